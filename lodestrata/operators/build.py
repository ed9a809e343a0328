"""The property graph of an indexed tree: nodes, edges in both directions, references, the lexical dictionary.

Ids are made of what a file's own extraction knows, so neither parents nor sources of references need a join; only
directories are looked up, to tell those that the walk didn't see.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..codes import EDGE_KINDS, NODE_KINDS, code
from ..functions import paths as P
from ..functions.ids import node_id
from .catalogue import lookup, reverse
from .search import utf16
from .tables import dense_index

REPOSITORY, DIRECTORY, FILE, CONFIG = (code(NODE_KINDS, k) for k in ("Repository", "Directory", "File", "ConfigSymbol"))
CONTAINS, DECLARES, DEFINES, GUARDED_BY = (code(EDGE_KINDS, k) for k in ("CONTAINS", "DECLARES", "DEFINES", "GUARDED_BY"))


def _id(repository: str, kind: Column | int, path: Column, qualified: Column, ordinal: Column | int = 0) -> Column:
    as_column = lambda x, t: (F.lit(x) if isinstance(x, int) else x).cast(t)
    return node_id(as_column(kind, "int"), F.lit(repository), path, qualified, as_column(ordinal, "bigint"))


def graph(spark: SparkSession, repository: str, directories: DataFrame, files: DataFrame) -> dict[str, DataFrame]:
    """The tables of an artifact.

    directories: (path); files: rows of ``discover.read``, each with its symbols and references.  A symbol without a
    parent belongs to its file, a directory or file whose parent wasn't seen to the repository (with a diagnostic).
    """
    root = _id(repository, REPOSITORY, F.lit(""), F.lit(repository))
    path = F.col("path")
    file_id, directory_id = _id(repository, FILE, path, path), _id(repository, DIRECTORY, path, path)
    symbols = files.select("path", "language", F.posexplode("symbols").alias("pos", "s")).select("path", "language", "pos", "s.*")
    symbols = symbols.withColumn("node_id", _id(repository, F.col("kind"), path, F.col("qualified_name"), F.col("ordinal")))
    refs = files.select("path", "language", F.inline("refs"))
    source = F.when(F.col("source_kind").isNull(), file_id).otherwise(_id(repository, F.col("source_kind"), path, F.col("source_qualified"), F.col("source_ordinal")))
    refs = refs.select(source.alias("source"), "target", "qualifier", "line", "start_byte", "end_byte", "language", "edge_kind", "stage", "confidence")
    guarded = refs.filter((F.col("edge_kind") == GUARDED_BY) & (F.col("target") != "")).select("source", "target").distinct()
    names = guarded.select(F.col("target").alias("name")).distinct()
    config_id = lambda c: _id(repository, CONFIG, F.lit(""), c)

    none, zero = F.lit(None).cast("string"), F.lit(0).cast("bigint")

    def made(df: DataFrame, cls: int, kind: Column | int, ident: Column, name: Column, qualified: Column, file_path: Column, language: Column, flags: Column, lines: tuple[Column, Column], ordinal: Column, size: tuple[Column, Column], order: Column, pos: Column) -> DataFrame:
        return df.select(
            ident.alias("node_id"), (F.lit(kind) if isinstance(kind, int) else kind).cast("tinyint").alias("kind"), language.cast("smallint").alias("language"), flags.cast("int").alias("flags"),
            file_path.alias("file_path"), name.alias("name"), qualified.alias("qualified_name"), lines[0].cast("int").alias("start_line"), lines[1].cast("int").alias("end_line"), ordinal.cast("bigint").alias("ordinal"),
            size[0].cast("bigint").alias("start_byte"), size[1].cast("bigint").alias("end_byte"), F.lit(cls).alias("__class"), utf16(order).alias("__order"), pos.cast("bigint").alias("__pos"),
        )

    nothing = (zero, zero)
    first = F.when(F.col("line_count") > 0, 1).otherwise(0)
    repo = F.lit(repository)
    nodes = [
        made(spark.range(1), 0, REPOSITORY, root, repo, repo, none, zero, zero, nothing, zero, nothing, F.lit(""), zero),
        made(directories, 1, DIRECTORY, directory_id, P.file_name(path), path, none, zero, zero, nothing, zero, nothing, path, zero),
        made(files, 2, FILE, file_id, P.file_name(path), path, path, F.col("language"), F.col("flags"), (first, F.col("line_count")), zero, (zero, F.col("size_bytes")), path, zero),
        made(symbols, 3, F.col("kind"), F.col("node_id"), F.col("name"), F.col("qualified_name"), path, F.col("language"), F.col("flags"), (F.col("start_line"), F.col("end_line")), F.col("ordinal"), (F.col("start_byte"), F.col("end_byte")), path, F.col("pos")),
        made(names, 4, CONFIG, config_id(F.col("name")), F.col("name"), F.col("name"), none, zero, zero, nothing, zero, nothing, F.col("name"), zero),
    ]
    nodes = dense_index(reduce(DataFrame.unionByName, nodes), ["__class", "__order", "__pos"]).drop("__class", "__order", "__pos")

    edge = lambda df, kind, src, dst: df.select(F.lit(kind).cast("tinyint").alias("kind"), src.alias("src"), dst.alias("dst"))
    known = directories.select(path.alias("up"))
    inner = directories.select("path", directory_id.alias("node_id")).unionByName(files.select("path", file_id.alias("node_id"))).withColumn("up", P.parent(path))
    placed = inner.join(known.withColumn("seen", F.lit(True)), "up", "left")
    above = F.when(F.col("seen"), _id(repository, DIRECTORY, F.col("up"), F.col("up"))).otherwise(root)
    parent = F.when(F.col("parent_kind").isNull(), file_id).otherwise(_id(repository, F.col("parent_kind"), path, F.col("parent_qualified"), F.col("parent_ordinal")))
    edges = [
        edge(placed, CONTAINS, above, F.col("node_id")),
        edge(symbols, CONTAINS, parent, F.col("node_id")),
        edge(names, CONTAINS, root, config_id(F.col("name"))),
        edge(symbols.filter(F.col("flags").bitwiseAND(2) != 0), DECLARES, file_id, F.col("node_id")),
        edge(symbols.filter(F.col("flags").bitwiseAND(1) != 0), DEFINES, file_id, F.col("node_id")),
        edge(guarded, GUARDED_BY, F.col("source"), config_id(F.col("target"))),
    ]
    edges = reduce(DataFrame.unionByName, edges).distinct()
    lost = placed.filter("seen is null and up <> ''").select(F.lit("PathRejected").alias("kind"), "path", F.lit("its directory was not seen").alias("detail"))
    return {"nodes": nodes, "edges": edges, "redges": reverse(edges), "files": files.drop("symbols", "refs", "problem"), "refs": refs, "lookup": lookup(nodes), "lost": lost}


def coverage(files: DataFrame) -> DataFrame:
    """(language, tier, reason, files, two example paths): how far files were looked into, paths cut at 509 characters."""
    from .tables import coverage as examples

    cut = lambda c: F.when(F.length(c) > 512, F.concat(F.substring(c, 1, 509), F.lit("..."))).otherwise(F.col(c)).alias(c)
    found = examples(files, ["language", "tier", "reason"], "path")
    return found.select("language", "tier", "reason", "files", cut("first_path"), cut("second_path"))


def tiers(files: DataFrame) -> DataFrame:
    """How many files were read by syntax, by lines, and not at all."""
    return files.agg(F.count_if(F.col("tier") == 2).alias("syntax"), F.count_if(F.col("tier") == 1).alias("lines"), F.count_if(F.col("tier") == 0).alias("not_extracted"))
