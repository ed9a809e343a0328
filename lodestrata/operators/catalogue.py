"""Building a typed property graph from tables: nodes, edges by kind, the lexical dictionary."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..codes import EDGE_KINDS, NODE_KINDS, code
from ..functions.ids import node_id
from ..session import ensure_checkpoint_dir, table

REPOSITORY = "catalog"


def _nodes(df: DataFrame, kind: str, name: Column, qualified: Column, path: Column, file_path: Column, flags: Column | None = None, ordinal: Column | None = None) -> DataFrame:
    kind_code, ordinal = F.lit(code(NODE_KINDS, kind)), F.lit(0).cast("bigint") if ordinal is None else ordinal
    return df.select(
        node_id(kind_code, F.lit(REPOSITORY), path, qualified, ordinal).alias("node_id"),
        kind_code.cast("tinyint").alias("kind"),
        name.alias("name"),
        qualified.alias("qualified_name"),
        file_path.cast("string").alias("file_path"),
        (F.lit(0) if flags is None else flags).cast("int").alias("flags"),
    )


def parts(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """Each group of nodes with the keys its edges need."""
    t = lambda name: table(spark, sf_dir, name)
    none = F.lit(None)
    nation = t("nation").join(F.broadcast(t("region")), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "n_name", "r_name", F.concat_ws("/", "r_name", "n_name").alias("dir"))
    # the directories of a catalogue are a fixed small set (nations), whatever the scale
    customer = t("customer").join(F.broadcast(nation), F.col("c_nationkey") == F.col("n_nationkey")).withColumn("file", F.concat_ws("/", "dir", "c_name"))
    supplier = t("supplier").join(F.broadcast(nation), F.col("s_nationkey") == F.col("n_nationkey")).withColumn("file", F.concat_ws("/", "dir", "s_name"))
    orders = t("orders").join(customer.select("c_custkey", "c_name", "file"), F.col("o_custkey") == F.col("c_custkey"))
    orders = orders.withColumn("symbol", F.concat(F.lit("O"), F.col("o_orderkey").cast("string"))).withColumn("full", F.concat("c_name", F.lit("::"), "symbol"))
    status = F.when(F.col("o_orderstatus") == "F", 1).when(F.col("o_orderstatus") == "O", 2).otherwise(0)
    extra = F.when(F.col("o_orderpriority") == "5-LOW", 8).when(F.col("o_orderpriority") == "4-NOT SPECIFIED", 16).otherwise(0)
    part = t("part").withColumn("symbol", F.concat("p_name", F.lit("#"), F.col("p_partkey").cast("string")))
    one = spark.range(1)
    return {
        "repository": _nodes(one, "Repository", F.lit(REPOSITORY), F.lit(REPOSITORY), F.lit(""), none),
        "region": _nodes(t("region"), "Directory", F.col("r_name"), F.col("r_name"), F.col("r_name"), none),
        "nation": _nodes(nation, "Directory", F.col("n_name"), F.col("dir"), F.col("dir"), none),
        "customer": _nodes(customer, "File", F.col("c_name"), F.col("file"), F.col("file"), F.col("file")),
        "supplier": _nodes(supplier, "File", F.col("s_name"), F.col("file"), F.col("file"), F.col("file")),
        "orders": _nodes(orders, "Function", F.col("symbol"), F.col("full"), F.col("file"), F.col("file"), status + extra),
        "part": _nodes(part, "ConfigSymbol", F.col("symbol"), F.col("symbol"), F.lit(""), none),
        "_orders": orders.withColumn("status", status),
        "_part": part,
        "_nation": nation,
    }


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = None
    for name, df in parts(spark, sf_dir).items():
        if not name.startswith("_"):
            out = df if out is None else out.unionByName(df)
    return out


def _id(kind: str, path: Column, qualified: Column) -> Column:
    return node_id(F.lit(code(NODE_KINDS, kind)), F.lit(REPOSITORY), path, qualified, F.lit(0).cast("bigint"))


def edges(spark: SparkSession, sf_dir: str, kinds: list[str] | None = None) -> DataFrame:
    """(kind, src, dst), distinct.  Only the sources of the kinds asked for are read.

    Ids are computed from the keys on both sides, so no edge needs a join with the nodes.
    """
    p = parts(spark, sf_dir)
    dir_of = F.regexp_replace("file_path", "/[^/]*$", "")
    repo = _id("Repository", F.lit(""), F.lit(REPOSITORY))
    order_id = _id("Function", F.col("file"), F.col("full"))
    file_id = _id("File", F.col("file"), F.col("file"))

    def made(kind: str, df: DataFrame, src: Column, dst: Column) -> DataFrame:
        return df.select(F.lit(code(EDGE_KINDS, kind)).cast("tinyint").alias("kind"), src.alias("src"), dst.alias("dst"))

    def contains() -> list[DataFrame]:
        files = p["customer"].unionByName(p["supplier"])
        region = F.substring_index("qualified_name", "/", 1)
        return [
            made("CONTAINS", p["region"].unionByName(p["part"]), repo, F.col("node_id")),
            made("CONTAINS", p["nation"], _id("Directory", region, region), F.col("node_id")),
            made("CONTAINS", files, _id("Directory", dir_of, dir_of), F.col("node_id")),
            made("CONTAINS", p["_orders"], file_id, order_id),
        ]

    def guarded() -> list[DataFrame]:
        part = p["_part"].select("p_partkey", _id("ConfigSymbol", F.lit(""), F.col("symbol")).alias("part_id"))
        lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey").distinct()
        both = lines.join(part, F.col("l_partkey") == F.col("p_partkey")).join(p["_orders"].select("o_orderkey", order_id.alias("order_id")), F.col("l_orderkey") == F.col("o_orderkey"))
        return [made("GUARDED_BY", both, F.col("order_id"), F.col("part_id"))]

    build = {
        "CONTAINS": contains,
        "DECLARES": lambda: [made("DECLARES", p["_orders"].filter("status = 2"), file_id, order_id)],
        "DEFINES": lambda: [made("DEFINES", p["_orders"].filter("status = 1"), file_id, order_id)],
        "GUARDED_BY": guarded,
    }
    out = None
    for kind in kinds or build:
        for df in build[kind]():
            out = df if out is None else out.unionByName(df)
    return out.distinct()


def reverse(edges_df: DataFrame) -> DataFrame:
    return edges_df.select("kind", F.col("dst").alias("src"), F.col("src").alias("dst"))


def lookup(nodes_df: DataFrame) -> DataFrame:
    """(folded, key, node_id, target, kind, flags, path): name 0, qualified name 1, owning file's path 2; no empty keys.

    What a hit is ranked by stands beside its key, so that a search reads nothing else before its limit.  Texts of
    ASCII only need neither composing nor folding by Python; the others are a branch of their own.
    """
    from ..functions.text import lookup_key
    from .search import rank_path

    targets = F.array(*[F.struct(F.col(c).alias("text"), F.lit(i).cast("tinyint").alias("target")) for i, c in enumerate(("name", "qualified_name", "file_path"))])
    rows = nodes_df.select("node_id", "kind", "flags", rank_path().alias("path"), F.inline(targets)).filter("text is not null and text <> ''")
    rest = ["node_id", "target", "kind", "flags", "path"]
    ascii_ = F.octet_length("text") == F.length("text")

    def both(df: DataFrame, plain: Column, folded: Column) -> DataFrame:
        regions = F.array(F.struct(F.lit(False).alias("folded"), plain.alias("key")), F.struct(F.lit(True).alias("folded"), folded.alias("key")))
        return df.select(*rest, F.inline(regions)).select("folded", "key", *rest)

    other = rows.filter(~ascii_).select(*rest, lookup_key(F.col("text"), False).alias("__plain"), lookup_key(F.col("text"), True).alias("__folded"))
    return both(rows.filter(ascii_), F.col("text"), F.lower("text")).unionByName(both(other, F.col("__plain"), F.col("__folded")))


_PUBLISHED: dict[tuple[str, str], dict[str, DataFrame]] = {}


def published(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """The catalogue as an artifact: built, laid out and written once a session, then read.

    Queries over a graph read such an artifact, as they would that of an indexed tree: edges parted by kind and
    sorted by their beginning, in both directions, and the dictionary sorted by key.
    """
    from ..sources import store

    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _PUBLISHED:
        out = f"{ensure_checkpoint_dir(spark).rstrip('/')}/catalogue-{hashlib.sha256(repr(key).encode()).hexdigest()[:16]}"
        every = edges(spark, sf_dir)
        made = {"nodes": nodes(spark, sf_dir), "edges": every, "redges": reverse(every)}
        store.publish(spark, out, made | {"lookup": lookup(made["nodes"])})
        # a generation never changes: its tables stay open for the session
        _PUBLISHED[key] = store.open_artifact(spark, out)
    return _PUBLISHED[key]
