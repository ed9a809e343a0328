"""Lexical search over names, qualified names and paths with a total ranking order."""

from __future__ import annotations

import unicodedata

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

EXACT, PREFIX, SUBSTRING = 0, 1, 2
MOST_CHARS = 4096


class UserError(ValueError):
    """An argument outside its range."""


def checked(needle: str) -> str:
    if not needle:
        raise UserError("the search text is empty")
    if len(needle) > MOST_CHARS:
        raise UserError(f"the search text is longer than {MOST_CHARS} characters")
    if any(0xD800 <= ord(c) <= 0xDFFF for c in needle):
        raise UserError("the search text holds an unpaired surrogate")
    return needle


def utf16(c: Column) -> Column:
    """Sort key of the ordinal order by UTF-16 code units."""
    return F.encode(c, "UTF-16BE")


def rank_path() -> Column:
    """The path a node is ranked by: its file's, a directory's own, else none."""
    return F.coalesce("file_path", F.when(F.col("kind") == 2, F.col("qualified_name")), F.lit(""))


def penalty(flags: Column) -> Column:
    """Vendored, generated and test each count one."""
    bit = lambda b: F.when(flags.bitwiseAND(b) != 0, 1).otherwise(0)
    return bit(16) + bit(8) + bit(4)


def hits(lookup: DataFrame, needle: str, ignore_case: bool = False, strengths: tuple[int, ...] = (EXACT, PREFIX, SUBSTRING), targets: tuple[int, ...] = (0, 1, 2)) -> DataFrame:
    """(node_id, strength, target): the best hit of each node.

    Exact and prefix searches compare with ``=`` and ``startswith``, which prune a dictionary sorted by key;
    only a substring search reads every key.
    """
    key = composed(needle)
    if ignore_case:
        key = unicodedata.normalize("NFC", "".join(c.lower() if len(c.lower()) == 1 else c for c in key))
    where = F.col("key").contains(key) if SUBSTRING in strengths else F.col("key").startswith(key) if PREFIX in strengths else F.col("key") == key
    strength = F.when(F.col("key") == key, EXACT).when(F.col("key").startswith(key), PREFIX).otherwise(SUBSTRING)
    rows = lookup.filter((F.col("folded") == ignore_case) & where & F.col("target").isin(*targets)).withColumn("strength", strength).filter(F.col("strength").isin(*strengths))
    beside = [c for c in ("kind", "flags", "path") if c in lookup.columns]
    best = rows.groupBy("node_id").agg(F.min(F.struct("strength", "target")).alias("best"), *[F.min(c).alias(c) for c in beside])
    return best.select("node_id", F.col("best.strength").alias("strength"), F.col("best.target").cast("int").alias("target"), *beside)


ORDER = ["strength", "target", "definition", "penalty", "kind", "__path", "node_id"]


def placed(hits_df: DataFrame, nodes: DataFrame) -> DataFrame:
    """Hits with what they are ranked by; it is looked up only if the dictionary didn't hold it."""
    if "path" not in hits_df.columns:
        hits_df = hits_df.join(nodes.select("node_id", "kind", "flags", rank_path().alias("path")), "node_id")
    definition = F.when(F.col("flags").bitwiseAND(1) != 0, 0).when(F.col("flags").bitwiseAND(2) != 0, 1).otherwise(2)
    return hits_df.withColumns({"definition": definition, "penalty": penalty(F.col("flags")), "__path": utf16(F.col("path"))}).drop("flags")


def ranked(hits_df: DataFrame, nodes: DataFrame, limit: int | None = None) -> DataFrame:
    """Hits with their nodes in ranking order; with a limit the first ones, through a bounded heap per task.

    With a limit, names are looked up after it: the ids that were kept, at most ``MOST_KEPT``, prune the nodes.
    """
    first = placed(hits_df, nodes)
    columns = ["node_id", "strength", "target", "definition", "penalty", "kind", "path"]
    names = nodes.select("node_id", "name", "qualified_name")
    if limit is None or limit > MOST_KEPT:
        first = first.orderBy(*ORDER).limit(limit) if limit is not None else first
        return names.join(first, "node_id").orderBy(*ORDER).select(*columns, "name", "qualified_name")
    kept = first.orderBy(*ORDER).limit(limit).select(*columns).collect()
    by = {r["node_id"]: r for r in by_ids(names, [r["node_id"] for r in kept]).collect()}
    rows = [(*r, by[r["node_id"]]["name"], by[r["node_id"]]["qualified_name"]) for r in kept]
    kinds = dict(first.dtypes)
    return local(nodes.sparkSession, rows, ", ".join([f"{c} {kinds[c]}" for c in columns] + ["name string", "qualified_name string"]))


#: Rows of an answer that the driver takes at most.
MOST_KEPT = 10_001
_ARROW = {"string": pa.string(), "int": pa.int32(), "tinyint": pa.int8(), "bigint": pa.int64()}


def local(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A few rows of the driver as a table, handed over as Arrow."""
    fields = [c.split() for c in schema.split(", ")]
    columns = list(zip(*rows, strict=True)) if rows else [()] * len(fields)
    return spark.createDataFrame(pa.table({n: pa.array(list(c), _ARROW[t]) for (n, t), c in zip(fields, columns, strict=True)}), schema)


def by_ids(df: DataFrame, ids: list[str], column: str = "node_id", most_listed: int = 64) -> DataFrame:
    """Rows with one of some ids: a filter that the scan sees, or for more ids a join with them sent to every task."""
    if len(ids) <= most_listed:
        return df.filter(F.col(column).isin(*ids)) if ids else df.limit(0)
    return df.join(F.broadcast(local(df.sparkSession, [(i,) for i in dict.fromkeys(ids)], f"{column} string")), column, "left_semi")


def named(lookup: DataFrame, text: str, most: int = 2) -> list[str]:
    """Ids of up to ``most`` nodes that a text names: the id it spells, or all with that exact name or qualified name."""
    if is_id(text):
        return [text.lower()]
    key = F.col("key") == composed(text)
    # a node is hit by its name and by its qualified name at most
    rows = lookup.filter(~F.col("folded") & key & F.col("target").isin(0, 1)).select("node_id").limit(2 * most).collect()
    return list(dict.fromkeys(r[0] for r in rows))[:most]


def composed(text: str) -> str:
    return unicodedata.normalize("NFC", checked(text))


def is_id(text: str) -> bool:
    return len(text) == 32 and all(c in "0123456789abcdefABCDEF" for c in text)


def resolve(lookup: DataFrame, nodes: DataFrame, text: str) -> DataFrame:
    """Nodes that a text names: the one with that id, else all with that exact name or qualified name."""
    if is_id(text):
        return nodes.filter(F.col("node_id") == text.lower())
    return nodes.join(hits(lookup, text, strengths=(EXACT,), targets=(0, 1)).select("node_id"), "node_id", "left_semi")
