"""Statistics, windows and joins over files, symbols and reference candidates."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def dense_index(df: DataFrame, order: list[str]) -> DataFrame:
    """Rows numbered from 0 in order, without sending all rows to one task.

    Rows are range-partitioned and sorted; a partition's first number is the sum of the sizes of those before it,
    one row per partition.
    """
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__part", F.spark_partition_id())
    numbered = ranged.withColumn("__n", F.row_number().over(Window.partitionBy("__part").orderBy(*order)))
    sizes = ranged.groupBy("__part").agg(F.count("*").alias("__size"))
    before = sizes.select("__part", (F.sum("__size").over(Window.orderBy("__part")) - F.col("__size")).alias("__before"))
    # one row per partition: its size is bounded by the number of partitions
    return numbered.join(F.broadcast(before), "__part").withColumn("dense_idx", F.col("__before") + F.col("__n") - 1).drop("__part", "__n", "__before")


def ordinals(symbols: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    return symbols.withColumn("ordinal", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1)


def following(rows: DataFrame, key: str, order: list[str], is_note: str, name: str, line: str) -> DataFrame:
    """Forward as-of join within a key: each note with the first later row that isn't one.

    Rows are looked at from the last to the first, so that the frame only grows: linear in a key's rows.
    """
    back = [F.col(c).desc_nulls_last() for c in order]
    later = Window.partitionBy(key).orderBy(*back).rowsBetween(Window.unboundedPreceding, -1)
    target = F.last(F.when(~F.expr(is_note), F.struct(F.col(name).alias("n"), F.col(line).alias("l"))), ignorenulls=True).over(later)
    return rows.withColumn("__t", target).filter(F.expr(is_note) & F.col("__t").isNotNull()).withColumns({"target": F.col("__t.n"), "target_line": F.col("__t.l")}).drop("__t")


def budget_prefix(rows: DataFrame, order: list[str], size: str, budget: int) -> DataFrame:
    """The longest prefix in order whose sizes add up to the budget at most.

    Only rows that could still fit are looked at: sizes are positive, so at most ``budget`` rows can.
    """
    top = rows.orderBy(*order).limit(budget)
    running = F.sum(size).over(Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return top.withColumn("running", running).filter(F.col("running") <= budget)


def coverage(files: DataFrame, keys: list[str], path: str) -> DataFrame:
    """Per group the number of files and the two smallest paths, without gathering a group's paths.

    The two smallest come from two ``min`` passes that combine on the map side.
    """
    first = files.groupBy(*keys).agg(F.count("*").alias("files"), F.min(path).alias("first_path"))
    named = first.select(*[F.col(k).alias(f"__{k}") for k in keys], F.col("first_path").alias("__first"))
    same = F.lit(True)
    for k in keys:
        same &= F.col(k).eqNullSafe(F.col(f"__{k}"))
    rest = files.join(named, same & (F.col(path) > F.col("__first"))).groupBy(*[f"__{k}" for k in keys]).agg(F.min(path).alias("second_path"))
    return first.join(rest, same, "left").select(*keys, "files", "first_path", "second_path")


def top_samples(rows: DataFrame, kind: str, sample: str, most: int) -> DataFrame:
    """Exact count of each kind and its smallest distinct samples."""
    distinct = rows.select(kind, sample).distinct()
    rank = F.row_number().over(Window.partitionBy(kind).orderBy(sample))
    counts = rows.groupBy(kind).agg(F.count("*").alias("total"))
    return distinct.withColumn("rank", rank).filter(F.col("rank") <= most).join(counts, kind)


def full_difference(a: DataFrame, b: DataFrame, key: str, value: str) -> DataFrame:
    """Full outer comparison of two sides: which keys are new, gone, changed or the same."""
    x, y = a.select(key, F.col(value).alias("a"), F.lit(1).alias("in_a")), b.select(key, F.col(value).alias("b"), F.lit(1).alias("in_b"))
    state = F.when(F.col("in_a").isNull(), "added").when(F.col("in_b").isNull(), "deleted").when(F.col("a").eqNullSafe(F.col("b")), "unchanged").otherwise("changed")
    return x.join(y, key, "full_outer").select(key, state.alias("state"))
