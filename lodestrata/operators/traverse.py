"""Bounded graph traversal: one hop, breadth-first neighbourhoods, shortest paths, context packs.

A frontier of counted, small size is kept on the driver and sent to the tasks, where it prunes the edges that are
read; beyond ``MOST_SENT`` nodes frontiers become tables, joined by shuffling and cut off by checkpoints.  Both ways
give the same rows.  Reverse edges are read from their stored table where there is one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir
from .search import ORDER, SUBSTRING, UserError, by_ids, composed, local, placed

DEEPEST = 64
#: Nodes up to which what was reached stays on the driver, 32 bytes each.
MOST_SENT = 100_000


def arcs(edges: DataFrame, direction: str, kinds: list[int] | None = None, redges: DataFrame | None = None) -> list[DataFrame]:
    """(at, to, kind, src, dst) for each direction of travel; src and dst keep the edge as it is."""
    if direction not in ("in", "out", "both"):
        raise UserError(f"unknown direction: {direction}")
    some = lambda e: e.filter(F.col("kind").isin(*kinds)) if kinds else e
    out = some(edges).select(F.col("src").alias("at"), F.col("dst").alias("to"), "kind", "src", "dst")
    if redges is None:
        back = some(edges).select(F.col("dst").alias("at"), F.col("src").alias("to"), "kind", "src", "dst")
    else:
        # turned round: what it begins with is what the edge ends with
        back = some(redges).select(F.col("src").alias("at"), F.col("dst").alias("to"), "kind", F.col("dst").alias("src"), F.col("src").alias("dst"))
    return [out] if direction == "out" else [back] if direction == "in" else [out, back]


def _all(sides: list[DataFrame]) -> DataFrame:
    return sides[0] if len(sides) == 1 else sides[0].unionByName(sides[1])


def neighbors(edges: DataFrame, node: str, direction: str = "both", kinds: list[int] | None = None, redges: DataFrame | None = None) -> DataFrame:
    return _all([a.filter(F.col("at") == node) for a in arcs(edges, direction, kinds, redges)]).select(F.col("to").alias("node_id")).distinct()


def _at(spark: SparkSession, sides: list[DataFrame], nodes: list[str]) -> DataFrame:
    """The arcs that begin at some nodes, at most MOST_SENT."""
    return _all([by_ids(a, nodes, "at") for a in sides])


def distances(edges: DataFrame, seeds: DataFrame | list[str], depth: int, direction: str = "both", kinds: list[int] | None = None, redges: DataFrame | None = None, most_sent: int = MOST_SENT) -> DataFrame:
    """(node_id, distance) of every node within ``depth`` of a seed, a table or a list of ids; one job a level."""
    if not 0 <= depth <= DEEPEST:
        raise UserError(f"depth must lie between 0 and {DEEPEST}")
    spark = edges.sparkSession
    sides = arcs(edges, direction, kinds, redges)
    first = list(dict.fromkeys(seeds)) if isinstance(seeds, list) else [r[0] for r in seeds.select("node_id").distinct().limit(most_sent + 1).collect()]
    if len(first) > most_sent:
        seeds = local(spark, [(n,) for n in first], "node_id string") if isinstance(seeds, list) else seeds
        return _far(sides, seeds.select("node_id").distinct().withColumn("distance", F.lit(0)), 1, depth)
    reached = dict.fromkeys(first, 0)
    frontier = first
    for level in range(1, depth + 1):
        if not frontier:
            break
        # those reached before come again at most once each, so a full list of this size is complete
        room = most_sent + len(reached) + 1
        near = _at(spark, sides, frontier).select("to").distinct().limit(room).toArrow()["to"].to_pylist()
        if len(near) == room or len(reached) + len(near) > 2 * most_sent:
            return _far(sides, _local(spark, reached), level, depth)
        frontier = [n for n in near if n not in reached]
        reached |= dict.fromkeys(frontier, level)
    return _local(spark, reached)


def _local(spark: SparkSession, reached: dict[str, int]) -> DataFrame:
    return local(spark, list(reached.items()), "node_id string, distance int")


def _far(sides: list[DataFrame], reached: DataFrame, level: int, depth: int) -> DataFrame:
    """The levels from ``level`` on, with frontiers as tables.

    One join of the frontier with the edges a level; what was reached is cut off by a checkpoint after each, so the
    plan doesn't grow with the depth and a lost executor costs one level.
    """
    ensure_checkpoint_dir(reached.sparkSession)
    steps = _all([a.select("at", "to") for a in sides]).filter(F.col("at") != F.col("to"))
    frontier = reached.filter(F.col("distance") == level - 1)
    for k in range(level, depth + 1):
        near = frontier.join(steps, frontier.node_id == steps.at).select(F.col("to").alias("node_id")).distinct()
        frontier = near.join(reached, "node_id", "left_anti").withColumn("distance", F.lit(k))
        if k < depth:
            frontier = frontier.checkpoint()
            if frontier.isEmpty():
                break
        reached = reached.unionByName(frontier)
    return reached


def expanded_edges(edges: DataFrame, reached: DataFrame, depth: int, direction: str = "both", kinds: list[int] | None = None, redges: DataFrame | None = None) -> DataFrame:
    """Edges at nodes that were expanded, those nearer than ``depth``; between two boundary nodes there is none."""
    inner = reached.filter(F.col("distance") < depth).select(F.col("node_id").alias("at"))
    return _all([a.join(inner, "at", "left_semi") for a in arcs(edges, direction, kinds, redges)]).select("kind", "src", "dst").distinct()


def shortest_path(edges: DataFrame, source: str, target: str, depth: int = 16, direction: str = "both", kinds: list[int] | None = None, redges: DataFrame | None = None, most_sent: int = MOST_SENT) -> list[str] | None:
    """Nodes of a shortest path, the smallest by id where several are as short; None if there is none in reach.

    Two frontiers grow in turn, the smaller first; a level of one side is one job.  No limit cuts the search, so
    None always means that there is no path.
    """
    if source == target:
        return [source]
    spark = edges.sparkSession
    forward = arcs(edges, direction, kinds, redges)
    ways = [forward, arcs(edges, {"in": "out", "out": "in"}.get(direction, direction), kinds, redges)]
    came: list[dict[str, str | None]] = [{source: None}, {target: None}]
    fronts = [[source], [target]]
    for done in range(depth):
        k = 0 if len(fronts[0]) <= len(fronts[1]) else 1
        room = most_sent + len(came[k]) + 1
        level = _at(spark, ways[k], fronts[k]).groupBy("to").agg(F.min("at").alias("at")).limit(room).toArrow()
        if level.num_rows == room:
            return _far_path(spark, forward, came, fronts, depth - done)
        new = {to: at for to, at in zip(level["to"].to_pylist(), level["at"].to_pylist(), strict=True) if to not in came[k]}
        came[k] |= new
        fronts[k] = sorted(new)
        if not new:
            return None
        met = min((n for n in fronts[k] if n in came[1 - k]), default=None)
        if met is not None:
            return _joined(met, [came[0].get, came[1].get])
    return None


def _joined(met: str, via: list) -> list[str]:
    chains = []
    for came in via:
        chain = [met]
        while (up := came(chain[-1])) is not None:
            chain.append(up)
        chains.append(chain)
    return [*reversed(chains[0]), *chains[1][1:]]


def _far_path(spark: SparkSession, forward: list[DataFrame], came: list[dict], fronts: list[list[str]], depth: int) -> list[str] | None:
    """The same with both sides as tables, from where the driver's sides have come."""
    ensure_checkpoint_dir(spark)
    steps = _all([a.select("at", "to") for a in forward]).filter(F.col("at") != F.col("to")).distinct().checkpoint()
    schema = "node_id string, via string"
    sides = [local(spark, list(c.items()), schema) for c in came]
    edge = [local(spark, [(n,) for n in f], "node_id string") for f in fronts]
    sizes = [len(f) for f in fronts]
    for _ in range(depth):
        k = 0 if sizes[0] <= sizes[1] else 1
        walk = steps if k == 0 else steps.select(F.col("to").alias("at"), F.col("at").alias("to"))
        level = edge[k].join(walk, edge[k].node_id == walk.at).groupBy(F.col("to").alias("node_id")).agg(F.min("at").alias("via"))
        new = level.join(sides[k].select("node_id"), "node_id", "left_anti").checkpoint()
        sides[k], edge[k], sizes[k] = sides[k].unionByName(new), new.select("node_id"), new.count()
        if not sizes[k]:
            return None
        met = new.join(sides[1 - k].select("node_id"), "node_id").agg(F.min("node_id")).first()[0]
        if met is not None:
            def back(side: DataFrame):
                return lambda node: (side.filter(F.col("node_id") == node).select("via").first() or [None])[0]

            return _joined(met, [back(sides[0]), back(sides[1])])
    return None


def degrees(edges: DataFrame, incoming: bool) -> DataFrame:
    end = "dst" if incoming else "src"
    return edges.groupBy("kind", F.col(end).alias("node_id")).agg(F.count("*").alias("degree"))


def overview(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Repository and directories with their depth and the number of their direct members."""
    shape = nodes.filter(F.col("kind").isin(1, 2)).select("node_id", "kind", "qualified_name", F.when(F.col("kind") == 1, 0).otherwise(F.size(F.split("qualified_name", "/"))).alias("distance"))
    weight = edges.filter("kind = 1").groupBy(F.col("src").alias("node_id")).agg(F.count("*").alias("weight"))
    return shape.join(weight, "node_id", "left").select("node_id", "kind", "qualified_name", "distance", F.coalesce("weight", F.lit(0)).alias("weight"))


def matches(lookup: DataFrame, nodes: DataFrame, keywords: list[str]) -> DataFrame:
    """(word, node_id, what it is ranked by): the best hit of each node for each keyword, in one pass over the dictionary."""
    keys = [composed(w) for w in keywords]
    strength = lambda k: F.when(F.col("key") == k, 0).when(F.startswith("key", F.lit(k)), 1).when(F.contains("key", F.lit(k)), SUBSTRING)
    each = F.array(*[F.struct(F.lit(i).alias("word"), strength(k).alias("strength")) for i, k in enumerate(keys)])
    beside = [c for c in ("kind", "flags", "path") if c in lookup.columns]
    any_key = F.lit(False)
    for k in keys:
        any_key = any_key | F.contains("key", F.lit(k))
    rows = lookup.filter(~F.col("folded") & any_key).select("node_id", "target", *beside, F.inline(F.filter(each, lambda x: x["strength"].isNotNull())))
    best = rows.groupBy("word", "node_id").agg(F.min(F.struct("strength", "target")).alias("best"), *[F.min(c).alias(c) for c in beside])
    return placed(best.select("word", "node_id", F.col("best.strength").alias("strength"), F.col("best.target").cast("int").alias("target"), *beside), nodes)


def context_pack(lookup: DataFrame, nodes: DataFrame, edges: DataFrame, keywords: list[str], limit: int = 50, depth: int = 1, redges: DataFrame | None = None) -> DataFrame:
    """(node_id, distance, pos): per keyword the best hits interleaved, then their neighbourhood, ``limit`` nodes in all."""
    if not 1 <= len(keywords) <= 32:
        raise UserError("between 1 and 32 keywords")
    spark = nodes.sparkSession
    core_size = limit if depth == 0 else max(1, limit // 2)
    rank = F.row_number().over(Window.partitionBy("word").orderBy(*ORDER))
    # at most core_size rows of each keyword
    best = matches(lookup, nodes, keywords).withColumn("rank", rank).filter(F.col("rank") <= core_size).select("node_id", "word", "rank").collect()
    core = list(dict.fromkeys(r["node_id"] for r in sorted(best, key=lambda r: (r["rank"], r["word"]))))[:core_size]
    schema = "node_id string, distance int, pos int"
    placed_ = [(n, 0, k) for k, n in enumerate(core, 1)]
    if depth and core:
        near = distances(edges, core, depth, redges=redges).filter("distance > 0").join(nodes.select("node_id", "kind"), "node_id")
        more = near.orderBy("distance", "kind", "node_id").limit(limit - len(core)).collect()
        placed_ += [(r["node_id"], r["distance"], k) for k, r in enumerate(more, len(core) + 1)]
    return local(spark, placed_, schema)
