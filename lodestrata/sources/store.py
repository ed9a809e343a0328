"""Artifacts: immutable generations in Parquet, a manifest that names the current one, verification."""

from __future__ import annotations

import hashlib
import json
import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..codes import EDGE_KINDS, FLAG_MASK, NODE_KINDS
from .files import Files

FORMAT, MANIFEST = 4, "manifest.json"
#: How a table is laid out: the column that parts its folders, the columns its files are sorted by.
PARTED = {"edges": "kind", "redges": "kind"}
SORTED = {"nodes": ["node_id"], "lookup": ["folded", "key"], "edges": ["src"], "redges": ["src"], "files": ["path"]}


class Corrupt(RuntimeError):
    """An artifact that can't be read as what it says it is."""


def content_hash(df: DataFrame) -> tuple[int, str]:
    """Rows and an order-free hash of a table: sums of two 64-bit row hashes, so any plan gives the same."""
    columns = sorted(df.columns)
    # a null adds nothing to a hash, so that it is one is hashed as well
    each = [*(F.col(c) for c in columns), *(F.col(c).isNull() for c in columns)]
    wide = lambda h: F.sum(h.cast("decimal(38,0)"))
    r = df.agg(F.count("*").alias("n"), wide(F.xxhash64(*each)).alias("a"), wide(F.xxhash64(F.lit(1), *each)).alias("b")).first()
    return r["n"], hashlib.sha256(f"{r['n']},{r['a']},{r['b']}".encode()).hexdigest()


def publish(spark: SparkSession, out: str, tables: dict[str, DataFrame], complete: bool = True, allow_partial: bool = False, about: dict | None = None) -> str:
    """Write the tables into a staging folder, name it by its contents, then replace the manifest.

    One writer at a time; a scan that wasn't complete doesn't replace an artifact unless allowed, and nodes with
    equal ids are never published.  The folder may lie in any file system that driver and executors share.
    """
    files = Files(spark, out)
    if not complete and not allow_partial and files.exists(files.at(MANIFEST)):
        raise Partial("the scan was not complete; the artifact stays as it is")
    files.make(files.at("segments"))
    lock = files.at("lock")
    if not files.take(lock):
        raise Locked(f"another writer holds {lock}")
    staging = files.at("segments", f".staging-{uuid.uuid4().hex}")
    try:
        counts, written = {}, {}
        for name, df in tables.items():
            if name == "redges" and "edges" in written:
                # the stored edges turned round, so that they aren't built again
                df = written["edges"].select("kind", F.col("dst").alias("src"), F.col("src").alias("dst"))
            elif name == "lookup" and "nodes" in written:
                from ..operators.catalogue import lookup

                df = lookup(written["nodes"])
            by = [*([PARTED[name]] if name in PARTED else []), *SORTED.get(name, [])]
            if by:
                # ranges are sampled and then filled: what is ranged is written before, so it is worked out once
                raw = f"{staging}/.raw-{name}"
                df.write.parquet(raw)
                df = spark.read.parquet(raw).repartitionByRange(*by).sortWithinPartitions(*by)
            w = df.write
            if name in PARTED:
                w = w.partitionBy(PARTED[name])
            w.parquet(f"{staging}/{name}")
            if by:
                files.delete(raw)
            written[name] = spark.read.parquet(f"{staging}/{name}")
            n, digest = content_hash(written[name])
            counts[name] = {"rows": n, "hash": digest}
        if "nodes" in written and not (twice := written["nodes"].groupBy("node_id").count().filter("count > 1").limit(1)).isEmpty():
            raise Collision(f"two nodes have the id {twice.first()['node_id']}")
        lines = "".join(f"{k}\0{v['rows']}\0{v['hash']}\n" for k, v in sorted(counts.items()))
        generation = hashlib.sha256(lines.encode()).hexdigest()[:32]
        final = files.at("segments", generation)
        if not files.exists(final):
            files.move(staging, final)
        before = manifest(spark, out)["generation"] if files.exists(files.at(MANIFEST)) else None
        made = {"formatVersion": FORMAT, "generation": generation, "previous": before if before != generation else None, "complete": complete, "tables": counts, "about": about or {}}
        files.write(files.at(MANIFEST), json.dumps(made, sort_keys=True))
        # the generation before stays for its readers, older ones go
        for name in files.names(files.at("segments")):
            if not name.startswith(".") and name not in (generation, before):
                files.delete(files.at("segments", name))
        return generation
    finally:
        files.delete(staging)
        files.delete(lock)


class Partial(RuntimeError):
    """A scan that wasn't complete would replace an artifact."""


class Locked(RuntimeError):
    """Another writer is at work."""


class Collision(RuntimeError):
    """Two nodes have one id."""


_TYPES = {"formatVersion": int, "generation": str, "complete": bool, "tables": dict}


def manifest(spark: SparkSession, out: str) -> dict:
    """The manifest, each field of its type; anything else is corrupt."""
    try:
        files = Files(spark, out)
        m = json.loads(files.read(files.at(MANIFEST)))
    except Exception as e:
        raise Corrupt(f"no readable manifest in {out}") from e
    if not isinstance(m, dict) or any(type(m.get(k)) is not t for k, t in _TYPES.items()):
        raise Corrupt("the manifest isn't what it should be")
    if m["formatVersion"] != FORMAT:
        raise Corrupt(f"unknown format version {m.get('formatVersion')}")
    return m


def open_artifact(spark: SparkSession, out: str) -> dict[str, DataFrame]:
    """The tables of one generation; if another was published meanwhile, that one."""
    for _ in range(4):
        m = manifest(spark, out)
        try:
            tables = {n: spark.read.parquet(Files(spark, out).at("segments", m["generation"], n)) for n in m["tables"]}
        except Exception as e:
            raise Corrupt(f"a table of generation {m['generation']} is missing") from e
        if manifest(spark, out)["generation"] == m["generation"]:
            return tables
    raise Corrupt("the artifact kept changing while it was opened")


def transpose_issues(edges: DataFrame, redges: DataFrame) -> DataFrame:
    """Edges that lack their stored reverse, and reverses that lack their edge."""
    turned = redges.select("kind", F.col("dst").alias("src"), F.col("src").alias("dst"))
    e = edges.select("kind", "src", "dst")
    return e.exceptAll(turned).unionByName(turned.exceptAll(e))


def lookup_issues(nodes: DataFrame, keys: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(missing, extra) postings of a stored dictionary, both regions, folded and composed anew from the nodes."""
    from ..operators.catalogue import lookup

    columns = ["folded", "key", "node_id", "target"]
    want, have = lookup(nodes).select(*columns), keys.select(*columns)
    return want.exceptAll(have), have.exceptAll(want)


_BAD_NODE = f"NOT (kind BETWEEN 1 AND {len(NODE_KINDS)} AND flags BETWEEN 0 AND {FLAG_MASK} AND (kind <> 3 OR file_path IS NOT NULL) AND (kind NOT IN (1, 2) OR file_path IS NULL))"
_BAD_EXTENT = "NOT (start_line >= 0 AND start_line <= end_line AND start_byte >= 0 AND start_byte <= end_byte AND ordinal >= 0)"
_BAD_REF = f"NOT (edge_kind BETWEEN 1 AND {len(EDGE_KINDS)} AND stage BETWEEN 0 AND 6 AND confidence BETWEEN 1 AND 3 AND line >= 0 AND start_byte >= 0 AND start_byte <= end_byte)"
_BAD_FILE = "NOT (encoding BETWEEN 1 AND 12 AND line_count >= 0 AND size_bytes >= 0)"


def verify(spark: SparkSession, out: str) -> DataFrame:
    """(check, issues): counts and hashes first; structure only if they hold, graph and dictionary only if that does."""
    m, tables = manifest(spark, out), open_artifact(spark, out)
    found: list[tuple[str, int]] = []
    for name, said in m["tables"].items():
        n, digest = content_hash(tables[name])
        found.append((f"contents of {name}", int((n, digest) != (said["rows"], said["hash"]))))
    sound = lambda: not any(n for _, n in found)
    done = lambda: spark.createDataFrame(found, "check string, issues bigint")
    if not sound() or not {"nodes", "edges"} <= tables.keys():
        return done()
    nodes, edges = tables["nodes"], tables["edges"]
    count = lambda name, df: found.append((name, df.count()))
    count("repeated ids", nodes.groupBy("node_id").count().filter("count > 1"))
    count("fields of nodes", nodes.filter(_BAD_NODE))
    if "start_line" in nodes.columns:
        count("extents of nodes", nodes.filter(_BAD_EXTENT))
    if "dense_idx" in nodes.columns:
        span = nodes.agg(F.min("dense_idx").alias("a"), F.max("dense_idx").alias("b"), F.countDistinct("dense_idx").alias("n"), F.count("*").alias("all")).first()
        found.append(("dense numbers", int(span["all"] > 0 and (span["a"], span["b"] + 1, span["n"]) != (0, span["all"], span["all"]))))
        count("ids", _other_ids(nodes))
    count("repeated edges", edges.groupBy("kind", "src", "dst").count().filter("count > 1"))
    ends = reduce(DataFrame.unionByName, [edges.select(F.col(c).alias("node_id")) for c in ("src", "dst")]).distinct()
    count("edges without node", ends.join(nodes, "node_id", "left_anti"))
    if "refs" in tables:
        count("fields of references", tables["refs"].filter(_BAD_REF))
        count("references without node", tables["refs"].select(F.col("source").alias("node_id")).distinct().join(nodes, "node_id", "left_anti"))
    if "files" in tables and "file_path" in nodes.columns:
        count("fields of files", tables["files"].filter(_BAD_FILE))
        count("nodes of files", nodes.filter("kind = 3").join(tables["files"], F.col("file_path") == F.col("path"), "full_outer").filter("node_id IS NULL OR path IS NULL"))
    if sound() and "redges" in tables:
        count("transpose", transpose_issues(edges, tables["redges"]))
    if sound() and "lookup" in tables:
        missing, extra = lookup_issues(nodes, tables["lookup"])
        count("dictionary lacks", missing)
        count("dictionary has besides", extra)
    return done()


def _other_ids(nodes: DataFrame) -> DataFrame:
    """Nodes whose id isn't that of their kind, path, qualified name and ordinal."""
    from ..functions.ids import node_id

    root = nodes.filter("kind = 1").select(F.col("qualified_name").alias("repository"))
    # one row
    both = nodes.crossJoin(F.broadcast(root.limit(1)))
    path = F.when(F.col("kind") == 2, F.col("qualified_name")).otherwise(F.coalesce("file_path", F.lit("")))
    return both.filter(F.col("node_id") != node_id(F.col("kind").cast("int"), F.col("repository"), path, F.col("qualified_name"), F.col("ordinal")))


def differences(one: dict[str, DataFrame], other: dict[str, DataFrame]) -> list[tuple[str, int]]:
    """Rows of each table that stand in one artifact only."""
    found = []
    for name in sorted(one.keys() | other.keys()):
        if name not in one or name not in other:
            found.append((name, -1))
            continue
        a, b = one[name], other[name].select(*one[name].columns)
        found.append((name, a.exceptAll(b).count() + b.exceptAll(a).count()))
    return found
