"""Queries over the catalogue graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import catalogue as C
from ..operators import search as S
from ..operators import traverse as T
from ..session import table
from ..sources import store

_U32 = "unhex(substr(printf('%08x', {n}),7,2)||substr(printf('%08x', {n}),5,2)||substr(printf('%08x', {n}),3,2)||substr(printf('%08x', {n}),1,2))"


def _lp(s: str) -> str:
    return f"{_U32.format(n=f'octet_length(encode({s}))')}||encode({s})"


def _nid(kind: int, path: str, qualified: str) -> str:
    return f"substr(sha256(unhex('02')||unhex(printf('%02x', {kind}))||{_lp(chr(39) + C.REPOSITORY + chr(39))}||{_lp(path)}||{_lp(qualified)}||unhex('00000000')),1,32)"


GRAPH = f"""
nat AS (SELECT n_nationkey, n_name, r_name, r_name||'/'||n_name AS dir FROM nation JOIN region ON n_regionkey = r_regionkey),
cus AS (SELECT c_custkey, c_name, dir, dir||'/'||c_name AS file FROM customer JOIN nat ON c_nationkey = n_nationkey),
sup AS (SELECT s_name, dir, dir||'/'||s_name AS file FROM supplier JOIN nat ON s_nationkey = n_nationkey),
ord AS (SELECT o_orderkey, file, 'O'||o_orderkey AS symbol, c_name||'::O'||o_orderkey AS full_name, o_orderstatus,
  (CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 2 ELSE 0 END) + (CASE o_orderpriority WHEN '5-LOW' THEN 8 WHEN '4-NOT SPECIFIED' THEN 16 ELSE 0 END) AS flags
  FROM orders JOIN cus ON o_custkey = c_custkey),
prt AS (SELECT p_partkey, p_name||'#'||p_partkey AS symbol FROM part),
nodes AS (
 SELECT {_nid(1, "''", "'catalog'")} AS node_id, 1 AS kind, 'catalog' AS name, 'catalog' AS qualified_name, NULL::VARCHAR AS file_path, 0 AS flags
 UNION ALL SELECT {_nid(2, "r_name", "r_name")}, 2, r_name, r_name, NULL, 0 FROM region
 UNION ALL SELECT {_nid(2, "dir", "dir")}, 2, n_name, dir, NULL, 0 FROM nat
 UNION ALL SELECT {_nid(3, "file", "file")}, 3, c_name, file, file, 0 FROM cus
 UNION ALL SELECT {_nid(3, "file", "file")}, 3, s_name, file, file, 0 FROM sup
 UNION ALL SELECT {_nid(6, "file", "full_name")}, 6, symbol, full_name, file, flags FROM ord
 UNION ALL SELECT {_nid(12, "''", "symbol")}, 12, symbol, symbol, NULL, 0 FROM prt),
edges AS (
 SELECT DISTINCT * FROM (
 SELECT 1 AS kind, {_nid(1, "''", "'catalog'")} AS src, {_nid(2, "r_name", "r_name")} AS dst FROM region
 UNION ALL SELECT 1, {_nid(1, "''", "'catalog'")}, {_nid(12, "''", "symbol")} FROM prt
 UNION ALL SELECT 1, {_nid(2, "r_name", "r_name")}, {_nid(2, "dir", "dir")} FROM nat
 UNION ALL SELECT 1, {_nid(2, "dir", "dir")}, {_nid(3, "file", "file")} FROM cus
 UNION ALL SELECT 1, {_nid(2, "dir", "dir")}, {_nid(3, "file", "file")} FROM sup
 UNION ALL SELECT 1, {_nid(3, "file", "file")}, {_nid(6, "file", "full_name")} FROM ord
 UNION ALL SELECT 4, {_nid(3, "file", "file")}, {_nid(6, "file", "full_name")} FROM ord WHERE o_orderstatus = 'O'
 UNION ALL SELECT 5, {_nid(3, "file", "file")}, {_nid(6, "file", "full_name")} FROM ord WHERE o_orderstatus = 'F'
 UNION ALL SELECT 15, {_nid(6, "file", "full_name")}, {_nid(12, "''", "prt.symbol")} FROM lineitem JOIN ord ON l_orderkey = o_orderkey JOIN prt ON l_partkey = p_partkey) q),
keys AS (SELECT node_id, name AS key, 0 AS target FROM nodes WHERE name <> '' UNION ALL SELECT node_id, qualified_name, 1 FROM nodes WHERE qualified_name <> ''
 UNION ALL SELECT node_id, file_path, 2 FROM nodes WHERE file_path <> '')"""

QUERIES: dict = {}
SQL: dict[str, str] = {}


def artifact(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(nodes, edges, redges, lookup) of the catalogue's artifact."""
    t = C.published(spark, d)
    return t["nodes"], t["edges"], t["redges"], t["lookup"]


def query(name: str, sql: str | None = None):
    def register(f):
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = f"WITH RECURSIVE {GRAPH} {sql}" if not sql.lstrip().startswith(",") else f"WITH RECURSIVE {GRAPH}{sql}"
        return f

    return register


@query("catalogue_nodes", "SELECT * FROM nodes")
def _(spark: SparkSession, d: str) -> DataFrame:
    return C.nodes(spark, d)


for _kind, _code in (("CONTAINS", 1), ("DECLARES", 4), ("DEFINES", 5), ("GUARDED_BY", 15)):
    QUERIES[f"build_{_kind.lower()}"] = lambda spark, d, k=_kind: C.edges(spark, d, [k])
    SQL[f"build_{_kind.lower()}"] = f"WITH {GRAPH} SELECT * FROM edges WHERE kind = {_code}"


@query("node_kind_counts", "SELECT kind, count(*) AS n FROM nodes GROUP BY kind")
def _(spark, d):
    return artifact(spark, d)[0].groupBy("kind").agg(F.count("*").alias("n"))


@query("edge_kind_counts", "SELECT kind, count(*) AS n FROM edges GROUP BY kind")
def _(spark, d):
    return artifact(spark, d)[1].groupBy("kind").agg(F.count("*").alias("n"))


@query("id_collisions", "SELECT count(*) AS nodes, count(*) - count(DISTINCT node_id) AS collisions FROM nodes")
def _(spark, d):
    per = C.nodes(spark, d).groupBy("node_id").agg(F.count("*").alias("n"))
    return per.agg(F.sum("n").alias("nodes"), F.sum(F.col("n") - 1).alias("collisions"))


@query("lookup_entries", "SELECT target, count(*) AS n, count(DISTINCT key) AS keys FROM keys GROUP BY target")
def _(spark, d):
    return artifact(spark, d)[3].filter("not folded").groupBy("target").agg(F.count("*").alias("n"), F.countDistinct("key").alias("keys"))


def _hits_sql(match: str, key: str, column: str = "key", targets: str = "0, 1, 2") -> str:
    low = f"CASE WHEN {column} = {key} THEN 0 WHEN starts_with({column}, {key}) THEN 1 ELSE 2 END"
    return f""", h AS (SELECT node_id, min(({low}) * 10 + target) AS best FROM keys WHERE {match} AND target IN ({targets}) GROUP BY node_id)"""


_RANKED = """ SELECT n.node_id, best // 10 AS strength, best % 10 AS target, CASE WHEN flags & 1 <> 0 THEN 0 WHEN flags & 2 <> 0 THEN 1 ELSE 2 END AS definition,
 (flags >> 4 & 1) + (flags >> 3 & 1) + (flags >> 2 & 1) AS penalty, kind, coalesce(file_path, CASE WHEN kind = 2 THEN qualified_name END, '') AS path, name, qualified_name
 FROM h JOIN nodes n ON n.node_id = h.node_id"""
_ORDER = " ORDER BY strength, target, definition, penalty, kind, path, n.node_id LIMIT 50"


def _search(spark, d, needle, limit=50, **how):
    n, _, _, keys = artifact(spark, d)
    return S.ranked(S.hits(keys, needle, **how), n, limit)


@query("search_exact", _hits_sql("key = 'O7'", "'O7'") + _RANKED + _ORDER)
def _(spark, d):
    return _search(spark, d, "O7", strengths=(S.EXACT,))


@query("search_prefix", _hits_sql("starts_with(key, 'O12')", "'O12'") + _RANKED + _ORDER)
def _(spark, d):
    return _search(spark, d, "O12", strengths=(S.EXACT, S.PREFIX))


@query("search_substring", _hits_sql("contains(key, '00007')", "'00007'") + _RANKED)
def _(spark, d):
    return _search(spark, d, "00007", limit=None)


@query("search_ranked", _hits_sql("contains(key, 'O1')", "'O1'") + _RANKED + _ORDER)
def _(spark, d):
    return _search(spark, d, "O1")


@query("search_ignore_case", _hits_sql("contains(lower(key), 'america')", "'america'", "lower(key)") + _RANKED + _ORDER)
def _(spark, d):
    return _search(spark, d, "aMeRiCa", ignore_case=True)


@query("search_exact_names", _hits_sql("key = 'Customer#000000007'", "'Customer#000000007'", targets="0, 1") + _RANKED)
def _(spark, d):
    return _search(spark, d, "Customer#000000007", limit=None, strengths=(S.EXACT,), targets=(0, 1))


@query("resolve_unique", "SELECT node_id, kind, qualified_name FROM nodes WHERE name = 'EUROPE' OR qualified_name = 'EUROPE'")
def _(spark, d):
    n, _, _, keys = artifact(spark, d)
    return S.resolve(keys, n, "EUROPE").select("node_id", "kind", "qualified_name")


_CUSTOMER = f"(SELECT {_nid(3, 'file', 'file')} FROM cus WHERE c_custkey = 7)"


def _customer(spark, d) -> list[str]:
    """The node of one file, found by its name."""
    return S.named(artifact(spark, d)[3], "Customer#000000007")


for _dir, _sql in (
    ("out", "SELECT DISTINCT dst AS node_id FROM edges WHERE src = {c}"),
    ("in", "SELECT DISTINCT src AS node_id FROM edges WHERE dst = {c}"),
    ("both", "SELECT dst AS node_id FROM edges WHERE src = {c} UNION SELECT src FROM edges WHERE dst = {c}"),
):
    QUERIES[f"neighbors_{_dir}"] = lambda spark, d, k=_dir: T.neighbors(artifact(spark, d)[1], "".join(_customer(spark, d)[:1]), k, None, artifact(spark, d)[2])
    SQL[f"neighbors_{_dir}"] = f"WITH {GRAPH} " + _sql.format(c=_CUSTOMER)


def _bfs_sql(seeds: str, depth: int, both: bool = True, kinds: str = "") -> str:
    e = f"SELECT src AS a, dst AS b FROM edges {kinds}" + (f" UNION SELECT dst, src FROM edges {kinds}" if both else "")
    return f", st AS MATERIALIZED ({e}), w AS ({seeds} UNION SELECT b, dist + 1 FROM w JOIN st ON st.a = w.node_id WHERE dist < {depth}), r AS (SELECT node_id, min(dist) AS distance FROM w GROUP BY node_id)"


_SEED = f"SELECT {_nid(3, 'file', 'file')} AS node_id, 0 AS dist FROM cus WHERE c_custkey = 7"
for _depth in (1, 2, 3):
    QUERIES[f"bfs_d{_depth}"] = lambda spark, d, k=_depth: T.distances(artifact(spark, d)[1], _customer(spark, d), k, redges=artifact(spark, d)[2])
    SQL[f"bfs_d{_depth}"] = f"WITH RECURSIVE {GRAPH}" + _bfs_sql(_SEED, _depth) + " SELECT node_id, distance FROM r"


@query("bfs_multi_out", _bfs_sql("SELECT node_id, 0 AS dist FROM nodes WHERE kind = 2 AND name IN ('ASIA', 'EUROPE')", 3, False) + " SELECT node_id, distance FROM r")
def _(spark, d):
    n, e, r, _ = artifact(spark, d)
    return T.distances(e, n.filter("kind = 2 and name in ('ASIA', 'EUROPE')"), 3, "out", redges=r)


@query("bfs_kinds", _bfs_sql(_SEED, 2, True, "WHERE kind IN (5, 15)") + " SELECT node_id, distance FROM r")
def _(spark, d):
    _, e, r, _ = artifact(spark, d)
    return T.distances(e, _customer(spark, d), 2, "both", [5, 15], r)


@query("bfs_edges", _bfs_sql(_SEED, 2) + " SELECT DISTINCT kind, src, dst FROM edges WHERE src IN (SELECT node_id FROM r WHERE distance < 2) OR dst IN (SELECT node_id FROM r WHERE distance < 2)")
def _(spark, d):
    _, e, r, _ = artifact(spark, d)
    return T.expanded_edges(e, T.distances(e, _customer(spark, d), 2, redges=r), 2, redges=r)


@query("shortest_len", _bfs_sql(_SEED, 6) + f" SELECT distance AS hops FROM r WHERE node_id = {_nid(12, chr(39) * 2, '(SELECT symbol FROM prt WHERE p_partkey = 5)')}")
def _(spark, d):
    _, e, r, keys = artifact(spark, d)
    symbol = table(spark, d, "part").filter("p_partkey = 5").select(F.concat("p_name", F.lit("#"), F.col("p_partkey").cast("string"))).first()
    goal = "".join(S.named(keys, symbol[0])[:1]) if symbol else ""
    path = T.shortest_path(e, "".join(_customer(spark, d)[:1]), goal, 6, redges=r)
    rows = [] if path is None else [(len(path) - 1,)]
    return spark.createDataFrame(rows, "hops int")


@query("show_node", f"SELECT n.node_id, n.qualified_name, n.file_path, p.qualified_name AS parent FROM nodes n JOIN edges e ON e.dst = n.node_id AND e.kind = 1 JOIN nodes p ON p.node_id = e.src WHERE n.node_id = {_CUSTOMER}")
def _(spark, d):
    n, _, r, keys = artifact(spark, d)
    ids = S.named(keys, "Customer#000000007")
    # one node and its parents: their ids are known before the nodes are read
    up = [(x["src"], x["dst"]) for x in S.by_ids(r.filter("kind = 1"), ids, "src").select("src", "dst").collect()]
    by = {x["node_id"]: x for x in S.by_ids(n, [*ids, *(p for _, p in up)]).select("node_id", "qualified_name", "file_path").collect()}
    return S.local(spark, [(*by[c], by[p]["qualified_name"]) for c, p in up], "node_id string, qualified_name string, file_path string, parent string")


@query("containing_chain", f", up AS (SELECT {_CUSTOMER} AS node_id, 0 AS dist UNION SELECT src, dist + 1 FROM up JOIN edges ON dst = up.node_id AND kind = 1) SELECT node_id, dist AS distance FROM up")
def _(spark, d):
    _, e, r, _ = artifact(spark, d)
    return T.distances(e, _customer(spark, d), 8, "in", [1], r)


for _in, _end in ((False, "src"), (True, "dst")):
    QUERIES[f"degree_{'in' if _in else 'out'}"] = lambda spark, d, k=_in: T.degrees(artifact(spark, d)[1], k)
    SQL[f"degree_{'in' if _in else 'out'}"] = f"WITH {GRAPH} SELECT kind, {_end} AS node_id, count(*) AS degree FROM edges GROUP BY kind, {_end}"


@query("overview_aggregate", "SELECT n.node_id, n.kind, n.qualified_name, CASE WHEN n.kind = 1 THEN 0 ELSE len(string_split(n.qualified_name, '/')) END AS distance, count(e.dst) AS weight FROM nodes n LEFT JOIN edges e ON e.src = n.node_id AND e.kind = 1 WHERE n.kind IN (1, 2) GROUP BY ALL")
def _(spark, d):
    n, e, _, _ = artifact(spark, d)
    return T.overview(n, e)


_PACK = "".join(
    f", h{i} AS (SELECT node_id, min((CASE WHEN key = '{w}' THEN 0 WHEN starts_with(key, '{w}') THEN 1 ELSE 2 END) * 10 + target) AS best FROM keys WHERE contains(key, '{w}') GROUP BY node_id)"
    f", t{i} AS (SELECT n.node_id, row_number() OVER (ORDER BY best // 10, best % 10, CASE WHEN flags & 1 <> 0 THEN 0 WHEN flags & 2 <> 0 THEN 1 ELSE 2 END, (flags >> 4 & 1) + (flags >> 3 & 1), kind, coalesce(file_path, CASE WHEN kind = 2 THEN qualified_name END, ''), n.node_id) AS rk, {i} AS word FROM h{i} JOIN nodes n ON n.node_id = h{i}.node_id QUALIFY rk <= 10)"
    for i, w in enumerate(("O77", "Supplier#00000001"))
)


@query(
    "context_pack",
    _PACK
    + ", f AS (SELECT node_id, min(rk * 100 + word) AS first_at FROM (SELECT * FROM t0 UNION ALL SELECT * FROM t1) GROUP BY node_id), core AS (SELECT node_id, row_number() OVER (ORDER BY first_at) AS pos FROM f QUALIFY pos <= 10)"
    + _bfs_sql("SELECT node_id, 0 AS dist FROM core", 1)
    + ", m AS (SELECT r.node_id, distance, row_number() OVER (ORDER BY distance, kind, r.node_id) + (SELECT count(*) FROM core) AS pos FROM r JOIN nodes n ON n.node_id = r.node_id WHERE distance > 0) SELECT node_id, 0 AS distance, pos FROM core UNION ALL SELECT node_id, distance, pos FROM m WHERE pos <= 20",
)
def _(spark, d):
    n, e, r, keys = artifact(spark, d)
    return T.context_pack(keys, n, e, ["O77", "Supplier#00000001"], 20, 1, r)


@query("reverse_edges", "SELECT kind, dst AS src, src AS dst FROM edges")
def _(spark, d):
    """As stored."""
    return artifact(spark, d)[2].select("kind", "src", "dst")


@query("transpose_check", "SELECT kind, count(*) AS edges, 0 AS issues FROM edges GROUP BY kind")
def _(spark, d):
    """Of each kind the stored edges, and those whose stored reverse is missing or too many."""
    _, e, r, _ = artifact(spark, d)
    bad = store.transpose_issues(e, r).groupBy("kind").agg(F.count("*").cast("int").alias("issues"))
    return e.groupBy("kind").agg(F.count("*").alias("edges")).join(bad, "kind", "left").select("kind", "edges", F.coalesce("issues", F.lit(0)).alias("issues"))


@query("dangling_edges", "SELECT count(*) AS dangling FROM edges WHERE src NOT IN (SELECT node_id FROM nodes) OR dst NOT IN (SELECT node_id FROM nodes)")
def _(spark, d):
    n, e, _, _ = artifact(spark, d)
    ends = e.select(F.col("src").alias("node_id")).unionByName(e.select(F.col("dst").alias("node_id"))).distinct()
    return ends.join(n, "node_id", "left_anti").agg(F.count("*").alias("dangling"))


@query(
    "lookup_coverage",
    ", w AS (SELECT false AS folded, key, node_id, target FROM keys UNION ALL SELECT true, lower(key), node_id, target FROM keys) SELECT folded, target, count(*) AS postings, count(DISTINCT key) AS keys, 0 AS missing, 0 AS extra FROM w GROUP BY folded, target",
)
def _(spark, d):
    """The stored dictionary, both regions, against one made anew from the stored nodes."""
    n, _, _, keys = artifact(spark, d)
    missing, extra = store.lookup_issues(n, keys)
    per = keys.groupBy("folded", "target").agg(F.count("*").alias("postings"), F.countDistinct("key").alias("keys"))
    for name, df in (("missing", missing), ("extra", extra)):
        per = per.join(df.groupBy("folded", "target").agg(F.count("*").cast("int").alias(name)), ["folded", "target"], "left")
    return per.select("folded", "target", "postings", "keys", F.coalesce("missing", F.lit(0)).alias("missing"), F.coalesce("extra", F.lit(0)).alias("extra"))


@query("dense_index", "SELECT node_id, row_number() OVER (ORDER BY CASE kind WHEN 1 THEN 0 WHEN 2 THEN 1 WHEN 3 THEN 2 WHEN 12 THEN 4 ELSE 3 END, coalesce(file_path, qualified_name), qualified_name) - 1 AS dense_idx FROM nodes")
def _(spark, d):
    from ..operators.tables import dense_index

    cls = F.when(F.col("kind") == 1, 0).when(F.col("kind") == 2, 1).when(F.col("kind") == 3, 2).when(F.col("kind") == 12, 4).otherwise(3)
    return dense_index(C.nodes(spark, d).select("node_id", cls.alias("c"), F.coalesce("file_path", "qualified_name").alias("p"), "qualified_name"), ["c", "p", "qualified_name"]).select("node_id", "dense_idx")
