"""Query commands over an opened artifact: each gives an exit code and an envelope of bounded size.

Searches and traversals are never cut short, so counts of what an answer leaves out are exact; what the driver takes
is bounded by ``limit`` and, for edges, by ``MOST_EDGES``.
"""

from __future__ import annotations

import hashlib
import json
import os
import time
import unicodedata

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..codes import EDGE_KINDS, code
from . import envelope as V
from . import search as S
from . import traverse as T

MOST_EDGES = 400_000
MOST_FILES, MOST_BYTES, MOST_SECONDS = 32, 256 << 20, 10.0


class Command:
    def __init__(self, tables: dict[str, DataFrame], generation: str = "", limit: int = 0, budget: int = 0):
        self.nodes, self.edges, self.lookup, self.generation = tables["nodes"], tables["edges"], tables.get("lookup"), generation
        self.redges = tables.get("redges")
        self.limit, self.budget = V.bounded(limit, V.LIMIT, 1, V.MOST, "limit"), V.bounded(budget, V.BUDGET, V.LEAST_BUDGET, V.MOST_BUDGET, "budget")

    def _keys(self) -> DataFrame:
        if self.lookup is None:
            raise S.UserError("this artifact has no search index")
        return self.lookup

    def _answer(self, command: str, query: dict, rows: list[dict], edges: list[dict], total: int, total_edges: int | None = None, summary: dict | None = None) -> tuple[int, str]:
        text = V.fit(command, self.generation, query | {"limit": self.limit, "budget": self.budget}, rows, edges, total, self.budget, total_edges=total_edges, summary=summary)
        return json.loads(text)["exitCode"], text

    def _resolve(self, text: str) -> tuple[str | None, list[dict], int]:
        """(the one node, candidates in ranking order, how many there are)."""
        if S.is_id(text):
            found = [r.asDict() for r in S.resolve(self._keys(), self.nodes, text).limit(2).collect()]
            return (found[0]["node_id"] if found else None), found, len(found)
        hits = S.hits(self._keys(), text, strengths=(S.EXACT,), targets=(0, 1))
        found = [r.asDict() for r in S.ranked(hits, self.nodes, self.limit + 1).collect()]
        if len(found) == 1:
            return found[0]["node_id"], self._whole([found[0]["node_id"]]), 1
        return None, found[: self.limit], len(found) if len(found) <= self.limit else hits.count()

    def _whole(self, ids: list[str]) -> list[dict]:
        by = {r["node_id"]: r.asDict() for r in self.nodes.filter(F.col("node_id").isin(ids)).collect()}
        return [by[i] for i in ids if i in by]

    def _missing(self, command: str, query: dict, found: list[dict], total: int) -> tuple[int, str]:
        """A name of no node, or of several; the latter are shown."""
        code_, text = self._answer(command, query, found, [], total)
        return (V.PARTIAL if code_ == V.PARTIAL else V.NOTHING), text

    @staticmethod
    def kinds(names: str) -> list[int]:
        try:
            return [code(EDGE_KINDS, n.strip().upper()) for n in names.split(",") if n.strip()]
        except ValueError as e:
            raise S.UserError(f"unknown edge kind in {names!r}") from e

    def search(self, text: str, ignore_case: bool = False) -> tuple[int, str]:
        hits = S.hits(self._keys(), text, ignore_case)
        rows = [r.asDict() for r in S.ranked(hits, self.nodes, self.limit).collect()]
        return self._answer("search", {"text": text, "ignoreCase": ignore_case}, rows, [], hits.count() if len(rows) == self.limit else len(rows), summary={"usedIndex": True})

    def show(self, text: str) -> tuple[int, str]:
        node, found, total = self._resolve(text)
        if node is None:
            return self._missing("show", {"node": text}, found, total)
        up = T.neighbors(self.edges, node, "in", [1], self.redges)
        parents = [r.asDict() for r in self.nodes.join(up, "node_id", "left_semi").orderBy("kind", "node_id").limit(self.limit).collect()]
        known = {r["node_id"] for r in [*found, *parents]}
        owner = []
        if found[0].get("file_path") and found[0].get("kind") != 3:
            owner = [r.asDict() for r in self.nodes.filter((F.col("kind") == 3) & (F.col("file_path") == found[0]["file_path"])).limit(1).collect() if r["node_id"] not in known]
        edges = [{"kind": 1, "src": r["node_id"], "dst": node} for r in parents]
        rows = [*found[:1], *owner, *parents]
        return self._answer("show", {"node": text}, rows[: self.limit], edges, len(rows))

    def _reached(self, seeds: DataFrame | list[str], depth: int, direction: str, codes: list[int]) -> DataFrame:
        return T.distances(self.edges, seeds, depth, direction, codes, self.redges)

    def _edges_at(self, reached: DataFrame, depth: int, direction: str, codes: list[int]) -> tuple[list[dict], int]:
        """Edges of expanded nodes as far as an answer can hold them, and how many there are."""
        every = T.expanded_edges(self.edges, reached, depth, direction, codes, self.redges)
        rows = [r.asDict() for r in every.orderBy("src", "kind", "dst").limit(MOST_EDGES + 1).collect()]
        return rows[:MOST_EDGES], len(rows) if len(rows) <= MOST_EDGES else every.count()

    def neighbors(self, text: str, depth: int = 1, direction: str = "both", kinds: str = "") -> tuple[int, str]:
        if not 0 <= depth <= 16:
            raise S.UserError("depth must lie between 0 and 16")
        codes = self.kinds(kinds)
        node, found, total = self._resolve(text)
        if node is None:
            return self._missing("neighbors", {"node": text}, found, total)
        reached = self._reached([node], depth, direction, codes)
        rows = [r.asDict() for r in self.nodes.join(reached, "node_id").orderBy("distance", "kind", "node_id").limit(self.limit).collect()]
        edges, total_edges = self._edges_at(reached, depth, direction, codes)
        count = reached.count()
        return self._answer("neighbors", {"node": text, "depth": depth, "direction": direction}, rows, edges, count, total_edges, {"totalReachable": count})

    def path(self, source: str, target: str, depth: int = 16, direction: str = "both", kinds: str = "") -> tuple[int, str]:
        if not 0 <= depth <= 16:
            raise S.UserError("depth must lie between 0 and 16")
        codes, ends = self.kinds(kinds), []
        for text in (source, target):
            node, found, total = self._resolve(text)
            if node is None:
                return self._missing("path", {"source": source, "target": target}, found, total)
            ends.append(node)
        chain = T.shortest_path(self.edges, *ends, depth, direction, codes, self.redges)
        if chain is None:
            return V.NOTHING, self._answer("path", {"source": source, "target": target}, [], [], 0)[1]
        steps = set(zip(chain, chain[1:], strict=False))
        between = self.edges.filter(F.col("src").isin(chain) & F.col("dst").isin(chain))
        between = between.filter(F.col("kind").isin(codes)) if codes else between
        ways = {"out": (True, False), "in": (False, True), "both": (True, True)}[direction]
        edges = [r.asDict() for r in between.collect()]
        edges = [e for e in edges if (ways[0] and (e["src"], e["dst"]) in steps) or (ways[1] and (e["dst"], e["src"]) in steps)]
        return self._answer("path", {"source": source, "target": target}, self._whole(chain), edges, len(chain), summary={"length": len(chain) - 1})

    def context(self, keywords: list[str], depth: int = 1) -> tuple[int, str]:
        if not 0 <= depth <= 16:
            raise S.UserError("depth must lie between 0 and 16")
        pack = T.context_pack(self._keys(), self.nodes, self.edges, keywords, self.limit, depth, self.redges)
        rows = [r.asDict() for r in self.nodes.join(pack, "node_id").orderBy("pos").collect()]
        per = T.matches(self._keys(), self.nodes, keywords)
        matched = per.agg(F.countDistinct("word").alias("words"), F.countDistinct("node_id").alias("nodes")).first()
        core = pack.filter("distance = 0").select("node_id")
        reached = self._reached(core, depth, "both", [])
        edges, total_edges = self._edges_at(reached, depth, "both", []) if depth else ([], 0)
        # nodes of matches and of the neighbourhood, each once
        known = per.select("node_id").unionByName(reached.select("node_id")).distinct().count()
        seeds = self.limit if depth == 0 else max(1, self.limit // 2)
        return self._answer("context", {"keywords": keywords, "depth": depth}, rows, edges, known, total_edges, {"totalMatches": matched["nodes"], "matchedKeywords": matched["words"], "seedLimit": seeds})

    def export(self, file: str, text: str | None = None, depth: int = 1, most: int = 20_000) -> int:
        """A page around a node, or of the overview: repository and directories with the number of their members."""
        if text is None:
            weighed = T.overview(self.nodes, self.edges).withColumn("weight", F.col("weight").cast("int"))
            chosen = weighed.orderBy("kind", S.utf16(F.col("qualified_name"))).limit(most)
        else:
            node = self._resolve(text)[0]
            if node is None:
                return V.NOTHING
            reached = self._reached([node], depth, "both", [])
            order = "dense_idx" if "dense_idx" in self.nodes.columns else "node_id"
            chosen = self.nodes.join(reached, "node_id").orderBy("distance", order).limit(most)
        wanted = [c for c in ("node_id", "kind", "qualified_name", "distance", "weight", "file_path", "flags") if c in chosen.columns]
        rows = [r.asDict() for r in chosen.select(*wanted).collect()]
        kept = S.local(self.nodes.sparkSession, [(r["node_id"],) for r in rows], "node_id string")
        edges = self.edges.join(kept.withColumnRenamed("node_id", "src"), "src", "left_semi").join(kept.withColumnRenamed("node_id", "dst"), "dst", "left_semi").orderBy("kind", "src", "dst").limit(50_000)
        V.write_page(file, V.page(text or "overview", rows, [r.asDict() for r in edges.select("kind", "src", "dst").collect()]))
        return V.OK


def freshness(files: DataFrame, root: str, paths: list[str], most_bytes: int = MOST_BYTES, most_seconds: float = MOST_SECONDS) -> list[tuple[str, str, str]]:
    """(path, status, reason) of up to 32 paths, by the bytes as they are.

    Bytes and time are bounded: what lies beyond is ``unchecked``, as are paths that aren't indexed.
    """
    if len(paths) > MOST_FILES:
        raise S.UserError(f"at most {MOST_FILES} files")
    paths = list(dict.fromkeys(unicodedata.normalize("NFC", p.replace("\\", "/")) for p in paths))
    recorded = {r.path: r.content_sha256 for r in files.filter(F.col("path").isin(paths)).select("path", "content_sha256").collect()}
    until, read, out = time.monotonic() + most_seconds, 0, []
    root = os.path.realpath(root)
    for path in paths:
        file = os.path.join(root, path)
        if time.monotonic() > until:
            out.append((path, "unchecked", "time-limit"))
        elif path not in recorded:
            out.append((path, "unchecked", "not-indexed"))
        elif recorded[path] is None:
            out.append((path, "unchecked", "no-content-hash"))
        elif not os.path.lexists(file):
            out.append((path, "deleted", "not-found"))
        elif os.path.realpath(file) != file:
            out.append((path, "unreadable", "link-rejected"))
        elif not os.path.isfile(file):
            out.append((path, "unreadable", "not-regular-file"))
        elif os.path.getsize(file) > most_bytes - read:
            out.append((path, "unchecked", "byte-limit"))
        else:
            try:
                with open(file, "rb") as f:
                    content = f.read()
                read += len(content)
                out.append((path, "unchanged" if hashlib.sha256(content).hexdigest() == recorded[path] else "changed", ""))
            except PermissionError:
                out.append((path, "unreadable", "access-denied"))
            except OSError:
                out.append((path, "unreadable", "io-error"))
    return out


_BINDING = ("EXECUTABLE", "SOURCE_ROOT", "INDEX_DIR")


def sidecar(file: str, index: str, root: str | None = None, executable: str | None = None) -> str:
    """A small file that binds an index to its source tree and program, each an absolute path; written if root is given."""
    import sys
    import uuid

    index = os.path.abspath(index)
    if root is not None:
        bound = {"schemaVersion": 1, "EXECUTABLE": os.path.abspath(executable or sys.executable), "SOURCE_ROOT": os.path.abspath(root), "INDEX_DIR": index}
        if not os.path.isfile(bound["EXECUTABLE"]) or not os.path.isdir(bound["SOURCE_ROOT"]):
            raise S.UserError("program and source tree must exist")
        if os.path.islink(file):
            raise S.UserError("the file is a link")
        aside = f"{file}.{uuid.uuid4().hex}"
        with open(os.open(aside, os.O_CREAT | os.O_EXCL | os.O_WRONLY, 0o600), "w", encoding="utf-8") as f:
            json.dump(bound, f, indent=2)
        os.replace(aside, file)
    try:
        with open(file, encoding="utf-8") as f:
            bound = json.loads(f.read(1 << 20))
    except (OSError, ValueError) as e:
        raise S.UserError(f"{file} can't be read") from e
    if not isinstance(bound, dict) or any(not isinstance(bound.get(k), str) or not os.path.isabs(bound[k]) for k in _BINDING):
        raise S.UserError("each field must be an absolute path")
    if bound["INDEX_DIR"] != index:
        raise S.UserError("the file belongs to another index")
    return json.dumps({k: bound[k] for k in _BINDING})
