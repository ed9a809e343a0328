"""Command line: index a tree, search it, show statistics and verify it."""

from __future__ import annotations

import argparse
import sys
import tempfile

from pyspark.sql import functions as F

from .functions.text import size_of
from .operators import build
from .operators import envelope as V
from .operators import search as S
from .operators.commands import Command, freshness, sidecar
from .session import ensure_checkpoint_dir, local_session
from .sources import discover, store


def index(spark, root: str, out: str, repository: str, use_ignore: bool = True, allow_partial: bool = False, tier: int = 2, assume: str | None = None, **limits) -> str:
    """Walk, read, extract and publish; returns the generation.

    What the one pass over the files found is cut off by a checkpoint, so no file is read twice and none of its
    text is kept.
    """
    ensure_checkpoint_dir(spark)
    seen = discover.tree(spark, root, use_ignore=use_ignore, excluded=out, **limits).checkpoint()
    directories = seen.filter(F.col("problem") == discover.DIRECTORY).select("path")
    files = discover.read(seen, tier, assume).checkpoint()
    tables = build.graph(spark, repository, directories, files)
    lost = tables.pop("lost")
    skipped = seen.filter((F.col("problem") != discover.DIRECTORY) & F.col("problem").isNotNull()).select(F.col("problem").alias("kind"), "path", F.lit("").alias("detail"))
    found = files.filter("problem is not null").select(F.col("problem").alias("kind"), "path", F.coalesce("reason", F.lit("")).alias("detail"))
    tables["diagnostics"] = skipped.unionByName(found).unionByName(lost)
    tables["coverage"] = build.coverage(files)
    complete = tables["diagnostics"].filter(F.col("kind").isin(*discover.INCOMPLETE)).isEmpty()
    about = {"repository": repository, "tier": tier, "assumeEncoding": assume, "ignore": use_ignore}
    return store.publish(spark, out, tables, complete, allow_partial, about)


def rebuilt(spark, root: str, out: str, aside: str) -> list[tuple[str, int]]:
    """Index a tree once more and compare: (table, rows that differ)."""
    about = store.manifest(spark, out)["about"]
    index(spark, root, aside, about["repository"], about["ignore"], True, about["tier"], about["assumeEncoding"])
    return store.differences(store.open_artifact(spark, out), store.open_artifact(spark, aside))


def main(argv: list[str] | None = None) -> int:
    a = argparse.ArgumentParser(prog="lodestrata")
    sub = a.add_subparsers(dest="command", required=True)
    i = sub.add_parser("index")
    i.add_argument("path")
    i.add_argument("--repo", default="repository")
    i.add_argument("--no-gitignore", action="store_true")
    i.add_argument("--allow-partial", action="store_true")
    i.add_argument("--tier", type=int, choices=(0, 1, 2), default=2)
    i.add_argument("--assume-encoding", default=None)
    i.add_argument("--max-file-size", default="64MiB")
    i.add_argument("--max-depth", type=int, default=discover.MOST_DEPTH)
    i.add_argument("--follow-symlinks", action="store_true")
    s = sub.add_parser("search")
    s.add_argument("text")
    s.add_argument("--ignore-case", action="store_true")
    show = sub.add_parser("show")
    show.add_argument("node")
    near = sub.add_parser("neighbors")
    near.add_argument("node")
    way = sub.add_parser("path")
    way.add_argument("source")
    way.add_argument("target")
    pack = sub.add_parser("context")
    pack.add_argument("keywords", nargs="+")
    ex = sub.add_parser("export")
    ex.add_argument("--file", required=True)
    ex.add_argument("--node")
    fresh = sub.add_parser("freshness")
    fresh.add_argument("files", nargs="+")
    fresh.add_argument("--root", required=True)
    for x in (s, show, near, way, pack):
        x.add_argument("--limit", type=int, default=0)
        x.add_argument("--text", dest="as_text", action="store_true", help="lines for a terminal instead of JSON")
        x.add_argument("--budget", type=int, default=0)
    for x, default in ((near, 1), (way, 16), (pack, 1), (ex, 1)):
        x.add_argument("--depth", type=int, default=default)
    for x in (near, way):
        x.add_argument("--edge", default="")
        x.add_argument("--direction", choices=("in", "out", "both"), default="both")
    sub.add_parser("stats")
    verify = sub.add_parser("verify")
    verify.add_argument("--deterministic", metavar="ROOT", help="index this tree again and compare")
    note = sub.add_parser("agent-context")
    note.add_argument("--file", required=True)
    note.add_argument("--write", metavar="ROOT")
    for x in sub.choices.values():
        x.add_argument("--out", required=True)
    o = a.parse_args(argv)
    spark = local_session()
    try:
        if o.command == "index":
            limits = {"most_bytes": size_of(o.max_file_size), "most_depth": V.bounded(o.max_depth, discover.MOST_DEPTH, 1, discover.MOST_DEPTH, "max-depth"), "follow": o.follow_symlinks}
            print(index(spark, o.path, o.out, o.repo, not o.no_gitignore, o.allow_partial, o.tier, o.assume_encoding, **limits))
            return V.PARTIAL if not store.open_artifact(spark, o.out)["diagnostics"].isEmpty() else V.OK
        if o.command == "agent-context":
            print(sidecar(o.file, o.out, o.write))
            return V.OK
        tables = store.open_artifact(spark, o.out)
        if o.command in ("search", "show", "neighbors", "path", "context", "export"):
            c = Command(tables, store.manifest(spark, o.out)["generation"], getattr(o, "limit", 0), getattr(o, "budget", 0))
            if o.command == "export":
                return c.export(o.file, o.node, o.depth)
            code_, text = {
                "search": lambda: c.search(o.text, o.ignore_case),
                "show": lambda: c.show(o.node),
                "neighbors": lambda: c.neighbors(o.node, o.depth, o.direction, o.edge),
                "path": lambda: c.path(o.source, o.target, o.depth, o.direction, o.edge),
                "context": lambda: c.context(o.keywords, o.depth),
            }[o.command]()
            print(V.lines(text) if o.as_text else text)
            return code_
        if o.command == "freshness":
            states = freshness(tables["files"], o.root, o.files)
            for path, state, reason in states:
                print(f"{state} {path}" + (f" ({reason})" if reason else ""))
            return V.OK if all(state == "unchanged" for _, state, _ in states) else V.PARTIAL
        if o.command == "stats":
            tables["files"].groupBy("language").agg(F.count("*").alias("files"), F.sum("size_bytes").alias("bytes")).orderBy(F.desc("files"), "language").show(100)
            build.tiers(tables["files"]).show()
            return V.OK
        found = store.verify(spark, o.out).collect()
        for check, n in found:
            print(f"{check}: {n}")
        if any(n for _, n in found):
            return V.CORRUPT
        if o.deterministic:
            with tempfile.TemporaryDirectory() as aside:
                other = rebuilt(spark, o.deterministic, o.out, aside)
            for name, n in other:
                print(f"rebuilt {name}: {n}")
            return V.PARTIAL if any(n for _, n in other) else V.OK
        return V.OK
    except (S.UserError, ValueError) as e:
        print(V.error(o.command, str(e), V.USAGE))
        return V.USAGE
    except store.Corrupt as e:
        print(V.error(o.command, str(e), V.CORRUPT))
        return V.CORRUPT
    except store.Partial as e:
        print(V.error(o.command, str(e), V.PARTIAL))
        return V.PARTIAL
    except store.Locked as e:
        print(V.error(o.command, str(e), V.IO))
        return V.IO
    except store.Collision as e:
        print(V.error(o.command, str(e), V.INTERNAL))
        return V.INTERNAL


if __name__ == "__main__":
    sys.exit(main())
