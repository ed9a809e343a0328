"""A source tree as a DataFrame of files: walked on the driver, read, classified and extracted on the executors."""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..codes import EDGE_KINDS, ENCODINGS, LANGUAGES, NODE_KINDS
from ..functions import paths as P
from . import encodings, extract, ignore

EXCLUDED = {".git", ".hg", ".svn"}
MOST_DEPTH, MOST_BYTES, MOST_ENTRIES = 256, 64 << 20, 8_000_000
#: Problems after which a scan isn't complete.
INCOMPLETE = ("PermissionDenied", "DepthLimitExceeded", "EntryLimitExceeded", "DirectoryCycle", "FileUnreadable", "PathRejected", "IgnoreFileUnreadable")
DIRECTORY = "Directory"
IGNORE_FILES = (".gitignore",)
FILE_SCHEMA = "path string, physical string, size_bytes bigint, problem string"


def walk(root: str, ignore_files: tuple[str, ...] = IGNORE_FILES, use_ignore: bool = True, follow: bool = False, excluded: str | None = None, most_depth: int = MOST_DEPTH, most_bytes: int = MOST_BYTES, most_entries: int = MOST_ENTRIES) -> Iterator[tuple[str, str, int, str | None]]:
    """(path, physical path, size, what) in order: what is null for a file, ``Directory``, or why something was skipped.

    Directories and files are counted apart, up to ``most_entries`` of each.
    """
    root = os.path.realpath(root)
    excluded = excluded and os.path.realpath(excluded)
    counts = {True: 0, False: 0}

    def visit(at: str, segments: list[str], rules: list, above: tuple[str, ...]) -> Iterator[tuple[str, str, int, str | None]]:
        if use_ignore:
            for name in ignore_files:
                file = os.path.join(at, name)
                if os.path.isfile(file) and os.path.getsize(file) <= 1 << 20:
                    try:
                        with open(file, encoding="utf-8", errors="replace") as f:
                            rules = [*rules, (len(segments), ignore.parse(f.read().split("\n")))]
                    except OSError:
                        yield "/".join([*segments, name]), file, 0, "IgnoreFileUnreadable"
        try:
            entries = sorted(os.scandir(at), key=lambda e: e.name.encode("utf-16-be", "surrogatepass"))
        except OSError:
            yield "/".join(segments), at, 0, "PermissionDenied"
            return
        for e in entries:
            mine, path = [*segments, e.name], "/".join([*segments, e.name])
            real = e.path
            if e.is_symlink():
                real = os.path.realpath(e.path)
                if not follow:
                    yield path, e.path, 0, "SymbolicLinkSkipped"
                    continue
                if not (real + os.sep).startswith(root + os.sep):
                    yield path, e.path, 0, "LinkEscapesRoot"
                    continue
                if real in above:
                    yield path, e.path, 0, "DirectoryCycle"
                    continue
            directory = os.path.isdir(real)
            if directory and (e.name.startswith(".") or e.name in EXCLUDED or real == excluded):
                continue
            if use_ignore and ignore.decide(rules, mine, directory) == "ignored":
                continue
            if any(ord(c) < 32 or c in "\x7f\\" for c in e.name):
                yield path, e.path, 0, "PathRejected"
                continue
            if directory or os.path.isfile(real):
                counts[directory] += 1
                if counts[directory] > most_entries:
                    if counts[directory] == most_entries + 1:
                        yield path, e.path, 0, "EntryLimitExceeded"
                    continue
            if directory:
                if len(mine) > most_depth:
                    yield path, e.path, 0, "DepthLimitExceeded"
                else:
                    yield path, real, 0, DIRECTORY
                    yield from visit(real, mine, rules, (*above, real))
            elif os.path.isfile(real):
                size = os.path.getsize(real)
                yield path, real, size, "FileTooLarge" if size > most_bytes else None

    yield from visit(root, [], [], (root,))


_SYMBOL = "kind tinyint, name string, qualified_name string, ordinal bigint, parent_kind tinyint, parent_qualified string, parent_ordinal bigint, start_line int, end_line int, start_byte bigint, end_byte bigint, flags int, condition string, doc_bytes bigint"
_REFERENCE = "source_kind tinyint, source_qualified string, source_ordinal bigint, edge_kind tinyint, target string, qualifier string, line int, start_byte bigint, end_byte bigint, stage tinyint, confidence tinyint"
_READ = f"path string, language smallint, flags int, size_bytes bigint, encoding smallint, candidates array<string>, content_sha256 string, line_count int, tier tinyint, reason string, symbols array<struct<{_SYMBOL.replace(' ', ': ').replace(',: ', ', ')}>>, refs array<struct<{_REFERENCE.replace(' ', ': ').replace(',: ', ', ')}>>, problem string"
_NODE_CODE = {k: i for i, k in enumerate(NODE_KINDS, 1)}
_EDGE_CODE = {k: i for i, k in enumerate(EDGE_KINDS, 1)}
BINARY, UNDETERMINED, SKIPPED, AMBIGUOUS = 64, 128, 256, 1024


def _flat(found: extract.Extracted) -> tuple[list[dict], list[dict]]:
    """Symbols and references with their parents and sources named by what makes up an id."""
    symbols, references = [], []
    name = lambda k: (_NODE_CODE[found.symbols[k].kind], found.symbols[k].qualified, found.ordinals[k]) if k >= 0 else (None, None, None)
    for s, ordinal in zip(found.symbols, found.ordinals, strict=True):
        kind, qualified, nth = name(s.parent)
        symbols.append({"kind": _NODE_CODE[s.kind], "name": s.name, "qualified_name": s.qualified, "ordinal": ordinal, "parent_kind": kind, "parent_qualified": qualified, "parent_ordinal": nth, "start_line": s.start_line, "end_line": s.end_line, "start_byte": s.start, "end_byte": s.end, "flags": s.flags, "condition": s.condition, "doc_bytes": s.doc})
    for r in found.references:
        kind, qualified, nth = name(r.source)
        references.append({"source_kind": kind, "source_qualified": qualified, "source_ordinal": nth, "edge_kind": _EDGE_CODE[r.kind], "target": r.target, "qualifier": r.qualifier, "line": r.line, "start_byte": r.start, "end_byte": r.end, "stage": r.stage, "confidence": r.confidence})
    return symbols, references


def read(files: DataFrame, tier: int = 2, assume: str | None = None, most_scanned: int = extract.MOST_BYTES) -> DataFrame:
    """One pass over each file's bytes: hash, encoding, lines, symbols and references.

    ``assume`` is the encoding of files of several possible ones, if it is one of theirs.  Why a file's symbols
    weren't looked for, or not in the best way, stands in ``reason``.
    """

    def one(path: str, physical: str, language: int, flags: int) -> tuple:
        try:
            with open(physical, "rb") as f:
                content = f.read()
        except OSError:
            return (path, language, flags | SKIPPED, 0, None, [], None, 0, 0, "read-error", [], [], "FileUnreadable")
        name, candidates = encodings.detect(content)
        lines = 0 if not content or name == "binary" else len(re.findall(rb"\r\n|\r|\n", content)) + (content[-1:] not in (b"\r", b"\n"))
        sha = hashlib.sha256(content).hexdigest()
        reached, reason, symbols, references = 0, None, [], []
        several = name == "undetermined" and len(candidates) > 1
        if several and assume in candidates:
            name, several = assume, False
        if name == "binary":
            flags, reason = flags | BINARY, "binary"
        elif several:
            flags, reason = flags | AMBIGUOUS | UNDETERMINED, "ambiguous-encoding"
        elif len(content) > most_scanned:
            reason = "extraction-size-limit"
        else:
            flags |= UNDETERMINED if name == "undetermined" else 0
            text = encodings.decode(content, name)
            if text is None:
                reason = "unsupported-encoding"
            else:
                found = extract.file(text, LANGUAGES[language], path, flags, tier)
                reached, reason, flags = found.tier, found.reason, flags | found.flags
                symbols, references = _flat(found)
        problem = {"parse-timeout": "ParseTimedOut", "parse-failed": "ParseFailed", "extraction-limit": "ExtractionTruncated", "extraction-size-limit": "TooLargeToExtract", "ambiguous-encoding": "AmbiguousEncoding"}.get(reason)
        return (path, language, flags, len(content), ENCODINGS.index(name) + 1, candidates, sha, lines, reached, reason, symbols, references, problem)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = "path language flags size_bytes encoding candidates content_sha256 line_count tier reason symbols refs problem".split()
        for batch in batches:
            rows = [one(*row) for row in batch[["path", "physical", "language", "flags"]].itertuples(index=False)]
            yield pd.DataFrame(rows, columns=names).astype({"language": "Int16", "encoding": "Int16", "tier": "Int8"})

    good = files.filter("problem is null").withColumns({"language": P.language(F.col("path")), "flags": P.flags(F.col("path"))})
    return good.mapInPandas(run, _READ)


def tree(spark: SparkSession, root: str, **how) -> DataFrame:
    """Everything met on the walk, in as many partitions as there are files for: (path, physical, size_bytes, problem)."""
    rows = list(walk(root, **how))
    found = spark.createDataFrame(rows, FILE_SCHEMA)
    return found.repartition(max(1, min(len(rows) // 64 + 1, 8 * spark.sparkContext.defaultParallelism)))
