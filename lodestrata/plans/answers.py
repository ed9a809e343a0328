"""Queries whose results SQL can't express: envelopes, pages, encodings, ignore rules, line scans."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import catalogue as C
from ..operators import envelope as V
from ..operators import search as S
from ..operators import traverse as T
from ..session import table
from ..sources import encodings, extract, ignore, lines

RULES = ["*.o", "build/", "third_party/", "!third_party/keep/", "/tests/**/tmp*", "**/gen_*.py"]


def json_envelope(spark: SparkSession, d: str) -> DataFrame:
    """A search's first fifty hits, fitted to the default budget."""
    t = C.published(spark, d)
    rows = [r.asDict() for r in S.ranked(S.hits(t["lookup"], "O1"), t["nodes"], 50).collect()]
    return spark.createDataFrame([(V.fit("search", "", {"text": "O1"}, rows),)], "envelope string")


def html_page(spark: SparkSession, d: str) -> DataFrame:
    """The overview as a self-contained page."""
    t = C.published(spark, d)
    e = t["edges"].filter("kind = 1")
    shown = T.overview(t["nodes"], e).orderBy("distance", "qualified_name").limit(20_000)
    rows = [r.asDict() for r in shown.select("node_id", "kind", "qualified_name").collect()]
    ids = shown.select("node_id")
    inside = e.join(ids.withColumnRenamed("node_id", "src"), "src", "left_semi").join(ids.withColumnRenamed("node_id", "dst"), "dst", "left_semi").limit(50_000)
    return spark.createDataFrame([(V.page("overview", rows, [r.asDict() for r in inside.collect()]),)], "page string")


def encoding_detect(spark: SparkSession, d: str) -> DataFrame:
    """The encoding of every document's bytes, as UTF-8 and as UTF-16 with its mark."""
    t = table(spark, d, "documents").filter("text is not null").select("doc_id", "text")
    found = t.select("doc_id", encodings.detected(F.encode("text", "UTF-8")).alias("u8"), encodings.detected(F.concat(F.unhex(F.lit("FFFE")), F.encode("text", "UTF-16LE"))).alias("u16"))
    return found.select("doc_id", F.col("u8.encoding").alias("utf8"), F.col("u16.encoding").alias("utf16"))


def gitignore_filter(spark: SparkSession, d: str) -> DataFrame:
    """What a fixed rule file says of every path; a directory that is left out takes its members along."""
    rules = [(0, ignore.parse(RULES))]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            said = []
            for path in batch.path:
                parts = path.split("/")
                above = next((k for k in range(1, len(parts)) if ignore.decide(rules, parts[:k], True) == "ignored"), None)
                said.append("ignored" if above else ignore.decide(rules, parts, False))
            yield pd.DataFrame({"path": batch.path, "decision": said})

    return table(spark, d, "source_files").select("path").distinct().mapInPandas(run, "path string, decision string")


def scanned(texts: DataFrame, key: str, text: str, language: str) -> DataFrame:
    """(key, kind, name, qualified_name, line, start_byte, end_byte) of what the line scanner finds in each text."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for k, body in zip(batch[key], batch[text], strict=True):
                symbols, references, _, _ = lines.scan(body, language)
                rows += [(k, x.kind, x.name, x.qualified, x.start_line, x.start, x.end) for x in symbols] + [(k, x.kind, x.target, x.target, x.line, x.start, x.end) for x in references]
            yield pd.DataFrame(rows, columns=[key, "kind", "name", "qualified_name", "line", "start_byte", "end_byte"])

    return texts.select(key, text).mapInPandas(run, f"{key} {dict(texts.dtypes)[key]}, kind string, name string, qualified_name string, line int, start_byte bigint, end_byte bigint")


_HEAD = "#include <s.h>\n"


def line_scan(spark: SparkSession, d: str) -> DataFrame:
    """Every file's symbols written as definitions of C, one a line, and read again by the line scanner."""
    return scanned(_as_source(spark, d), "file_idx", "text", "c").select("file_idx", "kind", "name", "line")


def _as_source(spark: SparkSession, d: str) -> DataFrame:
    """(file_idx, text): a file with a line for each distinct name of its symbols, in order."""
    names = table(spark, d, "source_symbols").filter("name rlike '^[A-Za-z_][A-Za-z0-9_]*$'").select("file_idx", "name").distinct()
    body = F.array_join(F.transform(F.array_sort(F.collect_list("name")), lambda n: F.concat(F.lit("struct "), n, F.lit(" { int field; };"))), "\n")
    return names.groupBy("file_idx").agg(F.concat(F.lit(_HEAD), body, F.lit("\n")).alias("text"))


def syntax_scan(spark: SparkSession, d: str) -> DataFrame:
    """The same files read by the syntax tier: types with their fields, and what they belong to."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for key, body in zip(batch.file_idx, batch.text, strict=True):
                found = extract.file(body, "c", f"f{key}.c")
                rows += [(key, s.kind, s.qualified, found.symbols[s.parent].name if s.parent >= 0 else None, s.start_line, o) for s, o in zip(found.symbols, found.ordinals, strict=True)]
            yield pd.DataFrame(rows, columns=["file_idx", "kind", "qualified_name", "parent", "line", "ordinal"])

    return _as_source(spark, d).mapInPandas(run, "file_idx bigint, kind string, qualified_name string, parent string, line int, ordinal bigint")


_SOURCE_SQL = "WITH n AS (SELECT file_idx, name, row_number() OVER (PARTITION BY file_idx ORDER BY name) + 1 AS line FROM (SELECT DISTINCT file_idx, name FROM source_symbols WHERE regexp_full_match(name, '[A-Za-z_][A-Za-z0-9_]*')))"
QUERIES = {f.__name__: f for f in (json_envelope, html_page, encoding_detect, gitignore_filter, line_scan, syntax_scan)}
SQL: dict[str, str] = {
    "line_scan": f"{_SOURCE_SQL} SELECT file_idx, 'Type' AS kind, name, line FROM n UNION ALL SELECT DISTINCT file_idx, 'INCLUDES', 's.h', 1 FROM n",
    "syntax_scan": f"{_SOURCE_SQL} SELECT file_idx, 'Type' AS kind, name AS qualified_name, NULL AS parent, line, 0 AS ordinal FROM n UNION ALL SELECT file_idx, 'Field', name || '::field', name, line, 0 FROM n",
    "encoding_detect": "SELECT doc_id, CASE WHEN contains(text, chr(0)) THEN 'binary' WHEN text = '' THEN 'UTF-8' ELSE 'UTF-8' END AS utf8, 'UTF-16LE' AS utf16 FROM documents WHERE text IS NOT NULL",
    "gitignore_filter": """SELECT path, CASE
 WHEN regexp_matches(path, '(^|/)[^/]*[.]o/') OR regexp_matches(path, '(^|/)build/') OR (regexp_matches(path, '(^|/)third_party/') AND NOT regexp_matches(path, '^third_party/keep/') AND regexp_matches(path, '(^|/)third_party/')) OR regexp_matches(path, '^tests/(.*/)?tmp[^/]*/') OR regexp_matches(path, '(^|/)gen_[^/]*[.]py/') THEN 'ignored'
 WHEN regexp_matches(path, '(^|/)gen_[^/]*[.]py$') OR regexp_matches(path, '^tests/(.*/)?tmp[^/]*$') OR regexp_matches(path, '(^|/)[^/]*[.]o$') THEN 'ignored' ELSE 'none' END AS decision FROM (SELECT DISTINCT path FROM source_files)""",
}
