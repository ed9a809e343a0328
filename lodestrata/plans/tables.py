"""Queries over source_files, source_symbols, ref_candidates and text functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..codes import FLAGS
from ..functions import paths as P
from ..functions import text as X
from ..operators import build as B
from ..operators import search as S
from ..operators import tables as T
from ..session import table

from . import answers as A

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(f):
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return register


def _t(name):
    return lambda spark, d: table(spark, d, name)


files, symbols, refs, docs, parts = _t("source_files"), _t("source_symbols"), _t("ref_candidates"), _t("documents"), _t("part")


@query("stats_languages", "SELECT language, count(*) AS files, sum(size_bytes)::BIGINT AS bytes, sum(line_count)::BIGINT AS lines FROM source_files GROUP BY language")
def _(s, d):
    return files(s, d).groupBy("language").agg(F.count("*").alias("files"), F.sum("size_bytes").alias("bytes"), F.sum("line_count").alias("lines"))


@query("stats_encodings", "SELECT encoding, count(*) AS files, count_if(flags & 1024 <> 0)::BIGINT AS ambiguous FROM source_files GROUP BY encoding")
def _(s, d):
    return files(s, d).groupBy("encoding").agg(F.count("*").alias("files"), F.count_if(F.col("flags").bitwiseAND(1024) != 0).alias("ambiguous"))


@query("stats_ref_kinds", "SELECT edge_kind, count(*) AS n, count_if(confidence = 1)::BIGINT AS extracted, count_if(confidence = 3)::BIGINT AS ambiguous FROM ref_candidates GROUP BY edge_kind")
def _(s, d):
    return refs(s, d).groupBy("edge_kind").agg(F.count("*").alias("n"), F.count_if(F.col("confidence") == 1).alias("extracted"), F.count_if(F.col("confidence") == 3).alias("ambiguous"))


@query("stats_totals", "SELECT count(*) AS files, sum(size_bytes)::BIGINT AS bytes, sum(line_count)::BIGINT AS lines FROM source_files")
def _(s, d):
    return files(s, d).agg(F.count("*").alias("files"), F.sum("size_bytes").alias("bytes"), F.sum("line_count").alias("lines"))


@query("symbol_kind_counts", "SELECT kind, count(*) AS n FROM source_symbols GROUP BY kind")
def _(s, d):
    return symbols(s, d).groupBy("kind").agg(F.count("*").alias("n"))


@query("flag_counts", " UNION ALL ".join(f"SELECT '{n}' AS flag, count_if(flags & {1 << i} <> 0)::BIGINT AS files FROM source_files" for i, n in enumerate(FLAGS)))
def _(s, d):
    each = files(s, d).agg(*[F.count_if(F.col("flags").bitwiseAND(1 << i) != 0).alias(n) for i, n in enumerate(FLAGS)])
    return each.select(F.inline(F.array(*[F.struct(F.lit(n).alias("flag"), F.col(n).alias("files")) for n in FLAGS])))


@query("flag_names", "SELECT DISTINCT file_idx, array_to_string(list_filter([" + ", ".join(f"CASE WHEN flags & {1 << i} <> 0 THEN '{n}' END" for i, n in enumerate(FLAGS)) + "], lambda x: x IS NOT NULL), ',') AS names FROM source_files")
def _(s, d):
    return files(s, d).select("file_idx", F.array_join(X.flag_names(F.col("flags"), FLAGS), ",").alias("names")).distinct()


@query("coverage_examples", "SELECT language, encoding, count(*) AS files, min(path) AS first_path, list_extract(list_sort(list(DISTINCT path)), 2) AS second_path FROM source_files GROUP BY ALL")
def _(s, d):
    return T.coverage(files(s, d), ["language", "encoding"], "path")


@query("diagnostics_top", "SELECT edge_kind, target, rank, total FROM (SELECT edge_kind, target, row_number() OVER (PARTITION BY edge_kind ORDER BY target) AS rank FROM (SELECT DISTINCT edge_kind, target FROM ref_candidates)) JOIN (SELECT edge_kind, count(*) AS total FROM ref_candidates GROUP BY edge_kind) USING (edge_kind) WHERE rank <= 32")
def _(s, d):
    return T.top_samples(refs(s, d), "edge_kind", "target", 32)


@query("ordinals", "SELECT node_id, file_idx, kind, qualified_name, row_number() OVER (PARTITION BY file_idx, kind, qualified_name ORDER BY start_line, end_line DESC, ord, node_id) - 1 AS ordinal FROM (SELECT DISTINCT node_id, file_idx, kind, qualified_name, start_line, end_line, ord FROM source_symbols)")
def _(s, d):
    rows = symbols(s, d).select("node_id", "file_idx", "kind", "qualified_name", "start_line", "end_line", "ord").distinct()
    return T.ordinals(rows, ["file_idx", "kind", "qualified_name"], ["start_line", F.desc("end_line"), "ord", "node_id"]).select("node_id", "file_idx", "kind", "qualified_name", "ordinal")


@query("parent_symbols", "SELECT s.node_id, s.parent, count(p.node_id) AS parents FROM (SELECT DISTINCT node_id, file_idx, parent FROM source_symbols WHERE parent IS NOT NULL) s LEFT JOIN (SELECT DISTINCT node_id, file_idx, name FROM source_symbols) p ON p.file_idx = s.file_idx AND p.name = s.parent GROUP BY ALL")
def _(s, d):
    child = symbols(s, d).filter("parent is not null").select("node_id", "file_idx", "parent").distinct()
    per = symbols(s, d).select("node_id", "file_idx", "name").distinct().groupBy("file_idx", F.col("name").alias("parent")).agg(F.count("*").alias("parents"))
    return child.join(per, ["file_idx", "parent"], "left").select("node_id", "parent", F.coalesce("parents", F.lit(0)).alias("parents"))


@query("symbol_files", "SELECT s.node_id, s.name, f.path FROM (SELECT DISTINCT node_id, name, file_idx FROM source_symbols) s LEFT JOIN (SELECT DISTINCT file_idx, path FROM source_files) f USING (file_idx)")
def _(s, d):
    return symbols(s, d).select("node_id", "name", "file_idx").distinct().join(files(s, d).select("file_idx", "path").distinct(), "file_idx", "left").select("node_id", "name", "path")


@query("explains_asof", "WITH q AS (SELECT DISTINCT file_idx, kind, name, start_line FROM source_symbols), n AS (SELECT a.file_idx, a.name, a.start_line, b.name AS target, b.start_line AS target_line, row_number() OVER (PARTITION BY a.file_idx, a.kind, a.name, a.start_line ORDER BY b.start_line, b.name, b.kind) AS k FROM q a JOIN q b ON a.file_idx = b.file_idx AND (b.start_line, b.name, b.kind) > (a.start_line, a.name, a.kind) AND b.kind NOT IN ('Macro', 'Note') WHERE a.kind IN ('Macro', 'Note')) SELECT file_idx, name, start_line, target, target_line FROM n WHERE k = 1")
def _(s, d):
    rows = symbols(s, d).select("file_idx", "kind", "name", "start_line").distinct()
    return T.following(rows, "file_idx", ["start_line", "name", "kind"], "kind in ('Macro', 'Note')", "name", "start_line").select("file_idx", "name", "start_line", "target", "target_line")


@query("refs_resolved_local", "SELECT r.source, r.target, count(*) AS n FROM (SELECT DISTINCT source, target, qualifier, line, start_byte, end_byte FROM ref_candidates) r JOIN (SELECT DISTINCT node_id, file_idx FROM source_symbols) a ON a.node_id = r.source JOIN (SELECT DISTINCT file_idx, name FROM source_symbols) b ON b.file_idx = a.file_idx AND b.name = r.target GROUP BY ALL")
def _(s, d):
    r = refs(s, d).select("source", "target", "qualifier", "line", "start_byte", "end_byte").distinct().groupBy("source", "target").agg(F.count("*").alias("c"))
    own = symbols(s, d).select(F.col("node_id").alias("source"), "file_idx").distinct()
    names = symbols(s, d).select("file_idx", F.col("name").alias("target")).distinct()
    return r.join(own, "source").join(names, ["file_idx", "target"]).groupBy("source", "target").agg(F.sum("c").alias("n"))


@query("guarded_refs", "SELECT DISTINCT source, target FROM ref_candidates WHERE edge_kind = 15 AND target <> ''")
def _(s, d):
    return refs(s, d).filter("edge_kind = 15 and target <> ''").select("source", "target").distinct()


@query("config_names", "SELECT DISTINCT target AS name FROM ref_candidates WHERE edge_kind = 15 AND target <> ''")
def _(s, d):
    return refs(s, d).filter("edge_kind = 15 and target <> ''").select(F.col("target").alias("name")).distinct()


@query("invalid_refs", "SELECT count(*) AS rows, count_if(NOT (edge_kind BETWEEN 1 AND 19 AND stage BETWEEN 0 AND 6 AND confidence BETWEEN 1 AND 3 AND line >= 0 AND start_byte >= 0 AND start_byte <= end_byte))::BIGINT AS invalid FROM ref_candidates")
def _(s, d):
    ok = F.expr("edge_kind between 1 and 19 and stage between 0 and 6 and confidence between 1 and 3 and line >= 0 and start_byte >= 0 and start_byte <= end_byte")
    return refs(s, d).agg(F.count("*").alias("rows"), F.count_if(~ok).alias("invalid"))


@query("dangling_refs", "SELECT count(*) AS dangling FROM ref_candidates r WHERE source IS NOT NULL AND source NOT IN (SELECT node_id FROM source_symbols WHERE node_id IS NOT NULL)")
def _(s, d):
    return refs(s, d).filter("source is not null").join(symbols(s, d).select(F.col("node_id").alias("source")), "source", "left_anti").agg(F.count("*").alias("dangling"))


@query("duplicate_files", "SELECT content_sha256, count(DISTINCT path) AS paths FROM source_files WHERE content_sha256 IS NOT NULL GROUP BY 1 HAVING count(DISTINCT path) > 1")
def _(s, d):
    return files(s, d).filter("content_sha256 is not null").select("content_sha256", "path").distinct().groupBy("content_sha256").agg(F.count("*").alias("paths")).filter("paths > 1")


@query("freshness_join", "SELECT coalesce(a.path, b.path) AS path, CASE WHEN a.path IS NULL THEN 'added' WHEN b.path IS NULL THEN 'deleted' WHEN a.v IS NOT DISTINCT FROM b.v THEN 'unchanged' ELSE 'changed' END AS state FROM (SELECT path, max(content_sha256) AS v FROM source_files GROUP BY path) a FULL JOIN (SELECT path, max(content_sha256) AS v FROM (SELECT path, content_sha256 FROM source_files UNION ALL SELECT target, NULL FROM ref_candidates WHERE edge_kind IN (2, 3) UNION ALL SELECT path, 'g' FROM source_files WHERE flags & 8 <> 0) GROUP BY path) b ON a.path = b.path")
def _(s, d):
    """The recorded files against a state in which generated ones have other contents and what is included is there too."""
    f = files(s, d).select("path", "content_sha256")
    included = refs(s, d).filter("edge_kind in (2, 3)").select(F.col("target").alias("path"), F.lit(None).cast("string").alias("content_sha256"))
    made = files(s, d).filter(F.col("flags").bitwiseAND(8) != 0).select("path", F.lit("g").alias("content_sha256"))
    state = lambda x: x.groupBy("path").agg(F.max("content_sha256").alias("v"))
    return T.full_difference(state(f), state(f.unionByName(included).unionByName(made)), "path", "v")


@query("path_parts", "SELECT DISTINCT path, string_split(path, '/')[-1] AS name, regexp_replace(path, '/?[^/]*$', '') AS parent, len(string_split(path, '/')) AS depth, lower(regexp_extract(string_split(path, '/')[-1], '^.+\\.([^.]+)$', 1)) AS ext FROM source_files")
def _(s, d):
    p = F.col("path")
    return files(s, d).select("path", P.file_name(p).alias("name"), P.parent(p).alias("parent"), P.depth(p).alias("depth"), P.extension(p).alias("ext")).distinct()


#: Languages by extension and by name, and the names that make flags, as the oracle has them: values of its own.
_BY_EXTENSION = "c 2 h 3 cc 4 cpp 4 cxx 4 c++ 4 hh 5 hpp 5 hxx 5 inc 5 ipp 5 m 6 mm 7 rs 8 py 9 pyi 9 js 10 mjs 10 cjs 10 jsx 10 ts 11 mts 11 cts 11 java 12 go 13 cs 14 fs 15 fsx 15 s 16 asm 16 sh 17 bash 17 zsh 17 mk 18 cmake 19 gn 20 gni 20 yml 22 yaml 22 json 23 jsonc 23 toml 24 xml 25 md 26 markdown 26 txt 1 tsx 28 fsi 29".split()
_BY_NAME = "Makefile 18 makefile 18 GNUmakefile 18 Kbuild 18 CMakeLists.txt 19 BUILD.gn 20 BUILD 20 Kconfig 21 OWNERS 27 MAINTAINERS 27 CODEOWNERS 27".split()
_cases = lambda column, pairs: f"CASE {column} " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in zip(pairs[::2], pairs[1::2], strict=True)) + " END"
PATH_CLASSES = f"""WITH p AS (SELECT DISTINCT path, string_split(path, '/')[-1] AS name, lower(string_split(path, '/')[-1]) AS low FROM source_files),
q AS (SELECT *, CASE WHEN strpos(name[2:], '.') > 0 AND name NOT LIKE '%.' THEN string_split(low, '.')[-1] ELSE '' END AS ext, list_transform(string_split(path, '/')[:-2], lambda x: lower(x)) AS dirs FROM p)
SELECT path, coalesce({_cases("name", _BY_NAME)}, CASE WHEN name LIKE 'Kconfig.%' THEN 21 WHEN length(name) > 2 AND name LIKE '%.C' THEN 4 WHEN length(name) > 2 AND name LIKE '%.H' THEN 5 END, {_cases("ext", _BY_EXTENSION)}, 0) AS language,
 (CASE WHEN list_has_any(dirs, ['test', 'tests', 'testing', '__tests__', 'spec']) OR starts_with(low, 'test_') OR contains(low, '_test.') OR contains(low, '.test.') OR contains(low, '_unittest.') THEN 4 ELSE 0 END)
 + (CASE WHEN ends_with(low, '.g.cs') OR ends_with(low, '.generated.cs') OR ends_with(low, '.pb.go') OR ends_with(low, '.pb.cc') OR ends_with(low, '.pb.h') THEN 8 ELSE 0 END)
 + (CASE WHEN list_has_any(dirs, ['third_party', 'thirdparty', 'vendor', 'vendored', 'node_modules', 'external', 'externals']) THEN 16 ELSE 0 END) AS flags,
 NOT (path = '' OR starts_with(path, '/') OR ends_with(path, '/') OR contains(path, '//') OR regexp_matches(path, '[\x00-\x1f\x7f\\\\]') OR list_has_any(string_split(path, '/'), ['.', '..']) OR len(string_split(path, '/')) > 256) AS valid FROM q"""


@query("path_classes", PATH_CLASSES)
def _(s, d):
    return files(s, d).select("path", P.language(F.col("path")).alias("language"), P.flags(F.col("path")).alias("flags"), P.is_valid(F.col("path")).alias("valid")).distinct()


@query("case_collisions", "SELECT regexp_replace(path, '/?[^/]*$', '') AS parent, lower(string_split(path, '/')[-1]) AS folded, count(DISTINCT path) AS n FROM source_files GROUP BY 1, 2 HAVING count(DISTINCT path) > 1")
def _(s, d):
    p = F.col("path")
    return files(s, d).select("path").distinct().groupBy(P.parent(p).alias("parent"), F.lower(P.file_name(p)).alias("folded")).agg(F.count("*").alias("n")).filter("n > 1")


@query("line_counts", "SELECT doc_id, CASE WHEN text = '' THEN 0 ELSE len(regexp_extract_all(text, '\\r\\n|\\r|\\n')) + CASE WHEN regexp_matches(text, '[\\r\\n]\\z') THEN 0 ELSE 1 END END AS lines FROM documents WHERE text IS NOT NULL")
def _(s, d):
    return docs(s, d).filter("text is not null").select("doc_id", X.line_count(F.col("text")).alias("lines"))


_WORD_SCALARS = "[\\x{2E80}-\\x{2EFF}\\x{3040}-\\x{312F}\\x{3130}-\\x{318F}\\x{3400}-\\x{4DBF}\\x{4E00}-\\x{9FFF}\\x{A960}-\\x{A97F}\\x{AC00}-\\x{D7AF}\\x{F900}-\\x{FAFF}\\x{20000}-\\x{3FFFD}]"


@query("token_estimate", "SELECT doc_id, (ceil(a / 4) + k + ceil((length(text) - a - k) / 2))::BIGINT AS tokens FROM (SELECT *, length(regexp_replace(text, '[^\\x00-\\x7F]', '', 'g')) AS a, length(text) - length(regexp_replace(text, '" + _WORD_SCALARS + "', '', 'g')) AS k FROM documents WHERE text IS NOT NULL)")
def _(s, d):
    return docs(s, d).filter("text is not null").select("doc_id", X.token_estimate(F.col("text")).alias("tokens"))


@query("sanitize", "SELECT doc_id, md5(regexp_replace(text, '[\\x{0000}-\\x{001F}\\x{007F}-\\x{009F}\\x{061C}\\x{200E}\\x{200F}\\x{202A}-\\x{202E}\\x{2066}-\\x{2069}]', '�', 'g')) AS clean FROM documents WHERE text IS NOT NULL")
def _(s, d):
    return docs(s, d).filter("text is not null").select("doc_id", F.md5(X.sanitize(F.col("text"))).alias("clean"))


@query("nfc", "SELECT doc_id, md5(nfc_normalize(text)) AS form FROM documents WHERE text IS NOT NULL")
def _(s, d):
    return docs(s, d).filter("text is not null").select("doc_id", F.md5(X.nfc(F.col("text"))).alias("form"))


@query("word_split", "SELECT DISTINCT name, array_to_string(list_filter(regexp_split_to_array(lower(regexp_replace(regexp_replace(regexp_replace(regexp_replace(name, '([a-z])([A-Z])', '\\1 \\2', 'g'), '([A-Z])([A-Z][a-z])', '\\1 \\2', 'g'), '([A-Za-z])([0-9])', '\\1 \\2', 'g'), '([0-9])([A-Za-z])', '\\1 \\2', 'g')), '[^a-z0-9]+'), lambda x: x <> ''), ' ') AS words FROM source_symbols")
def _(s, d):
    return symbols(s, d).select("name", F.array_join(X.words(F.col("name")), " ").alias("words")).distinct()


@query("ngrams3", "SELECT p_partkey, array_to_string(list_sort(list_distinct(list_transform(range(1, length(p_name) - 1), lambda i: lower(substr(p_name, i, 3))))), ',') AS grams FROM part")
def _(s, d):
    return parts(s, d).select("p_partkey", F.array_join(X.ngrams(F.col("p_name")), ",").alias("grams"))


@query("short_names", "SELECT DISTINCT qualified_name, string_split(qualified_name, '::')[-1] AS short FROM source_symbols")
def _(s, d):
    return symbols(s, d).select("qualified_name", X.short_name(F.col("qualified_name")).alias("short")).distinct()


@query("guard_names", r"""WITH c AS (SELECT DISTINCT cond FROM source_symbols WHERE cond IS NOT NULL), w AS (SELECT cond, unnest(regexp_extract_all(regexp_replace(cond, '\b[0-9][0-9A-Za-z_.]*', ' ', 'g'), '[A-Za-z_][A-Za-z0-9_]*')) AS word, generate_subscripts(regexp_extract_all(regexp_replace(cond, '\b[0-9][0-9A-Za-z_.]*', ' ', 'g'), '[A-Za-z_][A-Za-z0-9_]*'), 1) AS pos FROM c),
f AS (SELECT cond, word, min(pos) AS pos FROM w WHERE word <> 'defined' GROUP BY cond, word) SELECT c.cond, coalesce(string_agg(word, ',' ORDER BY pos), '') AS names FROM c LEFT JOIN f USING (cond) GROUP BY c.cond""")
def _(s, d):
    return symbols(s, d).filter("cond is not null").select("cond", F.array_join(X.guard_names(F.col("cond")), ",").alias("names")).distinct()


@query("display_width")
def _(s, d):
    return symbols(s, d).select("name", X.display_width(F.col("name")).alias("width"), X.truncate_to_width(F.col("name"), 12).alias("cut")).distinct()


@query("note_scan", "SELECT file_idx, row_number() OVER (PARTITION BY file_idx ORDER BY qualified_name) AS line, 'NOTE' AS tag, 'NOTE: ' || rtrim(substr(qualified_name, 1, 256)) AS note FROM (SELECT DISTINCT file_idx, qualified_name FROM source_symbols WHERE qualified_name IS NOT NULL)")
def _(s, d):
    """Notes that the line scanner finds where every symbol of a file has one behind a statement."""
    names = symbols(s, d).filter("qualified_name is not null").select("file_idx", "qualified_name").distinct()
    said = F.transform(F.array_sort(F.collect_list("qualified_name")), lambda q: F.concat(F.lit('x = "// TODO: no"; /* NOTE : '), q, F.lit("  */")))
    texts = names.groupBy("file_idx").agg(F.array_join(said, "\n").alias("text"))
    return A.scanned(texts, "file_idx", "text", "c").filter("kind = 'Note'").select("file_idx", "line", F.col("name").alias("tag"), F.col("qualified_name").alias("note"))


@query("budget_prefix", "SELECT doc_id, running FROM (SELECT doc_id, sum(n) OVER (ORDER BY n, doc_id)::BIGINT AS running FROM (SELECT doc_id, (ceil(a / 4) + k + ceil((length(text) - a - k) / 2))::BIGINT AS n FROM (SELECT *, length(regexp_replace(text, '[^\\x00-\\x7F]', '', 'g')) AS a, length(text) - length(regexp_replace(text, '" + _WORD_SCALARS + "', '', 'g')) AS k FROM documents WHERE length(text) > 0))) WHERE running <= 8000")
def _(s, d):
    """The shortest documents that fit a budget of tokens together."""
    rows = docs(s, d).filter("length(text) > 0").select("doc_id", X.token_estimate(F.col("text")).alias("n"))
    return T.budget_prefix(rows, ["n", "doc_id"], "n", 8000).select("doc_id", "running")


@query("name_limits", "SELECT DISTINCT qualified_name, substr(qualified_name, 1, 12) AS cut, length_grapheme(qualified_name) AS clusters FROM source_symbols WHERE qualified_name IS NOT NULL")
def _(s, d):
    q = F.col("qualified_name")
    return symbols(s, d).filter("qualified_name is not null").select("qualified_name", X.name_of(q, 12).alias("cut"), X.grapheme_count(q).alias("clusters")).distinct()


@query("tier_counters", "SELECT count_if(language IN (2, 3, 4, 5) AND encoding < 11)::BIGINT AS syntax, count_if(language NOT IN (2, 3, 4, 5) AND encoding < 11)::BIGINT AS lines, count_if(encoding >= 11)::BIGINT AS not_extracted FROM (SELECT coalesce(language, 0) AS language, encoding FROM source_files)")
def _(s, d):
    """How far files of their language and encoding are looked into."""
    language = F.coalesce("language", F.lit(0))
    tier = F.when(F.col("encoding") >= 11, 0).when(language.isin(2, 3, 4, 5), 2).otherwise(1)
    return B.tiers(files(s, d).withColumn("tier", tier))


@query("reference_order", "SELECT source, edge_kind, start_byte, target, qualifier, row_number() OVER (PARTITION BY source ORDER BY edge_kind, start_byte, target, coalesce(qualifier, '')) - 1 AS pos FROM (SELECT DISTINCT source, edge_kind, start_byte, target, qualifier FROM ref_candidates)")
def _(s, d):
    """References in their order within a source; text by its UTF-16 units."""
    rows = refs(s, d).select("source", "edge_kind", "start_byte", "target", "qualifier").distinct()
    order = ["edge_kind", "start_byte", S.utf16(F.col("target")), S.utf16(F.coalesce("qualifier", F.lit("")))]
    return T.ordinals(rows, ["source"], order).withColumnRenamed("ordinal", "pos")


@query("line_offsets", "SELECT corpus_id, sum(n) AS sum_of_starts, count(*) AS lines, max(n) AS last_start FROM (SELECT corpus_id, coalesce(sum(octet_length(encode(line)) + 1) OVER (PARTITION BY corpus_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS n FROM (SELECT corpus_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS k FROM (SELECT corpus_id, any_value(text) AS text FROM corpus_docs WHERE text IS NOT NULL GROUP BY corpus_id))) GROUP BY corpus_id")
def _(s, d):
    """Where each line of a text begins, in bytes: their number, their sum and the last."""
    t = table(s, d, "corpus_docs").filter("text is not null").select("corpus_id", "text").dropDuplicates(["corpus_id"])
    starts = t.select("corpus_id", X.line_starts(F.col("text")).alias("at"))
    total = F.aggregate("at", F.lit(0).cast("bigint"), lambda a, x: a + x)
    return starts.select("corpus_id", total.alias("sum_of_starts"), F.size("at").cast("bigint").alias("lines"), F.element_at("at", -1).alias("last_start"))


@query("refs_late", "SELECT source, target, line, start_byte, epoch_us(scanned_at) AS scanned_us, epoch_us(loaded_at) AS loaded_us FROM ref_candidates WHERE loaded_at > scanned_at + INTERVAL 2 DAY")
def _(s, d):
    return refs(s, d).filter("loaded_at > scanned_at + interval 2 day").select("source", "target", "line", "start_byte", F.unix_micros("scanned_at").alias("scanned_us"), F.unix_micros("loaded_at").alias("loaded_us"))
