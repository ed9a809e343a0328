"""Repetition inside one document: a threshold table compiled into one projection, without user functions.

The measures are expressions over arrays of the document's own units, so a document is measured where it lies
and nothing is shuffled.  A unit is a word, or a single letter in documents written mostly in a script without
spaces; letter case, punctuation, numbers and markup are left aside.  A unit is repeated if a run of ``RUN`` units
(``LETTERS`` letters) around it, within a sentence or list item, already stood earlier, or if its whole sentence,
list item or paragraph did, however short it is.

Defined cases: null, blank and letterless texts measure 0 and are never found; repeated rows count once; a finding
whose document, line or related lines are missing is no case.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .lexicon import COMMON_WORDS
from .plain import with_plain
from .sentences import _BEFORE_NUMBER, _INNER, _TITLES, _any

RUN, LETTERS = 5, 12
MEASURES = ("repeated_share", "again_share", "repeated_line_share", "repeated_sentence_share", "symbol_share", "common_share", "mean_line")
#: Scripts without spaces between words: kana, Han, Thai, Lao, Khmer, Myanmar.
_UNSPACED = r"[\x{3040}-\x{30FF}\x{4E00}-\x{9FFF}\x{0E00}-\x{0EFF}\x{1000}-\x{109F}\x{1780}-\x{17FF}\x{3400}-\x{4DBF}\x{F900}-\x{FAFF}]"
#: Most characters of most texts, none of which is a break: looked at first.
_USUAL = r"(?![a-zA-Z0-9 ,\x{00C0}-\x{052F}\x{3040}-\x{30FF}\x{4E00}-\x{9FFF}])"
#: Signs for places that no phrase crosses: inside a sentence (cells, semicolons), at its end or before a list item,
#: and between paragraphs.
_CUT, _STOP, _GAP = _BREAK = "\ue000\ue001\ue002"
_UNITS = r"[\p{L}\p{M}]+|[\x{E000}-\x{E002}]"
_AFTER = r"+(?=[\s\p{Z}]|\z|[^\p{L}\p{N}])"
#: Dots of abbreviations, which cut nothing.
_ABBREVIATED = (
    r"(?=\.)(?:\.(?<=(?<![\p{L}\p{N}])" + _any(_TITLES) + r"\.)"
    r"|(?i:\.(?<=(?<![\p{L}\p{N}])" + _any(_INNER) + r"\.))"
    r"|(?i:\.(?=[\s\p{Z}]*\d)(?<=(?<![\p{L}\p{N}])" + _any(_BEFORE_NUMBER) + r"\.)))"
)
_BREAKS = (
    (r"\n(?=\s*\n)", _GAP),
    (_USUAL + r"(?:[.!?…。！？｡؟।።]" + _AFTER + r"|[。！？｡]|\n(?=\s*(?:[-*•–—→>]|\(?\w{1,3}[.)]\s|#)))", _STOP),
    (_USUAL + r"[;；|•·›→]" + _AFTER, _CUT),
)

#: The threshold table: measure, comparison, bound.  A document is repetitive if any row holds.
THRESHOLDS = (("again_share", ">=", 0.25),)


def _letters(text: Column) -> Column:
    return F.lower(F.regexp_replace(text, r"[^\p{L}\p{M}]+", ""))


def _is_unspaced(letters: Column) -> Column:
    """Whether most letters belong to a script without spaces; letters of ASCII are told by their bytes."""
    other = F.regexp_replace(letters, r"[\x00-\x7F]+", "")
    unspaced = F.length(other) - F.length(F.regexp_replace(other, _UNSPACED + "+", ""))
    return F.when(F.octet_length(letters) == F.length(letters), False).otherwise(unspaced * 2 > F.length(letters))


def _with_units(df: DataFrame, text: str, unspaced: str, name: str, said: str) -> DataFrame:
    """The units of a text and the signs of its breaks, in order; and as one string, its letters and those signs."""
    t = F.col(text)
    df = df.withColumn(name, F.when(F.regexp_like(t, F.lit(f"[{_CUT}-{_GAP}]")), F.translate(t, _BREAK, "   ")).otherwise(t))
    cut = F.lower(F.regexp_replace(name, _ABBREVIATED, " "))
    for pattern, sign in _BREAKS:
        cut = F.regexp_replace(cut, pattern, f" {sign} ")
    df = df.withColumn(name, cut).withColumn(said, F.regexp_replace(name, r"[^\p{L}\p{M}\x{E000}-\x{E002}]+", ""))
    units = F.when(F.col(unspaced), F.filter(F.split(said, ""), lambda u: u != "")).otherwise(F.regexp_extract_all(name, F.lit(_UNITS), F.lit(0)))
    return df.withColumn(name, units)


def measured(df: DataFrame, text_column: str, names: tuple[str, ...] = MEASURES) -> DataFrame:
    """The rows with the named measures of their texts added; what they are built on stays inside the projection.

    The measures leave through ``inline``, which a filter on them doesn't pass: pushed below it, the filter would
    hold the whole chain of expressions once for each mention.  Places are looked for only in texts in which two
    runs, sentences or paragraphs are alike.
    """
    t, columns = "__plain", df.columns
    signs = str(tuple(_BREAK))
    df = with_plain(df, F.coalesce(F.col(text_column), F.lit("")), t)
    df = df.withColumn("__bare", F.regexp_replace(t, r"[^\p{L}\p{M}]+", "")).withColumn("__letters", F.length("__bare").cast("bigint"))
    df = df.withColumn("__unspaced", _is_unspaced(F.col("__bare")))
    df = _with_units(df, t, "__unspaced", "__units", "__marks")
    df = df.withColumn("__run", F.when(F.col("__unspaced"), LETTERS).otherwise(RUN))
    # a break's hash is its place, so a run over one is like no other run
    df = df.withColumn("__hashes", F.expr(f"transform(__units, (u, i) -> IF(u IN {signs}, bigint(i), xxhash64(u)))"))
    hashed = lambda array, places: "xxhash64(" + ", ".join(f"{array}[i + {k}]" for k in places) + ")"
    thirds = f"transform(sequence(0, size(__units) - {LETTERS // 4}), i -> {hashed('__hashes', range(LETTERS // 4))})"
    df = df.withColumn("__thirds", F.expr(f"CASE WHEN __unspaced AND size(__units) >= {LETTERS} THEN {thirds} ELSE array() END"))
    letters = f"transform(sequence(0, size(__units) - {LETTERS}), i -> {hashed('__thirds', range(0, LETTERS, LETTERS // 4))})"
    words = f"transform(sequence(0, size(__units) - {RUN}), i -> {hashed('__hashes', range(RUN))})"
    df = df.withColumn("__run_hashes", F.expr(f"CASE WHEN size(__units) < __run THEN array() WHEN __unspaced THEN {letters} ELSE {words} END"))
    df = df.withColumn("__alike", F.size("__run_hashes") > F.size(F.array_distinct("__run_hashes")))
    # sentences, and paragraphs of several of them: their letters without the breaks in them
    df = df.withColumn("__marks", F.replace("__marks", F.lit(_CUT), F.lit("")))
    df = df.withColumn("__saids", F.filter(F.split("__marks", f"[{_STOP}{_GAP}]"), lambda x: x != ""))
    several = F.filter(F.split("__marks", _GAP), lambda x: F.regexp_like(x, F.lit(f"[^{_STOP}]{_STOP}+[^{_STOP}]")))
    df = df.withColumn("__saids", F.concat("__saids", F.transform(several, lambda x: F.replace(x, F.lit(_STOP), F.lit("")))))
    df = df.withColumn("__saids", F.transform("__saids", lambda x: F.xxhash64(x)))
    df = df.withColumn("__said_alike", F.size("__saids") > F.size(F.array_distinct("__saids")))
    df = df.withColumn("__sizes", F.expr(f"CASE WHEN __alike OR __said_alike THEN transform(__units, u -> IF(u IN {signs}, 0, length(u))) ELSE array() END"))
    # every run of units with its place, in order: all but the first of equal runs stood earlier
    df = df.withColumn("__runs", F.expr("CASE WHEN __alike THEN sort_array(transform(__run_hashes, (h, k) -> named_struct('h', h, 'i', k + 1))) ELSE array() END"))
    df = df.withColumn("__again", F.expr("CASE WHEN __alike THEN array_sort(filter(transform(sequence(2, size(__runs)), j -> IF(__runs[j - 1].h = __runs[j - 2].h, __runs[j - 1].i, NULL)), x -> x IS NOT NULL)) ELSE array() END"))
    covered = """aggregate(transform(__again, (p, k) -> aggregate(
        sequence(IF(k = 0, p, greatest(p, __again[k - 1] + __run)), p + __run - 1),
        0L, (a, q) -> a + __sizes[q - 1])), 0L, (a, x) -> a + x)"""
    df = df.withColumn("__repeated", F.expr(covered))
    # sentences and paragraphs with their places; one is said again if its letters stood whole before it began
    for name, ends in (("__sentences", (_STOP, _GAP)), ("__paragraphs", (_GAP,))):
        at = f"filter(sequence(0, size(__units) + 1), i -> i = 0 OR i > size(__units) OR __units[i - 1] IN ({', '.join(map(repr, ends))}))"
        df = df.withColumn(f"{name}_at", F.expr(f"CASE WHEN __said_alike THEN {at} ELSE array() END"))
        said = f"array_join(filter(slice(__units, {name}_at[k - 1] + 1, {name}_at[k] - {name}_at[k - 1] - 1), u -> u NOT IN {signs}), '')"
        parts = f"filter(transform(sequence(1, size({name}_at) - 1), k -> named_struct('said', {said}, 'i', {name}_at[k - 1] + 1, 'e', {name}_at[k] - 1)), x -> x.said <> '')"
        df = df.withColumn(name, F.expr(f"CASE WHEN __said_alike THEN transform({parts}, x -> named_struct('h', xxhash64(x.said), 'i', x.i, 'e', x.e)) ELSE array() END"))
    df = df.withColumn("__parts", F.expr("sort_array(concat(__sentences, __paragraphs))"))
    df = df.withColumn("__parts_again", F.expr("CASE WHEN size(__parts) > 1 THEN filter(transform(sequence(2, size(__parts)), j -> IF(__parts[j - 1].h = __parts[j - 2].h AND __parts[j - 2].e < __parts[j - 1].i, named_struct('i', __parts[j - 1].i, 'e', __parts[j - 1].e), NULL)), x -> x IS NOT NULL) ELSE array() END"))
    # the union of phrases, sentences and paragraphs, from left to right
    union = """aggregate(array_sort(concat(transform(__again, p -> named_struct('i', p, 'e', p + __run - 1)), __parts_again)),
        named_struct('to', 0, 'n', 0L),
        (a, x) -> named_struct('to', greatest(a.to, x.e), 'n', a.n + IF(x.e <= a.to, 0L,
            aggregate(slice(__sizes, greatest(a.to + 1, x.i), x.e - greatest(a.to + 1, x.i) + 1), 0L, (s, v) -> s + v))),
        a -> a.n)"""
    df = df.withColumn("__said_again", F.expr(f"IF(size(__parts_again) = 0, __repeated, {union})"))
    # as columns of their own, each is cut once and not once for each mention
    if "repeated_line_share" in names:
        df = df.withColumn("__lines", F.filter(F.transform(F.split(F.col(t), "\n"), _letters), lambda x: x != ""))
    if "repeated_sentence_share" in names:
        df = df.withColumn("__said", F.filter(F.transform(F.split(F.col(t), r"[.!?…。！？｡؟।።]+|\n\s*\n"), _letters), lambda x: x != ""))
    lines, sentences = F.col("__lines"), F.col("__said")
    share = lambda x, n: F.when(n > 0, x / n).otherwise(0.0)
    chars = F.length(F.regexp_replace(F.col(t), r"\s+", ""))
    common = sorted({w for words in COMMON_WORDS.values() for w in words.split()})
    measures = {
        "repeated_share": share(F.col("__repeated"), F.col("__letters")),
        "again_share": share(F.col("__said_again"), F.col("__letters")),
        "repeated_line_share": share(F.size(lines) - F.size(F.array_distinct(lines)), F.size(lines)),
        "repeated_sentence_share": share(F.size(sentences) - F.size(F.array_distinct(sentences)), F.size(sentences)),
        "symbol_share": share(chars - F.col("__letters"), chars),
        "common_share": share(F.size(F.filter("__units", lambda u: u.isin(common))), F.size(F.filter("__units", lambda u: ~u.isin(*_BREAK)))),
        "mean_line": share(F.length(t), F.size(F.split(F.col(t), r"\n"))),
    }
    row = F.struct(F.col("__letters").alias("letters"), *(measures[name].alias(name) for name in names))
    return df.select(*columns, F.inline(F.array(row)))


def compiled(thresholds=THRESHOLDS) -> Column:
    """The threshold table as one condition."""
    return F.expr(" OR ".join(f"{name} {sign} {bound!r}D" for name, sign, bound in thresholds))


def repetitive(df: DataFrame, id_column: str, text_column: str, thresholds=THRESHOLDS) -> DataFrame:
    rows = df.select(F.col(id_column).alias("row_id"), F.col(text_column).cast("string").alias("__text"))
    needed = tuple(dict.fromkeys(name for name, _, _ in thresholds))
    return measured(rows, "__text", needed).filter(compiled(thresholds)).select("row_id").distinct()


def same_lines(findings: DataFrame, documents: DataFrame) -> DataFrame:
    """(row_id) of findings at least half of whose other related lines say the same as their own line.

    Documents go into the join as 64-bit hashes of their lines, in order; a line without letter or digit has none.
    """
    said = lambda line: F.lower(F.regexp_replace(line, r"[^\p{L}\p{M}\p{N}]+", ""))
    lines = F.transform(F.split("text", r"\n"), lambda x: F.when(said(x) != "", F.xxhash64(said(x))))
    texts = documents.filter("text is not null and corpus_id is not null").select("corpus_id", lines.alias("lines")).dropDuplicates(["corpus_id"])
    asked = findings.filter("related_lines is not null").select("finding_id", "corpus_id", "line", "related_lines").distinct()
    both = asked.join(texts, "corpus_id")
    both = both.withColumn("own", F.expr("get(lines, line - 1)")).filter("own is not null")
    both = both.withColumn("others", F.expr("filter(array_distinct(related_lines), x -> x IS NOT NULL AND x <> line)"))
    both = both.withColumn("same", F.expr("size(filter(others, x -> x >= 1 AND coalesce(get(lines, x - 1) = own, false)))"))
    return both.filter("size(others) > 0 AND same * 2 >= size(others)").select(F.col("finding_id").alias("row_id")).distinct()
