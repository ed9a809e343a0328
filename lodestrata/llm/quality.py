"""Per-document text quality: an ordered rule list learned by incremental reduced-error pruning, applied as SQL.

The measures of a document are SQL expressions over its lines and paragraphs.  Labels come from a closer reading
of a bounded sample (its rendered blocks and their sentences); rules are grown on one part of the sample and
pruned on the other, and the learned thresholds become one CASE expression that is applied to all documents.

Defined cases: null, blank and letterless-by-blank texts measure 0 and are never found; if the sample holds one
label only, the rule list is the single threshold of the definition; repeated rows count once; char_count and
corpus_type are carried along as they are, since their spelling and freshness say nothing about the text.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import lookalike, markup
from .lexicon import COMMON_WORDS
from .plain import with_plain

#: At most about so many documents are read closely to learn the rules.
SAMPLE = 3000
MEASURES = ["prose", "common", "letters", "mixed", "garbled", "ended_lines", "mean_word", "digits"]

#: Full-width letters and digits; the wide marks of Chinese and Japanese stay, as they tell prose from cells.
_LETTERS = "".join(c for c in lookalike._NARROW if c.isalnum())
_WIDE_LETTERS = "".join(chr(ord(c) + 0xFEE0) for c in _LETTERS)
_COMMON = sorted({w for words in COMMON_WORDS.values() for w in words.split()})
#: Most characters of most texts, none of which ends a sentence: looked at first.
_USUAL = r"(?![a-zA-Z0-9 ,\x{00C0}-\x{052F}\x{3040}-\x{30FF}\x{4E00}-\x{9FFF}])"
_ENDS = _USUAL + r"(?:[.!?…](?=[\s\"'”’»)\]]|\z)|[。！？｡।።؟])"
_CLOSED = _USUAL + r"[.!?…。！？｡।።؟][\"'”’»)\]」』）】]*[ \t]*(?=\n|\z)"
_UNSPACED = r"[\x{3040}-\x{30FF}\x{4E00}-\x{9FFF}\x{AC00}-\x{D7A3}\x{0E00}-\x{0EFF}\x{3400}-\x{4DBF}]+"
_GARBLED = r"[ÃÂâãåæçäèéïð][\x{0080}-\x{00BF}\x{2010}-\x{2122}\x{0152}-\x{0178}]|\x{FFFD}"
#: Characters to even out stand in these ranges only.
_UNEVEN = r"[\x{00A0}\x{00AD}\x{034F}\x{061C}\x{17B4}-\x{206F}\x{3000}\x{FE00}-\x{FF5A}]"
#: Lines that are an item, a row of cells or a menu whatever stands around them: what such a line holds, its pattern.
_ITEMS = (
    ((), r"\A\s*(?:[-*•–—→‣▪+]\s|\(?(?:\d{1,3}|[a-z])[.)]\s|\[[ xX]\]|\|)"),
    (("\t",), r"\t[^\t]*\t"),
    (("  ",), r"\S {2,}\S+ {2,}\S"),
    ((" ; ", " | ", " › ", " · ", " / "), r" [;|›·/] [^;|›·/]* [;|›·/] "),
    ((",",), r"\A(?:[^\s,]*,){2,}[^\s,]*\z"),
)


def _is_item(line: Column) -> Column:
    found = F.lit(False)
    for signs, pattern in _ITEMS:
        there = F.regexp_like(line, F.lit(pattern))
        if signs:
            there = reduce(Column.__or__, [F.contains(line, F.lit(sign)) for sign in signs]) & there
        found = found | there
    return found


def _is_common(word: Column) -> Column:
    """A common word, also one in which letters of another script stand among Latin ones."""
    mixed = (F.octet_length(word) > F.length(word)) & F.regexp_like(word, F.lit("[a-z]"))
    return word.isin(_COMMON) | (mixed & F.translate(word, lookalike._LETTERS, lookalike._LATIN).isin(_COMMON))


def _chars(text: Column) -> Column:
    """Characters that aren't blank; spaces of other widths are evened out before."""
    return F.length(F.regexp_replace(text, r"\s+", ""))


def _seen(block: Column) -> Column:
    """What is counted in a block."""
    ascii_ = F.octet_length(block) == F.length(block)
    rare = lambda pattern: F.when(ascii_, 0).otherwise(F.length(block) - F.length(F.regexp_replace(block, pattern, "")))
    words = F.regexp_extract_all(F.lower(block), F.lit(r"[\p{L}\p{M}]+"), F.lit(0))
    return F.struct(
        _chars(block).alias("size"),
        F.regexp_count(block, F.lit(_ENDS)).alias("ends"),
        rare(r"[\x{0E00}-\x{0EFF}]+").alias("thai"),
        rare(_UNSPACED).alias("unspaced"),
        rare(r"[、，]+").alias("commas"),
        words.alias("words"),
    )


def measured(df: DataFrame, text_column: str) -> DataFrame:
    """The rows with their measures added; each is a share but for mean_word."""
    columns = df.columns
    share = lambda x, n: F.when(n > 0, x / n).otherwise(0.0)
    total = lambda xs, of: F.aggregate(xs, F.lit(0), lambda a, x: a + of(x))
    # characters that only look different are no sign of quality: widths and invisible ones are evened out first
    text = F.coalesce(F.col(text_column).cast("string"), F.lit(""))
    even = F.regexp_replace(F.translate(text, _WIDE_LETTERS + lookalike._SPACES, _LETTERS + " " * len(lookalike._SPACES)), lookalike.INVISIBLE, "")
    even = F.when((F.octet_length(text) > F.length(text)) & F.regexp_like(text, F.lit(_UNEVEN)), even).otherwise(text)
    df = with_plain(df, even, "__plain")
    df = df.withColumn("__lines", F.filter(F.split("__plain", r"\n", -1), lambda x: ~_is_item(x)))
    df = df.withColumn("__blocks", F.filter(F.split(F.array_join("__lines", "\n"), r"\n\s*\n"), lambda x: F.regexp_like(x, F.lit(r"\S"))))
    df = df.withColumn("__blocks", F.transform("__blocks", _seen))
    # the words stay a column of their own, so that each is looked up once
    df = df.withColumn("__known", F.transform("__blocks", lambda b: F.size(F.filter(b["words"], _is_common))))
    df = df.withColumn("__chars", _chars(F.col("__plain"))).withColumn("__tokens", F.filter(F.split("__plain", r"\s+"), lambda x: F.length(x) > 2))

    def reads(b: Column, known: Column) -> Column:
        words = F.size(b["words"])
        long_enough = (words >= 2) | (b["unspaced"] >= 5)
        # sentences whose marks were lost, as in a loop of one phrase
        loose = ((words >= 12) & (known >= 0.25 * words)) | ((b["unspaced"] > 40) & (b["commas"] * 40 >= b["unspaced"]))
        return ((b["ends"] > 0) & (b["size"] <= 240 * b["ends"]) & long_enough) | (b["thai"] * 2 > b["size"]) | loose

    prose = F.zip_with("__blocks", "__known", lambda b, known: F.when(reads(b, known), b["size"]).otherwise(0))
    df = df.withColumn("__prose", total(prose, lambda x: x)).withColumn("__unspaced", total("__blocks", lambda b: b["unspaced"]))
    df = df.withColumn("__n_words", total("__blocks", lambda b: F.size(b["words"])))
    df = df.withColumn("__letters", total("__blocks", lambda b: total(b["words"], F.length)))
    plain, n = F.col("__plain"), F.col("__chars")
    signs = F.length(F.regexp_replace(plain, r"[^のをがにはでともたしれ的了是在有和不这那还之就은는이가을를에다로고하지의ทนกงมไใเจึ]+", ""))
    odd = F.filter("__tokens", lambda x: F.regexp_like(x, F.lit(r"[\d;|?!@%^:]")) & F.regexp_like(x, F.lit(r"\p{Ll}[\d;|?!@%^:]+\p{Ll}|\A[;|^%@]|[\d^%@;|][^\p{L}]*\p{L}.*[\d^%@;|]")))
    garbled = F.when(F.octet_length(plain) == F.length(plain), 0).otherwise(F.regexp_count(plain, F.lit(_GARBLED)))
    said = F.size(F.filter(F.split("__plain", r"\n"), lambda x: F.regexp_like(x, F.lit(r"\S"))))
    row = F.struct(
        share(F.col("__prose"), n).alias("prose"),
        F.when(F.col("__unspaced") * 4 > n, share(signs, F.col("__unspaced"))).otherwise(share(total("__known", lambda x: x), F.col("__n_words"))).alias("common"),
        share(F.col("__letters"), n).alias("letters"),
        share(F.size(odd), F.size("__tokens")).alias("mixed"),
        share(2 * garbled, n).alias("garbled"),
        share(F.regexp_count(plain, F.lit(_CLOSED)), said).alias("ended_lines"),
        share(F.col("__letters"), F.col("__n_words")).alias("mean_word"),
        share(F.length(plain) - F.length(F.regexp_replace(plain, "[0-9]+", "")), n).alias("digits"),
        F.col("__n_words").alias("n_words"),
        n.alias("n_chars_seen"),
    )
    # blank texts are left out here, as a filter would be pushed down and hold the whole chain once for each mention
    return df.select(*columns, F.inline(F.filter(F.array(row), lambda r: r["n_chars_seen"] > 0)))


_WORD = re.compile(r"(?:[^\W\d_]|[\u0300-\u036f\u0900-\u0963\u0970-\u097f])+")
_EVEN = str.maketrans(_WIDE_LETTERS + lookalike._HALF + lookalike._SPACES, _LETTERS + lookalike._FULL + " " * len(lookalike._SPACES))
_FOLD = str.maketrans(lookalike._LETTERS, lookalike._LATIN)
_UNSEEN = re.compile("[\u00ad\u034f\u061c\u180b-\u180f\u200b-\u200f\u202a-\u202e\u2060-\u206f\ufe00-\ufe0f\ufeff]")
_SET = frozenset(_COMMON)


def reads_well(block: str) -> bool:
    """Whether a paragraph consists of readable running sentences."""
    text = " ".join(block.split())
    dense = re.sub(r"\s", "", text)
    if not dense:
        return False
    letters = sum(c.isalpha() or "฀" <= c <= "๿" or "ऀ" <= c <= "ॿ" for c in dense)
    if letters < 0.55 * len(dense) or len(re.findall(r"[ÃÂâãåæçäèéïð][\x80-\xbf‐-™Œ-Ÿ]|�", text)) > 0.03 * len(dense):
        return False
    thai = sum("฀" <= c <= "๿" for c in dense)
    if thai * 2 > len(dense):
        return len(dense) > 12
    cjk = sum("぀" <= c <= "鿿" or "가" <= c <= "힣" for c in dense)
    ends = len(re.findall(r"[.!?…](?=[\s\"'”’»)\]]|\Z)|[。！？｡।።؟]", text))
    words = [w.lower() for w in _WORD.findall(text)]
    if cjk * 4 > len(dense):
        signs = sum(c in "のをがにはでともたしれ的了是在有和不这那还之就은는이가을를에다로고하지의" for c in dense)
        kana_only = not re.search(r"[一-鿿゠-ヿ가-힣]", text)
        commas = text.count("、") + text.count("，")
        return (ends > 0 and len(dense) <= 160 * ends or cjk > 40 and commas * 40 >= cjk) and signs >= 0.06 * cjk and not (kana_only and len(dense) > 30)
    odd = sum(bool(re.search(r"[a-z][\d;|?!@%^:]+[a-z]|^[;|^%@]", t)) for t in text.split())
    if odd > 0.15 * len(text.split()):
        return False
    common = sum(w in _SET or w.translate(_FOLD) in _SET for w in words)
    latin = bool(re.search(r"[a-zA-Z]", text)) and not re.search(r"[Ͱ-῿]", text)
    if len(words) >= 8 and common >= 0.25 * len(words):
        return True
    return ends > 0 and len(dense) <= 240 * ends and len(words) >= 2 and (common >= 0.1 * len(words) or (not latin and common > 0) or (len(words) <= 6 and len(words) > 2))


def is_junk(text: str) -> bool:
    """The closer reading: less than half of the characters, markup aside, stand in readable sentences."""
    page = markup.read(_UNSEEN.sub("", text.translate(_EVEN)))
    good = bad = 0
    for kind, _, block in page.blocks:
        for part in re.split(r"\n\s*\n", block):
            lines = part.split("\n")
            item = re.compile(r"\s*(?:[•–—→‣▪+]\s|[-*]\s|\(?(?:\d{1,3}|[a-z])[.)]\s)")
            rest = [x for x in lines if not item.match(x)]
            n = lambda xs: sum(len(re.sub(r"\s", "", x)) for x in xs)
            bad += n(x for x in lines if item.match(x))
            if kind == "text" and reads_well("\n".join(rest)):
                good += n(rest)
            else:
                bad += n(rest)
    return good < bad


Rule = list[tuple[int, bool, float]]


def _holds(rule: Rule, x: np.ndarray) -> np.ndarray:
    ok = np.ones(len(x), dtype=bool)
    for k, at_least, bound in rule:
        ok &= (x[:, k] >= bound) if at_least else (x[:, k] <= bound)
    return ok


def _grow(x: np.ndarray, y: np.ndarray) -> Rule:
    """Add the condition of the highest information gain until no negative is covered."""
    rule: Rule = []
    inside = np.ones(len(x), dtype=bool)
    while y[inside].sum() < inside.sum() and len(rule) < 6:
        p0, n0 = y[inside].sum(), (~y[inside]).sum()
        base = np.log2(p0 / (p0 + n0))
        best: tuple[float, tuple[int, bool, float] | None] = (1e-9, None)
        for k in range(x.shape[1]):
            v = x[inside, k]
            for bound in np.unique(np.quantile(v, np.linspace(0, 1, 41))):
                for at_least in (False, True):
                    c = (v >= bound) if at_least else (v <= bound)
                    p = (y[inside] & c).sum()
                    if p and c.sum() < len(v):
                        gain = p * (np.log2(p / c.sum()) - base)
                        if gain > best[0]:
                            best = (gain, (k, at_least, float(bound)))
        if best[1] is None:
            break
        rule.append(best[1])
        inside = _holds(rule, x)
    return rule


def learn(x: np.ndarray, y: np.ndarray, seed: int = 3) -> list[Rule]:
    """Ordered rules for the positive class by incremental reduced-error pruning (grow on 2/3, prune on 1/3)."""
    y = y.astype(bool)
    order = np.random.default_rng(seed).permutation(len(y))
    x, y = x[order], y[order]
    rules: list[Rule] = []
    while y.any() and len(rules) < 12:
        third = np.arange(len(y)) % 3 == 2
        rule = _grow(x[~third], y[~third]) if y[~third].any() else []
        worth = lambda r, m=third: (lambda c: (y[m][c].sum() - (~y[m][c]).sum()) / max(1, c.sum()))(_holds(r, x[m]))  # noqa: B023, E731
        while len(rule) > 1 and worth(rule[:-1]) >= worth(rule):
            rule = rule[:-1]
        covered = _holds(rule, x)
        if not rule or not covered.any() or worth(rule) <= 0 and third.sum() > 20:
            break
        rules.append(rule)
        x, y = x[~covered], y[~covered]
    return rules


def rules_sql(rules: Iterable[Rule], names: list[str]) -> str:
    """The rule list as one CASE expression."""
    cases = [" AND ".join(f"{names[k]} {'>=' if at_least else '<='} {bound!r}D" for k, at_least, bound in rule) for rule in rules]
    return "CASE " + " ".join(f"WHEN {c} THEN true" for c in cases) + " ELSE false END" if cases else "false"


def _labelled(rows: DataFrame) -> DataFrame:
    """The closer reading of each row's ``__text`` beside it, in tasks; the texts themselves don't leave them."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(0).to_pylist()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([is_junk(t) for t in texts], pa.bool_())], names=["__text", "__junk"])

    return rows.select("__text").mapInArrow(run, "__text string, __junk boolean")


def rule_list(df: DataFrame, text_column: str, sample: int = SAMPLE, label_column: str | None = None) -> str:
    """Learn the rule list from a bounded sample of the rows, chosen and ordered by a hash of the text.

    Labels are those of ``label_column`` where there is one, else those of the closer reading.  Only the measures
    and the labels of the sample come to the driver, and in an order that doesn't depend on files or tasks.
    """
    text = F.col(text_column).cast("string").alias("__text")
    texts = df.select(text) if label_column is None else df.select(text, F.col(label_column).cast("boolean").alias("__junk")).filter("__junk is not null")
    texts = texts.filter(F.regexp_like("__text", F.lit(r"\S"))).withColumn("__at", F.xxhash64("__text"))
    cut = int(min(1.0, sample / max(1, texts.count())) * (1 << 30))
    chosen = texts.filter(F.pmod("__at", F.lit(1 << 30)) < cut).distinct().orderBy("__at", "__text").limit(2 * sample).repartition(32)
    rows = _labelled(chosen) if label_column is None else chosen
    rows = measured(rows, "__text").select(*MEASURES, "__junk", F.xxhash64("__text").alias("__at")).toPandas().sort_values(["__at", *MEASURES])
    y = rows["__junk"].to_numpy(dtype=bool)
    if not len(rows):
        return "false"
    if not 0 < y.sum() < len(y):
        return "prose <= 0.5D"
    return rules_sql(learn(rows[MEASURES].to_numpy(dtype=float), y), MEASURES)


def found(df: DataFrame, id_column: str, text_column: str, sample: int = SAMPLE, label_column: str | None = None) -> DataFrame:
    case = rule_list(df, text_column, sample, label_column)
    rows = df.select(id_column, F.col(text_column).cast("string").alias("__text"))
    return measured(rows, "__text").filter(F.expr(case)).select(id_column).distinct()
