"""Scalar text functions as Column expressions; a Pandas UDF only where no built-in has the semantics."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType

from ..codes import CJK_RANGES

#: Scalars of Chinese, Japanese and Korean scripts, as a regex class.
CJK = "[" + "".join(f"\\x{{{a:04X}}}-\\x{{{b:04X}}}" for a, b in CJK_RANGES) + "]"
_CONTROLS = r"\x{0000}-\x{001F}\x{007F}-\x{009F}\x{061C}\x{200E}\x{200F}\x{202A}-\x{202E}\x{2066}-\x{2069}"


@F.pandas_udf(StringType())
def _nfc(s: pd.Series) -> pd.Series:
    return s.map(lambda x: x if x is None else unicodedata.normalize("NFC", x))


@F.pandas_udf(StringType())
def _fold(s: pd.Series) -> pd.Series:
    # one scalar to one scalar, no locale, no final-sigma rule
    return s.map(lambda x: x if x is None else "".join(c.lower() if len(c.lower()) == 1 else c for c in x))


@F.pandas_udf(IntegerType())
def _width(s: pd.Series) -> pd.Series:
    def one(c: str) -> int:
        if unicodedata.combining(c) or unicodedata.category(c) in ("Cc", "Cf", "Mn", "Me"):
            return 0
        return 2 if unicodedata.east_asian_width(c) in ("W", "F") else 1

    return s.map(lambda x: None if x is None else sum(map(one, x))).astype("Int32")


def _non_ascii(c: Column) -> Column:
    return F.regexp_like(c, F.lit(r"[^\x{0000}-\x{007F}]"))


def nfc(c: Column) -> Column:
    return F.when(_non_ascii(c), _nfc(c)).otherwise(c)


def fold(c: Column) -> Column:
    return F.when(_non_ascii(c), _fold(c)).otherwise(F.lower(c))


def lookup_key(c: Column, ignore_case: bool) -> Column:
    return nfc(fold(nfc(c))) if ignore_case else nfc(c)


def display_width(c: Column) -> Column:
    return F.when(_non_ascii(c), _width(c)).otherwise(F.length(F.regexp_replace(c, r"[\x00-\x1f\x7f]", "")))


@F.pandas_udf(StringType())
def _cut(s: pd.Series, width: pd.Series) -> pd.Series:
    import regex

    def one(text: str | None, most: int) -> str | None:
        if text is None:
            return None
        out, used = [], 0
        for cluster in regex.findall(r"\X", text):
            w = sum(0 if unicodedata.combining(c) or unicodedata.category(c) in ("Cc", "Cf", "Mn", "Me") else 2 if unicodedata.east_asian_width(c) in ("W", "F") else 1 for c in cluster)
            if used + w > most:
                break
            out.append(cluster)
            used += w
        return "".join(out)

    return pd.Series([one(a, b) for a, b in zip(s, width, strict=True)])


def truncate_to_width(c: Column, width: int) -> Column:
    """Whole grapheme clusters from the left, as many as fit."""
    return _cut(c, F.lit(width))


def sanitize(c: Column, multiline: bool = False) -> Column:
    """Control and direction characters become U+FFFD; multiline keeps tab, line feed and carriage return."""
    return F.regexp_replace(c, f"[{_CONTROLS}&&[^\\t\\n\\r]]" if multiline else f"[{_CONTROLS}]", "\ufffd")


def words(c: Column) -> Column:
    """Identifier words in lower case: camel humps, acronym ends and digit borders part them, a CJK run is one."""
    t = F.regexp_replace(c, r"(\p{Ll})(\p{Lu})", "$1 $2")
    t = F.regexp_replace(t, r"(\p{Lu})(\p{Lu}\p{Ll})", "$1 $2")
    t = F.regexp_replace(t, r"(\p{L})(\p{Nd})", "$1 $2")
    t = F.regexp_replace(t, r"(\p{Nd})(\p{L})", "$1 $2")
    t = F.regexp_replace(t, f"({CJK}+)", " $1 ")
    return F.filter(F.split(F.lower(t), r"[^\p{L}\p{N}\p{M}]+"), lambda w: w != "")


def ngrams(c: Column, n: int = 3) -> Column:
    """Distinct n-grams in order; two scalars where a CJK character begins; the whole of a shorter text."""
    low = F.lower(c)
    grams = F.transform(F.sequence(F.lit(1), F.length(low) - n + 1), lambda i: F.when(F.regexp_like(F.substring(low, i, F.lit(1)), F.lit(CJK)), F.substring(low, i, F.lit(2))).otherwise(F.substring(low, i, F.lit(n))))
    return F.when(F.length(low) < n, F.filter(F.array(low), lambda x: x != "")).otherwise(F.array_sort(F.array_distinct(grams)))


def token_parts(c: Column) -> tuple[Column, Column, Column]:
    ascii_ = F.length(F.regexp_replace(c, r"[^\x{0000}-\x{007F}]", ""))
    cjk = F.length(c) - F.length(F.regexp_replace(c, CJK, ""))
    return ascii_, cjk, F.length(c) - ascii_ - cjk


def token_estimate(c: Column) -> Column:
    a, k, o = token_parts(c)
    return (F.ceil(a / 4) + k + F.ceil(o / 2)).cast("bigint")


def line_count(c: Column) -> Column:
    """CR, LF and CRLF each end a line; an unfinished last line counts; 0 for empty text."""
    ends = F.regexp_count(c, F.lit(r"\r\n|\r|\n"))
    return F.when(c == "", 0).otherwise(ends + F.when(F.regexp_like(c, F.lit(r"[\r\n]\z")), 0).otherwise(1)).cast("int")


def line_starts(c: Column) -> Column:
    """Bytes before each line; CR, LF and CRLF end one, and what follows the last end is a line, empty or not.

    Pieces are the lines with their ends, so their sizes add up; sums are built in blocks, as appending to one array
    would copy it for each line.
    """
    sizes = F.transform(F.split(F.regexp_replace(c, r"(\r\n|\r|\n)", "$1\x00"), "\x00", -1), lambda x: F.octet_length(x).cast("bigint"))

    def running(xs: Column, first: Column) -> Column:
        return F.aggregate(xs, F.array(first), lambda a, x: F.array_append(a, F.element_at(a, -1) + x))

    def of(sizes: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(1), F.size(sizes), F.lit(256)), lambda k: F.slice(sizes, k, F.lit(256)))
        totals = F.transform(blocks, lambda b: F.aggregate(b, F.lit(0).cast("bigint"), lambda a, x: a + x))
        begins = running(totals, F.lit(0).cast("bigint"))
        return F.flatten(F.zip_with(blocks, F.slice(begins, F.lit(1), F.size(blocks)), lambda b, first: F.slice(running(b, first), F.lit(1), F.size(b))))

    return F.get(F.transform(F.array(sizes), of), 0)


def flag_names(c: Column, names: list[str]) -> Column:
    return F.filter(F.array(*[F.when(c.bitwiseAND(1 << i) != 0, F.lit(n)) for i, n in enumerate(names)]), lambda x: x.isNotNull())


def short_name(c: Column) -> Column:
    return F.substring_index(c, "::", -1)


def guard_names(c: Column) -> Column:
    """Identifiers of a preprocessor condition outside literals and numbers, without ``defined``, once each."""
    t = F.regexp_replace(c, r"\"(?:[^\"\\]|\\.)*\"|'(?:[^'\\]|\\.)*'|\b\d[\w.]*", " ")
    return F.array_except(F.array_distinct(F.regexp_extract_all(t, F.lit(r"[A-Za-z_]\w*"), F.lit(0))), F.array(F.lit("defined")))


_SIZES = {"": 1, "b": 1, "kb": 1000, "mb": 1000**2, "gb": 1000**3, "kib": 1024, "mib": 1024**2, "gib": 1024**3, "tib": 1024**4}


def size_of(text: str) -> int:
    """Bytes that a size such as ``64MiB`` spells; ValueError for anything else."""
    import re

    m = re.fullmatch(r"(\d+) ?([A-Za-z]*)", text.strip())
    unit = _SIZES.get(m.group(2).lower()) if m else None
    if unit is None or (value := int(m.group(1)) * unit) >= 1 << 63:
        raise ValueError(f"not a size: {text!r}")
    return value


@F.pandas_udf(StringType())
def _cut_units(s: pd.Series, most: pd.Series) -> pd.Series:
    def one(text: str | None, units: int) -> str | None:
        if text is None:
            return None
        raw = unicodedata.normalize("NFC", text).encode("utf-16-le", "surrogatepass")
        return raw[: 2 * units].decode("utf-16-le", "ignore")

    return pd.Series([one(a, b) for a, b in zip(s, most, strict=True)])


def name_of(c: Column, most: int = 1024) -> Column:
    """NFC, cut to a number of UTF-16 units; no pair is split.  ASCII names stay in the JVM."""
    return F.when(_non_ascii(c), _cut_units(c, F.lit(most))).otherwise(F.substring(c, 1, most))


@F.pandas_udf(IntegerType())
def _clusters(s: pd.Series) -> pd.Series:
    import regex

    return s.map(lambda x: None if x is None else len(regex.findall(r"\X", x))).astype("Int32")


def grapheme_count(c: Column) -> Column:
    """Clusters that a reader takes as one character; CR LF is one."""
    return F.when(_non_ascii(c), _clusters(c)).otherwise(F.length(F.replace(c, F.lit("\r\n"), F.lit("\n"))))
