"""Encoding of file contents by byte structure, and decoding to text."""

from __future__ import annotations

import codecs
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

PREFIX = 65_536
_BOMS = ((b"\xef\xbb\xbf", "UTF-8-BOM"), (b"\xff\xfe", "UTF-16LE"), (b"\xfe\xff", "UTF-16BE"))
_ISO_2022_JP = (b"\x1b$@", b"\x1b$B", b"\x1b(B", b"\x1b(J", b"\x1b(I")
# What may stand in each multi-byte encoding, in the order in which candidates are named.
_STRUCTURE = {
    "Shift_JIS": rb"(?:[\x00-\x7f\xa1-\xdf]|[\x81-\x9f\xe0-\xfc][\x40-\x7e\x80-\xfc])*",
    "EUC-JP": rb"(?:[\x00-\x7f]|\x8e[\xa1-\xdf]|\x8f[\xa1-\xfe]{2}|[\xa1-\xfe]{2})*",
    "GB18030": rb"(?:[\x00-\x7f]|[\x81-\xfe][\x40-\x7e\x80-\xfe]|[\x81-\xfe][\x30-\x39][\x81-\xfe][\x30-\x39])*",
    "Big5": rb"(?:[\x00-\x7f]|[\x81-\xfe][\x40-\x7e\xa1-\xfe])*",
    "EUC-KR": rb"(?:[\x00-\x7f]|[\x81-\xfe][\x41-\x5a\x61-\x7a\x81-\xfe])*",
}
_PATTERNS = {name: re.compile(p, re.S) for name, p in _STRUCTURE.items()}
_CODECS = {"UTF-8": "utf-8", "UTF-8-BOM": "utf-8-sig", "UTF-16LE": "utf-16-le", "UTF-16BE": "utf-16-be", "Shift_JIS": "shift_jis", "EUC-JP": "euc_jp", "ISO-2022-JP": "iso2022_jp", "GB18030": "gb18030", "Big5": "big5", "EUC-KR": "euc_kr"}


def detect(content: bytes | None) -> tuple[str | None, list[str]]:
    """(encoding, candidates).  Several structural matches leave the encoding undetermined with its candidates."""
    if content is None:
        return None, []
    prefix, cut = content[:PREFIX], len(content) > PREFIX
    for bom, name in _BOMS:
        if prefix.startswith(bom):
            return name, [name]
    if not prefix:
        return "UTF-8", ["UTF-8"]
    if b"\0" in prefix:
        return "binary", []
    if max(prefix) < 0x80 and any(x in prefix for x in _ISO_2022_JP):
        return "ISO-2022-JP", ["ISO-2022-JP"]
    try:
        codecs.getincrementaldecoder("utf-8")().decode(prefix, final=not cut)
        return "UTF-8", ["UTF-8"]
    except UnicodeDecodeError:
        pass
    found = [n for n, p in _PATTERNS.items() if (m := p.match(prefix)).end() == len(prefix) or (cut and len(prefix) - m.end() < 4)]
    return (found[0] if len(found) == 1 else "undetermined"), found


def decode(content: bytes, encoding: str) -> str | None:
    codec = _CODECS.get(encoding)
    if codec is None:
        return content.decode("utf-8", "replace") if encoding == "undetermined" else None
    return content.decode(codec, "replace").removeprefix("﻿")


@F.pandas_udf(StructType([StructField("encoding", StringType()), StructField("candidates", ArrayType(StringType()))]))
def _detect(s: pd.Series) -> pd.DataFrame:
    both = [detect(x) for x in s]
    return pd.DataFrame({"encoding": [a for a, _ in both], "candidates": [b for _, b in both]})


def detected(content: Column) -> Column:
    return _detect(content)
