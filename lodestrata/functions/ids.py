"""Node ids: the first 16 bytes of a SHA-256 over kind, repository, path, qualified name and ordinal."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _u32(n: Column) -> Column:
    h = F.lpad(F.hex(n), 8, "0")
    return F.unhex(F.concat(*[F.substring(h, at, 2) for at in (7, 5, 3, 1)]))


def _sized(s: Column) -> Column:
    return F.concat(_u32(F.octet_length(s)), F.encode(s, "UTF-8"))


def node_id(kind: Column, repository: Column, path: Column, qualified: Column, ordinal: Column) -> Column:
    """32 lower-case hex digits; lengths and the ordinal are little-endian."""
    whole = F.concat(F.unhex(F.lit("02")), F.unhex(F.lpad(F.hex(kind), 2, "0")), _sized(repository), _sized(path), _sized(qualified), _u32(ordinal))
    return F.substring(F.sha2(whole, 256), 1, 32)


def parsed(text: Column) -> Column:
    """The id a text spells in either case, or null."""
    return F.when(F.regexp_like(text, F.lit("^[0-9a-fA-F]{32}$")), F.lower(text))
