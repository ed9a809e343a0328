"""Logical paths: parts, language by name, and flags by directories and name."""

from __future__ import annotations

from functools import reduce
from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..codes import CASED_EXTENSIONS, EXTENSIONS, FILE_NAMES, GENERATED_ENDS, LANGUAGES, TEST_DIRECTORIES, TEST_PARTS, TEST_PREFIX, VENDOR_DIRECTORIES


def file_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def parent(path: Column) -> Column:
    return F.regexp_replace(path, r"/?[^/]*$", "")


def depth(path: Column) -> Column:
    return F.when(path == "", 0).otherwise(F.size(F.split(path, "/")))


def extension(path: Column) -> Column:
    """Without the dot, in lower case; empty for a leading or trailing dot only."""
    return F.lower(F.regexp_extract(file_name(path), r"^.+\.([^.]+)$", 1))


def is_valid(path: Column) -> Column:
    return F.regexp_like(path, F.lit(r"^(?!/)(?!.*(?:^|/)\.{1,2}(?:/|$))(?!.*//)[^\x{0000}-\x{001F}\x{007F}\\]*(?<!/)$")) & (depth(path) <= 256)


def _table(values: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for x in chain.from_iterable((k, LANGUAGES.index(v)) for k, v in values.items())])


def language(path: Column) -> Column:
    """Exact name, then Kconfig.*, then the cased extensions, then the folded extension, else unknown."""
    name = file_name(path)
    raw = F.regexp_extract(name, r"^.+\.([^.]+)$", 1)
    kconfig = F.when(name.startswith("Kconfig."), LANGUAGES.index("kconfig"))
    return F.coalesce(F.try_element_at(_table(FILE_NAMES), name), kconfig, F.when(F.length(name) > 2, F.try_element_at(_table(CASED_EXTENSIONS), F.substring_index(name, ".", -1))), F.try_element_at(_table(EXTENSIONS), F.lower(raw)), F.lit(0)).cast("smallint")


def flags(path: Column) -> Column:
    """Test 4, Generated 8, Vendored 16."""
    directories = F.transform(F.split(parent(path), "/"), F.lower)
    name = F.lower(file_name(path))
    in_ = lambda names: F.arrays_overlap(directories, F.array(*map(F.lit, names)))
    any_of = lambda tests: reduce(Column.__or__, tests)
    test = in_(TEST_DIRECTORIES) | F.startswith(name, F.lit(TEST_PREFIX)) | any_of([F.contains(name, F.lit(x)) for x in TEST_PARTS])
    generated = any_of([F.endswith(name, F.lit(x)) for x in GENERATED_ENDS])
    bit = lambda c, b: F.when(c, b).otherwise(0)
    return (bit(test, 4) + bit(generated, 8) + bit(in_(VENDOR_DIRECTORIES), 16)).cast("int")
