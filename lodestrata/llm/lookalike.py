"""Visually identical text with different characters: one consistent form, and the rows that share it.

Inside each Arrow partition DuckDB runs one embedded SQL expression: widths and spaces are mapped with
``translate``, invisible characters removed with a regular expression, look-alike letters of other scripts and
compatibility forms mapped to Latin ones and then accents composed with ``nfc_normalize``.  Letter case, accents, raised digits and punctuation of
other shape stay apart.  Pairs are then built from classes of equal form: first the classes of equal characters,
then pairs of classes, then their members, so copies with equal characters never meet each other.

Defined cases: null texts and texts of white space or invisible characters only have no form and are no case;
repeated rows count once; a text with no character to map is its own form.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir

# Fixed values.  Full-width forms of ASCII follow their originals at a fixed distance.
_WIDE = "".join(map(chr, range(0xFF01, 0xFF5F)))
_NARROW = "".join(map(chr, range(0x21, 0x7F)))
#: Half-width katakana and marks, and their usual forms (the sound marks as combining ones).
_HALF = "｡｢｣､･ｦｧｨｩｪｫｬｭｮｯｰｱｲｳｴｵｶｷｸｹｺｻｼｽｾｿﾀﾁﾂﾃﾄﾅﾆﾇﾈﾉﾊﾋﾌﾍﾎﾏﾐﾑﾒﾓﾔﾕﾖﾗﾘﾙﾚﾛﾜﾝﾞﾟ￠￡￢￣￤￥￦"
_FULL = "。「」、・ヲァィゥェォャュョッーアイウエオカキクケコサシスセソタチツテトナニヌネノハヒフヘホマミムメモヤユヨラリルレロワン゙゚¢£¬¯¦¥₩"
#: Spaces of other widths.
_SPACES = "               　"
#: Hyphens drawn as the hyphen-minus.
_HYPHENS = "‐‑"
#: Characters without a visible mark: soft hyphen, joiners, direction marks, fillers, variation selectors.
INVISIBLE = r"[\x{00AD}\x{034F}\x{061C}\x{17B4}\x{17B5}\x{180B}-\x{180F}\x{200B}-\x{200F}\x{202A}-\x{202E}\x{2060}-\x{206F}\x{FE00}-\x{FE0F}\x{FEFF}\x{E0100}-\x{E01EF}]"
#: More of them: fillers of Hangul and tag characters.
_FILLERS = r"[\x{115F}\x{1160}\x{3164}\x{FFA0}\x{E0000}-\x{E007F}]"
#: Letters of the Cyrillic and Greek scripts drawn like Latin ones.
_LETTERS = "аеорсухѕіјһԁԛԝАВЕЅІЈКМНОРСТУХΑΒΕΖΗΙΚΜΝΟΡΤΥΧονёЁїЇό"
_LATIN = "aeopcyxsijhdqwABESIJKMHOPCTYXABEZHIKMNOPTYXovëËïÏó"
#: All letters of the Cyrillic, Greek and Armenian scripts drawn like Latin ones or digits.
_LOOK = dict(
    zip(
        "аеорсухѕіјһԁԛԝѵүӏгҽбАВЕЅІЈКМНОРСТУХԌԚԜѴҮӀЬЗ" + "αγινορσυϲϳϱΑΒΕΖΗΙΚΜΝΟΡΤΥΧϹͿϜϺ" + "ՏօՕհոսզգցյքՍԼ",
        "aeopcyxsijhdqwvylre6ABESIJKMHOPCTYXGQWVYIb3" + "ayivopoucjpABEZHIKMNOPTYXCJFM" + "SoOhnuqqgjfUL",
        strict=True,
    )
)


def _folded(c: str) -> str:
    """What a single character of another script or of a compatibility form is drawn like."""
    if 0xFF00 <= ord(c) <= 0xFFEF:
        return "".join(chr(int(x, 16)) for x in unicodedata.decomposition(c).split()[1:]) or c
    return unicodedata.normalize("NFC", "".join(_LOOK.get(x, x) for x in unicodedata.normalize("NFKD" if ord(c) >= 0x2000 else "NFD", c)))


def _rare(ranges: tuple[tuple[int, int], ...]) -> dict[str, str]:
    """Accented look-alikes, half-width Hangul and signs, ligatures, Roman numerals, mathematical letters and digits."""
    every = (chr(k) for first, last in ranges for k in range(first, last + 1))
    known = set(_LOOK) | set(_HALF) | {"ﾠ"}
    return {c: f for c in every if c not in known and (f := _folded(c)) not in (c, unicodedata.normalize("NFC", c))}


_RARE = _rare(((0x370, 0x58F), (0x1F00, 0x1FFF), (0x2160, 0x217F), (0xFB00, 0xFB06), (0xFB13, 0xFB17), (0xFF5F, 0xFF60), (0xFFA1, 0xFFDC), (0xFFE8, 0xFFEE), (0x1D400, 0x1D7FF)))
_RARE_CLASS = r"[\x{0370}-\x{058F}\x{1F00}-\x{1FFF}\x{2160}-\x{217F}\x{FB00}-\x{FB17}\x{FF5F}\x{FF60}\x{FFA1}-\x{FFDC}\x{FFE8}-\x{FFEE}\x{1D400}-\x{1D7FF}]"


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def form_sql(column: str) -> str:
    """The consistent form as an expression of DuckDB's SQL."""
    width_from, width_to = _WIDE + _HALF + _SPACES + _HYPHENS, _NARROW + _FULL + " " * len(_SPACES) + "-" * len(_HYPHENS)
    wide = f"translate({column}, {_quoted(width_from)}, {_quoted(width_to)})"
    seen = f"regexp_replace({wide}, '{INVISIBLE[:-1]}{_FILLERS[1:]}', '', 'g')"
    # letters are mapped before accents are composed, so that an accent composes with the Latin letter
    single = {c: f for c, f in _RARE.items() if len(f) == 1} | _LOOK
    mapped = f"translate(t, {_quoted(''.join(single))}, {_quoted(''.join(single.values()))})"
    for c, f in _RARE.items():
        if len(f) > 1:
            mapped = f"replace({mapped}, {_quoted(c)}, {_quoted(f)})"
    # only texts with such a character pay for the long map
    return f"list_transform([{seen}], lambda t: nfc_normalize(CASE WHEN regexp_matches(t, '{_RARE_CLASS}') THEN {mapped} ELSE t END))[1]"


def forms(df: DataFrame, id_column: str, text_column: str, memory_mb: int = 256) -> DataFrame:
    """(id, text, form) of each row; null stays null.  No shuffle."""
    source = df.select(F.col(id_column).alias("__id"), F.col(text_column).cast("string").alias("__text"))
    id_type = source.schema["__id"].dataType.simpleString()
    query = f"SELECT __id, __text, {form_sql('__text')} AS form FROM part"

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import duckdb

        con = duckdb.connect(config={"threads": 1, "memory_limit": f"{memory_mb}MB"})
        try:
            for batch in batches:
                con.register("part", pa.Table.from_batches([batch]))
                result = con.execute(query).to_arrow_table().cast(pa.schema([("__id", batch.schema.field(0).type), ("__text", pa.string()), ("form", pa.string())]))
                yield from result.combine_chunks().to_batches()
                con.unregister("part")
        finally:
            con.close()

    out = source.mapInArrow(run, f"__id {id_type}, __text string, form string")
    return out.select(F.col("__id").alias(id_column), F.col("__text").alias(text_column), "form")


#: Rows of one class that one task joins; a larger class is spread over as many tasks as it takes.
CLASS_ROWS = 50_000


def classes(tables: dict[str, tuple[DataFrame, str, str]]) -> DataFrame:
    """(src_table, id, form, body, n): rows that look like another row with other characters.

    ``form`` names what a row looks like, ``body`` its characters, ``n`` counts the rows with these characters:
    rows of one form and several bodies belong together, and copies aren't paired with each other.  tables maps a
    name to (rows, id column, text column).  Only ids and digests are shuffled.
    """
    rows = None
    for name, (df, id_column, text_column) in tables.items():
        mine = forms(df, id_column, text_column).filter(F.trim("form") != "").filter(F.regexp_like("form", F.lit(r"\S")))
        mine = mine.select(F.lit(name).alias("src_table"), F.col(id_column).cast("bigint").alias("id"), F.unhex(F.sha2("form", 256)).alias("form"), F.unhex(F.sha2(text_column, 256)).alias("body"))
        rows = mine if rows is None else rows.unionByName(mine)
    # the digests are read several times below: written once, the texts aren't folded again for each
    ensure_checkpoint_dir(rows.sparkSession)
    rows = rows.filter("id is not null").distinct().checkpoint()
    several = rows.groupBy("src_table", "form").agg(F.min("body").alias("x"), F.max("body").alias("y")).filter("x <> y").select("src_table", "form")
    # few rows look like another: what follows is small
    rows = rows.join(several, ["src_table", "form"], "left_semi")
    bodies = rows.groupBy("src_table", "form", "body").agg(F.count("*").alias("n"))
    hexed = lambda c: F.lower(F.hex(c)).alias(c)
    return rows.join(bodies, ["src_table", "form", "body"]).select("src_table", "id", hexed("form"), hexed("body"), "n")


def pairs(tables: dict[str, tuple[DataFrame, str, str]], class_rows: int = CLASS_ROWS) -> DataFrame:
    """(src_table, id_a, id_b), id_a < id_b: rows of one table that look the same but differ in characters.

    Pairs of bodies come first, then their rows; a body with more than ``class_rows`` rows is split by a hash of
    the id into parts of about that size, on both sides of the joins.
    """
    key = ["src_table", "form"]
    rows = classes(tables)
    parts = F.ceil(F.col("n") / class_rows).cast("int")
    bodies = rows.select(*key, "body", parts.alias("parts")).distinct()
    rows = rows.select(*key, "body", "id", F.pmod(F.xxhash64("id"), parts).cast("int").alias("part"))
    side = lambda x: bodies.select(*key, F.col("body").alias(f"body_{x}"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias(f"part_{x}"))
    members = lambda x: rows.select(*key, F.col("body").alias(f"body_{x}"), F.col("part").alias(f"part_{x}"), F.col("id").alias(x))
    both = side("a").join(side("b"), key).filter("body_a < body_b")
    both = both.join(members("a"), [*key, "body_a", "part_a"]).join(members("b"), [*key, "body_b", "part_b"])
    return both.filter("a <> b").select("src_table", F.least("a", "b").alias("id_a"), F.greatest("a", "b").alias("id_b")).distinct()
