"""Sentence boundaries across languages and scripts, in SQL expressions only.

A copy of the text is masked character by character, so its positions stay those of the text: marks inside
numbers, links, initials, abbreviations, quotations and brackets become a private-use character.  Then a second
private-use character is put where a sentence ends, by one pattern for each way of ending, and the copy is split
there.  The sentence itself is cut from the unmasked text by its offsets.

Defined cases: null and blank texts have no sentence; a text that holds the two private-use characters itself is
split as if they were letters; several rows with equal keys and texts give their sentences once; offsets count
code points, the end is exclusive, surrounding white space is outside.  A quotation or bracket of any length
counts as one if it is opened and closed in one paragraph; unpaired signs hold nothing back.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HELD, END = "", ""

_S = r"[\s\p{Z}]"
_MARKS = ".!?…。！？．｡؟۔।॥።"
#: What may follow a mark and still belongs to the sentence: quotes, brackets, emphasis, invisible characters.
_CLOSING = r"[\"'”’»›“」』）】〕〉》)\]}＂＇*_~`\x{00AD}\x{200B}-\x{200D}\x{2060}\x{FEFF}]"

# Abbreviations, in the order of the languages en, de, fr, es, ru, ar, hi, am.
_TITLES = "Mr Mrs Ms Mx Dr Prof Rev Gen Col Sgt Capt Lt Hon St Messrs Hr Fr Frl Dipl Ing M MM Mme Mlle Me Mgr Sr Sra Srta Dra Ud Uds Dn Dña г-н г-жа им ул д د أ م डॉ श्री ዶ ወ"
_INNER = "vs cf e.g i.e eg ie viz al approx dept est vgl bzw ca sog evtl ggf inkl bspw zzgl env ap av núm aprox ср см напр т.е т.к"
_BEFORE_NUMBER = "no nos nr nrn fig figs abb tab p pp s sec sect ch chap vol art § pág págs cap núm n c h ч стр с рис гл п ст jan feb mar apr jun jul aug sep sept oct nov dec janv févr avr juil déc ene abr ago dic"
_GERMAN_MONTHS = "Januar Jänner Februar März April Mai Juni Juli August September Oktober November Dezember"
_QUOTING = "하고 라고 이라고 라며 라는"


def _any(words: str) -> str:
    return "(?:" + "|".join(w.replace(".", r"\.") for w in sorted(words.split(), key=lambda w: (-len(w), w))) + ")"


def _hold(text: Column, pattern: str) -> Column:
    """Mask the one mark that each match of the pattern is."""
    return F.regexp_replace(text, pattern, HELD)


def _quoted(paragraph: Column) -> Column:
    """Mask the marks between a quote and its closing one, but for those right before the closing one."""
    pieces = F.split(paragraph, '"', -1)

    def inside(piece: Column, i: Column) -> Column:
        tail = F.regexp_extract(piece, f"[{_MARKS}]*\\z", 0)
        head = F.substring(piece, F.lit(1), F.length(piece) - F.length(tail))
        return F.when((i % 2 == 1) & (i < F.size(pieces) - 1), F.concat(F.translate(head, _MARKS, HELD * len(_MARKS)), tail)).otherwise(piece)

    return F.array_join(F.transform(pieces, inside), '"')


def _let(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value), the value worked out once."""
    return F.get(F.transform(F.array(value), then), 0)


def _bracketed(opening: str, closing: str) -> Callable[[Column], Column]:
    """Mask the marks in brackets that are opened and closed, but for those right before the outermost closing one."""
    return lambda p: F.when(F.contains(p, F.lit(opening)) & F.contains(p, F.lit(closing)), _in_pairs(p, opening, closing)).otherwise(p)


def _in_pairs(paragraph: Column, opening: str, closing: str) -> Column:
    """Pieces begin with a bracket.  One lies inside if the depth after its bracket is undercut later."""

    def depth_after(so_far: Column, piece: Column) -> Column:
        step = F.when(F.startswith(piece, F.lit(opening)), 1).when(F.startswith(piece, F.lit(closing)), -1).otherwise(0)
        return F.concat(so_far, F.array(F.greatest(F.coalesce(F.get(so_far, F.size(so_far) - 1), F.lit(0)) + step, F.lit(0))))

    def least_later(so_far: Column, depth: Column) -> Column:
        return F.concat(so_far, F.array(F.least(F.get(so_far, F.size(so_far) - 1), depth)))

    def held(pieces: Column, inside: Column) -> Column:
        def one(piece: Column, i: Column) -> Column:
            tail = F.when(F.coalesce(F.get(inside, i + 1), F.lit(False)), F.lit("")).otherwise(F.regexp_extract(piece, f"[{_MARKS}]*\\z", 0))
            return F.when(F.get(inside, i), _let(tail, lambda t: F.concat(F.translate(F.substring(piece, F.lit(1), F.length(piece) - F.length(t)), _MARKS, HELD * len(_MARKS)), t))).otherwise(piece)

        return F.array_join(F.transform(pieces, one), "")

    def by_depth(pieces: Column, depths: Column) -> Column:
        later = F.aggregate(F.reverse(depths), F.array(F.lit(2**31 - 1)), least_later)
        return _let(later, lambda low: _let(F.transform(depths, lambda d, i: F.get(low, F.size(depths) - 1 - i) < d), lambda inside: held(pieces, inside)))

    pieces = F.split(paragraph, f"(?=[\\{opening}\\{closing}])", -1)
    return _let(pieces, lambda p: _let(F.aggregate(p, F.expr("cast(array() as array<int>)"), depth_after), lambda d: by_depth(p, d)))


def masked(df: DataFrame, text: Column, name: str) -> DataFrame:
    """The copy in which every mark that ends no sentence is held back, as a column; as long as the text."""
    t = F.translate(text, HELD + END, "xx")
    # each pattern begins with the mark, so what stands before is looked at only where a mark stands
    t = _hold(t, r"[.．](?<=\d[.．])(?=\d)")
    t = _hold(t, r"[.!?](?<=(?:://|www\.)[^\s<>\"]{0,300})(?=[^\s<>\"'）)\]。、])")
    t = _hold(t, r"\.(?<=(?<![\p{L}\p{N}])" + _any(_TITLES) + r"\.)")
    t = _hold(t, r"(?i)\.(?<=(?<![\p{L}\p{N}])" + _any(_INNER) + r"\.)")
    t = _hold(t, r"(?i)\.(?=" + _S + r"*\d)(?<=(?<![\p{L}\p{N}])" + _any(_BEFORE_NUMBER) + r"\.)")
    t = _hold(t, r"\.(?<=\d\.)(?=" + _S + r"+(?:\d|" + _any(_GERMAN_MONTHS) + r"))")
    t = _hold(t, r"\.(?<=(?<![\p{L}\p{N}])[zdusmioavтpa]\.)(?=" + _S + r"?[BhaUÄOÖmeкMе]\b\.)")
    t = _hold(t, r"\.(?<=(?:(?<![\p{L}\p{N}])z\x{E000}" + _S + r"?B|(?<![\p{L}\p{N}])d\x{E000}" + _S + r"?h|(?<![\p{L}\p{N}])u\x{E000}" + _S + r"?a)\.)")
    t = _hold(t, r"\.(?<=(?<![\p{L}\p{N}.])\p{Lu}\.)(?=" + _S + r"?\p{Lu})")
    # typographic double quotes are read as the plain one, paragraph by paragraph
    plain = F.translate(t, "„“”«»＂", '""""""')
    paragraphs = F.split(F.regexp_replace(plain, r"(\n[ \t]*(?=\n))", "$1" + END), END, -1)
    df = df.withColumn(name, paragraphs)
    # one kind of bracket after the other, as columns: nested in one expression they are too deep to be analysed
    for opening, closing in ("「」", "『』", "（）", "()", "[]", "【】", "《》"):
        df = df.withColumn(name, F.transform(name, _bracketed(opening, closing)))
    return df.withColumn(name, F.array_join(F.transform(name, _quoted), ""))


def marked(t: Column) -> Column:
    """The masked copy t with a sign at each end of a sentence."""
    here = "$1" + END
    # a blank line
    t = F.regexp_replace(t, r"(\n[ \t]*(?=\n))", here)
    # marks of scripts that have no case, wherever they stand
    t = F.regexp_replace(t, r"([।॥።؟۔]+" + _CLOSING + r"*)(?=[^\x{E001}])", here)
    t = F.regexp_replace(t, r"([。！？｡]+[*_~`]*)(?![。！？｡*_~`]|" + _CLOSING + r"|[、，,])", here)
    t = F.regexp_replace(t, r"([。｡][\"'”’」』）】〕》)\]]+)(?![\"'”’」』）】〕》)\]、，,。]|と|って|など|という)", here)
    t = F.regexp_replace(t, r"([！？]+[）】)\]]+)(?![\"'”’」』）】〕》)\]、，,。]|と|って)", here)
    t = F.regexp_replace(t, r"([！？]+[\"'”’」』]+)(?=[\s\p{Z}])", here)
    t = F.regexp_replace(t, r"(?=[!?])(?<=[\x{3040}-\x{30FF}\x{4E00}-\x{9FFF}])([!?]+)(?=[\p{L}\p{N}「『（(])", here)
    # marks of scripts with case need a gap and no small letter after it
    t = F.regexp_replace(t, r"([.!?…．！？]+" + _CLOSING + r"*)(?=" + _S + r"+(?!" + _S + r"|(?:" + "|".join(_QUOTING.split()) + r")\b)(?:[^\p{Ll}]|[a-z]\p{Lu}))", here)
    t = F.regexp_replace(t, r"(?=[.!?])(?<=[\x{AC00}-\x{D7A3}])([.!?]+)(?=" + _S + r"+\p{Ll})", here)
    t = F.regexp_replace(t, r"(?=[.!?])(?<=\p{Ll}{2}|\d|\.m)([.!?]+)(?=\p{Lu}(?:\p{Ll}| \p{Ll}))", here)
    # in Thai a space
    return F.regexp_replace(t, r"(?= )(?:(?<=[\x{0E00}-\x{0E7F}])|(?<=[^ \x{E001}])(?= +[\x{0E00}-\x{0E7F}]))", END)


_BLOCK = 256


def _sums(sizes: str, first: str) -> str:
    """Running sums of an array, beginning with ``first``: where each piece begins."""
    return f"slice(aggregate({sizes}, array({first}), (a, x) -> array_append(a, element_at(a, -1) + x)), 1, size({sizes}))"


def _cut(df: DataFrame, keys: list[str], text_column: str, with_text: bool) -> DataFrame:
    """One row for each piece of a text: its keys, its place and what is blank around it; with its text if asked.

    Everything is worked out in the text's own row, without a shuffle of texts or pieces.  Pieces are counted in
    blocks, so that neither the sums nor the cutting of a very long text grows with the square of its length.
    """
    rows = df.select(*keys, F.col(text_column).cast("string").alias("__text")).filter(F.regexp_like("__text", F.lit(r"[^\s\p{Z}]")))
    rows = masked(rows, F.col("__text"), "__masked")
    rows = rows.withColumn("__pieces", F.split(marked(F.col("__masked")), END, -1))
    measured = F.transform("__pieces", lambda x: F.struct(F.length(x).cast("bigint").alias("size"), F.length(F.regexp_extract(x, r"\A[\s\p{Z}]*", 0)).alias("before"), F.length(F.regexp_extract(x, r"[\s\p{Z}]*\z", 0)).alias("after")))
    rows = rows.withColumn("__pieces", measured)
    blocks = f"transform(sequence(1, size(__pieces), {_BLOCK}), k -> slice(__pieces, k, {_BLOCK}))"
    rows = rows.withColumn("__blocks", F.expr(blocks))
    sizes = "transform(__blocks, b -> aggregate(b, 0L, (a, x) -> a + x.size))"
    rows = rows.withColumn("__sizes", F.expr(sizes)).withColumn("__starts", F.expr(_sums("__sizes", "0L")))
    block = "transform(__blocks, (b, k) -> named_struct('pieces', b, 'start', __starts[k]" + (", 'text', substring(__text, int(__starts[k]) + 1, int(__sizes[k]))" if with_text else "") + "))"
    rows = rows.select(*keys, F.explode(F.expr(block)).alias("__block")).select(*keys, "__block.*")
    rows = rows.withColumn("starts", F.expr(_sums("transform(pieces, x -> x.size)", "0L")))
    said = ", 'sentence', substring(text, int(starts[k]) + x.before + 1, int(x.size) - x.before - x.after)" if with_text else ""
    spans = f"transform(pieces, (x, k) -> named_struct('start_pos', start + starts[k] + x.before, 'end_pos', start + starts[k] + x.size - x.after{said}))"
    return rows.select(*keys, F.inline(F.expr(f"filter({spans}, x -> x.end_pos > x.start_pos)")))


def spans(df: DataFrame, keys: list[str], text_column: str) -> DataFrame:
    """(keys, start_pos, end_pos) of each sentence of each row, once."""
    return _cut(df, keys, text_column, False).distinct()


def sentences(df: DataFrame, keys: list[str], text_column: str) -> DataFrame:
    """The sentences themselves beside their offsets, cut from the text as it stands; a row that came again gives them again."""
    return _cut(df, keys, text_column, True)
