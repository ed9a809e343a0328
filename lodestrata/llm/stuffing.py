"""Keyword-stuffed and link-list mails: bagged trees on content and link features, smoothed by host.

Each mail's own text gives a row of shares.  Weak labels come from votes on these shares, rows on which the votes
disagree or abstain train nothing.  The trees are fitted on a bounded sample, exported to SQL and applied to all
rows natively; then each page's score is drawn a little towards the spam rate of its host.

Defined cases: null, blank or wholly quoted mails have no content and are never found; a mail without a readable
host keeps its own score; if the sample holds no mail of one of the labels, the share of votes takes the trees'
place; repeated rows give their row once.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir
from . import mail, trees
from .lexicon import CLOSING_MARKS, COMMON_WORDS, SENTENCE_ENDS

#: At most about so many mails are taken to the driver to fit the trees.
SAMPLE = 4000
#: Weight of the host's rate in the smoothed score, and how many mails the prior counts as.
HOST_WEIGHT, HOST_PRIOR = 0.1, 50.0
HOST_PARTS = 16

FEATURES = ["sentences", "common", "distinct_words", "links", "tags", "separators", "prices", "top_word", "line_words", "details", "size"]

_COMMON = frozenset(w for words in COMMON_WORDS.values() for w in words.split())
#: A link, with or without its scheme, as a word of its own.
_LINK = re.compile(r"[\[(<]*(?:https?://\S+|www\.\S+|[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}(?:[/?]\S*)?[\])>]*)\Z")
_TOKEN = re.compile(r"[^\W_]+(?:['’_-][^\W_]+)*")
_KANA = re.compile(r"[぀-ゟ]")
_CJK = re.compile(r"[぀-ヿ㐀-鿿가-힯]")
_SEPARATOR = re.compile(r"[|,;/·•★☆→›»~、・]")
_PRICE = re.compile(r"[-−]?\d+(?:[.,]\d+)?\s?(?:[$€£¥%]|usd|eur|gbp|chf)|[$€£¥]\s?\d", re.I)
_ENDS = re.compile(f"[{re.escape(SENTENCE_ENDS)}][{re.escape(CLOSING_MARKS)}]*(?=\\s|\\Z)|[。！？｡]")
_DETAIL = re.compile(r"(?:[a-z-]{2,12}: \S+|[-+@]{1,3} ?.*[;(){}].*|(?:---|\+\+\+) .*|\s{2,}.*[;(){}].*)\Z")


def features(own: str) -> list[float]:
    """The shares of a mail's own text, in the order of FEATURES."""
    lines = [line for line in own.split("\n") if line]
    chars = sum(map(len, lines))
    if not chars:
        return [0.0] * len(FEATURES)
    words = own.split()
    link_words = {w for w in words if "." in w and _LINK.match(w)}
    links = sum(len(w) for w in words if w in link_words)
    plain = "\n".join(" ".join(w for w in line.split() if w not in link_words) for line in own.split("\n")) if link_words else own
    tokens = [t.lower() for t in _TOKEN.findall(plain)]
    n = max(1, len(tokens))
    pieces = plain.split()
    counts = Counter(tokens)
    cjk, kana = len(_CJK.findall(own)), len(_KANA.findall(own))
    running = 0
    for block in re.split(r"\n\s*\n", plain):
        text = " ".join(block.split())
        ends = len(_ENDS.findall(text))
        if ends and len(text) <= 260 * ends:
            running += len(text)
        elif not ends and len(mine := [t.lower() for t in _TOKEN.findall(text)]) >= 12:
            # sentences whose marks were lost: many common words, few words again and again
            if sum(t in _COMMON for t in mine) >= 0.25 * len(mine) and len(set(mine)) >= 0.6 * len(mine):
                running += len(text)
    common = sum(c for t, c in counts.items() if t in _COMMON)
    details = sum(len(line) for line in lines if _DETAIL.match(line))
    return [
        min(1.0, running / chars),
        common / n if cjk * 2 < chars else kana / max(1, cjk),
        len(counts) / n if cjk * 2 < chars or n > 40 else min(1.0, 3 * len(set(own)) / max(1, min(chars, 300))),
        min(1.0, links / chars),
        sum(p[0] in "#@+" and len(p) > 1 for p in pieces) / max(1, len(pieces)),
        len(_SEPARATOR.findall(plain)) / n,
        len(_PRICE.findall(plain)) / n,
        max(counts.values(), default=0) / n,
        n / len(lines),
        details / chars,
        float(np.log1p(chars)),
    ]


def _votes() -> tuple[str, str]:
    """Weak labels: what speaks for a list and what for sentences, each a number of votes."""
    spam = ["links > 0.4", "tags > 0.4", "separators > 0.3 AND sentences < 0.5 AND common < 0.2", "prices > 0.12", "distinct_words < 0.35 AND common < 0.3", "top_word > 0.2 AND size > 4", "line_words < 3 AND sentences < 0.2 AND details < 0.3", "sentences < 0.1 AND common < 0.12 AND details < 0.3"]
    prose = ["sentences > 0.7 AND distinct_words > 0.4", "common > 0.25 AND distinct_words > 0.4", "details > 0.3", "sentences > 0.5 AND common > 0.2 AND separators < 0.2"]
    add = lambda votes: " + ".join(f"CASE WHEN {v} THEN 1 ELSE 0 END" for v in votes)
    return add(spam), add(prose)


def _measure(df: DataFrame, id_column: str, text_column: str, sender_column: str) -> DataFrame:
    source = df.select(
        F.col(id_column).alias("__id"),
        F.col(text_column).cast("string").alias("__text"),
        F.lower(F.regexp_extract(F.col(sender_column).cast("string"), r"@([\w.-]+)", 1)).alias("host"),
    )
    id_type = source.schema["__id"].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [mail.own_text(t) if t else "" for t in batch.column(1).to_pylist()]
            rows = np.array([features(o) for o in own], dtype=np.float64).reshape(-1, len(FEATURES))
            arrays = [batch.column(0), batch.column(2), *(pa.array(rows[:, k]) for k in range(len(FEATURES)))]
            yield pa.RecordBatch.from_arrays(arrays, names=["__id", "host", *FEATURES])

    return source.mapInArrow(run, f"__id {id_type}, host string, " + ", ".join(f"{f} double" for f in FEATURES))


def scores(
    df: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    sender_column: str = "sender",
    sample: int = SAMPLE,
    host_weight: float = HOST_WEIGHT,
) -> DataFrame:
    """(id, host, page, host_rate, score): the trees' score of each mail and the smoothed one.

    The features of all rows are computed once and cut off by a checkpoint, as both the hosts' rates and the
    smoothing read them; the sample's features are computed on its few rows beforehand.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    total = max(1, df.count())
    cut = int(min(1.0, sample / total) * (1 << 30))
    chosen = df.filter(F.pmod(F.xxhash64(F.col(id_column)), F.lit(1 << 30)) < cut)
    # in an order that doesn't depend on files or tasks: the same mails give the same trees
    chosen = chosen.orderBy(F.xxhash64(F.col(id_column)), F.col(text_column)).limit(2 * sample).repartition(32)
    spam, prose = _votes()
    labelled = _measure(chosen, id_column, text_column, sender_column).filter("size > 0")
    labelled = labelled.select(*FEATURES, F.expr(spam).alias("spam"), F.expr(prose).alias("prose")).toPandas().sort_values(FEATURES)
    sure = labelled[(labelled.spam == 0) != (labelled.prose == 0)]
    x, y = sure[FEATURES].to_numpy(), (sure.spam > 0).to_numpy().astype(float)
    if len(y) and 0 < y.sum() < len(y):
        page = trees.sql(trees.bagged(x, y), FEATURES)
    else:
        page = f"CAST(({spam}) > ({prose}) AS DOUBLE)"
    pages = _measure(df, id_column, text_column, sender_column).filter("size > 0").select("__id", "host", F.expr(page).alias("page")).checkpoint()
    prior = pages.filter("host <> ''").agg(F.avg("page").alias("prior"))
    rates = pages.filter("host <> ''").groupBy("host").agg(F.sum("page").alias("s"), F.count("*").alias("n")).crossJoin(F.broadcast(prior))
    rates = rates.select("host", ((F.col("s") + HOST_PRIOR * F.col("prior")) / (F.col("n") + HOST_PRIOR)).alias("host_rate"))
    # a host may hold a third of all rows: its pages are spread over parts, and each part finds its rate
    pages = pages.withColumn("part", F.pmod(F.xxhash64("__id"), F.lit(HOST_PARTS)).cast("int"))
    rates = rates.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(HOST_PARTS - 1))))
    score = F.coalesce(F.col("page") + host_weight * (F.col("host_rate") - F.col("page")), F.col("page"))
    return pages.join(rates, ["host", "part"], "left").select(F.col("__id").alias(id_column), "host", "page", "host_rate", score.alias("score"))


def found(df: DataFrame, id_column: str = "doc_id", threshold: float = 0.5, **how) -> DataFrame:
    return scores(df, id_column, **how).filter(F.col("score") >= threshold).select(id_column).distinct()
