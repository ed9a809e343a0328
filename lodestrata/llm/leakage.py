"""Evaluation texts leaking into a corpus: an FM-index per shard of the corpus, searched by the test phrases.

Each task reads its mails as a reader sees them, turns them into words and gathers shards of bounded size.  A
shard is written in the alphabet of the test phrases; a stretch between two words that no passage has is kept if
a phrase fits into it (a phrase can't reach beyond it, so this loses nothing).  The suffixes of the kept stretches
are sorted, the Burrows-Wheeler transform is kept as a wavelet matrix with ranks, and all phrases of ``n_words``
consecutive words of all passages are searched backwards side by side; occurrences are found by stepping back to
sampled suffix positions; those that overlap or touch merge into removal spans.

Nothing is shuffled but the spans found.  The test set is the stated query set: its phrases are broadcast in
blocks of bounded size, and every block is searched in the one index of a shard, so the corpus is read, decoded
and indexed once however many blocks there are.  Spans that meet where a long text was cut are merged at the end.

Defined cases: null, empty and unreadable mails give no row; passages with fewer than ``n_words`` words match
nothing; repeated items or documents give their rows once; a text longer than a shard is cut into shards that
overlap by ``n_words - 1`` words; extra columns are not looked at.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import mail

_WORD = re.compile(r"[^\W_]+")
SHARD_WORDS = 1_000_000
BLOCK_CHARS = 8_000_000
_SAMPLE = 16
_LAST, _END, _OTHER = 0, 1, -1


def words(text: str) -> list[str]:
    """Runs of letters and digits in lower case; quote marks, line breaks and other marks fall between them."""
    return _WORD.findall((text if text.isascii() else unicodedata.normalize("NFC", text)).lower())


class Phrases:
    """All runs of ``n_words`` words of some items' passages, as rows of symbols of one alphabet."""

    def __init__(self, items: list[tuple[int, str]], n_words: int, alphabet: dict[str, int]):
        owner: list[int] = []
        rows: list[list[int]] = []
        for item, passage in items:
            symbols = [alphabet.setdefault(w, len(alphabet) + 2) for w in words(passage or "")]
            for k in range(len(symbols) - n_words + 1):
                rows.append(symbols[k : k + n_words])
                owner.append(item)
        self.rows = np.array(rows, dtype=np.int32).reshape(-1, n_words)
        self.owner = np.array(owner, dtype=np.int64)


class FmIndex:
    """Index over a sequence of symbols that ends with its only 0."""

    def __init__(self, symbols: np.ndarray, size: int):
        n = len(symbols)
        suffixes = self._sort(symbols, size)
        bwt = symbols[suffixes - 1]
        self.first = np.concatenate([[0], np.cumsum(np.bincount(symbols, minlength=size))])
        self.levels: list[tuple[np.ndarray, int]] = []
        self.bits = max(1, (size - 1).bit_length())
        level = bwt
        for b in range(self.bits - 1, -1, -1):
            one = (level >> b) & 1 == 1
            ones = np.zeros(n + 1, dtype=np.int32)
            np.cumsum(one, out=ones[1:])
            self.levels.append((ones, n - int(ones[-1])))
            level = np.concatenate([level[~one], level[one]])
        self.bwt = bwt
        sampled = suffixes % _SAMPLE == 0
        self.sampled = sampled
        self.sample_rank = np.cumsum(sampled) - 1
        self.samples = suffixes[sampled]

    @staticmethod
    def _sort(symbols: np.ndarray, size: int) -> np.ndarray:
        """All suffixes in order: prefixes are doubled, and only those still alike are sorted again."""
        n, bits = len(symbols), max(1, size.bit_length())
        done = max(1, 62 // bits)
        padded = np.concatenate([symbols + 1, np.zeros(done, dtype=np.int64)])
        key = np.zeros(n, dtype=np.int64)
        for k in range(done):
            key = (key << bits) | padded[k : k + n]
        order = np.argsort(key, kind="stable")
        key = key[order]
        new = np.concatenate([[True], key[1:] != key[:-1]])
        rank = np.empty(n, dtype=np.int64)
        start = np.flatnonzero(new)
        group = np.cumsum(new) - 1
        rank[order] = start[group]
        # rows of groups with more than one suffix
        alike = np.flatnonzero(np.diff(np.append(start, n))[group] > 1)
        while len(alike):
            at = order[alike]
            later = np.where(at + done < n, rank[np.minimum(at + done, n - 1)] + 1, 0)
            base = rank[at]
            by = np.lexsort((later, base))
            at, later, base = at[by], later[by], base[by]
            order[alike] = at
            new = np.concatenate([[True], (base[1:] != base[:-1]) | (later[1:] != later[:-1])])
            start = np.flatnonzero(new)
            group = np.cumsum(new) - 1
            rank[at] = alike[start][group]
            alike = alike[np.diff(np.append(start, len(alike)))[group] > 1]
            done *= 2
        return order

    def rank(self, symbol: np.ndarray, upto: np.ndarray) -> np.ndarray:
        """How often each symbol stands in the transform before each position."""
        lo, hi = np.zeros_like(upto), upto
        for k, (ones, zeros) in enumerate(self.levels):
            one = (symbol >> (self.bits - 1 - k)) & 1 == 1
            a, b = ones[lo], ones[hi]
            lo, hi = np.where(one, zeros + a, lo - a), np.where(one, zeros + b, hi - b)
        return hi - lo

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The interval of suffixes that begin with each phrase."""
        lo = np.zeros(len(phrases), dtype=np.int64)
        hi = np.full(len(phrases), len(self.bwt), dtype=np.int64)
        live = np.arange(len(phrases))
        for k in range(phrases.shape[1] - 1, -1, -1):
            s = phrases[live, k]
            lo[live] = self.first[s] + self.rank(s, lo[live])
            hi[live] = self.first[s] + self.rank(s, hi[live])
            live = live[hi[live] > lo[live]]
        hi = np.maximum(lo, hi)
        return lo, hi

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Positions of suffixes, by stepping back to a sampled one."""
        at, steps = rows.copy(), np.zeros(len(rows), dtype=np.int64)
        open_ = np.flatnonzero(~self.sampled[at])
        while len(open_):
            s = self.bwt[at[open_]]
            at[open_] = self.first[s] + self.rank(s, at[open_])
            steps[open_] += 1
            open_ = open_[~self.sampled[at[open_]]]
        return self.samples[self.sample_rank[at]] + steps


class Shard:
    """Gathers the words of documents and finds the phrases in them."""

    def __init__(self, alphabet: dict[str, int], n_words: int):
        self.alphabet, self.n_words = alphabet, n_words
        self.symbols: list[int] = []
        self.keys: list = []
        self.starts: list[int] = []
        self.offsets: list[int] = []

    def add(self, key, document: list[str], offset: int) -> None:
        get = self.alphabet.get
        self.keys.append(key)
        self.starts.append(len(self.symbols))
        self.offsets.append(offset)
        self.symbols.extend([get(w, _OTHER) for w in document])
        self.symbols.append(_OTHER)

    def find(self, blocks: Iterable[Phrases]) -> Iterator[tuple]:
        """(key, item, first word, word after the last), each span as long as it gets."""
        n_words = self.n_words
        symbols = np.array(self.symbols, dtype=np.int64)
        inside = np.concatenate([[False], symbols != _OTHER, [False]])
        edge = np.flatnonzero(inside[1:] != inside[:-1])
        begin, end = edge[::2], edge[1::2]
        fits = end - begin >= n_words
        begin, end = begin[fits], end[fits]
        if not len(begin):
            return
        # the kept stretches one after the other, each with the place after it, which becomes an end mark
        size = end - begin + 1
        upto = np.cumsum(size)
        place = np.arange(int(upto[-1])) + np.repeat(begin - (upto - size), size)
        kept = np.where(symbols[place] == _OTHER, _END, symbols[place])
        index = FmIndex(np.append(kept, _LAST), len(self.alphabet) + 2)
        starts = np.array(self.starts)
        found: set[tuple[int, int, int]] = set()
        for phrases in blocks:
            lo, hi = index.search(phrases.rows)
            count = hi - lo
            which = np.repeat(np.arange(len(lo)), count)
            rows = np.arange(len(which)) + np.repeat(lo - (np.cumsum(count) - count), count)
            at = place[index.locate(rows)]
            document = np.searchsorted(starts, at, side="right") - 1
            found.update(zip(document.tolist(), phrases.owner[which].tolist(), at.tolist(), strict=True))
        d0 = i0 = None
        first = last = 0
        for d, item, a in sorted(found):
            a += self.offsets[d] - self.starts[d]
            if d == d0 and item == i0 and a <= last:
                last = a + n_words
                continue
            if d0 is not None:
                yield self.keys[d0], i0, first, last
            d0, i0, first, last = d, item, a, a + n_words
        if d0 is not None:
            yield self.keys[d0], i0, first, last


def _blocks(items: DataFrame, id_column: str, passage_column: str, most: int) -> Iterator[list[tuple[int, str]]]:
    """The test items in blocks of at most ``most`` characters (a single longer passage is a block of its own)."""
    block: list[tuple[int, str]] = []
    size = 0
    rows = items.select(id_column, passage_column).filter(F.col(passage_column).isNotNull() & F.col(id_column).isNotNull()).distinct().orderBy(id_column, passage_column)
    for item, passage in rows.toLocalIterator():
        if block and size + len(passage) > most:
            yield block
            block, size = [], 0
        block.append((item, passage))
        size += len(passage)
    if block:
        yield block


def _search(alphabet, blocks: list, n_words: int, shard_words: int, id_column: str, item_column: str):
    """alphabet and the Phrases of each block are broadcast variables."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        overlap = n_words - 1
        shard = Shard(alphabet.value, n_words)
        for batch in batches:
            kind = batch.schema.field(0).type

            def out(shard: Shard, kind=kind) -> pa.RecordBatch:
                found = list(shard.find(b.value for b in blocks))
                columns = zip(*found, strict=True) if found else ([], [], [], [])
                arrays = [pa.array(list(c), t) for c, t in zip(columns, (kind, pa.int64(), pa.int64(), pa.int64()), strict=True)]
                return pa.RecordBatch.from_arrays(arrays, names=[id_column, item_column, "first_word", "end_word"])

            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                offset = 0
                for part in mail.parts(text):
                    document = words(mail.visible(part))
                    for k in range(0, max(1, len(document) - overlap), shard_words):
                        shard.add(key, document[k : k + shard_words + overlap], offset + k)
                        if len(shard.symbols) >= shard_words:
                            yield out(shard)
                            shard = Shard(alphabet.value, n_words)
                    offset += len(document) + 1
        if shard.keys:
            yield out(shard)

    return run


#: Spans from left to right, those that overlap or touch become one.
_MERGED = """aggregate(array_sort(spans), cast(array() as array<struct<first_word:bigint,end_word:bigint>>), (a, x) ->
    CASE WHEN size(a) > 0 AND element_at(a, -1).end_word >= x.first_word
    THEN concat(slice(a, 1, size(a) - 1), array(named_struct('first_word', element_at(a, -1).first_word, 'end_word', greatest(element_at(a, -1).end_word, x.end_word))))
    ELSE concat(a, array(x)) END)"""


def leaks(
    documents: DataFrame,
    items: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    item_column: str = "item_id",
    passage_column: str = "passage",
    n_words: int = 12,
    shard_words: int = SHARD_WORDS,
    block_chars: int = BLOCK_CHARS,
) -> DataFrame:
    """(doc, item, first_word, end_word): the spans of each mail that hold ``n_words`` or more words of a passage.

    Word positions count through the text parts of the mail; the end of a part counts as one.
    """
    source = documents.select(F.col(id_column).alias("__id"), F.col(text_column).cast("string").alias("__text")).filter("__text is not null")
    id_type = source.schema["__id"].dataType.simpleString()
    schema = f"{id_column} {id_type}, {item_column} bigint, first_word bigint, end_word bigint"
    context = documents.sparkSession.sparkContext
    alphabet: dict[str, int] = {}
    blocks = [context.broadcast(Phrases(block, n_words, alphabet)) for block in _blocks(items, item_column, passage_column, block_chars)]
    if not alphabet:
        return documents.sparkSession.createDataFrame([], schema)
    run = _search(context.broadcast(alphabet), blocks, n_words, shard_words, id_column, item_column)
    # a task's spans of one mail and item are few: those of one text don't overlap
    found = source.mapInArrow(run, schema).groupBy(id_column, item_column).agg(F.collect_set(F.struct("first_word", "end_word")).alias("spans"))
    return found.select(id_column, item_column, F.inline(F.expr(_MERGED)))
