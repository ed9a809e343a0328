"""Encoding a corpus with a public byte-level BPE vocabulary.

Every piece of text is merged with a segment tree over its adjacent pair ranks.  A leaf holds
``rank * width + position`` of the pair that begins there, so the root yields the leftmost pair of the lowest
rank; a merge changes three leaves and walks their paths to the root, until no mergeable pair is left.  The
trees of all new pieces of a batch with the same width are worked on side by side in numpy; a piece too wide for
that has a tree of its own.

Text is first cut at white space into chunks (each an optional space and its word), which no piece of the
vocabulary's own pattern crosses; the ids of a chunk seen before come from a bounded per-worker memory.

Defined cases: null and empty text give an empty list; a lone surrogate can't occur in Spark strings; the strings
of special tokens are ordinary text.  Rows are independent: repeated ids or texts give repeated rows.
"""

from __future__ import annotations

import base64
import os
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed value: the pattern that cuts text into pieces before any merge (published with the vocabulary).
PIECES = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
TOKENIZERS = os.environ.get("TOKENIZERS_DIR", "/opt/tokenizers")
VOCABULARY = "byte_bpe_50k.tiktoken"

#: The same for a chunk of ASCII.
_ASCII_PIECES = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z]+| ?[0-9]+| ?[^ \t\n\r\f\vA-Za-z0-9]+|[ \t\n\r\f\v]+").findall
_CHUNKS = re.compile(r" ?\S+|\s+(?!\S)|\s+")
#: Python's re counts these as white space, the vocabulary's pattern does not.
_SEPARATORS = ("\x1c", "\x1d", "\x1e", "\x1f")
_NONE = np.int32(2**31 - 1)
_WIDEST = 128
_CELLS = 1 << 21
_MEMORY = 400_000


def spans(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The positions start, start+1, ... of each span, one span after the other."""
    ends = np.cumsum(count)
    return np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(start - (ends - count), count)


class BytePairs:
    """A rank file with a hash table of its mergeable pairs."""

    def __init__(self, path: str):
        import regex

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self.ranks = ranks
        self.pattern = regex.compile(PIECES)
        self.byte = np.array([ranks[bytes([b])] for b in range(256)], dtype=np.int32)
        keys, values = [], []
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                a, b = ranks.get(token[:cut]), ranks.get(token[cut:])
                if a is not None and b is not None:
                    keys.append((a << 20) | b)
                    values.append(rank)
        self.pairs = dict(zip(keys, values, strict=True))
        self._index(np.array(keys, dtype=np.int64), np.array(values, dtype=np.int32))

    def _index(self, keys: np.ndarray, values: np.ndarray) -> None:
        """Open addressing with linear probing, filled round by round."""
        self.bits = max(10, int(len(keys) * 4).bit_length())
        size = 1 << self.bits
        self.slot_key, self.slot_rank = np.full(size, -1, dtype=np.int64), np.full(size, _NONE, dtype=np.int32)
        at, left, self.probes = self._hash(keys), np.arange(len(keys)), 0
        while len(left):
            self.probes += 1
            free = self.slot_key[at] == -1
            slot, first = np.unique(at[free], return_index=True)
            chosen = left[free][first]
            self.slot_key[slot], self.slot_rank[slot] = keys[chosen], values[chosen]
            rest = np.ones(len(left), dtype=bool)
            rest[np.flatnonzero(free)[first]] = False
            left, at = left[rest], (at[rest] + 1) & (size - 1)

    def _hash(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of each pair, or the largest int32."""
        key = (a.astype(np.int64) << 20) | b
        at = self._hash(key)
        found = self.slot_key[at]
        out = np.where(found == key, self.slot_rank[at], _NONE)
        open_ = np.flatnonzero((found != key) & (found != -1))
        while len(open_):
            at[open_] = (at[open_] + 1) & ((1 << self.bits) - 1)
            found = self.slot_key[at[open_]]
            hit = found == key[open_]
            out[open_[hit]] = self.slot_rank[at[open_[hit]]]
            open_ = open_[~hit & (found != -1)]
        return out

    def encode_pieces(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all pieces one after the other, and how many each has."""
        n = len(pieces)
        whole = np.fromiter((self.ranks.get(p, -1) for p in pieces), dtype=np.int32, count=n)
        count = np.ones(n, dtype=np.int64)
        done: list[tuple[np.ndarray, np.ndarray]] = [(np.flatnonzero(whole >= 0), whole[whole >= 0])]
        rest = np.flatnonzero(whole < 0)
        size = np.fromiter((len(pieces[i]) for i in rest), dtype=np.int64, count=len(rest))
        for i in rest[size > _WIDEST]:
            ids = self._one(pieces[i])
            count[i] = len(ids)
            done.append((np.array([i]), ids))
        width = 2
        while width <= _WIDEST:
            mine = rest[(size <= width) & ((size > width // 2) | (width == 2))]
            step = max(1, _CELLS // (width * 4))
            for k in range(0, len(mine), step):
                part = mine[k : k + step]
                ids, counts = self._many([pieces[i] for i in part], width)
                count[part] = counts
                done.append((part, ids))
            width *= 2
        flat = np.empty(int(count.sum()), dtype=np.int32)
        start = np.cumsum(count) - count
        for which, ids in done:
            flat[spans(start[which], count[which])] = ids
        return flat, count

    def _many(self, pieces: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
        n = len(pieces)
        raw = np.frombuffer(b"".join(p.ljust(width, b"\0") for p in pieces), dtype=np.uint8).reshape(n, width)
        size = np.fromiter(map(len, pieces), dtype=np.int64, count=n)
        symbol = self.byte[raw]
        live = np.arange(width)[None, :] < size[:, None]
        after = np.broadcast_to(np.arange(1, width + 1, dtype=np.int32), (n, width)).copy()
        before = np.broadcast_to(np.arange(-1, width - 1, dtype=np.int32), (n, width)).copy()
        tree = np.full((n, 2 * width), _NONE, dtype=np.int32)
        pair = self.rank(symbol[:, :-1].ravel(), symbol[:, 1:].ravel()).reshape(n, width - 1)
        place = np.arange(width, dtype=np.int32)
        can = (pair != _NONE) & live[:, 1:]
        tree[:, width : 2 * width - 1] = np.where(can, np.where(can, pair, 0) * width + place[None, :-1], _NONE)
        at = width
        while at > 1:
            tree[:, at // 2 : at] = np.minimum(tree[:, at : 2 * at : 2], tree[:, at + 1 : 2 * at : 2])
            at //= 2
        rows = np.flatnonzero(tree[:, 1] != _NONE)
        while len(rows):
            root = tree[rows, 1]
            p = root % width
            q = after[rows, p]
            merged = root // width
            symbol[rows, p] = merged
            live[rows, q] = False
            nxt = after[rows, q]
            after[rows, p] = nxt
            inside = nxt < size[rows]
            safe = np.where(inside, nxt, 0)
            before[rows[inside], nxt[inside]] = p[inside]
            self._put(tree, rows, q, np.full(len(rows), _NONE, dtype=np.int32), width)
            r = self.rank(merged, symbol[rows, safe])
            self._put(tree, rows, p, np.where(inside & (r != _NONE), np.where(r != _NONE, r, 0) * width + p, _NONE), width)
            prev = before[rows, p]
            with_prev = prev >= 0
            rr, pp = rows[with_prev], prev[with_prev]
            r = self.rank(symbol[rr, pp], merged[with_prev])
            self._put(tree, rr, pp, np.where(r != _NONE, np.where(r != _NONE, r, 0) * width + pp, _NONE), width)
            rows = rows[tree[rows, 1] != _NONE]
        return symbol[live], live.sum(axis=1)

    @staticmethod
    def _put(tree: np.ndarray, rows: np.ndarray, position: np.ndarray, value: np.ndarray, width: int) -> None:
        """Set a leaf of each row and renew the path above it."""
        at = position.astype(np.int64) + width
        tree[rows, at] = value
        while width > 1:
            at >>= 1
            tree[rows, at] = np.minimum(tree[rows, 2 * at], tree[rows, 2 * at + 1])
            width >>= 1

    def _one(self, piece: bytes) -> np.ndarray:
        n = len(piece)
        width = 1 << (n - 1).bit_length()
        none = 1 << 62
        symbol: list[int] = self.byte[np.frombuffer(piece, dtype=np.uint8)].tolist()
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        get = self.pairs.get
        tree = [none] * (2 * width)
        for i in range(n - 1):
            r = get((symbol[i] << 20) | symbol[i + 1])
            if r is not None:
                tree[width + i] = r * width + i
        for at in range(width - 1, 0, -1):
            a, b = tree[2 * at], tree[2 * at + 1]
            tree[at] = a if a < b else b

        def put(position: int, value: int) -> None:
            at = position + width
            tree[at] = value
            at >>= 1
            while at:
                a, b = tree[2 * at], tree[2 * at + 1]
                low = a if a < b else b
                if tree[at] == low:
                    break
                tree[at] = low
                at >>= 1

        dead = bytearray(n)
        while tree[1] != none:
            rank, p = divmod(tree[1], width)
            q = after[p]
            symbol[p] = rank
            dead[q] = 1
            nxt = after[q]
            after[p] = nxt
            put(q, none)
            r = None
            if nxt < n:
                before[nxt] = p
                r = get((rank << 20) | symbol[nxt])
            put(p, none if r is None else r * width + p)
            prev = before[p]
            if prev >= 0:
                r = get((symbol[prev] << 20) | rank)
                put(prev, none if r is None else r * width + prev)
        return np.array([s for s, d in zip(symbol, dead, strict=True) if not d], dtype=np.int32)


@lru_cache(maxsize=4)
def load(path: str) -> BytePairs:
    return BytePairs(path)


class Encoder:
    """Texts to one flat array of ids and the number of ids of each text."""

    def __init__(self, path: str):
        self.bpe = load(path)
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.starts, self.counts, self.pool = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int32)]
        self.size = 0

    def _learn(self, chunks: list[str]) -> None:
        cut = [_ASCII_PIECES(c) if c.isascii() else self.bpe.pattern.findall(c) for c in chunks]
        number = {p: i for i, p in enumerate(dict.fromkeys(chain.from_iterable(cut)))}
        flat, count = self.bpe.encode_pieces([p.encode() for p in number])
        start = np.cumsum(count) - count
        pieces = np.fromiter(map(len, cut), dtype=np.int64, count=len(cut))
        which = np.fromiter(map(number.__getitem__, chain.from_iterable(cut)), dtype=np.int64, count=int(pieces.sum()))
        ids = flat[spans(start[which], count[which])]
        upto = np.concatenate([[0], np.cumsum(count[which])])[np.cumsum(pieces)]
        counts = np.diff(upto, prepend=0)
        at = len(self.known)
        self.known.update(zip(chunks, range(at, at + len(chunks)), strict=True))
        self.starts.append(self.size + upto - counts)
        self.counts.append(counts)
        self.pool.append(ids)
        self.size += len(ids)

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        if len(self.known) > _MEMORY:
            self.forget()
        find, fine = _CHUNKS.findall, self.bpe.pattern.findall
        cut = [[] if not t else fine(t) if any(c in t for c in _SEPARATORS) else find(t) for t in texts]
        new = [c for c in dict.fromkeys(chain.from_iterable(cut)) if c not in self.known]
        if new:
            self._learn(new)
        if len(self.pool) > 1:
            self.pool, self.starts, self.counts = [np.concatenate(self.pool)], [np.concatenate(self.starts)], [np.concatenate(self.counts)]
        chunks = np.fromiter(map(len, cut), dtype=np.int64, count=len(cut))
        which = np.fromiter(map(self.known.__getitem__, chain.from_iterable(cut)), dtype=np.int64, count=int(chunks.sum()))
        count = self.counts[0][which]
        flat = self.pool[0][spans(self.starts[0][which], count)]
        upto = np.concatenate([[0], np.cumsum(count)])[np.cumsum(chunks)]
        return flat, np.diff(upto, prepend=0)


def encode(df: DataFrame, id_column: str, text_column: str, vocabulary: str = VOCABULARY, folder: str = TOKENIZERS) -> DataFrame:
    """(id, ids): the token ids of each row's whole text.  No shuffle; one read of the two columns."""
    path = os.path.join(folder, vocabulary)
    source = df.select(F.col(id_column).alias("__id"), F.col(text_column).cast("string").alias("__text"))
    id_type = source.schema["__id"].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(path)
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                part = batch.slice(at, 2000)
                flat, counts = encoder.encode(part.column(1).to_pylist())
                offsets = pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32))
                ids = pa.ListArray.from_arrays(offsets, pa.array(flat, type=pa.int32()))
                yield pa.RecordBatch.from_arrays([part.column(0), ids], names=[id_column, "ids"])

    return source.mapInArrow(run, f"{id_column} {id_type}, ids array<int>")
