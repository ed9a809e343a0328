"""Both tiers of one file merged: order, parents, ordinals, notes explained, limits."""

from __future__ import annotations

from collections import Counter
from typing import NamedTuple

from ..codes import EDGE_KINDS, NODE_KINDS
from . import lines, syntax
from .syntax import Reference, Symbol

_KIND = {k: i for i, k in enumerate(NODE_KINDS, 1)}
_EDGE = {k: i for i, k in enumerate(EDGE_KINDS, 1)}
GENERATED = 8
MOST_BYTES = 8 << 20


class Extracted(NamedTuple):
    tier: int
    reason: str | None
    flags: int
    symbols: list[Symbol]
    ordinals: list[int]
    references: list[Reference]


def _utf16(text: str) -> bytes:
    return text.encode("utf-16-be", "surrogatepass")


def file(text: str, language: str, path: str, flags: int = 0, tier: int = 2, seconds: float = 5.0) -> Extracted:
    """What a file's text holds.

    The line tier always runs; where the syntax tier succeeds it gives the definitions and the line tier the notes
    and what is brought in.  If it fails or takes too long, the line tier's result stays, with the reason.
    """
    if tier == 0:
        return Extracted(0, "requested-tier", 0, [], [], [])
    said, brought, generated, truncated = lines.scan(text, language, flags)
    own = GENERATED if generated else 0
    reached, reason, symbols, references = 1, None, [], []
    if language in syntax.LANGUAGES:
        if tier < 2:
            reason = "requested-tier"
        else:
            try:
                symbols, references, cut = syntax.read(text, language, path, flags | own, seconds)
                reached, truncated = 2, truncated or cut
            except TimeoutError:
                reason = "parse-timeout"
            except (ValueError, IndexError, RecursionError, AttributeError):
                reason = "parse-failed"
    if reached == 2:
        said = [s for s in said if s.kind == "Note"]
        references = [r for r in references if r.kind not in ("INCLUDES", "IMPORTS")]
    merged = symbols + [s._replace(flags=s.flags | own) for s in said]
    order = sorted(range(len(merged)), key=lambda k: (merged[k].start, -merged[k].end, _KIND[merged[k].kind], _utf16(merged[k].qualified), k))
    place = {old: new for new, old in enumerate(order)}
    kept = [merged[k]._replace(parent=place.get(merged[k].parent, -1)) for k in order]
    if len(kept) > syntax.MOST_SYMBOLS:
        truncated, kept = True, kept[: syntax.MOST_SYMBOLS]
    found = [r._replace(source=place.get(r.source, -1)) for r in references] + brought
    found = [r for r in found if r.source < len(kept)] + explained(kept)
    found.sort(key=lambda r: (r.source, _EDGE[r.kind], r.start, _utf16(r.target), _utf16(r.qualifier)))
    if len(found) > syntax.MOST_REFERENCES:
        truncated, found = True, found[: syntax.MOST_REFERENCES]
    counts: Counter = Counter()
    ordinals = []
    for s in kept:
        ordinals.append(counts[s.kind, s.qualified])
        counts[s.kind, s.qualified] += 1
    reason = reason or ("extraction-limit" if truncated else None)
    return Extracted(reached, reason, own | (syntax.TRUNCATED if truncated else 0), kept, ordinals, found)


def explained(symbols: list[Symbol]) -> list[Reference]:
    """From each note to the first later symbol that isn't one and begins after it; one pass over the ordered symbols."""
    out: list[Reference] = []
    cursor = 0
    for k, note in enumerate(symbols):
        if note.kind == "Note":
            cursor = max(cursor, k + 1)
            while cursor < len(symbols) and (symbols[cursor].kind == "Note" or symbols[cursor].start < note.end):
                cursor += 1
            if cursor < len(symbols):
                out.append(Reference(k, "EXPLAINS", symbols[cursor].qualified, "", note.start_line, note.start, note.end, 2, 1))
    return out
