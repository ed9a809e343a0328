"""Reading stored mails: parts, transfer encodings, visible text and the sender's own words.

Plain functions on one mail, used inside Arrow batches.  They never raise on damaged input: an unfinished
multipart ends with the text, a damaged base64 block is read as far as it goes, an unknown character set is read
as UTF-8 where valid and else byte by byte.
"""

from __future__ import annotations

import base64
import binascii
import html
import quopri
import re
from typing import NamedTuple

_HEADER = re.compile(r"[!-9;-~]+[ \t]*:")
_BLANK_LINE = re.compile(r"\r?\n[ \t]*\r?\n")
_FOLD = re.compile(r"\r?\n[ \t]+")
_PARAM = re.compile(r';\s*([\w*-]+)\s*=\s*("(?:[^"\\]|\\.)*"|[^;\s]+)')
_NOT_BASE64 = re.compile(r"[^A-Za-z0-9+/]+")

_HIDDEN = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style|head)\b.*?(?:</\1\s*>|\Z)", re.I | re.S)
_BLOCK = re.compile(r"</?(?:p|div|br|li|ul|ol|tr|table|h[1-6]|blockquote|pre|hr|body|html|dl|dt|dd|section|article|center|form)\b[^<>]*>", re.I)
_CELL = re.compile(r"</?(?:td|th)\b[^<>]*>", re.I)
_TAG = re.compile(r"</?[a-zA-Z][^<>]*>|<![^<>]*>|<\?[^<>]*>")


class Part(NamedTuple):
    kind: str
    attached: bool
    text: str


def _headers(head: str) -> dict[str, str]:
    found: dict[str, str] = {}
    for line in _FOLD.sub(" ", head).split("\n"):
        name, colon, value = line.partition(":")
        if colon:
            found.setdefault(name.strip().lower(), value.strip())
    return found


def _split(entity: str) -> tuple[dict[str, str], str]:
    """Header fields and body; a text that doesn't begin like a header is all body."""
    if entity[:1] in ("\n", "\r"):
        return {}, entity.lstrip("\r\n") if entity[:2] in ("\r\n", "\n\n") else entity[1:]
    if not _HEADER.match(entity):
        return {}, entity
    m = _BLANK_LINE.search(entity)
    return (_headers(entity), "") if m is None else (_headers(entity[: m.start()]), entity[m.end() :])


def _params(value: str) -> dict[str, str]:
    return {k.lower(): v.strip('"') for k, v in _PARAM.findall(value)}


def _bytes_to_text(raw: bytes, charset: str) -> str:
    try:
        return raw.decode(charset or "utf-8")
    except (LookupError, UnicodeDecodeError):
        try:
            return raw.decode("utf-8")
        except UnicodeDecodeError as e:
            # a text cut in the middle of a character is still that text
            return raw[: e.start].decode("utf-8") if e.start >= len(raw) - 3 else raw.decode("cp1252", "replace")


def decode(body: str, encoding: str, charset: str) -> str:
    encoding = encoding.lower()
    if encoding == "base64":
        letters = _NOT_BASE64.sub("", body.partition("=")[0] if body.rstrip().endswith("=") else body)
        letters = letters[: len(letters) - (len(letters) % 4 == 1)]
        try:
            return _bytes_to_text(base64.b64decode(letters + "=" * (-len(letters) % 4)), charset)
        except (binascii.Error, ValueError):
            return body
    if encoding == "quoted-printable":
        return _bytes_to_text(quopri.decodestring(body.encode("utf-8")), charset)
    return body


def parts(entity: str | None) -> list[Part]:
    """The text parts of a mail at any depth, decoded, in order; parts that aren't text are left out."""
    found: list[Part] = []
    waiting = [entity] if entity else []
    while waiting:
        head, body = _split(waiting.pop())
        value = head.get("content-type", "")
        kind = value.partition(";")[0].strip().lower() or "text/plain"
        params = _params(value) if ";" in value else {}
        if kind.startswith("multipart/"):
            inner = _pieces(body, params["boundary"]) if params.get("boundary") else None
            if inner is not None:
                waiting += reversed(inner)
                continue
            kind = "text/plain"
        if kind == "message/rfc822":
            # its body is shorter than itself, so this ends
            waiting.append(decode(body, head.get("content-transfer-encoding", ""), params.get("charset", "")))
        elif kind.startswith("text/"):
            attached = "attachment" in head.get("content-disposition", "").lower() or "name" in params
            found.append(Part(kind, attached, decode(body, head.get("content-transfer-encoding", ""), params.get("charset", ""))))
    return found


def _pieces(body: str, boundary: str) -> list[str] | None:
    """The pieces of a multipart body as far as it goes; None if the boundary doesn't occur."""
    cut = re.split(r"(?:\A|\r?\n)" + re.escape("--" + boundary) + r"(--)?[ \t]*(?=\r?\n|\Z)", body)
    if len(cut) == 1:
        return None
    inner: list[str] = []
    # cut: preamble, closing mark or None, piece, closing mark or None, piece, ...
    for closing, piece in zip(cut[1::2], cut[2::2], strict=True):
        if closing:
            break
        inner.append(piece[2:] if piece[:2] == "\r\n" else piece[1:])
    return inner


def without_tags(source: str) -> str:
    """Visible text of an HTML part: blocks on lines of their own, tags within a line leave no gap."""
    text = _HIDDEN.sub("", source)
    text = _TAG.sub("", _CELL.sub(" ", _BLOCK.sub("\n", text)))
    return html.unescape(text) if "&" in text else text


def visible(part: Part) -> str:
    return without_tags(part.text) if part.kind in ("text/html", "text/enriched", "text/xml") else part.text


_QUOTE_BLOCK = re.compile(r"<blockquote\b.*?(?:</blockquote\s*>|\Z)", re.I | re.S)
_SMALL = re.compile(r"<small\b.*?(?:</small\s*>|\Z)", re.I | re.S)
_ORIGINAL = re.compile(r"\s*[-_]{3,}\s*(?:original message|forwarded message|ursprüngliche nachricht|message d'origine|mensaje original|元のメッセージ|weitergeleitete nachricht)\s*[-_]{3,}", re.I)
_RULE = re.compile(r"\s*_{4,}\s*\Z")
_BAR_QUOTE = re.compile(r"\s*\|(?:\s?[|>])*\s?[^|]*\Z")
_ATTRIBUTION = re.compile(r".*\d.*:\s*\Z|.*(?:wrote|schrieb|écrit|escribió|書きました)\s*:\s*\Z", re.I)


def own_text(entity: str | None) -> str:
    """What the sender wrote: no header, quotation, greeting, closing, signature, disclaimer or attachment."""
    inline = [p for p in parts(entity) if not p.attached and p.text.strip()]
    plain = [p.text for p in inline if p.kind == "text/plain"]
    text = "\n".join(plain) if plain else "\n".join(without_tags(_SMALL.sub("", _QUOTE_BLOCK.sub("", p.text))) for p in inline)
    kept: list[str] = []
    for line in text.split("\n"):
        line = line.rstrip()
        if line == "--" or _RULE.match(line) or _ORIGINAL.match(line):
            break
        start = line.lstrip()
        if start[:1] == ">" or (start[:1] == "|" and _BAR_QUOTE.match(line)):
            while kept and not kept[-1]:
                kept.pop()
            if kept and _ATTRIBUTION.match(kept[-1]):
                kept.pop()
            continue
        kept.append(start)
    while kept and not kept[-1]:
        kept.pop()
    lines = [k for k, line in enumerate(kept) if line]
    if len(lines) > 1 and _short(kept[lines[0]], 4) and kept[lines[0]][-1] in ",:!。、，様":
        kept[lines[0]] = ""
    closing = [k for k in lines if kept[k]][-2:]
    if len(closing) == 2 and closing[1] == closing[0] + 1 and (closing[0] == 0 or not kept[closing[0] - 1]) and all(_short(kept[k], 4) for k in closing):
        kept[closing[0]] = kept[closing[1]] = ""
    return "\n".join(kept).strip()


def _short(line: str, most: int) -> bool:
    return len(line) <= 48 and len(line.split()) <= most and not any(c in line for c in "#@+|/")
