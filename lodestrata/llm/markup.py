"""Markup residue in text: layout-aware rendering with the structure that was marked up.

A tree builder reads HTML tags, and Markdown, wiki and LaTeX constructs become blocks.  Tags that HTML leaves out
are implied (a list item ends where the next begins, cells and rows likewise), and visibility rules leave out
comments, scripts, heads and elements hidden by attribute or style.  The renderer emits all visible text, one block
after another, with lists indented by depth and numbered as they were, table cells aligned and code and formulas
kept as they stand; each kind of structure it met is reported.

Defined cases: null and blank text give an empty rendering and no markup; damaged or unclosed markup is read as
far as it goes and never raises; repeated rows give equal rows.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PIECES = ("heading", "list", "code", "formula")

_TAGS = "a abbr article aside b big blockquote body br center cite code col dd del div dl dt em fig figure font footer form h1 h2 h3 h4 h5 h6 head header hr html i img input ins kbd label li link main mark math meta mi mn mo mrow msqrt msub msup nav nowiki ol option p pre q ref s samp script section select small source span strike strong style sub sup syntaxhighlight table tbody td template tfoot th thead title tr tt u ul var video"
_TAG = re.compile(r"<!--|<(/?)(" + "|".join(sorted(_TAGS.split(), key=len, reverse=True)) + r")(?=[\s/>])((?:[^<>\"'\x04]|\"[^\"\x04]*\"|'[^'\x04]*')*)>|<!doctype[^>]*>", re.I | re.S)
_ENTITY = re.compile(r"&(?:[a-zA-Z][a-zA-Z0-9]*|#\d+|#x[0-9a-fA-F]+);")
_CODE = re.compile(r"^ {0,3}(`{3,}|~{3,})[^\S\n]*[\w+-]*[^\S\n]*$|\\begin\{((?:verbatim|lstlisting|minted|Verbatim)\*?)\}", re.M)
_ATX = re.compile(r" {0,3}(#{1,6})[ \t]+(\S.*?)(?:[ \t]+#+)?[ \t]*\Z")
_SETEXT = re.compile(r" {0,3}(=+|-{3,})[ \t]*\Z")
_WIKI_HEADING = re.compile(r"(={2,6})[ \t]*([^=\s].*?)[ \t]*\1[ \t]*\Z")
_BULLET = re.compile(r"([ \t]*)([-*+])[ \t]+(\[[ xX]\][ \t]+)?(\S.*)\Z")
_ORDERED = re.compile(r"([ \t]*)(\d{1,9})\.[ \t]+(\S.*)\Z")
_WIKI_ITEM = re.compile(r"([#*]+|[:;]+)[ \t]*(\S.*)\Z")
_WIKI = re.compile(r"\[\[|\{\{\w+\||''|\[https?://\S+ [^\]]*\]|^==[^=].*==\s*\Z")
_TABLE_RULE = re.compile(r"[ \t]*\|?[ \t]*:?-{3,}:?[ \t]*(?:\|[ \t]*:?-{3,}:?[ \t]*)*\|?[ \t]*\Z")
_LATEX_BLOCK = re.compile(r"\\begin\{(?!(?:itemize|enumerate|description)\*?\})(\w+\*?)\}(.*?)(?:\\end\{\1\}|\Z)", re.S)
_LATEX_LIST = re.compile(r"\\begin\{(itemize|enumerate|description)\*?\}(?:\[[^\]]*\])?|\\end\{(itemize|enumerate|description)\*?\}|\\item(?![a-zA-Z])(?:\[([^\]]*)\])?[ \t]*\n?[ \t]*")
_LATEX_HEADING = re.compile(r"\\(?:part|chapter|(?:sub){0,2}section|paragraph)\*?\{([^{}]*)\}")
_LATEX_INLINE = re.compile(r"\\(?:textbf|textit|emph|texttt|underline|text|footnote|textsc|href|url)\*?\{|~?\\(?:cite|label|ref|eqref|pageref)\{[^{}]*\}|\{\\(?:it|bf|em|tt|sc)\b|\\(?:documentclass|usepackage)(?:\[[^\]]*\])?\{[^{}]*\}")
_FORMULAS = (
    re.compile(r"\$\$(.+?)\$\$", re.S),
    re.compile(r"\\\[(.+?)\\\]", re.S),
    re.compile(r"\\\((.+?)\\\)", re.S),
    re.compile(r"(?<![\\$\w])\$(?=[^\s$])([^$\n]*?(?:[\\^_{}=]|\b[a-zA-Z]\b)[^$\n]*?)(?<=[^\s$])\$(?![\w$])"),
)
_MATH_ENVS = ("equation", "align", "gather", "multline", "eqnarray", "displaymath", "math")

_HEADINGS = ("h1", "h2", "h3", "h4", "h5", "h6")
_LISTS, _ITEMS = ("ul", "ol", "dl"), ("li", "dt", "dd")
_TABLE = ("table", "thead", "tbody", "tfoot", "tr", "td", "th")
_ROWS = _TABLE[:-2]
_BLOCKS = {*_HEADINGS, *_LISTS, *_ITEMS, *_TABLE, *"p div blockquote section article body html center header footer pre syntaxhighlight".split()}
#: Elements that don't show, that have no end tag, and that make a table's cell a part of the page's layout.
_HIDDEN = ("script", "style", "head", "template")
_RAW = ("script", "style", "syntaxhighlight")
_VOID = ("br", "hr", "img", "input", "link", "meta", "col")
_LAYOUT = {*_HEADINGS, *_LISTS, "table", "pre", "syntaxhighlight"}
_NEXT_BLOCK = re.compile(r"\n[ \t]*(?=\n|\x04)|\x04|<(?=/?(?:body|h[1-6]|p|div|ul|ol|dl|li|table|pre|blockquote|section|article)[\s/>])", re.I)
_END_TAG = re.compile(r"</\w+[^<>]*>")
#: Implied ends: a tag ends the open elements named, as far as the nearest one of the second names.
_SCOPE = ("td", "th", "li", "dd", "div", "blockquote", "section", "article", "table")
_ENDS = {
    "li": (("li",), _LISTS),
    "dt": (("dt", "dd"), _LISTS),
    "dd": (("dt", "dd"), _LISTS),
    "td": (("td", "th"), ("tr", "table")),
    "th": (("td", "th"), ("tr", "table")),
    "tr": (("tr", "td", "th"), ("table",)),
    **dict.fromkeys(("thead", "tbody", "tfoot"), (("tr", "td", "th", "thead", "tbody", "tfoot"), ("table",))),
    "body": (("head",), ()),
}
#: What an end tag doesn't reach over.
_CLOSES = {**dict.fromkeys(_ITEMS, (*_LISTS, "td", "th")), **dict.fromkeys(_TABLE[1:], ("table",))}
_ATTRIBUTE = re.compile(r"([^\s=/\"'<>]+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]*))?")
#: Signs at the head of a line: heading, item (with depth and label up to the second sign), code, row; and between cells.
_SIGNS = dict.fromkeys((2, 3, 4, 5, 6, 7, 0x1F))
_SMALL = {k: k + 32 for k in range(65, 91)}

_INLINE = (
    ("link", re.compile(r"!?\[([^\[\]\n]*)\]\((?:https?://|mailto:|[./#]|\w+/|\w+\.\w)[^()\s]*(?:\s\"[^\"]*\")?\)"), r"\1"),
    ("link", re.compile(r"(?<!\w)!?\[([^\[\]\n]+)\]\[[^\[\]\n]*\]|(?<=\w)\[([^\[\]\n]+)\]\[[^\[\]\n]*\]"), lambda m: m.group(1) or m.group(2)),
    ("wiki", re.compile(r"\[\[(?:[^\[\]|]*\|)?([^\[\]|]*)\]\]"), r"\1"),
    ("wiki", re.compile(r"\[https?://[^\s\]]+ ([^\[\]]*)\]"), r"\1"),
    ("wiki", re.compile(r"\{\{[A-Za-z][\w -]*\|(?:[^{}|]*\|)*([^{}]*)\}\}"), r"\1"),
    ("wiki", re.compile(r"'''?(?=[^'\s])(.+?)(?<=[^'\s])'''?"), r"\1"),
    ("emphasis", re.compile(r"\*\*(?=[^\s*])(.+?)(?<=[^\s*])\*\*"), r"\1"),
    ("emphasis", re.compile(r"~~(?=[^\s~])(.+?)(?<=[^\s~])~~"), r"\1"),
    ("emphasis", re.compile(r"(?<![_/.\\])__(?=[^\s_])([^_\n]+?)(?<=[^\s_])__(?!_)"), r"\1"),
    ("emphasis", re.compile(r"(?<![\w*])\*(?=[^\s*])([^*\n]+?)(?<=[^\s*])\*(?![\w*])|(?<=[^\x00-\x7f])\*(?=[^\s*])([^*\n]+?)(?<=[^\s*])\*(?=[^\x00-\x7f])"), lambda m: m.group(1) or m.group(2)),
    ("code", re.compile(r"(?<!`)`(?=[^\s`])([^`\n]+?)`(?!`)"), r"\1"),
)


class Page:
    """Blocks in the order of the text, and what was marked up."""

    def __init__(self) -> None:
        self.blocks: list[tuple[str, int, str]] = []
        self.labels: dict[int, str] = {}
        self.pieces: set[str] = set()
        self.marked = False

    def put(self, kind: str, text: str, depth: int = 0, label: str = "-") -> None:
        if kind in PIECES:
            self.pieces.add(kind)
            self.marked = True
        if text.strip() or kind in ("code", "formula"):
            if label != "-":
                self.labels[len(self.blocks)] = label
            self.blocks.append((kind, depth, text))

    def render(self) -> str:
        out: list[str] = []
        rows: list[list[str]] = []
        last = ""
        for k, (kind, depth, text) in enumerate([*self.blocks, ("end", 0, "")]):
            if kind == "row":
                rows.append([" ".join(c.split()) for c in text.split("\x1f")])
                continue
            if rows:
                widths = [max(len(r[k]) for r in rows if k < len(r)) for k in range(max(map(len, rows)))]
                table = "\n".join("  ".join(c.ljust(w) for c, w in zip(r, widths, strict=False)).rstrip() for r in rows)
                out.append(("\n\n" if out else "") + table)
                rows, last = [], "row"
            if kind == "end":
                break
            gap = "" if not out else "\n" if kind == last and kind in ("list", "code") else "\n\n"
            body = "  " * depth + f"{self.labels.get(k, '-')} " + " ".join(text.split()) if kind == "list" else text.strip("\n") if kind in ("code", "formula") else text.strip()
            out.append(gap + body)
            last = kind
        return "".join(out).strip()


def _inline(text: str, page: Page) -> str:
    for _, pattern, replacement in _INLINE:
        text, n = pattern.subn(replacement, text)
        page.marked |= n > 0
    found = _LATEX_INLINE.search(text)
    if found:
        page.marked = True
        text = re.sub(r"~?\\(?:cite|label|ref|eqref|pageref|documentclass|usepackage)(?:\[[^\]]*\])?\{[^{}]*\}", "", text)
        text = re.sub(r"\\(?:textbf|textit|emph|texttt|underline|text|footnote|textsc|href|url)\*?\{([^{}]*)\}", r"\1", text)
        text = re.sub(r"\{\\(?:it|bf|em|tt|sc)\b\s*([^{}]*)\}", r"\1", text)
    return text


class _Element:
    """An open element of the tree: where it stands, whether it shows, and how deep in lists it is."""

    __slots__ = ("cell", "closed", "hidden", "layout", "lists", "name", "number", "up")

    def __init__(self, name: str, up: _Element | None, attributes: dict[str, str]):
        self.name, self.up, self.closed, self.layout = name, up, False, False
        style = attributes.get("style", "").lower().replace(" ", "")
        own = name in _HIDDEN or "hidden" in attributes or "display:none" in style or "visibility:hidden" in style
        self.hidden = own or (up is not None and up.hidden)
        self.lists = (up.lists if up is not None else 0) + (name in _LISTS)
        self.cell = self if name in ("td", "th") else up.cell if up is not None else None
        start = attributes.get("start", "")
        self.number = int(start) if re.fullmatch(r"-?\d{1,9}", start) else 1


def _implied(name: str, top: _Element, count: Counter) -> _Element | None:
    """The open element that a tag of this name ends, if any."""
    ends, scope = _ENDS.get(name, ((), ()))
    if name in _BLOCKS and name not in ("tr", "td", "th", "thead", "tbody", "tfoot"):
        ends, scope = (*ends, "p"), scope or _SCOPE
    found = None
    if any(count[e] for e in ends):
        while top.up is not None and top.name not in scope:
            found = top if top.name in ends else found
            top = top.up
    return found


def _tree(text: str, page: Page) -> list[tuple[str, _Element, str]]:
    """The tree of open elements in the order of the text: (open, text or close; the element; the text)."""
    root = _Element("", None, {})
    here, at, count = root, 0, Counter()
    events: list[tuple[str, _Element, str]] = []

    def close(last: _Element, closed: bool = True) -> _Element:
        e = here
        while True:
            e.closed = closed
            count[e.name] -= 1
            events.append(("close", e, ""))
            if e is last:
                return e.up
            e = e.up

    low, last_end = text.translate(_SMALL), {}

    def ends_later(mark: str, after: int) -> bool:
        if mark not in last_end:
            last_end[mark] = low.rfind(mark)
        return last_end[mark] >= after

    def next_block(after: int) -> int:
        m = _NEXT_BLOCK.search(text, after)
        return m.start() if m else len(text)

    while m := _TAG.search(text, at):
        if m.start() > at:
            events.append(("text", here, text[at : m.start()]))
        at = m.end()
        page.marked = True
        name = (m.group(2) or "").lower()
        if not name:
            if m.group(0) == "<!--":
                # a comment without an end goes as far as the next block
                at = text.index("-->", at) + 3 if ends_later("-->", at) else next_block(at)
            continue
        if m.group(1) == "/":
            e = here
            if count[name]:
                limit = _CLOSES.get(name, ("td", "th") if name not in _TABLE else ())
                while e.name != name and e.up is not None and e.name not in limit and (name in _BLOCKS or e.name not in _BLOCKS):
                    e = e.up
            if e.name == name:
                here = close(e)
            elif name in _BLOCKS:
                events.append(("text", here, "\n\n" if name == "p" else "\n"))
            continue
        attributes = {}
        raw = m.group(3) or ""
        if raw and ("hidden" in raw.lower() or "display" in raw.lower() or name in ("ol", "li")):
            attributes = {k.lower(): v.strip("\"'") for k, v in _ATTRIBUTE.findall(raw)}
        if name in _RAW:
            # what stands in it is no markup
            end = low.index(f"</{name}", at) if ends_later(f"</{name}", at) else next_block(at)
            e = _Element(name, here, attributes)
            events += [("open", e, ""), ("text", e, text[at:end]), ("close", e, "")]
            tag = _END_TAG.match(text, end)
            at = tag.end() if tag else end
            continue
        last = _implied(name, here, count)
        if last is not None:
            here = close(last)
        e = _Element(name, here, attributes)
        if name == "li" and re.fullmatch(r"-?\d{1,9}", attributes.get("value", "")) and here.name == "ol":
            here.number = int(attributes["value"])
        if name in _VOID or (raw.endswith("/") and name not in _BLOCKS):
            events += [("open", e, ""), ("close", e, "")]
        elif e.hidden and not here.hidden and not ends_later(f"</{name}", at) and not (name == "head" and ends_later("<body", at)):
            # a hidden element without an end goes as far as the next block
            at = next_block(at)
        elif name in _BLOCKS or name == "math" or e.hidden:
            here = e
            count[name] += 1
            events.append(("open", e, ""))
            if name in _LAYOUT and e.up.cell is not None:
                cell = e.up.cell
                while cell is not None and not cell.layout:
                    cell.layout = True
                    cell = cell.up.cell
    if at < len(text):
        events.append(("text", here, text[at:]))
    if here is not root:
        close_to = here
        while close_to.up is not root:
            close_to = close_to.up
        close(close_to, closed=False)
    return events


def _tags(text: str, page: Page, code: list[str]) -> str:
    """HTML to lines: the tree of open elements decides what is visible, where blocks begin and how deep lists are."""
    if "<" not in text:
        return text
    out: list[str] = []
    inner: list[str] = []
    pre: _Element | None = None
    for what, e, said in _tree(text, page):
        if e.hidden:
            continue
        name = e.name
        flat = e.cell is not None and not e.cell.layout
        if what == "text":
            if pre is not None:
                inner.append(said)
            elif re.search("[\x02-\x06]", said):
                out.append(said)
            elif flat or (name in _HEADINGS and e.closed):
                out.append(re.sub(r"\s+", " ", said))
            elif name in _ROWS:
                out.append(said if said.strip() else "")
            elif name in _ITEMS and e.closed:
                begun = out and out[-1].endswith("\x06")
                said = re.sub(r"[ \t]*\n(?!\n)[ \t]*", " ", re.sub(r"\n\s*\n", "\x07\x07", said)).replace("\x07", "\n")
                out.append(said.lstrip() if begun else said)
            else:
                out.append(said)
        elif pre is not None:
            if e is pre:
                said = "".join(inner)
                said = said if name == "syntaxhighlight" else html.unescape(said)
                # code put aside within it comes back
                said = re.sub(r"\x04(\d+)", lambda m: code[int(m.group(1))], said)
                out.append(_aside(said.strip("\n"), code))
                pre = None
            elif name == "br" and what == "open":
                inner.append("\n")
        elif name in _HEADINGS:
            out.append(" " if flat else "\n\n" if what == "close" else "\n\n\x02")
            page.put("heading", "")
        elif name in _LISTS:
            out.append("\n" if e.lists > 1 else "\n\n")
            page.put("list", "")
        elif name in _ITEMS:
            page.put("list", "")
            label = "-"
            if what == "open" and e.up.name == "ol":
                label, e.up.number = f"{e.up.number}.", e.up.number + 1
            out.append("\n" if what == "close" else f"\n\x03{max(e.lists - 1, 0)},{label}\x06")
        elif name in ("pre", "syntaxhighlight"):
            pre, inner = e, []
            page.put("code", "")
        elif name == "math":
            out.append(" ")
            page.put("formula", "")
        elif name == "tr":
            out.append("\n" if what == "close" else "\n\x05")
        elif name in ("td", "th"):
            out.append("\n\n" if e.layout else "\x1f" if what == "open" else "")
        elif name == "br":
            out.append("" if what == "close" else " " if flat or name in _HEADINGS else "\n")
        elif name in _BLOCKS or name == "hr":
            begun = what == "open" and out and out[-1].endswith("\x06")
            out.append(" " if flat else "" if begun else "\n\n")
    return "".join(out)


def read(text: str | None) -> Page:
    """The page of a text in any of the markups, or of plain text."""
    page = Page()
    if not text or not text.strip():
        return page
    text = text.translate(_SIGNS)

    def environment(m: re.Match) -> str:
        name, body = m.group(1), m.group(2)
        page.marked = True
        base = name.rstrip("*")
        if base in _MATH_ENVS:
            page.put("formula", "")
            return "\n\n" + body.strip() + "\n\n"
        return _LATEX_BLOCK.sub(environment, body)

    # code lines are put aside first, so that nothing below reads what is in them
    text, code = _code_blocks(text, page)
    if "\\" in text:
        text = _latex_lists(_LATEX_BLOCK.sub(environment, text), page)
        if _LATEX_HEADING.search(text):
            page.put("heading", "")
            text = _LATEX_HEADING.sub(lambda m: f"\n\n\x02{m.group(1)}\n\n", text)
    joined = _tags(text, page, code)
    outside = re.sub(r"\x04\d+", "", joined)
    if any(p.search(outside) for p in _FORMULAS):
        page.put("formula", "")
    if _ENTITY.search(outside):
        unescaped = html.unescape(joined)
        page.marked |= unescaped != joined
        joined = unescaped
    lines = [f"\x04{code[int(line[1:])]}" if line[:1] == "\x04" else line for line in joined.split("\n")]
    page.blocks.clear()
    page.labels.clear()
    _blocks(lines, page)
    return page


def _latex_lists(text: str, page: Page) -> str:
    """Lists of LaTeX at any depth to lines of items."""
    open_: list[list] = []

    def token(m: re.Match) -> str:
        if m.group(1):
            page.put("list", "")
            open_.append([m.group(1), 0])
            return "\n\n" if len(open_) == 1 else "\n"
        if m.group(2):
            if open_:
                open_.pop()
            return "\n" if open_ else "\n\n"
        if not open_:
            return m.group(0)
        open_[-1][1] += 1
        label = f"{open_[-1][1]}." if open_[-1][0] == "enumerate" else "-"
        term = (m.group(3) or "").strip()
        return f"\n\x03{len(open_) - 1},{label}\x06" + (term + " " if term else "")

    return _LATEX_LIST.sub(token, text)


def _aside(body: str, code: list[str]) -> str:
    """Lines of code as signs with their numbers in ``code``, where they stay as they are."""
    first = len(code)
    code.extend(body.split("\n"))
    return "\n\n" + "".join(f"\x04{k}\n" for k in range(first, len(code))) + "\n"


def _code_blocks(text: str, page: Page) -> tuple[str, list[str]]:
    """The text with its fenced and verbatim blocks put aside, whichever opens first, and their lines."""
    out: list[str] = []
    code: list[str] = []
    at = 0
    while m := _CODE.search(text, at):
        out.append(text[at : m.start()])
        page.put("code", "")
        if m.group(1):
            close = re.compile(rf"^ {{0,3}}{m.group(1)[0]}{{{len(m.group(1))},}}[ \t]*$", re.M).search(text, m.end())
            end, at = (close.start(), close.end()) if close else (len(text), len(text))
            body = text[m.end() + 1 : end]
            body = body.removesuffix("\n") if close else body
            empty = m.end() + 1 >= end
        else:
            mark = f"\\end{{{m.group(2)}}}"
            end = text.find(mark, m.end())
            end, at = (end, end + len(mark)) if end >= 0 else (len(text), len(text))
            body = text[m.end() : end].strip("\n")
            empty = not body
        out.append("\n\n" if empty else _aside(body, code))
    out.append(text[at:])
    return "".join(out), code


def _blocks(lines: list[str], page: Page) -> None:
    paragraph: list[str] = []
    items = _marked_items(lines)

    def flush() -> None:
        if paragraph:
            page.put("text", _inline("\n".join(paragraph), page))
            paragraph.clear()

    k = 0
    if lines and lines[0].strip() == "---":
        end = next((j for j in range(1, len(lines)) if lines[j].strip() == "---"), 0)
        if end and all(re.match(r"[\w-]+:\s", x) or not x.strip() for x in lines[1:end]):
            page.marked = True
            k = end + 1
    while k < len(lines):
        line = lines[k]
        nxt = lines[k + 1] if k + 1 < len(lines) else ""
        sign, rest = line[:1], line[1:]
        if sign == "\x04":
            flush()
            page.put("code", rest)
        elif sign == "\x02":
            flush()
            page.put("heading", _inline(rest.strip(), page))
        elif sign == "\x03":
            flush()
            place, _, rest = rest.partition("\x06")
            depth, _, label = place.partition(",")
            page.put("list", _inline(rest.strip(), page), int(depth), label)
        elif sign == "\x05":
            flush()
            page.put("row", _inline(rest.lstrip("\x1f"), page))
        elif not line.strip():
            flush()
        elif m := _WIKI_HEADING.match(line):
            flush()
            page.put("heading", _inline(m.group(2), page))
        elif k in items:
            flush()
            depth, label, rest = items[k]
            page.put("list", _inline(rest, page), depth, label)
        elif (m := _ATX.match(line)):
            flush()
            page.put("heading", _inline(m.group(2), page))
        elif nxt and _SETEXT.match(nxt) and not paragraph and (nxt.strip()[0] == "=" or not lines[k + 2 : k + 3] or not lines[k + 2].strip()):
            flush()
            page.put("heading", _inline(line.strip(), page))
            k += 1
        elif "|" in line and nxt and "|" in nxt and _TABLE_RULE.match(nxt):
            flush()
            page.marked = True
            page.put("row", _inline("\x1f".join(line.strip().strip("|").split("|")), page))
            k += 2
            while k < len(lines) and "|" in lines[k]:
                page.put("row", _inline("\x1f".join(lines[k].strip().strip("|").split("|")), page))
                k += 1
            continue
        else:
            paragraph.append(line)
        k += 1
    flush()


def _marked_items(lines: list[str]) -> dict[int, tuple[int, str, str]]:
    """Lines that are list items of Markdown or wiki text: their depth, their label and what they say.

    One line with a star, dash or number is an item.  A line with ``#`` is a Markdown heading, but an item if
    several stand together or the rest is written in wiki markup.  Markdown's depth is the number of open items
    that stand further left, wiki text's the number of signs.
    """
    found: dict[int, tuple[int, str, str]] = {}
    wiki = any(_WIKI.search(line) for line in lines)
    runs: list[int] = []
    left: list[int] = []
    numbers: list[int] = []

    def numbered(depth: int, ordered: bool) -> str:
        """The label of a wiki item, numbers counted at each depth."""
        del numbers[depth + 1 :]
        numbers.extend([0] * (depth + 1 - len(numbers)))
        numbers[depth] = numbers[depth] + 1 if ordered else 0
        return f"{numbers[depth]}." if ordered else "-"

    last = -1
    for k, line in enumerate([*lines, ""]):
        hashes = bool(re.match(r"#+[ \t]+\S", line))
        if hashes:
            runs.append(k)
            left = []
            continue
        if len(runs) > 1 or (runs and wiki):
            for j in runs:
                if j != last + 1:
                    numbers.clear()
                depth = len(lines[j]) - len(lines[j].lstrip("#")) - 1
                found[j], last = (depth, numbered(depth, True), lines[j].lstrip("# \t")), j
        runs = []
        bullet, ordered = _BULLET.match(line), _ORDERED.match(line)
        if m := bullet or ordered:
            indent = len(m.group(1).expandtabs(4))
            while left and left[-1] >= indent:
                left.pop()
            found[k] = (len(left), "-" if bullet else f"{m.group(2)}.", m.group(4) if bullet else m.group(3))
            left.append(indent)
            if not (bullet and bullet.group(2) == "*" and not indent):
                continue
            numbered(0, False)
            last = k
        elif m := re.match(r"(\*\*+|\*#|#\*|[:;](?=[ \t]))[ \t]*(\S.*)\Z", line):
            if not line.rstrip().endswith("**"):
                if k != last + 1:
                    numbers.clear()
                depth = len(m.group(1)) - 1
                found[k], last = (depth, numbered(depth, m.group(1)[-1] == "#"), m.group(2)), k
                left = []
        elif line.strip() and not line[:1].isspace():
            left = []
    return found


def rendered(df: DataFrame, keys: list[str], text_column: str) -> DataFrame:
    """(keys, clean, marked, pieces) of each row: visible text, whether there was markup, its structures."""
    source = df.select(*keys, F.col(text_column).cast("string").alias("__text"))
    types = ", ".join(f"{k} {source.schema[k].dataType.simpleString()}" for k in keys)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pages = [read(t) for t in batch.column(len(keys)).to_pylist()]
            arrays = [batch.column(i) for i in range(len(keys))]
            arrays += [pa.array([p.render() for p in pages], pa.string()), pa.array([p.marked for p in pages]), pa.array([sorted(p.pieces) for p in pages], pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays(arrays, names=[*keys, "clean", "marked", "pieces"])

    return source.mapInArrow(run, f"{types}, clean string, marked boolean, pieces array<string>")


def found(df: DataFrame, keys: list[str], text_column: str) -> DataFrame:
    """(keys, piece): each structure of a row with markup, or 'none'."""
    rows = rendered(df, keys, text_column).filter("marked")
    piece = F.explode(F.when(F.size("pieces") > 0, F.col("pieces")).otherwise(F.array(F.lit("none"))))
    return rows.select(*keys, piece.alias("piece")).distinct()
