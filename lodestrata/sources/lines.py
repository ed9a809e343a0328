"""Line tier: imports, definitions, notes and the marker of generated files, found line by line.

Comments and the insides of strings are blanked first, in a line of the same length, so that every place found is
a place of the text; block comments are followed over lines.
"""

from __future__ import annotations

import re

from .syntax import DEFINITION, MOST_REFERENCES, MOST_SYMBOLS, Reference, Symbol, normal

# Words, markers and limits of the line tier.
_C = {"struct": "Type", "union": "Type", "enum": "Type", "class": "Type", "interface": "Type", "namespace": "Module"}
_WEB = {"function": "Function", "class": "Type", "interface": "Type", "enum": "Type", "type": "Type"}
_MANAGED = {"class": "Type", "interface": "Type", "enum": "Type", "record": "Type"}
_ML = {"type": "Type", "module": "Module", "namespace": "Module", "val": "Function"}
_C_LIKE = ("c", "c-header", "cpp", "cpp-header", "objective-c", "objective-cpp")
DEFINITIONS = {
    **dict.fromkeys(_C_LIKE, _C),
    "rust": {"fn": "Function", "struct": "Type", "enum": "Type", "trait": "Type", "union": "Type", "type": "Type", "mod": "Module", "const": "Constant", "static": "Variable"},
    "python": {"def": "Function", "class": "Type"},
    "go": {"func": "Function", "type": "Type"},
    "java": _MANAGED,
    "csharp": _MANAGED,
    **dict.fromkeys(("javascript", "typescript", "tsx"), _WEB),
    **dict.fromkeys(("fsharp", "fsharp-signature"), _ML),
}
#: Words that bring something in, how it is written, and the kind of the edge.
IMPORTS = {
    **dict.fromkeys((*_C_LIKE, "assembly"), (("include", "include_next", "import"), "directive", "INCLUDES")),
    "python": (("from", "import"), "dotted", "IMPORTS"),
    "rust": (("use", "mod"), "scoped", "IMPORTS"),
    "java": (("import",), "dotted", "IMPORTS"),
    "csharp": (("using",), "dotted", "IMPORTS"),
    **dict.fromkeys(("go", "javascript", "typescript", "tsx"), (("import",), "quoted", "IMPORTS")),
    "shell": (("source",), "bare", "IMPORTS"),
    "makefile": (("include", "-include"), "bare", "IMPORTS"),
    "kconfig": (("source",), "quoted", "IMPORTS"),
    "cmake": (("include",), "quoted", "IMPORTS"),
    **dict.fromkeys(("fsharp", "fsharp-signature"), (("open",), "dotted", "IMPORTS")),
}
LINE_COMMENTS = {
    **dict.fromkeys((*_C_LIKE, "rust", "go", "java", "csharp", "javascript", "typescript", "tsx", "fsharp", "fsharp-signature"), ("//",)),
    "assembly": ("//", ";"),
    **dict.fromkeys(("python", "shell", "makefile", "cmake", "kconfig", "yaml", "toml", "gn", "owners"), ("#",)),
}
BLOCK_COMMENTS = (*_C_LIKE, "rust", "go", "java", "csharp", "javascript", "typescript", "tsx")
NO_STRINGS = ("makefile", "kconfig", "owners", "text", "markdown", "unknown")
TAGS = ("TODO", "FIXME", "NOTE", "HACK", "SAFETY", "XXX")
MARKERS = ("do not edit", "do not modify", "autogenerated", "auto-generated", "automatically generated", "@generated", "generated by")
MARKER_LINES, MARKER_BYTES, LINE_CHARS, NOTE_CHARS, SKIPPED_WORDS = 32, 8192, 65_536, 256, 4

_NOTE = re.compile(r"(?<!\w)(" + "|".join(TAGS) + r")[ \t]*:[ \t]*(.*)", re.S)
_WORD = re.compile(r"[^\W\d]\w*")
_SPELLINGS = {
    "dotted": re.compile(r"[ \t]*([^\W\d][\w.]*)"),
    "scoped": re.compile(r"[ \t]*([^\W\d](?:[\w:]*\w)?)"),
    "quoted": re.compile(r"[^\"'<]*(?:\"([^\"]*)\"|'([^']*)'|<([^>]*)>)"),
    "bare": re.compile(r"[ \t]*(.*\S)"),
    "directive": re.compile(r"[ \t]*(?:\"([^\"]*)\"|<([^>]*)>|([^\"<\s].*\S|[^\"<\s]))"),
}
_MAKE = re.compile(r"([\w.-]+)[ \t]*(:=|:|=|\+=|\?=)")
_LABEL = re.compile(r"([^\W\d]\w*):")
_CONFIG = re.compile(r"[ \t]*(?:config|menuconfig)(?!\w)[ \t]*(\w+)")
_DEFINE = re.compile(r"[ \t]*#[ \t]*define(?!\w)[ \t]*([^\W\d]\w*)(\()?")


def _blanked(line: str, tokens: re.Pattern, inside: bool) -> tuple[str, int, int, int, bool]:
    """The line's code with strings blanked, where its code begins, and its first comment's place; block state after."""
    out: list[str] = []
    at = start = 0
    first = last = -1
    if inside:
        end = line.find("*/")
        stop = len(line) if end < 0 else end
        first, last = 0, stop
        if end < 0:
            return " " * len(line), len(line), first, last, True
        at = start = end + 2
        out.append(" " * at)
    while m := tokens.search(line, at):
        out.append(line[at : m.start()])
        t = m.group()
        if t == "/*":
            end = line.find("*/", m.end())
            stop = len(line) if end < 0 else end
            if first < 0:
                first, last = m.end(), stop
            if end < 0:
                return "".join(out).rstrip(), start, first, last, True
            at = end + 2
            out.append(" " * (at - m.start()))
        elif t[0] in "\"'" and len(t) > 1:
            out.append(t[0] + " " * (len(t) - 2) + t[-1])
            at = m.end()
        elif t in ("//", "#", ";"):
            if first < 0:
                first, last = m.end(), len(line)
            return "".join(out).rstrip(), start, first, last, False
        else:
            out.append(t)
            at = m.end()
    return ("".join(out) + line[at:]).rstrip(), start, first, last, False


def scan(text: str, language: str, flags: int = 0) -> tuple[list[Symbol], list[Reference], bool, bool]:
    """(symbols, references, generated, truncated) of one file's text; flags are the file's, for its symbols."""
    symbols: list[Symbol] = []
    references: list[Reference] = []
    generated = truncated = inside = False
    flags &= 4 | 8 | 16
    words, brings = DEFINITIONS.get(language, {}), IMPORTS.get(language)
    starts = [re.escape(x) for x in LINE_COMMENTS.get(language, ())]
    block, strings = language in BLOCK_COMMENTS, language not in NO_STRINGS
    tokens = re.compile("|".join([*([r"/\*"] if block else []), *starts, *([r"\"(?:[^\"\\]|\\.)*\"|'(?:[^'\\]|\\.)*'"] if strings else [])]) or r"(?!)")
    offset = 0
    for n, (line, end) in enumerate(re.findall(r"([^\r\n]*)(\r\n|\r|\n|\Z)", text), 1):
        if not line and not end:
            break
        whole = line
        if len(line) > LINE_CHARS:
            truncated, line = True, line[:LINE_CHARS]
        code, start, first, last, inside = _blanked(line, tokens, inside)
        place = (lambda k, o=offset: o + k) if whole.isascii() else lambda k, o=offset, x=line: o + len(x[:k].encode("utf-8", "surrogatepass"))

        def add(kind: str, name: str, a: int, b: int, given: int = DEFINITION, qualified: str | None = None, n=n, place=place) -> None:
            nonlocal truncated
            if len(symbols) >= MOST_SYMBOLS:
                truncated = True
                return
            symbols.append(Symbol(kind, normal(name), normal(qualified or name), -1, n, n, place(a), place(b), flags | given, "", 0))

        if first >= 0:
            said = line[first:last]
            if not generated and n <= MARKER_LINES and offset < MARKER_BYTES:
                low = said.encode("utf-8", "surrogatepass")[: MARKER_BYTES - offset].decode("utf-8", "ignore").lower()
                generated = any(m in low for m in MARKERS)
            if m := _NOTE.search(said):
                body = m.group(2).rstrip(" \t*/\r")
                body = normal(body, NOTE_CHARS)
                add("Note", m.group(1), first + m.start(), last, 0, f"{m.group(1)}: {body}" if body else m.group(1))
        offset_next = offset + len(whole.encode("utf-8", "surrogatepass")) + len(end)
        if code.strip():
            body = code[start:].lstrip(" \t")
            at = len(code) - len(body) if body else start
            if brings:
                names, style, edge = brings
                directive = body[:1] == "#"
                key = re.match(r"#?[ \t]*(-?\w+)", body)
                if key and directive == (style == "directive") and key.group(1) in names:
                    # the insides of strings are blank in the code: the spelling is read from the line
                    m = _SPELLINGS[style].match(line[: len(code)], at + key.end())
                    if m:
                        k = next(i for i, x in enumerate(m.groups(), 1) if x is not None)
                        if len(references) >= MOST_REFERENCES:
                            truncated = True
                        elif m.group(k):
                            references.append(Reference(-1, edge, normal(m.group(k)), "", n, place(m.start(k)), place(m.end(k)), 0, 1))
            if body[:1] == "#":
                if m := _DEFINE.match(code, start):
                    add("Macro" if m.group(2) else "Constant", m.group(1), at, len(code))
            elif words:
                cursor = at
                for _ in range(SKIPPED_WORDS + 1):
                    m = _WORD.match(code, cursor)
                    if not m:
                        break
                    after = re.compile(r"[ \t]*").match(code, m.end()).end()
                    if m.group() in words:
                        if name := _WORD.match(code, after):
                            add(words[m.group()], name.group(), cursor, len(code))
                        break
                    cursor = after
            if language == "kconfig" and (m := _CONFIG.match(code, start)):
                add("ConfigSymbol", m.group(1), at, len(code))
            elif language == "makefile" and not start and (m := _MAKE.match(code)):
                add("BuildTarget" if m.group(2) == ":" else "Variable", m.group(1), 0, len(code))
            elif language == "assembly" and not start and (m := _LABEL.match(code)):
                add("Function", m.group(1), 0, m.end(1))
        offset = offset_next
    return symbols, references, generated, truncated
