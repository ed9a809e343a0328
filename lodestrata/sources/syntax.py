"""Syntax tier for C and C++: a tolerant scanner of declarations, scopes, calls and preprocessor conditions.

No grammar is at hand, so tokens are gathered into the head of a declaration until ``;`` or ``{`` says what it is.
Scopes stand on a stack; every branch of a conditional is read, and an alternative branch begins with the scopes
its conditional began with.  Damaged text is read as far as it makes sense and never raises.

Known limits: declarations of functions inside function bodies and old-style parameter lists are left out.
"""

from __future__ import annotations

import bisect
import re
import time
import unicodedata
from typing import NamedTuple

#: Limits of what one file may hold, in the data model's terms.
MOST_SYMBOLS, MOST_REFERENCES, MOST_CONDITIONS, CONDITION_DEPTH, CONDITION_CHARS, NAME_CHARS = 65_536, 262_144, 65_536, 256, 512, 1024
DEFINITION, DECLARATION, TEST, CONDITIONAL, INTERNAL, TRUNCATED = 1, 2, 4, 32, 2048, 4096
TEST_MACROS = ("TEST", "TEST_F", "TEST_P", "TYPED_TEST", "TYPED_TEST_P")
LANGUAGES = ("c", "c-header", "cpp", "cpp-header")

_TOKEN = re.compile(
    r"(?P<space>(?:\s|\\\r?\n)+)|(?P<comment>//(?:[^\\\n]|\\.|\\\n)*|/\*.*?(?:\*/|\Z))"
    r"|(?P<string>(?:u8|[uUL])?R\"(?P<mark>[^()\\\s]{0,16})\(.*?\)(?P=mark)\"|(?:u8|[uUL])?\"(?:[^\"\\\n]|\\.)*\"?|(?:u8|[uUL])?'(?:[^'\\\n]|\\.)*'?)"
    r"|(?P<number>\.?\d(?:[eEpP][+-]|[\w.']|(?<=')\w)*)|(?P<word>[^\W\d]\w*)|(?P<punct>::|->\*?|\.\.\.|<<=?|>>=|<=>|[-+*/%&|^=!<>]=|&&|\|\||\+\+|--|.)",
    re.S,
)
_DIRECTIVE = re.compile(r"[ \t]*#[ \t]*(\w*)((?:[^\\\n/]|\\\r?\n|\\.|/(?![*/])|/\*.*?\*/|//[^\n]*)*)", re.S)
_WORDS = re.compile(r"[^\W\d]\w*")
_TYPES = frozenset("void char short int long float double signed unsigned bool auto wchar_t char8_t char16_t char32_t size_t ssize_t ptrdiff_t intptr_t uintptr_t int8_t int16_t int32_t int64_t uint8_t uint16_t uint32_t uint64_t".split())
_QUALIFIERS = frozenset("const volatile static extern inline register mutable virtual explicit constexpr consteval constinit friend thread_local _Thread_local typename restrict __restrict __inline __inline__ _Noreturn noreturn".split())
_NOT_CALLED = frozenset("if while for switch return sizeof alignof _Alignof decltype typeof __typeof__ catch throw new delete else do case goto and or not static_assert _Static_assert __attribute__ __declspec alignas noexcept requires co_return co_await co_yield defined".split()) | _TYPES
_KEYS = ("class", "struct", "union", "enum")


class Symbol(NamedTuple):
    kind: str
    name: str
    qualified: str
    parent: int
    start_line: int
    end_line: int
    start: int
    end: int
    flags: int
    condition: str
    doc: int


class Reference(NamedTuple):
    source: int
    kind: str
    target: str
    qualifier: str
    line: int
    start: int
    end: int
    stage: int
    confidence: int


class _Token(NamedTuple):
    kind: str
    text: str
    start: int
    end: int


class _Scope:
    __slots__ = ("head", "internal", "kind", "prefix", "start", "symbol")

    def __init__(self, kind: str, symbol: int, prefix: str, internal: bool, start: int = 0, head: list | None = None):
        self.kind, self.symbol, self.prefix, self.internal, self.start = kind, symbol, prefix, internal, start
        #: What of a declaration goes on after the scope's end.
        self.head = head


def normal(name: str, most: int = NAME_CHARS) -> str:
    """NFC, cut to a number of UTF-16 units without splitting a pair."""
    name = unicodedata.normalize("NFC", name)
    if len(name) * 2 > most and len(units := name.encode("utf-16-le", "surrogatepass")) > 2 * most:
        name = units[: 2 * most].decode("utf-16-le", "ignore")
    return name


def guards(condition: str) -> list[str]:
    """Identifiers of a condition outside literals and numbers, without ``defined``, once each in order."""
    bare = re.sub(r"\"(?:[^\"\\]|\\.)*\"?|'(?:[^'\\]|\\.)*'?|(?<!\w)\d[\w.']*", " ", condition)
    return list(dict.fromkeys(normal(w) for w in _WORDS.findall(bare) if w != "defined"))


class _Reader:
    def __init__(self, text: str, language: str, path: str, flags: int, seconds: float):
        self.text, self.path, self.header, self.flags = text, path, language.endswith("header"), flags
        self.until = time.monotonic() + seconds
        self.symbols: list[Symbol] = []
        self.references: list[Reference] = []
        self.truncated = False
        self.scopes = [_Scope("file", -1, "", False)]
        self.conditions: list[dict] = []
        self.seen_conditions = 0
        self.head: list[_Token] = []
        self.comment: tuple[int, int] | None = None
        self.doc = 0
        #: The head whose depth is known, its length and its depth.
        self.counted: list = [None, 0, 0]
        self.lines = [0, *(m.end() for m in re.finditer(r"\r\n|\r|\n", text))]
        # bytes before each line, so that a place in bytes needs only its own line
        self.bytes = None
        if not text.isascii():
            self.bytes = [0]
            for a, b in zip(self.lines, [*self.lines[1:], len(text)], strict=True):
                self.bytes.append(self.bytes[-1] + len(text[a:b].encode("utf-8", "surrogatepass")))

    # places

    def line(self, at: int) -> int:
        return bisect.bisect_right(self.lines, at)

    def byte(self, at: int) -> int:
        if self.bytes is None:
            return at
        k = self.line(at) - 1
        return self.bytes[k] + len(self.text[self.lines[k] : at].encode("utf-8", "surrogatepass"))

    # what is found

    @property
    def scope(self) -> _Scope:
        return next(s for s in reversed(self.scopes) if s.kind != "block")

    def is_global(self) -> bool:
        return self.scope.kind in ("file", "module")

    def condition(self) -> str:
        return self.conditions[-1]["combined"] if self.conditions else ""

    def doc_before(self, start: int) -> int:
        if self.comment and self.comment[1] <= start and not self.text[self.comment[1] : start].strip(" \t\r\n"):
            return self.byte(self.comment[1]) - self.byte(self.comment[0])
        return 0

    def add(self, kind: str, name: str, start: int, end: int, flags: int, doc: int = 0, qualified: str | None = None) -> int:
        scope = self.scope
        if not name:
            return -1
        if len(self.symbols) >= MOST_SYMBOLS:
            self.truncated = True
            return -1
        if qualified is None:
            qualified = f"{scope.prefix}::{name}" if scope.prefix else name
            name = name.rpartition("::")[2]
        if scope.internal or flags & INTERNAL:
            qualified = f"{self.path}::{qualified}"
        condition = self.condition()
        flags |= self.flags | (INTERNAL if scope.internal else 0) | (CONDITIONAL if condition else 0)
        self.symbols.append(Symbol(kind, normal(name), normal(qualified), scope.symbol, self.line(start), self.line(end), self.byte(start), self.byte(end), flags, condition, doc))
        return len(self.symbols) - 1

    def close(self, symbol: int, end: int) -> None:
        if symbol >= 0:
            self.symbols[symbol] = self.symbols[symbol]._replace(end_line=self.line(max(0, end - 1)), end=self.byte(end))

    def refer(self, source: int, kind: str, target: str, qualifier: str, start: int, end: int, confidence: int = 1) -> None:
        if not target:
            return
        if len(self.references) >= MOST_REFERENCES:
            self.truncated = True
            return
        self.references.append(Reference(source, kind, normal(target), normal(qualifier), self.line(start), self.byte(start), self.byte(end), 0, confidence))

    # preprocessor

    def directive(self, m: re.Match, following: dict[int, tuple[bool, str]]) -> None:
        word, rest = m.group(1), re.sub(r"/\*.*?\*/|//[^\n]*", " ", m.group(2).replace("\\\r\n", " ").replace("\\\n", " "), flags=re.S)
        own = " ".join(rest.split())
        name = (_WORDS.match(own) or [""])[0]
        if word == "define" and name:
            at = m.start(2) + m.group(2).find(name) + len(name)
            start, end = m.start() + len(m.group()) - len(m.group().lstrip()), min(len(self.text), m.end() + 1)
            self.add("Macro" if self.text[at : at + 1] == "(" else "Constant", name, start, end, DEFINITION, self.doc_before(start))
        elif word in ("ifdef", "ifndef"):
            negated = word == "ifndef"
            alternative, guarded = following.get(m.start(), (True, ""))
            if self.header and negated and name and not self.conditions and len(self.scopes) == 1 and not alternative and guarded == name:
                self.conditions.append({"outer": "", "remaining": "", "combined": "", "scopes": 1})
            else:
                self.enter(f"{'!' if negated else ''}defined({name})" if name else "", False)
        elif word == "if":
            self.enter(own, False)
        elif word in ("elif", "elifdef", "elifndef", "else"):
            shown = own if word == "elif" else "" if word == "else" or not name else f"{'!' if word == 'elifndef' else ''}defined({name})"
            self.enter(shown, True)
        elif word == "endif" and self.conditions:
            self.conditions.pop()

    def enter(self, own: str, alternative: bool) -> None:
        cut = lambda x: normal(x, CONDITION_CHARS)
        self.truncated |= len(own) > CONDITION_CHARS or self.seen_conditions >= MOST_CONDITIONS or len(self.conditions) >= CONDITION_DEPTH
        own = cut(own)
        self.seen_conditions += 1
        if alternative and self.conditions:
            before = self.conditions.pop()
            outer, scopes = before["outer"], before["scopes"]
            effective = f"{before['remaining']} && ({own})" if own else before["remaining"]
            remaining = f"{before['remaining']} && !({own})" if own else ""
            # the branch begins with the scopes that were open where its conditional began
            while len(self.scopes) > scopes:
                self.scopes.pop()
                self.head = []
        else:
            outer, effective, remaining, scopes = self.condition(), own, f"!({own})", len(self.scopes)
        combined = effective if not outer else outer if not effective else f"({outer}) && ({effective})"
        self.conditions.append({"outer": outer, "remaining": cut(remaining), "combined": cut(combined), "scopes": scopes})

    def pairs(self, found: list[re.Match]) -> dict[int, tuple[bool, str]]:
        """Of each conditional: whether it has an alternative, and the name defined right after it."""
        out: dict[int, tuple[bool, str]] = {}
        open_: list[int] = []
        for k, m in enumerate(found):
            word = m.group(1)
            if word in ("if", "ifdef", "ifndef"):
                nxt = found[k + 1] if k + 1 < len(found) else None
                direct = nxt is not None and nxt.group(1) == "define" and not re.sub(r"/\*.*?\*/|//[^\n]*", "", self.text[m.end() : nxt.start()], flags=re.S).strip()
                out[m.start()] = (False, (_WORDS.search(nxt.group(2)) or [""])[0] if direct else "")
                open_.append(m.start())
            elif word.startswith("el") and open_:
                out[open_[-1]] = (True, out[open_[-1]][1])
            elif word == "endif" and open_:
                open_.pop()
        return out

    # declarations

    def read(self) -> None:
        text, at, fresh = self.text, 0, True
        directives: list[re.Match] = []
        scan, line_start = 0, True
        while scan < len(text):
            m = _DIRECTIVE.match(text, scan) if line_start else None
            if m and m.group().strip():
                directives.append(m)
                scan = m.end()
                line_start = False
                continue
            t = _TOKEN.match(text, scan)
            line_start = "\n" in t.group() if t.lastgroup == "space" else line_start and t.lastgroup == "comment"
            scan = t.end()
        following = self.pairs(directives)
        at_directive = {m.start(): m for m in directives}
        steps = 0
        while at < len(text):
            steps += 1
            if steps % 4096 == 0 and time.monotonic() > self.until:
                raise TimeoutError
            if at in at_directive:
                m = at_directive[at]
                self.directive(m, following)
                at = m.end()
                continue
            m = _TOKEN.match(text, at)
            kind = m.lastgroup if m.lastgroup != "mark" else "string"
            nxt = m.end()
            if kind == "space":
                # a directive begins with the blanks of its own line
                inside = [k for k in (bisect.bisect_left(self._starts(directives), at + 1),) if k < len(directives) and directives[k].start() < nxt]
                at = directives[inside[0]].start() if inside else nxt
                continue
            at = nxt
            if kind == "comment":
                self.comment = (m.start(), m.end())
                continue
            self.token(_Token(kind, m.group(), m.start(), m.end()))
        for scope in reversed(self.scopes):
            self.close(scope.symbol, len(text))

    def _starts(self, directives: list[re.Match]) -> list[int]:
        if not hasattr(self, "_at"):
            self._at = [m.start() for m in directives]
        return self._at

    def token(self, t: _Token) -> None:
        head, here = self.head, self.scopes[-1]
        if not head and t.kind != "punct":
            self.doc = self.doc_before(t.start)
        if head is not self.counted[0] or len(head) != self.counted[1]:
            self.counted = [head, len(head), self._depth(head)]
        depth = self.counted[2]
        if t.text == "}" and t.kind == "punct":
            if depth and here.kind in ("function", "block"):
                self.statement(t)
            elif head and here.kind == "enum":
                self.enumerator(head)
            elif head:
                self.statement(t)
            self.head = []
            if len(self.scopes) > 1:
                done = self.scopes.pop()
                self.close(done.symbol if done.kind != "block" else -1, t.end)
                if done.head is not None:
                    self.head = done.head
            return
        if here.kind == "enum":
            if t.text == "," and not depth:
                self.enumerator(head)
                self.head = []
            else:
                self.append(t)
            return
        if t.text == ";" and t.kind == "punct" and not depth:
            head.append(t)
            self.statement(t)
            self.head = []
            return
        if t.text == "{" and t.kind == "punct":
            if depth and here.kind in ("function", "block"):
                # a body among arguments: a lambda or a statement expression
                self.calls(head, 0)
                self.scopes.append(_Scope("block", -1, "", False))
                self.head = []
            else:
                self.opened(t)
            return
        if t.text == ":" and len(head) == 1 and head[0].text in ("public", "private", "protected", "signals", "default"):
            self.head = []
            return
        self.append(t)

    def append(self, t: _Token) -> None:
        """Into the head, its depth kept."""
        self.head.append(t)
        step = ((t.text in "([") - (t.text in ")]")) if t.kind == "punct" else 0
        self.counted = [self.head, len(self.head), max(0, self.counted[2] + step)]

    @staticmethod
    def _depth(head: list[_Token]) -> int:
        depth = 0
        for t in head:
            if t.kind == "punct":
                depth += (t.text in "([") - (t.text in ")]")
        return max(0, depth)

    @staticmethod
    def plain(head: list[_Token]) -> list[_Token]:
        """The head without a leading template clause and without attributes."""
        out: list[_Token] = []
        k = 0
        while k < len(head):
            t = head[k].text
            if t == "template" and k + 1 < len(head) and head[k + 1].text == "<":
                depth, k = 0, k + 1
                while k < len(head):
                    depth += {"<": 1, ">": -1, ">>": -2}.get(head[k].text, 0)
                    k += 1
                    if depth <= 0:
                        break
                continue
            if t in ("__attribute__", "__declspec", "alignas") and k + 1 < len(head) and head[k + 1].text == "(":
                k = _group(head, k + 1)
                continue
            if t == "[" and k + 1 < len(head) and head[k + 1].text == "[":
                k = _group(head, k)
                continue
            out.append(head[k])
            k += 1
        return out

    def opened(self, brace: _Token) -> None:
        head = self.plain(self.head)
        words = [t.text for t in head]
        self.head = []
        here = self.scope
        in_body = self.scopes[-1].kind in ("function", "block")
        block = _Scope("block", -1, "", False)
        if not head:
            self.scopes.append(block)
            return
        if "namespace" in words[:2] and "=" not in words:
            name = "".join(words[words.index("namespace") + 1 :])
            symbol = self.add("Module", name, head[0].start, brace.end, DEFINITION, self.doc) if name else here.symbol
            prefix = here.prefix if not name else f"{here.prefix}::{name}" if here.prefix else name
            self.scopes.append(_Scope("module", symbol if name else -2, prefix, here.internal or not name))
            if not name:
                self.scopes[-1].symbol = here.symbol
                self.scopes[-1].head = None
            return
        if words[0] == "extern" and len(head) == 2 and head[1].kind == "string":
            self.scopes.append(block)
            return
        outer = _outer(head)
        top = [k for k in range(len(head)) if words[k] == "(" and outer[k]]
        equals = next((k for k in range(len(head)) if words[k] == "=" and outer[k]), None)
        key = next((k for k in range(len(head)) if words[k] in _KEYS and outer[k]), None)
        if key is not None and equals is None and not [k for k in top if k > key and words[k - 1] not in _KEYS]:
            self.specifier(head, key, brace)
            return
        if equals is not None and not (top and words[equals - 1] == "operator"):
            self.calls(head[equals:], 0)
            self.scopes.append(_Scope("block", -1, "", False, head=head))
            return
        named = _declarator(head) if not in_body else None
        if named is None or not named[2] or (in_body and here.kind == "function"):
            self.calls(head, 0)
            self.scopes.append(block)
            return
        self.function(head, named, brace)

    def specifier(self, head: list[_Token], key: int, brace: _Token) -> None:
        """A class, struct, union or enumeration with its body."""
        here, words = self.scope, [t.text for t in head]
        colon = next((k for k in range(key + 1, len(head)) if words[k] == ":"), len(head))
        parts = [t for t in head[key + 1 : colon] if t.kind == "word" and t.text not in ("class", "struct", "final")]
        name = ""
        if parts:
            last = head.index(parts[-1])
            first = last
            while first >= 2 and words[first - 1] == "::":
                first -= 2
            name = "".join(words[first : last + 1])
        typedef = "typedef" in words[:key]
        symbol = self.add("Type", name, head[key].start, brace.end, DEFINITION, self.doc_before(head[key].start)) if name else -1
        if name and words[key] != "enum":
            for a, b in _bases(head, colon + 1):
                self.refer(symbol, "INHERITS", self.text[a:b], here.prefix, a, b)
        kind = "enum" if words[key] == "enum" else "type"
        prefix = (f"{here.prefix}::{name}" if here.prefix else name) if name else here.prefix
        scope = _Scope(kind, symbol if name else here.symbol, prefix, here.internal, head[0].start, [*head[:key], _Token("body", name, head[key].start, brace.end)])
        if not name:
            alias = self.alias_after(brace.end) if typedef else ""
            if alias:
                symbol = self.add("Type", alias, head[0].start, brace.end, DEFINITION, self.doc)
                scope.symbol, scope.prefix = symbol, f"{here.prefix}::{alias}" if here.prefix else alias
                scope.head = [_Token("alias", str(symbol), head[0].start, brace.end), *scope.head]
            elif here.kind == "type" or here.kind == "file":
                scope.head = [*head[:key], _Token("body", "", head[key].start, brace.end)]
        self.scopes.append(scope)

    def alias_after(self, at: int) -> str:
        """The first plain name after the body that begins before ``at``."""
        depth = 1
        while at < len(self.text):
            m = _TOKEN.match(self.text, at)
            at = m.end()
            if m.lastgroup == "punct":
                depth += (m.group() == "{") - (m.group() == "}")
                if not depth:
                    found = re.compile(r"[\s]*([^\W\d]\w*)\s*[,;]").match(self.text, at)
                    return found.group(1) if found else ""
        return ""

    def enumerator(self, head: list[_Token]) -> None:
        if head and head[0].kind == "word":
            self.add("Constant", head[0].text, head[0].start, head[-1].end, DEFINITION)

    def function(self, head: list[_Token], named: tuple, brace: _Token) -> None:
        here = self.scope
        start = head[0].start
        first, last, _, opening = named
        raw = self.text[head[first].start : head[last].end]
        raw = re.sub(r"\s*::\s*", "::", raw)
        if raw in TEST_MACROS and first == 0:
            close = _group(head, opening) - 1
            case = re.sub(r"\s", "", self.text[head[opening].end : head[close].start]).replace(",", ".")
            name = case or raw
            qualified = f"{here.prefix}::{name}" if here.prefix else name
            symbol = self.add("Function", name.rpartition(".")[2], start, brace.end, DEFINITION | TEST, self.doc, qualified)
            if case and symbol >= 0:
                self.refer(symbol, "TESTS", case.partition(".")[0], here.prefix, start, brace.end, 3)
            self.scopes.append(_Scope("function", symbol, qualified, here.internal))
            return
        static = self.is_global() and any(t.text == "static" for t in head[:first])
        symbol = self.add("Function", raw, start, brace.end, DEFINITION | (INTERNAL if static else 0), self.doc)
        self.scopes.append(_Scope("function", symbol, f"{here.prefix}::{raw}" if here.prefix else raw, here.internal))
        self.uses(head)
        # of a constructor's list of members only what stands in its brackets is called
        self.calls(head, opening, skip_names=True)

    def uses(self, head: list[_Token]) -> None:
        """Types named with their key word and without a body."""
        for k, t in enumerate(head[:-1]):
            if t.text in _KEYS and head[k + 1].kind == "word" and head[k + 1].text not in _KEYS:
                name = head[k + 1]
                self.refer(self.scope.symbol, "REFERENCES", name.text, self.scope.prefix, name.start, name.end)

    def calls(self, head: list[_Token], since: int, skip_names: bool = False) -> None:
        scope = self.scope
        depth = 0
        for k in range(since, len(head) - 1):
            t = head[k]
            depth += (t.text == "(") - (t.text == ")")
            if t.kind != "word" or head[k + 1].text != "(" or t.text in _NOT_CALLED or (skip_names and not depth):
                continue
            before = head[k - 1] if k else None
            if before is not None and (before.kind == "word" and before.text not in ("return", "else", "do", "throw", "case", "co_return", "co_await", "co_yield", "and", "or", "not") or before.text in (">", "~")) and not skip_names:
                # a declaration of an object with its arguments
                continue
            first = k
            while first >= 1 and head[first - 1].text in ("::", ".", "->"):
                if first >= 2 and head[first - 2].kind == "word":
                    first -= 2
                elif first >= 2 and head[first - 2].text in (")", "]"):
                    first = _back(head, first - 2)
                    first -= first >= 1 and head[first - 1].kind == "word" and head[first - 1].text not in _NOT_CALLED
                elif head[first - 1].text == "::":
                    first -= 1
                    break
                else:
                    break
            self.refer(scope.symbol, "CALLS", self.text[head[first].start : t.end], scope.prefix, head[first].start, t.end)

    def statement(self, last: _Token) -> None:
        """A declaration or statement that ends without a body."""
        head = self.plain(self.head)
        if head and head[-1].text == ";" and head[-1].kind == "punct":
            head = head[:-1]
        alias = next((t for t in head if t.kind == "alias"), None)
        head = [t for t in head if t.kind != "alias"]
        if not head:
            return
        words, scope, end = [t.text for t in head], self.scope, last.end if last.text == ";" else head[-1].end
        start = head[0].start
        in_body = scope.kind == "function"
        if in_body:
            self.calls(head, 0)
            self.uses(head)
            if words[0] != "static":
                return
        if words[0] == "using":
            if "=" in words and len(head) > 3:
                self.add("Type", words[1], start, end, DEFINITION, self.doc)
            return
        if words[0] in ("namespace", "static_assert", "_Static_assert", "goto", "return"):
            return
        body = next((k for k, t in enumerate(head) if t.kind == "body"), None)
        if words[0] == "typedef":
            inner = head[body].text if body is not None else ""
            rest = head[(body + 1) if body is not None else 1 :]
            if alias is not None:
                self.close(int(alias.text), end)
            for k, part in enumerate(_split(rest)):
                named = _declarator(part, typedef=True, more=k > 0 or body is not None)
                if named:
                    name = part[named[0]].text
                    if name != inner and not (alias is not None and self.symbols[int(alias.text)].name == normal(name)):
                        self.add("Type", name, start, end, DEFINITION, self.doc)
            self.uses(head)
            return
        key = next((k for k, w in enumerate(words) if w in _KEYS), None)
        if body is None and key is not None and "friend" not in words and all(t.kind == "word" or t.text in (":", "::") for t in head) and len([w for w in words[key + 1 :] if w not in ("class", "struct", ":", "::")]) == (1 if ":" not in words else len([w for w in words[key + 1 :] if w not in ("class", "struct", ":", "::")])):
            names = [t for t in head[key + 1 : words.index(":") if ":" in words else len(head)] if t.kind == "word" and t.text not in ("class", "struct")]
            if names:
                self.add("Type", names[-1].text, head[key].start, head[-1].end, DECLARATION, self.doc_before(head[key].start))
            return
        if "friend" in words:
            self.uses(head)
            return
        static, extern = "static" in words, "extern" in words
        linkage = INTERNAL if static and self.is_global() else 0
        type_name = _type_name(head)
        fields = scope.kind == "type"
        for k, part in enumerate(_split(head)):
            outer = _outer(part)
            equals = next((j for j in range(len(part)) if part[j].text == "=" and outer[j]), None)
            named = _declarator(part[:equals] if equals is not None and part[equals - 1].text != "operator" else part, more=k > 0 or body is not None, in_type=fields)
            if named is None:
                if not in_body:
                    self.calls(part, 0)
                continue
            first, final, is_function, opening = named
            name = re.sub(r"\s*::\s*", "::", self.text[part[first].start : part[final].end])
            if is_function and not fields and k == 0 and first == 0:
                # nothing before the name: a macro that is called
                if not in_body:
                    self.calls(part, 0)
                continue
            if is_function and in_body:
                continue
            if is_function:
                self.add("Function", name, start, end, DECLARATION | linkage, self.doc)
            elif fields:
                symbol = self.add("Field", name, start, end, DEFINITION, self.doc)
                if type_name and symbol >= 0:
                    self.refer(symbol, "TYPED_AS", type_name.text, scope.prefix, type_name.start, type_name.end)
            elif self.is_global() or static:
                self.add("Variable", name, start, end, (DECLARATION if extern and equals is None else DEFINITION) | linkage, self.doc)
            if not in_body and equals is not None:
                self.calls(part[equals:], 0)
        if not in_body:
            self.uses(head)


def _group(head: list[_Token], at: int) -> int:
    """The place after the bracket that closes the one at ``at``."""
    depth = 0
    for k in range(at, len(head)):
        depth += (head[k].text in ("(", "[")) - (head[k].text in (")", "]"))
        if depth <= 0:
            return k + 1
    return len(head)


def _back(head: list[_Token], at: int) -> int:
    depth = 0
    for k in range(at, -1, -1):
        depth += (head[k].text in (")", "]")) - (head[k].text in ("(", "["))
        if depth <= 0:
            return k
    return 0


def _outer(head: list[_Token]) -> list[bool]:
    """Of each place whether it lies outside brackets."""
    out: list[bool] = []
    depth = 0
    for t in head:
        out.append(depth <= 0)
        depth += (t.text in ("(", "[")) - (t.text in (")", "]"))
    return out


def _split(head: list[_Token]) -> list[list[_Token]]:
    """Declarators, at commas outside brackets and template arguments."""
    out: list[list[_Token]] = [[]]
    depth = angle = 0
    for k, t in enumerate(head):
        depth += (t.text in ("(", "[")) - (t.text in (")", "]"))
        if not depth:
            if t.text == "<" and k and head[k - 1].kind == "word":
                angle += 1
            elif t.text in (">", ">>") and angle:
                angle = max(0, angle - len(t.text))
        if t.text == "," and not depth and not angle:
            out.append([])
        else:
            out[-1].append(t)
    return [x for x in out if x]


def _bases(head: list[_Token], at: int) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for part in _split(head[at:]):
        names = [t for t in part if t.kind == "word" and t.text not in ("public", "private", "protected", "virtual")]
        if names and not any(t.text == "<" for t in part):
            out.append((names[0].start, names[-1].end))
    return out


def _type_name(head: list[_Token]) -> _Token | None:
    """The type of a field if it is one plain name."""
    rest = [t for t in head if t.text not in _QUALIFIERS]
    if len(rest) > 1 and rest[0].kind == "word" and rest[0].text not in _TYPES and rest[0].text not in _KEYS and rest[1].text not in ("::", "<", "("):
        return rest[0]
    return None


def _declarator(part: list[_Token], typedef: bool = False, more: bool = False, in_type: bool = False) -> tuple[int, int, bool, int] | None:
    """(first and last token of the name, whether it is a function, where its parameters open), or None.

    more: the type stands before this part, so that a single name is a name.
    """
    words, outer = [t.text for t in part], _outer(part)
    angle = 0
    for k, t in enumerate(part):
        if t.text == "<" and k and part[k - 1].kind == "word" and part[k - 1].text != "operator":
            angle += 1
        elif t.text in (">", ">>") and angle:
            angle = max(0, angle - len(t.text))
        if angle or t.text != "(" or not outer[k]:
            continue
        inner = part[k + 1 : _group(part, k) - 1]
        pointer = [x for x in inner if x.text not in ("const", "volatile", "restrict")]
        if k and "operator" in words[:k]:
            first = words.index("operator")
            if first + 1 == k:
                # operator()
                close = _group(part, k)
                return _qualified(part, first), close - 1, True, close
            if part[first + 1].kind == "word":
                return None
            return _qualified(part, first), k - 1, True, k
        if k == 0 or part[k - 1].kind != "word" or part[k - 1].text in _TYPES or part[k - 1].text in _QUALIFIERS:
            if pointer and pointer[0].text in ("*", "&", "^", "&&") or (len(pointer) > 2 and any(x.text == "*" for x in pointer) and pointer[1].text == "::"):
                names = [j for j, x in enumerate(inner) if x.kind == "word" and x.text not in _QUALIFIERS]
                if not names:
                    return None
                j = k + 1 + names[0]
                function = j + 1 < len(part) and part[j + 1].text == "("
                return j, j, function, j + 1
            continue
        if part[k - 1].text in _NOT_CALLED:
            continue
        if not in_type and inner and inner[0].kind in ("number", "string") and k - 1 > 0:
            return k - 1, k - 1, False, k
        last = k - 1
        return _qualified(part, last - 1 if last and words[last - 1] == "~" else last), last, True, k
    stop = next((k for k, t in enumerate(part) if t.text in ("=", "[", ":") and outer[k]), len(part))
    names = [k for k in range(stop) if part[k].kind == "word" and part[k].text not in _QUALIFIERS and outer[k]]
    if not names or part[names[-1]].text in _TYPES:
        return None
    before = [t for t in part[: names[-1]] if t.text not in ("*", "&", "&&")]
    if not before and not more:
        return None
    if all(t.text in _QUALIFIERS for t in before) and not more and not typedef:
        return None
    if before and before[-1].text in _KEYS:
        return None
    return names[-1] if words[names[-1] - 1 : names[-1]] != ["::"] else _qualified(part, names[-1]), names[-1], False, stop


def _qualified(part: list[_Token], at: int) -> int:
    """Where the qualified name that ends at a place begins."""
    while at >= 2 and part[at - 1].text == "::" and (part[at - 2].kind == "word" or part[at - 2].text == ">"):
        if part[at - 2].text == ">":
            depth, k = 0, at - 2
            while k >= 0:
                depth += (part[k].text == ">") - (part[k].text == "<")
                if depth == 0:
                    break
                k -= 1
            at = max(0, k - 1)
        else:
            at -= 2
    return at


def read(text: str, language: str, path: str, flags: int = 0, seconds: float = 5.0) -> tuple[list[Symbol], list[Reference], bool]:
    """Symbols and references of one file, and whether a limit cut something; TimeoutError if it takes too long."""
    reader = _Reader(text, language, path, flags & (4 | 8 | 16), seconds)
    reader.read()
    for k, s in enumerate(reader.symbols):
        for name in guards(s.condition) if s.condition else ():
            if len(reader.references) >= MOST_REFERENCES:
                reader.truncated = True
                break
            reader.references.append(Reference(k, "GUARDED_BY", name, "", s.start_line, s.start, s.end, 0, 1))
    return reader.symbols, reader.references, reader.truncated
