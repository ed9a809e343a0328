"""Ignore rules of version control: the last matching rule of the deepest file decides."""

from __future__ import annotations

import re
import unicodedata
from typing import NamedTuple

MOST_RULES, MOST_LINE = 10_000, 4096


class Rule(NamedTuple):
    pattern: re.Pattern
    keep: bool
    directories_only: bool


def _glob(text: str) -> str:
    out, k = [], 0
    while k < len(text):
        c = text[k]
        if c == "*":
            while k + 1 < len(text) and text[k + 1] == "*":
                k += 1
            out.append("[^/]*")
        elif c == "?":
            out.append("[^/]")
        elif c == "[":
            end = text.find("]", k + (3 if text[k + 1 : k + 2] in ("!", "^") else 2))
            if end < 0:
                out.append(r"\[")
            else:
                body = text[k + 1 : end]
                negated = body[:1] in ("!", "^")
                out.append("(?!/)[" + ("^" if negated else "") + (body[1:] if negated else body).replace("\\", "\\\\").replace("[", r"\[") + "]")
                k = end
        elif c == "\\" and k + 1 < len(text):
            k += 1
            out.append(re.escape(text[k]))
        else:
            out.append(re.escape(c))
        k += 1
    return "".join(out)


def parse(lines: list[str]) -> list[Rule]:
    rules: list[Rule] = []
    for n, raw in enumerate(lines):
        line = unicodedata.normalize("NFC", raw.removeprefix("﻿") if n == 0 else raw).rstrip("\r\n")
        if len(line.encode()) > MOST_LINE or len(rules) >= MOST_RULES:
            continue
        while line.endswith(" ") and not line.endswith("\\ "):
            line = line[:-1]
        if not line or line.startswith("#"):
            continue
        keep = line.startswith("!")
        line = line[1:] if keep or line[:2] in (r"\#", r"\!") else line
        directories = line.endswith("/")
        line = line.rstrip("/") if directories else line
        if not line or line == ".." or line.startswith("../"):
            continue
        anchored = "/" in line
        segments = line.lstrip("/").split("/")
        if not anchored:
            segments = ["**", *segments]
        regex = ""
        for k, s in enumerate(segments):
            last = k == len(segments) - 1
            if s == "**":
                regex += ".+" if last else "(?:.*/)?"
            else:
                regex += _glob(s) + ("" if last else "/")
        try:
            rules.append(Rule(re.compile(regex + r"\Z", re.S), keep, directories))
        except re.error:
            continue
    return rules


def decide(rule_sets: list[tuple[int, list[Rule]]], segments: list[str], directory: bool) -> str:
    """'ignored', 'kept' or 'none' for a path; rule_sets holds (depth of the ignore file, its rules), outermost first."""
    for depth, rules in reversed(rule_sets):
        path = "/".join(segments[depth:])
        for rule in reversed(rules):
            if (directory or not rule.directories_only) and rule.pattern.match(path):
                return "kept" if rule.keep else "ignored"
    return "none"
