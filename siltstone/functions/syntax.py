"""Nesting of source text without a grammar: comments, strings, brackets and indentation give each line a
depth, ranges to split along, and the bytes that don't fit together."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import lru_cache

INDENTED = frozenset(["python", "yaml", "haskell"])  # blocks by indentation
OPEN, CLOSE = "([{", ")]}"
MOST_ERRORS = 0.5  # share of bytes above which a text isn't split along its nesting

_STRINGS = r"\"(?:[^\"\\\n]|\\.)*\""
_SINGLE = r"|'(?:[^'\\\n]|\\.)*'"
_TEMPLATE = r"|`(?:[^`\\]|\\.)*`"
_TRIPLE = r"\"\"\"(?:[^\\]|\\.)*?\"\"\"|'''(?:[^\\]|\\.)*?'''|"
_CHAR = r"|'(?:[^'\\\n]|\\[^\n]{1,8}?)'"  # a quote that isn't one is a lifetime or a mark of its own


@dataclass
class Nesting:
    """Depth at the first token of each line, and the bytes of lines that hold an unmatched bracket or follow
    an open comment or string."""

    depths: list[int] = field(default_factory=list)
    errors: int = 0
    size: int = 0

    @property
    def error_share(self) -> float:
        return self.errors / self.size if self.size else 0.0


@lru_cache(64)
def _tokens(language: str, lines: tuple[str, ...], blocks: tuple[tuple[str, str], ...]) -> re.Pattern:
    parts = [rf"(?P<open>{re.escape(a)})(?:.*?{re.escape(b)}|(?P<rest>.*)\Z)" for a, b in blocks[:1]]
    parts += [rf"{re.escape(m)}[^\n]*" for m in lines]
    quotes = _STRINGS + (_CHAR if language in ("rust", "haskell") else "" if language in ("scheme",) else _SINGLE)
    if language in ("javascript", "typescript", "go"):
        quotes += _TEMPLATE
    if language == "python":
        quotes = _TRIPLE + quotes
    return re.compile("(?s:" + "|".join([*parts, quotes]) + r")|(?P<b>[()\[\]{}])")


def nesting(text: str, language: str, lines: tuple[str, ...] = ("//",), blocks: tuple[tuple[str, str], ...] = (("/*", "*/"),)) -> Nesting:
    """The nesting of a text with the given marks of comments."""
    rows = text.split("\n")
    starts = [0]
    for r in rows:
        starts.append(starts[-1] + len(r) + 1)
    change = [0] * (len(rows) + 1)  # depth gained by brackets on each line
    lead = [0] * len(rows)  # closing brackets that begin a line
    bad: set[int] = set()
    stack: list[tuple[str, int]] = []
    line = 0
    for m in _tokens(language, tuple(lines), tuple(blocks)).finditer(text):
        while m.start() >= starts[line + 1]:
            line += 1
        got = m.groupdict()
        if got.get("rest") is not None:  # a comment that never ends
            bad.update(range(line, len(rows)))
            break
        b = m["b"]
        if b is None:
            continue
        if b in OPEN:
            stack.append((b, line))
            change[line] += 1
            continue
        want = OPEN[CLOSE.index(b)]
        if not stack or stack[-1][0] != want:
            near = next((k for k in range(len(stack) - 1, -1, -1) if stack[k][0] == want), None)
            if near is None:  # closes nothing
                bad.add(line)
                continue
            bad.update(at for _, at in stack[near + 1 :])  # what was left open inside
            for _, at in stack[near + 1 :]:
                change[at] -= 1
            del stack[near + 1 :]
        stack.pop()
        change[line] -= 1
        if not text[starts[line] : m.start()].strip(" \t)]}"):
            lead[line] += 1
    for _, at in stack:
        bad.add(at)
        change[at] -= 1
    depths, depth = [], 0
    indents = [0]
    for k, r in enumerate(rows):
        if language in INDENTED:
            width = len(r) - len(r.lstrip())
            if r.strip() and depth == 0:
                while indents and indents[-1] > width:
                    indents.pop()
                if not indents or indents[-1] < width:
                    indents.append(width)
            depths.append(depth + len(indents) - 1 if indents else depth)
        else:
            depths.append(max(0, depth - lead[k]))
        depth = max(0, depth + change[k])
    return Nesting(depths, sum(len(rows[k].encode("utf-8", "surrogatepass")) + 1 for k in bad), sum(len(r.encode("utf-8", "surrogatepass")) + 1 for r in rows))


def split_ranges(depths: list[int], filled: list[bool], cost: Callable[[int, int], int], budget: int) -> list[tuple[int, int]]:
    """Ranges of lines within the budget, cut where the text is nested least: first between the outermost
    constructs, then inside of those that are too large, small neighbours joined up to the budget. A
    range that can't be cut (one line) stays as it is."""

    def cut(a: int, b: int) -> list[tuple[int, int]]:
        if b - a <= 1 or cost(a, b) <= budget:
            return [(a, b)]
        inner = [k for k in range(a + 1, b) if filled[k]]
        if not inner:
            return [(a, b)]
        least = min(depths[k] for k in inner)
        edges = [a, *(k for k in inner if depths[k] == least), b]
        parts: list[tuple[int, int]] = []
        for x, y in zip(edges, edges[1:], strict=False):
            for piece in cut(x, y) if (x, y) != (a, b) else [(x, y)]:
                if parts and cost(parts[-1][0], piece[1]) <= budget:
                    parts[-1] = (parts[-1][0], piece[1])
                else:
                    parts.append(piece)
        return parts

    return cut(0, len(depths)) if depths else []
