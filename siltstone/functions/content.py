"""Cleaning and chunking of one text (plain Python, run inside Arrow batches).

Cleaning takes comment blocks, license heads, decorative lines, HTML and MDX noise out of a text
and reports what it took. Chunking cuts a text into disjoint pieces by headings, symbols or lines
under a token budget.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from siltstone.functions.syntax import MOST_ERRORS, Nesting, nesting, split_ranges

# --- comment syntax --------------------------------------------------------------------------------

_C = (("//",), (("/*", "*/"),))
_HASH = (("#",), ())
_MARKUP = ((), (("<!--", "-->"),))
SYNTAX: dict[str, tuple[tuple[str, ...], tuple[tuple[str, str], ...]]] = {
    **dict.fromkeys("rust go typescript javascript solidity swift kotlin csharp java compact".split(), _C),
    **dict.fromkeys("bash toml yaml python ruby".split(), _HASH),
    "scheme": ((";",), (("#|", "|#"),)),
    "haskell": (("--",), (("{-", "-}"),)),
    **dict.fromkeys("html xml".split(), _MARKUP),
}


@dataclass
class Block:
    """A comment that stands by itself: lines [first, last] of the text and its words."""

    first: int
    last: int
    text: str


def _plain(line: str) -> str:
    t = line.strip()
    return t[1:].strip() if t.startswith("*") else t


def line_class(line: str, number: int, language: str) -> str:
    """blank, comment or code."""
    t = line.strip()
    marks, pairs = SYNTAX[language]
    if not t:
        return "blank"
    if number == 0 and t.startswith("#!"):
        return "code"
    if any(t.startswith(m) for m in marks):
        return "comment"
    for a, b in pairs:
        if t.startswith(a):
            inner, closed, after = t[len(a) :].partition(b)
            return "code" if closed and after.strip() else "comment"
    return "code"


def comment_blocks(lines: list[str], language: str) -> list[Block]:
    """Runs of line comments and block comments; a block that ends before code on its line is none."""
    marks, pairs = SYNTAX[language]
    out: list[Block] = []
    i = 0
    while i < len(lines):
        if line_class(lines[i], i, language) != "comment":
            i += 1
            continue
        t = lines[i].strip()
        pair = next((p for p in pairs if t.startswith(p[0])), None)
        if pair is None:
            j = i
            said = []
            while j < len(lines) and line_class(lines[j], j, language) == "comment" and (m := next((m for m in marks if lines[j].strip().startswith(m)), None)):
                said.append(lines[j].strip()[len(m) :].strip())
                j += 1
            out.append(Block(i, j - 1, "\n".join(said).strip()))
            i = j
            continue
        opened, closed = pair
        if closed in t[len(opened) :]:
            out.append(Block(i, i, t[len(opened) :].partition(closed)[0].strip()))
            i += 1
            continue
        said, j, alone = [_plain(t[len(opened) :])], i + 1, True
        while j < len(lines):
            if closed in lines[j]:
                inner, _, after = lines[j].partition(closed)
                said.append(_plain(inner))
                alone = not after.strip()
                break
            said.append(_plain(lines[j]))
            j += 1
        if alone:
            out.append(Block(i, min(j, len(lines) - 1), "\n".join(said).strip()))
        i = j + 1
    return out


def head_blocks(lines: list[str], blocks: list[Block]) -> int:
    """How many of the blocks come before the first line of code."""
    covered = {k for b in blocks for k in range(b.first, b.last + 1)}
    code = next((k for k, x in enumerate(lines) if k not in covered and x.strip() and not (k == 0 and x.startswith("#!"))), len(lines))
    return sum(1 for b in blocks if b.first < code)


# What makes a comment look like a license, and a file generated.
LICENSEISH = re.compile(r"(?i)(copyright|licensed under|license|SPDX-License-Identifier|all rights reserved|permission is hereby granted|warranty)")
GENERATED = re.compile(r"(?i)(@generated|DO NOT EDIT|Code generated by|Auto-?generated( by)?)")
SPDX = re.compile(r"(?im)^\s*SPDX-License-Identifier:\s*(\S[^\r\n]*?)\s*$")
_RUN = re.compile(r"([^\w\s]|_)\1{4,}")


@dataclass
class Cleaned:
    """A cleaned text and what was taken."""

    body: str
    licenses: list[str] = field(default_factory=list)
    generated: bool = False
    taken: dict[str, int] = field(default_factory=dict)

    def take(self, what: str, n: int) -> None:
        if n:
            self.taken[what] = self.taken.get(what, 0) + n


def _size(s: str) -> int:
    return len(s.encode("utf-8", "surrogatepass"))


def tidy(body: str) -> str:
    """Trailing spaces off, runs of blank lines to one, ends trimmed."""
    text = re.sub(r"[^\S\n]+(?=\n|\Z)", "", body)
    return re.sub(r"\n{3,}", "\n\n", text).strip("\n")


def clean_code(body: str, language: str, name: str = "", detect=None) -> Cleaned:
    """License heads, license comments with a tag, and decorative lines out of code. `detect` may
    name the license of a comment text, or give None."""
    if language not in SYNTAX:
        return Cleaned(tidy(body))
    lines = body.split("\n")
    blocks = comment_blocks(lines, language)
    if not name.endswith(".d.ts") and any(b.first < 10 and GENERATED.search(b.text) for b in blocks):
        return Cleaned(body, generated=True)
    out = Cleaned(body)
    heads, gone = head_blocks(lines, blocks), set()
    for k, b in enumerate(blocks):
        text = b.text[:8192]
        if not LICENSEISH.search(text):
            continue
        tag = SPDX.search(text)
        named = tag[1] if tag else (detect(text) if detect else None)
        if k >= heads and not named:
            continue
        if named and named not in out.licenses:
            out.licenses.append(named)
        gone |= set(range(b.first, b.last + 1))
    out.take("license", sum(_size(lines[k]) + 1 for k in gone))
    commented = {k for b in blocks for k in range(b.first, b.last + 1)}
    kept: list[str] = []
    for k, line in enumerate(lines):
        if k in gone:
            continue
        if k in commented and (short := _RUN.sub("", line)) != line:
            if not any(c.isalnum() for c in short):
                out.take("decorative", _size(line) + 1)
                continue
            out.take("decorative", _size(line) - _size(short))
            line = short
        kept.append(line)
    out.body = tidy("\n".join(kept))
    return out


_BADGE = re.compile(r"^\s*(\[!\[[^\]]*\]\([^)]*\)\]\([^)]*\)\s*)+$")
_JSX = re.compile(r"^\s*(</?[A-Z][A-Za-z0-9_.]*(\s[^<>]*)?/?>\s*)+$")


def fenced(lines: list[str]) -> list[bool]:
    """Whether each line belongs to a code fence, its marks included."""
    out, mark, width = [], "", 0
    for line in lines:
        t = line.lstrip()
        m = re.match(r"(`{3,}|~{3,})", t) if len(line) - len(t) <= 3 else None
        if not mark:
            out.append(bool(m))
            if m:
                mark, width = m[1][0], len(m[1])
        else:
            out.append(True)
            if m and m[1][0] == mark and len(m[1]) >= width and not t[len(m[1]) :].strip():
                mark = ""
    return out


def _esm_done(line: str) -> bool:
    t = line.rstrip()
    return t.endswith(";") or t[-1:] in "\"'" and bool(t)


def clean_markdown(body: str, mdx: bool = False) -> Cleaned:
    """Comments, badges, and in MDX imports, exports and lines of tags alone, outside of fences."""
    out = Cleaned(body)
    lines = body.split("\n")
    inside = fenced(lines)
    starts = [0]
    for x in lines:
        starts.append(starts[-1] + len(x) + 1)

    def line_at(p: int) -> int:
        import bisect

        return bisect.bisect_right(starts, p) - 1

    cuts: list[tuple[int, int]] = []
    for opened, closed in (("<!--", "-->"), *((("{/*", "*/}"),) if mdx else ())):
        at = body.find(opened)
        while at >= 0:
            k = line_at(at)
            end = body.find(closed, at)
            ticks = body[starts[k] : at].count("`")
            if end < 0 or inside[k] or ticks % 2 or any(inside[k : line_at(end) + 1]):
                at = body.find(opened, at + len(opened))
                continue
            end += len(closed)
            tail = body.find("\n", end)
            tail = len(body) if tail < 0 else tail
            if not body[starts[k] : at].strip() and not body[end:tail].strip():
                end = min(tail + 1, len(body))
            cuts.append((at, end))
            at = body.find(opened, end)
    out.take("html_comment", sum(_size(body[a:b]) for a, b in cuts))
    i = 0
    while i < len(lines):
        a, b = starts[i], starts[i] + len(lines[i]) + 1
        i += 1
        if inside[i - 1] or any(x < b and a < y for x, y in cuts):
            continue
        line = lines[i - 1]
        if _BADGE.match(line):
            cuts.append((a, b))
            out.take("badge", _size(line) + 1)
        elif mdx and re.match(r"\s*(import[ {]|export )", line):
            n = 1
            while not _esm_done(lines[i - 1]) and n < 20 and i < len(lines) and not inside[i]:
                i, n = i + 1, n + 1
            end = starts[i - 1] + len(lines[i - 1]) + 1
            cuts.append((a, end))
            out.take("mdx_esm", _size(body[a:end]))
        elif mdx and _JSX.match(line):
            cuts.append((a, b))
            out.take("mdx_jsx", _size(line) + 1)
    kept, at = [], 0
    for a, b in sorted(cuts):
        if a >= at:
            kept.append(body[at:a])
        at = max(at, b)
    out.body = tidy("".join(kept) + body[at:])
    return out


def clean(kind: str, path: str, body: str, language: str | None, detect=None) -> Cleaned:
    """By kind; cleaning a cleaned text changes nothing more."""
    name = path.rsplit("/", 1)[-1]
    for _ in range(8):  # until nothing changes; taking one thing may bare another
        got = clean_code(body, language or "", name, detect) if kind == "code" else clean_markdown(body, name.endswith(".mdx")) if kind == "markdown" else Cleaned(tidy(body))
        if _ == 0:
            first = got
        else:
            first.licenses += [x for x in got.licenses if x not in first.licenses]
            for k, v in got.taken.items():
                first.take(k, v)
            first.body = got.body
        if got.generated or got.body == body:
            break
        body = got.body
    return first


def reflow(text: str, width: int = 80) -> str:
    """A text without line breaks, in lines of at most `width` where words allow."""
    if "\n" in text.strip():
        return text
    import textwrap

    return textwrap.fill(text, width, break_long_words=False, break_on_hyphens=False)


# --- chunking --------------------------------------------------------------------------------------

MAX_TOKENS = 1024
_TOKEN = re.compile(r"\w+|[^\w\s]")


def count_tokens(text: str) -> int:
    """Words and marks, and two for the ends."""
    return sum(1 for _ in _TOKEN.finditer(text)) + 2


def fill_target(max_tokens: int) -> int:
    """Tokens to which pieces are filled: 90 %."""
    return max_tokens * 9 // 10


@dataclass
class Chunk:
    content: str
    start: int  # bytes
    end: int
    tokens: int
    headings: list[str] = field(default_factory=list)
    symbols: list[dict] = field(default_factory=list)
    fallback: bool = False


def _windows(text: str, base: int, max_tokens: int, headings: list[str], fallback: bool) -> list[Chunk]:
    """Whole lines, filled to the target; a line above it stands alone."""
    out: list[Chunk] = []
    held, size, start, at = [], 0, base, base
    target = fill_target(max_tokens)

    def flush() -> None:
        nonlocal held, size, start
        piece = "".join(held)
        if piece.strip():
            out.append(Chunk(piece, start, at, count_tokens(piece), list(headings), [], fallback))
        held, size, start = [], 0, at

    for line in re.findall(r"[^\n]*\n|[^\n]+", text):
        n = count_tokens(line) - 2
        if held and size + n + 2 > target:
            flush()
        held.append(line)
        size += n
        at += _size(line)
    flush()
    return out


def line_windows(text: str, max_tokens: int = MAX_TOKENS) -> list[Chunk]:
    return _windows(text, 0, max_tokens, [], True)


_ATX = re.compile(r"^ {0,3}(#{1,6})(?:[ \t]+(.*?))?(?:[ \t]+#+)?[ \t]*$")


def markdown_chunks(text: str, max_tokens: int = MAX_TOKENS) -> list[Chunk]:
    """Sections by heading with the titles above each; small ones join unless the next is higher."""
    lines = re.findall(r"[^\n]*\n|[^\n]+", text)
    inside = fenced([x.rstrip("\n") for x in lines])
    sections: list[tuple[int, list[str], list[str]]] = []  # depth, titles above, lines
    stack: list[tuple[int, str]] = []
    for line, f in zip(lines, inside, strict=True):
        m = None if f else _ATX.match(line.rstrip("\n"))
        if m:
            depth = len(m[1])
            while stack and stack[-1][0] >= depth:
                stack.pop()
            sections.append((depth, [t for _, t in stack], [line]))
            stack.append((depth, (m[2] or "").replace("`", "").replace("*", "").strip()))
        elif sections:
            sections[-1][2].append(line)
        else:
            sections.append((0, [], [line]))
    out: list[Chunk] = []
    i = at = 0
    target = fill_target(max_tokens)
    while i < len(sections):
        depth, above, held = sections[i]
        piece = "".join(held)
        n = count_tokens(piece) - 2
        j = i + 1
        while j < len(sections) and sections[j][0] >= depth:
            more = "".join(sections[j][2])
            m = count_tokens(more) - 2
            if n + m + 2 > target:
                break
            piece, n, j = piece + more, n + m, j + 1
        if piece.strip():
            if n + 2 <= max_tokens:
                out.append(Chunk(piece, at, at + _size(piece), n + 2, above))
            else:
                out += _windows(piece, at, max_tokens, above, False)
        at += _size(piece)
        i = j
    return out


# Declarations by language: kind of symbol and the pattern of its line.
_ID = r"([A-Za-z_$][\w$]*)"
SYMBOLS: dict[str, list[tuple[str, str]]] = {
    "rust": [(k, rf"^\s*(?:pub(?:\([^)]*\))?\s+)?(?:unsafe\s+|async\s+|const\s+|default\s+)*{k}\s+{_ID}") for k in ("mod", "trait", "struct", "enum", "fn")] + [("impl", r"^\s*(?:unsafe\s+)?impl(?:<[^>]*>)?\s+(?:[\w:<>, ]+\s+for\s+)?([A-Za-z_]\w*)")],
    "typescript": [(k, rf"^\s*(?:export\s+)?(?:default\s+)?(?:declare\s+)?(?:abstract\s+)?(?:async\s+)?{k}\*?\s+{_ID}") for k in ("namespace", "class", "interface", "function")] + [("method", rf"^\s+(?:public\s+|private\s+|protected\s+|static\s+|async\s+)*(?!if\b|for\b|while\b|switch\b|return\b|catch\b){_ID}\s*\([^)]*\)\s*(?::[^{{=]+)?\{{\s*$")],
    "javascript": [(k, rf"^\s*(?:export\s+)?(?:default\s+)?(?:async\s+)?{k}\*?\s+{_ID}") for k in ("class", "function")] + [("method", rf"^\s+(?:static\s+|async\s+)*(?!if\b|for\b|while\b|switch\b|return\b|catch\b){_ID}\s*\([^)]*\)\s*\{{\s*$")],
    "python": [("class", rf"^\s*class\s+{_ID}"), ("def", rf"^\s*(?:async\s+)?def\s+{_ID}")],
    "go": [("method", rf"^func\s+\([^)]*\)\s+{_ID}"), ("func", rf"^func\s+{_ID}"), ("type", rf"^type\s+{_ID}")],
    "compact": [(k, rf"^\s*(?:export\s+)?(?:sealed\s+|pure\s+)*{k}\s+{_ID}") for k in ("module", "ledger", "circuit", "witness", "contract", "struct", "enum", "type")] + [("constructor", r"^\s*(constructor)\b")],
    "bash": [("fn", rf"^\s*(?:function\s+)?{_ID}\s*\(\)\s*\{{?")],
    "solidity": [(k, rf"^\s*(?:abstract\s+)?{k}\s+{_ID}") for k in ("contract", "function", "modifier", "struct")],
    "toml": [("key", r"^\s*\[\[?\s*([^\]]+?)\s*\]\]?")],
    "yaml": [("key", r"^([A-Za-z_][\w.-]*)\s*:")],
    "html": [("element", r"^\s*<([A-Za-z][\w-]*)")],
    "xml": [("element", r"^\s*<([A-Za-z][\w:.-]*)")],
    "swift": [(k, rf"^\s*(?:public\s+|private\s+|open\s+|internal\s+|final\s+|static\s+)*{k}\s+{_ID}") for k in ("class", "func", "protocol")],
    "ruby": [(k, rf"^\s*{k}\s+(?:self\.)?([A-Za-z_][\w:?!]*)") for k in ("class", "module", "def")],
    "kotlin": [(k, rf"^\s*(?:public\s+|private\s+|internal\s+|open\s+|data\s+|override\s+|suspend\s+)*{k}\s+{_ID}") for k in ("class", "object", "fun")],
    "csharp": [(k, rf"^\s*(?:public\s+|private\s+|protected\s+|internal\s+|static\s+|sealed\s+|abstract\s+|partial\s+)*{k}\s+([A-Za-z_][\w.]*)") for k in ("namespace", "class", "interface")] + [("method", rf"^\s*(?:public|private|protected|internal)\s+(?:static\s+|async\s+|override\s+|virtual\s+)*[\w<>\[\],.? ]+\s+{_ID}\s*\(")],
    "java": [(k, rf"^\s*(?:public\s+|private\s+|protected\s+|static\s+|final\s+|abstract\s+)*{k}\s+{_ID}") for k in ("class", "interface")] + [("method", rf"^\s*(?:public|private|protected)\s+(?:static\s+|final\s+|synchronized\s+)*[\w<>\[\],.? ]+\s+{_ID}\s*\(")],
    "haskell": [("data", rf"^(?:data|newtype)\s+{_ID}"), ("class", rf"^class\s+(?:[^=]*=>\s*)?{_ID}"), ("fn", rf"^{_ID}\s*::")],
    "scheme": [],
}
_SYMBOL_RE = {k: [(kind, re.compile(p)) for kind, p in v] for k, v in SYMBOLS.items()}
_MARK = {"python": "#", "bash": "#", "toml": "#", "yaml": "#", "ruby": "#", "haskell": "--", "scheme": ";"}


def symbols_of(lines: list[str], language: str, depths: list[int] | None = None) -> list[tuple[int, int, dict]]:
    """(line, depth, symbol with the path of those around it) of each declaration. Depth is that of the
    nesting, or of indentation without it."""
    found: list[tuple[int, int, dict]] = []
    stack: list[tuple[int, str]] = []
    for k, line in enumerate(lines):
        if not line.strip():
            continue
        for kind, p in _SYMBOL_RE.get(language, []):
            if m := p.match(line):
                depth = len(line) - len(line.lstrip()) if depths is None else depths[k]
                while stack and stack[-1][0] >= depth:
                    stack.pop()
                stack.append((depth, m[1]))
                found.append((k, depth, {"kind": kind, "name": m[1], "path": [n for _, n in stack]}))
                break
    return found


def symbol_path_at(found: list[tuple[int, int, dict]], depths: list[int], line: int) -> list[str]:
    """Names of the declarations that enclose a line, outermost first."""
    deepest = depths[line]
    out: list[str] = []
    for k, depth, s in reversed(found):
        if k < line and depth < deepest:
            out.insert(0, s["name"])
            deepest = depth
    return out


def code_chunks(text: str, language: str, name: str = "", max_tokens: int = MAX_TOKENS) -> list[Chunk]:
    """Pieces cut where the text is nested least, small neighbours joined, each with its symbols; a piece
    inside a symbol gets a comment line that names where it stands. A text whose brackets, comments and
    strings mostly don't fit together falls back to line windows."""
    if language not in _SYMBOL_RE:
        return line_windows(text, max_tokens)
    lines = re.findall(r"[^\n]*\n|[^\n]+", text)
    plain = [x.rstrip("\n") for x in lines]
    nest = nesting("\n".join(plain), language, *SYNTAX[language]) if language in SYNTAX else Nesting([len(x) - len(x.lstrip()) for x in plain])
    if nest.error_share > MOST_ERRORS:
        return line_windows(text, max_tokens)
    depths = nest.depths
    found = symbols_of(plain, language, depths)
    totals = [0]
    for x in lines:
        totals.append(totals[-1] + count_tokens(x) - 2)
    target = fill_target(max_tokens)
    groups = split_ranges(depths, [bool(x.strip()) for x in plain], lambda a, b: totals[b] - totals[a] + 2, target)
    offsets = [0]
    for x in lines:
        offsets.append(offsets[-1] + _size(x))
    out: list[Chunk] = []
    for a, b in groups:
        piece = "".join(lines[a:b])
        if not piece.strip():
            continue
        first = next(k for k in range(a, b) if plain[k].strip())
        inner = [s for k, _, s in found if a <= k < b]
        around = symbol_path_at(found, depths, first)
        outer = next((s for k, _, s in reversed(found) if k < a and s["path"] == around), None)
        parts = [Chunk(piece, offsets[a], offsets[b], count_tokens(piece))] if count_tokens(piece) <= max_tokens else _windows(piece, offsets[a], max_tokens, [], False)
        for c in parts:
            c.symbols = inner or ([outer] if outer else [])
            if around:
                c.content = f"{_MARK.get(language, '//')} {' > '.join([name, *around] if name else around)}\n{c.content}"
                c.tokens = count_tokens(c.content)
            out.append(c)
    return out


def chunk(kind: str, path: str, body: str, language: str | None, max_tokens: int = MAX_TOKENS) -> list[Chunk]:
    """By kind; whatever fails falls back to line windows."""
    if not body.strip():
        return []
    try:
        if kind == "markdown":
            return markdown_chunks(body, max_tokens)
        if kind == "code" and language in _SYMBOL_RE:
            return code_chunks(body, language, path.rsplit("/", 1)[-1], max_tokens)
    except (ValueError, IndexError, RecursionError):
        pass
    return line_windows(body, max_tokens)
