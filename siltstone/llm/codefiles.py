"""Generated, minified, third-party and data files among code files.

Each code file is lexed (comments, strings, numbers, words, punctuation) and its tokens are laid out
anew in a canonical form: one statement or block edge a line, brackets longer than `WIDTH` broken,
fixed spacing, indentation by depth. Line breaks, spaces and indentation of the file are compared
with that form:

* data: `LITERALS` of the code characters, or more, lie in string and number literals;
* minified: the canonical form has `EXPANSION` times the lines of the file, or more, and at least
  `LEAST_CANONICAL`, or the file lacks `MISSING` of the white space of that form;
* generated: a comment at the head declares a generator, or one shape (literals and names replaced)
  makes up `UNIFORM` of the statements of the canonical form, imports aside, of which there are
  `LEAST_STATEMENTS` or more, or, in files of `CANONICAL_LINES` or more, `CANONICAL_UNIFORM` of them
  where `AGREEMENT` of the layout is canonical. Agreement alone decides nothing: formatted
  hand-written files have it. Elements of one list are no statements, so lists and enumerations
  aren't uniform;
* third_party: a directory of the path is one where third-party code is kept, a comment at the head
  says the file comes from elsewhere, or the bytes equal those of a file in such a directory.

Words of a marker inside a string, or a path that only resembles one, decide nothing.

Defined cases: null paths are no code. Empty files are hand-written unless their directory is
third-party, and are no copies. A document without its file is judged by its path. Repeated rows
count once. Extra columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.llm.common import clean_path, decode
from siltstone.session import ship, table

# Extensions of code files, directories of third-party code.
CODE_EXTENSIONS = "ts tsx mts cts js jsx mjs cjs rs go py pyi compact sol java kt kts scala c h cc cpp cxx hpp hh cs rb php swift lua dart sh bash pl r jl ex exs erl hs ml zig nim vue svelte css scss sql".split()
THIRD_PARTY_DIRS = "third_party third-party thirdparty 3rdparty vendor vendored node_modules bower_components external externals deps".split()

EXPANSION, LEAST_CANONICAL, LITERALS, UNIFORM, LEAST_STATEMENTS = 4.0, 12, 0.62, 0.75, 10
WIDTH, MISSING, LEAST_WHITE, AGREEMENT, CANONICAL_UNIFORM, CANONICAL_LINES = 100, 0.9, 20, 0.99, 0.6, 30
HASH_COMMENTS = frozenset("py pyi rb sh bash pl r jl ex exs nim".split())

# Comments by extension; C's (//, /* */) where nothing is named. A shebang, an open tag of php and the
# section tags of vue and svelte stand before the code like comments.
_SLASHES, _BLOCK, _HASH, _DASHES = r"//[^\n]*", r"/\*.*?(?:\*/|\Z)", r"\#[^\n]*", r"--[^\n]*"
_DOCSTRING = r"|(?P<d>(?:\"{3}.*?(?:\"{3}|\Z))|(?:'{3}.*?(?:'{3}|\Z)))"
_C_STYLE = f"{_SLASHES}|{_BLOCK}"
_TAGS = rf"<!--.*?(?:-->|\Z)|</?(?:script|style|template)\b[^>]*>|{_C_STYLE}"
_COMMENTS = {e: _HASH for e in HASH_COMMENTS} | {
    "jl": rf"\#=.*?(?:=\#|\Z)|{_HASH}", "nim": rf"\#\[.*?(?:\]\#|\Z)|{_HASH}", "rb": rf"^=begin\b.*?(?:^=end\b[^\n]*|\Z)|{_HASH}", "pl": rf"^=[a-z]\w*.*?(?:^=cut\b[^\n]*|\Z)|{_HASH}",
    "sql": f"{_DASHES}|{_BLOCK}", "lua": rf"--\[(?P<eq>=*)\[.*?(?:\](?P=eq)\]|\Z)|{_DASHES}", "hs": rf"\{{-.*?(?:-\}}|\Z)|--+(?![!#$%&*+./<=>?@\\^|~:])[^\n]*", "erl": r"%[^\n]*", "ml": r"\(\*.*?(?:\*\)|\Z)",
    "css": _BLOCK, "php": rf"<\?(?:php\b|=)|\?>|{_C_STYLE}|\#(?!\[)[^\n]*", "vue": _TAGS, "svelte": _TAGS,
}
_REST = r"|(?P<s>\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'|`(?:[^`\\]|\\.)*`)|(?P<n>[-+]?\b\d[\w.]*)|(?P<w>[^\W\d]\w*)|(?P<p>[^\s\w])"
LEXERS = {e: re.compile(rf"(?P<c>\A\#!(?!\[)[^\n]*|{_COMMENTS.get(e, _C_STYLE)})" + (_DOCSTRING if e in HASH_COMMENTS else "") + _REST, re.S | re.M) for e in CODE_EXTENSIONS}

_GENERATED = re.compile(r"@generated\b|<auto-?generated|\bauto-?generated (?:by|from)\b|\bcode generated by\b|\bmachine-made output\b|\bgenerated file\b.*\bdo not (?:modify|edit)\b|\bautomatically (?:created|generated)\b|\bwas (?:written|generated) by\b.*\b(?:change|edit)s? will be (?:lost|overwritten)\b|\bdo not edit\b", re.I)
_NOT_GENERATED = re.compile(r"no longer a generated|first generated by|is not\b|checks? that", re.I)
_ELSEWHERE = re.compile(r"^\W*(?:third-party (?:source|code)\s*:|vendored from\b|(?:copied|taken|imported|mirrored|pulled)(?: (?:verbatim|unchanged|unmodified|as is))? (?:from|out of)\b.*\b(?:upstream|kept in sync|at tag|project|repository|release|commit|version|v?\d+\.\d+))", re.I)
_IMPORTS = frozenset("import from use using require include mod package extern".split())


_OPENS, _CLOSES = "([{", ")]}"
_SPACED = frozenset("= == === != !== += -= *= /= %= |= &= ^= => -> && || <= >= := ?? <- ~= ..= <<= >>= **= //= =~ |>".split())
_CONTINUES = frozenset("else elif catch finally while except rescue ensure from as".split())
_BEFORE_PAREN = frozenset("if for while switch catch return in of and or not match when elif unless until case await yield else new throw typeof import let var const mut".split())
_BLOCK_HEADS = frozenset("if elif else for while def class try except finally with async match case".split())
_BEFORE_LITERAL = frozenset("import export return from in of default use var let const yield await case".split())


def _lex(text: str, extension: str) -> tuple[list[list], Counter[str], list[str]]:
    """Tokens as [kind, text, line feeds before, white space before, column]; characters by kind;
    the lines of the comments at the head. Runs of operator signs are one token."""
    tokens: list[list] = []
    chars: Counter[str] = Counter()
    head: list[str] = []
    at = feeds = 0
    blank = commented = False
    for m in LEXERS[extension].finditer(text):
        kind, got, start = m.lastgroup, m.group(), m.start()
        if at < start:
            blank = True
            feeds += text.count("\n", at, start)
        at = m.end()
        if kind == "c" or (kind == "d" and not chars):
            if not chars:
                head += got.splitlines()
            feeds += got.count("\n")
            commented = True
            continue
        kind = "s" if kind == "d" else kind
        chars[kind] += len(got)
        if kind == "p":
            if got not in "()[]{},;.":
                kind = "o"
                if tokens and not blank and not commented and tokens[-1][0] == "o":
                    tokens[-1][1] += got
                    continue
        # where a comment stands between, only the line break can be compared
        tokens.append([kind, got, feeds, None if commented else blank, start - text.rfind("\n", 0, start) - 1 if feeds else 0])
        feeds, blank, commented = 0, False, False
    return tokens, chars, head


def _space(a: list, b: list, operand: bool, square: bool, bracket: bool, hashed: bool) -> bool | None:
    """Whether the canonical form has a space between two tokens of a line; None where either is right."""
    ka, ta, kb, tb = a[0], a[1], b[0], b[1]
    if tb in ",;" or tb in ")]" or ta in "([":
        return False
    if ta in ",;":
        return True
    if ta == "." or tb == ".":
        return None if ka == "o" or kb == "o" else False
    if ta == "{" or tb == "}":
        return None
    if tb == "{":
        return True if ta == ")" or ka == "w" else None
    if tb in "([":
        if ka == "w":
            return True if ta in _BEFORE_PAREN and tb == "(" else None if ta in _BEFORE_PAREN or tb == "[" else False
        if ka != "o":
            return False if ta in ")]" else None
    for k, t, other in ((ka, ta, kb), (kb, tb, ka)):
        if k == "o" and t in _SPACED:
            return None if t == "=" and (hashed and bracket) else True
    if ka == "o":
        if ta == ":":
            return None if square else True
        if ta in "+-":
            return operand
        return True if ta in "/%" and operand else None
    if kb == "o":
        return True if tb in "+-/%" and (ka in "wsn" or ta in ")]") else None
    if ta == "}":
        return None if tb in _CLOSES else True
    return True if ka in "wsn" and kb in "wsn" and "s" not in (ka, kb) else None


def _statements(tokens: list[list], hashed: bool) -> tuple[list[int | None], list[int], list[int]]:
    """Gaps before each token where nothing is too long for a line (0 nothing, 1 a space, 2 a line
    break, None either of the first two), the match of each bracket (-1: none) and the depth of
    blocks. A line holds one statement or block edge."""
    n = len(tokens)
    gaps: list[int | None] = [2] + [0] * (n - 1)
    match, depth = [-1] * n, [0] * n
    stack: list[tuple[int, bool]] = []
    closed = colon = False
    blocks = 0
    for i, b in enumerate(tokens):
        kind, got = b[0], b[1]
        a = tokens[i - 1] if i else b
        ended = None
        if kind == "p" and got in _CLOSES and stack:
            j, ended = stack.pop()
            match[i], match[j] = j, i
            blocks -= ended
        level = not stack or stack[-1][1]
        if i:
            ta = a[1]
            if ended is not None:
                gaps[i] = (2 if match[i] < i - 1 else None) if ended else (None if got == "}" else 0)
            elif level and (ta == ";" or (ta == "{" and stack and stack[-1][0] == i - 1) or (colon and ta == ":")):
                gaps[i] = 2
            elif level and ta == "}" and closed and not (got in _CONTINUES or got in ".,;" or kind == "o"):
                gaps[i] = 2
            elif level and b[2] and (a[0] in "wsn" or ta in _CLOSES) and got not in ".,;" and (kind != "o" or got[0] in "@#*&-!~$<"):
                gaps[i] = 2  # the line break ends the statement
            else:
                before = tokens[i - 2] if i > 1 else None
                operand = before is not None and (before[0] in "wsn" or before[1] in ")]")
                s = _space(a, b, operand, bool(stack) and tokens[stack[-1][0]][1] == "[", not level, hashed)
                gaps[i] = None if s is None else int(s)
        if level and gaps[i] == 2 and ended is None:
            colon = hashed and got in _BLOCK_HEADS
        depth[i], closed = blocks, bool(ended)
        if kind == "p" and got in _OPENS:
            is_block = got == "{" and (gaps[i] == 2 or a[1] in ("=>", ")", "]", "->") or (a[0] in "wsn" and a[1] not in _BEFORE_LITERAL) or (a[0] == "o" and a[1][-1] == ">"))
            stack.append((i, is_block))
            blocks += is_block
    return gaps, match, depth


def _broken(tokens: list[list], gaps: list[int | None], match: list[int], depth: list[int]) -> None:
    """Break what is longer than `WIDTH`: a bracket, else a statement, gets an element a line; where
    the elements are single tokens, as many as fit. Depths of inner lines are put into `depth`."""
    n = len(tokens)
    ends, flat, widths = [0] * n, [0] * (n + 1), [0] * n
    end = n
    for i in range(n - 1, -1, -1):
        ends[i] = end
        if gaps[i] == 2:
            end = i
    for i, t in enumerate(tokens):
        widths[i] = len(t[1]) + (1 if gaps[i] == 1 or (gaps[i] is None and t[3]) else 0)
        flat[i + 1] = flat[i] + widths[i]
    open_: list[tuple[int, bool, bool, int]] = []  # match, breaks, is filled, depth outside
    column = extra = 0
    wide = False
    for i, t in enumerate(tokens):
        got = t[1]
        while open_ and i >= open_[-1][0]:
            at, breaks, _, outer = open_.pop()
            extra = outer
            if at == i and breaks and gaps[i] != 2:
                gaps[i], column = 2, 2 * (depth[i] + extra)
        if gaps[i] == 2:
            if not open_:
                wide = flat[ends[i]] - flat[i] + 2 * depth[i] > WIDTH
            column = 2 * (depth[i] + extra)
        elif i and tokens[i - 1][1] == "," and (open_[-1][1] if open_ else wide):
            if not open_ or not open_[-1][2] or column + widths[i] + 1 > WIDTH:
                gaps[i], column = 2, 2 * (depth[i] + extra)
        elif i and open_ and open_[-1][1] and match[i - 1] == open_[-1][0]:
            gaps[i], column = 2, 2 * (depth[i] + extra)
        depth[i] += extra
        column += widths[i]
        if got in _OPENS and match[i] > i:
            j = match[i]
            inner = ends[i] > j or gaps[j] != 2  # no block of statements
            breaks = inner and column + flat[j + 1] - flat[i + 1] > WIDTH and j > i + 1
            filled = breaks and all(tokens[k][1] == "," or tokens[k - 1][1] in ",([{" or tokens[k - 1][1] in "+-" for k in range(i + 1, j))
            open_.append((j, breaks, filled, extra))
            extra += breaks


def layout(text: str, extension: str) -> dict[str, float]:
    """What the comparison of the layouts gives.

    expansion: lines of the canonical form by lines of the file; missing: share of the white space of
    the canonical form that the file lacks; agreement: share of line breaks, spaces and indentations
    that are those of the canonical form; gaps: how many were compared. Besides, literals, uniform,
    lines, canonical (its lines), statements, marker, elsewhere."""
    hashed = extension in HASH_COMMENTS
    tokens, chars, head = _lex(text, extension)
    code = sum(chars.values())
    out = {
        "expansion": 0.0, "missing": 0.0, "agreement": 0.0, "gaps": 0, "white": 0, "uniform": 0.0, "lines": 0, "canonical": 0, "statements": 0,
        "literals": (chars["s"] + chars["n"]) / code if code else 0.0,
        "marker": any(_GENERATED.search(x) and not _NOT_GENERATED.search(x) for x in head),
        "elsewhere": any(_ELSEWHERE.search(x) for x in head),
    }
    if not tokens:
        return out
    gaps, match, depth = _statements(tokens, hashed)
    shapes = Counter(_shapes(tokens, gaps))
    _broken(tokens, gaps, match, depth)
    lines = 1 + sum(t[2] > 0 for t in tokens[1:])
    starts = [t[4] for t in tokens if t[2]]
    unit = min((c for c in starts if c), default=1)
    compared = same = white = missing = 0
    for i in range(1, len(tokens)):
        a, b, want = tokens[i - 1], tokens[i], gaps[i]
        had = 2 if b[2] else b[3]
        if want == 2 or (want == 1 and not (a[0] in "wn" and b[0] in "wn")):
            if had is not None and had != 2:  # kept line breaks may be syntax
                white += 1
                missing += not had
        if want == 2 or had == 2:
            compared += 1
            same += want == had
            if want == had == 2 and not hashed:
                # indentation, and no empty line inside of a block
                compared += 1
                same += b[4] == unit * depth[i] and (b[2] == 1 or not depth[i] or b[3] is None)
        elif want is not None and had is not None:
            compared += 1
            same += want == had
    statements, canonical = sum(shapes.values()), sum(g == 2 for g in gaps)
    out |= {"expansion": canonical / lines, "canonical": canonical, "statements": statements, "missing": missing / white if white else 0.0, "agreement": same / compared if compared else 0.0, "gaps": compared, "white": white, "uniform": max(shapes.values()) / statements if shapes else 0.0, "lines": lines}
    return out


def _shapes(tokens: list[list], gaps: list[int | None]) -> Iterator[str]:
    """The statements of the canonical form with names and literals replaced, without imports."""
    line: list[list] = []
    for t, gap in zip([*tokens, None], [*gaps, 2], strict=True):
        if gap == 2 and line:
            first = [x[1] for x in line[:2]]
            if not (_IMPORTS.intersection(first) or (first[0] == "export" and any(x[1] == "from" for x in line))):
                yield "".join(x[0].upper() if x[0] in "wsn" else x[1] for x in line)
            line = []
        line.append(t)


def judge(text: str, extension: str) -> str | None:
    """minified, data, generated, third_party, or None for hand-written."""
    m = layout(text, extension)
    if m["elsewhere"]:
        return "third_party"
    if m["literals"] >= LITERALS:
        return "data"
    if (m["expansion"] >= EXPANSION and m["canonical"] >= LEAST_CANONICAL) or (m["missing"] >= MISSING and m["white"] >= LEAST_WHITE):
        return "minified"
    canonical = m["agreement"] >= AGREEMENT and m["lines"] >= CANONICAL_LINES and m["uniform"] >= CANONICAL_UNIFORM
    if m["marker"] or canonical or (m["uniform"] >= UNIFORM and m["statements"] >= LEAST_STATEMENTS):
        return "generated"
    return None


def extension_of(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))


def in_third_party(path: Column) -> Column:
    return F.lower(path).rlike(r"(^|/)(" + "|".join(map(re.escape, THIRD_PARTY_DIRS)) + r")/")


def _judge_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        verdicts = [judge(decode(c), e) for c, e in zip(b.column("content").to_pylist(), b.column("ext").to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays([b.column("scope"), b.column("path"), b.column("sha"), pa.array(verdicts, pa.string())], names=["scope", "path", "sha", "verdict"])


def classify_files(files: DataFrame, scope_col: str, path_col: str, content_col: str) -> DataFrame:
    """(scope, path, verdict) of the code files that aren't hand-written; scope is the snapshot."""
    ship(files.sparkSession)
    path = clean_path(F.col(path_col).cast("string"))
    code = files.select(F.col(scope_col).cast("string").alias("scope"), path.alias("path"), F.col(content_col).cast("binary").alias("content")).withColumn("ext", extension_of(F.col("path"))).where(F.col("ext").isin(CODE_EXTENSIONS))
    sha = F.when(F.length("content") > 0, F.sha2("content", 256))
    judged = code.withColumn("sha", sha).mapInArrow(_judge_batches, "scope string, path string, sha string, verdict string").distinct()
    judged = judged.withColumn("third", in_third_party(F.col("path")))
    # hashes of third-party files come from the files again, in the JVM: nothing is lexed twice
    kept = code.where(in_third_party(F.col("path"))).select(sha.alias("sha")).where("sha is not null").groupBy("sha").agg(F.lit(True).alias("copy"))
    verdict = F.when(F.col("third") | F.coalesce("copy", F.lit(False)), F.lit("third_party")).otherwise(F.col("verdict"))
    return judged.join(kept, "sha", "left").select("scope", "path", verdict.alias("verdict")).where("verdict is not null").distinct()


def not_handwritten(docs: DataFrame, files: DataFrame) -> DataFrame:
    """(id, verdict) of the documents that are such files."""
    flagged = classify_files(files, "source_version_id", "path", "content")
    d = docs.select("id", F.col("source_version_id").alias("scope"), clean_path(F.col("source_path")).alias("path")).where("id is not null").distinct()
    d = d.where(extension_of(F.col("path")).isin(CODE_EXTENSIONS))
    verdict = F.coalesce("verdict", F.when(in_third_party(F.col("path")), F.lit("third_party")))
    return d.join(flagged, ["scope", "path"], "left").select("id", verdict.alias("verdict")).where("verdict is not null").distinct()


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return not_handwritten(table(spark, sf_dir, "new_document"), table(spark, sf_dir, "source_file")).select("id").distinct()


def p5_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts by verdict over the whole corpus."""
    found = not_handwritten(table(spark, sf_dir, "new_document"), table(spark, sf_dir, "source_file"))
    return found.groupBy("verdict").agg(F.count_distinct("id").alias("n_documents"))
