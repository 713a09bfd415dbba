"""Text, path, hash and identifier functions as columns (all run in the JVM)."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- hashes ----------------------------------------------------------------------------------------


def normalised_text(text: Column) -> Column:
    """Line feeds only, trailing white space of each line and blank lines at the end dropped, one
    final line feed. Text without content is a single line feed."""
    unix = F.regexp_replace(text, "\r\n", "\n")
    trimmed = F.regexp_replace(unix, r"(?m)[^\S\n]+$", "")
    return F.concat(F.regexp_replace(trimmed, r"\n+\z", ""), F.lit("\n"))


def hash_input(front: Column, body: Column) -> Column:
    """What a document hash covers: verbatim front matter, NUL, body."""
    return F.concat(F.coalesce(front, F.lit("")), F.lit("\0"), body)


def document_hash(text: Column) -> Column:
    return F.sha2(normalised_text(text), 256)


def chunk_hash(text: Column) -> Column:
    """Of the text as it is."""
    return F.sha2(text, 256)


def clean_hash(h: Column) -> Column:
    """A stored hash without prefix, in lower case; null where it is no SHA-256."""
    c = F.regexp_replace(F.lower(F.trim(h)), r"^sha-?256[:=]", "")
    return F.when(c.rlike("^[0-9a-f]{64}$"), c)


# --- front matter and white space ------------------------------------------------------------------

_FENCE = r"(?s)\A---[ \t]*\n(.*?)\n---[ \t]*(?:\n|\z)"


def unix_text(text: Column) -> Column:
    """Byte-order mark off, CRLF to LF; a leading fence stays (for files that aren't Markdown)."""
    return F.regexp_replace(F.regexp_replace(text, "\\A\\x{FEFF}", ""), "\r\n", "\n")


def front_matter(text: Column) -> Column:
    """The YAML between the fences, or null."""
    u = unix_text(text)
    return F.when(u.rlike(_FENCE), F.regexp_extract(u, _FENCE, 1))


def body_after_front_matter(text: Column) -> Column:
    return F.regexp_replace(unix_text(text), _FENCE, "")


def whitespace_form(text: Column) -> Column:
    """Trailing spaces off, runs of blank lines to one, ends trimmed; applying it twice changes
    nothing."""
    lines = F.regexp_replace(text, r"(?m)[^\S\n]+$", "")
    return F.regexp_replace(F.regexp_replace(lines, r"\n{3,}", "\n\n"), r"\A\n+|\n+\z", "")


def longest_line(text: Column) -> Column:
    """Bytes of the longest line."""
    return F.array_max(F.transform(F.split(text, "\n"), lambda x: F.octet_length(x)))


def looks_binary(content: Column) -> Column:
    """A NUL among the first 8192 bytes."""
    return F.contains(F.substring(content, 1, 8192), F.lit(b"\0"))


def is_utf8(content: Column) -> Column:
    return F.is_valid_utf8(content.cast("string"))


# --- paths -----------------------------------------------------------------------------------------


def clean_path(path: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.trim(path), r"\\+", "/"), r"^(\./+|/+)+", "")


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def dirname(path: Column) -> Column:
    return F.regexp_replace(path, r"/?[^/]*$", "")


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(basename(path), r"^.+\.([^.]+)$", 1))


# Languages by extension.
LANGUAGES: dict[str, str] = {
    "markdown": "md mdx",
    "rust": "rs",
    "typescript": "ts tsx",
    "javascript": "js jsx mjs cjs",
    "compact": "compact",
    "plaintext": "txt",
    "json": "json",
    "yaml": "yaml yml",
    "toml": "toml",
    "python": "py pyi",
    "go": "go",
    "solidity": "sol",
    "bash": "sh bash",
    "scheme": "scm ss sld",
    "java": "java",
    "swift": "swift",
    "ruby": "rb",
    "kotlin": "kt kts",
    "csharp": "cs",
    "haskell": "hs",
    "html": "html htm",
    "xml": "xml csproj nuspec plist",
}
BY_EXTENSION = {e: name for name, es in LANGUAGES.items() for e in es.split()}
NOT_CODE = ("markdown", "plaintext", "json")


def language_of(path: Column) -> Column:
    """Language by extension, or null."""
    m = F.create_map(*[F.lit(x) for kv in BY_EXTENSION.items() for x in kv])
    return F.try_element_at(m, extension(path))


def kind_of(path: Column) -> Column:
    """markdown, plaintext or code."""
    lang = language_of(path)
    return F.when(lang == "markdown", "markdown").when(lang.isNull() | lang.isin("plaintext"), "plaintext").otherwise("code")


def chunker_language(path: Column) -> Column:
    """Language that has a code chunker, else 'other'."""
    lang = language_of(path)
    return F.when(lang.isNull() | lang.isin(*NOT_CODE), "other").otherwise(lang)


def shebang_language(text: Column) -> Column:
    first = F.regexp_extract(text, r"\A#!([^\n]*)", 1)
    return F.when(first.rlike("bash|/sh|sh$"), "bash").when(first.contains("python"), "python").when(first.contains("node"), "javascript")


def is_license_file(path: Column) -> Column:
    return basename(path).rlike(r"(?is)^(LICEN[SC]E|COPYING|NOTICE|PATENTS)([-.].*)?$")


def glob_regex(glob: str) -> str:
    """A glob (*, **, ?, [..], {a,b}) as an anchored regular expression; * stays inside a part
    only after a '**' has been used, as usual for path globs matched on whole strings."""
    out, i, depth = "", 0, 0
    while i < len(glob):
        c = glob[i]
        if glob.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
            continue
        if glob.startswith("**", i):
            out, i = out + ".*", i + 2
            continue
        if c == "*":
            out += ".*"
        elif c == "?":
            out += "."
        elif c == "[" and "]" in glob[i + 1 :]:
            j = glob.index("]", i + 1)
            body = glob[i + 1 : j]
            out += "[" + ("^" + body[1:] if body[:1] == "!" else body) + "]"
            i = j
        elif c == "{":
            out, depth = out + "(?:", depth + 1
        elif c == "}" and depth:
            out, depth = out + ")", depth - 1
        elif c == "," and depth:
            out += "|"
        else:
            out += re.escape(c)
        i += 1
    return "^" + out + "$"


def glob_matches(path: Column, globs: list[str]) -> Column:
    """Some glob matches the whole path or the last part."""
    if not globs:
        return F.lit(False)
    r = "|".join(f"(?:{glob_regex(g)})" for g in globs)
    return path.rlike(r) | basename(path).rlike(r)


# Parts and files that an ingest leaves out by default.
SKIP_DIRS = ("node_modules", "target", "vendor", "dist", "build", "out", "coverage", "managed", "__snapshots__")
SKIP_FILES = ("*.min.js", "*.bundle.js", "*_pb.ts", "*_pb.js", "*.pb.go", "package-lock.json", "npm-shrinkwrap.json", "pnpm-lock.yaml", "CODE_OF_CONDUCT.md", "CONTRIBUTING.md", "SECURITY.md")


def path_allowed(path: Column, includes: list[str] = (), excludes: list[str] = (), defaults: bool = True, known_kind: bool = True) -> Column:
    """The filter ladder: .git, default skips, license files, excludes, includes, known kinds."""
    parts = F.split(path, "/")
    ok = ~F.array_contains(parts, ".git")
    if defaults:
        ok &= ~F.arrays_overlap(parts, F.array(*map(F.lit, SKIP_DIRS))) & ~glob_matches(path, list(SKIP_FILES)) & ~is_license_file(path)
    if excludes:
        ok &= ~glob_matches(path, list(excludes))
    if includes:
        ok &= glob_matches(path, list(includes))
    elif known_kind:
        ok &= language_of(path).isNotNull()
    return ok


def composed_url(inherited: Column, path: Column) -> Column:
    """A prefix that ends in '/' gets the stem of the file and '/'; another stays."""
    stem = F.regexp_replace(basename(path), r"\.[^.]*$", "")
    return F.when(inherited.endswith("/"), F.concat(inherited, stem, F.lit("/"))).otherwise(inherited)


# --- URLs ------------------------------------------------------------------------------------------


def looks_like_sitemap(spec: Column) -> Column:
    p = F.lower(F.regexp_replace(spec, r"[?#].*$", ""))
    return p.rlike(r"(\.xml|\.xml\.gz)$") | p.contains("sitemap")


def robots_url(base: Column) -> Column:
    return F.concat(F.parse_url(base, F.lit("PROTOCOL")), F.lit("://"), F.parse_url(base, F.lit("AUTHORITY")), F.lit("/robots.txt"))


def robots_sitemaps(body: Column) -> Column:
    """URLs of the Sitemap lines, in order, each once."""
    lines = F.transform(F.split(body, "\n"), lambda x: F.trim(F.regexp_replace(F.regexp_replace(x, "#.*$", ""), "\r", "")))
    hits = F.filter(lines, lambda x: x.rlike(r"(?i)^sitemap\s*:\s*\S"))
    return F.array_distinct(F.transform(hits, lambda x: F.trim(F.regexp_replace(x, r"(?i)^sitemap\s*:", ""))))


def sitemap_locations(body: Column) -> Column:
    return F.xpath(body, F.lit("//*[local-name()='loc']/text()"))


def url_parts(url: Column) -> Column:
    p = F.regexp_replace(F.coalesce(F.try_parse_url(url, F.lit("PATH")), url), r"\.(html?|mdx?)$", "")
    return F.filter(F.split(F.lower(p), "/"), lambda x: x != "")


def file_parts(path: Column) -> Column:
    p = F.regexp_replace(F.regexp_replace(F.lower(path), r"\.[a-z0-9]+$", ""), "/(index|readme)$", "")
    return F.filter(F.split(p, "/"), lambda x: x != "")


def common_tail(a: Column, b: Column) -> Column:
    """Parts that two paths share from the end."""
    n = F.least(F.size(a), F.size(b))
    pairs = F.zip_with(F.slice(F.reverse(a), 1, n), F.slice(F.reverse(b), 1, n), lambda x, y: (x == y).cast("int"))
    first = F.array_position(pairs, 0)
    return F.when(n <= 0, 0).when(first > 0, first - 1).otherwise(n).cast("int")


# --- lines, lexing by expression -------------------------------------------------------------------


def without_runs(line: Column) -> Column:
    """Runs of five or more of one punctuation character removed."""
    return F.regexp_replace(line, r"([^\p{L}\p{N}\s])\1{4,}", "")


def cleaned_block_line(line: Column) -> Column:
    return F.trim(F.regexp_replace(F.trim(line), r"^\*", ""))


def esm_ends(line: Column) -> Column:
    return F.rtrim(line).rlike(r"""(;|["'])\s*;?$""")


def in_inline_code(line: Column, position: Column) -> Column:
    """An odd number of backticks before the 0-based position."""
    return F.regexp_count(F.substr(line, F.lit(1), position), F.lit("`")) % 2 == 1


def looks_generated(text: Column) -> Column:
    """A banner of a generator in the first ten lines."""
    head = F.array_join(F.slice(F.split(text, "\n"), 1, 10), "\n")
    return head.rlike(r"(?i)(@generated|DO NOT EDIT|Code generated by|Auto-?generated( by)?)")


def spdx_tags(text: Column) -> Column:
    """Expressions of the SPDX tags, each once."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(r"(?im)^[^\S\n]*(?:(?://|#|\*|/\*|--|;)[^\S\n]*)?SPDX-License-Identifier:[^\S\n]*(\S[^\r\n]*?)[^\S\n]*(?:\*/)?[^\S\n]*$"), F.lit(1)))


def valid_license_expression(s: Column) -> Column:
    one = r"\(*[A-Za-z0-9.+-]+\)*"
    return s.rlike(rf"^\s*{one}(\s+(?:AND|OR|WITH)\s+{one})*\s*$") & (F.length(F.regexp_replace(s, r"[^(]", "")) == F.length(F.regexp_replace(s, r"[^)]", "")))


# --- identifiers, cursors, redaction ---------------------------------------------------------------


def encoded_cursor(s: Column) -> Column:
    return F.rtrim(F.translate(F.base64(F.encode(s, "UTF-8")), "+/", "-_"), F.lit("="))


def decoded_cursor(c: Column) -> Column:
    padded = F.rpad(c, F.ceil(F.length(c) / 4).cast("int") * 4, "=")
    return F.decode(F.unbase64(F.translate(padded, "-_", "+/")), "UTF-8")


def model_name(wire: Column) -> Column:
    """name of name@revision, null unless the revision is a positive number."""
    return F.when(wire.rlike(r"^[^@]+@[1-9]\d*$"), F.split_part(wire, F.lit("@"), F.lit(1)))


def model_revision(wire: Column) -> Column:
    return F.when(wire.rlike(r"^[^@]+@[1-9]\d*$"), F.split_part(wire, F.lit("@"), F.lit(2)).cast("int"))


def redacted(s: Column) -> Column:
    """Runs of 32 or more characters that could be a key."""
    return F.regexp_replace(s, r"[A-Za-z0-9.\-_=+/]{32,}", "[redacted]")


def snippet(s: Column, n: int = 150) -> Column:
    return F.when(F.length(s) > n, F.concat(F.left(s, F.lit(n)), F.lit("…"))).otherwise(s)


def char_windows(text: Column, n: int = 2000) -> Column:
    """The text in pieces of n characters."""
    last = F.greatest(F.ceil(F.length(text) / n), F.lit(1)).cast("int") - 1
    return F.transform(F.sequence(F.lit(0), last), lambda i: F.substr(text, i * n + 1, F.lit(n)))


def rerank_query(query: Column, instruction: Column) -> Column:
    return F.concat_ws("\nInstructions: ", query, F.nullif(F.trim(instruction), F.lit("")))


def wrapped_untrusted(text: Column, nonce: Column) -> Column:
    """The text between tags with a nonce; tags of that name inside are defused."""
    safe = F.regexp_replace(text, r"(?i)<(/?)untrusted", "&lt;$1untrusted")
    return F.concat(F.lit("<untrusted-"), nonce, F.lit(">\n"), safe, F.lit("\n</untrusted-"), nonce, F.lit(">"))


LEVELS = ("disabled", "low", "moderate", "high", "strict")


def should_wrap(attribution: Column, verified: Column, level: str) -> Column:
    """Whether content of this origin is marked as untrusted at a level, from disabled to strict."""
    a, v = F.coalesce(attribution, F.lit("unknown")), F.coalesce(verified, F.lit(False))
    return {
        "disabled": F.lit(False),
        "low": ~v & a.isin("third_party", "community", "unknown"),
        "moderate": ~v,
        "high": ~(v & (a == "foundation")),
        "strict": F.lit(True),
    }[level]


def guarded(text: Column, attribution: Column, verified: Column, flagged: Column, nonce: Column, level: str) -> Column:
    """Kept, wrapped, or (flagged under strict) removed: null."""
    wrapped = F.when(should_wrap(attribution, verified, level), wrapped_untrusted(text, nonce)).otherwise(text)
    return F.when(flagged, F.lit(None)).otherwise(wrapped) if level == "strict" else wrapped


# --- terms -----------------------------------------------------------------------------------------

# Words that carry no meaning for lexical search.
STOP_WORDS = "a an and are as at be but by for if in into is it no not of on or such that the their then there these they this to was will with".split()


def terms(text: Column) -> Column:
    """Lower-case runs of letters and digits without stop words, in order."""
    words = F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    return F.filter(words, lambda w: ~w.isin(STOP_WORDS))
