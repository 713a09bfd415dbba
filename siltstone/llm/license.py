"""The license of each file and repository.

1. Statements are read from the files: front matter, notices and license sections of the file
   itself; license-family files and manifest entries for their directory. Comment blocks, sections and
   license-family files that hold the words of a license or of its header are told by a regression on
   the word n-grams of license texts (`license_texts`); known names in a title come before it.
2. Each named alternative of a statement goes through a multinomial logistic regression on word
   n-grams, trained on variants of the reference licenses written from templates, with a
   background class of other licenses. A name is rejected (open set) when its best probability is
   low, or when its words were mostly never seen in training.
3. Predictions are reconciled along the path: the file's statements count; without any, those of
   the nearest directory above that has some.

Results: the license ids sorted and joined by ' OR ', or CONFLICT, UNKNOWN, NONE. Where all of several
apply ('A AND B') they are joined by ' AND '; an exception to a license ('A WITH x') leaves A.

Defined cases: null or empty license lists, placeholders and pointers to a file are no statement.
A document without its file is judged by its own entry and the directories above its path.
Repeated rows count once. Statements that name nothing known count as equal to one another. Extra
columns are ignored. Empty tables give no rows. The reference table is read to the driver, up to
`MAX_REFERENCE` rows (it is a fixed list of licenses); more is an error.
"""

from __future__ import annotations

import itertools
import json
import re
import tomllib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.llm.common import clean_path, decode
from siltstone.llm.license_texts import HINT as TEXT_HINT
from siltstone.llm.license_texts import OTHER as ANOTHER_TEXT
from siltstone.llm.license_texts import TextModel
from siltstone.session import ship, staged, table

MAX_REFERENCE = 2000
UNKNOWN, OTHER, OTHER_NAME = "UNKNOWN", "~other", "LicenseRef-other"

# Common names of licenses by id. {n} templates below make the variants.
NAMES: dict[str, list[str]] = {
    "MIT": ["MIT", "Expat", "Expat MIT", "MIT Expat", "MIT X11"],
    "Apache-2.0": ["Apache 2", "Apache 2.0", "ASL 2.0", "ASL 2", "AL 2.0", "Apache Software 2.0", "Apache 2.0 only"],
    "BSD-2-Clause": ["BSD 2 clause", "2 clause BSD", "two clause BSD", "simplified BSD", "FreeBSD", "simplified BSD 2 clause", "BSD 2"],
    "BSD-3-Clause": ["BSD 3 clause", "3 clause BSD", "three clause BSD", "new BSD", "modified BSD", "revised BSD", "new BSD 3 clause", "BSD 3"],
    "ISC": ["ISC", "Internet Systems Consortium"],
    "MPL-2.0": ["MPL 2", "MPL 2.0", "Mozilla Public 2.0", "Mozilla Public 2", "Mozilla 2.0"],
    "Unlicense": ["Unlicense", "the Unlicense", "Unlicense public domain"],
    "CC-BY-4.0": ["CC BY 4.0", "CC BY 4", "Creative Commons Attribution 4.0", "Creative Commons Attribution 4.0 International", "Creative Commons BY 4.0"],
    "Zlib": ["zlib", "zlib libpng"],
}
GNU_NAMES: dict[str, list[str]] = {
    "GPL": ["GPL", "GNU GPL", "GNU General Public", "GNU General Public License GPL"],
    "LGPL": ["LGPL", "GNU LGPL", "GNU Lesser General Public", "GNU Lesser GPL", "Lesser General Public"],
    "AGPL": ["AGPL", "GNU AGPL", "GNU Affero General Public", "GNU Affero GPL", "Affero General Public"],
}
# Licenses outside the reference, for the background class.
BACKGROUND: list[str] = [
    "Eclipse Public 2.0", "EPL 1.0", "CDDL 1.1", "Common Development and Distribution", "Artistic 2.0", "WTFPL", "0BSD", "zero clause BSD", "BSD 4 clause", "original BSD", "four clause BSD",
    "Business Source 1.1", "BUSL 1.1", "BSL 1.0", "Boost Software 1.0", "Server Side Public 1", "SSPL 1.0", "Elastic 2.0", "Apache 1.0", "Apache 1.1", "MPL 1.0", "MPL 1.1", "Mozilla Public 1.1",
    "CC BY 3.0", "CC BY SA 4.0", "CC BY NC 4.0", "CC BY ND 4.0", "CC0 1.0", "Creative Commons Attribution ShareAlike 4.0", "Creative Commons Attribution NonCommercial 4.0", "Creative Commons Zero 1.0 Universal",
    "proprietary", "commercial", "all rights reserved", "internal evaluation 1.0", "evaluation agreement", "source available 2", "community terms 1.1", "field of use", "company confidential", "custom terms",
    "LicenseRef eval", "LicenseRef proprietary", "LicenseRef custom 1.0", "Python 2.0", "PostgreSQL", "OpenSSL", "Ruby", "PHP 3.01", "Microsoft Public", "MS PL", "European Union Public 1.2", "EUPL 1.2", "NCSA", "Ms RL", "OFL 1.1", "SIL Open Font 1.1", "Vim", "JSON", "Beerware", "X11",
]
# Names of families, which name no license alone; each weighs as much in training as a class.
FAMILIES: list[str] = ["BSD", "BSD style", "Berkeley Software Distribution", "GNU", "CC", "Creative Commons"]
GNU_OTHER: list[tuple[str, str, str]] = [(f, v, s) for f, v, s in itertools.product(("GPL", "LGPL", "AGPL"), ("1.0", "2.0", "2.1", "3.0"), ("only", "or later"))]
PLACEHOLDERS = frozenset(["", "noassertion", "none", "unknown", "n a", "na", "tbd", "todo", "fixme", "null", "license", "unspecified", "undefined", "not specified", "other", "see license"])

_WORDS = re.compile(r"[a-z]+|\d+(?:\.\d+)*|\+")
_DROP = frozenset(["the", "license", "licence", "version", "v", "licensed", "under", "terms", "of", "a", "an"])
_NUMBERS = {"two": "2", "three": "3", "four": "4"}
_TEMPLATES = ["{n}", "the {n} license", "{n} licence", "license {n}", "licensed under {n}", "{n} license version"]


def words(phrase: str) -> list[str]:
    """Words of a license name: case, punctuation, filler words, '.0' and spelling of '+' levelled."""
    out: list[str] = []
    level = re.sub(r"v\.?(?=\s*\d)", " ", phrase.lower()).replace("or any later", "or later").replace("or newer", "or later")
    for w in _WORDS.findall(level):
        w = _NUMBERS.get(w, w)
        if w == "+":
            out += ["or", "later"]
            continue
        if w in _DROP:
            continue
        if w[0].isdigit():
            while w.endswith(".0"):
                w = w[:-2]
        out.append(w)
    return out


def features(phrase: str) -> list[str]:
    """Word n-grams, n = 1 to 3, with the ends marked."""
    w = words(phrase)
    p = ["^", *w, "$"]
    return w + [" ".join(p[i : i + 2]) for i in range(len(p) - 1)] + [" ".join(p[i : i + 3]) for i in range(len(p) - 2)]


def _gnu(spdx: str) -> tuple[str, str, str] | None:
    m = re.fullmatch(r"(A?L?GPL)-(\d\.\d)-(only|or-later)", spdx)
    return (m[1], m[2], m[3].replace("-", " ")) if m else None


def _gnu_forms(family: str, version: str, suffix: str) -> list[str]:
    """Names of a GNU license; one without a suffix is the 'only' one."""
    short = version[:-2] if version.endswith(".0") else version
    tails = [suffix] + ([""] if suffix == "only" else ["+", "or any later version", "or newer"])
    return [f"{n} {v} {t}".strip() for n in GNU_NAMES[family] for v in {version, short, f"v{short}", f"version {short}"} for t in tails]


def training_phrases(reference: list[tuple[str, str]]) -> list[tuple[str, str]]:
    """(phrase, label) of all variants; labels are the reference ids and the background class."""
    out: set[tuple[str, str]] = set()
    known_gnu = {g for s, _ in reference if (g := _gnu(s))}
    for spdx, title in reference:
        forms = {spdx, spdx.replace("-", " "), title, re.sub(r"\bLicen[sc]e\b", "", title or ""), *NAMES.get(spdx, [])}
        if g := _gnu(spdx):
            forms |= set(_gnu_forms(*g))
        out |= {(t.format(n=f), spdx) for f in forms if f and f.strip() for t in _TEMPLATES}
    other = {*BACKGROUND, *FAMILIES}
    for g in GNU_OTHER:
        if g not in known_gnu:
            other |= set(_gnu_forms(*g))
    known = {" ".join(words(p)) for p, _ in out}
    out |= {(t.format(n=f), OTHER) for f in other if " ".join(words(f)) not in known for t in _TEMPLATES}
    # an id and a title may level to the same words under two labels; the first label keeps them
    seen: dict[str, str] = {}
    for p, label in sorted(out, key=lambda x: (x[1] == OTHER, x[1], x[0])):
        seen.setdefault(" ".join(words(p)), label)
    return sorted((k, v) for k, v in seen.items() if k)


class LicenseModel:
    """Multinomial logistic regression on word n-grams, with open-set rejection."""

    def __init__(self, reference: list[tuple[str, str]], rounds: int = 400, rate: float = 1.0, decay: float = 1e-4, least_probability: float = 0.5, least_known: float = 0.6):
        data = training_phrases(reference)
        self.labels = sorted({label for _, label in data} | {OTHER})
        self.vocabulary: dict[str, int] = {}
        rows = [[self.vocabulary.setdefault(f, len(self.vocabulary)) for f in features(p)] for p, _ in data]
        x = np.zeros((len(rows), len(self.vocabulary) + 1))
        for i, r in enumerate(rows):
            x[i, r] = 1.0
            x[i] /= max(1.0, np.linalg.norm(x[i]))
        x[:, -1] = 0.3
        y = np.zeros((len(rows), len(self.labels)))
        y[np.arange(len(rows)), [self.labels.index(label) for _, label in data]] = 1
        weight = (1 / np.maximum(y.sum(0), 1))[y.argmax(1)]
        alone = {" ".join(words(f)) for f in FAMILIES}
        weight[[p in alone for p, _ in data]] = 1
        weight = weight[:, None] * len(rows) / (len(self.labels) + len(alone))
        w, step = np.zeros((x.shape[1], len(self.labels))), np.zeros((x.shape[1], len(self.labels)))
        for _ in range(rounds):  # full-batch gradient descent with momentum; the result is fixed
            z = x @ w
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            step = 0.9 * step - rate * (x.T @ (weight * (p - y)) / len(rows) + decay * w)
            w = w + step
        self.weights, self.least_probability, self.least_known = w, least_probability, least_known
        self.known_words = {g for p, _ in data for g in p.split()}

    def predict(self, phrase: str) -> str:
        """A reference id, or UNKNOWN."""
        ws = words(phrase)
        if not ws or sum(w in self.known_words for w in ws) < self.least_known * len(ws):
            return UNKNOWN
        x = np.zeros(self.weights.shape[0])
        x[[self.vocabulary[f] for f in features(phrase) if f in self.vocabulary]] = 1.0
        x /= max(1.0, np.linalg.norm(x))
        x[-1] = 0.3
        z = x @ self.weights
        p = np.exp(z - z.max())
        p /= p.sum()
        k = int(p.argmax())
        return UNKNOWN if self.labels[k] == OTHER or p[k] < self.least_probability else self.labels[k]


def alternatives(statement: str) -> list[str]:
    """The names that a statement lets choose from; none for a placeholder or a pointer to a file."""
    s = re.sub(r"\s+", " ", statement).strip(" \t.;,:\"'`*")
    s = re.sub(r"(?i)^(?:either|your choice of)\s+", "", s).replace("as you choose,", " ").replace("at your option,", " ")
    level = " ".join(re.findall(r"[a-z]+", s.lower()))
    if level in PLACEHOLDERS or re.match(r"(?i)(?:please )?(?:see|refer to|check|file:?)\b", s) or re.fullmatch(r"(?i)licen[sc]e(?:\.(?:md|txt))?", s):
        return []
    parts = re.split(r"(?i)\s*/\s*|\s+or,?\s+(?!(?:any )?later|newer)|\s*\|\|?\s*|\s+and/or\s+|,(?!\s*v(?:ersion\b|\.|\s*\d))\s*(?=[A-Za-z])", s.replace("(", " ( ").replace(")", " ) "))
    out = []
    for p in parts:
        p = re.sub(r"\s+", " ", p.replace("(", " ").replace(")", " ")).strip(" .;,:")
        p = re.sub(r"(?i)^(?:either|the|or)\s+", "", p)
        p = re.sub(r"(?i)\s+with\s+(?:the\s+)?[\w.+ -]*exception[\w.+-]*$", "", p)
        if p and " ".join(re.findall(r"[a-z]+", p.lower())) not in PLACEHOLDERS:
            out.append(p)
    return out


def value_of(names: list[str], predict) -> str | None:
    """One value of a statement: known ids sorted and joined, UNKNOWN, or None for no statement."""
    if not names:
        return None
    known = set()
    for n in names:
        all_of = {predict(x) for x in re.split(r"\s+(?:AND|&)\s+", n)}
        if UNKNOWN not in all_of:
            known.add(" AND ".join(sorted(all_of)))
    return " OR ".join(sorted(known)) if known else UNKNOWN


# --- statements in files ---------------------------------------------------------------------------

_FAMILY = re.compile(r"(?i)(?:un)?licen[sc]e(?:[-._ ].*)?|copying(?:[-._ ].*)?")
MANIFESTS = frozenset(["cargo.toml", "package.json", "pyproject.toml"])
_DECOR = re.compile(r"^\s*(?:(?:///?|#+|/\*+!?|\*+/?|<!--|--|;+|%+|\"\"\"|''')\s*)*|\s*(?:\*/|-->|\"\"\")\s*$")
_TAIL = r"(.+?)(?:[.;]?\s*$|(?<!\bv)[.;]\s)"
_SAID = r"(?:licensed|released|distributed|available|offered|covered|published) (?:under|by)"
_NOTICE = [re.compile(p) for p in (
    r"(?i)^spdx-license-identifier\s*:\s*(.+?)\s*$",
    r"(?i)^@licen[sc]e\s*:?\s+(.+?)\s*$",
    r"(?i)^licen[sc]e\s*:\s*(.+?)\s*$",
    r"(?i)^(?:(?:this|the) [\w ,]{1,60} is |all [\w ]{1,40} (?:is|are) )?" + _SAID + r" (?:the terms of )?" + _TAIL,
    r"(?i)^(?:[\w ,'/@.-]{0,120} )?(?:on|under) the (?:terms|conditions) of " + _TAIL,
    r"(?i)^(?:[\w ,'/@.-]{0,120} )?under the conditions of " + _TAIL,
)]
# a file without these can't match any of the patterns: each needs one of them within a line
_HINT = re.compile(rf"(?i)licen[sc]e|{_SAID}|(?:terms|conditions) of|{TEXT_HINT}".encode())
_COMMENT = re.compile(r"^\s*(?://|#|/\*|\*|<!--|--|;|%|\"\"\"|''')")


def notice(line: str) -> str | None:
    """The license part of a notice line without comment marks."""
    for p in _NOTICE:
        if m := p.match(line):
            return m[1].strip()
    return None


def front_matter(text: str) -> tuple[list[str], str]:
    """(license entries of the YAML fence, rest of the text)."""
    m = re.match(r"---[ \t]*\n(.*?)\n---[ \t]*(?:\n|$)", text, re.S)
    if not m:
        return [], text
    found = re.search(r"(?im)^licen[sc]e\s*:[ \t]*(.*(?:\n[ \t]*-[ \t]+.*)*)$", m[1])
    if not found:
        return [], text[m.end() :]
    raw = found[1].strip()
    items = re.findall(r"-[ \t]+(.+)", raw) if raw.startswith("-") else raw.strip("[]").split(",") if raw.startswith("[") else [raw]
    return [x.strip().strip("\"'") for x in items if x.strip()], text[m.end() :]


def own_statements(text: str, prose: bool, texts: TextModel | None = None) -> list[list[str]]:
    """Names by statement that a file makes about itself. In code only comments can."""
    out: list[list[str]] = []
    if prose:
        entries, text = front_matter(text)
        if names := [n for e in entries for n in alternatives(e)]:
            out.append(names)
    block, lines = "", []
    for raw in text.split("\n"):
        # state of a block comment, for lines without a mark of their own
        inside = bool(block)
        if not block and (m := re.match(r"\s*(/\*|<!--|\"\"\"|''')", raw)):
            block = {"/*": "*/", "<!--": "-->"}.get(m[1], m[1])
            if block in raw[m.end() :]:
                block = ""
            inside = True
        elif block and block in raw:
            block = ""
        commented = inside or bool(_COMMENT.match(raw))
        line = _DECOR.sub("", _DECOR.sub("", raw)).strip() if commented else raw.strip()
        lines.append((line, prose or commented))
    told: set[int] = set()
    if texts is not None:
        for label, at in texts.licenses([x if said else None for x, said in lines]):
            out.append([label if label != ANOTHER_TEXT else OTHER_NAME])
            told |= set(at)
    previous = ""
    for i, (line, may) in enumerate(lines):
        if may and i not in told:
            joined = f"{previous} {line}" if previous.endswith((" the", " on", " under", " of")) else line
            said = notice(line) or notice(joined)
            if said and (names := alternatives(said)):
                out.append(names)
        previous = line
    return out


def family_statement(text: str, predict, texts: TextModel) -> list[str]:
    """Names of a license-family file: those it gives, if one is known, else the license whose words it holds."""
    names = family_names(text)
    if not any(predict(n) != UNKNOWN for n in names):
        told = [label for label, _ in texts.licenses([x.strip() for x in text.split("\n")]) if label != ANOTHER_TEXT]
        names = told or names
    return names


def family_names(text: str) -> list[str]:
    """Names that a license-family file gives."""
    lines = [x.strip().strip("#").strip() for x in text.split("\n") if x.strip()]
    for line in lines:
        if (m := re.match(r"(?i)spdx-license-identifier\s*:\s*(.+)$", line)) or (m := re.search(r"(?i)\b(?:is|are) (?:released|licensed|offered|distributed|available|covered) (?:under|by) (?:the terms of )?(.+?)(?:, whichever\b.*)?\.?$", line)):
            return alternatives(m[1])
    for line in lines:
        if not re.match(r"(?i)(?:copyright\b|\(c\)|licen[sc]e$|all rights reserved)", line):
            return alternatives(line)
    return []


def manifest_names(base: str, text: str) -> list[str]:
    """Names of the license entry of a manifest."""
    try:
        if base == "package.json":
            d = json.loads(text)
            raw = d.get("license", d.get("licenses"))
        else:
            d = tomllib.loads(text)
            if base == "cargo.toml":
                raw = d.get("package", {}).get("license") or d.get("workspace", {}).get("package", {}).get("license")
                raw = raw if isinstance(raw, str) else None
            else:
                raw = d.get("project", {}).get("license") or d.get("tool", {}).get("poetry", {}).get("license")
    except (ValueError, AttributeError, TypeError):
        return []
    items = raw if isinstance(raw, list) else [raw]
    named = [x if isinstance(x, str) else (x.get("type") or x.get("text")) if isinstance(x, dict) else None for x in items]
    return [n for x in named if isinstance(x, str) for n in alternatives(x)]


_STATED = "scope string, path string, level string, names array<string>"


def _read_files(models_b):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, texts = models_b.value
        predict = lru_cache(65536)(model.predict)
        for b in batches:
            rows: list[tuple] = []
            for scope, path, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                base = path.rsplit("/", 1)[-1].lower()
                if _FAMILY.fullmatch(base):
                    if names := family_statement(decode(raw), predict, texts):
                        rows.append((scope, path, "family", names))
                elif base in MANIFESTS:
                    if names := manifest_names(base, decode(raw)):
                        rows.append((scope, path, "manifest", names))
                elif raw and _HINT.search(raw) and not re.match(r"(?:notice|patents)(?:[-.].*)?$", base):
                    prose = base.rsplit(".", 1)[-1] in {"md", "mdx", "markdown", "txt", "rst", "adoc", "html", "htm"} or "." not in base
                    rows += [(scope, path, "file", names) for names in own_statements(decode(raw), prose, texts)]
            cols = list(zip(*rows, strict=True)) if rows else [[], [], [], []]
            types = [pa.string(), pa.string(), pa.string(), pa.list_(pa.string())]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=["scope", "path", "level", "names"])

    return run


def _value_udf(models_b):
    @F.pandas_udf("string")
    def value(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        predict = lru_cache(65536)(models_b.value[0].predict)
        for names in batches:
            yield names.map(lambda x: None if x is None else value_of([n for n in x if n], predict))

    return value


def _entry_udf():
    @F.pandas_udf("array<string>")
    def entry(lists):
        return lists.map(lambda x: None if x is None else [n for e in x if e for n in alternatives(e)])

    return entry


def _settle(values: Column) -> Column:
    return F.when(values.isNull() | (F.size(values) == 0), F.lit(None)).when(F.size(values) == 1, values[0]).otherwise(F.lit("CONFLICT"))


def resolve_licenses(docs: DataFrame, files: DataFrame, versions: DataFrame, sources: DataFrame, reference: DataFrame) -> DataFrame:
    """(unit_kind, unit_id, license) of every document id and source id."""
    spark = ship(docs.sparkSession)
    ref = [(r.spdx_id, r.title or "") for r in reference.select("spdx_id", "title").where("spdx_id is not null").distinct().limit(MAX_REFERENCE + 1).collect()]
    if len(ref) > MAX_REFERENCE:
        raise ValueError(f"the reference has more than {MAX_REFERENCE} licenses")
    models_b = spark.sparkContext.broadcast((LicenseModel(sorted(ref)), TextModel(sorted(x for x, _ in ref))))
    value, entry = _value_udf(models_b), _entry_udf()

    src = files.select(F.col("source_version_id").cast("string").alias("scope"), clean_path(F.col("path")).alias("path"), F.col("content").cast("binary").alias("content")).where("path is not null")
    stated = src.mapInArrow(_read_files(models_b), _STATED)
    here = F.regexp_replace("path", r"/?[^/]*$", "")
    # license-family files of a directory are one statement
    key = F.when(F.col("level") == "file", F.col("path")).when(F.col("level") == "manifest", F.col("path")).otherwise(here)
    grouped = stated.select("scope", "level", key.alias("at"), F.when(F.col("level") == "family", here).otherwise(F.col("path")).alias("path"), F.when(F.col("level") == "family", F.lit("")).otherwise(F.array_join("names", "\n")).alias("own"), "names")
    joined = grouped.groupBy("scope", "level", "path", "own").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_set("names")))).alias("names"))
    # a few statements a directory: written once, so that the files are read once
    valued = staged(joined.withColumn("value", value("names")).where("value is not null"), "statements")

    own = valued.where("level = 'file'").groupBy("scope", "path").agg(F.collect_set("value").alias("said"))
    active = versions.where("is_active").select(F.col("id").cast("string").alias("scope"), F.col("source_id").alias("source_id")).distinct()
    roots = sources.select(F.col("id").alias("source_id"), "license").groupBy("source_id").agg(F.min("license").alias("license")).withColumn("names", entry("license")).withColumn("value", F.when(F.size("names") > 0, value("names")))
    dirs = valued.where("level <> 'file'").select("scope", F.when(F.col("level") == "manifest", here).otherwise(F.col("path")).alias("dir"), "value")
    dirs = dirs.unionByName(active.join(roots, "source_id").where("value is not null").select("scope", F.lit("").alias("dir"), "value"))
    dirs = dirs.groupBy("scope", "dir").agg(F.collect_set("value").alias("values")).select("scope", "dir", _settle(F.col("values")).alias("dir_license"))

    d = docs.select(F.col("id").cast("string").alias("id"), F.struct(F.col("source_version_id").cast("string").alias("scope"), clean_path(F.col("source_path")).alias("path"), F.col("license").cast("array<string>").alias("license")).alias("m")).where("id is not null")
    d = d.groupBy("id").agg(F.min("m").alias("m")).select("id", "m.*")  # of different rows under one id the smallest counts
    d = d.withColumn("names", entry("license")).withColumn("entered", F.when(F.size("names") > 0, value("names"))).select("id", "scope", "path", "entered")
    d = d.join(own, ["scope", "path"], "left")
    d = d.select("id", "scope", here.alias("dir"), _settle(F.array_distinct(F.array_compact(F.array_append(F.coalesce("said", F.array().cast("array<string>")), F.col("entered"))))).alias("license"))
    d = staged(d, "documents")

    # the directories of documents, each once, with those above, nearest first: a/b -> a/b, a, ''
    parts = F.split("dir", "/")
    above = F.concat(F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda k: F.array_join(F.slice(parts, 1, F.size(parts) - k), "/")), F.array(F.lit("")))
    open_ = d.where("license is null and scope is not null").select("scope", F.coalesce("dir", F.lit("")).alias("dir")).distinct()
    up = open_.select("scope", F.col("dir").alias("from"), F.posexplode(above).alias("up", "dir"))
    near = up.join(dirs, ["scope", "dir"]).groupBy("scope", F.col("from").alias("dir")).agg(F.min_by("dir_license", "up").alias("near"))
    per_file = d.withColumn("dir", F.coalesce("dir", F.lit(""))).join(near, ["scope", "dir"], "left").select(F.lit("file").alias("unit_kind"), F.col("id").alias("unit_id"), F.coalesce("license", "near", F.lit("NONE")).alias("license"))

    at_root = active.join(dirs.where("dir = ''"), "scope").groupBy("source_id").agg(F.collect_set("dir_license").alias("values"))
    per_source = roots.join(at_root, "source_id", "left").where("source_id is not null")
    alone = F.coalesce(_settle(F.col("values")), F.col("value"), F.lit("NONE"))
    return per_file.unionByName(per_source.select(F.lit("repository").alias("unit_kind"), F.col("source_id").cast("string").alias("unit_id"), alone.alias("license")))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = {n: table(spark, sf_dir, n) for n in ("new_document", "source_file", "source_version", "corpus_source", "license_ref")}
    return resolve_licenses(t["new_document"], t["source_file"], t["source_version"], t["corpus_source"], t["license_ref"])


def p3_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Units by kind and license over the whole corpus."""
    return p3_found(spark, sf_dir).groupBy("unit_kind", "license").agg(F.count("*").alias("n_units"))
