"""Package manifests: licenses, names, dependencies, and which package a file belongs to."""

from __future__ import annotations

import json
import re
import tomllib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.functions import text
from siltstone.session import ship

MANIFESTS = ("Cargo.toml", "package.json", "pyproject.toml")
TRACKED = ("@",)  # default prefixes of the dependencies that are kept; a deployment sets its own


def _toml(body: str) -> dict:
    try:
        return tomllib.loads(body)
    except (tomllib.TOMLDecodeError, TypeError):
        return {}


def _json(body: str) -> dict:
    try:
        d = json.loads(body)
    except (ValueError, TypeError):
        return {}
    return d if isinstance(d, dict) else {}


def _strings(x) -> list[str]:
    return [v for v in (x if isinstance(x, list) else [x]) if isinstance(v, str) and v.strip()]


def cargo_license(body: str) -> list[str]:
    """Of the package, else of the workspace's packages."""
    d = _toml(body)
    own = d.get("package", {}).get("license") if isinstance(d.get("package"), dict) else None
    return _strings(own) or _strings(((d.get("workspace") or {}).get("package") or {}).get("license"))


def npm_license(body: str) -> list[str]:
    """A string, an object with a type, or the older list of objects."""
    d = _json(body)
    raw = d.get("license", d.get("licenses"))
    return [y for x in (raw if isinstance(raw, list) else [raw]) for y in _strings(x.get("type") if isinstance(x, dict) else x)]


def python_license(body: str) -> list[str]:
    """A string or a table with a text; a table with a file only names none."""
    raw = (_toml(body).get("project") or {}).get("license")
    return _strings(raw.get("text") if isinstance(raw, dict) else raw)


LICENSE_OF = {"Cargo.toml": cargo_license, "package.json": npm_license, "pyproject.toml": python_license}


def cargo_package(body: str) -> tuple[str, str | None] | None:
    """(name, version); None for a manifest that is a workspace only."""
    p = _toml(body).get("package")
    if not isinstance(p, dict) or not isinstance(p.get("name"), str):
        return None
    v = p.get("version")
    return p["name"], v if isinstance(v, str) else None


def npm_package(body: str) -> tuple[str, str | None] | None:
    d = _json(body)
    return (d["name"], d.get("version") if isinstance(d.get("version"), str) else None) if isinstance(d.get("name"), str) else None


def npm_dependencies(body: str, prefixes: tuple[str, ...] = TRACKED) -> list[tuple[str, str]]:
    d = _json(body)
    got = {k: v for part in ("devDependencies", "peerDependencies", "dependencies") for k, v in (d.get(part) or {}).items()}
    return sorted((k, v) for k, v in got.items() if isinstance(v, str) and k.startswith(prefixes))


def cargo_dependencies(body: str, workspace: str | None = None, prefixes: tuple[str, ...] = TRACKED) -> list[tuple[str, str]]:
    """Strings, tables with a version, and entries that take the workspace's version."""
    shared = (_toml(workspace or "").get("workspace") or {}).get("dependencies") or {}

    def version(x) -> str | None:
        return x if isinstance(x, str) else x.get("version") if isinstance(x, dict) else None

    out = {}
    d = _toml(body)
    for part in ("build-dependencies", "dev-dependencies", "dependencies"):
        for k, v in (d.get(part) or {}).items():
            if k.startswith(prefixes):
                use = shared.get(k) if isinstance(v, dict) and v.get("workspace") else v
                if (got := version(use)) is not None:
                    out[k] = got
    return sorted(out.items())


def language_version(body: Column) -> Column:
    """The constraint of `pragma language_version ...;`."""
    raw = F.trim(F.regexp_extract(body, r"(?m)^\s*pragma\s+language_version\s+([^;]+);", 1))
    return F.nullif(F.regexp_replace(F.regexp_replace(raw, r"\s*&&\s*", ", "), r"([<>=])\s+(?=\d)", "$1"), F.lit(""))


def module_package(body: Column) -> Column:
    """The name of the only top-level module of a file."""
    names = F.regexp_extract_all(body, F.lit(r"(?m)^(?:export\s+)?module\s+([A-Za-z_]\w*)"), F.lit(1))
    return F.when(F.size(names) == 1, names[0])


def manifests(files: DataFrame) -> DataFrame:
    """(scope, path, dir, kind, name, version, licenses, dependencies) of all package manifests of
    `files` (scope, path, content)."""
    ship(files.sparkSession)
    dep = pa.list_(pa.struct([("name", pa.string()), ("version_constraint", pa.string())]))
    types = [pa.string(), pa.string(), pa.string(), pa.string(), pa.string(), pa.list_(pa.string()), dep]
    names = ["scope", "path", "kind", "name", "version", "licenses", "dependencies"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for scope, path, raw in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                base, body = path.rsplit("/", 1)[-1], (raw or b"").decode("utf-8", "replace").lstrip("﻿")
                pkg = cargo_package(body) if base == "Cargo.toml" else npm_package(body) if base == "package.json" else None
                deps = npm_dependencies(body) if base == "package.json" else cargo_dependencies(body) if base == "Cargo.toml" else []
                kind = {"Cargo.toml": "rust", "package.json": "npm"}.get(base, "other")
                rows.append((scope, path, kind, *(pkg or (None, None)), LICENSE_OF[base](body), [{"name": k, "version_constraint": v} for k, v in deps]))
            cols = list(zip(*rows, strict=True)) if rows else [[] for _ in names]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=names)

    src = files.select("scope", text.clean_path(F.col("path")).alias("path"), "content").where(text.basename(F.col("path")).isin(*MANIFESTS))
    out = src.mapInArrow(run, "scope string, path string, kind string, name string, version string, licenses array<string>, dependencies array<struct<name:string,version_constraint:string>>")
    return out.withColumn("dir", text.dirname(F.col("path")))


def license_titles(files: DataFrame) -> DataFrame:
    """(scope, dir, titles): first lines of the license files of each directory, sorted, each once."""
    p = text.clean_path(F.col("path"))
    body = F.regexp_replace(F.col("content").cast("string"), r"\A[\s#]+", "")
    f = files.select("scope", p.alias("path"), F.trim(F.regexp_extract(body, r"\A([^\n]*)", 1)).alias("title")).where(text.is_license_file(F.col("path")) & (F.col("title") != ""))
    return f.groupBy("scope", text.dirname(F.col("path")).alias("dir")).agg(F.array_sort(F.array_distinct(F.collect_list("title"))).alias("titles"))


def expression(raw: str) -> str | None:
    """A license expression with checked form, or None."""
    s = re.sub(r"\s+", " ", raw or "").strip()
    return s if re.fullmatch(r"\(*[A-Za-z0-9.+-]+\)*(?: (?:AND|OR|WITH) \(*[A-Za-z0-9.+-]+\)*)*", s) and s.count("(") == s.count(")") else None
