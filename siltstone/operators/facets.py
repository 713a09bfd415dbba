"""Facet filters: a registry of the keys, validation, and filters as boolean columns.

The filter of a request is a dict by facet key. Sets are `{"any_of": [...], "none_of": [...]}`,
booleans plain values, ranges `{"after"/"before"}` (dates) or `{"min"/"max"}`. Facets join by AND;
values of any_of by OR; none_of keeps rows whose value is missing.
"""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from siltstone.functions.versions import parseable
from siltstone.model import ATTRIBUTIONS, CONTENT_TYPES, DOCUMENT_KINDS, PACKAGE_KINDS, SOURCE_KINDS


@dataclass(frozen=True)
class Facet:
    """One key of the registry."""

    key: str
    shape: str  # enum, open, object, bool, temporal, numeric
    negatable: bool
    values: tuple[str, ...] = ()


REGISTRY: dict[str, Facet] = {
    f.key: f
    for f in (
        [Facet(k, "enum", True, v) for k, v in (("attribution", ATTRIBUTIONS), ("content_type", CONTENT_TYPES), ("kind", DOCUMENT_KINDS), ("source_kind", SOURCE_KINDS))]
        + [Facet(k, "open", True) for k in ("source_slug", "language", "tags", "heading_path")]
        + [Facet(k, "object", True) for k in ("symbol", "package")]
        + [Facet(k, "bool", False) for k in ("verified", "deprecated")]
        + [Facet(k, "object", False) for k in ("language_target", "sdk_dependency")]
        + [Facet(k, "temporal", False) for k in ("ingested_at", "source_modified_at")]
        + [Facet("token_count", "numeric", False)]
    )
}
INT_MAX = 2**31 - 1


class FilterError(ValueError):
    """A filter that can't be planned."""


def is_empty(filters: dict | None) -> bool:
    """Whether a filter restricts nothing."""
    def bare(v) -> bool:
        return v is None or (isinstance(v, dict) and not any(x not in (None, []) for x in v.values()))

    return not filters or all(bare(v) for v in filters.values())


def validate(filters: dict) -> None:
    """Raise FilterError on the first violation, in the order of the registry."""
    for k in filters:
        if k not in REGISTRY:
            raise FilterError(f"unknown facet {k}")
    for key, f in REGISTRY.items():
        v = filters.get(key)
        if v is None:
            continue
        if f.shape == "bool":
            if not isinstance(v, bool):
                raise FilterError(f"{key} takes true or false")
            continue
        if not isinstance(v, dict):
            raise FilterError(f"{key} takes an object")
        if f.shape in ("temporal", "numeric"):
            low, high = ("after", "before") if f.shape == "temporal" else ("min", "max")
            if set(v) - {low, high}:
                raise FilterError(f"{key}: unknown field")
            if v.get(low) is not None and v.get(high) is not None and v[low] > v[high]:
                raise FilterError(f"{key}: {low} is above {high}")
            continue
        if set(v) - {"any_of", "none_of"}:
            raise FilterError(f"{key}: unknown field")
        if v.get("none_of") and not f.negatable:
            raise FilterError(f"{key} can't be negated")
        both = [*(v.get("any_of") or []), *(v.get("none_of") or [])]
        if f.values and (bad := [x for x in both if x not in f.values]):
            raise FilterError(f"{key}: {bad[0]} is not one of its values")
        if key == "package" and any(x.get("kind") not in PACKAGE_KINDS for x in both):
            raise FilterError("package: unknown kind")
        if key in ("language_target", "sdk_dependency"):
            for x in both:
                if x.get("version_satisfies") is not None and not parseable(x["version_satisfies"]):
                    raise FilterError(f"{key}: {x['version_satisfies']} is no version or range")


def day_start(day: dt.date | str) -> Column:
    """A date as the timestamp of its first instant in UTC (the session's zone)."""
    return F.to_timestamp(F.lit(str(day)))


def any_of(c: Column, values: list) -> Column:
    return c.isin(values)


def none_of(c: Column, values: list) -> Column:
    """Excludes the values; a missing value stays."""
    return ~F.coalesce(c, F.lit("")).isin(values)


def overlaps(c: Column, values: list[str]) -> Column:
    return F.coalesce(F.arrays_overlap(F.array_compact(c), F.array(*map(F.lit, values))), F.lit(False))


def symbol_holds(c: Column, want: dict) -> Column:
    """Some element has the wanted kind and name; an empty want holds for any non-empty path."""
    def one(s: Column) -> Column:
        parts = [s[k] == F.lit(want[k]) for k in ("kind", "name") if want.get(k) is not None]
        return reduce(lambda a, b: a & b, parts, F.lit(True))

    return F.coalesce(F.exists(c, one), F.lit(False))


def named_in(c: Column, names: list[str]) -> Column:
    """Some struct of the array has one of the names (case counts)."""
    return F.coalesce(F.exists(c, lambda s: s["name"].isin(names)), F.lit(False))


def _sets(v: dict, hit, miss=None) -> list[Column]:
    out = []
    if v.get("any_of"):
        out.append(hit(v["any_of"]))
    if v.get("none_of"):
        out.append((miss or (lambda x: ~hit(x)))(v["none_of"]))
    return out


def predicate(filters: dict | None, strict: bool = False, c=F.col) -> Column:
    """The filter over the columns of `siltstone.operators.search.searchable`; `strict` adds the
    name gates of the version facets."""
    if is_empty(filters):
        return F.lit(True)
    validate(filters)
    prov, out = c("provenance"), []
    plain = {"kind": c("kind"), "language": c("language"), "source_slug": c("source_slug"), "source_kind": c("source_kind"), "attribution": F.coalesce(prov["attribution"], F.lit("unknown")), "content_type": F.coalesce(prov["content_type"], F.lit("other"))}
    for key, column in plain.items():
        if v := filters.get(key):
            out += _sets(v, lambda x, column=column: any_of(column, x), lambda x, column=column: none_of(column, x))
    flags = {"verified": prov["verified"], "deprecated": prov["deprecation"]["is_deprecated"]}
    for key, column in flags.items():
        if filters.get(key) is not None:
            out.append(F.coalesce(column, F.lit(False)) == filters[key])
    for key, column in {"tags": prov["tags"], "heading_path": c("heading_path")}.items():
        if v := filters.get(key):
            out += _sets(v, lambda x, column=column: overlaps(column, x))
    if v := filters.get("symbol"):
        out += _sets(v, lambda x: reduce(lambda a, b: a | b, [symbol_holds(c("symbol_path"), s) for s in x]))
    if v := filters.get("package"):
        def one(p: dict) -> Column:
            return F.coalesce((c("package_kind") == p["kind"]) & (c("package_name") == p["name"]), F.lit(False))

        out += _sets(v, lambda x: reduce(lambda a, b: a | b, map(one, x)))
    if strict:
        for key, column in {"language_target": prov["language_targets"], "sdk_dependency": prov["sdk_dependencies"]}.items():
            if v := filters.get(key):
                out += _sets(v, lambda x, column=column: named_in(column, [t["name"] for t in x]))
    for key in ("ingested_at", "source_modified_at"):
        if v := filters.get(key):
            out += [c(key) >= day_start(v["after"])] if v.get("after") else []
            out += [c(key) <= day_start(v["before"])] if v.get("before") else []
    if v := filters.get("token_count"):
        out += [c("token_count") >= min(v["min"], INT_MAX)] if v.get("min") is not None else []
        out += [c("token_count") <= min(v["max"], INT_MAX)] if v.get("max") is not None else []
    return reduce(lambda a, b: a & b, out, F.lit(True))


def needs(filters: dict | None) -> set[str]:
    """The tables beside chunk that the filter reads: joins that nothing needs are left out."""
    if is_empty(filters):
        return set()
    out = set()
    for k in filters:
        if k in ("kind", "language", "attribution", "content_type", "verified", "deprecated", "tags", "language_target", "sdk_dependency", "source_modified_at"):
            out.add("document")
        elif k in ("source_slug", "source_kind"):
            out.add("source")
        elif k == "package":
            out |= {"document", "package"}
    return out


def from_flags(**flags) -> dict:
    """Keyword flags to a filter: `kind=[...]` any_of, `not_kind=[...]` none_of, `after`/`before`
    with the key as prefix, `min_tokens`/`max_tokens`, booleans plain."""
    out: dict = {}
    for name, v in flags.items():
        if v is None or v == []:
            continue
        if name in ("min_tokens", "max_tokens"):
            out.setdefault("token_count", {})[name[:3]] = v
        elif name.startswith("not_") and name[4:] in REGISTRY:
            out.setdefault(name[4:], {})["none_of"] = list(v)
        elif name.rpartition("_")[2] in ("after", "before") and name.rpartition("_")[0] in REGISTRY:
            out.setdefault(name.rpartition("_")[0], {})[name.rpartition("_")[2]] = v
        elif name in REGISTRY:
            out[name] = v if REGISTRY[name].shape == "bool" else {**out.get(name, {}), "any_of": list(v)}
        else:
            raise FilterError(f"unknown flag {name}")
    validate(out)
    return out
