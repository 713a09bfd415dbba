"""Rerank scores joined to results, client orders, hints for empty results, projections."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siltstone.functions import scoring, text

REASONS = ("timeout", "unavailable", "rate_limited", "bad_response", "disabled")  # fixed values
MAX_INSTRUCTION = 400


def known_reason(raw: str | None) -> str:
    """A reason of the closed set."""
    return raw if raw in REASONS else "unavailable"


def valid_instruction(s: str | None) -> str | None:
    s = (s or "").strip()
    if len(s) > MAX_INSTRUCTION:
        raise ValueError(f"an instruction has at most {MAX_INSTRUCTION} characters")
    return s or None


def default_instruction(code_only: bool, version: str | None) -> str:
    base = "Prefer passages with code that answers the query." if code_only else "Prefer passages that answer the query directly."
    return base + (f" The reader uses version {version}." if version else "")


def placement(flag: str | None = None, env: str | None = None, config: str | None = None) -> str:
    return next((x for x in (flag, env, config) if x), "auto")


def with_scores(results: DataFrame, scores: DataFrame, policy: scoring.ScoringPolicy = scoring.DEFAULT, order: str = "confidence", limit: int = 20) -> DataFrame:
    """Results (id, trust, relevance, confidence, rank) with rerank scores (id, rerank_score) as
    relevance where there are any; a result without one keeps its own. Ordered by the confidence
    that follows, or by the raw score; the first score of an id counts."""
    s = scores.groupBy("id").agg(F.first("rerank_score", True).alias("rerank_score"))
    out = results.join(s, "id", "left").withColumn("relevance", scoring.clamp_unit(F.coalesce("rerank_score", "relevance")))
    out = out.withColumn("confidence", F.round(scoring.confidence(F.col("trust"), F.col("relevance"), policy), 9))
    key = "confidence" if order == "confidence" else "rerank_score"
    w = Window.orderBy(F.desc_nulls_last(key), F.asc("rank"), F.asc("id"))  # one page of results
    return out.withColumn("place", F.row_number().over(w)).where(F.col("place") <= limit)


def relaxed(filters: dict, version_match: str | None = None) -> tuple[str, dict, str | None] | None:
    """(what, filter, version match) of the next looser request: recency, verified, strictness,
    versions; None when nothing is left to loosen."""
    for key in ("source_modified_at", "ingested_at", "verified"):
        if key in filters:
            return key, {k: v for k, v in filters.items() if k != key}, None
    if any(t.get("version_satisfies") for k in ("language_target", "sdk_dependency") for t in (filters.get(k) or {}).get("any_of", [])):
        if version_match == "strict":
            return "version_match", dict(filters), "permissive"
        return "version", without_versions(filters), None
    return None


def without_versions(filters: dict) -> dict:
    """The filter with names only."""
    out = dict(filters)
    for k in ("language_target", "sdk_dependency"):
        if k in out:
            out[k] = {side: [{f: v for f, v in t.items() if f != "version_satisfies"} for t in ts] for side, ts in out[k].items()}
    return out


def hint(filters: dict | None, version_match: str | None = None) -> str:
    """What to tell a reader without results."""
    if not filters:
        return "Nothing matched. Try fewer or more common words, or another mode."
    step = relaxed(filters, version_match)
    return f"Nothing matched under the filter. Loosen `{step[0]}` and retry." if step else "Nothing matched under the filter. Retry without it."


def guarded(results: DataFrame, level: str, nonce: str) -> DataFrame:
    """Content marked by its origin; flagged rows leave under the strict level."""
    c = text.guarded(F.col("content"), F.col("attribution"), F.col("verified"), F.col("flagged"), F.lit(nonce), level)
    return results.withColumn("content", c).where("content IS NOT NULL")


def brief(results: DataFrame) -> DataFrame:
    return results.select("id", F.concat_ws(" > ", F.col("source_path"), F.array_join(F.transform("symbol_path", lambda s: s["name"]), " > ")).alias("breadcrumb"), text.snippet(F.col("content")).alias("snippet"))


def projected(results: DataFrame, include_scores: bool = True, concise: bool = False) -> DataFrame:
    """Scores at the top level, or none of them."""
    scores = ["score", "relevance", "trust", "confidence", "best_similarity"]
    if include_scores and not concise:
        return results
    keep = [] if concise or not include_scores else scores
    return results.drop(*[c for c in scores if c not in keep])
