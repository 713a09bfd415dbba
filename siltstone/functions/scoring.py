"""Trust, relevance and confidence as columns."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class ScoringPolicy:
    """Weights of the scores. The defaults are those of the data model."""

    attribution: dict[str, float] = field(default_factory=lambda: {"foundation": 1.00, "partner": 0.85, "third_party": 0.60, "community": 0.40, "unknown": 0.30})
    verified_by_foundation: float = 1.00
    verified_by_partner: float = 0.90
    verified_by_other: float = 0.80
    unverified: float = 0.70
    decay_days: float = 180.0
    deprecated: float = 0.30
    satisfies: float = 1.15
    neutral: float = 1.00
    floor: float = 0.30
    patch_step: float = 0.05
    minor_step: float = 0.15
    trust_weight: float = 0.55
    relevance_weight: float = 0.45

    def __post_init__(self) -> None:
        numbers = [*self.attribution.values(), *(v for k, v in vars(self).items() if k != "attribution")]
        if any(not (0 <= x < float("inf")) for x in numbers):
            raise ValueError("scoring weights must be finite and not negative")


DEFAULT = ScoringPolicy()


def normalised_rrf(raw: Column) -> Column:
    return 1 - 1 / (1 + F.greatest(raw, F.lit(0.0)))


def clamp_unit(x: Column) -> Column:
    """Into [0, 1]; what is no finite number becomes 0."""
    bad = F.isnan(x) | (F.abs(x) == float("inf"))
    return F.when(bad, F.lit(0.0)).otherwise(F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0)))


def attribution_multiplier(attribution: Column, p: ScoringPolicy = DEFAULT) -> Column:
    out = F.lit(p.attribution["unknown"])
    for name, weight in p.attribution.items():
        out = F.when(attribution == name, F.lit(weight)).otherwise(out)
    return out


def verification_multiplier(verified: Column, by: Column, p: ScoringPolicy = DEFAULT) -> Column:
    who = F.lower(F.coalesce(by, F.lit("")))
    return (
        F.when(~F.coalesce(verified, F.lit(False)), F.lit(p.unverified))
        .when(who.contains("foundation"), F.lit(p.verified_by_foundation))
        .when(who.contains("partner"), F.lit(p.verified_by_partner))
        .otherwise(F.lit(p.verified_by_other))
    )


def age_in_days(as_of: Column, modified: Column, ingested: Column) -> Column:
    """Whole days, toward zero, since the source changed, else since it was ingested."""
    seconds = F.unix_timestamp(as_of) - F.unix_timestamp(F.coalesce(modified, ingested))
    return F.when(seconds >= 0, F.floor(seconds / 86400)).otherwise(F.ceil(seconds / 86400)).cast("bigint")


def freshness_multiplier(age: Column, p: ScoringPolicy = DEFAULT) -> Column:
    return F.exp(-F.greatest(age, F.lit(0)) / F.lit(p.decay_days))


def deprecation_multiplier(deprecated: Column, p: ScoringPolicy = DEFAULT) -> Column:
    return F.when(F.coalesce(deprecated, F.lit(False)), F.lit(p.deprecated)).otherwise(F.lit(1.0))


def version_multiplier(match: Column, distance: Column, p: ScoringPolicy = DEFAULT) -> Column:
    """Multiplier of a match class; missing means nothing was asked for."""
    def step(s: float) -> Column:
        return F.greatest(1 - F.lit(s) * distance, F.lit(p.floor))

    return (
        F.when(match == "satisfies", F.lit(p.satisfies))
        .when(match == "near_miss_patch", step(p.patch_step))
        .when(match == "near_miss_minor", step(p.minor_step))
        .when(match == "breaking", F.lit(p.floor))
        .otherwise(F.lit(p.neutral))
    )


def confidence(trust: Column, relevance: Column, p: ScoringPolicy = DEFAULT) -> Column:
    return clamp_unit(F.pow(clamp_unit(trust), F.lit(p.trust_weight)) * F.pow(clamp_unit(relevance), F.lit(p.relevance_weight)))


def score(provenance: Column, age: Column, relevance: Column, version: Column | None = None, p: ScoringPolicy = DEFAULT) -> Column:
    """A struct of trust, confidence and their factors. `version` is a version multiplier."""
    factors = {
        "attribution_multiplier": attribution_multiplier(F.coalesce(provenance["attribution"], F.lit("unknown")), p),
        "verification_multiplier": verification_multiplier(provenance["verified"], provenance["verified_by"], p),
        "freshness_multiplier": freshness_multiplier(age, p),
        "deprecation_multiplier": deprecation_multiplier(provenance["deprecation"]["is_deprecated"], p),
        "version_multiplier": F.lit(p.neutral) if version is None else F.coalesce(version, F.lit(p.neutral)),
    }
    trust = F.lit(1.0)
    for f in factors.values():
        trust = trust * f
    trust = clamp_unit(trust)
    return F.struct(trust.alias("trust"), confidence(trust, relevance, p).alias("confidence"), clamp_unit(relevance).alias("relevance"), *[f.alias(n) for n, f in factors.items()])


def confidence_bucket(c: Column) -> Column:
    return F.when(c >= 0.85, "high").when(c >= 0.7, "medium").when(c >= 0.5, "low").otherwise("very_low")


def authority_level(attribution: Column, verified: Column) -> Column:
    """high for a verified foundation or partner, medium for one of both, else low."""
    strong = F.coalesce(attribution.isin("foundation", "partner"), F.lit(False)).cast("int")
    return F.element_at(F.array(F.lit("low"), F.lit("medium"), F.lit("high")), strong + F.coalesce(verified, F.lit(False)).cast("int") + 1)


def version_fit_label(match: Column, distance: Column, name: Column) -> Column:
    near = F.when(distance.isNull(), F.lit("near-miss")).otherwise(F.concat(F.lit("near-miss (off by "), distance.cast("string"), F.lit(")")))
    return (
        F.when(match == "satisfies", F.when(name.isNull(), F.lit("satisfies")).otherwise(F.concat(F.lit("satisfies "), name)))
        .when(match.startswith("near_miss"), near)
        .when(match == "silent", F.lit("no version declared"))
        .when(match.isNotNull(), F.lit("version unknown"))
    )


# --- vectors ---------------------------------------------------------------------------------------


def dot(a: Column, b: Column) -> Column:
    """In double precision."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; null where a side is null or has no length, or the dimensions differ."""
    n = norm(a) * norm(b)
    return F.when((F.size(a) == F.size(b)) & (n > 0), dot(a, b) / n)


def l2_normalised(a: Column) -> Column:
    """Unit vector; a zero vector stays."""
    n = norm(a)
    return F.when(n > 0, F.transform(a, lambda x: x.cast("double") / n)).otherwise(F.transform(a, lambda x: x.cast("double")))


def nearest_centroid(vector: Column, centroids: Column) -> Column:
    """struct<s, label> of the nearest of the centroids (array of struct<label, centroid>), the later
    label on ties."""
    return F.array_max(F.transform(centroids, lambda c: F.struct(F.round(cosine(vector, c["centroid"]), 12).alias("s"), c["label"].alias("label"))))


def topic_label(best: Column, least: float) -> Column:
    """The label of the nearest centroid, 'other' below `least` or without a vector."""
    return F.when(best["s"] >= least, best["label"]).otherwise(F.lit("other"))


# --- token estimates -------------------------------------------------------------------------------


def char_tokens(text: Column) -> Column:
    """At least one token; a token is four bytes."""
    return F.greatest(F.ceil(F.octet_length(F.coalesce(text, F.lit(""))) / 4), F.lit(1))


def rerank_tokens(query: Column, texts: Column) -> Column:
    """Tokens of a rerank call: the query counts once for each text."""
    each = F.aggregate(texts, F.lit(0).cast("bigint"), lambda s, t: s + F.ceil(F.octet_length(t) / 4))
    return F.greatest(F.ceil(F.octet_length(query) / 4) * F.size(texts) + each, F.lit(1))


def billed_tokens(total: Column, lite: Column) -> Column:
    return F.when(lite, F.ceil(total / 2)).otherwise(total).cast("bigint")
