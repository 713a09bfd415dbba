"""Detection of injected instructions: levelled text, rules, scores and verdicts."""

from __future__ import annotations

import base64
import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Characters dropped, and look-alike letters folded, before matching.
ZERO_WIDTH = "​‌‍⁠﻿­"
LOOK_ALIKE_FROM = "аеорсхуіјһԁԛѕкмтнвοαινρυ"
LOOK_ALIKE_TO = "aeopcxyijhdqskmthboaivpu"
_FOLD = {**dict.fromkeys(map(ord, ZERO_WIDTH)), **{ord(a): b for a, b in zip(LOOK_ALIKE_FROM, LOOK_ALIKE_TO, strict=True)}}
_FOLD |= {c: None for c in [*range(0x20), *range(0x7F, 0xA0)] if c not in (9, 10, 13)}
_RUN = re.compile(r"[A-Za-z0-9+/]{16,}={0,2}")

# Technique, weight and pattern of each rule.
RULES: list[tuple[str, float, str]] = [
    ("instruction_override", 0.9, r"\b(ignore|disregard|forget)\s+(all\s+|any\s+)?(previous|prior|above|earlier)\s+(instructions|prompts|context|rules)\b"),
    ("instruction_override", 0.9, r"\bdisregard\s+(everything|all)\b"),
    ("role_injection", 0.8, r"\byou\s+are\s+now\s+(a|an|the)\b"),
    ("role_injection", 0.8, r"(?m)^\s*(system|assistant|developer)\s*:"),
    ("role_injection", 0.8, r"\bact\s+as\s+(an?\s+)?(unrestricted|dan|jailbroken)\b"),
    ("system_prompt_leak", 0.8, r"\b(reveal|print|repeat|show|output)\s+(your|the)\s+(system\s+prompt|initial\s+instructions|system\s+message)\b"),
    ("tool_call_smuggle", 0.85, r"\b(ignore|disregard|forget|then|now)\b.{0,40}\b(call|invoke|execute|run)\s+the\s+\w+\s+tool\b"),
    ("tool_call_smuggle", 0.85, r"(<\s*tool_call\b|\bfunction_call\s*:)"),
    ("data_exfil", 0.85, r"\b(send|post|exfiltrate|upload|leak)\b.*\b(https?://|api[_-]?key|secret|token|credentials)\b"),
    ("data_exfil", 0.85, r"\bcurl\s+https?"),
]


def level(text: str) -> tuple[str, list[int]]:
    """(levelled text, for each of its bytes the byte of the original it stems from)."""
    out: list[str] = []
    origin: list[int] = []
    at = 0
    for ch in text:
        width = len(ch.encode("utf-8", "surrogatepass"))
        got = unicodedata.normalize("NFKC", ch.translate(_FOLD)).lower() if ord(ch) in _FOLD or not ch.isascii() else ch.lower()
        if got:
            out.append(got)
            origin += [at] * len(got.encode("utf-8", "surrogatepass"))
        at += width
    for m in _RUN.finditer(text):
        run = m.group()
        try:
            plain = base64.b64decode(run, validate=True).decode("utf-8")
        except ValueError:
            continue
        if plain:
            more = "\n" + plain.lower()
            out.append(more)
            origin += [len(text[: m.start()].encode("utf-8", "surrogatepass"))] * len(more.encode("utf-8", "surrogatepass"))
    return "".join(out), origin


def original_span(origin: list[int], size: int, start: int, end: int) -> tuple[int, int]:
    """Bytes of the original that bytes [start, end) of the levelled text stem from."""
    if not origin or start >= len(origin):
        return size, size
    after = next((o for o in origin[end:] if o > origin[max(start, end - 1)]), size) if end <= len(origin) else size
    return origin[start], after


def rule_columns(levelled: Column) -> dict[str, Column]:
    """Hits of each rule in levelled text, in the JVM."""
    return {f"{t}_{i}": F.regexp_count(levelled, F.lit(p)) for i, (t, _, p) in enumerate(RULES)}


def pattern_score(levelled: Column) -> Column:
    """Largest weight of the rules that hit, else 0."""
    return F.greatest(*[F.when(levelled.rlike(p), F.lit(w)).otherwise(F.lit(0.0)) for _, w, p in RULES])


def techniques(levelled: Column) -> Column:
    """The techniques that hit, sorted."""
    return F.array_sort(F.array_distinct(F.array_compact(F.array(*[F.when(levelled.rlike(p), F.lit(t)) for t, _, p in RULES]))))


def levelled_plain(text: Column) -> Column:
    """Levelled text by JVM expressions only: zero width, controls, look-alikes, case. (NFKC and
    decoded runs need `level_udf`.)"""
    c = F.regexp_replace(text, r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F-\x9F" + ZERO_WIDTH + "]", "")
    return F.lower(F.translate(c, LOOK_ALIKE_FROM, LOOK_ALIKE_TO))


@F.pandas_udf(StringType())
def level_udf(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Levelled text with NFKC and decoded runs."""
    for s in texts:
        yield s.map(lambda t: None if t is None else level(t)[0])


def blend(pattern: Column, model: Column, pattern_weight: float = 0.5, model_weight: float = 0.5) -> Column:
    """Weighted mean of both scores; the pattern score alone without a model score."""
    p = F.least(F.greatest(pattern, F.lit(0.0)), F.lit(1.0))
    if pattern_weight + model_weight <= 0:
        return p
    both = (pattern_weight * pattern + model_weight * model) / (pattern_weight + model_weight)
    return F.when(model.isNull(), p).otherwise(F.least(F.greatest(both, F.lit(0.0)), F.lit(1.0)))


def model_gated(attribution: Column, gates: tuple[str, ...] = ("third_party", "community", "unknown")) -> Column:
    """Whether the costlier model pass runs for this origin."""
    return F.coalesce(attribution, F.lit("unknown")).isin(*gates)


def verdict(blended: Column, reject: float = 0.85) -> Column:
    return F.when(blended >= reject, "reject").otherwise("accept")


def malicious_probability(labels: Column) -> Column:
    """From array<struct<label, score>> of a classifier: the best malicious label, else what the
    best harmless label leaves."""
    bad = F.filter(labels, lambda x: F.lower(x["label"]).rlike("injection|malicious|jailbreak|unsafe|label_1"))
    good = F.filter(labels, lambda x: F.lower(x["label"]).rlike("benign|safe|legit|label_0") & ~F.lower(x["label"]).rlike("unsafe"))
    return F.coalesce(F.array_max(F.transform(bad, lambda x: x["score"])), 1 - F.array_max(F.transform(good, lambda x: x["score"])))


def document_probability(windows: DataFrame) -> DataFrame:
    """(id, probability): the largest of a document's windows (id, probability)."""
    return windows.groupBy("id").agg(F.max("probability").alias("probability"))
