"""Scanning files: what is read, and why the rest is skipped. A bad file is a row, never a failure."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.functions import text

MAX_FILE_BYTES, MAX_LINE_BYTES = 1_048_576, 10_000
SKIP_REASONS = ("not_regular_file", "too_large", "long_line", "binary", "not_utf8", "empty_no_chunks", "generated_file")  # fixed values


def read_files(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """(path, length, modification_time, content) of the files under a directory."""
    r = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if glob:
        r = r.option("pathGlobFilter", glob)
    return r.load(path).select("path", "length", F.col("modificationTime").alias("modification_time"), "content")


def skip_reason(content: Column, length: Column, path: Column, max_file_bytes: int = MAX_FILE_BYTES, max_line_bytes: int = MAX_LINE_BYTES) -> Column:
    """Why a file is skipped, or null. The order is the order of the checks; a limit of 0 is off."""
    body = content.cast("string")
    out = F.when(content.isNull(), "not_regular_file")
    if max_file_bytes:
        out = out.when(length > max_file_bytes, "too_large")
    out = out.when(text.looks_binary(content), "binary").when(~text.is_utf8(content), "not_utf8")
    if max_line_bytes:
        out = out.when(text.longest_line(body) > max_line_bytes, "long_line")
    code = text.kind_of(path) == "code"
    out = out.when(code & text.looks_generated(body) & ~path.endswith(".d.ts"), "generated_file")
    return out.when(F.trim(F.regexp_replace(body, r"\s+", " ")) == "", "empty_no_chunks")


def scan(files: DataFrame, includes: list[str] = (), excludes: list[str] = (), defaults: bool = True, known_kind: bool = True, **limits) -> DataFrame:
    """Files that the filter ladder lets through, with kind, language and skip reason."""
    p = text.clean_path(F.col("path"))
    f = files.withColumn("path", p).where(text.path_allowed(F.col("path"), includes, excludes, defaults, known_kind))
    return f.withColumn("kind", text.kind_of(F.col("path"))).withColumn("language", text.language_of(F.col("path"))).withColumn("skip_reason", skip_reason(F.col("content"), F.col("length"), F.col("path"), **limits))


def skipped(scanned: DataFrame) -> DataFrame:
    """(skip_reason, n_files)."""
    return scanned.where("skip_reason IS NOT NULL").groupBy("skip_reason").agg(F.count("*").alias("n_files"))


def bodies(scanned: DataFrame) -> DataFrame:
    """Files to ingest with their text."""
    return scanned.where("skip_reason IS NULL").withColumn("body", text.unix_text(F.col("content").cast("string"))).drop("content", "skip_reason")


def ignore_rules(lines: list[str]) -> list[tuple[bool, str]]:
    """(keeps, regular expression) of each rule of an ignore file, in order."""
    out = []
    for raw in lines:
        line = raw.rstrip()
        if not line or line.startswith("#"):
            continue
        keeps, line = line.startswith("!"), line.removeprefix("!")
        only_dir, line = line.endswith("/"), line.rstrip("/")
        rooted, line = "/" in line, line.removeprefix("/")
        body = text.glob_regex(line)[1:-1].replace(".*", "[^/]*") if "**" not in line else text.glob_regex(line)[1:-1]
        out.append((keeps, ("^" if rooted else "(^|/)") + body + ("/" if only_dir else "(/|$)")))
    return out


def not_ignored(path: Column, lines: list[str]) -> Column:
    """Whether the rules of an ignore file let a path through; the last rule that matches decides."""
    verdict = F.lit(True)
    for keeps, r in ignore_rules(lines):
        verdict = F.when(path.rlike(r), F.lit(keeps)).otherwise(verdict)
    return verdict


def not_hidden(path: Column) -> Column:
    return ~path.rlike(r"(^|/)\.[^/]+")
