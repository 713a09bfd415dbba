"""Manifests: a tree of nodes with files and directories, flattened to one row a file; generation
from listings and sitemaps; matching of files and pages."""

from __future__ import annotations

from dataclasses import dataclass, field
from pathlib import PurePosixPath

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.functions import text

PIN_LEAVES = 5  # fixed value: leaves without a page that make a directory one entry


class ManifestError(ValueError):
    """A manifest that can't be used."""


@dataclass
class Node:
    """A node of the tree; what isn't set is inherited."""

    name: str = ""
    path: str | None = None
    file: str | None = None
    published_url: str | None = None
    provenance: dict = field(default_factory=dict)
    no_extract: bool | None = None
    include: list[str] = field(default_factory=list)
    exclude: list[str] = field(default_factory=list)
    children: list[Node] = field(default_factory=list)


def parse(body: str) -> Node:
    """The tree of a YAML (or JSON) manifest of version 1."""
    try:
        import yaml

        doc = yaml.safe_load(body)
    except ImportError:  # JSON is the part of YAML that needs no parser
        import json

        doc = json.loads(body)
    if not isinstance(doc, dict) or doc.get("manifest_version") != 1:
        raise ManifestError("manifest_version must be 1")

    def node(d: dict) -> Node:
        known = {k: d[k] for k in ("name", "path", "file", "published_url", "provenance", "no_extract", "include", "exclude") if d.get(k) is not None}
        return Node(**known, children=[node(c) for c in d.get("children") or []])

    tree = node({k: v for k, v in doc.items() if k != "manifest_version"} | {"children": doc.get("children") or doc.get("nodes") or []})
    validate(tree)
    return tree


def _nodes(n: Node):
    yield n
    for c in n.children:
        yield from _nodes(c)


def validate(tree: Node) -> None:
    """Relative paths without '..', and each file once."""
    files = [n.file for n in _nodes(tree) if n.file]
    for p in [*files, *(n.path for n in _nodes(tree) if n.path)]:
        if p.startswith("/") or ".." in PurePosixPath(p).parts:
            raise ManifestError(f"{p} leaves the manifest's directory")
    twice = sorted({f for f in files if files.count(f) > 1})
    if twice:
        raise ManifestError(f"{twice[0]} is listed twice")


def manifest_rows(tree: Node) -> list[tuple]:
    """(is_file, target, url, provenance, no_extract, include, exclude) of all entries, with what
    they inherit."""
    out: list[tuple] = []

    def down(n: Node, url: str | None, prov: dict, no_extract: bool) -> None:
        url = n.published_url or url
        prov = {**prov, **n.provenance}  # the deeper value of a key wins
        no_extract = no_extract if n.no_extract is None else n.no_extract
        for target, is_file in ((n.file, True), (n.path, False)):
            if target:
                out.append((is_file, target.strip("/").removeprefix("./"), url, {k: str(v) for k, v in prov.items()}, no_extract, n.include, n.exclude))
        for c in n.children:
            down(c, url, prov, no_extract)

    down(tree, None, {}, False)
    return out


def resolved(spark: SparkSession, tree: Node, listing: DataFrame) -> DataFrame:
    """(path, published_url, provenance, no_extract) of every listed file the manifest reaches: by
    name, or under the deepest directory entry whose globs allow it. Files named themselves belong
    to no directory."""
    schema = "is_file boolean, target string, url string, provenance map<string,string>, no_extract boolean, include array<string>, exclude array<string>"
    entries = spark.createDataFrame(manifest_rows(tree), schema)
    files = listing.select(text.clean_path(F.col("path")).alias("path")).distinct()
    cols = ["path", "url", "provenance", "no_extract"]
    named = files.join(entries.where("is_file"), F.col("path") == F.col("target")).select(cols)
    parts = F.split("path", "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, 1, F.size(parts) - k), "/"))
    open_ = files.join(named.select("path"), "path", "left_anti").select("path", F.posexplode(above).alias("up", "dir"))
    dirs = [r for r in manifest_rows(tree) if not r[0]]
    found = open_.join(entries.where("NOT is_file").withColumn("dir", F.when(F.col("target") == ".", F.lit("")).otherwise(F.col("target"))), "dir")
    keep = F.lit(True)
    for _, target, _, _, _, include, exclude in dirs:  # globs are those of the manifest's entries
        if include or exclude:
            here = F.col("target") == target
            ok = (text.glob_matches(F.col("path"), include) if include else F.lit(True)) & ~text.glob_matches(F.col("path"), exclude)
            keep = keep & (~here | ok)
    best = found.where(keep).groupBy("path").agg(F.min_by(F.struct("url", "provenance", "no_extract"), "up").alias("b")).select("path", "b.*")
    both = named.unionByName(best.select(cols))
    return both.select("path", text.composed_url(F.col("url"), F.col("path")).alias("published_url"), "provenance", "no_extract")


def shared_prefixes(urls: DataFrame, least: int = 2) -> DataFrame:
    """(dir, prefix): directories where all files (at least `least`) have pages under one prefix."""
    u = urls.select(text.dirname(F.col("path")).alias("dir"), F.regexp_replace("url", r"[^/]+/?$", "").alias("prefix"))
    return u.groupBy("dir").agg(F.count_distinct("prefix").alias("n_prefixes"), F.count("*").alias("n"), F.count("prefix").alias("with_url"), F.first("prefix", True).alias("prefix")).where((F.col("n_prefixes") == 1) & (F.col("n") >= least) & (F.col("with_url") == F.col("n"))).select("dir", "prefix")


def pinned_dirs(urls: DataFrame, least: int = PIN_LEAVES) -> DataFrame:
    """Directories with at least `least` files of which none has a page."""
    return urls.groupBy(text.dirname(F.col("path")).alias("dir")).agg(F.count("*").alias("n"), F.count("url").alias("with_url")).where((F.col("n") >= least) & (F.col("with_url") == 0)).select("dir", "n")


def match_pages(files: DataFrame, urls: DataFrame) -> DataFrame:
    """(path, url): the page of each file: the first page that ends in the file's slug (column
    `slug`, if there is one), else the same last part and then the longest common tail of both
    paths; no page on ties. The join is by the last part; only files and pages that share it meet."""
    if "slug" in files.columns:
        last = urls.select("url", F.element_at(text.url_parts(F.col("url")), -1).alias("slug"))
        by_slug = files.where("slug IS NOT NULL").join(last, "slug").groupBy("path").agg(F.min("url").alias("url"))
        return by_slug.unionByName(match_pages(files.select("path").join(by_slug, "path", "left_anti"), urls))
    f = files.select("path").distinct().withColumn("fp", text.file_parts(F.col("path"))).where(F.size("fp") > 0).withColumn("last", F.element_at("fp", -1))
    u = urls.select("url").distinct().withColumn("up", text.url_parts(F.col("url"))).where(F.size("up") > 0).withColumn("last", F.element_at("up", -1))
    j = f.join(u, "last").withColumn("tail", text.common_tail(F.col("fp"), F.col("up")))
    best = j.groupBy("path").agg(F.max("tail").alias("tail"))
    top = j.join(best, ["path", "tail"])
    return top.groupBy("path").agg(F.count("*").alias("n"), F.first("url").alias("url")).where("n = 1").select("path", "url")


def sitemap_urls(sitemaps: DataFrame) -> DataFrame:
    """(url, is_index) of each location in sitemap bodies (url set or index)."""
    return sitemaps.select(F.col("body").rlike(r"<sitemapindex\b").alias("is_index"), F.explode(text.sitemap_locations(F.col("body"))).alias("url")).select(F.trim("url").alias("url"), "is_index").distinct()


def generate(urls: DataFrame) -> DataFrame:
    """(dir, entry, target, url): manifest entries for a listing with pages where known: a pinned
    directory is one entry, other files are one each, with their page unless the directory has it."""
    pins = pinned_dirs(urls).select("dir")
    shared = shared_prefixes(urls)
    d = urls.withColumn("dir", text.dirname(F.col("path")))
    files = d.join(pins, "dir", "left_anti").join(shared, "dir", "left")
    rows = files.select("dir", F.lit("file").alias("entry"), F.col("path").alias("target"), F.when(F.col("prefix").isNull(), F.col("url")).alias("url"))
    heads = shared.select("dir", F.lit("prefix").alias("entry"), F.col("dir").alias("target"), F.col("prefix").alias("url"))
    return rows.unionByName(heads).unionByName(pins.select("dir", F.lit("path").alias("entry"), F.col("dir").alias("target"), F.lit(None).cast("string").alias("url")))

