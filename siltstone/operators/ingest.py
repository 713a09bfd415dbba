"""Planning and running an ingest: what is new, carried over, conflicting or gone."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstone.functions import content, text
from siltstone.session import ship

MAX_BODY = 25 * 1024 * 1024  # fixed value
FILL = 85  # percent of a body that a batch may take
ACCEPTED_DROPS = ("carry requested but no matching prior document; re-embed required", "carry requested but embedding model changed; re-embed required")

CHUNK_SCHEMA = "path string, chunk_index int, total_chunks int, content string, heading_path array<string>, symbol_path array<struct<kind:string,name:string,path:array<string>>>, start_byte int, end_byte int, token_count int, fallback_used boolean"
CLEAN_SCHEMA = "path string, kind string, language string, body string, licenses array<string>, generated boolean, taken map<string,bigint>"


def cleaned(files: DataFrame) -> DataFrame:
    """`files` (path, kind, language, body) with the cleaned body and what was taken."""
    ship(files.sparkSession)
    names = ["path", "kind", "language", "body", "licenses", "generated", "taken"]
    types = [pa.string(), pa.string(), pa.string(), pa.string(), pa.list_(pa.string()), pa.bool_(), pa.map_(pa.string(), pa.int64())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for p, k, lang, body in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
                c = content.clean(k or "plaintext", p, body or "", lang)
                rows.append((p, k, lang, c.body, c.licenses, c.generated, list(c.taken.items())))
            cols = list(zip(*rows, strict=True)) if rows else [[] for _ in names]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=names)

    return files.select("path", "kind", "language", "body").mapInArrow(run, CLEAN_SCHEMA)


def stripped_bytes(clean: DataFrame) -> DataFrame:
    """(what, n_bytes) over all files."""
    return clean.select(F.explode("taken").alias("what", "n")).groupBy("what").agg(F.sum("n").alias("n_bytes"))


def chunked(files: DataFrame, max_tokens: int = content.MAX_TOKENS) -> DataFrame:
    """The pieces of every (path, kind, language, body)."""
    ship(files.sparkSession)
    sym = pa.list_(pa.struct([("kind", pa.string()), ("name", pa.string()), ("path", pa.list_(pa.string()))]))
    names = [c.split()[0] for c in ("path", "chunk_index", "total_chunks", "content", "heading_path", "symbol_path", "start_byte", "end_byte", "token_count", "fallback_used")]
    types = [pa.string(), pa.int32(), pa.int32(), pa.string(), pa.list_(pa.string()), sym, pa.int32(), pa.int32(), pa.int32(), pa.bool_()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for p, k, lang, body in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
                cs = content.chunk(k or "plaintext", p, body or "", lang, max_tokens)
                rows += [(p, i, len(cs), c.content, c.headings, c.symbols, c.start, c.end, c.tokens, c.fallback) for i, c in enumerate(cs)]
            cols = list(zip(*rows, strict=True)) if rows else [[] for _ in names]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=names)

    return files.select("path", "kind", "language", "body").mapInArrow(run, CHUNK_SCHEMA)


def walked(files: DataFrame) -> DataFrame:
    """Documents of a scan with the hash that decides about carrying over."""
    front = F.when(F.col("kind") == "markdown", text.front_matter(F.col("body")))
    rest = F.when(F.col("kind") == "markdown", text.body_after_front_matter(F.col("body"))).otherwise(text.unix_text(F.col("body")))
    return files.withColumn("content_hash", text.document_hash(text.hash_input(front, rest)))


def plan(new: DataFrame, prior: DataFrame) -> DataFrame:
    """(path, decision): new, changed, carried or deleted. `new` and `prior` have path and
    content_hash; one join by path decides all."""
    n = new.select("path", F.col("content_hash").alias("h"))
    p = prior.select("path", F.col("content_hash").alias("ph"))
    j = n.join(p, "path", "full")
    decision = F.when(F.col("h").isNull(), "deleted").when(F.col("ph").isNull(), "new").when(F.col("h") == F.col("ph"), "carried").otherwise("changed")
    return j.select("path", decision.alias("decision"))


def deleted(new: DataFrame, prior: DataFrame) -> DataFrame:
    return prior.join(new.select("path"), "path", "left_anti")


def duplicate_paths(new: DataFrame, order: str) -> DataFrame:
    """Rows of a path after its first."""
    w = Window.partitionBy("path").orderBy(order)
    return new.withColumn("nth", F.row_number().over(w)).where("nth > 1")


def upload_decision(carried: Column, has_chunks: Column, prior_match: Column, can_carry: Column) -> Column:
    """carry, insert, or why not."""
    return (
        F.when(carried & prior_match & can_carry, "carry")
        .when(carried & ~prior_match, F.lit(ACCEPTED_DROPS[0]))
        .when(carried, F.lit(ACCEPTED_DROPS[1]))
        .when(has_chunks, "insert")
        .otherwise("document has no chunks; refusing to insert an unsearchable document")
    )


def intentional_drop(reason: Column) -> Column:
    return reason.isin(*ACCEPTED_DROPS)


def carried_chunks(prior_chunks: DataFrame, carried: DataFrame, version_id: str) -> DataFrame:
    """Chunks of carried documents under the new version; `carried` has document_id and
    new_document_id."""
    c = prior_chunks.join(carried, "document_id")
    new_id = F.sha2(F.concat(F.col("id"), F.lit(version_id)), 256)
    return c.withColumn("id", new_id).withColumn("document_id", F.col("new_document_id")).withColumn("source_version_id", F.lit(version_id)).drop("new_document_id")


def same_model(old: DataFrame, new: DataFrame) -> Column:
    return old["embedding_model_id"].eqNullSafe(new["embedding_model_id"])


def attached(chunks: DataFrame, vectors: DataFrame, column: str = "embedding", only_code: bool = False) -> DataFrame:
    """Vectors joined by (document_id, chunk_index); with `only_code` other kinds keep none."""
    v = vectors.select("document_id", "chunk_index", F.col("vector").alias("_v"))
    out = chunks.join(v, ["document_id", "chunk_index"], "left")
    value = F.when(F.col("kind") == "code", F.col("_v")) if only_code else F.col("_v")
    return out.withColumn(column, value).drop("_v")


def embed_failed(chunks: DataFrame) -> DataFrame:
    """Chunks that wait for another embedding run."""
    return chunks.where("status = 'embed_failed'")


def vector_mismatches(chunks: DataFrame, vectors: DataFrame) -> DataFrame:
    """Documents whose number of vectors isn't that of their chunks."""
    a = chunks.groupBy("document_id").agg(F.count("*").alias("n_chunks"))
    b = vectors.groupBy("document_id").agg(F.count("*").alias("n_vectors"))
    return a.join(b, "document_id", "full").where(~F.col("n_chunks").eqNullSafe(F.col("n_vectors")))


def body_bytes(path: Column, is_code: Column, contents: Column) -> Column:
    """Estimated bytes of a document in an upload: texts, vectors (two for code) and frames."""
    text_bytes = F.aggregate(contents, F.lit(0).cast("bigint"), lambda s, c: s + F.octet_length(c))
    vector = F.when(is_code, F.lit(2)).otherwise(F.lit(1)) * 1024 * 12
    return F.octet_length(path) + 512 + text_bytes + F.size(contents) * (vector + 256)


def oversize(docs: DataFrame, size: str = "n_bytes", limit: int = MAX_BODY) -> DataFrame:
    return docs.where(F.col(size) > limit)


def overlaid(own: Column, extracted: Column, above: Column) -> Column:
    """Provenance by field: front matter, then what was extracted, then the directory; a field's
    default doesn't count as said."""
    def pick(name: str, default=None) -> Column:
        said = [F.when(c[name] != default, c[name]) if default is not None else c[name] for c in (own, extracted, above)]
        return F.coalesce(*said, *([F.lit(default)] if default is not None else []))

    def pick_list(name: str) -> Column:
        return F.coalesce(*[F.when(F.size(c[name]) > 0, c[name]) for c in (own, extracted, above)])

    return F.struct(pick("attribution", "unknown").alias("attribution"), pick("verified", False).alias("verified"), pick("verified_by").alias("verified_by"), pick_list("tags").alias("tags"), pick_list("language_targets").alias("language_targets"), pick_list("sdk_dependencies").alias("sdk_dependencies"), pick("content_type", "other").alias("content_type"))


def nearest_above(files: DataFrame, marked: DataFrame, keep: list[str]) -> DataFrame:
    """Files (scope, path) with `keep` of the nearest directory (scope, dir) above that is marked,
    by equality on the few directories of each path."""
    parts = F.split("path", "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, 1, F.size(parts) - k), "/"))
    up = files.select("scope", "path", F.posexplode(above).alias("up", "dir"))
    hit = up.join(marked, ["scope", "dir"]).groupBy("scope", "path").agg(F.min_by(F.struct("dir", *keep), "up").alias("n"))
    return files.join(hit, ["scope", "path"], "left").select(*[files[c] for c in files.columns], F.col("n.dir").alias("dir"), *[F.col(f"n.{k}").alias(k) for k in keep])


def licenses_by_path(own: DataFrame, above: DataFrame) -> DataFrame:
    """(scope, path, licenses): the file's own, else those of the directory."""
    return own.join(above.select("scope", "path", F.col("licenses").alias("dir_licenses")), ["scope", "path"], "left").select("scope", "path", F.coalesce(F.when(F.size("licenses") > 0, F.col("licenses")), F.col("dir_licenses")).alias("licenses"))


def run_report(rows: DataFrame, path: str) -> None:
    """One JSON file; the commit of the job makes it appear whole."""
    rows.coalesce(1).write.mode("overwrite").json(path)
