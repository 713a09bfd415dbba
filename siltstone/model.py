"""The corpus: named tables, their identities, and views on them that every operator starts from."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.session import staged, table

# The closed value sets of the data model.
DOCUMENT_KINDS = ("markdown", "code", "plaintext")
SOURCE_KINDS = ("docs_site", "code_repo", "standalone", "mixed")
PACKAGE_KINDS = ("rust", "npm", "compact", "other")
ATTRIBUTIONS = ("foundation", "partner", "third_party", "community", "unknown")
CONTENT_TYPES = ("tutorial", "guide", "reference", "example", "contract_source", "sdk_source", "test", "readme", "other")
VERSION_STATUSES = ("building", "active", "inactive", "aborted", "retired")
CHUNK_STATUSES = ("ready", "embed_failed", "deprecated")

PROVENANCE = (
    "attribution string, verified boolean, verified_by string, verified_at date, verification_notes string, "
    "language_targets array<struct<name:string,version_constraint:string>>, "
    "sdk_dependencies array<struct<kind:string,name:string,version_constraint:string>>, "
    "deprecation struct<is_deprecated:boolean,since:date,reason:string>, tags array<string>, content_type string"
)


def provenance_of(json: Column) -> Column:
    """The provenance struct of a JSON text; what can't be read has the lowest trust: all fields
    missing, which every reader takes as unknown and unverified."""
    read = F.from_json(json, PROVENANCE, {"mode": "PERMISSIVE"})
    return F.coalesce(read, F.from_json(F.lit("{}"), PROVENANCE))


BROADCAST_IDS = 100_000  # repeated ids that are broadcast (under 10 MB); more are shuffled


def one_per_id(df: DataFrame) -> DataFrame:
    """Rows of an id that are equal in every column, or come late, count once. The columns that are
    used move in a shuffle, so this is for narrow reads."""
    return df.dropDuplicates(["id"])


def first_of_each_id(raw: DataFrame, broadcast_ids: int = BROADCAST_IDS) -> DataFrame:
    """The same for wide reads: ids alone are grouped to find the repeated ones and the places (file and
    row) of all but their first, and those places are taken out. Up to `broadcast_ids` repeated ids the
    places are broadcast and the scan filters them; more go through a filter by id first, so that only
    rows of repeated ids move. The rows kept are the same at every size. `raw` is a Parquet table."""
    place = F.struct(F.xxhash64("_metadata.file_path").alias("f"), F.col("_metadata.row_index").alias("r"))
    again = raw.select("id", place.alias("p")).groupBy("id").agg(F.min("p").alias("keep"), F.count("*").alias("n")).where("n > 1").select("id", "keep")
    found = again.limit(broadcast_ids + 1).collect()
    if not found:
        return raw
    rows = raw.select("*", place.alias("_p"))
    if len(found) <= broadcast_ids:
        rows = rows.join(F.broadcast(raw.sparkSession.createDataFrame(found, again.schema)), "id", "left")
        return rows.where(F.col("keep").isNull() | (F.col("keep") == F.col("_p"))).select(raw.columns)
    again = staged(again, "repeated")
    told = marked(rows, F.col("id"), again.select("id"))
    few = told.where("_maybe").join(again, "id", "left").where(F.col("keep").isNull() | (F.col("keep") == F.col("_p")))
    return told.where("NOT _maybe").select(raw.columns).unionByName(few.select(raw.columns))


MARK_BITS = 26  # 8 MB of marks: at 6.7 million ids a tenth of the other rows is taken for them


def _mark(id_: Column) -> Column:
    return F.pmod(F.xxhash64(id_), F.lit(1 << MARK_BITS)) + 1


def id_marks(ids: DataFrame) -> DataFrame:
    """(_bucket, _bits): a bitmap of the hashes of the ids (the only column), in rows of 4 KB, 2**MARK_BITS
    bits at most."""
    h = ids.select(_mark(F.col(ids.columns[0])).alias("_h"))
    return h.groupBy(F.bitmap_bucket_number("_h").alias("_bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("_h")).alias("_bits"))


def marked(rows: DataFrame, key: Column, ids: DataFrame) -> DataFrame:
    """`rows` with `_maybe`: true for all whose key is among the ids and a few more. The marks are
    broadcast, whose size is bounded whatever the number of ids; nothing is shuffled."""
    told = rows.withColumn("_h", _mark(key)).join(F.broadcast(id_marks(ids)), F.bitmap_bucket_number("_h") == F.col("_bucket"), "left")
    at = F.bitmap_bit_position("_h")
    byte = F.conv(F.hex(F.substring("_bits", (F.floor(at / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    bit = F.pmod(F.floor(byte / F.pow(F.lit(2), at % 8)), F.lit(2)) == 1
    return told.select(*rows.columns, F.coalesce(bit, F.lit(False)).alias("_maybe"))


@dataclass(frozen=True)
class Corpus:
    """The tables of one data directory. Properties are plans; only the wide ones look at ids first."""

    spark: SparkSession
    path: str

    def raw(self, name: str) -> DataFrame:
        return table(self.spark, self.path, name)

    @cached_property
    def sources(self) -> DataFrame:
        return self.raw("corpus_source")

    @cached_property
    def versions(self) -> DataFrame:
        return self.raw("source_version")

    @cached_property
    def packages(self) -> DataFrame:
        return self.raw("source_package")

    @cached_property
    def nodes(self) -> DataFrame:
        return self.raw("node")

    @cached_property
    def models(self) -> DataFrame:
        return self.raw("embedding_model")

    @cached_property
    def documents(self) -> DataFrame:
        return one_per_id(self.raw("new_document"))

    @cached_property
    def chunks(self) -> DataFrame:
        return one_per_id(self.raw("chunk"))

    @cached_property
    def wide_chunks(self) -> DataFrame:
        """Chunks for reads of texts and vectors."""
        return first_of_each_id(self.raw("chunk"))

    @cached_property
    def wide_documents(self) -> DataFrame:
        """Documents for filters that should reach the scan: no aggregate lies between."""
        return first_of_each_id(self.raw("new_document"))

    @cached_property
    def active_versions(self) -> DataFrame:
        return self.versions.where("is_active")

    @cached_property
    def corpus_model(self) -> DataFrame:
        """One row (model_id): the model of the latest active version (at most 3 models exist)."""
        a = self.active_versions.select("embedding_model_id", "ingested_at", "id")
        return a.agg(F.max_by("embedding_model_id", F.struct(F.col("ingested_at"), F.col("id"))).alias("model_id"))
