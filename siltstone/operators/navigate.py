"""Reading around a chunk: neighbours, windows of a document, ancestors, lookups by id."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siltstone.model import Corpus

MAX_IDS = 20


def visible(chunks: DataFrame) -> DataFrame:
    """Reads hide failed chunks only; deprecated ones stay."""
    return chunks.where("status <> 'embed_failed'")


def parse_ids(raw: str) -> list[str]:
    """1 to 20 ids of a comma-separated list."""
    ids = [x.strip() for x in raw.split(",") if x.strip()]
    if not 1 <= len(ids) <= MAX_IDS:
        raise ValueError(f"1 to {MAX_IDS} ids")
    return ids


def positions(chunks: DataFrame) -> DataFrame:
    """Visible chunks with their position in the document (0-based, without gaps)."""
    w = Window.partitionBy("document_id").orderBy("chunk_index", "id")
    return visible(chunks).withColumn("position", F.row_number().over(w) - 1)


def following(chunks: DataFrame, anchors: DataFrame, count: int, back: bool = False) -> DataFrame:
    """(anchor_id, id, chunk_index, step): the next (or previous) visible chunks of each anchor id. One
    window counts the visible chunks up to each row, another numbers them, and the wanted numbers are
    joined by equality: linear in the chunks of a document."""
    key = F.desc("chunk_index") if back else F.asc("chunk_index")
    rows = chunks.select("id", "document_id", "chunk_index", (F.col("status") != "embed_failed").alias("v"))
    whole = anchors is chunks
    if not whole:  # only documents that hold an anchor
        rows = rows.join(rows.join(anchors.select("id"), "id", "left_semi").select("document_id").distinct(), "document_id", "left_semi")
    a = rows.withColumn("seen", F.count_if("v").over(Window.partitionBy("document_id").orderBy(key)).cast("int"))  # rows of one index are peers
    a = a if whole else a.join(anchors.select("id"), "id", "left_semi")
    a = a.select(F.col("id").alias("anchor_id"), "document_id", F.posexplode(F.sequence(F.col("seen") + 1, F.col("seen") + count)).alias("k", "place"))
    to = rows.where("v").withColumn("place", F.row_number().over(Window.partitionBy("document_id").orderBy(key, F.asc("id"))))
    return a.join(to, ["document_id", "place"]).select("anchor_id", "id", "chunk_index", (F.col("k") + 1).alias("step"))


def neighbours(chunks: DataFrame, anchors: DataFrame, count: int) -> DataFrame:
    """(anchor_id, id, chunk_index, offset): previous, the anchor itself, and next."""
    before = following(chunks, anchors, count, back=True).select("anchor_id", "id", "chunk_index", (-F.col("step")).alias("offset"))
    after = following(chunks, anchors, count).select("anchor_id", "id", "chunk_index", F.col("step").alias("offset"))
    own = visible(chunks).join(anchors.select("id"), "id", "left_semi").select(F.col("id").alias("anchor_id"), "id", "chunk_index", F.lit(0).alias("offset"))
    return before.unionByName(own).unionByName(after)


def document_window(chunks: DataFrame, document_id: str, start: int, count: int) -> DataFrame:
    """Bodies of a document's chunks from a position, with the total."""
    doc = positions(chunks.where(F.col("document_id") == document_id))
    total = F.count("*").over(Window.partitionBy("document_id"))
    return doc.withColumn("total", total).where((F.col("position") >= start) & (F.col("position") < start + count)).select("position", "id", "chunk_index", "content", "total")


def skeleton(chunks: DataFrame) -> DataFrame:
    """(document_id, id, chunk_index, headings, symbol, tokens): a document without bodies."""
    first = F.when(F.size("symbol_path") > 0, F.col("symbol_path")[0])
    return visible(chunks).select("document_id", "id", "chunk_index", F.array_join(F.coalesce("heading_path", F.array().cast("array<string>")), " > ").alias("headings"), first["kind"].alias("symbol_kind"), first["name"].alias("symbol_name"), "token_count")


def outline(chunks: DataFrame, document_id: str, n: int = 50) -> DataFrame:
    """The first lines of a document's outline."""
    s = skeleton(chunks.where(F.col("document_id") == document_id))
    label = F.concat_ws(" ", F.nullif("headings", F.lit("")), F.concat_ws(" ", "symbol_kind", "symbol_name"))
    return s.select("chunk_index", "id", F.concat(F.lit("- ["), F.col("chunk_index"), F.lit("] "), label).alias("line")).orderBy("chunk_index", "id").limit(n)


def breadcrumb(symbol_path: Column) -> Column:
    return F.array_join(F.transform(symbol_path, lambda s: s["name"]), " > ")


def with_context(corpus: Corpus, ids: list[str]) -> DataFrame:
    """Chunks by id with document, version and source."""
    c = visible(corpus.chunks).where(F.col("id").isin(ids))
    d = corpus.documents.select(F.col("id").alias("document_id"), "source_path", "kind", "language")
    v = corpus.versions.select(F.col("id").alias("source_version_id"), "source_id", "revision")
    s = corpus.sources.select(F.col("id").alias("source_id"), F.col("slug").alias("source_slug"))
    return c.join(d, "document_id").join(v, "source_version_id").join(s, "source_id").select("id", "chunk_index", "content", "source_path", "kind", "language", "revision", "source_slug")


def batch_get(spark: SparkSession, rows: DataFrame, ids: list[str], key: str = "id") -> DataFrame:
    """(position, wanted, found): rows of the ids in the order asked for; an id asked again, or
    unknown, is missing."""
    seen: set[str] = set()
    asked = []
    for p, i in enumerate(ids):
        asked.append((p, i, i in seen))
        seen.add(i)
    a = spark.createDataFrame(asked, "position int, wanted string, again boolean")
    hit = rows.where(F.col(key).cast("string").isin(list(seen))).select(F.col(key).cast("string").alias("k"))
    return a.join(hit.distinct(), F.col("wanted") == F.col("k"), "left").select("position", "wanted", (F.col("k").isNotNull() & ~F.col("again")).alias("found"))


def ancestors(spark: SparkSession, nodes: DataFrame, start: DataFrame, max_depth: int = 1000) -> DataFrame:
    """(id, ancestor_id, depth), nearest first: each start node's chain of parents, whatever its length.
    One recursive plan; the tree is read once a level. A chain longer than `max_depth` (a cycle of
    parents among them) is an error, it isn't cut. The depth bounds the rows; Spark's own limit, a
    million for all levels together, is off."""
    nodes.select("id", "parent_node_id").distinct().createOrReplaceTempView("siltstone_edges")
    start.select("id").distinct().createOrReplaceTempView("siltstone_start")
    spark.conf.set("spark.sql.cteRecursionLevelLimit", str(max_depth + 2))
    spark.conf.set("spark.sql.cteRecursionRowLimit", "-1")
    up = spark.sql(f"""
        WITH RECURSIVE up(id, ancestor_id, depth) AS (
            SELECT s.id, e.parent_node_id, 1 FROM siltstone_start s JOIN siltstone_edges e ON e.id = s.id WHERE e.parent_node_id IS NOT NULL
            UNION ALL
            SELECT u.id, e.parent_node_id, u.depth + 1 FROM up u JOIN siltstone_edges e ON e.id = u.ancestor_id
            WHERE e.parent_node_id IS NOT NULL AND u.depth <= {int(max_depth)})
        SELECT id, ancestor_id, depth FROM up""")
    too_long = F.raise_error(F.concat(F.lit("chain of parents too long or in a cycle at "), F.col("id")))
    return up.withColumn("depth", F.when(F.col("depth") > max_depth, too_long.cast("int")).otherwise(F.col("depth")))


def ancestors_with_documents(corpus: Corpus, start: DataFrame) -> DataFrame:
    """The same with name and kind of the ancestor and the document that hangs on it, if any."""
    n = corpus.nodes.select(F.col("id").alias("ancestor_id"), "name", "kind").distinct()
    d = corpus.documents.select(F.col("node_id").alias("ancestor_id"), F.col("id").alias("document_id"))
    return ancestors(corpus.spark, corpus.nodes, start).join(n, "ancestor_id").join(d, "ancestor_id", "left").select("id", "ancestor_id", "depth", "name", "kind", "document_id")


def keyset_page(rows: DataFrame, key: str, after: str | None, n: int) -> DataFrame:
    """The next n keys after a cursor, with a flag on the last if more follow."""
    r = rows if after is None else rows.where(F.col(key) > after)
    got = r.orderBy(key).limit(n + 1)
    w = Window.orderBy(key)  # n + 1 rows
    return got.withColumn("_k", F.row_number().over(w)).withColumn("more", F.max("_k").over(Window.partitionBy()) > n).where(F.col("_k") <= n).drop("_k")


# --- lookups ---------------------------------------------------------------------------------------


def exists(rows: DataFrame, id_: str) -> bool:
    """Tells an empty answer from an unknown anchor."""
    return not rows.where(F.col("id") == id_).select("id").limit(1).isEmpty()


def version_at(versions: DataFrame, source_id: str, revision: int) -> DataFrame:
    return versions.where((F.col("source_id") == source_id) & (F.col("revision") == revision))


def newest_first(versions: DataFrame) -> DataFrame:
    """(source_id, id, revision, place): the versions of each source, newest revision first."""
    w = Window.partitionBy("source_id").orderBy(F.desc("revision"), "id")
    return versions.select("source_id", "id", "revision", F.row_number().over(w).alias("place"))


def documents_by_hash(documents: DataFrame, version_id: str, content_hash: str) -> DataFrame:
    return documents.where((F.col("source_version_id") == version_id) & (F.lower("content_hash") == content_hash.lower()))


def symbols_of_chunk(chunks: DataFrame, id_: str) -> DataFrame:
    """(position, kind, name, path) of a chunk's symbols."""
    return chunks.where(F.col("id") == id_).select(F.posexplode("symbol_path").alias("position", "s")).select("position", "s.kind", "s.name", "s.path")


def list_sources(sources: DataFrame, kind: str | None = None, retired: bool | None = None, after: str | None = None) -> DataFrame:
    """Sources by slug; each condition only if it is given."""
    out = sources
    if kind is not None:
        out = out.where(F.col("kind") == kind)
    if retired is not None:
        out = out.where(F.col("retired_at").isNotNull() == F.lit(retired))
    if after is not None:
        out = out.where(F.col("slug") > after)
    return out.orderBy("slug")


def packages_of(packages: DataFrame, version_id: str) -> DataFrame:
    return packages.where(F.col("source_version_id") == version_id).orderBy("kind", "name")


def chunks_in_order(chunks: DataFrame, document_id: str) -> DataFrame:
    return chunks.where(F.col("document_id") == document_id).orderBy("chunk_index")
