"""Queries on the star schema and the event stream: windows, budgets, hierarchies, usage limits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siltstone.operators import analytics, batching, lifecycle, navigate, quota
from siltstone.queries import query
from siltstone.session import table


def _usage(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select(F.col("user_id").cast("string").alias("subject"), "ts", F.round(F.col("value") * 100).cast("bigint").alias("tokens"))


_MIN = "m AS (SELECT CAST(user_id AS VARCHAR) AS subject, CAST(floor(epoch(ts) / 60) AS BIGINT) AS minute, CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) AS tokens FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL GROUP BY 1, 2)"


@query("token_window_hour", f"WITH {_MIN} SELECT subject, minute, tokens, CAST(sum(tokens) OVER w AS BIGINT) AS used, (min(minute) OVER w + 60) * 60 AS reset_at FROM m WINDOW w AS (PARTITION BY subject ORDER BY minute RANGE BETWEEN 59 PRECEDING AND CURRENT ROW)")
def token_window_hour(spark: SparkSession, sf: str) -> DataFrame:
    return quota.hour_window(quota.per_minute(_usage(spark, sf)))


@query("token_window_day", f"WITH {_MIN}, h AS (SELECT subject, CAST(floor(minute / 60) AS BIGINT) AS hour, CAST(sum(tokens) AS BIGINT) AS tokens FROM m GROUP BY 1, 2) SELECT subject, hour, tokens, CAST(sum(tokens) OVER w AS BIGINT) AS used, (min(hour) OVER w + 24) * 3600 AS reset_at FROM h WINDOW w AS (PARTITION BY subject ORDER BY hour RANGE BETWEEN 23 PRECEDING AND CURRENT ROW)")
def token_window_day(spark: SparkSession, sf: str) -> DataFrame:
    return quota.day_window(quota.per_minute(_usage(spark, sf)))


@query("limit_exceeded", f"WITH {_MIN}, u AS (SELECT subject, minute, CAST(sum(tokens) OVER (PARTITION BY subject ORDER BY minute RANGE BETWEEN 59 PRECEDING AND CURRENT ROW) AS BIGINT) AS used FROM m) SELECT subject, minute, used FROM u WHERE used > 20000")
def limit_exceeded(spark: SparkSession, sf: str) -> DataFrame:
    return quota.exceeded(token_window_hour(spark, sf), F.lit(20_000)).select("subject", "minute", "used")


@query("limit_remaining", f"WITH {_MIN}, u AS (SELECT subject, minute, CAST(sum(tokens) OVER (PARTITION BY subject ORDER BY minute RANGE BETWEEN 59 PRECEDING AND CURRENT ROW) AS BIGINT) AS used FROM m) SELECT subject, minute, greatest(20000 - used, 0) AS remaining FROM u")
def limit_remaining(spark: SparkSession, sf: str) -> DataFrame:
    return quota.remaining(token_window_hour(spark, sf), F.lit(20_000).cast("bigint")).select("subject", "minute", "remaining")


@query("global_window", f"WITH {_MIN}, g AS (SELECT minute, CAST(sum(tokens) AS BIGINT) AS tokens FROM m GROUP BY 1) SELECT minute, tokens, CAST(sum(tokens) OVER w AS BIGINT) AS used, (min(minute) OVER w + 180) * 60 AS reset_at FROM g WINDOW w AS (ORDER BY minute RANGE BETWEEN 179 PRECEDING AND CURRENT ROW)")
def global_window(spark: SparkSession, sf: str) -> DataFrame:
    return quota.global_window(quota.per_minute(_usage(spark, sf)), 180)


@query("usage_snapshot", f"WITH {_MIN} SELECT subject, CAST(floor(minute / 60) AS BIGINT) AS hour_epoch, CAST(sum(tokens) AS BIGINT) AS tokens FROM m GROUP BY 1, 2")
def usage_snapshot(spark: SparkSession, sf: str) -> DataFrame:
    return quota.snapshots(_usage(spark, sf))


@query("daily_event_rollup", "SELECT CAST(ts AS DATE) AS day, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def daily_event_rollup(spark: SparkSession, sf: str) -> DataFrame:
    return analytics.daily_events(table(spark, sf, "events"))


@query("search_daily_rollup", "SELECT CAST(CAST(asked_at AS TIMESTAMP) AS DATE) AS day, mode, code_mode, client, count(*) AS n, count(*) FILTER (vector IS NOT NULL) AS with_vector FROM (SELECT DISTINCT ON (pair_id) * FROM query_pair) GROUP BY 1, 2, 3, 4")
def search_daily_rollup(spark: SparkSession, sf: str) -> DataFrame:
    return analytics.search_rollup(table(spark, sf, "query_pair").dropDuplicates(["pair_id"]))


@query("search_cube", "SELECT mode, client, count(*) AS n FROM (SELECT DISTINCT ON (pair_id) * FROM query_pair) GROUP BY CUBE (mode, client)")
def search_cube(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "query_pair").dropDuplicates(["pair_id"]).cube("mode", "client").agg(F.count("*").alias("n"))


@query("tumbling_hour", "SELECT date_trunc('hour', ts) AS hour, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def tumbling_hour(spark: SparkSession, sf: str) -> DataFrame:
    """The batch twin of the hourly stream."""
    return table(spark, sf, "events").groupBy(F.window("ts", "1 hour"), "event_type").agg(F.count("*").alias("n")).select(F.col("window.start").alias("hour"), "event_type", "n")


@query(
    "session_gap",
    """WITH e AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w >= INTERVAL 30 MINUTE OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS opens FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
    s AS (SELECT *, sum(opens) OVER (PARTITION BY user_id ORDER BY ts) AS s FROM e) SELECT user_id, min(ts) AS start, max(ts) AS last, count(*) AS n FROM s GROUP BY user_id, s""",
)
def session_gap(spark: SparkSession, sf: str) -> DataFrame:
    """Sessions of a user, a new one after half an hour."""
    g = table(spark, sf, "events").groupBy("user_id", F.session_window("ts", "30 minutes")).agg(F.count("*").alias("n"), F.min("ts").alias("start"), F.max("ts").alias("last"))
    return g.select("user_id", "start", "last", "n")


@query(
    "cidr_longest_prefix",
    """WITH r AS (SELECT event_id, '10.' || (user_id % 4) || '.' || (event_id % 256) || '.' || (user_id % 200) AS ip, (10 * 16777216 + (user_id % 4) * 65536 + (event_id % 256) * 256 + user_id % 200) AS n FROM events),
    o(oid, prefix, lo, hi) AS (VALUES ('a', 8, 167772160, 184549375), ('b', 16, 167837696, 167903231), ('c', 24, 167837952, 167838207), ('d', 32, 167772165, 167772165))
    SELECT event_id, o.oid AS override_id, CAST(o.prefix AS INT) AS prefix FROM r LEFT JOIN o ON n BETWEEN lo AND hi QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY prefix DESC) = 1""",
)
def cidr_longest_prefix(spark: SparkSession, sf: str) -> DataFrame:
    o = spark.createDataFrame([("a", "10.0.0.0/8"), ("b", "10.1.0.0/16"), ("c", "10.1.1.0/24"), ("d", "10.0.0.5"), ("e", "nonsense/8")], "id string, cidr string").withColumn("created_at", F.lit("2024-01-01").cast("timestamp"))
    ip = F.concat(F.lit("10."), F.col("user_id") % 4, F.lit("."), F.col("event_id") % 256, F.lit("."), F.col("user_id") % 200)
    r = table(spark, sf, "events").select("event_id", ip.alias("ip"))
    return quota.by_network(r, o).select("event_id", "override_id", "prefix")


@query("overlapping_networks", "SELECT * FROM (VALUES ('a', 'b'), ('a', 'c'), ('b', 'c'), ('a', 'd')) t(outer_id, inner_id)")
def overlapping_networks(spark: SparkSession, sf: str) -> DataFrame:
    return quota.overlapping(spark.createDataFrame([("a", "10.0.0.0/8"), ("b", "10.1.0.0/16"), ("c", "10.1.1.0/24"), ("d", "10.0.0.5"), ("e", "192.168.0.0/16")], "id string, cidr string"))


@query("budget_prefix", "SELECT o_orderkey, o_custkey FROM (SELECT o_orderkey, o_custkey, sum(CAST(o_totalprice AS BIGINT)) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS spent FROM (SELECT o_orderkey, o_custkey, o_orderdate, floor(o_totalprice) AS o_totalprice FROM orders)) WHERE coalesce(spent, 0) < 500000")
def budget_prefix(spark: SparkSession, sf: str) -> DataFrame:
    """A customer's orders that begin while the budget lasts."""
    o = table(spark, sf, "orders").withColumn("cost", F.floor("o_totalprice"))
    return batching.budget_prefix(o, ["o_custkey"], ["o_orderdate", "o_orderkey"], "cost", 500_000).select("o_orderkey", "o_custkey")


@query("retention_orders", "SELECT o_orderkey, o_custkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) > 5")
def retention_orders(spark: SparkSession, sf: str) -> DataFrame:
    """What a retention of five newest versions a key would delete, with orders as versions."""
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("source_id"), F.col("o_orderkey").alias("revision"), F.lit("inactive").alias("status"), F.col("o_orderdate").cast("timestamp").alias("ingested_at"))
    s = table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.lit(None).cast("int").alias("retention_count"))
    return lifecycle.swept_versions(o, s, "2030-01-01 00:00:00", 30).select(F.col("id").alias("o_orderkey"), F.col("source_id").alias("o_custkey"))


@query(
    "region_ancestors",
    """WITH RECURSIVE e AS (SELECT 'c' || c_custkey AS id, 'n' || c_nationkey AS p FROM customer UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey FROM nation UNION ALL SELECT 'r' || r_regionkey, NULL FROM region),
    up(id, ancestor_id, depth) AS (SELECT id, p, 1 FROM e WHERE p IS NOT NULL UNION ALL SELECT u.id, e.p, u.depth + 1 FROM up u JOIN e ON e.id = u.ancestor_id WHERE e.p IS NOT NULL) SELECT id, ancestor_id, CAST(depth AS INT) AS depth FROM up""",
)
def region_ancestors(spark: SparkSession, sf: str) -> DataFrame:
    c, n, r = (table(spark, sf, t) for t in ("customer", "nation", "region"))
    e = c.select(F.concat(F.lit("c"), "c_custkey").alias("id"), F.concat(F.lit("n"), "c_nationkey").alias("parent_node_id")).union(n.select(F.concat(F.lit("n"), "n_nationkey"), F.concat(F.lit("r"), "n_regionkey"))).union(r.select(F.concat(F.lit("r"), "r_regionkey"), F.lit(None).cast("string")))
    return navigate.ancestors(spark, e, e)


@query("value_page", "SELECT p_name, (SELECT count(DISTINCT p_name) FROM part WHERE p_name > 'm') > 50 AS more FROM (SELECT DISTINCT p_name FROM part WHERE p_name > 'm' ORDER BY 1 LIMIT 50)")
def value_page(spark: SparkSession, sf: str) -> DataFrame:
    """A page of fifty after a cursor: keyset pagination is the feature."""
    return navigate.keyset_page(table(spark, sf, "part").select("p_name").distinct(), "p_name", "m", 50)


@query("top_brands", "WITH n AS (SELECT p_type, p_brand, count(*) AS n FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1, 2) SELECT p_type, p_brand, n, CAST(row_number() OVER (PARTITION BY p_type ORDER BY n DESC, p_brand) AS INT) AS place FROM n QUALIFY place <= 5")
def top_brands(spark: SparkSession, sf: str) -> DataFrame:
    n = table(spark, sf, "lineitem").join(table(spark, sf, "part"), F.col("l_partkey") == F.col("p_partkey")).groupBy("p_type", "p_brand").agg(F.count("*").alias("n"))
    w = Window.partitionBy("p_type").orderBy(F.desc("n"), "p_brand")
    return n.withColumn("place", F.row_number().over(w)).where("place <= 5")


@query("pricing_summary", "SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, count(*) AS n FROM lineitem GROUP BY 1, 2")
def pricing_summary(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), F.count("*").alias("n"))
