"""Usage windows, limits by subject, and overrides by network or user (batch forms)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HOUR_MINUTES, DAY_HOURS, RESERVATION_SECONDS = 60, 24, 60  # fixed values


# --- networks --------------------------------------------------------------------------------------


def ipv4(ip: Column) -> Column:
    """An IPv4 address as a number, or null."""
    parts = F.split(ip, r"\.")
    n = F.lit(0).cast("bigint")
    for i in range(4):
        n = n * 256 + F.try_element_at(parts, F.lit(i + 1)).try_cast("bigint")
    return F.when(ip.rlike(r"^((25[0-5]|2[0-4]\d|1?\d?\d)(\.(?!$)|$)){4}$"), n)


def ipv6_hex(ip: Column) -> Column:
    """An IPv6 address as 32 hex digits, or null."""
    sides = F.split(F.lower(ip), "::")
    def groups(s: Column) -> Column:
        return F.transform(F.filter(F.split(s, ":"), lambda g: g != ""), lambda g: F.lpad(g, 4, "0"))

    left, right = groups(sides[0]), groups(F.coalesce(F.try_element_at(sides, F.lit(2)), F.lit("")))
    fill = F.array_repeat(F.lit("0000"), F.greatest(8 - F.size(left) - F.size(right), F.lit(0)))
    full = F.array_join(F.concat(left, fill, right), "")
    return F.when(ip.contains(":") & ip.rlike(r"^[0-9a-fA-F:]+$") & (F.length(full) == 32), full)


def cidr_bounds(cidr: Column) -> Column:
    """struct<low, high, prefix> of an IPv4 network; a bare address is a /32; null if malformed."""
    base = ipv4(F.split_part(cidr, F.lit("/"), F.lit(1)))
    prefix = F.when(cidr.contains("/"), F.split_part(cidr, F.lit("/"), F.lit(2)).try_cast("int")).otherwise(F.lit(32))
    size = F.shiftleft(F.lit(1).cast("bigint"), 0)
    size = F.pow(F.lit(2.0), 32 - prefix).cast("bigint")
    low = base - base % size
    return F.when(base.isNotNull() & prefix.between(0, 32), F.struct(low.alias("low"), (low + size - 1).alias("high"), prefix.alias("prefix")))


def cidr6_bounds(cidr: Column) -> Column:
    """struct<low, high, prefix> of an IPv6 network as hex digits (prefix in whole digits)."""
    base = ipv6_hex(F.split_part(cidr, F.lit("/"), F.lit(1)))
    prefix = F.when(cidr.contains("/"), F.split_part(cidr, F.lit("/"), F.lit(2)).try_cast("int")).otherwise(F.lit(128))
    k = F.floor(prefix / 4).cast("int")
    nibble = F.conv(F.substr(base, k + 1, F.lit(1)), 16, 10).cast("int")
    step = F.pow(F.lit(2.0), 4 - prefix % 4).cast("int")
    low_n = F.when(prefix % 4 == 0, F.lit(None)).otherwise(nibble - nibble % step)
    head_low = F.concat(F.substr(base, F.lit(1), k), F.coalesce(F.lower(F.conv(low_n.cast("string"), 10, 16)), F.lit("")))
    head_high = F.concat(F.substr(base, F.lit(1), k), F.coalesce(F.lower(F.conv((low_n + step - 1).cast("string"), 10, 16)), F.lit("")))
    return F.when(base.isNotNull() & prefix.between(0, 128), F.struct(F.rpad(head_low, 32, "0").alias("low"), F.rpad(head_high, 32, "f").alias("high"), prefix.alias("prefix")))


def ip_in(ip: Column, cidr: Column) -> Column:
    """Whether an address of either kind lies in a network of its kind."""
    n, b = ipv4(ip), cidr_bounds(cidr)
    h, b6 = ipv6_hex(ip), cidr6_bounds(cidr)
    return F.coalesce(n.between(b["low"], b["high"]), h.between(b6["low"], b6["high"]), F.lit(False))


def live(overrides: DataFrame, as_of: str) -> DataFrame:
    """Overrides that haven't expired, newest first."""
    return overrides.where(F.col("expires_at").isNull() | (F.col("expires_at") > F.to_timestamp(F.lit(as_of)))).orderBy(F.desc("created_at"), "id")


def _network_of(n: Column, prefix: Column) -> Column:
    """Low bound of the network of this prefix that holds the address."""
    size = F.element_at(F.array(*[F.lit(1 << (32 - p)) for p in range(33)]), prefix + 1)
    return n - n % size


def by_network(requests: DataFrame, overrides: DataFrame, ip_col: str = "ip") -> DataFrame:
    """Requests with the override of the longest matching prefix, the newest on ties. Networks are
    looked up by (prefix, low bound): an address has one key for each prefix in use (33 at most),
    so the join is by equality at any number of rows."""
    b = cidr_bounds(F.col("cidr"))
    o = overrides.withColumn("b", b).where("b IS NOT NULL").select(F.col("b.prefix").alias("prefix"), F.col("b.low").alias("low"), F.struct("created_at", F.col("id").alias("override_id")).alias("o"))
    o = o.groupBy("prefix", "low").agg(F.max("o").alias("o"))
    used = sorted(r.prefix for r in o.select("prefix").distinct().collect())  # 33 values at most
    n = ipv4(F.col(ip_col))
    keys = F.array(*[F.struct(F.lit(p).alias("prefix"), (F.col("n") - F.col("n") % F.lit(1 << (32 - p))).alias("low")) for p in used]) if used else F.array().cast("array<struct<prefix:int,low:bigint>>")
    ips = requests.select(ip_col).distinct().withColumn("n", n).where("n IS NOT NULL").select(ip_col, F.explode(keys).alias("k")).select(ip_col, "k.prefix", "k.low")
    best = ips.join(o, ["prefix", "low"]).groupBy(ip_col).agg(F.max_by("o", "prefix").alias("o"), F.max("prefix").alias("prefix"))
    return requests.join(best.select(ip_col, F.col("o.override_id").alias("override_id"), "prefix"), ip_col, "left")


def by_user(requests: DataFrame, overrides: DataFrame, user_col: str = "user_id") -> DataFrame:
    o = overrides.where("subject_kind = 'user'").groupBy(F.col("subject").alias("_u")).agg(F.max_by("id", F.struct("created_at", "id")).alias("override_id"))
    return requests.join(o, F.col(user_col).cast("string") == F.col("_u"), "left").drop("_u")


def overlapping(overrides: DataFrame) -> DataFrame:
    """Pairs of networks that share addresses: one contains the other, so the shorter prefix of a
    network is one of its ancestors; the join is by equality."""
    o = overrides.withColumn("b", cidr_bounds(F.col("cidr"))).where("b IS NOT NULL").select("id", "cidr", F.col("b.prefix").alias("prefix"), F.col("b.low").alias("low"))
    up = F.transform(F.sequence(F.lit(0), F.col("prefix")), lambda p: F.struct(p.alias("prefix"), _network_of(F.col("low"), p).alias("low")))
    inner = o.select(F.col("id").alias("inner_id"), F.explode(up).alias("k")).select("inner_id", "k.prefix", "k.low")
    return inner.join(o.select(F.col("id").alias("outer_id"), "prefix", "low"), ["prefix", "low"]).where((F.col("inner_id") != F.col("outer_id"))).select("outer_id", "inner_id").distinct()


def tier(override: Column, is_admin: Column, has_uplift: Column, anonymous: int = 10, uplift: int = 60, admin: int = 1000) -> Column:
    """Requests a second: override, admin, uplift, anonymous."""
    return F.coalesce(override, F.when(is_admin, admin).when(has_uplift, uplift).otherwise(anonymous))


# --- windows ---------------------------------------------------------------------------------------


def per_minute(usage: DataFrame, subject: str = "subject", at: str = "ts", tokens: str = "tokens") -> DataFrame:
    """(subject, minute, tokens): usage is summed by minute first, so windows run over buckets."""
    return usage.where(F.col(subject).isNotNull() & F.col(at).isNotNull()).groupBy(F.col(subject).alias("subject"), F.floor(F.unix_timestamp(F.col(at).cast("timestamp")) / 60).alias("minute")).agg(F.sum(tokens).alias("tokens"))


def hour_window(minutes: DataFrame) -> DataFrame:
    """Rolling hour of minute buckets: tokens used, and the second when the oldest leaves."""
    w = Window.partitionBy("subject").orderBy("minute").rangeBetween(-(HOUR_MINUTES - 1), 0)
    return minutes.withColumn("used", F.sum("tokens").over(w)).withColumn("reset_at", (F.min("minute").over(w) + HOUR_MINUTES) * 60)


def day_window(minutes: DataFrame) -> DataFrame:
    """Rolling day of hour buckets."""
    hours = minutes.groupBy("subject", F.floor(F.col("minute") / 60).alias("hour")).agg(F.sum("tokens").alias("tokens"))
    w = Window.partitionBy("subject").orderBy("hour").rangeBetween(-(DAY_HOURS - 1), 0)
    return hours.withColumn("used", F.sum("tokens").over(w)).withColumn("reset_at", (F.min("hour").over(w) + DAY_HOURS) * 3600)


def global_window(minutes: DataFrame, span: int) -> DataFrame:
    """Site-wide usage of the last `span` minutes at every minute. Sums by minute are one row a
    minute (half a million a year), which bounds the single window partition."""
    all_ = minutes.groupBy("minute").agg(F.sum("tokens").alias("tokens"))
    w = Window.orderBy("minute").rangeBetween(-(span - 1), 0)
    return all_.withColumn("used", F.sum("tokens").over(w)).withColumn("reset_at", (F.min("minute").over(w) + span) * 60)


def exceeded(windowed: DataFrame, limit: Column) -> DataFrame:
    return windowed.where(F.col("used") > limit)


def remaining(windowed: DataFrame, limit: Column) -> DataFrame:
    return windowed.withColumn("remaining", F.greatest(limit - F.col("used"), F.lit(0)))


def snapshots(usage: DataFrame, subject: str = "subject", at: str = "ts", tokens: str = "tokens") -> DataFrame:
    """(subject, hour_epoch, tokens): the durable hourly table."""
    m = per_minute(usage, subject, at, tokens)
    return m.groupBy("subject", (F.floor(F.col("minute") / 60)).alias("hour_epoch")).agg(F.sum("tokens").alias("tokens"))


def pruned(snapshot: DataFrame, now_hour: int, keep_hours: int = 25) -> DataFrame:
    return snapshot.where(F.col("hour_epoch") > now_hour - keep_hours)
