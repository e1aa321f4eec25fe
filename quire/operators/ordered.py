"""Look-around and running totals in an order, for keys of any size.

A window over a key puts all of its rows into one task. Here a key's rows are cut into buckets of the order
(days, say); windows run within (key, bucket), and what passes from bucket to bucket is one row for each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def with_previous(rows: DataFrame, key: str, bucket: Column, order: list[str], value: str, name: str) -> DataFrame:
    """Adds ``name``: the value of the row before in the key's order; null for its first. Null keys are a key."""
    r = rows.withColumn("_bucket", bucket)
    w = Window.partitionBy(key, "_bucket").orderBy(*order)
    r = r.withColumn("_own", F.lag(value).over(w)).withColumn("_first", F.row_number().over(w) == 1)
    ends = r.groupBy(key, "_bucket").agg(F.max_by(value, F.struct(*order)).alias("_end"))
    before = ends.select(F.col(key).alias("_k"), F.col("_bucket").alias("_b"), F.lag("_end").over(Window.partitionBy(key).orderBy("_bucket")).alias("_carried"))
    j = r.join(before, r[key].eqNullSafe(before["_k"]) & r["_bucket"].eqNullSafe(before["_b"]), "left")
    return j.withColumn(name, F.when(F.col("_first"), F.col("_carried")).otherwise(F.col("_own"))).select(*rows.columns, name)


def with_running_sum(rows: DataFrame, key: str, bucket: Column, order: list[str], value: str, name: str) -> DataFrame:
    """Adds ``name``: the sum of the value over the key's rows up to this one."""
    r = rows.withColumn("_bucket", bucket)
    w = Window.partitionBy(key, "_bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    r = r.withColumn("_own", F.sum(value).over(w))
    sums = r.groupBy(key, "_bucket").agg(F.sum(value).alias("_sum"))
    before = Window.partitionBy(key).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    start = sums.select(F.col(key).alias("_k"), F.col("_bucket").alias("_b"), F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_start"))
    j = r.join(start, r[key].eqNullSafe(start["_k"]) & r["_bucket"].eqNullSafe(start["_b"]), "left")
    return j.withColumn(name, F.col("_own") + F.col("_start")).select(*rows.columns, name)


def with_running_max(rows: DataFrame, key: str, bucket: Column, order: list[str], value: str, name: str) -> DataFrame:
    """Adds ``name``: the greatest value of the key's rows up to this one."""
    r = rows.withColumn("_bucket", bucket)
    w = Window.partitionBy(key, "_bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    r = r.withColumn("_own", F.max(value).over(w))
    tops = r.groupBy(key, "_bucket").agg(F.max(value).alias("_top"))
    before = Window.partitionBy(key).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    start = tops.select(F.col(key).alias("_k"), F.col("_bucket").alias("_b"), F.max("_top").over(before).alias("_start"))
    j = r.join(start, r[key].eqNullSafe(start["_k"]) & r["_bucket"].eqNullSafe(start["_b"]), "left")
    return j.withColumn(name, F.greatest("_own", "_start")).select(*rows.columns, name)


def _micros(ts: str) -> Column:
    """Microseconds since 1970 by the clock that the column shows, with or without a zone."""
    seconds = F.hour(ts) * 3600 + F.minute(ts) * 60
    return (F.unix_date(F.to_date(ts)).cast("long") * 86400 + seconds) * 1_000_000 + (F.extract(F.lit("SECOND"), F.col(ts)) * 1_000_000).cast("long")


def paced(calls: DataFrame, key: str, gap: int, tie: str, ts: str = "ts") -> DataFrame:
    """Adds ``at_us``: when each call may go, in microseconds, so that a key's calls are ``gap`` microseconds apart, none before it came.

    The n-th call goes at n gaps after the latest start that any call up to it would set: ``n * gap + max(ts - n * gap)``.
    """
    day = F.to_date(ts)
    c = with_running_sum(calls.withColumn("_one", F.lit(1)), key, day, [ts, tie], "_one", "_n")
    c = c.withColumn("_from", _micros(ts) - F.col("_n") * gap)
    c = with_running_max(c, key, day, [ts, tie], "_from", "_latest")
    return c.withColumn("at_us", F.col("_latest") + F.col("_n") * gap).drop("_one", "_n", "_from", "_latest")


def sessions(events: DataFrame, key: str, gap: str, tie: str, ts: str = "ts") -> DataFrame:
    """Adds ``session``: the number of the key's stretch of events with no pause over ``gap`` between them."""
    day = F.to_date(ts)
    e = with_previous(events, key, day, [ts, tie], ts, "_before")
    e = e.withColumn("_new", F.when(F.col(ts) - F.col("_before") <= F.expr(f"INTERVAL {gap}"), 0).otherwise(1))
    return with_running_sum(e, key, day, [ts, tie], "_new", "session").drop("_before", "_new")
