"""Queries on events in order: windows of time, sessions, late arrivals; and unions of phases."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import ordered
from ..streaming import intake
from .registry import Catalogue, table

catalogue = Catalogue()


@catalogue.query("SELECT event_type, date_trunc('hour', ts) AS hour, count(*) AS events, round(sum(value), 4) AS value FROM events GROUP BY ALL")
def event_tumbling_counts(spark, sf):
    return intake.tumbling(table(spark, sf, "events", "ts", "event_type", "value"), "1 hour").select("event_type", F.col("start").alias("hour"), "events", F.round("value", 4).alias("value"))


@catalogue.query("""
    SELECT event_type, w AS start, count(*) AS events FROM (SELECT event_type, unnest([date_trunc('hour', ts), date_trunc('hour', ts) - INTERVAL 1 HOUR]) AS w FROM events) GROUP BY ALL""")
def event_sliding_counts(spark, sf):
    return intake.sliding(table(spark, sf, "events", "ts", "event_type", "value"), "2 hours", "1 hour").select("event_type", "start", "events")


@catalogue.query("""
    WITH g AS (SELECT user_id, ts, event_id, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) <= INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events),
    s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS session FROM g)
    SELECT user_id, min(ts) AS first_ts, max(ts) AS last_ts, count(*) AS events FROM s GROUP BY user_id, session""")
def event_session_windows(spark, sf):
    e = table(spark, sf, "events", "event_id", "user_id", "ts")
    s = ordered.sessions(e, "user_id", "'30' MINUTE", "event_id")
    return s.groupBy("user_id", "session").agg(F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.count("*").alias("events")).drop("session")


@catalogue.query("""
    SELECT 'documents' AS tbl, date_diff('day', added_at, loaded_at)::INT AS days, count(*) AS rows FROM documents GROUP BY ALL
    UNION ALL SELECT 'your_markdown', date_diff('day', extracted_at, loaded_at)::INT, count(*) FROM your_markdown GROUP BY ALL
    UNION ALL SELECT 'max_pipeline', date_diff('day', updated_at, loaded_at)::INT, count(*) FROM max_pipeline GROUP BY ALL""")
def late_arrivals(spark, sf):
    """How many days rows came after they were made."""
    parts = [("documents", "added_at"), ("your_markdown", "extracted_at"), ("max_pipeline", "updated_at")]
    rows = None
    for name, made in parts:
        t = table(spark, sf, name, made, "loaded_at").select(F.lit(name).alias("tbl"), F.date_diff(F.to_date("loaded_at"), F.to_date(made)).alias("days"))
        rows = t if rows is None else rows.unionByName(t)
    return rows.groupBy("tbl", "days").agg(F.count("*").alias("rows"))


@catalogue.query("""
    SELECT min(chunk_id) AS chunk_id, book_id, chunk_idx, count(*) AS deliveries FROM your_markdown WHERE target IS NOT NULL GROUP BY book_id, chunk_idx, sha256(target)""")
def repeated_deliveries(spark, sf):
    """Chunks by content within their place in a book, and how often each was delivered."""
    t = table(spark, sf, "your_markdown", "chunk_id", "book_id", "chunk_idx", "target").where("target is not null")
    return t.groupBy("book_id", "chunk_idx", F.sha2("target", 256).alias("h")).agg(F.min("chunk_id").alias("chunk_id"), F.count("*").alias("deliveries")).select("chunk_id", "book_id", "chunk_idx", "deliveries")


@catalogue.query("""
    SELECT p.phase, p.findings, coalesce(s.skipped, 0)::BIGINT AS skipped FROM (SELECT phase, count(*) AS findings FROM max_pipeline GROUP BY phase) p
    LEFT JOIN (SELECT phase, count(*) AS skipped FROM skipped JOIN max_pipeline USING (finding_id) GROUP BY phase) s USING (phase)""")
def phase_union_counts(spark, sf):
    """Findings and skipped findings of each phase, unioned and counted once."""
    f = table(spark, sf, "max_pipeline", "finding_id", "phase")
    s = table(spark, sf, "skipped", "finding_id").join(f, "finding_id").select("phase", F.lit(0).alias("found"), F.lit(1).alias("left"))
    both = f.select("phase", F.lit(1).alias("found"), F.lit(0).alias("left")).unionByName(s)
    return both.groupBy("phase").agg(F.sum("found").alias("findings"), F.sum("left").alias("skipped"))


@catalogue.query("""
    SELECT user_id, event_id, (n * 60000000 + max(epoch_us(ts) - n * 60000000) OVER (PARTITION BY user_id ORDER BY n))::BIGINT AS at_us
    FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events)""")
def paced_calls(spark, sf):
    """When each caller's calls may go if they have to be a minute apart."""
    e = table(spark, sf, "events", "event_id", "user_id", "ts")
    return ordered.paced(e, "user_id", 60_000_000, "event_id").select("user_id", "event_id", "at_us")
