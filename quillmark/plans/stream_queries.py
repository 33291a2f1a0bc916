"""Stateful queries: events replayed as micro-batches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmark.plans.base import query
from quillmark.sources.tables import table
from quillmark.streaming import jobs
from quillmark.streaming import processors as P


def _events(spark: SparkSession, d: str) -> DataFrame:
    """Events with the second of the poll that brings them."""
    now = F.unix_timestamp(F.col("ts").cast("timestamp"))
    return table(spark, d, "events").select("event_id", "user_id", "event_type", "ts", now.alias("now"))


@query("""
WITH e AS (SELECT event_id, user_id, strftime(ts, '%Y-%m-%d') AS date, epoch(date_trunc('day', ts))::BIGINT + 86400 AS now FROM events),
p AS (SELECT *, max(date) OVER (PARTITION BY user_id ORDER BY now RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS mark FROM e)
SELECT user_id AS cik, 'a' || event_id AS accession, date, now FROM p WHERE mark IS NULL OR date >= mark
""")
def seen_watermark_stateful(spark: SparkSession, d: str) -> DataFrame:
    """New filings of each company, by a mark and the ids seen; a poll a day."""
    day = F.unix_timestamp(F.date_trunc("day", F.col("ts").cast("timestamp"))) + 86_400
    polls = table(spark, d, "events").select(
        F.col("user_id").alias("cik"), F.concat(F.lit("a"), F.col("event_id").cast("string")).alias("accession"), F.date_format("ts", "yyyy-MM-dd").alias("date"),
        F.col("event_id").alias("pos"), F.lit(False).alias("seed"), day.alias("now"),
    )
    return jobs.replay(polls, P.new_filings, "now")


@query("""
WITH RECURSIVE e AS (
  SELECT user_id || '/' || event_type AS event_key, event_id::VARCHAR AS uid, epoch(date_trunc('second', ts))::BIGINT AS now,
    row_number() OVER (PARTITION BY user_id, event_type ORDER BY epoch(date_trunc('second', ts))::BIGINT, event_id::VARCHAR) AS n FROM events),
r AS (
  SELECT event_key, uid, now, n, now AS last, true AS passed FROM e WHERE n = 1
  UNION ALL
  SELECT e.event_key, e.uid, e.now, e.n, CASE WHEN e.now - r.last > 345600 THEN e.now ELSE r.last END, e.now - r.last > 345600 FROM r JOIN e ON e.event_key = r.event_key AND e.n = r.n + 1)
SELECT event_key, uid, now FROM r WHERE passed
""")
def suppress_ttl(spark: SparkSession, d: str) -> DataFrame:
    """Events that may be pushed: none of their key in the four days before."""
    e = _events(spark, d).select(F.concat_ws("/", F.col("user_id").cast("string"), "event_type").alias("event_key"), F.col("event_id").cast("string").alias("uid"), "now")
    return jobs.replay(e, P.unsuppressed, "now")


@query("""
WITH RECURSIVE e AS (
  SELECT event_type AS queue, epoch(date_trunc('second', ts))::BIGINT AS now, list(event_id::VARCHAR ORDER BY event_id::VARCHAR) AS ids,
    row_number() OVER (PARTITION BY event_type ORDER BY epoch(date_trunc('second', ts))::BIGINT) AS n FROM events GROUP BY 1, 2),
r AS (
  SELECT queue, n, now, ids AS given, CAST([] AS VARCHAR[]) AS held, now AS last FROM e WHERE n = 1
  UNION ALL
  SELECT e.queue, e.n, e.now, CASE WHEN due THEN all_ids ELSE CAST([] AS VARCHAR[]) END, CASE WHEN due THEN CAST([] AS VARCHAR[]) ELSE all_ids END, CASE WHEN due THEN e.now ELSE last END
  FROM (SELECT r.last, e.*, list_concat(r.held, e.ids) AS all_ids, len(r.held) + len(e.ids) >= 12 OR e.now - r.last >= 900 AS due
    FROM r JOIN e ON e.queue = r.queue AND e.n = r.n + 1) e)
SELECT queue, unnest(given)::VARCHAR AS uid, now AS fired FROM r
""")
def count_or_time_trigger(spark: SparkSession, d: str) -> DataFrame:
    """Items handed on when twelve wait or fifteen minutes are over."""
    e = _events(spark, d).select(F.col("event_type").alias("queue"), F.col("event_id").cast("string").alias("uid"), "now")
    return jobs.replay(e, P.due_items, "now")
