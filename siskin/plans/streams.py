"""Streams over the event table, run until their input is read."""

from __future__ import annotations

from siskin import streaming
from siskin.plans.catalogue import query


@query("SELECT date_trunc('day', ts) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def stream_counts(spark, d):
    events = streaming.read(spark, f"{d.rstrip('/')}/events.parquet", spark.read.parquet(f"{d.rstrip('/')}/events.parquet").schema)
    out = streaming.completed(streaming.counts(events))
    return out.withColumn("start", out["start"].cast("timestamp_ntz"))


@query("SELECT user_id, count(*) AS n, min(ts) AS first, max(ts) AS last FROM events GROUP BY user_id")
def stream_user_totals(spark, d):
    events = streaming.read(spark, f"{d.rstrip('/')}/events.parquet", spark.read.parquet(f"{d.rstrip('/')}/events.parquet").schema)
    return streaming.completed(streaming.totals(events))


@query(
    "SELECT user_id, min(ts) AS start, count(*) AS n FROM (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS visit FROM "
    "(SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events)) GROUP BY user_id, visit"
)
def stream_sessions(spark, d):
    events = streaming.read(spark, f"{d.rstrip('/')}/events.parquet", spark.read.parquet(f"{d.rstrip('/')}/events.parquet").schema)
    out = streaming.completed(streaming.sessions(events))
    return out.withColumn("start", out["start"].cast("timestamp_ntz"))
