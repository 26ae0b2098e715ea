"""Queries that run a stream to its end and read the result (ST1, ST2, ST6, ST8) and session windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chorale.plans.shared import Query
from chorale.plans.texts import _struct_sql
from chorale.sources.tables import table
from chorale.streaming.windows import drained, file_stream, first_seen, hourly, structure_counts


def st08_hourly(spark: SparkSession, d: str) -> DataFrame:
    """Tumbling windows of an hour over the event stream."""
    return drained(hourly(file_stream(spark, d, "events")), "complete")


def st02_first_seen(spark: SparkSession, d: str) -> DataFrame:
    """Users and event types met in the stream, each once."""
    return drained(first_seen(file_stream(spark, d, "events"), ["user_id", "event_type"]), "append")


def st06_structures(spark: SparkSession, d: str) -> DataFrame:
    """Title structures per channel, counted in state."""
    return drained(structure_counts(file_stream(spark, d, "videos")), "complete")


def ext_sessions(spark: SparkSession, d: str) -> DataFrame:
    """Sessions of a user: events no more than 12 hours apart."""
    e = table(spark, d, "events").groupBy("user_id", F.session_window("ts", "12 hours").alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return e.select("user_id", F.col("w.start").alias("begin_at"), "n")


QUERIES: dict[str, Query] = {"st08_hourly": st08_hourly, "st02_first_seen": st02_first_seen, "st06_structures": st06_structures, "ext_sessions": ext_sessions}
ORACLE: dict[str, str] = {
    "st08_hourly": "SELECT date_trunc('hour', ts) AS hour, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2",
    "st02_first_seen": "SELECT DISTINCT user_id, event_type FROM events",
    "st06_structures": f"SELECT channel_id, structure, count(*) AS n FROM (SELECT channel_id, {_struct_sql} AS structure FROM videos WHERE channel_id IS NOT NULL) WHERE structure IS NOT NULL GROUP BY 1, 2",
    "ext_sessions": "SELECT user_id, min(ts) AS begin_at, count(*) AS n FROM (SELECT user_id, ts, sum(is_new) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS s FROM (SELECT user_id, ts, event_id, CASE WHEN lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) + INTERVAL 12 HOUR > ts THEN 0 ELSE 1 END AS is_new FROM events)) GROUP BY user_id, s",
}
