"""Queries of the general problems: orphan references (2) and packed values (3)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chorale.functions.text import trimmed, video_key
from chorale.operators.packed import infer_delimiters, split_packed
from chorale.operators.references import orphan_references
from chorale.sources.tables import table


def _references(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    videos = table(spark, d, "videos")

    def refs(name: str, kind: str, key: str, at: str) -> DataFrame:
        return table(spark, d, name).select(F.lit(name).alias("table_name"), F.lit(kind).alias("ref_kind"), trimmed(key).alias("ref_key"), F.col(at).alias("ref_time"), "record_id")

    all_refs = refs("videos", "channel", "channel_id", "scraped_at").unionByName(refs("discogs_data", "video", "video_id", "fetched_at")).unionByName(refs("video_features", "video", "video_id", "extracted_at"))
    known_videos = videos.select(F.lit("video").alias("ref_kind"), video_key("video_id", "url").alias("ref_key"), F.col("scraped_at").alias("known_from"), F.col("deleted_at").alias("gone_from"))
    known_channels = table(spark, d, "channels").select(F.lit("channel").alias("ref_kind"), trimmed("channel_id").alias("ref_key"), F.col("created_at").alias("known_from"), F.col("deleted_at").alias("gone_from"))
    return all_refs, known_videos.unionByName(known_channels)


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """table_name, ref_month, record_id of every reference that is not known at its record's time."""
    found = orphan_references(*_references(spark, d))
    return found.select("table_name", F.date_format("ref_time", "yyyy-MM").alias("ref_month"), "record_id")


def p2_orphan_counts(spark: SparkSession, d: str) -> DataFrame:
    """Orphans per table, month and kind of failure."""
    found = orphan_references(*_references(spark, d))
    return found.groupBy("table_name", F.date_format("ref_time", "yyyy-MM").alias("ref_month"), "status").agg(F.count(F.lit(1)).alias("orphans"), F.count_distinct("ref_key").alias("orphan_keys"))


PACKED = (("videos", "featured_artists"), ("discogs_data", "genres"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """table_name, record_id, pos, item_value of every field that holds two or more values."""
    parts = [split_packed(table(spark, d, name).select(F.lit(name).alias("table_name"), "record_id", field), field, at_least=2).drop(field) for name, field in PACKED]
    return parts[0].unionByName(parts[1])


def p3_delimiters(spark: SparkSession, d: str) -> DataFrame:
    """The score of every candidate delimiter in each source, and whether it is used."""
    rows = []
    for name, field in PACKED:
        used, scores = infer_delimiters(table(spark, d, name), field)
        rows += [(name, field, s.delimiter, s.rows, round(s.consistency, 6), round(s.regularity, 6), round(s.apart, 6), s.delimiter in used) for s in scores]
    return spark.createDataFrame(rows, "table_name string, field_name string, delimiter string, n_rows long, consistency double, regularity double, apart double, used boolean")


_KNOWN_SQL = r"""
vid AS (SELECT coalesce(nullif(regexp_replace(video_id, '^\s+|\s+$', '', 'g'), ''), nullif(regexp_extract(url, '[?&]v=([A-Za-z0-9_-]{11})', 1), ''), nullif(regexp_extract(url, '/([A-Za-z0-9_-]{11})(?:$|[?&#/])', 1), '')) AS k, scraped_at, deleted_at FROM videos),
known AS (SELECT 'video' AS kind, k, min(scraped_at) AS since, min(deleted_at) AS gone FROM vid WHERE k IS NOT NULL GROUP BY k
 UNION ALL SELECT 'channel', regexp_replace(channel_id, '^\s+|\s+$', '', 'g'), min(created_at), min(deleted_at) FROM channels WHERE channel_id IS NOT NULL GROUP BY 2),
refs AS (SELECT 'videos' AS table_name, 'channel' AS kind, regexp_replace(channel_id, '^\s+|\s+$', '', 'g') AS k, scraped_at AS t, record_id FROM videos
 UNION ALL SELECT 'discogs_data', 'video', regexp_replace(video_id, '^\s+|\s+$', '', 'g'), fetched_at, record_id FROM discogs_data
 UNION ALL SELECT 'video_features', 'video', regexp_replace(video_id, '^\s+|\s+$', '', 'g'), extracted_at, record_id FROM video_features),
found AS (SELECT r.table_name, strftime(r.t, '%Y-%m') AS ref_month, r.record_id, r.k, CASE WHEN since IS NULL THEN 'missing' WHEN r.t < since THEN 'early' ELSE 'deleted' END AS status
 FROM refs r LEFT JOIN known n ON r.kind = n.kind AND r.k = n.k WHERE r.k IS NOT NULL AND r.k <> '' AND (since IS NULL OR r.t < since OR r.t >= gone))
"""

QUERIES = {"p2_found": p2_found, "p2_orphan_counts": p2_orphan_counts, "p3_found": p3_found, "p3_delimiters": p3_delimiters}
ORACLE = {
    "p2_found": f"WITH {_KNOWN_SQL} SELECT table_name, ref_month, record_id FROM found",
    "p2_orphan_counts": f"WITH {_KNOWN_SQL} SELECT table_name, ref_month, status, count(*) AS orphans, count(DISTINCT k) AS orphan_keys FROM found GROUP BY 1, 2, 3",
}
