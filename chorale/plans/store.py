"""Upserts, projections, merges and migrations of the stored tables (SNK, PRJ, MIG, ORC)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chorale.operators.store import insert_absent, merged_sources, upsert
from chorale.plans.shared import Query, register
from chorale.sources.tables import table

QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}

_latest = lambda t, key, at, cols, extra="": f"SELECT {key}, {', '.join(cols)} FROM (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY {at} DESC NULLS LAST{extra}) AS rn FROM {{{t}}} WHERE {key} IS NOT NULL) x WHERE rn = 1"

register(
    QUERIES,
    ORACLE,
    {
        "snk02_latest_features": _latest("video_features", "video_id", "extracted_at", ["record_id", "has_guide_vocals", "has_scrolling_lyrics", "has_backing_vocals", "is_instrumental", "is_piano_only", "is_acoustic", "overall_confidence", "extracted_at"], ", record_id DESC"),
        "snk02_latest_ratings": _latest("ryd_data", "video_id", "fetched_at", ["estimated_dislikes", "ryd_likes", "ryd_rating", "ryd_confidence", "fetched_at"], ", estimated_dislikes DESC NULLS LAST, ryd_likes DESC NULLS LAST, ryd_rating DESC NULLS LAST, ryd_confidence DESC NULLS LAST"),
        "snk02_latest_releases": _latest("discogs_data", "video_id", "fetched_at", ["record_id", "release_id", "master_id", "artist_name", "song_title", "year", "genres", "styles", "label", "country", "media_format", "confidence", "discogs_url", "community_have", "community_want", "barcode", "catno", "fetched_at"], ", record_id DESC"),
        "snk02_latest_quality": _latest("videos", "video_id", "scraped_at", ["record_id", "quality_score", "engagement_ratio", "parse_confidence"], ", record_id DESC"),
        "snk02_latest_checks": _latest("videos", "video_id", "scraped_at", ["record_id", "discogs_checked", "musicbrainz_checked"], ", record_id DESC"),
        "snk04_touched_channels": "SELECT channel_id, max(scraped_at) AS updated_at FROM {videos} WHERE channel_id IS NOT NULL GROUP BY channel_id",
        "prj02_rounded": "SELECT record_id, CAST(round(CAST(parse_confidence AS DECIMAL(28, 12)), 2) AS DOUBLE) AS confidence, CAST(round(CAST(engagement_ratio AS DECIMAL(28, 12)), 3) AS DOUBLE) AS engagement FROM {videos} WHERE abs(parse_confidence) < 1000000 AND abs(coalesce(engagement_ratio, 0)) < 1000000",
        "prj03_optimized": """
            SELECT record_id, coalesce(nullif(channel_name, ''), 'unknown') AS channel, coalesce(nullif(genre, ''), 'none') AS genre, coalesce(nullif(release_year, 0), try_cast(substring(upload_date, 1, 4) AS INT)) AS year,
              coalesce(engagement_ratio, CASE WHEN view_count > 0 AND like_count IS NOT NULL THEN round(100.0 * like_count / view_count, 3) END) IS NOT NULL AS has_engagement FROM {videos}""",
        "prj04_legacy_view": "SELECT record_id, artist AS original_artist, round(engagement_ratio / 100, 8) AS ratio FROM {videos}",
        "prj08_promoted": """
            SELECT v.record_id, coalesce(nullif(v.genre, ''), g.styles) AS genre, coalesce(v.release_year, g.year) AS year FROM {videos} v LEFT JOIN (
              SELECT video_id, styles, year FROM (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY confidence DESC NULLS LAST, record_id) AS rn FROM {discogs_data} WHERE video_id IS NOT NULL) x WHERE rn = 1) g ON v.video_id = g.video_id""",
        "prj09_release_year": """
            SELECT v.record_id, CASE WHEN y < 2025 THEN y END AS resolved_year FROM (SELECT v.record_id, CASE WHEN g.year > 1900 THEN g.year ELSE v.release_year END AS y FROM {videos} v LEFT JOIN (
              SELECT video_id, year FROM (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY confidence DESC NULLS LAST, record_id) AS rn FROM {discogs_data} WHERE video_id IS NOT NULL) x WHERE rn = 1) g ON v.video_id = g.video_id) v""",
        "prj10_source_flags": "SELECT v.record_id, EXISTS (SELECT 1 FROM {discogs_data} g WHERE g.video_id = v.video_id) AS has_release, EXISTS (SELECT 1 FROM {ryd_data} r WHERE r.video_id = v.video_id) AS has_ratings, EXISTS (SELECT 1 FROM {video_features} f WHERE f.video_id = v.video_id) AS has_features FROM {videos} v",
        "prj13_flat": "SELECT record_id, coalesce(try_cast(barcode AS BIGINT), 0) AS barcode, coalesce(community_have, 0) AS have, coalesce(community_want, 0) AS want FROM {discogs_data}",
        "mig01_videos_v2": "SELECT record_id, video_id, round(coalesce(CASE WHEN parse_confidence BETWEEN 0 AND 1 THEN parse_confidence END, 0e0), 2) AS confidence, CASE WHEN engagement_ratio IS NOT NULL THEN engagement_ratio / 100 END IS NOT NULL AS has_ratio FROM {videos}",
        "mig02_channels_v2": "SELECT channel_id, channel_name, coalesce(updated_at, created_at) AS updated_at FROM {channels}",
        "mig03_features_v2": "SELECT record_id, CASE WHEN has_guide_vocals OR overall_confidence > 0.5 THEN 1 ELSE 0 END AS guide_vocals, CASE WHEN is_instrumental OR is_piano_only THEN 1 ELSE 0 END AS without_voice FROM {video_features}",
        "mig04_split_out": "SELECT video_id, master_id, artist_name, confidence FROM {discogs_data} WHERE master_id IS NOT NULL",
        "mig05_validation": "SELECT record_id, artist <> '' AND song_title <> '' AS is_valid, CASE WHEN artist <> '' THEN 5e-1 ELSE 0e0 END + CASE WHEN song_title <> '' THEN 5e-1 ELSE 0e0 END AS validation_score FROM {videos}",
        "mig06_rounded_ratings": "SELECT video_id, CAST(round(CAST(ryd_rating AS DECIMAL(28, 12)), 1) AS DOUBLE) AS rating, CAST(round(CAST(ryd_confidence AS DECIMAL(28, 12)), 2) AS DOUBLE) AS confidence FROM {ryd_data} WHERE abs(ryd_rating) < 1000000",
        "mig09_range_check": "SELECT count(*) AS violations FROM {ryd_data} WHERE ryd_likes < 0 OR estimated_dislikes < 0 OR ryd_rating < 0",
        "mig12_cascade": "SELECT f.record_id FROM {video_features} f WHERE f.video_id IN (SELECT video_id FROM {videos} WHERE video_id IS NOT NULL AND deleted_at IS NOT NULL)",
        "st01_incremental": """
            SELECT v.record_id, v.channel_id FROM {videos} v JOIN (SELECT channel_id, max(updated_at) AS mark FROM {channels} WHERE channel_id IS NOT NULL GROUP BY channel_id) c ON v.channel_id = c.channel_id WHERE v.scraped_at > c.mark""",
        "st05_breaker_openings": """
            SELECT user_id, event_id FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id, grp ORDER BY ts, event_id) AS failures FROM (
              SELECT user_id, event_id, ts, event_type, sum(CASE WHEN event_type = 'error' THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS grp FROM {events}) r WHERE event_type = 'error') f WHERE failures = 2""",
        "st03_backoff": """
            SELECT event_id, CAST(least(300, power(2, failures - 1)) AS BIGINT) AS wait_seconds FROM (SELECT event_id, row_number() OVER (PARTITION BY user_id, grp ORDER BY ts, event_id) AS failures FROM (
              SELECT user_id, event_id, ts, event_type, sum(CASE WHEN event_type = 'error' THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS grp FROM {events}) r WHERE event_type = 'error') f""",
        "agg27_recent_rate": """
            SELECT channel_id, round(avg(CASE WHEN ok THEN 1e0 ELSE 0e0 END), 6) AS recent_rate FROM (SELECT channel_id, artist <> '' AND song_title <> '' AS ok, row_number() OVER (PARTITION BY channel_id ORDER BY scraped_at DESC, record_id DESC) AS rn FROM {videos} WHERE channel_id IS NOT NULL) x WHERE rn <= 10 GROUP BY channel_id""",
        "top11_most_recent": "SELECT channel_id, record_id FROM (SELECT channel_id, record_id, row_number() OVER (PARTITION BY channel_id ORDER BY scraped_at DESC, record_id DESC) AS rn FROM {videos} WHERE channel_id IS NOT NULL) x WHERE rn <= 5",
        "top06_best_candidate": "SELECT video_id, record_id, confidence FROM (SELECT video_id, record_id, confidence, row_number() OVER (PARTITION BY video_id ORDER BY confidence DESC, record_id) AS rn FROM {discogs_data} WHERE video_id IS NOT NULL AND confidence > 0 AND confidence <= 1) x WHERE rn = 1",
        "top05_early_exit": """
            SELECT video_id, min(CASE WHEN confidence > 0.9 THEN rn END) AS stop_at, count(*) AS candidates FROM (SELECT video_id, confidence, row_number() OVER (PARTITION BY video_id ORDER BY fetched_at, record_id) AS rn FROM {discogs_data} WHERE video_id IS NOT NULL AND confidence BETWEEN 0 AND 1) x GROUP BY video_id""",
        "top08_best_strategy": "SELECT source, lang, n FROM (SELECT source, lang, n, row_number() OVER (PARTITION BY source ORDER BY n DESC, lang) AS rn FROM (SELECT source, coalesce(lang, 'und') AS lang, count(*) AS n FROM {documents} GROUP BY 1, 2) c) x WHERE rn = 1",
        "num06_running_mean": "SELECT event_id, round(CAST(sum(CAST(value AS DECIMAL(18, 4))) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS DOUBLE), 4) AS total_so_far, count(*) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS n_so_far FROM {events}",
        "jn12_best_recording": """
            SELECT record_id, release_record, points FROM (SELECT v.record_id, g.record_id AS release_record, 50 + CASE WHEN lower(v.artist) = lower(g.artist_name) THEN 50 WHEN strpos(lower(v.artist), lower(g.artist_name)) > 0 OR strpos(lower(g.artist_name), lower(v.artist)) > 0 THEN 30 ELSE 0 END AS points,
              row_number() OVER (PARTITION BY v.record_id ORDER BY CASE WHEN lower(v.artist) = lower(g.artist_name) THEN 50 WHEN strpos(lower(v.artist), lower(g.artist_name)) > 0 OR strpos(lower(g.artist_name), lower(v.artist)) > 0 THEN 30 ELSE 0 END DESC, g.record_id) AS rn
              FROM {videos} v JOIN {discogs_data} g ON lower(v.song_title) = lower(g.song_title) WHERE v.song_title <> '' AND v.artist <> '' AND g.artist_name <> '') x WHERE rn = 1""".replace("strpos(", "instr("),
    },
)

_CUT = "2025-01-01"


def snk01_upserted(spark: SparkSession, d: str) -> DataFrame:
    """The store after a batch, with all its columns: the records of a later period replace those of the same video."""
    v = table(spark, d, "videos").where("video_id is not null")
    return upsert(v.where(F.col("scraped_at") < _CUT), v.where(F.col("scraped_at") >= _CUT), ["video_id"], [F.desc_nulls_last("scraped_at"), F.desc("record_id")])


def snk03_channels_added(spark: SparkSession, d: str) -> DataFrame:
    """Known channels and those that only videos name, each once."""
    known = table(spark, d, "channels").where("channel_id is not null").select("channel_id").distinct()
    return insert_absent(known, table(spark, d, "videos").select("channel_id"), ["channel_id"])


def prj06_merged(spark: SparkSession, d: str) -> DataFrame:
    """Evidence of a video's own record and its best release, merged by confidence."""
    v = table(spark, d, "videos").where("video_id is not null and parse_confidence between 0 and 1")
    g = table(spark, d, "discogs_data").where("video_id is not null and confidence between 0 and 1")
    return merged_sources(v, g)


QUERIES |= {"snk01_upserted": snk01_upserted, "snk03_channels_added": snk03_channels_added, "prj06_merged": prj06_merged}
ORACLE |= {
    "snk01_upserted": f"""WITH v AS (SELECT *, scraped_at >= TIMESTAMP '{_CUT}' AS is_new FROM videos WHERE video_id IS NOT NULL)
SELECT * EXCLUDE (rn, is_new) FROM (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY is_new DESC, scraped_at DESC NULLS LAST, record_id DESC) AS rn FROM v WHERE is_new IS NOT NULL) WHERE rn = 1""",
    "snk03_channels_added": "SELECT channel_id FROM channels WHERE channel_id IS NOT NULL UNION SELECT channel_id FROM videos WHERE channel_id IS NOT NULL",
    "prj06_merged": """WITH a AS (SELECT * FROM (SELECT video_id, artist, song_title, release_year, genre, parse_confidence AS c, row_number() OVER (PARTITION BY video_id ORDER BY parse_confidence DESC, record_id) AS rn FROM videos WHERE video_id IS NOT NULL AND parse_confidence BETWEEN 0 AND 1) WHERE rn = 1),
b AS (SELECT * FROM (SELECT video_id, artist_name, song_title, year, styles, confidence AS c, row_number() OVER (PARTITION BY video_id ORDER BY confidence DESC, record_id) AS rn FROM discogs_data WHERE video_id IS NOT NULL AND confidence BETWEEN 0 AND 1) WHERE rn = 1)
SELECT coalesce(a.video_id, b.video_id) AS video_id, CASE WHEN a.c IS NULL OR b.c > a.c THEN coalesce(nullif(b.artist_name, ''), nullif(a.artist, '')) ELSE coalesce(nullif(a.artist, ''), nullif(b.artist_name, '')) END AS artist,
 CASE WHEN a.c IS NULL OR b.c > a.c THEN coalesce(nullif(b.song_title, ''), nullif(a.song_title, '')) ELSE coalesce(nullif(a.song_title, ''), nullif(b.song_title, '')) END AS song_title,
 coalesce(nullif(b.year, 0), nullif(a.release_year, 0)) AS release_year, coalesce(nullif(b.styles, ''), nullif(a.genre, '')) AS genre,
 round(CASE WHEN a.c IS NOT NULL AND b.c IS NOT NULL THEN a.c * 0.6 + b.c * 0.4 ELSE coalesce(a.c, b.c) END, 4) AS confidence, (a.c IS NOT NULL)::INT + (b.c IS NOT NULL)::INT AS sources FROM a FULL JOIN b ON a.video_id = b.video_id""",
}
