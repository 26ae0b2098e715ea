"""Reports over the stored tables: statistics, distributions, completeness, anomalies (AGG, JN1-JN5, TOP14)."""

from __future__ import annotations

from chorale.plans.shared import Query, register

QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}

#: Confidence outside 0 to 1 or null counts as missing.
_CONF = "CASE WHEN parse_confidence BETWEEN 0 AND 1 THEN parse_confidence END"

#: Open-ended histogram bounds, highest first. Fixed values.
_BANDS = [0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3, 0.2, 0.1]


def _band(column: str) -> str:
    tops = ["1.0", *[str(b) for b in _BANDS[:-1]]]
    return "CASE " + " ".join(f"WHEN {column} >= {b} THEN '{b}-{t}'" for b, t in zip(_BANDS, tops)) + " ELSE '0.0-0.1' END"


def _profile(table: str, columns: list[str], text: set[str]) -> str:
    parts = [
        f"SELECT '{c}' AS column_name, count(*) AS n_rows, count(*) FILTER (WHERE {c} IS NULL) AS n_null, "
        f"{f'''count(*) FILTER (WHERE {c} = '')''' if c in text else 'CAST(0 AS BIGINT)'} AS n_blank FROM {{{table}}}"
        for c in columns
    ]
    return "SELECT column_name, n_rows, n_null, n_blank, round(1e2 * n_null / n_rows, 2) AS null_percent, n_null * 2 > n_rows AS mostly_null FROM (" + " UNION ALL ".join(parts) + ") p"


_VIDEO_COLUMNS = ["video_id", "url", "title", "description", "duration_seconds", "view_count", "like_count", "comment_count", "upload_date", "thumbnail_url", "channel_name", "channel_id", "artist", "song_title", "featured_artists", "release_year", "genre", "parse_confidence", "quality_score", "engagement_ratio", "deleted_at"]
_VIDEO_TEXT = {"video_id", "url", "title", "description", "upload_date", "thumbnail_url", "channel_name", "channel_id", "artist", "song_title", "featured_artists", "genre"}

register(
    QUERIES,
    ORACLE,
    {
        "agg01_statistics": """
            SELECT v.total_videos, v.videos_with_parse, c.total_channels, d.discogs_rows, v.avg_quality_score FROM
            (SELECT count(*) AS total_videos, count(*) FILTER (WHERE artist IS NOT NULL AND song_title IS NOT NULL) AS videos_with_parse, coalesce(round(avg(quality_score), 2), 0.0) AS avg_quality_score FROM {videos}) v
            CROSS JOIN (SELECT count(*) AS total_channels FROM {channels}) c CROSS JOIN (SELECT count(*) AS discogs_rows FROM {discogs_data}) d""",
        "agg02_channel_statistics": """
            SELECT count(*) AS total_channels, CAST(sum(CASE WHEN is_karaoke_focused THEN 1 ELSE 0 END) AS BIGINT) AS karaoke_focused, CAST(sum(video_count) AS BIGINT) AS videos
            FROM (SELECT channel_id, bool_or(is_karaoke_focused) AS is_karaoke_focused, max(video_count) AS video_count FROM {channels} WHERE channel_id IS NOT NULL GROUP BY channel_id) c""",
        "agg03_duplicate_ids": "SELECT video_id, count(*) AS copies FROM {videos} WHERE video_id IS NOT NULL GROUP BY video_id HAVING count(*) > 1",
        "agg04_column_profile": _profile("videos", _VIDEO_COLUMNS, _VIDEO_TEXT),
        "agg04_column_profile_discogs": _profile("discogs_data", ["video_id", "release_id", "master_id", "artist_name", "song_title", "year", "genres", "styles", "label", "country", "media_format", "confidence", "barcode", "catno"], {"video_id", "artist_name", "song_title", "genres", "label", "country"}),
        "agg05_top_years": "SELECT release_year, count(*) AS n FROM {videos} WHERE release_year IS NOT NULL GROUP BY release_year ORDER BY n DESC, release_year LIMIT 15",
        "agg05_year_distribution": "SELECT release_year, count(*) AS n FROM {videos} GROUP BY release_year",
        "agg06_top_channels": "SELECT channel_name, count(*) AS n FROM {videos} WHERE channel_name IS NOT NULL GROUP BY channel_name ORDER BY n DESC, channel_name LIMIT 10",
        "agg06_top_channel_ids": "SELECT channel_id, min(channel_name) AS channel_name, count(*) AS n FROM {videos} WHERE channel_id IS NOT NULL GROUP BY channel_id ORDER BY n DESC, channel_id LIMIT 10",
        "agg06_channel_counts": "SELECT channel_id, min(channel_name) AS channel_name, count(*) AS n FROM {videos} WHERE channel_id IS NOT NULL GROUP BY channel_id",
        "agg07_quality_histogram": f"SELECT {_band('quality_score')} AS band, count(*) AS n FROM {{videos}} WHERE quality_score IS NOT NULL GROUP BY 1",
        "agg08_text_lengths": """
            SELECT 'description' AS field, count(*) AS n, min(length(description)) AS min_len, max(length(description)) AS max_len, round(avg(length(description)), 4) AS avg_len,
              count(*) FILTER (WHERE length(description) >= 4990) AS possibly_truncated, count(*) FILTER (WHERE length(description) = 5000) AS truncated FROM {videos} WHERE description <> ''
            UNION ALL SELECT 'featured_artists', count(*), min(length(featured_artists)), max(length(featured_artists)), round(avg(length(featured_artists)), 4),
              count(*) FILTER (WHERE length(featured_artists) >= 490), count(*) FILTER (WHERE length(featured_artists) = 500) FROM {videos} WHERE featured_artists <> ''""",
        "agg09_year_validity": "SELECT count(*) FILTER (WHERE release_year IS NULL) AS null_years, count(*) FILTER (WHERE release_year < 1900) AS too_old, count(*) FILTER (WHERE release_year > 2024) AS future, count(*) FILTER (WHERE release_year BETWEEN 1900 AND 2024) AS valid FROM {videos}",
        "agg10_field_coverage": "SELECT count(*) AS total, count(*) FILTER (WHERE artist <> '') AS has_artist, count(*) FILTER (WHERE song_title <> '') AS has_song, count(*) FILTER (WHERE genre <> '') AS has_genre, count(*) FILTER (WHERE featured_artists <> '') AS has_featured FROM {videos}",
        "agg11_confidence_bands": f"SELECT count(c) AS n, round(avg(c), 6) AS avg_confidence, min(c) AS min_confidence, max(c) AS max_confidence, count(*) FILTER (WHERE c >= 0.8) AS high, count(*) FILTER (WHERE c >= 0.5 AND c < 0.8) AS medium, count(*) FILTER (WHERE c < 0.5) AS low FROM (SELECT {_CONF} AS c FROM {{videos}}) x",
        "agg12_distinct_channels": "SELECT count(DISTINCT channel_id) AS channels, count(DISTINCT video_id) AS videos FROM {videos}",
        "agg13_release_to_upload": "SELECT count(*) AS n, round(avg(try_cast(substring(upload_date, 1, 4) AS INT) - release_year), 6) AS avg_years FROM {videos} WHERE release_year BETWEEN 1900 AND 2024 AND upload_date IS NOT NULL",
        "agg14_recent_years": "SELECT release_year, count(*) AS n FROM {videos} WHERE release_year >= 2020 GROUP BY release_year",
        "agg15_year_examples": "SELECT record_id, title, release_year, parse_confidence FROM {videos} WHERE release_year = 2025 ORDER BY parse_confidence DESC NULLS LAST, record_id LIMIT 10",
        "agg15_year_counts": "SELECT count(*) FILTER (WHERE release_year = 2025) AS in_2025, count(*) FILTER (WHERE release_year = 2025 AND title LIKE '%2025%') AS in_title, count(*) AS total FROM {videos}",
        "agg16_discogs_coverage": "SELECT field, n FROM (" + " UNION ALL ".join(f"SELECT '{c}' AS field, count({c}) AS n FROM {{discogs_data}}" for c in ["release_id", "master_id", "artist_name", "year", "genres", "styles", "label", "country"]) + ") u",
        "agg17_check_flags": "SELECT count(*) FILTER (WHERE discogs_checked) AS discogs_checked, count(*) FILTER (WHERE musicbrainz_checked) AS musicbrainz_checked, count(*) FILTER (WHERE discogs_checked AND musicbrainz_checked) AS checked_by_both FROM {videos}",
        "agg18_compare_halves": """
            SELECT metric, before, after, after - before AS delta, CASE WHEN before > 0 THEN round(1e2 * (after - before) / before, 4) END AS percent FROM (
              SELECT 'videos' AS metric, count(*) FILTER (WHERE year(scraped_at) < 2025) AS before, count(*) FILTER (WHERE year(scraped_at) >= 2025) AS after FROM {videos}
              UNION ALL SELECT 'with_artist', count(*) FILTER (WHERE year(scraped_at) < 2025 AND artist <> ''), count(*) FILTER (WHERE year(scraped_at) >= 2025 AND artist <> '') FROM {videos}
              UNION ALL SELECT 'with_year', count(*) FILTER (WHERE year(scraped_at) < 2025 AND release_year IS NOT NULL), count(*) FILTER (WHERE year(scraped_at) >= 2025 AND release_year IS NOT NULL) FROM {videos}) m""",
        "agg19_anomalies": "SELECT count(*) FILTER (WHERE duration_seconds < 30 OR duration_seconds > 3600) AS odd_durations, count(*) FILTER (WHERE view_count > 100000000) AS odd_views, count(*) FILTER (WHERE like_count > view_count) AS more_likes_than_views FROM {videos}",
        "agg26_genre_by_decade": "SELECT genre, CAST(floor(release_year / 10) * 10 AS BIGINT) AS decade, count(*) AS n, round(avg(view_count), 4) AS avg_views FROM {videos} WHERE release_year BETWEEN 1900 AND 2024 AND genre <> '' GROUP BY 1, 2",
        "agg31_top_artists": "SELECT artist, count(*) AS n, round(avg(view_count), 4) AS avg_views FROM {videos} WHERE artist <> '' GROUP BY artist ORDER BY n DESC, artist LIMIT 10",
        "agg31_artists": f"SELECT artist, count(*) AS n, round(avg(view_count), 4) AS avg_views, round(avg({_CONF}), 6) AS avg_confidence FROM {{videos}} WHERE artist <> '' GROUP BY artist",
        "agg32_table_inventory": " UNION ALL ".join(f"SELECT '{t}' AS table_name, count(*) AS n_rows FROM {{{t}}}" for t in ["videos", "channels", "video_features", "discogs_data", "ryd_data", "documents"]),
        "agg33_verify_ranges": """
            SELECT 'parse_confidence' AS rule, count(*) AS violations FROM {videos} WHERE parse_confidence < 0 OR parse_confidence > 1
            UNION ALL SELECT 'engagement_ratio', count(*) FROM {videos} WHERE engagement_ratio < -100 OR engagement_ratio > 100
            UNION ALL SELECT 'quality_score', count(*) FROM {videos} WHERE quality_score < 0 OR quality_score > 1
            UNION ALL SELECT 'ryd_rating', count(*) FROM {ryd_data} WHERE ryd_rating < 0 OR ryd_rating > 5""",
        "agg34_success_rate": "SELECT channel_id, count(*) AS attempts, round(avg(CASE WHEN artist <> '' AND song_title <> '' THEN 1e0 ELSE 0e0 END), 6) AS success_rate FROM {videos} WHERE channel_id IS NOT NULL GROUP BY channel_id",
        "agg28_channel_drift": f"SELECT channel_id, n, round(success, 6) AS success_rate FROM (SELECT channel_id, count(*) AS n, avg(CASE WHEN {_CONF} >= 0.5 THEN 1e0 ELSE 0e0 END) AS success FROM {{videos}} WHERE channel_id IS NOT NULL GROUP BY channel_id) c WHERE n >= 10 AND success < 0.9",
        "jn01_channel_videos": """
            SELECT c.channel_id, c.channel_name, coalesce(v.n, 0) AS collected FROM (SELECT channel_id, max(channel_name) AS channel_name FROM {channels} WHERE channel_id IS NOT NULL GROUP BY channel_id) c
            LEFT JOIN (SELECT channel_id, count(video_id) AS n FROM {videos} GROUP BY channel_id) v ON c.channel_id = v.channel_id""",
        "jn02_not_stored": "SELECT DISTINCT d.video_id FROM {discogs_data} d WHERE d.video_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM {videos} v WHERE v.video_id = d.video_id)",
        "jn03_orphaned_videos": "SELECT v.record_id, v.channel_id FROM {videos} v WHERE v.channel_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM {channels} c WHERE c.channel_id = v.channel_id)",
        "jn04_kept_features": "SELECT f.record_id, f.video_id FROM {video_features} f WHERE EXISTS (SELECT 1 FROM {videos} v WHERE v.video_id = f.video_id)",
        "jn05_dislike_backfill": """
            SELECT v.record_id, CASE WHEN v.view_count > 0 THEN round(1e2 * (v.like_count - coalesce(r.estimated_dislikes, 0)) / v.view_count, 6) END AS net_ratio
            FROM {videos} v LEFT JOIN (SELECT video_id, max(estimated_dislikes) AS estimated_dislikes FROM {ryd_data} WHERE video_id IS NOT NULL GROUP BY video_id) r ON v.video_id = r.video_id""",
        "jn13_known_by_title": """
            SELECT v.record_id, m.artist, m.song_title FROM {videos} v JOIN (SELECT title, artist, song_title FROM (
              SELECT title, artist, song_title, row_number() OVER (PARTITION BY title ORDER BY parse_confidence DESC, record_id) AS rn FROM {videos} WHERE parse_confidence > 0.7 AND parse_confidence <= 1 AND artist <> '' AND song_title <> '' AND title IS NOT NULL) t WHERE rn = 1) m ON v.title = m.title""",
        "top14_confident_examples": "SELECT record_id, title, artist, song_title, parse_confidence FROM {videos} WHERE parse_confidence >= 0.8 AND parse_confidence <= 1 ORDER BY parse_confidence DESC, record_id LIMIT 10",
        "dt06_recent_ids": "SELECT DISTINCT video_id FROM {videos} WHERE video_id IS NOT NULL AND CAST(scraped_at AS DATE) >= DATE '2025-06-24' AND CAST(scraped_at AS DATE) <= DATE '2025-07-01'",
        "dt07_upload_years": "SELECT try_cast(substring(upload_date, 1, 4) AS INT) AS upload_year, count(*) AS n FROM {videos} GROUP BY 1",
        "src16_stored_ids": "SELECT DISTINCT video_id FROM {videos} WHERE video_id IS NOT NULL AND deleted_at IS NULL",
        "agg20_table_ages": "SELECT count(*) AS entries, CAST(sum(length(text)) AS BIGINT) AS total_size, round(avg(length(text)), 4) AS avg_size, max(created_at) AS newest, min(created_at) AS oldest, count(*) FILTER (WHERE created_at < TIMESTAMP '2025-01-01 00:00:00') AS expired FROM {documents}",
        "flt18_expired": "SELECT doc_id FROM {documents} WHERE created_at < TIMESTAMP '2025-01-01 00:00:00'",
        "agg25_hourly": "SELECT date_trunc('hour', ts) AS hour, event_type, count(*) AS n, round(sum(value), 4) AS total FROM {events} GROUP BY 1, 2",
        "agg24_health": """
            SELECT user_id, calls, error_rate, mean_value, CASE WHEN error_rate > 0.15 THEN 'unhealthy' WHEN mean_value > 5000 THEN 'degraded' ELSE 'healthy' END AS status FROM (
              SELECT user_id, count(*) AS calls, round(avg(CASE WHEN event_type = 'error' THEN 1e0 ELSE 0e0 END), 6) AS error_rate, round(avg(value), 4) AS mean_value FROM {events} GROUP BY user_id) e WHERE calls >= 10""",
        "agg23_pass_statistics": "SELECT event_type, count(*) AS attempts, round(avg(value), 6) AS mean_value, min(value) AS least, max(value) AS most, count(DISTINCT user_id) AS users FROM {events} GROUP BY event_type",
        "jn14_channel_dimension": "SELECT v.record_id, c.channel_name AS known_name, c.is_karaoke_focused FROM {videos} v JOIN (SELECT channel_id, max(channel_name) AS channel_name, bool_or(is_karaoke_focused) AS is_karaoke_focused FROM {channels} WHERE channel_id IS NOT NULL GROUP BY channel_id) c ON v.channel_id = c.channel_id",
        "ext_cube": "SELECT country, media_format, count(*) AS n FROM {discogs_data} GROUP BY CUBE (country, media_format)",
        "ext_rollup": "SELECT r_name, n_name, count(*) AS customers, round(sum(c_acctbal), 2) AS balance FROM {customer} JOIN {nation} ON c_nationkey = n_nationkey JOIN {region} ON n_regionkey = r_regionkey GROUP BY ROLLUP (r_name, n_name)",
        "ext_running_total": "SELECT event_id, user_id, round(sum(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 4) AS running FROM {events}",
        "ext_pricing_summary": """
            SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc_price, round(avg(l_discount), 6) AS avg_disc, count(*) AS n
            FROM {lineitem} WHERE l_shipdate <= TIMESTAMP '1998-09-02 00:00:00' GROUP BY 1, 2""",
    },
)
