"""Queries of the problems on records: representatives (1) and copies (5)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chorale.functions.text import trimmed, video_key
from chorale.llm.copies import canonical_key, collapsed, copy_runs
from chorale.llm.matching import matches
from chorale.llm.names import name_clusters, name_pairs
from chorale.llm.near import group_pairs, near_duplicate_groups, normal_text
from chorale.llm.representatives import best_records, completeness, consolidated, top_of_group, valid_confidence
from chorale.sources.tables import table


def _duplicate_records(spark: SparkSession, d: str) -> DataFrame:
    v, g = table(spark, d, "videos"), table(spark, d, "discogs_data")
    videos = v.select(F.lit("videos").alias("table_name"), video_key("video_id", "url").alias("group_id"), valid_confidence("parse_confidence").alias("trust"), F.col("scraped_at").alias("at"), "record_id", F.col("release_year").cast("long").alias("year"))
    discogs = g.select(F.lit("discogs_data").alias("table_name"), trimmed("video_id").alias("group_id"), valid_confidence("confidence").alias("trust"), F.col("fetched_at").alias("at"), "record_id", F.col("year").cast("long").alias("year"))
    return videos.unionByName(discogs).where("group_id is not null")


def _order() -> list:
    return [F.col("trust").desc_nulls_last(), F.col("at").desc_nulls_last(), F.col("record_id").desc_nulls_last()]


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """table_name, group_id, best_record_id, year_record_id of every group of two or more records."""
    best = best_records(_duplicate_records(spark, d), ["table_name", "group_id"], _order(), sources={"year_record_id": F.col("year").between(1900, F.year("at"))}, at_least=2)
    return best.select("table_name", "group_id", "best_record_id", F.coalesce("year_record_id", F.lit(0)).cast("long").alias("year_record_id"))


MERGED = ["title", "artist", "song_title", "channel_name", "genre", "duration_seconds", "view_count"]


def p1_consolidated(spark: SparkSession, d: str) -> DataFrame:
    """One record per video built field by field from its records, most trusted and recent first."""
    v = table(spark, d, "videos")
    rows = v.select(video_key("video_id", "url").alias("group_id"), valid_confidence("parse_confidence").alias("trust"), F.col("scraped_at").alias("at"), "record_id", *MERGED).where("group_id is not null")
    return consolidated(rows, ["group_id"], MERGED, [("trust", True), ("at", True), ("record_id", True)])


def p1_most_complete(spark: SparkSession, d: str) -> DataFrame:
    """group_id, record_id, filled: of every video the record with most fields filled, then the most trusted, the latest and the largest id."""
    v = table(spark, d, "videos").select(video_key("video_id", "url").alias("group_id"), valid_confidence("parse_confidence").alias("trust"), F.col("scraped_at").alias("at"), "record_id", completeness(MERGED).cast("long").alias("filled"))
    return top_of_group(v.where("group_id is not null"), ["group_id"], [F.desc("filled"), *_order()]).select("group_id", "record_id", "filled")


def _named(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "videos").select("record_id", "artist", "song_title").where("artist <> '' and song_title <> ''")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """first_record_id, record_id of every record that is a copy of an earlier one."""
    return copy_runs(_named(spark, d), canonical_key(["artist", "song_title"])).where("record_id <> first_record_id")


def p5_copy_counts(spark: SparkSession, d: str) -> DataFrame:
    """One record per set of copies with the exact number of copies."""
    return collapsed(_named(spark, d), canonical_key(["artist", "song_title"]))


def _clusters(spark: SparkSession, d: str) -> list[tuple[str, DataFrame]]:
    v, g = table(spark, d, "videos"), table(spark, d, "discogs_data")
    names = v.select(F.col("artist").alias("name")).unionByName(g.select(F.col("artist_name").alias("name"))).where("name is not null")
    titles = v.select(F.col("song_title").alias("title")).unionByName(g.select(F.col("song_title").alias("title")))
    channels = v.select(F.col("channel_name").alias("name")).where("name is not null")
    return [("artist", name_clusters(names, "artist", titles)), ("channel", name_clusters(channels, "channel"))]


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """name_kind, name_a, name_b of every two spellings of one artist or channel."""
    parts = [name_pairs(c).select(F.lit(kind).alias("name_kind"), "name_a", "name_b") for kind, c in _clusters(spark, d)]
    return parts[0].unionByName(parts[1])


def p4_clusters(spark: SparkSession, d: str) -> DataFrame:
    """name_kind, spelling, cluster of every name."""
    parts = [c.select(F.lit(kind).alias("name_kind"), "spelling", "cluster") for kind, c in _clusters(spark, d)]
    return parts[0].unionByName(parts[1])


def _near_records(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "videos").select("record_id", "video_id", "url", "title", "artist", "song_title")
    key = F.when((F.col("artist") != "") & (F.col("song_title") != ""), F.xxhash64(canonical_key(["artist", "song_title"])))
    video = F.xxhash64(F.coalesce(video_key("video_id", "url"), F.concat(F.lit("#"), F.col("record_id").cast("string"))))
    return v.select("record_id", normal_text(["title", "artist", "song_title"]).alias("text"), video.alias("video"), key.alias("ckey"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    """record_a, record_b of every two records in one group of near duplicates."""
    return group_pairs(near_duplicate_groups(_near_records(spark, d)))


def p6_groups(spark: SparkSession, d: str) -> DataFrame:
    """record_id, group_id of every record that has a near duplicate."""
    return near_duplicate_groups(_near_records(spark, d)).select("record_id", "group_id")


def p7_matches(spark: SparkSession, d: str) -> DataFrame:
    """discogs_record_id, video_id and confidence of every match of a release without a video."""
    g, v = table(spark, d, "discogs_data"), table(spark, d, "videos")
    left = g.where("video_id is null").select(F.col("record_id").cast("string").alias("key"), F.col("artist_name").alias("artist"), F.col("song_title").alias("title"), F.col("year").cast("int").alias("year"))
    right = v.select(video_key("video_id", "url").alias("key"), "artist", F.col("song_title").alias("title"), F.col("release_year").cast("int").alias("year"))
    return matches(left, right).select(F.col("left_key").cast("long").alias("discogs_record_id"), F.col("right_key").alias("video_id"), F.round("confidence", 4).alias("confidence"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    """discogs_record_id, video_id of every match."""
    return p7_matches(spark, d).select("discogs_record_id", "video_id")


_V_KEY = r"coalesce(nullif(regexp_replace(video_id, '^\s+|\s+$', '', 'g'), ''), nullif(regexp_extract(url, '[?&]v=([A-Za-z0-9_-]{11})', 1), ''), nullif(regexp_extract(url, '/([A-Za-z0-9_-]{11})(?:$|[?&#/])', 1), ''))"
_L = r"regexp_replace(lower({}), '[^\pL\pN]+', '', 'g')"
_COPIES = f"""k AS (SELECT record_id, least({_L.format("artist")}, {_L.format("song_title")}) AS a, greatest({_L.format("artist")}, {_L.format("song_title")}) AS b FROM videos WHERE artist <> '' AND song_title <> ''),
g AS (SELECT min(record_id) OVER (PARTITION BY a, b) AS first_record_id, record_id FROM k)"""

QUERIES = {"p1_found": p1_found, "p1_consolidated": p1_consolidated, "p1_most_complete": p1_most_complete, "p5_found": p5_found, "p5_copy_counts": p5_copy_counts, "p4_found": p4_found, "p4_clusters": p4_clusters, "p6_found": p6_found, "p6_groups": p6_groups, "p7_found": p7_found, "p7_matches": p7_matches}
ORACLE = {
    "p1_found": rf"""WITH r AS (
 SELECT 'videos' AS table_name, {_V_KEY} AS group_id, CASE WHEN parse_confidence BETWEEN 0 AND 1 THEN parse_confidence END AS trust, scraped_at AS t, record_id, release_year AS y FROM videos
 UNION ALL SELECT 'discogs_data', nullif(regexp_replace(video_id, '^\s+|\s+$', '', 'g'), ''), CASE WHEN confidence BETWEEN 0 AND 1 THEN confidence END, fetched_at, record_id, year FROM discogs_data),
o AS (SELECT *, row_number() OVER (PARTITION BY table_name, group_id ORDER BY trust DESC NULLS LAST, t DESC NULLS LAST, record_id DESC) AS n FROM r WHERE group_id IS NOT NULL)
SELECT table_name, group_id, min_by(record_id, n) AS best_record_id, coalesce(min_by(record_id, n) FILTER (WHERE y BETWEEN 1900 AND year(t)), 0) AS year_record_id FROM o GROUP BY 1, 2 HAVING count(*) >= 2""",
    "p1_consolidated": rf"""WITH r AS (SELECT *, {_V_KEY} AS group_id, CASE WHEN parse_confidence BETWEEN 0 AND 1 THEN parse_confidence END AS trust FROM videos),
o AS (SELECT *, row_number() OVER (PARTITION BY group_id ORDER BY trust DESC NULLS LAST, scraped_at DESC NULLS LAST, record_id DESC) AS n FROM r WHERE group_id IS NOT NULL)
SELECT group_id, count(*) AS copies, {", ".join(f"min_by({c}, n) FILTER (WHERE trim({c}::varchar) <> '') AS {c}" for c in MERGED)} FROM o GROUP BY 1""",
    "p1_most_complete": rf"""WITH r AS (SELECT *, {_V_KEY} AS group_id, CASE WHEN parse_confidence BETWEEN 0 AND 1 THEN parse_confidence END AS trust, {" + ".join(f"(coalesce(trim({c}::VARCHAR, ' '), '') <> '')::BIGINT" for c in MERGED)} AS filled FROM videos),
o AS (SELECT *, row_number() OVER (PARTITION BY group_id ORDER BY filled DESC, trust DESC NULLS LAST, scraped_at DESC NULLS LAST, record_id DESC) AS n FROM r WHERE group_id IS NOT NULL)
SELECT group_id, record_id, filled::BIGINT AS filled FROM o WHERE n = 1""",
    "p5_found": f"WITH {_COPIES} SELECT first_record_id, record_id FROM g WHERE record_id <> first_record_id",
    "p5_copy_counts": f"WITH {_COPIES} SELECT first_record_id, count(*) AS copies FROM g GROUP BY 1",
}
