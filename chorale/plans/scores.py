"""Queries of filters, scores, features and rankings over videos (FLT, SCR, FEA, NUM, DT, TOP)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chorale.functions import scoring as S
from chorale.functions import words as W
from chorale.operators import filters as L
from chorale.plans.shared import Query
from chorale.sources.tables import table

QUERY, AS_OF = "karaoke with lyrics", "2025-07-01"

_t = "lower(coalesce(title, ''))"
_td = "lower(coalesce(title, '') || ' ' || coalesce(description, ''))"
_d = "lower(coalesce(description, ''))"
_c = "lower(coalesce(channel_name, ''))"
_day = "coalesce(CASE WHEN regexp_full_match(upload_date, '[0-9]{8}') THEN CAST(try_strptime(upload_date, '%Y%m%d') AS DATE) END, CASE WHEN regexp_full_match(upload_date, '[0-9]{4}-[0-9]{2}-[0-9]{2}') THEN CAST(try_strptime(upload_date, '%Y-%m-%d') AS DATE) END)"


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _any(text: str, words: list[str]) -> str:
    return "(" + " OR ".join(f"contains({text}, {_q(w)})" for w in words) + ")"


def _hits(text: str, words: list[str]) -> str:
    return "(" + " + ".join(f"CAST(contains({text}, {_q(w)}) AS INT)" for w in words) + ")"


def _weighed(text: str, weights: dict[str, float], scale: float = 1.0) -> str:
    return "(" + " + ".join(f"CASE WHEN contains({text}, {_q(w)}) THEN {x * scale!r}::DOUBLE ELSE 0 END" for w, x in weights.items()) + ")"


def _first(text: str, weights: dict, which=None, otherwise: object = 0.0) -> str:
    return "CASE " + " ".join(f"WHEN contains({text}, {_q(w)}) THEN {x if which is None else x[which]}" for w, x in weights.items()) + f" ELSE {otherwise} END"


def _clamp(x: str) -> str:
    return f"greatest(0.0::DOUBLE, least(1.0::DOUBLE, {x}))"


_terms = QUERY.split()
_relevance = f"least(1.0::DOUBLE, (CAST(contains({_t}, '{QUERY}') AS DOUBLE) * 0.4 + CAST(contains({_d}, '{QUERY}') AS DOUBLE) * 0.1 + {_hits(_t, _terms)} / {len(_terms)}.0::DOUBLE * 0.3 + {_hits(_d, _terms)} / {len(_terms)}.0::DOUBLE * 0.1) * CASE WHEN length({_t}) > 100 THEN 0.9 ELSE 1.0 END)"
_quality = _clamp(
    f"0.5::DOUBLE + {_weighed(_td, W.QUALITY, 0.1)} + CASE WHEN coalesce(duration_seconds, 0) = 0 THEN 0 WHEN duration_seconds / 60.0::DOUBLE BETWEEN 2 AND 6 THEN 0.1 WHEN duration_seconds / 60.0::DOUBLE < 1 OR duration_seconds / 60.0::DOUBLE > 10 THEN -0.2 ELSE 0 END"
    f" + {_first(_c, W.VERIFIED_CHANNELS)} * 0.1 + CASE WHEN {_any(_c, W.PROFESSIONAL)} THEN 0.05 ELSE 0 END - CASE WHEN {_any(_c, W.AMATEUR)} THEN 0.05 ELSE 0 END"
)
_age = f"date_diff('day', {_day}, DATE '{AS_OF}')"
_age_score = f"CASE WHEN {_day} IS NULL THEN 0.5 WHEN {_age} <= 30 THEN 0.9 WHEN {_age} <= 180 THEN 0.7 WHEN {_age} <= 365 THEN 0.5 WHEN {_age} <= 1095 THEN 0.3 ELSE 0.2 END"
_view_score = "CASE WHEN view_count <= 1000 THEN 0.1 WHEN view_count <= 10000 THEN 0.3 WHEN view_count <= 100000 THEN 0.5 WHEN view_count <= 1000000 THEN 0.7 WHEN view_count <= 10000000 THEN 0.9 ELSE 1.0 END"
_popularity = f"CASE WHEN coalesce(view_count, 0) = 0 THEN 0.3 ELSE {_view_score} * 0.7 + {_age_score} * 0.3 END"
_metadata = "least(1.0, CASE WHEN length(title) > 10 THEN 0.3 ELSE 0 END + CASE WHEN length(channel_name) > 0 THEN 0.2 ELSE 0 END + CASE WHEN length(description) > 50 THEN 0.2 ELSE 0 END + CASE WHEN duration_seconds > 0 THEN 0.1 ELSE 0 END + CASE WHEN view_count > 0 THEN 0.1 ELSE 0 END + CASE WHEN length(upload_date) > 0 THEN 0.1 ELSE 0 END)"
_final = _clamp(f"({_relevance}) * 0.35 + ({_quality}) * 0.25 + ({_popularity}) * 0.2 + ({_metadata}) * 0.2")

QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def _add(name: str, columns: dict[str, object] | None, where, sql: str, doc: str) -> None:
    def run(spark: SparkSession, d: str) -> DataFrame:
        v = table(spark, d, "videos")
        v = v if where is None else v.where(where() if callable(where) else where)
        return v.select("record_id", *[(c() if callable(c) else c).alias(k) for k, c in (columns or {}).items()])

    run.__doc__ = doc
    QUERIES[name], ORACLE[name] = run, sql


def _score(name: str, column, sql: str, doc: str) -> None:
    _add(name, {"score": lambda: F.round(column(), 6)}, None, f"SELECT record_id, round({sql}, 6)::DOUBLE AS score FROM videos", doc)


_add("flt01_likely_karaoke", None, L.likely_karaoke, f"SELECT record_id FROM videos WHERE {_any(_td, W.KARAOKE)} AND NOT {_any(_td, W.NOT_KARAOKE)}", "Likely karaoke: a word for it, none against it.")
_add("flt02_plausible_duration", None, L.plausible_duration, "SELECT record_id FROM videos WHERE coalesce(duration_seconds, 0) = 0 OR duration_seconds BETWEEN 45 AND 900", "Durations of 45 to 900 seconds or none.")
_add("flt04_channel_limits", None, L.within_channel_limits, f"SELECT record_id FROM videos WHERE duration_seconds BETWEEN {_first(_c, W.DURATIONS, 0, W.DURATION_ELSE[0])} AND {_first(_c, W.DURATIONS, 1, W.DURATION_ELSE[1])}", "Durations within the limits of the channel's kind.")
_add("flt05_uploaded_after", None, lambda: L.uploaded_after("2021-06-30"), f"SELECT record_id FROM videos WHERE {_day} IS NULL OR {_day} > DATE '2021-06-30'", "Uploads after a day; unreadable dates pass.")
_add("flt06_valid_artist", None, lambda: L.valid_name("artist"), f"SELECT record_id FROM videos WHERE length(trim(artist)) >= 1 AND length(artist) <= 100 AND lower(trim(artist)) NOT IN ({', '.join(_q(w) for some in W.NO_NAME for w in some)}) AND len(regexp_extract_all(artist, '[\\pL\\pM\\p{{Nd}}\\p{{Pc}}\\p{{Nl}}\\x{{200C}}\\x{{200D}}]')) >= length(artist) * 0.3".replace("{{", "{").replace("}}", "}"), "Artists that look like names, by the stricter test.")
_add("flt07_valid_song", None, lambda: L.valid_song("song_title"), f"SELECT record_id FROM videos WHERE length(trim(song_title)) BETWEEN 2 AND 200 AND lower(trim(song_title)) NOT IN ({', '.join(map(_q, W.NO_SONG))})", "Songs that look like titles.")
_add("flt09_valid_guest", None, lambda: L.valid_guest(F.col("featured_artists")), f"SELECT record_id FROM videos WHERE NOT {_any('lower(featured_artists)', W.NO_GUEST)} AND NOT regexp_full_match(featured_artists, '[\\d\\s\\-_.]+') AND length(trim(featured_artists)) >= 2", "Featured artists that look like names.")
_add("flt12_karaoke_channel", None, lambda: L.karaoke_channel(), f"SELECT record_id FROM videos WHERE {_hits(_c + chr(32) + '||' + chr(32) + _q(' ') + ' || ' + _d, W.KARAOKE_CHANNEL)} >= 2 OR contains({_c}, 'karaoke')", "Records of channels about karaoke.")
_add("flt13_complete_metadata", None, lambda: L.complete_metadata(), "SELECT record_id FROM videos WHERE length(trim(genre)) > 0 AND release_year <> 0", "Records with genre and year.")


def flt03_new_batch(spark: SparkSession, d: str) -> DataFrame:
    """Videos of strict duration that no release is attached to (batch anti-join)."""
    return L.not_stored(table(spark, d, "videos").select("record_id", "video_id", "duration_seconds"), table(spark, d, "discogs_data")).select("record_id")


QUERIES["flt03_new_batch"] = flt03_new_batch
ORACLE["flt03_new_batch"] = "SELECT record_id FROM videos v WHERE coalesce(duration_seconds, 0) BETWEEN 45 AND 900 AND NOT EXISTS (SELECT 1 FROM discogs_data g WHERE g.video_id = v.video_id)"

_score("scr01_relevance", lambda: S.relevance(QUERY), _relevance, "Relevance of every title and description to a query.")
_score("scr02_quality", S.quality, _quality, "Quality by words, duration and channel.")
_score("scr03_popularity", lambda: S.popularity(AS_OF), _popularity, "Popularity by views and age.")
_score("scr04_metadata", S.metadata_score, _metadata, "Completeness of the metadata.")
_score("scr05_final", lambda: S.final_score(QUERY, AS_OF), _final, "Weighted final score.")
_score("scr07_hit_relevance", lambda: S.hit_relevance(QUERY), f"least(2.0::DOUBLE, CAST(contains({_t}, '{QUERY}') AS DOUBLE) + {_hits(_t, _terms)} / {len(_terms)}.0::DOUBLE * 0.5 + {_weighed(_t, W.HIT_WORDS)})", "Relevance of a search hit.")
_score("scr07_channel_video", S.channel_video_score, f"least(2.0::DOUBLE, 0.5::DOUBLE + CASE WHEN {_any(_t, ['karaoke', 'backing track', 'instrumental', 'sing along'])} THEN 0.3 ELSE 0 END + {_weighed(_t, W.CHANNEL_WORDS)})", "Score of a channel's own video.")
_score("scr09_technical", lambda: S.technical_quality(F.col("duration_seconds")), "CASE WHEN duration_seconds BETWEEN 120 AND 360 THEN 0.3 WHEN duration_seconds BETWEEN 60 AND 480 THEN 0.2 ELSE 0.0 END", "Technical part of the quality.")
_score("num03_view_score", lambda: S.view_score(F.col("view_count")), _view_score.replace("ELSE 1.0", "WHEN view_count IS NULL THEN 0.1 ELSE 1.0"), "Step score of the views.")
_add("str24_channel_kind", {"kind": S.channel_kind}, None, f"SELECT record_id, CASE WHEN {_any(_c, list(W.VERIFIED_CHANNELS))} THEN 'verified_karaoke' WHEN {_any(_c, W.PROFESSIONAL)} THEN 'professional' WHEN {_any(_c, W.AMATEUR)} THEN 'amateur' ELSE 'unknown' END AS kind FROM videos", "Kind of the channel by its name.")
_add("str28_holiday_genre", {"genre_found": lambda: F.when(S.has_any(S.text_of("title", "description"), W.HOLIDAY), "Christmas/Holiday")}, None, f"SELECT record_id, CASE WHEN {_any(_td, W.HOLIDAY)} THEN 'Christmas/Holiday' END AS genre_found FROM videos", "Holiday genre by words.")
_add("dt03_upload_day", {"day": S.upload_day}, None, f"SELECT record_id, {_day} AS day FROM videos", "Upload dates of both forms as dates.")
_add("dt04_age_days", {"age_days": lambda: F.datediff(F.lit(AS_OF).cast("date"), S.upload_day()).cast("long")}, None, f"SELECT record_id, {_age} AS age_days FROM videos", "Age in days at a given day.")
_add("dt04_age_score", {"score": lambda: S.age_score(S.upload_day(), AS_OF)}, None, f"SELECT record_id, ({_age_score})::DOUBLE AS score FROM videos", "Step score of the age.")
_add(
    "fea01_feature_flags",
    {k: (lambda p=p: S.feature_flag(S.text_of("title", "description"), p)[0]) for k, p in W.FEATURES.items()} | {f"{k}_confidence": (lambda p=p: F.round(S.feature_flag(S.text_of("title", "description"), p)[1], 6)) for k, p in W.FEATURES.items()},
    None,
    "SELECT record_id, " + ", ".join(f"{_hits(_td, p)} > 0 AS {k}, round(CASE WHEN {_hits(_td, p)} > 0 THEN least(1.0, 0.6 + ({_hits(_td, p)} - 1) * 0.1) ELSE 0.0 END, 6)::DOUBLE AS {k}_confidence" for k, p in W.FEATURES.items()) + " FROM videos",
    "Six features found by words, with confidences.",
)


def num02_engagement(spark: SparkSession, d: str) -> DataFrame:
    """Net likes per view of every record, with the dislikes of its video."""
    r = table(spark, d, "ryd_data").where("video_id is not null").groupBy("video_id").agg(F.max("estimated_dislikes").alias("dislikes"))
    return table(spark, d, "videos").join(r, "video_id", "left").select("record_id", S.engagement(F.col("view_count"), F.col("like_count"), F.col("dislikes")).alias("engagement"))


def scr09_engagement_quality(spark: SparkSession, d: str) -> DataFrame:
    """Engagement part of the quality, with a penalty for trusted dislikes."""
    r = table(spark, d, "ryd_data").where("video_id is not null").groupBy("video_id").agg(F.max("estimated_dislikes").alias("dislikes"), F.max("ryd_confidence").alias("trust"))
    return table(spark, d, "videos").join(r, "video_id", "left").select("record_id", F.round(S.engagement_quality(F.col("view_count"), F.col("like_count"), F.col("dislikes"), F.col("trust")), 6).alias("score"))


_RYD = "videos v LEFT JOIN (SELECT video_id, max(estimated_dislikes) AS dislikes, max(ryd_confidence) AS trust FROM ryd_data WHERE video_id IS NOT NULL GROUP BY 1) r ON v.video_id = r.video_id"
QUERIES |= {"num02_engagement": num02_engagement, "scr09_engagement_quality": scr09_engagement_quality}
ORACLE |= {
    "num02_engagement": f"SELECT record_id, CASE WHEN view_count > 0 AND like_count IS NOT NULL THEN round((CASE WHEN coalesce(dislikes, 0) > 0 THEN like_count - dislikes ELSE like_count END)::DOUBLE / view_count * 100, 3) END AS engagement FROM {_RYD}",
    "scr09_engagement_quality": f"SELECT record_id, round(greatest(0.0, least(1.0, CASE WHEN coalesce(view_count, 0) > 1000 THEN 0.3 ELSE 0 END + CASE WHEN coalesce(view_count, 0) > 10000 THEN 0.2 ELSE 0 END + CASE WHEN coalesce(like_count, 0) > 50 THEN 0.3 ELSE 0 END + CASE WHEN view_count > 0 AND coalesce(like_count, 0)::DOUBLE / view_count > 0.01 THEN 0.2 ELSE 0 END - CASE WHEN coalesce(trust, 0) > 0.5 AND coalesce(like_count, 0) + coalesce(dislikes, 0) > 0 AND coalesce(dislikes, 0)::DOUBLE / (coalesce(like_count, 0) + coalesce(dislikes, 0)) > 0.3 THEN 0.2 ELSE 0 END)), 6)::DOUBLE AS score FROM {_RYD}",
}


def top01_ranked(spark: SparkSession, d: str) -> DataFrame:
    """Rank of every record within its channel by final score; ties by record_id."""
    v = table(spark, d, "videos").where("channel_id is not null").select("record_id", "channel_id", F.round(S.final_score(QUERY, AS_OF), 6).alias("score"))
    return v.withColumn("place", F.row_number().over(Window.partitionBy("channel_id").orderBy(F.desc("score"), "record_id"))).where("place <= 10")


def top03_union_first(spark: SparkSession, d: str) -> DataFrame:
    """Two sources united, the first source and the earlier row winning for each video."""
    v = table(spark, d, "videos").where("video_id is not null").select("video_id", F.lit(1).alias("source"), F.col("record_id").alias("place"))
    g = table(spark, d, "discogs_data").where("video_id is not null").select("video_id", F.lit(2).alias("source"), F.col("record_id").alias("place"))
    w = Window.partitionBy("video_id").orderBy("source", "place")
    return v.unionByName(g).withColumn("rn", F.row_number().over(w)).where("rn = 1").drop("rn")


def top04_best_releases(spark: SparkSession, d: str) -> DataFrame:
    """Releases deduplicated by artist and song in lower case, the most confident kept."""
    g = table(spark, d, "discogs_data").where("artist_name is not null and song_title is not null and confidence between 0 and 1").select(F.lower("artist_name").alias("artist"), F.lower("song_title").alias("song"), "record_id", "confidence")
    w = Window.partitionBy("artist", "song").orderBy(F.desc("confidence"), "record_id")
    return g.withColumn("rn", F.row_number().over(w)).where("rn = 1").drop("rn")


def flt14_result_filter(spark: SparkSession, d: str) -> DataFrame:
    """Candidates of a video above a confidence that is stricter where there are many."""
    g = table(spark, d, "discogs_data").where("video_id is not null").select("record_id", "video_id", "confidence")
    n = F.count(F.lit(1)).over(Window.partitionBy("video_id"))
    return g.withColumn("n", n).where(F.col("confidence") >= F.when(F.col("n") > 3, 0.5).otherwise(0.3)).select("record_id")


def agg22_score_buckets(spark: SparkSession, d: str) -> DataFrame:
    """How many records fall in each tenth of the final score."""
    v = table(spark, d, "videos").select(F.round(S.final_score(QUERY, AS_OF), 6).alias("score"))
    return v.groupBy((F.floor(F.col("score") * 10) / 10).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


QUERIES |= {"top01_ranked": top01_ranked, "top03_union_first": top03_union_first, "top04_best_releases": top04_best_releases, "flt14_result_filter": flt14_result_filter, "agg22_score_buckets": agg22_score_buckets}
ORACLE |= {
    "top01_ranked": f"SELECT * FROM (SELECT record_id, channel_id, score, row_number() OVER (PARTITION BY channel_id ORDER BY score DESC, record_id) AS place FROM (SELECT record_id, channel_id, round({_final}, 6)::DOUBLE AS score FROM videos WHERE channel_id IS NOT NULL)) WHERE place <= 10",
    "top03_union_first": "SELECT video_id, source, place FROM (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY source, place) AS rn FROM (SELECT video_id, 1 AS source, record_id AS place FROM videos WHERE video_id IS NOT NULL UNION ALL SELECT video_id, 2, record_id FROM discogs_data WHERE video_id IS NOT NULL)) WHERE rn = 1",
    "top04_best_releases": "SELECT artist, song, record_id, confidence FROM (SELECT lower(artist_name) AS artist, lower(song_title) AS song, record_id, confidence, row_number() OVER (PARTITION BY lower(artist_name), lower(song_title) ORDER BY confidence DESC, record_id) AS rn FROM discogs_data WHERE artist_name IS NOT NULL AND song_title IS NOT NULL AND confidence BETWEEN 0 AND 1) WHERE rn = 1",
    "flt14_result_filter": "SELECT record_id FROM (SELECT record_id, confidence, count(*) OVER (PARTITION BY video_id) AS n FROM discogs_data WHERE video_id IS NOT NULL) WHERE confidence >= CASE WHEN n > 3 THEN 0.5 ELSE 0.3 END",
    "agg22_score_buckets": f"SELECT floor(score * 10) / 10 AS bucket, count(*) AS n FROM (SELECT round({_final}, 6)::DOUBLE AS score FROM videos) GROUP BY 1",
}
