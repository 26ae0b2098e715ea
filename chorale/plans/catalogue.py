"""Queries of catalogue scores, evidence, ordered choices and the search composition (SCR, FEA2, TOP, ORC, STR)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chorale.functions import catalogue as C
from chorale.functions import scoring as S
from chorale.functions import strings as T
from chorale.functions import words as W
from chorale.plans.scores import AS_OF, QUERY, _any, _final, _hits, _t, _td, _terms, _weighed
from chorale.plans.shared import Query, register
from chorale.plans.similar import _ascii, _clean, _jac, _words
from chorale.plans.texts import _SPACE, q
from chorale.sources.tables import table

QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}

_RATIO = f"{_hits(_t, _terms)} / {len(_terms)}.0::DOUBLE"


def scr08_second_source(spark: SparkSession, d: str) -> DataFrame:
    """Relevance as the second search source scores it."""
    return table(spark, d, "videos").select("record_id", F.round(C.second_source(QUERY), 6).alias("score"))


def scr08_third_source(spark: SparkSession, d: str) -> DataFrame:
    """Relevance as the third search source scores it."""
    return table(spark, d, "videos").select("record_id", F.round(C.third_source(QUERY), 6).alias("score"))


def scr11_votes_trust(spark: SparkSession, d: str) -> DataFrame:
    """Trust in the votes of a video."""
    return table(spark, d, "ryd_data").select("video_id", "fetched_at", F.round(C.votes_trust(F.col("ryd_likes"), F.col("estimated_dislikes"), F.col("ryd_rating"), F.lit(False)), 6).alias("trust"))


def _attached(spark: SparkSession, d: str) -> DataFrame:
    """Records and releases of the same video, with plain names."""
    v = table(spark, d, "videos").where("artist <> '' and song_title <> ''").select("record_id", "video_id", T.plain_ascii("artist").alias("va"), T.plain_ascii("song_title").alias("vs"))
    g = table(spark, d, "discogs_data").where("artist_name <> '' and song_title <> ''").select("video_id", F.col("record_id").alias("release_record"), T.plain_ascii("artist_name").alias("ga"), T.plain_ascii("song_title").alias("gs"), "year", "genres", "label", "master_id")
    return v.join(g, "video_id")


def scr12_parse_confidence(spark: SparkSession, d: str) -> DataFrame:
    """Confidence that a release is the song of a record."""
    extras = [F.col("year").isNotNull(), F.length("genres") > 0, F.col("label").isNotNull(), F.col("master_id").isNotNull()]
    return _attached(spark, d).select("record_id", "release_record", F.round(C.parse_confidence(F.col("va"), F.col("vs"), F.col("ga"), F.col("gs"), extras), 6).alias("confidence"))


def scr18_release_confidence(spark: SparkSession, d: str) -> DataFrame:
    """Stricter confidence of a release: the artist must be alike."""
    return _attached(spark, d).select("record_id", "release_record", F.round(C.release_confidence(F.col("va"), F.col("vs"), F.col("ga"), F.col("gs"), F.col("master_id")), 5).alias("confidence"))


def scr10_overall(spark: SparkSession, d: str) -> DataFrame:
    """Overall confidence of a record from what is known of it."""
    text = S.text_of("title", "description")
    features = [S.feature_flag(text, p)[1] for p in W.FEATURES.values()]
    valid = F.when((F.col("artist") != "") & (F.col("song_title") != ""), 1.0).otherwise(0.0)
    missing = F.coalesce((F.coalesce(F.col("artist"), F.lit("")) == "").cast("int") + F.col("channel_id").isNull().cast("int"), F.lit(0))
    return table(spark, d, "videos").select("record_id", F.round(C.overall_confidence(F.col("title"), F.col("view_count"), F.col("duration_seconds"), features, F.lit(0.0), valid, missing), 6).alias("confidence"))


def scr21_swapped(spark: SparkSession, d: str) -> DataFrame:
    """Points for artist and song being swapped, and whether they are enough."""
    v = table(spark, d, "videos").where("artist <> '' and song_title <> ''").select("record_id", F.round(C.swapped_fields(F.col("artist"), F.col("song_title")), 4).alias("points"))
    return v.withColumn("swap", F.col("points") >= 0.8)


def str27_genre_of_artist(spark: SparkSession, d: str) -> DataFrame:
    """Genre told by words of the artist's name."""
    return table(spark, d, "videos").where("artist is not null").select("record_id", C.genre_of_artist(F.col("artist")).alias("genre_guess"))


def agg29_genre_vote(spark: SparkSession, d: str) -> DataFrame:
    """The genre most tags of a release speak for."""
    g = table(spark, d, "discogs_data").select("record_id", F.explode(F.array_distinct(F.split(F.regexp_replace("genres", r'[\[\]"]', ""), r"\s*[,;/|]\s*"))).alias("tag"))
    votes = g.select("record_id", F.explode(C.genres_of_tag(F.col("tag"))).alias("g")).groupBy("record_id", "g.place", "g.genre").agg(F.count(F.lit(1)).alias("n"))
    return votes.groupBy("record_id").agg(F.max_by("genre", F.struct("n", "place")).alias("genre_class"), F.max("n").alias("votes"))


def fea02_assembly(spark: SparkSession, d: str) -> DataFrame:
    """Flags found in the text where none is stored, the latest stored ones else."""
    w = Window.partitionBy("video_id").orderBy(F.desc("extracted_at"), F.desc("record_id"))
    f = table(spark, d, "video_features").where("video_id is not null").withColumn("rn", F.row_number().over(w)).where("rn = 1").select("video_id", F.col("has_guide_vocals").alias("stored"))
    v = table(spark, d, "videos").select("record_id", "video_id", S.feature_flag(S.text_of("title", "description"), W.FEATURES["has_guide_vocals"])[0].alias("found"))
    return v.join(f, "video_id", "left").select("record_id", F.coalesce("stored", "found").alias("has_guide_vocals"), F.when(F.col("stored").isNotNull(), "stored").otherwise("text").alias("origin"))


def orc01_search(spark: SparkSession, d: str) -> DataFrame:
    """Search as a composition: hits of two sources filtered, united (the first source wins), ranked; the first hundred."""
    v = table(spark, d, "videos").where("video_id is not null").where(S.has_any(S.text_of("title", "description"), W.KARAOKE))
    scored = v.select("video_id", "record_id", F.when(F.col("discogs_checked"), "first").otherwise("second").alias("source"), F.round(S.final_score(QUERY, AS_OF), 6).alias("score"))
    weight = F.when(F.col("source") == "first", C.SOURCE_WEIGHTS["first"]).otherwise(C.SOURCE_WEIGHTS["second"])
    w = Window.partitionBy("video_id").orderBy("source", "record_id")
    one = scored.withColumn("rn", F.row_number().over(w)).where("rn = 1").withColumn("final", F.round(F.col("score") * weight, 6))
    return one.orderBy(F.desc("final"), "record_id").limit(100).select("video_id", "record_id", "source", "final")


def top07_capped_sources(spark: SparkSession, d: str) -> DataFrame:
    """Of every source of documents the five longest texts."""
    w = Window.partitionBy("source").orderBy(F.desc("n_chars"), "doc_id")
    return table(spark, d, "documents").select("source", "doc_id", "n_chars").withColumn("place", F.row_number().over(w)).where("place <= 5")


def str14_candidates(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of artist and song a title may stand for: either side of a dash, either way round."""
    parts = F.filter(F.transform(F.split("title", r"\s[-–—]\s"), lambda x: T.stripped(F.regexp_replace(x, r"[(\[][^)\]]*[)\]]", ""))), lambda x: x != "")
    a, b = F.get(parts, F.lit(0)), F.get(parts, F.lit(1))
    pairs = F.array(F.struct(a.alias("artist"), b.alias("song")), F.struct(b.alias("artist"), a.alias("song")))
    return table(spark, d, "videos").where(F.size(parts) >= 2).select("record_id", F.posexplode(pairs).alias("pos", "p")).select("record_id", "pos", "p.artist", "p.song")


QUERIES |= {
    f.__name__: f
    for f in (scr08_second_source, scr08_third_source, scr10_overall, scr11_votes_trust, scr12_parse_confidence, scr18_release_confidence, scr21_swapped, str27_genre_of_artist, agg29_genre_vote, fea02_assembly, orc01_search, top07_capped_sources, str14_candidates)
}

_ATT = f"(SELECT v.record_id, g.record_id AS release_record, {_ascii('v.artist')} AS va, {_ascii('v.song_title')} AS vs, {_ascii('g.artist_name')} AS ga, {_ascii('g.song_title')} AS gs, g.year, g.genres, g.label, g.master_id FROM videos v JOIN discogs_data g ON v.video_id = g.video_id WHERE v.artist <> '' AND v.song_title <> '' AND g.artist_name <> '' AND g.song_title <> '')"
_part = lambda a, b: f"CASE WHEN {a} = {b} THEN 0.3 WHEN contains({a}, {b}) OR contains({b}, {a}) THEN 0.2 WHEN (SELECT ({_jac('w1', 'w2')}) >= 0.7 FROM (SELECT {_clean(a)} AS w1, {_clean(b)} AS w2)) THEN 0.1 ELSE 0 END"
_edit = "(1 - levenshtein({0}, {1})::DOUBLE / greatest(length({0}), length({1}), 1))"


def _similar(a: str, b: str, artist: bool) -> str:
    cut = lambda t: f"trim(regexp_replace({t}, '[{_SPACE}]*\\([^)]*\\)', '', 'g'), ' ')"
    base = f"SELECT x, y, {cut('x')} AS cx, {cut('y')} AS cy, list_distinct({_words(cut('x'))}) AS wx, list_distinct({_words(cut('y'))}) AS wy FROM (SELECT trim({a}, ' ') AS x, trim({b}, ' ') AS y)"
    near = f"len([q FOR q IN wx IF len([r FOR r IN wy IF {_edit.format('q', 'r')} >= 0.8]) > 0])::DOUBLE"
    score = f"{_edit.format('x', 'y')} * 0.5 + CASE WHEN len(wx) > 0 THEN {near} / len(wx) ELSE 0 END * 0.4 + ({_jac('wx', 'wy')}) * 0.1" if artist else f"{_edit.format('x', 'y')} * 0.6 + ({_jac('wx', 'wy')}) * 0.25 + CASE WHEN least(length(cx), length(cy)) >= 3 AND (contains(cx, cy) OR contains(cy, cx)) THEN least(length(cx), length(cy))::DOUBLE / greatest(length(cx), length(cy)) ELSE 0 END * 0.15"
    return f"(SELECT CASE WHEN x = '' OR y = '' THEN 0 WHEN x = y THEN 1 ELSE least(1, {score}) END::DOUBLE FROM ({base}))"


_feat = "[" + ", ".join(f"CASE WHEN {_hits(_td, p)} > 0 THEN least(1.0, 0.6 + ({_hits(_td, p)} - 1) * 0.1) ELSE 0.0 END::DOUBLE" for p in W.FEATURES.values()) + "]"
_valid = "CASE WHEN artist <> '' AND song_title <> '' THEN 1.0 ELSE 0.0 END::DOUBLE"
_missing = "((coalesce(artist, '') = '')::INT + (channel_id IS NULL)::INT)"
_tl = lambda c: f"regexp_matches(lower({c}), '\\b(?:me|my|your|you|tonight|like|don''t|nobody|every|when|before|serenade)\\b')::INT"
_al = lambda c: f"regexp_matches(lower({c}), '\\b(?:and the|brothers|sisters|trio|quartet|orchestra|choir|ensemble|collective|dj|mc)\\b')::INT"
_many = lambda c: f"len(regexp_split_to_array(trim({c}, ' '), '[\\s\\v]+'))"
_points = f"round({_tl('artist')} * 0.4 + {_al('song_title')} * 0.4 + CASE WHEN {_many('artist')} > {_many('song_title')} + 2 THEN 0.2 ELSE 0 END - {_tl('song_title')} * 0.4 - {_al('artist')} * 0.4, 4)::DOUBLE"
ORACLE |= {
    "scr08_second_source": f"SELECT record_id, round(least(1.5, contains({_t}, '{QUERY}')::INT * 0.8 + {_RATIO} * 0.4 + {_weighed(_t, C.SECOND_WORDS)}), 6)::DOUBLE AS score FROM videos",
    "scr08_third_source": f"SELECT record_id, round(least(1.2, contains({_t}, '{QUERY}')::INT * 0.7 + {_RATIO} * 0.3 + {_weighed(_t, C.THIRD_WORDS)}), 6)::DOUBLE AS score FROM videos",
    "scr11_votes_trust": "SELECT video_id, fetched_at, round(least(1.0, CASE WHEN d > 0 THEN 0.3 ELSE 0 END + CASE WHEN k > 0 AND d > 0 AND k::DOUBLE / greatest(k + d, 1) BETWEEN 0.1 AND 0.99 THEN 0.4 ELSE 0 END + CASE WHEN ryd_rating > 0 THEN 0.2 ELSE 0 END + 0.1), 6)::DOUBLE AS trust FROM (SELECT *, coalesce(ryd_likes, 0) AS k, coalesce(estimated_dislikes, 0) AS d FROM ryd_data)",
    "scr12_parse_confidence": f"SELECT record_id, release_record, round(least(1.0, 0.3 + {_part('a', 'x')} + {_part('b', 'y')} + CASE WHEN year IS NOT NULL THEN 0.05 ELSE 0 END + CASE WHEN length(genres) > 0 THEN 0.05 ELSE 0 END + CASE WHEN label IS NOT NULL THEN 0.05 ELSE 0 END + CASE WHEN master_id IS NOT NULL THEN 0.05 ELSE 0 END), 6)::DOUBLE AS confidence FROM (SELECT *, lower(va) AS a, lower(vs) AS b, lower(ga) AS x, lower(gs) AS y FROM {_ATT})",
    "scr18_release_confidence": f"SELECT record_id, release_record, round(CASE WHEN sa < 0.75 THEN 0 ELSE least(1.0::DOUBLE, (sa * 0.5 + st * 0.4) * CASE WHEN a2 IN ({', '.join(map(q, C.VARIOUS))}) THEN 0.2 ELSE 1 END * CASE WHEN {_any('s2', ['soundtrack', 'ost'])} THEN 0.5 ELSE 1 END + CASE WHEN master_id IS NOT NULL THEN 0.1 ELSE 0 END) END, 5)::DOUBLE AS confidence FROM (SELECT *, {_similar('a1', 'a2', True)} AS sa, {_similar('s1', 's2', False)} AS st FROM (SELECT *, lower(va) AS a1, lower(vs) AS s1, lower(ga) AS a2, lower(gs) AS s2 FROM {_ATT}))",
    "scr10_overall": f"SELECT record_id, round(least(1.0, greatest(0.0, least(1.0, b)) * (0.7 + 0.3 * v)), 6)::DOUBLE AS confidence FROM (SELECT record_id, {_valid} AS v, CASE WHEN length(title) > 0 THEN 0.2 ELSE 0 END + CASE WHEN view_count > 0 THEN 0.2 ELSE 0 END + CASE WHEN duration_seconds > 0 THEN 0.2 ELSE 0 END + coalesce(list_avg([x FOR x IN {_feat} IF x > 0]), 0) * 0.3 + {_valid} * 0.2 - least({_missing} * 0.1, 0.3) AS b FROM videos)",
    "scr21_swapped": f"SELECT record_id, points, points >= 0.8 AS swap FROM (SELECT record_id, {_points} AS points FROM videos WHERE artist <> '' AND song_title <> '')",
    "str27_genre_of_artist": "SELECT record_id, CASE " + " ".join(f"WHEN {_any('lower(artist)', w)} THEN {q(g)}" for g, w in C.GENRE_OF_ARTIST) + " END AS genre_guess FROM videos WHERE artist IS NOT NULL",
    "agg29_genre_vote": "WITH t AS (SELECT DISTINCT record_id, unnest(regexp_split_to_array(regexp_replace(genres, '[\\[\\]\"]', '', 'g'), '\\s*[,;/|]\\s*')) AS tag FROM discogs_data), g AS (" + " UNION ALL ".join(f"SELECT record_id, {-k} AS place, {q(g)} AS genre FROM t WHERE {_any('lower(tag)', w)}" for k, (g, w) in enumerate(C.GENRE_OF_TAG.items())) + "), n AS (SELECT record_id, place, genre, count(*) AS n FROM g GROUP BY 1, 2, 3) SELECT record_id, genre AS genre_class, n AS votes FROM (SELECT *, row_number() OVER (PARTITION BY record_id ORDER BY n DESC, place DESC) AS rn FROM n) WHERE rn = 1",
    "fea02_assembly": f"SELECT v.record_id, coalesce(f.has_guide_vocals, {_hits(_td, W.FEATURES['has_guide_vocals'])} > 0) AS has_guide_vocals, CASE WHEN f.has_guide_vocals IS NOT NULL THEN 'stored' ELSE 'text' END AS origin FROM videos v LEFT JOIN (SELECT * FROM (SELECT video_id, has_guide_vocals, row_number() OVER (PARTITION BY video_id ORDER BY extracted_at DESC, record_id DESC) AS rn FROM video_features WHERE video_id IS NOT NULL) WHERE rn = 1) f ON v.video_id = f.video_id",
    "orc01_search": f"SELECT video_id, record_id, source, round(score * CASE source WHEN 'first' THEN 1.0 ELSE 0.6 END, 6)::DOUBLE AS final FROM (SELECT video_id, record_id, source, score, row_number() OVER (PARTITION BY video_id ORDER BY source, record_id) AS rn FROM (SELECT video_id, record_id, CASE WHEN discogs_checked THEN 'first' ELSE 'second' END AS source, round({_final}, 6)::DOUBLE AS score FROM videos WHERE video_id IS NOT NULL AND {_any(_td, W.KARAOKE)})) WHERE rn = 1 ORDER BY final DESC, record_id LIMIT 100",
    "top07_capped_sources": "SELECT * FROM (SELECT source, doc_id, n_chars, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS place FROM documents) WHERE place <= 5",
    "str14_candidates": f"SELECT record_id, i AS pos, CASE i WHEN 0 THEN p[1] ELSE p[2] END AS artist, CASE i WHEN 0 THEN p[2] ELSE p[1] END AS song FROM (SELECT record_id, p, unnest([0, 1]) AS i FROM (SELECT record_id, [x FOR x IN [regexp_replace(regexp_replace(y, '[(\\[][^)\\]]*[)\\]]', '', 'g'), '^[{_SPACE}]+|[{_SPACE}]+$', '', 'g') FOR y IN regexp_split_to_array(title, '\\s[-–—]\\s')] IF x <> ''] AS p FROM videos) WHERE len(p) >= 2)",
}

register(
    QUERIES,
    ORACLE,
    {
        "top02_best_of_parses": """
            SELECT record_id, artist, song_title, weight FROM (SELECT record_id, artist, song_title, weight, row_number() OVER (PARTITION BY record_id ORDER BY weight DESC, place) AS rn FROM (
              SELECT v.record_id, v.artist, v.song_title, 0 AS place, round(coalesce(CASE WHEN v.parse_confidence BETWEEN 0 AND 1 THEN v.parse_confidence END, 0e0) * CASE WHEN v.artist <> '' AND v.song_title <> '' THEN 1.2e0 ELSE 1e0 END, 6) AS weight FROM {videos} v
              UNION ALL SELECT v.record_id, g.artist_name, g.song_title, g.record_id, round(g.confidence * CASE WHEN g.artist_name <> '' AND g.song_title <> '' THEN 1.2e0 ELSE 1e0 END, 6) FROM {videos} v JOIN {discogs_data} g ON v.video_id = g.video_id WHERE g.confidence BETWEEN 0 AND 1) p) x WHERE rn = 1""",
        "top09_ordered_releases": "SELECT video_id, record_id, place FROM (SELECT video_id, record_id, row_number() OVER (PARTITION BY video_id ORDER BY confidence DESC NULLS LAST, community_have DESC NULLS LAST, fetched_at DESC, record_id) AS place FROM {discogs_data} WHERE video_id IS NOT NULL) x WHERE place <= 3",
        "top10_recent_channels": "SELECT channel_id, last_seen, n FROM (SELECT channel_id, max(scraped_at) AS last_seen, count(*) AS n FROM {videos} WHERE channel_id IS NOT NULL GROUP BY channel_id) c ORDER BY last_seen DESC, channel_id LIMIT 50",
        "top12_not_yet_stored": "SELECT g.record_id FROM {discogs_data} g LEFT JOIN {videos} v ON g.video_id = v.video_id WHERE g.video_id IS NOT NULL AND v.video_id IS NULL",
        "prj05_rounded_families": "SELECT record_id, CAST(round(CAST(overall_confidence AS DECIMAL(28, 12)), 2) AS DOUBLE) AS confidence, CAST(round(CAST(overall_confidence * 5 AS DECIMAL(28, 12)), 1) AS DOUBLE) AS rating, CAST(round(CAST(overall_confidence * 100 AS DECIMAL(28, 12)), 3) AS DOUBLE) AS percentage FROM {video_features} WHERE abs(overall_confidence) < 1000000",
        "orc05_enriched": """
            SELECT v.record_id, r.ryd_rating, coalesce(CASE WHEN v.parse_confidence BETWEEN 0 AND 1 THEN v.parse_confidence END, r.ryd_confidence, 0e0) AS confidence FROM {videos} v LEFT JOIN (
              SELECT video_id, max(ryd_rating) AS ryd_rating, max(ryd_confidence) AS ryd_confidence FROM {ryd_data} WHERE video_id IS NOT NULL GROUP BY video_id) r ON v.video_id = r.video_id""",
        "orc08_channel_counters": "SELECT channel_id, count(*) AS total_videos, max(scraped_at) AS last_updated, count(*) FILTER (WHERE artist <> '' AND song_title <> '') AS successes FROM {videos} WHERE channel_id IS NOT NULL GROUP BY channel_id",
        "orc10_knowledge": "SELECT lower(artist) AS entity, count(*) AS frequency, max(scraped_at) AS last_seen FROM {videos} WHERE artist <> '' GROUP BY 1",
        "orc11_known_names": "SELECT lower(artist) AS name, 'artist' AS kind FROM {videos} WHERE artist <> '' AND song_title <> '' AND parse_confidence > 0.8 AND parse_confidence <= 1 UNION SELECT lower(song_title), 'song' FROM {videos} WHERE artist <> '' AND song_title <> '' AND parse_confidence > 0.8 AND parse_confidence <= 1",
        "orc14_cache_kept": "SELECT doc_id FROM {documents} WHERE created_at >= TIMESTAMP '2025-01-01 00:00:00'",
        "orc16_name_statistics": "SELECT length(artist) AS name_length, count(*) AS n, count(DISTINCT artist) AS names FROM {videos} WHERE artist IS NOT NULL GROUP BY 1",
        "orc13_channel_trust": "SELECT channel_id, n >= 10 AND success >= 0.8 AS trusted FROM (SELECT channel_id, count(*) AS n, avg(CASE WHEN artist <> '' AND song_title <> '' THEN 1e0 ELSE 0e0 END) AS success FROM {videos} WHERE channel_id IS NOT NULL GROUP BY channel_id) c",
        "src02_normal_hits": "SELECT record_id, 'https://vids.example/watch?v=' || video_id AS url, coalesce(title, '') AS title, coalesce(channel_name, '') AS channel, coalesce(view_count, 0) AS view_count FROM {videos} WHERE video_id <> ''",
        "src04_channel_drops": "SELECT channel_id, count(*) AS listed, count(*) FILTER (WHERE video_id IS NULL) AS without_id, count(*) FILTER (WHERE duration_seconds IS NULL OR duration_seconds NOT BETWEEN 15 AND 1500) AS odd_duration, count(*) FILTER (WHERE upload_date IS NULL) AS without_date FROM {videos} WHERE channel_id IS NOT NULL GROUP BY channel_id",
        "src09_latest_votes": "SELECT video_id, estimated_dislikes, ryd_likes FROM (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY fetched_at DESC, estimated_dislikes, ryd_likes) AS rn FROM {ryd_data} WHERE video_id IS NOT NULL) x WHERE rn = 1",
        "ext_set_difference": "SELECT video_id FROM {discogs_data} WHERE video_id IS NOT NULL EXCEPT SELECT video_id FROM {videos} WHERE video_id IS NOT NULL",
        "ext_intersection": "SELECT video_id FROM {video_features} INTERSECT SELECT video_id FROM {ryd_data}",
        "ext_order_priorities": "SELECT o_orderpriority, count(*) AS n FROM {orders} WHERE EXISTS (SELECT 1 FROM {lineitem} WHERE l_orderkey = o_orderkey AND l_quantity > 45) GROUP BY o_orderpriority",
        "ext_nation_revenue": "SELECT n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM {lineitem} JOIN {supplier} ON l_suppkey = s_suppkey JOIN {nation} ON s_nationkey = n_nationkey GROUP BY n_name",
    },
)
