"""Queries of the checks of queries, names and matches, and of small conversions (FLT8 to FLT21, PAR6 to PAR9, SCR14 to SCR20, PRJ, NUM, MAP)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chorale.functions import evidence as E
from chorale.functions import strings as T
from chorale.functions import words as W
from chorale.operators import filters as L
from chorale.plans.scores import _any
from chorale.plans.shared import Query, register
from chorale.plans.similar import _ascii
from chorale.plans.texts import _SPACE, _WORD, _title_case, chained, q, re2
from chorale.sources.tables import table

QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def _add(name: str, source: str, columns: dict, sql: str, where: str | None = None) -> None:
    def run(spark: SparkSession, d: str) -> DataFrame:
        df = table(spark, d, source)
        df = df.where(where) if where else df
        return df.select("record_id", *[f().alias(c) for c, f in columns.items()])

    run.__doc__ = name
    QUERIES[name] = run
    ORACLE[name] = f"SELECT record_id, {sql} FROM {source}" + (f" WHERE {where}" if where else "")


_w = lambda x: f"[w FOR w IN regexp_split_to_array(lower({x}), '[{_SPACE}]+') IF w <> '']"
_list = lambda words: "(" + ", ".join(map(q, words)) + ")"
_re = lambda p: re2(p.replace(r"\b\w{1,2}", r"(?:^|[^\w])\w{1,2}").replace(r"\w{1,2}\b", r"\w{1,2}(?:$|[^\w])"))
_runs = " AND ".join(f"NOT regexp_matches(lower(title), {q(re2(p))})" for p in E.SHORT_RUNS)
_add("flt10_valid_query", "videos", {"ok": lambda: E.valid_query(T.plain_ascii("title"))}, f"(SELECT length(trim(t, ' ')) >= 3 AND len([x FOR x IN w IF x IN {_list(E.NOISE)}]) <= len(w) * 0.6 AND len([x FOR x IN w IF length(x) <= 2]) <= len(w) * 0.5 AND NOT {_any('lower(t)', E.FRAGMENTS)} AND len([x FOR x IN w IF length(x) >= 3]) >= 2 AND " + " AND ".join(f"NOT regexp_matches(lower(t), {q(p)})" for p in E.SHORT_RUNS) + f" FROM (SELECT t, {_w('t')} AS w FROM (SELECT {_ascii('title')} AS t))) AS ok", where="title IS NOT NULL")
_add("flt11_worth_comparing", "videos", {"ok": lambda: E.worth_comparing(F.col("artist"), F.col("title"))}, f"(SELECT contains(lower(title), lower(artist)) OR len(list_intersect(a, b)) > 0 OR len(a) <= 1 FROM (SELECT [x FOR x IN list_distinct({_w('artist')}) IF x NOT IN {_list(E.COMMON)}] AS a, [x FOR x IN list_distinct({_w('title')}) IF x NOT IN {_list(E.COMMON)}] AS b)) AS ok", where="artist IS NOT NULL AND title IS NOT NULL")
_word1 = f"len(regexp_extract_all(artist, '[{_WORD}]'))"
_add("flt08_plain_names", "videos", {"artist_ok": lambda: L.valid_artist("artist"), "song_ok": lambda: L.valid_song("song_title")}, f"length(trim(artist, ' ')) BETWEEN 1 AND 100 AND lower(trim(artist, ' ')) NOT IN {_list(W.NO_ARTIST)} AND {_word1} >= length(artist) * 0.2 AS artist_ok, length(trim(song_title, ' ')) BETWEEN 2 AND 200 AND lower(trim(song_title, ' ')) NOT IN {_list(W.NO_SONG)} AS song_ok")
_signs = lambda x, ps: "(" + " + ".join(f"regexp_matches({x}, {q(p)}, 'i')::INT" for p in ps) + ")"
_a, _s = "a", "s"
_add("par06_switched", "videos", {"switched": lambda: E.fields_switched(T.plain_ascii("artist"), T.plain_ascii("song_title"))}, f"(SELECT {_signs('s', E.ARTIST_SIGNS)} + {_signs('a', E.SONG_SIGNS)} > {_signs('a', E.ARTIST_SIGNS)} + {_signs('s', E.SONG_SIGNS)} + 1 FROM (SELECT {_ascii('artist')} AS a, {_ascii('song_title')} AS s)) AS switched", where="artist <> '' AND song_title <> ''")
_parts = rf"flatten([regexp_split_to_array(regexp_replace(x, '[^{_WORD}{_SPACE},&]', '', 'g'), '\s*[,&]\s*|\s+and\s+') FOR x IN regexp_extract_all(lower(t), {q(E.GUESTS)}, 1)])"
_add("str07_guests", "videos", {"guests": lambda: F.array_join(E.guests(T.plain_ascii("title")), ", ")}, f"(SELECT array_to_string(list_sort(list_distinct([x FOR x IN [{_title_case('trim(y, chr(32))')} FOR y IN {_parts}] IF length(x) > 2])), ', ') FROM (SELECT {_ascii('title')} AS t)) AS guests", where="title IS NOT NULL")
_add("str15_for_matching", "videos", {"cleaned": lambda: E.for_matching(F.col("title"))}, chained("title", [(p, r.replace("$1", "\\1").replace("$2", "\\2")) for p, r in E.MATCHING]) + " AS cleaned")
_add("num01_whole_numbers", "discogs_data", {"barcode": lambda: F.coalesce(F.col("barcode").try_cast("long"), F.lit(0)), "year": lambda: F.coalesce(F.col("year").cast("long"), F.lit(0)), "share": lambda: F.round(F.try_divide(F.col("community_want").cast("double"), F.col("community_have") + F.col("community_want")), 6)}, "coalesce(try_cast(barcode AS BIGINT), 0) AS barcode, coalesce(year, 0)::BIGINT AS year, round(community_want::DOUBLE / nullif(community_have + community_want, 0), 6) AS share")
_add("num07_clamped", "videos", {"confidence": lambda: F.when(F.col("parse_confidence").isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), "parse_confidence")))}, "CASE WHEN parse_confidence IS NOT NULL THEN greatest(0.0::DOUBLE, least(1.0::DOUBLE, parse_confidence)) END AS confidence")
_add("map01_defaults", "videos", {"genre": lambda: F.coalesce(F.element_at(F.create_map(F.lit("g"), F.col("genre")), "g"), F.lit("none")), "missing": lambda: F.coalesce(F.try_element_at(F.create_map(F.lit("g"), F.col("genre")), F.lit("h")), F.lit("none"))}, "coalesce(genre, 'none') AS genre, 'none' AS missing")
_add("prj01_normal_hit", "videos", {"video_id": lambda: F.coalesce("video_id", F.lit("")), "title": lambda: F.coalesce("title", F.lit("")), "channel": lambda: F.coalesce("channel_name", F.lit("")), "views": lambda: F.coalesce("view_count", F.lit(0)), "method": lambda: F.lit("api")}, "coalesce(video_id, '') AS video_id, coalesce(title, '') AS title, coalesce(channel_name, '') AS channel, coalesce(view_count, 0) AS views, 'api' AS method")


def prj07_merged_maps(spark: SparkSession, d: str) -> DataFrame:
    """Metadata of a record over that of its channel: the record's own wins, the channel's fills."""
    c = table(spark, d, "channels").where("channel_id is not null").groupBy("channel_id").agg(F.max("channel_name").alias("known"))
    v = table(spark, d, "videos").join(c, "channel_id", "left")
    own = F.map_filter(F.create_map(F.lit("channel"), F.col("channel_name"), F.lit("genre"), F.col("genre")), lambda k, x: x.isNotNull() & (x != ""))
    more = F.map_filter(F.create_map(F.lit("channel"), F.col("known"), F.lit("origin"), F.lit("channels")), lambda k, x: x.isNotNull())
    merged = F.map_concat(own, F.map_filter(more, lambda k, x: ~F.map_contains_key(own, k)))
    return v.select("record_id", merged["channel"].alias("channel"), merged["genre"].alias("genre"), F.size(merged).cast("long").alias("n_keys"))


def prj11_parsing_json(spark: SparkSession, d: str) -> DataFrame:
    """What a parse left behind as JSON; null where nothing did."""
    keep = F.struct(F.col("genre"), F.col("release_year"))
    return table(spark, d, "videos").select("record_id", F.when(F.col("genre").isNotNull() | F.col("release_year").isNotNull(), F.to_json(keep)).alias("metadata"))


def jn15_artist_variants(spark: SparkSession, d: str) -> DataFrame:
    """Releases of an artist whose telling words equal those of a video's artist, other than by spelling."""
    v = table(spark, d, "videos").where("artist <> ''").select(T.plain_ascii("artist").alias("a")).distinct().withColumn("k", T.artist_key("a"))
    g = table(spark, d, "discogs_data").where("artist_name <> ''").select(T.plain_ascii("artist_name").alias("b")).distinct().withColumn("k", T.artist_key("b"))
    return v.where("k <> ''").join(g, "k").where("a <> b").select("a", "b")


def _evidence(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "videos").where("title <> ''").select("record_id", "video_id", "title", "artist", "song_title")
    g = table(spark, d, "discogs_data").where("video_id is not null and artist_name <> '' and song_title <> ''").select("video_id", F.col("record_id").alias("release_record"), "artist_name", F.col("song_title").alias("release_song"), F.coalesce(F.round(F.col("confidence") * 100), F.lit(0.0)).alias("own_score"))
    return v.join(g, "video_id")


def scr14_search_confidence(spark: SparkSession, d: str) -> DataFrame:
    """Confidence of a release found by the title of a record."""
    return _evidence(spark, d).select("record_id", "release_record", F.round(E.search_confidence(F.col("own_score"), F.col("release_song"), F.col("artist_name"), F.col("title")), 6).alias("confidence"))


def scr15_mismatch(spark: SparkSession, d: str) -> DataFrame:
    """Penalty where a release's artist resembles no place of the title."""
    return _evidence(spark, d).select("record_id", "release_record", E.mismatch_penalty(F.col("artist_name"), F.col("title")).alias("penalty"))


def scr16_title_check(spark: SparkSession, d: str) -> DataFrame:
    """Factor for a release against the title of the record."""
    return _evidence(spark, d).select("record_id", "release_record", F.round(E.title_check(F.col("artist_name"), F.col("release_song"), F.col("title")), 6).alias("factor"))


def scr20_validated(spark: SparkSession, d: str) -> DataFrame:
    """Validation of a record's own artist and song against a release."""
    e = _evidence(spark, d).where("artist <> '' and song_title <> ''")
    score, valid = E.validated(F.col("artist"), F.col("song_title"), F.col("artist_name"), F.col("release_song"), T.vowelless)
    return e.select("record_id", "release_record", F.round(score, 6).alias("score"), valid.alias("valid"))


QUERIES |= {f.__name__: f for f in (prj07_merged_maps, prj11_parsing_json, jn15_artist_variants, scr14_search_confidence, scr15_mismatch, scr16_title_check, scr20_validated)}
_key = lambda x: f"array_to_string([w FOR w IN regexp_split_to_array(regexp_replace(lower({x}), '[^{_WORD}{_SPACE}]', '', 'g'), '[{_SPACE}]+') IF w <> '' AND w NOT IN {_list(T.STOP_WORDS)}], ' ')"
ORACLE |= {
    "prj07_merged_maps": "SELECT record_id, coalesce(nullif(v.channel_name, ''), c.known) AS channel, nullif(genre, '') AS genre, 1 + (coalesce(nullif(v.channel_name, ''), c.known) IS NOT NULL)::INT + (genre <> '' AND genre IS NOT NULL)::INT AS n_keys FROM videos v LEFT JOIN (SELECT channel_id, max(channel_name) AS known FROM channels WHERE channel_id IS NOT NULL GROUP BY 1) c ON v.channel_id = c.channel_id",
    "jn15_artist_variants": f"SELECT a, b FROM (SELECT a, {_key('a')} AS k FROM (SELECT DISTINCT {_ascii('artist')} AS a FROM videos WHERE artist <> '')) x JOIN (SELECT b, {_key('b')} AS k FROM (SELECT DISTINCT {_ascii('artist_name')} AS b FROM discogs_data WHERE artist_name <> '')) y USING (k) WHERE k <> '' AND a <> b",
}

register(
    QUERIES,
    ORACLE,
    {
            "flt19_karaoke_context": "SELECT record_id FROM {videos} WHERE lower(channel_name) LIKE '%karaoke%' OR lower(channel_name) LIKE '%sing%' OR lower(channel_name) LIKE '%backing%' OR lower(channel_name) LIKE '%instrumental%' OR lower(channel_name) LIKE '%piano%'",
        "mig10_touched": "SELECT record_id, greatest(scraped_at, coalesce(deleted_at, scraped_at)) AS updated_at FROM {videos} WHERE scraped_at IS NOT NULL",
        "mig11_added_columns": "SELECT record_id, video_id, CAST(NULL AS VARCHAR(64)) AS musicbrainz_id, CAST(0 AS INT) AS web_search_performed FROM {videos}",
            "scr06_details": "SELECT record_id, title <> '' AS has_title, coalesce(length(title), 0) AS title_length, coalesce(length(description), 0) AS description_length, duration_seconds / 60.0e0 AS minutes FROM {videos}",
                "scr19_prototype": "SELECT record_id, round(least(1e0, 0.5e0 + CASE WHEN year IS NOT NULL THEN 0.1e0 ELSE 0e0 END + CASE WHEN genres IS NOT NULL THEN 0.1e0 ELSE 0e0 END + CASE WHEN styles IS NOT NULL THEN 0.1e0 ELSE 0e0 END + CASE WHEN label IS NOT NULL THEN 0.1e0 ELSE 0e0 END + CASE WHEN master_id IS NOT NULL THEN 0.1e0 ELSE 0e0 END), 6) AS confidence FROM {discogs_data}",
        "par08_description_boost": "SELECT record_id, round(CASE WHEN parse_confidence BETWEEN 0 AND 1 THEN parse_confidence END * CASE WHEN instr(lower(description), lower(artist)) > 0 THEN 1.1e0 ELSE 1e0 END * CASE WHEN instr(lower(description), lower(song_title)) > 0 THEN 1.1e0 ELSE 1e0 END, 6) AS boosted FROM {videos} WHERE artist <> '' AND song_title <> ''",
        "par18_enriched": """
            SELECT v.record_id, coalesce(nullif(v.genre, ''), g.styles) AS genre, CASE WHEN nullif(v.genre, '') IS NULL AND g.styles IS NOT NULL THEN round(least(0.95e0, 1.1e0 * v.parse_confidence), 6) ELSE v.parse_confidence END AS confidence FROM (SELECT * FROM {videos} WHERE parse_confidence BETWEEN 0 AND 1) v LEFT JOIN (
              SELECT video_id, styles FROM (SELECT video_id, styles, row_number() OVER (PARTITION BY video_id ORDER BY confidence DESC NULLS LAST, record_id) AS rn FROM {discogs_data} WHERE video_id IS NOT NULL AND styles IS NOT NULL) x WHERE rn = 1) g ON v.video_id = g.video_id""",
        "par20_kept_artist": "SELECT v.record_id, CASE WHEN length(v.artist) - length(replace(v.artist, '&', '')) > length(g.artist_name) - length(replace(g.artist_name, '&', '')) THEN v.artist ELSE g.artist_name END AS artist, g.record_id AS release_record FROM {videos} v JOIN {discogs_data} g ON v.video_id = g.video_id WHERE v.artist <> '' AND g.artist_name <> ''",
        },
)

ORACLE["prj11_parsing_json"] = "SELECT record_id, CASE WHEN genre IS NOT NULL OR release_year IS NOT NULL THEN '{' || concat_ws(',', '\"genre\":' || to_json(genre), '\"release_year\":' || release_year::VARCHAR) || '}' END AS metadata FROM videos"
