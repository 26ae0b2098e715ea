"""Queries of text, date, JSON and array functions over videos, releases and documents (STR, DT, JS, ARR, SRC)."""

from __future__ import annotations


from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chorale.functions import strings as T
from chorale.plans.shared import Query
from chorale.sources.tables import table

QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}

_SPACE = r"\s\pZ\x{85}\x{1c}-\x{1f}\v"
_WORD = r"\pL\pM\p{Nd}\p{Pc}\p{Nl}\x{200c}\x{200d}"


def re2(pattern: str) -> str:
    """A pattern with Unicode classes for an engine whose own classes know ASCII only."""
    out, inside, i, begun = [], False, 0, 0
    while i < len(pattern):
        two = pattern[i : i + 2]
        if two in (r"\s", r"\w"):
            cls = _SPACE if two == r"\s" else _WORD
            out.append(cls if inside else f"[{cls}]")
            i += 2
            continue
        if two[0] == "\\":
            out.append(two)
            i += 2
            continue
        if pattern[i] == "[" and not inside:
            inside, begun = True, i + (2 if pattern[i + 1 : i + 2] == "^" else 1)
        elif pattern[i] == "]" and inside and i > begun:
            inside = False
        out.append(pattern[i])
        i += 1
    return "".join(out)


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def sub(x: str, pattern: str, replacement: str, flags: str = "gi") -> str:
    return f"regexp_replace({x}, {q(re2(pattern))}, {q(replacement)}, '{flags}')"


def chained(x: str, rules: T.Rules) -> str:
    for p, r in rules:
        x = sub(x, p, r)
    return x


def _title_case(x: str) -> str:
    return rf"array_to_string(list_transform(regexp_extract_all({x}, '\pL+|\PL+'), lambda w: upper(w[1]) || lower(w[2:])), '')"


def _extracted(x: str) -> str:
    e = chained(x, T.EXTRACTED)
    return rf"(SELECT CASE WHEN regexp_matches(z, '[!?.]$') THEN z ELSE {sub(sub('z', r'[^\w\s]+$', ''), r'\s+$', '')} END FROM (SELECT CASE WHEN length(e) > 3 AND e = lower(e) AND regexp_matches(e, '\pL') THEN {_title_case('e')} ELSE e END AS z FROM (SELECT {e} AS e)))"


_trimmed = lambda x: sub(x, r"^\s+|\s+$", "")


def _add(name: str, source: str, key: str, columns: dict, sql: str, where: str | None = None, doc: str = "") -> None:
    """columns: name -> function giving the expression; sql: what is selected beside the key."""

    def run(spark: SparkSession, d: str) -> DataFrame:
        df = table(spark, d, source)
        df = df.where(where) if where else df
        return df.select(key, *[f().alias(c) for c, f in columns.items()])

    run.__doc__ = doc or name
    QUERIES[name] = run
    ORACLE[name] = f"SELECT {key}, {sql} FROM {source}" + (f" WHERE {where}" if where else "")


_V = ("videos", "record_id")
_marked = f"regexp_replace(translate({{}}, {q(T.MARKED)}, {q(T.PLAIN)}), '[\\x{{0300}}-\\x{{036f}}]', '', 'g')".replace("{{", "{").replace("}}", "}")
_add("str01_normal_name", *_V, {"name": lambda: T.normal_name("artist")}, _trimmed(chained(_marked.replace("{}", "lower(" + _trimmed("artist") + ")", 1), T.NORMAL)) + " AS name")
_add("str02_clean_title", *_V, {"cleaned": lambda: T.chained("title", T.CLEAN_TITLE)}, chained("title", T.CLEAN_TITLE) + " AS cleaned")
_add("str03_extracted", *_V, {"cleaned": lambda: T.extracted("song_title")}, _extracted("song_title") + " AS cleaned")
_add("str04_extracted_plain", *_V, {"cleaned": lambda: T.chained("title", T.EXTRACTED_PLAIN)}, chained("title", T.EXTRACTED_PLAIN) + " AS cleaned")
_add("str05_without_repetition", *_V, {"cleaned": lambda: T.without_repetition("title")}, r"""CASE WHEN NOT contains(title, ' - ') THEN title
 WHEN len(string_split(title, ' - ')) = 2 AND lower(trim(string_split(title, ' - ')[1])) = lower(trim(string_split(title, ' - ')[2])) THEN trim(string_split(title, ' - ')[1])
 ELSE (SELECT CASE WHEN len(k) < len(w) THEN array_to_string(k, ' ') ELSE title END FROM (SELECT w, [x FOR x, i IN w IF i = 1 OR lower(x) <> lower(w[i - 1])] AS k FROM (SELECT [x FOR x IN regexp_split_to_array(title, '[\s\pZ\x{85}\x{1c}-\x{1f}\v]+') IF x <> ''] AS w))) END AS cleaned""")
_add("str06_script", *_V, {"script": lambda: T.script("title")}, "CASE WHEN title IS NULL THEN 'english' " + " ".join(f"WHEN regexp_matches(title, {q(p)}) THEN '{n}'" for n, p in T.SCRIPTS) + " ELSE 'english' END AS script")
_add("str09_query", *_V, {"query": lambda: F.trim(T.chained(F.lower("title"), T.QUERY))}, "trim(" + "regexp_replace(" * 0 + chained("lower(title)", T.QUERY) + ") AS query")
_add("str11_artist_key", *_V, {"key": lambda: T.artist_key("artist")}, f"array_to_string([w FOR w IN regexp_split_to_array({sub('lower(artist)', r'[^\w\s]', '')}, {q(re2(r'\s+'))}) IF w <> '' AND w NOT IN ({', '.join(map(q, T.STOP_WORDS))})], ' ') AS key")
_add("str12_release_query", *_V, {"query": lambda: F.trim(T.chained("title", T.RELEASE_QUERY))}, "trim(" + chained("title", T.RELEASE_QUERY) + ") AS query")
_add("str16_leading_cut", *_V, {"cleaned": lambda: T.chained("title", T.LEADING)}, chained("title", T.LEADING) + " AS cleaned")
_add("str17_cache_query", *_V, {"query": lambda: T.chained(F.lower("title"), T.CACHE_QUERY)}, chained("lower(title)", T.CACHE_QUERY) + " AS query")
_add("str18_song_only", *_V, {"song": lambda: T.song_only("title")}, f"CASE WHEN instr(title, ' - ') > 0 THEN {_trimmed("substring(title, instr(title, ' - ') + 3)")} WHEN instr(lower(title), ' by ') > 0 THEN {_trimmed("substring(title, 1, instr(lower(title), ' by ') - 1)")} END AS song")
_add("str20_structure", *_V, {"structure": lambda: T.structure("title")}, "CASE " + " ".join(f"WHEN regexp_matches(title, {q(re2(p))}, 'i') THEN '{n}'" for n, p in T.STRUCTURES) + " END AS structure")
_add("str22_korean", *_V, {"korean": lambda: F.col("title").rlike("[가-힯ᄀ-ᇿ]")}, "regexp_matches(title, '[가-힯ᄀ-ᇿ]') AS korean")
_dup = lambda x: "CASE " * 0 + f"array_to_string([c FOR c, i IN string_split({x}, '') IF i = 1 OR c <> string_split({x}, '')[i - 1]], '')"
_az = "regexp_replace(lower(artist), '[^a-z]', '', 'g')"
_add("str25_short_sound", *_V, {"code": lambda: T.short_sound("artist")}, f"upper(left(left({_dup(_az)}, 1) || regexp_replace(substring({_dup(_az)}, 2), '[aeiou]', '', 'g'), 4)) AS code")
_codes = "translate(upper(regexp_replace(artist, '[^A-Za-z]', '', 'g')), 'BFPVCGJKQSXZDTLMNRAEIOUYHW', '11112222222233455600000000')"
_add("str25_sound", *_V, {"code": lambda: T.sound("artist")}, f"CASE WHEN regexp_replace(artist, '[^A-Za-z]', '', 'g') = '' THEN '' ELSE rpad(left(upper(left(regexp_replace(artist, '[^A-Za-z]', '', 'g'), 1)) || regexp_replace(substring({_dup(_codes)}, 2), '0', '', 'g'), 4), 4, '0') END AS code")
_add("str26_vowelless", *_V, {"code": lambda: T.vowelless("artist")}, f"left({_az}, 1) || regexp_replace(substring({_az}, 2), '[aeiou]', '', 'g') AS code")
_add("snk08_sanitized", *_V, {"title": lambda: T.sanitized("title", 60), "description": lambda: T.sanitized("description", 2000)}, ", ".join(rf"CASE WHEN length({sub(c, r'\s+', '')}) > 0 THEN regexp_replace(CASE WHEN length({c}) > {n} THEN left({c}, {n - 3}) || '...' ELSE {c} END, '[\x{{00}}-\x{{08}}\x{{0B}}\x{{0C}}\x{{0E}}-\x{{1F}}\x{{7F}}-\x{{9F}}]', '', 'g') END AS {c}" for c, n in (("title", 60), ("description", 2000))))
_add("snk07_cache_key", *_V, {"key": lambda: F.substring(F.sha2(F.concat_ws("|", F.lit("search"), F.coalesce(F.lower("title"), F.lit("")), F.coalesce("channel_id", F.lit(""))), 256), 1, 32)}, "substring(sha256('search|' || lower(coalesce(title, '')) || '|' || coalesce(channel_id, '')), 1, 32) AS key")
_add("dt02_clock", *_V, {"clock": lambda: T.clock("duration_seconds")}, "CASE WHEN duration_seconds < 0 THEN '00:00' WHEN duration_seconds >= 3600 THEN lpad((duration_seconds // 3600)::VARCHAR, 2, '0') || ':' || lpad((duration_seconds % 3600 // 60)::VARCHAR, 2, '0') || ':' || lpad((duration_seconds % 60)::VARCHAR, 2, '0') WHEN duration_seconds >= 0 THEN lpad((duration_seconds // 60)::VARCHAR, 2, '0') || ':' || lpad((duration_seconds % 60)::VARCHAR, 2, '0') ELSE ':' END AS clock", where="duration_seconds IS NOT NULL AND duration_seconds < 360000")
_add("dt01_seconds_round_trip", *_V, {"seconds": lambda: T.seconds_of(T.clock("duration_seconds")), "iso": lambda: T.seconds_of(F.concat(F.lit("PT"), F.floor(F.col("duration_seconds") / 60).cast("string"), F.lit("M"), (F.col("duration_seconds") % 60).cast("string"), F.lit("S")))}, "duration_seconds AS seconds, duration_seconds AS iso", where="duration_seconds BETWEEN 0 AND 359999")
_years = "[" + ", ".join(f"regexp_extract_all(t, {q('(?i)' + re2(p))}, 1)" for p in T.YEARS) + "]"
_add("dt05_release_year", *_V, {"year": lambda: T.release_year_in("title", "description", 2025)}, rf"(SELECT list_min([y::INT FOR y IN flatten({_years}) IF y::INT BETWEEN 1900 AND 2024]) FROM (SELECT regexp_replace(regexp_replace(coalesce(title, '') || ' ' || coalesce(description, ''), '\b\d{{4}}''s[\s]+\w+[\s]+[Pp]laylist', '', 'g'), '\b\d{{4}}''s\b', '', 'g') AS t)) AS year")
_add("js01_styles", "discogs_data", "record_id", {"n_styles": lambda: F.size(F.from_json("styles", "array<string>")), "first_style": lambda: F.get(F.from_json("styles", "array<string>"), F.lit(0)), "styles_text": lambda: F.array_join(F.array_sort(F.from_json("styles", "array<string>")), ", ")}, "len(json_extract_string(styles, '$[*]'))::INT AS n_styles, json_extract_string(styles, '$[0]') AS first_style, array_to_string(list_sort(json_extract_string(styles, '$[*]')), ', ') AS styles_text", where="styles IS NOT NULL")
_add("js02_event_props", "events", "event_id", {"k": lambda: F.get_json_object("props", "$.k").cast("long")}, "CAST(json_extract(props, '$.k') AS BIGINT) AS k")
_add("arr01_codes", "discogs_data", "record_id", {"codes": lambda: F.array_join(F.array_compact(F.array("barcode", "catno")), ", ")}, "array_to_string([x FOR x IN [barcode, catno] IF x IS NOT NULL], ', ') AS codes")
_add("js04_split_title", *_V, {"left_part": lambda: T.stripped(F.substring_index("title", " - ", 1)), "right_part": lambda: F.when(F.instr("title", " - ") > 0, T.stripped(F.expr("substring(title, instr(title, ' - ') + 3)")))}, f"{_trimmed("string_split(title, ' - ')[1]")} AS left_part, CASE WHEN instr(title, ' - ') > 0 THEN {_trimmed("substring(title, instr(title, ' - ') + 3)")} END AS right_part")
_add("src08_enhanced_query", *_V, {"query": lambda: F.when(F.lower("title").rlike("karaoke|backing track|instrumental|sing along"), F.col("title")).otherwise(F.concat("title", F.lit(" karaoke")))}, "CASE WHEN regexp_matches(lower(title), 'karaoke|backing track|instrumental|sing along') THEN title ELSE title || ' karaoke' END AS query", where="title IS NOT NULL")


def src06_links(spark: SparkSession, d: str) -> DataFrame:
    """Video ids linked in documents, one row each with its place (scan of loose text or mark-up)."""
    ids = F.regexp_extract_all("text", F.lit(r"watch\?v=([A-Za-z0-9_-]{11})"), F.lit(1))
    return table(spark, d, "documents").select("doc_id", F.posexplode(ids).alias("pos", "linked_id")).select("doc_id", (F.col("pos") + 1).cast("long").alias("pos"), "linked_id")


def arr02_genre_union(spark: SparkSession, d: str) -> DataFrame:
    """Styles of all releases of a video, united and sorted."""
    g = table(spark, d, "discogs_data").where("video_id is not null").select("video_id", F.explode(F.from_json("styles", "array<string>")).alias("style"))
    return g.groupBy("video_id").agg(F.array_join(F.array_sort(F.collect_set("style")), ", ").alias("styles"))


def agg29_style_vote(spark: SparkSession, d: str) -> DataFrame:
    """The style most of a video's releases have, ties by name."""
    g = table(spark, d, "discogs_data").where("video_id is not null").select("video_id", "record_id", F.explode(F.from_json("styles", "array<string>")).alias("style")).distinct()
    votes = g.groupBy("video_id", "style").agg(F.count(F.lit(1)).alias("n"))
    return votes.groupBy("video_id").agg(F.max_by("style", F.struct("n", "style")).alias("style"), F.max("n").alias("votes"))


def agg30_earliest_release(spark: SparkSession, d: str) -> DataFrame:
    """Earliest plausible year and first three labels of a video's releases."""
    g = table(spark, d, "discogs_data").where("video_id is not null")
    return g.groupBy("video_id").agg(F.min(F.when(F.col("year").between(1900, 2025), F.col("year"))).alias("first_year"), F.array_join(F.slice(F.array_sort(F.collect_set("label")), 1, 3), ", ").alias("labels"))


def agg26_title_structures(spark: SparkSession, d: str) -> DataFrame:
    """Structures that at least three titles of a channel have."""
    v = table(spark, d, "videos").where("channel_id is not null").withColumn("structure", T.structure("title")).where("structure is not null")
    return v.groupBy("channel_id", "structure").agg(F.count(F.lit(1)).alias("n")).where("n >= 3")


QUERIES |= {"src06_links": src06_links, "arr02_genre_union": arr02_genre_union, "agg29_style_vote": agg29_style_vote, "agg30_earliest_release": agg30_earliest_release, "agg26_title_structures": agg26_title_structures}
_struct_sql = "CASE " + " ".join(f"WHEN regexp_matches(title, {q(re2(p))}, 'i') THEN '{n}'" for n, p in T.STRUCTURES) + " END"
ORACLE |= {
    "src06_links": r"SELECT doc_id, i AS pos, l[i] AS linked_id FROM (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS i FROM (SELECT doc_id, regexp_extract_all(text, 'watch\?v=([A-Za-z0-9_-]{11})', 1) AS l FROM documents))",
    "arr02_genre_union": "SELECT video_id, array_to_string(list_sort(list(DISTINCT style)), ', ') AS styles FROM (SELECT video_id, unnest(json_extract_string(styles, '$[*]')) AS style FROM discogs_data WHERE video_id IS NOT NULL AND styles IS NOT NULL) GROUP BY 1",
    "agg29_style_vote": "SELECT video_id, max(struct_pack(n := n, style := style)).style AS style, max(n) AS votes FROM (SELECT video_id, style, count(*) AS n FROM (SELECT DISTINCT video_id, record_id, unnest(json_extract_string(styles, '$[*]')) AS style FROM discogs_data WHERE video_id IS NOT NULL AND styles IS NOT NULL) GROUP BY 1, 2) GROUP BY 1",
    "agg30_earliest_release": "SELECT video_id, min(year) FILTER (WHERE year BETWEEN 1900 AND 2025) AS first_year, coalesce(array_to_string(list_sort(list(DISTINCT label) FILTER (WHERE label IS NOT NULL))[1:3], ', '), '') AS labels FROM discogs_data WHERE video_id IS NOT NULL GROUP BY 1",
    "agg26_title_structures": f"SELECT channel_id, structure, count(*) AS n FROM (SELECT channel_id, {_struct_sql} AS structure FROM videos WHERE channel_id IS NOT NULL) WHERE structure IS NOT NULL GROUP BY 1, 2 HAVING count(*) >= 3",
}
