"""Queries of title parsing, learned patterns and the staged ladder (PAR, AGG26, STR7-STR14)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chorale.functions import strings as T
from chorale.functions import words as W
from chorale.functions.title_rules import BY_CHANNEL, CORE, SPLITS, Rule
from chorale.operators.parsing import ladder, parsed
from chorale.plans.shared import Query
from chorale.plans.stage import staged
from chorale.plans.texts import _extracted, _struct_sql, _title_case, q, re2
from chorale.sources.tables import spread, table

QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def _sql_group(rules: list[Rule], which: str) -> str:
    out = "CASE rule"
    for name, pattern, artist, song, _ in rules:
        if name in SPLITS:
            g = 1 if which == "artist" else 2
            cases = " ".join(f"WHEN regexp_matches(x, {q(re2(p))}, 'i') THEN (SELECT {_title_case('y')} FROM (SELECT regexp_extract(x, {q(re2(p))}, {g}, 'i') AS y))" for p in SPLITS[name])
            one = f"regexp_extract(title, {q(re2(pattern))}, 1, 'i')"
            out += f" WHEN '{name}' THEN (SELECT CASE {cases} END FROM (SELECT {_extracted(one)} AS x))"
            continue
        parts = [f"regexp_extract(title, {q(re2(pattern))}, {g}, 'i')" for g in (artist if which == "artist" else (song,) if song else ())]
        out += f" WHEN '{name}' THEN {' || {} || '.format(q(' ')).join(parts) if parts else 'NULL'}"
    return out + " END"


_words_in = "len(regexp_extract_all(artist, '[\\pL\\pM\\p{Nd}\\p{Pc}\\p{Nl}\\x{200C}\\x{200D}]'))"
_ok_plain = f"length(trim(artist, ' ')) BETWEEN 1 AND 100 AND lower(trim(artist, ' ')) NOT IN ({', '.join(map(q, W.NO_ARTIST))}) AND {_words_in} >= length(artist) * 0.2"
_ok_artist = f"length(trim(artist, ' ')) >= 1 AND length(artist) <= 100 AND lower(trim(artist, ' ')) NOT IN ({', '.join(q(w) for some in W.NO_NAME for w in some)}) AND {_words_in} >= length(artist) * 0.3"
_ok_song = f"length(trim(song, ' ')) BETWEEN 2 AND 200 AND lower(trim(song, ' ')) NOT IN ({', '.join(map(q, W.NO_SONG))})"


def _parsed_sql(rules: list[Rule], source: str = "videos", clean=_extracted, artist_ok: str = _ok_artist, partial: float = 0.7) -> str:
    first = "CASE " + " ".join(f"WHEN regexp_matches(title, {q(re2(p))}, 'i') THEN '{n}'" for n, p, *_ in rules) + " END"
    conf = "CASE rule " + " ".join(f"WHEN '{n}' THEN {c}" for n, *_, c in rules) + " ELSE 0 END"
    return f"""SELECT record_id, channel_name, rule, artist, song, round({conf} * CASE WHEN artist IS NOT NULL AND song IS NOT NULL THEN 1.0 WHEN artist IS NOT NULL OR song IS NOT NULL THEN {partial} ELSE 0 END, 4)::DOUBLE AS confidence FROM (
SELECT record_id, channel_name, rule, CASE WHEN {artist_ok} THEN artist END AS artist, CASE WHEN {_ok_song} THEN song END AS song FROM (
SELECT record_id, channel_name, rule, {clean('a0')} AS artist, {clean('s0')} AS song FROM (
SELECT record_id, channel_name, rule, {_sql_group(rules, 'artist')} AS a0, {_sql_group(rules, 'song')} AS s0 FROM (SELECT record_id, channel_name, title, {first} AS rule FROM {source}))))"""


def par02_core_rules(spark: SparkSession, d: str) -> DataFrame:
    """Artist and song of every title by the first core rule that fits."""
    return parsed(spread(table(spark, d, "videos").select("record_id", "title")), CORE).drop("title")


def par01_ladder(spark: SparkSession, d: str) -> DataFrame:
    """Channel rules, then rules of the script, then core rules."""
    return ladder(spread(table(spark, d, "videos").select("record_id", "title", "channel_name"))).drop("title", "channel_name")


def agg23_rule_statistics(spark: SparkSession, d: str) -> DataFrame:
    """How often each rule fits, and how often both parts come out."""
    p = par02_core_rules(spark, d)
    return p.groupBy("rule").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("artist").isNotNull() & F.col("song").isNotNull()).alias("both"), F.round(F.avg("confidence"), 4).alias("avg_confidence"))


_is_kind = [f"regexp_matches(lower(coalesce(channel_name, '')), {q(p)})" for _, p, _ in BY_CHANNEL]
_channel_case = [(" AND ".join([_is_kind[k], *(f"NOT {c}" for c in _is_kind[:k])]), rules) for k, (_, _, rules) in enumerate(BY_CHANNEL)]
_join = " ".join(f"LEFT JOIN ({_parsed_sql(r)}) c{k} ON v.record_id = c{k}.record_id" for k, (_, r) in enumerate(_channel_case))
_pick = lambda c: "CASE " + " ".join(f"WHEN {cond.replace('channel_name', 'v.channel_name')} AND c{k}.confidence > 0.7 THEN c{k}.{c}" for k, (cond, _) in enumerate(_channel_case)) + f" ELSE v.{c} END AS parsed_{c}"
QUERIES |= {"par02_core_rules": par02_core_rules, "par01_ladder": par01_ladder, "agg23_rule_statistics": agg23_rule_statistics}
ORACLE |= {
    "par02_core_rules": f"SELECT record_id, rule, artist, song, confidence FROM ({_parsed_sql(CORE)})",
    "par01_ladder": f"SELECT v.record_id, {', '.join(map(_pick, ('rule', 'artist', 'song', 'confidence')))} FROM ({_parsed_sql(CORE)}) v {_join}",
    "agg23_rule_statistics": f"SELECT rule, count(*) AS n, count(*) FILTER (WHERE artist IS NOT NULL AND song IS NOT NULL) AS both, round(avg(confidence), 4) AS avg_confidence FROM ({_parsed_sql(CORE)}) GROUP BY 1",
}


def par17_staged_ladder(spark: SparkSession, d: str) -> DataFrame:
    """The stored parse if sure (0.75), else the rules' (0.65), else the best release (0.6): each stage joins only what is left."""
    v = spread(table(spark, d, "videos").select("record_id", "video_id", "title", "artist", "song_title", "parse_confidence"))
    sure = (F.col("parse_confidence") >= 0.75) & (F.col("parse_confidence") <= 1) & (F.col("artist") != "") & (F.col("song_title") != "")
    sure = F.coalesce(sure, F.lit(False))
    done = v.where(sure).select("record_id", F.lit("stored").alias("stage"), F.col("artist").alias("found_artist"), F.col("song_title").alias("found_song"))
    left = staged(parsed(v.where(~sure).select("record_id", "video_id", "title"), CORE), "parsed")  # read twice below
    by_rule = left.where("confidence >= 0.65").select("record_id", F.lit("rules").alias("stage"), F.col("artist").alias("found_artist"), F.col("song").alias("found_song"))
    g = table(spark, d, "discogs_data").where("video_id is not null and confidence between 0.6 and 1")
    w = Window.partitionBy("video_id").orderBy(F.desc("confidence"), "record_id")
    best = g.withColumn("rn", F.row_number().over(w)).where("rn = 1").select("video_id", F.col("artist_name").alias("ga"), F.col("song_title").alias("gs"))
    last = left.where("confidence < 0.65").join(best, "video_id", "left").select("record_id", F.when(F.col("gs").isNotNull(), "release").otherwise("none").alias("stage"), F.col("ga").alias("found_artist"), F.col("gs").alias("found_song"))
    return done.unionByName(by_rule).unionByName(last)


_SURE = "coalesce(parse_confidence >= 0.75 AND parse_confidence <= 1 AND artist <> '' AND song_title <> '', false)"
QUERIES["par17_staged_ladder"] = par17_staged_ladder
ORACLE["par17_staged_ladder"] = f"""WITH p AS ({_parsed_sql(CORE)}), g AS (SELECT video_id, artist_name AS ga, song_title AS gs FROM (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY confidence DESC, record_id) AS rn FROM discogs_data WHERE video_id IS NOT NULL AND confidence BETWEEN 0.6 AND 1) WHERE rn = 1)
SELECT v.record_id, CASE WHEN {_SURE.replace('artist', 'v.artist')} THEN 'stored' WHEN p.confidence >= 0.65 THEN 'rules' WHEN gs IS NOT NULL THEN 'release' ELSE 'none' END AS stage,
 CASE WHEN {_SURE.replace('artist', 'v.artist')} THEN v.artist WHEN p.confidence >= 0.65 THEN p.artist ELSE ga END AS found_artist, CASE WHEN {_SURE.replace('artist', 'v.artist')} THEN v.song_title WHEN p.confidence >= 0.65 THEN p.song ELSE gs END AS found_song
FROM videos v JOIN p ON v.record_id = p.record_id LEFT JOIN g ON v.video_id = g.video_id"""


def par13_channel_patterns(spark: SparkSession, d: str) -> DataFrame:
    """The ten most frequent title structures of each channel with their success."""
    v = table(spark, d, "videos").where("channel_id is not null").withColumn("structure", T.structure("title")).where("structure is not null")
    ok = F.when((F.col("artist") != "") & (F.col("song_title") != ""), 1.0).otherwise(0.0)
    p = v.groupBy("channel_id", "structure").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(ok), 6).alias("success"), F.max("scraped_at").alias("last_seen"))
    return p.withColumn("place", F.row_number().over(Window.partitionBy("channel_id").orderBy(F.desc("n"), "structure"))).where("place <= 10")


_P13 = f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY channel_id ORDER BY n DESC, structure) AS place FROM (SELECT channel_id, structure, count(*) AS n, round(avg(CASE WHEN artist <> '' AND song_title <> '' THEN 1.0 ELSE 0.0 END), 6) AS success, max(scraped_at) AS last_seen FROM (SELECT *, {_struct_sql} AS structure FROM videos WHERE channel_id IS NOT NULL) WHERE structure IS NOT NULL GROUP BY 1, 2)) WHERE place <= 10"
QUERIES["par13_channel_patterns"] = par13_channel_patterns
ORACLE["par13_channel_patterns"] = _P13


def str13_artist_variations(spark: SparkSession, d: str) -> DataFrame:
    """Spellings under which a catalogue may list an artist."""
    a = F.trim("artist_name")
    forms = F.array(a, F.trim(F.regexp_replace(a, r"\s*\([^)]*\)", "")), F.replace(a, F.lit("&"), F.lit("and")), F.regexp_replace(a, r"\band\b", "&"), F.replace(a, F.lit("$"), F.lit("S")), T.unmarked(a))
    return table(spark, d, "discogs_data").where("artist_name <> ''").select("artist_name").distinct().select("artist_name", F.explode(F.array_distinct(F.filter(forms, lambda x: x != ""))).alias("variation"))


def str23_quoted_parts(spark: SparkSession, d: str) -> DataFrame:
    """Quoted parts of titles, with their places."""
    found = F.regexp_extract_all("title", F.lit('"([^"]+)"'), F.lit(1))
    return table(spark, d, "videos").select("record_id", F.posexplode(found).alias("pos", "part"))


QUERIES |= {"str13_artist_variations": str13_artist_variations, "str23_quoted_parts": str23_quoted_parts}

ORACLE |= {
    "str13_artist_variations": rf"SELECT artist_name, unnest(list_distinct([x FOR x IN [a, trim(regexp_replace(a, '\s*\([^)]*\)', '', 'g'), ' '), replace(a, '&', 'and'), regexp_replace(a, '\band\b', '&', 'g'), replace(a, '$', 'S'), regexp_replace(translate(a, {q(T.MARKED)}, {q(T.PLAIN)}), '[\x{{0300}}-\x{{036f}}]', '', 'g')] IF x <> ''])) AS variation FROM (SELECT DISTINCT artist_name, trim(artist_name, ' ') AS a FROM discogs_data WHERE artist_name <> '')",
    "str23_quoted_parts": "SELECT record_id, (i - 1)::INT AS pos, p[i] AS part FROM (SELECT record_id, p, unnest(range(1, len(p) + 1)) AS i FROM (SELECT record_id, regexp_extract_all(title, '\"([^\"]+)\"', 1) AS p FROM videos))",
}
