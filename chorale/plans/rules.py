"""Queries of the rule tables and of what follows from a parse (PAR, JN16, STR8, STR10, SCR13, SCR17, AGG21, TOP13, ST7, FLT16, ORC3)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chorale.functions import evidence as E
from chorale.functions import similarity as S
from chorale.functions import strings as T
from chorale.functions import words as W
from chorale.functions.scoring import hit_relevance
from chorale.functions.title_rules import BRANDED, BY_CHANNEL, BY_SCRIPT, CONTEXT, IN_CONTEXT, LIBRARY, PLAIN, PLAIN_BEGINNINGS, PLAIN_DESCRIPTION, PLAIN_DESCRIPTION_WEIGHT, TEMPLATES, Rule
from chorale.operators.filters import valid_artist, valid_guest, valid_name
from chorale.operators.parsing import first_rule, parsed
from chorale.plans.evidence import _list, _w
from chorale.plans.parse import _ok_artist, _ok_plain, _P13, _parsed_sql, par13_channel_patterns
from chorale.plans.scores import QUERY, _any, _hits, _t, _terms, _weighed
from chorale.plans.shared import Query, register
from chorale.plans.similar import _ascii, _clean, _jac
from chorale.plans.texts import _extracted, _title_case, chained, q, re2, sub
from chorale.sources.tables import spread, table

QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}
_FLAGS = "(?iUu)"


def par03_script_rules(spark: SparkSession, d: str) -> DataFrame:
    """Titles in another script by the rules of that script; one in no such script has no row."""
    v = table(spark, d, "videos").select("record_id", "title")
    parts = [parsed(v.where(T.script("title") == name), rules).drop("title") for name, rules in BY_SCRIPT.items()]
    return reduce(DataFrame.unionByName, parts)


def par04_channel_rules(spark: SparkSession, d: str) -> DataFrame:
    """Every title by the rules of every kind of channel, where one fits; `own` tells whether the title's channel is of the kind."""
    v = spread(table(spark, d, "videos").select("record_id", "title", "channel_name"))
    own = lambda p: F.coalesce(F.lower("channel_name").rlike(p), F.lit(False))
    parts = [parsed(v, rules).where("rule is not null").select("record_id", F.lit(kind).alias("kind"), own(p).alias("own"), "rule", "artist", "song", "confidence") for kind, p, rules in BY_CHANNEL]
    return reduce(DataFrame.unionByName, parts)


def plain_parse(df: DataFrame, custom: list[str] = ()) -> DataFrame:
    """df (title, description) with rule, artist, song, confidence: the plain rules, else the description's artist, else the caller's patterns.

    A rule keeps its weight if either part is valid. The caller's patterns have the artist in the first group and the song in the second.
    """
    clean = lambda c: T.chained(c, T.EXTRACTED_PLAIN)
    title = T.stripped(F.col("title"))
    for p in PLAIN_BEGINNINGS:
        title = F.regexp_replace(title, _FLAGS + p, "")
    df = parsed(df.withColumn("__title", T.stripped(title)), PLAIN, "__title", clean=clean, artist_ok=valid_artist, partial=1.0)
    df = df.withColumn("__said", clean(F.regexp_extract(F.coalesce("description", F.lit("")), _FLAGS + PLAIN_DESCRIPTION, 1)))
    said = (F.col("confidence") == 0) & valid_artist("__said")
    out = df.withColumns({"rule": F.when(said, "plain_description").otherwise(F.when(F.col("confidence") > 0, F.col("rule"))), "artist": F.when(said, F.col("__said")).otherwise(F.col("artist")), "confidence": F.when(said, PLAIN_DESCRIPTION_WEIGHT).otherwise(F.col("confidence"))})
    for k, p in enumerate(custom):
        a, s = (clean(F.regexp_extract("__title", _FLAGS + p, g)) for g in (1, 2))
        fits = F.col("rule").isNull() & F.col("__title").rlike(_FLAGS + p)
        out = out.withColumns({"__a": a, "__s": s})
        out = out.withColumns({"artist": F.when(fits & valid_artist("__a"), F.col("__a")).otherwise(F.col("artist")), "song": F.when(fits & F.length("__s").between(2, 200), F.col("__s")).otherwise(F.col("song")), "rule": F.when(fits, f"custom_{k}").otherwise(F.col("rule")), "confidence": F.when(fits, 0.6).otherwise(F.col("confidence"))}).drop("__a", "__s")
    return out.drop("__title", "__said")


def par09_plain_parse(spark: SparkSession, d: str) -> DataFrame:
    """Every title by the eighteen plain rules, else by its description."""
    return plain_parse(spread(table(spark, d, "videos").select("record_id", "title", "description"))).drop("title", "description")


def _fitting(spark: SparkSession, d: str) -> DataFrame:
    """record_id, channel_id, rule_set, rule: the first rule of every set of the library that fits a title."""
    v = spread(table(spark, d, "videos").select("record_id", "channel_id", "title").where("title is not null"))
    firsts = F.array(*[F.struct(F.lit(name).alias("rule_set"), first_rule(F.col("title"), rules).alias("rule")) for name, rules in LIBRARY.items()])
    return v.select("record_id", "channel_id", F.inline(firsts)).where("rule is not null")


def par11_library(spark: SparkSession, d: str) -> DataFrame:
    """How many titles each rule of each known channel is the first to fit."""
    return _fitting(spark, d).groupBy("rule_set", "rule").agg(F.count(F.lit(1)).alias("n"))


def _weight(rule: Column) -> Column:
    chain = F
    for rules in LIBRARY.values():
        for name, *_, w in rules:
            chain = chain.when(rule == name, F.lit(w))
    return chain.otherwise(F.lit(0.0))


def jn16_rules_by_channel(spark: SparkSession, d: str) -> DataFrame:
    """The set of rules that cuts most of a channel's titles, by weight: counts a rule first, so a large channel sends few rows."""
    n = _fitting(spark, d).where("channel_id is not null").groupBy("channel_id", "rule_set", "rule").agg(F.count(F.lit(1)).alias("n"))
    n = n.groupBy("channel_id", "rule_set").agg(F.sum("n").alias("n"), F.round(F.sum(F.col("n") * _weight(F.col("rule"))), 4).alias("weight"))
    w = Window.partitionBy("channel_id").orderBy(F.desc("weight"), "rule_set")
    return n.withColumn("place", F.row_number().over(w)).where("place = 1").drop("place")


def template_result(df: DataFrame, rules: list[Rule], attempts: Column, successes: Column) -> DataFrame:
    """df with artist, song and confidence by a channel's rules, weighed with how the channel's titles fared before.

    Dots between artists become commas. A Korean artist gives a tenth more if a name stands in brackets and a
    twentieth more in any case, up to 0.95. Of rules below 0.9 a fifth depends on the share of successes; a
    rule of 0.9 or more that was never tried loses a twentieth.
    """
    p = parsed(df, rules).withColumn("artist", F.replace(F.replace(F.col("artist"), F.lit(" · "), F.lit(", ")), F.lit("·"), F.lit(", ")))
    base = F
    for name, *_, c in rules:
        base = base.when(F.col("rule") == name, F.lit(c))
    base = base.otherwise(F.lit(0.0))
    korean = F.coalesce(F.col("artist").rlike("[가-힯]"), F.lit(False))
    c = F.col("confidence")
    c = F.when(korean & F.contains(F.col("artist"), F.lit("(")) & F.contains(F.col("artist"), F.lit(")")), F.least(c * 1.1, F.lit(0.95))).otherwise(c)
    c = F.when(korean, F.least(c * 1.05, F.lit(0.95))).otherwise(c)
    c = F.when((attempts > 0) & (base < 0.9), c * (0.8 + 0.2 * successes / attempts)).when((attempts == 0) & (base >= 0.9), c * 0.95).otherwise(c)
    return p.withColumn("confidence", F.round(c, 4))


def par12_template_result(spark: SparkSession, d: str) -> DataFrame:
    """Titles by the rules of a known channel, with the history of the channel they are from.

    The history is aggregated a channel, then joined; Spark broadcasts it only if it is small enough.
    """
    v = spread(table(spark, d, "videos").select("record_id", "channel_id", "title", "artist", "song_title"))
    done = F.count_if((F.col("artist") != "") & (F.col("song_title") != ""))
    history = v.where("channel_id is not null").groupBy("channel_id").agg(F.count(F.lit(1)).alias("attempts"), done.alias("successes"))
    v = v.select("record_id", "channel_id", "title").join(history, "channel_id", "left").fillna(0, ["attempts", "successes"])
    return template_result(v, LIBRARY["TheoMusicChannel"], F.col("attempts"), F.col("successes")).select("record_id", "rule", "artist", "song", "confidence")


#: Days after which a pattern is deprecated, what is then left of its weight, what a day without use leaves. Fixed values.
DEPRECATED_AFTER, DEPRECATED, DAILY = 30, 0.7, 0.95


def par15_pattern_confidence(spark: SparkSession, d: str, as_of: str = "2027-04-01") -> DataFrame:
    """Learned patterns' weights: decay by day, deprecation, then recency and success; `half` is that of a parse with one part."""
    p = par13_channel_patterns(spark, d).withColumn("age", F.datediff(F.lit(as_of).cast("date"), F.col("last_seen").cast("date")))
    stale = F.col("age") > DEPRECATED_AFTER
    own = F.lit(0.7) * F.pow(F.lit(DAILY), F.greatest(F.col("age"), F.lit(0))) * F.when(stale, DEPRECATED).otherwise(1.0)
    weight = own * F.greatest(F.lit(0.7), 1 - F.col("age") / 30.0) * (0.5 + 0.5 * F.col("success"))
    return p.select("channel_id", "structure", F.when(stale, "deprecated").otherwise("active").alias("state"), F.round(own, 8).alias("own"), F.round(weight, 8).alias("confidence"), F.round(weight * 0.7, 8).alias("half"), F.round(F.when(stale, F.least(own * 1.2, F.lit(0.9))), 8).alias("revived"))


_SEPARATORS = ["by", "from", "feat", "ft", "featuring"]
_SAID = [r"(?:by|artist|performed by|original artist):\s*([^\n\r]+)", r"Artist:\s*([^\n\r]+)", r"Song:\s*([^\n\r]+)"]


def par07_by_words(spark: SparkSession, d: str) -> DataFrame:
    """Artist and song on either side of the first separating word: the shorter side is the artist; else what the description says."""
    v = spread(table(spark, d, "videos").select("record_id", "title", "description"))
    words = F.regexp_extract_all(F.lower(F.coalesce("title", F.lit(""))), F.lit(r"(?U)(\w+)"), F.lit(1))
    v = v.withColumn("w", words).withColumn("at", F.coalesce(F.array_min(F.filter(F.array(*[F.array_position("w", F.lit(x)) for x in _SEPARATORS]), lambda x: x > 0)), F.lit(0)))
    v = v.withColumns({"before": F.array_join(F.slice("w", 1, F.greatest(F.col("at") - 1, F.lit(0)).cast("int")), " "), "after": F.array_join(F.expr("slice(w, cast(at + 1 as int), size(w))"), " ")})
    v = v.withColumn("after", T.stripped(F.regexp_replace("after", r"\b(karaoke|instrumental|backing|track)\b.*", "")))
    said = F.coalesce(*[F.nullif(F.regexp_extract(F.coalesce("description", F.lit("")), _FLAGS + p, 1), F.lit("")) for p in _SAID])
    v = v.withColumn("said", T.extracted(said))
    split, first = (F.col("at") > 0) & (F.length("after") > 0), (F.length("before") < F.length("after")) & (F.length("before") > 0)
    told = valid_name("said")
    kind = F.when(split & first, "shorter_first").when(split, "shorter_last").when(told, "description")
    v = v.withColumn("kind", kind).where("kind is not null")
    artist = F.when(F.col("kind") == "shorter_first", T.titled("before")).when(F.col("kind") == "shorter_last", T.titled("after")).otherwise(F.col("said"))
    song = F.when(F.col("kind") == "shorter_first", T.titled("after")).when(F.col("kind") == "shorter_last", T.titled("before"))
    return v.select("record_id", "kind", artist.alias("artist"), song.alias("song"), F.when(F.col("kind") == "shorter_first", 0.6).when(F.col("kind") == "shorter_last", 0.5).otherwise(0.7).alias("confidence"))


_GUESTS = [r"feat\.?\s+([^(\[]+)", r"featuring\s+([^(\[]+)", r"ft\.?\s+([^(\[]+)", r"with\s+([^(\[]+)", r"&\s+([^(\[]+)"]


def str08_guests(spark: SparkSession, d: str) -> DataFrame:
    """Names after feat., featuring, ft., with or & in title and description, pattern by pattern, each once in the order found."""
    text = F.lower(F.concat_ws(" ", F.coalesce("title", F.lit("")), F.coalesce("description", F.lit("")), F.lit("")))
    found = F.concat(*[F.regexp_extract_all(text, F.lit(p), F.lit(1)) for p in _GUESTS])
    cleaned = F.transform(found, lambda x: F.regexp_replace(T.stripped(x), r"(?U)[^\w\s,&]", ""))
    parts = F.flatten(F.transform(cleaned, lambda x: F.split(x, r"(?U)\s*&\s*|\s+and\s+|,\s*")))
    names = F.transform(F.filter(F.transform(parts, lambda x: T.stripped(x)), lambda x: F.length(x).between(3, 49) & valid_guest(x)), T.titled)
    return spread(table(spark, d, "videos").select("record_id", "title", "description")).select("record_id", F.array_join(F.array_distinct(names), ", ").alias("guests")).where("guests <> ''")


#: Signs between artists, in the order in which they are tried; separators of artist and song. Fixed values.
_ARTISTS, _PARTS = [r"feat\.", r"ft\.", "featuring", "&", ",", " x "], [" - ", " by ", " from ", ":", " | "]


def str10_search_queries(spark: SparkSession, d: str) -> DataFrame:
    """Up to seven different queries of a title worth searching for: by several artists, spaced out, whole, and by parts in both orders."""
    both = lambda a, b: F.concat(F.lit('artist:"'), a, F.lit('" AND recording:"'), b, F.lit('"'))
    v = spread(table(spark, d, "videos").select("record_id", "title").where("title is not null")).withColumn("base", F.trim(T.chained(F.lower(T.plain_ascii("title")), T.QUERY)))
    v = v.where((F.length("base") >= 3) & E.valid_query(F.col("base"))).withColumns({"rest": F.col("base"), "lead": F.lit(None).cast("string")})
    for p in _ARTISTS:
        has = F.col("rest").rlike(p)
        v = v.withColumns({"lead": F.when(F.col("lead").isNull() & has, F.trim(F.get(F.split("rest", p, 2), F.lit(0)))).otherwise(F.col("lead")), "rest": F.when(has, F.trim(F.get(F.split("rest", p, 2), F.lit(1)))).otherwise(F.col("rest"))})
    v = v.withColumn("spaced", F.regexp_replace(F.regexp_replace("base", "([a-z0-9])-([a-z0-9])", "$1 - $2"), "([a-z0-9])-([a-z0-9])", "$1 - $2"))
    at = F
    for x in _PARTS:
        at = at.when(F.contains(F.col("spaced"), F.lit(x)), F.lit(x))
    v = v.withColumn("sep", at.otherwise(F.lit(None)))
    cut = F.expr("instr(spaced, sep)")
    v = v.withColumns({"l": F.trim(F.expr("substring(spaced, 1, instr(spaced, sep) - 1)")), "r": F.trim(F.expr("substring(spaced, instr(spaced, sep) + length(sep))"))})
    some = F.when(F.col("lead").isNotNull(), F.array(both("base", "base"), both("lead", "rest")))
    parts = F.when(F.col("sep").isNotNull() & (cut > 0), F.array(both("l", "r"), both("r", "l")))
    none = F.array().cast("array<string>")
    queries = F.concat(F.coalesce(some, none), F.array("spaced", "base"), F.coalesce(parts, none))
    kept = F.slice(F.array_distinct(F.filter(queries, lambda x: F.length(x) > 3)), 1, 7)
    return v.select("record_id", F.posexplode(kept).alias("pos", "query"))


def _candidates(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "videos").where("artist <> '' and song_title <> '' and video_id is not null").select("record_id", "video_id", "artist", "song_title")
    g = table(spark, d, "discogs_data").where("video_id is not null").select("video_id", F.col("record_id").alias("release_record"), "artist_name", F.col("song_title").alias("release_song"), "styles", "genres", "master_id")
    n = g.where("master_id is not null").groupBy("master_id").agg(F.count(F.lit(1)).alias("releases"))
    return v.join(g, "video_id").join(n, "master_id", "left")


def scr13_points(spark: SparkSession, d: str) -> DataFrame:
    """The best candidate of a record with 50 points or more: 50 for a name that holds the other, 30 for like words, releases up to 10, 5 for tags."""
    c = _candidates(spark, d)
    low = lambda x: F.lower(F.coalesce(F.col(x), F.lit("")))
    for name, a, b in (("pa", "artist", "artist_name"), ("ps", "song_title", "release_song")):
        c = c.withColumn(name, F.when(F.contains(low(b), low(a)) | F.contains(low(a), low(b)), 50).when(S.words_match(low(a), low(b)), 30).otherwise(0))
    tags = (F.coalesce("styles", "genres", F.lit("")) != "").cast("int") * 5
    c = c.withColumn("points", F.when(F.col("artist_name").isNull(), 0).otherwise(F.col("pa")) + F.col("ps") + F.least(F.coalesce("releases", F.lit(0)), F.lit(10)) + tags).where("points >= 50")
    w = Window.partitionBy("record_id").orderBy(F.desc("points"), "release_record")
    return c.withColumn("place", F.row_number().over(w)).where("place = 1").select("record_id", "release_record", F.col("points").cast("long").alias("points"))


#: Added before rounding, so that halves go up whatever the last bit of a sum is.
HALF = 1e-9


def validation_factor(artist: Column, song: Column, score: Column) -> Column:
    """How well a parse matches a catalogue entry, 0 to 1.5, from the similarities of artist and song and the catalogue's score (0 to 100)."""
    exact = F.when((artist > 0.95) & (song > 0.95), 0.3).when((artist > 0.9) | (song > 0.9), 0.15).otherwise(0.0)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.5), (artist + song) / 2 + F.least(score / 100, F.lit(0.2)) + exact - F.when((artist < 0.5) | (song < 0.5), 0.2).otherwise(0.0)))


def _validated(spark: SparkSession, d: str, similar) -> DataFrame:
    v = table(spark, d, "videos").where("artist <> '' and song_title <> '' and video_id is not null and parse_confidence between 0 and 1").select("record_id", "video_id", "artist", "song_title", "parse_confidence")
    g = table(spark, d, "discogs_data").where("video_id is not null and confidence between 0 and 1 and artist_name <> ''").select("video_id", F.col("record_id").alias("release_record"), "artist_name", F.col("song_title").alias("release_song"), "confidence")
    low = lambda x: F.lower(F.coalesce(F.col(x), F.lit("")))
    c = v.join(g, "video_id").withColumns({"sa": similar(low("artist"), low("artist_name")), "ss": similar(low("song_title"), low("release_song"))})
    c = c.withColumn("factor", validation_factor(F.col("sa"), F.col("ss"), F.col("confidence") * 20))
    sure = F.col("factor") >= 0.8
    return c.select("record_id", "release_record", F.round(F.col("factor") + HALF, 6).alias("factor"), F.round(F.least(F.col("parse_confidence") * F.col("factor"), F.lit(0.98)) + HALF, 6).alias("confidence"), F.when(sure, F.col("artist_name")).otherwise(F.col("artist")).alias("final_artist"), F.when(sure & (F.col("release_song") != ""), F.col("release_song")).otherwise(F.col("song_title")).alias("final_song"))


def scr17_adjusted(spark: SparkSession, d: str) -> DataFrame:
    """Parses validated against their releases: the factor by matching blocks, the weight after it (0.98 at most), and the catalogue's names from 0.8 on."""
    return _validated(spark, d, S.ratcliff)


def scr17_by_edits(spark: SparkSession, d: str) -> DataFrame:
    """The same by the edit similarity of the names in plain letters, which SQL can state."""
    return _validated(spark, d, lambda a, b: S.edit_similarity(T.plain_ascii(a), T.plain_ascii(b)))


#: A channel's name is cut off a title's beginning before its rules are tried, so that they are the same for all channels.
_UNBRANDED = [(n, p.replace("{}", "<channel>"), a, s, w) for n, p, a, s, w in BRANDED]


def par10_template_pass(spark: SparkSession, d: str) -> DataFrame:
    """Titles by rules that name their channel, by further templates (both above 0.75), else for karaoke channels by their context (above 0.6)."""
    v = spread(table(spark, d, "videos").select("record_id", "title", "channel_name").where("title is not null"))
    low, name = F.lower("title"), F.lower(F.coalesce("channel_name", F.lit("")))
    bracket, plain = F.startswith(low, F.concat(F.lit("["), name, F.lit("]"))) & (name != ""), F.startswith(low, name) & (name != "")
    rest = lambda n: F.expr(f"substring(title, length(channel_name) + {n})")
    marked = F.when(bracket, F.concat(F.lit("[<channel>]"), rest(3))).when(plain, F.concat(F.lit("<channel>"), rest(1))).otherwise(F.col("title"))
    v = parsed(v.withColumn("__marked", marked), _UNBRANDED + TEMPLATES, "__marked", "t_")
    v = parsed(v, IN_CONTEXT, "title", "c_")
    context = reduce(lambda a, b: a | b, [name.contains(x) for x in CONTEXT])
    boosted = F.round(F.least(F.col("c_confidence") * 1.1, F.lit(0.95)), 4)
    first, second = F.col("t_confidence") > 0.75, context & (boosted > 0.6)
    pick = lambda c: F.when(first, F.col(f"t_{c}")).when(second, F.col(f"c_{c}")).alias(c)
    return v.select("record_id", pick("rule"), pick("artist"), pick("song"), F.when(first, F.col("t_confidence")).when(second, boosted).otherwise(0.0).alias("confidence"))


def orc03_sorted_hits(spark: SparkSession, d: str) -> DataFrame:
    """Hits of watch pages with their score for the query, and their place among the channel's, best first."""
    v = spread(table(spark, d, "videos").select("record_id", "url", "title", "channel_id")).withColumn("hit", F.regexp_extract("url", r"watch\?v=([^&]+)", 1)).where("hit <> '' and channel_id is not null")
    w = Window.partitionBy("channel_id").orderBy(F.desc("score"), "record_id")
    return v.select("record_id", "hit", "channel_id", F.round(hit_relevance(QUERY), 6).alias("score")).withColumn("place", F.row_number().over(w))


for _f in (par10_template_pass, orc03_sorted_hits, par03_script_rules, par04_channel_rules, par09_plain_parse, par11_library, jn16_rules_by_channel, par12_template_result, par15_pattern_confidence, par07_by_words, str08_guests, str10_search_queries, scr13_points, scr17_adjusted, scr17_by_edits):
    QUERIES[_f.__name__] = _f

# SQL of the above
_plain = lambda x: chained(x, T.EXTRACTED_PLAIN)
_script_case = "CASE " + " ".join(f"WHEN regexp_matches(title, {q(p)}) THEN '{n}'" for n, p in T.SCRIPTS) + " ELSE 'english' END"
_strip = lambda x: sub(x, r"^\s+|\s+$", "")
_begun = _strip("title")
for _p in PLAIN_BEGINNINGS:
    _begun = sub(_begun, _p, "", "i")
_begun = _strip(_begun)
_plain_sql = _parsed_sql(PLAIN, f"(SELECT record_id, channel_name, {_begun} AS title FROM videos)", _plain, _ok_plain, 1.0)
_first = lambda rules: "CASE " + " ".join(f"WHEN regexp_matches(title, {q(re2(p))}, 'i') THEN '{n}'" for n, p, *_ in rules) + " END"
_fit_sql = " UNION ALL ".join(f"SELECT record_id, channel_id, '{name}' AS rule_set, {_first(rules)} AS rule FROM videos WHERE title IS NOT NULL" for name, rules in LIBRARY.items())
_weights = "CASE rule " + " ".join(f"WHEN '{n}' THEN {w}" for rules in LIBRARY.values() for n, *_, w in rules) + " END"
_theo = LIBRARY["TheoMusicChannel"]
_base = "CASE rule " + " ".join(f"WHEN '{n}' THEN {w}" for n, *_, w in _theo) + " ELSE 0 END"
_korean = "regexp_matches(coalesce(artist, ''), '[가-힯]')"
_w_split = f"regexp_extract_all(lower(coalesce(title, '')), {q(re2('[' + chr(92) + 'w]+'))})"
_low = lambda x: f"lower(coalesce({x}, ''))"
_said_sql = "coalesce(" + ", ".join(f"nullif(regexp_extract(coalesce(description, ''), {q(re2(p))}, 1, 'i'), '')" for p in _SAID) + ")"
_guest_all = "list_concat(" * 4 + f"regexp_extract_all(t, {q(re2(_GUESTS[0]))}, 1)" + "".join(f", regexp_extract_all(t, {q(re2(p))}, 1))" for p in _GUESTS[1:])
_split_1 = lambda p: f"regexp_replace(rest, {q('(?s)' + '^(.*?)' + '(?:' + p + ')' + '(.*)$')}, "
_rest = "SELECT record_id, base, base AS rest, NULL::VARCHAR AS lead FROM s1"
for _p in _ARTISTS:
    _rest = f"SELECT record_id, base, CASE WHEN lead IS NULL AND regexp_matches(rest, {q(_p)}) THEN trim({_split_1(_p)}'\\1'), ' ') ELSE lead END AS lead, CASE WHEN regexp_matches(rest, {q(_p)}) THEN trim({_split_1(_p)}'\\2'), ' ') ELSE rest END AS rest FROM ({_rest})"
_valid_q = f"(SELECT length(trim(base, ' ')) >= 3 AND len([x FOR x IN w IF x IN {_list(E.NOISE)}]) <= len(w) * 0.6 AND len([x FOR x IN w IF length(x) <= 2]) <= len(w) * 0.5 AND NOT {_any('base', E.FRAGMENTS)} AND len([x FOR x IN w IF length(x) >= 3]) >= 2 AND " + " AND ".join(f"NOT regexp_matches(base, {q(p)})" for p in E.SHORT_RUNS) + f" FROM (SELECT {_w('base')} AS w))"
_dashed = "regexp_replace(regexp_replace(base, '([a-z0-9])-([a-z0-9])', '\\1 - \\2', 'g'), '([a-z0-9])-([a-z0-9])', '\\1 - \\2', 'g')"
_sep = "CASE " + " ".join(f"WHEN contains(spaced, {q(x)}) THEN {q(x)}" for x in _PARTS) + " END"
_two_of = lambda a, b: f"'artist:\"' || {a} || '\" AND recording:\"' || {b} || '\"'"
_edit = lambda a, b: f"1 - levenshtein({a}, {b})::DOUBLE / greatest(length({a}), length({b}), 1)"
ORACLE |= {
    "par03_script_rules": "SELECT record_id, rule, artist, song, confidence FROM (" + " UNION ALL ".join(_parsed_sql(rules, f"(SELECT * FROM videos WHERE {_script_case} = '{name}')") for name, rules in BY_SCRIPT.items()) + ")",
    "par04_channel_rules": " UNION ALL ".join(f"SELECT record_id, '{kind}' AS kind, coalesce(regexp_matches(lower(channel_name), {q(p)}), false) AS own, rule, artist, song, confidence FROM ({_parsed_sql(rules)}) WHERE rule IS NOT NULL" for kind, p, rules in BY_CHANNEL),
    "par09_plain_parse": f"""SELECT p.record_id, CASE WHEN said THEN 'plain_description' WHEN confidence > 0 THEN rule END AS rule, CASE WHEN said THEN x ELSE p.artist END AS artist, song, CASE WHEN said THEN {PLAIN_DESCRIPTION_WEIGHT} ELSE confidence END::DOUBLE AS confidence
FROM (SELECT p.*, x, confidence = 0 AND ({_ok_plain.replace('artist', 'x')}) AS said FROM ({_plain_sql}) p JOIN (SELECT record_id, {_plain(f"regexp_extract(coalesce(description, ''), {q(re2(PLAIN_DESCRIPTION))}, 1, 'i')")} AS x FROM videos) v ON p.record_id = v.record_id) p""",
    "par11_library": f"SELECT rule_set, rule, count(*) AS n FROM ({_fit_sql}) WHERE rule IS NOT NULL GROUP BY 1, 2",
    "jn16_rules_by_channel": f"SELECT channel_id, rule_set, n, weight FROM (SELECT *, row_number() OVER (PARTITION BY channel_id ORDER BY weight DESC, rule_set) AS place FROM (SELECT channel_id, rule_set, count(*) AS n, round(sum(({_weights})::DOUBLE), 4) AS weight FROM ({_fit_sql}) WHERE rule IS NOT NULL AND channel_id IS NOT NULL GROUP BY 1, 2)) WHERE place = 1",
    "par12_template_result": f"""SELECT record_id, rule, artist, song, round(CASE WHEN attempts > 0 AND base < 0.9 THEN c2 * (0.8 + 0.2 * successes::DOUBLE / attempts) WHEN attempts = 0 AND base >= 0.9 THEN c2 * 0.95 ELSE c2 END, 4)::DOUBLE AS confidence FROM (
SELECT *, CASE WHEN {_korean} THEN least(c1 * 1.05, 0.95) ELSE c1 END AS c2 FROM (SELECT p.record_id, rule, replace(replace(artist, ' · ', ', '), '·', ', ') AS artist, song, ({_base})::DOUBLE AS base, coalesce(attempts, 0) AS attempts, coalesce(successes, 0) AS successes,
 CASE WHEN {_korean} AND contains(artist, '(') AND contains(artist, ')') THEN least(confidence * 1.1, 0.95) ELSE confidence END AS c1 FROM ({_parsed_sql(_theo)}) p JOIN (SELECT record_id, channel_id FROM videos) v ON p.record_id = v.record_id
 LEFT JOIN (SELECT channel_id, count(*) AS attempts, count(*) FILTER (WHERE artist <> '' AND song_title <> '') AS successes FROM videos WHERE channel_id IS NOT NULL GROUP BY 1) h ON v.channel_id = h.channel_id))""",
    "par15_pattern_confidence": f"""SELECT channel_id, structure, CASE WHEN age > {DEPRECATED_AFTER} THEN 'deprecated' ELSE 'active' END AS state, round(own, 8) AS own, round(w, 8) AS confidence, round(w * 0.7, 8) AS half, round(CASE WHEN age > {DEPRECATED_AFTER} THEN least(own * 1.2, 0.9) END, 8) AS revived FROM (
SELECT *, own * greatest(0.7::DOUBLE, 1 - age / 30.0::DOUBLE) * (0.5 + 0.5 * success) AS w FROM (SELECT *, 0.7::DOUBLE * pow({DAILY}::DOUBLE, greatest(age, 0)) * CASE WHEN age > {DEPRECATED_AFTER} THEN {DEPRECATED}::DOUBLE ELSE 1 END AS own FROM (SELECT *, date_diff('day', last_seen::DATE, DATE '2027-04-01') AS age FROM ({_P13}))))""",
    "par07_by_words": f"""SELECT record_id, kind, CASE kind WHEN 'shorter_first' THEN {_title_case('bef')} WHEN 'shorter_last' THEN {_title_case('aft')} ELSE said END AS artist, CASE kind WHEN 'shorter_first' THEN {_title_case('aft')} WHEN 'shorter_last' THEN {_title_case('bef')} END AS song, CASE kind WHEN 'shorter_first' THEN 0.6 WHEN 'shorter_last' THEN 0.5 ELSE 0.7 END::DOUBLE AS confidence FROM (
SELECT *, CASE WHEN nth > 0 AND length(aft) > 0 THEN CASE WHEN length(bef) < length(aft) AND length(bef) > 0 THEN 'shorter_first' ELSE 'shorter_last' END WHEN {_ok_artist.replace('artist', 'said')} THEN 'description' END AS kind FROM (
SELECT record_id, nth, array_to_string(w[1:nth - 1], ' ') AS bef, {_strip(r"regexp_replace(array_to_string(w[nth + 1:], ' '), '\b(karaoke|instrumental|backing|track)\b.*', '')")} AS aft, {_extracted('said')} AS said FROM (
SELECT record_id, w, {_said_sql} AS said, coalesce(list_min([i FOR i IN [{', '.join(f"list_position(w, '{x}')" for x in _SEPARATORS)}] IF i > 0]), 0) AS nth FROM (SELECT record_id, description, {_w_split} AS w FROM videos)))) WHERE kind IS NOT NULL""",
    "str08_guests": f"""SELECT record_id, guests FROM (SELECT record_id, array_to_string([x FOR x, i IN n IF list_position(n, x) = i], ', ') AS guests FROM (SELECT record_id, [{_title_case('y')} FOR y IN [{_strip('z')} FOR z IN flatten([regexp_split_to_array({sub(_strip('x'), r'[^\w\s,&]', '')}, {q(re2(r'\s*&\s*|\s+and\s+|,\s*'))}) FOR x IN {_guest_all}])] IF length(y) BETWEEN 3 AND 49 AND NOT {_any('y', W.NO_GUEST)} AND NOT regexp_full_match(y, '[\\d\\s\\-_.]+')] AS n
FROM (SELECT record_id, lower(coalesce(title, '') || ' ' || coalesce(description, '') || ' ') AS t FROM videos))) WHERE guests <> ''""",
    "scr13_points": f"""WITH n AS (SELECT master_id, count(*) AS releases FROM discogs_data WHERE master_id IS NOT NULL AND video_id IS NOT NULL GROUP BY 1), c AS (
SELECT v.record_id, g.record_id AS release_record, CASE WHEN g.artist_name IS NULL THEN 0 WHEN contains({_low('g.artist_name')}, {_low('v.artist')}) OR contains({_low('v.artist')}, {_low('g.artist_name')}) THEN 50 WHEN (SELECT ({_jac('x', 'y')}) >= 0.7 FROM (SELECT {_clean('v.artist')} AS x, {_clean("coalesce(g.artist_name, '')")} AS y)) THEN 30 ELSE 0 END
 + CASE WHEN contains({_low('g.song_title')}, {_low('v.song_title')}) OR contains({_low('v.song_title')}, {_low('g.song_title')}) THEN 50 WHEN (SELECT ({_jac('x', 'y')}) >= 0.7 FROM (SELECT {_clean('v.song_title')} AS x, {_clean("coalesce(g.song_title, '')")} AS y)) THEN 30 ELSE 0 END
 + least(coalesce(releases, 0), 10) + CASE WHEN coalesce(g.styles, g.genres, '') <> '' THEN 5 ELSE 0 END AS points
FROM (SELECT * FROM videos WHERE artist <> '' AND song_title <> '') v JOIN discogs_data g ON v.video_id = g.video_id LEFT JOIN n ON g.master_id = n.master_id)
SELECT record_id, release_record, points FROM (SELECT *, row_number() OVER (PARTITION BY record_id ORDER BY points DESC, release_record) AS place FROM c WHERE points >= 50) WHERE place = 1""",
    "scr17_by_edits": f"""SELECT record_id, release_record, round(f + 1e-9, 6) AS factor, round(least(pc * f, 0.98) + 1e-9, 6) AS confidence, CASE WHEN f >= 0.8 THEN artist_name ELSE artist END AS final_artist, CASE WHEN f >= 0.8 AND gs <> '' THEN gs ELSE song_title END AS final_song FROM (
SELECT *, greatest(0.0::DOUBLE, least(1.5::DOUBLE, (sa + ss) / 2 + least(c * 20 / 100, 0.2) + CASE WHEN sa > 0.95 AND ss > 0.95 THEN 0.3 WHEN sa > 0.9 OR ss > 0.9 THEN 0.15 ELSE 0 END - CASE WHEN sa < 0.5 OR ss < 0.5 THEN 0.2 ELSE 0 END)) AS f FROM (
SELECT v.record_id, g.record_id AS release_record, v.artist, v.song_title, v.parse_confidence AS pc, g.artist_name, g.song_title AS gs, g.confidence AS c, {_edit(_ascii(_low('v.artist')), _ascii(_low('g.artist_name')))} AS sa, {_edit(_ascii(_low('v.song_title')), _ascii(_low('g.song_title')))} AS ss
FROM (SELECT * FROM videos WHERE artist <> '' AND song_title <> '' AND parse_confidence BETWEEN 0 AND 1) v JOIN (SELECT * FROM discogs_data WHERE confidence BETWEEN 0 AND 1 AND artist_name <> '') g ON v.video_id = g.video_id))""",
}

#: Totals of a run, what a pass may use, the weight of the newest measurement, how many of these matter to a double. 60, 100, 10, 5, 0.1.
register(
    QUERIES,
    ORACLE,
    {
        "flt16_over_budget": """
            SELECT event_id, cpu + 10 > 60 AS cpu_over, api + 5 > 100 AS api_over, cpu + 10 > 60 OR api + 5 > 100 AS over_budget FROM (
              SELECT event_id, coalesce(sum(CAST(value AS DECIMAL(18, 4))) OVER w, 0) AS cpu, count(*) OVER w AS api FROM {events} WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) x""",
        "agg21_provider_stats": """
            SELECT t.event_type, searches, good, round(CAST(good AS DOUBLE) / searches, 6) AS success_rate, CASE WHEN good > 0 THEN round(CAST(results AS DOUBLE) / good, 4) ELSE 0e0 END AS avg_results, round(ema, 4) AS response FROM (
              SELECT event_type, count(*) AS searches, count(CASE WHEN value >= 10 THEN 1 END) AS good, sum(CASE WHEN value >= 10 THEN CAST(floor(value) AS BIGINT) ELSE 0 END) AS results FROM {events} WHERE event_type IS NOT NULL AND value IS NOT NULL GROUP BY event_type) t
            JOIN (SELECT k.event_type, sum(value * CASE WHEN k.place = n.searches THEN power(0.9e0, k.place - 1) ELSE 0.1e0 * power(0.9e0, k.place - 1) END) AS ema FROM (
                SELECT event_type, value, place FROM (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS place FROM {events} WHERE event_type IS NOT NULL AND value IS NOT NULL) x WHERE place <= 400) k
              JOIN (SELECT event_type, count(*) AS searches FROM {events} WHERE event_type IS NOT NULL AND value IS NOT NULL GROUP BY event_type) n ON k.event_type = n.event_type GROUP BY k.event_type) e ON t.event_type = e.event_type""",
        "st07_live_entries": """
            SELECT channel_id, video_id, last_used, hits FROM (
              SELECT channel_id, video_id, last_used, hits, row_number() OVER (PARTITION BY channel_id ORDER BY last_used DESC, video_id) AS place FROM (
                SELECT channel_id, video_id, max(scraped_at) AS last_used, min(scraped_at) AS put_at, count(*) AS hits FROM {videos} WHERE channel_id IS NOT NULL AND video_id IS NOT NULL AND scraped_at IS NOT NULL GROUP BY channel_id, video_id) e
              WHERE put_at >= (SELECT max(scraped_at) FROM {videos}) - INTERVAL '365' DAY) x WHERE place <= 20""",
    },
)


def top13_unique_guests(spark: SparkSession, d: str) -> DataFrame:
    """The different names of a packed field, in the order in which they first stand, seven at most."""
    parts = F.filter(F.transform(F.split(F.lower("featured_artists"), r"[,;/|&]"), lambda x: F.trim(x)), lambda x: x != "")
    return table(spark, d, "videos").where("featured_artists <> ''").select("record_id", F.array_join(F.slice(F.array_distinct(parts), 1, 7), ", ").alias("names"), F.size(F.array_distinct(parts)).cast("long").alias("n"))


QUERIES["top13_unique_guests"] = top13_unique_guests
ORACLE["top13_unique_guests"] = "SELECT record_id, array_to_string(u[1:7], ', ') AS names, len(u)::BIGINT AS n FROM (SELECT record_id, [x FOR x, i IN p IF list_position(p, x) = i] AS u FROM (SELECT record_id, [trim(x, ' ') FOR x IN regexp_split_to_array(lower(featured_artists), '[,;/|&]') IF trim(x, ' ') <> ''] AS p FROM videos WHERE featured_artists <> ''))"
ORACLE["str10_search_queries"] = f"""WITH s1 AS (SELECT record_id, base FROM (SELECT record_id, trim({chained('lower(t)', T.QUERY)}, ' ') AS base FROM (SELECT record_id, {_ascii('title')} AS t FROM videos WHERE title IS NOT NULL)) WHERE length(base) >= 3 AND {_valid_q}),
p AS (SELECT *, {_sep} AS sep FROM (SELECT *, {_dashed} AS spaced FROM ({_rest}))), h AS (SELECT *, trim(substring(spaced, 1, instr(spaced, sep) - 1), ' ') AS l, trim(substring(spaced, instr(spaced, sep) + length(sep)), ' ') AS r FROM p),
a AS (SELECT record_id, list_concat(list_concat(CASE WHEN lead IS NOT NULL THEN [{_two_of('base', 'base')}, {_two_of('lead', 'rest')}] ELSE [] END, [spaced, base]), CASE WHEN sep IS NOT NULL THEN [{_two_of('l', 'r')}, {_two_of('r', 'l')}] ELSE [] END) AS qs FROM h),
u AS (SELECT record_id, [x FOR x, i IN qs IF list_position(qs, x) = i AND length(x) > 3][1:7] AS qs FROM a)
SELECT record_id, (i - 1)::INT AS pos, qs[i] AS query FROM (SELECT record_id, qs, unnest(range(1, len(qs) + 1)) AS i FROM u)"""
ORACLE["orc03_sorted_hits"] = rf"""SELECT *, row_number() OVER (PARTITION BY channel_id ORDER BY score DESC, record_id) AS place FROM (SELECT record_id, regexp_extract(url, 'watch\?v=([^&]+)', 1) AS hit, channel_id, round(least(2.0::DOUBLE, CAST(contains({_t}, '{QUERY}') AS DOUBLE) + {_hits(_t, _terms)} / {len(_terms)}.0::DOUBLE * 0.5 + {_weighed(_t, W.HIT_WORDS)}), 6) AS score FROM videos) WHERE hit <> '' AND channel_id IS NOT NULL"""
_n = "lower(coalesce(channel_name, ''))"
_marked_sql = f"CASE WHEN {_n} <> '' AND starts_with(lower(title), '[' || {_n} || ']') THEN '[<channel>]' || substring(title, length(channel_name) + 3) WHEN {_n} <> '' AND starts_with(lower(title), {_n}) THEN '<channel>' || substring(title, length(channel_name) + 1) ELSE title END"
_in_context = "(" + " OR ".join(f"contains({_n}, {q(x)})" for x in CONTEXT) + ")"
ORACLE["par10_template_pass"] = f"""SELECT record_id, CASE WHEN first THEN r1 WHEN second THEN r2 END AS rule, CASE WHEN first THEN a1 WHEN second THEN a2 END AS artist, CASE WHEN first THEN s1 WHEN second THEN s2 END AS song, CASE WHEN first THEN k1 WHEN second THEN k2 ELSE 0 END::DOUBLE AS confidence FROM (
SELECT *, k1 > 0.75 AS first, {_in_context} AND k2 > 0.6 AS second FROM (SELECT t.record_id, t.channel_name, t.rule AS r1, t.artist AS a1, t.song AS s1, t.confidence AS k1, c.rule AS r2, c.artist AS a2, c.song AS s2, round(least(c.confidence * 1.1, 0.95), 4) AS k2
FROM ({_parsed_sql(_UNBRANDED + TEMPLATES, f"(SELECT record_id, channel_name, {_marked_sql} AS title FROM videos WHERE title IS NOT NULL)")}) t JOIN ({_parsed_sql(IN_CONTEXT, "(SELECT * FROM videos WHERE title IS NOT NULL)")}) c ON t.record_id = c.record_id))"""
