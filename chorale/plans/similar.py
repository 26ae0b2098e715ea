"""Queries of similarities and fuzzy joins (SIM, JN7-JN11, FLT15, FLT21)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chorale.functions import similarity as S
from chorale.functions import strings as T
from chorale.operators.fuzzy import edit_similar_pairs
from chorale.plans.shared import Query
from chorale.plans.texts import _SPACE, _WORD, q
from chorale.plans.texts import ORACLE as ORACLE_TEXTS
from chorale.sources.tables import table

QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}

_words = lambda x: f"[w FOR w IN regexp_split_to_array({x}, '[{_SPACE}]+') IF w <> '']"
_jac = lambda x, y: f"CASE WHEN len({x}) > 0 AND len({y}) > 0 THEN len(list_intersect({x}, {y}))::DOUBLE / len(list_distinct(list_concat({x}, {y}))) ELSE 0 END"
_ascii = lambda x: "regexp_replace(translate(" + x + f", {q(T.MARKED)}, {q(T.PLAIN)}), '[^ -~]', '', 'g')"
_pairs_of = lambda x, y: f"pairs AS (SELECT * FROM (SELECT DISTINCT {_ascii('v.' + x)} AS a, {_ascii('g.' + y)} AS b FROM videos v JOIN discogs_data g ON v.video_id = g.video_id) WHERE a <> '' AND b <> '')"
_PAIRS, _TITLES = _pairs_of("artist", "artist_name"), _pairs_of("song_title", "song_title")


def _pairs(spark: SparkSession, d: str, own: str, other: str) -> DataFrame:
    """Distinct pairs of the two spellings of a video's record and its releases: each is scored once."""
    v, g = table(spark, d, "videos").select("video_id", T.plain_ascii(own).alias("a")), table(spark, d, "discogs_data").select("video_id", T.plain_ascii(other).alias("b"))
    return v.join(g, "video_id").where("a <> '' and b <> ''").select("a", "b").distinct()


def _add(name: str, columns: tuple[str, str], score, sql: str | None, with_sql: str) -> None:
    def run(spark: SparkSession, d: str) -> DataFrame:
        return _pairs(spark, d, *columns).select("a", "b", score().alias("score"))

    run.__doc__ = f"{name}: score of every distinct pair of {columns[0]} and {columns[1]} of one video."
    QUERIES[name] = run
    if sql:
        ORACLE[name] = f"WITH {with_sql} SELECT a, b, {sql} AS score FROM pairs"


_ART, _SONG = ("artist", "artist_name"), ("song_title", "song_title")
_wa, _wb = _words("lower(a)"), _words("lower(b)")
_add("sim02_tokens", _ART, lambda: F.round(S.token_similarity(F.lower("a"), F.lower("b")), 6), f"(SELECT round(j + CASE WHEN len(x) = len(y) AND len(x) > 0 THEN least(len([1 FOR p, i IN x IF p = y[i]])::DOUBLE / len(x) * 0.2, 1 - j) ELSE 0 END, 6) FROM (SELECT x, y, {_jac('x', 'y')} AS j FROM (SELECT {_wa} AS x, {_wb} AS y)))", _PAIRS)
_x, _y = "lower(trim(a, ' '))", "lower(trim(b, ' '))"
_cx, _cy = (f"trim(regexp_replace({t}, '[{_SPACE}]*\\([^)]*\\)', '', 'g'), ' ')" for t in (_x, _y))
_edit = "1 - levenshtein({0}, {1})::DOUBLE / greatest(length({0}), length({1}), 1)"
_base = f"SELECT {_x} AS x, {_y} AS y, {_cx} AS cx, {_cy} AS cy, list_distinct({_words(_cx)}) AS wx, list_distinct({_words(_cy)}) AS wy"
_add("sim05_titles", _SONG, lambda: F.round(S.release_similarity("a", "b"), 6), f"(SELECT round(CASE WHEN x = '' OR y = '' THEN 0 WHEN x = y THEN 1 ELSE least(1, ({_edit.format('x', 'y')}) * 0.6 + ({_jac('wx', 'wy')}) * 0.25 + CASE WHEN least(length(cx), length(cy)) >= 3 AND (contains(cx, cy) OR contains(cy, cx)) THEN least(length(cx), length(cy))::DOUBLE / greatest(length(cx), length(cy)) ELSE 0 END * 0.15) END, 6)::DOUBLE FROM ({_base}))", _TITLES)
_add("sim05_artists", _ART, lambda: F.round(S.release_similarity("a", "b", artist=True), 6), f"(SELECT round(CASE WHEN x = '' OR y = '' THEN 0 WHEN x = y THEN 1 ELSE least(1, ({_edit.format('x', 'y')}) * 0.5 + CASE WHEN len(wx) > 0 THEN len([q FOR q IN wx IF len([r FOR r IN wy IF 1 - levenshtein(q, r)::DOUBLE / greatest(length(q), length(r)) >= 0.8]) > 0])::DOUBLE / len(wx) ELSE 0 END * 0.4 + ({_jac('wx', 'wy')}) * 0.1) END, 6)::DOUBLE FROM ({_base}))", _PAIRS)
_clean = lambda c: f"list_distinct([w FOR w IN regexp_split_to_array(regexp_replace(lower({c}), '[^{_WORD}{_SPACE}]', '', 'g'), '[{_SPACE}]+') IF w <> '' AND w NOT IN ({', '.join(repr(w) for w in S.FUZZY_STOP_WORDS)})])"
_add("sim06_words_match", _SONG, lambda: S.words_match("a", "b"), f"(SELECT ({_jac('x', 'y')}) >= 0.7 FROM (SELECT {_clean('a')} AS x, {_clean('b')} AS y))", _TITLES)
_add("sim07_jaro_winkler", _ART, lambda: F.round(S.jaro_winkler(F.lower("a"), F.lower("b")), 4), "round(jaro_winkler_similarity(lower(a), lower(b)), 4)", _PAIRS)
_add("sim07_ratcliff", _ART, lambda: F.round(S.ratcliff(F.lower("a"), F.lower("b")), 6), None, _PAIRS)
_add("sim01_mixed", _ART, lambda: F.round(S.mixed_similarity(T.normal_name("a"), T.normal_name("b")), 6), None, _PAIRS)
_add("sim03_phonetic", _ART, lambda: F.greatest(F.when(T.sound("a") == T.sound("b"), 1.0).otherwise(0.0), F.when(T.short_sound("a") == T.short_sound("b"), 1.0).otherwise(0.0)), None, _PAIRS)
_add("flt15_alike_artists", _ART, lambda: S.edit_similarity(F.lower("a"), F.lower("b")) >= 0.7, "1 - levenshtein(lower(a), lower(b))::DOUBLE / greatest(length(lower(a)), length(lower(b)), 1) >= 0.7", _PAIRS)
_parts = r"&|,| and | feat\.? | ft\.? "
_add("flt21_more_artists", _ART, lambda: F.size(F.split(F.lower("a"), _parts)) > F.size(F.split(F.lower("b"), _parts)), f"len(regexp_split_to_array(lower(a), '{_parts}')) > len(regexp_split_to_array(lower(b), '{_parts}'))", _PAIRS)


#: Weights of letters and sound, and the least score of a match. Fixed values.
LETTERS, SOUND, MATCH = 0.8, 0.2, 0.8


def fuzzy_matches(asked: DataFrame, known: DataFrame) -> DataFrame:
    """query, candidate, score of all pairs of names that match: 0.8 of their edit similarity and 0.2 if they sound alike."""
    pairs = edit_similar_pairs(asked.select(F.lower(asked.columns[0]).alias("a")), known.select(F.lower(known.columns[0]).alias("b")), (MATCH - SOUND) / LETTERS)
    sound = ((T.sound("a") == T.sound("b")) | (T.short_sound("a") == T.short_sound("b"))).cast("double")
    return pairs.select(F.col("a").alias("query"), F.col("b").alias("candidate"), F.round(F.col("similarity") * LETTERS + sound * SOUND, 6).alias("score")).where(F.col("score") >= MATCH)


def _matched(spark: SparkSession, d: str) -> DataFrame:
    return fuzzy_matches(table(spark, d, "discogs_data").select(T.plain_ascii("artist_name").alias("a")), table(spark, d, "videos").select(T.plain_ascii("artist").alias("b")))


def jn07_best_match(spark: SparkSession, d: str) -> DataFrame:
    """The candidate most like each query name, of all."""
    w = Window.partitionBy("query").orderBy(F.desc("score"), "candidate")
    return _matched(spark, d).withColumn("rn", F.row_number().over(w)).where("rn = 1").drop("rn")


def jn08_all_matches(spark: SparkSession, d: str) -> DataFrame:
    """The ten candidates most like each query name."""
    w = Window.partitionBy("query").orderBy(F.desc("score"), "candidate")
    return _matched(spark, d).withColumn("place", F.row_number().over(w)).where("place <= 10")


def jn09_pair_match(spark: SparkSession, d: str) -> DataFrame:
    """Of a video's releases the one whose artist (0.6) and song (0.4) are most alike, each at least half."""
    v = table(spark, d, "videos").where("video_id is not null and artist <> '' and song_title <> ''").select("record_id", "video_id", F.lower(T.plain_ascii("artist")).alias("va"), F.lower(T.plain_ascii("song_title")).alias("vs"))
    g = table(spark, d, "discogs_data").where("video_id is not null and artist_name <> '' and song_title <> ''").select("video_id", F.col("record_id").alias("release_record"), F.lower(T.plain_ascii("artist_name")).alias("ga"), F.lower(T.plain_ascii("song_title")).alias("gs"))
    s = v.join(g, "video_id").withColumns({"sa": S.edit_similarity("va", "ga"), "ss": S.edit_similarity("vs", "gs")}).where("sa >= 0.5 and ss >= 0.5").withColumn("score", F.round(F.col("sa") * 0.6 + F.col("ss") * 0.4, 6))
    w = Window.partitionBy("record_id").orderBy(F.desc("score"), "release_record")
    return s.withColumn("rn", F.row_number().over(w)).where("rn = 1").select("record_id", "release_record", "score")


def known_in_titles(titles: DataFrame, artists: DataFrame, songs: DataFrame, least: float = 0.8) -> DataFrame:
    """record_id, artist, song, confidence of the known artist and song most like a run of capitalised words of a title.

    titles: record_id, title. The confidence is 0.9 of the better similarity. Runs are joined to the names
    once each, however many titles have them; a title without a match has no row. No run is more like a name than an
    equal one, so only titles without an equal run are compared further.
    """
    runs = titles.select("record_id", F.explode(F.array_distinct(F.regexp_extract_all("title", F.lit(r"\b([A-Z][a-z]+(?:\s+[A-Z][a-z]+)*)\b"), F.lit(1)))).alias("run")).withColumn("a", F.lower("run"))
    found = None
    for kind, names in (("artist", artists), ("song", songs)):
        named = names.select(F.col(names.columns[0]).alias("name")).where("name <> ''").groupBy(F.lower("name").alias("b")).agg(F.min("name").alias("name"))
        equal = runs.join(named, F.col("a") == F.col("b")).select("record_id", F.struct(F.lit(1.0).alias("s"), "name").alias("hit"))
        rest = runs.join(equal.select("record_id").distinct(), "record_id", "left_anti")
        near = edit_similar_pairs(rest.select("a"), named.select("b"), least + 1e-7).where(F.col("similarity") > least).join(named, "b").select("a", F.struct(F.round("similarity", 6).alias("s"), "name").alias("hit"))
        best = equal.unionByName(rest.join(near, "a").select("record_id", "hit")).groupBy("record_id").agg(F.min_by("hit", F.struct(-F.col("hit.s"), F.col("hit.name"))).alias(kind))
        found = best if found is None else found.join(best, "record_id", "full")
    score = F.greatest(F.coalesce("artist.s", F.lit(0.0)), F.coalesce("song.s", F.lit(0.0)))
    return found.select("record_id", F.col("artist.name").alias("artist"), F.col("song.name").alias("song"), F.round(score * 0.9, 6).alias("confidence"))


def jn10_known_artists(spark: SparkSession, d: str) -> DataFrame:
    """Known artists and songs in titles, misspelt or not."""
    g = table(spark, d, "discogs_data")
    return known_in_titles(table(spark, d, "videos").select("record_id", T.plain_ascii("title").alias("title")), g.select(T.plain_ascii("artist_name").alias("n")), g.select(T.plain_ascii("song_title").alias("n")))


def jn11_nearest_centroid(spark: SparkSession, d: str) -> DataFrame:
    """The label whose mean vector has the highest cosine with each vector; there is one mean for each label."""
    e = table(spark, d, "embeddings").select("vec_id", "label", "embedding")
    means = e.select("label", F.posexplode("embedding").alias("i", "x")).groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("x"))
    means = means.groupBy("label").agg(F.array_sort(F.collect_list(F.struct("i", "x"))).alias("m")).select(F.col("label").alias("near"), F.transform("m", lambda s: s["x"]).alias("mean"))
    all_means = F.broadcast(means.agg(F.sort_array(F.collect_list(F.struct("near", "mean"))).alias("means")).withColumn("k", F.lit(1)))
    scored = e.withColumn("k", F.lit(1)).join(all_means, "k").select("vec_id", F.transform("means", lambda m: F.struct(F.round(S.cosine("embedding", m["mean"]), 5).alias("c"), (-m["near"]).alias("l"))).alias("s"))
    best = F.array_max("s")
    return scored.select("vec_id", (-best["l"]).alias("near"), best["c"].alias("cosine"))


QUERIES |= {"jn07_best_match": jn07_best_match, "jn08_all_matches": jn08_all_matches, "jn09_pair_match": jn09_pair_match, "jn10_known_artists": jn10_known_artists, "jn11_nearest_centroid": jn11_nearest_centroid}
_sound_of = lambda name, x: ORACLE_TEXTS[name].removeprefix("SELECT record_id, ").split(" AS code")[0].replace("artist", x)
ORACLE["sim03_phonetic"] = f"WITH {_PAIRS} SELECT a, b, CASE WHEN ({_sound_of('str25_sound', 'a')}) = ({_sound_of('str25_sound', 'b')}) OR ({_sound_of('str25_short_sound', 'a')}) = ({_sound_of('str25_short_sound', 'b')}) THEN 1.0 ELSE 0.0 END::DOUBLE AS score FROM pairs"
_alike = f"(({_sound_of('str25_sound', 'query')}) = ({_sound_of('str25_sound', 'candidate')}) OR ({_sound_of('str25_short_sound', 'query')}) = ({_sound_of('str25_short_sound', 'candidate')}))"
_B = f"""p AS (SELECT query, candidate, 1 - levenshtein(query, candidate)::DOUBLE / greatest(length(query), length(candidate)) AS e FROM (SELECT DISTINCT lower({_ascii('artist_name')}) AS query FROM discogs_data) q, (SELECT DISTINCT lower({_ascii('artist')}) AS candidate FROM videos) c WHERE query <> '' AND candidate <> '' AND abs(length(query) - length(candidate)) <= 0.25 * greatest(length(query), length(candidate)) + 1e-9),
b AS (SELECT * FROM (SELECT query, candidate, round(e * {LETTERS} + CASE WHEN {_alike} THEN {SOUND} ELSE 0 END, 6) AS score FROM p WHERE e >= 0.75 - 1e-9) WHERE score >= {MATCH})"""
_runs = r"[x FOR x IN regexp_extract_all(t, '\b[A-Z][a-z]+(?:\s+[A-Z][a-z]+)*\b')]"
_near = lambda kind, c: f"""{kind} AS (SELECT record_id, arg_min(name, (-s, name)) AS name, max(s) AS s FROM (SELECT DISTINCT record_id, lower(x) AS a FROM r) r JOIN (SELECT a, name, round(1 - levenshtein(a, b)::DOUBLE / greatest(length(a), length(b)), 6) AS s FROM (SELECT DISTINCT lower(x) AS a FROM r), (SELECT lower(n) AS b, min(n) AS name FROM (SELECT {_ascii(c)} AS n FROM discogs_data) WHERE n <> '' GROUP BY 1) k WHERE abs(length(a) - length(b)) <= 0.2 * greatest(length(a), length(b)) AND levenshtein(a, b) < 0.2 * greatest(length(a), length(b)) - 1e-9) USING (a) GROUP BY 1)"""
ORACLE |= {
    "jn07_best_match": f"WITH {_B} SELECT query, candidate, score FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, candidate) AS rn FROM b) WHERE rn = 1",
    "jn08_all_matches": f"WITH {_B} SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, candidate) AS place FROM b) WHERE place <= 10",
    "jn09_pair_match": f"""WITH s AS (SELECT v.record_id, g.record_id AS release_record, {_edit.format('lower(' + _ascii('v.artist') + ')', 'lower(' + _ascii('g.artist_name') + ')')} AS sa, {_edit.format('lower(' + _ascii('v.song_title') + ')', 'lower(' + _ascii('g.song_title') + ')')} AS ss FROM videos v JOIN discogs_data g ON v.video_id = g.video_id WHERE v.artist <> '' AND v.song_title <> '' AND g.artist_name <> '' AND g.song_title <> '')
SELECT record_id, release_record, score FROM (SELECT record_id, release_record, round(sa * 0.6 + ss * 0.4, 6) AS score, row_number() OVER (PARTITION BY record_id ORDER BY round(sa * 0.6 + ss * 0.4, 6) DESC, release_record) AS rn FROM s WHERE sa >= 0.5 AND ss >= 0.5) WHERE rn = 1""",
    "jn10_known_artists": f"WITH r AS (SELECT record_id, unnest({_runs}) AS x FROM (SELECT record_id, {_ascii('title')} AS t FROM videos)), {_near('ar', 'artist_name')}, {_near('so', 'song_title')} SELECT coalesce(ar.record_id, so.record_id) AS record_id, ar.name AS artist, so.name AS song, round(greatest(coalesce(ar.s, 0), coalesce(so.s, 0)) * 0.9, 6) AS confidence FROM ar FULL JOIN so ON ar.record_id = so.record_id",
    "jn11_nearest_centroid": """WITH x AS (SELECT vec_id, label, unnest(embedding) AS v, generate_subscripts(embedding, 1) AS i FROM embeddings), m AS (SELECT label AS near, list(a ORDER BY i) AS mean FROM (SELECT label, i, avg(v::DOUBLE) AS a FROM x GROUP BY 1, 2) GROUP BY 1)
SELECT vec_id, near, cosine FROM (SELECT vec_id, near, round(list_cosine_similarity(embedding::DOUBLE[], mean), 5) AS cosine, row_number() OVER (PARTITION BY vec_id ORDER BY round(list_cosine_similarity(embedding::DOUBLE[], mean), 5) DESC, near) AS rn FROM embeddings CROSS JOIN m) WHERE rn = 1""",
}
