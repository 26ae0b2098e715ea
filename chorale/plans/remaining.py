"""Queries of limiters, rule tables, staged name matching and catalogue introspection (ST3, ST4, ST7, PAR3 to PAR16, SIM4 to SIM9, JN6, ORC)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chorale.functions import evidence as E
from chorale.functions import similarity as S
from chorale.functions import strings as T
from chorale.plans.shared import Query, register
from chorale.plans.similar import ORACLE as SIMILAR_SQL
from chorale.plans.similar import _PAIRS, _pairs, jn07_best_match
from chorale.plans.texts import q
from chorale.plans.evidence import _key
from chorale.sources.tables import table

QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}

#: Calls a minute and burst of the limiter. 0.8 of 60, and 3.
PER_MINUTE, BURST = 48, 3


def st04_limited(spark: SparkSession, d: str) -> DataFrame:
    """Seconds each call of a user waits under a token bucket, all calls kept.

    The time at which a call may go is the running maximum of (time - place * interval) plus place *
    interval: a window without state beyond a maximum, so no group is held in memory.
    """
    gap = 60.0 * 60.0 / PER_MINUTE
    t = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = table(spark, d, "events").select("event_id", "user_id", "ts", t.alias("t"), (F.row_number().over(w) - 1).alias("k"))
    start = F.max(F.col("t") - F.col("k") * gap).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)) + F.col("k") * gap
    return e.select("event_id", F.round(F.greatest(F.lit(0.0), start - (BURST - 1) * gap - F.col("t")), 3).alias("wait_seconds"))


def par16_staged_names(spark: SparkSession, d: str) -> DataFrame:
    """Release artists by the first stage that finds them among video artists: equal, alike, none. Only what is left goes on."""
    names = table(spark, d, "discogs_data").select(F.lower(T.plain_ascii("artist_name")).alias("query")).where("query <> ''").distinct()
    known = table(spark, d, "videos").select(F.lower(T.plain_ascii("artist")).alias("k")).where("k <> ''").distinct()
    equal = names.join(known, F.col("query") == F.col("k"), "left_semi")
    left = names.join(known, F.col("query") == F.col("k"), "left_anti")
    best = jn07_best_match(spark, d).select("query", "candidate")
    rest = left.join(best, "query", "left").select("query", F.when(F.col("candidate").isNotNull(), "alike").otherwise("none").alias("stage"))
    return equal.select("query", F.lit("equal").alias("stage")).unionByName(rest)


def sim04_combined(spark: SparkSession, d: str) -> DataFrame:
    """Four fifths by letters and one by sound."""
    sound = F.greatest((T.sound("a") == T.sound("b")).cast("double"), (T.short_sound("a") == T.short_sound("b")).cast("double"))
    return _pairs(spark, d, "artist", "artist_name").select("a", "b", F.round(S.mixed_similarity(T.normal_name("a"), T.normal_name("b")) * 0.8 + sound * 0.2, 6).alias("score"))


def sim08_variants(spark: SparkSession, d: str) -> DataFrame:
    """Whether one name's telling words lie within the other's."""
    return _pairs(spark, d, "artist", "artist_name").select("a", "b", E.key_overlap(F.col("a"), F.col("b")).alias("variant"))


def num05_cosine_to_first(spark: SparkSession, d: str) -> DataFrame:
    """Cosine of every vector to the first one of its label."""
    e = table(spark, d, "embeddings")
    first = e.groupBy("label").agg(F.min_by("embedding", "vec_id").alias("first"))
    return e.join(first, "label").select("vec_id", F.round(S.cosine("embedding", "first"), 5).alias("cosine"))


def jn06_columns(spark: SparkSession, d: str) -> DataFrame:
    """Columns and types of all tables, from their schemas alone."""
    rows = [(t, f.name, f.dataType.simpleString(), i) for t in ("videos", "channels", "video_features", "discogs_data", "ryd_data", "documents") for i, f in enumerate(table(spark, d, t).schema.fields)]
    return spark.createDataFrame(rows, "table_name string, column_name string, type string, place int")


QUERIES |= {f.__name__: f for f in (st04_limited, par16_staged_names, sim04_combined, sim08_variants, num05_cosine_to_first, jn06_columns)}
_gap = 60.0 * 60.0 / PER_MINUTE
_wd = "PARTITION BY user_id ORDER BY ts, event_id"
_with_b = SIMILAR_SQL["jn07_best_match"].split(" SELECT query, candidate, score FROM (SELECT *, row_number()")[0]
ORACLE |= {
    "st04_limited": f"SELECT event_id, round(greatest(0.0::DOUBLE, s - {(BURST - 1) * _gap}::DOUBLE - t), 3) AS wait_seconds FROM (SELECT event_id, t, max(t - k * {_gap}::DOUBLE) OVER ({_wd} ROWS UNBOUNDED PRECEDING) + k * {_gap}::DOUBLE AS s FROM (SELECT event_id, user_id, ts, epoch_us(ts) / 1e6::DOUBLE AS t, row_number() OVER ({_wd}) - 1 AS k FROM events))",
    "par16_staged_names": f"{_with_b}, n AS (SELECT DISTINCT lower({{0}}) AS query FROM discogs_data) SELECT query, CASE WHEN lower(query) IN (SELECT lower({{1}}) FROM videos WHERE artist IS NOT NULL) THEN 'equal' WHEN query IN (SELECT query FROM b) THEN 'alike' ELSE 'none' END AS stage FROM n WHERE query <> ''",
    "sim08_variants": f"WITH {_PAIRS} SELECT a, b, x <> '' AND y <> '' AND (contains(x, y) OR contains(y, x)) AS variant FROM (SELECT a, b, {_key('a')} AS x, {_key('b')} AS y FROM pairs)",
    "num05_cosine_to_first": "SELECT vec_id, round(list_cosine_similarity(embedding::DOUBLE[], f::DOUBLE[]), 5) AS cosine FROM embeddings JOIN (SELECT label, arg_min(embedding, vec_id) AS f FROM embeddings GROUP BY 1) USING (label)",
}


def _fill(text: str) -> str:
    from chorale.plans.similar import _ascii

    return text.replace("{0}", _ascii("artist_name")).replace("{1}", _ascii("artist"))


ORACLE["par16_staged_names"] = _fill(ORACLE["par16_staged_names"])

register(
    QUERIES,
    ORACLE,
    {
        "orc18_summary": "SELECT event_type, 'calls ' || CAST(n AS VARCHAR(20)) || ', users ' || CAST(u AS VARCHAR(20)) AS summary FROM (SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS u FROM {events} GROUP BY event_type) e",
        "orc20_first_channels": "SELECT channel_id, channel_name FROM (SELECT channel_id, max(channel_name) AS channel_name FROM {channels} WHERE channel_id IS NOT NULL GROUP BY channel_id) c ORDER BY channel_name NULLS LAST, channel_id LIMIT 10",
        "par19_release_ladder": "SELECT video_id, record_id, confidence FROM (SELECT video_id, record_id, confidence, row_number() OVER (PARTITION BY video_id ORDER BY confidence DESC, record_id) AS rn, count(*) OVER (PARTITION BY video_id) AS n FROM {discogs_data} WHERE video_id IS NOT NULL AND confidence BETWEEN 0.3 AND 1) x WHERE rn = 1 AND (n <= 3 OR confidence >= 0.6)",
    },
)

# the same from the checking engine's own catalogue, its type names turned into Spark's
ORACLE["jn06_columns"] = "SELECT table_name, column_name, CASE data_type WHEN 'BIGINT' THEN 'bigint' WHEN 'INTEGER' THEN 'int' WHEN 'VARCHAR' THEN 'string' WHEN 'DOUBLE' THEN 'double' WHEN 'BOOLEAN' THEN 'boolean' WHEN 'TIMESTAMP' THEN 'timestamp_ntz' ELSE lower(data_type) END AS type, (ordinal_position - 1)::INT AS place FROM information_schema.columns WHERE table_name IN ('videos', 'channels', 'video_features', 'discogs_data', 'ryd_data', 'documents')"
