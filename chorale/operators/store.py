"""Upserts and merges of stored tables, as plans over DataFrames (SNK, PRJ6)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def upsert(stored: DataFrame, batch: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row per key: of the batch where it has the key, else of what is stored; the first in `order` of several."""
    both = stored.withColumn("__new", F.lit(0)).unionByName(batch.withColumn("__new", F.lit(1)), allowMissingColumns=True)
    w = Window.partitionBy(*keys).orderBy(F.desc("__new"), *order)
    return both.withColumn("__rank", F.row_number().over(w)).where("__rank = 1").drop("__rank", "__new")


def insert_absent(stored: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """What is stored, and one row for each key of `rows` that is not; rows with a null key are left out."""
    new = rows.dropna(subset=keys).dropDuplicates(keys).join(stored.select(*keys), keys, "left_anti")
    return stored.unionByName(new, allowMissingColumns=True)


def merged_sources(own: DataFrame, releases: DataFrame) -> DataFrame:
    """Per video the evidence of its most confident record and release.

    Artist and song are taken from the more confident side (a tie goes to the record) and filled from the
    other; year and genre rather from the release; the confidence is 0.6 and 0.4 of both where both are.
    """

    def best(df: DataFrame, conf: str, fields: dict[str, str]) -> DataFrame:
        w = Window.partitionBy("video_id").orderBy(F.desc(conf), "record_id")
        return df.withColumn("__rank", F.row_number().over(w)).where("__rank = 1").select("video_id", F.col(conf).alias("c"), *[F.nullif(F.col(c), F.lit("" if t == "string" else 0)).alias(n) for n, c in fields.items() for t in [dict(df.dtypes)[c]]])

    a = best(own, "parse_confidence", {"artist": "artist", "song_title": "song_title", "year": "release_year", "genre": "genre"}).alias("a")
    b = best(releases, "confidence", {"artist": "artist_name", "song_title": "song_title", "year": "year", "genre": "styles"}).alias("b")
    both = a.join(b, "video_id", "full")
    other = F.col("a.c").isNull() | (F.col("b.c") > F.col("a.c"))
    pick = lambda f: F.when(other, F.coalesce(f"b.{f}", f"a.{f}")).otherwise(F.coalesce(f"a.{f}", f"b.{f}"))
    conf = F.when(F.col("a.c").isNotNull() & F.col("b.c").isNotNull(), F.col("a.c") * 0.6 + F.col("b.c") * 0.4).otherwise(F.coalesce("a.c", "b.c"))
    return both.select(
        "video_id", pick("artist").alias("artist"), pick("song_title").alias("song_title"), F.coalesce(F.col("b.year").cast("long"), F.col("a.year").cast("long")).alias("release_year"), F.coalesce("b.genre", "a.genre").alias("genre"),
        F.round(conf, 4).alias("confidence"), (F.col("a.c").isNotNull().cast("int") + F.col("b.c").isNotNull().cast("int")).alias("sources"),
    )
