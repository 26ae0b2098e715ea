"""Readers of what connectors leave behind: hits, pages, catalogue answers, channel lists (SRC, ORC2, ORC3, JS3, JS4).

Live services are reached by whatever fills the landing folder; the engine reads files, so a run can be
repeated. Hits can also be read by name through Spark's Python data source interface.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from chorale.functions.strings import seconds_of, stripped

HITS = "id string, title string, uploader string, uploader_id string, duration double, view_count long, upload_date string, description string"
RECORDINGS = "id string, title string, score int, length long, `artist-credit` array<struct<name: string, artist: struct<id: string, name: string>>>, releases array<struct<date: string>>, tags array<struct<name: string, count: int>>"
RELEASES = "id long, master_id long, title string, artist string, year int, genre array<string>, style array<string>, label array<string>, country string, format array<string>, barcode array<string>, catno string"


class HitSource(DataSource):
    """Format "landed_hits": a folder of JSON lines, one partition for each file."""

    @classmethod
    def name(cls) -> str:
        return "landed_hits"

    def schema(self) -> str:
        return HITS

    def reader(self, schema) -> DataSourceReader:
        return _HitReader(self.options["path"], [f.name for f in schema.fields])


class _HitReader(DataSourceReader):
    def __init__(self, path: str, columns: list[str]):
        self.path, self.columns = path.removeprefix("file://"), columns

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(str(p)) for p in sorted(Path(self.path).glob("*.json*"))]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        kinds = {"duration": float, "view_count": int}
        with open(partition.value, encoding="utf-8") as f:
            for line in f:
                try:
                    row = json.loads(line)
                except ValueError:
                    continue  # a broken line is no hit
                if isinstance(row, dict):
                    yield tuple(None if row.get(c) is None else kinds.get(c, str)(row[c]) for c in self.columns)


def landed_hits(spark: SparkSession, folder: str) -> DataFrame:
    """Hits of a folder of JSON lines; lines that can't be read are left out."""
    return spark.read.schema(HITS).option("mode", "DROPMALFORMED").json(folder)


def normal_hits(hits: DataFrame, watch: str = "https://vids.example/watch?v=") -> DataFrame:
    """Hits with an id, with defaults for what is missing."""
    return hits.where("id <> ''").select(
        F.col("id").alias("video_id"), F.concat(F.lit(watch), "id").alias("url"), F.coalesce("title", F.lit("")).alias("title"), F.coalesce("uploader", F.lit("")).alias("channel"), F.coalesce("uploader_id", F.lit("")).alias("channel_id"),
        F.col("duration").cast("long").alias("duration"), F.coalesce("view_count", F.lit(0)).alias("view_count"), "upload_date", "description",
    )


def only_sections(entries: DataFrame, key: str = "channel") -> DataFrame:
    """Channels whose listing has five entries at most that all lack a duration: sections, to be read again."""
    return entries.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.max(F.coalesce("duration", F.lit(0))).alias("longest")).where("n <= 5 and longest = 0").select(key)


def channel_list(spark: SparkSession, path: str) -> DataFrame:
    """Channels of a text file, one a line; blank lines and lines after # don't count."""
    line = stripped("value")
    return spark.read.text(path).select(line.alias("channel")).where("channel <> '' and not startswith(channel, '#')")


def links_in_pages(pages: DataFrame, html: str = "html") -> DataFrame:
    """pos, linked_id, linked_title, seconds of every watch link of a page: anchors with their text, and the duration next after each."""
    pieces = F.expr(f"slice(split({html}, '(?i)<a '), 2, 100000)")
    p = pages.select(*[c for c in pages.columns if c != html], F.posexplode(pieces).alias("pos", "__a"))
    found = p.select(
        *[c for c in p.columns if c != "__a"],
        F.nullif(F.regexp_extract("__a", r"(?i)href=\"[^\"]*watch\?v=([A-Za-z0-9_-]{11})", 1), F.lit("")).alias("linked_id"),
        stripped(F.regexp_extract("__a", r"(?is)^[^>]*>([^<]*)<", 1)).alias("linked_title"),
        F.nullif(F.regexp_extract("__a", r"(\d+:\d{2}(?::\d{2})?)", 1), F.lit("")).alias("__d"),
    )
    return found.where("linked_id is not null").withColumn("seconds", F.when(F.col("__d").isNotNull(), seconds_of("__d"))).drop("__d")


def recordings(spark: SparkSession, folder: str) -> DataFrame:
    """Catalogue recordings with their credits joined, the first artist's id and the earliest year."""
    r = spark.read.schema(RECORDINGS).json(folder)
    years = F.transform("releases", lambda x: F.nullif(F.regexp_extract(x["date"], r"^(\d{4})", 1), F.lit("")).try_cast("int"))
    return r.select(
        "id", "title", F.coalesce(F.col("score"), F.lit(0)).alias("score"), F.array_join(F.transform("artist-credit", lambda x: x["name"]), ", ").alias("artist"), F.get(F.col("artist-credit"), F.lit(0))["artist"]["id"].alias("artist_id"),
        F.array_min(F.filter(years, lambda y: y.between(1900, 2100))).alias("first_year"), F.to_json(F.slice(F.transform("tags", lambda x: x["name"]), 1, 20)).alias("tags"), (F.col("length") / 1000).cast("long").alias("seconds"),
    )


def split_release_title(artist: Column, title: Column) -> tuple[Column, Column]:
    """Artist and title of a release whose artist may stand in its title ('A - T')."""
    parts = F.split(title, " - ", 2)
    missing = artist.isNull() | F.lower(artist).isin("", "various", "various artists")
    own = F.when(missing & (F.size(parts) == 2), F.get(parts, F.lit(0))).otherwise(artist)
    rest = F.when(F.size(parts) == 2, F.when(missing | (F.lower(F.get(parts, F.lit(0))) == F.lower(artist)), F.get(parts, F.lit(1)))).otherwise(F.lit(None))
    return stripped(own), stripped(F.coalesce(rest, title))


def releases(spark: SparkSession, folder: str) -> DataFrame:
    """Catalogue releases, one row each, with lists joined."""
    r = spark.read.schema(RELEASES).json(folder)
    artist, title = split_release_title(F.col("artist"), F.col("title"))
    return r.select("id", "master_id", artist.alias("artist"), title.alias("title"), "year", F.get("label", F.lit(0)).alias("label"), F.get("format", F.lit(0)).alias("format"), F.array_join("genre", ", ").alias("genres"), F.array_join("style", ", ").alias("styles"), F.array_join("barcode", ", ").alias("barcodes"), "country", "catno")
