"""Written results: JSON exports, a key-value cache with expiry, backups and swapped tables (SNK5, SNK6, MIG7, MIG8, MIG11)."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def export_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def put_cache(spark: SparkSession, path: str, entries: DataFrame) -> None:
    """Adds entries (key, value, created_at, ttl_seconds); an older entry of a key is outlived, not changed."""
    entries.select("key", "value", "created_at", "ttl_seconds").write.mode("append").parquet(path)


def cached(spark: SparkSession, path: str, as_of: str, most: int | None = None) -> DataFrame:
    """The latest entry of every key that has not expired; the `most` most recent ones where that is given."""
    w = Window.partitionBy("key").orderBy(F.desc("created_at"), "value")
    e = spark.read.parquet(path).withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")
    e = e.where(F.unix_timestamp(F.lit(as_of).cast("timestamp")) - F.unix_timestamp(F.col("created_at").cast("timestamp")) <= F.col("ttl_seconds"))
    return e.orderBy(F.desc("created_at"), "key").limit(most) if most else e


def replace_table(spark: SparkSession, df: DataFrame, path: str, keep: bool = True) -> str | None:
    """Writes df beside the table and swaps folders; a reader sees the old table or the new one. Returns the backup's path."""
    new, old = f"{path}.new-{uuid.uuid4().hex[:8]}", f"{path}.backup-{uuid.uuid4().hex[:8]}"
    df.write.parquet(new)
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    there = hadoop.Path(path)
    fs = there.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    had = fs.exists(there)
    if had and not fs.rename(there, hadoop.Path(old)):
        raise OSError(f"{path} can't be moved")
    if not fs.rename(hadoop.Path(new), there):
        raise OSError(f"{new} can't be moved")
    if had and not keep:
        fs.delete(hadoop.Path(old), True)
    return old if had and keep else None


def evolved(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Tables of several ages as one: a column that an older one lacks is null there."""
    return spark.read.option("mergeSchema", "true").parquet(*paths)
