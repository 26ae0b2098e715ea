"""Structured Streaming forms of the incremental operators (ST): run over what is there, then read as tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chorale.plans.stage import shared_folder


def file_stream(spark: SparkSession, folder: str, name: str, files_per_batch: int = 4) -> DataFrame:
    """The Parquet table `name` of `folder` as a stream of its files."""
    path = f"{folder.rstrip('/')}/{name}.parquet"
    schema = spark.read.parquet(path).schema
    # a table of one file is found by its name in the folder, one of several is a folder itself
    single = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    is_file = single.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(single).isFile()
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch)
    return reader.option("pathGlobFilter", f"{name}.parquet").parquet(folder) if is_file else reader.parquet(path)


def drained(stream: DataFrame, mode: str, write: Callable[[DataFrame, str], None] | None = None) -> DataFrame:
    """What the stream gives for all there is now, as a table in the shared folder.

    complete: every batch replaces the table with the whole result; append: batches add to it.
    """
    spark = stream.sparkSession
    base = f"{shared_folder(spark)}/streams/{uuid.uuid4().hex}"
    out, marks = f"{base}/out", f"{base}/marks"

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/v={number}" if mode == "append" else out)

    stream.writeStream.outputMode(mode).option("checkpointLocation", marks).trigger(availableNow=True).foreachBatch(put).start().awaitTermination()
    got = spark.read.schema(stream.schema).option("basePath", out).parquet(*([f"{out}/v=*"] if mode == "append" else [out]))
    return got.select(*stream.columns)


def hourly(stream: DataFrame) -> DataFrame:
    """Events per hour and type; late events count as long as the watermark of a day lasts."""
    s = stream.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", "1 day").groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return s.select(F.col("w.start").cast("timestamp_ntz").alias("hour"), "event_type", "n", "total")


def first_seen(stream: DataFrame, keys: list[str]) -> DataFrame:
    """Each key once; the state holds keys only."""
    return stream.select(*keys).dropDuplicates(keys)


def structure_counts(stream: DataFrame) -> DataFrame:
    from chorale.functions.strings import structure

    return stream.where("channel_id is not null").select("channel_id", structure("title").alias("structure")).where("structure is not null").groupBy("channel_id", "structure").agg(F.count(F.lit(1)).alias("n"))
