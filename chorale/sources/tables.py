"""Readers of the Parquet tables the queries run over."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from chorale.plans.ship import shipped


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The whole table `name` of `folder`; columns are pruned by whoever selects from it."""
    shipped(spark)
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """A table of one file over all cores: one small file would be one task, whatever is done with each row.

    Tables of several files are left as they are, so nothing is moved where data is large.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if cores > 1 and len(df.inputFiles()) < 2 else df
