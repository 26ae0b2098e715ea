"""Queries whose text means the same to Spark SQL and to the checking engine.

A text names its tables in braces; Spark binds them to DataFrames (no views are left behind in the
session), the checking engine gets the bare names.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from chorale.sources.tables import table

Query = Callable[[SparkSession, str], DataFrame]


def tables_of(text: str) -> list[str]:
    return sorted(set(re.findall(r"\{(\w+)\}", text)))


def spark_query(text: str, doc: str = "") -> Query:
    def run(spark: SparkSession, d: str) -> DataFrame:
        return spark.sql(text, **{t: table(spark, d, t) for t in tables_of(text)})

    run.__doc__ = doc or " ".join(text.split())
    return run


def plain_sql(text: str) -> str:
    return re.sub(r"\{(\w+)\}", r"\1", text)


def register(queries: dict[str, Query], oracle: dict[str, str], texts: dict[str, str]) -> None:
    for name, text in texts.items():
        queries[name] = spark_query(text)
        oracle[name] = plain_sql(text)
