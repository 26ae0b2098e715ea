"""Best representative of each duplicate group (problem 1).

Method: records are ranked by trust, recency and a tie-break with window ordering and the top record of
each group is kept. Spark limits each group to its top row before the shuffle (WindowGroupLimit), so a
group that holds a third of all rows sends one row per task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def valid_confidence(c: Column | str) -> Column:
    """A confidence outside 0 to 1, null or NaN counts as missing (null)."""
    c = F.col(c) if isinstance(c, str) else c
    return F.when(c.between(0.0, 1.0) & ~F.isnan(c), c)


def completeness(columns: list[str]) -> Column:
    """How many of the columns are neither null nor blank."""
    filled = [F.when(F.trim(F.col(c).cast("string")) != "", 1).otherwise(0) for c in columns]
    return sum(filled[1:], filled[0]) if filled else F.lit(0)


def top_of_group(df: DataFrame, group: list[str], order: list[Column]) -> DataFrame:
    """One row per group: the first in `order`, which must be a total order for a result that never varies.

    Null group keys form a group of their own; repeated rows count once; an empty table stays empty.
    """
    rank = "__rank"
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where(F.col(rank) == 1).drop(rank)


def best_records(df: DataFrame, group: list[str], order: list[Column], record: str = "record_id", sources: dict[str, Column] | None = None, at_least: int = 1) -> DataFrame:
    """group, n, best_<record>, and for each name of `sources` the <record> it is taken from.

    The best record is the first of its group in `order`; a source is the first for which its condition
    holds (null where there is none). Groups of fewer than `at_least` rows are left out.
    """
    counts = df.groupBy(*group).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= at_least)
    out = counts.join(top_of_group(df, group, order).select(*group, F.col(record).alias(f"best_{record}")), group)
    for name, holds in (sources or {}).items():
        out = out.join(top_of_group(df.where(holds), group, order).select(*group, F.col(record).alias(name)), group, "left")
    return out


def sort_key(order: list[tuple[str, bool]], types: dict[str, str]) -> Column:
    """A struct whose smallest value comes first: (column, descending) in order of weight, nulls last.

    Numbers, dates, times and booleans can be descending, strings only ascending.
    """
    parts = []
    for k, (c, descending) in enumerate(order):
        v, kind = F.col(c), types[c]
        if kind.startswith(("timestamp", "date")):
            v = F.unix_micros(v.cast("timestamp"))
        elif kind == "boolean":
            v = v.cast("int")
        elif kind == "string" and descending:
            raise ValueError(f"{c} is a string; it can only be ascending")
        if kind in ("double", "float"):
            v = F.when(~F.isnan(v), v)
        parts += [v.isNull().alias(f"n{k}"), (-v if descending else v).alias(f"v{k}")]
    return F.struct(*parts)


def consolidated(df: DataFrame, group: list[str], fields: list[str], order: list[tuple[str, bool]]) -> DataFrame:
    """group, copies and the surviving record built field by field.

    order: (column, descending). Every field takes the value of the first record in that order where it is
    neither null nor blank; null where no record has one. Each field is an aggregate that combines before
    the shuffle, so a group of any size sends one row per task. Null group keys form a group; repeated rows
    count as copies; an empty table gives an empty one.
    """
    keyed = df.select(*group, *fields, sort_key(order, dict(df.dtypes)).alias("__key"))

    def first(c: str) -> Column:
        return F.min_by(F.col(c), F.when(F.trim(F.col(c).cast("string")) != "", F.col("__key"))).alias(c)

    return keyed.groupBy(*group).agg(F.count(F.lit(1)).alias("copies"), *[first(c) for c in fields])
