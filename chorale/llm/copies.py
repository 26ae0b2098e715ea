"""Duplicates hidden by formatting differences (problem 5).

Method: canonical records are range-partitioned by their full key and id and sorted; each task scans its
sorted rows for runs of equal keys. As the id is part of the range, a key that holds a third of all rows
is spread over many tasks; a run that goes on in the next partition is joined up by the boundary runs,
of which there are at most two per partition.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chorale.functions.text import letters
from chorale.plans.stage import staged

_RUNS = "part int, run long, first_id long, record_id long, bound_key string"


def canonical_key(fields: list[Column | str]) -> Column:
    """The letters of the fields, in sorted order, so that field order doesn't count; null if any is null."""
    parts = F.array(*[letters(f) for f in fields])
    return F.when(F.forall(parts, lambda x: x.isNotNull()), F.array_join(F.array_sort(parts), "\u0001"))


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """key, record_id in order -> the run of every row; at the end the first and last run with their keys."""
    part, run, key, first = TaskContext.get().partitionId(), -1, None, None
    bounds: dict[int, tuple[int, str]] = {}
    schema = pa.schema([("part", pa.int32()), ("run", pa.int64()), ("first_id", pa.int64()), ("record_id", pa.int64()), ("bound_key", pa.string())])
    for b in batches:
        n = b.num_rows
        if not n:
            continue
        keys, ids = b.column(0), b.column(1)
        starts = [True] if keys[0].as_py() != key else [False]
        new = pa.concat_arrays([pa.array(starts), pc.not_equal(keys.slice(1), keys.slice(0, n - 1))]) if n > 1 else pa.array(starts)
        at = new.to_numpy(zero_copy_only=False)
        runs = at.cumsum() + run
        where = at.nonzero()[0]
        heads = ids.to_numpy()[where]
        if not at[0]:
            heads = [first, *heads]
            of = runs - run
        else:
            of = runs - run - 1
        heads = pa.array(heads, pa.int64())
        firsts = heads.take(pa.array(of, pa.int64()))
        if 0 not in bounds:
            bounds[0] = (ids[0].as_py(), keys[0].as_py())
        run, key, first = int(runs[-1]), keys[n - 1].as_py(), firsts[n - 1].as_py()
        yield pa.RecordBatch.from_arrays([pa.array([part] * n, pa.int32()), pa.array(runs, pa.int64()), firsts, ids, pa.nulls(n, pa.string())], schema=schema)
    if run >= 0:
        bounds[run] = (first, key)
        k = sorted(bounds)
        yield pa.RecordBatch.from_arrays(
            [pa.array([part] * len(k), pa.int32()), pa.array(k, pa.int64()), pa.array([bounds[i][0] for i in k], pa.int64()), pa.nulls(len(k), pa.int64()), pa.array([bounds[i][1] for i in k], pa.string())], schema=schema
        )


def copy_runs(df: DataFrame, key: Column, record: str = "record_id") -> DataFrame:
    """first_record_id, record_id of every row with a key: the smallest id of its set of copies.

    Rows with a null key or id are in no set and don't come out; a repeated id comes out as often as it is
    there; an empty table gives an empty one. Keys are compared in full, whatever their length.
    """
    keyed = df.select(key.alias("key"), F.col(record).cast("long").alias("record_id")).where("key is not null and record_id is not null")
    runs = keyed.repartitionByRange("key", "record_id").sortWithinPartitions("key", "record_id").mapInArrow(_scan, _RUNS)
    runs = staged(runs, "runs")
    bounds = runs.where("bound_key is not null").select("part", "run", F.min("first_id").over(Window.partitionBy("bound_key")).alias("joined_id"))
    rows = runs.where("bound_key is null").join(F.broadcast(bounds), ["part", "run"], "left")
    return rows.select(F.coalesce("joined_id", "first_id").alias("first_record_id"), "record_id")


def collapsed(df: DataFrame, key: Column, record: str = "record_id") -> DataFrame:
    """first_record_id and the exact number of copies (itself included) of every set."""
    return copy_runs(df, key, record).groupBy("first_record_id").agg(F.count(F.lit(1)).alias("copies"))
