"""References to records that do not exist (problem 2).

Method: references are pre-aggregated per key and period; keys with very many references (at most
`hot_keys` of them, so the broadcast has a fixed bound) are settled by a broadcast, all others by a
shuffled join of the keys that have an orphan in some period; both parts are united. A key that is left to
the shuffle has fewer references than each of the hot ones, so at most one in `hot_keys` + 1 of all; where
that is still too much for a task, adaptive execution splits its partition.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: At most so many keys are treated as hot; bounds every broadcast here.
HOT_KEYS = 256
#: A key with fewer references than this is never hot.
HOT_ROWS = 5_000

REF = ["ref_kind", "ref_key"]


def _orphan(at: Column) -> Column:
    """Not known at that time: never known, not yet, or no longer. A null time finds only what was never known."""
    return F.col("__known_from").isNull() | F.coalesce(at < F.col("__known_from"), F.lit(False)) | F.coalesce(at >= F.col("__gone_from"), F.lit(False))


def reference_status(at: Column | str = "ref_time") -> Column:
    """missing (never known), early (known only later), deleted, or ok."""
    at = F.col(at) if isinstance(at, str) else at
    return (
        F.when(F.col("__known_from").isNull(), "missing")
        .when(F.coalesce(at < F.col("__known_from"), F.lit(False)), "early")
        .when(F.coalesce(at >= F.col("__gone_from"), F.lit(False)), "deleted")
        .otherwise("ok")
    )


def orphan_references(refs: DataFrame, known: DataFrame, hot_rows: int = HOT_ROWS, hot_keys: int = HOT_KEYS) -> DataFrame:
    """The references that point to nothing known at their time.

    refs: table_name, ref_kind, ref_key, ref_time and any columns to keep. known: ref_kind, ref_key,
    known_from, gone_from (null: never removed); repeated keys are merged (earliest of each time).
    Out: the rows of refs concerned with `status` (missing, early, deleted; replaces a column of that name). Null keys are no
    references and never come out; repeated rows come out as often as they are there; a null ref_time
    finds only keys that were never known; an empty table of known keys makes every reference missing.
    """
    refs = refs.where(F.col("ref_key").isNotNull())
    known = (
        known.where(F.col("ref_key").isNotNull())
        .groupBy(*REF)
        .agg(F.min("known_from").alias("__known_from"), F.min("gone_from").alias("__gone_from"))
        .where(F.col("__known_from").isNotNull())
    )
    period = F.date_trunc("month", "ref_time")
    per_period = refs.groupBy(*REF, period.alias("period")).agg(F.count(F.lit(1)).alias("n"), F.min("ref_time").alias("first"), F.max("ref_time").alias("last"))
    settled = per_period.join(known, REF, "left")
    # a period is free of orphans if both its ends are known times; then so is all between, as a key is known in one stretch
    per_key = settled.groupBy(*REF).agg(
        F.sum("n").alias("n"), F.min("__known_from").alias("__known_from"), F.min("__gone_from").alias("__gone_from"), F.max((_orphan(F.col("first")) | _orphan(F.col("last"))).cast("int")).alias("__any_orphan")
    )
    hot = per_key.where(F.col("n") >= hot_rows).orderBy(F.desc("n"), *REF).limit(hot_keys)
    hot_part = refs.join(F.broadcast(hot.select(*REF, "__known_from", "__gone_from", "__any_orphan")), REF, "inner").where("__any_orphan = 1")
    cold = per_key.where("__any_orphan = 1").select(*REF, "__known_from", "__gone_from")
    cold_part = refs.join(F.broadcast(hot.select(*REF)), REF, "left_anti").hint("shuffle_hash").join(cold, REF, "inner")
    both = hot_part.drop("__any_orphan").unionByName(cold_part)
    return both.withColumn("status", reference_status()).where("status <> 'ok'").drop("__known_from", "__gone_from")
