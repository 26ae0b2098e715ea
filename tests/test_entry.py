import __spark_entry__ as entry
from chorale.plans import store


def test_entry_and_names(spark):
    assert entry.entry(spark).count() > 0
    queries, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(queries) and len(queries) > 150


def test_upsert_is_idempotent(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y"), (2, "z")], "k int, v string")
    b = spark.createDataFrame([(2, "n"), (3, "m")], "k int, v string")
    from pyspark.sql import functions as F

    once = store.upsert(a, b, ["k"], [F.asc("v")])
    assert sorted(map(tuple, once.collect())) == [(1, "x"), (2, "n"), (3, "m")]
    assert sorted(map(tuple, store.upsert(once, b, ["k"], [F.asc("v")]).collect())) == [(1, "x"), (2, "n"), (3, "m")]
    assert store.insert_absent(a.limit(0), b, ["k"]).count() == 2
