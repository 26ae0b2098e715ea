from datetime import datetime as T

from chorale.operators.references import orphan_references

REFS = "table_name string, ref_kind string, ref_key string, ref_time timestamp, record_id long, known_from string, status string"
KNOWN = "ref_kind string, ref_key string, known_from timestamp, gone_from timestamp"


def refs(spark, rows):
    return spark.createDataFrame([(*r, "clash", "clash") for r in rows], REFS)


def test_missing_early_deleted_and_ties(spark):
    known = spark.createDataFrame([("v", "a", T(2024, 1, 5), None), ("v", "a", T(2024, 1, 9), None), ("v", "b", T(2024, 1, 1), T(2024, 2, 1)), (None, None, None, None)], KNOWN)
    rows = [
        ("t", "v", "a", T(2024, 1, 5), 1), ("t", "v", "a", T(2024, 1, 4), 2), ("t", "v", "b", T(2024, 2, 1), 3), ("t", "v", "b", T(2024, 1, 31), 4),
        ("t", "v", "x", T(2024, 1, 1), 5), ("t", "v", None, T(2024, 1, 1), 6), ("t", "v", "A", T(2024, 3, 1), 7), ("t", "v", "x", None, 8), ("t", "v", "a", None, 9), ("t", "v", "x", T(2024, 1, 1), 5),
    ]
    for hot in (1, 1000):  # all keys by broadcast, all by shuffle
        got = sorted((r.record_id, r.status) for r in orphan_references(refs(spark, rows), known, hot_rows=hot).collect())
        assert got == [(2, "early"), (3, "deleted"), (5, "missing"), (5, "missing"), (7, "missing"), (8, "missing")]


def test_empty_tables(spark):
    none = spark.createDataFrame([], KNOWN)
    assert orphan_references(refs(spark, []), none).count() == 0
    assert orphan_references(refs(spark, [("t", "v", "a", T(2024, 1, 1), 1)]), none).collect()[0].status == "missing"


def test_hot_key_among_many(spark):
    rows = [("t", "v", "hot", T(2024, 1 + i % 3, 1), i) for i in range(600)] + [("t", "v", f"k{i}", T(2024, 1, 1), 1000 + i) for i in range(300)]
    known = spark.createDataFrame([("v", "hot", T(2024, 2, 1), None)], KNOWN)
    got = orphan_references(refs(spark, rows), known, hot_rows=100, hot_keys=2)
    assert got.count() == 200 + 300 and got.where("ref_key = 'hot'").count() == 200
