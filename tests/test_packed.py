import pytest
from pyspark.sql import functions as F

from chorale.operators.packed import infer_delimiters, packed_values, split_packed

SIGNS = [",", ";", "|", "/", "·", "&", "\t", "\n"]

CASES = [
    ("A B, C D", ["A B", "C D"]), ("Rhythm and Sway, ", ["Rhythm and Sway"]), ('"A, B & C" , D;E', ["A, B & C", "D", "E"]), ("A,, B,\tC , ;", ["A", "B", "C"]),
    ('["A", "B \\"x\\" C", "Caf\\u00e9"]', ["A", 'B "x" C', "Café"]), ("['A', \"O'Neil\", 'D\\'E']", ["A", "O'Neil", "D'E"]), ('"Ada ""M"" B";"C"', ['Ada "M" B', "C"]), ("[]", []), ("  ", []), (None, []),
    ("O'Hara / Post-Skiffle", ["O'Hara", "Post-Skiffle"]), ('"A, B', ['"A', "B"]), ('["A", ]', ["A"]), ("x" * 100_000 + ";y", ["x" * 100_000, "y"]), ('""', []), ("A\nB", ["A", "B"]), ('["A, B", "C"]', ["A, B", "C"]),
]


@pytest.mark.parametrize("text,values", CASES)
def test_values(spark, text, values):
    df = spark.createDataFrame([(text,)], "f string")
    assert df.select(packed_values("f", SIGNS).alias("v")).collect()[0].v == values


def test_delimiters_inferred_over_all_rows(spark):
    names = ["Ann Lee", "Bo Ray", "Cy-Dee Fox", "O'Day", "J. R. Kay"]
    rows = [(names[i % 5] + sep + names[(i + 1) % 5],) for i in range(200) for sep in (", ", ",", "; ", ";", " / ", "/")] + [(n,) for n in names] * 20 + [(None,), ("",)]
    used, scores = infer_delimiters(spark.createDataFrame(rows, "f string"), "f")
    assert {",", ";", "/"} <= set(used) and not {"-", "'", "."} & set(used)
    assert next(s for s in scores if s.delimiter == ",").consistency == 1


def test_positions_repeats_and_clashing_names(spark):
    df = spark.createDataFrame([(1, "a,b", "old", "old"), (1, "a,b", "old", "old"), (2, None, "old", "old")], "id long, f string, pos string, item_value string")
    got = split_packed(df, "f", [","])
    assert sorted((r.id, r.pos, r.item_value) for r in got.collect()) == [(1, 1, "a"), (1, 1, "a"), (1, 2, "b"), (1, 2, "b")]
    assert split_packed(df.where(F.lit(False)), "f").count() == 0
