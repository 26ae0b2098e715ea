import json
import random

from pyspark.sql import functions as F

from chorale.functions.strings import clock, seconds_of
from chorale.operators.packed import packed_values
from chorale.plans.store import upsert

SIGNS = [",", ";", "|", "/", "·", "&", "\t", "\n"]


def test_packed_values_come_back_as_they_went_in(spark):
    rng = random.Random(11)
    atoms = ["Ann", "Bo Ray", "O'Day", "Cy-Dee", "Né", "J. R. K", "A, B", "C & D", "E/F", 'The "Moth" One', "x;y", "(live)"]
    rows = []
    for i in range(600):
        values = [rng.choice(atoms) for _ in range(rng.randint(0, 6))]
        form = rng.choice(["json", "python", "plain", "quoted"])
        if form == "json":
            text = json.dumps(values, ensure_ascii=rng.random() < 0.5)
        elif form == "python":
            text = str(values)
        else:
            sign = rng.choice(SIGNS)
            must = lambda v: form == "quoted" or any(s in v for s in [*SIGNS, '"'])
            pad = lambda: rng.choice(["", " "])
            text = sign.join(pad() + ('"' + v.replace('"', '""') + '"' if must(v) else v) + pad() for v in values)
            text += rng.choice(["", sign, f" {sign} {sign}"])
        rows.append((i, text, values))
    df = spark.createDataFrame([r[:2] for r in rows], "i int, f string").repartition(4)
    got = {r.i: r.v for r in df.select("i", packed_values("f", SIGNS).alias("v")).collect()}
    assert [(i, t, got[i]) for i, t, v in rows if got[i] != v] == []


def test_durations_come_back(spark):
    df = spark.range(0, 360_000, 977).withColumnRenamed("id", "s")
    assert df.where(seconds_of(clock("s")) != F.col("s")).count() == 0


def test_upsert_of_random_batches_equals_a_dictionary(spark):
    rng = random.Random(2)
    stored: dict[int, str] = {}
    table = spark.createDataFrame([], "k int, v string, n int")
    for n in range(4):
        batch = [(rng.randrange(30), f"{n}-{j}", j) for j in range(20)]
        for k, v, _ in batch:
            stored[k] = v
        table = upsert(table, spark.createDataFrame(batch, "k int, v string, n int"), ["k"], [F.desc("n")])
    assert {r.k: r.v for r in table.collect()} == stored
