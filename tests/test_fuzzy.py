import random

import pytest

from chorale.operators.fuzzy import edit_similar_pairs
from chorale.plans import similar


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def names_of(seed, n, letters):
    r = random.Random(seed)
    out = ["".join(r.choices(letters, k=r.randint(1, 16))) for _ in range(n)]
    for x in out[: n // 2]:  # edited ones, up to and beyond the bound
        y = list(x)
        for _ in range(r.randint(1, 5)):
            at = r.randrange(len(y) + 1)
            y[at : at + r.randint(0, 1)] = r.choices(letters, k=r.randint(0, 1))
        out.append("".join(y))
    return out


@pytest.mark.parametrize("least", [0.75, 0.8])
@pytest.mark.parametrize("letters", ["ab ", "abcdefghijk é", "aあ😀z"])
def test_all_pairs_of_random_names_in_one_cell_and_in_many(spark, least, letters):
    names = names_of(5, 160, letters)
    asked, known = names[::2] + ["", None], names[1::2] + names[:20] + [None, ""]
    expected = {(a, b) for a in asked for b in known if a and b and (1 - distance(a, b) / max(len(a), len(b))) >= least - 1e-9}
    df = lambda xs: spark.createDataFrame([(x,) for x in xs], "x string")
    for chunk in (1000, 23):
        got = [(r.a, r.b) for r in edit_similar_pairs(df(asked), df(known), least, chunk).collect()]
        assert len(got) == len(set(got)) and set(got) == expected


def test_names_with_a_part_in_common_are_no_rows_of_a_join(spark):
    # every two share most of their letters: candidates by a shared part were rows, 640,000 of them, before any check
    df = spark.createDataFrame([(f"{'%04d' % (i * 7919 % 9999)} the band {'%04d' % (i * 104729 % 9999)}",) for i in range(800)], "x string")
    pairs = edit_similar_pairs(df, df)
    assert "Join" not in pairs._jdf.queryExecution().toString()
    got = {(r.a, r.b) for r in pairs.collect()}
    names = [r.x for r in df.collect()]
    assert got == {(a, b) for a in names[:20] for b in names if distance(a, b) <= 0.2 * 18 + 1e-9} | {p for p in got if p[0] not in names[:20]}


def test_empty_side(spark):
    some, none = spark.createDataFrame([("a",)], "x string"), spark.createDataFrame([], "x string")
    assert edit_similar_pairs(some, none).count() == 0 and edit_similar_pairs(none, some).count() == 0


def test_titles_with_an_equal_run_are_not_compared_further(spark, monkeypatch):
    asked = []

    def pairs(a, known, least):
        asked.append(sorted({r.a for r in a.collect()}))
        return edit_similar_pairs(a, known, least)

    monkeypatch.setattr(similar, "edit_similar_pairs", pairs)
    titles = spark.createDataFrame([(1, "Anna Bell - Harbur Song"), (2, "Ana Belle Blue - Nobody"), (3, "none")], "record_id long, title string")
    artists, songs = (spark.createDataFrame([(x,) for x in xs], "n string") for xs in (["anna bell", "Anna Bell", "Anna Belle Blue"], ["Harbour Song", "", None]))
    got = sorted(map(tuple, similar.known_in_titles(titles, artists, songs).collect()))
    assert got == [(1, "Anna Bell", "Harbour Song", 0.9), (2, "Anna Belle Blue", None, 0.84)]
    assert asked == [["ana belle blue", "nobody"], ["ana belle blue", "anna bell", "harbur song", "nobody"]]
