import itertools
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from chorale.llm.copies import canonical_key, collapsed, copy_runs
from chorale.llm.graph import components
from chorale.llm.matching import matches, title_parts
from chorale.llm.names import _POSTING, SLOTS, _candidates, _keys, _vector, average_linkage, cosine, explicable, grouped, link_keys, name_clusters, name_pairs, plain_words, slips, sparse_linkage
from chorale.llm import matching
from chorale.llm.near import group_pairs, near_duplicate_groups, normal_text, trigrams
from chorale.llm.representatives import best_records, completeness, consolidated, valid_confidence


def test_best_records_ties_nulls_and_sources(spark):
    rows = [("a", 0.9, 1, 1, 1990), ("a", 0.9, 1, 2, None), ("a", 2.0, 9, 3, 2000), ("b", None, None, 4, None), ("b", float("nan"), None, 5, None), (None, 0.1, 1, 6, 1), ("c", 0.5, 1, 7, 1)]
    df = spark.createDataFrame(rows, "g string, c double, t int, record_id long, y int").withColumn("c", valid_confidence("c"))
    order = [F.desc_nulls_last("c"), F.desc_nulls_last("t"), F.desc("record_id")]
    got = {r.g: (r.n, r.best_record_id, r.src) for r in best_records(df, ["g"], order, sources={"src": F.col("y").isNotNull()}, at_least=2).collect()}
    assert got == {"a": (3, 2, 1), "b": (2, 5, None)}
    assert best_records(df.limit(0), ["g"], order).count() == 0


def test_consolidated_takes_fields_one_by_one(spark):
    df = spark.createDataFrame([("a", 1, None, "x", 1), ("a", 2, "t", " ", 1), ("a", 3, "u", "y", 1), ("b", 1, None, None, 1)], "g string, k int, p string, q string, n int")
    assert sorted(map(tuple, consolidated(df, ["g"], ["p", "q"], [("k", False)]).collect())) == [("a", 3, "t", "x"), ("b", 1, None, None)]
    assert sorted(map(tuple, consolidated(df, ["g"], ["p"], [("k", True)]).collect())) == [("a", 3, "u"), ("b", 1, None)] and consolidated(df.limit(0), ["g"], ["p"], [("k", True)]).count() == 0
    with pytest.raises(ValueError):
        consolidated(df, ["g"], ["p"], [("p", True)])
    assert df.select(completeness(["p", "q"]).alias("c")).agg(F.sum("c")).collect()[0][0] == 4


@pytest.mark.parametrize("parts", ["1", "3", "7"])
def test_copy_runs_against_brute_force(spark, parts):
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        rng = random.Random(5)
        forms = [lambda s: s, str.upper, lambda s: f"  {s}! ", lambda s: s.replace(" ", "-")]
        rows = [(i, rng.choice(forms)(rng.choice(["hot one", f"k {rng.randrange(40)}"])), rng.choice(["s", "S "])) for i in rng.sample(range(10_000), 600)] + [(None, "hot one", "s"), (20_000, None, "s"), (20_001, "", ""), (20_002, "x" * 50_000, "s"), (20_003, "X" * 50_000, "s")]
        rows = [(i, b, a) if i and i % 7 == 0 else (i, a, b) for i, a, b in rows]
        df = spark.createDataFrame([(*r, "clash") for r in rows], "record_id long, a string, b string, part string")
        norm = lambda s: "".join(ch for ch in s.lower() if ch.isalnum())
        first: dict = {}
        for i, a, b in sorted((r for r in rows if r[0] is not None and r[1] is not None and r[2] is not None)):
            first.setdefault(tuple(sorted((norm(a), norm(b)))), []).append(i)
        want = {(ids[0], i) for ids in first.values() for i in ids}
        assert {(r.first_record_id, r.record_id) for r in copy_runs(df, canonical_key(["a", "b"])).collect()} == want
        assert {(r.first_record_id, r.copies) for r in collapsed(df, canonical_key(["a", "b"])).collect()} == {(ids[0], len(ids)) for ids in first.values()}
        assert copy_runs(df.limit(0), canonical_key(["a", "b"])).count() == 0
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_components_of_chains_stars_and_loops(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(7, 7), (1, 0), (500, 501)]
    got = dict(map(tuple, components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert all(got[i] == 0 for i in range(41)) and all(got[100 + i] == 100 for i in range(30)) and got[501] == 500
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def brute_groups(rows, threshold=0.75):
    grams = [trigrams(r[1] or "") for r in rows]
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    apart = lambda i, j: rows[i][2] != rows[j][2] and (rows[i][3] is None or rows[i][3] != rows[j][3])
    for i, j in itertools.combinations(range(len(rows)), 2):
        both = len(grams[i] & grams[j])
        if both and apart(i, j) and both / len(grams[i] | grams[j]) >= threshold:
            parent[root(i)] = root(j)
    return {tuple(sorted((rows[i][0], rows[j][0]))) for i, j in itertools.combinations(range(len(rows)), 2) if root(i) == root(j) and apart(i, j)}


@pytest.mark.parametrize(("seed", "hot", "levels"), [(1, 50_000, 3), (3, 12, 3), (4, 12, 1), (5, 30, 0)])
def test_near_duplicates_against_brute_force(spark, seed, hot, levels):
    """Regions whole, split by further pivots, and split into pairs of chunks give all links."""
    rng = random.Random(seed)
    words = ["".join(rng.choices("abdeiklmnorstu", k=rng.randint(3, 8))) for _ in range(60)]
    base = [" ".join(rng.choices(words, k=rng.randint(4, 9))) for _ in range(25)]
    rows = []
    for i in range(220):
        t = base[0] if i % 3 == 0 else rng.choice(base)
        for _ in range(rng.choice([0, 0, 1, 2])):
            k = rng.randrange(len(t))
            t = t[:k] + rng.choice(["", "x", " "]) + t[k + 1 :]
        rows.append((i, t, rng.randrange(60), rng.choice([None, None, rng.randrange(30)])))
    rows += [(900, "", 1, None), (901, "ab", 2, None), (902, "ab", 3, None), (903, "zzzz", 4, None), (904, "zzzzz", 5, None), (905, "\U0001f3b5 na na \U0001f3b6", 6, None), (906, "\U0001f3b5 na na \U0001f3b6 na", 7, None)]
    df = spark.createDataFrame([(*r, 0, 0) for r in rows], "record_id long, text string, video long, ckey long, nv int, cid long")
    assert {(r.record_a, r.record_b) for r in group_pairs(near_duplicate_groups(df, hot=hot, levels=levels)).collect()} == brute_groups(rows)


def test_near_duplicates_of_common_words_with_one_changed(spark):
    words = ["barley", "copper", "dahlia", "ember"]
    rows = [(i, f"{i:05d}q " + " ".join(w for k, w in enumerate(words) if (i + k) % 5 or i % 2), i, None) for i in range(2000)]
    rows += [(9001, "barley copper dahlia endless evenings wonderful", 9001, None), (9002, "barlex copper dahlia endless evenings wonderful", 9002, None)]
    # the last words are common as well, so no rare word is shared
    rows += [(5000 + i, f"{i:05d}z endless evenings wonderful {i * 7919 % 100000:05d}", 5000 + i, None) for i in range(1800)]
    df = spark.createDataFrame(rows, "record_id long, text string, video long, ckey long")
    assert (9001, 9002) in {(r.record_a, r.record_b) for r in group_pairs(near_duplicate_groups(df)).collect()}


def test_near_duplicates_of_nothing_and_of_one_video(spark):
    schema = "record_id long, text string, video long, ckey long"
    assert near_duplicate_groups(spark.createDataFrame([], schema)).count() == 0
    same = spark.createDataFrame([(1, "the same words here", 5, None), (2, "the same words here", 5, None), (3, None, 6, None), (None, "x y z", 7, None)], schema)
    assert near_duplicate_groups(same).count() == 0
    assert spark.createDataFrame([("A-b", None, "C")], "a string, b string, c string").select(normal_text(["a", "b", "c"]).alias("t")).collect()[0].t == "a b c"


def test_slips_and_explicable():
    assert [slips("kitten", "kittne", 2), slips("abc", "abd", 1), slips("abcd", "ab", 1), slips("", "a", 1)] == [1, 1, 2, 1]
    assert explicable(["harriet", "konbrip"], ["h", "konbrip"]) and explicable(["l", "justirtusla", "bjorn"], ["bjorn", "justirtusla"])
    assert not explicable(["mara", "konbrip"], ["nora", "konbrip"], {"mara", "nora"}) and not explicable(["a"], ["b"]) and not explicable([], [])
    assert plain_words("  Søren O'Neil–Vale ") == ["soren", "oneil", "vale"] and plain_words("") == []


def test_average_linkage_against_definition():
    s = np.array([[0, 0.9, 0.1, 0], [0.9, 0, 0.5, 0], [0.1, 0.5, 0, 0], [0, 0, 0, 0]])
    label = average_linkage(s, 0.25)
    assert label[0] == label[1] == label[2] != label[3]  # (0.1 + 0.5) / 2 is enough
    assert len(set(average_linkage(s, 0.35)[:3])) == 2


def test_name_clusters(spark):
    names = ["Harriet Konbriplon"] * 5 + ["H. Konbriplon", "Konbriplon, Harriet", "Hattie Konbriplon", "HARRIET KONBRIPLNO", "Moss Dranvelkus", "Unknown Artist", None, "", "???", "The Velkus Trio", "Velkus + Trio", "Renée Plusbrer", "Renee Plusbrer"]
    clusters = name_clusters(spark.createDataFrame([(n, 1) for n in names], "name string, words int"))
    got = {(r.name_a, r.name_b) for r in name_pairs(clusters).collect()}
    one = sorted(["harrietkonbriplon", "hkonbriplon", "konbriplonharriet", "hattiekonbriplon", "harrietkonbriplno"])
    assert got == set(itertools.combinations(one, 2)) | {("thevelkustrio", "velkustrio"), ("reneeplusbrer", "renéeplusbrer")}
    assert name_pairs(name_clusters(spark.createDataFrame([], "name string"))).count() == 0


def test_link_keys_lead_to_all_explicable_pairs():
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abc") for _ in range(rng.choice([1, 1, 2, 3, 4, 5, 7])))
    seen = [0, 0]
    for _ in range(60_000):
        a = [word() for _ in range(rng.randint(1, 4))]
        b = [x[0] if rng.random() < 0.2 else x for x in a]
        if rng.random() < 0.7:
            k, i = rng.randrange(len(b)), rng.randrange(8)
            b[k] = b[k][:i] + rng.choice(["", "a", "b"]) + b[k][i + rng.randint(0, 1) :] or "a"
        if rng.random() < 0.2:
            b.append(rng.choice("abc"))
        a, b = sorted(a), sorted(b)
        if explicable(a, b, set(), 1):
            (a1, a2), (b1, b2) = link_keys(a), link_keys(b)
            initial = any(len(w) == 1 for w in a + b)
            assert a1 & b1 or initial and a2 & b2, (a, b)
            seen[initial] += 1
    assert min(seen) > 1000


def test_equal_words_of_names_are_paired_at_one_key():
    def pairs(*names):
        rows = sorted((k, word, n, any(len(w) == 1 for w in name.split())) for n, name in enumerate(names) for k, word in _keys(name.split())[1].items())
        batch = pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows), _POSTING)], schema=_POSTING)
        return sum(b.num_rows for b in _candidates(iter([batch])))

    assert pairs("gonlustozan samuel", "gonlustozan s") <= 2  # one key for each slip of the word before
    assert pairs("gonlustozan samuel", "gonlustosan s") >= 1 and pairs("gonlustozan samuel", "gonlustozan simon") == 0


def test_link_keys_lead_to_pairs_of_two_slips():
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abc") for _ in range(rng.choice([1, 1, 2, 3, 4, 5, 7, 9, 10])))
    seen = [0, 0]
    for _ in range(20_000):
        a = [word() for _ in range(rng.randint(1, 4))]
        b = [x[0] if rng.random() < 0.2 else x for x in a]
        for _ in range(2):
            k, i = rng.randrange(len(b)), rng.randrange(10)
            b[k] = b[k][:i] + b[k][i : i + 2][::-1] + b[k][i + 2 :] if rng.random() < 0.3 else b[k][:i] + rng.choice(["", "a", "b"]) + b[k][i + rng.randint(0, 1) :] or "a"
        a, b = sorted(a), sorted(b)
        if explicable(a, b):
            (a1, a2), (b1, b2) = link_keys(a), link_keys(b)
            initial = any(len(w) == 1 for w in a + b)
            assert a1 & b1 or initial and a2 & b2, (a, b)
            seen[initial] += 1
    assert min(seen) > 1000


def test_name_clusters_of_two_slips_and_of_short_words(spark):
    rng = random.Random(7)
    word = lambda n: "".join(rng.choice("bcdfghjklmnpqrstvwxz") for _ in range(n))
    pairs = [("Annika Thorwald", "Anniko Thorwold"), ("Vesterlundgard", "Vosterlundgerd"), ("J Marblequist", "Jon Marplequisd"), ("Kemp Oru", "Kepm Oru")]
    names = [word(10) for _ in range(500)] + [x for p in pairs for x in p]
    got = set(map(tuple, name_pairs(name_clusters(spark.createDataFrame([(n,) for n in names], "name string"))).collect()))
    letters = lambda x: x.lower().replace(" ", "")
    assert {tuple(sorted(map(letters, p))) for p in pairs} <= got


def test_name_clusters_of_frequent_n_grams(spark):
    rng = random.Random(4)
    word = lambda n: "".join(rng.choice("bcdfghjklmnpqrstvwxz") for _ in range(n))
    names = [f"vesterlu{word(6)}" for _ in range(320)] + [f"{word(7)}lund" for _ in range(9)] + [word(12) for _ in range(4000)] + ["vesterlund", "vesterlumd"]
    assert ("vesterlumd", "vesterlund") in set(map(tuple, name_pairs(name_clusters(spark.createDataFrame([(n,) for n in names], "name string"))).collect()))


def test_sparse_linkage_is_average_linkage():
    rng = np.random.default_rng(6)
    for n in (3, 20, 60, 150):
        s = np.round(rng.random((n, n)), 1) * (rng.random((n, n)) < 8 / n)
        s = np.triu(s, 1) + np.triu(s, 1).T
        got = sparse_linkage(n, {(i, j): s[i, j] for i in range(n) for j in range(i) if s[i, j]}, 0.2)
        assert got == average_linkage(s, 0.2).tolist()


def test_large_components_are_grouped_as_small_ones():
    rng = random.Random(9)
    weight, word = np.ones(SLOTS), lambda n: "".join(rng.choice("bcdfgklmnprst") for _ in range(n))
    base = [word(10) for _ in range(3)]
    names = {" ".join(sorted((b[:i] + word(1) + b[i + 1 :], rng.choice(["anna", "a", "otto"])))) for b in base for _ in range(220) for i in [rng.randrange(10)]}
    names = sorted(names)
    assert len(names) > 400
    words, vectors = [x.split() for x in names], [_vector(x.split(), weight) for x in names]
    s = np.zeros((len(names), len(names)))
    for i in range(len(names)):
        for j in range(i):
            if explicable(words[i], words[j], set()):
                s[i, j] = s[j, i] = cosine(vectors[i], vectors[j])
    links = [(names[j], names[i], s[i, j]) for i in range(len(names)) for j in range(i) if s[i, j] and explicable(words[j], words[i], set(), 1)]
    inside = {x for a, b, _ in links for x in (a, b)}
    assert inside == set(names)
    label = average_linkage(s, 0.2)
    assert dict(grouped(links, weight, 0.2, set())) == {x: names[label[i]] for i, x in enumerate(names)}
    # more than 2,000 names: the weakest links count too
    pairs = [(w := word(12), w + "x", 0.3 if k < 300 else 0.9) for k in range(1100)]
    got = dict(grouped(pairs, weight, 0.2, set()))
    assert all(got[a] == got[b] == a for a, b, _ in pairs)


def test_matches(spark):
    schema = "key string, artist string, title string, year int, song long"
    right = [("v1", "Ann Lee", "Golden River", 1990, 0), ("v2", "Bo Ray", "Golden River", 1991, 0), ("v3", "Ann Lee", "Silver Lamp (Part Two)", 1990, 0), ("v4", "Unknown Artist", "Lost Harbour Song", 2001, 0), (None, "A", "B", 1, 0), ("v5", "C", None, 1, 0)]
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("bdfgklmnprstvz") + rng.choice("aeiou") for _ in range(5))
    songs = [(f"{word()} {word()}", f"{word()} and {word()}") for _ in range(60)]
    right += [(f"w{i}", *songs[i], 1980 + i % 9, 0) for i in range(60)]
    left = [("1", "Lee, Ann", "Golden Rivre (Remastered)", 1995, 0), ("2", None, "Golden River", 1991, 0), ("3", "Ann Lee", "Silver Lamp", 1990, 0), ("4", "", "Lost Harbour Song", 2001, 0), ("5", "", "Lost Harbour Song", 2002, 0), ("6", "X", None, 1, 0), (None, "A", "B", 1, 0)]
    left += [(str(100 + i), *songs[i], None, 0) for i in range(0, 60, 2)] * 2
    got = {(r.left_key, r.right_key) for r in matches(spark.createDataFrame(left, schema), spark.createDataFrame(right, schema)).collect()}
    assert got == {("1", "v1"), ("2", "v2"), ("4", "v4")} | {(str(100 + i), f"w{i}") for i in range(0, 60, 2)}
    none = spark.createDataFrame([], schema)
    assert matches(none, spark.createDataFrame(right, schema)).count() == 0 and matches(spark.createDataFrame(left, schema), none).count() == 0


@pytest.mark.parametrize("title,want", [("A Song - Single Version", (["a", "song"], "")), ("A Song (The Answer)", (["a", "song"], "answer")), ("A Song II", (["a", "song"], "2")), ("A Song, Part Two (Mono)", (["a", "song"], "2")), ("Mono", (["mono"], ""))])
def test_title_parts(title, want):
    assert title_parts(title) == want


def test_groups_are_limited_before_the_shuffle(spark):
    df = spark.range(1000).selectExpr("id % 3 as g", "id as record_id")
    plan = best_records(df, ["g"], [F.desc("record_id")])._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan


def test_matching_in_cells_of_large_blocks_and_without_a_set_start(spark, monkeypatch):
    rng = random.Random(8)
    words = ["".join(rng.choices("abdeiklmnorstu", k=rng.randint(4, 9))) for _ in range(80)]
    artists = [f"{rng.choice(words).title()} {rng.choice(words).title()}" for _ in range(12)]
    songs = [(f"v{i}", artists[0] if i % 3 == 0 else rng.choice(artists), " ".join(rng.sample(words, 4)), rng.randint(1960, 2020)) for i in range(240)]
    left = []
    for i, (_, a, t, y) in enumerate(songs[:90]):
        k = rng.randrange(len(t))
        left.append((f"d{i}", None if i % 9 == 0 else a, t if i % 2 else t[:k] + t[k + 1 :], y if i % 4 else None))
    schema = "key string, artist string, title string, year int"
    tables = spark.createDataFrame(left, schema), spark.createDataFrame(songs, schema)
    whole = {(r.left_key, r.right_key) for r in matching.matches(*tables).collect()}
    monkeypatch.setattr(matching, "CELL", 7)
    assert {(r.left_key, r.right_key) for r in matching.matches(*tables).collect()} == whole
    true = {(f"d{i}", f"v{i}") for i in range(90) if i % 9 or i % 4}  # without artist and year nothing decides
    assert len(whole & true) >= 0.75 * len(true) and len(whole - true) <= 3


def test_blocks_lead_to_all_similar_titles(spark):
    rng = random.Random(12)
    words = ["".join(rng.choices("abdeik", k=rng.randint(1, 10))) for _ in range(150)]
    weights = {w: rng.choice([0.3, 1.0, 3.0, 8.0]) for w in words}
    weight = lambda w: weights.setdefault(w, rng.choice([0.3, 2.0, 8.0]))

    def edited(w):
        for _ in range(rng.choice([0, 1, 2])):
            i = rng.randrange(len(w))
            w = w[:i] + rng.choice(["", "x"]) + w[i + rng.randint(0, 1) :] or "x"
        return w

    left = [rng.choices(words, k=rng.randint(1, 5)) for _ in range(250)]
    right = [rng.sample(t, len(t)) if (r := rng.random()) < 0.1 else ["".join(t)] if r < 0.15 else [edited(w) for w in t if rng.random() < 0.8] or t for t in left] + [[rng.choice(words)] for _ in range(40)]
    of = lambda titles: spark.createDataFrame([(w,) for t in titles for w in t], "w string").distinct()
    near: dict = {}
    for r in matching.near_words(of(left), of(right)).collect():
        near.setdefault(r.w, []).append(f"{r.w} {r.x}")
    mine = [matching._blocks_of(" ".join(t), [p for w in set(t) for p in near.get(w, ())], 0, weight) for t in left]
    others = [matching._blocks_of(" ".join(t), None, 1, weight) for t in right]
    similar = [(i, j) for i, a in enumerate(left) for j, b in enumerate(right) if matching.title_similarity(a, b, weight) >= matching.TITLE]
    assert len(similar) > 300 and all(mine[i].keys() & others[j].keys() for i, j in similar)
    assert matching.near_words(of([]), of(right)).count() == 0


def test_matches_of_one_misspelt_word_and_of_common_words(spark):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("bdfgklmnprstvz") + rng.choice("aeiou") for _ in range(5))
    songs = [(f"{word()} {word()}", f"{word()} {word()}") for _ in range(60)]
    right = [("v1", "Ann Konbriplon", "Sunflower", 1990), ("v2", "Bo Vesterlund", "Harbour", 1991)] + [(f"w{i}", *songs[i], 1980 + i % 9) for i in range(60)] + [(f"x{i}", word(), f"Harbour {word()}", 1970) for i in range(320)]
    left = [("1", "Ann Konbriplon", "Sunflwoer", 1990), ("2", "Bo Vesterlumd", "Harbour", 1990)] + [(str(100 + i), *songs[i], None) for i in range(60)]
    schema = "key string, artist string, title string, year int"
    got = {(r.left_key, r.right_key) for r in matches(spark.createDataFrame(left, schema), spark.createDataFrame(right, schema)).collect()}
    assert {("1", "v1"), ("2", "v2")} <= got and not any(r.startswith("x") for _, r in got)


def test_slips_meet_at_the_commoner_word_and_no_similar_title_is_left_out(spark, monkeypatch):
    rng = random.Random(21)
    word = lambda: "".join(rng.choice("bdfgklmnprstvz") + rng.choice("aeiou") for _ in range(rng.randint(2, 5)))
    words = ["river"] * 40 + [word() for _ in range(60)]

    def edited(w):
        k = rng.randrange(len(w))
        return w[:k] + rng.choice("aeioubdfg") + w[k + 1 :]

    left = [[w if rng.random() < 0.8 else edited(w) for w in rng.sample(words, rng.randint(1, 6))] for _ in range(150)]
    right = [[w if rng.random() < 0.8 else edited(w) for w in t if rng.random() < 0.9] or t for t in left for _ in range(2)]
    df = np.zeros(matching.SLOTS, np.int64)
    for t in left + right:
        for w in set(t):
            df[matching._hash(w) % matching.SLOTS] += 1
    weight, of = matching._weights(df, len(right)), lambda titles: spark.createDataFrame([(w,) for t in titles for w in t], "w string").distinct()
    near: tuple[dict, dict] = {}, {}
    for r in matching.near_words(of(left), of(right)).mapInArrow(matching._directed(spark.sparkContext.broadcast(df)), "w string, x string, up boolean").collect():
        w, x = (r.w, r.x) if r.up else (r.x, r.w)
        near[not r.up].setdefault(w, []).append(f"{w} {x}")
    slips_of = lambda t, side: [p for w in dict.fromkeys(t) for p in near[side].get(w, ())]
    rows = [[(matching._blocks_of(" ".join(t), slips_of(t, side), side, weight), matching._entries(" ".join(t), slips_of(t, side), weight)) for t in titles] for side, titles in enumerate((left, right))]
    assert max(len(matching._blocks_of("river", slips_of(["river"], side), side, weight)) for side in (0, 1)) == 3  # not one for each of its slips
    both = [*((b, 0) for _, b in rows[0]), *((b, 1) for _, b in rows[1])]
    n = len(both)
    t = matching.pa.table({"block": [0] * n, "song": list(range(n)), "side": [s for _, s in both], **{x: [0] * n for x in ("low", "high", "who_low", "who_high", "year")}, "words": matching.pa.array([b for b, _ in both], "binary")})
    i, j = (x.ravel() for x in np.meshgrid(range(len(left)), range(len(left), n), indexing="ij"))
    may = set(zip(*(x[matching._Rows(t).common(i, j)].tolist() for x in (i, j))))
    similar = [(i, j) for i, a in enumerate(left) for j, b in enumerate(right) if matching.title_similarity(a, b, weight) >= matching.TITLE]
    assert len(similar) > 200 and all(rows[0][i][0].keys() & rows[1][j][0].keys() and (i, len(left) + j) in may for i, j in similar)
    assert len(may) < 0.3 * len(left) * len(right)
    schema = "key string, artist string, title string, year int"
    tables = [spark.createDataFrame([(str(k), "Ann Konbriplon", " ".join(t), 1990) for k, t in enumerate(x)], schema) for x in (left[:60], right[:120])]
    got = set(matches(*tables).collect())
    monkeypatch.setattr(matching, "HELD", 0)
    assert got and set(matches(*tables).collect()) == got


def test_hot_regions_are_split_in_rounds_of_no_more_rows_than_the_first(spark, monkeypatch):
    from chorale.llm import near

    rng = random.Random(31)
    words = ["".join(rng.choices("abdeiklmnorstu", k=5)) for _ in range(30)]
    texts = sorted({" ".join(rng.choices(words, k=rng.randint(8, 14))) for _ in range(400)})
    texts = sorted({*texts, *(t[:9] + t[10:] for t in texts[::5])})
    classes = spark.createDataFrame([(t,) for t in texts], "text string")
    pairs = lambda hot: {tuple(r) for r in near.candidate_pairs(classes, hot=hot, levels=1).collect()}
    whole, made, regions = pairs(10_000), [], near._regions

    def counted(rank, marks, chunks, threshold, buckets, *turn):
        made.append((len(marks), len(near.Regions(rank.value, [m.value for m in marks], None, threshold, *turn).of(texts)[0])))
        return regions(rank, marks, chunks, threshold, buckets, *turn)

    monkeypatch.setattr(near, "_regions", counted)
    bits = dict(zip(zip(*(x.tolist() for x in near.bitmaps(texts))), map(trigrams, texts)))
    similar = lambda p: len(bits[p[:2]] & bits[p[2:]]) >= near.THRESHOLD * len(bits[p[:2]] | bits[p[2:]])
    assert {p for p in pairs(60) if similar(p)} == {p for p in whole if similar(p)} != set()
    first, split = made[0][1], [n for level, n in made if level]
    assert sum(split) > 2 * first and max(split) < 1.6 * first
