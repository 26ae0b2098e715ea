import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from chorale.llm.leakage import common_subsequence, contaminated, leaks, longest_run, paraphrases, words_of
from chorale.llm.packing import _tightened, pack, packed, token_counts
from chorale.llm.quality import Profiles, divergence, fitted_profiles, not_prose, text_statistics


def test_words_without_marks():
    assert words_of("<b>A</b>&nbsp;[00:12] b\n> c\n12. d (1:02:03) e-f") == ["a", "b", "c", "d", "e", "f"]
    assert words_of(None) == [] and words_of("") == []


def test_runs_and_subsequences_against_brute_force():
    rng = random.Random(3)
    for _ in range(200):
        a, b = ([rng.randrange(5) for _ in range(rng.randrange(14))] for _ in "ab")
        item = [x + 1 for x in b]
        runs = [k for k in range(1, 14) for i in range(len(a) - k + 1) for j in range(len(item) - k + 1) if 0 not in a[i : i + k] and a[i : i + k] == item[j : j + k]]
        assert longest_run(a, item) == max(runs, default=0)
        row = [0] * (len(item) + 1)
        for x in a:
            new = [0]
            for j, y in enumerate(item):
                new.append(row[j] + 1 if x == y and x else max(row[j + 1], new[j]))
            row = new
        assert common_subsequence(a, item) == row[-1]


def test_leaks_against_brute_force(spark):
    rng = random.Random(8)
    common = "the a and of to in was that it for on with song singer melody".split()
    names = ["".join(rng.choices("bdfgklmnprst", k=1)) + "".join(rng.choices("aeiou", k=1)) + "".join(rng.choices("klmnrst", k=3)) + str(i) for i in range(300)]
    items = [(i, " ".join(rng.choice(names if rng.random() < 0.4 else common) for _ in range(60)), "blue") for i in range(20)]
    docs = []
    for d in range(400):
        w = [rng.choice(common + names[:5]) for _ in range(rng.randrange(5, 300))]
        if d % 4 == 0:
            it = rng.choice(items)[1].split()
            n, at = rng.randrange(6, 30), rng.randrange(30)
            k = rng.randrange(len(w))
            w[k:k] = it[at : at + n]
        docs.append((d, rng.choice([" ", "\n", " <i> "]).join(x.upper() if d % 3 == 0 else x for x in w), 1))
    docs += [(900, None, 1), (901, "", 1), (902, "x " * 30_000 + items[0][1], 1), (0, docs[0][1], 1)]
    grams = defaultdict(set)
    for i, t, _ in items:
        w = words_of(t)
        for j in range(len(w) - 8):
            grams[tuple(w[j : j + 9])].add(i)
    want = Counter((d, i) for d, t, _ in docs for w in [words_of(t)] for i in {i for j in range(len(w) - 8) for i in grams.get(tuple(w[j : j + 9]), ())})
    df, ev = spark.createDataFrame(docs, "doc_id long, text string, words int"), spark.createDataFrame(items, "item_id long, item_text string, answer string")
    got = Counter((r.doc_id, r.item_id) for r in contaminated(df, ev).collect())
    assert set(got) <= set(want) and len(got) >= 0.95 * len(want) and (902, 0) in got
    assert leaks(df.limit(0), ev).count() == 0 and leaks(df, ev.limit(0)).count() == 0


def test_leaks_of_exactly_nine_words(spark):
    rng = random.Random(12)
    words = [f"w{i}" for i in range(150)]
    items = [(i, " ".join(rng.choices(words, k=60)), "blue") for i in range(40)]
    docs = []
    for d in range(600):
        w, it = rng.choices(words, k=200), items[d % 40][1].split()
        at, k = rng.randrange(51), rng.randrange(200)
        w[k:k] = it[at : at + 9]
        docs.append((d, " ".join(w)))
    df, ev = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, item_text string, answer string")
    assert {(r.doc_id, r.item_id) for r in contaminated(df, ev).collect()} >= {(d, d % 40) for d in range(600)}


def test_paraphrases_are_candidates_from_the_least_cosine(spark):
    rng = random.Random(15)
    items = [(i, " ".join(f"w{i}x{k}" for k in range(24)), f"w{i}x1") for i in range(8)]
    docs = []
    for d in range(80):
        w = [x for k, x in enumerate(items[d % 8][1].split()) if k % 3]  # no three consecutive words
        docs.append((d, " ".join(w + [f"w{(d + 1) % 8}x{k}" for k in rng.sample(range(24), d // 8 * 2)])))
    df, ev = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, item_text string, answer string")
    got = {(r.doc_id, r.item_id): r for r in leaks(df, ev).collect()}
    assert all(r.run_words < 7 and r.cosine >= 0.45 - 1e-6 for r in got.values())
    assert {(d, d % 8) for d in range(80)} <= set(got) and any(r.cosine < 0.65 for r in got.values())
    assert all(got[d, d % 8].subsequence_words >= 16 and got[d, d % 8].answer_found for d in range(80)) and contaminated(df, ev).count() == 0


@pytest.mark.parametrize("capacity", [7, 64, 1000])
def test_pack_keeps_capacity_and_fills(capacity):
    rng = np.random.default_rng(2)
    lengths = np.concatenate([rng.integers(1, capacity + 1, 500), np.full(50, capacity), np.ones(200, np.int64)])
    s = pack(lengths, capacity)
    assert np.bincount(s, lengths).max() <= capacity
    t = _tightened(lengths, s.copy(), capacity)
    used = np.bincount(t, lengths)
    assert used.max() <= capacity and used.min() > 0 and len(used) <= s.max() + 1
    assert lengths.sum() / (len(used) * capacity) > 0.9


def test_packed_pieces_and_edges(spark):
    counts = spark.createDataFrame([(1, 10, 0), (2, 25, 0), (3, 0, 0), (4, None, 0), (5, 3, 0), (5, 3, 0), (6, 10, 0)], "doc_id long, n_tokens long, shard int")
    targets = spark.createDataFrame([(1, 10), (2, 0), (3, None), (4, 100)], "target_id long, capacity_tokens long")
    rows = packed(counts, targets, shard_tokens=20).collect()
    assert {r.target_id for r in rows} == {1, 4}
    used = Counter()
    for r in rows:
        if r.container is not None:
            used[r.target_id, r.container] += r.n_tokens
    assert all(v <= {1: 10, 4: 100}[t] for (t, _), v in used.items())
    tokens = Counter()
    for r in rows:
        tokens[r.target_id, r.doc_id] += r.n_tokens
    assert tokens[1, 2] == 25 and tokens[4, 5] == 6 and [r.container for r in rows if r.doc_id in (3, 4)] == [None] * 4
    assert [r.piece for r in sorted(rows, key=lambda r: r.piece) if r.target_id == 1 and r.doc_id == 2] == [1, 2, 3]
    assert packed(counts.limit(0), targets).count() == 0


def test_token_counts(spark):
    docs = spark.createDataFrame([(1, "hello world"), (2, None), (3, ""), (4, "a " * 50_000)], "doc_id long, text string")
    got = dict(map(tuple, token_counts(docs).collect()))
    assert got[1] == 2 and got[2] == got[3] == 0 and got[4] >= 50_000


PROSE = ["We sang it twice in the back room, and nobody seemed to mind. The key change was late.", "WE SANG IT TWICE IN THE BACK ROOM, AND NOBODY SEEMED TO MIND.", "we sang it twice in the back room and nobody seemed to mind the key change was late for all of us", "– Wir haben die Strophe noch einmal gesungen.\n— Das ist nicht die Stimme, die ich gehört habe.", "Quand le refrain arrive, la voix\ndevient lente. On a chanté la note\ndeux fois avec les amis."]
OTHER = ["1. Under Your Gentle River\n2. Nobody Can Wait\n3. Hold My Lamp - Ann Lee", "a | b | c\n--- | --- | ---\nx y | 12 | z\nq | 13 | w", "#one #two #three #four #five", "karaoke free karaoke free karaoke free karaoke free karaoke free karaoke free", "♪★=~!! ♫♪ ...", "12 34 0.5 7%\n13 35 0.6 8%", "https://v.example/watch?v=abc\nhttps://v.example/watch?v=def", "name,year,key\nA Lamp,1999,C\nB Lamp,2001,D"]


def test_prose_and_others(spark):
    docs = [(i, t) for i, t in enumerate(PROSE + OTHER)] + [(90, None), (91, ""), (92, " \n "), (93, PROSE[0] + "\n\n" + OTHER[0]), (94, (PROSE[0] + " ") * 3000)]
    df = spark.createDataFrame([(*d, "x") for d in docs], "doc_id long, text string, profile string")
    assert {r.doc_id for r in not_prose(df).collect()} == set(range(len(PROSE), len(PROSE) + len(OTHER)))
    stats = {r.doc_id: r for r in text_statistics(df).collect()}
    assert stats[90].profile is None and stats[91].n_words == 0 and len(stats) == len(docs)
    assert stats[0].n_words == 18 and 0 < stats[0].symbol_ratio < 0.1 and stats[0].prose_share == 1
    assert text_statistics(df.limit(0)).count() == 0


def test_divergence_against_definition():
    p, q = np.array([[0.5, 0.5, 0.0]]), np.array([[0.0, 0.5, 0.5], [0.5, 0.5, 0.0]])
    assert divergence(p, q)[0] == pytest.approx([0.5, 0.0])


def test_planted_paraphrases_are_found(spark):
    rng = random.Random(12)
    words = ["".join(rng.choices("abdeiklmnorstu", k=rng.randint(3, 8))) for _ in range(900)]
    items = [(i, " ".join(rng.choices(words, k=rng.randint(25, 45))), rng.choice(words)) for i in range(40)]
    documents, planted = [], set()
    for i in range(300):
        text = rng.choices(words, k=rng.randint(40, 120))
        if i % 3 == 0:
            item = rng.randrange(40)
            said = items[item][1].split()
            for k in range(rng.randrange(5), len(said), 5):  # every fifth word is another
                said[k] = rng.choice(words)
            text[len(text) // 2 : len(text) // 2] = said
            planted.add((i, item))
        documents.append((i, " ".join(text)))
    got = paraphrases(spark.createDataFrame(documents, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, item_text string, answer string"))
    found = {(r.doc_id, r.item_id) for r in got.collect()}
    assert len(found & planted) >= 0.9 * len(planted) and len(found - planted) <= 0.1 * len(planted)


def test_profiles_follow_the_documents(spark):
    english = "The night was long and we sang all of the songs that she had brought with her, and then it was over. "
    rows = [(i, english * 5) for i in range(60)] + [(100, "a, b, c"), (101, None), (102, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    fitted = fitted_profiles(df, 1000)
    k = fitted.names.index("prose, en")
    assert fitted.p[k][0] > Profiles().p[k][0] and fitted.kinds[k] == "prose"  # more function words than in general
    assert {r.doc_id for r in text_statistics(df, fitted).where("prose_share > 0.5").collect()} == set(range(60))


def test_profiles_are_fitted_to_every_document(spark):
    # of 9,000 documents a sample of 4,000 took every second one, by a hash of the id
    english = "The night was long and we sang all of the songs that she had brought with her, and then it was over."
    df = spark.range(9000).selectExpr("id AS doc_id", f"'{english}' AS text")
    fitted = fitted_profiles(df)
    one = fitted_profiles(df.limit(1))
    k = int(np.abs(one.p - Profiles().p).sum(1).argmax())
    g = Profiles().p[k]
    v = one.p[k] * 51 - g * 50  # the one document's distribution, beside a prior of 50
    assert fitted.p[k] == pytest.approx((v * 9000 + g * 50) / 9050, abs=1e-9)
