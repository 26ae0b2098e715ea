"""Variant spellings of names typed by people (problem 4).

Method: names become weighted character n-gram vectors; a distributed join over keys that all explicable
pairs share (the name with a letter left out, a word and an initial) finds pairs with a high cosine, whose
differences must be explicable (typing slips, initials, nicknames,
order, left-out words); the pairs' components are grouped by average-linkage clustering. Placeholders and
titles that stand in a name field are told by fixed words and by how often their words stand in names and
in titles.
"""

from __future__ import annotations

import heapq
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chorale.functions.text import letters
from chorale.llm.graph import components
from chorale.plans.stage import staged

#: Slots of word and n-gram counts; fixed, so their size is.
SLOTS = 1 << 18
#: Least cosine of a link, and least average similarity of two clusters to become one.
COSINE, AVERAGE = 0.20, 0.20

#: Values that stand for no name. Fixed values, as letters.
PLACEHOLDERS = "unknown unknownartist various variousartists variousartist va na none null artist unbekannt desconocido inconnu tba tbd untitled notavailable noartist anonymous".split()

#: Words that a name may have or lack. Fixed values.
OPTIONAL = {"artist": set("the and mc dj".split()), "channel": set()}

#: Abbreviations of words in names. Fixed values.
ABBREVIATIONS = {
    "artist": {"coll": "collective", "ens": "ensemble", "bros": "brothers", "orch": "orchestra", "qrt": "quartet", "qt": "quartet", "assy": "assembly", "assem": "assembly", "co": "company", "sis": "sisters", "phil": "philharmonic"},
    "channel": {"kar": "karaoke", "b": "backing", "trax": "tracks", "offl": "official"},
}

#: Letters that don't come apart into a plain one and a mark. Fixed values.
PLAIN = str.maketrans({"ø": "o", "ł": "l", "đ": "d", "ð": "d", "ı": "i", "ß": "ss", "æ": "ae", "œ": "oe", "þ": "th"})

#: Short forms of given names. Fixed values.
NICKNAMES = {
    short: full
    for full, shorts in {
        "alexander": "alex alec sandy", "anthony": "tony", "benjamin": "ben benny", "charles": "charlie chuck", "christina": "tina chris", "dorothea": "dot dottie dora",
        "edward": "ed eddie ted ned", "elizabeth": "liz beth betty eliza lizzie", "frederick": "fred freddie", "gabriella": "gabi gaby ella", "harriet": "hattie", "josephine": "josie jo",
        "katherine": "kate kathy katie kat", "lawrence": "larry", "leonard": "len lenny leo", "margaret": "peggy maggie meg", "matthew": "matt", "michael": "mike mick mickey",
        "nathaniel": "nat nate", "penelope": "penny", "philippa": "pip pippa", "rebecca": "becky becca", "robert": "bob rob bobby robbie", "samuel": "sam sammy",
        "susannah": "sue susie", "theodora": "thea theo", "victoria": "vicky vic", "william": "bill will billy willie", "thomas": "tom tommy", "james": "jim jimmy", "richard": "dick rick",
        "joseph": "joe joey", "daniel": "dan danny", "andrew": "andy drew", "patricia": "pat patty", "jennifer": "jen jenny", "nicholas": "nick nicky", "stephen": "steve",
        "timothy": "tim", "gregory": "greg", "jonathan": "jon", "deborah": "deb debbie", "barbara": "barb", "catherine": "cathy", "abigail": "abby", "jacqueline": "jackie",
    }.items()
    for short in shorts.split()
}


def plain_words(value: str) -> list[str]:
    """Lower-case words without accents; apostrophes don't part words, all other signs do."""
    out, word = [], []
    for ch in unicodedata.normalize("NFKD", value.lower()).translate(PLAIN):
        if ch.isalnum():
            word.append(ch)
        elif ch in "'’ʼ​‌‍⁠﻿­" or unicodedata.combining(ch):
            continue
        elif word:
            out.append("".join(word))
            word = []
    return [*out, "".join(word)] if word else out


def slips(a: str, b: str, most: int) -> int:
    """Typing slips between two words (insertion, deletion, substitution, swap of neighbours); most + 1 if more."""
    if a == b:
        return 0
    if abs(len(a) - len(b)) > most or len(set(a) ^ set(b)) > 2 * most:
        return most + 1
    before, row = None, list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            d = min(row[j] + 1, new[j - 1] + 1, row[j - 1] + (x != y))
            if before is not None and j > 1 and x == b[j - 2] and a[i - 2] == y:
                d = min(d, before[j - 2] + 1)
            new.append(d)
        if min(new) > most:
            return most + 1
        before, row = row, new
    return min(row[-1], most + 1)


def explicable(a: list[str], b: list[str], frequent: frozenset[str] | set[str] = frozenset(), most_slips: int = 2) -> bool:
    """Whether the differences of two names (as words) are slips, initials and left-out initials only.

    Of two words that are both frequent neither is a slip of the other. A long word may hold two slips, no pair more than `most_slips`.
    """
    left, right = list(a), list(b)
    solid = 0
    for w in a:
        if w in right:
            right.remove(w)
            left.remove(w)
            solid += len(w) > 3
    edits = 0
    for w in sorted(left, key=len, reverse=True):
        if len(w) < 2 or len(w) < 4 and not solid:
            continue
        most = min(most_slips, 2 if len(w) >= 9 else 1)
        best = min(((slips(w, x, most), x) for x in right if len(x) > 1 and not (w in frequent and x in frequent)), default=(9, ""))
        if best[0] <= most:
            left.remove(w)
            right.remove(best[1])
            edits += best[0]
            solid += len(w) > 3
    if edits > most_slips or not solid:
        return False
    for one, other in ((left, right), (right, left)):
        for w in [x for x in one if len(x) == 1]:
            full = next((x for x in other if x[0] == w and len(x) > 1), None)
            if full:
                one.remove(w)
                other.remove(full)
    # what is left over may only be an initial between two full names
    return all(len(w) == 1 for w in left + right) and not (left and right) and (not (left or right) or len(a) > 1 and len(b) > 1)


def _slot(w: str) -> int:
    import xxhash

    return xxhash.xxh32_intdigest(w) & (SLOTS - 1)


def _grams(word: str, n: int) -> list[str]:
    w = f"^{word}$"
    return [w[i : i + n] for i in range(len(w) - n + 1)] or [w]


def _vector(words: list[str], weight: np.ndarray) -> dict[int, float]:
    v: dict[int, float] = {}
    for w in words:
        for g in _grams(w, 3):
            s = _slot(g)
            v[s] = float(weight[s])
    norm = sum(x * x for x in v.values()) ** 0.5 or 1.0
    return {k: x / norm for k, x in v.items()}


def cosine(a: dict[int, float], b: dict[int, float]) -> float:
    if len(a) > len(b):
        a, b = b, a
    return sum(x * b.get(k, 0.0) for k, x in a.items())


def average_linkage(similar: np.ndarray, least: float) -> np.ndarray:
    """Cluster numbers of the rows of a matrix of similarities: the two most similar clusters on average are joined while that is at least `least`."""
    n = len(similar)
    s = similar.astype(float).copy()
    np.fill_diagonal(s, -1)
    size = np.ones(n)
    label = np.arange(n)
    while True:
        i, j = divmod(int(s.argmax()), n)
        if s[i, j] < least:
            return label
        joined = (s[i] * size[i] + s[j] * size[j]) / (size[i] + size[j])
        s[i], s[:, i] = joined, joined
        s[i, i] = -1
        s[j], s[:, j] = -1, -1
        size[i] += size[j]
        label[label == j] = i


def sparse_linkage(n: int, similar: dict[tuple[int, int], float], least: float) -> list[int]:
    """The same as `average_linkage` for similarities (i, j) -> s of which most are 0; `least` is above 0."""
    near: list[dict[int, float]] = [{} for _ in range(n)]
    for (i, j), s in similar.items():
        near[i][j] = near[j][i] = s
    heap = [(-s, i, j) for i in range(n) for j, s in near[i].items() if i < j and s >= least]
    heapq.heapify(heap)
    size, parent = [1] * n, list(range(n))
    while heap:
        s, i, j = heapq.heappop(heap)
        if near[i].get(j) != -s:
            continue
        parent[j] = i
        one, other = near[i], near[j]
        near[j] = {}
        for k in (one.keys() | other.keys()) - {i, j}:
            joined = (one.get(k, 0.0) * size[i] + other.get(k, 0.0) * size[j]) / (size[i] + size[j])
            one[k] = near[k][i] = joined
            near[k].pop(j, None)
            if joined >= least:
                heapq.heappush(heap, (-joined, min(i, k), max(i, k)))
        one.pop(j)
        size[i] += size[j]
    for k in range(n):  # a cluster's number is that of its first row
        parent[k] = parent[parent[k]]
    return parent


def _counts(words: DataFrame, column: str) -> np.ndarray:
    """How many rows of `words` fall in each slot (a column of slots); at most SLOTS rows reach the driver."""
    got = words.groupBy(column).agg(F.count(F.lit(1)).alias("n")).toPandas()
    out = np.zeros(SLOTS, np.int64)
    out[got[column].to_numpy(np.int64)] = got["n"].to_numpy()
    return out


def _is_title(words: list[str], odds: np.ndarray | None) -> bool:
    return odds is not None and len(words) > 1 and sum(odds[_slot(w)] for w in set(words) if len(w) > 1) > 0


def _words_seen(odds: np.ndarray | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            names = [words for v in b.column(0).to_pylist() if not _is_title(words := plain_words(v), odds)]
            yield pa.RecordBatch.from_arrays([pa.array([w for words in names for w in set(words)], pa.string())], names=["w"])

    return run


def _canonical(kind: str, common: list[str], title_odds: np.ndarray | None):
    """value, spelling -> spelling, words (sorted, in their full forms); titles and placeholders are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent = set(common)
        by_length: dict[int, list[str]] = {}
        for w in common:
            if len(w) >= 4:
                by_length.setdefault(len(w), []).append(w)
        fixed: dict[str, str] = {}

        def full(w: str) -> str:
            w = ABBREVIATIONS[kind].get(w, w)
            if kind != "artist":
                return corrected(w)
            w = NICKNAMES.get(w) or corrected(w)
            return NICKNAMES.get(w, w)

        def corrected(w: str) -> str:
            """A frequent word that is one slip away, if there is just one and it is no name of its own."""
            if w in frequent or len(w) < 4:
                return w
            if w not in fixed:
                near = [x for n in (len(w) - 1, len(w), len(w) + 1) for x in by_length.get(n, ()) if (x[0] == w[0] or x[-2:] == w[-2:]) and slips(w, x, 1) <= 1]
                fixed[w] = near[0] if len(near) == 1 else w
            return fixed[w]

        for b in batches:
            spellings, values = [], []
            for value, spelling in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                words = plain_words(value)
                if _is_title(words, title_odds):
                    continue
                if len(words) > 1:
                    words = [full(w) for w in words]
                if kind == "channel":
                    kept = [w for w in words if w not in frequent and len(w) > 1]
                else:
                    kept = [w for w in words if w not in OPTIONAL[kind]]
                spellings.append(spelling)
                values.append(" ".join(sorted(kept or words)))
            yield pa.RecordBatch.from_arrays([pa.array(spellings, pa.string()), pa.array(values, pa.string())], names=["spelling", "words"])

    return run


def _gram_slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        slots = [s for v in b.column(0).to_pylist() for s in {_slot(g) for w in v.split() for g in (*_grams(w, 3), *(_grams(w, 4) if len(w) > 3 else ()))}]
        yield pa.RecordBatch.from_arrays([pa.array(slots, pa.int64())], names=["slot"])


def _less_one(w: str) -> set[str]:
    """The word, and the word without one of its letters: two words one slip apart have one of these in common."""
    return {w, *(w[:i] + w[i + 1 :] for i in range(len(w)))}


def _less_two(w: str) -> set[str]:
    """The same with two letters left out; two slips are allowed in words of nine letters, so shorter than seven needs none."""
    return {u for v in _less_one(w) for u in _less_one(v)} if len(w) > 6 else _less_one(w)


def _halves(w: str) -> set[str]:
    """Beginnings and ends of a word, of which two words one slip apart have one in common, as a slip leaves one of them whole.

    Each is taken for a longer word of the pair with as many letters and with one more.
    """
    out = set()
    for m in (len(w), len(w) + 1):
        p = m // 2
        out |= {f"{w[:p]}<{m}", f"{m}>{w[len(w) - (m - 1 - p) :]}"}
    return out


def _number(x: str) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(x)


def link_keys(words: list[str]) -> tuple[set[int], set[int]]:
    """Keys of a name: two names whose differences are explicable, with up to two slips, have a key in common, however frequent their words are.

    The first are of the whole name with no letter, one, or two of a word left out, or with halves of two of its
    words in their place; they hold for pairs that differ in slips only. All other pairs have an initial in one of the
    names, and by `explicable` two or more words matched: one of more than three letters and another that begins alike,
    or, if a slip is at its beginning, has one of its first two letters in common. Those are the second.
    """
    first, second = _keys(words)
    return first, set(second)


def _keys(words: list[str]) -> tuple[set[int], dict[int, int]]:
    """The keys of `link_keys`, those of parts with a number: 0 for a word as it is, which equal words have in common, and of its slips the word's, as only different words need those."""
    number = {w: _number(w) for w in words}
    whole = sum(number[w] for w in words)
    first, second = {whole & _KEY}, {}
    halves = {w: [_number(v) - n for v in _halves(w)] for w, n in number.items() if len(w) > 1}
    for w in number:
        less = _less_two(w)
        if len(w) > 1:
            first |= {whole - number[w] + _number(v) & _KEY for v in less}
        others = [x for x in words if x != w] + [w] * (words.count(w) - 1)
        if len(w) > 2 and others:
            begins = {c for x in others for c in x[:2]}
            own = number[w] & _KEY or 1
            second |= {_number(f"{v} {c}") & _KEY: own for v in less for c in begins} | {_number(f"{w} {c} =") & _KEY: 0 for c in begins}
    long = [w for w in words if len(w) > 1]
    for k, w in enumerate(long):
        for z in long[:k]:
            first |= {whole + x + y & _KEY for x in halves[w] for y in halves[z]}
    return first, second


#: Bits of a key and of a word's number; names whose keys are equal by chance are candidates more, not less.
_KEY = (1 << 48) - 1
#: Bits that tell which keys of parts the names with an initial have; fixed, so their size is.
PART_BITS = 1 << 24
_POSTING = pa.schema([("gram", pa.int64()), ("word", pa.int64()), ("name", pa.int64()), ("led", pa.bool_())])
_POSTING_DDL = "gram long, word long, name long, led boolean"


def _part_bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """words -> the bits of the keys of parts of names with an initial, 64 in a word of bits."""
    for b in batches:
        names = [v.split() for v in b.column(0).to_pylist()]
        keys = [np.fromiter(_keys(w)[1], np.uint64) for w in names if any(len(x) == 1 for x in w)]
        at = np.unique(np.concatenate(keys) & np.uint64(PART_BITS - 1)) if keys else np.zeros(0, np.uint64)
        word, first = np.unique(at >> np.uint64(6), return_index=True)
        bits = np.bitwise_or.reduceat(np.uint64(1) << (at & np.uint64(63)), first) if len(at) else at
        yield pa.RecordBatch.from_arrays([pa.array(word.astype(np.int64)), pa.array(bits.view(np.int64))], names=["at", "bits"])


def _postings(parts):
    """words -> a row for each of its keys with the hash of the name, and whether the key leads somewhere: one of the whole name, or the name has an initial.

    Keys of parts that no name with an initial has are left out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = parts.value
        for b in batches:
            for at in range(0, b.num_rows, 2_000):
                keys, of, counts, led, names = [], [], [], [], []
                for v in b.column(0).slice(at, 2_000).to_pylist():
                    words = v.split()
                    first, second = _keys(words)
                    one = np.fromiter(first, np.uint64, len(first))
                    other, word = (np.fromiter(x, np.uint64, len(second)) for x in (second.keys(), second.values()))
                    slot = (other & np.uint64(PART_BITS - 1)).astype(np.int64)
                    ok = bits[slot >> 6] >> (slot & 63).astype(np.uint64) & np.uint64(1) > 0
                    other, word = other[ok], word[ok]
                    keys += [one, other]
                    of += [np.zeros(len(one), np.uint64), word]
                    counts += [len(one), len(other)]
                    led += [True, any(len(w) == 1 for w in words)]
                    names += [_number(v)] * 2
                if not keys:
                    continue
                rows = *(pa.array(np.concatenate(x).view(np.int64)) for x in (keys, of)), pa.array(np.repeat(np.array(names, np.uint64).view(np.int64), counts)), pa.array(np.repeat(np.array(led), counts))
                yield pa.RecordBatch.from_arrays(list(rows), schema=_POSTING)

    return run


def _whole_groups(batches: Iterator[pa.RecordBatch], column: str, least: int) -> Iterator[pa.Table]:
    """Rows sorted by a column, in tables of about `least` rows that no group is cut by."""
    kept: list[pa.RecordBatch] = []
    n = 0
    for b in batches:
        kept.append(b)
        n += b.num_rows
        if n < least:
            continue
        t = pa.Table.from_batches(kept).combine_chunks()
        key = t.column(column).to_numpy()
        cut = int(np.searchsorted(key, key[-1]))
        if cut:
            yield t.slice(0, cut)
        kept = t.slice(cut).to_batches()
        n = t.num_rows - cut
    if kept and (t := pa.Table.from_batches(kept).combine_chunks()).num_rows:
        yield t


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        yield pa.RecordBatch.from_arrays([pa.array(np.array(list(map(_number, b.column(0).to_pylist())), np.uint64).view(np.int64)), b.column(0)], names=["name", "words"])


_CANDIDATE = pa.schema([("x", pa.int64()), ("y", pa.int64())])


def _candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by key -> the pairs x < y of names with a key in common, where one of the two rows leads somewhere; two slips of one word are no pair, as the word itself is."""
    for t in _whole_groups(batches, "gram", 100_000):
        gram, word, name, led = t.column("gram").to_numpy(), t.column("word").to_numpy(), t.column("name").to_numpy(), np.asarray(t.column("led"))
        rows, d = np.arange(len(gram)), 1
        while True:
            rows = rows[rows + d < len(gram)]
            rows = rows[gram[rows] == gram[rows + d]]
            if not len(rows):
                break
            some = rows[(led[rows] | led[rows + d]) & (name[rows] != name[rows + d]) & ((word[rows] == 0) | (word[rows] != word[rows + d]))]
            x, y = name[some], name[some + d]
            both = np.unique(np.stack([np.minimum(x, y), np.maximum(x, y)]), axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(both[0]), pa.array(both[1])], schema=_CANDIDATE)
            d += 1


_LINK = pa.schema([("a", pa.string()), ("b", pa.string()), ("cosine", pa.float64())])


def _links(weights, least: float, frequent: set[str]):
    """Pairs of names -> those with a cosine of at least `least` whose differences are explicable."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight = weights.value
        vectors: dict[str, dict[int, float]] = {}

        def vector(v: str) -> dict[int, float]:
            if v not in vectors:
                if len(vectors) > 100_000:
                    vectors.clear()
                vectors[v] = _vector(v.split(), weight)
            return vectors[v]

        for batch in batches:
            out = []
            for x, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                a, b = (x, y) if x < y else (y, x)
                if explicable(a.split(), b.split(), frequent) and (c := cosine(vector(a), vector(b))) >= least:
                    out.append((a, b, c))
            yield pa.RecordBatch.from_arrays([pa.array(x, y.type) for x, y in zip(zip(*out) if out else ([], [], []), _LINK)], schema=_LINK)

    return run


def _two_slip_keys(words: list[str]) -> set[int]:
    """Keys of a name with no, one or two letters left out: two names that differ in two slips at most have one in common."""
    number = [_number(w) for w in words]
    whole = sum(number)
    less = [{_number(v) - x for v in _less_one(w)} if len(w) > 1 else {0} for w, x in zip(words, number)]
    keys = {whole + x + y for k, own in enumerate(less) for other in less[:k] for x in own for y in other} | {whole + x for own in less for x in own}
    for w, x in zip(words, number):
        if len(w) > 6:  # two slips are allowed in words of nine letters
            keys |= {whole - x + _number(u) for v in _less_one(w) for u in _less_one(v)}
    return keys


def _comparable(words: list[list[str]]) -> set[tuple[int, int]]:
    """The pairs i > j of names, of which all with explicable differences are some: by keys, and those of names with an initial with all."""
    by_key: dict[int, list[int]] = {}
    for i, w in enumerate(words):
        for k in _two_slip_keys(w):
            by_key.setdefault(k, []).append(i)
    out = {(i, j) for some in by_key.values() for at, i in enumerate(some) for j in some[:at]}
    for i, w in enumerate(words):
        if any(len(x) == 1 for x in w):
            out |= {(max(i, j), min(i, j)) for j in range(len(words)) if j != i}
    return out


def grouped(pairs: list[tuple[str, str, float]], weight: np.ndarray, least: float, frequent: set[str]) -> list[tuple[str, str]]:
    """Links of a component -> words, cluster of its names; one rule at every size."""
    names = sorted({x for a, b, _ in pairs for x in (a, b)})
    if len(names) == 2:
        return [(x, names[0]) for x in names] if pairs[0][2] >= least else []
    at = {x: i for i, x in enumerate(names)}
    similar = {(max(at[a], at[b]), min(at[a], at[b])): c for a, b, c in pairs}
    words, vectors = [x.split() for x in names], [_vector(x.split(), weight) for x in names]
    for i, j in _comparable(words) - similar.keys():
        if (c := cosine(vectors[i], vectors[j])) and explicable(words[i], words[j], frequent):
            similar[i, j] = c
    label = sparse_linkage(len(names), similar, least)
    return [(x, names[label[i]]) for i, x in enumerate(names)]


def _clusters(weights, least: float, frequent: set[str]):
    """component, a, b, cosine sorted by component -> words, cluster (its smallest member)."""
    schema = pa.schema([("words", pa.string()), ("cluster", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight = weights.value
        last, pairs, out = None, [], []
        for b in batches:
            for k, x, y, c in zip(*(col.to_pylist() for col in b.columns)):
                if k != last and pairs:
                    out += grouped(pairs, weight, least, frequent)
                    pairs = []
                last = k
                pairs.append((x, y, c))
        if pairs:
            out += grouped(pairs, weight, least, frequent)
        yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in out], pa.string()), pa.array([y for _, y in out], pa.string())], schema=schema)

    return run


def name_clusters(values: DataFrame, kind: str = "artist", titles: DataFrame | None = None, least: float = COSINE, average: float = AVERAGE) -> DataFrame:
    """spelling (its letters), words, cluster of every spelling of a name that is no placeholder and no title.

    values: one string column of names, one row per use. titles: one string column of titles; a name whose
    words stand rather in titles is left out. kind: artist or channel (where words that very many names
    have carry no identity). Null and blank names are left out; a name without letters is none; repeated
    rows count as uses; an empty table gives an empty one. Spellings with the same words are one vertex,
    so a name with very many uses costs no more.
    """
    spark = values.sparkSession
    v = F.col(values.columns[0])
    uses = values.select(v.alias("value"), letters(v).alias("spelling")).where("spelling <> ''").groupBy("spelling", "value").agg(F.count(F.lit(1)).alias("n"))
    spelled = uses.groupBy("spelling").agg(F.max_by("value", F.struct("n", "value")).alias("value"), F.sum("n").alias("n")).where(~F.col("spelling").isin(PLACEHOLDERS))
    spelled = staged(spelled, "spelled")
    total = max(1, spelled.count())
    odds = None
    if titles is not None:
        t = F.col(titles.columns[0])

        def slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                yield pa.RecordBatch.from_arrays([pa.array([_slot(w) for x in b.column(0).to_pylist() for w in set(plain_words(x))], pa.int64())], names=["slot"])

        in_titles = _counts(titles.select(t.alias("t")).where("t is not null").distinct().mapInArrow(slots, "slot long"), "slot")
        in_names = _counts(spelled.select("value").mapInArrow(slots, "slot long"), "slot")
        a, b = (in_titles + 0.5) / (in_titles.sum() + 1.0), (in_names + 0.5) / (in_names.sum() + 1.0)
        odds = np.clip(np.log(a / b), -4, 4)
        odds[(in_titles + in_names) < 3] = -0.5
    words = spelled.select("value").mapInArrow(_words_seen(odds), "w string")
    # words of one name in 400 are words of the language of names; as each name counts once a word, there are at most 400 for every word a name has on average
    bound = max(8, total // 400)
    common = [r[0] for r in words.groupBy("w").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= bound).orderBy(F.desc("n"), "w").collect()]
    named = staged(spelled.select("value", "spelling").mapInArrow(_canonical(kind, common, odds), "spelling string, words string").where("words <> ''"), "named")
    forms = named.select("words").distinct()
    counts = _counts(forms.mapInArrow(_gram_slots, "slot long"), "slot")
    n = max(1, int(forms.count()))
    # inverse frequency, no higher than that of an n-gram in one of a thousand names, so slips don't outweigh the rest
    weight = np.minimum(np.log(1 + n / np.maximum(1, counts)), np.log(1 + min(n, 1000)))
    weights = spark.sparkContext.broadcast(weight)
    parts = np.zeros(PART_BITS >> 6, np.uint64)
    got = forms.mapInArrow(_part_bits, "at long, bits long").groupBy("at").agg(F.bit_or("bits").alias("bits")).toPandas()
    parts[got["at"].to_numpy(np.int64)] = got["bits"].to_numpy(np.int64).view(np.uint64)
    postings = forms.mapInArrow(_postings(spark.sparkContext.broadcast(parts)), _POSTING_DDL)
    # keys of parts lead somewhere only if a name with an initial has them; keys of one name lead nowhere
    pairs = postings.repartition("gram").sortWithinPartitions("gram").mapInArrow(_candidates, "x long, y long").distinct()
    numbered = lambda x, words: forms.mapInArrow(_numbered, f"{x} long, {words} string")
    links = pairs.join(numbered("x", "a"), "x").join(numbered("y", "b"), "y").select("a", "b").mapInArrow(_links(weights, least, set(common)), "a string, b string, cosine double")
    links = staged(links, "links")
    groups = components(links.select(F.xxhash64("a").alias("a"), F.xxhash64("b").alias("b")))
    grouped = links.withColumn("vertex", F.xxhash64("a")).join(groups, "vertex").select("component", "a", "b", "cosine")
    clustered = grouped.repartition("component").sortWithinPartitions("component", "a", "b").mapInArrow(_clusters(weights, average, set(common)), "words string, cluster string")
    return named.join(clustered, "words", "left").select("spelling", "words", F.coalesce("cluster", "words").alias("cluster"))


def name_pairs(clusters: DataFrame) -> DataFrame:
    """name_a, name_b of every two spellings of a cluster, name_a the smaller by code point."""
    a = clusters.select("cluster", F.col("spelling").alias("name_a"))
    b = clusters.select("cluster", F.col("spelling").alias("name_b"))
    return a.join(b, "cluster").where("name_a < name_b").select("name_a", "name_b").distinct()
