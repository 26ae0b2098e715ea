"""Joins of names by edit similarity that lose no pair (JN7, JN8, JN10)."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chorale.plans.stage import staged

#: Names of a side that a cell holds at most.
CHUNK = 1 << 15
#: Pairs of a cell that are worth a task of their own, and comparisons that a task makes at once.
WORTH, STEP = 10_000_000, 1 << 16

#: Letters of a name that are compared by words of bits; the few pairs with a longer name are left to the exact check.
LONG = 64
#: Letters from which on names are compared by their pairs of letters first, as most have the same letters.
BY_PAIRS = 16

_SIGNED = pa.schema([("name", pa.string()), ("n", pa.int32()), ("letters", pa.int64()), ("more", pa.int64()), ("grams", pa.int64()), ("grams_high", pa.int64())])
_SIGNED_DDL = "name string, n int, letters long, more long, grams long, grams_high long"
_PAIR = pa.schema([("a", pa.string()), ("b", pa.string())])


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """name -> its length and bitmaps: its letters, a bit for the first and second of a kind and one for the third and fourth, and its pairs of letters (128 bits)."""
    of_gram: dict[str, int] = {}

    def bit(gram: str) -> int:
        x = 1 << ((zlib.crc32(gram.encode("utf-8", "surrogatepass")) * 0x9E3779B97F4A7C15 & (1 << 64) - 1) >> 57)
        if len(of_gram) < 500_000:
            of_gram[gram] = x
        return x

    for b in batches:
        names = b.column(0).to_pylist()
        letters, more, grams, high = (np.zeros(len(names), np.uint64) for _ in range(4))
        for i, name in enumerate(names):
            one = two = three = 0
            for gram in map("".join, zip("\0" + name, name + "\0")):
                three |= of_gram.get(gram) or bit(gram)
            for ch in name:
                x = 1 << (ord(ch) & 31)
                if not one & x:
                    one |= x
                elif not one & x << 32:
                    one |= x << 32
                else:
                    two |= x << 32 if two & x else x
            letters[i], more[i], grams[i], high[i] = one, two, three & (1 << 64) - 1, three >> 64
        columns = [b.column(0), pa.array(list(map(len, names)), pa.int32()), *(pa.array(x.view(np.int64)) for x in (letters, more, grams, high))]
        yield pa.RecordBatch.from_arrays(columns, schema=_SIGNED)


def _codes(names: list[str], most: int) -> np.ndarray:
    """A row for each name, of the last seven bits of its letters; names of more than `most` letters have none."""
    short = [x if len(x) <= most else "" for x in names]
    width = max(map(len, short), default=0)
    points = np.frombuffer("".join(x.ljust(width, "\0") for x in short).encode("utf-32-le", "surrogatepass"), np.uint32)
    return (points & 127).astype(np.uint8).reshape(len(names), width)


def _places(codes: np.ndarray) -> np.ndarray:
    """For each name and code the bits of the places it stands in."""
    out = np.zeros((len(codes), 128), np.uint64)
    rows = np.arange(len(codes))
    for p in range(codes.shape[1]):
        out[rows, codes[:, p]] |= np.uint64(1) << np.uint64(p)
    return out


def _distances(places: np.ndarray, length: int, i: np.ndarray, codes: np.ndarray, sizes: np.ndarray, j: np.ndarray, most: np.ndarray | None = None) -> np.ndarray:
    """Edit distances of pairs, of a name of `length` letters each, by bit-parallel columns; letters of one code count as equal, so none is too high.

    most: pairs that can't come down to it any more are left, with a distance above it.
    """
    order = np.argsort(-sizes[j], kind="stable")
    i, j = i[order], j[order]
    size, most = sizes[j], most if most is None else most[order]
    one, top = np.uint64(1), np.uint64(length - 1)
    up, down = np.full(len(i), ~np.uint64(0)), np.zeros(len(i), np.uint64)
    score = np.full(len(i), length, np.int16)
    out = np.empty(len(i), np.int16)
    for p in range(int(size[0]) if len(size) else 0):
        n = int(np.searchsorted(-size, -p, "left"))  # names that go on
        if most is not None and p % 6 == 5:
            out[order[n:]] = score[n:]
            least = score[:n] - (size[:n] - p)  # a letter takes one off at most
            out[order[:n]] = least
            on = np.flatnonzero(least <= most[:n])
            i, j, size, most, up, down, score, order = (x[on] for x in (i, j, size, most, up, down, score, order))
            n = len(on)
        pv, mv = up[:n], down[:n]
        eq = places[i[:n], codes[j[:n], p]]
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph, mh = mv | ~(xh | pv), pv & xh
        score[:n] += (ph >> top & one).astype(np.int16)
        score[:n] -= (mh >> top & one).astype(np.int16)
        ph, mh = ph << one | one, mh << one
        up[:n], down[:n] = mh | ~(xv | ph), ph & xv
    out[order] = score
    return out


def _alike(least: float):
    """Rows of one cell, of both sides -> the pairs that can have an edit similarity of `least`.

    An edit takes one letter and two pairs of letters at most from a name, so of a name with k edits at most k bits of the
    letters and 2 k bits of the pairs are not the other's. What is left is compared letter by letter.
    """
    away = 1 - least

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = [b for b in batches if b.num_rows]
        if not kept:
            return
        t = pa.Table.from_batches(kept).sort_by([("n", "ascending")])
        right = np.asarray(t.column("side"))
        names, n, letters, more, grams, high = ([c.filter(pa.array(x)).combine_chunks() for x in (~right, right)] for c in (t.column(f.name) for f in _SIGNED))
        n = [x.to_numpy() for x in n]
        letters, more, grams, high = ([x.to_numpy().view(np.uint64) for x in y] for y in (letters, more, grams, high))
        count, count_more, *count_grams = ([np.bitwise_count(x).astype(np.int16) for x in y] for y in (letters, more, grams, high))
        count_grams = [x + y for x, y in zip(*count_grams)]
        all_letters = [x + y for x, y in zip(count, count_more)]
        places, codes = _places(_codes(names[0].to_pylist(), LONG)), _codes(names[1].to_pylist(), 2 * LONG)
        for length in np.unique(n[0]).tolist():
            begin, end = (int(x) for x in np.searchsorted(n[1], [np.ceil(length * least - 1e-9), np.floor(length / least + 1e-9) + 0.5]))
            if begin == end:
                continue
            k = np.floor(np.maximum(n[1][begin:end], length) * away + 1e-9).astype(np.int16)
            own = np.flatnonzero(n[0] == length)
            waiting: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

            def near() -> Iterator[pa.RecordBatch]:
                i, j, most = (np.concatenate(x) for x in zip(*waiting))
                waiting.clear()
                exact = np.flatnonzero((n[0][i] <= LONG) & (n[1][j] <= 2 * LONG))
                ok = np.ones(len(i), bool)
                if len(exact):
                    ok[exact] = _distances(places, length, i[exact], codes, n[1], j[exact], most[exact]) <= most[exact]
                if ok.any():
                    yield pa.RecordBatch.from_arrays([names[0].take(pa.array(i[ok])), names[1].take(pa.array(j[ok]))], schema=_PAIR)

            first, edits = (count_grams, 2 * k) if length > BY_PAIRS else (count, k)
            for bits in np.unique(first[0][own]).tolist():
                need = np.clip(np.maximum(first[1][begin:end], bits) - edits, 0, 128).astype(np.uint8)
                some = own[first[0][own] == bits]
                rows = max(1, STEP // (end - begin))
                for at in range(0, len(some), rows):
                    part = some[at : at + rows]
                    if length > BY_PAIRS:
                        common = np.bitwise_count(grams[0][part][:, None] & grams[1][begin:end][None])
                        common += np.bitwise_count(high[0][part][:, None] & high[1][begin:end][None])
                    else:
                        common = np.bitwise_count(letters[0][part][:, None] & letters[1][begin:end][None])
                    got = np.flatnonzero(common >= need[None])
                    i, j = part[got // (end - begin)], got % (end - begin)
                    most, j = k[j], j + begin
                    ok = np.bitwise_count(grams[0][i] & grams[1][j]) + np.bitwise_count(high[0][i] & high[1][j]) >= np.maximum(count_grams[0][i], count_grams[1][j]) - 2 * most
                    i, j, most = i[ok], j[ok], most[ok]
                    both = np.bitwise_count(letters[0][i] & letters[1][j]).astype(np.int16) + np.bitwise_count(more[0][i] & more[1][j])
                    ok = both >= np.maximum(all_letters[0][i], all_letters[1][j]) - most
                    waiting.append((i[ok], j[ok], most[ok]))
                    if sum(len(x) for x, _, _ in waiting) >= STEP // 4 or len(waiting) >= 4096:
                        yield from near()
            if waiting:
                yield from near()

    return run


def edit_similar_pairs(asked: DataFrame, known: DataFrame, least: float = 0.8, chunk: int = CHUNK) -> DataFrame:
    """a, b, similarity of all pairs of a name of `asked` and one of `known` with an edit similarity of `least` or more.

    asked, known: one string column each. Names are cut into chunks by a hash; a chunk of one side and one of the other meet
    in one task, a cell, each name as its length and 256 bits. Of names of lengths L and l at most (1 - least) * max(L, l)
    letters differ; pairs of lengths that allow it are compared by bitmaps, those left over letter by letter, and only similar ones are rows.
    So no pair is left out, and what is shuffled is each name once for every chunk of the other side. Comparisons grow with
    the product of the sides, at about a nanosecond each. Null and empty names match nothing; repeated ones count once.
    """
    spark = asked.sparkSession
    signed = lambda df: staged(df.select(F.col(df.columns[0]).alias("name")).where("name <> ''").distinct().mapInArrow(_signed, _SIGNED_DDL), "names")
    sides = [signed(asked), signed(known)]
    sizes = [max(1, x.count()) for x in sides]
    chunks = [-(-x // chunk) for x in sizes]
    while chunks[0] * chunks[1] < spark.sparkContext.defaultParallelism and sizes[0] * sizes[1] > WORTH * chunks[0] * chunks[1]:
        chunks[sizes[0] // chunks[0] < sizes[1] // chunks[1]] += 1
    mine = lambda s: F.pmod(F.xxhash64("name"), F.lit(chunks[s])).cast("int")
    every = lambda s: F.explode(F.sequence(F.lit(0), F.lit(chunks[1 - s] - 1)))
    a = sides[0].withColumn("other", every(0)).withColumns({"cell": mine(0) * chunks[1] + F.col("other"), "side": F.lit(False)})
    b = sides[1].withColumn("other", every(1)).withColumns({"cell": F.col("other") * chunks[1] + mine(1), "side": F.lit(True)})
    cells = a.unionByName(b).drop("other").repartitionById(chunks[0] * chunks[1], "cell")
    pairs = cells.mapInArrow(_alike(least), "a string, b string")
    return pairs.withColumn("similarity", 1 - F.levenshtein("a", "b") / F.greatest(F.length("a"), F.length("b"))).where(F.col("similarity") >= least - 1e-9)
