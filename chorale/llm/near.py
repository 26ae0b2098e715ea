"""Near-duplicate records with small edits (problem 6): a metric-space join, exact at every size.

The metric is the set difference of trigram sets, of which the Jaccard similarity sets the radius: of two
records that are similar enough, x lacks at most b(x) = |x| - ceil(t |x|) of its trigrams in the other.
Pivots are the sets of one trigram. A record is nearer to a pivot the rarer the pivot's trigram is among
those it has; its Voronoi region is that of its nearest pivot, and by the radius a record within reach has
one of the nearest b(x) + 1 pivots too: these are the window, and the record is replicated to each of their
regions. A region with more than `HOT` records is not compared but split recursively by the next nearest
pivot within what is left of the radius, over tasks; after `LEVELS` splits by pairs of chunks. A split has a
row for each further pivot, so it is made in rounds, each of some of the regions that are split and of no more
rows than the first regions have: what is on disk at once grows with the records, however many regions are hot. Within a
region sizes and places leave out pairs that can't overlap enough, 128-bit bitmaps of the sets (their
difference never exceeds the sets') most others, and what remains is checked with the whole texts.
Records as pivots replicate each record to nearly every region; see the README.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chorale.llm.graph import components
from chorale.plans.stage import staged

THRESHOLD = 0.75
#: Slots of trigrams: two trigrams of one slot are one pivot, which can only add candidates. Fixed, so the counts' size is.
SLOTS = 1 << 19
#: Slots in which split regions are marked. Fixed; a region marked for another is split as well, and loses nothing.
MARKS = 1 << 20
#: Records of a region that are compared in one task; larger regions are split.
HOT = 50_000
#: Splits by further pivots before chunks.
LEVELS = 3
#: Rows of regions that a task takes at once.
BUCKET = 500_000


def normal_text(fields: list[Column | str]) -> Column:
    """The fields joined by blanks, in lower case, runs of anything but letters and digits made one blank."""
    parts = [F.coalesce(F.col(f) if isinstance(f, str) else f, F.lit("")) for f in fields]
    return F.regexp_replace(F.lower(F.concat_ws(" ", *parts)), r"[^\p{L}\p{N}]+", " ")


def trigrams(text: str) -> frozenset[str]:
    return frozenset(map("".join, zip(text, text[1:], text[2:])))


#: Bits of code points above the first plane in a trigram's number.
_ASTRAL = np.uint64(sum(0x1F0000 << k for k in (0, 21, 42)))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _all_grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """owner, number of every trigram of every text."""
    lengths = np.array([len(t) for t in texts], np.int64)
    points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    own = np.repeat(np.arange(len(texts), dtype=np.int64), lengths)
    if len(points) < 3:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    inside = own[2:] == own[:-2]
    gram = (points[:-2] << np.uint64(42)) | (points[1:-1] << np.uint64(21)) | points[2:]  # code points have 21 bits
    return own[:-2][inside], gram[inside]


def gram_sets(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """owner, number of every distinct trigram of every text (in order of owner), and each text's count of them."""
    own, gram = _all_grams(texts)
    if not len(own):
        return own, gram, np.zeros(len(texts), np.int64)
    if not (gram & _ASTRAL).any() and len(texts) < 1 << 15:
        gram = (gram & np.uint64(0xFFFF)) | (gram >> np.uint64(21) & np.uint64(0xFFFF)) << np.uint64(16) | (gram >> np.uint64(42)) << np.uint64(32)
        both = np.sort(own.astype(np.uint64) << np.uint64(48) | gram)
        both = both[np.r_[True, both[1:] != both[:-1]]]
        own, gram = (both >> np.uint64(48)).astype(np.int64), both & np.uint64((1 << 48) - 1)
        gram = (gram & np.uint64(0xFFFF)) | (gram >> np.uint64(16) & np.uint64(0xFFFF)) << np.uint64(21) | (gram >> np.uint64(32)) << np.uint64(42)
    else:
        order = np.lexsort((gram, own))
        own, gram = own[order], gram[order]
        new = np.r_[True, (own[1:] != own[:-1]) | (gram[1:] != gram[:-1])]
        own, gram = own[new], gram[new]
    return own, gram, np.bincount(own, minlength=len(texts))


def _bits(own: np.ndarray, mixed: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Two words of 64 bits of every text, a bit for each of its trigrams."""
    bit = mixed >> np.uint64(57)
    one = np.uint64(1) << (bit & np.uint64(63))
    out = np.zeros((2, n), np.uint64)
    if len(own):
        first = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
        out[0, own[first]] = np.bitwise_or.reduceat(np.where(bit < 64, one, 0), first)
        out[1, own[first]] = np.bitwise_or.reduceat(np.where(bit < 64, 0, one), first)
    return out[0], out[1]


def bitmaps(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    own, gram, _ = gram_sets(texts)
    low, high = _bits(own, _mixed(gram), len(texts))
    return low.view(np.int64), high.view(np.int64)


def _slots_seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How often trigrams of a slot stand in the texts; repeats within a text count too, as any order of pivots will do."""
    seen = np.zeros(SLOTS, np.int64)
    for b in batches:
        _, gram = _all_grams(b.column(0).to_pylist())
        seen += np.bincount((_mixed(gram) & np.uint64(SLOTS - 1)).astype(np.int64), minlength=SLOTS)
    at = np.flatnonzero(seen)
    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(seen[at])], names=["slot", "n"])


#: What a row of a region holds: the region, the number of distinct trigrams, how many of the record's nearer pivots are not shared, the chunk's side, the bitmap.
_FIELDS = (("region", np.uint32), ("size", np.uint32), ("pos", np.uint32), ("side", np.uint8), ("low", np.uint64), ("high", np.uint64))


def _packed(columns: list[np.ndarray]) -> bytes:
    """Columns one after the other, each byte by byte of its numbers, so that what is alike lies together."""
    return b"".join(c.astype(t).view(np.uint8).reshape(len(c), -1).T.tobytes() for c, (_, t) in zip(columns, _FIELDS))


def _unpacked(blobs: list[bytes]) -> list[np.ndarray]:
    width = sum(np.dtype(t).itemsize for _, t in _FIELDS)
    out: list[list[np.ndarray]] = [[] for _ in _FIELDS]
    for x in blobs:
        n, at = len(x) // width, 0
        for k, (_, t) in enumerate(_FIELDS):
            w = np.dtype(t).itemsize
            out[k].append(np.ascontiguousarray(np.frombuffer(x, np.uint8, n * w, at).reshape(w, n).T).view(t).ravel())
            at += n * w
    return [np.concatenate(x) if x else np.zeros(0, t) for x, (_, t) in zip(out, _FIELDS)]


def _mark(region: np.ndarray) -> np.ndarray:
    return (_mixed(region.astype(np.uint64)) & np.uint64(MARKS - 1)).astype(np.int64)


def lacking(sizes: np.ndarray, threshold: float) -> np.ndarray:
    """How many trigrams of a set at most are not in one that is similar enough."""
    return sizes - np.ceil(threshold * sizes - 1e-9).astype(np.int64)


class Regions:
    """The regions of a batch of texts; level by level, only those of which all before are marked, and of these one round's."""

    def __init__(self, rank: np.ndarray, marks: list[np.ndarray], chunks: np.ndarray | None, threshold: float, turn: tuple[int, int] = (0, 1)):
        self.rank, self.marks, self.chunks, self.threshold, self.turn = rank, marks, chunks, threshold, turn

    def of(self, texts: list[str]) -> list[np.ndarray]:
        n, level = len(texts), len(self.marks)
        own, gram, sizes = gram_sets(texts)
        mixed = _mixed(gram)
        low, high = _bits(own, mixed, n)
        both = np.sort(own.astype(np.uint64) << np.uint64(32) | self.rank[(mixed & np.uint64(SLOTS - 1)).astype(np.int64)])
        both = both[np.r_[True, both[1:] != both[:-1]]] if len(both) else both
        own, token = (both >> np.uint64(32)).astype(np.int64), both & np.uint64((1 << 32) - 1)
        b = lacking(sizes, self.threshold)
        have = np.bincount(own, minlength=n)
        start = np.cumsum(have) - have
        place = np.arange(len(own)) - start[own]
        near = place <= b[own] + level
        own, token, place = own[near], token[near], place[near]
        if level:  # all records have as many trigrams more in common, so that splits leave sets of a few trigrams whole
            every = np.tile(np.arange(n), level)
            ends = np.repeat(np.arange(level), n)
            some = have[every] + ends <= b[every] + level
            own, token, place = np.r_[own, every[some]], np.r_[token, np.uint64(1 << 31) + ends[some].astype(np.uint64)], np.r_[place, (have[every] + ends)[some]]
            order = np.lexsort((place, own))
            own, token, place = own[order], token[order], place[order]
        ends = np.searchsorted(own, np.arange(n), "right")
        keep = place <= b[own]
        at, region = np.flatnonzero(keep), token[keep].astype(np.uint32)
        for k, marked in enumerate(self.marks):
            split = marked[_mark(region)]
            if not k:
                split &= _mixed(region.astype(np.uint64) + np.uint64(11)) % np.uint64(self.turn[1]) == self.turn[0]
            at, region = at[split], region[split]
            # the pivots behind, as far as the radius reaches
            further = np.minimum(ends[own[at]] - at - 1, np.maximum(b[own[at]] + k + 1 - place[at], 0))
            to = np.repeat(at, further) + 1 + np.arange(further.sum()) - np.repeat(np.cumsum(further) - further, further)
            region = (_mixed(np.repeat(region, further).astype(np.uint64) << np.uint64(32) | token[to]) >> np.uint64(32)).astype(np.uint32)
            at = to
        own, pos = own[at], place[at] - level
        side = np.full(len(own), 2, np.uint8)
        if self.chunks is not None:
            times = self.chunks[_mark(region)]  # none for regions that were compared before
            row = np.repeat(np.arange(len(own)), times)
            other = np.arange(len(row)) - np.repeat(np.cumsum(times) - times, times)
            region, own, pos = region[row], own[row], pos[row]
            mine = (_mixed(low[own] ^ _mixed(high[own])) % times[row].astype(np.uint64)).astype(np.int64)
            side = np.where(mine == other, 2, np.where(mine < other, 0, 1)).astype(np.uint8)
            region = (_mixed(region.astype(np.uint64) << np.uint64(32) | (np.minimum(mine, other) << 16 | np.maximum(mine, other)).astype(np.uint64)) >> np.uint64(32)).astype(np.uint32)
        return [region, sizes[own], pos, side, low[own], high[own]]


def _regions(rank, marks: list, chunks, threshold: float, buckets: int, turn: tuple[int, int] = (0, 1)):
    """text -> bucket, rows: the rows of all regions of a bucket that a batch of records has."""
    schema = pa.schema([("bucket", pa.int32()), ("rows", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make = Regions(rank.value, [m.value for m in marks], chunks.value if chunks is not None else None, threshold, turn)
        for b in batches:
            for at in range(0, b.num_rows, 10_000):
                columns = make.of(b.column(0).slice(at, 10_000).to_pylist())
                bucket = (_mixed(columns[0].astype(np.uint64) + np.uint64(7)) % np.uint64(buckets)).astype(np.int32)
                order = np.lexsort((columns[0], bucket))
                bucket, columns = bucket[order], [c[order] for c in columns]
                first = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]]) if len(bucket) else np.zeros(0, np.int64)
                last = np.r_[first[1:], len(bucket)]
                yield pa.RecordBatch.from_arrays([pa.array(bucket[first]), pa.array([_packed([c[s:e] for c in columns]) for s, e in zip(first, last)], pa.binary())], schema=schema)

    return run


def candidates(region: np.ndarray, size: np.ndarray, pos: np.ndarray, side: np.ndarray, low: np.ndarray, high: np.ndarray, threshold: float, hot: int | None) -> tuple[np.ndarray, np.ndarray, list[tuple[int, int]]]:
    """Row numbers i, j of the pairs of one region that can be similar enough, and the marks (with counts) of regions that are too large.

    Rows are taken by size. Of two rows of sizes s <= r with p and q nearer pivots unshared, the sets overlap
    in s - p and in r - q at most, and a similarity of t needs t / (1 + t) of s + r.
    """
    share, most = threshold / (1 + threshold), (1 - threshold) / (1 + threshold)
    starts = np.flatnonzero(np.r_[True, region[1:] != region[:-1]]) if len(region) else np.zeros(0, np.int64)
    ends = np.r_[starts[1:], len(region)].astype(np.int64)
    out_i, out_j, large = [], [], []
    s, p = size.astype(np.float64), pos.astype(np.float64)
    top = np.minimum(s / threshold, (s - p) / share - s) + 1e-6  # sizes of partners at most, of the rows as the smaller one

    def keep(i: np.ndarray, j: np.ndarray) -> None:
        ok = s[j] <= top[i]
        i, j = i[ok], j[ok]
        both = s[i] + s[j]
        ok = np.bitwise_count(low[i] ^ low[j]) + np.bitwise_count(high[i] ^ high[j]) <= most * both + 1e-6
        i, j, both = i[ok], j[ok], both[ok]
        ok = (s[j] - p[j] >= share * both - 1e-6) & ((side[i] != side[j]) | (side[i] == 2))
        out_i.append(i[ok])
        out_j.append(j[ok])

    width = ends - starts
    few = (width > 1) & (width <= 64)
    rows = np.concatenate([np.arange(a, b) for a, b in zip(starts[few], ends[few])]) if few.any() else np.zeros(0, np.int64)
    last, d = np.repeat(ends[few], width[few]), 1
    while len(rows):
        inside = rows + d < last
        rows, last = rows[inside], last[inside]
        keep(rows, rows + d)
        d += 1
    for a, e in zip(starts[width > 64].tolist(), ends[width > 64].tolist()):
        if hot is not None and e - a > hot:
            large.append((int(_mark(region[a : a + 1])[0]), e - a))
            continue
        # rows of like reach together, the partners of a block by their sizes
        upto = a + np.searchsorted(s[a:e], top[a:e], "right")
        reach = np.flatnonzero(upto > np.arange(a, e) + 1)
        band = pos[a:e][reach] // 3
        blocks = [g[k : k + 64] + a for g in (reach[band == x] for x in np.unique(band)) for k in range(0, len(g), 64)]
        for i in blocks:
            begin, end = int(i[0]) + 1, int(upto[i - a].max())
            limit = np.minimum(most * (s[i].max() + s[begin:end]) + 1e-6, 255).astype(np.uint8)
            near = np.bitwise_count(low[i][:, None] ^ low[begin:end][None]) <= limit[None]
            got = np.flatnonzero(near)
            if len(got):
                x, y = i[got // (end - begin)], begin + got % (end - begin)
                more = y > x
                keep(x[more], y[more])
    none = np.zeros(0, np.int64)
    return np.concatenate(out_i) if out_i else none, np.concatenate(out_j) if out_j else none, large


_PAIR = pa.schema([("low_a", pa.int64()), ("high_a", pa.int64()), ("low_b", pa.int64()), ("high_b", pa.int64()), ("mark", pa.int64()), ("n", pa.int64())])
_PAIR_DDL = "low_a long, high_a long, low_b long, high_b long, mark long, n long"


def _compared(threshold: float, hot: int | None):
    """bucket, rows sorted by bucket -> the pairs of bitmaps to check, and the regions that are too large."""

    def joined(blobs: list[bytes]) -> pa.RecordBatch:
        columns = _unpacked(blobs)
        order = np.lexsort((columns[2], columns[1], columns[0]))
        columns = [c[order] for c in columns]
        i, j, large = candidates(*columns, threshold, hot)
        low, high = columns[4].view(np.int64), columns[5].view(np.int64)
        swap = (low[i] > low[j]) | (low[i] == low[j]) & (high[i] > high[j])
        i, j = np.where(swap, j, i), np.where(swap, i, j)
        pairs = [low[i], high[i], low[j], high[j]]
        if len(i):
            order = np.lexsort(pairs)
            pairs = [x[order] for x in pairs]
            new = np.r_[True, np.any([x[1:] != x[:-1] for x in pairs], axis=0)]
            pairs = [x[new] for x in pairs]
        n, m = len(pairs[0]), len(large)
        cols = [pa.concat_arrays([pa.array(x, pa.int64()), pa.nulls(m, pa.int64())]) for x in pairs]
        marks = [pa.concat_arrays([pa.nulls(n, pa.int64()), pa.array([x[k] for x in large], pa.int64())]) for k in range(2)]
        return pa.RecordBatch.from_arrays([*cols, *marks], schema=_PAIR)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, blobs = None, []
        for b in batches:
            for k, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if k != last and blobs:
                    yield joined(blobs)
                    blobs = []
                last = k
                blobs.append(x)
        if blobs:
            yield joined(blobs)

    return run


_LINK = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("nva", pa.int32()), ("nvb", pa.int32()), ("va1", pa.int64()), ("va2", pa.int64()), ("vb1", pa.int64()), ("vb2", pa.int64())])
_LINK_DDL = "a long, b long, nva int, nvb int, va1 long, va2 long, vb1 long, vb2 long"


def _checked(threshold: float):
    """Pairs of classes with their texts -> those that are similar enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets: dict[str, frozenset] = {}

        def of(t: str) -> frozenset:
            s = sets.get(t)
            if s is None:
                if len(sets) > 20_000:
                    sets.clear()
                s = sets[t] = trigrams(t)
            return s

        for b in batches:
            ok = []
            for x, y in zip(b.column("ta").to_pylist(), b.column("tb").to_pylist()):
                x, y = of(x), of(y)
                both = len(x & y)
                ok.append(both > 0 and both >= threshold * (len(x) + len(y) - both) - 1e-12)
            yield pa.RecordBatch.from_arrays([b.column(f.name).filter(pa.array(ok, pa.bool_())) for f in _LINK], schema=_LINK)

    return run


def _slot_array(df: DataFrame, key: str, size: int) -> np.ndarray:
    """Sums of n by slot; at most `size` rows reach the driver."""
    got = df.groupBy(key).agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(size, np.int64)
    out[got[key].to_numpy(np.int64)] = got["n"].to_numpy(np.int64)
    return out


def candidate_pairs(classes: DataFrame, threshold: float = THRESHOLD, hot: int = HOT, levels: int = LEVELS) -> DataFrame:
    """low_a, high_a, low_b, high_b: the bitmaps of all pairs of texts that can be similar enough, each once."""
    spark = classes.sparkSession
    texts = classes.select("text")
    counts = _slot_array(texts.mapInArrow(_slots_seen, "slot long, n long"), "slot", SLOTS)
    rank = np.empty(SLOTS, np.uint32)
    rank[np.lexsort((np.arange(SLOTS), counts))] = np.arange(SLOTS, dtype=np.uint32)
    rank_b = spark.sparkContext.broadcast(rank)
    # an eighth of the trigrams are nearest pivots of their records, and some more for smaller partners
    first = max(1.0, counts.sum() * 0.26)
    buckets = int(max(spark.sparkContext.defaultParallelism, first // BUCKET, 1))
    further = first / max(1, texts.count()) / 2 + 1  # pivots behind a region's, on average
    marks: list = []
    found: list[DataFrame] = []
    chunks, rounds = None, 1
    while True:
        last, parts = chunks is not None, []
        for turn in range(rounds):
            rows = texts.mapInArrow(_regions(rank_b, list(marks), chunks, threshold, buckets, (turn, rounds)), "bucket int, rows binary")
            rows = rows.repartitionById(buckets, "bucket").sortWithinPartitions("bucket").mapInArrow(_compared(threshold, None if last else hot), _PAIR_DDL)
            parts.append(staged(rows.distinct(), "candidates"))
        found += [x.where("low_a is not null").select("low_a", "high_a", "low_b", "high_b") for x in parts]
        if last:
            break
        large = reduce(DataFrame.unionByName, parts).where("low_a is null")
        if not large.limit(1).count():
            break
        size = _slot_array(large, "mark", MARKS)
        if len(marks) < levels:
            marks.append(spark.sparkContext.broadcast(size > 0))
            made = size.sum() * further
        else:
            times = np.minimum(-(-size // hot), 1 << 15).astype(np.int64)
            chunks, made = spark.sparkContext.broadcast(times), float((size * times).sum())
        rounds = int(-(-made // first))
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out.distinct() if len(found) > 1 else out


def _bitmapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        yield pa.RecordBatch.from_arrays([*b.columns, *map(pa.array, bitmaps(b.column("text").to_pylist()))], names=[*b.schema.names, "low", "high"])


def text_links(classes: DataFrame, threshold: float = THRESHOLD, hot: int = HOT, levels: int = LEVELS) -> DataFrame:
    """The links a, b between classes of records: cid, ckey, nv, v1, v2, text, low, high (bitmaps of the text's trigrams)."""
    pairs = candidate_pairs(classes, threshold, hot, levels)
    side = lambda x: classes.select(F.col("low").alias(f"low_{x}"), F.col("high").alias(f"high_{x}"), F.col("cid").alias(x), F.col("ckey").alias(f"k{x}"), F.col("nv").alias(f"nv{x}"), F.col("v1").alias(f"v{x}1"), F.col("v2").alias(f"v{x}2"), F.col("text").alias(f"t{x}"))
    both = pairs.join(side("a"), ["low_a", "high_a"]).join(side("b"), ["low_b", "high_b"])
    both = both.where("a <> b and (ka is null or kb is null or ka <> kb) and not (nva = 1 and nvb = 1 and va1 = vb1) and (low_a <> low_b or high_a <> high_b or a < b)")
    links = both.select(*[f.name for f in _LINK], "ta", "tb").mapInArrow(_checked(threshold), _LINK_DDL)
    return links


def near_duplicate_groups(records: DataFrame, threshold: float = THRESHOLD, hot: int = HOT, levels: int = LEVELS) -> DataFrame:
    """record_id, group_id, video, ckey of every record in a group of two or more.

    records: record_id, text (normal_text), video (long: records of one are never linked to each other),
    ckey (long: nor are records of one key; null is no key). Two records are linked if the Jaccard
    similarity of their texts' trigram sets is at least `threshold`; a group is what chains of links join.
    Records of one text and key are one vertex, so copies cost nothing; texts without a trigram are linked
    to nothing; null texts, ids or videos are left out; an empty table gives an empty one.
    """
    records = records.select("record_id", "text", "video", "ckey").where("record_id is not null and text is not null and video is not null").withColumn("cid", F.xxhash64("text", F.coalesce(F.col("ckey"), F.lit(0)), F.col("ckey").isNull()))
    classes = (
        records.where(F.length("text") > 2)
        .groupBy("cid")
        .agg(F.first("ckey", True).alias("ckey"), F.count_distinct("video").cast("int").alias("nv"), F.min("video").alias("v1"), F.max("video").alias("v2"), F.first("text").alias("text"))
    )
    classes = staged(classes.mapInArrow(_bitmapped, "cid long, ckey long, nv int, v1 long, v2 long, text string, low long, high long"), "texts")
    links = staged(text_links(classes, threshold, hot, levels), "links")

    # A class of three videos or more is one vertex, but for a video that is all its neighbours have; a
    # smaller class has a vertex for each video, as records of one video are not linked.
    own = lambda cid, video: F.xxhash64(cid, video)
    sides = links.select(F.col("a").alias("cid"), F.col("nva").alias("nv"), F.col("nvb").alias("other_nv"), F.col("vb1").alias("other_v")).unionByName(links.select(F.col("b").alias("cid"), F.col("nvb").alias("nv"), F.col("nva").alias("other_nv"), F.col("va1").alias("other_v")))
    unkeyed = classes.where("ckey is null and nv > 1").select("cid", "nv", "v1", "v2")
    sides = sides.unionByName(unkeyed.select("cid", "nv", F.col("nv").alias("other_nv"), F.col("v1").alias("other_v")))
    linked = sides.groupBy("cid").agg(
        F.first("nv").alias("nv"),
        F.when((F.max("other_nv") == 1) & (F.min("other_v") == F.max("other_v")) & (F.first("nv") > 2), F.min("other_v")).alias("but_for"),
    )
    vertices = lambda x: F.when(F.col(f"nv{x}") > 2, F.array(F.struct(F.col(x).alias("id"), F.lit(None).cast("long").alias("v")))).otherwise(
        F.array_distinct(F.array(F.struct(own(F.col(x), F.col(f"v{x}1")).alias("id"), F.col(f"v{x}1").alias("v")), F.struct(own(F.col(x), F.col(f"v{x}2")).alias("id"), F.col(f"v{x}2").alias("v"))))
    )
    pairs = links.select(F.explode(vertices("a")).alias("x"), vertices("b").alias("ys")).select("x", F.explode("ys").alias("y"))
    edges = pairs.where("x.v is null or y.v is null or x.v <> y.v").select(F.col("x.id").alias("a"), F.col("y.id").alias("b"))
    edges = edges.unionByName(unkeyed.where("nv = 2").select(own(F.col("cid"), F.col("v1")).alias("a"), own(F.col("cid"), F.col("v2")).alias("b")))
    # a large class without key holds together by itself
    edges = edges.unionByName(unkeyed.where("nv > 2").select(F.col("cid").alias("a"), F.xxhash64("cid", F.lit("itself")).alias("b")))
    groups = components(edges)
    members = records.select("record_id", "cid", "video", "ckey").join(linked, "cid")
    members = members.where("nv <= 2 or but_for is null or video <> but_for").withColumn("vertex", F.when(F.col("nv") > 2, F.col("cid")).otherwise(own(F.col("cid"), F.col("video"))))
    return members.join(groups, "vertex").select("record_id", F.col("component").alias("group_id"), "video", "ckey")


def group_pairs(groups: DataFrame) -> DataFrame:
    """record_a, record_b of every two records of a group, of different videos and keys."""
    a = groups.select("group_id", F.col("record_id").alias("record_a"), F.col("video").alias("va"), F.col("ckey").alias("ka"))
    b = groups.select("group_id", F.col("record_id").alias("record_b"), F.col("video").alias("vb"), F.col("ckey").alias("kb"))
    return a.join(b, "group_id").where("record_a < record_b and va <> vb and (ka is null or kb is null or ka <> kb)").select("record_a", "record_b")
