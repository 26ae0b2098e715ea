"""Evaluation texts leaking into training text (problem 9).

Method: passages of all documents become TF-IDF vectors over the words of the evaluation items; a
randomised SVD, summed up over all partitions, gives a latent space; passages near an item's passage
by cosine are candidates, and so are documents with some consecutive words of an item (a short run in other
text is far by cosine); they are then checked word by word (longest common run, longest common
subsequence, presence of the answer). Only tables of the size of the item set reach the driver.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chorale.plans.stage import staged

#: Words of a passage and between the starts of two; a run of WINDOW - STRIDE words lies whole in some passage.
WINDOW, STRIDE = 24, 12
#: Dimensions of the latent space, and extra ones for the randomised range.
RANK, EXTRA = 192, 16
#: Least cosine of a candidate; so many consecutive words in common make one by themselves.
COSINE, SHARED = 0.45, 7
#: A word in more than these shares of both the items and the documents carries no weight.
COMMON_ITEMS, COMMON_DOCS = 0.05, 0.02

_WORD = re.compile(r"[^\W_]+")
_TAGS = re.compile(r"</?[a-zA-Z][^<>]*>|<[^<>]{0,300}>|&(?:[a-zA-Z]{2,8}|#\d{1,6});")
_CUES = re.compile(
    r"^[ \t]*\d{1,6}[ \t]*\r?\n(?=[ \t]*\d{1,2}:\d{2})"  # numbers of cues
    r"|[\[(]?(?<![\w:])\d{1,3}:\d{2}(?::\d{2})?(?:[.,]\d{1,3})?(?![\w:])[\])]?",  # cue times
    re.MULTILINE,
)
_MARKS = re.compile(r"^[ \t]*(?:\d{1,3}[.)]|[a-zA-Z][.)]|\[[ xX]?\])(?=\s)", re.MULTILINE)


def words_of(text: str | None) -> list[str]:
    """The words that count: lower case, without punctuation, mark-up, cue times and line marks."""
    if not text:
        return []
    # each pattern is tried only where a sign it needs is in the text
    if "<" in text or "&" in text:
        text = _TAGS.sub(" ", text)
    if ":" in text:
        text = _CUES.sub(" ", text)
    if "." in text or ")" in text or "]" in text:
        text = _MARKS.sub(" ", text)
    return _WORD.findall(text.lower())


def longest_run(doc: list[int], item: list[int]) -> int:
    """Length of the longest run of consecutive words common to both; 0 is no word."""
    where: dict[int, list[int]] = {}
    for j, w in enumerate(item):
        where.setdefault(w, []).append(j)
    best, before = 0, {}
    for w in doc:
        now = {j: before.get(j - 1, 0) + 1 for j in where.get(w, ())} if w else {}
        if now:
            best = max(best, *now.values())
        before = now
    return best


def common_subsequence(doc: list[int], item: list[int]) -> int:
    """Length of the longest common subsequence, by bit-parallel rows."""
    masks: dict[int, int] = {}
    for j, w in enumerate(item):
        masks[w] = masks.get(w, 0) | 1 << j
    full = (1 << len(item)) - 1
    row = full
    for w in doc:
        m = row & masks.get(w, 0) if w else 0
        if m:
            row = ((row + m) | (row - m)) & full
    return len(item) - row.bit_count()


@dataclass
class _Items:
    ids: list[int]
    words: list[list[int]]
    answers: list[list[int]]
    vocabulary: dict[str, int]


def _read_items(items: DataFrame) -> _Items:
    rows = items.select("item_id", "item_text", "answer").where("item_id is not null").orderBy("item_id").collect()
    vocabulary: dict[str, int] = {}
    number = lambda text: [vocabulary.setdefault(w, len(vocabulary) + 1) for w in words_of(text)]
    return _Items([r[0] for r in rows], [number(r[1]) for r in rows], [number(r[2]) for r in rows], vocabulary)


def _numbered(vocabulary: dict[str, int], kind: str):
    """text -> its words as numbers of the vocabulary, 0 for all others, packed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get = vocabulary.get
        for b in batches:
            packed = []
            for text in b.column(1).to_pylist():
                words = words_of(text)
                packed.append(np.fromiter(map(get, words, repeat(0)), kind, len(words)).tobytes())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(packed, pa.binary())], names=["doc_id", "words"])

    return run


def _entries(packed: list[bytes], kind: str, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(stride, word) of every word with a weight, strides by number over the whole batch and in order; and the document of each number.

    Passage q consists of the strides q and q + 1; each document's first number and the one after its last have no words.
    """
    arrays = [np.frombuffer(x, kind) for x in packed]
    lengths = np.array([len(a) for a in arrays], np.int64)
    counts = lengths // STRIDE + 2
    first = np.concatenate([[0], np.cumsum(counts)])
    flat = np.concatenate(arrays) if arrays else np.zeros(0, kind)
    at = np.flatnonzero(weight[flat] > 0)
    doc = np.repeat(np.arange(len(arrays)), lengths)[at]
    place = at - np.repeat(np.cumsum(lengths) - lengths, lengths)[at]
    return first[doc] + 1 + place // STRIDE, flat[at], np.repeat(np.arange(len(arrays)), counts)


def _stride_sums(stride: np.ndarray, word: np.ndarray, table: np.ndarray, most: int = 30_000) -> Iterator[tuple[np.ndarray, ...]]:
    """For about `most` words at a time, strides whole: the numbers of the strides with words, the place after
    each one's last word, the sums of the words' rows of `table` in it, in the stride before and in the one
    after, whether the one before has words, and the words.

    A word is added up once, though it is in two passages; what is spread over the dimensions stays small.
    """
    starts = np.flatnonzero(np.r_[True, stride[1:] != stride[:-1]]) if len(stride) else np.zeros(0, np.int64)
    numbers, ends = stride[starts], np.r_[starts[1:], len(stride)]
    k = 0
    while k < len(starts):
        n = max(k + 1, int(np.searchsorted(starts, starts[k] + most)))
        lo, hi = max(0, k - 1), min(len(starts), n + 1)
        sums = np.add.reduceat(table[word[starts[lo] : ends[hi - 1]]], starts[lo:hi] - starts[lo], axis=0)
        none = np.zeros((1, table.shape[1]), table.dtype)
        before = sums[k - 1 - lo : n - 1 - lo] if k else np.concatenate([none, sums[: n - 1]])
        after = sums[k + 1 - lo : n + 1 - lo] if n < len(starts) else np.concatenate([sums[k + 1 - lo :], none])
        own = numbers[k:n]
        # only neighbours by number count
        linked = np.r_[numbers[k - 1] if k else -9, own[:-1]] == own - 1
        links = np.r_[own[1:], numbers[n] if n < len(numbers) else -9] == own + 1
        yield own, ends[k:n] - starts[k], sums[k - lo : n - lo], before * linked[:, None], after * links[:, None], linked, word[starts[k] : ends[n - 1]]
        k = n


def _document_counts(kind: str, size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(size, np.int64)
        for b in batches:
            for x in b.column(0).to_pylist():
                counts[np.unique(np.frombuffer(x, kind))] += 1
        seen = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int64()), pa.array(counts[seen], pa.int64())], names=["word", "n"])

    return run


def _products(kind: str, weight: np.ndarray, omega: np.ndarray):
    """Of the partition's passages A: the rows of A'(A omega) that are not zero."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, weighed = np.zeros(omega.shape, np.float64), omega * weight[:, None]
        for b in batches:
            stride, word, _ = _entries(b.column(0).to_pylist(), kind, weight)
            for _, ends, sums, before, after, _, words in _stride_sums(stride, word, weighed):
                # a word is in the passage its stride begins and in the one it ends
                back = np.repeat(before + 2 * sums + after, np.diff(np.r_[0, ends]), axis=0) * weight[words][:, None]
                order = np.argsort(words, kind="stable")
                firsts = np.flatnonzero(np.r_[True, np.diff(words[order]) != 0])
                total[words[order][firsts]] += np.add.reduceat(back[order], firsts, axis=0)
        some = np.flatnonzero(np.abs(total).sum(1))
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array([total[i].tobytes() for i in some], pa.binary())], names=["word", "sums"])

    return run


def _summed(rows: pd.DataFrame) -> pd.DataFrame:
    total = sum(np.frombuffer(x, np.float64) for x in rows["sums"])
    return pd.DataFrame({"word": [rows["word"].iloc[0]], "sums": [total.tobytes()]})


def _only(seq: np.ndarray, words: list[int], mask: np.ndarray) -> list[int]:
    """The places of `seq` that hold some of `words`, each stretch of others as one 0: runs and subsequences in common with them stay. `mask` is false everywhere."""
    mask[words] = True
    mask[0] = False
    some = mask[seq]
    mask[words] = False
    keep = some.copy()
    keep[1:] |= some[:-1]
    return np.where(some, seq, 0)[keep].tolist()


def _shingles(words: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Where n consecutive words are all of the items' vocabulary, and a number for each."""
    if len(words) < n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    w = words.astype(np.uint64)
    h, ok = np.zeros(len(w) - n + 1, np.uint64), np.ones(len(w) - n + 1, bool)
    for k in range(n):
        part = w[k : len(w) - n + 1 + k]
        h = (h ^ part) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
        ok &= part > 0
    return np.flatnonzero(ok), h[ok].view(np.int64)


def _item_shingles(items: list[list[int]], n: int) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of all items' runs of n words, sorted, and the item of each."""
    got = [np.unique(_shingles(np.array(w, np.int64), n)[1]) for w in items]
    numbers, of = np.concatenate([np.zeros(0, np.int64), *got]), np.repeat(np.arange(len(got)), [len(x) for x in got])
    order = np.lexsort((of, numbers))
    return numbers[order], of[order]


def _sharing(packed: list[bytes], kind: str, n: int, numbers: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The document (by place) and item of every pair that has n consecutive words in common."""
    gap = np.zeros(1, kind)  # no run reaches into the next document
    arrays = [x for p in packed for x in (np.frombuffer(p, kind), gap)]
    ends = np.cumsum([len(p) // gap.itemsize + 1 for p in packed])
    at, h = _shingles(np.concatenate([gap, *arrays])[1:], n)
    first, last = np.searchsorted(numbers, h), np.searchsorted(numbers, h, "right")
    some = np.flatnonzero(last > first)
    many = (last - first)[some]
    doc = np.repeat(np.searchsorted(ends, at[some], "right"), many)
    item = of[np.repeat(first[some] - (np.cumsum(many) - many), many) + np.arange(many.sum())]
    return tuple(np.unique(np.stack([doc, item]), axis=1).astype(np.int64))


def _passages(words: list[int]) -> list[list[int]]:
    return [words[i : i + WINDOW] for i in range(0, max(1, len(words) - WINDOW + STRIDE), STRIDE)]


def leaks(documents: DataFrame, items: DataFrame, cosine: float = COSINE, rank: int = RANK, seed: int = 7, shared: int = SHARED, least_run: int = 0) -> DataFrame:
    """doc_id, item_id, cosine, run_words, subsequence_words, item_words, answer_found of every candidate.

    Candidates are near by cosine in the latent space; as an exact rest for runs of words within other
    text, those that have `shared` consecutive words in common are checked below that cosine too. With
    `least_run` (of `shared` or more) only pairs with such a run come out: one without `shared` consecutive
    words in common has none, so its other checks are saved.

    documents: doc_id, text. items: item_id, item_text, answer; of a size that fits the driver (held-out
    tests do). All documents are searched over their whole text. A null or empty text has no candidates,
    nor has an empty table; items without words match nothing; repeated rows come out repeatedly.
    """
    spark = documents.sparkSession
    known = _read_items(items)
    size = len(known.vocabulary) + 1
    kind = "int16" if size < 32_000 else "int32"
    schema = "doc_id long, item_id long, cosine double, run_words long, subsequence_words long, item_words long, answer_found boolean"
    if size == 1:
        return spark.createDataFrame([], schema)
    numbered = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("text is not null").mapInArrow(_numbered(known.vocabulary, kind), "doc_id long, words binary")
    numbered = staged(numbered, "words")
    total = max(1, numbered.count())
    counts = np.zeros(size)
    for word, n in numbered.select("words").mapInArrow(_document_counts(kind, size), "word long, n long").groupBy("word").agg(F.sum("n")).collect():
        counts[word] = n
    in_items = np.zeros(size)
    for w in known.words:
        in_items[np.unique(w).astype(int)] += 1
    weight = np.maximum(1.0, np.log((1 + total) / (1 + counts)))
    weight[(in_items > COMMON_ITEMS * len(known.words)) & (counts > max(20, COMMON_DOCS * total))] = 0
    weight[0] = 0

    passages = [(i, p) for i, w in enumerate(known.words) for p in _passages(w)]
    held = np.zeros((len(passages), size), np.float32)
    for r, (_, p) in enumerate(passages):
        np.add.at(held[r], p, weight[p])
    dims = min(rank + EXTRA, size)
    omega = np.random.default_rng(seed).standard_normal((size, dims))
    product = held.T.astype(float) @ (held @ omega)  # the items' passages are rows of the matrix too
    parts = numbered.select("words").mapInArrow(_products(kind, weight, omega), "word long, sums binary")
    for word, sums in parts.groupBy("word").applyInPandas(_summed, "word long, sums binary").collect():
        product[word] += np.frombuffer(sums, np.float64)
    basis, strength, _ = np.linalg.svd(product, full_matrices=False)
    basis = (basis[:, :rank] * (strength[:rank] > 1e-9 * max(strength[0], 1e-300))).astype(np.float32)

    unit = lambda x: x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
    latent = unit(held @ basis)
    sent = spark.sparkContext.broadcast((weight, (weight[:, None] * basis).astype(np.float32), latent, np.array([i for i, _ in passages]), known.ids, known.words, known.answers, *_item_shingles(known.words, shared)))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight, project, latent, of_item, ids, item_words, answers, numbers, run_of = sent.value
        mask = np.zeros(len(weight), bool)
        for b in batches:
            docs, packed = b.column(0).to_pylist(), b.column(1).to_pylist()
            stride, word, doc_of = _entries(packed, kind, weight)
            out: list[tuple] = []
            run_doc, run_item = _sharing(packed, kind, shared, numbers, run_of)
            runs = run_doc * len(ids) + run_item
            has_run = np.zeros(len(docs), bool)
            has_run[run_doc] = True
            pairs, cosines = [runs], [np.zeros(len(runs), np.float32)]
            for own, _, one, _, after, linked, _ in _stride_sums(stride, word, project):
                rows, sums = np.concatenate([own, own[~linked] - 1]), np.concatenate([one + after, one[~linked]])
                for s in range(0, len(rows), 4096):
                    near = unit(sums[s : s + 4096]) @ latent.T
                    r, c = np.nonzero(near >= cosine)
                    pairs.append(doc_of[rows[s + r]] * len(ids) + of_item[c])
                    cosines.append(near[r, c])
                    of_run = np.flatnonzero(has_run[doc_of[rows[s : s + 4096]]])
                    pair = (doc_of[rows[s + of_run]] * len(ids))[:, None] + of_item
                    low = np.isin(pair, runs)
                    pairs.append(pair[low])
                    cosines.append(near[of_run][low])
            if sum(map(len, pairs)):
                pair, at = np.unique(np.concatenate(pairs), return_inverse=True)
                best = np.zeros(len(pair), np.float32)
                np.maximum.at(best, at, np.concatenate(cosines))
                if least_run >= shared:
                    has = np.isin(pair, runs)
                    pair, best = pair[has], best[has]
                for p, near_by in zip(pair.tolist(), best.tolist()):
                    d, i = divmod(p, len(ids))
                    whole, answer = np.frombuffer(packed[d], kind), answers[i]
                    seq = _only(whole, item_words[i], mask)
                    out.append((docs[d], ids[i], near_by, longest_run(seq, item_words[i]), common_subsequence(seq, item_words[i]), len(item_words[i]), bool(answer) and longest_run(_only(whole, answer, mask), answer) == len(answer)))
            yield pa.RecordBatch.from_pylist([dict(zip(_LEAK.names, x)) for x in out], schema=_LEAK)

    return numbered.mapInArrow(search, schema)


_LEAK = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("cosine", pa.float64()), ("run_words", pa.int64()), ("subsequence_words", pa.int64()), ("item_words", pa.int64()), ("answer_found", pa.bool_())])


def contaminated(documents: DataFrame, items: DataFrame, run: int = 9, **options) -> DataFrame:
    """The candidates that contain at least `run` consecutive words of the item."""
    return leaks(documents, items, shared=min(run, SHARED), least_run=run, **options).where(F.col("run_words") >= run)


def paraphrases(documents: DataFrame, items: DataFrame, run: int = 9, share: float = 0.6, with_answer: float = 0.4, **options) -> DataFrame:
    """The candidates without such a run that have most of an item's words in its order, or a good part of them and its answer.

    A candidate counts if its longest common subsequence with the item is `share` of the item's words or
    more, or `with_answer` of them and the document holds the answer.
    """
    enough = (F.col("subsequence_words") >= share * F.col("item_words")) | (F.col("answer_found") & (F.col("subsequence_words") >= with_answer * F.col("item_words")))
    return leaks(documents, items, shared=min(run, SHARED), **options).where((F.col("run_words") < run) & enough)
