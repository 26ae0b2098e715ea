"""Filling fixed-capacity containers with items (problem 8).

Method: the cost of a sequence is estimated as linear plus quadratic in the lengths it holds (attention);
documents in descending length go to the lowest-cost sequence with enough capacity left. Documents are
spread over shards of a bounded number of tokens, each packed by one task.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chorale.plans.stage import staged

#: Files of public tokenizers; a parameter of every operator here.
TOKENIZERS = "/opt/tokenizers"
VOCABULARY = "byte_bpe_50k.tiktoken"
#: Tokens in a shard, about; a task holds one shard's lengths only.
SHARD_TOKENS = 4_000_000

_LOADED: dict[str, object] = {}


def _encoder(folder: str, name: str):
    """The tokenizer of a vocabulary file, loaded once in each Python worker."""
    key = f"{folder}/{name}"
    if key not in _LOADED:
        import base64
        import importlib.util

        import tiktoken

        spec = importlib.util.spec_from_file_location("_tokenizer_files", f"{folder}/__init__.py")
        files = importlib.util.module_from_spec(spec)
        spec.loader.exec_module(files)
        with open(key, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _LOADED[key] = tiktoken.Encoding(name, pat_str=files.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _LOADED[key]


def token_counts(documents: DataFrame, folder: str = TOKENIZERS, vocabulary: str = VOCABULARY) -> DataFrame:
    """doc_id, n_tokens of every document over its whole text; a null or empty text has 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoder(folder, vocabulary).encode_ordinary
        for b in batches:
            counts = [len(encode(t)) if t else 0 for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(counts, pa.int64())], names=["doc_id", "n_tokens"])

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_tokens long")


def pack(lengths: np.ndarray, capacity: int, linear: float = 1.0, quadratic: float = 1 / 1024) -> np.ndarray:
    """The sequence of every length (all within 1 to capacity), by lowest cost with room.

    A tree over the room left holds at every leaf the sequences with that room by cost, and at every node
    the lowest cost below it; so the lowest-cost sequence with room for a length is found in log(capacity).
    Sequences start as many as the tokens need; another is opened only when no sequence has room.
    """
    order = np.argsort(-lengths, kind="stable")
    width = 1 << capacity.bit_length()
    none = float("inf")
    tree = [none] * (2 * width)
    leaves: list[list] = [[] for _ in range(capacity + 1)]

    def put(room: int, cost: float, sequence: int) -> None:
        heapq.heappush(leaves[room], (cost, sequence))
        update(room)

    def update(room: int) -> None:
        i = room + width
        tree[i] = leaves[room][0][0] if leaves[room] else none
        i >>= 1
        while i:
            low = min(tree[2 * i], tree[2 * i + 1])
            if tree[i] == low:
                break
            tree[i] = low
            i >>= 1

    def lowest(at_least: int) -> int:
        """The room of the lowest-cost sequence with that much room, -1 if there is none."""
        lo, hi, best, node = at_least + width, 2 * width, none, 0
        while lo < hi:
            if lo & 1:
                if tree[lo] < best:
                    best, node = tree[lo], lo
                lo += 1
            if hi & 1:
                hi -= 1
                if tree[hi] < best:
                    best, node = tree[hi], hi
            lo >>= 1
            hi >>= 1
        if not node:
            return -1
        while node < width:
            node = 2 * node + (tree[2 * node] != best)
        return node - width

    opened = -(-int(lengths.sum()) // capacity)
    leaves[capacity] = [(0.0, s) for s in range(opened)]
    update(capacity)
    out = np.empty(len(lengths), np.int64)
    for k in order.tolist():
        n = int(lengths[k])
        room = lowest(n)
        if room < 0:
            room, cost, sequence = capacity, 0.0, opened
            opened += 1
        else:
            cost, sequence = heapq.heappop(leaves[room])
            update(room)
        out[k] = sequence
        put(room - n, cost + linear * n + quadratic * n * n, sequence)
    return out


def _tightened(lengths: np.ndarray, sequence: np.ndarray, capacity: int) -> np.ndarray:
    """Empty the emptiest sequences into the room left in others, as long as all their items fit; renumber."""
    count = int(sequence.max()) + 1 if len(sequence) else 0
    room = capacity - np.bincount(sequence, lengths, count).astype(np.int64)
    order = np.argsort(sequence, kind="stable")
    ends = np.searchsorted(sequence[order], np.arange(count + 1))
    by_room: list[set] = [set() for _ in range(capacity + 1)]
    for s in range(count):
        by_room[room[s]].add(s)
    dissolved = np.zeros(count, bool)
    failures = 0
    for s in np.argsort(-room, kind="stable").tolist():
        if failures > PATIENCE:
            break
        own = order[ends[s] : ends[s + 1]]
        if (sequence[own] != s).any() or dissolved[s] or (len(own) and own.size and capacity - room[s] != lengths[own].sum()):
            continue
        by_room[room[s]].discard(s)
        moves: list[tuple[int, int]] = []
        for k in sorted(own.tolist(), key=lambda k: -lengths[k]):
            n = int(lengths[k])
            fit = next((r for r in range(n, capacity + 1) if by_room[r]), -1)
            if fit < 0:
                break
            t = min(by_room[fit])
            by_room[fit].discard(t)
            room[t] = fit - n
            by_room[fit - n].add(t)
            moves.append((k, t))
        if len(moves) == len(own):
            for k, t in moves:
                sequence[k] = t
            dissolved[s] = True
            failures = 0
        else:
            for k, t in reversed(moves):
                by_room[room[t]].discard(t)
                room[t] += lengths[k]
                by_room[room[t]].add(t)
            by_room[room[s]].add(s)
            failures += 1
    used = np.unique(sequence)
    return np.searchsorted(used, sequence)


#: Sequences in a row that can't be emptied before no more are tried; it costs fill, never an item. Targets that are made part of the plan.
PATIENCE, MOST_LITERAL = 64, 1000

PACKED = "target_id long, doc_id long, piece long, n_tokens long, container long"


def packed(counts: DataFrame, targets: DataFrame, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """target_id, doc_id, piece, n_tokens, container of every document for every target.

    counts: doc_id, n_tokens (counted once; staged by the caller). targets: target_id, capacity_tokens, a
    few rows. A document within the capacity is one piece (1) in one container; a larger one is cut into
    pieces of the capacity and a rest. Documents of 0 tokens or null length come out with a null container;
    targets without a capacity of 1 or more are left out. Container numbers are unique within a target.
    """
    counts = counts.select("doc_id", "n_tokens")
    total = counts.agg(F.sum("n_tokens")).collect()[0][0] or 0
    shards = max(1, -(-int(total) // shard_tokens))
    limits = targets.where("capacity_tokens >= 1").select(F.col("target_id").cast("long").alias("target_id"), F.col("capacity_tokens").cast("long").alias("capacity")).dropDuplicates(["target_id"])
    few = limits.limit(MOST_LITERAL + 1).collect()
    sharded = counts.withColumn("shard", F.pmod(F.xxhash64("doc_id"), F.lit(shards)))
    if len(few) > MOST_LITERAL:
        spread = sharded.withColumn("one", F.lit(1)).join(limits.withColumn("one", F.lit(1)), "one").drop("one")
    else:  # a few targets are part of the plan, so there is no join
        each = [F.struct(F.lit(r.target_id).cast("long").alias("target_id"), F.lit(r.capacity).cast("long").alias("capacity")) for r in few]
        spread = sharded.select("*", F.inline(F.array(*each) if each else F.from_json(F.lit("[]"), "array<struct<target_id: long, capacity: long>>")))

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        shard, capacity = int(key[1]), int(rows["capacity"].iloc[0])
        n, doc = rows["n_tokens"].fillna(0).to_numpy(np.int64), rows["doc_id"]
        at = np.lexsort((doc.to_numpy(), -n))
        n, doc = n[at], doc.iloc[at].reset_index(drop=True)
        full = n // capacity
        rest = n % capacity
        own = np.repeat(np.arange(len(n)), full)
        piece = np.arange(len(own)) - np.repeat(np.cumsum(full) - full, full) + 1
        left = np.flatnonzero(rest)
        sequence = _tightened(rest[left], pack(rest[left], capacity), capacity) if len(left) else np.zeros(0, np.int64)
        zero = np.flatnonzero(n == 0)
        place = np.concatenate([sequence, np.arange(len(own)) + (sequence.max() + 1 if len(sequence) else 0)])
        index = np.concatenate([left, own, zero]).astype(np.int64)
        return pd.DataFrame(
            {
                "target_id": np.int64(key[0]),
                "doc_id": doc.iloc[index].to_numpy(),
                "piece": np.concatenate([full[left] + 1, piece, np.ones(len(zero), np.int64)]),
                "n_tokens": np.concatenate([rest[left], np.full(len(own), capacity), np.zeros(len(zero), np.int64)]),
                "container": pd.array(np.concatenate([place * shards + shard, np.zeros(len(zero), np.int64)]), dtype="Int64").copy() if not len(zero) else pd.array([*(place * shards + shard), *[None] * len(zero)], dtype="Int64"),
            }
        )

    return spread.groupBy("target_id", "shard").applyInPandas(run, PACKED)


def pack_documents(documents: DataFrame, targets: DataFrame, folder: str = TOKENIZERS, vocabulary: str = VOCABULARY, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """packed() of the documents' token counts; every text is tokenized once."""
    return packed(staged(token_counts(documents, folder, vocabulary), "tokens"), targets, shard_tokens)
