"""Texts packed into contexts of fixed capacity.

Sizes are tokens of a public tokenizer. A text longer than a context is cut into full pieces
and a rest; everything else stays whole. Full pieces fill a context each. The rest is spread
by hash over shards of some ten thousand texts, and each shard is packed by itself with
best-two-fit: a bin is filled greedily with the largest text that still fits, then its
smallest text is replaced by the two unpacked texts that fit the gap left by it more tightly.
A shard leaves about one context partly filled for want of texts, so what sharding costs
doesn't grow with the corpus, and no task or driver sees more than one shard.

Defined results: null texts have no context; empty texts have 0 tokens and take a place in a
context without filling it; equal doc ids are rows of their own only if their texts differ
in nothing else than copies (``doc_id`` is a key; repeats of it are packed once each).
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from plumbline.operators.pieces import sorted_groups
from plumbline.operators.written import written

TOKENIZER = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
#: Splits a text into words, numbers and signs before merging bytes.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
SHARD_TEXTS = 20_000
#: More capacities than a plan should list are an error.
MOST_CAPACITIES = 1_000
PACKED = "context_id string, shard int, bin int, doc_id bigint, piece int, tokens int"


@lru_cache(maxsize=2)
def _encoding(path: str):
    import base64

    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_counts(documents: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """``(doc_id, tokens)`` of the texts that are not null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = _encoding(tokenizer)
        for b in batches:
            sizes = [len(encoding.encode_ordinary(t)) for t in b.column("text").to_pylist()]
            yield pa.record_batch({"doc_id": b.column("doc_id"), "tokens": pa.array(sizes, pa.int32())})

    return documents.select("doc_id", "text").where("doc_id is not null and text is not null").mapInArrow(run, "doc_id bigint, tokens int")


def best_two_fit(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """The bin of each size; sizes are between 1 and the capacity."""
    order = np.argsort(sizes, kind="stable")
    left = np.bincount(sizes, minlength=capacity + 1)  # unpacked texts of each size
    start = np.r_[0, np.cumsum(left)[:-1]]  # texts of one size stand together in ``order``
    taken = np.zeros(capacity + 1, np.int64)
    present = np.flatnonzero(left)  # sizes with unpacked texts, ascending
    out = np.full(len(sizes), -1)
    rest, number = int(left.sum()), 0

    def largest(limit: int) -> int:
        nonlocal present
        while True:
            k = int(np.searchsorted(present, limit, "right")) - 1
            if k < 0:
                return 0
            if left[present[k]]:
                return int(present[k])
            present = present[left[present] > 0]

    while rest:
        chosen: list[int] = []
        gap = capacity
        while gap and (s := largest(gap)):
            chosen.append(s)
            left[s] -= 1
            gap -= s
        if gap:
            smallest = chosen[-1] if len(chosen) == 1 else min(chosen)
            room = gap + smallest
            pair = _two(present, left, room)
            if pair and sum(pair) > smallest:
                chosen.remove(smallest)
                left[smallest] += 1
                if left[smallest] == 1 and present[min(np.searchsorted(present, smallest), len(present) - 1)] != smallest:
                    present = np.insert(present, np.searchsorted(present, smallest), smallest)
                for s in pair:
                    chosen.append(s)
                    left[s] -= 1
        for s in chosen:
            out[order[start[s] + taken[s]]] = number
            taken[s] += 1
        rest -= len(chosen)
        number += 1
    return out


def _two(present: np.ndarray, left: np.ndarray, room: int) -> tuple[int, int] | None:
    """The two unpacked sizes with the largest sum that ``room`` holds."""
    a = present[(present < room) & (left[present] > 0)]
    if not len(a):
        return None
    k = np.searchsorted(a, room - a, "right") - 1
    ok = k >= 0
    if not ok.any():
        return None
    b = a[np.maximum(k, 0)]
    # the same size twice needs two texts of it; else its partner is the next smaller size
    twin = (b == a) & (left[a] < 2)
    b = np.where(twin, np.where(k > 0, a[np.maximum(k - 1, 0)], 0), b)
    ok &= b > 0
    if not ok.any():
        return None
    best = int(np.argmax(np.where(ok, a + b, -1)))
    return int(a[best]), int(b[best])


def _pack(t: pa.Table, group: np.ndarray) -> pa.Table:
    tokens, capacity = t.column("tokens").to_numpy(), t.column("capacity").to_numpy()
    bins = np.zeros(len(t), np.int64)
    cut = np.r_[0, np.flatnonzero(np.diff(group)) + 1, len(t)]
    for a, b in zip(cut[:-1], cut[1:], strict=True):
        some = np.flatnonzero(tokens[a:b] > 0) + a
        if len(some):
            bins[some] = best_two_fit(tokens[some], int(capacity[a]))
    names = t.select(["context_id", "shard"])
    return pa.table({
        "context_id": names.column("context_id"), "shard": names.column("shard"), "bin": pa.array(bins, pa.int32()),
        "doc_id": t.column("doc_id"), "piece": t.column("piece"), "tokens": t.column("tokens"),
    })


def packed_contexts(documents: DataFrame, contexts: DataFrame, tokenizer: str = TOKENIZER, shard_texts: int = SHARD_TEXTS) -> DataFrame:
    """``(context_id, shard, bin, doc_id, piece, tokens)``: the context of each text or piece.
    ``shard`` and ``bin`` name the context; full pieces have shard -1 and a bin of their own,
    named by document and piece. Texts are tokenized once: their sizes, two numbers each, are
    written."""
    counts = written(token_counts(documents, tokenizer))
    shards = max(1, -(-counts.count() // shard_texts))
    sizes = contexts.select("context_id", F.col("capacity_tokens").cast("int").alias("capacity")).where("context_id is not null and capacity > 0").distinct()
    # every text meets every capacity; they are given with the job and go along as a list
    listed = [tuple(r) for r in sizes.orderBy("context_id").limit(MOST_CAPACITIES + 1).collect()]
    if len(listed) > MOST_CAPACITIES:
        raise ValueError(f"more than {MOST_CAPACITIES} capacities")
    if not listed:
        return documents.sparkSession.createDataFrame([], PACKED)
    each = F.array(*[F.struct(F.lit(c).alias("context_id"), F.lit(n).alias("capacity")) for c, n in listed])
    rows = counts.withColumn("c", F.explode(each)).select("doc_id", "tokens", "c.context_id", "c.capacity")
    full, rest = F.floor(F.col("tokens") / F.col("capacity")).cast("int"), (F.col("tokens") % F.col("capacity")).cast("int")
    pieces = F.concat(
        F.transform(F.when(full > 0, F.sequence(F.lit(0), full - 1)).otherwise(F.expr("array()").cast("array<int>")), lambda k: F.struct(k.alias("piece"), F.col("capacity").alias("tokens"))),
        F.when((rest > 0) | (full == 0), F.array(F.struct(full.alias("piece"), rest.alias("tokens")))).otherwise(F.expr("array()").cast("array<struct<piece:int,tokens:int>>")),
    )
    rows = rows.withColumn("p", F.explode(pieces)).select("context_id", "capacity", "doc_id", "p.piece", "p.tokens")
    rows = rows.withColumn("shard", F.when(F.col("tokens") == F.col("capacity"), -1).otherwise(F.pmod(F.xxhash64("doc_id", "piece"), F.lit(shards)).cast("int")))
    whole = rows.where("shard = -1").select("context_id", "shard", F.col("piece").alias("bin"), "doc_id", "piece", "tokens")
    packed = sorted_groups(rows.where("shard >= 0"), ["context_id", "shard"], ["doc_id", "piece"], _pack, PACKED)
    return whole.unionByName(packed)


def fill_report(packed: DataFrame, contexts: DataFrame) -> DataFrame:
    """``(context_id, contexts, tokens, unused_share)`` per capacity."""
    bins = packed.groupBy("context_id", "shard", "bin", F.when(F.col("shard") == -1, F.col("doc_id")).alias("_own")).agg(F.sum("tokens").alias("tokens"))
    per = bins.groupBy("context_id").agg(F.count(F.lit(1)).alias("contexts"), F.sum("tokens").alias("tokens"))
    return per.join(contexts.select("context_id", "capacity_tokens").distinct(), "context_id").select(
        "context_id", "contexts", "tokens", (1 - F.col("tokens") / (F.col("contexts") * F.col("capacity_tokens"))).alias("unused_share")
    )
