from __future__ import annotations

from collections import defaultdict

import numpy as np

from plumbline.llm.packing import best_two_fit, fill_report, packed_contexts


def check(sizes, capacity):
    bins = best_two_fit(np.array(sizes), capacity)
    used = np.bincount(bins, weights=sizes)
    assert (bins >= 0).all() and (used <= capacity).all() and (used > 0).all()
    return len(used)


def test_bins_hold_and_are_tight():
    rng = np.random.default_rng(4)
    for capacity in (16, 512, 2048):
        sizes = np.minimum(rng.geometric(6 / capacity, 3000), capacity)
        assert check(sizes, capacity) <= int(np.ceil(sizes.sum() / capacity) * 1.02) + 1
    assert check([7, 7, 3, 3, 3, 3], 13) == 2 and check([5], 5) == 1
    # greedy alone takes 6 + 3 and leaves a gap of one; two texts of two fill it
    assert check([6, 3, 2, 2], 10) == 2


def test_two_replace_the_smallest():
    bins = best_two_fit(np.array([6, 3, 2, 2]), 10)
    assert bins[0] == bins[2] == bins[3] != bins[1]


def test_contexts_of_texts(spark):
    docs = [(1, "a word " * 300), (2, "short"), (3, ""), (4, None), (5, "x " * 40), (6, "short"), (None, "lost")]
    d = spark.createDataFrame([(*r, 9) for r in docs], "doc_id long, text string, tokens int")
    c = spark.createDataFrame([("s", 64), ("l", 4096), ("none", None)], "context_id string, capacity_tokens int")
    rows = packed_contexts(d, c).collect()
    size = defaultdict(int)
    for r in rows:
        size[r["context_id"], r["doc_id"]] += r["tokens"]
    assert {k[1] for k in size} == {1, 2, 3, 5, 6} and all(size["s", k] == size["l", k] for k in (1, 2, 3, 5, 6))
    used = defaultdict(int)
    for r in rows:
        used[r["context_id"], r["shard"], r["bin"], r["doc_id"] if r["shard"] == -1 else 0] += r["tokens"]
    assert all(v <= {"s": 64, "l": 4096}[k[0]] for k, v in used.items())
    pieces = sorted((r["piece"], r["tokens"]) for r in rows if r["context_id"] == "s" and r["doc_id"] == 1)
    assert [p for p, _ in pieces] == list(range(len(pieces))) and all(t == 64 for _, t in pieces[:-1])
    assert all(r["piece"] == 0 for r in rows if r["context_id"] == "l")
    report = {r["context_id"]: r for r in fill_report(packed_contexts(d, c), c).collect()}
    assert report["l"]["contexts"] == 1 and report["l"]["tokens"] == sum(v for k, v in size.items() if k[0] == "l")
    assert packed_contexts(d.limit(0), c).count() == 0 and packed_contexts(d, c.limit(0)).count() == 0
