"""Ranked search against scores of every document."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from notelake.llm import ranked_search as R

DOCS = "doc_id long, text string, q long, terms string, item_id string, rank int, score long"
ITEMS = "item_id long, text string, doc_id string, q string, terms string"


def terms(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def plain(items, docs, k):
    counts = [(d, Counter(terms(t))) for d, t in docs]
    counts = [(d, c) for d, c in counts if c]
    n_docs, total = len(counts), sum(sum(c.values()) for _, c in counts)
    df = Counter(t for _, c in counts for t in c)
    out = []
    for item, text in items:
        asked, scored = Counter(terms(text)), []
        for d, c in counts:
            m = 75 + 25 * sum(c.values()) * n_docs // total
            part = lambda t: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 12 * m))  # noqa: E731, B023
            score = sum(times * part(t) for t, times in asked.items() if c[t])
            if score > 0:
                scored.append((-score, d is not None, d or 0, d))
        out += [(item, r + 1, x[3], -x[0]) for r, x in enumerate(sorted(scored)[:k])]
    return sorted(out, key=str)


def tables(seed, n_docs, n_items):
    rng = random.Random(seed)
    words = [f"w{int(rng.paretovariate(0.6))}" for _ in range(400)] + ["Über", "café", "日本"]
    text = lambda n: rng.choice([" ", "\n", ", "]).join(rng.choice(words) for _ in range(n))
    docs = [(i, text(rng.choice([1, 5, 40, 300]))) for i in range(n_docs)]
    docs += [(n_docs + i, docs[3][1]) for i in range(50)] + [docs[5], docs[5], (None, docs[6][1]), (9001, None), (9002, ""), (9003, "  .,"), (9004, "w1 " * 20000)]
    items = [(i, text(rng.choice([1, 3, 30]))) for i in range(n_items)] + [(0, "W1 w1 w1 W2"), (700, None), (701, ""), (None, "w3 w4"), (702, "absent"), (703, docs[3][1])]
    return items, docs


@pytest.mark.parametrize(("shard", "group"), [(16_384, 32_000_000), (7, 400)])
def test_every_score(spark, monkeypatch, shard, group):
    monkeypatch.setattr(R, "GROUP_BYTES", group * 10)
    items, docs = tables(1, 150, 12)
    got = R.ranked(spark.createDataFrame([(*i, "c", "c", "c") for i in items], ITEMS), spark.createDataFrame([(*d, 1, "c", "c", 1, 2) for d in docs], DOCS), k=20)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted(map(tuple, got.collect()), key=str) == plain(items, docs, 20)


@pytest.mark.parametrize("k", [1, 3, 20, 5000])
def test_stops_only_when_proven(k):
    """The k best of a shard, for many items, equal those of whole scores."""
    import pyarrow as pa

    rng = np.random.default_rng(k)
    sizes = rng.integers(0, 30, 900)
    lists = [np.sort(rng.choice(60, s, replace=False)) for s in sizes]
    tfs = [rng.geometric(0.6, s) for s in sizes]
    batch = pa.RecordBatch.from_arrays(
        [pa.array(np.arange(900)), pa.array(rng.integers(30, 400, 900)), pa.array(lists, pa.list_(pa.int32())), pa.array(tfs, pa.list_(pa.int64()))],
        names=["doc", "n", "terms", "tfs"],
    )
    shard = R.Shard([batch], R.Corpus(900, 900 * 200, rng.integers(0, 9000, 60)))
    for _ in range(30):
        own = np.sort(rng.choice(60, rng.integers(1, 25), replace=False))
        times = rng.integers(1, 4, len(own))
        whole = shard.scores(np.arange(900), own, times)
        found, score = shard.best(own, times, k, 1)
        assert (whole[found] == score).all()
        rank = lambda ids, s: sorted(((-int(x), int(i)) for i, x in zip(ids, s, strict=True) if x > 0))[:k]
        assert rank(found, score) == rank(np.arange(900), whole)


def test_empty_tables(spark):
    items, docs = spark.createDataFrame([(1, "a b")], "item_id long, text string"), spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    assert R.ranked(items, docs.limit(0)).collect() == []
    assert R.ranked(items.limit(0), docs).collect() == []
    assert [tuple(r)[:3] for r in R.ranked(items, docs).collect()] == [(1, 1, 1)]
