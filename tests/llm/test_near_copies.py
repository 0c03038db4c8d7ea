"""The near_dedup stage against brute-force Jaccard, with null and repeated ids."""

import random

import pytest

import corpus_pipeline
from notelake.llm import jaccard

from .test_operators import ascii_lower, components, plain_fingerprint


def grams(text, k=5):
    w = ascii_lower(text or "").split()
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def near(a, b):
    x, y = grams(a), grams(b)
    return 5 * len(x & y) >= 4 * len(x | y) or bin(plain_fingerprint(a) ^ plain_fingerprint(b)).count("1") <= 2


def texts(seed=3):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    out = [[rng.choice(words) for _ in range(rng.choice([3, 8, 60, 200]))] for _ in range(30)]
    common = [rng.choice(words) for _ in range(60)]
    out += [common + [rng.choice(words) for _ in range(rng.choice([5, 12, 40]))] for _ in range(20)]
    for base in out[:12] * 4:
        copy = list(base)
        for _ in range(rng.randint(1, max(1, len(base) // 40))):
            copy[rng.randrange(len(copy))] = rng.choice(words)
        out.append(copy)
    return [" ".join(w) for w in out]


@pytest.mark.parametrize("limit", [0, 3, 32])
def test_near_dedup_is_exact_for_jaccard(spark, limit, monkeypatch):
    monkeypatch.setattr(jaccard, "PAIR_LIMIT", limit)
    known = dict(enumerate(texts()))
    df = spark.createDataFrame(list(known.items()), "doc_id long, text string")
    links = [(a, b) for a in known for b in known if a < b and near(known[a], known[b])]
    want = set(components(known, links).values())
    assert len(want) < len(known) - 20
    assert {r.doc_id for r in corpus_pipeline.near_dedup(spark, df, "").collect()} == want


def test_near_dedup_decides_by_row(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(100)) for x in "abc")
    data = [(None, a), (None, b), (5, b + " end"), (7, c), (7, c), (3, c + " end"), (3, a + " more")]
    df = spark.createDataFrame(data, "doc_id long, text string")
    got = corpus_pipeline.near_dedup(spark, df, "").collect()
    assert sorted((r.doc_id, r.text) for r in got) == sorted([(5, b + " end"), (3, c + " end"), (3, a + " more")])
    alone = spark.createDataFrame([(None, a), (None, b)], "doc_id long, text string")
    assert corpus_pipeline.near_dedup(spark, alone, "").count() == 2


def test_shingles_are_counted_over_all_texts(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "ORDER_DOCS", 10, raising=False)
    shared = " ".join(f"s{i}" for i in range(9))
    df = spark.createDataFrame([(i, f"{shared} own{i}" if i < 40 else None) for i in range(50)], "doc_id long, text string").repartition(3)
    cell, n = jaccard._common(df, 5)
    assert dict(zip(cell.tolist(), n.tolist(), strict=True)) == {int(h) % jaccard.CELLS: 40 for h in jaccard.shingle_set(shared.encode(), 5)}


def test_found_components_are_one_link_a_node(spark, monkeypatch):
    """Each later search for components starts from one link a node, not from all pairs so far."""
    sizes, verified, find, check = [], [], jaccard.connected_components, jaccard._verified

    def seen(edges):
        sizes.append(edges.count())
        return find(edges)

    def checked(*args, **more):
        verified.append(check(*args, **more))
        return verified[-1]

    monkeypatch.setattr(jaccard, "PAIR_LIMIT", 0)
    monkeypatch.setattr(jaccard, "connected_components", seen)
    monkeypatch.setattr(jaccard, "_verified", checked)
    known = texts()
    jaccard.near_copies(spark.createDataFrame(list(enumerate(known)), "doc_id long, text string"))
    assert len(sizes) > 1 and sizes[1] < sizes[0] + verified[1].count()
