"""License scan against plain search of every block and place."""

import random
import re
from math import ceil

import pytest

from notelake.llm import license_scan as L

SCHEMA = "doc_id long, text string, row long, label string, w string, found string, chunks string, best double"
FILL = "the of this to a in is and river stone mit version software copy".split()


def plain(text):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text)
    base = [(i, label) for p, label in L.PHRASES for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
    found, best = set(), 0.0
    for at in range(0, len(w), L.STRIDE):
        block = set(w[at : at + 2 * L.STRIDE])
        for label, t in L.TEMPLATES:
            t = set(t.split())
            if len(block & t) >= ceil(L.THRESHOLD * len(t) - 1e-9):
                found.add(label)
                best = max(best, len(block & t) / len(t))
    labels = {label for _, label in base}
    at = [i for i, _ in base]
    return (len(w), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(labels)), ",".join(sorted(labels | found)), 1.0 if at else best)


def texts():
    rng = random.Random(7)
    fill = lambda n: " ".join(rng.choice(FILL) for _ in range(n))
    out = [f"{fill(rng.randint(0, 60))} {rng.choice(L.TEMPLATES)[1]}. {fill(rng.randint(0, 60))}" for _ in range(80)]
    for _, t in L.TEMPLATES:  # a word or two missing, and the words spread out
        for n in (1, 2, 3):
            w = t.split()
            for _ in range(min(n, len(w) - 1)):
                w.pop(rng.randrange(len(w)))
            out.append(f"{fill(30)} {' '.join(w)} {fill(30)}")
        out.append("\n".join(f"{x} {fill(2)}" for x in t.split()))
    out += ["Released under the MIT-License.", "UNDER THE MIT LICENSE under the mit license", "Apache License, Version 2.0", "CC BY-NC 4.0", "ccbync", "mit ünder the license"]
    out += [None, "", " \n\t", "mit", "x" * 5000, "under the mit license " * 3000, (fill(4000) + " apache license version 2 ") * 3, "日本語 under the mit license 😀"]
    return out + out[:5]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(None if i == 3 else i % 120, t, 1, "c", "c", "c", "c", 9.0) for i, t in enumerate(texts())], SCHEMA)


def test_every_block_and_place(docs):
    got = L.scan_licenses(docs)
    assert got.columns == ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]
    want = [(None if i == 3 else i % 120, *plain(t)) for i, t in enumerate(texts())]
    key = lambda r: str([(x is None, round(x, 9) if isinstance(x, float) else x) for x in r])
    assert sorted(map(key, map(tuple, got.collect()))) == sorted(map(key, want))
    assert any(r["labels"] != r["base_labels"] for r in got.collect())


def test_own_templates(spark, docs):
    given = [("stone", "river stone"), ("long", "a version of this software in the river is a copy")]
    rows = L.scan_licenses(docs.limit(60), templates=given, phrases=[("river stone", "rs")], threshold=0.5).collect()
    assert {r["labels"] for r in rows} >= {"long,rs,stone"}
    with pytest.raises(ValueError):
        L.scan_licenses(docs, templates=[("x", "a " * 40)])


def test_empty_table(spark):
    assert L.scan_licenses(spark.createDataFrame([], SCHEMA)).collect() == []
