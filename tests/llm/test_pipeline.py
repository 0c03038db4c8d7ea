"""Each pipeline stage, on its own input, against a plain re-statement."""

from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from notelake.llm.common import materialize

from .test_near_copies import near
from .test_operators import SCHEMA, ascii_lower, components, rows


@pytest.fixture(scope="module")
def stages(spark):
    docs = spark.createDataFrame([r for r in rows(seed=6) if r[0] is not None], SCHEMA).select("doc_id", "text", "lang", "source", "n_chars")
    out = {"documents": docs}
    for name, stage in corpus_pipeline.STAGES:
        docs = materialize(stage(spark, docs, ""), f"test-{name}")
        out[name] = docs
    return out


def taken(df):
    return [(r.doc_id, r.text) for r in df.collect()]


def test_stage_names_and_columns(stages):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "exact_dedup", "near_dedup", "mix_sources", "encode"]
    for name in ("language_id", "exact_dedup", "near_dedup", "mix_sources"):
        assert stages[name].columns == stages["documents"].columns


def test_language_id_drops_texts_without_letters(stages):
    want = Counter((i, t) for i, t in taken(stages["documents"]) if any(c.isalpha() for c in t or ""))
    assert Counter(taken(stages["language_id"])) == want


def test_language_id_names_languages_and_drops_unclear_texts(spark):
    say = {"en": "the river of stone and light", "de": "der fluss und das licht schön", "fr": "le fleuve est une pierre où"}
    docs = [(i, f"{say[k]} {say[k][::-1]}", k if i % 3 else None) for i in range(60) for k in say] + [(90, "qqqq", None), (91, "12 !", "en"), (None, say["fr"], None)]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string").withColumn("p", F.lit("clash")).withColumn("row", F.lit(1))
    got = corpus_pipeline.language_id(spark, df, "")
    assert got.columns == df.columns
    kept = [(r.doc_id, r.text, r.lang) for r in got.collect()]
    assert sorted(kept, key=str) == sorted([(i, t, next(k for k in say if t.startswith(say[k]))) for i, t, _ in docs if i not in (90, 91)], key=str)


def test_exact_dedup_keeps_largest(stages):
    keep = defaultdict(list)
    for i, t in taken(stages["language_id"]):
        keep[ascii_lower(t)].append(i)
    assert {i for i, _ in taken(stages["exact_dedup"])} == {max(v) for v in keep.values()}


def test_near_dedup_keeps_smallest(stages):
    """The stage's rule: five words and a Jaccard similarity of 0.8 or more, or op1's fingerprints."""
    texts = dict(taken(stages["exact_dedup"]))
    links = [(a, b) for a in texts for b in texts if a < b and near(texts[a], texts[b])]
    assert {i for i, _ in taken(stages["near_dedup"])} == set(components(texts, links).values())


def test_mixing_uses_everything_and_encoding_is_lossless(stages):
    before, after = Counter(i for i, _ in taken(stages["near_dedup"])), Counter(i for i, _ in taken(stages["mix_sources"]))
    assert set(before) == set(after) and all(before[i] <= after[i] <= 3 * before[i] for i in before)
    coded = stages["encode"].collect()
    assert Counter(r.doc_id for r in coded) == after and all(r.lossless and r.n_ids == len(r.ids) for r in coded)


def test_run_over_a_folder(spark, tmp_path):
    docs = spark.createDataFrame(rows(n=10), SCHEMA)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    coded = corpus_pipeline.run(spark, str(tmp_path))
    assert coded.where("not lossless").count() == 0 and coded.where("doc_id is null").count() >= 1  # a text of its own without an id stays
    docs.limit(0).write.parquet(f"{tmp_path}/none/documents.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").count() == 0
