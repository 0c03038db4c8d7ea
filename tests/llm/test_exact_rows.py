"""The exact_dedup stage on null and repeated ids."""

from collections import Counter

import corpus_pipeline


def test_exact_dedup_decides_by_row(spark):
    data = [(None, "only here"), (None, "both"), (4, "BOTH"), (9, "one"), (9, "two"), (12, "Two"), (None, None), (3, "same"), (3, "same")]
    df = spark.createDataFrame(data, "doc_id long, text string")
    got = Counter((r.doc_id, r.text) for r in corpus_pipeline.exact_dedup(spark, df, "").collect())
    assert got == Counter([(None, "only here"), (4, "BOTH"), (9, "one"), (12, "Two"), (None, None), (3, "same"), (3, "same")])


def test_stages_keep_rows_without_ids(spark):
    df = spark.createDataFrame([(None, "a text without an id", "en"), (1, "another text of five words", "en")], "doc_id long, text string, lang string")
    for _, stage in corpus_pipeline.STAGES[:3]:
        df = stage(spark, df, "")
        assert {r.doc_id for r in df.collect()} == {None, 1}
