"""The mix_sources stage uses every document, also where a share would round below a source's total."""

import corpus_pipeline


def test_cover_survives_rounding(spark):
    data = [(i, "word", "a" if i < 40 else "b") for i in range(57)]
    df = spark.createDataFrame(data, "doc_id long, text string, source string")
    assert {r.doc_id for r in corpus_pipeline.mix_sources(spark, df, "").collect()} == set(range(57))
