"""Registered queries of the corpus operators, over whole tables with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (
    conversation_repair, exact_lsm, langid, license_scan, line_dedup, mixing, pii, quality_crf, ranked_search, sentencepiece_dropout, simhash,
    suffix_dedup, topk,
)
from .common import read_table
from .more_sql import LICENSE_SQL, RANKED_SQL, REPAIR_SQL


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(read_table(spark, sf_dir, "documents"), shingle=3, distance=2)
    return found.select("doc_id", simhash.fingerprint_hex(F.col("fp")).alias("fingerprint"), "component_id")


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digests(pii.find_pii(read_table(spark, sf_dir, "documents")))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_lines(read_table(spark, sf_dir, "documents"), min_run=3, min_words=50)


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return sentencepiece_dropout.encode(docs, dropout=0.1, seed=1).withColumn("n_ids", F.size("ids").cast("long"))


def op5_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(read_table(spark, sf_dir, "documents"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_crf.score_quality(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_lsm.exact_duplicates(read_table(spark, sf_dir, "documents"), keep="largest")


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(read_table(spark, sf_dir, "documents"), seed=1, repetition=2.0)


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(read_table(spark, sf_dir, "documents")).drop("kept")


def op10_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = topk.quantized(read_table(spark, sf_dir, "embeddings"))
    return topk.top_k(vectors.where(F.col("vec_id") % 50 == 0), vectors, k=5)


def op11_license(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan_licenses(read_table(spark, sf_dir, "documents"))


def op12_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_repair.audited(read_table(spark, sf_dir, "conversations"))


def op13_ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search.ranked(read_table(spark, sf_dir, "benchmark"), read_table(spark, sf_dir, "documents"), k=20)


QUERIES = {
    "op1_simhash": op1_simhash,
    "op2_pii": op2_pii,
    "op3_line_dedup": op3_line_dedup,
    "op4_sentencepiece": op4_sentencepiece,
    "op5_langid": op5_langid,
    "op6_quality": op6_quality,
    "op7_exact_dedup": op7_exact_dedup,
    "op8_mixing": op8_mixing,
    "op9_suffix_dedup": op9_suffix_dedup,
    "op10_topk": op10_topk,
    "op11_license": op11_license,
    "op12_repair": op12_repair,
    "op13_ranked": op13_ranked,
}

ORACLES = {
    "op3_line_dedup": """
        WITH d AS (SELECT doc_id, coalesce(text, '') AS t, string_split(coalesce(text, ''), chr(10)) AS a FROM documents),
             c3 AS (SELECT doc_id, a, list_transform(a, lambda x: len(regexp_extract_all(x, '[^\\x20\\x09-\\x0D]+'))) AS n_words FROM d),
             w AS (SELECT doc_id, s - 1 AS s, n, list_slice(a, s, s + n - 1) AS w
                   FROM (SELECT doc_id, a, n_words, n, unnest(range(1, len(a) - n + 2)) AS s FROM c3, (VALUES (1), (2), (3)) z(n) WHERE len(a) >= n)
                   WHERE n = 3 OR list_sum(list_slice(n_words, s, s + n - 1)) >= 50),
             o AS (SELECT *, row_number() OVER (PARTITION BY w ORDER BY doc_id, s) AS r FROM w),
             g AS (SELECT DISTINCT doc_id, unnest(range(s, s + n)) AS line FROM o WHERE r > 1),
             l AS (SELECT doc_id, unnest(a) AS x, unnest(range(0, len(a))) AS line FROM d),
             k AS (SELECT l.doc_id, string_agg(l.x, chr(10) ORDER BY l.line) AS text FROM l ANTI JOIN g USING (doc_id, line) GROUP BY l.doc_id),
             c AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id)
        SELECT d.doc_id, CAST(len(d.a) AS BIGINT) AS n_lines, coalesce(c.n, 0) AS n_removed, coalesce(k.text, '') AS text
        FROM d LEFT JOIN c USING (doc_id) LEFT JOIN k USING (doc_id)
    """,
    "op8_mixing": """
        WITH RECURSIVE
        c AS (SELECT doc_id, coalesce(source, '') AS source,
                     CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS tokens,
                     sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), 'null')) AS h FROM documents),
        t AS (SELECT source, CAST(sum(tokens) AS BIGINT) AS total, count(*) AS n FROM c GROUP BY source),
        k AS (SELECT i, max(share / z * all_tokens / total) <= 2.0 AS fits
              FROM (SELECT i, total, pow(total, i / 1000000.0) AS share, sum(pow(total, i / 1000000.0)) OVER (PARTITION BY i) AS z,
                           sum(total) OVER (PARTITION BY i) AS all_tokens
                    FROM t, (SELECT unnest(range(0, 1001)) * 1000 AS i)) WHERE total > 0 GROUP BY i),
        g AS (SELECT coalesce(min(i), 1000000) AS top FROM k WHERE fits),
        f AS (SELECT i, max(share / z * all_tokens / total) <= 2.0 AS fits
              FROM (SELECT i, total, pow(total, i / 1000000.0) AS share, sum(pow(total, i / 1000000.0)) OVER (PARTITION BY i) AS z,
                           sum(total) OVER (PARTITION BY i) AS all_tokens
                    FROM t, (SELECT unnest(range(greatest(0, top - 1000), top + 1)) AS i FROM g)) WHERE total > 0 GROUP BY i),
        e AS (SELECT coalesce(min(i), 1000000) / 1000000.0 AS a FROM f WHERE fits),
        s AS (SELECT source, total, CAST(ceil(n / 512.0) AS BIGINT) AS blocks,
                     CASE WHEN total > 0 THEN CAST(floor(pow(total, a) / (SELECT sum(pow(total, a)) FROM t) * (SELECT sum(total) FROM t)) AS BIGINT) ELSE 0 END AS share
              FROM t, e),
        p AS (SELECT source, blocks, CASE WHEN total > 0 THEN share // total ELSE 1 END AS whole,
                     share - CASE WHEN total > 0 THEN share // total ELSE 1 END * total AS rest FROM s),
        o AS (SELECT c.doc_id, c.source, c.tokens, CAST('0x' || substr(h, 1, 8) AS BIGINT) % blocks AS block, substr(h, 9, 56) AS h
              FROM c JOIN p USING (source)),
        b AS (SELECT *, coalesce(sum(tokens) OVER (PARTITION BY source, block ORDER BY h, doc_id, tokens ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM o),
        z AS (SELECT source, block, sum(tokens) AS size FROM o GROUP BY source, block),
        x AS (SELECT source, block, size, whole, rest, unnest(range(1, whole + 2)) AS epoch FROM z JOIN p USING (source)),
        y AS (SELECT *, sha256('1:' || epoch || ':' || source || ':' || block) AS turn FROM x),
        r AS (SELECT *, row_number() OVER w AS block_rank, sum(size) OVER w - size AS done FROM y
              WINDOW w AS (PARTITION BY source, epoch ORDER BY turn, block))
        SELECT b.doc_id, b.source, b.tokens, CAST(r.epoch AS INTEGER) AS epoch, b.block, CAST(r.block_rank AS INTEGER) AS block_rank
        FROM b JOIN r USING (source, block) WHERE r.epoch <= r.whole OR b.before < r.rest - r.done
    """,
    "op7_exact_dedup": """
        WITH t AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS x FROM documents),
             g AS (SELECT x, max(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY x)
        SELECT t.doc_id, g.keep_id, g.group_size, t.doc_id = g.keep_id AS kept, sha256(t.x) AS text_sha256
        FROM t JOIN g ON t.x = g.x
    """,
    "op10_topk": """
        WITH v AS (SELECT vec_id, row_number() OVER () AS own, list_transform(embedding, lambda e: CAST(floor(256 * CAST(e AS DOUBLE)) AS BIGINT)) AS v
                   FROM embeddings
                   WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0),
             s AS (SELECT q.own, q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
                   FROM v q JOIN v c ON q.own <> c.own WHERE q.vec_id % 50 = 0),
             r AS (SELECT *, CAST(row_number() OVER (PARTITION BY own ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
        SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
    """,
    "op11_license": LICENSE_SQL,
    "op12_repair": REPAIR_SQL,
    "op13_ranked": RANKED_SQL,
}
