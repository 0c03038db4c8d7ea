"""Exact ranked lexical search: impact-ordered postings, scored at a time, with proven stops."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, materialize, small_batches, text_of
from .license_scan import words_of

#: Bytes of the items' terms that are broadcast at once.
GROUP_BYTES = 32_000_000
#: Documents and postings of a shard, of which a task holds one at a time.
SHARD_DOCS, SHARD_POSTINGS = 16_384, 2_000_000
#: Of the impacts still to come, the share of the greatest down to which a step goes.
STEP = 0.75
#: Impacts stay below this power of two: weights below 2**16, times at most 10**6.
BITS = 36
_NONE = -(1 << 63)
_FORWARD = "doc long, n long, terms array<int>, tfs array<long>"
_LISTS = "q long, doc long, score long"


@dataclass
class Corpus:
    """Counts that weights need: documents with terms, their terms, and a weight for each term of the items."""

    docs: int
    terms: int
    weight: np.ndarray


def weight(docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * docs + 2) / (2 * df + 1)))


def _forward(batches: Iterator[pa.RecordBatch], terms) -> Iterator[pa.RecordBatch]:
    """Documents ``(doc, words)`` as their length and the counts of those words that are terms of items."""
    known = pa.array(terms.value, pa.string())
    size = max(1, len(known))
    for batch in batches:
        lists = batch.column(1)
        n = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
        term = pc.index_in(lists.flatten(), value_set=known)
        hit = np.flatnonzero(term.is_valid().to_numpy(zero_copy_only=False))
        own = np.repeat(np.arange(len(n)), n)[hit]
        key, tf = np.unique(own * size + term.drop_null().to_numpy().astype(np.int64), return_counts=True)
        ends = np.concatenate(([0], np.cumsum(np.bincount(key // size, minlength=len(n))))).astype(np.int32)
        cols = [
            batch.column(0), pa.array(n),
            pa.ListArray.from_arrays(ends, pa.array((key % size).astype(np.int32))), pa.ListArray.from_arrays(ends, pa.array(tf.astype(np.int64))),
        ]
        yield pa.RecordBatch.from_arrays(cols, names=["doc", "n", "terms", "tfs"])


class Shard:
    """Postings of some documents: a term's in falling order of impact, and each document's own."""

    def __init__(self, batches: list[pa.RecordBatch], corpus: Corpus):
        table = pa.Table.from_batches(batches).combine_chunks()
        flat = lambda name: table.column(name).combine_chunks().flatten().to_numpy()
        self.ids, n = table.column("doc").to_numpy(), table.column("n").to_numpy()
        self.term, tf = flat("terms").astype(np.int64), flat("tfs")
        sizes = pc.list_value_length(table.column("terms")).to_numpy().astype(np.int64)
        self.ends = np.concatenate(([0], np.cumsum(sizes)))
        own = np.repeat(np.arange(len(n)), sizes)
        m = 75 + 25 * n * corpus.docs // corpus.terms
        self.impact = corpus.weight[self.term] * ((1_000_000_000 * tf) // (1000 * tf + 12 * m[own]))
        falling = np.lexsort((-self.impact, self.term))
        self.doc, self.by_impact = own[falling], self.impact[falling]
        #: Rises along the postings, so that one search finds where an impact's group ends for many terms.
        self.key = (self.term[falling] << BITS) + ((1 << BITS) - self.by_impact)

    def bounds(self, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return np.searchsorted(self.key, terms << BITS), np.searchsorted(self.key, (terms + 1) << BITS)

    def scores(self, docs: np.ndarray, terms: np.ndarray, times: np.ndarray) -> np.ndarray:
        """Whole scores of ``docs``, from each one's own postings."""
        sizes = self.ends[docs + 1] - self.ends[docs]
        at = _ranges(self.ends[docs], sizes)
        place = np.minimum(np.searchsorted(terms, self.term[at]), len(terms) - 1)
        part = np.where(terms[place] == self.term[at], times[place] * self.impact[at], 0)
        out = np.zeros(len(docs), np.int64)
        np.add.at(out, np.repeat(np.arange(len(docs)), sizes), part)
        return out

    def best(self, terms: np.ndarray, times: np.ndarray, k: int, floor: int) -> tuple[np.ndarray, np.ndarray]:
        """Documents and scores of the k best for one item (more where equal), of those that reach ``floor``.

        Whole groups of equal impact are added, the greatest first. What a document can still
        gain is at most the sum of the greatest impacts to come, one a term; once at most a few documents can
        reach the k-th best partial score, theirs are completed and nothing else is read.
        """
        start, end = self.bounds(terms)
        live = end > start
        terms_here, times_here, at, end = terms[live], times[live], start[live].copy(), end[live]
        got = np.zeros(len(self.ids), np.int64)
        ahead = times_here * self.by_impact[at] if len(at) else np.zeros(0, np.int64)
        while True:
            rest = int(ahead.sum())
            if rest < max(floor, int(got.max(initial=0))) or not rest:
                kth = int(np.partition(got, len(got) - k)[len(got) - k]) if len(got) >= k else 0
                able = np.flatnonzero(got + rest >= max(kth, floor, 1))
                if len(able) <= 4 * k or not rest:
                    score = self.scores(able, terms, times) if rest else got[able]
                    return able, score
            down = max(1, int(ahead.max() * STEP))
            to = np.searchsorted(self.key, (terms_here << BITS) + ((1 << BITS) - -(-down // times_here)), "right")
            to = np.clip(to, at, end)
            posting = _ranges(at, to - at)
            np.add.at(got, self.doc[posting], np.repeat(times_here, to - at) * self.by_impact[posting])
            at = to
            ahead = np.where(at < end, times_here * self.by_impact[np.minimum(at, end - 1)], 0)


def _ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """``start[i] .. start[i] + size[i] - 1`` of all i, one after the other."""
    return np.arange(int(size.sum())) + np.repeat(start - np.concatenate(([0], np.cumsum(size)[:-1])), size)


def _shards(batches: Iterator[pa.RecordBatch], corpus: Corpus) -> Iterator[Shard]:
    held, docs, postings = [], 0, 0
    for batch in batches:
        held.append(batch)
        docs, postings = docs + batch.num_rows, postings + len(batch.column(2).flatten())
        if docs >= SHARD_DOCS or postings >= SHARD_POSTINGS:
            yield Shard(held, corpus)
            held, docs, postings = [], 0, 0
    if docs:
        yield Shard(held, corpus)


def _search(batches: Iterator[pa.RecordBatch], shared, k: int) -> Iterator[pa.RecordBatch]:
    """A task's shards against all items of a group: each item's k best of the task."""
    corpus, items = shared.value
    best = {q: (np.zeros(0, np.int64), np.zeros(0, np.int64)) for q, _, _ in items}
    for shard in _shards(batches, corpus):
        for q, terms, times in items:
            ids, score = best[q]
            floor = int(score[k - 1]) if len(score) == k else 1
            found, more = shard.best(terms, times, k, floor)
            ids, score = np.concatenate((ids, shard.ids[found])), np.concatenate((score, more))
            top = np.lexsort((ids, -score))[:k]
            best[q] = ids[top], score[top]
    for q, (ids, score) in best.items():
        if len(ids):
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), q)), pa.array(ids), pa.array(score)], names=["q", "doc", "score"])


def _group(rows: DataFrame) -> list[tuple[int, list[str]]]:
    return [(r["q"], r["terms"]) for r in rows.select("q", "terms").collect()]


def ranked(items: DataFrame, docs: DataFrame, k: int = 20) -> DataFrame:
    """``items(item_id, text)`` and ``docs(doc_id, text)`` -> ``(item_id, rank, doc_id, score)``: each item's k best documents.

    Terms are runs of 0-9, a-z (A-Z lower-cased) and characters beyond ASCII. A document's counts of the items' terms make one row;
    weights need the numbers of documents with each term, counted over all of them. Every task keeps its
    documents in shards, whose postings lie in falling order of impact, and leaves its k best of each item; these
    merge over branches and then whole. Items are taken in groups of about GROUP_BYTES, each of
    which is broadcast and reads the documents once.

    Scores of 0 are left out; equal scores rank by doc_id, nulls first. Null and empty texts have no terms. Rows that
    repeat a doc_id are documents of their own, as are items that repeat an item_id. Other columns are ignored; an empty table gives an
    empty result.
    """
    spark = docs.sparkSession
    small_batches(spark)
    asked = materialize(items.select(F.monotonically_increasing_id().alias("q"), items["item_id"].alias("item_id"), words_of(text_of(items)).alias("terms")), "items")
    size = asked.agg(F.sum(F.length(F.array_join("terms", " ")).cast("long") * 2 + 32).alias("n")).first()["n"] or 0
    groups, lists = max(1, -(-size // GROUP_BYTES)), []
    for g in range(groups):
        part = _group(asked.where(F.pmod(F.xxhash64("q"), F.lit(groups)) == g))
        vocabulary = sorted({t for _, ts in part for t in ts})
        terms = spark.sparkContext.broadcast(vocabulary)
        words = docs.select(F.coalesce(docs["doc_id"].cast("long"), F.lit(_NONE)).alias("doc"), words_of(text_of(docs)).alias("words"))
        forward = materialize(words.mapInArrow(lambda it, terms=terms: _forward(it, terms), _FORWARD).where("n > 0"), "forward")
        total = forward.agg(F.count("*").alias("docs"), F.sum("n").alias("terms")).first()
        counted = forward.select(F.explode("terms").alias("t")).groupBy("t").agg(F.count("*").alias("df")).collect()  # a row a term of the group
        number, weights = {t: i for i, t in enumerate(vocabulary)}, np.zeros(max(1, len(vocabulary)), np.int64)
        for r in counted:
            weights[r["t"]] = weight(total["docs"], r["df"])
        arranged = []
        for q, ts in part:
            own, times = np.unique(np.array([number[t] for t in ts], np.int64), return_counts=True)
            if len(own):
                arranged.append((q, own, times.astype(np.int64)))
        shared = spark.sparkContext.broadcast((Corpus(total["docs"], total["terms"] or 1, weights), arranged))
        lists.append(materialize(forward.mapInArrow(lambda it, shared=shared: _search(it, shared, k), _LISTS), "ranked"))
        discard(forward)
    found = lists[0]
    for more in lists[1:]:
        found = found.union(more)
    first = Window.partitionBy("q", "tree").orderBy(F.desc("score"), "doc")
    last = Window.partitionBy("q").orderBy(F.desc("score"), "doc")
    merged = (
        found.withColumn("tree", F.pmod(F.xxhash64("doc"), F.lit(16)))
        .withColumn("r", F.row_number().over(first)).where(F.col("r") <= k)
        .withColumn("rank", F.row_number().over(last)).where(F.col("rank") <= k)
    )
    return merged.join(asked.select("q", "item_id"), "q").select(
        "item_id", F.col("rank").cast("int").alias("rank"), F.when(F.col("doc") != _NONE, F.col("doc")).alias("doc_id"), "score"
    )
