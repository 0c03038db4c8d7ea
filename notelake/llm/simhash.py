"""SimHash near-duplicate detection with pivot distance tables."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, released, small_batches, text_of
from .components import connected_components

BITS = 64
BLOCK_BYTES = 1 << 20
#: Members of one signature up to which its pairs are tested directly.
PAIR_LIMIT = 32
#: References of the table whose rows discard pairs, and of the masked signatures.
TABLE_PIVOTS = 16
SIGNATURE_PIVOTS = 20

_SPACE = re.compile(rb"[\x20\x09-\x0D]")
_BYTE_BITS = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.int64)
_BYTE_OFFSET = (np.arange(8) * 256).astype(np.int64)


def _word_blocks(raw: bytes) -> Iterator[list[bytes]]:
    """Lower-cased words, a bounded piece of text at a time."""
    at, n = 0, len(raw)
    while at < n:
        end = min(n, at + BLOCK_BYTES)
        if end < n:
            m = _SPACE.search(raw, end)
            end = m.start() if m else n
        yield raw[at:end].lower().split()
        at = end


def shingle_hashes(raw: bytes, shingle: int = 3, seed: int = 42) -> Iterator[np.ndarray]:
    """Hashes of a text's word shingles, a bounded piece of text at a time; of a shorter text, of all its words."""
    carry, any_full = [], False
    digest = xxhash.xxh64_intdigest
    for block in _word_blocks(raw):
        words = carry + block
        if len(words) < shingle:
            carry = words
            continue
        joined = b" ".join(words)
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        starts = np.concatenate(([0], ends[:-1] + 1))
        n = len(words) - shingle + 1
        spans = zip(starts[:n].tolist(), ends[shingle - 1 :].tolist(), strict=True)
        yield np.fromiter((digest(joined[a:b], seed) for a, b in spans), np.uint64, n)
        carry, any_full = words[n:], True
    if carry and not any_full:
        yield np.array([digest(b" ".join(carry), seed)], np.uint64)


def fingerprint(raw: bytes, shingle: int = 3, seed: int = 42) -> int:
    """64-bit SimHash of a UTF-8 text, unsigned; zero for a text without words."""
    counts, total = np.zeros(BITS, np.int64), 0
    for hashes in shingle_hashes(raw, shingle, seed):
        cells = hashes.view(np.uint8).reshape(len(hashes), 8) + _BYTE_OFFSET
        counts += (np.bincount(cells.ravel(), minlength=2048).reshape(8, 256) @ _BYTE_BITS).ravel()
        total += len(hashes)
    return int(np.packbits(counts * 2 > total, bitorder="little").view(np.uint64)[0])


def _fingerprints(batches: Iterator[pa.RecordBatch], shingle: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = np.fromiter((fingerprint(x.as_py(), shingle) for x in batch.column(1)), np.uint64, batch.num_rows)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out.view(np.int64))], names=["doc_id", "fp"])


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """``(doc_id, fp)`` of every row of ``docs``; a null text counts as empty."""
    small_batches(docs.sparkSession)
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), text_of(docs).cast("binary").alias("raw"))
    return rows.mapInArrow(lambda it: released(_fingerprints(it, shingle)), "doc_id long, fp long")


def _references(n: int, salt: str) -> list[int]:
    """Fixed pseudo-random reference fingerprints, as signed longs."""
    return [int(np.uint64(xxhash.xxh64_intdigest(f"{salt}:{i}")).astype(np.int64)) for i in range(n)]


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def pigeonhole_masks(distance: int) -> list[int]:
    """Bit masks of which at least one is free of differences for fingerprints within ``distance``.

    ``distance + 1`` bands, each joined with every one of ``distance + 1`` parts of the other bits.
    """
    parts = distance + 1
    bits = np.arange(BITS)
    out = []
    for band in np.array_split(bits, parts):
        rest = np.setdiff1d(bits, band)
        for sub in np.array_split(rest, parts):
            out.append(sum(1 << int(b) for b in (*band, *sub)))
    return out


def _mixed(x: np.ndarray) -> np.ndarray:
    """A bijective mix of 64-bit words."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _keyed(batches: Iterator[pa.RecordBatch], distance: int) -> Iterator[pa.RecordBatch]:
    """For each fingerprint and mask: a hash of the distances, within the mask, to the references."""
    refs = np.array(_references(SIGNATURE_PIVOTS, "signature"), np.int64).view(np.uint64)
    masks = np.array(pigeonhole_masks(distance), np.uint64)
    for batch in batches:
        fp = batch.column(0).to_numpy().view(np.uint64)
        keys = np.empty((len(masks), len(fp)), np.uint64)
        for k, mask in enumerate(masks):
            key = np.full(len(fp), k + 1, np.uint64)
            for r in refs:
                key = _mixed(key * np.uint64(64) + np.bitwise_count((fp ^ r) & mask))
            keys[k] = key
        again = lambda c: pa.array(np.tile(c.to_numpy(), len(masks)))
        cols = [pa.array(keys.ravel().view(np.int64)), again(batch.column(0)), again(batch.column(1))]
        yield pa.RecordBatch.from_arrays(cols, names=["key", "fp", "rep"])


def _table(fp: Column) -> Column:
    return F.array(*[F.bit_count(fp.bitwiseXOR(F.lit(r))).cast("byte") for r in _references(TABLE_PIVOTS, "table")])


def _ball(fp: Column, distance: int) -> Column:
    """The fingerprint and all that differ from it in one bit (for links of 2 bits at most)."""
    return F.concat(F.array(fp), F.array(*[fp.bitwiseXOR(F.lit(_signed(1 << i))) for i in range(BITS)]))


def link_fingerprints(reps: DataFrame, distance: int = 2) -> DataFrame:
    """``reps(fp, rep)``, one row a fingerprint -> edges ``(a, b)`` of reps that connect all
    fingerprints within ``distance`` (2 at most) differing bits.

    Two fingerprints within the distance agree on at least one pigeonhole mask, hence have the
    same distances to every reference within it: an equi-join on those signatures proposes pairs.
    The pivot table (distances to references over all bits) then discards every pair with a
    coordinate that differs by more than ``distance`` (triangle inequality), and an exact count of
    differing bits verifies survivors. Signatures with more than PAIR_LIMIT members don't emit
    pairs: their members meet at shared one-bit neighbours, at most 65 rows each, exact for
    distances up to 2, since any two members of such a neighbourhood differ in 2 bits at most; what
    meets there passes the pivot table and the count of bits like any other pair.
    """
    if distance > 2:
        raise ValueError("links of more than 2 bits are not supported")
    keyed = reps.select("fp", "rep").mapInArrow(lambda it: _keyed(it, distance), "key long, fp long, rep long")
    shared = materialize(keyed.groupBy("key").agg(F.count("*").alias("members")).where("members > 1"), "signatures")
    cand = materialize(keyed.join(shared, "key").select("key", "fp", "rep", "members"), "candidates")
    few = cand.where(F.col("members") <= PAIR_LIMIT).withColumn("table", _table(F.col("fp")))
    left = few.select("key", F.col("fp").alias("fa"), F.col("rep").alias("a"), F.col("table").alias("ta"))
    right = few.select("key", F.col("fp").alias("fb"), F.col("rep").alias("b"), F.col("table").alias("tb"))
    near = F.forall(F.zip_with("ta", "tb", lambda x, y: F.abs(x - y)), lambda d: d <= distance)
    same = F.bit_count(F.col("fa").bitwiseXOR(F.col("fb"))) <= distance
    pairs = left.join(right, (left["key"] == right["key"]) & (F.col("fa") < F.col("fb"))).where(near).where(same).select("a", "b")
    many = cand.where(F.col("members") > PAIR_LIMIT).select("fp", "rep").distinct()
    spread = materialize(many.select("rep", F.explode(_ball(F.col("fp"), distance)).alias("z"), "fp"), "balls")
    if distance == 2:
        hubs = spread.groupBy("z").agg(F.min(F.struct("rep", "fp")).alias("hub"), F.count("*").alias("n")).where("n > 1")
        ends = [F.col("hub.fp").alias("fa"), F.col("hub.rep").alias("a"), F.col("fp").alias("fb"), F.col("rep").alias("b")]
        stars = spread.join(materialize(hubs, "hubs"), "z").where("rep <> hub.rep").select(*ends)
    else:
        own = many.select(F.col("fp").alias("z"), F.col("fp").alias("fa"), F.col("rep").alias("a"))
        stars = spread.join(own, "z").where("a <> rep").select("fa", "a", F.col("fp").alias("fb"), F.col("rep").alias("b"))
    stars = stars.withColumns({"ta": _table(F.col("fa")), "tb": _table(F.col("fb"))}).where(near).where(same).select("a", "b")
    return pairs.union(stars)


def near_duplicates(docs: DataFrame, shingle: int = 3, distance: int = 2) -> DataFrame:
    """``(doc_id, fp, component_id)`` of every row of ``docs``.

    Texts are lower-cased (A-Z), cut into words at ASCII white space and shingles of ``shingle``
    words; fingerprints within ``distance`` bits link, and a component's id is its smallest doc_id.
    Null and empty texts have fingerprint zero and link like any other; repeated rows give
    repeated rows; a null doc_id keeps its fingerprint and takes its component's id; an empty
    table gives an empty result; other columns are ignored.
    """
    prints = materialize(fingerprints(docs, shingle), "fingerprints")
    reps = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("rep")), "fp_reps")
    edges = link_fingerprints(reps.where("rep is not null"), distance)
    found = connected_components(edges)
    comp = materialize(
        reps.join(found, reps.rep == found.v, "left").select("fp", F.coalesce("component", "rep").alias("component_id")), "components"
    )
    return prints.join(comp, "fp").select("doc_id", "fp", "component_id")


def fingerprint_hex(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
