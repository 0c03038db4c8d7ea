"""Pairs of texts with similar word shingle sets: exact, by prefix filtering."""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import ArrowUDFType

from .common import discard, materialize, released, small_batches, text_of
from .components import connected_components
from .simhash import TABLE_PIVOTS, _references, fingerprint, link_fingerprints, shingle_hashes

#: Cells that shingles are counted in, for their order (any order gives the same result), and cells of a block of counts.
CELLS, CELL_BLOCK = 1 << 22, 1 << 12
#: Shingles from which on a cell may count as common, and times the mean of all cells that it must have.
COMMON, OVER = 8, 4
#: Members of a bucket up to which its pairs are tested directly.
PAIR_LIMIT = 32
#: Further rounds, and members of a bucket and size band that those outside its largest component meet in each.
ROUNDS, STARS = 1, 4
#: Nodes whose keys are broadcast (24 bytes each) to find their texts.
BROADCAST_NODES = 500_000


def shingle_set(raw: bytes, shingle: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's word shingles; of a shorter text, of all its words."""
    parts = list(shingle_hashes(raw, shingle))
    return np.unique(np.concatenate(parts)) if parts else np.empty(0, np.uint64)


def _cells(batches: Iterator[pa.RecordBatch], shingle: int) -> Iterator[pa.RecordBatch]:
    """One task's shingles by cell, as blocks of counts."""
    counts = np.zeros(CELLS, np.int32)
    for batch in batches:
        sets = [shingle_set(x.as_py(), shingle) for x in batch.column(0)] or [np.empty(0, np.uint64)]
        cell, n = np.unique(np.concatenate(sets) % np.uint64(CELLS), return_counts=True)
        counts[cell.astype(np.int64)] += n.astype(np.int32)
    blocks = counts.reshape(-1, CELL_BLOCK)
    for i in np.flatnonzero(blocks.any(axis=1)):
        yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([blocks[i].tobytes()], pa.binary())], names=["block", "counts"])


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The cells of whole blocks and their counts, over all tasks."""
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for i, x in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            total[i] = total.get(i, 0) + np.frombuffer(x.as_buffer(), np.int32).astype(np.int64)
    for i, n in total.items():
        own = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(i * CELL_BLOCK + own), pa.array(n[own])], names=["cell", "n"])


def _common(docs: DataFrame, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """Cells of common shingles and their counts over all texts.

    Tasks count into CELLS cells and add up block by block. Cells with OVER times the mean are a share of CELLS at most, however many texts there are.
    """
    raw = docs.select(text_of(docs).cast("binary").alias("raw"))
    parts = raw.mapInArrow(lambda it: released(_cells(it, shingle)), "block int, counts binary")
    cells = materialize(parts.repartition("block").mapInArrow(_summed, "cell long, n long"), "shingle_cells")
    every = cells.agg(F.sum("n")).first()[0] or 0
    rows = cells.where(F.col("n") >= max(COMMON, OVER * every / CELLS)).toArrow()
    discard(cells)
    return rows["cell"].to_numpy(), rows["n"].to_numpy()


def parities(own: np.ndarray) -> np.ndarray:
    """Parity bits of a set's hashes by cell, two cells an item or more: a fingerprint in which sets
    that differ in d items differ in d bits at most, as words."""
    cells = max(256, 1 << (2 * len(own) - 1).bit_length())
    odd = np.bincount((own & np.uint64(cells - 1)).astype(np.int64), minlength=cells) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64)


def _folded(words: np.ndarray) -> np.ndarray:
    """The parities of 256 cells, as four words."""
    return np.bitwise_xor.reduce(words.reshape(-1, 4), axis=0)


def _prefixes(batches, shingle: int, least: Fraction, common) -> Iterator[pa.RecordBatch]:
    """Fingerprint, 128-bit key and size of each text's set, the rarest shingles of which a similar
    set has one, its parities and their distances to the references."""
    cells = np.sort(np.append(common[0], CELLS))
    weights = np.append(common[1][np.argsort(common[0])], 0)
    references = np.array(_references(4 * TABLE_PIVOTS, "parity"), np.int64).reshape(-1, 4)
    for batch in batches:
        fp, s1, s2, size, prefix, parity, table = [], [], [], [], [], [], []
        for x in batch.column(3):
            raw = x.as_py()
            own = shingle_set(raw, shingle)
            key = xxhash.xxh3_128_intdigest(own.tobytes())
            keep = len(own) - -(-len(own) * least.numerator // least.denominator) + 1 if len(own) else 0
            cell = (own % np.uint64(CELLS)).astype(np.int64)
            at = np.searchsorted(cells, cell)
            order = np.argsort(np.where(cells[at] == cell, weights[at], 0), kind="stable")[:keep]
            fp.append(fingerprint(raw))
            s1.append(key & ((1 << 64) - 1))
            s2.append(key >> 64)
            size.append(len(own))
            prefix.append(own[order].view(np.int64))
            parity.append(parities(own))
            table.append(np.bitwise_count((_folded(parity[-1]) ^ references).view(np.uint64)).sum(axis=1).astype(np.int16))
        cols = [pa.array(np.array(c, np.uint64).view(np.int64)) for c in (fp, s1, s2)]
        lists = [pa.array(prefix, pa.list_(pa.int64())), pa.array(parity, pa.list_(pa.int64())), pa.array(table, pa.list_(pa.int16()))]
        arrays = [batch.column(0), batch.column(1), batch.column(2), *cols, pa.array(size, pa.int64()), *lists]
        yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "k1", "k2", "fp", "s1", "s2", "n", "prefix", "parity", "table"])


def _similar(shingle: int, least: Fraction):
    """A function of two texts: whether the Jaccard similarity of their whole shingle sets is enough."""

    def similar(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for left, right in batches:
            out, last, own = [], None, np.empty(0, np.uint64)
            for x, y in zip(left, right, strict=True):
                x, y = x.as_py(), y.as_py()
                if x != last:  # the pairs of a text lie side by side
                    last, own = x, shingle_set(x, shingle)
                other = shingle_set(y, shingle)
                shared = len(np.intersect1d(own, other, assume_unique=True))
                out.append(shared * (least.numerator + least.denominator) >= (len(own) + len(other)) * least.numerator)
            yield pa.array(out, pa.bool_())

    return F.arrow_udf(lambda it: released(similar(it)), "boolean", ArrowUDFType.SCALAR_ITER)


def _keys(text: Column) -> list[Column]:
    return [F.xxhash64(text).alias("k1"), F.xxhash64(F.lit(1), text).alias("k2")]


def _enough(least: Fraction, shared: Column, na: Column, nb: Column) -> Column:
    """Whether ``shared`` of sets of ``na`` and ``nb`` reach the similarity."""
    return shared * (least.numerator + least.denominator) >= (na + nb) * least.numerator


def _possible(least: Fraction) -> Column:
    """What sizes and places of two sets' first common shingle allow: it, and all after it.

    Shingles have one order over all texts. Every similar pair meets in the bucket of its first
    common shingle, where nothing before it is shared; other buckets needn't propose it.
    """
    return _enough(least, F.least(F.col("na") - F.col("pa"), F.col("nb") - F.col("pb")), F.col("na"), F.col("nb"))


def _apart(xa: Column, xb: Column) -> Column:
    """Bits that differ between two parities; the longer one is first folded to the length of the other."""
    add = lambda a, x: a + x
    count = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: F.bit_count(p.bitwiseXOR(q))), F.lit(0), add)

    def half(x: Column) -> Column:
        n = (F.size(x) / 2).cast("int")
        return F.zip_with(F.slice(x, F.lit(1), n), F.slice(x, n + 1, n), lambda p, q: p.bitwiseXOR(q))

    same = F.when(F.size(xa) == F.size(xb), count(xa, xb))
    twice = same.when(F.size(xa) == 2 * F.size(xb), count(half(xa), xb)).when(F.size(xb) == 2 * F.size(xa), count(xa, half(xb)))
    return twice.otherwise(0)  # sizes further apart than similar sets' are no reason to discard here


def _marks(nodes: DataFrame, s: str) -> DataFrame:
    """Size, parities and pivot distances of nodes, named for one side of a pair."""
    return nodes.select(F.col("node").alias(s), F.col("n").alias(f"n{s}"), F.col("parity").alias(f"x{s}"), F.col("table").alias(f"t{s}"))


def _close(least: Fraction) -> Column:
    """Whether two marked nodes can be similar.

    Sets that differ in d shingles differ in d bits of their parities at most, and so do the distances of
    these to any reference: the pivot table discards pairs by their largest coordinate difference, the
    parities most of the rest.
    """
    allowed = F.floor((F.col("na") + F.col("nb")) * (least.denominator - least.numerator) / (least.numerator + least.denominator))
    near = F.forall(F.zip_with("ta", "tb", lambda x, y: F.abs(x - y)), lambda d: d <= allowed)
    return F.when(near, _apart(F.col("xa"), F.col("xb")) <= allowed).otherwise(F.lit(False))


def _verified(docs: DataFrame, nodes: DataFrame, pairs: DataFrame, shingle: int, least: Fraction, closed: bool = False) -> DataFrame:
    """The pairs ``(a, b)`` whose sets are similar.

    Pairs pass the marks first (unless ``closed``: they have); the whole sets, made from the texts, decide.
    Up to BROADCAST_NODES nodes, their keys are broadcast so that only their texts are shuffled.
    """
    close = pairs.select("a", "b").distinct()
    if not closed:
        close = close.join(_marks(nodes, "a"), "a").join(_marks(nodes, "b"), "b").where(_close(least))
    pairs = materialize(close.select("a", "b"), "similar_candidates")
    wanted = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    texts = docs.select(text_of(docs).alias("t")).select("t", *_keys(F.col("t")))
    of = materialize(nodes.join(wanted, "node").select("node", "k1", "k2"), "similar_nodes")
    few = of.limit(BROADCAST_NODES + 1).count() <= BROADCAST_NODES
    raw = texts.join(F.broadcast(of) if few else of.hint("merge"), ["k1", "k2"]).dropDuplicates(["node"])
    raw = materialize(raw.select("node", F.col("t").cast("binary").alias("raw")), "similar_texts")
    left = raw.select(F.col("node").alias("a"), F.col("raw").alias("ra"))
    right = raw.select(F.col("node").alias("b"), F.col("raw").alias("rb"))
    both = pairs.join(right.hint("merge"), "b").join(left.hint("merge"), "a")
    found = materialize(both.where(_similar(shingle, least)("ra", "rb")).select("a", "b"), "similar")
    discard(pairs, of, raw)
    return found


def near_copies(docs: DataFrame, shingle: int = 5, similarity: float = 0.8, distance: int = 2) -> tuple[DataFrame, DataFrame]:
    """Rows ``(doc_id, k1, k2, node)`` of ``docs`` and ``(node, lo, component)`` of their nodes.

    A node stands for the texts of one shingle set and fingerprint. Nodes link when the Jaccard
    similarity of their sets of ``shingle`` words is at least ``similarity`` (no pair is missed:
    similar sets share one of their first shingles in any common order, here rarest first, and
    every pair proposed is verified on the whole sets), or when their fingerprints link as in op1.
    Members of buckets of more than PAIR_LIMIT first meet one member of their size band, another one in each bucket;
    those outside the bucket's largest component meet a few more, and only those still outside it
    meet all others, so a group of copies doesn't emit its pairs.

    A null text counts as empty; texts without a word are one node; rows that repeat an id or have none are rows of
    their own; other columns are ignored; an empty table gives empty results.
    """
    small_batches(docs.sparkSession)
    least = Fraction(similarity).limit_denominator(1000)
    common = _common(docs, shingle)
    flat = docs.select(docs["doc_id"].cast("long").alias("doc_id"), text_of(docs).alias("t"))
    texts = flat.select("doc_id", *_keys(F.col("t")), F.col("t").cast("binary").alias("raw"))
    schema = "doc_id long, k1 long, k2 long, fp long, s1 long, s2 long, n long, prefix array<long>, parity array<long>, table array<short>"
    prints = materialize(texts.mapInArrow(lambda it: released(_prefixes(it, shingle, least, common)), schema), "prefixes")
    key = ["s1", "s2", "fp"]
    rows = materialize(prints.select("doc_id", "k1", "k2", *key), "rows")
    firsts = [F.first(c).alias(c) for c in ("n", "prefix", "parity", "table")]
    grouped = prints.groupBy(*key).agg(F.min("doc_id").alias("lo"), F.min(F.struct("k1", "k2")).alias("k"), *firsts)
    nodes = materialize(
        grouped.withColumn("node", F.monotonically_increasing_id()).select("node", *key, "lo", F.col("k.k1"), F.col("k.k2"), "n", "prefix", "parity", "table"), "nodes"
    )
    discard(prints)
    reps = materialize(nodes.groupBy("fp").agg(F.min("node").alias("rep")), "fp_reps")
    same = nodes.join(reps, "fp").where("node <> rep").select(F.col("rep").alias("a"), F.col("node").alias("b"))
    first = nodes.groupBy("s1", "s2").agg(F.min("node").alias("rep"))
    equal = nodes.join(first, ["s1", "s2"]).where("node <> rep").select(F.col("rep").alias("a"), F.col("node").alias("b"))
    edges = materialize(link_fingerprints(reps, distance).union(same).union(equal), "near_edges")

    places = nodes.select("node", "n", F.posexplode("prefix").alias("p", "token"))
    shared = materialize(places.groupBy("token").agg(F.count("*").alias("members")).where("members > 1"), "shared_shingles")
    cand = materialize(places.join(shared, "token"), "buckets")
    side = lambda df, s: df.select("token", *[F.col(c).alias(f"{c}{s}" if c != "node" else s) for c in df.columns if c in ("node", "n", "p", "c")])
    few, many = cand.where(F.col("members") <= PAIR_LIMIT), cand.where(F.col("members") > PAIR_LIMIT)
    pairs = side(few, "a").join(side(few, "b"), "token").where("a < b").where(_possible(least))
    band = F.floor(F.log("n") / float(np.log(1 / similarity))) if similarity < 1 else F.col("n")
    crowd = materialize(many.select("token", "node", "n", "p", band.alias("band")), "crowd")

    def starred(members: DataFrame, salt: int) -> DataFrame:
        """Pairs of ``members`` with one member of their bucket and size band, by a hash with ``salt``."""
        hub = F.min(F.struct(F.xxhash64(F.lit(salt), "token", "node"), "node", "n", "p")).alias("hub")
        ends = [F.col(f"hub.{c}").alias(x) for c, x in (("node", "a"), ("n", "na"), ("p", "pa"))]
        met = members.join(crowd.groupBy("token", "band").agg(hub), ["token", "band"])
        both = met.select(*ends, F.col("node").alias("b"), F.col("n").alias("nb"), F.col("p").alias("pb")).where("a <> b").where(_possible(least))
        return both.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))

    def placed(found: DataFrame) -> tuple[DataFrame, DataFrame]:
        """All members of crowded buckets with their component, and those outside their bucket's largest one."""
        own = crowd.join(found, crowd.node == found.v, "left").select("token", "node", "n", "p", "band", F.coalesce("component", "node").alias("c"))
        own = materialize(own, "crowded")
        sizes = own.groupBy("token", "c").agg(F.count("*").alias("m"))
        home = sizes.groupBy("token").agg(F.max(F.struct("m", "c")).alias("home"))
        return own, materialize(own.join(home, "token").where("c <> home.c").select("token", "node", "n", "p", "band", "c"), "away")

    def linked(found: DataFrame) -> DataFrame:
        """One link a node, to the least of its component: what was found before, in place of all its links."""
        return found.where("v <> component").select(F.col("component").alias("a"), F.col("v").alias("b"))

    proposed = pairs.select("a", "b").union(starred(crowd, 0))
    for again in range(ROUNDS + 1):
        found = connected_components(edges.union(_verified(docs, nodes, proposed, shingle, least)))
        edges = linked(found)
        own, away = placed(found)
        if not away.limit(1).count():
            break
        if again < ROUNDS:
            proposed = reduce(DataFrame.union, [starred(away, 1 + STARS * again + k) for k in range(STARS)])
        else:
            # The marks are part of the join's condition: what they discard is never a row.
            left = away.select("token", F.col("node").alias("a"), F.col("p").alias("pa"), F.col("c").alias("ca")).join(_marks(nodes, "a"), "a")
            right = own.select("token", F.col("node").alias("b"), F.col("p").alias("pb"), F.col("c").alias("cb")).join(_marks(nodes, "b"), "b")
            both = (left["token"] == right["token"]) & (F.col("ca") != F.col("cb")) & _possible(least) & _close(least)
            rest = left.join(right, both).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
            found = connected_components(edges.union(_verified(docs, nodes, rest, shingle, least, closed=True)))
    comp = nodes.join(found, nodes.node == found.v, "left").select("node", "lo", F.coalesce("component", "node").alias("component"))
    of = materialize(nodes.select(*key, "node"), "node_keys")
    comp = materialize(comp, "components")
    discard(nodes, cand, crowd)
    return rows.join(of, key).select("doc_id", "k1", "k2", "node"), comp


def keep_one(docs: DataFrame, shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """Rows of ``docs`` that keep their group of near copies: those with its smallest doc_id.

    Rows are decided by doc_id and text, so an id that carries several texts is judged text by
    text, and a row without an id keeps its group only if no row of it has one. Of rows
    that repeat id and text all stay; a null text counts as empty; an empty table gives none.
    """
    rows, comp = near_copies(docs, shingle, similarity)
    heads = comp.groupBy("component").agg(F.min(F.struct(F.col("lo").isNull().alias("none"), "lo", "node")).alias("h"))
    heads = materialize(heads.select(F.col("h.node").alias("node"), F.col("h.lo").alias("lo")), "heads")
    kept = rows.join(heads, "node").where(F.col("doc_id").eqNullSafe(F.col("lo"))).groupBy("doc_id", "node").agg(F.min(F.struct("k1", "k2")).alias("k"))
    kept = materialize(kept.select(F.col("doc_id").alias("kept_id"), F.col("k.k1"), F.col("k.k2")), "kept")
    row = F.struct(*[docs[c] for c in docs.columns]).alias("row")
    keyed = docs.select(docs["doc_id"].cast("long").alias("own_id"), *_keys(text_of(docs)), row)
    same = keyed["own_id"].eqNullSafe(kept["kept_id"]) & (keyed["k1"] == kept["k1"]) & (keyed["k2"] == kept["k2"])
    return keyed.join(kept.hint("merge"), same, "left_semi").select("row.*")
