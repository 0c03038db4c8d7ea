"""Approximate nearest vectors by hashed projections, re-ranked exactly. The exact search stays the default."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

_BUCKETS = "id long, bucket array<int>"
#: Vectors and queries of a block.
SHARD, TILE = 2048, 512
#: Parts that the shards are dealt to, each of which gives k rows a query; pairs of blocks of an Arrow batch.
BRANCHES, PAIRS = 8, 16
#: Room for rounding between a matrix product and the scores that decide.
SLACK = 1e-9
_SHARDS = "n int, ids binary, vectors binary, owner binary, bucket binary"
_TILES = "tile long, query_ids binary, queries binary"
_FOUND = "query_id long, id long, score double"


@dataclass
class Projections:
    """Seeded random planes, ``bits`` for each of ``tables`` tables; a vector's bucket has a bit for the side of each plane."""

    dimensions: int
    tables: int = 24
    bits: int = 8
    seed: int = 1

    def planes(self) -> np.ndarray:
        return np.random.default_rng(self.seed).standard_normal((self.dimensions, self.tables * self.bits))

    def sides(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Buckets ``(n, tables)`` of vectors of length one, and their distances to all planes."""
        length = np.linalg.norm(vectors, axis=1, keepdims=True)
        far = (vectors / np.where(length > 0, length, 1.0)) @ self.planes()
        bits = (far.reshape(len(vectors), self.tables, self.bits) > 0).astype(np.int64)
        return bits @ (1 << np.arange(self.bits)), far.reshape(len(vectors), self.tables, self.bits)


def _vectors(batch: pa.RecordBatch, dimensions: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and vectors of the rows that have the right length and only finite numbers."""
    held = [(i, v) for i, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) if i is not None and v is not None and len(v) == dimensions and None not in v]
    ids, vectors = np.array([i for i, _ in held], np.int64), np.array([v for _, v in held], np.float64).reshape(-1, dimensions)
    good = np.isfinite(vectors).all(axis=1)
    return ids[good], vectors[good]


def buckets(vectors: DataFrame, planes: Projections, key: str = "vec_id", column: str = "embedding") -> DataFrame:
    """The index: ``(id, bucket)`` of every vector of the planes' dimensions, a bucket a table. Write it once and pass it on.

    Vectors that are null, of another length, or hold a null or non-finite number are left out, as are null ids.
    """

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, held = _vectors(batch, planes.dimensions)
            bucket, _ = planes.sides(held)
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(list(bucket.astype(np.int32)), pa.list_(pa.int32()))], names=["id", "bucket"])

    return vectors.select(F.col(key).cast("long").alias("id"), F.col(column).alias("v")).mapInArrow(place, _BUCKETS)


def _blocks(batches: Iterator[pa.RecordBatch], dimensions: int, size: int) -> Iterator[tuple[pa.Table, np.ndarray, np.ndarray]]:
    """Rows ``(id, v, ...)`` in blocks of at most ``size``: those with a good vector longer than 0, their ids and vectors."""

    def block(rows: pa.Table) -> Iterator[tuple[pa.Table, np.ndarray, np.ndarray]]:
        some = [i for i, (x, v) in enumerate(zip(rows.column(0).to_pylist(), rows.column(1).to_pylist(), strict=True)) if x is not None and v is not None and len(v) == dimensions and None not in v]
        rows = rows.take(pa.array(some, pa.int64()))
        v = np.array(rows.column(1).to_pylist(), np.float64).reshape(-1, dimensions)
        good = np.flatnonzero(np.isfinite(v).all(axis=1) & (v != 0).any(axis=1))
        if len(good):
            yield rows.take(pa.array(good)), rows.column(0).to_numpy()[good].astype(np.int64), v[good]

    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(x.num_rows for x in held) >= size:
            rows = pa.Table.from_batches(held)
            for first in range(0, rows.num_rows - size + 1, size):
                yield from block(rows.slice(first, size))
            held = rows.slice(rows.num_rows // size * size).to_batches()
    if held:
        yield from block(pa.Table.from_batches(held))


def _shards(batches: Iterator[pa.RecordBatch], planes: Projections) -> Iterator[pa.RecordBatch]:
    """Rows ``(id, v, buckets)`` as blocks: ids, vectors, and lists of a bucket a table with the row that each belongs to."""
    for part, ids, v in _blocks(batches, planes.dimensions, SHARD):
        lists = part.column(2).to_pylist()
        owner = np.repeat(np.arange(len(ids)), [len(x) for x in lists])
        codes = np.array([c for x in lists for c in x], np.int32)
        cols = [pa.array([len(ids)], pa.int32()), *(pa.array([x.tobytes()], pa.binary()) for x in (ids, v, owner, codes))]
        yield pa.RecordBatch.from_arrays(cols, names=["n", "ids", "vectors", "owner", "bucket"])


def _tiles(batches: Iterator[pa.RecordBatch], planes: Projections) -> Iterator[pa.RecordBatch]:
    """Rows ``(id, v, row)`` as blocks of queries, named by their first row."""
    for part, ids, v in _blocks(batches, planes.dimensions, TILE):
        cols = [pa.array([part.column(2)[0].as_py()], pa.int64()), *(pa.array([x.tobytes()], pa.binary()) for x in (ids, v))]
        yield pa.RecordBatch.from_arrays(cols, names=["tile", "query_ids", "queries"])


def _probes(queries: np.ndarray, planes: Projections, probes: int) -> np.ndarray:
    """For each table and bucket, bits of the queries that look into it: into their own, and those over the planes that they lie next to."""
    bucket, far = planes.sides(queries)
    near = np.argsort(np.abs(far), axis=2)[:, :, :probes]
    every = np.concatenate([bucket[:, :, None], bucket[:, :, None] ^ (1 << near)], axis=2)
    asked = np.zeros((planes.tables, 1 << planes.bits, len(queries)), bool)
    row, table = np.arange(len(queries))[:, None, None], np.arange(planes.tables)[None, :, None]
    asked[np.broadcast_to(table, every.shape), every, np.broadcast_to(row, every.shape)] = True
    return np.packbits(asked, axis=2)


def _length(v: np.ndarray) -> np.ndarray:
    return np.sqrt(_total(v * v))


def _total(x: np.ndarray) -> np.ndarray:
    """Sums of rows in their order, so that a pair has one score wherever it is scored."""
    out = np.zeros(len(x))
    for i in range(x.shape[1]):
        out += x[:, i]
    return out


def _best(rows: np.ndarray, ids: np.ndarray, score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of scored candidates of several queries (``rows``), each query's k best, ties to the smaller id."""
    order = np.lexsort((ids, -score, rows))
    rows, ids, score = rows[order], ids[order], score[order]
    first = np.searchsorted(rows, rows)
    keep = np.arange(len(rows)) - first < k
    return rows[keep], ids[keep], score[keep]


def _search(batches: Iterator[pa.RecordBatch], planes: Projections, k: int, probes: int) -> Iterator[pa.RecordBatch]:
    """Pairs of a shard and a tile: each query's k best of the candidates of one task, which keeps no pair."""
    tiles: dict[int, list] = {}
    for batch in batches:
        for r in batch.to_pylist():
            ids, v = np.frombuffer(r["ids"], np.int64), np.frombuffer(r["vectors"], np.float64).reshape(-1, planes.dimensions)
            owner, codes = np.frombuffer(r["owner"], np.int64), np.frombuffer(r["bucket"], np.int32).reshape(-1, planes.tables)
            owner = owner[:: planes.tables]
            if r["tile"] not in tiles:
                q = np.frombuffer(r["queries"], np.float64).reshape(-1, planes.dimensions)
                none = (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))
                tiles[r["tile"]] = [np.frombuffer(r["query_ids"], np.int64), q, _length(q), _probes(q, planes, probes), np.full(len(q), -np.inf), none]
            query_ids, q, qn, asked, least, found = tiles[r["tile"]]
            met = np.zeros((len(owner), asked.shape[2]), np.uint8)
            for t in range(planes.tables):
                met |= asked[t][codes[:, t]]
            if len(owner) > len(ids):  # an id that the index has more than once
                met = np.bitwise_or.reduceat(met, np.flatnonzero(np.diff(owner, prepend=-1)), axis=0)
            near, vn = np.unpackbits(met, axis=1, count=len(q)).astype(bool), _length(v)
            score = np.where(near, (v @ q.T) / (vn[:, None] * qn), -np.inf)
            if len(ids) > k:
                least = np.maximum(least, np.partition(score, len(ids) - k, axis=0)[len(ids) - k])
            at, row = np.nonzero(near & (score >= least - SLACK))
            exact = _total(q[row] * v[at]) / (qn[row] * vn[at])
            found = _best(*(np.concatenate(x) for x in zip(found, (row, ids[at], exact), strict=True)), k)
            full = np.bincount(found[0], minlength=len(q)) == k
            low = np.full(len(q), np.inf)
            np.minimum.at(low, found[0], found[2])
            tiles[r["tile"]][4:] = [np.where(full, low, -np.inf), found]
    for query_ids, *_, (row, ids, score) in tiles.values():
        yield pa.RecordBatch.from_arrays([pa.array(query_ids[row]), pa.array(ids), pa.array(score)], names=["query_id", "id", "score"])


def near_k(
    queries: DataFrame, vectors: DataFrame, index: DataFrame, planes: Projections, k: int = 10, probes: int = 8, key: str = "vec_id", column: str = "embedding"
) -> DataFrame:
    """``(query_id, rank, id, score)``: of the vectors that share a probed bucket with a query, the k of highest cosine, ties by id.

    ``queries`` are rows like those of ``vectors``; a query's own id is among its results, as any other. ``index`` is
    what ``buckets`` made of ``vectors``. Only vectors outside all probed buckets can be missed, and every score is exact. More tables or
    probes miss fewer. With the defaults, on 2,000 random vectors of 64 dimensions
    (the tenth neighbour has a cosine of 0.32, so nothing is really near), recall at 10 is 0.96 and 56 % of all pairs are scored.

    So many pairs are no rows: vectors lie in shards with their buckets, queries in tiles, and each pair of blocks is
    scored in a task, which keeps k rows a query. BRANCHES times as many are written for the last choice.
    """
    spark = queries.sparkSession
    named = lambda df: df.select(F.col(key).cast("long").alias("id"), F.col(column).cast("array<double>").alias("v"))
    places = index.groupBy("id").agg(F.flatten(F.collect_list("bucket")).alias("bucket"))
    shards = named(vectors).join(places, "id").mapInArrow(lambda it: _shards(it, planes), _SHARDS).repartition(BRANCHES)
    asked = named(queries).select("id", "v", F.monotonically_increasing_id().alias("row"))
    tiles = asked.mapInArrow(lambda it: _tiles(it, planes), _TILES).repartition(spark.sparkContext.defaultParallelism)
    pairs = shards.crossJoin(tiles.hint("shuffle_replicate_nl"))
    conf, name = spark.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = conf.get(name)
    conf.set(name, str(PAIRS))
    try:
        lists = pairs.mapInArrow(lambda it: _search(it, planes, k, probes), _FOUND)
        lists = lists.checkpoint() if conf.get("spark.checkpoint.dir", None) else lists.localCheckpoint()
    finally:
        conf.set(name, before)
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return lists.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "id", "score")
