"""Exact top-k inner-product search by tiled matrix products."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, materialize

TILE_QUERIES = 512
SHARD_ROWS = 4096
#: Most rows of an Arrow batch whose rows are whole shards.
PAIRS = 8
_PACKED = "first long, dim int, ids binary, own binary, data binary"
_PARTIAL = "q long, query_id long, own long, vec_id long, score long"


def quantized(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", scale: int = 256) -> DataFrame:
    """``(vec_id, v array<long>)``: floor(scale * x) of every component.

    Null vectors, and vectors that hold a null or non-finite component, are left out.
    """
    x = F.col(vec_col).cast("array<double>")
    bad = F.exists(x, lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf")))
    rows = vectors.where(F.col(vec_col).isNotNull()).where(~F.coalesce(bad, F.lit(True)))
    return rows.select(
        F.col(id_col).cast("long").alias("vec_id"), F.transform(x, lambda e: F.floor(e * scale).cast("long")).alias("v")
    ).where("vec_id is not null")


def _products(q: np.ndarray, s: np.ndarray) -> np.ndarray:
    """Exact integer products: in doubles while every sum stays under 2**53, else in Python's
    integers, held to the range of a long."""
    big = max(1, int(np.abs(q).max(initial=0))) * max(1, int(np.abs(s).max(initial=0))) * max(1, q.shape[1])
    if 0 < big < 1 << 53:
        return (q.astype(np.float64) @ s.astype(np.float64).T).astype(np.int64)
    low, high = np.iinfo(np.int64).min + 1, np.iinfo(np.int64).max
    return np.clip(q.astype(object) @ s.astype(object).T, low, high).astype(np.int64)


def _merged(ids: np.ndarray, score: np.ndarray, more_ids: np.ndarray, more: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Of two lists a query (rows), the k best, ties to the smaller id."""
    ids, score = np.concatenate((ids, more_ids), axis=1), np.concatenate((score, more), axis=1)
    order = np.lexsort((ids, -score), axis=1)[:, :k]
    return np.take_along_axis(ids, order, 1), np.take_along_axis(score, order, 1)


def _best(q: np.ndarray, sids: np.ndarray, s: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Of one tile and shard: ids and scores of each query's k best, ties to the smaller id.

    A partition finds each query's k-th score; only where ties at it leave a choice are they
    ranked by id.
    """
    order = np.argsort(sids, kind="stable")
    sids, score = sids[order], _products(q, s[order])
    want = min(k, len(sids))
    top = np.argpartition(score, len(sids) - want, axis=1)[:, len(sids) - want :]
    edge = np.take_along_axis(score, top, 1).min(axis=1)
    for i in np.flatnonzero((score >= edge[:, None]).sum(axis=1) > want):
        hit = np.flatnonzero(score[i] >= edge[i])
        top[i] = hit[np.argsort(-score[i, hit], kind="stable")][:want]
    return sids[top], np.take_along_axis(score, top, 1)


def _by_length(vectors: pa.ListArray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places and vectors of each length."""
    sizes, values = pa.compute.list_value_length(vectors).to_numpy(), vectors.flatten().to_numpy()
    first = np.cumsum(sizes) - sizes
    for dim in np.unique(sizes).tolist():
        own = np.flatnonzero(sizes == dim)
        yield own, values[first[own][:, None] + np.arange(dim)]


def _packed(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """Rows ``(row, vec_id, v)`` as blocks of at most ``size`` vectors of one length: ids, rows and a matrix each."""

    def block(rows: np.ndarray, ids: np.ndarray, v: np.ndarray) -> pa.RecordBatch:
        cols = [pa.array([int(rows[0])]), pa.array([v.shape[1]], pa.int32()), *(pa.array([x.astype(np.int64).tobytes()], pa.binary()) for x in (ids, rows, v))]
        return pa.RecordBatch.from_arrays(cols, names=["first", "dim", "ids", "own", "data"])

    held: dict[int, list] = {}
    for batch in batches:
        rows, ids = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        for own, v in _by_length(batch.column(2)):
            part = held.setdefault(v.shape[1], [])
            part.append((rows[own], ids[own], v))
            while sum(len(x[0]) for x in part) >= size:
                r, i, m = (np.concatenate(x) for x in zip(*part, strict=True))
                yield block(r[:size], i[:size], m[:size])
                part[:] = [(r[size:], i[size:], m[size:])] if len(r) > size else []
    for part in held.values():
        if part:
            yield block(*(np.concatenate(x) for x in zip(*part, strict=True)))


def packed(vectors: DataFrame, size: int, name: str) -> DataFrame:
    """A table of blocks of ``vectors(row, vec_id, v)``."""
    return materialize(vectors.select("row", "vec_id", "v").mapInArrow(lambda it: _packed(it, size), _PACKED), name)


def _search(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """Pairs of a shard and a tile of queries: each query's k best of the pairs of one task."""
    found: dict[int, tuple] = {}
    read = lambda c, i: np.frombuffer(c[i].as_buffer(), np.int64)
    for batch in batches:
        dims, ids, data, first, tile_ids, tile_rows, tile_data = batch.columns
        for i in range(batch.num_rows):
            dim, key = dims[i].as_py(), first[i].as_py()
            v, q = read(data, i).reshape(-1, dim), read(tile_data, i).reshape(-1, dim)
            got = _best(q, read(ids, i), v, k)
            if key in found:
                rows, *before = found[key]
                found[key] = (rows, *_merged(*before, *got, k))
            else:
                own = np.concatenate([_products(x[None], x[None]).ravel() for x in q])
                found[key] = (np.stack([read(tile_rows, i), read(tile_ids, i), own], axis=1), *got)
    for rows, ids, score in found.values():
        rows = np.repeat(rows, ids.shape[1], axis=0)
        cols = [*(np.ascontiguousarray(c) for c in rows.T), ids.ravel(), score.ravel()]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["q", "query_id", "own", "vec_id", "score"])


def top_k(queries: DataFrame, vectors: DataFrame, k: int = 5) -> DataFrame:
    """``queries``/``vectors`` of ``(vec_id, v)`` -> ``(query_id, rank, vec_id, score)``.

    ``queries`` are rows of ``vectors``. Vectors are written as shards of SHARD_ROWS, queries as tiles of TILE_QUERIES; every shard meets
    every tile of its length, as blocks of two tables whose parts are read by the tasks in turn: nothing passes through the driver. A pair
    makes one matrix product and one partial selection; a task merges the lists of its pairs, so that k + 1 rows a query
    and task are left, which merge over branches and then whole.

    Only vectors of the query's own length are scored; ties go to the smaller vec_id. A query's own row is left
    out: of k + 1 best, one row with its id and its own product goes, else the last. Rows that repeat a vec_id are
    candidates of their own, and as queries have a list each under the same query_id. Empty
    tables give an empty result.
    """
    numbered = lambda df: df.select(F.monotonically_increasing_id().alias("row"), "vec_id", "v")
    shards = packed(numbered(vectors), SHARD_ROWS, "shards")
    tiles = packed(numbered(queries), TILE_QUERIES, "tiles")
    named = tiles.select("first", F.col("dim").alias("tile_dim"), F.col("ids").alias("tile_ids"), F.col("own").alias("tile_rows"), F.col("data").alias("tile_data"))
    pairs = shards.select("dim", "ids", "data").crossJoin(named.hint("shuffle_replicate_nl")).where("dim = tile_dim").drop("tile_dim")
    conf, key = queries.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = conf.get(key)
    conf.set(key, str(PAIRS))
    try:
        found = materialize(pairs.mapInArrow(lambda it: _search(it, k + 1), _PARTIAL), "lists")
    finally:
        conf.set(key, before)
    discard(shards, tiles)
    first = Window.partitionBy("q", "tree").orderBy(F.desc("score"), "vec_id")
    last = Window.partitionBy("q").orderBy(F.desc("score"), "vec_id")
    merged = (
        found.withColumn("tree", F.pmod(F.xxhash64("vec_id"), F.lit(16)))
        .withColumn("r", F.row_number().over(first)).where(F.col("r") <= k + 1)
        .withColumn("r", F.row_number().over(last)).where(F.col("r") <= k + 1)
    )
    mine = F.when((F.col("vec_id") == F.col("query_id")) & (F.col("score") == F.col("own")), F.col("r"))
    cut = F.coalesce(F.min(mine).over(Window.partitionBy("q")), F.lit(k + 1))
    rest = merged.withColumn("cut", cut).where(F.col("r") != F.col("cut"))
    return rest.select("query_id", F.when(F.col("r") > F.col("cut"), F.col("r") - 1).otherwise(F.col("r")).cast("int").alias("rank"), "vec_id", "score")
