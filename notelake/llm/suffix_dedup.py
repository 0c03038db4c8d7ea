"""Removal of repeated byte strings by a hash-compared suffix sort of sampled suffixes."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cmp_to_key

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, released, small_batches, text_of

#: Bytes of the shortest repeated string that is removed, and of the gram that anchors are picked by.
LENGTH, GRAM = 400, 64
#: Window starts treated at once; positions within such a block fit POSITION_BITS.
BLOCK, POSITION_BITS = 1 << 20, 21
#: Distinct surroundings of a gram up to which they are sorted in one task.
SORT_LIMIT = 64

_rng = np.random.default_rng(20_240_229)
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64)
_BASE = 0x9E3779B97F4A7C15 | 1


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, np.uint64(base & ((1 << 64) - 1)))
    out[0] = 1
    return np.multiply.accumulate(out)


_SIDE = _powers(_BASE, LENGTH + 1)
_cache: dict[str, np.ndarray] = {}


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, at least ``n`` of each."""
    if "up" not in _cache or len(_cache["up"]) < n:
        size = min(BLOCK + LENGTH, max(1 << 14, 1 << (n - 1).bit_length()))
        _cache["up"], _cache["down"] = _powers(_BASE, max(size, n)), _powers(pow(_BASE, -1, 1 << 64), max(size, n))
    return _cache["up"], _cache["down"]


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


def _gram_hashes(data: np.ndarray) -> np.ndarray:
    """Hash of every gram, from prefix polynomial hashes."""
    n = len(data)
    up, down = _tables(n)
    prefix = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTE[data] * up[:n], out=prefix[1:])
    return _mixed((prefix[GRAM:] - prefix[:-GRAM]) * down[: n - GRAM + 1])


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    pad = -len(x) % width
    rows = np.concatenate((x, np.full(pad, np.iinfo(x.dtype).max, x.dtype))).reshape(-1, width)
    ahead = np.minimum.accumulate(rows, axis=1).ravel()
    behind = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    n = len(x) - width + 1
    return np.minimum(behind[:n], ahead[width - 1 : width - 1 + n])


def anchors(raw: bytes) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Block by block: gram hash, place, first and last window start of every anchor.

    A window of LENGTH bytes picks the gram of least hash in it (leftmost of equals), so equal
    windows pick the same relative place, and all window starts of a text are dealt to anchors.
    """
    data = np.frombuffer(raw, np.uint8)
    for at in range(0, len(data) - LENGTH + 1, BLOCK):
        part = data[at : at + BLOCK + LENGTH - 1]
        grams = _gram_hashes(part)
        low = np.uint64((1 << POSITION_BITS) - 1)
        packed = (grams & ~low) | np.arange(len(grams), dtype=np.uint64)
        place = (_sliding_min(packed, LENGTH - GRAM + 1) & low).astype(np.int64)
        edge = np.flatnonzero(np.diff(place)) + 1
        first = np.concatenate(([0], edge))
        last = np.concatenate((edge, [len(place)])) - 1
        p = place[first]
        yield grams[p], p + at, first + at, last + at


_ANCHOR = "d long, k long, gram long, c1 long, c2 long, p int, s0 int, s1 int"


def _strong(parts: list[bytes]) -> np.ndarray:
    """The first 128 bits of SHA-256 of each, as two words: nobody can make two byte strings share them, so equal words stand for equal bytes."""
    return np.frombuffer(b"".join([hashlib.sha256(x).digest()[:16] for x in parts]), np.int64).reshape(-1, 2)


def _anchor_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        got: list[list[np.ndarray]] = []
        for d, k, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
            raw = t.as_py()
            for gram, p, s0, s1 in anchors(raw):
                spans = zip(s0.tolist(), s1.tolist(), (p - s0).tolist(), strict=True)
                ctx = _strong([raw[a : b + LENGTH] + o.to_bytes(2) for a, b, o in spans])
                n = len(p)
                got.append([np.full(n, d), np.full(n, k), gram.view(np.int64), ctx[:, 0], ctx[:, 1], *(x.astype(np.int32) for x in (p, s0, s1))])
            if sum(len(g[0]) for g in got[-64:]) > 100_000 or len(got) > 2_000:
                yield _batch(got)
                got = []
        if got:
            yield _batch(got)


def _batch(got: list[list[np.ndarray]]) -> pa.RecordBatch:
    cols = [pa.array(np.concatenate([g[i] for g in got])) for i in range(8)]
    return pa.RecordBatch.from_arrays(cols, names=["d", "k", "gram", "c1", "c2", "p", "s0", "s1"])


_DETAIL = "hot boolean, gram long, single boolean, d long, k long, p int, s0 int, s1 int, left binary, right binary, w1 long, w2 long, s int"


def _detail_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Surroundings of the anchors that a sort compares, or each window's two hashes where too many differ."""
    names = [c.split()[0] for c in _DETAIL.split(", ")]
    kinds = [pa.bool_(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.int32()]
    out: list[tuple] = []
    for batch in batches:
        for d, k, t, todo in zip(*(batch.column(i) for i in range(4)), strict=True):
            d, k, raw = d.as_py(), k.as_py(), t.as_py()
            for a in todo.as_py():
                p, s0, s1 = a["p"], a["s0"], a["s1"]
                if a["hot"]:
                    hashed = _strong([raw[s : s + LENGTH] for s in range(s0, s1 + 1)]).tolist()
                    out += [(True, a["gram"], a["single"], d, k, p, s0, s1, None, None, *w, s0 + i) for i, w in enumerate(hashed)]
                else:
                    out.append((False, a["gram"], a["single"], d, k, p, s0, s1, raw[s0:p], raw[p : s1 + LENGTH], None, None, None))
                if len(out) >= 20_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=names)
                    out = []
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=names)


class Suffix:
    """An anchor's surroundings: bytes from it on, bytes before it backwards, and prefix hashes of both."""

    __slots__ = ("row", "right", "left", "to_right", "to_left")

    def __init__(self, row: dict):
        self.row, self.right, self.left = row, row["right"], row["left"][::-1]
        self.to_right, self.to_left = _prefix(self.right), _prefix(self.left)


def _prefix(raw: bytes) -> np.ndarray:
    """Polynomial hashes of all prefixes, the empty one first."""
    out = np.zeros(len(raw) + 1, np.uint64)
    code = _BYTE[np.frombuffer(raw, np.uint8)]
    power = _SIDE if len(raw) <= LENGTH else _tables(len(raw))[0]
    np.cumsum(code * power[: len(raw)], out=out[1:])
    return out


def common(x: bytes, hx: np.ndarray, y: bytes, hy: np.ndarray) -> int:
    """Length of the common prefix: binary search over prefix hashes, then a check of the bytes."""
    low, high = 0, min(len(x), len(y))
    if hx[high] == hy[high]:
        low = high
    while low < high:
        mid = (low + high + 1) // 2
        if hx[mid] == hy[mid]:
            low = mid
        else:
            high = mid - 1
    if x[:low] != y[:low]:  # a collision: compare bytes
        low = next((i for i, (a, b) in enumerate(zip(x, y, strict=False)) if a != b), min(len(x), len(y)))
    return low


def _compare(a: Suffix, b: Suffix) -> int:
    n = common(a.right, a.to_right, b.right, b.to_right)
    x, y = a.right[n : n + 1], b.right[n : n + 1]
    return (x > y) - (x < y)


def sort_suffixes(items: list[Suffix]) -> tuple[list[Suffix], list[int]]:
    """Suffixes in order (a merge sort with hash comparisons) and each one's common prefix with the next."""
    ordered = sorted(items, key=cmp_to_key(_compare))
    return ordered, [common(a.right, a.to_right, b.right, b.to_right) for a, b in zip(ordered, ordered[1:], strict=False)]


def repeated_starts(group: list[dict]) -> Iterator[tuple[dict, int, int]]:
    """For the anchors of one gram with distinct surroundings: runs ``(row, first, last)`` of window
    starts whose window also surrounds another anchor of the group.

    Two windows that reach ``o`` bytes back from their anchors are equal iff the anchors share
    ``LENGTH - o`` bytes to the right and ``o`` to the left.
    """
    ordered, lcp = sort_suffixes([Suffix(r) for r in group])
    for i, a in enumerate(ordered):
        row = a.row
        if not row["single"]:
            continue
        ranges = []
        low_o, high_o = row["p"] - row["s1"], row["p"] - row["s0"]
        for step in (1, -1):
            right, j = len(a.right), i
            while 0 <= (j := j + step) < len(ordered):
                right = min(right, lcp[j - 1] if step > 0 else lcp[j])
                if right < LENGTH - high_o:
                    break
                b = ordered[j]
                left = common(a.left, a.to_left, b.left, b.to_left)
                lo, hi = max(low_o, LENGTH - right), min(high_o, left)
                if lo <= hi:
                    ranges.append((row["p"] - hi, row["p"] - lo))
        for s0, s1 in ranges:
            yield row, s0, s1


def _sorted_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order of gram -> byte ranges ``(d, k, a, b)``."""
    group: list[dict] = []
    out: list[tuple[int, int, int, int]] = []

    def close() -> None:
        out.extend((r["d"], r["k"], s0, s1 + LENGTH) for r, s0, s1 in repeated_starts(group))

    for batch in batches:
        for row in batch.to_pylist():
            if group and row["gram"] != group[0]["gram"]:
                close()
                group = []
            group.append(row)
        if len(out) > 20_000:
            yield _ranges(out)
            out = []
    if group:
        close()
    if out:
        yield _ranges(out)


def _ranges(out: list[tuple[int, int, int, int]]) -> pa.RecordBatch:
    d, k, a, b = zip(*out, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(d, pa.int64()), pa.array(k, pa.int64()), pa.array(a, pa.int32()), pa.array(b, pa.int32())], names=["d", "k", "a", "b"])


def keyed(docs: DataFrame) -> DataFrame:
    """``(doc_id, d, k, raw)``: d and k identify a document by id and content; null texts are empty."""
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), text_of(docs).alias("t"))
    return rows.select("doc_id", F.coalesce("doc_id", F.lit(-1)).alias("d"), F.xxhash64("t").alias("k"), F.col("t").cast("binary").alias("raw"))


def repeated_ranges(docs: DataFrame) -> DataFrame:
    """``(d, k, ranges array<struct<a,b>>)``: byte ranges covered by repeated strings of LENGTH bytes, unmerged.

    Anchors whose gram and whole surroundings occur twice are repeated throughout (equal surroundings have the same
    128 bits of SHA-256, which is what verifies them; the sort compares bytes). The other
    anchors of a shared gram are compared with one representative of each distinct surroundings:
    by a suffix sort in one task for up to SORT_LIMIT of them, and beyond that by counting the
    hashes of their windows, so that no group of any size meets in one task.
    """
    small_batches(docs.sparkSession)
    rows = keyed(docs)
    found = materialize(rows.where(F.octet_length("raw") >= LENGTH).select("d", "k", "raw").mapInArrow(lambda it: released(_anchor_rows(it)), _ANCHOR), "anchors")
    classes = materialize(
        found.groupBy("gram", "c1", "c2").agg(F.count("*").alias("c"), F.min(F.struct("d", "k", "p", "s0", "s1")).alias("r")), "surroundings"
    )
    grams = materialize(
        classes.groupBy("gram").agg(F.sum("c").alias("n"), F.count("*").alias("m"), F.min("c").alias("least")).where("n > 1"), "grams"
    )
    whole = materialize(classes.where("c > 1").select("gram", "c1", "c2"), "repeated")
    first = found.join(whole, ["gram", "c1", "c2"]).select("d", "k", F.col("s0").alias("a"), (F.col("s1") + LENGTH).alias("b"))

    open_grams = grams.where("least = 1 and m > 1").select("gram", (F.col("m") > SORT_LIMIT).alias("hot"))
    todo = classes.join(open_grams, "gram").select("r.d", "r.k", F.struct("gram", "hot", (F.col("c") == 1).alias("single"), "r.p", "r.s0", "r.s1").alias("x"))
    per_doc = materialize(todo.groupBy("d", "k").agg(F.collect_list("x").alias("todo")), "open")
    texts = rows.select("d", "k", "raw").join(per_doc.hint("merge"), ["d", "k"]).select("d", "k", "raw", "todo")
    detail = materialize(texts.mapInArrow(_detail_rows, _DETAIL), "detail")

    few = detail.where("not hot").select("gram", "single", "d", "k", "p", "s0", "s1", "left", "right")
    sort_in = few.repartition(F.col("gram")).sortWithinPartitions("gram")
    second = sort_in.mapInArrow(_sorted_groups, "d long, k long, a int, b int")

    windows = detail.where("hot").select("w1", "w2", "single", "d", "k", "s")
    place = F.struct("d", "k", "s")
    twice = windows.groupBy("w1", "w2").agg(F.min(place).alias("lo"), F.max(place).alias("hi")).where("lo <> hi")
    shared = materialize(twice.select("w1", "w2"), "windows")
    third = windows.where("single").join(shared, ["w1", "w2"]).select("d", "k", F.col("s").alias("a"), (F.col("s") + LENGTH).alias("b"))

    every = first.union(second).union(third)
    return materialize(every.groupBy("d", "k").agg(F.collect_list(F.struct("a", "b")).alias("ranges")), "ranges")


def merge_ranges(ranges: list[dict] | None) -> list[tuple[int, int]]:
    """Sorted disjoint runs; touching ones join."""
    out: list[tuple[int, int]] = []
    for a, b in sorted((r["a"], r["b"]) for r in ranges or ()):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for raw, ranges in zip(batch.column(1), batch.column(2), strict=True):
            raw, runs = raw.as_py(), merge_ranges(ranges.as_py())
            kept, at = [], 0
            for a, b in runs:
                kept.append(raw[at:a])
                at = b
            kept.append(raw[at:])
            left = b"".join(kept)
            rows.append((len(raw), len(raw) - len(left), len(runs), hashlib.sha256(left).hexdigest(), left))
        cols = list(zip(*rows, strict=True)) if rows else [[]] * 5
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), *(pa.array(c, t) for c, t in zip(cols, kinds, strict=True))],
            names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"],
        )


def remove_repeats(docs: DataFrame) -> DataFrame:
    """``(doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept)`` of every row of ``docs``.

    Every byte covered by a string of LENGTH bytes that starts anywhere else as well, in the same
    or another document, goes; strings are judged on the input. ``kept`` holds the remaining
    bytes (which may cut a character). Null counts as empty; shorter texts stay whole; rows that
    repeat a doc_id and text are two documents and lose what they share; other columns are
    ignored; an empty table gives an empty result.
    """
    ranges = repeated_ranges(docs)
    rows = keyed(docs).join(ranges.hint("merge"), ["d", "k"], "left").select("doc_id", "raw", "ranges")
    return rows.mapInArrow(
        _cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"
    )
