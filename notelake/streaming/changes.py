"""Debounced change streams: batches of changes closed by a pause, and incremental indexing."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions import text as X
from ..sources import files

GAP = "3 seconds"
#: Times of one key are sorted within spans of this length, so that a key's history lies in many tasks.
SPAN = "hour"


def indexable(changes: DataFrame) -> DataFrame:
    """Changes of notes and bases outside hidden folders."""
    return changes.where(is_indexable(F.col("path")))


def is_indexable(path):
    return ~X.hidden(path) & (path.endswith(".md") | path.endswith(".base"))


def batch_starts(changes: DataFrame, key: str = "vault", gap: str = GAP) -> DataFrame:
    """``(key, ts, start)`` of each distinct time of a table: when the batch that it belongs to began.

    A batch starts where a key's time differs from the one before by more than the gap. Times are sorted within
    spans; between the spans of a key go only their first and last time and last start.
    """
    times = changes.select(key, "ts").distinct().withColumn("span", F.date_trunc(SPAN, "ts"))
    within, across = Window.partitionBy(key, "span").orderBy("ts"), Window.partitionBy(key).orderBy("span")
    spans = times.groupBy(key, "span").agg(F.max("ts").alias("last")).withColumn("before", F.lag("last").over(across)).drop("last")
    near = F.coalesce(F.lag("ts").over(within), "before")
    fresh = F.when(F.col("near").isNull() | (F.col("near") + F.expr(f"interval {gap}") < F.col("ts")), F.col("ts"))
    starts = times.join(spans, [key, "span"]).withColumn("near", near).withColumn("fresh", fresh)
    running = starts.withColumn("own", F.max("fresh").over(within.rowsBetween(Window.unboundedPreceding, 0)))
    heads = running.groupBy(key, "span").agg(F.max("fresh").alias("head"))
    carried = heads.withColumn("carried", F.max("head").over(across.rowsBetween(Window.unboundedPreceding, -1))).drop("head")
    return running.join(carried, [key, "span"]).select(key, "ts", F.coalesce("own", "carried").alias("start"))


def debounced(changes: DataFrame, key: str = "vault", gap: str = GAP, watermark: str | None = None) -> DataFrame:
    """``changes(ts, <key>, path, change_type)`` -> one row a pause-separated batch of each key.

    ``(key, start, end, n_changes)``, and on a table ``n_paths``. Works on a stream (give a watermark; the last open
    batch appears once the watermark has passed it; the state of a batch is its count) and on a table alike.
    """
    if watermark:
        rows = changes.withWatermark("ts", watermark)
        got = rows.groupBy(key, F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n_changes"))
        return got.select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n_changes")
    dated = changes.where(F.col("ts").isNotNull()).join(batch_starts(changes, key, gap), [key, "ts"])
    got = dated.groupBy(key, "start").agg(F.max("ts").alias("last"), F.count("*").alias("n_changes"), F.count_distinct("path").alias("n_paths"))
    return got.select(key, "start", (F.col("last") + F.expr(f"interval {gap}")).alias("end"), "n_changes", "n_paths")


def last_changes(changes: DataFrame, key: str = "vault", gap: str = GAP) -> DataFrame:
    """``(key, start, path, change_type)``: each path's last change (the greatest of equally late ones) within each batch of a table."""
    last = F.max(F.struct("ts", "change_type"))
    dated = changes.join(batch_starts(changes, key, gap), [key, "ts"])
    return dated.groupBy(key, "start", "path").agg(last.alias("c")).select(key, "start", "path", "c.change_type")


# -- a stream's batches, with their paths


_SETTLED = "vault string, start timestamp, end timestamp, path string, change_type string"
_ROWS = 10_000
#: Changes that a task of the watcher has in memory at once.
HELD = 1 << 20


def _joined(starts: np.ndarray, ends: np.ndarray, gap: int) -> tuple[np.ndarray, np.ndarray]:
    """Spans of time with those that lie no further apart than ``gap`` made one, in order."""
    if not len(starts):
        return starts, ends
    order = np.argsort(starts, kind="stable")
    starts, ends = starts[order], np.maximum.accumulate(ends[order])
    first = np.flatnonzero(np.append(True, starts[1:] > ends[:-1] + gap))
    return starts[first], ends[np.append(first[1:], len(starts)) - 1]


class Settling(StatefulProcessor):
    """Holds a vault's changes until none has come for ``gap``; then emits each path's last one.

    Every event moves the pause on, also one whose path is null (of a file that isn't indexed). Batches may still
    join while the watermark hasn't passed them, so state has the open batches' ends by their start, and the changes as they
    came, in blocks of one Arrow batch each: a block is one call of the state store, not one a change. Which batch a change belongs to follows
    from its time. When the changes held have doubled, only each path's last one in its batch stays. Changes are reduced in rounds
    by a hash of the path, so a burst of many paths isn't held in memory. A timer waits for the watermark to pass the earliest end.
    """

    def __init__(self, gap_us: int):
        self.gap = gap_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getMapState("open", "start long", "end long")
        self.blocks = handle.getMapState("blocks", "number long", "block binary")
        self.size = handle.getValueState("size", "next long, held long, least long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        before = self._spans()
        waiting = [before]
        following, held, least = self._size()
        for frame in rows:
            frame = frame[frame["us"].notna()]
            us = frame["us"].to_numpy(np.int64)
            waiting.append(_joined(us, us, self.gap))
            if sum(len(s) for s, _ in waiting[1:]) > HELD:
                waiting = [self._all(waiting)]
            notes = frame[frame["path"].notna()]
            if len(notes):
                held += len(notes)
                following = self._put(following, self._block(notes))
        starts, ends = self._all(waiting)
        self._keep(before, starts, ends)
        if held > 2 * least + HELD // 8:
            old, held, rounds = self._numbers(), 0, 1 + held // HELD
            for table in self._last(old, rounds, starts, np.ones(len(starts), bool)):
                table = table.drop_columns(["at"])
                for i in range(0, len(table), _ROWS):
                    following = self._put(following, table.slice(i, _ROWS))
                held += len(table)
            for n in old:
                self.blocks.removeKey((n,))
            least = held
        self.size.update((following, held, least))
        self._wait(ends)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs() * 1000
        starts, ends = self._spans()
        done = ends + self.gap < now
        following, held, least = self._size()
        numbers = self._numbers()
        for table in self._last(numbers, 1 + held // HELD, starts, done):
            for i in range(0, len(table), _ROWS):
                yield self._frame(key[0], table.slice(i, _ROWS), starts, ends)
        for n in numbers:
            table = self._get(n)
            rest = table.filter(~done[self._at(table, starts)])
            held -= len(table) - len(rest)
            if not len(rest):
                self.blocks.removeKey((n,))
            elif len(rest) < len(table):
                self._put(n, rest)
        self._keep((starts, ends), starts[~done], ends[~done])
        self.size.update((following, held, min(least, held)))
        self._wait(ends[~done])

    # spans of the open batches
    def _spans(self) -> tuple[np.ndarray, np.ndarray]:
        found = sorted((k[0], v[0]) for k, v in self.open.iterator())
        return tuple(np.array(found, np.int64).reshape(-1, 2).T)

    def _all(self, spans: list) -> tuple[np.ndarray, np.ndarray]:
        return _joined(np.concatenate([s for s, _ in spans]), np.concatenate([e for _, e in spans]), self.gap)

    def _keep(self, before: tuple, starts: np.ndarray, ends: np.ndarray) -> None:
        old, new = (dict(zip(s.tolist(), e.tolist(), strict=True)) for s, e in (before, (starts, ends)))
        for s in old.keys() - new.keys():
            self.open.removeKey((s,))
        for s, e in new.items():
            if old.get(s) != e:
                self.open.updateValue((s,), (e,))

    def _wait(self, ends: np.ndarray) -> None:
        for at in list(self.handle.listTimers()):
            self.handle.deleteTimer(at)
        if len(ends):
            self.handle.registerTimer((int(ends.min()) + self.gap) // 1000 + 1)

    # blocks of changes
    def _size(self) -> tuple[int, int, int]:
        return tuple(self.size.get()) if self.size.exists() else (0, 0, 0)

    def _numbers(self) -> list[int]:
        return [k[0] for k in self.blocks.keys()]

    @staticmethod
    def _block(notes: pd.DataFrame) -> pa.Table:
        texts = {n: pa.array(notes[n], pa.string()) for n in ("path", "change_type")}
        deal = pd.util.hash_array(notes["path"].to_numpy(object), categorize=False)
        return pa.table({"us": notes["us"].to_numpy(np.int64), **texts, "deal": deal})

    def _put(self, number: int, table: pa.Table) -> int:
        """Write a block under a number; the number after it."""
        out = pa.BufferOutputStream()
        with pa.ipc.new_stream(out, table.schema) as stream:
            stream.write_table(table)
        self.blocks.updateValue((number,), (out.getvalue().to_pybytes(),))
        return number + 1

    def _get(self, number: int) -> pa.Table:
        return pa.ipc.open_stream(bytes(self.blocks.getValue((number,))[0])).read_all()

    @staticmethod
    def _at(table: pa.Table, starts: np.ndarray) -> np.ndarray:
        """The place of each change's batch."""
        return np.searchsorted(starts, table["us"].to_numpy(), "right") - 1

    def _last(self, numbers: list[int], rounds: int, starts: np.ndarray, wanted: np.ndarray) -> Iterator[pa.Table]:
        """Each path's last change in each of the wanted batches, with the batch's place ``at``; in rounds by the hash of the path."""
        for i in range(rounds if wanted.any() else 0):
            found = []
            for n in numbers:
                table = self._get(n)
                at = self._at(table, starts)
                mine = wanted[at] & (table["deal"].to_numpy() % rounds == i)
                found.append(table.filter(mine).append_column("at", pa.array(at[mine])))
            if not found:
                return
            rows = pa.concat_tables(found).combine_chunks().sort_by([(c, "ascending") for c in ("at", "path", "us", "change_type")])
            if len(rows):
                path, at = rows["path"], rows["at"].to_numpy()
                other = pc.not_equal(path.slice(1), path.slice(0, len(path) - 1)).to_numpy()
                yield rows.filter(np.append(other | (at[1:] != at[:-1]), True))

    def _frame(self, vault: str, table: pa.Table, starts: np.ndarray, ends: np.ndarray) -> pd.DataFrame:
        at = table["at"].to_numpy()
        times = {n: pd.to_datetime(t[at], unit="us", utc=True) for n, t in (("start", starts), ("end", ends + self.gap))}
        return pd.DataFrame({"vault": vault, **times, "path": table["path"].to_pandas(), "change_type": table["change_type"].to_pandas()})

    def close(self) -> None:
        pass


_STORE = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def keep_state_in_rocksdb(spark: SparkSession) -> None:
    """``settled`` needs a state store with timers."""
    spark.conf.set(_STORE, _ROCKS)


def settled(changes: DataFrame, gap: str = GAP, watermark: str = "1 second") -> DataFrame:
    """A stream ``changes(ts, vault, path, change_type)`` -> ``(vault, start, end, path, change_type)`` of its closed batches.

    A batch closes when the watermark has passed its last event by the gap: any event of the vault counts, also of files that
    aren't indexed, but only notes and bases outside hidden folders are emitted. Late events are dropped.
    """
    keep_state_in_rocksdb(changes.sparkSession)
    rows = changes.withWatermark("ts", watermark).select(
        "vault", "ts", F.unix_micros("ts").alias("us"), F.when(is_indexable(F.col("path")), F.col("path")).alias("path"), "change_type"
    )
    gap_us = int(pd.Timedelta(gap).total_seconds() * 1_000_000)
    return rows.groupBy("vault").transformWithStateInPandas(Settling(gap_us), outputStructType=_SETTLED, outputMode="Append", timeMode="EventTime")


def log_changes(spark: SparkSession, folder: str, seen: DataFrame, log: str, vault: str = "vault") -> DataFrame:
    """Append what has changed in a folder since the listing ``seen(path, size, mtime)`` to a change log; the folder's listing now.

    Call it every so often with what it gave, written somewhere; ``spark.readStream`` over ``log`` (schema ``ts timestamp, vault string, path
    string, change_type string``) is the stream of changes. Nothing is read but names, sizes and times.
    """
    now = files.listing(spark, folder).where(~F.col("is_dir")).select("path", "size", "mtime")
    old = seen.select("path", F.col("size").alias("old_size"), F.col("mtime").alias("old_mtime"))
    kind = F.when(F.col("old_size").isNull(), "created").when(F.col("size").isNull(), "deleted").otherwise("modified")
    same = F.col("size").eqNullSafe(F.col("old_size")) & F.col("mtime").eqNullSafe(F.col("old_mtime"))
    moved = now.join(old, "path", "full").where(~same).select(F.current_timestamp().alias("ts"), F.lit(vault).alias("vault"), "path", kind.alias("change_type"))
    moved.write.mode("append").parquet(log)
    return now


def index_stream(stream: DataFrame, index, files, checkpoint: str, available_now: bool = True):
    """Start a query that brings ``index`` up to date with every micro-batch of ``stream(path, ...)``, without a pause.

    ``files()`` scans the notes as they are when the batch runs. Batches are checkpointed, so a
    change that arrives during indexing is handled by the next one.
    """

    def step(batch: DataFrame, _: int) -> None:
        changed = indexable(batch).where(F.col("path").endswith(".md")).select("path").distinct()
        if not changed.isEmpty():
            index.update(files(), only=changed)

    return _started(stream, step, checkpoint, available_now)


def watch(changes: DataFrame, update: Callable[[DataFrame], object], checkpoint: str, gap: str = GAP, watermark: str = "1 second", available_now: bool = False):
    """Start a query that calls ``update(paths)`` once for each closed batch of ``changes``, in the order of their starts.

    ``update`` is, say, ``lambda paths: index.update_folder(folder, only=paths)``. A batch holds the notes among its paths; those
    without one make no call. What a failed call was given is given again when the query is started anew.
    """

    def step(batch: DataFrame, _: int) -> None:
        notes = batch.where(F.col("path").endswith(".md")).persist()
        try:
            for r in notes.select("vault", "start").distinct().orderBy("start", "vault").collect():  # batches that closed since the last step
                update(notes.where((F.col("vault") == r["vault"]) & (F.col("start") == F.lit(r["start"]))).select("path"))
        finally:
            notes.unpersist()

    return _started(settled(changes, gap, watermark), step, checkpoint, available_now)


def _started(stream: DataFrame, step: Callable[[DataFrame, int], None], checkpoint: str, available_now: bool):
    writer = stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="500 milliseconds")).start()
