"""Maintenance of the chunk, fact and metadata tables."""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.tokens import TokenCounter
from ..sources import files as listed
from ..sources import providers, vault
from .chunking import chunks

MIN_BODY = 10
TABLES = {
    "chunks": "chunk_id string, source_path string, note_title string, section_header string, chunk_type string, chunk_index int, "
    "tags array<string>, links array<string>, content string, content_hash string, embedding array<float>",
    "facts": "fact_id string, path string, title string, entity string, key string, value string, context string, place int",
    "meta": "path string, mtime double, size bigint, content_hash string",
}
#: Of each table, the column that names a row's note.
NOTE = {"chunks": "source_path", "facts": "path", "meta": "path"}


def changes(files: DataFrame, meta: DataFrame) -> DataFrame:
    """``files(path, content, mtime, size)`` against ``meta``: a row per path of either, with ``state``.

    ``unchanged`` (same time and size), ``touched`` (same content), ``new``, ``modified`` or ``removed``.
    """
    now = files.select("path", "mtime", "size", X.content_hash(F.col("content")).alias("content_hash"))
    rows = compared(now, meta)
    return rows.select("path", "mtime", "size", "content_hash", "old_hash", _state(F.col("state")).alias("state"))


def compared(listing: DataFrame, meta: DataFrame) -> DataFrame:
    """``listing(path, mtime, size, ...)`` against ``meta`` without any content: ``unchanged``, ``removed``, or ``differs``."""
    old = meta.select("path", F.col("mtime").alias("old_mtime"), F.col("size").alias("old_size"), F.col("content_hash").alias("old_hash"))
    same = (F.col("mtime") == F.col("old_mtime")) & (F.col("size") == F.col("old_size"))
    state = F.when(F.col("size").isNull(), "removed").when(F.coalesce(same, F.lit(False)), "unchanged").otherwise("differs")
    return listing.join(old, "path", "full").withColumn("state", state).drop("old_mtime", "old_size")


def _state(state: Column) -> Column:
    """The state of a row whose content is known where it differs."""
    return (
        F.when(state != "differs", state)
        .when(F.col("old_hash").isNull(), "new")
        .when(F.col("content_hash") == F.col("old_hash"), "touched")
        .otherwise("modified")
    )


def long_enough(notes: DataFrame, least: int = MIN_BODY) -> DataFrame:
    return notes.where(F.length(X.strip(F.col("body"))) >= least)


def without(table: DataFrame, paths: DataFrame, column: str = "path") -> DataFrame:
    """Rows of ``table`` whose note is not among ``paths``."""
    return table.join(paths.select(F.col("path").alias(column)), column, "left_anti")


def stats(found: DataFrame) -> DataFrame:
    """One row of counts; a removed note counts as indexed."""
    state = F.col("state")
    return found.agg(
        F.count_if(state.isin("new", "modified", "removed")).alias("indexed"),
        F.count_if(state.isin("unchanged", "touched")).alias("skipped"),
        F.count_if(state == "removed").alias("removed"),
    )


#: Notes of a part; when there are more on average, parts are cut in two.
NOTES_PER_PART = 4096
#: Bits of a row's slot; a part is a span of slots.
SLOT_BITS = 30
#: Spans of slots that a scan is given as a condition; more are joined.
SPANS = 64
#: Seconds for which files that no current manifest names are kept for readers that began before, and for runs under way.
RETAIN = 7 * 24 * 3600


def _nothing() -> dict:
    return {"bits": 0, "notes": 0, "tables": {n: {"folders": [], "wrote": [], "current": [[-1, 1 << SLOT_BITS]]} for n in TABLES}}


def _slot(column: str) -> Column:
    return F.shiftrightunsigned(F.xxhash64(column), 64 - SLOT_BITS).cast("int")


def _owners(table: dict, bits: int) -> np.ndarray:
    """For each part the place of the folder that is current for it, or -1."""
    place, slots = np.array(table["current"], np.int64).T
    return np.repeat(place, slots >> (SLOT_BITS - bits))


def _slots(parts: np.ndarray, bits: int) -> int:
    return int(parts.sum()) << (SLOT_BITS - bits)


@dataclass
class Index:
    """Chunk, fact and metadata tables in Parquet below ``root``, cut into parts by the first bits of a hash of the path.

    A run writes one folder a table, with the rows of all parts that it touches, in as many files as their bytes ask for and sorted
    by ``slot``, the hash's first bits; the rows that those parts have in earlier folders aren't current any more. A manifest names each
    table's folders and the one that is current for each part. It is written last, under the next number, whose creation
    fails if another run has made it meanwhile; readers take the manifest with the highest number. So a failed run leaves the
    tables as they were, and a new process finds them again. When parts grow beyond ``notes_per_part`` notes, the number of
    bits grows, and no row moves. A run takes over the rest of a folder that is current for no more parts than it writes, or for less
    than half of what was written: so a table has few folders, however many runs and parts, and at least half of what it holds is
    current. ``vacuum`` deletes folders that are no longer named.

    ``embedder`` and ``chat`` are the model services (offline ones by default); without ``facts`` none are extracted; a
    ``counter`` counts tokens with a tokenizer.
    """

    spark: SparkSession
    root: str
    max_tokens: int = 1500
    notes_per_part: int = NOTES_PER_PART
    embedder: providers.Embedder | None = None
    chat: providers.Chat | None = None
    facts: bool = True
    counter: TokenCounter | None = None
    counted: dict[str, int] = field(default_factory=dict)

    # files and manifests
    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def _files(self):
        return self._path("").getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _names(self, folder: str) -> list[tuple[str, float]]:
        """Names and times of what lies in a folder; none if it is gone."""
        fs, where = self._files(), self._path(folder)
        return [(f.getPath().getName(), f.getModificationTime() / 1000) for f in fs.listStatus(where)] if fs.exists(where) else []

    def _numbers(self) -> dict[int, float]:
        return {int(n[:-5]): t for n, t in self._names("manifests") if n.endswith(".json") and not n.startswith(".")}

    def manifest(self, number: int | None = None) -> tuple[int, dict]:
        """Number and content of the newest manifest; 0 and none at first.

        ``{"bits", "notes", "tables": {table: {"folders", "wrote", "current"}}}``: folders, the slots that each was written for, and
        ``[place of a folder, slots]`` one after the other.
        """
        number = max(self._numbers(), default=0) if number is None else number
        if not number:
            return 0, _nothing()
        stream = self._files().open(self._path(f"manifests/{number}.json"))
        try:
            return number, json.loads(bytes(self.spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode())
        finally:
            stream.close()

    def _publish(self, number: int, held: dict) -> None:
        part = self._path(f"manifests/.{uuid.uuid4().hex}")
        stream = self._files().create(part, True)
        try:
            stream.write(bytearray(json.dumps(held).encode()))
        finally:
            stream.close()
        where = self._path(f"manifests/{number}.json")
        if self._files().exists(where) or not self._files().rename(part, where):
            self._files().delete(part, False)
            raise RuntimeError("another run has changed the index meanwhile; run again")

    # reading
    def table(self, name: str) -> DataFrame:
        """A table as the newest manifest has it."""
        return self._read(name, self.manifest()[1])

    def _read(self, name: str, held: dict, taken: np.ndarray | None = None) -> DataFrame:
        """The current rows of a table; with ``taken``, of those parts alone."""
        table, bits = held["tables"][name], held["bits"]
        owner, read = _owners(table, bits), self.spark.read.schema(f"{TABLES[name]}, slot int")
        whole, some = [], []
        for i, folder in enumerate(table["folders"]):
            parts = owner == i if taken is None else (owner == i) & taken
            if _slots(parts, bits) == table["wrote"][i]:
                whole.append(f"{self.root}/{folder}")
            elif parts.any():
                some.append(self._of_parts(read.parquet(f"{self.root}/{folder}"), parts, bits))
        found = ([read.parquet(*whole)] if whole else []) + some
        if not found:
            return self.spark.createDataFrame([], TABLES[name])
        return reduce(DataFrame.unionByName, found).drop("slot")

    def _of_parts(self, rows: DataFrame, parts: np.ndarray, bits: int) -> DataFrame:
        """Rows of the marked parts: few spans of slots skip pages of the files, many are a join."""
        ends = np.flatnonzero(np.diff(parts.astype(np.int8), prepend=0, append=0)).reshape(-1, 2) << (SLOT_BITS - bits)
        if len(ends) <= SPANS:
            return rows.where(reduce(Column.__or__, [F.col("slot").between(a, b - 1) for a, b in ends.tolist()]))
        marked = self.spark.createDataFrame(pa.table({"part": np.flatnonzero(parts)}))
        return rows.withColumn("part", F.shiftright("slot", SLOT_BITS - bits).cast("long")).join(F.broadcast(marked), "part", "left_semi").drop("part")

    def counts(self) -> DataFrame:
        """One row ``(notes, chunks, facts)``: rows of the tables."""
        n = lambda name: self.table(name).agg(F.count("*").alias(name))
        return n("meta").withColumnRenamed("meta", "notes").join(n("chunks")).join(n("facts"))

    # writing
    def wipe(self) -> None:
        self._publish(self.manifest()[0] + 1, _nothing())

    def update(self, files: DataFrame, only: DataFrame | None = None) -> DataFrame:
        """Bring the tables up to a table ``files(path, content, mtime, size)``; with ``only(path)``, those paths alone, whatever their times.

        Times and sizes are compared first; contents are read, hashed and parsed only of notes that differ. Returns one row of
        counts, see ``report``.
        """

        def read(rows: DataFrame, differ: DataFrame) -> DataFrame:
            found = files.select("path", "content").join(differ.select("path"), "path", "left_semi")
            return rows.join(found, "path", "left").withColumn("problem", F.lit(None).cast("string"))

        listing = files.select("path", "mtime", "size")
        return self._run(listing if only is None else listing.join(only.select("path").distinct(), "path", "left_semi"), read, only)

    def update_folder(self, folder: str, only: DataFrame | None = None) -> DataFrame:
        """Bring the tables up to the notes of a folder; with ``only(path)``, those paths alone: then nothing else is listed.

        Files are listed without their content, and those opened whose time or size differs.
        """
        if only is None:
            listing = listed.with_suffix(listed.listing(self.spark, folder), ".md")
        else:
            listing = listed.stats_of(only.where(F.col("path").endswith(".md")), folder)
        return self._run(listing, lambda rows, _: listed.contents(rows, folder, F.col("state") == "differs"), only)

    def _run(self, listing: DataFrame, read: Callable[[DataFrame, DataFrame], DataFrame], only: DataFrame | None) -> DataFrame:
        number, held = self.manifest()
        run = f"run-{number + 1}-{uuid.uuid4().hex}"
        meta = self._read("meta", held)
        if only is not None:
            meta = meta.join(only.select("path").distinct(), "path", "left_semi")
        rows = compared(listing, meta)
        if only is not None:
            rows = rows.withColumn("state", F.when(F.col("state") == "unchanged", "differs").otherwise(F.col("state")))
        moved = self._moved(rows, read, run, only is not None)
        if not self.counted.pop("moved"):
            return self.report()
        made = self._made(vault.detailed(moved.where("state in ('new', 'modified') and not short")), run)
        moved = moved.select("path", "mtime", "size", "content_hash", "state")
        failed = made["chunks"].where("embedding is null").select(F.col("source_path").alias("path")).distinct()
        if lost := failed.count():  # notes without a vector stay as they were, and are tried again
            moved, made = without(moved, failed), {n: without(t, failed, NOTE[n]) for n, t in made.items()}
            self.counted |= {"errors": self.counted["errors"] + lost, "indexed": self.counted["indexed"] - lost} | {n: t.count() for n, t in made.items()}
        made["meta"] = moved.where("state <> 'removed'").select("path", "mtime", "size", "content_hash")
        stale = moved.where("state <> 'touched'")
        held["notes"] += self.counted.pop("new") - self.counted["removed"]
        held["bits"] = min(SLOT_BITS, max(held["bits"], (max(1, held["notes"]) // self.notes_per_part).bit_length()))
        all_parts, stale_parts = self._touched(moved, held["bits"])
        tables = {
            n: self._merged(n, moved, all_parts, new, held, run) if n == "meta" else self._merged(n, stale, stale_parts, new, held, run) for n, new in made.items()
        }
        self._publish(number + 1, held | {"tables": tables})
        return self.report()

    def _moved(self, rows: DataFrame, read: Callable[[DataFrame, DataFrame], DataFrame], run: str, forced: bool) -> DataFrame:
        """A table of the notes that differ, parsed where they are new or modified, counted as it is written.

        Unchanged notes are counted and left out; notes that can't be read are counted as errors and stay as they were.
        """
        scanned, wrote = Observation(f"scan-{run}"), Observation(f"notes-{run}")
        differ = rows.where("state <> 'unchanged'")
        seen = rows.observe(scanned, F.count_if(F.col("state") == "unchanged").alias("n")).where("state <> 'unchanged'")
        known = read(seen, differ.where("state = 'differs'"))
        known = known.withColumn("content_hash", F.when(F.col("content").isNotNull(), X.content_hash(F.col("content"))))
        state = F.when((_state(F.col("state")) == "touched") & F.lit(forced), "modified").otherwise(_state(F.col("state")))
        named = known.select("path", "mtime", "size", "problem", "content_hash", state.alias("state"), "content")
        fresh = F.col("state").isin("new", "modified")
        headed = vault.headed(named.withColumn("content", F.when(fresh, F.col("content"))))
        bad = F.coalesce("problem", F.when(fresh, F.col("bad")))
        table = headed.select(
            "path", "mtime", "size", "content_hash", "content", "title", "body", "fm", bad.alias("problem"),
            F.coalesce(F.length(X.strip(F.col("body"))) < MIN_BODY, F.lit(False)).alias("short"),
            F.when(bad.isNotNull(), "failed").otherwise(F.col("state")).alias("state"),
        )
        count = lambda test, name: F.count_if(F.expr(test)).alias(name)
        written = table.observe(
            wrote, count("state = 'removed' or state in ('new', 'modified') and not short", "indexed"),
            count("state = 'touched' or state in ('new', 'modified') and short", "skipped"), count("state = 'removed'", "removed"),
            count("state = 'new'", "new"), count("state = 'failed'", "errors"), count("state <> 'failed'", "moved"),
        )
        written.write.parquet(f"{self.root}/{run}/notes")
        self.counted = {"chunks": 0, "facts": 0, **wrote.get}
        self.counted["skipped"] += scanned.get["n"]
        return self.spark.read.schema(table.schema).parquet(f"{self.root}/{run}/notes").where("state <> 'failed'")

    def _made(self, notes: DataFrame, run: str) -> dict[str, DataFrame]:
        """Chunks with their vectors, and facts, of the notes of this run, written once."""
        columns = {n: [c.split()[0] for c in TABLES[n].split(", ")] for n in TABLES}
        new = {"chunks": providers.embedded(chunks(notes, self.max_tokens, counter=self.counter), self.embedder).select(*columns["chunks"])}
        if not self.facts:
            new["facts"] = self.spark.createDataFrame([], TABLES["facts"])
        elif self.chat is None:
            new["facts"] = providers.extract_facts(notes)
        else:
            new["facts"] = providers.model_facts(notes, self.chat).where("problem is null").select(*columns["facts"])
        out = {}
        for name, rows in new.items():
            wrote = Observation(f"{name}-{run}")
            rows.observe(wrote, F.count("*").alias("n")).write.parquet(f"{self.root}/{run}/new-{name}")
            self.counted[name] = wrote.get["n"]
            out[name] = self.spark.read.schema(TABLES[name]).parquet(f"{self.root}/{run}/new-{name}")
        return out

    @staticmethod
    def _touched(moved: DataFrame, bits: int) -> tuple[np.ndarray, np.ndarray]:
        """For each part, whether a note of it is in ``moved``, and whether one is that isn't merely touched.

        As many numbers as the run touches parts reach the driver, which keeps the manifest.
        """
        part = F.shiftright(_slot("path"), SLOT_BITS - bits)
        found = moved.groupBy(part.alias("part")).agg(F.bool_or(F.col("state") != "touched").alias("stale")).toArrow()
        both = np.zeros((2, 1 << bits), bool)
        both[0, found["part"].to_numpy()] = True
        both[1, found["part"].to_numpy()] = found["stale"].to_numpy()
        return both[0], both[1]

    def _merged(self, name: str, stale: DataFrame, touched: np.ndarray, new: DataFrame, held: dict, run: str) -> dict:
        """A table's entry in the manifest after this run; only parts with a stale or new note, and those taken over, are read and written."""
        table, bits = held["tables"][name], held["bits"]
        if not touched.any():
            return table
        owner, wrote = _owners(table, bits), np.array(table["wrote"], np.int64) >> (SLOT_BITS - bits)
        taken = touched | (owner < 0)
        while True:
            rest = np.bincount(owner[~taken], minlength=len(wrote))
            over = (rest > 0) & ((rest <= taken.sum()) | (2 * rest < wrote))
            if not over.any():
                break
            taken |= over[owner]
        rows = without(self._read(name, held, taken), stale, NOTE[name]).unionByName(new)
        rows.withColumn("slot", _slot(NOTE[name])).repartition("slot").sortWithinPartitions("slot", NOTE[name]).write.parquet(f"{self.root}/{run}/{name}")
        left = np.flatnonzero(rest)
        place = np.full(len(wrote) + 1, len(left))
        place[left] = np.arange(len(left))
        owner = np.where(taken, len(left), place[owner])
        first = np.flatnonzero(np.diff(owner, prepend=-1))
        spans = np.diff(first, append=len(owner)) << (SLOT_BITS - bits)
        return {
            "folders": [table["folders"][i] for i in left] + [f"{run}/{name}"],
            "wrote": [table["wrote"][i] for i in left] + [_slots(taken, bits)],
            "current": np.stack([owner[first], spans], 1).tolist(),
        }

    def report(self) -> DataFrame:
        """One row of the last run's counts: ``(indexed, skipped, removed, chunks, facts, errors)``.

        A removed note counts as indexed; notes with too short a body count as skipped, and lose what they had. Errors are notes that
        can't be read, whose header is malformed, or that got no vector: they stay as they were and are tried again.
        """
        names = ("indexed", "skipped", "removed", "chunks", "facts", "errors")
        return self.spark.createDataFrame([tuple(self.counted[n] for n in names)], ", ".join(f"{n} long" for n in names))

    def vacuum(self, retain: float = RETAIN, versions: int = 2) -> int:
        """Delete folders that neither the last ``versions`` manifests nor any younger than ``retain`` seconds name; how many went.

        A reader that took its manifest within that time keeps its files. Runs under way write to folders that are newer than
        any manifest, or younger than ``retain``: these stay.
        """
        numbers, now, fs = self._numbers(), time.time(), self._files()
        kept = set(sorted(numbers)[-versions:]) | {n for n, t in numbers.items() if now - t < retain}
        named = {f for n in kept for table in self.manifest(n)[1]["tables"].values() for f in table["folders"]}
        gone = 0
        for run, made in self._names(""):
            if not run.startswith("run-") or (int(run.split("-")[1]) > max(numbers, default=0) and now - made < max(retain, 3600)) or now - made < retain:
                continue
            inner = [f"{run}/{t}" for t, _ in self._names(run)]
            spare = [f for f in inner if f not in named] if any(f in named for f in inner) else [run]
            gone += sum(fs.delete(self._path(f), True) for f in spare)
        for n in set(numbers) - kept:
            fs.delete(self._path(f"manifests/{n}.json"), False)
        return gone
