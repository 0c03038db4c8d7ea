"""A durable journal of changes to notes, shared by processes, with undo."""

from __future__ import annotations

import json
import time
from collections import deque
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import mutate

#: What an operation's row holds. In the log, an ``undo`` row has the numbers that it takes back in ``undone``, and an operation
#: the least number that was still kept after it in ``floor``: what has been pushed out doesn't come back with an undo.
COLUMNS = "seq bigint, timestamp double, message_id string, path string, action string, before_content string, after_content string"
_LOGGED = COLUMNS + ", undone array<bigint>, floor bigint"


class MemoryJournal:
    """The last operations of one process, for a vault that is a table."""

    def __init__(self, spark: SparkSession, keep: int = mutate.KEEP_OPERATIONS):
        self.spark, self.held, self.next = spark, deque(maxlen=keep), 1

    def record(self, message_id: str, path: str, action: str, before: str | None, after: str | None) -> int:
        self.held.append((self.next, time.time(), message_id, path, action, before, after))
        self.next += 1
        return self.next - 1

    @property
    def rows(self) -> DataFrame:
        return self.spark.createDataFrame(list(self.held), COLUMNS)

    def take_back(self, seqs: list[int]) -> None:
        self.held = deque((r for r in self.held if r[0] not in seqs), self.held.maxlen)

    def recent(self, n: int = 10) -> DataFrame:
        return mutate.retained(self.rows, n).orderBy("seq")

    def size(self) -> int:
        return len(self.held)


@dataclass
class Journal:
    """Operations as files of one row below ``root``, each under the next free number.

    A number is reserved by creating its claim, which fails where another process has it; the row is then written beside and renamed,
    so a reader sees whole rows. Taking back writes a row too. The rows are one scan of the folder, whatever their number; when
    it holds ``spare`` files beyond those kept, the kept operations are written as one file and the others deleted.
    """

    spark: SparkSession
    root: str
    keep: int = mutate.KEEP_OPERATIONS
    spare: int = 100

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")

    def _fs(self):
        return self._path("ops").getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _names(self, folder: str) -> list[str]:
        fs, where = self._fs(), self._path(folder)
        return sorted(n for f in fs.listStatus(where) if not (n := f.getPath().getName()).startswith(".")) if fs.exists(where) else []

    def _claim(self) -> int:
        number = max((int(n.split("-")[0].split(".")[0]) for n in self._names("claims") + self._names("ops")), default=0) + 1
        while not self._fs().createNewFile(self._path(f"claims/{number:015d}")):
            number += 1
        return number

    def _write(self, name: str, rows: list[dict]) -> None:
        part = self._path(f"ops/.{name}.part")
        stream = self._fs().create(part, True)
        try:
            stream.write(bytearray("".join(json.dumps(r) + "\n" for r in rows).encode()))
        finally:
            stream.close()
        if not self._fs().rename(part, self._path(f"ops/{name}")):
            raise OSError(f"cannot write operation {name}")

    def _append(self, row: dict) -> int:
        seq = self._claim()
        self._write(f"{seq:015d}.json", [{"seq": seq, "timestamp": time.time(), **row}])
        if len(self._names("ops")) > self.keep + self.spare:
            self.compact()
        return seq

    def record(self, message_id: str, path: str, action: str, before: str | None, after: str | None) -> int:
        """Append an operation; its number."""
        kept = [r[0] for r in self.rows.select("seq").orderBy(F.desc("seq")).collect()][: self.keep - 1]  # at most ``keep``
        floor = {"floor": min(kept)} if len(kept) == self.keep - 1 and kept else {}
        return self._append({"message_id": message_id, "path": path, "action": action, "before_content": before, "after_content": after, **floor})

    def take_back(self, seqs: list[int]) -> None:
        self._append({"action": "undo", "undone": seqs})

    @property
    def rows(self) -> DataFrame:
        """The last operations that aren't taken back, at most ``keep``."""
        if not self._names("ops"):
            return self.spark.createDataFrame([], COLUMNS)
        logged = self.spark.read.schema(_LOGGED).option("ignoreMissingFiles", "true").json(f"{self.root}/ops").where("seq is not null")
        gone = logged.select(F.explode("undone").alias("seq")).distinct()
        floor = logged.agg(F.coalesce(F.max("floor"), F.lit(0)).alias("least"))
        left = logged.where("action <> 'undo'").drop("undone", "floor").dropDuplicates(["seq"]).join(gone, "seq", "left_anti")
        return mutate.retained(left.join(F.broadcast(floor), F.col("seq") >= F.col("least")).drop("least"), self.keep)

    def compact(self) -> None:
        """Write the operations that are kept as one file, then delete the files that it stands for, and their claims but the last."""
        names = self._names("ops")
        last = max(int(n.split("-")[-1].split(".")[0]) for n in names)
        kept = [r.asDict() for r in self.rows.orderBy("seq").collect() if r["seq"] <= last]  # at most ``keep``
        kept = [r | {"floor": kept[0]["seq"]} for r in kept]
        self._write(f"{last:015d}-{last:015d}.json", kept)
        for n in names:
            if n != f"{last:015d}-{last:015d}.json":
                self._fs().delete(self._path(f"ops/{n}"), False)
        for n in self._names("claims"):
            if int(n) < last:
                self._fs().delete(self._path(f"claims/{n}"), False)

    def recent(self, n: int = 10) -> DataFrame:
        return mutate.retained(self.rows, n).orderBy("seq")

    def size(self) -> int:
        return self.rows.count()
