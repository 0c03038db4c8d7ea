"""Exact deduplication with a log-structured merge index of text digests."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import ascii_lower, materialize, shared_dir, text_of

#: Level-0 runs that trigger a compaction.
FAN_OUT = 4
#: Batches that a call to exact_duplicates hands to the index, each flushed as one run.
MEMTABLES = 4
#: Groups of copies whose digests are broadcast (under 100 bytes each).
BROADCAST_GROUPS = 500_000
#: Distinct digests a filter of a run file is sized for.
FILTER_DIGESTS = 20_000
_RUN = T.StructType(
    [
        T.StructField("digest", T.LongType()),
        T.StructField("n_bytes", T.LongType()),
        T.StructField("sha", T.BinaryType()),
        T.StructField("smallest", T.LongType()),
        T.StructField("largest", T.LongType()),
        T.StructField("members", T.LongType()),
    ]
)
_KEY = ["digest", "n_bytes", "sha"]


class DigestIndex:
    """Sorted digest runs in the shared folder, level by level.

    ``add`` turns a batch of rows into a level-0 run: each task pre-aggregates its rows (the
    memtable), the run is flushed sorted by digest, and every run file carries Parquet's Bloom
    filter on the digest, which lookups by digest use to skip files. FAN_OUT runs of a level
    compact into one of the next; compaction keeps the smallest and the largest identifier and
    adds up the members. Runs are never changed in place, so a lost executor costs a re-read.
    Null texts count as empty, null ids order first; rows that repeat an id are members of their own; an empty batch makes an empty run.
    """

    def __init__(self, spark: SparkSession, path: str | None = None):
        self.spark = spark
        self.path = path or f"{shared_dir(spark)}/notelake/lsm-{uuid.uuid4().hex}"
        self.levels: list[list[str]] = [[]]

    def _run(self, level: int) -> str:
        while len(self.levels) <= level:
            self.levels.append([])
        return f"{self.path}/level-{level}/run-{uuid.uuid4().hex}"

    @staticmethod
    def _writer(rows: DataFrame):
        return (
            rows.write.option("parquet.bloom.filter.enabled#digest", "true")
            .option("parquet.bloom.filter.expected.ndv#digest", str(FILTER_DIGESTS))
            .option("parquet.bloom.filter.adaptive.enabled", "true")
        )

    def add(self, entries: DataFrame, memtables: int = 1) -> None:
        """``entries(digest, n_bytes, sha, doc_id)``, one row a document, dealt to ``memtables``.

        One pass groups the rows of every memtable and flushes each as a run of its own.
        """
        table = F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(memtables)).cast("int").alias("memtable")
        grouped = entries.groupBy(table, *_KEY).agg(
            F.min("doc_id").alias("smallest"), F.max("doc_id").alias("largest"), F.count("*").alias("members")
        )
        run = self._run(0)
        self._writer(grouped.sortWithinPartitions("memtable", "digest")).partitionBy("memtable").parquet(run)
        written = self.spark.read.schema(T.StructType([*_RUN.fields, T.StructField("memtable", T.IntegerType())])).parquet(run)
        filled = sorted(r["memtable"] for r in written.select("memtable").distinct().collect())
        self.levels[0] += [f"{run}/memtable={k}" for k in filled]
        if len(self.levels[0]) >= FAN_OUT:
            self.compact(0)

    def compact(self, level: int) -> None:
        """Merge the runs of ``level`` into one run of the next level."""
        run = self._run(level + 1)
        self._writer(self._merged(self.levels[level]).sortWithinPartitions("digest")).parquet(run)
        self.levels[level] = []
        self.levels[level + 1].append(run)
        if len(self.levels[level + 1]) >= FAN_OUT:
            self.compact(level + 1)

    def _merged(self, runs: list[str]) -> DataFrame:
        rows = self.spark.read.schema(_RUN).parquet(*runs)
        return rows.groupBy(*_KEY).agg(
            F.min("smallest").alias("smallest"), F.max("largest").alias("largest"), F.sum("members").alias("members")
        )

    def entries(self) -> DataFrame:
        """All levels merged: one row a digest."""
        runs = [r for level in self.levels for r in level]
        if not runs:
            return self.spark.createDataFrame([], _RUN)
        if len(runs) == 1:
            return self.spark.read.schema(_RUN).parquet(*runs)
        return self._merged(runs)

    def lookup(self, digests: list[int]) -> DataFrame:
        """Entries of a few digests; the runs' filters skip files without them."""
        runs = [r for level in self.levels for r in level]
        if not runs or not digests:
            return self.spark.createDataFrame([], _RUN)
        rows = self.spark.read.schema(_RUN).parquet(*runs).where(F.col("digest").isin(digests))
        return rows.groupBy(*_KEY).agg(
            F.min("smallest").alias("smallest"), F.max("largest").alias("largest"), F.sum("members").alias("members")
        )


def digest_rows(docs: DataFrame) -> DataFrame:
    """``(doc_id, norm, digest, n_bytes, sha)`` of every row: A-Z lower-cased text and its digests."""
    norm = docs.select(docs["doc_id"].cast("long").alias("doc_id"), ascii_lower(text_of(docs)).alias("norm"))
    return norm.select(
        "doc_id",
        "norm",
        F.xxhash64("norm").alias("digest"),
        F.octet_length("norm").cast("long").alias("n_bytes"),
        F.unhex(F.sha2("norm", 256)).alias("sha"),
    )


def exact_duplicates(docs: DataFrame, keep: str = "largest", index: DigestIndex | None = None) -> DataFrame:
    """``(doc_id, keep_id, group_size, kept, text_sha256)``, one row for every row of ``docs``.

    Texts are equal when identical after lower-casing A-Z; ``keep`` names the identifier that
    stays, "largest" or "smallest". The index proposes groups by digest; every member of a group
    of two or more is then compared with its keeper byte for byte, and a difference (two texts
    that share a 64-bit hash, a length and a SHA-256) raises an error rather than give a wrong
    group. Null counts as the empty text; empty texts are equal to each other; of rows that
    repeat the keeper's doc_id all are marked kept; rows with a null doc_id belong to their
    group but never keep it unless it has no other; other columns are ignored and an empty table
    gives an empty result.
    """
    spark = docs.sparkSession
    index = index or DigestIndex(spark)
    rows = digest_rows(docs)
    flat = f"{index.path}/entries-{uuid.uuid4().hex}"
    rows.select("doc_id", *_KEY).write.parquet(flat)
    entry_schema = T.StructType([T.StructField("doc_id", T.LongType()), *_RUN.fields[:3]])
    entries = spark.read.schema(entry_schema).parquet(flat)
    index.add(entries, MEMTABLES)
    merged = index.entries().withColumnRenamed(keep, "keep_id").select(*_KEY, "keep_id", "members")
    if not materialize(_differing(rows, merged), "differing").isEmpty():
        raise ValueError("two texts share a digest, a length and a SHA-256")
    return entries.join(merged, _KEY).select(
        "doc_id",
        "keep_id",
        F.col("members").alias("group_size"),
        F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )


def _differing(rows: DataFrame, merged: DataFrame) -> DataFrame:
    """Members of groups of two or more whose bytes differ from their keeper's.

    Up to BROADCAST_GROUPS groups, their digests are broadcast so that only members' texts are
    shuffled; beyond, the same rows come from a shuffled join. Nothing after the join with the
    keepers needs a group's rows together, so adaptive execution may split a hot one.
    """
    groups = materialize(merged.where("members > 1").select(*_KEY, "keep_id"), "repeated")
    few = groups.select("digest").limit(BROADCAST_GROUPS + 1).count() <= BROADCAST_GROUPS
    near = rows.join(F.broadcast(groups), _KEY) if few else rows.join(groups, _KEY)
    hits = materialize(near.select(*_KEY, "doc_id", "keep_id", "norm"), "hits")
    first = hits.where("doc_id <=> keep_id").groupBy(*_KEY).agg(F.min("norm").alias("kept_norm"))
    keeper = materialize(first, "keepers")
    return hits.join(keeper.hint("merge"), _KEY).where("norm <> kept_norm").select(*_KEY, "doc_id")


def drop_duplicates(docs: DataFrame, keep: str = "largest") -> DataFrame:
    """The rows of ``docs`` that keep their group, with all columns; of repeated rows all stay.

    Rows are decided by doc_id and text: an id that carries several texts is judged text by text,
    and rows without an id stay where no row of their group has one.
    """
    found = exact_duplicates(docs, keep)
    heads = materialize(found.where("kept").select(F.col("doc_id").alias("kept_id"), F.unhex("text_sha256").alias("kept_sha")).distinct(), "kept")
    row = F.struct(*[docs[c] for c in docs.columns]).alias("row")
    sha = F.unhex(F.sha2(ascii_lower(text_of(docs)), 256))
    keyed = docs.select(docs["doc_id"].cast("long").alias("own_id"), sha.alias("own_sha"), row)
    same = keyed["own_id"].eqNullSafe(heads["kept_id"]) & (keyed["own_sha"] == heads["kept_sha"])
    return keyed.join(heads.hint("merge"), same, "left_semi").select("row.*")
