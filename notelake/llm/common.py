"""Helpers shared by the corpus operators: shared-folder tables and input normalisation."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def shared_dir(spark: SparkSession) -> str:
    """Folder that driver and executors share, named by ``spark.checkpoint.dir``.

    Where the setting is absent (tests on one machine) a temporary folder is chosen
    once and remembered in the session.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        root = spark.conf.get("notelake.shared.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="notelake-")
        spark.conf.set("notelake.shared.dir", root)
    return root.rstrip("/")


def materialize(df: DataFrame, name: str, options: dict[str, str] | None = None) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back.

    Cuts lineage so that a lost executor costs a re-read, not a recomputation.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/notelake/{name}-{uuid.uuid4().hex}"
    schema = T.StructType([T.StructField(f.name, f.dataType, True) for f in df.schema.fields])
    df.write.options(**(options or {})).parquet(path)
    return spark.read.schema(schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Delete the files of tables made by ``materialize`` that no later plan reads."""
    for df in tables:
        spark = df.sparkSession
        for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            where = spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


#: Most rows of an Arrow batch that carries whole texts.
BATCH_ROWS = 1_000


def small_batches(spark: SparkSession) -> None:
    """Hold the session's Arrow batches to BATCH_ROWS rows, so that a batch of whole texts stays small."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(key, "10000"))
    if now <= 0 or now > BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def released(batches: Iterator) -> Iterator:
    """``batches``; after the last, memory that allocators of this worker hold back is given up."""
    yield from batches
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # no glibc
        pass


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(df: DataFrame, column: str = "text") -> Column:
    """The text column with null counted as empty."""
    return F.coalesce(df[column].cast("string"), F.lit(""))


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z only; other letters stay.

    ``lower`` runs on bytes when a value has only ASCII; ``translate`` maps code points.
    """
    upper, low = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return F.when(F.length(c) == F.octet_length(c), F.lower(c)).otherwise(F.translate(c, upper, low))


#: Most groups of a sample, whose counts (one row each) every task holds.
MAX_GROUPS = 100_000


def hash_sample(ids: DataFrame, group: str, size: int) -> DataFrame:
    """At most ``size`` rows of each group of ``ids(doc_id, h, <group>)``: those of least hash ``h``.

    A group's count sets a threshold that about twice as many hashes pass, so that only those
    rows, however large the group, meet in one task to be ranked. Groups (languages, labels) are
    few: their counts are broadcast, so that no row moves before the threshold has applied; more than MAX_GROUPS raise
    ValueError.
    """
    counts = materialize(ids.groupBy(group).agg(F.count("*").alias("n")), "group_counts")
    if counts.limit(MAX_GROUPS + 1).count() > MAX_GROUPS:
        raise ValueError(f"more than {MAX_GROUPS} values of {group}")
    part = F.shiftrightunsigned("h", 11) / float(1 << 53)
    some = ids.join(F.broadcast(counts), group).where(part * F.col("n") < 2.0 * size + 50).drop("n")
    first = Window.partitionBy(group).orderBy(F.shiftrightunsigned("h", 1), "doc_id")
    return some.withColumn("r", F.row_number().over(first)).where(F.col("r") <= size).drop("r")
