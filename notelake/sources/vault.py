"""Note folders as DataFrames: scans, listings, trees and the parsed-note projection."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions import yaml_header as Y
from . import files


def scan(spark: SparkSession, root: str, suffix: str = ".md") -> DataFrame:
    """``(path, content, mtime, size)`` of the files below ``root``; hidden paths, and files that are no UTF-8 text, are left out."""
    found = files.contents(files.with_suffix(files.listing(spark, root), suffix), root)
    return found.where("problem is null").select("path", "content", "mtime", "size")


def bodies(notes: DataFrame) -> DataFrame:
    """``notes(path, content, ...)`` with title, frontmatter block and body; no property is parsed."""
    fenced = notes.select("*", F.explode(F.array(X.fence(F.col("content")))).alias("fence"))
    front, body = X.split_note(F.col("content"), F.col("fence"))
    return fenced.withColumns({"title": X.stem(F.col("path")), "front": front, "body": body}).drop("fence")


def headed(notes: DataFrame, flat: bool = False) -> DataFrame:
    """``bodies`` with frontmatter entries ``fm`` and the ``problem`` of a header that can't be read.

    Flat headers (keys with plain values and lists of them) are read JVM-side; with ``flat`` all of them are known to
    be. The rest go to a YAML parser, without their bodies. The search for the fence and this parsing sit in one-row
    generators: the optimizer can't copy them into every predicate and column that reads them, so they
    run once a note. What only reads properties never cuts a body.
    """
    front = F.col("front")
    if flat:
        return bodies(notes).select("*", F.explode(F.array(X.entries(front))).alias("fm"), F.lit(None).cast("string").alias("bad")).drop("front")
    marked = bodies(notes).select("*", F.explode(F.array(Y.flat(front))).alias("is_flat"))
    read = marked.withColumn("read", Y.whole(F.when(~F.col("is_flat"), front)))
    entries = F.when(F.col("read").isNull(), X.entries(front)).otherwise(F.coalesce("read.entries", F.array().cast(X.ENTRIES)))
    return read.select("*", F.explode(F.array(entries)).alias("fm"), F.col("read.problem").alias("bad")).drop("front", "is_flat", "read")


def detailed(read: DataFrame) -> DataFrame:
    """``headed`` notes with tags, links, headers and line count."""
    return read.withColumns(
        {
            "tags": X.tags(F.col("fm"), F.col("body")),
            "wikilinks": X.wikilinks(F.col("body")),
            "headers": X.headers(F.col("content"), F.col("body")),
            "line_count": X.line_count(F.col("content")),
        }
    )


def parse(notes: DataFrame, flat: bool = False) -> DataFrame:
    """``notes(path, content, ...)`` with title, body, frontmatter entries, tags, links, headers and line count.

    Notes whose header can't be read are left out.
    """
    read = headed(notes, flat)
    return detailed((read if flat else read.where("bad is null")).drop("bad"))


def paths(notes: DataFrame) -> DataFrame:
    """All paths, in order."""
    return notes.select("path").orderBy("path")


def safe_path(path: str) -> str:
    """A relative path that stays below its root, or ValueError."""
    parts: list[str] = []
    if path.startswith("/"):
        raise ValueError(f"path escapes the vault: {path}")
    for part in path.split("/"):
        if part == "..":
            if not parts:
                raise ValueError(f"path escapes the vault: {path}")
            parts.pop()
        elif part not in ("", "."):
            parts.append(part)
    return "/".join(parts)


def read_one(notes: DataFrame, path: str) -> DataFrame:
    """The parsed note at ``path``; FileNotFoundError without one, ValueError for another suffix."""
    where = safe_path(path)
    if not where.endswith(".md"):
        raise ValueError(f"not a note: {path}")
    found = parse(notes.where(F.col("path") == where))
    if found.isEmpty():
        raise FileNotFoundError(path)
    return found


def read_file(spark: SparkSession, root: str, path: str) -> DataFrame:
    """``read_one`` of a folder's note: only that file is opened."""
    one = spark.createDataFrame([(safe_path(path),)], "path string")
    found = files.contents(files.stats_of(one, root), root)
    return read_one(found.where("problem is null").select("path", "content", "mtime", "size"), path)


def exists(notes: DataFrame, path: str) -> bool:
    return present(notes, notes.sparkSession.createDataFrame([(path,)], "path string")).first()["present"]


def present(notes: DataFrame, asked: DataFrame) -> DataFrame:
    """``asked(path)`` with ``present``: whether it names a file or folder of ``notes(path, ...)``; false for paths that leave the root.

    One join with all paths and the folders above them, however many are asked for.
    """
    parts = F.split(F.col("path"), "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))
    known = notes.select(F.explode(above).alias("where")).distinct()
    plan = F.aggregate(
        F.filter(parts, lambda p: (p != "") & (p != ".")), F.array().cast("array<string>"),
        lambda a, p: F.when(p != "..", F.concat(a, F.array(p))).when(F.size(a) > 0, F.slice(a, F.lit(1), F.size(a) - 1)),
    )
    where = F.when(~F.startswith("path", F.lit("/")), F.array_join(plan, "/"))
    rows = asked.select("path", where.alias("where"))
    found = rows.join(known.withColumn("found", F.lit(True)), "where", "left")
    return found.select("path", F.coalesce(F.col("found") | (F.col("where") == ""), F.lit(False)).alias("present"))


def read_raw(spark: SparkSession, root: str, path: str) -> str:
    """The text of any file below ``root``; FileNotFoundError without one."""
    where = _jvm_path(spark, root, safe_path(path))
    fs = where.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(where) or fs.getFileStatus(where).isDirectory():
        raise FileNotFoundError(path)
    stream = fs.open(where)
    try:
        return bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode("utf-8", "replace")
    finally:
        stream.close()


def _jvm_path(spark: SparkSession, root: str, path: str):
    return spark._jvm.org.apache.hadoop.fs.Path(root, path)


def write_raw(spark: SparkSession, root: str, path: str, content: str) -> None:
    """Write one file below ``root``, through a hidden neighbour that is then renamed, so readers see the old or the new text."""
    where = _jvm_path(spark, root, safe_path(path))
    fs, part = where.getFileSystem(spark._jsc.hadoopConfiguration()), _jvm_path(spark, str(where.getParent()), f".{where.getName()}.{uuid.uuid4().hex}")
    stream = fs.create(part, True)
    try:
        stream.write(bytearray(content.encode()))
    finally:
        stream.close()
    fs.delete(where, False)
    if not fs.rename(part, where):
        raise OSError(f"cannot write {path}")


def remove_raw(spark: SparkSession, root: str, path: str) -> None:
    where = _jvm_path(spark, root, safe_path(path))
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, False)


def write_notes(notes: DataFrame, root: str) -> DataFrame:
    """Write every row of ``notes(path, content)`` as a file below ``root``; ``(path, size)`` of each, once read.

    Every task writes its own rows where they are, through hidden neighbours that are then
    renamed: a repeated task writes the same files again. ``root`` is a folder or a URI that all executors
    reach. A path that leaves the root raises ValueError.
    """

    def written(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = files.store_of(root)
        made: set[str] = set()
        for batch in batches:
            sizes = []
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                where, raw = f"{base}/{safe_path(path)}", (content or "").encode()
                folder, name = where.rsplit("/", 1)
                if folder not in made:
                    store.create_dir(folder, recursive=True)
                    made.add(folder)
                part = f"{folder}/.{name}.{uuid.uuid4().hex}"
                with store.open_output_stream(part) as out:
                    out.write(raw)
                store.move(part, where)
                sizes.append(len(raw))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64())], names=["path", "size"])

    return notes.select("path", "content").mapInArrow(written, "path string, size long")


def remove_notes(paths: DataFrame, root: str) -> DataFrame:
    """Delete the files ``paths(path)`` below ``root``; ``(path, removed)`` of each, once read. A file that is gone is no error."""

    def removed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, base = files.store_of(root)
        for batch in batches:
            there = []
            for path in batch.column(0).to_pylist():
                where = f"{base}/{safe_path(path)}"
                there.append(store.get_file_info(where).type == fs.FileType.File)
                if there[-1]:
                    store.delete_file(where)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(there, pa.bool_())], names=["path", "removed"])

    return paths.select("path").mapInArrow(removed, "path string, removed boolean")


def _inside(listed: DataFrame, base: str) -> DataFrame:
    """Rows below a folder, hidden ones left out; a table of notes holds no folders."""
    rows = listed if "is_dir" in listed.columns else listed.withColumn("is_dir", F.lit(False))
    rows = rows if "size" in rows.columns else rows.withColumn("size", F.lit(0).cast("long"))
    return rows.where(F.col("path").startswith(base + "/" if base else "") & ~X.hidden(F.col("path")))


def _need_folder(listed: DataFrame, base: str, path: str) -> None:
    """NotADirectoryError for a path that is no folder, or that no row lies in."""
    if base:
        known = F.col("path").startswith(base + "/")
        known = known | ((F.col("path") == base) & F.col("is_dir")) if "is_dir" in listed.columns else known
        if listed.where(known).isEmpty():
            raise NotADirectoryError(path)


def list_dir(listed: DataFrame, path: str = "") -> DataFrame:
    """``(name, path, is_dir, size, extension)`` of what lies directly in ``path``; folders have size 0.

    ``listed`` holds files, and folders where it has ``is_dir``. What is no folder raises NotADirectoryError.
    """
    base = safe_path(path)
    prefix = base + "/" if base else ""
    _need_folder(listed, base, path)
    rest = F.substring(F.col("path"), F.lit(len(prefix) + 1), F.length("path"))
    rows = _inside(listed, base).select(
        F.element_at(F.split(rest, "/"), 1).alias("name"), (F.col("is_dir") | (F.instr(rest, "/") > 0)).alias("is_dir"), "size"
    )
    return (
        rows.groupBy("name", "is_dir")
        .agg(F.max("size").alias("size"))
        .select(
            "name",
            F.concat(F.lit(prefix), F.col("name")).alias("path"),
            "is_dir",
            F.when(F.col("is_dir"), F.lit(0)).otherwise(F.col("size")).cast("long").alias("size"),
            F.when(F.col("is_dir"), F.lit("")).otherwise(X.extension(F.col("name"))).alias("extension"),
        )
        .orderBy("name")
    )


def tree(listed: DataFrame, path: str = "", depth: int = 3) -> DataFrame:
    """``(path, depth, parent, type, n_files)`` of folders and files down to ``depth`` levels below ``path``, empty folders too.

    What is no folder raises NotADirectoryError.
    """
    base = safe_path(path)
    prefix = base + "/" if base else ""
    _need_folder(listed, base, path)
    parts = F.split(F.substring(F.col("path"), F.lit(len(prefix) + 1), F.length("path")), "/")
    levels = _inside(listed, base).select("is_dir", parts.alias("parts"), F.explode(F.sequence(F.lit(1), F.least(F.lit(depth), F.size(parts)))).alias("depth"))
    rows = levels.select(
        F.concat(F.lit(prefix), F.array_join(F.slice("parts", 1, F.col("depth")), "/")).alias("path"),
        "depth",
        F.concat(F.lit(prefix), F.array_join(F.slice("parts", F.lit(1), F.col("depth") - 1), "/")).alias("parent"),
        F.when(F.col("is_dir") | (F.col("depth") < F.size("parts")), F.lit("directory")).otherwise(F.lit("file")).alias("type"),
        "is_dir",
    )
    return rows.groupBy("path", "depth", "parent", "type").agg(F.count_if(~F.col("is_dir")).alias("n_files")).orderBy("path")


def spread(rows: DataFrame) -> DataFrame:
    """``rows`` over all cores where the input has fewer parts than that; a larger input stays where it lies."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(cores) if rows.rdd.getNumPartitions() < cores else rows


def derived_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(path, content)`` notes made from the documents and labels tables."""
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    docs = spread(read("documents").select("doc_id", "lang", "source", "text")).join(read("labels").select("doc_id", "quality"), "doc_id", "left")
    total = read("documents").agg(F.count("*").alias("n"))
    n = F.col("n")
    quality = F.coalesce(F.concat(F.lit("quality: q"), F.col("quality").cast("string"), F.lit("\n")), F.lit(""))
    link = lambda c: F.concat(F.lit("[[doc_"), c.cast("string"))
    content = F.concat(
        F.lit("---\nlang: "), F.col("lang"), F.lit("\nsource: "), F.col("source"), F.lit("\n"), quality, F.lit("---\n\n# Doc "),
        F.col("doc_id").cast("string"), F.lit("\n\n"), F.col("text"), F.lit("\n\n## Links\n\n#"), F.col("lang"), F.lit(" "),
        link((F.col("doc_id") * 7 + 1) % n), F.lit("]] "), link((F.col("doc_id") * 3) % n), F.lit("|alias]]\n"),
    )
    path = F.concat(F.col("source"), F.lit("/doc_"), F.col("doc_id").cast("string"), F.lit(".md"))
    return docs.crossJoin(F.broadcast(total)).select(path.alias("path"), content.alias("content"), "doc_id")
