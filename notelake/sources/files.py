"""Files and folders below a root as rows: listed without their content, and read only where asked.

Spark's own file sources leave out empty files, empty folders and names that start with an underscore,
so listing is a data source of its own, and reading takes the paths to read from a column.
"""

from __future__ import annotations

import posixpath
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

LISTED = "path string, is_dir boolean, size long, mtime double"
_SCHEMA = pa.schema([("path", pa.string()), ("is_dir", pa.bool_()), ("size", pa.int64()), ("mtime", pa.float64())])
#: Folders that the driver opens until there are this many to deal out.
FOLDERS = 256
BATCH_ROWS, BATCH_BYTES = 10_000, 8_000_000


def store_of(root: str):
    """The file system of a folder or URI, and the folder in it."""
    from pyarrow import fs

    if "://" not in root and not root.startswith("file:"):
        return fs.LocalFileSystem(), posixpath.normpath(root)
    if root.startswith("file:"):
        return fs.LocalFileSystem(), posixpath.normpath("/" + root[5:].lstrip("/"))
    scheme, rest = root.split("://", 1)
    return fs.FileSystem.from_uri(f"{ {'s3a': 's3', 's3n': 's3'}.get(scheme, scheme)}://{rest.rstrip('/')}")


def entries(store, base: str, folder: str, named: frozenset[str] = frozenset()) -> list:
    """What lies directly in ``folder`` below ``base``, as ``(relative path, info)``; hidden names are left out, but for ``named`` ones."""
    from pyarrow import fs

    where = f"{base}/{folder}" if folder else base
    found = store.get_file_info(fs.FileSelector(where))
    return [(f"{folder}/{i.base_name}" if folder else i.base_name, i) for i in found if not i.base_name.startswith(".") or i.base_name in named]


def _row(path: str, info) -> tuple:
    from pyarrow import fs

    folder = info.type == fs.FileType.Directory
    return path, folder, 0 if folder else info.size, None if info.mtime_ns is None else info.mtime_ns / 1e9


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _SCHEMA, strict=True)], schema=_SCHEMA)


class _Folders(InputPartition):
    def __init__(self, shallow: list[str], deep: list[str]):
        self.shallow, self.deep = shallow, deep


class _Lister(DataSourceReader):
    def __init__(self, root: str, folders: int, named: frozenset[str]):
        self.root, self.folders, self.named = root, folders, named

    def partitions(self) -> list[_Folders]:
        """Folders dealt round; the driver opens one after the other until there are enough, or they held so many files that tasks should go on."""
        from pyarrow import fs

        store, base = store_of(self.root)
        if store.get_file_info(base).type != fs.FileType.Directory:
            raise NotADirectoryError(self.root)
        opened: list[str] = []
        ahead, seen = [""], 0
        while ahead and len(opened) + len(ahead) < self.folders and seen < BATCH_ROWS:
            opened.append(ahead.pop(0))
            found = entries(store, base, opened[-1])
            seen += len(found)
            ahead += sorted(path for path, info in found if info.type == fs.FileType.Directory)
        n = max(1, min(self.folders, len(opened) + len(ahead)))
        return [_Folders(opened[i::n], ahead[i::n]) for i in range(n)]

    def read(self, partition: _Folders) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, base = store_of(self.root)
        ahead, rows = [(f, True) for f in partition.deep] + [(f, False) for f in partition.shallow], []
        while ahead:
            folder, deep = ahead.pop()
            for path, info in entries(store, base, folder, self.named):
                if not self.named or info.base_name in self.named:
                    rows.append(_row(path, info))
                if deep and info.type == fs.FileType.Directory:
                    ahead.append((path, True))
                if len(rows) == BATCH_ROWS:
                    yield _batch(rows)
                    rows = []
        if rows:
            yield _batch(rows)


class FileListing(DataSource):
    """``spark.read.format("notelake_files").load(root)``: a row for each file and folder that is not hidden.

    With the option ``named`` (names, comma-joined), only what has one of these names, hidden or not.
    """

    @classmethod
    def name(cls) -> str:
        return "notelake_files"

    def schema(self) -> str:
        return LISTED

    def reader(self, schema) -> DataSourceReader:
        named = frozenset(filter(None, self.options.get("named", "").split(",")))
        return _Lister(self.options["path"], int(self.options.get("folders", FOLDERS)), named)


def listing(spark: SparkSession, root: str) -> DataFrame:
    """``(path, is_dir, size, mtime)`` of all files and folders below ``root`` that are not hidden; folders have size 0.

    Empty files and folders are among them. A root that is no folder raises when the rows are read.
    """
    spark.dataSource.register(FileListing)
    return spark.read.format("notelake_files").load(root)


def with_suffix(listed: DataFrame, suffix: str) -> DataFrame:
    return listed.where(~F.col("is_dir") & F.col("path").endswith(suffix)).select("path", "size", "mtime")


def _spread(rows: DataFrame) -> DataFrame:
    """Paths dealt by hash to four tasks a core of the cluster, however few tasks listed them."""
    return rows.repartition(4 * rows.sparkSession.sparkContext.defaultParallelism, "path")


def stats_of(paths: DataFrame, root: str) -> DataFrame:
    """``(path, size, mtime)`` of those of ``paths(path)`` that are files; nothing else is listed or read."""

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, base = store_of(root)
        for batch in batches:
            names = [p for p in batch.column(0).to_pylist() if p]
            infos = store.get_file_info([f"{base}/{p}" for p in names]) if names else []
            rows = [_row(p, i) for p, i in zip(names, infos, strict=True) if i.type == fs.FileType.File]
            if rows:
                yield _batch(rows)

    return _spread(paths.select("path").distinct()).mapInArrow(look, LISTED).select("path", "size", "mtime")


def contents(rows: DataFrame, root: str, wanted: Column | None = None) -> DataFrame:
    """``rows(path, ...)`` with ``content`` and ``problem`` of each file, where ``wanted`` holds; others have neither.

    Line ends become ``\\n``. A file that is gone or is no UTF-8 text has a problem and no content. A batch that goes
    to Spark holds about BATCH_BYTES of text, or one file.
    """
    names = rows.columns
    asked = rows.withColumn("wanted", F.lit(True) if wanted is None else wanted)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = store_of(root)
        for batch in batches:
            where, wants = batch.column(names.index("path")).to_pylist(), batch.column(len(names)).to_pylist()
            texts, problems, held, first = [], [], 0, 0
            for i, (path, want) in enumerate(zip(where, wants, strict=True)):
                text, problem = _text(store, f"{base}/{path}") if want else (None, None)
                texts.append(text)
                problems.append(problem)
                held += len(text or "")
                if held >= BATCH_BYTES or i + 1 == len(where):
                    part = [c.slice(first, i + 1 - first) for c in batch.columns[:-1]]
                    yield pa.RecordBatch.from_arrays([*part, pa.array(texts, pa.string()), pa.array(problems, pa.string())], names=[*names, "content", "problem"])
                    texts, problems, held, first = [], [], 0, i + 1

    made = T.StructType([*rows.schema.fields, T.StructField("content", T.StringType()), T.StructField("problem", T.StringType())])
    return _spread(asked).mapInArrow(read, made)


def _text(store, where: str) -> tuple[str | None, str | None]:
    try:
        with store.open_input_stream(where) as stream:
            return stream.read().decode("utf-8").replace("\r\n", "\n").replace("\r", "\n"), None
    except FileNotFoundError:
        return None, "missing"
    except UnicodeDecodeError:
        return None, "no UTF-8 text"
