"""Files as a Spark data source (S1): ``spark.read.format("ragtables_files").load(folder)``.

The folder is listed once while the scan is planned, names with a leading dot or underscore included, and its files are
packed in path order into partitions of about ``partitionBytes`` (and at most ``FILES_PER_PARTITION`` files), so rows come
in path order without a sort. Files are opened in the tasks. One that cannot be read gives a row with its ``error`` and
no content; so does one beyond the 2 GB that a binary value can hold.

Options: ``path`` (a plain path or a ``file:``, ``s3:``, ``gs:`` or ``hdfs:`` URI), ``suffixes`` (comma-separated, lower
case; default: all), ``partitionBytes`` (64 MB), ``content`` (``false``: listing only). A missing folder gives no rows.

``list_files`` lists a folder without planning: no process holds the listing, and the driver sees none of it.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import datetime, timedelta, timezone
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

FORMAT = "ragtables_files"
SCHEMA = "path string, length long, modified timestamp, content binary, error string"
PARTITION_BYTES, FILES_PER_PARTITION = 64 << 20, 10_000
#: Bytes of content and files in one Arrow batch, and the most bytes that a value can hold.
BATCH_BYTES, BATCH_FILES, MOST_BYTES = 4 << 20, 1000, (1 << 31) - 1
#: A listed file; length and modification time (microseconds) are null where the walk does not see them.
LISTED = pa.schema([("path", pa.string()), ("length", pa.int64()), ("modified", pa.int64())])
NEVER = datetime.fromtimestamp(0, timezone.utc)
ARROW = pa.schema([("path", pa.string()), ("length", pa.int64()), ("modified", pa.timestamp("us", "UTC")), ("content", pa.binary()), ("error", pa.string())])


def file_system(path: str) -> tuple[object, str]:
    """(file system, path in it) of a path or URI."""
    from pyarrow import fs

    if "://" in path or path.startswith("file:"):
        return fs.FileSystem.from_uri(path if "://" in path else "file://" + path.removeprefix("file:"))
    return fs.LocalFileSystem(), path


def suffix_of(name: str) -> str:
    """From the last dot, in lower case, if that dot is neither first nor last."""
    dot = name.rfind(".")
    return name[dot:].lower() if 0 < dot < len(name) - 1 else ""


@dataclass
class Listed:
    path: str
    length: int
    modified: datetime


class FilePartition(InputPartition):
    def __init__(self):
        super().__init__(None)
        self.files: list[Listed] = []


def listed(path: str, suffixes: tuple[str, ...]) -> list[Listed]:
    """The regular files under a folder, in order of their path components."""
    from pyarrow import fs

    system, root = file_system(path)
    found = system.get_file_info(fs.FileSelector(root, recursive=True, allow_not_found=True))
    files = [f for f in found if f.type == fs.FileType.File and (not suffixes or suffix_of(f.base_name) in suffixes)]
    files.sort(key=lambda f: f.path.split("/"))
    return [Listed(f.path, f.size, f.mtime or NEVER) for f in files]


def packed(files: list[Listed], partition_bytes: int, most_files: int = FILES_PER_PARTITION) -> list[FilePartition]:
    """Consecutive files in partitions of about ``partition_bytes``."""
    out, size = [], 0
    for f in files:
        if not out or (size + f.length > partition_bytes and out[-1].files) or len(out[-1].files) >= most_files:
            out.append(FilePartition())
            size = 0
        out[-1].files.append(f)
        size += f.length
    return out or [FilePartition()]


class FilesReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options.get("path")
        if not self.path:
            raise ValueError("give the folder as path")
        self.suffixes = tuple(s.strip() for s in options.get("suffixes", "").split(",") if s.strip())
        self.partition_bytes = int(options.get("partitionbytes", PARTITION_BYTES))
        self.content = options.get("content", "true").lower() != "false"

    def partitions(self) -> list[FilePartition]:
        return packed(listed(self.path, self.suffixes), self.partition_bytes)

    def read(self, partition: FilePartition) -> Iterator[pa.RecordBatch]:
        system, _ = file_system(self.path)
        rows, size = [], 0
        for f in partition.files:
            content, error = None, None
            if self.content:
                try:
                    if f.length > MOST_BYTES:
                        raise OSError(f"{f.length} bytes are more than a value can hold")
                    with system.open_input_stream(f.path) as stream:
                        content = stream.read()
                except OSError as e:
                    error = str(e)
            rows.append({"path": f.path, "length": f.length, "modified": f.modified, "content": content, "error": error})
            size += len(content or b"")
            if size >= BATCH_BYTES or len(rows) >= BATCH_FILES:
                yield pa.RecordBatch.from_pylist(rows, schema=ARROW)
                rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=ARROW)


class FilesSource(DataSource):
    """See the module's docstring."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> FilesReader:
        return FilesReader(self.options)


def read_files(spark: SparkSession, directory: str, suffixes: tuple[str, ...] = (), content: bool = True, partition_bytes: int = PARTITION_BYTES):
    """The files under ``directory`` (path, length, modified, content, error), in path order."""
    spark.dataSource.register(FilesSource)
    reader = spark.read.format(FORMAT).option("suffixes", ",".join(suffixes)).option("partitionBytes", partition_bytes)
    return reader.option("content", str(content).lower()).load(directory)


def _entry(f) -> tuple[str, int, int]:
    return f.path, f.size, ((f.mtime or NEVER) - NEVER) // timedelta(microseconds=1)


def walked(root: str, suffixes: tuple[str, ...]) -> Iterator[tuple[str, int | None, int | None]]:
    """(path, length, modified) of the regular files under a folder, in no order, one after the other.

    A local folder is read entry by entry, without the files' lengths and times; other stores tell both, and are listed a
    folder at a time."""
    from pyarrow import fs

    system, root = file_system(root)
    folders = [root]
    while folders:
        folder = folders.pop()
        if isinstance(system, fs.LocalFileSystem):
            try:
                with os.scandir(folder) as entries:
                    for e in entries:
                        if e.is_dir():
                            folders.append(e.path)
                        elif not suffixes or suffix_of(e.name) in suffixes:
                            yield e.path, None, None
            except FileNotFoundError:
                pass  # no such folder, or gone meanwhile
        else:
            for f in system.get_file_info(fs.FileSelector(folder, allow_not_found=True)):
                if f.type == fs.FileType.Directory:
                    folders.append(f.path)
                elif f.type == fs.FileType.File and (not suffixes or suffix_of(f.base_name) in suffixes):
                    yield _entry(f)


def list_files(spark: SparkSession, directory: str, suffixes: tuple[str, ...] = ()) -> DataFrame:
    """The files under ``directory`` (path, length, modified in microseconds), in no order: the listing of ``read_files``
    for any number of files. One task walks the folders and sends the files on as it finds them; lengths and times that it
    did not see are asked for by all tasks, a batch of files at a time."""
    from pyarrow import fs

    def walk(_: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = walked(directory, suffixes)
        while rows := list(islice(found, BATCH_FILES)):
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), LISTED.types, strict=True)], schema=LISTED)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, _ = file_system(directory)
        for batch in batches:
            for lo in range(0, batch.num_rows, BATCH_FILES):
                rows = [tuple(r.values()) for r in batch.slice(lo, BATCH_FILES).to_pylist()]
                seen = [r for r in rows if r[1] is not None]
                seen += [_entry(f) for f in system.get_file_info([r[0] for r in rows if r[1] is None]) if f.type == fs.FileType.File]
                yield pa.RecordBatch.from_pylist([dict(zip(LISTED.names, r, strict=True)) for r in seen], schema=LISTED)

    kind = "path string, length long, modified long"
    found = spark.range(0, 1, 1, 1).mapInArrow(walk, kind)
    return found.repartition(spark.sparkContext.defaultParallelism, "path").mapInArrow(ask, kind)


def write_files(rows, root: str, path: str = "path", content: str = "content"):
    """One file for each row of (``path`` relative to ``root``, ``content``); a task that runs again writes the same files.
    Returns the number of files."""
    from pyspark.sql import functions as F

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = file_system(root)
        made, n = set(), 0
        for batch in batches:
            for name, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                at = f"{base.rstrip('/')}/{name}"
                parent = at.rsplit("/", 1)[0]
                if parent not in made:
                    system.create_dir(parent, recursive=True)
                    made.add(parent)
                with system.open_output_stream(at) as stream:
                    stream.write(value or b"")
                n += 1
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], names=["n"])

    done = rows.select(F.col(path).alias("path"), F.col(content).cast("binary").alias("content")).mapInArrow(run, "n long")
    return done.agg(F.sum("n")).first()[0] or 0
