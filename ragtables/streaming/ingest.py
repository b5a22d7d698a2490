"""Incremental ingest (S14): only changed files are read, chunked, embedded and upserted.

Each trigger lists the folder in tasks (``note_folder``) as one more batch of a streaming table: the files (path, length,
modification time) are dealt to ``LISTING_BUCKETS`` buckets by a hash of their path, one row for each bucket and listing, also
for an empty bucket. ``transformWithState`` keeps what is known of a bucket's files: length, time and content hash. A file
that is new or whose length or time differs is read; if its hash differs too, it goes on as a change. Files that the newest
listing no longer has go on as removed. So the state is asked once for a bucket, not for each file, and written only where a
bucket changed. There is no manifest: the state is the store's, and old listings are deleted by the source. ``foreachBatch``
upserts the changes; a batch that runs again upserts the same rows.
"""

from __future__ import annotations

import hashlib
import io
import time
from collections.abc import Iterator
from typing import Callable

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..functions.text import clean_text
from ..operators.chunking import chunk_documents, with_chunk_keys
from ..operators.embedding import embed
from ..operators.profiles import ChunkConfig
from ..sources.files import TEXT_SUFFIXES, base_path, file_text, with_path_metadata
from ..sources.filesource import file_system, list_files
from ..sources.index import index_buckets, write_index

LISTED = "bucket long, at timestamp, path array<string>, length array<long>, modified array<long>"
CHANGES = "path string, change string, content binary"
KNOWN = pa.schema([("path", pa.string()), ("length", pa.int64()), ("modified", pa.int64()), ("digest", pa.binary())])
#: Buckets of a listing (fixed: the state is kept by bucket), and bytes of content that are sent on together.
LISTING_BUCKETS, SENT_BYTES = 1024, 16 << 20
ADAPTIVE = "spark.sql.adaptive.enabled"
STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def packed(known: dict[str, tuple[int, int, bytes]]) -> bytes:
    sink, rows = io.BytesIO(), [(path, *of) for path, of in sorted(known.items())]
    with pa.ipc.new_stream(sink, KNOWN) as out:
        out.write_table(pa.table([list(c) for c in zip(*rows, strict=True)] or [[]] * len(KNOWN), schema=KNOWN))
    return sink.getvalue()


def unpacked(blob: bytes) -> dict[str, tuple[int, int, bytes]]:
    c = pa.ipc.open_stream(blob).read_all().to_pydict()
    return dict(zip(c["path"], zip(c["length"], c["modified"], c["digest"], strict=True), strict=True))


class FileChanges(StatefulProcessor):
    """Listings of one bucket in, its changes out: ``added``, ``changed`` (with the content) and ``removed``."""

    def __init__(self, root: str):
        self.root = root

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.known = handle.getValueState("files", "packed binary")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        newest = max((row for part in rows for row in part.itertuples(index=False)), key=lambda row: row.at)
        known = unpacked(bytes(self.known.get()[0])) if self.known.exists() else {}
        listed = {path: (int(n), int(at)) for path, n, at in zip(newest.path, newest.length, newest.modified, strict=True)}
        out, size, news = [], 0, False
        for path in known.keys() - listed.keys():
            del known[path]
            out.append((path, "removed", None))
        system = file_system(self.root)[0]
        for path, now in listed.items():
            before = known.get(path)
            if before is not None and before[:2] == now:
                continue
            try:
                with system.open_input_stream(path) as stream:
                    content = stream.read()
            except OSError:
                continue  # gone or unreadable now: the next listing tells
            digest, news = hashlib.sha256(content).digest(), True
            known[path] = (*now, digest)
            if before is None or before[2] != digest:
                out.append((path, "added" if before is None else "changed", content))
                size += len(content)
            if size >= SENT_BYTES:
                yield _changes(out)
                out, size = [], 0
        if out:
            news = True
            yield _changes(out)
        if news:
            self.known.update((packed(known),))

    def close(self) -> None:
        pass


def _changes(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=["path", "change", "content"], dtype=object)


def listings(checkpoint: str) -> str:
    return f"{checkpoint.rstrip('/')}/listings"


def note_folder(spark: SparkSession, directory: str, checkpoint: str) -> None:
    """One more listing of the folder for the stream."""
    at = F.timestamp_millis(F.lit(int(time.time() * 1000)))
    files = list_files(spark, directory, TEXT_SUFFIXES).select(
        F.pmod(F.xxhash64("path"), F.lit(LISTING_BUCKETS)).alias("bucket"), F.struct("path", "length", "modified").alias("file"))
    empty = spark.range(LISTING_BUCKETS).select(F.col("id").alias("bucket"), F.lit(None).cast(files.schema["file"].dataType).alias("file"))
    rows = files.unionByName(empty).groupBy("bucket").agg(F.collect_list("file").alias("files"))  # the files of one bucket, no null
    rows.select("bucket", at.alias("at"), "files.path", "files.length", "files.modified").write.mode("append").parquet(listings(checkpoint))


def file_changes(spark: SparkSession, directory: str, checkpoint: str) -> DataFrame:
    """The stream of changes (path, change, content) between the listings."""
    spark.conf.set(*STORE)
    listed = spark.readStream.schema(LISTED).option("cleanSource", "delete").parquet(listings(checkpoint))
    return listed.groupBy("bucket").transformWithStateInPandas(FileChanges(directory), CHANGES, "Update", "None")


def _batch_documents(files: DataFrame, root: str) -> DataFrame:
    """Documents of the changes, also those without text (their chunks are to go)."""
    files = with_path_metadata(files.select("path", "content"), root)
    docs = files.withColumn("content", clean_text(file_text(F.col("file_suffix"), F.col("content"))["text"]))
    # doc_id = hash of the path: stable across batches, so an upsert replaces a changed file's chunks; the batch job
    # numbers documents by path order instead, which no later batch could keep
    return docs.withColumn("doc_id", F.sha2("path", 256)).withColumn("doc_ord", F.xxhash64("path"))


def _upsert(docs: DataFrame, index_path: str, config: ChunkConfig, profile_id: str | None, collection: str,
            make_model: Callable | None, batch_size: int) -> None:
    chunks = with_chunk_keys(chunk_documents(docs, config, make_model=make_model, batch_size=batch_size), profile_id, collection)
    if make_model is not None:
        chunks = embed(chunks, "content", make_model, batch_size=batch_size, normalize=True)
    incoming = docs.select(F.lit(collection).alias("collection_name"), "doc_id")
    if index_buckets(docs.sparkSession, index_path) is None and chunks.isEmpty():
        return
    write_index(chunks, index_path, mode="upsert", documents=incoming, counts=False)


def ingest_stream(spark: SparkSession, directory: str, index_path: str, checkpoint: str, *, config: ChunkConfig = ChunkConfig(),
                  profile_id: str | None = None, collection: str = "knowledge", make_model: Callable | None = None,
                  batch_size: int = 32, available_now: bool = True):
    """Bring the index up to date with the folder; returns the StreamingQuery.

    ``available_now``: one listing, processed to its end. Otherwise the query keeps running, and every call of
    ``note_folder`` (by a timer of the caller) makes it process one more listing."""
    root = base_path(directory)
    note_folder(spark, directory, checkpoint)

    def upsert_batch(batch: DataFrame, epoch: int) -> None:
        batch, conf = batch.persist(), batch.sparkSession.conf  # the state is asked once, by the plan made here
        before = conf.get(ADAPTIVE)
        # a stream's own session has adaptive execution off, and without it the write's rebalancing is left out: every
        # task would write a file into every bucket
        conf.set(ADAPTIVE, "true")
        try:
            if not batch.isEmpty():
                _upsert(_batch_documents(batch, root), index_path, config, profile_id, collection, make_model, batch_size)
        finally:
            conf.set(ADAPTIVE, before)
            batch.unpersist()

    q = file_changes(spark, directory, checkpoint).writeStream.outputMode("update").foreachBatch(upsert_batch)
    q = q.option("checkpointLocation", checkpoint)
    q = q.trigger(availableNow=True) if available_now else q.trigger(processingTime="10 seconds")
    handle = q.start()
    if available_now:
        handle.awaitTermination()
    return handle
