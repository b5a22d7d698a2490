"""The chunk index as partitioned Parquet (S13): write, read, replace a collection, upsert."""

from __future__ import annotations

import json

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.checkpoints import cut


def upsert(old: DataFrame, new: DataFrame, keys: tuple[str, ...] = ("collection_name", "doc_id"), documents: DataFrame | None = None) -> DataFrame:
    """Rows of the incoming documents replace all old rows of those documents (so chunks that a
    document no longer has disappear); other rows are kept. ``documents``: the keys of all incoming documents, also
    of those that have no chunk any more. Left-anti join on the document key + union: no row-by-row id lookups."""
    incoming = new.select(*keys)
    if documents is not None:
        incoming = incoming.unionByName(documents.select(*keys))
    # data-derived side: AQE broadcasts it after measuring it, else a shuffle anti-join (skew split on)
    kept = old.join(incoming.distinct(), list(keys), "left_anti")
    return kept.unionByName(new, allowMissingColumns=True)


# Document buckets per collection of a new index: an upsert rewrites only the buckets its documents fall into.
DOC_BUCKETS = 256
# The index keeps its bucket count in this file (readers skip names that start with an underscore).
META = "_index.json"
PARTS = ["collection_name", "doc_bucket"]


def doc_bucket(doc_id, buckets: int = DOC_BUCKETS):
    return F.pmod(F.xxhash64(F.col(doc_id).cast("string") if isinstance(doc_id, str) else doc_id.cast("string")), F.lit(buckets)).cast("int")


def _meta(spark: SparkSession, path: str):
    """(file system, path) of the file that holds the bucket count."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}/{META}")
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def index_buckets(spark: SparkSession, path: str) -> int | None:
    """Bucket count of an existing index; None without one."""
    fs, at = _meta(spark, path)
    if not fs.exists(at):
        return None
    stream = fs.open(at)
    try:
        return json.loads(spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))["buckets"]
    finally:
        stream.close()


def _note_buckets(spark: SparkSession, path: str, buckets: int) -> None:
    fs, at = _meta(spark, path)
    stream = fs.create(at, True)
    stream.write(bytearray(json.dumps({"buckets": buckets}).encode()))
    stream.close()


def _stored(spark: SparkSession, path: str) -> DataFrame | None:
    """All rows under ``path``, markers of emptied partitions included; None if nothing is written yet."""
    spark.catalog.refreshByPath(path)
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() in ("UNABLE_TO_INFER_SCHEMA", "PATH_NOT_FOUND"):
            return None
        raise


def write_index(chunks: DataFrame, path: str, mode: str = "replace", buckets: int = DOC_BUCKETS, documents: DataFrame | None = None,
                counts: bool = True, collections: list[str] | None = None) -> dict:
    """Write chunks partitioned by ``collection_name`` and ``doc_bucket`` (a hash of ``doc_id``).

    ``replace``: the collections of ``chunks`` (named by ``collections``, else looked up first) are replaced, other
    collections stay. ``upsert``: only the (collection, bucket) partitions of the incoming documents are read, merged
    (their chunks replace the old ones; ``documents`` names all incoming documents, also those that became blank) and
    rewritten. An existing index keeps its bucket count; a new one takes ``buckets``.

    One write with Spark's dynamic partition overwrite: rows are staged by the commit protocol and replace their
    partitions only when all of them are written, so a failed write leaves the old rows. A partition that loses all its
    rows gets a marker row without a ``doc_id``, which ``read_index`` leaves out. Rows are rebalanced by partition, so a
    large bucket is many tasks and files, and small ones share a task.

    Returns the per-collection document and chunk counts (``counts=False``: none, which saves reading the index); no
    chunks is an error, but for an upsert with ``documents``. An index that cannot be read is an error.
    """
    if mode not in ("replace", "upsert"):
        raise ValueError("mode must be 'replace' or 'upsert'")
    if (mode == "replace" or documents is None) and chunks.isEmpty():
        raise ValueError("no chunks to index")
    spark = chunks.sparkSession
    known = index_buckets(spark, path)
    if known is None:
        _note_buckets(spark, path, buckets)
    buckets = known or buckets
    chunks = chunks.withColumn("doc_bucket", doc_bucket("doc_id", buckets))
    old = _stored(spark, path)
    fresh = chunks
    if old is not None and mode == "replace":
        present = old.select(*PARTS).distinct()
        names = chunks.select("collection_name").distinct() if collections is None else spark.createDataFrame([(c,) for c in collections], "collection_name string")
        # one row per collection, and per collection and bucket
        fresh = fresh.unionByName(present.join(F.broadcast(names), "collection_name", "left_semi"), allowMissingColumns=True)
    elif mode == "upsert":
        keys = chunks.select(*PARTS, "doc_id")
        if documents is not None:
            keys = documents.select("collection_name", "doc_id").withColumn("doc_bucket", doc_bucket("doc_id", buckets)).select(*PARTS, "doc_id")
        touched = cut(keys.select(*PARTS).distinct())
        if old is not None:
            # at most collections x buckets rows: the scan is pruned to these partitions
            mine = old.filter("doc_id is not null").join(F.broadcast(touched), PARTS, "left_semi")
            fresh = upsert(mine, chunks, documents=documents)
        fresh = fresh.unionByName(touched, allowMissingColumns=True)
    fresh = fresh.select(*[c for c in fresh.columns if c not in PARTS], *PARTS)
    writer = fresh.hint("rebalance", *PARTS).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    writer.partitionBy(*PARTS).parquet(path)
    spark.catalog.refreshByPath(path)
    if not counts:
        return {}
    stats = read_index(spark, path).groupBy("collection_name").agg(F.countDistinct("doc_id").alias("documents"), F.count("*").alias("chunks"))
    return {r["collection_name"]: {"documents": r["documents"], "chunks": r["chunks"]} for r in stats.collect()}


def read_index(spark: SparkSession, path: str, collection: str | None = None) -> DataFrame:
    """The index; a collection filter prunes to that partition directory."""
    df = spark.read.parquet(path).filter("doc_id is not null")
    return df.filter(F.col("collection_name") == collection) if collection else df


def build_index(docs: DataFrame, path: str, profiles=None, *, config=None, make_model=None, embed_col: str = "embedding",
                mode: str = "replace", batch_size: int = 32) -> dict:
    """Ingest: documents -> chunks per profile (C1/C9) -> keys (C10) -> vectors (E1, when
    ``make_model`` is given, which semantic chunking then uses too) -> partitioned index (S13). Without profiles one default collection is
    built with ``config``. Returns the per-collection document and chunk counts."""
    from ..operators.chunking import chunk_documents, chunk_profiles, with_chunk_keys
    from ..operators.embedding import embed
    from ..operators.profiles import DEFAULT_COLLECTION, ChunkConfig

    if docs.limit(1).count() == 0:
        raise FileNotFoundError("no documents to index")
    if profiles:
        chunks = chunk_profiles(docs, list(profiles), make_model=make_model, batch_size=batch_size)
        names = [p.collection_name for p in profiles]
    else:
        split = chunk_documents(docs, config or ChunkConfig(), make_model=make_model, batch_size=batch_size)
        chunks, names = with_chunk_keys(split, None, DEFAULT_COLLECTION), [DEFAULT_COLLECTION]
    if make_model is not None:
        chunks = embed(chunks, "content", make_model, out_col=embed_col, batch_size=batch_size, normalize=True)
    incoming = docs.select(F.explode(F.array(*map(F.lit, names))).alias("collection_name"), "doc_id")
    return write_index(chunks, path, mode=mode, documents=incoming, collections=names)
