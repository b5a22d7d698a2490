"""Chunking operators (C1, C9, C10): documents -> one row per chunk.

Chunking is a narrow per-row map (native array expressions + posexplode): it never shuffles, and a
document is never split across tasks because it is one row. Several profiles are branches over the
same documents, unioned.
"""

from __future__ import annotations

from typing import Callable

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.chunkers import add_chunks, semantic_stages, sentences
from ..functions.text import clean_text, nullif_blank
from ..functions.vectors import cosine_of_known, norm
from ..plans.checkpoints import cut
from ..plans.ordinals import lag_split
from ..plans.partitioning import bounded_batches
from ..schemas import CHUNK_COLUMNS, FILE_METADATA_COLUMNS
from .embedding import embed, hash_vectors
from .profiles import ChunkConfig, Profile


def chunk_documents(
    docs: DataFrame,
    config: ChunkConfig = ChunkConfig(),
    *,
    text_col: str = "content",
    make_model: Callable | None = None,
    batch_size: int = 32,
    embed_once: bool = False,
) -> DataFrame:
    """One row per chunk: the document's columns, ``chunk_index`` and the chunk as ``content``.

    Text is normalised and stripped first; blank documents give no chunks. Chunkers are array expressions
    in the scan stage. Semantic chunking (C6) asks the model of E1 (``make_model``, batches of
    ``batch_size`` sentences) for vectors; without one it uses the E2 hash model. ``embed_once``: each distinct sentence
    of all documents is embedded once and joined back (for a costly model; see ``sentence_similarities``).
    """
    config.validate()
    keep = [c for c in docs.columns if c != text_col]
    staged = docs.select(*keep, clean_text(F.col(text_col)).alias("_text"))
    if embed_once and config.strategy == "semantic":
        staged = sentence_similarities(staged, "_text", make_model or hash_vectors, batch_size).withColumn("_chunks", F.col("_sentences"))
        for stage in semantic_stages(config.size, config.overlap, config.threshold, lambda _: F.col("_sims"), split=lambda ss: ss):
            staged = staged.withColumn("_chunks", stage(F.col("_chunks")))
    else:
        if config.strategy == "semantic":
            bounded_batches(docs.sparkSession)
        staged = add_chunks(staged, "_text", "_chunks", config.strategy, config.size, config.overlap, config.threshold, make_model, batch_size)
    # the outer form: for the inner one Spark infers a filter on the array and so chunks every text twice more
    chunks = staged.select(*keep, F.posexplode_outer("_chunks").alias("chunk_index", "content")).filter("chunk_index is not null")
    return chunks.withColumn("chunk_index", F.col("chunk_index").cast("int"))


def sentence_similarities(docs: DataFrame, text_col: str, make_model: Callable, batch_size: int = 32) -> DataFrame:
    """The documents with ``_sentences`` in place of the text, and ``_sims``: the similarity of each sentence to the one
    before it (0 for the first).

    Sentences are rows: their distinct texts are embedded once, over all tasks, and joined back, so a long document or
    one that holds a common sentence is no single task. Documents are split once and checkpointed with a number of their
    own; vectors with their lengths."""
    rows = cut(docs.withColumn("_row", F.monotonically_increasing_id()).withColumn("_sentences", sentences(F.col(text_col))).drop(text_col))
    most = rows.agg(F.max(F.size("_sentences")).alias("n")).first()["n"] or 0
    parts = rows.select("_row", F.posexplode("_sentences").alias("_pos", "_sentence"))
    vectors = embed(parts.select("_sentence").distinct(), "_sentence", make_model, out_col="_v", batch_size=batch_size)
    vectors = cut(vectors.withColumn("_n", norm(F.col("_v"))))
    placed = lag_split(parts.join(vectors, "_sentence").select("_row", "_pos", "_v", "_n"), ["_row"], ["_pos"], ["_v", "_n"], largest=most)
    sim = F.when(F.col("_pos") == 0, F.lit(0.0)).otherwise(cosine_of_known(*map(F.col, ("prev__v", "_v", "prev__n", "_n"))))
    per_doc = placed.select("_row", "_pos", sim.alias("_sim")).groupBy("_row").agg(F.array_sort(F.collect_list(F.struct("_pos", "_sim"))).alias("_sims"))
    sims = F.coalesce(F.transform("_sims", lambda x: x["_sim"]), F.array().cast("array<double>"))
    return rows.join(per_doc, "_row", "left").withColumn("_sims", sims).drop("_row")


def with_chunk_keys(chunks: DataFrame, profile_id: str | None = None, collection_name: str = "") -> DataFrame:
    """``{profile or default}-doc-{doc_ord}-chunk-{chunk_index}``, kb id, collection, metadata."""
    prefix = profile_id or "default"
    out = chunks.withColumn(
        "id", F.format_string(f"{prefix.replace('%', '%%')}-doc-%d-chunk-%d", F.col("doc_ord"), F.col("chunk_index"))
    )
    out = out.withColumn("kb_id", F.lit(profile_id or "")).withColumn("collection_name", F.lit(collection_name))
    for c in FILE_METADATA_COLUMNS:
        out = out.withColumn(c, nullif_blank(F.col(c)) if c in chunks.columns else F.lit(None).cast("string"))
    for c in ("source", "path"):
        if c not in out.columns:
            out = out.withColumn(c, F.lit(""))
    rest = [c for c in out.columns if c not in CHUNK_COLUMNS]
    return out.select(*CHUNK_COLUMNS, *rest)


def chunk_profiles(
    docs: DataFrame,
    profiles: list[Profile],
    *,
    make_model: Callable | None = None,
    batch_size: int = 32,
    persist: bool = False,
) -> DataFrame:
    """The same documents chunked once per profile, each into its own collection.

    One branch per profile (profiles are configuration, not data), unioned. Each branch reads only the
    columns it needs from the source; ``persist=True`` shares one cached scan instead (worth it when the
    documents come from an expensive plan rather than a table).
    """
    if not profiles:
        raise ValueError("at least one profile is required")
    for p in profiles:
        p.validate()
    if persist and len(profiles) > 1:
        docs = docs.persist(StorageLevel.MEMORY_AND_DISK)
    out = None
    for p in profiles:
        part = with_chunk_keys(chunk_documents(docs, p.chunk, make_model=make_model, batch_size=batch_size), p.id, p.collection_name)
        out = part if out is None else out.unionByName(part)
    return out



# Per-strategy forms (native JVM expressions): add ``out_col`` = array of chunks of ``text_col``.


def _native(df: DataFrame, text_col: str, out_col: str, strategy: str, size: int, overlap: int, threshold: float = 0.75,
            make_model: Callable | None = None) -> DataFrame:
    ChunkConfig(strategy, size, overlap, threshold).validate()
    staged = df.withColumn(out_col, clean_text(F.col(text_col)))
    return add_chunks(staged, out_col, out_col, strategy, size, overlap, threshold, make_model)


def split_fixed(df: DataFrame, text_col: str, size: int, overlap: int, out_col: str = "chunks") -> DataFrame:
    """C2."""
    return _native(df, text_col, out_col, "fixed", size, overlap)


def split_recursive(df: DataFrame, text_col: str, size: int, overlap: int, out_col: str = "chunks") -> DataFrame:
    """C4 (with C3)."""
    return _native(df, text_col, out_col, "recursive", size, overlap)


def split_semantic(df: DataFrame, text_col: str, size: int, overlap: int, threshold: float,
                   make_model: Callable | None = None, out_col: str = "chunks") -> DataFrame:
    """C6 (``make_model`` as in E1; default E2)."""
    return _native(df, text_col, out_col, "semantic", size, overlap, threshold, make_model)


def split_structure(df: DataFrame, text_col: str, size: int, overlap: int, out_col: str = "chunks") -> DataFrame:
    """C8."""
    return _native(df, text_col, out_col, "structure", size, overlap)


def split_sentences(df: DataFrame, text_col: str, out_col: str = "sentences") -> DataFrame:
    """C5."""
    from ..functions.chunkers import sentences

    return df.withColumn(out_col, sentences(clean_text(F.col(text_col))))


def split_sections(df: DataFrame, text_col: str, out_col: str = "sections") -> DataFrame:
    """C7."""
    from ..functions.chunkers import sections

    return df.withColumn(out_col, sections(clean_text(F.col(text_col))))
