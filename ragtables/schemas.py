"""Column lists of the tables that flow between operators."""

from __future__ import annotations

from pyspark.sql import types as T

# The file metadata keys copied from a document to its chunks (null where blank).
FILE_METADATA_COLUMNS = ("file_name", "file_stem", "file_suffix", "relative_path", "parent_dir", "document_type")

DOCUMENT_COLUMNS = ("doc_id", "doc_ord", "content", "source", "path") + FILE_METADATA_COLUMNS

CHUNK_COLUMNS = (
    "id", "kb_id", "collection_name", "doc_id", "doc_ord", "chunk_index", "content", "source", "path",
) + FILE_METADATA_COLUMNS

HIT_COLUMNS = (
    "question_id", "rank", "kb_id", "kb_name", "collection_name", "content", "source", "path",
) + FILE_METADATA_COLUMNS + ("doc_ord", "chunk_index", "distance", "score")

DOCUMENT_SCHEMA = T.StructType(
    [T.StructField("doc_id", T.StringType()), T.StructField("doc_ord", T.LongType()), T.StructField("content", T.StringType()),
     T.StructField("source", T.StringType()), T.StructField("path", T.StringType())]
    + [T.StructField(c, T.StringType()) for c in FILE_METADATA_COLUMNS]
)
