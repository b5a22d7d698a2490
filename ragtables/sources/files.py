"""Files as documents."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import clean_text, col_
from ..plans.partitioning import bounded_batches
from ..schemas import DOCUMENT_COLUMNS
from .filesource import file_system, read_files
from .markup import PARSED, PARSERS, parsed_text, visible_text

# Supported file suffixes (lower case).
SUPPORTED_SUFFIXES = (".txt", ".md", ".pdf", ".csv", ".xlsx", ".xls", ".xlsm", ".docx", ".pptx", ".html", ".json", ".xml")
# Suffixes whose bytes this package turns into text (the office and PDF formats come as extracted parts, see S9).
TEXT_SUFFIXES = (".txt", ".md", ".html", ".json", ".xml", ".csv")


def file_name(path: Column) -> Column:
    return F.regexp_extract(path, "([^/]*)$", 1)


def file_suffix(name: Column) -> Column:
    """Python ``PurePath.suffix``: from the last dot, if that dot is neither first nor last."""
    return F.regexp_extract(name, "(?s)^.+(\\.[^./]+)$", 1)


def file_stem(name: Column) -> Column:
    suf = file_suffix(name)
    return F.when(F.length(suf) > 0, F.substring(name, F.lit(1), F.length(name) - F.length(suf))).otherwise(name)


def normalize_path(path: Column) -> Column:
    """Collapse repeated slashes and drop a trailing one (as pathlib does)."""
    p = F.regexp_replace(path, "/+", "/")
    return F.when(p == "/", p).otherwise(F.regexp_replace(p, "/$", ""))


def with_path_metadata(df: DataFrame, root: str, path_col: str = "path") -> DataFrame:
    """source/file name, stem, lower suffix, path relative to ``root`` (else absolute), parent
    directory ('' at the root) and ``document_type = 'file'``."""
    root = root.rstrip("/") or "/"
    p = normalize_path(F.col(path_col))
    prefix = root if root.endswith("/") else root + "/"
    rel = F.when(p.startswith(prefix), F.substring(p, F.lit(len(prefix) + 1), F.lit(1 << 30))).otherwise(p)
    parent = F.regexp_extract(rel, "(?s)^(.*)/[^/]*$", 1)
    parent = F.when(rel.startswith("/") & (F.length(parent) == 0), F.lit("/")).otherwise(parent)
    name = file_name(p)
    return df.withColumn(path_col, p).select(
        "*",
        name.alias("source"),
        name.alias("file_name"),
        file_stem(name).alias("file_stem"),
        F.lower(file_suffix(name)).alias("file_suffix"),
        rel.alias("relative_path"),
        parent.alias("parent_dir"),
        F.lit("file").alias("document_type"),
    )


def base_path(directory: str) -> str:
    """The folder as the files' paths begin."""
    return file_system(directory)[1]


def scan_files(spark: SparkSession, directory: str, suffixes=SUPPORTED_SUFFIXES) -> DataFrame:
    """Regular files under ``directory`` (recursive, names with a leading dot or underscore too) whose lower-cased
    suffix is supported, in path order without a sort; a missing directory gives no rows. Columns: path, length, content
    (binary), error (why a file could not be read)."""
    return read_files(spark, directory, tuple(suffixes)).select("path", "length", "content", "error")


def decoded(v: bytes) -> str:
    for enc in ("utf-8", "gbk", "gb18030"):
        try:
            return bytes(v).decode(enc)
        except UnicodeDecodeError:
            continue
    return bytes(v).decode("utf-8", errors="ignore")


@F.pandas_udf(T.StringType())
def _decode_fallback(b: pd.Series) -> pd.Series:
    return b.map(lambda v: None if v is None else decoded(v))


def decode_text(content: Column | str) -> Column:
    """S3: bytes -> text: UTF-8 natively; otherwise GBK, GB18030, then UTF-8 dropping bad bytes."""
    c = col_(content)
    s = c.cast("string")
    # Spark runs a Python function for every row even under CASE WHEN: valid rows send it a null
    return F.coalesce(F.when(F.is_valid_utf8(s), s), _decode_fallback(F.when(~F.is_valid_utf8(s), c)))


#: How the extracted parts of other formats are joined (S9), by suffix.
PART_KINDS = {".pdf": "pages", ".docx": "paragraphs", ".pptx": "slides", ".xlsx": "paragraphs", ".xls": "paragraphs", ".xlsm": "paragraphs"}


@F.pandas_udf(PARSED)
def _read_file(suffix: pd.Series, content: pd.Series) -> pd.DataFrame:
    def one(suf, v):
        if v is None or suf not in TEXT_SUFFIXES:
            return None, None
        if suf in PARSERS:
            return parsed_text(suf, decoded(v))
        return (visible_text(decoded(v)) if suf == ".html" else decoded(v)), None

    return pd.DataFrame([one(s, v) for s, v in zip(suffix, content)], columns=["text", "error"], dtype=object)


_read_once = _read_file.asNondeterministic()  # else a filter on the text is pushed below it and each file is parsed again


def file_text(suffix: Column, content: Column) -> Column:
    """struct(text, error) of a file's bytes by its suffix (S3-S7); the text is null for other formats and for contents
    that cannot be parsed, of which the error tells why. One Python function for all formats, so a task has one worker for
    them; valid UTF-8 of plain files stays in Spark."""
    text = content.cast("string")
    plain = F.coalesce(suffix.isin(".txt", ".md") & F.is_valid_utf8(text), F.lit(False))
    return F.when(plain, F.struct(text.alias("text"), F.lit(None).cast("string").alias("error"))).otherwise(_read_once(suffix, F.when(~plain, content)))


def file_texts(spark: SparkSession, directory: str) -> DataFrame:
    """One row per file of a text format: path metadata, ``content`` (text) and ``error`` (unreadable or unparsable)."""
    bounded_batches(spark)
    files = with_path_metadata(scan_files(spark, directory, TEXT_SUFFIXES), base_path(directory))
    read = files.withColumn("_read", file_text(F.col("file_suffix"), F.col("content")))
    return read.withColumn("content", clean_text("_read.text")).withColumn("error", F.coalesce("error", "_read.error")).drop("_read", "length")


def failed_files(spark: SparkSession, directory: str) -> DataFrame:
    """(path, error) of the files that ``file_documents`` leaves out because they cannot be read or parsed."""
    return file_texts(spark, directory).filter("error is not null").select("path", "error")


def _part_documents(parts: DataFrame, root: str) -> DataFrame:
    """Documents of the extracted parts (path, part, text[, sub]): pages, paragraphs, slides or sheets by the suffix."""
    from .tables import assemble_parts

    named = with_path_metadata(parts, root).withColumnRenamed("text", "_text")
    out = None
    for kind in sorted(set(PART_KINDS.values())):
        own = named.filter(F.col("file_suffix").isin(*[s for s, k in PART_KINDS.items() if k == kind]))
        sub = "sub" if kind == "slides" and "sub" in parts.columns else None
        one = assemble_parts(own, doc_key=["path"], part_key="part", text="_text", kind=kind, sub_key=sub)
        out = one if out is None else out.unionByName(one)
    return with_path_metadata(out.select("path", clean_text("content").alias("content")), root).filter(F.length("content") > 0)


def file_documents(spark: SparkSession, directory: str, parts: DataFrame | None = None) -> DataFrame:
    """S12 (files): text formats decoded and converted by suffix, stripped, blanks dropped, newlines normalised;
    ``doc_ord`` follows the path order. ``parts`` (path, part, text[, sub]): the extracted pages, paragraphs, slides (with
    their shapes as ``sub``) or sheets of files in other formats, which become documents too. Files that cannot be read
    or parsed fail no job (``failed_files``)."""
    docs = file_texts(spark, directory).filter("error is null").drop("error").filter(F.length("content") > 0)
    if parts is not None:
        docs = docs.unionByName(_part_documents(parts, base_path(directory)), allowMissingColumns=True)
    from ..plans.ordinals import with_ordinal

    # numbered in path-component order (as sorted Path objects), not string order: "a/b" < "a-c/x"; only the
    # paths are ordered and numbered, and joined back
    paths = with_ordinal(docs.select("path", F.split("path", "/").alias("_parts")), ["_parts"], "doc_ord").drop("_parts")
    docs = docs.join(paths, "path").withColumn("doc_id", F.sha2(F.col("path"), 256))
    return docs.select(*DOCUMENT_COLUMNS)


def skipped_files(spark: SparkSession, directory: str, suffixes=TEXT_SUFFIXES) -> DataFrame:
    """(path, file_suffix) of the files under ``directory`` of other formats, which ``file_documents`` does not read."""
    found = read_files(spark, directory, content=False).select("path", F.lower(file_suffix(file_name(F.col("path")))).alias("file_suffix"))
    return found.filter(~F.col("file_suffix").isin(*suffixes))


def load_documents(*parts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Documents of all sources concatenated in argument order (files first, then tables) and
    numbered across the whole list (``doc_ord``, used in chunk ids), + counts per type and total."""
    from ..plans.ordinals import with_ordinal

    docs = None
    for i, p in enumerate(parts):
        p = p.withColumn("_part", F.lit(i))
        if "doc_ord" not in p.columns:
            p = p.withColumn("doc_ord", F.lit(0).cast("long"))
        docs = p if docs is None else docs.unionByName(p, allowMissingColumns=True)
    docs = with_ordinal(docs.withColumnRenamed("doc_ord", "_ord_in_part"), ["_part", "_ord_in_part"], "doc_ord")
    docs = docs.drop("_part", "_ord_in_part")
    return docs, source_counts(docs)


def source_counts(docs: DataFrame) -> DataFrame:
    """S12 counts: documents per ``document_type`` and a ``total`` row, in one pass (``rollup``)."""
    counted = docs.rollup("document_type").agg(F.count("*").alias("documents"), F.grouping("document_type").alias("_total"))
    name = F.when(F.col("_total") == 1, F.lit("total")).otherwise(F.col("document_type"))
    return counted.select(name.alias("document_type"), "documents")
