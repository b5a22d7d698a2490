"""Evaluation sets and reports."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import strip

CASE_SCHEMA = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("category", T.StringType()),
        T.StructField("question", T.StringType()),
        T.StructField("expected_keywords", T.ArrayType(T.StringType())),
        T.StructField("reference", T.StringType()),
    ]
)


def load_eval_cases(spark: SparkSession, path: str, limit: int = 0) -> tuple[DataFrame, DataFrame]:
    """``.json`` (object with ``meta`` and ``cases``) or ``.jsonl`` (one case per non-blank line,
    meta = format and count). Returns (cases with 1-based ``ord`` in file order, meta as JSON text);
    the first ``limit`` cases when limit > 0."""
    if path.lower().endswith(".jsonl"):
        # lines of a large set lie in several files or blocks, which Spark does not read in their order
        place = ["_file", "_block", "_line"]
        raw = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"))
        raw = raw.withColumn("_line", F.monotonically_increasing_id()).filter(F.length(strip("value")) > 0)
        cases = raw.select(*place, F.from_json("value", CASE_SCHEMA).alias("c"))
        from ..plans.ordinals import with_ordinal

        cases = with_ordinal(cases, place, "ord", start=1).select("ord", "c.*")
        n = cases.count()
        meta = spark.createDataFrame([(json.dumps({"format": "jsonl", "case_count": n}),)], "meta string")
    else:
        schema = T.StructType([T.StructField("meta", T.StringType()), T.StructField("cases", T.ArrayType(CASE_SCHEMA))])
        doc = spark.read.schema(schema).option("multiLine", "true").json(path)  # a string field keeps an object's JSON text
        cases = doc.select(F.posexplode("cases").alias("pos", "c")).select((F.col("pos") + 1).alias("ord"), "c.*")
        meta = doc.select("meta")
    if limit > 0:
        cases = cases.filter(F.col("ord") <= limit)
    return cases, meta


def list_eval_datasets(spark: SparkSession, directory: str) -> DataFrame:
    """(name, path, format) of the ``.json`` and ``.jsonl`` case files directly in a folder, by name; a missing folder
    gives no rows."""
    from .files import base_path, with_path_metadata
    from .filesource import read_files

    found = with_path_metadata(read_files(spark, directory, (".json", ".jsonl"), content=False), base_path(directory))
    found = found.filter("parent_dir = ''").select(F.col("file_name").alias("name"), "path", F.substring("file_suffix", 2, 10).alias("format"))
    return found.orderBy("name")


def write_eval_results(results: DataFrame, path: str) -> tuple[DataFrame, DataFrame]:
    """Per-case results as a partitioned JSON dataset. Returns (the written rows, their summary), the summary
    (V5) observed while the rows are written, so they are computed once."""
    from ..operators.evaluation import summary_columns

    spark, at = results.sparkSession, path.rstrip("/") + "/results"
    seen, columns = Observation("eval_summary"), summary_columns()
    results.observe(seen, *columns).write.mode("overwrite").json(at)
    schema = results.limit(0).agg(*columns).schema
    summary = spark.createDataFrame([tuple(seen.get[f.name] for f in schema.fields)], schema)
    return spark.read.schema(results.schema).json(at), summary


def write_eval_summary(summary: DataFrame, by_category: DataFrame, path: str, cases_path: str = "", meta_json: str = "{}") -> None:
    """generated_at (with zone), cases path, and meta and summary as objects in one JSON line; per-category rows as a
    dataset next to it."""
    stamp = F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ssXXX")
    quoted = F.to_json(F.struct(stamp.alias("generated_at"), F.lit(cases_path).alias("cases_path")))
    line = F.concat(
        F.substring(quoted, F.lit(1), F.length(quoted) - 1), F.lit(',"meta":' + json.dumps(json.loads(meta_json or "{}"), ensure_ascii=False)),
        F.lit(',"summary":'), F.to_json(F.struct(*summary.columns)), F.lit("}"),
    )
    summary.select(line.alias("value")).coalesce(1).write.mode("overwrite").text(path.rstrip("/") + "/summary")
    by_category.write.mode("overwrite").json(path.rstrip("/") + "/by_category")


def write_eval_report(results: DataFrame, path: str, cases_path: str = "", meta_json: str = "{}") -> DataFrame:
    """The whole report of V4 results, which are computed once: results, per-category rows, summary. Returns the
    written results."""
    from ..operators.evaluation import eval_by_category

    kept, summary = write_eval_results(results, path)
    write_eval_summary(summary, eval_by_category(kept), path, cases_path, meta_json)
    return kept


def read_eval_summary(spark: SparkSession, path: str) -> DataFrame:
    """The one row of a written report's summary."""
    return spark.read.json(path.rstrip("/") + "/summary").select("summary.*")
