"""Corpus pipeline over ``documents``: language, near duplicates, repeated passages, test items, tokens.

Each stage takes (spark, docs, sf_dir), works on all rows that its predecessor kept, and returns the columns of
``documents`` (the last one the tokens). ``run`` writes what a stage returns as Parquet in the shared folder and reads
it again as the next one's docs.

Defined results: documents whose text is null or has no letter, or whose language is not clear, go in the first
stage; of each class of near duplicates the row with the smallest doc_id stays, repeated rows (doc_id and text) of it
go, and rows that share only their doc_id are classed each by its own text; rows with a null doc_id pass through the two stages of copies; a document that holds a copy of a test item goes; a text
of which everything was cut stays as an empty one. Extra columns are dropped; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ragtables.llm import bitmaps, decontaminate, language_id, near_dup, piece_codec, suffix_dedup
from ragtables.llm.storage import cut, new_folder

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: A smaller share of the likelihood than this is no clear language.
MIN_LANGUAGE_SCORE = 0.5
ORACLE_SQL = None


def keep_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of a clear language."""
    docs = docs.select(COLUMNS)
    model = language_id.fit(docs.filter(language_id.held_out() != 2))
    return language_id.keep_clear(docs, model, MIN_LANGUAGE_SCORE)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates. Rows are chosen on narrow columns; only the rows of classes of
    several rows are shuffled."""
    docs = docs.select(COLUMNS)
    rows = docs.filter("doc_id is not null").withColumn("key", F.xxhash64("doc_id", "text"))
    found = near_dup.near_duplicates(rows.select(F.col("key").alias("doc_id"), "text"))
    classes = cut(found.select(F.col("doc_id").alias("key"), "class_id"))
    several = classes.groupBy("class_id").agg(F.count("*").alias("n")).filter("n > 1").select("class_id")
    busy = cut(classes.join(several, "class_id").distinct())
    wanted, alone = bitmaps.split(rows, "key", busy.select("key"))
    ids = bitmaps.split(rows.select("key", "doc_id"), "key", busy.select("key"))[0].join(busy, "key")
    kept = ids.groupBy("class_id").agg(F.min(F.struct("doc_id", "key")).alias("first")).select(F.col("first.key").alias("key"))
    state = busy.select("key").distinct().join(kept.withColumn("kept", F.lit(True)), "key", "left").select("key", F.coalesce("kept", F.lit(False)).alias("kept"))
    # rows that the bit map lets through by chance are in no class of several rows
    one = wanted.join(state, "key", "left").filter(F.coalesce("kept", F.lit(True))).dropDuplicates(["key"])  # both by key: one shuffle
    return one.select(COLUMNS).unionByName(alone.select(COLUMNS)).unionByName(docs.filter("doc_id is null"))


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the strings that a document with a smaller doc_id holds too."""
    cut = suffix_dedup.cut_documents(docs, COLUMNS)
    return cut.withColumn("n_chars", F.length("text").cast("long")).select(COLUMNS)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a copy of a test item, row by row: rows that share a doc_id, or have none, count by their text."""
    rows, items = docs.select(COLUMNS).withColumn("key", F.xxhash64("doc_id", "text")), spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    found = decontaminate.contaminated(rows.select(F.col("key").alias("doc_id"), "text"), items)
    return rows.join(found.select(F.col("doc_id").alias("key")).distinct(), "key", "left_anti").select(COLUMNS)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of each document, and whether decoding them gives the text back."""
    coded = piece_codec.encode(docs, columns=("doc_id", "lang", "source"))
    return coded.select("doc_id", "lang", "source", F.size("ids").alias("n_tokens"), "ids", "exact")


STAGES = [
    ("language", keep_language),
    ("near duplicates", drop_near_duplicates),
    ("repeated passages", cut_repeats),
    ("test items", drop_contaminated),
    ("tokens", tokenize),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = new_folder(spark, f"pipeline-{name.replace(' ', '-')}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
