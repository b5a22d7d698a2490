"""Exact vector top-k (R4) over an index of any size.

Both sides are cut in blocks: index rows by a hash of their chunk key, questions by a hash of their id. Every block of
one side meets every block of the other side in a task of its own (``plan="grid"``: a cogroup on the two block numbers),
which scores it by one matrix product and keeps the best k per question and collection; a rank filter merges the blocks.
Blocks are sized in bytes, from counts alone, so no task and no driver holds a side. Questions that fit one
block are broadcast instead (``plan="broadcast"``), which spares the shuffle of the index.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.joins import DEFAULT_BROADCAST_ROWS
from ..plans.topk import top_k

CHUNK_KEY = ["collection_name", "doc_ord", "chunk_index"]
#: Bytes of question vectors and of index vectors in a block, and rows that a block keeps (questions x k).
QUESTION_BYTES, INDEX_BYTES, KEPT_ROWS = 16 << 20, 32 << 20, 1_000_000
#: Cells of a score matrix computed at once.
CELLS = 4_000_000
#: Groups that a question's rows are cut in before they meet.
MERGE_GROUPS = 32
SCORES = [T.StructField("cosine", T.DoubleType()), T.StructField("distance", T.DoubleType())]


def key_columns(index: DataFrame) -> list[str]:
    return [c for c in CHUNK_KEY if c in index.columns]


def collections_bound(index: DataFrame) -> int:
    """Collections in the index: 1 after a literal collection filter, else counted (partition column)."""
    return index.select("collection_name").distinct().count() if "collection_name" in index.columns else 1


def with_payload(index: DataFrame, ranked: DataFrame, questions: int, k: int, columns: list[str]) -> DataFrame:
    """Payload of the final rows by one join on the chunk key; the ranked side is broadcast when its bound
    (questions x k x collections) is small."""
    keys = key_columns(index)
    if questions * max(k, 1) * collections_bound(index) <= DEFAULT_BROADCAST_ROWS:
        ranked = F.broadcast(ranked)
    return index.select(*dict.fromkeys([*keys, *columns])).join(ranked, keys)


def merged_top_k(partial: DataFrame, group: list[str], order: list[Column], k: int) -> DataFrame:
    """Final rank filter in two steps, so that a question's rows of all blocks do not meet in one task."""
    salted = partial.withColumn("_salt", F.pmod(F.spark_partition_id(), F.lit(MERGE_GROUPS)))
    first = top_k(salted, [*group, "_salt"], order, k, rank_col="_first").drop("_first", "_salt")
    return top_k(first, group, order, k)


def matrix(vectors: pa.Array, d: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows x d, valid): the vectors of dimension d; other rows are zero."""
    if isinstance(vectors, pa.ChunkedArray):
        vectors = vectors.combine_chunks()
    offs = vectors.offsets.to_numpy()
    valid = (np.diff(offs) == d) & vectors.is_valid().to_numpy(zero_copy_only=False)
    flat = vectors.values.to_numpy(zero_copy_only=False).astype(np.float64)
    x = np.zeros((len(vectors), d))
    x[valid] = flat[offs[:-1][valid, None] + np.arange(d)]
    return x, valid


def in_key_order(rows: pa.Table) -> pa.Table:
    """The rows by chunk key, so that of equal scores the first rows win."""
    return rows.take(pc.sort_indices(rows, sort_keys=[(c, "ascending") for c in ("doc_ord", "chunk_index")]))


def best_rows(value: np.ndarray, names: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, question) of the k largest values (whole numbers; negative: no hit) of each question and collection; of equal
    values the first rows win."""
    n = len(value)
    place = np.where(value >= 0, value * n + (n - 1 - np.arange(n))[:, None], -1)
    keep = place >= 0
    for name in set(names):
        rows = np.flatnonzero(names == name)
        if len(rows) > k:
            kth = np.partition(place[rows], len(rows) - k, axis=0)[len(rows) - k]
            keep[rows] &= place[rows] >= kth[None, :]
    return np.nonzero(keep)


def block_scores(keys: pa.Table, x: np.ndarray, valid: np.ndarray, ids: pa.Array, q: np.ndarray, q_valid: np.ndarray, k: int) -> Iterator[pa.Table]:
    """The best k rows of a block (chunk keys, question_id, cosine, distance) for each question."""
    xn, qn = np.linalg.norm(x, axis=1), np.linalg.norm(q, axis=1)
    names = keys.column("collection_name").to_numpy(zero_copy_only=False) if "collection_name" in keys.column_names else np.zeros(len(x))
    step = max(1, CELLS // max(len(q), 1))
    for lo in range(0, len(x), step):
        part = slice(lo, lo + step)
        norms = xn[part, None] * qn[None, :]
        ok = (norms > 0) & valid[part, None] & q_valid[None, :]
        cosine = np.where(ok, (x[part] @ q.T) / np.where(ok, norms, 1.0), 0.0)
        distance = np.round(1.0 - cosine, 6) + 0.0  # no negative zero
        row, question = best_rows(2_000_000 - np.rint(distance * 1e6).astype(np.int64), names[part], k)
        out = keys.slice(lo, step).take(pa.array(row))
        for name, column in (("question_id", ids.take(pa.array(question))), ("cosine", pa.array(cosine[row, question])), ("distance", pa.array(distance[row, question]))):
            out = out.append_column(name, column)
        yield out


def _broadcast_scores(questions: DataFrame, index: DataFrame, vec_col: str, k: int, d: int, schema: T.StructType) -> DataFrame:
    asked = questions.toArrow()  # one block at most
    block = index.sparkSession.sparkContext.broadcast((asked.column(0).combine_chunks(), *matrix(asked.column(1), d)))
    keys = key_columns(index)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = in_key_order(pa.Table.from_batches([batch]))
            for out in block_scores(own.select(keys), *matrix(own.column(vec_col), d), *block.value, k):
                yield from out.to_batches()

    return index.select(*keys, vec_col).mapInArrow(run, schema)


def grid_scores(questions: DataFrame, index: DataFrame, on: list[str], vec_col: str, k: int, d: int, schema: T.StructType) -> DataFrame:
    """Scores of the questions (question_id, qvec, on) and index rows that agree in the ``on`` columns, group by group."""
    keys = key_columns(index)

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        right = in_key_order(right)
        out = list(block_scores(right.select(keys), *matrix(right.column(vec_col), d), left.column("question_id").combine_chunks(), *matrix(left.column("qvec"), d), k)) if left.num_rows else []
        names = [f.name for f in schema.fields]
        return pa.concat_tables(out).select(names) if out else right.select(keys).slice(0, 0).append_column("question_id", left.column("question_id").slice(0, 0)).append_column("cosine", pa.array([], pa.float64())).append_column("distance", pa.array([], pa.float64())).select(names)

    left = questions.select("question_id", "qvec", *on).groupBy(*on)
    right = index.select(*keys, vec_col, *on).groupBy(*on)
    return left.cogroup(right).applyInArrow(run, schema)


def block_of(columns: list[str], blocks: Column | int) -> Column:
    return F.pmod(F.xxhash64(*columns), F.lit(blocks) if isinstance(blocks, int) else blocks).cast("int")


def all_blocks(blocks: Column | int) -> Column:
    """One row for each block number."""
    return F.explode(F.sequence(F.lit(0), (F.lit(blocks) if isinstance(blocks, int) else blocks) - 1))


def question_blocks(n: int, d: int, k: int, question_bytes: int = QUESTION_BYTES) -> int:
    return max(1, math.ceil(n / max(1, min(question_bytes // (8 * max(d, 1)), KEPT_ROWS // max(k, 1)))))


def index_block_rows(d: int, index_bytes: int = INDEX_BYTES) -> int:
    return max(1, index_bytes // (8 * max(d, 1)))


def score_schema(questions: DataFrame, index: DataFrame) -> T.StructType:
    return T.StructType([*index.select(*key_columns(index)).schema.fields, questions.schema["question_id"], *SCORES])


def vector_topk(questions: DataFrame, index: DataFrame, k: int, *, vec_col: str = "embedding", question_vec_col: str = "embedding",
                payload: list[str], max_question_bytes: int = QUESTION_BYTES, index_bytes: int = INDEX_BYTES, plan: str = "auto") -> DataFrame:
    """The k nearest rows per question and collection by cosine distance, with ``payload`` columns, question_id, cosine,
    distance (= round(1 - cosine, 6)) and rank. Ties go to the smaller chunk key; vectors of another dimension, zero
    and null vectors have the distance 1."""
    spark, schema, keys = index.sparkSession, score_schema(questions, index), key_columns(index)
    asked = questions.select("question_id", F.col(question_vec_col).alias("qvec"))
    stats = asked.agg(F.count("*").alias("n"), F.max(F.size("qvec")).alias("d")).first()
    n, d = stats["n"], max(stats["d"] or 0, 0)
    if n == 0 or k <= 0:
        empty = [*index.select(*dict.fromkeys([*keys, *payload])).schema.fields, *schema.fields[len(keys):]]
        return spark.createDataFrame([], T.StructType(empty).add("rank", T.IntegerType()))
    q_blocks = question_blocks(n, d, k, max_question_bytes)
    if plan == "broadcast" or (plan == "auto" and q_blocks == 1):
        partial = _broadcast_scores(asked, index, vec_col, k, d, schema)
    else:
        i_blocks = max(1, math.ceil(index.count() / index_block_rows(d, index_bytes)))
        left = asked.select("*", block_of(["question_id"], q_blocks).alias("_q"), all_blocks(i_blocks).alias("_i"))
        right = index.select(*keys, vec_col, block_of(keys, i_blocks).alias("_i"), all_blocks(q_blocks).alias("_q"))
        partial = grid_scores(left, right, ["_q", "_i"], vec_col, k, d, schema)
    group = ["question_id", *(["collection_name"] if "collection_name" in keys else [])]
    ranked = merged_top_k(partial, group, [F.asc("distance"), F.asc("doc_ord"), F.asc("chunk_index")], k)
    return with_payload(index, ranked, n, k, payload)
