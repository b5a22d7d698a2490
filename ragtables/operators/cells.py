"""Vector search over cells (R5): exact by the triangle inequality, or the nearest ``nprobe`` cells only.

KMeans cells (fitted on a bounded sample, assigned to every row) have a centroid, a radius and a size. Angles between
vectors are a metric, so every vector of a cell is at least (angle to the centroid - radius) from a question.

* ``nprobe``: each question meets the rows of its ``nprobe`` nearest cells.
* exact (``nprobe=None``): the same for the first ``FIRST`` cells, then for all other cells that can hold a row as near
  as the k-th found so far. The result is that of a full search; only the visited share differs.

Questions and rows meet by an equi-join on the cell, cut in blocks on both sides (see ``vector_search``), so a cell that
holds a third of all rows is many tasks. ``cell`` is a partition column of a stored index (``write_cells``). Rows whose
vector is null, zero or of another dimension have the distance 1 to everything and are cell ``NO_VECTOR``.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans, KMeansModel
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.vectors import cosine, l2_normalize
from ..plans.checkpoints import cut
from ..plans.joins import join_small
from ..plans.topk import top_k
from .vector_search import all_blocks, block_of, grid_scores, index_block_rows, key_columns, matrix, merged_top_k, question_blocks, score_schema, with_payload

NO_VECTOR = -1
#: Cells that are visited before others are ruled out, and rows that the cells are fitted on at most (about).
FIRST, SAMPLE_ROWS = 4, 100_000
#: Most cells: their centroids are broadcast (4096 x 1024 doubles are 32 MB).
MOST_CELLS = 4096
#: Distances are rounded to six digits, so bounds leave room for half a unit and for rounding errors.
ROUNDING = 1e-6


class CellIndex(NamedTuple):
    """Index rows with their ``cell``, and (cell, centroid, radius, n) of the cells."""

    rows: DataFrame
    cells: DataFrame
    vec_col: str = "embedding"


def _usable(vec_col: str, d: int):
    v = F.col(vec_col)
    return F.coalesce((F.size(v) == d) & F.exists(v, lambda x: x != 0), F.lit(False))


def fit_cells(index: DataFrame, cells: int, d: int, *, vec_col: str = "embedding", seed: int = 1, sample_rows: int = SAMPLE_ROWS) -> KMeansModel:
    """KMeans by cosine on about ``sample_rows`` rows, chosen by a hash of the chunk key."""
    fine = index.filter(_usable(vec_col, d))
    n = fine.count()
    share = F.pmod(F.xxhash64(*key_columns(index)), F.lit(1 << 30)) < F.lit(int((1 << 30) * min(1.0, sample_rows / max(n, 1))))
    sample = fine.filter(share).select(array_to_vector(l2_normalize(vec_col).cast("array<double>")).alias("features"))
    return KMeans(k=min(cells, MOST_CELLS), seed=seed, distanceMeasure="cosine", initSteps=2).fit(sample)


def build_cells(index: DataFrame, cells: int, *, vec_col: str = "embedding", seed: int = 1, sample_rows: int = SAMPLE_ROWS) -> CellIndex:
    """Every row with the cell of its vector, and the cells with their radii."""
    spark = index.sparkSession
    d = index.agg(F.max(F.size(vec_col))).first()[0] or 0
    model = fit_cells(index, cells, d, vec_col=vec_col, seed=seed, sample_rows=sample_rows)
    centers = spark.createDataFrame([(i, [float(x) for x in c]) for i, c in enumerate(model.clusterCenters())], "cell int, centroid array<double>")
    fine = _usable(vec_col, d)
    vectors = index.filter(fine).withColumn("_unit", array_to_vector(l2_normalize(vec_col).cast("array<double>")))
    placed = model.setFeaturesCol("_unit").setPredictionCol("cell").transform(vectors).drop("_unit")
    rest = index.filter(~fine).withColumn("cell", F.lit(NO_VECTOR))
    rows = placed.unionByName(rest)
    angle = F.acos(F.least(F.lit(1.0), F.greatest(F.lit(-1.0), cosine("centroid", vec_col))))
    # at most MOST_CELLS centroids
    sized = placed.select("cell", vec_col).join(F.broadcast(centers), "cell").groupBy("cell").agg(F.max(angle).alias("radius"), F.count("*").alias("n"))
    none = rest.agg(F.count("*").alias("n")).filter("n > 0").select(F.lit(NO_VECTOR).alias("cell"), F.lit(None).cast("array<double>").alias("centroid"), F.lit(0.0).alias("radius"), "n")
    return CellIndex(rows, cut(centers.join(sized, "cell").select("cell", "centroid", "radius", "n").unionByName(none)), vec_col)


def write_cells(index: CellIndex, path: str) -> None:
    """Store the rows by cell, and the cells."""
    index.rows.repartition("cell", block_of(key_columns(index.rows), 16)).write.mode("overwrite").partitionBy("cell").parquet(f"{path}/rows")
    index.cells.write.mode("overwrite").parquet(f"{path}/cells")


def read_cells(spark: SparkSession, path: str, vec_col: str = "embedding") -> CellIndex:
    return CellIndex(spark.read.parquet(f"{path}/rows"), spark.read.parquet(f"{path}/cells"), vec_col)


def cell_bounds(questions: DataFrame, index: CellIndex) -> DataFrame:
    """(question_id, qvec, cell, order, least): the cells by their distance from each question (0 the nearest), and the
    least cosine distance that a row of the cell can have."""
    cells = index.cells.orderBy("cell").toArrow()  # at most MOST_CELLS rows
    numbers = cells.column("cell").to_numpy()
    d = max([len(c) for c in cells.column("centroid").to_pylist() if c is not None], default=0)
    centers, real = matrix(cells.column("centroid").cast(pa.list_(pa.float64())), d)
    shared = index.rows.sparkSession.sparkContext.broadcast((numbers, centers, real, cells.column("radius").to_numpy()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers, centers, real, radius = shared.value
        for batch in batches:
            q, valid = matrix(batch.column(1), centers.shape[1])
            norm = np.linalg.norm(q, axis=1, keepdims=True) * np.linalg.norm(centers, axis=1)
            angle = np.arccos(np.clip((q @ centers.T) / np.where(norm > 0, norm, 1), -1, 1))
            least = 1 - np.cos(np.maximum(angle - radius - 1e-9, 0))
            # a question without a direction, and rows without one, are at distance 1 from everything
            least = np.where((valid & (norm.max(axis=1, initial=0) > 0))[:, None] & real, least, 1.0)
            order = np.argsort(np.argsort(np.where(real, angle, 4.0), axis=1, kind="stable"), axis=1)
            at = np.repeat(np.arange(len(q)), len(numbers))
            yield pa.RecordBatch.from_arrays([*batch.take(pa.array(at)).columns, pa.array(np.tile(numbers, len(q)).astype(np.int32)), pa.array(order.reshape(-1).astype(np.int32)), pa.array(least.reshape(-1))],
                                             names=["question_id", "qvec", "cell", "order", "least"])

    schema = questions.select("question_id", "qvec").schema.add("cell", T.IntegerType()).add("order", T.IntegerType()).add("least", T.DoubleType())
    return questions.select("question_id", "qvec").mapInArrow(run, schema)


class CellHits(NamedTuple):
    """Hits as of ``vector_topk``, and (question_id, cells_visited, rows_visited, share) of the search."""

    hits: DataFrame
    visits: DataFrame


def cell_topk(questions: DataFrame, index: CellIndex, k: int, *, question_vec_col: str = "embedding", nprobe: int | None = None,
              payload: list[str] | None = None, first: int = FIRST) -> CellHits:
    """The k nearest rows per question (and collection); exact without ``nprobe``."""
    rows, vec_col = index.rows, index.vec_col
    keys, schema = key_columns(rows), score_schema(questions, rows)
    asked = questions.select("question_id", F.col(question_vec_col).cast("array<double>").alias("qvec"))
    stats = asked.agg(F.count("*").alias("n"), F.max(F.size("qvec")).alias("d")).first()
    n, d = stats["n"], max(stats["d"] or 0, 0)
    q_blocks, per_block = question_blocks(n, d, k), index_block_rows(d)
    blocks = index.cells.select("cell", F.ceil(F.col("n") / per_block).cast("int").alias("blocks"))
    bounds = cut(cell_bounds(asked, index))
    # by cell: at most MOST_CELLS rows
    right = rows.select(*keys, vec_col, "cell").join(F.broadcast(blocks), "cell").select(*keys, vec_col, "cell", block_of(keys, F.col("blocks")).alias("_i"), all_blocks(q_blocks).alias("_q"))
    group = ["question_id", *(["collection_name"] if "collection_name" in keys else [])]
    order = [F.asc("distance"), F.asc("doc_ord"), F.asc("chunk_index")]

    def scores(visited: DataFrame) -> DataFrame:
        left = visited.join(F.broadcast(blocks), "cell").select("question_id", "qvec", "cell", block_of(["question_id"], q_blocks).alias("_q"), all_blocks(F.col("blocks")).alias("_i"))
        return grid_scores(left, right, ["cell", "_i", "_q"], vec_col, k, d, schema)

    visited = bounds.filter(F.col("order") < (nprobe or first))
    partial = scores(visited)
    if nprobe is None:
        partial = cut(merged_top_k(partial, group, order, k).drop("rank"))
        names = rows.select("collection_name").distinct().count() if "collection_name" in keys else 1
        kth = partial.groupBy(*group).agg(F.count("*").alias("found"), F.max("distance").alias("far"))
        kth = kth.groupBy("question_id").agg(F.count("*").alias("groups"), F.min("found").alias("found"), F.max("far").alias("far"))
        full = (F.col("found") >= k) & (F.col("groups") >= names)  # else nothing can be ruled out
        more = join_small(bounds.filter(F.col("order") >= first), kth, "question_id", "left")
        more = more.filter(F.coalesce(~full | (F.col("least") <= F.col("far") + ROUNDING), F.lit(True))).select(bounds.columns)
        partial, visited = partial.unionByName(scores(more)), visited.unionByName(more)
    ranked = merged_top_k(partial, group, order, k)
    total = index.cells.agg(F.sum("n")).first()[0] or 0
    visits = visited.join(F.broadcast(index.cells.select("cell", "n")), "cell").groupBy("question_id").agg(F.count("*").alias("cells_visited"), F.sum("n").alias("rows_visited"))
    visits = visits.withColumn("share", F.col("rows_visited") / F.lit(max(total, 1)))
    return CellHits(with_payload(rows, ranked, n, k, payload or [c for c in rows.columns if c not in (vec_col, "cell")]), visits)
