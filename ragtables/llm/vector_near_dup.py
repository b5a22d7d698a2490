"""Near duplicates of embeddings by collision-counting projections.

Vectors of one label and dimension are linked if their cosine is at least ``threshold``. Each vector is projected on many
random lines. The line of a table is cut into cells by the signs of further projections, and the points of a cell are
sorted along the line. A query's window of ``width`` to either side of it holds the points that collide with it. Pairs
that collide in at least ``least`` tables are verified by their cosine in double precision. The number of sign bits
follows the largest label (a few unlike vectors per cell, at any size); the number of tables follows from the
probabilities of a pair at the threshold, so that it is found with probability ``RECALL`` or more. Pairs that are closer
are found with a larger one (cosine 0.97: above 0.9999).

Many alike vectors do not make all pairs. Cells with many points give centroids, and the vectors within half of the
threshold's angle of one form a knot: by the triangle inequality all of them are linked, so they are counted, not
compared. A knot is then one node of the search, in all cells of its members. Two nodes with centroid distance d and
radii r, s are linked throughout if d + r + s is within the angle and not at all if d - r - s is beyond it; other pairs
of nodes are compared vector by vector, in blocks. So n_links is exact for all node pairs found, and nothing is capped.

Defined results: one row per input row; a null label or a vector that is null, empty, zero or holds null or non-finite
components has no links; vectors of unequal dimension are not linked; rows that repeat a vec_id are vectors of their
own; component_id is the smallest non-null vec_id that is reached, kept is null-safe equality with vec_id. Extra
columns are dropped; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from ragtables.llm import textarrays as ta
from ragtables.llm.near_dup import components
from ragtables.llm.storage import cut

THRESHOLD = 0.93
RECALL = 0.995
LEAST = 2
#: Unlike vectors of one label that a cell holds on average, and the most sign bits of a cell.
PER_CELL, MOST_BITS = 4, 48
#: Half width of a window, in standard deviations of the projected distance at the threshold.
DEVIATIONS = 2.2
#: Tables in which dense cells are looked for, points that make a cell dense, vectors in a block of two knots.
DENSE_TABLES, DENSE, BLOCK = 4, 32, 256
MARGIN = 1e-6
SEED = 20240612


class Plan(NamedTuple):
    """Sign bits of a cell, tables, half width of a window, collisions that make a candidate, angle of the threshold."""

    bits: int
    tables: int
    width: float
    least: int
    angle: float


def calibrated(largest: int, threshold: float = THRESHOLD, recall: float = RECALL, least: int = LEAST) -> Plan:
    """The plan for labels of at most ``largest`` vectors, by which a pair at the threshold is found often enough."""
    angle, chord = math.acos(threshold), math.sqrt(2 - 2 * threshold)
    bits = min(MOST_BITS, max(0, math.ceil(math.log2(max(largest, 1) / PER_CELL))))
    p = (1 - angle / math.pi) ** bits * math.erf(DEVIATIONS / math.sqrt(2))
    tables = least
    while sum(math.comb(tables, i) * p**i * (1 - p) ** (tables - i) for i in range(least)) > 1 - recall:
        tables += 1
    return Plan(bits, tables, DEVIATIONS * chord, least, angle)


def by_dimension(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, unit vectors) of each dimension of a list column without nulls."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    offs, flat = column.offsets.to_numpy(), column.values.to_numpy(zero_copy_only=False).astype(np.float64)
    sizes = np.diff(offs)
    for d in np.unique(sizes):
        rows = np.flatnonzero(sizes == d)
        x = flat[offs[:-1][rows, None] + np.arange(d)]
        x = x / np.abs(x).max(axis=1, keepdims=True)
        yield rows, x / np.linalg.norm(x, axis=1, keepdims=True)


def vector_list(x: np.ndarray) -> pa.Array:
    n, d = x.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(0, (n + 1) * d, d, dtype=np.int32)), pa.array(x.reshape(-1)))


def usable(vectors: DataFrame) -> DataFrame:
    """(row, vec_id, label, dim, embedding) of every row; label is null where the row can have no links."""
    e = F.col("embedding")
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    fine = e.isNotNull() & (F.size(e) > 0) & F.forall(e, finite) & F.exists(e, lambda x: x != 0)
    rows = vectors.select("vec_id", "embedding", "label").withColumn("row", F.monotonically_increasing_id())
    label = F.when(F.coalesce(fine, F.lit(False)), F.col("label"))
    return cut(rows.select("row", "vec_id", label.alias("label"), F.size(e).alias("dim"), "embedding"))


def points(rows: DataFrame, plan: Plan, tables: int) -> DataFrame:
    """(row, node, tight, bucket, v): the cell and the place on the line of each vector in the first ``tables`` tables."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, node, tight, group = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(4))
            for at, x in by_dimension(batch.column(4)):
                lines = np.random.default_rng([SEED, x.shape[1]]).standard_normal((x.shape[1], plan.tables, plan.bits + 1))
                for t in range(tables):
                    p = x @ lines[:, t]
                    cell = (p[:, 1:] > 0).astype(ta.U64) @ (ta.U64(1) << np.arange(plan.bits, dtype=ta.U64)) if plan.bits else np.zeros(len(x), ta.U64)
                    bucket = ta.mix(ta.mix(group[at].view(ta.U64) + ta.U64(t)) + cell)
                    yield pa.RecordBatch.from_arrays([pa.array(keys[at]), pa.array(node[at]), pa.array(tight[at]), pa.array(bucket.view(np.int64)), pa.array(p[:, 0])], names=["row", "node", "tight", "bucket", "v"])

    ta.bounded_batches(rows.sparkSession)
    group = F.xxhash64(F.col("label").cast("string"), "dim").alias("grp")
    return rows.filter("label is not null").select("row", "node", "tight", group, "embedding").mapInArrow(run, "row long, node long, tight boolean, bucket long, v double")


KNOT = ["label", "dim", "cell"]


def centroids(own: DataFrame) -> DataFrame:
    """(label, dim, cell, center): the mean direction of the vectors of each dense cell."""
    schema = own.select(*KNOT).schema.add("s", ArrayType(DoubleType()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.select(KNOT)
            for at, x in by_dimension(batch.column(batch.schema.get_field_index("embedding"))):
                cell = names.column(2).to_numpy()[at]
                _, first, number = np.unique(cell, return_index=True, return_inverse=True)
                total = np.zeros((len(first), x.shape[1]))
                np.add.at(total, number, x)
                yield pa.RecordBatch.from_arrays([*names.take(pa.array(at[first])).columns, vector_list(total)], names=[*KNOT, "s"])

    parts = own.select(*KNOT, "embedding").mapInArrow(run, schema).select(*KNOT, F.posexplode("s").alias("i", "s"))
    sums = parts.groupBy(*KNOT, "i").agg(F.sum("s").alias("s"))
    return sums.groupBy(*KNOT).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "s"))), lambda x: x["s"]).alias("center"))


def knots(rows: DataFrame, plan: Plan) -> tuple[DataFrame, DataFrame]:
    """(row, node) of the vectors in knots, and (node, center, radius, label, dim) of the knots."""
    alone = rows.withColumn("node", F.col("row")).withColumn("tight", F.lit(False))
    seen = points(alone, plan, min(DENSE_TABLES, plan.tables)).select("row", "bucket")
    dense = seen.groupBy("bucket").agg(F.count("*").alias("n")).filter(F.col("n") >= DENSE)
    cell = F.max(F.struct("n", "bucket")).alias("best")
    chosen = seen.join(dense, "bucket").groupBy("row").agg(cell).select("row", F.col("best.bucket").alias("cell"))
    own = cut(rows.join(chosen, "row").select("row", *KNOT, "embedding"))
    middle = cut(centroids(own).filter(F.exists("center", lambda x: x != 0)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            angle = np.zeros(batch.num_rows)
            for (at, x), (_, y) in zip(by_dimension(batch.column(4)), by_dimension(batch.column(5)), strict=True):
                angle[at] = angles(x, y)
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(angle)], names=["row", *KNOT, "angle"])

    schema = own.select("row", *KNOT).schema.add("angle", "double")
    near = own.join(middle, KNOT).select("row", *KNOT, "embedding", "center").mapInArrow(run, schema)
    near = cut(near.filter(F.col("angle") <= plan.angle / 2 - MARGIN))
    made = near.groupBy(*KNOT).agg(F.min("row").alias("node"), F.max("angle").alias("radius"))
    made = cut(made.join(middle, KNOT).select("node", "label", "dim", "cell", "center", "radius"))
    return near.join(made.select("node", *KNOT), KNOT).select("row", "node"), made.drop("cell")


def angles(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(np.einsum("ij,ij->i", x, y), -1, 1))


def window_pairs(placed: DataFrame, width: float) -> DataFrame:
    """(a, b): the nodes of each pair of points (bucket, v, slack, node) of a bucket that lie in each other's window."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        for batch in batches:
            new = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(4)]
            first = len(held[0]) if held else 0  # pairs of held points are out already
            bucket, v, slack, node = [np.concatenate(x) for x in zip(held, new, strict=True)] if held else new
            for step in range(1, len(v)):
                there = np.arange(max(0, first - step), len(v) - step)
                there = there[(bucket[there] == bucket[there + step]) & (v[there + step] - v[there] <= width * 1.5)]
                if not len(there):
                    break
                met = there[v[there + step] - v[there] <= width + slack[there] + slack[there + step]]
                a, b = np.minimum(node[met], node[met + step]), np.maximum(node[met], node[met + step])
                yield pa.RecordBatch.from_arrays([pa.array(a[a < b]), pa.array(b[a < b])], names=["a", "b"])
            open_ = (bucket == bucket[-1:]) & (v >= v[-1:] - width * 1.5) if len(v) else np.zeros(0, bool)
            held = [x[open_] for x in (bucket, v, slack, node)]

    sorted_ = placed.select("bucket", "v", "slack", "node").repartition("bucket").sortWithinPartitions("bucket", "v", "node")
    return sorted_.mapInArrow(run, "a long, b long")


def candidates(rows: DataFrame, plan: Plan) -> DataFrame:
    """(a, b): pairs of nodes that collide in enough tables. A knot has a point in each quarter of a window it touches."""
    placed, grid = points(rows, plan, plan.tables), plan.width / 4
    single = placed.filter("not tight").select("bucket", "v", F.lit(0.0).alias("slack"), "node")
    knot = placed.filter("tight").groupBy("bucket", "node", F.floor(F.col("v") / grid).alias("part")).agg(F.min("v").alias("v"))
    pairs = window_pairs(single.unionByName(knot.select("bucket", "v", F.lit(grid).alias("slack"), "node")), plan.width)
    return pairs.groupBy("a", "b").agg(F.count("*").alias("n")).filter(F.col("n") >= plan.least).select("a", "b")


LINKED, DOUBT = 1, 2


def verified(pairs: DataFrame, rows: DataFrame, made: DataFrame, plan: Plan, threshold: float) -> DataFrame:
    """(a, b, kind) of the pairs of nodes that are linked throughout, or of which some vectors may be linked."""
    single = rows.filter("label is not null and not tight").select("node", "label", "dim", F.col("embedding").cast("array<double>").alias("center"), F.lit(-1.0).alias("radius"))
    info = single.unionByName(made.select(single.columns))
    side = lambda name: info.select(F.col("node").alias(name), *(F.col(c).alias(f"{name}_{c}") for c in info.columns[1:]))
    both = pairs.join(side("a"), "a").join(side("b"), "b").filter("a_label = b_label and a_dim = b_dim")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            r, s = batch.column(3).to_numpy(), batch.column(5).to_numpy()
            cosine = np.zeros(batch.num_rows)
            for (at, x), (_, y) in zip(by_dimension(batch.column(2)), by_dimension(batch.column(4)), strict=True):
                cosine[at] = np.einsum("ij,ij->i", x, y)
            single, d, reach = (r < 0) & (s < 0), np.arccos(np.clip(cosine, -1, 1)), np.maximum(r, 0) + np.maximum(s, 0)
            linked = np.where(single, cosine >= threshold, d + reach <= plan.angle - MARGIN)
            doubt = ~single & ~linked & (d - reach <= plan.angle + MARGIN)
            kind = np.where(linked, LINKED, np.where(doubt, DOUBT, 0)).astype(np.int32)
            out = pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(kind)], names=["a", "b", "kind"])
            yield out.filter(pa.array(kind > 0))

    return both.select("a", "b", "a_center", "a_radius", "b_center", "b_radius").mapInArrow(run, "a long, b long, kind int")


def compared(doubt: DataFrame, rows: DataFrame, nodes: DataFrame, threshold: float) -> DataFrame:
    """(a, b, row, n): the links of each vector between two nodes, by blocks of their vectors."""
    wanted = doubt.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    sized = rows.join(wanted, "node").join(nodes.select("node", "size"), "node")
    block = F.pmod(F.xxhash64("row"), F.ceil(F.col("size") / BLOCK)).alias("block")
    blocks = sized.groupBy("node", block).agg(F.collect_list(F.struct("row", F.col("embedding").cast("array<double>").alias("e"))).alias("own"))
    side = lambda name: blocks.select(F.col("node").alias(name), F.col("own").alias(f"{name}_own"))
    met = doubt.select("a", "b").join(side("a"), "a").join(side("b"), "b").select("a", "b", "a_own", "b_own")

    def vectors(lists: pa.ListArray, i: int) -> tuple[np.ndarray, np.ndarray]:
        lo, hi = (lists.offsets[i + j].as_py() for j in (0, 1))
        own = lists.values.slice(lo, hi - lo)
        return own.field("row").to_numpy(), next(by_dimension(own.field("e")))[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                (left, x), (right, y) = vectors(batch.column(2), i), vectors(batch.column(3), i)
                near = x @ y.T >= threshold
                keys, n = np.concatenate([left, right]), np.concatenate([near.sum(axis=1), near.sum(axis=0)])
                some = np.flatnonzero(n)
                pair = [pa.array(np.full(len(some), batch.column(j)[i].as_py(), np.int64)) for j in (0, 1)]
                yield pa.RecordBatch.from_arrays([*pair, pa.array(keys[some]), pa.array(n[some].astype(np.int64))], names=["a", "b", "row", "n"])

    return met.mapInArrow(run, "a long, b long, row long, n long")


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row of (vec_id, embedding, label)."""
    vec_type = vectors.schema["vec_id"].dataType
    rows = usable(vectors)
    largest = rows.filter("label is not null").groupBy("label", "dim").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0]
    plan = calibrated(largest or 0, threshold, recall)
    inside, made = knots(rows, plan)
    rows = rows.join(inside, "row", "left").withColumn("tight", F.col("node").isNotNull()).withColumn("node", F.coalesce("node", "row"))
    rows = cut(rows)
    links = cut(verified(candidates(rows, plan), rows, made, plan, threshold))
    nodes = rows.groupBy("node").agg(F.count("*").alias("size"), F.min("vec_id").alias("low"))
    met = cut(compared(links.filter(F.col("kind") == DOUBT), rows, nodes, threshold))
    linked = links.filter(F.col("kind") == LINKED).select("a", "b")
    edges = linked.unionByName(met.select("a", "b").distinct())
    found = edges.count()
    roots = components(edges, found) if found else edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    other = linked.unionByName(linked.select(F.col("b").alias("a"), F.col("a").alias("b"))).join(nodes.select(F.col("node").alias("b"), "size"), "b")
    sure = other.groupBy("a").agg(F.sum("size").alias("sure")).withColumnRenamed("a", "node")
    named = nodes.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    named = named.join(named.groupBy("root").agg(F.min("low").alias("component_id")), "root").join(sure, "node", "left")
    single = met.groupBy("row").agg(F.sum("n").alias("some"))
    out = rows.select("row", "vec_id", "node", "tight").join(named.select("node", "size", "component_id", "sure"), "node").join(single, "row", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long")
    n_links = F.when(F.col("tight"), F.col("size") - 1).otherwise(0) + zero("sure") + zero("some")
    return out.select(F.col("vec_id").cast(vec_type).alias("vec_id"), n_links.cast("long").alias("n_links"), "component_id", F.col("vec_id").eqNullSafe(F.col("component_id")).alias("kept"))
