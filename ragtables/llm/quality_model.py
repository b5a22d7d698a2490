"""Quality classifier: random-indexing word vectors, pooled, and a small numpy network.

Units are the maximal runs of letters (bytes above 127 count as letters), of digits and of other visible characters
of a text, ASCII letters in lower case; a run of two or more letters all in ASCII capitals is the unit "capitals".
Units are hashed to ``BUCKETS`` rows. Each bucket has a sparse random index vector; its context vector is the sum of
the index vectors of its neighbours within ``REACH`` units over the training texts (random indexing), reduced to
unit length. A document is pooled to the mean of its units' vectors, the mean over its
distinct units, and the logs of both numbers of units, so that repetition shows. A two-layer network
(tanh, logistic) is fitted by Adam, and its logits are divided by a temperature that minimises the loss on a part of
the training rows kept from the fit.

Word vectors, network and temperature are one classifier, fitted on a bounded sample of labelled rows
(``max_train_rows``, chosen by a hash of doc_id); every document is scored on its whole text. The model's size is
fixed: BUCKETS x DIMS and the network.

Defined results: null and empty texts have no units and get the network's score of the zero vector. Labels other
than 0 and 1 are not learned from. Without labelled rows the score is 0.5; with one class only, it is that class's
share. Repeated rows get equal scores. Extra columns are dropped.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ragtables.llm import textarrays as ta

BUCKETS = 1 << 15
DIMS = 32
POOLED = 2 * DIMS + 3
NONZERO = 4
REACH = 2
HIDDEN = 24
MAX_TRAIN_ROWS = 12_000
SMALL_BLOCK = 1 << 18
SPACE, LETTER, DIGIT, OTHER = range(4)
KIND = np.full(256, OTHER, dtype=np.uint8)
KIND[:33] = SPACE
KIND[127] = SPACE
KIND[128:] = LETTER
KIND[48:58] = DIGIT
KIND[65:91] = LETTER
KIND[97:123] = LETTER
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
CAPITALS = 0  # its bucket


def units(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, document) of the units of a block."""
    kind = KIND[data]
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    cut = np.zeros(n + 1, dtype=bool)
    cut[offs] = True
    cut[1:n] |= kind[1:] != kind[:-1]
    cut[n] = True
    edges = np.flatnonzero(cut)
    starts, ends = edges[:-1], edges[1:]
    keep = kind[starts] != SPACE
    starts, ends = starts[keep], ends[keep]
    bucket = (ta.Substrings(LOWER[data]).hashes(starts, ends) % ta.U64(BUCKETS - 1)).astype(np.int64) + 1
    small = np.concatenate(([0], np.cumsum((data >= 97) & (data <= 122))))
    large = np.concatenate(([0], np.cumsum((data >= 65) & (data <= 90))))
    shout = (small[ends] == small[starts]) & (large[ends] - large[starts] >= 2)
    return np.where(shout, CAPITALS, bucket), ta.owners(offs, starts)


def index_vectors() -> np.ndarray:
    """Sparse random index vectors: NONZERO entries of +1 or -1 in each row."""
    rng = np.random.default_rng(7)
    out = np.zeros((BUCKETS, DIMS), dtype=np.float32)
    at = np.argpartition(rng.random((BUCKETS, DIMS)), NONZERO, axis=1)[:, :NONZERO]
    np.put_along_axis(out, at, rng.choice(np.array([-1, 1], dtype=np.float32), at.shape), axis=1)
    return out


def context_sums(bucket: np.ndarray, owner: np.ndarray, index: np.ndarray) -> np.ndarray:
    """Sum of the neighbours' index vectors for each bucket of a block."""
    near = np.zeros((len(bucket), DIMS), dtype=np.float32)
    for step in range(1, REACH + 1):
        same = (owner[step:] == owner[:-step])[:, None]
        vectors = index[bucket]
        near[step:] += vectors[:-step] * same
        near[:-step] += vectors[step:] * same
    out = np.zeros((BUCKETS, DIMS))
    for j in range(DIMS):
        out[:, j] = np.bincount(bucket, weights=near[:, j], minlength=BUCKETS)
    return out


def word_vectors(texts: DataFrame) -> np.ndarray:
    """Unit-length context vectors of all buckets from column ``text``; a fixed BUCKETS x DIMS matrix."""

    def run(batches):
        index, total = index_vectors(), np.zeros((BUCKETS, DIMS))
        for batch in batches:
            for _, _, b, o in ta.blocks(*ta.text_buffers(batch.column(0)), SMALL_BLOCK):
                bucket, owner = units(b, o)
                if len(bucket):
                    total += context_sums(bucket, owner, index)
        seen = np.flatnonzero(np.abs(total).sum(axis=1))
        columns = [pa.array(seen), *(pa.array(total[seen, j]) for j in range(DIMS))]
        yield pa.RecordBatch.from_arrays(columns, names=["bucket", *(f"c{j}" for j in range(DIMS))])

    schema = "bucket long, " + ", ".join(f"c{j} double" for j in range(DIMS))
    summed = texts.select("text").mapInArrow(run, schema).groupBy("bucket").agg(*(F.sum(f"c{j}").alias(f"c{j}") for j in range(DIMS))).toArrow()
    out = np.zeros((BUCKETS, DIMS))
    if summed.num_rows:
        out[summed.column(0).to_numpy()] = np.stack([summed.column(j + 1).to_numpy() for j in range(DIMS)], axis=1)
    length = np.linalg.norm(out, axis=1, keepdims=True)
    return (out / np.maximum(length, 1e-12)).astype(np.float32)


def means(bucket: np.ndarray, owner: np.ndarray, docs: int, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(mean vector, number) of the units of each document; units are ordered by document."""
    n = np.bincount(owner, minlength=docs)
    out = np.zeros((docs, DIMS), dtype=np.float32)
    begins = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
    out[owner[begins]] = np.add.reduceat(vectors[bucket], begins, axis=0) / n[owner[begins], None]
    return out, n


def pooled(data: np.ndarray, offs: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Pooled row of each document: means over all and over distinct units, logs of their numbers and the difference."""
    out = np.zeros((len(offs) - 1, POOLED), dtype=np.float32)
    for lo, hi, b, o in ta.blocks(data, offs, SMALL_BLOCK):
        bucket, owner = units(b, o)
        if not len(bucket):
            continue
        types = np.unique(owner * BUCKETS + bucket)
        out[lo:hi, :DIMS], n = means(bucket, owner, hi - lo, vectors)
        out[lo:hi, DIMS : 2 * DIMS], distinct = means(types % BUCKETS, types // BUCKETS, hi - lo, vectors)
        out[lo:hi, 2 * DIMS] = np.log1p(n)
        out[lo:hi, 2 * DIMS + 1] = np.log1p(distinct)
        out[lo:hi, 2 * DIMS + 2] = np.log1p(n) - np.log1p(distinct)
    return out


def logits(model: dict, x: np.ndarray) -> np.ndarray:
    hidden = np.tanh((x - model["mean"]) / model["std"] @ model["w1"] + model["b1"])
    return (hidden @ model["w2"] + model["b2"]) / model["temperature"]


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def loss(z: np.ndarray, y: np.ndarray) -> float:
    return float(np.mean(np.logaddexp(0, z) - y * z))


def fit_network(x: np.ndarray, y: np.ndarray, tune: np.ndarray, epochs: int = 60, batch: int = 128, rate: float = 0.01, decay: float = 1e-4) -> dict:
    """Two layers fitted by Adam on the rows outside ``tune``; the temperature is set on the rows inside it."""
    rng = np.random.default_rng(11)
    xs, ys = x[~tune], y[~tune]
    model = {"mean": xs.mean(axis=0), "std": xs.std(axis=0) + 1e-3, "temperature": 1.0}
    xn = (xs - model["mean"]) / model["std"]
    par = {"w1": rng.normal(0, 1 / np.sqrt(x.shape[1]), (x.shape[1], HIDDEN)), "b1": np.zeros(HIDDEN), "w2": rng.normal(0, 1 / np.sqrt(HIDDEN), HIDDEN), "b2": np.zeros(())}
    m, v, t = {k: np.zeros_like(p) for k, p in par.items()}, {k: np.zeros_like(p) for k, p in par.items()}, 0
    for _ in range(epochs):
        order = rng.permutation(len(xn))
        for lo in range(0, len(order), batch):
            rows, t = order[lo : lo + batch], t + 1
            hidden = np.tanh(xn[rows] @ par["w1"] + par["b1"])
            error = (sigmoid(hidden @ par["w2"] + par["b2"]) - ys[rows]) / len(rows)
            back = np.outer(error, par["w2"]) * (1 - hidden**2)
            grad = {"w1": xn[rows].T @ back + decay * par["w1"], "b1": back.sum(axis=0), "w2": hidden.T @ error + decay * par["w2"], "b2": error.sum()}
            for k, g in grad.items():
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.999 * v[k] + 0.001 * g**2
                par[k] = par[k] - rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)
    model |= par
    if tune.any():
        z = logits(model, x[tune])
        scales = np.exp(np.linspace(np.log(0.25), np.log(8), 120))
        model["temperature"] = float(min(scales, key=lambda s: loss(z / s, y[tune])))
    return model


def fit(docs: DataFrame, labels: DataFrame, max_train_rows: int = MAX_TRAIN_ROWS) -> dict:
    """Classifier from documents (doc_id, text) and labels (doc_id, quality); uses at most ``max_train_rows`` labels."""
    chosen = labels.filter(F.col("quality").isin(0, 1)).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).filter("doc_id is not null")
    chosen = chosen.groupBy("doc_id").agg(F.min("quality").alias("quality")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_train_rows)
    # at most max_train_rows ids: a bounded broadcast
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(chosen), "doc_id").persist(StorageLevel.MEMORY_AND_DISK)
    vectors = word_vectors(rows.coalesce(8))
    local = pooled_rows(rows, vectors).toArrow()
    rows.unpersist()
    order = np.lexsort((local.column("doc_id").to_numpy(),))
    y = local.column("quality").to_numpy()[order].astype(np.float64)
    x = np.stack([local.column(f"c{j}").to_numpy()[order] for j in range(POOLED)], axis=1) if len(y) else np.zeros((0, POOLED))
    tune = (ta.mix(local.column("doc_id").to_numpy()[order].view(ta.U64)) % ta.U64(5)) == 0
    if not len(y) or y.min() == y.max() or not (~tune).any():
        return {"constant": float(y.mean()) if len(y) else 0.5}
    return {"vectors": vectors, "network": fit_network(x.astype(np.float64), y, tune)}


def pooled_rows(rows: DataFrame, vectors: np.ndarray) -> DataFrame:
    """doc_id, quality and the pooled vector of each row, as columns."""
    shared = rows.sparkSession.sparkContext.broadcast(vectors)  # fixed size: BUCKETS x DIMS

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        x = pooled(*ta.text_buffers(batch.column(2)), shared.value)
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(x[:, j].astype(np.float64)) for j in range(POOLED))], names=["doc_id", "quality", *(f"c{j}" for j in range(POOLED))])

    return ta.map_arrow(rows.select("doc_id", "quality", "text"), run, "doc_id long, quality int, " + ", ".join(f"c{j} double" for j in range(POOLED)), "text")


def score(docs: DataFrame, model: dict) -> DataFrame:
    """(doc_id, score) of every row of (doc_id, text)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # fixed size

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        model = shared.value
        if "constant" in model:
            out = np.full(batch.num_rows, model["constant"])
        else:
            out = sigmoid(logits(model["network"], pooled(*ta.text_buffers(batch.column(1)), model["vectors"]).astype(np.float64)))
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(out)], names=["doc_id", "score"])

    return ta.map_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, "doc_id long, score double", "text")


def fold(parts: int = 3) -> Column:
    """crc32 of doc_id as text, modulo ``parts``; a null id is in fold 0."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % parts, F.lit(0))


def quality_scores(docs: DataFrame, labels: DataFrame, max_train_rows: int = MAX_TRAIN_ROWS) -> DataFrame:
    """doc_id, held_out, score, predicted: learned from labels outside fold 1 of 3, applied to every document."""
    model = fit(docs, labels.filter(fold() != 1), max_train_rows)
    return score(docs, model).select("doc_id", (fold() == 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
