"""Embed a text column with a user-supplied model, in batches, one model per Python worker."""

from __future__ import annotations

from typing import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.vectors import l2_normalize


def embed(
    df: DataFrame,
    text_col: str,
    make_model: Callable[[], Callable[[np.ndarray], np.ndarray]],
    *,
    out_col: str = "embedding",
    batch_size: int = 32,
    normalize: bool = False,
) -> DataFrame:
    """Add ``out_col`` = model vectors of ``text_col``.

    ``make_model()`` is called once per Python worker and returns ``predict(texts) -> (n, dim)``;
    Spark feeds it Arrow batches of ``batch_size`` texts (``predict_batch_udf``). ``normalize`` applies
    E4 (local sentence models normalise their output).
    """
    from pyspark.ml.functions import predict_batch_udf

    def make_predict_fn():
        model = make_model()

        def predict(texts: np.ndarray) -> np.ndarray:
            return np.asarray(model(texts), dtype=np.float32)

        return predict

    udf = predict_batch_udf(make_predict_fn, return_type=T.ArrayType(T.FloatType()), batch_size=batch_size)
    out = df.withColumn(out_col, udf(F.col(text_col)))
    return out.withColumn(out_col, l2_normalize(out_col)) if normalize else out


def hash_model(dim: int = 64, unit: bool = False) -> Callable[[np.ndarray], np.ndarray]:
    """Offline model with the E2 rule (md5 buckets of R1 tokens, counts), for tests and the bench.

    ``unit``: E2 itself, vectors of length 1 in single precision. Buckets of tokens are remembered per worker, at most ``KNOWN_TOKENS`` of them.
    """
    import hashlib
    import re

    word, cjk, known = re.compile(r"[a-zA-Z0-9_]+"), re.compile("[\u4e00-\u9fff]"), {}

    def bucket(token: str) -> int:
        if token not in known:
            if len(known) >= KNOWN_TOKENS:
                known.clear()
            known[token] = int(hashlib.md5(token.encode("utf-8")).hexdigest()[:7], 16) % dim
        return known[token]

    def predict(texts: np.ndarray) -> np.ndarray:
        out = np.zeros((len(texts), dim), dtype=np.float64)
        for i, t in enumerate(texts):
            low = str(t).lower()
            tokens = [bucket(token) for token in word.findall(low) + cjk.findall(low)]
            if tokens:
                out[i] = np.bincount(tokens, minlength=dim)
        if not unit:
            return out
        length = np.linalg.norm(out, axis=1, keepdims=True)
        return (out / np.where(length > 0, length, 1.0)).astype(np.float32)

    return predict


def hash_vectors() -> Callable[[np.ndarray], np.ndarray]:
    """The E2 model, the default of semantic chunking."""
    return hash_model(unit=True)


KNOWN_TOKENS = 500_000
_MODELS: dict = {}


def _worker_model(key, make_model: Callable) -> Callable:
    """One model per Python worker and make function."""
    if key not in _MODELS:
        _MODELS.clear()
        _MODELS[key] = make_model()
    return _MODELS[key]


def hash_embed_arrow(col, dim: int = 64):
    """E2 over Arrow batches (numpy), equal to the native ``functions.vectors.hash_embed``; used for
    bulk embedding of an index, where the native form runs ``dim`` interpreted lambdas per text."""

    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def run(s: pd.Series) -> pd.Series:
        model = _worker_model(("hash", dim), lambda: hash_model(dim, unit=True))
        there = s.notna().to_numpy()
        out = np.full(len(s), None, dtype=object)
        for i, row in zip(np.flatnonzero(there), model(s[there].to_numpy()).astype(np.float32), strict=True):
            out[i] = row
        return pd.Series(out, dtype=object)

    return run(F.col(col) if isinstance(col, str) else col)


def previous_similarity(make_model: Callable[[], Callable], batch_size: int = 32):
    """Column function: array of sentences -> cosine similarity of each to the sentence before it (0 for the first).

    The sentences of all documents of an Arrow batch are embedded together, ``batch_size`` at a time.
    """
    import uuid

    key = uuid.uuid4().hex  # a model for each plan

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def run(s: pd.Series) -> pd.Series:
        model = _worker_model(key, make_model)
        counts = s.map(lambda x: 0 if x is None else len(x)).to_numpy().astype(int)
        texts = np.array([t for x in s if x is not None for t in x], dtype=object)
        parts = [np.asarray(model(texts[i : i + batch_size]), dtype=np.float64) for i in range(0, len(texts), batch_size)]
        if any(len(p) != len(texts[i * batch_size : (i + 1) * batch_size]) for i, p in enumerate(parts)):
            raise ValueError("the model must give one vector for each text")
        sims = np.zeros(len(texts))
        if len(texts) > 1:
            v = np.concatenate(parts)
            length = np.linalg.norm(v, axis=1)
            both = length[1:] * length[:-1]
            sims[1:] = np.where(both > 0, (v[1:] * v[:-1]).sum(axis=1) / np.where(both > 0, both, 1), 0.0)
        ends = np.cumsum(counts)
        sims[(ends - counts)[counts > 0]] = 0.0
        out = np.empty(len(s), dtype=object)
        for i, (end, n, x) in enumerate(zip(ends, counts, s, strict=True)):
            out[i] = None if x is None else sims[end - n : end]
        return pd.Series(out, dtype=object)

    return run
