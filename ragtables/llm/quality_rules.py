"""Quality rules with risk-controlled thresholds.

Word and line statistics are taken of every whole text. Each rule rejects a document whose statistic lies above a
cutoff. Cutoffs are chosen per stratum (language) from labelled holdouts: from the most lenient cutoff to stricter
ones, a cutoff is certified while the exact binomial tail P(Bin(n, alpha) <= rejected good documents) stays at or
below the level; the first failure ends the sequence (fixed-sequence testing needs no further correction within a
rule). The level is ``delta`` divided by rules x strata (Bonferroni), and ``alpha`` is ``max_false_rejection``
divided by the number of rules, so with probability 1 - delta no stratum loses more than ``max_false_rejection``
of its good documents to the learned rules. A stratum with too few good documents certifies nothing and rejects
nothing.

Defined results: null text is an empty text; a null stratum is a stratum of its own; labels of 1 are good, others
and null are not used, nor are documents with labels of 1 and others; a document counts once for the cutoffs, however
often its label or its row is repeated (of rows that share only the doc_id, the least); every row is judged; extra columns are dropped; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ragtables.llm import textarrays as ta

WINDOW = 5
STATS = "doc_id long, stratum string, n_words long, word_chars long, n_symbols long, n_lines long, n_dup_lines long, n_repeat_words long, n_upper long, n_letters long"
#: Characters counted by n_symbols: #*$%&|<>
SYMBOLS = np.zeros(256, dtype=bool)
SYMBOLS[[ord(c) for c in "#*$%&|<>"]] = True
#: Steps of the cutoff grid of the ratios: 0/200 to 200/200.
GRID = 200


def block_stats(data: np.ndarray, offs: np.ndarray) -> dict[str, np.ndarray]:
    """Statistics of each document of a block."""
    docs = len(offs) - 1
    starts, ends = ta.words(data, offs)
    bounds = ta.per_document(starts, offs)
    counts = np.diff(bounds)
    subs = ta.Substrings(data)
    owner = np.repeat(np.arange(docs), counts)
    lead = (data & 0xC0) != 0x80
    out = {"n_words": counts}
    upto = partial(ta.sums, bounds=offs)
    out["word_chars"] = upto(lead & ~ta.SPACE[data])
    out["n_symbols"] = upto(SYMBOLS[data])
    out["n_upper"] = upto((data >= 65) & (data <= 90))
    out["n_letters"] = out["n_upper"] + upto((data >= 97) & (data <= 122))
    # lines that hold a word
    line_starts, line_ends = ta.runs(data != 10, offs)
    held = np.searchsorted(starts, line_ends) > np.searchsorted(starts, line_starts)
    line_starts, line_ends = line_starts[held], line_ends[held]
    line_owner = ta.owners(offs, line_starts)
    out["n_lines"] = np.bincount(line_owner, minlength=docs)
    key = ta.mix(subs.hashes(line_starts, line_ends) + line_owner.astype(ta.U64) * ta.U64(ta.BASE))
    _, firsts = np.unique(key, return_index=True)
    out["n_dup_lines"] = out["n_lines"] - np.bincount(line_owner[firsts], minlength=docs)
    # words in windows found twice or more
    windows = ta.window_hashes(subs.hashes(starts, ends), WINDOW)
    own = owner[: len(windows)]
    inside = own == owner[WINDOW - 1 :] if len(windows) else own.astype(bool)
    at = np.flatnonzero(inside)
    key = ta.mix(windows[at] + own[at].astype(ta.U64) * ta.U64(ta.BASE))
    _, inverse, times = np.unique(key, return_inverse=True, return_counts=True)
    again = at[times[inverse] > 1] if len(at) else at
    step = np.bincount(again, minlength=len(starts) + WINDOW + 1) - np.bincount(again + WINDOW, minlength=len(starts) + WINDOW + 1)
    out["n_repeat_words"] = np.bincount(owner, weights=np.cumsum(step)[: len(starts)] > 0, minlength=docs).astype(np.int64)
    return out


def text_stats(docs: DataFrame) -> DataFrame:
    """doc_id, stratum and the statistics of ``text`` of each row of (doc_id, stratum, text)."""
    schema = pa.schema([(f.split()[0], pa.string() if f.endswith("string") else pa.int64()) for f in STATS.split(", ")])

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        data, offs = ta.text_buffers(batch.column(2))
        parts = [block_stats(b, o) for _, _, b, o in ta.blocks(data, offs)]
        columns = [batch.column(0).cast(pa.int64()), batch.column(1).cast(pa.string())]
        columns += [pa.array(np.concatenate([p[f.name] for p in parts]).astype(np.int64)) for f in list(schema)[2:]]
        return pa.RecordBatch.from_arrays(columns, schema=schema)

    return ta.map_arrow(docs.select(F.col("doc_id").cast("long"), F.col("stratum").cast("string"), "text"), run, STATS, "text")


def rules() -> dict[str, Column]:
    """Statistic of each rule, scaled to 0..1; higher is worse."""
    ratio = lambda a, b: F.least(F.lit(1.0), F.coalesce(F.col(a) / F.nullif(F.col(b), F.lit(0)), F.lit(0.0)))
    return {
        "symbols": ratio("n_symbols", "word_chars"),
        "duplicate_lines": ratio("n_dup_lines", "n_lines"),
        "repeated_words": ratio("n_repeat_words", "n_words"),
        "capitals": ratio("n_upper", "n_letters"),
        "word_length": F.least(F.lit(1.0), F.coalesce(F.col("word_chars") / F.nullif(F.col("n_words"), F.lit(0)), F.lit(0.0)) / 50),
    }


def tail_at_most(k: int, n: int, p: float) -> float:
    """P(Bin(n, p) <= k) = I(1 - p; n - k, k + 1), by the continued fraction of the incomplete beta function."""
    if k >= n:
        return 1.0
    a, b, x = n - k, k + 1, 1 - p
    if x > (a + 1) / (a + b + 2):
        return 1 - _beta_fraction(b, a, p)
    return _beta_fraction(a, b, x)


def _beta_fraction(a: float, b: float, x: float) -> float:
    """I(x; a, b) for x up to about a / (a + b); modified Lentz evaluation."""
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    c, d = 1.0, 1 / (1 - (a + b) * x / (a + 1))
    total = d
    for m in range(1, 100_000):
        for term in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / (1 + term * d)
            c = 1 + term / c
            total *= c * d
        if abs(c * d - 1) < 1e-13:
            break
    return front * total


def certified_cutoff(rejected: list[int], n: int, alpha: float, level: float) -> int | None:
    """Strictest certified grid step: rejected[g] good documents lie above step g; steps are tried from the top down."""
    best = None
    for step in range(len(rejected) - 1, -1, -1):
        if n == 0 or rejected[step] > alpha * n or tail_at_most(rejected[step], n, alpha) > level:
            break
        best = step
    return best


def cutoffs(labelled: DataFrame, max_false_rejection: float, delta: float) -> DataFrame:
    """(stratum, <rule>_cut ...): certified cutoffs from labelled good rows of (stratum, <rule> ...); null: none certified."""
    names = list(rules())
    entries = F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), F.ceil(F.col(r) * GRID).cast("int").alias("step")) for r in names]))
    histogram = labelled.select(F.coalesce("stratum", F.lit("")).alias("stratum"), entries.alias("e")).groupBy("stratum", "e.rule", "e.step").agg(F.count("*").alias("n"))
    strata = histogram.agg(F.countDistinct("stratum").alias("n")).first()["n"] or 1
    alpha, level = max_false_rejection / len(names), delta / (len(names) * strata)

    def choose(pdf: pd.DataFrame) -> pd.DataFrame:
        row: dict = {"stratum": pdf["stratum"].iloc[0]}
        for rule in names:
            part = pdf[pdf["rule"] == rule]
            at = np.bincount(part["step"], weights=part["n"], minlength=GRID + 1).astype(np.int64)
            above = at.sum() - np.cumsum(at)
            step = certified_cutoff([int(x) for x in above], int(at.sum()), alpha, level)
            row[f"{rule}_cut"] = None if step is None else float(step)
        return pd.DataFrame([row])

    schema = "stratum string, " + ", ".join(f"{r}_cut double" for r in names)
    return histogram.groupBy("stratum").applyInPandas(choose, schema)  # at most rules x (GRID + 1) rows each


def quality_rules(docs: DataFrame, labels: DataFrame, stratum: str = "lang", max_false_rejection: float = 0.05, delta: float = 0.05) -> DataFrame:
    """Statistics, base verdict and risk-controlled verdict of every document.

    docs: doc_id, text and the stratum column; labels: doc_id, quality. Base failure: fewer than 10 words, or more
    than a fifth of the words in repeated windows. kept: no base failure and no statistic above a certified cutoff.
    """
    stats = text_stats(docs.select("doc_id", F.col(stratum).alias("stratum"), "text"))
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    stats = stats.withColumn("base_failed", failed).withColumns(rules()).persist(StorageLevel.MEMORY_AND_DISK)
    # the exact bound needs one trial per document, however often its label or its row is given
    marks = labels.filter("quality is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").alias("least"), F.max("quality").alias("most"))
    good = marks.filter("least = 1 and most = 1").select("doc_id")
    found = stats.filter("not base_failed").join(good, "doc_id")
    labelled = found.groupBy("doc_id").agg(F.min(F.struct(*found.columns)).alias("row")).select("row.*")
    cuts = cutoffs(labelled, max_false_rejection, delta).withColumnRenamed("stratum", "key")
    judged = stats.join(cuts, F.coalesce("stratum", F.lit("")) == F.col("key"), "left").drop("key")
    broken = [F.when(F.ceil(F.col(r) * GRID) > F.col(f"{r}_cut"), F.lit(r)) for r in rules()]
    verdict = judged.withColumn("broken_rules", F.array_compact(F.array(*broken)))
    return verdict.withColumn("kept", ~F.col("base_failed") & (F.size("broken_rules") == 0)).drop(*[f"{r}_cut" for r in rules()])
