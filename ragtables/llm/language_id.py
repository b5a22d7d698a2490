"""Language identification by word-first backoff.

A known word is scored by its per-language log frequency. A word not seen in learning falls back to its character
4-grams; if none of them is known to 3-grams, then 2-grams and single characters: the mean log frequency of the
known n-grams of the longest size that has any. A document's language is the one with the largest sum over its
words; the score is that language's share of the likelihood.

The model is a classifier fitted on a bounded sample of labelled rows: ``rows_per_language`` rows of each language,
chosen by a hash of doc_id. Every document is then scored on its whole text.

Defined results: null text and text without a letter give ``und`` and score 0; so does everything if no labelled
row exists. Rows with null lang or text are not learned from. Repeated rows are scored alike. Ties and texts of
which nothing is known go to the first language in name order. Extra columns are dropped.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ragtables.llm import textarrays as ta

SIZES = (4, 3, 2, 1)
WORD = 0
ROWS_PER_LANGUAGE = 2000
MIN_COUNT = 2
SMOOTH = 0.5
COUNTS = "kind int, hash long, lang int, n long"
PREDICTIONS = "doc_id long, lang_pred string, score double"
SMALL_BLOCK = 1 << 18


def letters_only(text: Column) -> Column:
    """Lower-case words of letters and marks, each between single spaces; null stays null."""
    return F.concat(F.lit(" "), F.regexp_replace(F.lower(text), r"[^\p{L}\p{M}]+", " "), F.lit(" "))


def grams(data: np.ndarray, subs: ta.Substrings, chars: np.ndarray, starts: np.ndarray, ends: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(word, hash) of the character n-grams of words taken with the space on either side."""
    first, last = np.searchsorted(chars, starts - 1), np.searchsorted(chars, ends + 1)
    row, at = ta.ragged(np.maximum(last - first - size + 1, 0))
    at = at + first[row]
    bounds = np.append(chars, len(data))
    return row, subs.hashes(bounds[at], bounds[at + size])


def block_counts(data: np.ndarray, offs: np.ndarray, lang: np.ndarray) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """(kind, hash, language) of all words (kind 0) and n-grams (kind n) of a block."""
    starts, ends = ta.runs(data != 32, offs)
    owner = lang[ta.owners(offs, starts)]
    subs, chars = ta.Substrings(data), np.flatnonzero((data & 0xC0) != 0x80)
    out = [(WORD, subs.hashes(starts, ends), owner)]
    for size in SIZES:
        row, h = grams(data, subs, chars, starts, ends, size)
        out.append((size, h, owner[row]))
    return out


def fit(labelled: DataFrame, rows_per_language: int = ROWS_PER_LANGUAGE) -> dict:
    """Model from (doc_id, text, lang): {"langs": [...], kind: (sorted hashes, log frequencies)}."""
    labelled = labelled.filter("lang is not null and text is not null").select("doc_id", "text", "lang")
    sizes = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.count("*").alias("n")).collect()}  # one row per language
    langs = sorted(sizes)
    if not langs:
        return {"langs": []}
    # a hash share of about twice the rows wanted of each language, of which the first by hash are taken
    share = F.element_at(F.create_map(*[F.lit(x) for lang, n in sizes.items() for x in (lang, 2.0 * rows_per_language / n)]), F.col("lang"))
    h = F.xxhash64("doc_id")
    few = labelled.select("doc_id", "lang").filter((h / F.lit(2.0**64) + 0.5) < share)
    pick = Window.partitionBy("lang").orderBy(h, "doc_id")
    chosen = few.withColumn("r", F.row_number().over(pick)).filter(F.col("r") <= rows_per_language).select("doc_id", "lang").distinct()
    # at most rows_per_language ids for each language: a bounded broadcast
    rows = labelled.join(F.broadcast(chosen), ["doc_id", "lang"], "left_semi").select(letters_only(F.col("text")).alias("text"), F.array_position(F.array(*map(F.lit, langs)), F.col("lang")).cast("int").alias("lang"))

    def count(batch: pa.RecordBatch) -> pa.RecordBatch:
        data, offs = ta.text_buffers(batch.column(0))
        lang = batch.column(1).to_numpy(zero_copy_only=False) - 1
        columns: list[list] = [[], [], [], []]
        for lo, hi, b, o in ta.blocks(data, offs, SMALL_BLOCK):
            for kind, h, owner in block_counts(b, o, lang[lo:hi]):
                order = np.lexsort((owner, h))
                h, owner = h[order], owner[order]
                new = np.flatnonzero(np.append(True, (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])))[: len(h)]
                for column, values in zip(columns, (np.full(len(new), kind), h[new].view(np.int64), owner[new], np.diff(np.append(new, len(h)))), strict=True):
                    column.append(values)
        arrays = [np.concatenate(c) if c else np.zeros(0, np.int64) for c in columns]
        return pa.RecordBatch.from_arrays([pa.array(a.astype(t)) for a, t in zip(arrays, (np.int32, np.int64, np.int32, np.int64), strict=True)], names=["kind", "hash", "lang", "n"])

    counted = ta.map_arrow(rows, count, COUNTS, "text").groupBy("kind", "hash", "lang").agg(F.sum("n").alias("n"))
    # the sample bounds the model: words and n-grams that it holds at least MIN_COUNT times in a language
    table = counted.filter(F.col("n") >= MIN_COUNT).toArrow()
    kind, h, lang, n = (table.column(i).to_numpy() for i in range(4))
    model: dict = {"langs": langs}
    for k in (WORD, *SIZES):
        at = kind == k
        keys, row = np.unique(h[at].view(ta.U64), return_inverse=True)
        counts = np.zeros((len(keys), len(langs)))
        counts[row, lang[at]] = n[at]
        logs = np.log(counts + SMOOTH) - np.log(counts.sum(axis=0) + SMOOTH * (len(keys) + 1))
        model[k] = (keys, logs.astype(np.float32))
    return model


def lookup(keys: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Position of each hash in sorted keys, or -1."""
    if not len(keys):
        return np.full(len(h), -1)
    at = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
    return np.where(keys[at] == h, at, -1)


def word_scores(model: dict, data: np.ndarray, subs: ta.Substrings, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(distinct words' log frequencies, index of each word's row): words by themselves, the others by n-grams."""
    h = subs.hashes(starts, ends)
    _, first, inverse = np.unique(h, return_index=True, return_inverse=True)
    starts, ends, h = starts[first], ends[first], h[first]
    keys, logs = model[WORD]
    scores = np.zeros((len(h), len(model["langs"])), dtype=np.float32)
    at = lookup(keys, h)
    scores[at >= 0] = logs[at[at >= 0]]
    left = np.flatnonzero(at < 0)
    chars = np.flatnonzero((data & 0xC0) != 0x80)
    for size in SIZES:
        if not len(left):
            break
        keys, logs = model[size]
        row, g = grams(data, subs, chars, starts[left], ends[left], size)
        at = lookup(keys, g)
        row, at = row[at >= 0], at[at >= 0]
        counts = np.bincount(row, minlength=len(left))
        if len(row):
            begins = np.flatnonzero(np.append(True, row[1:] != row[:-1]))
            scores[left[row[begins]]] = np.add.reduceat(logs[at], begins, axis=0) / counts[row[begins], None]
        left = left[counts == 0]
    return scores, inverse


def predict(model: dict, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(language index, score) of each document of normalised text."""
    langs = len(model["langs"])
    best, score = np.zeros(len(offs) - 1, dtype=np.int64), np.zeros(len(offs) - 1)
    for lo, hi, b, o in ta.blocks(data, offs, SMALL_BLOCK):
        starts, ends = ta.runs(b != 32, o)
        total = np.zeros((hi - lo, langs))
        if len(starts):
            scores, inverse = word_scores(model, b, ta.Substrings(b), starts, ends)
            owner = ta.owners(o, starts)
            for j in range(langs):
                total[:, j] = np.bincount(owner, weights=scores[inverse, j], minlength=hi - lo)
        share = np.exp(total - total.max(axis=1, keepdims=True))
        best[lo:hi] = total.argmax(axis=1)
        score[lo:hi] = share.max(axis=1) / share.sum(axis=1)
    return best, score


def judged(docs: DataFrame, columns: list[str], model: dict, schema, finish) -> DataFrame:
    """``finish(columns of the batch, predictions, scores)`` over all rows; the prediction of a text without letters is und."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by rows_per_language x languages
    text = F.col("text")
    rows = docs.select(*columns, F.when(F.coalesce(text.rlike(r"\p{L}"), F.lit(False)), letters_only(text)).alias("_letters"))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        model, letters = shared.value, batch.column("_letters")
        none = pc.is_null(letters).to_numpy(zero_copy_only=False)
        langs = np.array([*model["langs"], "und"], dtype=object)
        if model["langs"]:
            best, score = predict(model, *ta.text_buffers(letters))
        else:
            best, score = np.zeros(len(none), dtype=np.int64), np.zeros(len(none))
            none = np.ones(len(none), dtype=bool)
        return finish(batch.select(columns), langs[np.where(none, -1, best)], np.where(none, 0.0, score))

    return ta.map_arrow(rows, run, schema, "_letters")


def identify(docs: DataFrame, model: dict) -> DataFrame:
    """(doc_id, lang_pred, score) of every row of (doc_id, text)."""

    def finish(batch: pa.RecordBatch, lang: np.ndarray, score: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(lang, pa.string()), pa.array(score)], names=["doc_id", "lang_pred", "score"])

    return judged(docs, ["doc_id"], model, PREDICTIONS, finish)


def keep_clear(docs: DataFrame, model: dict, min_score: float) -> DataFrame:
    """The rows of ``docs`` whose language is known with at least ``min_score``."""

    def finish(batch: pa.RecordBatch, lang: np.ndarray, score: np.ndarray) -> pa.RecordBatch:
        return batch.filter(pa.array((lang != "und") & (score >= min_score)))

    return judged(docs, docs.columns, model, docs.schema, finish)


def fold(doc_id: str = "doc_id", parts: int = 4) -> Column:
    """crc32 of the id as text, modulo ``parts``; a null id is in fold 0."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % parts, F.lit(0))


held_out = partial(fold, "doc_id", 4)


def language_id(docs: DataFrame, rows_per_language: int = ROWS_PER_LANGUAGE) -> DataFrame:
    """doc_id, held_out, lang_pred, score: learned from documents outside fold 2 of 4, applied to all."""
    model = fit(docs.filter(held_out() != 2), rows_per_language)
    return identify(docs, model).select("doc_id", (held_out() == 2).alias("held_out"), "lang_pred", "score")
