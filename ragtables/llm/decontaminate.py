"""Benchmark decontamination: gapped seeds that no match can miss, then Smith-Waterman alignment.

Words are runs of letters, digits and bytes above 127 of the lower-case text. Training passages that share enough seeds
with a test item are aligned with it word by word (match 2, mismatch -1, gap -1; the best local score over the score of
a full match). Copies with words changed, added or dropped keep a high score.

A seed is the hash of three words in order, with at most ``EDITS`` other words between them; a text has all of them.
An alignment of m of n words with e edits scores 2m - e, so one of at least 2nt (t the threshold) has e <= 2(m - nt). Its
m - 2 runs of three matched words have 2e edits between them at most, so at least n - 2 - 4n(1 - t) / (EDITS + 1) of them
have at most EDITS edits, and their words are seeds of both texts. For items too short for that (under seven words at
0.5) seeds are two words with at most ``PAIR_EDITS`` others between; there at least nt - 1 are shared. So each item with
nt > 1 shares a known number of seeds with all its matches, and passages that share fewer need no alignment: none is
missed. Repeated seeds of an item are counted as the fewest distinct ones that can make up that number.

Passages are overlapping windows of twice the most words that a match can take, so each match lies in one. Only
fixed-size bit maps (``1 << BITS`` bits) are broadcast: of the words and the seeds of the items, and of the passages to
align. Bits that are set by chance are dropped by the joins. Seeds in many documents are split by salt. Texts are
shuffled only for passages to align, and no candidate is capped.

Defined results: one row per (doc_id, item_id) with a score of at least ``threshold``; repeated rows with one doc_id
give one row; ``n_seeds`` counts the distinct seeds that the passage shares with the item. Null or empty texts and items
under three words match nothing. Rows with null ids take no part; equal items are all reported; extra columns are
dropped; empty tables give an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast, StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ragtables.llm import textarrays as ta

LEAST_WORDS = 3
EDITS, PAIR_EDITS = 2, 1
THRESHOLD = 0.5
BITS = 22
SALTS = 16
MATCH, MISMATCH, GAP = 2, -1, -1
INSIDE = np.zeros(256, dtype=bool)
INSIDE[128:] = INSIDE[48:58] = INSIDE[97:123] = INSIDE[65:91] = True
#: Distances between the words of a seed of three words, and of two.
TRIPLES = [(x, y) for x in range(1, EDITS + 2) for y in range(1, EDITS + 3 - x)]
PAIRS = [(x,) for x in range(1, PAIR_EDITS + 2)]
FACTORS = (1, ta.BASE, 0xD6E8FEB86659FD93)
PROBES = (64 - BITS, 21, 0)
MATCHES = "doc_id long, item_id long, score double, start_word long, end_word long, n_seeds long"


def word_hashes(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, ...]:
    """(starts, ends, hashes, bounds by document) of the words of a block."""
    starts, ends = ta.runs(INSIDE[data], offs)
    return starts, ends, ta.Substrings(data).hashes(starts, ends), ta.per_document(starts, offs)


def seeds_at(h: np.ndarray, bounds: np.ndarray, steps: tuple[int, ...], known: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, word index in the block, hash) of the words at these distances, within documents; of ``known`` words only."""
    places = np.cumsum((0, *steps)).tolist()
    n = max(0, len(h) - places[-1])
    owner = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    there = owner[:n] == owner[places[-1] :][:n]
    if known is not None:
        for x in places:
            there &= known[x : x + n]
    at = np.flatnonzero(there)
    g = np.full(len(at), len(places), dtype=ta.U64)
    for x, factor in zip(places, FACTORS, strict=False):
        g += h[at + x] * ta.U64(factor)
    return owner[at], at, g


def needed(words: int, threshold: float) -> tuple[list[tuple[int, ...]], int]:
    """The kind of seeds of an item, and how many of them a match shares at least."""
    three = math.ceil(words - 2 - 4 * words * (1 - threshold) / (EDITS + 1) - 1e-9)
    return (TRIPLES, three) if three > 0 else (PAIRS, max(1, math.ceil(words * threshold - 1 - 1e-9)))


def item_seeds(items: DataFrame, threshold: float) -> DataFrame:
    """(item, h, need, words, pairs) of all seeds of the items; need is the number of distinct ones that a match shares."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        keys, parts = batch.column(0).to_pylist(), [[], [], [], [], []]
        for lo, _, b, o in ta.blocks(*ta.text_buffers(batch.column(1))):
            *_, h, bounds = word_hashes(b, o)
            for d, n in enumerate(np.diff(bounds).tolist()):
                if n < LEAST_WORDS:
                    continue
                kind, need = needed(n, threshold)
                own, one = h[bounds[d] : bounds[d + 1]], np.array([0, n])
                g, times = np.unique(np.concatenate([seeds_at(own, one, steps)[2] for steps in kind]), return_counts=True)
                need = int(np.searchsorted(np.cumsum(np.sort(times)[::-1]), need)) + 1
                for part, x in zip(parts, (keys[lo + d], g.view(np.int64), need, n, int(kind is PAIRS)), strict=True):
                    part.append(np.broadcast_to(np.asarray(x, dtype=np.int64), len(g)))
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(p) if p else np.zeros(0, np.int64)) for p in parts], names=["item", "h", "need", "words", "pairs"])

    return ta.map_arrow(items, run, "item long, h long, need long, words long, pairs long", "text")


def item_words(items: DataFrame) -> DataFrame:
    """(h): hashes of the words of the items."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [np.unique(word_hashes(b, o)[2]) for _, _, b, o in ta.blocks(*ta.text_buffers(batch.column(1)))]
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.zeros(0, ta.U64), *found]).view(np.int64))], names=["h"])

    return ta.map_arrow(items, run, "h long", "text")


def bit_map(rows: DataFrame, column: str = "h") -> Broadcast:
    """Broadcast of the fixed-size map of the bits that ``column`` sets, one by each probe."""
    probes = [F.shiftrightunsigned(column, s).bitwiseAND(F.lit((1 << BITS) - 1)) for s in PROBES]
    bits = rows.select(F.explode(F.array(*probes)).alias("bit")).distinct().toArrow()  # at most 1 << BITS rows
    out = np.zeros(1 << BITS, dtype=bool)
    out[bits.column(0).to_numpy()] = True
    return rows.sparkSession.sparkContext.broadcast(np.packbits(out))


def passing(bits: np.ndarray, g: np.ndarray) -> np.ndarray:
    """Indexes of the values whose bits are all set."""
    at = np.arange(len(g))
    for s in PROBES:
        at = at[bits[((g[at] >> ta.U64(s)) & ta.U64((1 << BITS) - 1)).astype(np.int64)]]
    return at


def region_ids(keys: np.ndarray, window: np.ndarray) -> np.ndarray:
    return ta.mix(keys.view(ta.U64) + window.astype(ta.U64) * ta.U64(ta.BASE))


def last_windows(bounds: np.ndarray, span: int) -> np.ndarray:
    """Number of the last window of each document: window c holds the words from c * span to (c + 2) * span."""
    return np.maximum(-(-np.diff(bounds) // span) - 2, 0)


def seed_hits(docs: DataFrame, words: Broadcast, bits: Broadcast, span: int, kinds: list[tuple[int, ...]]) -> DataFrame:
    """(region, h): the possible seeds in each window of the documents (key, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, there = np.unpackbits(words.value).astype(bool), np.unpackbits(bits.value).astype(bool)
        for batch in batches:
            keys, regions, seeds = batch.column(0).to_numpy(), [np.zeros(0, ta.U64)], [np.zeros(0, ta.U64)]
            for lo, _, b, o in ta.blocks(*ta.text_buffers(batch.column(1))):
                *_, h, bounds = word_hashes(b, o)
                known = np.zeros(len(h), dtype=bool)
                known[passing(vocabulary, h)] = True
                last, found = last_windows(bounds, span), []
                for steps in kinds:
                    doc, at, g = seeds_at(h, bounds, steps, known)
                    hit = passing(there, g)
                    found.append((doc[hit], at[hit], g[hit]))
                doc, at, g = (np.concatenate(x) for x in zip(*found, strict=True))
                cell = (at - bounds[doc]) // span
                for window in (np.minimum(cell, last[doc]), np.maximum(cell - 1, 0)):
                    regions.append(region_ids(keys[lo + doc], window))
                    seeds.append(g)
            region, g = np.concatenate(regions), np.concatenate(seeds)
            order = np.lexsort((g, region))
            region, g = region[order], g[order]
            new = np.append(True, (region[1:] != region[:-1]) | (g[1:] != g[:-1]))[: len(g)]
            yield pa.RecordBatch.from_arrays([pa.array(region[new].view(np.int64)), pa.array(g[new].view(np.int64))], names=["region", "h"])

    return docs.select("key", "text").mapInArrow(run, "region long, h long")


def passages(docs: DataFrame, bits: Broadcast, span: int) -> DataFrame:
    """(region, doc_id, first_word, passage): the windows of the documents (key, text, doc_id) that may be in the bit map."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = np.unpackbits(bits.value).astype(bool)
        for batch in batches:
            for part in ta.row_slices(batch, "text"):
                keys, ids, rows = part.column(0).to_numpy(), part.column(2).to_pylist(), []
                for lo, _, b, o in ta.blocks(*ta.text_buffers(part.column(1))):
                    starts, ends, h, bounds = word_hashes(b, o)
                    doc, window = ta.ragged(last_windows(bounds, span) + 1)
                    region = region_ids(keys[lo + doc], window)
                    hit = passing(wanted, region)
                    raw = b.tobytes()
                    for d, c, r in zip(doc[hit].tolist(), window[hit].tolist(), region[hit].view(np.int64).tolist(), strict=True):
                        low = int(bounds[d]) + c * span
                        high = min(low + 2 * span, int(bounds[d + 1]))
                        if low < high:
                            rows.append((r, ids[lo + d], c * span, raw[starts[low] : ends[high - 1]].decode("utf-8", "replace")))
                columns = list(zip(*rows, strict=True)) or [()] * 4
                types = (pa.int64(), pa.int64(), pa.int64(), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["region", "doc_id", "first_word", "passage"])

    return docs.select("key", "text", "doc_id").mapInArrow(run, "region long, doc_id long, first_word long, passage string")


def align(a: np.ndarray, a_len: np.ndarray, b: np.ndarray, b_len: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(score, start, end) of the best local alignment of each row of items a in passages b; start and end are words of b.

    A cell is score * 2**32 + (2**32 - 1 - start), so that maxima also carry the start; all passages advance together.
    """
    rows, width = b.shape
    one, none = np.int64(1) << 32, np.int64((1 << 32) - 1)
    place = np.arange(width)
    fresh = np.broadcast_to(none - place, (rows, width))  # an alignment that begins at the column
    ramp = place * GAP * -one
    live = place[None, :] < b_len[:, None]
    before = np.full((rows, width), np.int64(0))
    top, end = np.zeros(rows, dtype=np.int64), np.zeros(rows, dtype=np.int64)
    for i in range(a.shape[1]):
        diagonal = np.concatenate((fresh[:, :1], np.where(before[:, :-1] >= one, before[:, :-1], fresh[:, 1:])), axis=1)
        cell = diagonal + np.where(b == a[:, i : i + 1], MATCH, MISMATCH) * one
        cell = np.maximum(cell, before + GAP * one)
        cell = np.maximum.accumulate(cell + ramp, axis=1) - ramp
        cell = np.where((cell >= one) & live & (i < a_len)[:, None], cell, 0)
        best = cell.argmax(axis=1)
        value = cell[np.arange(rows), best]
        better = value > top
        top, end = np.where(better, value, top), np.where(better, best + 1, end)
        before = np.where((i < a_len)[:, None], cell, before)
    return top >> 32, none - (top & none), end


def padded(h: np.ndarray, bounds: np.ndarray, fill: int) -> np.ndarray:
    size = np.diff(bounds)
    out = np.full((len(size), max(1, int(size.max(initial=0)))), fill, dtype=ta.U64)
    row, at = ta.ragged(size)
    out[row, at] = h[bounds[row] + at]
    return out


def aligned(pairs: DataFrame, threshold: float) -> DataFrame:
    """Scores of (doc_id, item_id, first_word, passage, item, n_seeds) of at least ``threshold``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in ta.row_slices(batch, "passage", 1 << 18):
                for few in ta.row_slices(part, "item", 1 << 18):
                    *_, h, bounds = word_hashes(*ta.text_buffers(few.column("passage")))
                    *_, ih, ibounds = word_hashes(*ta.text_buffers(few.column("item")))
                    score, start, end = align(padded(ih, ibounds, 0), np.diff(ibounds), padded(h, bounds, 1), np.diff(bounds))
                    share = score / (MATCH * np.maximum(np.diff(ibounds), 1))
                    first = few.column("first_word").to_numpy()
                    out = pa.RecordBatch.from_arrays([few.column("doc_id"), few.column("item_id"), pa.array(share), pa.array(first + start), pa.array(first + end), few.column("n_seeds")], names=["doc_id", "item_id", "score", "start_word", "end_word", "n_seeds"])
                    yield out.filter(pa.array(share >= threshold))

    return pairs.mapInArrow(run, MATCHES)


def contaminated(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, item_id, score, start_word, end_word, n_seeds of the documents that hold copies of test items."""
    docs = docs.filter("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.lower("text").alias("text"))
    items = items.filter("item_id is not null").select(F.col("item_id").cast("long").alias("item_id"), F.lower("text").alias("text")).distinct()
    items = items.withColumn("item", F.xxhash64("item_id", "text"))
    docs = docs.withColumn("key", F.xxhash64("doc_id", "text"))
    ta.bounded_batches(docs.sparkSession)
    known = item_seeds(items.select("item", "text"), threshold).persist(StorageLevel.MEMORY_AND_DISK)
    most = known.agg(F.max("words").alias("words"), F.min("pairs").alias("least"), F.max("pairs").alias("most")).first()
    span = math.ceil((most["words"] or 1) * (3 - 2 * threshold))  # m + e words of the document at most
    kinds = TRIPLES * (most["least"] == 0) + PAIRS * (most["most"] == 1) or TRIPLES
    hits = seed_hits(docs, bit_map(item_words(items.select("item", "text"))), bit_map(known), span, kinds)
    hits = hits.withColumn("salt", F.pmod("region", F.lit(SALTS)))
    salted = known.select("item", "h", "need").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))).withColumn("salt", F.col("salt").cast("long"))
    shared = hits.join(salted, ["h", "salt"]).groupBy("region", "item").agg(F.countDistinct("h").alias("n_seeds"), F.first("need").alias("need"))
    wanted = shared.filter("n_seeds >= need").select("region", "item", "n_seeds").persist(StorageLevel.MEMORY_AND_DISK)
    texts = passages(docs, bit_map(wanted, "region"), span).dropDuplicates(["region"])
    pairs = wanted.join(texts, "region").join(items.select("item", "item_id", F.col("text").alias("item_text")), "item").drop("item").withColumnRenamed("item_text", "item")
    best = F.max(F.struct("score", "n_seeds", F.negative("start_word").alias("s"), "end_word")).alias("m")
    found = aligned(pairs, threshold).groupBy("doc_id", "item_id").agg(best)
    return found.select("doc_id", "item_id", "m.score", F.negative("m.s").alias("start_word"), "m.end_word", "m.n_seeds")
