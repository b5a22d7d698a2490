"""Phrase collocation mining by best-first branch and bound over prefix counts.

Texts are lower-cased (A-Z), cut into pieces and words. f counts all contiguous occurrences of a phrase within pieces,
per language. A candidate has 2 to ``LONGEST`` words and a = f >= ``least``; its score is the smallest over all cuts of
floor(2000000 a / (l + r)), l and r being the counts of the two parts. A candidate inside a longer one that is at least
80 % as frequent is dropped, and each language's first ``limit`` by (score, a, phrase) stay.

The search grows phrases by one word at the right, in passes over the texts:

1. words; 2. pairs of words that occur at least ``least`` times each; 3. triples of two such pairs, and fours of three
such pairs that are expanded from the frontier.

* Bound: any phrase that grows from the prefix (x, y) has a <= f(xy), and what follows x occurs at least a times, so its
  score is at most 2000000 f(xy) / (f(x) + f(xy)). The prefix's own score is no larger.
* Best first: a language's prefixes are expanded in order of their bounds, down to the score tau of its
  ``limit`` x 4-th best pair (next round 32, then all). Every candidate that scores tau or more, and every longer phrase
  that could drop it, then has an expanded prefix among its first two pairs and is counted. If at least ``limit``
  candidates of tau or more survive, nothing that is not expanded can enter the result, ties included: the language is
  settled. Others go on to the next round, in which only the newly expanded prefixes are counted.
* A candidate that is dropped by a phrase longer by two words is dropped by one longer by one as well (which is as
  frequent or more), so only those are looked at.

Each task encodes the words of about ``CHUNK`` bytes exactly (no hashes) and counts there, so a frequent phrase leaves
it once; Spark adds up the counts by (lang, phrase). Which words and pairs are frequent or expanded is broadcast as bit
maps of at most ``1 << MOST_BITS`` bits (16 MB), sized by the number of phrases; bits set by chance, or a full map, only
let more phrases be counted, and all that are counted are counted in full.

Defined results: a null text is empty, a null lang is ``und``; repeated rows count each; numbers are exact (decimals
where products may pass 64 bits). Extra columns are dropped; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ragtables.llm import textarrays as ta
from ragtables.llm.storage import cut
from ragtables.plans.joins import join_small

LONGEST = 4
LEAST = 30
LIMIT = 2000
SCALE = 2_000_000
COVERED = 80
#: Prefixes are expanded down to the score of the pair of this rank x limit; then all.
FRONTIER = (4, 32, None)
CHUNK = 8 << 20
MOST_BITS = 27
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
WORD, SPACE, BREAK = 0, 1, 2
CLASS = np.zeros(256, dtype=np.uint8)
CLASS[[0x20, 0x09]] = SPACE
CLASS[[*b".,;:!?", 0x0A, 0x0B, 0x0C, 0x0D]] = BREAK
COUNTS = "lang string, phrase string, size int, n long"
#: The size of the row that has the number of words of a language.
TOTAL = 0


def words_of(texts: pa.Array) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """(word number of each word, the distinct words, whether the next word follows in the same piece)."""
    data, offs = ta.text_buffers(texts)
    data = LOWER[data]
    kind = CLASS[data]
    inside = kind == WORD
    starts, ends = ta.runs(inside, offs)
    ends_at = np.concatenate(([0], np.cumsum(ends - starts)))
    packed = pa.Array.from_buffers(pa.large_string(), len(starts), [None, pa.py_buffer(ends_at), pa.py_buffer(data[inside])])
    coded = packed.dictionary_encode()
    piece = np.cumsum(kind == BREAK)[starts]
    owner = ta.owners(offs, starts)
    joined = np.append((piece[1:] == piece[:-1]) & (owner[1:] == owner[:-1]), False)[: len(starts)]
    return coded.indices.to_numpy().astype(np.int64), coded.dictionary, joined


def lang_hash(lang: str) -> int:
    raw = np.frombuffer(lang.encode(), dtype=np.uint8)
    return int(ta.Substrings(raw).hashes(np.array([0]), np.array([len(raw)]))[0])


def hashes_of(words: pa.Array, lang: int) -> np.ndarray:
    """Hash of each word with the language."""
    data, offs = ta.text_buffers(words)
    return ta.mix(ta.Substrings(data).hashes(offs[:-1], offs[1:]) + ta.U64(lang))


def pair_hashes(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    return ta.mix(left * ta.U64(ta.BASE) + right)


class BitMap:
    """Which phrases may be in a set."""

    def __init__(self, bits: int, index: np.ndarray, mask: np.ndarray):
        self.bits, self.words = bits, np.zeros(max(1, (1 << bits) >> 6), dtype=ta.U64)
        self.words[index] = mask.view(ta.U64)

    def has(self, h: np.ndarray) -> np.ndarray:
        found = np.ones(len(h), dtype=bool)
        for shift in (0, 32):
            at = (h >> ta.U64(shift)) & ta.U64((1 << self.bits) - 1)
            found &= (self.words[(at >> ta.U64(6)).astype(np.int64)] >> (at & ta.U64(63))) & ta.U64(1) == 1
        return found


def bit_map(phrases: DataFrame) -> Broadcast:
    """Broadcast of the bit map of a table (lang, phrase) of words or pairs."""
    bits = min(MOST_BITS, max(16, (16 * phrases.count()).bit_length()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, texts = batch.column(0).to_pylist(), batch.column(1)
            out = []
            for lang in set(langs):
                data, offs = ta.text_buffers(texts.filter(pa.array([x == lang for x in langs])))
                starts, ends = ta.runs(data != 32, offs)
                h = ta.mix(ta.Substrings(data).hashes(starts, ends) + ta.U64(lang_hash(lang)))
                first = ta.per_document(starts, offs)
                one = np.diff(first) == 1
                out += [h[first[:-1][one]], pair_hashes(h[first[:-1][~one]], h[first[:-1][~one] + 1])]
            h = np.concatenate([np.zeros(0, ta.U64), *out])
            at = np.concatenate([(h >> ta.U64(s)) & ta.U64((1 << bits) - 1) for s in (0, 32)])
            index, mask = (at >> ta.U64(6)).astype(np.int64), ta.U64(1) << (at & ta.U64(63))
            yield pa.RecordBatch.from_arrays([pa.array(index), pa.array(mask.view(np.int64))], names=["i", "mask"])

    words = phrases.select("lang", "phrase").mapInArrow(run, "i long, mask long").groupBy("i").agg(F.bit_or("mask").alias("mask")).toArrow()
    made = BitMap(bits, words.column("i").to_numpy(), words.column("mask").to_numpy())
    return phrases.sparkSession.sparkContext.broadcast(made)


def counted(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(distinct keys, an index of each, number of each key's distinct one, counts)."""
    return np.unique(keys, return_index=True, return_inverse=True, return_counts=True)


def phrases_at(at: np.ndarray, size: int, ids: np.ndarray, vocabulary: pa.Array) -> pa.Array:
    """The phrases of ``size`` words that begin at these words."""
    parts = [vocabulary.take(pa.array(ids[at + i])) for i in range(size)]
    return parts[0] if size == 1 else pc.binary_join_element_wise(*parts, pa.scalar(" ", pa.large_string()))


def word_counts(texts: pa.Array, lang: str) -> Iterator[tuple[pa.Array, int, np.ndarray]]:
    """(phrases, size, counts) of the words, and their number."""
    ids, vocabulary, _ = words_of(texts)
    yield vocabulary, 1, np.bincount(ids, minlength=len(vocabulary))
    yield pa.array([""], pa.large_string()), TOTAL, np.array([len(ids)])


def pair_counts(texts: pa.Array, lang: str, frequent: BitMap) -> Iterator[tuple[pa.Array, int, np.ndarray]]:
    """Pairs of frequent words."""
    ids, vocabulary, joined = words_of(texts)
    known = frequent.has(hashes_of(vocabulary, lang_hash(lang)))[ids]
    at = np.flatnonzero(joined[:-1] & known[:-1] & known[1:])
    _, first, _, n = counted(ids[at] * len(vocabulary) + ids[at + 1])
    yield phrases_at(at[first], 2, ids, vocabulary), 2, n


def long_counts(texts: pa.Array, lang: str, pairs: BitMap, expanded: BitMap, sizes: tuple[int, ...]) -> Iterator[tuple[pa.Array, int, np.ndarray]]:
    """Triples of frequent pairs; fours of frequent pairs of which the first or the second one is expanded."""
    ids, vocabulary, joined = words_of(texts)
    h, size = hashes_of(vocabulary, lang_hash(lang)), len(vocabulary)
    at = np.flatnonzero(joined)
    keys, first, number, _ = counted(ids[at] * size + ids[np.minimum(at + 1, len(ids) - 1)])
    g = pair_hashes(h[keys // max(size, 1)], h[keys % max(size, 1)])
    good, grows = pairs.has(g), expanded.has(g)
    pair = np.full(len(ids) + 3, -1)
    pair[at] = np.where(good[number], number, -1)
    grow = np.zeros(len(ids) + 3, dtype=bool)
    grow[at] = grows[number]
    at = np.flatnonzero((pair[:-1] >= 0) & (pair[1:] >= 0))
    keys, first, number, n = counted(pair[at] * size + ids[at + 2])
    if 3 in sizes:
        yield phrases_at(at[first], 3, ids, vocabulary), 3, n
    triple = np.full(len(ids) + 3, -1)
    triple[at] = number
    at = np.flatnonzero((triple[:-1] >= 0) & (triple[1:] >= 0) & (grow[:-1] | grow[1:]))
    _, first, _, n = counted(triple[at] * size + ids[at + 3])
    yield phrases_at(at[first], 4, ids, vocabulary), 4, n


def counts(docs: DataFrame, count: Callable, least: int, *maps: Broadcast) -> DataFrame:
    """(lang, phrase, size, n) of what ``count`` finds, in full, where n is ``least`` or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[pa.Array]] = {}
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            for lang, texts in held.items():
                for phrases, words, n in count(pa.concat_arrays(texts), lang, *(m.value for m in maps)):
                    columns = [pa.array([lang], pa.string()).take(pa.array(np.zeros(len(n), np.int64))), phrases.cast(pa.string()), pa.array(np.full(len(n), words, np.int32)), pa.array(n.astype(np.int64))]
                    made = pa.RecordBatch.from_arrays(columns, names=["lang", "phrase", "size", "n"])
                    yield from (made.slice(lo, 20_000) for lo in range(0, made.num_rows, 20_000))
            held.clear()

        for batch in batches:
            for part in ta.row_slices(batch, "text", CHUNK):
                langs = part.column(0).dictionary_encode()
                texts = part.column(1).cast(pa.large_string())
                for code, lang in enumerate(langs.dictionary.to_pylist()):
                    held.setdefault(lang, []).append(texts.filter(pc.equal(langs.indices, code)))
                size += int(pc.sum(pc.binary_length(texts)).as_py() or 0)
                if size >= CHUNK:
                    yield from flush()
                    size = 0
        yield from flush()

    ta.bounded_batches(docs.sparkSession)
    found = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).alias("text")).mapInArrow(run, COUNTS)
    total = found.groupBy("lang", "phrase", "size").agg(F.sum("n").alias("n"))
    return total.filter((F.col("n") >= least) | (F.col("size") == TOTAL))


def exact(c: str | Column) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("decimal(20,0)")


def score_of(a: str, left: str, right: str) -> Column:
    """floor(2000000 a / (left + right)), exactly."""
    return F.expr(f"cast((cast({SCALE} as decimal(8,0)) * cast({a} as decimal(20,0))) div (cast({left} as decimal(20,0)) + cast({right} as decimal(20,0))) as long)")


def pair_bounds(words: DataFrame, pairs: DataFrame) -> DataFrame:
    """(lang, phrase, score, bound) of the pairs: their own score, and the most that a phrase growing from them can have."""
    left = words.select("lang", F.col("phrase").alias("x"), F.col("n").alias("l"))
    right = words.select("lang", F.col("phrase").alias("y"), F.col("n").alias("r"))
    parts = pairs.select("lang", "phrase", "n", F.substring_index("phrase", " ", 1).alias("x"), F.substring_index("phrase", " ", -1).alias("y"))
    both = parts.join(left, ["lang", "x"]).join(right, ["lang", "y"])
    return both.select("lang", "phrase", score_of("n", "l", "r").alias("score"), score_of("n", "l", "n").alias("bound"))


def scored(candidates: DataFrame, known: DataFrame) -> DataFrame:
    """(lang, phrase, size, a, l, r, score) by the lowest-scoring cut of each candidate."""
    words, k = F.split("phrase", " "), F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k")
    cuts = candidates.withColumn("words", words).select("lang", "phrase", "size", F.col("n").alias("a"), "words", k)
    part = lambda start, n: F.array_join(F.slice("words", start, n), " ")
    cuts = cuts.withColumn("x", part(F.lit(1), F.col("k"))).withColumn("y", part(F.col("k") + 1, F.col("size") - F.col("k"))).drop("words")
    side = lambda name, n: known.select("lang", F.col("phrase").alias(name), F.col("n").alias(n))
    cuts = cuts.join(side("x", "l"), ["lang", "x"]).join(side("y", "r"), ["lang", "y"])
    best = F.min(F.struct(score_of("a", "l", "r").alias("score"), "k", "l", "r")).alias("best")
    return cuts.groupBy("lang", "phrase", "size", "a").agg(best).select("lang", "phrase", "size", "a", "best.l", "best.r", "best.score")


def survivors(candidates: DataFrame, longer: DataFrame) -> DataFrame:
    """The candidates that no phrase longer by one word covers."""
    first = F.expr("substring_index(phrase, ' ', size - 1)")
    rest = F.expr("substring_index(phrase, ' ', 1 - size)")
    inside = longer.select("lang", "n", F.explode(F.array(first, rest)).alias("phrase"))
    cover = inside.groupBy("lang", "phrase").agg(F.max("n").alias("cover"))
    covered = (exact("cover") * 100) >= exact("a") * COVERED
    return candidates.join(cover, ["lang", "phrase"], "left").filter(~F.coalesce(covered, F.lit(False))).drop("cover")


def collocations(docs: DataFrame, limit: int = LIMIT, least: int = LEAST, frontier: tuple[int | None, ...] = FRONTIER) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the first ``limit`` collocations of each language."""
    spark = docs.sparkSession
    words = cut(counts(docs, word_counts, least))
    single = words.filter("size = 1")
    pairs = cut(counts(docs, pair_counts, least, bit_map(single)))
    bounds = cut(pair_bounds(single, pairs))
    pair_map = bit_map(pairs)
    ranked = bounds.select("lang", "score", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), "phrase")).alias("at"))
    longer, before, open_docs, found = None, None, docs, None
    for share in frontier:
        # one row per language: the score down to which its prefixes are expanded
        if share is None:
            tau = bounds.select("lang").distinct().withColumn("tau", F.lit(0).cast("long"))
        else:
            cutoff = ranked.filter(F.col("at") <= share * limit).groupBy("lang").agg(F.max("at").alias("most"), F.min("score").alias("low"))
            tau = cutoff.select("lang", F.when(F.col("most") < share * limit, 0).otherwise(F.col("low")).cast("long").alias("tau"))
        if before is not None:
            tau = join_small(tau, before.filter("not settled").select("lang"), "lang")
        tau = cut(tau)
        reach = join_small(bounds, tau, "lang").filter("bound >= tau")
        if before is not None:
            reach = join_small(reach, before.select("lang", F.col("tau").alias("old")), "lang").filter("bound < old")
        sizes = (3, 4) if longer is None else (4,)
        fresh = counts(open_docs, partial(long_counts, sizes=sizes), least, pair_map, bit_map(reach))
        longer = cut(fresh if longer is None else longer.unionByName(fresh).distinct())
        known = single.unionByName(pairs).unionByName(longer.filter("size = 3"))
        candidates = join_small(pairs.unionByName(longer), tau.select("lang"), "lang")
        kept = join_small(survivors(scored(candidates, known), longer), tau, "lang").filter("score >= tau")
        order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), F.asc("phrase"))
        kept = cut(kept.withColumn("rank", F.row_number().over(order).cast("long")).filter(F.col("rank") <= limit))
        state = tau.join(kept.groupBy("lang").agg(F.count("*").alias("kept")), "lang", "left")
        before = cut(state.select("lang", "tau", ((F.col("tau") == 0) | (F.coalesce("kept", F.lit(0)) >= limit)).alias("settled")))
        part = join_small(kept, before.filter("settled").select("lang"), "lang")
        found = part if found is None else found.unionByName(part)
        if before.filter("not settled").isEmpty():
            break
        named = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), "text")
        open_docs = join_small(named, before.filter("not settled").select("lang"), "lang")
    total = words.filter(F.col("size") == TOTAL).select("lang", F.col("n").alias("n"))
    return join_small(found, total, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
