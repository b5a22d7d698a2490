"""Keyword top-k (R3): one scan of the texts, or a threshold algorithm over stored term tables.

The score of a chunk is the share of the question's tokens (with multiplicity) that occur in its text. A token occurs in
a text iff it is inside one of the text's terms (word runs and CJK characters).

Without term tables (``scan_scores``) the texts are read once for a block of questions. A task finds the question tokens
in the distinct terms of a batch (substring hashes of the tokens' lengths, each match then compared), sums the hits of
its chunks and keeps the best k per question and collection. Questions that fit one block are broadcast; otherwise blocks
of questions meet blocks of chunks in a cogroup, as in ``vector_search``.

With term tables (``term_scores``) the texts are not scanned. ``write_keyword_tables`` stores:

* ``postings``: (collection, term, doc_ord, chunk_index), the chunks that have the term, as two arrays; a task makes one row
  of the chunks that it reads together, so a common term has many rows and no task gathers it;
* ``terms``: (collection, term, df), df being the chunks that have the term;
* ``grams``: (collection, gram, term, df), the substrings of one to three characters of each term, and
  ``gram_stats``: (collection, gram, terms, bound) with the sum of df.

Each file is sorted by term or gram. Postings and grams are written by the tasks that make them, without a shuffle.

A token lies only in terms that have its rarest gram, and ``bound`` of that gram is an upper bound of the chunks that
hold the token. Questions are answered by a threshold algorithm, all questions and collections in one plan:

1. the tokens of a question are ordered by their bounds; the rarest ones that make up ``SEED_SHARE`` of the question
   (its seeds) are looked up, and their hits are summed for each chunk;
2. the best few chunks by these hits are scored in full; the k-th of these scores is a threshold that no chunk of the
   result can be below;
3. a chunk at the threshold misses no more than the rest of the question's weight. The rarest tokens that make up
   ``MISSED_TIMES`` of that are looked up, so a chunk that can reach the threshold has a good part of them, and the commonest
   are not where little may be missed. Only chunks whose hits plus the weight of the open tokens reach the threshold are kept;
4. the best few of these are scored in full for a second threshold, which is the higher as more tokens are counted, and
   only the chunks that can reach it are scored in full, from their texts.

So tokens that most chunks hold cost nothing but a bound, and nothing is collected. A collection with fewer than k hits
so far has the threshold 1, which looks up every token. Scores are compared as whole hit counts. Where even the rarest
tokens of the questions are common, the scan is the cheaper of the two.
"""

from __future__ import annotations

import math
import re
from collections import defaultdict
from collections.abc import Iterator
from itertools import chain
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.tokens import CJK_TOKEN_REGEX, WORD_TOKEN_REGEX, tokenize
from ..plans.checkpoints import cut
from ..plans.joins import join_small
from ..plans.topk import top_k
from .vector_search import KEPT_ROWS, all_blocks, best_rows, block_of, in_key_order, key_columns, merged_top_k

GRAM_SIZES = (1, 2, 3)
#: Share of a question's weight that its first looked-up tokens make up, and chunks scored in full for the threshold.
SEED_SHARE, SEED_CHUNKS = 0.15, 16
#: A token is looked up if the rarer ones weigh at most so many times what a chunk at the threshold may miss.
MISSED_TIMES = 1.4
CHUNK = ["doc_ord", "chunk_index"]
KEY = ["collection_name", *CHUNK]
TABLES = ("postings", "terms", "grams", "gram_stats")
#: (chunk, term) pairs that a task packs at once.
PACKED_PAIRS = 2_000_000


class KeywordTables(NamedTuple):
    postings: DataFrame
    terms: DataFrame
    grams: DataFrame
    gram_stats: DataFrame


def grams_of(text: Column, sizes: tuple[int, ...] = GRAM_SIZES) -> Column:
    """The distinct substrings of these sizes."""
    n = F.length(text)
    cuts = lambda size: F.transform(F.sequence(F.lit(1), n - size + 1), lambda i: F.substring(text, i, size))
    none = F.array().cast("array<string>")
    return F.array_distinct(F.flatten(F.array(*[F.when(n >= size, cuts(size)).otherwise(none) for size in sizes])))


def _with_collection(index: DataFrame) -> DataFrame:
    return index if "collection_name" in index.columns else index.withColumn("collection_name", F.lit(""))


def _postings(index: DataFrame) -> DataFrame:
    rows = _with_collection(index).select(*KEY, "content")
    arrays = [T.StructField(c, T.ArrayType(rows.schema[c].dataType)) for c in CHUNK]
    schema = T.StructType([rows.schema["collection_name"], T.StructField("term", T.StringType()), *arrays])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = Packing()
        for batch in batches:
            for lo in range(0, batch.num_rows, TERM_CHUNKS):
                held.add(batch.slice(lo, TERM_CHUNKS))
                if held.pairs >= PACKED_PAIRS:
                    yield from held.flush()
        yield from held.flush()

    return rows.mapInArrow(run, schema)


class Packing:
    """The distinct terms of a task's chunks until they are packed by term."""

    def __init__(self):
        self.keys: list[pa.RecordBatch] = []
        self.terms: list[np.ndarray] = []
        self.sizes: list[np.ndarray] = []
        self.known: defaultdict[str, int] = defaultdict()
        self.known.default_factory = self.known.__len__  # a new term gets the next number
        self.pairs = 0

    def add(self, rows: pa.RecordBatch) -> None:
        """Rows (collection_name, doc_ord, chunk_index, content)."""
        held = [list(map(self.known.__getitem__, set(TERM.findall(text.lower())))) if text else [] for text in rows.column("content").to_pylist()]
        sizes = np.array([len(h) for h in held], dtype=np.int64)
        self.keys.append(rows.select(KEY))
        self.sizes.append(sizes)
        self.terms.append(np.fromiter(chain.from_iterable(held), dtype=np.int64, count=int(sizes.sum())))
        self.pairs += len(self.terms[-1])

    def flush(self) -> Iterator[pa.RecordBatch]:
        """(collection_name, term, doc_ord, chunk_index) of what is held, the last two as arrays."""
        if self.pairs:
            keys, term, size = pa.Table.from_batches(self.keys).combine_chunks(), np.concatenate(self.terms), np.concatenate(self.sizes)
            name = keys.column("collection_name").combine_chunks().dictionary_encode(null_encoding="encode")
            row = np.repeat(np.arange(len(size)), size)
            group = name.indices.to_numpy()[row].astype(np.int64) * len(self.known) + term
            order = np.argsort(group, kind="stable")
            begins = np.flatnonzero(np.append(True, group[order][1:] != group[order][:-1]))
            chunks, ends = keys.select(CHUNK).take(pa.array(row[order])), pa.array(np.append(begins, len(order)), pa.int32())
            lists = [pa.ListArray.from_arrays(ends, chunks.column(c).combine_chunks()) for c in CHUNK]
            first = order[begins]
            named = [name.dictionary.take(name.indices.take(pa.array(row[first]))), pa.array(list(self.known)).take(pa.array(term[first]))]
            out = pa.RecordBatch.from_arrays([*named, *lists], names=["collection_name", "term", *CHUNK])
            for lo in range(0, out.num_rows, TERM_CHUNKS):
                yield out.slice(lo, TERM_CHUNKS)
        self.__init__()


def _terms(postings: DataFrame) -> DataFrame:
    return postings.groupBy("collection_name", "term").agg(F.sum(F.size("doc_ord").cast("long")).alias("df"))


def _grams(terms: DataFrame) -> DataFrame:
    return terms.select("collection_name", F.explode(grams_of(F.col("term"))).alias("gram"), "term", "df")


def _gram_stats(grams: DataFrame) -> DataFrame:
    return grams.groupBy("collection_name", "gram").agg(F.count("*").alias("terms"), F.sum("df").alias("bound"))


def keyword_tables(index: DataFrame) -> KeywordTables:
    """The tables of an index that is not stored; each is computed once."""
    postings = cut(_postings(index))
    terms = cut(_terms(postings))
    grams = _grams(terms)
    return KeywordTables(postings, terms, grams, cut(_gram_stats(grams)))


def write_keyword_tables(index: DataFrame, path: str) -> None:
    """Store the tables under ``path``, by collection and each file sorted by term or gram, so that lookups skip pages."""
    spark, made = index.sparkSession, {}
    for name, build, order in (("postings", _postings, "term"), ("terms", _terms, "term"), ("grams", _grams, "gram"), ("gram_stats", _gram_stats, "gram")):
        source = {"postings": index, "terms": made.get("postings"), "grams": made.get("terms"), "gram_stats": made.get("grams")}[name]
        table = build(source).sortWithinPartitions("collection_name", order)
        table.write.mode("overwrite").partitionBy("collection_name").parquet(f"{path}/{name}")
        made[name] = spark.read.parquet(f"{path}/{name}")


def read_keyword_tables(spark: SparkSession, path: str) -> KeywordTables:
    return KeywordTables(*(spark.read.parquet(f"{path}/{name}") for name in TABLES))


def question_tokens(questions: DataFrame) -> DataFrame:
    """(question_id, token, mult) of the question texts."""
    return questions.select("question_id", F.explode(tokenize("question")).alias("token")).groupBy("question_id", "token").agg(F.count("*").alias("mult"))


def token_weights(questions: DataFrame, tables: KeywordTables, seed_share: float) -> DataFrame:
    """(question_id, collection_name, token, mult, gram, rest, seed): the tokens that may occur in a collection, each with
    its rarest gram; rest is the weight of the token and the commoner ones."""
    mult = question_tokens(questions)
    size = F.least(F.length("token"), F.lit(max(GRAM_SIZES)))
    found = F.when(size == 1, grams_of(F.col("token"), (1,))).when(size == 2, grams_of(F.col("token"), (2,))).otherwise(grams_of(F.col("token"), (3,)))
    parts = mult.select("token").distinct().withColumn("all", found).select("token", F.size("all").alias("parts"), F.explode("all").alias("gram"))
    located = join_small(tables.gram_stats, parts, "gram").groupBy("collection_name", "token", "parts").agg(
        F.count("*").alias("found"), F.min("bound").alias("bound"), F.min_by("gram", F.struct("terms", "gram")).alias("gram"))
    located = located.filter("found = parts").select("collection_name", "token", "bound", "gram")
    rows = join_small(located, mult, "token")
    order = Window.partitionBy("question_id", "collection_name").orderBy("bound", "token")
    total = F.sum("mult").over(Window.partitionBy("question_id", "collection_name"))
    before = F.sum("mult").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("mult")
    return rows.select("question_id", "collection_name", "token", "mult", "gram", (total - before).alias("rest"), (before < seed_share * total).alias("seed"))


def hit_sums(weights: DataFrame, tables: KeywordTables) -> DataFrame:
    """(question_id, chunk, hits): summed weights of these tokens, for every chunk that has one of them."""
    tokens = weights.select("collection_name", "token", "gram").distinct()
    inside = join_small(tables.grams, tokens, ["collection_name", "gram"]).filter(F.contains("term", "token")).select("collection_name", "token", "term")
    found = tables.postings.join(inside, ["collection_name", "term"]).select("collection_name", "token", "chunk_index", F.posexplode("doc_ord").alias("_at", "doc_ord"))
    found = found.withColumn("chunk_index", F.get("chunk_index", F.col("_at")))
    # dealt by chunk, which serves the distinct rows and the sums
    chunks = found.select(*KEY, "token").repartition(*KEY).distinct()
    pairs = join_small(chunks, weights.select("question_id", "collection_name", "token", "mult"), ["collection_name", "token"])
    return pairs.groupBy("question_id", *KEY).agg(F.sum("mult").alias("hits"))


def full_hits(pairs: DataFrame, questions: DataFrame, index: DataFrame) -> DataFrame:
    """(question_id, chunk, hits, tokens): the hits of each pair from its texts."""
    asked = questions.select("question_id", tokenize("question").alias("asked"))
    texts = _with_collection(index).select(*KEY, F.lower("content").alias("low"))
    both = join_small(join_small(texts, pairs.select("question_id", *KEY), KEY), asked, "question_id")
    hits = F.size(F.filter("asked", lambda t: F.contains("low", t)))
    return both.select("question_id", *KEY, hits.cast("long").alias("hits"), F.size("asked").alias("tokens"))


def term_scores(questions: DataFrame, index: DataFrame, k: int, tables: KeywordTables, seed_share: float = SEED_SHARE) -> DataFrame:
    """(question_id, chunk, score, rank): the best k chunks with a hit of each question and collection."""
    group, best = ["question_id", "collection_name"], [F.desc("hits"), F.asc("doc_ord"), F.asc("chunk_index")]

    def threshold(pairs: DataFrame) -> DataFrame:
        """The k-th of the full scores of the best few pairs of each group."""
        few = cut(top_k(pairs, group, best, SEED_CHUNKS * k, rank_col="at"))
        scored = top_k(full_hits(few, questions, index), group, best, k)
        floor = scored.groupBy(*group).agg(F.count("*").alias("n"), F.min("hits").alias("low"))
        return floor.select(*group, F.when(F.col("n") >= k, F.col("low")).otherwise(1).alias("floor"))

    weights = cut(token_weights(questions, tables, seed_share))
    seeds = cut(hit_sums(weights.filter("seed"), tables))
    floor = threshold(seeds)
    needed = weights.join(floor, group, "left").withColumn("floor", F.coalesce("floor", F.lit(1)))
    total = F.max("rest").over(Window.partitionBy(*group))
    needed = cut(needed.withColumn("needed", F.col("seed") | (total - F.col("rest") <= MISSED_TIMES * (total - F.col("floor")))))
    weight = lambda which: F.sum(F.when(which, F.col("mult")).otherwise(0))
    open_ = cut(needed.groupBy(*group, "floor").agg(weight(~F.col("needed")).alias("open"), weight(~F.col("seed")).alias("other")))
    # the seeds' hits are known; chunks that all the other tokens would not lift to the threshold are left out
    seeds = join_small(seeds, open_, group).filter(F.col("hits") + F.col("other") >= F.col("floor")).select("question_id", *KEY, "hits")
    sums = seeds.unionByName(hit_sums(needed.filter("needed and not seed"), tables)).groupBy("question_id", *KEY).agg(F.sum("hits").alias("hits"))
    reach = join_small(sums, open_, group).filter(F.col("hits") + F.col("open") >= F.col("floor"))
    reach = cut(reach.select("question_id", *KEY, "hits", "open"))
    left = cut(join_small(reach, threshold(reach), group).filter(F.col("hits") + F.col("open") >= F.col("floor")))
    ranked = top_k(full_hits(left, questions, index), group, best, k)
    return ranked.select("question_id", *KEY, (F.col("hits") / F.col("tokens")).alias("score"), "rank")


# ---- one scan of the texts

#: Bytes of question tokens in a block, and about what one (question, token) entry takes; chunks in a block.
TOKEN_BYTES, ENTRY_BYTES, CHUNKS_PER_BLOCK = 64 << 20, 48, 50_000
#: Chunks whose terms are matched at once, and cells of (chunk, token) or (chunk, question) at once.
TERM_CHUNKS, HIT_CELLS = 5_000, 500_000
TERM = re.compile(f"{WORD_TOKEN_REGEX}|{CJK_TOKEN_REGEX}")
BASE = 0x9E3779B97F4A7C15


class Asked(NamedTuple):
    """A block of questions: their ids and token counts, the distinct tokens, and the entries (question, weight) of each
    token from ``begins[token]`` to ``begins[token + 1]``."""

    ids: pa.Array
    ntok: np.ndarray
    tokens: list[str]
    begins: np.ndarray
    question: np.ndarray
    weight: np.ndarray


def asked(entries: pa.Table) -> Asked:
    """From entries (question_id, token, mult)."""
    ids, tokens = (entries.column(c).combine_chunks().dictionary_encode() for c in ("question_id", "token"))
    question, token = ids.indices.to_numpy(), tokens.indices.to_numpy()
    order, weight = np.argsort(token, kind="stable"), entries.column("mult").to_numpy()
    begins = np.concatenate(([0], np.cumsum(np.bincount(token, minlength=len(tokens.dictionary)))))
    ntok = np.bincount(question, weights=weight, minlength=len(ids.dictionary)).astype(np.int64)
    return Asked(ids.dictionary, ntok, tokens.dictionary.to_pylist(), begins, question[order], weight[order])


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32).astype(np.uint64)


def _prefix(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    powers = np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(len(codes), BASE, dtype=np.uint64))), dtype=np.uint64)
    return np.concatenate((np.zeros(1, np.uint64), np.cumsum(codes * powers[:-1], dtype=np.uint64))), powers


def matches(terms: list[str], tokens: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(term, token) pairs of which the token is a substring of the term."""
    codes = _codes("\x00".join(terms))
    sums, powers = _prefix(codes)
    owner = np.repeat(np.arange(len(terms)), [len(t) + 1 for t in terms])
    sizes, pairs = np.array([len(t) for t in tokens]), [np.zeros(0, np.int64)]
    for size in np.unique(sizes):
        own = np.flatnonzero(sizes == size)
        letters = _codes("".join(tokens[i] for i in own)).reshape(len(own), size)
        # hashes of position p carry the factor BASE**p, so tokens are compared at the end of the text
        n = max(0, len(codes) - size + 1)
        found = (sums[size:][:n] - sums[:n]) * powers[len(codes) :: -1][:n]
        wanted = (letters * powers[:size]).sum(axis=1, dtype=np.uint64) * powers[len(codes)]
        order = np.argsort(wanted, kind="stable")
        maybe = np.zeros(1 << 20, dtype=bool)  # most substrings that are no token end here
        maybe[wanted >> np.uint64(44)] = True
        here = np.flatnonzero(maybe[found >> np.uint64(44)])
        at = np.minimum(np.searchsorted(wanted[order], found[here]), len(own) - 1)
        same = wanted[order][at] == found[here]
        here, token = here[same], order[at[same]]
        _, first = np.unique(owner[here] * len(own) + token, return_index=True)
        here, token = here[first], token[first]
        same = np.ones(len(here), dtype=bool)
        for i in range(size):
            same &= codes[here + i] == letters[token, i]
        pairs.append(owner[here[same]] * len(tokens) + own[token[same]])
    both = np.concatenate(pairs)
    return both // max(len(tokens), 1), both % max(len(tokens), 1)


def text_scores(keys: pa.Table, texts: list[str | None], block: Asked, k: int) -> Iterator[pa.Table]:
    """The best k chunks (keys, question_id, score) of each question and collection, by their texts.

    The terms of ``TERM_CHUNKS`` chunks are matched together; hits are summed for as many chunks at once as make ``HIT_CELLS``
    cells with the tokens or the questions, so the work arrays do not grow with the batch. Each step is a call of its own,
    which frees its arrays before the next one makes its own."""
    names = keys.column("collection_name").to_numpy(zero_copy_only=False) if "collection_name" in keys.column_names else np.zeros(len(texts))
    for first in range(0, len(texts), TERM_CHUNKS):
        row, question, hits = _best_of_texts(names, texts, first, block, k)
        out = keys.take(pa.array(row)).append_column("question_id", block.ids.take(pa.array(question)))
        yield out.append_column("score", pa.array(hits / block.ntok[question]))


def _best_of_texts(names: np.ndarray, texts: list[str | None], first: int, block: Asked, k: int) -> tuple[np.ndarray, ...]:
    """(row, question, hits) of the best k of the ``TERM_CHUNKS`` chunks from ``first`` on."""
    known: defaultdict[str, int] = defaultdict()
    known.default_factory = known.__len__  # a new term gets the next number
    held = [list(map(known.__getitem__, set(TERM.findall(text.lower())))) if text else [] for text in texts[first : first + TERM_CHUNKS]]
    term, token = matches(list(known), block.tokens)
    counts = np.bincount(term, minlength=len(known))
    token, begins = token[np.argsort(term, kind="stable")], np.cumsum(counts) - counts
    step = max(1, HIT_CELLS // max(len(block.ntok), len(block.tokens), 1))
    best, kept, most = [], 0, KEPT_ROWS
    for lo in range(0, len(held), step):
        hits = _hits(held[lo : lo + step], counts, begins, token, block)
        row, question = best_rows(np.where(hits > 0, hits, -1), names[first + lo : first + lo + len(hits)], k)
        best.append((row + first + lo, question, hits[row, question]))
        kept += len(row)
        if kept > most:
            best = [first_ranked(names, best, k)]
            kept, most = len(best[0][0]), max(KEPT_ROWS, 2 * len(best[0][0]))
    return first_ranked(names, best, k)


def _hits(some: list[list[int]], counts: np.ndarray, begins: np.ndarray, token: np.ndarray, block: Asked) -> np.ndarray:
    """Hits (chunk x question) of chunks that have these terms; term t holds ``counts[t]`` tokens from ``begins[t]`` on."""
    n_questions, n_tokens = len(block.ntok), len(block.tokens)
    # the tokens of each chunk, once each
    chunk = np.repeat(np.arange(len(some)), [len(h) for h in some])
    terms = np.fromiter(chain.from_iterable(some), dtype=np.int64, count=len(chunk))
    size = counts[terms]
    has = np.zeros(len(some) * n_tokens, dtype=bool)
    has[np.repeat(chunk * n_tokens, size) + token[_ranges(begins[terms], size)]] = True
    chunk, found = np.nonzero(has.reshape(len(some), n_tokens))
    size = block.begins[found + 1] - block.begins[found]
    at = _ranges(block.begins[found], size)
    hits = np.bincount(np.repeat(chunk, size) * n_questions + block.question[at], weights=block.weight[at], minlength=len(some) * n_questions)
    return hits.astype(np.int64).reshape(len(some), n_questions)


def first_ranked(names: np.ndarray, parts: list[tuple[np.ndarray, ...]], k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of parts (row, question, hits), the k with most hits of each question and collection; of equal ones the first rows."""
    row, question, hits = (np.concatenate(c) for c in zip(*parts, strict=True))
    number = {name: i for i, name in enumerate(dict.fromkeys(names))}
    group = np.array([number[name] for name in names[row]], dtype=np.int64) * (question.max(initial=0) + 1) + question
    order = np.lexsort((row, -hits, group))
    new = np.append(True, group[order][1:] != group[order][:-1])[: len(order)]
    begins = np.flatnonzero(new)
    kept = order[np.arange(len(order)) - begins[np.cumsum(new) - 1] < k]
    return row[kept], question[kept], hits[kept]


def _ranges(begins: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers of the ranges of these begins and sizes, one range after the other."""
    return np.repeat(begins - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())


def scan_scores(questions: DataFrame, index: DataFrame, k: int, token_bytes: int = TOKEN_BYTES, plan: str = "auto") -> DataFrame:
    """(question_id, chunk, score, rank): as ``term_scores``, from the texts."""
    keys, entries = key_columns(index), question_tokens(questions)
    size = entries.agg(F.count("*").alias("n"), F.countDistinct("question_id").alias("q")).first()
    schema = T.StructType([*index.select(*keys).schema.fields, questions.schema["question_id"], T.StructField("score", T.DoubleType())])
    q_blocks = max(1, math.ceil(size["n"] * ENTRY_BYTES / token_bytes), math.ceil(size["q"] * k / KEPT_ROWS))

    def scored(rows: pa.Table, block: Asked) -> Iterator[pa.Table]:
        rows = in_key_order(rows.select([*keys, "content"]))
        for out in text_scores(rows.select(keys), rows.column("content").to_pylist(), block, k):
            yield out.select(schema.fieldNames())

    if plan == "broadcast" or (plan == "auto" and q_blocks == 1):
        block = index.sparkSession.sparkContext.broadcast(asked(entries.toArrow()))  # one block at most

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for out in scored(pa.Table.from_batches([batch]), block.value):
                    yield from out.to_batches()

        partial = index.select(*keys, "content").mapInArrow(run, schema)
    else:
        i_blocks = max(1, math.ceil(index.count() / CHUNKS_PER_BLOCK))
        left = entries.select("*", block_of(["question_id"], q_blocks).alias("_q"), all_blocks(i_blocks).alias("_i"))
        right = index.select(*keys, "content", block_of(keys, i_blocks).alias("_i"), all_blocks(q_blocks).alias("_q"))

        def meet(left: pa.Table, right: pa.Table) -> pa.Table:
            out = list(scored(right, asked(left))) if left.num_rows and right.num_rows else []
            none = right.select(keys).slice(0, 0).append_column("question_id", left.column("question_id").slice(0, 0)).append_column("score", pa.array([], pa.float64()))
            return pa.concat_tables(out) if out else none.select(schema.fieldNames())

        partial = left.groupBy("_q", "_i").cogroup(right.groupBy("_q", "_i")).applyInArrow(meet, schema)
    group = ["question_id", *(["collection_name"] if "collection_name" in keys else [])]
    return merged_top_k(partial, group, [F.desc("score"), F.asc("doc_ord"), F.asc("chunk_index")], k)
