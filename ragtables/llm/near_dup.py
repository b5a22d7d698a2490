"""Near-duplicate classes by ProbMinHash, banding and verification.

Shingles are the runs of five words (ASCII white space between; a shorter text with a word is one shingle), weighted
by 1 + ln(count) / 4. Each shingle emits exponential arrivals at the rate of its weight, each to another register
(sampling without replacement); a register keeps the shingle of its earliest arrival. A shingle stops as soon as its
next arrival is later than all registers of its document, so few arrivals are made. Two registers agree with the
probability Jaccard similarity of the weighted sets.

Registers are banded (32 bands of 4: a pair of similarity 0.8 is missed with probability 5e-8, one of 0.7 with 2e-4).
Texts with equal words are one node. Candidates are verified on the texts: the Jaccard similarity of the sets of
shingles must be at least ``threshold``. No bucket is expanded into all pairs: in each round every node is compared
with one leader of its bucket that is not yet in its class (the smallest, then random ones), and classes are joined.
The nodes that still share a bucket with another class are then compared exactly and without a cap: they meet again in
wide buckets (16 bands of 3: similarity 0.8 is missed with probability 1e-5), each cut into blocks of bounded size, and
a task computes all similarities of two blocks by a matrix product. Two blocks of a bucket's largest class never meet,
and a block gives only the links that join classes, so no pairs are emitted.

Defined results: class_id is the smallest doc_id of the class; a text without words (also null) is a class of its
own; rows with a null doc_id get a null class and take no part; repeated rows are kept, with equal classes; extra
columns are dropped; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ragtables.llm import bitmaps
from ragtables.llm import textarrays as ta
from ragtables.llm.storage import cut

WORDS = 5
THRESHOLD = 0.8
BANDS, ROWS = 32, 4
WIDE_BANDS, WIDE_ROWS = 16, 3
#: Texts and bytes of text in a block of the exact comparison.
BLOCK_TEXTS, BLOCK_BYTES = 500, 1 << 20
REGISTERS = BANDS * ROWS
ROUNDS = 2
#: Links in a partition of the steps that join classes.
LINKS_PER_PART = 500_000
DOCS_AT_ONCE = 2048


def shingles(data: np.ndarray, offs: np.ndarray, size: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """(document, hash) of all shingles of a block, with repeats, ordered by document."""
    starts, ends = ta.words(data, offs)
    bounds = ta.per_document(starts, offs)
    counts = np.diff(bounds)
    h = ta.Substrings(data).hashes(starts, ends)
    owner = np.repeat(np.arange(len(counts)), counts)
    whole = ta.window_hashes(h, size)
    inside = owner[: len(whole)] == owner[size - 1 :] if len(whole) else np.zeros(0, bool)
    doc, out = owner[: len(whole)][inside], whole[inside]
    short = np.flatnonzero((counts > 0) & (counts < size))
    if len(short):
        row, at = ta.ragged(counts[short])
        factor = np.cumprod(np.full(size, ta.BASE, dtype=ta.U64))
        total = np.zeros(len(short), dtype=ta.U64)
        np.add.at(total, row, h[bounds[short][row] + at] * factor[at])
        doc, out = np.append(doc, short), np.append(out, ta.mix(total + counts[short].astype(ta.U64)))
        order = np.argsort(doc, kind="stable")
        doc, out = doc[order], out[order]
    return doc, out


def distinct(doc: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, hash, count) of the distinct shingles of each document."""
    order = np.lexsort((h, doc))
    doc, h = doc[order], h[order]
    new = np.flatnonzero(np.append(True, (doc[1:] != doc[:-1]) | (h[1:] != h[:-1])))[: len(h)]
    return doc[new], h[new], np.diff(np.append(new, len(h)))


def prob_minhash(doc: np.ndarray, h: np.ndarray, weight: np.ndarray, docs: int, registers: int = REGISTERS) -> np.ndarray:
    """Registers (docs x registers) of weighted sets; ``registers`` is a power of two."""
    first = np.full(docs * registers, np.inf)
    value = np.zeros(docs * registers, dtype=ta.U64)
    latest = np.full(docs, np.inf)
    time = np.zeros(len(h))
    places = ta.mix(h ^ ta.U64(0x5851F42D4C957F2D))
    stride, shift = (places | ta.U64(1)), places >> ta.U64(32)
    for i in range(registers):
        u = (ta.mix(h + ta.U64((i + 1) * 0x9E3779B97F4A7C15 % (1 << 64))) >> ta.U64(11)).astype(np.float64)
        time = time - np.log((u + 1) * 2.0**-53) / weight * (registers / (registers - i))
        early = time < latest[doc]
        if not early.all():
            doc, h, weight, time, stride, shift = (x[early] for x in (doc, h, weight, time, stride, shift))
        if not len(h):
            break
        at = doc * registers + ((stride * ta.U64(i) + shift) & ta.U64(registers - 1)).astype(np.int64)
        np.minimum.at(first, at, time)
        won = first[at] == time
        value[at[won]] = h[won]
        latest = first.reshape(docs, registers).max(axis=1)
    return value.reshape(docs, registers)


def band_hashes(registers: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    """Hash of each band of consecutive registers, different for each band."""
    parts = registers[:, : bands * rows].reshape(len(registers), bands, rows)
    total = np.tile(np.arange(1, bands + 1, dtype=ta.U64) * ta.U64(0xD6E8FEB86659FD93), (len(registers), 1))
    for j in range(rows):
        total = ta.mix(total + parts[:, :, j])
    return total


def signatures(docs: DataFrame, count: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(doc_id, content, bands): a hash of the words, null without words, and the band hashes of each document."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        data, offs = ta.text_buffers(batch.column(1))
        content, bands = np.zeros(batch.num_rows, dtype=ta.U64), np.zeros((batch.num_rows, count), dtype=ta.U64)
        some = np.zeros(batch.num_rows, dtype=bool)
        for lo, hi, b, o in ta.blocks(data, offs):
            doc, h = shingles(b, o)
            if not len(doc):
                continue
            begins = np.flatnonzero(np.append(True, doc[1:] != doc[:-1]))
            within = np.arange(len(doc)) - np.repeat(begins, np.diff(np.append(begins, len(doc))))
            up, _ = ta.powers(len(doc))
            content[lo + doc[begins]] = ta.mix(np.add.reduceat(h * up[within], begins) + np.diff(np.append(begins, len(doc))).astype(ta.U64))
            some[lo + doc[begins]] = True
            d, h, n = distinct(doc, h)
            weight = 1 + np.log(n) / 4
            for at in range(0, hi - lo, DOCS_AT_ONCE):
                few = min(DOCS_AT_ONCE, hi - lo - at)
                mine = slice(*np.searchsorted(d, (at, at + few)))
                bands[lo + at : lo + at + few] = band_hashes(prob_minhash(d[mine] - at, h[mine], weight[mine], few), count, rows)
        lists = pa.ListArray.from_arrays(pa.array(np.arange(0, (batch.num_rows + 1) * count, count, dtype=np.int32)), pa.array(bands.reshape(-1).view(np.int64)))
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(content.view(np.int64), mask=~some), lists], names=["doc_id", "content", "bands"])

    texts = docs.filter("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return ta.map_arrow(texts, run, "doc_id long, content long, bands array<long>", "text")


def jaccard(left: tuple[np.ndarray, np.ndarray], right: tuple[np.ndarray, np.ndarray], rows: int) -> np.ndarray:
    """Jaccard similarity of the sets of shingles, row by row."""
    a, ah, _ = distinct(*left)
    b, bh, _ = distinct(*right)
    both, _, times = distinct(np.concatenate((a, b)), np.concatenate((ah, bh)))
    common = np.bincount(both[times > 1], minlength=rows)
    return common / np.maximum(np.bincount(a, minlength=rows) + np.bincount(b, minlength=rows) - common, 1)


def verified(pairs: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a, b) of nodes whose texts are similar enough; a hot b is split by adaptive skew joins."""
    left = pairs.join(texts.select(F.col("node").alias("a"), F.col("text").alias("left")), "a")
    both = left.join(texts.select(F.col("node").alias("b"), F.col("text").alias("right")), "b").select("a", "b", "left", "right")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in ta.row_slices(batch, "left", 2 << 20):
                for few in ta.row_slices(part, "right", 2 << 20):
                    left, right = shingles(*ta.text_buffers(few.column(2))), shingles(*ta.text_buffers(few.column(3)))
                    similar = pa.array(jaccard(left, right, few.num_rows) >= threshold)
                    yield few.select(["a", "b"]).filter(similar)

    return both.mapInArrow(run, "a long, b long")


def linked(links: DataFrame, most: int) -> DataFrame:
    """The distinct links, of which there are at most about ``most``."""
    return cut(links.distinct().coalesce(parts_for(most)))


def parts_for(rows: int) -> int:
    """Partitions for a table of links; few for few rows, so that the many small steps make few files."""
    return 1 + rows // LINKS_PER_PART


def components(edges: DataFrame, rows: int) -> DataFrame:
    """(node, root) of the connected components of ``rows`` edges (a, b), by alternating large and small stars."""
    parts = parts_for(rows)
    edges = cut(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").coalesce(parts).distinct().coalesce(parts))
    state = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).coalesce(parts)
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        edges = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).coalesce(parts).distinct().coalesce(parts)
        least = edges.groupBy("a").agg(F.min("b").alias("m"))
        small = edges.join(least, "a")
        edges = small.select("a", F.col("m").alias("b")).unionByName(small.filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")))
        edges = cut(edges.coalesce(parts).distinct().coalesce(parts))
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == state:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        state = now


def joined_roots(roots: DataFrame | None, links: DataFrame) -> DataFrame:
    """(node, root) after more links between nodes; nodes that are their own root are left out."""
    rows = links.count()
    if not rows:
        return roots if roots is not None else links.select(F.col("a").alias("node"), F.col("b").alias("root"))
    if roots is None:
        return components(links, rows)
    parts = parts_for(roots.count() + rows)
    a, b = (rooted(links, roots, c).coalesce(parts) for c in "ab")
    edges = links.join(a, "a").coalesce(parts).join(b, "b").select(F.col("a_root").alias("a"), F.col("b_root").alias("b"))
    top = components(edges, rows)
    moved = roots.join(top.select(F.col("node").alias("root"), F.col("root").alias("up")), "root", "left").select("node", F.coalesce("up", "root").alias("root"))
    return cut(moved.coalesce(parts).unionByName(top.join(roots, "node", "left_anti").coalesce(parts)))


def rooted(rows: DataFrame, roots: DataFrame, column: str) -> DataFrame:
    """Distinct values of ``column`` with their roots as ``<column>_root``."""
    found = roots.select(F.col("node").alias(column), "root")
    return rows.select(column).distinct().join(found, column, "left").select(column, F.coalesce("root", column).alias(f"{column}_root"))


def leader_pairs(members: DataFrame, turn: int) -> DataFrame:
    """(a, b): each node and the leader of each of its buckets, where they are of different classes."""
    order = F.col("node") if turn == 0 else F.xxhash64("bucket", "node", F.lit(turn))
    chief = members.groupBy("bucket").agg(F.min(F.struct(order.alias("o"), "node", "root")).alias("l"), F.min("root").alias("low"), F.max("root").alias("high"))
    chief = chief.filter("low <> high").select("bucket", F.col("l.node").alias("b"), F.col("l.root").alias("b_root"))
    pairs = members.join(chief, "bucket").filter("root <> b_root")
    return pairs.select(F.greatest("node", "b").alias("a"), F.least("node", "b").alias("b")).distinct()


def similar_pairs(doc: np.ndarray, h: np.ndarray, docs: int, threshold: float) -> np.ndarray:
    """Whether the Jaccard similarity of each pair of a block's sets is at least ``threshold``, from its distinct shingles."""
    size = np.bincount(doc, minlength=docs)
    _, column, times = np.unique(h, return_inverse=True, return_counts=True)
    rank = np.cumsum(times > 1) - 1  # only shingles of two or more texts count
    held = times[column] > 1
    row, column, common = doc[held], rank[column[held]], np.zeros((docs, docs), dtype=np.float32)
    order = np.argsort(column, kind="stable")
    row, column, width = row[order], column[order], 4096
    for low in range(0, int(column[-1]) + 1 if len(column) else 0, width):
        mine = slice(*np.searchsorted(column, (low, low + width)))
        part = np.zeros((docs, width), dtype=np.float32)
        part[row[mine], column[mine] - low] = 1
        common += part @ part.T
    near = np.zeros((docs, docs), dtype=bool)
    for low in range(0, docs, 128):
        some = common[low : low + 128].astype(np.float64)
        near[low : low + 128] = some / np.maximum(size[low : low + 128, None] + size[None, :] - some, 1) >= threshold
    return near


def block_links(mixed: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """Links (a, b) that join classes, among all pairs of the nodes (node, root) that meet in a wide bucket."""
    own = texts.join(mixed.select("node"), "node", "left_semi").select(F.col("node").alias("doc_id"), "text")
    sizes = own.select(F.col("doc_id").alias("node"), F.octet_length("text").alias("bytes")).groupBy("node").agg(F.sum("bytes").alias("bytes"))
    wide = signatures(own, WIDE_BANDS, WIDE_ROWS).filter("content is not null").select(F.col("doc_id").alias("node"), F.explode("bands").alias("bucket")).distinct()
    placed = cut(wide.join(mixed, "node").join(sizes, "node"))
    classes = placed.groupBy("bucket", "root").agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes"))
    largest = F.max(F.struct("n", "bytes", "root"))
    blocks = lambda n, size: F.ceil(F.greatest(n / BLOCK_TEXTS, size / BLOCK_BYTES, F.lit(1.0)))
    stats = classes.groupBy("bucket").agg(largest.alias("l"), F.sum("n").alias("n"), F.sum("bytes").alias("bytes"), F.count("*").alias("classes")).filter("classes > 1")
    stats = stats.select("bucket", F.col("l.root").alias("main"), blocks(F.col("l.n"), F.col("l.bytes")).alias("mains"), blocks(F.col("n") - F.col("l.n"), F.col("bytes") - F.col("l.bytes")).alias("others"))
    own_block = lambda n: F.pmod(F.xxhash64("node"), n)
    number = F.col("block")
    member = placed.join(stats, "bucket").withColumn("is_main", F.col("root") == F.col("main")).withColumn("block", F.when(F.col("is_main"), own_block(F.col("mains"))).otherwise(own_block(F.col("others"))))
    key = lambda main, x, y: F.struct(F.lit(main).alias("main"), x.alias("x"), y.alias("y"))
    among = F.transform(F.sequence(F.lit(0).cast("long"), F.col("others") - 1), lambda i: key(False, F.least(i, number), F.greatest(i, number)))
    to_main = F.transform(F.sequence(F.lit(0).cast("long"), F.col("mains") - 1), lambda i: key(True, i, number))
    from_main = F.transform(F.sequence(F.lit(0).cast("long"), F.col("others") - 1), lambda i: key(True, number, i))
    sent = member.select("bucket", "node", "root", F.explode(F.when(F.col("is_main"), from_main).otherwise(F.concat(among, to_main))).alias("k"))
    rows = sent.join(texts, "node").select("bucket", "k.main", "k.x", "k.y", "node", "root", "text")

    def run(group: pa.Table) -> pa.Table:
        node, root = group.column("node").to_numpy(), group.column("root").to_numpy().copy()
        out: list[tuple[int, int]] = []
        if root.min() != root.max():
            data, offs = ta.text_buffers(group.column("text"))
            parts = [(lo + d, h) for lo, _, b, o in ta.blocks(data, offs) for d, h in [shingles(b, o)]]
            doc, h, _ = distinct(*(np.concatenate(x) for x in zip(*parts, strict=True)))
            near = similar_pairs(doc, h, len(node), threshold)
            for i, j in zip(*np.nonzero(near & (root[:, None] < root[None, :])), strict=True):
                if root[i] != root[j]:
                    out.append((int(node[i]), int(node[j])))
                    root[root == root[j]] = root[i]
        a, b = zip(*out, strict=True) if out else ((), ())
        return pa.table([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return rows.groupBy("bucket", "main", "x", "y").applyInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD, rounds: int = ROUNDS) -> DataFrame:
    """(doc_id, class_id) of every row of (doc_id, text)."""
    ta.bounded_batches(docs.sparkSession)
    signed = signatures(docs).persist(StorageLevel.MEMORY_AND_DISK)
    nodes = signed.filter("content is not null").groupBy("content").agg(F.min("doc_id").alias("node"), F.first("bands").alias("bands"))
    members = nodes.select("node", F.explode("bands").alias("bucket"))
    shared = members.groupBy("bucket").agg(F.min("node").alias("low"), F.max("node").alias("high")).filter("low <> high").select("bucket")
    members = members.join(shared, "bucket").persist(StorageLevel.MEMORY_AND_DISK)
    wanted = members.select(F.col("node").alias("doc_id")).distinct()
    texts, _ = bitmaps.split(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), "doc_id", wanted)
    texts = texts.join(wanted, "doc_id").select(F.col("doc_id").alias("node"), "text").persist(StorageLevel.MEMORY_AND_DISK)
    roots, done = None, None
    place = lambda: members.withColumn("root", F.col("node")) if roots is None else members.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    for turn in range(rounds):
        pairs = leader_pairs(place(), turn)
        pairs = cut(pairs if done is None else pairs.join(done, ["a", "b"], "left_anti"))
        done = pairs if done is None else done.unionByName(pairs)
        roots = joined_roots(roots, linked(verified(pairs, texts, threshold), pairs.count()))
    several = place().groupBy("bucket").agg(F.min("root").alias("low"), F.max("root").alias("high")).filter("low <> high").select("bucket")
    mixed = cut(place().join(several, "bucket", "left_semi").select("node", "root").distinct())
    roots = joined_roots(roots, linked(block_links(mixed, texts, threshold), mixed.count()))
    named = nodes.join(roots, "node", "left").select("content", F.coalesce("root", "node").alias("node"))
    classes = signed.select("doc_id", "content").join(named, "content", "left").select("doc_id", F.coalesce("node", "doc_id").alias("class_id"))
    nameless = docs.filter("doc_id is null").select(F.col("doc_id").cast("long").alias("doc_id"), F.lit(None).cast("long").alias("class_id"))
    return classes.unionByName(nameless)
