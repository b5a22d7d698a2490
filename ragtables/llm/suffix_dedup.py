"""Exact removal of repeated byte strings by a depth-limited radix sort of suffixes.

A byte is removed if it is covered by a string of ``LENGTH`` bytes that also starts in a document with a smaller
doc_id. Suffixes are compared to depth LENGTH only, most significant digit first, and a suffix that is alone after a
digit leaves the sort:

1. First digit: ``SEED`` bytes. Of the LENGTH - SEED + 1 suffixes that start in a window of LENGTH bytes the one with
   the smallest seed hash (the leftmost of equals) stands for the window. The choice depends on the window's bytes
   alone, so equal windows choose suffixes with equal first digits, and about 2 in 34 suffixes enter the sort. The
   whole reach of a chosen suffix (all windows that can choose it) is hashed with it: equal reaches are equal windows
   throughout, so each but that of the smallest document is removed at once.
2. Second digit, only where a first digit has several reaches: the seed with half of the reach on its left, and with
   half of it on its right. Every window holds one of the two.
3. Full depth, only on the sides where a second digit is shared by documents: the windows that chose the suffix.

Each task first combines its own suffixes: what repeats a smaller document of the same task is settled there and
only the smallest document's suffix of each group is shuffled, so a passage in a third of all documents sends at
most a few rows per task. Rows travel packed, one byte string for each task and bucket; the number of buckets grows
with the text, so a bucket holds about ``BUCKET_BYTES``.

Groups are compared by hashes of 64 bits (first digit) or 56 bits (later ones) and the bucket's own bits, which grow
with the data.

Defined results: null text is empty; texts under LENGTH bytes keep everything; rows with a null doc_id keep
everything and cause no removal; rows with equal doc_id do not remove each other and each is judged by its own text;
extra columns are dropped; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ragtables.llm import textarrays as ta

LENGTH = 50
SEED = 18
BUCKET_BYTES = 24 << 20
FLUSH_ROWS = 3_000_000
#: bytes kept of digit and hash in the first stage and later (the later digit follows from the hash)
FIRST_WIDTHS, LATER_WIDTHS = (3, 5), (1, 6)
#: bytes kept of the steps of doc_id, tag and position, and of doc_id, tag, start and length
PLACE_WIDTHS, RUN_WIDTHS = (8, 5, 4), (8, 5, 4, 4)
ROW_BYTES = 25
PACKED = "bucket long, settled boolean, rows binary"
FOUND = "doc_id long, tag int, start int, stop int, open boolean"
RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def sliding_argmin(key: np.ndarray, size: int) -> np.ndarray:
    """Minimum of each run of ``size`` values, by doubling."""
    low, width = key, 1
    while width * 2 <= size:
        low = np.minimum(low[: len(low) - width], low[width:])
        width *= 2
    rest = size - width
    return np.minimum(low[: len(low) - rest], low[rest:]) if rest else low


def window_choices(data: np.ndarray, offs: np.ndarray, length: int, seed: int) -> tuple[ta.Substrings, np.ndarray, np.ndarray, np.ndarray]:
    """(substrings, first digit of each position, starts of all windows of a block, the suffix that each one chooses)."""
    n = len(data)
    subs = ta.Substrings(data)
    if n < length:
        return subs, np.zeros(0, ta.U64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    digit = ta.mix((subs.prefix[seed:] - subs.prefix[:-seed]) * subs.down[: n - seed + 1])
    key = (digit & ta.U64(0xFFFFFFFF00000000)) | np.arange(n - seed + 1).astype(ta.U64)
    best = (sliding_argmin(key, length - seed + 1) & ta.U64(0xFFFFFFFF)).astype(np.int64)
    stop = np.repeat(offs[1:], np.diff(offs))
    start = np.flatnonzero(np.arange(len(best)) + length <= stop[: len(best)])
    return subs, digit, start, best[start]


def chosen_suffixes(data: np.ndarray, offs: np.ndarray, length: int, seed: int) -> tuple[np.ndarray, ...]:
    """(document, position in the block, first digit, reach) of the suffixes that stand for windows."""
    subs, digit, _, pos = window_choices(data, offs, length, seed)
    pos = pos[np.append(True, pos[1:] != pos[:-1])] if len(pos) else pos
    doc = ta.owners(offs, pos)
    start, end = np.maximum(pos - (length - seed), offs[doc]), np.minimum(pos + length, offs[doc + 1])
    reach = ta.mix(subs.raw(start, end) + (pos - start).astype(ta.U64) * ta.U64(0xD6E8FEB86659FD93) + (end - start).astype(ta.U64))
    return doc, pos, digit[pos], reach


def merged(start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Unions of overlapping or touching ranges."""
    if not len(start):
        return start, stop
    order = np.argsort(start, kind="stable")
    start, stop = start[order], np.maximum.accumulate(stop[order])
    new = np.append(True, start[1:] > stop[:-1])
    return start[new], stop[np.append(np.flatnonzero(new)[1:], len(start)) - 1]


def merged_by_document(doc: np.ndarray, tag: np.ndarray, start: np.ndarray, stop: np.ndarray) -> list[np.ndarray]:
    """Unions of ranges within each (doc, tag)."""
    if not len(doc):
        return [doc, tag, start, stop]
    order = np.lexsort((start, tag, doc))
    doc, tag, start, stop = doc[order], tag[order], start[order].astype(np.int64), stop[order].astype(np.int64)
    group = np.cumsum(np.append(False, (doc[1:] != doc[:-1]) | (tag[1:] != tag[:-1])))
    shift = group * (1 << 33)  # groups apart, so that one pass merges all
    lo, hi = merged(start + shift, stop + shift)
    at = np.searchsorted(group, lo >> 33)
    base = (lo >> 33) << 33
    return [doc[at], tag[at], (lo - base).astype(np.int32), (hi - base).astype(np.int32)]


def to_planes(columns: list[np.ndarray], widths: tuple[int, ...]) -> bytes:
    """The low bytes of 64-bit columns, plane by plane; planes of zero bytes cost nothing once Spark compresses them."""
    return b"".join(np.ascontiguousarray(np.ascontiguousarray(c).view(np.uint8).reshape(-1, 8)[:, :w].T).tobytes() for c, w in zip(columns, widths, strict=True))


def from_planes(blob: bytes, widths: tuple[int, ...]) -> list[np.ndarray]:
    n, at, columns = len(blob) // sum(widths), 0, []
    for w in widths:
        wide = np.zeros((n, 8), dtype=np.uint8)
        wide[:, :w] = np.frombuffer(blob, dtype=np.uint8, count=n * w, offset=at).reshape(w, n).T
        columns.append(wide.reshape(-1).view(ta.U64))
        at += n * w
    return columns


def place_steps(doc: np.ndarray, tag: np.ndarray, pos: np.ndarray) -> list[np.ndarray]:
    """Steps of doc_id, tag and position of rows in order of these; the first row of each (doc_id, tag) has bit 32 in its tag."""
    same = np.append(False, (doc[1:] == doc[:-1]) & (tag[1:] == tag[:-1]))[: len(doc)]
    tags = np.where(same, 0, (tag.astype(np.int64) & 0xFFFFFFFF) | (1 << 32))
    step = [np.diff(doc, prepend=doc.dtype.type(0)), tags, np.where(same, np.diff(pos, prepend=0), pos)]
    return [x.astype(np.int64).view(ta.U64) for x in step]


def places(doc: np.ndarray, tag: np.ndarray, pos: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """doc_id, tag and position from their steps."""
    new = np.flatnonzero(tag >> ta.U64(32))
    size = np.diff(np.append(new, len(doc)))
    pos = pos.astype(np.uint32).view(np.int32).astype(np.int64)
    total = np.cumsum(pos)
    return np.cumsum(doc, dtype=ta.U64).view(np.int64), np.repeat(tag.astype(np.uint32).view(np.int32)[new], size), total - np.repeat(total[new] - pos[new], size)


def packed(digit: np.ndarray, key: np.ndarray, doc: np.ndarray, tag: np.ndarray, pos: np.ndarray, widths: tuple[int, int]) -> bytes:
    """Rows as byte planes, ordered by document."""
    order = np.lexsort((pos, tag, doc))
    return to_planes([digit[order], key[order], *place_steps(doc[order], tag[order], pos[order])], widths + PLACE_WIDTHS)


def unpacked(blobs: list[bytes], widths: tuple[int, int]) -> list[np.ndarray]:
    """digit, hash (as far as they are kept), doc_id, tag and position of packed rows."""
    parts: list[list[np.ndarray]] = [[np.zeros(0, t)] for t in (ta.U64, ta.U64, np.int64, np.int32, np.int64)]
    for blob in blobs:
        digit, key, *step = from_planes(blob, widths + PLACE_WIDTHS)
        for part, x in zip(parts, (digit, key, *places(*step)), strict=True):
            part.append(x)
    return [np.concatenate(p) for p in parts]


def packed_runs(runs: list[np.ndarray]) -> bytes:
    doc, tag, start, stop = runs
    order = np.lexsort((start, tag, doc))
    length = (stop - start)[order].astype(np.int64).view(ta.U64)
    return to_planes([*place_steps(doc[order], tag[order], start[order].astype(np.int64)), length], RUN_WIDTHS)


def unpacked_runs(blobs: list[bytes]) -> list[np.ndarray]:
    parts: list[list[np.ndarray]] = [[np.zeros(0, t)] for t in (np.int64, np.int32, np.int32, np.int32)]
    for blob in blobs:
        *step, length = from_planes(blob, RUN_WIDTHS)
        doc, tag, start = places(*step)
        for part, x in zip(parts, (doc, tag, start.astype(np.int32), (start + length.view(np.int64)).astype(np.int32)), strict=True):
            part.append(x)
    return [np.concatenate(p) for p in parts]


def smallest_first(group: list[np.ndarray], doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order, first row of the ordered row's group, whether each ordered row is of the smallest document of its group)."""
    order = np.lexsort((doc, *group))
    new = np.zeros(len(order), dtype=bool)
    for column in group:
        sorted_ = column[order]
        new |= np.append(True, sorted_[1:] != sorted_[:-1])[: len(order)]
    number = np.cumsum(new) - 1
    least = doc[order][np.flatnonzero(new)][number] if len(order) else doc
    return order, number, doc[order] == least


class Stage:
    """One digit of the sort: how rows of a task are combined and how a bucket is settled.

    ``before`` and ``after``: bytes around a position that a settled row covers; ``half``: rows are not removed but
    kept for the next digit if another document shares theirs; ``last``: nothing is left to order.
    """

    def __init__(self, buckets: int, before: int = 0, after: int = 0, half: bool = False, last: bool = False):
        self.buckets, self.before, self.after, self.half, self.last = buckets, before, after, half, last
        self.widths = LATER_WIDTHS if half or last else FIRST_WIDTHS

    def settled(self, doc: np.ndarray, tag: np.ndarray, pos: np.ndarray) -> list[np.ndarray]:
        if self.half:
            return [doc, tag, pos.astype(np.int32), pos.astype(np.int32)]
        return merged_by_document(doc, tag, np.maximum(pos - self.before, 0), pos + self.after)

    def combined(self, parts: list[tuple]) -> Iterator[pa.RecordBatch]:
        """A task's rows: those of the smallest documents by bucket, the others settled and spread by document."""
        digit, key, doc, tag, pos = (np.concatenate(c) for c in zip(*parts, strict=True))
        parts.clear()  # held once while they are sorted and sent
        order, number, least = smallest_first([key, digit], doc)
        ship, done = order[least], order[~least]
        pos = pos.astype(np.int64)
        if self.half:  # the smallest document's row is shared too
            done = np.append(done, order[least & (np.bincount(number, weights=~least) > 0)[number]])
        for bucket, at in ta.buckets_of((digit[ship] >> ta.U64(32)).astype(np.int64) % self.buckets):
            at = ship[at]
            yield pa.RecordBatch.from_pydict({"bucket": [bucket], "settled": [False], "rows": [packed(digit[at], key[at], doc[at], tag[at], pos[at], self.widths)]})
        runs = self.settled(doc[done], tag[done], pos[done])
        for bucket, at in ta.buckets_of((ta.mix(runs[0].view(ta.U64)) % ta.U64(self.buckets)).astype(np.int64)):
            yield pa.RecordBatch.from_pydict({"bucket": [bucket], "settled": [True], "rows": [packed_runs([r[at] for r in runs])]})

    def settle(self, rows: DataFrame) -> DataFrame:
        """Ranges to remove (open is false) and positions to order further (open is true)."""

        def run(group: pa.Table) -> pa.Table:
            blobs, done = group.column("rows").to_pylist(), group.column("settled").to_pylist()
            runs = unpacked_runs([b for b, s in zip(blobs, done, strict=True) if s])
            digit, key, doc, tag, pos = unpacked([b for b, s in zip(blobs, done, strict=True) if not s], self.widths)
            order, number, least = smallest_first([key, digit], doc)
            over = order[~least]
            found = [np.concatenate(x) for x in zip(runs, self.settled(doc[over], tag[over], pos[over]), strict=True)]
            left = order[least]
            if self.half:
                shared = np.bincount(number, weights=~least) > 0 if len(number) else np.zeros(0, bool)
                left = left[shared[number[least]]]
            elif self.last:
                left = left[:0]
            elif len(left):
                left = left[np.argsort(digit[left], kind="stable")]
                d, k, o = digit[left], key[left], doc[left]
                firsts = np.flatnonzero(np.append(True, d[1:] != d[:-1]))
                size = np.diff(np.append(firsts, len(d)))
                several = (np.minimum.reduceat(k, firsts) != np.maximum.reduceat(k, firsts)) & (np.minimum.reduceat(o, firsts) != np.maximum.reduceat(o, firsts))
                left = left[np.repeat(several, size)]
            columns = [np.concatenate((f, x[left].astype(f.dtype))) for f, x in zip(found, (doc, tag, pos, pos), strict=True)]
            is_open = np.repeat([self.half, True], [len(found[0]), len(left)])
            return pa.table([pa.array(c.astype(t)) for c, t in zip(columns, (np.int64, np.int32, np.int32, np.int32), strict=True)] + [pa.array(is_open)], names=["doc_id", "tag", "start", "stop", "open"])

        return rows.groupBy("bucket").applyInArrow(run, FOUND)


class Collected:
    """Rows of a task until they are combined and sent."""

    def __init__(self, stage: Stage):
        self.parts: list[tuple] = []
        self.count, self.stage = 0, stage

    def add(self, *columns: np.ndarray) -> Iterator[pa.RecordBatch]:
        if len(columns[0]):
            self.parts.append(columns)
            self.count += len(columns[0])
        if self.count >= FLUSH_ROWS:
            yield from self.flush()

    def flush(self) -> Iterator[pa.RecordBatch]:
        if self.parts:
            yield from self.stage.combined(self.parts)
        self.parts, self.count = [], 0


def suffix_rows(rows: DataFrame, stage: Stage, length: int, seed: int) -> DataFrame:
    """First digit and reach of the chosen suffixes of (doc_id, tag, text), combined by task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = Collected(stage)
        for batch in batches:
            ids, tags = batch.column("doc_id").to_numpy(zero_copy_only=False), batch.column("tag").to_numpy(zero_copy_only=False)
            for lo, _, b, o in ta.blocks(*ta.text_buffers(batch.column("text"))):
                doc, pos, digit, key = chosen_suffixes(b, o, length, seed)
                yield from held.add(digit, key, ids[lo + doc], tags[lo + doc], (pos - o[doc]).astype(np.int32))
        yield from held.flush()

    return rows.filter("doc_id is not null").select("doc_id", "tag", "text").mapInArrow(run, PACKED)


def opened_rows(rows: DataFrame, stage: Stage, cut) -> DataFrame:
    """Rows of the strings that ``cut`` finds for the open positions of (doc_id, tag, text, opened), combined by task.

    cut(data, bounds, document, value) gives (document, start, stop, value) of strings in a block.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = Collected(stage)
        for batch in batches:
            batch = batch.filter(batch.column("opened").is_valid())
            if not batch.num_rows:
                continue
            opened = batch.column("opened")
            ids, tags = batch.column("doc_id").to_numpy(zero_copy_only=False), batch.column("tag").to_numpy(zero_copy_only=False)
            value, of = opened.flatten().to_numpy().astype(np.int64), np.repeat(np.arange(batch.num_rows), opened.value_lengths().to_numpy())
            for lo, hi, b, o in ta.blocks(*ta.text_buffers(batch.column("text"))):
                mine = slice(*np.searchsorted(of, (lo, hi)))
                doc, start, stop, out = cut(b, o, of[mine] - lo, value[mine])
                if len(doc):
                    key = ta.Substrings(b).hashes(start, stop) ^ ((out & 1).astype(ta.U64) if stage.half else ta.U64(0))
                    yield from held.add(ta.mix(key ^ ta.U64(0xA5A5A5A5)), key, ids[lo + doc], tags[lo + doc], out)
        yield from held.flush()

    return rows.mapInArrow(run, PACKED)


def chosen_sides(b: np.ndarray, o: np.ndarray, length: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """(starts of all windows of a block, twice the suffix that each chose, plus one if it has less than half of its reach on the left)."""
    _, _, start, best = window_choices(b, o, length, seed)
    return start, 2 * best + (best - start < (length - seed + 1) // 2)


def among(values: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Whether each value is in ``wanted`` (sorted, distinct)."""
    if not len(wanted):
        return np.zeros(len(values), dtype=bool)
    return wanted[np.minimum(np.searchsorted(wanted, values), len(wanted) - 1)] == values


def halves(length: int, seed: int):
    """The strings of the second digit of each side on which a window chose the open position; their value is twice
    the position, and one more for the right one."""
    left = (length - seed + 1) // 2
    right = length - seed - left + 1

    def cut(b: np.ndarray, o: np.ndarray, doc: np.ndarray, pos: np.ndarray) -> tuple[np.ndarray, ...]:
        _, own = chosen_sides(b, o, length, seed)
        own = own[np.append(True, own[1:] != own[:-1])] if len(own) else own
        own = np.unique(own[among(own >> 1, np.unique(o[doc] + pos))])
        at, side = own >> 1, own & 1
        start, stop = at - np.where(side == 0, left, 0), at + seed + np.where(side == 0, 0, right)
        doc = ta.owners(o, at)
        return doc, start, stop, 2 * (at - o[doc]) + side

    return cut


def windows(length: int, seed: int):
    """The windows that chose an open position, on its open side; their value is their start in the document."""

    def cut(b: np.ndarray, o: np.ndarray, doc: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, ...]:
        start, own = chosen_sides(b, o, length, seed)
        start = start[among(own, np.unique(2 * (o[doc] + (value >> 1)) + (value & 1)))]
        doc = ta.owners(o, start)
        return doc, start, start + length, start - o[doc]

    return cut


def number_of_buckets(rows: int) -> int:
    return 1 + rows * ROW_BYTES // BUCKET_BYTES


def repeated_ranges(docs: DataFrame, length: int = LENGTH, seed: int = SEED) -> DataFrame:
    """Every row of ``docs`` (doc_id, tag, text and others) with ``ranges``: byte ranges to remove, in any order."""
    ta.bounded_batches(docs.sparkSession)
    size = docs.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    reach = length - seed
    chosen = 2 * size // (reach + 2)

    def again(found: DataFrame, most_rows: int, cut, **kind) -> DataFrame:
        """The next digit of the open positions. All joins of docs are in one plan and share one shuffle of docs."""
        opened = found.filter("open").groupBy("doc_id", "tag").agg(F.collect_list("start").alias("opened"))
        stage = Stage(number_of_buckets(most_rows), **kind)
        return stage.settle(opened_rows(docs.join(opened, ["doc_id", "tag"], "left"), stage, cut))

    stage = Stage(number_of_buckets(chosen), reach, length)
    first = stage.settle(suffix_rows(docs, stage, length, seed)).persist(StorageLevel.MEMORY_AND_DISK)
    second = again(first, 2 * chosen, halves(length, seed), half=True)
    third = again(second, size, windows(length, seed), after=length, last=True)
    both = F.shiftleft(F.col("start").cast("long"), 32).bitwiseOR(F.col("stop").cast("long"))
    found = first.filter("not open").unionByName(third).select("doc_id", "tag", both.alias("range"))
    # ranges of a document come from many buckets: single rows are smaller than the partial lists of each task
    ranges = found.repartition("doc_id", "tag").groupBy("doc_id", "tag").agg(F.collect_list("range").alias("ranges"))
    return docs.join(ranges, ["doc_id", "tag"], "left")


def row_ranges(ranges: pa.Array, offs: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(row, start, stop) of the merged ranges (start * 2**32 + stop) of each row, clipped to its text."""
    counts = ranges.value_lengths().fill_null(0).to_numpy()
    both = ranges.flatten().to_numpy()
    row = np.repeat(np.arange(len(counts)), counts)
    start, stop = both >> 32, both & 0xFFFFFFFF
    of, _, start, stop = merged_by_document(row, np.zeros(len(row), np.int64), start, np.minimum(stop, np.diff(offs)[row]))
    return zip(of.tolist(), start.tolist(), stop.tolist(), strict=True)


def cut_texts(batch: pa.RecordBatch) -> Iterator[tuple[int, int, int, bytes]]:
    """(bytes, removed bytes, spans, kept bytes) of each row of (doc_id, tag, text, ranges)."""
    data, offs = ta.text_buffers(batch.column("text"))
    spans: list[list[tuple[int, int]]] = [[] for _ in range(batch.num_rows)]
    for row, start, stop in row_ranges(batch.column("ranges"), offs):
        spans[row].append((start, stop))
    raw = data.tobytes()
    for i, own in enumerate(spans):
        text = raw[offs[i] : offs[i + 1]]
        removed, kept, at = 0, [], 0
        for start, stop in own:
            kept.append(text[at:start])
            removed, at = removed + stop - start, stop
        yield len(text), removed, len(own), b"".join([*kept, text[at:]])


def tagged(docs: DataFrame, columns: list[str]) -> DataFrame:
    return docs.select(*columns).withColumns({"doc_id": F.col("doc_id").cast("long"), "tag": F.hash("text")})


def suffix_dedup(docs: DataFrame, length: int = LENGTH, seed: int = SEED) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every document."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = [(n, removed, spans, hashlib.sha256(kept).hexdigest()) for n, removed, spans, kept in cut_texts(batch)]
        columns = list(zip(*rows, strict=True)) or [()] * 4
        arrays = [batch.column("doc_id")] + [pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.string()), strict=True)]
        return pa.RecordBatch.from_arrays(arrays, names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return ta.map_arrow(repeated_ranges(tagged(docs, ["doc_id", "text"]), length, seed), run, RESULT, "text")


def cut_documents(docs: DataFrame, columns: list[str], length: int = LENGTH, seed: int = SEED) -> DataFrame:
    """``columns`` (doc_id, text and others) of every document with the repeated strings cut from ``text``.

    Cuts are made on bytes; what is left of a character that a cut divides is dropped. Null text stays null.
    """
    rows = repeated_ranges(tagged(docs, columns), length, seed)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        there = batch.column("text").is_valid().to_pylist()
        kept = [text.decode("utf-8", "ignore") if t else None for t, (*_, text) in zip(there, cut_texts(batch), strict=True)]
        arrays = [pa.array(kept, pa.string()) if c == "text" else batch.column(c) for c in columns]
        return pa.RecordBatch.from_arrays(arrays, names=columns)

    return ta.map_arrow(rows, run, rows.select(*columns).schema, "text")
