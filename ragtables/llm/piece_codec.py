"""Encoding and decoding with SentencePiece models, by batched Viterbi search in numpy.

Texts are cut into words: before a run of spaces (no piece crosses that border, which is checked when a model is
loaded) and between two ASCII characters that no piece holds side by side. Distinct words of equal length in characters advance together, position by position: the substrings
that end at the position are hashed, their hashes probe the sorted piece keys, and a vectorised maximum over the
admissible pieces stores the back pointer. Back pointers give the pieces of all words of a length at once.

For a unigram model a piece's value is its score plus the best value at its start (the classic search). For a BPE
model the value of a prefix is 0 or -inf: a segmentation is the BPE result exactly if no two neighbouring pieces would
have merged across their border, and each prefix has exactly one last piece of that kind, so the maximum picks it.
Whether two pieces may stand side by side follows from undoing the later of their last merges again and again and
asking for a better merge across the border (``adjacent``). Sums of BPE scores would give other ids than the model's
own encoder; this search gives the same ones.

Characters without a piece become byte pieces (or the unknown piece if the model has none). Runs of spaces before the
last one of a word are pieces of spaces only, merged after all others (also checked when a model is loaded).

Defined results: null text gives a null list; empty text an empty one. U+2581 is the model's own sign of a space and
is decoded as a space. Repeated rows are coded alike; an empty table gives an empty result.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

from ragtables.llm import textarrays as ta

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2
NONE, CHAR = -1, -2  # no piece yet; a character without a piece
SLICE = 2 << 20
#: Words whose pieces a worker remembers; beyond it, it starts anew.
KNOWN_WORDS = 600_000
#: Pairs of pieces of which a worker remembers whether they may stand side by side.
PAIR_SLOTS = 1 << 19
TOP = np.iinfo(np.int64).max


def fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(field number, value) of one message in protocol buffer wire format."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at, value, shift = at + 1, value | (byte & 127) << shift, shift + 7
            if byte < 128:
                return value

    while at < len(data):
        key = varint()
        if key & 7 == 0:
            yield key >> 3, varint()
            continue
        size = varint() if key & 7 == 2 else {1: 8, 5: 4}[key & 7]
        yield key >> 3, data[at : at + size]
        at += size


def read_model(path: str) -> dict:
    """Pieces, scores, kinds and the settings that encoding needs."""
    with open(path, "rb") as f:
        parts = list(fields(f.read()))
    pieces = [dict(fields(v)) for k, v in parts if k == 1]
    trainer, normalizer = (dict(fields(next((v for k, v in parts if k == n), b""))) for n in (2, 3))
    if normalizer.get(2) or normalizer.get(4, 1) or not normalizer.get(3, 1) or not normalizer.get(5, 1):
        raise ValueError("only models with identity normalisation, a dummy prefix and kept white space are supported")
    model = {"pieces": [p[1].decode() for p in pieces], "scores": [struct.unpack("<f", p[2])[0] if 2 in p else 0.0 for p in pieces], "kinds": [p.get(3, NORMAL) for p in pieces], "type": trainer.get(3, UNIGRAM)}
    if model["type"] not in (UNIGRAM, BPE) or USER in model["kinds"]:
        raise ValueError("only unigram and BPE models without user-defined symbols are supported")
    return model


def merged(text: str, rank: dict[str, int]) -> tuple[list[str], tuple[str, str] | None]:
    """BPE of a short text by repeated best merge, leftmost first; also the parts of the last merge."""
    parts, last = list(text), None
    while len(parts) > 1:
        best = min((rank.get(parts[i] + parts[i + 1], TOP), i) for i in range(len(parts) - 1))
        if best[0] == TOP:
            break
        i = best[1]
        last = (parts[i], parts[i + 1])
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
    return parts, last


class Codec:
    """Tables of one model. All are of the size of its vocabulary."""

    def __init__(self, path: str = MODEL):
        m = read_model(path)
        self.bpe = m["type"] == BPE
        kinds = np.array(m["kinds"])
        names = [p.replace(MARK, " ") for p in m["pieces"]]
        normal = [i for i, k in enumerate(kinds) if k == NORMAL]
        if any(" " in names[i].lstrip(" ") for i in normal):
            raise ValueError("a piece crosses a word border")
        by_score = {s: r for r, s in enumerate(sorted({m["scores"][i] for i in normal}, reverse=True))}
        self.rank = np.full(len(names), TOP)
        self.rank[normal] = [by_score[m["scores"][i]] for i in normal]
        self.score = np.array(m["scores"])
        self.unknown_score = min((m["scores"][i] for i in normal), default=0.0) - 10
        rank = {names[i]: int(self.rank[i]) for i in normal}
        ids = {names[i]: i for i in normal}
        spaces = [i for i in normal if not names[i].strip(" ") and len(names[i]) > 1]
        rest = [int(self.rank[i]) for i in normal if names[i].strip(" ")]
        if spaces and rest and min(self.rank[spaces]) <= max(rest) and self.bpe:
            raise ValueError("pieces of spaces must merge last")
        self.space_rank, self.ids = rank, ids
        self.runs: dict[int, list[int]] = {}
        # last merge of each piece; 0 is not used by characters
        self.left, self.right = np.zeros(len(names), dtype=np.int64), np.zeros(len(names), dtype=np.int64)
        self.formed = np.full(len(names) + 1, -1)  # rank of the last merge; characters are there from the start
        keep = []
        for i in normal:
            if len(names[i]) > 1 and self.bpe:
                parts, last = merged(names[i], rank)
                if len(parts) > 1 or not all(p in ids for p in last):
                    continue  # never the result of merges
                self.left[i], self.right[i] = ids[last[0]], ids[last[1]]
                self.formed[i] = rank[names[i]]
            keep.append(i)
        byte = {i: int(m["pieces"][i][1:-1], 16) for i in range(len(names)) if kinds[i] == BYTE}
        self.byte_ids = np.full(256, -1)
        for i, b in byte.items():
            self.byte_ids[b] = i
        self.unknown = int(np.flatnonzero(kinds == UNKNOWN)[0])
        # keys of pieces: hashes of their bytes
        raw = [names[i].encode() if kinds[i] == NORMAL else bytes([byte[i]]) if kinds[i] == BYTE else " ⁇ ".encode() if kinds[i] == UNKNOWN else b"" for i in range(len(names))]
        self.bytes = np.frombuffer(b"".join(raw), dtype=np.uint8)
        self.bounds = np.cumsum([0, *map(len, raw)])
        subs = ta.Substrings(self.bytes)
        self.raw, self.size = subs.raw(self.bounds[:-1], self.bounds[1:]), np.diff(self.bounds)
        keep = np.array(keep, dtype=np.int64)
        h = subs.hashes(self.bounds[keep], self.bounds[keep + 1])
        order = np.argsort(h)
        self.keys, self.key_ids = h[order], keep[order]
        self.maybe = np.zeros(1 << 22, dtype=bool)  # most substrings that are no piece end here
        self.maybe[h >> ta.U64(42)] = True
        inner = np.ones(len(self.bytes), dtype=bool)
        inner[self.bounds[:-1][self.size > 0]] = False
        at = np.flatnonzero(inner)
        self.joined = np.zeros((256, 256), dtype=bool)  # bytes that stand side by side in some piece
        self.joined[128:, :] = self.joined[:, 128:] = True
        self.joined[self.bytes[at - 1], self.bytes[at]] = True
        self.longest = max((len(names[i]) for i in normal), default=1)
        self.forget()

    def forget(self) -> None:
        """Empty the store of words that this worker has already searched."""
        self.known, self.known_at, self.known_size = np.zeros(0, ta.U64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.known_ids = np.zeros(0, np.int32)
        self.pair_key = self.pair_fine = None  # made by the worker

    def distinct_words(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(start, number) in ``known_ids`` of the ids of distinct words with sorted hashes; new words are searched."""
        if len(self.known) > KNOWN_WORDS:
            self.forget()
        at = np.minimum(np.searchsorted(self.known, h), max(len(self.known) - 1, 0))
        new = np.flatnonzero(self.known[at] != h) if len(self.known) else np.arange(len(h))
        if len(new):
            row, step = ta.ragged(ends[new] - starts[new])
            small = data[starts[new][row] + step]  # new words side by side
            bounds = np.concatenate(([0], np.cumsum(ends[new] - starts[new])))
            ids, cuts = self.words(ta.Substrings(small), small, bounds[:-1], bounds[1:])
            keys = np.concatenate((self.known, h[new]))
            order = np.argsort(keys, kind="stable")
            self.known = keys[order]
            self.known_at = np.concatenate((self.known_at, cuts[:-1] + len(self.known_ids)))[order]
            self.known_size = np.concatenate((self.known_size, np.diff(cuts)))[order]
            self.known_ids = np.concatenate((self.known_ids, ids.astype(np.int32)))
            at = np.searchsorted(self.known, h)
        return self.known_at[at], self.known_size[at]

    def find(self, h: np.ndarray) -> np.ndarray:
        """Piece of each hash, or NONE."""
        out = np.full(len(h), NONE)
        some = np.flatnonzero(self.maybe[h >> ta.U64(42)])
        at = np.minimum(np.searchsorted(self.keys, h[some]), len(self.keys) - 1)
        out[some] = np.where(self.keys[at] == h[some], self.key_ids[at], NONE)
        return out

    def adjacent(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether BPE leaves pieces a and b side by side; the last pair of each of ``PAIR_SLOTS`` slots is remembered."""
        if self.pair_key is None:
            self.pair_key, self.pair_fine = np.full(PAIR_SLOTS, -1), np.zeros(PAIR_SLOTS, dtype=bool)
        pair = a * len(self.rank) + b
        slot = (ta.mix(pair.astype(ta.U64)) % ta.U64(PAIR_SLOTS)).astype(np.int64)
        fine, new = self.pair_fine[slot], np.flatnonzero(self.pair_key[slot] != pair)
        if len(new):
            fine[new] = self.never_merged(pair[new])
            self.pair_key[slot[new]], self.pair_fine[slot[new]] = pair[new], fine[new]  # of pairs with one slot the last one, twice
        return fine

    def never_merged(self, pairs: np.ndarray) -> np.ndarray:
        """For pairs of pieces: no better merge across the border at any time."""
        x, y = pairs // len(self.rank), pairs % len(self.rank)
        fine, active = np.ones(len(pairs), dtype=bool), np.arange(len(pairs))
        x_until, y_until = np.full(len(pairs), TOP), np.full(len(pairs), TOP)
        up, _ = ta.powers(1 << 10)
        while len(active):
            across = self.find(ta.mix(self.raw[x] + self.raw[y] * up[self.size[x]] + (self.size[x] + self.size[y]).astype(ta.U64)))
            r = np.where(across >= 0, self.rank[across], TOP)
            merge = (across >= 0) & (r < x_until) & (r <= y_until)
            fine[active[merge]] = False
            undo_x = self.formed[x] > self.formed[y]
            undo_y = ~undo_x & (self.formed[y] >= 0)
            x_until, y_until = np.where(undo_x, self.formed[x], x_until), np.where(undo_y, self.formed[y], y_until)
            x, y = np.where(undo_x, self.right[x], x), np.where(undo_y, self.left[y], y)
            go = ~merge & (undo_x | undo_y)
            active, x, y, x_until, y_until = active[go], x[go], y[go], x_until[go], y_until[go]
        return fine

    def search(self, subs: ta.Substrings, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Viterbi over words of one length: at (words x length + 1) are the byte positions of their characters.

        Gives for each word and position the last piece and its length in characters.
        """
        n, length = at.shape[0], at.shape[1] - 1
        piece = np.full((n, length + 1), NONE)
        back = np.zeros((n, length + 1), dtype=np.int64)
        best = np.zeros((n, length + 1))
        rows = np.arange(n)
        for i in range(1, length + 1):
            value, todo = np.full(n, -np.inf), rows
            for size in range(min(i, self.longest), 0, -1):
                if not len(todo):
                    break
                found = self.find(subs.hashes(at[todo, i - size], at[todo, i]))
                if size == 1:
                    found = np.where(found == NONE, CHAR, found)
                ok = np.flatnonzero(found != NONE)
                if self.bpe:
                    before = piece[todo[ok], i - size]
                    check = np.flatnonzero((before >= 0) & (found[ok] >= 0))
                    fit = np.ones(len(ok), dtype=bool)
                    fit[check] = self.adjacent(before[check], found[ok[check]])
                    ok = ok[fit]
                    gain = np.zeros(len(ok))
                else:
                    gain = best[todo[ok], i - size] + np.where(found[ok] >= 0, self.score[found[ok]], self.unknown_score)
                more = gain > value[todo[ok]]
                ok, gain = ok[more], gain[more]
                who = todo[ok]
                value[who], piece[who, i], back[who, i] = gain, found[ok], size
                if self.bpe:  # the admissible last piece is the only one
                    todo = np.delete(todo, ok)
            best[:, i] = value
        return piece, back

    def words(self, subs: ta.Substrings, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, bounds) of distinct words; the ids of word w are ids[bounds[w]:bounds[w + 1]]."""
        chars = np.append(np.flatnonzero((data & 0xC0) != 0x80), len(data))
        first = np.searchsorted(chars, starts)
        length = np.searchsorted(chars, ends) - first
        rows, steps, tokens, froms, tos = [], [], [], [], []
        for size in np.unique(length):
            same = np.flatnonzero(length == size)
            for lo in range(0, len(same), max(1, 1_000_000 // int(size + 1))):
                some = same[lo : lo + max(1, 1_000_000 // int(size + 1))]
                at = chars[first[some][:, None] + np.arange(size + 1)]
                piece, back = self.search(subs, at)
                here, who = np.full(len(some), size), np.arange(len(some))
                while len(who):
                    step = back[who, here]
                    rows.append(some[who])
                    steps.append(here.copy())
                    tokens.append(piece[who, here])
                    froms.append(at[who, here - step])
                    tos.append(at[who, here])
                    here = here - step
                    who, here = who[here > 0], here[here > 0]
        if not rows:
            return np.zeros(0, np.int64), np.zeros(len(starts) + 1, np.int64)
        rows, steps, tokens, froms, tos = (np.concatenate(x) for x in (rows, steps, tokens, froms, tos))
        order = np.lexsort((steps, rows))
        rows, tokens, froms, tos = rows[order], tokens[order], froms[order], tos[order]
        by_byte = (tokens == CHAR) & (self.byte_ids >= 0).all()
        count = np.where(by_byte, tos - froms, 1)
        of, step = ta.ragged(count)
        ids = np.where(by_byte[of], self.byte_ids[data[np.minimum(froms[of] + step, len(data) - 1)]], np.where(tokens[of] >= 0, tokens[of], self.unknown))
        return ids, np.searchsorted(rows[of], np.arange(len(starts) + 1))

    def run(self, spaces: int) -> list[int]:
        """Ids of a run of spaces."""
        if spaces not in self.runs:
            rank, top = self.space_rank, max((len(p) for p in self.ids if not p.strip(" ")), default=1)
            if self.bpe and all(" " * k in rank for k in range(1, top + 1)) and len({rank[" " * k] for k in range(2, top + 1)}) <= 1:
                parts = [" " * top] * (spaces // top) + ([" " * (spaces % top)] if spaces % top else [])  # equal ranks merge from the left
            else:
                parts = merged(" " * spaces, rank)[0]
            self.runs[spaces] = [self.ids.get(p, self.unknown) for p in parts]
        return self.runs[spaces]

    def encode(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, bounds) of documents whose texts each begin with the added space; empty ones have no byte."""
        n = len(data)
        if not n:
            return np.zeros(0, np.int64), np.zeros(len(offs), np.int64)
        space = data == 32
        first = np.zeros(n + 1, dtype=bool)
        first[offs] = True
        # a word begins at the last space of each run of spaces
        next_same = np.append(space[1:] & ~first[1:-1], False)
        run_ends = np.flatnonzero(space & ~next_same)
        run_starts = np.flatnonzero(space & ~np.append(False, space[:-1] & ~first[1:-1]))
        apart = np.append(False, ~self.joined[data[:-1], data[1:]] & ~space[1:])
        starts = np.sort(np.concatenate((run_ends, np.flatnonzero(apart))))
        after = np.searchsorted(run_starts, starts, side="right")  # a word ends at the next one or at the next run of spaces
        ends = np.minimum(np.append(starts[1:], n), np.append(run_starts, n)[after])
        extra = np.zeros(len(starts), dtype=np.int64)
        extra[np.searchsorted(starts, run_ends)] = run_ends - run_starts
        subs = ta.Substrings(data)
        h, one, inverse = np.unique(subs.hashes(starts, ends), return_index=True, return_inverse=True)
        word_at, word_size = self.distinct_words(data, starts[one], ends[one], h)
        ids, word_at, count = self.known_ids, word_at[inverse], word_size[inverse]
        lone = ids[word_at] == self.ids.get(" ", NONE)
        drop = ((extra > 0) & lone).astype(np.int64)
        lead = np.zeros(len(starts), dtype=np.int64)
        several = np.flatnonzero(extra)
        prefix = [self.run(int(extra[w] + drop[w])) for w in several]
        lead[several] = [len(p) for p in prefix]
        total = lead + count - drop
        at = np.concatenate(([0], np.cumsum(total)))
        out = np.zeros(at[-1], dtype=np.int64)
        row, step = ta.ragged(count - drop)
        out[at[row] + lead[row] + step] = ids[word_at[row] + drop[row] + step]
        if len(several):
            row, step = ta.ragged(lead)
            out[at[row] + step] = np.concatenate(prefix)
        return out, at[np.searchsorted(starts, offs)]

    def decode(self, ids: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(bytes, offsets) of the documents' texts, without the added space."""
        size = self.size[ids]
        row, step = ta.ragged(size)
        raw = self.bytes[self.bounds[ids[row]] + step]
        offs = np.concatenate(([0], np.cumsum(size)))[bounds]
        some = np.flatnonzero(np.diff(offs) > 0)
        cut = some[raw[offs[some]] == 32]
        keep = np.ones(len(raw), dtype=bool)
        keep[offs[cut]] = False
        less = np.zeros(len(offs), dtype=np.int64)
        less[cut + 1] = 1
        return raw[keep], offs - np.cumsum(less)


def prepared(text: Column) -> Column:
    """The text as pieces see it: U+2581 is a space, and a space is added in front of any character."""
    return F.when(F.length(text) > 0, F.concat(F.lit(" "), F.translate(text, MARK, " "))).otherwise(text)


def encode(docs: DataFrame, path: str = MODEL, columns: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``columns``, ids (array<int>) and exact (decoding gives the text back) of every document."""
    ta.bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(Codec(path))  # of the size of the vocabulary
    rows = docs.select(*columns, prepared(F.col("text")).alias("_prepared"), (~F.coalesce(F.col("text").contains(MARK), F.lit(False))).alias("_plain"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = shared.value
        for batch in batches:
            for part in ta.row_slices(batch, "_prepared", SLICE):
                column = part.column("_prepared")
                data, offs = ta.text_buffers(column)
                ids, bounds = codec.encode(data, offs)
                raw, back = codec.decode(ids, bounds)
                lead = (np.diff(offs) > 0).astype(np.int64)
                want = np.ones(len(data), dtype=bool)
                want[offs[:-1][lead > 0]] = False
                plain = offs - np.concatenate(([0], np.cumsum(lead)))
                text = data[want]
                if np.array_equal(raw, text) and np.array_equal(back, plain):
                    same = np.ones(part.num_rows, dtype=bool)
                else:
                    same = np.array([np.array_equal(raw[back[i] : back[i + 1]], text[plain[i] : plain[i + 1]]) for i in range(part.num_rows)], dtype=bool)
                null = pc.is_null(column)
                lists = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(ids.astype(np.int32)), mask=null)
                exact = pc.and_(pc.and_(pa.array(same), part.column("_plain")), pc.invert(null))
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in columns), lists, exact], names=[*columns, "ids", "exact"])

    schema = rows.select(*columns).schema.add("ids", ArrayType(IntegerType())).add("exact", "boolean")
    return rows.mapInArrow(run, schema)


def decode(coded: DataFrame, path: str = MODEL, columns: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``columns`` and text of every row of ids; bytes that are no UTF-8 become U+FFFD, null ids null."""
    ta.bounded_batches(coded.sparkSession)
    shared = coded.sparkSession.sparkContext.broadcast(Codec(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("ids")
            counts = lists.value_lengths().fill_null(0).to_numpy()
            raw, offs = shared.value.decode(lists.flatten().to_numpy().astype(np.int64), np.concatenate(([0], np.cumsum(counts))))
            there, text = lists.is_valid().to_pylist(), raw.tobytes()
            out = [text[offs[i] : offs[i + 1]].decode("utf-8", "replace") if t else None for i, t in enumerate(there)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), pa.array(out, pa.string())], names=[*columns, "text"])

    return coded.select(*columns, "ids").mapInArrow(run, coded.select(*columns).schema.add("text", "string"))
