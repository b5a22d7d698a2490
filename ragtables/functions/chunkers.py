"""Chunking expressions: text Column -> array<string> Column.

Every chunker is a native expression (``split``, ``transform``, ``aggregate``), evaluated per row,
so chunking is a narrow map over the document partitions: no shuffle, no Python worker.
Sizes and overlaps may be Python ints or Columns (profiles carry them as columns).
"""

from __future__ import annotations

from typing import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .text import col_, let, split_literal, strip, stripped_nonblank

# Recursive separators in priority order ("" = cut by size).
RECURSIVE_SEPARATORS = ["\n\n", "\n", "。", "！", "？", ".", "!", "?", "；", ";", " ", ""]

# Sentence ends (cut after each of them).
SENTENCE_END_CHARS = "。！？!?；;\n"

# A cut before every line that starts a heading (markdown marks, record titles, chapters, numbered and
# listed items). (?d): only \n ends a line; (?m): ^ at line starts; the long classes are Python's white space.
STRUCTURE_SPLIT_REGEX = (
    r"(?dm)(?=^#{1,6}[\t\n\x0b\x0c\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+|^记录 \p{Nd}+"
    r"|^第[0-9一二三四五六七八九十百千]+[章节部分条]|^\p{Nd}+\.[\t\n\x0b\x0c\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+|^[一二三四五六七八九十]+、)"
)


def _empty() -> Column:
    return F.array().cast(T.ArrayType(T.StringType()))


def _c(v) -> Column:
    return v if isinstance(v, Column) else F.lit(v)


def windows(p: Column, size, overlap) -> Column:
    """Cut an oversize paragraph in windows of ``size``; next start = end - overlap; pieces stripped."""
    size, overlap = _c(size), _c(overlap)
    step = size - overlap
    n = F.length(p)
    last = F.greatest(F.lit(0), F.ceil((n - size) / step).cast("int"))
    pieces = F.transform(F.sequence(F.lit(0), last), lambda i: strip(F.substring(p, i * step + 1, size)))
    return F.filter(pieces, lambda s: F.length(s) > 0)


def group_starts(lengths: Column, gap, size) -> Column:
    """First index of each group when items of these lengths are packed greedily, ``gap`` characters between two."""
    size = _c(size)
    init = F.struct(F.array().cast("array<int>").alias("starts"), F.lit(-1).alias("cur"), F.lit(0).alias("i"))

    def step(acc, n):
        longer = acc["cur"] + _c(gap) + n
        return F.when(
            (acc["cur"] >= 0) & (longer <= size),
            F.struct(acc["starts"].alias("starts"), longer.alias("cur"), (acc["i"] + 1).alias("i")),
        ).otherwise(F.struct(F.concat(acc["starts"], F.array(acc["i"])).alias("starts"), n.alias("cur"), (acc["i"] + 1).alias("i")))

    return F.aggregate(lengths, init, step, lambda acc: acc["starts"])


def joined_groups(items: Column, starts: Column, sep: Column | str) -> Column:
    """The items from each start up to the next, joined by ``sep``."""
    sep = _c(sep)
    return let(
        F.struct(items.alias("x"), starts.alias("s")),
        lambda v: F.transform(
            v["s"], lambda s, j: F.call_function("array_join", F.slice(v["x"], s + 1, F.coalesce(F.get(v["s"], j + 1), F.size(v["x"])) - s), sep)
        ),
    )


def pack(segments: Column, sep: Column | str, size) -> Column:
    """Greedy packing: strip segments, drop blanks, join with ``sep`` while the result fits ``size``.

    The fold runs over lengths only; the strings are sliced and joined once at the end.
    """
    return let(
        stripped_nonblank(segments),
        lambda segs: joined_groups(segs, group_starts(F.transform(segs, F.length), F.length(_c(sep)), size), sep),
    )


def fixed_chunks(text: Column | str, size, overlap) -> Column:
    """Paragraphs (split on a blank line) packed greedily; an oversize paragraph is cut in windows.

    An oversize paragraph can share no group (its length alone is over ``size``), so packing all
    paragraphs first and cutting the groups that are too long is the same.
    """
    return let(
        pack(split_literal(text, "\n\n"), "\n\n", size),
        lambda gs: F.when(
            F.exists(gs, lambda g: F.length(g) > _c(size)),
            F.flatten(F.transform(gs, lambda g: F.when(F.length(g) <= _c(size), F.array(g)).otherwise(windows(g, size, overlap)))),
        ).otherwise(gs),
    )


def apply_overlap(chunks: Column, overlap) -> Column:
    """Chunk i >= 1 gets the last ``overlap`` characters of the original chunk i-1 in front."""
    overlap = _c(overlap)

    def body(cs):
        def one(c, i):
            prev = F.element_at(cs, i)  # 1-based: element i is chunk i-1
            return F.when((i == 0) | (overlap <= 0), c).otherwise(F.concat(F.right(prev, overlap), c))

        return F.transform(cs, one)

    return let(chunks, body)


def _level(sep: Column, size: Column):
    """Split the pieces that are too long at ``sep`` and pack them; a piece without ``sep`` stays as it is."""
    quoted = F.concat(F.lit("\\Q"), sep, F.lit("\\E"))
    split = lambda p: F.when((F.length(p) > size) & F.contains(p, sep), pack(F.split(p, quoted, -1), sep, size)).otherwise(F.array(p))
    return _where_too_long(size, split)


def _where_too_long(size: Column, cut) -> Callable[[Column], Column]:
    """Pieces -> pieces: ``cut`` each one, but only in lists with a piece over ``size``."""
    return lambda ps: F.when(F.exists(ps, lambda p: F.length(p) > size), F.flatten(F.transform(ps, cut))).otherwise(ps)


def recursive_stages(size, overlap) -> list[Callable[[Column], Column]]:
    """C4 as stages over a state ``array<array<string>>`` (one inner array per section).

    A piece that fits is kept; an oversize piece is split on the next separator, segments are
    stripped and packed. A level whose separator is absent is a no-op, so one pass over the separators
    equals the recursion: a fold over their array, whose expression is built and analysed once for all of
    them. Pieces still oversize after the last separator have no separator left and are cut in windows (C2
    on one paragraph). The last stage applies C3 per section and flattens.

    Stages are applied one ``withColumn`` at a time, so that each is analysed on its own.
    """
    size, overlap = _c(size), _c(overlap)
    separators = F.array(*[F.lit(sep) for sep in RECURSIVE_SEPARATORS[:-1]])
    stages: list[Callable[[Column], Column]] = [lambda st: F.aggregate(separators, st, lambda now, sep: F.transform(now, _level(sep, size)))]
    last = _where_too_long(size, lambda p: F.when(F.length(p) <= size, F.array(p)).otherwise(windows(p, size, overlap)))
    stages.append(lambda st: F.transform(st, last))
    stages.append(lambda st: F.flatten(F.transform(st, lambda ps: apply_overlap(ps, overlap))))
    return stages


def recursive_init(text: Column | str) -> Column:
    """Initial C4 state: one section holding the stripped text (none when blank)."""
    t = strip(col_(text))
    return F.when(F.length(t) > 0, F.array(F.array(t))).otherwise(F.array().cast("array<array<string>>"))


def structure_init(text: Column | str, size) -> Column:
    """Initial C8 state: one inner array per section (sections that fit pass the stages unchanged)."""
    return F.transform(sections(text), lambda sct: F.array(sct))


def sentences(text: Column | str) -> Column:
    """Cut after each sentence end (not after '.'), strip, drop blanks."""
    return stripped_nonblank(F.split(col_(text), f"(?<=[{SENTENCE_END_CHARS}])", -1))


def semantic_stages(size, overlap, threshold, similarity: Callable[[Column], Column], split: Callable[[Column], Column] = sentences) -> list[Callable[[Column], Column]]:
    """C6 as stages over the stripped text: sentences, similarity of each to the sentence before it, the
    left-to-right packing, then C2 on groups that ended up oversize.

    ``similarity`` maps an array of sentences to the array of similarities to the previous one (0 for the first). ``split``
    makes the sentences of the column that the stages begin with.
    """
    size, overlap, threshold = _c(size), _c(overlap), _c(threshold)

    def with_sims(t: Column) -> Column:
        return let(split(t), lambda ss: F.struct(ss.alias("s"), F.transform(ss, F.length).alias("n")))

    def fold(v: Column) -> Column:
        init = F.struct(F.array().cast("array<int>").alias("starts"), F.lit(-1).alias("cur"), F.lit(0).alias("i"))

        def step(acc, it):
            longer = acc["cur"] + it["n"]
            return F.when(
                (acc["cur"] >= 0) & (it["sim"] >= threshold) & (longer <= size),
                F.struct(acc["starts"].alias("starts"), longer.alias("cur"), (acc["i"] + 1).alias("i")),
            ).otherwise(F.struct(F.concat(acc["starts"], F.array(acc["i"])).alias("starts"), it["n"].alias("cur"), (acc["i"] + 1).alias("i")))

        items = F.zip_with(v["n"], v["sims"], lambda n, sim: F.struct(n.alias("n"), sim.alias("sim")))
        return stripped_nonblank(joined_groups(v["s"], F.aggregate(items, init, step, lambda acc: acc["starts"]), ""))

    def split_oversize(groups: Column) -> Column:
        return F.flatten(
            F.transform(groups, lambda g: F.when(F.length(g) <= size, F.array(g)).otherwise(fixed_chunks(g, size, overlap)))
        )

    # the similarities come from a batched Python function, which cannot stand inside a lambda
    add_sims = lambda v: v.withField("sims", similarity(v["s"]))
    return [with_sims, add_sims, fold, split_oversize]


def sections(text: Column | str) -> Column:
    """Cut before heading lines; with no cut but at 0, paragraphs if more than one, else the text."""

    def body(v):
        parts, paragraphs, t = v["parts"], v["paras"], v["t"]
        whole = F.when(F.length(t) > 0, F.array(t)).otherwise(_empty())
        fallback = F.when(F.size(paragraphs) > 1, paragraphs).otherwise(whole)
        return F.when(F.size(parts) > 1, stripped_nonblank(parts)).otherwise(fallback)

    t = col_(text)
    return let(
        F.struct(
            F.split(t, STRUCTURE_SPLIT_REGEX, -1).alias("parts"),
            stripped_nonblank(split_literal(t, "\n\n")).alias("paras"),
            strip(t).alias("t"),
        ),
        body,
    )


def add_chunks(df, text_col: str, out_col: str, strategy: str, size, overlap, threshold=0.75, make_model=None, batch_size: int = 32):
    """Add ``out_col`` = the chunk array of ``text_col`` (already normalised and stripped).

    ``make_model`` (C6 only) is that of E1: called once per worker, it returns ``predict(texts) -> (n, dim)``;
    without one the E2 hash model is used.
    """
    t = F.col(text_col)
    if strategy == "fixed":
        return df.withColumn(out_col, fixed_chunks(t, size, overlap))
    if strategy == "recursive":
        df, stages = df.withColumn(out_col, recursive_init(t)), recursive_stages(size, overlap)
    elif strategy == "structure":
        df, stages = df.withColumn(out_col, structure_init(t, size)), recursive_stages(size, overlap)
    elif strategy == "semantic":
        from ..operators.embedding import hash_vectors, previous_similarity

        similarity = previous_similarity(make_model or hash_vectors, batch_size)
        df, stages = df.withColumn(out_col, t), semantic_stages(size, overlap, threshold, similarity)
    else:
        raise ValueError(f"unknown chunk strategy {strategy!r}")
    for st in stages:
        df = df.withColumn(out_col, st(F.col(out_col)))
    return df
