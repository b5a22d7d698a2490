"""Plain Python versions of the operators' results, and rows with every awkward case."""

from __future__ import annotations

import collections
import hashlib
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")

MESSY = [
    (1, "", "en", "s"),
    (2, None, "en", "s"),
    (3, "12 34 !!", None, None),
    (4, "the of and to in is that it was for " * 4, "en", "s"),
    (4, "the of and to in is that it was for " * 4, "en", "s"),
    (None, "the of and to in is that it was for " * 4, "en", "s"),
    (5, "der die das und ist nicht ein eine mit für " * 3000, "de", None),
    (6, "der die das und ist nicht ein eine mit für " * 3, None, "s"),
    (7, "\n\n  \t\r\n", "de", "s"),
    (8, "word", "en", "s"),
    (9, "a▁b \x1c\u00a0 ÀÉ 中文 😀 \u2028", "fr", "s"),
    (4, "another text under the same id, with other words in it", "en", "s"),
]


def messy(spark):
    """Documents with null, empty, long, tied and repeated rows, and columns whose names the operators use inside."""
    rows = [(*row, 1, "x", 2.0, "y", "z", 3) for row in MESSY]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars int, tag string, score double, node string, bands string, bucket int")


def empty(df):
    return df.limit(0)


def shingles(text: str | None) -> frozenset:
    w = WORD.findall(text or "")
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def classes(docs: list[tuple], threshold: float = 0.8) -> dict:
    """doc_id -> smallest id of its class, by all pairs of sets of shingles."""
    sets = [(d, shingles(t)) for d, t in docs if d is not None]
    parent = {d: d for d, _ in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, (a, x) in enumerate(sets):
        for b, y in sets[:i]:
            if x and y and len(x & y) >= threshold * len(x | y):
                low, high = sorted((find(a), find(b)))
                parent[high] = low
    return {d: find(d) for d in parent}


def removed(docs: list[tuple], length: int = 50) -> list[tuple]:
    """(bytes, marks of removed bytes) of each row."""
    first: dict = {}
    for d, t in docs:
        b = (t or "").encode()
        for i in range(len(b) - length + 1) if d is not None else ():
            first[b[i : i + length]] = min(first.get(b[i : i + length], d), d)
    out = []
    for d, t in docs:
        b = (t or "").encode()
        marks = bytearray(len(b))
        for i in range(len(b) - length + 1) if d is not None else ():
            if first[b[i : i + length]] < d:
                marks[i : i + length] = b"\1" * length
        out.append((b, bytes(marks)))
    return out


def cut_rows(docs: list[tuple], length: int = 50) -> list[tuple]:
    out = []
    for (d, _), (b, marks) in zip(docs, removed(docs, length), strict=True):
        kept = bytes(c for c, m in zip(b, marks, strict=True) if not m)
        out.append((d, len(b), sum(marks), len(re.findall(b"\1+", marks)), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def stats(text: str | None) -> dict:
    text = text or ""
    words = WORD.findall(text)
    lines, seen, dup = [x for x in text.split("\n") if WORD.search(x)], set(), 0
    for line in lines:
        dup += line in seen
        seen.add(line)
    windows = collections.Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    covered = {j for i in range(len(words) - 4) if windows[tuple(words[i : i + 5])] > 1 for j in range(i, i + 5)}
    return {"n_words": len(words), "word_chars": sum(map(len, words)), "n_symbols": sum(c in "#*$%&|<>" for c in text), "n_dup_lines": dup, "n_repeat_words": len(covered)}


def local_score(a: list, b: list) -> int:
    """Smith-Waterman with match 2, mismatch -1, gap -1."""
    best, before = 0, [0] * (len(b) + 1)
    for x in a:
        row = [0]
        for j, y in enumerate(b):
            row.append(max(0, before[j] + (2 if x == y else -1), before[j + 1] - 1, row[j] - 1))
        best, before = max(best, *row), row
    return best
