"""SentencePiece encoding and decoding (op6)."""

import random
import struct

import numpy as np
import pyarrow as pa
import pytest
import sentencepiece
from plain import empty, messy

from ragtables.llm import piece_codec
from ragtables.llm import textarrays as ta
from ragtables.llm.queries import op6_piece_codec


def run(codec, texts):
    ids, bounds = codec.encode(*ta.text_buffers(pa.array([" " + t if t else t for t in texts])))
    raw, offs = codec.decode(ids, bounds)
    return [ids[a:b].tolist() for a, b in zip(bounds, bounds[1:])], [raw[a:b].tobytes().decode() for a, b in zip(offs, offs[1:])]


def test_ids_are_those_of_the_library():
    rng = random.Random(1)
    letters = list("aabcdeehilnorst  -_=*#.,1230\n\téüß中ﬁ①😀\"'()")
    texts = ["", " ", "  ", " a", "a ", "x" + " " * 40 + "y", " " * 33, "-" * 37, "aaaaaaaaaaaaaaaa", "don't it's"]
    texts += ["".join(rng.choices(letters, k=rng.randint(0, 60))) for _ in range(3000)]
    texts += ["".join(rng.choices("ab-= ", k=rng.randint(0, 40))) for _ in range(1000)]
    ids, back = run(piece_codec.Codec(), texts)
    assert ids == sentencepiece.SentencePieceProcessor(model_file=piece_codec.MODEL).encode(texts)
    assert back == texts


def test_query_matches_the_library_on_documents(spark):
    sf = "/root/testdata/sf0.001"
    library = sentencepiece.SentencePieceProcessor(model_file=piece_codec.MODEL)
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    coded = op6_piece_codec(spark, sf)
    for r in coded.collect():
        assert r["ids"] == library.encode(texts[r["doc_id"]]) and r["exact"] and r["n_tokens"] == len(r["ids"])
    assert {r["doc_id"]: r["text"] for r in piece_codec.decode(coded).collect()} == texts


def test_messy_and_empty_tables(spark):
    docs = messy(spark)
    coded = piece_codec.encode(docs, columns=("doc_id", "text"))
    library = sentencepiece.SentencePieceProcessor(model_file=piece_codec.MODEL)
    for r in coded.collect():
        assert r["ids"] == (None if r["text"] is None else library.encode(r["text"]))
        assert r["exact"] == (r["text"] is not None and "▁" not in r["text"])
    assert sorted(map(str, (r["text"] for r in piece_codec.decode(coded).collect()))) == sorted(str(r["text"] and r["text"].replace("▁", " ")) for r in docs.collect())
    assert piece_codec.encode(empty(docs)).collect() == []


def field(number, value):
    if isinstance(value, int):
        return bytes([number << 3, value])
    return (bytes([number << 3 | 5]) + struct.pack("<f", value)) if isinstance(value, float) else bytes([number << 3 | 2, len(value)]) + value


@pytest.fixture
def unigram(tmp_path):
    """A unigram model of single letters and random longer pieces."""
    rng = random.Random(4)
    pieces = {"<unk>": (0.0, 2), "▁": (-2.0, 1)} | {c: (-3.0 - i / 10, 1) for i, c in enumerate("abcd")}
    for _ in range(40):
        pieces.setdefault(rng.choice(("", "▁")) + "".join(rng.choices("abcd", k=rng.randint(2, 4))), (round(-rng.uniform(2, 9), 3), 1))
    body = b"".join(field(1, field(1, p.encode()) + field(2, s) + field(3, k)) for p, (s, k) in pieces.items())
    path = tmp_path / "unigram.model"
    path.write_bytes(body + field(2, field(3, 1)) + field(3, field(3, 1) + field(4, 0) + field(5, 1)))
    return str(path), {p.replace("▁", " "): s for p, (s, k) in pieces.items() if k == 1}


def test_unigram_search_finds_the_best_sum(unigram):
    path, scores = unigram
    codec, rng = piece_codec.Codec(path), random.Random(5)
    texts = ["".join(rng.choices("abcdx ", k=rng.randint(1, 14))).strip() for _ in range(400)]
    names = list(scores)
    low = min(scores.values()) - 10

    def best(text):
        top = [0.0] + [float("-inf")] * len(text)
        for i in range(1, len(text) + 1):
            for j in range(i):
                s = scores.get(text[j:i], low if i - j == 1 else float("-inf"))
                top[i] = max(top[i], top[j] + s)
        return top[-1]

    ids, _ = run(codec, texts)
    for t, own in zip(texts, ids, strict=True):
        total = sum(codec.score[i] if i else low for i in own)
        assert total == pytest.approx(best(" " + t) if t else 0, abs=1e-3), t
    assert names


def test_pairs_are_remembered(monkeypatch):
    """A pair of pieces is settled once, and pairs that share a slot keep their own answers."""
    codec, rng = piece_codec.Codec(), np.random.default_rng(3)
    a, b = rng.integers(300, 3000, 4000), rng.integers(300, 3000, 4000)
    want = codec.never_merged(a * len(codec.rank) + b)
    asked, plain = [], codec.never_merged
    monkeypatch.setattr(codec, "never_merged", lambda pairs: asked.append(len(pairs)) or plain(pairs))
    assert (codec.adjacent(a, b) == want).all() and (codec.adjacent(a, b) == want).all()
    assert sum(asked) < 4100
    monkeypatch.setattr(piece_codec, "PAIR_SLOTS", 5)
    codec.forget()
    for at in (slice(None), slice(0, 50), slice(40, 90)):
        assert (codec.adjacent(a[at], b[at]) == want[at]).all()
