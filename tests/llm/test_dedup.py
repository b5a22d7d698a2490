"""Suffix-array dedup (op7) and near duplicates (op9)."""

import random

import numpy as np
import pytest
from plain import MESSY, classes, cut_rows, empty, messy, removed

from ragtables.llm import near_dup, suffix_dedup
from ragtables.llm.queries import op7_suffix_dedup, op9_near_dup

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def spliced():
    """Rows made of shared stretches, periodic runs, equal ids and null ids."""
    rng = random.Random(5)
    base = ["".join(rng.choices("ab cdé", k=400)) for _ in range(5)]
    rows = []
    for i in range(90):
        text = ""
        for _ in range(rng.randint(0, 5)):
            part, at = rng.choice(base), rng.randint(0, 350)
            text += part[at : at + rng.randint(10, 200)] + rng.choice(["", "", "x" * 60, "ab" * 40])
        rows.append((i if rng.random() < 0.9 else rng.randint(0, 50), text))
    return rows + [(None, base[0]), (500, None), (501, ""), (502, "a" * 200), (503, "a" * 200), (7, rows[7][1])]


def test_removed_bytes_match_brute_force(spark, spliced):
    docs = spark.createDataFrame(spliced, "doc_id long, text string").repartition(5)
    assert sorted(map(tuple, suffix_dedup.suffix_dedup(docs).collect()), key=str) == cut_rows(spliced)


def test_many_buckets_and_flushes_change_nothing(spark, spliced, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "BUCKET_BYTES", 2000)
    docs = spark.createDataFrame(spliced, "doc_id long, text string").repartition(3)
    assert sorted(map(tuple, suffix_dedup.suffix_dedup(docs).collect()), key=str) == cut_rows(spliced)
    short = sorted(map(tuple, suffix_dedup.suffix_dedup(docs, 20, 8).collect()), key=str)
    assert short == cut_rows(spliced, 20)


def test_query_matches_brute_force(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    assert sorted(map(tuple, op7_suffix_dedup(spark, SF).collect()), key=str) == cut_rows(docs)


def test_cut_of_messy_and_empty_tables(spark):
    docs = messy(spark)
    short = [(d, t if t is None or len(t) < 1000 else t[:500]) for d, t, *_ in MESSY]
    assert sorted(map(tuple, suffix_dedup.suffix_dedup(spark.createDataFrame(short, "doc_id long, text string")).collect()), key=str) == cut_rows(short)
    cut = suffix_dedup.cut_documents(docs, ["doc_id", "text", "lang", "source"])
    assert cut.columns == ["doc_id", "text", "lang", "source"] and cut.count() == docs.count()
    assert cut.filter("doc_id = 2").first()["text"] is None
    assert suffix_dedup.cut_documents(empty(docs), ["doc_id", "text"]).collect() == []


def test_cut_texts_are_what_is_left(spark, spliced):
    docs = spark.createDataFrame(spliced, "doc_id long, text string")
    want = sorted(((d, None if t is None else bytes(c for c, m in zip(b, marks, strict=True) if not m).decode("utf-8", "ignore")) for (d, t), (b, marks) in zip(spliced, removed(spliced), strict=True)), key=str)
    assert sorted(map(tuple, suffix_dedup.cut_documents(docs, ["doc_id", "text"]).collect()), key=str) == want


def test_classes_match_brute_force(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    assert {r["doc_id"]: r["class_id"] for r in op9_near_dup(spark, SF).collect()} == classes(docs)


def test_large_groups_lose_no_link(spark, monkeypatch):
    monkeypatch.setattr(near_dup, "BLOCK_TEXTS", 12)
    rng = random.Random(2)
    words = [f"w{i}" for i in range(300)]
    base, rows = rng.choices(words, k=60), []
    for i in range(150):
        text = list(base)
        for _ in range(rng.randint(0, 4)):  # similarities around the threshold
            text[rng.randrange(60)] = rng.choice(words)
        rows.append((i, " ".join(text)))
    rows += [(200 + i, rows[i][1]) for i in range(30)] + [(300 + i, " ".join(rng.choices(words, k=40))) for i in range(20)]
    got = near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), rounds=1).collect()
    assert {r["doc_id"]: r["class_id"] for r in got} == classes(rows)


def test_classes_of_messy_and_empty_tables(spark):
    docs = messy(spark)
    rows = near_dup.near_duplicates(docs).collect()
    want = {d: d for d, *_ in MESSY} | {6: 5}
    # 5 repeats what 6 says once: equal sets of shingles
    assert {r["doc_id"]: r["class_id"] for r in rows} == want | {6: want[6]} and len(rows) == len(MESSY)
    assert near_dup.near_duplicates(empty(docs)).collect() == []


def test_registers_estimate_probability_jaccard():
    rng = np.random.default_rng(1)
    h = rng.integers(0, 2**64, 300, dtype=np.uint64)
    wa, wb = rng.integers(1, 6, 300).astype(float), rng.integers(1, 6, 300).astype(float)
    wa[:60] = 0
    wb[240:] = 0
    got = []
    for salt in range(20):
        x = h ^ np.uint64(salt * 7919)
        a = near_dup.prob_minhash(np.zeros((wa > 0).sum(), dtype=np.int64), x[wa > 0], wa[wa > 0], 1)[0]
        b = near_dup.prob_minhash(np.zeros((wb > 0).sum(), dtype=np.int64), x[wb > 0], wb[wb > 0], 1)[0]
        got.append((a == b).mean())
    both = (wa > 0) & (wb > 0)
    want = sum(1 / np.maximum(wa / wa[i], wb / wb[i]).sum() for i in np.flatnonzero(both))
    assert abs(np.mean(got) - want) < 0.03


def test_rows_of_a_task_are_held_once_when_they_are_sent():
    import numpy as np

    from ragtables.llm.suffix_dedup import Collected, Stage

    held, n = Collected(Stage(4, 32, 50)), 1000
    for i in range(3):
        at = np.arange(n)
        assert not list(held.add(at.astype(np.uint64) << np.uint64(32), at.astype(np.uint64), at + i, at.astype(np.int32), at.astype(np.int32)))
    sent = held.flush()
    next(sent)
    assert not held.parts  # before: the collected rows stayed beside their sorted copies
    assert list(sent)
