"""Benchmark decontamination (op5)."""

import random

import numpy as np
from plain import empty, local_score, messy

from ragtables.llm import decontaminate
from ragtables.llm.queries import op5_decontaminate

SF = "/root/testdata/sf0.01"


def test_alignment_matches_plain_smith_waterman():
    rng = np.random.default_rng(0)
    a, b = rng.integers(2, 7, (80, 15)).astype(np.uint64), rng.integers(2, 7, (80, 30)).astype(np.uint64)
    a_len, b_len = rng.integers(1, 16, 80), rng.integers(1, 31, 80)
    for i in range(80):
        a[i, a_len[i] :], b[i, b_len[i] :] = 0, 1
    score, start, end = decontaminate.align(a, a_len, b, b_len)
    for i in range(80):
        x, y = a[i, : a_len[i]].tolist(), b[i, : b_len[i]].tolist()
        assert score[i] == local_score(x, y) == local_score(x, y[start[i] : end[i]])


def test_finds_every_exact_passage(spark):
    docs, items = (spark.read.parquet(f"{SF}/{t}.parquet").collect() for t in ("documents", "benchmark"))
    want = {(d["doc_id"], i["item_id"]) for d in docs for i in items if i["text"] in d["text"]}
    rows = op5_decontaminate(spark, SF).collect()
    got = {(r["doc_id"], r["item_id"]) for r in rows}
    assert want and want <= got and all(r["score"] >= 0.5 for r in rows)
    assert len(got - want) < 0.2 * len(want)


def test_finds_edited_copies_and_leaves_others(spark):
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(400)]
    items = [(i, " ".join(rng.choices(vocabulary, k=30))) for i in range(20)]

    def edited(text):
        out = []
        for w in text.split():
            x = rng.random()
            out += [] if x < 0.05 else [w, "extra"] if x < 0.1 else [rng.choice(vocabulary)] if x < 0.17 else [w.upper() + ","]
        return " ".join(out)

    docs = [(100 + i, " ".join(rng.choices(vocabulary, k=80)) + " " + edited(t) + "\n" + " ".join(rng.choices(vocabulary, k=50))) for i, t in items]
    docs += [(1000 + i, " ".join(rng.choices(vocabulary, k=200))) for i in range(60)]
    rows = decontaminate.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r["doc_id"], r["item_id"]) for r in rows} == {(100 + i, i) for i, _ in items}


def test_a_passage_in_all_documents_is_found_in_all(spark):
    passage = " ".join(f"rare{i}" for i in range(25))
    docs = spark.createDataFrame([(i, f"start {i} " + passage + f" end {i}") for i in range(300)], "doc_id long, text string")
    rows = decontaminate.contaminated(docs, spark.createDataFrame([(1, passage)], "item_id long, text string")).collect()
    assert sorted(r["doc_id"] for r in rows) == list(range(300)) and {r["score"] for r in rows} == {1.0}


def test_messy_and_empty_tables(spark):
    docs = messy(spark)
    items = spark.createDataFrame([(1, "die das und ist nicht ein eine mit", "x"), (2, None, "x"), (3, "", "x"), (None, "of and to in is that", "x"), (5, "word", "x"), (1, "die das und ist nicht ein eine mit", "x")], "item_id long, text string, h string")
    rows = decontaminate.contaminated(docs, items).collect()
    assert {(r["doc_id"], r["item_id"]) for r in rows} == {(5, 1), (6, 1)} and {r["score"] for r in rows} == {1.0}
    assert decontaminate.contaminated(empty(docs), items).collect() == []
    assert decontaminate.contaminated(docs, empty(items)).collect() == []


def test_no_pair_of_the_threshold_is_missed(spark):
    rng = random.Random(11)
    vocabulary = [f"w{i}" for i in range(300)]
    items = [(i, " ".join(rng.choices(vocabulary, k=rng.choice([3, 4, 5, 6, 7, 9, 15, 24, 40])))) for i in range(60)]

    def edited(words, every, kind):
        out = []
        for n, w in enumerate(words, 1):
            out += [w] if n % every else [f"x{n}"] if kind == 0 else [] if kind == 1 else [w, f"x{n}"]
        return out

    docs = []
    for i, t in items:
        for every in (1, 2, 3, 4, 5, 6, 8):
            for kind in range(3):
                long = rng.choice([5, 60, 200])
                docs.append((len(docs), " ".join(rng.choices(vocabulary, k=long) + edited(t.split(), every, kind) + rng.choices(vocabulary, k=40))))
    docs += [(len(docs) + i, t) for i, t in items]  # an exact copy of each is in the corpus too
    rows = decontaminate.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    got = {(r["doc_id"], r["item_id"]): r["score"] for r in rows}
    sets = [(d, t.split(), set(t.split())) for d, t in docs]
    want = {}
    for i, t in items:
        a = t.split()
        for d, b, words in sets:
            if 2 * sum(w in words for w in a) >= len(a):
                score = local_score(a, b) / (2 * len(a))
                if score >= 0.5:
                    want[d, i] = score
    assert len(want) > 500 and got == want


def test_a_repetitive_item_is_found(spark):
    item = "la la la la la la la la la la la la"
    docs = [(1, "oh la la la x la la la y la la la z la la la oh"), (2, "la oh la oh"), (3, "a " * 500 + item)]
    rows = decontaminate.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(1, item)], "item_id long, text string")).collect()
    assert {r["doc_id"]: r["score"] for r in rows} == {1: local_score(item.split(), docs[0][1].split()) / 24, 3: 1.0}
