"""Phrase mining (op13) against plain counting of all phrases."""

import collections
import random
import re

import pytest
from plain import empty, messy

from ragtables.llm import phrase_mining as pm

SF = "/root/testdata/sf0.001"
UPPER = {i: i + 32 for i in range(65, 91)}


def brute(docs, limit=2000, least=30):
    f = collections.defaultdict(collections.Counter)
    for text, lang in docs:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(UPPER)):
            w = re.findall(r"[^\x20\x09]+", piece)
            for n in range(1, 5):
                f["und" if lang is None else lang].update(tuple(w[i : i + n]) for i in range(len(w) - n + 1))
    out = []
    for lang, c in f.items():
        candidates = {p: a for p, a in c.items() if len(p) > 1 and a >= least}
        total, rows = sum(a for p, a in c.items() if len(p) == 1), []
        longest = collections.Counter()
        for p, a in candidates.items():
            for n in range(2, len(p)):
                for i in range(len(p) - n + 1):
                    longest[p[i : i + n]] = max(longest[p[i : i + n]], a)
        for p, a in candidates.items():
            if 100 * longest[p] >= 80 * a:
                continue
            score, _, left, right = min((2000000 * a // (c[p[:k]] + c[p[k:]]), k, c[p[:k]], c[p[k:]]) for k in range(1, len(p)))
            rows.append((-score, -a, " ".join(p).encode(), left, right))
        rows.sort()
        out += [(lang, i + 1, p.decode(), -a, left, right, total, -score) for i, (score, a, p, left, right) in enumerate(rows[:limit])]
    return sorted(out)


def pairs_of(df):
    return [(r["text"], r["lang"]) for r in df.select("text", "lang").collect()]


@pytest.fixture(scope="module")
def invented(spark):
    rng = random.Random(8)
    vocabulary = [f"W{i}" if i % 7 == 0 else f"é{i}" for i in range(25)]
    stock = [" ".join(rng.choices(vocabulary, k=rng.randint(2, 5))) for _ in range(12)]
    rows = []
    for i in range(600):
        parts = [rng.choice(stock) if rng.random() < 0.5 else " ".join(rng.choices(vocabulary, k=rng.randint(1, 6))) for _ in range(rng.randint(0, 6))]
        text = "".join(p + rng.choice([" ", "  ", "\t", ", ", ".", "\n", "!? "]) for p in parts)
        rows.append((i, text, rng.choice(["en", "en", "en", "fr", None, "und"])))
    return spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4)


def test_small_chunks_match_brute_force(spark, invented, monkeypatch):
    monkeypatch.setattr(pm, "CHUNK", 3000)
    assert sorted(map(tuple, pm.collocations(invented).collect())) == brute(pairs_of(invented))


@pytest.mark.parametrize("frontier", [(1, 2, 4, None), (2, None)])
def test_rounds_settle_the_same_result(spark, invented, frontier):
    docs = pairs_of(invented)
    assert sorted(map(tuple, pm.collocations(invented, 10, 5, frontier).collect())) == brute(docs, 10, 5)


def test_full_bit_maps_change_nothing(spark, invented, monkeypatch):
    monkeypatch.setattr(pm, "MOST_BITS", 7)
    assert sorted(map(tuple, pm.collocations(invented, 40, 8).collect())) == brute(pairs_of(invented), 40, 8)


def test_query_matches_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert sorted(map(tuple, pm.collocations(docs, 50, 4).collect())) == brute(pairs_of(docs), 50, 4)


def test_messy_and_empty_tables(spark):
    docs = messy(spark)
    assert sorted(map(tuple, pm.collocations(docs).collect())) == brute(pairs_of(docs))
    assert pm.collocations(empty(docs)).collect() == []


def test_products_beyond_64_bits(spark):
    rows = spark.createDataFrame([(9_000_000_000_000_000_000, 9_100_000_000_000_000_000, 9_200_000_000_000_000_000)], "a long, l long, r long")
    want = 2_000_000 * 9_000_000_000_000_000_000 // (9_100_000_000_000_000_000 + 9_200_000_000_000_000_000)
    assert rows.select(pm.score_of("a", "l", "r").alias("s")).first()["s"] == want
