"""Embedding near duplicates (op12) against all pairs."""

import math
import random

import numpy as np
import pytest
from plain import empty

from ragtables.llm import vector_near_dup as vn
from ragtables.llm.queries import op12_vector_near_dup

SF = "/root/testdata/sf0.001"
SCHEMA = "vec_id long, embedding array<float>, label int"


def fine(v):
    return v is not None and len(v) > 0 and all(x is not None and math.isfinite(x) for x in v) and any(v)


def brute(rows, threshold=0.93):
    """(vec_id, n_links, component_id, kept) of every row, and the number of links, by all pairs."""
    n = len(rows)
    unit = [np.array(v, float) / np.linalg.norm(np.array(v, float) / np.abs(v).max()) / np.abs(v).max() if fine(v) and label is not None else None for _, v, label in rows]
    groups = {}
    for i, (_, v, label) in enumerate(rows):
        if unit[i] is not None:
            groups.setdefault((label, len(v)), []).append(i)
    links, parent = [0] * n, list(range(n))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for own in groups.values():
        x = np.array([unit[i] for i in own])
        near = x @ x.T >= threshold
        for i, j in zip(*np.nonzero(np.triu(near, 1)), strict=True):
            links[own[i]] += 1
            links[own[j]] += 1
            parent[find(own[i])] = find(own[j])
    low = {}
    for i, (vec_id, *_) in enumerate(rows):
        if vec_id is not None:
            low[find(i)] = min(low.get(find(i), vec_id), vec_id)
    return sorted(((r[0], links[i], low.get(find(i)), r[0] == low.get(find(i))) for i, r in enumerate(rows)), key=str)


def got(df):
    return sorted(map(tuple, df.collect()), key=str)


def around(rng, center, angle, n):
    """n vectors at about this angle from the center."""
    noise = rng.standard_normal((n, len(center)))
    noise -= np.outer(noise @ center, center)
    noise /= np.linalg.norm(noise, axis=1, keepdims=True)
    return math.cos(angle) * center + math.sin(angle) * noise


def unit(rng, d):
    x = rng.standard_normal(d)
    return x / np.linalg.norm(x)


@pytest.fixture(scope="module")
def grouped():
    rng, rows = np.random.default_rng(6), []
    for size, angle in ((400, 0.1), (250, 0.22), (60, 0.15), (3, 0.05), (2, 0.1), (90, 0.02)):
        center = unit(rng, 64)
        rows += [(v, int(rng.integers(1, 3))) for v in around(rng, center, angle, size)]
    # two tight groups whose vectors are partly linked
    center = unit(rng, 64)
    for c in around(rng, center, 0.16, 2):
        rows += [(v, 3) for v in around(rng, c, 0.08, 120)]
    rows += [(unit(rng, 64), int(rng.integers(1, 4))) for _ in range(900)]
    rows += [(rows[i][0] * 3.5, rows[i][1]) for i in range(0, 800, 40)]
    return [(i, [float(np.float32(x)) for x in v], label) for i, (v, label) in enumerate(rows)]


def test_links_and_components_match_all_pairs(spark, grouped):
    df = spark.createDataFrame(grouped, SCHEMA).repartition(5)
    want = brute(grouped)
    found = got(vn.near_duplicates(df))
    assert [r[0] for r in found] == [r[0] for r in want]
    total = sum(r[1] for r in want)
    assert all(a[1] <= b[1] for a, b in zip(found, want, strict=True))  # none below the threshold
    assert sum(r[1] for r in found) >= 0.995 * total
    assert sum(a[2] == b[2] for a, b in zip(found, want, strict=True)) >= 0.999 * len(want)


def test_all_kinds_of_pairs_occur(spark, grouped):
    rows = vn.usable(spark.createDataFrame(grouped, SCHEMA))
    plan = vn.calibrated(1200)
    inside, made = vn.knots(rows, plan)
    assert inside.count() > 500 and made.count() < 60
    tight = {r["row"]: r["node"] for r in inside.collect()}
    vectors = {r["row"]: (np.array(r["embedding"], float), r["label"]) for r in rows.collect()}
    by_node = {}
    for row, node in tight.items():
        by_node.setdefault(node, []).append(vectors[row])
    for own in by_node.values():  # every two vectors of a knot are linked
        x = np.array([v / np.linalg.norm(v) for v, _ in own])
        assert (x @ x.T >= vn.THRESHOLD).all() and len({label for _, label in own}) == 1


def test_recall_of_pairs_at_the_threshold(spark):
    rng, rows = np.random.default_rng(3), []
    for i in range(1500):
        x = unit(rng, 32)
        rows += [(2 * i, x.tolist(), 1), (2 * i + 1, around(rng, x, math.acos(0.9301), 1)[0].tolist(), 1)]
    found = got(vn.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")))
    want = brute(rows)
    assert sum(r[1] for r in found) >= 0.98 * sum(r[1] for r in want)


def test_plans_keep_recall_at_every_size():
    for largest in (0, 1, 10, 1000, 10**6, 10**9):
        plan = vn.calibrated(largest)
        p = (1 - plan.angle / math.pi) ** plan.bits * math.erf(vn.DEVIATIONS / math.sqrt(2))
        miss = sum(math.comb(plan.tables, i) * p**i * (1 - p) ** (plan.tables - i) for i in range(plan.least))
        assert miss <= 1 - vn.RECALL and largest <= 4 * vn.PER_CELL * 2**plan.bits


def test_query_matches_all_pairs(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding", "label").collect()]
    assert got(op12_vector_near_dup(spark, SF)) == brute(rows)


def test_messy_and_empty_tables(spark):
    rng = random.Random(1)
    v = [rng.random() for _ in range(8)]
    rows = [(1, v, 1), (2, v, 1), (2, v, 1), (None, v, 1), (3, None, 1), (4, [], 1), (5, [0.0] * 8, 1), (6, [None, 1.0], 1), (7, [float("nan"), 1.0], 1),
            (8, [float("inf"), 1.0], 1), (9, v, None), (10, [2 * x for x in v], 1), (11, v[:4], 1), (12, [-x for x in v], 1), (13, v, 2), (None, [1.0, 0.0], 5), (14, [1e300, 1e300], 6), (15, [1e-300, 1e-300], 6)]
    df = spark.createDataFrame([(*r, 1, "x", 2, 0.5) for r in rows], "vec_id long, embedding array<double>, label int, row int, node string, dim int, v double")
    assert got(vn.near_duplicates(df)) == brute(rows)
    assert vn.near_duplicates(empty(df)).collect() == []
