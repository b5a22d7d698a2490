"""Quality classifier (op1) and quality rules (op2)."""

import math

import numpy as np
from plain import empty, messy, stats

from ragtables.llm import quality_model, quality_rules
from ragtables.llm.queries import op1_quality_model, op2_quality_rules

SF = "/root/testdata/sf0.01"


def test_scores_separate_held_out_labels(spark):
    rows = op1_quality_model(spark, SF).join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").filter("held_out").collect()
    right = sum((r["predicted"] == 1) == (r["quality"] == 1) for r in rows)
    assert len(rows) > 80 and right / len(rows) > 0.95
    good, bad = [r["score"] for r in rows if r["quality"] == 1], [r["score"] for r in rows if r["quality"] == 0]
    assert np.mean([[g > b for b in bad] for g in good]) > 0.97


def test_scores_of_messy_and_empty_tables(spark):
    docs = messy(spark)
    labels = spark.createDataFrame([(1, 0, 0), (5, 1, 0), (6, 1, None), (7, 0, 0), (None, 1, 0), (4, None, 0), (8, 7, 0)], "doc_id long, quality int, toxic int")
    rows = quality_model.quality_scores(docs, labels).collect()
    assert len(rows) == docs.count() and all(0 <= r["score"] <= 1 for r in rows)
    assert len({r["score"] for r in rows if r["doc_id"] in (1, 2)}) == 1  # null is empty
    none = quality_model.quality_scores(docs, empty(labels)).collect()
    assert {r["score"] for r in none} == {0.5} and {r["predicted"] for r in none} == {1}
    assert quality_model.quality_scores(empty(docs), labels).collect() == []


def test_temperature_lowers_the_loss():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(400, 5))
    y = (x[:, 0] + rng.normal(size=400) > 0).astype(float)
    tune = np.arange(400) % 5 == 0
    model = quality_model.fit_network(x, y, tune)
    calibrated = quality_model.loss(quality_model.logits(model, x[tune]), y[tune])
    assert calibrated <= quality_model.loss(quality_model.logits(model | {"temperature": 1.0}, x[tune]), y[tune]) + 1e-3


def test_statistics_match_plain_python(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    rows = {r["doc_id"]: r for r in op2_quality_rules(spark, "/root/testdata/sf0.001").collect()}
    for d in docs.collect():
        want = stats(d["text"])
        got = rows[d["doc_id"]]
        assert {k: got[k] for k in want} == want
        assert got["base_failed"] == (want["n_words"] < 10 or 100 * want["n_repeat_words"] > 20 * want["n_words"])
        assert not (got["base_failed"] and got["kept"])


def test_rules_of_messy_and_empty_tables(spark):
    docs = messy(spark)
    labels = spark.createDataFrame([(4, 1, 0), (9, 1, 0)], "doc_id long, quality int, toxic int")
    rows = quality_rules.quality_rules(docs, labels).collect()
    texts = sorted((stats(r["text"]) for r in docs.collect()), key=str)
    assert sorted(({k: r[k] for k in texts[0]} for r in rows), key=str) == texts
    assert all(r["kept"] != r["base_failed"] for r in rows)  # too few labels certify no rule
    assert quality_rules.quality_rules(empty(docs), empty(labels)).collect() == []


def test_binomial_tail_is_exact():
    for n, p in ((5, 0.3), (40, 0.02), (300, 0.01)):
        for k in range(0, n, max(1, n // 7)):
            want = sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1))
            assert abs(quality_rules.tail_at_most(k, n, p) - want) < 1e-10


def test_certified_cutoff_is_the_strictest_that_holds():
    n, rejected = 2000, [400, 60, 9, 2, 0]
    step = quality_rules.certified_cutoff(rejected, n, 0.01, 0.001)
    assert step == 3 and quality_rules.tail_at_most(9, n, 0.01) > 0.001 >= quality_rules.tail_at_most(2, n, 0.01)
    assert quality_rules.certified_cutoff([0, 0], 100, 0.01, 0.001) is None


def test_learned_rule_rejects_and_spares_good_rows(spark):
    good = [(i, "some plain words that make a good text of ten words and more", "en") for i in range(900)]
    bad = [(1000 + i, "### $$$ *** some &&& words ||| that %%% are $$$ mostly *** signs ### here", "en") for i in range(50)]
    docs = spark.createDataFrame(good + bad, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, 1) for i in range(900)] + [(1000 + i, 0) for i in range(50)], "doc_id long, quality int")
    rows = quality_rules.quality_rules(docs, labels).collect()
    assert all(r["kept"] == (r["doc_id"] < 900) for r in rows)


def test_repeated_labels_and_rows_certify_nothing_new(spark):
    good = [(i, f"some plain words that make a good text of ten words and number {i}", "en") for i in range(60)]
    spam = [(1000, "### $$$ *** some &&& words ||| that %%% are $$$ mostly *** signs ### here", "en")]
    docs = spark.createDataFrame(good + spam, "doc_id long, text string, lang string")
    marks = [(i, 1) for i in range(60)]
    columns = ["doc_id", "kept", "broken_rules"]
    once = quality_rules.quality_rules(docs, spark.createDataFrame(marks, "doc_id long, quality int")).select(columns).collect()
    often = quality_rules.quality_rules(docs, spark.createDataFrame(marks * 20, "doc_id long, quality int")).select(columns).collect()
    assert sorted(map(str, once)) == sorted(map(str, often)) and not any(r["broken_rules"] for r in once)
    rows = quality_rules.quality_rules(docs.unionByName(docs.filter("doc_id < 60")), spark.createDataFrame(marks, "doc_id long, quality int")).select(columns)
    assert {str(r) for r in rows.collect()} == {str(r) for r in once}


def test_documents_with_conflicting_labels_are_not_used(spark):
    docs = spark.createDataFrame([(i, f"some plain words that make a good text of ten words and number {i}", "en") for i in range(900)], "doc_id long, text string, lang string")
    marks = spark.createDataFrame([(i, q) for i in range(900) for q in (0, 1)], "doc_id long, quality int")
    assert all(r["kept"] and not r["broken_rules"] for r in quality_rules.quality_rules(docs, marks).collect())
