"""Prompts, answers, evaluation, timing and profiles."""

import pytest
from pyspark.sql import functions as F

from ragtables.operators.evaluation import (build_eval_cases, eval_by_category, eval_misses, eval_summary, evaluate_cases,
                                            keyword_hits, score_keywords)
from ragtables.operators.profiles import ChunkConfig, Profile, default_profiles, profile_violations, profiles_frame, validate_profiles
from ragtables.operators.prompts import DEFAULT_SYSTEM_PROMPT, EMPTY_INDEX_ERROR, answer, build_prompts, format_context
from ragtables.operators.timing import pair_stages, timing_summary

HIT = ("question_id long, rank int, source string, path string, relative_path string, file_name string, parent_dir string, "
       "content string")


def test_format_context(spark):
    h = spark.createDataFrame(
        [(1, 1, "s.md", "/k/sop/s.md", "sop/s.md", "s.md", "sop", "text one"),
         (1, 2, "t.md", "t.md", None, None, None, "text two"),
         (1, 3, None, "", None, None, None, "x")],
        HIT,
    )
    blocks = [r.block for r in format_context(h).orderBy("rank").collect()]
    assert blocks[0] == "[片段 1]\n来源: sop/s.md\n路径: /k/sop/s.md\n目录: sop\n内容: text one"
    assert blocks[1] == "[片段 2]\n来源: t.md\n内容: text two"
    assert blocks[2] == "[片段 3]\n来源: unknown\n内容: x"


def test_prompts_and_answer(spark):
    q = spark.createDataFrame([(1, "what?"), (2, "none?")], "question_id long, question string")
    h = spark.createDataFrame([(1, 2, "b", "", None, None, None, "second"), (1, 1, "a", "", None, None, None, " first "),
                               (1, 3, "a", "", None, None, None, "third")], HIT)
    p = build_prompts(q, h).collect()[0]
    assert p.system == DEFAULT_SYSTEM_PROMPT and list(p.references) == ["a", "b"] and p.context_count == 3
    assert p.user.startswith("以下是检索到的知识库内容：\n[片段 1]") and "用户问题：what?" in p.user
    assert build_prompts(q, h, "  custom  ").collect()[0].system == "custom"
    a = {r.question_id: r for r in answer(q, h).collect()}
    assert a[1].answer == "first" and a[1].error == "" and a[1].context_count == 3
    assert a[2].error == EMPTY_INDEX_ERROR and a[2].answer == "" and a[2].context_count == 0

    def failing(pdf):
        raise RuntimeError("model down")

    b = {r.question_id: r for r in answer(q, h, failing).collect()}
    assert b[1].error == "model down" and b[1].answer == ""


def test_a_failing_prompt_fails_alone(spark):
    q = spark.createDataFrame([(i, f"q{i}") for i in range(6)], "question_id long, question string").coalesce(1)
    h = spark.createDataFrame([(i, 1, "s", "", None, None, None, f"c{i}") for i in range(6)], HIT)

    def failing():
        def fn(pdf):
            if "q3" in list(pdf["question"]):
                raise RuntimeError("no q3")
            return list(pdf["question"])

        return fn

    def short():
        return lambda pdf: list(pdf["question"])[:1]  # one answer too few for every batch but those of one prompt

    got = {r.question: (r.answer, r.error) for r in answer(q, h, failing()).collect()}
    assert got == {f"q{i}": (f"q{i}", "") if i != 3 else ("", "no q3") for i in range(6)}
    assert {r.answer for r in answer(q, h, short()).collect()} == {f"q{i}" for i in range(6)}


def test_keyword_scoring(spark):
    df = spark.createDataFrame([("RAG and Drag", ["rag", "RAG", "x"]), ("abc", [])], "t string, k array<string>")
    r = df.select(keyword_hits(F.col("t"), F.col("k")).alias("m")).collect()
    assert list(r[0].m) == ["rag", "RAG"] and list(r[1].m) == []
    rows = spark.createDataFrame([(["a", "b"], 3), ([], 0), (["a"], 3), ([], 2)], "m array<string>, n int")
    hit, rec = score_keywords(F.col("m"), F.col("n"), 0.5)
    got = [(x.h, round(x.r, 6)) for x in rows.select(hit.alias("h"), rec.alias("r")).collect()]
    assert got == [(True, 0.666667), (True, 1.0), (False, 0.333333), (False, 0.0)]


def test_evaluation(spark):
    cases = spark.createDataFrame(
        [(1, "Q001", "c1", "q one", ["alpha", "beta"], 1), (2, "Q002", "c1", "q two", ["gamma"], 2), (3, "Q003", "c2", "q three", [], 3)],
        "ord int, id string, category string, question string, expected_keywords array<string>, question_id long",
    )
    answers = spark.createDataFrame(
        [(1, "Alpha is here", ["s"], 1, ""), (2, "", [], 0, "boom"), (3, "x", ["s"], 1, "")],
        "question_id long, answer string, references array<string>, context_count int, error string",
    )
    hits = spark.createDataFrame([(1, 1, "beta text", "s", "/p"), (3, 1, "c", "s", "/p")],
                                 "question_id long, rank int, content string, source string, path string")
    contexts = hits.groupBy("question_id").agg(F.collect_list(F.struct("rank", "content", "source", "path")).alias("contexts"))
    res = evaluate_cases(cases, answers.join(contexts, "question_id", "left"))
    r = {x.id: x for x in res.collect()}
    assert r["Q001"].retrieval_hit and r["Q001"].answer_hit and r["Q001"].retrieval_keyword_recall == 0.5
    assert not r["Q002"].retrieval_hit and r["Q002"].error == "boom" and r["Q002"].context_count == 0
    assert r["Q003"].retrieval_hit and r["Q003"].retrieval_keyword_recall == 1.0
    s = eval_summary(res).collect()[0]
    assert (s.total_cases, s.successful_cases, s.failed_cases) == (3, 2, 1) and s.retrieval_recall == 1.0
    cats = {x.category: x for x in eval_by_category(res).collect()}
    assert cats["c1"].total == 1 and cats["c2"].answer_accuracy == 1.0
    assert [x.id for x in eval_misses(res, 2).collect()] == ["Q002"]
    failed = eval_summary(res.filter("error != ''")).collect()[0]
    assert failed.retrieval_recall == 0.0 and failed.avg_latency_ms == 0.0


def test_build_eval_cases(spark):
    t = spark.createDataFrame([(i, f"c{i % 2}") for i in range(5)], "k int, category string")
    c = build_eval_cases(t, 3, ["k"]).orderBy("ord").collect()
    assert [x.id for x in c] == ["Q001", "Q002", "Q003"]
    with pytest.raises(ValueError):
        build_eval_cases(t, 6, ["k"])


def test_timing(spark):
    from datetime import datetime as D

    ev = spark.createDataFrame(
        [("r", "s", "start", D(2024, 1, 1, 0, 0, 0), 1), ("r", "s", "start", D(2024, 1, 1, 0, 0, 1), 2),
         ("r", "s", "end", D(2024, 1, 1, 0, 0, 1, 500000), 3), ("r", "s", "end", D(2024, 1, 1, 0, 0, 2), 4),
         ("r", "t", "start", D(2024, 1, 1, 0, 0, 3), 5), ("r", "t", "end", D(2024, 1, 1, 0, 0, 5), 6)],
        "req string, stage string, kind string, ts timestamp, id int",
    )
    st = pair_stages(ev, request="req", stage="stage", kind="kind", ts="ts", order="id")
    rows = st.orderBy("id").collect()
    assert [(r.stage, r.duration_ms) for r in rows] == [("s", 500.0), ("t", 2000.0)]
    summ = timing_summary(st, request="req", end_order=["ended_at", "id"]).collect()[0]
    assert summ.total_ms == 2500.0 and summ.chain_text == "s(500.0ms) -> t(2000.0ms)" and summ.stages == 2


def test_profiles(spark):
    ps = default_profiles("knowledge")
    assert [p.id for p in ps] == ["kb-fixed", "kb-recursive", "kb-semantic", "kb-structure"]
    assert [p.enabled for p in ps] == [True, False, False, False]
    assert ps[1].collection_name == "knowledge-recursive"
    validate_profiles(profiles_frame(spark, ps))
    bad = ps + [Profile("kb-fixed", " ", "-bad", ChunkConfig("fixed", 10, 20), enabled=False)]
    rules = {r.rule for r in profile_violations(profiles_frame(spark, bad)).collect()}
    assert {"id_duplicate", "name_blank", "collection_name_invalid", "overlap_not_below_size"} <= rules
    with pytest.raises(ValueError):
        validate_profiles(profiles_frame(spark, bad))
    assert profile_violations(profiles_frame(spark, bad), registry_enabled=False).count() == 0
    with pytest.raises(ValueError):
        Profile("x", "y", "ok", ChunkConfig("fixed", 5, 9)).validate()
