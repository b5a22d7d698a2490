"""Keyword evaluation of question sets (V1-V8)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import let


def keyword_hits(text: Column, keywords: Column) -> Column:
    """V1: keywords contained in the text, both lower-cased; order and duplicates kept."""
    return let(F.lower(text), lambda low: F.filter(keywords, lambda k: F.contains(low, F.lower(k))))


def context_text(contents: Column) -> Column:
    """V2: content, source and path of every hit, one per line, in rank order (array<struct>)."""
    return F.array_join(
        F.flatten(F.transform(contents, lambda h: F.array(
            F.coalesce(h["content"], F.lit("")), F.coalesce(h["source"], F.lit("")), F.coalesce(h["path"], F.lit(""))
        ))),
        "\n",
    )


def score_keywords(matched: Column, total: Column, ratio: float) -> tuple[Column, Column]:
    """V3: (hit, recall); total <= 0 -> (true, 1.0); hit iff matched >= max(1, int(total*ratio + 0.999999))."""
    required = F.greatest(F.lit(1), F.floor(total.cast("double") * ratio + 0.999999).cast("int"))
    hit = F.when(total <= 0, F.lit(True)).otherwise(F.size(matched) >= required)
    recall = F.when(total <= 0, F.lit(1.0)).otherwise(F.size(matched).cast("double") / total)
    return hit, recall


def evaluate_cases(cases: DataFrame, answers: DataFrame, min_ratio: float = 0.5) -> DataFrame:
    """V4: per case, V1 + V3 on the contexts and on the answer. ``cases``: (ord, id, category, question,
    expected_keywords, question_id); ``answers``: P5 output with its ``contexts``, so that retrieval is not
    run again. A case with an error scores zero everywhere."""
    latency = F.col("latency_ms") if "latency_ms" in answers.columns else F.lit(0)
    got = answers.select("question_id", "answer", "references", "context_count", "error", latency.alias("latency_ms"), F.col("contexts").alias("_ctx"))
    j = cases.join(got, "question_id", "left")
    kw = F.col("expected_keywords")
    total = F.size(kw)
    ctext = F.coalesce(context_text(F.col("_ctx")), F.lit(""))
    r_m = keyword_hits(ctext, kw)
    a_m = keyword_hits(F.coalesce(F.col("answer"), F.lit("")), kw)
    r_hit, r_rec = score_keywords(r_m, total, min_ratio)
    a_hit, a_rec = score_keywords(a_m, total, min_ratio)
    err = F.coalesce(F.col("error"), F.lit("no answer"))
    ok = err == ""
    empty = F.array().cast("array<string>")
    return j.select(
        "ord", "id", "category", "question", "expected_keywords",
        F.when(ok, r_hit).otherwise(F.lit(False)).alias("retrieval_hit"),
        F.when(ok, r_m).otherwise(empty).alias("retrieval_matched_keywords"),
        F.when(ok, r_rec).otherwise(F.lit(0.0)).alias("retrieval_keyword_recall"),
        F.when(ok, a_hit).otherwise(F.lit(False)).alias("answer_hit"),
        F.when(ok, a_m).otherwise(empty).alias("answer_matched_keywords"),
        F.when(ok, a_rec).otherwise(F.lit(0.0)).alias("answer_keyword_accuracy"),
        F.when(ok, F.col("references")).otherwise(empty).alias("references"),
        F.when(ok, F.col("answer")).otherwise(F.lit("")).alias("answer"),
        F.when(ok, F.col("context_count")).otherwise(F.lit(0)).alias("context_count"),
        err.alias("error"),
        F.coalesce(F.col("latency_ms"), F.lit(0)).cast("int").alias("latency_ms"),
    )


def _rates(prefix: str = "") -> list[Column]:
    valid = F.col("error") == ""
    n_valid = F.count_if(valid)
    return [
        F.count_if(valid & F.col("retrieval_hit")).alias("retrieval_hits"),
        F.count_if(valid & F.col("answer_hit")).alias("answer_hits"),
        F.coalesce(F.count_if(valid & F.col("retrieval_hit")) / F.when(n_valid > 0, n_valid), F.lit(0.0)).alias("retrieval_recall"),
        F.coalesce(F.count_if(valid & F.col("answer_hit")) / F.when(n_valid > 0, n_valid), F.lit(0.0)).alias("answer_accuracy"),
    ]


def summary_columns() -> list[Column]:
    """V5 as aggregates: totals and rates over rows without error (0.0 when none)."""
    valid = F.col("error") == ""
    mean = lambda c: F.coalesce(F.avg(F.when(valid, F.col(c))), F.lit(0.0))
    return [
        F.count(F.lit(1)).alias("total_cases"),
        F.count_if(valid).alias("successful_cases"),
        F.count_if(~valid).alias("failed_cases"),
        *_rates()[2:],
        mean("retrieval_keyword_recall").alias("avg_retrieval_keyword_recall"),
        mean("answer_keyword_accuracy").alias("avg_answer_keyword_accuracy"),
        mean("latency_ms").alias("avg_latency_ms"),
    ]


def eval_summary(results: DataFrame) -> DataFrame:
    """V5: one row, one aggregate pass."""
    return results.agg(*summary_columns())


def eval_by_category(results: DataFrame) -> DataFrame:
    """V6: per category (rows without error only): total, hits and rates."""
    valid = results.filter(F.col("error") == "")
    return valid.groupBy("category").agg(
        F.count("*").alias("total"),
        F.count_if(F.col("retrieval_hit")).alias("retrieval_hit"),
        F.count_if(F.col("answer_hit")).alias("answer_hit"),
        (F.count_if(F.col("retrieval_hit")) / F.count("*")).alias("retrieval_recall"),
        (F.count_if(F.col("answer_hit")) / F.count("*")).alias("answer_accuracy"),
    )


def eval_misses(results: DataFrame, n: int = 10) -> DataFrame:
    """V7: of the first ``n`` results (by ``ord``), those with an error or a missed hit."""
    first = results.filter(F.col("ord") <= n)
    return first.filter((F.col("error") != "") | ~F.col("retrieval_hit") | ~F.col("answer_hit"))


def build_eval_cases(templates: DataFrame, n: int, order_by: list[str]) -> DataFrame:
    """V8: ordered templates -> first ``n`` with ids Q001...; fewer than ``n`` templates is an error."""
    from ..plans.ordinals import with_ordinal

    have = templates.limit(n).count()
    if have < n:
        raise ValueError(f"only {have} templates for {n} cases")
    # only the keys are numbered; a large table is range-split over the tasks
    keys = with_ordinal(templates.select(*order_by), order_by, "ord", start=1).filter(F.col("ord") <= n)
    same = None
    for c in order_by:
        keys = keys.withColumnRenamed(c, f"_key_{c}")
        one = F.col(c).eqNullSafe(F.col(f"_key_{c}"))
        same = one if same is None else same & one
    first = templates.join(keys, same).drop(*[f"_key_{c}" for c in order_by])
    return first.withColumn("ord", F.col("ord").cast("int")).withColumn("id", F.format_string("Q%03d", F.col("ord")))


def run_evaluation(spark, cases_path: str, index: DataFrame, *, retrieval=None, profiles=None, embed=None,
                   answer_fn=None, limit: int = 0, min_ratio: float = 0.5, report_path: str | None = None):
    """Batch evaluation: cases (S15) -> retrieval (R9/R10) -> answers (P5) -> per-case
    scores (V4) -> summary (V5), per category (V6), first misses (V7) -> report (S16). One Spark job
    graph in place of the per-case request loop. The results are computed once (the model is asked once per question):
    written as the report's results, or checkpointed without ``report_path``; all else is derived from the kept rows, and
    the summary is observed while they are written. Returns (results, summary, by_category, misses)."""
    from ..operators.profiles import RetrievalConfig
    from ..operators.prompts import answer, first_context_answer
    from ..operators.retrieval import retrieve, retrieve_multi
    from ..plans.checkpoints import cut
    from ..sources.evalsets import load_eval_cases, write_eval_results, write_eval_summary

    cases, meta = load_eval_cases(spark, cases_path, limit)
    cases = cases.withColumn("question_id", F.col("ord").cast("long"))
    qs = cases.select("question_id", "question")
    config = retrieval or RetrievalConfig("keyword")
    if profiles:
        hits = retrieve_multi(qs, index, list(profiles), config, embed=embed)
    else:
        hits = retrieve(qs, index, config, embed=embed)
    answers = answer(qs, hits, answer_fn or first_context_answer)
    results = evaluate_cases(cases, answers, min_ratio)
    if not report_path:
        results = cut(results)
        return results, eval_summary(results), eval_by_category(results), eval_misses(results)
    results, summary = write_eval_results(results, report_path)
    by_cat = eval_by_category(results)
    write_eval_summary(summary, by_cat, report_path, cases_path, meta.first()["meta"])
    return results, summary, by_cat, eval_misses(results)
