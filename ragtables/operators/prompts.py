"""Prompt building and batch answers."""

from __future__ import annotations

from typing import Callable, Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import strip

# Prompt texts of the reference (labels, template and default system prompt).
DEFAULT_SYSTEM_PROMPT = (
    "你是一个严谨的中文知识库问答助手。"
    "请优先依据检索到的上下文回答问题。"
    "如果上下文不足以支持结论，请明确说明不知道或信息不足，"
    "不要编造事实。"
)
BLOCK_HEADER = "[片段 {n}]"
LABEL_PREFIX = "来源: "
PATH_PREFIX = "路径: "
DIR_PREFIX = "目录: "
CONTENT_PREFIX = "内容: "
USER_TEMPLATE_HEAD = "以下是检索到的知识库内容：\n"
USER_TEMPLATE_QUESTION = "\n\n用户问题："
USER_TEMPLATE_TAIL = "\n\n请用中文给出简洁准确的答案，并尽量结合上下文内容。"
EMPTY_INDEX_ERROR = "当前向量库为空，请先建立索引。"


def _nonempty(c: Column) -> Column:
    return F.when(F.length(c) > 0, c)


def context_label(hit_cols: list[str]) -> Column:
    """First non-empty of relative_path, file_name, source, else 'unknown'."""
    cands = [F.col(c) for c in ("relative_path", "file_name", "source") if c in hit_cols]
    return F.coalesce(*[_nonempty(c) for c in cands], F.lit("unknown"))


def format_context(hits: DataFrame) -> DataFrame:
    """Adds ``block``, the text block of each hit (``rank`` is its number)."""
    cols = hits.columns
    label = context_label(cols)
    path = strip(F.coalesce(F.col("path"), F.lit(""))) if "path" in cols else F.lit("")
    parent = strip(F.coalesce(F.col("parent_dir"), F.lit(""))) if "parent_dir" in cols else F.lit("")
    block = F.concat_ws(
        "\n",
        F.concat(F.lit("[片段 "), F.col("rank").cast("string"), F.lit("]")),
        F.concat(F.lit(LABEL_PREFIX), label),
        F.when((F.length(path) > 0) & (path != label), F.concat(F.lit(PATH_PREFIX), path)),
        F.when(F.length(parent) > 0, F.concat(F.lit(DIR_PREFIX), parent)),
        F.concat(F.lit(CONTENT_PREFIX), F.coalesce(F.col("content"), F.lit(""))),
    )
    return hits.withColumn("block", block)


def build_prompts(questions: DataFrame, hits: DataFrame, system_prompt: str = "") -> DataFrame:
    """P2 + P3: per question with hits: ``system``, ``user`` (blocks in rank order), ``references``
    (sources, distinct, first-appearance order), ``context_count``.

    The groups are one question's top-k hits (bounded by k).
    """
    system = system_prompt.strip() or DEFAULT_SYSTEM_PROMPT
    blocks = format_context(hits)
    path = [F.col("path")] if "path" in blocks.columns else [F.lit("").alias("path")]
    per_q = blocks.groupBy("question_id").agg(
        F.array_sort(F.collect_list(F.struct("rank", "block", "source", F.coalesce(F.col("content"), F.lit("")).alias("content"), *path))).alias("_b")
    )
    context = F.array_join(F.transform("_b", lambda b: b["block"]), "\n\n")
    refs = F.array_distinct(F.transform("_b", lambda b: b["source"]))
    joined = questions.join(per_q, "question_id")
    user = F.concat(F.lit(USER_TEMPLATE_HEAD), context, F.lit(USER_TEMPLATE_QUESTION), F.col("question"), F.lit(USER_TEMPLATE_TAIL))
    return joined.select(
        "question_id", "question", F.lit(system).alias("system"), user.alias("user"), refs.alias("references"),
        F.size("_b").alias("context_count"), F.col("_b").alias("_blocks"),
    )


def first_context_answer(pdf):
    """Offline answer function: the first context's content (for tests and the bench).

    A batch holds ``question_id``, ``question``, ``system``, ``user``, ``references``,
    ``context_count`` and ``_blocks`` (the contexts in rank order: rank, block, source, content).
    """
    return [(b[0]["content"] if b is not None and len(b) else "") for b in pdf["_blocks"]]


def generate_answers(prompts: DataFrame, fn: Callable = first_context_answer, batch_size: int = 64) -> DataFrame:
    """One completion per prompt through a user function over pandas batches of ``batch_size`` prompts (one
    client per partition); the answer is stripped, null -> ''. If a batch fails, or gives another number of answers
    than prompts, its prompts are asked one by one, so ``error`` holds the failure of that prompt only."""
    schema = T.StructType(prompts.schema.fields + [T.StructField("answer", T.StringType()), T.StructField("error", T.StringType())])

    def run(batches: Iterator):
        import pandas as pd

        def ask(part: "pd.DataFrame") -> list[tuple[str, str]]:
            try:
                got = list(fn(part))
                if len(got) != len(part):
                    raise ValueError(f"{len(got)} answers for {len(part)} prompts")
                return [(("" if a is None else str(a)).strip(), "") for a in got]
            except Exception as exc:  # any failure of the user's function is a result
                if len(part) == 1:
                    return [("", str(exc) or type(exc).__name__)]
                return [r for i in range(len(part)) for r in ask(part.iloc[i : i + 1])]

        for pdf in batches:
            rows = [r for i in range(0, len(pdf), batch_size) for r in ask(pdf.iloc[i : i + batch_size])]
            yield pdf.assign(answer=[a for a, _ in rows], error=[e for _, e in rows])

    return prompts.mapInPandas(run, schema)


def answer(questions: DataFrame, hits: DataFrame, fn: Callable = first_context_answer, system_prompt: str = "",
           with_contexts: bool = True) -> DataFrame:
    """P5: question -> answer, references, contexts; questions without hits get the empty-index error."""
    prompts = build_prompts(questions, hits, system_prompt)
    answered = generate_answers(prompts, fn)
    cols = ["question_id", "answer", "references", "context_count", "error"]
    out = questions.select("question_id", "question").join(answered.select(*cols, "_blocks"), "question_id", "left")
    out = out.select(
        "question_id", "question",
        F.coalesce("answer", F.lit("")).alias("answer"),
        F.coalesce("references", F.array().cast("array<string>")).alias("references"),
        F.coalesce("context_count", F.lit(0)).alias("context_count"),
        F.when(F.col("_blocks").isNull(), F.lit(EMPTY_INDEX_ERROR)).otherwise(F.col("error")).alias("error"),
        (F.col("_blocks") if with_contexts else F.lit(None)).alias("contexts"),
    )
    return out


def references(hits: DataFrame) -> DataFrame:
    """Per question, the hit sources, distinct, in order of first appearance (rank order)."""
    g = hits.groupBy("question_id").agg(F.array_sort(F.collect_list(F.struct("rank", "source"))).alias("_s"))
    return g.select("question_id", F.array_distinct(F.transform("_s", lambda s: s["source"])).alias("references"))
