"""Retrieval over a chunk index, batch over a table of questions.

Questions are a table ``(question_id, question[, embedding])``; hits are ranked rows per ``question_id`` (see
``schemas.HIT_COLUMNS``). Ties are broken by ``(doc_ord, chunk_index)``.

* keyword (R3): a scan of the texts, or a threshold algorithm over stored term tables (``operators.keyword``).
* vector (R4): exact, block by block (``operators.vector_search``); R5 rules out cells first (``operators.cells``).

All methods keep the best hits of each (question, collection), so several collections are searched in one plan.
"""

from __future__ import annotations

from typing import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.tokens import keyword_score_tokens, tokenize
from ..functions.vectors import cosine
from ..plans.joins import join_small
from ..plans.topk import top_k
from ..schemas import FILE_METADATA_COLUMNS
from . import vector_search
from .keyword import KeywordTables, scan_scores, term_scores
from .profiles import Profile, RetrievalConfig
from .vector_search import with_payload

PAYLOAD = ["collection_name", "kb_id", "doc_ord", "chunk_index", "content", "source", "path", *FILE_METADATA_COLUMNS]


def _payload(index: DataFrame) -> list[str]:
    return [c for c in PAYLOAD if c in index.columns]


def keyword_topk(questions: DataFrame, index: DataFrame, k: int, tables: KeywordTables | None = None, **sizes) -> DataFrame:
    """Chunks with score > 0, best k per (question, collection); distance = round(1 - score, 6). ``tables``: stored
    term tables of the index, which are then used in place of a scan of its texts. ``sizes``: see ``operators.keyword``."""
    n = questions.count()
    if n == 0 or k <= 0:
        fields = [*index.select(*_payload(index)).schema.fields, questions.schema["question_id"], T.StructField("score", T.DoubleType())]
        return index.sparkSession.createDataFrame([], T.StructType(fields).add("rank", T.IntegerType()).add("distance", T.DoubleType()))
    if tables is None:
        scores = scan_scores(questions, index, k, **sizes)
    else:
        scores = term_scores(questions, index, k, tables, **sizes)
        scores = scores if "collection_name" in index.columns else scores.drop("collection_name")
    return with_payload(index, scores, n, k, _payload(index)).withColumn("distance", F.round(1 - F.col("score"), 6))


def vector_topk(questions: DataFrame, index: DataFrame, k: int, *, vec_col: str = "embedding", question_vec_col: str = "embedding",
                carry: list[str] | None = None, **sizes) -> DataFrame:
    """The k nearest chunks per question and collection by cosine distance (exact), best first, with payload columns
    (plus ``carry``, e.g. the chunk vector for re-ranking). ``sizes``: see ``vector_search.vector_topk``."""
    payload = _payload(index) + [c for c in (carry or []) if c not in PAYLOAD]
    return vector_search.vector_topk(questions, index, k, vec_col=vec_col, question_vec_col=question_vec_col, payload=payload, **sizes)


# ---------------------------------------------------------------------------------------------------
# re-ranking, fusion, merging


def rerank(questions: DataFrame, candidates: DataFrame, k: int, *, vec_col: str = "embedding", question_vec_col: str = "embedding",
           group: tuple[str, ...] = ("question_id",)) -> DataFrame:
    """score = 0.7 * cosine(question, chunk) + 0.3 * keyword score; best k of each ``group`` by score.

    ``candidates`` are vector hits that still carry the chunk vector and their vector ``rank``.
    """
    q = questions.select("question_id", tokenize("question").alias("_qtok"), F.col(question_vec_col).alias("_qvec"))
    c = join_small(candidates.withColumnRenamed("rank", "_vrank"), q, "question_id")
    vscore = F.when(F.col(vec_col).isNotNull(), cosine("_qvec", vec_col)).otherwise(F.lit(0.0))
    scored = c.withColumn("score", vscore * 0.7 + keyword_score_tokens(F.col("_qtok"), F.col("content")) * 0.3)
    scored = scored.withColumn("distance", F.round(1 - F.col("score"), 6))
    ranked = top_k(scored, list(group), [F.desc("score"), F.asc("_vrank")], k)
    return ranked.drop("_qtok", "_qvec", "_vrank", vec_col, "cosine")


def rrf_fuse(keyword_hits: DataFrame, vector_hits: DataFrame, rrf_k: int, k: int, *, group: tuple[str, ...] = ("question_id",)) -> DataFrame:
    """Reciprocal-rank fusion keyed by (source, content) in each ``group``; every occurrence adds 1/(rrf_k + rank).

    The fused row is the first sighting (keyword list first, then by rank); ties keep that order.
    Output has ``distance = round(1 - score, 6)`` and no score.
    """
    cols = [c for c in PAYLOAD if c in keyword_hits.columns and c in vector_hits.columns]
    kw = keyword_hits.select("question_id", "rank", *cols).withColumn("_list", F.lit(0))
    vc = vector_hits.select("question_id", "rank", *cols).withColumn("_list", F.lit(1))
    u = kw.unionByName(vc)
    first = F.struct(F.col("_list"), F.col("rank"))
    g = u.groupBy(*group, "source", "content").agg(
        F.sum(1.0 / (F.lit(rrf_k) + F.col("rank"))).alias("score"),
        F.min_by(F.struct(*[c for c in cols if c not in ("source", "content", *group)]), first).alias("_seed"),
        F.min(first).alias("_first"),
    )
    ranked = top_k(g, list(group), [F.desc(F.round("score", 12)), F.asc("_first._list"), F.asc("_first.rank")], k)
    out = ranked.select(*group, "rank", "source", "content", "_seed.*", F.round(1 - F.col("score"), 6).alias("distance"))
    return out.withColumn("score", F.lit(None).cast("double"))


def merge_hits(groups: DataFrame, k: int) -> DataFrame:
    """Concatenated hit groups (``group_ord``, ``rank``) -> first row per (source, content), sorted
    by distance (or 1 - score, or 999) then -score; ``k <= 0`` keeps all."""
    first = top_k(groups, ["question_id", "source", "content"], [F.asc("group_ord"), F.asc("rank")], 1, rank_col="_dup")
    dist, score = F.col("distance"), F.col("score")
    k1 = F.coalesce(dist, 1 - score, F.lit(999.0))
    k2 = F.when(dist.isNotNull(), -F.coalesce(score, F.lit(0.0))).when(score.isNotNull(), -score).otherwise(F.lit(0.0))
    keyed = first.drop("_dup").withColumnRenamed("rank", "_group_rank").withColumn("_k1", k1).withColumn("_k2", k2)
    ranked = top_k(keyed, ["question_id"], [F.asc("_k1"), F.asc("_k2"), F.asc("group_ord"), F.asc("_group_rank")], k)
    return ranked.drop("_k1", "_k2", "_group_rank")


# ---------------------------------------------------------------------------------------------------
# one collection, several collections


def _with_question_vectors(questions: DataFrame, embed: Callable[[Column], Column] | None, question_vec_col: str) -> DataFrame:
    if question_vec_col in questions.columns:
        return questions
    if embed is None:
        raise ValueError("vector methods need question vectors or an embed function")
    return questions.withColumn(question_vec_col, embed(F.col("question")))


def _method_hits(questions: DataFrame, index: DataFrame, config: RetrievalConfig, embed: Callable[[Column], Column] | None, vec_col: str,
                 tables: KeywordTables | None, group: tuple[str, ...]) -> DataFrame:
    """Hits of the configured method, best ones of each ``group``."""
    qvec, m = "_question_vec", config.method
    if m == "keyword":
        return keyword_topk(questions, index, config.top_k, tables)
    qs = _with_question_vectors(questions, embed, vec_col).withColumnRenamed(vec_col, qvec)
    if m == "vector":
        return vector_topk(qs, index, config.top_k, vec_col=vec_col, question_vec_col=qvec)
    if m == "rerank":
        near = vector_topk(qs, index, config.candidate_k, vec_col=vec_col, question_vec_col=qvec, carry=[vec_col])
        return rerank(qs, near, config.top_k, vec_col=vec_col, question_vec_col=qvec, group=group)
    words = keyword_topk(questions, index, config.candidate_k, tables)
    near = vector_topk(qs, index, config.candidate_k, vec_col=vec_col, question_vec_col=qvec)
    return rrf_fuse(words, near, config.rrf_k, config.top_k, group=group)


def _finished(hits: DataFrame) -> DataFrame:
    hits = hits if "score" in hits.columns else hits.withColumn("score", F.lit(None).cast("double"))
    return hits.drop("cosine")


def _tables_of(tables: KeywordTables | None, names: list[str]) -> KeywordTables | None:
    """The part of stored term tables that belongs to these collections (a partition filter)."""
    return None if tables is None else KeywordTables(*(t.filter(F.col("collection_name").isin(*names)) for t in tables))


def retrieve(questions: DataFrame, index: DataFrame, config: RetrievalConfig = RetrievalConfig(), *, collection: str | None = None,
             embed: Callable[[Column], Column] | None = None, vec_col: str = "embedding", tables: KeywordTables | None = None) -> DataFrame:
    """Hits of one collection by ``keyword``, ``vector``, ``rerank`` or ``rrf``; stamps the collection."""
    config.validate()
    if collection is not None:
        index, tables = index.filter(F.col("collection_name") == collection), _tables_of(tables, [collection])
    hits = _finished(_method_hits(questions, index, config, embed, vec_col, tables, ("question_id",)))
    return hits if collection is None else hits.withColumn("collection_name", F.lit(collection))


def retrieve_multi(questions: DataFrame, index: DataFrame, profiles: list[Profile], config: RetrievalConfig = RetrievalConfig(), *,
                   default_collection: str | None = None, embed: Callable[[Column], Column] | None = None, vec_col: str = "embedding",
                   tables: KeywordTables | None = None) -> DataFrame:
    """R9 per enabled profile (kb_id, kb_name stamped, cut to max(top_k, candidate_k)), then R8 in profile order,
    as one search of all their collections. Without enabled profiles: R9 on the default collection."""
    active = [p for p in profiles if p.enabled]
    if not active:
        return retrieve(questions, index, config, collection=default_collection, embed=embed, vec_col=vec_col, tables=tables)
    config.validate()
    names = sorted({p.collection_name for p in active})
    index = index.filter(F.col("collection_name").isin(*names))
    hits = _finished(_method_hits(questions, index, config, embed, vec_col, _tables_of(tables, names), ("question_id", "collection_name")))
    hits = hits.filter(F.col("rank") <= max(config.top_k, config.candidate_k)).drop("kb_id", "kb_name")
    # one small row per profile, as literals: rows made of Python objects take Python workers of their own on every executor
    stamp = lambda p, i: F.struct(*[F.lit(v).cast(t).alias(c) for c, v, t in (("collection_name", p.collection_name, "string"), ("kb_id", p.id, "string"), ("kb_name", p.name, "string"), ("group_ord", i, "int"))])
    stamps = index.sparkSession.range(1).select(F.inline(F.array(*[stamp(p, i) for i, p in enumerate(active)])))
    return merge_hits(hits.join(F.broadcast(stamps), "collection_name"), config.top_k).drop("group_ord")
