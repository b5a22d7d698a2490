"""DuckDB SQL for each registered query (tables are views named after the parquet files)."""

from __future__ import annotations

from .sqlparts import (
    EMPTY, NL2, WS, clean, explode_list, fixed, lit, nonblank, overlap, recursive_ctes, sections, strip, tokens,
)


def _with(ctes: list[str], body: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n" + body


def _docs_cte(text: str = "text") -> str:
    return f"d AS (SELECT doc_id, {clean(text)} AS t FROM documents)"


def c2_split_fixed() -> str:
    return _with(
        [_docs_cte("replace(text, chr(10), chr(10) || chr(10))"), f"c AS (SELECT doc_id, {fixed('t', 800, 120)} AS chunks FROM d WHERE length(t) > 0)"],
        explode_list("doc_id", "chunks", "c"),
    )


def c4_split_recursive() -> str:
    ctes, last = recursive_ctes("s", "doc_id", "st", 300, 40)
    return _with(
        [_docs_cte(), "s AS (SELECT doc_id, [[t]] AS st FROM d WHERE length(t) > 0)", *ctes],
        explode_list("doc_id", "chunks", last),
    )


def _sentences(t: str) -> str:
    marked = f"regexp_replace({t}, '([。！？!?；;\n])', '\\1' || chr(1), 'g')"
    return nonblank(f"string_split({marked}, chr(1))")


def c5_split_sentences() -> str:
    return _with(
        [_docs_cte(), f"s AS (SELECT doc_id, {_sentences('t')} AS ss FROM d WHERE length(t) > 0)"],
        explode_list("doc_id", "ss", "s", "sentence_index", "sentence"),
    )


def _bucket(t: str, dim: int = 64) -> str:
    return f"((('0x' || substr(md5({t}), 1, 7))::BIGINT % {dim})::INTEGER)"


def _embed_ctes(src: str, keys: str, text: str, prefix: str, dim: int = 64) -> tuple[list[str], str]:
    """E2 as CTEs over ``src``: adds ``vec`` (FLOAT[]) keyed by ``keys``."""
    ctes = [
        f"{prefix}b AS (SELECT {keys}, list_transform({tokens(text)}, lambda t: {_bucket('t', dim)}) AS bk FROM {src})",
        f"{prefix}c AS (SELECT {keys}, list_transform(range(0, {dim}), lambda j: len(list_filter(bk, lambda x: x = j))::DOUBLE) AS cnt FROM {prefix}b)",
        f"{prefix}n AS (SELECT {keys}, cnt, sqrt(list_sum(list_transform(cnt, lambda x: x * x))) AS nrm FROM {prefix}c)",
        f"{prefix}v AS (SELECT {keys}, CASE WHEN nrm = 0 THEN list_transform(cnt, lambda x: x::FLOAT) "
        f"ELSE list_transform(cnt, lambda x: (x / nrm)::FLOAT) END AS vec FROM {prefix}n)",
    ]
    return ctes, f"{prefix}v"


def _cos(a: str, b: str) -> str:
    """E3 on two FLOAT[] expressions."""
    A, B = f"{a}::DOUBLE[]", f"{b}::DOUBLE[]"
    na = f"sqrt(list_sum(list_transform({A}, lambda x: x * x)))"
    nb = f"sqrt(list_sum(list_transform({B}, lambda x: x * x)))"
    return (
        f"(CASE WHEN {a} IS NULL OR {b} IS NULL OR len({a}) = 0 OR len({a}) <> len({b}) THEN 0.0 "
        f"WHEN {na} = 0 OR {nb} = 0 THEN 0.0 ELSE list_dot_product({A}, {B}) / ({na} * {nb}) END)"
    )


def c3_apply_overlap() -> str:
    return _with(
        [_docs_cte(), f"s AS (SELECT doc_id, {overlap(_sentences('t'), 10)} AS ss FROM d WHERE length(t) > 0)"],
        explode_list("doc_id", "ss", "s"),
    )


def c6_user_model() -> str:
    """C6 with a model that tells even from odd sentence lengths."""
    return c6_split_semantic(model=(["ev AS (SELECT doc_id, i, s, CASE WHEN length(s) % 2 = 0 THEN [1.0, 0.0] ELSE [0.0, 1.0] END AS vec FROM u)"], "ev"))


def s3_decode_text() -> str:
    return "SELECT doc_id, text AS utf8, '中文' || regexp_replace(text, '[^ -~]', '', 'g') AS gbk, text AS bad FROM documents"


def s6_xml_to_text() -> str:
    nl = "chr(10)"
    return (
        f"SELECT o_orderkey, '<order>' || {nl} || '  <status>' || {nl} || '  ' || o_orderstatus || {nl} || '  <customer>' || {nl} || '    <key>' || {nl} || "
        f"'    ' || o_custkey || {nl} || '  <priority>' || {nl} || '  ' || o_orderpriority AS text FROM orders"
    )


def c6_split_semantic(size: int = 300, overlap: int = 40, th: float = 0.3, model: tuple | None = None) -> str:
    ectes, ev = model or _embed_ctes("u", "doc_id, i, s", "s", "e")
    step = (
        "lambda acc, it: CASE WHEN length(acc.cur) = 0 THEN {'out': acc.out, 'cur': it.s} "
        f"WHEN it.sim >= {th} AND length(acc.cur) + length(it.s) <= {size} THEN {{'out': acc.out, 'cur': acc.cur || it.s}} "
        f"ELSE {{'out': list_append(acc.out, {strip('acc.cur')}), 'cur': it.s}} END"
    )
    fin = f"(CASE WHEN length({strip('st.cur')}) > 0 THEN list_append(st.out, {strip('st.cur')}) ELSE st.out END)"
    over = f"flatten(list_transform(groups, lambda g: CASE WHEN length(g) <= {size} THEN [g] ELSE {fixed('g', size, overlap)} END))"
    return _with(
        [
            _docs_cte(),
            f"s AS (SELECT doc_id, {_sentences('t')} AS ss FROM d WHERE length(t) > 0)",
            "u AS (SELECT doc_id, unnest(range(len(ss))) AS i, unnest(ss) AS s FROM s)",
            *ectes,
            f"p AS (SELECT doc_id, i, s, vec, lag(vec) OVER (PARTITION BY doc_id ORDER BY i) AS pv FROM {ev})",
            f"q AS (SELECT doc_id, i, s, CASE WHEN i = 0 THEN 0.0 ELSE {_cos('pv', 'vec')} END AS sim FROM p)",
            "g AS (SELECT doc_id, list({'s': s, 'sim': sim} ORDER BY i) AS items FROM q GROUP BY doc_id)",
            f"f AS (SELECT doc_id, list_reduce(items, {step}, {{'out': {EMPTY}, 'cur': ''}}) AS st FROM g)",
            f"h AS (SELECT doc_id, {fin} AS groups FROM f)",
            f"o AS (SELECT doc_id, {over} AS chunks FROM h)",
        ],
        explode_list("doc_id", "chunks", "o"),
    )


def _customer_records_cte() -> list[str]:
    line = lambda c: f"'{c}: ' || coalesce(CAST({c} AS VARCHAR), '')"
    rec = " || chr(10) || ".join(line(c) for c in ["c_custkey", "c_name", "c_acctbal", "c_mktsegment"])
    return [
        "r0 AS (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS i FROM customer)",
        f"r1 AS (SELECT c_nationkey, i, ((i - 1) // 50)::INTEGER AS part, {strip(chr(39) + '记录 ' + chr(39) + ' || i || chr(10) || ' + rec)} AS sec FROM r0)",
        f"recs AS (SELECT c_nationkey, part, {strip(chr(39) + '客户' + chr(39) + f' || {NL2} || string_agg(sec, {NL2} ORDER BY i)')} AS content FROM r1 GROUP BY c_nationkey, part)",
    ]


def s8_rows_to_text() -> str:
    return _with(_customer_records_cte(), "SELECT c_nationkey, part, content FROM recs")


def c8_split_structure() -> str:
    ctes, last = recursive_ctes("s", "doc_id", "st", 300, 40)
    return _with(
        [
            *_customer_records_cte(),
            f"d AS (SELECT (c_nationkey * 1000 + part)::BIGINT AS doc_id, {clean('content')} AS t FROM recs)",
            f"s AS (SELECT doc_id, list_transform({sections('t')}, lambda x: [x]) AS st FROM d WHERE length(t) > 0)",
            *ctes,
        ],
        explode_list("doc_id", "chunks", last),
    )


def _default_chunks_ctes() -> list[str]:
    return [
        _docs_cte(),
        f"c AS (SELECT doc_id, {fixed('t', 800, 120)} AS chunks FROM d WHERE length(t) > 0)",
        f"chunks AS ({explode_list('doc_id', 'chunks', 'c')})",
    ]


def c10_chunk_keys() -> str:
    return _with(
        _default_chunks_ctes(),
        "SELECT format('default-doc-{}-chunk-{}', doc_id, chunk_index) AS id, doc_id, chunk_index, 'knowledge' AS collection_name FROM chunks",
    )


def r1_tokenize() -> str:
    return _with([f"b AS (SELECT item_id, {tokens('text')} AS toks FROM benchmark)"], explode_list("item_id", "toks", "b", "pos", "token"))


def _keyword_topk(k: int) -> list[str]:
    return [
        *_default_chunks_ctes(),
        "cl AS (SELECT doc_id, chunk_index, lower(content) AS low FROM chunks)",
        f"q AS (SELECT item_id AS question_id, {tokens('text')} AS toks FROM benchmark)",
        "sc AS (SELECT q.question_id, cl.doc_id, cl.chunk_index, "
        "len(list_filter(q.toks, lambda t: contains(cl.low, t)))::DOUBLE / len(q.toks) AS score "
        "FROM q, cl WHERE len(q.toks) > 0)",
        "rk AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, doc_id, chunk_index) AS rank FROM sc WHERE score > 0)",
        f"kw AS (SELECT question_id, rank::INTEGER AS rank, doc_id, chunk_index, score, round(1 - score, 6) AS distance FROM rk WHERE rank <= {k})",
    ]


def r3_keyword_topk() -> str:
    return _with(_keyword_topk(4), "SELECT question_id, rank, doc_id, chunk_index, distance FROM kw")


def _centroids_ctes() -> list[str]:
    return [
        "ex AS (SELECT label, unnest(range(len(embedding))) AS i, unnest(embedding) AS v FROM embeddings)",
        "cx AS (SELECT label, i, avg(v) AS v FROM ex GROUP BY label, i)",
        "cen AS (SELECT label, list(v ORDER BY i) AS centroid FROM cx GROUP BY label)",
    ]


def r4_vector_topk() -> str:
    return _with(
        [
            *_centroids_ctes(),
            f"sc AS (SELECT cen.label, e.vec_id, round(1 - {_cos('cen.centroid', 'e.embedding')}, 6) AS distance FROM cen, embeddings e)",
            "rk AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY distance, vec_id) AS rank FROM sc)",
        ],
        "SELECT label::BIGINT AS question_id, rank::INTEGER AS rank, vec_id, distance FROM rk WHERE rank <= 5",
    )


def r4_nearest_vectors() -> str:
    return _with(
        [
            f"sc AS (SELECT q.vec_id AS question_id, e.vec_id, round(1 - {_cos('q.embedding', 'e.embedding')}, 6) + 0.0 AS distance "
            "FROM embeddings q, embeddings e WHERE q.vec_id % 20 = 0)",
            "rk AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY distance, vec_id) AS rank FROM sc)",
        ],
        "SELECT question_id, rank::INTEGER AS rank, vec_id, distance FROM rk WHERE rank <= 5",
    )


def e2_hash_embed() -> str:
    ctes, v = _embed_ctes("benchmark", "item_id", "text", "e")
    return _with(ctes, f"SELECT item_id, unnest(range(len(vec)))::INTEGER AS dim, round(unnest(vec)::DOUBLE, 6) AS value FROM {v}")


def e1_embed_model() -> str:
    return e2_hash_embed()


def r2_keyword_score() -> str:
    return _with(_keyword_topk(4), "SELECT question_id, rank, round(score, 9) AS score FROM kw")


def e3_cosine() -> str:
    return _with(
        _centroids_ctes(),
        f"SELECT e.vec_id, round({_cos('e.embedding', 'cen.centroid')}, 6) AS cosine FROM embeddings e JOIN cen USING (label)",
    )


def e4_l2_normalize() -> str:
    return _with(
        [
            *_centroids_ctes(),
            "nn AS (SELECT label, centroid, sqrt(list_sum(list_transform(centroid, lambda x: x * x))) AS nrm FROM cen)",
            "vv AS (SELECT label, CASE WHEN nrm = 0 THEN list_transform(centroid, lambda x: x::FLOAT) "
            "ELSE list_transform(centroid, lambda x: (x / nrm)::FLOAT) END AS vec FROM nn)",
        ],
        "SELECT label, unnest(range(len(vec)))::INTEGER AS dim, round(unnest(vec)::DOUBLE, 6) AS value FROM vv",
    )



# ---- retrieval with hash embeddings ---------------------------------------------------------------


def _embedded_ctes() -> list[str]:
    c_ctes, cv = _embed_ctes("chunks", "doc_id, chunk_index, content, source, path", "content", "ce")
    q_ctes, qv = _embed_ctes("benchmark", "item_id, text", "text", "qe")
    return [
        *_default_chunks_ctes_meta(),
        *c_ctes,
        *q_ctes,
        f"vsc AS (SELECT q.item_id AS question_id, c.doc_id, c.chunk_index, c.content, c.source, c.path, c.vec AS cvec, q.vec AS qvec, q.text AS question, "
        f"round(1 - {_cos('q.vec', 'c.vec')}, 6) AS distance FROM {qv} q, {cv} c)",
        "vrk AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY distance, doc_id, chunk_index) AS rank FROM vsc)",
    ]


def _default_chunks_ctes_meta() -> list[str]:
    return [
        _docs_cte(),
        f"c AS (SELECT doc_id, {fixed('t', 800, 120)} AS chunks FROM d WHERE length(t) > 0)",
        f"ch0 AS ({explode_list('doc_id', 'chunks', 'c')})",
        "chunks AS (SELECT ch0.*, dd.source, 'table/' || CAST(ch0.doc_id AS VARCHAR) AS path FROM ch0 JOIN documents dd USING (doc_id))",
    ]


def _kw_score(q_toks: str, low: str) -> str:
    return f"(CASE WHEN len({q_toks}) > 0 THEN len(list_filter({q_toks}, lambda t: contains({low}, t)))::DOUBLE / len({q_toks}) ELSE 0.0 END)"


def _keyword_ranked(chunks: str, k: int, name: str, qsrc: str = "benchmark") -> list[str]:
    return [
        f"{name}l AS (SELECT *, lower(content) AS low FROM {chunks})",
        f"{name}q AS (SELECT item_id AS question_id, text AS question, {tokens('text')} AS toks FROM {qsrc})",
        f"{name}s AS (SELECT q.question_id, q.question, c.*, {_kw_score('q.toks', 'c.low')} AS score FROM {name}q q, {name}l c WHERE len(q.toks) > 0)",
        f"{name} AS (SELECT * EXCLUDE (low, rn), rn::INTEGER AS rank, round(1 - score, 6) AS distance FROM "
        f"(SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, doc_id, chunk_index) AS rn FROM {name}s WHERE score > 0) "
        f"WHERE rn <= {k})",
    ]


def r9_retrieve_vector() -> str:
    return _with(_embedded_ctes(), "SELECT question_id, rank::INTEGER AS rank, doc_id, chunk_index, distance FROM vrk WHERE rank <= 4")


def r6_rerank() -> str:
    return _with(
        [
            *_embedded_ctes(),
            f"cand AS (SELECT *, {_cos('qvec', 'cvec')} * 0.7 + {_kw_score(tokens('question'), 'lower(content)')} * 0.3 AS score FROM vrk WHERE rank <= 12)",
            "rr AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, rank) AS r2 FROM cand)",
        ],
        "SELECT question_id, r2::INTEGER AS rank, doc_id, chunk_index, round(1 - score, 6) AS distance FROM rr WHERE r2 <= 4",
    )


def _rrf_body(k: int = 4, rrf_k: int = 60) -> list[str]:
    return [
        "u AS (SELECT question_id, rank, doc_id, chunk_index, source, content, 0 AS lst FROM kw "
        "UNION ALL SELECT question_id, rank, doc_id, chunk_index, source, content, 1 AS lst FROM vrk WHERE rank <= 12)",
        f"g AS (SELECT question_id, source, content, sum(1.0 / ({rrf_k} + rank)) AS score, min(lst * 1000000 + rank) AS first, "
        "arg_min(doc_id, lst * 1000000 + rank) AS doc_id, arg_min(chunk_index, lst * 1000000 + rank) AS chunk_index FROM u "
        "GROUP BY question_id, source, content)",
        "fr AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY round(score, 12) DESC, first) AS r2 FROM g)",
    ]


def r7_rrf() -> str:
    return _with(
        [*_embedded_ctes(), *_keyword_ranked("chunks", 12, "kw"), *_rrf_body()],
        "SELECT question_id, r2::INTEGER AS rank, doc_id, chunk_index, round(1 - score, 6) AS distance FROM fr WHERE r2 <= 4",
    )


def _merge(groups: str, k: int) -> list[str]:
    return [
        f"md AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY question_id, source, content ORDER BY grp, rank) AS dn FROM {groups}) WHERE dn = 1)",
        "mk AS (SELECT *, coalesce(distance, 1 - score, 999.0) AS k1, CASE WHEN distance IS NOT NULL THEN -coalesce(score, 0.0) "
        "WHEN score IS NOT NULL THEN -score ELSE 0.0 END AS k2 FROM md)",
        f"mr AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY k1, k2, grp, rank) AS r2 FROM mk)",
    ]


def r8_merge_hits() -> str:
    return _with(
        [
            *_embedded_ctes(),
            *_keyword_ranked("chunks", 4, "kw"),
            "grp AS (SELECT question_id, rank, doc_id, chunk_index, source, content, distance, score, 0 AS grp FROM kw "
            "UNION ALL SELECT question_id, rank, doc_id, chunk_index, source, content, distance, NULL::DOUBLE AS score, 1 AS grp FROM vrk WHERE rank <= 4)",
            *_merge("grp", 4),
        ],
        "SELECT question_id, r2::INTEGER AS rank, doc_id, chunk_index, distance FROM mr WHERE r2 <= 4",
    )


def _recursive_chunks_ctes() -> list[str]:
    ctes, last = recursive_ctes("rs", "doc_id", "st", 300, 40, prefix="rl")
    return [
        "rs AS (SELECT doc_id, [[t]] AS st FROM d WHERE length(t) > 0)",
        *ctes,
        f"rch0 AS ({explode_list('doc_id', 'chunks', last)})",
        "rchunks AS (SELECT rch0.*, dd.source, 'table/' || CAST(rch0.doc_id AS VARCHAR) AS path FROM rch0 JOIN documents dd USING (doc_id))",
    ]


def c9_chunk_profiles() -> str:
    return _with(
        [*_default_chunks_ctes_meta(), *_recursive_chunks_ctes()],
        "SELECT format('kb-fixed-doc-{}-chunk-{}', doc_id, chunk_index) AS id, 'kb-fixed' AS kb_id, 'knowledge-fixed' AS collection_name, "
        "doc_id, chunk_index, content FROM chunks UNION ALL "
        "SELECT format('kb-recursive-doc-{}-chunk-{}', doc_id, chunk_index), 'kb-recursive', 'knowledge-recursive', doc_id, chunk_index, content FROM rchunks",
    )


def r10_retrieve_multi() -> str:
    return _with(
        [
            *_default_chunks_ctes_meta(), *_recursive_chunks_ctes(),
            *_keyword_ranked("chunks", 4, "ka"), *_keyword_ranked("rchunks", 4, "kb"),
            "grp AS (SELECT question_id, rank, doc_id, chunk_index, source, content, distance, score, 0 AS grp, 'kb-fixed' AS kb_id FROM ka "
            "UNION ALL SELECT question_id, rank, doc_id, chunk_index, source, content, distance, score, 1, 'kb-recursive' FROM kb)",
            *_merge("grp", 4),
        ],
        "SELECT question_id, r2::INTEGER AS rank, kb_id, doc_id, chunk_index, distance FROM mr WHERE r2 <= 4",
    )


# ---- prompts --------------------------------------------------------------------------------------

_SYSTEM = ("你是一个严谨的中文知识库问答助手。请优先依据检索到的上下文回答问题。"
           "如果上下文不足以支持结论，请明确说明不知道或信息不足，不要编造事实。")


def _blocks() -> list[str]:
    return [
        *_default_chunks_ctes_meta(),
        *_keyword_ranked("chunks", 4, "kw"),
        "bl AS (SELECT question_id, question, rank, source, content, '[片段 ' || rank || ']' || chr(10) || '来源: ' || source"
        " || CASE WHEN length(trim(path, " + WS + ")) > 0 AND trim(path, " + WS + ") <> source THEN chr(10) || '路径: ' || trim(path, " + WS + ") ELSE '' END"
        " || chr(10) || '内容: ' || content AS block FROM kw)",
        "pq AS (SELECT question_id, any_value(question) AS question, string_agg(block, chr(10) || chr(10) ORDER BY rank) AS ctx, "
        "count(*) AS context_count, list(source ORDER BY rank) AS srcs, arg_min(content, rank) AS first_content FROM bl GROUP BY question_id)",
    ]


def p1_format_context() -> str:
    return _with(_blocks(), "SELECT question_id, rank, block FROM bl")


def p2_build_prompts() -> str:
    user = ("'以下是检索到的知识库内容：' || chr(10) || ctx || chr(10) || chr(10) || '用户问题：' || question || chr(10) || chr(10) || "
            "'请用中文给出简洁准确的答案，并尽量结合上下文内容。'")
    return _with(_blocks(), f"SELECT question_id, '{_SYSTEM}' AS system, {user} AS user FROM pq")


def _refs_text() -> str:
    # distinct sources in order of first appearance
    return ("array_to_string(list_filter(srcs, lambda x, i: list_position(srcs, x) = i), chr(10))")


def p3_references() -> str:
    return _with(_blocks(), f"SELECT question_id, {_refs_text()} AS references_text, context_count::INTEGER AS context_count FROM pq")


def p5_answer() -> str:
    return _with(
        _blocks(),
        f"SELECT b.item_id AS question_id, coalesce({strip('pq.first_content')}, '') AS answer, coalesce({_refs_text()}, '') AS references_text, "
        "coalesce(pq.context_count, 0)::INTEGER AS context_count, "
        "CASE WHEN pq.question_id IS NULL THEN '当前向量库为空，请先建立索引。' ELSE '' END AS error "
        "FROM benchmark b LEFT JOIN pq ON pq.question_id = b.item_id",
    )


# ---- evaluation -----------------------------------------------------------------------------------


def _eval_ctes() -> list[str]:
    return [
        "cases AS (SELECT row_number() OVER (ORDER BY item_id) AS ord, printf('Q%03d', row_number() OVER (ORDER BY item_id)) AS id, item_id, text AS question, "
        "CASE WHEN length(text) < 200 THEN 'short' WHEN length(text) < 400 THEN 'medium' ELSE 'long' END AS category, "
        "list_slice(regexp_extract_all(lower(text), '[a-zA-Z0-9_]+'), 1, 3) AS kw FROM benchmark)",
        *_default_chunks_ctes_meta(),
        *_keyword_ranked("chunks", 4, "kh"),
        "ctx AS (SELECT question_id, string_agg(content || chr(10) || source || chr(10) || path, chr(10) ORDER BY rank) AS ctext, "
        "count(*) AS n, arg_min(content, rank) AS first_content, list(source ORDER BY rank) AS srcs FROM kh GROUP BY question_id)",
        "j AS (SELECT cs.*, coalesce(ctx.ctext, '') AS ctext, coalesce(ctx.n, 0) AS n, coalesce(" + strip("ctx.first_content") + ", '') AS answer, "
        "CASE WHEN ctx.question_id IS NULL THEN '当前向量库为空，请先建立索引。' ELSE '' END AS error "
        "FROM cases cs LEFT JOIN ctx ON ctx.question_id = cs.item_id)",
        "m AS (SELECT *, list_filter(kw, lambda k: contains(lower(ctext), lower(k))) AS rm, "
        "list_filter(kw, lambda k: contains(lower(answer), lower(k))) AS am, len(kw) AS total FROM j)",
        "res AS (SELECT ord, id, category, error, "
        "CASE WHEN error <> '' THEN false WHEN total <= 0 THEN true ELSE len(rm) >= greatest(1, floor(total * 0.5 + 0.999999)::INTEGER) END AS retrieval_hit, "
        "CASE WHEN error <> '' THEN 0.0 WHEN total <= 0 THEN 1.0 ELSE len(rm)::DOUBLE / total END AS retrieval_keyword_recall, "
        "CASE WHEN error <> '' THEN false WHEN total <= 0 THEN true ELSE len(am) >= greatest(1, floor(total * 0.5 + 0.999999)::INTEGER) END AS answer_hit, "
        "CASE WHEN error <> '' THEN 0.0 WHEN total <= 0 THEN 1.0 ELSE len(am)::DOUBLE / total END AS answer_keyword_accuracy, "
        "CASE WHEN error <> '' THEN '' ELSE array_to_string(rm, '|') END AS retrieval_matched, "
        "CASE WHEN error <> '' THEN '' ELSE array_to_string(am, '|') END AS answer_matched, "
        "CASE WHEN error <> '' THEN 0 ELSE n END::INTEGER AS context_count, 0 AS latency_ms FROM m)",
    ]


def v8_build_eval_cases() -> str:
    return _with(_eval_ctes()[:1], "SELECT ord::INTEGER AS ord, id, category, array_to_string(kw, '|') AS keywords FROM cases")


def v4_evaluate_cases() -> str:
    return _with(_eval_ctes(), "SELECT id, category, retrieval_hit, round(retrieval_keyword_recall, 6) AS retrieval_keyword_recall, "
                 "answer_hit, round(answer_keyword_accuracy, 6) AS answer_keyword_accuracy, retrieval_matched, answer_matched, context_count, error FROM res")


def v5_eval_summary() -> str:
    return _with(_eval_ctes(), (
        "SELECT count(*) AS total_cases, count(*) FILTER (WHERE error = '') AS successful_cases, count(*) FILTER (WHERE error <> '') AS failed_cases, "
        "round(coalesce(count(*) FILTER (WHERE error = '' AND retrieval_hit) / nullif(count(*) FILTER (WHERE error = ''), 0), 0.0), 6) AS retrieval_recall, "
        "round(coalesce(count(*) FILTER (WHERE error = '' AND answer_hit) / nullif(count(*) FILTER (WHERE error = ''), 0), 0.0), 6) AS answer_accuracy, "
        "round(coalesce(avg(retrieval_keyword_recall) FILTER (WHERE error = ''), 0.0), 6) AS avg_retrieval_keyword_recall, "
        "round(coalesce(avg(answer_keyword_accuracy) FILTER (WHERE error = ''), 0.0), 6) AS avg_answer_keyword_accuracy, "
        "round(coalesce(avg(latency_ms) FILTER (WHERE error = ''), 0.0), 6) AS avg_latency_ms FROM res"))


def v6_eval_by_category() -> str:
    return _with(_eval_ctes(), (
        "SELECT category, count(*) AS total, count(*) FILTER (WHERE retrieval_hit) AS retrieval_hit, count(*) FILTER (WHERE answer_hit) AS answer_hit, "
        "round(count(*) FILTER (WHERE retrieval_hit) / count(*), 6) AS retrieval_recall, round(count(*) FILTER (WHERE answer_hit) / count(*), 6) AS answer_accuracy "
        "FROM res WHERE error = '' GROUP BY category"))


def v7_eval_misses() -> str:
    return _with(_eval_ctes(), "SELECT ord::INTEGER AS ord, id, retrieval_hit, answer_hit, error FROM res "
                 "WHERE ord <= 10 AND (error <> '' OR NOT retrieval_hit OR NOT answer_hit)")


# ---- sources --------------------------------------------------------------------------------------


def s2_path_metadata() -> str:
    return (
        "WITH p0 AS (SELECT page_id, regexp_replace('/web/' || regexp_replace(url, '^[a-zA-Z]+://', ''), '/+', '/', 'g') AS p FROM pages), "
        "p1 AS (SELECT page_id, CASE WHEN p = '/' THEN p ELSE regexp_replace(p, '/$', '') END AS path FROM p0), "
        "p2 AS (SELECT page_id, path, regexp_extract(path, '([^/]*)$', 1) AS name, "
        "CASE WHEN starts_with(path, '/web/') THEN substring(path, 6) ELSE path END AS rel FROM p1), "
        "p3 AS (SELECT *, regexp_extract(name, '(?s)^.+(\\.[^./]+)$', 1) AS suf FROM p2) "
        "SELECT page_id, path, name AS file_name, CASE WHEN length(suf) > 0 THEN substring(name, 1, length(name) - length(suf)) ELSE name END AS file_stem, "
        "lower(suf) AS file_suffix, rel AS relative_path, "
        "CASE WHEN starts_with(rel, '/') AND regexp_extract(rel, '(?s)^(.*)/[^/]*$', 1) = '' THEN '/' ELSE regexp_extract(rel, '(?s)^(.*)/[^/]*$', 1) END AS parent_dir, "
        "'file' AS document_type FROM p3"
    )


def _html_text(x: str) -> str:
    for tag in ("script", "style", "template"):
        x = f"regexp_replace({x}, '(?is)<{tag}\\b.*?</{tag}\\s*>', chr(10), 'g')"
    x = f"regexp_replace({x}, '(?s)<!--.*?-->', chr(10), 'g')"
    x = f"regexp_replace({x}, '(?s)<![^>]*>', chr(10), 'g')"
    x = f"regexp_replace({x}, '(?s)</?[a-zA-Z][^>]*>', chr(10), 'g')"
    for name, ch in [("lt", "<"), ("gt", ">"), ("quot", '"'), ("nbsp", "\xa0"), ("copy", "©"), ("reg", "®"), ("middot", "·"), ("amp", "&")]:
        x = f"regexp_replace({x}, '&{name};?', {lit(ch)}, 'g')"
    lines = f"regexp_split_to_array({x}, '\\r\\n|[\\n\\r\\x0b\\x0c\\x1c\\x1d\\x1e\\x{{85}}\\x{{2028}}\\x{{2029}}]')"
    return f"array_to_string({nonblank(lines)}, chr(10))"


def s4_html_to_text() -> str:
    return f"SELECT page_id, {_html_text('html')} AS text FROM pages"


def s5_json_to_text() -> str:
    return "SELECT event_id, '{' || chr(10) || '  \"k\": ' || json_extract_string(props, '$.k') || chr(10) || '}' AS text FROM events"


def _csv_cell(c: str) -> str:
    return f"CASE WHEN regexp_matches({c}, '[\",\\r\\n]') THEN '\"' || replace({c}, '\"', '\"\"') || '\"' ELSE {c} END"


def s7_table_to_text() -> str:
    return ("SELECT c_nationkey, '工作表: ' || n_name || chr(10) || 'c_custkey,c_name,c_mktsegment' || chr(10) || "
            f"string_agg(CAST(c_custkey AS VARCHAR) || ',' || {_csv_cell('c_name')} || ',' || {_csv_cell('c_mktsegment')}, chr(10) ORDER BY c_custkey) AS content "
            "FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY c_nationkey, n_name")


def s7_workbooks() -> str:
    return _with(
        [
            "typed AS (SELECT *, bool_or(c_acctbal < 0) OVER (PARTITION BY c_nationkey, c_mktsegment) AS gaps FROM customer)",
            f"sheets AS (SELECT c_nationkey, c_mktsegment, '工作表: ' || c_mktsegment || chr(10) || 'id,name,balance,code,rich' || chr(10) || "
            f"string_agg(c_custkey || ',' || {_csv_cell('c_name')} || ',' || CASE WHEN c_acctbal < 0 THEN '' ELSE CAST(c_acctbal AS VARCHAR) END || ',' || "
            "CASE WHEN c_acctbal < 0 THEN '' WHEN gaps THEN c_nationkey || '.0' ELSE CAST(c_nationkey AS VARCHAR) END || ',' || "
            "CASE WHEN c_acctbal > 5000 THEN 'True' ELSE 'False' END, chr(10) ORDER BY c_custkey) AS sheet FROM typed GROUP BY c_nationkey, c_mktsegment)",
        ],
        f"SELECT c_nationkey, string_agg(sheet, {NL2} ORDER BY c_mktsegment) AS content FROM sheets GROUP BY c_nationkey",
    )


def s9_assemble_parts() -> str:
    return (f"SELECT conv_id, string_agg({strip('text')}, {NL2} ORDER BY turn) AS content FROM conversations "
            f"WHERE length({strip('text')}) > 0 GROUP BY conv_id")


def _table_doc(t: str, key: str, cols: list[str], ordv: int) -> str:
    rec = " || chr(10) || ".join(f"'{c}: ' || coalesce(CAST({c} AS VARCHAR), '')" for c in cols)
    return (
        f"SELECT {ordv}::BIGINT AS doc_ord, 'mysql_table:{t}' AS source, 'catalog://default/{t}' AS path, 'mysql_table' AS document_type, "
        f"{strip(chr(39) + 'MySQL 表: ' + t + chr(39) + f' || {NL2} || string_agg(sec, {NL2} ORDER BY i)')} AS content FROM "
        f"(SELECT i, {strip(chr(39) + '记录 ' + chr(39) + ' || i || chr(10) || ' + rec)} AS sec FROM "
        f"(SELECT *, row_number() OVER (ORDER BY {key}) AS i FROM (SELECT * FROM {t} ORDER BY {key} LIMIT 500)))"
    )


def s10_table_documents() -> str:
    record = "'记录 ' || i || chr(10) || 'c_mktsegment: ' || c_mktsegment || chr(10) || 'customers: ' || customers"
    query = (
        "SELECT 0::BIGINT AS doc_ord, 'mysql_query' AS source, 'catalog://default/query' AS path, 'mysql_query' AS document_type, "
        f"'MySQL 自定义查询结果' || {NL2} || string_agg({record}, {NL2} ORDER BY i) AS content FROM "
        "(SELECT *, row_number() OVER (ORDER BY c_mktsegment) AS i FROM (SELECT c_mktsegment, count(*) AS customers FROM customer GROUP BY c_mktsegment))"
    )
    return " UNION ALL ".join([query, _table_doc("supplier", "s_suppkey", ["s_suppkey", "s_name", "s_nationkey", "s_acctbal"], 1),
                               _table_doc("nation", "n_nationkey", ["n_nationkey", "n_name", "n_regionkey"], 2)])


def s11_preview_table() -> str:
    return "SELECT *, count(*) OVER () AS row_count FROM (SELECT * FROM supplier ORDER BY s_suppkey LIMIT 10)"


def s12_source_counts() -> str:
    return (
        f"WITH u AS (SELECT 'table_text' AS document_type FROM documents WHERE length({clean('text')}) > 0 "
        f"UNION ALL SELECT 'html' FROM pages WHERE length({clean(_html_text('html'))}) > 0) "
        "SELECT document_type, count(*) AS documents FROM u GROUP BY document_type UNION ALL SELECT 'total', count(*) FROM u"
    )


def s13_upsert() -> str:
    return _with(
        [*_default_chunks_ctes_meta(), *_recursive_chunks_ctes()],
        "SELECT c.doc_id, c.chunk_index, c.content FROM chunks c JOIN documents dd USING (doc_id) "
        "WHERE dd.lang IN ('en', 'fr') AND dd.lang NOT IN ('fr', 'de', 'es') "
        "UNION ALL SELECT r.doc_id, r.chunk_index, r.content FROM rchunks r JOIN documents dd USING (doc_id) WHERE dd.lang IN ('fr', 'de', 'es')",
    )


def _document_files_cte() -> str:
    lead = "CASE doc_id % 4 WHEN 1 THEN '_' WHEN 2 THEN '.' WHEN 3 THEN 'x' ELSE '' END"
    german = "coalesce(lang = 'de', false)"
    return ("files AS (SELECT doc_id, text, coalesce(lang, 'und') AS folder, "
            f"'k/' || coalesce(lang, 'und') || '/' || {lead} || 'd' || doc_id || CASE WHEN {german} THEN '.JSON' ELSE '.txt' END AS relative_path, "
            f"{german} AS german FROM documents)")


def s1_scan_files() -> str:
    size = """octet_length(encode(CASE WHEN german THEN '{"text":' || CAST(to_json(text) AS VARCHAR) || '}' ELSE coalesce(text, '') END))::BIGINT"""
    return _with([_document_files_cte()], f"SELECT relative_path, CASE WHEN german THEN '.json' ELSE '.txt' END AS file_suffix, {size} AS length, {size} AS bytes_read, '' AS error FROM files")


def s12_load_files() -> str:
    json_text = """'{' || chr(10) || '  "text": ' || CAST(to_json(text) AS VARCHAR) || chr(10) || '}'"""
    return _with(
        [_document_files_cte(), f"loaded AS (SELECT relative_path, 'k/' || folder AS parent_dir, CASE WHEN german THEN {json_text} ELSE {clean('text')} END AS content FROM files)"],
        "SELECT row_number() OVER (ORDER BY string_split(relative_path, '/')) - 1 AS doc_ord, relative_path, parent_dir, content FROM loaded WHERE length(content) > 0",
    )


def s14_ingest_stream() -> str:
    return _with(
        [_docs_cte("CASE WHEN lang = 'fr' THEN 'v2 ' || text ELSE text END"), *_default_chunks_ctes()[1:]],
        "SELECT doc_id, 'a/' || doc_id || '.md' AS relative_path, chunk_index, content FROM chunks",
    )


def s15_load_eval_cases() -> str:
    return _with(_eval_ctes()[:1], "SELECT ord::INTEGER AS ord, id, category, question, array_to_string(kw, '|') AS keywords FROM cases")


def s17_parse_stage_log() -> str:
    return ("SELECT CASE WHEN event_type = 'error' THEN 'API_STAGE_END' ELSE 'STAGE_END' END AS marker, event_type AS name, "
            "date_trunc('second', ts) AS started_at, date_trunc('second', ts) AS ended_at, CAST(printf('%.2f', value * 1000) AS DOUBLE) AS duration_ms FROM events")


def c7_split_sections() -> str:
    return _with(
        [*_customer_records_cte(), f"d AS (SELECT (c_nationkey * 1000 + part)::BIGINT AS doc_id, {clean('content')} AS t FROM recs)",
         f"s AS (SELECT doc_id, {sections('t')} AS secs FROM d)"],
        explode_list("doc_id", "secs", "s", "section_index", "section"),
    )


# ---- timing ---------------------------------------------------------------------------------------


def _stages_ctes() -> list[str]:
    return [
        "ev AS (SELECT user_id, event_id, ts, CASE WHEN event_type = 'view' THEN 'start' ELSE 'end' END AS kind FROM events WHERE event_type IN ('view', 'click'))",
        "lg AS (SELECT *, lag(kind) OVER w AS pk, lag(ts) OVER w AS pts FROM ev WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))",
        "st AS (SELECT user_id, event_id, pts AS started_at, ts AS ended_at, "
        "floor((epoch_us(ts) - epoch_us(pts) + 5) / 10) / 100.0 AS duration_ms FROM lg WHERE kind = 'end' AND pk = 'start')",
    ]


def t1_pair_stages() -> str:
    return _with(_stages_ctes(), "SELECT user_id, event_id, started_at, ended_at, duration_ms FROM st")


def t2_timing_summary() -> str:
    fmt = "regexp_replace(regexp_replace(printf('%.2f', duration_ms), '0+$', ''), '\\.$', '.0')"
    return _with(_stages_ctes(), (
        "SELECT user_id, round(sum(duration_ms), 2) AS total_ms, count(*) AS stages, "
        f"string_agg('session(' || {fmt} || 'ms)', ' -> ' ORDER BY ended_at, event_id) AS chain_text FROM st GROUP BY user_id"))

ORACLES = {
    "c2_split_fixed": c2_split_fixed,
    "c4_split_recursive": c4_split_recursive,
    "c3_apply_overlap": c3_apply_overlap,
    "c5_split_sentences": c5_split_sentences,
    "c6_split_semantic": c6_split_semantic,
    "s8_rows_to_text": s8_rows_to_text,
    "c8_split_structure": c8_split_structure,
    "c10_chunk_keys": c10_chunk_keys,
    "r1_tokenize": r1_tokenize,
    "r3_keyword_topk": r3_keyword_topk,
    "r3_term_tables": r3_keyword_topk,
    "r4_vector_topk": r4_vector_topk,
    "r4_grid_topk": r4_nearest_vectors,
    "r5_cell_topk": r4_nearest_vectors,
    "r5_cell_probe": r4_nearest_vectors,
    "e2_hash_embed": e2_hash_embed,
    "e1_embed_model": e1_embed_model,
    "r2_keyword_score": r2_keyword_score,
    "e3_cosine": e3_cosine,
    "e4_l2_normalize": e4_l2_normalize,
    "r9_retrieve_vector": r9_retrieve_vector,
    "r6_rerank": r6_rerank,
    "r7_rrf": r7_rrf,
    "r8_merge_hits": r8_merge_hits,
    "c9_chunk_profiles": c9_chunk_profiles,
    "r10_retrieve_multi": r10_retrieve_multi,
    "p1_format_context": p1_format_context,
    "p2_build_prompts": p2_build_prompts,
    "p3_references": p3_references,
    "p5_answer": p5_answer,
    "v8_build_eval_cases": v8_build_eval_cases,
    "v4_evaluate_cases": v4_evaluate_cases,
    "v5_eval_summary": v5_eval_summary,
    "v6_eval_by_category": v6_eval_by_category,
    "v7_eval_misses": v7_eval_misses,
    "s2_path_metadata": s2_path_metadata,
    "s4_html_to_text": s4_html_to_text,
    "s5_json_to_text": s5_json_to_text,
    "c6_user_model": c6_user_model,
    "c6_embed_once": c6_user_model,
    "s3_decode_text": s3_decode_text,
    "s6_xml_to_text": s6_xml_to_text,
    "s7_table_to_text": s7_table_to_text,
    "s7_workbooks": s7_workbooks,
    "s9_assemble_parts": s9_assemble_parts,
    "s10_table_documents": s10_table_documents,
    "s11_preview_table": s11_preview_table,
    "s12_source_counts": s12_source_counts,
    "s13_upsert": s13_upsert,
    "s1_scan_files": s1_scan_files,
    "s12_load_files": s12_load_files,
    "s13_write_read": s13_upsert,
    "s14_ingest_stream": s14_ingest_stream,
    "s15_load_eval_cases": s15_load_eval_cases,
    "s16_report_results": v4_evaluate_cases,
    "s16_report_summary": v5_eval_summary,
    "s17_parse_stage_log": s17_parse_stage_log,
    "c7_split_sections": c7_split_sections,
    "t1_pair_stages": t1_pair_stages,
    "t2_timing_summary": t2_timing_summary,
}
