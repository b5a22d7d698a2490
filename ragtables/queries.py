"""Registered queries over the driver's tables: each takes (spark, table_dir) and returns a DataFrame.

Column names match the DuckDB oracles in ``checks/oracles.py``.
"""

from __future__ import annotations

import uuid

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.chunkers import apply_overlap, sections, sentences
from .functions.text import clean_text
from .functions.tokens import keyword_score, tokenize
from .functions.vectors import cosine, hash_embed, l2_normalize
from .operators.cells import build_cells, cell_topk
from .operators.chunking import chunk_documents, chunk_profiles, with_chunk_keys
from .operators.embedding import embed, hash_embed_arrow, hash_model
from .operators.evaluation import build_eval_cases, eval_by_category, eval_misses, eval_summary, evaluate_cases
from .operators.keyword import read_keyword_tables, write_keyword_tables
from .operators.profiles import ChunkConfig, Profile, RetrievalConfig
from .operators.prompts import answer, build_prompts, format_context
from .operators.retrieval import keyword_topk, merge_hits, retrieve, retrieve_multi, vector_topk
from .operators.timing import pair_stages, timing_summary
from .plans.joins import join_small
from .plans.partitioning import spread
from .session import checkpoint_dir
from .sources.evalsets import load_eval_cases, read_eval_summary, write_eval_report
from .sources.files import base_path, decode_text, file_documents, scan_files, source_counts, with_path_metadata
from .sources.filesource import file_system, write_files
from .sources.index import read_index, upsert, write_index
from .sources.logs import parse_stage_log
from .sources.markup import html_to_text, json_to_text, xml_to_text
from .sources.sheets import workbook_texts
from .sources.tables import (assemble_parts, documents_from_table, load_table_documents, preview_table, rows_to_text,
                             table_to_text)
from .streaming.ingest import ingest_stream

DEFAULT = ChunkConfig("fixed", 800, 120)


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def documents(spark, d) -> DataFrame:
    return documents_from_table(spread(table(spark, d, "documents")))


def paragraph_documents(spark, d) -> DataFrame:
    """Documents whose line breaks are made paragraph breaks (the table has no blank lines)."""
    return documents_from_table(spread(table(spark, d, "documents")).withColumn("text", F.regexp_replace("text", "\n", "\n\n")))


def questions(spark, d) -> DataFrame:
    return table(spark, d, "benchmark").select(F.col("item_id").alias("question_id"), F.col("text").alias("question"))


def chunk_index(spark, d, config: ChunkConfig = DEFAULT) -> DataFrame:
    """C1 + C10 over the documents: the default collection."""
    return with_chunk_keys(chunk_documents(documents(spark, d), config), None, "knowledge")


def default_index(spark, d, config: ChunkConfig = DEFAULT) -> DataFrame:
    """The default collection, chunked once and kept (a deployment reads a stored index)."""
    return chunk_index(spark, d, config).persist(StorageLevel.MEMORY_AND_DISK)


def _chunks_out(df: DataFrame) -> DataFrame:
    return df.select("doc_id", "chunk_index", "content")


def c2_split_fixed(spark, d):
    return _chunks_out(chunk_documents(paragraph_documents(spark, d), ChunkConfig("fixed", 800, 120)))


def c4_split_recursive(spark, d):
    return _chunks_out(chunk_documents(documents(spark, d), ChunkConfig("recursive", 300, 40)))


def c5_split_sentences(spark, d):
    docs = documents(spark, d)
    return docs.select("doc_id", F.posexplode(sentences(F.col("content"))).alias("sentence_index", "sentence")).withColumn(
        "sentence_index", F.col("sentence_index").cast("int")
    )


def c3_apply_overlap(spark, d):
    """C3 on the sentence lists of the documents: each sentence gets the last 10 characters of the previous one."""
    docs = documents(spark, d)
    return docs.select("doc_id", F.posexplode(apply_overlap(sentences(F.col("content")), 10)).alias("chunk_index", "content")).withColumn(
        "chunk_index", F.col("chunk_index").cast("int"))


def c6_split_semantic(spark, d):
    return _chunks_out(chunk_documents(documents(spark, d), ChunkConfig("semantic", 300, 40, 0.3)))


def parity_model():
    """A model that tells even from odd text lengths."""
    return lambda texts: [[1.0, 0.0] if len(t) % 2 == 0 else [0.0, 1.0] for t in texts]


def c6_user_model(spark, d):
    """C6 with a model other than the default."""
    return _chunks_out(chunk_documents(documents(spark, d), ChunkConfig("semantic", 300, 40, 0.3), make_model=parity_model))


def c6_embed_once(spark, d):
    """C6 with that model, asked once for each distinct sentence."""
    return _chunks_out(chunk_documents(documents(spark, d), ChunkConfig("semantic", 300, 40, 0.3), make_model=parity_model, embed_once=True))


def customer_records(spark, d) -> DataFrame:
    """Customers rendered as record text, one document per nation and 50 records."""
    cust = table(spark, d, "customer")
    return rows_to_text(
        cust,
        columns=["c_custkey", "c_name", "c_acctbal", "c_mktsegment"],
        title="客户",
        order_by=["c_custkey"],
        group_by=["c_nationkey"],
        rows_per_doc=50,
    )


def s8_rows_to_text(spark, d):
    return customer_records(spark, d)


def c8_split_structure(spark, d):
    recs = customer_records(spark, d)
    docs = recs.select(
        (F.col("c_nationkey") * 1000 + F.col("part")).cast("long").alias("doc_id"), F.col("content")
    )
    return _chunks_out(chunk_documents(docs, ChunkConfig("structure", 300, 40)))


def c10_chunk_keys(spark, d):
    return default_index(spark, d).select("id", F.col("doc_ord").alias("doc_id"), "chunk_index", "collection_name")


def r1_tokenize(spark, d):
    b = table(spark, d, "benchmark")
    return b.select("item_id", F.posexplode(tokenize("text")).alias("pos", "token")).withColumn("pos", F.col("pos").cast("int"))


def r3_keyword_topk(spark, d):
    hits = keyword_topk(questions(spark, d), default_index(spark, d), 4)
    return hits.select("question_id", F.col("rank").cast("int").alias("rank"), F.col("doc_ord").alias("doc_id"), "chunk_index", "distance")


def r3_term_tables(spark, d):
    """R3 over stored term tables: the threshold algorithm."""
    index, path = default_index(spark, d), scratch(spark, "terms")
    write_keyword_tables(index, path)
    hits = keyword_topk(questions(spark, d), index, 4, read_keyword_tables(spark, path))
    return hits.select("question_id", F.col("rank").cast("int").alias("rank"), F.col("doc_ord").alias("doc_id"), "chunk_index", "distance")


def label_centroids(spark, d) -> DataFrame:
    """Mean vector per label: per-dimension averages (map-side partial aggregation), reassembled."""
    e = table(spark, d, "embeddings")
    per_dim = e.select("label", F.posexplode("embedding").alias("i", "v")).groupBy("label", "i").agg(F.avg("v").alias("v"))
    return per_dim.groupBy("label").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("i", "v"))), lambda s: s["v"]).alias("centroid")
    )


def embeddings_index(spark, d) -> DataFrame:
    e = table(spark, d, "embeddings")
    return e.select(
        F.lit("embeddings").alias("collection_name"),
        F.col("vec_id").alias("doc_ord"),
        F.lit(0).alias("chunk_index"),
        F.lit("").alias("content"),
        F.concat(F.lit("label-"), F.col("label").cast("string")).alias("source"),
        "embedding",
    )


def r4_vector_topk(spark, d):
    qs = label_centroids(spark, d).select(F.col("label").cast("long").alias("question_id"), F.col("centroid").alias("embedding"))
    hits = vector_topk(qs, embeddings_index(spark, d), 5)
    return hits.select("question_id", F.col("rank").cast("int").alias("rank"), F.col("doc_ord").alias("vec_id"), "distance")


def vector_questions(spark, d) -> DataFrame:
    """A stated query set: every vector whose id is divisible by 20."""
    return table(spark, d, "embeddings").filter("vec_id % 20 = 0").select(F.col("vec_id").alias("question_id"), "embedding")


def _vector_hits(hits: DataFrame) -> DataFrame:
    return hits.select("question_id", F.col("rank").cast("int").alias("rank"), F.col("doc_ord").alias("vec_id"), "distance")


def r4_grid_topk(spark, d):
    """R4 with both sides distributed: blocks of questions against blocks of the index."""
    return _vector_hits(vector_topk(vector_questions(spark, d), embeddings_index(spark, d), 5, plan="grid"))


def r5_cell_topk(spark, d):
    """R5, exact: cells ruled out by the triangle inequality."""
    return _vector_hits(cell_topk(vector_questions(spark, d), build_cells(embeddings_index(spark, d), 64), 5).hits)


def r5_cell_probe(spark, d):
    """R5 by probing: with as many probes as cells the result is that of R4."""
    return _vector_hits(cell_topk(vector_questions(spark, d), build_cells(embeddings_index(spark, d), 64), 5, nprobe=64).hits)


def e2_hash_embed(spark, d):
    b = table(spark, d, "benchmark")
    return b.select("item_id", F.posexplode(hash_embed("text")).alias("dim", "value")).select(
        "item_id", F.col("dim").cast("int").alias("dim"), F.round(F.col("value").cast("double"), 6).alias("value")
    )


def e1_embed_model(spark, d):
    """Benchmark texts through a model function in batches of 32 (offline hash model), L2-normalised."""
    b = embed(table(spark, d, "benchmark"), "text", lambda: hash_model(64), batch_size=32, normalize=True)
    return b.select("item_id", F.posexplode("embedding").alias("dim", "value")).select(
        "item_id", F.col("dim").cast("int").alias("dim"), F.round(F.col("value").cast("double"), 6).alias("value"))


def r2_keyword_score(spark, d):
    """R2 (native expression) on every keyword hit of the default collection."""
    qs = questions(spark, d)
    hits = keyword_topk(qs, default_index(spark, d), 4).join(qs, "question_id")
    return hits.select("question_id", F.col("rank").cast("int").alias("rank"),
                       F.round(keyword_score("question", "content"), 9).alias("score"))


def e3_cosine(spark, d):
    e = table(spark, d, "embeddings")
    c = label_centroids(spark, d)
    return join_small(e, c, "label").select("vec_id", F.round(cosine("embedding", "centroid"), 6).alias("cosine"))


def e4_l2_normalize(spark, d):
    c = label_centroids(spark, d)
    return c.select("label", F.posexplode(l2_normalize("centroid")).alias("dim", "value")).select(
        "label", F.col("dim").cast("int").alias("dim"), F.round(F.col("value").cast("double"), 6).alias("value")
    )




# ---- retrieval with hash embeddings (E2) over the default collection ----------------------------


def embedded_index(spark, d) -> DataFrame:
    return chunk_index(spark, d).withColumn("embedding", hash_embed_arrow("content")).persist(StorageLevel.MEMORY_AND_DISK)  # texts are kept once


def embedded_questions(spark, d) -> DataFrame:
    return questions(spark, d).withColumn("embedding", hash_embed_arrow("question"))


def _hits_out(h: DataFrame) -> DataFrame:
    return h.select("question_id", F.col("rank").cast("int").alias("rank"), F.col("doc_ord").alias("doc_id"), "chunk_index", "distance")


def r9_retrieve_vector(spark, d):
    return _hits_out(retrieve(embedded_questions(spark, d), embedded_index(spark, d), RetrievalConfig("vector", 4)))


def r6_rerank(spark, d):
    return _hits_out(retrieve(embedded_questions(spark, d), embedded_index(spark, d), RetrievalConfig("rerank", 4, 12)))


def r7_rrf(spark, d):
    return _hits_out(retrieve(embedded_questions(spark, d), embedded_index(spark, d), RetrievalConfig("rrf", 4, 12, 60)))


def r8_merge_hits(spark, d):
    qs, idx = embedded_questions(spark, d), embedded_index(spark, d)
    kw = retrieve(qs, idx, RetrievalConfig("keyword", 4)).withColumn("group_ord", F.lit(0))
    vc = retrieve(qs, idx, RetrievalConfig("vector", 4)).withColumn("group_ord", F.lit(1))
    return _hits_out(merge_hits(kw.unionByName(vc, allowMissingColumns=True), 4))


TWO_PROFILES = [
    Profile("kb-fixed", "fixed 切分库", "knowledge-fixed", ChunkConfig("fixed", 800, 120)),
    Profile("kb-recursive", "recursive 切分库", "knowledge-recursive", ChunkConfig("recursive", 300, 40)),
]


def c9_chunk_profiles(spark, d):
    idx = chunk_profiles(documents(spark, d), TWO_PROFILES)
    return idx.select("id", "kb_id", "collection_name", F.col("doc_ord").alias("doc_id"), "chunk_index", "content")


def r10_retrieve_multi(spark, d):
    # every text is kept twice, once per profile: on disk, as blocks in memory would fill the executors' heap
    idx = chunk_profiles(documents(spark, d), TWO_PROFILES).persist(StorageLevel.DISK_ONLY)
    h = retrieve_multi(questions(spark, d), idx, TWO_PROFILES, RetrievalConfig("keyword", 4, 12))
    return h.select("question_id", F.col("rank").cast("int").alias("rank"), "kb_id", F.col("doc_ord").alias("doc_id"),
                    "chunk_index", "distance")


# ---- prompts and answers ----------------------------------------------------------------------


def keyword_hits_default(spark, d) -> DataFrame:
    return keyword_topk(questions(spark, d), default_index(spark, d), 4)


def p1_format_context(spark, d):
    return format_context(keyword_hits_default(spark, d)).select("question_id", F.col("rank").cast("int").alias("rank"), "block")


def p2_build_prompts(spark, d):
    return build_prompts(questions(spark, d), keyword_hits_default(spark, d)).select("question_id", "system", "user")


def p3_references(spark, d):
    p = build_prompts(questions(spark, d), keyword_hits_default(spark, d))
    return p.select("question_id", F.array_join("references", "\n").alias("references_text"), "context_count")


def p5_answer(spark, d):
    a = answer(questions(spark, d), keyword_hits_default(spark, d))
    return a.select("question_id", "answer", F.array_join("references", "\n").alias("references_text"), "context_count", "error")


# ---- evaluation ---------------------------------------------------------------------------------


def eval_cases(spark, d) -> DataFrame:
    """V8: benchmark passages as cases: ids by item order, a length category, the first three word tokens."""
    b = table(spark, d, "benchmark")
    words = F.regexp_extract_all(F.lower("text"), F.lit("[a-zA-Z0-9_]+"), 0)
    t = b.select(
        "item_id",
        F.when(F.length("text") < 200, "short").when(F.length("text") < 400, "medium").otherwise("long").alias("category"),
        F.col("text").alias("question"), F.slice(words, 1, 3).alias("expected_keywords"),
    )
    return build_eval_cases(t, b.count(), ["item_id"]).withColumn("question_id", F.col("item_id"))


def eval_results(spark, d) -> DataFrame:
    cases = eval_cases(spark, d)
    qs = cases.select("question_id", "question")
    hits = keyword_topk(qs, default_index(spark, d), 4)
    return evaluate_cases(cases, answer(qs, hits), min_ratio=0.5)


def v8_build_eval_cases(spark, d):
    c = eval_cases(spark, d)
    return c.select(F.col("ord").cast("int").alias("ord"), "id", "category", F.array_join("expected_keywords", "|").alias("keywords"))


def _results_out(r: DataFrame) -> DataFrame:
    return r.select(
        "id", "category", "retrieval_hit", F.round("retrieval_keyword_recall", 6).alias("retrieval_keyword_recall"),
        "answer_hit", F.round("answer_keyword_accuracy", 6).alias("answer_keyword_accuracy"),
        F.array_join("retrieval_matched_keywords", "|").alias("retrieval_matched"),
        F.array_join("answer_matched_keywords", "|").alias("answer_matched"),
        F.col("context_count").cast("int").alias("context_count"), "error",
    )


def v4_evaluate_cases(spark, d):
    return _results_out(eval_results(spark, d))


SUMMARY_RATES = ["retrieval_recall", "answer_accuracy", "avg_retrieval_keyword_recall", "avg_answer_keyword_accuracy", "avg_latency_ms"]


def v5_eval_summary(spark, d):
    s = eval_summary(eval_results(spark, d))
    return s.select(
        "total_cases", "successful_cases", "failed_cases",
        *[F.round(c, 6).alias(c) for c in SUMMARY_RATES],
    )


def v6_eval_by_category(spark, d):
    s = eval_by_category(eval_results(spark, d))
    return s.select("category", "total", "retrieval_hit", "answer_hit",
                    F.round("retrieval_recall", 6).alias("retrieval_recall"), F.round("answer_accuracy", 6).alias("answer_accuracy"))


def v7_eval_misses(spark, d):
    return eval_misses(eval_results(spark, d), 10).select(F.col("ord").cast("int").alias("ord"), "id", "retrieval_hit", "answer_hit", "error")


# ---- sources ------------------------------------------------------------------------------------


def s2_path_metadata(spark, d):
    pages = table(spark, d, "pages").select("page_id", F.concat(F.lit("/web/"), F.regexp_replace("url", "^[a-zA-Z]+://", "")).alias("path"))
    m = with_path_metadata(pages, "/web")
    return m.select("page_id", "path", "file_name", "file_stem", "file_suffix", "relative_path", "parent_dir", "document_type")


def s3_decode_text(spark, d):
    """Every whole text three times as bytes and back: as UTF-8; its ASCII part after two GBK characters; as UTF-8 with a
    last byte that no encoding knows."""
    t = spread(table(spark, d, "documents"))
    gbk = F.concat(F.unhex(F.lit("D6D0CEC4")), F.encode(F.regexp_replace("text", "[^ -~]", ""), "UTF-8"))
    bad = F.concat(F.encode("text", "UTF-8"), F.unhex(F.lit("FF")))
    raw = t.select("doc_id", F.encode("text", "UTF-8").alias("utf8"), gbk.alias("gbk"), bad.alias("bad"))
    return raw.select("doc_id", *[decode_text(c).alias(c) for c in ("utf8", "gbk", "bad")])


def s4_html_to_text(spark, d):
    return spread(table(spark, d, "pages")).select("page_id", html_to_text("html").alias("text"))


def s5_json_to_text(spark, d):
    return table(spark, d, "events").select("event_id", json_to_text("props").alias("text"))


def s6_xml_to_text(spark, d):
    """XML built from the orders: nested elements, attributes and tail text (both left out)."""
    xml = F.concat(F.lit('<order id="'), F.col("o_orderkey").cast("string"), F.lit('"><status>'), "o_orderstatus", F.lit("</status>tail<customer> <key>"),
                   F.col("o_custkey").cast("string"), F.lit("</key> </customer><priority>"), "o_orderpriority", F.lit("</priority></order>"))
    return spread(table(spark, d, "orders")).select("o_orderkey", xml_to_text(xml).alias("text"))


def s7_table_to_text(spark, d):
    """One sheet of customers per nation."""
    nation = table(spark, d, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    c = join_small(table(spark, d, "customer"), nation, "c_nationkey")
    return table_to_text(c, columns=["c_custkey", "c_name", "c_mktsegment"], order_by=["c_custkey"], group_by=["c_nationkey"],
                         title_col="n_name").select("c_nationkey", "content")


def s7_workbooks(spark, d):
    """A workbook per nation, a sheet per market segment; cells as text, some missing."""
    low = F.col("c_acctbal") < 0
    cells = table(spark, d, "customer").select(
        "c_nationkey", "c_mktsegment", "c_custkey", F.lpad(F.col("c_custkey").cast("string"), 8, "0").alias("id"), F.col("c_name").alias("name"),
        F.when(low, "NA").otherwise(F.col("c_acctbal").cast("string")).alias("balance"), F.when(~low, F.col("c_nationkey").cast("string")).alias("code"),
        F.when(F.col("c_acctbal") > 5000, "TRUE").otherwise("false").alias("rich"))
    return workbook_texts(cells, columns=["id", "name", "balance", "code", "rich"], workbook=["c_nationkey"], sheet="c_mktsegment", order_by=["c_custkey"])


def s9_assemble_parts(spark, d):
    c = table(spark, d, "conversations")
    return assemble_parts(c, doc_key=["conv_id"], part_key="turn", text="text", kind="paragraphs")


def s10_table_documents(spark, d):
    """A custom query over the customers, and two tables."""
    for name in ("customer", "supplier", "nation"):
        table(spark, d, name).createOrReplaceTempView(name)
    docs = load_table_documents(spark, ["supplier", "nation"], query="SELECT c_mktsegment, count(*) AS customers FROM customer GROUP BY c_mktsegment",
                                order_by={"__query__": ["c_mktsegment"], "supplier": ["s_suppkey"], "nation": ["n_nationkey"]})
    return docs.select("doc_ord", "source", "path", "document_type", "content")


def s11_preview_table(spark, d):
    table(spark, d, "supplier").createOrReplaceTempView("supplier")
    return preview_table(spark, "supplier", 10, ["s_suppkey"]).withColumn("row_count", F.col("row_count").cast("long"))


def s12_source_counts(spark, d):
    docs = documents(spark, d).withColumn("document_type", F.lit("table_text"))
    pages = table(spark, d, "pages").select(
        F.col("page_id").alias("doc_id"), clean_text(html_to_text("html")).alias("content"), F.lit("html").alias("document_type")
    ).filter(F.length("content") > 0)
    return source_counts(docs.select("doc_id", "content", "document_type").unionByName(pages))


def s13_upsert(spark, d):
    docs = documents_from_table(spread(table(spark, d, "documents")), keep=["lang"])
    old = with_chunk_keys(chunk_documents(docs.filter(F.col("lang").isin("en", "fr")).drop("lang"), DEFAULT), None, "knowledge")
    new = with_chunk_keys(chunk_documents(docs.filter(F.col("lang").isin("fr", "de", "es")).drop("lang"),
                                          ChunkConfig("recursive", 300, 40)), None, "knowledge")
    return upsert(old, new).select(F.col("doc_ord").alias("doc_id"), "chunk_index", "content")


def scratch(spark, name: str) -> str:
    """A folder of its own in the shared checkpoint folder."""
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def document_files(spark, d) -> str:
    """The documents as one file each: folders by language, some names with a leading dot or underscore, JSON for the
    German ones."""
    t = table(spark, d, "documents")
    lead = F.element_at(F.array(*map(F.lit, ("", "_", ".", "x"))), (F.pmod("doc_id", F.lit(4)) + 1).cast("int"))
    german = F.coalesce(F.col("lang") == "de", F.lit(False))
    path = F.concat(F.lit("k/"), F.coalesce("lang", F.lit("und")), F.lit("/"), lead, F.lit("d"), F.col("doc_id").cast("string"), F.when(german, ".JSON").otherwise(".txt"))
    root = scratch(spark, "files")
    write_files(spread(t).select(path.alias("path"), F.when(german, F.to_json(F.struct("text"))).otherwise(F.col("text")).alias("content")), root)
    return root


def s1_scan_files(spark, d):
    """Listing and bytes of the documents' files, hidden names included."""
    root = document_files(spark, d)
    files = with_path_metadata(scan_files(spark, root), base_path(root))
    return files.select("relative_path", "file_suffix", "length", F.length("content").cast("long").alias("bytes_read"), F.coalesce("error", F.lit("")).alias("error"))


def s12_load_files(spark, d):
    """The documents' files as documents, numbered in path order."""
    return file_documents(spark, document_files(spark, d)).select("doc_ord", "relative_path", "parent_dir", "content")


def s13_write_read(spark, d):
    """The rows of ``s13_upsert`` through a stored index: written, upserted, read."""
    docs = documents_from_table(spread(table(spark, d, "documents")), keep=["lang"])
    first, second = docs.filter(F.col("lang").isin("en", "fr")).drop("lang"), docs.filter(F.col("lang").isin("fr", "de", "es")).drop("lang")
    path = scratch(spark, "index")
    write_index(with_chunk_keys(chunk_documents(first, DEFAULT), None, "knowledge"), path, buckets=16, counts=False, collections=["knowledge"])
    new = with_chunk_keys(chunk_documents(second, ChunkConfig("recursive", 300, 40)), None, "knowledge")
    write_index(new, path, mode="upsert", documents=second.select(F.lit("knowledge").alias("collection_name"), "doc_id"), counts=False)
    return read_index(spark, path, "knowledge").select(F.col("doc_ord").alias("doc_id"), "chunk_index", "content")


def s14_ingest_stream(spark, d):
    """Three triggers over a folder: added, changed and removed files; the index is that of the last state."""
    t = spread(table(spark, d, "documents"))
    root, lang, n = scratch(spark, "stream"), F.coalesce("lang", F.lit("und")), F.col("doc_id").cast("string")
    index, notes, config = f"{root}/index", f"{root}/checkpoint", DEFAULT
    put = lambda rows, folder, text: write_files(rows.select(F.concat(F.lit(folder), n, F.lit(".md")).alias("path"), text.alias("content")), f"{root}/k")
    put(t.filter(~lang.isin("de", "es")), "a/", F.col("text"))
    put(t.filter(lang == "es"), "old/", F.col("text"))
    ingest_stream(spark, f"{root}/k", index, notes, config=config)
    put(t.filter(lang == "fr"), "a/", F.concat(F.lit("v2 "), "text"))
    put(t.filter(lang.isin("de", "es")), "a/", F.col("text"))
    ingest_stream(spark, f"{root}/k", index, notes, config=config)
    system, base = file_system(f"{root}/k")
    system.create_dir(f"{base}/old")
    system.delete_dir(f"{base}/old")
    ingest_stream(spark, f"{root}/k", index, notes, config=config)
    return read_index(spark, index).select(F.regexp_extract("file_stem", "([0-9]+)$", 1).cast("long").alias("doc_id"), "relative_path", "chunk_index", "content")


def s15_load_eval_cases(spark, d):
    """The benchmark written as JSON lines in several files, and loaded in order."""
    path = f"{scratch(spark, 'cases')}.jsonl"
    c = eval_cases(spark, d).select("ord", F.to_json(F.struct("id", "category", "question", "expected_keywords", F.lit("").alias("reference"))).alias("value"))
    c.repartitionByRange(4, "ord").sortWithinPartitions("ord").select("value").write.text(path)
    cases, _ = load_eval_cases(spark, path)
    return cases.select(F.col("ord").cast("int").alias("ord"), "id", "category", "question", F.array_join("expected_keywords", "|").alias("keywords"))


def s16_report_results(spark, d):
    """Results of a written report."""
    return _results_out(write_eval_report(eval_results(spark, d), scratch(spark, "report")))


def s16_report_summary(spark, d):
    """Summary of a written report, observed while its results were written."""
    path = scratch(spark, "report")
    write_eval_report(eval_results(spark, d), path)
    s = read_eval_summary(spark, path)
    return s.select("total_cases", "successful_cases", "failed_cases", *[F.round(F.col(c).cast("double"), 6).alias(c) for c in SUMMARY_RATES])


def stage_log_lines(spark, d) -> DataFrame:
    e = table(spark, d, "events")
    t = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")
    line = F.concat_ws(
        " | ", F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), F.lit("INFO"), F.lit("ragtables"),
        F.when(F.col("event_type") == "error", "API_STAGE_END").otherwise("STAGE_END"), F.col("event_type"),
        F.concat(F.lit("started_at="), t), F.concat(F.lit("ended_at="), t),
        F.concat(F.lit("duration_ms="), F.format_string("%.2f", F.col("value") * 1000)),
    )
    return e.select(line.alias("value"))


def s17_parse_stage_log(spark, d):
    return parse_stage_log(stage_log_lines(spark, d)).select("marker", "name", "started_at", "ended_at", "duration_ms")


def c7_split_sections(spark, d):
    recs = customer_records(spark, d)
    docs = recs.select((F.col("c_nationkey") * 1000 + F.col("part")).cast("long").alias("doc_id"), clean_text("content").alias("t"))
    return docs.select("doc_id", F.posexplode(sections("t")).alias("section_index", "section")).withColumn(
        "section_index", F.col("section_index").cast("int"))


# ---- timing ---------------------------------------------------------------------------------------


def session_stages(spark, d) -> DataFrame:
    e = table(spark, d, "events").filter(F.col("event_type").isin("view", "click"))
    e = e.select("user_id", F.lit("session").alias("stage"), F.when(F.col("event_type") == "view", "start").otherwise("end").alias("kind"),
                 "ts", "event_id")
    return pair_stages(e, request="user_id", stage="stage", kind="kind", ts="ts", order="event_id")


def t1_pair_stages(spark, d):
    return session_stages(spark, d).select("user_id", "event_id", "started_at", "ended_at", "duration_ms")


def t2_timing_summary(spark, d):
    return timing_summary(session_stages(spark, d), request="user_id", end_order=["ended_at", "event_id"])


QUERIES = {
    "c2_split_fixed": c2_split_fixed,
    "c4_split_recursive": c4_split_recursive,
    "c3_apply_overlap": c3_apply_overlap,
    "c5_split_sentences": c5_split_sentences,
    "c6_split_semantic": c6_split_semantic,
    "c6_user_model": c6_user_model,
    "c6_embed_once": c6_embed_once,
    "s3_decode_text": s3_decode_text,
    "s6_xml_to_text": s6_xml_to_text,
    "s8_rows_to_text": s8_rows_to_text,
    "c8_split_structure": c8_split_structure,
    "c10_chunk_keys": c10_chunk_keys,
    "r1_tokenize": r1_tokenize,
    "r3_keyword_topk": r3_keyword_topk,
    "r3_term_tables": r3_term_tables,
    "r4_vector_topk": r4_vector_topk,
    "r4_grid_topk": r4_grid_topk,
    "r5_cell_topk": r5_cell_topk,
    "r5_cell_probe": r5_cell_probe,
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
    "s7_table_to_text": s7_table_to_text,
    "s7_workbooks": s7_workbooks,
    "s9_assemble_parts": s9_assemble_parts,
    "s10_table_documents": s10_table_documents,
    "s11_preview_table": s11_preview_table,
    "s12_source_counts": s12_source_counts,
    "s13_upsert": s13_upsert,
    "s1_scan_files": s1_scan_files,
    "s12_load_files": s12_load_files,
    "s13_write_read": s13_write_read,
    "s14_ingest_stream": s14_ingest_stream,
    "s15_load_eval_cases": s15_load_eval_cases,
    "s16_report_results": s16_report_results,
    "s16_report_summary": s16_report_summary,
    "s17_parse_stage_log": s17_parse_stage_log,
    "c7_split_sections": c7_split_sections,
    "t1_pair_stages": t1_pair_stages,
    "t2_timing_summary": t2_timing_summary,
}
