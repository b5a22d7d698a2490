"""Sources and sinks: files, markup, tables, index, evaluation sets, logs, streaming."""

import json
import os
import tempfile
import uuid

import pytest
from pyspark.sql import functions as F

from ragtables.sources.evalsets import load_eval_cases, write_eval_summary
from ragtables.sources.files import decode_text, file_documents, scan_files, with_path_metadata
from ragtables.sources.index import build_index, read_index, upsert, write_index
from ragtables.sources.logs import parse_stage_log
from ragtables.sources.markup import html_to_text, json_to_text, xml_to_text
from ragtables.sources.tables import (assemble_parts, load_table_documents, preview_table, rows_to_text, safe_identifier,
                                      table_to_text)


def _tree(tmp):
    os.makedirs(os.path.join(tmp, "sop"))
    files = {
        "sop/guide.md": "# Guide\n\nstep one".encode(),
        "intro.MD": "﻿BOM text".encode("utf-8"),
        "gbk.txt": "向量数据库".encode("gbk"),
        "bad.txt": b"ok \xff\xfe end",
        "page.html": b"<html><head><title>T</title><script>var a='</p>';</script></head><body><p>A &amp B</p><!-- c --></body></html>",
        "data.json": '{"b": 1, "a": "中"}'.encode(),
        "tree.xml": b"<root a='1'><x>t1</x><y><z>deep</z></y>tail</root>",
        "image.png": b"\x89PNG",
        "empty.txt": b"   ",
        "a.b.txt": b"two dots",
    }
    for name, data in files.items():
        with open(os.path.join(tmp, name), "wb") as f:
            f.write(data)


def test_scan_and_file_documents(spark):
    tmp = tempfile.mkdtemp(prefix="rt-files-")
    _tree(tmp)
    paths = [r.path for r in scan_files(spark, tmp).collect()]
    assert not any(p.endswith(".png") for p in paths) and any(p.endswith("intro.MD") for p in paths)
    assert scan_files(spark, os.path.join(tmp, "missing")).count() == 0
    docs = {r.relative_path: r for r in file_documents(spark, tmp).collect()}
    assert docs["sop/guide.md"].parent_dir == "sop" and docs["sop/guide.md"].file_suffix == ".md"
    assert docs["intro.MD"].file_suffix == ".md" and docs["intro.MD"].content.startswith("﻿")
    assert docs["gbk.txt"].content == "向量数据库"
    assert docs["bad.txt"].content == "ok  end"
    assert docs["page.html"].content == "T\nA & B"
    assert docs["data.json"].content == '{\n  "b": 1,\n  "a": "中"\n}'
    assert docs["tree.xml"].content == "<root>\n  <x>\n  t1\n  <y>\n    <z>\n    deep"
    assert docs["a.b.txt"].file_stem == "a.b" and "empty.txt" not in docs
    assert sorted(r.doc_ord for r in docs.values()) == list(range(len(docs)))


def test_path_metadata(spark):
    df = spark.createDataFrame([("/k/sop/guide.md",), ("/k/.bashrc",), ("/k/a.tar.gz",), ("/other/x.TXT",), ("/k//n/",)], "path string")
    r = {x.path: x for x in with_path_metadata(df, "/k").collect()}
    assert (r["/k/sop/guide.md"].relative_path, r["/k/sop/guide.md"].parent_dir) == ("sop/guide.md", "sop")
    assert (r["/k/.bashrc"].file_suffix, r["/k/.bashrc"].file_stem) == ("", ".bashrc")
    assert (r["/k/a.tar.gz"].file_suffix, r["/k/a.tar.gz"].file_stem) == (".gz", "a.tar")
    assert (r["/other/x.TXT"].relative_path, r["/other/x.TXT"].parent_dir, r["/other/x.TXT"].file_suffix) == ("/other/x.TXT", "/other", ".txt")
    assert r["/k/n"].relative_path == "n" and r["/k/n"].parent_dir == ""


def test_markup(spark):
    df = spark.createDataFrame([("<p>a &copy b &middot; c &quot;d&quot; &am x</p><style>p{}</style><template>t</template>",)], "h string")
    assert df.select(html_to_text("h").alias("t")).collect()[0].t == 'a © b · c "d" &am x'
    j = spark.createDataFrame([('{"k": [1, {"z": null}]}',)], "s string").select(json_to_text("s").alias("t")).collect()[0].t
    assert j == json.dumps({"k": [1, {"z": None}]}, indent=2, ensure_ascii=False)
    x = spark.createDataFrame([("<a><b>1</b></a>",)], "s string").select(xml_to_text("s").alias("t")).collect()[0].t
    assert x == "<a>\n  <b>\n  1"
    d = spark.createDataFrame([(bytearray("中".encode("gb18030")),)], "b binary").select(decode_text("b").alias("t")).collect()[0].t
    assert d == "中"


def test_tables(spark):
    df = spark.createDataFrame([(1, "a,b", None), (2, 'q"x', 3.5)], "id int, name string, v double")
    csv = table_to_text(df, columns=["id", "name", "v"], order_by=["id"]).collect()[0].content
    assert csv == 'id,name,v\n1,"a,b",\n2,"q""x",3.5'
    rec = rows_to_text(df, columns=["id", "name", "v"], title="T", order_by=["id"]).collect()[0].content
    assert rec == 'T\n\n记录 1\nid: 1\nname: a,b\nv:\n\n记录 2\nid: 2\nname: q"x\nv: 3.5'
    parts = spark.createDataFrame([(1, 2, 0, " s2 "), (1, 1, 1, "b"), (1, 1, 0, "a"), (1, 3, 0, "  ")], "d int, slide int, shape int, t string")
    sl = assemble_parts(parts, doc_key=["d"], part_key="slide", text="t", kind="slides", sub_key="shape").collect()[0].content
    assert sl == "幻灯片 1\na\nb\n\n幻灯片 2\ns2"
    df.createOrReplaceTempView("t_small")
    docs = load_table_documents(spark, ["t_small"], query="SELECT id FROM t_small", order_by={"t_small": ["id"], "__query__": ["id"]}, limit=1)
    rows = docs.orderBy("doc_ord").collect()
    assert [r.source for r in rows] == ["mysql_query", "mysql_table:t_small"]
    assert rows[1].content == "MySQL 表: t_small\n\n记录 1\nid: 1\nname: a,b\nv:"
    with pytest.raises(ValueError):
        safe_identifier("t; drop")
    assert preview_table(spark, "t_small", 1, ["id"]).collect()[0].row_count == 1


def test_html_cases(spark):
    cases = [
        ("caf&eacute; &#39;x&#39; &hellip; &euro;5 &#x41;", "café 'x' … €5 A"),
        ("&copysr; &ltimes; a &amp;lt; b", "℗ ⋉ a &lt; b"),
        ('<a title="a>b">hi</a><p>there', "hi\nthere"),
        ("<!-- <script> -->KEEP<script>no</script> end", "KEEP\nend"),
        ("<style>p{}</style><template>t<b>u</b></template>x", "x"),
        ("", ""),
    ]
    df = spark.createDataFrame([(i, h) for i, (h, _) in enumerate(cases)] + [(99, None)], "id int, h string")
    got = {r.id: r.t for r in df.select("id", html_to_text("h").alias("t")).collect()}
    assert got == {i: t for i, (_, t) in enumerate(cases)} | {99: None}


def test_csv_parts_and_skipped_files(spark):
    from ragtables.sources.files import skipped_files

    tmp = tempfile.mkdtemp(prefix="rt-mixed-")
    for name, data in {"a.csv": "id,名\n1,x\n2,\n".encode("gbk"), "b.txt": b"text", "_n.txt": b"x", ".h.txt": b"x", "c.pdf": b"%PDF", "e.csv": b""}.items():
        with open(os.path.join(tmp, name), "wb") as f:
            f.write(data)
    parts = spark.createDataFrame([(f"{tmp}/c.pdf", 2, "page two"), (f"{tmp}/c.pdf", 1, "page one")], "path string, part int, text string")
    docs = {r.relative_path: r.content for r in file_documents(spark, tmp, parts).collect()}
    assert docs == {"a.csv": "id,名\n1,x\n2,", "b.txt": "text", "_n.txt": "x", ".h.txt": "x", "c.pdf": "page one\npage two"}
    assert [os.path.basename(r.path) for r in skipped_files(spark, tmp).collect()] == ["c.pdf"]


def test_parts_are_joined_by_their_format(spark):
    tmp = tempfile.mkdtemp(prefix="rt-parts-")
    rows = [("c.pdf", 2, 0, "two"), ("c.pdf", 1, 0, "one"), ("w.docx", 1, 0, "a"), ("w.docx", 2, 0, " "), ("w.docx", 3, 0, "b"),
            ("s.PPTX", 1, 1, "right"), ("s.PPTX", 1, 0, "left"), ("s.PPTX", 3, 0, "third"), ("s.PPTX", 2, 0, ""), ("t.xlsx", 1, 0, "工作表: A\nx"), ("t.xlsx", 2, 0, "工作表: B\ny")]
    parts = spark.createDataFrame([(f"{tmp}/{n}", p, s, t) for n, p, s, t in rows], "path string, part int, sub int, text string")
    docs = {r.relative_path: r.content for r in file_documents(spark, tmp, parts).collect()}
    assert docs == {"c.pdf": "one\ntwo", "w.docx": "a\n\nb", "s.PPTX": "幻灯片 1\nleft\nright\n\n幻灯片 3\nthird", "t.xlsx": "工作表: A\nx\n\n工作表: B\ny"}


def test_unreadable_and_unparsable_files_are_rows(spark, monkeypatch):
    from ragtables.sources.files import failed_files

    tmp = tempfile.mkdtemp(prefix="rt-broken-")
    for name, data in {"good.json": b'{"a": 1}', "bad.json": b"{", "bad.xml": b"<a>", "ok.txt": b"text"}.items():
        with open(os.path.join(tmp, name), "wb") as f:
            f.write(data)
    os.symlink(os.path.join(tmp, "nowhere.txt"), os.path.join(tmp, "dangling.txt"))
    assert sorted(r.relative_path for r in file_documents(spark, tmp).collect()) == ["good.json", "ok.txt"]
    errors = {os.path.basename(r.path): r.error for r in failed_files(spark, tmp).collect()}
    assert set(errors) - {"dangling.txt"} == {"bad.json", "bad.xml"} and all(errors.values())


def test_files_are_packed_by_bytes_in_path_order(spark):
    from ragtables.sources.filesource import packed, read_files, write_files

    tmp = tempfile.mkdtemp(prefix="rt-packed-")
    rows = spark.range(300).selectExpr("concat('d', id % 7, '/', if(id % 3 = 0, '.', if(id % 3 = 1, '_', 'f')), id, '.txt') path", "repeat('x', cast(id as int)) content")
    assert write_files(rows, tmp) == 300
    got = read_files(spark, tmp, (".txt",), partition_bytes=2000)
    assert got.rdd.getNumPartitions() > 20
    rows = got.collect()
    assert len(rows) == 300 and all(len(r.content) == r.length and r.error is None for r in rows)
    assert [r.path for r in rows] == sorted((r.path for r in rows), key=lambda p: p.split("/"))
    assert read_files(spark, tmp, (".md",)).count() == 0 and read_files(spark, tmp, content=False).filter("content is not null").count() == 0
    from ragtables.sources.filesource import listed

    parts = packed(listed(tmp, ()), 5000)
    assert all(sum(f.length for f in p.files) <= 5000 for p in parts) and sum(len(p.files) for p in parts) == 300


def test_index_write_upsert(spark):
    path = tempfile.mkdtemp(prefix="rt-index-") + "/idx"
    mk = lambda rows: spark.createDataFrame(rows, "collection_name string, doc_id string, chunk_index int, content string")
    stats = write_index(mk([("c1", "a", 0, "a0"), ("c1", "a", 1, "a1"), ("c1", "b", 0, "b0"), ("c2", "z", 0, "z0")]), path)
    assert stats["c1"] == {"documents": 2, "chunks": 3}
    write_index(mk([("c1", "a", 0, "A0"), ("c1", "n", 0, "n0")]), path, mode="upsert")
    c1 = sorted((r.doc_id, r.chunk_index, r.content) for r in read_index(spark, path, "c1").collect())
    assert c1 == [("a", 0, "A0"), ("b", 0, "b0"), ("n", 0, "n0")]
    assert read_index(spark, path, "c2").count() == 1
    write_index(mk([("c1", "q", 0, "q0")]), path, mode="replace")
    assert [r.doc_id for r in read_index(spark, path, "c1").collect()] == ["q"] and read_index(spark, path, "c2").count() == 1
    with pytest.raises(ValueError):
        write_index(mk([]), path)
    old, new = mk([("c", "a", 0, "x"), ("c", "a", 1, "y")]), mk([("c", "a", 0, "z")])
    assert [r.content for r in upsert(old, new).collect()] == ["z"]


def _files(path):
    return [f for _, _, names in os.walk(path) for f in names if f.startswith("part-")]


def test_index_is_clustered_keeps_buckets_and_drops_emptied_documents(spark):
    path = tempfile.mkdtemp(prefix="rt-index-") + "/idx"
    rows = spark.range(2000).selectExpr("'c' collection_name", "cast(id % 400 as string) doc_id", "cast(id as int) chunk_index", "concat('t', id) content").repartition(8)
    write_index(rows, path, buckets=5)
    assert len(_files(path)) == 5  # one file for each bucket, not one for each task and bucket
    from ragtables.sources.index import index_buckets

    assert index_buckets(spark, path) == 5
    new = spark.createDataFrame([("c", "7", 0, "new")], "collection_name string, doc_id string, chunk_index int, content string")
    gone = spark.createDataFrame([("c", "7"), ("c", "8")], "collection_name string, doc_id string")
    assert write_index(new, path, mode="upsert", buckets=99, documents=gone)["c"] == {"documents": 399, "chunks": 2000 - 10 + 1}
    assert read_index(spark, path, "c").filter("doc_id = '7'").first().content == "new"
    assert write_index(new.limit(0), path, mode="upsert", documents=gone.filter("doc_id = '7'"))["c"]["documents"] == 398
    assert not [n for n in os.listdir(os.path.dirname(path)) if "_stage" in n]


def test_an_index_that_cannot_be_read_is_an_error(spark):
    path = tempfile.mkdtemp(prefix="rt-index-") + "/idx"
    mk = lambda rows: spark.createDataFrame(rows, "collection_name string, doc_id string, chunk_index int, content string")
    write_index(mk([("c", "a", 0, "a"), ("c", "b", 0, "b")]), path, buckets=1)
    part = [os.path.join(d, n) for d, _, names in os.walk(path) for n in names if n.startswith("part-")][0]
    with open(part, "wb") as f:
        f.write(b"broken")
    with pytest.raises(Exception):
        write_index(mk([("c", "a", 0, "new")]), path, mode="upsert")
    assert os.path.exists(part)


def test_a_failed_write_leaves_the_old_rows(spark):
    path = tempfile.mkdtemp(prefix="rt-index-") + "/idx"
    mk = lambda rows: spark.createDataFrame(rows, "collection_name string, doc_id string, chunk_index int, content string")
    old = [("c", f"d{i}", 0, f"old {i}") for i in range(50)]
    write_index(mk(old), path, buckets=4)
    broken = mk([("c", f"d{i}", 0, "new") for i in range(50)]).withColumn("content", F.when(F.col("doc_id") == "d49", F.raise_error(F.lit("lost"))).otherwise(F.col("content")))
    for mode in ("replace", "upsert"):
        with pytest.raises(Exception, match="lost"):
            write_index(broken, path, mode=mode, documents=mk(old).select("collection_name", "doc_id"), collections=["c"])
        spark.catalog.refreshByPath(path)
        assert sorted(r.content for r in read_index(spark, path).collect()) == sorted(r[3] for r in old)


def test_replaced_collections_lose_their_old_buckets(spark):
    path = tempfile.mkdtemp(prefix="rt-index-") + "/idx"
    mk = lambda rows: spark.createDataFrame(rows, "collection_name string, doc_id string, chunk_index int, content string")
    write_index(mk([(c, f"d{i}", 0, "old") for i in range(60) for c in ("a", "b")]), path, buckets=8)
    assert write_index(mk([("a", "d1", 0, "new")]), path) == {"a": {"documents": 1, "chunks": 1}, "b": {"documents": 60, "chunks": 60}}
    assert [(r.doc_id, r.content) for r in read_index(spark, path, "a").collect()] == [("d1", "new")]


def test_changed_emptied_and_removed_files(spark):
    from ragtables.operators.profiles import ChunkConfig
    from ragtables.streaming.ingest import ingest_stream

    base = tempfile.mkdtemp(prefix="rt-change-")
    kdir, idx, ck = os.path.join(base, "k"), os.path.join(base, "idx"), os.path.join(base, "ck")
    os.makedirs(kdir)

    def put(name, text, at):
        with open(os.path.join(kdir, name), "w") as f:
            f.write(text)
        os.utime(os.path.join(kdir, name), (at, at))

    for name in ("a.md", "b.md", "c.md", "d.md"):
        put(name, f"old {name}", 1_700_000_000)
    ingest_stream(spark, kdir, idx, ck, config=ChunkConfig("fixed", 50, 0))
    put("a.md", "new text", 1_700_000_100)
    put("b.md", "  ", 1_700_000_100)
    os.remove(os.path.join(kdir, "c.md"))
    ingest_stream(spark, kdir, idx, ck, config=ChunkConfig("fixed", 50, 0))
    spark.catalog.refreshByPath(idx)
    assert sorted(r.content for r in read_index(spark, idx).collect()) == ["new text", "old d.md"]


def test_eval_sets_and_report(spark):
    tmp = tempfile.mkdtemp(prefix="rt-eval-")
    cases = [{"id": f"Q{i}", "category": "c", "question": f"q{i}", "expected_keywords": ["k"], "reference": "r"} for i in range(3)]
    with open(os.path.join(tmp, "set.json"), "w") as f:
        json.dump({"meta": {"name": "x", "n": {"a": [1, True]}}, "cases": cases}, f)
    with open(os.path.join(tmp, "set.jsonl"), "w") as f:
        f.write("\n".join(json.dumps(c) for c in cases) + "\n\t\n\n")
    c1, m1 = load_eval_cases(spark, os.path.join(tmp, "set.json"), limit=2)
    assert [r.id for r in c1.orderBy("ord").collect()] == ["Q0", "Q1"] and json.loads(m1.collect()[0].meta) == {"name": "x", "n": {"a": [1, True]}}
    c2, m2 = load_eval_cases(spark, os.path.join(tmp, "set.jsonl"))
    assert c2.count() == 3 and json.loads(m2.collect()[0].meta) == {"format": "jsonl", "case_count": 3}
    summary = spark.createDataFrame([(3, 1.0)], "total_cases int, retrieval_recall double")
    write_eval_summary(summary, summary, os.path.join(tmp, "report"), "set.jsonl", m1.collect()[0].meta)
    head = json.loads(spark.read.text(os.path.join(tmp, "report", "summary")).first().value)
    assert head["meta"] == {"name": "x", "n": {"a": [1, True]}} and head["summary"] == {"total_cases": 3, "retrieval_recall": 1.0}
    assert head["cases_path"] == "set.jsonl" and head["generated_at"][-1] == "Z" or "+" in head["generated_at"]
    from ragtables.sources.evalsets import list_eval_datasets

    assert [(r.name, r.format) for r in list_eval_datasets(spark, tmp).collect()] == [("set.json", "json"), ("set.jsonl", "jsonl")]
    assert list_eval_datasets(spark, tmp + "/none").count() == 0


def test_lines_of_several_files_keep_their_order(spark):
    path = tempfile.mkdtemp(prefix="rt-lines-") + "/set.jsonl"
    rows = [(i, json.dumps({"id": f"Q{i}", "category": "c", "question": "x" * (5000 if i > 60 else 5), "expected_keywords": [], "reference": ""})) for i in range(90)]
    spark.createDataFrame(rows, "i int, value string").repartitionByRange(6, "i").sortWithinPartitions("i").select("value").write.text(path)
    cases, meta = load_eval_cases(spark, path, limit=70)
    assert [r.id for r in cases.orderBy("ord").collect()] == [f"Q{i}" for i in range(70)]
    assert json.loads(meta.first().meta)["case_count"] == 90


def test_stage_log(spark):
    lines = spark.createDataFrame(
        [("2024-01-01 00:00:00,1 | INFO | easy | STAGE_END | vector_retrieve | started_at=2024-01-01T00:00:00 | ended_at=2024-01-01T00:00:01 | duration_ms=12.5",),
         ("2024-01-01 00:00:00,1 | INFO | api | API_STAGE_END | request | started_at=2024-01-01T00:00:00 | ended_at=2024-01-01T00:00:02 | duration_ms=20.0",),
         ("2024 | INFO | api | STAGE_END | broken | started_at=bad | ended_at=2024-01-01T00:00:02 | duration_ms=1e",),
         ("2024-01-01 | INFO | x | STAGE_START | vector_retrieve | started_at=2024-01-01T00:00:00",)],
        "value string",
    )
    rows = parse_stage_log(lines).orderBy("name").collect()
    assert [(r.marker, r.name, r.duration_ms) for r in rows] == [("STAGE_END", "broken", None), ("API_STAGE_END", "request", 20.0), ("STAGE_END", "vector_retrieve", 12.5)]


def test_streaming_ingest_equals_batch(spark):
    from ragtables.operators.profiles import ChunkConfig
    from ragtables.streaming.ingest import ingest_stream

    base = tempfile.mkdtemp(prefix="rt-stream-")
    kdir, idx, ck = os.path.join(base, "k"), os.path.join(base, "idx"), os.path.join(base, "ck")
    os.makedirs(kdir)
    cfg = ChunkConfig("fixed", 20, 0)
    with open(os.path.join(kdir, "a.md"), "w") as f:
        f.write("alpha paragraph one\n\nalpha two")
    ingest_stream(spark, kdir, idx, ck, config=cfg)
    first = read_index(spark, idx).count()
    with open(os.path.join(kdir, "b.md"), "w") as f:
        f.write("beta text")
    ingest_stream(spark, kdir, idx, ck, config=cfg)
    streamed = sorted((r.relative_path, r.chunk_index, r.content) for r in read_index(spark, idx).collect())
    assert first == 2 and len(streamed) == 3
    from ragtables.operators.chunking import chunk_documents

    batch = chunk_documents(file_documents(spark, kdir), cfg)
    assert streamed == sorted((r.relative_path, r.chunk_index, r.content) for r in batch.collect())


def test_catalog_summary(spark):
    from ragtables.sources.tables import catalog_summary

    spark.range(3).createOrReplaceTempView("t_catalog")
    r = catalog_summary(spark).collect()[0]
    assert r.version == spark.version and r.table_count >= 1 and "t_catalog" in r.sample_tables


def test_build_index_and_run_evaluation(spark, sf):
    from ragtables.operators.embedding import hash_model
    from ragtables.operators.evaluation import run_evaluation
    from ragtables.operators.profiles import ChunkConfig, Profile, RetrievalConfig
    from ragtables.sources.tables import documents_from_table

    base = tempfile.mkdtemp(prefix="rt-e2e-")
    docs = documents_from_table(spark.read.parquet(f"{sf}/documents.parquet"))
    profiles = [Profile("kb-a", "A", "coll-a", ChunkConfig("fixed", 600, 60)), Profile("kb-b", "B", "coll-b", ChunkConfig("recursive", 300, 30))]
    stats = build_index(docs, os.path.join(base, "idx"), profiles, make_model=lambda: hash_model(64))
    assert set(stats) == {"coll-a", "coll-b"} and stats["coll-a"]["documents"] == docs.count()
    idx = read_index(spark, os.path.join(base, "idx"))
    bench = spark.read.parquet(f"{sf}/benchmark.parquet").orderBy("item_id").collect()
    with open(os.path.join(base, "cases.jsonl"), "w") as f:
        for r in bench:
            words = r.text.lower().split()[:2]
            f.write(json.dumps({"id": f"Q{r.item_id:03d}", "category": "c", "question": r.text, "expected_keywords": words, "reference": ""}) + "\n")
    from ragtables.operators.embedding import hash_embed_arrow

    results, summary, by_cat, misses = run_evaluation(
        spark, os.path.join(base, "cases.jsonl"), idx, retrieval=RetrievalConfig("rrf", 4, 8), profiles=profiles,
        embed=hash_embed_arrow, limit=10, report_path=os.path.join(base, "report"))
    s = summary.collect()[0]
    assert s.total_cases == 10 and s.failed_cases == 0 and s.retrieval_recall > 0.5
    assert results.count() == 10 and spark.read.json(os.path.join(base, "report", "results")).count() == 10
    from ragtables.sources.evalsets import read_eval_summary

    assert read_eval_summary(spark, os.path.join(base, "report")).first().total_cases == 10
    # the model is asked once for each question, with and without a report
    for report in (None, os.path.join(base, "again")):
        notes = tempfile.mkdtemp(prefix="rt-asked-")

        def noted(prompts, notes=notes):
            for _ in range(len(prompts)):
                open(os.path.join(notes, uuid.uuid4().hex), "w").close()
            return ["an answer"] * len(prompts)

        out = run_evaluation(spark, os.path.join(base, "cases.jsonl"), idx, profiles=profiles, answer_fn=noted, limit=6, report_path=report)
        assert [df.count() for df in out][:2] == [6, 1] and len(os.listdir(notes)) == 6


def test_column_types_of_sheets_follow_a_table_reader(spark):
    import io

    import pandas as pd

    from ragtables.sources.markup import csv_to_text
    from ragtables.sources.sheets import sheet_texts, workbook_texts

    columns = {"ids": ["007", "010", "+3"], "gaps": ["7", "NA", "-2"], "prices": ["1.50", "2", "1e3"], "flags": ["TRUE", "false", "True"], "mixed": ["true", "1", "x"],
               "switch": ["true", "", "False"], "words": ["a,b", 'say "x"', "null"], "none": ["", "NaN", "N/A"], "tiny": [".5", "3.", "-0.25"]}
    csv = pd.DataFrame(columns).to_csv(index=False)
    rows = [(g, i, *[columns[c][i] for c in columns]) for g in ("s1", "s2") for i in range(3)]
    schema = "sheet string, row int, " + ", ".join(f"{c} string" for c in columns)
    df = spark.createDataFrame(rows, schema).repartition(4)
    want = csv_to_text(csv)
    got = sheet_texts(df, columns=list(columns), keys=["sheet"], order_by=["row"]).collect()
    assert {r.sheet: r.content for r in got} == {"s1": want, "s2": want}
    assert pd.read_csv(io.StringIO(csv))["ids"].tolist() == [7, 10, 3]
    book = workbook_texts(df.withColumn("file", F.lit("b.xlsx")), columns=list(columns), workbook=["file"], sheet="sheet", order_by=["row"]).first().content
    assert book == f"工作表: s1\n{want}\n\n工作表: s2\n{want}"


def test_table_to_text_empty(spark):
    empty = spark.createDataFrame([], "id int, name string")
    assert [r.content for r in table_to_text(empty, order_by=["id"]).collect()] == ["id,name"]
    one = spark.createDataFrame([(1, "x")], "id int, name string")
    assert [r.content for r in table_to_text(one, order_by=["id"]).collect()] == ["id,name\n1,x"]


def test_load_documents_numbers_across_sources(spark):
    from ragtables.sources.files import load_documents

    files = spark.createDataFrame([("f1", 0, "a", "file"), ("f2", 1, "b", "file")], "doc_id string, doc_ord long, content string, document_type string")
    spark.createDataFrame([(1, "x")], "k int, v string").createOrReplaceTempView("t_docs")
    tables = load_table_documents(spark, ["t_docs"], order_by={"t_docs": ["k"]}).withColumn("doc_id", F.lit("t"))
    docs, counts = load_documents(files, tables)
    got = sorted((r.doc_ord, r.document_type) for r in docs.collect())
    assert got == [(0, "file"), (1, "file"), (2, "mysql_table")]
    assert {r.document_type: r.documents for r in counts.collect()} == {"file": 2, "mysql_table": 1, "total": 3}


def test_file_order_by_path_components(spark):
    tmp = tempfile.mkdtemp(prefix="rt-order-")
    for rel in ["a-c/x.md", "a/b.md", "a.md"]:
        os.makedirs(os.path.dirname(os.path.join(tmp, rel)), exist_ok=True)
        with open(os.path.join(tmp, rel), "w") as f:
            f.write(rel)
    docs = sorted((r.doc_ord, r.relative_path) for r in file_documents(spark, tmp).collect())
    from pathlib import Path

    expect = [p.relative_to(tmp).as_posix() for p in sorted(Path(tmp).rglob("*")) if p.is_file()]
    assert [r for _, r in docs] == expect


def test_ingest_asks_the_state_by_bucket_and_rebalances_its_writes(spark):
    """The state of a listing is asked once for a bucket, and a bucket is written in few files, not one for each task."""
    import glob
    from unittest import mock

    from ragtables.operators.profiles import ChunkConfig
    from ragtables.streaming import ingest

    base = tempfile.mkdtemp(prefix="rt-buckets-")
    kdir, idx, ck = os.path.join(base, "k"), os.path.join(base, "idx"), os.path.join(base, "ck")
    os.makedirs(kdir)
    for i in range(400):
        with open(os.path.join(kdir, f"d{i}.md"), "w") as f:
            f.write(f"text {i}")
    with mock.patch.object(ingest, "LISTING_BUCKETS", 16):
        query = ingest.ingest_stream(spark, kdir, idx, ck, config=ChunkConfig("fixed", 50, 0))
        assert sum(p["stateOperators"][0]["numRowsUpdated"] for p in query.recentProgress if p["stateOperators"]) <= 16
        assert len(glob.glob(f"{idx}/*/*/*.parquet")) <= 256  # a file for each bucket at most; before, 400
        os.remove(os.path.join(kdir, "d7.md"))
        os.utime(os.path.join(kdir, "d8.md"), (1, 1))  # another time, the same content
        with open(os.path.join(kdir, "d9.md"), "w") as f:
            f.write("another text")
        query = ingest.ingest_stream(spark, kdir, idx, ck, config=ChunkConfig("fixed", 50, 0))
        assert 1 <= sum(p["stateOperators"][0]["numRowsUpdated"] for p in query.recentProgress if p["stateOperators"]) <= 3
    spark.catalog.refreshByPath(idx)
    want = {f"text {i}" for i in range(400) if i not in (7, 9)} | {"another text"}
    assert sorted(r.content for r in read_index(spark, idx).collect()) == sorted(want)


def test_files_are_read_by_one_python_function_in_small_batches(spark):
    """One worker of a task parses the files of all formats, once, in batches of bounded size."""
    from ragtables.sources.files import file_texts
    from ragtables.sources.filesource import FilesReader

    base = tempfile.mkdtemp(prefix="rt-once-")
    for i in range(2500):
        with open(os.path.join(base, f"f{i}.txt"), "w") as f:
            f.write("text")
    with open(os.path.join(base, "g.txt"), "wb") as f:
        f.write("中文".encode("gbk"))
    with open(os.path.join(base, "h.html"), "wb") as f:
        f.write("<p>中文</p>".encode("gbk"))
    docs = file_documents(spark, base)
    assert file_texts(spark, base).filter("error is null").filter("length(content) > 0")._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1
    assert sorted(r.content for r in docs.collect()) == ["text"] * 2500 + ["中文"] * 2
    assert int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= 1000
    reader = FilesReader({"path": base})
    assert max(b.num_rows for p in reader.partitions() for b in reader.read(p)) <= 1000


def test_a_folder_is_listed_in_tasks(spark, tmp_path, monkeypatch):
    """``list_files`` finds what ``read_files`` plans, and its walk holds no listing (which the driver held before)."""
    import tracemalloc

    from pyarrow import fs

    from ragtables.sources import filesource
    from ragtables.streaming.ingest import listings, note_folder

    names = ["a.md", ".b.md", "_c.TXT", "x/d e.md", "x/y/ü.md", "x/.h/f.json", "x/no", "x/g.png", "x.md/i.md"]
    for n in [*names, *(f"many/{i}.md" for i in range(5000))]:
        (tmp_path / "k" / n).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "k" / n).write_text(n)
    (tmp_path / "k/empty").mkdir()
    (tmp_path / "k/linked.md").symlink_to(tmp_path / "k/a.md")
    (tmp_path / "k/lost.md").symlink_to(tmp_path / "nowhere.md")
    root, suffixes = str(tmp_path / "k"), (".md", ".txt", ".json")
    planned = filesource.read_files(spark, root, suffixes, content=False).selectExpr("path", "length", "unix_micros(modified) AS modified")
    want = sorted(map(tuple, planned.collect()))
    assert len(want) == 5008
    assert sorted(map(tuple, filesource.list_files(spark, root, suffixes).collect())) == want
    assert sorted(map(tuple, filesource.list_files(spark, f"file://{root}", suffixes).collect())) == want
    assert filesource.list_files(spark, f"{root}/none", suffixes).count() == 0
    # the listing of a trigger has them by bucket, and no scan that the driver plans file by file
    note_folder(spark, root, str(tmp_path / "notes"))
    noted = spark.read.parquet(listings(str(tmp_path / "notes")))
    assert noted.count() == 1024
    assert sorted(map(tuple, noted.selectExpr("inline(arrays_zip(path, length, modified))").collect())) == want
    tracemalloc.start()
    assert sum(1 for _ in filesource.walked(root, suffixes)) == 5009
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 200_000  # a list of the files: over 1 MB
    # a store that tells lengths and times with the names
    store = fs._MockFileSystem()
    for n in ("k/x/y", "k/z"):
        store.create_dir(n, recursive=True)
    for n in ("k/a.md", "k/x/b.md", "k/x/y/c.txt", "k/x/y/d.png"):
        with store.open_output_stream(n) as out:
            out.write(b"123")
    monkeypatch.setattr(filesource, "file_system", lambda path: (store, path))
    assert sorted(r[:2] for r in filesource.walked("k", (".md", ".txt"))) == [("k/a.md", 3), ("k/x/b.md", 3), ("k/x/y/c.txt", 3)]


def test_a_trigger_plans_no_file(spark, tmp_path, monkeypatch):
    """The driver plans a fixed number of partitions for a listing, whatever the folder holds."""
    from ragtables.sources import filesource
    from ragtables.streaming import ingest

    plans = []
    real = type(spark.range(0)).groupBy
    monkeypatch.setattr(type(spark.range(0)), "groupBy", lambda self, *c: plans.append(self._jdf.queryExecution().executedPlan().toString()) or real(self, *c))
    (tmp_path / "k").mkdir()
    (tmp_path / "k/a.md").write_text("a")
    ingest.note_folder(spark, str(tmp_path / "k"), str(tmp_path / "notes"))
    assert plans and not any(filesource.FORMAT in p or "BatchScan" in p for p in plans)
