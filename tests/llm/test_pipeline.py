"""The pipeline as a whole, against plain Python."""

import sentencepiece
from plain import classes, empty, messy, removed

import corpus_pipeline
from ragtables.llm import piece_codec

SF = "/root/testdata/sf0.001"


def test_run_matches_plain_python(spark):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    items = [r["text"].lower() for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    group = classes(list(docs.items()))
    rows = [(d, t) for d, t in docs.items() if group[d] == d]
    left = [(d, bytes(c for c, m in zip(b, marks, strict=True) if not m).decode("utf-8", "ignore")) for (d, _), (b, marks) in zip(rows, removed(rows), strict=True)]
    left = {d: t for d, t in left if not any(i in t.lower() for i in items)}
    library = sentencepiece.SentencePieceProcessor(model_file=piece_codec.MODEL)
    got = {r["doc_id"]: r for r in corpus_pipeline.run(spark, SF).collect()}
    assert set(got) == set(left)
    for d, t in left.items():
        assert got[d]["ids"] == library.encode(t) and got[d]["exact"]


def test_stages_keep_the_columns_on_messy_and_empty_tables(spark):
    for docs, most in ((messy(spark), 12), (empty(messy(spark)), 0)):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, SF)
            if name != "tokens":
                assert out.columns == corpus_pipeline.COLUMNS
            most = out.count() if out.count() <= most else -1
            assert most >= 0
            docs = out


def test_each_stage_takes_effect(spark):
    docs = spark.createDataFrame([(1, "123 456", "en", "s", 7), (2, "the of and to in is that it was for " * 6, "en", "s", 1), (3, "the of and to in is that it was for " * 6, "en", "s", 1), (4, None, "en", "s", None)], "doc_id long, text string, lang string, source string, n_chars long")
    clear = corpus_pipeline.keep_language(spark, docs, SF)
    assert sorted(r["doc_id"] for r in clear.collect()) == [2, 3]
    assert [r["doc_id"] for r in corpus_pipeline.drop_near_duplicates(spark, clear, SF).collect()] == [2]
    assert {r["doc_id"]: r["n_chars"] for r in corpus_pipeline.cut_repeats(spark, clear, SF).collect()} == {2: 216, 3: 0}


def test_rows_that_share_only_their_doc_id_are_classed_by_their_texts(spark):
    text = {k: " ".join(f"{k}{i}" for i in range(40)) for k in "abc"}
    rows = [(1, text["a"]), (1, text["b"]), (1, text["b"]), (2, text["b"]), (2, text["c"]), (3, text["a"]), (3, None), (None, text["a"]), (0, text["c"])]
    docs = spark.createDataFrame([(d, t, "en", "s", 1) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    out = corpus_pipeline.drop_near_duplicates(spark, docs, SF)
    assert out.columns == corpus_pipeline.COLUMNS
    assert sorted(((r["doc_id"], r["text"]) for r in out.collect()), key=str) == sorted([(0, text["c"]), (1, text["a"]), (1, text["b"]), (3, None), (None, text["a"])], key=str)


def test_contaminated_rows_go_by_row(spark):
    item = spark.read.parquet(f"{SF}/benchmark.parquet").first()["text"]
    clean = " ".join(f"word{i}" for i in range(60))
    rows = [(None, item), (None, clean), (1, f"before {item} after"), (1, clean), (2, clean), (2, None)]
    docs = spark.createDataFrame([(d, t, "en", "s", 1) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    out = corpus_pipeline.drop_contaminated(spark, docs, SF)
    assert sorted(((r["doc_id"], r["text"]) for r in out.collect()), key=str) == sorted([(None, clean), (1, clean), (2, clean), (2, None)], key=str)


def test_bit_maps_lose_no_key(spark):
    from ragtables.llm import bitmaps

    rows = spark.range(5000).selectExpr("id as k", "cast(id as string) as text")
    keys = spark.range(0, 5000, 7).selectExpr("id as k")
    some, others = (df.select("k").collect() for df in bitmaps.split(rows, "k", keys))
    some, others = {r["k"] for r in some}, {r["k"] for r in others}
    assert set(range(0, 5000, 7)) <= some and some | others == set(range(5000)) and not some & others and len(others) > 4000
    assert bitmaps.split(rows, "k", keys.limit(0))[1].count() == 5000
