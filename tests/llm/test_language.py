"""Language identification (op4)."""

from plain import empty, messy

from ragtables.llm import language_id
from ragtables.llm.queries import op4_language_id

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    rows = op4_language_id(spark, SF).join(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang"), "doc_id").filter("held_out").collect()
    assert len(rows) > 200 and sum(r["lang"] == r["lang_pred"] for r in rows) / len(rows) > 0.98


def test_messy_and_empty_tables(spark):
    docs = messy(spark)
    rows = language_id.language_id(docs).collect()
    assert len(rows) == docs.count()
    for r in rows:
        if r["doc_id"] in (1, 2, 3, 7):
            assert (r["lang_pred"], r["score"]) == ("und", 0.0)
        else:
            assert r["lang_pred"] in ("de", "en", "fr") and 0 < r["score"] <= 1
    assert language_id.language_id(empty(docs)).collect() == []
    assert {r["lang_pred"] for r in language_id.language_id(docs.selectExpr("doc_id", "text", "cast(null as string) lang")).collect()} == {"und"}


def test_unseen_words_fall_back_to_grams(spark):
    learn = [(i, t, lang) for i in range(40) for t, lang in (("thing that there then them " * 3, "en"), ("schön über straße größe " * 3, "de"))]
    model = language_id.fit(spark.createDataFrame(learn, "doc_id long, text string, lang string"))
    new = spark.createDataFrame([(1, "thatthen"), (2, "schößegrö"), (3, "ß")], "doc_id long, text string")
    assert [r["lang_pred"] for r in language_id.identify(new, model).orderBy("doc_id").collect()] == ["en", "de", "de"]


def test_sample_is_bounded_for_each_language(spark):
    words = [a + b + c for a in "abcdefgh" for b in "abcdefgh" for c in "abcdefgh"]
    rows = [(i, f"common {w} {w}", "en") for i, w in enumerate(words)]
    model = language_id.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"), 20)
    assert len(model[language_id.WORD][0]) == 21
