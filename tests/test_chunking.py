"""Chunkers: hand-worked expected chunks, and properties that must hold on random texts."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from ragtables.functions import chunkers as C
from ragtables.functions.text import WHITESPACE, clean_text, strip
from ragtables.operators.chunking import chunk_documents, chunk_profiles, with_chunk_keys
from ragtables.operators.profiles import ChunkConfig, Profile


def run_chunks(spark, texts, strategy, size, overlap, threshold=0.75, make_model=None):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id long, t string")
    staged = C.add_chunks(df.withColumn("_t", clean_text("t")), "_t", "c", strategy, size, overlap, threshold, make_model)
    got = {r.id: list(r.c) for r in staged.select("id", "c").collect()}
    return [got[i] for i in range(len(texts))]


def table(cases):
    """(texts, expected) of a list of pairs."""
    return [t for t, _ in cases], [e for _, e in cases]


def test_strip_matches_python(spark):
    cases = ["　 a​b \x85　", "﻿x ", "", "  ", "\x1ca\x1c", " z ", "a​"]
    got = [r.s for r in spark.createDataFrame([(c,) for c in cases], "v string").select(strip("v").alias("s")).collect()]
    assert got == [c.strip() for c in cases]
    assert set(WHITESPACE) == {chr(c) for c in range(0x110000) if chr(c).isspace()}


def test_fixed(spark):
    texts, want = table([
        ("A" * 50, ["A" * 50]),
        ("A" * 51, ["A" * 50, "A" * 11]),
        ("A" * 120, ["A" * 50, "A" * 50, "A" * 40]),  # windows start at 0, 40, 80
        ("short one\n\n" + "B" * 60 + "\n\nshort two", ["short one", "B" * 50, "B" * 20, "short two"]),
        ("a\n\n\nb", ["a\n\nb"]),
        ("p1\n\np2\n\np3", ["p1\n\np2\n\np3"]),
        ("x" * 30 + "\n\n" + "y" * 18 + "\n\nz", ["x" * 30 + "\n\n" + "y" * 18, "z"]),
        ("  \n\n ", []),
        ("", []),
    ])
    assert run_chunks(spark, texts, "fixed", 50, 10) == want


def test_recursive(spark):
    texts, want = table([
        ("one two", ["one two"]),
        ("aaaa\n\nbbbb\n\ncccc", ["aaaa\n\nbbbb", "cccc"]),
        ("aaa bbb ccc ddd", ["aaa bbb", "ccc ddd"]),
        ("aaaaaa. bbbbbb. cc", ["aaaaaa", "bbbbbb.cc"]),  # the separator joins what was split at it
        ("x" * 23, ["x" * 10, "x" * 10, "x" * 3]),
        ("中文句子一。中文句子二！三", ["中文句子一", "中文句子二！三"]),
    ])
    assert run_chunks(spark, texts, "recursive", 10, 0) == want
    # overlap: the last characters of the chunk before, in front
    assert run_chunks(spark, ["aaa bbb ccc ddd"], "recursive", 10, 2) == [["aaa bbb", "bbccc ddd"]]


SECTIONS = [
    ("# Title\nintro text\n## Part\nbody", ["# Title\nintro text", "## Part\nbody"]),
    ("preface\n# Head\ncontent", ["preface", "# Head\ncontent"]),
    ("# Only heading at start", ["# Only heading at start"]),
    ("记录 1\na: 1\n\n记录 2\na: 2", ["记录 1\na: 1", "记录 2\na: 2"]),
    ("第十二章 开始\n内容\n第3节 继续", ["第十二章 开始\n内容", "第3节 继续"]),
    ("１. full width digit\n2. ascii digit", ["１. full width digit", "2. ascii digit"]),
    ("一、第一\n二、第二", ["一、第一", "二、第二"]),
    ("para one\n\npara two", ["para one", "para two"]),
    ("#nospace\n#\tTab heading", ["#nospace", "#\tTab heading"]),
    ("no cut at all", ["no cut at all"]),
]


def test_sections(spark):
    texts, want = table(SECTIONS)
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id long, t string")
    got = df.select("id", C.sections(clean_text("t")).alias("s")).orderBy("id").collect()
    assert [list(r.s) for r in got] == want


def test_structure_keeps_small_sections_and_splits_large_ones(spark):
    texts, want = table(SECTIONS)
    assert run_chunks(spark, texts, "structure", 1000, 0) == want
    assert run_chunks(spark, ["# A\none two three\n# B\nx"], "structure", 9, 0) == [["# A", "one two", "three", "# B\nx"]]


def test_sentences(spark):
    df = spark.createDataFrame([("a。b！c？d!e?f；g;h\ni.j",), ("",), ("x",)], "t string")
    assert [list(r.s) for r in df.select(C.sentences("t").alias("s")).collect()] == [["a。", "b！", "c？", "d!", "e?", "f；", "g;", "h", "i.j"], [], ["x"]]


def models():
    """Two models (nested functions travel to the workers by value): one vector for all; one way for texts with an "x"."""

    def constant_model():
        return lambda texts: np.ones((len(texts), 3))

    def alternating_model():
        return lambda texts: np.array([[1.0, 0.0] if "x" in t else [0.0, 1.0] for t in texts])

    return constant_model, alternating_model


constant_model, alternating_model = models()


def test_semantic_asks_the_model(spark):
    texts = ["aa. bb!cc!dd!ee!", "x1!x2!b!c!x3!", "only one", "x" * 9 + "!" + "x" * 9 + "!"]
    assert run_chunks(spark, texts, "semantic", 20, 0, 0.5, constant_model) == [["aa. bb!cc!dd!ee!"], ["x1!x2!b!c!x3!"], ["only one"], ["x" * 9 + "!" + "x" * 9 + "!"]]
    assert run_chunks(spark, texts, "semantic", 20, 0, 0.5, alternating_model) == [["aa. bb!cc!dd!ee!"], ["x1!x2!", "b!c!", "x3!"], ["only one"], ["x" * 9 + "!" + "x" * 9 + "!"]]
    # size ends a group, and what is over size alone is cut like a paragraph
    assert run_chunks(spark, ["x1!x2!x3!", "x" * 12], "semantic", 6, 0, 0.5, alternating_model) == [["x1!x2!", "x3!"], ["x" * 6, "x" * 6]]


def test_profiles_and_documents_pass_the_model(spark):
    docs = spark.createDataFrame([("d", 0, "aa. bb!cc!dd!ee!")], "doc_id string, doc_ord long, content string")
    config = ChunkConfig("semantic", 100, 0, 0.9)
    assert [r.content for r in chunk_documents(docs, config, make_model=constant_model).collect()] == ["aa. bb!cc!dd!ee!"]
    rows = chunk_profiles(docs, [Profile("p", "P", "coll", config)], make_model=constant_model).collect()
    assert [r.content for r in rows] == ["aa. bb!cc!dd!ee!"]
    assert len(chunk_documents(docs, config).collect()) > 1  # the default model
    with pytest.raises(TypeError):
        chunk_documents(docs, config, embed=constant_model)


def _random_text(rng):
    alphabet = ["a", "b", "c", "d", " ", " ", "\n", "\n\n", "。", "！", ".", "!", "?", ";", "；", "中", "　", "# ", "1. ", "记录 2"]
    return "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 120)))


def _letters(text):
    return re.sub(r"[\s.。！？!?；;]", "", text)


@pytest.mark.parametrize("strategy", ["fixed", "recursive", "structure", "semantic"])
def test_chunks_of_random_texts(spark, strategy):
    rng = random.Random(len(strategy))
    texts = [_random_text(rng) for _ in range(200)]
    for size in (15, 40):
        for text, chunks in zip(texts, run_chunks(spark, texts, strategy, size, 0, 0.5), strict=True):
            assert all(0 < len(c) <= size and c == c.strip() for c in chunks)
            assert _letters("".join(chunks)) == _letters(text)  # whole, in order
    plain, lapped = (run_chunks(spark, texts, strategy, 15, o, 0.5) for o in (0, 4))
    if strategy in ("recursive", "structure") and all(len(t) <= 15 for c in plain for t in c):
        for a, b in zip(plain, lapped, strict=True):
            assert (not a) == (not b)


def test_chunk_documents_and_keys(spark):
    docs = spark.createDataFrame(
        [("d0", 0, "p1\n\np2", "a.md", "/k/a.md", "a.md", "a", ".md", "a.md", "", "file"),
         ("d1", 1, "   ", "b.md", "/k/b.md", "b.md", "b", ".md", "b.md", "", "file")],
        "doc_id string, doc_ord long, content string, source string, path string, file_name string, file_stem string, "
        "file_suffix string, relative_path string, parent_dir string, document_type string",
    )
    ch = with_chunk_keys(chunk_documents(docs, ChunkConfig("fixed", 3, 0)), "kb-x", "coll")
    rows = ch.orderBy("chunk_index").collect()
    assert [r.id for r in rows] == ["kb-x-doc-0-chunk-0", "kb-x-doc-0-chunk-1"]
    assert rows[0].parent_dir is None and rows[0].file_suffix == ".md" and rows[0].collection_name == "coll"


def test_config_validation():
    with pytest.raises(ValueError):
        ChunkConfig("fixed", 10, 10).validate()
    with pytest.raises(ValueError):
        ChunkConfig("bogus", 10, 1).validate()
    with pytest.raises(ValueError):
        ChunkConfig("semantic", 10, 1, 0.0).validate()


def test_named_forms(spark):
    from ragtables.operators.chunking import split_fixed, split_recursive, split_sections, split_semantic, split_sentences, split_structure

    texts = [t for t, _ in SECTIONS]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id long, t string")
    for fn, strategy in [(split_fixed, "fixed"), (split_recursive, "recursive"), (split_structure, "structure")]:
        assert [list(r.chunks) for r in fn(df, "t", 20, 4).orderBy("id").collect()] == run_chunks(spark, texts, strategy, 20, 4)
    assert [list(r.chunks) for r in split_semantic(df, "t", 20, 4, 0.5).orderBy("id").collect()] == run_chunks(spark, texts, "semantic", 20, 4, 0.5)
    assert [list(r.sections) for r in split_sections(df, "t").orderBy("id").collect()] == [e for _, e in SECTIONS]
    assert split_sentences(df, "t").count() == len(texts)


def test_each_distinct_sentence_is_embedded_once(spark, monkeypatch):
    import os
    import tempfile
    import uuid

    from ragtables.plans import ordinals

    notes = tempfile.mkdtemp(prefix="rt-embedded-")

    def noting_model():
        def predict(texts):
            for _ in texts:
                open(os.path.join(notes, uuid.uuid4().hex), "w").close()
            return [[1.0, 0.0] if len(t) % 2 == 0 else [0.0, 1.0] for t in texts]

        return predict

    def same_model():
        return lambda texts: [[1.0, 0.0] if len(t) % 2 == 0 else [0.0, 1.0] for t in texts]

    texts = ["a! bb! a! ccc! " * 12, "a!bb!", "", "one", "dddd! a! e! " * 5, "a! bb! a! ccc! " * 12]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, content string").repartition(3)
    config = ChunkConfig("semantic", 12, 2, 0.5)
    want = sorted(map(tuple, chunk_documents(docs, config, make_model=same_model).collect()))
    assert sorted(map(tuple, chunk_documents(docs, config, make_model=noting_model, embed_once=True).collect())) == want
    assert len(os.listdir(notes)) == len({s + "!" if s != "one" else s for t in texts for s in t.replace(" ", "").split("!") if s})
    monkeypatch.setattr(ordinals, "MAX_KEY_ROWS", 10)  # a long document is several tasks
    assert sorted(map(tuple, chunk_documents(docs, config, make_model=same_model, embed_once=True).collect())) == want


def test_sentences_are_split_once_and_joined_rows_not_counted(spark, monkeypatch):
    from ragtables.plans import ordinals

    model = lambda: lambda texts: [[1.0, 0.0] if len(t) % 3 else [0.0, 0.0] for t in texts]
    rows = [(1, "a! bb! a! cc! ccc!"), (1, "a! bb! a! cc! ccc!"), (2, None), (None, "one"), (3, ""), (4, "dddd! a! " * 9)]
    docs = spark.createDataFrame(rows, "doc_id int, content string").repartition(2)
    config = ChunkConfig("semantic", 12, 2, 0.5)
    want = sorted(map(str, chunk_documents(docs, config, make_model=model).collect()))
    monkeypatch.setattr(ordinals, "largest_key", lambda *_: pytest.fail("the joined rows are computed to count them"))
    once = chunk_documents(docs, config, make_model=model, embed_once=True)
    assert C.SENTENCE_END_CHARS.strip() not in once._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(map(str, once.collect())) == want
