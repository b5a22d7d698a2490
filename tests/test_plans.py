"""Plan helpers: split ordinals and lag equal the plain window functions, also for a hot key."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from ragtables.plans.joins import fits, join_small
from ragtables.plans.ordinals import lag_split, with_ordinal
from ragtables.plans.partitioning import spread


def _data(spark):
    rows = [("hot", i, i % 3) for i in range(3000)] + [(f"k{i % 7}", i, i % 5) for i in range(300)]
    return spark.createDataFrame(rows, "k string, t long, v long")


def test_with_ordinal_hot_key(spark):
    df = _data(spark)
    got = with_ordinal(df, ["t"], "o", start=1, partition_by=["k"], max_key_rows=100)
    exp = df.withColumn("o", F.row_number().over(Window.partitionBy("k").orderBy("t")))
    assert sorted(map(tuple, got.select("k", "t", "o").collect())) == sorted(map(tuple, exp.select("k", "t", "o").collect()))
    g = with_ordinal(df, ["k", "t"], "g", max_key_rows=100)
    assert sorted(r.g for r in g.collect()) == list(range(3300))


def test_lag_split_hot_key(spark):
    df = _data(spark)
    got = lag_split(df, ["k"], ["t"], ["v", "t"], max_key_rows=100)
    w = Window.partitionBy("k").orderBy("t")
    exp = df.withColumn("prev_v", F.lag("v").over(w)).withColumn("prev_t", F.lag("t").over(w))
    cols = ["k", "t", "v", "prev_v", "prev_t"]
    assert sorted(map(tuple, got.select(*cols).collect())) == sorted(map(tuple, exp.select(*cols).collect()))


def test_joins_and_spread(spark):
    a = spark.range(100).withColumnRenamed("id", "k")
    b = spark.range(10).withColumnRenamed("id", "k")
    assert fits(b, 10) and not fits(b, 9)
    assert join_small(a, b, "k").count() == 10 and join_small(a, b, "k", max_rows=1).count() == 10
    assert spread(spark.range(10).coalesce(1), 4).rdd.getNumPartitions() == 4


def test_timing_summary_hot_request(spark):
    from ragtables.operators.timing import timing_summary

    rows = [("hot", f"s{i}", float(i % 7) + 0.5, i) for i in range(2500)] + [("cold", "x", 1.25, 0)]
    st = spark.createDataFrame(rows, "req string, stage string, duration_ms double, ended_at long")
    out = {r.req: r for r in timing_summary(st, request="req", end_order=["ended_at"], max_key_rows=100).collect()}
    small = {r.req: r for r in timing_summary(st, request="req", end_order=["ended_at"]).collect()}
    assert {k: tuple(v) for k, v in small.items()} == {k: tuple(v) for k, v in out.items()}
    exp = " -> ".join(f"s{i}({float(i % 7) + 0.5}ms)" for i in range(2500))
    assert out["hot"].chain_text == exp and out["hot"].stages == 2500
    assert out["hot"].total_ms == round(sum(float(i % 7) + 0.5 for i in range(2500)), 2)
    assert out["cold"].chain_text == "x(1.25ms)"


def test_ordered_join_paths(spark):
    from ragtables.plans.strings import ordered_join

    df = _data(spark).withColumn("s", F.col("t").cast("string"))
    a = {r.k: r.text for r in ordered_join(df, ["k"], ["t"], "s", ",", max_key_rows=100).collect()}
    b = {r.k: r.text for r in ordered_join(df, ["k"], ["t"], "s", ",").collect()}
    assert a == b and a["hot"] == ",".join(str(i) for i in range(3000))
    # also the plain-window paths equal the split ones
    w1 = with_ordinal(df, ["t"], "o", partition_by=["k"])
    w2 = with_ordinal(df, ["t"], "o", partition_by=["k"], max_key_rows=100)
    assert sorted(map(tuple, w1.select("k", "t", "o").collect())) == sorted(map(tuple, w2.select("k", "t", "o").collect()))


def test_null_keys_survive_on_both_paths(spark):
    rows = [(None if i % 2 else "k", i) for i in range(8)]
    df = spark.createDataFrame(rows, "k string, t long")
    for bound in (None, 1):
        got = with_ordinal(df, ["t"], "o", partition_by=["k"], max_key_rows=bound).collect()
        assert sorted((str(r.k), r.t, r.o) for r in got) == sorted((str(k), t, t // 2) for k, t in rows)
        lagged = lag_split(df, ["k"], ["t"], ["t"], max_key_rows=bound).collect()
        assert sorted((str(r.k), r.t, r.prev_t) for r in lagged) == sorted((str(k), t, t - 2 if t > 1 else None) for k, t in rows)


def test_broadcasts_are_bounded_in_bytes(spark, monkeypatch):
    from ragtables.plans import joins

    wide = spark.range(100).selectExpr("id", "repeat('x', 1000) s", "array_repeat(0.0D, 100) v")
    assert fits(wide, 100)
    monkeypatch.setattr(joins, "MAX_BROADCAST_BYTES", 100_000)
    assert not fits(wide, 100)


def test_parts_of_a_hot_key_join_to_the_whole_text(spark):
    from ragtables.operators.timing import timing_chains, timing_summary
    from ragtables.plans.strings import ordered_join, ordered_parts
    from ragtables.sources.tables import assemble_parts, rows_to_text

    df = _data(spark).withColumn("text", F.concat(F.lit("é"), F.col("t").cast("string"))).unionByName(spark.createDataFrame([(None, 1, 0, "n"), (None, 2, 0, "m")], "k string, t long, v long, text string")).repartition(6)
    whole = {r.k: r.text for r in ordered_join(df, ["k"], ["t"], "text", "; ").collect()}
    for size in (1, 200, 10**6):
        rows = ordered_parts(df, ["k"], ["t"], "text", "; ", size).collect()
        assert all(len(r.text.encode()) <= size + 10 for r in rows)
        assert {k: "; ".join(r.text for r in sorted((r for r in rows if r.k == k), key=lambda r: r.part)) for k in whole} == whole
    parts = rows_to_text(df, columns=["v"], title="T", order_by=["t"], group_by=["k"], bytes_per_doc=500).filter("k = 'hot'").orderBy("part").collect()
    one = rows_to_text(df, columns=["v"], title="T", order_by=["t"], group_by=["k"]).filter("k = 'hot'").first().content
    assert len(parts) > 50 and "T\n\n" + "\n\n".join(p.content.removeprefix("T\n\n") for p in parts) == one
    pages = assemble_parts(df, doc_key=["k"], part_key="t", text="text", kind="pages", bytes_per_doc=300).filter("k = 'hot'").orderBy("part").collect()
    assert "\n".join(p.content for p in pages) == whole["hot"].replace("; ", "\n")
    stages = df.select("k", F.col("t").alias("ended_at"), F.lit("s").alias("stage"), (F.col("v") / 2).alias("duration_ms"))
    chain = {r.k: r.chain_text for r in timing_summary(stages, request="k").collect()}
    cut = timing_chains(stages, request="k", part_bytes=400).collect()
    assert {k: " -> ".join(r.chain_text for r in sorted((r for r in cut if r.k == k), key=lambda r: r.part)) for k in chain} == chain
