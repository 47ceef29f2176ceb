"""The drop stages beyond the bound of a broadcast, and the pipeline over edge rows."""

import pytest
from pyspark.sql import functions as F

pytest.importorskip("public_tokenizers")

from netquarry.llm import exact_dedup, simhash  # noqa: E402

SF = "/root/testdata/sf0.001"


def moved_columns(df):
    """What the exchanges of a plan carry, broadcasts left out."""
    found = []

    def walk(p):
        name = p.getClass().getSimpleName()
        if name == "AdaptiveSparkPlanExec":
            return walk(p.executedPlan())
        if name == "ShuffleExchangeExec":
            found.append(p.output().mkString(" "))
        for k in range(p.children().size()):
            walk(p.children().apply(k))

    walk(df._jdf.queryExecution().executedPlan())
    return found


def test_cascade_is_exact(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup, "BITMAP_BITS", 16)
    monkeypatch.setattr(exact_dedup, "MOST_BITS", 16)
    rows = spark.range(40_000).select(F.col("id").alias("a"), (F.col("id") % 7).alias("b"), (F.xxhash64("id") % 5 == 0).alias("goes"))
    rows = exact_dedup.materialize(rows, "test")
    levels = exact_dedup.cascade(rows, ["a", "b"], "goes")
    assert len(levels) > 2
    out = exact_dedup.told(rows, ["a", "b"], levels)
    assert out.where("goes = stays").count() == 0 and out.count() == 40_000 and moved_columns(out) == []
    # A key that goes and stays, or too many keys, have no cascade.
    assert exact_dedup.cascade(rows.withColumn("a", F.lit(1)).withColumn("b", F.lit(None).cast("long")), ["a", "b"], "goes") is None
    monkeypatch.setattr(exact_dedup, "FULLEST", 0.01)
    assert exact_dedup.cascade(rows, ["a", "b"], "goes") is None


@pytest.mark.parametrize("cascaded", [True, False])
def test_texts_stay_beyond_the_broadcast_limit(spark, monkeypatch, request, cascaded):
    long = lambda k: " ".join(f"w{k}x{i}" for i in range(80))
    rows = [(k, long(k % 12) + (" and" if k % 5 == 0 else ""), "s") for k in range(36)] + [(99, None, None), (98, "", "s")]
    docs = exact_dedup.materialize(spark.createDataFrame(rows, "doc_id long, text string, source string"), "test")
    monkeypatch.setattr(simhash, "MET", 0.5)  # few samples do for copies but for a word
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    request.addfinalizer(lambda: spark.conf.unset("spark.sql.autoBroadcastJoinThreshold"))
    simhash.number_of.cache_clear()
    request.addfinalizer(simhash.number_of.cache_clear)
    want = [sorted(map(repr, f(docs).collect())) for f in (exact_dedup.drop_exact_duplicates, simhash.drop_near_duplicates)]
    for m in (exact_dedup, simhash):
        monkeypatch.setattr(m, "fits", lambda df, row_bytes, limit=0: False)
        monkeypatch.setattr(m, "if_small", lambda df, row_bytes, limit=0: df)
    if not cascaded:
        monkeypatch.setattr(exact_dedup, "FULLEST", -1)
    for f, rows in zip((exact_dedup.drop_exact_duplicates, simhash.drop_near_duplicates), want, strict=True):
        out = f(docs)
        assert bool([c for c in moved_columns(out) if "doc#" in c]) != cascaded
        assert sorted(map(repr, out.collect())) == rows and 0 < len(rows) < docs.count()


@pytest.mark.parametrize("far", [True, False])
def test_one_of_repeated_rows_stays(spark, monkeypatch, far):
    rows = [(4, "", "b"), (4, "", "b"), (4, None, "a"), (5, "x y", "a"), (3, "X y", "c"), (None, "z", None), (None, "Z", "d"), (9, "z2", "e")] + [(8, "long " * 50, "s")] * 30
    docs = spark.createDataFrame(rows, "doc_id long, text string, h string").repartition(5)
    if far:
        monkeypatch.setattr(exact_dedup, "fits", lambda df, row_bytes, limit=0: False)
        monkeypatch.setattr(exact_dedup, "if_small", lambda df, row_bytes, limit=0: df)
    got = [exact_dedup.drop_exact_duplicates(d, once=True).collect() for d in (docs, docs.repartition(3))]
    assert sorted(map(repr, got[0])) == sorted(map(repr, got[1]))
    assert sorted(str(r.doc_id) for r in got[0]) == ["4", "5", "8", "9", "None"]
    assert all(tuple(r) in rows for r in got[0])
    assert exact_dedup.drop_exact_duplicates(docs.limit(0), once=True).count() == 0


def test_pipeline_of_edge_rows(spark, tmp_path):
    """Nulls, empty texts, ties, repeated rows, clashing columns; empty tables."""
    import corpus_pipeline as cp

    long = " ".join(f"w{i}" for i in range(30_000))
    rows = [(1, None, "a"), (2, "", "a"), (2, "", "a"), (None, "a text of its own", None), (None, "a text of its own", None), (7, "A Text of its own", "b"), (8, long, "b"), (9, long + " tail", None), (3, "漢字 😀 é", "c")]
    schema = "doc_id long, text string, source string, id string, h string, n int, p int, root long, node long, o int, size int, stays boolean"
    for name, kept in (("some", rows), ("none", [])):
        folder = tmp_path / name
        spark.createDataFrame([(*r, "i", "h", 1, 2, 3, 4, 5, 6, True) for r in kept], schema).write.parquet(f"{folder}/documents.parquet")
        spark.read.parquet(f"{SF}/labels.parquet").limit(0).write.parquet(f"{folder}/labels.parquet")
        docs = spark.read.parquet(f"{folder}/documents.parquet")
        for stage, f in cp.STAGES[:-1]:
            docs = cp.materialize(f(spark, docs, str(folder)), "test")
            assert docs.columns == [c.split()[0] for c in schema.split(", ")]
            if stage == "near_dedup":
                assert sorted(r.doc_id for r in docs.collect()) == ([2, 3, 7, 8] if kept else [])
        out = cp.run(spark, str(folder))
        assert sorted(r.doc_id for r in out.collect()) == sorted(r.doc_id for r in docs.collect())
