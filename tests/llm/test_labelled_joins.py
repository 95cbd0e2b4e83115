"""Labelled rows are found by one plan at every size, and only features and candidates are shuffled."""

from __future__ import annotations

from pyspark.sql import functions as F

from varsparq.llm import mixing, shared


def test_of_keys_is_the_join(spark, monkeypatch):
    df = spark.range(3000).select(F.when(F.col("id") % 10 > 0, F.col("id") - 1500).alias("k"), F.col("id").alias("v"))
    keys = spark.range(0, 600, 7).select((F.col("id") - 300).alias("k"), (F.col("id") * 2).alias("w"))
    want = sorted(map(tuple, df.join(keys, "k").collect()))
    for bits in (1 << 25, 1 << 15):
        monkeypatch.setattr(shared, "KEY_BITS", bits)
        got = shared.of_keys(df, "k", keys)
        assert sorted(map(tuple, got.collect())) == want
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan  # dealt by key, though the keys are few
    none = keys.where("k is null")
    assert shared.of_keys(df, "k", none).count() == 0


def test_rows_of_a_cell_share_its_posteriors(spark):
    docs = spark.createDataFrame([(k, None if k == 9 else "rubbish words " * (k % 3) + "plain good words" * (k % 5), "x" * 50) for k in range(200)], "doc_id long, text string, extra string")
    labels = spark.createDataFrame([(k, int(k % 3 == 0), 0) for k in range(200)], "doc_id long, quality int, toxic int")
    rows, cells = mixing._classified(docs, labels, kept=["doc_id"])
    assert rows.select("_row.*").columns == ["doc_id"]  # texts are not written again
    assert rows.count() == 200 and cells.agg(F.sum("_tokens")).first()[0] == rows.agg(F.sum("_tokens")).first()[0]
    whole = {r._row.doc_id: (r._low, r._ordinary, r._toxic) for r in mixing.classify(docs, labels).collect()}
    of = {r._cell: (r._low, r._ordinary, r._toxic) for r in cells.collect()}
    assert len(whole) == 200 and all(whole[r._row.doc_id] == of[r._cell] for r in rows.collect())
    joined = rows.join(F.broadcast(cells.drop("_tokens")), "_cell")._jdf.queryExecution().executedPlan().toString()
    assert joined.count("array_intersect") <= 2  # each lexicon once
