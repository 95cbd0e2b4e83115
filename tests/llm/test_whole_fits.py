"""Fits of the operators read every labelled row."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from varsparq.llm import mixing, quality, secretscan


def test_forests_grow_over_all_rows_in_tasks(spark):
    r = np.random.default_rng(5)
    stats = r.integers(1, 60, (900, len(quality.STATS)))
    groups = [[0], [1], [2], [3], [0, 1, 2, 3]]
    known = spark.createDataFrame(stats.tolist(), ", ".join(f"{s} long" for s in quality.STATS)).repartition(5)
    got = quality.fit_forests(known, groups, trees=3)
    x = quality.features(stats)
    want = quality.grow(groups, 3, len(x), lambda forests, level: quality.reached(forests, level, x))
    for a, b in zip(got, want, strict=True):
        assert (a.feature == b.feature).all() and (a.split == b.split).all() and (a.path == b.path).all()
    n, low, high = quality.reached(got, 0, x)
    assert (n == 900).all() and low[-1].tolist() == x.min(0).tolist() and high[-1].tolist() == x.max(0).tolist()  # every row reaches each root


def test_markov_models_count_all_labelled_documents(spark):
    ids = spark.range(2300).select(F.col("id").alias("doc_id"))
    last = [r.doc_id for r in ids.orderBy(F.xxhash64("doc_id").desc()).limit(200).collect()]
    odd = F.col("doc_id").isin(last)
    plain = ids.withColumn("text", F.concat(F.lit("common words of document number"), F.repeat(F.lit(" plain"), 3)))
    docs = plain.withColumn("text", F.when(odd, F.lit("qzqzqz zqzqzq qzqzqzqz")).otherwise(F.col("text")))
    labels = ids.select("doc_id", F.lit(1).alias("quality"), F.lit(0).alias("toxic"))
    score = [secretscan.fit(d, labels, strings=200).score("qzqzqzqzqzqzqzqz") for d in (plain, docs)]
    assert score[1] < score[0] - 1


def test_mixing_counts_all_labelled_documents(spark):
    ids = spark.range(20_100).select(F.col("id").alias("doc_id"))
    last = [r.doc_id for r in ids.orderBy(F.xxhash64("doc_id").desc()).limit(60).collect()]
    low = F.col("doc_id").isin(last)
    docs = ids.select("doc_id", F.when(low, "rubbish rubbish words").otherwise("plain good words").alias("text"))
    labels = ids.select("doc_id", F.when(low, 0).otherwise(1).alias("quality"), F.lit(0).alias("toxic"))
    rows = mixing.classify(docs, labels).select("_row.text", "_low", "_ordinary").distinct().collect()
    share = {r.text.split()[0]: r._low / (r._low + r._ordinary) for r in rows}
    assert share["rubbish"] > 0.9 and share["plain"] < 0.1
