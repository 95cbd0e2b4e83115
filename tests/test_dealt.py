"""Groups of nearly as many keys as rows: tables of a task are bounded, results are those of plain groups."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from varsparq.operators import ordering, relational, submatrix


@pytest.fixture
def small_tasks(monkeypatch):
    monkeypatch.setattr(ordering, "TASK_ROWS", 100)


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def _rows(df):
    return sorted(map(str, df.collect()))


def _scores(spark, n=1000):
    k = F.col("id")
    return spark.range(n).select((k % 50).alias("site"), F.when(k % 9 > 0, k % 7).alias("sample"), (k % 13).cast("double").alias("value"))


def test_partitions_follow_rows(spark, small_tasks):
    df = _scores(spark)
    assert ordering.dealt(df, ["site", "sample"]).rdd.getNumPartitions() == 10
    assert ordering.dealt(df.where("site < 0"), ["site"]).count() == 0


def test_between_variance(spark, small_tasks):
    scores = _scores(spark)
    members = spark.createDataFrame([(k, "ab"[k % 2]) for k in range(5)], "sample long, population string")
    got = relational.between_group_variance(scores, members, "site", "sample", "population", "value")
    assert "REPARTITION_BY_NUM" in _plan(got)
    means = scores.join(members, "sample").groupBy("site", "population").agg(F.avg("value").alias("m"))
    want = means.groupBy("site").agg(F.var_samp("m").alias("v"))
    both = got.join(want, "site").collect()
    assert len(both) == got.count() == 50 and all(r.between_var == pytest.approx(r.v) for r in both)


def test_pair_counts_are_a_left_join(spark, small_tasks):
    scores = _scores(spark)
    members = spark.createDataFrame([(1, "a"), (1, "a"), (1, "b"), (2, None), (3, "c"), (None, "d")], "sample long, population string")
    got = relational.pair_counts(scores, members, "site", "sample", "population")
    assert "REPARTITION_BY_NUM" in _plan(got)
    assert _rows(got) == _rows(scores.join(members, "sample", "left").groupBy("site", "sample", "population").agg(F.count("*").alias("n")))


def test_tracks_deal_distinct_intervals(spark, small_tasks, monkeypatch):
    k = F.col("id") % 400
    beds = spark.range(1200).select(F.lit("x").alias("name"), F.lit("c").alias("chrom"), (k * 10).alias("start"), (k * 10 + 1 + k % 7).alias("end"), F.when(k % 2 == 0, "+").otherwise("-").alias("strand"))
    regions = spark.range(40).select(F.lit("c").alias("chrom"), F.col("id").alias("region"), (F.col("id") * 100).alias("start"), (F.col("id") * 100 + 95).alias("end"))
    seen = []
    monkeypatch.setattr(submatrix, "dealt", lambda df, keys: seen.append(ordering.dealt(df, keys)) or seen[-1])
    got = submatrix.annotation_tracks(regions, beds).groupBy("track").agg(F.sum(F.col("end") - F.col("start")).alias("n")).collect()
    assert seen[0].rdd.getNumPartitions() == 12
    assert {r.track: r.n for r in got} == {f"x_{n}": sum(min(1 + v % 7, 95 - v * 10 % 100) for v in range(400) if v % 2 == p) for p, n in enumerate(("pos", "neg"))}
