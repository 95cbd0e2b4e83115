"""Places, totals, ranks and quantiles on range partitions against plain computation."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from varsparq.operators import attribution, ordering, rankings, relational, significance


def test_places_of_many_rows_with_further_columns(spark):
    n = 200_000
    df = spark.range(n).select(((F.col("id") * 7919) % n).alias("k"), F.md5(F.col("id").cast("string")).alias("a"), F.rand(3).alias("b"), (F.col("id") % 3).alias("c"))
    rows = relational.row_index(df.repartition(9), ["k"], "at")
    assert rows.columns == ["k", "a", "b", "c", "at"]
    assert rows.where("at <> k").count() == 0 and rows.count() == n and rows.select("at").distinct().count() == n
    # few columns of the result, and a filter on it, see the same places
    assert rows.where("at < 10").select("k").orderBy("k").collect() == [(k,) for k in range(10)]


def test_places_of_odd_tables(spark):
    df = spark.createDataFrame([(None, 1), ("a", 2), ("b", 3)], "k string, v int")
    assert {(r.k, r.at) for r in relational.row_index(df, ["k"], "at").collect()} == {(None, 0), ("a", 1), ("b", 2)}
    assert relational.row_index(df.where("false"), ["k"], "at").count() == 0


def test_limits_count_over_the_whole_table(spark):
    df = spark.createDataFrame([(1, 9), (2, 1), (2, 2), (3, 1), (1, 8), (2, 9)], "site int, sample int")
    got = rankings.first_keys(df, {"site": 2, "sample": 2}).collect()
    assert sorted(map(tuple, got)) == [(2, 1), (2, 2)]  # sites 1 and 2, samples 1 and 2


def test_running_totals_and_what_follows(spark):
    draw = random.Random(3)
    rows = [("hot" if draw.random() < 0.6 else None if draw.random() < 0.3 else draw.choice("abc"), k, draw.randint(-5, 5)) for k in range(5000)]
    df = spark.createDataFrame(rows, "g string, k int, v int").repartition(7)
    got = {(r.g, r.k): (r.total, r.next) for r in ordering.running_totals(df, ["g"], ["k"], {"total": "v"}, {"next": "k"}).collect()}
    want = {}
    for g in {r[0] for r in rows}:
        own = sorted(r[1:] for r in rows if r[0] == g)
        total = 0
        for at, (k, v) in enumerate(own):
            total += v
            want[g, k] = (total, own[at + 1][0] if at + 1 < len(own) else None)
    assert got == want


@pytest.mark.parametrize("accuracy", [10_000, 50])
def test_quantiles_are_exact(spark, accuracy):
    draw = random.Random(4)
    groups = {"hot": 20_000, "small": 3, "one": 1, "two": 2, "ties": 500}
    rows = [(g, float(draw.choice([1, 2, 2, 3]) if g == "ties" else draw.gauss(0, 1))) for g, n in groups.items() for _ in range(n)] + [("small", None), ("none", None)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(5)
    fractions = [0.0, 0.05, 0.25, 0.5, 0.75, 0.999, 1.0]
    got = {r.g: r.q for r in ordering.exact_quantiles(df, ["g"], "v", fractions, accuracy).collect()}
    assert set(got) == set(groups)
    for g in groups:
        own = [v for x, v in rows if x == g and v is not None]
        assert np.allclose(got[g], np.quantile(own, fractions), rtol=0, atol=1e-12)
    whole = ordering.exact_quantiles(df, [], "v", [0.5]).collect()
    assert whole[0].q[0] == pytest.approx(np.median([v for _, v in rows if v is not None]), abs=1e-12)
    assert ordering.exact_quantiles(df.where("false"), ["g"], "v", [0.5]).count() == 0


def _ranks(values):
    order = sorted(values)
    return [np.mean([k + 1 for k, o in enumerate(order) if o == v]) for v in values]


def test_rank_tests_with_ties(spark):
    draw = random.Random(5)
    rows = [(k, draw.randint(0, 9), draw.randint(0, 9) + 0.5 * (k % 2), draw.random() < 0.4) for k in [1, 1, 2] for _ in range(60)]
    df = spark.createDataFrame(rows, "k int, a int, b double, g boolean").repartition(4)
    u = {r.k: r for r in attribution.mann_whitney(df, "k", "a", F.col("g")).collect()}
    rho = {r.k: r.rho for r in significance.spearman(df, "k", "a", "b").collect()}
    w = {r.k: r.w for r in significance.wilcoxon(df, "k", "a", "b").collect()}
    for k in (1, 2):
        own = [r for r in rows if r[0] == k]
        ra, rb = _ranks([r[1] for r in own]), _ranks([r[2] for r in own])
        n_a = sum(r[3] for r in own)
        assert u[k].u == pytest.approx(sum(x for x, r in zip(ra, own, strict=True) if r[3]) - n_a * (n_a + 1) / 2)
        assert rho[k] == pytest.approx(np.corrcoef(ra, rb)[0, 1])
        d = [r[1] - r[2] for r in own if r[1] != r[2]]
        rd = _ranks([abs(x) for x in d])
        assert w[k] == pytest.approx(min(sum(r for r, x in zip(rd, d, strict=True) if x > 0), sum(r for r, x in zip(rd, d, strict=True) if x < 0)))


def test_student_tail_is_the_integral(spark):
    def tail(t, df):  # twice the integral of the density beyond |t|, by its cosine form
        at = np.linspace(np.arctan(abs(t) / np.sqrt(df)), np.pi / 2, 200_001)
        whole = np.linspace(0, np.pi / 2, 200_001)
        f = lambda x: np.trapezoid(np.cos(x) ** (df - 1), x)
        return f(at) / f(whole)

    cases = [(t, float(df)) for t in (0.0, 0.3, -1.7, 4.0) for df in (1, 2, 3, 4, 7, 30, 399, 400, 5000)]
    got = spark.createDataFrame(cases, "t double, df double").select("t", "df", significance.student_tail(F.col("t"), F.col("df")).alias("p")).collect()
    for r in got:
        assert r.p == pytest.approx(tail(r.t, r.df), abs=1e-6 if r.df < 400 else 1e-5)


def test_f_tail_is_the_integral(spark):
    def tail(f, a, b):  # by the share of squared cosines beyond
        x = b / (b + a * f)
        at, whole = np.linspace(0, np.arcsin(np.sqrt(x)), 400_001), np.linspace(0, np.pi / 2, 400_001)
        g = lambda t: np.trapezoid(np.sin(t) ** (b - 1) * np.cos(t) ** (a - 1), t)
        return g(at) / g(whole)

    cases = [(f, a, b) for f in (0.0, 0.2, 1.0, 3.5, 40.0) for a in (1, 2, 5, 12) for b in (2, 3, 10, 250)]
    got = spark.createDataFrame([*cases, (None, 1, 2), (1.0, 0, 3)], "f double, a int, b int").select("f", "a", "b", significance.f_tail(F.col("f"), F.col("a"), F.col("b")).alias("p")).collect()
    for r in got:
        if r.f is None or not r.a:
            assert r.p is None
        else:
            assert r.p == pytest.approx(tail(r.f, r.a, r.b), abs=1e-7)
    rows = [("k", g, float(v)) for g, vs in {"x": [1, 2, 3], "y": [2, 3, 4], "z": [5, 6, 9], "one": [7]}.items() for v in vs]
    r = significance.anova_p(spark.createDataFrame(rows, "k string, g string, v double"), "k", "g", "v").first()
    means, n = [2, 3, 20 / 3], 3
    grand = sum(means) / 3
    f = (n * sum((m - grand) ** 2 for m in means) / 2) / ((2 + 2 + sum((v - 20 / 3) ** 2 for v in (5, 6, 9))) / 6)
    assert r.f == pytest.approx(f) and r.p == pytest.approx(tail(f, 2, 6), abs=1e-6)


def test_pairwise_stats_name_their_effects(spark):
    rows = [(c, float(v)) for c, vs in {"a": [1, 2, 3, 4, 5], "b": [4, 5, 6, 7], "c": [1, 9, 2, 8]}.items() for v in vs] + [("a", None)]
    got = significance.pairwise_stats(spark.createDataFrame(rows, "c string, v double"), "c", "v").collect()
    assert len(got) == 6 and {r.effect_size_kind for r in got} == {"cliffs_delta", "cohens_d"}
    assert got[0].asDict().keys() == {"test", "test_short_name", "group1", "group2", "n1", "n2", "statistic_name", "statistic", "pvalue", "effect_size", "effect_size_kind", "correction_method"}
    ab = next(r for r in got if (r.group1, r.group2, r.effect_size_kind) == ("a", "b", "cliffs_delta"))
    assert (ab.n1, ab.n2, ab.statistic) == (5, 4, 2.0) and ab.effect_size == pytest.approx(-0.8)
    t = next(r for r in got if (r.group1, r.group2, r.effect_size_kind) == ("a", "b", "cohens_d"))
    assert t.statistic == pytest.approx((3 - 5.5) / np.sqrt(2.5 / 5 + (5 / 3) / 4)) and 0.02 < t.pvalue / 3 < 0.05
