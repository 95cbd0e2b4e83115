"""Operators without SQL, against brute force on small tables."""

from __future__ import annotations

import math
import random
from itertools import groupby

import numpy as np
import pytest
from pyspark.sql import functions as F

from varsparq.functions import metrics as M
from varsparq.operators import benchmark, haplotypes, intervals, matrix, rankings, relational, significance


def _distance(a, b):
    at = sorted({*a, *b})
    return sum(abs(sum(x <= u for x in a) / len(a) - sum(x <= u for x in b) / len(b)) * (v - u) for u, v in zip(at, at[1:], strict=False))


def test_permutations(spark):
    draw = random.Random(1)
    rows = [("far", draw.gauss(0, 1), True) for _ in range(20)] + [("far", draw.gauss(3, 1), False) for _ in range(25)]
    rows += [("same", float(draw.randint(0, 5)), k % 2 == 0) for k in range(40)]
    df = spark.createDataFrame(rows, "k string, v double, a boolean")
    got = {r.k: r for r in significance.permuted_wasserstein(df, "k", "v", F.col("a"), 99, 3).collect()}
    for key in ("far", "same"):
        a, b = ([v for k, v, x in rows if k == key and x is side] for side in (True, False))
        assert got[key].observed == pytest.approx(_distance(a, b))
    assert got["far"].p == pytest.approx(0.01) and got["same"].p > 0.05


def test_rank_tests(spark):
    rows = [("x", float(v), v > 4) for v in (1, 2, 2, 3, 5, 6, 2, 7, 8)] + [("y", float(v % 5), v % 2 == 0) for v in range(30)]
    df = spark.createDataFrame(rows, "k string, v double, a boolean")
    got = {r.k: r for r in significance.adjusted(significance.mann_whitney_p(df, "k", "v", F.col("a")), "p").collect()}
    for key in got:
        a, b = ([v for k, v, x in rows if k == key and x is side] for side in (True, False))
        u = sum((x > y) + (x == y) / 2 for x in a for y in b)
        n, values = len(a) + len(b), sorted(a + b)
        ties = sum(t**3 - t for t in (len(list(g)) for _, g in groupby(values)))
        sd = math.sqrt(len(a) * len(b) / 12 * (n + 1 - ties / (n * (n - 1))))
        p = math.erfc(max(abs(u - len(a) * len(b) / 2) - 0.5, 0) / sd / math.sqrt(2))
        assert got[key].u == u and got[key].p == pytest.approx(p, abs=1e-6)
    low, high = sorted(r.p for r in got.values())
    by = sorted(got.values(), key=lambda r: r.p)
    assert [r.bonferroni for r in by] == pytest.approx([min(2 * low, 1), min(2 * high, 1)]) and [r.fdr for r in by] == pytest.approx([min(2 * low, high), high])


def test_logistic_benchmark_learns(spark):
    draw = random.Random(2)
    rows = [("g", k, draw.gauss(y, 0.7), y) for k, y in enumerate([0, 1] * 200)]
    df = spark.createDataFrame(rows, "grp string, id long, x double, y int")
    got = benchmark.logistic_benchmark(df, ["grp"], ["x"], "y", ["id"]).collect()
    assert 96 <= len(got) <= 104 and abs(sum(r.y for r in got) - len(got) / 2) <= 2
    train = [(x, y) for _, k, x, y in rows if k not in {r.id for r in got}]
    w = b = 0.0
    for _ in range(3000):  # plain gradient steps to the same optimum
        p = [1 / (1 + math.exp(-(w * x + b))) for x, _ in train]
        w -= 0.02 * (sum((q - y) * x for q, (x, y) in zip(p, train, strict=True)) + w)
        b -= 0.02 * sum(q - y for q, (_, y) in zip(p, train, strict=True))
    at = {k: x for _, k, x, _ in rows}
    assert all(r.prob == pytest.approx(1 / (1 + math.exp(-(w * at[r.id] + b))), abs=1e-5) for r in got)


def test_models_of_many_features_by_key(spark):
    r = np.random.default_rng(5)
    x = r.normal(size=(600, 3))
    grp = np.where(np.arange(600) % 3 == 0, "REF", "non-REF")
    y = (x @ [2.0, -1.0, 0.0] + 0.5 + r.logistic(size=600) > 0).astype(int)
    df = spark.createDataFrame([(str(g), k, *map(float, v), int(t)) for k, (g, v, t) in enumerate(zip(grp, x, y, strict=True))] + [("REF", 999, 0.0, None, 1.0, 1)], "grp string, id long, a double, b double, c double, y int")
    scored = benchmark.logistic_benchmark(df.repartition(3), ["grp"], ["a", "b", "c"], "y", ["id"])
    rows = scored.collect()
    report = {v.grp: v for v in benchmark.benchmark_report(scored, ["grp"], "y").collect()}
    for g in ("REF", "non-REF"):
        held = [v for v in rows if v.grp == g]
        out = {v.id for v in held}
        own = [k for k in range(600) if grp[k] == g and k not in out]
        assert abs(len(out) - (grp == g).sum() / 4) <= 2
        z, w = np.column_stack([x, np.ones(600)]), np.zeros(4)
        for _ in range(60):
            p = 1 / (1 + np.exp(-z[own] @ w))
            w -= np.linalg.solve(z[own].T @ (z[own] * (p * (1 - p))[:, None]) + np.diag([1, 1, 1, 0]), z[own].T @ (p - y[own]) + w * [1, 1, 1, 0])
        assert all(v.prob == pytest.approx(1 / (1 + np.exp(-z[v.id] @ w)), abs=1e-8) for v in held)
        t, q = np.array([v.y for v in held]), np.array([v.predicted for v in held])
        pr = [(t[q == c] == c).mean() for c in (0, 1)]
        rc = [(q[t == c] == c).mean() for c in (0, 1)]
        f1 = [2 * a * b / (a + b) for a, b in zip(pr, rc, strict=True)]
        v = report[g]
        assert v.support == len(held) and v.accuracy == pytest.approx((t == q).mean(), abs=1e-6)
        assert v.macro_f1 == pytest.approx(np.mean(f1), abs=1e-6) and v.weighted_precision == pytest.approx(np.average(pr, weights=[(t == 0).sum(), (t == 1).sum()]), abs=1e-6)
        order = np.argsort([-v.prob for v in held])
        hits = t[order].cumsum()
        assert v.average_precision == pytest.approx((hits / np.arange(1, len(t) + 1))[t[order] == 1].mean(), abs=1e-6)
    with pytest.raises(ValueError):
        benchmark.logistic_benchmark(df.where("false"), ["grp"], ["a"], "y", ["id"])


def test_density_grid(spark):
    draw = random.Random(3)
    points = [(draw.random(), draw.random()) for _ in range(40)]
    got = {(r.gx, r.gy): r.density for r in matrix.density_grid(spark.createDataFrame(points, "x double, y double"), "x", "y", 12, 0.1).collect()}
    raw = {(i, j): sum(math.exp(-((((i + 0.5) / 12 - x) ** 2) + ((j + 0.5) / 12 - y) ** 2) / 0.02) for x, y in points) for i in range(12) for j in range(12)}
    low, high = min(raw.values()), max(raw.values())
    assert len(got) == 144 and all(got[k] == pytest.approx((v - low) / (high - low), abs=0.03) for k, v in raw.items())


def test_seeded_samples_and_mutations(spark):
    df = spark.createDataFrame([("a" if k % 3 else "b", k, "ACGTACGT") for k in range(90)], "g string, id long, seq string")
    got = rankings.sample_per_group(df, ["g"], ["id"], 10, 5)
    assert {r.g: r.n for r in got.groupBy("g").agg(F.count("*").alias("n")).collect()} == {"a": 10, "b": 10}
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, rankings.sample_per_group(df.repartition(7), ["g"], ["id"], 10, 5).collect()))
    for r in df.withColumn("m", haplotypes.mutated("seq", "ACGT", 5, ["id"])).collect():
        assert len(r.m) == 8 and sum(x != y for x, y in zip(r.m, r.seq, strict=True)) == 1


def test_edges_of_small_operators(spark):
    empty = spark.createDataFrame([], "k string, v double, a boolean")
    assert significance.mann_whitney_p(empty, "k", "v", F.col("a")).count() == significance.permuted_wasserstein(empty, "k", "v", F.col("a"), 3, 1).count() == 0
    assert significance.equal_width_bins(empty, "v", 10).count() == relational.row_index(empty, ["k", "v"]).count() == 0
    bins = significance.equal_width_bins(spark.createDataFrame([(0.0,), (5.0,), (5.0,), (None,)], "v double"), "v", 10).collect()
    assert [r.bin for r in bins] == ["bin0", "bin1", "bin1", None]
    chain = spark.createDataFrame([("1", 0, 10, 5)], "chrom string, c_start long, c_end long, shift long")
    rows = spark.createDataFrame([("1", 9), ("1", 10), ("2", 3), (None, 3), ("1", None)], "chrom string, pos long")
    assert sorted(map(repr, ((r.new, r.lifted) for r in intervals.liftover(rows, chain, "pos", "new", 4).collect()))) == sorted(map(repr, [(14, True), (10, False), (3, False), (3, False), (None, False)]))
    mad = spark.createDataFrame([([1.0, 2.0, 9.0, 4.0],)], "x array<double>").select(M.median_absolute_deviation(F.col("x")), M.median_absolute_deviation(F.col("x"), True)).first()
    assert tuple(mad) == (1.5, 1.0)


def test_row_index_is_a_place_in_order(spark):
    df = spark.createDataFrame([(k * 7919 % 1000, k) for k in range(1000)], "a long, b long").repartition(9)
    assert [r.a for r in relational.row_index(df, ["a"]).orderBy("row_idx").collect()] == list(range(1000))
