"""Track metrics, walks and fills against plain computation."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest

from varsparq.operators import matrix, rankings


def _softmax_entropy(x):
    p = np.exp(x - x.max(0))
    p /= p.sum(0)
    return -(p * np.log(p + 1e-8)).sum(0)


def test_scores_of_tracks(spark):
    r = np.random.default_rng(3)
    a = np.exp(r.normal(size=(16, 5, 4)) * np.array([0.2, 1.0, 0.5, 1.5]))  # haplotypes, places, tracks
    h, p, t = np.indices(a.shape).reshape(3, -1)
    cells = spark.createDataFrame(pd.DataFrame({"hap": h, "place": p, "track": t, "v": a.ravel()})).repartition(3)
    q = a / (a.sum(0) + 1e-8)
    down = [a.reshape(16 // s, s, 5, 4).mean(1) for s in (1, 2, 4, 8)]
    ent = [_softmax_entropy(x) for x in down]
    mean_abs = np.abs(a).mean(0)
    want = {
        "std": a.std(0, ddof=1).mean(0), "mad": np.median(np.abs(a - np.median(a, 0)), 0).mean(0), "entropy": ent[0].mean(0), "differential_entropy": -(q * np.log(q + 1e-8)).sum(0).mean(0),
        "multiscale_entropy": sum((ent[k] + ent[k + 1]) / 2 * s for k, s in enumerate((1, 2, 4))).mean(0), "cv": (a.std(0, ddof=1) / (np.abs(a.mean(0)) + 1e-8)).mean(0),
        "range": (a.max(0) - a.min(0)).mean(0), "spread": (mean_abs > 0.05 * mean_abs.max(0) + 1e-8).mean(0), "auc": mean_abs.sum(0),
    }
    assert set(want) == set(rankings.VARIABILITY)
    for metric, values in want.items():
        got = {x.track: x.score for x in rankings.track_scores(cells, metric).collect()}
        assert all(got[k] == pytest.approx(values[k], rel=1e-9) for k in range(4)), metric
    top = rankings.most_variable_tracks(cells, "cv", 2).orderBy("place").collect()
    assert [x.track for x in top] == np.argsort(-want["cv"])[:2].tolist()
    with pytest.raises(ValueError):
        rankings.track_scores(cells, "other")


def test_walks_go_to_the_nearest(spark):
    r = np.random.default_rng(4)
    points = r.random((9, 2)).round(1)
    d = np.linalg.norm(points[:, None] - points[None], axis=2)
    rows = [(g, i, k, float(d[i, k])) for g in ("a", "b") for i in range(9) for k in range(9) if i != k and (g == "a" or i < 5 and k < 5)]
    got = rankings.nearest_path(spark.createDataFrame(rows, "path string, i long, k long, d double").repartition(3), 2).orderBy("path", "step").collect()
    for g, n in (("a", 9), ("b", 5)):
        at, left, want = 2, set(range(n)) - {2}, [2]
        while left:
            at = min(left, key=lambda k: (d[at, k], k))
            left.discard(at)
            want.append(at)
        assert [x.k for x in got if x.path == g] == want


def test_scaling_with_a_small_number(spark):
    m = spark.createDataFrame([(0, 0, 1.0), (0, 1, 3.0), (1, 0, 2.0), (1, 1, 2.0)], "i int, j int, v double")
    assert {(x.i, x.j): x.v for x in matrix.minmax(m, "i", 1e-8).collect()} == pytest.approx({(0, 0): 0.0, (0, 1): 1.0, (1, 0): 0.0, (1, 1): 0.0})
    with pytest.raises(ValueError):
        matrix.fill_rows(m, m.select("i"), m.select("j"), "other")
    rows, columns = spark.range(3).select("id").withColumnRenamed("id", "i"), spark.range(2500).withColumnRenamed("id", "j")
    grid = matrix.dense_grid(rows, columns)  # names in three blocks
    assert grid.count() == grid.distinct().count() == 7500
