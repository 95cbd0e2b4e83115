"""Ward merges, forest importances and collections of files against plain computation."""

from __future__ import annotations

import json

import numpy as np
import pandas as pd
import pytest

from varsparq.operators import clustering
from varsparq.sources import collections


def _ward_by_hand(points):
    """Merges one by one, always the nearest pair of clusters."""
    own = {i: [i] for i in range(len(points))}
    out = []
    while len(own) > 1:
        def d(a, b):
            x, y = points[own[a]], points[own[b]]
            return np.sqrt(2 * len(x) * len(y) / (len(x) + len(y))) * np.linalg.norm(x.mean(0) - y.mean(0))

        dist, a, b = min((d(a, b), a, b) for a in own for b in own if a < b)
        own[a] += own.pop(b)
        out.append((a, b, dist, len(own[a])))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_ward_merges_are_those_one_by_one(spark, seed):
    r = np.random.default_rng(seed)
    points = np.repeat(r.normal(size=(4, 3)) * 4, 4, axis=0)[:14] + r.normal(size=(14, 3))
    points[3, 1] = 0
    i, j = np.nonzero(points)
    got = clustering.ward(spark.createDataFrame(pd.DataFrame({"i": i, "j": j, "v": points[i, j]}))).orderBy("step").collect()
    want = _ward_by_hand(points)
    assert [(r.left, r.right, r.size) for r in got] == [(a, b, n) for a, b, _, n in want]
    assert np.allclose([r.distance for r in got], [d for _, _, d, _ in want])
    assert clustering.ward(spark.createDataFrame([(1, 1, 2.0)], "i int, j int, v double")).count() == 0


def test_centroids(spark):
    cells = spark.createDataFrame([("s1", "x", 2.0), ("s2", "x", 4.0), ("s2", "y", 1.0), ("s3", "y", 5.0)], "i string, j string, v double")
    members = spark.createDataFrame([("s1", "A"), ("s2", "A"), ("s3", "B"), ("s3", "B")], "sample string, pop string")
    got = {(r.i, r.j): r.v for r in clustering.centroids(cells, members, "sample", "pop").collect()}
    assert got == {("A", "x"): 3.0, ("A", "y"): 0.5, ("B", "y"): 5.0}


def test_the_true_feature_wins(spark):
    r = np.random.default_rng(4)
    rows, clusters = [], []
    for k in range(120):
        c = k % 3
        clusters.append((f"s{k}", str(c)))
        for f in range(6):
            v = r.normal() + (4.0 * c if f == 2 else 0)
            rows += [(f"s{k}", f"site{f}_0", v / 2), (f"s{k}", f"site{f}_1", v / 2)]
    clusters += [("REF", "1"), ("noise", "-1")]
    rows += [("REF", "site0_0", 99.0), ("noise", "site1_0", 99.0)]
    cells, told = spark.createDataFrame(rows, "i string, j string, v double"), spark.createDataFrame(clusters, "i string, cluster string")
    top = clustering.feature_importances(cells, told, top=2, trees=20).orderBy("importance", ascending=False).collect()
    assert len(top) == 2 and top[0].site == "site2" and top[0].importance > 0.7
    again = clustering.feature_importances(cells, told, top=2, trees=20).orderBy("importance", ascending=False).collect()
    assert again == top
    each = clustering.feature_importances(cells, told, top=1, trees=20, one_vs_rest=True).collect()
    assert {(r.cluster, r.site) for r in each} == {("0", "site2"), ("1", "site2"), ("2", "site2")}
    assert clustering.feature_importances(cells.where("false"), told, trees=5).count() == 0


def test_functions_over_a_collection(spark, tmp_path):
    for name, n in (("a_chr1", 3), ("b_chr22", 5), ("c_chrX", 0), ("d", 2)):
        (tmp_path / f"{name}.trees.json").write_text(json.dumps({"n": n}) if n else "broken")
    (tmp_path / "other.txt").write_text("x")
    names = spark.createDataFrame([("a_chr1", "first")], "name string, note string")
    c = collections.read_collection(spark, str(tmp_path), ".trees.json", names)
    assert {(r.name, r.chromosome, r.note) for r in c.drop("content").collect()} == {("a_chr1", "chr1", "first"), ("b_chr22", "chr22", None), ("c_chrX", "chrX", None), ("d", None, None)}

    def sizes(name, content):
        return [{"n": k, "first": name[0]} for k in range(json.loads(content)["n"])]

    got = collections.map_members(c, sizes, "n int, first string").collect()
    assert sorted((r.name, r.n) for r in got if not r.error) == [(n, k) for n, m in (("a_chr1", 3), ("b_chr22", 5), ("d", 2)) for k in range(m)]
    assert [(r.name, r.n) for r in got if r.error] == [("c_chrX", None)] and "JSONDecodeError" in next(r.error for r in got if r.error)
    assert {r.name for r in collections.filter_members(c, lambda x: json.loads(x)["n"] > 2).select("name").collect()} == {"a_chr1", "b_chr22"}
    batches = collections.map_batches(c, lambda ms: [{"names": ",".join(n for n, _ in ms)}], "names string", 3).orderBy("batch").collect()
    assert [(r.batch, r.names) for r in batches] == [(0, "a_chr1,b_chr22,c_chrX"), (1, "d")]
