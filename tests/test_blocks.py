"""Joins of many pairs send blocks, not rows."""

from __future__ import annotations

import numpy as np
import pytest

from varsparq.operators import intervals, matrix
from varsparq.storage import materialise


def test_blocks_are_sent_as_arrays(spark, monkeypatch):
    """What goes to several blocks is a row for each block; rows come back behind the shuffle, with all columns, nulls and repeats."""
    left = spark.range(900).selectExpr("id % 2 as k", "cast(id % 5 as string) as a", "if(id % 7 = 0, null, id / 8) as b", "array(id) as c")
    right = spark.range(500).selectExpr("id % 3 as k", "id % 300 as d")
    want = sorted(map(str, left.join(right, ["k"]).collect()))
    monkeypatch.setattr(intervals, "BLOCK", 40)
    monkeypatch.setattr(intervals, "PAIRS", 1000)
    got = intervals.spread_join(left, right, ["k"])
    assert got.columns == ["k", "a", "b", "c", "d"] and sorted(map(str, got.collect())) == want
    lines = got._jdf.queryExecution().optimizedPlan().toString().splitlines()
    sides = [k for k, x in enumerate(lines) if "RepartitionByExpression" in x]
    assert len(sides) == 2 and all("Generate explode" in "".join(lines[k - 3 : k]) for k in sides)


def test_keys_alone_meet_as_often_as_rows_do(spark, monkeypatch):
    monkeypatch.setattr(intervals, "BLOCK", 5)
    monkeypatch.setattr(intervals, "PAIRS", 10)
    left, right = spark.range(30).selectExpr("if(id = 3, null, id % 2) as k"), spark.range(20).selectExpr("id % 2 as k", "id as b")
    assert intervals.spread_join(left, right, ["k"]).count() == left.join(right, ["k"]).count() == 290


def _cells(spark, seed: int):
    r = np.random.default_rng(seed)
    v = {(f"r{i}", j): float(r.normal(5, 1)) for i in range(40) for j in range(25) if r.random() < 0.3} | {("alone", 99): 1.0}
    return v, spark.createDataFrame([(i, j, x) for (i, j), x in v.items()] + [(None, 3, 1.0), ("r1", None, 2.0)], "i string, j int, v double")


@pytest.mark.parametrize(("cells", "lines"), [(30, 2048), (60, 3), (10**6, 5), (2, 2)])
def test_blocks_of_cells_meet_without_copies(spark, monkeypatch, cells, lines):
    """Distances of named rows and correlations of columns, in many blocks and tiles, equal brute force; cells are not sent once for each block."""
    monkeypatch.setattr(matrix, "CELLS", cells)
    monkeypatch.setattr(matrix, "FEW_CELLS", cells)
    monkeypatch.setattr(matrix, "BLOCKS", 12)
    monkeypatch.setattr(matrix, "LINES", lines)
    v, m = _cells(spark, 4)
    near = matrix.distances(m)
    got = {(x.i, x.k): x.distance for x in near.collect()}
    rows, columns = (sorted({key[at] for key in v}) for at in (0, 1))
    want = {}
    for a, i in enumerate(rows):
        for k in rows[a + 1 :]:
            if shared := [j for j in columns if (i, j) in v and (k, j) in v]:
                want[i, k] = sum((v[i, j] - v[k, j]) ** 2 for j in shared) ** 0.5
    assert len(got) == near.count() and got == pytest.approx(want)
    found = matrix.correlations(m)
    got = {(x.j, x.k): (x.n, x.r) for x in found.collect()}
    want = {}
    for a, j in enumerate(columns):
        for k in columns[a + 1 :]:
            if shared := [i for i in rows if (i, j) in v and (i, k) in v]:
                x, y = (np.array([v[i, c] for i in shared]) for c in (j, k))
                want[j, k] = len(shared), float(np.corrcoef(x, y)[0, 1]) if len(shared) > 1 else None
    assert got.keys() == want.keys() and len(got) == found.count()
    assert all(got[p][0] == n and (got[p][1] is None if r is None else got[p][1] == pytest.approx(r)) for p, (n, r) in want.items())
    for frame in (near, found):
        plan = frame._jdf.queryExecution().optimizedPlan().toString()
        assert "Generate" not in plan and "Join" not in plan


def test_no_cells_have_no_pairs(spark):
    m = spark.createDataFrame([], "i long, j long, v double")
    assert matrix.distances(m).count() == matrix.correlations(m).count() == 0


def _anchor_pairs(points, contacts) -> list[tuple]:
    ends = {(c, n): [] for _, c, *_ in contacts for n in (0, 1)}
    for g, c, s1, e1, s2, e2 in contacts:
        for n, (s, e) in enumerate(((s1, e1), (s2, e2))):
            ends[c, n] += [i for h, i, p in points if h == g and s <= p < e]
    return sorted({(min(a, b), max(a, b), c) for _, c, *_ in contacts for a in ends[c, 0] for b in ends[c, 1] if a != b})


@pytest.mark.parametrize("repeated", [False, True])
def test_contacts_of_the_same_anchors_share_their_points(spark, monkeypatch, repeated):
    """What is written are points of distinct anchors; a contact of several rows pairs points of all of them."""
    points = [(k % 2, k, k * 7 % 30) for k in range(60)]
    contacts = [(k % 2, k, 3 * (k % 2), 9, 12, 17 + k % 2) for k in range(20)] + [(0, 5, 20, 25, 1, 2)] * repeated
    written = []
    monkeypatch.setattr(intervals, "materialise", lambda df, name: written.append(materialise(df, name)) or written[-1])
    got = intervals.anchor_pairs(spark.createDataFrame(points, "g long, id long, pos int"), spark.createDataFrame(contacts, "g long, contact long, a1_start int, a1_end int, a2_start int, a2_end int"), ["g"], 8)
    assert sorted(map(tuple, got.collect())) == _anchor_pairs(points, contacts)
    if not repeated:
        assert written[0].count() <= 2 * len(points)  # before: once for each contact
