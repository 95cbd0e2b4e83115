"""Grids are written gap by gap, with values that are rounded before."""

from __future__ import annotations

from pathlib import Path

import pytest

import __spark_entry__ as entry
from varsparq.operators import matrix, summaries

SMALL = Path("/root/testdata/sf0.001")


def test_gaps_of_tiles_equal_brute_force(spark, monkeypatch):
    """Full and empty rows, first and last cells, text names, one null value, ends of tiles."""
    monkeypatch.setattr(matrix, "SIDE", 3)
    held = {(i, j): i + j / 8 for i in range(8) for j in range(7) if i == 2 or (i != 4 and (i * 5 + j) % 3 == 0) or j in (0, 6) and i == 7}
    m = spark.createDataFrame([(f"s{i}", j, v) for (i, j), v in held.items()] + [("s4", 3, None)], "i string, j int, v double")
    grid = matrix.fill_rows(m, how=0.123456, digits=2)
    got = [(r.i, r.j, r.v) for r in grid.collect()]
    assert sorted(got) == sorted((f"s{i}", j, round(held[i, j] * 100 + 1e-9) / 100 if (i, j) in held else 0.12) for i in range(8) for j in range(7))
    plan = grid._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "array_except" not in plan


@pytest.mark.skipif(not SMALL.exists(), reason="the driver's tables")
@pytest.mark.parametrize("name", ["x08_fill_missing_whole", "a13_matrix_fill_mean", "a13_matrix_fill_median", "a13_matrix_fill_mode"])
def test_a_fill_is_rounded_once(spark, name):
    plan = entry.queries()[name](spark, str(SMALL))._jdf.queryExecution().optimizedPlan().toString()
    cells = plan[: plan.index("Generate posexplode")].split("Relation")[-1]
    assert "round(" not in cells and "BigDecimal" not in cells, cells


def test_fill_of_a_whole_matrix_is_rounded(spark):
    cells = spark.createDataFrame([(1, 1, 0.25), (2, 2, 0.5), (3, 1, 0.126)], "a int, b int, v double")
    got = {(r.a, r.b): r.v for r in summaries.filled_matrix(cells, "a", "b", "mean", 2).collect()}
    assert got == {(1, 1): 0.25, (1, 2): 0.29, (2, 1): 0.29, (2, 2): 0.5, (3, 1): 0.13, (3, 2): 0.29}
