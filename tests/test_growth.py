"""Steps that once grew faster than their input, against plain computations on small tables."""

from __future__ import annotations

import numpy as np

from varsparq.operators import components, matrix
from varsparq.sources import genotypes


def test_correlations_in_blocks_equal_numpy(spark, monkeypatch):
    monkeypatch.setattr(matrix, "CELLS", 12)
    r = np.random.default_rng(3)
    v = {(i, j): float(r.normal(7, 0.1)) for i in range(12) for j in range(6) if r.random() < 0.7} | {(20, 0): 1.0, (20, 7): 2.0} | {(i, 8): 0.1 for i in range(12)}
    m = spark.createDataFrame([(i, j, x) for (i, j), x in v.items()], "i long, j long, v double")
    got = {(x.j, x.k): (x.n, x.r) for x in matrix.correlations(m).collect()}
    want = {}
    for j in range(9):
        for k in range(j + 1, 9):
            rows = [i for i in range(21) if (i, j) in v and (i, k) in v]
            if rows:
                a, b = (np.array([v[i, c] for i in rows]) for c in (j, k))
                want[j, k] = len(rows), None if len(rows) == 1 or k == 8 else float(np.corrcoef(a, b)[0, 1])
    assert got.keys() == want.keys()
    for key, (n, c) in want.items():
        assert got[key][0] == n and (got[key][1] is None) == (c is None) and (c is None or abs(got[key][1] - c) < 1e-9), key


def test_bins_of_a_layout_grow_with_positions(spark, tmp_path):
    calls = spark.createDataFrame([(f"chr{k % 2 + 1}", k * 3_000_000, k) for k in range(200)], "chrom string, pos long, k int")
    assert genotypes.fitting_bin(calls.where("k < 3")) == genotypes.BIN
    size = genotypes.fitting_bin(calls, most=50)
    genotypes.write_binned(calls, str(tmp_path / "t"), size)
    assert size % genotypes.BIN == 0 and len(list((tmp_path / "t").glob("chrom=*/pos_bin=*"))) <= 52
    got = genotypes.read_region(spark, str(tmp_path / "t"), "1", 150_000_000, 170_000_000, size)
    assert sorted(r.k for r in got.collect()) == [50, 52, 54, 56]


def test_components_of_narrow_tables_shuffle_no_cells(spark):
    r = np.random.default_rng(8)
    x = r.normal(size=(40, 3)) * [5, 2, 1]
    m = spark.createDataFrame([(i, j, float(x[i, j])) for i in range(40) for j in range(3)], "i long, j int, v double")
    got = components.principal_components(m, 2, extra=1)
    assert np.allclose(got.values, np.sort(np.linalg.eigvalsh(np.cov(x.T)))[::-1][:2])
    assert np.allclose(sorted(v.v for v in got.projections.where("component = 0").collect()), sorted((x - x.mean(0)) @ np.array([v.v for v in got.vectors.where("component = 0").orderBy("j").collect()])))
    assert "Join" not in got.projections._jdf.queryExecution().toString()  # rows are records, vectors go to them
