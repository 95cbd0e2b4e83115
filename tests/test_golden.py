"""Cases with known results, and joins against brute force."""

from __future__ import annotations

import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from varsparq.functions import metrics, text
from varsparq.operators import attribution, haplotypes, intervals, summaries
from varsparq.sources import variants


def one(df):
    return df.first()[0]


def test_scalars(spark):
    row = spark.createDataFrame([("chr5", 218352, "A", "G", "ATCG", "MONDO:1|MONDO:MONDO:2,OMIM:7")], "c string, s long, r string, a string, d string, t string")
    assert one(row.select(text.variant_key(F.col("c"), F.col("s"), F.col("r"), F.col("a")))) == "chr5:218352-218353_A_G"
    assert one(row.select(text.transcribe(F.col("d")))) == "aucg"
    assert one(row.select(text.short_site(F.lit("chr1:100-101_A_G")))) == "chr1:100 A>G"
    assert one(row.select(text.ontology_ids(F.col("t"), "OMIM"))) == ["OMIM:7"]
    assert one(row.select(metrics.log2_ratio(F.lit(1.0), F.lit(3.0)))) == np.log2(3.000001 / 1.000001)
    soft = np.array(one(row.select(metrics.softmax(F.array(F.lit(1.0), F.lit(2.0), F.lit(-1.0))))))
    assert np.allclose(soft, np.exp([1, 2, -1]) / np.exp([1, 2, -1]).sum())


def test_alignment(spark):
    seqs = spark.createDataFrame([("a", "ATG", [100, 101, 103]), ("b", "ACG", [100, 102, 103])], "name string, seq string, coords array<int>")
    assert {r.name: r.row for r in haplotypes.alignment(seqs).collect()} == {"a": "AT-G", "b": "A-CG"}


def test_window_flags(spark):
    rows = [("AACGT", [1, 2, 3, 4, 5], 3, "T"), ("AACGT", [1, 2, 3, 4, 5], 3, "C"), ("AACGT", [1, 2, 4, 5, 6], 3, "C")]
    got = haplotypes.variant_window(spark.createDataFrame(rows, "seq string, coords array<int>, pos int, alt string"), 1).collect()
    assert [(r.flag, r.window) for r in got] == [(0, "ATG"), (1, "ACG"), (2, "NNN")]


def test_splice_regions(spark):
    exons = spark.createDataFrame([("chr1", 100, 200, "x", "+"), ("chr1", 100, 200, "y", "-")], "chrom string, start int, end int, name string, strand string")
    got = {(r.strand, r.region): (r.r_start, r.r_end) for r in intervals.splice_regions(exons).collect()}
    assert got["+", "5ss_can"] == (200, 202) and got["+", "bp_region"] == (60, 83) and got["+", "3ss_iprox"] == (83, 98)
    assert got["-", "5ss_can"] == (98, 100) and got["-", "bp_region"] == (217, 240) and got["-", "exon_core"] == (103, 197)


def test_interval_join_is_brute_force(spark):
    draw = random.Random(3)
    make = lambda: [(k, s := draw.randint(0, 300), s + draw.randint(1, 40)) for k in range(120)]
    a, b = make(), make()
    left, right = spark.createDataFrame(a, "a int, l_start int, l_end int"), spark.createDataFrame(b, "b int, r_start int, r_end int")
    got = sorted((r.a, r.b) for r in intervals.interval_join(left, right, [], 16).select("a", "b").collect())
    assert got == sorted((x[0], y[0]) for x in a for y in b if x[1] < y[2] and y[1] < x[2])


def test_ridge_is_direct_solution(spark):
    r = np.random.default_rng(1)
    w, y = r.integers(0, 2, 60).astype(float), r.normal(size=60)
    df = spark.createDataFrame(pd.DataFrame({"k": 0.7, "w": w, "y": y}))
    got = attribution.ridge_epistasis(df, ["k"], "w", "y", F.col("k"), 2.0).first()
    x = np.column_stack([w - w.mean(), 0.7 * (w - w.mean())])
    coef = np.linalg.solve(x.T @ x + 2 * np.eye(2), x.T @ (y - y.mean()))
    assert np.isclose(got.interaction_coef, coef[1]) and np.isclose(got.beta_int, coef[0] + 0.7 * coef[1])


def test_vcf(spark, tmp_path):
    (tmp_path / "x.vcf").write_text("##x\n#CHROM\tPOS\n1\t100\trs1\tA\tG,T\t.\t.\tMC=SO:1|miss;CLNDISDB=MONDO:1,OMIM:2\n")
    r = variants.read_vcf(spark, str(tmp_path / "x.vcf"), ["MC", "CLNDISDB"]).first()
    assert (r.chrom, r.pos, r.alt, r.MC_id, r.MC_term, r.MONDO, r.OMIM_n, r.MeSH) == ("1", 100, ["G", "T"], "SO:1", "miss", ["MONDO:1"], 1, [])


def test_wasserstein_is_brute_force(spark):
    draw = random.Random(5)
    rows = [("k", draw.choice([None, *range(6)]), draw.random() < 0.4) for _ in range(200)]
    frame = spark.createDataFrame([(k, None if v is None else float(v), a) for k, v, a in rows] + [("one side", 1.0, True)], "k string, v double, a boolean")
    got = {r.k: r for r in summaries.wasserstein(frame, ["k"], "v", F.col("a")).collect()}
    a, b = ([v for _, v, x in rows if v is not None and x == side] for side in (True, False))
    want = sum(abs(np.mean(np.array(a) <= t) - np.mean(np.array(b) <= t)) for t in range(5))
    assert set(got) == {"k"} and abs(got["k"].distance - want) < 1e-12
    assert (got["k"].n_a, got["k"].n_b) == (len(a), len(b))


def test_ancestors(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "b"), ("a", "b"), ("d", "b"), (None, "c"), ("e", None)], "child string, parent string")
    got = summaries.ancestors(edges)
    assert {(r.child, r.ancestor): r.level for r in got.collect()} == {("a", "b"): 1, ("a", "c"): 2, ("b", "c"): 1, ("b", "b"): 2, ("c", "b"): 1, ("c", "c"): 2, ("d", "b"): 1, ("d", "c"): 2}
    pairs = spark.createDataFrame([("a", "d"), ("a", "x")], "id1 string, id2 string")
    assert [tuple(r) for r in summaries.common_ancestor(got, pairs).collect()] == [("a", "d", "b", 2)]
    assert summaries.ancestors(edges.where("false")).count() == 0
    with pytest.raises(ValueError, match="deeper"):
        summaries.ancestors(spark.createDataFrame([(i, i + 1) for i in range(5)], "child int, parent int"), rounds=3)


def test_middle_and_order(spark):
    row = spark.createDataFrame([([1, 2, 3, 4, 5], [1], "x")], "long array<int>, short array<int>, c string")
    assert tuple(row.select(summaries.middle(F.col("long"), 3), summaries.middle(F.col("short"), 3), summaries.by_custom_order(F.col("c"), ["y"])).first()) == ([2, 3, 4], [1], 2)


def test_matrix_queries_read_every_cell(spark, tmp_path):
    from varsparq.plans import catalog

    draw = random.Random(8)
    lines = [(k, draw.randint(0, 90), draw.randint(0, 45), 1, 2.0, draw.uniform(2, 9), 0.1, "ANR"[k % 3]) for k in range(900)]
    spark.createDataFrame(lines, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_returnflag string").write.parquet(str(tmp_path / "lineitem.parquet"))
    cells = {}
    for _, i, j, _, q, p, *_ in lines:
        cells.setdefault((i, j), []).append(np.log(p / q))
    cells = {k: np.mean(v) for k, v in cells.items()}
    rows, columns = sorted({i for i, _ in cells}), sorted({j for _, j in cells})
    grid = np.array([[cells.get((i, j), np.nan) for j in columns] for i in rows])
    table = lambda a: {(i, j): a[x, y] for x, i in enumerate(rows) for y, j in enumerate(columns) if not np.isnan(a[x, y])}
    bins = {}
    for (i, j), v in cells.items():
        bins.setdefault((i // 6, j // 6), []).append(v)
    low, high = np.nanmin(grid, 0), np.nanmax(grid, 0)
    near = {(i, k): np.sqrt(np.nansum((grid[x] - grid[y]) ** 2)) for x, i in enumerate(rows) for y, k in enumerate(rows) if i < k and (~np.isnan(grid[x] - grid[y])).any()}
    both = {(j, k): ~np.isnan(grid[:, x] + grid[:, y]) for x, j in enumerate(columns) for y, k in enumerate(columns) if j < k}
    corr = {(j, k): np.corrcoef(grid[at, columns.index(j)], grid[at, columns.index(k)])[0, 1] for (j, k), at in both.items() if at.sum() > 1}
    want = {
        "x01_normalize_rows_whole": table(grid / np.nansum(grid, 1, keepdims=True)),
        "x05_bin_matrix_whole": {k: np.mean(v) for k, v in bins.items()},
        "x07_minmax_whole": table((grid - low) / (high - low)),
        "x08_fill_missing_whole": table(np.where(np.isnan(grid), np.nanmean(grid, 0), grid)),
        "x10_distances_whole": near,
        "x11_correlations_whole": corr,
    }
    for name, cells in want.items():
        got = {(r[0], r[1]): r[-1] for r in catalog.queries()[name](spark, str(tmp_path)).collect() if r[-1] is not None}
        assert got.keys() == cells.keys() and all(abs(got[k] - v) < 2e-6 for k, v in cells.items()), name


def test_semi_join_takes_every_region(spark, tmp_path):
    from varsparq.plans import catalog

    spark.createDataFrame([(k, 1 + k % 50) for k in range(300)], "p_partkey long, p_size int").write.parquet(str(tmp_path / "part.parquet"))
    spark.createDataFrame([(k, k * 3 % 25) for k in range(90)], "s_suppkey long, s_nationkey int").write.parquet(str(tmp_path / "supplier.parquet"))
    got = catalog.queries()["j07_interval_semi_join_whole"](spark, str(tmp_path)).collect()
    want = {a for a in range(300) if any(k * 3 % 25 == a % 25 and 1 + a % 50 < k % 60 + 2 and k % 60 < 4 + a % 50 for k in range(90))}
    assert len(got) == len(want) < 300 and {r.a for r in got} == want
