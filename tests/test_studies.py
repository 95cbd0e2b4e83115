"""Components, linear attribution, windows, coverage, contacts, region reads and scoring runs against plain computation."""

from __future__ import annotations

import random
from pathlib import Path

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from varsparq.operators import components, contacts, linear, scoring, submatrix
from varsparq.sources import genotypes


def _cells(spark, m):
    i, j = np.nonzero(m)
    return spark.createDataFrame(pd.DataFrame({"i": i, "j": j, "v": m[i, j]})).repartition(3)


def test_components_are_those_of_the_covariance(spark):
    r = np.random.default_rng(1)
    m = r.normal(size=(60, 5)) @ np.diag([5, 3, 2, 1, 0.5]) @ r.normal(size=(5, 30)) + 0.1 * r.normal(size=(60, 30)) + 3
    m[r.random(m.shape) < 0.1] = 0
    pca = components.principal_components(_cells(spark, m), 3, extra=4)
    centred = m - m.mean(0)
    values, vectors = np.linalg.eigh(np.cov(m, rowvar=False))
    values, vectors = values[::-1], vectors[:, ::-1]
    assert np.allclose(pca.values, values[:3], rtol=1e-9) and pca.total == pytest.approx(values.sum())
    got = pca.vectors.toPandas().pivot(index="j", columns="component", values="v").to_numpy()
    sign = np.sign((got * vectors[:, :3]).sum(0))
    assert np.allclose(got, vectors[:, :3] * sign, atol=1e-6)
    assert all(got[np.abs(got[:, c]).argmax(), c] > 0 for c in range(3))
    rows = pca.projections.toPandas().pivot(index="i", columns="component", values="v").to_numpy()
    assert np.allclose(rows, centred @ vectors[:, :3] * sign, atol=1e-5)
    assert max(pca.residuals) <= 1e-7 * values[0]
    cosines = {r.component: r.cosine for r in components.half_cosines(pca, 15).collect()}
    for c in range(3):
        a, b = got[:15, c], got[15:, c]
        assert cosines[c] == pytest.approx(a @ b / np.linalg.norm(a) / np.linalg.norm(b), abs=1e-6)


def test_components_of_odd_tables(spark):
    empty = spark.createDataFrame([], "i long, j long, v double")
    assert components.principal_components(empty, 2).values == []
    flat = components.principal_components(spark.createDataFrame([(i, 0, 2.0) for i in range(4)], "i long, j long, v double"), 2)
    assert flat.values == pytest.approx([0.0], abs=1e-12)
    two = components.principal_components(spark.createDataFrame([(0, 0, 1.0), (1, 1, 1.0), (2, 0, 3.0), (2, 1, None)], "i long, j long, v double"), 5)
    assert two.values == pytest.approx(np.linalg.eigvalsh(np.cov(np.array([[1, 0], [0, 1], [3, 0]]), rowvar=False))[::-1])


def _model(seed, n=50, p=7, sites=3):
    r = np.random.default_rng(seed)
    x = (r.random((n, p)) < 0.4).astype(float)
    x[:, 1] = np.where(r.random(n) < 0.8, x[:, 0], x[:, 1])
    return x, x @ r.normal(size=(p, sites)) + r.normal(size=(n, sites)) * 0.3 + 2


def _frames(spark, models):
    xs, ys = [], []
    for name, (x, y) in models.items():
        xs += [(name, int(i), f"chr1:{100 + j}-{101 + j}_A_G", float(x[i, j])) for i in range(len(x)) for j in range(x.shape[1]) if x[i, j]]
        ys += [(name, int(i), f"chr1:{150 + t}-{151 + t}_C_T", float(y[i, t])) for i in range(len(y)) for t in range(y.shape[1])]
    return spark.createDataFrame(xs, "model string, i long, j string, v double"), spark.createDataFrame(ys, "model string, i long, site string, y double")


def test_ridge_and_lasso_of_many_targets(spark):
    models = {"a": _model(1), "b": _model(2, 30, 4, 2)}
    x, y = _frames(spark, models)
    y = y.union(spark.createDataFrame([("a", 999, "chr1:150-151_C_T", 5.0)], y.schema))  # a row without all targets goes
    x = x.union(spark.createDataFrame([("a", 999, "chr1:100-101_A_G", 1.0)], x.schema))
    for kind, alpha in (("ridge", 1.5), ("lasso", 0.08)):
        got = {(r.model, r.wt_variant, r.site): r for r in linear.interactions(x.repartition(3), y, kind, alpha).collect()}
        assert len(got) == 7 * 3 + 4 * 2
        assert kind == "ridge" or any(r.interaction_strength == 0 and r.outlier_type == "neutral" for r in got.values())
        for name, (mx, my) in models.items():
            cx, cy = mx - mx.mean(0), my - my.mean(0)
            w = np.array([[got[name, f"chr1:{100 + j}-{101 + j}_A_G", f"chr1:{150 + t}-{151 + t}_C_T"].interaction_strength_signed for t in range(my.shape[1])] for j in range(mx.shape[1])])
            if kind == "ridge":
                assert np.allclose(w, np.linalg.solve(cx.T @ cx + alpha * np.eye(len(w)), cx.T @ cy))
            else:  # the conditions of a least value
                slope = cx.T @ (cy - cx @ w) / len(cx)
                assert np.all(np.abs(slope) <= alpha + 1e-9) and np.allclose(slope[w != 0], alpha * np.sign(w[w != 0]), atol=1e-9) and (w != 0).any()
    r = got["a", "chr1:100-101_A_G", "chr1:150-151_C_T"]
    assert (r.wt_position, r.clinical_position, r.position_distance, r.n_haplotypes) == (100, 150, 50, models["a"][0][:, 0].sum())
    assert r.interaction_strength_weighted == pytest.approx((r.interaction_strength * r.n_haplotypes) ** 0.5)


def test_models_are_fitted_once(spark, tmp_path):
    path = str(tmp_path / "models")
    x, y = _frames(spark, {"a": _model(1), "b": _model(2), "c": _model(3)})
    first = {tuple(r) for r in linear.interactions_cached(x, y.where("model <> 'c'"), path).collect()}
    changed = y.withColumn("y", F.when(F.col("model") == "c", F.col("y")).otherwise(0.0))  # a and b aren't looked at again
    whole = {tuple(r) for r in linear.interactions_cached(x, changed, path).collect()}
    assert first < whole and {r[0] for r in whole - first} == {"c"}
    assert {tuple(r) for r in linear.interactions_cached(x, y, path).collect()} == whole
    forced = linear.interactions_cached(x.where("model = 'a'"), y.where("model = 'a'"), path, force=True)
    assert {r.model for r in forced.select("model").distinct().collect()} == {"a"}


def test_epistasis_across_models(spark):
    models = {"a": _model(1), "b": _model(2), "few": _model(3, 8)}
    x, y = _frames(spark, models)
    sums = linear.pair_sums(x, y)
    joint = linear.interactions(x, y).select("model", "site", F.col("wt_variant").alias("j"), F.col("interaction_strength_signed").alias("coef"))
    got = {(r.model, r.j, r.site): r for r in linear.cross_model_epistasis(sums, joint, 1.0).collect()}
    effects = {}
    for mx, my in models.values():
        for j in range(mx.shape[1]):
            held = mx[:, j] > 0.5
            if held.any() and not held.all():
                effects.setdefault(j, []).extend(my[held].mean(0) - my[~held].mean(0))
    for name, (mx, my) in models.items():
        for j in range(mx.shape[1]):
            for t in range(my.shape[1]):
                r = got[name, f"chr1:{100 + j}-{101 + j}_A_G", f"chr1:{150 + t}-{151 + t}_C_T"]
                assert r.wt_individual_effect == pytest.approx(np.mean(effects[j]))
                if name == "few":
                    assert r.epistasis_fstat is None and r.is_epistatic is False
                    continue
                w, v = mx[:, j] - mx[:, j].mean(), my[:, t] - my[:, t].mean()
                d = r.joint_effect - r.wt_individual_effect
                rss = []
                for design in (w[:, None], np.column_stack([w, w * d])):
                    b = np.linalg.solve(design.T @ design + np.eye(design.shape[1]), design.T @ v)
                    rss.append(((v - design @ b) ** 2).sum())
                    if design.shape[1] == 1:
                        assert r.epistasis_coefficient == pytest.approx(b[0] - r.wt_individual_effect)
                n = len(v)
                assert r.epistasis_fstat == pytest.approx(max(0, (rss[0] - rss[1]) / (rss[1] / (n - 3))), abs=1e-8)
                assert r.additive_r2 == pytest.approx(1 - rss[0] / (v @ v)) and r.interaction_mse == pytest.approx(rss[1] / n)
    summary = linear.epistasis_summary(linear.cross_model_epistasis(sums, joint, 1.0)).first()
    assert summary.n_tested == summary.n_epistatic + summary.n_additive == 2 * 21


def test_dense_window_is_the_first(spark):
    r = np.random.default_rng(2)
    m = (r.random((23, 17)) < 0.15).astype(int)
    m[9:14, 6:11] = 1
    ones = _cells(spark, m)
    sums = {(r.i, r.j): r.s for r in submatrix.window_sums(ones, 23, 17, 5, 4).collect()}
    assert sums == {(i, j): m[i : i + 5, j : j + 4].sum() for i in range(19) for j in range(14)}
    for least, most in ((0.7, 1.0), (0.0, 0.0), (0.3, 0.4), (1.1, 2.0)):
        want = next(((i, j) for i in range(19) for j in range(13) if least <= m[i : i + 5, j : j + 5].mean() <= most), None)
        got = submatrix.dense_window(ones, 23, 17, 5, 5, least, most).collect()
        assert [(g.i, g.j) for g in got] == ([want] if want else [])
    found = submatrix.dense_window(ones, 23, 17, 5, 5, 0.9, 1.0)
    i, j = found.first()[:2]
    assert {r.i for r in submatrix.with_any_one(ones, found, 5, 5, "i").collect()} == set(np.flatnonzero(m[:, j : j + 5].any(1)).tolist())
    assert {r.j for r in submatrix.with_any_one(ones, found, 5, 5, "j").collect()} == set(np.flatnonzero(m[i : i + 5].any(0)).tolist())


def test_coverage_is_base_by_base(spark):
    draw = random.Random(6)
    rows = [(draw.choice(["hot", "hot", "c2"]), s := draw.randint(0, 300), s + draw.randint(0, 12)) for _ in range(400)] + [("c3", 5, None), ("c3", 9, 4)]
    got = submatrix.coverage(spark.createDataFrame(rows, "c string, start int, end int").repartition(5), ["c"]).collect()
    depth = {}
    for c, s, e in rows:
        for k in range(s, e or 0):
            depth[c, k] = depth.get((c, k), 0) + 1
    assert {(r.c, k): r.depth for r in got for k in range(r.start, r.end)} == depth
    ends = {(r.c, r.start): r for r in got}
    assert all(ends[r.c, r.end].depth != r.depth for r in got if (r.c, r.end) in ends)  # stretches are as long as can be


def test_annotation_tracks(spark):
    beds = [("exon", "1", 10, 20, "+"), ("exon", "1", 10, 20, "+"), ("exon", "1", 15, 30, "+"), ("exon", "1", 30, 35, "+"), ("exon", "1", 12, 14, "-"), ("exon", "2", 0, 9, "."), ("utr", "1", 100, 200, "-")]
    regions = [("1", "a", 12, 32), ("1", "b", 150, 151), ("2", "c", 0, 50)]
    got = submatrix.annotation_tracks(spark.createDataFrame(regions, "chrom string, region string, start int, end int"), spark.createDataFrame(beds, "name string, chrom string, start int, end int, strand string"), 16)
    assert sorted(map(tuple, got.collect())) == [("a", "exon_neg", 0, 2), ("a", "exon_pos", 0, 20), ("b", "utr_neg", 0, 1)]


def test_contacts_follow_covariance(spark):
    r = np.random.default_rng(3)
    effect, contact = r.normal(size=(12, 33, 2)), r.random((8, 8)).round(1)
    h, p, t = np.indices(effect.shape).reshape(3, -1)
    effects = spark.createDataFrame(pd.DataFrame({"hap": h, "pos": p, "track": t, "v": effect.ravel()})).repartition(3)
    a, b = np.indices(contact.shape).reshape(2, -1)
    table = spark.createDataFrame(pd.DataFrame({"a": a, "b": b, "contact": contact.ravel()}))
    pairs = contacts.contact_pairs(contacts.bin_covariance(effects, 33, 8), table, 2)
    binned = effect[:, :32].reshape(12, 8, 4, 2).mean(2)
    flat = (binned - binned.mean(0)).transpose(1, 0, 2).reshape(8, -1)
    cov = flat @ flat.T / 24
    want = {(i, j): (cov[i, j], contact[i, j]) for i in range(8) for j in range(i + 2, 8)}
    got = {(x.a, x.b): (x.covariance, x.contact) for x in pairs.collect()}
    assert got.keys() == want.keys() and all(np.allclose(got[k], want[k]) for k in want)
    cv, ct = np.array(list(want.values())).T
    rank = lambda v: np.array([(v < x).sum() + ((v == x).sum() + 1) / 2 for x in v])
    assert contacts.contact_correlation(pairs).first().correlation == pytest.approx(np.corrcoef(rank(cv), rank(ct))[0, 1])
    assert contacts.contact_correlation(pairs, "pearson").first().correlation == pytest.approx(np.corrcoef(cv, ct)[0, 1])
    edges = np.percentile(ct, np.linspace(0, 100, 6))
    inside = [(ct >= edges[q]) & ((ct < edges[q + 1]) | ((q == 4) & (ct <= edges[q + 1]))) for q in range(5)]
    found = {x.quantile: (x.n, x.mean_contact, x.mean_covariance) for x in contacts.contact_quantiles(pairs, 5).collect()}
    assert found.keys() == {q + 1 for q in range(5) if inside[q].any()}
    for q, (n, c, v) in found.items():
        assert n == inside[q - 1].sum() and (c, v) == pytest.approx((ct[inside[q - 1]].mean(), cv[inside[q - 1]].mean()))
    with pytest.raises(ValueError):
        contacts.bin_covariance(effects, 5, 8)


VCF = """##x
#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\ts1\ts2
chr1\t100\t.\tA\tG\t.\t.\t.\tGT:DP\t0|1:3\t1/1:4
chr1\t2500000\t.\tC\tT,G\t.\t.\t.\tGT\t.|.\t2|0
chr2\t100\t.\tA\tG\t.\t.\t.\tGT\t.|1\t0|0
"""


def test_region_reads_touch_only_their_bins(spark, tmp_path):
    (tmp_path / "a.vcf").write_text(VCF)
    calls = genotypes.read_calls(spark, str(tmp_path / "a.vcf"))
    assert calls.count() == 12
    path = str(tmp_path / "binned")
    genotypes.write_binned(calls, path)
    region = genotypes.read_region(spark, path, "1", 1, 1_000_000)
    assert len(region.select(F.input_file_name()).distinct().collect()) == 1
    assert all("chrom=chr1/pos_bin=0" in f for f in (x[0] for x in region.select(F.input_file_name()).collect()))
    plan = region._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "pos_bin" in plan.split("PartitionFilters: [")[1].split("]")[0]
    got = {(r.haplotype, r.variant): r.v for r in genotypes.region_matrix({"x": region}).collect()}
    assert got == {("s1_0", "chr1:100-101_A_G"): 0, ("s1_1", "chr1:100-101_A_G"): 1, ("s2_0", "chr1:100-101_A_G"): 1, ("s2_1", "chr1:100-101_A_G"): 1}
    late = genotypes.read_region(spark, path, "chr1", 2_500_000, 2_500_001)
    assert {r.haplotype: r.v for r in genotypes.region_matrix({"x": late, "y": late}).where("cohort = 'y'").collect()} == {"s1_0": 0, "s1_1": 0, "s2_0": 1, "s2_1": 0}
    assert {(r.sample, r.dosage) for r in genotypes.dosages(late).collect()} == {("s1", None), ("s2", 2)}
    assert genotypes.read_region(spark, path, "chr1", 100, 100).count() == 0


@scoring.scorer("counted", ["A", "B"], batch_size=3)
def counted(wt, mut):
    """Notes each sequence it scores; fails for x, stops for STOP as long as a file is there."""
    folder = Path(wt.iloc[0].split("|")[0])
    names = [w.split("|")[1] for w in wt]
    if any(n.startswith("x") for n in names):
        raise ValueError("no score for x")
    if any(n.startswith("STOP") for n in names) and (folder / "stop").exists():
        raise scoring.StopScoring("stopped")
    with (folder / "log").open("a") as f:
        f.write("".join(f"{n}\n" for n in names))
    return pd.DataFrame({"A": [float(len(n)) for n in names], "B": [float("nan") if n == "nan" else 1.0 for n in names]}, index=wt.index)


def test_a_run_that_stops_goes_on(spark, tmp_path):
    names = [f"n{k}" for k in range(40)] + ["x1", "STOP"]
    pairs = spark.createDataFrame([(f"s{k % 5}", k, f"{tmp_path}|{n}", "") for k, n in enumerate(names)], "site string, sample long, seq_wt string, seq_mut string")
    keys, path = ["site", "sample"], str(tmp_path / "scores")
    (tmp_path / "log").write_text("")
    (tmp_path / "stop").write_text("")
    with pytest.raises(Exception, match="stopped"):
        scoring.resume(pairs, "counted", keys, path, batch_rows=8)
    before = scoring.read_results(spark, path, keys)
    done = 0 if before is None else before.select(*keys).distinct().count()
    committed = set() if before is None else {r.sample for r in before.select("sample").distinct().collect()}
    assert done < 41 and scoring.commits(spark, path).count() < 6
    (tmp_path / "log").write_text("")
    (tmp_path / "stop").unlink()
    scoring.resume(pairs, "counted", keys, path, batch_rows=8)
    again = (tmp_path / "log").read_text().split()
    assert sorted(again) == sorted(set(again)) and not committed & {names.index(n) for n in again}  # no second score
    results = scoring.read_results(spark, path, keys)
    assert results.count() == 2 * 41 and results.select(*keys, "slot").distinct().count() == 2 * 41
    errors = scoring.read_errors(spark, path, keys).collect()
    assert {(r.site, r.sample) for r in errors} == {("s0", 40)} and "ValueError: no score for x" in errors[0].error
    (tmp_path / "log").write_text("")
    scoring.resume(pairs, "counted", keys, path)
    assert (tmp_path / "log").read_text() == ""  # only the one with the error is tried again
    wide = scoring.wide_results(results, keys, ["A", "B"]).collect()
    assert len(wide) == 41 and {r.B for r in wide} == {1.0}


def test_limits_and_force(spark, tmp_path):
    pairs = spark.createDataFrame([(f"s{k % 4}", k // 4, "ACGT", "ACGG") for k in range(40)], "site string, sample long, seq_wt string, seq_mut string")
    keys, path = ["site", "sample"], str(tmp_path / "scores")
    scoring.resume(pairs, "gc_shift", keys, path, limit_sites=2, limit_samples=3)
    assert {(r.site, r.sample) for r in scoring.read_results(spark, path, keys).collect()} == {(s, k) for s in ("s0", "s1") for k in range(3)}
    scoring.resume(pairs, "gc_shift", keys, path, limit_sites=["s3"], site_filter=F.col("site") != "s0")
    assert scoring.read_results(spark, path, keys).count() == 2 * (6 + 10)
    changed = pairs.withColumn("seq_mut", F.lit("GGGG"))
    scoring.resume(changed, "gc_shift", keys, path, limit_sites=1, force=True, extra=True)
    got = scoring.read_results(spark, path, keys)
    assert got.where("slot in ('GC', 'LEN')").count() == 2 * (6 + 10 + 7)
    assert {(r.site, r.value) for r in got.where("slot = 'GC'").collect()} == {("s0", 0.5), ("s1", 0.25), ("s3", 0.25)}
    assert {r.value for r in got.where("slot = 'len_seq_mut'").collect()} == {4.0}
    assert scoring.resume(pairs.where("false"), "gc_shift", keys, str(tmp_path / "none")) == 0
    with pytest.raises(ValueError, match="no scorer"):
        scoring.model_of("unknown")
