"""Statistical tests between groups: permutations, rank tests, effect sizes by name, curves of classifiers."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from varsparq.operators import attribution
from varsparq.operators.ordering import running_totals, value_ranks
from varsparq.storage import materialise


#: Permutations that share a copy of the rows.
DRAWS = 4


def permuted_wasserstein(df: DataFrame, key: str, value: str, is_a: Column, permutations: int, seed: int) -> DataFrame:
    """Observed distance of two groups of each key, and p = (permutations at or above it + 1) / (permutations + 1) (T-02).

    Each permutation gives the rows of a key a seeded order; as many as group a has come first and play group a.
    Rows are dealt once for each of DRAWS permutations, which are drawn where they arrive; keys are groups of samples, not whole tables.
    """
    sets = -(-(permutations + 1) // DRAWS)
    rows = df.where(F.col(value).isNotNull()).select(key, F.col(value).alias("_v"), is_a.alias("_a"))
    rows = rows.withColumn("_id", F.row_number().over(Window.partitionBy(key).orderBy("_v", "_a")))
    told = rows.withColumns({"_n": F.count_if("_a").over(Window.partitionBy(key)), "_m": F.count("*").over(Window.partitionBy(key))}).where("_n > 0 and _n < _m")
    dealt = told.withColumn("_set", F.explode(F.sequence(F.lit(0), F.lit(sets - 1)))).repartition(key, "_set")
    each = dealt.withColumn("_perm", F.explode(F.sequence(F.col("_set"), F.lit(permutations), F.lit(sets))))
    order = F.when(F.col("_perm") == 0, (~F.col("_a")).cast("long")).otherwise(F.xxhash64(F.lit(seed), "_perm", "_id"))
    one = Window.partitionBy(key, "_set", "_perm")  # within a dealt copy: nothing below is shuffled
    drawn = each.withColumn("_first", F.row_number().over(one.orderBy(order, "_id")) <= F.col("_n"))
    steps = drawn.groupBy(key, "_set", "_perm", "_n", "_m", "_v").agg(F.count_if("_first").alias("_in"), F.count_if(~F.col("_first")).alias("_out"))
    by_value = one.orderBy("_v")
    upto = by_value.rowsBetween(Window.unboundedPreceding, 0)
    gap = F.abs(F.sum("_in").over(upto) / F.col("_n") - F.sum("_out").over(upto) / (F.col("_m") - F.col("_n")))
    area = steps.withColumn("_area", gap * (F.lead("_v").over(by_value) - F.col("_v")))
    found = materialise(area.groupBy(key, "_set", "_perm").agg(F.coalesce(F.sum("_area"), F.lit(0.0)).alias("distance")), "permutations")
    observed = found.where("_perm = 0").select(key, F.col("distance").alias("observed"))
    null = found.where("_perm > 0").join(observed, key)
    return null.groupBy(key, "observed").agg(((F.count_if(F.col("distance") >= F.col("observed") - 1e-12) + 1) / (F.count("*") + 1)).alias("p"))


def normal_tail(z: Column) -> Column:
    """Two-sided tail probability of a standard normal value, by a rational approximation of the error function (1.5e-7).

    Fixed values: the coefficients of the approximation.
    """
    x = F.abs(z) / F.sqrt(F.lit(2.0))
    t = 1 / (1 + 0.3275911 * x)
    poly = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429))))
    return F.when(z.isNotNull(), F.least(poly * F.exp(-x * x), F.lit(1.0)))


def student_tail(t: Column, df: Column) -> Column:
    """Two-sided tail probability of Student's t with a whole number of degrees of freedom: the finite series, from 400 degrees on a normal value."""
    x = F.abs(t)
    c2 = df / (df + x * x)  # the squared cosine of atan(t / sqrt(df))
    angle, sine = F.atan(x / F.sqrt(df)), F.sqrt(1 - c2)
    odd = df % 2
    last = F.floor((df - 1 - odd) / 2)
    steps = F.when((df >= 2 + odd) & (df < 400), F.sequence(F.lit(1), F.greatest(last, F.lit(1)).cast("int")))
    first = F.when(odd == 1, F.sqrt(c2)).otherwise(F.lit(1.0))

    def step(a: Column, k: Column) -> Column:  # a term by its ratio to the one before
        term = a["term"] * c2 * (2 * k - 1 + odd) / (2 * k + odd)
        return F.struct(term.alias("term"), (a["sum"] + F.when(k <= last, term).otherwise(0.0)).alias("sum"))

    more = F.aggregate(steps, F.struct(first.alias("term"), first.alias("sum")), step, lambda a: a["sum"])
    series = F.coalesce(more, F.lit(0.0)) * sine  # one degree has no series
    inside = F.when(odd == 1, (angle + series) * (2 / math.pi)).otherwise(series)
    z = x * (1 - 1 / (4 * df)) / F.sqrt(1 + x * x / (2 * df))
    return F.when(df >= 400, normal_tail(z)).when(t.isNotNull() & df.isNotNull(), F.greatest(1 - inside, F.lit(0.0)))


def beta_share(x: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The regularised incomplete beta function, by its continued fraction on the side where that converges fast."""
    flip = x > (a + 1) / (a + b + 2)
    x, a, b = np.where(flip, 1 - x, x), np.where(flip, b, a), np.where(flip, a, b)
    gamma = np.vectorize(math.lgamma, otypes=[float])
    with np.errstate(divide="ignore"):
        front = np.exp(gamma(a + b) - gamma(a) - gamma(b) + a * np.log(x) + b * np.log1p(-x)) / a
    tiny = 1e-300
    c, d = np.ones_like(x), 1 / np.maximum(np.abs(1 - (a + b) * x / (a + 1)), tiny) * np.sign(1 - (a + b) * x / (a + 1))
    out = d.copy()
    for m in range(1, 400):
        for step in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + step * d
            d = 1 / np.where(np.abs(d) < tiny, tiny, d)
            c = 1 + step / c
            c = np.where(np.abs(c) < tiny, tiny, c)
            out = out * d * c
        if np.all(np.abs(d * c - 1) < 1e-14):
            break
    share = front * out
    return np.where(flip, 1 - share, share)


def f_tail(f: Column, d1: Column, d2: Column) -> Column:
    """Upper tail probability of F with d1 and d2 degrees of freedom."""

    @F.pandas_udf("double")
    def tail(f: pd.Series, d1: pd.Series, d2: pd.Series) -> pd.Series:
        a, b, x = d2.to_numpy(float) / 2, d1.to_numpy(float) / 2, f.to_numpy(float)
        good = np.isfinite(x) & (a > 0) & (b > 0) & (x >= 0)
        out = np.full(len(x), np.nan)
        if good.any():
            out[good] = beta_share(2 * a[good] / (2 * a[good] + 2 * b[good] * x[good]), a[good], b[good])
        return pd.Series(out).astype(object).where(good, None)

    return tail(f.cast("double"), d1.cast("double"), d2.cast("double"))


def anova_p(df: DataFrame, key: str, group: str, value: str) -> DataFrame:
    """One-way F of groups with more than one value for each key, and its p (T-01)."""
    return attribution.anova(df, key, group, value).withColumn("p", f_tail(F.col("f"), F.col("n_groups") - 1, F.col("n") - F.col("n_groups")))


def mann_whitney_p(df: DataFrame, key: str, value: str, is_a: Column) -> DataFrame:
    """U, Cliff's delta and p by the normal approximation with tie and continuity correction (T-08)."""
    g = attribution.mann_whitney(df, key, value, is_a)
    n = F.col("n_a") + F.col("n_b")
    spread = F.sqrt(F.col("n_a") * F.col("n_b") / 12 * (n + 1 - F.col("ties") / (n * (n - 1))))
    z = F.greatest(F.abs(F.col("u") - F.col("n_a") * F.col("n_b") / 2) - 0.5, F.lit(0.0)) / spread
    return g.withColumn("p", normal_tail(z)).drop("ties")


def adjusted(df: DataFrame, p: str) -> DataFrame:
    """Adds bonferroni and fdr (Benjamini-Hochberg) values; the tests of a report are few, one window sees them (T-08)."""
    every = Window.partitionBy()
    n = F.count(p).over(every)
    rank = F.row_number().over(every.orderBy(p))
    step = df.withColumns({"bonferroni": F.least(F.col(p) * n, F.lit(1.0)), "_raw": F.col(p) * n / rank})
    return step.withColumn("fdr", F.least(F.min("_raw").over(every.orderBy(F.desc(p)).rowsBetween(Window.unboundedPreceding, 0)), F.lit(1.0))).drop("_raw")


def wilcoxon(df: DataFrame, key: str, a: str, b: str) -> DataFrame:
    """n, signed-rank statistic (the smaller sum of ranks) and p by the normal approximation; pairs of equal values are left out (T-09)."""
    d = df.select(key, (F.col(a) - F.col(b)).alias("_d")).where("_d is not null and _d <> 0").withColumn("_m", F.abs("_d"))
    told = value_ranks(d, [key], "_m", {"_pos": F.count_if(F.col("_d") > 0), "_neg": F.count_if(F.col("_d") < 0)})
    r, t = F.col("rank"), F.col("n").cast("double")
    g = told.groupBy(key).agg(F.sum("n").alias("n"), F.sum(F.col("_pos") * r).alias("_up"), F.sum(F.col("_neg") * r).alias("_down"), F.sum(t * (t * t - 1)).alias("_ties"))
    n = F.col("n")
    w = F.least("_up", "_down")
    spread = F.sqrt((n * (n + 1) * (2 * n + 1) - F.col("_ties") / 2) / 24)
    return g.select(key, "n", w.alias("w"), normal_tail((w - n * (n + 1) / 4) / spread).alias("p"))


def effect_kind(test: Column) -> Column:
    """Which effect size goes with a test, by its description (T-06)."""
    t = F.lower(test)
    cliff = t.contains("mann-whitney") | t.contains("kruskal-wallis") | (t.contains("brunner") & ~t.contains("levene"))
    pooled = t.contains("welch") | (t.contains("independent") & t.contains("t-test"))
    paired = (t.contains("paired") & t.contains("t-test")) | t.contains("wilcoxon")
    return F.when(cliff, "cliffs_delta").when(t.contains("levene"), "n/a").when(pooled, "cohens_d").when(paired, "cohens_dz").otherwise("n/a")


def pairwise_stats(df: DataFrame, group: str, value: str, correction: str = "bonferroni") -> DataFrame:
    """The report on each pair of classes, by Mann-Whitney and by Welch's test (T-06, T-07).

    test, test_short_name, group1, group2, n1, n2, statistic_name, statistic, pvalue (bonferroni or fdr, over the pairs of a
    test), effect_size, effect_size_kind, correction_method. Rows meet each pair of their class; classes are a few names.
    """
    rows = df.where(F.col(value).isNotNull()).select(F.col(group).alias("_c"), F.col(value).cast("double").alias("_v"))
    names = rows.select("_c").distinct()
    pairs = names.select(F.col("_c").alias("group1")).join(names.select(F.col("_c").alias("group2")), F.col("group1") < F.col("group2"))
    sides = pairs.select("group1", "group2", F.explode(F.array("group1", "group2")).alias("_c"))
    told = rows.join(sides, "_c").withColumn("pair", F.struct("group1", "group2"))
    is_a = F.col("_c") == F.col("pair.group1")
    ranks = mann_whitney_p(told, "pair", "_v", is_a).select(
        F.lit("Mann-Whitney-Wilcoxon test two-sided").alias("test"), F.lit("M.W.W.").alias("test_short_name"), "pair", F.col("n_a").alias("n1"), F.col("n_b").alias("n2"),
        F.lit("U_stat").alias("statistic_name"), F.col("u").alias("statistic"), "p", F.col("cliffs_delta").alias("cliffs_delta"), F.lit(None).cast("double").alias("cohens_d"),
    )
    g = attribution.cohens_d(told, ["pair"], "_v", is_a)
    va, vb = F.col("v_a") / F.col("n_a"), F.col("v_b") / F.col("n_b")
    t, df_ = F.try_divide(F.col("m_a") - F.col("m_b"), F.sqrt(va + vb)), F.try_divide((va + vb) ** 2, va**2 / (F.col("n_a") - 1) + vb**2 / (F.col("n_b") - 1))
    welch = g.select(
        F.lit("Welch's t-test independent samples").alias("test"), F.lit("t-test_welch").alias("test_short_name"), "pair", F.col("n_a").alias("n1"), F.col("n_b").alias("n2"),
        F.lit("t").alias("statistic_name"), t.alias("statistic"), student_tail(t, F.round(df_)).alias("p"), F.lit(None).cast("double").alias("cliffs_delta"), "cohens_d",
    )
    kind = effect_kind(F.col("test"))
    size = F.when(kind == "cliffs_delta", F.col("cliffs_delta")).when(kind == "cohens_d", F.col("cohens_d"))
    out = [adjusted(x, "p").withColumn("pvalue", F.col(correction)) for x in (ranks, welch)]
    both = out[0].unionByName(out[1])
    return both.select("test", "test_short_name", "pair.group1", "pair.group2", "n1", "n2", "statistic_name", "statistic", "pvalue", size.alias("effect_size"), kind.alias("effect_size_kind"), F.lit(correction).alias("correction_method"))


def pairwise_effects(df: DataFrame, group: str, value: str) -> DataFrame:
    """Sizes, means, deviations and Cohen's d of each pair of classes, from one row for each class (T-07)."""
    g = df.groupBy(group).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.var_samp(value).alias("var"))
    side = lambda k: g.select(*(F.col(c).alias(f"{c}_{k}") for c in (group, "n", "mean", "var")))
    pairs = side(1).join(F.broadcast(side(2)), F.col(f"{group}_1") < F.col(f"{group}_2"))  # classes are a few names
    pooled = ((F.col("n_1") - 1) * F.col("var_1") + (F.col("n_2") - 1) * F.col("var_2")) / (F.col("n_1") + F.col("n_2") - 2)
    gap = F.col("mean_1") - F.col("mean_2")
    return pairs.withColumns({"mean_diff": gap, "cohens_d": F.try_divide(gap, F.sqrt(pooled))}).drop("var_1", "var_2")


def spearman(df: DataFrame, key: str, a: str, b: str) -> DataFrame:
    """Correlation of average ranks of each key; rows with a null are left out (T-10)."""
    rows = materialise(df.select(key, a, b).where(F.col(a).isNotNull() & F.col(b).isNotNull()), "ranks")  # values meet their ranks again, so they are computed once
    pairs = rows.groupBy(key, a, b).agg(F.count("*").alias("_c"))
    ranked = pairs
    for c, name in ((a, "_a"), (b, "_b")):
        ranked = ranked.join(value_ranks(rows, [key], c, {}).select(key, c, F.col("rank").alias(name)), [key, c])
    c, x, y = F.col("_c"), F.col("_a"), F.col("_b")
    g = ranked.groupBy(key).agg(F.sum("_c").alias("n"), F.sum(c * x * y).alias("xy"), F.sum(c * x * x).alias("xx"), F.sum(c * y * y).alias("yy"))
    mid = F.col("n") * ((F.col("n") + 1) / 2) ** 2  # the mean rank is (n + 1) / 2
    return g.select(key, "n", F.try_divide(F.col("xy") - mid, F.sqrt((F.col("xx") - mid) * (F.col("yy") - mid))).alias("rho"))


def reference_differences(df: DataFrame, key: str, is_reference: Column, a: str, b: str) -> DataFrame:
    """Correlations over reference and other rows of each key, and how they differ (T-13)."""
    side = lambda c: F.corr(F.when(c, F.col(a)), F.when(c, F.col(b)))
    g = df.groupBy(key).agg(side(is_reference).alias("r_ref"), side(~is_reference).alias("r_nonref"))
    return g.withColumns({"r_diff": F.col("r_nonref") - F.col("r_ref"), "r2_diff": F.col("r_nonref") ** 2 - F.col("r_ref") ** 2, "nonref_r_abs": F.abs("r_nonref")})


def equal_width_bins(df: DataFrame, value: str, bins: int) -> DataFrame:
    """Adds bin: bin0 for 0, else one of ``bins`` equal right-closed parts of the range of the rest; null stays null (T-16)."""
    v = F.col(value)
    ends = df.where(v != 0).agg(F.min(v), F.max(v)).first()  # two numbers
    low, high = (float(x) if x is not None else 0.0 for x in ends)
    width = (high - low) / bins or 1.0
    at = F.greatest(F.ceil((v - low) / width - 1e-9), F.lit(1))
    return df.withColumn("bin", F.when(v == 0, "bin0").when(v.isNotNull(), F.concat(F.lit("bin"), F.least(at, F.lit(bins)).cast("string"))))


def precision_recall(scores: DataFrame, keys: list[str], score: str, label: str) -> DataFrame:
    """precision and recall at each distinct score of each key, from the highest, and those of the step before (1 and 0 before the first) (M-08).

    Equal scores are one row before they are ordered.
    """
    steps = scores.groupBy(*keys, score).agg(F.sum(label).alias("_tp"), F.count("*").alias("_n"))
    found = steps.groupBy(*keys).agg(F.sum("_tp").alias("_all"))
    run = running_totals(steps, keys, [F.desc(score)], {"_tps": "_tp", "_ns": "_n"})
    run = run.join(found, keys) if keys else run.join(F.broadcast(found))  # one row without keys
    tp, n, every = F.col("_tps"), F.col("_ns"), F.col("_all")
    before = F.coalesce(F.try_divide(tp - F.col("_tp"), n - F.col("_n")), F.lit(1.0))
    return run.select(*keys, score, (tp / n).alias("precision"), F.try_divide(tp, every).alias("recall"), before.alias("precision_before"), F.try_divide(tp - F.col("_tp"), every).alias("recall_before"))


def average_precision(curve: DataFrame, keys: list[str]) -> DataFrame:
    """Average precision (steps) and the area under the curve (trapezoids from recall 0 at precision 1) (M-08)."""
    step = F.col("recall") - F.col("recall_before")
    area = step * (F.col("precision") + F.col("precision_before")) / 2
    return curve.groupBy(*keys).agg(F.sum(step * F.col("precision")).alias("average_precision"), F.sum(area).alias("auprc"))
