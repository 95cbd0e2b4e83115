"""Linear attribution and epistasis in closed form, and effect sizes: one aggregation each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from varsparq.operators.ordering import value_ranks


def ridge_epistasis(df: DataFrame, keys: list[str], w: str, y: str, d: Column, alpha: float = 1.0) -> DataFrame:
    """Additive and interaction ridge fits of y on w and on [w, w * d] for each key, with their F statistic (M-01, M-02, M-03).

    The interaction design is collinear, so both fits follow from centred sums. Keys with fewer than 10 rows, without
    variance in w, or with no residual are left out. ``d`` may use columns of ``keys`` only.
    """
    n, x, t = F.count("*").alias("n"), F.col(w).cast("double"), F.col(y)
    sums = df.groupBy(*keys).agg(n, (F.sum(x * x) - F.sum(x) * F.sum(x) / F.count("*")).alias("sxx"), (F.sum(x * t) - F.sum(x) * F.sum(t) / F.count("*")).alias("sxy"), (F.sum(t * t) - F.sum(t) * F.sum(t) / F.count("*")).alias("syy"))
    sums = sums.where((F.col("n") >= 10) & (F.col("sxx") / F.col("n") >= 1e-20)).withColumn("d", d)
    add = F.col("sxy") / (F.col("sxx") + alpha)
    inter = F.col("sxy") / (F.col("sxx") + alpha / (1 + F.col("d") * F.col("d")))
    rss = lambda b: F.col("syy") - 2 * b * F.col("sxy") + b * b * F.col("sxx")
    out = sums.withColumns({"beta_add": add, "beta_int": inter}).withColumns({"rss_add": rss(F.col("beta_add")), "rss_int": rss(F.col("beta_int"))})
    out = out.where("rss_int > 1e-10")
    f = F.greatest(F.lit(0.0), (F.col("rss_add") - F.col("rss_int")) / (F.col("rss_int") / (F.col("n") - 3)))
    return out.withColumns({"interaction_coef": F.col("d") * F.col("beta_int") / (1 + F.col("d") * F.col("d")), "f_stat": f})


def cohens_d(df: DataFrame, keys: list[str], value: str, is_a: Column) -> DataFrame:
    """Cohen's d of two groups by the pooled variance (T-03)."""
    v = F.col(value)
    a, b = F.when(is_a, v), F.when(~is_a, v)
    g = df.groupBy(*keys).agg(*(f(c).alias(f"{n}_{s}") for s, c in (("a", a), ("b", b)) for n, f in (("n", F.count), ("m", F.avg), ("v", F.var_samp))))
    pooled = ((F.col("n_a") - 1) * F.col("v_a") + (F.col("n_b") - 1) * F.col("v_b")) / (F.col("n_a") + F.col("n_b") - 2)
    return g.where("n_a > 1 and n_b > 1").withColumn("cohens_d", F.try_divide(F.col("m_a") - F.col("m_b"), F.sqrt(pooled)))


def mann_whitney(df: DataFrame, key: str, value: str, is_a: Column) -> DataFrame:
    """U of group a by average ranks, Cliff's delta, and ties (the sum of t^3 - t over equal values) of each key (T-04, T-08)."""
    told = value_ranks(df.withColumn("_a", is_a), [key], value, {"_in_a": F.count_if("_a"), "_in_b": F.count_if(~F.col("_a"))})
    tied = F.col("n").cast("double")
    g = told.groupBy(key).agg(F.sum("_in_a").alias("n_a"), F.sum("_in_b").alias("n_b"), F.sum(F.col("_in_a") * F.col("rank")).alias("_s"), F.sum(tied * tied * tied - tied).alias("ties"))
    u = F.col("_s") - F.col("n_a") * (F.col("n_a") + 1) / 2
    return g.where("n_a > 0 and n_b > 0").withColumn("u", u).withColumn("cliffs_delta", 2 * u / (F.col("n_a") * F.col("n_b")) - 1).drop("_s")


def anova(df: DataFrame, key: str, group: str, value: str) -> DataFrame:
    """One-way F of groups with more than one value, for each key (T-01)."""
    g = df.groupBy(key, group).agg(F.count(value).alias("n"), F.avg(value).alias("m"), F.var_samp(value).alias("v")).where("n > 1")
    s = g.groupBy(key).agg(F.count("*").alias("n_groups"), F.sum("n").alias("n"), (F.sum(F.col("n") * F.col("m") ** 2) - F.sum(F.col("n") * F.col("m")) ** 2 / F.sum("n")).alias("ssb"), F.sum((F.col("n") - 1) * F.col("v")).alias("ssw"))
    f = F.try_divide(F.col("ssb") / (F.col("n_groups") - 1), F.col("ssw") / (F.col("n") - F.col("n_groups")))
    return s.where("n_groups > 1 and n > n_groups").withColumn("f", f)
