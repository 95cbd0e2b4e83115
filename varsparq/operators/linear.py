"""Linear attribution of many targets: ridge and lasso from one table of products, and epistasis across models.

x holds the cells (model, i, j, v) of a haplotype x variant matrix, absent ones 0; y the targets (model, i, site, y). Products
of columns are summed by Spark; a task then solves the targets of a block from its model's products. A model has variants of
one window, MOST at most; more is an error, as the products of a model meet in a task.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from varsparq.operators.significance import student_tail
from varsparq.storage import materialise

#: Variants of a model, at most (their products are 8 * MOST^2 bytes in a task), and targets of a block.
MOST, TARGETS = 4096, 64


def complete_rows(x: DataFrame, y: DataFrame) -> DataFrame:
    """y of the rows (model, i) that have all targets of their model and no missing x."""
    told = y.where(F.col("y").isNotNull() & ~F.isnan(F.col("y").cast("double")))
    targets = y.groupBy("model").agg(F.count_distinct("site").alias("_all"))
    whole = told.groupBy("model", "i").agg(F.count_distinct("site").alias("_n")).join(targets, "model").where("_n = _all").select("model", "i")
    missing = x.where(F.col("v").isNull() | F.isnan(F.col("v").cast("double"))).select("model", "i")
    return told.join(whole.join(missing, ["model", "i"], "left_anti"), ["model", "i"], "left_semi")


def products(x: DataFrame, y: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Centred products: (model, j, k, g, n) of variants j <= k that share a row, with their means; (model, site, j, c) of variants and targets."""
    y = materialise(complete_rows(x, y).select("model", "i", "site", F.col("y").cast("double").alias("y")), "targets")
    rows = y.select("model", "i").distinct()
    x = materialise(x.where("v <> 0").select("model", "i", "j", F.col("v").cast("double").alias("v")).join(rows, ["model", "i"], "left_semi"), "features")
    n = rows.groupBy("model").agg(F.count("*").alias("n"))
    means = x.groupBy("model", "j").agg(F.sum("v").alias("sum")).join(n, "model").withColumn("mean", F.col("sum") / F.col("n"))
    other = x.select("model", "i", F.col("j").alias("k"), F.col("v").alias("u"))
    raw = x.join(other, ["model", "i"]).where("j <= k").groupBy("model", "j", "k").agg(F.sum(F.col("v") * F.col("u")).alias("g"))
    gram = raw.join(means.select("model", "j", "mean", "n"), ["model", "j"])
    average = y.groupBy("model", "site").agg(F.avg("y").alias("m"))
    cross = x.join(y, ["model", "i"]).groupBy("model", "site", "j").agg(F.sum(F.col("v") * F.col("y")).alias("c"))
    cross = cross.join(means.select("model", "j", "sum"), ["model", "j"]).join(average, ["model", "site"])
    return gram, cross.select("model", "site", "j", (F.col("c") - F.col("sum") * F.col("m")).alias("c"))


def ridge(gram: np.ndarray, cross: np.ndarray, n: int, alpha: float) -> np.ndarray:
    """Coefficients (variants x targets) that minimise |y - x w|^2 + alpha |w|^2."""
    return np.linalg.solve(gram + alpha * np.eye(len(gram)), cross)


def lasso(gram: np.ndarray, cross: np.ndarray, n: int, alpha: float) -> np.ndarray:
    """Coefficients that minimise |y - x w|^2 / 2n + alpha |w|_1, by coordinate descent on the products until none moves."""
    w, scale = np.zeros_like(cross), np.diag(gram) / n
    for _ in range(100_000):
        moved = 0.0
        for j in np.flatnonzero(scale > 1e-15):
            rest = (cross[j] - gram[j] @ w) / n + scale[j] * w[j]
            new = np.sign(rest) * np.maximum(np.abs(rest) - alpha, 0) / scale[j]
            moved = max(moved, float(np.abs(new - w[j]).max()))
            w[j] = new
        if moved <= 1e-12 * max(1.0, float(np.abs(w).max())):
            break
    return w


KINDS: dict[str, Callable[[np.ndarray, np.ndarray, int, float], np.ndarray]] = {"ridge": ridge, "lasso": lasso}


def coefficients(x: DataFrame, y: DataFrame, kind: str = "ridge", alpha: float = 1.0) -> DataFrame:
    """model, site, j, coef of all targets of all models; a variant without a 1 in complete rows has no coefficient (it would be 0)."""
    solve = KINDS[kind]
    gram, cross = products(x, y)
    kinds = dict(cross.dtypes)
    sites = cross.select("model", "site").distinct()
    blocks = sites.groupBy("model").agg(F.ceil(F.count("*") / TARGETS).alias("_b"))
    block = F.pmod(F.xxhash64("site"), F.col("_b")).alias("block")
    cross = cross.join(blocks, "model").select(F.col("model").alias("model"), block, F.col("site").alias("site"), F.col("j").alias("j"), "c")  # columns of their own for the cogroup
    spread = gram.join(sites.join(blocks, "model").select("model", block).distinct(), "model")

    def solved(g: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        if g.empty or c.empty:
            return pd.DataFrame({"model": [], "site": [], "j": [], "coef": []})
        own = g[g.j == g.k].sort_values("j")
        names = pd.Index(own.j)
        if len(names) > MOST:
            raise ValueError(f"a model has {len(names)} variants, more than {MOST}: use smaller windows")
        n, mean = int(own.n.iloc[0]), own["mean"].to_numpy()
        products = np.zeros((len(names), len(names)))
        a, b = names.get_indexer(g.j), names.get_indexer(g.k)
        products[a, b] = products[b, a] = g.g
        products -= n * np.outer(mean, mean)
        targets = pd.Index(sorted(c.site.unique()))
        right = np.zeros((len(names), len(targets)))
        right[names.get_indexer(c.j), targets.get_indexer(c.site)] = c.c
        w = solve(products, right, n, alpha)
        at, t = np.meshgrid(np.arange(len(names)), np.arange(len(targets)), indexing="ij")
        return pd.DataFrame({"model": g.model.iloc[0], "site": targets[t.ravel()], "j": names[at.ravel()], "coef": w.ravel()})

    schema = f"model {kinds['model']}, site {kinds['site']}, j {kinds['j']}, coef double"
    return spread.groupBy("model", "block").cogroup(cross.groupBy("model", "block")).applyInPandas(solved, schema)


def position_of(key: Column) -> Column:
    """The start of a variant key chr:start-end_..., else null."""
    return F.get(F.split(F.get(F.split(key.cast("string"), ":"), 1), "-"), 0).try_cast("long")


def interactions(x: DataFrame, y: DataFrame, kind: str = "ridge", alpha: float = 1.0) -> DataFrame:
    """The long table of strengths of variants on sites, all targets of all models at once (M-01).

    model, wt_variant, site, interaction_strength (absolute), interaction_strength_signed, outlier_type, n_haplotypes,
    interaction_strength_weighted (the root of strength times haplotypes), wt_position, clinical_position, position_distance.
    """
    held = x.join(complete_rows(x, y).select("model", "i").distinct(), ["model", "i"], "left_semi").groupBy("model", "j").agg(F.sum("v").cast("double").alias("n_haplotypes"))
    b = F.col("coef")
    out = materialise(coefficients(x, y, kind, alpha), "coefficients").join(held, ["model", "j"])
    label = F.when(b < 0, "more pathogenic").when(b == 0, "neutral").otherwise("more benign")
    wt, site = position_of(F.col("j")), position_of(F.col("site"))
    return out.select(
        "model", F.col("j").alias("wt_variant"), "site", F.abs(b).alias("interaction_strength"), b.alias("interaction_strength_signed"), label.alias("outlier_type"), "n_haplotypes",
        F.sqrt(F.abs(b) * F.col("n_haplotypes")).alias("interaction_strength_weighted"), wt.alias("wt_position"), site.alias("clinical_position"), F.abs(wt - site).alias("position_distance"),
    )


def interactions_cached(x: DataFrame, y: DataFrame, path: str, kind: str = "ridge", alpha: float = 1.0, force: bool = False) -> DataFrame:
    """interactions() of models that the table at ``path`` lacks are added to it; gives the table (M-04). ``force`` fits all models anew.

    Models without a coefficient (no variant in complete rows) leave no rows and are tried again.
    """
    spark = x.sparkSession
    if not force:
        try:
            done = spark.read.parquet(path).select("model").distinct()
            x, y = x.join(done, "model", "left_anti"), y.join(done, "model", "left_anti")
        except AnalysisException as e:
            if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
                raise
    interactions(x, y, kind, alpha).write.mode("overwrite" if force else "append").parquet(path)
    return spark.read.parquet(path)


def pair_sums(x: DataFrame, y: DataFrame) -> DataFrame:
    """For each variant and site of a model: n rows, n_with, mean_with, mean_without, and centred sums sxx, sxy, syy; x above 0.5 counts as held.

    Only rows with a 1 are read for x, as absent cells are 0.
    """
    told = y.where(F.col("y").isNotNull() & ~F.isnan(F.col("y").cast("double"))).select("model", "i", "site", F.col("y").cast("double").alias("y"))
    whole = told.groupBy("model", "site").agg(F.count("*").alias("n"), F.sum("y").alias("_y"), F.sum(F.col("y") * F.col("y")).alias("_yy"))
    v, t, held = F.col("v").cast("double"), F.col("y"), F.col("v") > 0.5
    part = x.where("v <> 0").join(told, ["model", "i"]).groupBy("model", "site", "j").agg(
        F.sum(v).alias("_x"), F.sum(v * v).alias("_xx"), F.sum(v * t).alias("_xy"), F.count_if(held).alias("n_with"), F.sum(F.when(held, t)).alias("_with")
    )
    n = F.col("n")
    both = part.join(whole, ["model", "site"])
    return both.select(
        "model", "site", "j", "n", "n_with", F.try_divide("_with", "n_with").alias("mean_with"), F.try_divide(F.col("_y") - F.coalesce("_with", F.lit(0.0)), n - F.col("n_with")).alias("mean_without"),
        (F.col("_xx") - F.col("_x") ** 2 / n).alias("sxx"), (F.col("_xy") - F.col("_x") * F.col("_y") / n).alias("sxy"), (F.col("_yy") - F.col("_y") ** 2 / n).alias("syy"),
    )


def one_predictor(sums: DataFrame, alpha: float) -> DataFrame:
    """model, site, j, coef: a ridge fit of each site on each variant alone (M-01 with one predictor)."""
    return sums.where(F.col("sxx") / F.col("n") >= 1e-20).select("model", "site", "j", (F.col("sxy") / (F.col("sxx") + alpha)).alias("coef"))


def cross_model_epistasis(sums: DataFrame, joint: DataFrame, alpha: float = 1.0, threshold: float = 0.05) -> DataFrame:
    """Whether a variant's effect on a site departs from its mean effect on all sites of all models (M-03).

    ``sums`` is from pair_sums(), ``joint`` has model, site, j, coef. The fits of y on x, and on x and x * (joint - mean
    effect), follow from the sums. Pairs of fewer than 10 rows or without variance have null results. The tail of F with 1
    and n - 3 degrees of freedom is that of its root under Student's t.
    """
    varied = F.col("sxx") / F.col("n") >= 1e-20
    split = (F.col("n_with") > 0) & (F.col("n_with") < F.col("n")) & varied & (F.col("n") >= 2)
    effects = sums.groupBy("j").agg(F.coalesce(F.avg(F.when(split, F.col("mean_with") - F.col("mean_without"))), F.lit(0.0)).alias("wt_individual_effect"))
    pairs = joint.join(sums, ["model", "site", "j"], "left").join(effects, "j", "left")
    n, sxx, sxy, syy = (F.col(c) for c in ("n", "sxx", "sxy", "syy"))
    fits = (n >= 10) & varied
    dev = F.col("coef") - F.col("wt_individual_effect")
    add, inter = sxy / (sxx + alpha), sxy / (sxx + alpha / (1 + dev * dev))
    rss = lambda b: syy - 2 * b * sxy + b * b * sxx
    pairs = pairs.withColumns({"_add": F.when(fits, add), "_int": F.when(fits, inter)}).withColumns({"_rss_add": rss(F.col("_add")), "_rss_int": rss(F.col("_int"))})
    f = F.greatest(F.lit(0.0), (F.col("_rss_add") - F.col("_rss_int")) / (F.col("_rss_int") / (n - 3)))
    pairs = pairs.withColumn("epistasis_fstat", F.when(F.col("_rss_int") > 1e-10, f))
    pairs = pairs.withColumn("epistasis_pvalue", student_tail(F.sqrt("epistasis_fstat"), (n - 3).cast("double")))
    r2 = lambda c: 1 - F.try_divide(F.col(c), syy)
    return pairs.select(
        "model", "site", "j", F.coalesce(F.col("epistasis_pvalue") < threshold, F.lit(False)).alias("is_epistatic"), "epistasis_pvalue", "epistasis_fstat",
        r2("_rss_add").alias("additive_r2"), r2("_rss_int").alias("interaction_r2"), (r2("_rss_int") - r2("_rss_add")).alias("delta_r2"),
        (F.col("_rss_add") / n).alias("additive_mse"), (F.col("_rss_int") / n).alias("interaction_mse"), (F.col("_add") - F.col("wt_individual_effect")).alias("epistasis_coefficient"),
        F.col("coef").alias("joint_effect"), F.col("wt_individual_effect").alias("expected_additive_effect"), dev.alias("deviation_from_additive"), "wt_individual_effect",
    )


def epistasis_summary(tested: DataFrame) -> DataFrame:
    """n_tested, n_epistatic, n_additive, epistasis_rate (M-02, M-03)."""
    g = tested.agg(F.count("epistasis_pvalue").alias("n_tested"), F.count_if("is_epistatic").alias("n_epistatic"))
    return g.withColumns({"n_additive": F.col("n_tested") - F.col("n_epistatic"), "epistasis_rate": F.coalesce(F.try_divide("n_epistatic", "n_tested"), F.lit(0.0))})
