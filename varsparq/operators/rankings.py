"""Rankings, arg-max and top-n operators."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from varsparq.functions import metrics
from varsparq.operators.ordering import exact_quantiles, with_facts
from varsparq.storage import materialise


def ranked(df: DataFrame, order: list[Column], n: int) -> DataFrame:
    """The first n rows in an order, with their place. Spark keeps n rows of each task; the window sees n rows (A-04, S-01 to S-03)."""
    return df.orderBy(*order).limit(n).withColumn("place", F.row_number().over(Window.orderBy(*order)))


def sample_per_group(df: DataFrame, keys: list[str], ids: list[str], n: int, seed: int) -> DataFrame:
    """n rows of each group, those of the smallest seeded hashes of their ids (A-37)."""
    order = [F.xxhash64(F.lit(seed), *ids), *map(F.col, ids)]
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("_r") <= n).drop("_r")


def best_column(df: DataFrame, names: list[str]) -> DataFrame:
    """Adds top (the first of the columns that holds the greatest value) and score; null when all are (W-06)."""
    best = F.greatest(*names)
    top = F.coalesce(*(F.when(F.col(c) == best, F.lit(c)) for c in names))
    return df.withColumns({"top": top, "score": best})


def first_argmax(df: DataFrame, keys: list[str], value: str, order: str) -> DataFrame:
    """For each key the row of the greatest value, the first by a number among equal ones (W-07, W-08)."""
    top = F.max_by(F.struct(order, value), F.struct(F.col(value), -F.col(order))).alias("_t")
    return df.groupBy(*keys).agg(top).select(*keys, f"_t.{order}", f"_t.{value}")


def top_haplotypes(df: DataFrame, hap: str, place: list[str], value: str, n: int, how: str) -> DataFrame:
    """The n haplotypes that deviate most from the mean of all at each place, by mean or max (W-09). Means meet the rows by a join."""
    mean = df.groupBy(*place).agg(F.avg(value).alias("_mean"))
    gap = F.abs(F.col(value) - F.col("_mean"))
    g = df.join(mean, place).groupBy(hap).agg((F.max(gap) if how == "max" else F.avg(gap)).alias("deviation"))
    return g.withColumn("_r", F.round("deviation", 6)).orderBy(F.desc("_r"), hap).limit(n).drop("_r")


def track_variability(df: DataFrame, track: str, place: str, value: str) -> DataFrame:
    """sd, cv, range and auc over haplotypes at each place of a track, averaged over places (W-10)."""
    g = df.groupBy(track, place).agg(F.stddev_samp(value).alias("sd"), F.avg(value).alias("_m"), (F.max(value) - F.min(value)).alias("range"), F.sum(value).alias("auc"))
    return g.withColumn("cv", F.col("sd") / F.col("_m")).groupBy(track).agg(*(F.avg(c).alias(c) for c in ("sd", "cv", "range", "auc")))


#: Metrics of most_variable_tracks.
VARIABILITY = ("std", "mad", "entropy", "differential_entropy", "multiscale_entropy", "cv", "range", "spread", "auc")


def track_scores(cells: DataFrame, metric: str, eps: float = 1e-8) -> DataFrame:
    """track, score: how differently the haplotypes of a track behave, from cells (hap, place, track, v) (W-10).

    Most metrics compare haplotypes at each place and are averaged over places: std, mad, entropies (over haplotypes in
    their order), cv and range. spread is the share of places whose mean absolute value exceeds a twentieth of the track's
    greatest, auc the sum of these means. An array holds the haplotypes of a place for multiscale_entropy only.
    """
    if metric not in VARIABILITY:
        raise ValueError(f"no such metric: {metric}; there are {', '.join(VARIABILITY)}")
    v, at = F.col("v").cast("double"), cells.groupBy("track", "place")
    if metric in ("spread", "auc"):
        means = at.agg(F.avg(F.abs(v)).alias("_m"))
        if metric == "auc":
            return means.groupBy("track").agg(F.sum("_m").alias("score"))
        tops = means.groupBy("track").agg((0.05 * F.max("_m") + eps).alias("_least"))
        return means.join(tops, "track").groupBy("track").agg(F.avg((F.col("_m") > F.col("_least")).cast("double")).alias("score"))
    simple = {"std": F.stddev_samp(v), "cv": F.stddev_samp(v) / (F.abs(F.avg(v)) + eps), "range": F.max(v) - F.min(v)}
    if metric in simple:
        return at.agg(simple[metric].alias("_s")).groupBy("track").agg(F.avg("_s").alias("score"))
    if metric == "multiscale_entropy":
        values, scales = F.transform(F.sort_array(F.collect_list(F.struct("hap", v.alias("x")))), lambda s: s["x"]), (1, 2, 4, 8)
        each = at.agg(values.alias("_a")).select("track", metrics.complexity_index(metrics.multiscale_entropy(F.col("_a"), scales, eps), scales).alias("_s"))
    else:
        each = _place_scores(cells, metric, eps)
    return each.groupBy("track").agg(F.avg("_s").alias("score"))


def _place_scores(cells: DataFrame, metric: str, eps: float) -> DataFrame:
    """track, place, _s: mad, entropy or differential_entropy over the haplotypes of each place, from sums, greatest values and medians that meet the cells."""
    keys = ["track", "place"]
    rows = materialise(cells.select(*keys, F.col("v").cast("double").alias("_v")).where("_v is not null"), "cells")
    if metric == "mad":
        middle = lambda d, c: materialise(exact_quantiles(d, keys, c, [0.5], plain=True).select(*keys, F.col("q")[0].alias("_s")), "medians")
        return middle(with_facts(rows, middle(rows, "_v"), keys).select(*keys, F.abs(F.col("_v") - F.col("_s")).alias("_d")), "_d")
    facts = materialise(rows.groupBy(*keys).agg(F.sum("_v").alias("_total"), F.max("_v").alias("_top")), "totals")
    if metric == "entropy":  # of the softmax
        part = F.exp(F.col("_v") - F.col("_top"))
        facts = materialise(with_facts(rows, facts, keys).groupBy(*keys).agg(F.sum(part).alias("_all"), F.max("_top").alias("_top")), "totals")
        p = part / F.col("_all")
    else:
        p = F.col("_v") / (F.col("_total") + eps)
    return with_facts(rows, facts, keys).groupBy(*keys).agg((-F.sum(p * F.ln(p + eps))).alias("_s"))


def most_variable_tracks(cells: DataFrame, metric: str = "std", n: int = 10) -> DataFrame:
    """place, track, score of the n tracks of the highest score, ties to the smaller track (W-10)."""
    return ranked(track_scores(cells, metric), [F.desc_nulls_last("score"), F.col("track")], n)


def nearest_path(distances: DataFrame, start: object, schema: str = "path string, step int, k long") -> DataFrame:
    """path, step, k: a walk through all points of each path that always goes to the nearest one not yet visited (W-12).

    distances: path, i, k, d, both directions; a missing one is never taken while others are left. Each step rests on the
    one before, so a path is walked in one task, which holds its points and distances. Equal distances go to the smaller point.
    """

    def walk(part: pd.DataFrame) -> pd.DataFrame:
        near = {i: dict(zip(g.k, g.d, strict=True)) for i, g in part.groupby("i")}
        left = set(part.i) | set(part.k)
        out, at = [], start if start in left else min(left)
        while left:
            left.discard(at)
            out.append(at)
            if left:
                own = near.get(at, {})
                at = min(left, key=lambda k: (own.get(k, float("inf")), k))
        return pd.DataFrame({"path": part.path.iloc[0], "step": range(len(out)), "k": out})

    return distances.groupBy("path").applyInPandas(walk, schema)


def downsample(df: DataFrame, key: str, order: str, value: str, width: int) -> DataFrame:
    """Means of windows of ``width`` rows in order without overlap, a remainder dropped (W-11). A window holds the rows of a key."""
    w = Window.partitionBy(key)
    at = df.withColumns({"_k": F.row_number().over(w.orderBy(order)) - 1, "_n": F.count("*").over(w)})
    whole = at.where(F.col("_k") < F.floor(F.col("_n") / width) * width)
    return whole.groupBy(key, F.floor(F.col("_k") / width).alias("window")).agg(F.avg(value).alias("v"))


def top_track_frequency(df: DataFrame, sample: str, track: str, value: str) -> DataFrame:
    """How many samples have each track as the one of their greatest value, ties to the smaller track (W-14)."""
    most = df.groupBy(sample, track).agg(F.max(value).alias("_m"))
    return first_argmax(most, [sample], "_m", track).groupBy(track).agg(F.count("*").alias("n"))


def by_priority(df: DataFrame, key: str, value: str, threshold: float, how: str, n: int) -> DataFrame:
    """The n keys of highest priority: std, range, count, mean, or crossing_first (100 for those that cross, plus std) (S-04)."""
    v = F.col(value)
    crosses = ((F.min(v) < threshold) & (F.max(v) > threshold)).cast("int")
    ways = {"std": F.stddev_samp(v), "range": F.max(v) - F.min(v), "count": F.count("*").cast("double"), "mean": F.avg(v), "crossing_first": crosses * 100 + F.stddev_samp(v)}
    g = df.groupBy(key).agg(F.count("*").alias("n"), F.round(F.stddev_samp(v), 6).alias("sd"), F.round(ways[how], 6).alias("priority"))
    return g.where("sd is not null").orderBy(F.desc("priority"), key).limit(n)


def first_keys(df: DataFrame, limits: dict[str, int]) -> DataFrame:
    """Rows of the first so many values of each key column, each counted over the whole table (S-06). The lists of keys are as short as their limits."""
    first = {key: df.select(key).distinct().orderBy(key).limit(n) for key, n in limits.items()}
    rows = df
    for key, keys in first.items():
        rows = rows.join(F.broadcast(keys), key, "left_semi")
    return rows.select(*df.columns)


def centre_crop(values: Column, width: int, resolution: int) -> Column:
    """The bins of an array around its centre that cover ``width`` bases (S-08)."""
    bins = max(1, width // resolution)
    start = F.greatest(F.floor(F.size(values) / 2) - bins // 2, F.lit(0)).cast("int") + 1
    return F.slice(values, start, F.lit(bins))
