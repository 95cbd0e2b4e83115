"""A logistic benchmark of scores against labels: stratified split, models of many features for each key, and their report (M-05, M-07)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from varsparq.operators.ordering import running_totals
from varsparq.operators.significance import average_precision, precision_recall
from varsparq.storage import materialise


def stratified_split(df: DataFrame, keys: list[str], label: str, ids: list[str], test_share: float, seed: int) -> DataFrame:
    """Adds _test: the first rows of each key and label in the order of seeded hashes of ids. ``ids`` tell the rows of a key apart."""
    groups = [*keys, label]
    hashed = df.withColumns({"_hash": F.xxhash64(F.lit(seed), *ids), "_one": F.lit(1).cast("long")})
    placed = running_totals(hashed, groups, ["_hash", *ids], {"_place": "_one"})
    sizes = df.groupBy(*groups).agg(F.count("*").alias("_size"))
    share = (F.col("_place") - 1) / F.greatest(F.col("_size") - 1, F.lit(1))
    return placed.join(sizes, groups).withColumn("_test", share < test_share).select(*df.columns, "_test")


def fit_logistic(train: DataFrame, keys: list[str], features: list[str], label: str, rounds: int = 40) -> DataFrame:
    """keys, w (array: a weight for each feature, then the intercept): penalty |w|^2 / 2 on all but the intercept, by Newton steps.

    A step sums gradient and curvature over the rows of each key in Spark; the few numbers of a key are then solved in place.
    Steps end when no weight moves by 1e-9.
    """
    names = [f"_x{k}" for k in range(len(features))]
    rows = train.select(*keys, *(F.col(f).cast("double").alias(n) for f, n in zip(features, names, strict=True)), F.col(label).cast("double").alias("_y"))
    rows = materialise(rows.groupBy(*keys, *names, "_y").agg(F.count("*").cast("double").alias("_c")), "train")  # equal rows once
    z = [*(F.col(n) for n in names), F.lit(1.0)]
    size = len(z)
    model = materialise(rows.select(*keys).distinct().withColumn("w", F.array(*[F.lit(0.0)] * size)), "model")
    kinds = ", ".join(f"`{k}` {rows.schema[k].dataType.simpleString()}" for k in keys)
    upper = [(a, b) for a in range(size) for b in range(a, size)]

    def step(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in it:
            w = np.stack(part["w"].to_numpy()) if len(part) else np.zeros((0, size))
            g = part[[f"g{a}" for a in range(size)]].to_numpy()
            h = np.zeros((len(part), size, size))
            for a, b in upper:
                h[:, a, b] = h[:, b, a] = part[f"h{a}_{b}"]
            g[:, :-1] += w[:, :-1]
            h[:, range(size - 1), range(size - 1)] += 1
            h[:, -1, -1] += 1e-12
            move = np.stack([np.linalg.solve(x, y) for x, y in zip(h, g, strict=True)]) if len(part) else g
            move *= np.minimum(1, 8 / np.maximum(np.abs(move).max(1, initial=0), 1e-300))[:, None]  # no step leaps
            yield part[keys].assign(w=list(w - move), moved=np.abs(move).max(1, initial=0))

    for _ in range(rounds):
        told = rows.join(model, keys)
        p = 1 / (1 + F.exp(-sum((F.col("w")[k] * c for k, c in enumerate(z)), F.lit(0.0))))
        told = told.withColumns({"_g": F.col("_c") * (p - F.col("_y")), "_h": F.col("_c") * p * (1 - p)})
        sums = told.groupBy(*keys, "w").agg(*(F.sum(F.col("_g") * z[a]).alias(f"g{a}") for a in range(size)), *(F.sum(F.col("_h") * z[a] * z[b]).alias(f"h{a}_{b}") for a, b in upper))
        found = materialise(sums.mapInPandas(step, f"{kinds}, w array<double>, moved double"), "model")
        model = found.drop("moved")
        if (found.agg(F.max("moved")).first()[0] or 0.0) < 1e-9:
            break
    return model


def logistic_benchmark(df: DataFrame, keys: list[str], features: list[str], label: str, ids: list[str], test_share: float = 0.25, seed: int = 42) -> DataFrame:
    """keys, ids, label, prob, predicted of the held-out rows: a model for each key, fitted on its other rows (M-05, M-07).

    Rows with a null feature or label are left out; an input without any rows left is an error.
    """
    whole = [F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double")) for c in features]
    rows = df.where(F.col(label).isNotNull())
    for c in whole:
        rows = rows.where(c)
    rows = rows.select(*dict.fromkeys([*keys, *ids, *features, label]))
    if rows.isEmpty():
        raise ValueError("no rows with all features and a label")
    split = materialise(stratified_split(rows, keys, label, ids, test_share, seed), "split")
    model = fit_logistic(split.where("not _test"), keys, features, label)
    z = sum((F.col("w")[k] * F.col(f).cast("double") for k, f in enumerate(features)), F.col("w")[len(features)])
    prob = 1 / (1 + F.exp(-z))
    return split.where("_test").join(model, keys).select(*keys, *ids, label, prob.alias("prob"), (prob >= 0.5).cast("int").alias("predicted"))


def benchmark_report(scored: DataFrame, keys: list[str], label: str) -> DataFrame:
    """keys, accuracy, macro and weighted precision, recall and f1, support, average_precision, auprc, rounded to six digits (M-05).

    A class that is never predicted has precision 0, and f1 0.
    """
    y, p = F.col(label) == 1, F.col("predicted") == 1
    g = scored.groupBy(*keys).agg(F.count_if(y & p).alias("tp"), F.count_if(~y & p).alias("fp"), F.count_if(y & ~p).alias("fn"), F.count_if(~y & ~p).alias("tn"))

    def ratio(a: Column, b: Column) -> Column:
        return F.coalesce(F.try_divide(a, b), F.lit(0.0))

    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    precision, recall = (ratio(tn, tn + fn), ratio(tp, tp + fp)), (ratio(tn, tn + fp), ratio(tp, tp + fn))
    f1 = tuple(ratio(2 * a * b, a + b) for a, b in zip(precision, recall, strict=True))
    n, of = tp + fp + fn + tn, (tn + fp, tp + fn)
    told = {"accuracy": (tp + tn) / n}
    for name, pair in (("precision", precision), ("recall", recall), ("f1", f1)):
        told |= {f"macro_{name}": (pair[0] + pair[1]) / 2, f"weighted_{name}": (pair[0] * of[0] + pair[1] * of[1]) / n}
    curve = average_precision(precision_recall(scored, keys, "prob", label), keys)
    report = g.select(*keys, *(F.round(c, 6).alias(k) for k, c in told.items()), n.alias("support"))
    return report.join(curve.select(*keys, *(F.round(c, 6).alias(c) for c in ("average_precision", "auprc"))), keys)
