"""Whether positions that covary across haplotypes are in contact (T-11)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from varsparq.operators.ordering import exact_quantiles
from varsparq.operators.significance import spearman
from varsparq.storage import materialise


def bin_covariance(effects: DataFrame, positions: int, bins: int) -> DataFrame:
    """(a, b, covariance) of bins a < b: the mean over haplotypes and tracks of products of centred bin means.

    effects: hap, pos (from 0), track, v. Positions beyond the last whole bin are left out; missing values don't count in a
    mean. A bin meets the others of its haplotype and track, so rows grow with haplotypes x tracks x bins^2.
    """
    size = positions // bins
    if size < 1:
        raise ValueError(f"{positions} positions can't fill {bins} bins")
    inside = effects.where((F.col("pos") >= 0) & (F.col("pos") < bins * size) & F.col("v").isNotNull())
    means = inside.groupBy("hap", "track", F.floor(F.col("pos") / size).alias("bin")).agg(F.avg("v").alias("m"))
    centre = means.groupBy("track", "bin").agg(F.avg("m").alias("c"))
    centred = means.join(centre, ["track", "bin"]).select("hap", "track", "bin", (F.col("m") - F.col("c")).alias("d"))
    n = effects.agg((F.count_distinct("hap") * F.count_distinct("track")).alias("n")).first()[0]  # one number
    other = centred.select("hap", "track", F.col("bin").alias("b"), F.col("d").alias("e"))
    pairs = centred.join(other, ["hap", "track"]).where("bin < b")
    return pairs.groupBy(F.col("bin").alias("a"), "b").agg((F.sum(F.col("d") * F.col("e")) / max(n, 1)).alias("covariance"))


def contact_pairs(covariance: DataFrame, contacts: DataFrame, min_distance: int = 0) -> DataFrame:
    """a, b, covariance, contact of pairs at least ``min_distance`` bins apart that have both; contacts of several tracks (a, b, contact) are averaged."""
    mean = contacts.where(F.col("contact").isNotNull() & ~F.isnan(F.col("contact").cast("double"))).groupBy("a", "b").agg(F.avg("contact").alias("contact"))
    return covariance.join(mean, ["a", "b"]).where(F.abs(F.col("a") - F.col("b")) >= min_distance)


def contact_correlation(pairs: DataFrame, method: str = "spearman") -> DataFrame:
    """n and the correlation of contact and covariance over all pairs: spearman or pearson."""
    if method == "spearman":
        return spearman(pairs.withColumn("_all", F.lit(0)), "_all", "contact", "covariance").select("n", F.col("rho").alias("correlation"))
    return pairs.agg(F.count("*").alias("n"), F.corr("contact", "covariance").alias("correlation"))


def contact_quantiles(pairs: DataFrame, quantiles: int = 10) -> DataFrame:
    """quantile (from 1), mean_contact, mean_covariance, n by equal parts of contact; parts are open above, the last is closed, empty ones are left out."""
    pairs = materialise(pairs.select("contact", "covariance"), "pairs")
    edges = exact_quantiles(pairs, [], "contact", [q / quantiles for q in range(quantiles + 1)], plain=True)
    told = pairs.join(F.broadcast(edges)).select("contact", "covariance", F.explode(F.filter(F.transform("q", lambda x, i: F.struct((i + 1).alias("k"), x.alias("low"))), lambda e: (e["k"] <= quantiles) & (e["low"] <= F.col("contact")))).alias("e"), "q")  # a row of edges
    high = F.element_at("q", F.col("e.k") + 1)
    inside = (F.col("contact") < high) | ((F.col("e.k") == quantiles) & (F.col("contact") <= high))
    return told.where(inside).groupBy(F.col("e.k").alias("quantile")).agg(F.avg("contact").alias("mean_contact"), F.avg("covariance").alias("mean_covariance"), F.count("*").alias("n"))
