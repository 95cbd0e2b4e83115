"""Pair statistics, ontology closure and grouped summaries, each as joins and aggregations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from varsparq.operators.matrix import dense_grid
from varsparq.operators.ordering import exact_quantiles, running_totals
from varsparq.storage import materialise


def wasserstein(df: DataFrame, keys: list[str], value: str, is_a: Column) -> DataFrame:
    """First Wasserstein distance of two groups for each key: the area between their distribution functions (T-02, observed part).

    Nulls are left out; keys that lack a group too. Equal values are one row before they are ordered.
    """
    v = F.col(value)
    counts = df.where(v.isNotNull()).groupBy(*keys, value).agg(F.count_if(is_a).alias("_a"), F.count_if(~is_a).alias("_b"))
    n = counts.groupBy(*keys).agg(F.sum("_a").alias("n_a"), F.sum("_b").alias("n_b")).where("n_a > 0 and n_b > 0")
    steps = running_totals(counts, keys, [value], {"_sa": "_a", "_sb": "_b"}, {"_next": value}).where("_next is not null").join(n, keys)
    area = F.abs(F.col("_sa") / F.col("n_a") - F.col("_sb") / F.col("n_b")) * (F.col("_next") - v)
    return n.join(steps.groupBy(*keys).agg(F.sum(area).alias("_d")), keys, "left").select(*keys, "n_a", "n_b", F.coalesce("_d", F.lit(0.0)).alias("distance"))


def paired_effect(df: DataFrame, keys: list[str], a: str, b: str) -> DataFrame:
    """Pairs, mean difference, Cohen's dz and paired t for each key; pairs with a null are left out (T-05, T-09 without Wilcoxon)."""
    d = F.col(a) - F.col(b)
    g = df.where(d.isNotNull()).groupBy(*keys).agg(F.count("*").alias("n"), F.avg(d).alias("mean_diff"), F.stddev_samp(d).alias("_sd"))
    dz = F.try_divide("mean_diff", "_sd")
    return g.where("n > 1").withColumns({"dz": dz, "t": dz * F.sqrt("n")}).drop("_sd")


def power_mean(df: DataFrame, keys: list[str], value: str, power: int) -> DataFrame:
    """Mean of a power of the values of each key (A-35)."""
    return df.groupBy(*keys).agg(F.avg(F.pow(value, F.lit(power))).alias("loading"))


def by_custom_order(category: Column, order: list[str]) -> Column:
    """Place in a given order, from 1; others come last (S-02)."""
    place = F.array_position(F.array(*map(F.lit, order)), category)
    return F.when(place > 0, place).otherwise(len(order) + 1)


def middle(values: Column, n: int) -> Column:
    """The n middle elements of an array; all of a shorter one (S-07)."""
    first = F.greatest(F.floor((F.size(values) - n) / 2), F.lit(0)).cast("int") + 1
    return F.slice(values, first, F.lit(n))


def ancestors(edges: DataFrame, rounds: int = 16) -> DataFrame:
    """(child, ancestor, level) of all pairs that parent links reach, at their least level (H-24).

    The closure is semi-naive: only pairs found in the last round are joined again. Each round is checkpointed where the
    session has a checkpoint folder. Cycles end, since a known pair is not new. ``rounds`` bounds the depth; a deeper
    ontology raises ValueError and loses nothing silently.
    """
    spark = edges.sparkSession
    cut = (lambda d: d.checkpoint()) if spark.sparkContext.getCheckpointDir() else (lambda d: d.persist())
    links = edges.select("child", "parent").where("child is not null and parent is not null").distinct().persist()
    new = cut(links.select("child", F.col("parent").alias("ancestor"), F.lit(1).alias("level")))
    known = new
    for level in range(2, rounds + 2):
        step = new.select("child", F.col("ancestor").alias("_at")).join(links.select(F.col("child").alias("_at"), F.col("parent").alias("ancestor")), "_at")
        new = cut(step.select("child", "ancestor").distinct().join(known, ["child", "ancestor"], "left_anti").withColumn("level", F.lit(level)))
        if new.isEmpty():
            return known
        known = known.unionByName(new)
    raise ValueError(f"links go deeper than {rounds} levels")


def common_ancestor(closure: DataFrame, pairs: DataFrame) -> DataFrame:
    """For each (id1, id2) the common ancestor that has most ancestors itself; ties go to the smaller name (H-25)."""
    depth = closure.groupBy(F.col("child").alias("mrca")).agg(F.count("*").alias("depth"))
    one = closure.select(F.col("child").alias("id1"), F.col("ancestor").alias("mrca"))
    two = closure.select(F.col("child").alias("id2"), F.col("ancestor").alias("mrca"))
    both = pairs.join(one, "id1").join(two, ["id2", "mrca"]).join(depth, "mrca", "left").na.fill(0, ["depth"])
    best = F.row_number().over(Window.partitionBy("id1", "id2").orderBy(F.desc("depth"), "mrca"))
    return both.withColumn("_r", best).where("_r = 1").select("id1", "id2", "mrca", "depth")


def class_summary(df: DataFrame, ids: list[str], label: str) -> DataFrame:
    """One text: the number of distinct ids of each class, by name (A-07). One row for each class is gathered."""
    n = df.groupBy(label).agg(F.count_distinct(*ids).alias("n"))
    told = F.array_sort(F.collect_list(F.concat(label, F.lit(": "), "n")))
    return n.agg(F.array_join(told, ", ").alias("summary"))


def title(df: DataFrame, columns: list[str]) -> DataFrame:
    """The single value of each column, or its name and the number of its values (A-08)."""
    one = lambda c: F.when(F.count_distinct(c) == 1, F.min(c)).otherwise(F.concat(F.lit(f"{c}: "), F.count_distinct(c)))
    return df.agg(*(one(c).alias(c) for c in columns))


def runtime_estimate(df: DataFrame, site: str, seconds: str, sites: int, gpus: int) -> DataFrame:
    """Seconds of a site on average, and days for ``sites`` of them (A-09)."""
    g = df.groupBy(site).agg(F.sum(seconds).alias("_s")).agg(F.count("*").alias("n_sites"), F.avg("_s").alias("seconds_per_site"))
    return g.withColumn("days", F.col("seconds_per_site") * sites / gpus / 86400)


def filled_matrix(cells: DataFrame, row: str, column: str, how: str, digits: int | None = None) -> DataFrame:
    """Every row and column with its value v, missing ones filled by the mean, median or mode (ties to the smaller) of all values (A-13).

    ``digits``: values are rounded before the grid is made, the fill once.
    """
    cells = materialise(cells, "cells")
    if how == "mode":
        fill = cells.groupBy("v").agg(F.count("*").alias("_n")).agg(F.min_by("v", F.struct(-F.col("_n"), F.col("v"))).alias("_fill"))
    elif how == "mean":
        fill = cells.agg(F.avg("v").alias("_fill"))
    else:
        fill = exact_quantiles(cells, [], "v", [0.5], plain=True).select(F.get("q", F.lit(0)).alias("_fill"))
    value = (fill.first() or [None])[0]  # one number
    near = lambda v: v if digits is None else F.round(v, digits)
    return dense_grid(cells.select(row).distinct(), cells.select(column).distinct(), cells.withColumn("v", near(F.col("v"))), near(F.lit(value).cast("double")))


def with_reference_twice(scores: DataFrame, is_reference: Column, ploid: str) -> DataFrame:
    """Rows of reference samples stand for both haplotypes (A-13, duplicate_ref_hap)."""
    both = F.array(F.lit(0), F.lit(1))
    return scores.withColumn(ploid, F.explode(F.when(is_reference, both).otherwise(F.array(F.col(ploid).cast("int")))))


def region_matrices(df: DataFrame, wt: dict[str, str], clinical: dict[str, str], wt_exon: str, clinical_exon: str, value: str) -> DataFrame:
    """Mean value for each pair of regions that hold a row's two variants, over all rows, exons that match or not, and exon distances (A-21)."""
    inside = lambda sets: F.filter(F.array(*(F.when(F.col(c), F.lit(n)) for n, c in sets.items())), lambda x: x.isNotNull())
    apart = F.abs(F.col(wt_exon) - F.col(clinical_exon))
    kinds = F.when(apart == 0, F.array(F.lit("all"), F.lit("match"))).otherwise(F.array(F.lit("all"), F.lit("mismatch"), F.concat(F.lit("distance "), apart)))
    rows = df.select(F.col(value).alias("_v"), inside(clinical).alias("_c"), kinds.alias("_k"), F.explode(inside(wt)).alias("wt"))
    rows = rows.select("_v", "_k", "wt", F.explode("_c").alias("clin")).select("_v", "wt", "clin", F.explode("_k").alias("kind"))
    return rows.groupBy("kind", "wt", "clin").agg(F.avg("_v").alias("v"), F.count("*").alias("n"))


def group_lists(df: DataFrame, key: str, value: str, more_than: int, most: int) -> DataFrame:
    """The first ``most`` distinct values of keys with more than ``more_than`` of them (A-23)."""
    w = Window.partitionBy(key)
    rows = df.select(key, value).distinct().withColumns({"_r": F.row_number().over(w.orderBy(value)), "_n": F.count("*").over(w)})
    kept = rows.where((F.col("_n") > more_than) & (F.col("_r") <= most))
    return kept.groupBy(key).agg(F.array_sort(F.collect_list(value)).alias("members"))


def role_strength(df: DataFrame, roles: dict[str, str], value: str) -> DataFrame:
    """Mean value of each position in each role (A-34)."""
    told = F.explode(F.array(*(F.struct(F.lit(r).alias("role"), F.col(c).alias("pos")) for r, c in roles.items())))
    return df.select(told.alias("_p"), F.col(value).alias("_v")).groupBy("_p.role", "_p.pos").agg(F.avg("_v").alias("strength"))


def relabelled_sum(df: DataFrame, column: str, labels: dict[str, str], default: str, keys: list[str], value: str) -> DataFrame:
    """Sums by label and keys (A-36)."""
    table = F.create_map(*(F.lit(x) for kv in labels.items() for x in kv))
    return df.groupBy(F.coalesce(table[F.col(column)], F.lit(default)).alias("label"), *keys).agg(F.sum(value).alias("n"))


def histogram(df: DataFrame, value: str, bins: int, low: float, high: float) -> DataFrame:
    """n, density and share of values in equal bins of [low, high], the last one closed (A-38)."""
    v, width = F.col(value), (high - low) / bins
    inside = df.where((v >= low) & (v <= high))
    at = F.least(F.floor((v - low) / (high - low) * bins), F.lit(bins - 1)).cast("long")
    counts = inside.groupBy(at.alias("bin")).agg(F.count("*").alias("n"))  # at most ``bins`` rows
    share = F.col("n") / F.sum("n").over(Window.partitionBy())
    return counts.withColumns({"share": share, "density": share / width})


def largest_columns(df: DataFrame, row: str, column: str, n: int) -> DataFrame:
    """Counts of rows by the n most frequent columns, 0 where there are none (A-41). n columns are broadcast."""
    top = df.groupBy(column).agg(F.count("*").alias("_n")).orderBy(F.desc("_n"), column).limit(n).select(column)
    counts = df.join(F.broadcast(top), column, "left_semi").groupBy(row, column).agg(F.count("*").alias("n"))
    names = F.broadcast(top.agg(F.collect_list(column).alias("_all")))
    grid = df.select(row).distinct().join(names).select(row, F.explode("_all").alias(column))
    return grid.join(counts, [row, column], "left").na.fill(0, ["n"])


def class_sources(frames: dict[str, DataFrame], label: str, columns: list[str], dropped: str = "vus") -> DataFrame:
    """Rows of each class by source, classes in title case, one of them dropped (A-42)."""
    rows = None
    for name, df in frames.items():
        part = df.select(F.lower(label).alias("class"), F.lit(name).alias("source"))
        rows = part if rows is None else rows.unionByName(part)
    return rows.where(F.col("class") != dropped).groupBy(F.initcap("class").alias("class")).agg(*(F.count_if(F.col("source") == c).alias(c) for c in columns))


def benchmark_rows(scores: DataFrame, sites: DataFrame, site: str, is_reference: str, value: str, label: str, labels: dict[str, int]) -> DataFrame:
    """site, y, grp, v: mean score of reference and other samples of each labelled site that has both (M-06)."""
    both = scores.groupBy(site).agg((F.max(is_reference) & ~F.min(is_reference)).alias("_both")).where("_both").select(site)
    table = F.create_map(*(F.lit(x) for kv in labels.items() for x in kv))
    known = sites.select(site, table[F.col(label)].alias("y")).where("y is not null")
    group = F.when(F.col(is_reference), "REF").otherwise("non-REF").alias("grp")
    return scores.join(both, site, "left_semi").groupBy(site, group).agg(F.avg(value).alias("v")).join(known, site).select(site, "y", "grp", "v")


def distance_to_mean(df: DataFrame, key: str, bin_: str, group: str, vector: str) -> DataFrame:
    """Mean and deviation, by bin and group, of the cosine distance of vectors to the mean vector of their bin (M-18)."""
    cells = df.select(key, bin_, group, F.posexplode(vector).alias("_k", "_v"))
    mean = cells.groupBy(bin_, "_k").agg(F.avg("_v").alias("_m"))
    sums = cells.join(mean, [bin_, "_k"]).groupBy(key, bin_, group).agg(F.sum(F.col("_v") * F.col("_m")).alias("_vm"), F.sum(F.col("_v") ** 2).alias("_vv"), F.sum(F.col("_m") ** 2).alias("_mm"))
    d = 1 - F.try_divide(F.col("_vm"), F.sqrt("_vv") * F.sqrt("_mm"))
    return sums.withColumn("_d", d).groupBy(bin_, group).agg(F.avg("_d").alias("mean"), F.stddev_samp("_d").alias("sd"))


def concatenated(df: DataFrame, key: str, order: list[str], value: str) -> DataFrame:
    """The values of each key in order, as one array: the parts of a site's track (K-07). A track is one row by its nature."""
    told = F.array_sort(F.collect_list(F.struct(*order, value)))
    return df.groupBy(key).agg(F.transform(told, lambda x: x[value]).alias("track"))


def range_bins(df: DataFrame, group: str, value: str, bins: int) -> DataFrame:
    """Counts by group and by ``bins`` equal parts of the range of all values."""
    low, high = df.agg(F.min(value), F.max(value)).first()  # two numbers
    width = ((high or 0) - (low or 0)) / bins or 1.0
    at = F.least(F.floor((F.col(value) - low) / width), F.lit(bins - 1)).cast("long")
    return df.groupBy(group, at.alias("bin")).agg(F.count("*").alias("n"))
