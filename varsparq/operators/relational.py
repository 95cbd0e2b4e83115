"""Filters, sorts, set operations, ranks and grouped summaries over score tables."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce
from operator import and_

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from varsparq.operators.ordering import dealt, exact_quantiles, row_index, with_facts
from varsparq.storage import materialise


#: Sequences of a block that a task compares with those of another.
SEQUENCES = 1024


def filter_by(df: DataFrame, filters: dict[str, object], at_least: Iterable[str] = ()) -> DataFrame:
    """A list means: the text contains a match of any; a scalar: equal, or >= for columns in ``at_least``; unknown columns are skipped (P-05)."""
    found: list[Column] = []
    for name, value in filters.items():
        if name in df.columns:
            c = F.col(name)
            found.append(c.rlike("|".join(map(str, value))) if isinstance(value, list | tuple) else c >= value if name in at_least else c == value)
    return df.where(reduce(and_, found)) if found else df


def best_rows(df: DataFrame, keys: list[str], order: list[Column], n: int = 1) -> DataFrame:
    """The first n rows of each key in a total order (W-01, W-02, J-16)."""
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("_r") <= n).drop("_r")


def missing_cells(expected: DataFrame, results: DataFrame, keys: list[str]) -> DataFrame:
    """Cells of the expected grid without a result (P-10, K-01)."""
    return expected.join(results.where("value is not null"), keys, "left_anti")


def between_group_variance(scores: DataFrame, members: DataFrame, site: str, member: str, group: str, value: str) -> DataFrame:
    """Variance of the means of groups, for each site (A-02); ``members`` (member, group) says who belongs where.

    Scores are summed by site and member before they meet the members, so a join sees a row for each pair of these.
    """
    sums = dealt(scores.select(site, member, value), [site, member]).groupBy(site, member).agg(F.sum(value).alias("_s"), F.count(value).alias("_n"))
    means = sums.join(members.select(member, group), member).groupBy(site, group).agg(F.try_divide(F.sum("_s"), F.sum("_n")).alias("_mean"))
    return means.groupBy(site).agg(F.var_samp("_mean").alias("between_var"))


def pair_counts(rows: DataFrame, members: DataFrame, site: str, member: str, group: str) -> DataFrame:
    """site, member, group, n: rows of each (J-03), a left join to ``members`` (member, group).

    Rows are counted by site and member before they meet the members; a repeated row of these counts as often as it is there.
    """
    pairs = dealt(rows.select(site, member), [site, member]).groupBy(site, member).agg(F.count("*").alias("_n"))
    known = members.groupBy(member, group).agg(F.count("*").alias("_m"))
    return pairs.join(known, member, "left").select(site, member, group, (F.col("_n") * F.coalesce("_m", F.lit(1))).alias("n"))


def scale_within(df: DataFrame, keys: list[str], value: str, method: str, plain: bool = False) -> DataFrame:
    """Adds ``scaled``: minmax, robust (median and quartiles, a zero range counts as 1) or sign (W-03). For ``plain`` see exact_quantiles()."""
    v = F.col(value)
    if method == "sign":
        return df.withColumn("scaled", F.signum(v))
    if method == "minmax":
        ends = materialise(df.groupBy(*keys).agg(F.min(v).alias("_low"), F.max(v).alias("_high")), "ends")  # partial sums first: a hot key is no group
        scaled = F.try_divide(v - F.col("_low"), F.col("_high") - F.col("_low"))
        return with_facts(df, ends, keys).withColumn("scaled", scaled).drop("_low", "_high")
    q = materialise(exact_quantiles(df, keys, value, [0.25, 0.5, 0.75], plain=plain).withColumnRenamed("q", "_q"), "quartiles")
    spread = F.coalesce(F.nullif(F.col("_q")[2] - F.col("_q")[0], F.lit(0.0)), F.lit(1.0))
    return with_facts(df, q, keys).withColumn("scaled", (v - F.col("_q")[1]) / spread).drop("_q")


def crossing(df: DataFrame, key: str, value: str, threshold: float) -> DataFrame:
    """Rows at and below a threshold, and whether a key crosses it (A-10, A-11)."""
    v = F.col(value)
    return df.groupBy(key).agg(F.count("*").alias("n"), F.count_if(v >= threshold).alias("n_above"), F.count_if(v < threshold).alias("n_below"), ((F.min(v) < threshold) & (F.max(v) > threshold)).alias("crosses"))


def top_and_other(df: DataFrame, category: str, n: int) -> DataFrame:
    """Counts of the n most frequent categories, the rest as Other (A-20)."""
    counts = df.groupBy(category).count()
    r = F.row_number().over(Window.orderBy(F.desc("count"), category))  # one row for each category
    named = counts.withColumn("category", F.when(r <= n, F.col(category)).otherwise("Other"))
    return named.groupBy("category").agg(F.sum("count").alias("n"))


def chromosome_order(chrom: Column) -> list[Column]:
    """Sort keys for 1..22, X, Y, M, then others (S-03)."""
    bare = F.regexp_replace(chrom, "^chr", "")
    number = bare.try_cast("int")
    rank = F.when(number.isNotNull(), 0).when(bare == "X", 1).when(bare == "Y", 2).when(bare.isin("M", "MT"), 3).otherwise(4)
    return [rank, number, bare]


def filter_sites(rows: DataFrame, filters: dict[str, object]) -> DataFrame:
    """Rows of regions that are their site's own, filtered: a list means one of, a whole number at least, a text a match (P-06)."""
    kept = rows.where("region_idx = site_idx")
    for name, value in filters.items():
        c = F.col(name)
        if isinstance(value, list | tuple):
            kept = kept.where(c.isin(*value))
        elif isinstance(value, int):
            kept = kept.where(c >= value)
        elif isinstance(value, str):
            kept = kept.where(c.rlike(value))
        else:
            raise TypeError(f"no filter by {type(value).__name__} for {name}")
    return kept


def top_of_terms(scores: DataFrame, sites: DataFrame, key: str, terms: list[str], search: str, group: str, order: list[Column], n: int) -> DataFrame:
    """Scores of the first n sites of each group whose ``search`` column matches a term (P-14)."""
    found = best_rows(sites.where(F.col(search).rlike("|".join(terms))), [group], order, n)
    return scores.join(found.select(key), key, "left_semi")


def json_members(df: DataFrame, column: str, field: str, values: list[str], key: str) -> DataFrame:
    """Distinct keys of rows whose JSON field is one of some values (P-16)."""
    return df.where(F.get_json_object(column, f"$.{field}").isin(*values)).select(key).distinct()


def binarised(df: DataFrame, columns: list[str]) -> DataFrame:
    """1 where a count is above 0, else 0 (P-19)."""
    return df.withColumns({c: (F.col(c) > 0).cast("int") for c in columns})


def frequent(calls: DataFrame, variant: str, genotype: str, least: float) -> DataFrame:
    """Variants with a mean genotype of ``least`` or more; -1 is missing (P-20)."""
    return calls.groupBy(variant).agg(F.avg(F.nullif(genotype, F.lit(-1))).alias("af")).where(F.col("af") >= least)


def limited(df: DataFrame, group: str, groups: int, order: list[Column], rows: int) -> DataFrame:
    """The first ``rows`` rows of each of the first ``groups`` groups by name (P-21, S-06)."""
    first = df.select(group).distinct().orderBy(group).limit(groups)
    return best_rows(df.join(F.broadcast(first), group, "left_semi"), [group], order, rows)


def merge_report(joined: DataFrame, keys: list[str], found: str) -> DataFrame:
    """Rows, rows that found a partner, and their share, after a left join (J-02)."""
    g = joined.groupBy(*keys).agg(F.count("*").alias("n"), F.count(found).alias("merged"))
    return g.withColumn("rate", F.col("merged") / F.col("n"))


def in_all_classes(df: DataFrame, key: str, label: str, supported: Column, classes: int) -> DataFrame:
    """Rows of keys that have supported rows of each class (J-18, U-06)."""
    good = df.where(supported).groupBy(key).agg(F.count_distinct(label).alias("_n")).where(F.col("_n") == classes)
    return df.join(good.select(key), key, "left_semi")


def unordered_pairs(df: DataFrame, on: list[str], key: str) -> DataFrame:
    """Pairs i < j of keys of one group (J-20). Their number is the square of a group, so groups are small by their nature."""
    one, two = df.select(*on, F.col(key).alias("i")), df.select(*on, F.col(key).alias("j"))
    return one.join(two, on).where("i < j")


def sequence_pairs(df: DataFrame, on: list[str]) -> DataFrame:
    """Ordered pairs i, j of sequences (id, phase, seq) of one group, whether their phase agrees, and the share of equal places (J-21).

    Sequences are dealt to blocks by hash; a task compares all pairs of two blocks of a group at once, as matrices of code points.
    """
    n = df.groupBy(*on).count().agg(F.max("count")).first()[0] or 0  # one number
    blocks = max(1, -(-n // SEQUENCES))
    told = df.select(*on, "id", "phase", "seq").where(reduce(and_, (F.col(c).isNotNull() for c in [*on, "id"])))
    told = told.withColumn("_own", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int"))
    side = lambda first: told.withColumns({"_first": F.lit(first), "_other": F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))})
    dealt = side(True).withColumnsRenamed({"_own": "_a", "_other": "_b"}).unionByName(side(False).withColumnsRenamed({"_own": "_b", "_other": "_a"}))
    kind = df.schema["id"].dataType.simpleString()
    parts = max(1, min(blocks * blocks * 8, 4000))

    def compared(part: pd.DataFrame) -> pd.DataFrame:
        one, two = part[part._first], part[~part._first]
        found = [part.head(0).assign(i=part.id.head(0), j=part.id.head(0), same_phase=False, similarity=0.0)[["i", "j", "same_phase", "similarity"]]]
        if not len(one) or not len(two):
            return found[0]
        a, b = (_code_points(d.seq) for d in (one, two))
        wide, step = max(a[0].shape[1], b[0].shape[1]), max(1, 2**18 // len(two))
        a, b = ((np.pad(c, ((0, 0), (0, wide - c.shape[1])), constant_values=-1), n, null) for c, n, null in (a, b))
        for k in range(0, len(one), step):
            codes, lengths, null = (x[k : k + step] for x in a)
            same = np.zeros((len(codes), len(two)), np.int32)
            for at in range(wide):
                same += (codes[:, at, None] == b[0][None, :, at]) & (codes[:, at, None] >= 0)
            share = same / np.maximum(np.maximum(lengths[:, None], b[1][None, :]), 1)
            share[null[:, None] | b[2][None, :]] = np.nan
            i, j = np.repeat(one.id.to_numpy()[k : k + step], len(two)), np.tile(two.id.to_numpy(), len(codes))
            p, q = np.repeat(one.phase.to_numpy()[k : k + step], len(two)), np.tile(two.phase.to_numpy(), len(codes))
            alike = pd.Series(p == q).astype(object).mask(pd.isna(p) | pd.isna(q), None) if pd.isna(one.phase).any() or pd.isna(two.phase).any() else p == q
            apart = i != j
            found.append(pd.DataFrame({"i": i, "j": j, "same_phase": alike, "similarity": share.ravel()})[apart])
        return pd.concat(found[1:])

    found = dealt.repartition(parts, *on, "_a", "_b").groupBy(*on, "_a", "_b").applyInPandas(compared, f"i {kind}, j {kind}, same_phase boolean, similarity double")
    return found.withColumn("similarity", F.nanvl("similarity", F.lit(None).cast("double")))


def _code_points(seqs: pd.Series) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(code points, -1 behind the end; lengths; whether null) of texts."""
    null = seqs.isna().to_numpy()
    texts = np.array(["" if x else s for s, x in zip(seqs, null, strict=True)])
    lengths = np.array([len(s) for s in texts], np.int64)
    wide = max(int(lengths.max(initial=0)), 1)
    codes = texts.astype(f"<U{wide}").view("<i4").reshape(len(texts), wide).copy()
    codes[np.arange(wide) >= lengths[:, None]] = -1
    return codes, lengths, null


def map_distinct(df: DataFrame, column: str, name: str, value: Column) -> DataFrame:
    """Adds an expression over one column, computed once for each distinct value and joined back (F-02)."""
    known = df.select(column).distinct().withColumn(name, value).withColumnRenamed(column, "_key")
    return df.join(known, F.col(column).eqNullSafe(F.col("_key")), "left").drop("_key")


def batches(df: DataFrame, order: list[str], most: int, ploid: int, mutants: int | None = None) -> DataFrame:
    """Adds the batch of each sample: ``most`` sequences a batch, ploid times (mutants + 1) of each sample (F-16)."""
    size = most // ploid
    if mutants is not None:
        size //= mutants + 1
    return row_index(df, order, "_k").withColumn("batch", F.floor(F.col("_k") / size)).drop("_k")


def by_cohort(frames: dict[str, DataFrame]) -> DataFrame:
    """Rows of several frames with the name of each as cohort; missing columns are null (U-04)."""
    named = [df.withColumn("cohort", F.lit(name)) for name, df in frames.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), named)


def merge_collections(frames: dict[str, DataFrame], node: str) -> DataFrame:
    """Rows of several collections, node ids told apart by the name of their collection (U-08)."""
    return reduce(DataFrame.unionByName, [df.withColumn(node, F.concat_ws(":", F.lit(name), node)) for name, df in frames.items()])
