"""Genotypes of a VCF as rows, a layout by position that a region read prunes, and matrices of a region."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from varsparq.functions.text import variant_key

#: Bases of a bin of the layout.
BIN = 1_000_000


def sample_names(spark: SparkSession, path: str) -> list[str]:
    """The samples of a VCF, from its header line."""
    line = spark.read.text(path).where(F.col("value").startswith("#CHROM")).limit(1).collect()
    return line[0].value.split("\t")[9:] if line else []


def allele(call: Column, ploid: Column | int) -> Column:
    """An allele of a call such as 0|1 or 0/1, -1 where it is missing."""
    return F.coalesce(F.try_element_at(F.split(call, "[|/]"), F.lit(ploid) + 1 if isinstance(ploid, int) else ploid + 1).try_cast("int"), F.lit(-1))


def read_calls(spark: SparkSession, path: str, ploidy: int = 2) -> DataFrame:
    """chrom, pos, id, ref, alt, sample, ploid, allele: a row for each sample and haplotype of each record (IO-14). All files have the same samples.

    GT must be the first of the FORMAT fields, as the format demands.
    """
    names = F.array(*map(F.lit, sample_names(spark, path)))
    cells = F.split("value", "\t")
    lines = spark.read.text(path).where(~F.col("value").startswith("#") & (F.col("value") != ""))
    records = lines.select(cells[0].alias("chrom"), cells[1].try_cast("bigint").alias("pos"), cells[2].alias("id"), cells[3].alias("ref"), cells[4].alias("alt"), F.arrays_zip(names.alias("sample"), F.slice(cells, 10, F.greatest(F.size(cells) - 9, F.lit(0))).alias("call")).alias("c"))
    calls = records.select("chrom", "pos", "id", "ref", "alt", F.explode("c").alias("c"))
    each = calls.withColumn("ploid", F.explode(F.sequence(F.lit(0), F.lit(ploidy - 1))))
    return each.select("chrom", "pos", "id", "ref", "alt", "c.sample", "ploid", allele(F.substring_index("c.call", ":", 1), F.col("ploid")).alias("allele"))


def fitting_bin(places: DataFrame, most: int = 1000, bin_size: int = BIN) -> int:
    """``bin_size``, or the multiple of it at which rows with chrom and pos fall into about ``most`` bins: folders of a layout don't grow with the table."""
    n, low, high = places.agg(F.count_distinct("chrom"), F.min("pos"), F.max("pos")).first()
    bins = n * ((high - low) // bin_size + 1) if n and high is not None else 1
    return bin_size * max(1, -(-bins // most))


def write_binned(calls: DataFrame, path: str, bin_size: int = BIN, mode: str = "error") -> None:
    """Write rows with chrom and pos by chromosome and bin of positions; rows of a bin are in one or a few files, in order."""
    binned = calls.withColumn("pos_bin", F.floor(F.col("pos") / bin_size))
    binned.repartitionByRange("chrom", "pos_bin", "pos").sortWithinPartitions("chrom", "pos_bin", "pos").write.mode(mode).partitionBy("chrom", "pos_bin").parquet(path)


def read_region(spark: SparkSession, path: str, chrom: str, start: int, stop: int, bin_size: int = BIN) -> DataFrame:
    """Rows with start <= pos < stop of a chromosome, with or without chr before its name; only files of its bins are read (IO-20).

    ``bin_size`` must be that of write_binned().
    """
    bare = chrom.removeprefix("chr")
    own = F.col("chrom").isin(bare, f"chr{bare}") & F.col("pos_bin").between(start // bin_size, (stop - 1) // bin_size)
    return spark.read.parquet(path).where(own & (F.col("pos") >= start) & (F.col("pos") < stop)).drop("pos_bin")


def region_matrix(cohorts: dict[str, DataFrame]) -> DataFrame:
    """cohort, haplotype (sample_ploid), variant, v: 1 where a haplotype has an alternative allele, 0 where it has none or the call is missing (IO-14).

    Haplotypes of all cohorts stand below each other; a variant that a cohort lacks has no rows for its haplotypes.
    """
    named = [df.withColumn("cohort", F.lit(name)) for name, df in cohorts.items()]
    rows = reduce(DataFrame.unionByName, [df.select("cohort", F.concat_ws("_", "sample", "ploid").alias("haplotype"), variant_key(F.col("chrom"), F.col("pos"), F.col("ref"), F.col("alt")).alias("variant"), "allele") for df in named])
    return rows.groupBy("cohort", "haplotype", "variant").agg(F.max((F.col("allele") > 0).cast("int")).alias("v")).withColumn("v", F.coalesce("v", F.lit(0)))


def dosages(calls: DataFrame) -> DataFrame:
    """variant, sample, dosage: alleles of both haplotypes added up; null when both are missing, a single missing one counts as -1 (IO-15)."""
    g = calls.groupBy(variant_key(F.col("chrom"), F.col("pos"), F.col("ref"), F.col("alt")).alias("variant"), "sample").agg(F.sum("allele").alias("_sum"), F.max("allele").alias("_most"))
    return g.select("variant", "sample", F.when(F.col("_most") > -1, F.col("_sum")).alias("dosage"))
