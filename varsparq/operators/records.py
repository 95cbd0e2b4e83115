"""Frames of variant records: BED and site forms, review scores, keyed overrides."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Chromosomes of a BED frame, and the columns of a site frame.
CHROMOSOMES = "^([0-9]+|X|Y)$"
SITE_COLUMNS = {"chrom": "CHROM", "chromStart": "POS", "chromEnd": "POS_END"}


def to_bed(records: DataFrame, score: Column, extra: list[str]) -> DataFrame:
    """A row for each alternative of records (chrom, pos, id, ref, alt array) on a known chromosome (P-02). A null list gives no row."""
    rows = records.where(F.col("chrom").rlike(CHROMOSOMES))
    end = F.col("pos") + F.length("ref")
    return rows.select("chrom", F.col("pos").alias("chromStart"), end.alias("chromEnd"), F.col("id").alias("name"), score.alias("score"), F.col("ref").alias("REF"), F.explode("alt").alias("ALT"), *extra)


def to_sites(records: DataFrame) -> DataFrame:
    """Records as sites, alternatives joined by commas (P-03)."""
    end = F.col("pos") + F.length("ref")
    return records.select(F.col("chrom").alias("CHROM"), F.col("pos").alias("POS"), end.alias("POS_END"), F.col("ref").alias("REF"), F.array_join("alt", ",").alias("ALT"))


def bed_to_sites(bed: DataFrame) -> DataFrame:
    """BED columns by the names of a site frame, those first (P-04)."""
    named = bed.withColumnsRenamed(SITE_COLUMNS)
    first = [*SITE_COLUMNS.values(), "REF", "ALT"]
    return named.select(*first, *(c for c in named.columns if c not in first))


def review_score(status: Column, stars: dict[str, int]) -> Column:
    """Stars of a review status; null for unknown ones (P-08)."""
    return F.create_map(*(F.lit(x) for kv in stars.items() for x in kv))[status].cast("tinyint")


def with_overrides(df: DataFrame, overrides: DataFrame, key: str) -> DataFrame:
    """``df`` with the values of a small table of overrides (one row for a key) in place of its own where given (P-23)."""
    names = [c for c in overrides.columns if c != key]
    both = df.join(overrides.select(key, *(F.col(c).alias(f"_{c}") for c in names)), key, "left")
    return both.select(*(F.coalesce(f"_{c}", c).alias(c) if c in names else F.col(c) for c in df.columns))
