"""Readers and writers of variant, interval and score files, all through Spark's sources."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from varsparq.functions.text import ONTOLOGIES, info_field, ontology_ids, split_ends
from varsparq.operators.records import review_score

#: Stars of review statuses.
REVIEW_STARS = {
    "practice_guideline": 4,
    "reviewed_by_expert_panel": 3,
    "criteria_provided,_multiple_submitters,_no_conflicts": 2,
    "criteria_provided,_conflicting_classifications": 1,
    "criteria_provided,_single_submitter": 1,
    "no_assertion_criteria_provided": 0,
    "no_classification_provided": 0,
    "no_classification_for_the_single_variant": 0,
    "no_classifications_from_unflagged_records": 0,
}
BED_SCHEMA = "chrom string, chromStart bigint, chromEnd bigint, name string, score double, REF string, ALT string"


def read_vcf(spark: SparkSession, path: str, info: list[str], extract_ids: bool = True, contig: str | None = None, predicate: Column | None = None, cache: str | None = None, force: bool = False) -> DataFrame:
    """One row for each record: chrom, pos, id, ref, alt (array) and the INFO fields; MC parts, review score and ontology ids derived (IO-01).

    contig: records of one chromosome, with or without chr; predicate: a condition on the columns read, before any are
    derived. With a cache the rows are written there as Parquet, and read from there by the next call unless ``force``.
    """
    if cache and not force:
        try:
            return spark.read.parquet(cache)
        except AnalysisException as e:
            if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
                raise
    cells = F.split("value", "\t")
    lines = spark.read.text(path).where(~F.col("value").startswith("#") & (F.col("value") != ""))
    df = lines.select(cells[0].alias("chrom"), cells[1].try_cast("bigint").alias("pos"), cells[2].alias("id"), cells[3].alias("ref"), F.split(cells[4], ",").alias("alt"), *(info_field(cells[7], k).alias(k) for k in info))
    if contig is not None:
        df = df.where(F.regexp_replace("chrom", "^chr", "") == contig.removeprefix("chr"))
    if predicate is not None:
        df = df.where(predicate)
    if "MC" in info:
        first, last = split_ends(F.col("MC"))
        df = df.withColumns({"MC_id": first, "MC_term": last})
    if "CLNREVSTAT" in info:
        df = df.withColumn("CLNREVSTAT_score", review_score(F.col("CLNREVSTAT"), REVIEW_STARS))
    if extract_ids and "CLNDISDB" in info:
        df = df.withColumns({o: ontology_ids(F.col("CLNDISDB"), o) for o in ONTOLOGIES}).withColumns({f"{o}_n": F.size(o) for o in ONTOLOGIES})
    if cache:
        df.write.mode("overwrite").parquet(cache)
        return spark.read.parquet(cache)
    return df


def read_bed(spark: SparkSession, path: str, schema: str = BED_SCHEMA, sep: str = "\t", header: bool = True) -> DataFrame:
    """Rows with an ALT; site is the name (IO-03)."""
    return spark.read.csv(path, sep=sep, header=header, schema=schema).na.drop(subset=["ALT"]).withColumn("site", F.col("name"))


def read_regions(spark: SparkSession, glob: str, schema: str) -> DataFrame:
    """Headerless interval files of a glob, with region_key from the file name up to its first dot (IO-04)."""
    return spark.read.csv(glob, sep="\t", schema=schema).withColumn("region_key", F.substring_index(F.col("_metadata.file_name"), ".", 1))


def write_bed(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, sep="\t", header=True)  # IO-05


def append_scores(scores: DataFrame, path: str) -> None:
    """Replace only the (model, chrom) partitions that ``scores`` holds (IO-06, IO-07)."""
    scores.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("model", "chrom").parquet(path)


def read_scores(spark: SparkSession, path: str, columns: list[str] | None = None, not_null: tuple[str, ...] = ("value",)) -> DataFrame:
    """Scores with pruned columns and without nulls or NaN; a missing column is an error (IO-08 to IO-11)."""
    df = spark.read.parquet(path)
    if columns:
        if missing := [c for c in columns if c not in df.columns]:
            raise ValueError(f"no such columns: {', '.join(missing)}")
        df = df.select(*columns)
    kinds = dict(df.dtypes)
    for c in (c for c in not_null if c in kinds):
        df = df.where(F.col(c).isNotNull() & (~F.isnan(c) if kinds[c] in ("double", "float") else F.lit(True)))
    return df


def dosage(genotypes: DataFrame) -> DataFrame:
    """Dosage of (a, b) allele calls; null when both are missing (-1) (IO-15)."""
    return genotypes.withColumn("dosage", F.when((F.col("a") == -1) & (F.col("b") == -1), None).otherwise(F.col("a") + F.col("b")))
