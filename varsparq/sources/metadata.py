"""Readers of manifests, track tables, JSON and sets of datasets, and the export of score tables."""

from __future__ import annotations

from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from varsparq.functions.text import file_chromosome


def read_listing(spark: SparkSession, path: str) -> DataFrame:
    """fname, datetime, size, chromosome of the lines of a directory listing, columns apart by blanks; shorter lines are left out (IO-19)."""
    parts = F.split(F.trim("value"), r"\s+")
    lines = spark.read.text(path).where(F.size(parts) >= 4).select(parts.alias("p"))
    return lines.select(F.col("p")[0].alias("fname"), F.concat_ws(" ", F.col("p")[1], F.col("p")[2]).alias("datetime"), F.col("p")[3].alias("size"), file_chromosome(F.col("p")[0]).alias("chromosome"))


def read_targets(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    """Track tables of several species (TSV with a header, first column the index), with idx, species, source, assay and name (IO-21).

    source is the eighth part of the file's path, assay what stands before the first colon of the description, name what
    stands behind it up to a comma.
    """
    told = []
    for species, path in paths.items():
        table = spark.read.csv(path, sep="\t", header=True)
        first = table.columns[0]
        told.append(table.select(F.col(first).try_cast("long").alias("idx"), *(c for c in table.columns if c != first), F.lit(species).alias("species")))
    both = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), told)
    behind = F.split("description", ":", 2)
    return both.withColumns({"source": F.get(F.split("file", "/"), 7), "assay": F.substring_index("description", ":", 1), "name": F.substring_index(F.get(behind, 1), ",", 1)})


def save_json(df: DataFrame, path: str, compress: bool = False, mode: str = "overwrite") -> None:
    """Write rows as JSON lines, gzipped on demand (IO-16)."""
    df.write.mode(mode).option("compression", "gzip" if compress else "none").json(path)


def load_json(spark: SparkSession, path: str, schema: str | None = None, error: bool = True, force: bool = False) -> DataFrame | None:
    """Rows of JSON files, gzipped or not; None where there are none, or with ``force``. A broken line is an error, or with error=False a row less (IO-17)."""
    if force:
        return None
    reader = spark.read.option("mode", "FAILFAST" if error else "DROPMALFORMED")
    try:
        return (reader.schema(schema) if schema else reader).json(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def read_datasets(spark: SparkSession, folder: str) -> DataFrame:
    """Rows of all Parquet datasets below a folder, with the name of each one's folder as dataset (IO-23)."""
    return spark.read.option("recursiveFileLookup", "true").parquet(folder).withColumn("dataset", F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2))


def export_scores(tables: dict[str, DataFrame], path: str, force: bool = False, not_null: list[str] | None = None) -> DataFrame:
    """Write each table to a folder of its name unless it is there, and give all their rows with the name as dataset (IO-09).

    Files keep rows with nulls; ``not_null`` only leaves them out of what is given back.
    """
    found = []
    for name, table in tables.items():
        spark, own = table.sparkSession, f"{path}/{name}"
        try:
            there = None if force else spark.read.parquet(own)
        except AnalysisException as e:
            if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
                raise
            there = None
        if there is None:
            table.write.mode("overwrite").parquet(own)
            there = spark.read.parquet(own)
        found.append(there.withColumn("dataset", F.lit(name)))
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), found)
    return rows.na.drop(subset=not_null) if not_null else rows
