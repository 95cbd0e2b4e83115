"""Where queries are registered, and what they share: tables by role, and the same as views of the SQL."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_ORACLES: dict[str, str] = {}

#: The views of the SQL, the same as the frames below.
VIEWS = """scores AS (SELECT l_partkey AS site, l_suppkey AS sample, l_linenumber % 2 AS ploid, l_returnflag AS slot, ln(l_extendedprice / l_quantity) AS value,
  l_extendedprice / 1000 AS ref, l_extendedprice * (1 - l_discount) / 1000 AS alt, l_orderkey FROM lineitem),
meta AS (SELECT s_suppkey AS sample, n_name AS population, r_name AS superpopulation FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
sites AS (SELECT p_partkey AS site, p_brand AS gene, split_part(p_type, ' ', 1) AS clinsig, p_size AS size, p_retailprice AS price FROM part),
"""


class Tables:
    """Frames by role, for one folder."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    @property
    def scores(self) -> DataFrame:
        p, d = F.col("l_extendedprice"), F.col("l_discount")
        return self.lineitem.select(F.col("l_partkey").alias("site"), F.col("l_suppkey").alias("sample"), (F.col("l_linenumber") % 2).alias("ploid"), F.col("l_returnflag").alias("slot"), F.ln(p / F.col("l_quantity")).alias("value"), (p / 1000).alias("ref"), (p * (1 - d) / 1000).alias("alt"), "l_orderkey")

    @property
    def meta(self) -> DataFrame:
        n = self.nation.join(self.region, F.col("n_regionkey") == F.col("r_regionkey"))
        return self.supplier.join(n, F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_suppkey").alias("sample"), F.col("n_name").alias("population"), F.col("r_name").alias("superpopulation"))

    @property
    def sites(self) -> DataFrame:
        return self.part.select(F.col("p_partkey").alias("site"), F.col("p_brand").alias("gene"), F.substring_index("p_type", " ", 1).alias("clinsig"), F.col("p_size").alias("size"), F.col("p_retailprice").alias("price"))


def query(name: str, sql: str | None = None) -> Callable[[Callable[[Tables], DataFrame]], Callable[[Tables], DataFrame]]:
    def keep(f: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        _QUERIES[name] = lambda spark, folder: f(Tables(spark, folder))
        if sql:
            _ORACLES[name] = "WITH " + sql if sql.startswith("RECURSIVE") else "WITH " + VIEWS + sql.strip() if re.match(r"\s*\w+ AS \(", sql) else "WITH " + VIEWS.rstrip().rstrip(",") + "\n" + sql.strip()
        return f

    return keep


def r6(c: Column | str) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, 6)


def rounded(v: Column) -> Column:
    """A double to six digits that keeps its sign where it becomes 0, as the SQL does; elements of arrays are told apart by it."""
    return F.signum(v) * F.round(F.abs(v), 6)


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracles() -> dict[str, str]:
    return dict(_ORACLES)
