"""Collections of binary files, one member each, and functions over their members (IO-24, K-11)."""

from __future__ import annotations

import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from varsparq.functions.text import file_chromosome
from varsparq.operators.ordering import row_index


def read_collection(spark: SparkSession, folder: str, suffix: str = ".trees.tsz", metadata: DataFrame | None = None) -> DataFrame:
    """name, path, chromosome, size, content of the files of a folder that end with ``suffix``; contents are read when a function needs them.

    ``metadata`` (name, ...) is joined where a member has it.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", f"*{suffix}").load(folder)
    name = F.regexp_replace(F.substring_index("path", "/", -1), f"{re.escape(suffix)}$", "")
    found = files.select(name.alias("name"), "path", file_chromosome(name).alias("chromosome"), F.col("length").alias("size"), "content")
    return found if metadata is None else found.join(metadata, "name", "left")


def _guarded(f: Callable[[], list[dict]]) -> tuple[list[dict], str | None]:
    try:
        return f(), None
    except Exception as e:  # noqa: BLE001  whatever a function raises
        return [], f"{type(e).__name__}: {e}"


def map_members(members: DataFrame, f: Callable[[str, bytes], list[dict]], schema: str) -> DataFrame:
    """name, the columns of ``schema`` and error: rows that ``f`` gives for each member, or one with its error.

    Members are groups of their own, so a task holds one content at a time. Names tell members apart.
    """
    names = [c.strip().split(" ")[0] for c in schema.split(",")]

    def rows(part: pd.DataFrame) -> pd.DataFrame:
        name, content = part["name"].iloc[0], bytes(part["content"].iloc[0])
        found, error = _guarded(lambda: f(name, content))
        if error:
            found = [dict.fromkeys(names)]
        return pd.DataFrame(found, columns=names, dtype=object).assign(name=name, error=error)[["name", *names, "error"]]

    return members.select("name", "content").groupBy("name").applyInPandas(rows, f"name string, {schema}, error string")


def filter_members(members: DataFrame, predicate: Callable[[bytes], bool]) -> DataFrame:
    """Members for which ``predicate`` holds; one that it fails on is left out."""
    told = map_members(members, lambda _, content: [{"keep": bool(predicate(content))}], "keep boolean")
    return members.join(told.where("keep").select("name"), "name", "left_semi")


def map_batches(members: DataFrame, f: Callable[[list[tuple[str, bytes]]], list[dict]], schema: str, size: int = 10) -> DataFrame:
    """batch, the columns of ``schema`` and error: rows that ``f`` gives for each ``size`` members in the order of names (the last batch may be smaller)."""
    names = [c.strip().split(" ")[0] for c in schema.split(",")]
    placed = row_index(members.select("name"), ["name"], "_at").select("name", F.floor(F.col("_at") / size).alias("batch"))
    dealt = members.join(placed, "name").select("batch", "name", "content")

    def rows(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("name")
        found, error = _guarded(lambda: f([(n, bytes(c)) for n, c in zip(part["name"], part["content"], strict=True)]))
        if error:
            found = [dict.fromkeys(names)]
        return pd.DataFrame(found, columns=names, dtype=object).assign(batch=part["batch"].iloc[0], error=error)[["batch", *names, "error"]]

    return dealt.groupBy("batch").applyInPandas(rows, f"batch long, {schema}, error string")
