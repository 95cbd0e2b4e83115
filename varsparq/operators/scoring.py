"""Resumable scoring with pluggable scorers, in micro-batches with a commit log.

A table of scores is a folder: ``scores`` holds the cells of all runs, ``commits`` one row for each batch that was written
whole. The work list is an anti-join against committed cells, so a run that fails loses the batch it was in, and the next
run scores what is left. A pair that a scorer can't score is a row with its error and no values; the next run tries it
again. With ``force`` cells are scored again, and the value of the latest run counts.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from varsparq.storage import materialise

#: wild-type sequences, mutant sequences -> a column for each slot
Scorer = Callable[[pd.Series, pd.Series], pd.DataFrame]
#: Slots that describe the scoring itself (K-06).
EXTRA_SLOTS = ["len_seq_wt", "len_seq_mut", "output_length", "time_run_vep", "time_total", "timestamp"]
COMMITS = "run long, batch int, model string, forced boolean, seconds double, at timestamp"


@dataclass
class Model:
    """A scorer's slots, sequences of a call, and a loader that a Python worker calls once (K-03 to K-05)."""

    slots: list[str]
    batch_size: int
    load: Callable[[], Scorer]


SCORERS: dict[str, Model] = {}


def scorer(name: str, slots: list[str], batch_size: int = 1000) -> Callable[[Scorer], Scorer]:
    """Register a function as a model that needs no loading."""

    def keep(f: Scorer) -> Scorer:
        SCORERS[name] = Model(slots, batch_size, lambda: f)
        return f

    return keep


def model_of(name: str) -> Model:
    """A model by its name, or by the longest registered name that ``name`` begins with."""
    fitting = [k for k in SCORERS if name.lower().startswith(k.lower())]
    if not fitting:
        raise ValueError(f"no scorer for {name}; there are {', '.join(sorted(SCORERS))}")
    return SCORERS[max(fitting, key=len)]


@scorer("gc_shift", ["GC", "LEN"])
def gc_shift(wt: pd.Series, mut: pd.Series) -> pd.DataFrame:
    """A stand-in model: change of the share of G and C, and of the length."""
    share = lambda s: s.str.count("[GC]") / s.str.len().clip(lower=1)
    return pd.DataFrame({"GC": share(mut) - share(wt), "LEN": (mut.str.len() - wt.str.len()).astype(float)})


class StopScoring(Exception):
    """Raised by a scorer to end the run, unlike other exceptions, which are kept as errors of a pair."""


def _scored(run: Scorer, slots: list[str], part: pd.DataFrame) -> tuple[pd.DataFrame, list[str | None]]:
    """Values of the pairs of ``part`` and errors; where a call fails, its pairs are tried one by one."""
    try:
        found = run(part["seq_wt"], part["seq_mut"])[slots]
        return found.set_index(part.index), [None] * len(part)
    except StopScoring:
        raise
    except Exception as e:  # noqa: BLE001  whatever a model raises
        if len(part) == 1:
            return pd.DataFrame({s: [float("nan")] for s in slots}, index=part.index), [f"{type(e).__name__}: {e}"]
        each = [_scored(run, slots, part.iloc[k : k + 1]) for k in range(len(part))]
        return pd.concat([x for x, _ in each]), [e for _, es in each for e in es]


def score_long(pairs: DataFrame, model: str, keys: list[str], extra: bool = False) -> DataFrame:
    """keys, model, slot, value, error of each pair (keys, seq_wt, seq_mut): a row for each slot, or one with the error (K-03, K-10).

    With ``extra`` there are rows for EXTRA_SLOTS too. NaN values become null.
    """
    own = model_of(model)
    kinds = dict(pairs.dtypes)
    slots, size = own.slots, own.batch_size

    def batches(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        run = own.load()
        for whole in it:
            for at in range(0, len(whole), size):
                part, began = whole.iloc[at : at + size], time.time()
                found, errors = _scored(run, slots, part)
                names = list(slots)
                if extra:
                    took = (time.time() - began) / len(part)
                    sizes = part["seq_wt"].str.len(), part["seq_mut"].str.len(), float(len(slots)), took, took, began
                    found, names = found.assign(**dict(zip(EXTRA_SLOTS, sizes, strict=True))), names + EXTRA_SLOTS
                out = part[keys].join(found).assign(error=errors)
                good = out[out.error.isna()].melt(id_vars=[*keys, "error"], value_vars=names, var_name="slot", value_name="value")
                bad = out.loc[out.error.notna(), [*keys, "error"]].assign(slot=None, value=None)
                for x in (good, bad):
                    if len(x):
                        yield x.assign(model=model, value=x.value.astype("float64"))[[*keys, "model", "slot", "value", "error"]]

    schema = ", ".join(f"`{k}` {kinds[k]}" for k in keys) + ", model string, slot string, value double, error string"
    found = pairs.select(*keys, "seq_wt", "seq_mut").mapInPandas(batches, schema)
    return found.withColumn("value", F.when(~F.isnan("value"), F.col("value")))


def _table(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame | None:
    try:
        return spark.read.schema(schema).parquet(path) if schema else spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return None


def commits(spark: SparkSession, path: str) -> DataFrame:
    """The log of a table of scores."""
    found = _table(spark, f"{path}/commits", COMMITS)
    return spark.createDataFrame([], COMMITS) if found is None else found


def _cells(spark: SparkSession, path: str) -> DataFrame | None:
    found = _table(spark, f"{path}/scores")
    return found if found is None else found.join(F.broadcast(commits(spark, path).select("run", "batch").distinct()), ["run", "batch"], "left_semi")  # a row for each batch


def read_results(spark: SparkSession, path: str, keys: list[str]) -> DataFrame | None:
    """keys, model, slot, value of committed batches; where a run was forced, the latest run's value of a cell."""
    found = _cells(spark, path)
    if found is None:
        return None
    rows = found.where("error is null").select(*keys, "model", "slot", "value", "run")
    if commits(spark, path).where("forced").limit(1).count():
        rows = rows.groupBy(*keys, "model", "slot").agg(F.max_by("value", "run").alias("value"))
    return rows.drop("run")


def read_errors(spark: SparkSession, path: str, keys: list[str]) -> DataFrame | None:
    """keys, model, error, run of pairs that a committed batch could not score."""
    found = _cells(spark, path)
    return found if found is None else found.where("error is not null").select(*keys, "model", "error", "run")


def _limited(pairs: DataFrame, limits: dict[str, int | list[str] | None]) -> DataFrame:
    """Pairs of the listed values of each column, or of its first so many among all pairs."""
    rows = pairs
    for column, limit in limits.items():
        if isinstance(limit, list):
            rows = rows.where(F.col(column).isin(limit))
        elif limit is not None:
            rows = rows.join(F.broadcast(pairs.select(column).distinct().orderBy(column).limit(limit)), column, "left_semi")  # as short as the limit
    return rows


def work_list(pairs: DataFrame, model: str, keys: list[str], path: str, force: bool = False) -> DataFrame:
    """Pairs without a value for each slot of the model; with ``force`` all pairs (P-10, K-01)."""
    done = read_results(pairs.sparkSession, path, keys)
    if force or done is None:
        return pairs
    slots = model_of(model).slots
    whole = done.where((F.col("model") == model) & F.col("slot").isin(slots) & F.col("value").isNotNull()).groupBy(*keys).agg(F.count_distinct("slot").alias("_n"))
    return pairs.join(whole.where(F.col("_n") == len(slots)).select(*keys), keys, "left_anti")


def resume(
    pairs: DataFrame, model: str, keys: list[str], path: str, batch_rows: int = 1_000_000, force: bool = False, limit_sites: int | list[str] | None = None,
    limit_samples: int | list[str] | None = None, site_filter: Column | None = None, site: str = "site", sample: str = "sample", extra: bool = False,
) -> int:
    """Score what is missing of ``pairs`` (keys, seq_wt, seq_mut) into the table at ``path``; gives the number of batches written (K-01, K-02).

    Limits are taken from all pairs before the work list, each by itself. A batch has about ``batch_rows`` pairs; the list is
    written once, by batch, so no batch looks for its pairs in the others'. Pairs with a null key are scored in each run.
    """
    spark = pairs.sparkSession
    if site_filter is not None:
        pairs = pairs.where(site_filter)
    few = _limited(pairs, {site: limit_sites, sample: limit_samples})
    todo = work_list(few, model, keys, path, force)
    todo = materialise(todo.select(*keys, "seq_wt", "seq_mut"), "work")
    batches = -(-todo.count() // batch_rows)
    run = (commits(spark, path).agg(F.max("run")).first()[0] or 0) + 1
    dealt = todo if batches < 2 else materialise_by(todo.withColumn("_b", F.pmod(F.xxhash64(*keys), F.lit(batches)).cast("int")), "_b")
    for b in range(batches):
        began = time.time()
        own = dealt if batches < 2 else dealt.where(F.col("_b") == b).drop("_b")
        scored = score_long(own, model, keys, extra).withColumns({"run": F.lit(run).cast("long"), "batch": F.lit(b)})
        scored.write.mode("append").partitionBy("model").parquet(f"{path}/scores")
        row = spark.range(1).select(F.lit(run).cast("long").alias("run"), F.lit(b).alias("batch"), F.lit(model).alias("model"), F.lit(force).alias("forced"), F.lit(time.time() - began).alias("seconds"), F.current_timestamp().alias("at"))
        row.coalesce(1).write.mode("append").parquet(f"{path}/commits")
    return batches


def materialise_by(df: DataFrame, column: str) -> DataFrame:
    """``df`` written by the values of a column, so that a reader of one value reads its files only."""
    from varsparq.storage import table_path

    path = table_path(df.sparkSession, "by")
    df.write.partitionBy(column).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def wide_results(results: DataFrame, keys: list[str], slots: list[str]) -> DataFrame:
    """A row for each pair with a column for each slot: the tidy frame of a loop over sites and haplotypes (K-10)."""
    return results.groupBy(*keys).pivot("slot", slots).agg(F.first("value"))
