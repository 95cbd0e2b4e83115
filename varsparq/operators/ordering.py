"""Places, running totals, ranks and quantiles in an order, exact and without a task that sees a whole group.

Rows are range partitioned once and written with their partition and their place in it, as a second evaluation of a range
partition can draw other bounds. What comes before a partition is then a sum over partitions. A group that spans several
partitions is the first or the last of each, so the table of what comes before and after has two rows for each partition.
"""

from __future__ import annotations

from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from varsparq.storage import materialise

#: Facts about keys that are sent to all tasks, at most.
FEW = 10_000
#: Rows of a partition that dealt() makes, about.
TASK_ROWS = 250_000
#: Rows of a partition, about, count up from the partition's number times this.
_ROOM = 33


def dealt(df: DataFrame, keys: list[str]) -> DataFrame:
    """``df`` hashed by ``keys`` into partitions of about TASK_ROWS rows, for groups of nearly as many keys as rows: tables of a task then
    are as large for any input, where partial sums would hold a whole split and later ones whatever partitions a session has. One count more.
    """
    return df.repartition(max(1, -(-df.count() // TASK_ROWS)), *keys)


def ordered(df: DataFrame, order: list[str | Column]) -> DataFrame:
    """``df`` in an order of columns, written once: adds __part, which rises with the order, and the place __k in it, from 0."""
    placed = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__m", F.monotonically_increasing_id())
    return materialise(placed, "ordered").withColumns({"__part": F.shiftright("__m", _ROOM), "__k": F.col("__m").bitwiseAND((1 << _ROOM) - 1)}).drop("__m")


def row_index(df: DataFrame, order: list[str], name: str = "row_idx") -> DataFrame:
    """Adds the place of each row in an order of columns that tells rows apart, from 0 (W-04)."""
    rows = ordered(df, order)
    counts = rows.groupBy("__part").agg(F.count("*").alias("_n"))
    before = counts.select("__part", (F.sum("_n").over(Window.orderBy("__part")) - F.col("_n")).alias("_before"))  # a row for each partition
    return rows.join(F.broadcast(before), "__part").select(*df.columns, (F.col("_before") + F.col("__k")).alias(name))


def running_totals(df: DataFrame, keys: list[str], order: list[str | Column], sums: dict[str, str], following: dict[str, str] | None = None) -> DataFrame:
    """Adds, for each name of ``sums``, the sum of its column over the rows of a key up to each row, in an order that tells the rows of a key apart (W-05).

    For each name of ``following``, adds its column's value in the next row of the key, null in the last.
    """
    following = following or {}
    rows = ordered(df, [*keys, *order])
    told = [*(F.sum(c).alias(f"_s_{n}") for n, c in sums.items()), *(F.min_by(c, "__k").alias(f"_f_{n}") for n, c in following.items())]
    parts = rows.groupBy("__part", *keys).agg(*told)
    every = Window.partitionBy(*keys).orderBy("__part")  # a row for each partition that a key spans
    earlier = every.rowsBetween(Window.unboundedPreceding, -1)
    carried = [*(F.sum(f"_s_{n}").over(earlier).alias(f"_before_{n}") for n in sums), *(F.lead(f"_f_{n}").over(every).alias(f"_after_{n}") for n in following)]
    spans = F.count("*").over(Window.partitionBy(*keys)).alias("_spans")
    more = parts.select(F.col("__part").alias("_p"), *(F.col(k).alias(f"_key_{k}") for k in keys), *carried, spans).where("_spans > 1")
    same = [F.col("__part") == F.col("_p"), *(F.col(k).eqNullSafe(F.col(f"_key_{k}")) for k in keys)]
    here = Window.partitionBy("__part", *keys).orderBy("__k")
    upto = here.rowsBetween(Window.unboundedPreceding, 0)
    local = {f"_local_{n}": F.sum(c).over(upto) for n, c in sums.items()} | {f"_next_{n}": F.lead(c).over(here) for n, c in following.items()} | {"_more": F.lead(F.lit(1)).over(here)}
    joined = rows.withColumns(local).join(F.broadcast(more), reduce(and_, same), "left")  # two rows for each partition at most: its first and its last key
    found = [*((F.coalesce(F.col(f"_before_{n}"), F.lit(0)) + F.col(f"_local_{n}")).alias(n) for n in sums), *(F.when(F.col("_more").isNull(), F.col(f"_after_{n}")).otherwise(F.col(f"_next_{n}")).alias(n) for n in following)]
    return joined.select(*df.columns, *found)


def with_facts(rows: DataFrame, facts: DataFrame, keys: list[str]) -> DataFrame:
    """``rows`` with the columns of ``facts``, one row for each key, by an inner join that no frequent key pulls into one task.

    Up to FEW facts, a bounded table, go to all tasks, and rows stay where they are.
    """
    if not keys:
        return rows.join(F.broadcast(facts))  # one row
    few = facts.limit(FEW + 1).count() <= FEW
    return rows.join(F.broadcast(facts) if few else facts, keys)


def value_ranks(df: DataFrame, keys: list[str], value: str, counts: dict[str, Column]) -> DataFrame:
    """keys, value, n, further ``counts`` (sums over the rows of a value) and the average rank of the value among those of its key, from 1.

    Equal values are counted before they are ordered, so a frequent one is a single row. Rows without a value don't count.
    """
    told = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("n"), *(c.alias(k) for k, c in counts.items()))
    return running_totals(told, keys, [value], {"_upto": "n"}).withColumn("rank", F.col("_upto") - (F.col("n") - 1) / 2).drop("_upto")


def exact_quantiles(df: DataFrame, keys: list[str], value: str, fractions: list[float], accuracy: int = 10_000, plain: bool = False) -> DataFrame:
    """keys and q, the quantiles of each key with linear interpolation; exact, though no task sorts or holds a key's values.

    A sketch brackets each quantile between two values of nearby ranks; counts of the rows below and up to them, exact, say
    how many values of the bracket come first. Only rows in a bracket, about 4 of ``accuracy`` for each quantile, are
    ordered. Where the counts show that a bracket misses its quantile, it is widened to all values of the key. Values are
    read three times; sums, which can differ in their last digits each time, are written first unless ``df`` is ``plain``:
    each value follows from a row of a table.
    """
    v = F.col(value).cast("double")
    rows = df.where(v.isNotNull()).select(*keys, v.alias("_v"))
    rows = rows if plain else materialise(rows, "values")
    span = 2 / accuracy
    ends = [x for f in fractions for x in (max(0.0, f - span), min(1.0, f + span))]
    sketch = rows.groupBy(*keys).agg(F.count("*").alias("_n"), F.min("_v").alias("_min"), F.max("_v").alias("_max"), F.percentile_approx("_v", ends, accuracy).alias("_e"))
    sketch = materialise(sketch, "brackets")
    low, high = (lambda i: F.col("_e")[2 * i]), (lambda i: F.col("_e")[2 * i + 1])
    v, places = F.col("_v"), range(len(fractions))
    told = [c for i in places for c in (F.count_if(v < low(i)).alias(f"_below{i}"), F.count_if(v <= high(i)).alias(f"_upto{i}"), F.min(F.when(v > high(i), v)).alias(f"_next{i}"))]
    counted = with_facts(with_facts(rows, sketch, keys).groupBy(*keys).agg(*told), sketch, keys)
    for i, f in enumerate(fractions):
        at = F.lit(f) * (F.col("_n") - 1)
        good = (F.col(f"_below{i}") <= F.floor(at)) & (F.col(f"_upto{i}") > F.floor(at))
        counted = counted.withColumn(f"_t{i}", F.struct(F.lit(i).alias("i"), at.alias("at"), F.when(good, low(i)).otherwise(F.col("_min")).alias("low"), F.when(good, high(i)).otherwise(F.col("_max")).alias("high"), F.when(good, F.col(f"_below{i}")).otherwise(F.lit(0)).alias("below"), F.when(good, F.col(f"_next{i}")).alias("next")))
    targets = materialise(counted.select(*keys, *(f"_t{i}" for i in places)), "targets")
    inside = [v.between(F.col(f"_t{i}.low"), F.col(f"_t{i}.high")) for i in places]
    few = with_facts(rows, targets, keys).where(reduce(or_, inside)).withColumn("_t", F.explode(F.array_compact(F.array(*(F.when(c, F.col(f"_t{i}")) for i, c in enumerate(inside))))))
    steps = few.groupBy(*keys, "_t", "_v").agg(F.count("*").alias("_c"))
    upto = F.col("_t.below") + F.sum("_c").over(Window.partitionBy(*keys, "_t.i").orderBy("_v"))
    first, last = F.floor("_t.at"), F.ceil("_t.at")
    holds = lambda k: F.max(F.when((F.col("_upto") > k) & (F.col("_upto") - F.col("_c") <= k), F.col("_v")))
    found = steps.withColumn("_upto", upto).groupBy(*keys, "_t").agg(holds(first).alias("_a"), holds(last).alias("_b"))
    b, part = F.coalesce("_b", "_t.next"), F.col("_t.at") - F.floor("_t.at")
    q = F.when(part == 0, F.col("_a")).otherwise(F.col("_a") * (1 - part) + b * part)
    listed = found.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(F.col("_t.i").alias("i"), q.alias("q")))).alias("_q"))  # one entry for each fraction
    return listed.select(*keys, F.col("_q.q").alias("q"))
