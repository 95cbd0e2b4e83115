"""Windows of a matrix by a summed-area table, and coverage by intervals, both on running sums that no task holds whole."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from varsparq.operators.intervals import interval_join
from varsparq.operators.ordering import dealt, running_totals


def summed_area(ones: DataFrame, rows: int, columns: int) -> DataFrame:
    """(i, j, s): the sum of v over all cells up to row i and column j of a rows x columns matrix, absent cells 0.

    One running sum goes along each row, the next down each column of the first.
    """
    line = ones.sparkSession.range(rows).select(F.col("id").alias("i"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(columns - 1).cast("long"))).alias("j"))
    cells = ones.groupBy(F.col("i").cast("long").alias("i"), F.col("j").cast("long").alias("j")).agg(F.sum("v").alias("v"))
    grid = line.join(cells, ["i", "j"], "left").select("i", "j", F.coalesce("v", F.lit(0)).alias("v"))
    along = running_totals(grid, ["i"], ["j"], {"r": "v"})
    return running_totals(along.select("i", "j", "r"), ["j"], ["i"], {"s": "r"}).select("i", "j", "s")


def window_sums(ones: DataFrame, rows: int, columns: int, height: int, width: int) -> DataFrame:
    """(i, j, s): the sum of each height x width window that starts at (i, j), from four corners of the summed-area table."""
    corner = lambda di, dj, sign: F.struct((F.col("i") + di).alias("i"), (F.col("j") + dj).alias("j"), (F.col("s") * sign).alias("s"))
    corners = F.array(corner(1 - height, 1 - width, 1), corner(1, 1 - width, -1), corner(1 - height, 1, -1), corner(1, 1, 1))
    moved = summed_area(ones, rows, columns).select(F.explode(corners).alias("c")).select("c.*")
    inside = F.col("i").between(0, rows - height) & F.col("j").between(0, columns - width)
    return moved.where(inside).groupBy("i", "j").agg(F.sum("s").alias("s"))


def dense_window(ones: DataFrame, rows: int, columns: int, height: int = 10, width: int = 10, least: float = 0.2, most: float = 0.8) -> DataFrame:
    """The first window, by row and then by column, with a share of ones from ``least`` to ``most``: i, j, share; no row if there is none (W-13).

    ``ones`` are cells (i, j, v) at places of the order that the caller has brought rows and columns into.
    """
    share = F.col("s") / (height * width)
    return window_sums(ones, rows, columns, height, width).select("i", "j", share.alias("share")).where(F.col("share").between(least, most)).orderBy("i", "j").limit(1)


def with_any_one(ones: DataFrame, found: DataFrame, height: int, width: int, axis: str) -> DataFrame:
    """Rows (axis i) or columns (axis j) that hold a 1 within the window's columns or rows (W-13, include_any_1_row and _col)."""
    other, reach = ("j", width) if axis == "i" else ("i", height)
    at = found.select(F.col(other).alias("_at"))  # a row
    inside = (F.col(other) >= F.col("_at")) & (F.col(other) < F.col("_at") + reach)
    return ones.where("v > 0").join(F.broadcast(at), inside).select(axis).distinct()


def coverage(intervals: DataFrame, keys: list[str], start: str = "start", end: str = "end") -> DataFrame:
    """keys, start, end, depth: stretches of equal depth above 0 of half-open intervals, from a sweep over their ends.

    Work grows with intervals, not with bases. Intervals without length or with a null end cover nothing.
    """
    real = intervals.where(F.col(start) < F.col(end))
    ends = F.explode(F.array(F.struct(F.col(start).alias("at"), F.lit(1).alias("step")), F.struct(F.col(end).alias("at"), F.lit(-1).alias("step"))))
    steps = real.select(*keys, ends.alias("e")).groupBy(*keys, F.col("e.at").alias("start")).agg(F.sum("e.step").alias("_step")).where("_step <> 0")
    swept = running_totals(steps, keys, ["start"], {"depth": "_step"}, {"end": "start"})
    return swept.where("depth > 0").select(*keys, "start", "end", "depth")


def annotation_tracks(regions: DataFrame, beds: DataFrame, bin_size: int = 10_000) -> DataFrame:
    """region, track (name_pos or name_neg), start, end: where a strand's intervals of a set cover a region, as stretches of 1 from the region's start (H-14).

    regions: chrom, region, start, end. beds: name, chrom, start, end, strand; repeated intervals count once. Neighbouring
    stretches of different depth are one stretch.
    """
    track = F.concat("name", F.when(F.col("strand") == "+", "_pos").otherwise("_neg"))
    own = beds.where(F.col("strand").isin("+", "-")).select("chrom", track.alias("track"), "start", "end")
    own = dealt(own, own.columns).distinct()
    covered = merged(coverage(own, ["chrom", "track"]), ["chrom", "track"])
    left = regions.select("chrom", "region", F.col("start").alias("l_start"), F.col("end").alias("l_end"))
    right = covered.select("chrom", "track", F.col("start").alias("r_start"), F.col("end").alias("r_end"))
    both = interval_join(left, right, ["chrom"], bin_size)
    return both.select("region", "track", (F.greatest("l_start", "r_start") - F.col("l_start")).alias("start"), (F.least("l_end", "r_end") - F.col("l_start")).alias("end"))


def merged(stretches: DataFrame, keys: list[str]) -> DataFrame:
    """Stretches that touch become one: only their outer ends remain, as +1 and -1 cancel where one ends and the next begins."""
    return coverage(stretches.select(*keys, "start", "end"), keys).select(*keys, "start", "end")


def strand_of(name: Column) -> Column:
    """The strand that a track's name ends with."""
    return F.when(F.endswith(name, F.lit("_pos")), "+").when(F.endswith(name, F.lit("_neg")), "-")
