"""Interval, point and distance joins by bins: an equi-join on the bin, then the exact condition. No cross join."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import AtomicType

from varsparq.storage import materialise

#: Rows of a side of a block of pairs, about; pairs of a task, about; tasks, at most.
BLOCK, PAIRS, TASKS = 16_384, 40_000_000, 20_000
#: Contacts that are sent to all tasks, at most.
CONTACTS = 1_000_000


def spread_join(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """An inner join by columns whose pairs are many: both sides of a frequent key are cut by hash into blocks of BLOCK rows, and blocks meet.

    A task then sees no more than some blocks, however few keys there are. What is sent once for each block of the other side
    are blocks, a sorted array for each column, which take a fraction of their rows' room. Both sides are read once more for their counts.
    """
    left, right = (d.dropna(subset=on) for d in (left, right))
    sizes = left.groupBy(*on).agg(F.count("*").alias("_a")).join(right.groupBy(*on).agg(F.count("*").alias("_b")), on)
    pairs = sizes.agg(F.sum(F.col("_a").cast("double") * F.col("_b"))).first()[0] or 0.0  # one number
    if pairs <= PAIRS:
        return left.join(right, on)
    parts = min(math.ceil(pairs / PAIRS), TASKS)
    cuts = sizes.select(*on, F.ceil(F.col("_a") / BLOCK).alias("_left"), F.ceil(F.col("_b") / BLOCK).alias("_right")).where("_left > 1 or _right > 1")

    def dealt(side: DataFrame, own: str, other: str) -> DataFrame:
        n, m = F.coalesce(own, F.lit(1)), F.coalesce(other, F.lit(1))
        told = side.withColumn("_h", F.xxhash64(*side.columns)).join(F.broadcast(cuts), on, "left")  # a row for each frequent key
        rest = [c for c in side.columns if c not in on][::-1] or ["_h"]  # what comes last differs least: positions before names
        block = F.collect_list(F.struct(*rest))
        ordered = F.sort_array(block) if all(isinstance(told.schema[c].dataType, AtomicType) for c in rest) else block
        blocks = told.groupBy(*on, F.pmod("_h", n).alias(f"{own}_at"), m.alias("_met")).agg(ordered.alias("_rows")).select(*on, f"{own}_at", "_met", *(F.col("_rows")[c].alias(c) for c in rest))
        sent = blocks.withColumn(f"{other}_at", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_met") - 1))).drop("_met").repartition(parts, *on, "_left_at", "_right_at")
        at = sent.select(*sent.columns, F.explode(F.sequence(F.lit(0), F.size(rest[0]) - 1)).alias("_k"))
        return at.select(*on, "_left_at", "_right_at", *(F.get(c, "_k").alias(c) for c in side.columns if c not in on))

    return dealt(left, "_left", "_right").join(dealt(right, "_right", "_left").hint("merge"), [*on, "_left_at", "_right_at"]).drop("_left_at", "_right_at")


def interval_join(left: DataFrame, right: DataFrame, on: list[str], bin_size: int, closed: bool = False, how: str = "inner") -> DataFrame:
    """Pairs of overlapping intervals (J-06, J-07, J-08). left: on, l_start, l_end; right: on, r_start, r_end.

    Half-open unless ``closed``. Each pair is found in the bin of its later start only, so pairs need no distinct.
    how: inner, or left_semi (rows of left with any overlap, once each, by all their columns).
    """
    last = 0 if closed else 1
    bins = lambda s, e: F.explode(F.sequence(F.floor(F.col(s) / bin_size), F.floor(F.greatest(F.col(e) - last, F.col(s)) / bin_size)))
    if how == "left_semi":  # whether a row overlaps any depends on its interval only, and on distinct ones of the other side
        own = [*on, "l_start", "l_end"]
        hits = interval_join(left.select(*own).distinct(), right.select(*on, "r_start", "r_end").distinct(), on, bin_size, closed)
        return left.join(hits.select(*own).distinct(), own, "left_semi").distinct()
    a, b = left.withColumn("_bin", bins("l_start", "l_end")), right.withColumn("_bin", bins("r_start", "r_end"))
    pairs = spread_join(a, b, [*on, "_bin"])
    meet = (F.col("l_start") <= F.col("r_end")) & (F.col("r_start") <= F.col("l_end")) if closed else (F.col("l_start") < F.col("r_end")) & (F.col("r_start") < F.col("l_end"))
    return pairs.where(meet & (F.col("_bin") == F.floor(F.greatest("l_start", "r_start") / bin_size))).drop("_bin")


def in_region_sets(left: DataFrame, regions: DataFrame, on: list[str], names: list[str], bin_size: int) -> DataFrame:
    """``left`` with a boolean for each region set: whether the row overlaps any of its regions (J-07). regions: region_set, on, r_start, r_end.

    Flags follow from the interval of a row, so distinct intervals meet distinct regions, and flags meet the rows.
    """
    own = [*on, "l_start", "l_end"]
    hits = interval_join(left.select(*own).distinct(), regions.select("region_set", *on, "r_start", "r_end").distinct(), on, bin_size)
    flags = hits.groupBy(*own).agg(*(F.max(F.col("region_set") == n).alias(n) for n in names))
    return left.join(flags, own, "left").select(*left.columns, *(F.coalesce(n, F.lit(False)).alias(n) for n in names))


def distance_join(left: DataFrame, right: DataFrame, on: list[str], window: int) -> DataFrame:
    """Pairs with abs(l_pos - r_pos) <= window / 2 (J-09)."""
    half = window / 2
    a = left.withColumn("_bin", F.floor(F.col("l_pos") / window))
    b = right.withColumn("_bin", F.explode(F.sequence(F.floor((F.col("r_pos") - half) / window), F.floor((F.col("r_pos") + half) / window))))
    return spread_join(a, b, [*on, "_bin"]).where(F.abs(F.col("l_pos") - F.col("r_pos")) <= half).drop("_bin")


def lookup(left: DataFrame, regions: DataFrame, on: list[str], key: str, names: list[str], bin_size: int) -> DataFrame:
    """``left`` with the distinct ``names`` of the regions that each row overlaps, null where none does (J-08)."""
    found = interval_join(left, regions, on, bin_size).select(key, *names).distinct()
    return left.join(found, key, "left")


def anchor_pairs(points: DataFrame, contacts: DataFrame, on: list[str], bin_size: int) -> DataFrame:
    """u < w, contact: pairs of points of which one lies in the first and one in the second anchor of a contact (J-10).

    points: on, id, pos. contacts: on, contact, a1_start, a1_end, a2_start, a2_end, half-open. Each point of a contact says in
    which anchors it lies, so of two points that could be told both ways one way is left out, and pairs need no distinct.
    Contacts of one row with the same anchors have the same pairs: points meet distinct anchors, and contacts meet their pairs.
    """
    anchors = [*on, "a1_start", "a1_end", "a2_start", "a2_end"]
    rows, names = contacts.agg(F.count("contact"), F.count_distinct("contact")).first()
    alike = rows == names and rows <= CONTACTS  # points of several rows of a contact may meet
    key = anchors if alike else ["contact"]
    own = contacts.select(*anchors).distinct() if alike else contacts
    left = points.withColumns({"l_start": F.col("pos"), "l_end": F.col("pos") + 1}).drop("pos")
    ends = F.explode(F.array(*(F.struct(F.lit(a == "a1").alias("one"), F.col(f"{a}_start").alias("r_start"), F.col(f"{a}_end").alias("r_end")) for a in ("a1", "a2"))))
    told = list(dict.fromkeys([*on, *key]))
    right = own.select(*told, ends.alias("_e")).select(*told, "_e.*")
    found = interval_join(left, right, on, bin_size)
    near = materialise(found.groupBy(*key, "id").agg(F.max("one").alias("one"), F.max(~F.col("one")).alias("two")), "anchors")
    side = lambda n: near.where(n).select(*key, F.col("id").alias(f"_{n}"), F.col("one" if n == "two" else "two").alias(f"_{n}_also"))
    once = (F.col("_one") < F.col("_two")) | ((F.col("_one") > F.col("_two")) & ~(F.col("_one_also") & F.col("_two_also")))
    both = spread_join(side("one"), side("two"), key).where(once)
    if alike:
        both = both.join(F.broadcast(contacts.select(*key, "contact")), key)
    return both.select(F.least("_one", "_two").alias("u"), F.greatest("_one", "_two").alias("w"), "contact")


def liftover(rows: DataFrame, chain: DataFrame, pos: str, name: str, bin_size: int) -> DataFrame:
    """Adds the position in another build, or the old one where no chain block holds it, and whether it was lifted (F-41).

    chain: chrom, c_start, c_end (half-open, without overlap), shift. Blocks are met by bins.
    """
    blocks = chain.withColumn("_bin", F.explode(F.sequence(F.floor(F.col("c_start") / bin_size), F.floor((F.col("c_end") - 1) / bin_size))))
    blocks = blocks.select(F.col("chrom").alias("_chrom"), "_bin", "c_start", "c_end", "shift")
    at = rows.withColumn("_at", F.floor(F.col(pos) / bin_size))
    inside = (F.col("chrom") == F.col("_chrom")) & (F.col("_at") == F.col("_bin")) & (F.col(pos) >= F.col("c_start")) & (F.col(pos) < F.col("c_end"))
    found = at.join(blocks, inside, "left")
    return found.select(*rows.columns, F.coalesce(F.col(pos) + F.col("shift"), F.col(pos)).alias(name), F.col("shift").isNotNull().alias("lifted"))


def region_counts(points: DataFrame, regions: DataFrame, on: list[str], key: str, bin_size: int) -> DataFrame:
    """n: points in each region, 0 where there are none (A-32). points: on, pos; regions: key, on, r_start, r_end, half-open.

    Points of one position are counted before they meet regions.
    """
    counts = points.groupBy(*on, "pos").agg(F.count("*").alias("_n")).select(*on, F.col("pos").alias("l_start"), (F.col("pos") + 1).alias("l_end"), "_n")
    found = interval_join(counts, regions, on, bin_size).groupBy(key).agg(F.sum("_n").alias("n"))
    return regions.select(key).distinct().join(found, key, "left").na.fill(0, ["n"])


def splice_regions(exons: DataFrame) -> DataFrame:
    """Eight regions of each exon (chrom, start, end, name, strand), mirrored on the - strand (H-17)."""
    s, e, plus = F.col("start"), F.col("end"), F.col("strand") == "+"
    #: Offsets from the exon's end (donor) or start (acceptor), on the + strand; core is inside.
    donor = {"5ss_can": (0, 2), "5ss_iprox": (2, 6), "5ss_eprox": (-3, 0)}
    acceptor = {"3ss_can": (-2, 0), "3ss_iprox": (-17, -2), "bp_region": (-40, -17), "3ss_eprox": (0, 3)}
    rows = []
    for anchor, mirror, table in ((e, s, donor), (s, e, acceptor)):
        for name, (a, b) in table.items():
            rows.append(F.struct(F.lit(name).alias("region"), F.when(plus, anchor + a).otherwise(mirror - b).alias("r_start"), F.when(plus, anchor + b).otherwise(mirror - a).alias("r_end")))
    rows.append(F.struct(F.lit("exon_core").alias("region"), (s + 3).alias("r_start"), (e - 3).alias("r_end")))
    return exons.select("*", F.explode(F.array(*rows)).alias("_r")).select(*exons.columns, "_r.*")
