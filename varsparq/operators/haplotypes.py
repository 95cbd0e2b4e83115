"""Haplotypes and alignments in long form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def unique_haplotypes(calls: DataFrame) -> DataFrame:
    """hash, variants, n_haplotypes, first of each distinct set of variants; calls: haplotype, variant (A-26, H-08, H-09).

    A haplotype's list is bounded by the variants of a region.
    """
    sets = calls.groupBy("haplotype").agg(F.array_sort(F.collect_set("variant")).alias("variants"))
    keyed = sets.withColumn("hash", F.md5(F.array_join(F.col("variants").cast("array<string>"), ",")))
    return keyed.groupBy("hash").agg(F.count("*").alias("n_haplotypes"), F.min("haplotype").alias("first"), F.min(F.size("variants")).alias("n_variants"))


def alignment(seqs: DataFrame) -> DataFrame:
    """Gappy alignment on reference coordinates: (name, seq, coords) to (name, row) with - for gaps; of bases at one coordinate the last holds (H-03)."""
    cells = seqs.select("name", F.posexplode(F.arrays_zip(F.split("seq", "").alias("base"), F.col("coords").alias("coord"))).alias("at", "c")).select("name", "at", "c.base", "c.coord")
    last = cells.groupBy("name", "coord").agg(F.max_by("base", "at").alias("base"))
    span = last.agg(F.min("coord").alias("low"), F.max("coord").alias("high"))
    grid = seqs.select("name").crossJoin(F.broadcast(span)).select("name", F.explode(F.sequence("low", "high")).alias("coord"))
    full = grid.join(last, ["name", "coord"], "left").withColumn("base", F.coalesce("base", F.lit("-")))
    rows = full.groupBy("name").agg(F.array_sort(F.collect_list(F.struct("coord", "base"))).alias("_r"))
    return rows.select("name", F.array_join(F.col("_r.base"), "").alias("row"))


def consensus(cells: DataFrame) -> DataFrame:
    """The most frequent base of each position (pos, base), ties to the smaller byte, with its share (H-04, H-05, H-06)."""
    counts = cells.groupBy("pos", "base").count()
    w = Window.partitionBy("pos")
    ranked = counts.withColumns({"share": F.col("count") / F.sum("count").over(w), "n_bases": F.count("*").over(w), "_r": F.row_number().over(w.orderBy(F.desc("count"), F.ascii("base")))})
    return ranked.where("_r = 1").select("pos", "base", "share", "n_bases")


def variant_window(df: DataFrame, context: int) -> DataFrame:
    """window and flag around a variant (seq, coords, pos, alt): 0 inserted, 1 already there, 2 position deleted, then all N (H-12)."""
    at = F.array_position("coords", F.col("pos"))
    width = 2 * context + 1
    around = lambda mid: F.concat(F.substring("seq", at.cast("int") - context, F.lit(context)), mid, F.substring("seq", at.cast("int") + 1, F.lit(context)))
    have = F.substring("seq", at.cast("int"), F.lit(1))
    flag = F.when(at == 0, 2).when(have == F.col("alt"), 1).otherwise(0)
    return df.withColumns({"flag": flag, "window": F.when(at == 0, F.lit("N" * width)).otherwise(around(F.col("alt")))})


def stacked(df: DataFrame, haps: str) -> DataFrame:
    """A row for each haplotype of an array of them: row 2 i and 2 i + 1 of sample i when ploidy is two (H-01)."""
    rows = df.select("*", F.posexplode(haps).alias("ploid", "hap"))
    return rows.withColumn("row", F.col("sample") * F.size(haps) + F.col("ploid")).drop(haps)


def complexity(cells: DataFrame) -> DataFrame:
    """1 - mean share of the most frequent base over positions, and mean number of further bases (H-06)."""
    c = consensus(cells)
    return c.agg((1 - F.avg("share")).alias("max_af"), F.avg(F.col("n_bases") - 1).alias("mean_var"))


def frequency_complexity(variants: DataFrame, keys: list[str], af: str, start: str, end: str) -> DataFrame:
    """Sum of allele frequencies over the length of a region (H-07)."""
    return variants.groupBy(*keys).agg((F.sum(af) / (F.max(end) - F.min(start))).alias("complexity"))


def haplotype_matrix(calls: DataFrame) -> DataFrame:
    """hap (the first of equal ones), variant, present: the binary matrix of distinct haplotypes in coordinate form (H-08, H-11).

    calls: haplotype, variant. Haplotypes with equal sets of variants are one.
    """
    sets = calls.groupBy("haplotype").agg(F.array_sort(F.collect_set("variant")).alias("variants"))
    first = sets.groupBy("variants").agg(F.min("haplotype").alias("hap"))
    return first.select("hap", F.explode("variants").alias("variant")).withColumn("present", F.lit(1))


def flat_index(df: DataFrame, region: str, sample: str, ploid: str, samples: int, ploidy: int) -> DataFrame:
    """Adds the flat index of (region, sample, ploid), and the three read back from it; an index out of its range is an error (H-13)."""
    inside = F.col(sample).between(0, samples - 1) & F.col(ploid).between(0, ploidy - 1) & (F.col(region) >= 0)
    flat = F.when(inside, (F.col(region) * samples + F.col(sample)) * ploidy + F.col(ploid)).otherwise(F.raise_error(F.lit("an index is out of its range")).cast("long"))
    whole = df.withColumn("flat", flat)
    back = {"r": F.floor(F.col("flat") / (samples * ploidy)), "s": F.floor(F.col("flat") / ploidy) % samples, "p": F.col("flat") % ploidy}
    return whole.withColumns(back)


def align_tracks(tracks: DataFrame, variant_pos: int, length: int, fill: float) -> DataFrame:
    """Values of each haplotype on a common grid of ``length`` places around a variant, missing ones filled (H-16).

    tracks: hap, coords (array), values (array). Coordinates below 0 and of 2 ** 31 - 1 and above are padding.
    """
    cells = tracks.select("hap", F.explode(F.arrays_zip(F.col("coords").alias("c"), F.col("values").alias("v"))).alias("x")).select("hap", F.col("x.c").alias("c"), F.col("x.v").alias("v"))
    start = variant_pos - length // 2
    real = cells.where((F.col("c") >= 0) & (F.col("c") < 2**31 - 1)).groupBy("hap", "c").agg(F.first("v").alias("v"))
    grid = tracks.select("hap").distinct().select("hap", F.explode(F.sequence(F.lit(start), F.lit(start + length - 1))).alias("c"))
    return grid.join(real, ["hap", "c"], "left").select("hap", (F.col("c") - start).alias("place"), F.coalesce("v", F.lit(fill)).alias("v"))


def splice_sites(genes: DataFrame) -> DataFrame:
    """Donor and acceptor positions from comma lists of exon starts and ends: inner bounds, mirrored on the - strand (H-18)."""
    bounds = lambda c: F.filter(F.transform(F.split(c, ","), lambda x: x.try_cast("long")), lambda x: x.isNotNull())
    starts, ends = bounds("exon_starts"), bounds("exon_ends")
    after, before = F.slice(starts, 2, F.greatest(F.size(starts) - 1, F.lit(0))), F.slice(ends, 1, F.greatest(F.size(ends) - 1, F.lit(0)))
    plus = F.col("strand") == "+"
    kinds = F.array(F.struct(F.lit("p5").alias("kind"), F.when(plus, before).otherwise(after).alias("at")), F.struct(F.lit("p3").alias("kind"), F.when(plus, after).otherwise(before).alias("at")))
    return genes.select("name", "strand", F.explode(kinds).alias("k")).select("name", "strand", "k.kind", F.explode("k.at").alias("pos"))


def padded_genes(genes: DataFrame, padding: int = 10_000) -> DataFrame:
    """Gene intervals with padding, not below 0 (H-19)."""
    return genes.withColumns({"start": F.greatest(F.col("start") - padding, F.lit(0)), "end": F.col("end") + padding})


def spliced(seq: str, starts: str, sizes: str) -> Column:
    """The blocks of a sequence joined (H-20)."""
    parts = F.transform(F.arrays_zip(F.col(starts).alias("a"), F.col(sizes).alias("n")), lambda b: F.substr(F.col(seq), b["a"] + 1, b["n"]))
    return F.array_join(parts, "")


def population_matrix(calls: DataFrame, site: str, population: str, genotype: str) -> DataFrame:
    """Mean genotype of each site over the samples of each population (H-23)."""
    return calls.groupBy(population, site).agg(F.avg(genotype).alias("mean_genotype"))


def mutated(seq: str, alphabet: str, seed: int, ids: list[str]) -> Column:
    """A sequence with one base replaced by the next of the alphabet, at a place drawn by a seeded hash of the row's ids (F-15)."""
    n = F.length(seq)
    at = F.pmod(F.xxhash64(F.lit(seed), *ids), n).cast("int")
    table = alphabet[1:] + alphabet[0]
    base = F.translate(F.substr(F.col(seq), at + 1, F.lit(1)), alphabet, table)
    return F.when(n > 0, F.concat(F.substr(F.col(seq), F.lit(1), at), base, F.substr(F.col(seq), at + 2, n))).otherwise(F.col(seq))
