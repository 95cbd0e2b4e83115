"""Splice scores of both strands from predicted acceptor and donor probabilities, and their flat table (K-09, IO-12, IO-13)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

STRANDS = ("pos", "neg")
KINDS = ("acceptor_gain", "acceptor_loss", "donor_gain", "donor_loss")
METADATA = ["variant_idx", "chromosome", "position", "ref_allele", "alt_allele", "sample_id", "hap_id", "flag"]
#: Columns of the flat table, in order.
FLAT = [*METADATA, "max_delta_score", "max_delta_coord", "max_delta_score_type", "max_delta_strand", *(f"{s}_{k}_max{c}" for s in STRANDS for k in KINDS for c in ("", "_coord"))]


def gains_and_losses(ref: Column, alt: Column, annotated: Column) -> tuple[Column, Column]:
    """Arrays over positions: alt - ref outside of annotated sites, and ref - alt inside (F-38)."""
    d = F.zip_with(alt, ref, lambda a, r: a - r)
    return F.zip_with(d, annotated, lambda x, m: x * (1 - m)), F.zip_with(d, annotated, lambda x, m: -x * m)


def score_windows(windows: DataFrame) -> DataFrame:
    """The 28 columns of FLAT for each window: 8 greatest scores with their coordinates, and the greatest of all with its type and strand.

    windows: METADATA, ref_coord, and for each strand the arrays {strand}_{acceptor, donor}_{ref, alt} and the 0/1 arrays
    {strand}_{acceptor, donor}_sites, all over the same positions. The first position counts among equal scores, and the
    first kind in the order of STRANDS and KINDS.
    """
    tracks = {}
    for strand in STRANDS:
        for site in ("acceptor", "donor"):
            name = f"{strand}_{site}"
            gain, loss = gains_and_losses(F.col(f"{name}_ref"), F.col(f"{name}_alt"), F.col(f"{name}_sites"))
            tracks |= {f"{name}_gain": gain, f"{name}_loss": loss}
    made = windows.withColumns({f"_{k}": v for k, v in tracks.items()})
    best = made.withColumns({f"{k}_max": F.array_max(f"_{k}") for k in tracks})
    at = lambda k: F.get("ref_coord", (F.array_position(F.col(f"_{k}"), F.col(f"{k}_max")) - 1).cast("int"))
    best = best.withColumns({f"{k}_max_coord": at(k) for k in tracks})
    names = [f"{s}_{k}" for s in STRANDS for k in KINDS]
    scores = best.withColumn("max_delta_score", F.greatest(*(f"{k}_max" for k in names)))
    first = lambda value: F.coalesce(*(F.when(F.col(f"{k}_max") == F.col("max_delta_score"), value(k)) for k in names))
    told = {"max_delta_coord": first(lambda k: F.col(f"{k}_max_coord")), "max_delta_score_type": first(lambda k: F.lit(k.split("_", 1)[1])), "max_delta_strand": first(lambda k: F.lit(k.split("_")[0]))}
    return scores.withColumns(told).select(*FLAT)


def write_splice_scores(scored: DataFrame, path: str, mode: str = "error") -> None:
    """Write the flat table as Snappy Parquet by chromosome."""
    scored.write.mode(mode).option("compression", "snappy").partitionBy("chromosome").parquet(path)
