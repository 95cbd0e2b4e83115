"""Readers, writers and splice scores on small files and tables."""

from __future__ import annotations

import gzip
import random

import pytest

from varsparq.operators import splicing
from varsparq.sources import metadata, variants


def test_listing(spark, tmp_path):
    (tmp_path / "l.txt").write_text("  x.full.chr1.vcf.gz   2019-06-06 14:28   26G  \n\nshort line\nx.full.chrX.vcf.gz.tbi 2020-02-12 11:17 146K\n")
    got = [tuple(r) for r in metadata.read_listing(spark, str(tmp_path / "l.txt")).collect()]
    assert got == [("x.full.chr1.vcf.gz", "2019-06-06 14:28", "26G", "chr1"), ("x.full.chrX.vcf.gz.tbi", "2020-02-12 11:17", "146K", "chrX")]


def test_targets(spark, tmp_path):
    (tmp_path / "h.txt").write_text("\tidentifier\tfile\tdescription\n0\tE1\t/a/b/c/d/e/f/enc/x.w5\tDNASE:liver, adult, male\n1\tE2\tx\tplain\n")
    (tmp_path / "m.txt").write_text("\tidentifier\tfile\tdescription\textra\n0\tE3\t/a/b/c/d/e/f/fantom/x\tCAGE:brain: cortex\tz\n")
    rows = metadata.read_targets(spark, {"human": str(tmp_path / "h.txt"), "mouse": str(tmp_path / "m.txt")}).orderBy("species", "idx").collect()
    assert [(r.idx, r.species, r.source, r.assay, r["name"], r.extra) for r in rows] == [(0, "human", "enc", "DNASE", "liver", None), (1, "human", None, "plain", None, None), (0, "mouse", "fantom", "CAGE", "brain: cortex", "z")]


def test_json(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, None)], "k long, v string")
    for compress in (False, True):
        metadata.save_json(df, str(tmp_path / f"j{compress}"), compress)
        assert sorted(map(tuple, metadata.load_json(spark, str(tmp_path / f"j{compress}"), "k long, v string").collect()), key=str) == [(1, "a"), (2, None)]
        assert list((tmp_path / f"j{compress}").glob("*.json.gz" if compress else "*.json"))
    assert metadata.load_json(spark, str(tmp_path / "none")) is None and metadata.load_json(spark, str(tmp_path / "jTrue"), force=True) is None
    with gzip.open(tmp_path / "bad.json.gz", "wt") as f:
        f.write('{"k": 1}\n{"k": \n')
    assert [r.k for r in metadata.load_json(spark, str(tmp_path / "bad.json.gz"), "k long", error=False).collect()] == [1]
    with pytest.raises(Exception, match="MALFORMED"):
        metadata.load_json(spark, str(tmp_path / "bad.json.gz"), "k long").collect()


def test_datasets_and_export(spark, tmp_path):
    one, two = spark.createDataFrame([(1, 1.0), (2, None)], "k long, v double"), spark.createDataFrame([(3, 3.0)], "k long, v double")
    path = str(tmp_path / "out")
    assert {(r.dataset, r.k) for r in metadata.export_scores({"a": one, "b": two}, path, not_null=["v"]).collect()} == {("a", 1), ("b", 3)}
    assert metadata.export_scores({"a": two, "b": two}, path).count() == 3  # what is there stays, with its null
    assert metadata.export_scores({"a": two}, path, force=True).count() == 1
    assert {(r.dataset, r.k) for r in metadata.read_datasets(spark, path).collect()} == {("a", 3), ("b", 3)}


def test_beds(spark, tmp_path):
    (tmp_path / "x.bed").write_text("chrom\tchromStart\tchromEnd\tname\tscore\tREF\tALT\nchr1\t5\t6\tn\t1.5\tA\tG\nchr1\t7\t8\tm\t\tA\t\n")
    bed = variants.read_bed(spark, str(tmp_path / "x.bed"))
    assert [(r.site, r.score) for r in bed.collect()] == [("n", 1.5)]
    variants.write_bed(bed.drop("site"), str(tmp_path / "out"))
    assert variants.read_bed(spark, str(tmp_path / "out")).collect() == bed.collect()
    (tmp_path / "exons.v1.bed").write_text("1\t2\t3\n")
    assert [r.region_key for r in variants.read_regions(spark, str(tmp_path / "exons*.bed"), "c string, s int, e int").collect()] == ["exons"]


def test_splice_scores_are_the_loops(spark, tmp_path):
    draw = random.Random(7)
    rows = []
    for k in range(30):
        row = {"variant_idx": k, "chromosome": f"chr{k % 2}", "position": 100 + k, "ref_allele": "A", "alt_allele": "G", "sample_id": "s", "hap_id": "0", "flag": 0, "ref_coord": [1000 + k + p for p in range(9)]}
        for s in splicing.STRANDS:
            for site in ("acceptor", "donor"):
                row |= {f"{s}_{site}_{x}": [round(draw.random(), 1) for _ in range(9)] for x in ("ref", "alt")} | {f"{s}_{site}_sites": [draw.randint(0, 1) for _ in range(9)]}
        rows.append(row)
    scored = splicing.score_windows(spark.createDataFrame(rows))
    assert len(scored.columns) == 28
    for got in scored.collect():
        row, best = rows[got.variant_idx], None
        for s in splicing.STRANDS:
            for kind in splicing.KINDS:
                site, what = kind.split("_")
                d = [a - r for a, r in zip(row[f"{s}_{site}_alt"], row[f"{s}_{site}_ref"], strict=True)]
                m = row[f"{s}_{site}_sites"]
                x = [v * (1 - w) if what == "gain" else -v * w for v, w in zip(d, m, strict=True)]
                at = x.index(max(x))
                assert got[f"{s}_{kind}_max"] == pytest.approx(x[at]) and got[f"{s}_{kind}_max_coord"] == row["ref_coord"][at]
                if best is None or x[at] > best[0]:
                    best = (x[at], row["ref_coord"][at], kind, s)
        assert (got.max_delta_score, got.max_delta_coord, got.max_delta_score_type, got.max_delta_strand) == best
    splicing.write_splice_scores(scored, str(tmp_path / "s"))
    assert spark.read.parquet(str(tmp_path / "s")).where("chromosome = 'chr1'").count() == 15 and list((tmp_path / "s").glob("chromosome=chr1/*.snappy.parquet"))
