"""Queries against their SQL on small tables, and operators on shapes that broke them."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from pyspark.sql import functions as F

from varsparq.operators import intervals, matrix, rankings, relational, significance

SMALL = Path("/root/testdata/sf0.001")


def _cells(rows) -> list[tuple]:
    return sorted(tuple(round(float(x), 6) if isinstance(x, float) else x for x in r) for r in rows)


def _same(spark, name: str) -> None:
    con = duckdb.connect()
    for p in SMALL.glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    got = entry.queries()[name](spark, str(SMALL))
    want = con.execute(entry.oracle_sql()[name])
    assert got.columns == [c[0] for c in want.description]
    assert _cells(map(tuple, got.collect())) == _cells(want.fetchall())


@pytest.mark.skipif(not SMALL.exists(), reason="the driver's tables")
@pytest.mark.parametrize("name", ["a04_variance_ranking", "a13_matrix_fill_mean", "a13_matrix_fill_median", "a13_matrix_fill_mode", "x08_fill_missing_whole", "j06_interval_join", "j07_interval_semi_join", "j07_interval_semi_join_whole", "j09_distance_join", "j10_anchor_pairs", "j21_sequence_pairs", "w03_minmax", "w03_robust", "t14_percentile_bands", "w10_track_scores", "x10_distances"])
def test_queries_equal_their_sql(spark, name):
    _same(spark, name)


def test_a_negative_value_that_rounds_to_zero_keeps_its_sign(spark, tmp_path):
    values = [0.0] * 22 + [-1e-7, 1e-7, -0.5, -0.0000015, float("nan"), float("-inf")] + [0.25] * 36
    rows = spark.createDataFrame([(1, values), (2, None)], "vec_id long, embedding array<float>")
    rows.write.parquet(str(tmp_path / "embeddings.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    for name in ("lineitem", "supplier", "nation", "region", "part"):  # views that the SQL names but does not read
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SMALL}/{name}.parquet'")
    want = dict(con.execute(entry.oracle_sql()["s08_centre_crop"]).fetchall())
    got = {r.vec_id: r.mid for r in entry.queries()["s08_centre_crop"](spark, str(tmp_path)).collect()}
    assert got[2] is want[2] is None
    assert [(str(x), math.copysign(1, x)) for x in got[1] if x == x] == [(str(x), math.copysign(1, x)) for x in want[1] if x == x]
    assert str(got[1][0]) == "-0.0" and math.isnan(got[1][4])


def test_a_grid_is_not_shuffled(spark, monkeypatch):
    """Tiles of a few names: cells, gaps and fills by row or column as by brute force, and no exchange behind the cells of the grid."""
    monkeypatch.setattr(matrix, "SIDE", 4)
    held = {(i, j): float(i * 10 + j) for i in range(11) for j in range(9) if (i * 7 + j * 3) % 4 == 0 and i != 5}
    m = spark.createDataFrame([(i, j, v) for (i, j), v in held.items()] + [(99, 1, 5.0)], "i long, j long, v double")  # row 99 is no row of the grid
    rows, columns = spark.range(11).withColumnRenamed("id", "i"), spark.range(9).withColumnRenamed("id", "j")
    mean = lambda v: sum(v) / len(v) if v else None
    for how, of in (("rowmean", lambda i, j: mean([v for (a, _), v in held.items() if a == i])), ("colmean", lambda i, j: mean([v for (_, b), v in held.items() if b == j] + [5.0] * (j == 1))), (0.5, lambda i, j: 0.5)):
        grid = matrix.fill_rows(m, rows, columns, how)
        got = {(r.i, r.j): r.v for r in grid.collect()}
        assert len(got) == grid.count() == 99
        for i in range(11):
            for j in range(9):
                assert got[i, j] == pytest.approx(held.get((i, j), of(i, j))), (how, i, j)
        plan = grid._jdf.queryExecution().optimizedPlan().toString()
        above = plan[: plan.index("Generate explode")]
        assert "Repartition" not in above and "Join" not in above.split("Union")[1].split("Relation")[0] and "Aggregate" not in above


def test_pairs_of_few_keys_are_dealt_in_blocks(spark, monkeypatch):
    """Frequent keys, a null key and repeated rows give the pairs of a plain join, spread over many tasks."""
    left = spark.range(900).selectExpr("if(id % 90 = 0, null, id % 3) as k", "id div 2 as a")
    right = spark.range(500).selectExpr("if(id % 70 = 0, null, if(id < 400, 0, id % 4)) as k", "id % 300 as b")
    want = sorted(map(tuple, left.join(right, ["k"]).collect()))
    monkeypatch.setattr(intervals, "BLOCK", 50)
    monkeypatch.setattr(intervals, "PAIRS", 1000)
    got = intervals.spread_join(left, right, ["k"])
    assert sorted(map(tuple, got.collect())) == want
    sizes = [n for n in got.rdd.mapPartitions(lambda it: [sum(1 for _ in it)]).collect() if n]
    assert len(sizes) > 40 and max(sizes) < len(want) / 8


def test_anchor_pairs_without_a_distinct(spark):
    """Points in both anchors, and one id at two places, give each pair once."""
    points = [(1, 1, 3), (1, 2, 4), (1, 3, 9), (1, 3, 4), (1, 4, 30), (2, 5, 4)]
    contacts = [(1, 7, 0, 5, 4, 10), (2, 8, 0, 5, 4, 10), (1, 9, 3, 5, 3, 5)]
    want = set()
    for g, c, s1, e1, s2, e2 in contacts:
        for h, a, p in points:
            for k, b, q in points:
                if g == h == k and a != b and s1 <= p < e1 and s2 <= q < e2:
                    want.add((min(a, b), max(a, b), c))
    got = intervals.anchor_pairs(spark.createDataFrame(points, "g long, id long, pos int"), spark.createDataFrame(contacts, "g long, contact long, a1_start int, a1_end int, a2_start int, a2_end int"), ["g"], 4)
    rows = [tuple(r) for r in got.select("u", "w", "contact").collect()]
    assert sorted(rows) == sorted(want)
    assert "Aggregate" not in got._jdf.queryExecution().optimizedPlan().toString()


def test_sequences_are_compared_in_blocks(spark, monkeypatch):
    """Unequal lengths, letters beyond ASCII and nulls, over several blocks; few rows are shuffled."""
    monkeypatch.setattr(relational, "SEQUENCES", 3)
    seqs = ["ACGT", "ACG", "TCGTA", None, "\u00e9\U0001f600GT", "ACGT", "", "\u00e9\U0001f601G"]
    rows = [(k % 2, k, None if k == 5 else k % 3, s) for k, s in enumerate(seqs + seqs)]
    got = {(r.i, r.j): (r.same_phase, r.similarity) for r in relational.sequence_pairs(spark.createDataFrame(rows, "g int, id long, phase int, seq string"), ["g"]).collect()}
    want = {}
    for g, i, p, s in rows:
        for h, j, q, t in rows:
            if g == h and i != j:
                share = None if s is None or t is None else sum(a == b for a, b in zip(s, t)) / max(len(s), len(t), 1)  # noqa: B905
                want[i, j] = (None if p is None or q is None else p == q, share)
    assert got == want


def test_rows_of_few_keys_stay_where_they_are(spark):
    df = spark.range(1000).selectExpr("id % 2 as slot", "cast(id as double) as value", "id")
    for method in ("minmax", "robust"):
        plan = relational.scale_within(df, ["slot"], "value", method, plain=True)._jdf.queryExecution().optimizedPlan().toString()
        assert "strategy=broadcast" in plan


def test_permutations_are_drawn_where_rows_are_dealt(spark):
    """Only the rows times sets of permutations are shuffled, and the draw is that of the seeded hashes."""
    rows = [("x", float(k * 7 % 23), k % 3 == 0) for k in range(40)] + [("y", float(k), k > 4) for k in range(9)] + [("z", 1.0, True)]
    df = spark.createDataFrame(rows, "k string, v double, a boolean")
    got = {r.k: (r.observed, r.p) for r in significance.permuted_wasserstein(df, "k", "v", F.col("a"), 30, 5).collect()}
    assert set(got) == {"x", "y"}
    for key in got:
        own = sorted((v, a) for k, v, a in rows if k == key)
        n = sum(a for _, a in own)
        hashes = spark.range(1, 31).select(F.col("id").cast("int").alias("_perm"), F.explode(F.sequence(F.lit(1), F.lit(len(own)))).alias("_id")).select("_perm", "_id", F.xxhash64(F.lit(5), "_perm", "_id").alias("h")).collect()
        distances = []
        for perm in range(31):
            order = sorted(range(len(own)), key=lambda k: (not own[k][1], k)) if perm == 0 else [i - 1 for _, i in sorted((r.h, r._id) for r in hashes if r._perm == perm)]
            a, b = [own[k][0] for k in order[:n]], [own[k][0] for k in order[n:]]
            points = sorted({v for v, _ in own})
            distances.append(sum(abs(sum(x <= p for x in a) / len(a) - sum(x <= p for x in b) / len(b)) * (q - p) for p, q in zip(points, points[1:], strict=False)))
        assert got[key][0] == pytest.approx(distances[0])
        assert got[key][1] == pytest.approx((sum(d >= distances[0] - 1e-12 for d in distances[1:]) + 1) / 31)


def test_no_array_holds_the_haplotypes_of_a_place(spark):
    cells = spark.range(200).selectExpr("id as hap", "id % 2 as track", "id % 5 as place", "exp(sin(id)) as v")
    for metric in ("mad", "entropy", "differential_entropy"):
        scores = rankings.track_scores(cells, metric)
        assert scores.count() == 2
        assert "collect_list" not in scores._jdf.queryExecution().optimizedPlan().toString()


def test_distances_by_blocks_of_rows(spark, monkeypatch):
    """Over one block and over several, pairs are those of a plain join; no join or aggregate of pairs is left."""
    cells = {(i, j): ((i * 31 + j * 17) % 23) / 7 for i in range(40) for j in range(30) if (i * 5 + j * 3) % 4 == 0 or j == i}
    m = spark.createDataFrame([(i, j, v) for (i, j), v in cells.items()] + [(None, 1, 2.0), (3, None, 2.0), (4, 29, None)], "i long, j long, v double")
    cells.pop((4, 29), None)
    want = {}
    for i in range(40):
        for k in range(i + 1, 40):
            shared = [j for j in range(30) if (i, j) in cells and (k, j) in cells]
            if shared:
                want[i, k] = math.sqrt(sum((cells[i, j] - cells[k, j]) ** 2 for j in shared))
    for lines in (2048, 7):
        monkeypatch.setattr(matrix, "LINES", lines)
        found = matrix.distances(m)
        rows = found.collect()
        assert len(rows) == len(want) and {(r.i, r.k): r.distance for r in rows} == pytest.approx(want)
        assert "Join" not in found._jdf.queryExecution().optimizedPlan().toString()
