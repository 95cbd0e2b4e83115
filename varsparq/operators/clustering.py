"""Ward clustering of group centroids by rounds of reciprocal nearest neighbours (M-15), and importances of features for clusters (M-09)."""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import StringIndexer
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from varsparq.operators.ordering import row_index
from varsparq.storage import materialise


def centroids(cells: DataFrame, members: DataFrame, member: str, group: str) -> DataFrame:
    """(i, j, v): the mean of each column j over the members (rows i of ``cells``) of each group i; absent cells count as 0."""
    size = members.select(member, group).distinct().groupBy(group).agg(F.count("*").alias("_n"))
    own = cells.join(members.select(F.col(member).alias("i"), group).distinct(), "i")
    sums = own.groupBy(group, "j").agg(F.sum("v").alias("_s")).join(size, group)
    return sums.select(F.col(group).alias("i"), "j", (F.col("_s") / F.col("_n")).alias("v"))


def _squares(points: DataFrame) -> DataFrame:
    """(a, b, d): squared distances of rows a < b, absent cells 0, as |a|^2 + |b|^2 - 2 a.b."""
    norm = points.groupBy("i").agg(F.sum(F.col("v") * F.col("v")).alias("_q"))
    a, b = (norm.select(F.col("i").alias(n), F.col("_q").alias(f"_{n}")) for n in "ab")
    dots = points.select(F.col("i").alias("a"), "j", F.col("v").alias("_u")).join(points.select(F.col("i").alias("b"), "j", "v"), "j").where("a < b")
    dots = dots.groupBy("a", "b").agg(F.sum(F.col("_u") * F.col("v")).alias("_dot"))
    pairs = a.join(b, F.col("a") < F.col("b")).join(dots, ["a", "b"], "left")
    return pairs.select("a", "b", F.greatest(F.col("_a") + F.col("_b") - 2 * F.coalesce("_dot", F.lit(0.0)), F.lit(0.0)).alias("d"))


def ward(points: DataFrame) -> DataFrame:
    """step, left, right, distance, size: the merges of Ward's method over rows of cells (i, j, v), nearest first.

    A cluster is named by the smallest row in it; left < right, and the merged one keeps the name of left. Pairs of rows are
    a table, so rows are groups, not members. In a round all clusters that are each other's nearest merge at once and
    distances follow from those before; for Ward's criterion that gives the merges of the method taken one by one. Equal
    distances go to the smaller name.
    """
    clusters = materialise(points.select("i").distinct().select(F.col("i").alias("c"), F.lit(1).cast("long").alias("n")), "clusters")
    pairs = materialise(_squares(points), "pairs")
    merges = pairs.where("false").select(F.col("a").alias("left"), F.col("b").alias("right"), F.col("d").alias("distance"), F.lit(0).cast("long").alias("size"))
    left = clusters.count()
    while left > 1:
        both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"), "d"))
        nearest = materialise(both.groupBy("a").agg(F.min_by("b", F.struct("d", F.least("a", "b"), F.greatest("a", "b"))).alias("b"), F.min("d").alias("d")), "nearest")
        back = nearest.select(F.col("b").alias("a"), F.col("a").alias("b"))
        met = nearest.where("a < b").join(back, ["a", "b"])
        sizes = clusters.select(F.col("c").alias("b"), F.col("n").alias("_m"))
        met = materialise(met.join(clusters.withColumnRenamed("c", "a"), "a").join(sizes, "b").select("a", "b", "d", F.col("n").alias("na"), F.col("_m").alias("nb")), "met")
        merges = merges.unionByName(met.select(F.col("a").alias("left"), F.col("b").alias("right"), F.sqrt("d").alias("distance"), (F.col("na") + F.col("nb")).alias("size")))
        pairs = materialise(_after(pairs, met, clusters), "pairs")
        gone = met.select(F.col("b").alias("c"))
        grown = met.select(F.col("a").alias("c"), F.col("nb").alias("_more"))
        clusters = materialise(clusters.join(gone, "c", "left_anti").join(grown, "c", "left").select("c", (F.col("n") + F.coalesce("_more", F.lit(0))).alias("n")), "clusters")
        left = clusters.count()
    return merges.select(F.row_number().over(Window.orderBy("distance", "left")).alias("step"), "left", "right", "distance", "size")  # a row for each group but one


def _after(pairs: DataFrame, met: DataFrame, clusters: DataFrame) -> DataFrame:
    """Squared Ward distances of the clusters after merges of disjoint pairs (a, b, d, na, nb).

    With Ward's update twice, where both sides merge, the distance of A = a + b to C = c + e is a combination of the four
    distances between their parts and of the two merges.
    """
    part = met.select(F.col("a").alias("part"), F.col("a").alias("into"), F.col("d").alias("_w")).unionByName(met.select(F.col("b").alias("part"), F.col("a").alias("into"), F.col("d").alias("_w")))
    told = clusters.select(F.col("c").alias("part"), "n").join(part, "part", "left").select("part", "n", F.coalesce("into", "part").alias("into"), F.coalesce("_w", F.lit(0.0)).alias("_w"))
    whole = told.groupBy("into").agg(F.sum("n").alias("_all"), F.max("_w").alias("_w"))
    told = told.drop("_w").join(whole, "into")
    side = lambda s: told.select(*(F.col(c).alias(f"{c}_{s}") for c in ("part", "n", "into", "_all", "_w")))
    each = pairs.join(side("a"), F.col("a") == F.col("part_a")).join(side("b"), F.col("b") == F.col("part_b")).where("into_a <> into_b")
    flip = F.col("into_a") > F.col("into_b")
    pick = lambda x, y: F.when(flip, F.col(y)).otherwise(F.col(x))
    n1, n2 = F.col("n_a"), F.col("n_b")
    # squared centroid distance of parts: d * (n1 + n2) / (2 n1 n2); between means it is their weighted mean less the spread within both sides
    between = F.sum(n1 * n2 * F.col("d") * (n1 + n2) / (2 * n1 * n2))
    g = each.groupBy(pick("into_a", "into_b").alias("x"), pick("into_b", "into_a").alias("y"), pick("_all_a", "_all_b").alias("nx"), pick("_all_b", "_all_a").alias("ny"), pick("_w_a", "_w_b").alias("wx"), pick("_w_b", "_w_a").alias("wy")).agg(between.alias("s"))
    # d of a merge is 2 na nb / (na + nb) times its squared gap, so its spread about the mean is na nb gap^2 / n^2 = d / (2 n)
    gap = F.col("s") / (F.col("nx") * F.col("ny")) - F.col("wx") / (2 * F.col("nx")) - F.col("wy") / (2 * F.col("ny"))
    return g.select(F.col("x").alias("a"), F.col("y").alias("b"), F.greatest(2 * F.col("nx") * F.col("ny") / (F.col("nx") + F.col("ny")) * gap, F.lit(0.0)).alias("d"))


def feature_importances(cells: DataFrame, clusters: DataFrame, top: int = 10, trees: int = 100, seed: int = 42, one_vs_rest: bool = False) -> DataFrame:
    """site, importance of the ``top`` features by a random forest, with one_vs_rest for each cluster: cluster, site, importance (M-09).

    cells: (i, j, v), rows samples; columns that differ only in a last _number are added up. clusters: (i, cluster) as text;
    rows of sample REF, of negative (noise) and of missing clusters are left out. Absent cells are 0.
    """
    kept = clusters.where((F.col("cluster") >= "0") & (F.col("i").cast("string") != "REF"))
    summed = cells.join(kept.select("i"), "i", "left_semi").groupBy("i", F.regexp_replace(F.col("j").cast("string"), r"_\d+$", "").alias("site")).agg(F.sum("v").alias("v"))
    sites = materialise(row_index(summed.select("site").distinct(), ["site"], "k"), "sites")
    d = sites.count()
    held = summed.join(sites, "site").groupBy("i").agg(F.map_from_entries(F.collect_list(F.struct(F.col("k").cast("int"), "v"))).alias("_m"))
    values = F.transform(F.sequence(F.lit(0), F.lit(max(d - 1, 0))), lambda k: F.coalesce(F.try_element_at(F.col("_m"), k), F.lit(0.0)))
    empty = F.create_map().cast("map<int,double>")
    rows = kept.select("i", "cluster").join(held, "i", "left").withColumn("_m", F.coalesce("_m", empty)).select("cluster", array_to_vector(values).alias("features"))
    rows = materialise(rows.where(F.lit(d > 0)), "forest")

    def fitted(labelled: DataFrame) -> list[tuple[int, float]]:
        model = RandomForestClassifier(labelCol="_y", numTrees=trees, seed=seed, maxDepth=8).fit(labelled)
        return sorted(enumerate(model.featureImportances.toArray().tolist()), key=lambda x: -x[1])[:top]  # a number for each feature

    spark = cells.sparkSession
    names = [r.cluster for r in rows.select("cluster").distinct().orderBy("cluster").collect()]  # a few clusters
    found: list[tuple[str, int, float]] = []
    if one_vs_rest:
        for name in names:
            found += [(name, k, x) for k, x in fitted(rows.withColumn("_y", (F.col("cluster") == name).cast("double")))]
    elif names:
        indexed = StringIndexer(inputCol="cluster", outputCol="_y").fit(rows).transform(rows)
        found = [("", k, x) for k, x in fitted(indexed)]
    table = spark.createDataFrame(found, "cluster string, k long, importance double").join(sites, "k").select("cluster", "site", "importance")
    return table if one_vs_rest else table.drop("cluster")
