"""Queries of grouped summaries, rankings, sorts and set operations."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from varsparq.operators import rankings, relational, summaries
from varsparq.plans.registry import Tables, query, r6, rounded


def _scored(t: Tables) -> DataFrame:
    """Scores with their metadata; the small side, one row for each sample, is joined by broadcast if Spark sees that it is small."""
    return t.scores.join(t.meta, "sample")


query("a04_variance_ranking", """x AS (SELECT site, superpopulation, avg(value) AS m FROM scores JOIN meta USING (sample) GROUP BY ALL), v AS (SELECT site, var_samp(m) AS v FROM x GROUP BY site)
SELECT site, round(v, 6) AS v, row_number() OVER (ORDER BY round(v, 6) DESC, site) AS place FROM v WHERE v IS NOT NULL QUALIFY place <= 25""")(
    lambda t: rankings.ranked(relational.between_group_variance(t.scores, t.meta, "site", "sample", "superpopulation", "value").where("between_var is not null").select("site", r6("between_var").alias("v")), [F.desc("v"), F.col("site")], 25)
)
query("a07_site_summary_text", "x AS (SELECT clinsig, count(DISTINCT gene || '_' || site) AS n FROM sites GROUP BY clinsig) SELECT string_agg(clinsig || ': ' || n, ', ' ORDER BY clinsig) AS summary FROM x")(
    lambda t: summaries.class_summary(t.sites, ["gene", "site"], "clinsig")
)
query("a08_title", "SELECT CASE WHEN count(DISTINCT gene) = 1 THEN min(gene) ELSE 'gene: ' || count(DISTINCT gene) END AS gene, CASE WHEN count(DISTINCT 'x') = 1 THEN 'x' END AS kind FROM sites")(
    lambda t: summaries.title(t.sites.withColumn("kind", F.lit("x")), ["gene", "kind"])
)
query("a09_runtime_estimate", "x AS (SELECT l_partkey AS site, sum(l_quantity) AS s FROM lineitem GROUP BY 1) SELECT count(*) AS n_sites, round(avg(s), 6) AS seconds_per_site, round(avg(s) * 5000 / 4 / 86400, 6) AS days FROM x")(
    lambda t: summaries.runtime_estimate(t.lineitem, "l_partkey", "l_quantity", 5000, 4).select("n_sites", r6("seconds_per_site").alias("seconds_per_site"), r6("days").alias("days"))
)
for _fill, _sql in (("mean", "avg(v) OVER ()"), ("median", "(SELECT median(v) FROM x)"), ("mode", "(SELECT v FROM x GROUP BY v ORDER BY count(*) DESC, v LIMIT 1)")):
    query(f"a13_matrix_fill_{_fill}", f"x AS (SELECT sample, site, round(avg(value), 2) AS v FROM scores WHERE slot = 'A' GROUP BY ALL), g AS (SELECT sample, site FROM (SELECT DISTINCT sample FROM x), (SELECT DISTINCT site FROM x)), f AS (SELECT DISTINCT {_sql} AS f FROM x) SELECT sample, site, round(coalesce(v, f), 6) AS v FROM g LEFT JOIN x USING (sample, site), f")(
        lambda t, how=_fill: summaries.filled_matrix(t.scores.where("slot = 'A'").groupBy("sample", "site").agg(F.round(F.avg("value"), 2).alias("v")), "sample", "site", how, 6).select("sample", "site", "v")
    )
query("a13_duplicate_reference", "SELECT sample, site, p.ploid, round(avg(value), 6) AS v FROM scores JOIN (SELECT unnest([0, 1]) AS ploid) p ON (sample % 10 = 0 OR scores.ploid = p.ploid) GROUP BY ALL")(
    lambda t: summaries.with_reference_twice(t.scores, F.col("sample") % 10 == 0, "ploid").groupBy("sample", "site", "ploid").agg(r6(F.avg("value")).alias("v"))
)
query("a21_region_matrix", """x AS (SELECT site % 5 = 0 AS wb, site % 3 = 0 AS wd, size > 25 AS cb, price > 1200 AS cd, site % 4 AS we, size % 4 AS ce, ln(price) AS v FROM sites),
y AS (SELECT unnest(['b', 'd']) AS wt, unnest([wb, wd]) AS a, cb, cd, we, ce, v FROM x), z AS (SELECT wt, a, unnest(['b', 'd']) AS clin, unnest([cb, cd]) AS b, we, ce, v FROM y)
SELECT kind, wt, clin, round(avg(v), 6) AS v, count(*) AS n FROM (SELECT *, unnest(CASE WHEN we = ce THEN ['all', 'match'] ELSE ['all', 'mismatch', 'distance ' || abs(we - ce)] END) AS kind FROM z WHERE a AND b) GROUP BY ALL""")(
    lambda t: summaries.region_matrices(t.sites.select((F.col("site") % 5 == 0).alias("wb"), (F.col("site") % 3 == 0).alias("wd"), (F.col("size") > 25).alias("cb"), (F.col("price") > 1200).alias("cd"), (F.col("site") % 4).alias("we"), (F.col("size") % 4).alias("ce"), F.ln("price").alias("v")), {"b": "wb", "d": "wd"}, {"b": "cb", "d": "cd"}, "we", "ce", "v")
    .withColumn("v", r6("v"))
)
query("a23_group_lists", "x AS (SELECT DISTINCT gene, clinsig FROM sites WHERE size < 8), y AS (SELECT *, row_number() OVER (PARTITION BY gene ORDER BY clinsig) AS r, count(*) OVER (PARTITION BY gene) AS n FROM x) SELECT gene, list(clinsig ORDER BY clinsig) AS members FROM y WHERE n > 2 AND r <= 4 GROUP BY gene")(
    lambda t: summaries.group_lists(t.sites.where("size < 8"), "gene", "clinsig", 2, 4)
)
query("a27_strata", "SELECT gene, count(*) FILTER (clinsig = 'SMALL') AS SMALL, count(*) FILTER (clinsig = 'LARGE') AS LARGE FROM sites GROUP BY gene")(lambda t: t.sites.groupBy("gene").pivot("clinsig", ["SMALL", "LARGE"]).count().na.fill(0))
query("a29_collection_summary", "SELECT l_linestatus AS chrom, count(DISTINCT l_suppkey) AS num_samples, count(DISTINCT l_partkey) AS num_sites, count(*) AS num_mutations FROM lineitem GROUP BY 1")(
    lambda t: t.lineitem.groupBy(F.col("l_linestatus").alias("chrom")).agg(F.count_distinct("l_suppkey").alias("num_samples"), F.count_distinct("l_partkey").alias("num_sites"), F.count("*").alias("num_mutations"))
)
query("a30_variants_per_sequence", "x AS (SELECT site, sample, ploid, count(*) AS n FROM scores GROUP BY ALL) SELECT site, median(n) AS med, max(n) AS most FROM x GROUP BY site")(
    lambda t: t.scores.groupBy("site", "sample", "ploid").agg(F.count("*").alias("n")).groupBy("site").agg(F.median("n").alias("med"), F.max("n").alias("most"))
)
query("a31_variants_per_cohort", "SELECT superpopulation AS cohort, slot AS chrom, sample, count(*) AS n FROM scores JOIN meta USING (sample) GROUP BY ALL")(lambda t: _scored(t).groupBy(F.col("superpopulation").alias("cohort"), F.col("slot").alias("chrom"), "sample").agg(F.count("*").alias("n")))
query("a33_contact_dedup", "SELECT l_partkey, l_suppkey, max(l_discount) AS score FROM lineitem GROUP BY ALL")(lambda t: t.lineitem.groupBy("l_partkey", "l_suppkey").agg(F.max("l_discount").alias("score")))
query("a34_role_strength", "SELECT role, pos, round(avg(v), 6) AS strength FROM (SELECT 'wt' AS role, l_partkey AS pos, l_discount AS v FROM lineitem UNION ALL SELECT 'clinical', l_suppkey, l_discount FROM lineitem) GROUP BY ALL")(
    lambda t: summaries.role_strength(t.lineitem, {"wt": "l_partkey", "clinical": "l_suppkey"}, "l_discount").withColumn("strength", r6("strength"))
)
query("a36_relabel_sum", "SELECT CASE clinsig WHEN 'SMALL' THEN 'minor' WHEN 'MEDIUM' THEN 'minor' ELSE 'other' END AS label, gene, sum(size)::BIGINT AS n FROM sites GROUP BY ALL")(
    lambda t: summaries.relabelled_sum(t.sites, "clinsig", {"SMALL": "minor", "MEDIUM": "minor"}, "other", ["gene"], "size")
)
query("a37_sample_per_slot")(lambda t: rankings.sample_per_group(t.scores, ["slot"], ["site", "sample", "l_orderkey", "ploid"], 100, 7).select("slot", "site", "sample", "l_orderkey"))
query("a38_histogram", """x AS (SELECT least(floor((l_quantity - 1) / 49.0 * 20), 19)::BIGINT AS bin, count(*) AS n FROM lineitem WHERE l_quantity BETWEEN 1 AND 50 GROUP BY 1)
SELECT bin, n, round(n / sum(n) OVER () / (49.0 / 20), 6) AS density, round(n / sum(n) OVER (), 6) AS share FROM x""")(
    lambda t: summaries.histogram(t.lineitem, "l_quantity", 20, 1.0, 50.0).select("bin", "n", r6("density").alias("density"), r6("share").alias("share"))
)
query("a40_track_entropies", """x AS (SELECT l_partkey % 40 AS track, l_suppkey AS batch, -sum(l_discount * ln(l_discount + 1e-8)) AS h FROM lineitem GROUP BY ALL), y AS (SELECT track, avg(h) AS h FROM x GROUP BY track)
SELECT track, round(h, 6) AS h FROM y ORDER BY h DESC, track LIMIT 20""")(
    lambda t: rankings.ranked(t.lineitem.groupBy((F.col("l_partkey") % 40).alias("track"), "l_suppkey").agg((-F.sum(F.col("l_discount") * F.ln(F.col("l_discount") + 1e-8))).alias("h")).groupBy("track").agg(F.avg("h").alias("h")), [F.desc("h"), F.col("track")], 20).select("track", r6("h").alias("h"))
)
query("a41_largest_columns", """x AS (SELECT gene, count(*) AS n FROM sites GROUP BY gene ORDER BY n DESC, gene LIMIT 8), g AS (SELECT DISTINCT clinsig FROM sites), c AS (SELECT clinsig, gene, count(*) AS n FROM sites GROUP BY ALL)
SELECT g.clinsig, x.gene, coalesce(c.n, 0) AS n FROM g CROSS JOIN x LEFT JOIN c ON c.clinsig = g.clinsig AND c.gene = x.gene""")(lambda t: summaries.largest_columns(t.sites, "clinsig", "gene", 8))
query("a42_class_sources", """x AS (SELECT 'one' AS source, lower(clinsig) AS c FROM sites UNION ALL SELECT 'two', lower(clinsig) FROM sites WHERE size > 20 UNION ALL SELECT 'three', 'vus' FROM sites)
SELECT upper(c[1]) || c[2:] AS class, count(*) FILTER (source = 'one') AS one, count(*) FILTER (source = 'two') AS two FROM x WHERE c <> 'vus' GROUP BY 1""")(
    lambda t: summaries.class_sources({"one": t.sites.select("clinsig"), "two": t.sites.where("size > 20").select("clinsig"), "three": t.sites.select(F.lit("VUS").alias("clinsig"))}, "clinsig", ["one", "two"])
)

# Rankings
query("w03_sign", "SELECT l_orderkey, site, ploid, sign(value - 7)::DOUBLE AS scaled FROM scores")(lambda t: relational.scale_within(t.scores.withColumn("value", F.col("value") - 7), ["slot"], "value", "sign").select("l_orderkey", "site", "ploid", "scaled"))
query("w04_row_index", "SELECT row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey) - 1 AS row_idx, l_orderkey, l_linenumber FROM lineitem")(lambda t: relational.row_index(t.lineitem, ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]).select("row_idx", "l_orderkey", "l_linenumber"))
query("w06_best_column", "SELECT l_orderkey, l_linenumber, CASE WHEN l_discount >= l_tax AND l_discount >= l_quantity / 500 THEN 'discount' WHEN l_tax >= l_quantity / 500 THEN 'tax' ELSE 'quantity' END AS top, round(greatest(l_discount, l_tax, l_quantity / 500), 6) AS score FROM lineitem")(
    lambda t: rankings.best_column(t.lineitem.withColumns({"discount": F.col("l_discount"), "tax": F.col("l_tax"), "quantity": F.col("l_quantity") / 500}), ["discount", "tax", "quantity"]).select("l_orderkey", "l_linenumber", "top", r6("score").alias("score"))
)
query("w08_first_argmax", "x AS (SELECT l_partkey AS site, l_linenumber AS k, max(l_discount) AS v FROM lineitem GROUP BY ALL) SELECT site, arg_max(k, (v, -k)) AS kind, max(v) AS score FROM x GROUP BY site")(
    lambda t: rankings.first_argmax(t.lineitem.groupBy(F.col("l_partkey").alias("site"), F.col("l_linenumber").alias("k")).agg(F.max("l_discount").alias("v")), ["site"], "v", "k").select("site", F.col("k").alias("kind"), F.col("v").alias("score"))
)
query("w09_top_haplotypes", """x AS (SELECT sample AS hap, site AS pos, avg(value) AS v FROM scores GROUP BY ALL), d AS (SELECT hap, abs(v - avg(v) OVER (PARTITION BY pos)) AS d FROM x)
SELECT hap, round(avg(d), 6) AS deviation FROM d GROUP BY hap ORDER BY round(avg(d), 6) DESC, hap LIMIT 10""")(
    lambda t: rankings.top_haplotypes(t.scores.groupBy(F.col("sample").alias("hap"), F.col("site").alias("pos")).agg(F.avg("value").alias("v")), "hap", ["pos"], "v", 10, "mean").select("hap", r6("deviation").alias("deviation"))
)
query("w10_variable_tracks", """x AS (SELECT gene AS track, size AS pos, stddev_samp(price) AS sd, stddev_samp(price) / avg(price) AS cv, max(price) - min(price) AS range, sum(price) AS auc FROM sites GROUP BY ALL)
SELECT track, round(avg(sd), 5) AS sd, round(avg(cv), 6) AS cv, round(avg(range), 6) AS range, round(avg(auc), 5) AS auc FROM x GROUP BY track""")(
    lambda t: rankings.track_variability(t.sites, "gene", "size", "price").select(F.col("gene").alias("track"), F.round("sd", 5).alias("sd"), r6("cv").alias("cv"), r6("range").alias("range"), F.round("auc", 5).alias("auc"))
)
query("w11_downsample", "x AS (SELECT gene, row_number() OVER (PARTITION BY gene ORDER BY site) - 1 AS k, count(*) OVER (PARTITION BY gene) AS n, price FROM sites) SELECT gene, k // 4 AS window, round(avg(price), 6) AS v FROM x WHERE k < n // 4 * 4 GROUP BY ALL")(
    lambda t: rankings.downsample(t.sites, "gene", "site", "price", 4).select("gene", "window", r6("v").alias("v"))
)
query("w14_top_track_frequency", "x AS (SELECT sample, site % 30 AS track, max(value) AS m FROM scores GROUP BY ALL), y AS (SELECT sample, arg_max(track, (m, -track)) AS track FROM x GROUP BY sample) SELECT track, count(*) AS n FROM y GROUP BY track")(
    lambda t: rankings.top_track_frequency(t.scores.withColumn("track", F.col("site") % 30), "sample", "track", "value")
)
query("s01_reverse_sort", "SELECT c_custkey, row_number() OVER (ORDER BY reverse(c_name), c_custkey) AS place FROM customer QUALIFY place <= 50")(lambda t: rankings.ranked(t.customer, [F.reverse("c_name"), F.col("c_custkey")], 50).select("c_custkey", "place"))
query("s02_sorted_classes", "x AS (SELECT clinsig, count(*) AS n FROM sites GROUP BY clinsig) SELECT clinsig, n, row_number() OVER (ORDER BY CASE clinsig WHEN 'SMALL' THEN 1 WHEN 'LARGE' THEN 2 ELSE 3 END, clinsig) AS place FROM x")(
    lambda t: rankings.ranked(t.sites.groupBy("clinsig").agg(F.count("*").alias("n")), [summaries.by_custom_order(F.col("clinsig"), ["SMALL", "LARGE"]), F.col("clinsig")], 100).select("clinsig", "n", "place")
)
query("s03_sorted_chromosomes", "x AS (SELECT DISTINCT p_partkey % 26 AS c FROM part) SELECT CASE c WHEN 0 THEN 'GL1' WHEN 23 THEN 'X' WHEN 24 THEN 'Y' WHEN 25 THEN 'M' ELSE c::VARCHAR END AS chrom, row_number() OVER (ORDER BY CASE c WHEN 0 THEN 99 ELSE c END) AS place FROM x")(
    lambda t: rankings.ranked(t.part.select((F.col("p_partkey") % 26).alias("c")).distinct().select(F.when(F.col("c") == 0, "GL1").when(F.col("c") == 23, "X").when(F.col("c") == 24, "Y").when(F.col("c") == 25, "M").otherwise(F.col("c").cast("string")).alias("chrom")), relational.chromosome_order(F.col("chrom")), 100)
)
query("s04_priority", """x AS (SELECT site, count(*) AS n, round(stddev_samp(value), 6) AS sd, min(value) < 7 AND max(value) > 7 AS crosses FROM scores GROUP BY site)
SELECT site, n, sd, round(crosses::INT * 100 + sd, 6) AS priority FROM x WHERE sd IS NOT NULL ORDER BY priority DESC, site LIMIT 15""")(lambda t: rankings.by_priority(t.scores, "site", "value", 7.0, "crossing_first", 15))
query("s05_top_n", "SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber LIMIT 40")(lambda t: t.lineitem.orderBy(F.desc("l_extendedprice"), "l_orderkey", "l_linenumber").select("l_orderkey", "l_linenumber", "l_extendedprice").limit(40))
query("s06_limits", "x AS (SELECT site, sample, dense_rank() OVER (ORDER BY site) AS s, dense_rank() OVER (ORDER BY sample) AS p FROM scores) SELECT DISTINCT site, sample FROM x WHERE s <= 20 AND p <= 10")(
    lambda t: rankings.first_keys(t.scores, {"site": 20, "sample": 10}).select("site", "sample").distinct()
)
query("s08_centre_crop", "SELECT vec_id, list_transform(embedding[23:42], lambda v: round(v::DOUBLE, 6)) AS mid FROM embeddings")(
    lambda t: t.embeddings.select("vec_id", F.transform(rankings.centre_crop(F.col("embedding").cast("array<double>"), 200, 10), rounded).alias("mid"))
)

# Sets
query("u01_intersection", "SELECT c_nationkey AS n FROM customer INTERSECT SELECT s_nationkey FROM supplier WHERE s_acctbal < 500")(lambda t: t.customer.select(F.col("c_nationkey").alias("n")).intersect(t.supplier.where("s_acctbal < 500").select("s_nationkey")))
query("u03_union", "SELECT site, gene FROM sites WHERE size < 3 UNION ALL SELECT s_suppkey, s_name FROM supplier")(lambda t: t.sites.where("size < 3").select("site", "gene").unionByName(t.supplier.select(F.col("s_suppkey").alias("site"), F.col("s_name").alias("gene"))))
query("u04_concat_cohorts", "SELECT 'a' AS cohort, c_custkey AS id, c_mktsegment AS segment, NULL::DOUBLE AS balance FROM customer UNION ALL SELECT 'b', s_suppkey, NULL, s_acctbal FROM supplier")(
    lambda t: relational.by_cohort({"a": t.customer.select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("segment")), "b": t.supplier.select(F.col("s_suppkey").alias("id"), F.col("s_acctbal").alias("balance"))})
)
query("u07_distinct_on", "SELECT gene, clinsig, min(site) AS site FROM sites GROUP BY ALL")(lambda t: relational.best_rows(t.sites, ["gene", "clinsig"], [F.col("site")]).select("gene", "clinsig", "site"))
query("u08_merge_collections", "SELECT 'A' || ':' || l_suppkey AS node, count(*) AS n FROM lineitem WHERE l_returnflag = 'A' GROUP BY 1 UNION ALL SELECT 'R:' || l_suppkey, count(*) FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1")(
    lambda t: relational.merge_collections({k: t.lineitem.where(F.col("l_returnflag") == k).groupBy(F.col("l_suppkey").alias("node")).agg(F.count("*").alias("n")) for k in "AR"}, "node")
)
query("u09_common_modalities", "SELECT DISTINCT l_linenumber AS modality FROM lineitem WHERE l_returnflag = 'A' AND l_linenumber IN (SELECT l_linenumber FROM lineitem WHERE l_linestatus = 'O')")(
    lambda t: t.lineitem.where("l_returnflag = 'A'").select(F.col("l_linenumber").alias("modality")).distinct().join(t.lineitem.where("l_linestatus = 'O'").select(F.col("l_linenumber").alias("modality")).distinct(), "modality")
)
