"""Queries of effect metrics, statistical tests, models, matrices, haplotypes and scoring."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from varsparq.functions import metrics as M
from varsparq.operators import benchmark, haplotypes, matrix, relational, significance, summaries
from varsparq.plans.registry import Tables, query, r6

# Effect metrics over pairs of tracks: a vector and the next one, made positive
_PAIR = """x AS (SELECT a.vec_id AS a, list_transform(a.embedding, lambda v: v::DOUBLE) AS u, list_transform(b.embedding, lambda v: v::DOUBLE) AS w FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1),
e AS (SELECT a, list_transform(u, lambda v: exp(v)) AS r, list_transform(w, lambda v: exp(v)) AS s, u, w FROM x),
c AS (SELECT a, unnest(r) AS r, unnest(s) AS s, unnest(u) AS u, unnest(w) AS w, unnest(range(len(r))) AS k, len(r) AS n FROM e)
"""


def _pairs(t: Tables) -> DataFrame:
    e = t.embeddings.select(F.col("vec_id").alias("a"), F.col("embedding").cast("array<double>").alias("u"))
    both = e.join(e.select((F.col("a") - 1).alias("a"), F.col("u").alias("w")), "a")
    return both.withColumns({"r": F.transform("u", F.exp), "s": F.transform("w", F.exp)})


query("f17_fold_change", _PAIR + """SELECT a, round(ln(avg(s) + 0.001) - ln(avg(r) + 0.001), 6) AS rnaseq, round(log2((sum(s) + 1) / (sum(r) + 1)), 6) AS atac, round(max(abs(s - r)), 6) AS splice_sites,
round(avg(abs(s - r)), 6) AS contact_maps, round(max(abs(ln(s + 1) - ln(r + 1))), 6) AS splice_junctions FROM c GROUP BY a""")(
    lambda t: _pairs(t).select("a", *(r6(M.fold_change(F.col("r"), F.col("s"), m)).alias(m) for m in ("rnaseq", "atac", "splice_sites", "contact_maps", "splice_junctions")))
)
query("f17_centre_mask", _PAIR + "SELECT a, round(log2((sum(s) + 1) / (sum(r) + 1)), 6) AS f FROM c WHERE k >= n // 2 - 5 AND k < n // 2 + 6 GROUP BY a")(
    lambda t: _pairs(t).select("a", r6(M.log2_ratio(M._sum(M.around_centre(F.col("r"), 11)), M._sum(M.around_centre(F.col("s"), 11)), 1.0)).alias("f"))
)
query("f20_modality_metrics", _PAIR + """, m AS (SELECT a, k % 2 AS modality, ln(avg(s) + 0.001) - ln(avg(r) + 0.001) AS lfc, max(abs(log2((s + 1e-6) / (r + 1e-6)))) AS covr FROM c GROUP BY ALL)
SELECT a, modality, round(lfc, 6) AS lfc, round(covr, 6) AS covr FROM m""")(lambda t: _modalities(t).select("a", "modality", r6("lfc").alias("lfc"), r6("covr").alias("covr")))
query("f21_aggregated", _PAIR + """, m AS (SELECT a, k % 2 AS modality, ln(avg(s) + 0.001) - ln(avg(r) + 0.001) AS lfc, max(abs(log2((s + 1e-6) / (r + 1e-6)))) AS covr FROM c GROUP BY ALL)
SELECT a, round(avg(lfc), 6) AS lfc_mean, round(max(lfc), 6) AS lfc_max, round(sum(lfc), 6) AS lfc_sum FROM m GROUP BY a""")(
    lambda t: _modalities(t).groupBy("a").agg(r6(F.avg("lfc")).alias("lfc_mean"), r6(F.max("lfc")).alias("lfc_max"), r6(F.sum("lfc")).alias("lfc_sum"))
)


def _modalities(t: Tables) -> DataFrame:
    """lfc and covr of each pair and modality; even bins play one modality, odd ones another."""
    part = lambda c, k: F.filter(c, lambda _, i: i % 2 == k)
    told = F.explode(F.array(*(F.struct(F.lit(k).cast("long").alias("modality"), part(F.col("r"), k).alias("r"), part(F.col("s"), k).alias("s")) for k in (0, 1))))
    rows = _pairs(t).select("a", told.alias("m")).select("a", "m.*")
    return rows.select("a", "modality", M.fold_change(F.col("r"), F.col("s"), "rnaseq").alias("lfc"), M.covr(F.col("r"), F.col("s")).alias("covr"))


query("f22_element_effects", _PAIR + "SELECT a, k::INT AS k, round(s - r, 6) AS delta, round(log2((s + 1e-6) / (r + 1e-6)), 6) AS ratio FROM c")(
    lambda t: _pairs(t)
    .select("a", F.posexplode(F.arrays_zip(*(M.element_effects(F.col("r"), F.col("s"), how).alias(n) for how, n in (("delta", "delta"), ("log2_ratio", "ratio"))))).alias("k", "e"))
    .select("a", "k", r6("e.delta").alias("delta"), r6("e.ratio").alias("ratio"))
)
query("f23_effects_of_rows", _PAIR + "SELECT a, round(avg(abs(log2((s + 1e-6) / (r + 1e-6)))), 6) AS effect FROM c GROUP BY a")(lambda t: _pairs(t).select("a", r6(M._mean(M.element_effects(F.col("r"), F.col("s"), "log2_ratio", as_abs=True))).alias("effect")))
_PQ = _PAIR + ", q AS (SELECT a, avg(1 / (1 + exp(-u))) AS p, avg(1 / (1 + exp(-w))) AS q FROM c GROUP BY a) SELECT a, round("
query("f26_kl_pointwise", _PQ + "q * (ln(q) - p), 6) AS kl FROM q")(lambda t: _pairs(t).select("a", r6(M.kl_pointwise(F.col("u"), F.col("w"))).alias("kl")))
query("f27_js_pointwise", _PQ + "((p + q) / 2 * (ln((p + q) / 2) - p) + (p + q) / 2 * (ln((p + q) / 2) - q)) / 2, 6) AS js FROM q")(lambda t: _pairs(t).select("a", r6(M.js_pointwise(F.col("u"), F.col("w"))).alias("js")))
query("f28_probability_difference", _PQ + "q - p, 6) AS d FROM q")(lambda t: _pairs(t).select("a", r6(M.probability_difference(F.col("u"), F.col("w"))).alias("d")))
query("f30_log_ratio_mean", _PAIR + "SELECT a, round(avg(ln(s / r)), 6) AS v FROM c GROUP BY a")(lambda t: _pairs(t).select("a", r6(M.log_ratio_mean(F.col("r"), F.col("s"))).alias("v")))
query("f31_score_difference", "SELECT l_orderkey, site, ploid, round(alt - ref, 6) AS d FROM scores")(lambda t: t.scores.select("l_orderkey", "site", "ploid", r6(F.col("alt") - F.col("ref")).alias("d")))
_ENT = """, v AS (SELECT a, 1 AS scale, k AS k, u AS v FROM c UNION ALL SELECT a, q, k // q, avg(u) FROM c, (SELECT unnest([2, 3]) AS q) WHERE k < n // q * q GROUP BY a, q, k // q),
p AS (SELECT a, scale, exp(v) / sum(exp(v)) OVER (PARTITION BY a, scale) AS p FROM v), h AS (SELECT a, scale, -sum(p * ln(p + 1e-8)) AS h FROM p GROUP BY ALL)
"""
query("f33_multiscale_entropy", _PAIR + _ENT + "SELECT a, list(round(h, 6) ORDER BY scale) AS h FROM h GROUP BY a")(lambda t: _pairs(t).select("a", F.transform(M.multiscale_entropy(F.col("u")), lambda x: F.round(x, 6)).alias("h")))
query("f34_complexity_index", _PAIR + _ENT + "SELECT a, round(max(h) FILTER (scale = 2) + (max(h) FILTER (scale = 1) + max(h) FILTER (scale = 3)) / 2, 6) AS ci FROM h GROUP BY a")(
    lambda t: _pairs(t).withColumn("h", M.multiscale_entropy(F.col("u"))).select("a", r6(M.complexity_index(F.col("h"))).alias("ci"))
)
query("f35_mad", _PAIR + ", m AS (SELECT a, median(u) AS m FROM c GROUP BY a) SELECT a, round(median(abs(u - m)), 6) AS mad FROM c JOIN m USING (a) GROUP BY a")(lambda t: _pairs(t).select("a", r6(M.median_absolute_deviation(F.col("u"))).alias("mad")))
query("f36_deviation", _PAIR + "SELECT a, round(stddev_samp(u), 6) AS sd, round(stddev_pop(u), 6) AS sd_pop FROM c GROUP BY a")(lambda t: _pairs(t).select("a", r6(M.deviation(F.col("u"))).alias("sd"), r6(M.deviation(F.col("u"), False)).alias("sd_pop")))
query("f37_nonzero_mean", "SELECT l_partkey, round(avg(nullif(l_discount, 0)), 6) AS m FROM lineitem GROUP BY 1")(lambda t: t.lineitem.groupBy("l_partkey").agg(r6(M.nonzero_mean(F.col("l_discount"))).alias("m")))
query("f38_splice_gain_loss", "SELECT l_orderkey, l_linenumber, round((l_discount - l_tax) * (1 - l_linenumber % 2), 6) AS acceptor_gain, round(-(l_discount - l_tax) * (l_linenumber % 2), 6) AS acceptor_loss, round(l_tax - l_discount, 6) AS donor_gain, round(l_discount - l_tax, 6) AS donor_loss FROM lineitem")(
    lambda t: t.lineitem.select("l_orderkey", "l_linenumber", *(r6(c).alias(n) for n, c in M.splice_gain_loss({"acceptor": F.col("l_tax"), "donor": F.col("l_discount")}, {"acceptor": F.col("l_discount"), "donor": F.col("l_tax")}, {"acceptor": F.col("l_linenumber") % 2}).items()))
)
query("f39_probability_slices", "SELECT vec_id, round(embedding[2]::DOUBLE, 6) AS acceptor, round(embedding[3]::DOUBLE, 6) AS donor FROM embeddings")(lambda t: t.embeddings.select("vec_id", F.round(F.col("embedding")[1].cast("double"), 6).alias("acceptor"), F.round(F.col("embedding")[2].cast("double"), 6).alias("donor")))
query("f15_mutate")(lambda t: t.supplier.select("s_suppkey", F.translate(F.md5("s_name"), "0123456789abcdef", "ACGTACGTACGTACGT").alias("seq")).select("s_suppkey", "seq", haplotypes.mutated("seq", "ACGT", 7, ["s_suppkey"]).alias("mutated")))

# Statistical tests
query("t02_permutations")(lambda t: significance.permuted_wasserstein(t.sites, "gene", "price", F.col("size") > 25, 99, 7))
query("t01_anova_probabilities")(
    lambda t: significance.anova_p(t.scores.join(t.meta, "sample").withColumn("kk", F.col("site") % 40), "kk", "superpopulation", "value").select(F.col("kk").alias("k"), F.round("f", 4).alias("f"), r6("p").alias("p"))
)
query("t07_pairwise_stats", """p AS (SELECT a.c AS group1, b.c AS group2 FROM (SELECT DISTINCT clinsig AS c FROM sites) a, (SELECT DISTINCT clinsig AS c FROM sites) b WHERE a.c < b.c),
x AS (SELECT group1, group2, clinsig = group1 AS a, price AS v FROM p JOIN sites ON clinsig IN (group1, group2)),
r AS (SELECT *, rank() OVER w + (count(*) OVER (PARTITION BY group1, group2, v) - 1) / 2 AS r FROM x WINDOW w AS (PARTITION BY group1, group2 ORDER BY v)),
s AS (SELECT group1, group2, count(*) FILTER (a) AS n1, count(*) FILTER (NOT a) AS n2, sum(r) FILTER (a) AS rs, avg(v) FILTER (a) AS m1, avg(v) FILTER (NOT a) AS m2, var_samp(v) FILTER (a) AS v1, var_samp(v) FILTER (NOT a) AS v2 FROM r GROUP BY ALL)
SELECT 'Mann-Whitney-Wilcoxon test two-sided' AS test, group1, group2, n1, n2, 'U_stat' AS statistic_name, round(rs - n1 * (n1 + 1) / 2, 4) AS statistic, round(2 * (rs - n1 * (n1 + 1) / 2) / (n1 * n2) - 1, 6) AS effect_size, 'cliffs_delta' AS effect_size_kind FROM s
UNION ALL SELECT 'Welch''s t-test independent samples', group1, group2, n1, n2, 't', round((m1 - m2) / sqrt(v1 / n1 + v2 / n2), 4), round((m1 - m2) / sqrt(((n1 - 1) * v1 + (n2 - 1) * v2) / (n1 + n2 - 2)), 6), 'cohens_d' FROM s""")(
    lambda t: significance.pairwise_stats(t.sites, "clinsig", "price").select("test", "group1", "group2", "n1", "n2", "statistic_name", F.round("statistic", 4).alias("statistic"), r6("effect_size").alias("effect_size"), "effect_size_kind")
)
query("t07_pairwise_effects", """x AS (SELECT clinsig AS g, count(*) AS n, avg(ln(price)) AS m, var_samp(ln(price)) AS v FROM sites GROUP BY clinsig)
SELECT a.g AS g_1, b.g AS g_2, a.n AS n_1, b.n AS n_2, round(a.m - b.m, 6) AS mean_diff, round((a.m - b.m) / sqrt(((a.n - 1) * a.v + (b.n - 1) * b.v) / (a.n + b.n - 2)), 6) AS cohens_d FROM x a JOIN x b ON a.g < b.g""")(
    lambda t: significance.pairwise_effects(t.sites.select(F.col("clinsig").alias("g"), F.ln("price").alias("v")), "g", "v").select("g_1", "g_2", "n_1", "n_2", r6("mean_diff").alias("mean_diff"), r6("cohens_d").alias("cohens_d"))
)
query("t08_rank_test_adjusted")(lambda t: significance.adjusted(significance.mann_whitney_p(t.sites, "gene", "price", F.col("size") > 25), "p").select("gene", "n_a", "n_b", "u", r6("p").alias("p"), r6("bonferroni").alias("bonferroni"), r6("fdr").alias("fdr")))
query("t09_wilcoxon", """x AS (SELECT l_partkey % 50 AS k, round(l_discount - l_tax, 2) AS d FROM lineitem), y AS (SELECT k, d, rank() OVER (PARTITION BY k ORDER BY abs(d)) + (count(*) OVER (PARTITION BY k, abs(d)) - 1) / 2 AS r FROM x WHERE d <> 0)
SELECT k, count(*) AS n, least(coalesce(sum(r) FILTER (d > 0), 0), coalesce(sum(r) FILTER (d < 0), 0))::DOUBLE AS w FROM y GROUP BY k""")(
    lambda t: significance.wilcoxon(t.lineitem.select((F.col("l_partkey") % 50).alias("k"), F.round(F.col("l_discount") - F.col("l_tax"), 2).alias("a"), F.lit(0.0).alias("b")), "k", "a", "b").select("k", "n", "w")
)
query("t10_spearman", """x AS (SELECT gene, rank() OVER (PARTITION BY gene ORDER BY price) + (count(*) OVER (PARTITION BY gene, price) - 1) / 2 AS a, rank() OVER (PARTITION BY gene ORDER BY size) + (count(*) OVER (PARTITION BY gene, size) - 1) / 2 AS b FROM sites)
SELECT gene, count(*) AS n, round(corr(a, b), 6) AS rho FROM x GROUP BY gene""")(lambda t: significance.spearman(t.sites, "gene", "price", "size").withColumn("rho", r6("rho")))
query("t12_log_p", "SELECT l_orderkey, l_linenumber, round(-log10(nullif(l_tax, 0)), 6) AS neg_log10_p FROM lineitem")(lambda t: t.lineitem.select("l_orderkey", "l_linenumber", r6(-F.log10(F.nullif("l_tax", F.lit(0.0)))).alias("neg_log10_p")))
query("t13_reference_difference", """x AS (SELECT slot, corr(ref, alt - ref) FILTER (sample % 10 = 0) AS r, corr(ref, alt - ref) FILTER (sample % 10 > 0) AS q FROM scores GROUP BY slot)
SELECT slot, round(r, 6) AS r_ref, round(q, 6) AS r_nonref, round(q - r, 6) AS r_diff, round(q * q - r * r, 6) AS r2_diff, round(abs(q), 6) AS nonref_r_abs FROM x""")(
    lambda t: significance.reference_differences(t.scores.withColumn("d", F.col("alt") - F.col("ref")), "slot", F.col("sample") % 10 == 0, "ref", "d").select("slot", *(r6(c).alias(c) for c in ("r_ref", "r_nonref", "r_diff", "r2_diff", "nonref_r_abs")))
)
query("t15_aggregate_tracks", "SELECT site, round(avg(value), 6) AS mean, round(median(value), 6) AS med, round(max(value), 6) AS most FROM scores GROUP BY site")(lambda t: t.scores.groupBy("site").agg(r6(F.avg("value")).alias("mean"), r6(F.median("value")).alias("med"), r6(F.max("value")).alias("most")))
query("t16_equal_width_bins", """x AS (SELECT l_partkey % 60 AS d FROM lineitem), e AS (SELECT min(d) AS lo, max(d) AS hi FROM x WHERE d <> 0)
SELECT CASE WHEN d = 0 THEN 'bin0' ELSE 'bin' || least(greatest(ceil((d - lo) / ((hi - lo) / 10.0) - 1e-9), 1), 10)::INT END AS bin, count(*) AS n FROM x, e GROUP BY 1""")(
    lambda t: significance.equal_width_bins(t.lineitem.select((F.col("l_partkey") % 60).alias("d")), "d", 10).groupBy("bin").agg(F.count("*").alias("n"))
)

# Models
query("m05_logistic_benchmark")(lambda t: benchmark.logistic_benchmark(_labelled(t), ["grp"], ["x"], "y", ["l_orderkey", "l_linenumber", "l_partkey"]).select("grp", "l_orderkey", "l_linenumber", "y", r6("prob").alias("prob"), "predicted"))
query("m05_benchmark_report")(
    lambda t: benchmark.benchmark_report(benchmark.logistic_benchmark(_labelled(t).withColumn("x2", F.col("l_partkey") % 97 / 97), ["grp"], ["x", "x2"], "y", ["l_orderkey", "l_linenumber", "l_partkey"]), ["grp"], "y")
)


def _labelled(t: Tables) -> DataFrame:
    y = (F.col("l_quantity") + F.col("l_linenumber") * 7 > 45).cast("int")
    return t.lineitem.select(F.when(F.col("l_suppkey") % 10 == 0, "REF").otherwise("non-REF").alias("grp"), "l_orderkey", "l_linenumber", "l_partkey", (F.col("l_quantity") / 50).alias("x"), y.alias("y"))


query("m06_benchmark_rows", """x AS (SELECT site, sample % 10 = 0 AS is_ref, value FROM scores), b AS (SELECT site FROM x GROUP BY site HAVING bool_or(is_ref) AND bool_or(NOT is_ref)), l AS (SELECT site, CASE clinsig WHEN 'SMALL' THEN 0 WHEN 'MEDIUM' THEN 0 WHEN 'LARGE' THEN 1 WHEN 'STANDARD' THEN 1 END AS y FROM sites)
SELECT site, y, CASE WHEN is_ref THEN 'REF' ELSE 'non-REF' END AS grp, round(avg(value), 6) AS v FROM x JOIN b USING (site) JOIN l USING (site) WHERE y IS NOT NULL GROUP BY ALL""")(
    lambda t: summaries.benchmark_rows(t.scores.withColumn("is_ref", F.col("sample") % 10 == 0), t.sites, "site", "is_ref", "value", "clinsig", {"SMALL": 0, "MEDIUM": 0, "LARGE": 1, "STANDARD": 1}).withColumn("v", r6("v"))
)
_CURVE = """x AS (SELECT l_returnflag AS g, l_discount AS s, sum((l_quantity > 25)::INT) AS tp, count(*) AS n FROM lineitem GROUP BY ALL),
c AS (SELECT g, s, sum(tp) OVER w / sum(n) OVER w AS precision, sum(tp) OVER w / sum(tp) OVER (PARTITION BY g) AS recall FROM x WINDOW w AS (PARTITION BY g ORDER BY s DESC))
"""
query("m08_precision_recall", _CURVE + "SELECT g, s, round(precision, 6) AS precision, round(recall, 6) AS recall FROM c")(lambda t: _curve(t).select("g", "s", r6("precision").alias("precision"), r6("recall").alias("recall")))
query("m08_average_precision", _CURVE + ", d AS (SELECT *, recall - coalesce(lag(recall) OVER w, 0) AS step, coalesce(lag(precision) OVER w, 1) AS before FROM c WINDOW w AS (PARTITION BY g ORDER BY s DESC)) SELECT g, round(sum(step * precision), 6) AS average_precision, round(sum(step * (precision + before) / 2), 6) AS auprc FROM d GROUP BY g")(
    lambda t: significance.average_precision(_curve(t), ["g"]).select("g", r6("average_precision").alias("average_precision"), r6("auprc").alias("auprc"))
)


def _curve(t: Tables) -> DataFrame:
    return significance.precision_recall(t.lineitem.select(F.col("l_returnflag").alias("g"), F.col("l_discount").alias("s"), (F.col("l_quantity") > 25).cast("int").alias("y")), ["g"], "s", "y")


query("m13_standardised", "x AS (SELECT sample AS i, slot AS j, avg(value) AS v FROM scores GROUP BY ALL) SELECT i, j, round(coalesce((v - avg(v) OVER w) / nullif(stddev_pop(v) OVER w, 0), 0), 5) AS v FROM x WINDOW w AS (PARTITION BY j)")(
    lambda t: matrix.standardised(t.scores.groupBy(F.col("sample").alias("i"), F.col("slot").alias("j")).agg(F.avg("value").alias("v"))).withColumn("v", F.round("v", 5))
)
query("m14_density_grid")(lambda t: matrix.density_grid(t.lineitem.select((F.col("l_quantity") / 51).alias("x"), (F.col("l_discount") * 9).alias("y")), "x", "y", 30, 0.03).withColumn("density", r6("density")))
query("m16_population_distance", """x AS (SELECT l_partkey AS site, superpopulation AS pop, avg((l_returnflag = 'A')::INT) AS p FROM lineitem JOIN meta ON sample = l_suppkey GROUP BY ALL)
SELECT a.pop AS pop1, b.pop AS pop2, count(*) AS n_sites, round(avg(a.p * (1 - b.p) + b.p * (1 - a.p)), 6) AS divergence, round(1 - avg(a.p * (1 - a.p) + b.p * (1 - b.p)) / avg(a.p * (1 - b.p) + b.p * (1 - a.p)), 6) AS fst FROM x a JOIN x b ON a.site = b.site AND a.pop < b.pop GROUP BY ALL""")(
    lambda t: matrix.fst(_genotypes(t), "site", "population", "g").select("pop1", "pop2", "n_sites", r6("divergence").alias("divergence"), r6("fst").alias("fst"))
)


def _genotypes(t: Tables) -> DataFrame:
    return t.lineitem.join(t.meta, F.col("l_suppkey") == F.col("sample")).select(F.col("l_partkey").alias("site"), F.col("superpopulation").alias("population"), (F.col("l_returnflag") == "A").cast("int").alias("g"))


query("m17_locus_importance", "x AS (SELECT l_partkey % 20 AS i, l_suppkey % 20 AS j, avg(l_discount) AS w FROM lineitem GROUP BY ALL) SELECT i AS locus, round(sum(w), 6) AS importance FROM x GROUP BY i")(
    lambda t: t.lineitem.groupBy((F.col("l_partkey") % 20).alias("locus"), (F.col("l_suppkey") % 20).alias("j")).agg(F.avg("l_discount").alias("w")).groupBy("locus").agg(r6(F.sum("w")).alias("importance"))
)
query("m18_distance_to_mean", """x AS (SELECT vec_id, vec_id % 10 AS bin, vec_id % 3 = 0 AS is_case, unnest(embedding)::DOUBLE AS v, unnest(range(len(embedding))) AS k FROM embeddings), m AS (SELECT bin, k, avg(v) AS m FROM x GROUP BY ALL),
d AS (SELECT vec_id, bin, is_case, 1 - sum(v * m) / (sqrt(sum(v * v)) * sqrt(sum(m * m))) AS d FROM x JOIN m USING (bin, k) GROUP BY ALL) SELECT bin, is_case, round(avg(d), 6) AS mean, round(stddev_samp(d), 6) AS sd FROM d GROUP BY ALL""")(
    lambda t: summaries.distance_to_mean(t.embeddings.select("vec_id", (F.col("vec_id") % 10).alias("bin"), (F.col("vec_id") % 3 == 0).alias("is_case"), F.col("embedding").cast("array<double>").alias("vector")), "vec_id", "bin", "is_case", "vector").select("bin", "is_case", r6("mean").alias("mean"), r6("sd").alias("sd"))
)

# Matrices
_M = "x AS (SELECT l_partkey % 90 AS i, l_suppkey % 40 AS j, avg(l_discount) AS v FROM lineitem GROUP BY ALL) "


def _m(t: Tables) -> DataFrame:
    return t.lineitem.groupBy((F.col("l_partkey") % 90).alias("i"), (F.col("l_suppkey") % 40).alias("j")).agg(F.avg("l_discount").alias("v"))


def _several(t: Tables) -> DataFrame:
    """Mean discounts in hundredths, down to steps of 2^-20: sums of such values don't depend on their order."""
    keys = F.col("l_returnflag").alias("which"), (F.col("l_partkey") % 90).alias("i"), (F.col("l_suppkey") % 40).alias("j")
    cells = t.lineitem.groupBy(*keys).agg((F.floor(F.sum(F.round(F.col("l_discount") * 100).cast("long")) * 2**20 / F.count("*")) / 2**20).alias("v"))
    return cells.withColumn("weight", F.when(F.col("which") == "A", 2.0).otherwise(1.0))


_SEV = "x AS (SELECT l_returnflag AS which, l_partkey % 90 AS i, l_suppkey % 40 AS j, floor(sum(round(l_discount * 100)::BIGINT)::BIGINT * 1048576 / count(*)) / 1048576 AS v, CASE WHEN l_returnflag = 'A' THEN 2.0::DOUBLE ELSE 1.0 END AS weight FROM lineitem GROUP BY ALL) "
query("x02_common_shape", "x AS (SELECT l_returnflag AS which, max(l_partkey) + 1 AS r, max(l_suppkey + l_linenumber) + 1 AS c FROM lineitem GROUP BY 1) SELECT which, r AS rows, c AS columns, max(r) OVER () - r AS pad_rows, max(c) OVER () - c AS pad_columns FROM x")(
    lambda t: matrix.padded(t.lineitem.select(F.col("l_returnflag").alias("which"), F.col("l_partkey").alias("i"), (F.col("l_suppkey") + F.col("l_linenumber")).alias("j")))
)
query("x03_weighted_mean", _SEV + "SELECT i, j, sum(v * weight) / sum(weight) AS v FROM x GROUP BY ALL HAVING count(v) = 3")(
    lambda t: matrix.average(_several(t), 3)
)
query("x03_weighted_max", _SEV + "SELECT i, j, round(max(v * weight), 6) AS v FROM x GROUP BY ALL HAVING count(v) = 3")(lambda t: matrix.weighted_max(_several(t), 3).withColumn("v", r6("v")))
query("x04_bin_columns", _M + "SELECT i, j // 7 AS j, round(avg(v), 6) AS v FROM x GROUP BY ALL")(lambda t: matrix.bin_axis(_m(t), "j", 7).withColumn("v", r6("v")))
query("x06_expand", "x AS (SELECT l_partkey % 30 AS i, l_suppkey % 30 AS j, max(l_discount) AS v FROM lineitem GROUP BY ALL) SELECT i * 3 + a AS i, j * 3 + b AS j, v FROM x, (SELECT unnest([0, 1, 2]) AS a), (SELECT unnest([0, 1, 2]) AS b) WHERE i * 3 + a < 80 AND j * 3 + b < 80")(
    lambda t: matrix.expand(t.lineitem.groupBy((F.col("l_partkey") % 30).alias("i"), (F.col("l_suppkey") % 30).alias("j")).agg(F.max("l_discount").alias("v")), 3, 80)
)
query("x08_missing_share", _M + "SELECT round(100 - count(v) * 100.0 / (90 * 40), 6) AS percent_missing FROM x")(lambda t: matrix.missing_share(_m(t), 90, 40).select(r6("percent_missing").alias("percent_missing")))
query("x09_fill_coordinates", "x AS (SELECT l_partkey % 90 AS i, l_suppkey % 40 AS j, avg(l_discount) AS v FROM lineitem WHERE l_linenumber = 1 GROUP BY ALL), d AS (SELECT range AS i, range AS j FROM range(100)) SELECT i::BIGINT AS i, j::BIGINT AS j, round(v, 6) AS v FROM x FULL JOIN d USING (i, j)")(
    lambda t: matrix.fill_coordinates(t.lineitem.where("l_linenumber = 1").groupBy((F.col("l_partkey") % 90).alias("i"), (F.col("l_suppkey") % 40).alias("j")).agg(F.avg("l_discount").alias("v")), 100).withColumn("v", r6("v"))
)
query("x12_varied_columns", "x AS (SELECT l_partkey AS i, l_linenumber AS j, (l_linenumber > 2 AND l_tax > 0)::INT AS v FROM lineitem) SELECT j, count(*) AS n FROM x WHERE j IN (SELECT j FROM x GROUP BY j HAVING count(DISTINCT v) > 1) GROUP BY j")(
    lambda t: matrix.varied(t.lineitem.select(F.col("l_partkey").alias("i"), F.col("l_linenumber").alias("j"), ((F.col("l_linenumber") > 2) & (F.col("l_tax") > 0)).cast("int").alias("v"))).groupBy("j").agg(F.count("*").alias("n"))
)
query("x13_bin_axis", _M + "SELECT i // 7 AS i, j, round(max(v), 6) AS v FROM x WHERE i // 7 < 90 // 7 GROUP BY ALL")(lambda t: matrix.bin_axis(_m(t), "i", 7, "max", drop_rest=True).withColumn("v", r6("v")))
query("x14_melted", _SEV + "SELECT which, 'd' || abs(i - j) AS distance, round(avg(v), 6) AS v FROM x GROUP BY ALL")(lambda t: _several(t).groupBy("which", F.concat(F.lit("d"), F.abs(F.col("i") - F.col("j"))).alias("distance")).agg(r6(F.avg("v")).alias("v")))
query("x15_without_empty", "x AS (SELECT l_partkey AS i, l_suppkey AS j, max(CASE WHEN l_linenumber = 7 THEN l_tax ELSE 0 END) AS v FROM lineitem GROUP BY ALL) SELECT i, j, round(log10(v + 1e-6), 6) AS v FROM x WHERE i IN (SELECT i FROM x GROUP BY i HAVING max(abs(v)) > 0) AND j IN (SELECT j FROM x GROUP BY j HAVING max(abs(v)) > 0)")(
    lambda t: matrix.without_empty(t.lineitem.groupBy(F.col("l_partkey").alias("i"), F.col("l_suppkey").alias("j")).agg(F.max(F.when(F.col("l_linenumber") == 7, F.col("l_tax")).otherwise(0.0)).alias("v")), 1e-6).withColumn("v", r6("v"))
)
query("x16_blend", """x AS (SELECT l_partkey % 20 AS i, l_suppkey % 20 AS j, avg(l_tax) FILTER (l_linestatus = 'O') AS a, avg(l_tax) FILTER (l_linestatus = 'F') AS b FROM lineitem GROUP BY ALL)
SELECT frame::INT AS frame, i, j, round((1 - frame / 4) * coalesce(a, 0) + frame / 4 * coalesce(b, 0), 6) AS v FROM x, range(5) r(frame) WHERE a IS NOT NULL OR b IS NOT NULL""")(
    lambda t: matrix.blend(*(t.lineitem.where(F.col("l_linestatus") == s).groupBy((F.col("l_partkey") % 20).alias("i"), (F.col("l_suppkey") % 20).alias("j")).agg(F.avg("l_tax").alias("v")) for s in "OF"), 4).withColumn("v", r6("v"))
)

# Haplotypes
query("h01_stack_ploidy", "SELECT s_suppkey AS sample, unnest([0, 1])::INT AS ploid, unnest([s_name, upper(s_name)]) AS hap, s_suppkey * 2 + unnest([0, 1]) AS row FROM supplier")(lambda t: haplotypes.stacked(t.supplier.select(F.col("s_suppkey").alias("sample"), F.array("s_name", F.upper("s_name")).alias("haps")), "haps"))
query("h02_select_haplotype", "SELECT s_suppkey AS sample, upper(s_name) AS hap FROM supplier")(
    lambda t: haplotypes.stacked(t.supplier.select(F.col("s_suppkey").alias("sample"), F.array("s_name", F.upper("s_name")).alias("haps")), "haps").where("ploid = 1").select("sample", "hap")
)
query("h05_varied_positions", "SELECT l_partkey AS pos, count(DISTINCT l_returnflag) AS n_bases FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_returnflag) > 1")(
    lambda t: haplotypes.consensus(t.lineitem.select(F.col("l_partkey").alias("pos"), F.col("l_returnflag").alias("base"))).where("n_bases > 1").select("pos", "n_bases")
)
query("h06_complexity", """x AS (SELECT l_partkey AS pos, l_returnflag AS base, count(*) AS n FROM lineitem GROUP BY ALL), y AS (SELECT pos, max(n) / sum(n) AS s, count(*) AS b FROM x GROUP BY pos) SELECT round(1 - avg(s), 6) AS max_af, round(avg(b - 1), 6) AS mean_var FROM y""")(
    lambda t: haplotypes.complexity(t.lineitem.select(F.col("l_partkey").alias("pos"), F.col("l_returnflag").alias("base"))).select(r6("max_af").alias("max_af"), r6("mean_var").alias("mean_var"))
)
query("h07_frequency_complexity", "SELECT l_suppkey, round(sum(l_discount) / (max(l_partkey + 1) - min(l_partkey)), 6) AS complexity FROM lineitem GROUP BY 1")(
    lambda t: haplotypes.frequency_complexity(t.lineitem.withColumn("e", F.col("l_partkey") + 1), ["l_suppkey"], "l_discount", "l_partkey", "e").withColumn("complexity", r6("complexity"))
)
query("h08_haplotype_matrix", "x AS (SELECT o_custkey AS h, list_sort(list(DISTINCT l_partkey % 50)) AS v FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY h), y AS (SELECT v, min(h) AS hap FROM x GROUP BY v) SELECT hap, unnest(v) AS variant, 1 AS present FROM y")(
    lambda t: haplotypes.haplotype_matrix(t.orders.join(t.lineitem, F.col("o_orderkey") == F.col("l_orderkey")).select(F.col("o_custkey").alias("haplotype"), (F.col("l_partkey") % 50).alias("variant")))
)
query("h10_haplotype_ids", "SELECT DISTINCT sample || '_' || ploid AS hap_id FROM scores")(lambda t: t.scores.select(F.concat_ws("_", "sample", "ploid").alias("hap_id")).distinct())
query("h13_flat_index", """n AS (SELECT max(sample) + 1 AS n FROM scores)
SELECT DISTINCT site, sample, ploid, (site * n + sample) * 2 + ploid AS flat, site AS r, sample AS s, ploid AS p FROM scores, n""")(
    lambda t: haplotypes.flat_index(t.scores.select("site", "sample", "ploid").distinct(), "site", "sample", "ploid", t.scores.agg(F.max("sample") + 1).first()[0], 2).withColumn("p", F.col("p").cast("int"))
)
query("h16_align_tracks", """x AS (SELECT vec_id AS hap, unnest(embedding)::DOUBLE AS v, unnest(range(len(embedding))) * 2 + vec_id % 3 AS c FROM embeddings), g AS (SELECT DISTINCT hap, p FROM x, range(41) r(p))
SELECT g.hap, p::INT AS place, round(coalesce(v, -1), 6) AS v FROM g LEFT JOIN x ON x.hap = g.hap AND c = p + 30 - 20""")(
    lambda t: haplotypes.align_tracks(t.embeddings.select(F.col("vec_id").alias("hap"), F.transform(F.sequence(F.lit(0), F.size("embedding") - 1), lambda k: (k * 2 + F.col("vec_id") % 3).cast("int")).alias("coords"), F.col("embedding").cast("array<double>").alias("values")), 30, 41, -1.0).withColumn("v", r6("v"))
)
_GENES = "x AS (SELECT p_partkey AS name, CASE WHEN p_size % 2 = 0 THEN '+' ELSE '-' END AS strand, [p_size, p_size + 100, p_size + 200] AS s, [p_size + 50, p_size + 150, p_size + 250] AS e FROM part) "


def _genes(t: Tables) -> DataFrame:
    text = lambda *add: F.concat(*(x for a in add for x in ((F.col("p_size") + a).cast("string"), F.lit(","))))
    return t.part.select(F.col("p_partkey").alias("name"), F.when(F.col("p_size") % 2 == 0, "+").otherwise("-").alias("strand"), text(0, 100, 200).alias("exon_starts"), text(50, 150, 250).alias("exon_ends"))


query("h18_splice_sites", _GENES + "SELECT name, strand, kind, unnest(CASE WHEN (kind = 'p5') = (strand = '+') THEN e[1:2] ELSE s[2:3] END)::BIGINT AS pos FROM x, (SELECT unnest(['p5', 'p3']) AS kind)")(lambda t: haplotypes.splice_sites(_genes(t)))
query("h19_padded_genes", "SELECT p_partkey AS name, greatest(p_partkey * 10 - 10000, 0) AS start, p_partkey * 10 + 500 + 10000 AS \"end\" FROM part")(
    lambda t: haplotypes.padded_genes(t.part.select(F.col("p_partkey").alias("name"), (F.col("p_partkey") * 10).alias("start"), (F.col("p_partkey") * 10 + 500).alias("end")))
)
query("h20_spliced_sequence", "SELECT s_suppkey, substr(md5(s_name), 3, 4) || substr(md5(s_name), 11, 5) AS seq FROM supplier")(
    lambda t: t.supplier.select("s_suppkey", F.md5("s_name").alias("full"), F.array(F.lit(2), F.lit(10)).alias("a"), F.array(F.lit(4), F.lit(5)).alias("n")).select("s_suppkey", haplotypes.spliced("full", "a", "n").alias("seq"))
)
query("h21_transcript_offsets", "SELECT gene, site, size, site - min(site) OVER (PARTITION BY gene) AS at FROM sites")(lambda t: t.sites.join(t.sites.groupBy("gene").agg(F.min("site").alias("tx_start")), "gene").select("gene", "site", "size", (F.col("site") - F.col("tx_start")).alias("at")))
query("h22_superpopulation_nodes", "SELECT superpopulation, list(sample ORDER BY sample) AS nodes FROM meta GROUP BY 1")(lambda t: t.meta.groupBy("superpopulation").agg(F.array_sort(F.collect_list("sample")).alias("nodes")))
query("h23_population_matrix", "SELECT superpopulation AS population, l_partkey AS site, round(avg((l_returnflag = 'A')::INT), 6) AS mean_genotype FROM lineitem JOIN meta ON sample = l_suppkey GROUP BY ALL")(lambda t: haplotypes.population_matrix(_genotypes(t), "site", "population", "g").withColumn("mean_genotype", r6("mean_genotype")))

# Scoring
query("k07_site_concat", "SELECT l_partkey AS site, list(l_extendedprice ORDER BY l_orderkey, l_linenumber, l_suppkey, l_extendedprice) AS track FROM lineitem GROUP BY 1")(
    lambda t: summaries.concatenated(t.lineitem, "l_partkey", ["l_orderkey", "l_linenumber", "l_suppkey"], "l_extendedprice").select(F.col("l_partkey").alias("site"), "track")
)
query("k08_ensemble_mean", "SELECT site, sample, round(avg(value), 6) AS v, count(DISTINCT slot) AS models FROM scores WHERE slot IN ('A', 'R') GROUP BY ALL")(
    lambda t: t.scores.where("slot in ('A', 'R')").groupBy("site", "sample").agg(r6(F.avg("value")).alias("v"), F.count_distinct("slot").alias("models"))
)
query("k12_median_of_counts", "x AS (SELECT sample, site, count(*) AS n FROM scores GROUP BY ALL) SELECT sample, median(n) AS med FROM x GROUP BY sample")(lambda t: t.scores.groupBy("sample", "site").agg(F.count("*").alias("n")).groupBy("sample").agg(F.median("n").alias("med")))

# Preparation of figures
query("plot_population_bins", """x AS (SELECT superpopulation AS g, value FROM scores JOIN meta USING (sample)), e AS (SELECT min(value) AS lo, (max(value) - min(value)) / 200 AS w FROM x)
SELECT g, least(floor((value - lo) / w), 199)::BIGINT AS bin, count(*) AS n FROM x, e GROUP BY ALL""")(lambda t: summaries.range_bins(t.scores.join(t.meta, "sample"), "superpopulation", "value", 200).select(F.col("superpopulation").alias("g"), "bin", "n"))
query("plot_top_labels", "x AS (SELECT DISTINCT ON (price) price, p_name FROM (SELECT p_retailprice AS price, p_name, p_partkey FROM part) ORDER BY price, p_partkey) SELECT price, left(p_name, 8) AS label FROM x ORDER BY price DESC LIMIT 12")(
    lambda t: relational.best_rows(t.part, ["p_retailprice"], [F.col("p_partkey")]).orderBy(F.desc("p_retailprice")).limit(12).select(F.col("p_retailprice").alias("price"), F.left("p_name", F.lit(8)).alias("label"))
)
