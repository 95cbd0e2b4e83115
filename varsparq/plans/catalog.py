"""The registered queries of the library over the driver's tables, and the same in SQL.

Roles of the tables: lineitem holds scores (site = part, sample = supplier, slot = return flag, value = log unit price),
supplier, nation and region sample metadata, part site annotation, orders and customers haplotypes, embeddings tracks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from varsparq.functions import metrics as M
from varsparq.functions import text as T
from varsparq.operators import attribution, haplotypes, intervals, matrix, ordering, relational, summaries
from varsparq.plans.registry import Tables, oracles, queries, query, r6

__all__ = ["oracles", "queries"]

CLASSES = {"STANDARD": "path", "LARGE": "likely_path", "SMALL": "benign", "MEDIUM": "likely_benign"}
_CASE = "CASE clinsig " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in CLASSES.items()) + " ELSE 'other' END"


@query("pipeline_population_variance", f"""x AS (SELECT site, population, avg(value) AS m FROM scores JOIN meta USING (sample) GROUP BY ALL),
b AS (SELECT site, var_samp(m) AS v FROM x GROUP BY site)
SELECT site, gene, {_CASE} AS class, round(v, 6) AS between_var FROM b JOIN sites USING (site) WHERE v IS NOT NULL ORDER BY round(v, 6) DESC, site LIMIT 20""")
def population_variance(t: Tables) -> DataFrame:
    """Top 20 sites by variance between populations (J-03, A-02, P-07, W-02)."""
    v = relational.between_group_variance(t.scores, t.meta, "site", "sample", "population", "value").where("between_var is not null")
    out = v.join(t.sites, "site").select("site", "gene", T.recode(F.col("clinsig"), CLASSES).alias("class"), r6("between_var").alias("between_var"))
    return out.orderBy(F.desc("between_var"), "site").limit(20)


query("a01_site_variance", "SELECT site, round(var_samp(value), 6) AS v FROM scores GROUP BY site")(lambda t: t.scores.groupBy("site").agg(r6(F.var_samp("value")).alias("v")))
query("a02_between_variance", "x AS (SELECT site, population, avg(value) AS m FROM scores JOIN meta USING (sample) GROUP BY ALL) SELECT site, round(var_samp(m), 6) AS v FROM x GROUP BY site")(
    lambda t: relational.between_group_variance(t.scores, t.meta, "site", "sample", "population", "value").select("site", r6("between_var").alias("v"))
)
query("a03_within_variance_merged", "SELECT site, sample, l_orderkey, ploid, round(value, 6) AS value, round(var_samp(value) OVER (PARTITION BY site, population), 6) AS within_var FROM scores JOIN meta USING (sample)")(
    lambda t: t.scores.join(t.meta, "sample").select("site", "sample", "l_orderkey", "ploid", r6("value").alias("value"), r6(F.var_samp("value").over(Window.partitionBy("site", "population"))).alias("within_var"))
)
query("a05_sites_per_gene", "SELECT clinsig, gene, count(DISTINCT site) AS n FROM sites GROUP BY ALL")(lambda t: t.sites.groupBy("clinsig", "gene").agg(F.count_distinct("site").alias("n")))
query("a10_describe", "SELECT site, count(*) AS n, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS sd, round(max(value) - min(value), 6) AS span FROM scores GROUP BY site HAVING count(*) >= 3")(
    lambda t: t.scores.groupBy("site").agg(F.count("*").alias("n"), r6(F.avg("value")).alias("mean"), r6(F.stddev_samp("value")).alias("sd"), r6(F.max("value") - F.min("value")).alias("span")).where("n >= 3")
)
query("a11_threshold_crossing", "SELECT user_id, count(*) AS n, count(*) FILTER (value >= 50) AS n_above, count(*) FILTER (value < 50) AS n_below, min(value) < 50 AND max(value) > 50 AS crosses FROM events GROUP BY user_id")(
    lambda t: relational.crossing(t.events, "user_id", "value", 50.0)
)
query("a13_score_matrix", "SELECT sample, site, round(avg(value), 6) AS v FROM scores GROUP BY ALL")(lambda t: t.scores.groupBy("sample", "site").agg(r6(F.avg("value")).alias("v")))
query("a13_score_pivot", "SELECT sample, round(avg(value) FILTER (slot = 'A'), 6) AS A, round(avg(value) FILTER (slot = 'N'), 6) AS N, round(avg(value) FILTER (slot = 'R'), 6) AS R FROM scores GROUP BY sample")(
    lambda t: t.scores.groupBy("sample").pivot("slot", ["A", "N", "R"]).agg(F.round(F.avg("value"), 6))
)
query("a15_class_ratio", "SELECT gene, count(*) FILTER (clinsig = 'STANDARD') AS path, count(*) FILTER (clinsig = 'SMALL') AS benign, round(count(*) FILTER (clinsig = 'STANDARD') / nullif(count(*) FILTER (clinsig = 'SMALL'), 0), 6) AS ratio FROM sites GROUP BY gene")(
    lambda t: t.sites.groupBy("gene").agg(F.count_if(F.col("clinsig") == "STANDARD").alias("path"), F.count_if(F.col("clinsig") == "SMALL").alias("benign")).withColumn("ratio", r6(F.try_divide("path", "benign")))
)
query("a16_value_counts", "x AS (SELECT clinsig, count(*) AS n FROM sites GROUP BY clinsig) SELECT clinsig, n, round(n / sum(n) OVER (), 6) AS share FROM x")(
    lambda t: t.sites.groupBy("clinsig").agg(F.count("*").alias("n")).withColumn("share", r6(F.col("n") / F.sum("n").over(Window.partitionBy())))
)
query("a17_crosstab_margins", "SELECT coalesce(gene, 'All') AS gene, coalesce(clinsig, 'All') AS clinsig, count(*) AS n FROM sites GROUP BY CUBE (gene, clinsig)")(
    lambda t: t.sites.cube("gene", "clinsig").agg(F.count("*").alias("n")).select(F.coalesce("gene", F.lit("All")).alias("gene"), F.coalesce("clinsig", F.lit("All")).alias("clinsig"), "n")
)
query("a18_rollup_sums", "SELECT gene, clinsig, sum((size > 25)::INT)::BIGINT AS n FROM sites GROUP BY ROLLUP (gene, clinsig)")(lambda t: t.sites.rollup("gene", "clinsig").agg(F.sum((F.col("size") > 25).cast("int")).alias("n")))
query("a19_missing_counts", "SELECT count(*) FILTER (nullif(l_linenumber, 1) IS NULL) AS line_missing, count(*) FILTER (nullif(l_returnflag, 'N') IS NULL) AS flag_missing FROM lineitem")(
    lambda t: t.lineitem.agg(F.count_if(F.nullif("l_linenumber", F.lit(1)).isNull()).alias("line_missing"), F.count_if(F.nullif("l_returnflag", F.lit("N")).isNull()).alias("flag_missing"))
)
query("a20_top_and_other", "x AS (SELECT gene, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, gene) AS r FROM sites GROUP BY gene) SELECT CASE WHEN r <= 5 THEN gene ELSE 'Other' END AS category, sum(n)::BIGINT AS n FROM x GROUP BY 1")(
    lambda t: relational.top_and_other(t.sites, "gene", 5)
)
query("a22_region_means", "x AS (SELECT unnest(['big', 'dear']) AS region, unnest([size > 25, price > 1200]) AS inside, ln(price) AS v FROM sites) SELECT region, inside, round(avg(v), 6) AS mean, count(*) AS n, round(stddev_samp(v) / sqrt(count(*)), 6) AS sem FROM x GROUP BY ALL")(
    lambda t: t.sites.select(F.ln("price").alias("v"), F.explode(F.array(F.struct(F.lit("big").alias("region"), (F.col("size") > 25).alias("inside")), F.struct(F.lit("dear").alias("region"), (F.col("price") > 1200).alias("inside")))).alias("f"))
    .groupBy("f.region", "f.inside").agg(r6(F.avg("v")).alias("mean"), F.count("*").alias("n"), r6(F.stddev_samp("v") / F.sqrt(F.count("*"))).alias("sem"))
)
query("a25_filtered_matrix", "SELECT gene, round(coalesce(avg(ln(price)) FILTER (clinsig = 'LARGE'), 0), 6) AS LARGE, round(coalesce(avg(ln(price)) FILTER (clinsig = 'SMALL'), 0), 6) AS SMALL FROM sites WHERE size <= 40 GROUP BY gene")(
    lambda t: t.sites.where("size <= 40").groupBy("gene").pivot("clinsig", ["LARGE", "SMALL"]).agg(F.round(F.avg(F.ln("price")), 6)).na.fill(0.0)
)
query("a28_cluster_shares", "x AS (SELECT slot, superpopulation, count(*) AS n FROM scores JOIN meta USING (sample) WHERE slot <> 'A' GROUP BY ALL) SELECT slot, superpopulation, n, round(n / sum(n) OVER (PARTITION BY slot), 6) AS share FROM x")(
    lambda t: t.scores.where("slot <> 'A'").join(t.meta, "sample").groupBy("slot", "superpopulation").agg(F.count("*").alias("n")).withColumn("share", r6(F.col("n") / F.sum("n").over(Window.partitionBy("slot"))))
)
query("a39_shared_histogram", "x AS (SELECT superpopulation AS g, least(floor((value - 6) / 2 * 70), 69)::BIGINT AS bin, count(*) AS n FROM scores JOIN meta USING (sample) GROUP BY ALL) SELECT g, bin, n, round(n / sum(n) OVER (PARTITION BY g), 6) AS share FROM x")(
    lambda t: t.scores.join(t.meta, "sample").groupBy(F.col("superpopulation").alias("g"), F.least(F.floor((F.col("value") - 6) / 2 * 70), F.lit(69)).cast("long").alias("bin")).agg(F.count("*").alias("n")).withColumn("share", r6(F.col("n") / F.sum("n").over(Window.partitionBy("g"))))
)
query("p05_filter", "SELECT site, gene FROM sites WHERE regexp_matches(clinsig, 'SMALL|LARGE') AND size >= 30 AND gene = 'Brand#12'")(
    lambda t: relational.filter_by(t.sites, {"clinsig": ["SMALL", "LARGE"], "size": 30, "gene": "Brand#12", "absent": 1}, at_least=["size"]).select("site", "gene")
)
query("p07_recode", f"SELECT site, {_CASE} AS class FROM sites")(lambda t: t.sites.select("site", T.recode(F.col("clinsig"), CLASSES).alias("class")))
query("p01_variant_key", "SELECT p_partkey AS site, 'chr' || (p_partkey % 22 + 1) || ':' || p_size || '-' || (p_size + length(p_brand)) || '_' || p_brand || '_' || p_type AS key FROM part")(
    lambda t: t.part.select(F.col("p_partkey").alias("site"), T.variant_key(F.col("p_partkey") % 22 + 1, F.col("p_size"), F.col("p_brand"), F.col("p_type")).alias("key"))
)
query("p09_complete_sites", "x AS (SELECT DISTINCT site, slot FROM scores) SELECT site, count(*) = 3 AS every, count(*) / 3 >= 0.6 AS most FROM x GROUP BY site")(
    lambda t: t.scores.select("site", "slot").distinct().groupBy("site").agg((F.count("*") == 3).alias("every"), (F.count("*") / 3 >= 0.6).alias("most"))
)
query("p10_work_list", "x AS (SELECT p_partkey AS site, slot FROM part, (SELECT unnest(range(1, 8)) AS slot)) SELECT site, slot FROM x WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = site AND l_linenumber = slot)")(
    lambda t: relational.missing_cells(
        t.sites.select("site", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(7).cast("long"))).alias("slot")),
        t.lineitem.select(F.col("l_partkey").alias("site"), F.col("l_linenumber").cast("long").alias("slot"), F.col("l_extendedprice").alias("value")),
        ["site", "slot"],
    )
)
query("p15_json_filter", "SELECT event_id, user_id FROM events WHERE (props->>'$.k')::INT IN (1, 2, 3)")(lambda t: t.events.where(F.get_json_object("props", "$.k").try_cast("int").isin(1, 2, 3)).select("event_id", "user_id"))


def _population() -> Column:
    return F.when(F.col("sample") % 10 == 0, "REF").otherwise(F.col("population"))


query("j03_metadata_left_join", "SELECT site, sample, CASE WHEN sample % 10 = 0 THEN 'REF' ELSE population END AS population, count(*) AS n FROM scores LEFT JOIN meta USING (sample) GROUP BY ALL")(
    lambda t: relational.pair_counts(t.scores, t.meta.withColumn("population", _population()), "site", "sample", "population").withColumn("population", _population())
)
query("j06_interval_join", "x AS (SELECT p_partkey AS a, p_size AS s, p_size + 3 AS e, p_brand AS g FROM part), y AS (SELECT s_suppkey AS b, (s_suppkey % 60)::INT AS s2, (s_suppkey % 60 + 2)::INT AS e2 FROM supplier) SELECT a, b FROM x JOIN y ON s <= e2 AND s2 <= e")(
    lambda t: intervals.interval_join(t.part.select(F.col("p_partkey").alias("a"), F.col("p_size").alias("l_start"), (F.col("p_size") + 3).alias("l_end")), t.supplier.select(F.col("s_suppkey").alias("b"), (F.col("s_suppkey") % 60).alias("r_start"), (F.col("s_suppkey") % 60 + 2).alias("r_end")), [], 8, closed=True).select("a", "b")
)
query("j07_interval_semi_join", """x AS (SELECT p_partkey AS a, p_partkey % 25 AS g, p_size AS s, p_size + 3 AS e FROM part),
y AS (SELECT s_nationkey AS g, s_suppkey % 60 AS s, s_suppkey % 60 + 2 AS e, s_acctbal > 5000 AS rich FROM supplier)
SELECT a, g, EXISTS (SELECT 1 FROM y WHERE y.g = x.g AND rich AND x.s < y.e AND y.s < x.e) AS in_rich,
  EXISTS (SELECT 1 FROM y WHERE y.g = x.g AND NOT rich AND x.s < y.e AND y.s < x.e) AS in_poor FROM x""")(
    lambda t: intervals.in_region_sets(
        t.part.select(F.col("p_partkey").alias("a"), (F.col("p_partkey") % 25).alias("g"), F.col("p_size").alias("l_start"), (F.col("p_size") + 3).alias("l_end")),
        t.supplier.select(F.when(F.col("s_acctbal") > 5000, "in_rich").otherwise("in_poor").alias("region_set"), F.col("s_nationkey").cast("long").alias("g"), (F.col("s_suppkey") % 60).alias("r_start"), (F.col("s_suppkey") % 60 + 2).alias("r_end")),
        ["g"], ["in_rich", "in_poor"], 8,
    ).select("a", "g", "in_rich", "in_poor")
)
#: Every supplier is a region, on the chromosome of its nation.
query("j07_interval_semi_join_whole", "x AS (SELECT p_partkey AS a, p_partkey % 25 AS g, p_size AS s, p_size + 3 AS e FROM part), y AS (SELECT s_nationkey AS g, s_suppkey % 60 AS s, s_suppkey % 60 + 2 AS e FROM supplier) SELECT a, g FROM x WHERE EXISTS (SELECT 1 FROM y WHERE y.g = x.g AND x.s < y.e AND y.s < x.e)")(
    lambda t: intervals.interval_join(t.part.select(F.col("p_partkey").alias("a"), (F.col("p_partkey") % 25).alias("g"), F.col("p_size").alias("l_start"), (F.col("p_size") + 3).alias("l_end")), t.supplier.select(F.col("s_nationkey").cast("long").alias("g"), (F.col("s_suppkey") % 60).alias("r_start"), (F.col("s_suppkey") % 60 + 2).alias("r_end")), ["g"], 8, how="left_semi").select("a", "g")
)
query("j09_distance_join", "x AS (SELECT p_partkey AS a, p_brand AS g, p_size AS p FROM part) SELECT x.a, y.a AS b FROM x JOIN x y ON x.g = y.g AND abs(x.p - y.p) <= 2 AND x.a < y.a")(
    lambda t: intervals.distance_join(t.part.select(F.col("p_partkey").alias("a"), F.col("p_brand").alias("g"), F.col("p_size").alias("l_pos")), t.part.select(F.col("p_partkey").alias("b"), F.col("p_brand").alias("g"), F.col("p_size").alias("r_pos")), ["g"], 4).where("a < b").select("a", "b")
)
query("j11_aggregate_then_join", "x AS (SELECT site, avg(value) AS m FROM scores GROUP BY site) SELECT site, gene, round(m, 6) AS m FROM x JOIN sites USING (site)")(lambda t: t.scores.groupBy("site").agg(r6(F.avg("value")).alias("m")).join(t.sites, "site").select("site", "gene", "m"))
query("j13_anti_join", "SELECT s_suppkey AS sample FROM supplier WHERE s_nationkey NOT IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1)")(
    lambda t: t.supplier.join(t.nation.where("n_regionkey = 1"), F.col("s_nationkey") == F.col("n_nationkey"), "left_anti").select(F.col("s_suppkey").alias("sample"))
)
query("j15_full_join", "x AS (SELECT gene, count(*) AS n FROM sites WHERE size > 45 GROUP BY gene), y AS (SELECT gene, count(*) AS m FROM sites WHERE size < 3 GROUP BY gene) SELECT gene, coalesce(n, 0) AS n, coalesce(m, 0) AS m FROM x FULL JOIN y USING (gene)")(
    lambda t: t.sites.where("size > 45").groupBy("gene").agg(F.count("*").alias("n")).join(t.sites.where("size < 3").groupBy("gene").agg(F.count("*").alias("m")), "gene", "full").na.fill(0)
)
query("w01_top_per_group", "SELECT gene, site FROM (SELECT gene, site, row_number() OVER (PARTITION BY gene ORDER BY price DESC, site) AS r FROM sites) WHERE r <= 3")(lambda t: relational.best_rows(t.sites, ["gene"], [F.desc("price"), F.col("site")], 3).select("gene", "site"))
query("w03_minmax", "SELECT site, sample, l_orderkey, ploid, round((value - min(value) OVER w) / nullif(max(value) OVER w - min(value) OVER w, 0), 6) AS scaled FROM scores WINDOW w AS (PARTITION BY slot)")(
    lambda t: relational.scale_within(t.scores, ["slot"], "value", "minmax").select("site", "sample", "l_orderkey", "ploid", r6("scaled").alias("scaled"))
)
query("w03_robust", "x AS (SELECT slot, quantile_cont(value, 0.25) AS a, quantile_cont(value, 0.5) AS b, quantile_cont(value, 0.75) AS c FROM scores GROUP BY slot) SELECT site, sample, l_orderkey, ploid, round((value - b) / coalesce(nullif(c - a, 0), 1), 6) AS scaled FROM scores JOIN x USING (slot)")(
    lambda t: relational.scale_within(t.scores, ["slot"], "value", "robust", plain=True).select("site", "sample", "l_orderkey", "ploid", r6("scaled").alias("scaled"))
)
query("w05_running_offsets", "SELECT gene, site, sum(size) OVER (PARTITION BY gene ORDER BY site)::BIGINT AS at FROM sites")(
    lambda t: ordering.running_totals(t.sites, ["gene"], ["site"], {"at": "size"}).select("gene", "site", "at")
)
query("s03_chromosome_order", "SELECT p_partkey AS site, CASE p_partkey % 25 WHEN 22 THEN 1 WHEN 23 THEN 2 WHEN 24 THEN 3 ELSE 0 END AS rank FROM part")(
    lambda t: t.part.withColumn("c", F.concat(F.lit("chr"), F.element_at(F.array(*map(F.lit, [*map(str, range(1, 23)), "X", "Y", "M"])), (F.col("p_partkey") % 25 + 1).cast("int")))).select(F.col("p_partkey").alias("site"), relational.chromosome_order(F.col("c"))[0].alias("rank"))
)
query("u02_in_both", "SELECT site FROM scores WHERE slot = 'A' INTERSECT SELECT site FROM scores WHERE slot = 'R'")(lambda t: t.scores.where("slot = 'A'").select("site").intersect(t.scores.where("slot = 'R'").select("site")))
query("u05_difference", "SELECT site FROM sites EXCEPT SELECT l_partkey FROM lineitem WHERE l_linenumber = 7")(
    lambda t: t.sites.select("site").exceptAll(t.lineitem.where("l_linenumber = 7").select("l_partkey").distinct()).distinct()
)
query("f10_transcribe", "SELECT n_nationkey, lower(translate(n_name, 'Tt', 'Uu')) AS rna FROM nation")(lambda t: t.nation.select("n_nationkey", T.transcribe(F.col("n_name")).alias("rna")))
query("f14_reverse_complement", "SELECT doc_id, reverse(translate(regexp_replace(upper(text), '[^ACGT]', '', 'g'), 'ACGT', 'TGCA')) AS rc FROM documents")(
    lambda t: t.documents.select("doc_id", T.reverse_complement(F.regexp_replace(F.upper("text"), "[^ACGT]", "")).alias("rc"))
)
query("f18_covr", "SELECT site, round(max(abs(log2((alt + 1e-6) / (ref + 1e-6)))), 6) AS covr FROM scores GROUP BY site")(lambda t: t.scores.groupBy("site").agg(r6(F.max(F.abs(M.log2_ratio(F.col("ref"), F.col("alt"))))).alias("covr")))
query("f24_sigmoid", "SELECT site, round(avg(1 / (1 + exp(-value))), 6) AS p FROM scores GROUP BY site")(lambda t: t.scores.groupBy("site").agg(r6(F.avg(M.sigmoid(F.col("value")))).alias("p")))

_PAIR = "x AS (SELECT a.vec_id AS a, list_transform(a.embedding, lambda v: v::DOUBLE) AS u, list_transform(b.embedding, lambda v: v::DOUBLE) AS w FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1) "


def _pairs(t: Tables) -> DataFrame:
    e = t.embeddings.select(F.col("vec_id").alias("a"), F.col("embedding").cast("array<double>").alias("u"))
    return e.join(e.select((F.col("a") - 1).alias("a"), F.col("u").alias("w")), "a")


query("f25_cosine", _PAIR + "SELECT a, round(list_dot_product(u, w) / greatest(sqrt(list_dot_product(u, u)) * sqrt(list_dot_product(w, w)), 1e-8), 6) AS c FROM x")(lambda t: _pairs(t).select("a", r6(M.cosine(F.col("u"), F.col("w"))).alias("c")))
_E = "list_transform({0}, lambda v: exp(v - list_max({0})))"
query("f29_kl", _PAIR + f""", y AS (SELECT a, {_E.format("u")} AS p, {_E.format("w")} AS q FROM x), z AS (SELECT a, unnest(p) / list_sum(p) AS p, unnest(q) / list_sum(q) AS q FROM y)
SELECT a, round(sum(p * ln(p / q)), 6) AS kl FROM z GROUP BY a""")(lambda t: _pairs(t).select("a", r6(M.kl_divergence(M.softmax(F.col("u")), M.softmax(F.col("w")), 0.0)).alias("kl")))
query("f32_entropy", "x AS (SELECT vec_id AS a, list_transform(embedding, lambda v: exp(v::DOUBLE)) AS u FROM embeddings), z AS (SELECT a, unnest(u) / list_sum(u) AS p FROM x) SELECT a, round(-sum(p * ln(p + 1e-8)), 6) AS h FROM z GROUP BY a")(
    lambda t: t.embeddings.select(F.col("vec_id").alias("a"), r6(M.entropy(F.transform(F.col("embedding").cast("array<double>"), F.exp))).alias("h"))
)
query("f19_delta_metrics", _PAIR + ", z AS (SELECT a, unnest(list_transform(u, lambda v: exp(v))) AS r, unnest(list_transform(w, lambda v: exp(v))) AS s FROM x) SELECT a, round(avg(s - r), 6) AS delta_mean, round(avg(abs(s - r)), 6) AS delta_abs_mean, round(max(s - r), 6) AS delta_max, round(max(abs(log2((s + 1e-6) / (r + 1e-6)))), 6) AS covr FROM z GROUP BY a")(
    lambda t: _pairs(t).withColumns({"r": F.transform("u", F.exp), "s": F.transform("w", F.exp)}).select("a", *(r6(c).alias(k) for k, c in M.delta_metrics(F.col("r"), F.col("s")).items() if k != "delta_sq_mean"))
)


def _cells(t: Tables) -> DataFrame:
    """All scores, sites and samples folded into 20 rows and columns."""
    return t.scores.groupBy((F.col("site") % 20).alias("i"), (F.col("sample") % 20).alias("j")).agg(F.avg("value").alias("v"))


_CELLS = "x AS (SELECT site % 20 AS i, sample % 20 AS j, avg(value) AS v FROM scores GROUP BY ALL) "
query("x01_normalize_rows", _CELLS + "SELECT i, j, round(v / nullif(sum(v) OVER (PARTITION BY i), 0), 6) AS v FROM x")(lambda t: matrix.normalize_rows(_cells(t)).withColumn("v", r6("v")))
query("x05_bin_matrix", _CELLS + "SELECT i // 6 AS i, j // 6 AS j, round(avg(v), 6) AS v FROM x WHERE i < 18 AND j < 18 GROUP BY 1, 2")(lambda t: matrix.bin_matrix(_cells(t), 6, 20).withColumn("v", r6("v")))
query("x07_minmax", _CELLS + "SELECT i, j, round((v - min(v) OVER w) / nullif(max(v) OVER w - min(v) OVER w, 0), 6) AS v FROM x WINDOW w AS (PARTITION BY j)")(lambda t: matrix.minmax(_cells(t), "j").withColumn("v", r6("v")))
query("x08_fill_missing", _CELLS + ", g AS (SELECT i, j FROM (SELECT DISTINCT i FROM x), (SELECT DISTINCT j FROM x)) SELECT i, j, round(coalesce(v, avg(v) OVER (PARTITION BY j)), 6) AS v FROM g LEFT JOIN x USING (i, j)")(
    lambda t: matrix.fill_rows(_cells(t), _cells(t).select("i").distinct(), _cells(t).select("j").distinct()).select("i", "j", r6("v").alias("v"))
)
query("x10_distances", _CELLS + "SELECT p.i, q.i AS k, round(sqrt(sum((p.v - q.v) ** 2)), 6) AS distance FROM x p JOIN x q ON p.j = q.j AND p.i < q.i GROUP BY ALL")(lambda t: matrix.distances(_cells(t)).withColumn("distance", r6("distance")))
query("x11_correlations", _CELLS + "SELECT p.j, q.j AS k, count(*) AS n, round(corr(p.v, q.v), 6) AS r FROM x p JOIN x q ON p.i = q.i AND p.j < q.j GROUP BY ALL")(lambda t: matrix.correlations(_cells(t)).withColumn("r", r6("r")))


def _all_cells(t: Tables) -> DataFrame:
    return ordering.dealt(t.scores.select(F.col("site").alias("i"), F.col("sample").alias("j"), "value"), ["i", "j"]).groupBy("i", "j").agg(F.avg("value").alias("v"))


#: The queries above fold sites and samples; these have a row and a column for each.
_ALL_CELLS = "x AS (SELECT site AS i, sample AS j, avg(value) AS v FROM scores GROUP BY ALL) "
query("x01_normalize_rows_whole", _ALL_CELLS + "SELECT i, j, round(v / nullif(sum(v) OVER (PARTITION BY i), 0), 6) AS v FROM x")(lambda t: matrix.normalize_rows(_all_cells(t)).withColumn("v", r6("v")))
query("x05_bin_matrix_whole", _ALL_CELLS + "SELECT i // 6 AS i, j // 6 AS j, round(avg(v), 6) AS v FROM x GROUP BY 1, 2")(lambda t: matrix.bin_matrix(_all_cells(t), 6, None).withColumn("v", r6("v")))
query("x07_minmax_whole", _ALL_CELLS + "SELECT i, j, round((v - min(v) OVER w) / nullif(max(v) OVER w - min(v) OVER w, 0), 6) AS v FROM x WINDOW w AS (PARTITION BY j)")(lambda t: matrix.minmax(_all_cells(t), "j").withColumn("v", r6("v")))
query("x08_fill_missing_whole", _ALL_CELLS + ", g AS (SELECT i, j FROM (SELECT DISTINCT i FROM x), (SELECT DISTINCT j FROM x)) SELECT i, j, round(coalesce(v, avg(v) OVER (PARTITION BY j)), 6) AS v FROM g LEFT JOIN x USING (i, j)")(
    lambda t: matrix.fill_rows(_all_cells(t), digits=6)
)
query("x10_distances_whole")(lambda t: matrix.distances(_all_cells(t)).withColumn("distance", r6("distance")))  # its pairs are too many for the SQL; see tests
query("x11_correlations_whole", _ALL_CELLS + "SELECT p.j, q.j AS k, count(*) AS n, round(corr(p.v, q.v), 6) AS r FROM x p JOIN x q ON p.i = q.i AND p.j < q.j GROUP BY ALL")(lambda t: matrix.correlations(_all_cells(t)).withColumn("r", r6("r")))

_FIT = """x AS (SELECT site % 50 AS k, slot, (ploid = 1)::INT AS w, value AS y FROM scores), s AS (SELECT k, slot, count(*) AS n, sum(w * w) - sum(w) * sum(w) / count(*) AS sxx, sum(w * y) - sum(w) * sum(y) / count(*) AS sxy, sum(y * y) - sum(y) * sum(y) / count(*) AS syy FROM x GROUP BY ALL),
b AS (SELECT *, sxy / (sxx + 1) AS ba, sxy / (sxx + 1 / (1 + (k / 10) * (k / 10))) AS bi FROM s WHERE n >= 10 AND sxx / n >= 1e-20)
SELECT k, slot, n, round(ba, 6) AS beta_add, round(bi, 6) AS beta_int FROM b"""
query("m02_ridge_epistasis", _FIT)(
    lambda t: attribution.ridge_epistasis(t.scores.select((F.col("site") % 50).alias("k"), "slot", (F.col("ploid") == 1).cast("int").alias("w"), F.col("value").alias("y")), ["k", "slot"], "w", "y", F.col("k") / 10).select("k", "slot", "n", r6("beta_add").alias("beta_add"), r6("beta_int").alias("beta_int"))
)
query("t01_anova", "x AS (SELECT site % 40 AS k, superpopulation AS g, count(*) AS n, avg(value) AS m, var_samp(value) AS v FROM scores JOIN meta USING (sample) GROUP BY ALL HAVING count(*) > 1), s AS (SELECT k, count(*) AS c, sum(n) AS n, sum(n * m * m) - sum(n * m) ** 2 / sum(n) AS ssb, sum((n - 1) * v) AS ssw FROM x GROUP BY k) SELECT k, round((ssb / (c - 1)) / (ssw / (n - c)), 4) AS f FROM s WHERE c > 1 AND n > c")(
    lambda t: attribution.anova(t.scores.join(t.meta, "sample").withColumn("kk", F.col("site") % 40), "kk", "superpopulation", "value").select(F.col("kk").alias("k"), F.round("f", 4).alias("f"))
)
query("t03_cohens_d", "x AS (SELECT gene, count(*) FILTER (size > 25) AS na, count(*) FILTER (size <= 25) AS nb, avg(ln(price)) FILTER (size > 25) AS ma, avg(ln(price)) FILTER (size <= 25) AS mb, var_samp(ln(price)) FILTER (size > 25) AS va, var_samp(ln(price)) FILTER (size <= 25) AS vb FROM sites GROUP BY gene) SELECT gene, round((ma - mb) / nullif(sqrt(((na - 1) * va + (nb - 1) * vb) / (na + nb - 2)), 0), 6) AS d FROM x WHERE na > 1 AND nb > 1")(
    lambda t: attribution.cohens_d(t.sites.withColumn("v", F.ln("price")), ["gene"], "v", F.col("size") > 25).select("gene", r6("cohens_d").alias("d"))
)
query("t08_mann_whitney", "x AS (SELECT gene, size > 25 AS a, rank() OVER (PARTITION BY gene ORDER BY price) + (count(*) OVER (PARTITION BY gene, price) - 1) / 2 AS r FROM sites), s AS (SELECT gene, count(*) FILTER (a) AS na, count(*) FILTER (NOT a) AS nb, sum(r) FILTER (a) AS s FROM x GROUP BY gene) SELECT gene, na AS n_a, nb AS n_b, round(s - na * (na + 1) / 2, 6) AS u, round(2 * (s - na * (na + 1) / 2) / (na * nb) - 1, 6) AS cliffs_delta FROM s WHERE na > 0 AND nb > 0")(
    lambda t: attribution.mann_whitney(t.sites, "gene", "price", F.col("size") > 25).select("gene", "n_a", "n_b", r6("u").alias("u"), r6("cliffs_delta").alias("cliffs_delta"))
)
query("t10_correlation", "SELECT gene, round(corr(ln(price), size), 6) AS r FROM sites GROUP BY gene")(lambda t: t.sites.groupBy("gene").agg(r6(F.corr(F.ln("price"), "size")).alias("r")))
query("t14_percentile_bands", "SELECT slot, round(median(value), 6) AS mid, round(quantile_cont(value, 0.05), 6) AS low, round(quantile_cont(value, 0.95), 6) AS high FROM scores GROUP BY slot")(
    lambda t: ordering.exact_quantiles(t.scores, ["slot"], "value", [0.05, 0.5, 0.95], plain=True).select("slot", *(r6(F.col("q")[i]).alias(n) for i, n in ((1, "mid"), (0, "low"), (2, "high"))))
)
query("h08_unique_haplotypes", "x AS (SELECT o_custkey AS h, list_sort(list(DISTINCT l_partkey % 50)) AS v FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY h) SELECT md5(array_to_string(v, ',')) AS hash, count(*) AS n_haplotypes, min(h) AS first, min(len(v))::INT AS n_variants FROM x GROUP BY 1")(
    lambda t: haplotypes.unique_haplotypes(t.orders.join(t.lineitem, F.col("o_orderkey") == F.col("l_orderkey")).select(F.col("o_custkey").alias("haplotype"), (F.col("l_partkey") % 50).alias("variant")))
)
query("h04_consensus", "x AS (SELECT l_partkey % 100 AS pos, l_returnflag AS base, count(*) AS n FROM lineitem GROUP BY ALL), r AS (SELECT pos, base, n / sum(n) OVER (PARTITION BY pos) AS share, count(*) OVER (PARTITION BY pos) AS n_bases, row_number() OVER (PARTITION BY pos ORDER BY n DESC, ascii(base)) AS r FROM x) SELECT pos, base, round(share, 6) AS share, n_bases FROM r WHERE r = 1")(
    lambda t: haplotypes.consensus(t.lineitem.select((F.col("l_partkey") % 100).alias("pos"), F.col("l_returnflag").alias("base"))).withColumn("share", r6("share"))
)
query("h17_splice_regions", """x AS (SELECT p_partkey AS name, p_size * 10 AS s, p_size * 10 + 100 AS e, p_partkey % 2 = 0 AS plus FROM part), r AS (SELECT unnest(['5ss_can', '5ss_iprox', '5ss_eprox']) AS region, unnest([0, 2, -3]) AS a, unnest([2, 6, 0]) AS b, true AS donor UNION ALL SELECT unnest(['3ss_can', '3ss_iprox', 'bp_region', '3ss_eprox']), unnest([-2, -17, -40, 0]), unnest([0, -2, -17, 3]), false)
SELECT name, region, CASE WHEN plus THEN (CASE WHEN donor THEN e ELSE s END) + a ELSE (CASE WHEN donor THEN s ELSE e END) - b END AS r_start, CASE WHEN plus THEN (CASE WHEN donor THEN e ELSE s END) + b ELSE (CASE WHEN donor THEN s ELSE e END) - a END AS r_end FROM x, r
UNION ALL SELECT name, 'exon_core', s + 3, e - 3 FROM x""")(
    lambda t: intervals.splice_regions(t.part.select(F.col("p_partkey").alias("name"), (F.col("p_size") * 10).alias("start"), (F.col("p_size") * 10 + 100).alias("end"), F.when(F.col("p_partkey") % 2 == 0, "+").otherwise("-").alias("strand"))).select("name", "region", "r_start", "r_end")
)


query("t02_wasserstein", """x AS (SELECT gene, price AS v, count(*) FILTER (size > 25) AS a, count(*) FILTER (size <= 25) AS b FROM sites GROUP BY ALL),
y AS (SELECT gene, lead(v) OVER w - v AS step, abs(sum(a) OVER w / sum(a) OVER (PARTITION BY gene) - sum(b) OVER w / sum(b) OVER (PARTITION BY gene)) AS gap FROM x WINDOW w AS (PARTITION BY gene ORDER BY v))
SELECT gene, round(sum(gap * step), 4) AS distance FROM y GROUP BY gene""")(
    lambda t: summaries.wasserstein(t.sites, ["gene"], "price", F.col("size") > 25).select("gene", F.round("distance", 4).alias("distance"))
)
query("t05_paired_effect", "x AS (SELECT slot, alt - ref AS d FROM scores) SELECT slot, count(*) AS n, round(avg(d), 6) AS mean_diff, round(avg(d) / stddev_samp(d), 6) AS dz, round(avg(d) / stddev_samp(d) * sqrt(count(*)), 4) AS t FROM x GROUP BY slot")(
    lambda t: summaries.paired_effect(t.scores, ["slot"], "alt", "ref").select("slot", "n", r6("mean_diff").alias("mean_diff"), r6("dz").alias("dz"), F.round("t", 4).alias("t"))
)
query("a06_group_spread", "x AS (SELECT gene, clinsig, var_samp(ln(price)) AS v, count(DISTINCT site) AS n FROM sites GROUP BY ALL) SELECT clinsig, round(avg(v), 6) AS mean_var, sum(n)::BIGINT AS n_sites, count(DISTINCT gene) AS n_genes, min(gene) AS first FROM x GROUP BY clinsig")(
    lambda t: t.sites.groupBy("gene", "clinsig").agg(F.var_samp(F.ln("price")).alias("v"), F.count_distinct("site").alias("n")).groupBy("clinsig").agg(r6(F.avg("v")).alias("mean_var"), F.sum("n").alias("n_sites"), F.count_distinct("gene").alias("n_genes"), F.min("gene").alias("first"))
)
query("a12_site_summary", "SELECT site, round(avg(ref), 6) AS ref_mean, round(stddev_samp(ref), 6) AS ref_sd, min(alt) AS alt_min, max(alt) AS alt_max FROM scores GROUP BY site")(
    lambda t: t.scores.groupBy("site").agg(r6(F.avg("ref")).alias("ref_mean"), r6(F.stddev_samp("ref")).alias("ref_sd"), F.min("alt").alias("alt_min"), F.max("alt").alias("alt_max"))
)
query("a14_centroids", "SELECT superpopulation, site, round(avg(value), 6) AS v FROM scores JOIN meta USING (sample) GROUP BY ALL")(lambda t: t.scores.join(t.meta, "sample").groupBy("superpopulation", "site").agg(r6(F.avg("value")).alias("v")))
query("a24_enrichment_means", "SELECT gene, round(avg(price), 6) AS mean FROM sites WHERE size <= 20 GROUP BY gene")(lambda t: t.sites.where("size <= 20").groupBy("gene").agg(r6(F.avg("price")).alias("mean")))
query("a35_power_mean", "SELECT slot, round(avg(value ** 4), 4) AS loading FROM scores GROUP BY slot")(lambda t: summaries.power_mean(t.scores, ["slot"], "value", 4).select("slot", F.round("loading", 4).alias("loading")))
query("j12_semi_join", "SELECT site, gene FROM sites WHERE site IN (SELECT site FROM scores WHERE slot = 'R' AND value > 7)")(lambda t: t.sites.join(t.scores.where("slot = 'R' and value > 7").select("site"), "site", "left_semi").select("site", "gene"))
query("s02_custom_order", "SELECT site, CASE clinsig WHEN 'SMALL' THEN 1 WHEN 'LARGE' THEN 2 ELSE 3 END::BIGINT AS place FROM sites")(lambda t: t.sites.select("site", summaries.by_custom_order(F.col("clinsig"), ["SMALL", "LARGE"]).cast("long").alias("place")))
query("s07_middle", "SELECT vec_id, round(list_sum(list_transform(embedding[28:37], lambda v: v::DOUBLE)), 6) AS s FROM embeddings")(
    lambda t: t.embeddings.select("vec_id", r6(F.aggregate(summaries.middle(F.col("embedding").cast("array<double>"), 10), F.lit(0.0), lambda a, v: a + v)).alias("s"))
)
query("u06_in_both_classes", "SELECT gene FROM sites WHERE clinsig IN ('SMALL', 'LARGE') GROUP BY gene HAVING count(DISTINCT clinsig) = 2")(
    lambda t: t.sites.where("clinsig in ('SMALL', 'LARGE')").groupBy("gene").agg(F.count_distinct("clinsig").alias("n")).where("n = 2").select("gene")
)
query("w07_argmax", "SELECT site, arg_max(l_orderkey, (value, -l_orderkey)) AS at, round(max(value), 6) AS top FROM scores GROUP BY site")(
    lambda t: t.scores.groupBy("site").agg(F.max_by("l_orderkey", F.struct(F.col("value"), -F.col("l_orderkey"))).alias("at"), r6(F.max("value")).alias("top"))
)


def _edges(t: Tables) -> DataFrame:
    return t.part.where("p_partkey > 1").select(F.col("p_partkey").alias("child"), F.floor(F.col("p_partkey") / 4).alias("parent")).where("parent > 0")


_CLOSURE = "RECURSIVE e AS (SELECT p_partkey AS child, p_partkey // 4 AS parent FROM part WHERE p_partkey // 4 > 0), c AS (SELECT child, parent AS ancestor, 1 AS level FROM e UNION ALL SELECT c.child, e.parent, level + 1 FROM c JOIN e ON e.child = c.ancestor)"
query("h24_ancestors", _CLOSURE + " SELECT child, ancestor, level FROM c")(lambda t: summaries.ancestors(_edges(t)))
query("h25_common_ancestor", _CLOSURE + """, d AS (SELECT child AS a, count(*) AS depth FROM c GROUP BY child), r AS (SELECT x.child AS id1, y.child AS id2, x.ancestor AS mrca, coalesce(depth, 0) AS depth, row_number() OVER (PARTITION BY x.child ORDER BY coalesce(depth, 0) DESC, x.ancestor) AS r
FROM c x JOIN c y ON y.child = x.child + 7 AND y.ancestor = x.ancestor LEFT JOIN d ON d.a = x.ancestor) SELECT id1, id2, mrca, depth FROM r WHERE r = 1""")(
    lambda t: summaries.common_ancestor(summaries.ancestors(_edges(t)), t.part.select(F.col("p_partkey").alias("id1"), (F.col("p_partkey") + 7).alias("id2")))
)
