"""Queries over variant records: reading order of fields, BED and site frames, keys, labels and joins of annotations.

part plays a table of variant records (chrom, pos, id, ref, list of alt, info text), customers sample metadata.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from varsparq.functions import text as T
from varsparq.operators import intervals, relational
from varsparq.operators import records as tobed
from varsparq.plans.registry import Tables, query, r6

#: A table of variant records in SQL, the same as records() below.
VCF = """x AS (SELECT *, p_partkey % 26 AS c FROM part),
vcf AS (SELECT p_partkey AS id, CASE c WHEN 0 THEN 'GL1' WHEN 23 THEN 'X' WHEN 24 THEN 'Y' WHEN 25 THEN 'MT' ELSE c::VARCHAR END AS chrom,
  p_partkey * 10 + p_size AS pos, substr('ACGT', p_size % 4 + 1, 1) || CASE WHEN p_size % 5 = 0 THEN 'AC' ELSE '' END AS ref,
  CASE WHEN p_size % 3 = 0 THEN ['G', 'T'] ELSE ['AA'] END AS alt, p_type AS clinsig, p_brand AS gene,
  'GENEINFO=' || p_brand || ':' || p_size || ';MC=SO:' || p_size || '|' || lower(p_type) || CASE WHEN p_size % 2 = 0 THEN '|x' ELSE '' END || ';AF=0.' || p_size ||
  CASE WHEN p_size % 7 = 0 THEN '' ELSE ';CLNDISDB=MONDO:MONDO:' || p_partkey || ',MedGen:C' || p_size || '|MONDO:MONDO:' || p_size END AS info FROM x)
"""


def records(t: Tables) -> DataFrame:
    k, size = F.col("p_partkey"), F.col("p_size")
    c = (k % 26).cast("string")
    chrom = F.when(k % 26 == 0, "GL1").when(k % 26 == 23, "X").when(k % 26 == 24, "Y").when(k % 26 == 25, "MT").otherwise(c)
    ref = F.concat(F.substr(F.lit("ACGT"), size % 4 + 1, F.lit(1)), F.when(size % 5 == 0, "AC").otherwise(""))
    alt = F.when(size % 3 == 0, F.array(F.lit("G"), F.lit("T"))).otherwise(F.array(F.lit("AA")))
    end = F.when(size % 2 == 0, "|x").otherwise("")
    ids = F.when(size % 7 == 0, "").otherwise(F.concat(F.lit(";CLNDISDB=MONDO:MONDO:"), k, F.lit(",MedGen:C"), size, F.lit("|MONDO:MONDO:"), size))
    info = F.concat(F.lit("GENEINFO="), "p_brand", F.lit(":"), size, F.lit(";MC=SO:"), size, F.lit("|"), F.lower("p_type"), end, F.lit(";AF=0."), size, ids)
    return t.part.select(k.alias("id"), chrom.alias("chrom"), (k * 10 + size).alias("pos"), ref.alias("ref"), alt.alias("alt"), F.col("p_type").alias("clinsig"), F.col("p_brand").alias("gene"), info.alias("info"))


_INFO = "nullif(regexp_extract(info, '(?:^|;){0}=([^;]+)', 1), '')"
_I = {n: _INFO.format(n) for n in ("GENEINFO", "MC", "AF", "CLNDISDB")}


@query("io02_info_fields", VCF + f"SELECT id, {_I['MC']} AS MC, {_I['AF']} AS AF, {_I['CLNDISDB']} AS CLNDISDB FROM vcf")
def _(t: Tables) -> DataFrame:
    return records(t).select("id", *(T.info_field(F.col("info"), n).alias(n) for n in ("MC", "AF", "CLNDISDB")))


_BED = VCF + """, bed AS (SELECT chrom, pos AS "chromStart", pos + length(ref) AS "chromEnd", id AS name, 0.0 AS score, ref AS "REF", unnest(alt) AS "ALT", clinsig FROM vcf
WHERE regexp_full_match(chrom, '[0-9]+|X|Y'))
"""


def bed(t: Tables) -> DataFrame:
    return tobed.to_bed(records(t), score=F.lit(0.0), extra=["clinsig"])


query("p02_records_to_bed", _BED + "SELECT * FROM bed")(bed)
query("p03_records_to_sites", VCF + """SELECT chrom AS "CHROM", pos AS "POS", pos + length(ref) AS "POS_END", ref AS "REF", array_to_string(alt, ',') AS "ALT" FROM vcf""")(lambda t: tobed.to_sites(records(t)))
query("p04_bed_to_sites", _BED + """SELECT "chrom" AS "CHROM", "chromStart" AS "POS", "chromEnd" AS "POS_END", "REF", "ALT", name, score, clinsig FROM bed""")(lambda t: tobed.bed_to_sites(bed(t)))

_REVIEW = {"ECONOMY": 0, "SMALL": 1, "MEDIUM": 2, "LARGE": 3, "PROMO": 4}
query("p08_review_score", VCF + "SELECT id, CASE clinsig " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in _REVIEW.items()) + " END::TINYINT AS stars FROM vcf")(
    lambda t: records(t).select("id", tobed.review_score(F.col("clinsig"), _REVIEW).alias("stars"))
)


@query("p06_site_filter", """x AS (SELECT l_partkey AS region_idx, (l_partkey + l_linenumber % 2) AS site_idx, l_suppkey AS sample, l_quantity::INT AS n, l_shipdate::VARCHAR AS day, l_orderkey, l_linenumber FROM lineitem),
y AS (SELECT *, row_number() OVER (ORDER BY l_orderkey, l_linenumber, region_idx, sample) - 1 AS row_idx FROM x)
SELECT row_idx, region_idx, sample FROM y WHERE region_idx = site_idx AND sample IN (1, 2, 3, 5, 8) AND n >= 20 AND regexp_matches(day, '-1[02]-')""")
def _(t: Tables) -> DataFrame:
    rows = t.lineitem.select(F.col("l_partkey").alias("region_idx"), (F.col("l_partkey") + F.col("l_linenumber") % 2).alias("site_idx"), F.col("l_suppkey").alias("sample"), F.col("l_quantity").cast("int").alias("n"), F.col("l_shipdate").cast("string").alias("day"), "l_orderkey", "l_linenumber")
    indexed = relational.row_index(rows, ["l_orderkey", "l_linenumber", "region_idx", "sample"])  # W-04: before the filter
    return relational.filter_sites(indexed, {"sample": [1, 2, 3, 5, 8], "n": 20, "day": "-1[02]-"}).select("row_idx", "region_idx", "sample")


query("p11_multi_label", "SELECT p_partkey FROM part WHERE (p_brand IN ('Brand#1', 'Brand#2') OR p_type IN ('SMALL') OR p_size IN (1, 2)) AND p_name IN (SELECT p_name FROM part WHERE p_size = 3)")(
    lambda t: t.part.where(F.col("p_brand").isin("Brand#1", "Brand#2") | F.col("p_type").isin("SMALL") | F.col("p_size").isin(1, 2)).join(t.part.where("p_size = 3").select("p_name").distinct(), "p_name", "left_semi").select("p_partkey")
)
query("p12_contains", VCF + "SELECT id, coalesce(contains(lower(CASE WHEN id % 9 > 0 THEN clinsig END), 'small'), false) AS hit FROM vcf")(
    lambda t: records(t).select("id", T.contains_any_case(F.when(F.col("id") % 9 > 0, F.col("clinsig")), "SMALL").alias("hit"))
)
_SIG = "CASE WHEN id % 3 = 0 THEN 'Likely_pathogenic' WHEN id % 3 = 1 THEN 'Benign/Likely_benign' ELSE clinsig END"
query("p13_significance_class", VCF + f"SELECT id, CASE WHEN contains(lower({_SIG}), 'pathogenic') THEN 'pathogenic' WHEN contains(lower({_SIG}), 'benign') THEN 'benign' ELSE 'other' END AS class FROM vcf")(
    lambda t: records(t).select("id", T.significance_class(F.when(F.col("id") % 3 == 0, "Likely_pathogenic").when(F.col("id") % 3 == 1, "Benign/Likely_benign").otherwise(F.col("clinsig"))).alias("class"))
)
query("p14_top_mutants", """x AS (SELECT gene, site, clinsig, row_number() OVER (PARTITION BY clinsig ORDER BY price DESC, site) AS r FROM sites WHERE regexp_matches(gene, '#1|#2'))
SELECT l_orderkey, site FROM scores WHERE site IN (SELECT site FROM x WHERE r <= 5)""")(lambda t: relational.top_of_terms(t.scores, t.sites, "site", ["#1", "#2"], "gene", "clinsig", [F.desc("price"), F.col("site")], 5).select("l_orderkey", "site"))
query("p16_populations_by_field", "SELECT DISTINCT user_id FROM events WHERE props->>'$.k' IN ('1', '2', '3')")(lambda t: relational.json_members(t.events, "props", "k", ["1", "2", "3"], "user_id"))
query("p17_collection_filter", "SELECT l_shipdate::DATE AS day, count(*) AS n FROM lineitem GROUP BY 1 HAVING count(*) > 30")(lambda t: t.lineitem.groupBy(F.to_date("l_shipdate").alias("day")).agg(F.count("*").alias("n")).where("n > 30"))
query("p19_binarise", "SELECT l_partkey AS site, (count(*) FILTER (l_returnflag = 'A') > 0)::INT AS A, (count(*) FILTER (l_returnflag = 'R') > 0)::INT AS R FROM lineitem GROUP BY 1")(
    lambda t: relational.binarised(t.lineitem.groupBy(F.col("l_partkey").alias("site")).agg(F.count_if(F.col("l_returnflag") == "A").alias("A"), F.count_if(F.col("l_returnflag") == "R").alias("R")), ["A", "R"])
)
query("p20_frequency_mask", "SELECT site, round(avg(nullif(g, -1)), 6) AS af FROM (SELECT l_partkey AS site, CASE WHEN l_linenumber = 7 THEN -1 ELSE (l_returnflag = 'A')::INT END AS g FROM lineitem) GROUP BY site HAVING avg(nullif(g, -1)) >= 0.3")(
    lambda t: relational.frequent(t.lineitem.select(F.col("l_partkey").alias("site"), F.when(F.col("l_linenumber") == 7, -1).otherwise((F.col("l_returnflag") == "A").cast("int")).alias("g")), "site", "g", 0.3).withColumn("af", r6("af"))
)
query("p21_limits", VCF + "SELECT id, chrom FROM (SELECT *, dense_rank() OVER (ORDER BY chrom) AS r, row_number() OVER (PARTITION BY chrom ORDER BY pos, id) AS k FROM vcf) WHERE r <= 3 AND k <= 10")(
    lambda t: relational.limited(records(t), "chrom", 3, [F.col("pos"), F.col("id")], 10).select("id", "chrom")
)
query("p22_backfill", "SELECT c_custkey, split_part(coalesce(CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment END, CASE WHEN c_custkey % 3 = 0 THEN c_name || ',x' END, 'none,y'), ',', 1) AS v FROM customer")(
    lambda t: t.customer.select("c_custkey", T.first_filled([F.when(F.col("c_custkey") % 2 == 0, F.col("c_mktsegment")), F.when(F.col("c_custkey") % 3 == 0, F.concat("c_name", F.lit(",x"))), F.lit("none,y")]).alias("v"))
)
query("p23_overrides", """x AS (SELECT s_suppkey AS sample, 'Override ' || s_nationkey AS p, 'OTHER' AS s FROM supplier WHERE s_acctbal < 1000)
SELECT sample, coalesce(p, population) AS population, coalesce(s, superpopulation) AS superpopulation FROM meta LEFT JOIN x USING (sample)""")(
    lambda t: tobed.with_overrides(t.meta, t.supplier.where("s_acctbal < 1000").select(F.col("s_suppkey").alias("sample"), F.concat(F.lit("Override "), "s_nationkey").alias("population"), F.lit("OTHER").alias("superpopulation")), "sample")
)

# Joins of annotations
_TWO = VCF + ", a AS (SELECT chrom, pos, ref, unnest(alt) AS alt, id FROM vcf), b AS (SELECT chrom, pos, ref, unnest(alt) AS alt, gene FROM vcf WHERE gene > 'Brand#2')\n"


def _left(t: Tables) -> DataFrame:
    return records(t).select("chrom", "pos", "ref", F.explode("alt").alias("alt"), "id")


def _right(t: Tables) -> DataFrame:
    return records(t).where("gene > 'Brand#2'").select("chrom", "pos", "ref", F.explode("alt").alias("alt"), "gene")


query("j01_variant_key_join", _TWO + "SELECT id, alt, gene FROM a JOIN b USING (chrom, pos, ref, alt)")(lambda t: _left(t).join(_right(t), ["chrom", "pos", "ref", "alt"]).select("id", "alt", "gene"))
query("j02_merge_report", _TWO + "SELECT chrom, count(*) AS n, count(gene) AS merged, round(count(gene) / count(*), 6) AS rate FROM a LEFT JOIN b USING (chrom, pos, ref, alt) GROUP BY chrom")(
    lambda t: relational.merge_report(_left(t).join(_right(t), ["chrom", "pos", "ref", "alt"], "left"), ["chrom"], "gene").withColumn("rate", r6("rate"))
)
query("j04_right_join", "x AS (SELECT n_name AS population, n_regionkey * 10.5 AS lat FROM nation WHERE n_regionkey <> 1) SELECT sample, population, lat FROM x RIGHT JOIN meta USING (population)")(
    lambda t: t.nation.where("n_regionkey <> 1").select(F.col("n_name").alias("population"), (F.col("n_regionkey") * 10.5).alias("lat")).join(t.meta, "population", "right").select("sample", "population", "lat")
)
query("j05_pedigree_join", "SELECT c_custkey, n_name AS population FROM customer JOIN nation ON c_nationkey = n_nationkey")(lambda t: t.customer.join(F.broadcast(t.nation), F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", F.col("n_name").alias("population")))
query("j08_exon_lookup", """x AS (SELECT p_partkey AS id, p_partkey % 25 AS g, p_size AS s, p_size + 1 AS e FROM part), y AS (SELECT s_nationkey AS g, s_suppkey % 60 AS s, s_suppkey % 60 + 2 AS e, s_suppkey % 7 AS exon FROM supplier),
h AS (SELECT DISTINCT id, exon FROM x JOIN y ON x.g = y.g AND x.s < y.e AND y.s < x.e) SELECT id, exon FROM x LEFT JOIN h USING (id)""")(
    lambda t: intervals.lookup(
        t.part.select(F.col("p_partkey").alias("id"), (F.col("p_partkey") % 25).alias("g"), F.col("p_size").alias("l_start"), (F.col("p_size") + 1).alias("l_end")),
        t.supplier.select(F.col("s_nationkey").cast("long").alias("g"), (F.col("s_suppkey") % 60).alias("r_start"), (F.col("s_suppkey") % 60 + 2).alias("r_end"), (F.col("s_suppkey") % 7).alias("exon")), ["g"], "id", ["exon"], 8,
    ).select("id", "exon")
)
query("a32_variants_per_region", """x AS (SELECT s_suppkey AS gene, s_suppkey % 7 + 1 AS c, s_suppkey AS s, s_suppkey + 20 AS e FROM supplier)
SELECT gene, count(l_partkey) AS n FROM x LEFT JOIN lineitem ON l_linenumber = c AND l_partkey >= s AND l_partkey < e GROUP BY gene""")(
    lambda t: intervals.region_counts(
        t.lineitem.select(F.col("l_linenumber").cast("long").alias("c"), F.col("l_partkey").alias("pos")),
        t.supplier.select(F.col("s_suppkey").alias("gene"), (F.col("s_suppkey") % 7 + 1).alias("c"), F.col("s_suppkey").alias("r_start"), (F.col("s_suppkey") + 20).alias("r_end")), ["c"], "gene", 32,
    )
)
query("j10_anchor_pairs", """x AS (SELECT s_suppkey AS contact, s_nationkey AS g, s_suppkey % 40 AS a1, (s_suppkey * 7) % 40 AS a2 FROM supplier),
v AS (SELECT p_partkey AS id, p_partkey % 25 AS g, p_size AS p FROM part),
one AS (SELECT id, contact FROM v JOIN x ON v.g = x.g AND p >= a1 AND p < a1 + 5), two AS (SELECT id, contact FROM v JOIN x ON v.g = x.g AND p >= a2 AND p < a2 + 5)
SELECT DISTINCT least(one.id, two.id) AS u, greatest(one.id, two.id) AS w, contact FROM one JOIN two USING (contact) WHERE one.id <> two.id""")(
    lambda t: intervals.anchor_pairs(
        t.part.select(F.col("p_partkey").alias("id"), (F.col("p_partkey") % 25).alias("g"), F.col("p_size").alias("pos")),
        t.supplier.select(F.col("s_suppkey").alias("contact"), F.col("s_nationkey").cast("long").alias("g"), (F.col("s_suppkey") % 40).alias("a1_start"), (F.col("s_suppkey") % 40 + 5).alias("a1_end"), (F.col("s_suppkey") * 7 % 40).alias("a2_start"), (F.col("s_suppkey") * 7 % 40 + 5).alias("a2_end")), ["g"], 8,
    )
)
query("j14_diagonal", "x AS (SELECT p_size AS i, p_partkey % 50 AS j, count(*) AS v FROM part WHERE p_size > 10 GROUP BY ALL), d AS (SELECT range AS i, range AS j FROM range(60)) SELECT i::BIGINT AS i, j::BIGINT AS j, v FROM x FULL JOIN d USING (i, j)")(
    lambda t: t.part.where("p_size > 10").groupBy(F.col("p_size").cast("long").alias("i"), (F.col("p_partkey") % 50).alias("j")).agg(F.count("*").alias("v")).join(t.spark.range(60).select(F.col("id").alias("i"), F.col("id").alias("j")), ["i", "j"], "full")
)
query("j16_top_mappings", """x AS (SELECT site, gene, row_number() OVER (PARTITION BY clinsig ORDER BY price DESC, site) AS r, clinsig FROM sites WHERE starts_with(gene, 'Brand#1'))
SELECT l_orderkey, l_linenumber, p_type AS clinsig, gene FROM lineitem JOIN part ON l_partkey = p_partkey LEFT JOIN (SELECT * FROM x WHERE r <= 2) x ON x.clinsig = p_type""")(
    lambda t: t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey")).select("l_orderkey", "l_linenumber", F.col("p_type").alias("clinsig"))
    .join(relational.best_rows(t.sites.where(F.col("gene").startswith("Brand#1")), ["clinsig"], [F.desc("price"), F.col("site")], 2).select("clinsig", "gene"), "clinsig", "left")
)
query("j17_id_labels", "SELECT c_custkey, n_name AS label FROM customer JOIN nation ON n_nationkey = c_custkey % 40")(lambda t: t.customer.withColumn("k", F.col("c_custkey") % 40).join(F.broadcast(t.nation), F.col("k") == F.col("n_nationkey")).select("c_custkey", F.col("n_name").alias("label")))
query("j18_supported_groups", """x AS (SELECT gene, clinsig, count(*) AS support, avg(price) AS f1 FROM sites WHERE clinsig IN ('SMALL', 'LARGE') GROUP BY ALL),
k AS (SELECT gene FROM x WHERE support >= 3 GROUP BY gene HAVING count(DISTINCT clinsig) = 2) SELECT gene, clinsig, support, round(f1, 6) AS f1 FROM x WHERE gene IN (SELECT gene FROM k)""")(
    lambda t: relational.in_all_classes(t.sites.where("clinsig in ('SMALL', 'LARGE')").groupBy("gene", "clinsig").agg(F.count("*").alias("support"), r6(F.avg("price")).alias("f1")), "gene", "clinsig", F.col("support") >= 3, 2)
)
query("j19_bare_chromosome", VCF + ", y AS (SELECT 'chr' || chrom AS chrom, pos, gene FROM vcf) SELECT id, y.gene FROM vcf JOIN y ON vcf.chrom = regexp_replace(y.chrom, '^chr', '') AND vcf.pos = y.pos")(
    lambda t: records(t).select("id", "chrom", "pos").join(records(t).select(T.bare_chromosome(F.concat(F.lit("chr"), "chrom")).alias("chrom"), "pos", "gene"), ["chrom", "pos"]).select("id", "gene")
)
query("j20_unordered_pairs", "SELECT a.n_nationkey AS i, b.n_nationkey AS j FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey")(lambda t: relational.unordered_pairs(t.nation.select("n_regionkey", F.col("n_nationkey").alias("id")), ["n_regionkey"], "id").select("i", "j"))
query("j21_sequence_pairs", "x AS (SELECT s_suppkey AS id, s_nationkey AS g, s_suppkey % 2 AS phase, md5(s_name) AS seq FROM supplier) SELECT a.id AS i, b.id AS j, a.phase = b.phase AS same_phase, (SELECT count(*) FROM range(1, 33) r(k) WHERE substr(a.seq, k::INT, 1) = substr(b.seq, k::INT, 1)) / 32 AS similarity FROM x a JOIN x b ON a.g = b.g AND a.id <> b.id")(
    lambda t: relational.sequence_pairs(t.supplier.select(F.col("s_suppkey").alias("id"), F.col("s_nationkey").alias("g"), (F.col("s_suppkey") % 2).alias("phase"), F.md5("s_name").alias("seq")), ["g"])
)
query("j22_matrix_lookup", "x AS (SELECT l_partkey % 50 AS i, l_suppkey % 50 AS j, avg(l_discount) AS ld FROM lineitem GROUP BY ALL) SELECT o_orderkey, round(ld, 6) AS ld FROM orders JOIN x ON i = o_custkey % 50 AND j = o_orderkey % 50")(
    lambda t: t.orders.select("o_orderkey", (F.col("o_custkey") % 50).alias("i"), (F.col("o_orderkey") % 50).alias("j")).join(t.lineitem.groupBy((F.col("l_partkey") % 50).alias("i"), (F.col("l_suppkey") % 50).alias("j")).agg(r6(F.avg("l_discount")).alias("ld")), ["i", "j"]).select("o_orderkey", "ld")
)

# Text functions
_MC = _I["MC"]
query("f01_ontology_ids", VCF + f"SELECT id, coalesce(regexp_extract_all({_I['CLNDISDB']}, '(MONDO:[^,|]+)', 1), []) AS ids, len(coalesce(regexp_extract_all({_I['CLNDISDB']}, '(MONDO:[^,|]+)', 1), []))::INT AS n FROM vcf")(
    lambda t: records(t).withColumn("ids", T.ontology_ids(T.info_field(F.col("info"), "CLNDISDB"), "MONDO")).select("id", "ids", F.size("ids").alias("n"))
)
query("f02_ids_of_distinct", VCF + f", d AS (SELECT DISTINCT {_I['CLNDISDB']} AS v FROM vcf), m AS (SELECT v, coalesce(regexp_extract_all(v, '(MedGen:[^,|]+)', 1), []) AS ids FROM d) SELECT id, ids FROM vcf JOIN m ON v IS NOT DISTINCT FROM {_I['CLNDISDB']}")(
    lambda t: relational.map_distinct(records(t).withColumn("v", T.info_field(F.col("info"), "CLNDISDB")), "v", "ids", T.ontology_ids(F.col("v"), "MedGen")).select("id", "ids")
)
query("f03_split_ends", VCF + f"SELECT id, split_part({_MC}, '|', 1) AS mc_id, split_part({_MC}, '|', -1) AS mc_term FROM vcf")(lambda t: records(t).withColumn("v", T.info_field(F.col("info"), "MC")).select("id", T.split_ends(F.col("v"))[0].alias("mc_id"), T.split_ends(F.col("v"))[1].alias("mc_term")))
query("f04_gene", VCF + f"SELECT id, split_part({_I['GENEINFO']}, ':', 1) AS gene FROM vcf")(lambda t: records(t).select("id", T.first_part(T.info_field(F.col("info"), "GENEINFO"), ":").alias("gene")))
query("f05_fix_prefix", VCF + f"SELECT id, replace({_I['CLNDISDB']}, 'MONDO:MONDO:', 'MONDO:') AS ids FROM vcf")(lambda t: records(t).select("id", T.fix_prefix(T.info_field(F.col("info"), "CLNDISDB")).alias("ids")))
_KEY = "'chr' || chrom || ':' || pos || '-' || (pos + length(ref)) || '_' || ref || '_' || alt[1]"


def _keyed(t: Tables) -> DataFrame:
    return records(t).withColumn("key", T.variant_key(F.col("chrom"), F.col("pos"), F.col("ref"), F.col("alt")[0]))


query("f06_parse_key", VCF + "SELECT id, 'chr' || chrom AS c, pos AS s, pos + length(ref) AS e FROM vcf")(lambda t: _keyed(t).select("id", *(T.parse_key(F.col("key"))[k].alias(n) for k, n in (("chrom", "c"), ("start", "s"), ("end", "e")))))
query("f07_short_site", VCF + "SELECT id, 'chr' || chrom || ':' || pos || ' ' || ref || '>' || alt[1] AS label FROM vcf")(lambda t: _keyed(t).select("id", T.short_site(F.col("key")).alias("label")))
query("f08_site_coords", VCF + f"""SELECT id, 'chr' || chrom AS chrom, pos AS start, pos + length(ref) AS "end", {_KEY} AS site_name FROM vcf""")(
    lambda t: records(t).select("id", *(c.alias(n) for n, c in T.site_coords(F.col("chrom"), F.col("pos"), F.col("pos") + F.length("ref"), F.col("ref"), F.col("alt")[0]).items()))
)
query("f09_hgvs_label", VCF + "SELECT id, 'g.' || pos || ref || '>' || alt[1] AS label FROM vcf")(lambda t: _keyed(t).select("id", T.hgvs_label(F.col("key")).alias("label")))
query("f11_bytes", VCF + "SELECT id, list_transform(string_split(ref, ''), lambda c: ord(c)) AS b, ref AS back FROM vcf")(lambda t: records(t).withColumn("b", T.to_bytes(F.col("ref"))).select("id", "b", T.from_bytes(F.col("b")).alias("back")))
query("f12_one_hot", VCF + "SELECT id, list_transform(string_split(ref || 'N', ''), lambda c: [(c = 'A')::INT, (c = 'C')::INT, (c = 'G')::INT, (c = 'T')::INT]) AS hot FROM vcf")(lambda t: records(t).select("id", T.one_hot(F.concat("ref", F.lit("N"))).alias("hot")))
query("f13_one_hot_channels", VCF + "SELECT id, list_transform(['A', 'C', 'G', 'T'], lambda b: list_transform(string_split(ref || 'N', ''), lambda c: (c = b)::INT::FLOAT)) AS hot FROM vcf")(lambda t: records(t).select("id", T.one_hot_channels(F.concat("ref", F.lit("N"))).alias("hot")))
query("f16_batches", "x AS (SELECT s_suppkey, s_nationkey, row_number() OVER (ORDER BY s_suppkey) - 1 AS k FROM supplier) SELECT s_suppkey, k // 5 AS batch FROM x")(lambda t: relational.batches(t.supplier, ["s_suppkey"], 20, 2, 1).select("s_suppkey", "batch"))
query("f40_decode", "SELECT l_orderkey, l_linenumber, ['acceptor_gain', 'acceptor_loss', 'donor_gain', 'donor_loss'][(l_linenumber - 1) % 4 + 1] AS kind, ['pos', 'neg'][(l_linenumber - 1) // 4 + 1] AS strand FROM lineitem")(
    lambda t: t.lineitem.select("l_orderkey", "l_linenumber", *(c.alias(n) for n, c in T.score_type(F.col("l_linenumber") - 1).items()))
)
query("f41_liftover", VCF + """, k AS (SELECT n_nationkey::VARCHAR AS chrom, s AS c_start, s + 3000 AS c_end, n_nationkey * 100 + 7 AS shift FROM nation, (SELECT unnest(range(0, 20000, 5000)) AS s))
SELECT id, vcf.chrom, pos AS old, coalesce(pos + shift, pos) AS new, shift IS NOT NULL AS lifted FROM vcf LEFT JOIN k ON k.chrom = vcf.chrom AND pos >= c_start AND pos < c_end""")(
    lambda t: intervals.liftover(records(t).select("id", "chrom", F.col("pos").alias("old")), t.nation.select(F.col("n_nationkey").cast("string").alias("chrom"), F.explode(F.array(*(F.lit(x).cast("long") for x in range(0, 20000, 5000)))).alias("c_start"), (F.col("n_nationkey") * 100 + 7).alias("shift")).withColumn("c_end", F.col("c_start") + 3000), "old", "new", 4096)
)
query("f42_wildcard_id", VCF + f"SELECT id, '*' || replace(split_part(replace({_I['CLNDISDB']}, 'MONDO:MONDO', 'MONDO'), ',', 1), ':', '_') AS w FROM vcf")(lambda t: records(t).select("id", T.wildcard_id(T.first_part(T.fix_prefix(T.info_field(F.col("info"), "CLNDISDB")), ",")).alias("w")))
query("f43_file_chromosome", VCF + "SELECT id, 'chr' || chrom AS c FROM vcf WHERE chrom <> 'GL1' AND chrom <> 'MT'")(lambda t: records(t).where("chrom not in ('GL1', 'MT')").select("id", T.file_chromosome(F.concat(F.lit("/x/calls_chr"), "chrom", F.lit(".vcf.gz"))).alias("c")))
