"""Queries of studies that take several steps: components, attribution, windows, coverage, contacts, regions and scoring runs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from varsparq.functions import metrics as M
from varsparq.operators import components, contacts, linear, matrix, ordering, rankings, scoring, splicing, submatrix
from varsparq.plans.registry import Tables, query, r6
from varsparq.sources import genotypes, variants
from varsparq.storage import table_path

# Principal components of vectors: a row for each vector, a column for each place


def _vector_cells(t: Tables) -> DataFrame:
    return t.embeddings.select(F.col("vec_id").alias("i"), F.posexplode("embedding").alias("j", "v"))


query("m10_principal_components")(lambda t: components.principal_components(_vector_cells(t), 4).table().select("component", r6("value").alias("value"), r6("ratio").alias("ratio"), F.round("residual", 5).alias("residual")))
query("m10_projections")(lambda t: components.principal_components(_vector_cells(t), 2).projections.select("i", "component", F.round("v", 4).alias("v")))


def _half_cosines(t: Tables) -> DataFrame:
    """Components of vectors side by side with the next one: 64 places of the first, 64 of the second."""
    e = t.embeddings.select("vec_id", F.posexplode("embedding").alias("j", "v"))
    cells = e.select(F.col("vec_id").alias("i"), "j", "v").union(e.select((F.col("vec_id") - 1).alias("i"), (F.col("j") + 64).alias("j"), "v"))
    whole = e.select(F.col("vec_id").alias("i")).distinct().join(e.select((F.col("vec_id") - 1).alias("i")).distinct(), "i")
    return components.half_cosines(components.principal_components(cells.join(whole, "i", "left_semi"), 4), 64).select("component", F.round("cosine", 4).alias("cosine"))


query("m12_half_cosines")(_half_cosines)

# Attribution: suppliers play haplotypes, their properties variants, mean values by class of the part targets
_X = """x AS (SELECT s_suppkey AS i, n_name AS j, 1.0::DOUBLE AS v FROM supplier JOIN nation ON s_nationkey = n_nationkey
UNION ALL SELECT s_suppkey, 'rich', 1.0 FROM supplier WHERE s_acctbal > 5000 UNION ALL SELECT s_suppkey, 'odd', 1.0 FROM supplier WHERE s_suppkey % 2 = 1),
y AS (SELECT sample AS i, clinsig AS site, avg(value) AS y FROM scores JOIN sites USING (site) GROUP BY ALL),
w AS (SELECT site, count(*) AS n, sum(y) AS sy, sum(y * y) AS syy FROM y GROUP BY site),
p AS (SELECT site, j, sum(v) AS sx, sum(v * v) AS sxx, sum(v * y) AS sxy FROM x JOIN y USING (i) GROUP BY ALL),
s AS (SELECT site, j, n, sx, sxy / nullif(sx, 0) AS m1, (sy - sxy) / nullif(n - sx, 0) AS m0, sxx - sx * sx / n AS sxx, sxy - sx * sy / n AS sxy, syy - sy * sy / n AS syy FROM p JOIN w USING (site))
"""


def _x(t: Tables) -> DataFrame:
    s = t.supplier.join(t.nation, F.col("s_nationkey") == F.col("n_nationkey"))
    told = F.array(F.col("n_name"), F.when(F.col("s_acctbal") > 5000, "rich"), F.when(F.col("s_suppkey") % 2 == 1, "odd"))
    return s.select(F.lit("all").alias("model"), F.col("s_suppkey").alias("i"), F.explode(F.array_compact(told)).alias("j"), F.lit(1.0).alias("v"))


def _y(t: Tables) -> DataFrame:
    means = t.scores.join(t.sites, "site").groupBy(F.col("sample").alias("i"), F.col("clinsig").alias("site")).agg(F.avg("value").alias("y"))
    return means.select(F.lit("all").alias("model"), "i", "site", "y")


def _interactions(t: Tables, kind: str, alpha: float) -> DataFrame:
    found = linear.interactions(_x(t), _y(t), kind, alpha)
    return found.select("wt_variant", "site", r6("interaction_strength_signed").alias("strength"), "outlier_type", "n_haplotypes", r6("interaction_strength_weighted").alias("weighted"))


query("m01_ridge_interactions")(lambda t: _interactions(t, "ridge", 1.0))
query("m01_lasso_interactions")(lambda t: _interactions(t, "lasso", 0.002))
query("m01_one_predictor", _X + "SELECT site, j, round(sxy / (sxx + 10), 6) AS coef FROM s WHERE sxx / n >= 1e-20")(
    lambda t: linear.one_predictor(linear.pair_sums(_x(t), _y(t)), 10.0).select("site", "j", r6("coef").alias("coef"))
)
_EPISTASIS = _X + """, e AS (SELECT j, coalesce(avg(m1 - m0), 0) AS wt FROM s GROUP BY j),
d AS (SELECT *, sxy / (sxx + 10) AS joint, sxy / (sxx + 1) AS b, sxy / (sxx + 1 / (1 + (sxy / (sxx + 10) - wt) ** 2)) AS bi FROM s JOIN e USING (j) WHERE sxx / n >= 1e-20),
r AS (SELECT *, syy - 2 * b * sxy + b * b * sxx AS ra, syy - 2 * bi * sxy + bi * bi * sxx AS ri FROM d WHERE n >= 10)
SELECT site, j, round(greatest(0, (ra - ri) / (ri / (n - 3))), 4) AS epistasis_fstat, round(1 - ra / syy, 6) AS additive_r2, round(1 - ri / syy, 6) AS interaction_r2,
  round(b - wt, 6) AS epistasis_coefficient, round(joint - wt, 6) AS deviation_from_additive, round(wt, 6) AS wt_individual_effect FROM r"""


def _epistasis(t: Tables) -> DataFrame:
    sums = linear.pair_sums(_x(t), _y(t))
    return linear.cross_model_epistasis(sums, linear.one_predictor(sums, 10.0), 1.0)


query("m03_cross_model_epistasis", _EPISTASIS)(
    lambda t: _epistasis(t).select("site", "j", F.round("epistasis_fstat", 4).alias("epistasis_fstat"), *(r6(c).alias(c) for c in ("additive_r2", "interaction_r2", "epistasis_coefficient", "deviation_from_additive", "wt_individual_effect")))
)


def _cached(t: Tables) -> DataFrame:
    """A model for each region of the haplotypes, fitted in two calls that share a cache."""
    path = table_path(t.spark, "models")
    named = t.meta.select(F.col("sample").alias("i"), F.col("superpopulation").alias("model"))
    x, y = (df.drop("model").join(named, "i") for df in (_x(t), _y(t)))
    linear.interactions_cached(x, y.where("model in ('ASIA', 'EUROPE')"), path)
    return linear.interactions_cached(x, y, path).select("model", "wt_variant", "site", r6("interaction_strength_signed").alias("strength"))


query("m04_models_cached")(_cached)

# Windows and coverage
query("w13_dense_window", """x AS (SELECT DISTINCT l_suppkey % 120 AS i, l_partkey % 90 AS j FROM lineitem WHERE l_quantity > 48 AND l_linenumber > 4),
o AS (SELECT a AS i, b AS j, count(x.i) AS s FROM range(111) r(a), range(81) c(b) LEFT JOIN x ON x.i >= a AND x.i < a + 10 AND x.j >= b AND x.j < b + 10 GROUP BY a, b)
SELECT i, j, s / 100 AS share FROM o WHERE s / 100 BETWEEN 0.06 AND 0.8 ORDER BY i, j LIMIT 1""")(
    lambda t: submatrix.dense_window(t.lineitem.where("l_quantity > 48 and l_linenumber > 4").select((F.col("l_suppkey") % 120).alias("i"), (F.col("l_partkey") % 90).alias("j"), F.lit(1).alias("v")).distinct(), 120, 90, 10, 10, 0.06, 0.8)
)
query("h14_coverage", """x AS (SELECT DISTINCT l_returnflag AS chrom, l_partkey * 7 AS s, l_partkey * 7 + l_quantity::BIGINT AS e FROM lineitem),
c AS (SELECT chrom, k, sum(step) AS step FROM (SELECT chrom, s AS k, 1 AS step FROM x UNION ALL SELECT chrom, e, -1 FROM x) GROUP BY ALL HAVING sum(step) <> 0),
d AS (SELECT chrom, k, lead(k) OVER w AS n, sum(step) OVER w AS depth FROM c WINDOW w AS (PARTITION BY chrom ORDER BY k))
SELECT chrom, count(*) AS stretches, sum((n - k) * depth)::BIGINT AS bases, max(depth)::BIGINT AS most, sum(n - k)::BIGINT AS covered FROM d WHERE depth > 0 GROUP BY chrom""")(
    lambda t: submatrix.coverage(_spans(t), ["chrom", "whole"])
    .join(t.lineitem.select(F.col("l_returnflag").alias("chrom")).distinct(), "chrom")
    .groupBy("chrom").agg(F.count("*").alias("stretches"), F.sum((F.col("end") - F.col("start")) * F.col("depth")).alias("bases"), F.max("depth").alias("most"), F.sum(F.col("end") - F.col("start")).alias("covered"))
)


def _spans(t: Tables) -> DataFrame:
    start = F.col("l_partkey") * 7
    spans = t.lineitem.select(F.col("l_returnflag").alias("chrom"), F.lit(1).alias("whole"), start.alias("start"), (start + F.col("l_quantity").cast("long")).alias("end"))
    return ordering.dealt(spans, ["chrom", "start", "end"]).distinct()


query("h14_annotation_tracks", """b AS (SELECT DISTINCT l_returnflag AS chrom, CASE WHEN l_linestatus = 'O' THEN 'exons_pos' ELSE 'exons_neg' END AS track, l_partkey * 40 AS s, l_partkey * 40 + l_quantity::BIGINT AS e FROM lineitem),
r AS (SELECT f AS chrom, p_partkey AS region, p_partkey * 37 AS s, p_partkey * 37 + 30 AS e FROM part, (SELECT unnest(['A', 'N', 'R']) AS f)),
base AS (SELECT DISTINCT r.chrom, region, track, unnest(generate_series(greatest(r.s, b.s), least(r.e, b.e) - 1)) - r.s AS k FROM r JOIN b ON r.chrom = b.chrom AND r.s < b.e AND b.s < r.e)
SELECT chrom || region AS region, track, count(*) AS covered, min(k) AS first, max(k) AS last FROM base GROUP BY ALL""")(
    lambda t: submatrix.annotation_tracks(
        t.part.select(F.explode(F.array(*map(F.lit, "ANR"))).alias("chrom"), "p_partkey").select("chrom", F.concat("chrom", "p_partkey").alias("region"), (F.col("p_partkey") * 37).alias("start"), (F.col("p_partkey") * 37 + 30).alias("end")),
        t.lineitem.select(F.lit("exons").alias("name"), F.col("l_returnflag").alias("chrom"), (F.col("l_partkey") * 40).alias("start"), (F.col("l_partkey") * 40 + F.col("l_quantity").cast("long")).alias("end"), F.when(F.col("l_linestatus") == "O", "+").otherwise("-").alias("strand")),
    ).groupBy("region", "track").agg(F.sum(F.col("end") - F.col("start")).alias("covered"), F.min("start").alias("first"), (F.max("end") - 1).alias("last"))
)

# Contacts: places of vectors in 16 bins, mean discounts by pairs of bins as contacts
_CONTACTS = """e AS (SELECT vec_id AS hap, unnest(embedding)::DOUBLE AS v, unnest(range(len(embedding))) AS pos FROM embeddings), m AS (SELECT hap, pos // 4 AS bin, avg(v) AS m FROM e GROUP BY ALL),
d AS (SELECT hap, bin, m - avg(m) OVER (PARTITION BY bin) AS d FROM m), k AS (SELECT p.bin AS a, q.bin AS b, sum(p.d * q.d) / (SELECT count(DISTINCT hap) FROM e) AS covariance FROM d p JOIN d q ON p.hap = q.hap AND p.bin < q.bin GROUP BY ALL),
c AS (SELECT l_partkey % 16 AS a, l_suppkey % 16 AS b, floor(sum(round(l_discount * 100)::BIGINT)::BIGINT * 1048576 / count(*)) / 1048576 AS contact FROM lineitem GROUP BY ALL),
p AS (SELECT a, b, covariance, contact FROM k JOIN c USING (a, b) WHERE abs(a - b) >= 2)
"""


def _contact_pairs(t: Tables) -> DataFrame:
    effects = t.embeddings.select(F.col("vec_id").alias("hap"), F.lit(0).alias("track"), F.posexplode(F.col("embedding").cast("array<double>")).alias("pos", "v"))
    hundredths = F.sum(F.round(F.col("l_discount") * 100).cast("long"))  # sums of whole numbers don't depend on their order
    found = t.lineitem.groupBy((F.col("l_partkey") % 16).alias("a"), (F.col("l_suppkey") % 16).alias("b")).agg((F.floor(hundredths * 2**20 / F.count("*")) / 2**20).alias("contact"))
    return contacts.contact_pairs(contacts.bin_covariance(effects, 64, 16), found, 2)


query("t11_contact_pairs", _CONTACTS + "SELECT a, b, round(covariance, 8) AS covariance, contact FROM p")(lambda t: _contact_pairs(t).select("a", "b", F.round("covariance", 8).alias("covariance"), "contact"))
query("t11_contact_correlation", _CONTACTS + """, r AS (SELECT rank() OVER (ORDER BY contact) + (count(*) OVER (PARTITION BY contact) - 1) / 2 AS x, rank() OVER (ORDER BY covariance) + (count(*) OVER (PARTITION BY covariance) - 1) / 2 AS y FROM p)
SELECT count(*) AS n, round(corr(x, y), 6) AS correlation FROM r""")(lambda t: contacts.contact_correlation(_contact_pairs(t)).select("n", r6("correlation").alias("correlation")))
query("t11_contact_quantiles", _CONTACTS + """, q AS (SELECT unnest(range(11)) AS k, unnest(quantile_cont(contact, [0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1])) AS low FROM p), f AS (SELECT k, low, lead(low) OVER (ORDER BY k) AS high FROM q)
SELECT (k + 1)::INT AS quantile, round(avg(contact), 6) AS mean_contact, round(avg(covariance), 8) AS mean_covariance, count(*) AS n FROM p JOIN f ON k < 10 AND contact >= low AND (contact < high OR (k = 9 AND contact <= high)) GROUP BY k""")(
    lambda t: contacts.contact_quantiles(_contact_pairs(t)).select("quantile", r6("mean_contact").alias("mean_contact"), F.round("mean_covariance", 8).alias("mean_covariance"), "n")
)

# Regions: suppliers play samples, parts positions
_CALLS = """c AS (SELECT 'chr' || (l_linenumber % 3 + 1) AS chrom, l_partkey * 5000 AS pos, l_returnflag AS ref, l_linestatus AS alt, l_suppkey AS sample, ploid, max(CASE WHEN l_tax = 0 THEN -1 WHEN l_discount > 0.05 THEN 1 ELSE 0 END) AS allele
FROM lineitem, (SELECT unnest([0, 1]) AS ploid) WHERE l_linenumber % 2 = ploid OR l_quantity > 25 GROUP BY ALL)
"""


def _calls(t: Tables) -> DataFrame:
    own = t.lineitem.withColumn("ploid", F.explode(F.array(F.lit(0), F.lit(1)))).where("l_linenumber % 2 = ploid or l_quantity > 25")
    call = F.when(F.col("l_tax") == 0, -1).when(F.col("l_discount") > 0.05, 1).otherwise(0)
    keys = F.concat(F.lit("chr"), F.col("l_linenumber") % 3 + 1).alias("chrom"), (F.col("l_partkey") * 5000).alias("pos"), F.col("l_returnflag").alias("ref"), F.col("l_linestatus").alias("alt"), F.col("l_suppkey").alias("sample"), "ploid"
    return own.groupBy(*keys).agg(F.max(call).alias("allele"))


def _region(t: Tables) -> DataFrame:
    path = table_path(t.spark, "calls")
    size = genotypes.fitting_bin(t.lineitem.select(F.concat(F.lit("chr"), F.col("l_linenumber") % 3 + 1).alias("chrom"), (F.col("l_partkey") * 5000).alias("pos")))
    genotypes.write_binned(_calls(t), path, size)
    return genotypes.read_region(t.spark, path, "2", 150_000, 700_000, size)


query("io20_region_read", _CALLS + "SELECT chrom, pos, ref, alt, sample, ploid::INT AS ploid, allele FROM c WHERE chrom = 'chr2' AND pos >= 150000 AND pos < 700000")(lambda t: _region(t).select("chrom", "pos", "ref", "alt", "sample", "ploid", "allele"))
query("io14_region_matrix", _CALLS + "SELECT sample || '_' || ploid AS haplotype, 'chr2:' || pos || '-' || (pos + 1) || '_' || ref || '_' || alt AS variant, (allele > 0)::INT AS v FROM c WHERE chrom = 'chr2' AND pos >= 150000 AND pos < 700000")(
    lambda t: genotypes.region_matrix({"one": _region(t)}).select("haplotype", "variant", "v")
)
query("io15_dosages", _CALLS + "SELECT 'chr2:' || pos || '-' || (pos + 1) || '_' || ref || '_' || alt AS variant, sample, CASE WHEN max(allele) > -1 THEN sum(allele)::BIGINT END AS dosage FROM c WHERE chrom = 'chr2' AND pos >= 150000 AND pos < 700000 GROUP BY ALL")(
    lambda t: genotypes.dosages(_region(t))
)

# Scoring runs
_DNA = "translate(md5({}), '0123456789abcdef', 'ACGTACGTACGTACGT')"
_PAIRS = f"""p AS (SELECT s_suppkey AS sample, n_name AS site, {_DNA.format("s_name")} AS wt, {_DNA.format("s_name")} || repeat('GC', (s_suppkey % 3)::INT) AS mut FROM supplier JOIN nation ON s_nationkey = n_nationkey),
g AS (SELECT sample, site, len(regexp_extract_all(mut, '[GC]')) / len(mut) - len(regexp_extract_all(wt, '[GC]')) / len(wt) AS gc, len(mut) - len(wt) AS l FROM p)
"""


def _scoring(t: Tables) -> tuple[DataFrame, list[str]]:
    dna = F.translate(F.md5("s_name"), "0123456789abcdef", "ACGTACGTACGTACGT")
    s = t.supplier.join(t.nation, F.col("s_nationkey") == F.col("n_nationkey"))
    return s.select(F.col("s_suppkey").alias("sample"), F.col("n_name").alias("site"), dna.alias("seq_wt"), F.concat(dna, F.expr("repeat('GC', cast(s_suppkey % 3 as int))")).alias("seq_mut")), ["site", "sample"]


def _resumed(t: Tables) -> DataFrame:
    """A run of five sites, then one of all: finished cells are not scored again."""
    pairs, keys = _scoring(t)
    path = table_path(t.spark, "scores")
    scoring.resume(pairs, "gc_shift", keys, path, limit_sites=5)
    scoring.resume(pairs, "gc_shift", keys, path)
    return scoring.read_results(t.spark, path, keys)


query("k01_resumed_scores", _PAIRS + "SELECT site, sample, 'gc_shift' AS model, unnest(['GC', 'LEN']) AS slot, round(unnest([gc, l]), 6) AS value FROM g")(lambda t: _resumed(t).select("site", "sample", "model", "slot", r6("value").alias("value")))
query("k10_wide_scores", _PAIRS + "SELECT site, sample, round(gc, 6) AS GC, l::DOUBLE AS LEN FROM g")(lambda t: scoring.wide_results(_resumed(t), ["site", "sample"], ["GC", "LEN"]).select("site", "sample", r6("GC").alias("GC"), "LEN"))


# Splice scores: sixteen places of a vector play each track
_TRACKS = ("acceptor_ref", "acceptor_alt", "donor_ref", "donor_alt")


def _windows(t: Tables) -> DataFrame:
    """Windows of 16 positions: tracks from quarters of the vector, those of the other strand from the vector back to front."""
    e = F.col("embedding").cast("array<double>")
    tracks = [F.slice(v, 16 * k + 1, 16).alias(f"{s}_{n}") for s, v in (("pos", e), ("neg", F.reverse(e))) for k, n in enumerate(_TRACKS)]
    every = lambda m: F.transform(F.sequence(F.lit(0), F.lit(15)), lambda k: ((k + F.col("vec_id")) % m == 0).cast("int"))
    sites = [every(m).alias(f"{s}_{n}_sites") for s in splicing.STRANDS for n, m in (("acceptor", 3), ("donor", 4))]
    told = {"variant_idx": "vec_id", "chromosome": "concat('chr', vec_id % 22 + 1)", "position": "vec_id * 100", "ref_allele": "'A'", "alt_allele": "'G'", "sample_id": "label", "hap_id": "vec_id % 2", "flag": "0"}
    coord = F.transform(F.sequence(F.lit(0), F.lit(15)), lambda k: F.col("vec_id") * 100 + k)
    return t.embeddings.select(*(F.expr(c).alias(n) for n, c in told.items()), coord.alias("ref_coord"), *tracks, *sites)


query("k09_splice_scores", """t AS (SELECT vec_id, s, k, v[k + 1] AS ar, v[k + 17] AS aa, v[k + 33] AS dr, v[k + 49] AS da, ((k + vec_id) % 3 = 0)::INT AS am, ((k + vec_id) % 4 = 0)::INT AS dm
FROM (SELECT vec_id, 0 AS s, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings UNION ALL SELECT vec_id, 1, list_transform(list_reverse(embedding), lambda x: x::DOUBLE) FROM embeddings), range(16) r(k)),
g AS (SELECT vec_id, s, k, unnest([0, 1, 2, 3]) AS kind, unnest([(aa - ar) * (1 - am), -(aa - ar) * am, (da - dr) * (1 - dm), -(da - dr) * dm]) AS v FROM t),
m AS (SELECT vec_id, s, kind, max(v) AS v, arg_max(vec_id * 100 + k, (v, -k)) AS coord FROM g GROUP BY ALL),
b AS (SELECT vec_id, arg_max(struct_pack(v := v, coord := coord, kind := kind, s := s), (v, -(s * 4 + kind))) AS b FROM m GROUP BY vec_id)
SELECT vec_id AS variant_idx, round(b.v, 6) AS max_delta_score, b.coord AS max_delta_coord, ['acceptor_gain', 'acceptor_loss', 'donor_gain', 'donor_loss'][b.kind + 1] AS max_delta_score_type, ['pos', 'neg'][b.s + 1] AS max_delta_strand,
  round(p.v, 6) AS pos_donor_loss_max, p.coord AS pos_donor_loss_max_coord, round(n.v, 6) AS neg_acceptor_gain_max, n.coord AS neg_acceptor_gain_max_coord
FROM b JOIN m p USING (vec_id) JOIN m n USING (vec_id) WHERE p.s = 0 AND p.kind = 3 AND n.s = 1 AND n.kind = 0""")(
    lambda t: splicing.score_windows(_windows(t)).select("variant_idx", "max_delta_coord", "max_delta_score_type", "max_delta_strand", "pos_donor_loss_max_coord", "neg_acceptor_gain_max_coord", *(r6(c).alias(c) for c in ("max_delta_score", "pos_donor_loss_max", "neg_acceptor_gain_max")))
)


# Files: tables written in the formats of the sources and read back
_LINE = "concat_ws('\t', concat('chr', p_partkey % 22 + 1), p_size * 100 + p_partkey, concat('rs', p_partkey), 'A', if(p_partkey % 3 = 0, 'G,T', 'C'), '.', '.', concat('AF=', p_size, ';CLNREVSTAT=', if(p_partkey % 2 = 0, 'practice_guideline', 'unknown'), ';MC=SO:', p_size, '|', lower(substring_index(p_type, ' ', 1))))"


def _vcf(t: Tables) -> DataFrame:
    """A VCF of parts, read by chromosome and predicate into a cache, and from the cache."""
    path, cache = table_path(t.spark, "vcf"), table_path(t.spark, "vcf-cache")
    t.part.select(F.expr(_LINE).alias("value")).write.text(path)
    read = lambda: variants.read_vcf(t.spark, path, ["AF", "MC", "CLNREVSTAT"], contig="7", predicate=F.col("AF").cast("int") > 10, cache=cache)
    read()
    return read()


query("io01_vcf_records", """x AS (SELECT *, p_size * 100 + p_partkey AS pos FROM part WHERE p_partkey % 22 + 1 = 7 AND p_size > 10)
SELECT 'chr7' AS chrom, pos, 'rs' || p_partkey AS id, 'A' AS ref, CASE WHEN p_partkey % 3 = 0 THEN 'G|T' ELSE 'C' END AS alt, p_size::VARCHAR AS AF, 'SO:' || p_size AS MC_id, lower(split_part(p_type, ' ', 1)) AS MC_term,
  CASE WHEN p_partkey % 2 = 0 THEN 4 END::TINYINT AS CLNREVSTAT_score FROM x""")(lambda t: _vcf(t).select("chrom", "pos", "id", "ref", F.array_join("alt", "|").alias("alt"), "AF", "MC_id", "MC_term", "CLNREVSTAT_score"))


def _bed(t: Tables) -> DataFrame:
    path = table_path(t.spark, "bed")
    alt = F.when(F.col("p_size") > 5, F.substring("p_brand", 1, 1))
    rows = t.part.select(F.concat(F.lit("chr"), F.col("p_partkey") % 22 + 1).alias("chrom"), F.col("p_size").alias("chromStart"), (F.col("p_size") + 1).alias("chromEnd"), F.concat(F.lit("v"), "p_partkey").alias("name"), "p_retailprice", F.lit("A").alias("REF"), alt.alias("ALT"))
    variants.write_bed(rows.withColumnRenamed("p_retailprice", "score"), path)
    return variants.read_bed(t.spark, path)


query("io03_bed_rows", "SELECT 'chr' || (p_partkey % 22 + 1) AS chrom, p_size::BIGINT AS chromStart, (p_size + 1)::BIGINT AS chromEnd, 'v' || p_partkey AS site, round(p_retailprice, 4) AS score, left(p_brand, 1) AS ALT FROM part WHERE p_size > 5")(
    lambda t: _bed(t).select("chrom", "chromStart", "chromEnd", "site", F.round("score", 4).alias("score"), "ALT")
)


def _score_table(t: Tables) -> DataFrame:
    """Scores by model and chromosome; one chromosome is written anew with other values, then columns are read without nulls."""
    path = table_path(t.spark, "score-table")
    rows = t.scores.select(F.lit("m").alias("model"), (F.col("site") % 4).alias("chrom"), "l_orderkey", "site", "sample", F.when(F.col("slot") != "N", F.col("value")).alias("value"))
    variants.append_scores(rows, path)
    variants.append_scores(rows.where("chrom = 2").withColumn("value", F.col("value") + 1), path)
    return variants.read_scores(t.spark, path, ["chrom", "l_orderkey", "site", "sample", "value"])


query("io07_score_table", "SELECT (site % 4)::INT AS chrom, l_orderkey, site, sample, round(CASE WHEN site % 4 = 2 THEN value + 1 ELSE value END, 6) AS value FROM scores WHERE slot <> 'N'")(
    lambda t: _score_table(t).select(F.col("chrom").cast("int").alias("chrom"), "l_orderkey", "site", "sample", r6("value").alias("value"))
)


# Tracks: labels of vectors play tracks, vectors haplotypes, components places; values are made positive
def _track_cells(t: Tables) -> DataFrame:
    return t.embeddings.select(F.col("vec_id").alias("hap"), F.col("label").alias("track"), F.posexplode(F.transform(F.col("embedding").cast("array<double>"), F.exp)).alias("place", "v"))


_TRACK_CELLS = """c AS (SELECT vec_id AS hap, label AS track, unnest(range(len(embedding))) AS place, exp(unnest(embedding)::DOUBLE) AS v FROM embeddings),
a AS (SELECT *, avg(v) OVER w AS m, stddev_samp(v) OVER w AS sd, max(v) OVER w - min(v) OVER w AS span, median(v) OVER w AS med, exp(v) / sum(exp(v)) OVER w AS p, v / (sum(v) OVER w + 1e-8) AS q FROM c WINDOW w AS (PARTITION BY track, place)),
g AS (SELECT track, place, avg(abs(v)) AS m, any_value(sd) AS std, median(abs(v - med)) AS mad, -sum(p * ln(p + 1e-8)) AS entropy, -sum(q * ln(q + 1e-8)) AS differential_entropy, any_value(sd / (abs(m) + 1e-8)) AS cv, any_value(span) AS span FROM a GROUP BY ALL),
t AS (SELECT track, avg(std) AS std, avg(mad) AS mad, avg(entropy) AS entropy, avg(differential_entropy) AS differential_entropy, avg(cv) AS cv, avg(span) AS range, sum(m) AS auc, avg((m > least)::INT) AS spread
FROM (SELECT *, 0.05 * max(m) OVER (PARTITION BY track) + 1e-8 AS least FROM g) GROUP BY track)
"""


def _all_scores(t: Tables) -> DataFrame:
    cells, out = _track_cells(t), None
    for metric in rankings.VARIABILITY:
        if metric != "multiscale_entropy":
            own = rankings.track_scores(cells, metric).select("track", r6("score").alias(metric))
            out = own if out is None else out.join(own, "track")
    return out


query("w10_track_scores", _TRACK_CELLS + "SELECT track, " + ", ".join(f"round({m}, 6) AS {m}" for m in rankings.VARIABILITY if m != "multiscale_entropy") + " FROM t")(_all_scores)
query("w10_most_variable_tracks", _TRACK_CELLS + "SELECT (row_number() OVER (ORDER BY std DESC, track))::INT AS place, track, round(std, 6) AS score FROM t ORDER BY place LIMIT 3")(
    lambda t: rankings.most_variable_tracks(_track_cells(t), "std", 3).select("place", "track", r6("score").alias("score"))
)

# Matrices with gaps: mean discounts of first lines
_GAPS = "x AS (SELECT l_partkey % 60 AS i, l_suppkey % 50 AS j, avg(l_discount) AS v FROM lineitem WHERE l_linenumber = 7 AND l_quantity < 25 GROUP BY ALL), g AS (SELECT i, j FROM (SELECT DISTINCT i FROM x), (SELECT DISTINCT j FROM x)) "


def _gaps(t: Tables) -> DataFrame:
    own = t.lineitem.where("l_linenumber = 7 and l_quantity < 25")
    return own.groupBy((F.col("l_partkey") % 60).alias("i"), (F.col("l_suppkey") % 50).alias("j")).agg(F.avg("l_discount").alias("v"))


for _how, _fill in (("colmedian", "median(v) OVER (PARTITION BY j)"), ("rowmean", "avg(v) OVER (PARTITION BY i)"), ("rowmedian", "median(v) OVER (PARTITION BY i)"), ("constant", "0.5")):
    query(f"x08_fill_{_how}", _GAPS + f"SELECT i, j, round(coalesce(v, {_fill}), 6) AS v FROM g LEFT JOIN x USING (i, j)")(
        lambda t, how=0.5 if _how == "constant" else _how: matrix.fill_rows(m := _gaps(t), m.select("i").distinct(), m.select("j").distinct(), how).select("i", "j", r6("v").alias("v"))
    )
query("x07_minmax_both", _GAPS + """, r AS (SELECT i, j, (v - min(v) OVER w) / nullif(max(v) OVER w - min(v) OVER w, 0) AS v FROM x WINDOW w AS (PARTITION BY i))
SELECT i, j, round((v - min(v) OVER w) / nullif(max(v) OVER w - min(v) OVER w, 0), 6) AS v FROM r WINDOW w AS (PARTITION BY j)""")(lambda t: matrix.minmax_in_order(_gaps(t), ["i", "j"]).withColumn("v", r6("v")))
query("f24_softmax_reductions", """x AS (SELECT vec_id, unnest(embedding)::DOUBLE AS v FROM embeddings), p AS (SELECT vec_id, v, exp(v) / sum(exp(v)) OVER (PARTITION BY vec_id) AS p FROM x)
SELECT vec_id, round(sum(ln(p)), 5) AS log_softmax_sum, round(avg(1 / (1 + exp(-v))), 6) AS sigmoid_mean, round(max(p), 6) AS softmax_max FROM p GROUP BY vec_id""")(
    lambda t: t.embeddings.select("vec_id", F.col("embedding").cast("array<double>").alias("e")).select(
        "vec_id", F.round(M.logits_to_probs(F.col("e"), "log_softmax", "sum"), 5).alias("log_softmax_sum"), r6(M.logits_to_probs(F.col("e"), "sigmoid", "mean")).alias("sigmoid_mean"), r6(M.logits_to_probs(F.col("e"), "softmax", F.array_max)).alias("softmax_max")
    )
)
