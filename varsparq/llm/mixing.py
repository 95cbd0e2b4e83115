"""Mixing sources to target weights by soft membership, in DataFrame functions alone.

A naive Bayes classifier, trained on the labelled table, gives each document posteriors over domains: low (quality 0),
toxic and ordinary. Projected-gradient least squares then fits a nonnegative rate for each document so that the expected
tokens of each domain, sum of rate * tokens * posterior, match the targets. Documents with equal posteriors keep equal
rates, so the steps run over one row for each distinct posterior: the product of the numbers of bins at most (400).
A step takes from a rate the posterior-weighted errors of the domains, scaled by the curvature of the rates above 0 (a
projected gradient step in the metric of the errors), and clips at 0; starting rates are 1. A step after which the errors
are not smaller is taken back for a shorter one, in the end for a plain gradient step of safe length.
Rates are a column of the small table, written once
a step. Where targets are out of reach, the rates are those of least error, and a warning tells what is left.

Defined cases: null and empty texts have no tokens, posteriors by their (empty) features, and a rate like any other;
rows with a null id have no label. Very long texts are read whole. Repeated rows get equal rates. Extra columns are kept,
whatever their names. Domains without a labelled row or without tokens get no target; the other weights are scaled up.
Without any label all documents are ordinary. An empty table gives an empty result.
"""

from __future__ import annotations

import math
import warnings
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from varsparq.llm.shared import materialise, of_keys

DOMAINS = ["low", "ordinary", "toxic"]
#: Upper ends of the bins of symbols a word and of distinct words a word.
SYMBOL_ENDS, DISTINCT_ENDS = [0.02, 0.2, 0.6, 1.5], [0.2, 0.4, 0.6, 0.8]
PREFIX, MOST_HITS, LEAST_SEEN, LEAST_RATIO = 5, 3, 12, 25.0
_WHITE = r"[\x20\x09-\x0D]+"


def _prefixes(text: Column) -> Column:
    """Distinct first letters (at most PREFIX) of the words of a text."""
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(rf"(\p{{L}}{{1,{PREFIX}}})\p{{L}}*"), F.lit(1)))


def _bin(value: Column, ends: list[float]) -> Column:
    return sum(((value > end).cast("int") for end in ends), F.lit(0))


def _domain(quality: Column, toxic: Column) -> Column:
    return F.when(quality == 0, "low").when(toxic == 1, "toxic").otherwise("ordinary")


def lexicons(labelled: DataFrame, size: int) -> dict[str, list[str]]:
    """For each domain but the ordinary one, at most ``size`` prefixes that are LEAST_RATIO times as frequent there as elsewhere.

    labelled: domain and _prefixes of documents.
    """
    total = {r.domain: r.n for r in labelled.groupBy("domain").agg(F.count("*").alias("n")).collect()}
    seen = labelled.select("domain", F.explode("_prefixes").alias("prefix")).where("prefix <> ''")
    counts = seen.groupBy("prefix").agg(*(F.count_if(F.col("domain") == d).alias(d) for d in DOMAINS))
    found = {d: [] for d in DOMAINS if d != "ordinary" and total.get(d)}
    if not found:
        return found
    told = []
    for domain in found:
        rest = sum(n for d, n in total.items() if d != domain)
        others = sum((F.col(d) for d in DOMAINS if d != domain), F.lit(0))
        ratio = ((F.col(domain) + 0.5) / (total[domain] + 1)) / ((others + 0.5) / (rest + 1))
        good = (F.col(domain) >= LEAST_SEEN) & (ratio >= LEAST_RATIO)
        told.append(F.struct(F.lit(domain).alias("domain"), F.when(good, F.col(domain)).alias("n")))
    both = counts.select("prefix", F.explode(F.array(*told)).alias("c")).select("prefix", "c.*").where("n is not null")
    best = both.withColumn("place", F.row_number().over(Window.partitionBy("domain").orderBy(F.desc("n"), "prefix"))).where(F.col("place") <= size)
    for r in best.orderBy("prefix").collect():  # at most ``size`` rows a domain
        found[r.domain].append(r.prefix)
    return found


def _hits(words: dict[str, list[str]]) -> dict[str, Column]:
    """Name -> how many words of a domain's lexicon a document has, up to MOST_HITS."""
    met = lambda lexicon: F.size(F.array_intersect("_prefixes", F.array(*map(F.lit, lexicon)))) if lexicon else F.lit(0)
    return {f"_f_hits_{domain}": F.least(met(lexicon), F.lit(MOST_HITS)) for domain, lexicon in words.items()}


def _read(docs: DataFrame, kept: list[str]) -> DataFrame:
    """_row (its columns ``kept``), _id, _tokens, bins of symbols and of distinct words, and _prefixes of each row of ``docs``: all that the classifier takes from texts, read once."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in kept)).alias("_row"), F.col("doc_id").alias("_id"), text.alias("_text")).withColumn("_words", F.filter(F.split("_text", _WHITE), lambda w: w != ""))
    n = F.greatest(F.size("_words"), F.lit(1))
    symbols = _bin(F.regexp_count("_text", F.lit(r"[#*$%&|<>]")) / n, SYMBOL_ENDS)
    distinct = _bin(F.size(F.array_distinct("_words")) / n, DISTINCT_ENDS)
    return rows.select("_row", "_id", F.size("_words").cast("long").alias("_tokens"), symbols.alias("_f_symbols"), distinct.alias("_f_distinct"), _prefixes(F.col("_text")).alias("_prefixes"))


def _classified(docs: DataFrame, labels: DataFrame, lexicon: int = 256, kept: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """_row, _tokens and _cell (a number for its bins of the features) of each row of ``docs``; _cell, _tokens (of all its rows) and posteriors of each cell, 400 at most.

    Lexicons and the tables of the naive Bayes classifier come from all labelled documents. Texts never meet labels: features do.
    """
    truth = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("toxic").alias("toxic"))
    truth = truth.select(F.col("doc_id").alias("_id"), _domain(F.col("quality"), F.col("toxic")).alias("domain"))
    read = materialise(_read(docs, docs.columns if kept is None else kept), "mix-features")
    labelled = of_keys(read.select("_id", "_f_symbols", "_f_distinct", "_prefixes"), "_id", truth).drop("_id")
    labelled = materialise(labelled, "mix-labelled")
    words = lexicons(labelled, lexicon)
    hits = _hits(words)
    names = {"_f_symbols": len(SYMBOL_ENDS) + 1, "_f_distinct": len(DISTINCT_ENDS) + 1} | dict.fromkeys(hits, MOST_HITS + 1)  # numbers of bins
    cell, size = F.lit(0), 1
    for f, bins in names.items():
        cell, size = cell + hits.get(f, F.col(f)) * size, size * bins
    cell = F.coalesce(cell, F.lit(-1)).alias("_cell")  # never null: a filter on nulls would count the hits again

    def bin_of(f: str) -> Column:
        at = list(names).index(f)
        return F.floor(F.col("_cell") / math.prod(list(names.values())[:at])).cast("int") % names[f]

    told = labelled.select("domain", cell).groupBy("domain", "_cell").agg(F.count("*").alias("_n"))
    cells = told.select("domain", "_n", F.explode(F.array(*(F.struct(F.lit(f).alias("f"), bin_of(f).alias("bin")) for f in names))).alias("c"))
    count = {(r.domain, r.f, r.bin): r.n for r in cells.groupBy("domain", "c.f", "c.bin").agg(F.sum("_n").alias("n")).collect()}
    total = {d: sum(n for (x, f, _), n in count.items() if x == d and f == "_f_symbols") for d in DOMAINS}
    known = [d for d in DOMAINS if total[d]] or ["ordinary"]

    def log_odds(domain: str) -> Column:
        out = F.lit(math.log(max(total[domain], 1)))
        for f, bins in names.items():
            table = [math.log((count.get((domain, f, b), 0) + 0.1) / (total[domain] + 0.1 * bins)) for b in range(bins)]
            out = out + F.element_at(F.array(*map(F.lit, table)), bin_of(f) + 1)
        return out

    with_cells = read.select("_row", "_tokens", cell)
    masses = materialise(with_cells.groupBy("_cell").agg(F.sum("_tokens").alias("_tokens")).coalesce(1), "mix-cells")
    scored = masses.select("_cell", "_tokens", *(log_odds(d).alias(f"_l_{d}") for d in known))
    top = F.greatest(*(F.col(f"_l_{d}") for d in known), *([F.lit(-1e300)] if len(known) == 1 else []))
    weights = {d: F.exp(F.col(f"_l_{d}") - top) for d in known}
    share = sum(weights.values(), F.lit(0.0))
    cells = scored.select("_cell", "_tokens", *((weights[d] / share if d in known else F.lit(0.0)).alias(f"_{d}") for d in DOMAINS))
    return with_cells, materialise(cells, "mix-posteriors")  # written, as a join by posteriors would filter by their whole formulas


def classify(docs: DataFrame, labels: DataFrame, lexicon: int = 256) -> DataFrame:
    """_row (a row of ``docs``), _tokens (words of its text) and _low, _ordinary, _toxic: posteriors, equal for equal bins of the features."""
    rows, cells = _classified(docs, labels, lexicon)
    return rows.join(F.broadcast(cells.drop("_tokens")), "_cell").drop("_cell")


def _posterior(domain: str) -> Column:
    return F.col(f"_{domain}") / sum((F.col(f"_{d}") for d in DOMAINS), F.lit(0))


def _solve(matrix: list[list[float]], values: list[float]) -> list[float]:
    """Solution of a small symmetric system, a trace of it added to the diagonal so that there is one."""
    n, ridge = len(values), 1e-9 * sum(row[i] for i, row in enumerate(matrix)) + 1e-12
    rows = [[*(x + ridge * (i == k) for k, x in enumerate(row)), values[i]] for i, row in enumerate(matrix)]
    for i in range(n):
        for k in range(n):
            if k != i:
                part = rows[k][i] / rows[i][i]
                rows[k] = [x - part * y for x, y in zip(rows[k], rows[i], strict=True)]
    return [row[-1] / row[i] for i, row in enumerate(rows)]


@dataclass
class Fit:
    """rates: DOMAINS (posteriors) and rate of each group. errors: what is left of each target, in proportion to it."""

    rates: DataFrame
    errors: dict[str, float]
    steps: int


def fit_rates(scored: DataFrame, weights: dict[str, float], total_tokens: float | None = None, iterations: int = 200, tolerance: float = 1e-4) -> Fit:
    """Rates by posteriors (_low, _ordinary, _toxic) of ``scored``, a result of classify.

    weights: target share of each domain. total_tokens: the sum of targets; unset, so many that the ordinary domain stays as large as it is.
    """
    keys = [f"_{d}" for d in DOMAINS]
    groups = scored.groupBy(*keys).agg(F.coalesce(F.sum("_tokens"), F.lit(0)).cast("double").alias("_mass"))
    groups = groups.withColumns({"_p": F.struct(*(_posterior(d).alias(d) for d in DOMAINS)), "rate": F.lit(1.0)})
    held = materialise(groups.coalesce(1), "mix-groups")  # a row for each combination of bins, some 400 at most
    part = {d: F.col(f"_p.{d}") for d in DOMAINS}
    mass = F.col("_mass")
    first = held.agg(*(F.sum(mass * part[d]).alias(d) for d in DOMAINS), *(F.sum(mass * part[d] * part[d]).alias(f"{d}-own") for d in DOMAINS)).first()
    domains = [d for d in DOMAINS if first[d] and weights.get(d, 0) > 0]
    if not domains:
        return Fit(held.select(*keys, "rate"), {}, 0)
    share = {d: weights[d] / sum(weights[x] for x in domains) for d in domains}
    lead = "ordinary" if "ordinary" in domains else max(domains, key=lambda d: first[d])
    total = total_tokens or first[lead] / share[lead]
    target = {d: total * share[d] for d in domains}
    own = {d: max(first[f"{d}-own"], 1e-12) for d in domains}
    pairs = [(a, b) for a in domains for b in domains]
    best, part_of_step, plain, stale = (math.inf, {}, held, [], []), 1.0, False, 0
    for step in range(iterations + 1):
        moving = mass * (F.col("rate") > 0).cast("double")
        sums = held.agg(*(F.sum(mass * F.col("rate") * part[d]) for d in domains), *(F.sum(moving * part[a] * part[b]) for a, b in pairs)).first()
        n = len(domains)
        error = [x - target[d] for x, d in zip(sums[:n], domains, strict=True)]
        size = sum(e**2 / own[d] for e, d in zip(error, domains, strict=True))
        stale = 0 if size < best[0] * (1 - 1e-3) else stale + 1
        if size < best[0]:
            curvature = [list(sums[n * (i + 1) : n * (i + 2)]) for i in range(n)]
            best = size, {d: e / target[d] for d, e in zip(domains, error, strict=True)}, held, error, curvature
            part_of_step, plain = min(1.0, 2 * part_of_step), False
        else:  # the step is taken back for a shorter one, in the end for a plain one
            part_of_step /= 4
            if part_of_step < 0.05:
                part_of_step, plain = 1.0, True
        _, left, held, error, curvature = best
        if all(abs(e) <= tolerance for e in left.values()) or stale > 12 or step == iterations:
            break
        direction = [e / own[d] / n for e, d in zip(error, domains, strict=True)] if plain else [x * part_of_step for x in _solve(curvature, error)]
        gradient = sum((part[d] * x for d, x in zip(domains, direction, strict=True)), F.lit(0.0))
        new = F.greatest(F.lit(0.0), F.col("rate") - gradient)
        held = materialise(held.select(*keys, "_mass", "_p", new.alias("rate")).coalesce(1), "mix-groups")
    if any(abs(e) > tolerance for e in left.values()):
        warnings.warn(f"rates miss their targets by these shares after {step} steps: " + ", ".join(f"{d} {e:+.2%}" for d, e in left.items()), stacklevel=2)
    return Fit(held.select(*keys, "rate"), left, step)


def _rated(docs: DataFrame, labels: DataFrame, weights: dict[str, float], total_tokens: float | None, fit: dict, kept: list[str] | None = None) -> DataFrame:
    """_row, _tokens, DOMAINS, rate and copies of each row of ``docs``: those of its cell, a row of a small table."""
    rows, cells = _classified(docs, labels, kept=kept, **fit)
    rates = fit_rates(cells, weights, total_tokens).rates.select(*(F.col(f"_{d}").alias(f"_r_{d}") for d in DOMAINS), F.round("rate", 6).alias("rate"))
    same = [F.col(f"_{d}") == F.col(f"_r_{d}") for d in DOMAINS]
    rated = materialise(cells.drop("_tokens").join(F.broadcast(rates), same).select("_cell", *(f"_{d}" for d in DOMAINS), "rate").coalesce(1), "mix-rates")  # 400 rows at most
    return rows.join(F.broadcast(rated), "_cell").withColumn("copies", _copies(F.col("rate"), F.col("_row.doc_id")))


def mixing_rates(docs: DataFrame, labels: DataFrame, weights: dict[str, float], total_tokens: float | None = None, **fit: int) -> DataFrame:
    """doc_id, n_tokens, p_low, p_ordinary, p_toxic, rate, copies of each row of ``docs``.

    copies: the rate rounded down or up by the hash of the id, so that its expectation is the rate.
    """
    found = _rated(docs.select("doc_id", "text"), labels, weights, total_tokens, fit, ["doc_id"])
    return found.select("_row.doc_id", F.col("_tokens").alias("n_tokens"), *(F.round(_posterior(d), 6).alias(f"p_{d}") for d in DOMAINS), "rate", "copies")


def _copies(rate: Column, doc_id: Column) -> Column:
    return F.floor(rate + F.pmod(F.xxhash64(doc_id), F.lit(1_000_000)) / 1_000_000).cast("int")


def mixed(docs: DataFrame, labels: DataFrame, weights: dict[str, float], **fit: int) -> DataFrame:
    """The rows of ``docs``, each as often as its rate says, with all their columns."""
    found = _rated(docs, labels, weights, None, fit).where("copies > 0")
    return found.select("_row", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("_row.*")
