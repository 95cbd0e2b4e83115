"""URL filters: host and path rules, and trust and distrust propagated over links between hosts.

Personalised PageRank starts from hosts in proportion to the share of their pages that a rule allows, and follows links;
distrust starts from hosts with blocked pages and follows links backwards, to those that link to them. A host without a
rule for a page is blocked when the distrust that reaches it over links is above its trust, both with seeds that add up to
1, and above a threshold of LEAST_DISTRUST of what a host with blocked pages only starts from. Both are carried on until they no longer change; the SQL of the query stops after ROUNDS rounds, so it can differ for hosts farther off.

Defined cases: a null url, or one without ://, has an empty host and path, fits no rule and is allowed. A null html has no
links. Repeated rows are judged alike; each counts as a page of its host. An empty table gives an empty result. Links of
a host to itself do not count. Extra columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from varsparq.llm.shared import materialise

#: The rules of the query.
RULES = [("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow")]
DAMPING, ROUNDS, LEAST_DISTRUST = 0.85, 15, 1e-6
#: Rounds end when no host's rank can change any more by this part of LEAST_DISTRUST; more rounds than the bound are an error.
CLOSE, MOST_ROUNDS = 0.01, 400
_LINK = r"""(?i)<a\s[^>]*?href\s*=\s*["']?([^"'\s>]+)"""


def _ascii_lower(c: Column) -> Column:
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(c, upper, upper.lower())


def url_host(url: Column) -> Column:
    """What stands after the first :// up to / ? # or the end, A-Z lower-cased; empty without ://."""
    return _ascii_lower(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def url_path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def fitting_rule(host: Column, path: Column, rules: list[tuple[str, str]]) -> Column:
    """The longest rule that fits, or null."""
    out = F.lit(None).cast("string")
    for rule, _ in sorted(rules, key=lambda r: (len(r[0]), r[0])):
        at = rule.index("/")
        name, start = rule[:at], rule[at:]
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(start)
        out = F.when(fits, F.lit(rule)).otherwise(out)
    return out


def _ranks(links: DataFrame, seeds: DataFrame, rounds: int, close: float) -> DataFrame:
    """host, got: what reaches each host over weighted links (src, dst, share) from seeds (host, seed).

    At least ``rounds`` rounds, and then until no host can change by ``close`` in all that would follow: the change of any
    host over all later rounds is at most the sum of the changes of the last one by DAMPING / (1 - DAMPING).
    """
    rank = seeds.select("host", F.col("seed").alias("rank"))
    got = None
    for k in range(max(rounds, MOST_ROUNDS)):
        new = rank.join(links, F.col("host") == F.col("src")).groupBy(F.col("dst").alias("host")).agg((DAMPING * F.sum(F.col("rank") * F.col("share"))).alias("got"))
        new = materialise(new, "ranks")
        if k + 1 >= rounds:
            if got is None:
                got = new.where("false")
            last = got.select("host", F.col("got").alias("last"))
            gap = F.abs(F.coalesce("got", F.lit(0.0)) - F.coalesce("last", F.lit(0.0)))
            change = new.join(last, "host", "full").agg(F.sum(gap)).first()[0] or 0.0
            if change * DAMPING / (1 - DAMPING) < close:
                return new
        got = new
        own = seeds.select("host", ((1 - DAMPING) * F.col("seed")).alias("rank"))
        rank = own.unionByName(got.select("host", F.col("got").alias("rank"))).groupBy("host").agg(F.sum("rank").alias("rank"))
    raise ValueError(f"ranks of hosts still change after {max(rounds, MOST_ROUNDS)} rounds")


def blocked_hosts(pages: DataFrame, rounds: int = ROUNDS, least: float = LEAST_DISTRUST) -> DataFrame:
    """host, trust, distrust of hosts to block; ``pages`` has host, verdict (of a rule or null) and html."""
    hosts = pages.groupBy("host").agg(F.count("*").alias("n"), F.count_if(F.col("verdict") == "allow").alias("allowed"), F.count_if(F.col("verdict") == "block").alias("blocked"))
    hosts = materialise(hosts, "hosts")
    to = F.explode(F.array_distinct(F.regexp_extract_all("html", F.lit(_LINK), F.lit(1))))
    found = pages.where("html like '%//%'").select(F.col("host").alias("src"), to.alias("url"))
    edges = found.select("src", url_host(F.regexp_replace("url", "^//", "http://")).alias("dst")).where("src <> '' and dst <> '' and src <> dst")
    edges = materialise(edges.groupBy("src", "dst").agg(F.count("*").alias("n")), "edges")

    def shares(a: str, b: str) -> DataFrame:
        sums = edges.groupBy(a).agg(F.sum("n").alias("all"))
        return materialise(edges.join(sums, a).select(F.col(a).alias("src"), F.col(b).alias("dst"), (F.col("n") / F.col("all")).alias("share")), "shares")

    def seeds(part: str) -> DataFrame:
        return hosts.where(f"{part} > 0 and host <> ''").select("host", (F.col(part) / F.col("n")).alias("seed"))

    if edges.isEmpty():  # nothing to follow
        return hosts.where("false").select("host", F.lit(0.0).alias("trust"), F.lit(0.0).alias("distrust"))
    sums = hosts.where("host <> ''").agg(*(F.sum(F.col(c) / F.col("n")).alias(c) for c in ("allowed", "blocked"))).first()  # two numbers
    trust = _ranks(shares("src", "dst"), seeds("allowed"), rounds, CLOSE * least).select("host", (F.col("got") / (sums.allowed or 1.0)).alias("trust"))
    distrust = _ranks(shares("dst", "src"), seeds("blocked"), rounds, CLOSE * least).select("host", F.col("got").alias("_got"), (F.col("got") / (sums.blocked or 1.0)).alias("distrust"))
    both = distrust.join(trust, "host", "left").select("host", F.coalesce("trust", F.lit(0.0)).alias("trust"), "distrust", "_got")
    return both.where((F.col("distrust") > F.col("trust")) & (F.col("_got") > least)).drop("_got")


def url_filter(pages: DataFrame, rules: list[tuple[str, str]] = RULES, rounds: int = ROUNDS) -> DataFrame:
    """page_id, host, path, rule, verdict of each row of ``pages`` (page_id, url, html)."""
    judged = pages.select("page_id", "html", url_host(F.col("url")).alias("host"), url_path(F.col("url")).alias("path"))
    judged = judged.withColumn("rule", fitting_rule(F.col("host"), F.col("path"), rules))
    told = F.lit(None).cast("string")
    for rule, verdict in rules:
        told = F.when(F.col("rule") == rule, verdict).otherwise(told)
    judged = judged.withColumn("verdict", told)
    bad = blocked_hosts(judged, rounds).select("host", F.lit(True).alias("bad"))
    method = F.when(F.col("bad"), "block").otherwise("allow")
    return judged.drop("html").join(bad, "host", "left").select("page_id", "host", "path", "rule", F.coalesce("verdict", method).alias("verdict"))
