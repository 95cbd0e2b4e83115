"""The operators that SQL can express, in DuckDB's SQL."""

from __future__ import annotations

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_LOWER = _UPPER.lower()

#: Candidates share one of their rarest shingles: of n, a similar set of 80 % holds one of any n - ceil(0.8 n) + 1.
_NEAR = f"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
sets AS (
  SELECT doc_id, list_distinct(CASE WHEN len(w) >= 2 THEN list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])
                                    WHEN len(w) = 1 THEN [w[1]] ELSE []::VARCHAR[] END) AS s FROM words),
shingles AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM sets),
ranked AS (
  SELECT doc_id, x, row_number() OVER (PARTITION BY doc_id ORDER BY df, x) AS r, n
  FROM (SELECT *, count(*) OVER (PARTITION BY x) AS df FROM shingles)),
rare AS (SELECT doc_id, x FROM ranked WHERE r <= n - ceil(0.8 * n) + 1),
pairs AS (SELECT DISTINCT a.doc_id AS u, b.doc_id AS v FROM rare a JOIN rare b ON a.x = b.x AND a.doc_id < b.doc_id),
near AS (
  SELECT u, v FROM (
    SELECT u, v, len(list_intersect(p.s, q.s)) AS k, len(p.s) AS m, len(q.s) AS n
    FROM pairs JOIN sets p ON p.doc_id = u JOIN sets q ON q.doc_id = v) WHERE 100 * k >= 80 * (m + n - k)),
links AS (SELECT u, v FROM near UNION ALL SELECT v, u FROM near),
reach AS (SELECT doc_id AS node, doc_id AS seen FROM documents UNION SELECT reach.node, links.v FROM reach JOIN links ON links.u = reach.seen),
least AS (SELECT node, min(seen) AS component_id FROM reach GROUP BY node)
SELECT doc_id, len(s)::BIGINT AS n_shingles, component_id, doc_id = component_id AS kept FROM sets JOIN least ON node = doc_id
"""


def _url() -> str:
    """Rules by CASE, and both rankings unrolled to the rounds of the operator."""
    from varsparq.llm.urlfilter import DAMPING, LEAST_DISTRUST, ROUNDS, RULES

    def fits(rule: str) -> str:
        name, _, path = rule.partition("/")
        return f"(host = '{name}' OR ends_with(host, '.{name}')) AND starts_with(path, '/{path}')"

    longest = sorted(RULES, key=lambda r: (-len(r[0]), r[0]))
    rule = "CASE " + " ".join(f"WHEN {fits(r)} THEN '{r}'" for r, _ in longest) + " END"
    verdict = "CASE rule " + " ".join(f"WHEN '{r}' THEN '{v}'" for r, v in RULES) + " END"
    host = f"translate(coalesce(regexp_extract({{}}, '(?s)^.*?://([^/?#]*)', 1), ''), '{_UPPER}', '{_LOWER}')"
    parts = [
        f"""parsed AS (SELECT page_id, html, {host.format("url")} AS host, coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages)""",
        f"ruled AS (SELECT *, {rule} AS rule FROM parsed)",
        f"judged AS (SELECT *, {verdict} AS verdict FROM ruled)",
        "hosts AS (SELECT host, count(*) AS n, count(*) FILTER (verdict = 'allow') AS allowed, count(*) FILTER (verdict = 'block') AS blocked FROM judged WHERE host <> '' GROUP BY host)",
        """found AS (SELECT host AS src, unnest(list_distinct(regexp_extract_all(html, '(?i)<a\\s[^>]*?href\\s*=\\s*["'']?([^"''\\s>]+)', 1))) AS url FROM judged)""",
        f"edges AS (SELECT src, dst, count(*) AS n FROM (SELECT src, {host.format("regexp_replace(url, '^//', 'http://')")} AS dst FROM found) WHERE src <> '' AND dst <> '' AND src <> dst GROUP BY ALL)",
    ]
    for name, a, b, seed in (("t", "src", "dst", "allowed"), ("d", "dst", "src", "blocked")):
        parts.append(f"{name}links AS (SELECT {a} AS src, {b} AS dst, n / sum(n) OVER (PARTITION BY {a}) AS share FROM edges)")
        parts.append(f"{name}seeds AS MATERIALIZED (SELECT host, {seed} / n AS seed FROM hosts WHERE {seed} > 0)")
        parts.append(f"{name}rank0 AS (SELECT host, seed AS rank FROM {name}seeds)")
        for k in range(1, ROUNDS + 1):
            parts.append(f"{name}got{k} AS (SELECT dst AS host, {DAMPING} * sum(rank * share) AS got FROM {name}rank{k - 1} JOIN {name}links ON host = src GROUP BY dst)")
            parts.append(f"{name}rank{k} AS (SELECT host, sum(rank) AS rank FROM (SELECT host, {1 - DAMPING} * seed AS rank FROM {name}seeds UNION ALL SELECT host, got FROM {name}got{k}) GROUP BY host)")
    parts.append(f"bad AS (SELECT d.host FROM dgot{ROUNDS} d LEFT JOIN tgot{ROUNDS} t USING (host) WHERE d.got / (SELECT sum(seed) FROM dseeds) > coalesce(t.got / (SELECT sum(seed) FROM tseeds), 0) AND d.got > {LEAST_DISTRUST})")
    return "WITH " + ",\n".join(parts) + "\nSELECT page_id, host, path, rule, coalesce(verdict, CASE WHEN host IN (SELECT host FROM bad) THEN 'block' ELSE 'allow' END) AS verdict FROM judged"


def _vector_codes(parts: int = 4, entries: int = 256, rounds: int = 4, scale: int = 1024) -> str:
    """Rounds unrolled. Squared distances are whole numbers below 2^53, so inner products of doubles are exact."""
    found = [
        f"""kept AS MATERIALIZED (SELECT vec_id, label, list_transform(embedding, lambda x: floor({scale} * x::DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)""",
        f"cut AS MATERIALIZED (SELECT vec_id, p, v[p * (len(v) // {parts}) + 1 : (p + 1) * (len(v) // {parts})] AS x FROM kept, range({parts}) t(p))",
        f"firsts AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS e FROM kept QUALIFY e < {entries})",
        "books0 AS MATERIALIZED (SELECT p, e, x AS b FROM cut JOIN firsts USING (vec_id))",
    ]
    for k in range(rounds + 1):
        distance = "list_inner_product(x, x) - 2 * list_inner_product(x, b) + list_inner_product(b, b)"
        found.append(f"best{k} AS MATERIALIZED (SELECT vec_id, p, min(({distance})::BIGINT * {entries} + e) AS best FROM cut JOIN books{k} USING (p) GROUP BY vec_id, p)")
        if k < rounds:
            found.append(f"cells{k} AS (SELECT p, best % {entries} AS e, unnest(x) AS x, generate_subscripts(x, 1) AS i FROM cut JOIN best{k} USING (vec_id, p))")
            found.append(f"means{k} AS (SELECT p, e, i, floor(sum(x) / count(*)) AS m FROM cells{k} GROUP BY p, e, i)")
            found.append(f"lists{k} AS (SELECT p, e, list(m ORDER BY i) AS b FROM means{k} GROUP BY p, e)")
            found.append(f"books{k + 1} AS MATERIALIZED (SELECT p, e, coalesce(l.b, o.b) AS b FROM books{k} o LEFT JOIN lists{k} l USING (p, e))")
    found.append(f"""codes AS (SELECT vec_id, string_agg(printf('%02x', best % {entries}), '' ORDER BY p) AS code, sum(best // {entries})::BIGINT AS error FROM best{rounds} GROUP BY vec_id)""")
    found.append(f"hashed AS (SELECT sha256(string_agg(array_to_string(list_transform(b, lambda x: x::BIGINT), ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM books{rounds})")
    return "WITH " + ",\n".join(found) + "\nSELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM kept JOIN codes USING (vec_id), hashed"


_DIVERGENCE = f"""
WITH docs AS (SELECT row_number() OVER () AS d, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
  regexp_extract_all(coalesce(text, ''), '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS w FROM documents),
found AS MATERIALIZED (SELECT d, lang, source, translate(unnest(w), '{_UPPER}', '{_LOWER}') AS term FROM docs),
kept AS MATERIALIZED (SELECT lang, term FROM found GROUP BY lang, term HAVING count(DISTINCT d) >= 30),
groups AS (SELECT DISTINCT lang, source FROM docs),
counted AS MATERIALIZED (SELECT lang, source, term, count(*) AS c FROM found JOIN kept USING (lang, term) GROUP BY lang, source, term),
sizes AS (SELECT lang, source, coalesce(n, 0) + 5 * coalesce(v, 0) AS size FROM groups
  LEFT JOIN (SELECT lang, source, sum(c)::BIGINT AS n FROM counted GROUP BY ALL) USING (lang, source)
  LEFT JOIN (SELECT lang, count(*) AS v FROM kept GROUP BY lang) USING (lang)),
shares AS MATERIALIZED (SELECT lang, source, term, coalesce(c, 0) AS c, 1 + (1000000000 * (coalesce(c, 0) + 5)) // size AS p
  FROM sizes JOIN kept USING (lang) LEFT JOIN counted USING (lang, source, term)),
totals AS (SELECT lang, term, sum(c)::BIGINT AS c FROM counted GROUP BY lang, term),
whole AS (SELECT lang, term, 1 + (1000000000 * (c + 5)) // ((sum(c) OVER l)::BIGINT + 5 * (count(*) OVER l)) AS q FROM totals WINDOW l AS (PARTITION BY lang)),
pairs AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p))::BIGINT AS value
  FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
every AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0) AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN pairs p ON p.lang = a.lang AND p.source = a.source AND p.item = b.source
  UNION ALL SELECT lang, source, 'term', term, (p - q)::BIGINT FROM shares JOIN whole USING (lang, term) WHERE c > 0 AND p > q),
ranked AS (SELECT *, (row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item))::INTEGER AS rank FROM every)
SELECT * FROM ranked WHERE part = 'pair' OR rank <= 50
"""

ORACLES: dict[str, str] = {"op2_minhash_near_dedup": _NEAR, "op5_url_filter": _url(), "op11_vector_codes": _vector_codes(), "op13_source_divergence": _DIVERGENCE}
