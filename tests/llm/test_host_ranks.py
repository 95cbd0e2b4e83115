"""Trust and distrust of hosts against a dense matrix."""

from __future__ import annotations

import random

import numpy as np

from varsparq.llm import urlfilter


def test_ranks_are_those_of_the_matrix(spark):
    draw = random.Random(11)
    hosts = [f"h{k}.info" for k in range(24)] + [f"bad{k}.net" for k in range(3)] + [f"good{k}.org" for k in range(2)]
    pages, links = [], np.zeros((len(hosts), len(hosts)))
    for k, h in enumerate(hosts):
        for page in range(draw.randint(1, 3)):
            to = draw.sample(range(len(hosts)), draw.randint(0, 4))
            for t in to:
                links[k, t] += t != k
            path = "/fr/x" if "good" in h and page == 0 else "/x"
            pages.append((len(pages), f"http://{h}{path}{page}", " ".join(f'<a href="https://{hosts[t]}/{page}">x</a>' for t in to)))
    judged = urlfilter.url_filter(spark.createDataFrame(pages, "page_id long, url string, html string").repartition(3)).collect()
    n = np.zeros(len(hosts))
    seed = {"allow": n.copy(), "block": n.copy()}
    for r in judged:
        k = hosts.index(r.host)
        n[k] += 1
        if r.rule:
            seed[r.verdict][k] += 1
    got = {}
    for name, m in (("allow", links), ("block", links.T)):
        share = m / np.maximum(m.sum(1, keepdims=True), 1)
        s = seed[name] / n
        rank = np.linalg.solve(np.eye(len(hosts)) - urlfilter.DAMPING * share.T, (1 - urlfilter.DAMPING) * s)  # where rounds end up
        reached = urlfilter.DAMPING * share.T @ rank
        got[name] = reached / s.sum(), reached
    bad = {h for k, h in enumerate(hosts) if got["block"][0][k] > got["allow"][0][k] and got["block"][1][k] > urlfilter.LEAST_DISTRUST}
    assert 3 < len(bad) < len(hosts)
    assert all(r.verdict == ("block" if r.host in bad else "allow") for r in judged if r.rule is None)
    found = urlfilter.blocked_hosts(spark.createDataFrame([(r.host, r.verdict if r.rule else None, p[2]) for r, p in zip(sorted(judged, key=lambda r: r.page_id), pages, strict=True)], "host string, verdict string, html string"))
    for r in found.collect():
        k = hosts.index(r.host)
        assert abs(r.trust - got["allow"][0][k]) < 1e-7 and abs(r.distrust - got["block"][0][k]) < 1e-7
