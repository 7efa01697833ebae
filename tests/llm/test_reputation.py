"""Posterior rates of hosts against numpy, and pages that the method itself blocks at each level."""

import numpy as np
import pytest

from quire.llm import host_reputation as R

#: Labelled pages of each host and how many are bad; what is known of a host, of its domain alone, of its suffix alone.
HOSTS = {f"h{k}.good{k % 4}.com": (30, k % 3) for k in range(16)} | {"bad.good0.com": (40, 38), "few.good1.com": (1, 1)}
HOSTS |= {f"h{k}.evil.edu": (12, 12) for k in range(6)} | {f"h{k}.fine.edu": (20, 0) for k in range(6)}
HOSTS |= {f"www.spam{k}.xyz": (9, 9 - (k == 0)) for k in range(12)}
UNSEEN = {"new.good2.com": "allow", "new.fine.edu": "allow", "new.evil.edu": "block", "www.fresh.xyz": "block", "bad.good0.com": "block", "few.good1.com": "block", "h0.good0.com": "allow", "h1.evil.edu": "block", "else.dev": "allow"}


def moments(groups, rate):
    n, bad = np.array([g[0] for g in groups if g[0]], float), np.array([g[1] for g in groups if g[0]], float)
    if len(n) < 2 or not 0 < rate < 1:
        return 100.0
    spread = (n * (bad / n - rate) ** 2).sum()
    spare = n.sum() - (n**2).sum() / n.sum() - (len(n) - 1)
    rho = (spread / (rate * (1 - rate)) - (len(n) - 1)) / spare if spare > 0 else 0.0
    return 1 / min(max(rho, 0.001), 0.9) - 1


def posterior(hosts):
    """Mean and lower bound of each host by plain sums."""
    domain = lambda h: ".".join(h.split(".")[-2:])
    suffix = lambda h: h.split(".")[-1]
    sums = [{}, {}]
    for level, of in enumerate((domain, suffix)):
        for h, (n, bad) in hosts.items():
            a, b = sums[level].get(of(h), (0, 0))
            sums[level][of(h)] = a + n, b + bad
    total = np.sum(list(hosts.values()), axis=0)
    rate = total[1] / total[0]
    k_host, k_domain, k_suffix = (moments(list(x.values()), rate) for x in (hosts, *sums))
    out = {}
    for h, (n, bad) in hosts.items():
        (sn, sb), (dn, db) = sums[1][suffix(h)], sums[0][domain(h)]
        of_suffix = (sb + k_suffix * rate) / (sn + k_suffix)
        of_domain = (db + k_domain * of_suffix) / (dn + k_domain)
        mean = (bad + k_host * of_domain) / (n + k_host)
        out[h] = mean, mean - R.DEVIATIONS * np.sqrt(mean * (1 - mean) / (n + k_host + 1))
    return out


def test_posterior_equals_numpy(spark):
    every = HOSTS | {h: (0, 0) for h in UNSEEN if h not in HOSTS}
    rows = spark.createDataFrame([(h, n, bad) for h, (n, bad) in every.items()], "host string, n long, bad long")
    got = {r.host: (r["mean"], r["lower"]) for r in R.reputation(rows).collect()}
    want = posterior(every)
    assert set(got) == set(want)
    for h in want:
        assert got[h] == pytest.approx(want[h], abs=1e-6), h
    # Shrinkage: hosts differ much here, so that one bad page tells a lot, if less than many do.
    assert want["few.good1.com"][1] < want["bad.good0.com"][1]
    assert want["new.good2.com"][1] < R.LIMIT < min(want[h][1] for h in ("few.good1.com", "new.evil.edu", "www.fresh.xyz"))


def test_alike_hosts_are_shrunk_together(spark):
    """Where hosts hardly differ, a bad page of one of them is chance, and the prior is strong."""
    rows = {f"h{k}.d{k % 5}.com": (20, 1 + k % 2) for k in range(60)} | {"few.d1.com": (1, 1)}
    found = R.reputation(spark.createDataFrame([(h, n, bad) for h, (n, bad) in rows.items()], "host string, n long, bad long"))
    got = {r.host: r.lower for r in found.collect()}
    assert got["few.d1.com"] == pytest.approx(posterior(rows)["few.d1.com"][1], abs=1e-6)
    assert max(got.values()) < R.LIMIT


def test_pages_are_blocked_at_each_level(spark):
    pages, outcomes = [], []
    for h, (n, bad) in HOSTS.items():
        for k in range(n):
            outcomes.append((len(pages), int(k < bad)))
            pages.append((len(pages), f"https://{h}/p{k}"))
    first = len(pages)
    asked = dict(enumerate(UNSEEN, first))
    pages += [(k, f"http://{h}/page?x") for k, h in asked.items()]
    found = R.judge(spark.createDataFrame(pages, "page_id long, url string"), spark.createDataFrame(outcomes, "id long, bad int"))
    got = {r.id: (r.rule, r.verdict) for r in found.collect()}
    assert {h: got[k] for k, h in asked.items()} == {h: (None, verdict) for h, verdict in UNSEEN.items()}
    # A host's labelled pages are judged like its others.
    assert {got[k][1] for k in range(first) if "bad.good0" in pages[k][1]} == {"block"}
    assert {got[k][1] for k in range(first) if "fine.edu" in pages[k][1]} == {"allow"}
