"""Rules and propagation against plain Python."""

import random

import numpy as np
import pytest

from surety.llm import url_filters as u


def split(url):
    if not url or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    end = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
    tail = rest[end:]
    stop = min([tail.find(c) for c in "?#" if c in tail] or [len(tail)])
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:end])
    return host, tail[:stop]


def rule(host, path, rules=u.RULES):
    fits = [(r, v) for r, v in rules
            if (host == r.split("/", 1)[0] or host.endswith("." + r.split("/", 1)[0])) and path.startswith("/" + r.split("/", 1)[1])]
    return max(fits, key=lambda x: len(x[0])) if fits else (None, None)


URLS = ["http://a.example.com/en/1", "https://WWW.Example.COM/en/x?y=1", "http://example.com", "http://x.net/es/1#t", "http://x.net/de/1", "ftp://x.net/fr/", None, "",
        "no scheme", "http://", "://h.net/es/", "http://b.org/p?u=http://c.com/", "http://É.Com/", "http://notexample.com/en/", "http://y.com.net/es/q", "http://net/es/",
        "http://www.example.com/en/a\nb", "http://h?x", "http://h#x", "http://spam.org/1", "http://friend.org/2"]


def test_hosts_paths_and_rules(spark):
    rows = [(i, url, '<a href="http://x.net/es/">' if url and "spam" in url else None) for i, url in enumerate(URLS)]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    got = {r["page_id"]: r for r in u.judge(df).collect()}
    assert len(got) == len(rows)
    for i, url in enumerate(URLS):
        host, path = split(url)
        name, verdict = rule(host, path)
        assert (got[i]["host"], got[i]["path"], got[i]["rule"]) == (host, path, name), url
        assert got[i]["verdict"] == (verdict or got[i]["verdict"]) and got[i]["verdict"] in ("allow", "block")


def walk(edges, seeds, rounds):
    hosts = sorted({h for e in edges for h in e[:2]})
    at = {h: k for k, h in enumerate(hosts)}
    out = {}
    for back, column in ((0, 0), (1, 1)):
        m = np.zeros((len(hosts), len(hosts)))
        for a, b, n in edges:
            a, b = (b, a) if back else (a, b)
            m[at[b], at[a]] += n
        m /= m.sum(0)
        s = np.array([seeds.get(h, (0, 0))[column] for h in hosts], float)
        s = s / (s.sum() or 1)
        e = np.full(len(hosts), 1 / len(hosts))
        x, v = s, e
        for _ in range(rounds):
            x, v = 0.15 * s + 0.85 * m @ x, 0.15 * e + 0.85 * m @ v
        out[column] = dict(zip(hosts, x / v))
    return {h: (out[0][h], out[1][h]) for h in hosts}


def test_propagation_equals_dense_iteration(spark):
    rng = random.Random(1)
    hosts = [f"h{i}.org" for i in range(12)]
    edges = {(h, h): 1 for h in hosts}
    for _ in range(40):
        edges[rng.choice(hosts), rng.choice(hosts)] = rng.randint(1, 5)
    rows = [(a, b, n) for (a, b), n in edges.items()]
    seeds = {"h0.org": (3, None), "h1.org": (None, 2), "h2.org": (1, 1)}
    got = u.propagate(spark.createDataFrame(rows, "src string, dst string, n bigint"),
                      spark.createDataFrame([(h, *s) for h, s in seeds.items()], "host string, good bigint, bad bigint")).collect()
    want = walk(rows, {h: (s[0] or 0, s[1] or 0) for h, s in seeds.items()}, u.ROUNDS)
    assert len(got) == 12
    for r in got:
        assert (r["trust"], r["distrust"]) == pytest.approx(want[r["host"]], abs=1e-8)


def test_links_carry_distrust(spark):
    rows = [(i, "http://bad.net/es/1", "") for i in range(5)]
    rows += [(10, "http://spam.org/a", '<a href="http://bad.net/es/1">x</a>' * 5), (11, "http://fine.org/a", '<a href="//ok.com/">x</a> <a href=/b>y</a>'),
             (12, "http://ok.com/", "<A HREF='http://fine.org/c'>")]
    df = spark.createDataFrame([(*r, "kept", 1) for r in rows], "page_id bigint, url string, html string, verdict string, _host int")
    got = {r["page_id"]: r for r in u.judge(df).collect()}
    assert got[10]["verdict"] == "block" and got[11]["verdict"] == "allow" and got[11]["trust"] > got[11]["distrust"]
    assert got[10]["_host"] == 1


@pytest.mark.parametrize("rows", [[], [(1, None, None)], [(1, "http://a.org/", "<a href='http://b.org'>"), (1, "http://a.org/", None)]])
def test_tiny_tables(spark, rows):
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    got = u.judge(df).collect()
    assert [r["verdict"] for r in got] == ["allow"] * len(rows)
