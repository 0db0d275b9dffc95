from __future__ import annotations

from laminar.llm.queries import op5_url_reputation, oracle_sql
from laminar.llm.url_reputation import RULES, host_reputation, judge_urls, split_url


def brute_split(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    k = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:k])
    tail = rest[k:]
    m = min([tail.find(c) for c in "?#" if c in tail], default=len(tail))
    return host, tail[:m]


def brute_rule(host, path):
    fit = [(len(h + p), kind, h + p) for kind, h, p in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fit)[1:] if fit else (None, None)


URLS = ["http://A.Example.ORG/es/1?x#y", "https://example.org/en/12", "https://example.org/en/2", "http://notexample.com/de/", "com/fr/", None, "", "x://", "x://com/fr/", "x://COM/de/?q", "a://b://c/d", "http://h?x=/p", "http://h#/p", "http://É.com/fr/", "x://y\n.com/de/z\nw"]


def test_query_equals_sql(spark):
    import duckdb

    sf = "/root/testdata/sf0.01"
    con = duckdb.connect()
    for t in ("pages", "labels"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    want = sorted(con.sql(oracle_sql()["op5_url_reputation"]).fetchall(), key=str)
    got = sorted(map(tuple, op5_url_reputation(spark, sf).collect()), key=str)
    assert got == want


def test_parsing_and_rules(spark):
    rows = [(k, u) for k, u in enumerate(URLS)]
    pages = spark.createDataFrame([(k, u, "e", "m") for k, u in rows], "page_id long, url string, host string, mean string")
    none = spark.createDataFrame([], "page_id long, bad int")
    got = {r["page_id"]: r for r in judge_urls(pages, none).collect()}
    assert len(got) == len(rows)
    for k, u in rows:
        host, path = brute_split(u)
        kind, name = brute_rule(host, path)
        assert (got[k]["host"], got[k]["path"], got[k]["rule"]) == (host, path, name), u
        assert got[k]["verdict"] == (kind or "allow" if kind or got[k]["bad_low"] <= 0.5 else "block")


def test_bad_hosts_are_blocked_and_priors_shrink(spark):
    rows, bad = [], []
    for host, n, share in (("good.a.net", 60, 0.05), ("evil.b.net", 60, 0.95), ("few.b.net", 1, 1.0), ("none.a.net", 2, 0.0)):
        for i in range(n):
            rows.append((len(rows), f"http://{host}/{i}"))
            if host != "none.a.net":
                bad.append((len(rows) - 1, int(i < share * n)))
    pages = spark.createDataFrame(rows + [(rows[0][0], rows[0][1]), (None, "http://evil.b.net/")], "page_id long, url string")
    outcomes = spark.createDataFrame([*bad, (None, 1), (3, None), (99999, 1)], "page_id long, bad int")
    got = judge_urls(pages, outcomes).collect()
    assert len(got) == len(rows) + 2
    verdict = {r["host"]: r["verdict"] for r in got}
    assert verdict["evil.b.net"] == "block" and verdict["good.a.net"] == "allow"
    means = {r["host"]: r["mean"] for r in host_reputation(split_url(pages).select("page_id", "host"), outcomes.where("page_id IS NOT NULL AND bad IS NOT NULL")).collect()}
    assert means["good.a.net"] < means["none.a.net"] < means["few.b.net"] < 1
    assert judge_urls(pages.limit(0), outcomes).count() == 0
