"""URL filters against plain Python rules and PageRank."""

import re
from collections import Counter

import duckdb
from tenantscope.llm.url_filters import (DAMPING, ITERATIONS, ORACLE, RULES, THRESHOLD, host_links, judge_urls, op4_url_filters)


def lower(s):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in s)


def split(url):
    if url is None or "://" not in url:
        return "", ""
    m = re.match(r"([^/?#]*)([^?#]*)", url.split("://", 1)[1], re.S)
    return lower(m[1]), m[2]


def brute(pages):
    judged, links = [], set()
    for i, url, html in pages:
        host, path = split(url)
        fits = [(len(h) + len(p), h + p, v) for v, h, p in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        judged.append((i, host, path, *(max(fits)[1:] if fits else (None, None))))
        for u in re.findall(r"""(?i)\s(?:href|src)\s*=\s*["']?\s*((?:https?:)?//[^\s"'<>]+)""", html or ""):
            to = split(u if "://" in u else "x:" + u)[0]
            if url is not None and host and to and to != host:
                links.add((host, to))
    rank = {}
    for kind, verdict, flow in (("trust", "allow", links), ("distrust", "block", {(b, a) for a, b in links})):
        n = Counter(j[1] for j in judged if j[4] == verdict and j[1])
        seed = {h: c / sum(n.values()) for h, c in n.items()}
        out = Counter(a for a, _ in flow)
        r = dict(seed)
        for _ in range(ITERATIONS):
            new = {h: (1 - DAMPING) * s for h, s in seed.items()}
            for a, b in flow:
                if a in r:
                    new[b] = new.get(b, 0) + DAMPING * r[a] / out[a]
            r = new
        rank[kind] = r
    rows = []
    for i, host, path, rule, verdict in judged:
        t, d = (rank[k].get(host, 0) for k in ("trust", "distrust"))
        own = "block" if t + d > 0 and d / (t + d) >= THRESHOLD else "allow"
        rows.append((i, host, path, rule, verdict or own))
    return sorted(rows, key=repr)


PAGES = [
    (1, "http://a.example.org/es/x", '<a href="http://Bad.example.com/de/1">'), (2, "https://EXAMPLE.ORG/en/12?q#f", None),
    (3, "http://example.org/en/2", ""), (4, "http://bad.example.com/de/9", '<a href="//net.example.net/x"> <img src=http://c.com/fr/>'),
    (5, "http://bad.example.com/en/9", '<a HREF = \'https://farm.net/\'>'), (6, "http://farm.net/a", '<a href="http://bad.example.com/de/1">'),
    (7, "http://farm.net?x", None), (8, "http://good.net/", None), (9, "http://c.com/fr/", '<a href="http://good.net">'),
    (10, None, '<a href="http://good.net">'), (11, "no scheme", None), (12, "://x.org/", None), (13, "a://b://c.org/", None),
    (14, "http://notexample.org/es/", None), (15, "http://org/", None), (16, "http://xorg/", None), (17, "http://com/de", None),
    (None, "http://com/de/", None), (3, "http://example.org/en/2", ""), (18, "http://ÄB.Org/É\nb", "<a href='http://ÄB.org/'>"),
    (19, "http://deep.farm.net/x", '<a href="http://farm.net/">'), (20, "", None)]


def test_matches_brute_force(spark):
    pages = spark.createDataFrame([(*p, "clash") for p in PAGES], "page_id long, url string, html string, host string")
    want = brute(PAGES)
    assert sorted((tuple(r) for r in op4_url_filters(pages).collect()), key=repr) == want
    verdict = {r[0]: r[4] for r in want}
    assert verdict[6] == "block" and verdict[8] == "allow" and verdict[5] == "block"
    assert host_links(pages).count() == 7


def test_distrust_reaches_the_end_of_a_long_chain(spark):
    n = 23
    rows = [(i, f"http://h{i}.net/", f'<a href="http://h{i + 1}.net/">' if i < n else '<a href="http://x.com/">') for i in range(n + 1)]
    rows += [(100, "http://x.com/de/1", None), (101, "http://far.net/", None)]
    got = {r.page_id: (r.verdict, r.distrust) for r in judge_urls(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {i: ("block", 1.0) for i in range(n + 1)} | {100: ("block", 1.0), 101: ("allow", None)}


def test_shares_are_those_of_settled_ranks(spark):
    links = {("a.net", "b.net"), ("b.net", "a.net"), ("b.net", "bad.com"), ("good.org", "a.net")}
    rows = [(i, f"http://{a}/", f'<a href="http://{b}/">') for i, (a, b) in enumerate(sorted(links))] + [(9, "http://bad.com/de/", None)]
    rank = {}
    for kind, seed, flow in (("t", "good.org", links), ("d", "bad.com", {(b, a) for a, b in links})):
        out, r = Counter(a for a, _ in flow), {seed: 1.0}
        for _ in range(400):
            new = {seed: 1 - DAMPING}
            for a, b in flow:
                if a in r:
                    new[b] = new.get(b, 0) + DAMPING * r[a] / out[a]
            r = new
        rank[kind] = r
    for r in judge_urls(spark.createDataFrame(rows, "page_id long, url string, html string")).collect():
        t, d = (rank[k].get(r.host, 0) for k in "td")
        assert abs(r.distrust - d / (t + d)) < 1e-5


def test_sql_and_sf(spark, sf_dir):
    p = spark.read.parquet(f"{sf_dir}/pages.parquet")
    got = sorted((tuple(r) for r in op4_url_filters(p).collect()), key=repr)
    assert got == brute([(r.page_id, r.url, r.html) for r in p.collect()])
    con = duckdb.connect()
    for rows in (None, PAGES):
        if rows is None:
            con.execute(f"create view pages as select * from read_parquet('{sf_dir}/pages.parquet/*.parquet')" if __import__("os").path.isdir(f"{sf_dir}/pages.parquet")
                        else f"create view pages as select * from read_parquet('{sf_dir}/pages.parquet')")
        else:
            con.execute("drop view pages")
            con.execute("create table pages (page_id bigint, url varchar, html varchar)")
            con.executemany("insert into pages values (?, ?, ?)", rows)
        want = got if rows is None else brute(PAGES)
        assert sorted((tuple(r) for r in con.execute(ORACLE).fetchall()), key=repr) == want


def test_no_python_in_the_plan_and_empty(spark, sf_dir):
    p = spark.read.parquet(f"{sf_dir}/pages.parquet")
    assert not re.search("Python|Pandas|Arrow", judge_urls(p)._jdf.queryExecution().executedPlan().toString())
    assert not op4_url_filters(p.limit(0)).collect()
