import random
import re
from html import unescape
from urllib.parse import urljoin, urlsplit

import duckdb
import pytest
from pyspark.sql import functions as F

from coinsight.llm import urls


@pytest.fixture(scope="module")
def got(spark):
    link = '<link href="{}" rel="canonical">'
    pages = [
        (1, "https://A.example.org/es/x?q#f", ""),
        (2, "http://b.net/p", link.format("https://a.example.org/es/x?q")),
        (3, "http://b.net/p/#top", None),
        (4, "http://c.net/q", "<META content='0; url=http://b.net/p' http-equiv=refresh>"),
        (5, "http://d.org/z", link.format("http://c.net/q")),
        (6, "http://plain.net/", ""),
        (7, None, "x"),
        (8, "no scheme", "x"),
        (9, "http://m.com/fr/1", ""),
        (10, "ftp://x.com/de/1", ""),
        (11, "http://example.org/en/17", ""),
        (12, "http://notexample.org/en/17", ""),
        (13, "http://e.net/only", link.format("/moved")),
        (14, "https://www.e.net/moved/", link.format("http://host.com/de/7")),
        (6, "http://plain.net/", ""),
        (15, "http://org/", ""),
    ]
    frame = spark.createDataFrame([(*p, 1) for p in pages], "page_id long, url string, html string, verdict long")
    return sorted(urls.judge(frame).collect(), key=lambda r: r.page_id)


def test_parts_and_rules(got):
    of = {r.page_id: r for r in got}
    assert (of[1].host, of[1].path, of[1].rule, of[1].verdict) == ("a.example.org", "/es/x", "example.org/es/", "block")
    assert (of[7].host, of[7].path, of[7].rule, of[7].verdict) == ("", "", None, "allow")
    assert (of[8].host, of[8].path, of[8].verdict) == ("", "", "allow")
    assert [of[k].verdict for k in (9, 10, 11, 12)] == ["allow", "block", "block", "allow"]
    assert of[11].rule == "example.org/en/1" and of[12].rule == "org/"


def test_blocks_reach_aliases_and_allows_stay(got):
    of = {r.page_id: (r.verdict, r.reason) for r in got}
    assert of[2] == of[3] == of[4] == of[13] == of[14] == ("block", "alias")
    assert of[5] == ("allow", "rule") and of[6] == ("allow", "default")
    assert len(got) == 16


def test_empty(spark):
    empty = spark.createDataFrame([], "page_id long, url string, html string")
    assert urls.judge(empty).count() == 0


BASE = "http://h.net/a/b/page.html?q=1"


@pytest.mark.parametrize(
    ("target", "want"),
    [
        ("http://x.net/y", "http://x.net/y"),
        ("//x.net/y", "http://x.net/y"),
        ("/y", "http://h.net/y"),
        ("y.html", "http://h.net/a/b/y.html"),
        ("./y.html#z", "http://h.net/a/b/y.html#z"),
        ("../y?k=../v", "http://h.net/a/y?k=../v"),
        ("../../../y", "http://h.net/y"),
        ("..", "http://h.net/a/"),
        ("?id=2", "http://h.net/a/b/page.html?id=2"),
        ("mailto:me", None),
    ],
)
def test_relative_targets(spark, target, want):
    row = spark.createDataFrame([(target, BASE)], "t string, b string")
    assert row.select(urls.resolved(F.col("t"), F.col("b"))).first()[0] == want
    assert duckdb.execute(f"SELECT {urls._sql_resolved('t', 'b')} FROM (SELECT ? AS t, ? AS b)", [target, BASE]).fetchone()[0] == want


def random_pages(seed):
    rnd, n = random.Random(seed), 120
    host = lambda k: rnd.choice(["h{}.net", "www.h{}.net", "H{}.net"]).format(k)
    pages = []
    for k in range(n):
        url = f"http://{host(k)}/p{k}/x"
        targets = [rnd.choice([f"https://h{j}.net/p{j}/x#f", f"http://h{j}.net/p{j}/x/", f"//www.h{j}.net/p{j}/./y/../x"]) for j in rnd.sample(range(n), rnd.choice([0, 0, 1, 1, 2]))]
        if rnd.random() < 0.1:
            targets.append(f"http://host.com/de/{k}")
        if rnd.random() < 0.1:
            targets.append(f"http://good.com/fr/{k}")
        html = "".join(rnd.choice(["<link rel='alternate' href='http://no.com/de/1'><LINK href='{}' rel=canonical>", '<meta content="5;URL={}" http-equiv="refresh">', "<link rel='x canonical' href={}>"]).format(t.replace("&", "&amp;")) for t in targets)
        pages.append((k, url, html))
    pages += [(n, "http://h500.net/dir/page", "<base href='http://host.com/de/'><link rel=canonical href='a?x=1&amp;y=2'>"), (n + 1, "http://h501.net/", "<link rel=canonical href='http:&#x2f;&#47;h500.net/dir/page'>"), (n + 2, None, "<link rel=canonical href='http://host.com/de/1'>"), (n + 3, "http://h600.net/ü", None)]
    return pages


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_random_graphs_match_union_find_and_sql(spark, seed):
    pages = random_pages(seed)
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    def key(u):
        scheme, _, rest = u.partition("://")
        rest = rest.partition("#")[0]
        host, slash, path = rest.partition("/")
        return (host.lower().removeprefix("www."), (slash + path).partition("?")[0].rstrip("/"), path.partition("?")[2])

    bad = set()
    for _, url, html in pages:
        if url is None or html is None:
            continue
        based = re.search(r"<base href='([^']*)", html)
        for tag in re.findall(r"<(?:link|meta)\s[^>]*>", html, re.I):
            if "alternate" in tag:
                continue
            t = re.search(r"(?:href|url)=['\"]?([^'\">]+)", tag, re.I)[1]
            t = urljoin(based[1] if based else url, unescape(t))
            parent[root(key(url))] = root(key(t))
            if urlsplit(t).path.startswith("/de/") and urlsplit(t).hostname.endswith("com"):
                bad.add(key(t))
    blocked = {root(k) for k in bad}
    want = {i: "block" if u and root(key(u)) in blocked else "allow" for i, u, _ in pages}
    frame = spark.createDataFrame(pages, "page_id long, url string, html string")
    got = sorted(map(tuple, urls.judge(frame).collect()))
    assert {r[0]: r[4] for r in got} == want and "alias" in {r[5] for r in got}
    db = duckdb.connect()
    db.execute("CREATE TABLE pages(page_id BIGINT, url VARCHAR, html VARCHAR)")
    db.executemany("INSERT INTO pages VALUES (?, ?, ?)", pages)
    assert sorted(db.execute(urls.SQL).fetchall()) == got
