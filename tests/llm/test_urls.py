import hashlib

import pytest
from comparing import rows_of
from pyspark.sql import functions as F

from wavemark.llm import urls
from wavemark.llm.queries import op13_url_filters

URLS = [
    "http://a.example.net/en/1?x=/de/", "https://EXAMPLE.net/en/", "https://example.net/en", "http://net/", "http://net", "http://xnet/",
    "http://example.net.org/fr/2#top", "http://www.example.com/de/9.html", "http://example.com/DE/9", "ftp://a..net/x", "http://user@b.example.com:80/de/", "http://b.example.org/fr?x",
    "http://example.com?u=http://x.net/", "no scheme net/", "", None, "://net/x", "http://.net/", "http://net./", "http://é.ÀEXAMPLE.net/en/é\n/ü?", "http://" + "a." * 3000 + "net/" + "p/" * 3000,
]


def parsed(url):
    """Host and path, read character by character."""
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:cut])
    rest = rest[cut:]
    return host, rest[: min([rest.find(c) for c in "?#" if c in rest] or [len(rest)])]


def brute(url, rules):
    host, path = parsed(url)
    fits = [(len(h) + len(p), len(h), v == "block", h + p) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    if not fits:
        return host, path, None, "allow"
    best = max(fits)
    return host, path, best[3], "block" if best[2] else "allow"


@pytest.fixture(scope="module")
def pages(spark):
    rows = [(i, u) for i, u in enumerate(URLS)] + [(0, URLS[7]), (None, URLS[0]), (3, URLS[3])]
    return spark.createDataFrame(rows, "page_id long, url string")


def expected(pages, rules):
    return sorted(((r.page_id is None, r.page_id, *brute(r.url, rules)) for r in pages.collect()), key=str)


def got(rows):
    return sorted(((r.page_id is None, r.page_id, r.host, r.path, r.rule, r.verdict) for r in rows.collect()), key=str)


MANY = [("net", "", "block"), ("net", "/e", "allow"), ("example.net", "/", "block"), ("example.net", "/", "allow"), ("a.example.net", "/en/1", "block"), ("b.example.com:80", "/d", "block"), ("", "/", "block"), ("ample.net", "/", "block"), ("example.net.org", "/fr/22", "block"), ("com", "/de/9.html", "block"), ("www.example.com", "/d", "allow")]


@pytest.mark.parametrize("rules", [urls.RULES, MANY])
@pytest.mark.parametrize(("shapes", "few"), [(4096, 1000), (1, 0)])
def test_equals_brute_force(spark, pages, rules, shapes, few, monkeypatch):
    monkeypatch.setattr(urls, "SHAPES", shapes)
    monkeypatch.setattr(urls, "BROADCAST_RULES", few)
    found = pages if shapes > 1 else pages.filter("length(url) < 200 or url is null")
    assert got(urls.judge(found, urls.rule_table(spark, tuple(rules)))) == expected(found, rules)


def test_query_equals_sql(spark, duck, data):
    rows = op13_url_filters(spark, data)
    assert rows_of(rows.toPandas()) == rows_of(duck.execute(urls.SQL).df())


def test_joins_are_on_short_prefixes_first(spark, pages):
    plan = urls.judge(pages, urls.rule_table(spark))._jdf.queryExecution().toString()
    assert "LeftSemi" in plan and "short" in plan
    digest = hashlib.sha256(b"net/").hexdigest()
    assert spark.range(1).select(urls.short(F.lit(digest))).first()[0] == int(digest[:8], 16)


def test_main_path_runs_no_python(spark, pages):
    plan = urls.judge(pages.select("page_id", F.concat("url", F.lit("")).alias("url")), urls.rule_table(spark))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_rules_with_nulls_and_without_rules(spark, pages):
    rules = spark.sql("SELECT * FROM VALUES ('net', NULL, 'block'), (NULL, '/', 'block'), ('com', '/', NULL) AS t(host, path, verdict)")
    assert {(r.rule, r.verdict) for r in urls.judge(pages, rules).collect()} == {(None, "allow")}
    assert {r.verdict for r in urls.judge(pages, rules, "block").collect()} == {"block"}


def test_empty_table_and_clashing_columns(spark, pages):
    rules = urls.rule_table(spark)
    assert urls.judge(pages.limit(0), rules).count() == 0
    names = ("host", "Path", "rule", "verdict", "blocks", "digest", "short", "ROW", "__host", "expression", "a`b", "c.d")
    odd = pages
    for name in names:
        odd = odd.withColumn(name, F.lit("own"))
    assert got(urls.judge(odd, rules)) == expected(pages, urls.RULES)
    kept = urls.allowed(odd, rules)
    assert kept.columns == odd.columns and kept.count() == sum(x[-1] == "allow" for x in expected(pages, urls.RULES))
