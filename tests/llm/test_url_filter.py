from pyspark.sql import functions as F

from tickwright.llm import url_filter
from tickwright.llm.queries import ORACLE_SQL, QUERIES, URL_RULES

from .run_queries import differences, views

SF = "/root/testdata/sf0.001"
URLS = [None, "", "no scheme.com/", "http://a.com", "http://a.com/", "HTTP://WWW.Example.COM/en/x?q#f",
        "https://example.com/en/", "https://x.example.com/en", "https://x.example.com/en/#a", "s://net/es/",
        "s://m.net/fr/a/b", "s://m.net/de/", "s://fnet/es/", "s://example.com:80/en/", "s://.com/", "s://com.",
        "s://", "s:///en/", "://com/", "s://a.com?/en/", "s://a.com\n/x", "s://b://com/", "s://" + "a." * 5000 + "com/"]


def pages(spark, urls):
    return spark.createDataFrame([(i, u, "odd") for i, u in enumerate(urls)], "page_id long, url string, key string")


def plain(url, rules):
    if not url or "://" not in url:
        host = path = ""
    else:
        rest = url.split("://", 1)[1]
        cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
        host, rest = rest[:cut], rest[cut:]
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
        path = rest[:min([rest.find(c) for c in "?#" if c in rest] or [len(rest)])]
    fits = [(len(h + p), h + p, a) for h, p, a in rules
            if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=(0, None, "allow"))
    return host, path, best[1], best[2]


def judged(spark, urls, rules):
    frame = spark.createDataFrame(rules, "host string, path string, action string")
    return {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in
            url_filter.judge(pages(spark, urls), frame).collect()}


def test_odd_urls(spark):
    assert judged(spark, URLS, URL_RULES) == {i: plain(u, URL_RULES) for i, u in enumerate(URLS)}


def test_no_rules_no_pages(spark):
    frame = spark.createDataFrame([], "host string, path string, action string")
    got = url_filter.judge(pages(spark, URLS), frame).collect()
    assert len(got) == len(URLS) and {(r.rule, r.verdict) for r in got} == {(None, "allow")}
    assert judged(spark, [], URL_RULES) == {}


def test_cascade_is_exact(spark):
    universe = spark.range(20_000).select(F.concat(F.lit("k"), "id").alias("key"))
    listed = universe.filter(F.crc32(F.col("key").cast("binary")) % 37 == 0)
    cascade = url_filter.Cascade.build(listed, universe)
    assert len(cascade.levels) > 2
    held = universe.filter(cascade.holds(F.col("key")))
    assert held.count() == listed.count() and held.join(listed, "key", "left_anti").count() == 0


def test_query_against_sql(spark):
    rows, problem = differences(QUERIES["op4_url_filters"](spark, SF), views(SF), ORACLE_SQL["op4_url_filters"])
    assert rows and problem is None
