from tickwright.llm import warc
from tickwright.llm.queries import ORACLE_SQL, QUERIES

from .run_queries import differences, views

SF = "/root/testdata/sf0.001"
RECORDS = "record_id long, url string, at long, kind string, headers map<string,string>"


def resolved(spark, rows, ranges=None):
    frame = spark.createDataFrame(rows, RECORDS)
    names = {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.shuffle.partitions": str(ranges)}
    before = {k: spark.conf.get(k) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v if ranges else before[k])
    try:
        return {r.record_id: (r.outcome, r.base_id, r.headers) for r in warc.resolve_revisits(frame).collect()}
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_latest_earlier_response_and_headers(spark):
    url = "http://Site.com:80/a#x"
    rows = [
        (1, url, 100, "response", {"etag": "1", "content-length": "9", "date": "a"}),
        (2, "http://site.com/a", 50_000, "response", {"etag": "2", "content-length": "7", "date": "b", "vary": "*"}),
        (3, "http://site.com/a", 90_000_000, "revisit", {"etag": "W/2", "content-length": "0", "date": "c"}),
        (4, "http://site.com/a", 200, "revisit", {"etag": "2"}),
        (5, "http://site.com/a", 300, "revisit", {"date": "d"}),
        (6, "http://site.com/a", 99, "revisit", {"etag": "1"}),
        (7, "http://site.com/b", 500, "revisit", None),
        (8, None, 500, "revisit", {"etag": "1"}),
        (9, url, None, "response", None),
        (10, "http://site.com/a", 60_000, "revisit", {"etag": "2", "date": "e"}),
    ]
    for ranges in (1, 4):
        got = resolved(spark, rows, ranges)
        assert got[3] == ("resolved", 2, {"etag": "W/2", "content-length": "7", "date": "c", "vary": "*"})
        assert got[4][:2] == ("changed", None) and got[5] == (
            "resolved", 1, {"etag": "1", "content-length": "9", "date": "d"})
        assert got[6][0] == "changed" and got[7][0] == "missing" and got[8][0] == "missing"
        assert got[10][:2] == ("resolved", 2) and got[1][0] == "response"


def test_only_the_port_of_the_scheme_is_left_out(spark):
    urls = {"http://x.org:80/a": "http://x.org/a", "http://x.org:443/a": "http://x.org:443/a", "HTTPS://X.org:443": "https://x.org/",
            "https://x.org:80/": "https://x.org:80/", "https://u:p@x.org:/b?c#d": "https://x.org/b?c", "x:80": "x:80",
            "ftp://x.org:80/": "ftp://x.org:80/"}
    frame = spark.createDataFrame([(u,) for u in urls], "url string")
    assert {r.url: r.key for r in frame.select("url", warc.canonical_url(frame.url).alias("key")).collect()} == urls


def test_one_crowded_url_over_many_ranges(spark):
    import random
    pick = random.Random(6)
    rows = [(i, pick.choice(["http://hot.org/", "http://hot.org", "http://b.org/x"]), pick.choice([5, 5, 5, 6, 7, None]),
             pick.choice(["response", "revisit", "revisit"]), {"etag": str(pick.randrange(3))}) for i in range(300)]
    got = resolved(spark, rows, 9)
    line = sorted(rows, key=lambda r: (r[1][7:10], -(1 << 40) if r[2] is None else r[2], r[0]))
    last = {}
    for i, url, _, kind, headers in line:
        key = url.rstrip("/")
        if kind == "response":
            assert got[i][0] == "response"
            last[key] = (i, headers["etag"])
        elif key not in last:
            assert got[i][0] == "missing"
        else:
            same = last[key][1] == headers["etag"]
            assert got[i][:2] == (("resolved", last[key][0]) if same else ("changed", None))


def test_ties_repeats_and_empty(spark):
    rows = [(1, "u", 5, "response", {"etag": "1"}), (2, "u", 5, "response", {"etag": "1"}),
            (3, "u", 5, "revisit", {"etag": "1"})]
    assert resolved(spark, rows)[3][:2] == ("resolved", 2)
    frame = spark.createDataFrame(rows + rows, RECORDS)
    got = warc.resolve_revisits(frame).collect()
    assert len(got) == 6 and {r.base_id for r in got if r.record_id == 3} == {2}
    assert resolved(spark, []) == {}
    from .cases import crowded
    odd = crowded(frame)
    for name in ("url_key", "span", "full", "near", "carried", "base"):
        odd = odd.withColumn(name, frame.url)
    assert sorted(map(str, warc.resolve_revisits(odd).collect())) == sorted(map(str, got))


def test_query_against_sql(spark):
    rows, problem = differences(QUERIES["op5_warc_revisits"](spark, SF), views(SF), ORACLE_SQL["op5_warc_revisits"])
    assert rows and problem is None
