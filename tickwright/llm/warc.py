"""Not-modified revisits of a crawl: the full response that each of them stands for.

A revisit record holds headers only. Its body is that of the latest earlier full
response of the same canonical URL; validators of both are compared, and the
revisit's headers replace those of the response but for headers that describe the
body or the connection.

Records are laid out in order of URL, time and id by ranges, and written. Inside a range
a window finds the last response; between ranges of one URL the last response of each
is carried on. So a URL that holds a third of all records, or a million at one second, is
spread over many tasks. Bodies take no part in it; the answer names the record that has
the body.

Defined results: a null url forms no group and a revisit of it has no base; a null
time is before all others; records of the same time are ordered by id; the same
record twice is resolved twice; a revisit without a validator is accepted, one whose validator differs is
`changed`, one without an earlier response is `missing`; a very long url is compared
whole; other columns are ignored; an empty table gives an empty result.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .tables import written

#: Headers of a stored response that a not-modified answer leaves alone.
KEPT_HEADERS = ("connection", "content-encoding", "content-length", "content-range", "content-type",
                "keep-alive", "proxy-authenticate", "proxy-authorization", "te", "trailer",
                "transfer-encoding", "upgrade")


def canonical_url(url: Column) -> Column:
    """Lower-case scheme and host, no fragment, user or default port, "/" for no path."""
    scheme = F.lower(F.regexp_extract(url, r"(?s)^([A-Za-z][A-Za-z0-9+.-]*)://", 1))
    host = F.lower(F.regexp_extract(url, r"(?s)^[^:]*://(?:[^/?#@]*@)?([^/?#]*)", 1))
    host = F.regexp_replace(host, ":$", "")
    host = (F.when(scheme == "http", F.regexp_replace(host, ":80$", ""))
            .when(scheme == "https", F.regexp_replace(host, ":443$", "")).otherwise(host))
    rest = F.regexp_extract(url, r"(?s)^[^:]*://[^/?#]*([^#]*)", 1)
    rest = F.when(rest.startswith("/"), rest).otherwise(F.concat(F.lit("/"), rest))
    return F.when(scheme != "", F.concat(scheme, F.lit("://"), host, rest)).otherwise(url)


def _header(headers: Column, name: str) -> Column:
    return F.element_at(headers, name)


def resolve_revisits(records: DataFrame) -> DataFrame:
    """Per row: record_id, url_key, base_id, outcome, headers.

    records: record_id, url, at (epoch seconds), kind (response or revisit), headers
    (lower-case names). outcome is response, resolved, changed or missing; base_id
    and merged headers are set for resolved, else headers are the record's own.
    """
    rows = records.select(
        "record_id", canonical_url(F.col("url")).alias("url_key"),
        F.coalesce(F.col("at").cast("long"), F.lit(-(1 << 40))).alias("at"), "kind", "headers")
    rows = written(rows.repartitionByRange("url_key", "at", "record_id")
                   .withColumn("span", F.spark_partition_id()), "crawl-records")
    rows = rows.withColumn("full", F.when((F.col("kind") == "response") & F.col("url_key").isNotNull(),
                                          F.struct("record_id", "headers")))
    order = F.struct("at", "record_id")
    last = (rows.filter("full IS NOT NULL").groupBy("url_key", "span")
            .agg(F.max_by("full", order).alias("last_full")))
    spans = rows.groupBy("url_key", "span").agg(F.count(F.lit(1)).alias("_n")).filter("url_key IS NOT NULL")
    earlier = Window.partitionBy("url_key").orderBy("span").rowsBetween(Window.unboundedPreceding, -1)
    carried = (spans.join(last, ["url_key", "span"], "left")
               .select("url_key", "span", F.last("last_full", True).over(earlier).alias("carried")))
    inside = (Window.partitionBy("url_key", "span").orderBy("at", "record_id")
              .rowsBetween(Window.unboundedPreceding, -1))
    named = rows.filter("url_key IS NOT NULL").withColumn("near", F.last("full", True).over(inside))
    found = (named.join(carried, ["url_key", "span"], "left")
             .withColumn("base", F.coalesce("near", "carried")).drop("near", "carried")
             .unionByName(rows.filter("url_key IS NULL").withColumn("base", F.lit(None).cast(
                 named.schema["full"].dataType))))

    def weak(tag):
        return F.regexp_replace(tag, "^W/", "")
    old, new = F.col("base.headers"), F.col("headers")
    same = F.coalesce(weak(_header(new, "etag")) == F.coalesce(weak(_header(old, "etag")), F.lit("")),
                      _header(new, "last-modified") == F.coalesce(_header(old, "last-modified"), F.lit("")),
                      F.lit(True))
    outcome = (F.when(F.col("kind") == "response", "response").when(F.col("base").isNull(), "missing")
               .when(same, "resolved").otherwise("changed"))
    fresh = F.map_filter(new, lambda k, _: ~k.isin(*KEPT_HEADERS))
    stale = F.map_filter(old, lambda k, _: ~F.array_contains(F.map_keys(fresh), k))
    done = outcome == "resolved"
    return found.select(
        "record_id", "url_key", F.when(done, F.col("base.record_id")).alias("base_id"),
        outcome.alias("outcome"),
        F.when(done & new.isNotNull() & old.isNotNull(), F.map_concat(stale, fresh))
        .when(done, F.coalesce(old, new)).otherwise(new).alias("headers"))
