"""The registered queries of the numbered operators: each over its whole table."""

from pyspark.sql import functions as F

from . import (alignment, conversations, exact_dedup, jaccard, language, mixing, quality, sharding, suffix_dedup, toxicity,
               url_filter, warc, winnowing)
from .heldout import held_out


def table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_suffix_dedup(spark, sf_dir):
    done = suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["begin"])
    return done.select("doc_id", "n_bytes", removed.alias("n_removed"),
                       F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


OP1_SQL = r"""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, strlen(coalesce(text, '')) AS n FROM documents),
w AS (SELECT doc_id, i, md5_number(substr(h, 2 * i + 1, 100)) AS s
      FROM (SELECT doc_id, h, unnest(range(greatest(n - 49, 0))) AS i FROM d)),
f AS (SELECT s, min(doc_id) AS lowest FROM w GROUP BY s),
m AS (SELECT doc_id, i, i > lag(i, 1, -100) OVER (PARTITION BY doc_id ORDER BY i) + 50 AS fresh
      FROM w JOIN f USING (s) WHERE lowest < doc_id),
r AS (SELECT doc_id, min(i) AS b, max(i) + 50 AS e
      FROM (SELECT *, sum(CAST(fresh AS INT)) OVER (PARTITION BY doc_id ORDER BY i) AS k FROM m) GROUP BY doc_id, k),
g AS (SELECT doc_id, b, e, lag(e, 1, 0) OVER (PARTITION BY doc_id ORDER BY b) AS p FROM r),
k AS (SELECT doc_id, sum(e - b) AS gone, count(*) AS spans, max(e) AS last,
             string_agg(substr(h, 2 * p + 1, 2 * (b - p)), '' ORDER BY b) AS kept
      FROM g JOIN d USING (doc_id) GROUP BY doc_id)
SELECT doc_id, CAST(n AS BIGINT) AS n_bytes, CAST(coalesce(gone, 0) AS BIGINT) AS n_removed, coalesce(spans, 0) AS n_spans,
       sha256(unhex(coalesce(kept || substr(h, 2 * last + 1), h))) AS kept_sha256
FROM d LEFT JOIN k USING (doc_id)
"""


def op2_exact_dedup(spark, sf_dir):
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents"))


OP2_SQL = r"""
WITH t AS (
  SELECT doc_id, length(coalesce(text, '')) AS points,
         regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm
  FROM documents)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id,
       count(*) OVER (PARTITION BY norm) AS group_size,
       doc_id = first_value(doc_id) OVER w AS kept, sha256(norm) AS text_sha256
FROM t WINDOW w AS (PARTITION BY norm ORDER BY points DESC, doc_id)
"""

def op3_toxicity(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    lexicon = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    scored = toxicity.score(docs, lexicon)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
                         (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"))


#: The rules of the query: host, path, action.
URL_RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]


def op4_url_filters(spark, sf_dir):
    rules = spark.createDataFrame(URL_RULES, "host string, path string, action string")
    return url_filter.judge(table(spark, sf_dir, "pages"), rules)


OP4_SQL = r"""
WITH rules(rule_host, rule_path, action) AS (VALUES
  ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'),
  ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
p AS (
  SELECT page_id,
    coalesce(translate(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'),
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
    coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') AS path
  FROM pages),
m AS (
  SELECT p.*, rule_host || rule_path AS rule, action,
    row_number() OVER (PARTITION BY page_id
                       ORDER BY length(rule_host || rule_path) DESC NULLS LAST) AS place
  FROM p LEFT JOIN rules
    ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path))
SELECT page_id, host, path, rule, coalesce(action, 'allow') AS verdict FROM m WHERE place = 1
"""


def crawl_records(pages):
    """Each page as three captures: a full response, then two not-modified revisits.

    Pages whose urls differ in their digits alone are captures of one url, so that a url
    has several responses. The first revisit carries the response's validator unless the
    page's number is a multiple of 7; the second one was made before the response when it
    is one of 5.
    """
    at = F.col("page_id") * 600
    step = F.explode(F.array(F.lit(0), F.lit(1), F.lit(2)))
    url = F.regexp_replace("url", "[0-9]+", "0")
    rows = pages.select("page_id", url.alias("url"), at.alias("seen"), F.md5("html").alias("tag"),
                        F.octet_length("html").cast("string").alias("length"), step.alias("step"))
    early = (F.col("step") == 2) & (F.col("page_id") % 5 == 0)
    tag = F.when((F.col("step") == 1) & (F.col("page_id") % 7 == 0), F.lit("other")).otherwise(F.col("tag"))
    return rows.select(
        (F.col("page_id") * 3 + F.col("step")).alias("record_id"), "url",
        (F.col("seen") + F.when(early, -1).otherwise(F.col("step") * 90_000)).alias("at"),
        F.when(F.col("step") == 0, "response").otherwise("revisit").alias("kind"),
        F.create_map(F.lit("etag"), tag,
                     F.lit("content-length"), F.when(F.col("step") == 0, F.col("length")).otherwise("0"),
                     F.lit("date"), F.col("step").cast("string")).alias("headers"))


def op5_warc_revisits(spark, sf_dir):
    done = warc.resolve_revisits(crawl_records(table(spark, sf_dir, "pages")))
    return done.select("record_id", "url_key", "base_id", "outcome",
                       F.element_at("headers", "etag").alias("etag"),
                       F.element_at("headers", "content-length").alias("content_length"),
                       F.element_at("headers", "date").alias("date"))


OP5_SQL = r"""
WITH r AS (
  SELECT page_id * 3 + step AS record_id,
    CASE WHEN regexp_matches(url, '^[A-Za-z][A-Za-z0-9+.-]*://') THEN
      lower(regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*)://', 1)) || '://' ||
      regexp_replace(lower(regexp_extract(url, '^[^:]*://(?:[^/?#@]*@)?([^/?#]*)', 1)),
        CASE WHEN starts_with(lower(url), 'http:') THEN ':(80)?$' WHEN starts_with(lower(url), 'https:') THEN ':(443)?$' ELSE ':$' END, '') ||
      CASE WHEN starts_with(regexp_extract(url, '^[^:]*://[^/?#]*([^#]*)', 1), '/') THEN '' ELSE '/' END ||
      regexp_extract(url, '^[^:]*://[^/?#]*([^#]*)', 1) ELSE url END AS url_key,
    page_id * 600 + CASE WHEN step = 2 AND page_id % 5 = 0 THEN -1 ELSE step * 90000 END AS at,
    step, CASE WHEN step = 1 AND page_id % 7 = 0 THEN 'other' ELSE md5(html) END AS etag,
    CASE WHEN step = 0 THEN CAST(strlen(html) AS VARCHAR) ELSE '0' END AS content_length
  FROM (SELECT * REPLACE (regexp_replace(url, '[0-9]+', '0', 'g') AS url) FROM pages), (VALUES (0), (1), (2)) s(step)),
b AS (
  SELECT v.record_id, f.record_id AS base, f.etag AS base_etag, f.content_length AS base_length,
    row_number() OVER (PARTITION BY v.record_id ORDER BY f.at DESC, f.record_id DESC) AS place
  FROM r v JOIN r f ON v.url_key = f.url_key AND f.step = 0 AND v.step > 0
    AND (f.at < v.at OR (f.at = v.at AND f.record_id < v.record_id)))
SELECT r.record_id, url_key, CASE WHEN base_etag = etag THEN base END AS base_id,
  CASE WHEN step = 0 THEN 'response' WHEN base IS NULL THEN 'missing'
       WHEN base_etag = etag THEN 'resolved' ELSE 'changed' END AS outcome,
  etag, CASE WHEN base_etag = etag THEN base_length ELSE content_length END AS content_length,
  CAST(step AS VARCHAR) AS date
FROM r LEFT JOIN (SELECT * FROM b WHERE place = 1) b USING (record_id)
"""


def op6_source_mixing(spark, sf_dir):
    return mixing.mix(table(spark, sf_dir, "documents")).select(
        "doc_id", "size", "source_size", "target", "taken")


SHARDS = 40


def op9_sharding(spark, sf_dir):
    done = sharding.shard_documents(table(spark, sf_dir, "documents"), SHARDS)
    return done.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot",
                       "grown_shard")


def op10_decontamination(spark, sf_dir):
    judged, _ = winnowing.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    ids = F.array_sort(F.transform(F.coalesce("item_ids", F.array().cast("array<long>")),
                                   lambda i: i.cast("string")))
    return judged.select("doc_id", "n_words", "n_hit", F.size(ids).cast("long").alias("n_items"),
                         F.sha2(F.array_join(ids, ","), 256).alias("items_sha256"), "contaminated")


OP10_SQL = r"""
WITH b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                     '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
i AS (
  SELECT DISTINCT item_id, least(len(w), 13) AS k, array_to_string(w[j:j + least(len(w), 13) - 1], ' ') AS g
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS j FROM b WHERE len(w) > 0)),
d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
p AS (
  SELECT doc_id, k, j, array_to_string(w[j:j + k - 1], ' ') AS g
  FROM (SELECT doc_id, w, k, unnest(range(1, greatest(len(w) - k + 1, 0) + 1)) AS j
        FROM d, (SELECT DISTINCT k FROM i))),
m AS (SELECT p.doc_id, p.k, p.j, i.item_id FROM p JOIN i ON p.g = i.g AND p.k = i.k),
h AS (SELECT doc_id, count(DISTINCT place) AS n_hit FROM (SELECT doc_id, unnest(range(j, j + k)) AS place FROM m) GROUP BY doc_id),
o AS (SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids
      FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS id FROM m) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN o USING (doc_id)
"""

OP6_SQL = r"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size
  FROM documents),
s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         row_number() OVER (ORDER BY source NULLS LAST) - 1 AS n FROM d GROUP BY source),
w AS (
  SELECT *, CAST(CASE n % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS DOUBLE) AS weight,
         CAST(3 * source_size AS DOUBLE) AS most FROM s),
r AS (
  SELECT *, row_number() OVER by_ratio AS k,
    ((SELECT CAST(sum(size) AS DOUBLE) FROM d)
      - coalesce(sum(most) OVER (by_ratio ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(weight) OVER (by_ratio ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS unit
  FROM w WINDOW by_ratio AS (ORDER BY most / weight, n)),
f AS (SELECT k, unit FROM r WHERE weight * unit <= most ORDER BY k LIMIT 1),
g AS (
  SELECT n, source, source_size, CASE WHEN r.k < f.k THEN most ELSE weight * f.unit END AS target,
         (source_size + 127) // 128 AS blocks FROM r, f),
h AS (
  SELECT *, CASE WHEN n = (SELECT max(n) FROM g WHERE target > 0) THEN 2 ELSE
    sum(target) OVER (ORDER BY n) / greatest((SELECT sum(target) FROM g), 1) END AS bound FROM g),
p AS (
  SELECT slot, (slot % 2147483648) * 1327217885 % 2147483648 / CAST(2147483648 AS DOUBLE) AS point
  FROM range((SELECT CAST(ceil(round(sum(target)) / 128) AS BIGINT) FROM g)) t(slot)),
a AS (SELECT slot, min(n) AS n FROM p JOIN h ON point < bound GROUP BY slot),
k AS (SELECT n, row_number() OVER (PARTITION BY n ORDER BY slot) - 1 AS rank FROM a),
t AS (SELECT n, rank % blocks AS block, count(*) AS times FROM k JOIN g USING (n) WHERE rank // blocks < 3 GROUP BY 1, 2),
b AS (
  SELECT d.*, n, coalesce(sum(size) OVER (PARTITION BY n ORDER BY md5(CAST(doc_id AS VARCHAR)), doc_id
                          ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS begin
  FROM d JOIN s ON d.source IS NOT DISTINCT FROM s.source),
x AS (
  SELECT doc_id, n, size, begin, unnest(range(CAST(begin // 128 AS BIGINT), CAST((begin + size - 1) // 128 + 1 AS BIGINT))) AS block
  FROM b WHERE size > 0),
y AS (
  SELECT doc_id, sum(times * (least(begin + size, (x.block + 1) * 128) - greatest(begin, x.block * 128))) AS taken
  FROM x JOIN t USING (n, block) GROUP BY doc_id)
SELECT b.doc_id, b.size, g.source_size, g.target, CAST(coalesce(taken, 0) AS BIGINT) AS taken
FROM b JOIN g USING (n) LEFT JOIN y ON y.doc_id = b.doc_id
"""


def op7_jaccard_join(spark, sf_dir):
    return jaccard.jaccard_components(table(spark, sf_dir, "documents"))


OP7_SQL = r"""
WITH RECURSIVE t AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(w[j:j + least(len(w), 5) - 1], ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS j FROM t WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
l AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id
  JOIN n x ON x.doc_id = a.doc_id JOIN n y ON y.doc_id = b.doc_id
  GROUP BY a.doc_id, b.doc_id, x.n, y.n HAVING 100 * count(*) >= 80 * (x.n + y.n - count(*))),
r(a, b) AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a)
SELECT t.doc_id, coalesce(n, 0) AS n_shingles, least(t.doc_id, coalesce(low, t.doc_id)) AS component_id
FROM t LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT a, min(b) AS low FROM r GROUP BY a) c ON c.a = t.doc_id
"""


def op8_language_id(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    model = language.fit(docs.select("doc_id", "text", "lang"))
    return language.identify(docs.select("doc_id", "text"), model).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op11_token_alignment(spark, sf_dir):
    rows, _ = alignment.align(table(spark, sf_dir, "documents"))
    return rows


def op12_quality_rules(spark, sf_dir):
    rows, _ = quality.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return rows


def damaged(rows):
    """Rows with every twentieth dropped, emptied, bared of stops, doubled or made a user's, by a checksum."""
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    k = F.pmod(F.crc32(F.concat(part("conv_id"), F.lit(":"), part("turn")).cast("binary")), F.lit(20))
    text, role = part("text"), part("role")
    return (rows.withColumn("__k", k).filter("__k != 0").select(
        "conv_id", "turn", F.when(F.col("__k") == 4, "user").otherwise(role).alias("role"),
        F.when(F.col("__k") == 1, "").when(F.col("__k") == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"),
        F.explode(F.when(F.col("__k") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"))
        .drop("copy"))


def op13_conversation_repair(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations")
    return conversations.repair_conversations(damaged(rows), rows)


QUERIES = {f.__name__: f for f in (
    op1_suffix_dedup, op2_exact_dedup, op3_toxicity, op4_url_filters, op5_warc_revisits, op6_source_mixing, op7_jaccard_join, op8_language_id, op9_sharding,
    op10_decontamination, op11_token_alignment, op12_quality_rules, op13_conversation_repair)}
#: The others cannot be stated in SQL: op3, op8 and op12 fit a model, op9 numbers rows by a hash that SQL
#: lacks, op11 needs the tokenizers, op13 a search; tests compare each with a plain version.
ORACLE_SQL = {"op1_suffix_dedup": OP1_SQL, "op2_exact_dedup": OP2_SQL, "op4_url_filters": OP4_SQL,
              "op5_warc_revisits": OP5_SQL, "op6_source_mixing": OP6_SQL, "op7_jaccard_join": OP7_SQL,
              "op10_decontamination": OP10_SQL}
