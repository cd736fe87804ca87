"""The searchable list of companies."""

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def union_catalog(core: DataFrame, wide: DataFrame) -> DataFrame:
    """Companies of both dimensions with the dimension they came from, 0 first."""
    core = core.filter("is_index = 0").select("symbol", "name", F.lit("").alias("exchange"),
                                              F.lit(0).alias("source"))
    return (core.unionByName(wide.select("symbol", "name", "exchange", F.lit(1).alias("source")))
            .filter(F.col("symbol").isNotNull()))


def dedupe_catalog(core: DataFrame, wide: DataFrame) -> DataFrame:
    """One row per symbol, the first dimension that has it wins."""
    order = F.struct("source", "name", "exchange")
    return (union_catalog(core, wide).groupBy("symbol")
            .agg(F.min(order).alias("x")).select("symbol", "x.name", "x.exchange", "x.source"))


EXACT, PREFIX, INSIDE = 0, 1, 2
PIECE = 3        # letters in a piece; a shorter term is a piece itself


@dataclass(frozen=True)
class SearchIndex:
    """companies (symbol, name, exchange, source, version), the pieces of their texts
    (piece, symbol, version), and how many companies hold a piece (piece, n).

    A company's row of an older version is void, and so are its pieces. `n` only picks
    the piece to look up, so it may count void rows.
    """

    companies: DataFrame
    postings: DataFrame
    sizes: DataFrame


def _pieces(text):
    """Every distinct run of 1 to PIECE letters of a text."""
    runs = F.transform(F.sequence(F.lit(1), F.length(text)),
                       lambda i: F.array(*[text.substr(i, F.lit(n)) for n in range(1, PIECE + 1)]))
    return F.when(F.length(text) > 0, F.flatten(runs)).otherwise(F.array().cast("array<string>"))


def index_catalog(catalog: DataFrame, version: int = 0) -> SearchIndex:
    """An inverted index of the pieces of tickers and names; nothing is written."""
    companies = catalog.select("symbol", "name", "exchange", "source", F.lit(version).cast("long").alias("version"))
    texts = F.concat(_pieces(F.upper("symbol")), _pieces(F.upper(F.coalesce("name", F.lit("")))))
    postings = companies.select(F.explode(F.array_distinct(texts)).alias("piece"), "symbol", "version")
    return SearchIndex(companies, postings, postings.groupBy("piece").agg(F.count("*").alias("n")))


def write_index(catalog: DataFrame, path: str, version: int = 0) -> SearchIndex:
    """Add a catalog's companies to the stored index as one version; later versions replace earlier ones.

    Pieces are written in order, so that a look-up of few pieces skips the rest of the
    files. Only what is handed in is read: an update passes the changed companies. The
    companies come last: until they are there, the version's pieces belong to nobody.
    """
    made = index_catalog(catalog, version)
    made.postings.repartitionByRange("piece").sortWithinPartitions("piece").write.mode("append").parquet(f"{path}/postings")
    made.sizes.write.mode("append").parquet(f"{path}/sizes")
    made.companies.write.mode("append").parquet(f"{path}/companies")
    return read_index(catalog.sparkSession, path)


def read_index(spark: SparkSession, path: str) -> SearchIndex:
    """The stored index with the latest version of every company."""
    rows = spark.read.schema("symbol string, name string, exchange string, source int, version long").parquet(f"{path}/companies")
    newest = rows.groupBy("symbol").agg(F.max(F.struct("version", "name", "exchange", "source")).alias("x"))
    return SearchIndex(
        newest.select("symbol", "x.name", "x.exchange", "x.source", "x.version"),
        spark.read.schema("piece string, symbol string, version long").parquet(f"{path}/postings"),
        spark.read.schema("piece string, n long").parquet(f"{path}/sizes").groupBy("piece").agg(F.sum("n").alias("n")))


def search_index(index: SearchIndex, terms: DataFrame, limit: int = 8) -> DataFrame:
    """Best matches of every term: exact ticker, then a prefix, then anywhere.

    A term looks up the rarest of its pieces, and its text is then sought in the few
    companies that hold that piece. A term with a piece that no company has finds none.
    """
    t = F.col("t")
    wanted = terms.select("term", F.upper(F.trim("term")).alias("t")).distinct().filter(t != "")
    own = F.when(F.length(t) <= PIECE, F.array(t)).otherwise(
        F.transform(F.sequence(F.lit(1), F.length(t) - PIECE + 1), lambda i: t.substr(i, F.lit(PIECE))))
    rarest = (wanted.select("term", "t", F.explode(own).alias("piece")).join(index.sizes, "piece", "left")
              .groupBy("term", "t").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "piece")).alias("x"))
              .filter("x.n > 0").select("term", "t", "x.piece"))
    symbol, name = F.upper("symbol"), F.upper(F.coalesce("name", F.lit("")))
    tier = (F.when(symbol == t, EXACT).when(symbol.startswith(t) | name.startswith(t), PREFIX).otherwise(INSIDE))
    hits = (rarest.join(index.postings, "piece").join(index.companies, ["symbol", "version"])
            .filter(symbol.contains(t) | name.contains(t)).withColumn("tier", tier))
    order = Window.partitionBy("term").orderBy("tier", "source", "symbol")
    return (hits.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= limit)
            .select("term", "rank", "symbol", "name",
                    F.coalesce(F.nullif(F.col("exchange"), F.lit("")), F.lit("local")).alias("exchange"),
                    "tier"))


def search_catalog(catalog: DataFrame, terms: DataFrame, limit: int = 8) -> DataFrame:
    """search_index over a catalog that is not stored."""
    return search_index(index_catalog(catalog), terms, limit)
