"""Which companies are in the wide universe, and what sector each is in."""

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Single industry codes whose sector differs from their range.
SIC_OVERRIDES = (
    (2711, "Communication Services"), (2721, "Communication Services"),
    (2731, "Communication Services"), (2834, "Health Care"), (2835, "Health Care"),
    (2836, "Health Care"), (3571, "Information Technology"), (3572, "Information Technology"),
    (3576, "Information Technology"), (3577, "Information Technology"),
    (3661, "Information Technology"), (3663, "Information Technology"),
    (3669, "Information Technology"), (3670, "Information Technology"),
    (3672, "Information Technology"), (3674, "Information Technology"),
    (3675, "Information Technology"), (3678, "Information Technology"),
    (3679, "Information Technology"), (3711, "Consumer Discretionary"),
    (3714, "Consumer Discretionary"), (3716, "Consumer Discretionary"),
    (3751, "Consumer Discretionary"), (3826, "Health Care"), (3827, "Information Technology"),
    (3841, "Health Care"), (3842, "Health Care"), (3843, "Health Care"), (3844, "Health Care"),
    (3845, "Health Care"), (3851, "Health Care"), (3861, "Information Technology"),
    (4812, "Communication Services"), (4813, "Communication Services"),
    (4822, "Communication Services"), (4832, "Communication Services"),
    (4833, "Communication Services"), (4841, "Communication Services"),
    (4899, "Communication Services"), (4911, "Utilities"), (4922, "Utilities"), (4923, "Utilities"),
    (4924, "Utilities"), (4931, "Utilities"), (4932, "Utilities"), (4941, "Utilities"),
    (4991, "Utilities"), (5122, "Health Care"), (5812, "Consumer Discretionary"),
    (5813, "Consumer Discretionary"), (6324, "Health Care"), (6500, "Real Estate"),
    (6512, "Real Estate"), (6513, "Real Estate"), (6519, "Real Estate"), (6531, "Real Estate"),
    (6552, "Real Estate"), (6798, "Real Estate"), (7011, "Consumer Discretionary"),
    (7370, "Information Technology"), (7371, "Information Technology"),
    (7372, "Information Technology"), (7373, "Information Technology"),
    (7374, "Information Technology"), (7812, "Communication Services"),
    (7819, "Communication Services"), (7822, "Communication Services"),
    (7841, "Communication Services"), (7900, "Communication Services"),
    (7990, "Communication Services"), (7997, "Consumer Discretionary"), (8000, "Health Care"),
    (8011, "Health Care"), (8060, "Health Care"), (8071, "Health Care"), (8090, "Health Care"),
    (8093, "Health Care"), (6798000, "Real Estate"),
)
# Inclusive industry code ranges and their sector.
SIC_RANGES = (
    (100, 999, "Consumer Staples"), (1000, 1099, "Materials"), (1200, 1299, "Energy"),
    (1300, 1399, "Energy"), (1400, 1499, "Materials"), (1500, 1799, "Industrials"),
    (2000, 2199, "Consumer Staples"), (2200, 2399, "Consumer Discretionary"),
    (2400, 2499, "Industrials"), (2500, 2599, "Consumer Discretionary"),
    (2600, 2699, "Materials"), (2700, 2799, "Communication Services"),
    (2800, 2899, "Materials"), (2900, 2999, "Energy"), (3000, 3299, "Materials"),
    (3300, 3399, "Materials"), (3400, 3599, "Industrials"),
    (3600, 3699, "Information Technology"), (3700, 3799, "Industrials"),
    (3800, 3899, "Health Care"), (3900, 3999, "Consumer Discretionary"),
    (4000, 4499, "Industrials"), (4500, 4599, "Industrials"), (4600, 4699, "Energy"),
    (4700, 4799, "Industrials"), (4800, 4899, "Communication Services"),
    (4900, 4999, "Utilities"), (5000, 5199, "Industrials"),
    (5200, 5999, "Consumer Discretionary"), (6000, 6199, "Financials"),
    (6200, 6299, "Financials"), (6300, 6499, "Financials"), (6500, 6599, "Real Estate"),
    (6700, 6799, "Financials"), (7000, 7099, "Consumer Discretionary"),
    (7200, 7299, "Consumer Discretionary"), (7300, 7399, "Information Technology"),
    (7500, 7699, "Consumer Discretionary"), (7800, 7999, "Communication Services"),
    (8000, 8099, "Health Care"), (8100, 8299, "Consumer Discretionary"),
    (8300, 8399, "Health Care"), (8400, 8999, "Industrials"),
)
UNCLASSIFIED = "Unclassified"

# Ticker suffix letters of lines that are not common stock.
DERIVATIVE_SUFFIXES = ("P", "W", "R", "U")


def sic_codes(spark: SparkSession) -> DataFrame:
    """(code, sector) for every known code, an override before a range.

    The ranges spelled out are fewer than ten thousand codes, so the range join
    is an equality join against a table of fixed size.
    """
    ranges = spark.createDataFrame(list(SIC_RANGES), "lo int, hi int, sector string")
    single = spark.createDataFrame(list(SIC_OVERRIDES), "code int, sector string")
    rows = (ranges.select(F.explode(F.sequence("lo", "hi")).alias("code"), "sector",
                          F.lit(1).alias("prio"))
            .unionByName(single.withColumn("prio", F.lit(0))))
    return rows.groupBy("code").agg(F.min_by("sector", "prio").alias("sector"))


def sector_from_sic(companies: DataFrame, code: str = "sic") -> DataFrame:
    """Adds `sector`; an unknown or unreadable code is 'Unclassified', never a guess."""
    codes = sic_codes(companies.sparkSession).withColumnRenamed("sector", "_sector")
    number = F.col(code).cast("string").try_cast("int")
    return (companies.drop("sector").withColumn("_code", number)
            .join(F.broadcast(codes), F.col("_code") == codes["code"], "left")
            .withColumn("sector", F.coalesce("_sector", F.lit(UNCLASSIFIED)))
            .drop("_code", "code", "_sector"))


def is_derivative_line(symbol="symbol"):
    """Preferred series, warrants, rights and units; a one-letter class is common stock."""
    dash = F.instr(F.col(symbol), "-")
    suffix = F.col(symbol).substr(dash + 1, F.length(symbol))
    one_letter = suffix.rlike("^[A-Za-z]$")
    return (dash > 0) & ~one_letter & F.substring(suffix, 1, 1).isin(list(DERIVATIVE_SUFFIXES))


def derivative_line_filter(directory: DataFrame) -> DataFrame:
    return directory.filter(~is_derivative_line())


def topk_frames(frames: DataFrame, top: int = 1100) -> DataFrame:
    """The largest `top` filers of each frame with their place, 0 first.

    Filtering a row number trims every partition to `top` rows before the shuffle.
    """
    w = Window.partitionBy("frame").orderBy(F.desc("val"), "cik")
    return (frames.filter(F.col("cik").isNotNull() & F.col("val").isNotNull())
            .withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= top)
            .withColumn("place", F.col("rn") - 1).drop("rn"))


def universe_prescreen(frames: DataFrame, directory: DataFrame, forced: DataFrame,
                       top: int = 1100) -> DataFrame:
    """Listed lines of the companies that rank highest over all frames.

    A place, not a value, is added up, so frames of different units mix. Forced
    symbols join whatever their place.
    """
    ranked = topk_frames(frames, top)
    sizes = ranked.groupBy("frame").agg(F.count("*").alias("n"))
    scores = (ranked.join(sizes, "frame").groupBy("cik")
              .agg(F.sum((F.col("n") - F.col("place")) / F.col("n")).alias("score")))
    common = derivative_line_filter(directory)
    chosen = (scores.join(common.select("cik"), "cik", "left_semi")
              .orderBy(F.desc("score"), "cik").limit(top))
    lines = common.join(chosen, "cik").select("symbol", "cik", "name", "exchange", "score")
    extra = (directory.join(forced.select("symbol"), "symbol", "left_semi")
             .join(lines.select("symbol"), "symbol", "left_anti")
             .select("symbol", "cik", "name", "exchange", F.lit(None).cast("double").alias("score")))
    return lines.unionByName(extra)


def liquidity_cut(bars: DataFrame, universe: DataFrame, forced: DataFrame, keep: int = 500,
                  least_sessions: int = 252) -> DataFrame:
    """The most traded line of each company, the most traded companies, the forced ones."""
    newest = Window.partitionBy("symbol").orderBy(F.desc("date"))
    traded = F.col("close") * F.col("volume")
    turnover = (bars.join(universe.select("symbol"), "symbol", "left_semi")
                .select("symbol", traded.alias("traded"), F.row_number().over(newest).alias("rn"))
                .groupBy("symbol").agg(
                    F.count("*").alias("n"),
                    F.avg(F.when(F.col("rn") <= least_sessions, F.col("traded"))).alias("turnover"))
                .filter((F.col("n") >= least_sessions) & F.col("turnover").isNotNull()))
    company = F.coalesce(F.col("cik").cast("string"), F.concat(F.lit("line "), "symbol"))
    rank = F.struct((-F.col("turnover")).alias("k"), "symbol")
    lines = (universe.join(turnover, "symbol").groupBy(company.alias("company"))
             .agg(F.min_by(F.struct("symbol", "cik", "name", "sector", "exchange", "turnover"),
                           rank).alias("x")).select("x.*"))
    largest = lines.orderBy(F.desc("turnover"), "symbol").limit(keep)
    must = (lines.join(forced.select("symbol"), "symbol", "left_semi")
            .join(largest.select("symbol"), "symbol", "left_anti"))
    return largest.unionByName(must.select(*largest.columns))
