"""Landed provider payloads (JSON text) as typed rows."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Listing venues in scope, as a directory and as a search spell them.
US_VENUES = ("NYSE", "Nasdaq", "NYSEAmerican", "NYSE American", "AMEX", "CBOE")
US_VENUE_PREFIXES = ("NYSE", "Nasdaq", "NMS", "NGM", "NCM", "NYQ", "ASE", "AMEX", "NYSEArca",
                     "BATS", "PCX")

_SERIES = "array<double>"
CHART = (f"chart struct<result: array<struct<meta: struct<symbol: string, longName: string, "
         "shortName: string, currency: string, fullExchangeName: string, "
         "regularMarketPrice: double, chartPreviousClose: double, previousClose: double, "
         "regularMarketDayHigh: double, regularMarketDayLow: double, regularMarketVolume: bigint, "
         "fiftyTwoWeekHigh: double, fiftyTwoWeekLow: double, firstTradeDate: bigint, "
         "regularMarketTime: bigint, exchangeTimezoneName: string>, timestamp: array<bigint>, "
         f"indicators: struct<quote: array<struct<open: {_SERIES}, high: {_SERIES}, low: {_SERIES}, "
         f"close: {_SERIES}, volume: array<bigint>>>, adjclose: array<struct<adjclose: {_SERIES}>>>>>>")


def _at(array, index):
    return F.get(array, index)


def parse_price_payload(df: DataFrame, payload: str = "payload") -> DataFrame:
    """Parallel arrays of a price document as bars.

    A session without a close is dropped; the adjusted close falls back to the
    close; the date is the UTC calendar date of the time stamp.
    """
    doc = df.select("symbol", F.from_json(payload, CHART)["chart"]["result"][0].alias("d"))
    quote, adjusted = F.col("d.indicators.quote")[0], F.get(F.col("d.indicators.adjclose"), 0)
    parts = doc.select("symbol", F.col("d.timestamp").alias("ts"), quote.alias("q"),
                       adjusted["adjclose"].alias("adj"))
    rows = parts.select("symbol", "q", "adj", F.posexplode("ts").alias("i", "ts"))
    i = F.col("i")
    close = _at(F.col("q.close"), i)
    return (rows.select(
        "symbol", F.date_from_unix_date(F.floor(F.col("ts") / 86400).cast("int")).alias("date"),
        *[_at(F.col(f"q.{c}"), i).alias(c) for c in ("open", "high", "low")],
        close.alias("close"), F.coalesce(_at(F.col("adj"), i), close).alias("adj_close"),
        _at(F.col("q.volume"), i).alias("volume")).filter(F.col("close").isNotNull()))


def parse_quote_payload(df: DataFrame, payload: str = "payload") -> DataFrame:
    """The quote block of a document; no change figure without a previous close."""
    m = df.select("symbol", F.from_json(payload, CHART)["chart"]["result"][0]["meta"].alias("m"))
    price = F.col("m.regularMarketPrice")
    prev = F.coalesce(F.nullif(F.col("m.chartPreviousClose"), F.lit(0.0)), F.col("m.previousClose"))
    base = F.nullif(prev, F.lit(0.0))
    return (m.filter(price.isNotNull()).select(
        F.upper(F.coalesce("m.symbol", "symbol")).alias("symbol"),
        F.coalesce("m.longName", "m.shortName", "symbol").alias("name"), price.alias("price"),
        prev.alias("prev_close"), F.when(base.isNotNull(), price - base).alias("change"),
        ((price - base) / base).alias("change_pct"), F.col("m.currency").alias("currency"),
        F.col("m.fullExchangeName").alias("exchange"),
        F.col("m.regularMarketDayHigh").alias("day_high"),
        F.col("m.regularMarketDayLow").alias("day_low"),
        F.col("m.regularMarketVolume").alias("volume"),
        F.col("m.fiftyTwoWeekHigh").alias("w52_high"), F.col("m.fiftyTwoWeekLow").alias("w52_low"),
        F.col("m.firstTradeDate").alias("first_trade"), F.col("m.regularMarketTime").alias("market_time"),
        F.col("m.exchangeTimezoneName").alias("timezone")))


def parse_ticker_directory(df: DataFrame, payload: str = "payload") -> DataFrame:
    """A columnar {fields, data} document as listed lines.

    The position of a field is looked up in the document. Only US venues count;
    a class share is written with a hyphen.
    """
    doc = df.select(F.from_json(payload, "fields array<string>, data array<array<string>>").alias("d"))
    rows = doc.select(F.col("d.fields").alias("fields"), F.explode("d.data").alias("row"))

    def field(name):
        place = F.array_position("fields", F.lit(name))
        return F.trim(F.coalesce(F.get("row", F.when(place > 0, place - 1).cast("int")), F.lit("")))

    ticker = F.upper(field("ticker"))
    name = F.coalesce(F.nullif(field("name"), F.lit("")), ticker)
    return (rows.filter((ticker != "") & field("exchange").isin(list(US_VENUES)))
            .select(F.translate(ticker, ".", "-").alias("symbol"),
                    field("cik").try_cast("long").alias("cik"), name.alias("name"),
                    field("exchange").alias("exchange")))


_OBSERVATION = T.StructType([
    T.StructField("start", T.StringType()), T.StructField("end", T.StringType()),
    T.StructField("val", T.DoubleType()), T.StructField("filed", T.StringType()),
    T.StructField("fp", T.StringType())])
FACTS_DOCUMENT = T.StructType([
    T.StructField("cik", T.LongType()),
    T.StructField("facts", T.MapType(T.StringType(), T.MapType(T.StringType(), T.StructType([
        T.StructField("units", T.MapType(T.StringType(), T.ArrayType(_OBSERVATION)))]))))])


def flatten_facts(df: DataFrame, payload: str = "payload") -> DataFrame:
    """Nested company-facts documents as one long table of observations."""
    doc = df.select(F.from_json(payload, FACTS_DOCUMENT).alias("d")).select("d.cik", "d.facts")
    by_taxonomy = doc.select("cik", F.explode("facts").alias("taxonomy", "tags"))
    by_tag = by_taxonomy.select("cik", "taxonomy", F.explode("tags").alias("tag", "entry"))
    by_unit = by_tag.select("cik", "taxonomy", "tag", F.explode("entry.units").alias("unit", "obs"))
    return by_unit.select("cik", "taxonomy", "tag", "unit", F.explode("obs").alias("o")).select(
        "cik", "taxonomy", "tag", "unit", F.try_to_date("o.start").alias("start"),
        F.try_to_date("o.end").alias("end_"), F.col("o.val").alias("val"),
        F.try_to_date("o.filed").alias("filed"), F.col("o.fp").alias("fp"))


SEARCH = ("quotes array<struct<symbol: string, shortname: string, longname: string, "
          "quoteType: string, exchDisp: string, fullExchangeName: string, industry: string, "
          "sector: string>>, news array<struct<title: string, publisher: string, link: string, "
          "providerPublishTime: bigint, thumbnail: struct<resolutions: "
          "array<struct<url: string, width: int>>>>>")


def parse_search_payload(df: DataFrame, limit: int = 12, payload: str = "payload") -> DataFrame:
    """US-listed equities of each search answer, one row per symbol, best placed first."""
    rows = df.select("query", F.posexplode(F.from_json(payload, SEARCH)["quotes"]).alias("i", "q"))
    venue = F.upper(F.coalesce(F.nullif(F.col("q.exchDisp"), F.lit("")), F.col("q.fullExchangeName"),
                               F.lit("")))
    listed = F.lit(False)
    for prefix in US_VENUE_PREFIXES:
        listed = listed | venue.startswith(prefix.upper())
    symbol = F.upper(F.coalesce("q.symbol", F.lit("")))
    named = F.struct(
        F.coalesce(F.nullif(F.col("q.shortname"), F.lit("")), "q.longname", symbol).alias("name"),
        F.coalesce("q.exchDisp", F.lit("")).alias("exchange"),
        F.coalesce("q.industry", F.lit("")).alias("industry"),
        F.coalesce("q.sector", F.lit("")).alias("sector"))
    firsts = (rows.filter((F.upper("q.quoteType") == "EQUITY") & listed & (symbol != ""))
              .groupBy("query", symbol.alias("symbol"))
              .agg(F.min("i").alias("i"), F.min_by(named, "i").alias("x")))
    w = Window.partitionBy("query").orderBy("i")
    return (firsts.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= limit)
            .select("query", "rank", "symbol", "x.*"))


def smallest_image(resolutions):
    """URL of the narrowest image; without any width, of the first one that has a URL."""
    linked = F.filter(resolutions, lambda r: F.coalesce(r["url"], F.lit("")) != "")
    sized = F.filter(linked, lambda r: F.coalesce(r["width"], F.lit(0)) > 0)
    narrowest = F.array_min(F.transform(sized, lambda r: F.struct(
        r["width"].alias("width"), r["url"].alias("url"))))["url"]
    return F.coalesce(narrowest, F.get(linked, 0)["url"], F.lit(""))


def parse_news_payload(df: DataFrame, limit: int = 6, payload: str = "payload") -> DataFrame:
    rows = df.select("query", F.posexplode(F.from_json(payload, SEARCH)["news"]).alias("i", "n"))
    title = F.trim(F.coalesce("n.title", F.lit("")))
    w = Window.partitionBy("query").orderBy("i")
    return (rows.filter(title != "").withColumn("rank", F.row_number().over(w))
            .filter(F.col("rank") <= limit)
            .select("query", "rank", title.alias("title"),
                    F.coalesce("n.publisher", F.lit("")).alias("publisher"),
                    F.coalesce("n.link", F.lit("")).alias("link"),
                    F.col("n.providerPublishTime").alias("published"),
                    smallest_image(F.col("n.thumbnail.resolutions")).alias("thumb")))
