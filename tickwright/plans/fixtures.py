"""The driver's tables seen as market data (see FIXTURES.md).

A symbol is a supplier nation, a sector its region, a session a ship date, and a
close the quantity-weighted retail price, plus the index symbol MARKET.
"""

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas

INDEX = "MARKET"

# The small literal inputs of the fixtures.
MARKET_EVENTS = [("1995-08-19", "first shock", "crisis"),
                 ("1997-10-27", "second shock", "crisis"),
                 ("1999-03-29", "turn", "recovery"),
                 ("2000-03-10", "peak", "milestone")]
CUTOFF_DATES = ["1997-06-30", "2000-12-31", "2001-11-04"]
PORTFOLIOS = [("equal", "NATION_0", 0.25), ("equal", "NATION_1", 0.25),
              ("equal", "NATION_2", 0.25), ("equal", "NATION_3", 0.25),
              ("pair", "NATION_4", 0.7), ("pair", "NATION_5", 0.3),
              ("single", "NATION_6", 1.0)]


class Fixtures:
    """Lazily built frames over one scale directory."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir.rstrip("/")

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    @cached_property
    def nations(self):
        n, r = self.table("nation"), self.table("region")
        return (n.join(r, n.n_regionkey == r.r_regionkey)
                .select(F.col("n_name").alias("symbol"), F.col("n_nationkey").alias("nk"),
                        F.col("n_regionkey").cast("long").alias("rk"),
                        F.col("r_name").alias("sector")))

    @cached_property
    def trades(self):
        li, s, p = self.table("lineitem"), self.table("supplier"), self.table("part")
        return (li.join(s, li.l_suppkey == s.s_suppkey)
                .join(self.nations, F.col("s_nationkey") == F.col("nk"))
                .join(p, li.l_partkey == p.p_partkey)
                .select("symbol", "nk", "sector", F.col("l_shipdate").cast("date").alias("date"),
                        F.col("p_retailprice").alias("px"),
                        F.round(F.col("p_retailprice") * 100).cast("long").alias("cents"),
                        F.col("l_quantity").cast("long").alias("qty"),
                        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq")))

    @cached_property
    def bars(self):
        """Daily bars per symbol, and the index rolled up from the same partials."""
        order_key = F.col("seq") * 10000 + F.col("px")
        per = self.trades.groupBy("symbol", "date").agg(
            F.min_by("px", order_key).alias("open"), F.min(order_key).alias("k"),
            F.max("px").alias("high"), F.min("px").alias("low"),
            F.sum(F.col("cents") * F.col("qty")).alias("notional"),
            F.sum("qty").alias("volume"))
        index = (per.groupBy("date").agg(
            F.min_by("open", "k").alias("open"), F.max("high").alias("high"),
            F.min("low").alias("low"), F.sum("notional").alias("notional"),
            F.sum("volume").alias("volume")).withColumn("symbol", F.lit(INDEX)))
        price = F.col("notional").cast("double") / (100.0 * F.col("volume").cast("double"))
        return (per.drop("k").unionByName(index)
                .select("symbol", "date", "open", "high", "low", price.alias("close"),
                        price.alias("adj_close"), "volume"))

    @cached_property
    def stocks(self):
        return self.bars.filter(F.col("symbol") != INDEX)

    @cached_property
    def index_bars(self):
        return self.bars.filter(F.col("symbol") == INDEX)

    @cached_property
    def symbols(self):
        rows = self.nations.select(
            "symbol", F.concat("symbol", F.lit(" Inc")).alias("name"), "sector",
            F.concat("sector", F.lit(" Industry")).alias("industry"), F.lit(0).alias("is_index"))
        index = self.spark.createDataFrame(
            [(INDEX, "Market Index", "Index", "Broad Market Index", 1)], schemas.SYMBOLS)
        return rows.unionByName(index)

    @cached_property
    def universe(self):
        return self.nations.select(
            "symbol", F.col("rk").alias("cik"), F.concat("symbol", F.lit(" Inc")).alias("name"),
            "sector", F.when(F.col("nk") % 2 == 0, "NYSE").otherwise("Nasdaq").alias("exchange"))

    @cached_property
    def orders_n(self):
        o, c = self.table("orders"), self.table("customer")
        return (o.join(c, o.o_custkey == c.c_custkey)
                .join(self.nations, F.col("c_nationkey") == F.col("nk"))
                .select("nk", "symbol", "sector", "o_orderkey", "o_orderpriority",
                        F.col("o_orderdate").cast("date").alias("d"),
                        F.col("o_totalprice").alias("v")))

    @cached_property
    def company_events(self):
        """Every order is an event of its nation; each nation also has one before the record."""
        orders = self.orders_n.select(
            "symbol", F.col("d").alias("date"),
            F.concat(F.lit("Order "), F.col("o_orderkey").cast("string")).alias("title"),
            F.lit("order").alias("description"), F.col("o_orderpriority").alias("category"),
            F.lit("orders").alias("source"))
        founding = self.table("nation").select(
            F.col("n_name").alias("symbol"), F.lit("1990-01-01").cast("date").alias("date"),
            F.lit("Founding").alias("title"), F.lit("before the record").alias("description"),
            F.lit("1-URGENT").alias("category"), F.lit("fixture").alias("source"))
        return orders.unionByName(founding)

    @cached_property
    def categories(self):
        p = F.col("o_orderpriority")
        return self.table("orders").select(
            p.alias("name"), F.lit("neutral").alias("tone"), p.alias("label")).distinct()

    @cached_property
    def market_events(self):
        from datetime import date
        rows = [(date.fromisoformat(d), t, c, t) for d, t, c in MARKET_EVENTS]
        return self.spark.createDataFrame(rows, schemas.MARKET_EVENTS)

    @cached_property
    def cutoffs(self):
        dates = F.array(*[F.lit(d).cast("date") for d in CUTOFF_DATES])
        return self.symbols.select("symbol", F.explode(dates).alias("asof"))

    @cached_property
    def portfolios(self):
        return self.spark.createDataFrame(PORTFOLIOS, schemas.PORTFOLIOS)

    @cached_property
    def fundamentals(self):
        def window_sum(lo, hi):
            inside = F.col("d") > F.lit(lo).cast("date")
            if hi:
                inside = inside & (F.col("d") <= F.lit(hi).cast("date"))
            return F.round(F.sum(F.when(inside, F.col("v")).otherwise(0.0)), 2)

        rev = self.orders_n.groupBy("symbol", "nk").agg(
            window_sum("2000-08-01", None).alias("r0"),
            window_sum("1999-08-01", "2000-08-01").alias("r1"),
            window_sum("1998-08-01", "1999-08-01").alias("r2")).filter("nk % 8 <> 7")
        r0, r1, r2, nk = F.col("r0"), F.col("r1"), F.col("r2"), F.col("nk")

        def unless(k, x):
            return F.when(nk % k != 0, x)

        cols = {
            "revenue": r0, "revenue_prior": r1, "net_income": r0 - r1,
            "net_income_prior": r1 - r2, "gross_profit": 0.4 * r0, "gross_profit_prior": 0.4 * r1,
            "operating_income": 0.2 * r0, "operating_income_prior": 0.2 * r1,
            "interest_expense": unless(5, 0.01 * r0), "interest_expense_prior": 0.01 * r1,
            "ocf": 0.15 * r0, "ocf_prior": 0.15 * r1, "capex": unless(4, 0.05 * r0),
            "capex_prior": 0.05 * r1, "assets": 2.0 * r0, "liabilities": 1.2 * r0,
            "equity": F.when(nk % 6 == 0, -0.1 * r0).otherwise(0.8 * r0),
            "assets_current": 0.5 * r0, "liabilities_current": unless(7, 0.3 * r1),
            "long_term_debt": 0.3 * r1, "short_term_debt": unless(3, 0.05 * r1),
            "shares_outstanding": (1000 * (nk + 1)).cast("double"),
            "earnings_stability": F.lit(None).cast("double"),
        }
        return rev.select("symbol", nk.cast("long").alias("cik"),
                          F.lit("2001-08-01").cast("date").alias("asof"),
                          *[c.alias(k) for k, c in cols.items()])

    @cached_property
    def analyst(self):
        """Consensus figures of most nations, counted from their customers, through a file and its reader."""
        from pyspark.sql import functions as F

        from ..session import scratch_path
        from ..sources.dimensions import read_analyst
        c, n = self.table("customer"), self.table("nation")
        rich = F.sum((F.col("c_acctbal") > 5000).cast("int"))
        building = F.sum((F.col("c_mktsegment") == "BUILDING").cast("int"))
        rows = (c.join(n, c.c_nationkey == n.n_nationkey).groupBy("n_nationkey", F.col("n_name").alias("symbol"))
                .agg(F.count("*").alias("n"), rich.alias("rich"), building.alias("building"))
                .filter("n_nationkey % 9 <> 4").select(
                    "symbol", (F.col("rich") / F.col("n")).alias("analyst_score"),
                    F.when(F.col("n_nationkey") % 5 > 0, F.col("building") / F.col("n")).alias("target_upside"),
                    ((F.col("rich") - F.col("building")) / F.col("n")).alias("eps_revision"),
                    F.col("n").cast("double").alias("n_analysts"), F.lit("2001-08-01").alias("fetched")))
        path = scratch_path(self.spark, "analyst-csv")
        rows.write.option("header", True).csv(path)
        return read_analyst(self.spark, path)

    @cached_property
    def part_panel(self):
        """Every part as a company of its brand, each metric a ratio of two figures of its sales.

        The panel of nations has 25 rows at every scale; this one grows with the parts.
        """
        from pyspark.sql import functions as F

        from ..operators.ranking import METRICS
        from ..session import persist_table
        sold = self.table("lineitem").groupBy(F.col("l_partkey").alias("p_partkey")).agg(
            F.count("*").alias("b0"), F.sum(F.col("l_quantity").cast("long")).alias("b1"),
            F.max(F.col("l_quantity").cast("long")).alias("b2"), F.min(F.col("l_quantity").cast("long")).alias("b3"),
            F.sum((F.col("l_returnflag") == "R").cast("long")).alias("b4"), F.sum((F.col("l_returnflag") == "A").cast("long")).alias("b5"),
            F.sum((F.col("l_shipdate") < "1998-01-01").cast("long")).alias("b6"))
        parts = self.table("part").join(sold, "p_partkey", "left").withColumns(
            {f"b{i}": F.coalesce(f"b{i}", F.lit(0).cast("long")) for i in range(7)}
            | {"b7": F.col("p_size").cast("long"), "b8": F.round(F.col("p_retailprice") * 100).cast("long")})
        key = F.col("p_partkey")
        metrics = [F.when(key % (i + 7) != 3, F.col(f"b{i % 9}").cast("double") / (F.col(f"b{(5 * i + 2) % 9}") + 1)).alias(m.key)
                   for i, m in enumerate(METRICS)]
        return persist_table(parts.select(
            F.concat(F.lit("P"), key.cast("string")).alias("symbol"), F.col("p_name").alias("name"),
            F.when(key % 40 > 0, F.col("p_brand")).alias("sector"), F.lit("").alias("exchange"), F.lit(0).alias("is_index"),
            F.col("p_retailprice").alias("last_close"), (F.col("b8") * 1000000.0).alias("market_cap"), *metrics), "part-panel")

    @cached_property
    def facts(self):
        """Quarterly revenue with restatements, some annual rows, one instant tag."""
        by = self.orders_n
        quarter = (by.groupBy("nk", F.trunc("d", "quarter").alias("q"))
                   .agg(F.round(F.sum("v"), 2).alias("val")))
        year = (by.filter("nk % 2 = 0").groupBy("nk", F.trunc("d", "year").alias("q"))
                .agg(F.round(F.sum("v"), 2).alias("val")))

        def rows(src, tag, start, end_months, val, filed_months, where=None):
            src = src.filter(where) if where else src
            return src.select(
                F.col("nk").cast("long").alias("cik"), F.lit("us-gaap").alias("taxonomy"),
                F.lit(tag).alias("tag"), F.lit("USD").alias("unit"),
                (F.col("q") if start else F.lit(None).cast("date")).alias("start"),
                F.date_sub(F.add_months("q", end_months), 1).alias("end_"),
                val.alias("val"), F.add_months("q", filed_months).alias("filed"))

        v = F.col("val")
        return (rows(quarter, "Revenues", True, 3, v, 4)
                .unionByName(rows(quarter, "Revenues", True, 3, F.round(1.01 * v, 2), 7,
                                  "month(q) = 1"))
                .unionByName(rows(year, "Revenues", True, 12, v, 14))
                .unionByName(rows(quarter, "Assets", False, 3, F.round(2 * v, 2), 4)))

    @cached_property
    def price_metrics(self):
        from ..operators.metrics import price_metrics
        return price_metrics(self.stocks, self.index_bars)

    @cached_property
    def panel(self):
        """The metric panel, written once like every rollup that scores re-read."""
        from ..operators.metrics import metric_panel
        from ..session import persist_table
        return persist_table(metric_panel(self.universe, self.price_metrics, self.fundamentals,
                                          self.analyst), "panel")

    @cached_property
    def questions(self):
        """A question per order, and every conversation turn as it is."""
        from pyspark.sql.functions import col, concat, lit, when
        o = self.table("orders")
        key = col("o_orderkey")

        def text(*parts):
            return concat(*[p if not isinstance(p, str) else lit(p) for p in parts])

        a = concat(lit("NATION_"), (col("o_custkey") % 25).cast("string"))
        b = concat(lit("nation_"), (F.floor(key / 8) % 25).cast("string"))
        n = (F.floor(key / 8) % 60).cast("string")
        year = (1990 + F.floor(key / 8) % 14).cast("string")
        forms = [
            text("Compare ", a, " and ", b, " since ", year),
            text("top ", n, " Asia companies over the past ", n, " years"),
            text("Which stock had the highest trading volume in ", year, "?"),
            text("five worst performers last ", n, " quarters"),
            text("How did ", a, " Inc perform within the last month"),
            text("Which sector performed best? technology or AFRICA"),
            text("How has the market done over the last twenty wks"),
            text("biggest drawdown of ", b, ", then ", a),
        ]
        asked = forms[-1]
        for i in range(len(forms) - 1):
            asked = when(key % 8 == i, forms[i]).otherwise(asked)
        stated = [
            when(key % 40 == 3, "1996-02-01").when(key % 40 == 11, "1990-01-01").when(key % 40 == 19, "soon").alias("asked_start"),
            when(key % 80 == 3, "1999-01-31").when(key % 80 == 27, "2030-01-01").alias("asked_end"),
            when(key % 50 == 4, 7).when(key % 50 == 5, 70).alias("asked_limit"),
            when(key % 30 == 5, " Volume ").alias("asked_metric"),
            when(key % 30 == 6, "ASC").when(key % 30 == 7, "sideways").alias("asked_ordering")]
        return (o.select(concat(lit("o"), key.cast("string")).alias("question_id"), asked.alias("text"), *stated)
                .unionByName(self.table("conversations").select(
                    F.concat_ws("-", lit("c"), "conv_id", "turn").alias("question_id"), "text"), True))

    @cached_property
    def terms(self):
        n = self.nations
        name = F.lower("symbol")
        parts = F.array(name, F.substring(name, 1, 5), F.substring(name, 5, 20), F.lit(" inc "),
                        F.lower("sector"))
        ships = self.table("orders").select(F.lower("o_orderpriority").alias("term")).distinct()
        return n.select(F.explode(parts).alias("term")).unionByName(ships).distinct()
