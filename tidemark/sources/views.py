"""Domain views derived from the star-schema tables.

They give every operator rows that grow with the tables: bars from line items, facts and
vintages from orders, holdings, insider trades and headlines from orders, events and documents.
No view hints a broadcast: Spark measures the sides at run time.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


# Order priorities standing for yield-curve tenors in the test views.
TENOR_OF = {
    "1-URGENT": "3 Mo",
    "2-HIGH": "2 Yr",
    "3-MEDIUM": "10 Yr",
    "4-NOT SPECIFIED": "1 Mo",
    "5-LOW": "30 Yr",
}


# Concepts standing for part-key remainders in the filed-facts view.
CONCEPT_OF = (
    "Revenues", "CostOfRevenue", "NetIncomeLoss", "NetCashProvidedByUsedInOperatingActivities",
    "Assets", "StockholdersEquity", "WeightedAverageNumberOfDilutedSharesOutstanding",
    "EntityCommonStockSharesOutstanding", "RevenueFromContractWithCustomerExcludingAssessedTax",
    "OperatingIncomeLoss", "DepreciationDepletionAndAmortization", "LongTermDebtNoncurrent",
    "CashAndCashEquivalentsAtCarryingValue", "PaymentsToAcquirePropertyPlantAndEquipment",
    "CommonStockSharesOutstanding", "WeightedAverageNumberOfSharesOutstandingBasic",
)
INSTANT_CONCEPTS = (
    "Assets", "StockholdersEquity", "EntityCommonStockSharesOutstanding", "LongTermDebtNoncurrent",
    "CashAndCashEquivalentsAtCarryingValue", "CommonStockSharesOutstanding",
)
SHARE_CONCEPTS = (
    "WeightedAverageNumberOfDilutedSharesOutstanding", "EntityCommonStockSharesOutstanding",
    "CommonStockSharesOutstanding", "WeightedAverageNumberOfSharesOutstandingBasic",
)


class Tables:
    """Parquet tables of one folder, and the domain views over them."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark = spark
        self.folder = folder.rstrip("/")

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return self.table(name)

    # --- market data ---------------------------------------------------------------------

    def raw_bars(self) -> DataFrame:
        """One bar per (brand, ship day). Aggregated map-side first, so a hot brand is split
        over the days before any window sees it."""
        part = self.part.select("p_partkey", "p_brand")
        rows = (
            self.lineitem.join(part, F.col("l_partkey") == F.col("p_partkey"))
            .where(F.col("l_quantity") > 0)
            .select(
                F.col("p_brand").alias("security_id"),
                F.to_date("l_shipdate").alias("trade_date"),
                (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"),
                F.col("l_quantity").alias("quantity"),
                F.struct(
                    "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"
                ).alias("tie"),
            )
        )
        return rows.groupBy("security_id", "trade_date").agg(
            F.min_by("price", "tie").alias("open"),
            F.max("price").alias("high"),
            F.min("price").alias("low"),
            F.max_by("price", "tie").alias("close"),
            F.sum("quantity").alias("volume"),
        )

    def bars(self) -> DataFrame:
        """Bars with a monthly dividend and a yearly split, so total returns are exercised."""
        day, month = F.dayofmonth("trade_date"), F.month("trade_date")
        return self.raw_bars().select(
            "security_id", "trade_date", "open", "high", "low", "close", "volume",
            F.when(day == 15, F.col("close") * 0.01).otherwise(0.0).alias("dividend_cash"),
            F.when((day == 1) & (month == 6), 2.0).otherwise(1.0).alias("split_factor"),
        )

    def bench(self) -> DataFrame:
        """Average close per day: the benchmark, one row per trading day."""
        return self.raw_bars().groupBy("trade_date").agg(F.avg("close").alias("close"))

    # --- fundamentals --------------------------------------------------------------------

    def facts(self) -> DataFrame:
        """Fact versions: company, concept, period end, value, filing day and accession."""
        orders = self.orders.select("o_orderkey", F.to_date("o_orderdate").alias("ordered"))
        return (
            self.lineitem.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
            .select(
                F.col("l_suppkey").alias("company"),
                F.col("l_returnflag").alias("concept"),
                F.last_day("ordered").alias("period_end"),
                F.col("l_extendedprice").alias("value"),
                F.to_date("l_shipdate").alias("filed_date"),
                F.col("l_orderkey").alias("accession"),
                F.col("l_linenumber").cast("bigint").alias("line"),
                F.col("l_partkey").alias("part"),
            )
        )

    def macro(self) -> DataFrame:
        """Vintages: series by order priority, one observation a day, published 0-59 days later."""
        ordered = F.to_date("o_orderdate")
        return self.orders.select(
            F.col("o_orderpriority").alias("series"),
            ordered.alias("observation_date"),
            F.date_add(ordered, (F.col("o_orderkey") % 60).cast("int")).alias("realtime_start"),
            F.col("o_totalprice").alias("value"),
            F.col("o_orderkey").alias("tie"),
        )

    def yields(self) -> DataFrame:
        """Yield observations, long form: a tenor per order priority."""
        tenor = F.create_map(
            *[F.lit(x) for pair in TENOR_OF.items() for x in pair]
        )[F.col("o_orderpriority")]
        return (
            self.orders.groupBy(F.to_date("o_orderdate").alias("observed_on"), tenor.alias("tenor"))
            .agg((F.max("o_totalprice") / 1e7).alias("value"))
        )

    def filed_facts(self) -> DataFrame:
        """Tagged facts with fiscal periods: a concept per part, a span per line number, filed 20
        to 219 days after the period. The last year has no annual filing yet."""
        orders = self.orders.select("o_orderkey", F.to_date("o_orderdate").alias("ordered"))
        rows = self.lineitem.join(orders, F.expr("l_orderkey = o_orderkey"))
        kind = F.col("l_partkey") % 16
        concept = F.element_at(
            F.array(*[F.lit(c) for c in CONCEPT_OF]), (kind + 1).cast("int")
        )
        instant = concept.isin(*INSTANT_CONCEPTS)
        shares = concept.isin(*SHARE_CONCEPTS)
        year = F.year("ordered")
        line = F.col("l_linenumber") % 4
        full_year = (line == 1) & (year < 2001) & ~instant
        quarter_end = F.last_day(F.add_months(F.trunc("ordered", "quarter"), 2))
        jan = F.trunc("ordered", "year")
        end = F.when(full_year, F.make_date(year, F.lit(12), F.lit(31))).otherwise(quarter_end)
        start = F.when(instant, F.lit(None)).when(full_year | (line == 2), jan).otherwise(
            F.trunc("ordered", "quarter")
        )
        value = F.when(
            shares,
            (1000 * (1 + F.col("l_suppkey") % 5)).cast("double")
            * F.when(F.col("l_orderkey") % 100 < 3, 2.0).otherwise(1.0),
        ).otherwise(F.col("l_extendedprice"))
        tagged = rows.select(
            F.col("l_suppkey").alias("company"),
            F.when(concept == "EntityCommonStockSharesOutstanding", "dei").otherwise("us-gaap").alias("taxonomy"),
            concept.alias("concept"),
            F.when(shares, "shares").otherwise("USD").alias("unit"),
            start.alias("period_start"),
            end.alias("period_end"),
            value.alias("value"),
            year.alias("fiscal_year"),
            F.when(full_year, "FY").otherwise("Q").alias("fiscal_period"),
            F.lpad(F.col("l_orderkey").cast("string"), 10, "0").alias("accession"),
            F.date_add(end, (20 + F.col("l_orderkey") % 200).cast("int")).alias("filed_date"),
        )
        key = [c for c in tagged.columns if c != "value"]
        return tagged.groupBy(*key).agg(F.max("value").alias("value"))

    def annual(self) -> DataFrame:
        """Annual facts: fiscal years end with the order's calendar year."""
        facts = self.facts()
        end = F.last_day(F.add_months(F.trunc("period_end", "year"), 11))
        return facts.withColumn("period_end", end).withColumn(
            "period_start", F.date_sub(end, 364)
        )

    def registrants(self) -> DataFrame:
        """Filer spans: a customer's orders within one year stand for one registrant."""
        year = F.year("o_orderdate")
        spans = self.orders.groupBy(F.col("o_custkey").alias("cust"), year.alias("yr")).agg(
            F.min(F.to_date("o_orderdate")).alias("first_filed"),
            F.max(F.to_date("o_orderdate")).alias("last_filed"),
        )
        suffix = F.element_at(
            F.array(*[F.lit(x) for x in (" Inc", " Holdings Corp", " Group")]),
            (F.col("cust") % 3 + 1).cast("int"),
        )
        number = (F.floor(F.col("cust") / 7) % 40).cast("string")
        return spans.select(
            (F.col("cust") * 10 + F.col("yr") % 10).alias("company"),
            F.concat(F.lit("Firm "), number, suffix).alias("legal_name"),
            F.concat(F.lit("T"), F.col("cust").cast("string")).alias("ticker"),
            ((F.col("cust") + F.col("yr")) % 2 == 0).alias("listed"),
            "first_filed",
            "last_filed",
        )

    # --- cross-section -------------------------------------------------------------------

    def snapshots(self) -> DataFrame:
        """Feature snapshots per (month end, supplier), from order-independent aggregates."""
        price = F.col("l_extendedprice") / F.col("l_quantity")
        n = F.count(F.lit(1))
        return (
            self.lineitem.where(F.col("l_quantity") > 0)
            .groupBy(
                F.last_day("l_shipdate").alias("as_of"), F.col("l_suppkey").alias("company")
            )
            .agg(
                F.min("l_discount").alias("earnings_yield"),
                F.max("l_tax").alias("book_to_price"),
                F.min(price).alias("ebitda_to_ev"),
                F.max(price).alias("fcf_yield"),
                F.sum("l_quantity").alias("sales_yield"),
                F.min("l_extendedprice").alias("roe"),
                F.max("l_extendedprice").alias("roic"),
                F.max("l_quantity").alias("gross_margin"),
                F.when(n >= 4, F.min("l_quantity")).alias("debt_to_equity"),
                (F.max(price) / F.min(price) - 1).alias("mom_12_1"),
                F.when(n >= 3, n.cast("double")).alias("mom_6m"),
                F.when(n >= 2, F.max(price) - F.min(price)).alias("vol_3m"),
                F.when(n >= 2, F.max("l_discount") - F.min("l_discount")).alias("beta_1y"),
                F.when(n >= 3, F.max("l_discount")).alias("revenue_growth_yoy"),
                F.when(n >= 5, F.min("l_tax")).alias("revenue_cagr_3y"),
                F.when(n >= 4, F.max("l_orderkey").cast("double")).alias("eps_growth_yoy"),
                F.ln(F.sum("l_quantity")).alias("log_market_cap"),
            )
        )

    def metrics(self) -> DataFrame:
        """Long company metrics from customers and their orders."""
        orders = self.orders.groupBy("o_custkey").agg(
            F.sum(F.round(F.col("o_totalprice") * 100).cast("bigint")).alias("cents"),
            F.count(F.lit(1)).alias("n"),
            F.max("o_totalprice").alias("largest"),
        )
        wide = self.customer.join(
            orders, F.col("c_custkey") == F.col("o_custkey"), "left"
        ).select(
            F.col("c_custkey").alias("company"),
            F.col("c_name").alias("name"),
            F.col("c_mktsegment").alias("sector"),
            F.col("c_nationkey").alias("grp"),
            (F.col("cents") / 100.0).alias("revenue"),
            F.col("n").cast("double").alias("pe_ratio"),
            F.col("largest").alias("market_cap"),
            F.col("c_acctbal").alias("net_income"),
        )
        return wide.unpivot(
            ["company", "name", "sector", "grp"],
            ["revenue", "pe_ratio", "market_cap", "net_income"],
            "metric",
            "value",
        ).where(F.col("value").isNotNull())

    def securities(self) -> DataFrame:
        """Listings from parts: ticker, exchange, activity and last sighting."""
        key = F.col("p_partkey")
        seen = F.date_add(F.to_date(F.lit("2000-01-01")), (key % 700).cast("int"))
        return self.part.select(
            key.alias("security"),
            F.concat(F.upper(F.substring("p_name", 1, 3)), (key % 50).cast("string")).alias("ticker"),
            F.col("p_brand").alias("exchange"),
            (key % 3 != 0).alias("is_active"),
            F.when(key % 5 != 0, seen).alias("last_seen"),
            (key % 400).alias("company"),
            F.col("p_name").alias("name"),
        )

    def filings(self) -> DataFrame:
        """A filing index from orders."""
        form = (
            F.when(F.col("o_orderpriority") == "1-URGENT", "10-K")
            .when(F.col("o_orderpriority") == "2-HIGH", "10-K/A")
            .when(F.col("o_orderpriority") == "3-MEDIUM", "10-Q")
            .when(F.col("o_orderpriority") == "4-NOT SPECIFIED", "8-K")
            .otherwise("4")
        )
        status = (
            F.when(F.col("o_orderstatus") == "F", "loaded")
            .when(F.col("o_orderstatus") == "O", "not_loaded")
            .otherwise("failed")
        )
        version = F.when(F.col("o_orderkey") % 3 == 1, "2026.09-5").when(
            F.col("o_orderkey") % 3 == 2, "old"
        )
        return self.orders.select(
            F.col("o_custkey").alias("company"),
            F.col("o_orderkey").alias("accession"),
            F.to_date("o_orderdate").alias("filed_date"),
            form.alias("form"),
            status.alias("status"),
            version.alias("version"),
        )

    def fetched_bars(self) -> DataFrame:
        """Bars with the fetch that supplied them and its adjusted close."""
        adjusted = F.when(F.dayofmonth("trade_date") % 2 == 0, F.col("close") / 2)
        return self.raw_bars().withColumn(
            "fetch_id", F.month("trade_date").cast("bigint")
        ).withColumn("adj_close", adjusted)

    # --- ownership and insiders ----------------------------------------------------------

    def holdings(self) -> DataFrame:
        orders = self.orders.select(
            "o_orderkey", F.col("o_custkey").alias("manager"), "o_orderstatus",
            F.to_date("o_orderdate").alias("filed"),
        )
        kind = (
            F.when(F.col("o_orderstatus") == "F", "original")
            .when(F.col("o_orderstatus") == "O", "restatement")
            .otherwise("new_holdings")
        )
        quarter_end = F.last_day(F.add_months(F.trunc("filed", "quarter"), 2))
        return self.lineitem.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(
            "manager",
            F.col("l_partkey").alias("cusip"),
            quarter_end.alias("period"),
            "filed",
            kind.alias("kind"),
            F.col("l_orderkey").alias("accession"),
            F.when(F.col("l_returnflag") == "R", "Put").alias("put_call"),
            F.when(F.col("l_linestatus") == "F", "SH").otherwise("PRN").alias("amount_type"),
            F.col("l_quantity").alias("amount"),
            F.col("l_extendedprice").alias("value"),
        )

    def insider(self) -> DataFrame:
        code = F.when(F.col("event_type") == "purchase", "P").when(
            F.col("event_type") == "click", "S"
        ).otherwise(F.upper(F.substring("event_type", 1, 1)))
        return self.events.select(
            F.col("event_id").alias("tx_id"),
            (F.col("user_id") % 10).alias("company"),
            F.col("user_id").alias("owner"),
            code.alias("code"),
            F.to_date("ts").alias("tx_date"),
            F.get_json_object("props", "$.k").cast("double").alias("shares"),
            F.col("value").alias("price"),
        )

    # --- text ----------------------------------------------------------------------------

    def news(self) -> DataFrame:
        """Headlines: an event of a user about a document, with its first line as title."""
        # only first lines are sent to the join
        docs = self.documents.select("doc_id", F.substring_index("text", "\n", 1).alias("title"), "source")
        count = self.documents.agg(F.count(F.lit(1)).alias("n_docs"))
        return (
            self.events.crossJoin(F.broadcast(count))  # one row
            .withColumn("doc_key", F.col("event_id") % F.col("n_docs"))
            .join(docs, F.col("doc_key") == F.col("doc_id"))
            .select(
                F.col("event_id").alias("news_id"),
                F.col("user_id").alias("company"),
                F.col("ts").alias("seen_at"),
                F.unix_micros(F.col("ts").cast("timestamp")).alias("seen_us"),
                "title",
                F.col("source").alias("domain"),
                "doc_id",
            )
        )

    def passages(self) -> DataFrame:
        """Documents split by line, with offsets into the document text."""
        lines = self.documents.select(
            "doc_id", "source", "lang",
            F.posexplode(F.split("text", "\n")).alias("ordinal", "text"),
        )
        w = Window.partitionBy("doc_id").orderBy("ordinal")
        before = F.coalesce(
            F.sum(F.length("text") + 1).over(w.rowsBetween(Window.unboundedPreceding, -1)),
            F.lit(0),
        )
        return lines.withColumn("char_start", before).withColumn(
            "char_end", F.col("char_start") + F.length("text")
        )
