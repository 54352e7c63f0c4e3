"""Discounted cash flow, residual income and dividend models for all companies at once.

Each projection is a ten-step fold inside one row, so valuing a table needs no shuffle. Invalid
assumptions give a null value and a message, never a substitute.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.functions import expr as E
from tidemark.functions.expr import clamp
from tidemark.operators import metrics as M
from tidemark.operators import ranking as R
from tidemark.operators import statements as S

YEARS, STAGE_ONE, MIN_SPREAD = 10, 5, 0.005
# Scenario shifts (growth, margin, discount rate, terminal growth).
SCENARIOS = {
    "bear": (-0.03, -0.02, 0.01, -0.005),
    "base": (0.0, 0.0, 0.0, 0.0),
    "bull": (0.03, 0.02, -0.01, 0.005),
}
STEPS = (-0.01, -0.005, 0.0, 0.005, 0.01)
WIDE_STEPS = (-0.04, -0.02, 0.0, 0.02, 0.04)
# Equity premium, terminal growth, statutory tax, fallback risk-free rate.
EQUITY_PREMIUM, TERMINAL_GROWTH, STATUTORY_TAX, FALLBACK_RATE = 0.05, 0.025, 0.21, 0.045


def cost_of_equity() -> Column:
    return F.col("risk_free") + F.col("beta") * F.col("equity_risk_premium")


def wacc() -> Column:
    """Weighted cost of capital; null unless equity plus debt is positive."""
    total = F.col("equity_value") + F.col("debt_value")
    debt = F.col("debt_value") / total
    after_tax = F.col("pre_tax_cost_of_debt") * (1 - F.col("tax_rate"))
    return F.when(total > 0, (1 - debt) * cost_of_equity() + debt * after_tax)


def _fade(start: Column, end: Column, year: Column) -> Column:
    part = (year - STAGE_ONE) / (YEARS - STAGE_ONE)
    return F.when(year <= STAGE_ONE, start).otherwise(start + (end - start) * part)


def _years() -> Column:
    return F.sequence(F.lit(1), F.lit(YEARS))


def _rate_error(rate: Column, growth: Column) -> Column:
    return F.when(
        rate - growth < MIN_SPREAD, F.lit("discount rate must exceed terminal growth")
    ).when(~growth.between(-0.05, 0.06), F.lit("terminal growth out of range"))


def _result(rows: DataFrame, error: Column, explicit, terminal, equity, per_share) -> DataFrame:
    out = rows.withColumn("error", error)
    good = F.col("error").isNull()
    for name, value in (("pv_explicit", explicit), ("pv_terminal", terminal), ("equity", equity), ("per_share", per_share)):
        out = out.withColumn(name, F.when(good, value))
    return out


def dcf(rows: DataFrame) -> DataFrame:
    """Ten-year two-stage free cash flow to the firm. Columns: base_revenue, growth, margin,
    long_run_margin, terminal_growth, tax_rate, sales_to_capital, discount_rate, terminal_roic,
    debt, cash, shares."""
    c = F.col
    rate, g = c("discount_rate"), c("terminal_growth")
    ronic = F.coalesce("terminal_roic", "discount_rate")
    error = F.coalesce(
        _rate_error(rate, g),
        F.when(c("base_revenue") <= 0, F.lit("revenue must be positive")),
        F.when(c("sales_to_capital") <= 0, F.lit("sales to capital must be positive")),
        F.when(~((c("tax_rate") >= 0) & (c("tax_rate") < 1)), F.lit("tax rate out of range")),
        F.when(c("shares") <= 0, F.lit("share count must be positive")),
        F.when(ronic <= 0, F.lit("return on new capital must be positive")),
    )

    def step(acc: Column, year: Column) -> Column:
        revenue = acc["revenue"] * (1 + _fade(c("growth"), g, year))
        income = revenue * _fade(c("margin"), c("long_run_margin"), year)
        taxed = F.when(income > 0, income * (1 - c("tax_rate"))).otherwise(income)
        flow = taxed - (revenue - acc["revenue"]) / c("sales_to_capital")
        return F.struct(
            revenue.alias("revenue"), (acc["pv"] + flow / F.pow(1 + rate, year)).alias("pv")
        )

    start = F.struct(c("base_revenue").cast("double").alias("revenue"), F.lit(0.0).alias("pv"))
    rows = rows.withColumn("_path", F.when(error.isNull(), F.aggregate(_years(), start, step)))
    last = c("_path.revenue") * (1 + g) * c("long_run_margin") * (1 - c("tax_rate"))
    terminal = last * (1 - g / ronic) / (rate - g) / F.pow(1 + rate, F.lit(YEARS))
    equity = c("_path.pv") + terminal - c("debt") + c("cash")
    return _result(rows, error, c("_path.pv"), terminal, equity, equity / c("shares")).drop("_path")


def rim(rows: DataFrame) -> DataFrame:
    """Residual income over book value. Columns: book_value, roe, long_run_roe, payout_ratio,
    cost_of_equity, terminal_growth, shares."""
    c = F.col
    rate, g = c("cost_of_equity"), c("terminal_growth")
    long_run = F.coalesce("long_run_roe", "cost_of_equity")
    error = F.coalesce(
        _rate_error(rate, g),
        F.when(c("book_value") <= 0, F.lit("book value must be positive")),
        F.when(~c("payout_ratio").between(0, 1), F.lit("payout ratio out of range")),
        F.when(c("shares") <= 0, F.lit("share count must be positive")),
    )

    def step(acc: Column, year: Column) -> Column:
        roe = _fade(c("roe"), long_run, year)
        gain = (roe - rate) * acc["book"] / F.pow(1 + rate, year)
        book = acc["book"] * (1 + roe * (1 - c("payout_ratio")))
        return F.struct(book.alias("book"), (acc["pv"] + gain).alias("pv"))

    start = F.struct(c("book_value").cast("double").alias("book"), F.lit(0.0).alias("pv"))
    rows = rows.withColumn("_path", F.when(error.isNull(), F.aggregate(_years(), start, step)))
    terminal = (long_run - rate) * c("_path.book") / (rate - g) / F.pow(1 + rate, F.lit(YEARS))
    equity = c("book_value") + c("_path.pv") + terminal
    return _result(rows, error, c("_path.pv"), terminal, equity, equity / c("shares")).drop("_path")


def ddm(rows: DataFrame) -> DataFrame:
    """Two-stage dividends. Columns: dividend_per_share, growth, terminal_growth, cost_of_equity."""
    c = F.col
    rate, g = c("cost_of_equity"), c("terminal_growth")
    error = F.coalesce(
        _rate_error(rate, g), F.when(c("dividend_per_share") <= 0, F.lit("dividend must be positive"))
    )

    def step(acc: Column, year: Column) -> Column:
        dividend = acc["dividend"] * (1 + _fade(c("growth"), g, year))
        paid = acc["pv"] + dividend / F.pow(1 + rate, year)
        return F.struct(dividend.alias("dividend"), paid.alias("pv"))

    start = F.struct(c("dividend_per_share").cast("double").alias("dividend"), F.lit(0.0).alias("pv"))
    rows = rows.withColumn("_path", F.when(error.isNull(), F.aggregate(_years(), start, step)))
    terminal = c("_path.dividend") * (1 + g) / (rate - g) / F.pow(1 + rate, F.lit(YEARS))
    value = c("_path.pv") + terminal
    none = F.lit(None).cast("double")
    return _result(rows, error, c("_path.pv"), terminal, none, value).drop("_path")


MODELS = {"dcf": dcf, "rim": rim, "ddm": ddm}
# The columns each driver shifts, per model.
DRIVERS = {
    "dcf": {"growth": ["growth"], "margin": ["margin", "long_run_margin"], "rate": ["discount_rate"]},
    "rim": {"growth": [], "margin": ["roe", "long_run_roe"], "rate": ["cost_of_equity"]},
    "ddm": {"growth": ["growth"], "margin": [], "rate": ["cost_of_equity"]},
}


def _shift(rows: DataFrame, model: str, growth, margin, rate, terminal) -> DataFrame:
    drivers = DRIVERS[model]
    moves = {c: growth for c in drivers["growth"]} | {c: margin for c in drivers["margin"]}
    moves |= {c: rate for c in drivers["rate"]} | {"terminal_growth": terminal}
    return rows.withColumns({c: F.col(c) + move for c, move in moves.items()})


def scenarios(rows: DataFrame, model: str) -> DataFrame:
    """Bear, base and bull values with upside against the price column."""
    table = F.array(*[
        F.struct(F.lit(n).alias("name"), *[F.lit(v).alias(k) for k, v in zip("gmrt", shift)])
        for n, shift in SCENARIOS.items()
    ])
    spread = rows.withColumn("_s", F.explode(table))
    moved = _shift(spread, model, *[F.col(f"_s.{k}") for k in "gmrt"])
    valued = MODELS[model](moved.withColumn("scenario", F.col("_s.name")).drop("_s"))
    return valued.withColumn("upside", F.when(F.col("price") > 0, F.col("per_share") / F.col("price") - 1))


def sensitivity(rows: DataFrame, model: str, first: str, second: str) -> DataFrame:
    """A 5 × 5 grid of per-share values over two drivers (growth, margin, rate, terminal)."""
    steps = lambda d: STEPS if d in ("rate", "terminal") else WIDE_STEPS
    grid = F.array(*[
        F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"))
        for a in steps(first) for b in steps(second)
    ])
    spread = rows.withColumn("_g", F.explode(grid))
    zero = F.lit(0.0)
    move = {"growth": zero, "margin": zero, "rate": zero, "terminal": zero}
    move[first], move[second] = F.col("_g.a"), F.col("_g.b")
    moved = _shift(spread, model, move["growth"], move["margin"], move["rate"], move["terminal"])
    named = moved.withColumn("row_step", F.col("_g.a")).withColumn("column_step", F.col("_g.b"))
    return MODELS[model](named.drop("_g"))


def risk_free(yields: DataFrame, tenor: str = "10 Yr") -> DataFrame:
    """Latest par yield of a tenor and its day."""
    rows = yields.where(F.col("tenor") == tenor)
    return rows.agg(
        F.max_by("value", "observed_on").alias("risk_free"), F.max("observed_on").alias("observed_on")
    )


def defaults(
    facts: DataFrame, companies: DataFrame, betas: DataFrame, yields: DataFrame, prices: DataFrame
) -> DataFrame:
    """Model assumptions from data, each bounded, with the fallback stated in a source column."""
    known = S.prepared(facts)
    years = S.fiscal_years(known)
    annual = S.build_statements(known, years, "annual")
    quarterly = S.build_statements(known, years, "quarterly")
    basis = M.wide_basis(M.ttm_basis(quarterly).unionByName(M.fy_basis(annual)))
    v = M.basis_values()
    latest = {
        "debt": v.debt(), "cash": v.cur("cash"), "interest": v.cur("interest_expense"),
        "revenue": F.when(v.cur("operating_income").isNotNull(), v.cur("revenue")),
        "operating_income": F.when(v.cur("revenue").isNotNull(), v.cur("operating_income")),
        "year_ago": v.prev("revenue"), "book": v.cur("total_equity"),
        "net_income": F.when(v.cur("total_equity").isNotNull(), v.cur("net_income")),
        "book_before": v.prev("total_equity"), "dividends": v.cur("dividends_paid"),
    }
    found = M.first_basis(basis, latest, [])
    figure = found.groupBy("company").agg(
        *[F.max(F.when(F.col("metric") == m, F.col("value"))).alias(m) for m in latest]
    )
    wide = M.wide(annual)
    last = wide.groupBy("company").agg(F.max("idx").alias("_last"))
    recent = wide.join(last, "company").withColumn("_back", F.col("_last") - F.col("idx"))
    at = lambda item, back: F.max(F.when(F.col("_back") == back, F.col(item)))
    margin = F.when(F.col("revenue") > 0, F.col("operating_income") / F.col("revenue"))
    past = recent.groupBy("company").agg(
        at("revenue", 0).alias("_r0"), at("revenue", 3).alias("_r3"),
        F.avg(F.when(F.col("_back") < 5, margin)).alias("_margins"),
        F.sum(F.when(F.col("_back") < 3, F.col("income_tax"))).alias("_tax"),
        F.sum(F.when(F.col("_back") < 3, F.col("pretax_income"))).alias("_pretax"),
        F.max("end").alias("reference"),
    )
    dated = past.join(M.last_price(prices), "company", "left").withColumn(
        "reference", F.coalesce("price_date", "reference")
    )
    shares = S.shares_for_market_cap(facts, dated.select("company", "reference"))
    rate = risk_free(yields).select(F.col("risk_free").alias("_rf"))
    joined = (
        companies.join(figure, "company")
        .join(dated, "company", "left")
        .join(shares.select("company", F.col("shares").cast("double").alias("shares")), "company", "left")
        .join(betas.select("company", "adjusted"), "company", "left")
        .crossJoin(F.broadcast(rate))  # one row
    )
    c = F.col
    rf = F.coalesce("_rf", F.lit(FALLBACK_RATE))
    debt, cash = F.coalesce("debt", F.lit(0.0)), F.coalesce("cash", F.lit(0.0))
    growth3 = F.when((c("_r0") > 0) & (c("_r3") > 0), F.pow(c("_r0") / c("_r3"), F.lit(1 / 3)) - 1)
    year = F.when(c("year_ago") > 0, c("revenue") / c("year_ago") - 1).otherwise(0.0)
    invested = F.coalesce("book", F.lit(0.0)) + debt - cash
    average = F.when(c("book_before").isNotNull(), (c("book") + c("book_before")) / 2).otherwise(c("book"))
    tax = F.when(c("_pretax") > 0, clamp(c("_tax") / c("_pretax"), 0.10, 0.30))
    cost = F.when(
        (c("interest") > 0) & (debt > 0),
        F.greatest(rf, F.least(rf + 0.08, c("interest") / debt)),
    )
    payout = F.when(c("net_income") > 0, clamp(F.coalesce("dividends", F.lit(0.0)) / c("net_income"), 0.0, 1.0))
    has_dcf = (c("shares") > 0) & (c("revenue") > 0)
    has_rim = (c("shares") > 0) & (c("book") > 0) & c("net_income").isNotNull()
    financial = c("sic").cast("int").between(6000, 6799)
    return joined.select(
        "company", rf.alias("risk_free"), F.lit(EQUITY_PREMIUM).alias("equity_risk_premium"),
        F.coalesce(clamp("adjusted", 0.3, 3.0), F.lit(1.0)).alias("beta"),
        F.when(c("adjusted").isNotNull(), "weekly returns").otherwise("assumed 1.0").alias("beta_source"),
        F.coalesce(tax, F.lit(STATUTORY_TAX)).alias("tax_rate"),
        F.when(tax.isNotNull(), "effective, bounded").otherwise("statutory").alias("tax_source"),
        F.coalesce(cost, rf + 0.015).alias("pre_tax_cost_of_debt"),
        F.coalesce(c("price").cast("double") * c("shares"), F.greatest(F.coalesce("book", F.lit(0.0)), F.lit(0.0))).alias("equity_value"),
        debt.alias("debt"), cash.alias("cash"), "shares",
        F.least(F.lit(TERMINAL_GROWTH), rf).alias("terminal_growth"),
        F.when(has_dcf, c("revenue")).alias("base_revenue"),
        F.when(has_dcf, clamp(F.coalesce(growth3, year), -0.10, 0.30)).alias("growth"),
        F.when(has_dcf, c("operating_income") / c("revenue")).alias("margin"),
        F.when(has_dcf, F.coalesce(c("_margins"), c("operating_income") / c("revenue"))).alias("long_run_margin"),
        F.when(has_dcf, F.when(invested > 0, clamp(c("revenue") / invested, 0.5, 5.0)).otherwise(1.5)).alias("sales_to_capital"),
        F.when(has_rim, c("book")).alias("book_value"),
        F.when(has_rim, F.when(average > 0, clamp(c("net_income") / average, -0.20, 0.40)).otherwise(0.0)).alias("roe"),
        F.when(has_rim, F.coalesce(payout, F.lit(0.0))).alias("payout_ratio"),
        F.when(F.coalesce(financial & has_rim, F.lit(False)), "rim").when(F.coalesce(has_dcf, F.lit(False)), "dcf")
        .when(F.coalesce(has_rim, F.lit(False)), "rim").otherwise("dcf").alias("recommended"),
    )


def relative(metrics: DataFrame, peers: DataFrame, groups: DataFrame, names: list[str]) -> DataFrame:
    """Own multiple beside the median positive multiple of peers and of the rest of the group.

    The group's median without the company itself needs only the group's three middle values,
    so groups are never paired with themselves."""
    rows = metrics.where(F.col("metric").isin(names)).select("company", "metric", "value")
    keyed = rows.join(groups.select("company", "grp"), "company")
    near = peers.select("company", "peer").join(
        rows.where("value > 0").select(F.col("company").alias("peer"), "metric", "value"), "peer"
    )
    peer = near.groupBy("company", "metric").agg(
        F.percentile("value", F.lit(0.5)).alias("peer_median"), F.count(F.lit(1)).alias("peer_count")
    )  # a handful of peers
    by = ["grp", "metric"]
    positions = R.value_positions(keyed.where("value > 0"), by, "value")
    start = F.floor((F.col("n") - 2) / 2)
    at = lambda k: F.max(F.when((F.col("below") <= k) & (k < F.col("below") + F.col("ties")), F.col("value")))
    middle = positions.groupBy(*by).agg(
        F.max("n").alias("n"), at(start).alias("m0"), at(start + 1).alias("m1"), at(start + 2).alias("m2")
    )
    own = keyed.join(middle, by, "left").join(
        positions.select(*by, "value", F.col("below").alias("place")), [*by, "value"], "left"
    )
    inside = F.col("place").isNotNull()
    even = F.col("n") % 2 == 0
    half = F.floor(F.col("n") / 2)
    full_median = F.when(even, (F.col("m0") + F.col("m1")) / 2).otherwise(F.col("m1"))
    without = F.when(even, F.when(F.col("place") <= half - 1, F.col("m1")).otherwise(F.col("m0"))).when(
        F.col("place") < half, (F.col("m1") + F.col("m2")) / 2
    ).when(F.col("place") > half, (F.col("m0") + F.col("m1")) / 2).otherwise((F.col("m0") + F.col("m2")) / 2)
    left = F.when(inside, F.col("n") - 1).otherwise(F.coalesce("n", F.lit(0)))
    median = F.when(left > 0, F.when(inside, without).otherwise(full_median))
    return own.join(peer, ["company", "metric"], "left").select(
        "company", "metric", "value", "peer_median",
        F.coalesce("peer_count", F.lit(0)).alias("peer_count"),
        median.alias("group_median"), left.alias("group_count"),
    )


#: Days before a fiscal year end in which a close counts, and fiscal years of the history.
NEAR_YEAR_END, HISTORY_YEARS = 7, 5


def multiple_history(annual: DataFrame, prices: DataFrame) -> DataFrame:
    """Median positive multiple over the last five fiscal year ends, and how many years have one.

    The close is the last of the week up to the year end, the share count that year's diluted one; missing debt and cash count
    as zero. A year end becomes its eight days, which meet the prices by equality; a company brings five years at most."""
    latest = Window.partitionBy("company").orderBy(F.desc("idx"))
    years = M.wide(annual).withColumn("_back", F.row_number().over(latest)).where(F.col("_back") <= HISTORY_YEARS)
    days = F.explode(F.sequence(F.date_sub("end", NEAR_YEAR_END), F.col("end"))).alias("trade_date")
    dated = years.select("company", "idx", days).join(prices.select("company", "trade_date", "close"), ["company", "trade_date"])
    closes = dated.where(F.col("close").isNotNull()).groupBy("company", "idx").agg(F.max_by("close", "trade_date").alias("_close"))
    v = M.Values(F.col, None, None, annual=True)
    cap = F.col("_close").cast("double") * F.col("shares_diluted")
    enterprise = cap + F.coalesce(v.debt(), F.lit(0.0)) - F.coalesce("cash", F.lit(0.0))
    multiples = {
        "pe_ratio": E.multiple(cap, v.cur("net_income")), "ev_to_ebitda": E.multiple(enterprise, v.ebitda()),
        "price_to_sales": E.multiple(cap, v.cur("revenue")), "price_to_book": E.multiple(cap, v.cur("total_equity")),
    }
    wide = years.join(closes, ["company", "idx"]).where(F.col("shares_diluted") > 0)
    long = wide.select("company", "idx", *[m.alias(name) for name, m in multiples.items()]).unpivot(
        ["company", "idx"], list(multiples), "metric", "value"
    )
    return long.where(F.col("value").isNotNull()).groupBy("company", "metric").agg(
        F.percentile(F.when(F.col("value") > 0, F.col("value")), F.lit(0.5)).alias("history_median"),
        F.count(F.lit(1)).alias("history_years"),
    )  # at most five values


def implied_per_share(compared: DataFrame, figures: DataFrame) -> DataFrame:
    """Rows of `relative` with the value per share that the peer median gives the company's own figures.

    `figures`: company, shares, net_income, ebitda, revenue, total_equity, debt, cash. Null without peers, shares or a positive
    figure; debt is taken off and cash added where the multiple is one of enterprise value."""
    base = {"pe_ratio": "net_income", "ev_to_ebitda": "ebitda", "price_to_sales": "revenue", "price_to_book": "total_equity"}
    own, metric = F.lit(None).cast("double"), F.col("metric")
    for name, column in base.items():
        own = F.when(metric == name, F.col(f"_f.{column}")).otherwise(own)
    net = F.coalesce(F.col("_f.debt"), F.lit(0.0)) - F.coalesce(F.col("_f.cash"), F.lit(0.0))
    value = F.col("peer_median") * own - F.when(metric == "ev_to_ebitda", net).otherwise(0.0)
    usable = (F.col("_f.shares") > 0) & (own > 0)
    wanted = ("shares", *base.values(), "debt", "cash")
    packed = figures.select("company", F.struct(*[F.col(c).cast("double").alias(c) for c in wanted]).alias("_f"))
    joined = compared.join(packed, "company", "left")
    return joined.withColumn("implied_per_share", F.when(usable, value / F.col("_f.shares"))).drop("_f")
