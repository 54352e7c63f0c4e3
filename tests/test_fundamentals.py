"""Hand-computed statements, metrics, splits and point-in-time behaviour of one issuer."""

from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tidemark.operators import metrics as M
from tidemark.operators import statements as S
from tidemark.operators import valuation as V

SCHEMA = (
    "company bigint, taxonomy string, concept string, unit string, period_start date, period_end date, "
    "value double, fiscal_year int, fiscal_period string, form string, accession string, filed_date date"
)
FY23, FY24 = ("2022-10-01", "2023-09-30"), ("2023-10-01", "2024-09-28")
Q1, Q2, Q3 = "2023-12-30", "2024-03-30", "2024-06-29"
# name: (accession, filed, fiscal year, fiscal period)
FILED = {
    "K23": ("23-10", "2023-11-03", 2023, "FY"), "K23A": ("24-02", "2024-01-15", 2023, "FY"),
    "Q1": ("24-05", "2024-02-02", 2024, "Q1"), "Q2": ("24-20", "2024-05-03", 2024, "Q2"),
    "Q3": ("24-30", "2024-08-02", 2024, "Q3"), "K24": ("24-40", "2024-11-01", 2024, "FY"),
}
REVENUE = "RevenueFromContractWithCustomerExcludingAssessedTax"
CASH_FLOW = "NetCashProvidedByUsedInOperatingActivities"
PRETAX = "IncomeLossFromContinuingOperationsBeforeIncomeTaxesExtraordinaryItemsNoncontrollingInterest"
SPANS = [
    (REVENUE, *FY23, 1000, "K23"), (REVENUE, *FY23, 990, "K23A"), (REVENUE, FY24[0], Q1, 280, "Q1"),
    (REVENUE, "2023-12-31", Q2, 300, "Q2"), (REVENUE, FY24[0], Q2, 580, "Q2"), (REVENUE, "2024-03-31", Q3, 290, "Q3"),
    (REVENUE, FY24[0], Q3, 870, "Q3"), (REVENUE, *FY24, 1200, "K24"),
    ("OperatingIncomeLoss", *FY23, 150, "K23"), ("OperatingIncomeLoss", *FY24, 200, "K24"),
    ("NetIncomeLoss", *FY23, 100, "K23"), ("NetIncomeLoss", *FY24, 150, "K24"),
    ("IncomeTaxExpenseBenefit", *FY24, 36, "K24"), (PRETAX, *FY24, 180, "K24"),
    ("DepreciationDepletionAndAmortization", *FY24, 30, "K24"),
    (CASH_FLOW, *FY23, 200, "K23"), (CASH_FLOW, FY24[0], Q1, 60, "Q1"), (CASH_FLOW, FY24[0], Q2, 130, "Q2"),
    (CASH_FLOW, FY24[0], Q3, 210, "Q3"), (CASH_FLOW, *FY24, 300, "K24"),
    ("PaymentsToAcquirePropertyPlantAndEquipment", *FY24, 50, "K24"),
    ("StockholdersEquity", None, FY23[1], 800, "K23"), ("StockholdersEquity", None, FY24[1], 1000, "K24"),
    ("LongTermDebtNoncurrent", None, FY23[1], 400, "K23"), ("LongTermDebtNoncurrent", None, FY24[1], 400, "K24"),
    ("DebtCurrent", None, FY23[1], 100, "K23"), ("DebtCurrent", None, FY24[1], 100, "K24"),
    ("CashAndCashEquivalentsAtCarryingValue", None, FY23[1], 300, "K23"),
    ("CashAndCashEquivalentsAtCarryingValue", None, Q2, 320, "Q2"),
    ("CashAndCashEquivalentsAtCarryingValue", None, FY24[1], 350, "K24"),
    ("AssetsCurrent", None, FY24[1], 900, "K24"), ("LiabilitiesCurrent", None, FY24[1], 600, "K24"),
]
PER_SHARE = [("EarningsPerShareDiluted", *FY23, 2.0, "K23"), ("EarningsPerShareDiluted", *FY24, 2.5, "K24")]
COVER = [("2024-10-18", 40, "K24"), ("2024-10-18", 20, "K24"), ("2023-10-20", 58, "K23")]
DILUTED = "WeightedAverageNumberOfDilutedSharesOutstanding"
SPLIT = [
    (DILUTED, "2021-10-01", "2022-09-30", 98, "K23"), (DILUTED, *FY23, 100, "K23"),
    (DILUTED, *FY23, 400, "K24"), (DILUTED, *FY24, 404, "K24"),
]


def _fact(concept, start, end, value, filing, unit="USD", taxonomy="us-gaap"):
    accession, filed, year, period = FILED[filing]
    return (1, taxonomy, concept, unit, start, end, float(value), year, period, "10-K", accession, filed)


@pytest.fixture(scope="module")
def data():
    facts = [_fact(*f) for f in SPANS] + [_fact(*f, unit="USD/shares") for f in PER_SHARE]
    cover = [_fact("EntityCommonStockSharesOutstanding", None, e, v, k, "shares", "dei") for e, v, k in COVER]
    return facts + cover


def _cells(frame):
    return {(r["item"], r["period"]): r for r in frame.collect()}


def test_quarters_come_from_year_to_date_values(rows, data):
    cells = _cells(S.statements(rows(SCHEMA, data), "quarterly"))
    revenue = [cells["revenue", f"FY2024-Q{q}"]["value"] for q in range(1, 5)]
    assert revenue == [Decimal(280), Decimal(300), Decimal(290), Decimal(330)]
    assert cells["revenue", "FY2024-Q2"]["derivation"] is None
    assert cells["revenue", "FY2024-Q4"]["derivation"] == "FY − 9M YTD"
    flow = [cells["operating_cash_flow", f"FY2024-Q{q}"]["value"] for q in range(1, 5)]
    assert flow == [60, 70, 80, 90]
    assert cells["operating_cash_flow", "FY2024-Q3"]["derivation"] == "9M YTD − 6M YTD"
    assert cells["cash", "FY2024-Q2"]["value"] == 320
    assert str(cells["revenue", "FY2024-Q2"]["start"]) == "2023-12-31"


def test_annual_metrics(rows, data):
    cells = S.statements(rows(SCHEMA, data), "annual")
    found = {(r["metric"], r["period"]): r["value"] for r in M.metric_series(cells, annual=True).collect()}
    expected = {
        "revenue_growth_yoy": 1200 / 990 - 1, "roe": 150 / 900, "roic": 160 / 1075, "fcf_margin": 250 / 1200,
        "current_ratio": 1.5, "debt_to_ebitda": 500 / 230, "eps_growth_yoy": 0.25,
    }
    for metric, value in expected.items():
        assert found[metric, "FY2024"] == pytest.approx(value, rel=1e-9), metric
    assert ("revenue_growth_yoy", "FY2023") not in found


@pytest.mark.parametrize("as_of", ["2023-12-31", "2024-06-01"])
def test_nothing_is_used_before_it_was_public(rows, data, as_of):
    facts = rows(SCHEMA, data)
    cut = facts.where(F.col("filed_date") <= as_of)
    for kind in ("annual", "quarterly"):
        known = S.statements(facts, kind, as_of).drop("idx").collect()
        assert sorted(map(str, known)) == sorted(map(str, S.statements(cut, kind).drop("idx").collect()))
        assert all(str(r["filed_date"]) <= as_of for r in known)


def test_splits_are_found_and_applied_once_public(rows, data):
    facts = rows(SCHEMA, data + [_fact(*f, unit="shares") for f in SPLIT])
    events = [(str(r["effective"]), r["ratio"]) for r in S.split_events(facts).collect()]
    assert events == [("2024-11-01", 4.0)]
    cells = _cells(S.statements(facts, "annual"))
    assert cells["shares_diluted", "FY2022"]["value"] == 392
    assert cells["shares_diluted", "FY2022"]["derivation"] == "Adjusted (split ×4 from 2024-11-01)"
    assert cells["eps_diluted", "FY2023"]["value"] == Decimal("0.5")
    before = _cells(S.statements(facts, "annual", "2024-06-01"))
    assert before["eps_diluted", "FY2023"]["value"] == 2


def test_thousandfold_restatements_are_not_splits(rows, data):
    scaled = [_fact(DILUTED, *FY23, 100, "K23", "shares"), _fact(DILUTED, *FY23, 100_000, "K24", "shares")]
    assert S.split_events(rows(SCHEMA, data + scaled)).count() == 0


def test_share_classes_are_summed(rows, data):
    facts = rows(SCHEMA, data)
    latest = S.shares_cover(facts).first()
    assert (latest["shares"], latest["classes"], str(latest["period_end"])) == (60, 2, "2024-10-18")
    assert S.shares_cover(facts, "2024-01-01").first()["shares"] == 58


def test_multiples_at_year_ends_and_implied_values(rows, data):
    diluted = [_fact(DILUTED, *FY23, 100, "K23", "shares"), _fact(DILUTED, *FY24, 50, "K24", "shares")]
    cells = S.statements(rows(SCHEMA, data + diluted), "annual")
    prices = rows("company bigint, trade_date date, close double", [
        (1, "2023-09-22", 7.0), (1, "2023-09-23", 9.0), (1, "2023-09-30", 10.0), (1, "2023-10-01", 99.0),
        (1, "2024-09-20", 99.0), (1, "2024-09-21", 30.0), (2, "2024-09-28", 5.0),
    ])
    found = {r["metric"]: r for r in V.multiple_history(cells, prices).collect()}
    expected = {
        "pe_ratio": (1000 / 100 + 1500 / 150) / 2, "price_to_sales": (1000 / 990 + 1500 / 1200) / 2,
        "price_to_book": (1000 / 800 + 1500 / 1000) / 2, "ev_to_ebitda": (1500 + 500 - 350) / 230,
    }
    assert {m: r["history_median"] for m, r in found.items()} == pytest.approx(expected)
    assert {m: r["history_years"] for m, r in found.items()} == {m: 1 if m == "ev_to_ebitda" else 2 for m in expected}
    assert V.multiple_history(cells, prices.limit(0)).count() == 0


def test_implied_value_per_share(rows):
    medians = [("pe_ratio", 12.0), ("ev_to_ebitda", 10.0), ("price_to_sales", None), ("price_to_book", 2.0)]
    compared = rows("company bigint, metric string, peer_median double", [(c, *m) for c in (1, 2, 3) for m in medians])
    figures = rows(
        "company bigint, shares double, net_income double, ebitda double, revenue double, total_equity double, debt double, cash double",
        [(1, 10.0, 50.0, 80.0, 900.0, 300.0, 200.0, None), (2, 0.0, 50.0, 80.0, 900.0, 300.0, 0.0, 0.0)],
    )
    found = {(r["company"], r["metric"]): r["implied_per_share"] for r in V.implied_per_share(compared, figures).collect()}
    assert found == {(c, m): None for c in (1, 2, 3) for m, _ in medians} | {
        (1, "pe_ratio"): 60.0, (1, "ev_to_ebitda"): 60.0, (1, "price_to_book"): 60.0
    }
