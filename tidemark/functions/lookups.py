"""Names, priorities, codes and thresholds that results depend on."""

from __future__ import annotations

# Factor inputs and the sign with which each counts.
FACTORS = {
    "value": {
        "earnings_yield": 1, "book_to_price": 1, "ebitda_to_ev": 1, "fcf_yield": 1,
        "sales_yield": 1,
    },
    "quality": {"roe": 1, "roic": 1, "gross_margin": 1, "debt_to_equity": -1},
    "momentum": {"mom_12_1": 1, "mom_6m": 1},
    "low_volatility": {"vol_3m": -1, "beta_1y": -1},
    "growth": {"revenue_growth_yoy": 1, "revenue_cagr_3y": 1, "eps_growth_yoy": 1},
    "size": {"log_market_cap": 1},
}

# SIC major groups and their divisions.
SIC_DIVISIONS = (
    (1, 9, "Agriculture, Forestry & Fishing"),
    (10, 14, "Mining"),
    (15, 17, "Construction"),
    (20, 39, "Manufacturing"),
    (40, 49, "Transportation, Communications & Utilities"),
    (50, 51, "Wholesale Trade"),
    (52, 59, "Retail Trade"),
    (60, 67, "Finance, Insurance & Real Estate"),
    (70, 89, "Services"),
    (91, 97, "Public Administration"),
    (99, 99, "Nonclassifiable"),
)

# Yield-curve tenors in months.
TENOR_MONTHS = {
    "1 Mo": 1.0, "1.5 Month": 1.5, "2 Mo": 2.0, "3 Mo": 3.0, "4 Mo": 4.0, "6 Mo": 6.0,
    "1 Yr": 12.0, "2 Yr": 24.0, "3 Yr": 36.0, "5 Yr": 60.0, "7 Yr": 84.0, "10 Yr": 120.0,
    "20 Yr": 240.0, "30 Yr": 360.0,
}

EXTRACTOR_VERSION = "2026.09-5"

# Statement line items as (item, kind, unit, concepts in priority order).
LINE_ITEMS = (
    ("revenue", "flow", "USD", (
        "RevenueFromContractWithCustomerExcludingAssessedTax", "Revenues", "SalesRevenueNet",
        "RevenueFromContractWithCustomerIncludingAssessedTax", "RevenuesNetOfInterestExpense")),
    ("cost_of_revenue", "flow", "USD", (
        "CostOfGoodsAndServicesSold", "CostOfRevenue", "CostOfGoodsSold", "CostOfServices")),
    ("gross_profit", "flow", "USD", ("GrossProfit",)),
    ("research_development", "flow", "USD", ("ResearchAndDevelopmentExpense",)),
    ("sga", "flow", "USD", ("SellingGeneralAndAdministrativeExpense",)),
    ("operating_income", "flow", "USD", ("OperatingIncomeLoss",)),
    ("interest_expense", "flow", "USD", (
        "InterestExpense", "InterestExpenseNonoperating", "InterestExpenseDebt")),
    ("pretax_income", "flow", "USD", (
        "IncomeLossFromContinuingOperationsBeforeIncomeTaxesExtraordinaryItems"
        "NoncontrollingInterest",
        "IncomeLossFromContinuingOperationsBeforeIncomeTaxesMinorityInterestAnd"
        "IncomeLossFromEquityMethodInvestments")),
    ("income_tax", "flow", "USD", ("IncomeTaxExpenseBenefit",)),
    ("net_income", "flow", "USD", (
        "NetIncomeLoss", "ProfitLoss", "NetIncomeLossAvailableToCommonStockholdersBasic")),
    ("eps_basic", "nonadditive", "USD/shares", (
        "EarningsPerShareBasic", "EarningsPerShareBasicAndDiluted")),
    ("eps_diluted", "nonadditive", "USD/shares", (
        "EarningsPerShareDiluted", "EarningsPerShareBasicAndDiluted")),
    ("shares_basic", "nonadditive", "shares", (
        "WeightedAverageNumberOfSharesOutstandingBasic",)),
    ("shares_diluted", "nonadditive", "shares", (
        "WeightedAverageNumberOfDilutedSharesOutstanding",)),
    ("cash", "instant", "USD", (
        "CashAndCashEquivalentsAtCarryingValue",
        "CashCashEquivalentsRestrictedCashAndRestrictedCashEquivalents")),
    ("short_term_investments", "instant", "USD", (
        "ShortTermInvestments", "MarketableSecuritiesCurrent",
        "AvailableForSaleSecuritiesDebtSecuritiesCurrent")),
    ("receivables", "instant", "USD", (
        "AccountsReceivableNetCurrent", "ReceivablesNetCurrent")),
    ("inventory", "instant", "USD", ("InventoryNet",)),
    ("current_assets", "instant", "USD", ("AssetsCurrent",)),
    ("total_assets", "instant", "USD", ("Assets",)),
    ("accounts_payable", "instant", "USD", ("AccountsPayableCurrent",)),
    ("current_liabilities", "instant", "USD", ("LiabilitiesCurrent",)),
    ("short_term_debt", "instant", "USD", (
        "DebtCurrent", "LongTermDebtCurrent", "ShortTermBorrowings")),
    ("long_term_debt", "instant", "USD", (
        "LongTermDebtNoncurrent", "LongTermDebtAndCapitalLeaseObligations")),
    ("total_liabilities", "instant", "USD", ("Liabilities",)),
    ("total_equity", "instant", "USD", (
        "StockholdersEquity",
        "StockholdersEquityIncludingPortionAttributableToNoncontrollingInterest")),
    ("common_shares_outstanding", "instant", "shares", ("CommonStockSharesOutstanding",)),
    ("operating_cash_flow", "flow", "USD", (
        "NetCashProvidedByUsedInOperatingActivities",
        "NetCashProvidedByUsedInOperatingActivitiesContinuingOperations")),
    ("capex", "flow", "USD", (
        "PaymentsToAcquirePropertyPlantAndEquipment", "PaymentsToAcquireProductiveAssets")),
    ("depreciation_amortization", "flow", "USD", (
        "DepreciationDepletionAndAmortization", "DepreciationAndAmortization",
        "DepreciationAmortizationAndAccretionNet")),
    ("stock_based_compensation", "flow", "USD", (
        "ShareBasedCompensation", "AllocatedShareBasedCompensationExpense")),
    ("dividends_paid", "flow", "USD", (
        "PaymentsOfDividends", "PaymentsOfDividendsCommonStock")),
    ("buybacks", "flow", "USD", ("PaymentsForRepurchaseOfCommonStock",)),
    ("dividends_per_share", "flow", "USD/shares", (
        "CommonStockDividendsPerShareDeclared", "CommonStockDividendsPerShareCashPaid")),
    ("investing_cash_flow", "flow", "USD", ("NetCashProvidedByUsedInInvestingActivities",)),
    ("financing_cash_flow", "flow", "USD", ("NetCashProvidedByUsedInFinancingActivities",)),
)
COVER_CONCEPT = "EntityCommonStockSharesOutstanding"
ACCEPTED_FORMS = ("10-K", "10-K/A", "10-Q", "10-Q/A", "10-KT", "10-KT/A")
# Funds that stand for markets and are listed even when the directory lacks them.
REFERENCE_TICKERS = ("SPY", "QQQ", "IWM", "DIA", "TLT", "GLD")


def tracked_concepts() -> list[tuple[str, str, str]]:
    """(taxonomy, concept, unit) triples that ingestion keeps."""
    rows = {("us-gaap", c, unit) for _, _, unit, concepts in LINE_ITEMS for c in concepts}
    return sorted(rows | {("dei", COVER_CONCEPT, "shares")})


def concept_rows() -> list[tuple[str, str, str, str, int]]:
    """(item, kind, unit, concept, priority) rows for joins."""
    return [
        (item, kind, unit, concept, place)
        for item, kind, unit, concepts in LINE_ITEMS
        for place, concept in enumerate(concepts)
    ]

CLASSIFIER_VERSION = "2026.09-3"
# Event types, most consequential first.
EVENT_TYPES = (
    "bankruptcy", "restatement", "cybersecurity", "m_and_a", "earnings", "guidance", "leadership",
    "material_agreement", "financing", "capital_return", "restructuring", "listing",
    "auditor_change", "governance", "legal_regulatory", "analyst", "product", "disclosure", "other",
)
# Current-report items and the event types they stand for.
EIGHT_K_TYPES = {
    "1.01": "material_agreement", "1.02": "material_agreement", "1.03": "bankruptcy",
    "1.05": "cybersecurity", "2.01": "m_and_a", "2.02": "earnings", "2.03": "financing",
    "2.04": "financing", "2.05": "restructuring", "2.06": "restructuring", "3.01": "listing",
    "3.02": "financing", "3.03": "governance", "4.01": "auditor_change", "4.02": "restatement",
    "5.01": "m_and_a", "5.02": "leadership", "5.03": "governance", "5.07": "governance",
    "7.01": "disclosure", "8.01": "disclosure",
}
# Current-report item titles used in event headlines.
EIGHT_K_TITLES = {
    "1.01": "Entry into a Material Definitive Agreement",
    "1.02": "Termination of a Material Definitive Agreement",
    "1.03": "Bankruptcy or Receivership",
    "1.04": "Mine Safety – Reporting of Shutdowns and Patterns of Violations",
    "1.05": "Material Cybersecurity Incidents",
    "2.01": "Completion of Acquisition or Disposition of Assets",
    "2.02": "Results of Operations and Financial Condition",
    "2.03": "Creation of a Direct Financial Obligation",
    "2.04": "Triggering Events That Accelerate or Increase a Financial Obligation",
    "2.05": "Costs Associated with Exit or Disposal Activities",
    "2.06": "Material Impairments",
    "3.01": "Notice of Delisting or Failure to Satisfy a Listing Rule",
    "3.02": "Unregistered Sales of Equity Securities",
    "3.03": "Material Modification to Rights of Security Holders",
    "4.01": "Changes in Registrant's Certifying Accountant",
    "4.02": "Non-Reliance on Previously Issued Financial Statements",
    "5.01": "Changes in Control of Registrant",
    "5.02": "Departure or Appointment of Directors or Certain Officers",
    "5.03": "Amendments to Articles of Incorporation or Bylaws",
    "5.04": "Temporary Suspension of Trading Under Employee Benefit Plans",
    "5.05": "Amendments to the Code of Ethics",
    "5.06": "Change in Shell Company Status",
    "5.07": "Submission of Matters to a Vote of Security Holders",
    "5.08": "Shareholder Director Nominations",
    "6.01": "ABS Informational and Computational Material",
    "7.01": "Regulation FD Disclosure",
    "8.01": "Other Events",
    "9.01": "Financial Statements and Exhibits",
}
# Headline rules in order; the first that matches names the event.
HEADLINE_RULES = (
    ("bankruptcy", r"\b(chapter 11|bankrupt\w*|insolven\w*)\b"),
    ("restatement", r"\b(restat(e|es|ed|ement)|accounting error)\b"),
    ("cybersecurity", r"\b(cyber ?attack|data breach|ransomware|hack(ed|ers?)?)\b"),
    ("m_and_a", r"\b(acquir(e|es|ed|ing)|acquisition|merger|merg(e|es|ed|ing)|takeover|buyout|"
                r"divest\w*|spin[- ]?off)\b"),
    ("earnings", r"\b(earnings|quarterly (results|profit|revenue)|(first|second|third|fourth)[- ]"
                 r"quarter (results|profit|revenue|sales)|q[1-4] (results|earnings|revenue|sales)|"
                 r"(beats|misses|tops) (estimates|expectations))\b"),
    ("guidance", r"\b(guidance|outlook|forecasts?)\b"),
    ("leadership", r"\b(resign(s|ed|ation)?|step(s|ped)? down|to step down|retir(e|es|ed|ement)|"
                   r"appoint(s|ed|ment)?|names? (a )?new|successor|succeed(s|ed)?|ousted|fired|"
                   r"hires? (a )?new)\b"),
    ("capital_return", r"\b(dividends?|buybacks?|share repurchases?|repurchase program)\b"),
    ("financing", r"\b(bond (sale|offering)|notes offering|debt offering|"
                  r"(secondary|share|stock) offering|credit facility|raises \$)"),
    ("legal_regulatory", r"\b(lawsuit|sues|sued|settle(s|d|ment)|antitrust|probe|investigation|"
                         r"fined|regulators?|ftc|doj|court|ruling|verdict|subpoena)\b"),
    ("analyst", r"\b((up|down)grade[sd]? .{0,40}?\b(to|at) (buy|sell|hold|neutral|overweight|"
                r"underweight|outperform|underperform|equal[- ]weight|market perform)|price target|"
                r"initiates? coverage|overweight|underweight|outperform|underperform)\b"),
    ("product", r"\b(launch(es|ed)?|unveil(s|ed)?|recalls?|rolls? out)\b"),
)
# Legal-form endings headlines leave out, and words that carry no story.
NAME_ENDINGS = (
    r"(?i)[,.]?\s+(&\s*)?(inc|incorporated|corp|corporation|co|com|company|ltd|limited|plc|llc|lp|"
    r"l\.p|n\.v|s\.a|ag|se|holdings?|group|/de|/md|/new)\.?$"
)
STOP_WORDS = (
    "a an and are as at be by for from has have in is it its of on or the to with says said".split()
)

# How a headline writes a ticker, as what stands before and after it.
TICKER_PATTERNS = {
    "exchange": (r"(?i)\((?:(?:nyse|nasdaq|nyse american|amex|otc)\s*:\s*)?", r"\)"),
    "cash": (r"\$", r"\b"),
    "bare": (r"\b", r"\b"),
}
