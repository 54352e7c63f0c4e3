"""Small fixtures checked by hand or by brute force."""

import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import asof, crosssection, events, markets, models, ownership, pit, portfolio, ranking, text, valuation
from tidemark.sources import readers, sinks


def test_positions_and_quantiles_are_exact_under_ties(spark):
    rng = random.Random(3)
    values = [("g", float(rng.choice([0, 0, 0, 1, 2, 5, 1e6, -3]))) for _ in range(400)]
    frame = spark.createDataFrame(values, "grp string, v double")
    found = {r["v"]: (r["below"], r["ties"]) for r in ranking.value_positions(frame, ["grp"], "v").collect()}
    plain = [v for _, v in values]
    for v, (below, ties) in found.items():
        assert below == sum(x < v for x in plain) and ties == plain.count(v)
    q = ranking.quantiles(ranking.value_positions(frame, ["grp"], "v"), ["grp"], "v", {"p": 0.73}).first()["p"]
    ordered, place = sorted(plain), 399 * 0.73
    low = ordered[int(place)]
    assert q == pytest.approx(low + (ordered[int(place) + 1] - low) * (place - int(place)))


def test_zscore_clips_the_outlier(spark):
    data = [("2024-01-31", i, "x", float(i)) for i in range(200)] + [("2024-01-31", 999, "x", 10000.0)]
    frame = spark.createDataFrame(data, "as_of string, company int, feature string, value double")
    z = {r["company"]: r["z"] for r in crosssection.zscores(frame).collect()}
    assert z[999] < 2 and len(z) == 201


def test_cap_weights_redistributes(rows):
    frame = rows("as_of date, company int, weight double", [("2024-01-31", 1, 0.7), ("2024-01-31", 2, 0.2), ("2024-01-31", 3, 0.1)])
    capped = {r["company"]: r["weight"] for r in crosssection.cap_weights(frame, 0.5).collect()}
    assert capped[1] == 0.5 and capped[2] == pytest.approx(1 / 3) and sum(capped.values()) == pytest.approx(1)
    low = crosssection.cap_weights(frame, 0.2).agg(F.sum("weight")).first()[0]
    assert low == pytest.approx(0.6)


def test_macro_lag_dates_only_back_filled_first_vintages(rows):
    frame = rows(
        "series string, observation_date date, realtime_start date, value double, tie bigint",
        [("A", "2020-01-01", "2020-01-20", 1.0, 1), ("A", "2020-01-01", "2020-03-01", 1.5, 2), ("A", "2010-01-01", "2019-01-01", 9.0, 3)],
    )
    known = {r["tie"]: str(r["available_on"]) for r in pit.macro_available(frame, F.lit(40)).collect()}
    assert known == {1: "2020-01-20", 2: "2020-03-01", 3: "2010-02-10"}


def test_a_revision_of_an_older_observation_never_wins(rows):
    frame = rows(
        "series string, observation_date date, realtime_start date, available_on date, value double, tie bigint",
        [("A", "2020-01-01", "2020-02-01", "2020-02-01", 1.0, 1), ("A", "2020-02-01", "2020-03-01", "2020-03-01", 2.0, 2),
         ("A", "2020-01-01", "2020-04-01", "2020-04-01", 7.0, 3)],
    )
    days = rows("as_of date", [("2020-02-15",), ("2020-03-31",), ("2020-05-31",)])
    found = {str(r["as_of"]): r["value"] for r in pit.macro_latest(frame, days).collect()}
    assert found == {"2020-02-15": 1.0, "2020-03-31": 2.0, "2020-05-31": 2.0}


def test_asof_join_equals_brute_force(rows):
    rng = random.Random(5)
    day = lambda: f"20{rng.randint(20, 22)}-{rng.randint(1, 12):02d}-{rng.randint(1, 28):02d}"
    right = sorted({(rng.choice("ab"), day()) for _ in range(40)})
    right = [(k, d, float(i)) for i, (k, d) in enumerate(right)]
    left = [(rng.choice("abc"), day(), i) for i in range(80)]
    found = asof.asof_join(
        rows("k string, d date, i int", left), rows("k string, t date, v double", right), "k", "d", "t", ["v"]
    )
    got = {r["i"]: r["v"] for r in found.collect()}
    for k, d, i in left:
        best = max(((t, v) for kk, t, v in right if kk == k and t <= d), default=(None, None))
        assert got[i] == best[1]


def test_bar_problems(rows):
    bars = rows(
        "open double, high double, low double, close double, volume double, split_factor double",
        [(1.0, 2.0, 0.5, 1.5, 10.0, 1.0), (0.0, 2.0, 0.0, 1.5, -1.0, 0.0), (3.0, 2.0, 1.0, 1.5, 1.0, None)],
    )
    found = [sorted(r["problems"]) for r in readers.bar_quality(bars).collect()]
    assert found == [[], ["negative_volume", "non_positive_price", "non_positive_split_factor"], ["high_below_range"]]


def test_inserts_are_idempotent(rows):
    stored = rows("k string, p date, v int", [("a", None, 1)])
    incoming = rows("k string, p date, v int", [("a", None, 2), ("b", None, 3), ("b", None, 4)])
    fresh = sinks.insert_ignore(stored, incoming, ["k", "p"])
    assert [(r["k"], r["v"]) for r in fresh.collect()] == [("b", 3)]
    assert sinks.insert_ignore(stored.unionByName(fresh), incoming, ["k", "p"]).count() == 0


def test_slices_are_replaced_on_disk(spark, rows, tmp_path):
    path = str(tmp_path / "slices")
    sinks.overwrite_slices(rows("d string, v int", [("x", 1), ("y", 2)]), path, ["d"])
    sinks.overwrite_slices(rows("d string, v int", [("y", 5)]), path, ["d"])
    assert sorted((r["d"], r["v"]) for r in spark.read.parquet(path).collect()) == [("x", 1), ("y", 5)]


def test_ownership_amendments_and_units(rows):
    filings = rows(
        "manager int, period date, accession string, kind string, filed date",
        [(1, "2023-06-30", "A1", "original", "2023-08-01"), (1, "2023-06-30", "A2", "restatement", "2023-08-10"),
         (2, "2023-06-30", "B1", "original", "2023-08-01"), (2, "2023-06-30", "B2", "new_holdings", "2023-08-05"),
         (3, "2023-06-30", "C1", "new_holdings", "2023-08-05")],
    )
    assert sorted(r["accession"] for r in ownership.select_filings(filings).collect()) == ["A2", "B1", "B2"]
    held = rows(
        "period date, cusip string, manager int, filed date, put_call string, amount_type string, amount double, value double",
        [("2022-12-31", "X", 1, "2022-12-30", None, "SH", 5.0, 15.0), ("2022-12-31", "X", 1, "2022-12-30", "Put", "SH", 9.0, 99.0)],
    )
    only = ownership.positions(held).first()
    assert (only["value"], only["shares"]) == (15000.0, 5.0)


def test_wacc_and_dcf_value(rows):
    base = rows(
        "risk_free double, beta double, equity_risk_premium double, pre_tax_cost_of_debt double, tax_rate double, equity_value double, debt_value double",
        [(0.04, 1.2, 0.05, 0.06, 0.25, 800.0, 200.0)],
    )
    assert base.select(valuation.wacc().alias("w")).first()["w"] == pytest.approx(0.8 * 0.10 + 0.2 * 0.045)
    frame = rows(
        "base_revenue double, growth double, margin double, long_run_margin double, terminal_growth double, tax_rate double, "
        "sales_to_capital double, discount_rate double, terminal_roic double, debt double, cash double, shares double",
        [(1000.0, 0.0, 0.2, 0.2, 0.0, 0.25, 1.0, 0.10, None, 200.0, 50.0, 10.0), (1000.0, 0.0, 0.2, 0.2, 0.099, 0.25, 1.0, 0.10, None, 0.0, 0.0, 1.0)],
    )
    good, bad = valuation.dcf(frame).collect()
    assert good["equity"] == pytest.approx(1350) and good["per_share"] == pytest.approx(135)
    assert bad["per_share"] is None and "exceed" in bad["error"]


def test_rank_ic_of_a_perfect_score(spark):
    data = [(f"2024-0{m}-28", c, c / 50, c / 100.0) for m in (1, 2) for c in range(50)]
    preds = spark.createDataFrame(data, "as_of string, company int, p double, excess double").withColumn("g", F.lit(1))
    assert models.rank_ic(preds, ["g"]).first()["mean"] == pytest.approx(1.0)
    assert models.decile_spread(preds, ["g"]).first()["decile_spread"] == pytest.approx(0.45)


def test_walk_forward_finds_signal(spark):
    rng = random.Random(1)
    data = []
    for year in range(2010, 2017):
        for month in (1, 4, 7, 10):
            for company in range(40):
                a, b = rng.random(), rng.random()
                day = f"{year}-{month:02d}-28"
                data.append((day, company, a, b, (a - 0.5) * 0.2 + rng.gauss(0, 0.05)))
    frame = spark.createDataFrame(data, "as_of string, company int, a double, b double, excess double")
    frame = frame.withColumn("as_of", F.to_date("as_of")).withColumn("label_end", F.date_add("as_of", 30))
    out = models.walk_forward(frame, ["a", "b"], minimum=(200, 50), rounds=2)
    assert out.agg(F.min("fold")).first()[0] == 2014
    assert models.auc(out.withColumn("g", F.lit(1)), ["g"]).first()["auc"] > 0.6


def test_novelty_equals_brute_force_with_many_copies(spark):
    rng = random.Random(9)
    words = "alpha beta gamma delta epsilon zeta eta theta".split()
    hour = 3600 * 1_000_000
    titles = [" ".join(rng.sample(words, 4)) for _ in range(6)] + ["one same headline"] * 3
    news = [(i, i % 2, i * 7 * hour + rng.randint(0, hour), rng.choice(titles)) for i in range(150)]
    frame = spark.createDataFrame(news, "news_id long, company long, seen_us long, title string")
    found = {r["news_id"]: (r["prior"], r["similarity"]) for r in events.novelty(frame).collect()}
    for i, c, t, title in news:
        best = (0.0, None)
        for j, cc, u, other in news:
            if cc == c and t - events.NOVELTY_US <= u < t:
                a, b = set(title.split()), set(other.split())
                score = len(a & b) / len(a | b)
                if score >= 0.5 and (score, -j) > (best[0], -(best[1] if best[1] is not None else 10**9)):
                    best = (score, j)
        assert found[i][0] == best[1], i
    clusters = {r["news_id"]: r["cluster_id"] for r in events.story_clusters(events.novelty(frame)).collect()}
    for i, (prior, _) in found.items():
        assert clusters[i] == (clusters[prior] if prior is not None else i)


def test_passages_cover_the_text_within_limits():
    body = "\n\n".join(["Short one."] * 40 + ["A long sentence here. " * 300] + ["x" * 5000])
    spans = text.passages_of(body)
    assert all(0 < e - s <= text.MAX_CHARS for s, e in spans)
    assert all(a[1] <= b[0] for a, b in zip(spans, spans[1:]))
    covered = "".join(body[s:e] for s, e in spans)
    assert covered.replace(" ", "").replace("\n", "") == body.replace(" ", "").replace("\n", "")


def test_comparison_kinds(spark):
    before = ["Risk A stays the same.", "Risk B may hurt our sales in Europe a lot.", "Risk C is old.", "End."]
    after = ["Risk A  stays the same.", "Risk B may hurt our sales in Asia a lot.", "Brand new words entirely.", "End."]
    frame = lambda d: spark.createDataFrame([(1, k, t) for k, t in enumerate(d)], "pair long, ordinal int, text string")
    rows = text.diff_paragraphs(frame(before), frame(after), "pair")
    found = [(r["kind"], r["before"], r["after"]) for r in rows.orderBy("block").collect()]
    assert [k for k, *_ in found] == ["same", "changed", "removed", "added", "same"]
    assert found[1] == ("changed", before[1], after[1])
    total = text.diff_summary(rows, "pair").first()
    assert tuple(total) == (1, 2, 1, 1, 1, 5, 5)


def test_comparison_of_long_versions(spark):
    """Many paragraphs on both sides are still compared, and each side can be put together from the blocks."""
    rng = random.Random(8)
    words = [f"w{k}" for k in range(300)]
    before = [" ".join(rng.choice(words) for _ in range(20)) for _ in range(150)]
    after = []
    for p in before:
        kind = rng.random()
        if kind < 0.6:
            w = p.split()
            w[rng.randrange(20)] = "edited"
            after.append(" ".join(w))
        elif kind < 0.8:
            after.append(p)
        if rng.random() < 0.1:
            after.append(" ".join(rng.choice(words) for _ in range(20)) + " fresh")
    frame = lambda d: spark.createDataFrame([(1, k, t) for k, t in enumerate(d)], "pair long, ordinal int, text string")
    found = text.diff_paragraphs(frame(before), frame(after), "pair").orderBy("block").collect()
    assert [r["before"] for r in found if r["before"] is not None] == before
    assert [r["after"] for r in found if r["after"] is not None] == after
    assert sum(r["kind"] == "changed" for r in found) > 70


def test_sections_skip_the_contents_table(spark):
    lines = ["Item 1. Business", "Item 1A. Risk Factors", "Item 7. Management's Discussion and Analysis",
             "Item 1. Business", "We make things. " * 20, "Item 1A. Risk Factors", "Many risks exist. " * 20,
             "Item 7.", "Management's Discussion and Analysis", "Sales went up. " * 20, "Signatures", "Signed by us."]
    frame = spark.createDataFrame([(1, "10-K", i, t) for i, t in enumerate(lines)], "filing long, form string, ordinal int, text string")
    found = {r["key"]: r["text"] for r in text.sections(frame).collect()}
    assert set(found) == {"item_1", "item_1a", "item_7"}
    assert found["item_1a"].startswith("Many risks") and found["item_7"].endswith("Sales went up. ")


def test_html_paragraphs(spark):
    html = "<html><head><title>t</title></head><body><div style='display: none'>hid</div><p>One &amp; two</p>" \
           "<table><tr><td>a</td><td>b</td></tr></table><p>12</p><script>x</script><p>Table of Contents</p></body></html>"  # fmt: skip
    frame = spark.createDataFrame([(1, html)], "page_id long, html string")
    assert [r["text"] for r in text.html_paragraphs(frame, "page_id", "html").orderBy("ordinal").collect()] == ["One & two", "a | b"]


def test_unclosed_markup_hides_nothing_else(spark):
    pages = ["<html><head><title>x</title><body><p>Hello body</p></body></html>", '<p style="display:none">hid<p>later',
             "<td><div style='display:none'>hid</td><td>shown</td>", "<ul><li style='display:none'>a<li>b</ul>"]
    frame = spark.createDataFrame(list(enumerate(pages)), "page_id long, html string")
    found = {r["page_id"]: r["text"] for r in text.html_paragraphs(frame, "page_id", "html").collect()}
    assert found == {0: "Hello body", 1: "later", 2: "shown", 3: "b"}


def test_unknown_current_report_items_keep_their_text(spark):
    lines = ["Item 2.02 Results of Operations", "Sales rose.", "Item 9.99 Something New", "New text.", "Item 8.01 Other Events", "Late."]
    frame = spark.createDataFrame([(1, "8-K", i, t) for i, t in enumerate(lines)], "filing long, form string, ordinal int, text string")
    found = {r["key"]: r["text"] for r in text.sections(frame).collect()}
    assert found["item_2.02"] == "Sales rose." and "New text." in "".join(found.values())
    assert not any("New text." in t for k, t in found.items() if k == "item_2.02")


def test_leakage_is_refused(rows):
    one = lambda schema, row: rows(schema, [row])
    price = one("as_of date, company int, mom double, price_used date", ("2024-01-31", 1, 0.1, "2024-01-30"))
    late = one("as_of date, company int, roe double, fact_used date", ("2024-01-31", 1, 0.2, "2024-02-01"))
    macro = one("as_of date, rate double, macro_used date", ("2024-01-31", 0.2, "2024-01-01"))
    market = one("as_of date, trend double, market_used date", ("2024-01-31", 0.2, "2024-01-31"))
    with pytest.raises(Exception, match="not public"):
        markets.feature_snapshots(price, late, macro, market).collect()


def test_probabilistic_sharpe_is_half_without_skill(rows):
    frame = rows("active_sharpe_daily double, n int, active_skew double, active_kurtosis double", [(0.0, 250, 0.0, 3.0)])
    assert frame.select(portfolio.probabilistic_sharpe().alias("p")).first()["p"] == pytest.approx(0.5)


def test_names_lose_any_number_of_endings(spark):
    frame = spark.createDataFrame([("Acme Holdings Group Co., Ltd., Inc. Corp plc",), ("ZETA & COMPANY",), ("Inc",)], "n string")
    assert [r[0] for r in frame.select(events.short_name(F.col("n"))).collect()] == ["Acme", "Zeta", "Inc"]


def test_signals_wait_for_the_next_trading_day(rows):
    signals = rows("as_of date", [("2024-01-31",), ("2024-02-10",), ("2024-06-30",)])
    calendar = rows("trade_date date", [("2024-01-31",), ("2024-03-15",), ("2024-03-18",)])
    found = {str(r["as_of"]): str(r["start"]) for r in portfolio.holding_spans(signals, calendar).collect()}
    assert found == {"2024-01-31": "2024-03-15", "2024-02-10": "2024-03-15"}


def test_top_positions_are_those_of_each_period(spark):
    held = spark.createDataFrame([(1, "a", 9.0), (1, "b", 5.0), (2, "c", 1.0), (2, "a", 0.5)], "period int, cusip string, value double")
    found = {(r["period"], r["cusip"]) for r in ownership.top_cusips(held, 1).collect()}
    assert found == {(1, "a"), (2, "c")}


def test_forecasts_in_unseen_bins_stay(spark):
    past = spark.createDataFrame([(0.15, float(k)) for k in range(11)], "p double, excess double")
    new = spark.createDataFrame([(1, 0.12), (2, 0.95)], "company int, p double")
    found = {r["company"]: r["mid"] for r in models.interval_forecast(past, new).collect()}
    assert found == {1: 5.0, 2: None}


def test_one_outlier_leaves_ranking_slots_even(spark):
    values = [(1, float(k)) for k in range(2000)] + [(1, 1e9), (2, None), (2, 3.0)]
    frame = spark.createDataFrame(values, "d int, v double")
    found = {r["v"]: r["below"] for r in ranking.value_positions(frame.where("d = 1"), ["d"], "v").collect()}
    assert found == {**{float(k): k for k in range(2000)}, 1e9: 2000}
    shares = F.array(*[F.lit(k / ranking.SLOTS) for k in range(1, ranking.SLOTS)])
    cuts = frame.where("d = 1").agg(F.percentile_approx("v", shares, ranking.ACCURACY)).first()[0]
    sizes = [sum(a < v <= b for _, v in values[:2001]) for a, b in zip([-1.0, *cuts], [*cuts, 2e9])]
    assert max(sizes) < 3 * 2001 / ranking.SLOTS
