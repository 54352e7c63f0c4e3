"""Streams whose rows arrive late and in pieces give the batch operators' rows."""

from __future__ import annotations

import os
import random
from datetime import date, timedelta

import numpy as np
from pyspark.sql import functions as F

from tidemark.operators import events
from tidemark.session import shared_folder, stage_base
from tidemark.streaming import jobs

HOUR = 3_600_000_000


def pieces(spark, frame, parts):
    """A stream that brings a frame's rows one file at a time, in random order."""
    path = shared_folder(spark, "pieces")
    for k, weight in enumerate(frame.randomSplit([1.0] * parts, seed=3)):
        weight.coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(frame.schema).option("maxFilesPerTrigger", 1).parquet(path)


def headlines(spark, n=120):
    rng = random.Random(9)
    words = "alpha beta gamma delta epsilon zeta eta theta".split()
    titles = [" ".join(rng.sample(words, 4)) for _ in range(9)]
    rows = [(i, i % 2, i * 5 * HOUR + rng.randint(0, HOUR), rng.choice(titles)) for i in range(n)]
    return spark.createDataFrame(rows, "news_id long, company long, seen_us long, title string")


def test_late_headlines_are_judged_and_judge_later_ones_anew(spark):
    frame = headlines(spark).cache()
    base = shared_folder(spark, "late")
    jobs.novelty(pieces(spark, frame, 6), f"{base}/table", f"{base}/progress").awaitTermination()
    found = {r["news_id"]: (r["similarity"], r["prior"], r["novelty"]) for r in jobs.judgements(spark, f"{base}/table").collect()}
    expected = {r["news_id"]: (r["similarity"], r["prior"], r["novelty"]) for r in events.novelty(frame).collect()}
    assert found == expected
    assert spark.read.parquet(f"{base}/table").where("version > 0").count() > 0


def test_vectors_of_one_model_decide_where_there_are_some(spark):
    rng = np.random.default_rng(4)
    middles = rng.normal(size=(5, 8))
    rows = []
    for i in range(160):
        v = None if i % 4 == 0 else [float(x) for x in middles[i % 5] + 0.25 * rng.normal(size=8)]
        if i % 10 == 9:
            v = rows[-5][4]
        rows.append((i, i % 2, i * 3 * HOUR, ("same words here" if i % 8 else "others"), v, None if v is None else f"m{i % 3 // 2}"))
    frame = spark.createDataFrame(rows, "news_id long, company long, seen_us long, title string, vector array<double>, model string")
    found = {r["news_id"]: r for r in events.novelty(frame).collect()}
    for i, company, seen, title, v, model in rows:
        earlier = [r for r in rows if r[1] == company and 0 < seen - r[2] <= 72 * HOUR and (r[4] is None) == (v is None) and r[5] == model]
        if v is None:
            same = [r[0] for r in earlier if r[3] == title]
            assert found[i]["prior"] == (min(same) if same else None)
            continue
        cos = lambda a, b: round(float(np.dot(a, b) / np.linalg.norm(a) / np.linalg.norm(b)), 9)
        best = max(((cos(v, r[4]), -r[0]) for r in earlier), default=None)
        assert found[i]["similarity"] == (None if best is None else best[0])
        assert found[i]["prior"] == (None if best is None or best[0] < 0.82 else -best[1])
    assert {r["novelty"] for r in found.values()} == {"first", "repeat"}


def stored_bytes(spark):
    base = stage_base(spark).removeprefix("file:")
    return sum(os.path.getsize(os.path.join(d, f)) for d, _, names in os.walk(base) for f in names)


def test_word_sets_meet_alike_over_all_and_within_spans(spark, monkeypatch):
    rng = random.Random(12)
    words = [f"w{k}" for k in range(40)]
    titles = [" ".join(rng.sample(words, rng.randint(1, 30))) for _ in range(40)]
    titles += [" ".join(w for w in t.split() if rng.random() < 0.8) for t in titles]
    rows = [(i, i % 3 if i % 50 else None, rng.randint(0, 400 * HOUR), rng.choice(titles)) for i in range(240)]
    frame = spark.createDataFrame(rows, "news_id long, company long, seen_us long, title string")
    expected = {}
    for i, company, seen, title in rows:
        earlier = [r for r in rows if r[1] == company and 0 < seen - r[2] <= 72 * HOUR]
        if company is None:  # unknown companies: equal words only
            earlier = [r for r in earlier if set(r[3].split()) == set(title.split())]
        share = lambda a, b: len(a & b) / len(a | b) if a and b else 0.0
        best = max(((share(set(title.split()), set(r[3].split())), -r[0]) for r in earlier), default=(0.0, 0))
        expected[i] = (best[0], -best[1], "repeat") if best[0] >= 0.5 else (None, None, "first")
    for over_all in (True, False):
        monkeypatch.setattr(events, "_spread_over_all", lambda copies, sets, answer=over_all: answer)
        found = {r["news_id"]: (r["similarity"], r["prior"], r["novelty"]) for r in events.novelty(frame).collect()}
        assert found == expected
    assert 20 < sum(e[2] == "repeat" for e in expected.values()) < 220


def test_stored_headlines_do_not_grow_with_their_titles(spark, monkeypatch):
    titles = F.array(*[F.lit(" ".join(f"word{(7 * k + i) % 900}" for i in range(60))) for k in range(20)])
    rows = spark.range(20000).select(
        F.col("id").alias("news_id"), (F.col("id") % 3).alias("company"), (F.col("id") * 60_000_000).alias("seen_us"), F.element_at(titles, (F.col("id") % 20 + 1).cast("int")).alias("title")
    )
    before = stored_bytes(spark)
    judged = events.novelty(rows)
    assert judged.where("novelty = 'repeat'").count() > 19000
    assert stored_bytes(spark) - before < 20000 * 40  # kept as words they take a kilobyte each
    path = shared_folder(spark, "titles")
    schema = "news_id long, company long, seen_us long, title string"
    rows.coalesce(1).write.parquet(f"{path}/in")
    before = stored_bytes(spark)
    jobs.novelty(spark.readStream.schema(schema).parquet(f"{path}/in"), f"{path}/table", f"{path}/progress").awaitTermination()
    assert jobs.judgements(spark, f"{path}/table", "novelty").where("novelty = 'repeat'").count() > 19000
    assert stored_bytes(spark) - before < 20000 * 120


def test_all_alert_kinds_equal_the_batch_rows_however_they_arrive(spark):
    rng, day = random.Random(6), date(2024, 1, 1)
    rules = [(k, ("filing", "earnings", "news", "insider", "price")[k % 5], 300.0, 0.05, day) for k in range(25)]
    rules = spark.createDataFrame(rules, "rule_id long, kind string, min_value double, min_move double, since date")
    scope = spark.createDataFrame([(k, c) for k in range(25) for c in range(8) if (k + c) % 3], "rule_id long, company long")
    on = lambda: day + timedelta(days=rng.randint(-5, 40))
    filings = [(a, a % 8, rng.choice(["10-K", "8-K", "4", "10-Q/A"]), on(), a % 3 == 0) for a in range(80)]
    news = [(i, i % 8, rng.choice(["first", "repeat"]), on()) for i in range(80)]
    trades = [(i, i % 8, rng.choice("PS"), rng.uniform(1, 50), rng.uniform(1, 50), on()) for i in range(80)]
    closes = [(c, day + timedelta(days=d), 100 + rng.uniform(-9, 9)) for c in range(8) for d in range(20) for _ in range(2)]
    tables = {
        "filings": spark.createDataFrame(filings, "accession long, company long, form string, filed_date date, is_earnings boolean"),
        "events": spark.createDataFrame(news, "news_id long, company long, novelty string, event_day date"),
        "trades": spark.createDataFrame(trades, "tx_id long, company long, code string, shares double, price double, tx_date date"),
        "closes": spark.createDataFrame(closes, "company long, trade_date date, close double"),
    }
    base = shared_folder(spark, "alerts")
    streams = {name: pieces(spark, frame, 1 if name == "closes" else 3) for name, frame in tables.items()}
    for stream in jobs.alerts(streams, rules, scope, f"{base}/table", f"{base}/progress"):
        stream.awaitTermination()
    daily = tables["closes"].groupBy("company", "trade_date").agg(F.max("close").alias("close"))
    expected = events.alert_candidates(rules, scope, tables["filings"], tables["events"], tables["trades"], daily)
    columns = ["rule_id", "company", "kind", "subject_key"]
    found = [tuple(r) for name in streams for r in spark.read.parquet(f"{base}/table/{name}").select(*columns).collect()]
    assert sorted(found) == sorted(tuple(r) for r in expected.select(*columns).collect())
    assert {r[2] for r in found} == {"filing", "earnings", "news", "insider", "price"}


def test_watched_pairs_come_once_and_are_not_sent_again(spark):
    rules = [(1, ["A", "B"], 10), (2, ["A"], None), (3, None, 10), (3, ["C"], 11), (4, ["C", "C"], 11), (4, ["C"], 11), (None, ["B"], 10), (5, ["Z"], 12)]
    listings = [("A", 100, True), ("A", 100, True), ("A", 101, True), ("B", 100, True), ("C", 7, True), ("C", 8, False), ("B", None, True)]
    lists = [(10, 100), (10, 100), (10, 102), (11, 7), (11, 102), (10, None), (13, 5)]
    tables = (
        spark.createDataFrame(rules, "rule_id long, tickers array<string>, watchlist_id long"),
        spark.createDataFrame(listings, "ticker string, company long, is_active boolean"),
        spark.createDataFrame(lists, "watchlist_id long, company long"),
    )
    expected = {(r, c) for r, tickers, w in rules for t in tickers or [] for k, c, active in listings if active and k == t}
    expected |= {(r, c) for r, _, w in rules for k, c in lists if w == k}
    scope = events.alert_scope(*tables)
    key = lambda row: tuple((x is not None, x or 0) for x in row)
    assert sorted(map(tuple, scope.collect()), key=key) == sorted(expected, key=key)
    # pairs are made by the last join and written as they come
    assert "Aggregate" not in scope._jdf.queryExecution().executedPlan().toString()
    kinds = spark.createDataFrame([(k, "news" if k % 2 else "price", 0.0, 0.0, date(2024, 1, 1)) for k in (1, 1, 2, 3, 4)], "rule_id long, kind string, min_value double, min_move double, since date")
    news = spark.createDataFrame([(i, c, "first", date(2024, 1, 1 + i % 3)) for i, c in enumerate((100, 101, 7, 102, None, 100))], "news_id long, company long, novelty string, event_day date")
    both = [sorted(map(tuple, events.news_candidates(events.scoped_rules(kinds, s), news).collect())) for s in (scope, events.watch(*tables))]
    assert both[0] == both[1]
    made = [(r, c, "news", f"event:{i}") for k in (1, 1, 3) for r, c in expected if r == k for i, n, _, _ in news.collect() if n == c is not None]
    assert both[0] == sorted(made)


def test_price_moves_keep_two_days_whatever_order_they_come_in(spark):
    day = date(2024, 1, 1)
    closes = [(c, day + timedelta(days=d), 10.0 + (d * 7 + c * 3 + k) % 11) for c in range(3) for d in range(12) for k in range(3)]
    frame = spark.createDataFrame(closes, "company long, trade_date date, close double")
    base = shared_folder(spark, "moves")
    write = lambda batch, epoch: batch.withColumn("epoch", F.lit(epoch)).write.mode("append").parquet(f"{base}/out")
    stream = jobs.price_moves(pieces(spark, frame, 5)).writeStream.outputMode("update").foreachBatch(write)
    stream.option("checkpointLocation", f"{base}/progress").trigger(availableNow=True).start().awaitTermination()
    last = spark.read.parquet(f"{base}/out").groupBy("company").agg(F.max_by(F.struct("last_day", "move"), "epoch").alias("b")).select("company", "b.*")
    daily = frame.groupBy("company", "trade_date").agg(F.max("close").alias("close"))
    assert sorted(map(tuple, last.collect())) == sorted(map(tuple, events.last_moves(daily).collect()))


def test_headline_rules_are_tried_wherever_they_match(spark):
    import re

    from tidemark.functions.lookups import HEADLINE_RULES

    titles = [
        "Firm FILES for Chapter 11", "restates accounts", "Hackers hit firm", "to acquire a rival", "Spin-off planned", "Q3 results beat", "tops estimates",
        "second quarter sales", "Outlook cut", "steps down", "names a new chief", "successor found", "hires new head", "dividend", "share offering", "raises $5m",
        "sues rival", "court ruling", "FTC asks", "downgraded by broker to sell", "price target up", "initiates coverage", "rolls out", "recalls cars", "nothing", "", None,
    ]
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(titles)], "k long, title string")
    found = {r["k"]: (r["kind"], r["d"]["event_type"], r["d"]["matched"]) for r in rows.select("k", events.headline_type(F.col("title")).alias("kind"), events.decided(F.col("title")).alias("d")).collect()}
    for k, title in enumerate(titles):
        hits = [(kind, m[0]) for kind, p in HEADLINE_RULES if (m := re.search(f"(?i){p}", title or ""))]
        kind, words = hits[0] if hits else ("other", None)
        assert found[k] == (kind, kind, words)
