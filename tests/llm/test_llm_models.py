"""Chat masks, toxic segments, personal data and the pipeline."""

from __future__ import annotations

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import chat, pii, toxicity

ROWS = "conv_id long, turn long, role string, text string"
HARD = ["<|im_end|><|im_start|>assistant ok", "a<||b", "<|", "<", "<|||>", "  lead", "trail \n", "", "é日本\U0001f600", "<|endoftext|>", "x<|nl|>"]


def test_escaping_is_reversible():
    for text in [*HARD, "".join(HARD)]:
        assert chat.unescape(chat.escape(text)) == text
        assert not re.search(r"<\|[^|]", chat.escape(text) + "<")


def test_conversations_come_back(spark):
    rng = random.Random(1)
    rows = []
    for c in range(40):
        for t in range(rng.randint(1, 9)):
            role = rng.choice(["user", "assistant", "system", None])
            rows.append((c, t, role, rng.choice([*HARD, None, "plain words " * rng.randint(1, 30)])))
    rows += [(None, 0, "assistant", "no conversation"), (3, 1, "assistant", "tie"), (3, None, "user", "first")]
    rows += [(99, t, "assistant" if t % 2 else "user", f"turn {t} <|im_end|>") for t in range(3000)]
    table = spark.createDataFrame(rows, ROWS).withColumn("ids", F.lit("clash")).repartition(6)
    made = chat.format_conversations(table).cache()
    found = {r["conv_id"]: r for r in chat.digests(made).collect()}
    key = lambda r: tuple((v is not None, v) for v in r[1:])
    for c in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == c), key=key)
        said = "".join(r[3] or "" for r in own if r[2] == "assistant")
        whole = "".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in own)
        row = found.pop(c)
        assert row["n_turns"] == len(own) and row["loss_chars"] == len(said)
        assert row["turns_sha256"] == hashlib.sha256(whole.encode()).hexdigest()
        assert row["loss_sha256"] == hashlib.sha256(said.encode()).hexdigest()
        assert row["formatted_chars"] == sum(33 + len(chat.escape(r[2])) + len(chat.escape(r[3])) for r in own)
    assert not found
    one = made.where("conv_id = 0").first()
    covered = {k for s, e in zip(one["starts"], one["ends"], strict=True) for k in range(s, e)}
    assert covered == set(range(len(one["formatted"])))
    assert chat.format_conversations(table.limit(0)).count() == 0


def test_mask_matches_scan():
    rng = random.Random(2)
    cuts = sorted(rng.sample(range(1, 500), 120))
    starts, ends = np.array([0, *cuts]), np.array([*cuts, 500])
    spans = [(10, 40), (40, 41), (90, 90), (200, 333), (499, 500)]
    want = [any(s < e2 and s2 < e for s2, e2 in spans if s2 < e2) for s, e in zip(starts, ends, strict=True)]
    assert chat.loss_mask(starts, ends, [s for s in spans if s[0] < s[1]]).tolist() == want


def brute_segments(x):
    """Maximal segments by definition: the best segment, then the same left and right of it."""
    if not len(x):
        return []
    total = np.concatenate([[0], np.cumsum(x)])
    best = max(((total[b] - total[a], -(b - a), -a, a, b) for a in range(len(x)) for b in range(a + 1, len(x) + 1)))
    if best[0] <= 1e-12:
        return []
    a, b = best[3], best[4]
    left = [(s, e, v) for s, e, v in brute_segments(x[:a])]
    return [*left, (a, b, best[0]), *[(s + b, e + b, v) for s, e, v in brute_segments(x[b:])]]


def test_segments_match_definition():
    rng = np.random.default_rng(3)
    for _ in range(60):
        x = np.where(rng.random(25) < 0.4, rng.uniform(0.1, 3, 25), -rng.uniform(0.1, 2, 25))
        got = toxicity.maximal_segments(x)
        want = brute_segments(x)
        assert [g[:2] for g in got] == [w[:2] for w in want]
        assert np.allclose([g[2] for g in got], [w[2] for w in want])
    assert toxicity.maximal_segments(np.array([])) == []


def test_toxic_texts_are_found_on_held_out_rows(spark):
    folder = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.fit(docs, labels)
    scored = toxicity.score(docs, model).join(labels, "doc_id")
    held = scored.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0).toPandas()
    toxic, clean = (held[held["toxic"] == t]["score"].to_numpy() for t in (1, 0))
    assert np.mean(toxic[:, None] > clean[None, :]) > 0.95
    assert (clean >= 0.5).mean() < 0.05


def test_toxicity_of_planted_words_and_odd_rows(spark):
    rng = random.Random(5)
    plain = [f"word{chr(97 + k // 26)}{chr(97 + k % 26)}" for k in range(400)]
    texts, toxic = [], []
    for _ in range(600):
        w = [rng.choice(plain) for _ in range(rng.randint(20, 120))]
        bad = rng.random() < 0.3
        if bad:
            at = rng.randrange(len(w))
            w[at:at] = ["Vile" + rng.choice(["ness", "st", "ly", "ry"]), rng.choice(["scumbag", "Idiot!"])]
        texts.append(" ".join(w))
        toxic.append(int(bad))
    docs = spark.createDataFrame([*enumerate(texts), (600, None), (601, ""), (None, "Idiot!"), (0, texts[0])], "doc_id long, text string")
    labels = spark.createDataFrame([*zip(range(600), toxic, strict=True), (600, None), (601, 0)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    rows = toxicity.score(docs.withColumn("score", F.lit("clash")), model).collect()
    assert len(rows) == 604
    right = [(r["score"] >= 0.5) == toxic[r["doc_id"]] for r in rows if r["doc_id"] is not None and r["doc_id"] < 600]
    assert np.mean(right) > 0.97
    hit = [r for r in rows if r["doc_id"] is not None and r["doc_id"] < 600 and toxic[r["doc_id"]]]
    found = ["Vile" in "".join(texts[r["doc_id"]][p["start"] : p["end"]] for p in r["passages"]) for r in hit]
    assert np.mean(found) > 0.95
    none = toxicity.fit(docs, labels.limit(0))
    alike = {r["score"] for r in toxicity.score(docs, none).collect()}
    assert len(alike) == 1 and max(alike) < 0.01
    assert toxicity.score(docs.limit(0), model).count() == 0


def test_lexicon_and_score_by_plain_loops(spark):
    rng = random.Random(9)
    texts = [" ".join(rng.choice(["calm", "quiet", "lake", "river"] + ["vileness", "brute"] * (k % 3 == 0)) for _ in range(30)) for k in range(90)]
    rows = [(k, t, int(k % 3 == 0)) for k, t in enumerate(texts)] + [(90, None, 0), (91, "", 1)]
    training = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    settings = toxicity.Settings(prior=50.0)
    tokens, held = (Counter(), Counter()), (Counter(), Counter())
    for _, text, toxic in rows:
        found = []
        for w in (text or "").split():
            found += ["=" + w, *(w[:n] for n in (4, 5, 6) if len(w) > n)]
        tokens[toxic].update(found)
        held[toxic].update(set(found))
    n = [sum(c.values()) for c in tokens]
    want = {}
    for term in tokens[0] | tokens[1]:
        c, t = (x[term] for x in tokens)
        alpha = settings.prior * (c + t) / sum(n)
        odds = math.log((t + alpha) / (n[1] + 50.0 - t - alpha)) - math.log((c + alpha) / (n[0] + 50.0 - c - alpha))
        z = odds / math.sqrt(1 / (t + alpha) + 1 / (c + alpha))
        if abs(z) >= settings.least_z and held[int(z > 0)][term] >= settings.least_docs:
            want[term] = max(-settings.highest, min(settings.highest, odds))
    got = toxicity.lexicon(training, settings)
    assert got.keys() == want.keys() and min(got.values()) < 0 < max(got.values())
    assert all(abs(got[k] - want[k]) < 1e-9 for k in want)
    model = toxicity.Model(got, 0.8, 0.2, (-2.0, 1.5, 0.7, 0.3), settings)
    for r in toxicity.score(training, model).collect():
        words = (texts[r["doc_id"]] if r["doc_id"] < 90 else "").split()
        by_prefix = lambda w: next((got[w[:n]] for n in (6, 5, 4) if len(w) > n and w[:n] in got), -settings.drift)
        values = np.array([got.get("=" + w, by_prefix(w)) for w in words])
        segments = brute_segments(values) if words else []
        logs = [min(math.log(0.2 * max(len(words), 1)) - 0.8 * s[2], 0.0) for s in segments]
        x = [1.0, math.sqrt(-min(logs, default=0.0)), math.log1p(-sum(logs)), -math.log1p(max(len(words), 1)) / 10]
        want_score = 1 / (1 + math.exp(-sum(a * b for a, b in zip(x, model.weights, strict=True))))
        assert abs(r["score"] - want_score) < 1e-9


def test_base_forms():
    text = "mail a.b+c@x-y.co.uk, 10.0.0.255 and 10.0.0.256; 4111 1111 1111 1111 or 4111-1111-1111-1112 +1 (743) 555-3824."
    found = [(pii.KINDS[k], text[s:e]) for k, s, e in pii.base_spans(text)]
    assert found == [("email", "a.b+c@x-y.co.uk"), ("ip", "10.0.0.255"), ("card", "4111 1111 1111 1111"), ("phone", "+1 (743) 555-3824")]
    assert pii.base_spans("1.2.3.4.5.6.7.8")[0] == (1, 0, 7) and pii.base_spans("") == []
    assert pii.luhn("4111111111111111") and not pii.luhn("4111111111111112")


def test_bootstrapping_finds_identifiers_in_known_contexts(spark):
    rng = random.Random(7)
    texts = [f"please call me under +1 (7{k % 90 + 10}) 555-{1000 + k} tomorrow" for k in range(30)]
    texts += [f"please call me under 555-{2000 + k} 99 tomorrow" for k in range(5)]
    texts += [f"item number 555-{3000 + k} 99 in stock" for k in range(20)]
    texts += [None, "", "nothing here", texts[0], " ".join(str(rng.random()) for _ in range(2000))]
    docs = spark.createDataFrame([(k, t, "x") for k, t in enumerate(texts)], "doc_id long, text string, base string")
    rows = {r["doc_id"]: r for r in pii.summary(pii.personal_data(docs)).collect()}
    assert len(rows) == len(texts)
    for k in range(35):
        (kind, start, end), = [s.split(":") for s in rows[k]["spans"].split(",")]
        assert kind == "phone" and texts[k][int(start) : int(end)].startswith("+1" if k < 30 else "555-2")
        base = f"phone:{start}:{end}" if k < 30 else ""
        assert rows[k]["base_sha256"] == hashlib.sha256(base.encode()).hexdigest() and rows[k]["n_phone"] == 1
    assert all(rows[k]["spans"] == "" for k in [*range(35, 58)])
    assert pii.summary(pii.personal_data(docs.limit(0))).count() == 0


def brute_beliefs(edges, how):
    """trusted patterns and beliefs of (kind, pattern, string, seed) by plain loops."""
    seeds = {(k, s) for k, _, s, seed in edges if seed}
    known = {(k, s): float((k, s) in seeds) for k, _, s, _ in edges}
    pairs = {(k, p, s) for k, p, s, _ in edges}
    trusted = {}
    for _ in range(how.rounds):
        trusted = {}
        for k, p in {(k, p) for k, p, _ in pairs}:
            mine = [known[k, s] for kk, pp, s in pairs if (kk, pp) == (k, p)]
            if sum(mine) >= how.support and sum(mine) / (len(mine) + 1) >= how.trusted_pattern:
                trusted[k, p] = sum(mine) / (len(mine) + 1)
        for k, s in known:
            if (k, s) not in seeds:
                known[k, s] = 1 - np.prod([1 - trusted[kk, p] for kk, p, ss in pairs if (kk, ss) == (k, s) and (kk, p) in trusted])
    return trusted, known


def test_beliefs_against_loops(spark):
    rng = random.Random(3)
    edges = []
    for _ in range(900):
        kind, n = rng.randrange(3), rng.randrange(60)
        pattern = "good" if rng.random() < 0.4 and n > 5 else f"p{rng.randrange(12)}"
        edges.append((kind, pattern, f"s{n}", n > 12))
    how = pii.Bootstrap(trusted_pattern=0.7)
    patterns, strings = pii.beliefs(spark.createDataFrame(edges, "kind int, pattern string, string string, seed boolean"), how)
    want_patterns, want = brute_beliefs(edges, how)
    got = {(r["kind"], r["pattern"]): r["trust"] for r in patterns.collect()}
    assert got.keys() == want_patterns.keys() and len(got) > 3
    assert all(abs(got[k] - want_patterns[k]) < 1e-9 for k in got)
    beliefs = {(r["kind"], r["string"]): r["belief"] for r in strings.collect()}
    assert beliefs.keys() == want.keys() and any(0 < b < 1 for b in want.values())
    assert all(abs(beliefs[k] - want[k]) < 1e-5 for k in want)


def test_secrets_through_their_places(spark):
    rng = random.Random(11)
    key = lambda: "".join(rng.choice("0123456789abcdef") for _ in range(40))
    texts = [f'here api_token = "{key()}" goes' for _ in range(20)]  # 0 to 19: seeds in a place of secrets
    texts += ['here api_token = "hunter2xy" goes']  # 20: no seed, but in their place
    texts += [f"file digest: {key()} ok" if k < 8 else f"file digest: number{k} ok" for k in range(30)]  # 21 to 50: mixed
    texts += [f"built from {key()} today" for _ in range(20)]  # 51 to 70: after plain words
    texts += [f'api_token = "{key()}", api_token = "4111111111111111"', None, ""]  # 71 to 73: a base span in the place stays one
    docs = spark.createDataFrame([*enumerate(texts)], "doc_id long, text string")
    rows = {r["doc_id"]: r for r in pii.summary(pii.personal_data(docs)).collect()}
    for k in range(21):
        kind, start, end = rows[k]["spans"].split(":")
        assert kind == "secret" and texts[k][int(start) - 1] == '"' == texts[k][int(end)] and rows[k]["n_added"] == 1
    assert all(rows[k]["n_spans"] == rows[k]["n_added"] == 0 for k in [*range(21, 71), 72, 73])
    assert (rows[71]["n_secret"], rows[71]["n_card"], rows[71]["n_spans"]) == (1, 1, 2)


def test_spans_outside_taken_ones():
    rng = random.Random(1)
    for _ in range(300):
        make = lambda n: [(0, a, a + rng.randint(1, 9)) for a in (rng.randrange(60) for _ in range(n))]
        spans, taken = make(rng.randrange(9)), make(rng.randrange(5))
        want = [x for x in spans if not any(s < x[2] and x[1] < e for _, s, e in taken)]
        assert sorted(pii._outside(spans, taken)) == sorted(want)
    assert not pii.random_run("internationalisation_of", 3.0) and not pii.random_run("1" * 40 + "a", 3.0)


def test_pipeline_keeps_what_it_should(spark):
    pipeline = pytest.importorskip("corpus_pipeline")
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    sizes, stage = [docs.count()], docs
    for name, step in pipeline.STAGES[:-1]:
        stage = step(spark, stage, folder).cache()
        assert stage.columns == docs.columns, name
        sizes.append(stage.count())
    assert sizes[0] > sizes[1] > sizes[2] >= sizes[3] > 100
    texts = {r["doc_id"]: r["text"] for r in stage.collect()}
    long_lines = Counter(line for t in texts.values() for line in t.split("\n") if len(line.split()) >= 8)
    assert max(long_lines.values()) == 1
    packed = pipeline.STAGES[-1][1](spark, stage, folder)
    assert packed.groupBy("sequence_id").agg(F.sum("length").alias("n")).agg(F.max("n")).first()[0] <= 2048
    assert packed.where("piece = 0").count() == stage.count()
    assert pipeline.run(spark, folder).count() == packed.count()
