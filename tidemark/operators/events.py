"""Headlines and events: linking, classification, novelty, story clusters and alerts."""

from __future__ import annotations

from itertools import count
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.functions.lookups import (
    CLASSIFIER_VERSION,
    EIGHT_K_TITLES,
    EIGHT_K_TYPES,
    EVENT_TYPES,
    HEADLINE_RULES,
    NAME_ENDINGS,
    STOP_WORDS,
    TICKER_PATTERNS,
)
from tidemark.operators.search import usable
from tidemark.session import Stages

NOVELTY_US = 72 * 3600 * 1_000_000
REPEAT_OVERLAP = 0.5
REPEAT_COSINE = 0.82


def in_spans(rows: DataFrame, span: int = NOVELTY_US) -> DataFrame:
    """Each row in its own time span and, as context, in the next one. Trailing windows of one
    span then see all they need inside (key, _slot), and a hot key is spread over time."""
    own = F.floor(F.col("seen_us") / span)
    return rows.withColumn("_own", own).withColumn(
        "_slot", F.explode(F.array(F.col("_own"), F.col("_own") + 1))
    )


def recent_window(news: DataFrame, span: int = NOVELTY_US) -> DataFrame:
    """Per headline: how many of the company's headlines came in the span before it, and the
    lowest id among them and itself."""
    rows = in_spans(news.select("news_id", "company", "seen_us"), span)
    frame = Window.partitionBy("company", "_slot").orderBy("seen_us").rangeBetween(-span, 0)
    counted = rows.withColumn("earlier", F.count(F.lit(1)).over(frame) - 1).withColumn(
        "first_id", F.min("news_id").over(frame)
    )
    return counted.where("_slot = _own").select("news_id", "company", "earlier", "first_id")


# --- Linking and classification -----------------------------------------------------------


#: Any number of legal endings one after another.
ALL_ENDINGS = f"(?i)(?:{NAME_ENDINGS.removeprefix('(?i)').removesuffix('$')}[ ,.]*)+$"


def short_name(legal_name: Column) -> Column:
    """Name as headlines write it: all legal endings removed, all-capital names title-cased."""
    name = F.regexp_replace(F.replace(legal_name, F.lit("&amp;"), F.lit("&")), r"\s+", " ")
    name = F.regexp_replace(F.regexp_replace(F.trim(name), ALL_ENDINGS, ""), r"^[ ,.]+|[ ,.]+$", "")
    words = F.transform(
        F.split(name, " "), lambda w: F.when(F.length(w) <= 3, w).otherwise(F.initcap(F.lower(w)))
    )
    capitals = (name == F.upper(name)) & (name != F.lower(name))
    return F.when(capitals, F.array_join(words, " ")).otherwise(name)


def _literal(text: Column) -> Column:
    return F.concat(F.lit(r"\Q"), text, F.lit(r"\E"))


def mention(title: Column, name: Column, tickers: Column) -> Column:
    """How a headline names a company: title_ticker, title_name, or query_only (low confidence).

    `tickers`: all listed ones of the company, as an array; null or empty names none."""
    pattern = lambda kind, t: F.concat(F.lit(TICKER_PATTERNS[kind][0]), _literal(t), F.lit(TICKER_PATTERNS[kind][1]))
    named = F.concat(F.lit(r"(?i)\b"), _literal(name), F.lit(r"(?:'s)?\b"))
    by_ticker = F.exists(
        F.coalesce(tickers, F.array().cast("array<string>")),
        lambda t: F.regexp_like(title, pattern("exchange", t))
        | F.regexp_like(title, pattern("cash", t))
        | ((F.length(t) >= 3) & F.regexp_like(title, pattern("bare", t))),
    )
    return (
        F.when(by_ticker, "title_ticker")
        .when((name != "") & F.regexp_like(title, named), "title_name")
        .otherwise("query_only")
    )


#: Of each rule, what any text it matches holds one of, in lower case.
_STEMS = {
    "bankruptcy": ("chapter 11", "bankrupt", "insolven"),
    "restatement": ("restat", "accounting error"),
    "cybersecurity": ("cyber", "data breach", "ransomware", "hack"),
    "m_and_a": ("acqui", "merg", "takeover", "buyout", "divest", "spin"),
    "earnings": ("earnings", "quarter", "q1", "q2", "q3", "q4", "beats", "misses", "tops"),
    "guidance": ("guidance", "outlook", "forecast"),
    "leadership": ("resign", "step", "retir", "appoint", "name", "succe", "ousted", "fired", "hire"),
    "capital_return": ("dividend", "buyback", "repurchase"),
    "financing": ("offering", "credit facility", "raises $"),
    "legal_regulatory": (
        "lawsuit", "sue", "settle", "antitrust", "probe", "investigation", "fined", "regulator", "ftc", "doj", "court", "ruling",
        "verdict", "subpoena",
    ),
    "analyst": ("grade", "price target", "initiate", "overweight", "underweight", "outperform", "underperform"),
    "product": ("launch", "unveil", "recall", "roll"),
}


def _by_rule(title: Column, value) -> Column:
    """value(kind, pattern) of the first rule that matches, null where none does; a rule is tried where one of its stems stands."""
    found = F.when(title.isNull(), F.lit(None))
    for kind, pattern in HEADLINE_RULES:
        stems = F.lit(False)
        for stem in _STEMS[kind]:
            stems = stems | F.contains(F.lower(title), F.lit(stem))
        found = found.when(stems & title.rlike(f"(?i){pattern}"), value(kind, f"(?i){pattern}"))
    return found


def headline_type(title: Column) -> Column:
    return F.coalesce(_by_rule(title, lambda kind, _: F.lit(kind)), F.lit("other"))


def decided(title: Column) -> Column:
    """A headline's type and the words that decided it (null for other headlines), found together."""
    found = _by_rule(title, lambda kind, pattern: F.struct(F.lit(kind).alias("event_type"), F.regexp_extract(title, pattern, 0).alias("matched")))
    return F.coalesce(found, F.struct(F.lit("other").alias("event_type"), F.lit(None).cast("string").alias("matched")))


def filing_type(items: Column) -> Column:
    """The most consequential event type among a report's items."""
    place = {i: EVENT_TYPES.index(kind) for i, kind in EIGHT_K_TYPES.items()}
    table = F.create_map(*[F.lit(x) for pair in place.items() for x in pair])
    best = F.array_min(F.array_compact(F.transform(items, lambda i: F.try_element_at(table, i))))
    names = F.array(*[F.lit(k) for k in EVENT_TYPES])
    return F.coalesce(F.try_element_at(names, best + 1), F.lit("disclosure"))


def filing_title(form: Column, items: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in EIGHT_K_TITLES.items() for x in pair])
    described = F.transform(
        F.filter(items, lambda i: (i != "9.01") & F.map_contains_key(table, i)),
        lambda i: F.concat(i, F.lit(" "), F.try_element_at(table, i)),
    )
    text = F.array_join(described, "; ")
    return F.substring(
        F.concat(form, F.lit(": "), F.when(text != "", text).otherwise("Current report")), 1, 500
    )


def filing_events(filings: DataFrame, events: DataFrame) -> DataFrame:
    """One event per current report that has none; primary sources are always first reports."""
    todo = filings.where(F.col("form").isin("8-K", "8-K/A")).join(events, "accession", "left_anti")
    return todo.select(
        "company", "accession", filing_type(F.col("items")).alias("event_type"),
        filing_title(F.col("form"), F.col("items")).alias("title"),
        F.coalesce("accepted_at", F.col("filed_date").cast("timestamp")).alias("occurred_at"),
        F.lit("first").alias("novelty"), F.lit(CLASSIFIER_VERSION).alias("version"),
    )


def reclassify(events: DataFrame) -> DataFrame:
    """Relabel events of an older rule version; novelty and clusters stay."""
    stale = ~F.col("version").eqNullSafe(CLASSIFIER_VERSION)
    return events.withColumn(
        "event_type", F.when(stale, headline_type(F.col("title"))).otherwise(F.col("event_type"))
    ).withColumn("version", F.lit(CLASSIFIER_VERSION))


def dedupe(news: DataFrame) -> DataFrame:
    """One row per provider and address, the earliest seen."""
    keyed = news.withColumn("url_sha256", F.sha2("url", 256))
    rest = [c for c in keyed.columns if c not in ("provider", "url_sha256")]
    first = F.min_by(F.struct(*rest), F.struct("seen_us", "news_id")).alias("_row")
    return keyed.groupBy("provider", "url_sha256").agg(first).select("provider", "url_sha256", "_row.*")


# --- Novelty ------------------------------------------------------------------------------


def story_words(title: Column) -> Column:
    """Sorted distinct words of a headline without stop words and single letters."""
    stop = F.array(*[F.lit(w) for w in STOP_WORDS])
    words = F.regexp_extract_all(F.lower(title), F.lit("([a-z0-9]+)"), 1)
    return F.array_sort(F.filter(F.array_except(words, stop), lambda w: F.length(w) > 1))  # each once


def jaccard(a: Column, b: Column) -> Column:
    shared = F.size(F.array_intersect(a, b))
    both = F.size(a) + F.size(b) - shared
    return F.when((F.size(a) > 0) & (F.size(b) > 0), shared / both).otherwise(0.0)


#: Longs of parities that a word set has.
_PARITIES = 4


def _parity(hashes: Column, k: int) -> Column:
    """Bit h mod 64 is set where an odd number of words have it, of those whose next two bits are k."""
    bit = lambda h: F.call_function("shiftleft", F.lit(1).cast("long"), h.bitwiseAND(F.lit(63)).cast("int"))
    mine = lambda h: F.shiftright(h, 6).bitwiseAND(F.lit(_PARITIES - 1)) == k
    return F.aggregate(hashes, F.lit(0).cast("long"), lambda bits, h: F.when(mine(h), bits.bitwiseXOR(bit(h))).otherwise(bits))


def _spread_over_all(copies: DataFrame, sets: int) -> bool:
    """Whether pairs of sets meet less often if all sets meet once than if those of each company and span do.

    By the sizes of the spans, each taken with the one before, as if sets fell into them by chance: a pair meets wherever both are."""
    sizes = copies.groupBy("company", "_slot").agg(F.count(F.lit(1)).alias("n"))
    both = F.pow(1 - F.exp(-2 * F.col("n") / F.lit(max(1, sets))), F.lit(2.0))
    return (sizes.agg(F.sum(both).alias("times")).first()["times"] or 0.0) >= 1


def _similar_sets(words: DataFrame, threshold: float, stages: Stages, asked: DataFrame | None = None, known: DataFrame | None = None) -> DataFrame:
    """Word sets (key, words by their hashes) → (key, other, score) of those that reach the overlap, both ways round. Where sets asked for and known
    in a span (company, _slot, key) are given, those that meet in one only, with company and _slot.

    Sets that overlap enough share one of their rarest words (prefix filtering), so pairs meet only there. Sizes and the parities
    of the words' hashes (a word that one set has alone flips one) rule out most of them at once; the others are scored once."""
    token = words.select("key", F.explode("words").alias("token"))
    marks = words.select("key", *[_parity(F.col("words"), k).alias(f"p{k}") for k in range(_PARITIES)])
    ranked = token.join(token.groupBy("token").agg(F.count(F.lit(1)).alias("df")), "token").groupBy("key").agg(
        F.array_sort(F.collect_list(F.struct("df", "token"))).alias("order")  # the words of one headline
    )
    size = F.size("order")
    length = size - F.ceil(size * F.lit(threshold)) + 1
    rare = F.slice("order", F.lit(1), length.cast("int"))["token"].alias("rare")
    rare = stages.keep(ranked.select("key", size.alias("n"), rare).join(marks, "key"), "rare")
    place = [] if asked is None else ["company", "_slot"]
    meet, tasks = [*place, "token"], int(words.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = lambda rows: rows.join(rare, "key") if place else rare
    bits, other_bits = [f"p{k}" for k in range(_PARITIES)], [f"q{k}" for k in range(_PARITIES)]
    at = lambda rows: placed(rows).select(*place, "key", "n", *bits, F.explode("rare").alias("token")).repartition(tasks, *meet)
    right = at(known).toDF(*place, "other", "other_n", *other_bits, "token")
    total = F.col("n") + F.col("other_n")
    apart = sum((F.bit_count(F.col(p).bitwiseXOR(F.col(q))) for p, q in zip(bits, other_bits, strict=True)), F.lit(0))
    # sets of too different a size can't reach the overlap
    sizes = F.least("n", "other_n") >= threshold * F.greatest("n", "other_n")
    near = sizes & (apart * (1 + threshold) <= total * (1 - threshold) + 1e-6)
    once = F.col("key") != F.col("other") if place else F.col("key") < F.col("other")
    pairs = stages.keep(at(asked).join(right, meet).where(once & near).select(*place, "key", "other").distinct(), "pairs")
    scored = pairs.select("key", "other").distinct().join(words, "key").join(
        words.select(F.col("key").alias("other"), F.col("words").alias("other_words")), "other"
    )
    scored = scored.select("key", "other", jaccard(F.col("words"), F.col("other_words")).alias("score")).where(F.col("score") >= threshold)
    if place:
        return pairs.join(scored, ["key", "other"]).select("company", "_slot", "key", "other", "score")
    scored = stages.keep(scored, "scored")
    return scored.unionByName(scored.select(F.col("other").alias("key"), F.col("key").alias("other"), "score"))


def _earlier_copies(rows: DataFrame, span: int) -> DataFrame:
    """Headlines (key: what they say) → each once in its span with prior, the lowest id of an earlier equal one within the span."""
    frame = Window.partitionBy("company", "_slot", "key").orderBy("seen_us").rangeBetween(-span, -1)
    spread = in_spans(rows, span).withColumn("prior", F.min("news_id").over(frame))
    return spread.where("_slot = _own").drop("_own")


def _by_words(rows: DataFrame, words: DataFrame, threshold: float, span: int, stages: Stages) -> DataFrame:
    """Headlines (news_id, company, seen_us, key) and their word sets (key, words) → news_id, similarity, prior of those with an
    earlier one whose words overlap enough.

    An equal word set is the best there can be, so only headlines without one ask other sets: the first of a story in a span.
    What they ask for are word sets, answered by trailing windows over each set's occurrences."""
    copies = stages.keep(_earlier_copies(rows, span), "copies")
    same = copies.where("prior is not null").select("news_id", F.lit(1.0).alias("similarity"), "prior")
    asks = copies.where("prior is null and company is not null").select("news_id", "company", "seen_us", "key", "_slot")
    spread = in_spans(copies.drop("_slot", "prior"), span)
    if _spread_over_all(copies, words.count()):
        similar, group = _similar_sets(words, threshold, stages), ["key"]
    else:
        sets = lambda found: found.select("company", "_slot", "key").distinct()
        similar, group = _similar_sets(words, threshold, stages, sets(asks), sets(spread)), ["company", "_slot", "key"]
    similar = stages.keep(similar, "similar")
    asks = asks.join(similar, group).select(
        "news_id", "company", "seen_us", "_slot", F.col("other").alias("target"), "score"
    ).withColumn("_event", F.lit(None).cast("bigint"))
    known = spread.join(similar.select(F.col("other").alias("key")).distinct(), "key", "left_semi").select(
        F.lit(None).cast("bigint").alias("news_id"), "company", "seen_us", "_slot",
        F.col("key").alias("target"), F.lit(None).cast("double").alias("score"), F.col("news_id").alias("_event"),
    )
    frame = Window.partitionBy("company", "_slot", "target").orderBy("seen_us").rangeBetween(-span, -1)
    answered = asks.unionByName(known).withColumn("prior", F.min("_event").over(frame))
    found = answered.where(F.col("news_id").isNotNull() & F.col("prior").isNotNull())
    best = F.max(F.struct("score", (-F.col("prior")).alias("_neg"))).alias("b")
    other = found.groupBy("news_id").agg(best).select("news_id", F.col("b.score").alias("similarity"), (-F.col("b._neg")).alias("prior"))
    return same.unionByName(other)


#: Numbers of the vectors that one task holds of either side, and products it computes at once.
_BLOCK, _CHUNK = 1 << 22, 1 << 22


def _best_cosine(span: int):
    """Rows of one pair of blocks: headlines that ask, earlier ones and the vectors of both → per asking headline its nearest earlier one."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        names, kind = ["news_id", "similarity", "prior"], rows["_kind"].to_numpy()
        none = pd.DataFrame({"news_id": [], "similarity": [], "prior": []}).astype({"news_id": "int64", "similarity": "float64", "prior": "int64"})
        asks, known, said = (rows[kind == k] for k in range(3))
        if asks.empty or known.empty:
            return none
        said = said.drop_duplicates("key")
        place = pd.Series(np.arange(len(said)), index=said["key"].to_numpy())
        unit = np.stack(said["vector"].to_numpy()).astype(float)
        unit /= np.linalg.norm(unit, axis=1, keepdims=True)
        # by time, so that what a few headlines look back on stands together; the lowest id of a moment first
        asks, known = asks.sort_values("seen_us"), known.sort_values(["seen_us", "news_id"])
        ids, seen, at = (known[c].to_numpy() for c in ("news_id", "seen_us", "key"))
        at, asked = place[at].to_numpy(), place[asks["key"].to_numpy()].to_numpy()
        now, own = asks["seen_us"].to_numpy(), asks["news_id"].to_numpy()
        since, until = np.searchsorted(seen, now - span, "left"), np.searchsorted(seen, now, "left")
        top, prior = np.full(len(now), -np.inf), np.full(len(now), -1)
        step = max(1, min(256, _CHUNK // len(seen)))
        for k in range(0, len(now), step):
            some = slice(k, k + step)
            lo, hi = since[some].min(), until[some].max()
            for j in range(lo, hi, _CHUNK // step):
                part = slice(j, min(hi, j + _CHUNK // step))
                scores = unit[asked[some]] @ unit[at[part]].T
                within = np.arange(part.start, part.stop)
                scores[(within < since[some][:, None]) | (within >= until[some][:, None])] = -np.inf
                most = scores.max(1)
                for r in np.flatnonzero(np.isfinite(most)):
                    # equal but for rounding is a tie, and goes to the lowest id
                    best = np.round(most[r], 9)
                    tied = np.flatnonzero(scores[r] > best - 1e-9)
                    low = ids[part][tied[np.round(scores[r][tied], 9) == best]].min()
                    if best > top[k + r] or (best == top[k + r] and low < prior[k + r]):
                        top[k + r], prior[k + r] = best, low
        found = np.isfinite(top)
        return pd.DataFrame({"news_id": own[found], "similarity": top[found], "prior": prior[found]})[names]

    return run


def _by_vectors(rows: DataFrame, vectors: DataFrame, span: int, stages: Stages) -> DataFrame:
    """Headlines (news_id, company, seen_us, model, key) and their vectors (key, vector) → news_id, similarity, prior: the nearest
    earlier one of the company within the span.

    Only vectors of one model are compared. An equal vector is the nearest there can be; the other headlines are compared in
    blocks of vectors, of which each gives a headline's best only. A block gets each vector once."""
    copies = stages.keep(_earlier_copies(rows, span), "vector-copies")
    same = copies.where("prior is not null").select("news_id", F.lit(1.0).alias("similarity"), "prior")
    group = ["company", "_slot", "model"]
    sizes = vectors.agg(F.max(F.size("vector")).alias("n")).first()  # of the longest one
    most = max(1, _BLOCK // max(1, sizes["n"] or 1))
    columns = [*group, "news_id", "seen_us", "key"]
    asks = copies.where("prior is null and company is not null").select(*columns)
    spread = in_spans(copies.drop("_slot", "prior"), span).select(*columns)
    held = spread.groupBy(*group).agg(F.count(F.lit(1)).alias("_known")).join(asks.groupBy(*group).agg(F.count(F.lit(1)).alias("_asks")), group)
    held = stages.keep(held.select(*group, *[F.ceil(F.col(c) / most).cast("int").alias(c) for c in ("_known", "_asks")]), "vector-blocks")
    mine = lambda c: F.pmod(F.xxhash64("key"), F.col(c)).cast("int")
    every = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    none = F.lit(None).cast(vectors.schema["vector"].dataType).alias("vector")
    pair = [*group, "_a", "_b"]
    of = lambda found: found.join(held, group)
    left = of(asks).select(*columns, mine("_asks").alias("_a"), every("_known").alias("_b"))
    right = of(spread).select(*columns, every("_asks").alias("_a"), mine("_known").alias("_b"))
    # a headline that asks is in its own span, too
    said = of(spread.select(*group, "key").distinct()).join(vectors, "key")
    place, other = mine("_asks").alias("_a"), mine("_known").alias("_b")
    ends = said.select(*group, "key", "vector", place, every("_known").alias("_b")).unionByName(said.select(*group, "key", "vector", every("_asks").alias("_a"), other))
    blank = F.lit(None).cast("bigint")
    ends = ends.select(*group, blank.alias("news_id"), blank.alias("seen_us"), "key", "_a", "_b", F.lit(2).alias("_kind"), "vector")
    both = left.withColumn("_kind", F.lit(0)).unionByName(right.withColumn("_kind", F.lit(1))).withColumn("vector", none).unionByName(ends)
    found = both.groupBy(*pair).applyInPandas(_best_cosine(span), "news_id bigint, similarity double, prior bigint")
    best = F.max(F.struct("similarity", (-F.col("prior")).alias("_neg"))).alias("b")
    other = found.groupBy("news_id").agg(best).select("news_id", "b.similarity", (-F.col("b._neg")).alias("prior"))
    return same.unionByName(other)


def novelty(news: DataFrame, threshold: float = REPEAT_OVERLAP, span: int = NOVELTY_US, stages: Stages | None = None) -> DataFrame:
    """Per headline the most similar earlier one of the company within the span; ties go to the lowest id.

    Where news has columns `vector` and `model`, headlines with a vector are compared by cosine with earlier ones of the same
    model: the similarity is reported, and prior and repeat where it reaches REPEAT_COSINE. Others are compared by words and
    reported when they reach the overlap. The result is a table of `stages`, which its owner may close; what it is made from is
    gone then. Word sets and vectors are kept once each, headlines by their hashes."""
    stages = stages or Stages(news.sparkSession)
    base = ["news_id", "company", "seen_us"]
    by_vector = "vector" in news.columns
    near = usable(F.col("vector")) & F.col("model").isNotNull() if by_vector else F.lit(False)
    said = F.when(~near & F.col("title").isNotNull(), F.xxhash64("title")).alias("said")
    titles = news.where(~near & F.col("title").isNotNull()).select(F.xxhash64("title").alias("said"), "title").dropDuplicates(["said"])
    words = titles.select("said", story_words(F.col("title")).alias("words")).where(F.size("words") > 0)
    hashes = F.transform("words", lambda w: F.xxhash64(w)).alias("words")
    words = stages.keep(words.select("said", F.xxhash64(F.array_join("words", " ")).alias("key"), hashes), "words")
    sets = stages.keep(words.select("key", "words").dropDuplicates(["key"]), "sets")
    more = [F.when(near, F.col("model")).alias("model"), F.when(near, F.xxhash64("model", "vector")).alias("_vector")] if by_vector else []
    rows = news.select(*base, said, *more).join(words.select("said", "key"), "said", "left").drop("said")
    rows = stages.keep(rows, "rows")
    stages.free("words")
    chosen = _by_words(rows.where("key is not null").select(*base, "key"), sets, threshold, span, stages)
    if by_vector:
        vectors = news.where(near).select(F.xxhash64("model", "vector").alias("key"), "vector").dropDuplicates(["key"])
        vectors = stages.keep(vectors, "vectors")
        found = _by_vectors(rows.where("_vector is not null").select(*base, "model", F.col("_vector").alias("key")), vectors, span, stages)
        found = stages.keep(found, "by-vectors")
        stages.free("vectors", "vector-copies", "vector-blocks")
        chosen = chosen.unionByName(found.withColumn("prior", F.when(F.col("similarity") >= REPEAT_COSINE, F.col("prior"))))
    judged = rows.select(*base).join(chosen, "news_id", "left")
    judged = judged.withColumn("novelty", F.when(F.col("prior").isNotNull(), "repeat").otherwise("first"))
    judged = stages.keep(judged, "judged")
    stages.free(*[name for name in stages.names() if name != "judged"])
    return judged


def story_clusters(judged: DataFrame) -> DataFrame:
    """Cluster of each headline: the first report its chain of repeats leads to.

    Pointers double each round, so a chain of n repeats takes log2(n) joins."""
    stages = Stages(judged.sparkSession)
    links = stages.keep(judged.select("news_id", F.coalesce("prior", "news_id").alias("root")), "links-0")
    for k in count(1):
        up = links.select(F.col("news_id").alias("root"), F.col("root").alias("_up"))
        moved = links.join(up, "root").select("news_id", F.col("_up").alias("root"), (F.col("_up") != F.col("root")).alias("_moved"))
        links = stages.keep(moved, f"links-{k}")
        stages.free(f"links-{k - 1}")
        if links.where("_moved").isEmpty():
            return links.select("news_id", F.col("root").alias("cluster_id"))
        links = links.drop("_moved")


def cluster_sizes(clusters: DataFrame, news: DataFrame) -> DataFrame:
    """Reports and distinct outlets per story."""
    joined = clusters.join(news.select("news_id", "domain"), "news_id")
    return joined.groupBy("cluster_id").agg(
        F.count(F.lit(1)).alias("size"), F.count_distinct("domain").alias("outlets")
    )


def timeline(events: DataFrame, since, limit: int) -> DataFrame:
    """Newest first reports since a day with their type's count, and how many are hidden."""
    day = F.col("occurred_at") >= F.lit(since).cast("timestamp")
    kept = events.where(day & (F.col("novelty") == "first"))
    counts = kept.groupBy("event_type").agg(F.count(F.lit(1)).alias("type_count"))
    hidden = events.where(day).agg(F.count_if(F.col("novelty") != "first").alias("hidden"))
    page = kept.orderBy(F.desc("occurred_at"), F.desc("news_id")).limit(limit)
    return page.join(counts, "event_type").crossJoin(F.broadcast(hidden))  # one row


def news_page(mentions: DataFrame, limit: int) -> DataFrame:
    """Newest headlines that name their company, and how many uncertain ones are hidden."""
    sure = F.col("method") != "query_only"
    hidden = mentions.agg(F.count_if(~sure).alias("hidden"))
    page = mentions.where(sure).orderBy(F.desc("seen_us"), F.desc("news_id")).limit(limit)
    return page.crossJoin(F.broadcast(hidden))  # one row


def feed(events: DataFrame, watched: DataFrame, limit: int) -> DataFrame:
    """Newest events of watched companies with an excerpt."""
    kept = events.join(watched.select("company").distinct(), "company", "left_semi")
    return kept.orderBy(F.desc("occurred_at"), F.desc("news_id")).limit(limit).withColumn(
        "excerpt", F.substring("title", 1, 40)
    )


# --- Alerts -------------------------------------------------------------------------------


#: Parts that the members of a list are dealt into, where they meet its followers.
_PARTS = 64


class Watch(NamedTuple):
    """Which rules watch which companies, without a row per pair: a rule follows groups, a group has members (company), and no
    pair comes of two groups. followers: rule_id, _group, _list and what else is known of the rule; members: _group, _list, company."""

    followers: DataFrame
    members: DataFrame


def _group(kind: str, key: str) -> Column:
    return F.concat(F.lit(f"{kind}:"), F.coalesce(F.col(key).cast("string"), F.lit(""))).alias("_group")


def _of_pairs(pairs: DataFrame) -> Watch:
    """Pairs (rule_id, company) as they are: each company is a group."""
    group = [_group("one", "company"), F.lit(False).alias("_list")]
    return Watch(pairs.select("rule_id", *group), pairs.select(*group, "company").distinct())


def watch(rules: DataFrame, listings: DataFrame, watchlists: DataFrame) -> Watch:
    """Who watches what: a rule follows its watchlist as one group, and the other companies of its tickers one by one.

    Rules of several watchlists, and rows without a rule or a company, go one by one, too, so that each pair comes once."""
    stages = Stages(rules.sparkSession)
    lists = watchlists.select("watchlist_id", "company").distinct()
    follows = rules.where(F.col("watchlist_id").isNotNull()).select("rule_id", "watchlist_id").distinct()
    follows = follows.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy("rule_id")))
    single = (F.col("_n") == 1) & F.col("rule_id").isNotNull()
    one, many = follows.where(single).drop("_n"), follows.where(~single).drop("_n")
    listed = listings.where("is_active").select("ticker", "company").distinct()
    named = rules.select("rule_id", F.explode("tickers").alias("ticker")).distinct().join(listed, "ticker").select("rule_id", "company")
    unknown = one.join(lists.where("company is null"), "watchlist_id")
    rest = named.unionByName(many.join(lists, "watchlist_id").select("rule_id", "company")).unionByName(unknown.select("rule_id", "company")).distinct()
    rest = rest.join(one, "rule_id", "left").join(lists, ["watchlist_id", "company"], "left_anti").select("rule_id", "company")
    singly = _of_pairs(stages.keep(rest, "watched-singly"))
    of_list = [_group("list", "watchlist_id"), F.lit(True).alias("_list")]
    followed = lists.where("company is not null").join(one.select("watchlist_id").distinct(), "watchlist_id", "left_semi")
    followers = one.select("rule_id", *of_list).unionByName(singly.followers)
    members = followed.select(*of_list, "company").unionByName(singly.members)
    return Watch(stages.keep(followers, "followers"), stages.keep(members, "members"))


def _meet(followers: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """Followers and rows of their groups. The rows of a list are dealt into parts, so that no task holds a whole list."""
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    every = F.when(F.col("_list"), F.sequence(F.lit(0), F.lit(_PARTS - 1))).otherwise(F.array(F.lit(0)))
    mine = F.when(F.col("_list"), F.pmod(F.xxhash64(key), F.lit(_PARTS)).cast("int")).otherwise(0)
    left = followers.withColumn("_part", F.explode(every)).drop("_list").repartition(tasks, "_group", "_part")
    right = rows.withColumn("_part", mine).drop("_list").repartition(tasks, "_group", "_part")
    return left.join(right, ["_group", "_part"]).drop("_group", "_part")


def alert_scope(rules: DataFrame, listings: DataFrame, watchlists: DataFrame) -> DataFrame:
    """Companies of each rule: its tickers' companies and those on its watchlist."""
    found = watch(rules, listings, watchlists)
    return _meet(found.followers, found.members, "company").select("rule_id", "company")


def scoped_rules(rules: DataFrame, scope: DataFrame | Watch) -> Watch:
    """What rules watch, their followers with kind, min_value, min_move and since. `scope`: rule_id, company; or as watch() gives it."""
    found = scope if isinstance(scope, Watch) else _of_pairs(scope)
    return Watch(found.followers.join(rules.drop("tickers", "watchlist_id"), "rule_id"), found.members)


def _candidates(scoped: Watch, kind: str, prefix: str, rows: DataFrame, key: Column, when: Column | None, *more: str) -> DataFrame:
    """Rows (company, ...) of watched companies with each rule of the kind that holds them; subjects are named before rules meet them."""
    subject = F.concat(F.lit(f"{prefix}:"), key.cast("string"))
    rows = rows.withColumn("subject_key", subject).join(scoped.members, "company")
    met = _meet(scoped.followers.where(F.col("kind") == kind).drop("kind"), rows, "subject_key")
    met = met if when is None else met.where(when)
    return met.select("rule_id", "company", F.lit(kind).alias("kind"), "subject_key", *more)


def filing_candidates(scoped: Watch, filings: DataFrame, *more: str) -> DataFrame:
    """Filings of the watched forms, and earnings reports."""
    filed = filings.where(F.col("form").isin("10-K", "10-Q", "8-K", "10-K/A", "10-Q/A", "8-K/A"))
    reported = filings.where((F.col("form") == "8-K") & F.col("is_earnings"))
    due = F.col("filed_date") >= F.col("since")
    return _candidates(scoped, "filing", "filing", filed, F.col("accession"), due, *more).unionByName(
        _candidates(scoped, "earnings", "event", reported, F.col("accession"), due, *more)
    )


def news_candidates(scoped: Watch, events: DataFrame, *more: str) -> DataFrame:
    """First reports."""
    return _candidates(scoped, "news", "event", events.where(F.col("novelty") == "first"), F.col("news_id"), F.col("event_day") >= F.col("since"), *more)


def insider_candidates(scoped: Watch, trades: DataFrame, *more: str) -> DataFrame:
    """Insider purchases of a rule's least value or more."""
    due = (F.col("shares") * F.col("price") >= F.col("min_value")) & (F.col("tx_date") >= F.col("since"))
    return _candidates(scoped, "insider", "insider", trades.where(F.col("code") == "P"), F.col("tx_id"), due, *more)


def price_candidates(scoped: Watch, moves: DataFrame, *more: str) -> DataFrame:
    """Moves (company, last_day, move) of a rule's least size or more."""
    return _candidates(scoped, "price", "price", moves, F.concat_ws(":", "company", "last_day"), F.abs("move") >= F.col("min_move"), *more)


def last_moves(closes: DataFrame) -> DataFrame:
    """Each company's newest close against the one before. `closes`: company, trade_date, close."""
    newest = Window.partitionBy("company").orderBy(F.desc("trade_date"))
    two = closes.withColumn("_back", F.row_number().over(newest)).where("_back <= 2")
    return two.groupBy("company").agg(
        F.max("trade_date").alias("last_day"),
        F.max(F.when(F.col("_back") == 1, F.col("close"))).alias("_now"),
        F.max(F.when(F.col("_back") == 2, F.col("close"))).alias("_before"),
    ).where("_before > 0").select("company", "last_day", (F.col("_now") / F.col("_before") - 1).alias("move"))


def alert_candidates(
    rules: DataFrame, scope: DataFrame | Watch, filings: DataFrame, events: DataFrame, trades: DataFrame, closes: DataFrame
) -> DataFrame:
    """Matches of every rule: filings, earnings, news, insider trades and price moves."""
    scoped = scoped_rules(rules, scope)
    parts = (
        filing_candidates(scoped, filings), news_candidates(scoped, events), insider_candidates(scoped, trades),
        price_candidates(scoped, last_moves(closes)),
    )
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def alert_emit(candidates: DataFrame, stored: DataFrame) -> DataFrame:
    """Candidates not alerted before, once per (rule, subject)."""
    fresh = candidates.dropDuplicates(["rule_id", "subject_key"])
    return fresh.join(stored, ["rule_id", "subject_key"], "left_anti")


def alert_list(alerts: DataFrame, rules: DataFrame, limit: int) -> DataFrame:
    """Newest alerts with their rule's name, and the unread total."""
    unread = alerts.agg(F.count_if(~F.col("is_read")).alias("unread"))
    page = alerts.orderBy(F.desc("created_on"), F.desc("alert_id")).limit(limit)
    return page.join(rules.select("rule_id", "name"), "rule_id", "left").crossJoin(F.broadcast(unread))  # one row


def admin_counts(fetches: DataFrame) -> DataFrame:
    """Fetches by provider and status, and each provider's last success."""
    return fetches.groupBy("provider").agg(
        F.count_if("ok").alias("succeeded"), F.count_if(~F.col("ok")).alias("failed"),
        F.max(F.when(F.col("ok"), F.col("started_us"))).alias("last_success_us"),
    )
