"""Toxic passages by maximum-scoring segments.

Tokens, as whole words and as prefixes, get log-odds between toxic and other training documents under an informative Dirichlet
prior, towards either side; words without significant odds cost a little. A linear-time scan finds all maximal scoring segments of a text; the score of the
best ones, calibrated by extreme-value statistics (the chance that a clean text of this length holds one as high), gives the
document's probability by a logistic fit.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import stored

_WORD = re.compile(r"[^\W\d_]+")
PREFIXES = (4, 5, 6)


@dataclass(frozen=True)
class Settings:
    #: Labelled training documents per class, the first by a hash of their id: bounds the fit, not the scoring.
    sample: int = 12_000
    #: Prior strength in counts; terms need this z score and this many documents of the side they speak for. The lexicon holds
    #: all such terms: the labelled sample alone bounds it.
    prior: float = 5000.0
    least_z: float = 4.0
    least_docs: int = 3
    #: Cost of a word without significant odds, and the highest log-odds a word may have, towards either side.
    drift: float = 1.5
    highest: float = 6.0
    #: A passage is significant if a clean text of the length holds such a one with a lower chance.
    significance: float = 0.01


@dataclass(frozen=True)
class Model:
    """A fitted model: term scores, Karlin-Altschul decay and size factor, logistic weights, settings."""

    terms: dict[str, float]
    decay: float
    size: float
    weights: tuple[float, ...]
    settings: Settings


def words_of(text: str | None) -> list[str]:
    return _WORD.findall(text.lower()) if text else []


def terms_of(words: list[str]) -> Counter:
    """Terms of a text with their tokens: every word (as `=word`) and its prefixes."""
    out: Counter = Counter()
    for w, n in Counter(words).items():
        out["=" + w] += n
        for k in PREFIXES:
            if len(w) > k:
                out[w[:k]] += n
    return out


class WordScores(dict):
    """Word → score with back-off: the word itself, else its longest significant prefix, else the drift."""

    def __init__(self, terms: dict[str, float], settings: Settings):
        super().__init__()
        self._terms, self._other = terms, -settings.drift

    def __missing__(self, word: str) -> float:
        terms = self._terms
        score = terms.get("=" + word)
        if score is None:
            score = next((terms[word[:n]] for n in reversed(PREFIXES) if len(word) > n and word[:n] in terms), self._other)
        if len(self) > 400_000:
            self.clear()
        self[word] = score
        return score


def maximal_segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (first, end, score) of a sequence, in order, in linear time.

    Every positive score starts a candidate; a candidate swallows earlier ones down to the last with a lower sum before it if
    that makes a higher total. Only positive places are visited; sums come from one cumulative pass.
    """
    total = np.concatenate([[0.0], np.cumsum(scores)])
    found: list[list] = []  # first, end, sum before, sum at end, place of the last candidate with a lower sum before
    for at in np.flatnonzero(scores > 0).tolist():
        first, end, low, high = at, at + 1, total[at], total[at + 1]
        while True:
            j = len(found) - 1
            while j >= 0 and found[j][2] >= low:
                j = found[j][4]
            if j < 0 or found[j][3] >= high:
                found.append([first, end, low, high, j])
                break
            first, low = found[j][0], found[j][2]
            del found[j:]
    return [(f, e, float(h - b)) for f, e, b, h, _ in found]


def decay_of(values: np.ndarray, chances: np.ndarray) -> float:
    """The positive root of sum(chance * exp(decay * value)) = 1, for scores of negative mean."""
    low, high = 1e-6, 50.0
    for _ in range(200):
        middle = (low + high) / 2
        if float(np.sum(chances * np.exp(np.minimum(middle * values, 700)))) > 1:
            high = middle
        else:
            low = middle
    return low


def features(n_words: int, segments: list[tuple[int, int, float]], decay: float, size: float) -> tuple[list[float], list[float]]:
    """Extreme-value calibrated features of a text, and the log chances of its segments.

    A segment of score s in n words has expectation size * n * exp(-decay * s) in clean text.
    """
    base = math.log(size) + math.log(max(n_words, 1))
    logs = [min(base - decay * s, 0.0) for _, _, s in segments]
    chances = [math.log(-math.expm1(-math.exp(x))) if x > -30 else x for x in logs]
    best = min(logs, default=0.0)
    return [1.0, math.sqrt(-best), math.log1p(sum(-x for x in logs)), -math.log1p(max(n_words, 1)) / 10], chances


def _fit_logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Penalised logistic weights by Newton steps, on the bounded training sample."""
    w = np.zeros(x.shape[1])
    ridge = np.eye(x.shape[1]) * 0.1
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (weight * (y - p)) - ridge @ w
        bend = (x * (weight * p * (1 - p))[:, None]).T @ x + ridge
        w = w + np.linalg.solve(bend, slope)
    return w


def training_rows(docs: DataFrame, labels: DataFrame, settings: Settings) -> tuple[DataFrame, dict[int, int]]:
    """The bounded training sample as (doc_id, text, toxic), and how many labelled documents each class has.

    Only rows with a label whose crc32(doc_id as text) mod 5 is not 0 are used; a doc_id with several labels is toxic if one
    says so.
    """
    known = labels.where("doc_id is not null and toxic is not null")
    known = known.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0)
    known = known.groupBy("doc_id").agg((F.max("toxic") > 0).cast("int").alias("toxic"))
    known = stored(known, "labels")
    sizes = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    parts = [known.where(F.col("toxic") == c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(settings.sample) for c in (0, 1)]
    sample = stored(parts[0].union(parts[1]), "sample")
    # at most two samples of rows: bounded, so it may be broadcast
    texts = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").dropDuplicates(["doc_id"])
    return stored(texts, "training"), sizes


def lexicon(training: DataFrame, settings: Settings) -> dict[str, float]:
    """Terms with significant log-odds towards either class, from the tokens of the training documents of each."""
    sides = ("clean", "toxic", "clean_docs", "toxic_docs")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[int]] = {}

        def made():
            arrays = [pa.array(list(held), pa.string()), *(pa.array([h[k] for h in held.values()], pa.int64()) for k in range(4))]
            held.clear()
            return pa.RecordBatch.from_arrays(arrays, names=["term", *sides])

        for batch in batches:
            for text, toxic in zip(batch.column(0), batch.column(1), strict=True):
                side = toxic.as_py()
                for term, n in terms_of(words_of(text.as_py())).items():
                    counts = held.setdefault(term, [0, 0, 0, 0])
                    counts[side] += n
                    counts[side + 2] += 1
                if len(held) > 200_000:
                    yield made()
        yield made()

    counts = training.select("text", "toxic").mapInArrow(count, "term string, " + ", ".join(f"{k} long" for k in sides))
    totals = [F.sum(k).alias(name) for k, name in zip(sides, ("c", "t", "c_docs", "t_docs"), strict=True)]
    counts = stored(counts.groupBy("term").agg(*totals), "terms")
    sums = counts.agg(F.sum("c").alias("c"), F.sum("t").alias("t")).first()
    n_clean, n_toxic = float(sums["c"] or 0), float(sums["t"] or 0)
    if n_clean == 0 or n_toxic == 0:
        return {}
    alpha = F.lit(settings.prior) * (F.col("c") + F.col("t")) / (n_clean + n_toxic)
    odds = lambda x, n: F.log((F.col(x) + alpha) / (n + settings.prior - F.col(x) - alpha))
    z = (odds("t", n_toxic) - odds("c", n_clean)) / F.sqrt(1 / (F.col("t") + alpha) + 1 / (F.col("c") + alpha))
    scored = counts.select("term", "c_docs", "t_docs", (odds("t", n_toxic) - odds("c", n_clean)).alias("odds"), z.alias("z"))
    toxic = (F.col("z") >= settings.least_z) & (F.col("t_docs") >= settings.least_docs)
    clean = (F.col("z") <= -settings.least_z) & (F.col("c_docs") >= settings.least_docs)
    # no more terms than the bounded sample has
    found = scored.where(toxic | clean).select("term", "odds").toPandas()
    odds_of = found["odds"].clip(-settings.highest, settings.highest)
    return dict(zip(found["term"], map(float, odds_of), strict=True))


def fit(docs: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> Model:
    """Learn from the labelled rows that are not held out. Without both classes the model scores all texts alike."""
    training, sizes = training_rows(docs, labels, settings)
    terms = lexicon(training, settings)
    if not terms:
        rate = sizes.get(1, 0) / max(sum(sizes.values()), 1)
        odds = math.log((rate + 1e-3) / (1 - rate + 1e-3))
        return Model({}, 1.0, 1.0, (odds, 0.0, 0.0, 0.0), settings)

    edges = np.linspace(-settings.highest, settings.highest, 241)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scores = WordScores(terms, settings)
        for batch in batches:
            n, seen_scores, best, per = [], [], [], []
            for text in batch.column(0):
                values = np.array([scores[w] for w in words_of(text.as_py())])
                segments = maximal_segments(values) if len(values) else []
                n.append(len(values))
                seen_scores.append(np.histogram(values, edges)[0].tolist())
                best.append(max((s for _, _, s in segments), default=0.0))
                per.append([s for _, _, s in segments])
            kinds = (pa.int64(), pa.list_(pa.int64()), pa.float64(), pa.list_(pa.float64()))
            arrays = [pa.array(x, k) for x, k in zip((n, seen_scores, best, per), kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(1), *arrays], names=["toxic", "n", "scores", "best", "per"])

    schema = "toxic int, n long, scores array<long>, best double, per array<double>"
    seen = training.select("text", "toxic").mapInArrow(scan, schema).toPandas()  # the bounded sample
    clean = seen[seen["toxic"] == 0]
    # how often clean words have which score, with half a word of the highest and one of the drift added
    values = np.append((edges[1:] + edges[:-1]) / 2, [settings.highest, -settings.drift])
    counts = np.sum(np.stack(clean["scores"].to_list()), axis=0) if len(clean) else np.zeros(len(edges) - 1)
    chances = np.append(counts, [0.5, 1.0])
    up, down = values > 0, values < 0
    gain, loss = float(chances[up] @ values[up]), float(-(chances[down] @ values[down]))
    chances[up] *= min(1.0, 0.99 * loss / gain)  # the mean has to be negative
    decay = decay_of(values, chances / chances.sum())
    tail = np.mean(decay * clean["best"] - np.log(np.maximum(clean["n"], 1)))
    size = float(np.clip(np.exp(tail - 0.5772), 1e-6, 1.0))
    x = np.array([features(n, [(0, 0, s) for s in per], decay, size)[0] for n, per in zip(seen["n"], seen["per"], strict=True)])
    y = seen["toxic"].to_numpy(float)
    total = sum(sizes.values())
    share = [sizes.get(c, 0) / total / max((y == c).mean(), 1e-9) for c in (0, 1)]
    weights = _fit_logistic(x, y, np.where(y == 1, share[1], share[0]))
    return Model(terms, decay, size, tuple(map(float, weights)), settings)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """docs (doc_id, text) → doc_id, score (0 to 1), passages: array of (start, end) of significant ones in characters.

    The whole text counts, and nothing but the text. Null and empty texts have no passages and the score of a text without
    toxic words; repeated rows are scored each.
    """
    id_type = docs.schema["doc_id"].dataType.simpleString()
    settings = model.settings
    least = math.log(settings.significance)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        word_scores = WordScores(model.terms, settings)
        for batch in batches:
            out, passages = [], []
            for item in batch.column(1):
                text = item.as_py() or ""
                lower = text.lower()
                values = np.array([word_scores[w] for w in _WORD.findall(lower)])
                segments = maximal_segments(values) if len(values) else []
                x, chances = features(len(values), segments, model.decay, model.size)
                z = sum(a * b for a, b in zip(x, model.weights, strict=True))
                out.append(1 / (1 + math.exp(-max(min(z, 500.0), -500.0))))
                own = [(a, b) for (a, b, _), c in zip(segments, chances, strict=True) if c <= least]
                if own:
                    # lower case may change lengths, so places are looked up in the text itself where it does
                    at = [m.span() for m in _WORD.finditer(lower if len(lower) == len(text) else text)]
                    own = [(at[a][0], at[min(b, len(at)) - 1][1]) for a, b in own if a < len(at)]
                passages.append([{"start": a, "end": b} for a, b in own])
            kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            arrays = [batch.column(0), pa.array(out, pa.float64()), pa.array(passages, kind)]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "score", "passages"])

    schema = f"doc_id {id_type}, score double, passages array<struct<start: bigint, end: bigint>>"
    return docs.select("doc_id", "text").mapInArrow(run, schema)
