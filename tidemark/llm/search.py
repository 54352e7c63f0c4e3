"""Ranked lexical search by dense blocked matrix multiplication.

Items come in tiles, each with a compact vocabulary of its own. One pass over the documents counts the vocabulary's terms;
document tiles then become dense matrices of term impacts, and item weights times impacts are the scores of all items for
the tile. Weights and impacts are whole numbers in float64, and the vocabulary is cut into blocks whose sums stay below 2**53,
so BLAS adds without rounding in any order; blocks are added in 64-bit integers. Of each tile the TOP highest are kept with
everything that ties with the last of them, then cut by document id.

Per item tile the driver holds its vocabulary with one count per term and its weights; nothing of the documents.
"""

from __future__ import annotations

import math
from array import array
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import stored

TOP = 20
#: Bytes of item text that make a tile, about; bounds what the driver and each task know of the items.
ITEM_TILE = 1 << 20
#: Numbers in a dense document tile (64 MB).
CELLS = 1 << 23
#: An impact is at most this (10**9 * tf div (1000 * tf + ...)), and sums stay below EXACT.
MOST_IMPACT = 10**6
EXACT = 1 << 53

#: Groups of tasks whose candidates are ranked among themselves before all are.
PARTS = 64

#: Bytes as terms have them: A-Z lowered, ASCII other than letters and digits to blanks, all of UTF-8's other bytes kept.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))


def terms_of(text: str | None) -> list[bytes]:
    """The terms of a text as UTF-8; null has none."""
    return text.encode("utf-8", "surrogatepass").translate(_FOLD).split() if text else []


def _counts(vocabulary: dict[bytes, int]):
    """Batches (doc_id, text) → doc_id, n, terms (numbers of vocabulary terms, ascending), tfs; documents without terms go."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, sizes, ends, terms, tfs = [], array("q"), array("i", [0]), array("i"), array("q")
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                words = terms_of(text.as_py())
                if not words:
                    continue
                found = sorted((vocabulary[w], c) for w, c in Counter(words).items() if w in vocabulary)
                ids.append(doc_id)
                sizes.append(len(words))
                terms.extend(t for t, _ in found)
                tfs.extend(c for _, c in found)
                ends.append(len(terms))
            lists = [pa.ListArray.from_arrays(pa.array(np.array(ends)), pa.array(np.array(x))) for x in (terms, tfs)]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(np.array(sizes)), *lists], ["doc_id", "n", "terms", "tfs"])

    return run


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def blocks(items: list[Counter[int]], weights: list[int]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Items (term → repeats) and weights → (terms, items x terms matrix of weight * repeats) per block.

    In a block no item's numbers times MOST_IMPACT add up to EXACT or more. A term repeated so often that its number alone
    would is in several blocks, with a part of its repeats in each.
    """
    room = (EXACT - 1) // MOST_IMPACT
    needed: dict[int, list[tuple[int, int]]] = {}
    for row, counts in enumerate(items):
        for term, repeats in counts.items():
            if weights[term] > 0:
                needed.setdefault(term, []).append((row, repeats))
    out: list[dict[int, list[tuple[int, int]]]] = [{}]
    used = [[0] * len(items)]

    def put(term: int, entries: list[tuple[int, int]]) -> list[tuple[int, int]]:
        """Put what fits into the last block; gives back what doesn't."""
        rest = []
        for row, repeats in entries:
            fits = min(repeats, (room - used[-1][row]) // weights[term])
            if fits:
                out[-1].setdefault(term, []).append((row, fits))
                used[-1][row] += fits * weights[term]
            if fits < repeats:
                rest.append((row, repeats - fits))
        return rest

    for term in sorted(needed):
        left = put(term, needed[term])
        while left:
            out.append({})
            used.append([0] * len(items))
            left = put(term, left)
    made = []
    for block in out:
        if block:
            terms = np.array(list(block), np.int64)
            matrix = np.zeros((len(items), len(terms)))
            for column, entries in enumerate(block.values()):
                for row, repeats in entries:
                    matrix[row, column] = repeats * weights[terms[column]]
            made.append((terms, matrix))
    return made


def best(scores: np.ndarray, ids: np.ndarray, null: np.ndarray, top: int) -> np.ndarray:
    """Places of the top highest scores above 0, equal ones by ascending id (null last), in that order."""
    if len(scores) > top:
        least = np.partition(scores, len(scores) - top)[-top]
        at = np.flatnonzero(scores >= max(least, 1))  # with all that tie with the last
    else:
        at = np.flatnonzero(scores > 0)
    return at[np.lexsort((ids[at], null[at], -scores[at]))][:top]


def _scored(names: list[int], made: list[tuple[np.ndarray, np.ndarray]], n_terms: int, n_docs: int, total: int, top: int):
    """Batches of counted documents → item (place in names), item_id, doc_id, score: the best of the batches a task sees."""
    slots = []
    for terms, matrix in made:
        slot = np.full(n_terms, -1, np.int64)
        slot[terms] = np.arange(len(terms))
        slots.append((slot, matrix))
    widest = max((len(terms) for terms, _ in made), default=1)
    height = max(64, CELLS // max(widest, len(names)))

    def tile(batch: pa.RecordBatch) -> np.ndarray:
        """Scores, items x documents."""
        n = batch.column("n").to_numpy()
        m = 75 + (25 * n * n_docs) // total
        spans = batch.column("terms")
        rows = np.repeat(np.arange(len(n)), np.diff(spans.offsets.to_numpy()))
        terms, tfs = spans.flatten().to_numpy(), batch.column("tfs").flatten().to_numpy()
        impacts = (1_000_000_000 * tfs) // (1000 * tfs + 12 * m[rows])
        out = np.zeros((len(names), len(n)), np.int64)
        for slot, matrix in slots:
            column = slot[terms]
            here = column >= 0
            dense = np.zeros((matrix.shape[1], len(n)))
            dense[column[here], rows[here]] = impacts[here]
            out += (matrix @ dense).astype(np.int64)
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [(np.zeros(0, np.int64),) * 2 + (np.zeros(0, bool),)] * len(names)
        for batch in batches:
            for start in range(0, batch.num_rows, height):
                part = pa.RecordBatch.from_struct_array(pa.concat_arrays([batch.slice(start, height).to_struct_array()]))
                column = part.column("doc_id")
                ids, null = column.fill_null(0).to_numpy(), column.is_null().to_numpy(zero_copy_only=False)
                scores = tile(part)
                for row in range(len(names)):
                    at = best(scores[row], ids, null, top)
                    merged = [np.concatenate(x) for x in zip(held[row], (scores[row][at], ids[at], null[at]), strict=True)]
                    at = best(*merged, top)
                    held[row] = tuple(x[at] for x in merged)
        sizes = [len(h[0]) for h in held]
        if sum(sizes):
            scores, ids, null = (np.concatenate(x) for x in zip(*held, strict=True))
            item_ids = pa.array([name for name, k in zip(names, sizes, strict=True) for _ in range(k)], pa.int64())
            columns = [pa.array(np.repeat(np.arange(len(names)), sizes)), item_ids, pa.array(ids, pa.int64(), mask=null), pa.array(scores)]
            yield pa.RecordBatch.from_arrays(columns, ["item", "item_id", "doc_id", "score"])

    return run


def _ranked(found: DataFrame, top: int) -> DataFrame:
    """Candidates of all tasks → the top of each item with rank; first in parts of the tasks, then together."""
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
    for keys in (["item", "part"], ["item"]):
        found = found.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= top)
    return found.select("item_id", "rank", "doc_id", "score")


def search(docs: DataFrame, items: DataFrame, top: int = TOP, item_tile: int = ITEM_TILE) -> DataFrame:
    """docs (doc_id, text), items (item_id, text) → item_id, rank (int from 1), doc_id, score (long): each item's top documents.

    Every document is scored for every item; only scores above 0 are listed, equal ones by ascending doc_id (null last, rows
    that repeat an id in any order, each with a rank of its own). Null and empty texts have no terms: such documents are in no
    count, such items list nothing. Rows that repeat an item count once; equal item_ids with different texts are items of
    their own. Empty tables give no rows. Other columns are not read, whatever they are called.
    """
    items = items.select("item_id", "text").where("text is not null").distinct()
    docs = docs.select("doc_id", "text")
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    tiles = max(1, -(-size // item_tile))
    tile_of = F.pmod(F.xxhash64("item_id", "text"), F.lit(tiles))
    spark, parts = docs.sparkSession, []
    for k in range(tiles):
        texts = items.where(tile_of == k).collect()  # about item_tile bytes
        parts.append(_tile(docs, [(r["item_id"], Counter(terms_of(r["text"]))) for r in texts], top))
    empty = spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    parts = [part for part in parts if part is not None]
    return _union(parts) if parts else empty


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def _tile(docs: DataFrame, items: list[tuple[int, Counter[bytes]]], top: int) -> DataFrame | None:
    vocabulary = {term: k for k, term in enumerate(sorted(set().union(*[counts for _, counts in items])))}
    if not vocabulary:
        return None
    counted = stored(docs.mapInArrow(_counts(vocabulary), "doc_id long, n long, terms array<int>, tfs array<long>"), "term-counts")
    n_docs, total = counted.agg(F.count("*"), F.sum("n")).first()
    if not n_docs:
        return None
    df = dict(counted.select(F.explode("terms").alias("term")).groupBy("term").count().collect())  # a row per vocabulary term
    weights = [weight(n_docs, df[t]) if t in df else 0 for t in range(len(vocabulary))]
    made = blocks([Counter({vocabulary[t]: c for t, c in counts.items()}) for _, counts in items], weights)
    run = _scored([item for item, _ in items], made, len(vocabulary), n_docs, total, top)
    found = counted.mapInArrow(run, "item long, item_id long, doc_id long, score long")
    return _ranked(found.withColumn("part", F.spark_partition_id() % PARTS), top)
