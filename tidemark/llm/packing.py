"""Best-fit-decreasing packing of token pieces, planned on the histogram of piece lengths.

Lengths are whole numbers up to the capacity, so the best-fit-decreasing plan depends only on how many pieces have each
length. The histogram (at most `capacity` rows whatever the corpus) is packed with a segment tree over remaining
capacities; the plan is a list of runs, and every piece finds its place from its rank among the pieces of its length.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import stored
from tidemark.llm.tokens import encoder, tokenizer_path

CAPACITY = 2048
#: Ranks within a length are counted in this many parts, so a very common length is never one task.
PARTS = 32


class OpenBins:
    """Open bins by remaining capacity: a segment tree finds the tightest capacity that still holds a length."""

    def __init__(self, capacity: int):
        self._leaves = 1 << capacity.bit_length()
        self._any = [False] * (2 * self._leaves)
        self._bins: dict[int, list[tuple[int, int]]] = {}

    def tightest(self, length: int) -> int | None:
        """The least remaining capacity of at least length with an open bin."""
        node = self._leaves + length
        if self._any[node]:
            return length
        while node > 1:
            if node % 2 == 0 and self._any[node + 1]:
                node += 1
                while node < self._leaves:
                    node = 2 * node if self._any[2 * node] else 2 * node + 1
                return node - self._leaves
            node //= 2
        return None

    def put(self, remaining: int, first: int, count: int) -> None:
        """Bins first … first + count - 1 now have this much room."""
        if count > 0 and remaining > 0:
            self._bins.setdefault(remaining, []).append((first, count))
            self._mark(remaining, True)

    def take(self, remaining: int) -> tuple[int, int]:
        groups = self._bins[remaining]
        group = groups.pop()
        if not groups:
            self._mark(remaining, False)
        return group

    def _mark(self, remaining: int, value: bool) -> None:
        node = self._leaves + remaining
        self._any[node] = value
        while node > 1:
            node //= 2
            self._any[node] = self._any[2 * node] or self._any[2 * node + 1]


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> dict[int, list[tuple[int, int, int, int]]]:
    """Pieces per length → per length the runs (first rank, first sequence, pieces per sequence, first offset).

    Best fit decreasing: lengths from the longest, each piece into the tightest open sequence that holds it, else a new one.
    Equal pieces fill the tightest sequence until it holds no more, so whole groups of alike sequences are served at once.
    """
    bins, runs, new = OpenBins(capacity), {}, 0
    for length in sorted(histogram, reverse=True):
        left, rank, own = histogram[length], 0, []
        while left:
            room = bins.tightest(length)
            if room is None:
                room, first, count = capacity, new, -(-left // (capacity // length))
                new += count
            else:
                first, count = bins.take(room)
            each = room // length
            full = min(count, left // each)
            offset = capacity - room
            if full:
                own.append((rank, first, each, offset))
                bins.put(room - each * length, first, full)
                rank, left = rank + full * each, left - full * each
            used = full
            if left and used < count:
                own.append((rank, first + used, each, offset))
                bins.put(room - left * length, first + used, 1)
                rank, left, used = rank + left, 0, used + 1
            bins.put(room, first + used, count - used)
        runs[length] = own
    return runs


def pieces(docs: DataFrame, tokenizer_file: str | None = None, end_id: int = 0, capacity: int = CAPACITY) -> DataFrame:
    """docs (doc_id, text) → per piece: doc_id, piece, start, length, ids_crc32, ids (little-endian unsigned 32-bit).

    A text's ids plus end_id, cut every `capacity` ids. Null and empty texts are the end id alone; repeated rows are
    documents of their own.
    """
    file = tokenizer_file or tokenizer_path("word_bpe_49k.json")
    end = int(end_id).to_bytes(4, "little")
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(file).ids
        step = 4 * capacity
        for batch in batches:
            if not batch.num_rows:
                continue
            owner, piece, start, length, crc, ids, held = [], [], [], [], [], [], 0
            texts = batch.column(1)

            def made(batch=batch):
                return pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(pa.array(owner, pa.int64())),
                        pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()),
                        pa.array(crc, pa.int64()), pa.array(ids, pa.binary()),
                    ],
                    names=["doc_id", "piece", "start", "length", "ids_crc32", "ids"],
                )

            for row in range(batch.num_rows):
                raw = encode(texts[row].as_py()) + end
                for k, at in enumerate(range(0, len(raw), step)):
                    part = raw[at : at + step]
                    owner.append(row)
                    piece.append(k)
                    start.append(at // 4)
                    length.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
                    ids.append(part)
                held += len(raw)
                if held > 8 << 20:
                    yield made()
                    owner, piece, start, length, crc, ids, held = [], [], [], [], [], [], 0
            if owner:
                yield made()

    schema = f"doc_id {id_type}, piece int, start long, length long, ids_crc32 long, ids binary"
    return docs.select("doc_id", "text").mapInArrow(cut, schema)


def pack(rows: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Rows with `length` (1 … capacity) → the same rows with sequence_id and offset (long).

    rows is read three times, so it should be a stored table. Ranks within a length are counted in PARTS parts by a hash of
    the row; the histogram of lengths is all that reaches the driver. Which of two equal pieces gets which place does not
    matter and is fixed by the row order within a part. Columns of rows that bear a result's name, or that of a column made on
    the way, are replaced.
    """
    rows = rows.drop("sequence_id", "offset", "_part", "_n", "_length", "_p", "_base", "_row", "_rank")
    columns = rows.columns
    order = [F.col(c) for c in columns if c not in ("length", "_part")]
    parted = rows.withColumn("_part", F.pmod(F.xxhash64(*order), F.lit(PARTS)).cast("int"))
    counts = parted.groupBy("length", "_part").agg(F.count("*").alias("_n"))
    counts = stored(counts, "lengths")
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("_n").alias("n")).collect()}
    runs = {
        length: tuple(np.array(x, dtype=np.int64) for x in zip(*own, strict=True))
        for length, own in plan(histogram, capacity).items()
    }
    before = Window.partitionBy("length").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select(
        F.col("length").alias("_length"), F.col("_part").alias("_p"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base")
    )
    within = F.row_number().over(Window.partitionBy("length", "_part").orderBy(*order)) - 1
    ranked = parted.withColumn("_row", within)
    ranked = ranked.join(base, (F.col("length") == F.col("_length")) & (F.col("_part") == F.col("_p")))
    ranked = ranked.select(*columns, (F.col("_base") + F.col("_row")).cast("long").alias("_rank"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            length = batch.column(batch.schema.get_field_index("length")).to_numpy(zero_copy_only=False)
            rank = batch.column(batch.num_columns - 1).to_numpy(zero_copy_only=False)
            sequence, offset = np.empty(len(rank), np.int64), np.empty(len(rank), np.int64)
            for value in np.unique(length):
                own = length == value
                first_rank, first, each, at = runs[int(value)]
                run = np.searchsorted(first_rank, rank[own], side="right") - 1
                nth = rank[own] - first_rank[run]
                sequence[own] = first[run] + nth // each[run]
                offset[own] = at[run] + nth % each[run] * value
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(sequence), pa.array(offset)], names=[*columns, "sequence_id", "offset"]
            )

    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    return ranked.mapInArrow(place, f"{kept}, sequence_id long, offset long")
