"""Token ids as ORC: sorted by document id, run-length encoded, with row indexes and Bloom filters on the id."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.tokens import encoder, tokenizer_path

#: Ids of a batch handed to the writer, in bytes.
BATCH_BYTES = 8 << 20


def write_ids(docs: DataFrame, path: str, tokenizer_file: str | None = None, end_id: int = 1) -> None:
    """Write docs (doc_id, text) as ORC files of (part, doc_id, before, n_tokens, ids), ascending by doc_id.

    Rows are range-partitioned and sorted before they are encoded, so texts move once and ids never do; each file is one id
    range, read stripe by stripe. `before` counts the ids of earlier rows of the same file. Null and empty texts are the end
    id alone, null doc_ids come first, rows with equal doc_id are ordered by a hash of the text.
    """
    file = tokenizer_file or tokenizer_path("word_bpe_49k.json")
    end = int(end_id).to_bytes(4, "little")
    id_type = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.xxhash64("text").alias("_h"))
    ordered = rows.repartitionByRange("doc_id", "_h").sortWithinPartitions("doc_id", "_h").select("doc_id", "text")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = encoder(file).ids
        part, before = TaskContext.get().partitionId(), 0
        for batch in batches:
            texts, at = batch.column(1), 0
            while at < batch.num_rows:
                raw, held = [], 0
                while at + len(raw) < batch.num_rows and held < BATCH_BYTES:
                    raw.append(ids(texts[at + len(raw)].as_py()) + end)
                    held += len(raw[-1])
                lengths = np.array([len(r) // 4 for r in raw], dtype=np.int64)
                offsets = np.concatenate([[0], np.cumsum(lengths)])
                values = pa.array(np.frombuffer(b"".join(raw), dtype="<i4"))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(len(raw), part, np.int32)), batch.column(0).slice(at, len(raw)),
                        pa.array(before + offsets[:-1]), pa.array(lengths),
                        pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), values),
                    ],
                    names=["part", "doc_id", "before", "n_tokens", "ids"],
                )
                before += int(offsets[-1])
                at += len(raw)

    encoded = ordered.mapInArrow(encode, f"part int, doc_id {id_type}, before long, n_tokens long, ids array<int>")
    writer = encoded.write.option("compression", "zstd").option("orc.bloom.filter.columns", "doc_id")
    writer.option("orc.bloom.filter.fpp", "0.01").option("orc.create.index", "true").option("orc.row.index.stride", "1000").option(
        "orc.stripe.size", str(16 << 20)
    ).orc(path)


def read_ids(spark: SparkSession, path: str, doc_ids: list | None = None) -> DataFrame:
    """The files' rows; with doc_ids only those documents, found by file and stripe statistics and Bloom filters."""
    rows = spark.read.orc(path)
    return rows if doc_ids is None else rows.where(F.col("doc_id").isin(doc_ids))


def spans_of(spark: SparkSession, path: str) -> DataFrame:
    """The files → per document: doc_id, start (ids of all documents before it), n_tokens, ids_crc32."""
    rows = read_ids(spark, path)
    sums = rows.groupBy("part").agg(F.sum("n_tokens").alias("n"))  # one row per file
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = sums.select(F.col("part").alias("_part"), F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("_base"))
    # one row per file, so the table is as small as the number of shuffle partitions
    placed = rows.join(F.broadcast(base), F.col("part") == F.col("_part")).select(
        "doc_id", (F.col("_base") + F.col("before")).alias("start"), "n_tokens", "ids"
    )
    id_type = rows.schema["doc_id"].dataType.simpleString()

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(3)
            values, offsets = lists.values.to_numpy(zero_copy_only=False), lists.offsets.to_numpy()
            crc = [zlib.crc32(values[a:b].tobytes()) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:3], pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"]
            )

    return placed.mapInArrow(digest, f"doc_id {id_type}, start long, n_tokens long, ids_crc32 long")
