"""Near-duplicate documents by SetSketch registers.

A document is its set of word shingles. Its sketch holds, per register, the least of exponential hash values of the shingles,
kept as the whole part of a logarithm (exponentially spaced, truncated): registers merge by maximum and agree the more
often the more alike two sets are. Bands of registers propose pairs, the joint likelihood of two sketches discards unlike
ones, and the rest are confirmed on the full shingle sets.

Copies are never expanded into pairs. Documents with equal sets are one set; in each band bucket every set is compared with
the bucket's least set only (its pivot). Where that leaves different groups round a pivot, two of its sets can be linked only
if they share a shingle that the pivot lacks or are both close to it; only such pairs are compared. So no proposed link between
different texts is lost, and a bucket in one group costs one comparison per set.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import stored
from tidemark.llm.components import components

_MIX = np.uint64(0x9E3779B97F4A7C15)
_WORDS: dict[bytes, int] = {}
_WORDS_SIZE = 1_000_000


@dataclass(frozen=True)
class SetSketch:
    """bands * rows registers with logarithm base `base` and values 0 … limit; shingles of `words` words.

    At similarity 0.8 a pair shares no band with probability (1 - 0.8 ** rows) ** bands: 3e-6 for 24 bands of 4.
    """

    words: int = 5
    percent: int = 80
    bands: int = 24
    rows: int = 4
    base: float = 1.02
    rate: float = 20.0
    limit: int = 4000
    #: Pairs whose most likely similarity is lower are discarded: seven standard errors below 0.8 for 96 registers.
    least_likely: float = 0.5

    @property
    def registers(self) -> int:
        return self.bands * self.rows


def split_words(text: str | None) -> list[bytes]:
    """ASCII letters in lower case, cut at the six ASCII white-space characters."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def shingle_hashes(words: list[bytes], n: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the n-word shingles; fewer words are one shingle, none give none."""
    if not words:
        return np.empty(0, np.uint64)
    known = _WORDS
    if len(known) > _WORDS_SIZE:
        known.clear()
    for w in set(words).difference(known):
        known[w] = xxhash.xxh64_intdigest(w)
    h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    n = min(n, len(h))
    out = np.zeros(len(h) - n + 1, np.uint64)
    for k in range(n):
        out = (out ^ (out >> np.uint64(31))) * _MIX + h[k : k + len(out)]
    out ^= out >> np.uint64(33)
    out *= np.uint64(0xFF51AFD7ED558CCD)
    out ^= out >> np.uint64(33)
    return np.unique(out)


def sketch(hashes: np.ndarray, how: SetSketch) -> np.ndarray:
    """Registers of a set of hashes: 1 - log_base of the least exponential value, cut to 0 … limit."""
    rng = np.random.default_rng(20_240_601)
    factors = rng.integers(1, 2**63, how.registers, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    shifts = rng.integers(0, 2**63, how.registers, dtype=np.uint64)
    least = np.empty(how.registers, np.uint64)
    buffer = np.empty(len(hashes), np.uint64)
    for k in range(how.registers):
        np.multiply(hashes, factors[k], out=buffer)
        np.add(buffer, shifts[k], out=buffer)
        least[k] = buffer.min()
    uniform = (least.astype(np.float64) + 0.5) / 2.0**64
    value = -np.log1p(-np.minimum(uniform, 1 - 2**-53)) / how.rate
    return np.clip(np.floor(1 - np.log(value) / np.log(how.base)), 0, how.limit).astype(np.uint16)


def likely(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray, how: SetSketch) -> np.ndarray:
    """Most likely similarity per pair of sketches (rows of a and b) of sets with na and nb members.

    With shares u and v of the two sizes, a register of the first is larger with probability p(u - vJ), smaller with p(v - uJ),
    where p(x) = -log_base(1 - x (base - 1) / base); the likelihood of the three counts is maximised over a grid of J.
    """
    more, less = (a > b).sum(1)[:, None], (a < b).sum(1)[:, None]
    same = a.shape[1] - more - less
    u = (na / (na + nb))[:, None]
    v = 1 - u
    j = np.linspace(0, 1, 101)[None, :]
    inside = j <= np.minimum(u / v, v / u) + 1e-12
    p = lambda x: -np.log1p(-np.clip(x, 0, 1) * (how.base - 1) / how.base) / np.log(how.base)
    up, down = p(u - v * j), p(v - u * j)
    tiny = 1e-12
    score = more * np.log(up + tiny) + less * np.log(down + tiny) + same * np.log(np.maximum(1 - up - down, tiny))
    return j[0, np.where(inside, score, -np.inf).argmax(1)]


def _key(hashes: np.ndarray) -> tuple[int, int]:
    return struct.unpack("<qq", xxhash.xxh3_128_digest(hashes.tobytes()))


def sketches(docs: DataFrame, how: SetSketch) -> DataFrame:
    """docs (doc_id, text) → doc_id, n_shingles, k1, k2 (of the set), registers (null for an empty set)."""
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, k1, k2, registers = [], [], [], []
            for text in batch.column(1):
                hashes = shingle_hashes(split_words(text.as_py()), how.words)
                a, b = _key(hashes)
                n.append(len(hashes))
                k1.append(a)
                k2.append(b)
                registers.append(sketch(hashes, how).tobytes() if len(hashes) else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(k1, pa.int64()), pa.array(k2, pa.int64()), pa.array(registers, pa.binary())],
                names=["doc_id", "n_shingles", "k1", "k2", "registers"],
            )

    schema = f"doc_id {id_type}, n_shingles long, k1 long, k2 long, registers binary"
    return docs.select("doc_id", "text").mapInArrow(run, schema)


def _stars(sets: DataFrame, how: SetSketch) -> DataFrame:
    """sets (id, n, registers) → (a, b, na, nb, many): each set b of a band bucket against the bucket's least set a.

    many: some bucket of the two holds a third set, so b may have to be compared further by its distance to a.
    """
    width = 2 * how.rows
    bands = F.array(*[F.xxhash64(F.lit(k), F.substring("registers", k * width + 1, width)) for k in range(how.bands)])
    rows = sets.select("id", "n", F.explode(bands).alias("bucket"))
    within = Window.partitionBy("bucket")
    rows = rows.select("id", "n", F.min("id").over(within).alias("pivot"), F.count("*").over(within).alias("count"))
    rows = rows.where("id <> pivot").groupBy(F.col("pivot").alias("a"), F.col("id").alias("b"))
    rows = stored(rows.agg(F.max("n").alias("nb"), (F.max("count") > 2).alias("many")), "stars")
    return rows.join(sets.select(F.col("id").alias("a"), F.col("n").alias("na")), "a")


def _within_size(a: str, b: str, how: SetSketch) -> str:
    """Only sets of like size can be linked."""
    return f"100 * least({a}, {b}) >= {how.percent} * greatest({a}, {b})"


def _counted(pairs: DataFrame, sets: DataFrame, docs: DataFrame, how: SetSketch) -> DataFrame:
    """pairs (a, b, many) → (a, b, na, nb, inter, outside), counted on the full shingle sets.

    Pairs that are unlikely to be linked are discarded first, except the `many`; for these, outside holds hashes of the
    shingles of b that a lacks.
    """
    side = lambda x: sets.select(F.col("id").alias(x), F.col("n").alias(f"n{x}"), F.col("registers").alias(f"r{x}"))
    id_type = sets.schema["id"].dataType.simpleString()

    def discard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            na, nb = (batch.column(k).to_numpy(zero_copy_only=False).astype(float) for k in (3, 5))
            ra, rb = (
                np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint16).reshape(-1, how.registers) for k in (4, 6)
            )
            keep = batch.column(2).to_numpy(zero_copy_only=False).astype(bool)
            keep |= likely(ra, rb, na, nb, how) >= how.least_likely
            yield pa.RecordBatch.from_arrays(batch.columns[:3], names=["a", "b", "many"]).filter(pa.array(keep))

    rows = pairs.select("a", "b", "many").join(side("a"), "a").join(side("b"), "b").select("a", "b", "many", "na", "ra", "nb", "rb")
    rows = stored(rows.mapInArrow(discard, f"a {id_type}, b {id_type}, many boolean"), "likely")
    ends = rows.select(F.col("a").alias("doc_id")).union(rows.select(F.col("b").alias("doc_id"))).distinct()
    texts = docs.select("doc_id", "text").join(ends.hint("merge"), "doc_id").dropDuplicates(["doc_id"])
    texts = stored(texts, "texts")
    full = rows.join(texts.toDF("a", "ta"), "a").join(texts.toDF("b", "tb"), "b").select("a", "b", "many", "ta", "tb")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, one = None, set()
        for batch in batches:
            columns: list[list] = [[], [], [], []]
            for a, many, ta, tb in zip(*(batch.column(k) for k in (0, 2, 3, 4)), strict=True):
                if a != last:
                    last, one = a, _shingles(split_words(ta.as_py()), how.words)
                other = _shingles(split_words(tb.as_py()), how.words)
                apart, first = other - one, []
                common = len(other) - len(apart)
                if many.as_py():
                    first = [xxhash.xxh64_intdigest(b"\0".join(s)) - (1 << 63) for s in apart]
                for column, value in zip(columns, (len(one), len(other), common, first), strict=True):
                    column.append(value)
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()))
            arrays = [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), *arrays], names=["a", "b", "na", "nb", "inter", "outside"]
            )

    schema = f"a {id_type}, b {id_type}, na long, nb long, inter long, outside array<long>"
    return stored(full.mapInArrow(count, schema), "counted")


def _shingles(words: list[bytes], n: int) -> set:
    n = min(n, len(words))
    return set(zip(*(words[k:] for k in range(n)), strict=False)) if n else set()


def near_duplicates(docs: DataFrame, how: SetSketch = SetSketch()) -> DataFrame:
    """docs (doc_id, text) → per row: doc_id, n_shingles, component_id, kept.

    Documents whose shingle sets have 100 * intersection >= percent * union are linked; component_id is the least doc_id
    reachable, kept marks it. Null and empty texts have no set, link with nothing and are kept. Rows without doc_id can't be
    named in a link: component_id is null and they are kept. Repeated rows share their document's answer; doc_id names one
    text, and of several texts under one doc_id only one is compared.
    """
    rows = stored(sketches(docs, how), "sketches")
    named = rows.where("doc_id is not null and n_shingles > 0")
    grouped = named.groupBy("k1", "k2").agg(F.min("doc_id").alias("id"), F.max("n_shingles").alias("n"), F.max("registers").alias("registers"))
    sets = stored(grouped, "sets")
    own = sets.select("k1", "k2", F.col("id").alias("set_id"))
    # below this size a linked set would have to be equal
    least = -(-how.percent // (100 - how.percent)) if how.percent < 100 else 1 << 62
    banded = stored(sets.where(F.col("n") >= least).select("id", "n", "registers").dropDuplicates(["id"]), "banded")
    stars = _stars(banded, how).where("many or " + _within_size("na", "nb", how))
    counted = _counted(stars, banded, docs, how)
    links = counted.where(_linked(how)).select("a", "b")
    groups = components(links)
    rest = stored(_rest(counted, groups, banded, how), "rest")
    if not rest.isEmpty():
        more = _counted(rest.withColumn("many", F.lit(False)), banded, docs, how)
        groups = components(links.union(more.where(_linked(how)).select("a", "b")))
    answer = own.join(groups.withColumnRenamed("id", "set_id"), "set_id", "left").select(
        "k1", "k2", F.coalesce("component", "set_id").alias("_component")
    )
    named_component = F.when(F.col("n_shingles") > 0, F.col("_component")).otherwise(F.col("doc_id"))
    out = rows.select("doc_id", "n_shingles", "k1", "k2").join(answer, ["k1", "k2"], "left")
    out = out.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), named_component).alias("component_id"))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def _linked(how: SetSketch) -> str:
    return f"100 * inter >= {how.percent} * (na + nb - inter)"


def _rest(counted: DataFrame, groups: DataFrame, sets: DataFrame, how: SetSketch) -> DataFrame:
    """Pairs (a, b) round one pivot that are in different groups and may be linked as far as the pivot tells.

    What linked sets x and y share beyond x's part of the pivot, they share among their `outside` shingles. So many of those
    have to meet that of x's outside shingles, the rarest round the pivot first, one of all but the last needed - 1 does; only
    those are joined. Sets that need none are both close to the pivot and are compared by that. The low four bits of all
    registers then rule out pairs far from the threshold.
    """
    label = groups.select(F.col("id").alias("b"), "component")
    rows = counted.select("a", "b", F.col("nb").alias("n"), "inter", "outside", F.expr(_linked(how)).alias("direct"))
    rows = rows.join(label, "b", "left").withColumn("component", F.coalesce("component", "b"))
    spread = rows.groupBy("a").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.min("n").alias("least"))
    rows = rows.join(spread.where("lo <> hi").select("a", "least"), "a")
    low = F.transform(
        F.sequence(F.lit(0), F.lit(how.registers // 16 - 1)),
        lambda k: F.conv(F.substring(F.regexp_replace(F.hex("registers"), ".(.)..", "$1"), k * 16 + 1, 16), 16, -10).cast("long"),
    )
    rows = stored(rows.join(sets.select(F.col("id").alias("b"), low.alias("low")), "b"), "round-pivots")
    # a pair at the threshold differs in a fifth of the registers, 15 of 16 times visibly; six standard errors are allowed
    p = (1 - how.percent / 100) * 15 / 16
    most = int(how.registers * p + 6 * (how.registers * p * (1 - p)) ** 0.5)
    nibbles = lambda v: f"(({v} | shiftrightunsigned({v}, 1) | shiftrightunsigned({v}, 2) | shiftrightunsigned({v}, 3)) & 1229782938247303441)"
    differing = " + ".join(f"bit_count({nibbles(f'(x.low[{k}] ^ y.low[{k}])')})" for k in range(how.registers // 16))
    may = f"x.component <> y.component and {_within_size('x.n', 'y.n', how)} and {differing} <= {most}"
    pair = (F.least("x.b", "y.b").alias("a"), F.greatest("x.b", "y.b").alias("b"))
    slim = rows.drop("outside")
    share = f"{how.percent} / {100 + how.percent}"  # of both sizes, for the intersection of linked sets
    needed = F.expr(f"greatest(ceil({share} * (n + greatest(least, {how.percent / 100} * n)) - 1e-9) - inter, 1)")
    keyed = rows.select(
        "a", "b", "n", "component", "direct", "low", F.size("outside").alias("size"), needed.alias("needed"),
        F.explode("outside").alias("shingle"),
    )
    common = keyed.groupBy("a", "shingle").agg(F.count("*").alias("times")).where("times > 1")
    own = Window.partitionBy("a", "b")
    keyed = keyed.join(common, ["a", "shingle"])
    keyed = keyed.withColumns({"met": F.count("*").over(own), "place": F.row_number().over(own.orderBy("times", "shingle"))})
    # shingles that occur once come first in the order and can't meet
    keyed = stored(keyed.where("place <= size - needed + 1 - (size - met)").drop("size", "needed", "times", "met", "place"), "outside")
    x, y = keyed.where("not direct").alias("x"), keyed.alias("y")
    sharing = x.join(y, F.expr(f"x.a = y.a and x.shingle = y.shingle and {may}")).select(*pair)
    close = f"{100 + how.percent} * least(x.inter, y.inter) >= {how.percent} * (x.n + y.n)"
    held = slim.where(f"{100 + how.percent} * inter >= {how.percent} * (n + {how.percent / 100} * n)")
    x, y = held.where("not direct").alias("x"), held.alias("y")
    alike = x.join(y, F.expr(f"x.a = y.a and {close} and {may}")).select(*pair)
    return sharing.union(alike).distinct().join(counted.select("a", "b"), ["a", "b"], "left_anti")
