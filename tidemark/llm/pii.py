"""Personal data: fixed forms as seeds, and bootstrapped contextual patterns for identifiers outside those forms.

Found forms are seeds, and so are long runs of random letters and digits, which may be secrets. The words and marks around
them are patterns; patterns and identifier-like strings make a graph whose two sides score each other in turns as joins and
grouped sums: a pattern is trusted by the share of its strings that are trusted, a string by the patterns it occurs in. Strings
that trusted patterns surround become spans of the pattern's kind. A secret is a span through its pattern only: a random run
in a place where other strings stand as well is none, and a short password in a place of secrets is one.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import stored

KINDS = ("email", "ip", "card", "phone", "secret")
SECRET = 4
#: The forms of the base spans.
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile("[0-9]")
#: Whole numbers, never digits cut out of a longer run of letters and digits.
_NUMBERS = re.compile(r"(?<![A-Za-z0-9])[+(]?[0-9][0-9\x20().-]*[0-9](?![A-Za-z0-9])")
_MAIL_LIKE = re.compile(r"[^\s<>()\[\],;\"']+@[^\s<>()\[\],;\"']+")
_WORD = re.compile(r"[^\W\d_]+")
#: A value behind a name: every one is a candidate for a secret, so that a pattern's share counts plain values as well.
_VALUE = re.compile(r"(?<=[:=])[\x20\t]{0,4}[\"']?([^\s\"'<>()\[\],;]{4,})")
#: Whole runs of letters and digits that are long enough for a seed of the kind secret.
_RUN = re.compile(r"(?<![A-Za-z0-9_+/-])[A-Za-z0-9_+/-]{20,200}={0,2}(?![A-Za-z0-9_+/=-])")
#: A name with the marks that part it from its value.
_NAMED = re.compile(r"([^\W\d_]+)([^\w\s]|\s){1,6}$")
#: Characters on either side in which context words are looked for.
_NEAR = 60


@dataclass(frozen=True)
class Bootstrap:
    rounds: int = 3
    #: A pattern needs so many trusted strings, and so high a share of them (with one doubtful string added).
    support: float = 4.0
    trusted_pattern: float = 0.8
    #: A string becomes a span from this belief on.
    trusted_string: float = 0.9
    #: Bits per character that a run of 20 characters or more, of letters and digits, has as a seed of the kind secret.
    entropy: float = 3.0


def luhn(digits: str) -> bool:
    values = [int(d) for d in reversed(digits)]
    return (sum(values[::2]) + sum(sum(divmod(2 * v, 10)) for v in values[1::2])) % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the fixed forms, by kind and start."""
    out = []
    if "@" in text:
        out += [(0, *m.span()) for m in EMAIL.finditer(text)]
    if _DIGIT.search(text):
        if "." in text:
            for m in IP.finditer(text):
                if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m[0].split(".")):
                    out.append((1, *m.span()))
        for m in CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 13 <= len(digits) <= 19 and luhn(digits):
                out.append((2, *m.span()))
        if "+" in text:
            for m in PHONE.finditer(text):
                if 9 <= len(_DIGIT.findall(m[0])) <= 15:
                    out.append((3, *m.span()))
    return out


def random_run(run: str, least: float) -> bool:
    """Whether letters and digits are mixed as in a key: both are there, and the characters carry enough bits each."""
    if not (_DIGIT.search(run) and any(c.isalpha() for c in run)):
        return False
    return -sum(n / len(run) * math.log2(n / len(run)) for n in Counter(run).values()) >= least


def _outside(spans: list[tuple[int, int, int]], taken: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Spans that overlap none of the taken ones: one walk over both lists, sorted by place."""
    busy, out, at, reach = sorted((s, e) for _, s, e in taken), [], 0, 0
    for span in sorted(spans, key=lambda x: (x[2], x[1])):
        while at < len(busy) and busy[at][0] < span[2]:
            reach = max(reach, busy[at][1])
            at += 1
        if reach <= span[1]:
            out.append(span)
    return out


def secrets(text: str, taken: list[tuple[int, int, int]], least: float) -> list[tuple[int, int, int, bool]]:
    """(kind, start, end, seed) of random runs and of all values behind a name, outside base spans; a longer one wins."""
    runs = [(SECRET, *m.span()) for m in _RUN.finditer(text) if random_run(m[0], least)]
    values = [(SECRET, *m.span(1)) for m in _VALUE.finditer(text)] if ":" in text or "=" in text else []
    seeds = _outside(runs, taken)
    return [(*r, True) for r in seeds] + [(*v, False) for v in _outside(values, [*taken, *seeds])]


def candidates(text: str, taken: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """(kind, start, end) of strings like an identifier of the kind, outside base spans."""
    out = []
    if "@" in text:
        out += [(0, *m.span()) for m in _MAIL_LIKE.finditer(text)]
    if _DIGIT.search(text):
        for m in _NUMBERS.finditer(text):
            digits = len(_DIGIT.findall(m[0]))
            if m[0].count(".") == 3 and " " not in m[0]:
                out.append((1, *m.span()))
            elif digits >= 12:
                out.append((2, *m.span()))
            if 7 <= digits <= 15:
                out.append((3, *m.span()))
    return _outside(out, taken)


def context(text: str, start: int, end: int, kind: int = 0) -> list[str]:
    """Lexical patterns around a span: the word before it with the marks between; one and two words before it, one after it,
    and both sides. A secret has the first only: what stands after plain words is not counted whole for it."""
    named = _NAMED.search(text, max(0, start - _NEAR), start)
    marks = "".join(text[named.end(1) : start].split()) if named else ""
    name = [f"{named[1].lower()}{marks}_"] if marks else []
    if kind == SECRET:
        return name if marks and marks[0] in ":=" else []
    before = _WORD.findall(text[max(0, start - _NEAR) : start].lower())[-2:]
    after = _WORD.findall(text[end : end + _NEAR].lower())[:1]
    out = name
    if before:
        out.append(f"{before[-1]} _")
    if len(before) == 2:
        out.append(f"{before[0]} {before[1]} _")
    if after:
        out.append(f"_ {after[0]}")
    if before and after:
        out.append(f"{before[-1]} _ {after[0]}")
    return out


def _string(kind: int, found: str) -> str:
    return found if kind == SECRET else found.lower() if kind == 0 else "".join(c for c in found if c.isdigit() or c == ".") if kind == 1 else "".join(
        _DIGIT.findall(found)
    )


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for k, s, e in sorted(spans))


def extract(docs: DataFrame, how: Bootstrap = Bootstrap()) -> DataFrame:
    """docs (doc_id, text) → doc_id, key (of the text), base_sha256, base spans, and the occurrences that make the graph.

    An occurrence is a seed (of the base forms or a random run), and open where it may become an added span."""
    id_type = docs.schema["doc_id"].dataType.simpleString()
    span = pa.struct([("kind", pa.int32()), ("start", pa.int32()), ("end", pa.int32())])
    seen = pa.struct(
        [("kind", pa.int32()), ("start", pa.int32()), ("end", pa.int32()), ("seed", pa.bool_()), ("open", pa.bool_()), ("string", pa.string()), ("patterns", pa.list_(pa.string()))]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, digests, bases, seens = [], [], [], []
            for item in batch.column(1):
                text = item.as_py() or ""
                base = sorted(base_spans(text))
                rows = [(*b, True, False) for b in base] + [(*c, True) for c in secrets(text, base, how.entropy)]
                hidden = [(k, s, e) for k, s, e, seed, free in rows if seed]
                rows += [(*c, False, True) for c in candidates(text, hidden)]
                keys.append(xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass")) - (1 << 63) if rows else 0)
                digests.append(hashlib.sha256(joined(base).encode()).hexdigest())
                bases.append([{"kind": k, "start": s, "end": e} for k, s, e in base])
                seens.append(
                    [
                        {"kind": k, "start": s, "end": e, "seed": seed, "open": free, "string": _string(k, text[s:e]), "patterns": context(text, s, e, k)}
                        for k, s, e, seed, free in rows
                    ]
                )
            arrays = [batch.column(0), pa.array(keys, pa.int64()), pa.array(digests), pa.array(bases, pa.list_(span)), pa.array(seens, pa.list_(seen))]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "key", "base_sha256", "base", "seen"])

    one = "kind: int, start: int, end: int"
    schema = (
        f"doc_id {id_type}, key long, base_sha256 string, base array<struct<{one}>>, "
        f"seen array<struct<{one}, seed: boolean, open: boolean, string: string, patterns: array<string>>>"
    )
    return docs.select("doc_id", "text").mapInArrow(run, schema)


def beliefs(graph: DataFrame, how: Bootstrap) -> tuple[DataFrame, DataFrame]:
    """Edges (kind, pattern, string, seed) → trusted patterns (kind, pattern, trust) and strings (kind, string, belief).

    Each round, patterns get (sum of beliefs) / (strings + 1) if the sum reaches the support, and strings that are no seeds
    1 - product(1 - trust) over their trusted patterns. Grouped sums and joins of stored tables throughout; a very common
    word is one group of partial sums.
    """
    edges = graph.groupBy("kind", "pattern", "string").agg(F.max("seed").alias("seed"))
    edges = stored(edges, "pii-edges")
    known = edges.select("kind", "string", F.when(F.col("seed"), 1.0).otherwise(0.0).alias("belief"))
    known = stored(known.groupBy("kind", "string").agg(F.max("belief").alias("belief")), "pii-strings")
    seeds = known.where("belief = 1").select("kind", "string", F.lit(True).alias("fixed"))
    trusted = None
    for _ in range(how.rounds):
        scored = edges.join(known, ["kind", "string"]).groupBy("kind", "pattern")
        scored = scored.agg(F.sum("belief").alias("sum"), F.count("*").alias("n"))
        scored = scored.select("kind", "pattern", "sum", (F.col("sum") / (F.col("n") + 1)).alias("trust"))
        trusted = stored(scored.where((F.col("sum") >= how.support) & (F.col("trust") >= how.trusted_pattern)), "pii-patterns")
        doubt = F.sum(F.log(1 - F.least("trust", F.lit(0.999999))))
        found = edges.join(trusted, ["kind", "pattern"]).groupBy("kind", "string").agg((1 - F.exp(doubt)).alias("found"))
        known = known.select("kind", "string").join(found, ["kind", "string"], "left").join(seeds, ["kind", "string"], "left")
        belief = F.when(F.col("fixed"), 1.0).otherwise(F.coalesce("found", F.lit(0.0)))
        known = stored(known.select("kind", "string", belief.alias("belief")), "pii-strings")
    return trusted, known


def personal_data(docs: DataFrame, how: Bootstrap = Bootstrap()) -> DataFrame:
    """docs (doc_id, text) → per row: doc_id, base_sha256, base, added (arrays of kind, start, end in code points).

    Texts are read whole and once. Null and empty texts have no spans; repeated rows get the same answer each. An added span is
    an occurrence of a trusted string inside a trusted pattern; it never overlaps a base span.
    """
    rows = stored(extract(docs, how), "pii-rows")
    seen = rows.where(F.size("seen") > 0).select("doc_id", "key", F.explode("seen").alias("o")).select("doc_id", "key", "o.*")
    seen = stored(seen.select("*", F.explode_outer("patterns").alias("pattern")).drop("patterns"), "pii-seen")
    trusted, known = beliefs(seen.where("pattern is not null").select("kind", "pattern", "string", "seed"), how)
    sure = known.where(F.col("belief") >= how.trusted_string).select("kind", "string")
    added = seen.where("open").join(trusted.select("kind", "pattern"), ["kind", "pattern"]).join(sure, ["kind", "string"])
    added = added.groupBy(F.col("doc_id").alias("_doc"), F.col("key").alias("_key")).agg(
        F.array_sort(F.collect_set(F.struct("kind", "start", "end"))).alias("added")  # of one document
    )
    out = rows.join(added, F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("key") == F.col("_key")), "left")
    empty = F.expr("cast(array() as array<struct<kind: int, start: int, end: int>>)")
    return out.select("doc_id", "base_sha256", "base", F.coalesce("added", empty).alias("added"))


def summary(found: DataFrame) -> DataFrame:
    """personal_data's rows → doc_id, counts per kind, base_sha256, spans (all, as kind:start:end by kind, then start)."""
    every = F.array_sort(F.concat("base", "added"))
    names = F.array(*map(F.lit, KINDS))
    text = F.transform(every, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"], s["end"]))
    of_kind = lambda k: F.size(F.filter(every, lambda s: s["kind"] == k)).cast("long")
    counts = [of_kind(k).alias(f"n_{name}") for k, name in enumerate(KINDS)]
    totals = [F.size(x).cast("long").alias(n) for x, n in ((every, "n_spans"), (F.col("added"), "n_added"))]
    return found.select("doc_id", *counts, "base_sha256", F.array_join(text, ",").alias("spans"), *totals)
