"""Quality rules as a ledger of failure bits. DataFrame expressions only.

Every rule is measured and judged once per document; the ledger keeps the measurements and one long of failure bits.
Policies are masks over those bits, so another policy, or the question what a rule alone removes, needs no text again.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import let, words_of

#: Rule name → (bit, failing condition on the measurements).
RULES: dict[str, tuple[int, str]] = {
    "few_words": (0, "n_words < 10"),
    "repeated_words": (1, "100 * n_repeat_words > 20 * n_words"),
    "symbols": (2, "10 * n_symbols > n_words"),
    "repeated_lines": (3, "10 * n_dup_lines > 3 * n_lines"),
    "capitals": (4, "10 * n_upper > 4 * word_chars"),
    "exclamations": (5, "10 * n_exclaim > 3 * n_words"),
    "poor_vocabulary": (6, "4 * n_distinct_words * n_distinct_words < 9 * n_words"),
    "word_length": (7, "word_chars < 2 * n_words or word_chars > 20 * n_words"),
}
BASE = ("few_words", "repeated_words")
MEASURES = (
    "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
    "n_lines", "n_upper", "n_exclaim", "n_distinct_words",
)


@dataclass(frozen=True)
class Policy:
    """A version of the decision: a document is kept if it fails none of the named rules."""

    version: str
    rules: tuple[str, ...]

    @property
    def mask(self) -> int:
        return sum(1 << RULES[r][0] for r in self.rules)


BASE_POLICY = Policy("base", BASE)
LENIENT = Policy("1", (*BASE, "symbols", "repeated_lines"))
PRODUCTION = Policy("2", tuple(RULES))


def measure(docs: DataFrame) -> DataFrame:
    """docs with `text` → the same rows with the measurements (long); a null or empty text has no words and zeros.

    Columns of docs that bear a measurement's name are replaced.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    kept = docs.drop(*MEASURES, "_w", "_l")
    rows = kept.withColumns({"_w": words_of(F.col("text")), "_l": lines})
    count = lambda pattern: F.length(text) - F.length(F.regexp_replace(text, pattern, ""))
    return rows.select(
        *kept.columns,
        F.size("_w").cast("long").alias("n_words"),
        F.length(F.regexp_replace(text, r"[\x20\x09-\x0D]+", "")).cast("long").alias("word_chars"),
        count(r"[#*$%&|<>]+").cast("long").alias("n_symbols"),
        (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
        _repeated(F.col("_w")).alias("n_repeat_words"),
        F.size("_l").cast("long").alias("n_lines"),
        count(r"\p{Lu}+").cast("long").alias("n_upper"),
        count("!+").cast("long").alias("n_exclaim"),
        F.size(F.array_distinct("_w")).cast("long").alias("n_distinct_words"),
    )


def _repeated(words: Column) -> Column:
    """Words inside 5-word windows that occur twice or more.

    Arrays that lambdas look into are bound once by let: a filter on the result may be pushed below the projection that made
    them, and they would be built anew for every element.
    """
    hashes = lambda w: F.when(
        F.size(w) >= 5,
        F.transform(F.sequence(F.lit(0), F.size(w) - 5), lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(5)])),
    ).otherwise(F.array().cast("array<bigint>"))
    placed = lambda h: F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("p"))))
    none = F.lit(0).cast("long")
    return let(
        let(words, hashes),
        lambda h: F.when(F.size(F.array_distinct(h)) < F.size(h), let(placed(h), _covered)).otherwise(none),
    )


def _covered(windows: Column) -> Column:
    """Words covered by windows whose hash occurs twice or more, from (hash, place) pairs in order: linear passes."""
    last = F.size(windows) - 1
    again = F.transform(
        windows,
        lambda e, k: F.when(
            ((k > 0) & (F.get(windows, k - 1)["h"] == e["h"])) | ((k < last) & (F.get(windows, k + 1)["h"] == e["h"])), e["p"]
        ),
    )
    starts = F.sort_array(F.array_compact(again))
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("end"))
    fold = F.aggregate(
        starts,
        start,
        lambda acc, p: F.struct(
            (acc["n"] + (p + 5 - F.greatest(acc["end"], p))).cast("long").alias("n"), (p + 5).alias("end")
        ),
    )
    return fold["n"]


def ledger(docs: DataFrame) -> DataFrame:
    """docs → the same rows with measurements and `failed` (long): bit b is set if the rule with bit b fails.

    Defined for every row: null and empty texts fail few_words only. Repeated rows are judged each.
    """
    measured = measure(docs.drop("failed"))
    bits = [F.when(F.expr(condition), F.lit(1 << bit)).otherwise(F.lit(0)) for bit, condition in RULES.values()]
    failed = bits[0].cast("long")
    for bit in bits[1:]:
        failed = failed.bitwiseOR(bit.cast("long"))
    return measured.withColumn("failed", failed)


def passes(policy: Policy) -> Column:
    """Whether a ledger row is kept under a policy."""
    return F.col("failed").bitwiseAND(F.lit(policy.mask)) == 0


def only_rule(policy: Policy) -> Column:
    """The rule without which a policy would keep a ledger row; null for kept rows and for those that fail several rules."""
    bits = F.col("failed").bitwiseAND(F.lit(policy.mask))
    found = F.lit(None).cast("string")
    for rule in policy.rules:
        found = F.when(bits == 1 << RULES[rule][0], F.lit(rule)).otherwise(found)
    return found


def ablations(rows: DataFrame, policy: Policy) -> DataFrame:
    """A ledger → per rule of the policy: documents failing it, documents only it rejects, documents kept without it.

    Works on counts per distinct bit pattern (at most two to the number of rules), not on documents.
    """
    patterns = rows.groupBy(F.col("failed").bitwiseAND(F.lit(policy.mask)).alias("bits")).agg(F.count("*").alias("n"))
    rules = F.array(
        *[F.struct(F.lit(r).alias("rule"), F.lit(1 << RULES[r][0]).cast("long").alias("bit")) for r in policy.rules]
    )
    each = patterns.select("bits", "n", F.explode(rules).alias("r"))
    bit = F.col("r.bit")
    total = lambda condition: F.coalesce(F.sum(F.when(condition, F.col("n"))), F.lit(0)).cast("long")
    return each.groupBy(F.col("r.rule").alias("rule")).agg(
        total(F.col("bits").bitwiseAND(bit) != 0).alias("n_failed"),
        total(F.col("bits") == bit).alias("n_only"),
        total(F.col("bits").bitwiseAND(F.bitwise_not(bit)) == 0).alias("n_kept_without"),
    )
