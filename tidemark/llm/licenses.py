"""License scan by ordered signature rules. DataFrame expressions only.

A text's words are looked up among the rules' keywords first; only where a keyword stands are that keyword's regular expressions
tried, one part ending at the keyword and the other starting behind it. So a text without keywords costs one pass, and a
detection's place is known from the keyword's, without searching the text for it.

Detections overlap. Of two, the one whose words all lie inside the other's goes, if the other's kind is as strong or stronger;
for equal words the stronger kind stays, then the earlier rule. In order of their starts that takes one running
maximum of ends per kind.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import let, stored
from tidemark.llm.license_rules import AFTER, BEFORE, CONFIDENCE, RULES

#: What parts words: ASCII other than letters and digits.
_BETWEEN = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
KEYWORDS = sorted({rule.keyword for rule in RULES})


def _rules() -> Column:
    """Keyword → its rules in order. The parts match from the blank on their left to the blank on their right."""
    entries = []
    for keyword in KEYWORDS:
        own = [
            F.struct(
                F.lit(r.number).alias("rule"),
                F.lit(f" (?:{r.before})$" if r.before else "").alias("before"),
                F.lit(f"^(?:{r.after}) " if r.after else "").alias("after"),
            )
            for r in RULES
            if r.keyword == keyword
        ]
        entries += [F.lit(keyword), F.array(*own)]
    return F.create_map(*entries)


def _words(part: Column) -> Column:
    """Words of a matched part, which stand between blanks."""
    return F.greatest(F.length(part) - F.length(F.replace(part, F.lit(" "), F.lit(""))) - 1, F.lit(0))


def _part(text: Column, pattern: Column) -> Column:
    return F.call_function("regexp_extract", text, pattern, F.lit(0))


def _found_at(words: Column, place: Column) -> Column:
    """The detections (start, end exclusive, rule) that the keyword at a place belongs to."""
    first = F.greatest(place - BEFORE, F.lit(0))
    before = F.concat(F.lit(" "), F.array_join(F.slice(words, first + 1, place - first), " "), F.lit(" "))
    after = F.concat(F.lit(" "), F.array_join(F.slice(words, place + 2, AFTER), " "), F.lit(" "))

    def tried(near: Column) -> Column:
        def one(rule: Column) -> Column:
            return let(
                F.struct(
                    _part(near["before"], rule["before"]).alias("b"), _part(near["after"], rule["after"]).alias("a")
                ),
                lambda m: F.when(
                    ((rule["before"] == "") | (m["b"] != "")) & ((rule["after"] == "") | (m["a"] != "")),
                    F.struct(
                        (place - _words(m["b"])).alias("start"),
                        (place + 1 + _words(m["a"])).alias("end"),
                        rule["rule"].alias("rule"),
                    ),
                ),
            )

        return F.filter(F.transform(F.element_at(_rules(), F.get(words, place)), one), lambda d: d.isNotNull())

    return let(F.struct(before.alias("before"), after.alias("after")), tried)


def detections(docs: DataFrame) -> DataFrame:
    """docs with `text` → the same rows with n_words (long) and found: all detections (start, end, rule) before suppression."""
    kept = docs.drop("n_words", "found", "_spaced", "_w")
    spaced = F.trim(F.regexp_replace(F.coalesce("text", F.lit("")), _BETWEEN, " "))
    rows = kept.withColumn("_spaced", spaced).withColumn("_w", F.split(F.lower("_spaced"), " "))
    # lower-casing beyond A-Z can only add keywords here; the words that rules see are lower-cased in A-Z alone
    named = F.arrays_overlap("_w", F.array(*map(F.lit, KEYWORDS)))
    places = lambda w: F.filter(F.sequence(F.lit(0), F.size(w) - 1), lambda i: F.get(w, i).isin(KEYWORDS))
    all_found = let(F.split(F.translate("_spaced", _UPPER, _LOWER), " "), lambda w: F.flatten(F.transform(places(w), lambda i: _found_at(w, i))))
    none = F.array().cast("array<struct<start:int,end:int,rule:int>>")
    return rows.select(
        *kept.columns,
        F.when(F.col("_spaced") == "", 0).otherwise(F.size("_w")).cast("long").alias("n_words"),
        F.when(named, all_found).otherwise(none).alias("found"),
    )


def _of_rule(values: list) -> Column:
    return F.get(F.array(*map(F.lit, values)), F.col("rule"))


def _resolved(rows: DataFrame) -> DataFrame:
    """_row, start, end, rule → those that no other one of the row suppresses, with label, kind and confidence."""
    rows = rows.select("*", _of_rule([r.label for r in RULES]).alias("label"), _of_rule([r.kind for r in RULES]).alias("kind"))
    order = Window.partitionBy("_row").orderBy("start", F.col("end").desc(), "kind", "rule").rowsBetween(Window.unboundedPreceding, -1)
    reached = [F.max(F.when(F.col("kind") <= k, F.col("end"))).over(order) for k in range(len(CONFIDENCE))]
    rows = rows.withColumn("_reached", F.get(F.array(*reached), F.col("kind")))
    rows = rows.where(F.col("_reached").isNull() | (F.col("end") > F.col("_reached"))).drop("_reached")
    return rows.withColumn("confidence", F.get(F.array(*map(F.lit, CONFIDENCE)), F.col("kind")))


def scan(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) → per row: doc_id, n_words (long), detections (start, end, label, kind, confidence; by start).

    start and end (exclusive) count words from 0; labels of kind 0 are the base phrases', which nothing suppresses. Null and
    empty texts have no words and no detections. Rows that repeat a document are scanned each. Very long texts are scanned
    whole; one row's words and detections are held at once. An empty table gives no rows. Other columns are not read,
    whatever they are called.
    """
    found = stored(detections(docs.select("doc_id", "text")).drop("text"), "license-detections")
    rows = found.select(F.monotonically_increasing_id().alias("_row"), "doc_id", "n_words", "found")
    parts = ["start", "end", "label", "kind", "confidence"]
    each = rows.select("_row", "doc_id", "n_words", F.inline("found"))
    some = _resolved(each).groupBy("_row").agg(
        F.first("doc_id").alias("doc_id"), F.first("n_words").alias("n_words"), F.sort_array(F.collect_list(F.struct(*parts))).alias("detections")
    )
    kind = some.schema["detections"].dataType
    none = rows.where(F.size("found") == 0).select("doc_id", "n_words", F.array().cast(kind).alias("detections"))
    return some.select("doc_id", "n_words", "detections").unionByName(none)


def summary(rows: DataFrame) -> DataFrame:
    """scan rows → doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score (the highest confidence, else 0)."""
    base = F.filter("detections", lambda d: d["kind"] == 0)
    names = lambda found: F.array_join(F.array_sort(F.array_distinct(F.transform(found, lambda d: d["label"]))), ",")
    starts = F.transform(base, lambda d: d["start"].cast("long"))
    return rows.select(
        "doc_id", "n_words", F.size(base).cast("long").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
        names(base).alias("base_labels"), names(F.col("detections")).alias("labels"),
        F.coalesce(F.array_max(F.transform("detections", lambda d: d["confidence"])), F.lit(0.0)).alias("score"),
    )
