"""License detections against a plain scan, rule by rule and word by word."""

from __future__ import annotations

import random
import re

import duckdb
from pyspark.sql import functions as F

from tidemark.llm import license_rules, licenses, queries

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
LINES = [
    "Released under the MIT License.", "Licensed under the Apache License, Version 2.0 (the \"License\");", "SPDX-License-Identifier: GPL-2.0-or-later",
    "Licensed under CC BY-NC 4.0.", "This work is licensed under the GNU General Public License, version 3.", "see LICENSE.txt for details",
    "http://www.apache.org/licenses/LICENSE-2.0", "All rights reserved", "dual licensed under the MIT license or the Apache License Version 2.0",
    "Creative Commons Attribution-NonCommercial-ShareAlike 4.0", "cc by nc cc by nc cc by nc sa 4 0", "Redistribution and use in source and binary forms, with "
    "or without modification, are permitted provided that the following conditions are met:", "commit the permit of mitigation",
]


def plain(text):
    w = WORD.findall((text or "").translate(LOWER))
    found = []
    for p, word in enumerate(w):
        for r in license_rules.RULES:
            if r.keyword == word:
                x = " " + "".join(v + " " for v in w[max(0, p - license_rules.BEFORE) : p])
                y = "".join(" " + v for v in w[p + 1 : p + 1 + license_rules.AFTER]) + " "
                b, a = re.search(f" (?:{r.before})$", x), re.search(f"^(?:{r.after}) ", y)
                if b and a:
                    found.append((p - len(WORD.findall(b[0])), p + 1 + len(WORD.findall(a[0])), r))
    best = lambda d: (d[0], -d[1], d[2].kind, d[2].number)
    left = [d for d in found if not any(e is not d and e[2].kind <= d[2].kind and e[0] <= d[0] and e[1] >= d[1] and best(e) < best(d) for e in found)]
    return len(w), sorted((s, e, r.label, r.kind) for s, e, r in left)


def scanned(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    rows = licenses.scan(docs.withColumns({"_row": F.lit("x"), "label": F.lit("y"), "found": F.lit("z"), "start": F.lit(0)})).collect()
    return {r["doc_id"]: (r["n_words"], [(d["start"], d["end"], d["label"], d["kind"]) for d in r["detections"]]) for r in rows}


def test_matches_a_plain_scan(spark):
    rng = random.Random(4)
    filler = ["tion", "onesen", "license", "mit", "under", "the", "gnu", "İ", "K", "ünder", "日本", "v2", "open", "cc", "by", "nc"]
    texts = [*LINES, None, "", " \n-- !", "MIT", "cc by nc", "Kernel under the MİT license"]
    for _ in range(120):
        texts.append(" ".join(rng.choice([*LINES, *filler * 2]) for _ in range(rng.randint(1, 12))))
    texts.append("filler words " * 30_000 + "under the MIT-License " * 200)
    assert scanned(spark, texts) == {k: plain(t) for k, t in enumerate(texts)}


def test_labels(spark):
    found = {k: [d[2] for d in v[1]] for k, v in scanned(spark, LINES).items()}
    assert found[0] == ["mit", "mit"] or found[0] == ["mit"]
    assert "apache-2" in found[1] and found[2] == ["gpl-2-or-later"] and "cc-by-nc-4.0" in found[3] and "gpl-3" in found[4]
    assert found[7] == ["proprietary"] and found[9] == ["cc-by-nc-sa"] and found[12] == []
    assert {"mit", "apache-2"} <= set(found[8])


def test_every_rule_has_a_keyword_and_fits_the_window():
    assert len(license_rules.RULES) > 300
    for r in license_rules.RULES:
        assert r.label and r.keyword in licenses.KEYWORDS
        re.compile(r.before), re.compile(r.after)


def test_repeated_rows_and_empty_table(spark):
    docs = spark.createDataFrame([(1, LINES[0]), (1, LINES[0]), (None, None), (None, "x")], "doc_id long, text string")
    rows = sorted(tuple(r) for r in licenses.summary(licenses.scan(docs)).select(F.coalesce("doc_id", F.lit(0)), "n_words", "n_base", "labels").collect())
    assert rows == [(0, 0, 0, ""), (0, 1, 0, ""), (1, 5, 1, "mit"), (1, 5, 1, "mit")]
    assert licenses.scan(docs.limit(0)).collect() == []


def test_query_matches_sql(spark, tmp_path):
    rng = random.Random(9)
    texts = [None, ""] + [" ".join(rng.choices(LINES, k=3)) for _ in range(40)]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    ours = queries.QUERIES["op12_license_rules"](spark, str(tmp_path)).toArrow()
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    theirs = db.sql(queries.SQL["op12_license_rules"]).to_arrow_table()
    key = lambda rows: sorted(repr(sorted(r.items())) for r in rows.to_pylist())
    assert key(ours) == key(theirs)
