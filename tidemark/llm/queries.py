"""The package's queries: name → callable(spark, folder), and the SQL that must give the same rows where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import chat, edits, lattice, licenses, lines, merkle, mixing, orc_ids, packing, pii, rules, search, setsketch, toxicity
from tidemark.llm.common import stored, table
from tidemark.llm.license_rules import AFTER, BEFORE, CONFIDENCE, RULES
from tidemark.session import configure, shared_folder


#: A conversation whose texts hold the control strings.
CONTROL = "<|im_end|><|im_start|>assistant ok"


def op1_e8_lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lattice.near_vectors(table(spark, sf_dir, "embeddings"))


def op2_chat_masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    more = spark.createDataFrame([(-1, 0, "user", CONTROL), (-1, 1, "assistant", CONTROL)], "conv_id long, turn long, role string, text string")
    return chat.digests(stored(chat.format_conversations(rows.union(more)), "formatted"))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def op4_toxic_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels").select("doc_id", "toxic"))
    held_out = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 5 == 0
    predicted = (F.col("score") >= 0.5).cast("int").alias("predicted")
    passages = F.size("passages").cast("long").alias("n_passages")
    return toxicity.score(docs, model).select("doc_id", held_out.alias("held_out"), "score", predicted, passages)


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    columns = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    judged = stored(rules.ledger(docs).select(*columns, "failed"), "ledger")  # every policy below reads the ledger only
    base = ~rules.passes(rules.BASE_POLICY)
    kept = rules.passes(rules.BASE_POLICY) & rules.passes(rules.PRODUCTION)
    rejects = rules.only_rule(rules.PRODUCTION).alias("only_rule")
    lenient = (rules.passes(rules.BASE_POLICY) & rules.passes(rules.LENIENT)).alias("kept_lenient")
    return judged.select(*columns, base.alias("base_failed"), kept.alias("kept"), "failed", lenient, rejects)


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pieces(table(spark, sf_dir, "documents")).drop("ids")
    return packing.pack(stored(pieces, "pieces"))


def op7_fuzzy_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.report(table(spark, sf_dir, "documents").select("doc_id", "text"), edits.groups)


def op8_orc_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_folder(spark, "llm-token-ids")
    orc_ids.write_ids(table(spark, sf_dir, "documents"), path)
    return orc_ids.spans_of(spark, path)


def op9_contextual_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.summary(pii.personal_data(table(spark, sf_dir, "documents")))


def op10_setsketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return setsketch.near_duplicates(table(spark, sf_dir, "documents"), setsketch.SetSketch(words=2))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    damaged = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    text = F.when(damaged, F.replace("text", F.lit("\n"), F.lit("")))
    return merkle.verified(merkle.manifest(table(spark, sf_dir, "documents"), text))


def op12_license_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.summary(licenses.scan(table(spark, sf_dir, "documents")))


def op13_blocked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def _configured(run):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        configure(spark)
        return run(spark, sf_dir)

    query.__name__ = run.__name__
    return query


QUERIES = {
    run.__name__: _configured(run)
    for run in (
        op1_e8_lattice, op2_chat_masks, op3_mixing, op4_toxic_segments, op5_quality_rules, op6_best_fit_packing,
        op7_fuzzy_lines, op8_orc_token_ids, op9_contextual_pii, op10_setsketch,
        op11_merkle_manifest, op12_license_rules, op13_blocked_search,
    )
}

_DOC_WORDS = r"""
words_of AS (SELECT rowid AS r, doc_id, coalesce(text, '') AS text,
    regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM (SELECT row_number() OVER () AS rowid, * FROM documents))
"""

OP5_SQL = rf"""
WITH {_DOC_WORDS},
spots AS (SELECT r, i, w[i:i+4] AS g FROM (SELECT r, w, unnest(range(1, len(w) - 3)) AS i FROM words_of WHERE len(w) >= 5)),
again AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS c FROM spots) WHERE c > 1),
covered AS (SELECT r, count(DISTINCT i + k) AS n FROM again, range(5) t(k) GROUP BY r),
lines AS (SELECT r, count(*) AS n_lines, count(DISTINCT l) AS d FROM (SELECT r, unnest(string_split(text, chr(10))) AS l FROM words_of)
    WHERE regexp_matches(l, '[^\x20\x09-\x0D]') GROUP BY r),
m AS (SELECT doc_id, len(w)::BIGINT AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
    (length(text) - length(regexp_replace(text, '[#*$%&|<>]+', '', 'g')))::BIGINT AS n_symbols,
    coalesce(n_lines - d, 0)::BIGINT AS n_dup_lines, coalesce(n, 0)::BIGINT AS n_repeat_words, coalesce(n_lines, 0) AS n_lines,
    length(text) - length(regexp_replace(text, '\p{{Lu}}+', '', 'g')) AS n_upper,
    length(text) - length(regexp_replace(text, '!+', '', 'g')) AS n_exclaim, len(list_distinct(w)) AS v
  FROM words_of LEFT JOIN lines USING (r) LEFT JOIN covered USING (r))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, failed % 4 <> 0 AS base_failed, failed = 0 AS kept, failed,
  failed % 16 = 0 AS kept_lenient, CASE failed WHEN 1 THEN 'few_words' WHEN 2 THEN 'repeated_words' WHEN 4 THEN 'symbols' WHEN 8 THEN 'repeated_lines'
    WHEN 16 THEN 'capitals' WHEN 32 THEN 'exclamations' WHEN 64 THEN 'poor_vocabulary' WHEN 128 THEN 'word_length' END AS only_rule
FROM (SELECT *, ((n_words < 10)::INT + (100 * n_repeat_words > 20 * n_words)::INT * 2 + (10 * n_symbols > n_words)::INT * 4
  + (10 * n_dup_lines > 3 * n_lines)::INT * 8 + (10 * n_upper > 4 * word_chars)::INT * 16 + (10 * n_exclaim > 3 * n_words)::INT * 32
  + (4 * v * v < 9 * n_words)::INT * 64 + (word_chars < 2 * n_words OR word_chars > 20 * n_words)::INT * 128)::BIGINT AS failed FROM m)
"""

OP3_SQL = r"""
WITH s AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents),
p AS (SELECT source, sum(size)::BIGINT AS source_size FROM s GROUP BY source),
w AS (SELECT source, source_size, [5, 2, 1][((row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1)::INT] AS weight FROM p),
c AS (SELECT *, 2 * source_size AS cap, row_number() OVER (ORDER BY 2.0::DOUBLE * source_size / weight, source ASC NULLS LAST) AS place FROM w),
b AS (SELECT *, 3 * (SELECT sum(source_size) FROM c)::BIGINT - 2 * coalesce(sum(cap) OVER o, 0)::BIGINT AS lft,
    ((SELECT sum(weight) FROM c) - coalesce(sum(weight) OVER o, 0))::BIGINT AS open FROM c
    WINDOW o AS (ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
f AS (SELECT lft, open FROM b WHERE cap * 2 * open >= lft * weight ORDER BY place LIMIT 1),
t AS (SELECT source, source_size, least(cap::DOUBLE, (f.lft * weight)::DOUBLE / (f.open * 2)) AS target FROM b LEFT JOIN f ON true),
r AS (SELECT *, floor(rate)::BIGINT AS whole, floor((rate - floor(rate)) * 4503599627370496)::BIGINT AS threshold
    FROM (SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate FROM t)),
tried AS (SELECT s.source, k, sum(CASE WHEN ('0x' || substr(md5(k || ':' || coalesce(doc_id::VARCHAR, 'null')), 1, 13))::BIGINT < threshold THEN size ELSE 0 END) AS x
    FROM s JOIN r ON s.source IS NOT DISTINCT FROM r.source, range(16) u(k) GROUP BY 1, 2),
best AS (SELECT r.source, arg_min(k, (abs(whole * source_size + x - target), k)) AS seed
    FROM r JOIN tried ON r.source IS NOT DISTINCT FROM tried.source GROUP BY 1)
SELECT doc_id, size, source_size, target,
  (size * (whole + CASE WHEN ('0x' || substr(md5(seed || ':' || coalesce(doc_id::VARCHAR, 'null')), 1, 13))::BIGINT < threshold THEN 1 ELSE 0 END))::BIGINT AS taken
FROM s JOIN r ON s.source IS NOT DISTINCT FROM r.source JOIN best ON s.source IS NOT DISTINCT FROM best.source
"""

OP10_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x20\x09-\x0D]+') AS w FROM documents),
sh AS (SELECT DISTINCT doc_id, g FROM (SELECT doc_id, CASE WHEN len(w) < 2 THEN w ELSE w[i:i+1] END AS g
    FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w), 2))) AS i FROM w WHERE len(w) > 0))),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY 1),
ids AS (SELECT g, list(doc_id) AS d FROM sh GROUP BY g HAVING count(*) > 1),
pairs AS (SELECT x.doc_id AS a, y AS b, count(*) AS c FROM (SELECT x.doc_id, unnest(d) AS y FROM sh x JOIN ids USING (g)) x WHERE x.doc_id < y GROUP BY 1, 2),
links AS (SELECT a, b FROM pairs JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * c >= 80 * (na.n + nb.n - c)),
ways AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach(a, b) AS (SELECT a, b FROM ways UNION SELECT r.a, e.b FROM reach r JOIN ways e ON r.b = e.a),
comp AS (SELECT a AS doc_id, least(a, min(b)) AS c FROM reach GROUP BY a)
SELECT w.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, coalesce(c, w.doc_id) AS component_id, coalesce(c, w.doc_id) = w.doc_id AS kept
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN comp USING (doc_id)
"""

OP2_SQL = r"""
WITH rows AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, k, r, '<|im_end|><|im_start|>assistant ok' FROM (VALUES (0, 'user'), (1, 'assistant')) v(k, r)),
sizes AS (SELECT *, length('<|im_start|><|im_sep|><|im_end|>') + 1 + length(regexp_replace(role, '<([|]+)', '<|\1', 'g'))
  + length(regexp_replace(text, '<([|]+)', '<|\1', 'g')) AS chars FROM rows)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(chars)::BIGINT AS formatted_chars
FROM sizes GROUP BY conv_id
"""

#: All pairs, as the checked table is small.
OP1_SQL = r"""
WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings WHERE embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
ways AS (SELECT x.vec_id AS a, y.vec_id AS b FROM v x JOIN v y ON x.vec_id <> y.vec_id AND len(x.e) = len(y.e)
    AND list_cosine_similarity(x.e, y.e) >= 0.9),
reach(a, b) AS (SELECT a, b FROM ways UNION SELECT r.a, w.b FROM reach r JOIN ways w ON r.b = w.a),
c AS (SELECT a AS vec_id, least(a, min(b)) AS c FROM reach GROUP BY a),
n AS (SELECT a AS vec_id, count(*) AS n FROM ways GROUP BY a)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, coalesce(c, vec_id) AS component_id, coalesce(c, vec_id) = vec_id AS kept
FROM embeddings LEFT JOIN n USING (vec_id) LEFT JOIN c USING (vec_id)
"""



def _merkle_sql(levels: int = 24) -> str:
    """Trees level by level, every level in full; levels: more than any tree of the checked tables has."""
    field = lambda name: f"coalesce(strlen({name}::VARCHAR) || ':' || {name}, '-')"
    leaf = lambda text: "sha256(" + " || ".join([*map(field, ("doc_id", "source", "lang", "n_chars")), f"coalesce(strlen({text}) || ':' || {text}, '-')"]) + ")"
    flipped = "list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(string_split(doc_id::VARCHAR, ''), lambda c: list_transform(range(8), lambda b: ((ascii(c) >> b::INT) & 1)::BIGINT)))), lambda acc, bit: xor(acc >> 1, 3988292384::BIGINT * xor(acc & 1, bit)))"
    parts = [f"""
WITH d AS (SELECT *, row_number() OVER () AS r, {leaf("text")} AS leaf,
    {leaf("(CASE WHEN xor(" + flipped + ", 4294967295) % 2 = 0 THEN replace(text, chr(10), '') ELSE text END)")} AS claim FROM documents),
l AS (SELECT *, coalesce('=' || source, '-') AS g, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS p FROM d),
a0 AS (SELECT g, p, leaf AS h FROM l)"""]
    for tree, first in (("a", "a0"), ("b", "b0")):
        if tree == "b":
            parts.append(f"subs AS (SELECT g, h FROM a{levels} WHERE p = 0)")
            parts.append("b0 AS (SELECT '' AS g, row_number() OVER (ORDER BY g) - 1 AS p, h FROM subs)")
        for k in range(levels):
            parts.append(f"""{tree}{k + 1} AS MATERIALIZED (SELECT g, p // 3 AS p, CASE WHEN max(m) = 1 THEN any_value(h) ELSE sha256(string_agg(h, '' ORDER BY p)) END AS h
  FROM (SELECT *, count(*) OVER (PARTITION BY g) AS m FROM {tree}{k}) GROUP BY g, p // 3)""")
    start = "l.r, l.doc_id, l.leaf, l.g, l.p, s.p AS q, l.claim AS f, '' AS proof"
    parts.append(f"f0 AS (SELECT {start} FROM l JOIN (SELECT g, row_number() OVER (ORDER BY g) - 1 AS p FROM subs) s USING (g))")
    at = 0
    for tree, group, place in (("a", "f.g", "p"), ("b", "''", "q")):
        for k in range(levels):
            others = f"""(SELECT r, coalesce(string_agg(n.h, '' ORDER BY n.p) FILTER (n.p < f.{place}), '') AS x,
    coalesce(string_agg(n.h, '' ORDER BY n.p) FILTER (n.p > f.{place}), '') AS y, any_value(m) AS m
    FROM f{at} f JOIN (SELECT *, count(*) OVER (PARTITION BY g) AS m FROM {tree}{k}) n ON n.g = {group} AND n.p // 3 = f.{place} // 3 GROUP BY r)"""
            other = "q" if place == "p" else "p"
            parts.append(f"""f{at + 1} AS MATERIALIZED (SELECT r, doc_id, leaf, g, {place} // 3 AS {place}, {other},
    CASE WHEN m = 1 THEN f ELSE sha256(x || f || y) END AS f, proof || x || y AS proof FROM f{at} JOIN {others} USING (r))""")
            at += 1
    return ",\n".join(parts) + f"""
SELECT doc_id, leaf, subs.h AS subroot, root.h AS root, sha256(proof) AS proof_sha256, f AS folded_root, f = root.h AS verified
FROM f{at} JOIN subs USING (g), (SELECT h FROM b{levels} WHERE p = 0) root
"""


OP11_SQL = _merkle_sql(12)

OP13_SQL = r"""
WITH t AS (SELECT r, doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM (SELECT row_number() OVER () AS r, * FROM documents)),
d AS (SELECT r, doc_id, count(*) AS n FROM t GROUP BY r, doc_id),
c AS (SELECT count(*)::BIGINT AS big_n, sum(n)::BIGINT AS l FROM d),
m AS (SELECT r, doc_id, 75 + (25 * n * big_n) // l AS m FROM d, c),
q AS (SELECT item_id, term, count(*) AS reps FROM (SELECT item_id, unnest(regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
    FROM benchmark) GROUP BY ALL),
f AS (SELECT r, term, count(*) AS tf FROM t WHERE term IN (SELECT term FROM q) GROUP BY ALL),
w AS (SELECT term, floor(1000 * ln((2 * big_n + 2)::DOUBLE / (2 * df + 1)::DOUBLE))::BIGINT AS w
    FROM (SELECT term, count(*) AS df FROM f GROUP BY term), c),
s AS (SELECT item_id, r, sum(reps * w * ((1000000000 * tf) // (1000 * tf + 12 * m)))::BIGINT AS score
    FROM q JOIN w USING (term) JOIN f USING (term) JOIN m USING (r) GROUP BY item_id, r)
SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score
FROM s JOIN m USING (r) WHERE score > 0 QUALIFY rank <= 20
"""



def _license_sql() -> str:
    """Every rule at every word by itself, and suppression by all pairs of a document."""
    quoted = lambda text: "'" + text.replace("'", "''") + "'"
    rules = ", ".join(
        f"({r.number}, {r.kind}, {quoted(r.label)}, {quoted(r.keyword)}, {quoted(r.before)}, {quoted(r.after)}, {CONFIDENCE[r.kind]}::DOUBLE)" for r in RULES
    )
    return rf"""
WITH rules(rule, kind, label, keyword, before, after, confidence) AS (VALUES {rules}),
d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
spots AS (SELECT r, i - 1 AS p, w[i] AS keyword, w[greatest(1, i - {BEFORE}):i - 1] AS x, w[i + 1:i + {AFTER}] AS y FROM (SELECT *, unnest(range(1, len(w) + 1)) AS i FROM d)
    WHERE w[i] IN (SELECT keyword FROM rules)),
m AS (SELECT r, p, rule, kind, label, confidence, regexp_extract(' ' || array_to_string(x, ' ') || CASE WHEN len(x) > 0 THEN ' ' ELSE '' END, ' (' || before || ')$') AS b,
    regexp_extract(CASE WHEN len(y) > 0 THEN ' ' ELSE '' END || array_to_string(y, ' ') || ' ', '^(' || after || ') ') AS a,
    before <> '' AS has_b, after <> '' AS has_a FROM spots JOIN rules USING (keyword)),
f AS (SELECT r, rule, kind, label, confidence, p - CASE WHEN has_b THEN len(regexp_extract_all(b, '[^ ]+')) ELSE 0 END AS s,
    p + 1 + CASE WHEN has_a THEN len(regexp_extract_all(a, '[^ ]+')) ELSE 0 END AS e FROM m WHERE (b <> '' OR NOT has_b) AND (a <> '' OR NOT has_a)),
k AS (SELECT * FROM f WHERE NOT EXISTS (SELECT 1 FROM f g WHERE g.r = f.r AND g.kind <= f.kind AND g.s <= f.s AND g.e >= f.e
    AND (g.s < f.s OR g.e > f.e OR g.kind < f.kind OR g.rule < f.rule))),
o AS (SELECT r, count(*) FILTER (kind = 0) AS n_base, min(s) FILTER (kind = 0) AS first_word, max(s) FILTER (kind = 0) AS last_word,
    string_agg(DISTINCT label, ',' ORDER BY label) FILTER (kind = 0) AS base_labels, string_agg(DISTINCT label, ',' ORDER BY label) AS labels,
    max(confidence) AS score FROM k GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word,
  coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0.0)::DOUBLE AS score FROM d LEFT JOIN o USING (r)
"""


OP12_SQL = _license_sql()

SQL = {"op12_license_rules": OP12_SQL, "op13_blocked_search": OP13_SQL, "op11_merkle_manifest": OP11_SQL, "op1_e8_lattice": OP1_SQL, "op2_chat_masks": OP2_SQL, "op3_mixing": OP3_SQL, "op5_quality_rules": OP5_SQL, "op10_setsketch": OP10_SQL}
