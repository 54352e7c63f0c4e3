"""Headline, event and alert queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions.lookups import (
    CLASSIFIER_VERSION,
    EIGHT_K_TITLES,
    EIGHT_K_TYPES,
    EVENT_TYPES,
    HEADLINE_RULES,
    STOP_WORDS,
)
from tidemark.operators import events as N
from tidemark.plans.base import big, q, qc, query
from tidemark.sources.views import Tables

# Phrases put into headlines so that every rule is exercised.
PHRASES = (
    "files for Chapter 11", "restated its accounts", "hit by a data breach", "to acquire a rival",
    "posts Q3 results", "cuts its outlook", "chief resigns", "raises dividend", "plans bond offering",
    "faces antitrust probe", "upgraded by broker to buy", "unveils a device", "in the news",
)
_PHRASE_SQL = "[" + ", ".join(f"'{p}'" for p in PHRASES) + "]"
_HEADLINES = f"""headlines AS (SELECT *, CASE news_id % 5 WHEN 0 THEN 'Acme (NYSE: TK' || company || ') '
        WHEN 1 THEN 'Traders like $TK' || company || ' as it ' WHEN 2 THEN 'TK' || company || ' '
        WHEN 3 THEN 'Firm ' || company || '''s board ' ELSE 'A company ' END
        || {_PHRASE_SQL}[news_id % 13 + 1] || ' ' || title AS headline FROM v_news)"""
_TYPE_SQL = "CASE " + " ".join(
    f"WHEN regexp_matches(headline, '{p}', 'i') THEN '{k}'" for k, p in HEADLINE_RULES
) + " ELSE 'other' END"
_MATCH_SQL = "CASE " + " ".join(
    f"WHEN regexp_matches(headline, '{p}', 'i') THEN regexp_extract(headline, '{p}', 0, 'i')" for _, p in HEADLINE_RULES
) + " END"


def _headlines(t: Tables):
    c = F.col("company").cast("string")
    part = F.col("news_id") % 5
    lead = (
        F.when(part == 0, F.concat(F.lit("Acme (NYSE: TK"), c, F.lit(") ")))
        .when(part == 1, F.concat(F.lit("Traders like $TK"), c, F.lit(" as it ")))
        .when(part == 2, F.concat(F.lit("TK"), c, F.lit(" ")))
        .when(part == 3, F.concat(F.lit("Firm "), c, F.lit("'s board ")))
        .otherwise("A company ")
    )
    phrase = F.element_at(F.array(*[F.lit(p) for p in PHRASES]), (F.col("news_id") % 13 + 1).cast("int"))
    return t.news().withColumn("headline", F.concat(lead, phrase, F.lit(" "), "title"))


_STRIP = f"regexp_replace(regexp_replace(legal, '{N.ALL_ENDINGS}', ''), '^[ ,.]+|[ ,.]+$', '', 'g')"


@query(
    "short_name",
    rf"""WITH n AS (SELECT c_custkey AS company, upper(c_mktsegment) || CASE c_custkey % 6
            WHEN 0 THEN ' HOLDINGS, INC.' WHEN 1 THEN ' Co., Ltd.' WHEN 2 THEN ' & Company'
            WHEN 3 THEN ' Group plc' WHEN 4 THEN ' CORP /DE' ELSE ' Holdings Group Co. Ltd., Inc. Corp, plc' END AS legal FROM customer),
        r AS (SELECT company, {_STRIP} AS name FROM n)
        SELECT company, CASE WHEN name = upper(name) AND name <> lower(name) THEN array_to_string(
            list_transform(string_split(name, ' '), lambda w: CASE WHEN length(w) <= 3 THEN w
            ELSE upper(w[1]) || lower(w[2:]) END), ' ') ELSE name END AS name FROM r""",
)
def short_name(t: Tables):
    part = F.col("c_custkey") % 6
    ending = (
        F.when(part == 0, " HOLDINGS, INC.").when(part == 1, " Co., Ltd.").when(part == 2, " & Company")
        .when(part == 3, " Group plc").when(part == 4, " CORP /DE").otherwise(" Holdings Group Co. Ltd., Inc. Corp, plc")
    )
    legal = F.concat(F.upper("c_mktsegment"), ending)
    return t.customer.select(F.col("c_custkey").alias("company"), N.short_name(legal).alias("name"))


@query(
    "mention",
    rf"""WITH {_HEADLINES}, n AS (SELECT news_id, headline, 'TK' || company AS tk,
            'Firm ' || company AS nm FROM headlines)
        SELECT news_id, CASE WHEN regexp_matches(headline, '\((?:(?:nyse|nasdaq|nyse american|amex|otc)\s*:\s*)?'
                || tk || '\)', 'i') OR regexp_matches(headline, '\$' || tk || '\b')
            OR (length(tk) >= 3 AND regexp_matches(headline, '\b' || tk || '\b')) THEN 'title_ticker'
            WHEN regexp_matches(headline, '\b' || nm || '(?:''s)?\b', 'i') THEN 'title_name'
            ELSE 'query_only' END AS method FROM n""",
)
def mention(t: Tables):
    c = F.col("company").cast("string")
    name, tickers = F.concat(F.lit("Firm "), c), F.array(F.concat(F.lit("NO.NE"), c), F.concat(F.lit("TK"), c))
    return _headlines(t).select("news_id", N.mention(F.col("headline"), name, tickers).alias("method"))


@query(
    "classify_headline",
    f"WITH {_HEADLINES} SELECT news_id, {_TYPE_SQL} AS event_type, {_MATCH_SQL} AS matched FROM headlines",
)
def classify_headline(t: Tables):
    return _headlines(t).select("news_id", N.decided(F.col("headline")).alias("d")).select("news_id", "d.event_type", "d.matched")


_ITEMS = """reports AS (SELECT company, accession, form, filed_date, CASE accession % 6
    WHEN 0 THEN ['2.02', '9.01'] WHEN 1 THEN ['8.01', '1.03'] WHEN 2 THEN ['5.02', '1.01', '9.01']
    WHEN 3 THEN ['9.01'] WHEN 4 THEN ['7.01', '4.02'] ELSE ['6.01', '2.05'] END AS items
    FROM v_filings)"""


def _reports(t: Tables):
    lists = (["2.02", "9.01"], ["8.01", "1.03"], ["5.02", "1.01", "9.01"], ["9.01"], ["7.01", "4.02"], ["6.01", "2.05"])
    items = F.element_at(
        F.array(*[F.array(*[F.lit(i) for i in x]) for x in lists]), (F.col("accession") % 6 + 1).cast("int")
    )
    return t.filings().withColumn("items", items).withColumn(
        "accepted_at", F.lit(None).cast("timestamp")
    ).withColumn("is_earnings", F.array_contains("items", "2.02"))


_PLACE = ", ".join(f"('{i}', '{k}', {EVENT_TYPES.index(k)})" for i, k in EIGHT_K_TYPES.items())
_FILING_TYPE = f"""kinds(item, kind, place) AS (VALUES {_PLACE}),
    typed AS (SELECT accession, arg_min(kind, place) AS kind FROM (SELECT accession,
        unnest(items) AS item FROM reports) JOIN kinds USING (item) GROUP BY 1)"""


@query(
    "classify_8k",
    f"""WITH {_ITEMS}, {_FILING_TYPE} SELECT accession, coalesce(kind, 'disclosure') AS event_type
        FROM reports LEFT JOIN typed USING (accession)""",
)
def classify_8k(t: Tables):
    return _reports(t).select("accession", N.filing_type(F.col("items")).alias("event_type"))


_TITLES = ", ".join("('{}', '{}')".format(i, n.replace("'", "''")) for i, n in EIGHT_K_TITLES.items())


@query(
    "filing_events",
    f"""WITH {_ITEMS}, {_FILING_TYPE}, titles(item, name) AS (VALUES {_TITLES}),
        d AS (SELECT accession, string_agg(item || ' ' || name, '; ' ORDER BY pos) AS text FROM (
            SELECT accession, unnest(items) AS item, unnest(range(len(items))) AS pos FROM reports)
            JOIN titles USING (item) WHERE item <> '9.01' GROUP BY 1)
        SELECT company, accession, coalesce(kind, 'disclosure') AS event_type,
            form || ': ' || coalesce(text, 'Current report') AS title, filed_date AS occurred_on
        FROM reports LEFT JOIN typed USING (accession) LEFT JOIN d USING (accession)
        WHERE form = '8-K' AND accession % 10 <> 0""",
)
def filing_events(t: Tables):
    done = t.orders.where("o_orderkey % 10 = 0").select(F.col("o_orderkey").alias("accession"))
    return N.filing_events(_reports(t), done).select(
        "company", "accession", "event_type", "title", F.to_date("occurred_at").alias("occurred_on")
    )


_STOP_SQL = "[" + ", ".join(f"'{w}'" for w in STOP_WORDS) + "]"
_WORDS = f"""worded AS (SELECT *, list_sort(list_distinct(list_filter(regexp_extract_all(lower(title),
    '[a-z0-9]+'), lambda w: length(w) > 1 AND NOT list_contains({_STOP_SQL}, w)))) AS words FROM v_news)"""
_SHARE = "len(list_intersect(a.words, b.words))"


@query(
    "overlap",
    f"""WITH {_WORDS}, d AS (SELECT doc_id, any_value(words) AS words FROM worded GROUP BY 1)
        SELECT a.doc_id, {q(f'''CASE WHEN len(a.words) > 0 AND len(b.words) > 0 THEN
            {_SHARE} / (len(a.words) + len(b.words) - {_SHARE}) ELSE 0 END''')} AS overlap
        FROM d a JOIN d b ON b.doc_id = a.doc_id + 1""",
)
def overlap(t: Tables):
    docs = t.documents.select("doc_id", N.story_words(F.substring_index("text", "\n", 1)).alias("words"))
    used = docs.join(t.news().select("doc_id").distinct(), "doc_id", "left_semi")
    after = used.select((F.col("doc_id") - 1).alias("doc_id"), F.col("words").alias("next"))
    return used.join(after, "doc_id").select("doc_id", qc(N.jaccard(F.col("words"), F.col("next")), "overlap"))


# Overlaps are those of the documents behind the headlines, so they are counted once per pair of documents, over shared words.
_NOVELTY = f"""{_WORDS}, docs AS (SELECT doc_id, any_value(words) AS words FROM worded WHERE len(words) > 0 GROUP BY 1),
    tok AS (SELECT doc_id, len(words) AS n, unnest(words) AS w FROM docs),
    near AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) / (any_value(a.n) + any_value(b.n) - count(*)) AS score
        FROM tok a JOIN tok b USING (w) GROUP BY 1, 2 HAVING score >= 0.5),
    news AS (SELECT * REPLACE (company % 5 AS company) FROM v_news),
    best AS (SELECT a.news_id, max(row(score, -b.news_id)) AS b FROM news a JOIN near ON a.doc_id = x
        JOIN news b ON b.doc_id = y AND a.company = b.company AND b.seen_us < a.seen_us
        AND b.seen_us >= a.seen_us - 259200000000 GROUP BY 1),
    judged AS (SELECT n.news_id, n.company, n.domain, n.seen_us, b[1] AS similarity, -b[2] AS prior,
        CASE WHEN b IS NULL THEN 'first' ELSE 'repeat' END AS novelty
        FROM news n LEFT JOIN best USING (news_id))"""


def _user_news(t: Tables):
    """Headlines with fewer companies, so that stories repeat."""
    return t.news().withColumn("company", F.col("company") % 5)


# Headlines about documents with a vector are compared by vectors of one model, the others by words.
_BOTH = _NOVELTY[: _NOVELTY.index("judged AS")].replace(
    "docs AS (SELECT doc_id, any_value(words) AS words FROM worded WHERE len(words) > 0 GROUP BY 1)",
    """v AS (SELECT vec_id AS doc_id, label % 2 AS model, embedding::DOUBLE[] AS e FROM embeddings),
    docs AS (SELECT doc_id, any_value(words) AS words FROM worded WHERE len(words) > 0 AND doc_id NOT IN (SELECT doc_id FROM v) GROUP BY 1)""",
) + """vnear AS (SELECT a.doc_id AS x, b.doc_id AS y, round(list_cosine_similarity(a.e, b.e), 9) AS score FROM v a JOIN v b USING (model)),
    vbest AS (SELECT a.news_id, max(row(score, -b.news_id)) AS b FROM news a JOIN vnear ON a.doc_id = x
        JOIN news b ON b.doc_id = y AND a.company = b.company AND b.seen_us < a.seen_us
        AND b.seen_us >= a.seen_us - 259200000000 GROUP BY 1),
    judged AS (SELECT n.news_id, coalesce(w.b[1], u.b[1]) AS similarity, CASE WHEN w.b IS NULL OR w.b[1] >= 0.82 THEN -coalesce(w.b, u.b)[2] END AS prior
        FROM news n LEFT JOIN vbest w USING (news_id) LEFT JOIN best u USING (news_id))"""


@query(
    "novelty",
    f"""WITH {_BOTH} SELECT news_id, {q('similarity')} AS similarity, prior,
        CASE WHEN prior IS NULL THEN 'first' ELSE 'repeat' END AS novelty FROM judged""",
)
def novelty(t: Tables):
    model = (F.col("label") % 2).cast("string")
    vectors = t.embeddings.select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("vector"), model.alias("model"))
    return N.novelty(_user_news(t).join(vectors, "doc_id", "left")).select("news_id", qc("similarity"), "prior", "novelty")


_CLUSTERS = f"""WITH RECURSIVE {_NOVELTY}, chain AS (SELECT news_id, news_id AS cluster_id FROM judged
        WHERE prior IS NULL UNION ALL SELECT j.news_id, c.cluster_id FROM judged j
        JOIN chain c ON j.prior = c.news_id)"""


@query("story_cluster", f"{_CLUSTERS} SELECT news_id, cluster_id FROM chain")
def story_cluster(t: Tables):
    return N.story_clusters(N.novelty(_user_news(t)))


@query(
    "clusters",
    f"""{_CLUSTERS} SELECT cluster_id, count(*) AS size, count(DISTINCT domain) AS outlets
        FROM chain JOIN judged USING (news_id) GROUP BY 1""",
)
def clusters(t: Tables):
    return N.cluster_sizes(N.story_clusters(N.novelty(_user_news(t))), t.news())


@query(
    "news_dedupe",
    """SELECT 'wire' AS provider, sha256('http://example.com/' || doc_id) AS url_sha256,
        arg_min(news_id, row(seen_us, news_id)) AS news_id FROM v_news GROUP BY doc_id""",
)
def news_dedupe(t: Tables):
    url = F.concat(F.lit("http://example.com/"), F.col("doc_id").cast("string"))
    rows = t.news().select("news_id", "seen_us", url.alias("url"), F.lit("wire").alias("provider"))
    return N.dedupe(rows).select("provider", "url_sha256", "news_id")


@query(
    "reclassify",
    f"""WITH {_HEADLINES} SELECT news_id, CASE WHEN news_id % 3 = 0 THEN {_TYPE_SQL} ELSE 'kept' END
        AS event_type, '{CLASSIFIER_VERSION}' AS version FROM headlines""",
)
def reclassify(t: Tables):
    version = F.when(F.col("news_id") % 3 == 0, "old").otherwise(CLASSIFIER_VERSION)
    events = _headlines(t).select(
        "news_id", F.col("headline").alias("title"), F.lit("kept").alias("event_type"), version.alias("version")
    )
    return N.reclassify(events).select("news_id", "event_type", "version")


def _events(t: Tables):
    return _headlines(t).select(
        "news_id", "company", N.headline_type(F.col("headline")).alias("event_type"),
        F.when(F.col("news_id") % 4 == 0, "repeat").otherwise("first").alias("novelty"),
        F.col("headline").alias("title"), F.col("seen_at").cast("timestamp").alias("occurred_at"),
    )


@query(
    "timeline",
    f"""WITH {_HEADLINES}, e AS (SELECT news_id, {_TYPE_SQL} AS event_type, news_id % 4 = 0 AS rep,
            seen_us FROM headlines WHERE seen_at >= TIMESTAMP '2024-01-10 00:00:00')
        SELECT news_id, event_type, (SELECT count(*) FROM e x WHERE NOT x.rep AND
            x.event_type = e.event_type) AS type_count, (SELECT count(*) FROM e WHERE rep) AS hidden
        FROM e WHERE NOT rep ORDER BY seen_us DESC, news_id DESC LIMIT 100""",
)
def timeline(t: Tables):
    return N.timeline(_events(t), "2024-01-10 00:00:00", 100).select(
        "news_id", "event_type", "type_count", "hidden"
    )


@query(
    "news",
    f"""WITH {_HEADLINES} SELECT news_id, company, (SELECT count(*) FROM headlines WHERE news_id % 5 = 4) AS hidden
        FROM headlines WHERE news_id % 5 <> 4 ORDER BY seen_us DESC, news_id DESC LIMIT 100""",
)
def news(t: Tables):
    c = F.col("company").cast("string")
    method = N.mention(F.col("headline"), F.concat(F.lit("Firm "), c), F.array(F.concat(F.lit("TK"), c)))
    return N.news_page(_headlines(t).withColumn("method", method), 100).select("news_id", "company", "hidden")


@query(
    "feed",
    f"""WITH {_HEADLINES} SELECT news_id, company, substr(headline, 1, 40) AS excerpt FROM headlines
        WHERE company IN (SELECT c_custkey FROM customer WHERE c_custkey % 7 = 0)
        ORDER BY seen_us DESC, news_id DESC LIMIT 100""",
)
def feed(t: Tables):
    watched = t.customer.where("c_custkey % 7 = 0").select(F.col("c_custkey").alias("company"))
    return N.feed(_events(t), watched, 100).select("news_id", "company", "excerpt")


@query(
    "earnings",
    f"""WITH {_ITEMS} SELECT company, accession, filed_date FROM reports WHERE form = '8-K'
        AND list_contains(items, '2.02') ORDER BY filed_date DESC, accession DESC LIMIT 100""",
)
def earnings(t: Tables):
    rows = _reports(t).where((F.col("form") == "8-K") & F.col("is_earnings"))
    return rows.orderBy(F.desc("filed_date"), F.desc("accession")).limit(100).select(
        "company", "accession", "filed_date"
    )


# --- Alerts -------------------------------------------------------------------------------

KINDS = ("filing", "earnings", "news", "insider", "price")
_RULES = """rules AS (SELECT s_suppkey AS rule_id, s_name AS name,
        ['filing', 'earnings', 'news', 'insider', 'price'][s_suppkey % 5 + 1] AS kind,
        s_suppkey * 3 % 200 AS tick, CASE WHEN s_suppkey % 2 = 0 THEN s_suppkey % 10 END AS watchlist_id
        FROM supplier),
    scope AS (SELECT rule_id, company FROM rules JOIN (SELECT DISTINCT ticker, company
            FROM v_securities WHERE is_active) s ON s.ticker = 'SMA' || (tick % 50)
        UNION SELECT rule_id, c_custkey FROM rules JOIN customer ON c_custkey % 100 = watchlist_id)"""


def _rules(t: Tables):
    key = F.col("s_suppkey")
    ticker = F.concat(F.lit("SMA"), (key * 3 % 200 % 50).cast("string"))
    kind = F.element_at(F.array(*[F.lit(k) for k in KINDS]), (key % 5 + 1).cast("int"))
    return t.supplier.select(
        key.alias("rule_id"), F.col("s_name").alias("name"), kind.alias("kind"), F.array(ticker).alias("tickers"),
        F.when(key % 2 == 0, key % 10).alias("watchlist_id"), F.lit(300.0).alias("min_value"),
        F.lit(0.05).alias("min_move"), F.lit("1995-01-01").cast("date").alias("since"),
    )


def _scope(t: Tables, of=N.watch):
    lists = t.customer.select((F.col("c_custkey") % 100).alias("watchlist_id"), F.col("c_custkey").alias("company"))
    return of(_rules(t), t.securities().select("ticker", "company", "is_active"), lists)


@query("alert_scope", f"WITH {_RULES} SELECT * FROM scope")
def alert_scope(t: Tables):
    return _scope(t, N.alert_scope)


_CANDIDATES = f"""{_RULES}, {_ITEMS}, sr AS (SELECT * FROM scope JOIN rules USING (rule_id)),
    closes AS (SELECT l_partkey AS company, CAST(l_shipdate AS DATE) AS d,
        max(l_extendedprice / l_quantity) AS close FROM lineitem GROUP BY 1, 2),
    two AS (SELECT *, row_number() OVER (PARTITION BY company ORDER BY d DESC) AS back FROM closes
        QUALIFY back <= 2),
    moves AS (SELECT company, max(d) AS last, max(close) FILTER (back = 1)
        / max(close) FILTER (back = 2) - 1 AS mv FROM two GROUP BY 1),
    candidates AS (
        SELECT rule_id, company, kind, 'filing:' || accession AS subject_key FROM sr
            JOIN reports USING (company) WHERE kind = 'filing' AND form <> '4'
        UNION ALL SELECT rule_id, company, kind, 'event:' || accession FROM sr JOIN reports
            USING (company) WHERE kind = 'earnings' AND form = '8-K' AND list_contains(items, '2.02')
        UNION ALL SELECT rule_id, company, kind, 'event:' || news_id FROM sr JOIN v_news
            USING (company) WHERE kind = 'news' AND news_id % 4 <> 0
        UNION ALL SELECT rule_id, company, kind, 'insider:' || tx_id FROM sr JOIN v_insider
            USING (company) WHERE kind = 'insider' AND code = 'P' AND shares * price >= 300
        UNION ALL SELECT rule_id, company, kind, 'price:' || company || ':' || CAST(last AS VARCHAR)
            FROM sr JOIN moves USING (company) WHERE kind = 'price' AND abs(mv) >= 0.05)"""


def _candidates(t: Tables):
    news = _events(t).withColumn("event_day", F.to_date("occurred_at"))
    closes = t.lineitem.groupBy(
        F.col("l_partkey").alias("company"), F.to_date("l_shipdate").alias("trade_date")
    ).agg(F.max(F.col("l_extendedprice") / F.col("l_quantity")).alias("close"))
    return N.alert_candidates(_rules(t).drop("name"), _scope(t), _reports(t), news, t.insider(), closes)


@query("alert_candidates", f"WITH {_CANDIDATES} SELECT * FROM candidates")
def alert_candidates(t: Tables):
    return _candidates(t)


@query(
    "alert_emit",
    f"""WITH {_CANDIDATES} SELECT DISTINCT rule_id, subject_key FROM candidates
        WHERE NOT (kind = 'filing' AND rule_id % 3 = 0)""",
)
def alert_emit(t: Tables):
    candidates = _candidates(t)
    stored = candidates.where("kind = 'filing' and rule_id % 3 = 0").select("rule_id", "subject_key")
    return N.alert_emit(candidates, stored).select("rule_id", "subject_key")


@query(
    "alert_list",
    """WITH a AS (SELECT o_orderkey AS alert_id, o_custkey % 150 AS rule_id, CAST(o_orderdate AS DATE)
            AS created_on, o_orderstatus = 'F' AS is_read FROM orders)
        SELECT alert_id, rule_id, created_on, s_name AS name, (SELECT count(*) FROM a WHERE NOT is_read)
            AS unread FROM a LEFT JOIN supplier ON s_suppkey = rule_id
        ORDER BY created_on DESC, alert_id DESC LIMIT 50""",
)
def alert_list(t: Tables):
    alerts = t.orders.select(
        F.col("o_orderkey").alias("alert_id"), (F.col("o_custkey") % 150).alias("rule_id"),
        F.to_date("o_orderdate").alias("created_on"), (F.col("o_orderstatus") == "F").alias("is_read"),
    )
    return N.alert_list(alerts, _rules(t), 50).select("alert_id", "rule_id", "created_on", "name", "unread")


@query(
    "alert_unread",
    """SELECT o_custkey % 20 AS owner, count(*) FILTER (o_orderstatus <> 'F') AS unread FROM orders
        GROUP BY 1""",
)
def alert_unread(t: Tables):
    return t.orders.groupBy((F.col("o_custkey") % 20).alias("owner")).agg(
        F.count_if(F.col("o_orderstatus") != "F").alias("unread")
    )


@query(
    "admin_counts",
    """SELECT event_type AS provider, count(*) FILTER (value > 5) AS succeeded,
        count(*) FILTER (NOT value > 5) AS failed, max(epoch_us(ts)) FILTER (value > 5)
        AS last_success_us FROM events GROUP BY 1""",
)
def admin_counts(t: Tables):
    fetches = t.events.select(
        F.col("event_type").alias("provider"), (F.col("value") > 5).alias("ok"),
        F.unix_micros(F.col("ts").cast("timestamp")).alias("started_us"),
    )
    return N.admin_counts(fetches)
