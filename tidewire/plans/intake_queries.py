"""Queries on collection, report files, the publication contract and grounded numbers, each with the SQL it must agree with."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewire.operators import grounding as G
from tidewire.sources import feeds as I
from tidewire.sources import views as V
from tidewire.sources.views import with_views

QUERIES: dict = {}
ORACLE_SQL: dict = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = with_views(" ".join(sql.split()))
        return f

    return add


def _text(c):
    return F.col(c).cast("string")


@query("s12_feed_items", """WITH e AS (SELECT user_id, event_id, date_trunc('second', ts) AS sent, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS pos FROM events) SELECT user_id AS feed, CAST(pos AS BIGINT) AS pos, 'https://f.example/' || event_id AS url, 'Item & ' || event_id AS title, CAST(CASE WHEN event_id % 5 = 0 THEN TIMESTAMP '2024-01-20 00:00:00' ELSE sent END AS VARCHAR)[1:19] AS published, CASE WHEN event_id % 3 = 0 THEN 400 ELSE 160 END AS size
 FROM e WHERE event_id % 7 <> 0 AND (event_id % 5 = 0 OR sent >= TIMESTAMP '2024-01-10 00:00:00') AND (event_id % 3 = 0 OR event_id % 2 = 0)""")
def s12(s, d):
    """Users with an even id have RSS feeds, the others Atom; dates in four zones and forms, none where 5 divides the id."""
    e = V.table(s, d, "events")
    i, k = _text("event_id"), F.col("event_id")
    at = lambda hours, form: F.date_format(F.col("ts") + F.make_dt_interval(hours=F.lit(hours)), form)
    mail, iso = "EEE, dd MMM yyyy HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss"
    dated = k % 5 != 0
    rss_date = F.when(dated, F.concat(F.lit("<pubDate>"), F.when(k % 4 == 0, F.concat(at(0, mail), F.lit(" GMT"))).when(k % 4 == 1, F.concat(at(8, mail), F.lit(" +0800"))).when(k % 4 == 2, F.concat(at(-5, "dd MMM yy HH:mm:ss"), F.lit(" EST"))).otherwise(F.concat(at(0, mail), F.lit(" +0000"))), F.lit("</pubDate>"))).otherwise("")
    atom_date = F.when(dated, F.concat(F.lit("<updated>"), F.when(k % 2 == 0, F.concat(at(8, iso), F.lit("+08:00"))).otherwise(F.concat(at(0, iso), F.lit("Z"))), F.lit("</updated>"))).otherwise("")
    url = F.concat(F.lit("https://f.example/"), i)
    linked = k % 7 != 0
    rss_link, atom_link = F.when(linked, F.concat(F.lit("<link>"), url, F.lit("</link>"))).otherwise(""), F.when(linked, F.concat(F.lit('<link rel="self" href="https://f.example/self"/><link rel="alternate" href="'), url, F.lit('"/>'))).otherwise("")
    long = F.repeat(F.lit("x"), 400)
    rss_body = F.when(k % 3 == 0, F.concat(F.lit("<description><![CDATA[<p>"), long, F.lit("</p>]]></description>"))).otherwise("<description>short</description>")
    atom_body = F.when(k % 3 == 0, F.concat(F.lit('<content type="html">&lt;p&gt;'), long, F.lit("&lt;/p&gt;</content>"))).otherwise('<summary type="text">short</summary>')
    title = F.concat(F.lit("Item &amp; "), i, F.lit("</title>"))
    item = F.when(F.col("user_id") % 2 == 0, F.concat(F.lit("<item><title>"), title, rss_link, rss_date, rss_body, F.lit("</item>"))).otherwise(F.concat(F.lit('<entry><title type="text">'), title, atom_link, atom_date, atom_body, F.lit("</entry>")))
    feeds = e.groupBy(F.col("user_id").alias("feed")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("event_id", item.alias("x")))), lambda x: x["x"]), "").alias("xml"))
    pages = e.where("event_id % 2 = 0").select(url.alias("url"), F.repeat(F.lit("y"), 160).alias("body"))
    now = F.lit("2024-01-20 00:00:00").cast("timestamp")
    out = I.feed_items(feeds, "xml", now, 240, pages)
    return out.select("feed", F.col("pos").cast("bigint").alias("pos"), "url", "title", F.date_format("published_at", "yyyy-MM-dd HH:mm:ss").alias("published"), F.length("content").alias("size"))


@query("s14_site_items", "SELECT event_id AS id, CASE WHEN event_id % 3 = 0 THEN 'https://u.example/' || event_id ELSE 'https://site.example/articles/' || event_id END AS url, CASE WHEN event_id % 4 = 0 THEN 'Short ' || event_id ELSE 'Title ' || event_id END AS title, CASE WHEN event_id % 2 = 0 THEN 'Body' WHEN event_id % 4 = 0 THEN 'Short ' || event_id ELSE 'Title ' || event_id END AS content FROM events WHERE date_trunc('second', ts) >= TIMESTAMP '2024-01-10 00:00:00' AND event_id % 11 <> 0")
def s14(s, d):
    e = V.table(s, d, "events")
    i, at = _text("event_id"), F.when(F.col("event_id") % 2 == 0, F.unix_seconds("ts")).otherwise(F.unix_seconds("ts") * 1000)
    blank = F.col("event_id") % 11 == 0
    item = F.struct(i.alias("id"), F.when(blank | (F.col("event_id") % 4 == 0), "").otherwise(F.concat(F.lit("Title "), i)).alias("title"), F.when(~blank, F.concat(F.lit("Short "), i)).alias("content_short"), at.alias("display_time"), F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("https://u.example/"), i)).alias("uri"), F.when(F.col("event_id") % 2 == 0, "Body").alias("content_text"))
    rows = e.select(F.col("event_id").alias("id"), F.to_json(F.struct(F.struct(F.array(item).alias("items")).alias("data"))).alias("payload"))
    return I.site_items(rows, "payload", "https://site.example/articles/", F.lit("2024-01-10 00:00:00").cast("timestamp")).select("id", "url", "title", "content")


@query("s18_first_success", """WITH a AS (SELECT user_id AS source_name, ['newsnow', 'rss', 'rss_fallback', 'rsshub', 'api', 'scrape'][CAST(event_id % 6 + 1 AS BIGINT)] AS method, event_id % 6 + 1 AS p, value >= 30 AS ok, event_id % 4 AS items, event_id FROM events), b AS (SELECT source_name, method, p, bool_or(ok) AS ok, max(CASE WHEN ok THEN items ELSE 0 END) AS items FROM a GROUP BY 1, 2, 3),
 f AS (SELECT *, min(CASE WHEN ok AND items > 0 THEN p END) OVER (PARTITION BY source_name) AS first FROM b) SELECT source_name, max(CASE WHEN p = first THEN method END) AS method, coalesce(string_agg(method || CASE WHEN ok THEN ':no_eligible_articles' ELSE ':error' END, ',' ORDER BY p) FILTER (first IS NULL OR p < first), '') AS outcomes FROM f GROUP BY 1""")
def s18(s, d):
    e = V.table(s, d, "events").select(F.col("user_id").alias("source_name"), V.pick(I.METHODS, F.col("event_id") % 6).alias("method"), (F.col("value") >= 30).alias("ok"), (F.col("event_id") % 4).alias("items"))
    attempts = e.groupBy("source_name", "method").agg(F.max("ok").alias("ok"), F.max(F.when(F.col("ok"), F.col("items")).otherwise(0)).alias("items"))
    return I.first_success(attempts)


@query("s19_selected_sources", "SELECT 'full' AS mode, name FROM v_sources UNION ALL SELECT 'delta', name FROM v_sources WHERE tier <> 'portal'")
def s19(s, d):
    v = V.sources(s, d)
    return I.selected_sources(v, "full").select(F.lit("full").alias("mode"), "name").union(I.selected_sources(v, "delta").select(F.lit("delta").alias("mode"), "name"))


@query("s22_certifications", "SELECT s_name AS source_name, CASE WHEN s_suppkey % 2 = 0 THEN 'jti' ELSE 'ifcn' END AS code, CASE WHEN s_suppkey % 2 = 0 THEN 'Journalism Trust Initiative' ELSE 'Fact-checking network' END AS label FROM supplier")
def s22(s, d):
    known = s.createDataFrame([("jti", "Journalism Trust Initiative"), ("ifcn", "Fact-checking network")], "code string, label string")
    return I.certifications(V.table(s, d, "supplier").select(F.col("s_name").alias("source_name"), F.when(F.col("s_suppkey") % 2 == 0, "jti").otherwise("ifcn").alias("code")), known)


@query("s24_golden_stories", "SELECT o_orderkey AS id, CASE WHEN o_orderkey % 3 = 0 THEN 'Topic' ELSE 'Head' END AS headline, CASE WHEN o_orderkey % 2 = 0 THEN 'a' || o_orderkey || ' own' ELSE 'b' || o_orderkey END AS urls FROM orders WHERE o_orderkey % 5 <> 0 UNION ALL SELECT o_orderkey, '?', 'f' || o_orderkey FROM orders WHERE o_orderkey % 4 = 0")
def s24(s, d):
    o, i = V.table(s, d, "orders"), _text("o_orderkey")
    link = lambda u, field: F.array(F.struct(u.alias(field)))
    story = F.struct(F.when(F.col("o_orderkey") % 3 != 0, "Head").alias("headline"), F.lit("Topic").alias("topic"), F.when((F.col("o_orderkey") % 2 == 0) & (F.col("o_orderkey") % 5 != 0), "own").alias("url"),
        F.when((F.col("o_orderkey") % 2 == 0) & (F.col("o_orderkey") % 5 != 0), link(F.concat(F.lit("a"), i), "url")).alias("articles"), F.when((F.col("o_orderkey") % 2 == 1) & (F.col("o_orderkey") % 5 != 0), link(F.concat(F.lit("b"), i), "link")).alias("footer_sources"))
    family = F.when(F.col("o_orderkey") % 4 == 0, F.array(F.struct(F.array(F.struct(link(F.concat(F.lit("f"), i), "url").alias("source_groups"))).alias("summaries"))))
    docs = o.select(F.col("o_orderkey").alias("id"), F.to_json(F.struct(F.array(story).alias("clusters"), family.alias("hot_topics"))).alias("doc"))
    return I.golden_stories(docs, "doc", "id").select("id", "headline", F.array_join("urls", " ").alias("urls"))


@query("s25_report_dates", "SELECT CAST(dt AS VARCHAR) AS day FROM (SELECT DISTINCT CAST(o_orderdate AS DATE) AS dt FROM orders) WHERE dayofmonth(dt) % 5 <> 0 AND (dayofmonth(dt) % 3 <> 0 OR dayofmonth(dt) % 2 = 0)")
def s25(s, d):
    days = V.table(s, d, "orders").select(F.col("o_orderdate").cast("date").alias("dt")).distinct()
    n, day = F.dayofmonth("dt"), F.col("dt").cast("string").alias("day")
    data = F.when(n % 3 == 0, F.when(n % 2 == 0, '{"total_cluster_count": "x"}').otherwise('{"total_cluster_count": 0}')).when(n % 7 == 0, "not json").otherwise('{"total_cluster_count": 4}')
    files = days.where(n % 5 != 0).select(day, F.lit("index.html").alias("name"), F.lit("").alias("text")).union(days.select(day, F.lit("data.json").alias("name"), data.alias("text")))
    return I.report_dates(files)


@query("s11_window_candidates", "WITH w AS (SELECT event_id AS id, event_type AS source_name, ts FROM events WHERE event_id % 4 <> 0 AND ts <= TIMESTAMP '2024-01-20 00:00:00' AND ts >= TIMESTAMP '2024-01-15 00:00:00' ORDER BY ts DESC, event_id LIMIT 200), r AS (SELECT id, row_number() OVER (PARTITION BY source_name ORDER BY ts DESC, id) AS k FROM w) SELECT id FROM r WHERE k <= 15")
def s11(s, d):
    e = V.table(s, d, "events").select(F.col("event_id").alias("id"), F.col("event_type").alias("source_name"), F.col("ts").alias("published_at"), (F.col("event_id") % 4 == 0).alias("is_searched"))
    return I.window_candidates(e, F.lit("2024-01-20 00:00:00").cast("timestamp"), 120, 200).select("id")


@query("z02_query_lists", "SELECT event_id AS id, CASE event_id % 3 WHEN 0 THEN 'us|cn' WHEN 1 THEN '' ELSE 'de' END AS regions FROM events")
def z02(s, d):
    value = F.when(F.col("event_id") % 3 == 0, "us, cn,").when(F.col("event_id") % 3 == 2, " ,de")
    return V.table(s, d, "events").select(F.col("event_id").alias("id"), F.array_join(I.query_list(value), "|").alias("regions"))


# The publication contract

_BODIES = ("**Head**\nA body of more than twenty letters in all.", "短", "3人。 A body of more than twenty letters in all.", "A body of more than twenty letters. 12%.", "，A body of more than twenty letters in all.", "A body of more than twenty letters, with 有关数字 in it.", "Fire kills, says a body of more than twenty letters.", " ")
_CODES = ("", "summary_body_too_short", "leading_numeric_fragment orphan_numeric_fragment", "orphan_numeric_fragment", "malformed_sentence_start", "numeric_placeholder", "malformed_numeric_remnant", "empty_summary")
_CODE_LIST = "[" + ", ".join(f"'{c}'" for c in _CODES) + "]"
_STATUS = ("publishable", "needs_review", "unknown")
_CONTRACT = f"""x AS (SELECT cluster_id, pos, trim(concat_ws(' ', CASE WHEN is_searched AND status = 'accepted' AND coalesce(freshness, '') = '' AND NOT coalesce(reason = 'current_event_perspective', false) THEN 'search_evidence_unverified' END, CASE WHEN is_placeholder THEN 'no_real_articles' END,
 CASE WHEN pos % 10 > 0 AND pos % 3 > 0 THEN 'quality_status_not_publishable' END, CASE WHEN pos % 10 > 0 AND pos % 7 = 0 THEN 'unsupported_numeric_claim' END, {_CODE_LIST}[CAST(pos % 8 + 1 AS BIGINT)])) AS issues FROM v_search)"""


def _contract(s, d):
    v, p = V.search_articles(s, d), F.col("pos")
    article = F.struct("url", "is_placeholder", "is_searched", "status", "reason", "freshness")
    flags = F.when(p % 7 == 0, F.array(F.lit("unsupported_numeric_claim"))).otherwise(F.array().cast("array<string>"))
    body, status = V.pick(_BODIES, p % 8), V.pick(_STATUS, p % 3)
    issues = G.publication_issues(F.array(article), status, flags, body, F.lit(None).cast("string"), p % 10 == 0)
    return v.select("cluster_id", "pos", F.filter(issues, lambda x: x != "").alias("issues"), flags.alias("flags"), status.alias("quality"), body.alias("body"))


@query("f04_publication_issues", f"WITH {_CONTRACT} SELECT cluster_id, pos, issues FROM x")
def f04(s, d):
    return _contract(s, d).select("cluster_id", "pos", F.array_join("issues", " ").alias("issues"))


@query("a09_issue_histogram", f"WITH {_CONTRACT}, u AS (SELECT unnest(string_split(issues, ' ')) AS flag FROM x WHERE issues <> '') SELECT flag, count(*) AS n FROM u GROUP BY 1")
def a09(s, d):
    from tidewire.operators.analytics import flag_histogram

    return flag_histogram(_contract(s, d), "issues")


@query("z19_publication_safe", f"WITH {_CONTRACT} SELECT count(*) FILTER (issues = '') AS safe, count(*) AS n FROM x")
def z19(s, d):
    return _contract(s, d).agg(F.count_if(F.size("issues") == 0).alias("safe"), F.count("*").alias("n"))


@query("f05_publication_rejections", f"WITH {_CONTRACT} SELECT cluster_id, pos, CASE WHEN issues <> '' AND pos % 2 = 0 THEN replace(issues, ' ', ';') WHEN pos % 3 = 1 THEN 'quality_status=needs_review' WHEN pos % 7 = 0 THEN 'unsupported_numeric_claim' WHEN pos % 8 = 5 THEN 'malformed_summary=有关数字|certain number' END AS reason FROM x")
def f05(s, d):
    c = _contract(s, d)
    issues = F.when(F.col("pos") % 2 == 0, F.col("issues")).otherwise(F.array().cast("array<string>"))
    return c.select("cluster_id", "pos", G.publication_rejection(issues, F.col("flags"), F.col("quality"), F.col("body"), F.lit(None).cast("string")).alias("reason"))


# Grounded numbers

_K = "(100 + o_orderkey % 900)"


def _k():
    return (F.lit(100) + F.col("o_orderkey") % 900).cast("string")


@query("fn_numeric_values", f"SELECT o_orderkey AS id, CASE o_orderkey % 4 WHEN 0 THEN {_K} * 10000.0::DOUBLE WHEN 1 THEN 3000.0::DOUBLE + {_K} WHEN 2 THEN {_K} * 1000.0::DOUBLE + 5 ELSE {_K} + 0.5::DOUBLE END AS first, CASE o_orderkey % 4 WHEN 0 THEN 2 ELSE 1 END AS n FROM orders")
def fn_values(s, d):
    k = _k()
    text = F.when(F.col("o_orderkey") % 4 == 0, F.concat(F.lit("共"), k, F.lit("万人和7个"))).when(F.col("o_orderkey") % 4 == 1, F.concat(F.lit("3千"), k, F.lit("枚"))).when(F.col("o_orderkey") % 4 == 2, F.concat(F.lit("x "), k, F.lit(",005 y"))).otherwise(F.concat(k, F.lit(".5")))
    v = G.numeric_values(text)
    return V.table(s, d, "orders").select(F.col("o_orderkey").alias("id"), F.element_at(v, 1).alias("first"), F.size(v).alias("n"))


@query("fn_money_amounts", f"SELECT o_orderkey AS id, CASE o_orderkey % 4 WHEN 0 THEN 'USD' WHEN 1 THEN 'CNY' WHEN 2 THEN 'EUR' END AS currency, CASE o_orderkey % 4 WHEN 0 THEN {_K} * 1e9::DOUBLE WHEN 1 THEN {_K} * 1e8::DOUBLE WHEN 2 THEN {_K} * 1.0::DOUBLE END AS value FROM orders")
def fn_money(s, d):
    k = _k()
    text = F.when(F.col("o_orderkey") % 4 == 0, F.concat(F.lit("It cost $"), k, F.lit(" billion."))).when(F.col("o_orderkey") % 4 == 1, F.concat(F.lit("约"), k, F.lit("亿元"))).when(F.col("o_orderkey") % 4 == 2, F.concat(k, F.lit(" Euros"))).otherwise(F.concat(k, F.lit(" people")))
    m = F.try_element_at(G.money_amounts(text), F.lit(1))
    return V.table(s, d, "orders").select(F.col("o_orderkey").alias("id"), m["currency"].alias("currency"), m["value"].alias("value"))


_TOLD = ("Police say the blast killed {}.", "{} apples lay there", "A {}-{} win for the home side", "{}7 of them left", "Talks took {} 天 and {} weeks", "约{}人受伤，{}号门关闭", "It cost $ {} in all", "Nothing is told here, said {} sources twice and went")


@query("fn_claims_in_context", """WITH o AS (SELECT o_orderkey AS id, CAST(o_orderkey % 9 + 1 AS VARCHAR) AS a, CAST(o_custkey % 9 + 1 AS VARCHAR) AS b FROM orders)
 SELECT id, CASE id % 8 WHEN 0 THEN a WHEN 1 THEN '' WHEN 2 THEN a || '-' || b WHEN 3 THEN a || '7' WHEN 4 THEN '' WHEN 5 THEN CASE WHEN a || '人' = b THEN a ELSE a || '人|' || b END WHEN 6 THEN '$ ' || a ELSE '' END AS claims FROM o""")
def fn_context(s, d):
    a, b = (F.col(c) % 9 + 1 for c in ("o_orderkey", "o_custkey"))
    told = F.format_string
    text = F.lit("")
    for n, form in enumerate(_TOLD):
        text = F.when(F.col("o_orderkey") % 8 == n, told(form.replace("{}", "%d"), *[a, b][: form.count("{}")])).otherwise(text)
    return V.table(s, d, "orders").select(F.col("o_orderkey").alias("id"), F.array_join(G.claims(text), "|").alias("claims"))


@query("z09_grounded_summaries", f"""SELECT o_orderkey AS id, CASE WHEN o_orderkey % 4 = 1 THEN 'No number is given by anyone here.' WHEN o_orderkey % 4 = 3 THEN 'The storm reached the coast. It moved on.' WHEN o_orderkey % 4 = 2 THEN 'The cost is $' || {_K} || ' million in all, they say.' ELSE 'The storm hurt ' || {_K} || ' people on the coast.' END AS summary,
 o_orderkey % 4 = 3 AS needs_review, CASE WHEN o_orderkey % 4 = 1 THEN 'numeric_grounding_rewritten' WHEN o_orderkey % 4 = 3 THEN 'unsupported_numeric_claim' ELSE '' END AS flags, CASE WHEN o_orderkey % 4 = 3 THEN CAST({_K} AS VARCHAR) ELSE '' END AS contested FROM orders""")
def z09(s, d):
    k, n = _k(), F.col("o_orderkey") % 4
    hurt = F.concat(F.lit("The storm hurt "), k, F.lit(" people on the coast."))
    summary = F.when(n == 0, hurt).when(n == 1, hurt).when(n == 2, F.concat(F.lit("The cost is $"), k, F.lit(" million in all, they say."))).otherwise(F.concat(F.lit("The storm reached the coast. It hurt "), k, F.lit(" people. It moved on.")))
    evidence = F.when(n == 0, F.concat(F.lit("Officials count "), k, F.lit(" hurt."))).when(n == 2, F.concat(F.lit("About USD? No: "), k, F.lit(".5 million dollars."))).otherwise("Officials give no count.")
    out = G.enforced(summary, F.when(n == 1, "No number is given by anyone here."), evidence)
    rows = V.table(s, d, "orders").select(F.col("o_orderkey").alias("id"), out.alias("o"))
    return rows.select("id", "o.summary", "o.needs_review", F.array_join("o.flags", " ").alias("flags"), F.array_join("o.contested", " ").alias("contested"))
