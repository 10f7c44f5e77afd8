"""Queries on audits, storyline records, queues and text reports, each with the SQL it must agree with."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewire.operators import records as R
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


@query("s15_article_links", """WITH l AS (SELECT page_id, regexp_replace(url, '^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*).*$', '\\1') AS root, regexp_extract_all(html, '<a\\s[^>]*href=["'']([^"'']+)["'']', 1) AS h FROM pages), u AS (SELECT page_id, root || unnest(h) AS link, generate_subscripts(h, 1) AS i FROM l WHERE root <> ''),
 f AS (SELECT page_id, link, min(i) AS i FROM u WHERE NOT regexp_matches(link, '(/tag/|/category/|/page/|/author/|/search|/about|/contact)') GROUP BY 1, 2), r AS (SELECT page_id, link, row_number() OVER (PARTITION BY page_id ORDER BY i) AS k FROM f) SELECT page_id, CAST(k - 1 AS BIGINT) AS pos, link FROM r WHERE k <= 25""")
def s15(s, d):
    pages = V.table(s, d, "pages")
    rules = s.createDataFrame([("no.such.example", "/x/")], "domain string, part string")
    return R.article_links(pages, rules).withColumn("pos", F.col("pos").cast("bigint"))


@query("s15_selected_links", """WITH p AS (SELECT page_id, html, regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)', 1) AS root, page_id % 4 AS k FROM pages), h AS (SELECT page_id, root, k, CASE k WHEN 0 THEN flatten(list_transform(regexp_extract_all(html, '(?s)<nav[^>]*>(.*?)</nav>', 1), lambda n: regexp_extract_all(n, '<a href="([^"]+)"', 1))) WHEN 3 THEN [] ELSE regexp_extract_all(html, '<a href="([^"]+)"', 1) END AS hrefs FROM p),
 u AS (SELECT page_id, root || unnest(CASE WHEN k = 1 THEN list_filter(hrefs, lambda x: ends_with(x, 'e')) ELSE hrefs END) AS link, generate_subscripts(CASE WHEN k = 1 THEN list_filter(hrefs, lambda x: ends_with(x, 'e')) ELSE hrefs END, 1) AS i FROM h WHERE root <> ''),
 f AS (SELECT page_id, link, min(i) AS i FROM u WHERE NOT regexp_matches(link, '(/tag/|/category/|/page/|/author/|/search|/about|/contact)') AND (page_id % 4 <> 2 OR contains(link, 'a')) GROUP BY 1, 2), r AS (SELECT page_id, link, row_number() OVER (PARTITION BY page_id ORDER BY i) AS n FROM f) SELECT page_id, CAST(n - 1 AS BIGINT) AS pos, link FROM r WHERE n <= 25""")
def s15_selected(s, d):
    """Every page's own host has a rule of its own: by element, by the link's end, by the URL's part, and one that matches nothing."""
    p = V.table(s, d, "pages")
    host = F.lower(F.regexp_extract("url", "^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1))
    own = p.withColumn("url", F.regexp_replace("url", "^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*).*$", "$1"))
    out = None
    for k, (part, selector) in enumerate((("", "article > nav a, body nav li a"), ("", "a[href$='e']"), ("a", None), ("", "main .post > a"))):
        some = own.where(F.col("page_id") % 4 == k)
        rules = p.where(F.col("page_id") % 4 == k).select(host.alias("domain")).distinct().select("domain", F.lit(part).alias("part"), F.lit(selector).cast("string").alias("selector"))
        found = R.article_links(some, rules)
        out = found if out is None else out.union(found)
    return out.withColumn("pos", F.col("pos").cast("bigint"))


@query("s17_meta_dates", "SELECT o_orderkey AS id, CASE WHEN o_orderkey % 3 < 2 THEN CAST(date_trunc('second', CAST(o_orderdate AS TIMESTAMP)) AS VARCHAR)[1:19] END AS published FROM orders")
def s17(s, d):
    o, k = V.table(s, d, "orders"), F.col("o_orderkey") % 3
    at = F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    html = F.when(k == 0, F.concat(F.lit('<head><meta property="article:published_time" content="'), at, F.lit('"></head>'))).when(k == 1, F.concat(F.lit('<p><time class="x" datetime="'), at, F.lit('">then</time>'))).otherwise("<p>no date</p>")
    return o.select(F.col("o_orderkey").alias("id"), F.date_format(R.meta_date(html), "yyyy-MM-dd HH:mm:ss").alias("published"))


@query("s20_run_log", "SELECT user_id AS source_name, event_type AS mode, CASE WHEN sum(CASE WHEN value >= 90 THEN 1 ELSE 0 END) > 0 THEN 'ok' WHEN bool_or(value >= 40) THEN 'empty' ELSE 'error' END AS status, CAST(sum(CASE WHEN value >= 90 THEN 1 ELSE 0 END) AS BIGINT) AS articles FROM events GROUP BY 1, 2")
def s20(s, d):
    e = V.table(s, d, "events").select(F.col("user_id").alias("source_name"), F.col("event_type").alias("mode"), (F.col("value") >= 40).alias("ok"), (F.col("value") >= 90).cast("bigint").alias("articles"), F.col("value").alias("ms"))
    return R.run_log(e).drop("ms")


@query("a09_quality_audit", "SELECT count(*) AS reports, round(avg(composite) + 1e-12::DOUBLE, 4) AS avg_score, count(*) FILTER (composite < 0.45) AS low, count(*) FILTER (evaluation_id % 3 = 0) AS unconfirmed, least(count(*) FILTER (evaluation_id % 4 = 0), count(*) FILTER (evaluation_id % 5 = 0)) AS single_source_risks, round(sum(evaluation_id % 7) * 0.001::DOUBLE, 6) AS cost FROM v_evaluations")
def a09(s, d):
    i, none = F.col("evaluation_id"), F.array().cast("array<string>")
    flags = F.array_compact(F.array(F.when(i % 4 == 0, "high_risk_topic"), F.when(i % 5 == 0, "single_source")))
    return R.quality_audit(V.evaluations(s, d, False).select(F.col("composite").alias("score"), flags.alias("flags"), F.when(i % 3 == 0, none).otherwise(F.array(F.lit("c"))).alias("confirmed"), ((i % 7) * 0.001).alias("cost")))


@query("a11_report_audit", "WITH c AS (SELECT cluster_id, count(DISTINCT source_name) AS angles, cluster_id % 5 = 0 AS blank, cluster_id % 3 = 0 AS marked FROM v_search GROUP BY 1) SELECT count(*) AS clusters, round(count(*) FILTER (angles <= 1) / count(*), 4) AS one_angle_rate, count(*) FILTER (blank) AS blank, CAST(2 * count(*) FILTER (marked AND NOT blank) AS BIGINT) AS marks FROM c")
def a11(s, d):
    c = V.search_articles(s, d).groupBy("cluster_id").agg(F.concat(F.array(F.lit(" ")), F.collect_list(F.concat(F.lit(" "), "source_name"))).alias("perspectives"))
    return R.report_audit(c.select("perspectives", F.when(F.col("cluster_id") % 5 == 0, " ").when(F.col("cluster_id") % 3 == 0, "**Head** body").otherwise("body").alias("text")))


@query("a12_storyline_states", "SELECT CASE WHEN o_orderkey % 3 = 0 THEN 'emerging' WHEN o_totalprice >= 275000 AND o_orderkey % 2 = 0 THEN 'stabilized' ELSE 'developing' END AS state, count(*) AS n FROM orders GROUP BY 1")
def a12(s, d):
    from tidewire.operators.storyline import lifecycle

    o, k = V.table(s, d, "orders"), F.col("o_orderkey")
    state = lifecycle(k % 3 != 0, F.col("o_totalprice") / 500000, F.when(k % 2 == 0, 3).otherwise(1), F.lit(1))
    return o.select(state.alias("state")).groupBy("state").agg(F.count("*").alias("n"))


@query("a21_ownership_by_target", "WITH x AS (SELECT region, source_name, cluster_id FROM v_search WHERE NOT is_placeholder), g AS (SELECT region, count(*) AS n, list_sort(list(DISTINCT source_name))[1:3] AS s FROM x GROUP BY 1) SELECT region, n, array_to_string(s, ',') AS samples, round(100.0::DOUBLE * n / sum(n) OVER (), 1) AS pct FROM g")
def a21(s, d):
    return R.counted_by(V.search_articles(s, d).where("NOT is_placeholder"), "region", "source_name").withColumn("samples", F.concat_ws(",", "samples"))


@query("m05_storyline_upserts", "SELECT c_custkey AS key, CASE WHEN c_custkey % 6 = 0 THEN 'new' ELSE c_name END AS name, CASE WHEN c_custkey % 2 = 0 THEN 'developing' ELSE 'emerging' END AS state, CASE WHEN c_custkey % 2 = 0 THEN 2 ELSE 1 END AS day FROM customer UNION ALL SELECT s_suppkey + 1000000, s_name, 'emerging', 2 FROM supplier")
def m05(s, d):
    c, k = V.table(s, d, "customer"), F.col("c_custkey")
    old = c.select(k.alias("key"), F.col("c_name").alias("name"), F.lit("emerging").alias("state"), F.lit(1).alias("day"))
    new = c.where(k % 2 == 0).select(k.alias("key"), F.when(k % 3 == 0, "new").alias("name"), F.lit("developing").alias("state"), F.lit(2).alias("day"))
    fresh = V.table(s, d, "supplier").select((F.col("s_suppkey") + 1000000).cast("bigint").alias("key"), F.col("s_name").alias("name"), F.lit("emerging").alias("state"), F.lit(2).alias("day"))
    return R.upserted_storylines(old, new.unionByName(fresh))


@query("m05_timeline_events", "WITH o AS (SELECT o_custkey AS key, o_orderkey AS cluster_id, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS day FROM orders) SELECT key, cluster_id, day, CASE WHEN cluster_id % 4 = 0 THEN 'new' ELSE 'old' END AS title FROM o UNION ALL SELECT key, cluster_id + 10000000, day, 'new' FROM o WHERE cluster_id % 4 = 1")
def m05b(s, d):
    o = V.table(s, d, "orders").select(F.col("o_custkey").alias("key"), F.col("o_orderkey").alias("cluster_id"), F.col("o_orderdate").cast("date").cast("string").alias("day"))
    again = o.where("cluster_id % 4 = 0").select("key", "cluster_id", "day", F.lit("new").alias("title"), F.lit("history").alias("kind"), F.lit(None).cast("bigint").alias("this"))
    current = o.where("cluster_id % 4 = 1").select("key", F.when(F.col("cluster_id") % 8 == 1, F.col("cluster_id")).alias("cluster_id"), "day", F.lit("new").alias("title"), F.lit("current").alias("kind"), (F.col("cluster_id") + 10000000).alias("this"))
    return R.upserted_events(o.withColumn("title", F.lit("old")), again.unionByName(current), "this")


@query("s09_pending_reviews", "SELECT event_id AS id FROM events WHERE event_type = 'click' ORDER BY ts DESC, event_id DESC LIMIT 500")
def s09(s, d):
    e = V.table(s, d, "events").select(F.col("event_id").alias("id"), F.when(F.col("event_type") == "click", "pending_review").otherwise("accepted").alias("decision"), F.col("ts").alias("created_at"))
    return R.pending_reviews(e, 9000).select("id")


@query("r15_review_lines", "SELECT event_id AS id, '#' || event_id || ' L' || user_id || '/us official site.example verdict=' || event_type || ' reason=r' AS line FROM events")
def r15(s, d):
    e = V.table(s, d, "events").select(F.col("event_id").alias("id"), F.concat(F.lit("L"), F.col("user_id").cast("string")).alias("target_label"), F.lit("us").alias("target_region"), F.lit("official").alias("stage"), F.lit("site.example").alias("domain"), F.col("event_type").alias("verdict"), F.lit("r").alias("reason"))
    return R.review_lines(e)


_CONTRIBUTED = "WITH m AS (SELECT DISTINCT v.source_name, v.cluster_id FROM v_search v WHERE NOT v.is_placeholder AND v.pos % 3 > 0), k AS (SELECT cluster_id, count(*) AS k FROM m GROUP BY 1), o AS (SELECT m.source_name, count(*) AS appearances, round(sum(e.composite), 3) AS impact_weighted, count(*) FILTER (k.k = 1) AS exclusive, count(*) FILTER (e.selected) AS selected_count FROM m JOIN v_evaluations e ON e.cluster_id = m.cluster_id JOIN k ON k.cluster_id = m.cluster_id GROUP BY 1)"


@query("r15_audit_lines", _CONTRIBUTED + """ SELECT 'issues' AS section, CAST(row_number() OVER (ORDER BY key) - 1 AS BIGINT) AS place, '- ' || key || ': ' || n AS line FROM (SELECT event_type AS key, count(*) AS n FROM events GROUP BY 1)
 UNION ALL SELECT 'sources', p - 1, concat_ws(repeat(' ', 2), '', format('{:<35} {:>6}', source_name, appearances), format('{:>7.3f}', impact_weighted), format('{:>5}', exclusive), format('{:>5}', selected_count)) FROM (SELECT *, row_number() OVER (ORDER BY impact_weighted DESC, source_name) AS p FROM o) WHERE p <= 5
 UNION ALL SELECT 'silent', 0, repeat(' ', 2) || 'Zero-contribution (candidates to drop): ' || string_agg(n, ', ' ORDER BY n) FROM (VALUES ('S1'), ('T1'), ('T2')) x(n) WHERE n NOT IN (SELECT source_name FROM o)""")
def r15_audit(s, d):
    from tidewire.operators.analytics import source_contribution, zero_contribution

    members = V.search_articles(s, d).where("NOT is_placeholder AND pos % 3 > 0").select("cluster_id", "source_name")
    own = source_contribution(V.evaluations(s, d, False), members)
    named = s.createDataFrame([("S1",), ("T1",), ("T2",)], "source_name string")
    issues = V.table(s, d, "events").groupBy(F.col("event_type").alias("key")).agg(F.count("*").alias("n"))
    return R.audit_lines(issues, own, named.join(own, "source_name", "left_anti"), 5)


@query("r15_calibration_lines", "SELECT CAST(row_number() OVER (ORDER BY event_type) - 1 AS INTEGER) AS place, concat_ws(repeat(' ', 2), '', format('{:<22} {:.4f}', event_type, w), format('(seed {:.4f}, {})', s, CASE WHEN s <> 0 THEN format('{:.2f}x', w / s) ELSE 'n/a' END), format('[{}]', t)) AS line FROM (SELECT event_type, count(*) / 1024.0::DOUBLE AS w, CASE WHEN event_type = 'click' THEN 0.0::DOUBLE ELSE 0.5::DOUBLE END AS s, CAST(max(date_trunc('second', ts)) AS VARCHAR)[1:19] AS t FROM events GROUP BY 1)")
def r15_calibration(s, d):
    e = V.table(s, d, "events").groupBy(F.col("event_type").alias("dimension")).agg((F.count("*") / 1024.0).alias("weight"), F.date_format(F.max("ts"), "yyyy-MM-dd HH:mm:ss").alias("updated_at"))
    return R.calibration_lines(e.withColumn("seed", F.when(F.col("dimension") == "click", 0.0).otherwise(0.5)))


@query("z03_feedback_text", "WITH x AS (SELECT f.id, CAST(e.report_date AS VARCHAR) AS day, f.verdict, e.display_category AS label, e.composite FROM v_feedback f JOIN v_evaluations e ON e.cluster_id = f.cluster_id) SELECT day, count(*) FILTER (verdict > 0) AS accepted, count(*) FILTER (verdict < 0) AS rejected, count(*) AS n FROM x GROUP BY 1")
def z03(s, d):
    e = V.evaluations(s, d, False).select("cluster_id", F.col("report_date").cast("string").alias("day"), F.col("display_category").alias("label"), "composite")
    t = R.feedback_lines(V.feedback(s, d).select("id", "cluster_id", "verdict").join(e, "cluster_id"))
    return t.select("day", "accepted", "rejected", (F.size(F.split("text", "\n"))).cast("bigint").alias("n"))


@query("d30_label_rejoin", "SELECT o_orderkey AS id, c.cluster_id FROM orders JOIN (SELECT o_orderpriority AS p, min(o_orderkey) AS cluster_id FROM orders WHERE o_orderkey % 2 = 0 GROUP BY 1) c ON c.p = o_orderpriority WHERE o_orderkey % 2 = 1")
def d30(s, d):
    o = V.table(s, d, "orders")
    follow = o.where("o_orderkey % 2 = 1").select(F.col("o_orderkey").alias("id"), F.concat(F.lit(" "), F.upper("o_orderpriority")).alias("label"))
    return R.reattached(follow, o.where("o_orderkey % 2 = 0").select(F.col("o_orderkey").alias("cluster_id"), F.col("o_orderpriority").alias("label")), "label").select("id", "cluster_id")


@query("j19_existing_urls", "SELECT p.page_id, count(q.page_id) AS earlier FROM pages p LEFT JOIN pages q ON q.url = p.url AND q.page_id < p.page_id GROUP BY 1")
def j19(s, d):
    return R.earlier_with(V.table(s, d, "pages").select("page_id", "url"), "url", "page_id").select("page_id", "earlier")


@query("d24_preferred_summaries", "SELECT o_custkey AS family, arg_min(o_orderkey, (CASE WHEN o_orderpriority = '1-URGENT' THEN 0 ELSE 1 END, -round(o_totalprice / 100000), -(o_orderkey % 3), -(o_orderkey % 2), o_orderkey)) AS id FROM orders GROUP BY 1")
def d24(s, d):
    o, k = V.table(s, d, "orders"), F.col("o_orderkey")
    rows = o.select(F.col("o_custkey").alias("family"), k.alias("id"), (F.col("o_orderpriority") == "1-URGENT").alias("positive"), F.round(F.col("o_totalprice") / 100000).alias("composite"), (k % 3).alias("perspective_groups"), F.lit(1).alias("sources"), F.when(k % 2 == 1, "new").otherwise("developing").alias("freshness"))
    return R.preferred(rows, "family").select("family", "id")


@query("e01_model_clusters", """WITH a AS (SELECT o_orderkey AS id, o_orderkey % 10 AS batch FROM orders), e AS (SELECT batch, id % 4 AS entry, id FROM a WHERE batch <> 3 AND id % 3 <> 0 UNION ALL SELECT batch, 7, id FROM a WHERE batch <> 3 AND id % 3 <> 2), f AS (SELECT batch, id, min(entry) AS entry FROM e GROUP BY 1, 2)
 SELECT id, 'm-' || batch || '-' || entry AS cluster FROM f UNION ALL SELECT id, 'f-' || id % 5 FROM a WHERE batch = 3""")
def e01(s, d):
    a = V.table(s, d, "orders").select(F.col("o_orderkey").alias("id"), (F.col("o_orderkey") % 10).alias("batch"))
    told = a.where("batch <> 3")
    one = told.where("id % 3 <> 0").groupBy("batch", (F.col("id") % 4).alias("entry")).agg(F.collect_list("id").alias("ids"))
    two = told.where("id % 3 <> 2").groupBy("batch").agg(F.collect_list("id").alias("ids")).select("batch", F.lit(7).cast("bigint").alias("entry"), F.concat("ids", F.array(F.lit(-1).cast("bigint"))).alias("ids"))
    return R.model_clusters(one.unionByName(two), a, a.select("id", (F.col("id") % 5).alias("cluster")))


@query("z15_retention", "SELECT 'orders' AS t, o_orderkey AS id FROM orders WHERE o_orderdate >= TIMESTAMP '1998-08-01 00:00:00' - INTERVAL 400 DAY UNION ALL SELECT 'events', event_id FROM events WHERE ts >= TIMESTAMP '1998-08-01 00:00:00' - INTERVAL 400 DAY")
def z15(s, d):
    kept = R.retention({"orders": (V.table(s, d, "orders"), "o_orderdate"), "events": (V.table(s, d, "events"), "ts")}, F.lit("1998-08-01 00:00:00").cast("timestamp"), 400)
    return kept["orders"].select(F.lit("orders").alias("t"), F.col("o_orderkey").alias("id")).union(kept["events"].select(F.lit("events").alias("t"), "event_id"))


@query("x06_stage_totals", "WITH x AS (SELECT CAST(ts AS DATE) AS day, event_type AS stage, value < 5 AS failed, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, event_id % 3 = 0 AS hit FROM events) SELECT CAST(day AS VARCHAR) AS day, stage, count(*) AS calls, count(*) FILTER (failed) AS failures, CAST(coalesce(sum(k), 0) AS BIGINT) AS prompt, CAST(coalesce(sum(k) FILTER (hit), 0) AS BIGINT) AS cached, CAST(coalesce(sum(k % 7), 0) AS BIGINT) AS completion, CASE WHEN sum(k) > 0 THEN round(coalesce(sum(k) FILTER (hit), 0) / sum(k), 4) ELSE 0.0::DOUBLE END AS cache_share FROM x GROUP BY 1, 2")
def x06(s, d):
    from tidewire.streaming import streams as M

    k = F.get_json_object("props", "$.k").cast("bigint")
    calls = M.event_stream(s, d).select("ts", F.col("event_type").alias("stage"), F.when(F.col("value") < 5, "error").otherwise("ok").alias("status"), k.alias("prompt"), F.when(F.col("event_id") % 3 == 0, k).alias("cached"), (k % 7).alias("completion"))
    return M.drained(M.stage_totals(calls), "complete").withColumn("day", F.date_format("day", "yyyy-MM-dd"))
