"""Queries on publication, acceptance and report assembly, each with the SQL it must agree with."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewire.functions import text as X
from tidewire.operators import editorial as E
from tidewire.operators import maintenance as M
from tidewire.operators import scoring as S
from tidewire.operators import selection as T
from tidewire.operators import similarity as Y
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


def line_pos():
    """An order of line items that hardly ties: line numbers repeat within an order."""
    return (F.col("l_linenumber") * 1000000 + F.col("l_partkey")) * 10000 + F.col("l_suppkey")


_REASON = "CASE WHEN event_id % 7 = 0 THEN 'entity_mismatch' WHEN ts < TIMESTAMP '2024-01-10 00:00:00' THEN 'stale_result' WHEN event_id % 5 = 0 THEN 'background_context' WHEN value >= 82 THEN 'duplicate_of_existing' WHEN value / 100 < 0.58 THEN 'event_mismatch' END"


def _candidates(s, d):
    e = V.table(s, d, "events")
    reason = E.rejection_reason(F.col("event_id") % 7 != 0, F.col("ts") >= F.lit("2024-01-10").cast("timestamp"), F.col("event_id") % 5 == 0, F.col("value"), F.col("value") / 100)
    return e.select("event_id", "user_id", "value", "ts", reason.alias("reason"))


@query("f06_rejection_ladder", f"SELECT event_id, {_REASON} AS reason FROM events")
def f06(s, d):
    return _candidates(s, d).select("event_id", "reason")


@query("f07_primary_reason", f"WITH c AS (SELECT user_id, {_REASON} AS reason FROM events) SELECT user_id, arg_min(reason, list_position(['event_mismatch', 'background_context', 'entity_mismatch', 'stale_result', 'duplicate_of_existing'], reason)) AS reason FROM c WHERE reason IS NOT NULL GROUP BY 1")
def f07(s, d):
    return E.primary_reason(_candidates(s, d).where("reason IS NOT NULL"), "user_id", "reason")


@query("f08_freshness_gate", "SELECT o_orderkey AS id, CASE WHEN o_orderkey % 13 = 0 THEN true ELSE epoch(TIMESTAMP '1998-01-04 00:00:00') - epoch(o_orderdate) <= 259200 END AS fresh FROM orders")
def f08(s, d):
    published = F.when(F.col("o_orderkey") % 13 != 0, F.col("o_orderdate"))
    return V.table(s, d, "orders").select(F.col("o_orderkey").alias("id"), E.is_fresh(published, F.lit("1998-01-04").cast("timestamp")).alias("fresh"))


@query("f13_should_enrich", "SELECT evaluation_id, status = 'P' OR composite >= 0.55 AS enrich FROM v_evaluations")
def f13(s, d):
    e = V.evaluations(s, d, False)
    return e.select("evaluation_id", E.should_enrich(F.when(F.col("status") == "P", "seek_more_evidence").otherwise("publishable"), F.col("composite")).alias("enrich"))


@query("f15_hot_members", "SELECT l_orderkey AS id, l_linenumber AS line, l_returnflag IN ('A', 'N') AND l_linestatus <> 'O' AS hot FROM lineitem")
def f15(s, d):
    role = F.when(F.col("l_returnflag") == "A", "core").when(F.col("l_returnflag") == "N", "spillover")
    membership = F.when(F.col("l_linestatus") == "O", "excluded_to_main").otherwise("member")
    return V.table(s, d, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("line"), E.is_hot_member(role, membership).alias("hot"))


@query("v03_voice_coverage", "SELECT l_orderkey AS cluster_id, ['official_direct', 'direct_quote', 'country_editorial', 'secondary_only', 'missing'][CAST(min(CASE WHEN l_linenumber <= 4 THEN 5 - l_linenumber ELSE 5 END) AS BIGINT)] AS coverage FROM lineitem GROUP BY 1")
def v03(s, d):
    kind = V.pick(("x", "secondary_only", "country_editorial", "direct_quote", "official_direct"), F.least(F.col("l_linenumber"), F.lit(5)) % 5)
    return E.voice_coverage(V.table(s, d, "lineitem").select(F.col("l_orderkey").alias("cluster_id"), kind.alias("kind")), ["cluster_id"], "kind")


@query("v01_voice_targets", """WITH t AS (SELECT l_orderkey AS cluster_id, 'P' || l_partkey % 4 AS label, l_returnflag AS region, l_suppkey % 3 AS priority, ((l_linenumber * 1000000 + l_partkey) * 10000 + l_suppkey) AS pos FROM lineitem),
 f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY cluster_id, lower(label), region ORDER BY priority, pos) AS r FROM t) WHERE r = 1),
 b AS (SELECT *, min(priority) OVER (PARTITION BY cluster_id) AS best FROM f), p AS (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY pos) AS place FROM b WHERE priority = best) SELECT cluster_id, label, region, place FROM p WHERE place <= 3""")
def v01(s, d):
    t = V.table(s, d, "lineitem")
    rows = t.select(F.col("l_orderkey").alias("cluster_id"), F.concat(F.lit("P"), (F.col("l_partkey") % 4).cast("string")).alias("label"), F.col("l_returnflag").alias("region"), (F.col("l_suppkey") % 3).alias("priority"), line_pos().alias("pos"))
    return E.voice_targets(rows)


@query("j17_domain_suffix", "WITH h AS (SELECT DISTINCT regexp_replace(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]*)', 1)), '^www\\.', '') AS host FROM pages), r AS (SELECT unnest(['com', 'example.com', 'org']) AS domain), m AS (SELECT host, domain, row_number() OVER (PARTITION BY host ORDER BY length(domain) DESC) AS k FROM h JOIN r ON host = domain OR host LIKE '%.' || domain) SELECT host, domain FROM m WHERE k = 1")
def j17(s, d):
    hosts = V.table(s, d, "pages").select(X.host(F.col("url")).alias("host")).distinct()
    registry = s.createDataFrame([("com",), ("example.com",), ("org",)], "domain string")
    return E.suffix_join(hosts, "host", registry, "domain").select("host", "domain")


@query("v07_accept_results", f"WITH c AS (SELECT *, {_REASON} AS reason FROM events), p AS (SELECT *, sum(CASE WHEN reason IS NULL THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM c) SELECT event_id, CASE WHEN reason IS NOT NULL THEN 'rejected' WHEN k <= 2 THEN 'accepted' ELSE 'surplus' END AS decision FROM p")
def v07(s, d):
    return E.accepted_first(_candidates(s, d), "user_id", "reason", ["event_id"], 2).select("event_id", "decision")


@query("v12_placeholders", f"WITH t AS (SELECT DISTINCT user_id, event_type FROM events), k AS (SELECT DISTINCT user_id, event_type FROM events WHERE ({_REASON}) IS NULL) SELECT t.user_id, t.event_type, 'placeholder:' || t.user_id || '-' || t.event_type AS url FROM t LEFT JOIN k ON k.user_id = t.user_id AND k.event_type = t.event_type WHERE k.user_id IS NULL")
def v12(s, d):
    types = V.table(s, d, "events").select("event_id", "event_type")
    c = _candidates(s, d).join(types, "event_id")
    return E.placeholders(c.select("user_id", "event_type").distinct(), c.where("reason IS NULL"), ["user_id", "event_type"])


@query("r02_consume_urls", """WITH c AS (SELECT l_orderkey AS cluster_id, l_suppkey % 3 AS source, ((l_linenumber * 1000000 + l_partkey) * 10000 + l_suppkey) AS pos, row_number() OVER (PARTITION BY l_orderkey, l_suppkey % 3 ORDER BY ((l_linenumber * 1000000 + l_partkey) * 10000 + l_suppkey)) AS k FROM lineitem),
 u AS (SELECT l_orderkey AS cluster_id, l_suppkey % 3 AS source, 'u' || l_partkey AS url, row_number() OVER (PARTITION BY l_orderkey, l_suppkey % 3 ORDER BY ((l_linenumber * 1000000 + l_partkey) * 10000 + l_suppkey)) AS k, count(*) OVER (PARTITION BY l_orderkey, l_suppkey % 3) AS n FROM lineitem WHERE l_linenumber <= 4),
 o AS (SELECT cluster_id, source, url FROM u WHERE n = 1) SELECT c.cluster_id, c.source, c.pos, coalesce(o.url, u.url) AS url, o.url IS NULL AND u.url IS NULL AS ambiguous FROM c LEFT JOIN u ON u.cluster_id = c.cluster_id AND u.source = c.source AND u.k = c.k LEFT JOIN o ON o.cluster_id = c.cluster_id AND o.source = c.source""")
def r02(s, d):
    lines = V.table(s, d, "lineitem").select(F.col("l_orderkey").alias("cluster_id"), (F.col("l_suppkey") % 3).alias("source"), "l_linenumber", line_pos().alias("pos"), F.concat(F.lit("u"), F.col("l_partkey").cast("string")).alias("url"))
    claims = lines.select("cluster_id", "source", "pos")
    return E.consume_urls(claims, lines.where("l_linenumber <= 4").select("cluster_id", "source", "url", F.col("pos").alias("upos")), ["cluster_id", "source"])


@query("r06_footer_sources", """WITH b AS (SELECT l_orderkey AS cluster_id, l_suppkey AS source, 0 AS part, l_linenumber AS pos FROM lineitem WHERE l_linestatus = 'F' UNION ALL SELECT l_orderkey, l_suppkey, 1, l_linenumber FROM lineitem WHERE l_returnflag = 'N'),
 f AS (SELECT cluster_id, source, min((part, pos)) AS place_at FROM b GROUP BY 1, 2) SELECT cluster_id, source, row_number() OVER (PARTITION BY cluster_id ORDER BY place_at, source) AS place FROM f""")
def r06(s, d):
    lines = V.table(s, d, "lineitem").select(F.col("l_orderkey").alias("cluster_id"), F.col("l_suppkey").alias("source"), F.col("l_linenumber").alias("pos"), "l_linestatus", "l_returnflag")
    return E.ordered_union([lines.where("l_linestatus = 'F'"), lines.where("l_returnflag = 'N'")], "cluster_id", "source", "pos")


@query("r12_day_links", "WITH x AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS d FROM orders) SELECT CAST(d AS VARCHAR) AS day, CAST(lag(d) OVER (ORDER BY d) AS VARCHAR) AS previous, CAST(lead(d) OVER (ORDER BY d) AS VARCHAR) AS next FROM x")
def r12(s, d):
    return E.day_links(V.table(s, d, "orders").select(F.col("o_orderdate").cast("date").cast("string").alias("day")), "day")


@query("r14_numbered_digest", "SELECT evaluation_id, row_number() OVER w AS number, lag(display_category) OVER w IS DISTINCT FROM display_category AS header FROM v_evaluations WINDOW w AS (PARTITION BY report_date ORDER BY display_category, composite DESC, evaluation_id)")
def r14(s, d):
    t = V.evaluations(s, d, False)
    return E.numbered_digest(t, "report_date", "display_category", ["display_category", F.desc("composite"), "evaluation_id"]).select("evaluation_id", "number", "header")


@query("d28_fill_sources", "WITH s AS (SELECT DISTINCT l_orderkey AS cluster_id, l_suppkey % 5 AS source_name FROM lineitem), p AS (SELECT l_orderkey AS cluster_id, l_suppkey % 5 AS source_name, 't' || min(((l_linenumber * 1000000 + l_partkey) * 10000 + l_suppkey)) AS text FROM lineitem WHERE l_linestatus = 'O' GROUP BY 1, 2) SELECT s.cluster_id, s.source_name, coalesce(p.text, 'no view') AS text FROM s LEFT JOIN p ON p.cluster_id = s.cluster_id AND p.source_name = s.source_name")
def d28(s, d):
    lines = V.table(s, d, "lineitem").select(F.col("l_orderkey").alias("cluster_id"), (F.col("l_suppkey") % 5).alias("source_name"), F.concat(F.lit("t"), line_pos().cast("string")).alias("text"), line_pos().alias("pos"), "l_linestatus")
    return E.fill_sources(lines.where("l_linestatus = 'O'"), lines, "cluster_id", "no view")


@query("d29_claimed_once", "SELECT l_suppkey AS article_id, min(l_orderkey) AS entry FROM lineitem GROUP BY 1")
def d29(s, d):
    return E.claimed_once(V.table(s, d, "lineitem").select(F.col("l_orderkey").alias("entry"), F.col("l_suppkey").alias("article_id")))


@query("z13_source_health", "SELECT event_type AS source_name, CASE max(CASE WHEN value >= 5 AND event_id % 4 > 0 THEN 3 WHEN value >= 5 THEN 2 ELSE 1 END) WHEN 3 THEN 'ok' WHEN 2 THEN 'empty' ELSE 'error' END AS state, CAST(sum(event_id % 4) AS BIGINT) AS items FROM events GROUP BY 1")
def z13(s, d):
    rows = V.table(s, d, "events").select(F.col("event_type").alias("source_name"), (F.col("value") >= 5).alias("ok"), (F.col("event_id") % 4).alias("items"), F.col("value").alias("ms"))
    return E.health(rows).select("source_name", "state", "items")


@query("s23_report_json", "SELECT id, len(article_ids) AS members, topic_category AS topic FROM v_clusters")
def s23(s, d):
    c = V.clusters(s, d)
    written = c.select(F.to_json(F.struct("id", F.struct(F.col("topic_category").alias("topic"), "article_ids").alias("cluster"))).alias("doc"))
    read = written.select(F.from_json("doc", "id bigint, cluster struct<topic:string,article_ids:array<bigint>>").alias("r"))
    return read.select("r.id", F.size("r.cluster.article_ids").cast("bigint").alias("members"), "r.cluster.topic")


@query("s23_report_files", "SELECT id, len(article_ids) AS members, topic_category AS topic, CAST(report_date AS VARCHAR) AS date FROM v_clusters WHERE report_date BETWEEN DATE '1995-01-01' AND DATE '1995-12-31'")
def s23_files(s, d):
    """Reports as files by date, written to the shared folder and read back for one year."""
    import uuid

    from tidewire.runtime import keep, scratch_root
    from tidewire.sources import feeds as I

    root = f"{scratch_root(s)}/reports-{uuid.uuid4().hex}"
    keep(s, root)
    c = V.clusters(s, d)
    I.write_reports(c.select(F.col("report_date").alias("date"), "id", F.struct(F.col("topic_category").alias("topic"), "article_ids").alias("cluster")).withColumn("date", F.trunc("date", "month")), root)
    read = I.read_reports(s, root, "id bigint, cluster struct<topic:string,article_ids:array<bigint>>", ("1995-01-01", "1995-12-31"))
    day = c.select("id", F.col("report_date").cast("string").alias("date"))
    return read.select("id", F.size("cluster.article_ids").cast("bigint").alias("members"), "cluster.topic").join(day, "id")


@query("a19_summary_counts", "SELECT m.cluster_id, count(*) AS sources, count(DISTINCT s.region) AS regions, count(*) FILTER (s.ownership LIKE 'independent%') AS independent FROM v_members m JOIN v_sources s ON s.source_id = m.source_id GROUP BY 1")
def a19(s, d):
    m = V.members(s, d).join(V.sources(s, d), "source_id")
    return m.groupBy("cluster_id").agg(F.count("*").alias("sources"), F.countDistinct("region").alias("regions"), F.count_if(F.col("ownership").startswith("independent")).alias("independent"))


@query("c03_subject_regions", "SELECT evaluation_id, array_to_string(subject_regions, ',') AS regions FROM v_evaluations")
def c03(s, d):
    raw = F.concat(F.transform("subject_regions", lambda r: F.concat(F.lit(" "), F.upper(r))), F.array(F.lit(""), F.lit(" ")), F.col("subject_regions"))
    return V.evaluations(s, d, False).select("evaluation_id", F.array_join(S.normalised_regions(raw), ",").alias("regions"))


@query("m07_append_version", "SELECT c_custkey AS version, c_name AS content FROM customer UNION ALL SELECT (SELECT max(c_custkey) FROM customer) + 1, 'memo'")
def m07b(s, d):
    rows = V.table(s, d, "customer").select(F.col("c_custkey").alias("version"), F.col("c_name").alias("content"))
    return M.append_version(rows, s.createDataFrame([("memo",)], "content string"))


@query("m09_placeholder_repair", "SELECT id, url LIKE 'placeholder:%' OR id % 9 = 0 AS is_placeholder FROM v_articles")
def m09(s, d):
    return V.articles(s, d).select("id", X.is_placeholder(F.concat(F.lit(" "), F.upper("url")), F.col("id") % 9 == 0).alias("is_placeholder"))


@query("d02_true_cosine", "SELECT a.vec_id AS a, round(list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda z: z[1]::DOUBLE * z[2]::DOUBLE)) / sqrt(list_sum(list_transform(a.embedding, lambda x: x::DOUBLE * x::DOUBLE))) / sqrt(list_sum(list_transform(b.embedding, lambda x: x::DOUBLE * x::DOUBLE))), 5) AS cosine FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 7")
def d02(s, d):
    e = V.table(s, d, "embeddings")
    other = e.select((F.col("vec_id") - 7).alias("a"), F.col("embedding").alias("vb"))
    return e.withColumnRenamed("vec_id", "a").join(other, "a").select("a", F.round(Y.cosine(F.col("embedding"), F.col("vb")), 5).alias("cosine"))


@query("w03_one_per_source", "SELECT l_orderkey AS cluster_id, l_suppkey AS source, l_linenumber AS line FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_suppkey ORDER BY l_shipdate DESC, l_linenumber) AS r FROM lineitem) WHERE r = 1")
def w03(s, d):
    lines = V.table(s, d, "lineitem").select(F.col("l_orderkey").alias("cluster_id"), F.col("l_suppkey").alias("source"), F.col("l_linenumber").alias("line"), "l_shipdate")
    return T.per_group(lines, ["cluster_id", "source"], [F.desc("l_shipdate"), "line"], 1).select("cluster_id", "source", "line")


@query("z12_token_usage", "SELECT event_id AS id, coalesce(TRY_CAST(json_extract_string(props, '$.k') AS BIGINT), 0) AS tokens, length(props) AS chars FROM events")
def z12(s, d):
    return V.table(s, d, "events").select(F.col("event_id").alias("id"), F.coalesce(F.get_json_object("props", "$.k").try_cast("bigint"), F.lit(0)).alias("tokens"), F.length("props").cast("bigint").alias("chars"))


@query("r13_seo_titles", "SELECT id, CASE WHEN length(trim(regexp_replace(title, '[ \\t\\n\\f\\r\\v]+', ' ', 'g'))) <= 70 THEN trim(regexp_replace(title, '[ \\t\\n\\f\\r\\v]+', ' ', 'g')) ELSE rtrim(substr(trim(regexp_replace(title, '[ \\t\\n\\f\\r\\v]+', ' ', 'g')), 1, 69)) || '…' END AS seo FROM v_titles")
def r13(s, d):
    return V.titles(s, d).select("id", X.preview(F.col("title"), 70).alias("seo"))


@query("z01_audit_window", "SELECT count(*) AS clusters, min(CAST(report_date AS VARCHAR)) AS first, max(CAST(report_date AS VARCHAR)) AS last FROM v_clusters WHERE report_date BETWEEN DATE '1996-07-09' AND DATE '1996-07-15'")
def z01(s, d):
    c = M.recent_clusters(V.clusters(s, d), "1996-07-16", 7)
    return c.agg(F.count("*").alias("clusters"), F.min(F.col("report_date").cast("string")).alias("first"), F.max(F.col("report_date").cast("string")).alias("last"))
