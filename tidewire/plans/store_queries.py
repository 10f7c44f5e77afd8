"""Queries on the store, its updates, storyline history and display functions, each with the SQL it must agree with."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewire.functions import display as D
from tidewire.operators import catalogue as K
from tidewire.operators import history as H
from tidewire.operators import scoring as S
from tidewire.operators import selection as T
from tidewire.operators.maintenance import insert_new, retain
from tidewire.operators.rounds import dense_places
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


@query("s03_article_by_url", "SELECT page_id FROM pages WHERE url = (SELECT max(url) FROM pages)")
def s03(s, d):
    pages = V.table(s, d, "pages")
    return K.by_key(pages, "url", pages.agg(F.max("url")).first()[0]).select("page_id")


@query("s10_review_by_id", "SELECT event_id, event_type, user_id FROM events WHERE event_id = 77")
def s10(s, d):
    return K.by_key(V.table(s, d, "events"), "event_id", 77).select("event_id", "event_type", "user_id")


@query("k02_insert_clusters", "SELECT c_custkey AS id, c_name AS name FROM customer UNION ALL SELECT (SELECT max(c_custkey) FROM customer) + row_number() OVER (ORDER BY s_suppkey), s_name FROM supplier")
def k02(s, d):
    c = V.table(s, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))
    return K.append_numbered(c, V.table(s, d, "supplier").select("s_suppkey", F.col("s_name").alias("name")), ["s_suppkey"])


@query("k04_append_telemetry", "WITH o AS (SELECT event_id AS id, event_type AS stage, ts AS created_at FROM events) SELECT id, stage, CAST(created_at AS VARCHAR)[1:19] AS created_at FROM o UNION ALL SELECT (SELECT max(id) FROM o) + row_number() OVER (ORDER BY id), stage, CASE WHEN id % 2 = 0 THEN CAST(created_at AS VARCHAR)[1:19] ELSE '2024-06-01 00:00:00' END FROM o WHERE stage = 'click'")
def k04(s, d):
    e = V.table(s, d, "events").select(F.col("event_id").alias("id"), F.col("event_type").alias("stage"), F.col("ts").alias("created_at"))
    new = e.where("stage = 'click'").withColumn("created_at", F.coalesce(F.when(F.col("id") % 2 == 0, F.col("created_at")), F.lit("2024-06-01 00:00:00").cast("timestamp")))
    return K.append_numbered(e, new.withColumnRenamed("id", "old"), ["old"]).withColumn("created_at", F.date_format("created_at", "yyyy-MM-dd HH:mm:ss"))


@query("k05_insert_reviews", "WITH o AS (SELECT event_type || '|' || user_id || '|' || coalesce(props, '') AS triple, event_id FROM events), h AS (SELECT triple, event_id FROM o WHERE event_id % 3 = 0), n AS (SELECT triple, min(event_id) AS event_id FROM o WHERE event_id % 3 <> 0 AND triple NOT IN (SELECT triple FROM h) GROUP BY 1) SELECT * FROM h UNION ALL SELECT * FROM n")
def k05(s, d):
    o = V.table(s, d, "events").select(F.concat_ws("|", "event_type", F.col("user_id").cast("string"), F.coalesce("props", F.lit(""))).alias("triple"), "event_id")
    return insert_new(o.where("event_id % 3 = 0"), o.where("event_id % 3 <> 0"), "triple", ["event_id"])


@query("k10_report_retention", "SELECT DISTINCT CAST(o_orderdate AS DATE)::VARCHAR AS day FROM orders WHERE CAST(o_orderdate AS DATE) >= DATE '1998-06-01' - 90 OR dayofmonth(CAST(o_orderdate AS DATE)) = 1")
def k10(s, d):
    days = V.table(s, d, "orders").select(F.col("o_orderdate").cast("date").alias("d")).distinct().withColumn("t", F.col("d").cast("timestamp"))
    now = F.lit("1998-06-01 00:00:00").cast("timestamp")
    return retain(days, "t", now, 90, F.dayofmonth("d") == 1).select(F.col("d").cast("string").alias("day"))


@query("m04_link_evaluations", "SELECT o_orderkey AS id, CASE WHEN o_orderkey % 4 = 0 THEN o_custkey ELSE NULL END AS cluster_id, o_orderkey % 4 = 0 AND o_orderkey % 8 <> 0 AS selected FROM orders")
def m04(s, d):
    rows = V.table(s, d, "orders").select(F.col("o_orderkey").alias("id"), F.lit(None).cast("bigint").alias("cluster_id"), F.lit(False).alias("selected"))
    links = V.table(s, d, "orders").where("o_orderkey % 4 = 0").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("cluster_id"), (F.col("o_orderkey") % 8 != 0).alias("selected"))
    return K.link(rows, links, ["id"], ["cluster_id", "selected"])


@query("m12_call_status", "SELECT event_id AS id, CASE WHEN event_id % 5 = 0 THEN 'parse_failed' ELSE 'ok' END AS status FROM events")
def m12(s, d):
    rows = V.table(s, d, "events").select(F.col("event_id").alias("id"), F.lit("ok").alias("status"))
    return K.link(rows, rows.where("id % 5 = 0").withColumn("status", F.lit("parse_failed")), ["id"], ["status"])


def _weights(s, d):
    return V.table(s, d, "nation").select(F.col("n_name").alias("dimension"), (F.col("n_nationkey") / 100.0).alias("weight"), (F.col("n_regionkey") / 100.0).alias("seed"))


_W = "w AS (SELECT n_name AS dimension, n_nationkey / 100.0::DOUBLE AS weight, n_regionkey / 100.0::DOUBLE AS seed FROM nation)"


@query("m06_seed_weights", f"WITH {_W} SELECT * FROM w UNION ALL SELECT r_name, 0.5::DOUBLE, 0.5::DOUBLE FROM region")
def m06(s, d):
    seeds = V.table(s, d, "region").select(F.col("r_name").alias("dimension"), F.lit(0.5).alias("weight"))
    return K.seeded(_weights(s, d), seeds.unionByName(_weights(s, d).select("dimension", F.lit(0.9).alias("weight"))))


@query("m06_weight_updates", f"WITH {_W}, c AS (SELECT dimension, 0.25::DOUBLE AS new_weight FROM w WHERE seed = 0.02 UNION ALL SELECT 'fresh', 0.25::DOUBLE) SELECT 'weight' AS part, w.dimension, coalesce(c.new_weight, w.weight) AS a, w.seed AS b FROM w LEFT JOIN c ON c.dimension = w.dimension UNION ALL SELECT 'weight', 'fresh', 0.25::DOUBLE, 0.25::DOUBLE UNION ALL SELECT 'log', c.dimension, coalesce(w.weight, 0), c.new_weight FROM c LEFT JOIN w ON w.dimension = c.dimension")
def m06b(s, d):
    w = _weights(s, d)
    changes = w.where("seed = 0.02").select("dimension").union(s.createDataFrame([("fresh",)], "dimension string")).select("dimension", F.lit(0.25).alias("new_weight"), F.lit("weekly").alias("reason"))
    new, log = K.updated_weights(w, changes)
    return new.select(F.lit("weight").alias("part"), "dimension", F.col("weight").alias("a"), F.col("seed").alias("b")).unionByName(log.select(F.lit("log").alias("part"), "dimension", F.col("old_weight").alias("a"), F.col("new_weight").alias("b")))


@query("z04_reset_weights", f"WITH {_W} SELECT 'weight' AS part, dimension, seed AS a FROM w UNION ALL SELECT 'log', dimension, weight FROM w WHERE weight <> seed")
def z04(s, d):
    new, log = K.reset_weights(_weights(s, d))
    return new.select(F.lit("weight").alias("part"), "dimension", F.col("weight").alias("a")).unionByName(log.select(F.lit("log").alias("part"), "dimension", F.col("old_weight").alias("a")))


def _reviews(s, d):
    p = F.col("pos")
    return V.search_articles(s, d).select(
        F.col("pos").alias("id"), F.concat(F.when(p % 2 == 0, "WWW.").otherwise(""), F.lit("site"), (p % 40).cast("string"), F.lit(".example ")).alias("domain"), "region", F.upper("region").alias("target_region"), F.concat(F.lit("Label "), (p % 6).cast("string")).alias("target_label"),
        V.pick(("official_web", "country_editorial", "official_social"), p % 3).alias("verdict"), V.pick(("pending_review", "accepted", "pending_review", "rejected"), p % 4).alias("decision"), F.when(p % 5 == 0, '{"publisher_region":"us"}').when(p % 5 == 1, "{}").alias("identity_evidence"), F.lit("r").alias("reason"))


_REVIEWS = "rv AS (SELECT pos AS id, 'site' || pos % 40 || '.example' AS domain, region, 'Label ' || pos % 6 AS label, ['official_web', 'country_editorial', 'official_social'][CAST(pos % 3 + 1 AS BIGINT)] AS verdict, ['pending_review', 'accepted', 'pending_review', 'rejected'][CAST(pos % 4 + 1 AS BIGINT)] AS decision, CASE WHEN pos % 5 = 0 THEN 'us' ELSE '' END AS publisher FROM v_search)"


@query("m10_review_decisions", f"WITH {_REVIEWS}, k AS (SELECT id, max(CASE WHEN decision = 'pending_review' THEN 1 ELSE 0 END) AS p FROM rv GROUP BY 1 HAVING count(*) = 1) SELECT k.id, CASE WHEN p = 1 THEN 'accepted' ELSE rv.decision END AS decision, CASE WHEN p = 1 THEN 'approved_by_editor' ELSE 'r' END AS reason FROM k JOIN rv ON rv.id = k.id")
def m10(s, d):
    r = _reviews(s, d)
    once = r.join(r.groupBy("id").count().where("count = 1").select("id"), "id").select("id", "decision", "reason")
    return K.decided(once, once.where("decision = 'pending_review'").select("id", F.lit("accepted").alias("decision"), F.lit("approved_by_editor").alias("reason")))


@query("m11_promoted_bindings", f"WITH {_REVIEWS}, o AS (SELECT domain, id, verdict, region, CASE WHEN verdict = 'official_web' THEN label END AS entity FROM rv WHERE decision = 'pending_review' AND verdict <> 'official_social' AND (publisher = '' OR publisher = region)), m AS (SELECT domain, max(id) AS id FROM o GROUP BY 1) SELECT o.domain, o.verdict, o.region, o.entity FROM o JOIN m ON m.domain = o.domain AND m.id = o.id")
def m11(s, d):
    return K.promotable(_reviews(s, d))


@query("v10_binding_registry", f"WITH {_REVIEWS}, o AS (SELECT domain, id, verdict, region, CASE WHEN verdict = 'official_web' THEN label END AS entity FROM rv WHERE decision = 'pending_review' AND verdict <> 'official_social' AND (publisher = '' OR publisher = region)), m AS (SELECT domain, max(id) AS id FROM o GROUP BY 1), p AS (SELECT o.domain, o.verdict, o.region, o.entity FROM o JOIN m ON m.domain = o.domain AND m.id = o.id), c AS (SELECT 'site' || n_nationkey || '.example' AS domain, 'country_editorial' AS verdict, 'xx' AS region, NULL AS entity FROM nation) SELECT * FROM p UNION ALL SELECT * FROM c WHERE domain NOT IN (SELECT domain FROM p)")
def v10(s, d):
    configured = V.table(s, d, "nation").select(F.concat(F.lit("site"), F.col("n_nationkey").cast("string"), F.lit(".example")).alias("domain"), F.lit("country_editorial").alias("verdict"), F.lit("xx").alias("region"), F.lit(None).cast("string").alias("entity"))
    return K.with_bindings(configured.limit(0), configured, K.promotable(_reviews(s, d)))


@query("j03_corrections", "SELECT event_id AS id, event_type AS kind, round(o_totalprice, 2) AS composite, o_orderpriority AS display_category FROM events JOIN orders ON o_orderkey = user_id WHERE ts >= TIMESTAMP '2024-01-10 00:00:00'")
def j03(s, d):
    e = V.table(s, d, "events").where(F.col("ts") >= F.lit("2024-01-10 00:00:00").cast("timestamp")).select(F.col("event_id").alias("id"), F.col("event_type").alias("kind"), F.col("user_id").alias("o_orderkey"))
    return e.join(V.table(s, d, "orders"), "o_orderkey").select("id", "kind", F.round("o_totalprice", 2).alias("composite"), F.col("o_orderpriority").alias("display_category"))


@query("j04_correction_verdicts", "SELECT event_id AS id, CASE WHEN event_id % 3 = 0 THEN 1 ELSE -1 END AS verdict, o_orderpriority AS display_category FROM events JOIN orders ON o_orderkey = user_id WHERE event_id % 3 < 2")
def j04(s, d):
    e = V.table(s, d, "events").select(F.col("event_id").alias("id"), V.pick(("promote", "demote", "dimension"), F.col("event_id") % 3).alias("kind"), F.col("user_id").alias("evaluation_id"))
    o = V.table(s, d, "orders").select(F.col("o_orderkey").alias("id_evaluation"), F.col("o_orderpriority").alias("display_category"))
    return K.correction_verdicts(e, o).select("id", "verdict", "display_category")


@query("j22_rejoined_answers", "SELECT conv_id AS batch, turn AS idx, CASE WHEN turn % 4 <> 1 THEN CASE WHEN turn % 4 = 2 THEN ' ' ELSE role END END AS answer, turn % 4 IN (1, 2) AS missing FROM conversations")
def j22(s, d):
    c = V.table(s, d, "conversations").select(F.col("conv_id").alias("batch"), F.col("turn").alias("idx"), "role")
    return K.rejoined(c.select("batch", "idx"), c.where("idx % 4 <> 1").select("batch", "idx", F.when(F.col("idx") % 4 == 2, " ").otherwise(F.col("role")).alias("answer")), ["batch", "idx"], "answer")


@query("w09_batches", "SELECT o_orderkey AS id, CAST((row_number() OVER (PARTITION BY CAST(o_orderdate AS DATE) ORDER BY o_orderkey) - 1) // 2 AS BIGINT) AS batch FROM orders")
def w09(s, d):
    o = V.table(s, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderdate").cast("date").alias("day"))
    return T.batches(o, ["day"], ["id"], 2).select("id", "batch")


@query("c01_weights", "WITH x AS (SELECT n_name AS dimension, CASE WHEN n_nationkey % 3 = 0 THEN n_nationkey / 100.0::DOUBLE ELSE 0.2::DOUBLE END AS w FROM nation) SELECT dimension, round(w / sum(w) OVER (), 9) AS weight FROM x")
def c01(s, d):
    n = V.table(s, d, "nation")
    seeds = n.select(F.col("n_name").alias("dimension"), F.lit(0.2).alias("seed"))
    live = n.where("n_nationkey % 3 = 0").select(F.col("n_name").alias("dimension"), (F.col("n_nationkey") / 100.0).alias("weight"))
    return S.live_weights(seeds, live).select("dimension", F.round("weight", 9).alias("weight"))


_SIG = "sig AS (SELECT o_orderkey AS id, least(1.0::DOUBLE, o_totalprice / 500000) AS signal, o_orderkey % 3 = 0 AS judged, CAST(o_orderkey % 12 AS DOUBLE) AS severity FROM orders)"


@query("c06_degraded_assessment", f"WITH {_SIG} SELECT id, judged AS evaluated, round(CASE WHEN judged THEN least(1.0::DOUBLE, 0.24::DOUBLE * signal + 0.16::DOUBLE * least(10.0::DOUBLE, severity) / 10) ELSE signal END + 1e-9::DOUBLE, 6) AS composite, CASE WHEN judged THEN CASE WHEN least(1.0::DOUBLE, 0.24::DOUBLE * signal + 0.16::DOUBLE * least(10.0::DOUBLE, severity) / 10) < 0.18 THEN 'suppress' WHEN least(1.0::DOUBLE, 0.24::DOUBLE * signal + 0.16::DOUBLE * least(10.0::DOUBLE, severity) / 10) < 0.34 THEN 'needs_review' ELSE 'publishable' END ELSE 'publishable' END AS status FROM sig")
def c06(s, d):
    o = V.table(s, d, "orders").select(F.col("o_orderkey").alias("id"), F.least(F.lit(1.0), F.col("o_totalprice") / 500000).alias("signal"), F.array().cast("array<string>").alias("flags"))
    items = V.table(s, d, "orders").where("o_orderkey % 3 = 0").select(F.col("o_orderkey").alias("id"), F.lit(0.0).alias("scope"), (F.col("o_orderkey") % 12).cast("double").alias("severity"), *[F.lit(0.0).alias(x) for x in ("novelty", "actor_influence", "decision_relevance", "feelgood")])
    return S.assessed(o, items, S.SEEDS).select("id", "evaluated", F.round(F.col("composite") + 1e-9, 6).alias("composite"), "status")


@query("t06_cluster_order", "SELECT cluster_id, row_number() OVER (ORDER BY count(DISTINCT s.region) DESC, count(DISTINCT m.source_id) DESC, count(*) DESC, cluster_id) AS place FROM v_members m JOIN v_sources s ON s.source_id = m.source_id GROUP BY 1")
def t06(s, d):
    """Places come from ranges of the order; a window over all clusters would hold them in one task."""
    kinds = lambda c: F.size(F.collect_set(c))
    m = V.members(s, d).join(V.sources(s, d).select("source_id", "region"), "source_id").groupBy("cluster_id").agg(kinds("region").alias("regions"), kinds("source_id").alias("sources"), F.count("*").alias("articles"))
    placed = dense_places(m, F.desc("regions"), F.desc("sources"), F.desc("articles"), F.col("cluster_id"))
    return placed.select("cluster_id", F.col("place").cast("int").alias("place"))


@query("t04_summary_families", "WITH r AS (SELECT o_custkey AS family, o_orderkey AS idx FROM orders WHERE o_orderstatus <> 'P'), g AS (SELECT family, count(*) AS members, min(idx) AS first FROM r GROUP BY 1 HAVING count(*) >= 2) SELECT family, members FROM g ORDER BY members DESC, first LIMIT 3")
def t04(s, d):
    o = V.table(s, d, "orders").select(F.col("o_custkey").alias("family"), F.col("o_orderkey").alias("idx"), F.when(F.col("o_orderstatus") == "P", "stale").otherwise("new").alias("freshness"))
    return T.summary_families(o, "family", "idx", "freshness")


@query("t07_stripped_families", "WITH h AS (SELECT o_custkey AS family, o_orderkey AS id FROM orders), p AS (SELECT o_orderkey AS id FROM orders WHERE o_orderkey % 3 = 0), k AS (SELECT family, id FROM h WHERE id NOT IN (SELECT id FROM p)), n AS (SELECT family FROM k GROUP BY 1 HAVING count(*) >= 2) SELECT k.family, k.id FROM k JOIN n ON n.family = k.family")
def t07(s, d):
    o = V.table(s, d, "orders").select(F.col("o_custkey").alias("family"), F.col("o_orderkey").alias("id"))
    return T.stripped(o, o.where("id % 3 = 0").select("id"), "family", "id")


_NAMED = "['美联储宣布维持利率', '俄乌停火谈判', 'tariff hike on steel', '', 'ab 经济']"
_TEXTS = "['英国央行维持利率不变', '俄乌双方重启谈判', 'steel tariff talks stall', 'Fed holds rates', '经济 ab cd']"


@query("d20_name_fits", f"""WITH x AS (SELECT o_orderkey AS id, {_NAMED}[CAST(o_orderkey % 5 + 1 AS BIGINT)] AS n, {_TEXTS}[CAST(o_orderkey // 5 % 5 + 1 AS BIGINT)] AS t FROM orders),
 k AS (SELECT id, list_distinct(list_transform(regexp_extract_all(n, '([\\x{{4e00}}-\\x{{9fff}}]|[a-zA-Z]{{2,}})', 1), lambda z: lower(z))) AS a, list_distinct(list_transform(regexp_extract_all(t, '([\\x{{4e00}}-\\x{{9fff}}]|[a-zA-Z]{{2,}})', 1), lambda z: lower(z))) AS b, regexp_extract_all(n, '([\\x{{4e00}}-\\x{{9fff}}])', 1) AS c, regexp_extract_all(t, '([\\x{{4e00}}-\\x{{9fff}}])', 1) AS e FROM x)
 SELECT id, CASE WHEN len(a) = 0 OR len(b) = 0 THEN false WHEN (len(c) > 0) <> (len(e) > 0) THEN true ELSE (len(c) < 3 OR list_has_any(c[1:3], e)) AND len(list_intersect(a, b)) / len(a) >= 0.18 END AS fits FROM k""")
def d20(s, d):
    names, texts = ("美联储宣布维持利率", "俄乌停火谈判", "tariff hike on steel", "", "ab 经济"), ("英国央行维持利率不变", "俄乌双方重启谈判", "steel tariff talks stall", "Fed holds rates", "经济 ab cd")
    o = V.table(s, d, "orders")
    return o.select(F.col("o_orderkey").alias("id"), H.name_fits(V.pick(names, F.col("o_orderkey") % 5), V.pick(texts, F.expr("o_orderkey div 5") % 5)).alias("fits"))


def _stories(s, d):
    o = V.table(s, d, "orders")
    return o.select(F.col("o_orderkey").alias("id"), F.concat(F.lit("k"), F.col("o_custkey").cast("string")).alias("key"), F.col("o_orderdate").cast("date").alias("day"), F.when(F.col("o_orderkey") % 4 == 0, "steel tariff").otherwise("river flood").alias("name"), F.concat(F.lit("river flood "), "o_orderpriority").alias("text"))


_STORIES = "st AS (SELECT o_orderkey AS id, 'k' || o_custkey AS key, CAST(o_orderdate AS DATE) AS day, o_orderkey % 4 <> 0 AS fits FROM orders)"


@query("z05_related_history", f"WITH {_STORIES}, h AS (SELECT a.id, b.id AS h_id, b.day FROM st a JOIN st b ON b.key = a.key AND b.id % 2 = 1 WHERE a.fits AND b.fits AND a.id % 2 = 0) SELECT id, h_id, row_number() OVER (PARTITION BY id ORDER BY day DESC, h_id DESC) AS place FROM h")
def z05(s, d):
    st = _stories(s, d)
    history = st.where("id % 2 = 1").select(F.col("id").alias("h_id"), "key", F.col("name").alias("h_name"), F.col("day").alias("h_day"))
    return H.related_history(st.where("id % 2 = 0"), history)


@query("w08_timeline_with_current", f"WITH {_STORIES}, h AS (SELECT a.id, b.id AS h_id, b.day FROM st a JOIN st b ON b.key = a.key AND b.id % 2 = 1 WHERE a.fits AND b.fits AND a.id % 2 = 0), p AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY day DESC, h_id DESC) AS place FROM h), u AS (SELECT id, h_id AS event_id, day FROM p WHERE place <= 4 UNION ALL SELECT id, id, day FROM st WHERE id % 2 = 0), r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY day DESC, event_id DESC) AS k FROM u) SELECT id, event_id, CAST(day AS VARCHAR) AS day FROM r WHERE k <= 5")
def w08(s, d):
    st = _stories(s, d)
    current = st.where("id % 2 = 0")
    related = H.related_history(current, st.where("id % 2 = 1").select(F.col("id").alias("h_id"), "key", F.col("name").alias("h_name"), F.col("day").alias("h_day")))
    placed = related.join(st.select(F.col("id").alias("h_id"), F.col("day").alias("h_day")), "h_id")
    return H.timeline_with_current(current, placed).withColumn("day", F.col("day").cast("string"))


@query("j14_best_history", """WITH v AS (SELECT vec_id, embedding, DATE '2024-01-01' + CAST(vec_id % 10 AS INTEGER) AS day, vec_id % 5 < 2 AS conflict, CASE WHEN vec_id % 7 <> 0 THEN 'k' || label END AS key FROM embeddings),
 m AS (SELECT c.vec_id AS id, h.vec_id AS h_id, h.key, list_sum(list_transform(list_zip(c.embedding, h.embedding), lambda z: z[1]::DOUBLE * z[2]::DOUBLE)) AS cosine, greatest(0.0::DOUBLE, (5 - greatest(c.day - h.day, 0)) / 5::DOUBLE) * 0.08::DOUBLE AS bonus, c.conflict AND h.conflict AS shared, h.conflict AS named FROM v c JOIN v h ON h.vec_id <> c.vec_id AND h.key IS NOT NULL),
 r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY cosine + bonus DESC, h_id) AS k FROM m WHERE (NOT named OR shared) AND cosine >= CASE WHEN shared THEN 0.25 ELSE 0.3 END) SELECT id, h_id, key, round(cosine + bonus, 4) AS score FROM r WHERE k = 1""")
def j14(s, d):
    conflicts = F.when(F.col("vec_id") % 5 < 2, F.array(F.lit("x"))).otherwise(F.array().cast("array<string>")).alias("conflicts")
    v = V.table(s, d, "embeddings").select("vec_id", F.col("embedding").alias("vector"), F.date_add(F.to_date(F.lit("2024-01-01")), (F.col("vec_id") % 10).cast("int")).alias("day"), conflicts, F.when(F.col("vec_id") % 7 != 0, F.concat(F.lit("k"), F.col("label").cast("string"))).alias("key"))
    current = v.select(F.col("vec_id").alias("id"), "day", "vector", "conflicts")
    history = v.select(F.col("vec_id").alias("h_id"), F.col("day").alias("h_day"), "key", "vector", "conflicts")
    return H.best_history(current, history, 0.3, 0.25, others=True).withColumn("score", F.round("score", 4))


@query("d16_split_families")
def d16(s, d):
    v = V.table(s, d, "embeddings").select(F.col("vec_id").alias("id"), F.concat(F.lit("k"), (F.col("vec_id") % 200).cast("string")).alias("key"), F.col("embedding").alias("vector"), (F.col("vec_id") % 13 / 13.0).alias("history_score"), (F.col("vec_id") % 97 == 0).alias("conflict"))
    return H.split_families(v, 0.2)


@query("d25_merged_duplicates", "WITH m AS (SELECT CASE WHEN cluster_id % 4 = 0 THEN cluster_id + 1 ELSE cluster_id END AS cluster_id, CASE WHEN cluster_id % 4 = 0 THEN 1 ELSE 0 END AS own, pos, url, source_name FROM v_search), f AS (SELECT cluster_id, url, min((own, pos, source_name)) AS f FROM m GROUP BY 1, 2) SELECT cluster_id, row_number() OVER (PARTITION BY cluster_id ORDER BY f[1], f[2], url) AS pos, url, f[3] AS source_name FROM f")
def d25(s, d):
    v = V.search_articles(s, d)
    pairs = v.where("cluster_id % 4 = 0").select(F.col("cluster_id").alias("duplicate"), (F.col("cluster_id") + 1).alias("target")).distinct()
    return H.merged_duplicates(pairs, v)


@query("fn_locale_category", "WITH x AS (SELECT o_orderkey AS id, ['us', ' De', 'x1', '', 'fr'][CAST(o_orderkey % 5 + 1 AS BIGINT)] AS code, ['World', '商业财经', 'odd', '体育运动', ' Society ', NULL][CAST(o_orderkey % 6 + 1 AS BIGINT)] AS c FROM orders) SELECT id, CASE trim(code) WHEN 'us' THEN '🇺🇸' WHEN 'De' THEN '🇩🇪' WHEN 'fr' THEN '🇫🇷' ELSE '' END AS flag, CASE trim(c) WHEN '商业财经' THEN 'Business' WHEN '体育运动' THEN 'Culture & Sports' WHEN 'Society' THEN 'Society' ELSE 'World' END AS category, CASE trim(c) WHEN '商业财经' THEN '商业' WHEN '体育运动' THEN '文化体育' WHEN 'Society' THEN '社会' ELSE '国际' END AS label, CASE trim(c) WHEN 'World' THEN 'World' WHEN '商业财经' THEN 'Business' WHEN '体育运动' THEN 'Culture & Sports' WHEN 'Society' THEN 'Society' ELSE 'Technology' END AS broad FROM x")
def fn_locale(s, d):
    code, c = V.pick(("us", " De", "x1", "", "fr"), F.col("o_orderkey") % 5), V.pick(("World", "商业财经", "odd", "体育运动", " Society ", None), F.col("o_orderkey") % 6)
    return V.table(s, d, "orders").select(F.col("o_orderkey").alias("id"), D.flag(code).alias("flag"), D.category(c).alias("category"), D.category_label(c).alias("label"), D.broad_category(F.lit("科技创新"), c).alias("broad"))


@query("fn_sparkline", "WITH g AS (SELECT o_custkey AS id, list(o_totalprice ORDER BY o_orderkey) AS v FROM orders GROUP BY 1), k AS (SELECT id, v, list_min(v) AS lo, CASE WHEN list_max(v) = list_min(v) THEN 1.0::DOUBLE ELSE list_max(v) - list_min(v) END AS span FROM g) SELECT id, CASE WHEN len(v) < 2 THEN '' ELSE array_to_string(list_transform(range(1, len(v) + 1), lambda i: printf('%.1f,%.1f', (i - 1) * (160.0::DOUBLE / (len(v) - 1)), 32.0::DOUBLE - (v[i] - lo) / span * 28 - 2)), ' ') END AS points FROM k")
def fn_sparkline(s, d):
    o = V.table(s, d, "orders").groupBy(F.col("o_custkey").alias("id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("o_orderkey", "o_totalprice"))), lambda x: x["o_totalprice"]).alias("v"))
    return o.select("id", D.sparkline(F.col("v")).alias("points"))
