"""Queries on payloads, perspectives, storyline roles and keys."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewire.operators import displayed as U
from tidewire.operators import perspectives as E
from tidewire.operators import storyline as L
from tidewire.sources import payloads as P
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


@query("s13_hot_list", "SELECT event_id AS id, 0 AS pos, event_type || ' number ' || event_id AS content, event_id % 3 = 2 AS batch_time FROM events WHERE length(event_type || ' number ' || event_id) >= 10")
def s13(s, d):
    e = V.table(s, d, "events")
    title = F.concat("event_type", F.lit(" number "), F.col("event_id").cast("string"))
    at = F.when(F.col("event_id") % 3 == 0, F.unix_seconds("ts")).when(F.col("event_id") % 3 == 1, F.unix_millis("ts"))
    item = F.struct(title.alias("title"), F.lit("").alias("body"), at.alias("at"))
    rows = e.select(F.col("event_id").alias("id"), F.to_json(F.struct(F.array(item).alias("items"))).alias("payload"))
    out = P.hot_list(rows, "payload", F.lit("2001-01-01").cast("timestamp"))
    return out.select("id", F.col("pos").cast("int").alias("pos"), "content", (F.year("published_at") == 2001).alias("batch_time"))


@query("e08_usage_tokens", "SELECT event_id AS id, CASE event_id % 4 WHEN 0 THEN event_id WHEN 1 THEN event_id WHEN 2 THEN event_id + 1 END AS tokens FROM events")
def e08(s, d):
    i = F.col("event_id").cast("string")
    shape = F.when(F.col("event_id") % 4 == 0, F.concat(F.lit('{"usage":{"total_tokens":'), i, F.lit("}}"))).when(F.col("event_id") % 4 == 1, F.concat(F.lit('{"total_tokens":'), i, F.lit("}"))).when(F.col("event_id") % 4 == 2, F.concat(F.lit('{"usage":{"prompt_tokens":'), i, F.lit(',"completion_tokens":1}}'))).otherwise("{}")
    return V.table(s, d, "events").select(F.col("event_id").alias("id"), P.usage_tokens(shape).alias("tokens"))


@query("z16_tolerant_parse", "SELECT event_id AS id, CASE WHEN event_id % 3 < 2 THEN event_type END AS label FROM events")
def z16(s, d):
    body = F.concat(F.lit('{"label":"'), "event_type", F.lit('"}'))
    answer = F.when(F.col("event_id") % 3 == 0, body).when(F.col("event_id") % 3 == 1, F.concat(F.lit("Here it is: "), body, F.lit(" done"))).otherwise("no answer")
    return V.table(s, d, "events").select(F.col("event_id").alias("id"), P.tolerant(answer, "label string")["label"].alias("label"))


@query("j23_storyline_roles", """WITH e AS (SELECT o_orderkey AS a, o_orderkey + 4 AS b, o_orderkey % 11 = 0 AS same FROM orders WHERE o_orderkey % 2 = 0), n AS (SELECT a AS id, same FROM e UNION ALL SELECT b, same FROM e), c AS (SELECT id, bool_or(same) AS core FROM n GROUP BY 1),
 m AS (SELECT o_orderkey AS id, o_custkey AS component, coalesce(c.core, false) AS core, o_totalprice AS composite FROM orders LEFT JOIN c ON c.id = o_orderkey), k AS (SELECT component, bool_or(core) AS has, arg_min(id, (-composite, id)) AS best FROM m GROUP BY 1)
 SELECT m.id, m.component, CASE WHEN core OR (NOT has AND id = best) THEN 'core' ELSE 'spillover' END AS role FROM m JOIN k ON k.component = m.component""")
def j23(s, d):
    o = V.table(s, d, "orders")
    edges = o.where("o_orderkey % 2 = 0").select(F.col("o_orderkey").alias("a"), (F.col("o_orderkey") + 4).alias("b"), F.when(F.col("o_orderkey") % 11 == 0, "same_core_storyline").otherwise("same_direct_spillover_storyline").alias("relation"))
    return L.roles(edges, o.select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("component"), F.col("o_totalprice").alias("composite")))


@query("z08_reused_keys", "SELECT o_custkey AS component, CASE WHEN count(DISTINCT CASE WHEN o_orderkey % 2 = 0 THEN o_orderstatus END) = 1 THEN max(CASE WHEN o_orderkey % 2 = 0 THEN o_orderstatus END) ELSE 'new-' || min(o_orderkey) END AS storyline_key FROM orders GROUP BY 1")
def z08(s, d):
    o = V.table(s, d, "orders")
    return L.reused_key(o.select(F.col("o_custkey").alias("component"), F.col("o_orderkey").alias("id")), o.where("o_orderkey % 2 = 0").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("h_key")))


@query("d27_canonical_perspectives")
def d27(s, d):
    c = V.table(s, d, "conversations")
    sources = F.array(F.concat(F.lit("s"), ((F.col("conv_id") + 3 * F.col("turn")) % 7).cast("string")), F.concat("role", F.lit(" "), (F.col("turn") % 3).cast("string"))).alias("sources")
    return E.canonicalise(c.select("conv_id", "turn", sources, "text"), "conv_id", "turn", "sources", "text")


_VIEWS = ("报道地震灾情及伤亡情况，关注救援进展和余震风险。", "报道地震伤亡及救援进展，关注余震风险。", "No distinct perspective could be extracted", "Markets fear a longer conflict and dearer oil", "Markets fear a longer conflict, and dearer oil", "The ministry rejects the report")


def displayed(s, d):
    """Reports by order day: clusters as summaries, families by customer, lines as articles and views."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    line = V.table(s, d, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("n"), F.concat(F.lit("s"), (F.col("l_suppkey") % 5).cast("string")).alias("source"), F.concat(F.lit("https://s.example/"), (F.col("l_partkey") % 60).cast("string")).alias("url"), V.pick(_VIEWS, F.col("l_partkey") % 6).alias("perspective"))
    held = F.array_sort(F.collect_list(F.struct("n", "url", "source", "perspective")))
    articles = line.groupBy("id").agg(held.alias("a"))
    family = F.when(c % 3 == 0, F.concat(F.lit("f"), (c % 2).cast("string")))
    positive = k % 11 == 0
    angle = F.radians((c % 24) * 15)
    rows = V.table(s, d, "orders").select(F.col("o_orderdate").cast("date").alias("report"), F.when(family.isNotNull(), 0).when(positive, 1).otherwise(2).alias("place"), k.alias("id"), F.round(F.col("o_totalprice") / 500000, 2).alias("composite"), (k % 2 == 0).alias("new"), family.alias("family"), (positive & family.isNull()).alias("positive"), F.when(k % 13 != 0, F.array(F.cos(angle), F.sin(angle))).alias("centroid"))
    shown = F.transform("a", lambda x: F.struct(x["url"].alias("url"), x["source"].alias("source")))
    groups = F.transform("a", lambda x: F.struct(F.array(x["source"]).alias("sources"), x["perspective"].alias("perspective")))
    return rows.join(articles, "id").select(*rows.columns, shown.alias("articles"), F.array_distinct(F.transform("a", lambda x: x["source"])).alias("sources"), groups.alias("groups"))


@query("d23_display_dedup")
def d23(s, d):
    return U.resolve_displayed(displayed(s, d))


@query("j21_url_overlap", "WITH g AS (SELECT l_orderkey AS id, list(DISTINCT l_suppkey) AS s FROM lineitem GROUP BY 1) SELECT a.id, list_has_any(a.s, b.s) AS overlap FROM g a JOIN g b ON b.id = a.id + 1")
def j21(s, d):
    g = V.table(s, d, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.collect_set("l_suppkey").alias("s"))
    b = g.select((F.col("id") - 1).alias("id"), F.col("s").alias("t"))
    return g.join(b, "id").select("id", F.arrays_overlap("s", "t").alias("overlap"))
