"""Queries on editions: profiles, labels, links, digests, search plans and telemetry, each with the SQL it must agree with."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewire.operators import editions as N
from tidewire.operators import history as H
from tidewire.operators import selection as T
from tidewire.operators import storyline as L
from tidewire.operators.dedup import compacted_updates
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


def _labels(s, d):
    return V.table(s, d, "orders").select(F.col("o_orderkey").alias("cluster_id"), F.col("o_orderpriority").alias("label"))


@query("z06_profiles", "WITH a AS (SELECT cluster_id, title, row_number() OVER (PARTITION BY cluster_id ORDER BY pos, title) AS k FROM v_search), g AS (SELECT cluster_id, string_agg(title, ' ' ORDER BY k) AS t, min(title) FILTER (k = 1) AS lead FROM a WHERE k <= 3 GROUP BY 1) SELECT o_orderkey AS cluster_id, o_orderpriority || coalesce(' ' || t, '') AS text, coalesce(lead, o_orderpriority) AS lead FROM orders LEFT JOIN g ON cluster_id = o_orderkey")
def z06(s, d):
    return N.profiles(_labels(s, d), V.search_articles(s, d)).select("cluster_id", "text", "lead")


@query("z07_stamped", "SELECT o_orderkey AS cluster_id, CASE WHEN o_orderkey % 3 = 0 THEN 'k' || o_custkey ELSE 'single-' || substr(sha1(o_orderpriority), 1, 8) END AS storyline_key, CASE WHEN o_orderkey % 3 = 0 AND o_orderkey % 2 = 0 THEN 'Name' ELSE o_orderpriority END AS storyline_name, CASE WHEN o_orderkey % 3 = 0 THEN 'core' ELSE 'none' END AS role, CASE WHEN o_orderkey % 3 = 0 THEN 'member' ELSE 'single' END AS membership FROM orders")
def z07(s, d):
    o = V.table(s, d, "orders").where("o_orderkey % 3 = 0").select(F.col("o_orderkey").alias("cluster_id"), F.concat(F.lit("k"), F.col("o_custkey").cast("string")).alias("storyline_key"), F.when(F.col("o_orderkey") % 2 == 0, "Name").alias("storyline_name"), F.lit("core").alias("role"))
    return N.stamped(_labels(s, d), o)


@query("z10_evidence_sentences", "WITH g AS (SELECT cluster_id, count(DISTINCT source_name) AS s, count(DISTINCT region) FILTER (NOT is_placeholder) AS r FROM v_search GROUP BY 1) SELECT o_orderkey AS cluster_id, CASE WHEN o_orderkey % 2 = 0 THEN coalesce(s, 0) || ' 个来源、' || coalesce(r, 0) || ' 个地区参与评估。' ELSE '' END AS evidence FROM orders LEFT JOIN g ON cluster_id = o_orderkey")
def z10(s, d):
    return N.evidence_sentences(_labels(s, d).withColumn("assessed", F.col("cluster_id") % 2 == 0), V.search_articles(s, d))


@query("z17_formatted_articles", "WITH a AS (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY pos) AS k FROM v_search WHERE NOT is_placeholder) SELECT cluster_id, count(*) AS n, sum(length('[' || k || '] 来源：' || source_name || chr(10) || '标题：' || title || chr(10) || '内容：' || content || chr(10))) + count(*) - 1 AS size FROM a GROUP BY 1")
def z17(s, d):
    t = N.formatted_articles(V.search_articles(s, d))
    return t.select("cluster_id", F.regexp_count("text", F.lit("(?m)^\\[[0-9]+\\] 来源：")).cast("bigint").alias("n"), F.length("text").cast("bigint").alias("size"))


@query("z20_ranked_main", "WITH r AS (SELECT evaluation_id, display_category, composite, row_number() OVER (PARTITION BY display_category ORDER BY composite DESC, evaluation_id) AS k FROM v_evaluations) SELECT evaluation_id FROM r ORDER BY CASE WHEN k > 3 THEN 1 ELSE 0 END, composite DESC, evaluation_id LIMIT 20")
def z20(s, d):
    return T.diverse(V.evaluations(s, d, False).select("evaluation_id", "display_category", "composite"), "display_category", "composite", "evaluation_id", 20, 3).select("evaluation_id")


@query("r10_repaired_labels", "SELECT o_orderkey AS id, CASE WHEN o_orderkey % 5 = 0 THEN '' WHEN o_custkey % 2 = 0 THEN CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE '俄乌升级' END WHEN o_orderkey % 3 = 0 OR o_orderkey % 3 = 2 THEN '旧名' ELSE '' END AS label FROM orders")
def r10(s, d):
    o = V.table(s, d, "orders")
    headline = V.pick(("旧名未改", "俄方回应", "English only"), F.col("o_orderkey") % 3)
    cards = o.select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("key"), F.when(F.col("o_orderkey") % 5 == 0, "").otherwise("旧名").alias("label"), headline.alias("headline"))
    return N.repaired_labels(cards, o.where("o_custkey % 2 = 0").select(F.col("o_custkey").alias("key"), F.lit("俄乌升级").alias("label")).distinct())


@query("r12_edition_paths", "WITH x AS (SELECT DISTINCT CAST(o_orderdate AS DATE)::VARCHAR AS day FROM orders), p AS (SELECT day, CASE WHEN right(day, 1) <> '3' THEN '/' || day || '/' END AS en, CASE WHEN right(day, 1) = '3' THEN '/' || day || '/' WHEN right(day, 1) <> '7' THEN '/cn/' || day || '/' END AS zh FROM x) SELECT day, en, zh, last_value(en IGNORE NULLS) OVER (ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS en_previous, first_value(en IGNORE NULLS) OVER (ORDER BY day ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS en_next FROM p")
def r12(s, d):
    days = V.table(s, d, "orders").select(F.col("o_orderdate").cast("date").cast("string").alias("day")).distinct()
    last = F.substring("day", -1, 1)
    return N.edition_paths(days.select("day", (last != "3").alias("has_english"), (last != "7").alias("has_chinese")))


@query("r13_seo_descriptions", "WITH r AS (SELECT source_name, title, row_number() OVER (PARTITION BY source_name ORDER BY id) AS k FROM v_titles), j AS (SELECT source_name, trim(regexp_replace(string_agg(title, '; ' ORDER BY k), '[ \\t\\n\\f\\r\\v]+', ' ', 'g')) AS t FROM r WHERE k <= 3 GROUP BY 1) SELECT source_name, CASE WHEN length(t) <= 155 THEN t ELSE rtrim(substr(t, 1, 154)) || '…' END AS description FROM j")
def r13(s, d):
    return N.seo_description(V.titles(s, d).withColumnRenamed("title", "headline"), "source_name", ["id"])


@query("r14_digest_items", "WITH k AS (SELECT o_orderkey AS id, CAST(o_orderdate AS DATE) AS day, o_orderpriority AS category, CASE WHEN o_orderstatus = 'P' THEN 1 ELSE 0 END AS lane FROM orders WHERE o_orderstatus <> 'P' OR o_orderkey % 3 = 0) SELECT id, row_number() OVER w AS number, lag(category) OVER w IS DISTINCT FROM category AS header FROM k WINDOW w AS (PARTITION BY day ORDER BY lane, category, id)")
def r14(s, d):
    o = V.table(s, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderdate").cast("date").alias("day"), F.col("o_orderpriority").alias("category"), F.when(F.col("o_orderstatus") == "P", "positive").otherwise("main").alias("lane"), (F.col("o_orderkey") % 3 == 0).alias("is_chinese"))
    return N.digest_items(o, "day", ["category", "id"]).select("id", "number", "header")


@query("r16_stage_groups", "SELECT o_custkey AS storyline, count(*) AS members, count(*) FILTER (o_orderstatus = 'F') AS cores, count(*) >= 4 AND count(*) FILTER (o_orderstatus = 'F') > 0 AND NOT bool_or(o_custkey % 5 = 0) AS near_miss FROM orders WHERE o_orderkey % 7 <> 0 GROUP BY 1")
def r16(s, d):
    o = V.table(s, d, "orders").select(F.col("o_custkey").alias("storyline"), F.when(F.col("o_orderstatus") == "F", "core").otherwise("spillover").alias("role"), F.when(F.col("o_orderkey") % 7 == 0, "stale").otherwise("new").alias("freshness"), (F.col("o_custkey") % 5 == 0).alias("hot"))
    return N.stage_groups(o, "storyline")


@query("v11_search_queries", """WITH t AS (SELECT o_orderkey AS id, 'L' || o_custkey % 9 AS label, o_orderkey % 2 = 0 AS country, ['de', 'us', 'in'][CAST(o_orderkey % 3 + 1 AS BIGINT)] AS region, o_orderstatus = 'F' AS official, o_orderkey % 5 <> 0 AS scoped FROM orders),
 e AS (SELECT *, CASE WHEN official THEN label || ' official statement tax' ELSE CASE WHEN NOT country AND scoped THEN label || ' ' ELSE '' END || 'tax ' || region || ' local news' END AS english FROM t), q AS (SELECT id, 1 AS r, 'german ' || english AS query FROM e WHERE region = 'de' UNION ALL SELECT id, 1, 'hindi ' || english FROM e WHERE region = 'in' UNION ALL SELECT id, 3, english FROM e) SELECT id, row_number() OVER (PARTITION BY id ORDER BY r) AS place, query FROM q""")
def v11(s, d):
    o, k = V.table(s, d, "orders"), F.col("o_orderkey")
    region = V.pick(("de", "us", "in"), k % 3)
    targets = o.select(k.alias("id"), F.concat(F.lit("L"), (F.col("o_custkey") % 9).cast("string")).alias("label"), F.when(k % 2 == 0, "country").otherwise("ministry").alias("role"), region.alias("region"), region.alias("country"), F.lit("tax").alias("keyword"), F.when(F.col("o_orderstatus") == "F", "official").otherwise("country").alias("stage"), (k % 5 != 0).alias("scoped"))
    languages = s.createDataFrame([("de", "de", 1, "german"), ("us", "en", 1, ""), ("in", "hi", 1, "hindi"), ("in", "en", 2, ""), ("in", "ta", 3, "tamil")], "region string, language string, pos int, prefix string")
    return N.search_queries(targets, languages)


_RUNS = "x AS (SELECT user_id AS run, event_type AS provider, CASE WHEN event_id % 3 = 0 THEN 'accepted' ELSE 'rejected' END AS decision, CASE event_id % 3 WHEN 1 THEN 'stale_result' WHEN 2 THEN 'thin_result' END AS reason FROM events)"


@query("v13_search_telemetry", f"WITH {_RUNS} SELECT run, provider, 'search' AS type, count(*) AS n, NULL AS reason FROM x GROUP BY 1, 2 UNION ALL SELECT run, provider, 'acceptance', count(*) FILTER (decision = 'accepted'), string_agg(DISTINCT reason, ',' ORDER BY reason) FROM x GROUP BY 1, 2 UNION ALL SELECT run, provider, 'rejection', count(*), reason FROM x WHERE decision = 'rejected' GROUP BY 1, 2, 5")
def v13(s, d):
    k = F.col("event_id") % 3
    return N.search_rows(V.table(s, d, "events").select(F.col("user_id").alias("run"), F.col("event_type").alias("provider"), F.when(k == 0, "accepted").otherwise("rejected").alias("decision"), F.when(k == 1, "stale_result").when(k == 2, "thin_result").alias("reason")))


@query("v14_search_budget", "WITH x AS (SELECT event_id, user_id, ['official', 'country', 'fallback'][CAST(event_id % 3 + 1 AS BIGINT)] AS stage, 40 - (row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1) AS l FROM events) SELECT event_id, l AS left_over, CASE stage WHEN 'official' THEN l >= 3 WHEN 'fallback' THEN l >= 10 ELSE l >= 1 END AS runs FROM x")
def v14(s, d):
    rows = V.table(s, d, "events").select("event_id", "user_id", V.pick(("official", "country", "fallback"), F.col("event_id") % 3).alias("stage"))
    return N.budgeted(rows, "user_id", ["event_id"], 40).select("event_id", F.col("left").alias("left_over"), "runs")


@query("z14_publish_flags", "WITH x AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS d FROM orders) SELECT 'ready' AS part, CAST(d AS VARCHAR) AS day FROM x WHERE dayofmonth(d) % 4 <> 0 AND dayofmonth(d) % 3 <> 0 UNION ALL SELECT 'old', CAST(d AS VARCHAR) FROM x WHERE DATE '1998-08-01' - d > 30")
def z14(s, d):
    days = V.table(s, d, "orders").select(F.col("o_orderdate").cast("date").alias("d")).distinct().withColumn("day", F.col("d").cast("string"))
    flags = days.select("day", F.when(F.dayofmonth("d") % 4 != 0, 5).alias("summaries"), F.when(F.dayofmonth("d") % 3 == 0, True).alias("pushed"))
    ready, old = N.publishable_days(flags, days.select("day"), F.to_date(F.lit("1998-08-01")), 30)
    return ready.select(F.lit("ready").alias("part"), "day").union(old.select(F.lit("old").alias("part"), "day"))


@query("z16_salvaged_answers", "SELECT event_id AS id, CASE WHEN event_id % 3 = 0 THEN 2 ELSE 1 END AS n, event_type AS first FROM events")
def z16b(s, d):
    one = F.concat(F.lit('{"id":'), F.col("event_id").cast("string"), F.lit(',"label":"'), "event_type", F.lit('"}'))
    answer = F.concat(F.lit('{"items":['), one, F.when(F.col("event_id") % 3 == 0, F.concat(F.lit(","), one)).otherwise(""), F.lit(',{"id":9,"lab'))
    got = N.salvaged(answer, "id bigint, label string")
    return V.table(s, d, "events").select(F.col("event_id").alias("id"), F.size(got).alias("n"), F.element_at(got, 1)["label"].alias("first"))


@query("u09_ragged_union", "SELECT c_custkey AS id, c_name AS name, NULL AS size FROM customer UNION ALL SELECT p_partkey, NULL, p_size FROM part UNION ALL SELECT s_suppkey, s_name, NULL FROM supplier")
def u09(s, d):
    c, p, u = V.table(s, d, "customer"), V.table(s, d, "part"), V.table(s, d, "supplier")
    return N.ragged_union([c.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name")), p.select(F.col("p_partkey").alias("id"), F.col("p_size").alias("size")), u.select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"))])


@query("z11_item_round_trip", "SELECT l_orderkey AS id, least(10.0::DOUBLE, count(*)) AS scope FROM lineitem WHERE l_orderkey % 3 <> 0 GROUP BY 1")
def z11(s, d):
    rows = V.dimensions(s, d).select(F.col("cluster_id").alias("id"), "scope", F.lit(0.5).alias("signal"), F.lit(0.4).alias("composite"), F.lit("publishable").alias("status"), F.array().cast("array<string>").alias("flags"), (F.col("cluster_id") % 3 != 0).alias("evaluated"))
    return N.round_trip(rows)


@query("e07_hashed_vectors", "WITH w AS (SELECT s_suppkey AS id, unnest(regexp_extract_all(lower(s_name), '([\\p{L}\\p{N}]+)', 1)) AS x FROM supplier), c AS (SELECT id, x, count(*) AS n FROM w GROUP BY 1, 2), g AS (SELECT id, sum(n) AS n FROM c GROUP BY 1) SELECT id, 1.0::DOUBLE AS norm, 64 AS size FROM g")
def e07(s, d):
    v = N.hashed_vector(F.col("s_name"))
    return V.table(s, d, "supplier").select(F.col("s_suppkey").alias("id"), F.round(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x), 9).alias("norm"), F.size(v).alias("size"))


@query("e07_vector_slots", """WITH shifts AS (SELECT list(list_reduce(list_concat([v], range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY v) AS crc FROM range(256) t(v)),
 w AS (SELECT p_partkey AS id, unnest(regexp_extract_all(lower(p_name), '([\\p{L}\\p{N}]+)', 1)) AS x FROM part),
 h AS (SELECT id, xor(list_reduce(list_concat([4294967295], list_transform(range(0, octet_length(encode(x))), lambda k: ('0x' || substr(hex(encode(x)), 2 * k + 1, 2))::BIGINT)), lambda c, b: xor(c >> 8, crc[(xor(c, b) & 255) + 1])), 4294967295) % 64 AS slot FROM w, shifts),
 n AS (SELECT id, slot, count(*) AS n FROM h GROUP BY 1, 2) SELECT id, CAST(slot AS INTEGER) AS slot, round(n / sqrt(sum(n * n) OVER (PARTITION BY id)), 9) AS value FROM n""")
def e07_slots(s, d):
    """Every slot of the vectors of all part names, by value."""
    v = V.table(s, d, "part").select(F.col("p_partkey").alias("id"), F.posexplode(N.hashed_vector(F.col("p_name"))).alias("slot", "value"))
    return v.where("value > 0").withColumn("value", F.round("value", 9))


@query("e03_storyline_relations", "SELECT event_id AS id, CASE WHEN event_id % 4 = 0 THEN 'same_core_storyline' WHEN value / 100.0::DOUBLE >= 0.8 THEN 'same_core_storyline' WHEN value / 100.0::DOUBLE >= 0.66 THEN 'same_direct_spillover_storyline' ELSE 'not_related' END AS relation FROM events")
def e03(s, d):
    e = V.table(s, d, "events")
    pairs = e.select(F.col("event_id").alias("id"), (F.col("value") / 100).alias("cosine"), F.lit(0.1).alias("overlap"), F.lit(False).alias("shared_history"), F.lit(False).alias("shared_conflict"))
    answers = e.where("event_id % 4 = 0").select(F.col("event_id").alias("id"), F.lit("same_core_storyline").alias("relation"), F.lit(0.9).alias("confidence"))
    return L.judged_pairs(pairs, answers, ["id"]).select("id", "relation")


@query("d09_compacted_updates")
def d09(s, d):
    e = V.table(s, d, "embeddings").select("vec_id", "embedding")
    t = V.titles(s, d).withColumn("vec_id", F.col("id") % e.count()).join(e, "vec_id").withColumn("real", F.col("id") % 25 != 0).withColumn("published_at", F.timestamp_seconds(F.lit(1704067200) + F.col("id") * 60))
    return compacted_updates(t, 0.2, 30.0)


_NAMES_SQL = "['热点专题：美以伊局势', '关税战 ', 'Tariff war', '', 'Нефть', '炼油厂火灾']"
_HEADS_SQL = "['俄军袭击乌克兰边境', '关税谈判继续', 'Only English here', '洪水退去。', '日本の製油']"


@query("r09_repaired_labels", f"""WITH o AS (SELECT o_orderkey AS id, o_custkey AS report, {_NAMES_SQL}[CAST(o_orderkey % 6 + 1 AS BIGINT)] AS n0, {_HEADS_SQL}[CAST(o_orderkey % 5 + 1 AS BIGINT)] AS h0, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS place FROM orders),
 k AS (SELECT *, CASE o_orderkey6 WHEN 0 THEN '美以伊局势' WHEN 1 THEN '关税战' WHEN 2 THEN 'Tariffwar' WHEN 4 THEN 'Нефть' WHEN 5 THEN '炼油厂火灾' END AS nm, CASE h5 WHEN 0 THEN '俄军袭击乌克兰边境' WHEN 1 THEN '关税谈判继续' WHEN 2 THEN 'OnlyEngli' || 's' WHEN 3 THEN '洪水退去' WHEN 4 THEN '日本の製油' END AS lead FROM (SELECT *, id % 6 AS o_orderkey6, id % 5 AS h5 FROM o)),
 f AS (SELECT *, coalesce(nm, lead) AS name, h5 = 0 AS esc, o_orderkey6 IN (0, 5) AS stale, h5 IN (0, 1, 3) AS zh FROM k),
 l AS (SELECT *, CASE WHEN esc AND stale THEN lead WHEN o_orderkey6 IN (0, 1, 5) OR (o_orderkey6 = 3 AND zh) THEN name WHEN zh THEN lead ELSE name END AS label, CASE WHEN esc AND stale THEN sp WHEN o_orderkey6 IN (0, 1, 5) OR (o_orderkey6 = 3 AND zh) THEN ne WHEN zh THEN coalesce(sp, ne) ELSE ne END AS label_en FROM (SELECT *, CASE WHEN id % 4 <> 0 THEN 'Family ' || id END AS ne, CASE WHEN zh AND id % 7 <> 0 THEN 'Short ' || id END AS sp FROM f)) SELECT report, id AS family, label, label_en FROM l WHERE place = 1""")
def r09(s, d):
    from pyspark.sql import Window

    from tidewire.operators import labels as B

    o, k = V.table(s, d, "orders"), F.col("o_orderkey")
    name = V.pick(("热点专题：美以伊局势", "关税战 ", "Tariff war", "", "Нефть", "炼油厂火灾"), k % 6)
    head = V.pick(("俄军袭击乌克兰边境", "关税谈判继续", "Only English here", "洪水退去。", "日本の製油"), k % 5)
    place = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))
    families = o.select(F.col("o_custkey").alias("report"), place.alias("place"), k.alias("family"), name.alias("name"), F.when(k % 4 != 0, F.concat(F.lit(" Family "), k.cast("string"))).alias("name_en"), F.lit("关税战").alias("storyline_name"))
    members = o.select(k.alias("family"), F.lit(1).alias("pos"), F.lit(None).cast("string").alias("short_name"), F.when(k % 7 != 0, F.concat(F.lit("Short "), k.cast("string"))).otherwise(" ").alias("short_name_en"), head.alias("headline"))
    labels = B.repaired(families, members)
    first = families.where("place = 1").select("report", "family")
    return labels.join(first, ["report", "family"], "left_semi")
