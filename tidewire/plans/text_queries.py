"""Queries on articles, texts, vectors, graphs and streams, each with the SQL it must agree with where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewire.functions import text as X
from tidewire.operators import clustering as C
from tidewire.operators import dedup as D
from tidewire.operators import graph as G
from tidewire.operators import history as H
from tidewire.operators import similarity as Y
from tidewire.operators import storyline as L
from tidewire.sources import pages as P
from tidewire.runtime import materialise
from tidewire.sources import views as V
from tidewire.sources.views import with_views
from tidewire.streaming import streams as R

QUERIES: dict = {}
ORACLE_SQL: dict = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = with_views(" ".join(sql.split()))
        return f

    return add


_GRAMS = """CASE WHEN length({c}) = 0 THEN [] WHEN length({c}) <= 3 THEN [{c}] ELSE list_distinct(list_transform(range(1, length({c}) - 1), lambda i: substr({c}, i, 3))) END"""
_CLEAN = "regexp_replace(lower({t}), '[^\\p{{L}}\\p{{N}}_]', '', 'g')"


@query("f01_real_articles", "SELECT id, url LIKE 'placeholder:%' AS placeholder, regexp_matches(url, '^https?://[^/?#]+') AS real FROM v_articles")
def f01(s, d):
    return V.articles(s, d).select("id", X.is_placeholder(F.col("url")).alias("placeholder"), X.is_real(F.col("url")).alias("real"))


@query("f03_generic_pages", "SELECT page_id, CASE WHEN regexp_matches(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1)), '/(authors?|compan(y|ies)|topics?|tags?|search|archives?|word)(/|$)') OR page_id % 4 = 1 THEN 'generic_page' WHEN page_id % 4 = 2 OR contains(url, '2025') OR contains(regexp_extract(html, '(?s)<title[^>]*>(.*?)</title>', 1), '2025') THEN 'stale_or_historical' END AS reason FROM pages")
def f03(s, d):
    title = F.concat(P.title(F.col("html")), F.when(F.col("page_id") % 4 == 1, F.lit(" | Reuters")).when(F.col("page_id") % 4 == 2, F.lit(" in 2025")).otherwise(""))
    return V.table(s, d, "pages").select("page_id", X.generic_or_stale(F.col("url"), title).alias("reason"))


@query("f14_latin_share", "WITH x AS (SELECT doc_id, text, [' 今天的新闻报道很多', '新闻', repeat('天气很好', 400), ''][CAST(doc_id % 4 + 1 AS BIGINT)] AS c, len(regexp_extract_all(coalesce(text, ''), '[A-Za-z]')) AS latin FROM documents) SELECT doc_id, latin, CASE doc_id % 4 WHEN 0 THEN 8 / greatest(8 + latin, 1) >= 0.08 WHEN 2 THEN 1600 / (1600 + latin) >= 0.08 ELSE false END AS chinese FROM x")
def f14(s, d):
    t = V.table(s, d, "documents")
    text = F.coalesce("text", F.lit(""))
    told = F.concat(text, V.pick((" 今天的新闻报道很", "新闻", "天气很好" * 400, ""), F.col("doc_id") % 4))
    return t.select("doc_id", F.regexp_count(text, F.lit("[A-Za-z]")).cast("bigint").alias("latin"), X.looks_chinese(told).alias("chinese"))


@query("d03_char_ngrams", f"WITH c AS (SELECT id, {_CLEAN.format(t='title')} AS c FROM v_titles), g AS (SELECT id, {_GRAMS.format(c='c')} AS g FROM c) SELECT id, len(g) AS n, array_to_string(list_sort(g), '|') AS grams FROM g")
def d03(s, d):
    g = V.titles(s, d).select("id", X.char_ngrams(F.col("title")).alias("g"))
    return g.select("id", F.size("g").cast("bigint").alias("n"), F.array_join(F.array_sort("g"), "|").alias("grams"))


@query("d04_ngram_pairs", f"""WITH c AS (SELECT id, source_name, {_CLEAN.format(t='title')} AS c FROM v_titles), g AS (SELECT id, source_name, {_GRAMS.format(c='c')} AS g FROM c),
 e AS (SELECT id, source_name, len(g) AS n, unnest(g) AS x FROM g),
 p AS (SELECT a.id AS k1, b.id AS k2, any_value(a.n) AS n1, any_value(b.n) AS n2, count(*) AS m FROM e a JOIN e b ON a.source_name = b.source_name AND a.x = b.x AND a.id < b.id GROUP BY 1, 2)
 SELECT k1, k2, round(m / (n1 + n2 - m), 4) AS overlap FROM p WHERE m / (n1 + n2 - m) >= 0.5""")
def d04(s, d):
    return Y.ngram_pairs(V.titles(s, d), "id", "title", "source_name", 0.5)


@query("d01_cosine", "SELECT a.vec_id AS a, b.vec_id AS b, round(list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda z: z[1]::DOUBLE * z[2]::DOUBLE)), 4) AS cosine FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def d01(s, d):
    e = V.table(s, d, "embeddings")
    nxt = e.select((F.col("vec_id") - 1).alias("a"), F.col("vec_id").alias("b"), F.col("embedding").alias("vb"))
    return e.withColumnRenamed("vec_id", "a").join(nxt, "a").select("a", "b", F.round(Y.dot(F.col("embedding"), F.col("vb")), 4).alias("cosine"))


@query("a14_centroids", """WITH f AS (SELECT label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings), m AS (SELECT label, i, avg(x) AS m FROM f GROUP BY 1, 2),
 n AS (SELECT label, sqrt(sum(m * m)) AS n FROM m GROUP BY 1) SELECT m.label, CAST(m.i - 1 AS BIGINT) AS i, round(m.m / n.n, 4) AS x FROM m JOIN n ON m.label = n.label""")
def a14(s, d):
    c = Y.centroids(V.table(s, d, "embeddings").where("label IS NOT NULL"), "label", "embedding")
    return c.select("label", F.posexplode("centroid").alias("i", "x")).select("label", F.col("i").cast("bigint").alias("i"), F.round("x", 4).alias("x"))


@query("a17_mean_pairwise", """WITH f AS (SELECT label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings), m AS (SELECT label, i, sum(x) AS s, sum(x * x) AS q, count(*) AS n FROM f GROUP BY 1, 2)
 SELECT label, round((sum(s * s) - sum(q)) / (max(n) * (max(n) - 1)), 5) AS mean_cosine FROM m GROUP BY 1""")
def a17(s, d):
    return Y.mean_pairwise(V.table(s, d, "embeddings").where("label IS NOT NULL"), "label", "embedding").withColumn("mean_cosine", F.round("mean_cosine", 5))


@query("d13_embedding_text", "SELECT id, length(CASE WHEN content <> '' AND NOT (len(regexp_extract_all(substr(content, 1, 200), '[\\x{80}-\\x{FF}]')) > length(substr(content, 1, 200)) * 0.25) AND NOT (length(content) < 120 AND NOT regexp_matches(content, '[。？！.?!\\n]')) THEN trim(title || ' ' || substr(content, 1, 500)) ELSE title END) AS n FROM v_articles")
def d13(s, d):
    return V.articles(s, d).select("id", F.length(X.embedding_text(F.col("title"), F.col("content"))).cast("bigint").alias("n"))


_EDGE = "ed AS (SELECT a.id AS a, b.id AS b FROM va a JOIN va b ON a.id < b.id AND abs(epoch(a.published_at) - epoch(b.published_at)) <= 172800 WHERE list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda z: z[1]::DOUBLE * z[2]::DOUBLE)) >= 0.40)"
_VA = "va AS (SELECT id, source_name, published_at, length(content) AS size, embedding FROM v_articles JOIN embeddings ON vec_id = id % (SELECT count(*) FROM embeddings) WHERE url LIKE 'https://%')"


def _vector_articles(s, d):
    """Real articles with their vectors: every article has one, by its number modulo the vectors'."""
    e = V.table(s, d, "embeddings").select("vec_id", "embedding")
    return V.articles(s, d).where(X.is_real(F.col("url"))).withColumn("vec_id", F.col("id") % e.count()).join(e, "vec_id").drop("vec_id")


@query("j11_event_edges", f"WITH {_VA}, {_EDGE} SELECT a, b FROM ed")
def j11(s, d):
    return C.event_edges(_vector_articles(s, d), least=0.40, strong=0.40).select("a", "b")


@query("d10_coherent_edges", f"""WITH {_VA}, {_EDGE.replace(' WHERE ', ' AND ').replace('SELECT a.id AS a, b.id AS b FROM', 'SELECT a.id AS a, b.id AS b, list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda z: z[1]::DOUBLE * z[2]::DOUBLE)) AS cosine FROM')},
 c AS (SELECT id, {_CLEAN.format(t='substr(content, 1, 60)')} AS c FROM v_articles), g AS (SELECT id, {_GRAMS.format(c='c')} AS g FROM c)
 SELECT a, b FROM ed JOIN g x ON x.id = a JOIN g y ON y.id = b WHERE cosine >= 0.6 OR len(list_intersect(x.g, y.g)) >= 0.04 * greatest(len(x.g) + len(y.g) - len(list_intersect(x.g, y.g)), 1)""")
def d10(s, d):
    """Edges of the event graph under its coherence rule: those under the strong bar need titles alike (here the content's opening)."""
    v = _vector_articles(s, d).withColumn("title", F.substring("content", 1, 60))
    return C.event_edges(v, least=0.40, strong=0.60, overlap=0.04).select("a", "b")


@query("d11_components", f"WITH RECURSIVE {_VA}, {_EDGE}, u AS (SELECT a, b FROM ed UNION ALL SELECT b, a FROM ed), r AS (SELECT a AS id, a AS c FROM u UNION SELECT u.a, r.c FROM r JOIN u ON u.b = r.id WHERE r.c < u.a) SELECT id, min(c) AS component FROM r GROUP BY 1")
def d11(s, d):
    e = materialise(C.event_edges(_vector_articles(s, d), least=0.40, strong=0.40).select("a", "b"))
    return G.connected_components(e.select(F.col("a").alias("id")).union(e.select("b")), e)


@query("w04_one_per_source", f"""WITH RECURSIVE {_VA}, {_EDGE}, u AS (SELECT a, b FROM ed UNION ALL SELECT b, a FROM ed), r AS (SELECT a AS id, a AS c FROM u UNION SELECT u.a, r.c FROM r JOIN u ON u.b = r.id WHERE r.c < u.a), k AS (SELECT id, min(c) AS component FROM r GROUP BY 1),
 g AS (SELECT a AS id, count(*) AS degree FROM u GROUP BY 1), o AS (SELECT k.component, va.id, va.source_name, g.degree, row_number() OVER (PARTITION BY k.component, va.source_name ORDER BY g.degree DESC, va.size DESC, va.published_at DESC, va.id) AS n FROM va JOIN k ON k.id = va.id JOIN g ON g.id = va.id) SELECT component, id, source_name, degree FROM o WHERE n = 1""")
def w04(s, d):
    v = _vector_articles(s, d)
    e = materialise(C.event_edges(v, least=0.40, strong=0.40).select("a", "b"))
    k = G.connected_components(e.select(F.col("a").alias("id")).union(e.select("b")), e)
    return C.one_per_source(v, k, e)


@query("d14_cluster_outliers", """WITH f AS (SELECT label, vec_id, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings), t AS (SELECT label, i, sum(x) AS s, count(*) AS n FROM f GROUP BY 1, 2),
 o AS (SELECT f.label, vec_id, sum(x * s) AS xs, sum(x * x) AS xx, max(n) AS n FROM f JOIN t ON t.label = f.label AND t.i = f.i GROUP BY 1, 2) SELECT label, vec_id, round((xs - xx) / nullif(n - 1, 0), 4) AS mean_cosine, coalesce((xs - xx) / nullif(n - 1, 0) < 0, false) AS outlier FROM o""")
def d14(s, d):
    return C.validate_cluster(V.table(s, d, "embeddings").where("label IS NOT NULL"), "label", "vec_id", "embedding", 0.0)


@query("d14_title_outliers", f"""WITH r AS (SELECT e.label, e.vec_id, e.embedding, {_CLEAN.format(t="coalesce(substr(d.text, 1, 60), '')")} AS c FROM embeddings e JOIN documents d ON d.doc_id = e.vec_id WHERE label IS NOT NULL), t AS (SELECT label, vec_id, {_GRAMS.format(c='c')} AS g FROM r),
 p AS (SELECT a.label, a.vec_id, count(*) + 1 AS n, avg(list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda z: z[1]::DOUBLE * z[2]::DOUBLE))) AS mean FROM r a JOIN r b ON a.label = b.label AND a.vec_id <> b.vec_id GROUP BY 1, 2),
 o AS (SELECT a.label, a.vec_id, avg(len(list_intersect(a.g, b.g)) / greatest(len(a.g) + len(b.g) - len(list_intersect(a.g, b.g)), 1)) AS o FROM t a JOIN t b ON a.label = b.label AND a.vec_id <> b.vec_id GROUP BY 1, 2)
 SELECT r.label, r.vec_id, round(p.mean, 4) AS mean_cosine, coalesce(p.mean < CASE WHEN n = 2 THEN 0.5 ELSE 0.001 END AND o.o < CASE WHEN n = 2 THEN 0.03 ELSE 0.05 END, false) AS outlier FROM r LEFT JOIN p USING (label, vec_id) LEFT JOIN o USING (label, vec_id)""")
def d14_titles(s, d):
    """Outliers by both halves of the rule: low mean cosine, and openings unlike the others'."""
    t = V.table(s, d, "documents").select(F.col("doc_id").alias("vec_id"), F.coalesce(F.substring("text", 1, 60), F.lit("")).alias("title"))
    rows = V.table(s, d, "embeddings").where("label IS NOT NULL").join(t, "vec_id")
    return C.validate_cluster(rows, "label", "vec_id", "embedding", 0.001, "title")


@query("d15_coherent_split")
def d15(s, d):
    e = V.table(s, d, "embeddings").select("vec_id", "embedding", (F.col("vec_id") % 50).cast("bigint").alias("component"))
    return G.coherent_split(e, "component", "vec_id", "embedding", 0.2)


@query("d07_fuzzy_dedup")
def d07(s, d):
    return D.fuzzy_dedup(V.titles(s, d).select("id", "title", "source_name"), V.doc_sources(s, d), 85.0)


@query("d08_semantic_dedup", """WITH a AS (SELECT v.id, v.source_name, coalesce(w.weight, 0.5) AS weight, e.embedding::DOUBLE[] AS v FROM v_articles v JOIN embeddings e ON e.vec_id = v.id % (SELECT count(*) FROM embeddings) LEFT JOIN v_doc_sources w ON w.name = v.source_name WHERE v.url LIKE 'https://%'),
 k AS (SELECT unnest(list_reduce(list([{'id': id, 's': source_name, 'v': v}] ORDER BY id), lambda kept, x: CASE WHEN len(list_filter(kept, lambda y: list_dot_product(y.v, x[1].v) >= CASE WHEN y.s = x[1].s THEN 0.35 ELSE 0.40 END)) > 0 THEN kept ELSE list_concat(kept, x) END)).id AS id FROM a),
 n AS (SELECT a.*, k.id IS NOT NULL AS anchor FROM a LEFT JOIN k USING (id)),
 f AS (SELECT x.id, x.weight, CASE WHEN x.anchor THEN x.id ELSE (SELECT min(y.id) FROM n y WHERE y.anchor AND y.id < x.id AND list_dot_product(y.v, x.v) >= CASE WHEN y.source_name = x.source_name THEN 0.35 ELSE 0.40 END) END AS by FROM n x)
 SELECT coalesce(max(CASE WHEN f.weight > a.weight THEN f.id END), f.by) AS id FROM f JOIN a ON a.id = f.by GROUP BY f.by""")
def d08(s, d):
    v = _vector_articles(s, d).select("id", "source_name", "embedding")
    return D.semantic_dedup(v, V.doc_sources(s, d), 0.35, 0.40)


@query("d06_token_set_ratio")
def d06(s, d):
    a = V.articles(s, d).select("source_name", "id", "content")
    w = Window.partitionBy("source_name").orderBy("id")
    return a.withColumn("before", F.lag("content").over(w)).select("id", F.round(Y.token_set_udf("content", "before"), 4).alias("score"))


@query("j16_pair_candidates", """WITH m AS (SELECT a.label, a.vec_id AS a, b.vec_id AS b, list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda z: z[1]::DOUBLE * z[2]::DOUBLE)) AS cosine FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id < b.vec_id),
 r AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY cosine DESC, b) AS k FROM m WHERE cosine >= 0.25) SELECT label, a, b, round(cosine, 4) AS cosine FROM r WHERE k <= 4 ORDER BY r.cosine DESC, a, b LIMIT 24""")
def j16(s, d):
    e = V.table(s, d, "embeddings").select("label", F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    return L.pair_candidates(e, "label", 0.25).withColumn("cosine", F.round("cosine", 4))


_JUDGED = """CASE WHEN c >= 0.80 AND (o >= 0.06 OR h) THEN ['same_core_storyline', least(0.92::DOUBLE, 0.60::DOUBLE + c * 0.28::DOUBLE)::VARCHAR] WHEN c >= 0.66 AND (o >= 0.06 OR h) THEN ['same_direct_spillover_storyline', least(0.85::DOUBLE, 0.5::DOUBLE + c * 0.22::DOUBLE + o * 0.15::DOUBLE)::VARCHAR]
 WHEN c >= 0.50 AND h AND k THEN ['same_conflict_different_event', '0.55'] ELSE ['not_related', greatest(0.15::DOUBLE, 0.45::DOUBLE - c * 0.2::DOUBLE)::VARCHAR] END"""
_EDGES = "x AS (SELECT event_id AS id, value / 100.0::DOUBLE AS c, (event_id % 10) / 50.0::DOUBLE AS o, user_id % 2 = 0 AS h, event_id % 3 = 0 AS k FROM events)"


def _edge_inputs(s, d):
    return V.table(s, d, "events").select(F.col("event_id").alias("id"), F.least(F.col("value") / 100, F.lit(1e9)).alias("c"), ((F.col("event_id") % 10) / 50.0).alias("o"), (F.col("user_id") % 2 == 0).alias("h"), (F.col("event_id") % 3 == 0).alias("k"))


@query("d17_relations", f"WITH {_EDGES}, j AS (SELECT id, {_JUDGED} AS j FROM x) SELECT id, j[1] AS relation, round(j[2]::DOUBLE, 5) AS confidence FROM j")
def d17(s, d):
    e = _edge_inputs(s, d).withColumn("j", L.relation(F.col("c"), F.col("o"), F.col("h"), F.col("k")))
    return e.select("id", "j.relation", F.round("j.confidence", 5).alias("confidence"))


@query("d18_accepted_edges", f"WITH {_EDGES} SELECT id, CASE WHEN id % 2 = 0 THEN 'same_conflict_different_event' WHEN id % 5 = 0 THEN 'not_related' ELSE 'same_core_storyline' END AS relation, round(c, 6) AS confidence FROM x WHERE c >= 0.5 AND (k OR id % 2 <> 0) AND (id % 2 = 0 OR id % 5 <> 0)")
def d18(s, d):
    said = F.when(F.col("id") % 2 == 0, "same_conflict_different_event").when(F.col("id") % 5 == 0, "not_related").otherwise("same_core_storyline")
    e = _edge_inputs(s, d).select("id", said.alias("relation"), F.col("c").alias("confidence"), F.col("k").alias("shared_conflict"))
    return L.accepted_edges(e).select("id", "relation", F.round("confidence", 6).alias("confidence"))


@query("d19_conflicts", """WITH x AS (SELECT o_orderkey AS id, o_orderpriority || ' ' || ['Russia and Ukraine', 'Iran, US talk', 'Gaza: Israel, Hamas', 'Saudi ship', 'Lebanon Israel line', '伊朗与以色列', '俄乌前线'][CAST(o_orderkey % 7 + 1 AS BIGINT)] AS t FROM orders), l AS (SELECT id, lower(t) AS t FROM x)
 SELECT id, concat_ws(',', CASE WHEN (contains(t, 'russia') AND contains(t, 'ukraine')) OR (contains(t, 'ru') AND contains(t, 'ua')) OR (contains(t, '俄罗斯') AND contains(t, '乌克兰')) OR (contains(t, '俄军') AND contains(t, '乌军')) OR contains(t, '俄乌') THEN 'russia_ukraine' END,
 CASE WHEN (contains(t, 'iran') AND (contains(t, 'us') OR contains(t, 'israel'))) OR (contains(t, '伊朗') AND (contains(t, '美国') OR contains(t, '以色列'))) OR contains(t, '美以伊') THEN 'iran_us_israel' END,
 CASE WHEN (contains(t, 'israel') AND (contains(t, 'palest') OR contains(t, 'gaza') OR contains(t, 'hamas'))) OR (contains(t, '以色列') AND contains(t, '巴勒斯坦')) OR (contains(t, '以军') AND contains(t, '哈马斯')) OR (contains(t, '加沙') AND contains(t, '以色列')) THEN 'israel_palestine' END,
 CASE WHEN (contains(t, 'saudi') AND contains(t, 'houthi')) OR (contains(t, '沙特') AND contains(t, '胡塞')) THEN 'saudi_houthi' END, CASE WHEN (contains(t, 'israel') AND contains(t, 'lebanon')) OR (contains(t, '以色列') AND contains(t, '黎巴嫩')) THEN 'israel_lebanon' END) AS conflicts FROM l""")
def d19(s, d):
    told = V.pick(("Russia and Ukraine", "Iran, US talk", "Gaza: Israel, Hamas", "Saudi ship", "Lebanon Israel line", "伊朗与以色列", "俄乌前线"), F.col("o_orderkey") % 7)
    return V.table(s, d, "orders").select(F.col("o_orderkey").alias("id"), F.concat_ws(",", L.conflicts(F.concat("o_orderpriority", F.lit(" "), told))).alias("conflicts"))


@query("d22_lifecycle", "SELECT evaluation_id, CASE WHEN evaluation_id % 3 = 0 THEN 'emerging' WHEN composite >= 0.55 AND (scope >= 3 OR len(subject_regions) >= 2) THEN 'stabilized' ELSE 'developing' END AS state FROM v_evaluations")
def d22(s, d):
    e = V.evaluations(s, d)
    return e.select("evaluation_id", L.lifecycle(F.col("evaluation_id") % 3 != 0, F.col("composite"), F.coalesce("scope", F.lit(0.0)), F.size("subject_regions")).alias("state"))


_NEAREST_SQL = """WITH n AS (SELECT count(*) AS n FROM embeddings), c AS (SELECT v.id, v.report_date AS day, v.article_ids, e.embedding AS v, v.id % 9 <> 0 AS summed FROM v_clusters v, n JOIN embeddings e ON e.vec_id = v.id % n.n),
 m AS (SELECT c.id, h.id AS h_id, list_sum(list_transform(list_zip(c.v, h.v), lambda z: z[1]::DOUBLE * z[2]::DOUBLE)) AS cosine FROM c JOIN c h ON h.day BETWEEN c.day - 3 AND c.day - 1 AND h.summed),
 b AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY cosine DESC, h_id) AS r FROM m WHERE cosine > 0)"""


def _nearest(s, d, clusters):
    """Clusters (written) with their day and vec_id, and the nearest one of the three days before for each of these; one in nine has no summary to compare with."""
    e = V.table(s, d, "embeddings").select("vec_id", F.col("embedding").alias("vector"))
    c = clusters.withColumnRenamed("report_date", "day").withColumn("vec_id", F.col("id") % e.count())
    summed = c.where("id % 9 <> 0").select(F.col("id").alias("h_id"), F.col("day").alias("h_day"), "vec_id")
    return c, H.nearest_of_vectors(c, summed, e)


@query("j15_nearest_history", _NEAREST_SQL + " SELECT id, h_id, round(cosine, 9) AS cosine FROM b WHERE r = 1")
def j15(s, d):
    lines = V.table(s, d, "lineitem").select(F.col("l_orderkey").alias("id")).distinct()
    dated = V.table(s, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderdate").cast("date").alias("report_date"))
    c, near = _nearest(s, d, materialise(dated.join(lines, "id")))
    return c.join(near, ["day", "vec_id"]).select("id", "h_id", F.round("cosine", 9).alias("cosine"))


@query("d21_freshness", _NEAREST_SQL + """ SELECT c.id AS cluster_id, CASE WHEN coalesce(3 * b.cosine, 0) < 0.85 THEN 'new' WHEN len(list_filter(c.article_ids, lambda x: NOT list_contains(o.article_ids, x))) > 0 THEN 'developing' ELSE 'stale' END AS freshness, CASE WHEN 3 * b.cosine >= 0.85 THEN b.h_id END AS continues FROM v_clusters c LEFT JOIN b ON b.id = c.id AND b.r = 1 LEFT JOIN v_clusters o ON o.id = b.h_id""")
def d21(s, d):
    close = 3 * F.col("cosine")  # the tables' vectors are spread wider than summaries of one story are
    c, near = _nearest(s, d, materialise(V.clusters(s, d).select("id", "report_date", "article_ids")))
    old = c.select(F.col("id").alias("h_id"), F.col("article_ids").alias("old"))
    met = c.join(near.where(close >= 0.85).join(old, "h_id"), ["day", "vec_id"], "left")
    return met.select(F.col("id").alias("cluster_id"), L.freshness(close, F.array_except("article_ids", "old")).alias("freshness"), F.when(close >= 0.85, F.col("h_id")).alias("continues"))


@query("key_cluster", "SELECT o_orderkey AS id, substr(sha1(o_orderpriority || '|' || o_orderstatus), 1, 16) AS cluster_key, substr(sha1(CASE WHEN o_orderpriority < o_orderstatus THEN o_orderpriority || '|' || o_orderstatus ELSE o_orderstatus || '|' || o_orderpriority END), 1, 8) AS storyline_key FROM orders")
def key_cluster(s, d):
    parts = F.array("o_orderpriority", "o_orderstatus")
    return V.table(s, d, "orders").select(F.col("o_orderkey").alias("id"), X.key_of(parts).alias("cluster_key"), L.storyline_key(parts).alias("storyline_key"))


@query("fn_slug_preview", "SELECT id, substr(regexp_replace(regexp_replace(lower(title), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 1, 40) AS slug, CASE WHEN length(trim(regexp_replace(content, '[ \\t\\n\\f\\r\\v]+', ' ', 'g'))) <= 120 THEN trim(regexp_replace(content, '[ \\t\\n\\f\\r\\v]+', ' ', 'g')) ELSE rtrim(substr(trim(regexp_replace(content, '[ \\t\\n\\f\\r\\v]+', ' ', 'g')), 1, 119)) || '…' END AS preview FROM v_articles")
def fn_slug(s, d):
    return V.articles(s, d).select("id", X.slug(F.col("title")).alias("slug"), X.preview(F.col("content")).alias("preview"))


@query("fn_host", "SELECT page_id, regexp_replace(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]*)', 1)), '^www\\.', '') AS host FROM pages")
def fn_host(s, d):
    return V.table(s, d, "pages").select("page_id", X.host(F.col("url")).alias("host"))


@query("fn_url_date", "WITH x AS (SELECT o_orderkey AS id, o_orderkey % 8 AS k, CAST(o_orderdate AS DATE) AS d FROM orders) SELECT id, CAST(CASE WHEN k < 3 THEN d WHEN k = 3 OR k = 4 THEN make_date(year(d), (quarter(d) - 1) * 3 + 1, 1) WHEN k = 5 OR k = 6 THEN make_date(year(d), month(d), 1) END AS VARCHAR) AS url_date FROM x")
def fn_url_date(s, d):
    o, k, at = V.table(s, d, "orders"), F.col("o_orderkey") % 8, F.col("o_orderdate")
    year, quarter = F.year(at).cast("string"), F.quarter(at).cast("string")
    forms = [F.date_format(at, "'/'yyyy'/'MM'/'dd'/x'"), F.date_format(at, "'/n'yyyyMMdd'.html'"), F.date_format(at, "'/a-'yyyy'-'M'-'d"), F.concat(F.lit("/r/"), year, F.lit("_"), quarter, F.lit("Q_business-report")), F.concat(F.lit("/r/"), year, F.lit("Q"), quarter, F.lit(".pdf")), F.concat(F.lit("/"), year, F.lit("/"), F.lower(F.date_format(at, "MMMM")), F.lit("/statement")), F.date_format(at, "'/'yyyy'/'MM'/report'"), F.lit("/x/12345678901")]
    url = F.concat(F.lit("https://a.example"), F.element_at(F.array(*forms), (k + 1).cast("int")))
    return o.select(F.col("o_orderkey").alias("id"), X.url_date(url).cast("string").alias("url_date"))


@query("fn_epoch", "SELECT event_id, CAST(make_timestamp(CASE WHEN event_id % 2 = 0 THEN epoch_us(ts) // 1000 ELSE epoch_us(ts) // 1000000 * 1000 END * 1000) AS VARCHAR)[1:19] AS at FROM events")
def fn_epoch(s, d):
    e = V.table(s, d, "events")
    raw = F.when(F.col("event_id") % 2 == 0, F.unix_millis("ts")).otherwise(F.unix_seconds("ts"))
    return e.select("event_id", F.date_format(X.epoch(raw), "yyyy-MM-dd HH:mm:ss").alias("at"))


@query("fn_day_gap", "SELECT o_orderkey AS id, CAST(greatest(0, DATE '1998-01-01' - CAST(o_orderdate AS DATE)) AS BIGINT) AS gap, round(greatest(0.0::DOUBLE, (5 - greatest(0, DATE '1998-01-01' - CAST(o_orderdate AS DATE))) / 5::DOUBLE) * 0.08::DOUBLE, 6) AS bonus FROM orders")
def fn_day_gap(s, d):
    gap = X.day_gap(F.to_date(F.lit("1998-01-01")), F.col("o_orderdate").cast("date"))
    return V.table(s, d, "orders").select(F.col("o_orderkey").alias("id"), gap.cast("bigint").alias("gap"), F.round(X.recency_bonus(gap), 6).alias("bonus"))


@query("fn_numeric_claims", "SELECT doc_id, array_to_string(list_sort(list_distinct(list_transform(regexp_extract_all(text, '([0-9][0-9,]*(?:\\.[0-9]+)?%?)', 1), lambda x: replace(x, ',', '')))), '|') AS claims FROM documents")
def fn_claims(s, d):
    return V.table(s, d, "documents").select("doc_id", F.array_join(F.array_sort(X.numeric_claims(F.col("text"))), "|").alias("claims"))


@query("s15_page_links", "WITH l AS (SELECT page_id, list_filter(regexp_extract_all(html, '<a href=\"([^\"#]+)\"', 1), lambda h: NOT regexp_matches(lower(h), '/(author|tag|topic|search|archive)s?(/|$)')) AS h FROM pages), u AS (SELECT page_id, unnest(h) AS href, generate_subscripts(h, 1) AS i FROM l), f AS (SELECT page_id, href, min(i) AS i FROM u GROUP BY 1, 2), r AS (SELECT page_id, href, row_number() OVER (PARTITION BY page_id ORDER BY i) AS k FROM f) SELECT page_id, CAST(k - 1 AS BIGINT) AS pos, href FROM r WHERE k <= 25")
def s15(s, d):
    return P.links(V.table(s, d, "pages")).withColumn("pos", F.col("pos").cast("bigint"))


@query("s17_page_titles", "SELECT page_id, trim(regexp_extract(html, '(?s)<title[^>]*>(.*?)</title>', 1)) AS title FROM pages")
def s17(s, d):
    return V.table(s, d, "pages").select("page_id", P.title(F.col("html")).alias("title"))


@query("s16_js_rendered", "SELECT page_id, length(trim(regexp_replace(regexp_replace(regexp_replace(html, '(?s)<(script|style)[^>]*>.*?</(script|style)>', ' ', 'g'), '(?s)<[^>]*>', ' ', 'g'), '[ \\t\\n\\f\\r\\v]+', ' ', 'g'))) < 500 AS js FROM pages")
def s16(s, d):
    return V.table(s, d, "pages").select("page_id", P.js_rendered(F.col("html")).alias("js"))


@query("j20_golden_coverage")
def j20(s, d):
    t = V.titles(s, d).withColumn("day", F.col("id") % 20)
    return L.golden_coverage(t.where("id % 3 = 0").select("day", F.col("title").alias("headline")), t.where("id % 3 <> 0").select("day", F.col("title").alias("headline")))


@query("x05_daily_rollup", "SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS day, event_type AS stage, count(*) AS calls, CAST(sum(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS BIGINT) AS tokens FROM events GROUP BY 1, 2")
def x05(s, d):
    return R.telemetry_rollup(V.table(s, d, "events")).select(F.date_format("day", "yyyy-MM-dd").alias("day"), "stage", "calls", "tokens")


@query("x05_daily_rollup_stream", "SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS day, event_type AS stage, count(*) AS calls, CAST(sum(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS BIGINT) AS tokens FROM events GROUP BY 1, 2")
def x05_stream(s, d):
    return R.drained(R.telemetry_rollup(R.event_stream(s, d)), "complete").select(F.date_format("day", "yyyy-MM-dd").alias("day"), "stage", "calls", "tokens")


@query("x03_sliding_counts", "WITH w AS (SELECT unnest([date_trunc('day', ts), date_trunc('day', ts) - INTERVAL 1 DAY]) AS start FROM events) SELECT CAST(CAST(start AS DATE) AS VARCHAR) AS start, count(*) AS n FROM w GROUP BY 1")
def x03(s, d):
    return R.drained(R.sliding_counts(R.event_stream(s, d)), "complete").withColumn("start", F.date_format("start", "yyyy-MM-dd"))


@query("x08_sessions", """WITH g AS (SELECT user_id, ts, value, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM events),
 k AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS session FROM g) SELECT user_id, epoch_us(min(ts)) // 1000000 AS start, count(*) AS n FROM k GROUP BY user_id, session""")
def x08(s, d):
    return R.drained(R.sessions(R.event_stream(s, d)), "complete").select("user_id", F.unix_seconds("start").alias("start"), "n")


@query("x02_distinct_stream", "SELECT DISTINCT user_id, event_type FROM events")
def x02(s, d):
    rows = V.table(s, d, "events").select("user_id", "event_type", "ts")
    return R.appended(R.in_batches(rows, 4), ["user_id", "event_type"]).select("user_id", "event_type")


@query("x04_lifecycle_stream", "SELECT user_id, count(*) AS seen, CASE WHEN count(*) < 3 THEN 'emerging' WHEN count(*) < 10 THEN 'developing' ELSE 'stabilized' END AS state FROM events GROUP BY 1")
def x04(s, d):
    out = R.drained(R.lifecycle_state(R.event_stream(s, d), idle="8760"), "update")
    return out.groupBy("user_id").agg(F.max("seen").alias("seen"), F.max_by("state", "seen").alias("state"))
