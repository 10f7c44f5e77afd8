"""Engine views over the driver's tables: what the news tables look like on them. Every view has a Spark and a SQL form."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# The six impact dimensions, source tiers and ownership classes.
DIMENSIONS = ("scope", "severity", "novelty", "actor_influence", "decision_relevance", "feelgood")
TIERS = ("mainstream", "portal", "specialist")
OWNERSHIPS = ("independent_public", "independent_nonprofit", "independent_private", "private_constrained", "independent_private_low_evidence", "state_influenced_review", "state_controlled_block")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.withColumns({c: F.col(c).cast("timestamp") for c, kind in df.dtypes if kind == "timestamp_ntz"})


def pick(values: tuple, index) -> F.Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (index + 1).cast("int"))


def sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The source dimension: name, region, weight, tier, ownership."""
    s, n = table(spark, sf_dir, "supplier"), table(spark, sf_dir, "nation")
    return s.join(n, s.s_nationkey == n.n_nationkey).select(
        F.col("s_suppkey").alias("source_id"), F.col("s_name").alias("name"), F.lower("n_name").alias("region"), F.round((F.col("s_acctbal") + 1000) / 11000, 3).alias("weight"),
        pick(TIERS, F.col("s_suppkey") % 3).alias("tier"), pick(OWNERSHIPS, F.col("s_suppkey") % 7).alias("ownership"))


def articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Articles from documents; every 50th is a placeholder row."""
    d = table(spark, sf_dir, "documents")
    url = F.when(F.col("doc_id") % 50 == 0, F.concat(F.lit("placeholder:"), "doc_id")).otherwise(F.concat(F.lit("https://"), "source", F.lit(".example.com/"), "doc_id"))
    return d.select(F.col("doc_id").alias("id"), F.concat("source", F.lit(" story "), F.col("doc_id").cast("string")).alias("title"), F.col("text").alias("content"), F.col("source").alias("source_name"), url.alias("url"), "lang", F.timestamp_seconds(F.lit(1704067200) + F.col("doc_id") * 420).alias("published_at"))


def titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headlines: the title elements of pages, by host."""
    p = table(spark, sf_dir, "pages")
    host = F.regexp_replace(F.lower(F.regexp_extract("url", "^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]*)", 1)), "^www\\.", "")
    return p.select(F.col("page_id").alias("id"), F.trim(F.regexp_extract("html", "(?s)<title[^>]*>(.*?)</title>", 1)).alias("title"), host.alias("source_name"), "url")


def doc_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources of documents: weight from the name's number, region from it modulo 5."""
    number = F.regexp_extract("source", "([0-9]+)$", 1).cast("bigint")
    return table(spark, sf_dir, "documents").select("source").distinct().select(F.col("source").alias("name"), (number / 20).alias("weight"), F.concat(F.lit("r"), (number % 5).cast("string")).alias("region"), pick(TIERS, number % 3).alias("tier"))


def members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cluster members in order: cluster_id, source_id. They lie by cluster, so what sums a cluster's members shuffles no more."""
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("cluster_id"), F.col("l_suppkey").alias("source_id")).repartition("cluster_id").distinct()


def clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clusters with their sorted member ids."""
    m = members(spark, sf_dir).groupBy("cluster_id").agg(F.sort_array(F.collect_list("source_id")).alias("article_ids"))
    o = table(spark, sf_dir, "orders")
    return o.join(m, o.o_orderkey == m.cluster_id).select(F.col("o_orderkey").alias("id"), F.col("o_orderdate").cast("date").alias("report_date"), F.col("o_orderpriority").alias("topic_category"), "article_ids")


def dimensions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Impact dimensions of a cluster (0 to 10)."""
    cap = lambda c: F.round(F.least(F.lit(10.0), c.cast("double")), 4)
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("cluster_id")).agg(
        cap(F.count("*")).alias("scope"), cap(F.sum("l_quantity") / 20).alias("severity"), cap(F.avg("l_discount") * 100).alias("novelty"),
        cap(F.max("l_tax") * 100).alias("actor_influence"), cap(F.countDistinct("l_partkey")).alias("decision_relevance"), cap(F.min("l_quantity") / 5).alias("feelgood"))


def evaluations(spark: SparkSession, sf_dir: str, with_dims: bool = True) -> DataFrame:
    """Cluster evaluations; subject regions come from the customer's nation (and, every fourth, the next nation)."""
    o, c, n = (table(spark, sf_dir, t) for t in ("orders", "customer", "nation"))
    nations = n.select("n_nationkey", F.lower("n_name").alias("region"))
    second = nations.select(F.col("n_nationkey").alias("second_key"), F.col("region").alias("second_region"))
    e = o.join(c, o.o_custkey == c.c_custkey).join(F.broadcast(nations), F.col("c_nationkey") == F.col("n_nationkey")).join(F.broadcast(second), (F.col("c_nationkey") + 1) % 25 == F.col("second_key"))
    e = e.select(
        F.col("o_orderkey").alias("evaluation_id"), F.col("o_orderkey").alias("cluster_id"), F.col("o_orderdate").cast("date").alias("report_date"), F.col("o_orderpriority").alias("display_category"),
        F.col("o_orderstatus").alias("status"), (F.col("o_totalprice") / 500000).alias("composite"), (F.col("o_orderstatus") == "F").alias("selected"),
        F.when(F.col("o_orderkey") % 4 == 0, F.array("region", "second_region")).otherwise(F.array("region")).alias("subject_regions"))
    return e.join(dimensions(spark, sf_dir), "cluster_id", "left") if with_dims else e


def feedback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Editorial feedback: clusters that are not pending have a verdict, finished ones a later, opposite one."""
    o = table(spark, sf_dir, "orders").where("o_orderstatus <> 'P'")
    verdict = F.when(F.expr("o_orderkey div 3") % 2 == 0, 1).otherwise(-1)
    first = o.select((F.col("o_orderkey") * 2).alias("id"), F.col("o_orderkey").alias("cluster_id"), verdict.alias("verdict"), F.col("o_orderdate").alias("created_at"))
    later = o.where("o_orderstatus = 'F'").select((F.col("o_orderkey") * 2 + 1).alias("id"), F.col("o_orderkey").alias("cluster_id"), (-verdict).alias("verdict"), (F.col("o_orderdate") + F.expr("INTERVAL 1 DAY")).alias("created_at"))
    return first.union(later)


def telemetry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Call telemetry from events: stage, duration, tokens from the JSON properties."""
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.col("event_type").alias("stage"), F.col("user_id").alias("account"), F.col("value").alias("duration_ms"), F.get_json_object("props", "$.k").cast("bigint").alias("tokens"), F.col("ts").alias("created_at"))


# Fixed values of the search view: URLs by publisher, reasons and states of candidates, sentences about a party.
SEARCH_URLS = ("https://www.state.gov/a/n", "https://x.com/acct", "https://news.example.com/2024/03/05/n", "https://www.youtube.com/@chan", "https://dept.gov.uk/x?url=https%3A%2F%2Freal.example.org%2Fp")
SEARCH_REASONS = ("current_event_perspective", "background_context", "http_404,stale_result", "official_confirmation", "http_429")
SEARCH_TEXTS = ("said \"we will act at once\" on Monday.", "has published its annual report.", "was seen near the port.", "did not comment, 称：“不会接受这种安排” 。")


def search_articles(spark: SparkSession, sf_dir: str, by_cluster: bool = False) -> DataFrame:
    """Members of clusters with what a search run stores about them: provenance, acceptance, freshness, evidence role. On demand they lie by cluster: keys travel, and texts are made where they arrive."""
    x = table(spark, sf_dir, "lineitem")
    x = x.repartition("l_orderkey") if by_cluster else x
    return x.select(F.col("l_orderkey").alias("cluster_id"), *_search_columns(F.col))


#: The columns of lineitem that a search view's are made of.
SEARCH_LINE = ("l_linenumber", "l_partkey", "l_suppkey", "l_returnflag")


def search_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per cluster the keys (an array, lines) that its search view is made of, for travels; see search_members()."""
    x = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("cluster_id"), *SEARCH_LINE)
    return x.repartition("cluster_id").groupBy("cluster_id").agg(F.collect_list(F.struct(*SEARCH_LINE)).alias("lines"))


def search_members(lines: F.Column) -> F.Column:
    """A search view's columns, as an array of structs, of search_lines()."""
    return F.transform(lines, lambda x: F.struct(*_search_columns(lambda c: x[c])))


def _search_columns(at) -> list[F.Column]:
    part, supp, text = at("l_partkey"), at("l_suppkey"), lambda c: c.cast("string")
    searched, placeholder = at("l_returnflag") != "N", part % 9 == 0
    url = F.when(placeholder, F.concat(F.lit("placeholder:"), text(part))).otherwise(F.concat(pick(SEARCH_URLS, supp % 5), text(part)))
    content = F.concat(F.lit("Party P"), text(part % 4), F.lit(" "), pick(SEARCH_TEXTS, part % 4))
    return [
        ((at("l_linenumber") * 1000000 + part) * 10000 + supp).alias("pos"), F.concat(F.lit("S"), text(supp % 7)).alias("source_name"), url.alias("url"),
        F.concat(F.lit("Line "), text(part)).alias("title"), content.alias("content"), searched.alias("is_searched"), placeholder.alias("is_placeholder"),
        F.when(searched, F.when(part % 4 == 0, "rejected").otherwise("accepted")).alias("status"), F.when(searched, pick(SEARCH_REASONS, part % 5)).alias("reason"),
        F.when(supp % 4 == 0, "fresh").when(supp % 4 == 1, "stale").alias("freshness"), F.when(part % 7 == 0, "direct_event").when(part % 7 == 1, "background").alias("evidence"),
        F.when(supp % 6 == 0, "official_web").when(supp % 6 == 1, "official_social").otherwise("news").alias("source_kind"), F.when(supp % 6 == 1, F.when(part % 2 == 0, "x").otherwise("youtube")).alias("platform"),
        pick(("us", "de", "cn", "fr"), supp % 4).alias("region"), F.when(searched, F.when(part % 3 == 0, "tavily_country").otherwise("tavily_official")).alias("provider")]


# The same views for DuckDB.
_LIST = "[" + ", ".join(f"'{x}'" for x in TIERS) + "]"
_OWN = "[" + ", ".join(f"'{x}'" for x in OWNERSHIPS) + "]"
_TEXTS = "[" + ", ".join(f"'{x}'" for x in SEARCH_TEXTS) + "]"
_URLS = "[" + ", ".join(f"'{x}'" for x in SEARCH_URLS) + "]"
_REASONS = "[" + ", ".join(f"'{x}'" for x in SEARCH_REASONS) + "]"
SQL = {
    "v_search": f"""SELECT l_orderkey AS cluster_id, (l_linenumber * 1000000 + l_partkey) * 10000 + l_suppkey AS pos, 'S' || l_suppkey % 7 AS source_name, CASE WHEN l_partkey % 9 = 0 THEN 'placeholder:' || l_partkey ELSE {_URLS}[l_suppkey % 5 + 1] || l_partkey END AS url, 'Line ' || l_partkey AS title,
 'Party P' || l_partkey % 4 || ' ' || {_TEXTS}[l_partkey % 4 + 1] AS content, l_returnflag <> 'N' AS is_searched, l_partkey % 9 = 0 AS is_placeholder, CASE WHEN l_returnflag = 'N' THEN NULL WHEN l_partkey % 4 = 0 THEN 'rejected' ELSE 'accepted' END AS status, CASE WHEN l_returnflag <> 'N' THEN {_REASONS}[l_partkey % 5 + 1] END AS reason,
 CASE l_suppkey % 4 WHEN 0 THEN 'fresh' WHEN 1 THEN 'stale' END AS freshness, CASE l_partkey % 7 WHEN 0 THEN 'direct_event' WHEN 1 THEN 'background' END AS evidence, CASE l_suppkey % 6 WHEN 0 THEN 'official_web' WHEN 1 THEN 'official_social' ELSE 'news' END AS source_kind,
 CASE WHEN l_suppkey % 6 = 1 THEN CASE WHEN l_partkey % 2 = 0 THEN 'x' ELSE 'youtube' END END AS platform, ['us', 'de', 'cn', 'fr'][l_suppkey % 4 + 1] AS region, CASE WHEN l_returnflag <> 'N' THEN CASE WHEN l_partkey % 3 = 0 THEN 'tavily_country' ELSE 'tavily_official' END END AS provider FROM lineitem""",
    "v_sources": f"SELECT s_suppkey AS source_id, s_name AS name, lower(n_name) AS region, round((s_acctbal + 1000) / 11000, 3) AS weight, {_LIST}[s_suppkey % 3 + 1] AS tier, {_OWN}[s_suppkey % 7 + 1] AS ownership FROM supplier JOIN nation ON s_nationkey = n_nationkey",
    "v_articles": "SELECT doc_id AS id, source || ' story ' || doc_id AS title, text AS content, source AS source_name, CASE WHEN doc_id % 50 = 0 THEN 'placeholder:' || doc_id ELSE 'https://' || source || '.example.com/' || doc_id END AS url, lang, TIMESTAMP '2024-01-01 00:00:00' + to_minutes(CAST(doc_id * 7 AS BIGINT)) AS published_at FROM documents",
    "v_titles": "SELECT page_id AS id, trim(regexp_extract(html, '(?s)<title[^>]*>(.*?)</title>', 1)) AS title, regexp_replace(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]*)', 1)), '^www\\.', '') AS source_name, url FROM pages",
    "v_doc_sources": f"SELECT DISTINCT source AS name, CAST(regexp_extract(source, '([0-9]+)$', 1) AS BIGINT) / 20.0::DOUBLE AS weight, 'r' || CAST(regexp_extract(source, '([0-9]+)$', 1) AS BIGINT) % 5 AS region, {_LIST}[CAST(regexp_extract(source, '([0-9]+)$', 1) AS BIGINT) % 3 + 1] AS tier FROM documents",
    "v_members": "SELECT DISTINCT l_orderkey AS cluster_id, l_suppkey AS source_id FROM lineitem",
    "v_clusters": "SELECT o_orderkey AS id, CAST(o_orderdate AS DATE) AS report_date, o_orderpriority AS topic_category, m.article_ids FROM orders JOIN (SELECT l_orderkey, list_sort(list(DISTINCT l_suppkey)) AS article_ids FROM lineitem GROUP BY 1) m ON o_orderkey = l_orderkey",
    "v_dims": "SELECT l_orderkey AS cluster_id, round(least(10.0::DOUBLE, count(*)), 4) AS scope, round(least(10.0::DOUBLE, sum(l_quantity) / 20), 4) AS severity, round(least(10.0::DOUBLE, avg(l_discount) * 100), 4) AS novelty, round(least(10.0::DOUBLE, max(l_tax) * 100), 4) AS actor_influence, round(least(10.0::DOUBLE, count(DISTINCT l_partkey)), 4) AS decision_relevance, round(least(10.0::DOUBLE, min(l_quantity) / 5), 4) AS feelgood FROM lineitem GROUP BY 1",
    "v_evaluations": "SELECT o_orderkey AS evaluation_id, o_orderkey AS cluster_id, CAST(o_orderdate AS DATE) AS report_date, o_orderpriority AS display_category, o_orderstatus AS status, o_totalprice / 500000 AS composite, o_orderstatus = 'F' AS selected, CASE WHEN o_orderkey % 4 = 0 THEN [lower(a.n_name), lower(b.n_name)] ELSE [lower(a.n_name)] END AS subject_regions, d.* EXCLUDE (cluster_id) FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation a ON c_nationkey = a.n_nationkey JOIN nation b ON (c_nationkey + 1) % 25 = b.n_nationkey LEFT JOIN v_dims d ON d.cluster_id = o_orderkey",
    "v_feedback": "SELECT o_orderkey * 2 AS id, o_orderkey AS cluster_id, CASE WHEN (o_orderkey // 3) % 2 = 0 THEN 1 ELSE -1 END AS verdict, o_orderdate AS created_at FROM orders WHERE o_orderstatus <> 'P' UNION ALL SELECT o_orderkey * 2 + 1, o_orderkey, CASE WHEN (o_orderkey // 3) % 2 = 0 THEN -1 ELSE 1 END, o_orderdate + INTERVAL 1 DAY FROM orders WHERE o_orderstatus = 'F'",
    "v_telemetry": "SELECT event_id AS id, event_type AS stage, user_id AS account, value AS duration_ms, CAST(json_extract_string(props, '$.k') AS BIGINT) AS tokens, ts AS created_at FROM events",
}
_NEEDS = {"v_evaluations": ("v_dims",)}


def with_views(body: str) -> str:
    """The query with the definitions of the views that it names."""
    names: list[str] = []
    for name in SQL:
        if name in body:
            names += [n for n in (*_NEEDS.get(name, ()), name) if n not in names]
    if not names:
        return body
    recursive = body.startswith("WITH RECURSIVE ")
    rest = body[len("WITH RECURSIVE ") if recursive else len("WITH ") :] if body.startswith("WITH ") else None
    views = ", ".join(f"{n} AS ({SQL[n]})" for n in names)
    return f"WITH {'RECURSIVE ' if recursive else ''}{views}" + (f" {body}" if rest is None else f", {rest}")
