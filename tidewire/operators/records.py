"""Audit counters, storyline records, review queues and text reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewire.functions.selectors import selected_udf
from tidewire.runtime import checked

# Paths of listing pages, and how many rows of a queue are shown.
LISTED = ("/tag/", "/category/", "/page/", "/author/", "/search", "/about", "/contact", "#")
QUEUE_LIMITS = (1, 500)


def absolute(base: Column, href: Column) -> Column:
    """A link resolved against the page it stands on (dot segments aside)."""
    root = F.regexp_extract(base, "^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1)
    scheme = F.regexp_extract(base, "^([A-Za-z][A-Za-z0-9+.-]*:)", 1)
    folder = F.when(F.regexp_extract(base, "^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*(/[^?#]*/)", 1) != "", F.regexp_extract(base, "^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*/[^?#]*/)", 1)).otherwise(F.concat(root, F.lit("/")))
    return F.when(href.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), href).when(href.startswith("//"), F.concat(scheme, href)).when(href.startswith("/"), F.concat(root, href)).otherwise(F.concat(folder, href))


def article_links(pages: DataFrame, rules: DataFrame, limit: int = 25) -> DataFrame:
    """(page_id, pos, link): each page's distinct links to its own domain, in order, listing paths left out.

    rules (domain, part and, if there are any, selector): a domain's selector chooses the elements whose links count, and
    its part must stand in the URL. Pages of other domains give all their links, by column expressions; only pages with a
    selector are read by the matcher.
    """
    domain = F.lower(F.regexp_extract("url", "^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1))
    met = pages.select("page_id", "url", domain.alias("domain"), F.regexp_extract_all("html", F.lit("<a\\s[^>]*href=[\"']([^\"']+)[\"']"), 1).alias("hrefs"), "html").join(checked(rules), "domain", "left")
    if "selector" in rules.columns:
        with_rule = met.where("selector IS NOT NULL").withColumn("hrefs", selected_udf("html", "selector"))
        met = met.where("selector IS NULL").unionByName(with_rule)
    full = F.transform("hrefs", lambda h: absolute(F.col("url"), h))
    path = lambda u: F.regexp_extract(u, "^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    own = lambda u: F.contains(F.lower(F.regexp_extract(u, "^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)), F.col("domain"))
    listed = lambda u: F.exists(F.array(*[F.lit(x) for x in LISTED]), lambda x: F.contains(path(u), x))
    kept = F.filter(full, lambda u: own(u) & F.contains(u, F.coalesce("part", F.lit(""))) & ~listed(u))
    return met.select("page_id", F.posexplode(F.slice(F.array_distinct(kept), 1, limit)).alias("pos", "link"))


def meta_date(html: Column) -> Column:
    """The time that a page's published-time mark or time element names, in UTC; null for none."""
    mark = "(?is)<meta[^>]*(?:article:published_time|datePublished|name=[\"']date[\"'])[^>]*content=[\"']([^\"']+)[\"']"
    element = "(?is)<time[^>]*datetime=[\"']([^\"']+)[\"']"
    value = F.coalesce(F.nullif(F.regexp_extract(html, mark, 1), F.lit("")), F.nullif(F.regexp_extract(html, element, 1), F.lit("")))
    return F.try_to_timestamp(value)


def run_log(results: DataFrame) -> DataFrame:
    """Of (source_name, mode, ok, articles, ms): per source and mode its status, articles and time."""
    g = results.groupBy("source_name", "mode").agg(F.sum("articles").alias("articles"), F.round(F.sum("ms"), 2).alias("ms"), F.max("ok").alias("any"))
    return g.select("source_name", "mode", F.when(F.col("articles") > 0, "ok").when(F.col("any"), "empty").otherwise("error").alias("status"), "articles", "ms")


def quality_audit(reports: DataFrame) -> DataFrame:
    """Of (score, flags, confirmed, cost): reports, mean score, low scores, those without confirmed claims, single-source risks, and the cost."""
    flagged = lambda f: F.count_if(F.array_contains("flags", f))
    return reports.agg(
        F.count("*").alias("reports"), F.round(F.avg(F.coalesce("score", F.lit(0.0))), 4).alias("avg_score"), F.count_if(F.coalesce("score", F.lit(0.0)) < 0.45).alias("low"),
        F.count_if(F.size("confirmed") == 0).alias("unconfirmed"), F.least(flagged("high_risk_topic"), flagged("single_source")).alias("single_source_risks"), F.round(F.sum(F.coalesce("cost", F.lit(0.0))), 6).alias("cost"))


def report_audit(clusters: DataFrame) -> DataFrame:
    """Of (perspectives array, text): clusters, share of those with one angle at most, clusters without text, and `**` marks left."""
    angles = F.size(F.array_distinct(F.filter(F.transform("perspectives", lambda p: F.trim(p)), lambda p: p != "")))
    marks = ((F.length("text") - F.length(F.replace(F.col("text"), F.lit("**"), F.lit("")))) / 2).cast("bigint")
    return clusters.agg(F.count("*").alias("clusters"), F.round(F.count_if(angles <= 1) / F.count("*"), 4).alias("one_angle_rate"), F.count_if(F.trim(F.coalesce("text", F.lit(""))) == "").alias("blank"), F.coalesce(F.sum(marks), F.lit(0)).alias("marks"))


def counted_by(rows: DataFrame, key: str, samples: str, most: int = 3) -> DataFrame:
    """Rows by a key: number, share in percent, and the first few of another column."""
    total = F.sum("n").over(Window.partitionBy())
    g = rows.groupBy(key).agg(F.count("*").alias("n"), F.slice(F.array_sort(F.collect_set(samples)), 1, most).alias("samples"))
    return g.withColumn("pct", F.round(100 * F.col("n") / total, 1))


def upserted_storylines(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """Storylines (key, name, state, day): incoming ones replace state and day, and the name where they have one."""
    new = incoming.select("key", F.struct("name", "state", "day").alias("_new"))
    met = existing.join(new, "key", "full")
    pick = lambda c: F.when(F.col("_new").isNotNull(), F.col(f"_new.{c}")).otherwise(F.col(c)).alias(c)
    return met.select("key", F.coalesce("_new.name", "name").alias("name"), pick("state"), pick("day"))


def upserted_events(existing: DataFrame, incoming: DataFrame, cluster: str) -> DataFrame:
    """Timeline events (key, cluster_id, day, title): the incoming ones of (kind, and this `cluster`) replace those of the same key, cluster and day; 'current' and unlinked ones are this cluster's."""
    own = F.when((F.col("kind") == "current") | F.col("cluster_id").isNull(), F.col(cluster)).otherwise(F.col("cluster_id"))
    new = incoming.select("key", own.alias("cluster_id"), "day", "title").dropDuplicates(["key", "cluster_id", "day"])
    return existing.join(new.select("key", "cluster_id", "day"), ["key", "cluster_id", "day"], "left_anti").select(*new.columns).unionByName(new)


def pending_reviews(reviews: DataFrame, limit: int) -> DataFrame:
    """The newest pending reviews, between 1 and 500 of them."""
    low, high = QUEUE_LIMITS
    return reviews.where("decision = 'pending_review'").orderBy(F.desc("created_at"), F.desc("id")).limit(max(low, min(high, limit)))


def review_lines(reviews: DataFrame) -> DataFrame:
    """A review as a line of the queue's text."""
    return reviews.select("id", F.format_string("#%d %s/%s %s %s verdict=%s reason=%s", "id", "target_label", "target_region", "stage", "domain", "verdict", "reason").alias("line"))


def _in_order(rows: DataFrame, order: list[Column], line: Column, limit: int) -> DataFrame:
    """(place, line) of the first `limit` rows in an order: a report's section."""
    first = rows.orderBy(*order).limit(limit).agg(F.collect_list(line).alias("lines"))
    return first.select(F.posexplode("lines").alias("place", "line"))


def audit_lines(issues: DataFrame, contribution: DataFrame, silent: DataFrame, ranked: int = 15) -> DataFrame:
    """Section, place, line of an audit's text: issues by name (key, n), the sources that contribute most (as A06 has them), and those that contribute nothing (source_name)."""
    counted = _in_order(issues, [F.asc("key")], F.format_string("- %s: %d", "key", "n"), 10_000)
    best = _in_order(contribution, [F.desc("impact_weighted"), F.asc("source_name")], F.format_string("  %-35s %6d  %7.3f  %5d  %5d", "source_name", "appearances", "impact_weighted", "exclusive", "selected_count"), ranked)
    none = silent.agg(F.array_join(F.array_sort(F.collect_set("source_name")), ", ").alias("names")).where("names <> ''")
    none = none.select(F.lit(0).alias("place"), F.concat(F.lit("  Zero-contribution (candidates to drop): "), "names").alias("line"))
    sections = [x.select(F.lit(name).alias("section"), F.col("place").cast("bigint").alias("place"), "line") for name, x in (("issues", counted), ("sources", best), ("silent", none))]
    return sections[0].union(sections[1]).union(sections[2])


def calibration_lines(weights: DataFrame) -> DataFrame:
    """Place, line of the calibration's text, by dimension: weight, seed, their ratio (n/a for a seed of 0) and when it changed (dimension, weight, seed, updated_at as text)."""
    ratio = F.when(F.col("seed") != 0, F.format_string("%.2fx", F.col("weight") / F.col("seed"))).otherwise("n/a")
    line = F.format_string("  %-22s %.4f  (seed %.4f, %s)  [%s]", "dimension", "weight", "seed", ratio, F.coalesce("updated_at", F.lit("")))
    return _in_order(weights, [F.asc("dimension")], line, 10_000)


def feedback_lines(rows: DataFrame) -> DataFrame:
    """Per day, accepted and rejected stories as one line each, in order, and their counts."""
    line = F.concat(F.when(F.col("verdict") > 0, "+ ").otherwise("- "), "label", F.lit(" ("), F.format_number("composite", 2), F.lit(")"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("id", line.alias("line")))), lambda x: x["line"]), "\n")
    return rows.groupBy("day").agg(F.count_if(F.col("verdict") > 0).alias("accepted"), F.count_if(F.col("verdict") < 0).alias("rejected"), joined.alias("text"))


def reattached(follow_ups: DataFrame, clusters: DataFrame, label: str) -> DataFrame:
    """Follow-ups with the cluster of their label, whatever its case and outer blanks; the first cluster of a label."""
    folded = F.lower(F.trim(F.col(label)))
    first = clusters.groupBy(folded.alias("_l")).agg(F.min("cluster_id").alias("cluster_id"))
    return follow_ups.withColumn("_l", folded).join(first, "_l").drop("_l")


def earlier_with(rows: DataFrame, key: str, order: str) -> DataFrame:
    """How many earlier rows have the same key."""
    w = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("earlier", F.count("*").over(w))


def preferred(rows: DataFrame, group: str) -> DataFrame:
    """The summary of each group that ranks first: positive lane, composite, groups, sources, new; the first id of equals."""
    fresh = (F.col("freshness") == "new").cast("int")
    order = [F.desc(F.col("positive").cast("int")), F.desc("composite"), F.desc("perspective_groups"), F.desc("sources"), F.desc(fresh), "id"]
    return rows.withColumn("_r", F.row_number().over(Window.partitionBy(group).orderBy(*order))).where("_r = 1").drop("_r")


def model_clusters(entries: DataFrame, articles: DataFrame, fallback: DataFrame) -> DataFrame:
    """(id, cluster): articles in the first entry (batch, entry, ids) of their batch that names them; articles of batches without any valid entry as the fallback (id, cluster) clusters them."""
    named = entries.select("batch", "entry", F.explode("ids").alias("id")).join(articles.select("batch", "id"), ["batch", "id"])
    first = named.groupBy("batch", "id").agg(F.min("entry").alias("entry"))
    told = first.select("id", F.concat_ws("-", F.lit("m"), F.col("batch").cast("string"), F.col("entry").cast("string")).alias("cluster"))
    silent = articles.join(first.select("batch").distinct(), "batch", "left_anti")
    return told.unionByName(silent.join(fallback, "id").select("id", F.concat(F.lit("f-"), F.col("cluster").cast("string")).alias("cluster")))


def retention(tables: dict[str, tuple[DataFrame, str]], now: Column, days: int) -> dict[str, DataFrame]:
    """Every table (with its time column) without rows older than `days`."""
    cutoff = now - F.make_dt_interval(days=F.lit(days))
    return {name: rows.where(F.col(time) >= cutoff) for name, (rows, time) in tables.items()}
