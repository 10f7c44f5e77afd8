"""Collection payloads and report files as DataFrames: feeds, site APIs, attempts per source, rendered reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewire.functions.text import epoch
from tidewire.runtime import checked

# The order in which a source's collection methods are tried, and known certifications.
METHODS = ("newsnow", "rss", "rss_fallback", "rsshub", "api", "scrape")
REPORT = "clusters array<struct<headline:string,topic:string,url:string,articles:array<struct<url:string,link:string>>,footer_sources:array<struct<url:string,link:string>>>>"
_STORIES = "array<struct<headline:string,topic:string,url:string,articles:array<struct<url:string,link:string>>,footer_sources:array<struct<url:string,link:string>>,footer_sources_en:array<struct<url:string,link:string>>,source_groups:array<struct<url:string,link:string>>>>"
GOLDEN = f"clusters {_STORIES}, positive_stories {_STORIES}, hot_topics array<struct<clusters:{_STORIES},summaries:{_STORIES}>>, focus_storylines array<struct<clusters:{_STORIES},summaries:{_STORIES}>>"


def stripped(text: Column) -> Column:
    return F.regexp_replace(text, "^\\s+|\\s+$", "")


def _field(item: Column, name: str) -> Column:
    """An element's text, CDATA and references resolved: for items that are no well-formed XML."""
    raw = F.regexp_extract(item, f"(?s)<{name}(?:\\s[^>]*)?>(.*?)</{name}>", 1)
    raw = F.regexp_replace(raw, "(?s)<!\\[CDATA\\[(.*?)\\]\\]>", "$1")
    for reference, character in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&amp;", "&")):
        raw = F.replace(raw, F.lit(reference), F.lit(character))
    return stripped(raw)


# North American zone names of RFC 822 with their offsets from UTC.
ZONES = {"EST": "-0500", "EDT": "-0400", "CST": "-0600", "CDT": "-0500", "MST": "-0700", "MDT": "-0600", "PST": "-0800", "PDT": "-0700"}
_LINK = "STRUCT<_VALUE: STRING, _href: STRING, _rel: STRING>"
ITEM = f"title STRING, link ARRAY<{_LINK}>, guid STRUCT<_VALUE: STRING, _isPermaLink: STRING>, pubDate STRING, published STRING, updated STRING, `dc:date` STRING, description STRING, summary STRING, `content:encoded` STRING, content STRING"


def feed_time(text: Column) -> Column:
    """A feed's date as a timestamp: RFC 822 (weekday, seconds, zone as you like; years of two or four digits) or ISO 8601; UTC if no zone is named, null if it is no date."""
    text = F.regexp_replace(stripped(text), "\\s+", " ")
    zone = F.regexp_extract(text, "(?:^|[0-9 ])([+-][0-9]{2}:?[0-9]{2}|[A-Za-z]{1,5})$", 1)
    named = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for item in ZONES.items() for x in item]), F.upper(zone)), F.lit("+0000"))
    offset = F.when(F.rlike(zone, F.lit("^[+-]")), F.replace(zone, F.lit(":"), F.lit(""))).otherwise(named)
    mail = "^(?:[A-Za-z]{3,9},? )?([0-9]{1,2}) ([A-Za-z]{3})[a-z]* ([0-9]{2}|[0-9]{4}) ([0-9]{1,2}:[0-9]{2})(:[0-9]{2})?(?: .*)?$"
    part = lambda k: F.regexp_extract(text, mail, k)
    year = F.when(F.length(part(3)) == 2, F.concat(F.when(part(3) < "70", "20").otherwise("19"), part(3))).otherwise(part(3))
    written = F.concat_ws(" ", part(1), F.initcap(part(2)), year, F.concat(part(4), F.coalesce(F.nullif(part(5), F.lit("")), F.lit(":00"))), offset)
    by_mail = F.when(F.rlike(text, F.lit(mail)), F.try_to_timestamp(written, F.lit("d MMM yyyy H:mm:ss xx")))
    iso = "^[0-9]{4}-[0-9]{2}-[0-9]{2}"
    rest = F.regexp_extract(text, iso + "(?:[T ][0-9:.]+)?(.*)$", 1)
    by_iso = F.when(F.rlike(text, F.lit(iso)), F.when(F.trim(rest) == "", F.concat(text, F.when(F.length(text) > 10, "Z").otherwise("T00:00:00Z"))).otherwise(text).try_cast("timestamp"))
    return F.coalesce(by_mail, by_iso)


def feed_items(rows: DataFrame, payload: str, now: Column, max_age_hours: int, pages: DataFrame, least: int = 150, own: int = 300) -> DataFrame:
    """Items of RSS feeds and entries of Atom feeds with link and title, not older than the cutoff: the item's own body if longer than `own`, else its page's (pages: url, body); at least `least` characters.

    Each item is parsed as XML (undeclared prefixes allowed); one that is not well formed is read by its elements' names.
    A link is the element's text, an alternate link's href, or a permanent guid. Items without a date that can be read
    count as of now.
    """
    items = rows.select("*", F.posexplode(F.regexp_extract_all(payload, F.lit("(?s)(<(?:[A-Za-z]+:)?(item|entry)[ >\t\n].*?</(?:[A-Za-z]+:)?\\2>)"), 1)).alias("pos", "_raw"))
    bare = F.regexp_replace("_raw", "<(/?)(?:atom|rss):", "<$1")
    items = items.withColumn("_item", bare).withColumn("_x", F.from_xml("_item", ITEM, {"mode": "PERMISSIVE", "ignoreNamespace": "false"}))
    text = lambda name, tag: F.coalesce(F.nullif(stripped(F.col("_x").getField(name)), F.lit("")), F.nullif(_field(F.col("_item"), tag), F.lit("")))
    shown = F.filter("_x.link", lambda x: F.coalesce(x["_rel"], F.lit("alternate")) == "alternate")
    hrefs = F.filter(F.transform(shown, lambda x: stripped(F.coalesce(x["_href"], x["_VALUE"]))), lambda u: F.coalesce(u, F.lit("")) != "")
    guid = F.when(F.coalesce(F.lower(F.col("_x.guid._isPermaLink")), F.lit("true")) == "true", stripped(F.col("_x.guid._VALUE")))
    link = F.coalesce(F.try_element_at(hrefs, F.lit(1)), F.nullif(_field(F.col("_item"), "link"), F.lit("")), guid)
    at = F.coalesce(*[feed_time(text(c, c)) for c in ("pubDate", "published", "updated", "dc:date")], now)
    body = F.coalesce(text("content:encoded", "content:encoded"), text("content", "content"), text("description", "description"), text("summary", "summary"), F.lit(""))
    found = items.select(*rows.columns, "pos", link.alias("url"), text("title", "title").alias("title"), at.alias("published_at"), body.alias("_own")).drop(payload)
    kept = found.where((F.col("url") != "") & (F.col("title") != "") & (F.col("published_at") >= now - F.make_dt_interval(hours=F.lit(max_age_hours))))
    met = kept.join(pages.select("url", F.col("body").alias("_page")), "url", "left")
    plain = stripped(F.regexp_replace("_own", "(?s)<[^>]*>", "\n"))
    content = F.when(F.length("_own") > own, plain).otherwise(F.coalesce("_page", F.lit("")))
    return met.withColumn("content", content).where(F.length("content") >= least).drop("_own", "_page")


def site_items(rows: DataFrame, payload: str, root: str, cutoff: Column) -> DataFrame:
    """Items of a site's JSON API: title or short text, seconds or milliseconds, own URI or one from its id; body, summary or title."""
    parsed = F.from_json(payload, "data struct<items:array<struct<id:string,title:string,content_short:string,display_time:bigint,uri:string,content_text:string,summary:string>>>")
    items = rows.select("*", F.posexplode(parsed["data"]["items"]).alias("pos", "i")).drop(payload)
    filled = lambda *c: F.coalesce(*[F.nullif(F.col(f"i.{x}"), F.lit("")) for x in c])
    title = F.trim(F.substring(F.coalesce(filled("title", "content_short"), F.lit("")), 1, 200))
    out = items.select(*[c for c in rows.columns if c != payload], "pos", title.alias("title"), epoch(F.coalesce("i.display_time", F.lit(0))).alias("published_at"), F.coalesce(filled("uri"), F.concat(F.lit(root), "i.id")).alias("url"), F.coalesce(filled("content_text", "summary"), title).alias("content"))
    return out.where((F.col("title") != "") & (F.col("published_at") >= cutoff))


def write_reports(reports: DataFrame, root: str) -> None:
    """One folder of JSON lines per report date (reports: date and any columns), replaced whole."""
    reports.repartition("date").write.mode("overwrite").partitionBy("date").json(root)


def read_reports(spark: SparkSession, root: str, schema: str, dates: tuple[str, str] | None = None) -> DataFrame:
    """The reports of write_reports() between two dates; only their folders are read."""
    rows = spark.read.schema(f"{schema}, date date").json(root)
    return rows if dates is None else rows.where(F.col("date").between(*[F.lit(x).cast("date") for x in dates]))


def selected_sources(sources: DataFrame, mode: str, named: list[str] | None = None) -> DataFrame:
    """All sources of a full run; of a delta run the named ones, or else all but portals."""
    if mode != "delta":
        return sources
    return sources.where(F.col("name").isin(*named)) if named else sources.where(F.coalesce(F.col("tier") != "portal", F.lit(True)))


def first_success(attempts: DataFrame) -> DataFrame:
    """Of (source_name, method, ok, items): the first method in order that brought items, and what the ones before came to."""
    place = F.array_position(F.array(*[F.lit(m) for m in METHODS]), F.col("method"))
    ranked = attempts.withColumn("_p", place).withColumn("_hit", F.col("ok") & (F.col("items") > 0))
    won = F.min_by(F.when(F.col("_hit"), F.col("method")), F.when(F.col("_hit"), F.col("_p")))
    until = ranked.withColumn("_first", F.min(F.when(F.col("_hit"), F.col("_p"))).over(Window.partitionBy("source_name")))
    outcome = F.concat("method", F.when(F.col("ok"), ":no_eligible_articles").otherwise(":error"))
    failed = F.array_sort(F.collect_list(F.when(F.col("_first").isNull() | (F.col("_p") < F.col("_first")), F.struct("_p", outcome.alias("o")))))
    return until.groupBy("source_name").agg(won.alias("method"), F.array_join(F.transform(failed, lambda x: x["o"]), ",").alias("outcomes"))


def certifications(entries: DataFrame, known: DataFrame) -> DataFrame:
    """(source_name, code, label) of certification codes; an unknown code fails the query."""
    met = entries.join(checked(known), "code", "left")
    label = F.coalesce("label", F.raise_error(F.concat(F.lit("Unknown certification code: "), "code")).cast("string"))
    return met.select("source_name", "code", label.alias("label"))


def golden_stories(reports: DataFrame, payload: str, key: str) -> DataFrame:
    """(key, headline, urls) of a report's stories with URLs, from its clusters, positive stories and both kinds of families."""
    r = reports.select(key, F.from_json(payload, GOLDEN).alias("r"))
    nothing = F.expr(f"cast(array() as {_STORIES})")
    of = lambda c: F.coalesce(F.col(f"r.{c}"), nothing)
    family = lambda c: F.coalesce(F.flatten(F.transform(f"r.{c}", lambda f: F.coalesce(F.when(F.size(f["clusters"]) > 0, f["clusters"]), f["summaries"], nothing))), nothing)
    stories = r.select(key, F.explode(F.concat(of("clusters"), of("positive_stories"), family("hot_topics"), family("focus_storylines"))).alias("s"))
    links = lambda c: F.coalesce(F.transform(f"s.{c}", lambda x: F.coalesce(F.nullif(x["url"], F.lit("")), x["link"])), F.array().cast("array<string>"))
    urls = F.array_distinct(F.filter(F.concat(links("articles"), links("footer_sources"), links("footer_sources_en"), links("source_groups"), F.array("s.url")), lambda u: F.coalesce(u, F.lit("")) != ""))
    return stories.select(key, F.coalesce(F.nullif("s.headline", F.lit("")), F.nullif("s.topic", F.lit("")), F.lit("?")).alias("headline"), urls.alias("urls")).where(F.size("urls") > 0)


def report_files(spark: SparkSession, root: str) -> DataFrame:
    """(day, name, text) of the files in folders named by a date; read whole, one row each."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    return files.select(F.regexp_extract("path", "/([0-9]{4}-[0-9]{2}-[0-9]{2})/[^/]+$", 1).alias("day"), F.regexp_extract("path", "([^/]+)$", 1).alias("name"), F.decode("content", "UTF-8").alias("text")).where("day <> ''")


def report_dates(files: DataFrame) -> DataFrame:
    """Days whose folder has an index, less those whose data says that it has no stories; unreadable data keeps the day."""
    number = F.get_json_object("text", "$.total_cluster_count").try_cast("bigint")
    g = files.groupBy("day").agg(F.max(F.col("name") == "index.html").alias("index"), F.max(F.when((F.col("name") == "data.json") & F.get_json_object("text", "$.total_cluster_count").isNotNull(), number)).alias("n"))
    return g.where(F.col("index") & (F.coalesce("n", F.lit(1)) > 0)).select("day")


def query_list(value: Column) -> Column:
    """A comma list's non-blank entries."""
    return F.filter(F.transform(F.split(F.coalesce(value, F.lit("")), ","), lambda x: F.trim(x)), lambda x: x != "")


def window_candidates(articles: DataFrame, now: Column, hours: int, cap: int, per_source: int = 15) -> DataFrame:
    """Organic articles of the hours before a moment, the newest `cap`, then each source's newest."""
    recent = articles.where(~F.col("is_searched") & (F.col("published_at") <= now) & (F.col("published_at") >= now - F.make_dt_interval(hours=F.lit(hours))))
    newest = recent.orderBy(F.desc("published_at"), "id").limit(cap)
    place = F.row_number().over(Window.partitionBy("source_name").orderBy(F.desc("published_at"), "id"))
    return newest.withColumn("_r", place).where(F.col("_r") <= per_source).drop("_r")
