"""Editions: profiles, labels, links, digests, telemetry rows and retention around a day's report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewire.functions.text import char_ngrams, preview

# Outcomes of a search stage, and reserves of a run's search budget.
OFFICIAL_RESERVE, FALLBACK_RESERVE = 2, 10
_CJK = "([\\x{4e00}-\\x{9fff}])"


def cjk(text: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(_CJK), 1)


def profiles(clusters: DataFrame, articles: DataFrame) -> DataFrame:
    """Per cluster (cluster_id, label): its text (label and first three titles), lead title and title n-grams. articles: cluster_id, pos, title."""
    first = F.slice(F.array_sort(F.collect_list(F.struct("pos", "title"))), 1, 3)
    g = articles.groupBy("cluster_id").agg(F.transform(first, lambda x: x["title"]).alias("titles"))
    met = clusters.join(g, "cluster_id", "left").withColumn("titles", F.coalesce("titles", F.array().cast("array<string>")))
    lead = F.coalesce(F.try_element_at("titles", F.lit(1)), F.col("label"))
    return met.select("cluster_id", F.array_join(F.concat(F.array("label"), "titles"), " ").alias("text"), lead.alias("lead"), char_ngrams(lead).alias("grams"))


def stamped(clusters: DataFrame, assignment: DataFrame) -> DataFrame:
    """Clusters with their storyline's key, name, role and state; those in none are singles of their own key."""
    met = clusters.join(assignment, "cluster_id", "left")
    single = F.col("storyline_key").isNull()
    key = F.coalesce("storyline_key", F.concat(F.lit("single-"), F.substring(F.sha1(F.col("label").cast("binary")), 1, 8)))
    return met.select("cluster_id", key.alias("storyline_key"), F.coalesce("storyline_name", "label").alias("storyline_name"), F.when(single, "none").otherwise(F.col("role")).alias("role"), F.when(single, "single").otherwise("member").alias("membership"))


def evidence_sentences(summaries: DataFrame, articles: DataFrame) -> DataFrame:
    """Summaries (cluster_id, assessed) with the sentence that counts their sources and regions; empty without an assessment."""
    g = articles.groupBy("cluster_id").agg(F.countDistinct("source_name").alias("s"), F.countDistinct(F.when(~F.col("is_placeholder") & (F.col("region") != ""), F.col("region"))).alias("r"))
    met = summaries.join(g, "cluster_id", "left")
    told = F.format_string("%d 个来源、%d 个地区参与评估。", F.coalesce("s", F.lit(0)), F.coalesce("r", F.lit(0)))
    return met.select("cluster_id", F.when(F.col("assessed"), told).otherwise("").alias("evidence"))


def formatted_articles(articles: DataFrame, limit: int = 1600) -> DataFrame:
    """Per cluster its real articles, numbered in order, with the first `limit` characters of each as a prompt takes them."""
    real = articles.where("NOT is_placeholder").withColumn("k", F.row_number().over(Window.partitionBy("cluster_id").orderBy("pos")))
    line = F.concat(F.lit("["), F.col("k").cast("string"), F.lit("] 来源："), "source_name", F.lit("\n标题："), "title", F.lit("\n内容："), F.substring("content", 1, limit), F.lit("\n"))
    return real.groupBy("cluster_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", line.alias("line")))), lambda x: x["line"]), "\n").alias("text"))


def repaired_labels(cards: DataFrame, tabs: DataFrame) -> DataFrame:
    """Cards (id, key, label, headline) take their family's tab label, and lose it where it shares no CJK character with a CJK headline."""
    met = cards.join(tabs.select("key", F.col("label").alias("tab")), "key", "left")
    label = F.when(F.coalesce("label", F.lit("")) != "", F.coalesce(F.nullif("tab", F.lit("")), "label")).otherwise("")
    off = (F.size(cjk(label)) > 0) & (F.size(cjk(F.col("headline"))) > 0) & ~F.arrays_overlap(cjk(label), cjk(F.col("headline")))
    return met.select("id", F.when(off, "").otherwise(label).alias("label"))


def edition_paths(days: DataFrame) -> DataFrame:
    """Of (day, has_english, has_chinese): the English and Chinese page of each day, and the days before and after in each edition."""
    english = F.when(F.col("has_english"), F.concat(F.lit("/"), "day", F.lit("/")))
    chinese = F.when(F.col("has_english") & F.col("has_chinese"), F.concat(F.lit("/cn/"), "day", F.lit("/"))).when(F.col("has_chinese"), F.concat(F.lit("/"), "day", F.lit("/")))
    p = days.select("day", english.alias("en"), chinese.alias("zh"))
    before, after = Window.orderBy("day").rowsBetween(Window.unboundedPreceding, -1), Window.orderBy("day").rowsBetween(1, Window.unboundedFollowing)
    return p.select("day", "en", "zh", F.last("en", ignorenulls=True).over(before).alias("en_previous"), F.first("en", ignorenulls=True).over(after).alias("en_next"))


def seo_description(headlines: DataFrame, group: str, order: list, limit: int = 155) -> DataFrame:
    """Each group's first three headlines joined, cut to the limit."""
    top = headlines.withColumn("_r", F.row_number().over(Window.partitionBy(group).orderBy(*order))).where("_r <= 3")
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_r", "headline"))), lambda x: x["headline"]), "; ")
    return top.groupBy(group).agg(preview(joined, limit).alias("description"))


def digest_items(rows: DataFrame, group: str, order: list) -> DataFrame:
    """Main items, then positive ones that are Chinese, numbered; a header where the category changes."""
    kept = rows.where((F.col("lane") == "main") | ((F.col("lane") == "positive") & F.col("is_chinese")))
    w = Window.partitionBy(group).orderBy(F.when(F.col("lane") == "main", 0).otherwise(1), *order)
    return kept.withColumn("number", F.row_number().over(w)).withColumn("header", ~F.lag("category").over(w).eqNullSafe(F.col("category")))


def stage_groups(rows: DataFrame, key: str, least: int = 4) -> DataFrame:
    """Storylines of fresh members with members, cores and whether they nearly became hot: enough members and a core, but not hot."""
    fresh = rows.where("freshness <> 'stale'")
    g = fresh.groupBy(key).agg(F.count("*").alias("members"), F.count_if(F.col("role") == "core").alias("cores"), F.max("hot").alias("hot"))
    return g.withColumn("near_miss", (F.col("members") >= least) & (F.col("cores") > 0) & ~F.col("hot")).drop("hot")


def search_queries(targets: DataFrame, languages: DataFrame, most: int = 2) -> DataFrame:
    """The ordered, distinct queries of a target (id, label, role, region, country, keyword, stage, scoped): localised ones first, English last.

    languages: region, language, pos and prefix (what localising puts before the English text); English is not localised.
    """
    scoped = F.when((F.col("role") != "country") & F.col("scoped"), F.concat("label", F.lit(" "))).otherwise("")
    english = F.when(F.col("stage") == "official", F.concat("label", F.lit(" official statement "), "keyword")).otherwise(F.concat(scoped, "keyword", F.lit(" "), "country", F.lit(" local news")))
    base = targets.withColumn("english", english)
    ranked = languages.withColumn("_r", F.row_number().over(Window.partitionBy("region").orderBy("pos"))).where((F.col("_r") <= most) & (F.col("language") != "en"))
    local = base.join(F.broadcast(ranked), "region").select("id", "_r", F.concat("prefix", F.lit(" "), "english").alias("query"))
    both = local.union(base.select("id", F.lit(most + 1), "english"))
    first = both.groupBy("id", "query").agg(F.min("_r").alias("_r"))
    return first.withColumn("place", F.row_number().over(Window.partitionBy("id").orderBy("_r", "query"))).select("id", "place", "query")


def search_rows(candidates: DataFrame) -> DataFrame:
    """Telemetry of candidates (run, provider, decision, reason): a request row, an acceptance row, and one for each reason, per run and provider."""
    g = candidates.groupBy("run", "provider").agg(F.count("*").alias("results"), F.count_if(F.col("decision") == "accepted").alias("accepted"), F.count_if(F.col("decision") == "rejected").alias("rejected"), F.array_join(F.array_sort(F.collect_set("reason")), ",").alias("reasons"))
    request = g.select("run", "provider", F.lit("search").alias("type"), F.col("results").alias("n"), F.lit(None).cast("string").alias("reason"))
    acceptance = g.select("run", "provider", F.lit("acceptance").alias("type"), F.col("accepted").alias("n"), F.nullif("reasons", F.lit("")).alias("reason"))
    raw = candidates.where("decision = 'rejected'").groupBy("run", "provider", "reason").agg(F.count("*").alias("n")).select("run", "provider", F.lit("rejection").alias("type"), "n", "reason")
    return request.unionByName(acceptance).unionByName(raw)


def budgeted(requests: DataFrame, run: str, order: list, budget: int) -> DataFrame:
    """Whether a request runs: official ones leave OFFICIAL_RESERVE of the budget to country ones, entity-free fallbacks need FALLBACK_RESERVE left; skipped requests cost nothing before themselves."""
    w = Window.partitionBy(run).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    left = F.lit(budget) - F.coalesce(F.count("*").over(w), F.lit(0))
    need = F.when(F.col("stage") == "official", OFFICIAL_RESERVE + 1).when(F.col("stage") == "fallback", FALLBACK_RESERVE).otherwise(1)
    return requests.withColumn("left", left).withColumn("runs", F.col("left") >= need)


def publishable_days(flags: DataFrame, staging: DataFrame, today: Column, keep_days: int) -> tuple[DataFrame, DataFrame]:
    """Days whose flag (day, summaries, pushed) is complete and not pushed yet, and staging folders (day) too old to keep."""
    ready = flags.where((F.coalesce("summaries", F.lit(0)) > 0) & ~F.coalesce("pushed", F.lit(False))).select("day")
    return ready, staging.where(F.datediff(today, F.to_date("day")) > keep_days).select("day")


def salvaged(answer: Column, schema: str) -> Column:
    """The objects of a list, complete ones of a truncated answer too, each parsed on its own."""
    return F.filter(F.transform(F.regexp_extract_all(F.coalesce(answer, F.lit("")), F.lit("(\\{[^{}]*\\})"), 1), lambda x: F.from_json(x, schema)), lambda x: x.isNotNull())


def hashed_vector(text: Column, size: int = 64) -> Column:
    """A text's words counted in `size` slots by hash, as a unit vector; a stand-in where no embedding is given. Null without words."""
    words = F.regexp_extract_all(F.lower(text), F.lit("([\\p{L}\\p{N}]+)"), 1)
    slots = F.transform(words, lambda w: F.pmod(F.crc32(w.cast("binary")), F.lit(size)).cast("int"))
    counted = lambda own: F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: F.size(F.filter(own, lambda s: s == i)).cast("double"))
    norm = lambda counts: F.sqrt(F.aggregate(counts, F.lit(0.0), lambda a, x: a + x * x))
    scaled = lambda counts: _once(norm(counts), lambda n: F.transform(counts, lambda x: x / n))
    return _once(slots, lambda own: F.when(F.size(own) > 0, _once(counted(own), scaled)))


def _once(value: Column, then) -> Column:
    """then(value), with the value computed once: a column that a lambda names is computed anew for each of its elements."""
    return F.transform(F.array(value), then)[0]


def ragged_union(parts: list[DataFrame]) -> DataFrame:
    """Tables of different columns, one under the other; what a table lacks is null."""
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part, allowMissingColumns=True)
    return out


def round_trip(assessments: DataFrame) -> DataFrame:
    """The items that assessments were made from: dimensions and what the model said, without what is derived."""
    return assessments.where("evaluated").drop("signal", "composite", "status", "flags", "evaluated")
