"""Report assembly: source entries with their provenance, failure labels, perspective payloads and counts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewire.functions.text import preview
from tidewire.runtime import checked

# Labels of search failures (Chinese, English), of provenance and of search stages, and texts that are no perspective.
FAILURES = {
    "http_401": ("鉴权失败", "Auth failed"), "http_403": ("鉴权失败", "Auth failed"), "http_402": ("额度不足", "Quota exceeded"), "http_429": ("限流", "Rate limited"),
    "network": ("网络错误", "Network error"), "official_not_found": ("未找到官方回应", "No official response found"), "country_fallback_not_found": ("未找到当地报道", "No local reporting found"),
    "candidate_unverified": ("来源未能核验", "Source could not be verified"), "candidate_pending_review": ("来源待人工核验", "Source pending review"), "not_official_source": ("非官方来源", "Not an official source"),
    "not_related_country_source": ("非相关当地来源", "Not related local reporting"), "empty_results": ("无新结果", "No fresh results"), "no_acceptable_result": ("无可用结果", "No acceptable result"),
    "stale_result": ("结果过旧", "Result too old"), "region_mismatch": ("地区不匹配", "Region mismatch"), "event_mismatch": ("事件不匹配", "Event mismatch"), "duplicate_of_existing": ("已有相同报道", "Duplicate of existing"),
    "thin_result": ("结果内容过少", "Result too thin"), "query_generation_failed": ("查询生成失败", "Query generation failed"), "entity_mismatch": ("实体不匹配", "Entity mismatch"), "invalid_result_url": ("结果链接无效", "Invalid result URL"),
    "publisher_target_mismatch": ("发布者与目标不匹配", "Publisher does not match target"), "publisher_binding_unverified": ("未确认官方归属", "Official ownership unverified"),
    "official_binding_not_found": ("未找到可信官方渠道", "No verified official channel found"), "official_skipped_low_budget": ("官方渠道搜索已让位于本地搜索", "Official search deferred to preserve local-search budget"),
    "request_budget_exhausted": ("本轮搜索额度已用完", "Search budget exhausted"), "coverage_satisfied": ("已有合格来源", "Qualifying coverage already exists"), "identity_binding_resolved": ("已确认官方渠道", "Official channel verified"),
    "country_target_official_forbidden": ("国家目标不可使用官方搜索", "Country target cannot use official search"), "unknown": ("未知原因", "Unknown reason"),
}
STAGES = {"official": ("官方", "Official"), "country": ("当地", "Local")}
NO_PERSPECTIVE = "(?i)无关|不相关|未提供.{0,8}(视角|信息|内容)|未稳定提炼出可单列的差异化视角|not related|unrelated|irrelevant|no distinct perspective could be extracted"
SAME_ANGLE = "(?i)未稳定提炼出可单列的差异化视角|未提供.{0,8}(视角|信息|内容)|no distinct perspective could be extracted|reports? a similar angle to the main summary"
BACKGROUND_ROLES = ("background_context", "official_confirmation", "background")
BACKGROUND_REASONS = ("background_context", "official_confirmation", "stale_result", "event_mismatch")
OLD = ("stale", "old", "background")


def _among(value: Column, values: tuple) -> Column:
    return F.coalesce(F.lower(F.trim(value)).isin(*values), F.lit(False))


def is_background(evidence: Column, reason: Column, freshness: Column) -> Column:
    """search material that gives context only."""
    return _among(evidence, BACKGROUND_ROLES) | _among(reason, BACKGROUND_REASONS) | _among(freshness, OLD)


def has_evidence(evidence: Column, reason: Column, freshness: Column) -> Column:
    """An accepted article's freshness, role or reason tells why it counts."""
    given = lambda c: F.coalesce(c, F.lit("")) != ""
    return given(freshness) | given(evidence) | F.coalesce(reason == "current_event_perspective", F.lit(False))


def counts_as_perspective(placeholder: Column, searched: Column, status: Column, evidence: Column, reason: Column, freshness: Column) -> Column:
    """organic articles count; searched ones if accepted (or never judged), with evidence, and current."""
    accepted = F.coalesce(status == "accepted", F.lit(True)) & ~(F.coalesce(status == "accepted", F.lit(False)) & ~has_evidence(evidence, reason, freshness))
    return ~placeholder & ~is_background(evidence, reason, freshness) & (~searched | (accepted & ~_among(freshness, OLD)))


def is_renderable(text: Column) -> Column:
    """some text, and none that says there is no perspective."""
    flat = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), "\\s+", " "))
    return (flat != "") & ~flat.rlike(NO_PERSPECTIVE)


def is_distinct(text: Column) -> Column:
    """some text, and none that says it is the main summary's angle."""
    flat = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), "\\s+", " "))
    return (flat != "") & ~flat.rlike(SAME_ANGLE)


def failure_label(reason: Column, language: int = 1) -> Column:
    """The label of a failure (0 Chinese, 1 English): the first of a comma list, other HTTP codes by template."""
    first = F.trim(F.element_at(F.split(F.coalesce(reason, F.lit("")), ","), 1))
    known = F.create_map(*[F.lit(x) for k, v in FAILURES.items() for x in (k, v[language])])
    code = F.regexp_extract(first, "^http_(.*)$", 1)
    code = F.when(code != "", code).otherwise("error")
    template = F.concat(F.lit(("搜索服务错误（HTTP ", "Search service error (HTTP ")[language]), code, F.lit(("）", ")")[language]))
    return F.coalesce(F.try_element_at(known, first), F.when(first.startswith("http_"), template), F.lit(FAILURES["unknown"][language]))


def stage_detail(trace: Column, language: int = 1) -> Column:
    """The attempted stages with their reasons, of an array of (stage, reason); null for none."""
    known = F.create_map(*[F.lit(x) for k, v in STAGES.items() for x in (k, v[language])])
    low = lambda c: F.lower(F.trim(F.coalesce(c, F.lit(""))))
    other = lambda s: F.when(s != "", s if language == 0 else F.initcap(s)).otherwise(("搜索", "Search")[language])
    told = F.transform(trace, lambda t: F.concat(F.coalesce(F.try_element_at(known, low(t["stage"])), other(low(t["stage"]))), F.lit(("：", ": ")[language]), failure_label(low(t["reason"]), language)))
    return F.when(F.size(trace) > 0, F.array_join(told, ("；", "; ")[language]))


def pending_label(source: Column) -> Column:
    """The English form of a source name that marks a missing voice."""
    inner = F.regexp_replace(F.trim(source), "^\\[(.*)\\]$", "$1")
    for mark, english in (("声音待补", " voice pending"), ("视角待补", " perspective pending"), ("待补", " pending")):
        inner = F.replace(inner, F.lit(mark), F.lit(english))
    inner = F.trim(F.regexp_replace(inner, "\\s+", " "))
    return F.when(F.trim(source).rlike("^\\[.*\\]$"), F.concat(F.lit("["), inner, F.lit("]"))).otherwise(inner)


def provenance(kind: Column, platform: Column, searched: Column, status: Column, evidence: Column, reason: Column, freshness: Column, language: int = 1) -> Column:
    """What a source's label says about where it is from: searched background, review-only, official channel, search, or nothing."""
    name = lambda zh, en: F.lit((zh, en)[language])
    review = searched & F.coalesce(status == "accepted", F.lit(False)) & ~has_evidence(evidence, reason, freshness)
    social = F.when(platform == "x", name("官方X", "Official X")).when(platform == "youtube", name("官方YouTube", "Official YouTube")).otherwise(name("官方渠道", "Official channel"))
    return (
        F.when(searched & is_background(evidence, reason, freshness), name("背景资料", "Background context")).when(review, name("待核验", "Review only"))
        .when(kind == "official_web", name("官方网站", "Official website")).when(kind == "official_social", social).when(searched, name("搜索补充", "Search supplement"))
    )


def source_label(language: int = 1, at: Callable[[str], Column] = F.col) -> Column:
    """How a source is shown in a list, of a search view's columns (or whatever `at` finds by their names): its name with its provenance, or what is missing."""
    said = provenance(at("source_kind"), at("platform"), at("is_searched"), *[at(c) for c in ("status", "evidence", "reason", "freshness")], language=language)
    shown = F.concat(F.when(at("is_searched"), "🔍").otherwise(""), at("source_name"), F.when(said.isNotNull(), F.concat(F.lit(" · "), said)).otherwise(""))
    return F.when(at("is_placeholder"), F.concat(F.lit("🔍"), pending_label(at("source_name")) if language else at("source_name"))).otherwise(shown)


def source_entries(articles: DataFrame, certifications: DataFrame, language: int = 1) -> DataFrame:
    """Articles (a search view's columns) with label, url, certification codes and whether they count as a perspective.

    A placeholder shows its failure instead of a provenance and has no URL. certifications: source_name, codes.
    """
    args = [F.col(c) for c in ("status", "evidence", "reason", "freshness")]
    said = provenance(F.col("source_kind"), F.col("platform"), F.col("is_searched"), *args, language=language)
    label = F.when(F.col("is_placeholder"), failure_label(F.col("reason"), language)).otherwise(said)
    met = articles.join(checked(certifications), "source_name", "left")
    counts = counts_as_perspective(F.col("is_placeholder"), F.col("is_searched"), *args)
    return met.select("cluster_id", "pos", "source_name", source_label(language).alias("label"), label.alias("provenance"), F.when(~F.col("is_placeholder"), F.col("url")).alias("url"), F.coalesce("codes", F.array().cast("array<string>")).alias("codes"), counts.alias("counts"))


def article_meta(articles: DataFrame, fields: list[str]) -> DataFrame:
    """Per cluster and source its articles' fields, in member order."""
    g = articles.groupBy("cluster_id", "source_name").agg(F.array_sort(F.collect_list(F.struct("pos", *fields))).alias("entries"))
    return g.select("cluster_id", "source_name", F.transform("entries", lambda e: F.struct(*[e[f].alias(f) for f in fields])).alias("entries"))


def count_columns() -> list[Column]:
    """What summary_counts() counts, as aggregates of a search view's columns."""
    real, organic = ~F.col("is_placeholder"), ~F.col("is_placeholder") & ~F.col("is_searched")
    kinds = lambda c: F.size(F.collect_set(c)).cast("bigint")
    return [
        F.count_if(real).alias("real_articles"), F.count_if(~real).alias("placeholders"), kinds(F.when(real, F.col("source_name"))).alias("real_sources"),
        kinds(F.when(~real, F.col("source_name"))).alias("placeholder_sources"), kinds(F.when(organic, F.col("source_name"))).alias("organic_sources"),
        kinds(F.when(organic & (F.coalesce("region", F.lit("")) != ""), F.col("region"))).alias("organic_regions")]


def summary_counts(articles: DataFrame) -> DataFrame:
    """Per cluster: real and placeholder articles and sources, organic sources and regions. Articles are shuffled once, narrow; names are told apart where their cluster is."""
    rows = articles.select("cluster_id", "source_name", "region", "is_placeholder", "is_searched").repartition("cluster_id")
    return rows.groupBy("cluster_id").agg(*count_columns())


def perspective_payload(groups: DataFrame, articles: DataFrame) -> DataFrame:
    """Per cluster of groups (cluster_id, pos, sources, text): shown and suppressed groups, and a preview of the first two.

    A group shows if a source of its counts as a current perspective and its text is one; ineligible sources leave it.
    Groups count as distinct only for clusters of two real sources at least.
    """
    args = ("is_placeholder", "is_searched", "status", "evidence", "reason", "freshness")
    counts, real = counts_as_perspective(*[F.col(c) for c in args]), ~F.col("is_placeholder")
    #: Members and groups meet at their cluster, and travel no more if they lie there. A real source without name is one of its own.
    nameless = F.coalesce(F.max(F.when(real & F.col("source_name").isNull(), 1)), F.lit(0))
    voices = articles.groupBy("cluster_id").agg(F.collect_set(F.when(counts, F.col("source_name"))).alias("eligible"), (F.size(F.collect_set(F.when(real, F.col("source_name")))) + nameless >= 2).alias("multi"))
    met = groups.join(voices, "cluster_id", "left")
    sources = F.size(F.filter("sources", lambda s: F.array_contains("eligible", s)))
    g = met.groupBy("cluster_id", "pos").agg(F.first("text").alias("text"), F.sum(F.greatest(F.coalesce(sources, F.lit(0)), F.lit(0)).cast("bigint")).alias("sources"), F.first("multi").alias("multi"))
    g = g.withColumn("shown", (F.col("sources") > 0) & is_renderable(F.col("text")))
    first = F.transform(F.slice(F.array_sort(F.collect_list(F.when(F.col("shown"), F.struct("pos", "text")))), 1, 2), lambda x: preview(x["text"]))
    out = g.groupBy("cluster_id").agg(F.count_if("shown").alias("shown"), F.count_if(~F.col("shown")).alias("suppressed"), first.alias("first"), F.sum(F.when(F.col("shown"), F.col("sources"))).alias("shown_sources"), F.coalesce(F.first("multi"), F.lit(False)).alias("multi"))
    distinct = F.when(F.col("multi"), F.col("shown")).otherwise(F.lit(0))
    return out.select("cluster_id", distinct.cast("bigint").alias("distinct_perspectives"), "suppressed", F.coalesce("shown_sources", F.lit(0)).cast("bigint").alias("shown_sources"), (F.col("multi") & (F.col("shown") >= 2)).alias("expandable"), F.when(F.col("shown") >= 2, F.array_join("first", " / ")).otherwise("").alias("preview"))


def bilingual_groups(chinese: DataFrame, english: DataFrame, fallback: str = "") -> DataFrame:
    """Chinese groups (cluster_id, pos, text) with the English text of the same place among the cluster's groups, or the fallback."""
    placed = lambda d, name: d.select("cluster_id", F.row_number().over(Window.partitionBy("cluster_id").orderBy("pos")).alias("place"), F.col("text").alias(name))
    return placed(chinese, "text").join(placed(english, "text_en"), ["cluster_id", "place"], "left").select("cluster_id", "place", "text", F.coalesce("text_en", F.lit(fallback)).alias("text_en"))


def english_available(summaries: DataFrame, group: str, english: str, chinese_ok: str, label_en: str) -> DataFrame:
    """Per edition: all its summaries have English, are Chinese in Chinese, and have an English label where they belong to a family (label not null)."""
    whole = (F.coalesce(F.col(english), F.lit("")) != "") & F.col(chinese_ok) & (F.coalesce(F.col(label_en), F.lit("-")) != "")
    return summaries.groupBy(group).agg(F.min(F.coalesce(whole, F.lit(False))).alias("available"))


def family_display(members: DataFrame, family: str, order: list) -> DataFrame:
    """Members with display rank, and their family's numbers of core and spillover members."""
    w = Window.partitionBy(family)
    return members.withColumn("core_count", F.count_if(F.col("role") == "core").over(w)).withColumn("spillover_count", F.count_if(F.col("role") == "spillover").over(w)).withColumn("display_rank", F.row_number().over(w.orderBy(*order)))
