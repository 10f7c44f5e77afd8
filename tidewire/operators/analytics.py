"""Reporting analytics over evaluations, members and telemetry. DataFrame in, DataFrame out."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewire.functions.text import is_real

from tidewire.sources.views import DIMENSIONS


def filter_rows(rows: DataFrame, categories: Sequence[str] = (), statuses: Sequence[str] = (), selection: str = "all", composite_min: float | None = None, composite_max: float | None = None, subject_regions: Sequence[str] = (), has_feedback: bool | None = None) -> DataFrame:
    """conjunctive facets; an empty list or None filters nothing, bounds are inclusive."""
    if categories:
        rows = rows.where(F.col("display_category").isin(list(categories)))
    if statuses:
        rows = rows.where(F.col("status").isin(list(statuses)))
    if selection != "all":
        rows = rows.where(F.coalesce("selected", F.lit(False)) == F.lit(selection == "selected"))
    if composite_min is not None:
        rows = rows.where(F.coalesce("composite", F.lit(0.0)) >= composite_min)
    if composite_max is not None:
        rows = rows.where(F.coalesce("composite", F.lit(0.0)) <= composite_max)
    if subject_regions:
        rows = rows.where(F.arrays_overlap("subject_regions", F.array(*[F.lit(r) for r in subject_regions])))
    if has_feedback is not None:
        rows = rows.where(F.col("verdict").isNotNull() if has_feedback else F.col("verdict").isNull())
    return rows


def latest_verdicts(feedback: DataFrame) -> DataFrame:
    """The verdict of the highest feedback id per cluster."""
    return feedback.groupBy("cluster_id").agg(F.max_by("verdict", "id").alias("verdict"))


def with_latest_verdict(evaluations: DataFrame, feedback: DataFrame) -> DataFrame:
    """Evaluations with their cluster's latest verdict, pre-aggregated instead of a correlated subquery."""
    return evaluations.join(latest_verdicts(feedback), "cluster_id", "left")


def category_dimension(rows: DataFrame) -> DataFrame:
    """Mean of each dimension per category, one decimal, halves to even."""
    means = [F.bround(F.avg(F.coalesce(d, F.lit(0.0))), 1).alias(d) for d in DIMENSIONS]
    return rows.groupBy(F.coalesce("display_category", F.lit("?")).alias("category")).agg(*means)


def _subjects(regions: Column) -> Column:
    return F.when(F.size(regions) > 0, regions).otherwise(F.array(F.lit("?")))


def subject_category(rows: DataFrame) -> DataFrame:
    """Selected stories by subject region and category."""
    chosen = rows.where("selected").select(F.explode(_subjects(F.col("subject_regions"))).alias("region"), F.coalesce("display_category", F.lit("?")).alias("category"))
    return chosen.groupBy("region", "category").agg(F.count("*").alias("n"))


def source_regions(members: DataFrame, sources: DataFrame) -> DataFrame:
    """cluster_id, source name and region of each member."""
    return members.join(sources.select("source_id", F.col("name").alias("source_name"), F.col("region").alias("origin_region")), "source_id")


def article_regions(clusters: DataFrame, articles: DataFrame, sources: DataFrame) -> DataFrame:
    """cluster_id, source name and region of each real article of each cluster (id, article_ids), repeated ones kept.

    articles: id, url, source_name; sources: name, region (null where the source is unknown).
    """
    listed = clusters.select(F.col("id").alias("cluster_id"), F.explode("article_ids").alias("id"))
    real = articles.where(is_real(F.col("url"))).select("id", "source_name")
    return listed.join(real, "id").join(sources.select(F.col("name").alias("source_name"), F.col("region").alias("origin_region")), "source_name", "left").select("cluster_id", "source_name", "origin_region")


def source_subject(rows: DataFrame, member_regions: DataFrame) -> DataFrame:
    """Source region by subject region; every pair counts once per selected cluster."""
    subjects = rows.where("selected AND cluster_id IS NOT NULL").select("cluster_id", F.explode(_subjects(F.col("subject_regions"))).alias("subject_region"))
    origins = member_regions.select("cluster_id", F.coalesce("origin_region", F.lit("?")).alias("source_region")).distinct()
    met = subjects.join(origins, "cluster_id", "left").select(F.coalesce("source_region", F.lit("?")).alias("source_region"), "subject_region")
    return met.groupBy("source_region", "subject_region").agg(F.count("*").alias("n"))


def trends(rows: DataFrame) -> DataFrame:
    """Per date: selected, candidates, accept rate (null without verdicts), mean composite."""
    chosen = F.coalesce("selected", F.lit(False))
    return rows.groupBy("report_date").agg(
        F.count_if(chosen).alias("selected"), F.count_if(~chosen).alias("candidates"),
        F.round(F.count_if(F.col("verdict") == 1) / F.nullif(F.count("verdict"), F.lit(0)), 2).alias("accept_rate"), F.round(F.avg("composite"), 3).alias("composite_avg"))


def source_review(rows: DataFrame, member_regions: DataFrame) -> DataFrame:
    """Per source: composites of the selected clusters it is in, each once, and their number."""
    chosen = rows.where("selected AND cluster_id IS NOT NULL").select("cluster_id", "composite")
    once = member_regions.select(F.coalesce("source_name", F.lit("?")).alias("source"), "cluster_id").distinct()
    return once.join(chosen, "cluster_id").groupBy("source").agg(F.round(F.sum("composite"), 4).alias("contribution"), F.count("*").alias("clusters"))


def source_contribution(rows: DataFrame, member_regions: DataFrame) -> DataFrame:
    """Per source: appearances, impact-weighted sum, clusters it has alone, selected ones."""
    once = member_regions.select("source_name", "cluster_id").distinct()
    alone = once.groupBy("cluster_id").agg((F.count("*") == 1).alias("alone"))
    met = once.join(rows.select("cluster_id", "composite", "selected"), "cluster_id").join(alone, "cluster_id")
    return met.groupBy("source_name").agg(F.count("*").alias("appearances"), F.round(F.sum("composite"), 3).alias("impact_weighted"), F.count_if("alone").alias("exclusive"), F.count_if("selected").alias("selected_count"))


def zero_contribution(sources: DataFrame, active: DataFrame) -> DataFrame:
    """Configured sources without any contribution."""
    return sources.select(F.col("name").alias("source_name")).join(active.select("source_name").distinct(), "source_name", "left_anti")


def top_counter(rows: DataFrame, key: str, position: str, weight: Column | None = None, limit: int = 25) -> DataFrame:
    """Most frequent values, ties in order of first appearance; a weight of null or 0 counts 1."""
    n = F.count("*") if weight is None else F.sum(F.when(F.coalesce(weight, F.lit(0)) == 0, 1).otherwise(weight))
    counted = rows.groupBy(key).agg(n.cast("bigint").alias("n"), F.min(position).alias("first"))
    return counted.orderBy(F.desc("n"), "first").limit(limit).select(key, "n")


def quality_summary(rows: DataFrame, score: str, low: float = 0.45) -> DataFrame:
    """Mean score to four decimals, number below `low`, and the least of two counters."""
    return rows.agg(F.round(F.avg(score), 4).alias("avg_quality"), F.count_if(F.col(score) < low).alias("low_score"), F.least(F.count_if(F.col(score) < low), F.count_if("selected")).alias("low_capped"))


def flag_histogram(rows: DataFrame, flags: str = "flags") -> DataFrame:
    """How often each flag occurs. Flags are computed once for each row: a plain explode would test for them first, by computing them."""
    each = rows.select(F.posexplode_outer(flags).alias("_k", "flag")).where("_k IS NOT NULL")
    return each.groupBy("flag").agg(F.count("*").alias("n"))


def one_angle(perspectives: DataFrame) -> DataFrame:
    """A10: clusters with at most one distinct non-blank perspective in (cluster_id, perspective)."""
    clean = F.nullif(F.trim("perspective"), F.lit(""))
    return perspectives.groupBy("cluster_id").agg(F.countDistinct(clean).alias("angles")).where("angles <= 1")


def marker_leaks(texts: DataFrame, text: str, marker: str = "**") -> DataFrame:
    """Documents that hold the marker, and its occurrences."""
    n = (F.length(text) - F.length(F.replace(F.col(text), F.lit(marker), F.lit("")))) / len(marker)
    return texts.agg(F.count("*").alias("documents"), F.count_if(n > 0).alias("leaking"), F.coalesce(F.sum(n.cast("bigint")), F.lit(0)).alias("leaks"))


def ownership_audit(members: DataFrame) -> DataFrame:
    """Suppressed members by source: number, up to three sample clusters, share of all in percent."""
    total = F.sum("n").over(Window.partitionBy())
    counted = _with_samples(members)
    return counted.withColumn("pct", F.round(100 * F.col("n") / total, 1))


def _with_samples(members: DataFrame) -> DataFrame:
    ranked = members.withColumn("r", F.row_number().over(Window.partitionBy("source_name", "tier").orderBy("cluster_id")))
    samples = ranked.where("r <= 3").groupBy("source_name", "tier").agg(F.concat_ws(",", F.sort_array(F.collect_list("cluster_id"))).alias("samples"))
    return members.groupBy("source_name", "tier").agg(F.count("*").alias("n")).join(samples, ["source_name", "tier"])


def heat_class(value: Column, scale: float) -> Column:
    """C11: c0 to c4 for a value in [0, scale]."""
    if scale <= 0:
        return F.lit("c0")
    share = F.greatest(F.lit(0.0), F.least(F.lit(1.0), value / scale))
    return F.concat(F.lit("c"), F.least(F.lit(4), F.floor(share * 5)).cast("string"))


def first_seen(rows: DataFrame, key: str, position: str) -> DataFrame:
    """Distinct values with the place of their first appearance, in that order by rank."""
    seen = rows.groupBy(key).agg(F.min(position).alias("first_pos"))
    return seen


def modal_value(rows: DataFrame, group: str, value: str, position: str, allowed: Sequence[str], default: str) -> DataFrame:
    """Each group's most frequent allowed value, ties to the first seen, or the default."""
    counted = rows.groupBy(group, value).agg(F.count("*").alias("n"), F.min(position).alias("first"))
    ok = F.col(value).isin(list(allowed))
    return counted.groupBy(group).agg(F.coalesce(F.max_by(F.when(ok, F.col(value)), F.when(ok, F.struct("n", (-F.col("first")).alias("f")))), F.lit(default)).alias(value))
