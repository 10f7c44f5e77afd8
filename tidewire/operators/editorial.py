"""Publication contract, acceptance of search candidates, voice coverage and report assembly."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Rejection reasons, most telling first, and coverage kinds, strongest first.
REASONS = (
    "publisher_binding_unverified", "candidate_pending_review", "not_related_country_source", "publisher_target_mismatch", "not_official_source", "event_mismatch",
    "background_context", "entity_mismatch", "invalid_result_url", "stale_result", "duplicate_of_existing", "thin_result",
)
COVERAGE = ("official_direct", "direct_quote", "country_editorial", "secondary_only", "missing")


def rank_in(values: Sequence[str], key: Column) -> Column:
    """Place of a value in a list (from 0); the list's length for others."""
    place = F.array_position(F.array(*[F.lit(v) for v in values]), key)
    return F.when(F.coalesce(place, F.lit(0)) == 0, F.lit(len(values))).otherwise(place - 1).cast("int")


def rejection_reason(mentions: Column, fresh: Column, background: Column, title_ratio: Column, cosine: Column) -> Column:
    """first reason that applies; null accepts."""
    return F.when(~mentions, "entity_mismatch").when(~fresh, "stale_result").when(background, "background_context").when(title_ratio >= 82, "duplicate_of_existing").when(cosine < 0.58, "event_mismatch")


def primary_reason(rows: DataFrame, group: str, reason: str) -> DataFrame:
    """each group's most telling reason; of unknown ones the first by name."""
    return rows.groupBy(group).agg(F.min(F.struct(rank_in(REASONS, F.col(reason)).alias("rank"), F.col(reason).alias("reason"))).alias("r")).select(group, F.col("r.reason").alias(reason))


def is_fresh(published: Column, now: Column, hours: int = 72, undated: bool = True) -> Column:
    """not older than `hours`; undated rows by policy."""
    return F.when(published.isNull(), F.lit(undated)).otherwise(F.unix_timestamp(now) - F.unix_timestamp(published) <= hours * 3600)


def should_enrich(status: Column, composite: Column) -> Column:
    """F13."""
    return (status == "seek_more_evidence") | (composite >= 0.55)


def is_hot_member(role: Column, membership: Column) -> Column:
    """core or spillover, unless excluded to the main lane."""
    return F.coalesce(role.isin("core", "spillover"), F.lit(False)) & ~F.coalesce(membership == "excluded_to_main", F.lit(False))


def voice_coverage(rows: DataFrame, group: list[str], kind: str) -> DataFrame:
    """The strongest coverage per cluster and target."""
    return rows.groupBy(*group).agg(F.element_at(F.array(*[F.lit(c) for c in COVERAGE]), F.min(rank_in(COVERAGE[:-1], F.col(kind))) + 1).alias("coverage"))


def voice_targets(rows: DataFrame, limit: int = 3) -> DataFrame:
    """Of (cluster_id, label, region, priority, pos): targets of the best priority there is, repeats dropped, at most `limit`."""
    label = F.lower(F.trim("label"))
    first = rows.withColumn("_k", label).withColumn("_r", F.row_number().over(Window.partitionBy("cluster_id", "_k", "region").orderBy("priority", "pos"))).where("_r = 1")
    best = first.withColumn("_best", F.min("priority").over(Window.partitionBy("cluster_id"))).where(F.col("priority") == F.col("_best"))
    place = F.row_number().over(Window.partitionBy("cluster_id").orderBy("pos"))
    return best.withColumn("place", place).where(F.col("place") <= limit).select("cluster_id", "label", "region", "place")


def host_suffixes(host: Column) -> Column:
    """a.b.c -> [a.b.c, b.c, c]: turns a domain-suffix join into an equi-join."""
    parts = F.split(host, "\\.")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))


def suffix_join(rows: DataFrame, host: str, registry: DataFrame, domain: str) -> DataFrame:
    """Rows with the registry's entry of their longest matching domain suffix."""
    spread = rows.withColumn("_d", F.explode(host_suffixes(F.col(host))))
    met = spread.join(registry, F.col("_d") == F.col(domain))
    return met.withColumn("_r", F.row_number().over(Window.partitionBy(host).orderBy(F.desc(F.length("_d"))))).where("_r = 1").drop("_r", "_d")


def accepted_first(rows: DataFrame, group: str, reason: str, order: list, limit: int) -> DataFrame:
    """Decisions: the first `limit` candidates without a reason are accepted, later ones surplus, others rejected."""
    ok = F.col(reason).isNull()
    place = F.sum(ok.cast("int")).over(Window.partitionBy(group).orderBy(*order))
    return rows.withColumn("decision", F.when(~ok, "rejected").when(place <= limit, "accepted").otherwise("surplus"))


def placeholders(targets: DataFrame, satisfied: DataFrame, keys: list[str]) -> DataFrame:
    """A placeholder row for each target that nothing satisfies."""
    return targets.join(satisfied.select(*keys).distinct(), keys, "left_anti").withColumn("url", F.concat(F.lit("placeholder:"), F.concat_ws("-", *keys)))


def consume_urls(claims: DataFrame, urls: DataFrame, group: list[str]) -> DataFrame:
    """The k-th mention of a source takes its k-th URL; a single URL serves all; beyond that it is ambiguous and has none."""
    k = Window.partitionBy(*group)
    left = claims.withColumn("k", F.row_number().over(k.orderBy("pos")))
    right = urls.withColumn("k", F.row_number().over(k.orderBy("upos"))).withColumn("n", F.count("*").over(k))
    single = right.where("n = 1").select(*group, F.col("url").alias("only"))
    met = left.join(right.select(*group, "k", "url"), [*group, "k"], "left").join(single, group, "left")
    return met.select(*group, "pos", F.coalesce("only", "url").alias("url"), (F.col("only").isNull() & F.col("url").isNull()).alias("ambiguous"))


def ordered_union(parts: list[DataFrame], group: str, value: str, position: str) -> DataFrame:
    """Values of several lists in order of priority, each once, with their place."""
    both = None
    for k, part in enumerate(parts):
        part = part.select(group, value, F.struct(F.lit(k).alias("part"), F.col(position).alias("pos")).alias("at"))
        both = part if both is None else both.union(part)
    first = both.groupBy(group, value).agg(F.min("at").alias("at"))
    return first.withColumn("place", F.row_number().over(Window.partitionBy(group).orderBy("at", value))).drop("at")


def day_links(days: DataFrame, day: str) -> DataFrame:
    """Previous and next report date of each date."""
    w = Window.orderBy(day)
    return days.select(day).distinct().select(day, F.lag(day).over(w).alias("previous"), F.lead(day).over(w).alias("next"))


def numbered_digest(rows: DataFrame, group: str, category: str, order: list) -> DataFrame:
    """Running numbers, and a header mark where the category changes."""
    w = Window.partitionBy(group).orderBy(*order)
    return rows.withColumn("number", F.row_number().over(w)).withColumn("header", ~F.lag(category).over(w).eqNullSafe(F.col(category)))


def fill_sources(perspectives: DataFrame, sources: DataFrame, group: str, fallback: str) -> DataFrame:
    """Each source exactly once: its first perspective, or the fallback text."""
    first = perspectives.groupBy(group, "source_name").agg(F.min_by("text", "pos").alias("text"))
    return sources.select(group, "source_name").distinct().join(first, [group, "source_name"], "left").select(group, "source_name", F.coalesce("text", F.lit(fallback)).alias("text"))


def claimed_once(entries: DataFrame) -> DataFrame:
    """Of (entry, article_id): each article belongs to the first entry that claims it."""
    return entries.groupBy("article_id").agg(F.min("entry").alias("entry"))


def health(rows: DataFrame) -> DataFrame:
    """Per source: best state of its attempts, items and time."""
    state = F.element_at(F.array(F.lit("error"), F.lit("empty"), F.lit("ok")), F.max(F.when(F.col("ok") & (F.col("items") > 0), 3).when(F.col("ok"), 2).otherwise(1)))
    return rows.groupBy("source_name").agg(state.alias("state"), F.sum("items").alias("items"), F.round(F.sum("ms"), 2).alias("ms"))
