"""Signal, composite, status ladder, ownership gate, and the calibration of weights."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewire.sources.views import DIMENSIONS

# Weight seeds, tier scores and gate classes.
SEEDS = {"scope": 0.16, "severity": 0.16, "novelty": 0.12, "actor_influence": 0.14, "decision_relevance": 0.18, "feelgood": 0.0, "signal": 0.24}
TIER_SCORES = {"mainstream": 0.8, "portal": 0.5, "specialist": 0.65, "unknown": 0.45}
GATE_REVIEW = ("private_constrained", "independent_private_low_evidence", "state_influenced_review")
GATE_SUPPRESS = ("state_controlled_block",)
GATE_MULTIPLIERS = {"private_constrained": 0.85, "independent_private_low_evidence": 0.7, "state_influenced_review": 0.9}
MAX_STEP = 0.02
SUPPRESS_FLOOR, REVIEW_FLOOR, SEVERITY_REVIEW, MIN_GATE_CLUSTER = 0.18, 0.34, 6.0, 3


def clamp(value: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), value))


def lookup(values: dict[str, float], key: Column, default: float) -> Column:
    """A small constant map applied to a column."""
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for item in values.items() for x in item]), key), F.lit(default))


def signal(members: DataFrame) -> DataFrame:
    """Per cluster of (cluster_id, source_name, region, tier, searched, official): signal and flags.

    A source that only searched articles bring is none of its own: one organic source at most is flagged. official:
    the article is an official source's, or not of kind news. Members are shuffled once, by cluster; names are told apart there.
    """
    tier = lookup(TIER_SCORES, F.coalesce("tier", F.lit("unknown")), TIER_SCORES["unknown"])
    kinds = lambda c: F.size(F.collect_set(c)).cast("bigint")
    g = members.groupBy("cluster_id").agg(
        F.count("*").alias("articles"), kinds("source_name").alias("sources"), kinds(F.when(~F.col("searched"), F.col("source_name"))).alias("organic"),
        kinds("region").alias("regions"), F.avg(tier).alias("mean_tier"), F.count_if("official").alias("officials"))
    score = 0.45 * F.least("sources", F.lit(4)) / 4 + 0.30 * F.least("regions", F.lit(3)) / 3 + 0.25 * F.col("mean_tier")
    flags = F.array_compact(F.array(
        F.when(F.col("organic") <= 1, "single_source"), F.when((F.col("regions") <= 1) & (F.col("articles") >= 2), "single_region"),
        F.when(F.col("officials") == F.col("articles"), "official_only").when(F.col("officials") > 0, "official_source_present")))
    return g.select("cluster_id", "articles", "sources", "regions", clamp(score).alias("signal"), flags.alias("flags"))


def weights(spark, calibrated: dict[str, float] | None = None) -> dict[str, float]:
    """Calibrated over seed, normalised to a sum of 1."""
    live = {k: (calibrated or {}).get(k, v) for k, v in SEEDS.items()}
    total = sum(live.values()) or 1.0
    return {k: v / total for k, v in live.items()}


def composite(dims: dict[str, Column], signal_col: Column, w: dict[str, float]) -> Column:
    """Weighted signal plus tenths of the weighted dimensions, in 0 to 1. Weights come before the tenths: a value at a bar of status() depends on it."""
    total = F.lit(w["signal"]) * signal_col
    for d in DIMENSIONS:
        total = total + F.lit(w[d]) * F.coalesce(dims[d], F.lit(0.0)) / 10
    return clamp(total)


def status(composite_col: Column, severity: Column, flags: Column, evaluated: Column) -> Column:
    """Suppress, seek_more_evidence, needs_review or publishable."""
    has = lambda f: F.array_contains(flags, f)
    return (
        F.when(evaluated & (composite_col < SUPPRESS_FLOOR), "suppress")
        .when(has("single_source") & (severity >= SEVERITY_REVIEW), "seek_more_evidence")
        .when(has("official_only"), "needs_review")
        .when(evaluated & (composite_col < REVIEW_FLOOR), "needs_review")
        .otherwise("publishable")
    )


def ownership_gate(members: DataFrame, assessments: DataFrame) -> DataFrame:
    """The gate on stories about another country's home affairs.

    members: cluster_id, source_name, region, ownership. assessments: cluster_id, target, home_affairs, composite, status.
    The penalty looks at all members of a review class, own country included, where any foreign one asked for review.
    """
    met = members.join(assessments.select("cluster_id", "target", "home_affairs"), "cluster_id")
    active = F.col("home_affairs") & F.col("target").isNotNull()
    owner = F.coalesce("ownership", F.lit("state_influenced_review"))
    foreign = active & F.col("region").isNotNull() & (F.col("region") != F.col("target"))
    multiplier = F.when(F.col("ownership").isin(*GATE_REVIEW), lookup(GATE_MULTIPLIERS, F.col("ownership"), 1.0))
    g = met.groupBy("cluster_id").agg(
        F.count("*").alias("n"), F.count_if(foreign & owner.isin(*GATE_SUPPRESS)).alias("blocked"), F.count_if(foreign & owner.isin(*GATE_REVIEW)).alias("review"), F.min(multiplier).alias("worst"))
    a = assessments.join(g, "cluster_id", "left")
    all_blocked = (F.col("blocked") == F.col("n")) & (F.col("n") > 0)
    keep = (F.col("n") < MIN_GATE_CLUSTER) | (F.col("composite") >= REVIEW_FLOOR)
    gated = F.when(all_blocked & ~keep, "suppress").when(all_blocked, "needs_review").when((F.col("review") > 0) & (F.col("status") == "publishable"), "needs_review").otherwise(F.col("status"))
    penalised = F.when((F.col("review") > 0) & F.col("worst").isNotNull(), F.col("composite") * F.col("worst")).otherwise(F.col("composite"))
    return a.select("cluster_id", F.coalesce("blocked", F.lit(0)).cast("bigint").alias("blocked"), F.coalesce("review", F.lit(0)).cast("bigint").alias("review"), gated.alias("status"), penalised.alias("composite"))


def gate_badge(target: Column, blocked: Column, review: Column) -> Column:
    """None, block, review or allow."""
    return F.when(target.isNull() | (target == ""), "none").when(blocked > 0, "block").when(review > 0, "review").otherwise("allow")


def normalised_regions(regions: Column, limit: int = 3) -> Column:
    """Lower-case trimmed codes, blanks and repeats dropped, the first three."""
    return F.slice(F.array_distinct(F.filter(F.transform(regions, lambda r: F.lower(F.trim(r))), lambda r: r != "")), 1, limit)


def nudges(training: DataFrame, max_step: float = MAX_STEP) -> DataFrame:
    """Per dimension: mean over accepted less mean over rejected, in tenths and at most one, times the largest step; null if a side is empty or both are equal."""
    long = training.select("verdict", F.explode(F.create_map(*[x for d in DIMENSIONS for x in (F.lit(d), F.col(d))])).alias("dimension", "value"))
    g = long.groupBy("dimension").agg(F.avg(F.when(F.col("verdict") > 0, F.col("value"))).alias("up"), F.avg(F.when(F.col("verdict") < 0, F.col("value"))).alias("down"), F.count("*").alias("rows"))
    difference = F.col("up") - F.col("down")
    return g.select("dimension", "rows", F.when(difference != 0, clamp(difference / 10, -1.0, 1.0) * max_step).alias("nudge"))


def calibrate(current: DataFrame, nudged: DataFrame, min_rows: int = 10) -> DataFrame:
    """New weights of (dimension, weight, seed), within 0.3 to 3 times the seed; zero seeds and thin evidence stay."""
    met = current.join(nudged, "dimension", "left")
    moved = F.greatest(0.3 * F.col("seed"), F.least(3 * F.col("seed"), F.col("weight") + F.col("nudge")))
    move = (F.col("seed") > 0) & F.col("nudge").isNotNull() & (F.col("rows") >= min_rows)
    return met.select("dimension", "weight", F.round(F.when(move, moved).otherwise(F.col("weight")), 6).alias("new_weight"))


def with_rank(rows: DataFrame) -> DataFrame:
    """Rank by composite per date, ties to the smaller id."""
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("report_date").orderBy(F.desc("composite"), "evaluation_id")))


def live_weights(seeds: DataFrame, calibrated: DataFrame) -> DataFrame:
    """(dimension, weight): calibrated over seed, normalised to a sum of 1 (one row per dimension)."""
    met = seeds.join(calibrated, "dimension", "left").select("dimension", F.coalesce("weight", "seed").alias("weight"))
    total = F.sum("weight").over(Window.partitionBy())
    return met.withColumn("weight", F.col("weight") / F.when(total == 0, F.lit(1.0)).otherwise(total))


def assessed(signals: DataFrame, items: DataFrame, weights_of: dict[str, float]) -> DataFrame:
    """(id, signal, flags) with the item's dimensions (0 without one): composite, status, and whether an item was there; without it the signal decides alone.

    Calling it again after members changed derives all from the fresh signal, so no penalty adds up.
    """
    met = signals.join(items.withColumn("evaluated", F.lit(True)), "id", "left").withColumn("evaluated", F.coalesce("evaluated", F.lit(False)))
    dims = {d: clamp(F.coalesce(F.col(d), F.lit(0.0)), 0.0, 10.0) for d in DIMENSIONS}
    value = F.when(F.col("evaluated"), composite(dims, F.col("signal"), weights_of)).otherwise(F.col("signal"))
    return met.withColumn("composite", value).withColumn("status", status(F.col("composite"), dims["severity"], F.col("flags"), F.col("evaluated")))
