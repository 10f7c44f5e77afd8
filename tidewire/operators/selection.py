"""Top-k, capped and lane-wise selection without driver loops."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def top_window(rows: DataFrame, score: str, tie: str, n: int) -> DataFrame:
    """The n best by score; a TakeOrdered, not a sort."""
    return rows.orderBy(F.desc(score), tie).limit(n)


def per_group(rows: DataFrame, group: list[str], order: list, n: int) -> DataFrame:
    """The first n of each group; pruned before the shuffle (window group limit)."""
    return rows.withColumn("_r", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where(F.col("_r") <= n).drop("_r")


def diverse(rows: DataFrame, category: str, score: str, tie: str, limit: int, cap: int) -> DataFrame:
    """Best first with at most `cap` per category, then the overflow in order. Rows without a category aren't capped."""
    inside = F.row_number().over(Window.partitionBy(category).orderBy(F.desc(score), tie))
    over = rows.withColumn("_over", (F.col(category).isNotNull() & (F.col(category) != "") & (inside > cap)).cast("int"))
    #: No category has more than `limit` rows in the result: prune before the global order.
    pruned = over.withColumn("_in", inside).where(F.col("_in") <= limit)
    return pruned.orderBy("_over", F.desc(score), tie).limit(limit).drop("_over", "_in")


def hot_families(rows: DataFrame, family: str, score: str, tabs: int = 3, least: int = 2) -> DataFrame:
    """Families of at least `least` members, largest first, then by best score; the first `tabs`."""
    sized = rows.where(F.col(family).isNotNull()).groupBy(family).agg(F.count("*").alias("members"), F.max(score).alias("best"))
    return sized.where(F.col("members") >= least).orderBy(F.desc("members"), F.desc("best"), family).limit(tabs)


def report_lanes(rows: DataFrame, family: str, category: str, score: str, tie: str, limit: int = 20, cap: int = 8, tabs: int = 3, extras: int = 5, min_feelgood: float = 6.0) -> DataFrame:
    """Hot family members, the diverse main lane, and feelgood extras: rows with `lane`, each once."""
    hot_keys = hot_families(rows, family, score, tabs).select(family)
    hot = rows.join(F.broadcast(hot_keys), family, "left_semi")
    pool = rows.join(F.broadcast(hot_keys), family, "left_anti")
    main = diverse(pool, category, score, tie, limit, cap)
    rest = pool.join(F.broadcast(main.select(tie)), tie, "left_anti").where((F.col("feelgood") >= min_feelgood) & (F.col("status") != "suppress"))
    more = rest.orderBy(F.desc(score), tie).limit(extras)
    return hot.withColumn("lane", F.lit("hot")).unionByName(main.withColumn("lane", F.lit("main"))).unionByName(more.withColumn("lane", F.lit("extra")))


def positive_lane(rows: DataFrame, domain: str, score: str, tie: str, items: int = 5, min_feelgood: float = 6.0, max_severity: float = 4.0) -> DataFrame:
    """Best feelgood first, one per domain (blank domains unlimited), at most `items`."""
    fit = rows.where((F.col("feelgood") >= min_feelgood) & (F.col("severity") <= max_severity) & (F.col("status") != "suppress"))
    order = [F.desc("feelgood"), F.desc(score), tie]
    place = F.row_number().over(Window.partitionBy(domain).orderBy(*order))
    return fit.withColumn("_p", place).where((F.col("_p") == 1) | (F.coalesce(F.col(domain), F.lit("")) == "")).orderBy(*order).limit(items).drop("_p")


def chunks(rows: DataFrame, group: list[str], order: list, size: int) -> DataFrame:
    """Equal chunks of at most `size` in order: chunk number per row."""
    w = Window.partitionBy(*group)
    n = F.count("*").over(w)
    number = F.ceil(n / size)
    each = F.ceil(n / number)
    return rows.withColumn("chunk", F.floor((F.row_number().over(w.orderBy(*order)) - 1) / each).cast("bigint"))


def shared_labels(rows: DataFrame, key: str, label: str) -> DataFrame:
    """The label of keys that at least two rows share, unless it is a single's key; otherwise null."""
    n = F.count("*").over(Window.partitionBy(key))
    return rows.withColumn("shared_label", F.when((n >= 2) & ~F.col(key).startswith("single-"), F.col(label)))


def timeline(events: DataFrame, key: str, order: list, last: int = 5) -> DataFrame:
    """Each key's last events."""
    w = Window.partitionBy(key).orderBy(*order)
    return events.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= last).drop("_r")


def batches(rows: DataFrame, group: list[str], order: list, size: int) -> DataFrame:
    """Batch number (from 0) of full batches of `size` in order."""
    return rows.withColumn("batch", F.floor((F.row_number().over(Window.partitionBy(*group).orderBy(*order)) - 1) / size).cast("bigint"))


def summary_families(rows: DataFrame, family: str, position: str, freshness: str, tabs: int = 3, least: int = 2) -> DataFrame:
    """Families of summaries, stale ones left out: largest first, then by first appearance."""
    sized = rows.where((F.col(freshness) != "stale") & F.col(family).isNotNull()).groupBy(family).agg(F.count("*").alias("members"), F.min(position).alias("_first"))
    return sized.where(F.col("members") >= least).orderBy(F.desc("members"), "_first").limit(tabs).drop("_first")


def stripped(families: DataFrame, elsewhere: DataFrame, family: str, key: str, least: int = 2) -> DataFrame:
    """Family members without those that another lane took; families left with fewer than `least` go."""
    left = families.join(elsewhere.select(key).distinct(), key, "left_anti")
    return left.join(left.groupBy(family).count().where(F.col("count") >= least).select(family), family, "left_semi")
