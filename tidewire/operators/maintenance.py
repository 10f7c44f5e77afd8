"""Table maintenance as DataFrame transformations: inserts, merges, cascades, retention, lookups."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def insert_new(existing: DataFrame, incoming: DataFrame, key: str, order: list) -> DataFrame:
    """Existing rows and the incoming ones of unseen keys, the first of each."""
    fresh = incoming.join(existing.select(key).distinct(), key, "left_anti")
    first = fresh.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where("_r = 1").drop("_r")
    return existing.unionByName(first.select(*existing.columns))


def upsert(existing: DataFrame, incoming: DataFrame, keys: list[str], keep: list[str], reset: dict | None = None) -> DataFrame:
    """Incoming rows replace existing ones of equal keys; `keep` columns stay those of the existing row, `reset` ones become constants."""
    old = existing.select(*keys, *[F.col(c).alias(f"_old_{c}") for c in keep], F.lit(True).alias("_met"))
    merged = incoming.join(old, keys, "left")
    for c in keep:
        merged = merged.withColumn(c, F.coalesce(f"_old_{c}", c))
    for c, value in (reset or {}).items():
        merged = merged.withColumn(c, F.when(F.col("_met"), F.lit(value)).otherwise(F.col(c)))
    return merged.select(*existing.columns).unionByName(existing.join(incoming.select(*keys).distinct(), keys, "left_anti").select(*existing.columns))


def mark(rows: DataFrame, ids: DataFrame, key: str, flag: str, value: bool = True) -> DataFrame:
    """Set a flag for the given ids."""
    return rows.join(ids.select(key).distinct().withColumn("_hit", F.lit(True)), key, "left").withColumn(flag, F.when(F.col("_hit"), F.lit(value)).otherwise(F.col(flag))).drop("_hit")


def cascade_delete(parents: DataFrame, children: dict[str, DataFrame], dead: DataFrame, key: str) -> tuple[DataFrame, dict[str, DataFrame]]:
    """Parents and children without those of the dead keys."""
    gone = dead.select(key).distinct()
    return parents.join(gone, key, "left_anti"), {name: child.join(gone, key, "left_anti") for name, child in children.items()}


def replace_children(existing: DataFrame, incoming: DataFrame, key: str) -> DataFrame:
    """All children of the incoming parents replaced."""
    return existing.join(incoming.select(key).distinct(), key, "left_anti").unionByName(incoming.select(*existing.columns))


def retain(rows: DataFrame, time: str, now, days: int, protect=None) -> DataFrame:
    """Rows not older than `days` before now, and protected ones."""
    young = F.col(time) >= F.lit(now) - F.make_dt_interval(F.lit(days))
    return rows.where(young if protect is None else young | protect)


def append_version(existing: DataFrame, content: DataFrame, column: str = "content") -> DataFrame:
    """Content as the next version."""
    top = existing.agg(F.coalesce(F.max("version"), F.lit(0)).alias("_v"))
    return existing.unionByName(content.crossJoin(F.broadcast(top)).select((F.col("_v") + 1).alias("version"), column))


def latest_version(rows: DataFrame) -> DataFrame:
    """The row of the highest version, then id."""
    return rows.orderBy(F.desc("version"), F.desc("id")).limit(1)


def ranked_feed(rows: DataFrame, time: str, tie: str, n: int = 20) -> DataFrame:
    """The newest n."""
    return rows.orderBy(F.desc(time), tie).limit(n)


def archive_months(rows: DataFrame, date: str, keep: int = 7) -> DataFrame:
    """Per month: number of dates, the dates (newest first), and those among the `keep` newest of all."""
    days = rows.select(F.col(date).alias("d")).distinct()
    newest = days.orderBy(F.desc("d")).limit(keep).withColumn("new", F.lit(True))
    marked = days.join(F.broadcast(newest), "d", "left").groupBy(F.date_format("d", "yyyy-MM").alias("month"))
    return marked.agg(F.count("*").alias("days"), F.sort_array(F.collect_list("d"), False).alias("dates"), F.sort_array(F.collect_list(F.when(F.col("new"), F.col("d"))), False).alias("recent"))


def sitemap(rows: DataFrame, date: str, root: str) -> DataFrame:
    """(loc, lastmod) of the root page and of each date's page."""
    days = rows.select(F.col(date).cast("string").alias("lastmod")).distinct()
    pages = days.select(F.concat(F.lit(root), "lastmod", F.lit("/")).alias("loc"), "lastmod")
    return pages.unionByName(days.agg(F.lit(root).alias("loc"), F.max("lastmod").alias("lastmod")))


def pack(rows: DataFrame, group: str, order: str, text: str, limit: int) -> DataFrame:
    """Greedy packing of each group's ordered pieces into messages of at most `limit` characters (a longer piece alone, after empty ones at most).

    A fold over the ordered lengths; groups are digests of bounded length.
    """
    ordered = rows.groupBy(group).agg(F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), F.length(text).alias("n")))).alias("pieces"))
    start = "named_struct('size', 0, 'number', 0, 'out', cast(array() as array<int>))"
    step = f"""(acc, p) -> if(acc.number > 0 AND (acc.size = 0 OR acc.size + p.n <= {limit}),
        named_struct('size', acc.size + p.n, 'number', acc.number, 'out', concat(acc.out, array(acc.number))),
        named_struct('size', p.n, 'number', acc.number + 1, 'out', concat(acc.out, array(acc.number + 1))))"""
    folded = ordered.withColumn("message", F.expr(f"aggregate(pieces, {start}, {step}, acc -> acc.out)"))
    zipped = folded.select(group, F.explode(F.arrays_zip("pieces", "message")).alias("z"))
    return zipped.select(group, F.col("z.pieces.o").alias(order), F.col("z.message").cast("bigint").alias("message"))


def recent_clusters(rows: DataFrame, anchor: str, days: int) -> DataFrame:
    """Rows dated in [anchor - days, anchor); none if days <= 0."""
    if days <= 0:
        return rows.where(F.lit(False))
    end = F.to_date(F.lit(anchor))
    return rows.where((F.col("report_date") >= F.date_sub(end, days)) & (F.col("report_date") < end))


def report_article_ids(clusters: DataFrame, date: str) -> DataFrame:
    """Distinct member ids of a date's clusters."""
    return clusters.where(F.col("report_date") == F.to_date(F.lit(date))).select(F.explode("article_ids").alias("article_id")).distinct()
