"""JSON payloads of list APIs, usage records and tolerant batch answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewire.functions.text import epoch

ITEMS = "items array<struct<id:string,title:string,url:string,at:bigint,body:string,hover:string>>"


def hot_list(rows: DataFrame, payload: str, batch_time: Column, limit: int = 25, least: int = 10) -> DataFrame:
    """Up to `limit` items of each payload: seconds or milliseconds, batch time where unknown; body, else hover, else title; short ones go."""
    items = rows.select("*", F.posexplode(F.slice(F.from_json(payload, ITEMS)["items"], 1, limit)).alias("pos", "item"))
    text = F.coalesce(F.nullif(F.col("item.body"), F.lit("")), F.nullif(F.col("item.hover"), F.lit("")), F.col("item.title"))
    out = items.select(*rows.columns, "pos", F.col("item.title").alias("title"), F.col("item.url").alias("url"), F.coalesce(epoch(F.col("item.at")), batch_time).alias("published_at"), text.alias("content"))
    return out.where(F.length("content") >= least).drop(payload)


def usage_tokens(payload: Column) -> Column:
    """Total tokens in any of the three shapes that providers use; null is not 0."""
    get = lambda p: F.get_json_object(payload, p).try_cast("bigint")
    return F.coalesce(get("$.usage.total_tokens"), get("$.total_tokens"), get("$.usage.prompt_tokens") + get("$.usage.completion_tokens"))


def tolerant(answer: Column, schema: str) -> Column:
    """The JSON itself, else what stands between the outermost braces."""
    braces = F.regexp_extract(answer, "(?s)(\\{.*\\})", 1)
    whole = F.from_json(F.when(F.trim(answer).startswith("{"), answer), schema)
    return F.coalesce(whole, F.from_json(F.nullif(braces, F.lit("")), schema))
