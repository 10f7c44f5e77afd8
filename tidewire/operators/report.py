"""A report's whole payload: its summaries with articles, counts, views and storylines, in their lanes and families."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewire.functions.display import broad_category
from tidewire.functions.text import headline
from tidewire.operators.assembly import count_columns, perspective_payload, source_label

ARTICLE = "struct<title:string,url:string,source:string,published_at:string,search_acceptance_status:string,search_acceptance_reason:string,result_freshness_state:string,is_placeholder:boolean,is_real_article:boolean>"
CARD = (
    f"struct<index:int,cluster_id:bigint,topic:string,broad_category:string,headline:string,summary:string,headline_en:string,summary_en:string,sources:array<string>,is_multi:boolean,articles:array<{ARTICLE}>,"
    "footer_sources:array<struct<label:string,url:string>>,article_count:bigint,real_article_count:bigint,placeholder_count:bigint,total_article_count:bigint,real_source_count:bigint,placeholder_source_count:bigint,"
    "organic_unique_sources:bigint,organic_unique_regions:bigint,distinct_perspective_count:bigint,suppressed_group_count:bigint,has_expandable_perspectives:boolean,perspective_preview:string,freshness_state:string,"
    "is_developing:boolean,storyline_key:string,storyline_name:string,storyline_role:string,quality_score:double,quality_status:string,quality_flags:array<string>,duplicate_action:string,impact_composite:double>"
)
PAYLOAD = f"date string, part int, parts int, total_cluster_count bigint, main_count bigint, positive_count bigint, clusters array<{CARD}>, positive_stories array<{CARD}>, hot_topics array<struct<storyline_key:string,storyline_name:string,member_count:bigint,summaries:array<{CARD}>>>"


#: Cards of one document of a report at most.
MOST_CARDS = 4096


def body_only(text: Column) -> Column:
    """A summary without its first bold headline, its views' lines, and blank lines at either end."""
    lines = F.split(F.regexp_replace(F.coalesce(text, F.lit("")), "\r\n?", "\n"), "\n")
    bold = lambda x: F.trim(x).rlike("^\\*\\*(.+?)\\*\\*")
    first = F.array_position(F.transform(lines, bold), F.lit(True))
    kept = F.filter(F.transform(lines, lambda x, i: F.struct(x.alias("x"), i.alias("i"))), lambda y: (y["i"] + 1 != first) & ~F.trim(y["x"]).rlike("^[•·\\-*]\\s*【.+?】"))
    return F.regexp_replace(F.array_join(F.transform(kept, lambda y: y["x"]), "\n"), "^(?:[ \\t]*\n)+|(?:\n[ \\t]*)+$", "")


def sums(articles: DataFrame, groups: DataFrame) -> DataFrame:
    """What a card says about its cluster in numbers, with its preview: of articles (a search view's columns) and groups (the views of perspective_payload())."""
    return articles.groupBy("cluster_id").agg(*count_columns()).join(perspective_payload(groups, articles), "cluster_id", "left")


def cards(rows: DataFrame, english: bool = True) -> DataFrame:
    """Rows with their card (see CARD), made where a row lies: nothing is shuffled.

    rows, one for each summary: cluster_id, index, topic, display_category, summary, summary_en, freshness_state, storyline_key,
    storyline_name, storyline_role, quality_score, quality_status, quality_flags, duplicate_action, composite; members, an array
    of a search view's columns and published_at; and the columns of sums(). Members and sums are null where a cluster has none.
    """

    def member(m: Column) -> Column:
        real = ~m["is_placeholder"]
        article = F.struct(
            m["title"].alias("title"), F.when(real, m["url"]).alias("url"), m["source_name"].alias("source"), F.coalesce(F.date_format(m["published_at"], "HH:mm"), F.lit("")).alias("published_at"),
            F.coalesce(m["status"], F.when(m["is_searched"], "accepted")).alias("search_acceptance_status"), F.coalesce(m["reason"], F.lit("")).alias("search_acceptance_reason"),
            m["freshness"].alias("result_freshness_state"), m["is_placeholder"].alias("is_placeholder"), real.alias("is_real_article"),
        )
        return F.struct(m["pos"].alias("pos"), article.alias("a"), source_label(at=lambda c: m[c]).alias("label"))

    met = rows.withColumn("_m", F.array_sort(F.transform("members", member)))
    entry = lambda m: F.struct(m["label"].alias("label"), m["a"]["url"].alias("url"))
    met = met.withColumns({"articles": F.transform("_m", lambda m: m["a"]), "footer_sources": F.transform("_m", entry)})
    none = lambda kind: F.array().cast(f"array<{kind}>")
    met = met.withColumn("articles", F.coalesce("articles", none(ARTICLE))).withColumn("footer_sources", F.coalesce("footer_sources", none("struct<label:string,url:string>")))
    count = lambda c: F.coalesce(c, F.lit(0)).cast("bigint")
    real = F.filter("articles", lambda a: a["is_real_article"])
    said = lambda c: F.nullif(headline(F.col(c)), F.lit(""))
    in_english = lambda c: F.when(F.coalesce(F.col("summary_en"), F.lit("")) != "", c) if english else F.lit(None).cast("string")
    card = F.struct(
        "index", "cluster_id", "topic", broad_category(F.col("topic"), F.col("display_category")).alias("broad_category"), F.coalesce(said("summary"), "topic").alias("headline"), body_only(F.col("summary")).alias("summary"),
        in_english(said("summary_en")).alias("headline_en"), in_english(body_only(F.col("summary_en"))).alias("summary_en"), F.array_distinct(F.transform(real, lambda a: a["source"])).alias("sources"), (count(F.col("real_sources")) >= 2).alias("is_multi"),
        "articles", "footer_sources", count(F.col("real_articles")).alias("article_count"), count(F.col("real_articles")).alias("real_article_count"), count(F.col("placeholders")).alias("placeholder_count"), (count(F.col("real_articles")) + count(F.col("placeholders"))).alias("total_article_count"),
        count(F.col("real_sources")).alias("real_source_count"), count(F.col("placeholder_sources")).alias("placeholder_source_count"), count(F.col("organic_sources")).alias("organic_unique_sources"), count(F.col("organic_regions")).alias("organic_unique_regions"),
        count(F.col("distinct_perspectives")).alias("distinct_perspective_count"), count(F.col("suppressed")).alias("suppressed_group_count"), F.coalesce("expandable", F.lit(False)).alias("has_expandable_perspectives"), F.coalesce("preview", F.lit("")).alias("perspective_preview"),
        F.coalesce("freshness_state", F.lit("new")).alias("freshness_state"), (F.coalesce("freshness_state", F.lit("new")) == "developing").alias("is_developing"), "storyline_key", "storyline_name", F.coalesce("storyline_role", F.lit("none")).alias("storyline_role"),
        F.round(F.coalesce("quality_score", F.lit(0.0)), 3).alias("quality_score"), F.coalesce("quality_status", F.lit("unknown")).alias("quality_status"), F.coalesce("quality_flags", F.array().cast("array<string>")).alias("quality_flags"), F.coalesce("duplicate_action", F.lit("kept")).alias("duplicate_action"), F.round("composite", 3).alias("impact_composite"),
    )
    return met.select(*rows.columns, card.cast(CARD).alias("card"))


def placed(rows: DataFrame, most: int = MOST_CARDS) -> DataFrame:
    """Rows (date, cluster_id, lane ('main', 'positive' or 'hot'), place, family and family_name (of the hot lane), and others) of reports in order.

    They get their index in the report (in the order of lanes and places: families first), its part of at most `most` cards,
    and the numbers of parts, of cards in all, in both lanes and in their family. Rows travel to their day once, as they are, or lie by it.
    """
    order = [F.when(F.col("lane") == "hot", 0).when(F.col("lane") == "main", 1).otherwise(2), F.coalesce("family", F.lit("")), F.col("place"), F.col("cluster_id")]
    rows = rows.withColumns({"_lane": order[0], "_family": order[1]})
    order = ["_lane", "_family", "place", "cluster_id"]
    day, family = Window.partitionBy("date"), Window.partitionBy("date", "_lane", "_family")
    rows = rows.withColumn("index", F.row_number().over(day.orderBy(*order))).withColumns({"members_of_family": F.count("*").over(family), "family_name": F.min_by("family_name", F.struct("place", "cluster_id")).over(family)})
    rows = rows.withColumns({"total": F.count("*").over(day), "main_count": F.count_if(F.col("_lane") == 1).over(day), "positive_count": F.count_if(F.col("_lane") == 2).over(day)})
    rows = rows.withColumns({"part": F.floor((F.col("index") - 1) / most).cast("int") + 1, "parts": F.ceil(F.col("total") / most).cast("int")})
    return rows.sortWithinPartitions("date", *order)


def report_payloads(numbered: DataFrame) -> DataFrame:
    """Date and doc, the JSON (see PAYLOAD) of each report: main lane, positive lane, and families with their members.

    numbered: the rows of placed() with their card, in their order. A report of more cards than a part has is several documents,
    whose lists go on, with the numbers of the whole in each. A task holds one part at a time, its cards as text.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, head, lanes, hot = None, {}, ([], []), {}

        def doc() -> pa.RecordBatch:
            text = lambda x: json.dumps(x, ensure_ascii=False, separators=(",", ":"))
            families = [text({"storyline_key": key, "storyline_name": name, "member_count": n})[:-1] + f',"summaries":[{",".join(own)}]}}' for key, (name, n, own) in hot.items()]
            whole = f'{text(head)[:-1]},"clusters":[{",".join(lanes[0])}],"positive_stories":[{",".join(lanes[1])}],"hot_topics":[{",".join(families)}]}}'
            return pa.RecordBatch.from_arrays([pa.array([at[0]], pa.date32()), pa.array([whole])], ["date", "doc"])

        for batch in batches:
            keys = ("date", "part", "lane", "family", "family_name", "members_of_family", "total", "main_count", "positive_count", "parts", "card")
            for date, part, lane, family, name, n, total, main, positive, parts, card in zip(*(batch.column(c).to_pylist() for c in keys), strict=True):
                if (date, part) != at:
                    if at is not None:
                        yield doc()
                    at, lanes, hot = (date, part), ([], []), {}
                    head = {"date": None if date is None else str(date), "part": part, "parts": parts, "total_cluster_count": total, "main_count": main, "positive_count": positive}
                if lane == "hot":
                    hot.setdefault(family or "", (name, n, []))[2].append(card)
                else:
                    lanes[lane != "main"].append(card)
        if at is not None:
            yield doc()

    text = numbered.select("date", "part", "parts", "lane", "family", "family_name", "members_of_family", "total", "main_count", "positive_count", F.to_json("card").alias("card"))
    return text.mapInArrow(run, "date date, doc string")
