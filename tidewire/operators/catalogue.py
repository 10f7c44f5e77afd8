"""The store: table schemas, staged replacement, lookups, inserts and updates as DataFrame transformations."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewire.operators.rounds import dense_places

# The tables of the store with their columns.
TABLES = {
    "articles": "id bigint, url string, title string, source_name string, published_at timestamp, content string, topics array<string>, embedding array<float>, clustered boolean, is_searched boolean, search_region string, source_kind string, platform string, account_id string, is_official_source boolean, origin_region string, searched_provider string, is_placeholder boolean, search_acceptance_status string, search_acceptance_reason string, search_evidence_role string, ownership_suppressed boolean, created_at timestamp",
    "clusters": "id bigint, topic_category string, article_ids array<bigint>, summary string, perspectives map<string,string>, report_date date, freshness_state string, continues_cluster_id bigint, storyline_key string, storyline_name string, storyline_role string, storyline_confidence double, storyline_state string, quality_status string, quality_score double",
    "search_request_events": "id bigint, provider string, request_type string, target_region string, target_label string, target_role string, cluster_key string, query string, http_status int, result_count int, accepted_count int, rejection_reason string, rejection_count int, duration_ms int, estimated_cost_usd double, created_at timestamp",
    "search_candidate_reviews": "id bigint, url string, domain string, title string, source_name string, target_label string, target_region string, target_role string, stage string, verdict string, decision string, reason string, identity_evidence string, published_at timestamp, created_at timestamp",
    "cluster_quality_reports": "cluster_id bigint, status string, quality_score double, flags array<string>, confirmed_claims array<string>, contested_claims array<string>",
    "cluster_claims": "cluster_id bigint, claim_uid string, text string, claim_type string, importance double, source_names array<string>",
    "claim_evidence": "cluster_id bigint, claim_uid string, source_name string, stance string, excerpt string, confidence double",
    "cluster_evaluations": "id bigint, cluster_id bigint, report_date date, cluster_key string, dims map<string,double>, rationale string, signal double, composite double, rank int, selected boolean, display_category string, status string, flags array<string>, subject_regions array<string>, model string, created_at timestamp",
    "editorial_feedback": "id bigint, cluster_id bigint, verdict int, channel string, note string, created_at timestamp",
    "calibration_weights": "dimension string, weight double, seed double, updated_at timestamp",
    "calibration_log": "id bigint, dimension string, old_weight double, new_weight double, reason string, created_at timestamp",
    "editorial_policy": "id bigint, version int, content string, created_at timestamp",
    "feedback_corrections": "id bigint, evaluation_id bigint, kind string, dimension string, suggested_value double, payload string, channel string, created_at timestamp",
    "llm_call_events": "id bigint, stage string, model string, report_date date, cluster_key string, item_count int, attempt int, status string, finish_reason string, prompt_tokens int, completion_tokens int, total_tokens int, duration_ms int, created_at timestamp",
    "storylines": "storyline_key string, storyline_name string, storyline_state string, last_report_date date, quality_score double",
    "storyline_events": "storyline_key string, cluster_id bigint, event_date date, title string, storyline_state string, summary string, quality_score double, event_type string",
}
DECISIONS = ("accepted", "rejected", "pending_review")
PROMOTABLE = ("official_web", "country_editorial")


def _filesystem(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


POINTER = "_live-"


def _generations(spark: SparkSession, path: str) -> list[tuple[int, str]]:
    """(number, folder) of the generations that a table's pointers name, oldest first."""
    p, fs = _filesystem(spark, path)
    if not fs.exists(p):
        return []
    names = [f.getPath().getName() for f in fs.listStatus(p)]
    return sorted((int(number), folder) for number, _, folder in (n.removeprefix(POINTER).partition("-") for n in names if n.startswith(POINTER)))


def replace_table(df: DataFrame, path: str, keep: int = 1) -> None:
    """Write a new generation, then name it live by one rename of its pointer; until then, and if anything fails, readers see the old one.

    Generations are folders beside each other, and the pointer with the highest number names the live one. Older ones are
    swept after the commit, but for `keep` of them, so that running readers may finish. One writer at a time: a second one
    that commits the same number fails.
    """
    spark, path = df.sparkSession, path.rstrip("/")
    folder = f"gen-{uuid.uuid4().hex}"
    df.write.parquet(f"{path}/{folder}")
    known = _generations(spark, path)
    number = known[-1][0] + 1 if known else 1
    staged, fs = _filesystem(spark, f"{path}/_next-{folder}")
    fs.create(staged, False).close()
    if any(n >= number for n, _ in _generations(spark, path)) or not fs.rename(staged, _filesystem(spark, f"{path}/{POINTER}{number:010d}-{folder}")[0]):
        raise RuntimeError(f"another writer has replaced {path}")
    for n, old in known[: max(0, len(known) - keep)]:
        fs.delete(_filesystem(spark, f"{path}/{POINTER}{n:010d}-{old}")[0], False)
        fs.delete(_filesystem(spark, f"{path}/{old}")[0], True)


def read_table(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """The live generation of a table."""
    known = _generations(spark, path)
    if not known:
        raise FileNotFoundError(f"{path} has no generation")
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.parquet(f"{path.rstrip('/')}/{known[-1][1]}")


def open_store(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    """Every table of the store, empty ones created where they are missing, as views and DataFrames."""
    out = {}
    for name, schema in TABLES.items():
        path = f"{root.rstrip('/')}/{name}"
        if not _generations(spark, path):
            replace_table(spark.createDataFrame([], schema), path)
        out[name] = read_table(spark, path, schema)
        out[name].createOrReplaceTempView(name)
    return out


def by_key(rows: DataFrame, key: str, value) -> DataFrame:
    """The rows of one key; the filter reaches the scan."""
    return rows.where(F.col(key) == F.lit(value))


def append_numbered(existing: DataFrame, incoming: DataFrame, order: list, key: str = "id") -> DataFrame:
    """Incoming rows get the ids after the largest one, in order, and are appended; ids come from places inside ranges of the order."""
    top = existing.agg(F.coalesce(F.max(key), F.lit(0))).first()[0]
    placed = dense_places(incoming, *[F.col(c) if isinstance(c, str) else c for c in order], name="_place")
    numbered = placed.withColumn(key, (F.col("_place") + F.lit(int(top))).cast(existing.schema[key].dataType))
    return existing.unionByName(numbered.select(*existing.columns))


def link(rows: DataFrame, links: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Rows whose keys a link names take its values (null ones too); the others stay."""
    new = links.select(*keys, F.struct(*values).alias("_new"))
    met = rows.join(new, keys, "left")
    return met.select(*[F.when(F.col("_new").isNotNull(), F.col(f"_new.{c}")).otherwise(F.col(c)).alias(c) if c in values else F.col(c) for c in rows.columns])


def seeded(weights: DataFrame, seeds: DataFrame) -> DataFrame:
    """Seeds (dimension, weight) for dimensions without a weight; known ones stay."""
    fresh = seeds.join(weights.select("dimension"), "dimension", "left_anti")
    return weights.unionByName(fresh.select("dimension", "weight", F.col("weight").alias("seed")))


def updated_weights(weights: DataFrame, changes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Weights after changes (dimension, new_weight, reason), and their log rows; an unknown dimension's seed is its first weight."""
    old = weights.select("dimension", F.col("weight").alias("old_weight"))
    log = changes.join(old, "dimension", "left").select("dimension", F.coalesce("old_weight", F.lit(0.0)).alias("old_weight"), "new_weight", "reason")
    known = weights.join(changes.select("dimension", "new_weight"), "dimension", "left").select("dimension", F.coalesce("new_weight", "weight").alias("weight"), "seed")
    fresh = changes.join(weights.select("dimension"), "dimension", "left_anti").select("dimension", F.col("new_weight").alias("weight"), F.col("new_weight").alias("seed"))
    return known.unionByName(fresh), log


def reset_weights(weights: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Every weight at its seed, and log rows for those that moved."""
    moved = weights.where("weight <> seed").select("dimension", F.col("weight").alias("old_weight"), F.col("seed").alias("new_weight"), F.lit("reset").alias("reason"))
    return weights.withColumn("weight", F.col("seed")), moved


def decided(reviews: DataFrame, decisions: DataFrame) -> DataFrame:
    """Reviews after decisions (id, decision, reason); an unknown decision fails the query."""
    known = F.when(F.col("decision").isin(*DECISIONS), F.col("decision")).otherwise(F.raise_error(F.concat(F.lit("Unsupported search review decision: "), "decision")))
    return link(reviews, decisions.select("id", known.alias("decision"), "reason"), ["id"], ["decision", "reason"])


def promotable(reviews: DataFrame) -> DataFrame:
    """(domain, verdict, region, entity) of pending reviews that may become a binding, the latest of a domain.

    Official sites and country editorials only, with domain, region and label; a publisher region in the evidence must agree.
    """
    domain, region = F.regexp_replace(F.lower(F.trim("domain")), "^www\\.", ""), F.lower(F.trim("target_region"))
    publisher = F.lower(F.trim(F.coalesce(F.get_json_object("identity_evidence", "$.publisher_region"), F.lit(""))))
    ok = (F.col("decision") == "pending_review") & F.col("verdict").isin(*PROMOTABLE) & (domain != "") & (region != "") & (F.trim("target_label") != "") & ((publisher == "") | (publisher == region))
    bound = reviews.where(F.coalesce(ok, F.lit(False))).select("id", domain.alias("domain"), "verdict", region.alias("region"), F.when(F.col("verdict") == "official_web", F.trim("target_label")).alias("entity"))
    return bound.groupBy("domain").agg(F.max_by(F.struct("verdict", "region", "entity"), "id").alias("b")).select("domain", "b.*")


def with_bindings(bindings: DataFrame, configured: DataFrame, promoted: DataFrame) -> DataFrame:
    """(domain, verdict, region, entity): promoted ones over reviewed ones over configured sources."""
    ranked = promoted.withColumn("_p", F.lit(0)).unionByName(bindings.withColumn("_p", F.lit(1))).unionByName(configured.withColumn("_p", F.lit(2)))
    return ranked.groupBy("domain").agg(F.min_by(F.struct("verdict", "region", "entity"), "_p").alias("b")).select("domain", "b.*")


def correction_verdicts(corrections: DataFrame, evaluations: DataFrame) -> DataFrame:
    """Promotions and demotions as accepted and rejected training rows of their evaluation."""
    met = corrections.where(F.col("kind").isin("promote", "demote")).join(evaluations, F.col("evaluation_id") == F.col("id_evaluation"))
    return met.withColumn("verdict", F.when(F.col("kind") == "promote", 1).otherwise(-1))


def rejoined(items: DataFrame, answers: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Items with the answer of their batch and index, and whether it is missing (none, or blank)."""
    met = items.join(answers.select(*keys, value), keys, "left")
    return met.withColumn("missing", F.trim(F.coalesce(value, F.lit(""))) == "")
