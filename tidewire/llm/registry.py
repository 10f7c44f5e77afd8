"""The queries of this subpackage and their SQL, for the driver's entry file."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewire.llm import alignment, byte_bpe, exact_dedup, importance, language, mixing, near_dedup, neighbours, quality, repeats, sampling, set_join, toxicity, web_text


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def tokenizer_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def op1_pareto_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.taken(_documents(spark, sf_dir))


def op3_lsm_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.classes(_documents(spark, sf_dir))


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.digests(_documents(spark, sf_dir), tokenizer_path(), tokenizer_pattern())


QUERIES = {
    "op1_pareto_mix": op1_pareto_mix,
    "op3_lsm_exact_dedup": op3_lsm_exact_dedup,
    "op10_byte_bpe": op10_byte_bpe,
}

ORACLE_SQL = {
    "op1_pareto_mix": """
        WITH sized AS (
          SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size FROM documents),
        sources AS (SELECT source, CAST(sum(size) AS DOUBLE) AS source_size, sum(size) * 2.0::DOUBLE AS cap FROM sized GROUP BY source),
        weighed AS (SELECT *, [5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE][CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS BIGINT)] AS weight FROM sources),
        levels AS (
          SELECT *, (sum(source_size) OVER () * 1.5::DOUBLE - coalesce(sum(cap) OVER before, 0.0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER before, 0.0)) AS level
          FROM weighed WINDOW before AS (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
        targets AS (
          SELECT source, source_size, CASE WHEN level >= cap / weight THEN cap ELSE weight * (SELECT arg_min(level, (cap / weight, source)) FROM levels WHERE level < cap / weight) END AS target FROM levels),
        classes AS (
          SELECT t.source, t.source_size, t.target, c.bits, c.words FROM targets t
          JOIN (SELECT source, CAST(length(bin(size)) AS BIGINT) AS bits, sum(size) AS words FROM sized WHERE size > 0 GROUP BY 1, 2) c ON t.source IS NOT DISTINCT FROM c.source),
        filled AS (
          SELECT *, (target - 2.0::DOUBLE * coalesce(sum(words) OVER before, 0)) / (sum(words * bits) OVER (PARTITION BY source) - coalesce(sum(words * bits) OVER before, 0)) AS level
          FROM classes WINDOW before AS (PARTITION BY source ORDER BY bits DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
        expected AS (
          SELECT *, CASE WHEN level * bits >= 2.0::DOUBLE THEN 2.0::DOUBLE ELSE bits * max(CASE WHEN level * bits < 2.0::DOUBLE THEN {'b': bits, 'l': level} END) OVER (PARTITION BY source).l END AS copies FROM filled),
        plan AS (
          SELECT source, bits, target, floor(copies) AS whole, copies - floor(copies) AS p, target - sum(floor(copies) * words) OVER (PARTITION BY source) AS rest FROM expected),
        ranks AS (
          SELECT d.doc_id, d.source, d.size, p.whole, p.p, p.rest,
            (('0x' || substr(sha256(concat(coalesce(CAST(doc_id AS VARCHAR), ''), ':', size, ':17')), 1, 12))::BIGINT + 0.5::DOUBLE) / 281474976710656.0::DOUBLE AS u
          FROM sized d JOIN plan p ON d.source IS NOT DISTINCT FROM p.source AND d.size > 0 AND CAST(length(bin(d.size)) AS BIGINT) = p.bits),
        summed AS (
          SELECT *, sum(CASE WHEN p > 0 THEN size ELSE 0 END) OVER (PARTITION BY source ORDER BY CASE WHEN p > 0 THEN (u / (1 - u)) / (p / (1 - p)) END NULLS LAST, doc_id NULLS LAST, size) AS upto FROM ranks),
        chosen AS (
          SELECT doc_id, source, size, CAST(size * (whole + CASE WHEN p > 0 AND upto - size / 2.0::DOUBLE <= rest THEN 1 ELSE 0 END) AS BIGINT) AS taken FROM summed
          UNION ALL SELECT doc_id, source, size, CAST(0 AS BIGINT) FROM sized WHERE size = 0)
        SELECT doc_id, size, CAST(source_size AS BIGINT) AS source_size, target, taken
        FROM chosen c JOIN targets t ON c.source IS NOT DISTINCT FROM t.source""",
    "op3_lsm_exact_dedup": """
        WITH d AS (
          SELECT doc_id, length(coalesce(text, '')) AS n, sha256(regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]', '', 'g')) AS text_sha256 FROM documents)
        SELECT doc_id, first_value(doc_id) OVER best AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size,
          doc_id IS NOT DISTINCT FROM first_value(doc_id) OVER best AS kept, text_sha256
        FROM d WINDOW best AS (PARTITION BY text_sha256 ORDER BY n DESC, doc_id NULLS LAST)""",
}


def op4_centroid_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    model = language.train(docs, sampling.fold(F.col("_id"), 3) != 1)
    out = language.predicted(docs, model)
    return out.select("doc_id", (sampling.fold(F.col("doc_id"), 3) == 1).alias("held_out"), "lang_pred", "score", "cosine", "rejected")


def op5_noisy_or_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), sampling.fold(F.col("_id"), 5) != 0)
    out = toxicity.scored(docs, model)
    return out.select("doc_id", (sampling.fold(F.col("doc_id"), 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), F.size("offending").alias("n_offending"))


def op8_quadratic_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    model = quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), sampling.fold(F.col("_id"), 4) != 2)
    out = quality.scored(docs, model, keep=["doc_id"])
    return out.select("doc_id", (sampling.fold(F.col("doc_id"), 4) == 2).alias("held_out"), "score", (F.col("score") >= quality.THRESHOLD).cast("int").alias("predicted"))


QUERIES |= {
    "op4_centroid_language": op4_centroid_language,
    "op5_noisy_or_toxicity": op5_noisy_or_toxicity,
    "op8_quadratic_quality": op8_quadratic_quality,
}


def op9_weighted_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.classes(_documents(spark, sf_dir))


QUERIES["op9_weighted_minhash"] = op9_weighted_minhash


def op6_maximal_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.digests(_documents(spark, sf_dir))


QUERIES["op6_maximal_repeats"] = op6_maximal_repeats


def op2_learned_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.search(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("id") % 100 == 0)


def op7_template_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return web_text.extract(spark.read.parquet(f"{sf_dir}/pages.parquet")).withColumn("n_chars", F.length("text").cast("bigint"))


QUERIES |= {"op2_learned_partitions": op2_learned_partitions, "op7_template_text": op7_template_text}


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = importance.resampled(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return out.select("doc_id", "n_features", "weight", "score", "rank")


QUERIES["op13_importance_resampling"] = op13_importance_resampling

ORACLE_SQL["op13_importance_resampling"] = """
        WITH lowered AS (
          SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS words FROM documents),
        asked AS (
          SELECT unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')) AS word FROM benchmark),
        numbered AS (SELECT doc_id, words, row_number() OVER () AS r FROM lowered),
        occurring AS (SELECT r, unnest(words) AS word FROM numbered),
        shifts AS (
          SELECT list(list_reduce(list_concat([v], range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY v) AS crc FROM range(256) t(v)),
        bucketed AS (
          SELECT word, xor(list_reduce(list_concat([4294967295], list_transform(range(0, octet_length(encode(word))), lambda k: ('0x' || substr(hex(encode(word)), 2 * k + 1, 2))::BIGINT)),
            lambda c, b: xor(c >> 8, crc[(xor(c, b) & 255) + 1])), 4294967295) % 10000 AS bucket
          FROM (SELECT word FROM occurring UNION SELECT word FROM asked), shifts),
        s AS (SELECT bucket, count(*) AS s FROM occurring JOIN bucketed USING (word) GROUP BY 1),
        t AS (SELECT bucket, count(*) AS t FROM asked JOIN bucketed USING (word) GROUP BY 1),
        gains AS (
          SELECT bucket, CAST(floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * ((SELECT count(*) FROM occurring) + 10000)::DOUBLE
            / ((coalesce(s, 0) + 1)::DOUBLE * ((SELECT count(*) FROM asked) + 10000)::DOUBLE))) AS BIGINT) AS gain
          FROM s FULL JOIN t USING (bucket)),
        weighed AS (SELECT r, CAST(sum(gain) AS BIGINT) AS weight FROM occurring JOIN bucketed USING (word) JOIN gains USING (bucket) GROUP BY 1),
        scored AS (
          SELECT doc_id, len(words) AS n_features, coalesce(weight, 0) AS weight,
            coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296.0::DOUBLE))) AS BIGINT) AS score
          FROM numbered LEFT JOIN weighed USING (r)),
        placed AS (
          SELECT *, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id NULLS LAST, n_features) AS place, count(*) OVER (PARTITION BY n_features >= 20) AS n FROM scored)
        SELECT doc_id, CAST(n_features AS BIGINT) AS n_features, weight, score, CASE WHEN n_features >= 20 AND place <= 10 * n // 100 THEN place END AS rank FROM placed"""


def op11_set_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return set_join.joined(_documents(spark, sf_dir))


QUERIES["op11_set_join"] = op11_set_join


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    a, b = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "piece_bpe_32k.model"))
    return alignment.digests(_documents(spark, sf_dir), a, b, tokenizer_pattern())


QUERIES["op12_token_alignment"] = op12_token_alignment
