"""Exact deduplication as a log-structured merge index over digests, in DataFrame operations only.

Memtables: rows are dealt to `runs` memtables by a hash; each is flushed as a run that is sorted by digest and holds one
entry per digest (best row, count), so a group of copies of any size is summed before the shuffle. A run carries a
filter, a bitmap of fixed size over digest hashes. Compaction merges FANOUT runs of a level into one of the next, until
one run is left; of equal digests the entry with the best identifier is kept. An entry that no other run of its merge
has in its filter passes by the merge.

Entries of the last level that stand for several rows are hits. Only the texts of hits are read again (found by a filter
of fixed size over their ids), and their bytes are compared: least and greatest of a digest's normalised texts are the
same bytes, or the digest has collided and its rows are grouped by the bytes themselves.

Equal: identical after deleting every character of [\\x20\\x09-\\x0D]; null counts as empty. Best: most code points in
the original text, then smallest id (null last), then smallest text hash. Rows repeated under one id with as many code
points are kept or dropped together by classes(); distinct_rows() keeps one of them. Texts of any length are read whole.
An empty table gives an empty result. Extra columns are ignored by classes() and kept by distinct_rows(), whatever their
names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewire.runtime import checked, materialise

#: Memtables, and runs that one compaction merges.
RUNS = 16
FANOUT = 4
#: Bits of a run's filter (512 kB) and of the filter over the hits' ids (2 MB), whatever the number of entries.
RUN_BITS = 1 << 22
HIT_BITS = 1 << 24
BUCKET_BITS = 32_768


def best() -> Column:
    """The smallest of (-code points, id is null, id, text hash): the row that stays."""
    return F.min(F.struct((-F.col("n")).alias("n"), F.col("id").isNull().alias("none"), F.col("id").alias("id"), F.col("h").alias("h"))).alias("best")


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), "[\\x20\\x09-\\x0D]+", "")


def filters(rows: DataFrame, key: Column, bits: int, *by: str) -> DataFrame:
    """Bitmaps of the hashes of key, by the columns `by`: at most bits / 32768 rows of 4 kB each."""
    slotted = rows.select(*by, F.pmod(F.xxhash64(key), F.lit(bits)).alias("slot"))
    return slotted.groupBy(*by, F.expr(f"slot div {BUCKET_BITS}").alias("bucket")).agg(F.expr(f"bitmap_construct_agg(slot % {BUCKET_BITS})").alias("bitmap"))


def _is_set(bitmap: str) -> str:
    """Whether the bit for `slot` is set."""
    byte = f"cast(conv(hex(substring({bitmap}, cast((slot % {BUCKET_BITS}) div 8 + 1 as int), 1)), 16, 10) as int)"
    return f"(shiftright({byte}, cast(slot % 8 as int)) & 1) = 1"


def passing(rows: DataFrame, bitmaps: DataFrame, key: Column, bits: int) -> DataFrame:
    """The rows whose key the filter lets through."""
    slotted = rows.withColumn("slot", F.pmod(F.xxhash64(key), F.lit(bits))).withColumn("bucket", F.expr(f"slot div {BUCKET_BITS}"))
    return slotted.join(F.broadcast(bitmaps), "bucket").where(F.expr(_is_set("bitmap"))).drop("slot", "bucket", "bitmap")


def flushed(entries: DataFrame, runs: int) -> DataFrame:
    """Level 0: the memtables' runs, each sorted by digest."""
    run = F.pmod(F.xxhash64("id", "h"), F.lit(runs)).alias("run")
    table = entries.groupBy(run, "digest").agg(best(), F.count("*").alias("copies"))
    return materialise(table.sortWithinPartitions("run", "digest"))


def compacted(level: DataFrame, fanout: int, bits: int = RUN_BITS) -> DataFrame:
    """The next level: runs of `fanout` runs each. Entries whose digest no other run of the merge may hold pass by it."""
    merge = F.expr(f"run div {fanout}")
    held = filters(level, F.col("digest"), bits, "run").withColumn("merge", merge)
    held = held.groupBy("merge", "bucket").agg(F.collect_list(F.struct("run", "bitmap")).alias("filters"))
    slotted = level.withColumn("merge", merge).withColumn("slot", F.pmod(F.xxhash64("digest"), F.lit(bits))).withColumn("bucket", F.expr(f"slot div {BUCKET_BITS}"))
    elsewhere = F.expr(f"exists(filters, f -> f.run <> run AND {_is_set('f.bitmap')})")
    met = slotted.join(F.broadcast(held), ["merge", "bucket"]).select(F.col("merge").alias("run"), "digest", "best", "copies", elsewhere.alias("elsewhere"))
    merged = met.where("elsewhere").groupBy("run", "digest").agg(F.min("best").alias("best"), F.sum("copies").alias("copies"))
    return materialise(met.where("NOT elsewhere").drop("elsewhere").unionByName(merged).sortWithinPartitions("run", "digest"))


def index(entries: DataFrame, runs: int = RUNS, fanout: int = FANOUT) -> DataFrame:
    """The last level over (digest, id, n, h): digest, best (struct of -n, id is null, id, h), copies."""
    level = flushed(entries, runs)
    while runs > 1:
        level, runs = compacted(level, fanout), -(-runs // fanout)
    return level.drop("run")


def _rows(docs: DataFrame, id_col: str, text_col: str, digest_hex: int) -> DataFrame:
    """(id, n, h, norm, sha, digest)."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), F.length(text).cast("bigint").alias("n"), F.xxhash64(text).alias("h"), normalised(F.col(text_col)).alias("norm"))
    return rows.withColumn("sha", F.sha2("norm", 256)).withColumn("digest", F.unhex(F.substring("sha", 1, digest_hex)))


def grouped(docs: DataFrame, id_col: str, text_col: str, runs: int, digest_hex: int) -> DataFrame:
    """Per row: id, n, h, sha, best, group_size."""
    entries = materialise(_rows(docs, id_col, text_col, digest_hex).select("id", "n", "h", "sha", "digest"))
    level = materialise(index(entries.select("id", "n", "h", "digest"), runs).where("copies > 1"))
    side = checked(level)
    hit_ids = materialise(filters(entries.join(side, "digest", "left_semi"), F.col("id"), HIT_BITS))
    read = passing(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), hit_ids, F.col("id"), HIT_BITS)
    hits = _rows(read, "id", "text", digest_hex).select("id", "n", "h", "norm", "sha", "digest").join(side, "digest", "left_semi")
    collided = materialise(hits.groupBy("digest").agg(F.min("norm").alias("least"), F.max("norm").alias("most")).where("least <> most").select("digest"))
    single = F.struct((-F.col("n")).alias("n"), F.col("id").isNull().alias("none"), F.col("id").alias("id"), F.col("h").alias("h"))
    met = entries.join(side, "digest", "left").select("id", "n", "h", "sha", "digest", F.coalesce("best", single).alias("best"), F.coalesce("copies", F.lit(1).cast("bigint")).alias("group_size"))
    if collided.isEmpty():
        return met.drop("digest")
    own = hits.join(checked(collided), "digest", "left_semi")
    groups = own.groupBy("digest", "norm").agg(best(), F.count("*").alias("group_size"), F.first("sha").alias("sha"))
    parted = own.select("id", "n", "h", "digest", "norm").join(groups, ["digest", "norm"]).select("id", "n", "h", "sha", "best", "group_size")
    return met.join(checked(collided), "digest", "left_anti").drop("digest").unionByName(parted)


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", runs: int = RUNS, digest_hex: int = 64) -> DataFrame:
    """Per row: id, keep_id, group_size, kept, text_sha256. digest_hex: digits of the digest that the index goes by (tests shorten it to meet collisions)."""
    kept = F.col("id").eqNullSafe(F.col("best.id")) & (F.col("n") == -F.col("best.n"))
    return grouped(docs, id_col, text_col, runs, digest_hex).select(F.col("id").alias(id_col), F.col("best.id").alias("keep_id"), "group_size", kept.alias("kept"), F.col("sha").alias("text_sha256"))


def distinct_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of docs of each group of equal texts: the best; of rows repeated under its id and text, one."""
    rows = materialise(grouped(docs, id_col, text_col, RUNS, 64).where("group_size > 1").select("id", "h", "best"))
    stays = F.col("id").eqNullSafe(F.col("best.id")) & (F.col("h") == F.col("best.h"))
    named = [F.col("id").alias("_id"), F.col("h").alias("_h")]
    h = F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))
    this = F.col(id_col).eqNullSafe(F.col("_id")) & (h == F.col("_h"))
    left = docs.join(checked(materialise(rows.where(~stays).select(*named).distinct())), this, "left_anti")
    again = materialise(rows.where(stays).groupBy(*named).count().where("count > 1").drop("count"))
    if again.isEmpty():
        return left
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    one = left.join(checked(again), this, "left_semi").select(F.col(id_col).alias("id"), h.alias("h"), whole).dropDuplicates(["id", "h"]).select("row.*")
    return left.join(checked(again), this, "left_anti").unionByName(one)
