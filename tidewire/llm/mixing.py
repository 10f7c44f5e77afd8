"""Mixing sources to target weights by Pareto order sampling, in DataFrame operations only.

Every source has a target in words (mix_targets). Its documents share it unequally: a document of n words is expected
min(max_copies, level * bits(n)) times in the mix, bits(n) being the binary digits of n, so that a longer document is
likelier, and the level is such that the expected words are the target. The whole part of that number is taken for
certain. The fraction left is the inclusion probability p of one more copy: a document with the uniform number u is
ranked by (u / (1 - u)) / (p / (1 - p)), and the lowest ranks of a source are taken until its target is reached (a
document counts if its middle word still fits), so a source misses its target by half a document at most. The sample's
size is fixed in words, as targets are. u comes from a hash of id and size, so reruns agree.

The cut through the ranks is found by radix descent: words are summed over 4096 bins of the rank, then over 4096
sub-bins of the bin that holds the cut; only the few rows of one sub-bin are put in order. No source, however large, is
gathered in one task, and the decision on a row needs its source's cut alone. A source's level comes from its sums by
binary digits, 64 rows at most.

A null text has no words and is never taken; a null source is a source of its own, the last. Rows repeated under one id
and size draw alike and are taken or left together; ties in rank go by id (null last), then size. Texts of any length
are counted whole. An empty table gives an empty result; extra columns are ignored by taken() and kept by mixed(),
whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewire.runtime import checked, materialise

WEIGHTS = (5, 2, 1)
TOTAL = 1.5
MAX_COPIES = 2
BINS = 4096
SEED = 17


def words(text: Column) -> Column:
    """Runs of characters outside [\\x20\\x09-\\x0D]; null: 0."""
    return F.coalesce(F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("bigint")


def mix_targets(sizes: DataFrame, weights: tuple = WEIGHTS, total: float = TOTAL, max_copies: float = MAX_COPIES) -> DataFrame:
    """Per source of (source, size): source, source_size, target.

    Sources in code-point order (null last) weigh `weights`, repeating; they share total * all words by weight, none above
    max_copies times its own words, the excess going to the others by weight. One row per source is put in order here.
    """
    sources = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    ranked = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.row_number().over(ranked) - 1, F.lit(len(weights))) + 1).cast("int"))
    capped = sources.withColumn("weight", weight).withColumn("cap", F.col("source_size") * F.lit(float(max_copies)))
    #: In order of cap / weight, a source is at its cap if the level that the sources from it on would share reaches it.
    filling = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before, everything = filling.rowsBetween(Window.unboundedPreceding, -1), filling.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    spent = lambda c: F.coalesce(F.sum(c).over(before), F.lit(0.0))
    level = (F.sum("source_size").over(everything) * F.lit(float(total)) - spent("cap")) / (F.sum("weight").over(everything) - spent("weight"))
    levels = capped.withColumn("level", level).withColumn("full", F.col("level") >= F.col("cap") / F.col("weight"))
    share = F.first(F.when(~F.col("full"), F.col("level")), ignorenulls=True).over(everything)
    return levels.select("source", "source_size", F.when(F.col("full"), F.col("cap")).otherwise(F.col("weight") * share).alias("target"))


def uniform(seed: int = SEED) -> Column:
    """A number in (0, 1) from a hash of id and size."""
    text = F.concat_ws(":", F.coalesce(F.col("id").cast("string"), F.lit("")), F.col("size").cast("string"), F.lit(str(seed)))
    return (F.conv(F.substring(F.sha2(text, 256), 1, 12), 16, 10).cast("double") + 0.5) / F.lit(float(1 << 48))


def bits(size: Column) -> Column:
    """Binary digits of a number of words; 0 for none."""
    return F.when(size > 0, F.length(F.bin(size))).otherwise(F.lit(0))


def plan_of(sizes: DataFrame, targets: DataFrame, max_copies: float = MAX_COPIES) -> DataFrame:
    """Per source and bits: source_size, target, whole (certain copies), p (inclusion probability of one more), rest (the source's words that the sample has to give)."""
    sums = sizes.where("size > 0").groupBy("source", bits(F.col("size")).alias("bits")).agg(F.sum("size").alias("words"))
    met = _joined(targets, sums, "right_bits")
    #: Longest documents first: those from which on the level would reach max_copies have that many.
    down = Window.partitionBy("source").orderBy(F.desc("bits"))
    before, everything = down.rowsBetween(Window.unboundedPreceding, -1), down.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    spent = lambda c: F.coalesce(F.sum(c).over(before), F.lit(0))
    mass = F.col("words") * F.col("bits")
    level = (F.col("target") - F.lit(float(max_copies)) * spent(F.col("words"))) / (F.sum(mass).over(everything) - spent(mass))
    levels = met.withColumn("level", level).withColumn("full", F.col("level") * F.col("bits") >= F.lit(float(max_copies)))
    share = F.first(F.when(~F.col("full"), F.col("level")), ignorenulls=True).over(everything)
    expected = levels.withColumn("copies", F.when(F.col("full"), F.lit(float(max_copies))).otherwise(share * F.col("bits")))
    planned = expected.withColumn("whole", F.floor("copies")).withColumn("p", F.col("copies") - F.floor("copies"))
    rest = F.col("target") - F.sum(F.col("whole") * F.col("words")).over(everything)
    return planned.select("source", "source_size", "target", "bits", "whole", "p", rest.alias("rest"))


def row_key() -> Column:
    return F.struct(F.col("q").alias("q"), F.col("id").isNull().alias("none"), F.col("id").alias("id"), F.col("size").alias("size"))


def ranked(rows: DataFrame, plan: DataFrame, seed: int) -> DataFrame:
    """rows of (source, id, size) with the columns of their source's plan for their length, the Pareto rank q, and its bin and sub-bin (null if p is 0)."""
    side = plan.withColumnsRenamed({"source": "_source", "bits": "_bits"})
    met = rows.join(side, F.col("source").eqNullSafe(F.col("_source")) & (bits(F.col("size")) == F.col("_bits"))).drop("_source", "_bits")
    met = met.withColumn("u", uniform(seed))
    met = met.withColumn("q", F.when(F.col("p") > 0, (F.col("u") / (1 - F.col("u"))) / (F.col("p") / (1 - F.col("p")))))
    met = met.withColumn("v", F.col("q") / (1 + F.col("q")) * F.lit(float(BINS)))
    met = met.withColumn("bin", F.least(F.floor("v"), F.lit(BINS - 1)))
    return met.withColumn("sub", F.floor((F.col("v") - F.col("bin")) * F.lit(float(BINS)))).drop("u", "v")


def _first_reaching(sums: DataFrame, bin_col: str, before: str) -> DataFrame:
    """Per source, the first bin up to whose end `rest` words are there (else the last bin), and the words before it."""
    through = Window.partitionBy("source").orderBy(bin_col)
    sums = sums.withColumn("upto", F.sum("words").over(through) + F.col("earlier"))
    here = F.struct(F.col(bin_col).alias("at"), (F.col("upto") - F.col("words")).alias("before"))
    pick = F.coalesce(F.min(F.when(F.col("upto") >= F.col("rest"), here)), F.max(here)).alias("pick")
    return sums.groupBy("source").agg(pick).select("source", F.col("pick.at").alias(bin_col), F.col("pick.before").alias(before))


def with_cuts(rows: DataFrame, plan: DataFrame, seed: int = SEED) -> DataFrame:
    """plan with each source's cut: edge_bin, edge_sub, and last, the greatest (q, id is null, id, size) taken in that sub-bin."""
    sampled = rows.where("size > 0")
    drawn = plan.where("p > 0").select("source", "bits", "p", "rest")
    first = ranked(sampled, checked(drawn), seed).groupBy("source", "bin").agg(F.sum("size").alias("words"), F.max("rest").alias("rest"), F.lit(0).cast("bigint").alias("earlier"))
    edges = materialise(_first_reaching(first, "bin", "earlier").withColumnRenamed("bin", "edge_bin"))
    inner = ranked(sampled, checked(_joined(drawn, edges)), seed).where(F.col("bin") == F.col("edge_bin"))
    second = inner.groupBy("source", "sub").agg(F.sum("size").alias("words"), F.max("rest").alias("rest"), F.max("earlier").alias("earlier"))
    edges = materialise(_joined(edges.select("source", "edge_bin"), _first_reaching(second, "sub", "earlier").withColumnRenamed("sub", "edge_sub")))
    few = ranked(sampled, checked(_joined(drawn, edges)), seed).where((F.col("bin") == F.col("edge_bin")) & (F.col("sub") == F.col("edge_sub")))
    order = Window.partitionBy("source").orderBy("q", F.col("id").asc_nulls_last(), "size")
    few = few.withColumn("upto", F.sum("size").over(order) + F.col("earlier")).where(F.col("upto") - F.col("size") / 2 <= F.col("rest"))
    last = few.groupBy("source").agg(F.max(row_key()).alias("last"))
    return materialise(_joined(plan, _joined(edges.select("source", "edge_bin", "edge_sub"), last)))


def _joined(left: DataFrame, right: DataFrame, how: str = "left") -> DataFrame:
    """Join by source of narrow tables (a row per source, or per source and number of bits); right_bits: right's rows with left's columns."""
    right = right.withColumnRenamed("source", "_right")
    return left.join(right, F.col("source").eqNullSafe(F.col("_right")), "inner" if how == "right_bits" else how).drop("_right")


def copies(rows: DataFrame, cut: DataFrame, targets: DataFrame | None, seed: int = SEED) -> DataFrame:
    """rows of (source, id, size, ...) with source_size, target and copies, the number of times the mix takes the row whole; rows without words only with the targets."""
    met = ranked(rows, checked(cut), seed)  # no plan is for rows without words
    within = (F.col("sub") < F.col("edge_sub")) | ((F.col("sub") == F.col("edge_sub")) & F.coalesce(row_key() <= F.col("last"), F.lit(False)))
    one_more = (F.col("p") > 0) & ((F.col("bin") < F.col("edge_bin")) | ((F.col("bin") == F.col("edge_bin")) & within))
    number = F.col("whole") + F.coalesce(one_more, F.lit(False)).cast("bigint")
    met = met.withColumn("copies", number.cast("bigint")).drop("whole", "rest", "p", "q", "bin", "sub", "edge_bin", "edge_sub", "last")
    if targets is None:
        return met
    none = _joined(rows.where("size <= 0"), checked(targets)).withColumn("copies", F.lit(0).cast("bigint"))
    return met.unionByName(none)


def _keyed(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    return docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), words(F.col(text_col)).alias("size"))


def plan_mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple = WEIGHTS, total: float = TOTAL, max_copies: float = MAX_COPIES, seed: int = SEED) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows of id, source and size; one row per source and bits with its plan and cut; one row per source with its target)."""
    sizes = materialise(_keyed(docs, id_col, text_col, source_col))
    targets = materialise(mix_targets(sizes, weights, total, max_copies))
    plan = materialise(plan_of(sizes, targets, max_copies))
    return sizes, with_cuts(sizes, plan, seed), targets


def taken(docs: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """Per document: id, size, source_size, target, taken."""
    sizes, cut, targets = plan_mix(docs, id_col=id_col, **options)
    out = copies(sizes, cut, targets, options.get("seed", SEED))
    return out.select(F.col("id").alias(id_col), "size", "source_size", F.col("target").cast("double").alias("target"), (F.col("copies") * F.col("size")).alias("taken"))


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """The mix itself: docs' columns, each row as many times as the mix takes it. The text moves nowhere: a row's source and size decide."""
    _, cut, _ = plan_mix(docs, id_col, text_col, source_col, **options)
    held = docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), words(F.col(text_col)).alias("size"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    out = copies(held, cut, None, options.get("seed", SEED)).where("copies > 0")
    return out.select(F.explode(F.array_repeat("row", F.col("copies").cast("int"))).alias("row")).select("row.*")
