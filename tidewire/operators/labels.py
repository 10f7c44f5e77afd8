"""Labels of hot-topic families: normal form, repair of stale ones, and distinct names for the tabs of a report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Prefixes and punctuation of labels, and words that tell one conflict and its escalation from others.
DEFAULT = "全球焦点"
_PREFIX = "^(热点专题[-:：]?|专题[-:：]?)"
_EDGE = "^[ \\-:：，,、。.；;]+|[ \\-:：，,、。.；;]+$"
REFINERY = "(?i)(製油|炼油|炼厂|油库|refiner|oil depot)"
RUSSIA = "(?i)(俄罗斯|俄军|俄方|俄国防部|莫斯科|克里米亚|Russia|Russian|Moscow|Crimea)"
UKRAINE = "(?i)(乌克兰|乌军|乌方|泽连斯基|Ukraine|Ukrainian|Zelensky)"
ESCALATION = "(?i)(军事|军|袭击|攻击|互袭|无人机|导弹|防空|边境|打击|strike|attack|drone|missile|military|border|Belarus|Zaporizhzhia)"
OTHER_CONFLICT = "(?i)(美以伊|伊朗|以色列|加沙|哈马斯|Iran|Israeli?|Gaza|Hamas)"


def compact(text: Column, limit: int) -> Column:
    """A label without prefix and white space, cut, without punctuation at its ends."""
    bare = F.regexp_replace(F.regexp_replace(F.trim(F.coalesce(text, F.lit(""))), _PREFIX, ""), "\\s+", "")
    return F.regexp_replace(F.substring(bare, 1, limit), _EDGE, "")


def topic_name(name: Column, headline: Column, limit: int = 10) -> Column:
    """The label's normal form, else the headline's, else the default."""
    return F.coalesce(F.nullif(compact(name, limit), F.lit("")), F.nullif(compact(headline, limit), F.lit("")), F.lit(DEFAULT))


def is_public_chinese(name: Column) -> Column:
    """CJK characters, and neither kana nor Cyrillic."""
    return name.rlike("[\\x{4e00}-\\x{9fff}]") & ~name.rlike("[\\x{3040}-\\x{30ff}\\x{0400}-\\x{04ff}]")


def specific_labels(members: DataFrame, limit: int = 10) -> DataFrame:
    """Per family of (family, pos, short_name, headline and, if there is one, short_name_en): the first member's label that reads as Chinese with its English one, else the first member's without; and the lead headline's label and the family's text."""
    own = topic_name(F.col("short_name"), F.col("headline"), limit)
    english = F.nullif(F.trim("short_name_en"), F.lit("")) if "short_name_en" in members.columns else F.lit(None).cast("string")
    rows = members.select("family", "pos", own.alias("label"), english.alias("label_en"), topic_name(F.lit(None).cast("string"), F.col("headline"), limit).alias("lead"), F.concat_ws("\n", "short_name", "headline").alias("text"))
    g = rows.groupBy("family").agg(
        F.min(F.when(is_public_chinese(F.col("label")), F.struct("pos", "label", "label_en"))).alias("chinese"), F.min(F.struct("pos", "lead")).alias("first"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "text"))), lambda x: x["text"]), "\n").alias("text"))
    return g.select("family", F.coalesce("chinese.label", "first.lead").alias("specific"), F.col("chinese.label_en").alias("specific_en"), F.col("first.lead").alias("lead"), "text")


def repaired(families: DataFrame, members: DataFrame, limit: int = 10) -> DataFrame:
    """Families (report, place, family, name, name_en, storyline_name) with a label and an English one that fit: report, family, label, label_en.

    A label of another conflict, or of refineries, on stories of one known escalation gives way to the narrowest own one;
    a label that doesn't read as Chinese to one that does. Labels of one report differ, whatever their case: a repeated
    one becomes the storyline's name, else the specific label, else is joined with the lead headline. The English label goes
    where its Chinese one goes: a storyline's name has none, the specific one its member's (or, instead of a label that
    doesn't read as Chinese, the family's own).
    """
    met = families.join(specific_labels(members, limit), "family", "left")
    name = topic_name(F.col("name"), F.col("lead"), limit)
    text = F.coalesce("text", F.lit(""))
    escalation = text.rlike(RUSSIA) & text.rlike(UKRAINE) & text.rlike(ESCALATION)
    stale = F.concat_ws("\n", name, "name_en").rlike(REFINERY) | name.rlike(OTHER_CONFLICT)
    specific = F.coalesce("specific", F.lit(DEFAULT))
    english = F.nullif(F.trim("name_en"), F.lit(""))
    pair = lambda label, en: F.struct(label.alias("label"), en.alias("en"))
    fit = F.when(escalation & stale, pair(specific, F.col("specific_en"))).when(is_public_chinese(name), pair(name, english)).when(is_public_chinese(specific), pair(specific, F.coalesce("specific_en", english))).otherwise(pair(name, english))
    story = topic_name(F.col("storyline_name"), F.col("lead"), limit)
    rows = met.select("report", F.struct("place", "family", fit["label"].alias("label"), fit["en"].alias("en"), story.alias("story"), specific.alias("specific"), F.col("specific_en"), F.coalesce("lead", F.lit(DEFAULT)).alias("lead")).alias("f"))
    tabs = rows.groupBy("report").agg(F.array_sort(F.collect_list("f")).alias("tabs"))
    #: A report has a few tabs: they are named one after the other.
    start = F.struct(F.array().cast("array<string>").alias("used"), F.array().cast("array<struct<family:bigint,label:string,label_en:string>>").alias("out"))

    def named(acc: Column, f: Column) -> Column:
        free = lambda x: ~F.array_contains(acc["used"], F.lower(x))
        label = F.when(free(f["label"]), f["label"]).when(free(f["story"]), f["story"]).when(free(f["specific"]), f["specific"]).otherwise(F.concat(f["label"], F.lit("："), f["lead"]))
        english = F.when(free(f["label"]), f["en"]).when(free(f["story"]), F.lit(None).cast("string")).when(free(f["specific"]), f["specific_en"]).otherwise(f["en"])
        one = F.array(F.struct(f["family"].cast("bigint").alias("family"), label.alias("label"), english.alias("label_en")))
        return F.struct(F.concat(acc["used"], F.array(F.lower(label))).alias("used"), F.concat(acc["out"], one).alias("out"))

    done = tabs.select("report", F.aggregate("tabs", start, named, lambda acc: acc["out"]).alias("out"))
    return done.select("report", F.explode("out").alias("o")).select("report", "o.family", "o.label", "o.label_en")
