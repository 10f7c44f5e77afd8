"""Search acceptance: who published a candidate, whom it mentions, and which voices a cluster already has."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Markers of governmental suffixes, roles of actors and of events, verdicts of publishers, and patterns.
GOVERNMENTAL = ("gov", "mil", "govt", "gouv")
ACTOR_ROLES = ("company", "government", "government_agency", "ministry", "party", "organization", "person")
EVENT_ROLES = ("principal", "decision_maker", "regulator", "claimant", "respondent", "accused_party", "directly_affected_principal", "contracting_party")
SOURCE_TYPES = ("official_web", "official_social", "country_editorial", "reject")
RELATIONSHIPS = ("same_entity", "quoted_by_third_party", "covered_by_third_party", "uncertain", "unrelated")
BACKGROUND = (
    "(?i)(annual[-_ ]?report|business[-_ ]?report|financial[-_ ]?report|quarterly[-_ ]?report|10[-_ ]?k|year[-_ ]?in[-_ ]?review|investor[-_ ]?relations|(press|photo|media)?[-_ ]?gallery|"
    "fact[-_ ]?sheet|factsheet|brochure|about[-_ ]?(the|us)|company[-_ ]?overview|institutional[-_ ]?history|our[-_ ]?history|backgrounder)"
)
NO_VOICE = "(?i)(facility|factory|plant|mall|site|model|product|platform|store|设施|核设施|工厂|商场|门店|产品|模型|平台)$"
QUOTED = "[\"'“”‘’][^\"'“”‘’]{4,}[\"'“”‘’]"
ATTRIBUTED = "(?i)(said|stated|told|responded|announced|表示|回应|称|声明|指出)[：,:]?"
CONFIDENT = 0.85
DIRECT = 0.70

_WIDE = "".join(chr(c) for c in range(0xFF01, 0xFF5F))
_NARROW = "".join(chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F))


def collapsed(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), "\\s+", " "))


def identity_text(text: Column) -> Column:
    """Lower-case letters and digits; full-width forms count as the narrow ones."""
    return F.regexp_replace(F.lower(F.translate(F.coalesce(text, F.lit("")), _WIDE, _NARROW)), "[^\\p{L}\\p{N}]", "")


def official_background(title: Column, url: Column) -> Column:
    """reports, galleries and institutional pages are background, whoever owns them."""
    return F.concat_ws("\n", F.coalesce(title, F.lit("")), F.coalesce(url, F.lit(""))).rlike(BACKGROUND)


def _host(url: Column) -> Column:
    return F.regexp_replace(F.lower(F.regexp_extract(url, "^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]*)", 1)), "^www\\.", "")


def governmental(url: Column) -> Column:
    """a gov or mil top-level domain, or such a label below a country's."""
    labels = F.split(_host(url), "\\.")
    last, second = F.element_at(labels, -1), F.try_element_at(labels, F.lit(-2))
    return last.isin(*GOVERNMENTAL) | ((F.length(last) == 2) & F.coalesce(second.isin(*GOVERNMENTAL), F.lit(False)))


def social_account(url: Column) -> Column:
    """V10: 'platform:account' of a profile or channel URL, else null."""
    host, path = _host(url), F.regexp_extract(url, "^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*/*([^?#]*)", 1)
    x, handle, channel = F.regexp_extract(path, "^([A-Za-z0-9_]{1,15})(/|$)", 1), F.regexp_extract(path, "^@([^/]+)", 1), F.regexp_extract(path, "^channel/+([^/]+)/*$", 1)
    tube = F.when(handle != "", handle).when(channel != "", channel)
    return F.when((host == "x.com") & (x != ""), F.concat(F.lit("x:"), x)).when(host == "youtube.com", F.concat(F.lit("youtube:"), tube))


def canonical_url(url: Column) -> Column:
    """An HTTP(S) URL, or the HTTP(S) target of its url parameter; empty for anything else."""
    raw = F.trim(F.coalesce(url, F.lit("")))
    target = F.trim(F.try_url_decode(F.regexp_extract(raw, "[?&]url=([^&#]*)", 1)))
    web = lambda u: F.coalesce(F.lower(u).rlike("^https?://[^/?#]+"), F.lit(False))
    return F.when(web(target), target).when(web(raw), raw).otherwise("")


def mentions(text: Column, aliases: Column) -> Column:
    """Whether the text holds one of the names, in identity form."""
    held = identity_text(text)
    return F.exists(aliases, lambda a: (identity_text(a) != "") & F.contains(held, identity_text(a)))


def target_aliases(label: Column, evidence: Column, known: Column) -> Column:
    """A target's names: its label, short evidence, and the reviewed names of its registry entry (array, may be null)."""
    short = F.when((F.trim(evidence) != "") & (F.length(F.trim(evidence)) <= 120), F.trim(evidence))
    return F.array_union(F.array_compact(F.array(label, short)), F.coalesce(known, F.array().cast("array<string>")))


def attributed_quote(title: Column, content: Column, label: Column) -> Column:
    """A quotation and a verb of saying near the label's first place in title and the content's first 1800 characters."""
    text = F.concat(title, F.lit("\n"), F.substring(content, 1, 1800))
    at = F.position(F.lower(label), F.lower(text))
    start = F.greatest(at - 80, F.lit(1))
    near = F.substring(text, start, at - start + F.length(label) + 160)
    return (at > 0) & near.rlike(QUOTED) & near.rlike(ATTRIBUTED)


def evidence_role(cosine: Column, direct: float = DIRECT) -> Column:
    """Direct evidence of the event, or context; without a centroid direct."""
    return F.when(cosine.isNull() | (cosine >= direct), "direct_event").otherwise("background_context")


def coerced_identity(source_type: Column, relationship: Column, entity: Column, region: Column, evidence: Column, confidence: Column) -> Column:
    """A verifier's answer in known values: unknown types reject, unknown relations are uncertain, a bad confidence is none."""
    known = lambda value, values, other: F.when(value.isin(*values), value).otherwise(other)
    text = lambda c, n: F.substring(F.trim(F.coalesce(c, F.lit(""))), 1, n)
    return F.struct(
        known(source_type, SOURCE_TYPES, "reject").alias("source_type"), known(relationship, RELATIONSHIPS, "uncertain").alias("relationship"), text(entity, 120).alias("publisher_entity"),
        F.lower(text(region, 2)).alias("publisher_region"), text(evidence, 300).alias("ownership_evidence"), confidence.try_cast("double").alias("confidence"))


def official_reason(identity: Column, url: Column, label: Column, region: Column, in_registry: Column, bound_account: Column) -> Column:
    """Why an official candidate is not the target's own voice; null if it is."""
    kind, web = identity["source_type"], identity["source_type"] == "official_web"
    same_name = identity_text(identity["publisher_entity"]) == identity_text(label)
    domain = F.element_at(F.split(_host(url), "\\."), -2)
    trusted = web & (F.coalesce(identity["confidence"], F.lit(0.0)) >= CONFIDENT) & governmental(url)
    elsewhere = (identity["publisher_region"] != "") & (identity["publisher_region"] != region)
    return (
        F.when((kind == "official_social") & bound_account, None)
        .when(~kind.isin("official_web", "official_social"), "not_official_source")
        .when(in_registry, None)
        .when((identity["relationship"] != "same_entity") | elsewhere, "publisher_target_mismatch")
        .when(trusted, None)
        .when(~same_name, "publisher_target_mismatch")
        .when(kind == "official_social", F.when(~bound_account, "publisher_binding_unverified"))
        .when(~governmental(url) & (identity_text(domain) != identity_text(label)), "publisher_binding_unverified")
    )


def voice_needs(rows: DataFrame, countries: DataFrame, limit: int = 3) -> DataFrame:
    """Of (cluster_id, pos, label, country, kind): named needs in recognised countries, each label once, the first `limit`.

    countries: code, name (a country's name is no voice).
    """
    clean = rows.select("cluster_id", "pos", F.substring(collapsed(F.col("label")), 1, 100).alias("label"), F.lower(F.trim("country")).alias("country"), F.lower(F.trim(F.coalesce("kind", F.lit("organization")))).alias("kind"))
    known = clean.join(F.broadcast(countries.select(F.col("code").alias("country")).distinct()), "country", "left_semi").where((F.col("label") != "") & (F.col("kind") != "country"))
    named = known.withColumn("folded", F.lower("label")).join(F.broadcast(countries.select(F.lower("name").alias("folded")).distinct()), "folded", "left_anti")
    once = named.withColumn("_r", F.row_number().over(Window.partitionBy("cluster_id", "folded").orderBy("pos"))).where("_r = 1")
    place = F.row_number().over(Window.partitionBy("cluster_id").orderBy("pos"))
    return once.withColumn("place", place).where(F.col("place") <= limit).select("cluster_id", "label", "country", "kind", "place")


def validated_targets(rows: DataFrame, event_text: str, countries: DataFrame) -> DataFrame:
    """Of targets (cluster_id, label, region, role, event_role, materiality, evidence, and the event's text): the required ones in material roles that the text names."""
    label, evidence = F.substring(collapsed(F.col("label")), 1, 100), F.substring(collapsed(F.col("evidence")), 1, 200)
    held = identity_text(F.col(event_text))
    named = F.contains(held, identity_text(label)) | ((evidence != "") & F.contains(held, identity_text(evidence)))
    role = F.when(F.lower("role").isin(*ACTOR_ROLES), F.lower("role")).otherwise("organization")
    ok = (label != "") & (F.lower(F.coalesce("role", F.lit(""))) != "country") & (F.lower("materiality") == "required") & F.lower("event_role").isin(*EVENT_ROLES) & ~label.rlike(NO_VOICE) & named
    met = rows.withColumn("region", F.lower(F.trim("region"))).join(F.broadcast(countries.select(F.col("code").alias("region")).distinct()), "region", "left_semi")
    return met.where(F.coalesce(ok, F.lit(False))).select("cluster_id", label.alias("label"), "region", role.alias("role"), F.when(evidence != "", evidence).otherwise(label).alias("evidence"))


def coverage(targets: DataFrame, articles: DataFrame) -> DataFrame:
    """Each target's (cluster_id, label, region, role) strongest coverage by its cluster's articles, and whether it is satisfied.

    articles: cluster_id, title, content, region, placeholder, official, searched, status, provider, configured.
    """
    met = targets.join(articles.where("NOT placeholder").withColumnRenamed("region", "article_region"), "cluster_id", "left")
    named = F.coalesce(mentions(F.concat_ws("\n", "title", F.substring("content", 1, 1200)), F.array("label")), F.lit(False))
    actor = F.col("role") != "country"
    own = (F.col("article_region") == F.col("region")) & ((~F.col("searched") & F.col("configured")) | (F.col("searched") & (F.col("status") == "accepted") & F.col("provider").endswith("_country")))
    kind = F.when(actor & F.col("official") & named, 1).when(actor & attributed_quote(F.col("title"), F.col("content"), F.col("label")), 2).when(F.coalesce(own, F.lit(False)), 3).when(actor & named, 4).otherwise(5)
    names = F.array(*[F.lit(x) for x in ("official_direct", "direct_quote", "verified_related_country_editorial", "secondary_only", "missing")])
    g = met.groupBy("cluster_id", "label", "region", "role").agg(F.min(kind).alias("k"))
    return g.select("cluster_id", "label", "region", "role", F.element_at(names, F.col("k")).alias("coverage"), F.when(F.col("role") == "country", F.col("k") == 3).otherwise(F.col("k") <= 3).alias("satisfied"))


def registry_reason(stage: Column, verdict: Column, bound_region: Column, names: Column, url: Column, label: Column, region: Column) -> Column:
    """Why a reviewed binding (verdict, region, names; null verdict: none) rules a candidate out; null if it doesn't, or leaves it to the verifier."""
    named = F.exists(F.coalesce(names, F.array().cast("array<string>")), lambda n: (identity_text(n) != "") & (identity_text(n) == identity_text(label)))
    elsewhere = (F.coalesce(bound_region, F.lit("")) != "") & (bound_region != region)
    official = F.when(verdict == "official_social", "publisher_binding_unverified").when(verdict != "official_web", "not_official_source").when(~named & ~governmental(url), "publisher_binding_unverified")
    country = F.when((verdict != "country_editorial") | (F.coalesce(bound_region, F.lit("")) == ""), "not_related_country_source")
    return F.when(verdict.isNull(), None).when(elsewhere, "not_related_country_source").when(stage == "official", official).otherwise(country)


def accept_results(candidates: DataFrame, group: list[str], order: list, most: int) -> DataFrame:
    """Decision and reason of each candidate of a target's search, in order, until `most` are accepted (later ones: unread).

    Columns: stage, role, region, label, url (canonical, empty if none), thin, existing and satisfies (the cluster has the URL;
    it serves the target), ladder (F06's reason), verdict, bound_region, names (the domain's binding), identity (as
    coerced_identity gives it), bound_account. Unverified publishers and new local ones wait for review.
    """
    c, official = F.col, F.col("stage") == "official"
    registry = registry_reason(c("stage"), c("verdict"), c("bound_region"), c("names"), c("url"), c("label"), c("region"))
    bound = c("verdict").isNotNull() & (~official | F.exists(F.coalesce("names", F.array().cast("array<string>")), lambda n: identity_text(n) == identity_text(c("label"))))
    said = F.when(official & c("bound_account"), "official_social").when(bound, c("verdict")).otherwise(c("identity.source_type"))
    identity = F.struct(said.alias("source_type"), c("identity.relationship").alias("relationship"), c("identity.publisher_entity").alias("publisher_entity"), F.when(bound, c("region")).otherwise(c("identity.publisher_region")).alias("publisher_region"), c("identity.confidence").alias("confidence"))
    voice = official_reason(identity, c("url"), c("label"), c("region"), bound, c("bound_account"))
    country = F.when(said != "country_editorial", "not_related_country_source").when((identity["publisher_region"] != "") & (identity["publisher_region"] != c("region")), "not_related_country_source").when(c("verdict").isNull(), "candidate_pending_review")
    reason = (
        F.when(c("url") == "", "invalid_result_url").when(c("thin") & ~official, "thin_result").when(c("existing"), F.when(c("satisfies"), "coverage_satisfied").otherwise("duplicate_of_existing"))
        .when(c("ladder").isNotNull(), c("ladder")).when(registry.isNotNull(), registry).when(official & (c("role") == "country"), "country_target_official_forbidden").otherwise(F.when(official, voice).otherwise(country))
    )
    judged = candidates.withColumn("reason", reason)
    before = F.coalesce(F.sum(c("reason").isNull().cast("int")).over(Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    decision = F.when(before >= most, "unread").when(c("reason").isNull(), "accepted").when(c("reason").isin("publisher_binding_unverified", "candidate_pending_review"), "pending_review").otherwise("rejected")
    return judged.withColumn("decision", decision)
