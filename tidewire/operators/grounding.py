"""The publication contract and the grounding of numbers in evidence, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Number forms with their scales, currencies and units, and what malformed numeric text looks like.
SCALES = {"千": 1e3, "천": 1e3, "万": 1e4, "만": 1e4, "亿": 1e8, "억": 1e8, "兆": 1e12, "조": 1e12}
MONEY_SCALES = {"trillion": 1e12, "billion": 1e9, "million": 1e6, "thousand": 1e3, "bn": 1e9, "mn": 1e6, "万亿": 1e12, "亿": 1e8, "万": 1e4}
CURRENCIES = {
    "$": "USD", "€": "EUR", "£": "GBP", "¥": "CNY", "￥": "CNY", "usd": "USD", "dollar": "USD", "dollars": "USD", "美元": "USD", "美金": "USD", "eur": "EUR", "euro": "EUR", "euros": "EUR", "欧元": "EUR",
    "cny": "CNY", "rmb": "CNY", "yuan": "CNY", "人民币": "CNY", "元": "CNY", "gbp": "GBP", "pound": "GBP", "pounds": "GBP", "英镑": "GBP",
}
TOLERANCE = 0.08
_NUMBER = "[0-9][0-9,]*(?:\\.[0-9]+)?"
_SCALED = f"({_NUMBER})(千|천|万|만|亿|억|兆|조)({_NUMBER})?"
_MONEY = f"([$€£¥￥])?\\s*({_NUMBER})\\s*(trillion|billion|million|thousand|bn|mn|万亿|亿|万)?\\s*(usd|dollars?|eur|euros?|cny|rmb|yuan|gbp|pounds?|美元|美金|欧元|人民币|英镑|元)?"
_UNITS = "%|％|万亿美元|亿美元|亿元|万元|美元|欧元|人民币|票|项|例|病例|人|名|家|国|枚|架|艘|倍|岁|年|月|日|건|명|dead|deaths?|people|cases|injured?"
_FRAGMENT = f"\\s*(?:[$€£¥￥]\\s*)?[0-9][0-9,]*(?:\\.[0-9]+)?(?:\\s*(?:千|천|万|만|亿|억|兆|조)(?:\\s*[0-9][0-9,]*)?)?(?:\\s*(?:{_UNITS}))?\\s*[.,。!?！？]"
PLACEHOLDER = "(?i)有关数字|\\bcertain\\s+number\\b"
LEADING = f"(?i)^{_FRAGMENT}"
ORPHAN = f"(?i)^{_FRAGMENT}\\s*$"
REMNANT = "(?i)(?:超|超过|约|近|达|至少|至多|致|导致|造成)\\s*(?:例|病例|人|名|死亡|受伤|%|％|[，,。.!！？?])|\\b(?:kills?|killed|dead|deaths?|injured?)\\s*[,.;:]"
#: A claim: a number with sign, a range, scale and unit; and what stands near a single digit that is one.
CLAIM = f"((?:[$€£¥￥]\\s*)?{_NUMBER}(?:\\s*[-–—:比]\\s*{_NUMBER})?(?:\\s*(?:千|천|万|만|亿|억|兆|조)(?:\\s*{_NUMBER})?)?(?:\\s*(?:%|％|万亿美元|亿美元|亿元|万元|美元|欧元|人民币|票|项|例|病例|人|名|家|国|枚|架|艘|倍|岁|年|月|日|건|명))?)"
CONTEXT = "(?iU)[$€£¥￥%％]|万亿美元|亿美元|亿元|万元|美元|欧元|人民币|票|项|例|病例|人|名|家|国|枚|架|艘|倍|岁|年|月|日|건|명|死亡|死者|遇难|伤亡|受伤|伤者|确诊|病例|\\b(?:dead|death(?:s)?|died|kill(?:ed|s)?|casualt(?:y|ies)|injur(?:ed|y|ies)|people|persons|cases|patients|votes?|years?|months?|days?|percent|points?|items?|ships?|aircraft)\\b"
CORRUPTED = ("有关数字|certain number", "^\\s*[\\d,]+(?:\\.\\d+)?\\s*(?:[%％]|万人|万|人|死者|dead|injured)?\\s*[。.!?]?$")
BEFORE, BEHIND = 12, 24
BLOCKED = ("needs_review", "seek_more_evidence", "suppress")


def number(text: Column) -> Column:
    return F.replace(text, F.lit(","), F.lit("")).try_cast("double")


def _map(values: dict) -> Column:
    return F.create_map(*[F.lit(x) for item in values.items() for x in item])


def numeric_values(text: Column) -> Column:
    """Numbers of a text; 3千500 is 3500 and 2万 is 20000."""
    text = F.coalesce(text, F.lit(""))
    part = lambda m, k: F.regexp_extract(m, _SCALED, k)
    scaled = F.transform(F.regexp_extract_all(text, F.lit(f"({_SCALED})"), 1), lambda m: number(part(m, 1)) * F.element_at(_map(SCALES), part(m, 2)) + F.coalesce(number(F.nullif(part(m, 3), F.lit(""))), F.lit(0.0)))
    plain = F.transform(F.regexp_extract_all(F.regexp_replace(text, _SCALED, " "), F.lit(f"(?:^|[^0-9A-Za-z_])({_NUMBER})"), 1), number)
    return F.concat(scaled, plain)


def money_amounts(text: Column) -> Column:
    """(value, currency) of amounts with a currency sign or word, scale words applied."""
    part = lambda m, k: F.lower(F.regexp_extract(m, f"(?i){_MONEY}", k))
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(f"(?i)({_MONEY})"), 1)
    currency = lambda m: F.coalesce(F.try_element_at(_map(CURRENCIES), part(m, 1)), F.try_element_at(_map(CURRENCIES), part(m, 4)))
    amounts = F.transform(found, lambda m: F.struct((number(part(m, 2)) * F.coalesce(F.try_element_at(_map(MONEY_SCALES), part(m, 3)), F.lit(1.0))).alias("value"), currency(m).alias("currency")))
    return F.filter(amounts, lambda a: a["currency"].isNotNull())


def grounded(claim: Column, evidence: Column, evidence_money: Column | None = None) -> Column:
    """Whether the evidence holds a claim's number or its digits (two at least), or an amount in its currency within the tolerance."""
    values = numeric_values(evidence)
    same = F.exists(numeric_values(claim), lambda c: F.exists(values, lambda e: F.abs(c - e) <= F.greatest(F.lit(1e-9), F.abs(c) * 1e-9)))
    money = money_amounts(evidence) if evidence_money is None else evidence_money
    close = lambda x, y: F.abs(x - y) / F.greatest(F.abs(x), F.abs(y), F.lit(1e-12)) <= TOLERANCE
    near = F.exists(money_amounts(claim), lambda c: F.exists(money, lambda e: (c["currency"] == e["currency"]) & close(c["value"], e["value"])))
    digits = F.regexp_replace(claim, "[^0-9]", "")
    bare = (F.length(digits) >= 2) & F.rlike(F.coalesce(evidence, F.lit("")), F.concat(F.lit("(^|[^0-9])"), digits, F.lit("([^0-9]|$)")))
    return same | near | bare


def matches(text: Column, pattern: str) -> Column:
    """(start, value) of each match of a pattern whose matches begin with the first digit or sign that is left: start from 1, value as it stands.

    The pattern is one group. A match is where its text next occurs behind the one before, as an earlier occurrence would
    have been matched itself.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), 1)
    start = F.struct(F.lit(1).alias("from"), F.array().cast("array<struct<start:int,value:string>>").alias("out"))

    def placed(seen: Column, value: Column) -> Column:
        at = F.call_function("locate", value, text, seen["from"])
        return F.struct((at + F.length(value)).cast("int").alias("from"), F.array_append(seen["out"], F.struct(at.cast("int").alias("start"), value.alias("value"))).alias("out"))

    return F.aggregate(found, start, placed)["out"]


def claims(text: Column) -> Column:
    """Numeric claims, each once: numbers of two digits, ranges, and single digits with a unit or with a word of counting near them.

    Near is what stands up to 12 characters before and 24 behind.
    """
    text = F.coalesce(text, F.lit(""))

    def counts(m: Column) -> Column:
        first = F.greatest(m["start"] - BEFORE, F.lit(1))
        window = F.substring(text, first, m["start"] - first + F.length(m["value"]) + BEHIND)
        several = F.length(F.regexp_replace(m["value"], "[^0-9]", "")) >= 2
        return several | m["value"].rlike("[-–—:比]") | window.rlike(CONTEXT)

    return F.array_distinct(F.transform(F.filter(matches(text, CLAIM), counts), lambda m: F.trim(m["value"])))


def unsupported(text: Column, evidence: Column) -> Column:
    """Claims of a text that the evidence does not ground."""
    return F.filter(claims(text), lambda c: ~F.contains(F.regexp_replace(evidence, "[, ]", ""), F.regexp_replace(c, "[, ]", "")) & ~grounded(c, evidence))


def sentences(text: Column) -> Column:
    marked = F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), "([。！？])\\s*", "$1\u0001"), "([.!?])(?:\\s+|$)", "$1\u0001")
    return F.filter(F.transform(F.split(marked, "\u0001"), lambda s: F.trim(s)), lambda s: s != "")


def without(text: Column, dropped: Column) -> Column:
    """The text's sentences that hold none of the dropped claims."""
    return F.array_join(F.filter(sentences(text), lambda s: ~F.exists(dropped, lambda c: F.contains(s, c))), " ")


def once(value: Column, use) -> Column:
    """use(value) with the value computed once for each row, however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def text_issues(text: Column) -> Column:
    """codes of what is wrong with a summary's text; its first line may be a bold headline."""

    def of_body(x: Column) -> Column:
        text, body = x["text"], x["body"]
        #: Fragments have a digit; sentences are cut only where there is one.
        digit = F.translate(body, "0123456789", "") != body
        orphan = digit & F.exists(sentences(body), lambda s: s.rlike(ORPHAN))
        return F.array_compact(F.array(
            F.when(F.length(F.regexp_replace(body, "\\s+", "")) < 20, "summary_body_too_short"), F.when(text.rlike(PLACEHOLDER), "numeric_placeholder"), F.when(digit & body.rlike(LEADING), "leading_numeric_fragment"),
            F.when(orphan, "orphan_numeric_fragment"), F.when(body.rlike("^\\s*[，,、。.!！？?]"), "malformed_sentence_start"), F.when(text.rlike(REMNANT), "malformed_numeric_remnant"),
        ))

    def issues(text: Column) -> Column:
        body = F.trim(F.regexp_replace(text, "^\\s*\\*\\*.+?\\*\\*[^\\n]*(\\n|$)", ""))
        several = once(F.struct(text.alias("text"), body.alias("body")), of_body)
        return F.when(text == "", F.array().cast("array<string>")).when(F.trim(text) == "", F.array(F.lit("empty_summary"))).otherwise(several)

    return once(F.coalesce(text, F.lit("")), issues)


def article_issues(articles: Column) -> Column:
    """codes of a summary's articles, of (url, is_placeholder, is_searched, status, reason, freshness)."""
    real = lambda a: ~F.coalesce(a["is_placeholder"], F.lit(False)) & F.coalesce(F.lower(F.trim(a["url"])).rlike("^https?://[^/?#]+"), F.lit(False))
    mismatch = lambda a: F.lower(a["url"]).startswith("placeholder:") & ~F.coalesce(a["is_placeholder"], F.lit(False))
    unverified = lambda a: a["is_searched"] & (a["status"] == "accepted") & (F.coalesce(a["freshness"], F.lit("")) == "") & ~F.coalesce(a["reason"] == "current_event_perspective", F.lit(False))
    of = lambda rows, test, code: F.transform(F.filter(rows, lambda a: F.coalesce(test(a), F.lit(False))), lambda a: F.lit(code))
    none = lambda rows: F.when(F.exists(rows, real), F.array().cast("array<string>")).otherwise(F.array(F.lit("no_real_articles")))
    return once(articles, lambda rows: F.concat(of(rows, mismatch, "placeholder_url_mismatch"), of(rows, unverified, "search_evidence_unverified"), none(rows)))


def publication_issues(articles: Column, status: Column, flags: Column, summary: Column, summary_en: Column, approved: Column) -> Column:
    """all codes that keep a summary from publication; approval lifts status and numeric flags only."""
    review = F.array_compact(F.array(F.when(~F.coalesce(status == "publishable", F.lit(False)), "quality_status_not_publishable"), F.when(F.array_contains(flags, "unsupported_numeric_claim"), "unsupported_numeric_claim")))
    return F.concat(article_issues(articles), F.when(approved, F.array().cast("array<string>")).otherwise(review), text_issues(summary), text_issues(summary_en))


def publication_rejection(issues: Column, flags: Column, status: Column, summary: Column, summary_en: Column) -> Column:
    """why a summary is not published: its issues, else a blocked status, else visibly corrupted text with the pattern that it shows; null publishes."""
    free = ~F.array_contains(flags, "human_approved")
    corrupted = F.coalesce(*[F.when(F.coalesce(t, F.lit("")).rlike(f"(?i){p}"), F.lit(f"malformed_summary={p}")) for t in (summary, summary_en) for p in CORRUPTED])
    return (
        F.when(F.size(issues) > 0, F.array_join(issues, ";")).when(free & status.isin(*BLOCKED), F.concat(F.lit("quality_status="), status))
        .when(free & F.array_contains(flags, "unsupported_numeric_claim"), "unsupported_numeric_claim").otherwise(corrupted)
    )


def enforced(summary: Column, rewritten: Column, evidence: Column) -> Column:
    """The summary if its numbers are grounded, else a grounded rewrite, else without the sentences that are not; with status change, flags and contested claims."""
    bad = unsupported(summary, evidence)
    safe = lambda t: ~F.exists(text_issues(t), lambda c: c.isin("numeric_placeholder", "leading_numeric_fragment", "orphan_numeric_fragment", "malformed_numeric_remnant"))
    violates = ~safe(summary)
    fine = (F.size(bad) == 0) & ~violates
    good = rewritten.isNotNull() & (F.size(bad) > 0) & (F.size(unsupported(rewritten, evidence)) == 0) & safe(rewritten)
    flags = F.array_compact(F.array(F.when(F.size(bad) > 0, "unsupported_numeric_claim"), F.when(violates, "numeric_safety_failed")))
    none = F.array().cast("array<string>")
    made = lambda text, review, flag, contested: F.struct(text.alias("summary"), F.lit(review).alias("needs_review"), flag.alias("flags"), contested.alias("contested"))
    return F.when(fine, made(summary, False, none, none)).when(good, made(rewritten, False, F.array(F.lit("numeric_grounding_rewritten")), none)).otherwise(made(without(summary, bad), True, flags, bad))
