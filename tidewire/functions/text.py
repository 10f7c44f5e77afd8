"""Scalar text, URL and date functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = "[^\\p{L}\\p{N}_]"


def gram_text(text: Column) -> Column:
    """What n-grams are cut from: the lower-case text without non-word characters."""
    return F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), WORD, "")


def char_ngrams(text: Column, n: int = 3) -> Column:
    """Distinct character n-grams of the lower-case text without non-word characters; a text of at most n is its own only gram."""
    clean = gram_text(text)
    size = F.length(clean)
    grams = F.transform(F.sequence(F.lit(1), F.greatest(size - n + 1, F.lit(1))), lambda i: F.substring(clean, i, n))
    return F.when(size == 0, F.array().cast("array<string>")).when(size <= n, F.array(clean)).otherwise(F.array_distinct(grams))


def jaccard(a: Column, b: Column) -> Column:
    """Shared over all; 0 if either is empty."""
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b)))


def slug(text: Column, limit: int = 40) -> Column:
    """Lower-case ASCII words joined by hyphens."""
    return F.substring(F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), "^-+|-+$", ""), 1, limit)


def headline(markdown: Column) -> Column:
    """The first line-leading bold text."""
    return F.regexp_extract(markdown, "(?m)^\\s*\\*\\*(.+?)\\*\\*", 1)


def preview(text: Column, limit: int = 120) -> Column:
    """White space collapsed; cut with an ellipsis beyond the limit."""
    flat = F.trim(F.regexp_replace(text, "\\s+", " "))
    return F.when(F.length(flat) <= limit, flat).otherwise(F.concat(F.rtrim(F.substring(flat, 1, limit - 1)), F.lit("…")))


def is_placeholder(url: Column, flag: Column | None = None) -> Column:
    """flagged, or a placeholder: URL."""
    synthetic = F.lower(F.trim(F.coalesce(url, F.lit("")))).startswith("placeholder:")
    return synthetic if flag is None else F.coalesce(flag, F.lit(False)) | synthetic


def is_real(url: Column, flag: Column | None = None) -> Column:
    """not a placeholder, and an http(s) URL with a host."""
    return ~is_placeholder(url, flag) & F.coalesce(F.lower(F.trim(url)).rlike("^https?://[^/?#]+"), F.lit(False))


def host(url: Column) -> Column:
    """Lower-case host without www."""
    return F.regexp_replace(F.lower(F.regexp_extract(url, "^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]*)", 1)), "^www\\.", "")


def unwrapped(url: Column) -> Column:
    """The target of a redirecting ?url= link, or the URL itself."""
    target = F.try_url_decode(F.regexp_extract(url, "[?&](?:url|u)=([^&#]+)", 1))
    return F.when(target.rlike("^https?://"), target).otherwise(url)


def generic_or_stale(url: Column, title: Column, stale: str = "2025") -> Column:
    """generic_page for listing paths and titles, else stale_or_historical for the marker year, else null."""
    path = F.lower(F.regexp_extract(url, "^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1))
    listing = path.rlike("/(authors?|compan(y|ies)|topics?|tags?|search|archives?|word)(/|$)") | F.lower(title).rlike("latest news|最新ニュース|最新消息|\\| *reuters *$")
    return F.when(listing, "generic_page").when(F.contains(F.concat(url, title), F.lit(stale)), "stale_or_historical")


def looks_chinese(text: Column, least: int = 4, share: float = 0.08) -> Column:
    """at least `least` CJK characters, and their share of CJK and latin letters."""
    cjk = F.regexp_count(text, F.lit("[\\x{4e00}-\\x{9fff}]"))
    latin = F.regexp_count(text, F.lit("[A-Za-z]"))
    return (cjk >= least) & (cjk / F.greatest(cjk + latin, F.lit(1)) >= share)


def embedding_text(title: Column, content: Column) -> Column:
    """Title and content, or the title alone for mojibake and for short content without a sentence end."""
    sample = F.substring(F.coalesce(content, F.lit("")), 1, 200)
    mojibake = F.regexp_count(sample, F.lit("[\\x{80}-\\x{FF}]")) > F.length(sample) * 0.25
    bare = (F.length(content) < 120) & ~content.rlike("[。？！.?!\\n]")
    usable = F.coalesce(content, F.lit("")) != ""
    return F.when(usable & ~mojibake & ~bare, F.trim(F.concat(title, F.lit(" "), F.substring(content, 1, 500)))).otherwise(title)


def numeric_claims(text: Column) -> Column:
    """Numbers with their percent sign, thousands separators dropped, distinct in order."""
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit("([0-9][0-9,]*(?:\\.[0-9]+)?%?)"), 1), lambda x: F.replace(x, F.lit(","), F.lit(""))))


def unsupported_claims(claims: Column, evidence: Column, tolerance: float = 0.08) -> Column:
    """Claims that no evidence number is within `tolerance` of."""
    number = lambda x: F.regexp_replace(x, "%$", "").try_cast("double")
    near = lambda c: F.exists(evidence, lambda e: (e.endswith("%") == c.endswith("%")) & (F.abs(number(e) - number(c)) <= tolerance * F.abs(number(c))))
    return F.filter(claims, lambda c: ~near(c))


# Month names in URLs.
MONTHS = "jan feb mar apr may jun jul aug sep oct nov dec".split()
MONTH_NAMES = "january february march april may june july august september october november december".split()


def url_date(url: Column) -> Column:
    """The date that a URL's path names: a day, else the first day of a quarter, a named month, a month, or a year; null for none."""
    path = F.coalesce(F.try_url_decode(F.regexp_extract(url, "^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)), F.lit(""))
    part = lambda pattern, k: F.nullif(F.regexp_extract(path, pattern, k), F.lit(""))
    day_of = lambda y, m, d: F.try_to_date(F.concat(y, F.lit("-"), F.lpad(m, 2, "0"), F.lit("-"), F.lpad(d, 2, "0")), "yyyy-MM-dd")
    year, one = "(?<![0-9])((?:19|20)[0-9]{2})", F.lit("1")
    spaced, compact = year + "[-/_](0?[1-9]|1[0-2])[-/_](0?[1-9]|[12][0-9]|3[01])(?![0-9])", year + "(0[1-9]|1[0-2])(0[1-9]|[12][0-9]|3[01])(?![0-9])"
    before, after = year + "[_-]([1-4])[Qq](?![0-9])", year + "[_-]?[Qq]([1-4])(?![0-9])"
    named, month, bare = year + "[/_-]([A-Za-z]{3,9})(?=$|[/_.-])", year + "[/_-](0?[1-9]|1[0-2])(?=$|[/_.-])", "(?:^|/)((?:19|20)[0-9]{2})(?:/|$)"
    known = F.create_map(*[F.lit(x) for k in range(12) for n in dict.fromkeys((MONTHS[k], MONTH_NAMES[k])) for x in (n, str(k + 1))])
    quarter = lambda p: day_of(part(p, 1), ((part(p, 2).cast("int") - 1) * 3 + 1).cast("string"), one)
    exact = F.when(part(spaced, 1).isNotNull(), day_of(*[part(spaced, k) for k in (1, 2, 3)])).otherwise(day_of(*[part(compact, k) for k in (1, 2, 3)]))
    return (
        F.when(part(spaced, 1).isNotNull() | part(compact, 1).isNotNull(), exact).when(part(before, 1).isNotNull(), quarter(before)).when(part(after, 1).isNotNull(), quarter(after))
        .otherwise(F.coalesce(day_of(part(named, 1), F.try_element_at(known, F.lower(part(named, 2))), one), day_of(part(month, 1), part(month, 2), one), day_of(part(bare, 1), one, one)))
    )


def epoch(value: Column) -> Column:
    """Seconds or milliseconds since 1970 as a timestamp."""
    return F.timestamp_millis(F.when(value > 10_000_000_000, value).otherwise(value * 1000).cast("bigint"))


def day_gap(later: Column, earlier: Column) -> Column:
    """Days between, not negative; 9999 if unknown."""
    return F.coalesce(F.greatest(F.datediff(later, earlier), F.lit(0)), F.lit(9999))


def recency_bonus(days: Column) -> Column:
    """Up to 0.08, falling to 0 in five days."""
    return F.greatest(F.lit(0.0), (5 - days) / 5) * 0.08


def key_of(parts: Column, length: int = 16) -> Column:
    """Leading hex digits of the SHA-1 of the parts joined by bars."""
    return F.substring(F.sha1(F.array_join(parts, "|").cast("binary")), 1, length)
