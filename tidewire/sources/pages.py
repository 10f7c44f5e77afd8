"""Scanning raw web pages with column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LISTING = "/(author|tag|topic|search|archive)s?(/|$)"


def links(pages: DataFrame, limit: int = 25) -> DataFrame:
    """Each page's distinct links in order, listing paths left out, at most `limit`."""
    hrefs = F.array_distinct(F.regexp_extract_all("html", F.lit('<a href="([^"#]+)"'), 1))
    kept = F.slice(F.filter(hrefs, lambda h: ~F.lower(h).rlike(LISTING)), 1, limit)
    return pages.select("page_id", F.posexplode(kept).alias("pos", "href"))


def visible_text(html: Column) -> Column:
    """Text without scripts, styles and tags, white space collapsed."""
    bare = F.regexp_replace(F.regexp_replace(html, "(?s)<(script|style)[^>]*>.*?</(script|style)>", " "), "(?s)<[^>]*>", " ")
    return F.trim(F.regexp_replace(bare, "\\s+", " "))


def js_rendered(html: Column, least: int = 500) -> Column:
    """Pages whose visible text is shorter than `least`."""
    return F.length(visible_text(html)) < least


def title(html: Column) -> Column:
    """The title element's text."""
    return F.trim(F.regexp_extract(html, "(?s)<title[^>]*>(.*?)</title>", 1))
