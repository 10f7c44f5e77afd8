"""Locale, category and chart functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Display categories with their Chinese labels, and older names of them.
CATEGORIES = {"World": "国际", "Business": "商业", "Technology": "科技", "Science & Health": "科学健康", "Society": "社会", "Culture & Sports": "文化体育"}
OLDER = {"国际时政": "World", "商业财经": "Business", "科技创新": "Technology", "科学健康": "Science & Health", "社会民生": "Society", "文化艺术": "Culture & Sports", "体育运动": "Culture & Sports"}

_LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_INDICATORS = "".join(chr(0x1F1E6 + k) for k in range(26))


def flag(code: Column) -> Column:
    """The flag of a two-letter country code: its letters as regional indicators; empty for anything else."""
    upper = F.upper(F.trim(F.coalesce(code, F.lit(""))))
    return F.when(upper.rlike("^[A-Z]{2}$"), F.translate(upper, _LETTERS, _INDICATORS)).otherwise("")


def category(value: Column) -> Column:
    """A display category, from its own or an older name; World for anything else."""
    name = F.trim(F.coalesce(value, F.lit("")))
    known = F.create_map(*[F.lit(x) for k, v in OLDER.items() for x in (k, v)])
    return F.when(name.isin(*CATEGORIES), name).otherwise(F.coalesce(F.try_element_at(known, name), F.lit("World")))


def category_label(value: Column) -> Column:
    """The category's Chinese label."""
    return F.element_at(F.create_map(*[F.lit(x) for k, v in CATEGORIES.items() for x in (k, v)]), category(value))


def broad_category(topic: Column, display: Column) -> Column:
    """The display category if it is one, else the topic's."""
    names = [*CATEGORIES, *OLDER]
    return F.when(F.trim(display).isin(*names), category(display)).otherwise(category(topic))


def sparkline(values: Column, width: int = 160, height: int = 32) -> Column:
    """Points of a line chart through an array of numbers, nulls left out: 'x,y' with one decimal; empty below two."""
    points = F.filter(values, lambda v: v.isNotNull())
    low, span = F.array_min(points), F.array_max(points) - F.array_min(points)
    span = F.when(span == 0, F.lit(1.0)).otherwise(span)
    step = F.lit(float(width)) / (F.size(points) - 1)
    drawn = F.transform(points, lambda v, i: F.format_string("%.1f,%.1f", i * step, F.lit(float(height)) - (v - low) / span * (height - 4) - 2))
    return F.when(F.size(points) < 2, "").otherwise(F.array_join(drawn, " "))
