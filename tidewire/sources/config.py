"""Configuration files: sources, keyword lists, and reviewed bindings merged over configured ones."""

from __future__ import annotations

import json
import os

from pyspark.sql import DataFrame, SparkSession

try:
    import yaml
except ImportError:  # JSON files, which YAML includes, can still be read
    yaml = None

# A source's fields and what they are where a file says nothing.
SOURCE_FIELDS = {"name": None, "name_en": None, "url": None, "rss_url": None, "type": "rss", "weight": 1.0, "language": "zh", "region": "cn", "tier": "tech", "rsshub_url": None, "rss_fallback": None, "newsnow_id": None, "ownership": "state_influenced_review"}
SOURCE_SCHEMA = ", ".join(f"{f} {'double' if f == 'weight' else 'string'}" for f in SOURCE_FIELDS)
BINDINGS = ("source_verdicts", "official_account_bindings")


def read(path: str, default=None):
    """A YAML or JSON file; the default where it is missing or empty."""
    if not os.path.exists(path):
        return default
    with open(path, encoding="utf-8") as f:
        text = f.read()
    return (yaml.safe_load(text) if yaml is not None else json.loads(text or "null")) or default


def keywords(text: str) -> dict[str, list[str]]:
    """Lines under '# category' headers; a blank line ends a category, lines outside one are left out."""
    out: dict[str, list[str]] = {}
    current = None
    for line in map(str.strip, text.splitlines()):
        if not line:
            current = None
        elif line.startswith("#"):
            current = out[line.lstrip("#").strip()] = []
        elif current is not None:
            current.append(line)
    return out


def merged_bindings(configured: dict, reviewed: dict) -> dict:
    """Bindings by kind, reviewed ones over configured ones."""
    return {kind: {**(configured.get(kind) or {}), **(reviewed.get(kind) or {})} for kind in BINDINGS}


def sources(spark: SparkSession, config: dict) -> DataFrame:
    """The enabled sources of a configuration; a name, an English name and a URL are required."""
    rows = []
    for s in config.get("sources") or []:
        if not s.get("enabled", True):
            continue
        for field in ("name", "name_en", "url"):
            if field not in s:
                raise KeyError(field)
        rows.append(tuple(float(s.get(f, d)) if f == "weight" else s.get(f, d) for f, d in SOURCE_FIELDS.items()))
    return spark.createDataFrame(rows, SOURCE_SCHEMA)


def bindings(spark: SparkSession, merged: dict) -> DataFrame:
    """The merged domain bindings as a table: domain, verdict, region, entity."""
    rows = [(domain, b.get("verdict"), b.get("region"), b.get("entity")) for domain, b in sorted(merged["source_verdicts"].items())]
    return spark.createDataFrame(rows, "domain string, verdict string, region string, entity string")
