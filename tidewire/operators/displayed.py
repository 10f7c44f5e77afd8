"""What a report shows: duplicates among its summaries, merged into the ones that are preferred."""

from __future__ import annotations

import heapq
import re
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewire.operators.perspectives import canonical

# Cosines from which two summaries are one event, in all and inside a family, and the sources that these share.
SAME_EVENT = 0.73
SAME_IN_FAMILY = 0.90
SHARED_SOURCES = 2
BY_URL = 0.95

#: Summaries of small reports that share a call; a larger report has one of its own.
SHARED_ROWS = 1024


@dataclass
class Card:
    """A summary as it is displayed, with what merges bring to it."""

    id: int
    composite: float = 0.0
    new: bool = False
    family: str | None = None
    positive: bool = False
    articles: list[tuple[str, str]] = field(default_factory=list)
    sources: list[str] = field(default_factory=list)
    groups: list[tuple[list[str], str]] = field(default_factory=list)
    action: str = "kept"
    reason: str = ""
    confidence: float = 0.0
    into: int | None = None

    def urls(self) -> set[str]:
        return {u for u, _ in self.articles}

    def rank(self) -> tuple:
        return self.composite, len(self.groups), len(self.sources), self.new

    def take(self, other: Card, reason: str, confidence: float) -> None:
        """The other's articles by URL, their sources, and its views by their text, made canonical; D27's rule has the last word."""
        have = self.urls()
        for url, source in other.articles:
            if url not in have:
                have.add(url)
                self.articles.append((url, source))
                if source not in self.sources:
                    self.sources.append(source)
        own = {plain(view): sources for sources, view in self.groups if plain(view)}
        for sources, view in other.groups:
            if not plain(view):
                continue
            if plain(view) in own:
                own[plain(view)].extend(s for s in sources if s not in own[plain(view)])
            else:
                self.groups.append((list(sources), view))
                own[plain(view)] = self.groups[-1][0]
        self.groups = canonical(self.groups)
        self.action, other.action, other.into = "merged", "suppressed", self.id
        self.reason = other.reason = reason
        self.confidence = other.confidence = round(confidence, 4)


def plain(view: str) -> str:
    return re.sub(r"\s+", " ", view or "").strip()


def resolve(cards: list[Card], centroids: list[np.ndarray | None], least: float = SAME_EVENT) -> list[Card]:
    """In order, each card that is still shown meets the later ones that duplicate it: by a shared URL, or close centroids.

    Of two, a positive one stays, else the one of higher rank (the earlier of equals); it takes over what the other has.
    Inside a family only shared URLs and very close events with shared sources count. Cards that may meet are found by
    their URLs and one product per card; no pairs are made.
    """
    width = max((len(c) for c in centroids if c is not None), default=0)
    at = np.array([c if c is not None and len(c) == width else np.zeros(width) for c in centroids]).reshape(len(cards), width)
    has = np.array([c is not None and len(c) == width and width > 0 for c in centroids], bool)
    holders: dict[str, list[int]] = {}
    for i, card in enumerate(cards):
        for u in card.urls():
            holders.setdefault(u, []).append(i)
    for i, left in enumerate(cards):
        if left.action == "suppressed":
            continue
        near = at @ at[i] if has[i] else np.zeros(len(cards))
        heap = np.flatnonzero(has & (near >= least) & (np.arange(len(cards)) > i)).tolist() if has[i] else []
        seen_urls: set[str] = set()

        def seek(after: int, left=left, heap=heap, seen_urls=seen_urls) -> None:
            for u in left.urls() - seen_urls:
                seen_urls.add(u)
                for k in holders[u]:
                    if k > after:
                        heapq.heappush(heap, k)

        heapq.heapify(heap)
        seek(i)
        last = i
        while heap:
            j = heapq.heappop(heap)
            right = cards[j]
            if j == last or right.action == "suppressed":
                continue
            last = j
            by_url = bool(left.urls() & right.urls())
            confidence = BY_URL if by_url else float(near[j])
            if not by_url and not (has[i] and has[j] and confidence >= least):
                continue
            if left.family and left.family == right.family and not by_url:
                if confidence < SAME_IN_FAMILY or len(set(left.sources) & set(right.sources)) < SHARED_SOURCES:
                    continue
            ahead = left.positive if left.positive != right.positive else left.rank() >= right.rank()
            kept, lost = (left, right) if ahead else (right, left)
            kept.take(lost, "shared_article_url" if by_url else "embedding_similarity", confidence)
            if not ahead:
                for u in left.urls():
                    if j not in holders[u]:
                        holders[u].append(j)
                break
            seek(j)
    return cards


RESULT = "report {report}, id bigint, action string, reason string, confidence double, into bigint, urls array<string>, sources array<string>, groups array<struct<sources:array<string>,perspective:string>>"


def resolve_displayed(rows: DataFrame, least: float = SAME_EVENT) -> DataFrame:
    """D23/D25 per report (which shows some hundred summaries at most): every summary with its action, reason, confidence, what it went into, and what it shows now.

    rows: report, place, id, composite, new, family, positive, articles array<struct<url,source>>, sources, groups
    array<struct<sources,perspective>>, centroid (a unit vector or null).
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.concat([one(own) for _, own in pdf.groupby("report", sort=False)], ignore_index=True)

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["place", "id"])
        cards = [
            Card(int(r.id), 0.0 if pd.isna(r.composite) else float(r.composite), bool(r.new), r.family, bool(r.positive), [(a["url"], a["source"]) for a in _list(r.articles)], list(_list(r.sources)), [(list(_list(g["sources"])), g["perspective"]) for g in _list(r.groups)])
            for r in pdf.itertuples()
        ]
        resolve(cards, [None if v is None else np.asarray(v, float) for v in pdf["centroid"]], least)
        shown = [[{"sources": s, "perspective": t} for s, t in c.groups] for c in cards]
        return pd.DataFrame({
            "report": pdf["report"].to_numpy(), "id": [c.id for c in cards], "action": [c.action for c in cards], "reason": [c.reason for c in cards], "confidence": [c.confidence for c in cards],
            "into": pd.array([c.into for c in cards], "Int64"), "urls": [[u for u, _ in c.articles] for c in cards], "sources": [c.sources for c in cards], "groups": shown,
        })

    return rows.groupBy(F.pmod(F.xxhash64("report"), F.lit(heaps(rows))).alias("heap")).applyInPandas(run, RESULT.format(report=rows.schema["report"].dataType.simpleString()))


def heaps(rows: DataFrame) -> int:
    """In how many calls the reports are resolved: by their summaries, so that many or large reports don't come together."""
    return max(1, rows.count() // SHARED_ROWS)


def _list(value) -> list:
    return [] if value is None else value
