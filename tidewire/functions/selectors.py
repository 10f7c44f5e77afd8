"""Links of a page by the elements that they stand in: a small matcher of tag, class, id and attribute rules."""

from __future__ import annotations

import re
from functools import lru_cache
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Elements without content.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_PART = re.compile(r"""\*|(?P<tag>[A-Za-z][\w-]*)|\.(?P<cls>[\w-]+)|\#(?P<id>[\w-]+)|\[\s*(?P<attr>[\w:-]+)\s*(?:(?P<op>[*^$~|]?=)\s*(?:"(?P<dq>[^"]*)"|'(?P<sq>[^']*)'|(?P<bare>[^\]\s]+))\s*)?\]""", re.X)


@lru_cache(maxsize=1024)
def compiled(selector: str) -> tuple:
    """Alternatives of a selector, each a tuple of (combinator, tests) from the element itself outwards; the combinator is how an outer one is reached."""
    out = []
    for alternative in re.split(r",(?![^\[]*\])", selector):
        steps, combinator = [], " "
        for token in re.findall(r"\s*>\s*|(?:\[[^\]]*\]|[^\s>\[])+", alternative.strip()):
            if token.strip() == ">":
                combinator = ">"
                continue
            tests, at = [], 0
            while at < len(token):
                m = _PART.match(token, at)
                if m is None:
                    raise ValueError(f"selector {selector!r} is not understood at {token[at:]!r}")
                value = next((m[g] for g in ("dq", "sq", "bare") if m[g] is not None), "")
                tests += [("tag", "", m["tag"].lower())] if m["tag"] else [("class", "~=", m["cls"])] if m["cls"] else [("id", "=", m["id"])] if m["id"] else [(m["attr"].lower(), m["op"] or "", value)] if m["attr"] else []
                at = m.end()
            steps.append((combinator, tuple(tests)))
            combinator = " "
        if steps:
            out.append(tuple(reversed(steps)))
    return tuple(out)


def holds(test: tuple[str, str, str], element: tuple[str, dict]) -> bool:
    name, op, value = test
    if name == "tag":
        return element[0] == value
    own = element[1].get(name)
    if own is None:
        return False
    return {"": True, "=": own == value, "*=": value != "" and value in own, "^=": value != "" and own.startswith(value), "$=": value != "" and own.endswith(value), "~=": value in own.split(), "|=": own == value or own.startswith(value + "-")}[op]


def matches(steps: tuple, stack: list[tuple[str, dict]]) -> bool:
    """Whether the innermost element of the stack matches, outer steps being looked for outwards."""
    combinator, tests = steps[0]
    if not stack or not all(holds(t, stack[-1]) for t in tests):
        return False
    if len(steps) == 1:
        return True
    reach = range(len(stack) - 1, len(stack) - 2, -1) if combinator == ">" else range(len(stack) - 1, 0, -1)
    return any(matches(steps[1:], stack[:k]) for k in reach if k > 0)


class _Links(HTMLParser):
    def __init__(self, rules: tuple):
        super().__init__(convert_charrefs=True)
        self.rules, self.stack, self.found = rules, [], []

    def handle_starttag(self, tag, attrs):
        element = (tag, {k: v or "" for k, v in reversed(attrs)})
        self.stack.append(element)
        if element[1].get("href") and any(matches(r, self.stack) for r in self.rules):
            self.found.append(element[1]["href"])
        if tag in VOID:
            self.stack.pop()

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        if any(t == tag for t, _ in self.stack):
            while self.stack.pop()[0] != tag:
                pass


def selected(html: str | None, selector: str | None) -> list[str]:
    """hrefs, in order, of the elements that match; of all a elements without a selector."""
    parser = _Links(compiled(selector or "a[href]"))
    parser.feed(html or "")
    parser.close()
    return parser.found


@F.pandas_udf(T.ArrayType(T.StringType()))
def selected_udf(html: pd.Series, selector: pd.Series) -> pd.Series:
    return pd.Series([selected(h, s) for h, s in zip(html, selector, strict=True)])
