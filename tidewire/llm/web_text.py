"""Main text of web pages by template deduction from equivalence classes of tokens.

Pages become token sequences: tags by their path (names, classes and ids from the root) and words by the path of their
block. Over all of a host's pages each token has an occurrence vector (how often it stands in each page); tokens of equal
vectors, in most pages, form an equivalence class. A class is valid if its tags stand in one order in every repetition on
every page; its words belong to it if they always stand in the same gap between its tags. A class without tags needs
LEAST_WORDS words in one order. A class whose tokens always stand in one gap of another is nested there. The nested valid
classes are the host's template: their tokens are fixed, what stands between them are its slots.

Extraction keeps the blocks that hold slot content. A block of template words alone is no content (menus, notices, lines
that a host repeats), whatever its markup. Of the slots those under the template's article or main element count; elements
that their tag, class or id names as boilerplate (adverts, comments, sidebars: slots with content of their own) are left
out. Pages that their host's template does not fit, and hosts of fewer than LEAST_PAGES pages, where words of an article
can agree by chance, go by the rules for elements alone.

Every page is parsed whole, and every count is over all pages of a host: tokens in most pages of a host are in most pages
of some task's share of them, so these are the candidates that are counted. Null html gives an empty text, null URLs are
of no host. Rows repeat as they come and count as pages each; ties need no order. An empty table gives an empty result;
extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import html as entities
import json
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewire.runtime import checked, materialise, small_enough, workers_see_package

#: Hosts whose templates may be broadcast, and the bytes of these.
BROADCAST_HOSTS, BROADCAST_BYTES = 5_000, 16 << 20
#: Pages of a host from which on its words are tokens of the template, and words of a class without tags at least.
LEAST_PAGES, LEAST_WORDS = 4, 3
#: Words of waiting pages (or sums) that a task holds before it settles them.
HELD_TOKENS = 400_000
#: Pages of one host that a task compares at once for candidates.
GROUP = 16

# HTML element names by their part in a page, and words that name boilerplate in class and id.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = "script|style|noscript|template|textarea|title|iframe|svg|select|object|canvas"
INLINE = frozenset("a abbr b bdi bdo big br cite code data del dfn em font i img ins kbd mark q s samp small span strike strong sub sup time tt u var wbr".split())
BOILERPLATE = frozenset("nav header footer aside form button menu dialog head fieldset label input option video audio figure".split())
BOILERPLATE_WORDS = frozenset("ad ads advert advertisement banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus footer header login masthead menu modal nav navbar navigation newsletter notice notification pagination pager popup promo promoted promotion recommend recommended related replies respond share sharing sidebar signup social sponsor sponsored subscribe teaser toolbar widget".split())
MAIN = frozenset(("article", "main"))
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements whose articles are not the page's own; a form or label may stand around a whole page.
APART = frozenset("nav header footer aside button menu dialog head video audio figure".split())
#: An element that opens closes the ones of these names that stand open in the same parent.
CLOSES = {"p": ("p",), "li": ("li",), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "option": ("option",)}

_TOKEN = re.compile(rf"<!--.*?(?:-->|\Z)|<({RAW})\b[^>]*>.*?(?:</\1\s*>|\Z)|<(/?)([a-zA-Z][\w:-]*)((?:\"[^\"]*\"|'[^']*'|[^'\">])*)>|<[!?][^>]*>", re.S | re.I)
_NAMES = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_HIDDEN = re.compile(r"(?:^|\s)hidden(?:\s|=|$)|display\s*:\s*none|aria-hidden\s*=\s*[\"']?true", re.I)
_WORD = re.compile(r"[a-z]+")


def parse(page: str) -> Iterator[tuple[str, tuple, str, str]]:
    """(kind, path, role, text): 'open' and 'close' of elements, and 'text' between; path is a tuple of (name, marks) from the root, role names its block elements."""
    names: list[str] = []
    paths: list[tuple] = [()]
    roles: list[str] = [""]

    def closed(upto: int) -> Iterator[tuple[str, tuple, str, str]]:
        while len(names) > upto:
            yield "close", paths[-1], roles[-1], ""
            names.pop()
            paths.pop()
            roles.pop()

    at = 0
    for token in _TOKEN.finditer(page):
        start, end = token.span()
        if start > at:
            yield "text", paths[-1], roles[-1], page[at:start]
        at = end
        raw, slash, name, rest = token.groups()
        if name is None:
            if raw and raw.lower() != "title":
                yield "gap", paths[-1], roles[-1], ""
            continue
        name = name.lower()
        if slash:
            if name in names:
                yield from closed(len(names) - 1 - names[::-1].index(name))
            elif name == "p":
                yield "gap", paths[-1], roles[-1], ""
            continue
        if name not in INLINE and "p" in names:
            # A block begins: an open paragraph, with the inline elements left open in it, ends.
            depth = len(names) - 1 - names[::-1].index("p")
            if all(n in INLINE for n in names[depth + 1 :]):
                yield from closed(depth)
        if name in CLOSES:
            for depth in range(len(names) - 1, -1, -1):
                if names[depth] in CLOSES[name]:
                    yield from closed(depth)
                elif names[depth] not in INLINE:
                    break
        marks = ""
        if rest:
            marks = " ".join(" ".join(x for x in m if x) for m in _NAMES.findall(rest)).lower()
            if _HIDDEN.search(rest):
                marks += " hidden-element"
            marks = marks.strip()
        if name in VOID or rest.endswith("/"):
            yield ("space" if name in INLINE else "gap"), paths[-1], roles[-1], ""
            continue
        names.append(name)
        paths.append((*paths[-1], (name, marks)))
        label = f"{name}.{marks}" if marks else name
        roles.append(roles[-1] if name in INLINE else f"{roles[-1]}/{label}" if roles[-1] else label)
        yield "open", paths[-1], roles[-1], ""
    if at < len(page):
        yield "text", paths[-1], roles[-1], page[at:]
    yield from closed(0)


def is_boilerplate(element: tuple[str, str], inside_main: bool = False) -> bool:
    name, marks = element
    if name in BOILERPLATE:
        return not (inside_main and name in ("header", "figure", "label"))
    if not marks:
        return False
    if inside_main and (name in HEADINGS or name == "p"):
        return "hidden-element" in marks
    return name not in ("html", "body") and ("hidden-element" in marks or bool(BOILERPLATE_WORDS & set(_WORD.findall(marks))))


def sets_apart(element: tuple[str, str]) -> bool:
    """Whether articles in the element are not the page's own: by its name only, as marks of an article's ancestors may describe the whole page."""
    return element[0] in APART or "hidden-element" in element[1]


def segments(page: str, wanted: dict[str, set] | None = None) -> Iterator[tuple[str, list[str] | None]]:
    """The page's tokens in order: ('o' or 'c' with the path, None) of elements that open and close, ('w' with the path, words) of texts; of words only the wanted ones of their path."""
    for kind, path, role, text in parse(page):
        if kind == "text":
            if text.isspace():
                continue
            if wanted is None:
                yield "w" + role, (entities.unescape(text) if "&" in text else text).split()
            elif known := wanted.get("w" + role):
                yield "w" + role, [w for w in (entities.unescape(text) if "&" in text else text).split() if w in known]
        elif kind == "open":
            if path[-1][0] not in INLINE:
                yield "o" + role, None
        elif kind == "close" and path[-1][0] not in INLINE:
            yield "c" + role, None


def tokens_of(page: str, wanted: dict[str, set] | None = None) -> list[str]:
    """segments() as single tokens: a word's is its path, a tab and the word."""
    out = []
    for role, words in segments(page, wanted):
        if words is None:
            out.append(role)
        else:
            out += [f"{role}\t{w}" for w in words]
    return out


def by_path(tokens: Iterable[str]) -> dict[str, set]:
    """The words among the tokens, by their path."""
    out: dict[str, set] = {}
    for token in tokens:
        if token[0] == "w":
            role, _, word = token.partition("\t")
            out.setdefault(role, set()).add(word)
    return out


def observed(tokens: list[str], classes: list[dict]) -> dict[tuple[int, str], str]:
    """What a page shows of the host's classes: (class, '') the order of its tags, (class, word) the gap that a word stands in, (class, 'in N') the gap of class N that its tags stand in; '' where it is not one."""
    tag_of = {t: k for k, c in enumerate(classes) for t in c["tags"]}
    word_of = {w: k for k, c in enumerate(classes) for w in c["words"]}
    number = [len(c["tags"]) for c in classes]
    seen: list[list[str]] = [[] for _ in classes]
    words: list[list[str]] = [[] for _ in classes]
    gaps: dict[tuple[int, str], set[int]] = {}
    for token in tokens:
        if token[0] == "w":
            k = word_of.get(token)
            if k is not None:
                words[k].append(token)
                if number[k]:
                    gaps.setdefault((k, token), set()).add(len(seen[k]) % number[k])
        else:
            k = tag_of.get(token)
            if k is not None:
                for other, size in enumerate(number):
                    if other != k and size:
                        gaps.setdefault((k, f"in {other}"), set()).add(len(seen[other]) % size)
                seen[k].append(token)
    out = {key: str(next(iter(at))) if len(at) == 1 else "" for key, at in gaps.items()}
    for k, c in enumerate(classes):
        own, kinds = (seen[k], c["tags"]) if number[k] else (words[k], c["words"])
        if own:
            order = _order(own, len(kinds))
            out[k, ""] = hashlib.blake2b("\n".join(order).encode(), digest_size=16).hexdigest() if order else ""
    return out


def _order(own: list[str], size: int) -> list[str] | None:
    """The common order of a class's tokens in each of their repetitions, or none."""
    order = own[:size]
    if len(set(order)) < size or len(own) % size:
        return None
    return order if all(own[k : k + size] == order for k in range(0, len(own), size)) else None


def assembled(classes: list[dict], agreed: dict[tuple[int, str], str]) -> dict:
    """The template of classes and what all pages agree on: nested valid classes, their words, and the main elements."""
    valid = [k for k, c in enumerate(classes) if agreed.get((k, ""))]
    around = {k: [n for n in valid if n != k and agreed.get((k, f"in {n}"), "0") not in ("", "0")] for k in valid}
    nested, words = [], set()
    for k in valid:
        #: The innermost class around is the one that most others are around of.
        parent = max(around[k], key=lambda n: (len(around[n]), -n), default=None)
        own = [w for w in classes[k]["words"] if not classes[k]["tags"] or agreed.get((k, w))]
        words.update(own)
        nested.append({"class": k, "tags": classes[k]["tags"], "words": own, "parent": parent, "gap": int(agreed[k, f"in {parent}"]) if parent is not None else None})
    elements = sorted({t[1:] for n in nested for t in n["tags"] if t[0] == "o"})
    return {"classes": nested, "words": sorted(words), "main": _unmarked([e for e in elements if _may_be_main(e)])}


def class_of(roles: list[str], pages: int) -> dict | None:
    """A class of tokens of one vector, if it can be valid."""
    words = sorted(r for r in roles if r[0] == "w") if pages >= LEAST_PAGES else []
    tags = sorted(r for r in roles if r[0] != "w")
    return {"tags": tags, "words": words} if tags or len(words) >= LEAST_WORDS else None


def deduce(pages: list[str]) -> dict:
    """The template of same-host pages, in one process."""
    sequences = [tokens_of(p) for p in pages]
    vectors: dict[str, list[int]] = {}
    for k, sequence in enumerate(sequences):
        for role in sequence:
            vectors.setdefault(role, [0] * len(pages))[k] += 1
    groups: dict[tuple, list[str]] = {}
    for role, vector in vectors.items():
        if 2 * sum(v > 0 for v in vector) > len(pages):  # frequent: in most pages
            groups.setdefault(tuple(vector), []).append(role)
    classes = ordered_classes([c for c in (class_of(g, len(pages)) for g in groups.values()) if c])
    agreed: dict[tuple[int, str], str] = {}
    for sequence in sequences:
        for key, value in observed(sequence, classes).items():
            agreed[key] = value if agreed.get(key, value) == value else ""
    return assembled(classes, agreed)


def ordered_classes(classes: list[dict]) -> list[dict]:
    return sorted(classes, key=lambda c: (c["tags"], c["words"]))


def _may_be_main(role: str) -> bool:
    return role.rsplit("/", 1)[-1].split(".")[0] in MAIN and not any(sets_apart(_element(x)) for x in role.split("/")[:-1])


def _unmarked(roles: list[str]) -> list[str]:
    return [e for e in roles if not any(is_boilerplate(_element(x)) for x in e.split("/"))] or roles


def _element(text: str) -> tuple[str, str]:
    name, _, marks = text.partition(".")
    return name, marks


def blocks(page: str, template: dict | None) -> list[str]:
    """The page's main blocks in order: references decoded, white space single."""
    events = list(parse(page))
    #: Articles under no marked element come first; where there is none, those under marked ones are the page's.
    mains = {path for kind, path, _, _ in events if kind == "open" and path[-1][0] in MAIN and not any(sets_apart(e) for e in path[:-1])}
    mains = {path for path in mains if not any(is_boilerplate(e) for e in path)} or mains
    around = {path[:k] for path in mains for k in range(1, len(path) + 1)}
    fitting = {path for path in mains if template and _role(path) in set(template["main"])}
    fixed = template["words"] if template else ()
    fixed = fixed if isinstance(fixed, set) else set(fixed)
    for chosen in (fitting, mains, None):
        for words in (fixed, set()) if fixed else (fixed,):  # an article of template words alone keeps them
            found = _collect(events, chosen, around, words) if chosen is None or chosen else []
            if found:
                return found
    return _collect(events, None, around, set(), False)


def _role(path: tuple) -> str:
    return "/".join(f"{n}.{m}" if m else n for n, m in path)


def _collect(events: list[tuple], main: set[tuple] | None, around: set[tuple], fixed: set[str], less: bool = True) -> list[str]:
    """Text blocks with slot content under the main elements, or of the whole body (None), less boilerplate elements that are not around an article."""
    out: list[str] = []
    parts: list[str] = []
    slot = not fixed

    def flush() -> None:
        nonlocal slot
        text = " ".join(entities.unescape("".join(parts)).split())
        if text and slot:
            out.append(text)
        parts.clear()
        slot = not fixed

    chosen: dict[tuple, bool] = {}
    for kind, path, role, text in events:
        if kind in ("open", "close"):
            if path[-1][0] not in INLINE:
                flush()
            if kind == "open" and path not in chosen:
                above = chosen.get(path[:-1], main is None) or (main is not None and path in main)
                chosen[path] = above and (path in around or not less or not is_boilerplate(path[-1], main is not None))
        elif kind == "text":
            if chosen.get(path, main is None and not path):
                parts.append(text)
                if not slot:
                    slot = any(f"w{role}\t{word}" not in fixed for word in entities.unescape(text).split())
        elif kind == "gap":
            flush()
        else:
            parts.append(" ")
    flush()
    return out


def _fingerprint(page: int, count: int) -> tuple[int, int]:
    """Two summands of 31 bits: roles that occur equally often in every page, and hardly any others, have equal sums."""
    low = hashlib.blake2b(b"%d %d" % (page, count), digest_size=8).digest()
    return int.from_bytes(low[:4], "big") >> 1, int.from_bytes(low[4:], "big") >> 1


def majority(group: list[dict[str, set]]) -> dict[str, set]:
    """The words by path that stand in most of the group's pages."""
    out: dict[str, set] = {}
    for role in set().union(*group):
        own = [page[role] for page in group if role in page]
        if 2 * len(own) <= len(group):
            continue
        found = {w for w, n in Counter(chain.from_iterable(own)).items() if 2 * n > len(group)}
        if found:
            out[role] = found
    return out


def _candidates(rows: DataFrame) -> DataFrame:
    """(host, role, pages): tokens in most pages of some group of a host's pages, and for role '' the number of pages.

    A task deals each host's pages into groups of GROUP (the last one under twice that): a token in most pages of the host
    is in most of some group.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: dict[str, list[dict[str, set]]] = {}
        found: dict[str, dict[str, set]] = {}
        pages: Counter = Counter()
        held = 0

        def settle(host: str, group: list) -> None:
            own = found.setdefault(host, {})
            for role, words in majority(group).items():
                own.setdefault(role, set()).update(words)

        def named() -> pa.RecordBatch:
            for host, group in waiting.items():
                settle(host, group)
            out = [(h, "", n) for h, n in pages.items()] + [(h, f"{role}\t{word}" if word else role, 0) for h, roles in found.items() for role, words in roles.items() for word in words]
            columns = list(zip(*out, strict=True)) or [(), (), ()]
            for d in (waiting, found, pages):
                d.clear()
            return pa.RecordBatch.from_arrays([pa.array(columns[0], pa.string()), pa.array(columns[1], pa.string()), pa.array(columns[2], pa.int64())], ["host", "role", "pages"])

        for batch in batches:
            for host, html in zip(batch.column("host").to_pylist(), batch.column("html"), strict=True):
                here: dict[str, set] = {}
                for role, words in segments(html.as_py()):
                    here.setdefault(role, set()).update(("",) if words is None else words)
                pages[host] += 1
                group = waiting.setdefault(host, [])
                group.append(here)
                held += sum(map(len, here.values()))
                if len(group) == 2 * GROUP:
                    settle(host, group[:GROUP])
                    held -= sum(len(w) for page in group[:GROUP] for w in page.values())
                    del group[:GROUP]
                if held > HELD_TOKENS:
                    yield named()
                    held = 0
        yield named()

    parts = rows.select("host", "html").mapInArrow(run, "host string, role string, pages bigint")
    return parts.groupBy("host", "role").agg(F.sum("pages").alias("pages"))


def _sided(rows: DataFrame, side: DataFrame, column: str):
    """rows, and a function (batch, row) -> the side's value for the row's host: by a broadcast where the side is small, else by a join."""
    small = small_enough(side, BROADCAST_HOSTS) and (side.agg(F.sum(F.length(F.to_json(F.struct(column))))).first()[0] or 0) <= BROADCAST_BYTES
    if not small:
        joined = rows.join(side.select("host", column), "host", "left")
        return joined, joined.columns, lambda batch, row: batch.column(batch.schema.get_field_index(column))[row].as_py()
    shared = rows.sparkSession.sparkContext.broadcast({r["host"]: r[column] for r in side.select("host", column).collect()})
    return rows, rows.columns, lambda batch, row: shared.value.get(batch.column(batch.schema.get_field_index("host"))[row].as_py())


def _vector_sums(rows: DataFrame, held: DataFrame) -> DataFrame:
    """Per host and candidate (held: host, roles): in how many of all its pages it stands, and the sums that name its occurrence vector."""
    met, columns, side = _sided(rows.select("host", F.xxhash64("id", "url", "html").alias("page"), "html"), held, "roles")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, tuple[frozenset, dict]] = {}
        sums: dict[tuple, list[int]] = {}
        for batch in batches:
            for row, (host, page, html) in enumerate(zip(*(batch.column(c) for c in ("host", "page", "html")), strict=True)):
                host = host.as_py()
                if host not in known:
                    roles = side(batch, row) or ()
                    known[host] = frozenset(roles), by_path(roles)
                counts = Counter(tokens_of(html.as_py(), known[host][1]))
                counts = {role: n for role, n in counts.items() if role in known[host][0]}
                marks = {n: _fingerprint(page.as_py(), n) for n in set(counts.values())}
                for role, n in counts.items():
                    own = sums.setdefault((host, role), [0, 0, 0])
                    own[0] += 1
                    own[1] += marks[n][0]
                    own[2] += marks[n][1]
            if len(sums) > HELD_TOKENS:
                yield _sums_out(sums)
                sums = {}
        yield _sums_out(sums)

    parts = met.select(*columns).mapInArrow(run, "host string, role string, n bigint, f bigint, g bigint")
    return parts.groupBy("host", "role").agg(*(F.sum(c).alias(c) for c in ("n", "f", "g")))


def _sums_out(sums: dict) -> pa.RecordBatch:
    columns = [pa.array([k[c] for k in sums], pa.string()) for c in (0, 1)] + [pa.array([v[c] for v in sums.values()], pa.int64()) for c in (0, 1, 2)]
    return pa.RecordBatch.from_arrays(columns, ["host", "role", "n", "f", "g"])


def _agreements(rows: DataFrame, held: DataFrame) -> DataFrame:
    """(host, class, item, value) that all pages of the host agree on (held: host, classes as JSON)."""
    sided, columns, side = _sided(rows.select("host", "html"), held, "classes")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, tuple[list[dict], dict]] = {}
        for batch in batches:
            met: set[tuple] = set()
            for row, (host, html) in enumerate(zip(*(batch.column(c) for c in ("host", "html")), strict=True)):
                host = host.as_py()
                if host not in known:
                    read = json.loads(side(batch, row) or "[]")
                    known[host] = read, by_path(w for c in read for w in c["words"])
                shown = observed(tokens_of(html.as_py(), known[host][1]), known[host][0])
                met.update((host, k, item, value) for (k, item), value in shown.items())
            columns_out = list(zip(*met, strict=True)) or [(), (), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(columns_out[0], pa.string()), pa.array(columns_out[1], pa.int32()), pa.array(columns_out[2], pa.string()), pa.array(columns_out[3], pa.string())], ["host", "class", "item", "value"])

    found = sided.select(*columns).mapInArrow(run, "host string, class int, item string, value string")
    return found.groupBy("host", "class", "item").agg(F.min("value").alias("value"), F.max("value").alias("high")).where("value = high AND value <> ''").drop("high")


def templates(rows: DataFrame) -> DataFrame:
    """(host, template as JSON) as `deduce` finds it in all pages of the host: sums over pages, no host's pages in one place."""
    rows = rows.where("host <> ''")
    candidates = materialise(_candidates(rows))
    pages = candidates.where("role = ''").select("host", "pages")
    named = materialise(candidates.where("role <> ''").groupBy("host").agg(F.collect_list("role").alias("roles")))
    sums = _vector_sums(rows, named).join(checked(materialise(pages)), "host").where(2 * F.col("n") > F.col("pages"))
    groups = sums.groupBy("host", "n", "f", "g").agg(F.collect_list("role").alias("roles"), F.first("pages").alias("pages"))
    per_host = groups.groupBy("host").agg(F.collect_list("roles").alias("groups"), F.first("pages").alias("pages"))

    @F.udf("string")
    def kept(groups: list, n: int) -> str:
        return json.dumps(ordered_classes([c for c in (class_of(g, n) for g in groups) if c]))

    held = materialise(per_host.select("host", kept("groups", "pages").alias("classes")))
    agreed = _agreements(rows, held).groupBy("host").agg(F.collect_list(F.struct("class", "item", "value")).alias("agreed"))

    @F.udf("string")
    def template(classes: str, agreed: list | None) -> str:
        return json.dumps(assembled(json.loads(classes), {(a["class"], a["item"]): a["value"] for a in agreed or ()}))

    return held.join(agreed, "host", "left").select("host", template("classes", "agreed").alias("template"))


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Per page: id, url, text (main blocks joined by blank lines)."""
    workers_see_package(pages.sparkSession)
    host = F.lower(F.coalesce(F.regexp_extract(F.col(url_col), "^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1), F.lit("")))
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), host.alias("host"), F.coalesce(F.col(html_col), F.lit("")).alias("html"))
    met, columns, side = _sided(rows, materialise(templates(rows)), "template")
    key, url = (rows.schema[c].dataType.simpleString() for c in ("id", "url"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read: dict[str, dict | None] = {}
        for batch in batches:
            texts = []
            for row, (page, host) in enumerate(zip(batch.column("html"), batch.column("host"), strict=True)):
                host = host.as_py()
                if host not in read:
                    template = side(batch, row)
                    read[host] = json.loads(template) if template else None
                    if template:
                        read[host]["words"] = set(read[host]["words"])
                texts.append("\n\n".join(blocks(page.as_py(), read[host])))
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("url"), pa.array(texts, pa.string())], ["id", "url", "text"])

    return met.select(*columns).mapInArrow(run, f"id {key}, url {url}, text string").withColumnsRenamed({"id": id_col, "url": url_col})


