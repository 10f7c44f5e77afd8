"""Operators on hand-made rows: the sequential rules against plain Python, and table-driven cases."""

import copy
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidewire.functions import text as X
from tidewire.operators import analytics as A
from tidewire.operators import clustering as C
from tidewire.operators import dedup as D
from tidewire.operators import displayed as U
from tidewire.operators import graph as G
from tidewire.operators import rounds
from tidewire.operators import scoring as S
from tidewire.operators import selection as T
from tidewire.operators import similarity as Y


@settings(max_examples=60, deadline=None)
@given(st.text("abcd", max_size=12), st.text("abcd", max_size=12))
def test_lcs_by_table(a, b):
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
    assert Y.lcs_length(a, b) == table[-1][-1]


@pytest.mark.parametrize(("a", "b", "want"), [("", "", 100.0), ("abc", "abc", 100.0), ("abc", "abd", 200 * 2 / 6), (None, "a", 0.0)])
def test_indel_ratio(a, b, want):
    assert Y.indel_ratio(a, b) == pytest.approx(want)


def test_token_set_ratio():
    assert Y.token_set_ratio("fuzzy was a bear", "fuzzy fuzzy was a bear") == 100.0
    assert Y.token_set_ratio("", "a") == 0.0


@pytest.mark.parametrize("seed", range(4))
def test_displacing_in_rounds_equals_the_rule(spark, seed):
    rnd = random.Random(seed)
    n = 70
    weights = [rnd.choice([0.2, 0.5, 0.9] if seed % 2 else [0.5]) for _ in range(n)]
    similar = {(i, j) for i in range(n) for j in range(i + 1, n) if rnd.random() < (0.03 if seed < 2 else 0.3)}
    rows = spark.createDataFrame([(i, w) for i, w in enumerate(weights)], "id bigint, weight double")
    edges = spark.createDataFrame(sorted(similar), "a bigint, b bigint")
    for finish in (0, 1000):
        assert sorted(r.id for r in D.survivors(rows, edges, finish).collect()) == sorted(D.keep_fuzzy(list(range(n)), weights, similar))


@pytest.mark.parametrize("finish", [0, 25, 10_000])
def test_first_come_over_keys_equals_the_rule(spark, finish):
    rnd = random.Random(finish)
    speaks = sorted({(rnd.randrange(40), i) for i in range(120) for _ in range(rnd.choice([0, 1, 1, 2]))})
    listens = sorted({(rnd.randrange(40), i) for i in range(120) for _ in range(rnd.choice([0, 1, 2, 3]))})
    taken, want = set(), set()
    for i in range(120):
        if taken & {k for k, who in listens if who == i}:
            want.add(i)
        else:
            taken |= {k for k, who in speaks if who == i}
    kind = "key bigint, id bigint"
    got = [r.id for r in rounds.first_come(spark.createDataFrame(speaks, kind), spark.createDataFrame(listens, kind), finish).collect()]
    assert sorted(got) == sorted(want)


@pytest.mark.parametrize("least", [60.0, 85.0])
def test_fuzzy_edges_equal_all_pairs(spark, least):
    rnd = random.Random(int(least))
    base = ["Storm hits the coast again", "King visits Spain", "Exports fall 12% in May", "", "日本の経済"]

    def title():
        own = list(rnd.choice(base))
        for _ in range(rnd.randint(0, 4)):
            own.insert(rnd.randint(0, len(own)), rnd.choice("aeZ 9ß日")) if rnd.random() < 0.5 or not own else own.pop(rnd.randrange(len(own)))
        return "".join(own)

    rows = [(i, f"s{i % 2}", None if i % 41 == 0 else title()) for i in range(120)]
    got = sorted(map(tuple, D.fuzzy_edges(spark.createDataFrame(rows, "id bigint, source_name string, title string"), least).collect()))
    assert got == [(i, j) for i, s, t in rows for j, u, v in rows if i < j and s == u and Y.indel_ratio(t, v) >= least]


def test_fuzzy_dedup_query_equals_the_rule(spark):
    from tidewire.plans import text_queries as Q
    from tidewire.sources import views as V

    sf = "/root/testdata/sf0.001"
    rows = V.titles(spark, sf).select("id", "title", "source_name").orderBy("id").collect()
    weight = {r["name"]: r["weight"] for r in V.doc_sources(spark, sf).collect()}
    similar = {(i, j) for i, a in enumerate(rows) for j, b in enumerate(rows) if i < j and a.source_name == b.source_name and Y.indel_ratio(a.title, b.title) >= 85}
    want = D.keep_fuzzy(list(range(len(rows))), [weight.get(r.source_name, 0.5) for r in rows], similar)
    assert sorted(r.id for r in Q.QUERIES["d07_fuzzy_dedup"](spark, sf).collect()) == sorted(rows[k].id for k in want)


def plain_split(vectors, least):
    """D15 as it is told, over a matrix of cosines."""
    size = np.linalg.norm(vectors, axis=1)
    cosine = vectors @ vectors.T / np.outer(size, size)
    rest, out = list(range(len(vectors))), []
    mean = lambda g: np.mean([cosine[i, j] for n, i in enumerate(g) for j in g[n + 1 :]])
    while rest:
        core = [max(rest, key=lambda n: sum(cosine[n, m] for m in rest if m != n))]
        left = [n for n in rest if n != core[0]]
        while left:
            best = max(left, key=lambda n: mean([*core, n]))
            if mean([*core, best]) < least:
                break
            core.append(best)
            left.remove(best)
        out.append(core)
        rest = left
    return out


def test_coherence_queries_equal_the_rule(spark):
    from tidewire.plans import store_queries, text_queries

    sf = "/root/testdata/sf0.001"
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").orderBy("vec_id").collect()
    want = {}
    for c in range(50):
        own = [r for r in rows if r.vec_id % 50 == c]
        parts = plain_split(np.array([r.embedding for r in own], float), 0.2) if len(own) >= 3 else [list(range(len(own)))]
        want |= {own[i].vec_id: k for k, part in enumerate(parts) for i in part}
    assert {r.vec_id: r.part for r in text_queries.QUERIES["d15_coherent_split"](spark, sf).collect()} == want
    keeps = {}
    for key in range(200):
        own = [r for r in rows if r.vec_id % 200 == key]
        parts = plain_split(np.array([r.embedding for r in own], float), 0.2) if len(own) > 1 and not any(r.vec_id % 97 == 0 for r in own) else [list(range(len(own)))]
        anchor = max(range(len(own)), key=lambda i: own[i].vec_id % 13 / 13, default=None)
        primary = next((p for p in parts if anchor in p), [])
        primary = primary if len(primary) >= 2 else max(parts, key=len)
        keeps |= {r.vec_id: len(parts) == 1 or (len(primary) >= 2 and i in primary) for i, r in enumerate(own)}
    assert {r.id: r.keeps for r in store_queries.QUERIES["d16_split_families"](spark, sf).collect()} == keeps


def test_split_of_many_members_needs_no_matrix():
    rnd = np.random.default_rng(2)
    x = rnd.normal(size=(2500, 16)) + 3 * np.eye(16)[rnd.integers(0, 3, 2500)]
    sims = (u := x / np.linalg.norm(x, axis=1, keepdims=True)) @ u.T
    parts = G.split_coherently(x, 0.45)
    assert sorted(i for p in parts for i in p) == list(range(2500)) and len(parts) > 1
    first = parts[0]
    assert first[0] == int((sims.sum(1) - 1).argmax())
    gain, total = sims[first[0]].copy(), 0.0
    for n, i in enumerate(first[1:], 2):
        free = np.setdiff1d(np.arange(2500), first[: n - 1])
        assert gain[i] >= gain[free].max() - 1e-9
        total += gain[i]
        gain += sims[i]
        assert total / (n * (n - 1) / 2) >= 0.45 - 1e-9


def test_text_queries_equal_the_rules(spark):
    from tidewire.plans import text_queries as Q
    from tidewire.sources import views as V

    sf = "/root/testdata/sf0.001"
    titles = [(r.id, r.title) for r in V.titles(spark, sf).collect()]
    want = {}
    for day in range(20):
        golden = [t.strip() for i, t in titles if i % 20 == day and i % 3 == 0 and t.strip()]
        fresh = [t.strip() for i, t in titles if i % 20 == day and i % 3 and t.strip()]
        if golden:
            want[day] = len(golden), sum(any(Y.token_set_ratio(g, f) >= 60 for f in fresh) for g in golden)
    assert {r.day: (r.stories, r.covered) for r in Q.QUERIES["j20_golden_coverage"](spark, sf).collect()} == want


def test_fuzzy_dedup_needs_one_source(spark):
    rows = spark.createDataFrame([(1, "Markets rally on rates", "a"), (2, "Markets rally on rate", "a"), (3, "Markets rally on rates", "b")], "id bigint, title string, source_name string")
    weights = spark.createDataFrame([("a", 0.9)], "name string, weight double")
    assert {r.id for r in D.fuzzy_dedup(rows, weights).collect()} == {1, 3}


@pytest.mark.parametrize("finish", [0, 200_000])
def test_components_of_chain_and_ring(spark, finish):
    edges = [(i, i + 1) for i in range(1, 30)] + [(100, 101), (101, 102), (102, 100), (500, 500)]
    nodes = spark.createDataFrame([(x,) for e in edges for x in e] + [(7000,)], "id bigint")
    rows = G.connected_components(nodes, spark.createDataFrame(edges, "a bigint, b bigint"), finish).collect()
    got = {r.id: r.component for r in rows}
    assert len(rows) == len(got) == 35 and got[7000] == 7000 and got[500] == 500
    assert {got[i] for i in range(1, 31)} == {1} and {got[i] for i in (100, 101, 102)} == {100}
    assert G.connected_components(nodes, spark.createDataFrame([], "a bigint, b bigint"), finish).count() == 35


def test_coherent_split_keeps_like_together():
    a, b = np.array([1.0, 0.0]), np.array([0.0, 1.0])
    parts = G.split_coherently(np.stack([a, b, a, b, a]), 0.6)
    assert sorted(map(sorted, parts)) == [[0, 2, 4], [1, 3]]


@pytest.mark.parametrize("seed", range(8))
def test_coherent_split_equals_the_rule(seed):
    rnd = np.random.default_rng(seed)
    x = rnd.normal(size=(4, 5))[rnd.integers(0, 4, 25)] + 0.5 * rnd.normal(size=(25, 5))
    x /= np.linalg.norm(x, axis=1)[:, None]
    rest, want = list(range(25)), []
    while rest:
        group = [max(rest, key=lambda i: (round(float(x[i] @ x[rest].sum(0)), 12), -i))]
        while len(group) < len(rest):
            mean = lambda g: np.mean([x[a] @ x[b] for k, a in enumerate(g) for b in g[:k]])
            best = max((i for i in rest if i not in group), key=lambda i: (round(float(mean([*group, i])), 12), -i))
            if mean([*group, best]) < 0.4:
                break
            group.append(best)
        want.append(group)
        rest = [i for i in rest if i not in group]
    assert G.split_coherently(x, 0.4) == want


def test_event_edges_respect_time(spark):
    rows = spark.createDataFrame([(1, "2024-01-01 00:00:00", [1.0, 0.0]), (2, "2024-01-02 23:00:00", [0.97, 0.03]), (3, "2024-01-04 00:00:01", [1.0, 0.0])], "id bigint, t string, embedding array<double>").withColumn("published_at", F.col("t").cast("timestamp"))
    assert {(r.a, r.b) for r in C.event_edges(rows).collect()} == {(1, 2), (2, 3)}


@pytest.mark.parametrize("size", [7, 4096])
def test_bucketed_pairs_equal_all_pairs(spark, size):
    rnd = np.random.default_rng(8)
    x = rnd.normal(size=(90, 4))
    x /= np.linalg.norm(x, axis=1)[:, None]
    at = rnd.integers(0, 500, 90)
    rows = spark.createDataFrame([(i, [float(c) for c in v], int(t), int(i % 3)) for i, (v, t) in enumerate(zip(x, at, strict=True))] + [(99, None, 5, 1), (98, [1.0, 0.0, 0.0, 0.0], None, None)], "id bigint, v array<double>, t bigint, g bigint")
    near = {(a, b) for b in range(90) for a in range(b) if x[a] @ x[b] >= 0.3}
    timed = Y.bucketed_pairs(rows, "id", "v", F.floor(F.col("t") / 60), 0.3, F.col("t"), 60, block_rows=size)
    got = [(r.a, r.b) for r in timed.collect()]
    assert sorted(got) == sorted((a, b) for a, b in near if abs(at[a] - at[b]) <= 60)
    grouped = Y.bucketed_pairs(rows, "id", "v", F.col("g"), 0.3, block_rows=size)
    assert sorted((r.a, r.b) for r in grouped.collect()) == sorted((a, b) for a, b in near if a % 3 == b % 3)
    assert sorted((r.a, r.b) for r in Y.vector_pairs(rows.where("id < 90"), "id", "v", 0.3, block_rows=size).collect()) == sorted(near)


def test_matrices(spark):
    rows = spark.createDataFrame([(10, True, ["il"], "World", 8.0), (11, True, ["cn"], "World", 4.0), (12, False, ["us"], "World", 0.0)], "cluster_id bigint, selected boolean, subject_regions array<string>, display_category string, scope double")
    members = spark.createDataFrame([(10, "us"), (11, "us"), (11, "cn"), (11, "cn")], "cluster_id bigint, origin_region string")
    assert {tuple(r) for r in A.source_subject(rows, members).collect()} == {("us", "il", 1), ("us", "cn", 1), ("cn", "cn", 1)}
    assert {tuple(r) for r in A.subject_category(rows).collect()} == {("il", "World", 1), ("cn", "World", 1)}


def test_trends_without_verdicts(spark):
    rows = spark.createDataFrame([("d1", True, 0.5, 1), ("d1", False, 0.3, None), ("d2", True, 0.2, -1), ("d3", True, 0.2, None)], "report_date string, selected boolean, composite double, verdict int")
    assert {r.report_date: (r.selected, r.candidates, r.accept_rate) for r in A.trends(rows).collect()} == {"d1": (1, 1, 1.0), "d2": (1, 0, 0.0), "d3": (1, 0, None)}


def test_diverse_equals_greedy(spark):
    rnd = random.Random(5)
    rows = [(i, rnd.choice(["a", "b", "c", None]), rnd.random()) for i in range(80)]
    chosen, over, per = [], [], {}
    for i, c, _ in sorted(rows, key=lambda r: -r[2]):
        if len(chosen) >= 20:
            break
        if c and per.get(c, 0) >= 3:
            over.append(i)
            continue
        chosen.append(i)
        per[c] = per.get(c, 0) + 1
    chosen += over[: 20 - len(chosen)]
    got = T.diverse(spark.createDataFrame(rows, "id bigint, c string, s double"), "c", "s", "id", 20, 3)
    assert {r.id for r in got.collect()} == set(chosen)


def test_gate_penalises_all_members(spark):
    members = spark.createDataFrame([(1, "s1", "cn", "state_controlled_block"), (1, "s2", "gb", "private_constrained"), (1, "s3", "us", "state_influenced_review"), (2, "s4", "gb", "state_controlled_block")], "cluster_id bigint, source_name string, region string, ownership string")
    a = spark.createDataFrame([(1, "gb", True, 0.5, "publishable"), (2, "gb", True, 0.5, "publishable"), (3, None, False, 0.4, "publishable")], "cluster_id bigint, target string, home_affairs boolean, composite double, status string")
    got = {r.cluster_id: (r.blocked, r.review, r.status, round(r.composite, 4)) for r in S.ownership_gate(members, a).collect()}
    assert got == {1: (1, 1, "needs_review", 0.425), 2: (0, 0, "publishable", 0.5), 3: (0, 0, "publishable", 0.4)}


def test_text_functions(spark):
    row = spark.createDataFrame([("https://www.a.example/2024/03/05/x?url=https%3A%2F%2Fb.example%2Fy", "**Bold headline** rest")], "u string, m string")
    got = row.select(X.host(F.col("u")).alias("h"), X.url_date(F.col("u")).cast("string").alias("d"), X.unwrapped(F.col("u")).alias("t"), X.headline(F.col("m")).alias("m"), X.is_real(F.lit("placeholder:1")).alias("r")).first()
    assert tuple(got) == ("a.example", "2024-03-05", "https://b.example/y", "Bold headline", False)


def test_claims_within_tolerance(spark):
    got = spark.range(1).select(X.unsupported_claims(F.array(F.lit("100"), F.lit("55%"), F.lit("7")), F.array(F.lit("95"), F.lit("55"), F.lit("7"))).alias("x")).first()
    assert got.x == ["55%"]


def test_canonical_views_carry_leads_and_sources(spark):
    from tidewire.operators import perspectives as E

    a, b = "报道地震灾情及伤亡情况，关注救援进展和余震风险。", "报道地震伤亡及救援进展，关注余震风险。"
    assert E.canonical([(["Reuters"], a), (["BBC"], b)]) == [(["Reuters", "BBC"], a)]
    # A source speaks once; a view whose sources have all spoken is left out, as is one that only confirms.
    groups = [(["x", " x ", ""], "  Oil is\n dear "), (["x", "y"], "Quite another thing is said here"), (["x"], "A third thing"), (["z"], "该来源报道与主摘要角度接近，未稳定提炼出可单列的差异化视角。"), (["z"], "oil is dear!"), (["w"], ""), ([], "No one says this")]
    assert E.canonical(groups) == [(["x", "z"], "Oil is dear"), (["y"], "Quite another thing is said here")]
    assert not E.distinct("This source Reports a similar angle to the main summary.") and not E.distinct("未提供足够的视角") and E.distinct("未提供" + "长" * 9 + "视角")
    rows = spark.createDataFrame([(c, k, s, t) for c in (1, 2) for k, (s, t) in enumerate(groups)] + [(3, 0, None, None)], "c bigint, k int, s array<string>, t string")
    got = {(r.c, r.place): (r.sources, r.perspective) for r in E.canonicalise(rows, "c", "k", "s", "t").collect()}
    assert got == {(c, k): x for c in (1, 2) for k, x in enumerate(E.canonical(groups), 1)}


def test_editorial_rules(spark):
    from tidewire.operators import assembly as B
    from tidewire.operators import editorial as E

    row = spark.range(1).select(
        E.host_suffixes(F.lit("a.b.c")).alias("s"), B.failure_label(F.lit("http_503,x")).alias("f"), B.failure_label(F.lit(None).cast("string"), 0).alias("z"),
        E.rejection_reason(F.lit(True), F.lit(True), F.lit(False), F.lit(90.0), F.lit(0.1)).alias("r"))
    assert tuple(row.first()) == (["a.b.c", "b.c", "c"], "Search service error (HTTP 503)", "未知原因", "duplicate_of_existing")


@pytest.mark.parametrize(("a", "b", "want"), [
    ("", "", False), ("媒体报道", "聚焦", False), ("The tariff hurts exporters", "The tariff hurts exporters!", True), ("ＡＢＣ factory strike", "abc factory strike", True),
    ("该来源强调关税影响出口企业", "关税影响出口企业", True), ("Exports fell sharply", "The king visited Spain", False),
])
def test_equivalent_perspectives(a, b, want):
    from tidewire.operators import perspectives as P

    assert P.equivalent(a, b) is want


def test_compaction_equals_the_rule_on_all_rows(spark):
    rnd = np.random.default_rng(4)
    base = rnd.normal(size=(6, 8))
    rows = []
    for i in range(60):
        v = base[i % 6] + 0.25 * rnd.normal(size=8)
        rows.append((i, f"s{i % 2}", f"Storm hits coast {i % 6} {'again' if i % 4 else 'and harbour today'}", [float(x) for x in v], int(rnd.integers(0, 30)), i % 10 != 3))
    docs = spark.createDataFrame(rows, "id bigint, source_name string, title string, embedding array<double>, at bigint, real boolean").withColumn("published_at", F.timestamp_seconds("at"))
    cosine = lambda a, b: np.dot(a, b) / np.linalg.norm(a) / np.linalg.norm(b)
    kept, want = [], {}
    for r in sorted(rows, key=lambda r: (-r[4], r[0])):
        met = r[5] and next((k for k in kept if k[1] == r[1] and cosine(k[3], r[3]) >= 0.9 and Y.token_set_ratio(k[2], r[2]) >= 85.0), None)
        want[r[0]] = met[0] if met else r[0]
        if met is None:
            kept.append(r)
    for finish in (0, 1000):
        assert {r.id: r.representative for r in D.compacted_updates(docs, 0.9, 85.0, finish).collect()} == want
    assert any(k != v for k, v in want.items())


def test_families_keep_their_history(spark):
    from tidewire.operators import history as H

    a, b = [1.0, 0.0], [0.0, 1.0]
    rows = [(1, "k", a, None, False), (2, "k", a, None, False), (3, "k", a, None, False), (4, "k", b, 0.9, False), (5, "k", b, None, False), (6, "c", a, None, True), (7, "c", b, None, False), (8, "one", a, None, False), (9, "s", a, 0.7, False), (10, "s", b, None, False)]
    docs = spark.createDataFrame(rows, "id bigint, key string, vector array<double>, history_score double, conflict boolean")
    assert {r.id for r in H.split_families(docs).collect() if r.keeps} == {4, 5, 6, 7, 8}


def test_golden_coverage(spark):
    from tidewire.operators import storyline as L

    golden = [(1, "Storm hits the coast"), (1, "King visits Spain"), (1, ""), (2, "Exports fall"), (2, "Exports fall")]
    fresh = [(1, "The coast storm hits"), (2, "Exports fall in May"), (1, "Exports fall")]
    schema = "day int, headline string"
    got = L.golden_coverage(spark.createDataFrame(golden, schema), spark.createDataFrame(fresh, schema)).collect()
    want = {}
    for day, g in golden:
        if g:
            n, c = want.get(day, (0, 0))
            want[day] = n + 1, c + any(Y.token_set_ratio(g, f) >= 60 for e, f in fresh if e == day)
    assert {r.day: (r.stories, r.covered) for r in got} == want


@pytest.mark.parametrize("least", [40.0, 60.0, 85.0])
def test_resembled_texts_equal_all_pairs(spark, least):
    from tidewire.operators import storyline as L

    rnd = random.Random(int(least))
    words = ["storm", "coast", "king", "Spain", "exports", "fall", "falls", "the", "a", "日本", "ß", "harbour"]
    text = lambda: " ".join(rnd.choice(words) + rnd.choice(["", "", "s"]) for _ in range(rnd.randint(0, 6)))
    asked, known = [text() for _ in range(120)], [text() for _ in range(60)]
    want = [a for a in asked if any(Y.token_set_ratio(a, k) >= least for k in known)]
    assert L.resembled(asked, known, least) == want and 0 < len(want)
    rows = [(d, t) for d in (1, 2) for t in asked]
    fresh = [(1, t) for t in known] + [(2, t) for t in known[:9]]
    got = L.golden_coverage(spark.createDataFrame(rows, "day int, headline string"), spark.createDataFrame(fresh, "day int, headline string"), least, block_rows=16).collect()
    covered = lambda d: sum(bool(t.strip()) and any(Y.token_set_ratio(t, f) >= least for e, f in fresh if e == d and f.strip()) for t in asked)
    assert {r.day: (r.stories, r.covered) for r in got} == {d: (sum(bool(t.strip()) for t in asked), covered(d)) for d in (1, 2)}


@pytest.mark.parametrize(
    "selector, want",
    [
        ("a", ["/1", "/2", "/3", "/4", "/5"]), ("nav a", ["/1", "/2"]), ("nav > a", ["/2"]), ("article a, .post a", ["/3", "/4"]), ("ul.menu li a.x", ["/1"]), ("a[href*='3'], a[href$=\"5\"]", ["/3", "/5"]),
        ("#main a", ["/3"]), ("a[rel]", ["/4"]), ("h2 a", ["/3"]), ("* > h2 > a[href^='/']", ["/3"]), ("video a", []), ("a[rel='x,y']", ["/4"]),
    ],
)
def test_selected_links(selector, want):
    from tidewire.functions.selectors import selected

    html = """<body><nav><ul class="menu top"><li><a class="x y" href="/1">1</a></li></ul><br><a href="/2">2</a></nav><article id=main><h2><a href="/3">3</a></h2></article>
    <div class='post'><p>open<a rel="x,y" href="/4">4</a></div></p><a href="">none</a><a>none</a><img src=x><a href='/5'>5</a>"""
    assert selected(html, selector) == want and selected(None, selector) == []


def test_selectors_that_are_not_understood_fail():
    from tidewire.functions.selectors import compiled

    with pytest.raises(ValueError):
        compiled("a:hover")


def test_store_opens_and_replaces(spark, tmp_path):
    from tidewire.operators import catalogue as K

    store = K.open_store(spark, f"file://{tmp_path}/store")
    assert len(store) == 16 and store["articles"].count() == 0
    rows = spark.createDataFrame([(1, 2, 1, "cli", "note", None)], K.TABLES["editorial_feedback"])
    K.replace_table(rows, f"file://{tmp_path}/store/editorial_feedback")
    K.replace_table(rows.union(rows), f"file://{tmp_path}/store/editorial_feedback")
    assert K.open_store(spark, f"file://{tmp_path}/store")["editorial_feedback"].count() == 2
    assert sorted(p.name for p in (tmp_path / "store").iterdir()) == sorted(K.TABLES)


def test_unknown_codes_fail(spark):
    from tidewire.operators import catalogue as K
    from tidewire.sources import feeds as I

    reviews = spark.createDataFrame([(1, "pending_review", "r")], "id bigint, decision string, reason string")
    with pytest.raises(Exception, match="Unsupported search review decision: maybe"):
        K.decided(reviews, spark.createDataFrame([(1, "maybe", "x")], "id bigint, decision string, reason string")).collect()
    with pytest.raises(Exception, match="Unknown certification code: zz"):
        I.certifications(spark.createDataFrame([("s", "zz")], "source_name string, code string"), spark.createDataFrame([("jti", "J")], "code string, label string")).collect()


def test_report_files(spark, tmp_path):
    from tidewire.sources import feeds as I

    for day, data in (("2024-01-01", '{"total_cluster_count": 3}'), ("2024-01-02", '{"total_cluster_count": 0}'), ("2024-01-03", "broken"), ("other", "{}")):
        (tmp_path / day).mkdir()
        (tmp_path / day / "index.html").write_text("<html/>")
        (tmp_path / day / "data.json").write_text(data)
    (tmp_path / "2024-01-04").mkdir()
    (tmp_path / "2024-01-04" / "data.json").write_text("{}")
    files = I.report_files(spark, f"file://{tmp_path}")
    assert sorted(r.day for r in I.report_dates(files).collect()) == ["2024-01-01", "2024-01-03"]


def test_foreach_batch_sink_keeps_keys_unique(spark, tmp_path):
    from tidewire.streaming import streams as R

    kind = "k bigint, v string"
    write = R.append_new(f"{tmp_path}/table", ["k"])
    batches = [spark.createDataFrame(x, kind) for x in ([(1, "a"), (1, "a"), (2, "c")], [(2, "d"), (3, "e")], [(3, "f"), (4, "g")])]
    write(batches[0], 0)
    write(batches[1], 1)
    write(batches[1], 1)  # a batch that is run again leaves its rows once
    write(batches[0], 0)
    write(batches[2], 2)
    got = sorted(map(tuple, R.read_appended(spark, f"{tmp_path}/table", kind).collect()))
    assert [k for k, _ in got] == [1, 2, 3, 4] and got[0] == (1, "a") and got[3] == (4, "g")
    assert R.read_appended(spark, f"{tmp_path}/none", kind).count() == 0


def test_idle_keys_leave_the_state(spark, tmp_path):
    from tidewire.streaming import streams as R

    rows = [(k, hour) for hour in range(40) for k in ([0, 1, 2, 3, 4] if hour < 4 else [9])]
    events = spark.createDataFrame(rows, "user_id bigint, hour int").select("user_id", F.timestamp_seconds(F.lit(1704067200) + F.col("hour") * 3600).alias("ts"))
    sizes = {}
    for idle in (None, "5"):
        stream = R.lifecycle_state(R.in_batches(events, 8), idle=idle, lateness="1 hour")
        query = stream.writeStream.foreachBatch(lambda b, e: b.count()).outputMode("update").option("checkpointLocation", f"{tmp_path}/{idle}").trigger(availableNow=True).start()
        query.awaitTermination()
        sizes[idle] = [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress]
    assert max(sizes["5"]) >= 5 and sizes["5"][-1] == 1 and sizes[None][-1] == 6


def test_replacement_that_fails_leaves_the_old_table(spark, tmp_path, monkeypatch):
    from tidewire.operators import catalogue as K

    path = f"file://{tmp_path}/t"
    read = lambda: sorted(r.id for r in K.read_table(spark, path).collect())
    for n in (1, 2, 3):
        K.replace_table(spark.range(n), path)
        assert read() == list(range(n))
    assert len(K._generations(spark, path)) == 2  # the live one, and the one before for running readers
    generations = K._generations
    calls = []

    def failing(s, p):
        calls.append(p)
        if len(calls) == 2:
            raise OSError("the driver is lost between write and commit")
        return generations(s, p)

    monkeypatch.setattr(K, "_generations", failing)
    with pytest.raises(OSError):
        K.replace_table(spark.range(9), path)
    monkeypatch.setattr(K, "_generations", generations)
    assert read() == [0, 1, 2]
    K.replace_table(spark.range(4), path)
    assert read() == [0, 1, 2, 3]
    with pytest.raises(FileNotFoundError):
        K.read_table(spark, f"file://{tmp_path}/nothing")


def test_vector_pairs_equal_all_pairs(spark):
    rnd = np.random.default_rng(8)
    v = rnd.normal(size=(300, 6))
    v /= np.linalg.norm(v, axis=1)[:, None]
    rows = spark.createDataFrame([(i * 7, x.tolist()) for i, x in enumerate(v)] + [(-1, None)], "id bigint, v array<double>")
    want = {(i * 7, j * 7) for i in range(300) for j in range(i + 1, 300) if v[i] @ v[j] >= 0.5}
    for size in (1000, 64, 50):
        got = [(r.a, r.b) for r in Y.vector_pairs(rows, "id", "v", 0.5, size).collect()]
        assert len(got) == len(set(got)) and set(got) == want


def test_semantic_dedup_query_has_no_time_band(spark):
    from tidewire.plans import text_queries as Q
    from tidewire.sources import views as V

    sf = "/root/testdata/sf0.1"
    rows = Q._vector_articles(spark, sf).where("id < 3000").select("id", "source_name", "embedding").orderBy("id").collect()
    weight = {r["name"]: r["weight"] for r in V.doc_sources(spark, sf).collect()}
    v = np.array([r.embedding for r in rows])
    cosine = v @ v.T
    source = np.array([r.source_name for r in rows])
    similar = cosine >= np.where(source[:, None] == source[None, :], 0.35, 0.40)
    pairs = {(int(i), int(j)) for i, j in zip(*np.nonzero(np.triu(similar, 1)))}
    assert any(j - i > 411 for i, j in pairs)
    want = {rows[k].id for k in D.keep_anchored(list(range(len(rows))), [weight.get(s, 0.5) for s in source], pairs)}
    some = spark.createDataFrame([tuple(r) for r in rows], "id bigint, source_name string, embedding array<float>")
    for finish in (0, 200_000):
        got = [r.id for r in D.semantic_dedup(some, V.doc_sources(spark, sf), 0.35, 0.40, finish).collect()]
        assert len(got) == len(want) and set(got) == want


def test_semantic_dedup_of_equal_vectors(spark):
    rnd = random.Random(9)
    shapes = [[1.0, 0.0], [0.6, 0.8], [0.99, 0.14106735979665885], [-1.0, 0.0]]
    rows = [(i, rnd.choice(["a", "b", "c", None]), shapes[rnd.choice([0, 0, 1, 2, 3])]) for i in range(40)]
    weight = {"a": 0.2, "b": 0.9}
    similar = {(i, j) for i, s, x in rows for j, t, y in rows if i < j and x[0] * y[0] + x[1] * y[1] >= (0.58 if s == t and s is not None else 0.95)}
    want = {rows[k][0] for k in D.keep_anchored(list(range(40)), [weight.get(s, 0.5) for _, s, _ in rows], similar)}
    for finish in (0, 1000):
        got = D.semantic_dedup(spark.createDataFrame(rows, "id bigint, source_name string, embedding array<double>"), spark.createDataFrame(list(weight.items()), "name string, weight double"), 0.58, 0.95, finish)
        assert sorted(r.id for r in got.collect()) == sorted(want)


def resolved_by_pairs(cards, centroids, least=0.73):
    """D23 pair by pair, as the rule is told: each shown card meets all later ones."""
    for i, left in enumerate(cards):
        for j in range(i + 1, len(cards)):
            right = cards[j]
            if left.action == "suppressed":
                break
            if right.action == "suppressed":
                continue
            shared = bool({u for u, _ in left.articles} & {u for u, _ in right.articles})
            cosine = float(np.dot(centroids[i], centroids[j])) if centroids[i] is not None and centroids[j] is not None else -1.0
            reason, confidence = ("shared_article_url", 0.95) if shared else ("embedding_similarity", cosine)
            if not shared and cosine < least:
                continue
            if left.family and left.family == right.family and not shared and not (cosine >= 0.9 and len(set(left.sources) & set(right.sources)) >= 2):
                continue
            first = left.positive if left.positive != right.positive else (left.composite, len(left.groups), len(left.sources), left.new) >= (right.composite, len(right.groups), len(right.sources), right.new)
            (left if first else right).take(right if first else left, reason, confidence)
    return cards


def states(cards):
    return [(c.id, c.action, c.reason, c.confidence, c.into, c.articles, c.sources, c.groups) for c in cards]


@pytest.mark.parametrize("seed", range(6))
def test_displayed_cards_equal_the_rule_pair_by_pair(seed):
    rnd = random.Random(seed)
    views = ["Oil is dear", "oil is dear!", "The ministry rejects it", "No distinct perspective could be extracted", "Rain falls on the coast again"]

    def card(i):
        own = [(f"u{rnd.randrange(60)}", rnd.choice("abcd")) for _ in range(rnd.randint(0, 3))]
        return U.Card(i, rnd.choice([0.2, 0.4, 0.4, 0.9]), rnd.random() < 0.5, rnd.choice([None, "f", "g"]), rnd.random() < 0.1, own, list(dict.fromkeys(x for _, x in own)), [([rnd.choice("abcde")], rnd.choice(views)) for _ in range(rnd.randint(0, 3))])

    cards = [card(i) for i in range(60)]
    centroids = [None if rnd.random() < 0.1 else np.array([np.cos(x), np.sin(x)]) for x in (rnd.choice([rnd.random() * 6.28, 0.5]) for _ in cards)]
    got, want = U.resolve(copy.deepcopy(cards), centroids), resolved_by_pairs(copy.deepcopy(cards), centroids)
    assert states(got) == states(want) and any(c.action == "merged" for c in got)


@pytest.mark.parametrize(
    "left, right, cosine, kept",
    [
        ({"composite": 0.8, "articles": [("u", "a")]}, {"composite": 0.6, "articles": [("u", "b")]}, 0.0, [0]),
        ({"composite": 0.8}, {"composite": 0.6}, 0.99, [0]),
        ({"composite": 0.6}, {"composite": 0.6}, 0.748, [0]),
        ({"composite": 0.8}, {"composite": 0.6}, 0.64, [0, 1]),
        ({"composite": 0.6}, {"composite": 0.8}, 0.75, [1]),
        ({"composite": 0.9, "family": "f"}, {"composite": 0.85, "family": "f"}, 0.99, [0, 1]),
        ({"composite": 0.9, "family": "f", "articles": [("u", "a")]}, {"composite": 0.85, "family": "f", "articles": [("u", "a")]}, 0.1, [0]),
        ({"composite": 0.9, "family": "f", "sources": ["a", "b", "c"]}, {"composite": 0.8, "family": "f", "sources": ["c", "b"]}, 0.95, [0]),
        ({"composite": 0.9, "family": "f", "sources": ["a", "b"]}, {"composite": 0.8, "family": "f", "sources": ["b", "c"]}, 0.95, [0, 1]),
        ({"composite": 0.9, "family": "f"}, {"composite": 0.8, "family": "g"}, 0.95, [0]),
        ({"composite": 0.9}, {"composite": 0.1, "positive": True}, 0.95, [1]),
        ({"composite": 0.4, "groups": [(["a"], "x")]}, {"composite": 0.4, "groups": [(["a"], "x"), (["b"], "y")]}, 0.95, [1]),
        ({"composite": 0.4}, {"composite": 0.4, "new": True}, 0.95, [1]),
    ],
)
def test_displayed_pairs(left, right, cosine, kept):
    cards = [U.Card(0, **copy.deepcopy(left)), U.Card(1, **copy.deepcopy(right))]
    U.resolve(cards, [np.array([1.0, 0.0]), np.array(unit(cosine))])
    assert [c.id for c in cards if c.action != "suppressed"] == kept


def test_merged_cards_take_articles_sources_and_views():
    a, b = "报道地震灾情及伤亡情况，关注救援进展和余震风险。", "报道地震伤亡及救援进展，关注余震风险。"
    left = U.Card(1, 0.9, articles=[("u", "Reuters"), ("v", "Reuters")], sources=["Reuters"], groups=[(["Reuters"], a)])
    right = U.Card(2, 0.8, articles=[("u", "AFP"), ("w", "BBC")], sources=["AFP", "BBC"], groups=[(["BBC"], b)])
    U.resolve([left, right], [None, None])
    assert left.articles == [("u", "Reuters"), ("v", "Reuters"), ("w", "BBC")] and left.sources == ["Reuters", "BBC"] and left.groups == [(["Reuters", "BBC"], a)]
    assert (left.action, right.action, right.into, left.reason, left.confidence) == ("merged", "suppressed", 1, "shared_article_url", 0.95)


def test_displayed_query_equals_the_rule_pair_by_pair(spark):
    from tidewire.plans import payload_queries as Q

    sf = "/root/testdata/sf0.001"
    rows = Q.displayed(spark, sf).orderBy("report", "place", "id").collect()
    want = []
    for report in sorted({r.report for r in rows}):
        own = [r for r in rows if r.report == report]
        cards = [U.Card(r.id, r.composite, r.new, r.family, r.positive, [(x.url, x.source) for x in r.articles], list(r.sources), [(list(g.sources), g.perspective) for g in r.groups]) for r in own]
        want += states(resolved_by_pairs(cards, [None if r.centroid is None else np.array(r.centroid) for r in own]))
    got = Q.QUERIES["d23_display_dedup"](spark, sf).collect()
    assert sorted((r.id, r.action, r.reason, r.confidence, r.into, r.urls, r.sources, [(g.sources, g.perspective) for g in r.groups]) for r in got) == sorted((*w[:5], [u for u, _ in w[5]], w[6], w[7]) for w in want)
    assert {r.action for r in got} == {"kept", "merged", "suppressed"}


def unit(cosine):
    return [cosine, (1 - cosine * cosine) ** 0.5]


def test_event_edges_below_the_strong_bar_need_like_titles(spark):
    data = [(1, "Markets rally on rates", unit(1.0)), (2, "Something else", unit(0.8)), (3, "Markets rally on rate cut", unit(0.8)), (4, "Unlike words", unit(0.9)), (5, None, unit(-0.5))]
    rows = spark.createDataFrame(data, "id bigint, title string, embedding array<double>").withColumn("published_at", F.lit("2024-01-01").cast("timestamp"))
    grams = lambda t: {c[i : i + 3] for c in ["".join((t or "").lower().split())] for i in range(len(c) - 2)}
    want = set()
    for i, t, x in data:
        for j, u, y in data:
            cosine, a, b = x[0] * y[0] + x[1] * y[1], grams(t), grams(u)
            if i < j and cosine >= 0.72 and (cosine >= 0.86 or (a and b and len(a & b) / len(a | b) >= 0.12)):
                want.add((i, j))
    assert (1, 2) not in want and (1, 3) in want
    assert {(r.a, r.b) for r in C.event_edges(rows).collect()} == want


def test_validate_cluster_by_titles(spark):
    like, far = unit(1.0), unit(-0.9)
    data = [(1, 1, like, "Markets rally"), (1, 2, like, "Markets rally on"), (1, 3, far, "Quite another"), (1, 4, like, "Markets rally now"),
            (2, 1, like, "Markets rally"), (2, 2, like, "Markets rally on"), (2, 3, far, "Markets rally too"), (2, 4, like, "Markets"),
            (3, 1, like, "Abcdef"), (3, 2, unit(0.3), "Uvwxyz"), (4, 1, like, "Abcdef"), (4, 2, unit(0.3), "Abcdeg"), (5, 1, like, "Abcdef"), (6, 1, like, "Abcdef"), (6, 2, unit(0.55), "Uvwxyz")]
    rows = spark.createDataFrame(data, "c bigint, id bigint, v array<double>, title string")
    got = {(r.c, r.id) for r in C.validate_cluster(rows, "c", "id", "v", 0.58, "title").where("outlier").collect()}
    assert got == {(1, 3), (3, 1), (3, 2)}


def test_token_set_query_reads_whole_texts(spark):
    from tidewire.plans import text_queries as Q
    from tidewire.sources import views as V

    sf = "/root/testdata/sf0.001"
    text = {r["doc_id"]: r["text"] for r in V.table(spark, sf, "documents").select("doc_id", "text").collect()}
    before, want = {}, {}
    for r in V.articles(spark, sf).select("id", "source_name").orderBy("id").collect():
        want[r.id] = round(Y.token_set_ratio(text[r.id], text.get(before.get(r.source_name))), 4)
        before[r.source_name] = r.id
    got = {r.id: r.score for r in Q.QUERIES["d06_token_set_ratio"](spark, sf).collect()}
    assert got == pytest.approx(want, abs=1e-3)


def test_labels_of_one_report_differ(spark):
    from tidewire.operators import labels as B

    families = spark.createDataFrame([(1, 1, 10, "关税战", None, "关税战"), (1, 2, 11, "专题：关税战", None, "钢铁 关税"), (1, 3, 12, "关税战", None, "关税战"), (1, 4, 13, "关税战", None, "钢铁关税"), (2, 1, 14, "关税战", None, None)], "report int, place int, family bigint, name string, name_en string, storyline_name string")
    members = spark.createDataFrame([(10, 1, None, "头条甲"), (11, 1, None, "头条乙"), (12, 1, "小题", "头条丙"), (13, 1, None, "关税战"), (14, 1, None, "头条戊")], "family bigint, pos int, short_name string, headline string")
    got = {r.family: r.label for r in B.repaired(families, members).collect()}
    assert got == {10: "关税战", 11: "钢铁关税", 12: "小题", 13: "关税战：关税战", 14: "关税战"}


def test_configuration(spark, tmp_path):
    from tidewire.sources import config as C

    (tmp_path / "c.json").write_text('{"sources": [{"name": "A", "name_en": "A", "url": "u", "weight": 2}, {"name": "B", "name_en": "B", "url": "v", "enabled": false}]}')
    rows = C.sources(spark, C.read(str(tmp_path / "c.json"))).collect()
    assert [(r.name, r.weight, r.tier, r.ownership) for r in rows] == [("A", 2.0, "tech", "state_influenced_review")]
    assert C.read(str(tmp_path / "missing.json"), {}) == {}
    assert C.keywords("lost\n# AI & LLM\nmodel\n chip \n\nlost too\n# Space\n") == {"AI & LLM": ["model", "chip"], "Space": []}
    merged = C.merged_bindings({"source_verdicts": {"a.example": {"verdict": "x"}, "b.example": {"verdict": "y"}}}, {"source_verdicts": {"a.example": {"verdict": "official_web", "region": "us"}}})
    assert [(r.domain, r.verdict) for r in C.bindings(spark, merged).collect()] == [("a.example", "official_web"), ("b.example", "y")]


def test_retries():
    from tidewire.streaming import streams as R

    calls, pauses = [], []

    def send():
        calls.append(1)
        if len(calls) < 3:
            raise OSError("busy")

    assert R.retried(send, 3, 5.0, pauses.append) == 3 and pauses == [5.0, 5.0]
    with pytest.raises(OSError):
        R.retried(lambda: (_ for _ in ()).throw(OSError("down")), 2, 1.0, pauses.append)
