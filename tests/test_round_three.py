"""Cases of the third review: bars and ties as the SQL has them, streams without loss, whole searches."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewire.operators import scoring as S


def test_composite_at_the_bar_multiplies_before_it_divides(spark):
    rows = [(0.575, 1.0, 2.75, 1.0, 8.0, 1.0), (0.575, 3.0, 2.75, 0.0, 4.0, 3.0)]
    kinds = "signal double, scope double, severity double, novelty double, actor_influence double, decision_relevance double"
    dims = {d: F.lit(0.0) if d == "feelgood" else F.col(d) for d in S.DIMENSIONS}
    got = [r.c for r in spark.createDataFrame(rows, kinds).select(S.composite(dims, F.col("signal"), S.weights(spark)).alias("c")).collect()]
    want = [0.24 * s + 0.16 * a / 10 + 0.16 * b / 10 + 0.12 * c / 10 + 0.14 * d / 10 + 0.18 * e / 10 for s, a, b, c, d, e in rows]
    assert got == want and all(c < S.REVIEW_FLOOR for c in got)


def test_top_window_ties_are_those_of_the_scores_put_out(spark, tmp_path):
    from tidewire.plans import news_queries as Q

    prices = [(i, 1, "F", 250000.0 + i * 0.001, "1-URGENT") for i in range(200)]
    spark.createDataFrame(prices, "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, o_orderpriority string").withColumn("o_orderdate", F.lit("2024-01-01").cast("timestamp")).write.parquet(f"{tmp_path}/orders.parquet")
    spark.createDataFrame([(1, 0)], "c_custkey bigint, c_nationkey int").write.parquet(f"{tmp_path}/customer.parquet")
    spark.createDataFrame([(k, f"N{k}") for k in range(25)], "n_nationkey int, n_name string").write.parquet(f"{tmp_path}/nation.parquet")
    assert sorted(r.evaluation_id for r in Q.QUERIES["t01_top_window"](spark, str(tmp_path)).collect()) == list(range(90))


def test_distinct_stream_keeps_what_comes_late(spark, tmp_path, monkeypatch):
    from tidewire.plans import text_queries as Q
    from tidewire.streaming import streams as R

    rows = [(d * 10 + u, u + 100 * d, "x", d) for d in range(4) for u in range(10)]
    events = spark.createDataFrame(rows, "event_id bigint, user_id bigint, event_type string, day int")
    events.select("event_id", "user_id", "event_type", F.timestamp_seconds(F.lit(1704067200) + F.col("day") * 86400).alias("ts")).write.parquet(f"{tmp_path}/events.parquet")

    def newest_first(rows, files):
        root = f"{tmp_path}/in"
        for day in (3, 2, 1, 0):
            rows.where(F.dayofmonth("ts") == day + 1).coalesce(1).write.mode("append").parquet(root)
        return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(root)

    monkeypatch.setattr(R, "in_batches", newest_first)
    got = sorted(map(tuple, Q.QUERIES["x02_distinct_stream"](spark, str(tmp_path)).collect()))
    assert got == sorted((u, t) for _, u, t, _ in rows)


def test_hashed_vector_computes_its_words_once(spark):
    """In time: 20,000 texts of a hundred words; words were extracted anew for every slot of every slot."""
    import time
    import zlib

    from tidewire.operators import editions as N

    words = [f"w{i}" for i in range(100)]
    rows = spark.range(20_000).select("id", F.when(F.col("id") % 50 == 0, F.lit(" ,")).otherwise(F.concat_ws(" ", *[F.lit(w) for w in words], F.concat(F.lit("x"), (F.col("id") % 7).cast("string")))).alias("t"))
    start = time.monotonic()
    got = {r.id: r.v for r in rows.select("id", N.hashed_vector(F.col("t")).alias("v")).where("id % 997 = 0 OR element_at(v, 1) < 0").collect()}
    assert time.monotonic() - start < 60
    for i, v in got.items():
        want = np.bincount([zlib.crc32(w.encode()) % 64 for w in [*words, f"x{i % 7}"]], minlength=64).astype(float)
        assert v is None if i % 50 == 0 else v == pytest.approx(want / np.sqrt(want @ want), abs=1e-15)
    assert len(got) == 21


@pytest.mark.parametrize("block_rows", [7, 1000])
def test_nearest_history_searches_the_days_before_in_a_grid(spark, monkeypatch, block_rows):
    """Rows travel once to a grid of blocks; every query meets every row of its window, however days are cut."""
    from tidewire.operators import history as H
    from tidewire.operators import similarity as Y

    rng = np.random.default_rng(5)
    vectors = rng.normal(size=(60, 6)).astype(np.float32)
    vectors[7] = vectors[3]
    day = [int(x) for x in rng.integers(0, 9, 60)]
    rows = spark.createDataFrame([(i, d, v.tolist()) for i, (d, v) in enumerate(zip(day, vectors, strict=True))], "id bigint, n int, vector array<float>").withColumn("day", F.date_add(F.lit("2024-01-01").cast("date"), F.col("n")))
    monkeypatch.setattr(H, "best_matches", lambda *a, **k: Y.best_matches(*a, **k, block_rows=block_rows))
    got = {r.id: (r.h_id, r.cosine) for r in H.nearest_history(rows, rows.select(F.col("id").alias("h_id"), F.col("day").alias("h_day"), "vector")).collect()}
    cosine = vectors.astype(float) @ vectors.astype(float).T
    want = {}
    for i in range(60):
        met = [(cosine[i, j], -j) for j in range(60) if 1 <= day[i] - day[j] <= 3 and cosine[i, j] > 0]
        if met:
            want[i] = -max(met)[1]
    assert {i: h for i, (h, _) in got.items()} == want
    assert all(c == pytest.approx(cosine[i, h]) for i, (h, c) in got.items())


def test_best_history_query_searches_all_rows(spark):
    """Every row asks, and every other keyed row may answer."""
    from tidewire.plans import store_queries as Q

    sf = "/root/testdata/sf0.001"
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").orderBy("vec_id").collect()
    want = set()
    for c in rows:
        for h in rows:
            shared, named = c.vec_id % 5 < 2 and h.vec_id % 5 < 2, h.vec_id % 5 < 2
            if h.vec_id != c.vec_id and h.vec_id % 7 and h.label is not None and (shared or not named) and np.dot(np.array(c.embedding, float), np.array(h.embedding, float)) >= (0.25 if shared else 0.3):
                want.add(c.vec_id)
    assert {r.id for r in Q.QUERIES["j14_best_history"](spark, sf).collect()} == want


def test_semantic_dedup_writes_no_pairs(spark, monkeypatch):
    """A thousand rows that are all close to each other, and as many that are not, in several rounds: what is written grows with the rows."""
    from tidewire.operators import dedup as D

    rng = np.random.default_rng(3)
    close = np.array([1.0, 0, 0, 0, 0, 0, 0, 0]) + 0.05 * rng.normal(size=(1000, 8))
    vectors = np.concatenate([close, rng.normal(size=(1000, 8))])[rng.permutation(2000)]
    vectors /= np.linalg.norm(vectors, axis=1)[:, None]
    rows = [(i, rng.choice(["a", "b"]).item(), v.tolist()) for i, v in enumerate(vectors)]
    written = []
    plain = D.materialise
    monkeypatch.setattr(D, "materialise", lambda df: written.append(plain(df)) or written[-1])
    weight = {"a": 0.2, "b": 0.9}
    got = D.semantic_dedup(spark.createDataFrame(rows, "id bigint, source_name string, embedding array<double>"), spark.createDataFrame(list(weight.items()), "name string, weight double"), 0.6, 0.7, 256)
    source = np.array([s for _, s, _ in rows])
    similar = vectors @ vectors.T >= np.where(source[:, None] == source[None], 0.6, 0.7)
    pairs = {(int(i), int(j)) for i, j in zip(*np.nonzero(np.triu(similar, 1)))}
    assert sorted(r.id for r in got.collect()) == sorted(D.keep_anchored(list(range(2000)), [weight[s] for s in source], pairs))
    assert all(df.count() <= 2000 for df in written) and len(pairs) > 400_000


def _exchanges(df) -> int:
    plan = df._jdf.queryExecution().executedPlan().toString()
    return plan.count("Exchange hashpartitioning") + plan.count("Exchange SinglePartition")


def test_cluster_sums_shuffle_their_members_once(spark):
    from tidewire.operators import assembly as B
    from tidewire.sources import views as V

    sf = "/root/testdata/sf0.001"
    sources = F.broadcast(V.sources(spark, sf).withColumnRenamed("name", "source_name"))
    met = V.members(spark, sf).join(sources, "source_id").withColumn("searched", F.lit(False)).withColumn("official", F.lit(False))
    assert _exchanges(S.signal(met)) == 1
    assert _exchanges(B.summary_counts(V.search_articles(spark, sf))) == 1


def test_cluster_order_has_no_window_over_all(spark):
    from tidewire.plans import store_queries as Q

    placed = Q.QUERIES["t06_cluster_order"](spark, "/root/testdata/sf0.001")
    assert "Window" not in placed._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(r.place for r in placed.collect()) == list(range(1, placed.count() + 1))


def test_displayed_reports_share_a_call_by_their_summaries(spark):
    from tidewire.operators import displayed as U

    rows = spark.range(64 * 500).select((F.col("id") % 64).alias("report"), "id")
    n = U.heaps(rows)
    calls = rows.groupBy(F.pmod(F.xxhash64("report"), F.lit(n)).alias("heap")).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0]
    assert calls <= 5 * U.SHARED_ROWS
    assert U.heaps(rows.limit(10)) == 1


@pytest.mark.parametrize("block_rows", [5, 1000])
def test_mean_overlaps_by_blocks_equal_all_pairs(spark, block_rows):
    from tidewire.operators import clustering as C

    rnd = random.Random(8)
    rows = [(k % 3 if k else 9, k, sorted({rnd.choice("abcdefgh") for _ in range(rnd.randint(0, 5))})) for k in range(60)]
    known = spark.createDataFrame(rows, "c int, id bigint, g array<string>")
    got = {r.id: r.o for r in C.mean_overlaps(known.where("id % 2 = 0"), known, "c", "id", block_rows).collect()}
    want = {}
    for c, k, g in rows:
        others = [set(h) for d, m, h in rows if d == c and m != k]
        if k % 2 == 0 and others:
            want[k] = sum(len(set(g) & h) / max(len(set(g) | h), 1) for h in others) / len(others)
    assert got == pytest.approx(want)


def test_history_search_writes_no_vectors(spark, monkeypatch):
    from tidewire.operators import history as H
    from tidewire.operators import similarity as Y

    written = []
    plain = Y.materialise
    monkeypatch.setattr(Y, "materialise", lambda df: written.append(df.columns) or plain(df))
    rows = spark.createDataFrame([(i, i % 3, [1.0, float(i)]) for i in range(9)], "id bigint, n int, vector array<float>").withColumn("day", F.date_add(F.lit("2024-01-01").cast("date"), F.col("n")))
    assert H.nearest_history(rows, rows.select(F.col("id").alias("h_id"), F.col("day").alias("h_day"), "vector")).count() == 6
    assert written == [["heap", "rows", "columns"]]


def test_report_payload_members_travel_once_and_reports_are_written_small(spark, tmp_path, monkeypatch):
    """k06: members and groups are shuffled as keys, once each; the reports on disk are a fraction of their text."""
    import gzip
    import pathlib

    from tidewire.plans import assembly_queries as Q

    sf = "/root/testdata/sf0.001"
    assert _exchanges(Q.QUERIES["r05_perspective_payload"](spark, sf)) == 2
    monkeypatch.setattr("tidewire.runtime.scratch_root", lambda spark: f"file://{tmp_path}")
    assert Q.QUERIES["k06_report_payload"](spark, sf).count() == spark.read.parquet(f"{sf}/orders.parquet").count()
    files = list(pathlib.Path(tmp_path).glob("reports-*/part-*"))
    assert files and all(f.name.endswith(".gz") for f in files)
    assert sum(f.stat().st_size for f in files) * 4 < sum(len(gzip.decompress(f.read_bytes())) for f in files)


def test_issue_histogram_computes_issues_once(spark):
    """a09: each pattern stands once in the plan; a plain explode, and lists that use a text several times, computed them anew."""
    from tidewire.operators import grounding as G
    from tidewire.plans import intake_queries as Q

    plan = Q.QUERIES["a09_issue_histogram"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    rows = spark.createDataFrame([("**Head**\nA body of more than twenty letters.",)], "t string").select(G.text_issues(F.col("t")).alias("i"))
    assert rows._jdf.queryExecution().optimizedPlan().toString().count("regexp_replace(") <= 4
    assert "size(" not in plan
    odd = [("",), (None,), ("  ",), ("12人。",), ("A long enough body of text, it is. 7 %!",), ("**H**\n3人。 A body of more than twenty letters",)]
    got = [r.i for r in spark.createDataFrame(odd, "t string").select(G.text_issues(F.col("t")).alias("i")).collect()]
    assert got == [[], [], ["empty_summary"], ["summary_body_too_short", "leading_numeric_fragment", "orphan_numeric_fragment"], ["orphan_numeric_fragment"], ["leading_numeric_fragment", "orphan_numeric_fragment"]]


def titles_of_one_source(n, seed):
    rnd = random.Random(seed)
    words = ["".join(rnd.choice("etaoinshrdlu") for _ in range(rnd.randint(2, 8))) for _ in range(300)]
    return [" ".join(rnd.choice(words) for _ in range(9))[:60].strip() for _ in range(n)]


def test_fuzzy_edges_by_blocks_equal_all_pairs(spark):
    from tidewire.operators import dedup as D
    from tidewire.operators import similarity as Y

    rnd = random.Random(5)
    base = [*titles_of_one_source(6, 1), " ".join(titles_of_one_source(2, 2)), "日本の経済", "", "x"]
    rows = []
    for i in range(150):
        own = list(rnd.choice(base))
        for _ in range(rnd.randint(0, 3)):
            own.insert(rnd.randint(0, len(own)), rnd.choice("aeZ 9ß日"))
        rows.append((i, [f"s{i % 2}", None][i % 29 == 0], None if i % 31 == 0 else "".join(own)))
    frame = spark.createDataFrame(rows, "id bigint, source_name string, title string")
    want = [(i, j) for i, s, t in rows for j, u, v in rows if i < j and s and s == u and Y.indel_ratio(t, v) >= 85]
    assert any(len(rows[i][2]) > Y.WORD_BITS for i, _ in want)
    for size in (16, 4096):
        assert sorted(map(tuple, D.fuzzy_edges(frame, 85.0, size).collect())) == want
    similar = set(want)
    weights = spark.createDataFrame([("s0", 0.9)], "name string, weight double")
    kept = D.keep_fuzzy(list(range(150)), [0.5] * 150, similar)
    assert sorted(r.id for r in D.fuzzy_dedup(frame, weights).collect()) == sorted(kept)


def test_fuzzy_dedup_of_a_large_source(spark):
    """In time: 8,000 titles of one source, each pair of which was compared by expressions."""
    import time

    from tidewire.operators import dedup as D

    titles = titles_of_one_source(8_000, 3)
    frame = spark.createDataFrame([(i, t, "s") for i, t in enumerate([*titles, *titles[:50], *(t + "s" for t in titles[:50])])], "id bigint, title string, source_name string")
    start = time.monotonic()
    got = {r.id for r in D.fuzzy_dedup(frame, spark.createDataFrame([("s", 0.9)], "name string, weight double")).collect()}
    assert time.monotonic() - start < 40
    assert len(got) > 7_000 and not got & set(range(8_000, 8_100))


def shuffled(spark):
    executors = spark.sparkContext._jsc.sc().statusStore().executorList(False)
    return sum(executors.apply(i).totalShuffleWrite() for i in range(executors.size()))


def test_ngram_pairs_shuffle_rows_and_no_pairs(spark):
    """d04: candidates were shuffled, and joined with both sides' grams."""
    from tidewire.operators import similarity as Y

    titles = titles_of_one_source(40, 4)
    rnd = random.Random(6)
    rows = [(i, f"b{i % 2}" if i % 37 else None, rnd.choice(["", None, "ab", "A-b", "a", "日本", "日本の経済"]) if i % 9 == 0 else rnd.choice(titles) + rnd.choice(["", "!", " again", " Zé"])) for i in range(900)]
    frame = spark.createDataFrame(rows, "id bigint, b string, t string")
    clean = ["".join(c for c in (t or "").lower() if c.isalnum() or c == "_") for _, _, t in rows]
    grams = [({c} if len(c) <= 3 else {c[i : i + 3] for i in range(len(c) - 2)}) if c else set() for c in clean]
    want = {}
    for i, a in enumerate(grams):
        for j in range(i + 1, len(rows)):
            if a and grams[j] and rows[i][1] and rows[i][1] == rows[j][1] and len(a & grams[j]) / len(a | grams[j]) >= 0.5:
                want[i, j] = len(a & grams[j]) / len(a | grams[j])
    for size in (128, 4096):
        before = shuffled(spark)
        got = {(r.k1, r.k2): r.overlap for r in Y.ngram_pairs(frame, "id", "t", "b", 0.5, **({} if size == 4096 else {"block_rows": size})).collect()}
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) <= 5.1e-5 for k in want)
    assert shuffled(spark) - before < 8 * len(want)


def test_compaction_of_alike_rows_writes_no_pairs(spark, tmp_path, monkeypatch):
    """d09: rows of a source that mostly resemble each other; all their pairs were written."""
    import pathlib

    import pyarrow.parquet as pq

    from tidewire.operators import dedup as D
    from tidewire.operators import similarity as Y

    rnd = np.random.default_rng(8)
    base = rnd.normal(size=(5, 8))
    heads = ["Storm hits the coast", "King visits Spain", "Exports fall in May", "日本の経済", None]
    rows = []
    for i in range(2000):
        v = None if i % 101 == 0 else [float("nan")] * 8 if i % 103 == 0 else [0.0] * 8 if i % 107 == 0 else [float(x) for x in (base[i % 5] + 0.5 * rnd.normal(size=8))[: 7 if i % 11 == 0 else 8]]
        rows.append((i, [None, "a", "a", "a"][i % 4], heads[int(rnd.integers(0, 5))], v, int(rnd.integers(0, 2000)), i % 13 != 0))
    docs = spark.createDataFrame(rows, "id bigint, source_name string, title string, embedding array<double>, at bigint, real boolean").withColumn("published_at", F.timestamp_seconds("at"))
    norm = {r[0]: np.linalg.norm(r[3]) for r in rows if r[3]}
    kept, want = [], {}
    for r in sorted(rows, key=lambda r: (-r[4], r[0])):
        able = r[5] and norm.get(r[0], 0) > 0
        met = able and next((k for k in kept if k[1] == r[1] and len(k[3]) == len(r[3]) and np.dot(k[3], r[3]) >= 0.3 * norm[k[0]] * norm[r[0]] and Y.token_set_ratio(k[2], r[2]) >= 30.0), None)
        want[r[0]] = met[0] if met else r[0]
        if able and met is None:
            kept.append(r)
    monkeypatch.setattr("tidewire.runtime.scratch_root", lambda spark: f"file://{tmp_path}")
    assert {r.id: r.representative for r in D.compacted_updates(docs, 0.3, 30.0).collect()} == want
    tables = [sum(pq.read_metadata(f).num_rows for f in d.glob("*.parquet")) for d in pathlib.Path(tmp_path).glob("tidewire-*")]
    assert tables and max(tables) <= len(rows)
    assert {r.id: r.representative for r in D.compacted_updates(docs, 0.3, 30.0, 200).collect()} == want


def test_resembled_compares_many_texts_at_once(spark):
    """j20, in time: 1,000 stories that no headline resembles; each candidate went through Python's numbers. Results are those of all pairs, also of texts beyond a machine word."""
    import time

    from tidewire.operators import similarity as Y
    from tidewire.operators import storyline as L

    rnd = random.Random(9)
    words = ["storm", "coast", "king", "Spain", "exports", "fall", "falls", "the", "a", "日本", "extraordinarily-long-token-of-letters"]
    text = lambda: " ".join(rnd.choice(words) + rnd.choice(["", "", "s"]) for _ in range(rnd.randint(0, 12)))
    asked, known = [text() for _ in range(200)], [text() for _ in range(60)]
    assert max(map(len, asked)) > Y.WORD_BITS
    for n, least in ((1, 30.0), (7, 60.0), (60, 75.0), (60, 100.0)):
        assert L.resembled(asked, known[:n], least) == [a for a in asked if any(Y.token_set_ratio(a, k) >= least for k in known[:n])]
    titles = titles_of_one_source(2_000, 10)
    start = time.monotonic()
    got = L.resembled(titles[:1000], titles[1000:], 76.0)
    assert time.monotonic() - start < 6
    some = titles[:1000:50]
    assert [t for t in got if t in some] == [t for t in some if any(Y.token_set_ratio(t, k) >= 76.0 for k in titles[1000:])]
