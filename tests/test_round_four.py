"""Cases of the fourth review: what travels and what a task holds at six gigabytes."""

import numpy as np
import pytest
from pyspark.sql import functions as F


@pytest.mark.parametrize("block_rows", [4, 32768])
def test_history_asks_each_vector_of_a_day_once(spark, monkeypatch, block_rows):
    """j15: rows of one day and vector ask and answer as one, and no vector travels with a row; answers are those of all pairs."""
    from tidewire.operators import history as H
    from tidewire.operators import similarity as Y

    rng = np.random.default_rng(11)
    vectors = rng.normal(size=(8, 6)).astype(np.float32)
    vectors[5] = vectors[2]
    day, vec = rng.integers(0, 7, 300).tolist(), rng.integers(0, 9, 300).tolist()  # vector 8 is missing
    rows = spark.createDataFrame([(i, d, v) for i, (d, v) in enumerate(zip(day, vec, strict=True))], "id bigint, n int, vec_id bigint").withColumn("day", F.date_add(F.lit("2024-01-01").cast("date"), F.col("n")))
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)] + [(9, [1.0, 2.0])], "vec_id bigint, vector array<float>")
    asked = []

    def search(queries, base, *a, **k):
        asked.append((queries.count(), base.count(), "v" in queries.columns + base.columns))
        return Y.best_matches(queries, base, *a, **k, block_rows=block_rows)

    monkeypatch.setattr(H, "best_matches", search)
    history = rows.where("id % 4 <> 0").select(F.col("id").alias("h_id"), F.col("day").alias("h_day"), "vec_id")
    near = H.nearest_of_vectors(rows, history, table)
    got = {r.id: (r.h_id, r.cosine) for r in rows.join(near, ["day", "vec_id"]).collect()}
    cosine = vectors.astype(float) @ vectors.astype(float).T
    want = {}
    for i in range(300):
        met = [(round(cosine[vec[i], vec[j]], 12), -j) for j in range(300) if j % 4 and 1 <= day[i] - day[j] <= 3 and vec[i] < 8 and vec[j] < 8 and cosine[vec[i], vec[j]] > 0]
        if met:
            want[i] = -max(met)[1]
    assert {i: h for i, (h, _) in got.items()} == want
    assert all(c == pytest.approx(cosine[vec[i], vec[h]]) for i, (h, c) in got.items())
    assert asked == [(len(set(zip(day, vec, strict=True))), len({(d, v) for i, (d, v) in enumerate(zip(day, vec, strict=True)) if i % 4}), False)]


def test_freshness_reads_old_sources_once_for_a_day_and_vector(spark, tmp_path, monkeypatch):
    """d21: sources of matches meet what was asked, not each cluster; and the whole result is that of the SQL."""
    import duckdb

    from tidewire.operators import history as H
    from tidewire.plans import text_queries as Q

    rng = np.random.default_rng(3)
    orders = [(i, int(rng.integers(1, 6)), "1-URGENT") for i in range(200)]
    lines = [(i, int(x)) for i, _, _ in orders if i % 13 for x in rng.integers(0, 3, 2)]
    spark.createDataFrame(orders, "o_orderkey bigint, n int, o_orderpriority string").withColumn("o_orderdate", F.date_add(F.lit("2024-01-01").cast("date"), F.col("n")).cast("timestamp")).drop("n").coalesce(1).write.parquet(f"{tmp_path}/orders.parquet")
    spark.createDataFrame(lines, "l_orderkey bigint, l_suppkey bigint").coalesce(1).write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(i, rng.normal(size=4).astype(np.float32).tolist()) for i in range(6)], "vec_id bigint, embedding array<float>").coalesce(1).write.parquet(f"{tmp_path}/embeddings.parquet")
    sides, plain = [], H.best_matches
    monkeypatch.setattr(H, "best_matches", lambda queries, base, *a, **k: sides.append((queries.count(), base.count())) or plain(queries, base, *a, **k))
    got = Q.QUERIES["d21_freshness"](spark, str(tmp_path))
    met = [line for line in got._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join LeftOuter" in line]
    con = duckdb.connect()
    for name in ("orders", "lineitem", "embeddings"):
        con.sql(f"CREATE VIEW {name} AS FROM '{tmp_path}/{name}.parquet/*.parquet'")
    want = con.sql(Q.ORACLE_SQL["d21_freshness"]).fetchall()
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)
    assert len({r[1] for r in want}) == 3 and max(max(s) for s in sides) <= 30
    assert len(met) == 1 and "vec_id" in met[0]


def test_report_parts_are_bounded_and_whole(spark):
    """k06: no document holds more cards than a part, and the parts' lists together are the report, with the numbers of the whole."""
    import json

    from tidewire.operators import report as R

    days = [(i, "2024-01-01" if i < 23 else None if i == 23 else "2024-01-02", ("hot", "main", "positive", None)[i % 4], ("f1", "f0")[i % 8 // 4] if i % 4 == 0 else None) for i in range(26)]
    rows = spark.createDataFrame(days, "cluster_id bigint, date string, lane string, family string").withColumns({"date": F.col("date").cast("date"), "place": -F.col("cluster_id"), "family_name": F.concat(F.lit("n"), F.col("cluster_id").cast("string"))})
    numbered = R.placed(rows, most=4).withColumn("card", F.struct("index", "cluster_id", F.lit(None).cast("string").alias("headline"), F.lit('a "b"\n中').alias("summary")))
    docs = [(r.date, json.loads(r.doc)) for r in R.report_payloads(numbered).collect()]
    in_day = lambda d: sorted((x for at, x in docs if str(at) == d), key=lambda x: x["part"])
    assert [len(in_day(d)) for d in ("2024-01-01", "2024-01-02", "None")] == [6, 1, 1]
    held = lambda x: [c for h in x["hot_topics"] for c in h["summaries"]] + x["clusters"] + x["positive_stories"]
    assert all(len(held(x)) <= 4 for _, x in docs)
    own = sorted((i for i, d, _, _ in days if d == "2024-01-01"), key=lambda i: (min((i % 4) or 0, 2), days[i][3] or "", -i))
    got = [c for x in in_day("2024-01-01") for c in held(x)]
    assert [c["cluster_id"] for c in got] == own and [c["index"] for c in got] == list(range(1, 24)) and got[0]["summary"] == 'a "b"\n中'
    assert {(x["total_cluster_count"], x["main_count"], x["positive_count"], x["parts"]) for x in in_day("2024-01-01")} == {(23, 6, 11, 6)}
    assert {(h["storyline_key"], h["storyline_name"], h["member_count"]) for x in in_day("2024-01-01") for h in x["hot_topics"]} == {("f0", "n20", 3), ("f1", "n16", 3)}


def test_report_payload_rows_do_not_depend_on_parts(spark, monkeypatch):
    """k06: keys of members travel once to their cluster and once to their day; cards are made there, and read again from any number of parts."""
    from tidewire.operators import report as R
    from tidewire.plans import assembly_queries as Q

    sf, plain, seen, parts = "/root/testdata/sf0.001", R.report_payloads, [], R.placed
    whole = sorted(map(repr, Q.QUERIES["k06_report_payload"](spark, sf).collect()))
    monkeypatch.setattr(R, "placed", lambda rows: parts(rows, 2))
    monkeypatch.setattr(R, "report_payloads", lambda rows: seen.append(plain(rows)) or seen[-1])
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert sorted(map(repr, Q.QUERIES["k06_report_payload"](spark, sf).collect())) == whole
        lines = seen[0]._jdf.queryExecution().executedPlan().toString().splitlines()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    dealt = [line for line in lines if "Exchange hashpartitioning(date" in line]
    assert len(dealt) == 1 and all(x not in line for x in ("summary", "headline", " articles#") for line in lines[lines.index(dealt[0]) :])
