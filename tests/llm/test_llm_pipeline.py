"""The pipeline's stages on a small corpus, against what plain Python expects of each."""

import random

import pytest

import corpus_pipeline
from tidewire.llm import mixing
from tidewire.runtime import materialise


def test_stages(spark, tmp_path):
    rnd = random.Random(11)
    words = ["river", "stone", "cloud", "paper", "green", "window", "morning", "letter", "garden", "silver"]
    docs, labels = [], []
    for i in range(300):
        own = [rnd.choice(words) + rnd.choice(["", "s", "ed"]) for _ in range(rnd.randint(40, 120))]
        good = i % 5 != 0
        docs.append((i, " ".join(own) + "." if good else " ".join(w.upper() + "!!" for w in own), "en", f"s{i % 4}", 0))
        labels.append((i, int(good), 0))
    docs += [(1000 + i, docs[i][1] + " ", "en", "s0", 0) for i in (1, 2, 3)]  # longer originals of equal text
    docs += [(2000 + i, docs[i][1].replace(".", " more."), "en", "s1", 0) for i in (4, 6, 7)]
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    spark.createDataFrame(docs, schema).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    frames = [spark.read.parquet(f"{tmp_path}/documents.parquet")]
    for _, stage in corpus_pipeline.STAGES:
        frames.append(materialise(stage(spark, frames[-1], str(tmp_path))))
    ids = [{r.doc_id for r in f.collect()} for f in frames]
    assert all(f.columns == frames[0].columns for f in frames[:-1])
    assert ids[0] - ids[1] == {i for i in range(0, 300, 5)}
    assert ids[1] - ids[2] == {1, 2, 3}
    assert ids[2] - ids[3] == {2004, 2006, 2007}
    taken = {r.doc_id: r.taken for r in mixing.taken(frames[3]).collect()}
    size = {r.doc_id: len(r.text.split()) for r in frames[3].collect()}
    assert frames[4].count() == sum(t // size[i] for i, t in taken.items())
    assert frames[5].count() == frames[4].count()
    assert len(corpus_pipeline.STAGES) == 5


SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, id bigint, size string, `row` string, h string, digest string, copies string, score string"


def odd_docs(spark):
    """Null ids and texts, blank, repeated and very long rows, one id with two texts, clashing columns."""
    long = " ".join(f"w{k % 700}" for k in range(9_000))
    texts = [(1, "one two three four five six seven"), (1, "one two three four five six seven"), (1, "a text of its own words"), (2, None), (None, "no id"), (None, "no id"), (3, ""), (4, long), (5, long + " end"), (6, " \n"), (7, "é" * 200)]
    return spark.createDataFrame([(i, t, None if i == 2 else "en", None if i in (3, None) else f"s{(i or 0) % 2}", None, 7, "s", "r", "h", "d", "c", "x") for i, t in texts], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """A folder with odd documents and labels, one with empty tables."""
    out = []
    for name, docs in (("odd", odd_docs(spark)), ("none", spark.createDataFrame([], SCHEMA))):
        root = tmp_path_factory.mktemp(name)
        docs.write.mode("overwrite").parquet(f"{root}/documents.parquet")
        labels = [(i, int(i % 2 == 0), 0) for i in range(1, 8)] if name == "odd" else []
        spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.mode("overwrite").parquet(f"{root}/labels.parquet")
        out.append(str(root))
    return out


@pytest.mark.parametrize("number", range(5))
def test_each_stage_takes_odd_rows(spark, tables, number):
    name, stage = corpus_pipeline.STAGES[number]
    docs = spark.read.parquet(f"{tables[0]}/documents.parquet")
    got = materialise(stage(spark, docs, tables[0]))
    kept = [(r.doc_id, r.text) for r in got.collect()] if number < 4 else None
    if number < 4:
        assert got.columns == docs.columns
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    long = max((t or "" for _, t in rows), key=len)
    if name == "exact dedup":
        assert sorted((i or 0, t) for i, t in kept) == sorted([(1, rows_text(rows, 1, "one")), (1, "a text of its own words"), (0, "no id"), (4, long[:-4]), (5, long), (6, " \n"), (7, "é" * 200)])
    elif name == "near-duplicates":
        assert sorted(i or 0 for i, _ in kept) == [0, 0, 1, 1, 2, 3, 4, 6, 7]
    elif name == "source mix":
        assert set(kept) <= {r for r in rows if (r[1] or "").split()}
    elif number == 4:
        assert got.count() == len(rows) and {r.doc_id for r in got.where("n_tokens = 0").collect()} == {2, 3}
    none = spark.read.parquet(f"{tables[1]}/documents.parquet")
    assert stage(spark, none, tables[1]).count() == 0


def rows_text(rows, i, start):
    return next(t for k, t in rows if k == i and t.startswith(start))


def test_run_takes_odd_and_empty_tables(spark, tables):
    assert corpus_pipeline.run(spark, tables[0]).columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    assert corpus_pipeline.run(spark, tables[1]).count() == 0
