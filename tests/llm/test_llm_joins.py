"""Set join, token alignment and importance resampling against brute force, and on odd tables."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidewire.llm import alignment, importance, registry, set_join

SF = "/root/testdata/sf0.001"
CLASHING = "doc_id bigint, text string, id string, row string, n string, h string, rank string, score string, node string, shingle string, pairs string, label string"


def clashing(rows):
    return [(i, t, *("x" * 10)) for i, t in rows]


@pytest.fixture(scope="module")
def odd(spark):
    rnd = random.Random(2)
    long = " ".join(rnd.choice(["alpha", "beta", "Gamma", "délta"]) for _ in range(15_000))
    rows = [(1, "one two three four five six seven"), (1, "one two three four five six seven"), (2, None), (None, "one two three four five six seven"), (3, ""), (4, long), (5, long + " end"), (6, " \n\t"), (7, "x"), (None, None), (8, "é" * 9000)]
    return rows, spark.createDataFrame(clashing(rows), CLASHING).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], CLASHING)


def plain(text):
    return (text or "").translate({k: k + 32 for k in range(65, 91)})


# --- the set join


def sets_of(rows):
    words = [re.findall(r"[^\x20\x09-\x0D]+", plain(t)) for _, t in rows]
    return [{tuple(w[k : k + 4]) for k in range(max(1, len(w) - 3))} if w else set() for w in words]


def linked(x, y):
    return bool(x) and bool(y) and 100 * len(x & y) >= 85 * len(x | y)


def brute_join(rows):
    sets, lead = sets_of(rows), list(range(len(rows)))

    def find(x):
        while lead[x] != x:
            x = lead[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if linked(sets[a], sets[b]):
                lead[find(a)] = find(b)
    least: dict = {}
    for a, (i, _) in enumerate(rows):
        least[find(a)] = min((x for x in (least.get(find(a)), i) if x is not None), default=None)
    return sorted(((i, len(sets[a]), least[find(a)]) for a, (i, _) in enumerate(rows)), key=str)


def families(seed):
    rnd = random.Random(seed)
    words = [f"w{i}" for i in range(300)]
    bases = [[rnd.choice(words) for _ in range(rnd.choice([5, 30, 60, 120]))] for _ in range(8)]
    rows = []
    for i in range(260):
        own = list(rnd.choice(bases))
        for _ in range(rnd.choice([0, 0, 1, 1, 2, 3, 5])):
            own[rnd.randrange(len(own))] = rnd.choice(words)
        if rnd.random() < 0.2:
            own = own[: rnd.randrange(1, len(own))]
        if rnd.random() < 0.1:
            own = [rnd.choice(words) for _ in range(40)] + bases[0][:20]
        rows.append((i, " ".join(own)))
    return [*rows, (500, None), (501, ""), (502, "one two"), (503, "ONE  two"), (504, "a b c d")]


@pytest.mark.parametrize("sizes", [{}, {"most_members": 8, "list_members": 4}, {"most_members": 3, "most_shingles": 400, "list_members": 2}])
def test_set_join_equals_all_pairs(spark, sizes):
    rows = families(sum(sizes.values()))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    assert sorted(map(tuple, set_join.joined(docs, **sizes).collect()), key=str) == brute_join(rows)


def test_search_finds_all_linked_sets():
    rnd = np.random.default_rng(3)
    base = rnd.integers(0, 1 << 40, 80).astype(np.uint64)
    sets = []
    for _ in range(120):
        own = base.copy()
        change = rnd.choice(80, rnd.integers(0, 14), replace=False)
        own[change] = rnd.integers(0, 1 << 40, len(change))
        sets.append(np.unique(own[: rnd.integers(60, 81)]))
    index = set_join.Index(np.concatenate(sets), np.append(0, np.cumsum([len(s) for s in sets])))
    plain_sets = [set(s.tolist()) for s in sets]
    for i, s in enumerate(sets):
        wanted = np.arange(len(sets)) != i
        assert index.search(s, wanted).tolist() == [j for j in range(len(sets)) if j != i and linked(plain_sets[i], plain_sets[j])]


def test_occurring_counts_long_lists_by_search():
    rnd = random.Random(5)
    for _ in range(50):
        lists = [np.array(sorted(rnd.sample(range(40), rnd.randint(1, 30))), np.int64) for _ in range(rnd.randint(1, 9))]
        counts = Counter(x for own in lists for x in own.tolist())
        least = rnd.randint(1, len(lists))
        number, count = set_join.occurring(lists, least)
        assert dict(zip(number.tolist(), count.tolist())) == {x: c for x, c in counts.items() if c >= least}


def test_needed_is_the_least_overlap():
    for x in range(1, 60):
        for y in range(1, 60):
            least = next((o for o in range(min(x, y) + 1) if 100 * o >= 85 * (x + y - o)), None)
            assert least is None or least == set_join.needed(x, y)
    assert all(set_join.listed(n) == n - -(-85 * n // 100) + 1 for n in range(1, 300))


def test_set_join_odd(odd, none):
    rows, docs = odd
    assert sorted(map(tuple, set_join.joined(docs).collect()), key=str) == brute_join(rows)
    assert set_join.joined(none).collect() == []


def test_set_join_query_on_tables(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    assert sorted(map(tuple, registry.QUERIES["op11_set_join"](spark, SF).collect()), key=str) == brute_join(rows)


# --- token alignment


@pytest.fixture(scope="module")
def both():
    tokenizers = pytest.importorskip("public_tokenizers")
    return tokenizers.path("byte_bpe_50k.json"), tokenizers.path("piece_bpe_32k.model"), tokenizers.PATTERN


TEXTS = ["", "ｆｕｌｌ wide", "a  b\n\n\tc", "<|endoftext|> x <0x41> <s>", "▁x", "日本語 text ☃️ 🎉🎉", "   ", " a", "a ", "ﬁ ligature", " nb", "x\u0000y", "It's naïve, isn't it? 12345"]


def brute_alignment(text, both):
    """n_a, n_b, groups and links of one text by the libraries themselves, token by token."""
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    nothing = (0, 0, [], [])
    if not text:
        return nothing
    a_coder, b_coder = Tokenizer.from_file(both[0]), SentencePieceProcessor(model_file=both[1])
    a_coder.encode_special_tokens = True
    letters = alignment.byte_letters()
    a, b = a_coder.encode(" " + text, add_special_tokens=False).ids, b_coder.encode(text)
    a_bytes = [bytes(letters[c] for c in a_coder.id_to_token(i)) for i in a]
    names = [b_coder.id_to_piece(i) for i in b]
    b_bytes = [bytes([int(n[3:5], 16)]) if b_coder.is_byte(i) else n.replace("▁", " ").encode() for n, i in zip(names, b)]
    if not b"".join(a_bytes) == b"".join(b_bytes) == (" " + text).encode():
        return nothing
    spans = []
    for parts in (a_bytes, b_bytes):
        ends = np.cumsum([len(p) for p in parts]).tolist()
        spans.append(list(zip([0, *ends[:-1]], ends)))
    groups, start = [], 0
    for end in sorted({e for _, e in spans[0]} & {e for _, e in spans[1]}):
        groups.append("|".join(",".join(str(i) for i, (x, y) in zip(ids, own) if x >= start and y <= end) for ids, own in ((a, spans[0]), (b, spans[1]))))
        start = end
    links = [(i, j) for i, (x, y) in zip(a, spans[0]) for j, (u, v) in zip(b, spans[1]) if max(x, u) < min(y, v)]
    return len(a), len(b), groups, links


def brute_digests(rows, both):
    own = [brute_alignment(t, both) for _, t in rows]
    held = Counter(link for *_, links in own for link in set(links))
    best: dict = {}
    for (a, _), n in held.items():
        best[a] = max(best.get(a, 0), n)
    return sorted(
        ((i, na, nb, len(g), len(k), sum(held[x] == best[x[0]] for x in k), sum(held[x] for x in k), hashlib.sha256(";".join(g).encode()).hexdigest() if g else "") for (i, _), (na, nb, g, k) in zip(rows, own)), key=str
    )


@pytest.mark.parametrize("held", [alignment.PAIRS_HELD, 60, 0])
def test_alignment_equals_brute_force(spark, both, held):
    texts = [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").limit(40).collect()]
    rows = list(enumerate([t[:600] if t else t for t in texts] + TEXTS + [None, TEXTS[2]]))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    assert sorted(map(tuple, alignment.digests(docs, *both, most=held).collect()), key=str) == brute_digests(rows, both)


def test_alignment_gives_groups_and_pairs(spark, both):
    docs = spark.createDataFrame([(1, TEXTS[5]), (2, None)], "doc_id bigint, text string")
    got = {r.id: r for r in alignment.alignments(docs, *both).collect()}
    _, _, groups, links = brute_alignment(TEXTS[5], both)
    assert got[1].groups == ";".join(groups) and got[2].groups == "" and got[2].pairs == b""
    pairs = np.frombuffer(got[1].pairs, "<i8")
    times = np.frombuffer(got[1].times, "<u4").tolist()
    assert Counter({(int(p) >> alignment.B_BITS, int(p) & (1 << alignment.B_BITS) - 1): n for p, n in zip(pairs, times)}) == Counter(links)


def test_alignment_odd(odd, none, both):
    rows, docs = odd
    some = [(i, t) for i, t in rows if len(t or "") < 5000]
    got = alignment.digests(docs.where("text IS NULL OR length(text) < 5000"), *both).collect()
    assert sorted(map(tuple, got), key=str) == brute_digests(some, both)
    everything = {r.doc_id: r for r in alignment.digests(docs, *both).collect()}
    assert everything[4].n_groups > 10_000 and everything[5].n_groups == everything[4].n_groups + 1
    assert alignment.digests(none, *both).collect() == []


def test_alignment_query_on_tables(spark, both):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = {r.doc_id: r for r in registry.QUERIES["op12_token_alignment"](spark, SF).collect()}
    assert set(got) == {i for i, _ in rows}
    for i, t in rows[:12]:
        if len(t or "") < 1500:
            na, nb, groups, links = brute_alignment(t, both)
            assert (got[i].n_a, got[i].n_b, got[i].n_groups, got[i].n_links) == (na, nb, len(groups), len(links))
    assert all(r.n_links == r.n_a + r.n_b - r.n_groups for r in got.values())


# --- importance resampling


def brute_resample(rows, target, runs=1, buckets=10_000, least=20, percent=10):
    def features(text):
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", plain(text))
        return len(words), [zlib.crc32(" ".join(words[i : i + k]).encode()) % buckets for k in range(1, runs + 1) for i in range(len(words) - k + 1)]

    own = [features(t) for _, t in rows]
    s, t = Counter(b for _, f in own for b in f), Counter(b for x in target for b in features(x)[1])
    more, most = sum(s.values()) + buckets, sum(t.values()) + buckets
    out = []
    for (i, _), (n, found) in zip(rows, own):
        weight = sum(math.floor(1000 * math.log((t[b] + 1) * more / ((s[b] + 1) * most))) for b in found)
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, n, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
    eligible = sorted((r for r in out if r[1] >= least), key=lambda r: (-r[4], 1 << 70 if r[0] is None else r[0], r[2]))
    for rank, r in enumerate(eligible[: percent * len(eligible) // 100], 1):
        r[5] = rank
    return sorted(((i, f, w, x, r) for i, _, f, w, x, r in out), key=str)


def resampled(docs, target, **options):
    return sorted(map(tuple, importance.resampled(docs, target, **options).select("doc_id", "n_features", "weight", "score", "rank").collect()), key=str)


@pytest.mark.parametrize("options", [{}, {"runs": 3, "percent": 37, "least_words": 5}, {"buckets": 7, "percent": 100, "least_words": 0}])
def test_resampling_equals_brute_force(spark, options):
    rnd = random.Random(len(options))
    words = ["Alpha", "beta", "gämma", "x1", "delta", "w" * 70, "Ω", "end"]
    rows = [(rnd.randrange(-200, 400), " ".join(rnd.choice(words) for _ in range(rnd.choice([0, 3, 19, 20, 21, 60]))) + rnd.choice(["", ".", "\n"])) for _ in range(400)] + [(None, "beta " * 30), (7, None)]
    target = ["alpha beta, alpha!", None, "x1"]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    goal = spark.createDataFrame([(t,) for t in target], "text string")
    want = brute_resample(rows, target, options.get("runs", 1), options.get("buckets", 10_000), options.get("least_words", 20), options.get("percent", 10))
    assert resampled(docs, goal, **options) == want


def test_radix_selection_takes_exactly_k(spark):
    rnd = random.Random(9)
    rows = [(rnd.choice([-5, 0, 3, 1 << 40, -(1 << 62), (1 << 63) - 1]), rnd.choice([1, 2, -(1 << 63)]), i) for i in range(300)]
    df = spark.createDataFrame(rows, "a bigint, b bigint, c bigint")
    for k in (1, 2, 57, 150, 299):
        assert sorted(map(tuple, df.where(importance.upto(df, ["a", "b", "c"], k)).collect())) == sorted(rows)[:k]


def test_crc32_of_spans():
    data = np.frombuffer(("a bc déf " + "x" * 200).encode(), np.uint8)
    spans = [(0, 1), (2, 4), (0, 0), (5, 9), (10, len(data))]
    got = importance.crc32(data, *(np.array(x) for x in zip(*spans)))
    assert got.tolist() == [zlib.crc32(data[a:b].tobytes()) for a, b in spans]


def test_resampling_odd(spark, odd, none):
    rows, docs = odd
    target = spark.createDataFrame([("alpha beta",)], "text string")
    want = brute_resample(rows, ["alpha beta"], least=1, percent=50)
    assert resampled(docs, target, least_words=1, percent=50) == want
    assert importance.resampled(none, target).collect() == []
    assert len(resampled(docs, none)) == len(rows)
    drawn = importance.drawn(docs, target, least_words=1, percent=50)
    assert drawn.columns == [*docs.columns, "_rank"]
    assert {(r.doc_id, r.text) for r in drawn.collect()} == {(i, t) for i, t in rows if i in {w[0] for w in want if w[4]} and t and len(re.findall(r"\w+", t)) >= 1}


def test_repeated_rows_share_no_rank(spark):
    rows = [(1, "alpha " * 25)] * 500 + [(2, "alpha " * 25)] * 500
    got = resampled(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4), spark.createDataFrame([("alpha",)], "text string"))
    assert sorted(r[4] for r in got if r[4]) == list(range(1, 101)) and len({r[0] for r in got if r[4]}) == 1


def test_set_join_beyond_broadcasts_sends_no_other_sets(spark, monkeypatch):
    """op11: where lists are too long to go everywhere, bits tell exactly which rows take part before anything travels; the order's counters grow."""
    from tidewire.llm import set_join as J

    rows = spark.range(0, 100_000, 1, 3).select((F.col("id") + F.when(F.col("id") > 50_000, 1 << 33).otherwise(0)).alias("row"), F.lit(b"x").alias("whole"))
    asked = rows.where("row % 1000 IN (0, 1, 767, 768)").select(F.col("row").alias("node"))
    monkeypatch.setattr(J, "NARROW_ROWS", 10)
    sent = J.marked(rows, asked.withColumnRenamed("node", "row"))
    assert sorted(map(tuple, sent.select("row").collect())) == sorted(map(tuple, asked.collect()))
    assert "BroadcastHashJoin [static_invoke" in J.with_sets(asked, rows, "node")._jdf.queryExecution().executedPlan().toString()
    assert J.counters_for(1) == J.SKETCH < J.counters_for(500_000) < J.counters_for(3_000_000) == J.MOST_SKETCH
