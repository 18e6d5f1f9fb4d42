"""Ranking, fusion, gates and budgets on small values."""

import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import retrieval as R
from tidemark.operators import textindex

MARK = "\n... [truncated]\n"


def cut(t, most):
    return t if len(t) <= most else t[: max(most - 18, 0)] + MARK


def pack(hits, most):
    total, out = 0, []
    for pinned, _, ident, text in sorted(hits, key=lambda h: (not h[0], h[1])):
        if text is None:
            out.append((ident, None))
            continue
        if total >= most and not pinned:
            break
        if total + len(text) > most:
            left = max(most - total, 0)
            if left < 80 and not pinned:
                break
            text = cut(text, left) if left >= 80 else cut(text, min(80, len(text)))
        total += len(text)
        out.append((ident, text))
    return out


def test_budget_equals_the_fold(spark):
    rng = random.Random(5)
    cases = []
    for q in range(120):
        hits = [(rng.random() < 0.2, o, o, rng.choice([None, "", "é" * rng.randrange(1, 400), "a" * rng.randrange(60, 130)])) for o in range(rng.randrange(0, 7))]
        cases.append((q, hits))
    df = spark.createDataFrame(cases, "q int, hits array<struct<pinned:boolean,ord:int,id:bigint,content:string>>")
    for most in (50, 200, 400):
        got = {r.q: [(k.id, k.content) for k in r.kept] for r in df.select("q", R.char_budget(F.col("hits"), most).alias("kept")).collect()}
        assert got == {q: pack(h, most) for q, h in cases}


def test_fusion_of_two_lists(spark):
    lists = spark.createDataFrame([(1, "a", 1), (1, "b", 2), (1, "z", 1), (1, "y", 2), (2, "a", 1), (2, "a", 1)], "q int, item string, rank int")
    got = [(r.q, r.item, r.place) for r in R.reciprocal_rank_fusion(lists, ["q"], ["item"], "rank", 4).orderBy("q", "place").collect()]
    assert got == [(1, "a", 1), (1, "z", 2), (1, "b", 3), (1, "y", 4), (2, "a", 1)]


def test_relevance_and_confidence(spark):
    df = spark.createDataFrame([(1 / 61, 9.0), (None, 1.0), (None, -4.0), (None, None), (None, float("nan"))], "rrf double, d double")
    got = [(None if r[0] is None else round(r[0], 6), r[1]) for r in df.select(R.relevance(F.col("rrf"), F.col("d")), R.confidence_of(F.col("d"))).collect()]
    assert got[:4] == [(1.0, 0.1), (0.5, 0.5), (1.0, 1.0), (None, None)] and got[4][1] is None


def test_neighbours_in_several_passes(spark, monkeypatch):
    monkeypatch.setattr(R, "QUERY_BLOCK", 3)
    rng = random.Random(2)
    rows = [(i, [float(rng.randrange(4)) for _ in range(3)]) for i in range(40)] + [(40, None), (41, [1.0])]
    df = spark.createDataFrame(rows, "i long, v array<float>")
    got = {(r.q, r.i, r.rank) for r in R.exact_neighbours(df.filter("i < 8").withColumnRenamed("i", "q"), df, 4, "q", "i", "v").collect()}
    want = set()
    for q, v in rows[:8]:
        near = sorted((sum((a - b) ** 2 for a, b in zip(v, w)), i) for i, w in rows if w and len(w) == 3)[:4]
        want |= {(q, i, n + 1) for n, (_, i) in enumerate(near)}
    assert got == want
    assert R.exact_neighbours(df.limit(0).withColumnRenamed("i", "q"), df, 4, "q", "i", "v").count() == 0


def test_bm25_prefers_rare_words(spark):
    docs = spark.createDataFrame([(1, "cat cat dog"), (2, "dog dog"), (3, None), (4, "Cat")], "d long, t string")
    q = spark.createDataFrame([(1, "cat"), (2, "unknown"), (3, None)], "q long, t string")
    got = [(r.q, r.d, r["rank"]) for r in R.bm25(q, docs, 5, "q", "t", "d", "t").orderBy("q", "rank").collect()]
    assert got == [(1, 4, 1), (1, 1, 2)] or got == [(1, 1, 1), (1, 4, 2)]


def test_decisions(spark):
    df = spark.createDataFrame([(0, None, 0), (2, 0.05, 2), (2, 0.9, 0), (1, 0.9, 1), (1, None, 1)], "n int, best double, kept int")
    d, r = R.recall_decision(F.col("n"), F.col("best"), F.col("kept"), 0.5)
    assert [tuple(x) for x in df.select(d, r).collect()] == [("abstain", "no_hits"), ("abstain", "best_relevance_below_min_score"), ("abstain", "char_budget_exhausted"), ("inject", "hits_above_threshold"), ("inject", "hits_above_threshold")]


def test_equal_neighbours_fall_to_the_smallest_ids(spark):
    rows = [(i, [1.0, 2.0, 0.1]) for i in range(300, 0, -1)] + [(i, [5.0, float(i), 1.0]) for i in range(301, 320)]
    base = spark.createDataFrame(rows, "id long, v array<double>").coalesce(1)
    asked = spark.createDataFrame([(7, [1.0, 2.0, 0.3]), (8, [1.0, 2.0, 0.1])], "q long, v array<double>")
    got = {(r.q, r["rank"]): r.id for r in R.exact_neighbours(asked, base, 3, "q", "id", "v").collect()}
    assert got == {(q, n): n for q in (7, 8) for n in (1, 2, 3)}


def brute_bm25(queries, docs, k):
    import math
    import re

    split = {d: [w.lower() for w in re.findall(r"[A-Za-z0-9_]+", t or "")] for d, t in docs}
    n, mean = len(split), sum(map(len, split.values())) / len(split)
    out = set()
    for q, text in queries:
        words = {w.lower() for w in re.findall(r"[A-Za-z0-9_]+", text or "")}
        df = {w: sum(w in s for s in split.values()) for w in words}
        scores = {}
        for d, s in split.items():
            got = [math.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)) * s.count(w) * 2.2 / (s.count(w) + 1.2 * (0.25 + 0.75 * len(s) / mean)) for w in words if w in s]
            if got:
                scores[d] = round(sum(got), 9)
        best = sorted(scores, key=lambda d: (-scores[d], d))[:k]
        out |= {(q, d, i + 1) for i, d in enumerate(best)}
    return out


def test_bm25_in_several_passes_equals_brute_force(spark, monkeypatch):
    rng = random.Random(6)
    docs = [(f"d{i:03d}", rng.choice([None, "", " ".join(rng.choices("the Cat dog mouse the the owl fox_1 é zebra".split(), k=rng.randrange(30)))])) for i in range(120)] + [("long", "the cat " * 20_000)]
    asked = [(i, " ".join(rng.choices("the cat dog mouse owl fox_1 nothing THE".split(), k=rng.randrange(6)))) for i in range(40)] + [(40, None), (None, "cat")]
    d = spark.createDataFrame([(*x, "clash") for x in docs], "d string, t string, score string").repartition(3)
    q = spark.createDataFrame([(*x, "clash") for x in asked], "q long, t string, term string")
    want = brute_bm25([x for x in asked if x[0] is not None], docs, 5)
    for most in (7, 10**6):
        monkeypatch.setattr(R, "TERM_BLOCK", most)
        assert {(r.q, r.d, r["rank"]) for r in R.bm25(q, d, 5, "q", "t", "d", "t").collect()} == want
    assert R.bm25(q, d.limit(0), 5, "q", "t", "d", "t").count() == 0 and R.bm25(q.limit(0), d, 5, "q", "t", "d", "t").count() == 0


def test_neighbours_of_text_ids(spark, monkeypatch):
    monkeypatch.setattr(R, "QUERY_BLOCK", 5)
    monkeypatch.setattr(R, "STEP", 2)
    rng = random.Random(3)
    rows = [(f"s{i}", [float(rng.randrange(3)) for _ in range(3)]) for i in range(60)] + [(None, [1.0, 1.0, 1.0]), ("null", None)]
    df = spark.createDataFrame(rows, "id string, v array<float>").repartition(3)
    got = {(r.q, r.id, r["rank"]) for r in R.exact_neighbours(df.withColumnRenamed("id", "q"), df, 4, "q", "id", "v").collect()}
    known = [r for r in rows if r[0] and r[1]]
    want = {(q, i, n + 1) for q, v in known for n, (_, i) in enumerate(sorted((sum((a - b) ** 2 for a, b in zip(v, w)), i) for i, w in known)[:4])}
    assert got == want


@pytest.mark.parametrize("named", [2, 1000])
def test_text_index_follows_its_documents(spark, tmp_path, monkeypatch, named):
    monkeypatch.setattr(textindex, "NAMED_TERMS", named)
    rng = random.Random(8)
    text = lambda: rng.choice([None, "", " ".join(rng.choices("the Cat dog mouse owl".split(), k=rng.randrange(1, 20)))])
    index = textindex.TextIndex(spark, str(tmp_path / "i"), parts=4)
    asked = [(1, "cat"), (2, "the dog dog"), (3, "nothing"), (4, None), (5, "owl mouse")]
    q = spark.createDataFrame(asked, "q long, t string")
    frame = lambda d: spark.createDataFrame(list(d.items()), "d string, t string")
    state = {f"d{i:02d}": text() for i in range(40)}
    found = lambda: {(r.q, r.doc_id, r["rank"]) for r in index.search(q, 5, "q", "t").collect()}
    assert index.update(frame(state), "d", "t") == {"taken": 40} and found() == brute_bm25(asked, list(state.items()), 5)
    changed = {f"d{i:02d}": "owl cat" for i in range(5)} | {"new": "mouse"}
    state |= changed
    index.update(frame(changed), "d", "t")
    assert found() == brute_bm25(asked, list(state.items()), 5) and index.update(frame(changed), "d", "t") == {"taken": 0}
    state = {k: v for k, v in state.items() if k > "d07"}
    index.update(frame(state), "d", "t", whole=True)
    rows = index.postings.read().count()
    assert found() == brute_bm25(asked, list(state.items()), 5)
    index.compact()
    assert found() == brute_bm25(asked, list(state.items()), 5) and index.postings.read().count() < rows


def shuffled(spark, do) -> tuple[int, object]:
    """Rows that stages shuffled while ``do`` ran, and what it gave."""
    sc = spark.sparkContext
    jsc, jvm = sc._jsc.sc(), sc._jvm

    def total():
        jsc.listenerBus().waitUntilEmpty(30_000)
        stages = jsc.statusStore().stageList(None, False, False, sc._gateway.new_array(jvm.double, 0), jvm.java.util.ArrayList())
        return {(s.stageId(), s.attemptId()): s.shuffleWriteRecords() for s in (stages.apply(i) for i in range(stages.size()))}

    before = total()
    got = do()
    return sum(n for k, n in total().items() if k not in before), got


def test_text_index_shuffles_neither_postings_nor_pairs(spark, tmp_path):
    words = [f"w{i}" for i in range(100)]
    docs = spark.createDataFrame([(i, " ".join(random.Random(i).sample(words, 80)) + " the") for i in range(600)], "d long, t string")
    asked = spark.createDataFrame([(i, f"the w{i % 100}") for i in range(200)], "q long, t string")
    index = textindex.TextIndex(spark, str(tmp_path / "i"), parts=4)
    postings, pairs = 600 * 81, 600 * 200
    moved, got = shuffled(spark, lambda: index.update(docs, "d", "t"))
    assert got == {"taken": 600} and moved < postings / 4
    moved, got = shuffled(spark, lambda: {(r.q, r.doc_id, r["rank"]) for r in index.search(asked, 5, "q", "t").collect()})
    assert moved < pairs / 4
    assert got == {(r.q, r.d, r["rank"]) for r in R.bm25(asked, docs, 5, "q", "t", "d", "t").collect()}


@pytest.mark.parametrize("ids", [0, 500_000])
def test_text_index_of_many_segments_and_repeated_ids(spark, tmp_path, monkeypatch, ids):
    monkeypatch.setattr(textindex, "NAMED_IDS", ids)
    monkeypatch.setattr(textindex, "SEGMENT_DOCS", 4)
    monkeypatch.setattr(R, "TERM_BLOCK", 3)
    rng = random.Random(9)
    text = lambda: " ".join(rng.choices("the Cat dog mouse owl".split(), k=rng.randrange(12)))
    asked = [(1, "cat"), (2, "the dog dog"), (3, "owl mouse"), (4, "the cat dog mouse owl")]
    q = spark.createDataFrame(asked, "q long, t string")
    index = textindex.TextIndex(spark, str(tmp_path / "i"), parts=4)
    state = {i: text() for i in range(60)} | {60: "owl " * 20_000}
    twice = [(i, min(t, "")) for i, t in state.items() if i % 3 == 0] + [(i, t) for i, t in state.items() if i % 4 == 0]
    frame = lambda rows: spark.createDataFrame(rows, "d long, t string")
    found = lambda: {(r.q, r.doc_id, r["rank"]) for r in index.search(q, 5, "q", "t").collect()}
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 3)
    try:
        assert index.update(frame([*state.items(), *twice, (None, "cat")]), "d", "t") == {"taken": 61} and found() == brute_bm25(asked, list(state.items()), 5)
        state |= {i: text() + " dog" for i in range(10, 20)} | {70: "cat"}
        del state[5]
        index.update(frame([*state.items(), *[(i, "") for i in range(12, 15)]]), "d", "t", whole=True)
        assert found() == brute_bm25(asked, list(state.items()), 5)
        index.compact()
        assert found() == brute_bm25(asked, list(state.items()), 5)
        assert index.postings.read().filter("term = ''").count() == len(state)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_packed_numbers_come_back():
    import numpy as np

    for numbers in ([], [0], [1, 127, 0], [128, 5, 16_383, 16_384, 2**21, 2**31 - 1, 3]):
        data, ends = textindex._pack(np.array(numbers, np.int64))
        assert textindex._unpack(data.tobytes()).tolist() == numbers and (not numbers or ends[-1] == len(data))
