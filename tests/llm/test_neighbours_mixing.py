"""Permutation index against brute force, mixing against its targets."""

from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import mixing, neighbours
from tidemark.llm.neighbours import IndexOptions, _long_lists, footrule_block, list_keys, nearest_neighbours, permutations, similar_pairs

SCHEMA = "id string, vector array<float>"


def frame(spark, pairs):
    return spark.createDataFrame([(i, None if v is None else [float(x) for x in v]) for i, v in pairs], SCHEMA)


def brute(pairs, k):
    ids = sorted({i for i, v in pairs if v is not None and np.any(v)})
    by = {}
    for i, v in pairs:
        if i in ids and v is not None and np.any(v):
            by.setdefault(i, []).append(np.asarray(v, np.float32).astype(float) / np.linalg.norm(np.asarray(v, np.float32).astype(float)))
    out = {}
    for a in ids:
        best = sorted((-round(max(float(x @ y) for x in by[a] for y in by[b]), 6), b) for b in ids if b != a)
        out[a] = [b for _, b in best[:k]]
    return out


def lists(df):
    out = {}
    for r in df.orderBy("id", "place").collect():
        out.setdefault(r.id, []).append(r.neighbour)
    return out


def test_small_collections_are_exact(spark):
    rng = np.random.default_rng(1)
    base = rng.integers(-8, 8, (60, 6))
    pairs = [(f"v{i:02d}", v) for i, v in enumerate(base)] + [(f"c{i:02d}", base[0]) for i in range(20)] + [("s", base[1] * 3), ("zero", [0] * 6), ("null", None), ("short", [1.0]), ("nan", [float("nan")] * 6), ("v00", base[0]), ("two", base[2]), ("two", base[3])]
    df = frame(spark, pairs).withColumn("rep", F.lit("clash")).withColumn("cosine", F.lit("clash"))
    good = [(i, v) for i, v in pairs if i not in ("zero", "null", "short", "nan")]
    assert lists(nearest_neighbours(df, "id", "vector", 4)) == brute(good, 4)


def test_recall_and_similar_pairs_on_clusters(spark):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(150, 32))
    x = np.concatenate([centres + rng.normal(size=centres.shape) * s for s in (0.05, 0.1, 0.15, 0.2)] + [rng.normal(size=(600, 32))])
    pairs = [(f"{i:05d}", v) for i, v in enumerate(x)]
    want = brute(pairs, 5)
    options = IndexOptions(candidates=0.8)
    near = nearest_neighbours(frame(spark, pairs), "id", "vector", 5, options)
    got = lists(near)
    recall = np.mean([len(set(got.get(a, [])) & set(b)) / 5 for a, b in want.items()])
    assert recall >= 0.9, recall
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    true = {tuple(sorted((a, b))) for a, bs in want.items() for b in bs if u[int(a)] @ u[int(b)] >= 0.9}
    close = {tuple(r) for r in similar_pairs(nearest_neighbours(frame(spark, pairs), "id", "vector", 5, options, least=0.9), 0.9).collect()}
    assert len(true & close) >= 0.97 * len(true) and close <= true | close and len(close - true) <= 0.02 * len(true)


def recall(spark, x, options, k=5):
    pairs = [(f"{i:05d}", v) for i, v in enumerate(x)]
    got = lists(nearest_neighbours(frame(spark, pairs), "id", "vector", k, options))
    u = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
    hit = []
    for at in range(0, len(x), 500):
        sims = u[at : at + 500] @ u.T
        sims[np.arange(len(sims)), np.arange(at, at + len(sims))] = -2
        best = np.argpartition(-sims, k, axis=1)[:, :k]
        hit += [len({f"{j:05d}" for j in b} & set(got.get(f"{at + i:05d}", []))) / k for i, b in enumerate(best)]
    return np.array(hit)


def test_recall_in_a_dense_region_with_lists_cut(spark):
    # Half of all vectors lie around one centre; lists are cut there.
    rng = np.random.default_rng(3)
    centre = rng.normal(size=(1, 24))
    x = np.concatenate([centre + rng.normal(size=(3000, 24)) * 0.4, rng.normal(size=(3000, 24))])
    options = IndexOptions(longest=1.5)
    hit = recall(spark, x, options)
    assert hit.mean() >= 0.9 and hit[:3000].mean() >= 0.9, (hit.mean(), hit[:3000].mean())


def test_lists_are_cut_while_it_helps():
    assert list_keys([3, 1, 2, 0], 1, frozenset({(3,), (3, 1)})) == [(3, 1, 0), (3, 1, 2), (3, 2)]
    rng = np.random.default_rng(3)
    spread_out = np.array([rng.permutation(30)[:8] for _ in range(4000)])
    long_ = _long_lists(spread_out, 1.0, 3, 50, 8)
    sizes = Counter(k for p in spread_out for k in list_keys(p, 3, long_))
    assert max(sizes.values()) <= 50 and max(map(len, sizes)) > 1
    alike = np.array([[5, 4, 3, 2, 1, 0, 6, 7]] * 4000)
    assert max(len(k) for k in _long_lists(alike, 1.0, 3, 50, 8)) == 1


def test_a_sample_far_smaller_than_the_collection_posts_no_vector_in_many_lists(spark, monkeypatch):
    # Of unlike vectors and close pairs, a sample knows hardly any pair: lists were made longer and cut until each vector
    # was posted in dozens of them, and an executor's memory ended.
    rng = np.random.default_rng(6)
    centres = rng.normal(size=(8, 32))
    x = (centres[rng.integers(0, 8, 3000)] + rng.normal(size=(3000, 32))).astype(np.float32)
    x = np.concatenate([x, x + rng.normal(size=x.shape).astype(np.float32) * 0.1])
    fitted, fit = [], neighbours._fit
    monkeypatch.setattr(neighbours, "_fit", lambda *a: fitted.append(fit(*a)) or fitted[-1])
    options = IndexOptions(sample_rows=400, most_rows=150, min_list=100, list_factor=1.0)
    pairs = [(f"{i:05d}", v) for i, v in enumerate(x)]
    got = {tuple(r) for r in similar_pairs(nearest_neighbours(frame(spark, pairs), "id", "vector", 5, options, least=0.97), 0.97).collect()}
    pivots, width, _, long_lists, sublists = fitted[0]
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    assert np.mean([len(list_keys(p, options.posts, long_lists, sublists)) for p in permutations(u, pivots, width)]) <= 12
    true = {(f"{i:05d}", f"{i + 3000:05d}") for i in range(3000) if u[i].astype(float) @ u[i + 3000] >= 0.97}
    assert len(true) > 2500 and len(true & got) >= 0.9 * len(true), (len(true), len(true & got))


@pytest.mark.parametrize("least", [None, 0.6])
def test_a_list_in_small_blocks_and_files(monkeypatch, least):
    import pyarrow as pa

    rng = np.random.default_rng(7)
    x = rng.normal(size=(90, 8)).astype(np.float32)
    x[60:] = x[:30] + rng.normal(size=(30, 8)).astype(np.float32) * 0.1
    ids = [f"{i:02d}" for i in rng.permutation(90)]
    rows = pa.RecordBatch.from_arrays([pa.array(ids), pa.array(x.tolist(), pa.list_(pa.float32()))], ["id", "vector"])

    class Shared:
        value = (x[:1] / np.linalg.norm(x[:1]), frozenset())

    def found():
        posted = [*neighbours._posts(8, 1, 1, 2, Shared)(iter([rows, rows]))]
        assert all(b.num_rows <= neighbours.SLICE for b in posted)
        out = pa.Table.from_batches([*neighbours._list_neighbours(8, 3, 1, 200, least)(iter(posted))])
        return sorted(zip(*(out[c].to_pylist() for c in ("rep", "first", "cosine"))))

    whole = found()
    for name, value in (("SLICE", 7), ("BLOCK", 100), ("ROOM", 0)):
        monkeypatch.setattr(neighbours, name, value)
    assert [r[:2] for r in found()] == [r[:2] for r in whole]
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    sims = u @ u.T
    np.fill_diagonal(sims, -2)
    near = np.argsort(-sims, axis=1)[:, :4]
    assert sorted(r[1] for r in whole) == sorted(ids[j] for i in range(90) for j in near[i] if least is None or sims[i, j] >= least)


@pytest.mark.parametrize("scale", ["exact", "any"])
def test_rescaled_copies_fall_to_the_smallest_ids(spark, scale):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(600, 16)).astype(np.float32)
    groups = [x[0]] * 150 + [x[1]] * 40 + [x[2]] * 10
    by = rng.choice([0.25, 0.5, 2.0, 4.0], 200) if scale == "exact" else rng.uniform(0.3, 3.0, 200)
    vectors = [*x, *(v * np.float32(b) for v, b in zip(groups, by))]
    names = [f"{i:04d}" for i in rng.permutation(len(vectors))]
    pairs = list(zip(names, vectors))
    got, want = lists(nearest_neighbours(frame(spark, pairs).repartition(5), "id", "vector", 5, IndexOptions(min_list=100, list_factor=1.0))), brute(pairs, 5)
    copies = [names[i] for i in (0, 1, 2, *range(600, 800))]
    assert all(got[a] == want[a] for a in copies), [(a, got[a], want[a]) for a in copies if got[a] != want[a]][:3]


def test_many_equally_near(spark):
    # 60 unlike vectors have one cosine with the axis: the smallest ids of all of them are its neighbours.
    pairs = [("axis", [1.0] + [0.0] * 60)] + [(f"{(i * 37) % 60:02d}", [1.0] + [float(i == j) for j in range(60)]) for i in range(60)]
    assert lists(nearest_neighbours(frame(spark, pairs), "id", "vector", 5))["axis"] == ["00", "01", "02", "03", "04"]


def test_empty(spark):
    for rows in ([], [("a", None)], [("a", [0.0, 0.0])], [("a", [1.0, 0.0])]):
        assert nearest_neighbours(frame(spark, rows), "id", "vector").count() == 0


def test_footrule():
    pivots = np.eye(4, dtype=np.float32)
    perm = permutations(np.array([[4, 3, 2, 1], [1, 2, 3, 4]], np.float32), pivots, 3)
    assert perm.tolist() == [[0, 1, 2], [3, 2, 1]]
    pos = np.full((4, 2), 3, np.int8)
    for n in range(2):
        for place, p in enumerate(perm[n]):
            pos[p, n] = place
    assert footrule_block(pos, np.array([0, 1]), 3).tolist() == [[0, 8], [8, 0]]


def test_source_tokens():
    assert mixing.source_tokens({"a": 100, "b": 100}, {"a": 0.5, "b": 0.5}, {"a": 1, "b": 1}, 100) == {"a": 50, "b": 50}
    got = mixing.source_tokens({"a": 10, "b": 100, "c": 50}, {"a": 0.5, "b": 0.5, "x": 1}, {"a": 2, "b": 1, "x": 3}, 100)
    assert got == {"a": 20, "b": 80}
    assert mixing.source_tokens({"a": 10}, {"a": 1}, {"a": 2}, 1000) == {"a": 20} and mixing.source_tokens({}, {"a": 1}, {"a": 2}, 10) == {}


def test_raking_keeps_sources_and_caps():
    cells = {(s, g, t): 10.0 * (i + 1) for i, (s, g, t) in enumerate((s, g, t) for s in "ab" for g in "xy" for t in "pq")}
    sizes = {s: sum(v for c, v in cells.items() if c[0] == s) for s in "ab"}
    asked = {"a": sizes["a"] * 1.8, "b": sizes["b"] * 0.4}
    w = mixing.rake(cells, asked, {"a": 2, "b": 1})
    for s in "ab":
        assert abs(sum(w[c] * v for c, v in cells.items() if c[0] == s) - asked[s]) < 1e-6
    assert max(w[c] for c in cells if c[0] == "a") <= 2 and max(w[c] for c in cells if c[0] == "b") <= 1


def test_mixture_meets_its_targets(spark):
    rng = np.random.default_rng(4)
    rows = [(i, rng.choice([" A", "a", "B", "b ", "c", None]), rng.choice(["en", "de", None]), rng.choice(["p", "q"]), int(rng.integers(0, 200)), "x") for i in range(3000)]
    raw = spark.createDataFrame([tuple(v.item() if hasattr(v, "item") else v for v in r) for r in rows], "doc long, s string, l string, t string, n long, source string").drop("source")
    targets = spark.createDataFrame([("a", 0.5, 2), ("B", 0.3, 1), ("c", 0.15, 3), ("none", 0.05, 5), (None, 0.5, 1)], "source string, target_share double, max_repeats int")
    docs, want = mixing.normalised(raw, targets, "doc", "s", "l", "t", "n")
    total = 200_000
    mix = mixing.mix_sources(docs, want, "doc", total=total)
    got = mix.collect()
    assert len(got) == len({r.doc for r in got})
    caps, share = {"a": 2, "b": 1, "c": 3}, {"a": 0.5, "b": 0.3, "c": 0.15}
    sums = {s: sum(r.tokens * r.copies for r in got if r.source == s) for s in share}
    assert all(r.copies <= caps[r.source] for r in got)
    for s in share:
        assert abs(sums[s] - share[s] / 0.95 * total) <= 100, sums
    report = {r.source: r for r in mixing.share_report(mix, docs, want).collect()}
    assert report["none"].available_tokens == 0 and report["?"].mixed_tokens == 0 and abs(report["a"].actual_share - sums["a"] / sum(sums.values())) < 1e-9
    full = mixing.mix_sources(docs, want, "doc", total=10**9).collect()
    assert all(r.copies == caps[r.source] for r in full)
    assert sorted(map(tuple, mixing.mix_sources(docs, want, "doc", total=total).collect())) == sorted(map(tuple, got))


def test_empty_mixture(spark):
    docs = spark.createDataFrame([], "doc long, source string, language string, topic string, tokens long")
    targets = spark.createDataFrame([("a", 1.0, 1)], "source string, target_share double, max_repeats int")
    assert mixing.mix_sources(docs, targets, "doc").count() == 0 and mixing.share_report(mixing.mix_sources(docs, targets, "doc"), docs, targets).count() == 1


def test_a_large_source_with_a_small_share_is_ordered_in_part_only(spark):
    docs = spark.range(400_000).select(F.col("id").alias("doc"), F.when(F.col("id") % 3 == 0, "small").otherwise("large").alias("source"), F.lit("en").alias("language"), F.lit("t").alias("topic"), (F.col("id") % 7 + 1).alias("tokens"))
    targets = spark.createDataFrame([("large", 0.01, 1), ("small", 0.99, 1)], "source string, target_share double, max_repeats int")
    plan = mixing.plan_mixture(docs, targets, 400_000, 0.5)
    got = mixing.draw(docs, plan, "doc", 11).groupBy("source").agg(F.sum(F.col("tokens") * F.col("copies")).alias("t"), F.max("copies").alias("c")).collect()
    assert {r.source: abs(r.t - plan.tokens[r.source]) <= 4 and r.c == 1 for r in got} == {"large": True, "small": True}


def test_repeated_documents_in_a_mixture(spark):
    docs = spark.createDataFrame([(1, "a", "en", "t", 10)] * 100 + [(None, "a", "en", "t", 10)] * 20, "doc long, source string, language string, topic string, tokens long")
    targets = spark.createDataFrame([("a", 1.0, 1)], "source string, target_share double, max_repeats int")
    assert mixing.mix_sources(docs, targets, "doc", total=333).count() == 33


def test_too_many_targets_raise(spark, monkeypatch):
    monkeypatch.setattr(mixing, "MAX_CELLS", 2)
    docs = spark.createDataFrame([(1, "a", "en", "t", 10)], "doc long, source string, language string, topic string, tokens long")
    targets = spark.createDataFrame([(s, 1.0, 1) for s in "abc"], "source string, target_share double, max_repeats int")
    with pytest.raises(ValueError):
        mixing.mix_sources(docs, targets, "doc")


def test_query_shares(spark):
    import os

    import __spark_entry__ as entry
    from tidemark.llm import tokens

    sf = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
    enc = tokens.encoding(f"{tokens.TOKENIZERS}/{tokens.BYTE_BPE_50K}")
    sizes, longest = {}, 0
    for r in spark.read.parquet(f"{sf}/documents.parquet").collect():
        n, s = len(enc.encode_ordinary(r.text or "")), "?" if r.source is None else r.source.strip(" ").lower()
        sizes[s], longest = sizes.get(s, 0) + n, max(longest, n)
    want = [r for r in spark.read.parquet(f"{sf}/mix_targets.parquet").collect() if r.source is not None]
    asked = mixing.source_tokens(sizes, {r.source.strip().lower(): r.target_share for r in want}, {r.source.strip().lower(): r.max_repeats for r in want}, 0.5 * sum(sizes.values()))
    shares = {r.source: r for r in entry.queries()["p9_shares"](spark, sf).collect()}
    for s, t in asked.items():
        assert abs(shares[s].mixed_tokens - t) <= longest / 2 + 1, s
        assert shares[s].available_tokens == sizes[s] and abs(shares[s].actual_share - t / sum(asked.values())) <= longest / sum(asked.values())
    assert all(r.mixed_tokens == 0 for s, r in shares.items() if s not in asked)
