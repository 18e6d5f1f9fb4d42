"""Borda ranking and encoding against brute force."""

import random
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from tidemark.llm import tokens
from tidemark.llm.ranking import borda_ranking, rank_values

SCHEMA = "g long, i long, a float, b float, extra string"


def brute(rows, signs):
    groups = {}
    for g, i, *vals in rows:
        if g is None or i is None:
            continue
        got = groups.setdefault(g, {}).setdefault(i, [None] * len(signs))
        for n, (v, s) in enumerate(zip(vals, signs)):
            if v is not None and v == v and (got[n] is None or v * s > got[n]):
                got[n] = v * s
    out = []
    for g, items in groups.items():
        points = {i: Fraction(0) for i in items}
        for n in range(len(signs)):
            have = {i: v[n] for i, v in items.items() if v[n] is not None}
            for i in items:
                if i not in have:
                    points[i] += Fraction(1, 2)
                else:
                    better, same = sum(v > have[i] for v in have.values()), sum(v == have[i] for v in have.values())
                    points[i] += Fraction(2 * (len(have) - better) - same, 2 * len(have))
        order = sorted(items, key=lambda i: (-round(float(points[i] / len(signs)), 12), i))
        out += [(g, i, p + 1) for p, i in enumerate(order)]
    return set(out)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_borda(spark, seed):
    rng = random.Random(seed)
    val = lambda: rng.choice([None, float("nan"), 1.0, 2.0, rng.random() * 1000])
    rows = [(rng.choice([1, 1, 1, 2, 3, None]), rng.choice([None, *range(30)]), val(), val(), "x") for _ in range(200)]
    rows += rows[:20] + [(9, 1, None, None, "x"), (9, 0, None, None, "x")]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("points", F.lit("clash")).withColumn("place", F.lit(0))
    want = brute([r[:4] for r in rows], (-1, 1))
    full = {(r.g, r.i, r.place) for r in borda_ranking(df, "g", "i", {"a": -1.0, "b": 1.0}).collect()}
    assert full == want
    top = {(r.g, r.i, r.place) for r in borda_ranking(df, "g", "i", {"a": -1.0, "b": 1.0}, top=3).collect()}
    assert top == {w for w in want if w[2] <= 3}


def test_large_groups_are_ranked_in_ranges(spark):
    df = spark.range(5000).select((F.col("id") % 2).alias("g"), (F.col("id") % 700).cast("double").alias("value"))
    small = {tuple(r) for r in rank_values(df, ["g"]).collect()}
    assert small == {tuple(r) for r in rank_values(df, ["g"], bucket_rows=50).collect()}


def test_ties_of_a_large_group_are_placed_by_many_tasks(spark):
    df = spark.range(20_000).select(F.lit(1).cast("long").alias("g"), "id", F.lit(None).cast("float").alias("a"))
    got = borda_ranking(df, "g", "id", {"a": 1.0})
    assert got.filter(F.col("place") != F.col("id") + 1).count() == 0 and got.select("place").distinct().count() == 20_000
    assert points_in_ranges(spark) > 1


def points_in_ranges(spark):
    points = spark.range(20_000).select(F.lit(1).alias("g"), F.col("id").alias("i"), F.lit(0.5).alias("points"))
    return points.repartitionByRange(4, "g", F.col("points").desc(), F.col("i")).select(F.spark_partition_id()).distinct().count()


def test_empty_borda(spark):
    assert borda_ranking(spark.createDataFrame([], SCHEMA), "g", "i", {"a": 1.0}).count() == 0


TEXTS = [
    "", None, " ", "hello world", "<|endoftext|> is text", "don't we'll", "\r\n\t \n", "ünï©ødé 日本語のテキスト", "a" * 1000, " " * 500 + "x", "\x00\x01", "1234567890 " * 40,
    "word " * 400, "x \t y" * 150, "\n\n".join("para  graph " * 5 for _ in range(30)), "é" * 333 + " " * 333 + "z", "'s" * 200, "a\u3000b" * 100, "🙂" * 250, "tab\t" * 300 + "   end",
]


@pytest.mark.parametrize("chunk,overlap", [(50, 10), (64, 63), (97, 20), (4096, 256)])
def test_encoding_equals_encoding_whole_texts(spark, chunk, overlap):
    enc = tokens.encoding(f"{tokens.TOKENIZERS}/{tokens.BYTE_BPE_50K}")
    rng = random.Random(chunk)
    texts = TEXTS + ["".join(rng.choice("ab 1\n\t'.é日 ") for _ in range(rng.randrange(900))) for _ in range(60)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc long, text string").withColumn("ids", F.lit("clash")).repartition(4)
    got = {r.doc: r.ids for r in tokens.encode_corpus(df, "doc", "text", chunk_chars=chunk, overlap=overlap).collect()}
    assert got == {i: enc.encode_ordinary(t or "") for i, t in enumerate(texts)}


def test_repeated_rows_null_ids_and_empty(spark):
    df = spark.createDataFrame([(1, "a b " * 60), (1, "a b " * 60), (None, "c d " * 60), (1, "e"), (2, None)], "doc long, text string")
    got = tokens.encode_corpus(df, "doc", "text", chunk_chars=50, overlap=10)
    assert sorted((r.doc or 0, len(r.ids)) for r in got.collect()) == sorted((r.doc or 0, r.tokens) for r in tokens.count_tokens(df, "text").collect())
    assert tokens.encode_corpus(df.limit(0), "doc", "text").count() == 0


def test_round_trip(spark):
    texts = [t for t in TEXTS if t is not None]
    df = spark.createDataFrame(list(enumerate(texts)), "doc long, text string")
    back = tokens.decode_corpus(tokens.encode_corpus(df, "doc", "text", chunk_chars=80, overlap=16), "doc")
    assert {r.doc: r.text for r in back.collect()} == dict(enumerate(texts))


def test_a_long_document_takes_linear_time(spark):
    import time

    rng = random.Random(7)
    words = ["".join(rng.choices("abcdefgé日 ", k=rng.randrange(1, 9))) for _ in range(5000)]
    text = " ".join(rng.choices(words, k=2_200_000)) + "x" * 300_000
    enc = tokens.encoding(f"{tokens.TOKENIZERS}/{tokens.BYTE_BPE_50K}")
    df = spark.createDataFrame([(1, text)], "doc long, text string")
    began = time.time()
    got = tokens.encode_corpus(df, "doc", "text").collect()
    took = time.time() - began
    assert got[0].ids == enc.encode_ordinary(text) and took < 60, took
