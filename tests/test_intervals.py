"""Periods and gaps against a sweep in Python."""

import random
from datetime import datetime, timedelta

import pytest

from tidemark.operators import intervals
from tidemark.operators.intervals import OPEN, merge_periods, period_gaps

SCHEMA = "who string, a timestamp, b timestamp, entity string"
T0 = datetime(2024, 1, 1)


def micros(t):
    return OPEN if t is None else int((t - datetime(1970, 1, 1)).total_seconds() * 1_000_000)


def sweep(rows):
    by = {}
    for who, a, b, _ in rows:
        if who is not None and a is not None and micros(a) < micros(b):
            by.setdefault(who, []).append((micros(a), micros(b)))
    periods, gaps = set(), set()
    for who, iv in by.items():
        iv.sort()
        runs = [list(iv[0])]
        for s, e in iv[1:]:
            if s <= runs[-1][1]:
                runs[-1][1] = max(runs[-1][1], e)
            else:
                runs.append([s, e])
        periods |= {(who, *r) for r in runs}
        gaps |= {(who, x[1], y[0]) for x, y in zip(runs, runs[1:])}
    return periods, gaps


def check(spark, rows, most):
    p = merge_periods(spark.createDataFrame(rows, SCHEMA), "who", "a", "b", most)
    periods, gaps = p.collect(), period_gaps(p, most).collect()
    assert ({tuple(r) for r in periods}, {tuple(r) for r in gaps}) == sweep(rows)
    assert len(periods) == len(set(periods)) and len(gaps) == len(set(gaps))


@pytest.mark.parametrize("seed,most", [(1, 1), (2, 7), (3, 30), (4, 400)])
def test_random_intervals(spark, monkeypatch, seed, most):
    monkeypatch.setattr(intervals, "SHARDS", 4 + 20 * (seed % 2))
    rng = random.Random(seed)
    rows = []
    for i in range(400):
        a = T0 + timedelta(hours=rng.randrange(0, 24 * 400))
        length = rng.choice([1, 5, 24, 24 * 3, 24 * 40, 24 * 90])
        b = None if rng.random() < 0.005 else a + timedelta(hours=rng.randrange(-2, length))
        rows.append((rng.choice(["hot", "hot", "x", "y", f"e{i}"]), a, b, "extra"))
    check(spark, rows, most)


def test_borders_touching_and_nesting(spark):
    day = timedelta(days=1)
    rows = [("a", T0, T0 + day, None), ("a", T0 + day, T0 + 2 * day, None), ("b", T0, T0 + 100 * day, None), ("b", T0 + 3 * day, T0 + 4 * day, None), ("c", T0, T0, None), ("d", T0, None, None),
            ("d", T0 + 9 * day, T0 + 10 * day, None), ("e", T0, T0 + timedelta(seconds=1), None), ("e", T0 + timedelta(seconds=2), T0 + 70 * day, None), (None, T0, None, None), ("f", None, T0, None)] * 2
    for most in (1, 3, 30):
        check(spark, rows, most)


def test_empty(spark):
    check(spark, [], 30)


def test_a_dense_entity_is_cut_where_it_is_dense(spark):
    rows = [("hot", T0 + timedelta(seconds=3 * i), T0 + timedelta(seconds=3 * i + (i % 5)), None) for i in range(3000)] + [("hot", T0 - timedelta(days=400), T0 - timedelta(days=399), None), ("cold", T0, None, None)]
    check(spark, rows, 200)
