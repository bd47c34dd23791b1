import datetime as dt
import random

import pytest

from graphloom.operators.top_per_group import top_per_group

SCHEMA = "project string, subject_id string, score double, scored_at timestamp_ntz, place int, band int"


def at(minute):
    return dt.datetime(2025, 1, 1) + dt.timedelta(minutes=minute)


def brute(data, n):
    last = {}
    for p, s, x, t, *_ in data:
        if p is not None and s is not None:
            key = (t, x is not None, -1 if x is None else (float("inf") if x != x else x))
            if (p, s) not in last or key > last[p, s][0]:
                last[p, s] = (key, x)
    groups = {}
    for (p, s), (_, x) in last.items():
        if x is not None and x == x:
            groups.setdefault(p, []).append((-x, s))
    return sorted((p, s, k + 1) for p, items in groups.items() for k, (_, s) in enumerate(sorted(items)[:n]))


@pytest.mark.parametrize("seed", [1, 2])
def test_against_brute_force(spark, seed):
    rnd = random.Random(seed)
    scores = [None, float("nan"), 0.0, -1.0, 1.0, 0.5, 0.25, 0.75]
    data = [("hot" if rnd.random() < 0.4 else f"p{rnd.randrange(30)}", f"{rnd.choice('aAbé')}{rnd.randrange(60)}", rnd.choice(scores), at(rnd.randrange(1000)), 1, 1) for _ in range(800)]
    data += data[:50] + [(None, "x", 1.0, at(0), 1, 1), ("p1", None, 1.0, at(0), 1, 1)]
    got = top_per_group(spark.createDataFrame(data, SCHEMA), "project", "subject_id", "score", "scored_at")
    assert sorted(tuple(r) for r in got.collect()) == brute(data, 5)


def test_all_scores_equal(spark):
    data = [("p", f"s{k:03}", 1.0, at(0), 1, 1) for k in range(200)]
    got = top_per_group(spark.createDataFrame(data, SCHEMA), "project", "subject_id", "score", "scored_at", 3)
    assert sorted(tuple(r) for r in got.collect()) == [("p", "s000", 1), ("p", "s001", 2), ("p", "s002", 3)]


def test_empty(spark):
    assert top_per_group(spark.createDataFrame([], SCHEMA), "project", "subject_id", "score", "scored_at").collect() == []
