import datetime as dt
import json

import pytest

from graphloom.functions.text_json import read_beyond, with_canonical
from graphloom.operators.ordering import globally_ranked, with_neighbours
from graphloom.operators.snapshot_changes import snapshot_changes

RUNS = "id bigint, workspace_fingerprint string, created_at string, requested_json string, project string"
ROWS = "analysis_run_id bigint, position int, project string, value_json string, received_at timestamp_ntz, run_id string"


def at(minute):
    return dt.datetime(2025, 1, 1, 0, minute)


def test_changes(spark, rows):
    runs = spark.createDataFrame(
        [
            (2, "w", "2025-01-01T10:00:00+02:00", "[]", "x"),
            (2, "w", "2025-01-01T10:00:00+02:00", "[]", "x"),  # repeated
            (1, "w", "2025-01-01 09:00:00Z", "[ ]", None),  # later than run 2
            (3, "w", "2025-01-01T08:30:00Z", '["p"]', None),  # not full
            (4, "w", "2025-01-01T08:40:00Z", "[]", None),  # without rows
            (5, "v", "2025-01-01T08:40:00Z", "[]", None),  # another workspace, one snapshot only
            (6, None, None, None, None),
        ],
        RUNS,
    )
    old = json.dumps({"a": 3, "b": None, "c": [1, 2], "stats": {"n": 1}})
    new = '{"c": [1, 2.0], "stats": 7, "a": 3.00, "\\u0062": null}'
    data = [
        (2, 0, "same", old, at(0), "k"), (1, 0, "same", new, at(0), "k"),
        (2, 1, "order", '{"c":[1,2]}', at(0), "k"), (1, 1, "order", '{"c":[2,1]}', at(0), "k"),
        (2, 2, "gone", "{}", at(0), "k"), (1, 2, "come", "{}", at(0), "k"),
        (2, 3, "null", None, at(0), "k"), (1, 3, "null", "{broken", at(0), "k"),
        (2, 4, "value", "null", at(0), "k"), (1, 4, "value", "{}", at(0), "k"),
        (2, 5, "again", '{"a":1}', at(0), "k"), (2, 5, "again", '{"a":2}', at(1), "k"), (1, 5, "again", '"{\\"a\\": 2}"', at(0), "k"),
        (1, 6, None, "{}", at(0), "k"), (3, 0, "p", "{}", at(0), "k"), (99, 0, "lost", "{}", at(0), "k"), (5, 0, "q", "{}", at(0), "k"),
    ]
    got = snapshot_changes(runs, spark.createDataFrame(data, ROWS))
    assert rows(got) == [(1, "come", "added"), (1, "gone", "removed"), (1, "order", "changed"), (1, "value", "changed")]


def test_empty(spark, rows):
    assert rows(snapshot_changes(spark.createDataFrame([], RUNS), spark.createDataFrame([], ROWS))) == []


@pytest.mark.parametrize(
    ("one", "two", "same"),
    [
        ('{"a":1,"b":2}', '{ "b":2.0, "a":1e0 }', True),
        ('{"a":"\\u00e9"}', '{"a":"é"}', True),
        ('{"a":true}', '{"a":1}', False),
        ('{"a":"1"}', '{"a":1}', False),
        ('{"a":{"b":null}}', '{"a":{}}', True),
        ('{"a":[null]}', '{"a":[]}', False),
        ('{"a":0.1}', '{"a":1e-1}', True),
        ('{"a":123456789012345678901}', '{"a":123456789012345678902}', False),
        ('{"a":-0.0}', '{"a":0}', True),
        ("[1,]", "null", True),
        ('{"a":NaN}', None, True),
    ],
)
def test_canonical(spark, one, two, same):
    df = spark.createDataFrame([(one,), (two,)], "text string")
    a, b = (r["c"] for r in with_canonical(df, "text", "c").collect())
    assert (a == b) is same
    if a and b:
        assert (read_beyond(one) == read_beyond(two)) is same


def test_texts_beyond_the_limits_of_the_jvm(spark):
    deep, number = "[" * 5000 + "]" * 5000, "1" * 5000
    texts = [deep, f'{{"b":{number}, "a":null, "stats":2}}', f'{{"b":{number}}}', "[" * 5000 + "]" * 4999, f'{{"b":{number}2}}', f'{{"b":1,"b":{number}}}']
    got = [r["c"] for r in with_canonical(spark.createDataFrame([(t,) for t in texts], "text string"), "text", "c", ["stats"]).collect()]
    assert got[0] == deep and got[1] == got[2] and got[3] is None and got[4] not in (None, got[1]) and got[5] is None
    for text in ('{"a" 1}', '{"a":}', "[1 2]", "[,1]", '{"a":1,}', "{1:2}", "]", "[1]]", "1 2", "", '"x', "[:]"):
        assert read_beyond(text) is None
    assert read_beyond('"{\\"a\\": [1.50, {}]}"') == '{"a":[1.5,{}]}'


def test_neighbours_across_partitions(spark, rows):
    data = [(g, t, 10 * t + g) for g in range(3) for t in range(50)]
    df = spark.createDataFrame(data, "g int, t int, k int").repartition(7)
    got = {r["k"]: (r["previous"], r["following"]) for r in with_neighbours(df, "g", ["t"], "k").collect()}
    for g, t, k in data:
        assert got[k] == (k - 10 if t else None, k + 10 if t < 49 else None)
    ranked = globally_ranked(df, ["g", "t"]).orderBy("g", "t").collect()
    assert [r["rank"] for r in ranked] == list(range(150))
