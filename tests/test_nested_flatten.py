import datetime as dt
import json
import random

import pyarrow as pa

from graphloom.operators.nested_flatten import PROJECT_RUNS, flatten_texts, nested_items, slices

T0 = dt.datetime(2025, 1, 1)


def compact(value):
    return json.dumps(value, separators=(",", ":"), ensure_ascii=False)


def walk(value, stem, spec, out):
    for name, deeper in spec.items():
        held = value.get(name)
        for k, x in enumerate(held if isinstance(held, list) else [held]):
            if isinstance(x, dict):
                path = f"{stem}.{name}[{k}]" if stem else f"{name}[{k}]"
                out.append((path, stem))
                walk(x, path, deeper, out)


def random_value(rnd, depth=0):
    names = ["modules", "types", "methods", "findings", "trace", "evidence", "name", 'od"d', "b\\", "[", "é{"]
    kind = rnd.random()
    if depth > 6 or kind < 0.2:
        return rnd.choice([None, 1, -2.5, True, "", 'a"b', "x\\", '{"modules":[{}]}', "[,]", "日本"])
    if kind < 0.6:
        return {rnd.choice(names): random_value(rnd, depth + 1) for _ in range(rnd.randrange(4))}
    return [random_value(rnd, depth + 1) for _ in range(rnd.randrange(4))]


def test_kernels_against_walking():
    rnd = random.Random(5)
    values = [{"modules": random_value(rnd), "findings": random_value(rnd), "x": random_value(rnd)} if rnd.random() < 0.8 else random_value(rnd) for _ in range(600)]
    texts = pa.array([compact(v) for v in values], pa.string())
    for part in (texts, texts.slice(100, 300), texts.cast(pa.large_string())):
        start = 100 if len(part) == 300 else 0
        row, path, parent = flatten_texts(part, PROJECT_RUNS)
        got = sorted(zip(row.tolist(), path.to_pylist(), parent.to_pylist()))
        want = []
        for k in range(len(part)):
            own = []
            if isinstance(values[start + k], dict):
                walk(values[start + k], "", PROJECT_RUNS, own)
            want += [(k, p, s) for p, s in own]
        assert got == sorted(want)


def test_tables(spark, rows):
    runs = spark.createDataFrame(
        [
            (1, 0, '{"modules":[null,{"types":{"methods":[{"name":"a"},3]}}],"findings":{"trace":[{"evidence":[{}]}]}}', T0, "x"),
            (1, 0, '{"modules":[{}]}', T0 - dt.timedelta(1), "x"),  # superseded
            (2, 0, "{bad", T0, "x"), (3, 0, None, T0, "x"), (4, 1, "[]", T0, "x"), (5, 0, '"{\\"modules\\": {}}"', T0, "x"),
        ],
        "analysis_run_id bigint, position int, value_json string, received_at timestamp_ntz, record_id string",
    )
    analyses = spark.createDataFrame([(7, '["a", null, {"project":"b","scopes":[{"path":"x"},null,{"path":"y"}]}, 4, ""]', T0), (8, '{"project":"c","scopes":{"path":"z"}}', T0), (9, "[]", T0)], "id bigint, requested_json string, received_at timestamp_ntz")
    turns = spark.createDataFrame(
        [
            (1, '[{"code":"x","subjects":[null,{"subject_id":"s"}]}]', "2025-01-01T00:00:00Z"),
            (1, '["y"]', "2025-01-01T00:30:00+01:00"),  # earlier
            (2, '"[\\"z\\"]"', "2025-01-01T00:00:00Z"), (3, '["cut', "2025-01-01T00:00:00Z"), (4, None, None),
        ],
        "id bigint, limitations_json string, updated_at string",
    )
    assert rows(nested_items(runs, analyses, turns)) == sorted(
        [
            ("project_runs", 1, 0, "modules[1]", ""), ("project_runs", 1, 0, "modules[1].types[0]", "modules[1]"),
            ("project_runs", 1, 0, "modules[1].types[0].methods[0]", "modules[1].types[0]"), ("project_runs", 1, 0, "findings[0]", ""),
            ("project_runs", 1, 0, "findings[0].trace[0]", "findings[0]"), ("project_runs", 1, 0, "findings[0].trace[0].evidence[0]", "findings[0].trace[0]"),
            ("project_runs", 5, 0, "modules[0]", ""),
            ("analysis_runs", 7, -1, "[0]", ""), ("analysis_runs", 7, -1, "[2]", ""), ("analysis_runs", 7, -1, "[2].scopes[0]", "[2]"), ("analysis_runs", 7, -1, "[2].scopes[2]", "[2]"), ("analysis_runs", 7, -1, "[4]", ""),
            ("analysis_runs", 8, -1, "[0]", ""), ("analysis_runs", 8, -1, "[0].scopes[0]", "[0]"),
            ("conversation_turns", 1, -1, "[0]", ""), ("conversation_turns", 1, -1, "[0].subjects[1]", "[0]"), ("conversation_turns", 2, -1, "[0]", ""),
        ],
        key=repr,
    )
    assert rows(nested_items(runs.limit(0), analyses.limit(0), turns.limit(0))) == []


def test_slices_hold_all_rows_in_order():
    texts = pa.array(["x" * n for n in (5, 0, 3, 20, 1, 1, 1)])
    for size in (1, 4, 8, 100):
        found = list(slices(texts, size))
        assert [k for start, length in found for k in range(start, start + length)] == list(range(7))
        assert all(length == 1 or sum(len(texts[k].as_py()) for k in range(start, start + length)) <= size for start, length in found)
    whole = pa.array(['{"modules":[{"a":1},{"types":[{}]}]}', "{}", '{"modules":{"a":2}}'])
    rows = lambda t, base: [(int(r) + base, p) for r, p in zip(*(x.tolist() if hasattr(x, "tolist") else x.to_pylist() for x in flatten_texts(t, PROJECT_RUNS)[:2]))]
    parts = [x for start, length in slices(whole, 10) for x in rows(whole.slice(start, length), start)]
    assert sorted(parts) == sorted(rows(whole, 0))
    assert list(slices(whole.slice(0, 0))) == []
