import datetime as dt

from graphloom.operators.schema_drift import schema_changes

FILES = "file_name string, feed string, workspace_fingerprint string, exported_at timestamp_ntz"
RUNS = "export_file string, project string, value_json string, kind string"
TURNS = "export_file string, snapshot_id string, snapshot string"


def day(n):
    return dt.datetime(2025, 1, n)


def test_changes(spark, rows):
    files = spark.createDataFrame(
        [("r2", "runs", "w", day(2)), ("r1", "runs", "w", day(1)), ("r3", "runs", "w", day(3)), ("v1", "runs", "v", day(1)), ("t1", "turns", "w", day(1)), ("t2", "turns", "w", day(2)), ("t3", "turns", "w", day(3)), ("t4", "turns", "w", day(4)), ("r3", "runs", "w", day(3))],
        FILES,
    )
    runs = spark.createDataFrame(
        [
            ("r1", "p", '{"stats":{"a":1,"b":"x","gone":5,"n":null}}', None), ("r1", "q", '{"stats":{"a":2,"b":"y"}}', None),
            ("r2", "p", '{"stats":{"c":1,"b":"x","d":9.5,"n":1}}', None), ("r2", "q", '"{\\"stats\\":{\\"c\\":2,\\"other\\":77}}"', None), ("r2", "q", '{"stats":{"c"', None), ("r2", None, '{"stats":[1]}', None),
            ("r3", "p", '{"stats":{"c":"1","d":9,"b":[1]}}', None), ("r3", "p", None, None), ("lost", "p", '{"stats":{"z":1}}', None), (None, "p", '{"stats":{"z":1}}', None),
        ],
        RUNS,
    )
    turns = spark.createDataFrame([("t1", "123", None), ("t1", None, None), ("t2", None, "456"), ("t3", None, '{"id": "x"}'), ("t4", "sha256:ab", None)], TURNS)
    assert rows(schema_changes(files, runs, turns)) == sorted(
        [
            ("r2", "renamed", "a", "c"), ("r2", "removed", "gone", ""), ("r2", "added", "d", ""), ("r2", "added", "n", ""), ("r2", "added", "other", ""),
            ("r3", "retyped", "c", ""), ("r3", "retyped", "d", ""), ("r3", "retyped", "b", ""), ("r3", "removed", "n", ""), ("r3", "removed", "other", ""),
            ("t2", "renamed", "snapshot_id", "snapshot"), ("t3", "retyped", "snapshot", ""), ("t4", "removed", "snapshot", ""), ("t4", "added", "snapshot_id", ""),
        ],
        key=repr,
    )


def test_empty(spark, rows):
    assert rows(schema_changes(spark.createDataFrame([], FILES), spark.createDataFrame([], RUNS), spark.createDataFrame([], TURNS))) == []
