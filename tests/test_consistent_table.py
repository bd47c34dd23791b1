from decimal import Decimal

from graphloom.operators.schema_drift import consistent_table, failed_casts

FILES = "file_name string, feed string, workspace_fingerprint string, exported_at timestamp_ntz"
RUNS = "analysis_run_id long, position int, export_file string, project string, value_json string"
TURNS = "id long, position int, export_file string, snapshot_id string, snapshot string"


def table(spark, stats=(), turns=()):
    runs = spark.createDataFrame([(k, 0, "r", "p", '{"stats":%s}' % text) for k, text in enumerate(stats)], RUNS)
    return consistent_table(spark.createDataFrame([], FILES), runs, spark.createDataFrame(list(turns), TURNS))


def test_turns_are_in_the_table(spark):
    turns = [(1, 0, "t1", "ab", None), (2, 1, "t2", None, "sha256:cd"), (3, 2, "t2", None, "77"), (4, 3, "t2", None, '{"id":"x"}'), (5, 4, "t1", None, None)]
    found = table(spark, ['{"a":1}'], turns)
    got = sorted(tuple(r) for r in found.where("feed = 'turns'").select("turn_id", "field", "field_type", "raw_name", "raw_type", "text", "cast_failed").collect())
    one = ("snapshot_id", "text")
    assert got == [(1, *one, "snapshot_id", "text", "ab", False), (2, *one, "snapshot", "text", "sha256:cd", False), (3, *one, "snapshot", "integer", "77", False), (4, *one, "snapshot", "object", None, True)]
    report = {(r.export_file, r.raw_name): (r.rows, r.other_type, r.failed) for r in failed_casts(found).where("feed = 'turns'").collect()}
    assert report == {("t1", "snapshot_id"): (1, 0, 0), ("t2", "snapshot"): (3, 2, 1)}
    assert found.where("feed = 'runs'").count() == 1


def test_every_type_is_cast(spark):
    stats = ['{"i":1,"n":1.5,"b":true,"o":{"x":1},"l":[1],"s":"a"}'] * 3 + [
        '{"i":"1,234","n":"2","b":"False","o":"{}","l":"[2]","s":5}',
        '{"i":9.5,"n":"x","b":0,"o":[1],"l":{"x":1},"s":[1]}',
        '{"i":"12345678901234567","n":true,"b":"no","o":"x","l":3,"s":{}}',
    ]
    rows = table(spark, stats).where("analysis_run_id >= 3").collect()
    got = {(r.field, r.analysis_run_id): (r.cast_failed, *(v for v in (r.integer, r.number, r.flag, r.text, r.json) if v is not None)) for r in rows}
    assert {k for k, v in got.items() if v[0]} == {("i", 4), *((f, k) for f in "nbols" for k in (4, 5))}
    assert got["i", 3] == (False, Decimal(1234), 1234.0) and got["i", 4] == (True, 9.5) and got["i", 5][1] == Decimal(12345678901234567)
    assert got["n", 3] == (False, 2.0) and got["b", 3] == (False, False) and got["o", 3] == (False, "{}") and got["l", 3] == (False, "[2]") and got["s", 3] == (False, "5")
