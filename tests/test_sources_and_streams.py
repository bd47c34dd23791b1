import datetime as dt

import pytest
from pyspark.sql import functions as F

from graphloom.functions import java_numbers as J
from graphloom.operators import flow as W
from graphloom.operators import impact as I
from graphloom.operators import motifs as M
from graphloom.sources import changes, code, inventory, manifests, stores
from graphloom.streaming import watch as H


@pytest.mark.parametrize(
    ("name", "text", "want"),
    [
        ("pom.xml", "<project xmlns='x'><dependencies><dependency><groupId>g</groupId><artifactId>a</artifactId><version>1</version><optional>true</optional></dependency><dependency><groupId>g</groupId></dependency></dependencies></project>", [("maven", "g:a", "1", "compile", True)]),
        ("build.gradle.kts", "dependencies {\n  implementation(\"g:a:1\")\n  testImplementation 'g:b'\n  custom 'g:c:1'\n}", [("gradle", "g:a", "1", "implementation", False), ("gradle", "g:b", None, "testImplementation", False)]),
        ("requirements.txt", "a==1 # x\n-r other\n./local\nb[extra]>=2\n\nc", [("pypi", "a", "==1", "runtime", False), ("pypi", "b", ">=2", "runtime", False), ("pypi", "c", None, "runtime", False)]),
        ("pyproject.toml", '[tool.poetry.dependencies]\npython="3"\na={version="1",optional=true}\n[tool.poetry.group.dev.dependencies]\nb="2"', [("pypi", "a", "1", "runtime", True), ("pypi", "b", "2", "development", False)]),
        ("package.json", '{"dependencies":{"a":"^1"},"optionalDependencies":{"b":"2"}}', [("npm", "a", "^1", "runtime", False), ("npm", "b", "2", "optional", True)]),
        ("Cargo.toml", '[dependencies]\na="1"\n[dev-dependencies]\nb={path="x"}', [("cargo", "a", "1", "runtime", False), ("cargo", "b", None, "development", False)]),
        ("package.json", "{broken", []), ("pom.xml", "<a>", []), ("other.txt", "a==1", []), ("pom.xml", None, []),
    ],
)
def test_manifests(name, text, want):
    assert [tuple(d) for d in manifests.parse(name, text)] == want


def test_manifest_table(spark):
    files = spark.createDataFrame([("x/requirements.txt", "a==1\na==1"), ("y/none.txt", "b"), ("z/pom.xml", None)], "path string, content string")
    assert [tuple(r) for r in manifests.dependencies(files).collect()] == [("x/requirements.txt", "pypi", "a", "==1", "runtime", False)]


DIFF = """diff --git a/x.py b/x.py
--- a/x.py
+++ b/x.py
@@ -1,3 +1,4 @@ def f
 keep
-old
+new
++++plus
 end
@@ -10 +11,0 @@
-gone
diff --git a/old.txt b/new.txt
rename from old.txt
rename to new.txt
diff --git a/i.png b/i.png
Binary files a/i.png and b/i.png differ
diff --git a/n.py b/n.py
--- /dev/null
+++ b/n.py
@@ -0,0 +1,2 @@
+a
+b
\\ No newline at end of file
"""


def test_unified_diff(spark):
    assert [tuple(r) for r in changes.parse_diff(DIFF)] == [
        ("x.py", "x.py", "removed", 2), ("x.py", "x.py", "added", 2), ("x.py", "x.py", "added", 3), ("x.py", "x.py", "removed", 10),
        ("old.txt", "new.txt", "renamed", None), ("i.png", "i.png", "binary", None), (None, "n.py", "added", 1), (None, "n.py", "added", 2),
    ]
    got = changes.diff_lines(spark.createDataFrame([(1, DIFF), (2, None)], "id int, text string"))
    assert got.count() == 8 and changes.parse_diff("") == []


def test_change_log(spark):
    lines = ["@c1\t2025-01-01\tAnn", "1\t2\ta.py", "-\t-\tb.png", "", "@c2\t2025-01-02\tann", "3\t0\tc d.py"]
    got = changes.change_log(spark.createDataFrame(list(enumerate(lines)), "id bigint, value string")).orderBy("commit", "path").collect()
    assert [(r["commit"], r["path"], r["additions"], r["deletions"]) for r in got] == [("c1", "a.py", 1, 2), ("c1", "b.png", None, None), ("c2", "c d.py", 3, 0)]
    assert got[0]["contributor_id"] == got[2]["contributor_id"]
    far = [(0, "@c1\tt\ta"), (250_000, "1\t1\tx"), (300_001, "@c2\tt\tb"), (300_002, "2\t2\ty"), (900_000, "3\t3\tz")]
    got = changes.change_log(spark.createDataFrame(far, "id bigint, value string")).orderBy("path").collect()
    assert [(r["commit"], r["path"]) for r in got] == [("c1", "x"), ("c2", "y"), ("c2", "z")]


def test_declarations(spark):
    java = 'package a; // class No {}\npublic class A extends B {\n  private int n = 1;\n  String s = "class X {";\n  public static void run(int a) { }\n  interface In { }\n}\nenum E { }'
    assert [tuple(d) for d in code.java(java)] == [("class", "A", "", 2), ("field", "n", "A", 3), ("method", "run", "A", 5), ("interface", "In", "A", 6), ("enum", "E", "", 8)]
    assert [tuple(d) for d in code.python("class A:\n  def f(self): pass\nasync def g(): pass")] == [("class", "A", "", 1), ("method", "f", "A", 2), ("function", "g", "", 3)]
    assert [d.name for d in code.typescript("export interface I {}\n// class No {}\nexport default class C {}\nconst x = 1")] == ["I", "C", "x"]
    blocks = spark.createDataFrame([(1, 0, "python", "def f(: broken"), (2, 0, "sql", "select 1 from t join u"), (3, 0, "other", "x")], "id bigint, block int, language string, code string")
    assert [r["name"] for r in code.declarations(blocks).collect()] == ["t", "u"]


def test_settings_files():
    assert code.properties("a=1\n# no\nb : two \\\n  more\nc\\=d=x\n!e") == {"a": "1", "b": "two more", "c=d": "x"}
    assert code.flattened_yaml("a:\n  b: 1 # c\n  l:\n    - x\n    - k: v\n      m: w\ntop: 'q'\n") == {"a.b": "1", "a.l[0]": "x", "a.l[1].k": "v", "a.l[1].m": "w", "top": "q"}


def test_inventory(spark, tmp_path, rows):
    (tmp_path / "src" / "main").mkdir(parents=True)
    (tmp_path / ".git").mkdir()
    for name, text in {"src/main/A.java": "class A {}", "README.md": "# Hi", ".git/x": "no", "pom.xml": "<project/>"}.items():
        (tmp_path / name).write_text(text)
    assert inventory.scan(spark, str(tmp_path)).count() == 3
    assert [r["content"] for r in inventory.load_documents(spark, str(tmp_path)).collect()] == ["# Hi"]
    paths = ["src/main/java/A.java", "src/test/java/A.java", "a/b/fixtures/x.py", "src/main/test/X.kt", "build/out.js", "pom.xml", "docs/a.md", "lib/x.so", "logo.PNG", "Makefile", "no_suffix"]
    got = {r["path"]: r["kind"] for r in inventory.classified(spark.createDataFrame([(p,) for p in paths], "path string")).collect()}
    assert list(got[p] for p in paths) == ["source", "source", "source", "source", "generated", "build", "documentation", "binary", "asset", "build", "unknown"]
    files = spark.createDataFrame([("p", "x/pom.xml", "1"), ("p", "y/pom.xml", "2"), ("q", "Cargo.toml", "3")], "project string, path string, sha256 string")
    assert rows(inventory.technologies(files)) == [("p", "maven", 2), ("q", "cargo", 1)]
    one, two = inventory.project_fingerprints(files).collect(), inventory.project_fingerprints(files.orderBy(F.rand())).collect()
    assert sorted(map(tuple, one)) == sorted(map(tuple, two))


def test_snapshot_round_trip(spark, tmp_path):
    tables = {"nodes": spark.range(10).withColumn("x", F.lit("é")), "edges": spark.range(0)}
    stores.publish_snapshot(tables, str(tmp_path), "one")
    stores.publish_snapshot({"nodes": spark.range(3)}, str(tmp_path), "two")
    assert stores.load_snapshot(spark, str(tmp_path))["nodes"].count() == 3
    assert sorted(stores.load_snapshot(spark, str(tmp_path), "one")) == ["edges", "nodes"]
    spark.range(5).write.mode("overwrite").parquet(f"{tmp_path}/two/nodes.parquet")
    with pytest.raises(ValueError, match="differs"):
        stores.load_snapshot(spark, str(tmp_path))


def test_stores(spark, rows):
    runs = spark.range(1, 8)
    assert [r["id"] for r in stores.history_page(runs, 2, 1).collect()] == [6, 5]
    assert rows(stores.pruned(runs, 3)) == [(5,), (6,), (7,)] and rows(stores.pruned(runs.limit(0), 3)) == []
    assert rows(stores.eligible_runs(runs, spark.createDataFrame([(1,), (1,), (None,)], "analysis_run_id bigint"))) == [(k,) for k in range(2, 8)]
    held = spark.createDataFrame([(1, 4)], "conversation_id int, position int")
    new = spark.createDataFrame([(1, 9), (1, 8), (2, 1)], "conversation_id int, seq int")
    assert sorted(tuple(r) for r in stores.appended_messages(held, new).select("conversation_id", "seq", "position").collect()) == [(1, 8, 5), (1, 9, 6), (2, 1, 0)]
    findings = spark.createDataFrame([("R", "high", 'say "x"', "a", 1, "f")], "rule_id string, severity string, message string, path string, line int, fingerprint string")
    import json

    report = json.loads(stores.sarif_report(findings, "tool", 10))
    assert report["runs"][0]["results"][0]["message"]["text"] == 'say "x"' and report["runs"][0]["results"][0]["level"] == "error"
    assert "&lt;b&gt;" in stores.dashboard(spark.createDataFrame([("<b>", 1)], "project string, failed int"))


DIAMOND = [(1, 1, 1, ["x"], []), (1, 2, 2, ["y"], ["x"]), (1, 3, 3, ["x"], []), (1, 4, 4, [], ["x", "y"]), (1, 9, 9, ["z"], None)]


def test_flow_on_a_diamond_with_a_loop(spark, rows):
    blocks = spark.createDataFrame(DIAMOND, "method bigint, block bigint, position bigint, defines array<string>, uses array<string>")
    edges = spark.createDataFrame([(1, 1, 2), (1, 1, 3), (1, 2, 4), (1, 3, 4), (1, 4, 1), (1, 4, 77)], "method bigint, source bigint, target bigint")
    get = lambda name: {tuple(r)[1:] for r in W.analyse(blocks, edges, name).collect()}
    assert {r for r in get("reaching_definitions") if r[0] == 4} == {(4, "x", 1), (4, "x", 3), (4, "y", 2)}
    assert {r[:2] for r in get("liveness")} == {(1, "y"), (2, "x"), (3, "y"), (4, "x"), (4, "y")}
    assert (2, "x", 1) in get("def_use") and {r[:2] for r in get("dead_assignments")} == {(9, "z")}
    assert {r for r in get("dominators") if r[0] == 4} == {(4, None, 1), (4, None, 4)} and not {r for r in get("dominators") if r[0] == 9}
    assert len(get("reverse_postorder")) == 4 and (1, None, 0) in get("reverse_postorder")
    assert W.analyse(blocks.limit(0), edges, "liveness").collect() == []


def test_folds(spark, rows):
    steps = spark.createDataFrame([(1, 2, "b", None, ["a"]), (1, 1, "a", "x.read", []), (1, 3, "c", "x.clean", ["b"]), (1, 4, "b", None, []), (1, 5, "d", None, ["b", "a"])], "program bigint, position bigint, target string, call string, arguments array<string>")
    assert rows(W.sequential_taint(steps, (".read",), (".clean",))) == [(1, 1, "a"), (1, 2, "b"), (1, 5, "d")]
    sums = spark.createDataFrame([(1, 1, "a", "=", "2147483647", None), (1, 2, "b", "+", "a", "1"), (1, 3, "c", "/", "b", "0"), (1, 4, "d", "*", "c", "2")], "program bigint, position bigint, target string, op string, left string, right string")
    assert rows(W.constant_values(sums)) == [(1, "a", 2147483647), (1, "b", -2147483648), (1, "c", None), (1, "d", None)]
    nulls = spark.createDataFrame([(1, 1, "a", "null"), (1, 1, "a", "nonnull"), (1, 2, "b", "a"), (1, 2, "c", "zzz")], "method bigint, position bigint, variable string, source string")
    assert rows(W.nullability(nulls)) == [(1, "a", "maybe_null"), (1, "b", "maybe_null"), (1, "c", "unknown")]


@pytest.mark.parametrize(("op", "a", "b", "want"), [("+", 2**31 - 1, 1, -(2**31)), ("/", -7, 2, -3), ("%", -7, 2, -1), ("<<", 1, 33, 2), (">>>", -1, 28, 15), (">>", -8, 1, -4), ("/", 1, 0, None), ("*", 65536, 65536, 0)])
def test_wrapping_arithmetic(op, a, b, want):
    assert J.binary(op, a, b) == want


def test_impact_and_reachability(spark, rows):
    nodes = spark.createDataFrame([(x, "type") for x in "abcd"] + [("m", "concept")], "id string, kind string")
    edges = spark.createDataFrame([("b", "a", "calls", ["call_graph.v1:calls"]), ("c", "a", "depends_on", ["e", "uses"]), ("d", "b", "depends_on", ["workspace.projects:x"]), ("d", "c", "calls", ["call_graph.v1:calls"]), ("a", "d", "calls", []), ("a", "c", "calls", ["calls"]), ("m", "a", "depends_on", ["uses"])], "source string, target string, relation string, evidence array<string>")
    legal = I.legal_edges(nodes, edges, "signature")
    assert legal.count() == 4
    found = I.propagate(legal, spark.createDataFrame([("a",)], "root string"))
    assert {(r["node"], r["hops"], r["weakest"]) for r in found.collect()} == {("b", 1, 0.98), ("c", 1, 0.78), ("d", 2, 0.78)}
    # d by way of b: supports .81 and .7216, coverage .7 / 1.1 times the weaker support's share of the mean
    assert {(r["node"], r["confidence"], r["tier"]) for r in I.path_confidence(found).collect()} == {("b", 0.567, "low"), ("c", 0.5412, "low"), ("d", 0.4592, "low")}
    kinds = spark.createDataFrame([("type", "PUBLIC", "removal"), ("type", None, "removal"), ("method", "private", "rename"), ("concept", "public", "removal")], "k string, v string, c string")
    assert [r[0] for r in kinds.select(I.breaking_state(F.col("k"), F.col("v"), F.col("c"), F.lit(None).cast("boolean"))).collect()] == ["potentially_breaking", "not_evaluated", "not_applicable", "unsupported"]


def test_motifs(spark, rows):
    data = [("i1", "t", "inherits"), ("i2", "t", "inherits"), ("c", "t", "uses"), ("i1", "t", "uses"), ("f", "t", "returns"), ("f", "i1", "constructs"), ("f", "i2", "constructs"), ("i1", "t", "composes"), ("i1", "t", "calls"), ("i2", "z", "composes"), ("i2", "z", "calls"), ("v", "t", "composes"), ("v", "t", "calls")]
    facts = spark.createDataFrame(data, "source string, target string, relation string")
    assert rows(M.strategies(facts)) == [("t", "c", 2)] and rows(M.factories(facts)) == [("f", "t", 2)]
    assert rows(M.decorators(facts)) == [("i1", "t")] and rows(M.adapters(facts)) == [("i2", "t", "z")]
    assert rows(M.commands(facts)) == [("t", "i1", "i2", "z"), ("t", "v", "i2", "z")]
    methods = spark.createDataFrame([("B", "a", "B"), ("B", "b", "B"), ("B", "build", "X"), ("C", "a", "C"), ("C", "b", "C")], "owner string, name string, returns string")
    assert rows(M.builders(methods)) == [("B",)]


def test_poll_and_debounce(spark, rows):
    old = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "3"), ("k", "4")], "path string, sha256 string")
    new = spark.createDataFrame([("a2", "1"), ("b", "9"), ("n", "7"), ("k", "4")], "path string, sha256 string")
    assert rows(H.poll_events(old, new)) == [("a2", "renamed", "a"), ("b", "modified", None), ("c", "deleted", None), ("n", "created", None)]
    t = lambda ms: dt.datetime(2025, 1, 1) + dt.timedelta(milliseconds=ms)
    data = [(t(0), "p", "f", "created"), (t(50), "p", "f", "modified"), (t(120), "p", "f", "modified"), (t(1000), "p", "f", "deleted"), (t(0), "p", "g", "created"), (t(10), "p", "g", "deleted"), (t(0), "p", "h", "modified"), (t(20), "p", "h", "deleted")]
    events = spark.createDataFrame(data, "ts timestamp_ntz, project string, path string, kind string")
    assert rows(H.debounced(events).select("path", "kind", "events")) == [("f", "created", 3), ("f", "deleted", 1), ("h", "deleted", 2)]


def test_health_fold_equals_aggregates_and_stream(spark, tmp_path):
    import random

    rnd = random.Random(2)
    data = [(f"p{k % 7}", dt.datetime(2025, 1, 1) + dt.timedelta(seconds=rnd.randrange(60)), k, rnd.random() < 0.6) for k in range(200)] + [("ok", dt.datetime(2025, 1, 1), 1000, True)]
    schema = "plugin string, at timestamp_ntz, seq bigint, success boolean"
    want = {}
    for plugin, at, seq, success in sorted(data, key=lambda r: (r[1], r[2])):
        held = want.get(plugin, (("unknown", 0, 0), 0))
        want[plugin] = (H._step(held[0], success, 3, 2), held[1] + 1)
    want = sorted((p, *s, n) for p, (s, n) in want.items())
    df = spark.createDataFrame(data, schema)
    assert sorted(tuple(r) for r in H.health(df).collect()) == want
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = H.health_stream(spark.readStream.schema(schema).parquet(str(tmp_path / "in")))
    got = {}
    query = stream.writeStream.outputMode("update").foreachBatch(lambda d, n: got.update({r["plugin"]: tuple(r) for r in d.collect()})).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    query.awaitTermination()
    assert sorted(got.values()) == want


def test_stream_windows_equal_batch(spark, tmp_path, rows):
    events = spark.range(500).select((F.timestamp_seconds(F.lit(1_700_000_000) + F.col("id") * 60)).cast("timestamp_ntz").alias("ts"), (F.col("id") % 3).cast("string").alias("kind"))
    events.write.parquet(str(tmp_path / "in"))
    stream = H.event_rates(spark.readStream.schema(events.schema).parquet(str(tmp_path / "in")), late="0 seconds")
    H.run_to_end(stream, lambda d, n: d.write.mode("append").parquet(str(tmp_path / "out")), str(tmp_path / "state"))
    got, want = set(rows(spark.read.parquet(str(tmp_path / "out")))), set(rows(H.event_rates(events)))
    assert got < want and len(want - got) <= 3  # the last window is still open


def test_leases(spark, rows):
    log = [("a", 0.0, 1, "lease", "w"), ("a", 9.0, 2, "heartbeat", "w"), ("b", 0.0, 3, "lease", "w"), ("c", 0.0, 4, "lease", "w"), ("c", 1.0, 5, "fail", "w"), ("d", 0.0, 6, "lease", "w"), ("d", 1.0, 7, "complete", "w"), ("e", 0.0, 8, "heartbeat", None)]
    got = {r[0]: r[1] for r in rows(H.lease_states(spark.createDataFrame(log, "job string, at_s double, seq int, kind string, worker string"), 10.0, 5.0, 3))}
    assert got == {"a": "leased", "b": "expired", "c": "pending", "d": "succeeded", "e": "pending"}


def test_modules_projects_and_audit(spark, rows):
    pom = "<project><parent><groupId>g</groupId><artifactId>root</artifactId></parent><artifactId>{}</artifactId><dependencies><dependency><groupId>g</groupId><artifactId>{}</artifactId></dependency></dependencies></project>"
    files = [("pom.xml", "<project><groupId>g</groupId><artifactId>root</artifactId><modules><module>a</module><module>b</module></modules></project>"), ("a/pom.xml", pom.format("a", "b")), ("b/pom.xml", pom.format("b", "gone")), ("c/pom.xml", "<broken"), ("c/package.json", "{}"), ("a/x/build.gradle", ""), ("a/x/y.txt", None)]
    df = spark.createDataFrame(files, "path string, content string")
    assert rows(manifests.module_graph(df)) == [("g:a", "g:b", "depends_on"), ("g:b", "g:gone", "unresolved"), ("g:root", "g:a", "contains"), ("g:root", "g:a", "parent_of"), ("g:root", "g:b", "contains"), ("g:root", "g:b", "parent_of")]
    assert rows(inventory.discovered_projects(df)) == [(".", "maven", None), ("a", "maven", "."), ("a/x", "gradle", "a"), ("b", "maven", "."), ("c", "maven,npm", ".")]
    from graphloom.operators.aggregates import chain_breaks

    entries = stores.audit_entries(None, 1, ["x", "y", "z"])
    entries += stores.audit_entries(entries[-1][3], 4, ["w"])
    log = spark.createDataFrame([(k, link, digest) for k, link, _, digest in entries], "seq int, link string, digest string")
    assert chain_breaks(log, "seq", "link", "digest").count() == 0
    assert chain_breaks(log.withColumn("digest", F.when(F.col("seq") == 2, "forged").otherwise(F.col("digest"))), "seq", "link", "digest").count() == 1
