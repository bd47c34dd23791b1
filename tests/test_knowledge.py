"""The knowledge graph, searches with their ways, value flow and plans against small cases and brute force."""

import random

import pytest
from pyspark.sql import functions as F

from graphloom.operators import knowledge as K
from graphloom.operators import rules as R
from graphloom.operators import security as X
from graphloom.operators import traversal as V
from graphloom.operators.flow import Method
from graphloom.operators.graph import nearest
from graphloom.operators.ordering import ranked_within
from graphloom.sources import code as C

SYMBOLS = "id string, kind string, name string, qualified_name string, project string, extra int"
EDGES = "source string, target string"


def symbols(spark, data):
    return spark.createDataFrame([(*d, 1) for d in data], SYMBOLS)


def test_graph_of_facts(spark, rows):
    projects = spark.createDataFrame([("p",), ("p",), (None,)], "name string")
    own = symbols(spark, [("t:a", "type", "A", "x.A", "p"), ("t:a", "type", "A", "x.A", "q"), (None, "type", "B", "B", "p"), ("t:c", "type", None, None, None)])
    needs = spark.createDataFrame([("p", "lib"), ("q", "lib"), (None, "lib"), ("p", None)], "project string, name string")
    links = spark.createDataFrame([("t:a", "t:c", "calls", "y"), ("t:a", "t:c", "calls", "x"), ("t:a", None, "calls", "x")], EDGES + ", relation string, evidence string")
    assert rows(K.graph_nodes(projects, own, needs)) == sorted([("project:p", "project", "p", "p"), ("t:a", "type", "A", "p"), ("t:c", "type", None, None), ("dependency:lib", "dependency", "lib", None)], key=repr)
    got = {(r["source"], r["target"], r["relation"]): r["evidence"] for r in K.graph_edges(own, needs, links).collect()}
    assert got[("t:a", "t:c", "calls")] == ["x", "y"] and ("project:q", "t:a", "owns") in got and ("t:a", "project:p", "member_of") in got and ("project:p", "dependency:lib", "depends_on") in got
    assert len(got) == 7
    assert rows(K.graph_edges(own.limit(0), needs.limit(0), links.limit(0))) == []


def test_first_symbols_take_the_first_stage(spark, rows):
    own = symbols(spark, [("b", "type", "Cache", "x.Cache", "p"), ("a", "type", "CACHE", "y.Cache", "p"), ("cache", "type", "Other", None, None)])
    wanted = spark.createDataFrame([("Cache",), ("X.CACHE",), ("Other",), ("none",), (None,), ("cache",)], "term string")
    assert rows(K.first_symbols(wanted, own)) == sorted([("Cache", 1, "cache", 1), ("cache", 1, "cache", 1), ("X.CACHE", 2, "b", 1), ("Other", 3, "cache", 1), ("none", None, None, 0)], key=repr)


def test_index_and_candidates(spark, rows):
    nodes = spark.createDataFrame([("1", "type", "DataCache", "core"), ("2", "type", "cache", "app"), ("3", "method", None, "core"), ("4", "type", "", None)], "id string, kind string, name string, project string")
    words = K.index_postings(nodes)
    assert {(r["term"], r["id"]) for r in words.collect()} >= {("data", "1"), ("cache", "1"), ("cache", "2"), ("core", "3"), ("type", "4")}
    held = K.index_concepts(words, {"caching": ("cache", "data cache"), "never": ("no such",)})
    assert rows(held) == [("caching", "1", 0.7), ("caching", "2", 0.6)]
    assert rows(K.candidates(nodes, words, held, ["cache", "data"], ["caching"], ["type"])) == [("1", 2), ("2", 1)]
    assert rows(K.candidates(nodes, words, held, projects=["core"])) == [("1", 0), ("3", 0)]
    assert rows(K.candidates(nodes, words, held, ["cache"], ["caching", "never"])) == []
    assert rows(K.candidates(nodes, words, held, ["cache"], ["caching", "never"], every_concept=False)) == [("1", 1), ("2", 1)]


def test_architectures_need_groups_and_a_link(spark, rows):
    tokens = spark.createDataFrame([("a", t) for t in ("controller", "api", "service", "dao")] + [("b", "port"), ("c", "controller"), ("c", "service"), (None, "port")], "scope string, term string")
    assert rows(K.architectures(tokens, spark.createDataFrame([("a",), ("b",), ("a",)], "scope string"))) == [("a", "layered", 3, 0.64)]


@pytest.mark.parametrize("seed", range(3))
def test_traversal_against_brute_force(spark, seed):
    rnd = random.Random(seed)
    links = {(f"n{rnd.randrange(14)}", f"n{rnd.randrange(14)}") for _ in range(22)}
    roots = sorted({f"n{rnd.randrange(14)}" for _ in range(3)})
    depth = {r: (0, r, None) for r in roots}
    level = 0
    while True:
        found = {}
        for a, b in links:
            if a in depth and depth[a][0] == level and b not in depth:
                found[b] = min(found.get(b, ("~", "~")), (depth[a][1], a))
        if not found:
            break
        level += 1
        depth |= {b: (level, *best) for b, best in found.items()}
    df = spark.createDataFrame(sorted(links) + [("n1", None)], EDGES)
    got = V.traverse(df, spark.createDataFrame([(r, "x") for r in roots] + [(None, "x")], "id string, category string")).collect()
    assert {r["node"]: (r["depth"], r["root"], r["predecessor"]) for r in got} == depth
    assert all(len(r["path"]) == r["depth"] + 1 and r["path"][0] == r["root"] and r["path"][-1] == r["node"] for r in got)
    near = nearest(df, spark.createDataFrame([(r,) for r in roots], "id string")).collect()
    assert {r["node"]: r["depth"] for r in near} == {n: d for n, (d, _, _) in depth.items()}


def test_owners_and_relations(spark, rows):
    up = spark.createDataFrame([("m", "t"), ("t", "a"), ("t", "b"), ("a", "p"), ("b", "p"), ("p", "t")], EDGES)
    nodes = spark.createDataFrame([("t", "type"), ("a", "module"), ("b", "module"), ("p", "project"), ("m", "method")], "id string, kind string")
    assert rows(V.owners(up, nodes, spark.createDataFrame([("m",), ("p",), (None,)], "id string"), ["module", "project"])) == [("m", "module", "a", 2), ("m", "project", "p", 3), ("p", "module", "a", 2)]
    links = spark.createDataFrame([("m", "t", "member_of"), ("m", "a", "member_of"), ("m", "m", "calls"), ("m", "x", "calls"), ("t", "a", "imports")], EDGES + ", relation string")
    assert rows(V.reach_relations(links, nodes)) == [("m", "m"), ("m", "t")]


def test_plans_and_seams_tell_what_is_left_out(spark, rows):
    plans = spark.createDataFrame([("a", 2.0, 1), ("a", 1.0, 9), ("b", 3.0, 1), ("c", 3.0, 1)], "k string, cost double, via int")
    assert rows(V.top_plans(plans, ["k"], [F.col("cost").desc(), F.col("k")], ["cost", "via"], 2)) == [("b", 3.0, 1, 1), ("c", 3.0, 1, 1)]
    cycles = spark.createDataFrame([(["a", "b"],), (["a", "b", "c"],)], "path array<string>")
    assert rows(V.cycle_seams(cycles, 2)) == [("a", "b", 2, 2), ("b", "a", 1, 2)]
    assert rows(V.cycle_seams(cycles.limit(0))) == []


def test_taint_crosses_methods_and_stops_at_sanitisers(spark, rows):
    inner = spark.createDataFrame([("m", "x", "y"), ("n", "p", "q"), ("k", "p", "r")], "method string, source string, target string")
    into = spark.createDataFrame([("m", "y", "n", "p"), ("m", "y", "k", "p")], "caller string, argument string, callee string, parameter string")
    back = spark.createDataFrame([("m", "z", "n", "q")], "caller string, result string, callee string, value string")
    flow = V.value_flow(inner, into, back)
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "id string")
    assert rows(V.tainted_sinks(flow, ids("m#x"), ids("m#z", "k#r", "n#zz"), ids("k#p"))) == [("m#z", 4)]
    assert rows(V.tainted_sinks(flow, ids("m#x"), ids("m#z"), ids("m#x"))) == []


def test_suffixes_and_framework_rules(spark, rows):
    calls = spark.createDataFrame([(1, "a.b.exec"), (2, "exec"), (3, "a.bexec"), (4, None), (5, "")], "call_id int, name string")
    rules = spark.createDataFrame([("R1", "exec"), ("R2", "b.exec"), ("R2", "b.exec")], "rule_id string, suffix string")
    assert rows(V.suffix_hits(calls, rules)) == [(1, "R1"), (1, "R2"), (2, "R1")]
    used = spark.createDataFrame([("p", "web"), ("p", "web"), ("q", None), (None, "web")], "project string, framework string")
    table = spark.createDataFrame([("web", "source", "param"), ("*", "sink", "exec")], "framework string, role string, suffix string")
    assert rows(V.framework_rules(used, table)) == [("p", "sink", "exec"), ("p", "source", "param")]


def test_reuse_and_resume(spark, rows):
    edges = spark.createDataFrame([("b", "a"), ("c", "b"), ("d", "x")], EDGES)
    before = spark.createDataFrame([("a", 1), ("b", 1), ("c", 1), ("d", 1), ("g", 1)], "project string, fingerprint int")
    after = spark.createDataFrame([("a", 2), ("b", 1), ("c", 1), ("d", 1), ("n", 1)], "project string, fingerprint int")
    assert rows(V.reuse_plan(before, after, edges)) == [("a", "run", 0), ("b", "rerun", 1), ("c", "rerun", 2), ("d", "reuse", None), ("g", "dropped", 0), ("n", "run", 0)]
    log = spark.createDataFrame([("a", 1, False), ("a", 2, False), ("b", 1, False), ("c", 1, True), ("d", 1, False), (None, 1, True)], "task string, seq int, succeeded boolean")
    assert rows(V.resume_plan(log, edges, 2)) == [("a", 2, "give_up"), ("b", 1, "wait"), ("c", 0, "skip"), ("d", 1, "retry")]


def test_gates_and_rule_cases(spark, rows):
    found = spark.createDataFrame([(1, "R1", "a/x.java"), (2, "R2", "a/x.java"), (3, "R1", None), (4, "R3", "b/y.java")], "finding_id int, rule_id string, path string")
    held = spark.createDataFrame([(1, None, "a/x.java"), (2, "R1", None)], "place int, rule_id string, path string")
    assert [(r[0], r[3], r[4]) for r in rows(R.gated(found, held, exclude=["b/**"], disabled=["R2"]))] == [(1, "suppressed", 1), (2, "disabled", None), (3, "outside", None), (4, "outside", None)]
    one, two = spark.createDataFrame([(1, "R"), (1, "R"), (2, "R")], "k int, rule_id string"), spark.createDataFrame([(1, "R"), (3, "S")], "k int, rule_id string")
    assert rows(R.rule_test(one, two, "k")) == [("R", 1, 0, 1, False), ("S", 0, 1, 0, False)]


def test_scope_and_retained(spark, rows):
    found = spark.createDataFrame([("p", "s", "c", "high", None), ("q", "s", "c", "low", "java"), (None, "t", "d", "low", "java")], "project string, symbol string, category string, severity string, language string")
    assert X.in_scope(found).count() == 3 and X.in_scope(found, projects=["p"], languages=["java"]).count() == 0 and X.in_scope(found, severities=["low"], symbols=["t"]).count() == 1
    assert rows(X.retained(found.select("severity"), [F.col("severity")], 2)) == [("high", 3, 1), ("low", 3, 1)]
    texts = spark.createDataFrame([("see /usr/lib/x",), ("C:\\temp",), ("a/b/c",), ("x = 1;",), ("Plain words.",), (None,), ("",)], "t string")
    assert [tuple(r) for r in texts.select(X.has_absolute_path(F.col("t")), X.is_source_shaped(F.col("t"))).collect()] == [(True, False), (True, False), (False, False), (False, True), (False, False), (False, False), (False, False)]


def test_ranks_within_groups(spark, rows):
    df = spark.createDataFrame([("a", 3), ("a", 1), ("b", 2), ("a", 2)], "g string, n int").repartition(3)
    assert rows(ranked_within(df, "g", ["n"], "k").select("g", "n", "k")) == [("a", 1, 0), ("a", 2, 1), ("a", 3, 2), ("b", 2, 0)]


def test_code_and_settings(spark, rows):
    code = spark.createDataFrame([('include "a" // "no"\n/* include "x" */ include(\'b\', "c", d)\nincludeBuild "z"\nurl = "http://x"',), (None,)], "t string")
    got = code.select(C.literal_arguments(F.col("t"), "include"), C.without_comments(F.col("t"))).collect()
    assert got[0][0] == ["a", "b", "c"] and "http://x" in got[0][1] and '"no"' not in got[0][1] and got[1][1] is None
    files = spark.createDataFrame([("a/x.properties", "k=v"), ("b.yml", "a:\n  b: 1\n  c: 2"), ("c.txt", "k=v"), ("d.yaml", None)], "path string, content string")
    held = C.config_values(files)
    assert rows(held) == [("a/x.properties", "k", "v"), ("b.yml", "a.b", "1"), ("b.yml", "a.c", "2")]
    more = held.unionByName(spark.createDataFrame([("b.yml", "a", "0"), ("b.yml", "a.b.z", "3")], held.schema))
    assert rows(C.unflattened(more)) == [("a/x.properties", '{"k":"v"}'), ("b.yml", '{"a":{"":"0","b":{"":"1","z":"3"},"c":"2"}}')]
    paths = spark.createDataFrame([("m/src/main/java/a/X.java",), ("m/src/main/java/b/Y.java",), ("m/src/test/java/Z.java",), ("src/W.kt",), ("src/r.txt",), ("X.java",)], "path string")
    assert rows(C.source_roots(paths)) == [("m/src/main/java", 2), ("src", 1)]
    blocks = C.code_blocks(spark.createDataFrame([(1, "def f(x):\n    return x"), (2, "Words.\n```\nSELECT 1\n```\n"), (3, "Only words."), (4, None)], "id bigint, text string"))
    assert [(r["id"], r["block"], r["language"]) for r in blocks.orderBy("id").collect()] == [(1, 0, "python"), (2, 0, "sql")]


@pytest.mark.parametrize("seed", range(20))
def test_reverse_postorder_of_branching_methods(seed):
    rnd = random.Random(seed)
    n = rnd.randrange(1, 9)
    after = {a: sorted({rnd.randrange(n) for _ in range(rnd.randrange(3))}) for a in range(n)}
    method = Method([(a, None, None, after[a]) for a in range(n)])

    def reach(start):
        seen, stack = {start}, [start]
        while stack:
            for b in after[stack.pop()]:
                if b not in seen:
                    seen.add(b)
                    stack.append(b)
        return seen

    order = method.postorder()
    place = {b: k for k, b in enumerate(order)}
    assert order[0] == 0 and sorted(order) == sorted(reach(0)) and len(place) == len(order)
    assert all(place[a] < place[b] or a in reach(b) for a in order for b in after[a])
