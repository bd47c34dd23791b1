"""Searches by way of a hub give what the searches pair by pair give."""

import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from graphloom.operators import graph as G
from graphloom.operators import hubs as H
from graphloom.operators import security as X
from graphloom.operators import semantics as P
from graphloom.plans import analysis_queries, graph_queries, semantic_queries


def _links(seed):
    pick = random.Random(seed)
    inner = {(pick.randrange(14), pick.randrange(14)) for _ in range(16)}
    return sorted(inner | {(k, 99) for k in range(20, 26)} | {(99, k) for k in range(30, 35)} | {(3, 99), (99, 5), (30, 20), (40, 41), (41, 40), (21, 31), (7, 7)})


@pytest.fixture(params=[1, None])
def graph(spark, request):
    links = [(1, 2), (3, 4)] if request.param is None else _links(request.param)  # the last one has no hub
    edges = spark.createDataFrame(links, "source long, target long")
    return edges, spark.createDataFrame([(x,) for x in sorted({x for link in links for x in link} | {500})], "root long")


@pytest.mark.parametrize("start", ["always", "never", "by_cycle"])
def test_reach(spark, graph, rows, start):
    edges, roots = graph
    want = rows(G.reachable(edges, roots, start))
    assert rows(H.reach(edges, roots, start)) == want
    assert rows(H.reach(edges, roots.where("root % 3 > 0"), start, max_depth=3)) == rows(G.reachable(edges, roots.where("root % 3 > 0"), start, 3))
    if start != "always":
        related = H.Related(edges, roots, start)
        assert rows(related.pairs()) == [r[:2] for r in want]
        counts = {}
        for root, *_ in want:
            counts[root] = counts.get(root, 0) + 1
        assert dict(rows(related.counts())) == counts
        assert start == "never" or [r[0] for r in rows(related.recursive())] == sorted((r[0] for r in want if r[0] == r[1]), key=lambda x: repr((x,)))


def test_stop_and_targets(spark, graph, rows):
    edges, roots = graph
    ids = roots.withColumnRenamed("root", "id")
    stop, targets = ids.where("id % 5 = 1"), ids.where("id % 4 < 2")
    want = rows(G.reachable(edges, roots, "never", 4, stop).join(targets.withColumnRenamed("id", "node"), "node", "left_semi").select("root", "node", "depth"))
    assert rows(H.reach(edges, roots, "never", 4, stop, targets)) == want


def test_paths(spark, graph, rows):
    edges, roots = graph
    want = sorted((r["root"], r["node"], r["depth"], ">".join(map(str, r["path"]))) for r in G.shortest_paths(edges, roots).collect())
    assert sorted(rows(H.shortest_paths(edges, roots))) == want


def test_writers_are_searched_from_together(spark, rows, monkeypatch):
    def no(*_):
        raise AssertionError("a search from each reader")

    monkeypatch.setattr(P, "reachable", no)
    calls = spark.createDataFrame([(1, 9), (2, 9), (9, 7), (3, 4)], "source long, target long")
    ids = lambda *n: spark.createDataFrame([(k,) for k in n], "symbol long")
    assert rows(P.read_only_writes(calls, ids(1, 2, 3, 7, 8), ids(7))) == [(1,), (2,), (7,)]


def test_cycles_leave_hubs_without_a_way_back(spark, rows):
    star = [(k, 99) for k in range(20)] + [(99, k) for k in range(30, 50)] + [(1, 2), (2, 3), (3, 1)]
    links = spark.createDataFrame(star, "source long, target long")
    assert rows(G._trimmed(links)) == [(1, 2), (2, 3), (3, 1)]
    assert rows(G.simple_cycles(links, 4)) == [([1, 2, 3], 3)]


def test_overloads_of_one_name_do_not_meet_one_by_one(spark):
    calls = spark.range(20_000).select(F.col("id").alias("call_id"), F.lit("f").alias("name"), F.array(F.lit("int")).alias("arguments"))
    methods = spark.range(20_000).select(F.col("id").alias("method_id"), F.lit("f").alias("name"), F.array(F.when(F.col("id") % 2 == 0, "int").otherwise("long")).alias("parameters"))
    got = P.overloads(calls, methods, spark.createDataFrame([("int", "long")], "narrow string, wide string"))
    assert [tuple(r) for r in got.groupBy("status", "stage", "target", "options").count().collect()] == [("ambiguous", 0, 0, 10_000, 20_000)]


def _mutual():
    """A graph whose hub has a loop and ways back to nodes before it."""
    return _links(2) + [(99, 99), (99, 20), (99, 21), (30, 31), (31, 21), (22, 20), (20, 21)]


@pytest.mark.parametrize("depth", [1, 2, 3, 4])
@pytest.mark.parametrize("links", [_links(1), _mutual(), [(1, 2), (3, 4)]], ids=["hub", "mutual", "none"])
def test_all_paths(spark, rows, links, depth):
    edges = spark.createDataFrame(links, "source long, target long")
    roots = spark.createDataFrame([(x,) for x in sorted({x for link in links for x in link} | {500}) if x != 22], "root long")
    want = sorted((">".join(map(str, r["path"])), r["cyclic"]) for r in G.paths_from(edges, roots, depth).collect())
    assert sorted(rows(H.paths_from(edges, roots, depth))) == want


def test_paths_of_all_roots_are_not_walked(spark, monkeypatch, tmp_path):
    def no(*_):
        raise AssertionError("each path walked on its own")

    monkeypatch.setattr(G, "paths_from", no)
    monkeypatch.setattr(graph_queries, "trade", lambda *_: spark.createDataFrame([(1, 9), (2, 9), (9, 7)], "source long, target long"))
    assert sorted(r["path"] for r in graph_queries.graph_paths(spark, str(tmp_path)).collect()) == ["1>9>7", "2>9>7", "9>7"]


@pytest.mark.parametrize("depth", [1, 2, 4])
@pytest.mark.parametrize("links", [_links(1), _mutual(), [(1, 2), (3, 4)]], ids=["hub", "mutual", "none"])
@pytest.mark.parametrize("hub_in", ["", "99"])
def test_simple_between(spark, rows, links, depth, hub_in):
    edges = spark.createDataFrame(links, "source long, target long")
    every = spark.createDataFrame([(x,) for x in sorted({x for link in links for x in link})], "id long")
    sources, sinks, marks = (every.where(f"id % 5 in {kept} or (id = 99 and '{hub_in}' = '99')") for kept in ("(0, 3)", "(1, 2)", "(4)"))
    paths = G.prefixes(G.paths_from(edges, every.withColumnRenamed("id", "root"), depth))
    want = sorted((">".join(map(str, r["path"])), r["verdict"] == "sanitized") for r in X.taint_between(paths, sources, sinks, marks).collect())
    assert sorted(rows(H.simple_between(edges, sources, sinks, marks, depth))) == want


def test_taint_is_not_walked_from_every_project(spark, monkeypatch):
    folder = str(Path(__file__).parents[2] / "testdata/sf0.001")

    def no(*_):
        raise AssertionError("all paths, before any end is looked at")

    monkeypatch.setattr(G, "paths_from", no)
    monkeypatch.setattr(analysis_queries, "paths_from", no, raising=False)
    assert analysis_queries.taint_paths(spark, folder).count() > 0


@pytest.mark.parametrize("name, most", [
    ("graph_related", 0.5),
    ("graph_dependencies", 0.5),
    ("graph_dependents", 0.5),
    ("transaction_flow", 0.5),
    ("impact_findings", 0.5),
    ("impact_confidence", 0.5),
    ("graph_shortest_paths", 10),
    ("graph_paths", 10),
])
def test_pairs_by_way_of_a_hub_take_little_space(spark, monkeypatch, tmp_path, name, most):
    """Bytes a row, as Spark writes them: 1,500 nodes before a hub and 1,500 behind it."""
    number = lambda k: F.pmod(F.xxhash64(k), F.lit(2**48))
    ways = spark.range(3000).select(F.when(F.col("id") < 1500, number("id")).otherwise(7).alias("source"), F.when(F.col("id") < 1500, 7).otherwise(number("id")).cast("long").alias("target"))
    links = ways.select("source", "target", F.lit("depends_on").alias("relation"), F.array(F.lit("workspace.projects:module_of")).alias("evidence"))
    every = links.select(F.explode(F.array("source", "target")).alias("id")).distinct().select("id", F.lit("x").alias("name"), (F.col("id") % 5).alias("area"))
    for plans in (graph_queries, analysis_queries, semantic_queries):
        monkeypatch.setattr(plans, "trade", lambda *_: links)
        monkeypatch.setattr(plans, "projects", lambda *_: every, raising=False)
    query = next(plans.QUERIES[name] for plans in (graph_queries, analysis_queries, semantic_queries) if name in plans.QUERIES)
    query(spark, "").write.parquet(str(tmp_path / "out"))
    rows = spark.read.parquet(str(tmp_path / "out")).count()
    assert rows >= 1500 * 1500
    assert sum(p.stat().st_size for p in (tmp_path / "out").glob("*.parquet")) < most * rows


def test_many_distances_are_not_made_for_each_node(spark, monkeypatch, rows):
    monkeypatch.setattr(H, "_LEVELS", 3)
    links = spark.createDataFrame([(k, k + 1) for k in range(8)] + [(20, 8), (21, 8), (8, 30), (8, 31), (10, 3), (9, 10)], "source long, target long")
    roots = spark.range(35).select(F.col("id").alias("root"))
    assert rows(H.reach(links, roots, "by_cycle")) == rows(G.reachable(links, roots, "by_cycle"))
