import pytest

from graphloom.operators import graph as G

EDGES = "source string, target string, relation string, evidence array<string>"


@pytest.fixture
def graph(spark):
    def build(*links, relation="calls", evidence=("e",)):
        return spark.createDataFrame([(a, b, relation, list(evidence)) for a, b in links], EDGES)

    return build


@pytest.fixture
def nodes(spark):
    return lambda *ids, kind="type": spark.createDataFrame([(i, kind, i) for i in ids], "id string, kind string, name string")


def roots(spark, *ids):
    return spark.createDataFrame([(i,) for i in ids], "root string")


def test_degrees_count_distinct_neighbours(spark, graph, nodes, rows):
    edges = graph(("a", "b")).unionByName(graph(("a", "b"), evidence=("other",))).unionByName(graph(("owner", "a"), relation="owns")).unionByName(graph(("a", "gone")))
    kinds = nodes("a", "b").unionByName(nodes("owner", kind="project"))
    got = G.degree_summaries(kinds, edges, ["type"], ["type"])
    assert rows(got) == [("a", "*", 1, 0), ("a", "calls", 1, 0), ("b", "*", 0, 1), ("b", "calls", 0, 1)]
    every = {(r[0], r[1]): tuple(r[2:]) for r in rows(G.degree_summaries(kinds, edges))}
    assert every["a", "*"] == (1, 1) and every["a", "owns"] == (0, 1) and ("owner", "calls") not in every
    assert rows(G.degree_summaries(kinds, edges.limit(0))) == [("a", "*", 0, 0), ("b", "*", 0, 0), ("owner", "*", 0, 0)]
    assert rows(G.degree_summaries(kinds, edges.limit(0), include_zero=False)) == []


def test_bounded_adjacency_and_loops(graph, rows):
    edges = graph(("hub", "c"), ("hub", "a"), ("hub", "b"), ("hub", "hub"), ("a", "a"))
    assert rows(G.bounded_adjacency(edges, 2)) == [("a", "a", "calls", 1, 1), ("hub", "a", "calls", 1, 4), ("hub", "b", "calls", 2, 4)]
    assert [r for r in rows(G.incident_edges(edges)) if r[0] == "a"] == [("a", "in", "a", "calls"), ("a", "in", "hub", "calls"), ("a", "out", "a", "calls")]


@pytest.mark.parametrize(("start", "want"), [("always", {"a", "b", "c"}), ("never", {"b", "c"}), ("by_cycle", {"a", "b", "c"})])
def test_reach_on_a_cycle(spark, graph, start, want):
    edges = graph(("a", "b"), ("b", "c"), ("c", "a"), ("b", "c"), (None, "x"), ("c", None))
    got = {r["node"]: r["depth"] for r in G.reachable(edges, roots(spark, "a"), start).collect()}
    assert set(got) == want and got["c"] == 2 and got.get("a") in (None, 0, 3)


def test_reach_limits(spark, graph):
    chain = graph(*((f"n{k:02}", f"n{k + 1:02}") for k in range(20)), ("n03", "side"))
    assert G.reachable(chain, roots(spark, "n00"), max_depth=3).count() == 4
    assert {r["node"]: r["depth"] for r in G.reachable(chain, roots(spark, "n00")).collect()}["n20"] == 20
    stop = spark.createDataFrame([("n03",)], "id string")
    assert G.reachable(chain, roots(spark, "n00"), stop=stop).count() == 4
    assert {r["node"] for r in G.reachable(chain, roots(spark, "zzz")).collect()} == {"zzz"}
    assert G.reachable(chain, roots(spark).limit(0)).collect() == []
    assert G.reachable(chain, roots(spark, "n00", "n10")).count() == 22 + 11


def test_neighbourhood_drops_unknown_nodes(spark, graph, nodes, rows):
    assert rows(G.neighbourhood(nodes("a", "b"), graph(("b", "a"), ("a", "ghost"), ("ghost", "c")), roots(spark, "a"), 2)) == [("a", "a", 0), ("a", "b", 1)]


def test_shortest_path_takes_the_least(spark, graph):
    edges = graph(("a", "c"), ("a", "b"), ("b", "d"), ("c", "d"), ("d", "a"), ("a", "a"))
    got = {r["node"]: r["path"] for r in G.shortest_paths(edges, roots(spark, "a")).collect()}
    assert got == {"a": ["a"], "b": ["a", "b"], "c": ["a", "c"], "d": ["a", "b", "d"]}


def test_paths_cut_cycles(spark, graph):
    got = {(tuple(r["path"]), r["cyclic"]) for r in G.paths_from(graph(("a", "b"), ("b", "a"), ("b", "c")), roots(spark, "a"), 8).collect()}
    assert got == {(("a", "b", "a"), True), (("a", "b", "c"), False)}
    assert G.paths_from(graph(("a", "b"), ("a", "c"), ("a", "d")), roots(spark, "a"), 8, limit=2).count() == 2


def brute_components(links):
    ids = {x for e in links for x in e}
    reach = {i: {i} for i in ids}
    for _ in ids:
        for a, b in links:
            for r in reach.values():
                if a in r:
                    r.add(b)
    return {i: min(j for j in ids if j in reach[i] and i in reach[j]) for i in ids}


@pytest.mark.parametrize("seed", range(3))
def test_strong_components_against_brute_force(graph, seed):
    import random

    rnd = random.Random(seed)
    links = [(f"n{rnd.randrange(14):02}", f"n{rnd.randrange(14):02}") for _ in range(20)]
    got = G.strong_components(graph(*links)).collect()
    assert {r["node"]: r["component"] for r in got} == brute_components(links)
    for r in got:
        assert r["recursive"] == (r["size"] > 1 or (r["node"], r["node"]) in links)


def test_components_and_empty(graph, rows):
    assert rows(G.components(graph(("b", "a"), ("c", "b"), ("x", "y"), ("z", "z")))) == [("a", "a"), ("b", "a"), ("c", "a"), ("x", "x"), ("y", "x"), ("z", "z")]
    assert rows(G.components(graph(("a", "b")).limit(0))) == [] and rows(G.strong_components(graph(("a", "b")).limit(0))) == []


def test_cycles(graph):
    edges = graph(("a", "b"), ("b", "a"), ("b", "c"), ("c", "a"), ("a", "a")).unionByName(graph(("c", "d"), ("d", "c"), evidence=()))
    found = G.simple_cycles(edges, 4)
    assert {tuple(r["path"]) for r in found.collect()} == {("a", "b"), ("a", "b", "c"), ("c", "d")}
    assert {tuple(r["path"]) for r in G.cycles_supported(found, edges).collect()} == {("a", "b"), ("a", "b", "c")}


def test_waves(graph, nodes, rows):
    edges = graph(("app", "lib"), ("lib", "core"), ("app", "core"), ("x", "y"), ("y", "x"), ("top", "x"))
    assert rows(G.waves(edges, nodes("alone"))) == [("alone", 0), ("app", 2), ("core", 0), ("lib", 1), ("top", None), ("x", None), ("y", None)]


def test_orphans_invalidation_digest(spark, graph, nodes, rows):
    edges = graph(("a", "b"), ("b", "ghost"))
    assert rows(G.orphan_edges(nodes("a", "b"), edges)) == [("b", "ghost", "calls")]
    assert rows(G.invalidated(edges, spark.createDataFrame([("b",)], "id string"))) == [("a",), ("b",)]
    one, two = nodes("a", "b", "c"), nodes("c", "b", "a").repartition(3)
    assert G.table_digest(one).first() == G.table_digest(two).first() != G.table_digest(nodes("a", "b", "d")).first()
    assert G.table_digest(one.limit(0)).first()["rows"] == 0
