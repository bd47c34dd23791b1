"""The whole graph of small tables against brute force: more than 25 nodes, and hubs of more than three edges."""

import random
from collections import defaultdict

import pytest

import __spark_entry__ as entry

QUERIES = entry.queries()


@pytest.fixture(scope="module")
def small(spark, tmp_path_factory):
    """A folder of tables, and the set of edges that they hold."""
    folder, deal = tmp_path_factory.mktemp("tables"), random.Random(5)
    suppliers = [(s, f"S{s}", s % 3) for s in range(1, 7)]
    customers = [(c, f"C{c}", c % 4) for c in range(1, 16)]
    orders = [(o, deal.randint(1, 15)) for o in range(1, 31)]
    items = [(o, deal.randint(1, 12), deal.randint(1, 6), float(deal.randint(1, 50))) for o, _ in orders for _ in range(3)]
    tables = {
        "region": ([(0, "R0"), (1, "R1")], "r_regionkey int, r_name string"),
        "nation": ([(n, f"N{n}", n % 2) for n in range(4)], "n_nationkey int, n_name string, n_regionkey int"),
        "supplier": (suppliers, "s_suppkey long, s_name string, s_nationkey int"),
        "customer": (customers, "c_custkey long, c_name string, c_nationkey int"),
        "part": ([(p, f"P{p}") for p in range(1, 13)], "p_partkey long, p_name string"),
        "orders": (orders, "o_orderkey long, o_custkey long"),
        "lineitem": (items, "l_orderkey long, l_partkey long, l_suppkey long, l_quantity double"),
    }
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{folder}/{name}.parquet")
    buyer = dict(orders)
    links = {(f"nation:{n}", f"region:{n % 2}") for n in range(4)} | {(f"supplier:{s}", f"nation:{n}") for s, _, n in suppliers} | {(f"customer:{c}", f"nation:{n}") for c, _, n in customers}
    links |= {(f"supplier:{s}", f"part:{p}") for _, p, s, _ in items} | {(f"customer:{buyer[o]}", f"part:{p}") for o, p, _, _ in items}
    ids = {f"{kind}:{row[0]}" for kind in ("region", "nation", "supplier", "customer", "part") for row in tables[kind][0]}
    return str(folder), links, ids


def walks(links, ids):
    """All paths from all nodes, by nodes; the graph has no cycle."""
    out = defaultdict(list)
    for a, b in links:
        out[a].append(b)
    found, alive = [], [(i,) for i in ids]
    while alive:
        alive = [(*p, b) for p in alive for b in out[p[-1]]]
        found += alive
    return found


def kind(node):
    return node.split(":")[0]


def got(spark, name, folder):
    return sorted(tuple(r) for r in QUERIES[name](spark, folder).collect())


def test_reach(spark, small):
    folder, links, ids = small
    paths = walks(links, ids)
    pairs = sorted({(p[0], p[-1]) for p in paths})
    assert len(ids) > 25 and max(sum(a == i for a, _ in links) for i in ids) > 3
    assert got(spark, "whole_dependencies", folder) == got(spark, "whole_related", folder) == pairs
    assert got(spark, "whole_dependents", folder) == sorted((b, a) for a, b in pairs)
    shortest = {}
    for p in sorted(paths, key=lambda p: (len(p), p)):
        shortest.setdefault((p[0], p[-1]), p)
    assert got(spark, "whole_shortest_paths", folder) == sorted([(a, b, len(p) - 1, ">".join(p)) for (a, b), p in shortest.items()] + [(i, i, 0, i) for i in ids])
    leaves = ids - {a for a, _ in links}
    assert got(spark, "whole_paths", folder) == sorted((">".join(p), False) for p in paths if p[-1] in leaves)
    owned = {(a, b) for a, b in links if not (kind(a) == "customer" and kind(b) == "part")}
    assert got(spark, "whole_cascade_targets", folder) == sorted({(p[0], p[-1]) for p in walks(owned, ids)})


def test_components_cycles_and_waves(spark, small):
    folder, links, ids = small
    left, component = set(ids) & {x for link in links for x in link}, {}
    while left:
        group = {min(left)}
        while more := {y for a, b in links for x, y in ((a, b), (b, a)) if x in group} - group:
            group |= more
        component |= {x: min(group) for x in group}
        left -= group
    assert got(spark, "whole_components", folder) == sorted(component.items())
    assert got(spark, "whole_strong_components", folder) == sorted((x, x, 1, False) for x in component)
    assert got(spark, "whole_cycles", folder) == []
    wave = {i: max([len(p) - 1 for p in walks(links, [i])], default=0) for i in ids}
    assert got(spark, "whole_waves", folder) == sorted(wave.items())
    counts = [list(wave.values()).count(w) for w in set(wave.values())]
    assert got(spark, "whole_widest_wave", folder) == [(max(counts), len(counts))]
    ends = [(a, "out") for a, _ in links] + [(b, "in") for _, b in links]
    assert got(spark, "whole_incident", folder) == sorted((*e, ends.count(e)) for e in set(ends))


def test_impact_taint_and_flow(spark, small):
    folder, links, ids = small
    paths = walks(links, ids)
    hops = {}
    for p in sorted(paths, key=len):
        hops.setdefault((p[-1], p[0]), len(p) - 1)
    found = got(spark, "whole_impact_findings", folder)
    assert [(r[0], r[1], r[2]) for r in found] == sorted((*k, h) for k, h in hops.items())
    assert {(r[0], r[1]) for r in got(spark, "whole_impact_confidence", folder)} == set(hops)
    ends = [p for p in paths if kind(p[0]) in ("customer", "supplier") and kind(p[-1]) in ("part", "region")]
    clean = {"nation:0", "nation:2"}
    assert got(spark, "whole_taint_paths", folder) == sorted((">".join(p), "sanitized" if clean & set(p[1:-1]) else "tainted") for p in ends)
    assert got(spark, "whole_endpoint_entities", folder) == sorted({(p[0], p[-1], hops[p[-1], p[0]]) for p in ends})
    depth = {(a, b): h for (b, a), h in hops.items()} | {(i, i): 0 for i in ids}
    effect = lambda n, d: "root" if d == 0 else {0: "new", 1: "suspended"}.get(int(n.split(":")[1]) % 4, "joined")
    assert got(spark, "whole_transaction_flow", folder) == sorted((a, b, d, effect(b, d)) for (a, b), d in depth.items())
    writes = {i for i in ids if kind(i) in ("part", "nation") and int(i.split(":")[1]) % 7 == 3}
    assert got(spark, "whole_read_only_writes", folder) == sorted({(p[0],) for p in paths if p[-1] in writes and kind(p[0]) in ("customer", "supplier")})
    legacy = {i for i in ids if kind(i) == "region" or kind(i) == "part" and int(i.split(":")[1]) % 5 == 0}
    near = {n: min(h for (r, m), h in hops.items() if m == n and r in legacy) for n in ids - legacy if any(m == n and r in legacy for r, m in hops)}
    assert got(spark, "whole_legacy_impact", folder) == sorted((n, d, n[0].upper() + n.split(":")[1]) for n, d in near.items())


def test_motifs_and_review(spark, small):
    folder, links, ids = small
    provides = {(a, b) for a, b in links if kind(a) == "supplier" and kind(b) == "part"}
    bought = {(a, b) for a, b in links if kind(a) == "customer" and kind(b) == "part"}
    member = links - provides - bought
    makers = {p: {a for a, b in provides if b == p} for _, p in provides}
    nation = dict(member)
    assert got(spark, "whole_motif_decorators", folder) == sorted(provides)
    assert got(spark, "whole_motif_strategies", folder) == sorted((p, c, len(makers[p])) for c, p in bought if len(makers[p]) >= 2)
    assert got(spark, "whole_motif_adapters", folder) == sorted((s, p, nation[s]) for s, p in provides)
    assert got(spark, "whole_motif_commands", folder) == sorted((p, c, s, nation[s]) for c, p in bought if len(makers[p]) >= 2 for s in makers[p])
    made = defaultdict(int)
    for s, p in provides:
        made[nation[s], p] += 1
    assert got(spark, "whole_motif_factories", folder) == sorted((n, p, k) for (n, p), k in made.items() if k >= 2)
    assert got(spark, "whole_motif_template_methods", folder) == sorted((f"run {b}", f"hook {b}", f"hook {a}") for a, b in provides | member)
    assert got(spark, "whole_call_statistics", folder)[0][-1] == 0
    reach = {(p[-1], p[0]) for p in walks(links, ids)}
    count, into = (lambda i: sum(r == i for r, _ in reach)), (lambda i: sum(b == i for _, b in links))
    risk = lambda i: into(i) if into(i) > 55 else None
    rows = [(f"src/{i}", i, True) for i in ids if int(i.split(":")[1]) % 2 == 0] + [(f"docs/{kind(i)}", i, False) for i in ids]
    assert got(spark, "whole_change_review", folder) == sorted((path, i, exact, count(i), risk(i), False) for path, i, exact in rows)
