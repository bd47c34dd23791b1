"""Property-graph operators over ``nodes(id, kind, ...)`` and ``edges(source, target, relation, evidence)``.

Edges are a set over all four columns, so the same link with different evidence is two edges: degrees count distinct
neighbours. Nodes without a row may be endpoints; they are dropped only where an operator says so. Null ids never link.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.session import checkpoint


def degree_summaries(nodes: DataFrame, edges: DataFrame, subject_kinds: Sequence[str] = (), neighbour_kinds: Sequence[str] = (), include_zero: bool = True) -> DataFrame:
    """``(id, relation, out_degree, in_degree)`` of distinct neighbours; the total over all relations has relation ``*``.

    Both endpoints need a node row. A neighbour by two relations counts once in the total. With ``include_zero`` every
    subject has a total, even 0.
    """
    subjects = nodes.where(F.col("kind").isin(*subject_kinds)) if subject_kinds else nodes
    others = nodes.where(F.col("kind").isin(*neighbour_kinds)) if neighbour_kinds else nodes
    subjects, others = subjects.select("id").distinct(), others.select(F.col("id").alias("other")).distinct()
    links = edges.select("source", "target", "relation").distinct()
    out, into = (links.select(F.col(a).alias("id"), F.col(b).alias("other"), "relation") for a, b in (("source", "target"), ("target", "source")))

    def counted_side(side: DataFrame, name: str) -> DataFrame:
        held = side.join(others, "other", "left_semi")
        by_relation = held.groupBy("id", "relation").agg(F.count("*").alias(name))
        total = held.groupBy("id").agg(F.count_distinct("other").alias(name)).withColumn("relation", F.lit("*"))
        return by_relation.unionByName(total)

    sides = counted_side(out, "out_degree").withColumn("in_degree", F.lit(0).cast("bigint")).unionByName(counted_side(into, "in_degree").withColumn("out_degree", F.lit(0).cast("bigint")))
    counted = sides.groupBy("id", "relation").agg(F.sum("out_degree").alias("out_degree"), F.sum("in_degree").alias("in_degree")).join(subjects, "id", "left_semi")
    if include_zero:
        missing = subjects.join(counted.select("id").distinct(), "id", "left_anti")
        counted = counted.unionByName(missing.select("id", F.lit("*").alias("relation"), F.lit(0).cast("bigint").alias("out_degree"), F.lit(0).cast("bigint").alias("in_degree")))
    return counted


def bounded_adjacency(edges: DataFrame, k: int, by: str = "source") -> DataFrame:
    """The first ``k`` edges of each node in the order of (source, target, relation), with the node's exact ``total``.

    Spark keeps each task's first ``k`` before the shuffle, and the totals are aggregated apart, so a hub is never
    gathered in one task.
    """
    links = edges.select("source", "target", "relation").distinct()
    order = Window.partitionBy(by).orderBy("source", "target", "relation")
    first = links.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)
    return first.join(links.groupBy(by).agg(F.count("*").alias("total")), by).select("source", "target", "relation", "place", "total")


def incident_edges(edges: DataFrame) -> DataFrame:
    """``(id, direction, other, relation)``: a self-loop counts in both directions."""
    links = edges.select("source", "target", "relation").distinct()
    return links.select(F.col("source").alias("id"), F.lit("out").alias("direction"), F.col("target").alias("other"), "relation").unionByName(
        links.select(F.col("target").alias("id"), F.lit("in").alias("direction"), F.col("source").alias("other"), "relation")
    )


#: After so many levels what has been seen is written together, so that plans stay short on long chains.
_COMPACT = 8


def _grown(seen: DataFrame, frontier: DataFrame, level: int) -> DataFrame:
    """``seen`` with the new level, as one table every few levels."""
    both = seen.unionByName(frontier)
    return checkpoint(both) if level % _COMPACT == 0 else both


def reachable(edges: DataFrame, roots: DataFrame, include_start: str = "always", max_depth: int | None = None, stop: DataFrame | None = None) -> DataFrame:
    """``(root, node, depth)`` by shortest distance along ``edges(source, target)`` from ``roots(root)``.

    ``include_start``: ``always`` (depth 0), ``never`` (even on a cycle), or ``by_cycle`` (only if a cycle leads back,
    at the cycle's length). Nodes in ``stop(id)`` are reached but not left. One join per level against the frontier
    only; each level is checkpointed, so lineage and lost executors do not matter. Duplicates and self-loops are no harm.
    """
    links = checkpoint(edges.select("source", "target").where(F.col("source").isNotNull() & F.col("target").isNotNull()).distinct())
    start = roots.select(F.col("root"), F.col("root").alias("node"), F.lit(0).alias("depth")).where(F.col("root").isNotNull()).distinct()
    frontier = checkpoint(start)
    seen = frontier if include_start != "by_cycle" else frontier.limit(0)
    depth = 0
    while (max_depth is None or depth < max_depth) and not frontier.isEmpty():
        depth += 1
        leaving = frontier if stop is None else frontier.join(stop.select(F.col("id").alias("node")), "node", "left_anti")
        step = leaving.join(links, F.col("node") == F.col("source")).select("root", F.col("target").alias("node"), F.lit(depth).alias("depth")).distinct()
        frontier = checkpoint(step.join(seen.select("root", "node"), ["root", "node"], "left_anti"))
        seen = _grown(seen, frontier, depth)
    if include_start == "never":
        seen = seen.where(F.col("node") != F.col("root"))
    return seen


def neighbourhood(nodes: DataFrame, edges: DataFrame, roots: DataFrame, depth: int) -> DataFrame:
    """``(root, node, depth)``: undirected, with the start, without ids that have no node row."""
    either = edges.select("source", "target").unionByName(edges.select(F.col("target").alias("source"), F.col("source").alias("target")))
    return reachable(either, roots, "always", depth).join(nodes.select(F.col("id").alias("node")).distinct(), "node", "left_semi").select("root", "node", "depth")


def shortest_paths(edges: DataFrame, roots: DataFrame, max_depth: int = 64) -> DataFrame:
    """``(root, node, depth, path)``: for each pair the path of fewest steps, the least of them in the order of its nodes."""
    links = checkpoint(edges.select("source", "target").where(F.col("source").isNotNull() & F.col("target").isNotNull()).distinct())
    frontier = checkpoint(roots.select("root", F.col("root").alias("node"), F.lit(0).alias("depth"), F.array("root").alias("path")).distinct())
    seen, depth = frontier, 0
    while depth < max_depth and not frontier.isEmpty():
        depth += 1
        step = frontier.join(links, F.col("node") == F.col("source")).groupBy("root", F.col("target").alias("next")).agg(F.min("path").alias("path"))
        step = step.select("root", F.col("next").alias("node"), F.lit(depth).alias("depth"), F.concat("path", F.array("next")).alias("path"))
        frontier = checkpoint(step.join(seen.select("root", "node"), ["root", "node"], "left_anti"))
        seen = _grown(seen, frontier, depth)
    return seen


def paths_from(edges: DataFrame, roots: DataFrame, max_depth: int = 8, limit: int | None = None) -> DataFrame:
    """``(path, cyclic)``: all paths of 1 to ``max_depth`` steps that cannot go on, or that close a cycle and are cut there.

    Exponential in ``max_depth`` by nature; ``limit`` keeps the first paths in their order, which is the feature.
    """
    links = edges.select("source", "target").where(F.col("source").isNotNull() & F.col("target").isNotNull()).distinct()
    alive = roots.select(F.array("root").alias("path")).distinct()
    done = []
    for depth in range(1, max_depth + 1):
        step = alive.join(links, F.element_at("path", -1) == F.col("source"), "left")
        if depth > 1:
            done.append(step.where(F.col("target").isNull()).select("path", F.lit(False).alias("cyclic")))
        step = step.where(F.col("target").isNotNull()).select("path", "target", F.array_contains("path", F.col("target")).alias("cyclic"))
        longer = step.select(F.concat("path", F.array("target")).alias("path"), "cyclic")
        done.append(longer.where("cyclic" if depth < max_depth else "true"))
        alive = checkpoint(longer.where(~F.col("cyclic")).select("path"))
    result = reduce(DataFrame.unionByName, done)
    return result.orderBy("path").limit(limit) if limit else result


def prefixes(paths: DataFrame) -> DataFrame:
    """``(path)``: all simple paths of one step and more that ``paths(path, cyclic)`` begin with; the step that closes a cycle is left out."""
    simple = F.size("path") - F.col("cyclic").cast("int")
    return paths.where(simple >= 2).select(F.explode(F.transform(F.sequence(F.lit(2), simple), lambda n: F.slice("path", 1, n))).alias("path")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """``(node, component)`` of weakly connected components, named by their least node, by label passing with shortcuts."""
    links = edges.select(F.col("source").alias("a"), F.col("target").alias("b")).where("a is not null and b is not null")
    links = checkpoint(links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = checkpoint(links.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("component")))
    while True:
        near = links.join(labels, F.col("b") == F.col("node")).groupBy(F.col("a").alias("node")).agg(F.min("component").alias("near"))
        hop = labels.select(F.col("node").alias("component"), F.col("component").alias("far"))
        new = labels.join(near, "node").join(hop, "component", "left").select("node", F.least("component", "near", F.coalesce("far", "component")).alias("new"), "component")
        new = checkpoint(new)
        changed = not new.where(F.col("new") != F.col("component")).isEmpty()
        labels = new.select("node", F.col("new").alias("component"))
        if not changed:
            return labels


def _fixpoint_min(links: DataFrame, labels: DataFrame) -> DataFrame:
    """Least label that reaches each node along ``links(source, target)``; ``labels(node, colour)``."""
    while True:
        passed = links.join(labels, F.col("source") == F.col("node")).groupBy(F.col("target").alias("node")).agg(F.min("colour").alias("near"))
        new = checkpoint(labels.join(passed, "node", "left").select("node", "colour", F.least("colour", F.coalesce("near", "colour")).alias("new")))
        changed = not new.where(F.col("new") != F.col("colour")).isEmpty()
        labels = new.select("node", F.col("new").alias("colour"))
        if not changed:
            return labels


#: How often nodes without a way in or out are taken away before the colouring.
_TRIMS = 6


def strong_components(edges: DataFrame) -> DataFrame:
    """``(node, component, size, recursive)``: strongly connected components, named by their least node.

    Nodes without links into or out of what is left are components of their own and are taken away first, a few times over.
    Then colouring: the least label is passed forward to a fixpoint; the nodes of a colour that reach its root backward
    within the colour are one component, and the rest goes on. ``recursive`` is a size above one or a self-loop.
    """
    every = checkpoint(edges.select("source", "target").where(F.col("source").isNotNull() & F.col("target").isNotNull()).distinct())
    left = checkpoint(every.select(F.col("source").alias("node")).unionByName(every.select(F.col("target").alias("node"))).distinct())
    links, found = every.where("source <> target"), None
    for _ in range(_TRIMS):
        inner = left.join(links.select(F.col("source").alias("node")).distinct(), "node", "left_semi").join(links.select(F.col("target").alias("node")).distinct(), "node", "left_semi")
        kept = checkpoint(inner)
        single = checkpoint(left.join(kept, "node", "left_anti").select("node", F.col("node").alias("component")))
        if single.isEmpty():
            break
        found = single if found is None else found.unionByName(single)
        left = kept
        links = checkpoint(links.join(left.select(F.col("node").alias("source")), "source", "left_semi").join(left.select(F.col("node").alias("target")), "target", "left_semi"))
    while not left.isEmpty():
        colours = _fixpoint_min(links, left.select("node", F.col("node").alias("colour")))
        inside = links.join(colours.select(F.col("node").alias("source"), F.col("colour").alias("c1")), "source").join(colours.select(F.col("node").alias("target"), F.col("colour").alias("c2")), "target").where("c1 = c2")
        inside = checkpoint(inside.select(F.col("target").alias("source"), F.col("source").alias("target")))
        roots = colours.where("node = colour").select(F.col("node").alias("root"))
        own = reachable(inside, roots, "always").select("node", F.col("root").alias("component"))
        own = checkpoint(own)
        found = own if found is None else found.unionByName(own)
        left = checkpoint(left.join(own, "node", "left_anti"))
        links = checkpoint(links.join(left.select(F.col("node").alias("source")), "source", "left_semi").join(left.select(F.col("node").alias("target")), "target", "left_semi"))
    if found is None:
        found = left.select("node", F.col("node").alias("component"))
    loops = every.where("source = target").select(F.col("source").alias("node")).distinct().withColumn("loop", F.lit(True))
    sizes = found.groupBy("component").agg(F.count("*").alias("size"))
    return found.join(sizes, "component").join(loops, "node", "left").select("node", "component", "size", ((F.col("size") > 1) | F.col("loop").isNotNull()).alias("recursive"))


def _trimmed(links: DataFrame) -> DataFrame:
    """The links between nodes that have a link in and one out, again and again while a twentieth of them goes."""
    held = links.count()
    while True:
        inner = links.join(links.select(F.col("target").alias("source")).distinct(), "source", "left_semi").join(links.select(F.col("source").alias("target")).distinct(), "target", "left_semi")
        links = checkpoint(inner.select("source", "target"))
        before, held = held, links.count()
        if held > 0.95 * before or not held:
            return links


def simple_cycles(edges: DataFrame, max_length: int) -> DataFrame:
    """``(path, length)``: simple cycles of 2 to ``max_length`` nodes, each once, beginning with its least node.

    A node without a way in or out is on no cycle, so links of such are taken away first, for as long as that takes many.
    """
    links = _trimmed(checkpoint(edges.select("source", "target").where("source <> target").distinct()))
    paths = links.where("source < target").select(F.array("source", "target").alias("path"))
    found = []
    for length in range(2, max_length + 1):
        step = paths.join(links, F.element_at("path", -1) == F.col("source")).select("path", "target")
        found.append(step.where(F.col("target") == F.element_at("path", 1)).select("path", F.lit(length).alias("length")))
        if length < max_length:
            longer = step.where((F.col("target") > F.element_at("path", 1)) & ~F.array_contains("path", F.col("target")))
            paths = checkpoint(longer.select(F.concat("path", F.array("target")).alias("path")))
    return reduce(DataFrame.unionByName, found)


def cycles_supported(cycles: DataFrame, edges: DataFrame) -> DataFrame:
    """The cycles whose every step, the last one back to the first too, is an edge with evidence."""
    usable = edges.where(F.size("evidence") > 0).select("source", "target").distinct()
    steps = cycles.select("path", F.posexplode("path").alias("k", "source")).withColumn("target", F.element_at("path", F.when(F.col("k") + 2 > F.size("path"), 1).otherwise(F.col("k") + 2)))
    broken = steps.join(usable, ["source", "target"], "left_anti").select("path").distinct()
    return cycles.join(broken, "path", "left_anti")


def waves(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """``(node, wave)`` of ``edges(source depends on target)``: 0 for nodes without dependencies, else one more than the
    greatest of theirs. Nodes on or behind a cycle have a null wave."""
    links = checkpoint(edges.select("source", "target").where(F.col("source").isNotNull() & F.col("target").isNotNull()).distinct())
    ids = links.select(F.col("source").alias("node")).unionByName(links.select(F.col("target").alias("node")))
    if nodes is not None:
        ids = ids.unionByName(nodes.select(F.col("id").alias("node")))
    left, found, wave = checkpoint(ids.distinct()), None, 0
    while True:
        ready = checkpoint(left.join(links.select(F.col("source").alias("node")).distinct(), "node", "left_anti").select("node", F.lit(wave).alias("wave")))
        if ready.isEmpty():
            stuck = left.select("node", F.lit(None).cast("int").alias("wave"))
            return stuck if found is None else found.unionByName(stuck)
        found = ready if found is None else _grown(found, ready, wave)
        left = checkpoint(left.join(ready, "node", "left_anti"))
        links = checkpoint(links.join(ready.select(F.col("node").alias("target")), "target", "left_anti").select("source", "target"))
        wave += 1


def orphan_edges(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges of which an endpoint has no node row."""
    ids = nodes.select("id").distinct()
    return edges.join(ids.select(F.col("id").alias("source"), F.lit(1).alias("s")), "source", "left").join(ids.select(F.col("id").alias("target"), F.lit(1).alias("t")), "target", "left").where("s is null or t is null").select("source", "target", "relation")


def nearest(edges: DataFrame, starts: DataFrame, max_depth: int | None = None) -> DataFrame:
    """``(node, depth)``: what can be reached from any of ``starts(id)``, and the fewest steps to it; the starts have depth 0.

    One search from all starts together, so a node is held once, however many starts reach it.
    """
    links = checkpoint(edges.select("source", "target").where(F.col("source").isNotNull() & F.col("target").isNotNull()).distinct())
    frontier = checkpoint(starts.select(F.col("id").alias("node"), F.lit(0).alias("depth")).where(F.col("node").isNotNull()).distinct())
    seen, depth = frontier, 0
    while (max_depth is None or depth < max_depth) and not frontier.isEmpty():
        depth += 1
        step = frontier.join(links, F.col("node") == F.col("source")).select(F.col("target").alias("node"), F.lit(depth).alias("depth")).distinct()
        frontier = checkpoint(step.join(seen.select("node"), "node", "left_anti"))
        seen = _grown(seen, frontier, depth)
    return seen


def reversed_edges(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("target").alias("source"), F.col("source").alias("target"))


def invalidated(edges: DataFrame, changed: DataFrame) -> DataFrame:
    """``(node)``: the changed nodes and all that depend on them, directly or not."""
    return nearest(reversed_edges(edges), changed).select("node")


def row_digest(df: DataFrame, columns: Sequence[str] | None = None) -> Column:
    """SHA-256 of the row as canonical JSON: sorted member names, nulls left out, no spacing."""
    return F.sha2(F.to_json(F.struct(*sorted(columns or df.columns))), 256)


def table_digest(df: DataFrame) -> DataFrame:
    """``(rows, digest)``: a digest of the rows as a multiset that does not depend on their order or partitioning."""
    own = F.conv(F.substring(row_digest(df), 1, 15), 16, 10).cast("decimal(38,0)")
    return df.agg(F.count("*").alias("rows"), F.coalesce(F.sum(own), F.lit(0).cast("decimal(38,0)")).cast("string").alias("digest"))
