"""Searches that keep their way: predecessors and paths, ownership, plans, seams, value flow between methods, and reuse of results."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.operators.graph import nearest, reversed_edges
from graphloom.operators.search import bounded
from graphloom.session import checkpoint


def traverse(edges: DataFrame, roots: DataFrame, max_depth: int | None = None) -> DataFrame:
    """``(node, depth, root, predecessor, path)`` of one search from all ``roots(id, category)`` together.

    Of the roots that reach a node in the fewest steps the first by (id, category) owns it, then the least predecessor. Paths
    run from the root to the node. One join and checkpoint per level, against the frontier only.
    """
    links = checkpoint(edges.select("source", "target").where("source is not null and target is not null").distinct())
    first = roots.where("id is not null").groupBy(F.col("id").alias("node")).agg(F.min("category").alias("category"))
    none = F.lit(None).cast(links.schema["source"].dataType)
    frontier = checkpoint(first.select("node", F.lit(0).alias("depth"), F.struct(F.col("node").alias("id"), "category").alias("root"), none.alias("predecessor"), F.array("node").alias("path")))
    seen, depth = frontier, 0
    while (max_depth is None or depth < max_depth) and not frontier.isEmpty():
        depth += 1
        step = frontier.join(links, F.col("node") == F.col("source")).join(seen.select(F.col("node").alias("target")), "target", "left_anti")
        best = step.groupBy("target").agg(F.min(F.struct("root", F.col("source").alias("predecessor"), "path")).alias("best"))
        frontier = checkpoint(best.select(F.col("target").alias("node"), F.lit(depth).alias("depth"), "best.root", "best.predecessor", F.concat("best.path", F.array("target")).alias("path")))
        seen = checkpoint(seen.unionByName(frontier)) if depth % 8 == 0 else seen.unionByName(frontier)
    return seen.select("node", "depth", F.col("root.id").alias("root"), "predecessor", "path")


def reach_relations(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """``(source, target)`` that reachability follows: calls and overrides of known ends, and members to the type they belong to."""
    kinds = nodes.select("id", "kind").distinct()
    calls = edges.where(F.col("relation").isin("calls", "overrides")).select("source", "target")
    types = kinds.where("kind = 'type'").select(F.col("id").alias("target"))
    members = edges.where("relation = 'member_of'").select("source", "target").join(types, "target", "left_semi").select("source", "target")
    known = calls.unionByName(members).distinct()
    for end in ("source", "target"):
        known = known.join(kinds.select(F.col("id").alias(end)), end, "left_semi")
    return known.select("source", "target")


def owners(members: DataFrame, nodes: DataFrame, subjects: DataFrame, kinds: Sequence[str]) -> DataFrame:
    """``(id, kind, owner, distance)``: of each of ``subjects(id)`` and each kind the nearest owner above it, the least id at one distance.

    ``members(source, target)`` lead to owners. Only kinds of ``kinds`` come out; a subject is not its own owner.
    """
    links = checkpoint(members.select("source", "target").where("source is not null and target is not null").distinct())
    wanted = nodes.where(F.col("kind").isin(*kinds)).select(F.col("id").alias("node"), "kind").distinct()
    frontier = checkpoint(subjects.select("id", F.col("id").alias("node"), F.lit(0).alias("distance")).where("id is not null").distinct())
    seen, depth = frontier, 0
    while not frontier.isEmpty():
        depth += 1
        step = frontier.join(links, F.col("node") == F.col("source")).select("id", F.col("target").alias("node"), F.lit(depth).alias("distance")).distinct()
        frontier = checkpoint(step.join(seen.select("id", "node"), ["id", "node"], "left_anti"))
        seen = seen.unionByName(frontier)
    held = seen.where("distance > 0").join(wanted, "node")
    return held.groupBy("id", "kind").agg(F.min(F.struct("distance", "node")).alias("best")).select("id", "kind", F.col("best.node").alias("owner"), F.col("best.distance").alias("distance"))


def top_plans(plans: DataFrame, keys: Sequence[str], order: Sequence[Column], best: Sequence[str], limit: int) -> DataFrame:
    """The first ``limit`` of the distinct plans, with ``omitted``: of plans with equal ``keys`` the one whose ``best`` is least stays."""
    rest = [c for c in plans.columns if c not in (*keys, *best)]
    single = plans.groupBy(*keys).agg(F.min(F.struct(*best, *rest)).alias("p")).select(*keys, "p.*")
    return bounded(single, order, limit)


def cycle_seams(cycles: DataFrame, limit: int = 256) -> DataFrame:
    """``(source, target, cycles, omitted)``: steps of ``cycles(path)`` at which they may be cut, those in most cycles first."""
    steps = cycles.select("path", F.posexplode("path").alias("k", "source")).withColumn("target", F.element_at("path", F.when(F.col("k") + 2 > F.size("path"), 1).otherwise(F.col("k") + 2)))
    counted = steps.groupBy("source", "target").agg(F.count("*").alias("cycles"))
    return bounded(counted, [F.col("cycles").desc(), F.col("source"), F.col("target")], limit)


def value_flow(assignments: DataFrame, arguments: DataFrame, returns: DataFrame) -> DataFrame:
    """``(source, target)`` between values ``method#name``: assignments within a method, arguments to parameters, and returned values to results.

    ``assignments(method, source, target)``, ``arguments(caller, argument, callee, parameter)``, ``returns(caller, result, callee, value)``.
    """
    value = lambda method, name: F.concat_ws("#", method, name)
    inner = assignments.select(value("method", "source").alias("source"), value("method", "target").alias("target"))
    into = arguments.select(value("caller", "argument").alias("source"), value("callee", "parameter").alias("target"))
    back = returns.select(value("callee", "value").alias("source"), value("caller", "result").alias("target"))
    return inner.unionByName(into).unionByName(back).distinct()


def tainted_sinks(flow: DataFrame, sources: DataFrame, sinks: DataFrame, sanitizers: DataFrame) -> DataFrame:
    """``(sink, depth)``: sinks that a source's value reaches through any methods without passing a sanitiser, in the fewest steps.

    ``sources(id)``, ``sinks(id)``, ``sanitizers(id)``. The fixpoint over all methods is one search from all sources together;
    a value that is sanitised is never left, and a sanitised source is none.
    """
    clean = sanitizers.select("id").distinct()
    open_ = flow.join(clean.withColumnRenamed("id", "source"), "source", "left_anti").join(clean.withColumnRenamed("id", "target"), "target", "left_anti")
    reached = nearest(open_, sources.join(clean, "id", "left_anti").select("id"))
    return reached.join(sinks.select(F.col("id").alias("node")).distinct(), "node", "left_semi").select(F.col("node").alias("sink"), "depth")


def framework_rules(frameworks: DataFrame, rules: DataFrame) -> DataFrame:
    """``(project, role, suffix)``: the sources, sinks and sanitisers that a project's frameworks add to those of all (framework ``*``)."""
    known = frameworks.select("project", "framework").where("project is not null and framework is not null").distinct()
    every = known.select("project").distinct().withColumn("framework", F.lit("*"))
    return known.unionByName(every).join(rules, "framework").select("project", "role", "suffix").distinct()


def suffix_hits(calls: DataFrame, rules: DataFrame) -> DataFrame:
    """``(call_id, rule_id)``: rules whose suffix ends a call's dotted name at a dot. ``calls(call_id, name)``, ``rules(rule_id, suffix)``.

    A name has few suffixes, so they meet the rules in one equality join rather than each with each.
    """
    parts = F.split("name", r"\.")
    tails = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, k, F.size(parts)), "."))
    ends = calls.where("name is not null and name <> ''").select("call_id", F.explode(tails).alias("suffix"))
    return ends.join(rules.select("rule_id", "suffix").distinct(), "suffix").select("call_id", "rule_id").distinct()


def reuse_plan(before: DataFrame, after: DataFrame, edges: DataFrame) -> DataFrame:
    """``(project, action, distance)``: ``reuse`` a project's results, ``run`` it for its own change, or ``rerun`` it for one that it depends on.

    ``before(project, fingerprint)``, ``after(project, fingerprint)``, ``edges(source depends on target)``. New projects run,
    gone ones are ``dropped``; the distance is that to the nearest change.
    """
    joined = before.select("project", F.col("fingerprint").alias("old")).join(after.select("project", F.col("fingerprint").alias("new")), "project", "full_outer")
    changed = joined.where(~F.col("old").eqNullSafe(F.col("new"))).select(F.col("project").alias("id"))
    near = nearest(reversed_edges(edges), changed).withColumnRenamed("node", "project")
    action = F.when(F.col("new").isNull() & F.col("old").isNotNull(), "dropped").when(F.col("depth") == 0, "run").when(F.col("depth") > 0, "rerun").otherwise("reuse")
    return joined.join(near, "project", "left").select("project", action.alias("action"), F.col("depth").alias("distance"))


def resume_plan(log: DataFrame, edges: DataFrame, attempts: int) -> DataFrame:
    """``(task, attempts, action)`` after a stop: ``skip`` what succeeded, ``retry`` what failed less than ``attempts`` times, ``give_up``
    on the rest, and ``wait`` for tasks that are not given up but need one that is, directly or not.

    ``log(task, seq, succeeded)``: any success counts. ``edges(source needs target)``.
    """
    state = log.where("task is not null").groupBy("task").agg(F.count_if(~F.col("succeeded")).alias("attempts"), F.max("succeeded").alias("done"))
    lost = state.where(~F.col("done") & (F.col("attempts") >= attempts)).select(F.col("task").alias("id"))
    behind = nearest(reversed_edges(edges), lost).where("depth > 0").select(F.col("node").alias("task"), F.lit(True).alias("blocked"))
    joined = state.join(behind, "task", "left")
    action = F.when(F.col("done"), "skip").when(F.col("attempts") >= attempts, "give_up").when(F.col("blocked"), "wait").otherwise("retry")
    return joined.select("task", "attempts", action.alias("action"))
