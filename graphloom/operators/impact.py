"""Change impact along dependency edges, reachability states, and what may break."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.operators.evidence import tier
from graphloom.operators.graph import reversed_edges
from graphloom.operators.hubs import reach
from graphloom.session import checkpoint

#: Strength of each relation; reliability, specificity and coverage of its evidence.
STRENGTH = {"calls": 0.98, "overrides": 0.96, "inherits": 0.90, "imports": 0.86, "depends_on": 0.78, "member_of": 0.56, "owns": 0.56}
POLICY = {
    "calls": (0.90, 0.90, 0.70),
    "imports": (0.90, 0.90, 0.80),
    "inherits": (0.90, 0.95, 0.85),
    "overrides": (0.95, 0.95, 0.85),
    "depends_on": (0.82, 0.88, 0.75),
    "member_of": (0.90, 0.95, 0.80),
    "owns": (0.90, 0.95, 0.80),
}
#: Relations that each kind of change follows.
FOLLOWED = {
    "implementation": ("depends_on", "imports", "calls"),
    "dependency": ("depends_on", "imports"),
    "inheritance": ("depends_on", "imports", "inherits", "overrides"),
    "configuration": ("depends_on",),
}
ALL_FOLLOWED = ("depends_on", "imports", "inherits", "overrides", "calls")
#: How evidence begins that a relation's own producers give; an entry that ends with ``=`` is meant whole.
PRODUCERS = {
    "calls": ("call_graph.v1:calls=",),
    "imports": ("imports=", "global_symbol.metadata:imports:"),
    "inherits": ("extends=", "implements=", "global_symbol.metadata:inherits:", "global_symbol.metadata:bases:"),
    "overrides": ("global_symbol.metadata:overrides:",),
    "depends_on": ("workspace.projects:", "declared_dependency:", "repository_summary.frameworks=", "calls=", "uses=", "imports=", "extends=", "implements="),
    "member_of": ("global_symbol.owner_id=",),
    "owns": ("workspace.root=", "workspace.projects=", "repository_summary.projects=", "repository_summary.module_hierarchy=", "semantic_graph.project_id=", "global_symbol.owner_id="),
}
_CALLABLE = ("method", "type", "symbol")
_IMPORTING = ("project", "module", "package", "type", "method", "symbol")
_IMPORTED = ("project", "module", "package", "type", "dependency", "symbol")
_ABSTRACT = ("concept", "domain", "capability", "repository", "workspace")


def _valued(relation: Column, values: dict[str, float]) -> Column:
    found = F.lit(0.5)
    for name, value in values.items():
        found = F.when(relation == name, float(value)).otherwise(found)
    return found


def authoritative(relation: Column, evidence: Column) -> Column:
    """Whether some piece of evidence is of the relation's own producers; pieces with blanks, addresses or over 512 characters are none."""
    found = F.lit(False)
    for name, starts in PRODUCERS.items():
        found = F.when(relation == name, F.exists(evidence, _produced_by(starts))).otherwise(found)
    return F.coalesce(found, F.lit(False))


def _produced_by(starts: tuple[str, ...]):
    def fits(piece: Column) -> Column:
        begins = reduce(lambda a, b: a | b, ((piece == x[:-1]) if x.endswith("=") else piece.startswith(x) for x in starts))
        return begins & ~piece.rlike(r"\s|://") & (F.length(piece) <= 512)

    return fits


def legal_edges(nodes: DataFrame, edges: DataFrame, change_kind: str) -> DataFrame:
    """``(source, target, relation)`` along which a change of this kind may spread: with evidence of the relation's own producers, between kinds that fit the relation."""
    kinds = nodes.groupBy("id").agg(F.max("kind").alias("kind"))
    held = edges.where(F.col("relation").isin(*FOLLOWED.get(change_kind, ALL_FOLLOWED)) & authoritative(F.col("relation"), F.col("evidence"))).select("source", "target", "relation").distinct()
    held = held.join(kinds.select(F.col("id").alias("source"), F.col("kind").alias("a")), "source").join(kinds.select(F.col("id").alias("target"), F.col("kind").alias("b")), "target")
    relation, a, b = F.col("relation"), F.col("a"), F.col("b")
    fits = (
        F.when(relation == "inherits", (a == "type") & (b == "type")).when(relation == "overrides", (a == "method") & (b == "method")).when(relation == "calls", a.isin(*_CALLABLE) & b.isin(*_CALLABLE))
        .when(relation == "imports", a.isin(*_IMPORTING) & b.isin(*_IMPORTED)).otherwise(~a.isin(*_ABSTRACT) & ~b.isin(*_ABSTRACT))
    )
    return held.where(fits).select("source", "target", "relation")


def propagate(legal: DataFrame, roots: DataFrame, depth: int = 4) -> DataFrame:
    """``(root, node, hops, weakest, path)``: all that depends on a root within ``depth`` steps, by its best evidence path.

    Level by level against the edges' direction; of the paths of one length the one with the strongest weakest relation,
    then the least by its steps, is kept. The root itself is no result. Each level is one join and is checkpointed.
    """
    links = checkpoint(legal.where(F.col("source").isNotNull() & F.col("target").isNotNull()))
    start = roots.select("root", F.col("root").alias("node"), F.lit(0).alias("hops"), F.lit(1.0).alias("weakest"), F.array().cast("array<struct<n:double,relation:string,source:string,target:string>>").alias("path"))
    frontier = checkpoint(start.distinct())
    seen, level = frontier, 0
    while level < depth and not frontier.isEmpty():
        level += 1
        step = frontier.join(links, F.col("node") == F.col("target"))
        value = _valued(F.col("relation"), STRENGTH)
        hop = F.struct((-value).alias("n"), "relation", F.col("source").cast("string").alias("source"), F.col("target").cast("string").alias("target"))
        step = step.select("root", F.col("source").alias("node"), F.struct((-F.least("weakest", value)).alias("w"), F.concat("path", F.array(hop)).alias("path")).alias("key"))
        best = step.groupBy("root", "node").agg(F.min("key").alias("key"))
        found = best.select("root", "node", F.lit(level).alias("hops"), (-F.col("key.w")).alias("weakest"), F.col("key.path").alias("path"))
        frontier = checkpoint(found.join(seen.select("root", "node"), ["root", "node"], "left_anti"))
        seen = seen.unionByName(frontier)
    return seen.where("hops > 0")


def _one_relation(legal: DataFrame) -> str | None:
    """The relation that all links have, if they have but one."""
    found = legal.select("relation").distinct().limit(2).collect()
    return found[0]["relation"] if len(found) == 1 else None


def spread(legal: DataFrame, roots: DataFrame, depth: int = 4, told: Callable[[Column, Column, Column], dict[str, Column]] | None = None) -> DataFrame:
    """``(root, node, hops, weakest)`` of ``propagate``, or, with ``told``, the columns that it makes of node, hops and weakest instead of the last two.
    Links of one relation are all as strong, so the distance tells the rest, and what it tells is made once for a node and distance."""
    told = told or (lambda node, hops, weakest: {"hops": hops, "weakest": weakest})
    relation = _one_relation(legal)
    if relation is None:
        own = told(F.col("node"), F.col("hops"), F.col("weakest"))
        return propagate(legal, roots, depth).select("root", "node", *(c.alias(name) for name, c in own.items()))
    own = told(F.col("node"), F.col("depth"), _valued(F.lit(relation), STRENGTH))
    return reach(reversed_edges(legal), roots, "never", depth, told=own).select("root", "node", *own)


def spread_confidence(legal: DataFrame, roots: DataFrame, depth: int = 4) -> DataFrame:
    """``(root, node, hops, weakest, confidence, tier)``: ``path_confidence`` of ``propagate``; with one relation it is one of ``depth`` values."""
    relation = _one_relation(legal)
    if relation is None:
        return path_confidence(propagate(legal, roots, depth)).drop("path")
    steps = F.array_repeat(F.struct(F.lit(relation).alias("relation")), F.col("hops"))
    values = path_confidence(legal.sparkSession.range(1, depth + 1, 1, 1).select(F.col("id").cast("int").alias("hops")).withColumn("path", steps)).collect()

    def of(hops: Column, name: str, kind: str) -> Column:
        return F.element_at(F.array(*(F.lit(r[name]) for r in sorted(values))).cast(f"array<{kind}>"), hops)

    return spread(legal, roots, depth, lambda node, hops, weakest: {"hops": hops, "weakest": weakest, "confidence": of(hops, "confidence", "double"), "tier": of(hops, "tier", "string")})


def impact_score(weakest: Column, hops: Column, exposure: Column) -> Column:
    """.60 relation strength, .25 proximity and .15 exposure; an unknown exposure is left out and the rest renormalised."""
    base = weakest * 0.60 + 0.25 / (1 + 0.2 * (hops - 1))
    return F.round(F.when(exposure.isNull(), base / 0.85).otherwise(base + exposure * 0.15), 6)


def exposure(visibility: Column) -> Column:
    """1 for public or protected, 0 for private, package or internal, else unknown."""
    lower = F.lower(visibility)
    return F.when(lower.isin("public", "protected"), 1.0).when(lower.isin("private", "package", "internal"), 0.0)


def path_confidence(found: DataFrame) -> DataFrame:
    """``found`` with ``confidence`` and ``tier``: mean support of the steps, times the least coverage, a depth factor and the
    weakest support's share of the mean."""

    def of(k: int):
        return lambda h: _valued(h["relation"], {name: policy[k] for name, policy in POLICY.items()})

    support = F.transform("path", lambda h: of(0)(h) * of(1)(h))
    mean = F.aggregate(support, F.lit(0.0), lambda a, x: a + x) / F.size("path")
    coverage = F.array_min(F.transform("path", of(2))) / (1 + 0.1 * (F.col("hops") - 1)) * (F.array_min(support) / mean)
    score = F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), mean * coverage)), 4)
    return found.withColumn("confidence", score).withColumn("tier", tier(score, F.lit(False)))


def breaking_state(kind: Column, visibility: Column, change_kind: Column, declared: Column) -> Column:
    """unsupported, potentially_breaking, not_applicable or not_evaluated."""
    lower = F.lower(F.coalesce(visibility, F.lit("unknown")))
    surface = lower.isin("public", "protected") | F.coalesce(declared, F.lit(False))
    risky = change_kind.isin("signature", "visibility", "removal", "rename", "move", "inheritance")
    return (
        F.when(~kind.isin("type", "method", "field", "package", "project", "module"), "unsupported").when(surface & risky, "potentially_breaking")
        .when(lower.isin("private", "package", "internal"), "not_applicable").otherwise("not_evaluated")
    )


#: Protections by precedence.
PROTECTIONS = ("unreachable", "service_loader_discovered", "reflection_discovered", "framework_managed", "generated_or_annotation_managed", "externally_reachable", "conditionally_reachable")


def select_protections(protections: DataFrame) -> DataFrame:
    """``(id, protection)``: of several protections of a subject the one of highest precedence."""
    rank = F.lit(len(PROTECTIONS))
    for k, name in enumerate(PROTECTIONS):
        rank = F.when(F.col("protection") == name, k).otherwise(rank)
    return protections.groupBy("id").agg(F.min(F.struct(rank.alias("rank"), "protection")).alias("p")).select("id", "p.protection")


def reachability_states(nodes: DataFrame, protections: DataFrame, production: DataFrame, tests: DataFrame) -> DataFrame:
    """``(id, state)`` of ``nodes(id, kind, visibility, classification, calls, reflection, closed)``.

    Protection first, then production and test reach, partial reflection, missing calls, fields, public visibility,
    generated or foreign sources, and only in a closed world with complete calls ``likely_dead``; all else ``unused``.
    """
    joined = nodes.join(select_protections(protections), "id", "left").join(production.select("id").distinct().withColumn("main", F.lit(True)), "id", "left").join(tests.select("id").distinct().withColumn("test", F.lit(True)), "id", "left")
    state = (
        F.when(F.col("protection").isNotNull(), F.col("protection")).when(F.col("main"), "reachable").when(F.col("test"), "reachable_test_only")
        .when(F.col("reflection") == "partial", "unknown").when(F.col("calls").isin("unavailable", "insufficient"), "unknown").when(F.col("kind") == "field", "unknown")
        .when(F.col("visibility").isin("public", "protected"), "unused").when(F.col("classification").isin("generated", "external", "vendored"), "unknown")
        .when((F.col("calls") == "complete") & F.col("closed"), "likely_dead").otherwise("unused")
    )
    return joined.select("id", state.alias("state"))
