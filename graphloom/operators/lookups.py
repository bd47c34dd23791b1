"""Resolution joins: staged candidates, ancestors of paths, hierarchies, calls, policies and rules."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.operators.graph import reachable


def resolve_staged(requests: DataFrame, candidates: DataFrame, key: str) -> DataFrame:
    """``(key, status, stage, target, options)`` of each request by ``candidates(key, stage, target)``.

    Only the first stage that has candidates counts: one distinct target is resolved, several are ambiguous (the least
    is named), none at all unresolved. This serves type names, beans, subjects and calls alike.
    """
    first = candidates.groupBy(key).agg(F.min("stage").alias("stage"))
    held = candidates.join(first, [key, "stage"]).groupBy(key, "stage").agg(F.count_distinct("target").alias("options"), F.min("target").alias("target"))
    joined = requests.select(key).distinct().join(held, key, "left")
    status = F.when(F.col("options").isNull(), "unresolved").when(F.col("options") == 1, "resolved").otherwise("ambiguous")
    return joined.select(key, status.alias("status"), "stage", "target", F.coalesce("options", F.lit(0)).alias("options"))


def ancestors(path: Column) -> Column:
    """All folders above a path, the deepest last, and ``.`` as the root of all."""
    parts = F.split(path, "/")
    inner = F.when(F.size(parts) > 1, F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, 1, n), "/"))).otherwise(F.array().cast("array<string>"))
    return F.concat(F.array(F.lit(".")), inner)


def owning_projects(paths: DataFrame, projects: DataFrame) -> DataFrame:
    """``(path, project, options)``: the project at the deepest folder above a path, if exactly one is there.

    ``projects(root, project)``. Ancestors are exploded and joined on equality, so there is no prefix scan.
    """
    every = paths.select("path", F.posexplode(ancestors(F.col("path"))).alias("depth", "root")).join(projects.select("root", "project").distinct(), "root")
    deepest = every.groupBy("path", "depth").agg(F.count("*").alias("options"), F.min("project").alias("project"))
    best = deepest.groupBy("path").agg(F.max(F.struct("depth", "options", "project")).alias("b"))
    return paths.select("path").distinct().join(best, "path", "left").select("path", F.when(F.col("b.options") == 1, F.col("b.project")).alias("project"), F.coalesce("b.options", F.lit(0)).alias("options"))


def nearest_definitions(calls: DataFrame, hierarchy: DataFrame, definitions: DataFrame) -> DataFrame:
    """``(type, method, owner, distance)``: the nearest supertype, or the type itself, that defines a called method.

    ``calls(type, method)``, ``hierarchy(source extends target)``, ``definitions(type, method)``; of equally near ones the
    least name.
    """
    up = reachable(hierarchy, calls.select(F.col("type").alias("root")).distinct())
    held = calls.select("type", "method").distinct().join(up.select(F.col("root").alias("type"), F.col("node").alias("owner"), "depth"), "type")
    own = held.join(definitions.select(F.col("type").alias("owner"), "method").distinct(), ["owner", "method"])
    return own.groupBy("type", "method").agg(F.min(F.struct(F.col("depth").alias("distance"), "owner")).alias("n")).select("type", "method", "n.owner", "n.distance")


def argument_flow(calls: DataFrame, parameters: DataFrame) -> DataFrame:
    """``(call_id, actual, formal)``: arguments meet parameters by position; surplus ones on either side meet nothing."""
    actual = calls.select("call_id", "callee", F.posexplode("arguments").alias("position", "actual"))
    formal = parameters.select(F.col("method").alias("callee"), F.posexplode("parameters").alias("position", "formal"))
    return actual.join(formal, ["callee", "position"]).select("call_id", "actual", "formal")


def matches(mode: str, pattern: Column, text: Column) -> Column:
    """Whether ``text`` matches by exact, prefix, suffix or contains."""
    return {"exact": text == pattern, "prefix": text.startswith(pattern), "suffix": text.endswith(pattern), "contains": text.contains(pattern)}[mode]


def first_matching_rule(rows: DataFrame, rules: Sequence[tuple[str, str, str]], text: str) -> DataFrame:
    """``rows`` with ``rule``: the first of the rules ``(name, mode, pattern)`` that the text matches. Rules are parameters, so this is one expression."""
    found = F.lit(None).cast("string")
    for name, mode, pattern in reversed(list(rules)):
        found = F.when(matches(mode, F.lit(pattern), F.col(text)), name).otherwise(found)
    return rows.withColumn("rule", found)


def glob_pattern(glob: str) -> str:
    """A regular expression for a glob with ``**``, ``*`` and ``?`` over slash-separated paths."""
    import re

    parts = re.split(r"(\*\*/?|\*|\?)", glob)
    known = {"**/": "(?:.*/)?", "**": ".*", "*": "[^/]*", "?": "[^/]"}
    return "^" + "".join(known.get(p, re.escape(p)) for p in parts) + "$"


def globbed(paths: DataFrame, include: Sequence[str], exclude: Sequence[str] = ()) -> DataFrame:
    """Rows whose ``path`` matches some include glob and no exclude glob; no include glob means all."""
    kept = F.lit(not include)
    for one in include:
        kept = kept | F.col("path").rlike(glob_pattern(one))
    for one in exclude:
        kept = kept & ~F.col("path").rlike(glob_pattern(one))
    return paths.where(kept)


def forbidden_links(edges: DataFrame, layers: DataFrame, allowed: Sequence[tuple[str, str]]) -> DataFrame:
    """``(source, target, source_layer, target_layer)`` of edges between layers that may not depend on each other.

    Edges within a layer or with an endpoint without layer are no violations. ``allowed`` is a parameter.
    """
    known = layers.select("id", "layer").distinct()
    joined = edges.select("source", "target").distinct().join(known.select(F.col("id").alias("source"), F.col("layer").alias("source_layer")), "source").join(known.select(F.col("id").alias("target"), F.col("layer").alias("target_layer")), "target")
    fine = F.col("source_layer") == F.col("target_layer")
    for one, two in allowed:
        fine = fine | ((F.col("source_layer") == one) & (F.col("target_layer") == two))
    return joined.where(~fine)


def latest_by(rows: DataFrame, keys: Sequence[str], order: Column, columns: Sequence[str]) -> DataFrame:
    """Of each key the row of the greatest ``order``, then of the greatest values; aggregated before the shuffle."""
    return rows.groupBy(*keys).agg(F.max(F.struct(order.alias("_o"), *columns)).alias("_r")).select(*keys, *(F.col(f"_r.{c}").alias(c) for c in columns))


def layered_settings(settings: DataFrame) -> DataFrame:
    """``(key, value, layer)`` of ``settings(layer, rank, key, value)``: the value of the highest layer that sets a key, and where it is from."""
    return settings.groupBy("key").agg(F.max(F.struct("rank", "value", "layer")).alias("s")).select("key", "s.value", "s.layer")


def overlapping_edits(edits: DataFrame) -> DataFrame:
    """Edits ``(path, start, stop)`` that begin before one that sorts earlier has ended; only the others can be applied."""
    order = Window.partitionBy("path").orderBy("start", "stop").rowsBetween(Window.unboundedPreceding, -1)
    return edits.withColumn("before", F.max("stop").over(order)).where(F.col("start") < F.col("before")).drop("before")
