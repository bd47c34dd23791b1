"""Program facts as tables: symbols, calls, frameworks, transactions, constraints and assignments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.operators.graph import nearest, reachable, reversed_edges
from graphloom.operators.hubs import reach
from graphloom.operators.lookups import resolve_staged


def symbol_problems(symbols: DataFrame) -> DataFrame:
    """``(id, problem)``: duplicate ids, and owners that are no symbol. Symbols ``(id, owner_id)``."""
    twice = symbols.groupBy("id").agg(F.count("*").alias("n")).where("n > 1").select("id", F.lit("duplicate").alias("problem"))
    lost = symbols.where(F.col("owner_id").isNotNull()).select("id", "owner_id").join(symbols.select(F.col("id").alias("owner_id")).distinct(), "owner_id", "left_anti").select("id", F.lit("orphan").alias("problem"))
    return twice.unionByName(lost.distinct())


def without_source(symbols: DataFrame, sources: DataFrame) -> DataFrame:
    """The symbols that stay when some sources are removed; symbols without a source stay."""
    return symbols.join(sources.select("source").distinct(), "source", "left_anti")


def resolve_types(uses: DataFrame, types: DataFrame, imports: DataFrame) -> DataFrame:
    """``(use_id, status, stage, target, options)`` of ``uses(use_id, file, package, name)``.

    Stage 1 is the own package, an import or the language's package, stage 2 any type of that simple name. Only uses that
    stage 1 leaves open go on, and they meet one row per simple name, so a name of many types fans out nowhere.
    ``types(fqn, package, name)``, ``imports(file, fqn)``.
    """
    own = uses.select("use_id", "file", F.col("package").alias("here"), "name")
    known = types.select("fqn", F.col("package").alias("there"), "name").distinct()
    spoken = imports.select("file", "fqn").distinct().join(known.select("fqn", "name"), "fqn")
    imported = own.join(spoken, ["file", "name"]).select("use_id", F.col("fqn").alias("target"))
    beside = own.join(known.withColumnRenamed("there", "here"), ["here", "name"]).select("use_id", F.col("fqn").alias("target"))
    given = own.join(known.where("there = 'java.lang'"), "name").select("use_id", F.col("fqn").alias("target"))
    near = imported.unionByName(beside).unionByName(given).select("use_id", F.lit(1).alias("stage"), "target")
    rest = own.join(near.select("use_id").distinct(), "use_id", "left_anti")
    simple = known.groupBy("name").agg(F.count_distinct("fqn").alias("options"), F.min("fqn").alias("target"))
    far = rest.join(simple, "name").select("use_id", F.lit(2).alias("stage"), "target", "options")
    first = near.groupBy("use_id").agg(F.lit(1).alias("stage"), F.min("target").alias("target"), F.count_distinct("target").alias("options")).unionByName(far)
    status = F.when(F.col("options").isNull(), "unresolved").when(F.col("options") == 1, "resolved").otherwise("ambiguous")
    return uses.select("use_id").distinct().join(first, "use_id", "left").select("use_id", status.alias("status"), "stage", "target", F.coalesce("options", F.lit(0)).alias("options"))


def link_calls(calls: DataFrame, methods: DataFrame, library: DataFrame) -> DataFrame:
    """``(call_id, target, link)`` of ``calls(call_id, receiver, name, arity)``.

    All methods of the receiver's type, name and arity, else all of that name and arity: several fan out to one row
    each. Calls without any are unresolved, unless their name is in ``library(name)``.
    """
    exact = calls.join(methods.select(F.col("owner").alias("receiver"), "name", "arity", F.col("method_id").alias("target")).distinct(), ["receiver", "name", "arity"]).select("call_id", "target", F.lit("exact").alias("link"))
    rest = calls.join(exact.select("call_id").distinct(), "call_id", "left_anti")
    loose = rest.join(methods.select("name", "arity", F.col("method_id").alias("target")).distinct(), ["name", "arity"]).select("call_id", "target", F.lit("by_name").alias("link"))
    lost = rest.join(loose.select("call_id").distinct(), "call_id", "left_anti").join(library.select("name").distinct(), "name", "left_anti")
    return exact.unionByName(loose).unionByName(lost.select("call_id", F.lit(None).cast(exact.schema["target"].dataType).alias("target"), F.lit("unresolved").alias("link")))


def overloads(calls: DataFrame, methods: DataFrame, widens: DataFrame) -> DataFrame:
    """``(call_id, status, stage, target, options)``: of the methods of a name whose parameters take the arguments, those that
    need the fewest widenings. Calls of one name and arguments have one answer, and methods of one name and parameters count
    together, so no call ever meets each method. ``calls(call_id, name, arguments)``, ``methods(method_id, name, parameters)``,
    ``widens(narrow, wide)`` closed under steps, without a type to itself."""
    shapes = calls.select("name", "arguments").distinct().withColumn("arity", F.size("arguments"))
    kinds = methods.select("method_id", "name", "parameters").distinct().groupBy("name", "parameters").agg(F.count("*").alias("options"), F.min("method_id").alias("target")).withColumn("arity", F.size("parameters"))
    pairs = shapes.join(kinds, ["name", "arity"])
    key = ("name", "arguments", "parameters", "options", "target")
    empty = pairs.where(F.size("arguments") == 0).select(*key, F.lit(0).alias("stage"))
    each = pairs.select(*key, F.size("arguments").alias("n"), F.explode(F.arrays_zip("arguments", "parameters")).alias("p")).select(*key, "n", F.col("p.arguments").alias("narrow"), F.col("p.parameters").alias("wide"))
    fits = each.join(widens.select("narrow", "wide", F.lit(1).alias("w")).distinct(), ["narrow", "wide"], "left").where((F.col("narrow") == F.col("wide")) | F.col("w").isNotNull())
    whole = fits.groupBy(*key, "n").agg(F.count("*").alias("held"), F.count_if(F.col("narrow") != F.col("wide")).cast("int").alias("stage")).where("held = n").select(*key, "stage")
    first = whole.unionByName(empty).groupBy("name", "arguments", "stage").agg(F.sum("options").alias("options"), F.min("target").alias("target"))
    first = first.groupBy("name", "arguments").agg(F.min(F.struct("stage", "options", "target")).alias("f")).select("name", "arguments", "f.*")
    status = F.when(F.col("options").isNull(), "unresolved").when(F.col("options") == 1, "resolved").otherwise("ambiguous")
    return calls.select("call_id", "name", "arguments").distinct().join(first, ["name", "arguments"], "left").select("call_id", status.alias("status"), "stage", "target", F.coalesce("options", F.lit(0)).alias("options"))


def transaction_flow(calls: DataFrame, boundaries: DataFrame, roots: DataFrame) -> DataFrame:
    """``(root, symbol, depth, effect)``: what a transaction reaches, and where it is suspended or begins anew.

    ``calls(source, target)``, ``boundaries(symbol, propagation)``; a root is part of its own flow.
    """
    own = F.col("propagation")
    effect = F.when(F.col("depth") == 0, "root").when(own.isin("not_supported", "never"), "suspended").when(own.isin("requires_new", "nested"), "new").otherwise("joined")
    found = reach(calls, roots, notes=boundaries.select(F.col("symbol").alias("id"), "propagation").distinct(), told={"effect": effect})
    return found.select("root", F.col("node").alias("symbol"), "depth", "effect")


def read_only_writes(calls: DataFrame, read_only: DataFrame, writes: DataFrame) -> DataFrame:
    """``(symbol)`` of read-only boundaries that write, or reach something that does: one search back from all writers together."""
    behind = nearest(reversed_edges(calls), writes.select(F.col("symbol").alias("id")))
    return read_only.select("symbol").distinct().join(behind.select(F.col("node").alias("symbol")), "symbol", "left_semi")


def endpoint_entities(edges: DataFrame, endpoints: DataFrame, entities: DataFrame, max_depth: int = 8) -> DataFrame:
    """``(endpoint, entity, depth)``: entities within reach of an endpoint; the search stops at entities and skips ``exposes``."""
    links = edges.where("relation <> 'exposes'")
    found = reach(links, endpoints.select(F.col("id").alias("root")), "never", max_depth, entities, entities)
    return found.select(F.col("root").alias("endpoint"), F.col("node").alias("entity"), "depth")


def legacy_impact(edges: DataFrame, roots: DataFrame, sources: DataFrame, max_depth: int | None = None) -> DataFrame:
    """``(node, distance, file)``: what depends on any of the roots, the distance to the nearest, and the file it is in, if known."""
    near = nearest(reversed_edges(edges), roots.select(F.col("root").alias("id")), max_depth).where("depth > 0").withColumnRenamed("depth", "distance")
    return near.join(sources.select(F.col("id").alias("node"), F.col("source").alias("file")).distinct(), "node", "left")


def feasible_states(constraints: DataFrame) -> DataFrame:
    """``(state, feasible)`` of ``constraints(state, variable, op, value)``, a conjunction per state over numbers.

    Bounds are met by their extremes, so no order of constraints matters; a state is infeasible if any variable's bounds
    cross, two values are demanded, or a demanded value is out of bounds or excluded.
    """
    op, value = F.col("op"), F.col("value")
    by = constraints.groupBy("state", "variable").agg(
        F.max(F.when(op.isin(">", ">="), F.struct(value.alias("v"), (op == ">").alias("open")))).alias("low"),
        F.min(F.when(op.isin("<", "<="), F.struct(value.alias("v"), (op == "<=").alias("closed")))).alias("high"),
        F.min(F.when(op == "==", value)).alias("least"),
        F.max(F.when(op == "==", value)).alias("most"),
        F.collect_set(F.when(op == "!=", value)).alias("not"),
    )
    low, high, least = F.col("low"), F.col("high"), F.col("least")
    crossed = (low["v"] > high["v"]) | ((low["v"] == high["v"]) & (low["open"] | ~high["closed"]))
    outside = (least < low["v"]) | ((least == low["v"]) & low["open"]) | (least > high["v"]) | ((least == high["v"]) & ~high["closed"])
    single = (low["v"] == high["v"]) & F.array_contains("not", low["v"])
    broken = F.coalesce(crossed, F.lit(False)) | (least != F.col("most")) | F.coalesce(outside, F.lit(False)) | F.coalesce(F.array_contains("not", least), F.lit(False)) | F.coalesce(single, F.lit(False))
    return by.groupBy("state").agg((~F.max(F.coalesce(broken, F.lit(False)))).alias("feasible"))


def missing_cases(switches: DataFrame, cases: DataFrame, leaves: DataFrame) -> DataFrame:
    """``(switch_id, leaf)``: permitted leaves of a switch's type that no case names and no default covers.

    ``switches(switch_id, type, has_default)``, ``cases(switch_id, leaf)``, ``leaves(type, leaf)``.
    """
    open_ = switches.where(~F.coalesce("has_default", F.lit(False))).join(leaves.distinct(), "type")
    return open_.join(cases.select("switch_id", "leaf").distinct(), ["switch_id", "leaf"], "left_anti").select("switch_id", "leaf")


def permitted_leaves(extends: DataFrame, roots: DataFrame) -> DataFrame:
    """``(type, leaf)``: subtypes of a type that have no subtypes themselves, or the type itself if it has none. ``extends(source, target)``."""
    down = extends.select(F.col("target").alias("source"), F.col("source").alias("target"))
    reach = reachable(down, roots)
    inner = down.select(F.col("source").alias("node")).distinct()
    return reach.join(inner, "node", "left_anti").select(F.col("root").alias("type"), F.col("node").alias("leaf"))


def definitely_assigned(branches: DataFrame, assigned: DataFrame) -> DataFrame:
    """``(join_id, variable)``: variables assigned on every branch that reaches a join. ``branches(join_id, branch)``, ``assigned(branch, variable)``."""
    all_ = branches.distinct().groupBy("join_id").agg(F.count("*").alias("n"))
    held = branches.distinct().join(assigned.distinct(), "branch").groupBy("join_id", "variable").agg(F.count("*").alias("k"))
    return held.join(all_, "join_id").where("k = n").select("join_id", "variable")


def call_statistics(resolutions: DataFrame, components: DataFrame) -> DataFrame:
    """One row: calls by status, and how many components are recursive."""
    counts = resolutions.agg(*(F.count_if(F.col("status") == s).alias(s) for s in ("resolved", "ambiguous", "unresolved")))
    loops = components.where("recursive").agg(F.count_distinct("component").alias("recursive_components"))
    return counts.join(F.broadcast(loops))


#: Annotations that make a bean, map a route, inject, or mark an entity and its relations.
BEAN_ANNOTATIONS = {"Component": "component", "Service": "service", "Repository": "repository", "Controller": "controller", "RestController": "controller", "Configuration": "configuration"}
MAPPING_METHODS = {"GetMapping": "GET", "PostMapping": "POST", "PutMapping": "PUT", "PatchMapping": "PATCH", "DeleteMapping": "DELETE", "RequestMapping": "ANY"}
INJECTIONS = ("Autowired", "Inject", "Resource")
ENTITY_RELATIONS = ("OneToOne", "OneToMany", "ManyToOne", "ManyToMany")


def annotation_facts(sources: DataFrame) -> DataFrame:
    """``(id, annotation, argument, fact)`` of the annotations in Java ``sources(id, code)`` that frameworks know.

    ``fact`` is a bean's kind, a route's method, injection, entity or relation; ``argument`` the first text in the brackets.
    """
    code = F.regexp_replace(F.regexp_replace(F.coalesce("code", F.lit("")), r"(?s)/\*.*?\*/", " "), r"//[^\n]*", " ")
    found = F.regexp_extract_all(code, F.lit(r"@([A-Za-z_.]+(?:\s*\([^()]*\))?)"), 1)
    rows = sources.select("id", F.explode(found).alias("x"))
    name = F.regexp_extract("x", r"([A-Za-z_]+)(?:\s*\(|$)", 1)
    fact: Column = F.lit(None).cast("string")
    for table in (BEAN_ANNOTATIONS, MAPPING_METHODS, dict.fromkeys(INJECTIONS, "injection"), dict.fromkeys(ENTITY_RELATIONS, "relation"), {"Entity": "entity", "Transactional": "transaction"}):
        for annotation, meaning in table.items():
            fact = F.when(name == annotation, meaning).otherwise(fact)
    argument = F.regexp_extract("x", r"\"([^\"]*)\"", 1)
    return rows.select("id", name.alias("annotation"), F.when(argument != "", argument).alias("argument"), fact.alias("fact")).where("fact is not null")


def layer(facets: Column) -> Column:
    """controller, service, repository, entity, endpoint or other; the first that an element's facets name."""
    found = F.lit("other")
    for name in ("endpoint", "entity", "repository", "service", "controller"):
        found = F.when(F.exists(facets, _names(name)), name).otherwise(found)
    return found


def _names(name: str):
    return lambda x: F.lower(x).contains(name)
