"""The knowledge graph from program facts, the search index on it, symbol lookups, and candidates by posting."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.operators.search import terms


def _id(kind: str, column: str) -> Column:
    return F.concat(F.lit(f"{kind}:"), F.col(column))


def graph_nodes(projects: DataFrame, symbols: DataFrame, dependencies: DataFrame) -> DataFrame:
    """``(id, kind, name, project)``: one node for each project, symbol and declared dependency.

    ``projects(name)``, ``symbols(id, kind, name, project)``, ``dependencies(project, name)``. A symbol of several rows is one
    node: of its kinds, names and projects the least. Null names are left out.
    """
    named = projects.where("name is not null").select(_id("project", "name").alias("id"), F.lit("project").alias("kind"), "name", F.col("name").alias("project"))
    own = symbols.where("id is not null").groupBy("id").agg(*(F.min(c).alias(c) for c in ("kind", "name", "project")))
    declared = dependencies.where("name is not null").select(_id("dependency", "name").alias("id"), F.lit("dependency").alias("kind"), "name", F.lit(None).cast("string").alias("project"))
    return named.distinct().unionByName(own).unionByName(declared.distinct())


def graph_edges(symbols: DataFrame, dependencies: DataFrame, links: DataFrame) -> DataFrame:
    """``(source, target, relation, evidence)``: projects own their symbols, depend on what they declare, and symbols or projects
    are linked by ``links(source, target, relation, evidence)``.

    The evidence of equal links is one sorted set. Links with a null end are left out; both directions of ownership come out.
    """
    owned = symbols.where("id is not null and project is not null").select("id", _id("project", "project").alias("p"))
    parts = [
        owned.select(F.col("p").alias("source"), F.col("id").alias("target"), F.lit("owns").alias("relation"), F.lit("semantic_graph.project_id").alias("evidence")),
        owned.select(F.col("id").alias("source"), F.col("p").alias("target"), F.lit("member_of").alias("relation"), F.lit("global_symbol.owner_id").alias("evidence")),
        dependencies.where("name is not null and project is not null").select(_id("project", "project").alias("source"), _id("dependency", "name").alias("target"), F.lit("depends_on").alias("relation"), F.concat(F.lit("declared_dependency:"), "name").alias("evidence")),
        links.where("source is not null and target is not null").select("source", "target", "relation", "evidence"),
    ]
    return reduce(DataFrame.unionByName, parts).groupBy("source", "target", "relation").agg(F.array_sort(F.collect_set("evidence")).alias("evidence"))


def first_symbols(wanted: DataFrame, symbols: DataFrame) -> DataFrame:
    """``(term, stage, id, options)``: for each of ``wanted(term)`` the symbol of that id, else of that qualified name, else of that
    simple name; of several the least id, with their number. Terms without any have nulls and 0.

    ``symbols(id, qualified_name, name)``; letters' case does not matter. Each stage takes only the terms that those before left.
    """
    left = wanted.select(F.lower("term").alias("key"), "term").where("term is not null").distinct()
    found = None
    for stage, column in enumerate(("id", "qualified_name", "name"), 1):
        index = symbols.where(F.col(column).isNotNull()).groupBy(F.lower(column).alias("key")).agg(F.min("id").alias("id"), F.count_distinct("id").alias("options"))
        hit = left.join(index, "key").select("key", "term", F.lit(stage).alias("stage"), "id", "options")
        found = hit if found is None else found.unionByName(hit)
        left = left.join(index, "key", "left_anti")
    lost = left.select("key", "term", F.lit(None).cast("int").alias("stage"), F.lit(None).cast("string").alias("id"), F.lit(0).cast("bigint").alias("options"))
    return found.unionByName(lost).select("term", "stage", "id", "options")


def index_postings(nodes: DataFrame) -> DataFrame:
    """``(term, id)`` of the distinct words in the names, kinds and projects of ``nodes(id, kind, name, project)``; capitals begin words."""
    text = F.regexp_replace(F.concat_ws(" ", "name", "kind", "project"), r"([a-z0-9])([A-Z])", "$1 $2")
    return nodes.select("id", F.explode(terms(F.regexp_replace(text, "[_]", " "))).alias("term")).distinct()


def index_concepts(postings: DataFrame, concepts: Mapping[str, Sequence[str]], least: float = 0.6, step: float = 0.1) -> DataFrame:
    """``(concept, id, confidence)``: entries that hold all words of one of a concept's phrases; ``step`` more for each further phrase, 1 at most."""
    rows = [(name, phrase, len(set(phrase.split())), word) for name, phrases in concepts.items() for phrase in phrases for word in set(phrase.split())]
    words = postings.sparkSession.createDataFrame(rows, "concept string, phrase string, size int, term string")
    held = postings.join(words, "term").groupBy("concept", "phrase", "size", "id").agg(F.count_distinct("term").alias("n")).where("n = size")
    return held.groupBy("concept", "id").agg(F.round(F.least(F.lit(1.0), least + step * (F.count("*") - 1)), 4).alias("confidence"))


def candidates(nodes: DataFrame, postings: DataFrame, held: DataFrame, words: Sequence[str] = (), concepts: Sequence[str] = (), kinds: Sequence[str] = (), projects: Sequence[str] = (), every_concept: bool = True) -> DataFrame:
    """``(id, matched)``: entries with some of the words (all entries without words), with all or any of the concepts, of the
    kinds and within the projects. A scope filters before anything is counted."""
    scope = nodes.where(F.col("kind").isin(*kinds)) if kinds else nodes
    scope = scope.where(F.col("project").isin(*projects)) if projects else scope
    ids = scope.select("id").distinct()
    if words:
        hits = postings.where(F.col("term").isin(*words)).groupBy("id").agg(F.count_distinct("term").alias("matched"))
        found = hits.join(ids, "id", "left_semi")
    else:
        found = ids.withColumn("matched", F.lit(0).cast("bigint"))
    if concepts:
        wanted = held.where(F.col("concept").isin(*concepts)).groupBy("id").agg(F.count_distinct("concept").alias("n"))
        found = found.join(wanted.where(F.col("n") >= (len(set(concepts)) if every_concept else 1)).select("id"), "id", "left_semi")
    return found


#: Architecture styles by groups of tokens, the least number of groups, and the confidence of so many.
ARCHITECTURES = {
    "layered": ((("controller", "api"), ("service", "application"), ("repository", "dao", "persistence")), 2, 0.58),
    "hexagonal": ((("port",), ("adapter",), ("domain",)), 2, 0.62),
    "clean-architecture": ((("domain", "entity"), ("application", "usecase"), ("infrastructure",), ("interface", "presenter")), 3, 0.6),
    "cqrs": ((("command",), ("query",), ("handler",)), 3, 0.72),
    "event-driven": ((("event",), ("listener", "subscriber", "consumer"), ("publisher", "producer")), 2, 0.56),
    "plugin-architecture": ((("plugin",), ("extension",), ("provider",)), 2, 0.6),
}


def architectures(tokens: DataFrame, related: DataFrame, styles: Mapping[str, tuple] = ARCHITECTURES) -> DataFrame:
    """``(scope, style, groups, confidence)``: styles of which a scope has tokens of enough groups, and a relationship.

    ``tokens(scope, term)``; ``related(scope)`` are scopes with at least one link between their parts. The confidence grows by
    .06 with each further group and ends at .98.
    """
    rows = [(style, group, term, least, float(base)) for style, (groups, least, base) in styles.items() for group, own in enumerate(groups) for term in own]
    table = tokens.sparkSession.createDataFrame(rows, "style string, part int, term string, least int, base double")
    held = tokens.join(table, "term").groupBy("scope", "style", "least", "base").agg(F.count_distinct("part").alias("groups")).where("groups >= least")
    linked = held.join(related.select("scope").distinct(), "scope", "left_semi")
    return linked.select("scope", "style", "groups", F.round(F.least(F.lit(0.98), F.col("base") + 0.06 * (F.col("groups") - F.col("least"))), 4).alias("confidence"))
