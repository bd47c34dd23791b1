"""The graph, impact, motif, taint and review operators on all nodes and all edges of the driver's tables.

The queries of the same names without ``whole_`` run on the nation graph that their SQL names. Recursive SQL over every
supplier, customer and part is too slow, so these have none; tests compare them with brute force on small tables.
The edges lead from customers and suppliers to parts, nations and regions, so the tables hold no cycle.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.operators import graph as G
from graphloom.operators import impact as I
from graphloom.operators import motifs as M
from graphloom.operators import security as X
from graphloom.operators import semantics as P
from graphloom.plans.adapters import edges, nodes
from graphloom.plans.semantic_queries import resolved_types
from graphloom.session import checkpoint


def _links(spark: SparkSession, folder: str) -> DataFrame:
    return checkpoint(edges(spark, folder))


def _back(links: DataFrame) -> DataFrame:
    return links.select(F.col("target").alias("source"), F.col("source").alias("target"))


def _ids(spark: SparkSession, folder: str, *kinds: str) -> DataFrame:
    found = nodes(spark, folder)
    return (found.where(F.col("kind").isin(*kinds)) if kinds else found).select("id")


def _roots(spark: SparkSession, folder: str, *kinds: str) -> DataFrame:
    return _ids(spark, folder, *kinds).withColumnRenamed("id", "root")


def _key(column: str = "id") -> Column:
    return F.substring_index(column, ":", -1).cast("bigint")


def _shown(path: str = "path") -> Column:
    return F.concat_ws(">", path).alias("path")


def whole_incident(spark: SparkSession, folder: str) -> DataFrame:
    return G.incident_edges(edges(spark, folder)).groupBy("id", "direction").agg(F.count("*").alias("edges"))


def whole_dependencies(spark: SparkSession, folder: str) -> DataFrame:
    return G.reachable(_links(spark, folder), _roots(spark, folder), "never").select("root", "node")


def whole_dependents(spark: SparkSession, folder: str) -> DataFrame:
    return G.reachable(_back(_links(spark, folder)), _roots(spark, folder), "never").select("root", "node")


def whole_related(spark: SparkSession, folder: str) -> DataFrame:
    return G.reachable(_links(spark, folder), _roots(spark, folder), "by_cycle").select("root", "node")


def whole_shortest_paths(spark: SparkSession, folder: str) -> DataFrame:
    return G.shortest_paths(_links(spark, folder), _roots(spark, folder)).select("root", "node", "depth", _shown())


def whole_paths(spark: SparkSession, folder: str) -> DataFrame:
    return G.paths_from(_links(spark, folder), _roots(spark, folder), 3).select(_shown(), "cyclic")


def whole_components(spark: SparkSession, folder: str) -> DataFrame:
    return G.components(edges(spark, folder))


def whole_strong_components(spark: SparkSession, folder: str) -> DataFrame:
    return G.strong_components(edges(spark, folder))


def whole_cycles(spark: SparkSession, folder: str) -> DataFrame:
    links = _links(spark, folder)
    return G.cycles_supported(G.simple_cycles(links, 4), links).select(_shown(), "length")


def whole_waves(spark: SparkSession, folder: str) -> DataFrame:
    return G.waves(edges(spark, folder), nodes(spark, folder))


def whole_widest_wave(spark: SparkSession, folder: str) -> DataFrame:
    return whole_waves(spark, folder).groupBy("wave").agg(F.count("*").alias("n")).agg(F.max("n").alias("width"), F.count("*").alias("waves"))


def _impact(spark: SparkSession, folder: str) -> DataFrame:
    links = _links(spark, folder).withColumn("relation", F.lit("depends_on")).withColumn("evidence", F.array(F.lit("uses")))  # every link is a dependency here, as in trade()
    return I.propagate(I.legal_edges(nodes(spark, folder), links, "signature"), _roots(spark, folder), 4)


def whole_impact_findings(spark: SparkSession, folder: str) -> DataFrame:
    seen = F.when(F.col("node").startswith("supplier:"), "public").when(F.col("node").startswith("customer:"), "private")
    return _impact(spark, folder).select("root", "node", "hops", I.impact_score(F.col("weakest"), F.col("hops"), I.exposure(seen)).alias("score"), F.when(F.col("hops") == 1, "direct").otherwise("transitive").alias("reach"))


def whole_impact_confidence(spark: SparkSession, folder: str) -> DataFrame:
    return I.path_confidence(_impact(spark, folder)).select("root", "node", "confidence", "tier")


def _facts(spark: SparkSession, folder: str) -> DataFrame:
    """Suppliers implement the parts they provide and customers use those they buy; members compose and call what they are
    members of, and buyers their parts; a nation constructs its members and returns what they provide."""
    links = _links(spark, folder).select("source", "target", F.col("relation").alias("link"))
    provides, member = links.where("link = 'provides'"), links.where("link = 'member_of'")
    held = links.where("link <> 'provides'")
    returned = member.select("source", F.col("target").alias("nation")).join(provides.select("source", "target"), "source").select(F.col("nation").alias("source"), "target").distinct()
    kinds = {"inherits": provides, "uses": links.where("link = 'depends_on'"), "composes": held, "calls": held, "constructs": _back(member), "returns": returned}
    return checkpoint(reduce(DataFrame.unionByName, (df.select("source", "target", F.lit(name).alias("relation")) for name, df in kinds.items())))


def whole_motif_strategies(spark: SparkSession, folder: str) -> DataFrame:
    return M.strategies(_facts(spark, folder))


def whole_motif_factories(spark: SparkSession, folder: str) -> DataFrame:
    return M.factories(_facts(spark, folder))


def whole_motif_adapters(spark: SparkSession, folder: str) -> DataFrame:
    return M.adapters(_facts(spark, folder))


def whole_motif_decorators(spark: SparkSession, folder: str) -> DataFrame:
    """Suppliers hold and call the parts they provide, too."""
    links = _links(spark, folder).select("source", "target", F.col("relation").alias("link"))
    kinds = {"inherits": links.where("link = 'provides'"), "composes": links, "calls": links}
    return M.decorators(reduce(DataFrame.unionByName, (df.select("source", "target", F.lit(name).alias("relation")) for name, df in kinds.items())))


def whole_motif_commands(spark: SparkSession, folder: str) -> DataFrame:
    return M.commands(_facts(spark, folder))


def whole_motif_template_methods(spark: SparkSession, folder: str) -> DataFrame:
    links = _links(spark, folder).where("relation <> 'depends_on'").select("source", "target")
    method = lambda c, m: F.concat(F.lit(f"{m} "), F.col(c))
    over = links.select(method("source", "hook").alias("source"), method("target", "hook").alias("target"), F.lit("overrides").alias("relation"))
    calls = links.select(method("target", "run").alias("source"), method("target", "hook").alias("target"), F.lit("calls").alias("relation"))
    members = _ids(spark, folder).select(F.explode(F.array(method("id", "hook"), method("id", "run"))).alias("method"), F.col("id").alias("owner"))
    return M.template_methods(links.withColumn("relation", F.lit("inherits")).unionByName(over).unionByName(calls), members)


def whole_taint_paths(spark: SparkSession, folder: str) -> DataFrame:
    """From customers and suppliers to parts and regions; nations of even key are sanitizers."""
    paths = G.paths_from(_links(spark, folder), _roots(spark, folder, "customer", "supplier"), 4)
    every = G.prefixes(paths)
    clean = _ids(spark, folder, "nation").where(_key() % 2 == 0)
    return X.taint_between(every, _ids(spark, folder, "customer", "supplier"), _ids(spark, folder, "part", "region"), clean).select(_shown(), "verdict")


def whole_change_review(spark: SparkSession, folder: str) -> DataFrame:
    links, every = _links(spark, folder), nodes(spark, folder)
    subjects = every.select("id", F.concat(F.lit("src/"), "id").alias("path"), F.col("kind").alias("project"))
    changes = subjects.where(_key() % 2 == 0).select("path", "project").unionByName(subjects.select(F.concat(F.lit("docs/"), "project").alias("path"), "project").distinct())
    dependents = G.reachable(_back(links), _roots(spark, folder), "never").groupBy(F.col("root").alias("id")).agg(F.count("*").alias("dependents"))
    risk = links.groupBy(F.col("target").alias("id")).agg(F.count("*").alias("risk")).where("risk > 55")
    cyclic = G.strong_components(links).where("recursive").select(F.col("node").alias("id"))
    return X.change_review(changes, subjects, dependents, risk, cyclic)


def whole_transaction_flow(spark: SparkSession, folder: str) -> DataFrame:
    kind = F.when(_key() % 4 == 0, "requires_new").when(_key() % 4 == 1, "never")
    bounds = _ids(spark, folder).select(F.col("id").alias("symbol"), kind.alias("propagation")).where("propagation is not null")
    return P.transaction_flow(_links(spark, folder), bounds, _roots(spark, folder))


def whole_read_only_writes(spark: SparkSession, folder: str) -> DataFrame:
    readers = _ids(spark, folder, "customer", "supplier").withColumnRenamed("id", "symbol")
    writers = _ids(spark, folder, "part", "nation").where(_key() % 7 == 3).withColumnRenamed("id", "symbol")
    return P.read_only_writes(_links(spark, folder), readers, writers)


def whole_cascade_targets(spark: SparkSession, folder: str) -> DataFrame:
    owned = _links(spark, folder).where("relation <> 'depends_on'")
    return G.reachable(owned, _roots(spark, folder), "by_cycle").select("root", "node")


def whole_endpoint_entities(spark: SparkSession, folder: str) -> DataFrame:
    return P.endpoint_entities(_links(spark, folder), _ids(spark, folder, "customer", "supplier"), _ids(spark, folder, "part", "region"))


def whole_legacy_impact(spark: SparkSession, folder: str) -> DataFrame:
    """What depends on a region, or on a part whose key divides by 5; parts have no file."""
    legacy = _roots(spark, folder, "region").unionByName(_roots(spark, folder, "part").where(_key("root") % 5 == 0))
    sources = nodes(spark, folder).where("kind <> 'part'").select("id", F.col("name").alias("source"))
    return P.legacy_impact(_links(spark, folder), legacy, sources)


def whole_call_statistics(spark: SparkSession, folder: str) -> DataFrame:
    return P.call_statistics(resolved_types(spark, folder), G.strong_components(edges(spark, folder)))


QUERIES = {name: f for name, f in list(globals().items()) if name.startswith("whole_")}
