"""Graph operators on the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.operators import graph as G
from graphloom.operators import hubs as H
from graphloom.plans.adapters import EDGES_SQL, NODES_SQL, TRADE_SQL, edges, nodes, trade
from graphloom.session import checkpoint
from graphloom.sources.tables import table


def _roots(df: DataFrame) -> DataFrame:
    return df.select(F.col("source").alias("root")).unionByName(df.select(F.col("target").alias("root"))).distinct()


def graph_degrees(spark: SparkSession, folder: str) -> DataFrame:
    return G.degree_summaries(nodes(spark, folder), edges(spark, folder))


def graph_supplier_degrees(spark: SparkSession, folder: str) -> DataFrame:
    return G.degree_summaries(nodes(spark, folder), edges(spark, folder), ["supplier"], ["part"]).where("relation = '*'").select("id", "out_degree", "in_degree")


def graph_bounded_adjacency(spark: SparkSession, folder: str) -> DataFrame:
    return G.bounded_adjacency(edges(spark, folder), 3)


def graph_incident(spark: SparkSession, folder: str) -> DataFrame:
    return G.incident_edges(trade(spark, folder))


def graph_neighbourhood(spark: SparkSession, folder: str) -> DataFrame:
    member = edges(spark, folder).where("relation = 'member_of'")
    return G.neighbourhood(nodes(spark, folder), member, table(spark, folder, "region").select(F.concat(F.lit("region:"), F.col("r_regionkey")).alias("root")), 2)


def graph_dependencies(spark: SparkSession, folder: str) -> DataFrame:
    links = checkpoint(trade(spark, folder))
    return H.Related(links, _roots(links), "never").pairs()


def graph_dependents(spark: SparkSession, folder: str) -> DataFrame:
    links = checkpoint(trade(spark, folder))
    back = links.select(F.col("target").alias("source"), F.col("source").alias("target"))
    return H.Related(back, _roots(links), "never").pairs()


def graph_related(spark: SparkSession, folder: str) -> DataFrame:
    links = checkpoint(trade(spark, folder))
    return H.Related(links, _roots(links), "by_cycle").pairs()


def graph_shortest_paths(spark: SparkSession, folder: str) -> DataFrame:
    links = checkpoint(trade(spark, folder))
    return H.shortest_paths(links, _roots(links))


def graph_paths(spark: SparkSession, folder: str) -> DataFrame:
    links = checkpoint(trade(spark, folder))
    return H.paths_from(links, _roots(links), 3)


def graph_components(spark: SparkSession, folder: str) -> DataFrame:
    return G.components(trade(spark, folder))


def graph_strong_components(spark: SparkSession, folder: str) -> DataFrame:
    return G.strong_components(trade(spark, folder))


def graph_cycles(spark: SparkSession, folder: str) -> DataFrame:
    links = checkpoint(trade(spark, folder))
    found = G.cycles_supported(G.simple_cycles(links, 4), links)
    return found.select(F.concat_ws(">", F.transform("path", lambda x: x.cast("string"))).alias("path"), "length")


def graph_waves(spark: SparkSession, folder: str) -> DataFrame:
    links = trade(spark, folder).where("source > target")
    return G.waves(links)


def graph_widest_wave(spark: SparkSession, folder: str) -> DataFrame:
    return graph_waves(spark, folder).groupBy("wave").agg(F.count("*").alias("n")).agg(F.max("n").alias("width"), F.count("*").alias("waves"))


def graph_orphans(spark: SparkSession, folder: str) -> DataFrame:
    return G.orphan_edges(nodes(spark, folder).where("kind <> 'part' or name like '%a%'"), edges(spark, folder))


def graph_invalidated(spark: SparkSession, folder: str) -> DataFrame:
    changed = nodes(spark, folder).where("kind = 'region'").select("id")
    return G.invalidated(edges(spark, folder).where("relation = 'member_of'"), changed)


def graph_digest(spark: SparkSession, folder: str) -> DataFrame:
    return G.table_digest(nodes(spark, folder))


QUERIES = {f.__name__: f for f in (graph_degrees, graph_supplier_degrees, graph_bounded_adjacency, graph_incident, graph_neighbourhood, graph_dependencies, graph_dependents, graph_related, graph_shortest_paths, graph_paths, graph_components, graph_strong_components, graph_cycles, graph_waves, graph_widest_wave, graph_orphans, graph_invalidated, graph_digest)}

_REACH = "reach AS (SELECT DISTINCT source AS root, target AS node FROM {edges} UNION SELECT r.root, e.target FROM reach r JOIN {edges} e ON e.source = r.node)"
_BACK = "back AS (SELECT target AS source, source AS target FROM trade)"
_WAVES = "down AS (SELECT source, target FROM trade WHERE source > target), ids AS (SELECT source AS node FROM down UNION SELECT target FROM down), steps AS (SELECT node, 0 AS wave FROM ids UNION SELECT d.source, s.wave + 1 FROM steps s JOIN down d ON d.target = s.node), waves AS (SELECT node, max(wave) AS wave FROM steps GROUP BY node)"
SQL = {
    "graph_degrees": f"WITH {NODES_SQL}, {EDGES_SQL}, ends AS (SELECT source AS id, target AS other, relation, 'out' AS way FROM edges UNION ALL SELECT target, source, relation, 'in' FROM edges), held AS (SELECT * FROM ends WHERE id IN (SELECT id FROM nodes) AND other IN (SELECT id FROM nodes)), "
    "every AS (SELECT id, relation, other, way FROM held UNION SELECT id, '*', other, way FROM held) SELECT id, relation, count(*) FILTER (way = 'out') AS out_degree, count(*) FILTER (way = 'in') AS in_degree FROM every GROUP BY id, relation UNION ALL SELECT id, '*', 0, 0 FROM nodes WHERE id NOT IN (SELECT id FROM held)",
    "graph_supplier_degrees": "SELECT 'supplier:' || s_suppkey AS id, count(DISTINCT l_partkey) AS out_degree, 0::BIGINT AS in_degree FROM supplier LEFT JOIN lineitem ON l_suppkey = s_suppkey GROUP BY s_suppkey",
    "graph_bounded_adjacency": f"WITH {EDGES_SQL} SELECT * FROM (SELECT source, target, relation, row_number() OVER (PARTITION BY source ORDER BY source, target, relation)::INT AS place, count(*) OVER (PARTITION BY source) AS total FROM edges) WHERE place <= 3",
    "graph_incident": f"WITH {TRADE_SQL} SELECT source AS id, 'out' AS direction, target AS other, 'depends_on' AS relation FROM trade UNION ALL SELECT target, 'in', source, 'depends_on' FROM trade",
    "graph_neighbourhood": "WITH hop AS (SELECT r_regionkey AS r, 'region:' || r_regionkey AS node, 0 AS depth FROM region UNION ALL SELECT n_regionkey, 'nation:' || n_nationkey, 1 FROM nation UNION ALL SELECT n_regionkey, 'customer:' || c_custkey, 2 FROM customer JOIN nation ON c_nationkey = n_nationkey UNION ALL SELECT n_regionkey, 'supplier:' || s_suppkey, 2 FROM supplier JOIN nation ON s_nationkey = n_nationkey) SELECT 'region:' || r AS root, node, depth FROM hop",
    "graph_dependencies": f"WITH RECURSIVE {TRADE_SQL}, {_REACH.format(edges='trade')} SELECT root, node FROM reach WHERE root <> node UNION SELECT NULL, NULL WHERE false",
    "graph_dependents": f"WITH RECURSIVE {TRADE_SQL}, {_BACK}, {_REACH.format(edges='back')} SELECT root, node FROM reach WHERE root <> node",
    "graph_related": f"WITH RECURSIVE {TRADE_SQL}, {_REACH.format(edges='trade')} SELECT root, node FROM reach",
    "graph_shortest_paths": f"WITH RECURSIVE {TRADE_SQL}, ids AS (SELECT source AS id FROM trade UNION SELECT target FROM trade), walk AS (SELECT id AS root, id AS node, 0 AS depth, [id] AS path FROM ids UNION ALL SELECT w.root, t.target, w.depth + 1, list_append(w.path, t.target) FROM walk w JOIN trade t ON t.source = w.node WHERE NOT list_contains(w.path, t.target) AND w.depth < 20), best AS (SELECT root, node, min(depth) AS depth FROM walk GROUP BY root, node) "
    "SELECT root, node, depth, array_to_string(min(path), '>') AS path FROM walk JOIN best USING (root, node, depth) GROUP BY root, node, depth",
    "graph_paths": f"WITH RECURSIVE {TRADE_SQL}, ids AS (SELECT source AS id FROM trade UNION SELECT target FROM trade), walk AS (SELECT [id] AS path, false AS cyclic, 0 AS depth FROM ids UNION ALL SELECT list_append(w.path, t.target), list_contains(w.path, t.target), w.depth + 1 FROM walk w JOIN trade t ON t.source = w.path[-1] WHERE NOT w.cyclic AND w.depth < 3) SELECT array_to_string(path, '>') AS path, cyclic FROM walk WHERE depth > 0 AND (cyclic OR depth = 3 OR path[-1] NOT IN (SELECT source FROM trade))",
    "graph_components": f"WITH RECURSIVE {TRADE_SQL}, twoway AS (SELECT source, target FROM trade UNION SELECT target, source FROM trade), {_REACH.format(edges='twoway')} SELECT root AS node, least(min(node), root) AS component FROM reach GROUP BY root",
    "graph_strong_components": f"WITH RECURSIVE {TRADE_SQL}, ids AS (SELECT source AS id FROM trade UNION SELECT target FROM trade), {_REACH.format(edges='trade')}, same AS (SELECT id AS node, id AS other FROM ids UNION SELECT a.root, a.node FROM reach a JOIN reach b ON a.root = b.node AND a.node = b.root) SELECT node, min(other) AS component, count(*) AS size, count(*) > 1 OR node IN (SELECT source FROM trade WHERE source = target) AS recursive FROM same GROUP BY node",
    "graph_cycles": f"WITH RECURSIVE {TRADE_SQL}, walk AS (SELECT [source, target] AS path FROM trade WHERE source < target UNION ALL SELECT list_append(path, target) FROM walk JOIN trade ON source = path[-1] WHERE target > path[1] AND NOT list_contains(path, target) AND len(path) < 4) SELECT array_to_string(path, '>') AS path, len(path)::INT AS length FROM walk JOIN trade ON source = path[-1] AND target = path[1]",
    "graph_waves": f"WITH RECURSIVE {TRADE_SQL}, {_WAVES} SELECT node, wave FROM waves",
    "graph_widest_wave": f"WITH RECURSIVE {TRADE_SQL}, {_WAVES} SELECT max(n) AS width, count(*) AS waves FROM (SELECT wave, count(*) AS n FROM waves GROUP BY wave)",
    "graph_orphans": f"WITH {NODES_SQL}, {EDGES_SQL}, kept AS (SELECT id FROM nodes WHERE kind <> 'part' OR name LIKE '%a%') SELECT source, target, relation FROM edges WHERE source NOT IN (SELECT id FROM kept) OR target NOT IN (SELECT id FROM kept)",
    "graph_invalidated": "SELECT 'region:' || r_regionkey AS node FROM region UNION SELECT 'nation:' || n_nationkey FROM nation UNION SELECT 'customer:' || c_custkey FROM customer UNION SELECT 'supplier:' || s_suppkey FROM supplier",
    "graph_digest": f"WITH {NODES_SQL}, d AS (SELECT ('0x' || substr(sha256('{{\"id\":\"' || id || '\",\"kind\":\"' || kind || '\",\"name\":\"' || name || '\"}}'), 1, 15))::BIGINT AS own FROM nodes) SELECT count(*) AS rows, coalesce(sum(own::HUGEINT), 0)::VARCHAR AS digest FROM d",
}
