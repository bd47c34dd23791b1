"""The driver's tables seen as the engine's model: nodes, edges, files, changes, metrics and findings; with the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.sources.tables import table

_KINDS = {"region": "r_regionkey", "nation": "n_nationkey", "customer": "c_custkey", "supplier": "s_suppkey", "part": "p_partkey"}


def _id(kind: str, column: str):
    return F.concat(F.lit(f"{kind}:"), F.col(column).cast("string"))


def nodes(spark: SparkSession, folder: str) -> DataFrame:
    """id, kind, name of all regions, nations, customers, suppliers and parts."""
    found = None
    for kind, key in _KINDS.items():
        name = F.col(f"{kind[0]}_name")
        one = table(spark, folder, kind).select(_id(kind, key).alias("id"), F.lit(kind).alias("kind"), name.alias("name"))
        found = one if found is None else found.unionByName(one)
    return found


NODES_SQL = "nodes AS (" + " UNION ALL ".join(f"SELECT '{kind}:' || {key} AS id, '{kind}' AS kind, {kind[0]}_name AS name FROM {kind}" for kind, key in _KINDS.items()) + ")"


def edges(spark: SparkSession, folder: str) -> DataFrame:
    """member_of of nations, customers and suppliers; provides of suppliers; depends_on of customers, each with evidence."""
    lineitem, orders = table(spark, folder, "lineitem"), table(spark, folder, "orders")

    def link(df, source, target, relation):
        return df.select(source.alias("source"), target.alias("target"), F.lit(relation).alias("relation")).distinct()

    found = link(table(spark, folder, "nation"), _id("nation", "n_nationkey"), _id("region", "n_regionkey"), "member_of")
    found = found.unionByName(link(table(spark, folder, "customer"), _id("customer", "c_custkey"), _id("nation", "c_nationkey"), "member_of"))
    found = found.unionByName(link(table(spark, folder, "supplier"), _id("supplier", "s_suppkey"), _id("nation", "s_nationkey"), "member_of"))
    found = found.unionByName(link(lineitem, _id("supplier", "l_suppkey"), _id("part", "l_partkey"), "provides"))
    bought = orders.join(lineitem.select(F.col("l_orderkey").alias("o_orderkey"), "l_partkey"), "o_orderkey")
    found = found.unionByName(link(bought, _id("customer", "o_custkey"), _id("part", "l_partkey"), "depends_on"))
    return found.withColumn("evidence", F.array(F.col("relation")))


EDGES_SQL = (
    "edges AS (SELECT DISTINCT 'nation:' || n_nationkey AS source, 'region:' || n_regionkey AS target, 'member_of' AS relation FROM nation"
    " UNION SELECT 'customer:' || c_custkey, 'nation:' || c_nationkey, 'member_of' FROM customer"
    " UNION SELECT 'supplier:' || s_suppkey, 'nation:' || s_nationkey, 'member_of' FROM supplier"
    " UNION SELECT 'supplier:' || l_suppkey, 'part:' || l_partkey, 'provides' FROM lineitem"
    " UNION SELECT 'customer:' || o_custkey, 'part:' || l_partkey, 'depends_on' FROM orders JOIN lineitem ON l_orderkey = o_orderkey)"
)


def _number(name: str):
    """A number for a name, the same in Spark and SQL: 48 bits of its digest."""
    return F.conv(F.substring(F.sha2(name, 256), 1, 12), 16, 10).cast("bigint")


def _pairs(spark: SparkSession, folder: str) -> DataFrame:
    """one, two, evidence: projects and what ever blocked them, projects and the subjects that were asked about in them, and
    modules and their projects; each once, of whole tables."""
    runs = table(spark, folder, "project_runs", ["project", "blocked_by_json"])
    blocked = runs.select(F.col("project").alias("one"), F.explode(F.from_json("blocked_by_json", "array<string>")).alias("two"), F.lit("workspace.projects:blocked_by").alias("evidence"))
    asked = table(spark, folder, "ask_log").select(F.col("project").alias("one"), F.lower("subject").alias("two"), F.lit("uses").alias("evidence"))
    modules = table(spark, folder, "risk_hotspots").where(F.lower("kind") == "module").select(F.lower("subject_id").alias("one"), F.col("project").alias("two"), F.lit("workspace.projects:module_of").alias("evidence"))
    return blocked.unionByName(asked).unionByName(modules).where("one is not null and two is not null").distinct()


def projects(spark: SparkSession, folder: str) -> DataFrame:
    """id, name, area of all projects that runs name, and of all ends of ``trade``; areas are five."""
    pairs = _pairs(spark, folder)
    named = table(spark, folder, "project_runs", ["project"]).union(pairs.select("one")).union(pairs.select("two")).where("project is not null").distinct()
    return named.select(_number("project").alias("id"), F.col("project").alias("name"), (_number("project") % 5).alias("area"))


def trade(spark: SparkSession, folder: str) -> DataFrame:
    """The graph of projects and subjects, with cycles: each depends on what ever blocked it, was asked about in it, or holds it.
    It grows with the tables; no edge is left out."""
    return _pairs(spark, folder).groupBy(_number("one").alias("source"), _number("two").alias("target")).agg(F.lit("depends_on").alias("relation"), F.array_sort(F.collect_set("evidence")).alias("evidence"))


_NUMBER_SQL = "('0x' || substr(sha256({}), 1, 12))::BIGINT"
TRADE_SQL = (
    "pairs AS (SELECT DISTINCT one, two FROM (SELECT project AS one, unnest(from_json(blocked_by_json, '[\"VARCHAR\"]')) AS two FROM project_runs UNION ALL SELECT project, lower(subject) FROM ask_log UNION ALL SELECT lower(subject_id), project FROM risk_hotspots WHERE lower(kind) = 'module') WHERE one IS NOT NULL AND two IS NOT NULL), "
    f"trade AS MATERIALIZED (SELECT {_NUMBER_SQL.format('one')} AS source, {_NUMBER_SQL.format('two')} AS target FROM pairs), "
    f"projects AS MATERIALIZED (SELECT {_NUMBER_SQL.format('name')} AS id, name, {_NUMBER_SQL.format('name')} % 5 AS area FROM (SELECT project AS name FROM project_runs UNION SELECT one FROM pairs UNION SELECT two FROM pairs) WHERE name IS NOT NULL)"
)


def changes(spark: SparkSession, folder: str) -> DataFrame:
    """The change stream: commit, at, contributor_id, path, project from events."""
    events = table(spark, folder, "events")
    return events.select(F.col("event_id").alias("commit"), F.col("ts").alias("at"), F.col("user_id").cast("string").alias("contributor_id"), F.col("event_type").alias("project"))


def files(spark: SparkSession, folder: str) -> DataFrame:
    """The inventory: id, path, project, kind, language, size, content digest of documents."""
    docs = table(spark, folder, "documents")
    return docs.select(F.col("doc_id").alias("id"), F.col("doc_path").alias("path"), "project", F.col("doc_kind").alias("kind"), F.col("lang").alias("language"), F.coalesce(F.length("text"), F.lit(0)).cast("bigint").alias("size"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("sha256"))


FILES_SQL = "files AS (SELECT doc_id AS id, doc_path AS path, project, doc_kind AS kind, lang AS language, coalesce(length(text), 0)::BIGINT AS size, sha256(coalesce(text, '')) AS sha256 FROM documents)"
