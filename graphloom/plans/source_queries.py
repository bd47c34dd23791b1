"""Manifests, settings, diffs, source roots, snapshots, rule gates and reports on files made of the driver's tables."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions.versions import route
from graphloom.operators import rules as R
from graphloom.operators.semantics import layer, without_source
from graphloom.plans.adapters import NODES_SQL, files, nodes
from graphloom.plans.store_queries import SQL as STORE_SQL
from graphloom.plans.store_queries import _observations, _streamed
from graphloom.session import shared_dir
from graphloom.sources import changes as C
from graphloom.sources import code as P
from graphloom.sources import inventory as V
from graphloom.sources import manifests as M
from graphloom.sources import stores as T
from graphloom.sources.tables import table
from graphloom.streaming import watch as H


def _text(df: DataFrame, path: Column, line: Column, order: str, around: tuple[str, str] = ("", ""), between: str = "\n") -> DataFrame:
    """One file per path: the lines in order. For files that are small by nature."""
    lines = F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), line.alias("line")))), lambda x: x["line"])
    return df.groupBy(path.alias("path")).agg(F.concat(F.lit(around[0]), F.array_join(lines, between), F.lit(around[1])).alias("content"))


def manifest_dependencies(spark: SparkSession, folder: str) -> DataFrame:
    """Brands as Python projects that need their parts, nations as packages that need their suppliers, areas as Cargo crates."""
    part, supplier = table(spark, folder, "part"), table(spark, folder, "supplier")
    pip = _text(part, F.concat(F.col("p_brand"), F.lit("/requirements.txt")), F.concat(F.lit("part"), "p_partkey", F.when(F.col("p_size") % 2 == 0, F.lit("[extra] >=")).otherwise(F.lit("==")), "p_size", F.lit(" # "), "p_name"), "p_partkey")
    npm = _text(supplier, F.concat(F.lit("n"), "s_nationkey", F.lit("/package.json")), F.concat(F.lit('"s'), "s_suppkey", F.lit('": "^'), "s_nationkey", F.lit('"')), "s_suppkey", ('{"devDependencies": {', "}}"), ", ")
    cargo = _text(supplier, F.concat(F.lit("c"), F.col("s_nationkey") % 5, F.lit("/Cargo.toml")), F.concat(F.lit("c"), "s_suppkey", F.lit(' = { version = "'), "s_nationkey", F.lit('", optional = true }')), "s_suppkey", ("[build-dependencies]\n", "\n"))
    broken = spark.createDataFrame([("x/package.json", "{"), ("y/pom.xml", "<a>"), ("z/readme.md", "a==1"), ("w/pyproject.toml", None)], "path string, content string")
    return M.dependencies(pip.unionByName(npm).unionByName(cargo).unionByName(broken))


def maven_modules(spark: SparkSession, folder: str) -> DataFrame:
    """Regions as parents of their nations, which need the nation before them and a module that is none."""
    nation, region = table(spark, folder, "nation"), table(spark, folder, "region")
    child = F.concat(F.lit("<project><parent><groupId>g</groupId><artifactId>r"), "n_regionkey", F.lit("</artifactId></parent><artifactId>n"), "n_nationkey", F.lit("</artifactId><dependencies><dependency><groupId>g</groupId><artifactId>n"), F.col("n_nationkey") - 1, F.lit("</artifactId></dependency><dependency><groupId>o</groupId><artifactId>x</artifactId></dependency></dependencies></project>"))
    poms = nation.select(F.concat(F.lit("r"), "n_regionkey", F.lit("/n"), "n_nationkey", F.lit("/pom.xml")).alias("path"), child.alias("content"))
    top = _text(region.join(nation, F.col("r_regionkey") == F.col("n_regionkey")), F.concat(F.lit("r"), "r_regionkey", F.lit("/pom.xml")), F.concat(F.lit("<module>n"), "n_nationkey", F.lit("</module>")), "n_nationkey", ("<project><groupId>g</groupId><artifactId>R</artifactId><modules>", "</modules></project>"))
    named = top.withColumn("content", F.regexp_replace("content", "<artifactId>R<", F.concat(F.lit("<artifactId>"), F.substring_index("path", "/", 1), F.lit("<"))))
    return M.module_graph(poms.unionByName(named))


def diff_ranges(spark: SparkSession, folder: str) -> DataFrame:
    """Orders as diffs of a file: a line is removed first, then the order's lines are added; some files are renamed."""
    lines = table(spark, folder, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.count("*").alias("n"))
    name = F.concat(F.lit("o"), F.col("id") % 9, F.lit(".txt"))
    new = F.when(F.col("id") % 4 == 0, F.concat(F.lit("moved/"), name)).otherwise(name)
    head = F.concat(F.lit("diff --git a/"), name, F.lit(" b/"), new, F.lit("\n"), F.when(F.col("id") % 4 == 0, F.concat(F.lit("rename from "), name, F.lit("\nrename to "), new, F.lit("\n"))).otherwise(F.lit("")))
    body = F.concat(F.lit("--- a/"), name, F.lit("\n+++ b/"), new, F.lit("\n@@ -5,1 +7,"), "n", F.lit(" @@\n-gone\n"), F.array_join(F.array_repeat(F.lit("+new"), F.col("n").cast("int")), "\n"), F.lit("\n"))
    found = C.diff_lines(lines.select("id", F.concat(head, body).alias("text")))
    return found.groupBy("id", "new_path", "change").agg(F.min("line").alias("first"), F.max("line").alias("last"), F.count("*").alias("rows"))


def _settings(spark: SparkSession, folder: str) -> DataFrame:
    supplier = table(spark, folder, "supplier")
    plain = _text(supplier, F.concat(F.lit("n"), "s_nationkey", F.lit(".properties")), F.concat(F.lit("# one\nsupplier.s"), "s_suppkey", F.lit(" = "), "s_name"), "s_suppkey")
    nested = _text(supplier, F.concat(F.lit("n"), "s_nationkey", F.lit(".yml")), F.concat(F.lit("  s"), "s_suppkey", F.lit(":\n    name: '"), "s_name", F.lit("'")), "s_suppkey", ("suppliers:\n", "\n"))
    return P.config_values(plain.unionByName(nested))


def config_values(spark: SparkSession, folder: str) -> DataFrame:
    return _settings(spark, folder)


def config_objects(spark: SparkSession, folder: str) -> DataFrame:
    return P.unflattened(_settings(spark, folder).where("path like '%.yml'"))


_GRADLE = 'plugins { id "java" } // id "none"\n/* include "gone" */\ninclude "NAME:a", \'NAME:b\'\nincludeBuild("x")\ninclude(":c//d", other)\n'


def gradle_includes(spark: SparkSession, folder: str) -> DataFrame:
    text = F.replace(F.lit(_GRADLE), F.lit("NAME"), F.concat(F.lit(":n"), "n_nationkey"))
    return table(spark, folder, "nation").select("n_nationkey", F.explode(P.literal_arguments(text, "include")).alias("module"))


_FOLDERS = ("app/src/main/java/", "app/src/test/java/", "lib/src/main/kotlin/", "src/", "app/src/main/resources/", "tools/", "src/main/java/generated/")


def _placed(spark: SparkSession, folder: str) -> DataFrame:
    paths = files(spark, folder).where("path is not null")
    front = F.element_at(F.array(*(F.lit(x) for x in _FOLDERS)), (F.col("id") % len(_FOLDERS) + 1).cast("int"))
    return paths.select("id", "project", F.concat(front, F.lit("p"), F.col("id") % 3, F.lit("/X.java")).alias("path"), "sha256")


def source_roots(spark: SparkSession, folder: str) -> DataFrame:
    return P.source_roots(_placed(spark, folder))


_MANIFESTS = ("pom.xml", "build.gradle", "package.json", "Cargo.toml", "readme.md", "Dockerfile")


def _with_manifests(spark: SparkSession, folder: str) -> DataFrame:
    name = F.element_at(F.array(*(F.lit(x) for x in _MANIFESTS)), (F.col("id") % len(_MANIFESTS) + 1).cast("int"))
    return files(spark, folder).where("project is not null").select("id", "project", F.concat("project", F.lit("/"), F.when(F.col("id") % 5 == 0, F.lit("sub/")).otherwise(F.lit("")), name).alias("path"))


def technologies(spark: SparkSession, folder: str) -> DataFrame:
    return V.technologies(_with_manifests(spark, folder))


def discovered_projects(spark: SparkSession, folder: str) -> DataFrame:
    return V.discovered_projects(_with_manifests(spark, folder))


def snapshot_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    """Nodes and customers published, found again by the pointer and checked against the manifest."""
    root = f"{shared_dir(spark).rstrip('/')}/snapshots-{uuid.uuid4().hex}"
    T.publish_snapshot({"nodes": nodes(spark, folder), "customer": table(spark, folder, "customer")}, root, "first")
    T.publish_snapshot({"nodes": nodes(spark, folder).where("kind <> 'part'"), "customer": table(spark, folder, "customer")}, root, "second")
    held = T.load_snapshot(spark, root)
    return held["nodes"].groupBy("kind").agg(F.count("*").alias("rows")).unionByName(held["customer"].select(F.lit("table customer").alias("kind")).groupBy("kind").agg(F.count("*").alias("rows")))


def pack_order(spark: SparkSession, folder: str) -> DataFrame:
    """Nations as packs that need their region's; the order in which they can be loaded."""
    rows = table(spark, folder, "nation").select("n_nationkey", "n_regionkey").distinct().collect()  # fixed: 25 nations
    packs = [R.Pack(f"n{r[0]:02}", "1.2.0", ((f"r{r[1]}", "^1.0.0", False), ("none", "1", True))) for r in rows] + [R.Pack(f"r{k}", "1.1.0") for k in {r[1] for r in rows}]
    order = R.resolve_packs(packs, lambda version, constraint: version.split(".")[0] == constraint.strip("^").split(".")[0])
    return spark.createDataFrame(list(enumerate(order)), "place int, pack string")


def layers(spark: SparkSession, folder: str) -> DataFrame:
    facets = F.array(F.concat(F.lit("My"), F.when(F.col("p_size") % 3 == 0, "Service").when(F.col("p_size") % 3 == 1, "Repository").otherwise("Thing")), F.when(F.col("p_partkey") % 4 == 0, "RestController").otherwise("x"), F.when(F.col("p_partkey") % 5 == 0, "ENTITY").otherwise("y"))
    return table(spark, folder, "part").select("p_partkey", layer(facets).alias("layer"))


def fix_order(spark: SparkSession, folder: str) -> DataFrame:
    edits = table(spark, folder, "lineitem").select(F.col("l_orderkey").alias("path"), (F.col("l_partkey") % 100).alias("start"), (F.col("l_partkey") % 100 + F.col("l_quantity").cast("bigint")).alias("stop")).distinct()
    return H.auto_fix_order(edits)


def audit_log(spark: SparkSession, folder: str) -> DataFrame:
    """The regions and nations as entries of a chained log."""
    names = [r[0] for r in table(spark, folder, "nation").select("n_name").orderBy("n_nationkey").collect()]  # fixed: 25 nations
    entries = T.audit_entries(None, 0, names[:10])
    entries += T.audit_entries(entries[-1][3], 10, names[10:])
    return spark.createDataFrame(entries, "seq long, link string, payload string, digest string")


def health_updates(spark: SparkSession, folder: str) -> DataFrame:
    """Each plugin's last state that the stream gave."""
    found = _streamed(spark, folder, lambda s: H.health_stream(_observations(s)), "update")
    last = found.groupBy("plugin").agg(F.max_by(F.struct(*(c for c in found.columns if c != "plugin")), "probes").alias("s"))
    return last.select("plugin", "s.*")


def kept_symbols(spark: SparkSession, folder: str) -> DataFrame:
    """Parts as symbols of their brands as sources, without those of three brands; parts without a brand stay."""
    part = table(spark, folder, "part").select(F.col("p_partkey").alias("id"), F.when(F.col("p_size") != 50, F.col("p_brand")).alias("source"))
    gone = part.where("id % 400 = 0").select("source").where("source is not null").distinct()
    return without_source(part, gone).select("id", "source")


def named_nodes(spark: SparkSession, folder: str) -> DataFrame:
    """Nodes by kind, and by exact name."""
    every = nodes(spark, folder)
    return every.where("kind = 'supplier'").select("id", F.lit("kind").alias("by")).unionByName(every.where("name = 'red widget'").select("id", F.lit("name").alias("by")))


def _hits(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "part").select(F.col("p_partkey").alias("finding_id"), F.concat(F.lit("R"), F.col("p_size") % 5).alias("rule_id"), F.concat(F.lit("src/"), F.when(F.col("p_size") > 40, "gen").otherwise("app"), F.lit("/"), "p_brand", F.lit(".java")).alias("path"))


_SUPPRESSED = ((1, "R1", "src/app/Brand#7.java"), (2, None, "src/app/Brand#3.java"), (3, "R2", None), (4, "R1", None))


def gated_findings(spark: SparkSession, folder: str) -> DataFrame:
    return R.gated(_hits(spark, folder), spark.createDataFrame(list(_SUPPRESSED), "place int, rule_id string, path string"), ["src/**"], ["src/gen/**"], ["R4"])


def rule_cases(spark: SparkSession, folder: str) -> DataFrame:
    """What two rules find of the parts against what their cases expect."""
    registry = R.RuleRegistry()
    registry.add(R.Rule("large", "high", lambda: F.col("p_size") > 45))
    registry.add(R.Rule("red", "low", lambda: F.col("p_name").startswith("red")))
    part = table(spark, folder, "part")
    expected = part.where("p_size >= 45").select("p_partkey", F.lit("large").alias("rule_id")).unionByName(part.where("p_name like 'red%'").select("p_partkey", F.lit("red").alias("rule_id")))
    return R.rule_test(registry.run(part, "p_partkey"), expected, "p_partkey")


def routes_matched(spark: SparkSession, folder: str) -> DataFrame:
    """Requests meet endpoints by method and normalised path."""
    part, orders = table(spark, folder, "part"), table(spark, folder, "orders")
    verb = lambda c: F.element_at(F.array(F.lit("GET"), F.lit("POST"), F.lit("PUT")), (c % 3 + 1).cast("int"))
    ends = part.select(F.col("p_partkey").alias("endpoint"), verb(F.col("p_partkey")).alias("method"), route(F.concat(F.lit("a//"), "p_partkey", F.lit("/{id}/"))).alias("route"))
    asked = orders.select(F.col("o_orderkey").alias("request"), verb(F.col("o_custkey")).alias("method"), route(F.concat(F.lit("/a/"), F.col("o_custkey"), F.lit("/{name}"))).alias("route"))
    return asked.join(ends, ["method", "route"]).select("request", "endpoint")


def repository_report(spark: SparkSession, folder: str) -> DataFrame:
    """Sections of counts over documents, runs, scored subjects and the knowledge graph, one row an item."""
    docs, runs, spots = table(spark, folder, "documents"), table(spark, folder, "project_runs"), table(spark, folder, "risk_hotspots")
    parts = (("documents", docs, "doc_kind"), ("projects of documents", docs, "project"), ("runs", runs, "status"), ("subjects", spots, "language"), ("nodes", nodes(spark, folder), "kind"))
    counted = [df.groupBy(F.coalesce(F.col(c).cast("string"), F.lit("none")).alias("item")).agg(F.count("*").alias("rows")).select(F.lit(name).alias("section"), "item", "rows") for name, df, c in parts]
    return reduce(DataFrame.unionByName, counted)


QUERIES = {f.__name__: f for f in (manifest_dependencies, maven_modules, diff_ranges, config_values, config_objects, gradle_includes, source_roots, technologies, discovered_projects, snapshot_round_trip, pack_order, layers, fix_order, audit_log, health_updates, kept_symbols, named_nodes, gated_findings, rule_cases, routes_matched, repository_report)}

_HELD = "[" + ", ".join(f"'{x}'" for x in _FOLDERS) + "]"
_NAMES = "[" + ", ".join(f"'{x}'" for x in _MANIFESTS) + "]"
_MARK = "CASE k WHEN 0 THEN 'maven' WHEN 1 THEN 'gradle' WHEN 2 THEN 'npm' WHEN 3 THEN 'cargo' WHEN 5 THEN 'docker' END"
SQL = {
    "health_updates": STORE_SQL["plugin_health"],
    "manifest_dependencies": "SELECT p_brand || '/requirements.txt' AS path, 'pypi' AS ecosystem, 'part' || p_partkey AS name, CASE WHEN p_size % 2 = 0 THEN '>=' ELSE '==' END || p_size AS version, 'runtime' AS scope, false AS optional FROM part UNION ALL SELECT 'n' || s_nationkey || '/package.json', 'npm', 's' || s_suppkey, '^' || s_nationkey, 'development', false FROM supplier UNION ALL SELECT 'c' || (s_nationkey % 5) || '/Cargo.toml', 'cargo', 'c' || s_suppkey, s_nationkey::VARCHAR, 'build', true FROM supplier",
    "maven_modules": "SELECT 'g:r' || n_regionkey AS source, 'g:n' || n_nationkey AS target, unnest(['parent_of', 'contains']) AS relation FROM nation UNION ALL SELECT 'g:n' || n_nationkey, 'g:n' || (n_nationkey - 1), CASE WHEN n_nationkey = 0 THEN 'unresolved' ELSE 'depends_on' END FROM nation",
    "diff_ranges": "WITH o AS (SELECT l_orderkey AS id, count(*) AS n, CASE WHEN l_orderkey % 4 = 0 THEN 'moved/' ELSE '' END || 'o' || (l_orderkey % 9) || '.txt' AS new_path FROM lineitem GROUP BY 1) SELECT id, new_path, 'added' AS change, 7 AS first, 6 + n AS last, n AS rows FROM o UNION ALL SELECT id, new_path, 'removed', 5, 5, 1 FROM o UNION ALL SELECT id, new_path, 'renamed', NULL, NULL, 1 FROM o WHERE id % 4 = 0",
    "config_values": "SELECT 'n' || s_nationkey || '.properties' AS path, 'supplier.s' || s_suppkey AS key, s_name AS value FROM supplier UNION ALL SELECT 'n' || s_nationkey || '.yml', 'suppliers.s' || s_suppkey || '.name', s_name FROM supplier",
    "config_objects": "SELECT 'n' || s_nationkey || '.yml' AS path, '{\"suppliers\":{' || string_agg('\"s' || s_suppkey || '\":{\"name\":\"' || s_name || '\"}', ',' ORDER BY 's' || s_suppkey) || '}}' AS json FROM supplier GROUP BY s_nationkey",
    "gradle_includes": "SELECT n_nationkey, unnest([':n' || n_nationkey || ':a', ':n' || n_nationkey || ':b', ':c//d']) AS module FROM nation",
    "source_roots": f"SELECT CASE doc_id % 7 WHEN 0 THEN 'app/src/main/java' WHEN 2 THEN 'lib/src/main/kotlin' ELSE 'src' END AS root, count(*) AS files FROM documents WHERE doc_path IS NOT NULL AND doc_id % 7 IN (0, 2, 3) GROUP BY 1",
    "technologies": f"SELECT project, {_MARK} AS technology, count(*) AS evidence FROM (SELECT project, doc_id % 6 AS k FROM documents WHERE project IS NOT NULL AND doc_id % 6 <> 4) GROUP BY ALL",
    "discovered_projects": f"WITH r AS (SELECT root, array_to_string(list_sort(list(DISTINCT t)), ',') AS markers FROM (SELECT project || CASE WHEN doc_id % 5 = 0 THEN '/sub' ELSE '' END AS root, {_MARK} AS t FROM (SELECT project, doc_id, doc_id % 6 AS k FROM documents WHERE project IS NOT NULL AND doc_id % 6 <> 4)) GROUP BY root) SELECT r.root, r.markers, u.root AS parent FROM r LEFT JOIN r u ON r.root = u.root || '/sub'",
    "snapshot_round_trip": f"WITH {NODES_SQL} SELECT kind, count(*) AS rows FROM nodes WHERE kind <> 'part' GROUP BY kind UNION ALL SELECT 'table customer', count(*) FROM customer",
    "pack_order": "WITH f AS (SELECT n_regionkey AS r, min(n_nationkey) AS n FROM nation GROUP BY 1), k AS (SELECT 'n' || lpad(n_nationkey::VARCHAR, 2, '0') AS pack, n_nationkey AS a, 1 AS b FROM nation UNION ALL SELECT 'r' || r, n, 0 FROM f) SELECT (row_number() OVER (ORDER BY a, b) - 1)::INT AS place, pack FROM k",
    "layers": "SELECT p_partkey, CASE WHEN p_partkey % 4 = 0 THEN 'controller' WHEN p_size % 3 = 0 THEN 'service' WHEN p_size % 3 = 1 THEN 'repository' WHEN p_partkey % 5 = 0 THEN 'entity' ELSE 'other' END AS layer FROM part",
    "fix_order": "WITH e AS (SELECT DISTINCT l_orderkey AS path, l_partkey % 100 AS start, l_partkey % 100 + l_quantity::BIGINT AS stop FROM lineitem), c AS (SELECT *, max(stop) OVER (PARTITION BY path ORDER BY start, stop ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS ended FROM e) SELECT path, start, stop, row_number() OVER (PARTITION BY path ORDER BY start DESC, stop DESC)::INT AS turn FROM c WHERE ended IS NULL OR start >= ended",
    "audit_log": "WITH RECURSIVE n AS (SELECT row_number() OVER (ORDER BY n_nationkey) - 1 AS k, n_name FROM nation), c AS (SELECT 0::BIGINT AS seq, '' AS link, n_name AS payload, sha256(chr(10) || '0' || chr(10) || n_name) AS digest FROM n WHERE k = 0 UNION ALL SELECT k, digest, n_name, sha256(digest || chr(10) || k || chr(10) || n_name) FROM c JOIN n ON k = seq + 1) SELECT * FROM c",
    "kept_symbols": "WITH p AS (SELECT p_partkey AS id, CASE WHEN p_size <> 50 THEN p_brand END AS source FROM part) SELECT * FROM p WHERE source IS NULL OR source NOT IN (SELECT source FROM p WHERE id % 400 = 0 AND source IS NOT NULL)",
    "named_nodes": f"WITH {NODES_SQL} SELECT id, 'kind' AS by FROM nodes WHERE kind = 'supplier' UNION ALL SELECT id, 'name' FROM nodes WHERE name = 'red widget'",
    "gated_findings": "WITH f AS (SELECT p_partkey AS finding_id, 'R' || (p_size % 5) AS rule_id, 'src/' || CASE WHEN p_size > 40 THEN 'gen' ELSE 'app' END || '/' || p_brand || '.java' AS path FROM part), s(place, r, p) AS (VALUES (1, 'R1', 'src/app/Brand#7.java'), (2, NULL, 'src/app/Brand#3.java'), (3, 'R2', NULL), (4, 'R1', NULL)), g AS (SELECT f.*, (SELECT min(place) FROM s WHERE (r IS NULL OR r = rule_id) AND (p IS NULL OR p = path)) AS first FROM f), h AS (SELECT *, CASE WHEN rule_id = 'R4' THEN 'disabled' WHEN path LIKE 'src/gen/%' THEN 'outside' WHEN first IS NOT NULL THEN 'suppressed' ELSE 'kept' END AS state FROM g) SELECT finding_id, rule_id, path, state, CASE WHEN state = 'suppressed' THEN first END AS suppression FROM h",
    "rule_cases": "SELECT 'large' AS rule_id, count(*) FILTER (p_size > 45) AS found, count(*) FILTER (p_size = 45) AS missing, 0 AS unexpected, count(*) FILTER (p_size = 45) = 0 AS passed FROM part UNION ALL SELECT 'red', count(*) FILTER (starts_with(p_name, 'red')), 0, 0, true FROM part",
    "routes_matched": "SELECT o_orderkey AS request, p_partkey AS endpoint FROM orders JOIN part ON p_partkey = o_custkey",
    "repository_report": f"WITH {NODES_SQL} SELECT 'documents' AS section, coalesce(doc_kind, 'none') AS item, count(*) AS rows FROM documents GROUP BY 2 UNION ALL SELECT 'projects of documents', coalesce(project, 'none'), count(*) FROM documents GROUP BY 2 UNION ALL SELECT 'runs', coalesce(status, 'none'), count(*) FROM project_runs GROUP BY 2 UNION ALL SELECT 'subjects', coalesce(language, 'none'), count(*) FROM risk_hotspots GROUP BY 2 UNION ALL SELECT 'nodes', kind, count(*) FROM nodes GROUP BY 2",
}
