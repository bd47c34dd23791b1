"""The knowledge graph, its index, searches with their ways, value flow and plans on the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.operators import knowledge as K
from graphloom.operators import security as X
from graphloom.operators import traversal as V
from graphloom.operators.graph import cycles_supported, simple_cycles
from graphloom.plans.adapters import EDGES_SQL, NODES_SQL, TRADE_SQL, edges, nodes, projects, trade
from graphloom.session import checkpoint
from graphloom.sources.tables import table


def _symbols(spark: SparkSession, folder: str) -> DataFrame:
    """Scored subjects as symbols: ``type:Cache.00000012`` has the simple name ``cache``."""
    rows = table(spark, folder, "risk_hotspots").where("subject_id is not null").select(F.lower("subject_id").alias("id"), F.lower("kind").alias("kind"), "project").distinct()
    return rows.withColumn("qualified_name", F.substring_index("id", ":", -1)).withColumn("name", F.substring_index("qualified_name", ".", 1))


_SYMBOLS = "sy AS MATERIALIZED (SELECT DISTINCT lower(subject_id) AS id, lower(kind) AS kind, project, split_part(lower(subject_id), ':', -1) AS qualified_name, split_part(split_part(lower(subject_id), ':', -1), '.', 1) AS name FROM risk_hotspots WHERE subject_id IS NOT NULL)"


def _dependencies(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "ask_log").select("project", F.col("model").alias("name")).distinct()


def _links(spark: SparkSession, folder: str) -> DataFrame:
    runs = table(spark, folder, "project_runs", ["project", "blocked_by_json"])
    blocked = runs.select(F.concat(F.lit("project:"), "project").alias("source"), F.explode(F.from_json("blocked_by_json", "array<string>")).alias("b"))
    asked = table(spark, folder, "ask_log").select(F.concat(F.lit("project:"), "project").alias("source"), F.lower("subject").alias("target"), F.lit("depends_on").alias("relation"), F.lit("uses").alias("evidence"))
    return blocked.select("source", F.concat(F.lit("project:"), "b").alias("target"), F.lit("depends_on").alias("relation"), F.lit("workspace.projects:blocked_by").alias("evidence")).unionByName(asked)


def _graph_nodes(spark: SparkSession, folder: str) -> DataFrame:
    named = table(spark, folder, "project_runs", ["project"]).select(F.col("project").alias("name"))
    return K.graph_nodes(named, _symbols(spark, folder), _dependencies(spark, folder))


def knowledge_nodes(spark: SparkSession, folder: str) -> DataFrame:
    return _graph_nodes(spark, folder)


def knowledge_edges(spark: SparkSession, folder: str) -> DataFrame:
    found = K.graph_edges(_symbols(spark, folder), _dependencies(spark, folder), _links(spark, folder))
    return found.select("source", "target", "relation", F.array_join("evidence", ",").alias("evidence"))


_KG = (
    _SYMBOLS + ", de AS (SELECT DISTINCT project, model AS name FROM ask_log), kn AS MATERIALIZED (SELECT DISTINCT 'project:' || project AS id, 'project' AS kind, project AS name, project FROM project_runs WHERE project IS NOT NULL"
    " UNION ALL SELECT id, min(kind), min(name), min(project) FROM sy GROUP BY id UNION ALL SELECT DISTINCT 'dependency:' || name, 'dependency', name, NULL FROM de WHERE name IS NOT NULL)"
)


def symbol_lookup(spark: SparkSession, folder: str) -> DataFrame:
    """The asked subjects, their qualified and their simple names, and the projects."""
    asked = table(spark, folder, "ask_log").select("subject", "project").distinct()
    names = F.array("subject", F.substring_index("subject", ":", -1), F.substring_index(F.substring_index("subject", ":", -1), ".", 1), "project")
    return K.first_symbols(asked.select(F.explode(names).alias("term")).where("term is not null").distinct(), _symbols(spark, folder))


def index_postings(spark: SparkSession, folder: str) -> DataFrame:
    return K.index_postings(_graph_nodes(spark, folder)).groupBy("term").agg(F.count("*").alias("entries"), F.min("id").alias("first"))


CONCEPTS = {"caching": ("cache", "cache module"), "routing": ("route", "router"), "billing": ("billing", "store billing"), "core": ("platform core",)}


def index_concepts(spark: SparkSession, folder: str) -> DataFrame:
    return K.index_concepts(K.index_postings(_graph_nodes(spark, folder)), CONCEPTS)


def index_candidates(spark: SparkSession, folder: str) -> DataFrame:
    """Modules and types of the shared project with some of the words and the concept."""
    every = _graph_nodes(spark, folder)
    words = checkpoint(K.index_postings(every))
    return K.candidates(every, words, K.index_concepts(words, CONCEPTS), ["cache", "module", "trace"], ["core"], ["module", "type"], ["platform-core"])


_POSTED = _KG + ", po AS MATERIALIZED (SELECT DISTINCT id, unnest(regexp_extract_all(lower(replace(regexp_replace(concat_ws(' ', name, kind, project), '([a-z0-9])([A-Z])', '\\1 \\2', 'g'), '_', ' ')), '[a-z0-9_+]+')) AS term FROM kn)"
_PHRASES = ", ".join(f"('{c}', '{p}', {len(set(p.split()))}, '{w}')" for c, ps in CONCEPTS.items() for p in ps for w in sorted(set(p.split())))
_HELD = f"{_POSTED}, ph(concept, phrase, size, term) AS (VALUES {_PHRASES}), hp AS (SELECT concept, phrase, id FROM po JOIN ph USING (term) GROUP BY concept, phrase, size, id HAVING count(DISTINCT term) = size), co AS (SELECT concept, id, round(least(1.0, 0.6 + 0.1 * (count(*) - 1)), 4)::DOUBLE AS confidence FROM hp GROUP BY concept, id)"


def architecture_styles(spark: SparkSession, folder: str) -> DataFrame:
    """Words of each project's documents; projects with a link between them and another are related."""
    docs = table(spark, folder, "documents", ["project", "text"]).where("project is not null")
    tokens = docs.select(F.col("project").alias("scope"), F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), 0))).alias("term"))
    related = table(spark, folder, "ask_log").where("subject is not null").select(F.col("project").alias("scope"))
    return K.architectures(tokens, related, K.ARCHITECTURES | {"pipeline": ((("snapshot", "index"), ("importer", "parser"), ("report", "writer"), ("cache",)), 2, 0.5)})


def reach_traversal(spark: SparkSession, folder: str) -> DataFrame:
    """From all projects of the first area over the project graph, with predecessor and path."""
    roots = projects(spark, folder).where("area = 0").select("id", F.col("name").alias("category"))
    return V.traverse(trade(spark, folder), roots).select("node", "depth", "root", "predecessor", F.size("path").alias("steps"), F.col("path")[0].alias("first"))


def reach_relations(spark: SparkSession, folder: str) -> DataFrame:
    """Methods call the first method of their simple name, and methods and fields are members of the first type of it."""
    rows = _symbols(spark, folder).where("project is not null")
    first = rows.where("kind in ('method', 'type')").groupBy("kind", "name").agg(F.min("id").alias("target"))
    calls = rows.where("kind = 'method'").select("name", F.col("id").alias("source")).join(first.where("kind = 'method'"), "name").select("source", "target", F.lit("calls").alias("relation"))
    members = rows.where("kind in ('method', 'field')").select("name", F.col("id").alias("source")).join(first.where("kind = 'type'"), "name").select("source", "target", F.lit("member_of").alias("relation"))
    lost = rows.where("kind = 'field'").select(F.col("id").alias("source"), F.lit("method:none").alias("target"), F.lit("calls").alias("relation"))
    return V.reach_relations(calls.unionByName(members).unionByName(lost), rows)


def owner_levels(spark: SparkSession, folder: str) -> DataFrame:
    members = edges(spark, folder).where("relation = 'member_of'")
    subjects = nodes(spark, folder).where("kind in ('customer', 'supplier')").select("id")
    return V.owners(members, nodes(spark, folder), subjects, ["nation", "region"])


def impact_plans(spark: SparkSession, folder: str) -> DataFrame:
    """Lines as plans for a supplier's part: the cheapest stays, and the dearest fifty of those come out."""
    plans = table(spark, folder, "lineitem").select(F.col("l_suppkey").alias("subject"), F.col("l_partkey").alias("target"), F.col("l_extendedprice").alias("score"), F.col("l_orderkey").alias("via"))
    return V.top_plans(plans, ["subject", "target"], [F.col("score").desc(), F.col("subject"), F.col("target")], ["score", "via"], 50)


def refactoring_seams(spark: SparkSession, folder: str) -> DataFrame:
    links = checkpoint(trade(spark, folder))
    return V.cycle_seams(cycles_supported(simple_cycles(links, 4), links))


def _flow(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Orders as methods and their lines as values: some lines flow into the next one, and each into the same line of the
    customer's next order."""
    lines = table(spark, folder, "lineitem").select(F.col("l_orderkey").alias("method"), F.col("l_linenumber").alias("k"), "l_suppkey", "l_partkey").groupBy("method", "k").agg(F.min("l_suppkey").alias("s"), F.min("l_partkey").alias("p"))
    orders = table(spark, folder, "orders").select(F.col("o_custkey").alias("customer"), F.col("o_orderkey").alias("caller"))
    following = orders.join(orders.select("customer", F.col("caller").alias("callee")), "customer").where("callee > caller").groupBy("caller").agg(F.min("callee").alias("callee"))
    inner = lines.where("s % 2 = 0").select("method", F.col("k").alias("source"), (F.col("k") + 1).alias("target"))
    inner = inner.join(lines.select("method", F.col("k").alias("target")), ["method", "target"], "left_semi")
    into = lines.select(F.col("method").alias("caller"), F.col("k").alias("argument")).join(following, "caller").join(lines.select(F.col("method").alias("callee"), F.col("k").alias("parameter")), "callee").where("argument = parameter")
    back = spark.createDataFrame([], "caller long, result int, callee long, value int")
    return V.value_flow(inner, into, back), lines.select(F.concat_ws("#", "method", "k").alias("id"), "s", "p")


def method_taint(spark: SparkSession, folder: str) -> DataFrame:
    flow, values = _flow(spark, folder)
    return V.tainted_sinks(flow, values.where("p % 50 = 1").select("id"), values.where("p % 10 = 3").select("id"), values.where("s % 4 = 0").select("id"))


RULES = (("*", "sink", "click"), ("runbook", "source", "user.view"), ("adr", "sink", "purchase"), ("readme", "sanitizer", "error"))


def framework_taint_rules(spark: SparkSession, folder: str) -> DataFrame:
    found = table(spark, folder, "documents").select("project", F.col("doc_kind").alias("framework"))
    return V.framework_rules(found, spark.createDataFrame(list(RULES), "framework string, role string, suffix string"))


def call_rules(spark: SparkSession, folder: str) -> DataFrame:
    calls = table(spark, folder, "events").select(F.col("event_id").alias("call_id"), F.concat(F.lit("api.user"), F.col("user_id") % 3, F.lit("."), "event_type").alias("name"))
    return V.suffix_hits(calls, spark.createDataFrame([("R1", "click"), ("R2", "user1.error"), ("R3", "ick"), ("R4", "api.user2.view")], "rule_id string, suffix string"))


def _found(spark: SparkSession, folder: str) -> DataFrame:
    score = F.when(~F.isnan("score"), F.col("score"))
    level = F.when(score > 0.8, "critical").when(score > 0.6, "high").when(score > 0.3, "medium").otherwise("low")
    return table(spark, folder, "risk_hotspots").select("project", F.lower("subject_id").alias("symbol"), F.lower("kind").alias("category"), level.alias("severity"), "language").distinct()


def security_scope(spark: SparkSession, folder: str) -> DataFrame:
    return X.in_scope(_found(spark, folder), projects=["platform-core"], categories=["type", "method"], severities=["critical", "high", "low"], languages=["java", "kotlin"])


def retained_findings(spark: SparkSession, folder: str) -> DataFrame:
    order = [F.col(c).asc_nulls_last() for c in ("severity", "symbol", "project", "category", "language")]
    return X.retained(_found(spark, folder), order, 100).select("severity", "symbol", "project", "total", "omitted")


def safe_texts(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents", ["doc_id", "text"])
    return docs.select("doc_id", X.has_absolute_path(F.col("text")).alias("absolute"), X.is_source_shaped(F.col("text")).alias("source_shaped"))


def reuse_plan(spark: SparkSession, folder: str) -> DataFrame:
    """Projects before and after an edit of all their documents of one kind, over the project graph."""
    known = projects(spark, folder).select("name", F.col("id").alias("project"))
    sized = known.join(table(spark, folder, "documents", ["project", "doc_kind", "text"]).select(F.col("project").alias("name"), "doc_kind", F.length("text").alias("n")), "name", "left")
    before = sized.groupBy("project").agg(F.sum("n").alias("fingerprint"))
    after = sized.groupBy("project").agg(F.sum(F.when(F.col("doc_kind") == "runbook", F.col("n") + 1).otherwise(F.col("n"))).alias("fingerprint"))
    return V.reuse_plan(before, after, trade(spark, folder))


def resume_plan(spark: SparkSession, folder: str) -> DataFrame:
    known = projects(spark, folder).select(F.col("name").alias("project"), F.col("id").alias("task"))
    log = table(spark, folder, "project_runs").join(known, "project").select("task", F.col("analysis_run_id").alias("seq"), F.coalesce(F.col("status") == "succeeded", F.lit(False)).alias("succeeded"), "position").distinct()
    return V.resume_plan(log.where("not succeeded or seq % 2 = 0"), trade(spark, folder), 2)


QUERIES = {f.__name__: f for f in (knowledge_nodes, knowledge_edges, symbol_lookup, index_postings, index_concepts, index_candidates, architecture_styles, reach_traversal, reach_relations, owner_levels, impact_plans, refactoring_seams, method_taint, framework_taint_rules, call_rules, security_scope, retained_findings, safe_texts, reuse_plan, resume_plan)}

_FOUND = "fo AS (SELECT DISTINCT project, lower(subject_id) AS symbol, lower(kind) AS category, CASE WHEN score IS NULL OR isnan(score) THEN 'low' WHEN score > 0.8 THEN 'critical' WHEN score > 0.6 THEN 'high' WHEN score > 0.3 THEN 'medium' ELSE 'low' END AS severity, language FROM risk_hotspots)"
_STYLES = ", ".join(f"('{s}', {g}, '{t}', {least}, {base})" for s, (groups, least, base) in (K.ARCHITECTURES | {"pipeline": ((("snapshot", "index"), ("importer", "parser"), ("report", "writer"), ("cache",)), 2, 0.5)}).items() for g, own in enumerate(groups) for t in own)
_BEHIND = "WITH RECURSIVE {trade}, {start}, walk AS (SELECT id AS node, 0 AS depth FROM hit UNION SELECT t.source, w.depth + 1 FROM walk w JOIN trade t ON t.target = w.node WHERE w.depth < 40), near AS (SELECT node, min(depth) AS depth FROM walk GROUP BY node)"
SQL = {
    "knowledge_nodes": f"WITH {_KG} SELECT * FROM kn",
    "knowledge_edges": f"WITH {_KG}, ev AS (SELECT 'project:' || project AS source, id AS target, 'owns' AS relation, 'semantic_graph.project_id' AS evidence FROM sy WHERE project IS NOT NULL UNION ALL SELECT id, 'project:' || project, 'member_of', 'global_symbol.owner_id' FROM sy WHERE project IS NOT NULL UNION ALL SELECT 'project:' || project, 'dependency:' || name, 'depends_on', 'declared_dependency:' || name FROM de WHERE project IS NOT NULL AND name IS NOT NULL UNION ALL SELECT 'project:' || project, 'project:' || b, 'depends_on', 'workspace.projects:blocked_by' FROM (SELECT project, unnest(from_json(blocked_by_json, '[\"VARCHAR\"]')) AS b FROM project_runs) WHERE project IS NOT NULL UNION ALL SELECT 'project:' || project, lower(subject), 'depends_on', 'uses' FROM ask_log WHERE project IS NOT NULL AND subject IS NOT NULL) SELECT source, target, relation, array_to_string(list_sort(list(DISTINCT evidence)), ',') AS evidence FROM ev GROUP BY 1, 2, 3",
    "symbol_lookup": f"WITH {_SYMBOLS}, w AS (SELECT DISTINCT unnest([subject, split_part(subject, ':', -1), split_part(split_part(subject, ':', -1), '.', 1), project]) AS term FROM ask_log), h AS (SELECT term, 1 AS stage, s.id FROM w JOIN sy s ON lower(s.id) = lower(term) UNION SELECT term, 2, s.id FROM w JOIN sy s ON lower(s.qualified_name) = lower(term) UNION SELECT term, 3, s.id FROM w JOIN sy s ON lower(s.name) = lower(term)), f AS (SELECT term, min(stage) AS stage FROM h GROUP BY term) SELECT w.term, f.stage, min(h.id) AS id, count(DISTINCT h.id) AS options FROM w LEFT JOIN f USING (term) LEFT JOIN h ON h.term = w.term AND h.stage = f.stage WHERE w.term IS NOT NULL GROUP BY w.term, f.stage",
    "index_postings": f"WITH {_POSTED} SELECT term, count(*) AS entries, min(id) AS first FROM po GROUP BY term",
    "index_concepts": f"WITH {_HELD} SELECT * FROM co",
    "index_candidates": f"WITH {_HELD} SELECT id, count(DISTINCT term) AS matched FROM po WHERE term IN ('cache', 'module', 'trace') AND id IN (SELECT id FROM kn WHERE kind IN ('module', 'type') AND project = 'platform-core') AND id IN (SELECT id FROM co WHERE concept = 'core') GROUP BY id",
    "architecture_styles": f"WITH st(style, part, term, least, base) AS (VALUES {_STYLES}), tk AS (SELECT DISTINCT project AS scope, unnest(regexp_extract_all(lower(text), '[a-z]+')) AS term FROM documents WHERE project IS NOT NULL) SELECT scope, style, count(DISTINCT part) AS groups, round(least(0.98, base + 0.06 * (count(DISTINCT part) - least)), 4)::DOUBLE AS confidence FROM tk JOIN st USING (term) WHERE scope IN (SELECT project FROM ask_log WHERE subject IS NOT NULL) GROUP BY scope, style, least, base HAVING count(DISTINCT part) >= least",
    "reach_traversal": f"WITH RECURSIVE {TRADE_SQL}, walk AS (SELECT id AS root, id AS node, 0 AS depth FROM projects WHERE area = 0 UNION SELECT w.root, t.target, w.depth + 1 FROM walk w JOIN trade t ON t.source = w.node WHERE w.depth < 20), near AS (SELECT root, node, min(depth) AS depth FROM walk GROUP BY 1, 2), best AS (SELECT node, min(depth) AS depth FROM near GROUP BY node), own AS MATERIALIZED (SELECT node, depth, min(root) AS root FROM near JOIN best USING (node, depth) GROUP BY 1, 2) SELECT o.node, o.depth, o.root, min(p.node) AS predecessor, o.depth + 1 AS steps, o.root AS first FROM own o LEFT JOIN trade t ON t.target = o.node LEFT JOIN own p ON p.node = t.source AND p.depth = o.depth - 1 AND p.root = o.root GROUP BY 1, 2, 3",
    "reach_relations": f"WITH {_SYMBOLS}, r AS (SELECT * FROM sy WHERE project IS NOT NULL), f AS (SELECT kind, name, min(id) AS target FROM r WHERE kind IN ('method', 'type') GROUP BY 1, 2) SELECT DISTINCT r.id AS source, f.target FROM r JOIN f USING (name) WHERE (r.kind = 'method' AND f.kind = 'method') OR (r.kind IN ('method', 'field') AND f.kind = 'type')",
    "owner_levels": "WITH m AS (SELECT 'customer:' || c_custkey AS id, c_nationkey AS n FROM customer UNION ALL SELECT 'supplier:' || s_suppkey, s_nationkey FROM supplier) SELECT id, 'nation' AS kind, 'nation:' || n AS owner, 1 AS distance FROM m UNION ALL SELECT id, 'region', 'region:' || n_regionkey, 2 FROM m JOIN nation ON n_nationkey = n",
    "impact_plans": "WITH p AS (SELECT l_suppkey AS subject, l_partkey AS target, l_extendedprice AS score, l_orderkey AS via FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_suppkey, l_partkey ORDER BY l_extendedprice, l_orderkey) = 1) SELECT *, greatest((SELECT count(*) FROM p) - 50, 0) AS omitted FROM p ORDER BY score DESC, subject, target LIMIT 50",
    "refactoring_seams": f"WITH RECURSIVE {TRADE_SQL}, walk AS (SELECT [source, target] AS path FROM trade WHERE source < target UNION ALL SELECT list_append(path, target) FROM walk JOIN trade ON source = path[-1] WHERE target > path[1] AND NOT list_contains(path, target) AND len(path) < 4), cy AS (SELECT path FROM walk JOIN trade ON source = path[-1] AND target = path[1]), st AS (SELECT path[i] AS source, path[CASE WHEN i = len(path) THEN 1 ELSE i + 1 END] AS target FROM cy, range(1, 5) t(i) WHERE i <= len(path)) SELECT source, target, count(*) AS cycles, 0 AS omitted FROM st GROUP BY 1, 2",
    "method_taint": "WITH RECURSIVE v AS MATERIALIZED (SELECT l_orderkey AS m, l_linenumber AS k, min(l_suppkey) AS s, min(l_partkey) AS p FROM lineitem GROUP BY 1, 2), nx AS (SELECT o_orderkey AS a, lead(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS b FROM (SELECT DISTINCT o_custkey, o_orderkey FROM orders)), e AS MATERIALIZED (SELECT a.m AS m, a.k AS k, b.m AS m2, b.k AS k2 FROM v a JOIN v b ON b.m = a.m AND b.k = a.k + 1 WHERE a.s % 2 = 0 AND a.s % 4 <> 0 AND b.s % 4 <> 0 UNION ALL SELECT a.m, a.k, b.m, b.k FROM v a JOIN nx ON nx.a = a.m JOIN v b ON b.m = nx.b AND b.k = a.k WHERE a.s % 4 <> 0 AND b.s % 4 <> 0), w AS (SELECT m, k, 0 AS depth FROM v WHERE p % 50 = 1 AND s % 4 <> 0 UNION SELECT e.m2, e.k2, w.depth + 1 FROM w JOIN e ON e.m = w.m AND e.k = w.k) SELECT m || '#' || k AS sink, min(depth) AS depth FROM w JOIN v USING (m, k) WHERE p % 10 = 3 GROUP BY m, k",
    "framework_taint_rules": "WITH r(framework, role, suffix) AS (VALUES " + ", ".join(map(str, RULES)) + "), f AS (SELECT DISTINCT project, doc_kind AS framework FROM documents WHERE project IS NOT NULL AND doc_kind IS NOT NULL UNION SELECT DISTINCT project, '*' FROM documents WHERE project IS NOT NULL AND doc_kind IS NOT NULL) SELECT DISTINCT project, role, suffix FROM f JOIN r USING (framework)",
    "call_rules": "WITH c AS (SELECT event_id AS call_id, 'api.user' || (user_id % 3) || '.' || event_type AS name FROM events), r(rule_id, suffix) AS (VALUES ('R1', 'click'), ('R2', 'user1.error'), ('R3', 'ick'), ('R4', 'api.user2.view')) SELECT DISTINCT call_id, rule_id FROM c JOIN r ON name = suffix OR ends_with(name, '.' || suffix)",
    "security_scope": f"WITH {_FOUND} SELECT * FROM fo WHERE project = 'platform-core' AND category IN ('type', 'method') AND severity IN ('critical', 'high', 'low') AND language IN ('java', 'kotlin')",
    "retained_findings": f"WITH {_FOUND} SELECT severity, symbol, project, (SELECT count(*) FROM fo) AS total, greatest((SELECT count(*) FROM fo) - 100, 0) AS omitted FROM fo ORDER BY severity, symbol, project, category, language LIMIT 100",
    "safe_texts": "SELECT doc_id, coalesce(regexp_matches(text, '(^|[\\s\"''(=])(/[A-Za-z0-9._-]+){2,}|\\b[A-Za-z]:[\\\\/]|(^|\\s)~/'), false) AS absolute, coalesce(regexp_matches(text, '(?m)```|^\\s*(public|private|protected|class|def|function|import|package)\\s+\\S+.*[{:;]\\s*$|^\\s*\\S+.*;\\s*$'), false) AS source_shaped FROM documents",
    "reuse_plan": _BEHIND.format(trade=TRADE_SQL, start="fp AS (SELECT p.id, sum(length(text)) AS old, sum(length(text) + CASE WHEN doc_kind = 'runbook' THEN 1 ELSE 0 END) AS new FROM projects p LEFT JOIN documents d ON d.project = p.name GROUP BY p.id), hit AS (SELECT id FROM fp WHERE old IS DISTINCT FROM new)") + " SELECT id AS project, CASE WHEN depth = 0 THEN 'run' WHEN depth > 0 THEN 'rerun' ELSE 'reuse' END AS action, depth AS distance FROM fp LEFT JOIN near ON node = id",
    "resume_plan": _BEHIND.format(trade=TRADE_SQL, start="lg AS (SELECT DISTINCT p.id AS task, analysis_run_id, position, coalesce(status = 'succeeded', false) AS ok FROM project_runs JOIN projects p ON p.name = project), sa AS (SELECT task, count(*) FILTER (NOT ok) AS attempts, bool_or(ok) AS done FROM lg WHERE NOT ok OR analysis_run_id % 2 = 0 GROUP BY task), hit AS (SELECT task AS id FROM sa WHERE NOT done AND attempts >= 2)") + " SELECT task, attempts, CASE WHEN done THEN 'skip' WHEN attempts >= 2 THEN 'give_up' WHEN depth > 0 THEN 'wait' ELSE 'retry' END AS action FROM sa LEFT JOIN near ON node = task",
}
