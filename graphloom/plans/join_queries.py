"""Diffs, resolution joins and search on the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.operators import diffs as D
from graphloom.operators import lookups as L
from graphloom.operators import search as S
from graphloom.operators.interpreter import interpret
from graphloom.plans.adapters import FILES_SQL, NODES_SQL, edges, files, nodes
from graphloom.sources.tables import table


def evolution_nodes(spark: SparkSession, folder: str) -> DataFrame:
    part = table(spark, folder, "part")
    base = part.where("p_size <= 40").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_brand").alias("kind"))
    head = part.where("p_size >= 10").select(F.col("p_partkey").alias("id"), F.when(F.col("p_brand") == "Brand#7", F.upper("p_name")).otherwise(F.col("p_name")).alias("name"), F.col("p_brand").alias("kind"))
    return D.keyed_diff(base, head, ["id"], ["name", "kind"])


def evolution_relations(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "lineitem").select(F.col("l_suppkey").alias("source"), F.col("l_partkey").alias("target"), F.lit("provides").alias("relation"), F.array("l_returnflag").alias("evidence"), "l_linenumber")
    return D.relation_diff(rows.where("l_linenumber <= 5"), rows.where("l_linenumber >= 3"))


def file_changes(spark: SparkSession, folder: str) -> DataFrame:
    every = files(spark, folder).where("path is not null").groupBy("path").agg(F.max("sha256").alias("sha256"), F.max("kind").alias("kind"), F.max("size").alias("size"))
    head = every.where("kind <> 'runbook'").withColumn("sha256", F.when(F.col("size") > 1000, F.lit("edited")).otherwise(F.col("sha256")))
    return D.file_diff(every.where("kind <> 'adr'"), head)


def file_renames(spark: SparkSession, folder: str) -> DataFrame:
    every = files(spark, folder).where("path is not null").groupBy("path").agg(F.max("sha256").alias("sha256"), F.max("kind").alias("kind"))
    head = every.withColumn("path", F.when(F.col("kind") == "adr", F.concat(F.lit("moved/"), "path")).otherwise(F.col("path")))
    return D.renamed_files(every, head)


def _findings(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "lineitem").select(F.col("l_suppkey").alias("project"), F.col("l_returnflag").alias("rule"), F.concat(F.lit("src\\"), F.col("l_partkey")).alias("path"), F.col("l_linenumber").alias("line"))
    none = F.lit(None).cast("string")
    return rows.distinct().withColumn("fingerprint", D.finding_fingerprint(F.col("project").cast("string"), none, F.col("rule"), F.col("path"), F.col("line"), none, none))


def baseline_findings(spark: SparkSession, folder: str) -> DataFrame:
    found = _findings(spark, folder)
    return D.new_findings(found, found.where("rule = 'N'")).select("project", "rule", "path", "line", "fingerprint")


def changed_line_findings(spark: SparkSession, folder: str) -> DataFrame:
    found = _findings(spark, folder)
    return D.on_changed_lines(found, found.where("rule = 'R'")).select("project", "rule", "path", "line", "fingerprint")


def architecture_changes(spark: SparkSession, folder: str) -> DataFrame:
    nation, customer = table(spark, folder, "nation"), table(spark, folder, "customer")
    segments = customer.select(F.col("c_nationkey").cast("string").alias("item"), F.col("c_mktsegment").alias("value"))
    names = nation.select(F.col("n_nationkey").cast("string").alias("item"), F.col("n_name").alias("value"))
    one = D.set_changes(segments.where("value <> 'BUILDING'"), segments.where("value <> 'MACHINERY'"), "edges")
    return one.unionByName(D.set_changes(names.where("value <> 'NATION_3'"), names.where("value <> 'NATION_4'"), "nodes"))


def path_projects(spark: SparkSession, folder: str) -> DataFrame:
    paths = table(spark, folder, "documents").where("doc_path is not null").select(F.col("doc_path").alias("path"), "project", "doc_kind")
    roots = paths.where("doc_kind in ('readme', 'adr')").select(F.concat(F.lit("docs/"), "doc_kind").alias("root"), F.col("doc_kind").alias("project")).distinct()
    return L.owning_projects(paths, roots.unionByName(spark.createDataFrame([("docs", "all"), (".", "root"), ("docs/adr", "second")], "root string, project string")))


def bean_resolution(spark: SparkSession, folder: str) -> DataFrame:
    supplier, customer = table(spark, folder, "supplier"), table(spark, folder, "customer")
    beans = supplier.select(F.col("s_nationkey").alias("type"), F.col("s_suppkey").alias("target"), (F.col("s_acctbal") > 9000).alias("primary"), F.substring("s_name", -2, 2).alias("name"))
    wanted = customer.select(F.col("c_custkey").alias("injection"), F.col("c_nationkey").alias("type"), F.substring("c_name", -2, 2).alias("name"))
    typed = wanted.join(beans.drop("name"), "type")
    single = typed.groupBy("injection").agg(F.count("*").alias("n")).where("n = 1")
    stages = typed.join(single, "injection", "left_semi").select("injection", F.lit(1).alias("stage"), "target")
    stages = stages.unionByName(typed.where("primary").select("injection", F.lit(2).alias("stage"), "target"))
    stages = stages.unionByName(wanted.join(beans, ["type", "name"]).select("injection", F.lit(3).alias("stage"), "target"))
    return L.resolve_staged(wanted, stages, "injection")


def nearest_definitions(spark: SparkSession, folder: str) -> DataFrame:
    supplier, nation = table(spark, folder, "supplier"), table(spark, folder, "nation")
    up = supplier.select(F.concat(F.lit("s"), "s_suppkey").alias("source"), F.concat(F.lit("n"), "s_nationkey").alias("target")).unionByName(nation.select(F.concat(F.lit("n"), "n_nationkey").alias("source"), F.concat(F.lit("r"), "n_regionkey").alias("target")))
    methods = spark.createDataFrame([("load",), ("save",)], "method string")
    defined = table(spark, folder, "region").select(F.concat(F.lit("r"), "r_regionkey").alias("type"), F.lit("load").alias("method")).unionByName(nation.where("n_regionkey in (1, 3)").select(F.concat(F.lit("n"), "n_nationkey").alias("type"), F.lit("load").alias("method"))).unionByName(supplier.where("s_acctbal < 0").select(F.concat(F.lit("s"), "s_suppkey").alias("type"), F.lit("save").alias("method")))
    return L.nearest_definitions(supplier.select(F.concat(F.lit("s"), "s_suppkey").alias("type")).join(F.broadcast(methods)), up, defined)


def argument_flow(spark: SparkSession, folder: str) -> DataFrame:
    lineitem = table(spark, folder, "lineitem")
    calls = lineitem.groupBy(F.col("l_orderkey").alias("call_id"), F.col("l_suppkey").alias("callee")).agg(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey"))), lambda x: x["l_partkey"]).alias("arguments"))
    parameters = table(spark, folder, "supplier").select(F.col("s_suppkey").alias("method"), F.array(F.lit("first"), F.lit("second")).alias("parameters"))
    return L.argument_flow(calls, parameters)


RULES = (("widgets", "suffix", "widget"), ("red", "prefix", "red "), ("any", "contains", " "))


def first_rules(spark: SparkSession, folder: str) -> DataFrame:
    return L.first_matching_rule(table(spark, folder, "part"), RULES, "p_name").select("p_partkey", "rule")


def globbed_files(spark: SparkSession, folder: str) -> DataFrame:
    return L.globbed(files(spark, folder).select("id", "path"), ["docs/*/*.md"], ["**/amber-*", "docs/adr/**"])


def forbidden_links(spark: SparkSession, folder: str) -> DataFrame:
    customer, orders, lineitem = table(spark, folder, "customer"), table(spark, folder, "orders"), table(spark, folder, "lineitem")
    bought = orders.join(lineitem.select(F.col("l_orderkey").alias("o_orderkey"), "l_partkey"), "o_orderkey").select(F.concat(F.lit("c"), "o_custkey").alias("source"), F.concat(F.lit("p"), "l_partkey").alias("target"))
    layers = customer.select(F.concat(F.lit("c"), "c_custkey").alias("id"), F.col("c_mktsegment").alias("layer")).unionByName(table(spark, folder, "part").select(F.concat(F.lit("p"), "p_partkey").alias("id"), F.col("p_type").alias("layer")))
    return L.forbidden_links(bought, layers, [("BUILDING", "SMALL"), ("MACHINERY", "ECONOMY")])


def latest_turns(spark: SparkSession, folder: str) -> DataFrame:
    turns = table(spark, folder, "conversation_turns")
    return L.latest_by(turns, ["id"], F.col("updated_at"), ["status", "provider"]).groupBy("status", "provider").agg(F.count("*").alias("turns"))


def layered_settings(spark: SparkSession, folder: str) -> DataFrame:
    events = table(spark, folder, "events")
    return L.layered_settings(events.select(F.col("event_type").alias("layer"), F.col("event_id").alias("rank"), F.col("user_id").alias("key"), F.col("props").alias("value")))


def overlapping_edits(spark: SparkSession, folder: str) -> DataFrame:
    lineitem = table(spark, folder, "lineitem")
    return L.overlapping_edits(lineitem.select(F.col("l_orderkey").alias("path"), F.col("l_partkey").alias("start"), (F.col("l_partkey") + F.col("l_quantity").cast("bigint") * 4).alias("stop")).distinct())


QUESTION = 'scheduler cache "owner map" release adr'


def _documents(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").select(F.col("doc_id").alias("id"), F.col("doc_path").alias("path"), F.col("text").alias("content"))


def document_search(spark: SparkSession, folder: str) -> DataFrame:
    return S.document_scores(_documents(spark, folder), QUESTION)


def symbol_search(spark: SparkSession, folder: str) -> DataFrame:
    symbols = nodes(spark, folder).withColumn("qualified_name", F.concat_ws(".", "kind", "name"))
    return S.symbol_search(symbols, " Red widget ", ["part", "supplier"])


def symbol_search_top(spark: SparkSession, folder: str) -> DataFrame:
    symbols = nodes(spark, folder).withColumn("qualified_name", F.concat_ws(".", "kind", "name"))
    return S.symbol_search(symbols, "nation", limit=10)


def node_search(spark: SparkSession, folder: str) -> DataFrame:
    rows = nodes(spark, folder).withColumn("facets", F.array("kind"))
    return S.node_search(rows, "nation 7", 30)


def relational_search(spark: SparkSession, folder: str) -> DataFrame:
    empty = spark.createDataFrame([], "id string, concept string")
    return S.search_by_plan(interpret("depends on red widget"), nodes(spark, folder), edges(spark, folder), empty)


def scoped_search(spark: SparkSession, folder: str) -> DataFrame:
    """Customers as services, nations as projects: services that use a part, in one project."""
    every = nodes(spark, folder).withColumn("kind", F.when(F.col("kind") == "nation", "project").otherwise(F.col("kind")))
    concepts = every.where("kind = 'customer'").select("id", F.lit("service").alias("concept"))
    return S.search_by_plan(interpret("services using red widget in project NATION_7"), every, edges(spark, folder), concepts)


def bounded_search(spark: SparkSession, folder: str) -> DataFrame:
    """The first 2,000 subjects of a relation, and how many are left out."""
    empty = spark.createDataFrame([], "id string, concept string")
    return S.search_by_plan(interpret("depends on red widget"), nodes(spark, folder), edges(spark, folder), empty, 2000)


def postings_any(spark: SparkSession, folder: str) -> DataFrame:
    index = S.postings(table(spark, folder, "part").select(F.col("p_partkey").alias("id"), F.concat_ws(" ", "p_name", "p_type").alias("text")))
    return S.any_term(index, ["red", "widget", "small"])


def postings_all(spark: SparkSession, folder: str) -> DataFrame:
    index = S.postings(table(spark, folder, "part").select(F.col("p_partkey").alias("id"), F.concat_ws(" ", "p_name", "p_type").alias("text")))
    return S.all_terms(index, ["red", "widget"])


def hit_scores(spark: SparkSession, folder: str) -> DataFrame:
    part = table(spark, folder, "part")
    parts = {"identity": F.when(F.col("p_name").startswith("red"), 1.0), "lexical": F.round(F.col("p_size") / 50, 2), "intent": F.when(F.col("p_type") == "SMALL", 0.5), "graph": F.when(F.col("p_brand") == "Brand#7", 1.0).otherwise(0.0), "evidence": F.when(F.col("p_size") > 25, 1.0)}
    return part.select("p_partkey", S.hit_score(parts, F.col("p_name") == "red widget", F.col("p_size") > 25).alias("score"))


def bounded_context(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").where("project is not null").select("project", "doc_id", S.token_estimate(F.col("text")).alias("tokens"))
    return S.within_budget(docs, "project", [F.col("tokens"), F.col("doc_id")], "tokens", 1500)


def subject_resolution(spark: SparkSession, folder: str) -> DataFrame:
    every = nodes(spark, folder)
    wanted = every.select(F.col("name").alias("text")).unionByName(every.select(F.col("id").alias("text"))).unionByName(every.select(F.concat(F.lit("?"), "id").alias("text"))).distinct()
    stages = wanted.join(every.select(F.col("id").alias("text"), F.lit(1).alias("stage"), F.col("id").alias("target")), "text")
    stages = stages.unionByName(wanted.join(every.select(F.col("name").alias("text"), F.lit(2).alias("stage"), F.col("id").alias("target")), "text"))
    return L.resolve_staged(wanted, stages, "text")


QUERIES = {f.__name__: f for f in (evolution_nodes, evolution_relations, file_changes, file_renames, baseline_findings, changed_line_findings, architecture_changes, path_projects, bean_resolution, nearest_definitions, argument_flow, first_rules, globbed_files, forbidden_links, latest_turns, layered_settings, overlapping_edits, document_search, symbol_search, symbol_search_top, node_search, relational_search, scoped_search, bounded_search, postings_any, postings_all, hit_scores, bounded_context, subject_resolution)}

_STAGED = "first AS (SELECT {key}, min(stage) AS stage FROM c GROUP BY {key}), held AS (SELECT {key}, c.stage, count(DISTINCT target) AS options, min(target) AS target FROM c JOIN first USING ({key}, stage) GROUP BY {key}, c.stage) SELECT {key}, CASE WHEN options IS NULL THEN 'unresolved' WHEN options = 1 THEN 'resolved' ELSE 'ambiguous' END AS status, stage, target, coalesce(options, 0) AS options FROM (SELECT DISTINCT {key} FROM w) LEFT JOIN held USING ({key})"
_STATE = "CASE WHEN o.{k} IS NULL THEN 'added' WHEN n.{k} IS NULL THEN 'removed' WHEN {same} THEN 'unchanged' ELSE 'modified' END AS state"
_FILES = "every AS (SELECT path, max(sha256) AS sha256, max(kind) AS kind, max(size) AS size FROM files WHERE path IS NOT NULL GROUP BY path)"
_FIND = "found AS (SELECT DISTINCT l_suppkey AS project, l_returnflag AS rule, 'src\\' || l_partkey AS path, l_linenumber AS line, sha256(l_suppkey || chr(31) || l_returnflag || chr(31) || 'src/' || l_partkey || chr(31) || l_linenumber || chr(31) || chr(31)) AS fingerprint FROM lineitem)"
_TERMS = "list_distinct(regexp_extract_all(lower({0}), '[a-z0-9_+]+'))"
_POST = f"post AS (SELECT DISTINCT id, unnest(t) AS term FROM (SELECT p_partkey AS id, {_TERMS.format(chr(39) + chr(39) + ' || p_name || chr(32) || p_type')} AS t FROM part))"
SQL = {
    "evolution_nodes": f"WITH o AS (SELECT * FROM part WHERE p_size <= 40), n AS (SELECT p_partkey, CASE WHEN p_brand = 'Brand#7' THEN upper(p_name) ELSE p_name END AS p_name, p_brand FROM part WHERE p_size >= 10) SELECT coalesce(o.p_partkey, n.p_partkey) AS id, {_STATE.format(k='p_partkey', same='o.p_name = n.p_name AND o.p_brand = n.p_brand')} FROM o FULL JOIN n ON o.p_partkey = n.p_partkey",
    "evolution_relations": f"WITH o AS (SELECT l_suppkey AS s, l_partkey AS t, list_sort(list(DISTINCT l_returnflag)) AS e FROM lineitem WHERE l_linenumber <= 5 GROUP BY 1, 2), n AS (SELECT l_suppkey AS s, l_partkey AS t, list_sort(list(DISTINCT l_returnflag)) AS e FROM lineitem WHERE l_linenumber >= 3 GROUP BY 1, 2) SELECT coalesce(o.s, n.s) AS source, coalesce(o.t, n.t) AS target, 'provides' AS relation, {_STATE.format(k='s', same='o.e = n.e')} FROM o FULL JOIN n ON o.s = n.s AND o.t = n.t",
    "file_changes": f"WITH {FILES_SQL}, {_FILES}, o AS (SELECT * FROM every WHERE kind <> 'adr'), n AS (SELECT path, CASE WHEN size > 1000 THEN 'edited' ELSE sha256 END AS sha256 FROM every WHERE kind <> 'runbook') SELECT coalesce(o.path, n.path) AS path, {_STATE.format(k='path', same='o.sha256 = n.sha256')} FROM o FULL JOIN n ON o.path = n.path",
    "file_renames": f"WITH {FILES_SQL}, {_FILES}, o AS (SELECT path, sha256, row_number() OVER (PARTITION BY sha256 ORDER BY path) AS k FROM every WHERE kind = 'adr') SELECT 'moved/' || path AS path, path AS renamed_from FROM o",
    "baseline_findings": f"WITH {_FIND} SELECT * FROM found WHERE rule <> 'N'",
    "changed_line_findings": f"WITH {_FIND} SELECT project, rule, path, line, fingerprint FROM found WHERE (path, line) IN (SELECT (path, line) FROM found WHERE rule = 'R')",
    "architecture_changes": "WITH s AS (SELECT DISTINCT c_nationkey::VARCHAR AS item, c_mktsegment AS value FROM customer), n AS (SELECT n_nationkey::VARCHAR AS item, n_name AS value FROM nation) SELECT item, value, 'added' AS side, 'edges' AS part FROM s WHERE value = 'BUILDING' UNION ALL SELECT item, value, 'removed', 'edges' FROM s WHERE value = 'MACHINERY' UNION ALL SELECT item, value, 'added', 'nodes' FROM n WHERE value = 'NATION_3' UNION ALL SELECT item, value, 'removed', 'nodes' FROM n WHERE value = 'NATION_4'",
    "path_projects": "SELECT DISTINCT doc_path AS path, CASE WHEN doc_path LIKE 'docs/readme/%' THEN 'readme' WHEN doc_path LIKE 'docs/adr/%' THEN NULL WHEN doc_path LIKE 'docs/%' THEN 'all' ELSE 'root' END AS project, CASE WHEN doc_path LIKE 'docs/adr/%' THEN 2 ELSE 1 END::BIGINT AS options FROM documents WHERE doc_path IS NOT NULL",
    "bean_resolution": f"WITH b AS (SELECT s_nationkey AS type, s_suppkey AS target, s_acctbal > 9000 AS main, right(s_name, 2) AS name FROM supplier), w AS (SELECT c_custkey AS injection, c_nationkey AS type, right(c_name, 2) AS name FROM customer), c AS (SELECT injection, 1 AS stage, min(target) AS target FROM w JOIN b USING (type) GROUP BY injection HAVING count(*) = 1 UNION ALL SELECT injection, 2, target FROM w JOIN b USING (type) WHERE main UNION ALL SELECT injection, 3, target FROM w JOIN b USING (type, name)), {_STAGED.format(key='injection')}",
    "nearest_definitions": "SELECT 's' || s_suppkey AS type, 'load' AS method, CASE WHEN n_regionkey IN (1, 3) THEN 'n' || n_nationkey ELSE 'r' || n_regionkey END AS owner, CASE WHEN n_regionkey IN (1, 3) THEN 1 ELSE 2 END AS distance FROM supplier JOIN nation ON s_nationkey = n_nationkey UNION ALL SELECT 's' || s_suppkey, 'save', 's' || s_suppkey, 0 FROM supplier WHERE s_acctbal < 0",
    "argument_flow": "SELECT l_orderkey AS call_id, l_partkey AS actual, CASE k WHEN 1 THEN 'first' ELSE 'second' END AS formal FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_suppkey ORDER BY l_linenumber, l_partkey) AS k FROM lineitem) WHERE k <= 2 AND l_suppkey IN (SELECT s_suppkey FROM supplier)",
    "first_rules": "SELECT p_partkey, CASE WHEN ends_with(p_name, 'widget') THEN 'widgets' WHEN starts_with(p_name, 'red ') THEN 'red' WHEN contains(p_name, ' ') THEN 'any' END AS rule FROM part",
    "globbed_files": "SELECT doc_id AS id, doc_path AS path FROM documents WHERE regexp_full_match(doc_path, 'docs/[^/]*/[^/]*\\.md') AND NOT regexp_full_match(doc_path, '(.*/)?amber-[^/]*') AND NOT doc_path LIKE 'docs/adr/%'",
    "forbidden_links": "SELECT 'c' || c_custkey AS source, 'p' || p_partkey AS target, c_mktsegment AS source_layer, p_type AS target_layer FROM (SELECT DISTINCT o_custkey, l_partkey FROM orders JOIN lineitem ON l_orderkey = o_orderkey) JOIN customer ON c_custkey = o_custkey JOIN part ON p_partkey = l_partkey WHERE NOT (c_mktsegment = 'BUILDING' AND p_type = 'SMALL') AND NOT (c_mktsegment = 'MACHINERY' AND p_type = 'ECONOMY')",
    "latest_turns": "SELECT status, provider, count(*) AS turns FROM (SELECT id, max((updated_at, status, provider)) AS m, unnest(m) AS u FROM (SELECT id, {'a': updated_at, 'status': status, 'provider': provider} AS s FROM conversation_turns) GROUP BY id) GROUP BY 1, 2",
    "layered_settings": "SELECT user_id AS key, arg_max(props, event_id) AS value, arg_max(event_type, event_id) AS layer FROM events GROUP BY user_id",
    "overlapping_edits": "SELECT path, start, stop FROM (SELECT *, max(stop) OVER (PARTITION BY path ORDER BY start, stop ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM (SELECT DISTINCT l_orderkey AS path, l_partkey AS start, l_partkey + l_quantity::BIGINT * 4 AS stop FROM lineitem)) WHERE start < b",
    "document_search": "WITH d AS (SELECT doc_id AS id, regexp_replace(regexp_extract(coalesce(doc_path, ''), '([^/]*)$', 1), '(.)\\.[^.]*$', '\\1') AS stem, list_transform(regexp_split_to_array(coalesce(text, ''), '\\r\\n|\\n|\\r'), lambda x: trim(x)) AS lines, coalesce(text, '') AS text FROM documents), "
    "t AS (SELECT id, ['scheduler', 'cache', 'owner', 'map', 'release', 'adr'] AS q, " + _TERMS.format("stem") + " AS f, " + _TERMS.format("coalesce(list_filter(lines, lambda x: starts_with(x, '# '))[1], '')") + " AS h1, " + _TERMS.format("array_to_string(list_filter(lines, lambda x: starts_with(x, '#')), ' ')") + " AS h, " + _TERMS.format("text") + " AS b, array_to_string(regexp_extract_all(lower(stem), '[a-z0-9_+]+'), ' ') AS p1, array_to_string(regexp_extract_all(lower(text), '[a-z0-9_+]+'), ' ') AS p2 FROM d) "
    "SELECT * FROM (SELECT id, (5 * len(list_intersect(q, f)) + 4 * len(list_intersect(q, h1)) + 3 * len(list_intersect(q, h)) + len(list_intersect(q, b)) + CASE WHEN contains(p1, 'owner map') OR contains(p2, 'owner map') THEN 6 ELSE 0 END)::INT AS score FROM t) WHERE score > 0",
    "symbol_search": f"WITH {NODES_SQL} SELECT id, CASE WHEN lower(name) = 'red widget' THEN 100 WHEN starts_with(lower(name), 'red widget') THEN 70 ELSE 50 END AS score, CASE WHEN lower(name) = 'red widget' THEN 'exact-name' WHEN starts_with(lower(name), 'red widget') THEN 'name-prefix' ELSE 'name-contains' END AS reason FROM nodes WHERE kind IN ('part', 'supplier') AND contains(lower(name), 'red widget')",
    "symbol_search_top": f"WITH {NODES_SQL} SELECT id, CASE WHEN starts_with(lower(name), 'nation') THEN 70 WHEN contains(lower(name), 'nation') THEN 50 ELSE 30 END AS score, CASE WHEN starts_with(lower(name), 'nation') THEN 'name-prefix' WHEN contains(lower(name), 'nation') THEN 'name-contains' ELSE 'qualified-name-contains' END AS reason FROM nodes WHERE contains(kind || '.' || lower(name), 'nation') ORDER BY score DESC, kind || '.' || name, kind, id LIMIT 10",
    "node_search": f"WITH {NODES_SQL}, s AS (SELECT id, round(CASE WHEN lower(id) = 'nation 7' OR lower(name) = 'nation 7' THEN 100 WHEN contains(lower(id), 'nation 7') OR contains(lower(name), 'nation 7') THEN 45 ELSE 0 END + CASE WHEN 'nation' IN (lower(id), lower(name)) THEN 35 WHEN contains(lower(id), 'nation') OR contains(lower(name), 'nation') THEN 12 ELSE 0 END + CASE WHEN contains(kind, 'nation') THEN 8 ELSE 0 END + CASE WHEN '7' IN (lower(id), lower(name)) THEN 35 WHEN contains(lower(id), '7') OR contains(lower(name), '7') THEN 12 ELSE 0 END + CASE WHEN contains(kind, '7') THEN 8 ELSE 0 END, 1)::DOUBLE AS score FROM nodes) SELECT * FROM s WHERE score > 0 ORDER BY score DESC, lower(id), id LIMIT 30",
    "relational_search": "SELECT DISTINCT 'customer:' || o_custkey AS id, 'depends_on' AS why, 0 AS omitted FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey WHERE p_name = 'red widget'",
    "bounded_search": "WITH f AS (SELECT DISTINCT 'customer:' || o_custkey AS id FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey WHERE p_name = 'red widget') SELECT id, 'depends_on' AS why, greatest((SELECT count(*) FROM f) - 2000, 0) AS omitted FROM f ORDER BY id LIMIT 2000",
    "scoped_search": "SELECT DISTINCT 'customer:' || o_custkey AS id, 'concept' AS why, 0 AS omitted FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey JOIN customer ON c_custkey = o_custkey WHERE p_name = 'red widget' AND c_nationkey = 7",
    "postings_any": f"WITH {_POST} SELECT id, count(DISTINCT term) AS matched, 0 AS omitted FROM post WHERE term IN ('red', 'widget', 'small') GROUP BY id",
    "postings_all": f"WITH {_POST} SELECT id FROM post WHERE term IN ('red', 'widget') GROUP BY id HAVING count(DISTINCT term) = 2",
    "hit_scores": "WITH v AS (SELECT p_partkey, p_name = 'red widget' AS exact, p_size > 25 AS ev, CASE WHEN starts_with(p_name, 'red') THEN 1.0::DOUBLE END AS a, round(p_size / 50, 2) AS b, CASE WHEN p_type = 'SMALL' THEN 0.5::DOUBLE END AS c, CASE WHEN p_brand = 'Brand#7' THEN 1.0::DOUBLE ELSE 0 END AS d, CASE WHEN p_size > 25 THEN 1.0::DOUBLE END AS e FROM part), w AS (SELECT *, coalesce(a * 0.35::DOUBLE, 0) + b * 0.25::DOUBLE + coalesce(c * 0.15::DOUBLE, 0) + d * 0.15::DOUBLE + coalesce(e * 0.1::DOUBLE, 0) AS t, CASE WHEN a IS NULL THEN 0 ELSE 0.35::DOUBLE END + 0.25::DOUBLE + CASE WHEN c IS NULL THEN 0 ELSE 0.15::DOUBLE END + 0.15::DOUBLE + CASE WHEN e IS NULL THEN 0 ELSE 0.1::DOUBLE END AS w FROM v) SELECT p_partkey, round(CASE WHEN ev OR exact THEN t / w ELSE t / w * 0.39::DOUBLE END, 6) AS score FROM w",
    "bounded_context": "SELECT * FROM (SELECT project, doc_id, tokens, sum(tokens) OVER (PARTITION BY project ORDER BY tokens, doc_id ROWS UNBOUNDED PRECEDING)::BIGINT AS used FROM (SELECT project, doc_id, ceil(coalesce(length(text), 0) / 4)::BIGINT AS tokens FROM documents WHERE project IS NOT NULL)) WHERE used <= 1500",
    "subject_resolution": f"WITH {NODES_SQL}, w AS (SELECT name AS text FROM nodes UNION SELECT id FROM nodes UNION SELECT '?' || id FROM nodes), c AS (SELECT id AS text, 1 AS stage, id AS target FROM nodes UNION ALL SELECT name, 2, id FROM nodes), {_STAGED.format(key='text')}",
}
SQL["latest_turns"] = "SELECT m.status AS status, m.provider AS provider, count(*) AS turns FROM (SELECT id, max({'a': updated_at, 'status': status, 'provider': provider}) AS m FROM conversation_turns GROUP BY id) GROUP BY 1, 2"
