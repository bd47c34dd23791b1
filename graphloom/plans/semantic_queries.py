"""Program-fact operators on the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions import versions as V
from graphloom.operators import semantics as P
from graphloom.operators.graph import reachable, strong_components
from graphloom.operators.rules import Rule, RuleRegistry
from graphloom.plans.adapters import TRADE_SQL, projects, trade
from graphloom.session import checkpoint
from graphloom.sources.tables import table


def _nations(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "nation")


def symbol_problems(spark: SparkSession, folder: str) -> DataFrame:
    part = table(spark, folder, "part")
    return P.symbol_problems(part.select((F.col("p_partkey") % 1500).alias("id"), F.when(F.col("p_size") > 40, F.col("p_partkey") + 1000).alias("owner_id")))


def resolved_types(spark: SparkSession, folder: str) -> DataFrame:
    supplier, customer, lineitem = table(spark, folder, "supplier"), table(spark, folder, "customer"), table(spark, folder, "lineitem")
    types = supplier.select(F.concat(F.lit("t"), "s_suppkey").alias("fqn"), F.col("s_nationkey").cast("string").alias("package"), (F.col("s_suppkey") % 30).alias("name"))
    uses = customer.select(F.col("c_custkey").alias("use_id"), F.col("c_custkey").alias("file"), F.col("c_nationkey").cast("string").alias("package"), (F.col("c_custkey") % 40).alias("name"))
    imports = table(spark, folder, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("file")).join(lineitem.where("l_quantity > 45").select("l_orderkey", "l_suppkey"), "l_orderkey").select("file", F.concat(F.lit("t"), "l_suppkey").alias("fqn"))
    return P.resolve_types(uses, types, imports)


def linked_calls(spark: SparkSession, folder: str) -> DataFrame:
    part, orders = table(spark, folder, "part"), table(spark, folder, "orders")
    methods = part.select(F.col("p_partkey").alias("method_id"), F.col("p_brand").alias("owner"), F.col("p_name").alias("name"), (F.col("p_size") % 3).alias("arity"))
    names = part.select("p_partkey", "p_name")
    calls = orders.select(F.col("o_orderkey").alias("call_id"), F.concat(F.lit("Brand#"), F.col("o_custkey") % 40).alias("receiver"), (F.col("o_orderkey") % 2500).alias("p_partkey"), (F.col("o_custkey") % 4).cast("int").alias("arity")).join(names, "p_partkey", "left").select("call_id", "receiver", F.coalesce("p_name", F.lit("println")).alias("name"), "arity")
    library = spark.createDataFrame([("println",)], "name string")
    return P.link_calls(calls, methods, library)


def overload_resolution(spark: SparkSession, folder: str) -> DataFrame:
    part, orders = table(spark, folder, "part"), table(spark, folder, "orders")
    kind = lambda c: F.element_at(F.array(F.lit("int"), F.lit("long"), F.lit("double")), (c % 3 + 1).cast("int"))
    methods = part.select(F.col("p_partkey").alias("method_id"), (F.col("p_partkey") % 400).alias("name"), F.array(kind(F.col("p_size")), kind(F.col("p_partkey"))).alias("parameters"))
    calls = orders.select(F.col("o_orderkey").alias("call_id"), (F.col("o_orderkey") % 500).alias("name"), F.array(kind(F.col("o_custkey")), kind(F.col("o_orderkey"))).alias("arguments"))
    widens = spark.createDataFrame([("int", "long"), ("int", "double"), ("long", "double")], "narrow string, wide string")
    return P.overloads(calls, methods, widens)


def transaction_flow(spark: SparkSession, folder: str) -> DataFrame:
    links = checkpoint(trade(spark, folder))
    kind = F.when(F.col("id") % 4 == 0, "requires_new").when(F.col("id") % 4 == 1, "never")
    bounds = projects(spark, folder).select(F.col("id").alias("symbol"), kind.alias("propagation")).where("propagation is not null")
    return P.transaction_flow(links, bounds, projects(spark, folder).select(F.col("id").alias("root")))


def read_only_writes(spark: SparkSession, folder: str) -> DataFrame:
    links, every = checkpoint(trade(spark, folder)), projects(spark, folder)
    return P.read_only_writes(links, every.where("area = 2").select(F.col("id").alias("symbol")), every.where("id % 7 in (3, 4)").select(F.col("id").alias("symbol")))


def cascade_targets(spark: SparkSession, folder: str) -> DataFrame:
    links = checkpoint(trade(spark, folder)).where("target % 2 = 0")
    return reachable(links, projects(spark, folder).select(F.col("id").alias("root")), "by_cycle").select("root", "node")


def endpoint_entities(spark: SparkSession, folder: str) -> DataFrame:
    links, every = checkpoint(trade(spark, folder)), projects(spark, folder)
    return P.endpoint_entities(links, every.where("area = 0").select("id"), every.where("area = 1").select("id"))


def legacy_impact(spark: SparkSession, folder: str) -> DataFrame:
    links, every = checkpoint(trade(spark, folder)), projects(spark, folder)
    sources = every.where("area <> 4").select("id", F.col("name").alias("source"))
    return P.legacy_impact(links, every.where("area = 3").select(F.col("id").alias("root")), sources)


def feasible_states(spark: SparkSession, folder: str) -> DataFrame:
    lineitem = table(spark, folder, "lineitem")
    op = F.element_at(F.array(*(F.lit(x) for x in ("<", "<=", ">", ">=", "==", "!="))), (F.col("l_partkey") % 6 + 1).cast("int"))
    return P.feasible_states(lineitem.select(F.col("l_orderkey").alias("state"), (F.col("l_suppkey") % 2).alias("variable"), op.alias("op"), F.col("l_quantity").alias("value")))


def missing_cases(spark: SparkSession, folder: str) -> DataFrame:
    nation, customer, orders = _nations(spark, folder), table(spark, folder, "customer"), table(spark, folder, "orders")
    switches = customer.select(F.col("c_custkey").alias("switch_id"), (F.col("c_nationkey") % 5).alias("type"), (F.col("c_acctbal") < 0).alias("has_default"))
    cases = orders.select(F.col("o_custkey").alias("switch_id"), (F.col("o_orderkey") % 25).cast("int").alias("leaf"))
    return P.missing_cases(switches, cases, nation.select(F.col("n_regionkey").alias("type"), F.col("n_nationkey").alias("leaf")))


def permitted_leaves(spark: SparkSession, folder: str) -> DataFrame:
    nation, supplier = _nations(spark, folder), table(spark, folder, "supplier")
    extends = nation.select(F.concat(F.lit("n"), "n_nationkey").alias("source"), F.concat(F.lit("r"), "n_regionkey").alias("target")).unionByName(supplier.select(F.concat(F.lit("s"), "s_suppkey").alias("source"), F.concat(F.lit("n"), "s_nationkey").alias("target")))
    return P.permitted_leaves(extends, table(spark, folder, "region").select(F.concat(F.lit("r"), "r_regionkey").alias("root")))


def definitely_assigned(spark: SparkSession, folder: str) -> DataFrame:
    lineitem = table(spark, folder, "lineitem")
    return P.definitely_assigned(lineitem.select(F.col("l_orderkey").alias("join_id"), F.col("l_suppkey").alias("branch")), lineitem.select(F.col("l_suppkey").alias("branch"), (F.col("l_partkey") % 20).alias("variable")))


def call_statistics(spark: SparkSession, folder: str) -> DataFrame:
    return P.call_statistics(resolved_types(spark, folder), strong_components(trade(spark, folder)))


def annotation_facts(spark: SparkSession, folder: str) -> DataFrame:
    supplier = table(spark, folder, "supplier")
    code = F.concat(F.lit('// @Entity no\n@Service("'), "s_name", F.lit('")\nclass A { @GetMapping("/a/'), "s_nationkey", F.lit('") void f() {} @Autowired B b; @Override void g() {} }'))
    return P.annotation_facts(supplier.select(F.col("s_suppkey").alias("id"), code.alias("code")))


def version_constraints(spark: SparkSession, folder: str) -> DataFrame:
    part = table(spark, folder, "part")
    text = F.concat_ws(".", F.col("p_size") % 3, F.col("p_partkey") % 4, F.col("p_size") % 5)
    tagged = F.when(F.col("p_partkey") % 7 == 0, F.concat(text, F.lit("-rc.1"))).otherwise(text)
    return part.select("p_partkey", V.satisfies(tagged, "^1.1.0").alias("caret"), V.satisfies(tagged, ">=0.2.0, <2.0.0").alias("span"), V.satisfies(F.lit("x"), "*").alias("any"))


def route_names(spark: SparkSession, folder: str) -> DataFrame:
    part = table(spark, folder, "part")
    raw = F.concat(F.lit("//a/"), "p_size", F.lit("/{id"), "p_size", F.lit("}//"))
    return part.select("p_partkey", V.route(raw).alias("route"), V.bean_name(F.when(F.col("p_size") > 25, F.lit("URLMap")).otherwise(F.lit("OwnerMap"))).alias("bean"))


def literal_kinds(spark: SparkSession, folder: str) -> DataFrame:
    part = table(spark, folder, "part")
    forms = ("{}", "{}L", "{}.5f", "{}.25", "0x{}", '"{}"', "'x'", "true", "09{}", "{}_000")
    choice = F.element_at(F.array(*(F.concat(*(F.col("p_size").cast("string") if p is None else F.lit(p) for p in _split(f))) for f in forms)), (F.col("p_partkey") % len(forms) + 1).cast("int"))
    return part.select(choice.alias("text")).distinct().select("text", V.literal_kind(F.col("text")).alias("kind"))


def _split(form: str) -> list:
    before, middle, after = form.partition("{}")
    return [before, None, after] if middle else [before]


def rule_findings(spark: SparkSession, folder: str) -> DataFrame:
    registry = RuleRegistry()
    registry.add(Rule("R2", "high", lambda: F.col("p_size") > 45, "large"))
    registry.add(Rule("R1", "low", lambda: F.col("p_name").startswith("red"), "red"))
    return registry.run(table(spark, folder, "part"), "p_partkey")


QUERIES = {f.__name__: f for f in (symbol_problems, resolved_types, linked_calls, overload_resolution, transaction_flow, read_only_writes, cascade_targets, endpoint_entities, legacy_impact, feasible_states, missing_cases, permitted_leaves, definitely_assigned, call_statistics, annotation_facts, version_constraints, route_names, literal_kinds, rule_findings)}

_WALK = f"WITH RECURSIVE {TRADE_SQL}, walk AS (SELECT id AS root, id AS node, 0 AS depth FROM projects UNION SELECT w.root, t.target, w.depth + 1 FROM walk w JOIN trade t ON t.source = w.node WHERE w.depth < 12), near AS (SELECT root, node, min(depth) AS depth FROM walk GROUP BY root, node)"
_TYPES = "t AS (SELECT 't' || s_suppkey AS fqn, s_nationkey AS package, s_suppkey % 30 AS name FROM supplier), w AS (SELECT c_custkey AS use_id, c_nationkey AS package, c_custkey % 40 AS name FROM customer), i AS (SELECT DISTINCT o_custkey AS file, 't' || l_suppkey AS fqn FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE l_quantity > 45), c AS (SELECT use_id, 1 AS stage, fqn AS target FROM w JOIN t USING (name) WHERE w.package = t.package OR (use_id, fqn) IN (SELECT (file, fqn) FROM i) UNION ALL SELECT use_id, 2, fqn FROM w JOIN t USING (name))"
_STAGED = "first AS (SELECT {key}, min(stage) AS stage FROM c GROUP BY {key}), held AS (SELECT {key}, c.stage, count(DISTINCT target) AS options, min(target) AS target FROM c JOIN first USING ({key}, stage) GROUP BY {key}, c.stage), res AS (SELECT {key}, CASE WHEN options IS NULL THEN 'unresolved' WHEN options = 1 THEN 'resolved' ELSE 'ambiguous' END AS status, stage, target, coalesce(options, 0) AS options FROM (SELECT DISTINCT {key} FROM w) LEFT JOIN held USING ({key}))"
SQL = {
    "symbol_problems": "WITH s AS (SELECT p_partkey % 1500 AS id, CASE WHEN p_size > 40 THEN p_partkey + 1000 END AS owner FROM part) SELECT id, 'duplicate' AS problem FROM s GROUP BY id HAVING count(*) > 1 UNION ALL SELECT DISTINCT id, 'orphan' FROM s WHERE owner IS NOT NULL AND owner NOT IN (SELECT id FROM s)",
    "resolved_types": f"WITH {_TYPES}, {_STAGED.format(key='use_id')} SELECT * FROM res",
    "linked_calls": "WITH m AS (SELECT p_partkey AS id, p_brand AS owner, p_name AS name, p_size % 3 AS arity FROM part), k AS (SELECT o_orderkey AS call, 'Brand#' || (o_custkey % 40) AS receiver, coalesce(p_name, 'println') AS name, o_custkey % 4 AS arity FROM orders LEFT JOIN part ON p_partkey = o_orderkey % 2500), e AS (SELECT call, id FROM k JOIN m ON owner = receiver AND m.name = k.name AND m.arity = k.arity), l AS (SELECT call, id FROM k JOIN m ON m.name = k.name AND m.arity = k.arity WHERE call NOT IN (SELECT call FROM e)), x AS (SELECT call, id, 'exact' AS link FROM e UNION ALL SELECT call, id, 'by_name' FROM l UNION ALL SELECT call, NULL, 'unresolved' FROM k WHERE name <> 'println' AND call NOT IN (SELECT call FROM e) AND call NOT IN (SELECT call FROM l)) SELECT call AS call_id, id AS target, link FROM x",
    "overload_resolution": f"WITH m AS (SELECT p_partkey AS target, p_partkey % 400 AS name, p_size % 3 AS a, p_partkey % 3 AS b FROM part), w AS (SELECT o_orderkey AS call_id, o_orderkey % 500 AS name, o_custkey % 3 AS a, o_orderkey % 3 AS b FROM orders), c AS (SELECT call_id, ((w.a <> m.a)::INT + (w.b <> m.b)::INT) AS stage, target FROM w JOIN m USING (name) WHERE w.a <= m.a AND w.b <= m.b), {_STAGED.format(key='call_id')} SELECT * FROM res",
    "transaction_flow": _WALK + " SELECT root, node AS symbol, depth, CASE WHEN depth = 0 THEN 'root' WHEN node % 4 = 0 THEN 'new' WHEN node % 4 = 1 THEN 'suspended' ELSE 'joined' END AS effect FROM near",
    "read_only_writes": _WALK + " SELECT DISTINCT root AS symbol FROM near JOIN projects ON id = root WHERE area = 2 AND node % 7 IN (3, 4)",
    "cascade_targets": f"WITH RECURSIVE {TRADE_SQL}, c AS (SELECT * FROM trade WHERE target % 2 = 0), reach AS (SELECT source AS root, target AS node FROM c UNION SELECT r.root, c.target FROM reach r JOIN c ON c.source = r.node) SELECT root, node FROM reach",
    "endpoint_entities": f"WITH RECURSIVE {TRADE_SQL}, ent AS (SELECT id FROM projects WHERE area = 1), walk AS (SELECT id AS root, id AS node, 0 AS depth FROM projects WHERE area = 0 UNION SELECT w.root, t.target, w.depth + 1 FROM walk w JOIN trade t ON t.source = w.node WHERE w.depth < 8 AND w.node NOT IN (SELECT id FROM ent)) SELECT root AS endpoint, node AS entity, min(depth) AS depth FROM walk WHERE node IN (SELECT id FROM ent) GROUP BY root, node",
    "legacy_impact": f"WITH RECURSIVE {TRADE_SQL}, walk AS (SELECT id AS node, 0 AS depth FROM projects WHERE area = 3 UNION SELECT t.source, w.depth + 1 FROM walk w JOIN trade t ON t.target = w.node WHERE w.depth < 12) SELECT node, min(depth) AS distance, CASE WHEN any_value(area) <> 4 THEN any_value(name) END AS file FROM walk JOIN projects ON id = node WHERE area <> 3 GROUP BY node",
    "feasible_states": "WITH c AS (SELECT l_orderkey AS state, l_suppkey % 2 AS v, l_partkey % 6 AS op, l_quantity AS x FROM lineitem), b AS (SELECT state, v, max(x) FILTER (op IN (2, 3)) AS lo, max(x) FILTER (op = 2) AS lo_open, min(x) FILTER (op IN (0, 1)) AS hi, min(x) FILTER (op = 0) AS hi_open, min(x) FILTER (op = 4) AS e1, max(x) FILTER (op = 4) AS e2, list(DISTINCT x) FILTER (op = 5) AS n FROM c GROUP BY 1, 2), "
    "d AS (SELECT state, coalesce(lo > hi, false) OR coalesce(lo = hi AND (coalesce(lo_open = lo, false) OR coalesce(hi_open = hi, false) OR coalesce(list_contains(n, lo), false)), false) OR coalesce(e1 <> e2, false) OR coalesce(e1 < lo OR (e1 = lo AND lo_open = lo), false) OR coalesce(e1 > hi OR (e1 = hi AND hi_open = hi), false) OR coalesce(list_contains(n, e1), false) AS broken FROM b) SELECT state, NOT bool_or(broken) AS feasible FROM d GROUP BY state",
    "missing_cases": "SELECT c_custkey AS switch_id, n_nationkey AS leaf FROM customer JOIN nation ON n_regionkey = c_nationkey % 5 WHERE c_acctbal >= 0 AND (c_custkey, n_nationkey) NOT IN (SELECT (o_custkey, (o_orderkey % 25)::INT) FROM orders)",
    "permitted_leaves": "SELECT 'r' || n_regionkey AS type, coalesce('s' || s_suppkey, 'n' || n_nationkey) AS leaf FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey",
    "definitely_assigned": "WITH b AS (SELECT DISTINCT l_orderkey AS join_id, l_suppkey AS branch FROM lineitem), a AS (SELECT DISTINCT l_suppkey AS branch, l_partkey % 20 AS variable FROM lineitem), n AS (SELECT join_id, count(*) AS n FROM b GROUP BY 1) SELECT join_id, variable FROM b JOIN a USING (branch) JOIN n USING (join_id) GROUP BY join_id, variable, n HAVING count(*) = n",
    "call_statistics": f"WITH RECURSIVE {TRADE_SQL}, reach AS (SELECT source AS root, target AS node FROM trade UNION SELECT r.root, t.target FROM reach r JOIN trade t ON t.source = r.node), loops AS (SELECT a.root, min(a.node) AS component FROM reach a JOIN reach b ON a.root = b.node AND a.node = b.root GROUP BY a.root), {_TYPES}, {_STAGED.format(key='use_id')} SELECT count(*) FILTER (status = 'resolved') AS resolved, count(*) FILTER (status = 'ambiguous') AS ambiguous, count(*) FILTER (status = 'unresolved') AS unresolved, (SELECT count(DISTINCT component) FROM loops) AS recursive_components FROM res",
    "annotation_facts": "SELECT s_suppkey AS id, 'Service' AS annotation, s_name AS argument, 'service' AS fact FROM supplier UNION ALL SELECT s_suppkey, 'GetMapping', '/a/' || s_nationkey, 'GET' FROM supplier UNION ALL SELECT s_suppkey, 'Autowired', NULL, 'injection' FROM supplier",
    "version_constraints": "WITH v AS (SELECT p_partkey, p_size % 3 AS a, p_partkey % 4 AS b, p_size % 5 AS c, p_partkey % 7 = 0 AS pre FROM part) SELECT p_partkey, (a = 1 AND b >= 1 AND NOT (b = 1 AND c = 0 AND pre)) OR (a = 2 AND b = 0 AND c = 0 AND pre) AS caret, ((a > 0 OR b > 2 OR (b = 2 AND NOT (c = 0 AND pre))) AND a < 2) OR (a = 2 AND b = 0 AND c = 0 AND pre) AS span, true AS any FROM v",
    "route_names": "SELECT p_partkey, '/a/' || p_size || '/{}' AS route, CASE WHEN p_size > 25 THEN 'URLMap' ELSE 'ownerMap' END AS bean FROM part",
    "literal_kinds": "SELECT DISTINCT CASE p_partkey % 10 WHEN 0 THEN p_size::VARCHAR WHEN 1 THEN p_size || 'L' WHEN 2 THEN p_size || '.5f' WHEN 3 THEN p_size || '.25' WHEN 4 THEN '0x' || p_size WHEN 5 THEN '\"' || p_size || '\"' WHEN 6 THEN '''x''' WHEN 7 THEN 'true' WHEN 8 THEN '09' || p_size ELSE p_size || '_000' END AS text, ['int', 'long', 'float', 'double', 'int', 'string', 'char', 'boolean', 'invalid', 'int'][p_partkey % 10 + 1] AS kind FROM part",
    "rule_findings": "SELECT p_partkey, 'R2' AS rule_id, 'high' AS severity, 'large' AS message FROM part WHERE p_size > 45 UNION ALL SELECT p_partkey, 'R1', 'low', 'red' FROM part WHERE starts_with(p_name, 'red')",
}
