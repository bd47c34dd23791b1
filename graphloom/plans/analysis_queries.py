"""Impact, reachability, motifs, security, debt and review on the driver's tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.operators import hubs as H
from graphloom.operators import impact as I
from graphloom.operators import motifs as M
from graphloom.operators import search as S
from graphloom.operators import security as X
from graphloom.operators.hubs import Related
from graphloom.plans.adapters import TRADE_SQL, projects, trade
from graphloom.session import checkpoint
from graphloom.sources.tables import table


def _projects(spark: SparkSession, folder: str) -> DataFrame:
    return projects(spark, folder).withColumn("kind", F.lit("project"))


def _legal(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    every, links = checkpoint(_projects(spark, folder).select("id", "kind")), checkpoint(trade(spark, folder))
    return I.legal_edges(every, links, "signature"), every.select(F.col("id").alias("root"))


def impact_findings(spark: SparkSession, folder: str) -> DataFrame:
    def told(node: Column, hops: Column, weakest: Column) -> dict[str, Column]:
        seen = F.when(node % 3 == 0, "public").when(node % 3 == 1, "private")
        return {"hops": hops, "score": I.impact_score(weakest, hops, I.exposure(seen)), "reach": F.when(hops == 1, "direct").otherwise("transitive")}

    return I.spread(*_legal(spark, folder), 4, told).where("root <> node")


def impact_confidence(spark: SparkSession, folder: str) -> DataFrame:
    return I.spread_confidence(*_legal(spark, folder), 4).where("root <> node").select("root", "node", "confidence", "tier")


def impact_breaking(spark: SparkSession, folder: str) -> DataFrame:
    part = table(spark, folder, "part")
    kind = F.when(F.col("p_size") % 5 == 0, "concept").otherwise("type")
    seen = F.when(F.col("p_type") == "SMALL", "Public").when(F.col("p_type") == "LARGE", "private")
    change = F.when(F.col("p_size") > 25, "removal").otherwise("implementation")
    return part.select("p_partkey", I.breaking_state(kind, seen, change, F.col("p_brand") == "Brand#7").alias("state"))


def reachability(spark: SparkSession, folder: str) -> DataFrame:
    part, lineitem = table(spark, folder, "part"), table(spark, folder, "lineitem")
    nodes = part.select(
        F.col("p_partkey").alias("id"), F.when(F.col("p_size") == 7, "field").otherwise("type").alias("kind"), F.when(F.col("p_size") > 45, "public").otherwise("private").alias("visibility"), F.when(F.col("p_type") == "PROMO", "generated").otherwise("main").alias("classification"),
        F.when(F.col("p_brand") == "Brand#3", "unavailable").otherwise("complete").alias("calls"), F.when(F.col("p_brand") == "Brand#4", "partial").otherwise("complete").alias("reflection"), (F.col("p_size") < 20).alias("closed"),
    )
    protections = part.where("p_size = 11").select(F.col("p_partkey").alias("id"), F.lit("framework_managed").alias("protection")).unionByName(part.where("p_size = 11 and p_type = 'SMALL'").select(F.col("p_partkey").alias("id"), F.lit("unreachable").alias("protection")))
    return I.reachability_states(nodes, protections, lineitem.where("l_quantity > 49").select(F.col("l_partkey").alias("id")), lineitem.where("l_quantity < 3").select(F.col("l_partkey").alias("id")))


def _facts(spark: SparkSession, folder: str) -> DataFrame:
    links = checkpoint(trade(spark, folder).select("source", "target"))
    kinds = {"inherits": "target % 2 = 0", "composes": "true", "calls": "source % 11 <> 5", "returns": "target % 2 = 0", "constructs": "true"}
    found = None
    for name, condition in kinds.items():
        one = links.where(condition).withColumn("relation", F.lit(name))
        found = one if found is None else found.unionByName(one)
    return found.unionByName(links.select(F.col("target").alias("source"), F.col("source").alias("target"), F.lit("uses").alias("relation")))


def motif_strategies(spark: SparkSession, folder: str) -> DataFrame:
    return M.strategies(_facts(spark, folder))


def motif_factories(spark: SparkSession, folder: str) -> DataFrame:
    return M.factories(_facts(spark, folder))


def motif_adapters(spark: SparkSession, folder: str) -> DataFrame:
    return M.adapters(_facts(spark, folder))


def motif_decorators(spark: SparkSession, folder: str) -> DataFrame:
    return M.decorators(_facts(spark, folder))


def motif_commands(spark: SparkSession, folder: str) -> DataFrame:
    return M.commands(_facts(spark, folder))


def motif_builders(spark: SparkSession, folder: str) -> DataFrame:
    lineitem = table(spark, folder, "lineitem")
    return M.builders(lineitem.select(F.col("l_suppkey").alias("owner"), F.col("l_orderkey").alias("name"), F.when(F.col("l_quantity") == 50, F.col("l_suppkey")).otherwise(F.col("l_partkey")).alias("returns")))


def motif_template_methods(spark: SparkSession, folder: str) -> DataFrame:
    links = checkpoint(trade(spark, folder).select("source", "target"))
    inherits = links.withColumn("relation", F.lit("inherits"))
    method = lambda c, m: F.concat(F.lit(m), F.col(c))
    over = links.where("source % 2 = 0").select(method("source", "hook").alias("source"), method("target", "hook").alias("target"), F.lit("overrides").alias("relation"))
    calls = links.where("target % 3 = 0").select(method("target", "run").alias("source"), method("target", "hook").alias("target"), F.lit("calls").alias("relation"))
    members = projects(spark, folder).select(F.explode(F.array(F.struct(method("id", "hook").alias("method"), F.col("id").alias("owner")), F.struct(method("id", "run").alias("method"), F.col("id").alias("owner")))).alias("x")).select("x.method", "x.owner")
    facts = inherits.select(F.col("source").cast("string"), F.col("target").cast("string"), "relation").unionByName(over).unionByName(calls)
    return M.template_methods(facts, members.select("method", F.col("owner").cast("string").alias("owner")))


GROUPS = (("red", "blue"), ("small", "large"), ("widget",), ("ring",))


def architecture_tokens(spark: SparkSession, folder: str) -> DataFrame:
    terms = table(spark, folder, "part").select(F.col("p_brand").alias("scope"), F.explode(S.terms(F.col("p_name"))).alias("term"))
    return M.architecture_tokens(terms, GROUPS, 2, 0.6)


def secret_findings(spark: SparkSession, folder: str) -> DataFrame:
    texts = table(spark, folder, "documents").select(F.col("doc_id").alias("id"), "text")
    return X.secrets(texts, {**X.SECRETS, "limit": r"--limit [0-9]+", "public_class": r"public final class [A-Z]"})


def weak_crypto(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "part").select(F.upper("p_name").alias("name")).distinct().select("name", X.is_weak(F.concat(F.lit("A"), "name", F.lit("ES"))).alias("weak"))


def consolidated_findings(spark: SparkSession, folder: str) -> DataFrame:
    lineitem = table(spark, folder, "lineitem")
    level = F.when(F.col("l_quantity") > 40, "critical").when(F.col("l_quantity") > 20, "high").when(F.col("l_quantity") > 10, "low").otherwise("info")
    rows = lineitem.select(F.col("l_suppkey").alias("project"), F.col("l_returnflag").alias("rule"), F.col("l_linenumber").alias("line"), level.alias("severity"), F.col("l_linestatus").alias("producer"), (F.col("l_discount") * 100).cast("int").alias("traces"), (F.col("l_tax") > 0.07).alias("resolved"))
    return X.consolidated(rows, ["project", "rule", "line"])


def taint_paths(spark: SparkSession, folder: str) -> DataFrame:
    links = checkpoint(trade(spark, folder))
    own = _projects(spark, folder)
    found = H.simple_between(links, own.where("area = 0"), own.where("area = 1"), own.where("id % 7 = 2"), 4)
    return found.select("path", F.when(F.col("marked"), "sanitized").otherwise("tainted").alias("verdict"))


def debt_ranking(spark: SparkSession, folder: str) -> DataFrame:
    supplier = table(spark, folder, "supplier")
    return X.debt_ranking(supplier.select(F.col("s_suppkey").alias("seam"), F.when(F.col("s_acctbal") > 0, F.floor(F.col("s_acctbal") / 1000)).alias("impact"), F.col("s_nationkey").alias("direct"), F.when(F.col("s_nationkey") > 5, F.col("s_acctbal")).alias("risk")))


def change_review(spark: SparkSession, folder: str) -> DataFrame:
    every, links = _projects(spark, folder), checkpoint(trade(spark, folder))
    subjects = every.select("id", F.concat(F.lit("src/"), "name").alias("path"), F.col("area").cast("string").alias("project"))
    changes = subjects.where("id % 2 = 0").select("path", "project").unionByName(table(spark, folder, "region").select(F.concat(F.lit("docs/"), "r_name").alias("path"), F.col("r_regionkey").cast("string").alias("project")))
    back = links.select(F.col("target").alias("source"), F.col("source").alias("target"))
    related = Related(back, every.select(F.col("id").alias("root")), "by_cycle")
    cyclic = checkpoint(related.recursive().withColumnRenamed("root", "id"))
    dependents = related.counts().select(F.col("root").alias("id"), "pairs").join(cyclic.withColumn("self", F.lit(1)), "id", "left").select("id", (F.col("pairs") - F.coalesce("self", F.lit(0))).alias("dependents"))
    risk = table(spark, folder, "project_runs").groupBy("project").agg(F.count("*").alias("risk")).where("risk > 4").join(every.select(F.col("name").alias("project"), "id"), "project").select("id", "risk")
    return X.change_review(changes, subjects, dependents, risk, cyclic)


def citation_check(spark: SparkSession, folder: str) -> DataFrame:
    orders, lineitem = table(spark, folder, "orders"), table(spark, folder, "lineitem")
    cited = lineitem.select(F.col("l_orderkey").alias("answer"), F.col("l_partkey").alias("evidence"))
    known = table(spark, folder, "part").where("p_size > 10").select(F.col("p_partkey").alias("evidence"))
    required = orders.select(F.col("o_orderkey").alias("answer"), F.col("o_custkey").alias("evidence"))
    return X.citations(orders.select(F.col("o_orderkey").alias("answer")), cited, known, required)


QUERIES = {f.__name__: f for f in (impact_findings, impact_confidence, impact_breaking, reachability, motif_strategies, motif_factories, motif_adapters, motif_decorators, motif_commands, motif_builders, motif_template_methods, architecture_tokens, secret_findings, weak_crypto, consolidated_findings, taint_paths, debt_ranking, change_review, citation_check)}

_HOPS = f"WITH RECURSIVE {TRADE_SQL}, walk AS (SELECT id AS root, id AS node, 0 AS hops FROM projects UNION SELECT w.root, t.source, w.hops + 1 FROM walk w JOIN trade t ON t.target = w.node WHERE w.hops < 4), hop AS (SELECT root, node, min(hops) AS hops FROM walk GROUP BY root, node HAVING root <> node)"
_FACTS = f"{TRADE_SQL}, inh AS (SELECT * FROM trade WHERE target % 2 = 0), cal AS (SELECT * FROM trade WHERE source % 11 <> 5), impl AS (SELECT target AS base, count(*) AS implementations FROM inh GROUP BY 1 HAVING count(*) >= 2)"
SQL = {
    "impact_findings": _HOPS + " SELECT root, node, hops, round(CASE node % 3 WHEN 2 THEN (0.78::DOUBLE * 0.6 + 0.25 / (1 + 0.2::DOUBLE * (hops - 1))) / 0.85 ELSE 0.78::DOUBLE * 0.6 + 0.25 / (1 + 0.2::DOUBLE * (hops - 1)) + CASE node % 3 WHEN 0 THEN 0.15 ELSE 0 END END, 6) AS score, CASE hops WHEN 1 THEN 'direct' ELSE 'transitive' END AS reach FROM hop",
    "impact_confidence": _HOPS + ", c AS (SELECT root, node, round(0.82::DOUBLE * 0.88::DOUBLE * 0.75::DOUBLE / (1 + 0.1::DOUBLE * (hops - 1)), 4) AS confidence FROM hop) SELECT *, CASE WHEN confidence < 0.4 THEN 'insufficient' WHEN confidence >= 0.8 THEN 'high' WHEN confidence >= 0.6 THEN 'medium' ELSE 'low' END AS tier FROM c",
    "impact_breaking": "SELECT p_partkey, CASE WHEN p_size % 5 = 0 THEN 'unsupported' WHEN (p_type = 'SMALL' OR p_brand = 'Brand#7') AND p_size > 25 THEN 'potentially_breaking' WHEN p_type = 'LARGE' THEN 'not_applicable' ELSE 'not_evaluated' END AS state FROM part",
    "reachability": "SELECT p_partkey AS id, CASE WHEN p_size = 11 THEN CASE WHEN p_type = 'SMALL' THEN 'unreachable' ELSE 'framework_managed' END WHEN p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 49) THEN 'reachable' WHEN p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_quantity < 3) THEN 'reachable_test_only' WHEN p_brand = 'Brand#4' THEN 'unknown' WHEN p_brand = 'Brand#3' THEN 'unknown' WHEN p_size = 7 THEN 'unknown' WHEN p_size > 45 THEN 'unused' WHEN p_type = 'PROMO' THEN 'unknown' WHEN p_size < 20 THEN 'likely_dead' ELSE 'unused' END AS state FROM part",
    "motif_strategies": f"WITH {_FACTS} SELECT t.source AS abstraction, t.target AS client, implementations FROM trade t JOIN impl ON base = t.source WHERE (t.target, t.source) NOT IN (SELECT (source, target) FROM inh)",
    "motif_factories": f"WITH {_FACTS} SELECT r.source AS factory, r.target AS abstraction, count(*) AS products FROM inh r JOIN inh c ON c.target = r.target JOIN trade k ON k.source = r.source AND k.target = c.source GROUP BY 1, 2 HAVING count(*) >= 2",
    "motif_adapters": f"WITH {_FACTS} SELECT c.source AS adapter, i.target AS role, c.target AS adaptee FROM cal c JOIN inh i ON i.source = c.source WHERE i.target <> c.target",
    "motif_decorators": f"WITH {_FACTS} SELECT source AS decorator, target AS role FROM inh WHERE source % 11 <> 5",
    "motif_commands": f"WITH {_FACTS} SELECT v.target AS abstraction, v.source AS invoker, k.source AS command, r.target AS receiver FROM cal v JOIN impl ON base = v.target JOIN inh k ON k.target = v.target JOIN cal r ON r.source = k.source WHERE v.source <> k.source AND r.target <> v.target",
    "motif_builders": "SELECT owner FROM (SELECT DISTINCT l_suppkey AS owner, l_orderkey AS name, CASE WHEN l_quantity = 50 THEN l_suppkey ELSE l_partkey END AS r FROM lineitem) GROUP BY owner HAVING count(*) FILTER (r = owner) >= 2 AND count(*) FILTER (r <> owner) >= 1",
    "motif_template_methods": f"WITH {TRADE_SQL} SELECT DISTINCT 'run' || target AS template, 'hook' || target AS hook, 'hook' || source AS override FROM trade WHERE source % 2 = 0 AND target % 3 = 0",
    "architecture_tokens": "SELECT scope, count(DISTINCT g) AS groups, round(least(0.98, 0.6 + 0.06 * (count(DISTINCT g) - 2)), 4)::DOUBLE AS confidence FROM (SELECT p_brand AS scope, CASE WHEN t IN ('red', 'blue') THEN 0 WHEN t IN ('small', 'large') THEN 1 WHEN t = 'widget' THEN 2 WHEN t = 'ring' THEN 3 END AS g FROM (SELECT p_brand, unnest(string_split(lower(p_name), ' ')) AS t FROM part)) WHERE g IS NOT NULL GROUP BY scope HAVING count(DISTINCT g) >= 2",
    "secret_findings": "SELECT id, rule, hits FROM (SELECT doc_id AS id, unnest([{'rule': 'aws_access_key', 'hits': len(regexp_extract_all(text, 'AKIA[0-9A-Z]{16}'))::INT}, {'rule': 'private_key', 'hits': len(regexp_extract_all(text, '-----BEGIN (?:RSA |EC |OPENSSH )?PRIVATE KEY-----'))::INT}, {'rule': 'generic_secret', 'hits': len(regexp_extract_all(text, '(?i)(?:password|passwd|secret|api[_-]?key|token)\\s*[:=]\\s*[\"'']([^\"'']{8,})[\"'']'))::INT}, {'rule': 'limit', 'hits': len(regexp_extract_all(text, '--limit [0-9]+'))::INT}, {'rule': 'public_class', 'hits': len(regexp_extract_all(text, 'public final class [A-Z]'))::INT}], recursive := true) FROM documents) WHERE hits > 0",
    "weak_crypto": "SELECT DISTINCT upper(p_name) AS name, regexp_matches('A' || upper(p_name) || 'ES', 'MD5|SHA-1|SHA1|DES|RC4|AES/ECB') AS weak FROM part",
    "consolidated_findings": "WITH f AS (SELECT l_suppkey AS project, l_returnflag AS rule, l_linenumber AS line, CASE WHEN l_quantity > 40 THEN 4 WHEN l_quantity > 20 THEN 3 WHEN l_quantity > 10 THEN 1 ELSE 0 END AS s, l_linestatus AS p, trunc(l_discount * 100)::INT AS traces, l_tax > 0.07 AS resolved FROM lineitem), g AS (SELECT project, rule, line, s, count(*) AS n, list(DISTINCT p) AS ps, max(traces) AS traces, bool_or(resolved) AS resolved FROM f GROUP BY 1, 2, 3, 4), m AS (SELECT project, rule, line, max(s) AS s, round(max(n) / sum(n), 4) AS agreement, len(list_distinct(flatten(list(ps))))::INT AS producers, max(traces) AS traces, bool_or(resolved) AS resolved FROM g GROUP BY 1, 2, 3), "
    "w AS (SELECT *, 0.5::DOUBLE + CASE WHEN traces > 0 THEN 0.15::DOUBLE ELSE 0 END + CASE WHEN resolved THEN 0.15::DOUBLE ELSE 0 END AS weight, [0.05, 0.15, 0.3, 0.4, 0.5][s + 1]::DOUBLE + CASE WHEN traces >= 2 THEN 0.15::DOUBLE WHEN traces > 0 THEN 0.0975::DOUBLE ELSE 0 END + CASE WHEN resolved THEN 0.15::DOUBLE ELSE 0 END AS points FROM m), r AS (SELECT *, round(points / weight, 4) AS priority FROM w) SELECT project, rule, line, ['info', 'low', 'medium', 'high', 'critical'][s + 1] AS severity, agreement, producers, priority, CASE WHEN priority >= 0.85 THEN 'critical' WHEN priority >= 0.65 THEN 'high' WHEN priority >= 0.45 THEN 'medium' WHEN priority >= 0.2 THEN 'low' ELSE 'informational' END AS tier FROM r",
    "taint_paths": f"WITH RECURSIVE {TRADE_SQL}, walk AS (SELECT [id] AS path FROM projects UNION ALL SELECT list_append(path, target) FROM walk JOIN trade ON source = path[-1] WHERE len(path) < 5 AND NOT list_contains(path, target)), reached AS (SELECT path FROM walk WHERE len(path) > 1) SELECT array_to_string(path, '>') AS path, CASE WHEN len(list_filter(path[2:-2], lambda x: x % 7 = 2)) > 0 THEN 'sanitized' ELSE 'tainted' END AS verdict FROM reached WHERE path[1] % 5 = 0 AND path[-1] % 5 = 1",
    "debt_ranking": "WITH s AS (SELECT s_suppkey AS seam, CASE WHEN s_acctbal > 0 THEN floor(s_acctbal / 1000)::BIGINT END AS impact, s_nationkey AS direct, CASE WHEN s_nationkey > 5 THEN s_acctbal END AS risk FROM supplier) SELECT *, CASE WHEN impact IS NOT NULL THEN row_number() OVER (ORDER BY impact DESC NULLS LAST, direct DESC NULLS LAST, risk DESC NULLS LAST, seam)::INT END AS rank FROM s",
    "change_review": f"WITH RECURSIVE {TRADE_SQL}, nat AS (SELECT id, 'src/' || name AS path, area FROM projects), ch AS (SELECT path, id, true AS exact FROM nat WHERE id % 2 = 0 UNION ALL SELECT 'docs/' || r_name, id, false FROM region JOIN nat ON area = r_regionkey), reach AS (SELECT target AS root, source AS node FROM trade UNION SELECT r.root, t.source FROM reach r JOIN trade t ON t.target = r.node), dep AS (SELECT root, count(*) FILTER (root <> node) AS dependents, bool_or(root = node) AS c FROM reach GROUP BY root), risk AS (SELECT id, count(*) AS risk FROM project_runs JOIN projects ON name = project GROUP BY 1 HAVING count(*) > 4) SELECT path, ch.id, exact, coalesce(dependents, 0) AS dependents, risk, coalesce(c, false) AS in_cycle FROM ch LEFT JOIN dep ON root = ch.id LEFT JOIN risk ON risk.id = ch.id",
    "citation_check": "WITH ci AS (SELECT DISTINCT l_orderkey AS a, l_partkey AS e FROM lineitem), k AS (SELECT a, count(*) FILTER (e IN (SELECT p_partkey FROM part WHERE p_size > 10)) AS accepted, count(*) AS n FROM ci GROUP BY a) SELECT o_orderkey AS answer, coalesce(accepted, 0) AS accepted, coalesce(n - accepted, 0) AS unknown, CASE WHEN (o_orderkey, o_custkey) IN (SELECT (a, e) FROM ci) THEN 0 ELSE 1 END::BIGINT AS missing FROM orders LEFT JOIN k ON a = o_orderkey",
}
