"""Risk, evidence, gates and aggregates on the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.operators import aggregates as A
from graphloom.operators import evidence as E
from graphloom.operators import risk as R
from graphloom.plans.adapters import FILES_SQL, changes, files
from graphloom.sources.tables import table


def metrics(spark: SparkSession, folder: str) -> DataFrame:
    """subject_id, metric, cohort, value of suppliers, parts, customers, nations and regions."""
    lineitem, orders = table(spark, folder, "lineitem"), table(spark, folder, "orders")

    def one(df, kind, key, metric, value):
        return df.groupBy(F.col(key).alias("key")).agg(value.cast("double").alias("value")).select(F.concat(F.lit(f"{kind}:"), "key").alias("subject_id"), F.lit(metric).alias("metric"), F.lit(kind).alias("cohort"), "value")

    bought = orders.join(lineitem.select(F.col("l_orderkey").alias("o_orderkey"), "l_partkey"), "o_orderkey")
    parts = [
        one(lineitem, "supplier", "l_suppkey", "fan_out", F.count_distinct("l_partkey")),
        one(lineitem, "supplier", "l_suppkey", "change_frequency", F.count_distinct("l_orderkey")),
        one(lineitem, "supplier", "l_suppkey", "size", F.sum("l_quantity")),
        one(lineitem, "part", "l_partkey", "fan_in", F.count_distinct("l_suppkey")),
        one(lineitem, "part", "l_partkey", "change_frequency", F.count_distinct("l_orderkey")),
        one(bought, "customer", "o_custkey", "fan_out", F.count_distinct("l_partkey")),
        one(orders, "customer", "o_custkey", "change_frequency", F.count("*")),
        one(table(spark, folder, "customer"), "nation", "c_nationkey", "fan_in", F.count("*")),
        one(table(spark, folder, "nation"), "region", "n_regionkey", "fan_in", F.count("*")),
    ]
    found = parts[0]
    for part in parts[1:]:
        found = found.unionByName(part)
    return found


_METRICS = (
    "metrics AS (SELECT 'supplier:' || l_suppkey AS subject_id, 'fan_out' AS metric, 'supplier' AS cohort, count(DISTINCT l_partkey)::DOUBLE AS value FROM lineitem GROUP BY l_suppkey"
    " UNION ALL SELECT 'supplier:' || l_suppkey, 'change_frequency', 'supplier', count(DISTINCT l_orderkey) FROM lineitem GROUP BY l_suppkey"
    " UNION ALL SELECT 'supplier:' || l_suppkey, 'size', 'supplier', sum(l_quantity) FROM lineitem GROUP BY l_suppkey"
    " UNION ALL SELECT 'part:' || l_partkey, 'fan_in', 'part', count(DISTINCT l_suppkey) FROM lineitem GROUP BY l_partkey"
    " UNION ALL SELECT 'part:' || l_partkey, 'change_frequency', 'part', count(DISTINCT l_orderkey) FROM lineitem GROUP BY l_partkey"
    " UNION ALL SELECT 'customer:' || o_custkey, 'fan_out', 'customer', count(DISTINCT l_partkey) FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_custkey"
    " UNION ALL SELECT 'customer:' || o_custkey, 'change_frequency', 'customer', count(*) FROM orders GROUP BY o_custkey"
    " UNION ALL SELECT 'nation:' || c_nationkey, 'fan_in', 'nation', count(*) FROM customer GROUP BY c_nationkey"
    " UNION ALL SELECT 'region:' || n_regionkey, 'fan_in', 'region', count(*) FROM nation GROUP BY n_regionkey)"
)
_NORMAL = (
    _METRICS + ", ranked AS (SELECT *, rank() OVER (PARTITION BY metric, cohort ORDER BY value) AS lo, count(*) OVER (PARTITION BY metric, cohort, value) AS ties, count(*) OVER (PARTITION BY metric, cohort) AS n,"
    " min(value) OVER (PARTITION BY metric, cohort) <> max(value) OVER (PARTITION BY metric, cohort) AS varied FROM metrics WHERE value > 0), bounds(metric, a, b, c, d) AS (VALUES "
    + ", ".join(f"('{m}', {', '.join(str(float(x)) for x in b)})" for m, b in R.BANDS.items())
    + "), weights(metric, weight) AS (VALUES " + ", ".join(f"('{m}', {w})" for m, w in R.WEIGHTS.items())
    + "), normal AS (SELECT subject_id, metric, cohort, value, CASE WHEN n >= 20 AND varied THEN (lo - 1 + (ties - 1) / 2) / (n - 1) WHEN value <= a THEN 0 WHEN value <= b THEN 0.25 WHEN value <= c THEN 0.5 WHEN value <= d THEN 0.75 ELSE 1 END AS normalized,"
    " CASE WHEN n >= 20 AND varied THEN 'percentile' WHEN n < 20 THEN 'small-cohort' ELSE 'no-variance' END AS basis FROM ranked JOIN bounds USING (metric)),"
    " scored AS (SELECT subject_id, cohort, round(sum(weight * normalized) / sum(weight), 6) AS score, count(*) AS factors FROM normal JOIN weights USING (metric) GROUP BY subject_id, cohort)"
)


def risk_normalised(spark: SparkSession, folder: str) -> DataFrame:
    return R.normalised(metrics(spark, folder)).withColumn("normalized", F.round("normalized", 6))


def risk_hotspot_report(spark: SparkSession, folder: str) -> DataFrame:
    return R.hotspots(metrics(spark, folder))


def risk_scores(spark: SparkSession, folder: str) -> DataFrame:
    return R.scores(R.normalised(metrics(spark, folder))).drop("factor_names")


def risk_heatmap(spark: SparkSession, folder: str) -> DataFrame:
    return R.heatmap(R.normalised(metrics(spark, folder)))


def risk_trend(spark: SparkSession, folder: str) -> DataFrame:
    """The same subjects with some sizes missing now and some fan-outs missing before: equally many factors may be others."""
    normal = R.normalised(metrics(spark, folder))
    now, then = normal.where("not (metric = 'size' and value % 2 = 0)"), normal.where("not (metric = 'fan_out' and value % 3 = 0)")
    return R.trend(R.scores(now), R.scores(then))


def git_change_frequency(spark: SparkSession, folder: str) -> DataFrame:
    return R.change_frequency(changes(spark, folder))


def git_ownership(spark: SparkSession, folder: str) -> DataFrame:
    return R.ownership(changes(spark, folder))


def review_round_robin(spark: SparkSession, folder: str) -> DataFrame:
    return R.round_robin(table(spark, folder, "supplier"), "s_nationkey", "s_suppkey", 40).select("s_nationkey", "s_suppkey", "turn")


def evidence_confidence(spark: SparkSession, folder: str) -> DataFrame:
    suppliers = table(spark, folder, "supplier").select(F.col("s_suppkey").alias("subject_id"))
    roles = suppliers.select("subject_id", F.explode(F.array(F.struct(F.lit("sale").alias("role"), F.lit(True).alias("required")), F.struct(F.lit("return").alias("role"), F.lit(False).alias("required")))).alias("r")).select("subject_id", "r.*")
    lineitem = table(spark, folder, "lineitem")
    role = F.when(F.col("l_returnflag") == "R", "return").when(F.col("l_linestatus") == "F", "sale").otherwise("other")
    records = lineitem.select(F.col("l_suppkey").alias("subject_id"), role.alias("role"), (1 - F.col("l_discount")).alias("reliability"), (1 - F.col("l_tax")).alias("specificity"))
    return E.confidence(roles, records, coverage=0.9)


def _findings(spark: SparkSession, folder: str) -> DataFrame:
    """Findings from orders: the priority as severity, the customer as subject."""
    name = F.lower(F.regexp_replace("o_orderpriority", r"^\d-", ""))
    mapped = F.when(name == "urgent", "critical").when(name == "not specified", "error").otherwise(name)
    return table(spark, folder, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("subject"), mapped.alias("severity"), F.col("o_orderstatus").alias("category"), F.sha2(F.concat_ws("|", "o_custkey", "o_orderpriority"), 256).alias("fingerprint"))


_FINDINGS = "found AS (SELECT o_orderkey AS id, o_custkey AS subject, CASE name WHEN 'urgent' THEN 'critical' WHEN 'not specified' THEN 'error' ELSE name END AS severity, o_orderstatus AS category, sha256(o_custkey || '|' || o_orderpriority) AS fingerprint FROM (SELECT *, lower(regexp_replace(o_orderpriority, '^[0-9]-', '')) AS name FROM orders))"
_SEVERITY = "CASE WHEN severity IN ('info', 'low', 'medium', 'high', 'critical') THEN severity WHEN severity = 'error' THEN 'high' WHEN severity IN ('note', 'information') THEN 'info' ELSE 'medium' END"


def finding_severities(spark: SparkSession, folder: str) -> DataFrame:
    found = _findings(spark, folder)
    return A.severity_counts(found.withColumn("severity", E.severity(F.col("severity"))))


def finding_gate(spark: SparkSession, folder: str) -> DataFrame:
    return E.finding_gate(_findings(spark, folder), "high", 1_000_000)


def finding_priority(spark: SparkSession, folder: str) -> DataFrame:
    traces = table(spark, folder, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.count_if(F.col("l_returnflag") == "R").alias("traces"))
    found = _findings(spark, folder).join(traces, "id", "left").withColumn("traces", F.coalesce("traces", F.lit(0)))
    return found.select("id", *(c.alias(n) for n, c in E.security_priority(E.severity(F.col("severity")), F.col("traces"), F.col("category") == "F").items()))


def architecture_gate(spark: SparkSession, folder: str) -> DataFrame:
    """Orders as findings of customers: regressions, policies, and change impacts whose points are the price in thousands."""
    name, status = F.col("o_orderpriority"), F.col("o_orderstatus")
    level = F.when(name.startswith("1"), "critical").when(name.startswith("2"), "error").when(name.startswith("3"), "warning").otherwise("info")
    category = F.when(status == "F", "regression:edges").when(status == "P", "change-impact").otherwise("policy")
    severity = F.when((status == "P") & (level == "error"), "high").otherwise(level)
    rows = table(spark, folder, "orders").select(F.col("o_custkey").alias("subject"), category.alias("category"), severity.alias("severity"), F.floor(F.col("o_totalprice") / 1000).alias("points"))
    return E.architecture_gate(rows, table(spark, folder, "customer").select(F.col("c_custkey").alias("subject")))


def change_impact_points(spark: SparkSession, folder: str) -> DataFrame:
    lineitem = table(spark, folder, "lineitem")
    stats = lineitem.groupBy(F.col("l_suppkey").alias("subject")).agg(
        F.count_distinct(F.when(F.col("l_quantity") > 48, F.col("l_partkey"))).alias("d"), F.count_distinct(F.when(F.col("l_discount") == 0, F.col("l_partkey"))).alias("t"),
        F.count_if((F.col("l_returnflag") == "R") & (F.col("l_quantity") > 49)).alias("e"), F.count_if((F.col("l_linenumber") == 7) & (F.col("l_quantity") > 45)).alias("j"), F.count_distinct("l_linestatus").alias("p"), F.count_if(F.col("l_quantity") == 13).alias("c"),
    )
    points = E.impact_points(*(F.col(x) for x in "dtejpc"))
    return stats.select("subject", points.cast("bigint").alias("points"), E.impact_level(points).alias("level"))


def inventory_kinds(spark: SparkSession, folder: str) -> DataFrame:
    return A.named_statistics(files(spark, folder), "kind")


def inventory_languages(spark: SparkSession, folder: str) -> DataFrame:
    return A.named_statistics(files(spark, folder), "language")


def inventory_folders(spark: SparkSession, folder: str) -> DataFrame:
    return A.directory_statistics(files(spark, folder))


def inventory_totals(spark: SparkSession, folder: str) -> DataFrame:
    return A.inventory_totals(files(spark, folder))


def repository_summary(spark: SparkSession, folder: str) -> DataFrame:
    return A.repository_summary(files(spark, folder))


def route_conflicts(spark: SparkSession, folder: str) -> DataFrame:
    return A.route_conflicts(table(spark, folder, "orders").select(F.col("o_orderpriority").alias("method"), F.col("o_custkey").alias("path")))


def profile_metrics(spark: SparkSession, folder: str) -> DataFrame:
    return A.profile_metrics(table(spark, folder, "project_runs").distinct().select(F.col("status").alias("name"), F.col("duration_ms").alias("ms")))


def measurement_aggregate(spark: SparkSession, folder: str) -> DataFrame:
    events = table(spark, folder, "events")
    status = F.when(F.col("value") > 10, "measured").when(F.col("value") > 5, "unsupported").otherwise("unavailable")
    return A.measurement_aggregate(events.select(F.col("event_type").alias("name"), status.alias("status"), "value"))


def dashboard_totals(spark: SparkSession, folder: str) -> DataFrame:
    return A.dashboard_totals(table(spark, folder, "project_runs").distinct())


def equivalent_advice(spark: SparkSession, folder: str) -> DataFrame:
    return A.equivalent_advice(table(spark, folder, "lineitem").select(F.col("l_suppkey").alias("source"), F.col("l_partkey").alias("target"), F.col("l_returnflag").alias("advice")))


QUERIES = {f.__name__: f for f in (risk_normalised, risk_hotspot_report, risk_scores, risk_heatmap, risk_trend, git_change_frequency, git_ownership, review_round_robin, evidence_confidence, finding_severities, finding_gate, finding_priority, architecture_gate, change_impact_points, inventory_kinds, inventory_languages, inventory_folders, inventory_totals, repository_summary, route_conflicts, profile_metrics, measurement_aggregate, dashboard_totals, equivalent_advice)}


def _named(column: str) -> str:
    return f"WITH {FILES_SQL} SELECT name, files, bytes, row_number() OVER (ORDER BY files DESC, bytes DESC, name)::INT AS place FROM (SELECT {column} AS name, count(*) AS files, sum(size)::BIGINT AS bytes FROM files WHERE {column} IS NOT NULL GROUP BY {column})"


SQL = {
    "risk_normalised": f"WITH {_NORMAL} SELECT subject_id, metric, cohort, value, round(normalized, 6)::DOUBLE AS normalized, basis FROM normal",
    "risk_hotspot_report": f"WITH {_NORMAL} SELECT * FROM scored ORDER BY score DESC, subject_id LIMIT 25",
    "risk_scores": f"WITH {_NORMAL} SELECT * FROM scored",
    "risk_heatmap": f"WITH {_NORMAL} SELECT metric, cohort, least(floor(normalized * 5), 4)::INT AS bin, count(*) AS subjects FROM normal GROUP BY ALL",
    "risk_trend": f"WITH {_NORMAL}, cur AS (SELECT subject_id, cohort, round(sum(weight * normalized) / sum(weight), 6) AS score, string_agg(metric, ',' ORDER BY metric) AS f FROM normal JOIN weights USING (metric) WHERE NOT (metric = 'size' AND value % 2 = 0) GROUP BY subject_id, cohort), old AS (SELECT subject_id, cohort, round(sum(weight * normalized) / sum(weight), 6) AS previous_score, string_agg(metric, ',' ORDER BY metric) AS f FROM normal JOIN weights USING (metric) WHERE NOT (metric = 'fan_out' AND value % 3 = 0) GROUP BY subject_id, cohort) SELECT subject_id, cohort, score, previous_score, CASE WHEN previous_score IS NULL THEN 'not_comparable' WHEN score > previous_score THEN 'up' WHEN score < previous_score THEN 'down' ELSE 'same' END AS direction FROM cur LEFT JOIN old USING (subject_id, cohort, f)",
    "git_change_frequency": "SELECT event_type AS project, count(DISTINCT event_id) AS commits FROM events WHERE event_type IS NOT NULL GROUP BY event_type",
    "git_ownership": "WITH c AS (SELECT event_type AS project, event_id, arg_max(user_id, ts) AS u, max((user_id IS NULL)::INT) AS unknown FROM events WHERE event_type IS NOT NULL GROUP BY 1, 2), g AS (SELECT project, u, count(*) AS n, max(unknown) AS unknown FROM c GROUP BY 1, 2) SELECT project, sum(n)::BIGINT AS commits, max(n) AS top_commits, CASE WHEN max(unknown) = 0 THEN round(max(n) / sum(n), 6) END AS concentration FROM g GROUP BY project",
    "review_round_robin": "SELECT s_nationkey, s_suppkey, turn FROM (SELECT s_nationkey, s_suppkey, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey)::INT AS turn FROM supplier) ORDER BY turn, s_nationkey LIMIT 40",
    "evidence_confidence": "WITH q AS (SELECT l_suppkey, CASE WHEN l_returnflag = 'R' THEN 'return' WHEN l_linestatus = 'F' THEN 'sale' ELSE 'other' END AS role, avg((1 - l_discount) * (1 - l_tax)) AS quality FROM lineitem GROUP BY 1, 2), r AS (SELECT s_suppkey, role, required FROM supplier, (VALUES ('sale', true), ('return', false)) v(role, required)), g AS (SELECT s_suppkey, coalesce(sum(quality * CASE WHEN required THEN 2 ELSE 1 END) / sum(CASE WHEN quality IS NOT NULL THEN CASE WHEN required THEN 2 ELSE 1 END END), 0) AS support, count(*) FILTER (required AND quality IS NULL) AS missing FROM r LEFT JOIN q ON l_suppkey = s_suppkey AND q.role = r.role GROUP BY s_suppkey) "
    "SELECT s_suppkey AS subject_id, score, CASE WHEN missing > 0 OR score < 0.4 THEN 'insufficient' WHEN score >= 0.8 THEN 'high' WHEN score >= 0.6 THEN 'medium' ELSE 'low' END AS tier, missing FROM (SELECT *, round(greatest(0, least(1, support * 0.9)), 4) AS score FROM g)",
    "finding_severities": f"WITH {_FINDINGS} SELECT severity, count(*) AS findings FROM (SELECT DISTINCT fingerprint, {_SEVERITY} AS severity FROM found) GROUP BY severity",
    "finding_gate": f"WITH {_FINDINGS}, s AS (SELECT {_SEVERITY} AS severity FROM found) SELECT count(*) AS findings, count(*) FILTER (severity IN ('high', 'critical')) AS at_threshold, count(*) FILTER (severity IN ('high', 'critical')) = 0 AS passed FROM s",
    "finding_priority": f"WITH {_FINDINGS}, t AS (SELECT l_orderkey AS id, count(*) FILTER (l_returnflag = 'R') AS traces FROM lineitem GROUP BY 1), s AS (SELECT id, {_SEVERITY} AS severity, coalesce(traces, 0) AS traces, category = 'F' AS scoped FROM found LEFT JOIN t USING (id)), w AS (SELECT id, 0.5::DOUBLE + CASE WHEN traces > 0 THEN 0.15::DOUBLE ELSE 0 END + CASE WHEN scoped THEN 0.15::DOUBLE ELSE 0 END AS weight, "
    "CASE severity WHEN 'info' THEN 0.05::DOUBLE WHEN 'low' THEN 0.15::DOUBLE WHEN 'medium' THEN 0.3::DOUBLE WHEN 'high' THEN 0.4::DOUBLE ELSE 0.5::DOUBLE END + CASE WHEN traces >= 2 THEN 0.15::DOUBLE WHEN traces > 0 THEN 0.0975::DOUBLE ELSE 0 END + CASE WHEN scoped THEN 0.15::DOUBLE ELSE 0 END AS points FROM s) SELECT id, score, CASE WHEN score >= 0.85 THEN 'critical' WHEN score >= 0.65 THEN 'high' WHEN score >= 0.45 THEN 'medium' WHEN score >= 0.2 THEN 'low' ELSE 'informational' END AS tier, coverage FROM (SELECT id, round(points / weight, 4) AS score, round(weight, 4) AS coverage FROM w)",
    "architecture_gate": "WITH f AS (SELECT o_custkey AS subject, o_orderstatus AS k, CASE left(o_orderpriority, 1) WHEN '1' THEN 3 WHEN '2' THEN 2 WHEN '3' THEN 1 ELSE 0 END AS s, floor(o_totalprice / 1000)::BIGINT AS p FROM orders), g AS (SELECT subject, least(sum(CASE WHEN k = 'P' THEN CASE WHEN s >= 2 THEN least(30, greatest(10, p // 3)) ELSE 0 END WHEN k = 'F' THEN [2, 10, 25, 40][s + 1] ELSE [2, 8, 20, 35][s + 1] END), 100)::BIGINT AS points, max(s) AS worst, count(*) FILTER (k <> 'P' OR s >= 2) AS held FROM f GROUP BY subject) SELECT c_custkey AS subject, coalesce(points, 0) AS points, CASE WHEN worst >= 2 OR points >= 70 THEN 'fail' WHEN held > 0 THEN 'warn' ELSE 'pass' END AS status FROM customer LEFT JOIN g ON subject = c_custkey",
    "change_impact_points": "WITH s AS (SELECT l_suppkey AS subject, count(DISTINCT CASE WHEN l_quantity > 48 THEN l_partkey END) AS d, count(DISTINCT CASE WHEN l_discount = 0 THEN l_partkey END) AS t, count(*) FILTER (l_returnflag = 'R' AND l_quantity > 49) AS e, count(*) FILTER (l_linenumber = 7 AND l_quantity > 45) AS j, count(DISTINCT l_linestatus) AS p, count(*) FILTER (l_quantity = 13) AS c FROM lineitem GROUP BY 1), "
    "k AS (SELECT subject, (least(25, d * 5) + least(25, t * 3) + least(20, e * 10) + least(15, j * 5) + least(10, greatest(0, p - 1) * 5) + CASE WHEN c > 0 THEN 10 ELSE 0 END)::BIGINT AS points FROM s) SELECT subject, points, CASE WHEN points >= 75 THEN 'critical' WHEN points >= 50 THEN 'high' WHEN points >= 25 THEN 'medium' ELSE 'low' END AS level FROM k",
    "inventory_kinds": _named("kind"),
    "inventory_languages": _named("language"),
    "inventory_folders": f"WITH {FILES_SQL} SELECT CASE WHEN contains(path, '/') THEN regexp_extract(path, '^(.*)/[^/]*$', 1) ELSE '.' END AS folder, count(*) AS files, sum(size)::BIGINT AS bytes FROM files WHERE path IS NOT NULL GROUP BY 1 ORDER BY bytes DESC, folder LIMIT 20",
    "inventory_totals": f"WITH {FILES_SQL} SELECT count(*) AS files, sum(size)::BIGINT AS bytes, round(avg(size), 6) AS mean_size, (SELECT id FROM files ORDER BY size DESC, id LIMIT 1) AS largest FROM files",
    "repository_summary": f"WITH {FILES_SQL} SELECT project, count(*) AS files, sum(size)::BIGINT AS bytes, count(DISTINCT kind) AS kinds FROM files WHERE project IS NOT NULL GROUP BY project UNION ALL SELECT NULL, count(*), sum(size)::BIGINT, count(DISTINCT kind) FROM files",
    "route_conflicts": "SELECT o_orderpriority AS method, o_custkey AS path, count(*) AS endpoints FROM orders GROUP BY 1, 2 HAVING count(*) > 1",
    "profile_metrics": "SELECT status AS name, count(*) AS count, round(sum(duration_ms), 3) AS total_ms, min(duration_ms) AS min_ms, max(duration_ms) AS max_ms, round(sum(duration_ms) / count(*), 3) AS avg_ms FROM (SELECT DISTINCT * FROM project_runs) GROUP BY status",
    "measurement_aggregate": "WITH s AS (SELECT event_type AS name, CASE WHEN value > 10 THEN 'measured' WHEN value > 5 THEN 'unsupported' ELSE 'unavailable' END AS status, value FROM events) SELECT name, count(*) FILTER (status = 'measured') AS measured, count(*) FILTER (status = 'unsupported') AS unsupported, count(*) FILTER (status = 'unavailable') AS unavailable, round(sum(value) FILTER (status = 'measured'), 3) AS total, min(value) FILTER (status = 'measured') AS least, max(value) FILTER (status = 'measured') AS most FROM s GROUP BY name",
    "dashboard_totals": "SELECT project, count(*) AS runs, count(*) FILTER (status = 'succeeded') AS succeeded, count(*) FILTER (status = 'failed') AS failed, round(count(*) FILTER (status = 'succeeded') / count(*), 6) AS success_rate FROM (SELECT DISTINCT * FROM project_runs) GROUP BY project",
    "equivalent_advice": "SELECT l_suppkey AS source, l_partkey AS target, array_to_string(list_sort(list(DISTINCT l_returnflag)), ',') AS advice FROM lineitem GROUP BY 1, 2",
}
