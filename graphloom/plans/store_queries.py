"""Data flow, ingest, stores and streams on the driver's tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom.functions import java_numbers as J
from graphloom.operators import aggregates as A
from graphloom.operators import flow as W
from graphloom.plans.adapters import FILES_SQL, files
from graphloom.session import shared_dir
from graphloom.sources import code as C
from graphloom.sources import inventory as V
from graphloom.sources import stores as T
from graphloom.sources.tables import table
from graphloom.streaming import watch as H


def _blocks(spark: SparkSession, folder: str) -> DataFrame:
    """Each order as a method, its lines in order as blocks."""
    lineitem = table(spark, folder, "lineitem", ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"])
    place = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey"))
    return lineitem.select(F.col("l_orderkey").alias("method"), place.cast("bigint").alias("block"), "l_partkey", "l_suppkey").select(
        "method", "block", F.col("block").alias("position"), F.array(F.concat(F.lit("v"), F.col("l_partkey") % 3)).alias("defines"), F.array(F.concat(F.lit("v"), F.col("l_suppkey") % 3)).alias("uses"), "l_partkey", "l_suppkey"
    )


def _control_flow(blocks: DataFrame) -> DataFrame:
    """Each block goes on to the next; some also branch over it, and some go back two blocks."""
    at, ways = F.col("block"), (F.lit(True), F.col("l_suppkey") % 3 == 0, F.col("l_partkey") % 4 == 0)
    targets = F.array(*(F.when(way, at + step) for way, step in zip(ways, (1, 2, -2))))
    edges = blocks.select("method", at.alias("source"), F.explode(targets).alias("target")).where("target is not null")
    return edges.join(blocks.select("method", at.alias("target")), ["method", "target"], "left_semi").select("method", "source", "target")


def _flow(spark: SparkSession, folder: str, analysis: str) -> DataFrame:
    blocks = _blocks(spark, folder)
    return W.analyse(blocks, _control_flow(blocks), analysis)


def flow_reaching(spark: SparkSession, folder: str) -> DataFrame:
    return _flow(spark, folder, "reaching_definitions")


def flow_liveness(spark: SparkSession, folder: str) -> DataFrame:
    return _flow(spark, folder, "liveness").select("method", "block", "variable")


def flow_def_use(spark: SparkSession, folder: str) -> DataFrame:
    return _flow(spark, folder, "def_use")


def flow_dead_assignments(spark: SparkSession, folder: str) -> DataFrame:
    return _flow(spark, folder, "dead_assignments").select("method", "block", "variable")


def flow_dominators(spark: SparkSession, folder: str) -> DataFrame:
    return _flow(spark, folder, "dominators").select("method", "block", F.col("other").alias("dominator"))


def flow_order(spark: SparkSession, folder: str) -> DataFrame:
    return _flow(spark, folder, "reverse_postorder").select("method", "block", F.col("other").alias("place"))


def sequential_taint(spark: SparkSession, folder: str) -> DataFrame:
    events = table(spark, folder, "events")
    steps = events.select(F.col("user_id").alias("program"), F.col("event_id").alias("position"), F.concat(F.lit("x"), F.col("event_id")).alias("target"), F.concat(F.lit("api."), "event_type").alias("call"), F.array().cast("array<string>").alias("arguments"))
    return W.sequential_taint(steps, (".signup", ".purchase"), (".error",))


def constant_values(spark: SparkSession, folder: str) -> DataFrame:
    """Each order as a program: a line multiplies its part by a variable of the lines before, or starts one anew."""
    blocks = _blocks(spark, folder)
    variable = F.concat(F.lit("v"), F.col("l_suppkey") % 3)
    fresh = F.col("l_suppkey") % 2 == 0
    return W.constant_values(blocks.select(
        F.col("method").alias("program"), "position", F.col("defines")[0].alias("target"), F.when(fresh, "=").otherwise("*").alias("op"), (F.col("l_partkey") * 100003).cast("string").alias("left"), F.when(~fresh, variable).alias("right")
    ))


def wrapped_products(spark: SparkSession, folder: str) -> DataFrame:
    lineitem = table(spark, folder, "lineitem")
    return lineitem.groupBy("l_orderkey").agg(F.sum("l_partkey").alias("n")).select("l_orderkey", J.wrapped(F.col("n") * 1000003, 32).alias("value"))


def intervals(spark: SparkSession, folder: str) -> DataFrame:
    part = table(spark, folder, "part")
    size, price = F.col("p_size").cast("double"), F.col("p_retailprice")
    low, high, empty = J.interval_meet(size, size * 30, F.lit(200.0), price - 400)
    held = J.interval_contains(size, size * 30, F.col("p_size") % 2 == 0, F.lit(False), price / 10)
    return part.select("p_partkey", low.alias("low"), high.alias("high"), empty.alias("empty"), held.alias("held"))


def nullability(spark: SparkSession, folder: str) -> DataFrame:
    """Each user as a method whose events in order set one of three variables, or copy the next of them."""
    own, other = (F.concat(F.lit("a"), (F.col("event_id") + k) % 3) for k in (0, 1))
    source = F.when(F.col("event_type") == "error", "null").when(F.col("event_type") == "click", "nonnull").when(F.col("event_type") == "view", other).otherwise("unknown")
    return W.nullability(table(spark, folder, "events").select(F.col("user_id").alias("method"), F.col("event_id").alias("position"), own.alias("variable"), source.alias("source")))


def _documents(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").select(F.col("doc_id").alias("id"), "text")


def ingest_code_blocks(spark: SparkSession, folder: str) -> DataFrame:
    return C.code_blocks(_documents(spark, folder)).select("id", "block", "language", F.sha2("code", 256).alias("code"))


def ingest_declarations(spark: SparkSession, folder: str) -> DataFrame:
    return C.declarations(C.code_blocks(_documents(spark, folder)))


#: What is put behind a document's path, by its number.
_SUFFIXES = ("", ".java", ".XML", ".jar", ".class", ".png", ".rst", ".none", "/pom.xml", ".tsx")


def ingest_classified(spark: SparkSession, folder: str) -> DataFrame:
    front = F.when(F.col("id") % 3 == 0, "src/test/").when(F.col("id") % 3 == 1, "Build/").otherwise("")
    suffix = F.element_at(F.array(*(F.lit(x) for x in _SUFFIXES)), (F.col("id") % len(_SUFFIXES) + 1).cast("int"))
    paths = files(spark, folder).where("path is not null").select("id", F.concat(front, "path", suffix).alias("path"))
    return V.classified(paths).withColumn("test", V.is_test_path(F.col("path"))).groupBy("language", "kind", "test").agg(F.count("*").alias("files"))


def project_fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    return V.project_fingerprints(files(spark, folder))


def history_page(spark: SparkSession, folder: str) -> DataFrame:
    runs = table(spark, folder, "analysis_runs", ["id", "workspace_fingerprint", "succeeded"]).distinct()
    return T.history_page(runs, 20, 10)


def history_eligible(spark: SparkSession, folder: str) -> DataFrame:
    runs = table(spark, folder, "analysis_runs", ["id", "succeeded"]).distinct()
    failed = table(spark, folder, "project_runs").where("status = 'failed'").select("analysis_run_id")
    return T.eligible_runs(runs, failed)


def history_pruned(spark: SparkSession, folder: str) -> DataFrame:
    runs = table(spark, folder, "analysis_runs", ["id", "succeeded"]).distinct()
    return T.pruned(runs, 100)


def appended_messages(spark: SparkSession, folder: str) -> DataFrame:
    held = table(spark, folder, "conversation_messages").where("conversation_id is not null")
    new = table(spark, folder, "conversation_turns").select("conversation_id", F.col("id").alias("seq")).distinct()
    return T.appended_messages(held, new).select("conversation_id", "seq", "position")


def audit_breaks(spark: SparkSession, folder: str) -> DataFrame:
    events = table(spark, folder, "events").select("event_id", F.sha2(F.col("event_id").cast("string"), 256).alias("digest"), F.when(F.col("value") > 20, F.lit("?")).otherwise(F.sha2((F.col("event_id") - 1).cast("string"), 256)).alias("link"))
    return A.chain_breaks(events, "event_id", "link", "digest").select("event_id")


def report_lines(spark: SparkSession, folder: str) -> DataFrame:
    return T.json_lines(table(spark, folder, "supplier"), ["s_suppkey", "s_name", "s_nationkey"])


def report_sarif(spark: SparkSession, folder: str) -> DataFrame:
    supplier = table(spark, folder, "supplier").select(F.lit("R1").alias("rule_id"), F.when(F.col("s_acctbal") > 5000, "high").otherwise("low").alias("severity"), F.col("s_name").alias("message"), F.lit("src/a.java").alias("path"), F.col("s_nationkey").alias("line"), F.col("s_suppkey").cast("string").alias("fingerprint"))
    return T.sarif_results(supplier)


def watch_poll(spark: SparkSession, folder: str) -> DataFrame:
    every = files(spark, folder).where("path is not null").groupBy("path").agg(F.max("sha256").alias("sha256"), F.max("kind").alias("kind"))
    after = every.where("kind <> 'runbook'").select(F.when(F.col("kind") == "adr", F.concat(F.lit("moved/"), "path")).otherwise(F.col("path")).alias("path"), F.when(F.col("kind") == "readme", F.lit("new")).otherwise(F.col("sha256")).alias("sha256"))
    return H.poll_events(every.select("path", "sha256"), after)


def _file_events(events: DataFrame) -> DataFrame:
    kind = F.when(F.col("event_type") == "signup", "created").when(F.col("event_type") == "error", "deleted").otherwise("modified")
    return events.select("ts", F.lit("p").alias("project"), F.concat(F.lit("f"), "user_id").alias("path"), kind.alias("kind"), "event_id")


def watch_debounced(spark: SparkSession, folder: str) -> DataFrame:
    """The events lie hours apart, so the quiet period is hours too."""
    found = H.debounced(_file_events(table(spark, folder, "events")), "6 hours")
    return found.withColumn("at", F.date_format("at", "yyyy-MM-dd HH:mm:ss"))


def _streamed(spark: SparkSession, folder: str, plan, mode: str = "append") -> DataFrame:
    """The rows that ``plan`` of the events as a stream gives, run to its end with state and output in the shared folder."""
    schema = table(spark, folder, "events").schema
    own = f"{shared_dir(spark).rstrip('/')}/stream-{uuid.uuid4().hex}"
    stream = plan(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1000).parquet(f"{folder.rstrip('/')}/events.parque[t]"))  # a pattern, so that it may be a file or a folder
    H.run_to_end(stream, lambda df, n: df.write.mode("append").parquet(f"{own}/rows"), f"{own}/state", mode)
    return spark.read.schema(stream.schema).parquet(f"{own}/rows")


def stream_rates(spark: SparkSession, folder: str) -> DataFrame:
    """All windows with their last counts: updates of windows still open count, and no row of a table is late, whatever its file."""
    updates = _streamed(spark, folder, lambda s: H.event_rates(_file_events(s), "1 day", "36500 days"), "update")
    return updates.groupBy("start", "kind").agg(F.max("events").alias("events")).select(F.col("start").cast("string").alias("start"), "kind", "events")


def batch_rates(spark: SparkSession, folder: str) -> DataFrame:
    return H.event_rates(_file_events(table(spark, folder, "events")), "1 day").select(F.col("start").cast("string").alias("start"), "kind", "events")


def _observations(events: DataFrame) -> DataFrame:
    return events.select(F.concat(F.lit("plugin"), F.col("user_id")).alias("plugin"), F.col("ts").alias("at"), F.col("event_id").alias("seq"), (F.col("event_type") != "error").alias("success"))


def plugin_health(spark: SparkSession, folder: str) -> DataFrame:
    return H.health(_observations(table(spark, folder, "events")))


def lease_states(spark: SparkSession, folder: str) -> DataFrame:
    kind = F.when((F.col("event_type") == "signup") & (F.col("event_id") % 23 == 0), "complete").when(F.col("event_type") == "error", "fail").when(F.col("event_type") == "click", "lease").otherwise("heartbeat")
    log = table(spark, folder, "events").select(F.concat(F.lit("job"), F.col("user_id")).alias("job"), F.col("event_id").cast("double").alias("at_s"), F.col("event_id").alias("seq"), kind.alias("kind"), F.concat(F.lit("w"), F.col("event_id") % 5).alias("worker"))
    return H.lease_states(log, 10_000.0, 500.0, 4)


QUERIES = {f.__name__: f for f in (flow_reaching, flow_liveness, flow_def_use, flow_dead_assignments, flow_dominators, flow_order, sequential_taint, constant_values, wrapped_products, intervals, nullability, ingest_code_blocks, ingest_declarations, ingest_classified, project_fingerprints, history_page, history_eligible, history_pruned, appended_messages, audit_breaks, report_lines, report_sarif, watch_poll, watch_debounced, stream_rates, batch_rates, plugin_health, lease_states)}

_B = (
    "b AS MATERIALIZED (SELECT l_orderkey AS method, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS block, 'v' || (l_partkey % 3) AS d, 'v' || (l_suppkey % 3) AS u, l_partkey AS part, l_suppkey AS supp FROM lineitem), "
    "e AS MATERIALIZED (SELECT b.method, b.block AS s, t.block AS t, b.d, b.u FROM b JOIN b t ON t.method = b.method AND (t.block = b.block + 1 OR (b.supp % 3 = 0 AND t.block = b.block + 2) OR (b.part % 4 = 0 AND t.block = b.block - 2)))"
)
_REACHING = _B + ", r AS (SELECT method, t AS block, d AS variable, s AS other FROM e UNION SELECT e.method, e.t, r.variable, r.other FROM r JOIN e ON e.method = r.method AND e.s = r.block AND e.d <> r.variable)"
_LIVE = _B + ", live AS (SELECT method, block, u AS variable FROM b UNION SELECT e.method, e.s, l.variable FROM live l JOIN e ON e.method = l.method AND e.t = l.block AND e.d <> l.variable)"
_DOMINATED = _B + ", reach AS (SELECT DISTINCT method, 1::BIGINT AS block FROM b UNION SELECT e.method, e.t FROM reach r JOIN e ON e.method = r.method AND e.s = r.block), past AS (SELECT method, block AS a, 1::BIGINT AS block FROM b WHERE block > 1 UNION SELECT e.method, p.a, e.t FROM past p JOIN e ON e.method = p.method AND e.s = p.block AND e.t <> p.a)"
_STEPS = "s AS MATERIALIZED (SELECT program, position, target, op, a, right_, row_number() OVER (PARTITION BY program ORDER BY position) AS k FROM (SELECT l_orderkey AS program, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS position, l_partkey % 3 AS target, CASE WHEN l_suppkey % 2 = 0 THEN '=' ELSE '*' END AS op, l_partkey * 100003 AS a, l_suppkey % 3 AS right_ FROM lineitem))"
_WRAP = "((({} + 2147483648) % 4294967296) + 4294967296) % 4294967296 - 2147483648"
_EVERY = "every AS (SELECT path, max(sha256) AS sha256, max(kind) AS kind FROM files WHERE path IS NOT NULL GROUP BY path)"
_LANGUAGE = "CASE WHEN regexp_matches(ltrim({0}), '^(?:public|private|protected|final|abstract|package|import java|class \\w+ (?:[{{]|extends|implements))') THEN 'java' WHEN regexp_matches(ltrim({0}), '^(?:def |class \\w+[:(]|from \\w|import \\w)') THEN 'python' WHEN regexp_matches(ltrim({0}), '^(?i:select|insert|update|delete|create|with)\\s') THEN 'sql' WHEN starts_with(ltrim({0}), '$ ') THEN 'shell' WHEN regexp_matches(ltrim({0}), '^[\\[{{]') THEN 'json' WHEN regexp_matches(ltrim({0}), '^(?:export |interface \\w+|const \\w+|function \\w+)') THEN 'typescript' ELSE 'unknown' END"
SQL = {
    "flow_reaching": f"WITH RECURSIVE {_REACHING} SELECT * FROM r",
    "flow_liveness": f"WITH RECURSIVE {_LIVE} SELECT * FROM live",
    "flow_def_use": f"WITH RECURSIVE {_REACHING} SELECT r.* FROM r JOIN b ON b.method = r.method AND b.block = r.block AND b.u = r.variable",
    "flow_dead_assignments": f"WITH RECURSIVE {_LIVE} SELECT b.method, b.block, b.d AS variable FROM b WHERE NOT EXISTS (SELECT 1 FROM e JOIN live l ON l.method = e.method AND l.block = e.t WHERE e.method = b.method AND e.s = b.block AND l.variable = b.d)",
    "flow_dominators": f"WITH RECURSIVE {_DOMINATED} SELECT r.method, r.block, x.block AS dominator FROM reach r JOIN reach x ON x.method = r.method LEFT JOIN past p ON p.method = r.method AND p.a = x.block AND p.block = r.block WHERE x.block = r.block OR x.block = 1 OR p.a IS NULL",
    "sequential_taint": "SELECT user_id AS program, event_id AS position, 'x' || event_id AS target FROM events WHERE event_type IN ('signup', 'purchase')",
    "constant_values": f"WITH RECURSIVE {_STEPS}, f AS (SELECT DISTINCT program, 0::BIGINT AS k, [NULL, NULL, NULL]::BIGINT[] AS held, [false, false, false] AS set_ FROM s UNION ALL SELECT s.program, s.k, list_transform(f.held, lambda x, i: CASE WHEN i = s.target + 1 THEN CASE WHEN s.op = '=' THEN s.a ELSE {_WRAP.format('(s.a::HUGEINT * f.held[s.right_ + 1])')} END::BIGINT ELSE x END), list_transform(f.set_, lambda x, i: x OR i = s.target + 1) FROM f JOIN s ON s.program = f.program AND s.k = f.k + 1), z AS (SELECT program, held, set_ FROM f QUALIFY row_number() OVER (PARTITION BY program ORDER BY k DESC) = 1) SELECT program, 'v' || i AS target, held[i + 1] AS value FROM z, range(3) t(i) WHERE set_[i + 1]",
    "wrapped_products": "SELECT l_orderkey, ((((sum(l_partkey)::BIGINT * 1000003 + 2147483648) % 4294967296) + 4294967296) % 4294967296 - 2147483648)::BIGINT AS value FROM lineitem GROUP BY 1",
    "intervals": "SELECT p_partkey, greatest(p_size::DOUBLE, 200) AS low, least(p_size::DOUBLE * 30, p_retailprice - 400) AS high, greatest(p_size::DOUBLE, 200) > least(p_size::DOUBLE * 30, p_retailprice - 400) AS empty, CASE WHEN p_size % 2 = 0 THEN p_retailprice / 10 > p_size ELSE p_retailprice / 10 >= p_size END AND p_retailprice / 10 <= p_size::DOUBLE * 30 AS held FROM part",
    "nullability": "WITH RECURSIVE s AS MATERIALIZED (SELECT user_id AS method, event_type AS t, event_id % 3 AS v, (event_id + 1) % 3 AS w, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM events), f AS (SELECT DISTINCT method, 0::BIGINT AS k, [NULL, NULL, NULL]::VARCHAR[] AS held FROM s UNION ALL SELECT s.method, s.k, list_transform(f.held, lambda x, i: CASE WHEN i = s.v + 1 THEN CASE s.t WHEN 'error' THEN 'null' WHEN 'click' THEN 'nonnull' WHEN 'view' THEN coalesce(f.held[s.w + 1], 'unknown') ELSE 'unknown' END ELSE x END) FROM f JOIN s ON s.method = f.method AND s.k = f.k + 1), z AS (SELECT method, held FROM f QUALIFY row_number() OVER (PARTITION BY method ORDER BY k DESC) = 1) SELECT method, 'a' || i AS variable, held[i + 1] AS state FROM z, range(3) t(i) WHERE held[i + 1] IS NOT NULL",
    "ingest_code_blocks": f"WITH d AS (SELECT doc_id, replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)) AS bare FROM documents), t AS (SELECT doc_id, CASE WHEN NOT contains(bare, '```') AND {_LANGUAGE.format('bare')} <> 'unknown' THEN [bare] ELSE regexp_extract_all(bare, '(?s)```[A-Za-z0-9]*\\n(.*?)\\n```', 1) END AS codes FROM d) SELECT doc_id AS id, (i - 1)::INT AS block, {_LANGUAGE.format('codes[i]')} AS language, sha256(codes[i]) AS code FROM t, range(1, 1000) r(i) WHERE i <= len(codes)",
    "ingest_classified": "SELECT CASE WHEN k = 1 THEN 'Java' WHEN k = 9 THEN 'TypeScript' END AS language, CASE WHEN g THEN 'generated' ELSE ['documentation', 'source', 'config', 'archive', 'binary', 'asset', 'documentation', 'unknown', 'build', 'source'][k + 1] END AS kind, t AS test, count(*) AS files FROM (SELECT doc_id % 10 AS k, doc_id % 3 = 1 AS g, doc_id % 3 = 0 AS t FROM documents WHERE doc_path IS NOT NULL) GROUP BY ALL",
    "project_fingerprints": f"WITH {FILES_SQL} SELECT project, count(*) AS files, sha256(count(*) || '|' || sum(('0x' || substr(sha256(concat_ws(chr(31), path, sha256)), 1, 15))::BIGINT::HUGEINT)) AS fingerprint FROM files GROUP BY project",
    "history_page": "SELECT DISTINCT id, workspace_fingerprint, succeeded FROM analysis_runs ORDER BY id DESC LIMIT 20 OFFSET 10",
    "history_eligible": "SELECT DISTINCT id, succeeded FROM analysis_runs WHERE id NOT IN (SELECT analysis_run_id FROM project_runs WHERE status = 'failed')",
    "history_pruned": "SELECT DISTINCT id, succeeded FROM analysis_runs WHERE id IN (SELECT DISTINCT id FROM analysis_runs ORDER BY id DESC LIMIT 100)",
    "appended_messages": "WITH h AS (SELECT conversation_id, max(position) AS last FROM conversation_messages GROUP BY 1), n AS (SELECT DISTINCT conversation_id, id AS seq FROM conversation_turns) SELECT n.conversation_id, seq, (coalesce(last, -1) + row_number() OVER (PARTITION BY n.conversation_id ORDER BY seq))::INT AS position FROM n LEFT JOIN h ON h.conversation_id = n.conversation_id",
    "audit_breaks": "SELECT event_id FROM events WHERE value > 20 AND event_id > (SELECT min(event_id) FROM events)",
    "report_lines": "SELECT '{\"s_suppkey\":' || s_suppkey || ',\"s_name\":\"' || s_name || '\",\"s_nationkey\":' || s_nationkey || '}' AS line FROM supplier",
    "report_sarif": "SELECT '{\"ruleId\":\"R1\",\"level\":\"' || CASE WHEN s_acctbal > 5000 THEN 'error' ELSE 'note' END || '\",\"message\":{\"text\":\"' || s_name || '\"},\"locations\":[{\"physicalLocation\":{\"artifactLocation\":{\"uri\":\"src/a.java\"},\"region\":{\"startLine\":' || s_nationkey || '}}}],\"partialFingerprints\":{\"primary\":\"' || s_suppkey || '\"}}' AS result FROM supplier",
    "watch_poll": f"WITH {FILES_SQL}, {_EVERY}, gone AS (SELECT path, sha256, row_number() OVER (PARTITION BY sha256 ORDER BY path) AS n FROM every WHERE kind IN ('adr', 'runbook')), come AS (SELECT 'moved/' || path AS path, sha256, row_number() OVER (PARTITION BY sha256 ORDER BY path) AS n FROM every WHERE kind = 'adr'), m AS (SELECT come.path, gone.path AS previous FROM come JOIN gone USING (sha256, n)) SELECT path, 'renamed' AS kind, previous AS previous_path FROM m UNION ALL SELECT path, 'modified', NULL FROM every WHERE kind = 'readme' UNION ALL SELECT path, 'deleted', NULL FROM gone WHERE path NOT IN (SELECT previous FROM m)",
    "watch_debounced": "WITH e AS (SELECT ts, 'f' || user_id AS path, CASE event_type WHEN 'signup' THEN 'created' WHEN 'error' THEN 'deleted' ELSE 'modified' END AS kind FROM events), n AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY path ORDER BY ts, kind) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM e), g AS (SELECT *, sum(new) OVER (PARTITION BY path ORDER BY ts, kind ROWS UNBOUNDED PRECEDING) AS period FROM n), f AS (SELECT path, list(kind ORDER BY ts, kind) AS kinds, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS \"at\" FROM g GROUP BY path, period), k AS (SELECT path, list_reduce(list_prepend('none', kinds), lambda h, x: CASE WHEN h = 'created' AND x = 'modified' THEN 'created' WHEN h = 'created' AND x = 'deleted' THEN 'none' ELSE x END) AS kind, len(kinds)::INT AS events, \"at\" FROM f) SELECT 'p' AS project, * FROM k WHERE kind <> 'none'",
    "stream_rates": "SELECT strftime(time_bucket(INTERVAL 1 DAY, ts), '%Y-%m-%d %H:%M:%S') AS start, CASE event_type WHEN 'signup' THEN 'created' WHEN 'error' THEN 'deleted' ELSE 'modified' END AS kind, count(*) AS events FROM events GROUP BY 1, 2",
    "batch_rates": "SELECT strftime(time_bucket(INTERVAL 1 DAY, ts), '%Y-%m-%d %H:%M:%S') AS start, CASE event_type WHEN 'signup' THEN 'created' WHEN 'error' THEN 'deleted' ELSE 'modified' END AS kind, count(*) AS events FROM events GROUP BY 1, 2",
    "plugin_health": "WITH o AS (SELECT 'plugin' || user_id AS plugin, event_id, ts, event_type <> 'error' AS ok FROM events), l AS (SELECT plugin, max((ts, event_id)) FILTER (NOT ok) AS bad, max((ts, event_id)) FILTER (ok) AS good, count(*) AS probes FROM o GROUP BY 1), c AS (SELECT plugin, any_value(probes) AS probes, bool_or(bad IS NULL) AS never, count(*) FILTER (NOT ok AND (good IS NULL OR (ts, event_id) > good)) AS consecutive_failures, count(*) FILTER (ok AND (bad IS NULL OR (ts, event_id) > bad)) AS consecutive_successes FROM o JOIN l USING (plugin) GROUP BY plugin) SELECT plugin, CASE WHEN consecutive_failures >= 3 THEN 'unhealthy' WHEN consecutive_failures > 0 THEN 'degraded' WHEN never OR consecutive_successes >= 2 THEN 'healthy' ELSE 'degraded' END AS status, consecutive_failures, consecutive_successes, probes FROM c",
    "lease_states": "WITH l AS (SELECT 'job' || user_id AS job, event_id, CASE WHEN event_type = 'signup' AND event_id % 23 = 0 THEN 'complete' WHEN event_type = 'error' THEN 'fail' WHEN event_type = 'click' THEN 'lease' ELSE 'heartbeat' END AS kind, 'w' || (event_id % 5) AS worker FROM events), g AS (SELECT job, bool_or(kind = 'complete') AS done, count(*) FILTER (kind = 'lease') AS attempt, arg_max(kind, event_id) FILTER (kind IN ('lease', 'fail')) AS turn, arg_max(worker, event_id) FILTER (kind = 'lease') AS worker, max(event_id) FILTER (kind IN ('lease', 'heartbeat')) AS alive FROM l GROUP BY job) SELECT job, CASE WHEN done THEN 'succeeded' WHEN turn = 'fail' AND attempt >= 4 THEN 'failed' WHEN turn = 'fail' OR turn IS NULL THEN 'pending' WHEN alive + 500 <= 10000 THEN 'expired' ELSE 'leased' END AS state, worker, attempt FROM g",
}
