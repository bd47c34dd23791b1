"""Stores: snapshots, run history, conversations, baselines, audit logs and reports."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.operators.graph import table_digest
from graphloom.operators.ordering import globally_ranked


def _filesystem(spark: SparkSession, path: str):
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target


def _write_text(spark: SparkSession, path: str, text: str) -> None:
    """Written beside and renamed over the old one in one call, so that a reader sees the old or the new text wherever the
    file system's rename replaces atomically, as a distributed one's does."""
    files, _ = _filesystem(spark, path)
    _, beside = _filesystem(spark, f"{path}.new")
    stream = files.create(beside, True)
    stream.write(bytearray(text.encode()))
    stream.close()
    jvm, gateway = spark.sparkContext._jvm, spark.sparkContext._gateway
    rename = jvm.org.apache.hadoop.fs.Options.Rename
    options = gateway.new_array(rename, 1)
    options[0] = rename.OVERWRITE
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(files.getUri(), spark.sparkContext._jsc.hadoopConfiguration())
    context.rename(context.makeQualified(beside), context.makeQualified(jvm.org.apache.hadoop.fs.Path(path)), options)


def _read_text(spark: SparkSession, path: str) -> str:
    return "\n".join(r["value"] for r in spark.read.text(path, wholetext=True).collect())


def publish_snapshot(tables: dict[str, DataFrame], root: str, snapshot_id: str) -> dict:
    """Writes each table below ``root/snapshot_id``, a manifest of row counts and digests, and at last the pointer ``latest``."""
    spark = next(iter(tables.values())).sparkSession
    manifest = {"format": 1, "snapshot_id": snapshot_id, "tables": {}}
    for name, df in sorted(tables.items()):
        path = f"{root}/{snapshot_id}/{name}.parquet"
        df.write.mode("errorifexists").parquet(path)
        row = table_digest(spark.read.parquet(path)).first()
        manifest["tables"][name] = {"rows": row["rows"], "digest": row["digest"]}
    _write_text(spark, f"{root}/{snapshot_id}/manifest.json", json.dumps(manifest, sort_keys=True))
    _write_text(spark, f"{root}/latest", snapshot_id)
    return manifest


def load_snapshot(spark: SparkSession, root: str, snapshot_id: str | None = None, verify: bool = True) -> dict[str, DataFrame]:
    """The tables of a snapshot, by default the latest. A table whose digest is not the manifest's is an error."""
    own = snapshot_id or _read_text(spark, f"{root}/latest").strip()
    manifest = json.loads(_read_text(spark, f"{root}/{own}/manifest.json"))
    tables = {name: spark.read.parquet(f"{root}/{own}/{name}.parquet") for name in manifest["tables"]}
    for name, df in tables.items() if verify else ():
        row = table_digest(df).first()
        if {"rows": row["rows"], "digest": row["digest"]} != manifest["tables"][name]:
            raise ValueError(f"table {name} of snapshot {own} differs from its manifest")
    return tables


def history_page(runs: DataFrame, limit: int, offset: int = 0) -> DataFrame:
    """One page of the run history, the newest id first."""
    return runs.orderBy(F.col("id").desc()).offset(offset).limit(limit)


def eligible_runs(runs: DataFrame, exclusions: DataFrame) -> DataFrame:
    """Runs that are not excluded."""
    return runs.join(exclusions.select(F.col("analysis_run_id").alias("id")).distinct(), "id", "left_anti")


def pruned(runs: DataFrame, keep: int) -> DataFrame:
    """The newest ``keep`` runs: what remains after pruning. Two aggregates over ids, no sort of whole rows."""
    ids = runs.select("id").distinct().orderBy(F.col("id").desc()).limit(keep)
    edge = ids.agg(F.min("id").alias("_edge"))
    return runs.join(F.broadcast(edge), runs["id"] >= edge["_edge"]).drop("_edge")


def appended_messages(held: DataFrame, new: DataFrame) -> DataFrame:
    """``new(conversation_id, seq, ...)`` with ``position``: after the last position of its conversation, from 0 in a new one.

    Ranks come from one range-partitioned sort, so a conversation of any length is spread over all tasks.
    """
    last = held.groupBy("conversation_id").agg(F.max("position").alias("_last"))
    ranked = globally_ranked(new, ["conversation_id", "seq"], "_rank")
    first = ranked.groupBy("conversation_id").agg(F.min("_rank").alias("_first"))
    placed = ranked.join(first.join(last, "conversation_id", "left"), "conversation_id")
    return placed.withColumn("position", (F.coalesce("_last", F.lit(-1)) + 1 + F.col("_rank") - F.col("_first")).cast("int")).drop("_last", "_first", "_rank")


def json_lines(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``(line)``: each row as a JSON object of the columns, nulls kept."""
    return rows.select(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}).alias("line"))


#: Levels of the report format by severity.
SARIF_LEVELS = {"critical": "error", "high": "error", "medium": "warning", "low": "note", "info": "note"}


def sarif_results(findings: DataFrame) -> DataFrame:
    """``(result)``: each finding ``(rule_id, severity, message, path, line, fingerprint)`` as a SARIF result object."""
    level = F.lit("warning")
    for name, value in SARIF_LEVELS.items():
        level = F.when(F.col("severity") == name, value).otherwise(level)
    place = F.struct(F.struct(F.struct(F.col("path").alias("uri")).alias("artifactLocation"), F.struct(F.col("line").alias("startLine")).alias("region")).alias("physicalLocation"))
    result = F.struct(F.col("rule_id").alias("ruleId"), level.alias("level"), F.struct(F.col("message").alias("text")).alias("message"), F.array(place).alias("locations"), F.struct(F.col("fingerprint").alias("primary")).alias("partialFingerprints"))
    return findings.select(F.to_json(result).alias("result"))


def sarif_report(findings: DataFrame, tool: str, limit: int) -> str:
    """A whole SARIF document of the first ``limit`` findings by rule, path and line; for reports that a person reads."""
    first = findings.orderBy("rule_id", "path", "line", "fingerprint").limit(limit)
    results = [json.loads(r["result"]) for r in sarif_results(first).collect()]
    rules = sorted({r["ruleId"] for r in results})
    return json.dumps({"version": "2.1.0", "runs": [{"tool": {"driver": {"name": tool, "rules": [{"id": r} for r in rules]}}, "results": results}]}, sort_keys=True)


def dashboard(totals: DataFrame, limit: int = 100) -> str:
    """A small HTML page of per-project totals, the projects with the most failures first."""
    import html

    rows = totals.orderBy(F.col("failed").desc(), "project").limit(limit).collect()
    names = totals.columns
    cells = lambda tag, values: "".join(f"<{tag}>{html.escape(str(v))}</{tag}>" for v in values)
    return "<table><tr>" + cells("th", names) + "</tr>" + "".join("<tr>" + cells("td", r) + "</tr>" for r in rows) + "</table>"


def audit_entries(last_digest: str | None, first: int, payloads: Sequence[str]) -> list[tuple[int, str, str, str]]:
    """``(seq, link, payload, digest)`` of new entries of an audit log: each digest covers the one before, so the log is a chain.

    Appending is sequential by nature and small; a whole log is verified in parallel by ``chain_breaks``.
    """
    import hashlib

    rows, link = [], last_digest or ""
    for k, payload in enumerate(payloads, first):
        digest = hashlib.sha256(f"{link}\n{k}\n{payload}".encode()).hexdigest()
        rows.append((k, link, payload, digest))
        link = digest
    return rows
