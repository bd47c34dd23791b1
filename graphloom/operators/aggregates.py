"""Inventory, report and measurement aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.operators.ordering import globally_ranked


def named_statistics(files: DataFrame, name: str) -> DataFrame:
    """``(name, files, bytes, place)`` per value of a column; nulls are dropped; most files first, then bytes, then name."""
    counted = files.where(F.col(name).isNotNull()).groupBy(F.col(name).alias("name")).agg(F.count("*").alias("files"), F.sum("size").alias("bytes"))
    ranked = globally_ranked(counted.withColumns({"_1": -F.col("files"), "_2": -F.col("bytes")}), ["_1", "_2", "name"], "place").drop("_1", "_2")
    return ranked.withColumn("place", (F.col("place") + 1).cast("int"))


def parent_folder(path: Column) -> Column:
    """The direct parent; ``.`` for a path without a folder."""
    folder = F.regexp_extract(path, r"^(.*)/[^/]*$", 1)
    return F.when(path.contains("/"), folder).otherwise(".")


def directory_statistics(files: DataFrame, k: int = 20) -> DataFrame:
    """The ``k`` folders of the most bytes, by direct parent: ``(folder, files, bytes)``."""
    counted = files.where(F.col("path").isNotNull()).groupBy(parent_folder(F.col("path")).alias("folder")).agg(F.count("*").alias("files"), F.sum("size").alias("bytes"))
    return counted.orderBy(F.col("bytes").desc(), "folder").limit(k)


def inventory_totals(files: DataFrame) -> DataFrame:
    """One row: files, bytes, mean size (0 if empty), and the largest file, of several the first by id."""
    return files.agg(
        F.count("*").alias("files"),
        F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"),
        F.round(F.coalesce(F.avg("size"), F.lit(0.0)), 6).alias("mean_size"),
        F.max_by("id", F.struct(F.col("size"), -F.col("id"))).alias("largest"),
    )


def repository_summary(files: DataFrame) -> DataFrame:
    """Per project and then over all: ``(project, files, bytes, kinds)``; the row of all has a null project."""
    per = files.where(F.col("project").isNotNull()).groupBy("project").agg(F.count("*").alias("files"), F.sum("size").alias("bytes"), F.count_distinct("kind").alias("kinds"))
    whole = files.agg(F.lit(None).cast("string").alias("project"), F.count("*").alias("files"), F.sum("size").alias("bytes"), F.count_distinct("kind").alias("kinds"))
    return per.unionByName(whole)


def severity_counts(findings: DataFrame) -> DataFrame:
    """``(severity, findings)``: each fingerprint once."""
    return findings.dropDuplicates(["fingerprint"]).groupBy("severity").agg(F.count("*").alias("findings"))


def route_conflicts(endpoints: DataFrame) -> DataFrame:
    """``(method, path, endpoints)`` of routes that more than one endpoint serves."""
    return endpoints.groupBy("method", "path").agg(F.count("*").alias("endpoints")).where("endpoints > 1")


def profile_metrics(spans: DataFrame) -> DataFrame:
    """``(name, count, total_ms, min_ms, max_ms, avg_ms)`` per name."""
    total = F.sum("ms")
    return spans.groupBy("name").agg(F.count("*").alias("count"), F.round(total, 3).alias("total_ms"), F.min("ms").alias("min_ms"), F.max("ms").alias("max_ms"), F.round(total / F.count("*"), 3).alias("avg_ms"))


def measurement_aggregate(samples: DataFrame) -> DataFrame:
    """``(name, measured, unsupported, unavailable, total, least, most)`` of ``samples(name, status, value)``; only measured values are summed."""
    value = F.when(F.col("status") == "measured", F.col("value"))
    return samples.groupBy("name").agg(*(F.count_if(F.col("status") == s).alias(s) for s in ("measured", "unsupported", "unavailable")), F.round(F.sum(value), 3).alias("total"), F.min(value).alias("least"), F.max(value).alias("most"))


def dashboard_totals(runs: DataFrame) -> DataFrame:
    """``(project, runs, succeeded, failed, success_rate)`` of ``runs(project, status)``."""
    ok = F.count_if(F.col("status") == "succeeded")
    return runs.groupBy("project").agg(F.count("*").alias("runs"), ok.alias("succeeded"), F.count_if(F.col("status") == "failed").alias("failed"), F.round(ok / F.count("*"), 6).alias("success_rate"))


def equivalent_advice(seams: DataFrame) -> DataFrame:
    """``(source, target, advice)``: all advice for one seam, sorted, without repeats."""
    return seams.groupBy("source", "target").agg(F.array_join(F.array_sort(F.collect_set("advice")), ",").alias("advice"))


def chain_breaks(records: DataFrame, order: str, link: str, digest: str) -> DataFrame:
    """Rows of an append-only log whose ``link`` is not the ``digest`` of the row before; ``order`` is the row's number.

    Joins on consecutive numbers, so the log is verified in parallel. The first row has nothing before it.
    """
    before = records.select((F.col(order) + 1).alias(order), F.col(digest).alias("_expected"))
    first = records.agg(F.min(order).alias("_first"))
    return records.join(before, order, "left").join(F.broadcast(first)).where((F.col(order) != F.col("_first")) & ~F.col(link).eqNullSafe(F.col("_expected"))).select(*records.columns)
