"""File events: differences of polls, debouncing, health and leases; the same plans run on batches and on streams."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.operators.diffs import keyed_diff, renamed_files
from graphloom.session import ship


def poll_events(before: DataFrame, after: DataFrame) -> DataFrame:
    """``(path, kind, previous_path)`` of two polls ``(path, sha256)``: created, modified, deleted or renamed.

    A created path with the content of a deleted one is its renaming; several are paired in the order of their paths.
    """
    moved = renamed_files(before, after)
    diff = keyed_diff(before, after, ["path"], ["sha256"]).where("state <> 'unchanged'")
    rest = diff.join(moved.select("path"), "path", "left_anti").join(moved.select(F.col("renamed_from").alias("path")), "path", "left_anti")
    kind = F.when(F.col("state") == "added", "created").when(F.col("state") == "removed", "deleted").otherwise("modified")
    plain = rest.select("path", kind.alias("kind"), F.lit(None).cast("string").alias("previous_path"))
    return plain.unionByName(moved.select("path", F.lit("renamed").alias("kind"), F.col("renamed_from").alias("previous_path")))


def _merged(kinds):
    """Folds the kinds of one quiet period: created then modified stays created, created then deleted leaves nothing, else the latest."""
    return F.aggregate(
        kinds,
        F.lit("none"),
        lambda held, new: F.when((held == "created") & (new == "modified"), "created").when((held == "created") & (new == "deleted"), "none").otherwise(new),
    )


def debounced(events: DataFrame, quiet: str = "100 milliseconds", late: str = "10 minutes") -> DataFrame:
    """``(project, path, kind, at, events)``: one event per path and quiet period; each event begins the period anew.

    ``events(ts, project, path, kind)`` may be a batch or a stream: periods are session windows, which a stream emits when
    the watermark has passed them.
    """
    timed = events.withColumn("ts", F.col("ts").cast("timestamp"))
    if events.isStreaming:
        timed = timed.withWatermark("ts", late)
    period = F.session_window("ts", quiet)
    grouped = timed.groupBy(period, "project", "path").agg(F.array_sort(F.collect_list(F.struct("ts", "kind"))).alias("x"))
    kind = _merged(F.transform("x", lambda e: e["kind"]))
    return grouped.select("project", "path", kind.alias("kind"), F.array_max("x")["ts"].alias("at"), F.size("x").alias("events")).where("kind <> 'none'")


def event_rates(events: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """``(start, kind, events)``: counts per tumbling window, on batches and streams."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp"))
    if events.isStreaming:
        timed = timed.withWatermark("ts", late)
    counted = timed.groupBy(F.window("ts", width).alias("w"), "kind").agg(F.count("*").alias("events"))
    return counted.select(F.col("w.start").cast("timestamp_ntz").alias("start"), "kind", "events")


def run_to_end(stream: DataFrame, sink: Callable[[DataFrame, int], None], folder: str, mode: str = "append") -> None:
    """Runs a streaming query over what is there now, each batch through ``sink``, with its state in ``folder``."""
    query = stream.writeStream.outputMode(mode).foreachBatch(sink).option("checkpointLocation", folder).trigger(availableNow=True).start()
    query.awaitTermination()


#: Observations in a row that make a plugin unhealthy, and that make it healthy again.
FAILURES, RECOVERIES = 3, 2


def _step(state: tuple[str, int, int], success: bool, failures: int, recoveries: int) -> tuple[str, int, int]:
    status, bad, good = state
    if success:
        good += 1
        sick = status in ("unhealthy", "degraded")
        return ("healthy" if not sick or good >= recoveries else "degraded", 0, good)
    bad += 1
    return ("unhealthy" if bad >= failures else "degraded", bad, 0)


def health(observations: DataFrame, failures: int = FAILURES, recoveries: int = RECOVERIES) -> DataFrame:
    """``(plugin, status, consecutive_failures, consecutive_successes, probes)`` after all ``observations(plugin, at, success)``.

    The status is a fold over time, but its end depends only on the last run of equal outcomes and the status before it:
    a run of failures tells its own status; a run of successes is healthy if it is long enough or if nothing but successes
    came before it, or if the plugin was healthy. So runs are found by aggregates alone.
    """
    at = F.struct("at", "seq")
    rows = observations.withColumn("key", at)
    last = rows.groupBy("plugin").agg(F.max(F.when(~F.col("success"), F.col("key"))).alias("bad"), F.max(F.when(F.col("success"), F.col("key"))).alias("good"), F.count("*").alias("probes"))
    joined = rows.join(last, "plugin")
    counted = joined.groupBy("plugin").agg(
        F.max("probes").alias("probes"),
        F.count_if(~F.col("success") & (F.col("good").isNull() | (F.col("key") > F.col("good")))).alias("consecutive_failures"),
        F.count_if(F.col("success") & (F.col("bad").isNull() | (F.col("key") > F.col("bad")))).alias("consecutive_successes"),
        F.max(F.col("bad").isNull()).alias("never"),
    )
    bad, good = F.col("consecutive_failures"), F.col("consecutive_successes")
    status = F.when(bad >= failures, "unhealthy").when(bad > 0, "degraded").when(F.col("never") | (good >= recoveries), "healthy").otherwise("degraded")
    return counted.select("plugin", status.alias("status"), "consecutive_failures", "consecutive_successes", "probes")


def health_stream(observations: DataFrame, failures: int = FAILURES, recoveries: int = RECOVERIES) -> DataFrame:
    """``(plugin, status, consecutive_failures, consecutive_successes, probes)`` of a stream, updated with each batch; one small state per plugin."""
    ship(observations.sparkSession)

    def update(key: tuple, batches: Iterable[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        held = state.get if state.exists else ("unknown", 0, 0, 0)
        current, probes = tuple(held[:3]), held[3]
        frame = pd.concat(list(batches)).sort_values(["at", "seq"])
        for success in frame["success"]:
            current, probes = _step(current, bool(success), failures, recoveries), probes + 1
        state.update((*current, probes))
        yield pd.DataFrame([(key[0], *current, probes)], columns=["plugin", "status", "consecutive_failures", "consecutive_successes", "probes"])

    kept = "status string, bad int, good int, probes bigint"
    out = "plugin string, status string, consecutive_failures bigint, consecutive_successes bigint, probes bigint"
    return observations.groupBy("plugin").applyInPandasWithState(update, out, kept, "update", "NoTimeout")


def lease_states(log: DataFrame, now_s: float, lease_s: float, attempts: int = 3) -> DataFrame:
    """``(job, state, worker, attempt)`` of ``log(job, at_s, seq, kind, worker)`` with kinds lease, heartbeat, complete and fail.

    A completed job has succeeded. After a failure it is pending, or failed once all attempts are used. A lease without
    heartbeat for ``lease_s`` seconds before ``now_s`` has expired, and its job is pending again.
    """
    when = F.struct("at_s", "seq")
    grouped = log.groupBy("job").agg(
        F.max(F.col("kind") == "complete").alias("done"),
        F.count_if(F.col("kind") == "lease").alias("attempt"),
        F.max_by("kind", F.when(F.col("kind").isin("lease", "fail"), when)).alias("turn"),
        F.max_by("worker", F.when(F.col("kind") == "lease", when)).alias("worker"),
        F.max(F.when(F.col("kind").isin("lease", "heartbeat"), F.col("at_s"))).alias("alive"),
    )
    used = F.col("attempt") >= attempts
    state = (
        F.when(F.col("done"), "succeeded").when((F.col("turn") == "fail") & used, "failed").when(F.col("turn") == "fail", "pending")
        .when(F.col("turn").isNull(), "pending").when(F.col("alive") + lease_s <= now_s, "expired").otherwise("leased")
    )
    return grouped.select("job", state.alias("state"), "worker", "attempt")


def auto_fix_order(edits: DataFrame) -> DataFrame:
    """Edits ``(path, start, stop)`` that overlap none that begins before them, last place first within a path, as they are applied."""
    order = Window.partitionBy("path").orderBy("start", "stop")
    clear = edits.withColumn("ended", F.max("stop").over(order.rowsBetween(Window.unboundedPreceding, -1))).where(F.col("ended").isNull() | (F.col("start") >= F.col("ended")))
    return clear.withColumn("turn", F.row_number().over(Window.partitionBy("path").orderBy(F.col("start").desc(), F.col("stop").desc()))).drop("ended")
