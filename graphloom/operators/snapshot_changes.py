"""Problem 1: what was added, removed or changed from one full snapshot to the next."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.functions.text_json import instant, with_canonical
from graphloom.operators.ordering import with_neighbours
from graphloom.session import checkpoint


def held_project_hashes(project_runs: DataFrame) -> DataFrame:
    """``(run_id, project, value_hash)`` of the rows that hold.

    The canonical hash is taken at the scan, so the shuffles carry 16 bytes in place of the value. For one
    ``(analysis_run_id, position)`` the latest ``received_at`` holds; at a tie the greatest project, then hash.
    A project at several positions of a run counts once, by the highest position. Unreadable values hash as null.
    """
    read = with_canonical(project_runs.select("analysis_run_id", "position", "project", "received_at", "value_json"), "value_json", "canonical", ["stats"])
    hashed = read.select("analysis_run_id", "position", "project", "received_at", F.unhex(F.md5("canonical")).alias("value_hash"))
    held = hashed.groupBy("analysis_run_id", "position").agg(F.max(F.struct("received_at", "project", "value_hash")).alias("row"))
    return held.groupBy(F.col("analysis_run_id").alias("run_id"), F.col("row.project").alias("project")).agg(F.max(F.struct("position", "row.value_hash")).alias("last")).select("run_id", "project", F.col("last.value_hash").alias("value_hash"))


def is_full(requested_json: Column) -> Column:
    """Whether the run analysed the whole workspace: an array without elements."""
    return requested_json.rlike(r"^\s*\[\s*\]\s*$")


def full_snapshots(analysis_runs: DataFrame, project_runs: DataFrame) -> DataFrame:
    """Full snapshots ``(run_id, previous, following)``: the neighbours are run ids within the workspace by time, then id.

    Runs without project rows, with null id or unreadable time are none.
    """
    runs = (
        analysis_runs.where(is_full(F.col("requested_json")) & F.col("id").isNotNull())
        .select(F.col("id").alias("run_id"), F.col("workspace_fingerprint").alias("workspace"), instant(F.col("created_at")).alias("at"))
        .where(F.col("at").isNotNull())
        .dropDuplicates(["run_id"])
    )
    present = project_runs.select(F.col("analysis_run_id").alias("run_id")).distinct()
    return with_neighbours(runs.join(present, "run_id", "left_semi"), "workspace", ["at", "run_id"], "run_id").select("run_id", "previous", "following")


def snapshot_changes(analysis_runs: DataFrame, project_runs: DataFrame) -> DataFrame:
    """``(run_id, project, change_kind)`` between consecutive full snapshots of a workspace.

    A full outer join of each snapshot with the one before on (later run, project), comparing canonical hashes.
    Null values differ from all but null values; null projects are left out; empty tables give no rows.
    """
    snapshots = full_snapshots(analysis_runs, project_runs)
    rows = checkpoint(held_project_hashes(project_runs).where(F.col("project").isNotNull()).join(snapshots, "run_id"))
    later = rows.where(F.col("previous").isNotNull()).select("run_id", "project", F.col("value_hash").alias("new_hash"), F.lit(True).alias("is_new"))
    earlier = rows.where(F.col("following").isNotNull()).select(F.col("following").alias("run_id"), "project", F.col("value_hash").alias("old_hash"), F.lit(True).alias("is_old"))
    kind = F.when(F.col("is_old").isNull(), "added").when(F.col("is_new").isNull(), "removed").when(~F.col("new_hash").eqNullSafe(F.col("old_hash")), "changed")
    return later.join(earlier, ["run_id", "project"], "full_outer").select("run_id", "project", kind.alias("change_kind")).where(F.col("change_kind").isNotNull())
