"""Differences of snapshots, files, findings and sets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.operators.ordering import ranked_within


def keyed_diff(base: DataFrame, head: DataFrame, keys: Sequence[str], values: Sequence[str]) -> DataFrame:
    """The keys with ``state``: added, removed, modified or unchanged. Null values equal null values; renames are never inferred.

    Rows of one key count once, the greatest by its values; null keys match nothing and come out as added or removed.
    """

    def side(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy(*keys).agg(F.max(F.struct(*values)).alias(name))

    joined = side(base, "old").join(side(head, "new"), list(keys), "full_outer")
    state = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").when(F.col("old").eqNullSafe(F.col("new")), "unchanged").otherwise("modified")
    return joined.select(*keys, state.alias("state"))


def relation_diff(base: DataFrame, head: DataFrame) -> DataFrame:
    """``(source, target, relation, state)``: edges grouped over their evidence, whose sorted union is compared."""

    def grouped(edges: DataFrame) -> DataFrame:
        own = edges.select("source", "target", "relation", F.explode_outer("evidence").alias("e")).groupBy("source", "target", "relation")
        return own.agg(F.array_join(F.array_sort(F.collect_set("e")), "\x1f").alias("evidence"))

    return keyed_diff(grouped(base), grouped(head), ["source", "target", "relation"], ["evidence"])


def file_diff(base: DataFrame, head: DataFrame) -> DataFrame:
    """``(path, state)`` of file indexes ``(path, sha256)``; times play no part."""
    return keyed_diff(base, head, ["path"], ["sha256"])


def renamed_files(base: DataFrame, head: DataFrame) -> DataFrame:
    """``(path, renamed_from)``: created files whose content is that of a deleted one, paired in the order of their paths."""
    gone = base.select("path", "sha256").join(head.select("path"), "path", "left_anti")
    come = head.select("path", "sha256").join(base.select("path"), "path", "left_anti")
    old, new = (ranked_within(side.where("sha256 is not null").distinct(), "sha256", ["path"], "n") for side in (gone, come))
    old = old.withColumnRenamed("path", "renamed_from")
    return new.join(old, ["sha256", "n"]).select("path", "renamed_from")


def finding_fingerprint(project: Column, fingerprint: Column, rule: Column, path: Column, line: Column, column: Column, message: Column) -> Column:
    """SHA-256 of the project and the explicit fingerprint, else of rule, path (with slashes), line, column and message."""
    own = F.concat_ws("\x1f", F.coalesce(rule, F.lit("")), F.regexp_replace(F.coalesce(path, F.lit("")), r"\\", "/"), *(F.coalesce(c.cast("string"), F.lit("")) for c in (line, column, message)))
    return F.sha2(F.concat_ws("\x1f", F.coalesce(project, F.lit("")), F.coalesce(fingerprint, own)), 256)


def new_findings(findings: DataFrame, baseline: DataFrame) -> DataFrame:
    """Findings whose fingerprint the baseline lacks; null fingerprints are new."""
    return findings.join(baseline.select("fingerprint").distinct(), "fingerprint", "left_anti")


def on_changed_lines(findings: DataFrame, added: DataFrame) -> DataFrame:
    """Findings on added lines ``(path, line)``."""
    return findings.join(added.select("path", "line").distinct(), ["path", "line"], "left_semi")


def set_changes(base: DataFrame, head: DataFrame, part: str) -> DataFrame:
    """The rows only one side has, with ``part`` and ``side`` (added or removed); both sides share their columns."""
    columns = base.columns
    added = head.select(*columns).distinct().exceptAll(base.select(*columns).distinct()).withColumn("side", F.lit("added"))
    removed = base.select(*columns).distinct().exceptAll(head.select(*columns).distinct()).withColumn("side", F.lit("removed"))
    return added.unionByName(removed).withColumn("part", F.lit(part))
