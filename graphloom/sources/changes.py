"""Unified diffs and change logs as rows."""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.session import ship

_HUNK = re.compile(r"@@ -(\d+)(?:,(\d+))? \+(\d+)(?:,(\d+))? @@")


class DiffLine(NamedTuple):
    old_path: str | None
    new_path: str | None
    change: str  # added, removed, binary or renamed
    line: int | None


def _path(text: str) -> str | None:
    bare = text.split("\t")[0].strip().strip('"')
    return None if bare == "/dev/null" else re.sub(r"^[ab]/", "", bare)


def parse_diff(text: str | None) -> list[DiffLine]:
    """Added and removed line numbers of each file, and its renaming or binary change, of a unified diff."""
    rows: list[DiffLine] = []
    old = new = None
    marks: list[str] = []
    left_old = left_new = at_old = at_new = 0

    def close() -> None:
        rows.extend(DiffLine(old, new, mark, None) for mark in dict.fromkeys(marks))
        marks.clear()

    for line in (text or "").splitlines():
        if left_old > 0 or left_new > 0:
            sign = line[:1]
            if sign == "+":
                rows.append(DiffLine(old, new, "added", at_new))
            elif sign == "-":
                rows.append(DiffLine(old, new, "removed", at_old))
            if sign in ("+", " ", ""):
                at_new, left_new = at_new + 1, left_new - 1
            if sign in ("-", " ", ""):
                at_old, left_old = at_old + 1, left_old - 1
        elif line.startswith("diff --git "):
            close()
            match = re.match(r'diff --git "?a/(.+?)"? "?b/(.+?)"?$', line)
            old, new = match.groups() if match else (None, None)
        elif line.startswith("--- "):
            old = _path(line[4:])
        elif line.startswith("+++ "):
            new = _path(line[4:])
        elif line.startswith(("rename from ", "rename to ")):
            marks.append("renamed")
            if line.startswith("rename from "):
                old = line[12:].strip()
            else:
                new = line[10:].strip()
        elif line.startswith(("Binary files ", "GIT binary patch")):
            marks.append("binary")
        elif match := _HUNK.match(line):
            at_old, at_new = int(match[1]), int(match[3])
            left_old, left_new = (int(x) if x is not None else 1 for x in (match[2], match[4]))
    close()
    return rows


def diff_lines(diffs: DataFrame) -> DataFrame:
    """``(id, old_path, new_path, change, line)`` of ``diffs(id, text)``."""
    ship(diffs.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(own, *r) for own, text in zip(batch["id"], batch["text"]) for r in parse_diff(text)]
            frame = pd.DataFrame(rows, columns=["id", *DiffLine._fields])
            frame["line"] = frame["line"].astype("Int64")
            yield frame

    return diffs.select(F.col("id").cast("bigint").alias("id"), "text").mapInPandas(run, "id bigint, old_path string, new_path string, change string, line bigint")


def change_log(lines: DataFrame) -> DataFrame:
    """``(commit, timestamp, contributor_id, path, additions, deletions)`` of ``lines(id, value)``: a log whose headers are
    ``commit<TAB>time<TAB>author`` behind ``@`` and whose rows are ``added<TAB>deleted<TAB>path``, ``-`` for binary files.

    Contributors are pseudonymised by SHA-256. ``id`` numbers the lines; each row takes the last header before it.
    """
    parts = F.split("value", "\t")
    header = F.col("value").startswith("@")
    marked = lines.withColumn("header", F.when(header, F.struct(F.substring(parts[0], 2, 100).alias("commit"), parts[1].alias("timestamp"), F.sha2(F.lower(parts[2]), 256).alias("contributor_id"))))
    block = F.floor(F.col("id") / 100_000)
    own = marked.withColumn("own", F.last("header", True).over(Window.partitionBy(block).orderBy("id")))
    # a block without an own header so far takes the last one of the blocks before it
    heads = marked.groupBy(block.alias("b")).agg(F.max_by("header", F.when(F.col("header").isNotNull(), F.col("id"))).alias("h"))
    earlier = heads.select("b", F.last("h", True).over(Window.orderBy("b").rowsBetween(Window.unboundedPreceding, -1)).alias("h"))
    joined = own.withColumn("b", block).join(earlier, "b")
    number = F.regexp_extract("value", r"^(\d+|-)\t(\d+|-)\t(.+)$", 1)
    return joined.where(~header & (number != "")).select(
        F.coalesce("own.commit", "h.commit").alias("commit"), F.coalesce("own.timestamp", "h.timestamp").alias("timestamp"), F.coalesce("own.contributor_id", "h.contributor_id").alias("contributor_id"),
        parts[2].alias("path"), parts[0].try_cast("int").alias("additions"), parts[1].try_cast("int").alias("deletions"),
    )
