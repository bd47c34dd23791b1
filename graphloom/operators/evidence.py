"""Confidence, priorities, points and gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Severities in rank order, their other spellings, and their priority values.
SEVERITIES = ("info", "low", "medium", "high", "critical")
SEVERITY_ALIASES = {"error": "high", "warning": "medium", "note": "info", "information": "info"}
PRIORITY_VALUES = {"info": 0.10, "low": 0.30, "medium": 0.60, "high": 0.80, "critical": 1.00}


def severity(raw: Column) -> Column:
    """The severity that a text names in any case; null and unknown names are medium."""
    lower = F.lower(raw)
    found = F.lit("medium")
    for name in SEVERITIES:
        found = F.when(lower == name, name).otherwise(found)
    for name, meaning in SEVERITY_ALIASES.items():
        found = F.when(lower == name, meaning).otherwise(found)
    return found


def severity_rank(name: Column) -> Column:
    """0 for info to 4 for critical; null for other names."""
    rank = F.lit(None).cast("int")
    for k, one in enumerate(SEVERITIES):
        rank = F.when(name == one, k).otherwise(rank)
    return rank


def tier(score: Column, missing: Column) -> Column:
    """insufficient with missing required roles or below 0.4, then low, medium from 0.6, high from 0.8."""
    return F.when(missing | (score < 0.4), "insufficient").when(score >= 0.8, "high").when(score >= 0.6, "medium").otherwise("low")


def confidence(roles: DataFrame, records: DataFrame, coverage: float = 1.0, agreement: float = 1.0, penalties: float = 0.0) -> DataFrame:
    """``(subject_id, score, tier, missing)`` of ``roles(subject_id, role, required)`` with ``records(subject_id, role, reliability, specificity)``.

    A role's quality is the mean of reliability times specificity; required roles weigh 2, others 1, roles without
    records nothing. Subjects without any record score 0.
    """
    quality = records.groupBy("subject_id", "role").agg(F.avg(F.col("reliability") * F.col("specificity")).alias("quality"))
    joined = roles.join(quality, ["subject_id", "role"], "left").withColumn("weight", F.when(F.col("required"), 2.0).otherwise(1.0))
    held = F.col("quality").isNotNull()
    grouped = joined.groupBy("subject_id").agg(
        F.coalesce(F.try_divide(F.sum(F.when(held, F.col("quality") * F.col("weight"))), F.sum(F.when(held, F.col("weight")))), F.lit(0.0)).alias("support"),
        F.count_if(F.col("required") & ~held).alias("missing"),
    )
    score = F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("support") * coverage * agreement - penalties)), 4)
    return grouped.select("subject_id", score.alias("score"), tier(score, F.col("missing") > 0).alias("tier"), "missing")


def security_priority(severity_name: Column, traces: Column, resolved: Column) -> dict[str, Column]:
    """``score``, ``tier`` and ``coverage`` of a finding: severity .50, trace .15, scope .15 over the available weight.

    Runtime exposure and impact radius (.10 each) are never available here, so coverage is at most .8.
    """
    value = F.lit(None).cast("double")
    for name, one in PRIORITY_VALUES.items():
        value = F.when(severity_name == name, one).otherwise(value)
    traced, scoped = traces > 0, F.coalesce(resolved, F.lit(False))
    weight = F.lit(0.5) + F.when(traced, 0.15).otherwise(0.0) + F.when(scoped, 0.15).otherwise(0.0)
    points = F.round(value * 0.5, 4) + F.when(traced, F.when(traces >= 2, 0.15).otherwise(0.0975)).otherwise(0.0) + F.when(scoped, 0.15).otherwise(0.0)
    score = F.round(points / weight, 4)
    band = F.when(score >= 0.85, "critical").when(score >= 0.65, "high").when(score >= 0.45, "medium").when(score >= 0.2, "low").otherwise("informational")
    return {"score": score, "tier": F.when(value.isNotNull(), band), "coverage": F.round(weight, 4)}


def impact_points(direct: Column, transitive: Column, endpoints: Column, entities: Column, projects: Column, cycles: Column) -> Column:
    """Capped additive points of a change, 0 to 100."""
    zero = F.lit(0)
    return (
        F.least(F.lit(25), direct * 5) + F.least(F.lit(25), transitive * 3) + F.least(F.lit(20), endpoints * 10)
        + F.least(F.lit(15), entities * 5) + F.least(F.lit(10), F.greatest(zero, projects - 1) * 5) + F.when(cycles > 0, 10).otherwise(0)
    )


def impact_level(points: Column) -> Column:
    return F.when(points >= 75, "critical").when(points >= 50, "high").when(points >= 25, "medium").otherwise("low")


def finding_gate(findings: DataFrame, minimum: str | None = None, maximum: int | None = None) -> DataFrame:
    """One row ``(findings, at_threshold, passed)``: fails on any finding at or above ``minimum``, or on more than ``maximum``."""
    rank = severity_rank(severity(F.col("severity")))
    floor = SEVERITIES.index(minimum) if minimum else len(SEVERITIES)
    counted = findings.agg(F.count("*").alias("findings"), F.count_if(rank >= floor).alias("at_threshold"))
    return counted.withColumn("passed", (F.col("at_threshold") == 0) & (F.lit(True) if maximum is None else F.col("findings") <= maximum))


def architecture_gate(findings: DataFrame, subjects: DataFrame | None = None, fail: int = 70) -> DataFrame:
    """``(subject, points, status)`` of ``findings(subject, category, severity, points)`` and ``subjects(subject)``.

    Policy findings count 2, 8, 20 or 35 by severity info, warning, error, critical; regressions 2, 10, 25 or 40; a change
    impact that is high or critical counts a third of its ``points``, 10 to 30. Errors and worse of policies and regressions
    fail, so do all such change impacts, unresolved regressions, and ``fail`` points; any other finding warns; subjects
    without findings pass. Points end at 100.
    """
    category, name = F.col("category"), F.col("severity")
    regression, change = category.startswith("regression"), category == "change-impact"

    def by_severity(*values: int) -> Column:
        found = F.lit(0)
        for one, value in zip(("info", "warning", "error", "critical"), values):
            found = F.when(name == one, value).otherwise(found)
        return found

    strong = change & name.isin("high", "critical")
    third = F.least(F.lit(30), F.greatest(F.lit(10), F.floor(F.coalesce("points", F.lit(0)) / 3)))
    own = F.when(strong, third).when(change, 0).when(regression, by_severity(2, 10, 25, 40)).otherwise(by_severity(2, 8, 20, 35))
    counted = ~change | strong
    grouped = findings.groupBy("subject").agg(
        F.least(F.sum(own), F.lit(100)).cast("bigint").alias("points"),
        F.max(strong | (~change & name.isin("error", "critical")) | (category == "regression:unresolved")).alias("blocking"),
        F.count_if(counted).alias("held"),
    )
    if subjects is not None:
        grouped = subjects.select("subject").distinct().join(grouped, "subject", "left")
    points, blocking = F.coalesce("points", F.lit(0).cast("bigint")), F.coalesce("blocking", F.lit(False))
    status = F.when(blocking | (points >= fail), "fail").when(F.coalesce("held", F.lit(0)) > 0, "warn").otherwise("pass")
    return grouped.select("subject", points.alias("points"), status.alias("status"))
