"""Risk: metric rows, their normalisation within cohorts, renormalised scores, hotspots, heatmaps and trends."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.operators.ordering import running_totals
from graphloom.session import checkpoint

#: Weights of the metrics.
WEIGHTS = {"complexity": 0.25, "fan_in": 0.20, "fan_out": 0.15, "change_frequency": 0.15, "ownership": 0.10, "test_density": 0.10, "size": 0.05}
#: Upper bounds of the scores 0, 0.25, 0.5 and 0.75; greater values score 1.
BANDS = {
    "complexity": (1, 5, 10, 20),
    "fan_in": (0, 1, 3, 7),
    "fan_out": (0, 1, 3, 7),
    "change_frequency": (0, 1, 3, 7),
    "ownership": (0.25, 0.5, 0.75, 0.9),
    "test_density": (0.1, 0.25, 0.5, 0.75),
    "size": (1e5, 1e6, 1e7, 1e8),
}
#: Cohorts of fewer subjects, or without variance, are scored by bands.
COHORT_MINIMUM = 20


def band_score(metric: Column, value: Column) -> Column:
    """The score of a value by its metric's absolute bands; null for unknown metrics."""
    score = F.lit(None).cast("double")
    for name, bounds in BANDS.items():
        own = F.lit(1.0)
        for k in reversed(range(4)):
            own = F.when(value <= bounds[k], k * 0.25).otherwise(own)
        score = F.when(metric == name, own).otherwise(score)
    return score


def normalised(metrics: DataFrame, minimum: int = COHORT_MINIMUM) -> DataFrame:
    """``metrics(subject_id, metric, cohort, value)`` with ``normalized`` and ``basis``.

    Within (metric, cohort): the mid-rank percentile ``(first + last) / 2 / (n - 1)`` of the value's ties if the cohort has
    ``minimum`` subjects and some variance, else the absolute band. Null and non-positive values give no metric. Equal values
    are counted first, and only the distinct ones are sorted, range by range, so a cohort of any size is spread over all tasks.
    """
    key = ["metric", "cohort"]
    rows = checkpoint(metrics.where(F.col("value") > 0).select("subject_id", *key, F.col("value").cast("double").alias("value")))
    values = rows.groupBy(*key, "value").agg(F.count("*").alias("ties"))
    placed = running_totals(values, [*key, "value"], "ties", "lo")
    cohorts = placed.groupBy(*key).agg(F.min("lo").alias("base"), F.sum("ties").alias("n"), (F.count("*") > 1).alias("varied"))
    by_rank = (F.col("n") >= minimum) & F.col("varied")
    percentile = (F.col("lo") + (F.col("ties") - 1) / 2 - F.col("base")) / (F.col("n") - 1)
    basis = F.when(by_rank, "percentile").when(F.col("n") < minimum, "small-cohort").otherwise("no-variance")
    scored = placed.join(cohorts, key).select(*key, "value", F.when(by_rank, percentile).otherwise(band_score(F.col("metric"), F.col("value"))).alias("normalized"), basis.alias("basis"))
    return rows.join(scored, [*key, "value"]).select("subject_id", *key, "value", "normalized", "basis")


def scores(normal: DataFrame, weights: Mapping[str, float] = WEIGHTS) -> DataFrame:
    """``(subject_id, cohort, score, factors, factor_names)``: the weighted mean over the metrics that a subject has; missing is not zero."""
    weight = F.lit(None).cast("double")
    for name, value in weights.items():
        weight = F.when(F.col("metric") == name, float(value)).otherwise(weight)
    used = normal.withColumn("weight", weight).where((F.col("weight") > 0) & F.col("normalized").isNotNull())
    return used.groupBy("subject_id", "cohort").agg(F.round(F.sum(F.col("weight") * F.col("normalized")) / F.sum("weight"), 6).alias("score"), F.count("*").alias("factors"), F.array_join(F.array_sort(F.collect_set("metric")), ",").alias("factor_names"))


def hotspots(metrics: DataFrame, k: int = 25) -> DataFrame:
    """The ``k`` subjects of the greatest score, then by id: the flagship report."""
    return scores(normalised(metrics)).drop("factor_names").orderBy(F.col("score").desc(), "subject_id").limit(k)


def heatmap(normal: DataFrame) -> DataFrame:
    """``(metric, cohort, bin, subjects)``: five equal bins; 1.0 falls into the last."""
    return normal.groupBy("metric", "cohort", F.least(F.floor(F.col("normalized") * 5), F.lit(4)).cast("int").alias("bin")).agg(F.count("*").alias("subjects"))


def trend(current: DataFrame, previous: DataFrame) -> DataFrame:
    """``(subject_id, cohort, score, previous_score, direction)``: compared only where cohort and the factors themselves agree."""
    old = previous.select("subject_id", "cohort", "factor_names", F.col("score").alias("previous_score"))
    joined = current.join(old, ["subject_id", "cohort", "factor_names"], "left")
    change = F.when(F.col("previous_score").isNull(), "not_comparable").when(F.col("score") > F.col("previous_score"), "up").when(F.col("score") < F.col("previous_score"), "down").otherwise("same")
    return joined.select("subject_id", "cohort", "score", "previous_score", change.alias("direction"))


def change_frequency(changes: DataFrame) -> DataFrame:
    """``(project, commits)``: distinct commits per project; null projects are left out."""
    return changes.where(F.col("project").isNotNull()).groupBy("project").agg(F.count_distinct("commit").alias("commits"))


def ownership(changes: DataFrame) -> DataFrame:
    """``(project, commits, top_commits, concentration)``: the greatest share of commits by one contributor.

    A commit counts for its last contributor; the concentration is null where any contributor of the project is unknown.
    """
    held = changes.where(F.col("project").isNotNull())
    commits = held.groupBy("project", "commit").agg(F.max_by("contributor_id", F.struct("at", "contributor_id")).alias("contributor_id"), F.max(F.col("contributor_id").isNull() | (F.col("contributor_id") == "")).alias("unknown"))
    by_contributor = commits.groupBy("project", "contributor_id").agg(F.count("*").alias("n"), F.max("unknown").alias("unknown"))
    total = by_contributor.groupBy("project").agg(F.sum("n").alias("commits"), F.max("n").alias("top_commits"), F.max("unknown").alias("unknown"))
    return total.select("project", "commits", "top_commits", F.when(~F.col("unknown"), F.round(F.col("top_commits") / F.col("commits"), 6)).alias("concentration"))


def round_robin(rows: DataFrame, group: str, order: str, k: int) -> DataFrame:
    """The first ``k`` rows taken in turn from each group, groups in their order."""
    place = Window.partitionBy(group).orderBy(order)
    turns = rows.withColumn("turn", F.row_number().over(place)).where(F.col("turn") <= k)
    return turns.orderBy("turn", group).limit(k)
