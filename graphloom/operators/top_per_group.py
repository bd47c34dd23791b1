"""Problem 2: the N items with the highest scores of every group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.session import shared_table

#: Shares of all rows above each band's lower edge; the last band takes the rest.
BANDS = (0.02, 0.3)


def latest_scores(scored: DataFrame, group: str, item: str, score: str, at: str) -> DataFrame:
    """The score of each (group, item) by its latest ``at``; at a tie the greatest score.

    Items whose latest score is null or NaN, and rows without group or item, are left out.
    """
    last = scored.where(F.col(group).isNotNull() & F.col(item).isNotNull()).groupBy(group, item).agg(F.max(F.struct(F.col(at).alias("at"), F.col(score).alias("score"))).alias("last"))
    return last.select(F.col(group).alias("group"), F.col(item).alias("item"), F.col("last.score").alias("score")).where(F.col("score").isNotNull() & ~F.isnan("score"))


def _edges(scored: DataFrame, score: str, shares: Sequence[float]) -> list[float]:
    """Descending lower edges of the upper bands, from the scores of all rows."""
    valid = scored.where(F.col(score).isNotNull() & ~F.isnan(score))
    edges = valid.agg(F.percentile_approx(score, [1 - x for x in shares], 1000).alias("edges")).first()["edges"]
    return sorted(set(edges or []), reverse=True)


def top_per_group(scored: DataFrame, group: str, item: str, score: str, at: str, n: int = 5, shares: Sequence[float] = BANDS) -> DataFrame:
    """``(group, item, place)``: places 1 to ``n`` in each group by score descending, then item ascending by code points.

    The latest scores are written in bands of descending score. From the top band down, rows of groups that are
    filled already are taken out by an anti-join; the rest is ranked exactly within the band (Spark keeps each
    task's first ``n`` before the shuffle, so a hot group costs ``n`` rows a task), and a group takes what it still
    lacks. Ties at the edge of a band cannot be split: a band holds all rows of a score. Empty input gives no rows.
    """
    edges = _edges(scored, score, shares)
    band = F.lit(len(edges))
    for k in reversed(range(len(edges))):
        band = F.when(F.col("score") >= F.lit(edges[k]), k).otherwise(band)
    banded = shared_table(latest_scores(scored, group, item, score, at).withColumn("band", band.cast("int")), ["band"])
    order = Window.partitionBy("group").orderBy(F.col("score").desc(), F.col("item").asc())
    taken = None
    for k in range(len(edges) + 1):
        rows = banded.where(F.col("band") == k).drop("band")
        if taken is not None:
            held = taken.groupBy("group").agg(F.count("*").cast("int").alias("held"))
            rows = rows.join(held.where(F.col("held") >= n).select("group"), "group", "left_anti")
        ranked = rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)
        if taken is None:
            new = ranked.select("group", "item", F.col("rank").alias("place"))
        else:
            place = F.col("rank") + F.coalesce("held", F.lit(0))
            new = ranked.join(held.where(F.col("held") < n), "group", "left").select("group", "item", place.alias("place")).where(F.col("place") <= n)
        new = shared_table(new)
        taken = new if taken is None else taken.unionByName(new)
    return taken.select(F.col("group").alias(group), F.col("item").alias(item), "place")
