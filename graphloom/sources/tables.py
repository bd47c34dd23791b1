"""Reading Parquet tables, whole, with only the columns that a plan uses."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

from graphloom.session import ship


def table(spark: SparkSession, folder: str, name: str, columns: Sequence[str] = (), spread: bool = False) -> DataFrame:
    """``<folder>/<name>.parquet``, a file or a directory; extra columns are left out when ``columns`` is given.

    With ``spread``, a table that Spark would read in fewer tasks than there are cores is dealt out to all of them: for
    plans that spend their time in Python. Tables of many files or row groups are read as they are.
    """
    ship(spark)
    df = spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")
    df = df.select(*columns) if columns else df
    cores = spark.sparkContext.defaultParallelism
    if spread and df._jdf.queryExecution().toRdd().getNumPartitions() < cores:
        return df.repartition(cores)
    return df
