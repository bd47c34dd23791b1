"""Folding many small groups in Python without a pandas call for each."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.types import StructType, _parse_datatype_string

from graphloom.session import ship


def fold_groups(df: DataFrame, key: str, order: Sequence[str], fold: Callable[[object, list[tuple]], Iterable[tuple]], schema: str) -> DataFrame:
    """``fold(key, rows)`` of every group of ``df``; rows are tuples in ``df``'s column order, sorted by ``order``.

    Rows are partitioned by ``key`` and sorted once; a task streams over its groups batch by batch, holding one group at
    a time. For groups that are small by nature: the statements of a method, the steps of a program.
    """
    ship(df.sparkSession)
    at = df.columns.index(key)
    out = _parse_datatype_string(schema)
    assert isinstance(out, StructType)
    names = out.names
    whole = [f.name for f in out.fields if f.dataType.typeName() in ("long", "integer")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[tuple] = []

        def frame(found: list[tuple]) -> pd.DataFrame:
            made = pd.DataFrame(found, columns=names, dtype=object)
            return made.astype(dict.fromkeys(whole, "Int64"))

        for batch in batches:
            found: list[tuple] = []
            for row in batch.itertuples(index=False, name=None):
                if held and held[0][at] != row[at]:
                    found += fold(held[0][at], held)
                    held = []
                held.append(row)
            yield frame(found)
        if held:
            yield frame(list(fold(held[0][at], held)))

    return df.repartition(key).sortWithinPartitions(key, *order).mapInPandas(run, schema)

