"""Repeated deliveries of a row: the latest one counts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def latest_by_key(df: DataFrame, key: str, version: str, keep: Sequence[str]) -> DataFrame:
    """One row per ``key`` with the ``keep`` columns of its latest ``version``.

    Equal versions are settled by the greatest values of ``keep``, in the order given, nulls last; a null version is
    older than any other. Rows whose key is null cannot be told apart and all stay. An empty table gives an empty
    result; other columns, whatever their names, are dropped. Rows are combined before the shuffle, so a key that holds
    a large part of all rows does not make a large group.
    """
    columns = [F.col(c).alias(f"k{i}") for i, c in enumerate(keep)]
    known = df.where(F.col(key).isNotNull()).select(F.col(key).alias("key"), F.struct(F.col(version).alias("v"), *columns).alias("row"))
    known = known.groupBy("key").agg(F.max("row").alias("row"))
    latest = known.select("key", *(F.col(f"row.k{i}").alias(c) for i, c in enumerate(keep)))
    unknown = df.where(F.col(key).isNull()).select(F.col(key).alias("key"), *keep)
    return latest.unionByName(unknown).withColumnRenamed("key", key) if key not in keep else latest.unionByName(unknown).drop("key")
