"""The most frequent items of a column, by a heavy-light sketch in bounded memory."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sitewright.plans.stage import cut

BUCKETS = 1024
SLOTS = 8
LIGHT = 16384
EVICT_AT = 8

_SKETCH = "heavy boolean, place int, key bigint, votes bigint"


class HeavyLight:
    """Exact buckets for hot keys, whose holders are voted out by the rest, and plain counters for what they lose."""

    def __init__(self, buckets: int = BUCKETS, slots: int = SLOTS, light: int = LIGHT, evict_at: int = EVICT_AT):
        self.keys = np.zeros((buckets, slots), np.int64)
        self.votes = np.zeros((buckets, slots), np.int64)  # 0: the slot is free
        self.counters = np.zeros((buckets, slots), np.int32)
        self.against = np.zeros(buckets, np.int64)
        self.light = np.zeros(light, np.int64)
        self.evict_at = evict_at

    def add(self, items: np.ndarray, bucket: np.ndarray, counter: np.ndarray) -> None:
        """Count a batch. Challengers of a bucket come one a round, the most frequent first."""
        keys, at, counts = np.unique(items, return_index=True, return_counts=True)
        bucket, counter = bucket[at], counter[at]
        same = (self.keys[bucket] == keys[:, None]) & (self.votes[bucket] > 0)
        known = same.any(1)
        self.votes[bucket[known], same[known].argmax(1)] += counts[known]
        keys, counts, bucket, counter = (x[~known] for x in (keys, counts, bucket, counter))
        order = np.lexsort((-counts, bucket))
        keys, counts, bucket, counter = (x[order] for x in (keys, counts, bucket, counter))
        turn = np.arange(len(bucket)) - np.searchsorted(bucket, bucket)
        by_turn = np.argsort(turn, kind="stable")
        begin = 0
        for end in np.cumsum(np.bincount(turn)):
            now = by_turn[begin:end]
            begin = end
            self._challenge(keys[now], counts[now], bucket[now], counter[now])

    def _challenge(self, keys: np.ndarray, counts: np.ndarray, bucket: np.ndarray, counter: np.ndarray) -> None:
        weakest = self.votes[bucket].argmin(1)
        votes = self.votes[bucket, weakest]
        self.against[bucket] += np.where(votes > 0, counts, 0)
        wins = self.against[bucket] >= self.evict_at * votes
        held = wins & (votes > 0)
        np.add.at(self.light, self.counters[bucket[held], weakest[held]], votes[held])
        at = bucket[wins], weakest[wins]
        self.keys[at], self.votes[at], self.counters[at] = keys[wins], counts[wins], counter[wins]
        self.against[bucket[wins]] = 0
        np.add.at(self.light, counter[~wins], counts[~wins])

    def rows(self) -> pa.RecordBatch:
        bucket, slot = np.nonzero(self.votes)
        counter = np.flatnonzero(self.light)
        return pa.RecordBatch.from_pydict(
            {
                "heavy": np.repeat([True, False], [len(bucket), len(counter)]),
                "place": np.concatenate([bucket, counter]).astype(np.int32),
                "key": np.concatenate([self.keys[bucket, slot], np.zeros(len(counter), np.int64)]),
                "votes": np.concatenate([self.votes[bucket, slot], self.light[counter]]),
            }
        )


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sketch = HeavyLight()
    for batch in batches:
        if batch.num_rows:
            sketch.add(*(batch.column(c).to_numpy(zero_copy_only=False) for c in ("key", "bucket", "counter")))
    yield sketch.rows()


def _bucket(key: Column) -> Column:
    return F.pmod(F.shiftrightunsigned(F.xxhash64(key), 40), F.lit(BUCKETS)).cast("int")


def _counter(key: Column) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(LIGHT)).cast("int")


def sketch_counts(rows: DataFrame, key: Column) -> tuple[DataFrame, DataFrame]:
    """The merged sketch of an integer column: strongest keys (key, votes) and counters (place, votes).

    Every partition fills one sketch. Votes of the same key add up over the partitions, the strongest keys of a bucket
    keep its slots, and the votes of the others fall into their counters. Both results have at most as many rows as one
    sketch has places.
    """
    parts = rows.select(key.alias("key"), _bucket(key).alias("bucket"), _counter(key).alias("counter")).mapInArrow(_sketch, _SKETCH)
    merged = cut(parts.groupBy("heavy", "place", "key").agg(F.sum("votes").alias("votes")))
    strongest = Window.partitionBy("place").orderBy(F.desc("votes"), "key")
    ranked = merged.where("heavy").withColumn("rank", F.row_number().over(strongest))
    heavy = ranked.where(F.col("rank") <= SLOTS).select("key", "votes")
    fallen = ranked.where(F.col("rank") > SLOTS).select(_counter(F.col("key")).alias("place"), "votes")
    light = merged.where(~F.col("heavy")).select("place", "votes").unionByName(fallen)
    return heavy, light.groupBy("place").agg(F.sum("votes").alias("votes"))


def frequent_items(df: DataFrame, item: str, min_share: float) -> DataFrame:
    """Rows (item, estimate, n): the items that make up at least ``min_share`` of the rows whose item is not null.

    ``estimate`` is the sketch's count, the votes of the item's slot plus its counter, and never too low. ``n`` is the
    exact count, by which items that the estimate puts over the share and the rows don't are dropped again. Ties at the
    threshold all stay; an empty column gives an empty result; other columns are ignored, whatever their names.

    A key that no slot holds has all its rows in its counter. The keys of counters that reach the threshold, of which
    there are at most 1 / min_share, are counted exactly too, so no item is missed. The lists sent to the tasks are
    bounded by the places of one sketch.
    """
    whole = dict(df.dtypes)[item] == "bigint"
    key = F.col("item") if whole else F.xxhash64("item")
    rows = cut(df.where(F.col(item).isNotNull()).select(F.col(item).alias("item")))
    heavy, light = (x.toPandas() for x in sketch_counts(rows, key))
    counters = np.zeros(LIGHT, np.int64)
    counters[light.place] = light.votes
    least = max(1, math.ceil(min_share * int(heavy.votes.sum() + counters.sum())))
    spark = df.sparkSession
    at = spark.createDataFrame(light, "place int, votes bigint")
    known = spark.createDataFrame(heavy, "key bigint, votes bigint").withColumn("place", _counter(F.col("key")))
    estimates = F.broadcast(known.join(F.broadcast(at.withColumnRenamed("votes", "more")), "place", "left").select("key", (F.col("votes") + F.coalesce("more", F.lit(0))).alias("estimate")).where(F.col("estimate") >= least))
    found = rows.withColumn("key", key).join(estimates, "key")
    crowded = np.flatnonzero(counters >= least).tolist()
    if crowded:
        hidden = rows.withColumn("key", key).withColumn("place", _counter(F.col("key"))).where(F.col("place").isin(crowded))
        hidden = hidden.join(F.broadcast(known.select("key")), "key", "left_anti").join(F.broadcast(at), "place")
        found = found.unionByName(hidden.select("key", "item", F.col("votes").alias("estimate")))
    counted = found.groupBy("item").agg(F.max("estimate").alias("estimate"), F.count("*").alias("n"))
    return counted.where(F.col("n") >= least)
