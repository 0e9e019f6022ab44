"""How often each term or n-gram occurs, and in how many records, by sorted suffixes and a stack."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_COUNTS = "ngram array<string>, total bigint, records bigint"


def _codes(values: pa.Array) -> np.ndarray:
    """A number for each value, equal for equal ones; -1 for nulls."""
    return pc.fill_null(values.dictionary_encode().indices, -1).to_numpy(zero_copy_only=False).astype(np.int64)


def _open_depths(terms: np.ndarray, offsets: np.ndarray, size: np.ndarray) -> np.ndarray:
    """How many terms each suffix shares with the one before: the prefixes that stay open on the stack."""
    depth = np.zeros(len(size), np.int64)
    same = np.arange(1, len(size))
    for d in range(int(size.max(initial=0))):
        same = same[(size[same] > d) & (size[same - 1] > d)]
        same = same[terms[offsets[same] + d] == terms[offsets[same - 1] + d]]
        depth[same] = d + 1
    return depth


def _folded(suffixes: pa.ListArray, records: pa.Array, weights: np.ndarray) -> Iterator[pa.RecordBatch]:
    """The counts of all prefixes of suffixes that come in reverse lexicographic order.

    A prefix of ``d`` terms is pushed where a suffix shares fewer with the one before, and popped before the next such
    place; so all stack frames of one depth lie between these places, and are added up together.
    """
    offsets, values = suffixes.offsets.to_numpy().astype(np.int64), suffixes.values
    size = np.diff(offsets)
    depth, record = _open_depths(_codes(values), offsets, size), _codes(records)
    many = int(record.max(initial=0)) + 1
    for d in range(1, int(size.max(initial=0)) + 1):
        rows = np.flatnonzero(size >= d)
        frame = np.cumsum(depth < d)[rows]
        first = np.flatnonzero(np.r_[True, frame[1:] != frame[:-1]])
        frame = np.repeat(np.arange(len(first)), np.diff(np.r_[first, len(rows)]))
        known = record[rows] >= 0
        held = np.bincount(np.unique(frame[known] * many + record[rows][known]) // many, minlength=len(first))
        at = (offsets[rows[first]][:, None] + np.arange(d)).reshape(-1)
        ngrams = pa.ListArray.from_arrays(pa.array(np.arange(0, len(at) + 1, d, dtype=np.int32)), values.take(pa.array(at)))
        yield pa.RecordBatch.from_arrays([ngrams, pa.array(np.add.reduceat(weights[rows], first)), pa.array(held)], ["ngram", "total", "records"])


def _stack_counts(max_n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = pa.Table.from_batches([batch])
            if max_n > 1:  # longer suffixes wait for all that have their first term; single terms are added up anyway
                rows = pa.concat_tables([held, rows]) if held is not None else rows
                first = _codes(pc.list_element(rows.column("suffix"), 0).combine_chunks())
                other = np.flatnonzero(first != first[-1])
                keep = int(other[-1]) + 1 if len(other) else 0
                held, rows = rows.slice(keep), rows.slice(0, keep)
            yield from folded(rows)
        if held is not None:
            yield from folded(held)

    def folded(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        if rows.num_rows:
            whole = pa.Table.from_batches(rows.to_batches()).combine_chunks().to_batches()[0]
            suffixes = whole.column("suffix")
            suffixes = pa.ListArray.from_arrays(pa.array(suffixes.offsets.to_numpy() - suffixes.offsets[0].as_py(), pa.int32()), suffixes.flatten())
            yield from _folded(suffixes, whole.column("record"), whole.column("weight").to_numpy())

    return run


def ngram_counts(df: DataFrame, record: str, terms: str, weight: str | None = None, max_n: int = 1, spread: int | None = None) -> DataFrame:
    """Rows (ngram, total, records) for every n-gram of up to ``max_n`` terms of the array column ``terms``.

    ``total`` adds up ``weight`` (1 where none is given) over the occurrences, ``records`` counts the distinct
    non-null values of ``record`` that hold the n-gram. A null or empty array and null terms at the start of a suffix
    give nothing (a suffix ends before a null term); a null weight counts as 0, a null record adds to the totals only;
    repeated rows count again; an empty table gives an empty result; other columns are ignored, whatever their names.

    Each position makes one truncated suffix; equal suffixes of a record are added up before anything is shuffled. What
    is left is routed by its first term and by its record, so that a hot term spreads over ``spread`` tasks, by default
    as many as the session has shuffle partitions. A task sees its suffixes in reverse lexicographic order and folds
    them into their prefixes from a stack. Records of different routes differ, so the counts of the routes add up. With
    ``max_n`` above 1 a task holds the suffixes of one first term's records of one route, else one batch.
    """
    spread = spread or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    amount = F.coalesce(F.col(weight).cast("bigint"), F.lit(0)) if weight else F.lit(1).cast("bigint")
    given = df.select(F.col(record).cast("string").alias("record"), F.col(terms).alias("terms"), amount.alias("weight"))
    if max_n == 1:
        one = given.select(F.explode("terms").alias("first"), "record", "weight")
        suffixes = one.select(F.array("first").alias("suffix"), "record", "weight", "first")
    else:
        one = given.select("terms", "record", "weight", F.posexplode("terms").alias("at", "first"))
        cutoff = F.slice("terms", F.col("at") + 1, max_n)
        gap = F.array_position(F.transform(cutoff, lambda t: t.isNull()), True)
        suffixes = one.select(F.when(gap > 0, F.slice(cutoff, F.lit(1), gap.cast("int") - 1)).otherwise(cutoff).alias("suffix"), "record", "weight", "first")
    suffixes = suffixes.where(F.col("first").isNotNull()).groupBy("suffix", "record", "first").agg(F.sum("weight").alias("weight"))
    route = F.pmod(F.xxhash64(F.coalesce("record", F.lit(""))), F.lit(spread))
    routed = suffixes.withColumn("route", route).repartition("first", "route").sortWithinPartitions(F.desc("suffix"), "route")
    parts = routed.select("suffix", "record", "weight").mapInArrow(_stack_counts(max_n), _COUNTS)
    return parts.groupBy("ngram").agg(F.sum("total").alias("total"), F.sum("records").alias("records"))


def marked_terms(counts: DataFrame, records: int, rare_total: int, common_share: float) -> DataFrame:
    """``counts`` with ``marks``: ``rare`` for a total of at most ``rare_total``, ``common`` for n-grams in at least
    ``common_share`` of all ``records``; both or none are possible. Without any record nothing is common."""
    rare = F.when(F.col("total") <= rare_total, F.lit("rare"))
    common = F.when((F.col("records") >= common_share * records) & F.lit(records > 0), F.lit("common"))
    return counts.withColumn("marks", F.array_compact(F.array(rare, common)))
