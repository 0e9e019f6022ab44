"""Overlapping intervals merged into periods, and the gaps between them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitewright.plans.stage import cut

_SUMMARY = "part int, first_entity string, last_entity string, last_end bigint, last_start bigint"
_FOUND = "entity string, kind string, start bigint, stop bigint"


def _ends(batch: pa.RecordBatch, carry: tuple[str, int, int] | None, adjoin: int) -> tuple:
    """Running maximum end before each row of its entity, with island starts; carry is (entity, end, island start)."""
    entity = np.asarray(batch.column("entity").to_pylist(), dtype=object)
    start = batch.column("start").to_numpy(zero_copy_only=False)
    stop = batch.column("stop").to_numpy(zero_copy_only=False)
    fresh = np.ones(len(entity), bool)
    fresh[1:] = entity[1:] != entity[:-1]
    goes_on = carry is not None and entity[0] == carry[0]
    fresh[0] = not goes_on
    group = np.cumsum(fresh)
    # ranks of the ends keep the running maximum inside each entity: a later entity always has larger keys
    order = np.unique(np.append(stop, carry[1]) if goes_on else stop)
    key = group * len(order) + np.searchsorted(order, stop)
    if goes_on:
        key = np.concatenate([[np.searchsorted(order, carry[1])], key])
    else:
        key = np.concatenate([[-1], key])
    running = np.maximum.accumulate(key)
    before = order[running[:-1] % len(order)]
    after = order[running[1:] % len(order)]
    opens = fresh | (start > before + adjoin)
    return entity, start, before, after, fresh, opens


def _summaries(adjoin: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, carry, part = None, None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            entity, start, _, after, _, opens = _ends(batch, carry, adjoin)
            part = batch.column("part")[0].as_py()
            first = entity[0] if first is None else first
            at = np.flatnonzero(opens)
            carry = (entity[-1], int(after[-1]), int(start[at[-1]]) if len(at) else carry[2])
        if carry is not None:
            yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "first_entity": [first], "last_entity": [carry[0]], "last_end": [carry[1]], "last_start": [carry[2]]})

    return run


def _rescan(carries: dict[int, tuple[str, int, int]], adjoin: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carry, known = None, False
        for batch in batches:
            if not batch.num_rows:
                continue
            if not known:
                carry, known = carries.get(batch.column("part")[0].as_py()), True
            entity, start, before, after, fresh, opens = _ends(batch, carry, adjoin)
            at = np.flatnonzero(opens)
            runs = np.concatenate([[0], at]) if not opens[0] else at  # the first run may go on from before
            ends = np.append(runs[1:], len(entity)) - 1
            begun = start[runs].copy()
            if not opens[0]:
                begun[0] = carry[2]
            gap = np.flatnonzero(opens & ~fresh)
            yield pa.RecordBatch.from_pydict(
                {
                    "entity": pa.array(list(entity[runs]) + list(entity[gap]), pa.string()),
                    "kind": pa.array(["covered"] * len(runs) + ["gap"] * len(gap), pa.string()),
                    "start": pa.array(np.concatenate([begun, before[gap] + 1]), pa.int64()),
                    "stop": pa.array(np.concatenate([after[ends], start[gap] - 1]), pa.int64()),
                }
            )
            carry = (entity[-1], int(after[-1]), int(begun[-1]))

    return run


def prefix_combine(rows: list, adjoin: int) -> dict[int, tuple[str, int, int]]:
    """What each partition takes over from those before it, from one summary a partition in order."""
    carries: dict[int, tuple[str, int, int]] = {}
    carry: tuple[str, int, int] | None = None
    for part, first, last, end, start in rows:
        if carry is not None and carry[0] == first:
            carries[part] = carry
        if carry is not None and carry[0] == last:
            carry = (last, max(carry[1], end), carry[2] if start <= carry[1] + adjoin else start)
        else:
            carry = (last, end, start)
    return carries


def periods_and_gaps(df: DataFrame, entity: str, start: str, stop: str, adjoin: int = 1, partitions: int | None = None) -> DataFrame:
    """Rows (entity, kind, start, stop): the periods that the closed integer intervals cover, and the gaps between them.

    The smaller coordinate of a row counts as its start. Intervals of an entity that share a point, or of which the next
    starts at most ``adjoin`` after the end, form one ``covered`` period; a ``gap`` runs from the first to the last point
    between two periods of an entity. Rows with a null entity or coordinate take no part; equal rows count once; an
    empty table gives an empty result; other columns are dropped, whatever their names.

    Rows are range-sorted by entity and start over the cluster, each partition is summed up to its last entity's largest
    end and open period, the summaries (one short row a partition) are combined in order, and each partition is scanned
    again with what it takes over. So an entity with most of the rows spreads over many tasks.
    """
    a, b = F.col(start).cast("bigint"), F.col(stop).cast("bigint")
    known = df.where(F.col(entity).isNotNull() & a.isNotNull() & b.isNotNull())
    rows = known.select(F.col(entity).cast("string").alias("entity"), F.least(a, b).alias("start"), F.greatest(a, b).alias("stop")).distinct()
    count = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = rows.repartitionByRange(count, "entity", "start", "stop").sortWithinPartitions("entity", "start", "stop")
    ranged = cut(ranged.withColumn("part", F.spark_partition_id()))
    sums = ranged.mapInArrow(_summaries(adjoin), _SUMMARY)
    carries = prefix_combine(sorted(tuple(r) for r in sums.collect()), adjoin)
    found = ranged.mapInArrow(_rescan(carries, adjoin), _FOUND)
    # a period that crosses partitions or batches was written once by each, with the same start
    return found.groupBy("entity", "kind", "start").agg(F.max("stop").alias("stop")).select("entity", "kind", "start", "stop")
