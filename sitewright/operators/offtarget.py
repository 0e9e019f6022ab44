"""Other guides of the library that are too similar to a candidate.

A guide of up to 63 letters is two integers, the upper and the lower bit of each letter, so two guides differ where
either differs. Guides meet on the letters of some blocks ("key") and are compared in the task that holds the key.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import combinations
from math import ceil, comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sitewright.plans.stage import cut

#: Candidates and library guides of one key that one group compares; keys with more are dealt to several groups.
WANTED_A_GROUP, LIBRARY_A_GROUP = 2048, 65536
#: One guide in so many tells which keys are hot; their groups hold all their guides.
COUNTED = 16
#: What a guide sent under one more key costs, in comparisons of two guides.
KEY_COST = 1000
_AT_ONCE = 1 << 18  # comparisons held in memory
_LARGE = 4096  # comparisons from which a group is worth a table of its own
_PAIRS = "guide string, other string, distance int"


def _masks(letters: int, blocks: int) -> list[int]:
    """For each block of letters the mask of its bits."""
    edges = [round(i * letters / blocks) for i in range(blocks + 1)]
    return [sum(1 << (letters - 1 - i) for i in range(a, b)) for a, b in zip(edges, edges[1:], strict=False)]


def _choices(blocks: int, differing: int) -> list[int]:
    """The blocks that ``differing`` letters can leave untouched, as bits; one empty choice where they can touch all."""
    kept = max(0, blocks - differing)
    return [sum(1 << b for b in some) for some in combinations(range(blocks), kept)]


def best_blocks(letters: int, within: int, wanted: int, library: int) -> tuple[int, float]:
    """The number of blocks for which finding guides within so many letters costs least, and that cost.

    More blocks make longer keys, which fewer pairs share, and more keys a guide; the larger the library, the longer the
    keys. ``within`` blocks or fewer mean that all are compared with all, in groups.
    """
    rows, columns = ceil(wanted / WANTED_A_GROUP), ceil(library / LIBRARY_A_GROUP)
    best = within, float(wanted) * library + KEY_COST * (wanted * columns + library * rows)
    for blocks in range(within + 1, min(letters, within + 12) + 1):
        keys = comb(blocks, within)
        met = keys * wanted * library / 4.0 ** (letters * (blocks - within) / blocks)
        cost = met + KEY_COST * keys * (wanted + library)
        if cost < best[1]:
            best = blocks, cost
    return best


def _planes(guide: Column) -> tuple[Column, Column]:
    return tuple(F.conv(F.translate(guide, "ACGT", bits), 2, 10).cast("bigint") for bits in ("0011", "0101"))


def _parts(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def distinct_guides(df: DataFrame) -> DataFrame:
    """The distinct non-null guides (guide, hi, lo) of column guide, kept for several passes."""
    hi, lo = _planes(F.col("guide"))
    return cut(df.where(F.col("guide").isNotNull()).select("guide").distinct().select("guide", hi.alias("hi"), lo.alias("lo")))


def _keyed(codes: DataFrame, side: int, masks: list[int], choices: list[int]) -> DataFrame:
    """A row (key, tag, hi, lo) for each choice; the tag holds the number of the choice and the side."""

    def row(n: int, choice: int) -> Column:
        mask = F.lit(sum(m for b, m in enumerate(masks) if choice >> b & 1)).cast("bigint")
        key = F.xxhash64(F.lit(n), F.col("hi").bitwiseAND(mask), F.col("lo").bitwiseAND(mask))
        return F.struct(key.alias("key"), F.lit(2 * n + side).alias("tag"))

    return codes.select("hi", "lo", F.inline(F.array(*(row(n, c) for n, c in enumerate(choices))))).select("key", "tag", "hi", "lo")


def _dealt(left: DataFrame, right: DataFrame, one_key: tuple[int, int] | None) -> DataFrame:
    """Both sides under one schema, the groups of hot keys dealt to several: each candidate goes to one row of groups and
    each library guide to one column, so that every pair meets once. ``one_key``: the sizes, where all share one key."""
    both = left.unionByName(right)
    if one_key:
        rows, columns = (max(1, ceil(n / size)) for n, size in zip(one_key, (WANTED_A_GROUP, LIBRARY_A_GROUP), strict=True))
        both = both.withColumns({"rows": F.lit(rows), "columns": F.lit(columns)})
    else:
        wanted = F.col("tag") % 2 == 0
        some = both.where(F.pmod(F.xxhash64("lo", "hi"), F.lit(COUNTED)) == 0)
        counts = some.groupBy("key").agg((COUNTED * F.count_if(wanted)).alias("w"), (COUNTED * F.count_if(~wanted)).alias("l"))
        # every hot key holds this many rows, so there are few
        hot = cut(counts.where((F.col("w") > WANTED_A_GROUP) | (F.col("l") > LIBRARY_A_GROUP)))
        if hot.isEmpty():
            return both
        spread = hot.select("key", F.greatest(F.ceil(F.col("w") / WANTED_A_GROUP), F.lit(1)).cast("int").alias("rows"), F.greatest(F.ceil(F.col("l") / LIBRARY_A_GROUP), F.lit(1)).cast("int").alias("columns"))
        both = both.join(spread, "key", "left").fillna(1, ["rows", "columns"])
    wanted = F.col("tag") % 2 == 0
    own = F.pmod(F.xxhash64("lo", "hi"), F.when(wanted, F.col("rows")).otherwise(F.col("columns")))
    every = F.explode(F.sequence(F.lit(0), F.when(wanted, F.col("columns")).otherwise(F.col("rows")) - 1))
    dealt = both.select("key", "tag", "hi", "lo", "columns", own.alias("own"), every.alias("other"))
    place = F.when(wanted, F.col("own") * F.col("columns") + F.col("other")).otherwise(F.col("other") * F.col("columns") + F.col("own"))
    return dealt.select(F.when(F.col("columns").isNotNull(), F.xxhash64("key", place)).alias("key"), "tag", "hi", "lo")


def _nearest_only(i: np.ndarray, j: np.ndarray, d: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each ``i`` the ``k`` pairs with the least ``d``, and those that tie with the last of them."""
    order = np.lexsort((d, i))
    i, j, d = i[order], j[order], d[order]
    first = np.flatnonzero(np.r_[True, i[1:] != i[:-1]])
    size = np.diff(np.r_[first, len(i)])
    limit = d[first + np.minimum(k, size) - 1]
    keep = d <= np.repeat(limit, size)
    return i[keep], j[keep], d[keep]


def _met_in_runs(hi: np.ndarray, lo: np.ndarray, begin: np.ndarray, wanted: np.ndarray, end: np.ndarray, within: int, k: int | None):
    """Close pairs (i, j, distance) of rows, run by run: rows [begin, wanted) are candidates, [wanted, end) library."""
    sizes = end - wanted
    large = sizes * (wanted - begin) >= _LARGE
    for a, b, e in zip(begin[large], wanted[large], end[large], strict=True):
        step = max(1, _AT_ONCE // int(e - b))
        for top in range(a, b, step):
            some = slice(top, min(b, top + step))
            differ = hi[some, None] ^ hi[None, b:e]
            differ |= lo[some, None] ^ lo[None, b:e]
            count = np.bitwise_count(differ)
            count -= 1  # itself wraps round and is far
            most = np.uint8(within - 1) if k is None else _limits(count, within, k)[:, None]
            i, j = np.divmod(np.flatnonzero(count <= most), e - b)
            yield i + top, j + b, count[i, j] + 1
    small = ~large
    rows = np.concatenate([np.arange(a, b) for a, b in zip(begin[small], wanted[small], strict=True)]) if small.any() else np.empty(0, np.int64)
    partners, at = (np.repeat(x[small], (wanted - begin)[small]) for x in (sizes, wanted))
    ends = np.cumsum(partners)
    done = 0
    while done < len(rows):
        until = max(done + 1, int(np.searchsorted(ends, (ends[done - 1] if done else 0) + _AT_ONCE)))
        n = partners[done:until]
        i = np.repeat(rows[done:until], n)
        j = np.arange(len(i)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(at[done:until], n)
        d = np.bitwise_count((hi[i] ^ hi[j]) | (lo[i] ^ lo[j]))
        near = (d <= within) & (d > 0)
        yield i[near], j[near], d[near]
        done = until


def _limits(count: np.ndarray, within: int, k: int) -> np.ndarray:
    """For each row the value (a distance less one) of its ``k``-th least, at most ``within`` - 1."""
    if k == 1:
        return np.minimum(count.min(1), within - 1).astype(np.uint8)
    limit, seen = np.full(len(count), within - 1, np.uint8), np.zeros(len(count), np.int64)
    for d in range(within - 1):
        seen += np.count_nonzero(count == d, axis=1)
        limit[seen >= k] = np.minimum(limit[seen >= k], d)
        if (seen >= k).all():
            break
    return limit


def _letters_of(hi: np.ndarray, lo: np.ndarray, letters: int) -> pa.Array:
    shifts = np.arange(letters - 1, -1, -1, dtype=np.uint64)
    bits = 2 * (hi[:, None] >> shifts & np.uint64(1)) + (lo[:, None] >> shifts & np.uint64(1))
    text = np.frombuffer(b"ACGT", np.uint8)[bits.astype(np.uint8)]
    return pa.StringArray.from_buffers(len(hi), pa.py_buffer(np.arange(0, (len(hi) + 1) * letters, letters, dtype=np.int32)), pa.py_buffer(np.ascontiguousarray(text)))


def _search(letters: int, within: int, masks: list[int], choices: list[int], k: int | None):
    blocks = np.asarray(masks, np.uint64)
    bits = np.asarray(choices, np.int64)

    def pairs(key: np.ndarray, tag: np.ndarray, hi: np.ndarray, lo: np.ndarray) -> Iterator[pa.RecordBatch]:
        choice, library = tag >> 1, tag & 1
        start = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (choice[1:] != choice[:-1])])
        end = np.r_[start[1:], len(key)]
        middle = end - np.add.reduceat(library, start)
        live = (middle > start) & (end > middle)
        hi, lo = hi.view(np.uint64), lo.view(np.uint64)
        short = (hi.astype(np.uint32), lo.astype(np.uint32)) if letters <= 32 else (hi, lo)
        for i, j, d in _met_in_runs(*short, start[live], middle[live], end[live], within, k):
            if len(choices) > 1:  # a pair that shares several choices counts in the first one
                differ = (hi[i] ^ hi[j]) | (lo[i] ^ lo[j])
                equal = np.zeros(len(i), np.int64)
                for b, mask in enumerate(blocks):
                    equal |= (differ & mask == 0).astype(np.int64) << b
                others = equal & ~bits[choice[i]]
                once = (others == 0) | ((others & -others) > bits[choice[i]])
                i, j, d = i[once], j[once], d[once]
            if k is not None and len(i):
                i, j, d = _nearest_only(i, j, d, k)
            if len(i):
                yield pa.RecordBatch.from_arrays([_letters_of(hi[i], lo[i], letters), _letters_of(hi[j], lo[j], letters), pa.array(d.astype(np.int32))], ["guide", "other", "distance"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            now = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("key", "tag", "hi", "lo")]
            if held is not None:
                now = [np.concatenate(x) for x in zip(held, now, strict=True)]
            keep = int(np.searchsorted(now[0], now[0][-1]))  # before the batch's last key all groups are whole
            if keep:
                yield from pairs(*(x[:keep] for x in now))
            held = [x[keep:] for x in now]
        if held is not None:
            yield from pairs(*held)

    return run


def _met(wanted: DataFrame, library: DataFrame, letters: int, within: int, blocks: int, k: int | None, sizes: tuple[int, int]) -> DataFrame:
    """Pairs (guide, other, distance) of 1 to ``within`` letters, each once; with ``k`` only each group's nearest."""
    masks = _masks(letters, blocks)
    choices = _choices(blocks, within)
    left, right = (_keyed(df, side, masks, choices) for side, df in enumerate((wanted, library)))
    dealt = _dealt(left, right, sizes if len(choices) == 1 and not choices[0] else None)
    arrays = dealt.repartition(_parts(library), "key").sortWithinPartitions("key", "tag")  # few bytes are much work here
    return arrays.mapInArrow(_search(letters, within, masks, choices, k), _PAIRS)


def similar_guides(candidates: DataFrame, library: DataFrame, letters: int, within: int, blocks: int | None = None) -> DataFrame:
    """Rows (guide, other, distance): library guides that differ from a candidate in 1 to ``within`` letters.

    Both inputs have a column guide of ``letters`` letters A, C, G, T; nulls take no part, repeated guides count once;
    other columns are ignored. A difference in ``within`` letters leaves some choice of blocks untouched, so pairs meet
    on the letters of a choice, and each pair is kept in its first choice only: nothing is missed and nothing has to be
    made distinct. The number of blocks follows from the sizes of the inputs.
    """
    if within < 1:
        return candidates.select("guide", F.lit(None).cast("string").alias("other"), F.lit(0).alias("distance")).limit(0)
    wanted, known = distinct_guides(candidates), distinct_guides(library)
    sizes = wanted.count(), known.count()
    return _met(wanted, known, letters, within, blocks or best_blocks(letters, within, *sizes)[0], None, sizes)


def nearest_guides(candidates: DataFrame, library: DataFrame, letters: int, k: int = 1) -> DataFrame:
    """Rows (guide, other, distance, rank): for every candidate the ``k`` library guides that differ from it in the
    fewest letters, however many these are, ties by the other's letters. Itself is not counted.

    Inputs are those of ``similar_guides``. The search is widened in tiers: first to two letters, which is cheap, then
    to the distance at which a library of even letters would have ``k`` others, then by one letter at a time; whoever
    has ``k`` leaves, and once comparing the rest with all is less work, that is done. The result is exact; only a library
    of fewer than ``k`` others gives fewer rows.
    """
    wanted, known = distinct_guides(candidates), distinct_guides(library)
    n, m = wanted.count(), known.count()
    dense, expected = 0, 0.0
    while dense < letters and expected < 2 * k + 1:  # library guides so near, were all letters even
        dense += 1
        expected += m * comb(letters, dense) * 3.0**dense / 4.0**letters
    found, within = [], min(2, dense)
    while n and m:
        blocks, cost = best_blocks(letters, within, n, m)
        _, all_cost = best_blocks(letters, letters, n, m)
        if cost >= all_cost or within >= letters:
            within, blocks = letters, letters
        order = Window.partitionBy("guide").orderBy("distance", "other")
        near = _met(wanted, known, letters, within, blocks, k, (n, m))
        near = cut(near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k))
        if within == letters:
            found.append(near)
            break
        done = near.where(F.col("rank") == k).select("guide")
        found.append(near.join(done, "guide", "left_semi"))
        wanted = cut(wanted.join(done, "guide", "left_anti"))
        n, within = wanted.count(), max(within + 1, dense)
    none = wanted.select("guide", F.col("guide").alias("other"), F.lit(0).alias("distance"), F.lit(0).alias("rank")).limit(0)
    return reduce(DataFrame.unionByName, found) if found else none


def nearest_library_guide(candidates: DataFrame, library: DataFrame, letters: int) -> DataFrame:
    """Rows (guide, other, distance): the nearest other library guide of every candidate, ties by its letters."""
    return nearest_guides(candidates, library, letters).drop("rank")


def specific_guides(candidates: DataFrame, library: DataFrame, letters: int, edit_distance: int, distance: str = "hamming") -> DataFrame:
    """Candidates (guide, nearest, nearest_distance) of which no other library guide is nearer than ``edit_distance``.

    In ``hamming`` mode all other guides count. In ``levenshtein`` mode the three that differ in the fewest letters,
    however many, must be at least ``edit_distance`` edits away. ``nearest`` is the other guide that differs in the
    fewest letters; null only where the library has no other. An edit distance of 0 keeps all.
    """
    edits = distance == "levenshtein"
    near = nearest_guides(candidates, library, letters, 3 if edits else 1)
    apart = F.levenshtein("guide", "other") if edits else F.col("distance")
    close = near.groupBy("guide").agg(F.min(F.when(F.col("rank") == 1, F.struct("other", "distance"))).alias("nearest"), F.min(apart).alias("least"))
    found = candidates.where(F.col("guide").isNotNull()).select("guide").distinct().join(close, "guide", "left")
    kept = found.where(F.col("least").isNull() | (F.col("least") >= edit_distance))
    return kept.select("guide", F.col("nearest.other").alias("nearest"), F.col("nearest.distance").alias("nearest_distance"))


def mismatch_counts(guides: DataFrame, library: DataFrame, letters: int, most: int = 5) -> DataFrame:
    """A row (guide, mm0, ..., mm<most>) for every row of ``guides``: library guides that differ in so many letters.

    ``mm0`` is 1 where the library has the guide itself. Repeated rows are counted again each, null guides have null
    counts; other columns of ``guides`` stay.
    """
    pairs = similar_guides(guides, library, letters, most)
    counts = pairs.groupBy("guide").agg(*(F.count_if(F.col("distance") == d).alias(f"mm{d}") for d in range(1, most + 1)))
    own = library.select("guide").distinct().withColumn("mm0", F.lit(1).cast("bigint"))
    names = [f"mm{d}" for d in range(most + 1)]
    found = guides.drop(*names).join(own, "guide", "left").join(counts, "guide", "left")
    return found.withColumns({c: F.when(F.col("guide").isNotNull(), F.coalesce(c, F.lit(0))) for c in names})


def histogram_over_runs(counts: DataFrame, run: str, most: int = 5) -> DataFrame:
    """Rows (mismatches, mean, deviation) over the runs of ``mismatch_counts``: the totals of each class in each run,
    their mean and population deviation; every guide's match with itself is taken from class 0."""
    totals = counts.groupBy(run).agg(*((F.sum(f"mm{d}") - (F.count("guide") if d == 0 else 0)).cast("double").alias(f"mm{d}") for d in range(most + 1)))
    rows = totals.select(run, F.inline(F.array(*(F.struct(F.lit(d).alias("mismatches"), F.col(f"mm{d}").alias("n")) for d in range(most + 1)))))
    return rows.groupBy("mismatches").agg(F.avg("n").alias("mean"), F.stddev_pop("n").alias("deviation"))
