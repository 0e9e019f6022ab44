"""The most similar guides of every guide, by a forest of sorted hash strings."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sitewright.functions.guides import GUIDE_LETTERS, pack, unpack
from sitewright.operators import offtarget
from sitewright.plans.stage import cut

BLOCKS, COVERED = 5, 2
#: Trees whose prefixes cover every choice of ``COVERED`` differing letters, and further ones with letters in any order.
COVERING_TREES, FREE_TREES = 10, 6
#: A tree has enough candidates for a guide once so many share the prefix; all trees ascend until half of them have.
SHARE = 64
#: Rows of the sorted arrays that one group holds, and how far a guide looks to either side.
BLOCK, REACH = 32_768, 2048
_PAIRS_AT_ONCE = 1 << 20
_CROWDED = -1


def tree_orders(seed: int = 1) -> list[list[int]]:
    """For each tree the order of a guide's letters in its hash string.

    Two guides that differ in at most ``COVERED`` letters share three of five blocks of letters; every such choice comes
    first, its letters mixed, in one of the covering trees.
    """
    r = np.random.default_rng(seed)
    size = GUIDE_LETTERS // BLOCKS
    orders = []
    for kept in combinations(range(BLOCKS), BLOCKS - COVERED):
        first = [size * b + i for b in kept for i in range(size)]
        rest = [i for i in range(GUIDE_LETTERS) if i not in first]
        orders.append([*r.permutation(first).tolist(), *r.permutation(rest).tolist()])
    return orders + [r.permutation(GUIDE_LETTERS).tolist() for _ in range(FREE_TREES)]


SURE_PREFIX = GUIDE_LETTERS - COVERED * GUIDE_LETTERS // BLOCKS  # letters that a covering tree has first


def _distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    x = a ^ b
    return np.bitwise_count((x | (x >> 1)) & 0x5555555555555555)


def _shared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Letters of the longest common prefix of two hash strings."""
    x = (a ^ b).astype(np.float64)  # whole numbers below 2 ** 40 keep their highest bit
    return np.where(x > 0, GUIDE_LETTERS - 1 - (np.frexp(x)[1] - 1) // 2, GUIDE_LETTERS)


def _plant(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The hash string of each guide in each tree."""
    orders = tree_orders()
    for batch in batches:
        codes = batch.column("code").to_numpy()
        letters = [codes >> 2 * (GUIDE_LETTERS - 1 - i) & 3 for i in range(GUIDE_LETTERS)]
        for tree, order in enumerate(orders):
            value = np.zeros(len(codes), np.int64)
            for i in order:
                value = value << 2 | letters[i]
            yield pa.RecordBatch.from_pydict({"tree": pa.array(np.full(len(codes), tree, np.int32)), "hash": pa.array(value), "code": pa.array(codes)})


def _neighbour_prefixes(tree: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Letters that each row shares with the row before it; -1 at the first row and between trees."""
    out = np.full(len(hashes), -1)
    out[1:] = np.where(tree[1:] == tree[:-1], _shared(hashes[1:], hashes[:-1]), -1)
    return out


def _runs(prefixes: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
    """For each row the ends [begin, end) of the rows around it that share ``level`` letters."""
    begin = np.flatnonzero(prefixes < level)
    number = np.cumsum(prefixes < level) - 1
    return begin[number], np.r_[begin[1:], len(prefixes)][number]


def _descend(share: int, k: int):
    """For each row of the sorted arrays the longest prefix that ``share`` others share with it, and a bound on the
    distance of its ``k``-th neighbour, from the rows next to it."""

    def level_of(tree: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        prefixes = _neighbour_prefixes(tree, hashes)
        level = np.full(len(hashes), -1)
        for x in range(GUIDE_LETTERS, -1, -1):
            begin, end = _runs(prefixes, x)
            level[(level < 0) & (end - begin > share)] = x
        near = np.full((2 * k, len(hashes)), GUIDE_LETTERS, np.uint8)
        for step in range(1, min(k, len(hashes) - 1) + 1):
            apart = np.where(tree[step:] == tree[:-step], _distance(hashes[step:], hashes[:-step]), GUIDE_LETTERS)
            near[step - 1, step:], near[k + step - 1, :-step] = apart, apart
        return np.maximum(level, 0), np.partition(near, k - 1, axis=0)[k - 1]

    def told(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        rows = pa.Table.from_batches(held).combine_chunks()
        level, bound = level_of(*(rows.column(c).to_numpy() for c in ("tree", "hash")))
        columns = {c: rows.column(c).combine_chunks() for c in ("at", "tree", "hash", "code")}
        return pa.RecordBatch.from_pydict(columns | {"level": pa.array(level.astype(np.int32)), "bound": pa.array(bound.astype(np.int32))})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) >= BLOCK:  # prefixes at a seam only come out shorter
                yield told(held)
                held = []
        if sum(b.num_rows for b in held):
            yield told(held)

    return run


def _ascend(k: int):
    """Of the guides that share a row's prefix of its level the nearest, at most as far as its bound."""

    def pairs(at: np.ndarray, tree: np.ndarray, hashes: np.ndarray, codes: np.ndarray, level: np.ndarray, bound: np.ndarray, own: np.ndarray) -> Iterator[pa.RecordBatch]:
        prefixes = _neighbour_prefixes(tree, hashes)
        begin, end = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
        for x in np.unique(level[own]):
            some = own & (level == x)
            a, b = _runs(prefixes, int(x))
            begin[some], end[some] = a[some], b[some]
        rows = np.flatnonzero(own)
        crowded = (rows - begin[rows] > REACH) | (end[rows] - rows > REACH + 1)
        yield batch_of(codes[rows[crowded]], codes[rows[crowded]], np.full(int(crowded.sum()), _CROWDED))
        rows = rows[~crowded]
        size = end[rows] - begin[rows]
        ends, done = np.cumsum(size), 0
        while done < len(rows):
            until = max(done + 1, int(np.searchsorted(ends, (ends[done - 1] if done else 0) + _PAIRS_AT_ONCE)))
            n = size[done:until]
            place = np.repeat(np.arange(until - done), n)
            i = rows[done:until][place]
            j = np.arange(len(i)) - np.repeat(np.cumsum(n) - n, n) + begin[rows[done:until]][place]
            d = _distance(hashes[i], hashes[j]).astype(np.int64)
            met = np.bincount(place * (GUIDE_LETTERS + 1) + d, minlength=(until - done) * (GUIDE_LETTERS + 1)).reshape(-1, GUIDE_LETTERS + 1)
            met[:, 0] -= 1  # itself
            limit = np.minimum((np.cumsum(met, 1) < k).sum(1), bound[rows[done:until]])
            near = np.flatnonzero((d <= limit[place]) & (i != j))
            i, j, d = i[near], j[near], d[near]
            order = np.lexsort((codes[j], d, i))
            i, j, d = i[order], j[order], d[order]
            first = np.flatnonzero(np.r_[True, i[1:] != i[:-1]]) if len(i) else np.empty(0, np.int64)
            rank = np.arange(len(i)) - np.repeat(first, np.diff(np.r_[first, len(i)]))
            yield batch_of(codes[i[rank < k]], codes[j[rank < k]], d[rank < k])
            done = until

    def batch_of(left: np.ndarray, right: np.ndarray, distance: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"left": pa.array(left), "right": pa.array(right), "distance": pa.array(distance.astype(np.int32))})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            now = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("block", "at", "tree", "hash", "code", "level", "bound", "own")]
            if held is not None:
                now = [np.concatenate(x) for x in zip(held, now, strict=True)]
            new = np.flatnonzero(now[0][1:] != now[0][:-1]) + 1
            edges = [0, *new.tolist()]
            for a, b in zip(edges, edges[1:], strict=False):
                yield from pairs(*(x[a:b] for x in now[1:]))
            held = [x[edges[-1] :] for x in now]
        if held is not None:
            yield from pairs(*held[1:])

    return run


def _numbered(rows: DataFrame, order: list[str]) -> DataFrame:
    """``rows`` sorted over all partitions, with their place from 0 in ``at``."""
    ranged = cut(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id()).withColumn("row", F.monotonically_increasing_id()))
    counts = ranged.groupBy("part").agg(F.count("*").alias("n"), F.min("row").alias("first"))  # one row a partition
    before = F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    counts = counts.select("part", F.col("first"), F.coalesce(before, F.lit(0)).alias("before"))
    return ranged.join(F.broadcast(counts), "part").withColumn("at", F.col("before") + F.col("row") - F.col("first")).drop("part", "row", "first", "before")


def forest_neighbours(codes: DataFrame, k: int, max_distance: int | None = None) -> DataFrame:
    """Rows (left, right, distance) of the distinct packed guides in column ``code``: for every one about the ``k``
    others with the fewest differing letters, with ``max_distance`` only those so near.

    Every tree is one sorted array of hash strings, range-sorted over the cluster. Each guide descends in each tree to
    the longest prefix that ``SHARE`` others share; then all trees ascend together, letter by letter, until half of them
    have so many, and whoever shares the prefix of that length in any tree is compared. Guides with ``max_distance`` at
    most ``COVERED`` letters apart share the ``SURE_PREFIX`` of a covering tree, to which the ascent then goes at least.
    A guide with more than ``REACH`` candidates on a side gets its neighbours by the exact search instead.
    """
    parts = int(codes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    planted = codes.select("code").repartition(parts, "code").mapInArrow(_plant, "tree int, hash bigint, code bigint")
    arrays = _numbered(planted, ["tree", "hash"])
    descended = arrays.mapInArrow(_descend(SHARE, k), "at bigint, tree int, hash bigint, code bigint, level int, bound int")
    together = descended.groupBy("code").agg(F.collect_list(F.struct("level", "at", "tree", "hash")).alias("places"), F.min("bound").alias("bound"))  # a place for each tree
    half = F.element_at(F.array_sort("places.level"), F.lit((COVERING_TREES + FREE_TREES) // 2))
    if max_distance is not None:
        half = F.least(half, F.lit(SURE_PREFIX))
        together = together.withColumn("bound", F.least("bound", F.lit(max_distance)))
    rows = together.select("code", "bound", half.alias("stop"), F.inline("places")).drop("level").withColumnRenamed("stop", "level")
    inside = F.col("at") % BLOCK
    beside = F.array(F.lit(0), F.when(inside < REACH + 1, F.lit(-1)), F.when(inside >= BLOCK - REACH - 1, F.lit(1)))
    held = rows.withColumn("step", F.explode(F.array_compact(beside)))
    held = held.select((F.floor(F.col("at") / BLOCK) + F.col("step")).alias("block"), "at", "tree", "hash", "code", "level", "bound", (F.col("step") == 0).alias("own"))
    found = held.repartition(parts, "block").sortWithinPartitions("block", "at").mapInArrow(_ascend(k), "left bigint, right bigint, distance int")
    found = cut(found.distinct())
    crowded = found.where(F.col("distance") == _CROWDED).select(F.col("left").alias("code"))
    near = found.where(F.col("distance") != _CROWDED)
    if not crowded.isEmpty():
        near = near.join(crowded, near["left"] == crowded["code"], "left_anti").unionByName(exact_neighbours(crowded, codes, k, max_distance))
    best = Window.partitionBy("left").orderBy("distance", "right")
    return near.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).drop("rank")


def exact_neighbours(wanted: DataFrame, codes: DataFrame, k: int, max_distance: int | None = None) -> DataFrame:
    """The same rows for the guides in ``wanted``, none missed however far, by the block join of the off-target search."""
    guides = [df.select(unpack(F.col("code")).alias("guide")) for df in (wanted, codes)]
    if max_distance is None:
        found = offtarget.nearest_guides(*guides, GUIDE_LETTERS, k).drop("rank")
    else:
        found = offtarget.similar_guides(*guides, GUIDE_LETTERS, max_distance)
    return found.select(pack(F.col("guide")).alias("left"), pack(F.col("other")).alias("right"), "distance")


def nearest_guides(df: DataFrame, site: str, code: str, k: int = 10, max_distance: int | None = None, exact: bool = False) -> DataFrame:
    """Rows (site, other, distance): for every site ``k`` sites with the most similar guides, ties by the other's guide,
    then to the smaller id; with ``max_distance`` only of those that differ in at most so many letters.

    Rows with a null site or code take no part, equal rows count once, a site is never its own neighbour; an empty table
    gives an empty result; other columns are dropped, whatever their names. A guide that very many sites share costs no
    more than its sites: every guide offers its first k + 1 sites to the others.

    The search is ``forest_neighbours``, which loses a few of the farther neighbours; pairs within a ``max_distance`` of
    up to ``COVERED`` letters are all seen. ``exact`` takes ``exact_neighbours`` instead.
    """
    if max_distance is not None and max_distance < 1:
        raise ValueError("max_distance must be at least 1")
    sites = df.select(F.col(site).alias("site"), F.col(code).alias("code")).dropna().distinct()
    by_id = Window.partitionBy("code").orderBy("site")
    heads = sites.withColumn("rank", F.row_number().over(by_id)).where(F.col("rank") <= k + 1).drop("rank")
    codes = cut(sites.select("code").distinct())
    near = exact_neighbours(codes, codes, k, max_distance) if exact else forest_neighbours(codes, k, max_distance)
    offered = near.join(heads.withColumnRenamed("code", "right").withColumnRenamed("site", "other"), "right").select(F.col("left").alias("code"), "right", "other", "distance")
    offered = offered.unionByName(heads.select("code", F.col("code").alias("right"), F.col("site").alias("other"), F.lit(0).alias("distance")))
    best = Window.partitionBy("code").orderBy("distance", "right", "other")
    lists = offered.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k + 1)
    lists = lists.groupBy("code").agg(F.array_sort(F.collect_list(F.struct("distance", "right", "other"))).alias("offers"))
    own = sites.join(lists, "code").select("site", F.slice(F.filter("offers", lambda o: o["other"] != F.col("site")), 1, k).alias("offers"))
    found = own.select("site", F.explode("offers").alias("o")).select("site", "o.other", "o.distance", "o.right")
    found = found.groupBy("site", "other").agg(F.min(F.struct("distance", "right")).alias("d")).select("site", "other", "d.distance", "d.right")  # a site may come with several guides
    again = Window.partitionBy("site").orderBy("distance", "right", "other")
    return found.withColumn("rank", F.row_number().over(again)).where(F.col("rank") <= k).select("site", "other", "distance")
