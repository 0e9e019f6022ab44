"""Documents packed into containers of fixed capacity by best fit decreasing."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sitewright.plans.stage import cut

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Splits text into words before the byte pairs are merged; fixed by the vocabulary (public byte-level BPE).
WORD_PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"
#: Containers that one task packs, shards whose half-empty containers one task brings together.
BINS_A_SHARD, SHARDS_A_ROUND = 250, 256


@lru_cache(1)
def _encoding(path: str):
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("packing", pat_str=WORD_PATTERN, mergeable_ranks=ranks, special_tokens={})


def _count(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = _encoding(path)
        for batch in batches:
            counts = [0 if t is None else len(encoding.encode_ordinary(t)) for t in (x.as_py() for x in batch.column("text"))]
            yield pa.RecordBatch.from_arrays([batch.column("doc"), pa.array(counts, pa.int64())], ["doc", "tokens"])

    return run


def token_counts(df: DataFrame, doc: str, text: str, tokenizer: str = TOKENIZER) -> DataFrame:
    """Rows (doc, tokens): the length of each text in tokens of the vocabulary file ``tokenizer``; null texts have none."""
    kind = T.StructType([T.StructField("doc", df.schema[doc].dataType), T.StructField("tokens", T.LongType())])
    return df.select(F.col(doc).alias("doc"), F.col(text).alias("text")).mapInArrow(_count(tokenizer), kind)


class CapacityTree:
    """Open bins by remaining capacity: a segment tree of how many there are, with the bins as stacks at the leaves."""

    def __init__(self, capacity: int):
        self.leaves = 1 << capacity.bit_length()
        self.count = [0] * (2 * self.leaves)
        self.bins: list[list[int]] = [[] for _ in range(capacity + 1)]

    def add(self, room: int, container: int) -> None:
        self.bins[room].append(container)
        node = room + self.leaves
        while node:
            self.count[node] += 1
            node >>= 1

    def tightest(self, size: int) -> int:
        """The least remaining capacity of at least ``size`` that an open bin has, or -1."""
        node = size + self.leaves
        if self.count[node]:
            return size
        while node > 1 and (node & 1 or not self.count[node + 1]):
            node >>= 1
        if node <= 1:
            return -1
        node += 1
        while node < self.leaves:
            node = 2 * node if self.count[2 * node] else 2 * node + 1
        return node - self.leaves

    def take(self, room: int) -> int:
        node = room + self.leaves
        while node:
            self.count[node] -= 1
            node >>= 1
        return self.bins[room].pop()


def best_fit_decreasing(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """The bin of each item, of sizes 1 to ``capacity``; ties are taken in the order given."""
    tree, bins, opened = CapacityTree(capacity), np.empty(len(sizes), np.int64), 0
    for i in np.argsort(-sizes, kind="stable").tolist():
        size = int(sizes[i])
        room = tree.tightest(size)
        if room < 0:
            container, room = opened, capacity
            opened += 1
        else:
            container = tree.take(room)
        bins[i] = container
        if room > size:
            tree.add(room - size, container)
    return bins


def _pack(capacity: int):
    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["row", "piece"], kind="stable", ignore_index=True)
        rows["bin"] = best_fit_decreasing(rows["tokens"].to_numpy(), capacity)
        return rows.assign(filled=rows.groupby("bin")["tokens"].transform("sum"))

    return run


def _bring_together(capacity: int):
    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["shard", "bin"], kind="stable", ignore_index=True)
        into = best_fit_decreasing(rows["filled"].to_numpy(), capacity)
        first = pd.Series(rows.index).groupby(into).transform("first").to_numpy()  # the container keeps its first one's name
        return rows[["shard", "bin"]].assign(to_shard=rows["shard"].to_numpy()[first], to_bin=rows["bin"].to_numpy()[first])

    return run


def pack_documents(sizes: DataFrame, capacity: int, bins_a_shard: int = BINS_A_SHARD) -> DataFrame:
    """Rows (doc, piece, begin, end, tokens, container): the tokens [begin, end) of each document and their container.

    ``sizes`` has columns doc and tokens. A document of more than ``capacity`` tokens gives pieces that fill a container
    each and one piece for the rest; no other document is split. Documents without tokens (null or empty texts) take no
    room and get a null container. Repeated rows are packed again; an empty table gives an empty result; other columns
    are dropped.

    Full pieces are containers already. The others are dealt at random, by a hash of the row, into shards of about
    ``bins_a_shard`` containers, each packed in one task by best fit decreasing. A shard leaves its last containers
    open; those that are at most half full are then brought together, as items of a second round, by groups of shards.
    """
    kind = sizes.schema["doc"].dataType
    sizes = cut(sizes.select("doc", F.coalesce("tokens", F.lit(0)).cast("bigint").alias("tokens")))
    sizes = sizes.withColumn("row", F.monotonically_increasing_id())
    last = F.greatest(F.ceil(F.col("tokens") / capacity) - 1, F.lit(0)).cast("int")
    pieces = sizes.select("doc", "row", "tokens", F.explode(F.sequence(F.lit(0), last)).alias("piece"))
    begin = F.col("piece").cast("bigint") * capacity
    pieces = pieces.select("doc", "row", "piece", begin.alias("begin"), F.least(begin + capacity, "tokens").alias("end")).withColumn("tokens", F.col("end") - F.col("begin"))
    rest = sizes.agg(F.sum(F.pmod("tokens", F.lit(capacity)))).first()[0] or 0
    shards = max(1, -(-rest // (capacity * bins_a_shard)))
    open_pieces = pieces.where((F.col("tokens") > 0) & (F.col("tokens") < capacity))
    longs = lambda *names: [T.StructField(c, T.LongType()) for c in names]
    shape = T.StructType([T.StructField("doc", kind), *longs("row"), T.StructField("piece", T.IntegerType()), *longs("begin", "end", "tokens", "shard", "bin", "filled")])
    shard = F.pmod(F.xxhash64("row", "piece"), F.lit(shards))
    packed = cut(open_pieces.withColumn("shard", shard).groupBy("shard").applyInPandas(_pack(capacity), shape))
    open_bins = packed.where(F.col("filled") <= capacity // 2).select("shard", "bin", "filled").distinct()
    moved = open_bins.groupBy(F.floor(F.col("shard") / SHARDS_A_ROUND)).applyInPandas(_bring_together(capacity), T.StructType(longs("shard", "bin", "to_shard", "to_bin")))
    packed = packed.join(moved, ["shard", "bin"], "left")
    packed = packed.withColumn("container", F.concat_ws("-", F.lit("s"), F.coalesce("to_shard", "shard"), F.coalesce("to_bin", "bin"))).select("doc", "piece", "begin", "end", "tokens", "container")
    whole = pieces.where((F.col("tokens") == 0) | (F.col("tokens") == capacity))
    own = F.when(F.col("tokens") > 0, F.concat_ws("-", F.lit("f"), "row", "piece"))
    return packed.unionByName(whole.withColumn("container", own).drop("row"))
