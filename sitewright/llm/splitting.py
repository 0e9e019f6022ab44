"""Items over a size limit cut into pieces at natural boundaries, by dynamic programming over boundary positions."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_NO_LETTERS = bytes(b for b in range(256) if not chr(b).isalpha() or b > 127)
_INSIDE = 1e6  # penalty of a cut that is not at a boundary, more than all size imbalance of an item can add up to


def boundaries(letters: bytes, gap_letter: bytes, min_gap: int) -> list[tuple[int, int]]:
    """The runs of at least ``min_gap`` gap letters, as half-open ranges."""
    return [m.span() for m in re.finditer(re.escape(gap_letter) + b"{%d,}" % min_gap, letters)]


def fits_between(size: int, gaps: list[tuple[int, int]], limit: int) -> bool:
    """Whether no stretch between gaps or ends is longer than ``limit``."""
    edges = [0, *(x for gap in gaps for x in gap), size]
    return all(end - begin <= limit for begin, end in zip(edges[::2], edges[1::2], strict=True))


def best_cuts(size: int, gaps: list[tuple[int, int]], limit: int, grid: int, overlap: int = 0) -> list[tuple[int, bool]]:
    """The cuts (position, at a gap) that split ``size`` letters, each piece with the ``overlap`` letters before it, into
    pieces of at most ``limit`` at the least cost.

    The cost is the number of cuts outside gaps first, then the squared deviations of the pieces from even sizes. Cuts
    may be at both ends of a gap and on a grid of ``grid`` letters, inside gaps or not.
    """
    if size <= limit:
        return []
    at = np.unique(np.concatenate([np.arange(0, size, grid), np.asarray(gaps, np.int64).reshape(-1), [size]]))
    begins = np.asarray([g[0] for g in gaps], np.int64)
    ends = np.asarray([g[1] for g in gaps], np.int64)
    k = np.searchsorted(begins, at, side="right") - 1
    free = (k >= 0) & (at <= ends[k]) if len(gaps) else np.zeros(len(at), bool)
    free[-1] = True
    even = size / (1 - (limit - size) // (limit - overlap))
    penalty = np.where(free, 0.0, _INSIDE)
    cost, came = np.zeros(len(at)), np.zeros(len(at), np.int64)
    low = np.searchsorted(np.maximum(at - overlap, 0), at - limit)  # a piece takes the overlap along
    for i in range(1, len(at)):
        before = slice(low[i], i)
        total = cost[before] + ((at[i] - at[before] - even) / limit) ** 2
        best = int(total.argmin())
        came[i], cost[i] = low[i] + best, total[best] + penalty[i]
    cuts, i = [], came[-1]
    while i:
        cuts.append((int(at[i]), bool(free[i])))
        i = came[i]
    return cuts[::-1]


def _pieces(limit: int, overlap: int, gap_letter: str, min_gap: int, grid: int, with_text: bool):
    gap = gap_letter.upper().encode()
    names = ("item", "letters", "cut_kind", "piece", "begin", "end", "repeated", "at_gap", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kinds = (batch.column("item").type, pa.int64(), pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.bool_(), pa.string())
            for item, text in zip(batch.column("item"), batch.column("text"), strict=True):
                letters = text.as_py().encode().translate(None, _NO_LETTERS).upper()
                if len(letters) <= limit:
                    continue
                gaps = boundaries(letters, gap, min_gap)
                cuts = best_cuts(len(letters), gaps, limit, grid, overlap)
                kind = "gap" if fits_between(len(letters), gaps, limit) else "inside"
                edges = [0, *(p for p, _ in cuts), len(letters)]
                rows = []
                for n, (a, b) in enumerate(zip(edges, edges[1:], strict=False)):
                    begin = max(0, a - overlap)
                    rows.append((item.as_py(), len(letters), kind, n, begin, b, a - begin, (n == 0 or cuts[n - 1][1]), letters[begin:b].decode() if with_text else None))
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    return run


def split_oversized(df: DataFrame, item: str, text: str, limit: int, overlap: int = 0, gap_letter: str = "N", min_gap: int = 10, grid: int = 50, with_text: bool = True) -> DataFrame:
    """The pieces of every row whose ``text`` has more than ``limit`` letters (A-Z in either case; nothing else counts).

    A piece has at most ``limit`` letters, with the ``overlap`` letters before its own that it repeats, fewer only where
    the item has no more. Cuts lie at runs of ``min_gap`` gap letters where these allow it. Columns: item, letters,
    cut_kind (``gap`` if no stretch between gaps is longer than ``limit``, else ``inside``), piece, begin, end (of the
    upper-case letters, with the repeated ones), repeated, at_gap (whether the piece's own letters begin at a gap or the
    item's start; a stretch that fits only without the overlap is cut inside), text (null unless ``with_text``).

    Rows with null, empty or short texts give nothing; repeated rows are cut again; null items stay null; other columns
    are dropped, whatever their names.
    """
    if overlap < 0 or grid < 1 or overlap + grid > limit:
        raise ValueError("grid must be positive, overlap not negative, and both together at most limit")
    kind = df.schema[item].dataType
    schema = T.StructType(
        [
            T.StructField("item", kind), T.StructField("letters", T.LongType()), T.StructField("cut_kind", T.StringType()), T.StructField("piece", T.IntegerType()), T.StructField("begin", T.LongType()),
            T.StructField("end", T.LongType()), T.StructField("repeated", T.IntegerType()), T.StructField("at_gap", T.BooleanType()), T.StructField("text", T.StringType()),
        ]
    )
    long = df.where(F.octet_length(text) > limit).select(F.col(item).alias("item"), F.col(text).alias("text"))
    return long.mapInArrow(_pieces(limit, overlap, gap_letter, min_gap, grid, with_text), schema)
