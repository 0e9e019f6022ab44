"""Evaluation passages that stand in training documents, by pigeonhole pieces and bit-parallel edit distance."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sitewright.plans.stage import cut

#: Bits of the filter of pieces that goes to the tasks; fixed, so it doesn't grow with the items. More of them let more
#: places through to the join, which decides.
FILTER_BITS = 1 << 24
TEXTS_AT_ONCE = 100

_WORD = re.compile(r"[^\W_]+")
_KEYED = re.compile(r"\\(?:cite[a-z]*|ref|eqref|label)\*?(?:\[[^\]]*\])*\{[^{}]*\}")  # their argument is a key, not text
_COMMAND = re.compile(r"\\(?:[A-Za-z@]+\*?|-)")
_TO_BLANK = {c: " " for c in range(128) if not chr(c).isalnum()}


def _command(m: re.Match) -> str:
    return "" if m.group(0) == r"\-" else " "


def words_of(text: str) -> list[str]:
    """The words of a LaTeX source: runs of letters and digits in lower case, without markup commands and keys."""
    if "\\" in text:
        text = _COMMAND.sub(_command, _KEYED.sub(" ", text))
    text = text.lower()
    return text.translate(_TO_BLANK).split() if text.isascii() else _WORD.findall(text)


def edit_distance_within(pattern: Sequence[str], text: Sequence[str]) -> int:
    """The least number of word edits that turn ``pattern`` into some stretch of ``text`` (Myers' bit vectors)."""
    m = len(pattern)
    if not m:
        return 0
    peq: dict[str, int] = {}
    for i, w in enumerate(pattern):
        peq[w] = peq.get(w, 0) | 1 << i
    full, top = (1 << m) - 1, 1 << (m - 1)
    plus, minus, score, best = full, 0, m, m
    for w in text:
        eq = peq.get(w, 0)
        vertical = eq | minus
        diagonal = (((eq & plus) + plus) ^ plus) | eq
        up = minus | ~(diagonal | plus) & full
        down = plus & diagonal
        score += 1 if up & top else -1 if down & top else 0
        up = up << 1 & full  # a match may begin anywhere in the text
        down = down << 1 & full
        plus = down | ~(vertical | up) & full
        minus = up & vertical
        best = min(best, score)
    return best


def piece_words(min_words: int, max_edits: int) -> int:
    """Every window of ``min_words`` words of an item holds ``max_edits`` + 1 pieces of so many words whole."""
    return (min_words + 1) // (max_edits + 2)


def _piece_hashes(texts: Sequence[Sequence[str]], size: int) -> list[np.ndarray]:
    """For each list of words a hash of every run of ``size`` words, by its first word."""
    coded = pa.array([w for words in texts for w in words], pa.string()).dictionary_encode()
    own = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in coded.dictionary.to_pylist()), np.uint64, len(coded.dictionary))
    one = own[coded.indices.to_numpy()]
    out = np.zeros(max(0, len(one) - size + 1), np.uint64)
    for i in range(size):
        out = (out ^ one[i : i + len(out)]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    ends = np.cumsum([len(words) for words in texts])
    return [out.view(np.int64)[end - len(words) : max(end - len(words), end - size + 1)] for words, end in zip(texts, ends, strict=True)]


def _cut_items(min_words: int, size: int):
    """The pieces (hash, at) of each test item that is long enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes, at, number = [], [], []
            for n, passage in zip(batch.column("number").to_pylist(), batch.column("passage"), strict=True):
                words = words_of(passage.as_py())
                if len(words) >= min_words:
                    found = _piece_hashes([words], size)[0][::size]
                    hashes.append(found)
                    at += range(0, len(found) * size, size)
                    number += [n] * len(found)
            yield pa.RecordBatch.from_pydict({"number": pa.array(number, pa.int64()), "at": pa.array(at, pa.int32()), "hash": pa.array(np.concatenate(hashes) if hashes else np.empty(0, np.int64))})

    return run


def _scan(bits: np.ndarray, size: int):
    """The documents with pieces that the filter knows, and where."""
    top = np.int64(len(bits) * 8 - 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, hashes, places = [], [], []
            some = (batch.column("text").slice(k, TEXTS_AT_ONCE) for k in range(0, batch.num_rows, TEXTS_AT_ONCE))
            every = (found for texts in some for found in _piece_hashes([words_of(t.as_py()) for t in texts], size))
            for n, found in enumerate(every):
                at = found & top
                known = np.flatnonzero(bits[at >> 3] >> (at & 7) & 1)
                if len(known):
                    rows.append(n)
                    hashes.append(found[known])
                    places.append(known.astype(np.int32))
            some = batch.take(pa.array(rows, pa.int64()))
            lists = [pa.array(x, pa.list_(t)) for x, t in ((hashes, pa.int64()), (places, pa.int32()))]
            yield pa.RecordBatch.from_arrays([some.column("doc"), some.column("text"), *lists], ["doc", "text", "hashes", "places"])

    return run


def _run_around(item: list[str], words: list[str], at: int, place: int, size: int) -> tuple[int, int]:
    """Begin and length of the run of unchanged words around a hit."""
    left, right = 0, size
    while at - left > 0 and place - left > 0 and item[at - left - 1] == words[place - left - 1]:
        left += 1
    while at + right < len(item) and place + right < len(words) and item[at + right] == words[place + right]:
        right += 1
    return place - left, left + right


def verified(item: list[str], words: list[str], spots: Sequence[tuple[int, int]], size: int, min_words: int, max_edits: int) -> tuple[int, int, int] | None:
    """(fewest edits of a window, longest run of unchanged words beside it, word at which that begins), or None where no
    window of the item is within ``max_edits``. ``spots``: (place in the words, place in the item) of equal pieces."""
    best: tuple[int, int, int] | None = None
    tried: dict[tuple[int, int], int] = {}
    for place, at in sorted(spots):
        edits = min_words
        for begin in range(max(0, at + size - min_words), min(at, len(item) - min_words) + 1):
            low = max(0, place - (at - begin) - max_edits)
            if (begin, low) not in tried:
                tried[begin, low] = edit_distance_within(item[begin : begin + min_words], words[low : low + min_words + 2 * max_edits])
            edits = min(edits, tried[begin, low])
            if not edits:
                break
        if edits <= max_edits:
            first, run = _run_around(item, words, at, place, size)
            found = (edits, run, first)
            if best is None or (edits, -run, first) < (best[0], -best[1], best[2]):
                best = found
    return best


def _verify(size: int, min_words: int, max_edits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, found = [], []
            known: tuple[str, list[str]] = ("", [])
            for n, (text, passage, spots) in enumerate(zip(*(batch.column(c) for c in ("text", "passage", "spots")), strict=True)):
                if (t := text.as_py()) != known[0]:
                    known = (t, words_of(t))
                hit = verified(words_of(passage.as_py()), known[1], [(s["place"], s["at"]) for s in spots.as_py()], size, min_words, max_edits)
                if hit:
                    rows.append(n)
                    found.append(hit)
            some = batch.take(pa.array(rows, pa.int64()))
            numbers = [pa.array([f[i] for f in found], pa.int32()) for i in range(3)]
            yield pa.RecordBatch.from_arrays([some.column("doc"), some.column("item"), *numbers], ["doc", "item", "edits", "run_words", "at_word"])

    return run


def _bits_of(pieces: DataFrame) -> np.ndarray:
    """The filter with a bit for each piece, put together from one partial filter a partition."""
    top = np.int64(FILTER_BITS - 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = [np.unique(batch.column("hash").to_numpy() & top) for batch in batches]
        words = np.unique(np.concatenate(at)) if at else np.empty(0, np.int64)
        byte, first = np.unique(words >> 3, return_index=True)
        values = np.bitwise_or.reduceat(1 << (words & 7), first) if len(words) else words
        yield pa.RecordBatch.from_pydict({"byte": pa.array(byte), "value": pa.array(values)})

    set_bytes = pieces.select("hash").mapInArrow(run, "byte bigint, value bigint").groupBy("byte").agg(F.bit_or("value").alias("value"))
    bits = np.zeros(FILTER_BITS // 8, np.uint8)
    for part in set_bytes.toLocalIterator():  # as many rows as the filter has bytes, at most
        bits[part.byte] = part.value
    return bits


def find_leaks(docs: DataFrame, doc: str, text: str, items: DataFrame, item: str, passage: str, min_words: int = 12, max_edits: int = 1) -> DataFrame:
    """Rows (doc, item, edits, run_words, at_word): the documents that hold ``min_words`` consecutive words of an item's
    passage with at most ``max_edits`` words changed, added or left out.

    ``edits`` is the least number for any such stretch, ``run_words`` the longest run of unchanged words around a hit of
    the best stretch, beginning at word ``at_word`` of the document. Documents and passages that are null or too short
    give nothing, null ids stay null; repeated rows are reported again; ties go to the first place; empty tables give an
    empty result; other columns are ignored, whatever their names.

    The corpus is read once, however many items there are: a task hashes every run of ``piece_words`` words and keeps the
    documents where a filter of fixed size knows one. Only these are shuffled: their hits are joined with the items'
    pieces by hash, and each document with each item that it hits is verified by Myers' distance.
    """
    if max_edits < 0 or min_words < max_edits + 1:
        raise ValueError("min_words must be above max_edits, and max_edits not negative")
    size = piece_words(min_words, max_edits)
    tests = items.where(F.col(passage).isNotNull()).select(F.col(item).alias("item"), F.col(passage).alias("passage"))
    tests = cut(tests.withColumn("number", F.monotonically_increasing_id()))
    pieces = cut(tests.mapInArrow(_cut_items(min_words, size), "number bigint, at int, hash bigint"))
    kind = T.StructField("doc", docs.schema[doc].dataType)
    longs = [T.StructField("hashes", T.ArrayType(T.LongType())), T.StructField("places", T.ArrayType(T.IntegerType()))]
    texts = docs.where(F.col(text).isNotNull()).select(F.col(doc).alias("doc"), F.col(text).alias("text"))
    hit = texts.mapInArrow(_scan(_bits_of(pieces), size), T.StructType([kind, T.StructField("text", T.StringType()), *longs]))
    hit = cut(hit.withColumn("row", F.monotonically_increasing_id()))
    places = hit.select("row", F.inline(F.arrays_zip("hashes", "places"))).toDF("row", "hash", "place")
    spots = places.join(pieces, "hash").groupBy("row", "number").agg(F.collect_list(F.struct("place", "at")).alias("spots"))  # of one document and one item
    pairs = hit.select("row", "doc", "text").join(spots, "row").join(tests, "number").select("doc", "text", "item", "passage", "spots")
    found = T.StructType([kind, T.StructField("item", items.schema[item].dataType), *(T.StructField(c, T.IntegerType()) for c in ("edits", "run_words", "at_word"))])
    return pairs.mapInArrow(_verify(size, min_words, max_edits), found)
