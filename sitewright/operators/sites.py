"""Guide sites of contigs."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitewright.functions.sequences import seed as seed_of
from sitewright.functions.sequences import split_site
from sitewright.params import SiteParams

_SITES = "site string, accession string, location bigint, strand string, chrom_length bigint, left_arm string, right_arm string"
_COMPLEMENT = bytes.maketrans(b"ACGTMRWSYKVHDBN", b"TGCAKYWSRMBDHVN")
_TILES = "accession string, begin bigint, low bigint, high bigint, chrom_length bigint, seq string"
_CHUNK = 20_000
TILE = 1_000_000


def _cut(letters: np.ndarray, starts: np.ndarray, size: int) -> pa.Array:
    """The stretches of ``size`` letters at ``starts``."""
    block = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(letters, size)[starts])
    offsets = pa.py_buffer(np.arange(0, (len(starts) + 1) * size, size, dtype=np.int32))
    return pa.StringArray.from_buffers(len(starts), offsets, pa.py_buffer(block))


def _arm(letters: np.ndarray, starts: np.ndarray, there: np.ndarray, size: int) -> pa.Array:
    found = _cut(letters, starts[there], size) if there.any() else pa.array([], pa.string())
    places = np.full(len(starts), -1, np.int64)
    places[there] = np.arange(int(there.sum()))
    return found.take(pa.array(places, mask=~there))


def _tiles(params: SiteParams, size: int):
    """Stretches of ``size`` letters and a few more, so that no match of a PAM on either strand lies across their ends.

    Then the matches that do not overlap, counted from one end of the contig, are the same in each stretch alone.
    """
    margin = params.guide_length + 2 * len(params.pam) + params.arm_length + 1
    across = len(params.pam) - 1
    pams = [p.encode() for p in params.pams]
    both = re.compile(b"|".join({*pams, *(p.translate(_COMPLEMENT)[::-1] for p in pams)}))

    def seam(text: bytes, at: int) -> int:
        while 0 < at < len(text) and any(both.match(text, i) for i in range(max(0, at - across), at)):
            at += 1
        return at

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for accession, seq in zip(batch.column("accession"), batch.column("seq"), strict=True):
                text, low = seq.as_py().encode(), 0
                while low < len(text):
                    high = seam(text, min(len(text), low + size))
                    begin = max(0, low - margin)
                    part = text[begin : high + margin]
                    yield pa.RecordBatch.from_arrays([pa.array([accession.as_py()], pa.string()), *(pa.array([x], pa.int64()) for x in (begin, low, high, len(text))), pa.array([part.decode()])], ["accession", "begin", "low", "high", "chrom_length", "seq"])
                    low = high

    return run


def _scan(params: SiteParams, arms: bool):
    glen, plen, arm = params.guide_length, len(params.pam), params.arm_length
    patterns = [re.compile((f"(?={p})" if params.overlap == "all" else p).encode()) for p in params.pams]
    before = glen if params.orientation == "3prime" else 0

    def places(row: dict) -> Iterator[tuple[bytes, np.ndarray, np.ndarray]]:
        """Of each strand of a stretch its letters, and of its sites the places in them and on the contig's strand."""
        top, length = row["seq"].encode(), row["chrom_length"]
        for strand in "+-":
            # the stretch, its own part, and its first letter's place on the strand
            seq, low, high, first = top, row["low"] - row["begin"], row["high"] - row["begin"], row["begin"]
            if strand == "-":
                seq, low, high, first = top.translate(_COMPLEMENT)[::-1], len(top) - high, len(top) - low, length - row["begin"] - len(top)
            reach = min(len(seq), high + plen - 1) if params.overlap == "all" else high
            at = np.fromiter((m.start() for pattern in patterns for m in pattern.finditer(seq, low, reach)), np.int64) - before
            location = at + first
            kept = (location >= 0) & (location < length - glen - plen)
            yield seq, at[kept], location[kept]

    def found(rows: list[dict]) -> Iterator[pa.RecordBatch]:
        parts = [part for row in rows for part in places(row)]
        ends = np.cumsum([len(seq) for seq, _, _ in parts])
        letters = np.frombuffer(b"".join(seq for seq, _, _ in parts), np.uint8)
        at = np.concatenate([at + end - len(seq) for (seq, at, _), end in zip(parts, ends, strict=True)])
        location = np.concatenate([location for _, _, location in parts])
        part = np.repeat(np.arange(len(parts)), [len(at) for _, at, _ in parts])  # two strands a stretch
        accessions, strands = pa.array([row["accession"] for row in rows], pa.string()), pa.array(["+", "-"])
        lengths = np.array([row["chrom_length"] for row in rows], np.int64)
        for k in range(0, len(at), _CHUNK):
            loc, place, strand = at[k : k + _CHUNK], location[k : k + _CHUNK], part[k : k + _CHUNK]
            length = lengths[strand // 2]
            left, right = place - arm > 0, place + glen + plen + arm < length
            both = [_arm(letters, loc - arm, left, arm), _arm(letters, loc + glen + plen, right, arm)] if arms else [pa.nulls(len(loc), pa.string())] * 2
            yield pa.RecordBatch.from_arrays(
                [_cut(letters, loc, glen + plen), accessions.take(pa.array(strand // 2)), pa.array(place), strands.take(pa.array(strand % 2)), pa.array(length), *both],
                ["site", "accession", "location", "strand", "chrom_length", "left_arm", "right_arm"],
            )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, held = [], 0
            for n in range(batch.num_rows):
                rows += batch.slice(n, 1).to_pylist()
                held += len(rows[-1]["seq"])
                if held >= TILE or n + 1 == batch.num_rows:
                    yield from found(rows)
                    rows, held = [], 0

    return run


def site_tiles(contigs: DataFrame, params: SiteParams, size: int = TILE) -> DataFrame:
    """Stretches (accession, begin, low, high, chrom_length, seq) of about ``size`` letters of the contigs (accession,
    seq in capitals), with the letters around them that a site's arms reach.

    A long contig so spreads over as many tasks as it has stretches. This is the one exchange of sequences of a search.
    Null and empty sequences give nothing, a repeated contig gives its stretches again.
    """
    parts = int(contigs.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # the scan costs far more than the bytes tell
    tiles = contigs.where(F.length("seq") > 0).select("accession", "seq").mapInArrow(_tiles(params, size), _TILES)
    return tiles.repartition(parts, "accession", "begin")


def sites_of(tiles: DataFrame, params: SiteParams, arms: bool = True) -> DataFrame:
    """The sites of ``site_tiles``, as ``find_sites`` has them; without ``arms`` these are null."""
    found = tiles.mapInArrow(_scan(params, arms), _SITES)
    guide, pam = split_site(F.col("site"), params.guide_length, len(params.pam), params.orientation)
    return found.select("site", guide.alias("guide"), pam.alias("pam"), "accession", "location", "strand", "chrom_length", "left_arm", "right_arm")


def find_sites(contigs: DataFrame, params: SiteParams, size: int = TILE) -> DataFrame:
    """Every guide beside a PAM on both strands, with the arms around it.

    ``contigs`` has columns accession and seq (capitals). Matches of one concrete PAM do not overlap, unless
    ``params.overlap`` is ``all``. ``location`` counts from 0 on the site's own strand; a site flush with the end of its
    contig is left out, and so are arms that would reach beyond it (null). Null and empty sequences give nothing, a
    repeated contig gives its sites again. Columns: site, guide, pam, accession, location, strand, chrom_length,
    left_arm, right_arm.
    """
    params.check()
    return sites_of(site_tiles(contigs, params, size), params)


def guide_library(sites: DataFrame) -> DataFrame:
    """The distinct guides (guide, frequency) over all contigs and both strands, ambiguous letters left out."""
    return sites.where(~F.col("guide").rlike("[^ACGT]")).groupBy("guide").agg(F.count("*").alias("frequency"))


def unique_guides(library: DataFrame, params: SiteParams) -> DataFrame:
    """Guides that occur once and whose seed no other guide of the library has (a seed length of 0: any seed)."""
    once = library.where(F.col("frequency") == 1).select("guide")
    if not params.seed_length:
        return once
    key = seed_of(F.col("guide"), params.seed_length, params.guide_length, params.orientation)
    seeds = library.groupBy(key.alias("seed")).agg(F.count("*").alias("guides"), F.max("guide").alias("guide"), F.max("frequency").alias("frequency"))
    return seeds.where((F.col("guides") == 1) & (F.col("frequency") == 1)).select("guide")
