"""Column functions over sequences."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from sitewright.params import AMBIGUOUS

# fixed values: complements of the nucleotide codes, and the letter that stands in for an ambiguous one
_CODES, _COMPLEMENTS = "ACGTMRWSYKVHDBN", "TGCAKYWSRMBDHVN"
_AMBIGUOUS, _STAND_INS = "MRWSYKVHDBN", "AAACCGAAACA"
STEM = 4


def letters(seq: Column) -> Column:
    """The letters of a delivered sequence in capitals, without layout, digits and blanks."""
    return F.upper(F.regexp_replace(seq, "[^A-Za-z]+", ""))


def reverse_complement(seq: Column) -> Column:
    return F.translate(F.reverse(seq), _CODES, _COMPLEMENTS)


def gc_percent(seq: Column) -> Column:
    """Share of G, C and S in percent; null for an empty sequence."""
    return F.when(F.length(seq) > 0, 100.0 * F.length(F.regexp_replace(seq, "[^GCSgcs]", "")) / F.length(seq))


def count_letter(seq: Column, what: str) -> Column:
    """Occurrences of ``what``, not overlapping."""
    return ((F.length(seq) - F.length(F.replace(seq, F.lit(what), F.lit("")))) / len(what)).cast("int")


def kmers(seq: Column, k: int) -> Column:
    """All windows of ``k`` letters in order; an empty array where the sequence is shorter."""
    windows = F.transform(F.sequence(F.lit(1), F.length(seq) - (k - 1)), lambda i: F.substr(seq, i, F.lit(k)))
    return F.when(F.length(seq) >= k, windows).otherwise(F.array().cast("array<string>"))


def plain_letters(seq: Column) -> Column:
    """The sequence with a fixed plain letter for each ambiguous one."""
    return F.translate(seq, _AMBIGUOUS, _STAND_INS)


def is_ambiguous(seq: Column) -> Column:
    return seq.rlike(f"[{AMBIGUOUS}]")


def contains_any(seq: Column, motifs: Sequence[str]) -> Column:
    """Whether one of the plain motifs occurs; false for no motifs."""
    return seq.rlike("|".join(motifs)) if motifs else F.lit(False)


def has_run(seq: Column, letter: str, size: int) -> Column:
    return seq.contains(letter * size)


def split_site(site: Column, guide_length: int, pam_length: int, orientation: str) -> tuple[Column, Column]:
    """Guide and PAM of a site's letters."""
    if orientation == "3prime":
        return F.substr(site, F.lit(1), F.lit(guide_length)), F.substr(site, F.lit(guide_length + 1), F.lit(pam_length))
    return F.substr(site, F.lit(pam_length + 1), F.lit(guide_length)), F.substr(site, F.lit(1), F.lit(pam_length))


def seed(guide: Column, size: int, guide_length: int, orientation: str) -> Column:
    """The letters of the guide next to the PAM."""
    return F.substr(guide, F.lit(guide_length - size + 1 if orientation == "3prime" else 1), F.lit(size))


def self_complementarity(guide: Column, guide_length: int, gc_scale: str = "reference") -> Column:
    """Stems of four letters that also occur in the reverse complement far enough before their partner.

    With the ``reference`` scale a stem needs one G or C, with ``fraction`` half of its letters. The last window is
    left out.
    """
    rc = reverse_complement(guide)
    least = 1 if gc_scale == "reference" else STEM // 2

    def counts(j: Column) -> Column:
        stem = F.substr(guide, j + 1, F.lit(STEM))
        strong = F.length(F.regexp_replace(stem, "[^GCS]", "")) >= least
        return strong & (F.instr(F.substr(rc, F.lit(1), F.lit(guide_length - STEM - 1) - j), stem) > 0)

    return F.size(F.filter(F.sequence(F.lit(0), F.lit(guide_length - STEM - 1)), counts))


def context_window(left: Column, guide: Column, pam: Column, right: Column, guide_length: int, size: int = 24, after: int = 3) -> Column:
    """The letters a scorer looks at: ``size`` before the PAM, taken from the left arm where the guide is shorter."""
    if guide_length < size:
        before = F.concat(F.right(left, F.lit(size - guide_length)), guide)
    else:
        before = F.right(guide, F.lit(size))
    return F.concat(before, pam, F.left(right, F.lit(after)))


def context_window_5prime(left: Column, guide: Column, pam: Column, right: Column, guide_length: int, size: int = 27) -> Column:
    """The letters a scorer of 5' PAM sites looks at: one before the PAM, the PAM, and ``size`` after it."""
    after = F.concat(guide, F.left(right, F.lit(size - guide_length))) if guide_length < size else F.left(guide, F.lit(size))
    return F.concat(F.right(left, F.lit(1)), pam, after)


def reported_location(location: Column, strand: Column, chrom_length: Column, guide_length: int, pam_length: int) -> Column:
    """The place on the top strand."""
    return F.when(strand == "+", location).otherwise(chrom_length - location - guide_length - pam_length)


def compared_location(location: Column, strand: Column, chrom_length: Column) -> Column:
    """The coordinate that is compared with genes."""
    return F.when(strand == "+", location).otherwise(chrom_length - location)


def relative_orientation(left: Column, right: Column) -> Column:
    same = F.when(left == right, "tandem").when((left == "+") & (right == "-"), "convergent").otherwise("divergent")
    return F.when(left.isNotNull() & right.isNotNull(), same)
