"""Column functions that bring guides to one written form and pack them into integers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

GUIDE_LETTERS = 20
PAM_LETTERS = 3


def usable_guide(value: Column) -> Column:
    """The guide in capitals, or null where the value is not a usable guide.

    Blanks and letter case are set aside, U is read as T, and the PAM is dropped where 23 letters ending in GG are given.
    """
    plain = F.translate(F.upper(F.regexp_replace(value, r"[\s ]+", "")), "U", "T")
    with_pam = (F.length(plain) == GUIDE_LETTERS + PAM_LETTERS) & plain.endswith("GG")
    guide = F.when(with_pam, F.substring(plain, 1, GUIDE_LETTERS)).otherwise(plain)
    return F.when(guide.rlike(f"^[ACGT]{{{GUIDE_LETTERS}}}$"), guide)


def pack(guide: Column) -> Column:
    """A guide of at most 31 letters A, C, G, T as a bigint, two bits a letter, the first letter in the highest bits."""
    return F.conv(F.translate(guide, "ACGT", "0123"), 4, 10).cast("bigint")


def unpack(code: Column, letters: int = GUIDE_LETTERS) -> Column:
    """The guide that ``pack`` made ``code`` of."""
    return F.translate(F.lpad(F.conv(code.cast("string"), 10, 4), letters, "0"), "0123", "ACGT")


def packed_hamming(left: Column, right: Column) -> Column:
    """Differing letters of two packed guides."""
    xor = left.bitwiseXOR(right)
    odd = F.lit(0x5555555555555555)
    return F.bit_count(xor.bitwiseOR(F.shiftright(xor, 1)).bitwiseAND(odd))
