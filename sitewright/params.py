"""Search parameters: ambiguity codes, motif lists and checks."""

from __future__ import annotations

from dataclasses import dataclass

# fixed values: the nucleotide ambiguity codes and what they stand for
IUPAC = {
    "A": "A", "C": "C", "G": "G", "T": "T", "M": "AC", "R": "AG", "W": "AT", "S": "CG", "Y": "CT", "K": "GT",
    "V": "ACG", "H": "ACT", "D": "AGT", "B": "CGT", "N": "ACGT",
}
AMBIGUOUS = "".join(code for code, bases in IUPAC.items() if len(bases) > 1)


def expand(motif: str) -> list[str]:
    """All concrete sequences of an ambiguous motif; letters further right vary slowest."""
    found = [""]
    for code in motif.upper():
        if code not in IUPAC:
            raise ValueError(f"{code!r} is no nucleotide code")
        found = [prefix + base for base in IUPAC[code] for prefix in found]
    return found


def motif_list(text: str) -> list[str]:
    """The concrete motifs of a comma-separated list without blanks; an empty entry switches the whole list off."""
    motifs = text.replace(" ", "").split(",")
    return [] if "" in motifs else [m for motif in motifs for m in expand(motif)]


@dataclass(frozen=True)
class SiteParams:
    """Parameters of a site search; ``check`` raises ValueError for those that contradict each other."""

    pam: str = "NGG"
    orientation: str = "3prime"
    guide_length: int = 20
    seed_length: int = 10
    re_guide: str = ""
    gc_range: tuple[int, int] = (0, 100)
    poly_g_guide: int = 0
    poly_t_guide: int = 0
    intergenic_space: int = 300
    edit_distance: int = 6
    distance: str = "hamming"
    density_length: int = 10000
    arm_length: int = 50
    re_arm: str = ""
    poly_g_arm: int = 0
    poly_t_arm: int = 0
    backbone: str = ""
    distal_end: int = 5000
    gc_scale: str = "reference"
    overlap: str = "reference"

    def check(self) -> SiteParams:
        if self.orientation not in ("3prime", "5prime"):
            raise ValueError("orientation must be 3prime or 5prime")
        if not 10 <= self.guide_length <= 40:
            raise ValueError("guide_length must be 10 to 40")
        if self.seed_length >= self.guide_length:
            raise ValueError("seed_length must be below guide_length")
        if self.gc_range[0] < 0 or self.gc_range[1] > 100:
            raise ValueError("gc_range must be within 0 and 100")
        if self.distance not in ("hamming", "levenshtein"):
            raise ValueError("distance must be hamming or levenshtein")
        if self.pam == "NGG" and self.orientation == "3prime" and self.distal_end < self.arm_length:
            raise ValueError("distal_end must be at least arm_length")
        expand(self.pam)
        return self

    @property
    def pams(self) -> list[str]:
        return expand(self.pam)
