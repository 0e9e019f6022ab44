"""Scores and model features of context windows, as column expressions."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitewright.functions.sequences import count_letter, gc_percent, kmers

# fixed values: the published weights of the sigmoid rule set, by letters and 1-based position of the 30-letter window
RULE_INTERCEPT = 0.59763615
RULE_LOW_GC, RULE_HIGH_GC = -0.2026259, -0.1665878
RULE_SINGLE = {
    "G02": -0.2753771, "A03": -0.3238875, "C03": 0.17212887, "C04": -0.1006662, "C05": -0.2018029, "G05": 0.24595663,
    "A06": 0.03644004, "C06": 0.09837684, "C07": -0.7411813, "G07": -0.3932644, "A12": -0.466099, "A15": 0.08537695,
    "C15": -0.013814, "A16": 0.27262051, "C16": 0.1190226, "T16": -0.2859442, "A17": 0.09745459, "G17": -0.1755462,
    "C18": -0.3457955, "G18": -0.6780964, "A19": 0.22508903, "C19": -0.5077941, "G20": -0.4173736, "T20": -0.054307,
    "G21": 0.37989937, "T21": -0.0907126, "C22": 0.05782332, "T22": -0.5305673, "T23": -0.8770074, "C24": -0.8762358,
    "G24": 0.27891626, "T24": -0.4031022, "A25": -0.0773007, "C25": 0.28793562, "T25": -0.2216372, "G28": -0.6890167,
    "T28": 0.11787758, "C29": -0.1604453, "G30": 0.38634258,
}
RULE_PAIR = {
    "GT02": -0.6257787, "GC05": 0.30004332, "AA06": -0.8348362, "TA06": 0.76062777, "GG07": -0.4908167, "GG12": -1.5169074,
    "TA12": 0.7092612, "TC12": 0.49629861, "TT12": -0.5868739, "GG13": -0.3345637, "GA14": 0.76384993, "GC14": -0.5370252,
    "TG17": -0.7981461, "GG19": -0.6668087, "TC19": 0.35318325, "CC20": 0.74807209, "TG20": -0.3672668, "AC21": 0.56820913,
    "CG21": 0.32907207, "GA21": -0.8364568, "GG21": -0.7822076, "TC22": -1.029693, "CG23": 0.85619782, "CT23": -0.4632077,
    "AA24": -0.5794924, "AG24": 0.64907554, "AG25": -0.0773007, "CG25": 0.28793562, "TG25": -0.2216372, "GT27": 0.11787758,
    "GG29": -0.69774,
}

# fixed values: nearest-neighbour enthalpies and entropies of DNA (Allawi and SantaLucia 1997) and RNA (Xia et al. 1998)
DNA_PAIRS = {
    "init": (0, 0), "init_A/T": (2.3, 4.1), "init_G/C": (0.1, -2.8), "sym": (0, -1.4), "AA": (-7.9, -22.2), "AT": (-7.2, -20.4),
    "TA": (-7.2, -21.3), "CA": (-8.5, -22.7), "GT": (-8.4, -22.4), "CT": (-7.8, -21.0), "GA": (-8.2, -22.2), "CG": (-10.6, -27.2),
    "GC": (-9.8, -24.4), "GG": (-8.0, -19.9),
}
RNA_PAIRS = {
    "init": (3.61, -1.5), "init_A/T": (3.72, 10.5), "init_G/C": (0, 0), "sym": (0, -1.4), "AA": (-6.82, -19.0), "AT": (-9.38, -26.7),
    "TA": (-7.69, -20.5), "CA": (-10.44, -26.9), "GT": (-11.40, -29.5), "CT": (-10.48, -27.1), "GA": (-12.44, -32.5), "CG": (-10.64, -26.7),
    "GC": (-14.88, -36.9), "GG": (-13.39, -32.7),
}
GAS_CONSTANT, KELVIN = 1.987, 273.15
STRAND_NM, OTHER_STRAND_NM, SODIUM_MM = 25.0, 25.0, 50.0

WINDOW = 30
GUIDE_AT, GUIDE_SIZE = 4, 20
SINGLES = ("A", "T", "C", "G")
PAIRS = tuple("".join(p) for p in product(SINGLES, repeat=2))
BESIDE = tuple("".join(p) for p in product("ACGT", repeat=2))


def rule_score(window: Column, gc: str = "reference") -> Column:
    """The rule-set score of a 30-letter window, between 0 and 1; null for other lengths.

    The ``reference`` flavour always takes the low-GC term, ``guide`` looks at the letters 6 to 25.
    """
    total = F.lit(RULE_INTERCEPT)
    if gc == "reference":
        total = total + F.lit(RULE_LOW_GC)
    else:
        strong = F.length(F.regexp_replace(F.substr(window, F.lit(6), F.lit(20)), "[^GC]", ""))
        total = total + F.when(strong < 10, RULE_LOW_GC).otherwise(RULE_HIGH_GC)
    for table in (RULE_SINGLE, RULE_PAIR):
        for key, weight in table.items():
            letters, at = key[:-2], int(key[-2:])
            total = total + F.when(F.substr(window, F.lit(at), F.lit(len(letters))) == letters, weight).otherwise(0.0)
    return F.when(F.length(window) == WINDOW, 1 / (1 + F.exp(-total)))


def _one_hot(values: Column, kinds: tuple[str, ...]) -> Column:
    return F.flatten(F.transform(values, lambda v: F.array(*(F.when(v == k, 1.0).otherwise(0.0) for k in kinds))))


def _counts(values: Column, kinds: tuple[str, ...]) -> Column:
    def count(kind: str) -> Column:
        return F.size(F.filter(values, lambda v: v == kind)).cast("double")

    return F.array(*(count(k) for k in kinds))


def single_positions(seq: Column) -> Column:
    return _one_hot(kmers(seq, 1), SINGLES)


def single_counts(seq: Column) -> Column:
    return F.array(*(count_letter(seq, k).cast("double") for k in SINGLES))


def pair_positions(seq: Column) -> Column:
    return _one_hot(kmers(seq, 2), PAIRS)


def pair_counts(seq: Column) -> Column:
    return _counts(kmers(seq, 2), PAIRS)


def guide_gc(window: Column) -> Column:
    """G and C (all but A and T) of the guide inside a 30-letter window."""
    return F.length(F.translate(F.substr(window, F.lit(GUIDE_AT + 1), F.lit(GUIDE_SIZE)), "AT", ""))


def beside_pam(window: Column) -> Column:
    """One-hot of the letters before and after the GG of the PAM."""
    pair = F.concat(F.substr(window, F.lit(25), F.lit(1)), F.substr(window, F.lit(28), F.lit(1)))
    return F.array(*(F.when(pair == k, 1.0).otherwise(0.0) for k in BESIDE))


def melting_temperature(seq: Column, size: int, table: dict[str, tuple[float, float]] = DNA_PAIRS) -> Column:
    """Nearest-neighbour melting temperature in degrees of a sequence of ``size`` letters A, C, G, T and its complement,
    at 25 nM of each strand and 50 mM sodium, the entropy corrected for salt."""
    complement = {"A": "T", "T": "A", "C": "G", "G": "C"}
    values = {}
    for a, b in product("ACGT", repeat=2):
        values[a + b] = table.get(a + b) or table[complement[b] + complement[a]]
    found = kmers(seq, 2)

    def total(which: int) -> Column:
        amounts = F.create_map(*(F.lit(x) for k, v in values.items() for x in (k, float(v[which]))))
        pairs = F.aggregate(found, F.lit(0.0), lambda acc, p: acc + F.element_at(amounts, p))
        ends = F.concat(F.left(seq, F.lit(1)), F.right(seq, F.lit(1)))
        weak = F.length(F.regexp_replace(ends, "[^AT]", ""))
        own = F.when(seq == F.translate(F.reverse(seq), "ACGT", "TGCA"), float(table["sym"][which])).otherwise(0.0)
        return pairs + table["init"][which] + weak * float(table["init_A/T"][which]) + (2 - weak) * float(table["init_G/C"][which]) + own

    palindrome = seq == F.translate(F.reverse(seq), "ACGT", "TGCA")
    strands = F.when(palindrome, STRAND_NM * 1e-9).otherwise((STRAND_NM - OTHER_STRAND_NM / 2) * 1e-9)
    entropy = total(1) + 0.368 * (size - 1) * F.log(F.lit(SODIUM_MM * 1e-3))
    plain = F.length(seq) == size
    return F.when(plain & ~seq.rlike("[^ACGT]"), 1000 * total(0) / (entropy + GAS_CONSTANT * F.log(strands)) - KELVIN)


def melting_features(window: Column) -> Column:
    """Temperatures of the whole window and of three parts of the guide, with the RNA table."""
    parts = [(0, 30), (19, 24), (11, 19), (6, 11)]
    return F.array(*(melting_temperature(F.substr(window, F.lit(a + 1), F.lit(b - a)), b - a, RNA_PAIRS) for a, b in parts))


def window_features(window: Column, options: dict | None = None) -> Column:
    """The 627 features of a 30-letter window: letters and pairs by place and number, GC above and below ten and its
    count, the letters beside the PAM, and temperatures. Null for other lengths or without the GG of the PAM. Of the
    ``options``, nuc_features, gc_features, include_NGGX_interaction and include_Tm switch groups off, order 1 the pairs.
    """
    options = options or {}
    gc = guide_gc(window)
    parts = []
    if options.get("nuc_features", True):
        parts += [single_positions(window), single_counts(window)]
        parts += [pair_positions(window), pair_counts(window)] if options.get("order", 2) > 1 else []
    if options.get("gc_features", True):
        parts.append(F.array((gc > 10).cast("double"), (gc < 10).cast("double"), gc.cast("double")))
    parts += [beside_pam(window)] if options.get("include_NGGX_interaction", True) else []
    parts += [melting_features(window)] if options.get("include_Tm", True) else []
    features = F.concat(*parts)
    return F.when((F.length(window) == WINDOW) & (F.substr(window, F.lit(26), F.lit(2)) == "GG"), features)


def bacterial_features(window: Column) -> Column:
    """Features of the guide inside a 30-letter window: letters and pairs by place and number, the letters beside the
    PAM, temperatures of the guide and three parts with the DNA table, and its share of GC."""
    guide = F.substr(window, F.lit(GUIDE_AT + 1), F.lit(GUIDE_SIZE))
    parts = [(0, 20), (0, 7), (7, 15), (15, 20)]
    heat = F.array(*(melting_temperature(F.substr(guide, F.lit(a + 1), F.lit(b - a)), b - a) for a, b in parts))
    return F.when(F.length(window) == WINDOW, F.concat(single_positions(guide), single_counts(guide), pair_positions(guide), pair_counts(guide), beside_pam(window), heat, F.array(gc_percent(guide) / 100)))


def with_model_score(df: DataFrame, features: str, model_path: str, name: str = "score") -> DataFrame:
    """``df`` with the output of an ONNX regression on the array column ``features``, null features give null.

    The file is read once in each Python worker. It must take one float matrix and give one value a row.
    """

    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import onnxruntime

        session = onnxruntime.InferenceSession(model_path, providers=["CPUExecutionProvider"])
        given = session.get_inputs()[0].name
        for series in batches:
            out = np.full(len(series), np.nan)
            there = series.notna().to_numpy()
            if there.any():
                out[there] = session.run(None, {given: np.stack(series[there].to_list()).astype(np.float32)})[0].reshape(-1)
            yield pd.Series(out)

    score = F.pandas_udf(predict, "double")(F.col(features))
    return df.withColumn(name, F.nanvl(score, F.lit(None).cast("double")))


def scaled(df: DataFrame, value: str, name: str = "scaled") -> DataFrame:
    """``value`` scaled to 0..1 over all rows; NaN and null stay out of the range, equal values give null."""
    known = F.nanvl(F.col(value), F.lit(None).cast("double"))
    ends = df.agg(F.min(known).alias("low"), F.max(known).alias("high")).first()
    if ends["low"] is None or ends["low"] == ends["high"]:
        return df.withColumn(name, F.lit(None).cast("double"))
    return df.withColumn(name, (known - ends["low"]) / (ends["high"] - ends["low"]))
