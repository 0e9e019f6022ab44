from __future__ import annotations

import itertools
import random

import pytest
from pyspark.sql import functions as F

from sitewright.functions import scoring
from sitewright.functions.guides import pack, packed_hamming
from sitewright.functions.sequences import context_window, context_window_5prime, count_letter, gc_percent, is_ambiguous, kmers, letters, plain_letters, relative_orientation, reported_location, reverse_complement, seed, self_complementarity, split_site
from sitewright.operators.latest import latest_by_key
from sitewright.operators.reports import first_rows, fitted_line, long_form, plot_labels, plot_segments, row_statistics, standardised
from sitewright.params import SiteParams
from sitewright.plans.pipeline import arms_pass, guide_passes


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


def text(spark, f, s):
    return value(spark, f(F.lit(s)))


def test_sequences(spark):
    assert text(spark, reverse_complement, "ACGTN") == "NACGT" and text(spark, reverse_complement, "RYKM") == "KMRY"
    assert text(spark, gc_percent, "ACGS") == 75.0 and text(spark, gc_percent, "") is None
    assert text(spark, plain_letters, "MRWSYKVHDBN") == "AAACCGAAACA"
    assert text(spark, letters, "  1 acg\r\n 61 TN ") == "ACGTN" and text(spark, lambda s: kmers(s, 2), "ACG") == ["AC", "CG"] and text(spark, lambda s: kmers(s, 5), "ACG") == []
    assert text(spark, lambda s: count_letter(s, "A"), "ABA") == 2 and text(spark, is_ambiguous, "ACGN") and not text(spark, is_ambiguous, "ACG")
    for guide, stems in (("ACGT" * 5, 10), ("GCGCAAAAAAAAAAAAGCGC", 1), ("GGGGCCCCAAAAAAAAAAAA", 0), ("ATATATATATATATATATAT", 0)):
        assert text(spark, lambda s: self_complementarity(s, 20), guide) == stems
    assert value(spark, reported_location(F.lit(10), F.lit("-"), F.lit(100), 20, 3)) == 67
    assert [value(spark, relative_orientation(F.lit(a), F.lit(b))) for a, b in ("++", "+-", "-+")] == ["tandem", "convergent", "divergent"]
    site = F.lit("A" * 20 + "TGG")
    assert [value(spark, x) for x in split_site(site, 20, 3, "3prime")] == ["A" * 20, "TGG"] and value(spark, split_site(site, 20, 3, "5prime")[1]) == "AAA"
    assert value(spark, seed(F.lit("ACGTACGTAC"), 3, 10, "3prime")) == "TAC" and value(spark, seed(F.lit("ACGTACGTAC"), 3, 10, "5prime")) == "ACG"


def test_context_windows(spark):
    parts = [F.lit(x) for x in ("CCCC" + "TTTT", "A" * 20, "AGG", "GCA" + "T" * 20)]
    assert value(spark, context_window(*parts, 20)) == "TTTT" + "A" * 20 + "AGGGCA"
    assert value(spark, context_window(F.lit("C"), F.lit("A" * 4 + "G" * 24), F.lit("AGG"), F.lit("TTTT"), 28)) == "G" * 24 + "AGGTTT"
    assert value(spark, context_window_5prime(*parts, 20)) == "T" + "AGG" + "A" * 20 + "GCATTTT"


def test_packed_distance(spark):
    r = random.Random(0)
    rows = [tuple("".join(r.choice("ACGT") for _ in range(20)) for _ in "ab") for _ in range(200)] + [("A" * 20, "A" * 20), (None, "A" * 20)]
    df = spark.createDataFrame(rows, "a string, b string")
    for a, b, d in df.select("a", "b", packed_hamming(pack(F.col("a")), pack(F.col("b")))).collect():
        assert d == (None if a is None else sum(x != y for x, y in zip(a, b, strict=True)))


@pytest.mark.parametrize(
    ("params", "guide", "kept"),
    [
        ({}, "G" * 20, True), ({"poly_g_guide": 4}, "ACGGGGAC", False), ({"poly_g_guide": 4}, "ACCCCCAC", False), ({"poly_t_guide": 3}, "CAAAC", False), ({"poly_t_guide": 4}, "CAAAC", True),
        ({"re_guide": "GAATTA"}, "CCTAATTCCC", False), ({"re_guide": "GAATTA,"}, "CCTAATTCCC", True), ({"gc_range": (50, 60)}, "ACGT", True), ({"gc_range": (51, 60)}, "ACGT", False),
    ],
)
def test_guide_filters(spark, params, guide, kept):
    assert value(spark, guide_passes(F.lit(guide), SiteParams(**params))) is kept


@pytest.mark.parametrize(
    ("params", "left", "right", "kept"),
    [
        ({"poly_g_arm": 4}, "ACCCC", "A", True), ({"poly_g_arm": 4}, "AGGGG", "A", False), ({"poly_g_arm": 4}, "A", "GGGG", True), ({"poly_g_arm": 4}, "A", "CCCC", False),
        ({"re_arm": "GAATTA"}, "CTAATTCC", "C", True), ({"re_arm": "GAATTA"}, "CGAATTAC", "C", False), ({"poly_t_arm": 3}, None, None, True),
    ],
)
def test_arm_filters(spark, params, left, right, kept):
    assert value(spark, arms_pass(F.lit(left), F.lit(right), SiteParams(**params))) is kept


def test_rule_score(spark):
    assert text(spark, scoring.rule_score, "A" * 30) == pytest.approx(0.236922877, abs=1e-8)
    assert text(spark, scoring.rule_score, "A" * 29) is None
    strong = "AAAAA" + "GC" * 10 + "AAAAA"
    assert text(spark, lambda s: scoring.rule_score(s, "guide"), strong) > text(spark, scoring.rule_score, strong)


def test_features(spark):
    window = "ACGTACGTTGCAACGTAGCATTGCAGGACT"
    found = text(spark, scoring.window_features, window[:25] + "GG" + window[27:])
    s = window[:25] + "GG" + window[27:]
    want = [float(c == k) for c in s for k in "ATCG"] + [float(s.count(k)) for k in "ATCG"]
    pairs = ["".join(p) for p in itertools.product("ATCG", repeat=2)]
    twos = [s[i : i + 2] for i in range(29)]
    want += [float(t == k) for t in twos for k in pairs] + [float(twos.count(k)) for k in pairs]
    gc = sum(c in "GC" for c in s[4:24])
    want += [float(gc > 10), float(gc < 10), float(gc)] + [float(s[24] + s[27] == "".join(p)) for p in itertools.product("ACGT", repeat=2)]
    assert len(found) == 627 and found[:-4] == want
    assert text(spark, scoring.window_features, "A" * 30) is None and len(text(spark, scoring.bacterial_features, s)) == 425


def melting(seq, table):
    """Written out again from the published formula."""
    import math

    pair = lambda p: table.get(p) or table["".join({"A": "T", "T": "A", "C": "G", "G": "C"}[c] for c in reversed(p))]
    total = [table["init"][n] + sum(pair(seq[i : i + 2])[n] for i in range(len(seq) - 1)) + sum(table["init_A/T" if e in "AT" else "init_G/C"][n] for e in (seq[0], seq[-1])) for n in (0, 1)]
    own = seq == seq.translate(str.maketrans("ACGT", "TGCA"))[::-1]
    total = [t + (table["sym"][n] if own else 0) for n, t in enumerate(total)]
    return 1000 * total[0] / (total[1] + 0.368 * (len(seq) - 1) * math.log(0.05) + 1.987 * math.log(25e-9 if own else 12.5e-9)) - 273.15


@pytest.mark.parametrize("table", [scoring.DNA_PAIRS, scoring.RNA_PAIRS])
@pytest.mark.parametrize("seq", ["CGTTCCAAAGATGTGGGCATGAGCTTAC", "ACGT", "AACGTT", "GCGCG"])
def test_melting_temperature(spark, seq, table):
    assert text(spark, lambda s: scoring.melting_temperature(s, len(seq), table), seq) == pytest.approx(melting(seq, table), abs=1e-6)
    assert text(spark, lambda s: scoring.melting_temperature(s, len(seq), table), "N" * len(seq)) is None


def test_scaling(spark):
    rows = lambda x: spark.createDataFrame([(i, v) for i, v in enumerate(x)], "i int, v double")
    assert [r.scaled for r in scoring.scaled(rows([1.0, 2.0, 3.0, None, float("nan")]), "v").orderBy("i").collect()] == [0.0, 0.5, 1.0, None, None]
    assert [r.scaled for r in scoring.scaled(rows([4.0, 4.0]), "v").collect()] == [None, None] and scoring.scaled(rows([]), "v").collect() == []
    assert [r.v for r in standardised(rows([1.0, 2.0, 3.0]), ["v"]).orderBy("i").collect()] == [-1.0, 0.0, 1.0] and standardised(rows([2.0]), ["v"]).first().v is None


def test_latest(spark):
    rows = [(1, 1, "a"), (1, 3, "b"), (1, 3, None), (2, None, "c"), (2, 1, "d"), (None, 1, "x"), (None, 1, "x")]
    df = spark.createDataFrame(rows, "k int, t int, v string").withColumns({"key": F.lit(9), "row": F.lit(9)})
    assert sorted((r.k is None, r.k or 0, r.v) for r in latest_by_key(df, "k", "t", ["v"]).collect()) == [(False, 1, "b"), (False, 2, "d"), (True, 0, "x"), (True, 0, "x")]
    assert latest_by_key(df.limit(0), "k", "t", ["v"]).collect() == []


def test_reports(spark):
    shape = "site_id int, chromosome string, accession string, chromosome_length bigint, site_location bigint, left_gene string, right_gene string"
    rows = [(1, "chr1", "a", 10, 5, "x", None), (2, "chr2", "b", None, 6, None, None), (3, "chr2", "b", 20, 7, "y", "z")]
    df = spark.createDataFrame(rows, shape)
    assert sorted(map(tuple, plot_labels(df).collect())) == [("chr1", 10), ("chr2", 20)]
    unnamed = spark.createDataFrame([*rows, (4, "nan", "c", 5, 1, None, None)], shape)
    assert sorted(map(tuple, plot_labels(unnamed).collect())) == [("a", 10), ("b", 20), ("c", 5)] and plot_labels(df.limit(0)).collect() == []
    lines = {r.site_id: (r.label, r.guide, r.x, r.y0, r.y1, r.genes) for r in plot_segments(unnamed.withColumn("guide", F.lit("G"))).collect()}
    assert lines == {1: ("a", "G", 5, 0.25, 0.75, "x,-"), 2: ("b", "G", 6, 1.25, 1.75, "-,-"), 3: ("b", "G", 7, 1.25, 1.75, "y,z"), 4: ("c", "G", 1, 2.25, 2.75, "-,-")}
    named = plot_segments(df.withColumn("guide", F.lit("G"))).collect()
    assert {r.site_id: (r.label, r.y0) for r in named} == {1: ("chr1", 0.25), 2: ("chr2", 1.25), 3: ("chr2", 1.25)}
    wide = spark.createDataFrame([("s", 1.0, 2.0, 3.0, 4.0)], "k string, a double, b double, da double, db double")
    assert sorted(map(tuple, long_form(wide, "k", ["a", "b"], ["da", "db"]).collect())) == [("s", "a", 1.0, 3.0), ("s", "b", 2.0, 4.0)]
    assert tuple(row_statistics(wide, "k", ["a", "da"]).first()) == ("s", 2.0, 1.0)
    assert row_statistics(wide.select("k", F.lit(None).cast("double").alias("a")), "k", ["a"]).first().mean is None
    points = spark.createDataFrame([(0.0, 1.0), (1.0, 3.0), (2.0, 5.0), (None, 9.0)], "x double, y double")
    assert tuple(fitted_line(points, "x", "y").first()) == (2.0, 1.0)
    assert sorted(r.site_id for r in first_rows(df, "accession", ["site_location"]).collect()) == [1, 2]
