from __future__ import annotations

import random
import re
from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from sitewright.operators.genes import annotate_sites, gaps_between, gene_steps, numbered_zones, sites_in_zones
from sitewright.operators import offtarget
from sitewright.operators.offtarget import best_blocks, histogram_over_runs, mismatch_counts, nearest_guides, nearest_library_guide, similar_guides, specific_guides
from sitewright.operators.sites import find_sites, guide_library, site_tiles, unique_guides
from sitewright.params import SiteParams, expand, motif_list
from sitewright.plans import site_queries
from sitewright.plans.pipeline import Scorer, network_scorer, neutral_sites, numbered

SMALL = SiteParams(distal_end=50, intergenic_space=30, density_length=500, edit_distance=3)
PAIRS = str.maketrans("ACGTN", "TGCAN")


def scan(accession, seq, params):
    found = set()
    for strand, s in (("+", seq), ("-", seq.translate(PAIRS)[::-1])):
        for pam in params.pams:
            for m in re.finditer(pam, s):
                at = m.start() - (params.guide_length if params.orientation == "3prime" else 0)
                if -1 < at < len(s) - params.guide_length - len(pam):
                    site = s[at : at + params.guide_length + len(pam)]
                    found.add((site, accession, at, strand))
    return found


@pytest.mark.parametrize("params", [SMALL, replace(SMALL, orientation="5prime", pam="TTTV", guide_length=23)])
def test_scan_equals_plain_search(spark, params):
    r = random.Random(5)
    contigs = [(f"c{i}", "".join(r.choice("ACGGTN" if i % 2 else "ACGT") for _ in range(n))) for i, n in enumerate((0, 22, 23, 24, 300, 4000))]
    df = spark.createDataFrame([*contigs, ("none", None)], "accession string, seq string")
    rows = [tuple(x) for x in find_sites(df, params).select("site", "accession", "location", "strand").collect()]
    want = set().union(*(scan(a, s, params) for a, s in contigs))
    assert len(rows) == len(set(rows)) and set(rows) == want


@pytest.mark.parametrize("params", [SMALL, replace(SMALL, overlap="all"), replace(SMALL, orientation="5prime", pam="TTTV", guide_length=23), replace(SMALL, pam="GGG")])
def test_tiles_equal_the_plain_scan(spark, params):
    """Seams fall into runs of one letter, near ends and into sites; arms reach over them."""
    r = random.Random(6)
    contigs = [(f"c{i}", "".join(r.choice(("ACGT", "G" * 9, "C" * 7, "T" * 8, "ACGT")[r.randrange(5)]) * r.choice((1, 1, 1, 9)) for _ in range(n))) for i, n in enumerate((5, 60, 900))]
    df = spark.createDataFrame(contigs, "accession string, seq string")
    whole = sorted(map(str, find_sites(df, params).collect()))
    assert len(whole) > 50 and site_tiles(df, params, 64).count() > 20
    for size in (1, 37, 64, 500):
        assert sorted(map(str, find_sites(df, params, size).collect())) == whole
    if params.overlap == "reference":
        rows = {tuple(x) for x in find_sites(df, params, 64).select("site", "accession", "location", "strand").collect()}
        assert rows == set().union(*(scan(a, s, params) for a, s in contigs))


def test_long_contig_spreads_over_tasks(spark):
    r = random.Random(7)
    df = spark.createDataFrame([("long", "".join(r.choice("ACGT") for _ in range(400_000)))], "accession string, seq string")
    tiles = site_tiles(df, SMALL, 10_000)
    assert tiles.select(F.spark_partition_id()).distinct().count() == 4 and tiles.agg(F.max(F.length("seq"))).first()[0] < 10_200


def test_runs_and_ends(spark):
    def places(seq, **more):
        df = spark.createDataFrame([("c", seq)], "accession string, seq string")
        return sorted(r.location for r in find_sites(df, replace(SMALL, pam="GGG", **more)).where("strand = '+'").collect())

    assert places("A" * 20 + "GGGGGG" + "A") == [0, 3]
    assert places("A" * 20 + "GGGG" + "A") == [0]
    assert places("A" * 20 + "GGGG" + "A", overlap="all") == [0, 1]
    assert places("A" * 20 + "GGG") == []
    assert places("A" * 20 + "GGGA") == [0]


def test_arms(spark):
    seq = "C" * 60 + "A" * 20 + "AGG" + "T" * 60
    df = spark.createDataFrame([("c", seq)], "accession string, seq string")
    row = find_sites(df, SMALL).where("strand = '+' and pam = 'AGG'").first()
    assert (row.left_arm, row.right_arm) == ("C" * 50, "T" * 50)
    short = spark.createDataFrame([("c", seq[10:-10])], "accession string, seq string")
    row = find_sites(short, SMALL).where("strand = '+' and pam = 'AGG'").first()
    assert (row.left_arm, row.right_arm) == (None, None)  # both would touch the ends


def test_parameters():
    assert expand("NGG") == ["AGG", "CGG", "GGG", "TGG"]
    assert expand("TTTV") == ["TTTA", "TTTC", "TTTG"] and expand("RY") == ["AC", "GC", "AT", "GT"]
    assert motif_list("GAATTC,") == [] and motif_list("") == [] and motif_list("RG, CC") == ["AG", "GG", "CC"]
    for bad in ({"seed_length": 20}, {"gc_range": (-1, 50)}, {"gc_range": (0, 101)}, {"distal_end": 10}, {"orientation": "up"}, {"guide_length": 41}, {"distance": "x"}):
        with pytest.raises(ValueError):
            replace(SiteParams(), **bad).check()


def test_unique_guides(spark):
    rows = [("A" * 20, 1), ("C" * 10 + "A" * 10, 1), ("C" * 20, 2), ("G" * 20, 1)]
    library = spark.createDataFrame(rows, "guide string, frequency int")
    assert [r.guide for r in unique_guides(library, SMALL).collect()] == ["G" * 20]
    assert {r.guide for r in unique_guides(library, replace(SMALL, seed_length=0)).collect()} == {"A" * 20, "C" * 10 + "A" * 10, "G" * 20}


@pytest.mark.parametrize("within", [1, 2, 3, 4])
def test_similar_guides_equal_brute_force(spark, within):
    r = random.Random(within)
    guides = ["".join(r.choice("ACGT") for _ in range(20)) for _ in range(60)]
    for g in guides[:40]:
        for _ in range(4):
            s = list(g)
            for i in r.sample(range(20), r.randint(1, 6)):
                s[i] = r.choice("ACGT")
            guides.append("".join(s))
    some = guides[::3]
    df = lambda x: spark.createDataFrame([(g,) for g in [*x, x[0], None]], "guide string")
    pairs = similar_guides(df(some), df(guides), 20, within)
    want = {(a, b, d) for a in some for b in guides if 0 < (d := sum(x != y for x, y in zip(a, b, strict=True))) <= within}
    rows = [tuple(x) for x in pairs.collect()]
    assert len(rows) == len(set(rows)) and set(rows) == want
    kept = {x.guide for x in specific_guides(df(some).dropna(), df(guides), 20, within).collect()}
    assert kept == {a for a in some if all(not 0 < sum(x != y for x, y in zip(a, b, strict=True)) < within for b in guides)}


def test_nearest_guide_at_any_distance(spark):
    r = random.Random(8)
    guides = sorted({"".join(r.choice("ACGT") for _ in range(20)) for _ in range(80)})
    guides += [g[:-1] + ("A" if g[-1] != "A" else "C") for g in guides[:10]]
    some = guides[:30]
    df = lambda x: spark.createDataFrame([(g,) for g in x], "guide string")
    apart = lambda a, b: sum(x != y for x, y in zip(a, b, strict=True))
    want = {a: min((apart(a, b), b) for b in guides if b != a) for a in some}
    assert {x.guide: (x.distance, x.other) for x in nearest_library_guide(df(some), df(guides), 20).collect()} == want
    kept = specific_guides(df(some), df(guides), 20, 4).collect()
    assert {x.guide: (x.nearest_distance, x.nearest) for x in kept} == {a: n for a, n in want.items() if n[0] >= 4}
    assert len(kept) == 20 and max(x.nearest_distance for x in kept) > 4
    alone = specific_guides(df(some[:1]), df(some[:1]), 20, 4).collect()
    assert [(x.guide, x.nearest, x.nearest_distance) for x in alone] == [(some[0], None, None)]


@pytest.mark.parametrize("blocks", [2, 3, 5, 8])
def test_hot_keys_are_dealt(spark, monkeypatch, blocks):
    """A third of all guides share most letters; their keys go to several groups, and no pair is lost or doubled."""
    for name, size in (("WANTED_A_GROUP", 4), ("LIBRARY_A_GROUP", 16), ("COUNTED", 1), ("_LARGE", 30), ("_AT_ONCE", 50)):
        monkeypatch.setattr(offtarget, name, size)
    r = random.Random(4)
    guides = sorted({"A" * 14 + "".join(r.choice("ACGT") for _ in range(6)) for _ in range(80)} | {"".join(r.choice("ACGT") for _ in range(20)) for _ in range(160)})
    df = spark.createDataFrame([(g,) for g in guides], "guide string")
    apart = {(a, b): sum(x != y for x, y in zip(a, b, strict=True)) for a in guides for b in guides if a != b}
    rows = [tuple(x) for x in similar_guides(df, df, 20, 2, blocks).collect()]
    assert len(rows) == len(set(rows)) and set(rows) == {(*k, d) for k, d in apart.items() if d <= 2}
    near = {(x.guide, x.rank): (x.distance, x.other) for x in nearest_guides(df, df, 20, 2).collect()}
    for g in guides:
        assert [near[g, 1], near[g, 2]] == sorted((apart[g, b], b) for b in guides if b != g)[:2]


@pytest.mark.parametrize("letters", [32, 40])
def test_long_guides(spark, letters):
    r = random.Random(letters)
    guides = ["".join(r.choice("ACGT") for _ in range(letters)) for _ in range(30)]
    guides = sorted({*guides, *(g[:-2] + "AC" for g in guides), *("T" + g[1:] for g in guides)})
    df = spark.createDataFrame([(g,) for g in guides], "guide string")
    apart = lambda a, b: sum(x != y for x, y in zip(a, b, strict=True))
    assert {tuple(x) for x in similar_guides(df, df, letters, 3).collect()} == {(a, b, apart(a, b)) for a in guides for b in guides if 0 < apart(a, b) <= 3}


def test_keys_grow_with_the_library():
    lengths = [20 * (1 - 3 / best_blocks(20, 3, n, n)[0]) for n in (10**3, 10**5, 10**7, 10**9)]
    assert lengths == sorted(lengths) and lengths[-1] >= 8 and lengths[0] <= 5


def test_few_edits_but_many_mismatches(spark):
    """The three guides that differ in the fewest letters are edited, however many letters these are."""
    shifted = "CGTTGACATCGGATTACGAT"
    near = shifted[1:] + "G"  # two edits, nearly all letters differ
    df = lambda x: spark.createDataFrame([(g,) for g in x], "guide string")
    apart = sum(x != y for x, y in zip(shifted, near, strict=True))
    assert apart > 10
    assert specific_guides(df([shifted]), df([shifted, near]), 20, 4, "levenshtein").collect() == []
    kept = specific_guides(df([shifted]), df([shifted, near]), 20, 4).collect()
    assert [(x.nearest, x.nearest_distance) for x in kept] == [(near, apart)]


def test_mismatch_counts_over_runs(spark):
    library = ["A" * 20, "C" + "A" * 19, "CC" + "A" * 18, "G" * 20]
    rows = [("r1", library[0]), ("r1", library[3]), ("r2", library[0]), ("r2", None)]
    runs = spark.createDataFrame(rows, "run string, guide string")
    counts = mismatch_counts(runs, spark.createDataFrame([(g,) for g in library], "guide string"), 20)
    assert {(x.run, x.guide): [x[f"mm{d}"] for d in range(6)] for x in counts.collect()} == {
        ("r1", "A" * 20): [1, 1, 1, 0, 0, 0], ("r1", "G" * 20): [1, 0, 0, 0, 0, 0], ("r2", "A" * 20): [1, 1, 1, 0, 0, 0], ("r2", None): [None] * 6,
    }
    found = {x.mismatches: (x["mean"], x.deviation) for x in histogram_over_runs(counts, "run").collect()}
    assert found == {0: (0, 0), 1: (1, 0), 2: (1, 0), 3: (0, 0), 4: (0, 0), 5: (0, 0)}


def crowded_genome(spark):
    """Sites whose guides differ in 1 to 7 letters."""
    r = random.Random(3)
    seq = ""
    for base in ("".join(r.choice("ACT") for _ in range(20)) for _ in range(12)):
        for most in range(8):
            s = list(base)
            for i in r.sample(range(20), most):
                s[i] = r.choice("ACT")
            seq += "".join(s) + "TGG"
    return find_sites(spark.createDataFrame([("c", seq)], "accession string, seq string"), SMALL)


def apart_in(sites):
    """(guide, other): differing letters, of every candidate and every other library guide."""
    library = [x.guide for x in guide_library(sites).collect()]
    some = [x.guide for x in unique_guides(guide_library(sites), site_queries.PARAMS).collect()]
    return {(a, b): sum(x != y for x, y in zip(a, b, strict=True)) for a in some for b in library if a != b}


def test_nearest_guide_query_has_every_candidate(spark, monkeypatch):
    sites = crowded_genome(spark)
    monkeypatch.setattr(site_queries, "_sites", lambda *_: sites)
    want = {}
    for (a, b), d in apart_in(sites).items():
        want.setdefault(a, []).append((d, b))
    found = {(x.guide, x.rank): (x.distance, x.other) for x in site_queries.three_nearest(spark, "").collect()}
    assert found == {(a, n + 1): x for a, near in want.items() for n, x in enumerate(sorted(near)[:3])}
    assert max(d for d, _ in found.values()) > 2


def test_counts_and_similar_guides_reach_all_classes(spark, monkeypatch):
    sites = crowded_genome(spark)
    monkeypatch.setattr(site_queries, "_sites", lambda *_: sites)
    apart = apart_in(sites)
    some = {a for a, _ in apart}
    want = {a: [1, *(sum(d == k for (x, _), d in apart.items() if x == a) for k in range(1, 6))] for a in some}
    assert {x.guide: [x[f"mm{d}"] for d in range(6)] for x in site_queries.off_target_classes(spark, "").collect()} == want
    assert all(any(w[k] for w in want.values()) for k in range(6))
    rows = {(x.guide, x.other): x.distance for x in site_queries.near_guides(spark, "").collect()}
    assert rows == {k: d for k, d in apart.items() if d <= 4}


GENES = [("c", 100, 200, "+", "g1"), ("c", 300, 400, "-", "g2"), ("c", 500, 600, "-", "g3"), ("n", 100, 1000, "+", "a"), ("n", 200, 300, "+", "b"), ("n", 2000, 2100, "+", "d")]
AROUND = {
    ("c", 250): ("g1", "g2", 100, "convergent"), ("c", 450): ("g2", "g3", 100, "tandem"), ("c", 50): (None, "g1", None, None), ("c", 700): ("g3", None, None, None),
    ("n", 1500): ("b", "d", 1700, "tandem"), ("e", 10): (None, None, None, None),
}


@pytest.mark.parametrize("size", [64, 10_000])
def test_genes_around_sites(spark, size):
    genes = spark.createDataFrame(GENES, "accession string, start bigint, stop bigint, strand string, tag string")
    contigs = spark.createDataFrame([("c", 1000), ("n", 3000), ("e", 100)], "accession string, chrom_length bigint")
    sites = spark.createDataFrame(list(AROUND), "accession string, x bigint").join(contigs, "accession")
    found = {(r.accession, r.x): r for r in annotate_sites(sites, genes, contigs, 0, 160, only_free=False, size=size).collect()}
    assert {k: (r.left_gene, r.right_gene, r.intergenic_size, r.relative_orientation) for k, r in found.items()} == AROUND
    assert found["c", 250].gene_density == 2 and found["e", 10].gene_density is None
    free = {(r.accession, r.x) for r in annotate_sites(sites, genes, contigs, 50, 160, size=size).collect()}
    assert free == {("c", 700), ("n", 1500), ("e", 10), ("c", 250), ("c", 450), ("c", 50)}
    assert not annotate_sites(sites, genes, contigs, 51, 160, size=size).where("accession = 'c' and x in (250, 450, 50)").count()


@pytest.mark.parametrize("space, window", [(0, 3), (5, 40)])
def test_contig_with_most_genes(spark, space, window):
    r = random.Random(11)
    starts = [r.randrange(1, 280) for _ in range(600)]
    rows = [("h", s, s + r.choice((0, 1, 9, 60)), r.choice("+-"), f"t{i}") for i, s in enumerate(starts)] + [("o", 5, 9, "+", "only")]
    genes = spark.createDataFrame(rows, "accession string, start bigint, stop bigint, strand string, tag string")
    contigs = spark.createDataFrame([("h", 300), ("o", 300)], "accession string, chrom_length bigint")
    assert gene_steps(genes, contigs, space, window, 100).selectExpr("max(size(steps))").first()[0] <= 100
    sites = spark.createDataFrame([(a, x) for a in "ho" for x in range(0, 301, 7)], "accession string, x bigint").join(contigs, "accession")
    found = {(g.accession, g.x): g for g in annotate_sites(sites, genes, contigs, space, window, only_free=False, size=100).collect()}
    free = {(g.accession, g.x) for g in annotate_sites(sites, genes, contigs, space, window, size=100).select("accession", "x").collect()}
    for (accession, x), got in found.items():
        own = sorted((g[1], g[2], g[4]) for g in rows if g[0] == accession)
        passed, last = sum(stop < x for _, stop, _ in own), own[-1][1]
        left = None if x < own[0][0] else len(own) - 1 if x > last else passed - 1 if passed else None
        right = 0 if x < own[0][0] else passed if x <= last and 0 < passed < len(own) else None
        assert (got.left_gene, got.right_gene) == (None if left is None else own[left][2], None if right is None else own[right][2])
        assert got.gene_density == sum(a > max(0, x - window) and b < min(300, x + window) for a, b, _ in own)
        assert ((accession, x) in free) == (not any(a - space < x < b + space for a, b, _ in own))


def test_zones(spark):
    genes = spark.createDataFrame(GENES[3:], "accession string, start bigint, stop bigint, strand string, tag string")
    contigs = spark.createDataFrame([("n", 3000), ("e", 100)], "accession string, chrom_length bigint")
    order = spark.createDataFrame([("n", 1)], "accession string, first_row bigint")
    zones = numbered_zones(gaps_between(genes, contigs), order)
    assert sorted((r.zone, r.accession, r.low, r.high) for r in zones.collect()) == [(1, "n", 0, 100), (2, "n", 1000, 200), (3, "n", 300, 2000), (4, "n", 2100, 3000), (5, "e", 0, 100)]
    sites = spark.createDataFrame([("n", 1500), ("n", 2000), ("n", 0), ("e", 5), ("u", 5)], "accession string, x bigint")
    assert {(r.accession, r.x): r.zone for r in sites_in_zones(sites, zones, 700).collect()} == {("n", 1500): 3, ("n", 2000): None, ("n", 0): None, ("e", 5): 5, ("u", 5): None}


def test_scorers_and_zones(spark):
    r = random.Random(4)
    genome = spark.createDataFrame([("c", "".join(r.choice("ACGT") for _ in range(3000)), 3000)], "accession string, seq string, chrom_length bigint")
    features = spark.createDataFrame([("c", "chr", 1)], "accession string, name string, feature_row bigint")
    genes = spark.createDataFrame([("c", 900, 1000, "+", "g")], "accession string, start bigint, stop bigint, strand string, tag string")
    zones = spark.createDataFrame([("c", 0, 900, 1), ("c", 1000, 3000, 2)], "accession string, low bigint, high bigint, zone bigint")
    size = Scorer(lambda df, window, name: df.withColumn(name, F.length(window).cast("double")), "TTTV", "5prime", 27)
    params = replace(SMALL, pam="TTTV", orientation="5prime")
    rows = neutral_sites(genome, features, genes, params, size, zones=zones).collect()
    assert rows and {x.on_target_score for x in rows if x.left_hr and x.right_hr} == {32.0}
    assert all(x.zone == (1 if x.x < 900 else 2) for x in rows)
    assert {x.on_target_score for x in neutral_sites(genome, features, genes, params).collect()} == {None}  # the rule set is for NGG
    plain = {"conv1_kernel": (3, 4, 2), "conv2_kernel": (3, 2, 2), "dense1_kernel": (16, 1)}
    weights = {k: np.ones(shape, np.float32) for k, shape in plain.items()} | {"conv1_bias": np.zeros(2, np.float32), "conv2_bias": np.zeros(2, np.float32), "dense1_bias": np.zeros(1, np.float32)}
    weights |= {f"norm{n}_{k}": np.full(2, v, np.float32) for n in (1, 2) for k, v in (("scale", 1), ("shift", 0), ("mean", 0), ("variance", 1))}
    scores = [x.on_target_score for x in neutral_sites(genome, features, genes, params, network_scorer(weights, "5prime")).collect() if x.left_hr and x.right_hr]
    assert scores and all(s is not None and s < 0 for s in scores)


def test_result_has_no_near_guides(spark):
    r = random.Random(2)
    genome = spark.createDataFrame([(f"c{i}", "".join(r.choice("ACGT") for _ in range(2000)), 2000) for i in range(3)], "accession string, seq string, chrom_length bigint")
    features = spark.createDataFrame([("c0", "chr0", 2), ("c0", "late", 3), ("c1", "chr1", 1)], "accession string, name string, feature_row bigint")
    genes = spark.createDataFrame([("c0", 500, 700, "+", "g")], "accession string, start bigint, stop bigint, strand string, tag string")
    found = numbered(neutral_sites(genome, features, genes, SMALL)).cache()
    rows = found.orderBy("id").collect()
    assert [x.id for x in rows] == list(range(1, len(rows) + 1)) and rows
    assert {(x.accession, x.chromosome) for x in rows} == {("c0", "chr0"), ("c1", "chr1")}
    assert rows == sorted(rows, key=lambda x: (x.accession, x.site_location, x.strand, x.guide_sequence))
    library = guide_library(find_sites(genome, SMALL))
    assert similar_guides(found.select(F.col("guide_sequence").alias("guide")), library, 20, SMALL.edit_distance - 1).count() == 0
    assert not [x for x in rows if x.accession == "c0" and 470 < x.x < 730]
    empty = neutral_sites(genome.limit(0), features, genes, SMALL)
    assert empty.collect() == []
