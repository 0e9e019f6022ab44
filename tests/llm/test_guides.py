from __future__ import annotations

import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from sitewright.functions.guides import pack, unpack, usable_guide
from sitewright.llm import forest, frequent
from sitewright.llm.forest import SURE_PREFIX, _shared, forest_neighbours, nearest_guides, tree_orders
from sitewright.llm.frequent import HeavyLight, frequent_items
from sitewright.llm.splitting import best_cuts, split_oversized
from sitewright.llm.termcounts import marked_terms, ngram_counts


def test_usable_guides(spark):
    g = "ACGTACGTACGTACGTACGT"
    given = [g, g.lower() + " ", "\t" + g.replace("T", "U"), g[:10] + " " + g[10:], g + "CGG", g + "CGT", g[:-1], g[:-1] + "N", "", None, "-"]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(given)], "i int, g string")
    rows = df.select("i", usable_guide(F.col("g")).alias("u")).withColumn("back", unpack(pack(F.col("u")))).orderBy("i").collect()
    assert [r.u for r in rows] == [g] * 5 + [None] * 6 and all(r.back == r.u for r in rows)


def items(spark, rows, kind="bigint"):
    return spark.createDataFrame([(x,) for x in rows], f"item {kind}")


@pytest.mark.parametrize("kind", ["bigint", "string"])
def test_frequent_items_equal_counts(spark, kind):
    r = random.Random(1)
    values = [int(r.paretovariate(0.7)) % 5000 for _ in range(30_000)]
    values = [v if kind == "bigint" else f"v{v}" for v in values]
    found = {x.item: x for x in frequent_items(items(spark, [*values, None, None], kind).repartition(7), "item", 0.002).collect()}
    want = {k: n for k, n in Counter(values).items() if n >= 0.002 * len(values)}
    assert {k: x.n for k, x in found.items()} == want
    assert all(x.estimate >= x.n for x in found.values())


def test_frequent_items_crowded_sketch(spark, monkeypatch):
    """Too few slots for the hot items: those in crowded counters are still counted."""
    monkeypatch.setattr(frequent, "BUCKETS", 1)
    monkeypatch.setattr(frequent, "LIGHT", 4)
    monkeypatch.setattr(frequent, "SLOTS", 1)
    values = [i % 20 for i in range(2000)]
    found = {x.item: x.n for x in frequent_items(items(spark, values).coalesce(1), "item", 0.04).collect()}
    assert found == {i: 100 for i in range(20)}


def test_frequent_items_edges(spark):
    assert frequent_items(items(spark, []), "item", 0.1).collect() == []
    assert frequent_items(items(spark, [None]), "item", 0.1).collect() == []
    df = items(spark, [1, 1, 2, 2, 3]).withColumns({"key": F.lit("x"), "n": F.lit(0), "estimate": F.lit(None)})
    assert {(x.item, x.n) for x in frequent_items(df, "item", 0.4).collect()} == {(1, 2), (2, 2)}


def test_sketch_loses_no_vote():
    r = np.random.default_rng(0)
    sketch = HeavyLight(buckets=8, slots=2, light=16)
    for _ in range(20):
        keys = r.zipf(1.3, 500) % 1000
        sketch.add(keys, keys % 8, keys % 16)
    assert sketch.votes.sum() + sketch.light.sum() == 10_000


def plain_ngrams(rows, n):
    total, records = Counter(), defaultdict(set)
    for record, terms, weight in rows:
        for i in range(len(terms or [])):
            for k in range(1, n + 1):
                gram = tuple(terms[i : i + k])
                if len(gram) < k or None in gram:
                    break
                total[gram] += weight or 0
                if record is not None:
                    records[gram].add(record)
    return {g: (t, len(records[g])) for g, t in total.items()}


@pytest.mark.parametrize("n", [1, 2, 4])
def test_ngrams_equal_plain_counts(spark, n):
    r = random.Random(n)
    rows = [(r.choice(["a", "b", "c", None, "hot", "hot"]), [r.choice(["x", "x", "y", "z", "é"]) for _ in range(r.randrange(7))], r.choice([1, 2, None])) for _ in range(400)]
    rows += [("a", None, 1), ("a", [], 1), ("b", ["x", None, "y"], 1), ("b", [None], 1)]
    df = spark.createDataFrame(rows, "r string, t array<string>, w bigint").withColumns({"record": F.lit(1), "terms": F.lit(2), "first": F.lit(3)})
    found = ngram_counts(df, "r", "t", "w", max_n=n, spread=3).collect()
    assert len(found) == len({tuple(x.ngram) for x in found})
    assert {tuple(x.ngram): (x.total, x.records) for x in found} == plain_ngrams(rows, n)


def test_marks(spark):
    rows = spark.createDataFrame([(["a"], 2, 1), (["b"], 50, 5), (["c"], 3, 1), (["d"], 1, 5)], "ngram array<string>, total bigint, records bigint")
    assert {x.ngram[0]: x.marks for x in marked_terms(rows, 50, 2, 0.1).collect()} == {"a": ["rare"], "b": ["common"], "c": [], "d": ["rare", "common"]}
    assert all("common" not in x.marks for x in marked_terms(rows, 0, 2, 0.1).collect())


def check_pieces(pieces, letters, limit, overlap):
    own = 0
    for p in pieces:
        assert p.text == letters[p.begin : p.end] and p.end - p.begin <= limit
        assert p.begin + p.repeated == own and p.repeated == min(overlap, own)
        own = p.end
    assert own == len(letters)


def test_pieces(spark):
    r = random.Random(3)
    texts = []
    for _ in range(40):
        runs = ["".join(r.choice("ACGT") for _ in range(r.choice([5, 60, 100, 101, 250]))) for _ in range(r.randint(1, 6))]
        texts.append("".join(x + "N" * r.choice([3, 9, 10, 12, 300]) for x in runs))
    texts += ["", None, "acgt" * 25, "acgt" * 25 + "a", "1 aCg\r\n" * 60, "N" * 500]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, s string").withColumns({"item": F.lit(0), "text": F.lit("")})
    found = defaultdict(list)
    for row in split_oversized(df, "i", "s", 100, 7, grid=10).collect():
        found[row.item].append(row)
    for i, t in enumerate(texts):
        letters = "".join(c for c in t or "" if c.isalpha()).upper()
        pieces = sorted(found[i], key=lambda x: x.piece)
        if len(letters) <= 100:
            assert not pieces
            continue
        check_pieces(pieces, letters, 100, 7)
        import re

        longest = max(map(len, re.split("N{10,}", letters)))
        assert {p.cut_kind for p in pieces} == {"gap" if longest <= 100 else "inside"}
        assert pieces[0].cut_kind == "gap" or not all(p.at_gap for p in pieces)
        if longest <= 93:  # every stretch fits together with the overlap
            assert all(p.at_gap for p in pieces)


def test_cuts_are_even_where_nothing_else_counts():
    assert best_cuts(100, [], 100, 10) == [] and [p for p, _ in best_cuts(200, [], 110, 10)] == [100]
    assert [p for p, _ in best_cuts(300, [(90, 100), (180, 200)], 100, 50)][0] in (90, 100)
    with pytest.raises(ValueError):
        split_oversized(None, "a", "b", 10, -1)


def test_piece_edges(spark):
    empty = spark.createDataFrame([], "i int, s string")
    assert split_oversized(empty, "i", "s", 10, grid=5).collect() == []
    twice = spark.createDataFrame([(None, "A" * 25)] * 2, "i int, s string")
    assert [x.item for x in split_oversized(twice, "i", "s", 10, grid=5).collect()] == [None] * 6
    with pytest.raises(ValueError):
        split_oversized(twice, "i", "s", 10, 6, grid=5)


def coded(guide):
    return int("".join(str("ACGT".index(c)) for c in guide), 4)


def family(r, n):
    guides = ["".join(r.choice("ACGT") for _ in range(20)) for _ in range(n)]
    for g in list(guides):
        for _ in range(3):
            s = list(g)
            for i in r.sample(range(20), r.randint(0, 4)):
                s[i] = r.choice("ACGT")
            guides.append("".join(s))
    return guides


def differing(a, b):
    return sum(x != y for x, y in zip(a, b, strict=True))


def close(guides, most):
    return {(a, b, differing(a, b)) for a in guides for b in guides if 0 < differing(a, b) <= most}


@pytest.mark.parametrize("reach", [2048, 40, 1])
def test_forest_finds_every_close_pair(spark, monkeypatch, reach):
    """With a short reach guides get their neighbours by the exact search, and halos go over the ends of blocks."""
    monkeypatch.setattr(forest, "REACH", reach)
    monkeypatch.setattr(forest, "BLOCK", 100)
    guides = sorted(set(family(random.Random(reach), 80)))
    names = {coded(g): g for g in guides}
    rows = [tuple(x) for x in forest_neighbours(spark.createDataFrame([(c,) for c in names], "code bigint"), 30, 2).collect()]
    assert len(rows) == len(set(rows)) and {(names[a], names[b], d) for a, b, d in rows} == close(guides, 2)


def test_shared_letters_of_hash_strings():
    r = random.Random(1)
    for _ in range(200):
        a = "".join(r.choice("ACGT") for _ in range(20))
        b = a[: (n := r.randrange(21))] + "".join(r.choice("ACGT") for _ in range(20 - n))
        want = next((i for i in range(20) if a[i] != b[i]), 20)
        assert _shared(np.asarray([coded(a)]), np.asarray([coded(b)]))[0] == want


def test_near_guides_that_most_guides_resemble(spark, monkeypatch):
    """A third of all guides share sixteen letters; what they crowd out comes by the exact search."""
    monkeypatch.setattr(forest, "REACH", 20)
    monkeypatch.setattr(forest, "BLOCK", 64)
    r = random.Random(9)
    guides = sorted({"A" * 16 + "".join(r.choice("ACGT") for _ in range(4)) for _ in range(150)} | {"".join(r.choice("ACGT") for _ in range(20)) for _ in range(250)})
    names = {coded(g): g for g in guides}
    rows = [tuple(x) for x in forest_neighbours(spark.createDataFrame([(c,) for c in names], "code bigint"), 500, 2).collect()]
    assert {(names[a], names[b], d) for a, b, d in rows} == close(guides, 2)


@pytest.mark.parametrize("exact", [False, True])
def test_nearest_sites(spark, exact):
    r = random.Random(4)
    guides = family(r, 40)
    rows = [(i, coded(g)) for i, g in enumerate(guides)]
    given = [*rows, *rows[:5], (None, 3), (900, None)]
    df = spark.createDataFrame(given, "s bigint, c bigint").withColumns({"site": F.lit("x"), "code": F.lit("y"), "other": F.lit(1)})
    found = defaultdict(list)
    for x in nearest_guides(df, "s", "c", k=3, max_distance=2, exact=exact).collect():
        found[x.site].append((x.distance, x.other))
    for i, g in enumerate(guides):
        near = sorted((d, h, j) for j, h in enumerate(guides) if j != i and (d := differing(g, h)) <= 2)
        assert sorted(found[i]) == sorted((d, j) for d, _, j in near[:3])


@pytest.mark.parametrize("exact", [False, True])
def test_every_site_has_its_nearest(spark, exact):
    """However many letters they differ in; of 160 guides the forest compares every one with every other."""
    guides = family(random.Random(6), 40)
    found = defaultdict(list)
    for x in nearest_guides(spark.createDataFrame([(i, coded(g)) for i, g in enumerate(guides)], "s bigint, c bigint"), "s", "c", k=3, exact=exact).collect():
        found[x.site].append((x.distance, x.other))
    for i, g in enumerate(guides):
        near = sorted((differing(g, h), h, j) for j, h in enumerate(guides) if j != i)
        assert sorted(found[i]) == sorted((d, j) for d, _, j in near[:3])
    assert max(d for x in found.values() for d, _ in x) > 4


def test_forest_recall(spark):
    """Of guides without any order, whose neighbours are far."""
    r = random.Random(12)
    guides = sorted({"".join(r.choice("ACGT") for _ in range(20)) for _ in range(3000)})
    names = {coded(g): g for g in guides}
    found = defaultdict(list)
    for x in forest_neighbours(spark.createDataFrame([(c,) for c in names], "code bigint"), 10).collect():
        found[names[x.left]].append(x.distance)
    right = 0
    for g in guides[::50]:
        last = sorted(differing(g, h) for h in guides if h != g)[9]
        right += sum(d <= last for d in found[g])
    assert right >= 0.9 * 10 * len(guides[::50])


def test_many_sites_share_a_guide(spark):
    df = spark.createDataFrame([(i, 5) for i in range(400)] + [(1000, 4)], "s bigint, c bigint")
    rows = nearest_guides(df, "s", "c", k=4).collect()
    assert len(rows) == 401 * 4
    assert sorted(x.other for x in rows if x.site == 2) == [0, 1, 3, 4] and sorted(x.other for x in rows if x.site == 1000) == [0, 1, 2, 3]
    assert nearest_guides(df.limit(0), "s", "c").collect() == []
    with pytest.raises(ValueError):
        nearest_guides(df, "s", "c", max_distance=0)


def test_trees_cover_all_choices():
    orders = tree_orders()
    assert all(sorted(o) == list(range(20)) for o in orders)
    for i in range(20):
        for j in range(i):
            assert any(i not in o[:SURE_PREFIX] and j not in o[:SURE_PREFIX] for o in orders)
