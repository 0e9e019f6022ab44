from __future__ import annotations

import sys

import numpy as np
from pyspark.sql import functions as F

from sitewright.functions.networks import convolved, network_scores, one_hot, pooled, tensor, with_network_score
from sitewright.functions.scoring import window_features, with_model_score
from sitewright.operators.offtarget import specific_guides
from sitewright.operators.reports import over_runs
from sitewright.sources.files import read_essential, read_model_options, search_hits


def weights(r, length, dense):
    w = {}
    for n, (width, a, b) in enumerate(((5, 4, 20), (8, 20, 40)), 1):
        w |= {f"conv{n}_kernel": r.normal(size=(width, a, b)), f"conv{n}_bias": r.normal(size=b), f"norm{n}_scale": r.normal(size=b), f"norm{n}_shift": r.normal(size=b), f"norm{n}_mean": r.normal(size=b), f"norm{n}_variance": r.uniform(0.5, 2, b)}
    sizes = [length // 2 // 2 * 40, *dense, 1]
    for n, (a, b) in enumerate(zip(sizes, sizes[1:], strict=False), 1):
        w |= {f"dense{n}_kernel": r.normal(size=(a, b)), f"dense{n}_bias": r.normal(size=b)}
    return w


def test_convolution_by_hand():
    r = np.random.default_rng(0)
    x, kernel, bias = r.normal(size=(2, 7, 3)), r.normal(size=(4, 3, 2)), r.normal(size=2)
    padded = np.pad(x, ((0, 0), (1, 2), (0, 0)))
    want = np.asarray([[[max(0, bias[f] + sum(padded[n, t + k, c] * kernel[k, c, f] for k in range(4) for c in range(3))) for f in range(2)] for t in range(7)] for n in range(2)])
    assert np.allclose(convolved(x, kernel, bias), want)
    assert np.allclose(pooled(x, np.max)[0, 2], x[0, 4:6].max(0)) and pooled(x, np.mean).shape == (2, 3, 3)


def test_network_in_spark(spark):
    r = np.random.default_rng(1)
    for length, dense in ((28, (80,)), (32, (80, 40, 40))):
        w = weights(r, length, dense)
        seqs = ["".join(r.choice(list("ACGT"), length)) for _ in range(20)]
        df = spark.createDataFrame([*((i, s) for i, s in enumerate(seqs)), (90, None), (91, "ACGT")], "i int, s string")
        rows = {x.i: x.score for x in with_network_score(df, "s", length, w).collect()}
        assert np.allclose([rows[i] for i in range(20)], network_scores(seqs, w)) and rows[90] is None and rows[91] is None
    assert tensor(["A" * 32])[0, :, 0].sum() == 28
    row = spark.createDataFrame([("acgtN",)], "s string").select(one_hot(F.col("s"), 3).alias("v")).first().v
    assert row == [[1, 0, 0, 0], [0, 1, 0, 0], [0, 0, 1, 0], [0] * 4, [0] * 4]


def test_feature_switches(spark, tmp_path):
    (tmp_path / "o.json").write_text('{"nuc_features": false, "include_Tm": false, "order": 2}')
    options = read_model_options(str(tmp_path / "o.json"))
    window = "ACGTACGTTGCAACGTAGCATTGCAGGACT"
    s = window[:25] + "GG" + window[27:]
    row = spark.range(1).select(*(F.size(window_features(F.lit(s), o)).alias(n) for n, o in (("a", None), ("b", options), ("c", {"order": 1})))).first()
    assert tuple(row) == (627, 19, 627 - 480)


def _field(number, kind, value):
    return bytes([number << 3 | kind]) + value


def _bytes(number, value):
    n, size = len(value), b""
    while n > 127:
        size += bytes([n & 127 | 128])
        n >>= 7
    return _field(number, 2, size + bytes([n]) + value)


def sum_model():
    """An ONNX file that adds up its rows, written out as bytes."""
    over_columns = _bytes(1, b"axes") + _field(8, 0, b"\x01") + b"\xa0\x01\x07"  # its kind: whole numbers
    node = _bytes(1, b"x") + _bytes(2, b"y") + _bytes(4, b"ReduceSum") + _bytes(5, over_columns)
    typed = lambda name, columns: _bytes(1, name) + _bytes(2, _bytes(1, _field(1, 0, b"\x01") + _bytes(2, _bytes(1, _bytes(2, b"n")) + _bytes(1, _field(1, 0, bytes([columns]))))))
    graph = _bytes(1, node) + _bytes(2, b"g") + _bytes(11, typed(b"x", 3)) + _bytes(12, typed(b"y", 1))
    return _field(1, 0, b"\x07") + _bytes(7, graph) + _bytes(8, _field(2, 0, b"\x0b"))


def test_onnx_model(spark, tmp_path):
    (tmp_path / "m.onnx").write_bytes(sum_model())
    df = spark.createDataFrame([(1, [1.0, 2.0, 3.0]), (2, None), (3, [0.0, 0.5, 0.0])], "i int, f array<double>")
    assert {x.i: x.score for x in with_model_score(df, "f", str(tmp_path / "m.onnx")).collect()} == {1: 6.0, 2: None, 3: 0.5}


def test_levenshtein_mode(spark):
    a, shifted = "ACGTTGCAACGTAGCATTGC", "CGTTGCAACGTAGCATTGCA"  # two edits, many differing letters
    near = a[:-3] + "AAA"
    df = lambda *g: spark.createDataFrame([(x,) for x in g], "guide string")
    assert specific_guides(df(a), df(a, shifted), 20, 3, "levenshtein").collect() == [] and specific_guides(df(a), df(a, shifted), 20, 2, "levenshtein").count() == 1
    others = [x + a[1:9] + y + a[10:19] + z for x, y, z in ("CAA", "GGG", "TTT")]  # three that differ in three letters count before it
    assert [x.nearest for x in specific_guides(df(a), df(a, shifted, *others), 20, 3, "levenshtein").collect()] == [min(others)]
    assert specific_guides(df(a), df(a, near), 20, 4, "levenshtein").collect() == [] and specific_guides(df(a), df(a, near), 20, 3, "hamming").count() == 1
    assert [x.nearest_distance for x in specific_guides(df(a), df(a, near), 20, 3).collect()] == [3] and specific_guides(df(a), df(a, near), 20, 0).count() == 1


def test_runs_and_search(spark, tmp_path):
    counts = spark.createDataFrame([(1, "a", 2), (2, "a", 4), (2, "b", 6), (3, "a", 0)], "run int, k string, n int")
    assert {x.k: (x.mean, round(x.deviation, 6)) for x in over_runs(counts, "run", ["k"], "n").collect()} == {"a": (2.0, round(np.std([2, 4, 0]), 6)), "b": (2.0, round(np.std([0, 6, 0]), 6))}
    (tmp_path / "deg.csv").write_text("id,seq,Organism\nD1,MK,yeast\nD2,ML,other\n")
    assert [tuple(x) for x in read_essential(spark, str(tmp_path / "deg.csv"), ["yeast"]).collect()] == [("D1", "MK")]
    program = "import sys\nfor r in sys.stdin.read().split('>')[1:]:\n    k, s = r.split()\n    print(k, 's', 60, len(s), 0, 0, 1, 2, 3, 4, 1e-9, 50, sep='\\t')"
    queries = spark.createDataFrame([("q1", "MKV"), ("q2", None), ("q3", "M")], "k string, s string")
    hits = search_hits(queries, "k", "s", [sys.executable, "-c", program]).collect()
    assert sorted((x.query, x.aln_length, x.e_value) for x in hits) == [("q1", 3, 1e-9), ("q3", 1, 1e-9)]
