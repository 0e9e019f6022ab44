from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sitewright.llm.leaks import edit_distance_within, find_leaks, words_of
from sitewright.llm.packing import CapacityTree, best_fit_decreasing, pack_documents, token_counts

WORDS = [f"w{i}" for i in range(400)]


def test_words():
    assert words_of(r"The \emph{Quick} ``fox''~jumps% over" "\n" r"\textbf{3.5}~\cite{key2004} clus\-ters {\it a}-B ÀÉ") == ["the", "quick", "fox", "jumps", "over", "3", "5", "clusters", "a", "b", "àé"]


def plain_distance(pattern, text):
    row = list(range(len(pattern) + 1))
    best = row[-1]
    for w in text:
        new = [0]
        for i, p in enumerate(pattern):
            new.append(min(row[i] + (p != w), row[i + 1] + 1, new[i] + 1))
        row = new
        best = min(best, row[-1])
    return best


def test_bit_distance_equals_table():
    r = random.Random(0)
    for _ in range(300):
        a = [r.choice("abc") for _ in range(r.randint(1, 15))]
        b = [r.choice("abc") for _ in range(r.randrange(30))]
        assert edit_distance_within(a, b) == plain_distance(a, b)


def leak_case(r, n_items=6, n_docs=60):
    items = [(i, " ".join(r.choice(WORDS) for _ in range(r.choice([8, 12, 40])))) for i in range(n_items)]
    docs = []
    for d in range(n_docs):
        text = [r.choice(WORDS) for _ in range(60)]
        if d % 2:
            words = r.choice(items)[1].split()
            n = min(len(words), r.choice([10, 11, 12, 13, 20]))
            at = r.randrange(len(words) - n + 1)
            part = words[at : at + n]
            if d % 3 == 0:
                part[n // 2] = "changed"
            text[20:20] = part
        docs.append((d, " ".join(text)))
    return items, docs


@pytest.mark.parametrize("edits", [0, 1, 2])
def test_leaks_equal_brute_force(spark, edits):
    items, docs = leak_case(random.Random(edits))
    d = spark.createDataFrame([*docs, (900, None), (901, "")], "doc_id bigint, text string").withColumns({"doc": F.lit(1), "item": F.lit(2)})
    i = spark.createDataFrame([*items, (77, None)], "item_id bigint, passage string").withColumn("text", F.lit("x"))
    found = {(x.doc, x.item): x for x in find_leaks(d, "doc_id", "text", i, "item_id", "passage", 12, edits).collect()}
    want = {}
    for doc, text in docs:
        for item, passage in items:
            words = passage.split()
            near = [plain_distance(words[k : k + 12], text.split()) for k in range(len(words) - 11)]
            if near and min(near) <= edits:
                want[doc, item] = min(near)
    assert {k: x.edits for k, x in found.items()} == want and want
    for (doc, item), x in found.items():
        assert (x.run_words >= 12) == (x.edits == 0)
        run = dict(docs)[doc].split()[x.at_word : x.at_word + x.run_words]
        assert " ".join(run) in dict(items)[item]


def test_leaks_with_a_full_filter_and_empty(spark, monkeypatch):
    from sitewright.llm import leaks

    items, docs = leak_case(random.Random(5))
    d = spark.createDataFrame(docs, "doc_id bigint, text string")
    i = spark.createDataFrame(items, "item_id bigint, passage string")
    whole = sorted(map(tuple, find_leaks(d, "doc_id", "text", i, "item_id", "passage").collect()))
    monkeypatch.setattr(leaks, "FILTER_BITS", 8)
    assert sorted(map(tuple, find_leaks(d, "doc_id", "text", i, "item_id", "passage").collect())) == whole
    assert find_leaks(d.limit(0), "doc_id", "text", i, "item_id", "passage").collect() == []
    assert find_leaks(d, "doc_id", "text", i.limit(0), "item_id", "passage").collect() == []
    with pytest.raises(ValueError):
        find_leaks(d, "doc_id", "text", i, "item_id", "passage", 1, 1)


def plain_best_fit(sizes, capacity):
    rooms, out = [], [0] * len(sizes)
    for i in np.argsort(-sizes, kind="stable"):
        fitting = [(room, b) for b, room in enumerate(rooms) if room >= sizes[i]]
        if fitting:
            b = min(fitting)[1]
        else:
            b = len(rooms)
            rooms.append(capacity)
        rooms[b] -= sizes[i]
        out[i] = b
    return out, rooms


def test_best_fit_takes_the_tightest_bin():
    r = np.random.default_rng(1)
    for capacity in (1, 7, 100, 128):
        sizes = r.integers(1, capacity + 1, 200)
        bins = best_fit_decreasing(sizes, capacity)
        used = np.bincount(bins, sizes)
        assert used.max() <= capacity
        _, rooms = plain_best_fit(sizes, capacity)
        assert sorted(used) == sorted(capacity - x for x in rooms)
    tree = CapacityTree(10)
    assert tree.tightest(1) == -1
    tree.add(4, 0)
    tree.add(9, 1)
    assert [tree.tightest(n) for n in (1, 4, 5, 9, 10)] == [4, 4, 9, 9, -1]


@pytest.mark.parametrize("shard_size", [5, 50, 5000])
def test_packed_documents(spark, shard_size):
    r = random.Random(2)
    rows = [(i, r.choice([0, 1, 30, 60, 99, 100, 101, 250, None])) for i in range(500)] + [(1, 60), (1, 60), (None, 50)]
    df = spark.createDataFrame(rows, "doc bigint, tokens bigint").withColumn("bin", F.lit("x"))
    out = pack_documents(df, 100, bins_a_shard=shard_size).collect()
    rooms, parts = {}, {}
    for x in out:
        assert x.end - x.begin == x.tokens and (x.container is None) == (x.tokens == 0)
        if x.container is not None:
            rooms[x.container] = rooms.get(x.container, 0) + x.tokens
        parts.setdefault(x.doc, []).append((x.begin, x.end))
    assert max(rooms.values()) <= 100
    total = sum(n or 0 for _, n in rows)
    assert sum(rooms.values()) == total and len(rooms) <= 1.1 * total / 100
    for doc, n in rows:
        if doc not in (1, None):
            assert sorted(parts[doc]) == [(a, min(a + 100, n or 0)) for a in range(0, max(1, n or 0), 100)]
    assert pack_documents(df.limit(0), 100).collect() == []


def test_tokens_cover_the_text(spark):
    import base64

    from sitewright.llm.packing import TOKENIZER, _encoding

    texts = ["", None, "Let $x_{i+1} \\le 3$ hold.\n\n", "é 漢字 " * 50, "a" * 30_000, " \n" * 2000]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string").withColumn("doc", F.lit(0))
    found = {x.doc: x.tokens for x in token_counts(df, "i", "t").collect()}
    encoding = _encoding(TOKENIZER)
    for i, t in enumerate(texts):
        tokens = encoding.encode_ordinary(t or "")
        assert found[i] == len(tokens) and encoding.decode(tokens) == (t or "")
    assert base64.b64encode(b"x")
