from __future__ import annotations

import itertools
import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sitewright.llm.pii import as_read, find_pii, find_spans, load, redact_pii, replaced, settled, spans_of
from sitewright.llm.pii_forms import made_text
from sitewright.llm.pii_labels import label, refill
from sitewright.llm.pii_train import TAGS, examples, tag_numbers
from sitewright.llm.pii_windows import WIDTH, regions, windows
from sitewright.llm.tagger import Tagger, encode_batch, train

TEXT = r"""\documentclass{article}
\title{Stable loci in Prakelsil-A37}
\author{Greta Holvarmann \and I. M.~Brodersen\thanks{Corresponding author (greta.holvarmann [at] bio [dot] quorvia [dot] example).}}
\begin{document}
We thank Ravi J\"{o}rvekton for careful reading. In case of a spill call +1~555~555~0199 at once.
% The record was filed under passport no. XK0123456.
Samples were shipped to 12 Brusk Street, Apt. 4, Lindwick 00450. Supported under grant GR-4324-80.
The Harroberg test and the Harroberg-Quellidis bound agree. See protocol 2005-719-7971.
\begin{thebibliography}{9}
\bibitem{a2001} Wei Pellgarford and L. Zoltreaja. Notes, 79(1):107--646.
\end{thebibliography}
\end{document}
"""
WANT = {
    ("person_name", "Greta Holvarmann"), ("person_name", "I. M.~Brodersen"), ("email", "greta.holvarmann [at] bio [dot] quorvia [dot] example"), ("person_name", r"Ravi J\"{o}rvekton"),
    ("phone", "+1~555~555~0199"), ("id_number", "XK0123456"), ("street_address", "12 Brusk Street, Apt. 4, Lindwick 00450"),
}


def test_gradient():
    tagger = Tagger.fresh(["O", "B-x", "I-x"], 4)
    tagger.weights = {k: v.astype(np.float64) for k, v in tagger.weights.items()}
    symbols, size = encode_batch(["ab c1", "Xyz", "hello\n9"])
    gold = np.random.default_rng(0).integers(0, 3, symbols.shape)
    _, grad = tagger.loss_and_gradient(symbols, size, gold)
    for name, w in tagger.weights.items():
        at = np.unravel_index(np.abs(grad[name]).argmax(), w.shape)
        ends = []
        for step in (1e-3, -1e-3):
            w[at] += step
            ends.append(tagger.loss_and_gradient(symbols, size, gold)[0])
            w[at] -= step
        assert (ends[0] - ends[1]) / 2e-3 == pytest.approx(grad[name][at], rel=2e-3)


def test_viterbi_equals_all_paths():
    r = np.random.default_rng(1)
    tagger = Tagger.fresh(["O", "B-x", "I-x", "B-y", "I-y"], 3)
    tagger.weights["move"] = r.normal(0, 1, (5, 5)).astype(np.float32)
    scores, size = r.normal(0, 2, (4, 6, 5)).astype(np.float32), np.asarray([4, 3, 1, 2, 4, 3])
    found, ok = tagger._viterbi(scores, size), tagger.allowed()
    for b, n in enumerate(size):

        def value(path, b=b):
            if path[0] in (2, 4) or not all(ok[i, j] for i, j in itertools.pairwise(path)):
                return -np.inf
            return sum(scores[t, b, k] for t, k in enumerate(path)) + sum(tagger.weights["move"][i, j] for i, j in itertools.pairwise(path))

        assert tuple(found[:n, b]) == max(itertools.product(range(5), repeat=int(n)), key=value)


def test_training_learns_a_pattern():
    r = random.Random(0)
    texts, tags = [], []
    for _ in range(300):
        a, n = r.randrange(8), r.randint(2, 4)
        text = "x" * a + "@" + "y" * n + "z" * r.randrange(5)
        texts.append(text)
        tags.append(np.asarray([1 if i == a else 2 if a < i <= a + n else 0 for i in range(len(text))]))
    tagger = train(Tagger.fresh(["O", "B-e", "I-e"], 8), texts, tags, epochs=8, batch=32, rate=2e-2)
    found = tagger.decode(texts)
    assert np.mean([(f == g).all() for f, g in zip(found, tags, strict=True)]) > 0.95
    assert tagger.decode(["", "x"])[0].size == 0 and tagger.decode([]) == []


def test_windows_cover_regions():
    r = random.Random(2)
    text = " ".join(r.choice(["the", "Mina Zoltre", "a@b.cd", "123-456-7890", "word", "Zu", "%\n"]) for _ in range(600))
    decided = np.zeros(len(text), int)
    for begin, end, low, high in windows(text):
        assert end - begin <= WIDTH and begin <= low < high <= end
        decided[low:high] += 1
    inside = np.zeros(len(text), int)
    for a, b in regions(text):
        inside[a:b] = 1
    assert (decided == inside).all()
    assert regions("") == [] and regions("nothing here to find") == []


def test_windows_cover_all_text():
    shown, hidden = "nothing here to find, not even a number " * 60, r"\begin{thebibliography}{9} Wei Pellgarford \end{thebibliography}"
    for text in (shown, shown + hidden + shown, hidden + "x", hidden + hidden, "x", ""):
        decided = np.zeros(len(text), int)
        for begin, end, low, high in windows(text):
            assert end - begin <= WIDTH and begin <= low < high <= end
            decided[low:high] += 1
        want = np.ones(len(text), int)
        for k in range(len(text)):
            if text.startswith(hidden, k):
                want[k : k + len(hidden)] = 0
        assert (decided == want).all()


def test_case_without_a_trait_is_found():
    """Texts without two capitalised words, five digits or an at sign, which the tagger never saw."""
    plain = "the weather was fine and nothing happened. " * 30
    for before, case, kind in (("SSN ", "4821", "id_number"), ("Her passport no. ", "X4821", "id_number"), ("lives at ", "12 rue des lilas, 0045 Paris", "street_address")):
        text = plain + before + case + " and that was all. " + plain
        assert not regions(text)
        assert [(k, text[a:b]) for a, b, k in find_spans([text], load())[0]] == [(kind, case)]


def test_paths_on_open_stretches_equal_viterbi():
    r = np.random.default_rng(4)
    tagger = load()
    for bias, move in ((0.0, 1.0), (2.0, 1.0), (4.0, 1.0), (6.0, 1.0), (3.0, 0.0), (3.0, -1.0)):
        some = Tagger(tagger.tags, tagger.weights | {"move": tagger.weights["move"] * np.float32(move), "start": tagger.weights["start"] * np.float32(move)})
        scores, size = r.normal(0, 3, (40, 60, len(some.tags))).astype(np.float32), r.integers(1, 41, 60)
        scores[:, :, 0] += bias
        found, want = some._best_paths(scores, size), some._viterbi(scores, size)
        assert all((found[:n, k] == want[:n, k]).all() for k, n in enumerate(size))


def test_few_places_are_open():
    """Viterbi is worked out only around cases, though the bound must hold for all moves."""
    tagger = load()
    symbols, size = encode_batch([TEXT[a:b] for a, b, _, _ in windows(TEXT)] + ["The weather was fine and nothing happened, as in Table 12 of the last part. " * 6] * 4)
    some, _ = tagger._open(tagger.scores(symbols, size), size)
    assert 0 < some.sum() < 0.25 * size.sum()


def test_texts_without_hope_have_no_case():
    r = np.random.default_rng(5)
    tagger = load()
    texts = [TEXT[:-k] for k in range(1, 200, 7)] + ["so it was. " * 40, "lives at 12 rue des lilas, 0045 Paris", "SSN 4821", "x"]
    symbols, size = encode_batch(texts)
    real = tagger.scores(symbols, size)
    assert tagger._hopeful(real, size).tolist() == [*[True] * (len(texts) - 4), False, True, True, False]
    for bias in (2.0, 5.0, 8.0):
        scores = r.normal(0, 2, (60, 80, len(tagger.tags))).astype(np.float32)
        scores[:, :, 0] += bias
        size = r.integers(1, 61, 80)
        hope, want, strong = tagger._hopeful(scores, size), tagger._viterbi(scores, size), tagger._open(scores, size)[1]
        assert hope[strong.any(0)].all()
        assert not any(want[:n, k].any() for k, n in enumerate(size) if not hope[k])
        assert (~hope).any() or bias < 8


@pytest.mark.parametrize("onnx", [True, False])
def test_readers_equal_exact(onnx):
    if onnx:
        pytest.importorskip("onnxruntime")
    tagger = load()
    symbols, size = encode_batch([TEXT[:200], TEXT[200:330], "x", "Mina Zoltre"])
    exact = tagger.scores(symbols, size, keep=True)[0]
    found = tagger.scores(symbols, size, read=tagger.reader() if onnx else tagger._relative)
    assert all(np.abs(found[:n, k] - (exact[:n, k] - exact[:n, k, :1])).max() < 1e-3 for k, n in enumerate(size))


def test_labels_and_refills():
    r = random.Random(3)
    assert {(k, as_read(TEXT[a:b])) for a, b, k in label(TEXT)} >= {x for x in WANT if "J" not in x[1]} - {("person_name", "I. M.~Brodersen")}
    for a, b, kind in label(TEXT):
        new = refill(TEXT[a:b], kind, r)
        assert new and [c.isdigit() for c in new if c.isdigit() or c in "-@"][:3] == [c.isdigit() for c in TEXT[a:b] if c.isdigit() or c in "-@"][:3]
    texts, tags = examples([TEXT, TEXT], 1)
    assert len(texts) == len(set(texts)) and all(len(t) == len(g) for t, g in zip(texts, tags, strict=True))
    assert [TAGS[i] for i in tag_numbers(4, [(1, 3, "phone")])] == ["O", "B-phone", "I-phone", "O"]


def test_spans_and_ends():
    tags = ["O", "B-a", "I-a", "B-b", "I-b"]
    assert list(spans_of(tags, np.asarray([1, 2, 1, 0, 3, 4, 2, 0]))) == [(0, 2, "a"), (2, 3, "a"), (4, 6, "b"), (6, 7, "a")]
    text = "call (555) 555-0199, ext. 3. We thank Dr. Mina van der Zoltre. Here 00790888. and x@y.test."
    fix = lambda part, kind: (lambda s: s and text[s[0] : s[1]])(settled(text, text.index(part), text.index(part) + len(part), kind))
    assert fix("555) 555-01", "phone") == "(555) 555-0199"
    assert fix("Dr. Mina van der Zoltre. Here", "person_name") == "Mina van der Zoltre"
    assert fix("0790888", "id_number") == "00790888" and fix("y.te", "email") == "x@y.test"
    assert fix("Zoltre", "person_name") is None and fix("ext. 3", "phone") is None and fix("thank", "email") is None


def test_known_text():
    spans = find_spans([TEXT, ""], load())
    assert {(k, as_read(TEXT[a:b])) for a, b, k in spans[0]} == WANT and spans[1] == []
    out = replaced(TEXT, spans[0])
    assert "[EMAIL]" in out and "Holvarmann" not in out and "Wei Pellgarford" in out and "GR-4324-80" in out


OTHER_FORMS = [  # labelled by hand, none of a training pattern's own words
    ("SSN 123-45-6789", {"123-45-6789"}), ("We thank David P. Smith for help.", {"David P. Smith"}), ("Contact Michael Johnson (mjohnson@example.com) today.", {"Michael Johnson", "mjohnson@example.com"}),
    ("the talk by An Nguyen was good", {"An Nguyen"}), ("JANE MILLER wrote this", {"JANE MILLER"}), ("his passport no. X1234567 was lost", {"X1234567"}), ("call 555 0199 now", {"555 0199"}),
    ("1600 Pennsylvania Avenue NW, Washington, DC 20500", {"1600 Pennsylvania Avenue NW, Washington, DC 20500"}), ("lives at 10 Downing Street, London SW1A 2AA.", {"10 Downing Street, London SW1A 2AA"}),
    ("Tel: +1 202 555 0143, Fax: +1 202 555 0199", {"+1 202 555 0143", "+1 202 555 0199"}), ("ORCID 0000-0002-1825-0097", {"0000-0002-1825-0097"}), ("P.O. Box 1234, Palo Alto, CA 94302", {"P.O. Box 1234, Palo Alto, CA 94302"}),
    ("as Al Gore said", {"Al Gore"}), ("thanks to Šárka Nováková and Łukasz Wójcik", {"Šárka Nováková", "Łukasz Wójcik"}), ("автор Иван Петров сообщил", {"Иван Петров"}), ("jane AT host DOT org", {"jane AT host DOT org"}),
    ("write to a@3com.com please", {"a@3com.com"}), ("DNI 12345678Z", {"12345678Z"}), ("Hauptstraße 12, 10115 Berlin", {"Hauptstraße 12, 10115 Berlin"}), ("staff ID 48213", {"48213"}),
    ("RESULTS AND DISCUSSION follow. MATERIALS AND METHODS", set()), ("the University of Cambridge and the Max Planck Institute", set()), ("Monte Carlo and Gaussian Process models, see New York", set()),
    ("Smith et al. (2019) and Cauchy-Schwarz", set()), ("grant DMS-1234567 and arXiv:1234.56789", set()),
]


def test_other_forms():
    found = find_spans([t for t, _ in OTHER_FORMS], load())
    pairs = [({t[a:b] for a, b, _ in s}, want) for (t, want), s in zip(OTHER_FORMS, found, strict=True)]
    right = sum(len(f & w) for f, w in pairs)
    assert right >= 0.7 * sum(len(w) for _, w in pairs) and right >= 0.9 * sum(len(f) for f, _ in pairs)


def test_windows_offer_every_form():
    for text, want in OTHER_FORMS:
        for value in want:
            at = text.index(value)
            assert any(a <= at and b >= at + len(value) for a, b in regions(text)), text


def test_fast_reading_equals_exact():
    tagger = load()
    symbols, size = encode_batch([TEXT[:200], TEXT[200:330]])
    assert np.abs(tagger._read("f", symbols) - tagger._direction("f", symbols)[0]).max() < 0.02
    scores = tagger.scores(symbols, size)
    plain = tagger._only_outside(scores, size)
    assert all(not tagger._viterbi(scores, size)[: size[k], k].any() for k in np.flatnonzero(plain))


def test_made_texts_hold_their_spans():
    r = random.Random(5)
    kinds = set()
    for _ in range(200):
        text, spans = made_text(r)
        assert all(0 <= a < b <= len(text) and text[a:b].strip() == text[a:b] for a, b, _ in spans)
        kinds |= {k for _, _, k in spans}
    assert len(kinds) == 5


def test_queries_over_rows(spark):
    rows = [(1, TEXT), (1, TEXT), (2, None), (3, ""), (None, TEXT), (4, "no case\n" * 20_000), (5, "Tel. 555-555-0\n199 " + "x" * 200_000)]
    df = spark.createDataFrame(rows, "i bigint, t string").withColumns({"doc": F.lit("d"), "text": F.lit("t"), "kind": F.lit(None)})
    found = find_pii(df, "i", "t").collect()
    assert {(x.kind, x.found) for x in found if x.doc == 1} == WANT and len([x for x in found if x.doc == 1]) == 2 * len([x for x in found if x.doc is None])
    assert not [x for x in found if x.doc in (2, 3, 4)]
    assert all(as_read(TEXT[x.begin : x.end]) == x.found for x in found if x.doc in (1, None))
    clean = redact_pii(df, "i", "t").collect()
    assert len(clean) == len(rows) and sorted(x.replaced for x in clean if x.doc in (1, 2, 3, 4, None)) == [0, 0, 0, *[len(WANT)] * 3]
    assert [x.text for x in clean if x.doc in (2, 3)] == [None, ""] and find_pii(df.limit(0), "i", "t").collect() == []


@pytest.mark.skipif(not os.path.exists("/root/testdata/sf0.01/documents.parquet"), reason="needs the test data")
def test_held_out_accuracy(spark):
    """The silver labels are found again. Most of these texts are training documents too, so this tells what the tagger
    has learned, not what it does elsewhere; ``test_other_forms`` looks at that."""
    texts = [r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("text is not null").select("text").limit(400).collect()]
    right = found_n = wanted_n = 0
    for text, spans in zip(texts, find_spans(texts, load()), strict=True):
        found, want = {(k, as_read(text[a:b])) for a, b, k in spans}, {(k, as_read(text[a:b])) for a, b, k in label(text)}
        right, found_n, wanted_n = right + len(found & want), found_n + len(found), wanted_n + len(want)
    assert right / found_n > 0.98 and right / wanted_n > 0.98
