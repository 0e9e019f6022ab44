"""Train the tagger of personal information: ``python -m sitewright.llm.pii_train documents.parquet weights.npz [epochs]``.

A fourth argument names weights to go on from, at a lower rate and with all windows that hold names.

A bounded sample of documents (``DOCUMENTS``) gives labelled windows: as they stand, and with their spans refilled, so
that the tagger learns forms and surroundings instead of the names and numbers of the sample. ``MADE`` texts of
``pii_forms`` add forms that the documents lack. Texts that are held out are in no training window, whatever their id.
"""

from __future__ import annotations

import random
import sys
from collections.abc import Sequence
from multiprocessing import get_context

import numpy as np

from sitewright.llm.pii_forms import made_text
from sitewright.llm.pii_labels import KINDS, label, refill
from sitewright.llm.pii_windows import windows
from sitewright.llm.tagger import Tagger, train

DOCUMENTS = 4000
MADE = 24_000
REFILLS = 1
WORKERS = 8
NAMES_KEPT, PLAIN_KEPT = 0.35, 0.15
RATE, RATE_ON = 4e-3, 6e-4  # for fresh weights, and to go on from others
HIDDEN = 32
TAGS = ["O", *(f"{x}-{k}" for k in KINDS for x in "BI")]


def tag_numbers(size: int, spans: Sequence[tuple[int, int, str]]) -> np.ndarray:
    out = np.zeros(size, np.int8)
    for a, b, kind in spans:
        out[a:b] = TAGS.index(f"I-{kind}")
        out[a] = TAGS.index(f"B-{kind}")
    return out


def refilled(text: str, spans: list[tuple[int, int, str]], r: random.Random) -> tuple[str, list[tuple[int, int, str]]]:
    parts, moved, at, size = [], [], 0, 0
    for a, b, kind in spans:
        new = refill(text[a:b], kind, r)
        parts += [text[at:a], new]
        size += a - at
        moved.append((size, size + len(new), kind))
        size += len(new)
        at = b
    return "".join([*parts, text[at:]]), moved


def examples(texts: Sequence[str], refills: int = 0, names_kept: float = 1.0, seed: int = 0, plain_kept: float = 1.0) -> tuple[list[str], list[np.ndarray]]:
    """Windows with their tags, equal windows once: each text as it is, and ``refills`` times with its spans refilled.

    The rare kinds, and windows with digits that are no case, come with every refill. Of the windows that hold names or
    nothing, a share of ``names_kept`` is taken from the text as it is and its first refill only; of the windows that hold
    nothing at all, digits or not, a share of ``plain_kept``.
    """
    r = random.Random(seed)
    seen: dict[str, np.ndarray] = {}
    for text in texts:
        spans = label(text)
        for n in range(refills + 1):
            t, s = (text, spans) if not n else refilled(text, spans, r)
            tags = tag_numbers(len(t), s)
            for a, b, _, _ in windows(t):
                part = tags[a:b].copy()
                if plain_kept < 1 and not part.any() and r.random() >= plain_kept:
                    continue
                rare = any(TAGS[k][2:] not in ("", "person_name") for k in np.unique(part)) or sum(c.isdigit() for c in t[a:b]) > 5
                if not rare and (n > 1 or r.random() >= names_kept):
                    continue
                if part[0] and TAGS[part[0]][0] == "I":  # a span that the window cuts begins in it
                    part[0] -= 1
                seen.setdefault(t[a:b], part)
    return list(seen), list(seen.values())


def made_examples(texts: Sequence[str], n: int, seed: int = 7) -> tuple[list[str], list[np.ndarray]]:
    """Windows of made texts, two thirds of them between two stretches of a document."""
    r = random.Random(seed)
    seen: dict[str, np.ndarray] = {}
    for _ in range(n):
        given, at = r.choice(texts), r.random()
        before, after = (given[k : k + r.randrange(60)] for k in (int(at * len(given)), int(at * at * len(given))))
        made, spans = made_text(r, r.choice([1, 2, 3]))
        if r.random() < 1 / 3:
            before = after = ""
        text = before + r.choice([" ", "\n"]) + made + after
        shift = len(before) + 1
        tags = tag_numbers(len(text), [*label(before), *((a + shift, b + shift, kind) for a, b, kind in spans), *((a + shift + len(made), b + shift + len(made), kind) for a, b, kind in label(after))])
        for a, b, _, _ in windows(text):
            part = tags[a:b].copy()
            if part[0] and TAGS[part[0]][0] == "I":
                part[0] -= 1
            seen.setdefault(text[a:b], part)
    return list(seen), list(seen.values())


def main(source: str, target: str) -> None:
    import pyarrow.parquet as pq

    table = pq.read_table(source, columns=["doc_id", "text"]).to_pylist()
    texts = [x["text"] for x in sorted(table, key=lambda x: x["doc_id"]) if x["text"]]
    texts = list(dict.fromkeys(texts))
    r = random.Random(1)
    r.shuffle(texts)
    held = examples(texts[DOCUMENTS : DOCUMENTS + 300])
    made = made_examples(texts[:DOCUMENTS], MADE)
    unseen = made_examples(texts[DOCUMENTS : DOCUMENTS + 300], 500, seed=8)
    more = len(sys.argv) > 4
    given = examples(texts[:DOCUMENTS], REFILLS, 1.0 if more else NAMES_KEPT, seed=int(more), plain_kept=PLAIN_KEPT)
    start = Tagger.load(sys.argv[4]) if more else Tagger.fresh(TAGS, HIDDEN)
    given = tuple(x + y for x, y in zip(given, made, strict=True))
    print(len(given[0]), "windows,", sum(map(len, given[0])), "characters", flush=True)

    def report(epoch: int, loss: float, tagger: Tagger) -> None:
        for name, (some, tags) in {"held-out": held, "made": unseen}.items():
            wrong = sum(bool((f != g).any()) for f, g in zip(tagger.decode(some), tags, strict=True))
            print(f"epoch {epoch}: loss {loss:.3f}, {name} windows not all right {wrong} of {len(some)}", flush=True)
        tagger.save(target)

    with get_context("fork").Pool(WORKERS) as pool:
        train(start, *given, epochs=int(sys.argv[3]) if len(sys.argv) > 3 else 6, batch=256, rate=RATE_ON if more else RATE, report=report, run=pool.map, shares=WORKERS)


if __name__ == "__main__":
    main(sys.argv[1], sys.argv[2])
