"""A text as overlapping windows for the tagger: all of it but bibliographies. Its stretches with a trait of a case serve to compare."""

from __future__ import annotations

import re
from collections.abc import Iterator

WIDTH, OVERLAP = 480, 48
BIBLIOGRAPHY = re.compile(r"\\begin\{thebibliography\}.*?(?:\\end\{thebibliography\}|\Z)", re.S)

_GAP = r"(?:~|\\[ ,]|\s*\n\s*(?:%\s*)?|[ \t])"
_CAPITAL = "A-ZÀ-ÖØ-ÞĀ-ɏΆ-ΫЀ-Я"  # of Latin, Greek and Cyrillic; in the extended part both cases
_BEGIN = rf"(?:[{_CAPITAL}]|\\['\"`^~=.vcuHkr]\W?[A-Za-z]|\{{\\)"
_NAME = re.compile(rf"[{_CAPITAL}](?:\.|[^\W_][\w'’-]*)(?=({_GAP}{{1,2}}(?:(?:[a-z]{{1,4}}{_GAP}{{1,2}}){{1,2}}|[a-z]{{2}}-)?{_BEGIN}\S*))")
_ACCENTED = re.compile(rf"\\['\"`^~=.vcuHkr]\W?[A-Z]\S*{_GAP}{{1,2}}{_BEGIN}\S*|[A-Z][a-z]*\\['\"`^~=.vcuHkr]\W?[A-Za-z]\S*{_GAP}{{1,2}}{_BEGIN}\S*")
_DIGITS = re.compile(r"\d(?:[-+ .~()\\,/\n]{0,3}\d){4,}|\d(?:[A-Z ]{0,2}\d){4,}")
_SIGN = re.compile(r"@")
_BRACKETED = re.compile(r"[\[({<]\s?(?:at|AT)\s?[\])}>]")
_SPELLED = re.compile(r"(?<![^\W_])(?:at|AT)\s+[A-Za-z0-9][\w-]*\s*(?:\.[A-Za-z]|[\[({]?\s*\b(?:dot|DOT)\b)")


def _triggers(text: str) -> Iterator[tuple[int, int]]:
    """Stretches with a trait of personal information, with the room it may take on either side: two capitalised words or
    initials, maybe particles between; five digits with little between; the sign of an address or its spellings."""
    for m in _NAME.finditer(text):
        yield m.start() - 28, m.end(1) + 12
    if "\\" in text:
        for m in _ACCENTED.finditer(text):
            yield m.start() - 28, m.end() + 12
    for m in _DIGITS.finditer(text):
        yield m.start() - 44, m.end() + 20
    for m in _SIGN.finditer(text):
        yield m.start() - 52, m.end() + 44
    if "char64" in text:
        for m in re.finditer("char64", text):
            yield m.start() - 52, m.end() + 44
    for pattern in (_BRACKETED, _SPELLED):
        for m in pattern.finditer(text):
            yield m.start() - 52, m.end() + 60


def _bibliographies(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in BIBLIOGRAPHY.finditer(text)] if "{thebibliography}" in text else []


def regions(text: str) -> list[tuple[int, int]]:
    """The merged stretches around all triggers, without bibliographies. They tell where a case is likely; finding doesn't use them."""
    found = sorted((max(0, a), min(len(text), b)) for a, b in _triggers(text))
    hidden = _bibliographies(text)
    merged: list[list[int]] = []
    for begin, end in found:
        for a, b in hidden:
            if begin < a < end:
                end = a
            elif a <= begin < b:
                begin = min(b, end)
        if begin >= end:
            continue
        if merged and begin <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], end)
        else:
            merged.append([begin, end])
    return [(a, b) for a, b in merged]


def windows(text: str) -> Iterator[tuple[int, int, int, int]]:
    """(begin, end, from, to): windows of at most ``WIDTH`` characters over all of the text but its bibliographies, and the
    part of the text each one decides."""
    hidden = _bibliographies(text)
    for begin, end in zip([0, *(b for _, b in hidden)], [*(a for a, _ in hidden), len(text)], strict=True):
        at = begin
        while at < end:
            stop = min(at + WIDTH, end)
            yield at, stop, at + (OVERLAP // 2 if at > begin else 0), stop - (OVERLAP // 2 if stop < end else 0)
            if stop == end:
                break
            at = stop - OVERLAP
