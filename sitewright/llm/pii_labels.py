"""Labelled spans for training the tagger: silver labels on documents, and the same spans refilled with other content.

Only training and tests use this module. The rules name the surface forms and the given names of the training
documents; the tagger doesn't read them.
"""

from __future__ import annotations

import random
import re

from sitewright.llm.pii_windows import BIBLIOGRAPHY

KINDS = ("email", "phone", "id_number", "street_address", "person_name")

# fixed values: words by which the training rules know the parts of names and addresses
GIVEN = "Aisha Amara Anna Bruno Clara Dmitri Elena Emeka Felix Greta Hana Hugo Ilse Ingrid Joana Jonas Kenji Leila Lucia Marek Mina Nadia Noor Oskar Paulo Priya Ravi Samuel Sofia Stefan Teresa Tomas Victor Wei Yusuf".split()
PARTICLES = "van der|von der|de la|del|von|van|de|da|di|al|el|ten|zu|la|le"
STREETS = "Street|St\\.|Road|Rd\\.?|Avenue|Ave\\.|Lane|Court|Square|Drive|Way|Place|Terrace|Hill|Row|Close|Crescent"
ROAD_WORDS = "rue|avenue|boulevard|place|allée|chemin|quai"
ROAD_FIRST = "Calle|Avenida|Rua|Plaza|Via|Paseo|Camino|Travessa|Carrer"
ROAD_ENDS = "weg|straße|strasse|str\\.|gasse|allee|platz|ring|ufer|damm"
LABELS = (
    "SSN|social security (?:no\\.|number)|soc\\. sec\\. (?:no\\.|number)|ORCID(?: iD)?:?|researcher (?:id|no\\.)|passport(?: no\\.| number)?|travel document|"
    "(?:identity|ID) card(?: no\\.)?|national (?:id|register no\\.)|staff no\\.|personnel number|employee id|student (?:id|no\\.)|matriculation no\\.|Matrikelnummer"
)

_GAP = r"(?:~|\\,|\\ |[ \t]*\n[ \t]*(?:%[ \t]*)?|[ \t]+)"
_LETTER = r"(?:[^\W\d_]|\\[\"'`^~=.]\{?\\?[A-Za-z]\}?|\\[vcuHk]\{[A-Za-z]\}|\{\\(?:o|O|l|L|ss|aa|AA|ae|AE|oe|OE)\})"
_INITIAL = r"[A-Z]\."
_GIVEN = rf"(?:{'|'.join(GIVEN)})(?:-(?:{'|'.join(GIVEN)}))?"
_SURNAME = rf"(?:(?:{PARTICLES}){_GAP})*(?:al-)?(?=[A-ZÀ-Ý]|\\|\{{\\)(?!\\(?:and|thanks|texttt|inst|footnote)){_LETTER}{{3,}}(?:-{_LETTER}{{3,}})?"
_NAME = re.compile(rf"(?<![\w\\@.-])(?:{_GIVEN}(?:{_GAP}{_INITIAL})*|{_INITIAL}(?:{_GAP}?{_INITIAL})*){_GAP}{_SURNAME}")
_TOWN = rf"[A-ZÀ-Ý][^\W\d_]+(?:{_GAP}[A-Z][^\W\d_]+)?"
_CODE = r"\d{4,6}"
_ADDRESS = re.compile(
    rf"(?<![\w])(?:\d{{1,4}}[a-z]?{_GAP}(?:[A-ZÀ-Ý][^\W\d_]+{_GAP}){{1,2}}(?:{STREETS})(?:,{_GAP}Apt\.{_GAP}\d+)?,{_GAP}{_TOWN}{_GAP}{_CODE}"
    rf"|P\.{_GAP}?O\.{_GAP}Box{_GAP}\d+,{_GAP}{_TOWN}{_GAP}{_CODE}"
    rf"|\d{{1,4}}{_GAP}(?:{ROAD_WORDS}){_GAP}(?:(?:des|de{_GAP}la|de|du){_GAP})?[A-ZÀ-Ý][^\W\d_]+,{_GAP}{_CODE}{_GAP}{_TOWN}"
    rf"|[A-ZÀ-Ý][^\W\d_]+(?:{ROAD_ENDS}){_GAP}\d{{1,4}}[a-z]?,{_GAP}{_CODE}{_GAP}{_TOWN}"
    rf"|(?:{ROAD_FIRST}){_GAP}(?:de{_GAP})?[A-ZÀ-Ý][^\W\d_]+{_GAP}\d{{1,4}}[a-z]?,{_GAP}{_CODE}{_GAP}{_TOWN})"
)
_AT = rf"(?:\\?@|\$@\$|\{{\\?@\}}|\\char64\{{\}}|{_GAP}?[\[(]at[\])]{_GAP}?|{_GAP}(?:AT|at){_GAP})"
_DOT = rf"(?:\.|{_GAP}?[\[(]dot[\])]{_GAP}?|{_GAP}dot{_GAP})"
_EMAIL = re.compile(rf"(?<![\w+.\\-])[A-Za-z0-9](?:[\w.+-]|\\_)*{_AT}[A-Za-z][\w-]*(?:{_DOT}[A-Za-z][\w-]*)*{_DOT}[A-Za-z]{{2,}}(?![\w-])")
_SEP = rf"(?:--|[-./]|{_GAP})"
_PHONE = re.compile(rf"(?<![\w./-])(?:\+\d{{1,3}}(?:{_SEP}?\(?\d{{1,4}}\)?)(?:{_SEP}?\d{{2,4}}){{1,4}}|\(\d{{3}}\){_SEP}?\d{{3}}{_SEP}\d{{4}}|00\d{{2,3}}(?:{_GAP}\d\d){{4}}|\d{{3}}(?P<s>{_SEP})\d{{3}}(?P=s)\d{{4}})(?![\w])(?!-\d)")
_ID = re.compile(rf"(?:{LABELS.replace(' ', _GAP)}){_GAP}(?P<n>[A-Z]{{1,2}}-?\d{{5,8}}|\d[\d.-]*(?:{_GAP}\d+){{0,3}}[A-Z]?)(?![\w])")


def _spans(text: str):
    for m in _EMAIL.finditer(text):
        yield m.start(), m.end(), "email"
    for m in _ADDRESS.finditer(text):
        yield m.start(), m.end(), "street_address"
    for m in _ID.finditer(text):
        end = m.end("n")
        yield m.start("n"), end - (text[end - 1] in ".-"), "id_number"
    for m in _PHONE.finditer(text):
        before = text[max(0, m.start() - 12) : m.start()]
        if not re.search(r"(?:contract|grant|grid\s+of|Build|protocol|lot|Runs of)\W*$", before):
            yield m.start(), m.end(), "phone"
    for m in _NAME.finditer(text):
        if text[m.start() + 1] != "." or not re.search(r"[\d%][\s~]*$", text[max(0, m.start() - 4) : m.start()]):  # else a unit
            yield m.start(), m.end(), "person_name"


def label(text: str) -> list[tuple[int, int, str]]:
    """Spans (begin, end, kind) in order, none overlapping; of two that overlap the earlier rule's stays."""
    hidden = [m.span() for m in BIBLIOGRAPHY.finditer(text)]
    taken: list[tuple[int, int, str]] = []
    for begin, end, kind in _spans(text):
        if all(end <= a or begin >= b for a, b, _ in taken) and not any(a <= begin < b for a, b in hidden):
            taken.append((begin, end, kind))
    return sorted(taken)


_ONSETS = "b c d f g h j k l m n p r s t v w z br ch cl dr fr gr kl kr pl pr sch sh sl st th tr".split()
_VOWELS = "a e i o u a e i o ai ei ia ie oa ou ue".split()
_CODAS = ["", "", "", "n", "r", "l", "s", "m", "nd", "rt", "ck", "ng", "x", "th"]


def _word(r: random.Random, least: int = 2, most: int = 4) -> str:
    return "".join(r.choice(_ONSETS) + r.choice(_VOWELS) + r.choice(_CODAS) for _ in range(r.randint(least, most) - 1)).capitalize() + r.choice(["", "a", "o", "er", "en", "son", "ski", "ez"])


def refill(span: str, kind: str, r: random.Random) -> str:
    """The span with other digits, and with other names in place of its longer words."""
    out = re.sub(r"\d", lambda _: r.choice("0123456789"), span)
    if kind == "person_name":
        out = re.sub(r"(?<!\\)\b[A-Z][a-zà-ÿ]{2,}", lambda m: _word(r) if r.random() < 0.7 else m.group(0), out)
    elif kind == "street_address":
        keep = re.compile(rf"(?:{STREETS}|{ROAD_FIRST}|Box|Apt|P|O)\b|.*(?:{ROAD_ENDS})$")
        out = re.sub(r"\b[A-Z][a-zà-ÿ]{2,}", lambda m: m.group(0) if keep.match(m.group(0)) else _word(r), out)
    elif kind == "email":
        out = re.sub(r"[a-z]{4,}(?=[\w.+-]*(?:@|\\| |\[|\())", lambda m: _word(r).lower() if r.random() < 0.5 else m.group(0), out, count=2)
    return out
