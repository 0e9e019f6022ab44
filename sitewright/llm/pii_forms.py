"""Sentences with labelled personal information in forms that the documents lack, and sentences that only look like it.

Training mixes them with the windows of the documents, so that the tagger learns forms of other countries, scripts and
fields. Names and towns are partly invented by syllables.
"""

from __future__ import annotations

import random
import re
from collections.abc import Callable

from sitewright.llm.pii_labels import _word

# fixed values: given names, surnames and towns of many countries, and patterns of the sentences
GIVEN = (
    "Al An Bo Ed Jo Li Michael David Sarah John Mary Robert Linda James Jennifer William Susan Peter Paul Laura Kevin Emily Daniel Karen Mark Nancy George Helen Anthony Ruth Andrew Rachel Simon Alice Martin Julia "
    "Thomas Katrin Jürgen Björn Søren Åsa Zoë André Renée François Léa Chloé José María Íñigo Joaquín Luís João Gonçalo Şule Çiğdem Mehmet Ayşe Łukasz Małgorzata Paweł Šárka Jiří Zdeněk Žofia Gábor Ágnes Ștefan Ioana "
    "Mihai Đorđe Nikola Ivana Giorgos Eleni Иван Мария Юлия Сергей Ольга Олександр Νίκος Mohammed Fatima Omar Leila Hassan Yasmin Ali Arjun Ananya Sanjay Deepa Rahul Minh Thu Nguyen Hiroshi Yuki Keiko Jun Wei Xiaoming Mei "
    "Chen Hyun Jisoo Kwame Ama Chidi Ngozi Thabo Zanele De Le La"
).split()
SURNAMES = (
    "Smith Johnson Miller Brown Davis Wilson Taylor Moore Gore Clark Lewis Young King Wright Hill Green Baker Adams Nelson Carter O'Brien O'Neill McDonald MacLeod Nguyen Tran Pham Kim Park Lee Choi Wang Zhang Li Chen Liu Tanaka "
    "Suzuki Sato Singh Patel Sharma Gupta Khan Rahman Hussein Haddad García López Hernández Muñoz Silva Santos Ferreira Gonçalves Rossi Bianchi Esposito Müller Schäfer Weiß Schröder Jansen Visser Bakker Larsen Nielsen Åkesson "
    "Öberg Nováková Dvořák Wójcik Kowalska Łukasiewicz Szabó Nagy Popescu Ionescu Đoković Petrović Yılmaz Öztürk Papadopoulos Иванов Петрова Шевченко Παπαδόπουλος Okafor Mensah Dlamini Abebe"
).split()
TOWNS = "London Bristol Leeds Paris Lyon Lille Berlin Köln München Wien Zürich Roma Milano Madrid Sevilla Lisboa Porto Utrecht Gent Oslo Malmö Praha Gdańsk Boston Springfield Denver Austin Toronto Ottawa Sydney Perth Auckland Dublin Cork".split()
PARTS = "van der|von|de la|de|del|da|di|al|el|ten|bin|van|le|dos".split("|")
NAME_IN = (
    "We thank {n} for comments.|Written by {n} and {n}.|Contact {n} for access.|{n} proposed the idea.|as {n} pointed out,|said {n}.|\\author{{{n}}}|Dear {n},|Prof. {n} joined.|Dr. {n} agreed|% ask {n} about this|Signed, {n}|"
    "Name: {n}|{n}, {n} and {n} measured it.|the interview with {n} in May|Patient {n} was seen|by {n}|cc {n};|Ms. {n} replied|{n} ({e})|Reviewed by {n}, {n}.|Reviewer: {n}\n|{n} wrote the code, {n} the text."
).split("|")
EMAIL_IN = "mail {e}.|({e})|e-mail: {e}|write to {e} for data|Correspondence: {e}|\\email{{{e}}}|{n}, {e}|<{e}>|reach us at {e}, please".split("|")
PHONE_IN = "call {p}.|Tel.: {p}|Fax: {p}|phone {p}, ext. 4|mobile {p}|ring {p} after noon|Tel. {p} and Fax: {p}|hotline ({p})|dial {p} or {p}|Phone: {p}; Fax: {p}".split("|")
ID_IN = "SSN {i}|passport no. {i}.|Passport number {i}|ORCID {i}|student number {i}|staff ID {i}|national ID {i},|identity card {i}|NI number {i}|tax number {i}|employee no. {i}|credit card {i}|matriculation number {i}|social security number: {i}|researcher id {i}".split("|")
PLACE_IN = "Send it to {a}.|lives at {a}.|Address: {a}|{a}|our office, {a}, is open|shipped to {a} today|mailed to {n}, {a}.|Postal address: {a}\n".split("|")
ADDRESSES = (
    "{n} {w} Street, {t} {uk}|{n} {w} Road, {t} {uk}|{n} {w} Lane, {t} {uk}|{n} {w} Avenue NW, {t}, {st} {z}|{n} {w} {w} Boulevard, {t}, {st} {z}|P.O. Box {n}, {t}, {st} {z}|PO Box {n}, {t} {z}|{n} {w} Drive, Apt. {n}, {t}, {st} {z}|"
    "{w}straße {n}, {z} {t}|{w}weg {n}, {z} {t}|{n} rue de {w}, {z} {t}|{n} avenue {w}, {z} {t}|Via {w} {n}, {z} {t}|Calle {w} {n}, {z} {t}|Rua {w} {n}, {q}-{h} {t}|{w}straat {n}, {q} {L}{L} {t}|{w}gata {n}, {q} {t}|{n} {w} Road, {t}, ON {ca}|"
    "{n} {w} Parade, {t} NSW {q}|ul. {w} {n}, {k}-{h} {t}|{n}-{n} {w}, {t} {h}-{q}|Postfach {n}, {z} {t}"
).split("|")
NOTHING = (
    "the {s} method of {s} and {s}|{s} et al. (20{k})|{s}'s theorem|University of {t}|the {s} Institute in {t}|Table {k}: {c} {c}|Section {k}. {c} {c} {l}|under grant {L}{L}-{q}-{k}|protocol {q}-{h}-{q}|Build {q}{q}|see doi 10.{q}/{z}|RESULTS AND DISCUSSION|"
    "MATERIALS AND {U}|the {c} {c} algorithm|{c} {c} Network|Monte Carlo {l}|Markov Chain {l}|New York, San Francisco and {t}|on 12 May 20{k}|a grid of {h} {h} {h} points|contract no. {q} {z}|lot {z}-{k}|version 3.{k}.{k}|at {k}.{k} GHz DOT product|"
    "Department of {c} {c}|{c} {c}, {c} and {c}|catalogue number {z}|samples {q} to {q}|the {s}-{s} bound|{s} (19{k}) and {s} (20{k})|Figure {k} shows {c} {c}|http://{l}.org/{q}/{z}|record {z}{k}|IMPORTANT NOTICE|DATA {U}|SEE {U} BELOW|{c}. {c} {l} {l}|ISBN 978-{k}-{h}-{z}"
).split("|")


def _name(r: random.Random) -> str:
    given = r.choice(GIVEN) if r.random() < 0.7 else _word(r)
    surname = r.choice(SURNAMES) if r.random() < 0.5 else _word(r)
    if r.random() < 0.1:
        surname += "-" + (r.choice(SURNAMES) if r.random() < 0.5 else _word(r))
    if r.random() < 0.12:
        surname = f"{r.choice(PARTS)} {surname}"
    letter = lambda: r.choice("ABCDEFGHIJKLMNOPRSTVW") + "."
    form = r.random()
    first = given if form < 0.55 else f"{given} {letter()}" if form < 0.75 else letter() if form < 0.85 else f"{letter()} {letter()}" if form < 0.92 else f"{given} {r.choice(GIVEN)}"
    whole = f"{first} {surname}"
    whole = whole.upper() if form < 0.08 else whole
    return whole.replace(" ", "~", 1) if r.random() < 0.08 else whole


def _pattern(r: random.Random, form: str) -> str:
    """``#`` a digit, ``@`` a capital."""
    return "".join(r.choice("0123456789") if c == "#" else r.choice("ABCDEFGHJKLMNPRSTUVWXY") if c == "@" else c for c in form)


def _email(r: random.Random) -> str:
    user = r.choice(["{a}.{b}", "{a}", "{a}{b}", "{x}{b}", "{b}_{a}", "{a}-{b}", "{b}{d}"]).format(a=_word(r).lower(), b=_word(r).lower(), x=r.choice("abcdejklmprst"), d=r.randint(1, 99))
    host = [r.choice(["{w}", "{w}-{w}", "{d}{w}", "mail", "cs"]).format(w=_word(r).lower(), d=r.randint(1, 99)), *([_word(r).lower()] if r.random() < 0.4 else []), r.choice("com org edu net de fr uk io example test".split())]
    at, dot = r.choice([("@", "."), ("@", "."), ("@", "."), (" at ", " dot "), (" AT ", " DOT "), ("(at)", "(dot)"), (" [at] ", " [dot] "), (" AT ", "."), ("\\@", ".")])
    return user + at + dot.join(host)


def _phone(r: random.Random) -> str:
    return _pattern(r, r.choice("### ####|###-####|(###) ###-####|+## ## #### ####|+# ### ### ####|0## ### ####|(0##) #### ####|0#### ######|+##-##-###-####|## ## ## ## ##|###.###.####|+## (0)## ### ## ##|1-###-###-####|+###-##-#######".split("|")))


def _id(r: random.Random) -> str:
    return _pattern(r, r.choice("###-##-####|@#######|@@#######|####-####-####-####|0000-000#-####-###@|########|#####|#######|@@ ## ## ## @|@@######@|########@|######-####|#### #### #### ####|@##@##@##|##.##.##-###.##|@-######|###### ####".split("|")))


def _filled(form: str, values: dict[str, Callable[[], object]]) -> str:
    """The form with a new value for every name in braces."""
    return re.sub(r"\{(\w+)\}", lambda m: str(values[m.group(1)]()), form)


def _digits(r: random.Random) -> dict[str, Callable[[], object]]:
    return {name: lambda form=form: _pattern(r, form) for name, form in (("k", "##"), ("h", "###"), ("q", "####"), ("z", "#####"), ("L", "@"), ("st", "@@"), ("ca", "@#@ #@#"))}


def _address(r: random.Random) -> str:
    own = {
        "n": lambda: r.choice([r.randint(1, 99), r.randint(1, 2400)]), "w": lambda: r.choice([_word(r), r.choice(SURNAMES)]), "t": lambda: r.choice(TOWNS) if r.random() < 0.6 else _word(r),
        "uk": lambda: _pattern(r, r.choice(["@@# #@@", "@# #@@", "@@## #@@", "@@#@ #@@"])),
    }
    return _filled(r.choice(ADDRESSES), _digits(r) | own)


def _nothing(r: random.Random) -> str:
    own = {"s": lambda: r.choice([r.choice(SURNAMES), _word(r)]), "t": lambda: r.choice(TOWNS), "c": lambda: _word(r), "l": lambda: _word(r).lower(), "U": lambda: _word(r).upper()}
    return _filled(r.choice(NOTHING), _digits(r) | own)


_MAKERS = {"n": ("person_name", _name), "e": ("email", _email), "p": ("phone", _phone), "i": ("id_number", _id), "a": ("street_address", _address)}
_KINDS = (NAME_IN, NAME_IN, EMAIL_IN, PHONE_IN, ID_IN, PLACE_IN)


def made_sentence(r: random.Random) -> tuple[str, list[tuple[int, int, str]]]:
    """A sentence and its spans (begin, end, kind)."""
    if r.random() < 0.45:
        return _nothing(r), []
    form = r.choice(r.choice(_KINDS)).replace("{{", "\0").replace("}}", "\1")
    out, spans, at = "", [], 0
    while (found := form.find("{", at)) >= 0:
        kind, make = _MAKERS[form[found + 1]]
        out += form[at:found]
        value = make(r)
        spans.append((len(out), len(out) + len(value), kind))
        out += value
        at = found + 3
    return (out + form[at:]).replace("\0", "{").replace("\1", "}"), spans


def made_text(r: random.Random, sentences: int = 3) -> tuple[str, list[tuple[int, int, str]]]:
    """Several sentences in a row, with blanks or line breaks between them."""
    text, spans = "", []
    for _ in range(sentences):
        some, found = made_sentence(r)
        spans += [(a + len(text), b + len(text), kind) for a, b, kind in found]
        text += some + r.choice([" ", " ", "\n", ". ", "; ", ", "])
    return text, spans
