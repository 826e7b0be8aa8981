"""Licence notices, identifier tags and licence expressions in whole texts.

An Aho-Corasick automaton over the folded words finds notice phrases and identifier tags in one pass. What follows a tag is a licence expression;
a shunting-yard parser brings and/or/with into postfix order, from which its labels and its grade are computed. Nulls and empty texts have no
words, no labels and score 0.
"""

from __future__ import annotations

import re
from functools import lru_cache

import ahocorasick
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tellerlake.llm.common import folded_words, map_texts

#: Phrases and labels of the contract.
BASE = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
#: Further notices.
NOTICES = {
    "gnu general public license version 2": "gpl-2", "gnu general public license version 3": "gpl-3", "gnu lesser general public license": "lgpl", "gnu affero general public license": "agpl",
    "mozilla public license": "mpl", "bsd 2 clause": "bsd-2-clause", "bsd 3 clause": "bsd-3-clause", "cc by sa": "cc-by-sa", "cc by nd": "cc-by-nd", "cc0": "cc0", "released into the public domain": "public-domain",
    "the mit license": "mit", "all rights reserved": "all-rights-reserved",
}
TAG = "spdx license identifier"
TAG_TEXT = re.compile(r"spdx-license-identifier[ \t]*:", re.IGNORECASE)
ATOM = re.compile(r"[ \t]*(\(|\)|[A-Za-z0-9.+:-]+)")
#: How freely a labelled text may be used; labels that are not listed grade 0.
GRADES = {"mit": 1.0, "apache-2": 1.0, "bsd-2-clause": 1.0, "bsd-3-clause": 1.0, "isc": 1.0, "cc0": 1.0, "public-domain": 1.0, "cc-by": 0.9, "cc-by-sa": 0.7, "mpl": 0.6, "lgpl": 0.6, "gpl-2": 0.4, "gpl-3": 0.4, "agpl": 0.3, "cc-by-nd": 0.2, "cc-by-nc": 0.2}
BINDING = {"or": 1, "and": 2, "with": 3}


def label_of(identifier: str) -> str:
    """The label of an identifier: versions and endings that do not change the licence's family go."""
    name = re.sub(r"-(only|or-later)$|\+$", "", identifier.lower())
    name = re.sub(r"^((?:cc-by|cc0)[a-z-]*)-[0-9.]+$", r"\1", name)
    name = re.sub(r"^(apache|a?gpl|lgpl|mpl)-([0-9]+)(\.[0-9]+)?$", r"\1-\2", name)
    return {"agpl-3": "agpl", "lgpl-2": "lgpl", "lgpl-3": "lgpl", "mpl-1": "mpl", "mpl-2": "mpl"}.get(name, name)


def postfix(text: str, at: int) -> list[str]:
    """Shunting-yard: the expression that begins at a place, in postfix order. It ends where its grammar does; an open bracket closes there."""
    out: list[str] = []
    held: list[str] = []
    operand = False
    while m := ATOM.match(text, at):
        atom = m[1]
        low = atom.lower()
        if operand and low in BINDING:
            while held and held[-1] != "(" and BINDING[held[-1]] >= BINDING[low]:
                out.append(held.pop())
            held.append(low)
            operand = False
        elif operand and atom == ")" and "(" in held:
            while (top := held.pop()) != "(":
                out.append(top)
        elif not operand and atom == "(":
            held.append("(")
        elif not operand and atom not in "()" and low not in BINDING:
            out.append(label_of(atom))
            operand = True
        else:
            break
        at = m.end()
    held = [x for x in held if x != "("]
    if not operand and held:
        held.pop()  # nothing follows the last operator
    return out + held[::-1]


def evaluate(expression: list[str]) -> tuple[set[str], float]:
    """Labels and grade: `or` leaves the choice of the freer side, `and` binds to the stricter one, `with` names an exception that frees a little."""
    held: list[tuple[set[str], float]] = []
    for x in expression:
        if x not in BINDING:
            held.append(({x}, GRADES.get(x, 0.0)))
            continue
        if len(held) < 2:
            continue
        (right, b), (left, a) = held.pop(), held.pop()
        if x == "with":
            held.append(({f"{min(left)}-with-{min(right)}"} | left, min(1.0, a + 0.1)))
        else:
            held.append((left | right, max(a, b) if x == "or" else min(a, b)))
    return (set().union(*(s for s, _ in held)), min(g for _, g in held)) if held else (set(), 0.0)


@lru_cache(maxsize=1)
def automaton() -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    for phrase in {**BASE, **NOTICES, TAG: ""}:
        a.add_word(f" {phrase} ", phrase)
    a.make_automaton()
    return a


def scan(text: bytes) -> dict:
    """Places, labels and score of one whole text."""
    words = folded_words(text)
    line = f" {b' '.join(words).decode('latin-1')} "
    places, base, labels, grades, tagged = [], set(), set(), [], False
    before, counted = 0, 0
    for last, phrase in automaton().iter(line):
        begin = last - len(phrase) - 1
        if phrase == TAG:
            tagged = True
            continue
        if phrase in BASE:
            if begin >= counted:
                before, counted = before + line.count(" ", counted, begin), begin
                places.append(before)
            else:  # a longer phrase that began earlier ended later
                places.append(line.count(" ", 0, begin))
            base.add(BASE[phrase])
        label = BASE.get(phrase) or NOTICES[phrase]
        labels.add(label)
        grades.append(GRADES.get(label, 0.0))
    if tagged:
        raw = text.decode()
        for m in TAG_TEXT.finditer(raw):
            found, grade = evaluate(postfix(raw, m.end()))
            if found:
                labels |= found
                grades.append(grade)
    return {
        "n_words": len(words), "n_base": len(places), "first_word": min(places, default=None), "last_word": max(places, default=None),
        "base_labels": ",".join(sorted(base)), "labels": ",".join(sorted(labels)), "score": min(grades, default=0.0),
    }


FIELDS = [
    T.StructField("n_words", T.LongType()), T.StructField("n_base", T.LongType()), T.StructField("first_word", T.LongType()), T.StructField("last_word", T.LongType()),
    T.StructField("base_labels", T.StringType()), T.StructField("labels", T.StringType()), T.StructField("score", T.DoubleType()),
]


def license_scan(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Kept columns and the scan of each whole text, a row for each row. `score` is the grade of the strictest notice, 0 without any."""

    def work(texts: list[bytes]) -> dict[str, list]:
        rows = [scan(t) for t in texts]
        return {f.name: [r[f.name] for r in rows] for f in FIELDS}

    return map_texts(docs, text, {c: c for c in keep}, FIELDS, work)
