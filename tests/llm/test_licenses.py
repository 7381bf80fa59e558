"""Licence places against regular expressions that are tried on every stretch of words."""

import random
import re

import pytest

from ravelin.llm import license_scan as ls
from ravelin.llm.license_templates import BASE, TEMPLATES
from tests.llm.helpers import documents, rows

WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SMALL = (
    ("a", "red <<beginOptional>> green <<beginOptional>> blue <<endOptional>> <<endOptional>> stop"),
    ("b", "<<beginOptional>> red <<endOptional>> green <<var;match=3>> stop"),
    ("c", "green blue"),
    ("a", "blue blue <<var;match=2>>"),
)


def words(text):
    return WORDS.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def pattern(wording):
    """A template as a regular expression over words that each end in a space."""
    out = ""
    for i, piece in enumerate(re.split(r"<<(.*?)>>", wording)):
        if i % 2 == 0:
            out += "".join(re.escape(w) + " " for w in words(piece))
        elif piece.startswith("var"):
            out += r"(?:\S+ ){0,%s}" % piece.split("=")[1]
        else:
            out += "(?:" if piece == "beginOptional" else ")?"
    return re.compile(out)


def longest(text, templates):
    """(template, start, end) by trying every stretch."""
    every = []
    for t, (_, wording) in enumerate(templates):
        p = pattern(wording)
        for s in range(len(text)):
            ends = [e for e in range(s + 1, len(text) + 1) if p.fullmatch("".join(w + " " for w in text[s:e]))]
            every += [(t, s, ends[-1])] if ends else []
    return sorted(every)


def test_automaton_equals_tried_stretches():
    rng = random.Random(3)
    automaton = ls.Automaton(SMALL)
    for _ in range(300):
        text = rng.choices(["red", "green", "blue", "stop", "x"], k=rng.randint(0, 14))
        got = sorted(automaton.places([w.encode() for w in text]))
        assert got == longest(text, SMALL)
        kept = ls.outermost(got)
        assert set(kept) == {p for p in got if not any(q[1] <= p[1] and p[2] <= q[2] and q[1:] != p[1:] for q in got)}


def test_small_memory_gives_the_same(monkeypatch):
    text = ("red green x y stop blue blue z " * 40).split()
    want = sorted(ls.Automaton(SMALL).places([w.encode() for w in text]))
    monkeypatch.setattr(ls, "KEPT_SETS", 2)
    assert sorted(ls.Automaton(SMALL).places([w.encode() for w in text])) == want


def test_faults_in_templates_are_told():
    for wording in ("<<beginOptional>> a", "a <<endOptional>>", "<<var;match=2>> a", "<<beginOptional>> a <<endOptional>>"):
        with pytest.raises(ValueError):
            ls.Automaton([("x", wording)])


def plain(wording, rng):
    """A text that a template accepts: optional regions kept or left, others filled."""
    out, keep = [], [True]
    for i, piece in enumerate(re.split(r"<<(.*?)>>", wording)):
        if i % 2 == 0:
            out += [piece] if keep[-1] else []
        elif piece == "beginOptional":
            keep.append(keep[-1] and rng.random() < 0.5)
        elif piece == "endOptional":
            keep.pop()
        elif keep[-1]:
            out.append(" ".join(rng.choices(["Jane", "Ünal", "2024", "Corp"], k=rng.randint(0, int(piece.split("=")[1])))))
    return " ".join(out)


def test_every_template_accepts_its_wording_and_no_change_of_it(spark):
    rng = random.Random(5)
    texts, labels = [], []
    for label, wording in TEMPLATES:
        for _ in range(4):
            texts.append(f"Lorem ipsum; {plain(wording, rng)}. dolor sit")
            labels.append(label)
    got = {r["doc_id"]: r for r in ls.license_query(documents(spark, texts)).collect()}
    for i, label in enumerate(labels):
        assert label in got[i]["labels"].split(","), texts[i]
        assert 0 < got[i]["score"] < 1
    mandatory = [(label, w) for label, w in TEMPLATES if len(words(re.sub(r"<<.*?>>", " ", w))) > 60]
    changed = []
    for _, wording in mandatory:
        w = words(re.sub(r"<<beginOptional>>.*?<<endOptional>>|<<.*?>>", " ", re.sub(r"<<beginOptional>>[^<]*<<beginOptional>>.*?<<endOptional>>.*?<<endOptional>>", " ", wording)))
        w[len(w) // 2] = "otherwise-not"
        changed.append(" ".join(w))
    assert all(r["labels"] == "" for r in ls.license_query(documents(spark, changed)).collect() if "version" not in changed[r["doc_id"]])


def base(text):
    w = words(text)
    return sorted((label, i) for label, phrase in BASE for i in range(len(w)) if w[i : i + len(phrase.split())] == phrase.split())


def test_query_and_defined_cases(spark):
    texts = [
        None, "", " .,; ", "Released under the MIT License.", "UNDER the MİT license", "under the mit license under the MIT\n\nLicense; apache license, version 2.0", "CC BY-NC 4.0, cc-by nc",
        "This work is licensed under the GNU General Public License, version 3.", "Licensed under CC BY-NC 4.0.", "the apache license version", "ÀPACHE license version 2", "a\x00under\x7fthe mit license",
        "lorem ipsum " * 100_000 + "under the MIT license", "Released under the MIT License.", "x" * 300_000,
    ]
    df = documents(spark, texts, extra=True).withColumnRenamed("score", "places")
    got = {r["doc_id"]: r for r in ls.license_query(df).collect()}
    assert len(got) == len(texts)
    for i, text in enumerate(texts):
        r, want = got[i], base(text)
        assert r["n_words"] == len(words(text)) and r["n_base"] == len(want)
        assert (r["first_word"], r["last_word"]) == ((min(s for _, s in want), max(s for _, s in want)) if want else (None, None))
        assert r["base_labels"] == ",".join(sorted({label for label, _ in want}))
        assert set(r["base_labels"].split(",")) - {""} <= set(r["labels"].split(","))
        assert (r["score"] > 0) == (r["labels"] != "") and 0 <= r["score"] <= 1
        if len(words(text)) < 60:
            every = {TEMPLATES[t][0] for t, s, e in ls.outermost(longest(words(text), TEMPLATES))} | {label for label, _ in want}
            assert r["labels"] == ",".join(sorted(every))
    assert got[7]["labels"] == "gpl-3" and got[8]["labels"] == "cc-by-nc" and got[3]["labels"] == got[13]["labels"] == "mit"
    again = ls.license_query(documents(spark, texts).repartition(5))
    assert rows(again, *again.columns) == rows(ls.license_query(df), *again.columns)
    assert ls.license_query(df.limit(0)).count() == 0
