"""Licence scans by template-markup matching.

A template is licence wording with optional and replaceable regions marked in it. It
is compiled into a token automaton: a word is a step, an optional region is a way
around, a replaceable region a chain of steps that any word takes, as long as the
region may get. All templates share one automaton, whose sets of states are
determinised as texts reach them. A text is run through it from each word that a
template can begin with; an accepted run is a place whose mandatory wording matches
exactly, word by word. Of a template's runs the longest from each start counts; of
all accepted runs those that lie inside a longer one are dropped, so a licence named
within another's wording isn't reported for it. The base phrases are templates
without regions in the same automaton, and all their places count.

Words are cut from the UTF-8 bytes: runs of letters, digits and bytes from 0x80 on, A
to Z in lower case. Nothing is shuffled; a text is read whole by one task, in one
pass, and its accepted places are its output.

Defined cases: a null or empty text has no words, no places and score 0; a text of any
length is read whole; repeated rows and ids are scanned each; places of equal length
keep every label (ties of one label count once); other columns are not read, whatever
their names; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ravelin.llm.license_templates import BASE, TEMPLATES

_MARKUP = re.compile(r"<<(beginOptional|endOptional|var)(?:;match=(\d+))?>>")
_WORDS = re.compile(rb"[0-9a-z\x80-\xff]+")
#: Sets of states that a worker keeps; more are forgotten and made anew.
KEPT_SETS = 50_000


def words(text: bytes) -> list[bytes]:
    """The words of a text, A to Z in lower case; other letters stay as they are."""
    return _WORDS.findall(text.lower())


class Automaton:
    """Templates as one automaton over words. templates: (name, wording) in any number;
    accepted runs are told by the template's number."""

    def __init__(self, templates: Sequence[tuple[str, str]]):
        self.step: list[dict[bytes, int]] = []  # a state's step by word
        self.any: list[int] = []  # its step by any word, or -1
        self.free: list[list[int]] = []  # states that it reaches without a word
        self.end: list[int] = []  # the template that ends here, or -1
        self.fixed: list[int] = []  # mandatory words of each template
        root = self._state()
        for number, (name, wording) in enumerate(templates):
            first = self._state()
            self.free[root].append(first)
            last, fixed = self._compile(name, wording, first)
            self.end[last] = number
            self.fixed.append(fixed)
        self.start = self._closed([root])
        self.starts = frozenset(w for s in self.start for w in self.step[s])
        if any(self.any[s] >= 0 for s in self.start):
            raise ValueError("a template must begin with a word")
        if any(self.end[s] >= 0 for s in self.start):
            raise ValueError("a template without mandatory words accepts everything")
        self._forget()

    def _state(self) -> int:
        self.step.append({})
        self.any.append(-1)
        self.free.append([])
        self.end.append(-1)
        return len(self.step) - 1

    def _compile(self, name: str, wording: str, at: int) -> tuple[int, int]:
        """Adds a template's states after `at`: (last state, mandatory words)."""
        opened: list[int] = []
        fixed = 0
        pieces = _MARKUP.split(wording)
        for i in range(0, len(pieces), 3):
            for word in words(pieces[i].encode()):
                new = self._state()
                self.step[at][word] = new
                at = new
                fixed += not opened
            kind, most = pieces[i + 1 : i + 3] or (None, None)
            if kind == "beginOptional":
                opened.append(at)
                new = self._state()  # a state of its own, so that ways around don't mix
                self.free[at].append(new)
                at = new
            elif kind == "endOptional":
                if not opened:
                    raise ValueError(f"{name}: a region ends that did not begin")
                new = self._state()
                self.free[at].append(new)
                self.free[opened.pop()].append(new)
                at = new
            elif kind == "var":
                out = self._state()
                for _ in range(int(most or 1)):
                    new = self._state()
                    self.free[at].append(out)
                    self.any[at] = new
                    at = new
                self.free[at].append(out)
                at = out
        if opened:
            raise ValueError(f"{name}: a region does not end")
        return at, fixed

    def _closed(self, states: Sequence[int]) -> frozenset[int]:
        seen, todo = set(states), list(states)
        while todo:
            for s in self.free[todo.pop()]:
                if s not in seen:
                    seen.add(s)
                    todo.append(s)
        return frozenset(seen)

    def _forget(self) -> None:
        self.number: dict[frozenset[int], int] = {}
        self.sets: list[frozenset[int]] = []
        self.moves: list[dict[bytes, int]] = []  # by set: word -> set, -1 where none is left
        self.other: list[int | None] = []  # by set: where words go that no step names
        self.ends: list[tuple[int, ...]] = []
        self._numbered(self.start)

    def _numbered(self, states: frozenset[int]) -> int:
        if not states:
            return -1
        if states not in self.number:
            self.number[states] = len(self.sets)
            self.sets.append(states)
            self.moves.append({})
            self.other.append(None)
            self.ends.append(tuple(sorted(self.end[s] for s in states if self.end[s] >= 0)))
        return self.number[states]

    def _move(self, at: int, word: bytes) -> int:
        states = self.sets[at]
        named = [self.step[s][word] for s in states if word in self.step[s]]
        anyhow = [self.any[s] for s in states if self.any[s] >= 0]
        to = self._numbered(self._closed([*named, *anyhow]))
        if named:
            self.moves[at][word] = to
        else:
            self.other[at] = to
        return to

    def run(self, text: list[bytes], at: int) -> dict[int, int]:
        """Template -> end (exclusive) of its longest accepted run from a word on."""
        found: dict[int, int] = {}
        now, n = 0, len(text)
        while at < n:
            word = text[at]
            to = self.moves[now].get(word)
            if to is None:
                # words that no step names share one way out of a set of states
                to = self.other[now] if self.other[now] is not None and not any(word in self.step[s] for s in self.sets[now]) else self._move(now, word)
            if to < 0:
                break
            at, now = at + 1, to
            for template in self.ends[now]:
                found[template] = at
        if len(self.sets) > KEPT_SETS:
            self._forget()
        return found

    def places(self, text: list[bytes]) -> list[tuple[int, int, int]]:
        """(template, start, end) of the longest accepted run from every start."""
        starts = self.starts
        return [(t, i, e) for i in [i for i, w in enumerate(text) if w in starts] for t, e in self.run(text, i).items()]


def outermost(places: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """The places that lie in no longer one."""
    out: list[tuple[int, int, int]] = []
    reach = (-1, -1)
    for t, s, e in sorted(places, key=lambda p: (p[1], -p[2], p[0])):
        if e > reach[1] or (s, e) == reach:
            out.append((t, s, e))
            reach = (s, e)
    return out


_SPAN = pa.struct([("label", pa.string()), ("first", pa.int64()), ("last", pa.int64()), ("fixed", pa.int64()), ("base", pa.bool_())])


def _scan(base: Sequence[tuple[str, str]], templates: Sequence[tuple[str, str]]):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = Automaton([*base, *templates])
        labels = [label for label, _ in [*base, *templates]]
        n_base = len(base)
        for b in batches:
            counts, spans = [], []
            for text in b.column("text").cast(pa.binary()):
                found = words(text.as_py())
                counts.append(len(found))
                every = automaton.places(found)
                kept = [(p, True) for p in every if p[0] < n_base] + [(p, False) for p in outermost([p for p in every if p[0] >= n_base])]
                spans.append([{"label": labels[t], "first": s, "last": e - 1, "fixed": automaton.fixed[t], "base": is_base} for (t, s, e), is_base in kept])
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(counts, pa.int64()), pa.array(spans, pa.list_(_SPAN))], names=["doc_id", "n_words", "places"])

    return scan


def license_places(docs: DataFrame, base: Sequence[tuple[str, str]] = BASE, templates: Sequence[tuple[str, str]] = TEMPLATES) -> DataFrame:
    """(doc_id, n_words, places) of every row of docs (doc_id, text): places are
    (label, first and last word, mandatory words, base) in no order; base tells the
    phrases of `base`, all of whose places are there, from the templates' places."""
    thin = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    Automaton([*base, *templates])  # a fault in a template is told here
    return thin.mapInArrow(_scan(tuple(base), tuple(templates)), "doc_id long, n_words long, places array<struct<label:string,first:long,last:long,fixed:long,base:boolean>>")


def _labels(places: Column) -> Column:
    return F.array_join(F.array_sort(F.array_distinct(F.transform(places, lambda p: p["label"]))), ",")


def license_query(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score of
    every row. score: 1 minus the product, over the labels, of 4 / (4 + mandatory words
    of the label's fullest place): a phrase of four words makes 0.5, a whole licence
    nearly 1."""
    base = F.filter("places", lambda p: p["base"])
    starts = F.transform(base, lambda p: p["first"])
    names = F.array_distinct(F.transform("places", lambda p: p["label"]))

    def fullest(label: Column) -> Column:
        return F.array_max(F.transform(F.filter("places", lambda p: p["label"] == label), lambda p: p["fixed"]))

    left = F.aggregate(F.array_sort(names), F.lit(1.0), lambda a, label: a * (F.lit(4.0) / (fullest(label) + F.lit(4.0))))
    return license_places(docs).select(
        "doc_id",
        "n_words",
        F.size(base).cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"),
        _labels(base).alias("base_labels"),
        _labels(F.col("places")).alias("labels"),
        (F.lit(1.0) - left).alias("score"),
    )
