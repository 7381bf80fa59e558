"""Benchmark decontamination: BM25 with block-max WAND over test items.

The items are indexed, not the corpus: each term's impact on each item is its
BM25 weight divided by the item's own full score, so a passage's score for an
item is the share of the item's weight that the passage holds, and one threshold
serves all items. Document frequencies and the mean length are those of the whole
benchmark, however many parts it is indexed in. Items are dealt to classes by
length (each up to twice the last), and for each class every text is cut into
passages of twice a class's longest span that advance by one span, so each
occurrence lies whole in one. Every passage is a query. Skipping follows WAND: a
bound from the largest impact of each term, then one for each block of items, and
only the postings of blocks whose bound reaches the threshold are read. Bounds
never lie below a score, so all items above the threshold are retrieved. A hit is
verified in the spans of the item's own length (`SLACK` longer, for words put in):
one span must hold the threshold's share of the weight and enough of the
different words of the item's question (all sentences but the last) and of its
answer (the last sentence; for one sentence both are the whole), and `PAIRS` of the
item's pairs of adjacent words. What is returned
is thus a fact about text and item, not about passages, classes or parts.

Defined cases: null text has no passages, null or wordless items are not
indexed; repeated rows of a document count once; repeated items give a row for
each item_id; of equally good spans the first is told; very long texts are cut
into as many passages as they need; other columns of docs, whatever their names,
are left alone; an empty table on either side gives an empty result.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ravelin.llm.common import release, short_batches

K1, B = 1.2, 0.75
THRESHOLD = 0.6
OVERLAP = 0.8
BLOCK_ITEMS = 16
#: How much longer than the item a span may be.
SLACK = 0.25
#: The share of an item's different pairs of adjacent words that a span must hold:
#: long items and texts have most words in common by chance, but not their order.
PAIRS = 0.4
#: Items in one broadcast index; a larger benchmark is searched part by part.
MAX_ITEMS = 50_000
_WORDS = re.compile(r"\w+")
_SENTENCES = re.compile(r"[.!?\n]+")
#: Words that are looked at in one go.
_CHUNK = 400_000


def words(text: str | None) -> list[str]:
    return _WORDS.findall((text or "").lower())


def halves(text: str) -> tuple[set[str], set[str]]:
    """The different words of question and answer."""
    parts = [w for w in (words(s) for s in _SENTENCES.split(text)) if w]
    if len(parts) < 2:
        return set(words(text)), set(words(text))
    return {w for p in parts[:-1] for w in p}, set(parts[-1])


class Facts:
    """What BM25 needs to know of all items of a benchmark."""

    def __init__(self) -> None:
        self.n, self.total, self.df = 0, 0, Counter()

    def add(self, items: list[tuple[int, str]]) -> Facts:
        for _, text in items:
            if w := words(text):
                self.n, self.total = self.n + 1, self.total + len(w)
                self.df.update(set(w))
        return self


def span_of(size: int) -> int:
    """Words of the spans in which an item of size words is looked for."""
    return size + math.ceil(size * SLACK)


def enough(words_: int, overlap: float = OVERLAP) -> int:
    """How many of so many different words must be there: rounded down, one at least."""
    return max(1, math.floor(overlap * words_))


class Index:
    """Impacts of terms on items of one benchmark, with bounds for all items and
    for blocks. facts: of the whole benchmark, if these items are a part of it."""

    def __init__(self, items: list[tuple[int, str]], facts: Facts | None = None):
        facts = facts or Facts().add(items)
        items = [(i, t) for i, t in items if words(t)]
        items.sort(key=lambda x: (len(words(x[1])).bit_length(), x[0] is None, x[0], x[1]))  # a class of lengths is a range
        self.ids = [i for i, _ in items]
        counts = [Counter(words(t)) for _, t in items]
        n = len(items)
        self.terms = {w: k for k, w in enumerate(sorted({w for c in counts for w in c}))}
        size = np.array([sum(c.values()) for c in counts], float)
        self.spans = [span_of(int(x)) for x in size]
        #: For each class of lengths its longest span and its items' first and last place.
        kind = np.array([int(x).bit_length() for x in size], np.int64)
        self.classes = [(max(self.spans[a:b]), a, b) for k in np.unique(kind).tolist() for a, b in [(int(np.searchsorted(kind, k)), int(np.searchsorted(kind, k, "right")))]]
        all_n, df, mean = facts.n, facts.df, facts.total / max(1, facts.n)
        rows, cols, vals = [], [], []
        for i, c in enumerate(counts):
            w = {t: np.log(1 + (all_n - df[t] + 0.5) / (df[t] + 0.5)) * f * (K1 + 1) / (f + K1 * (1 - B + B * size[i] / mean)) for t, f in c.items()}
            own = sum(w.values())
            for t, x in w.items():
                rows.append(self.terms[t])
                cols.append(i)
                vals.append(x / own)
        order = np.lexsort((cols, rows)) if rows else np.zeros(0, int)
        self.row = np.array(rows, np.int64)[order]
        self.item, self.impact = np.array(cols, np.int64)[order], np.array(vals, np.float64)[order]
        self.start = np.searchsorted(self.row, np.arange(len(self.terms) + 1))
        # Blocks are ranges of places and never hold items of two classes.
        block = np.zeros(n, np.int64)
        at = 0
        for _, first, end in self.classes:
            block[first:end] = at + np.arange(end - first) // BLOCK_ITEMS
            at = int(block[end - 1]) + 1
        self.blocks = at
        self.class_blocks = [(int(block[first]), int(block[end - 1]) + 1) for _, first, end in self.classes]
        # Postings lie by term, block and item; an entry is a term's run in a block.
        entry = self.row * max(1, at) + block[self.item] if n else self.row
        self.entry_key, self.entry_start = np.unique(entry, return_index=True)
        self.entry_max = np.maximum.reduceat(self.impact, self.entry_start) if n else np.zeros(0)
        self.entry_start = np.append(self.entry_start, len(entry))
        # The largest impact of each term on the items of each class; the last term is for words of no item.
        self.bounds = np.zeros((len(self.classes), len(self.terms) + 1))
        for k, (lo, hi) in enumerate(self.class_blocks):
            mine = (block[self.item] >= lo) & (block[self.item] < hi)
            np.maximum.at(self.bounds[k], self.row[mine], self.impact[mine])
        parts = [halves(t) for _, t in items]
        self.held = [{self.terms[w]: 0.0 for w in c} for c in counts]
        for r, c, v in zip(self.row.tolist(), self.item.tolist(), self.impact.tolist(), strict=True):
            self.held[c][r] = v
        order = [[self.terms[w] for w in words(t)] for _, t in items]
        self.pairs = [set(zip(o, o[1:], strict=False)) for o in order]
        self.question = [{self.terms[w] for w in q} for q, _ in parts]
        self.answer = [{self.terms[w] for w in a} for _, a in parts]

    def search(self, tok: np.ndarray, lo: np.ndarray, hi: np.ndarray, threshold: float, kind: int) -> list[tuple[int, int, float]]:
        """(passage, item, score) of all pairs at or above the threshold with items
        of one class; passages are tok[lo:hi], term numbers with len(terms) for
        other words."""
        eps = 1e-9
        bound, none = self.bounds[kind], len(self.terms)
        cum = np.concatenate(([0.0], np.cumsum(bound[tok])))
        alive = np.flatnonzero(cum[hi] - cum[lo] >= threshold - 1e-6)
        if not len(alive):
            return []
        n = hi[alive] - lo[alive]
        who = np.repeat(np.arange(len(alive)), n)
        term = tok[_ranges(lo[alive], n)]
        real = bound[term] > 0
        pair = np.unique(who[real] * (none + 1) + term[real])  # a passage's different terms
        who, term = pair // (none + 1), pair % (none + 1)
        full = np.bincount(who, bound[term], minlength=len(alive)) >= threshold - eps
        keep = full[who]
        who, term = who[keep], term[keep]
        if not len(who):
            return []
        first, end = self.class_blocks[kind]
        a = np.searchsorted(self.entry_key, term * self.blocks + first)
        many = np.searchsorted(self.entry_key, term * self.blocks + end) - a
        entry, whose = _ranges(a, many), np.repeat(who, many)
        cell, where = np.unique(whose * self.blocks + self.entry_key[entry] % self.blocks, return_inverse=True)
        passing = (np.bincount(where, self.entry_max[entry]) >= threshold - eps)[where]
        entry, whose = entry[passing], whose[passing]
        many = self.entry_start[entry + 1] - self.entry_start[entry]
        at, whose = _ranges(self.entry_start[entry], many), np.repeat(whose, many)
        if not len(at):
            return []
        cell, where = np.unique(whose * len(self.ids) + self.item[at], return_inverse=True)
        score = np.bincount(where, self.impact[at])
        good = score >= threshold - eps
        return [(int(alive[c // len(self.ids)]), c % len(self.ids), s) for c, s in zip(cell[good].tolist(), score[good].tolist(), strict=True)]

    def verify(self, tok: list[int], item: int, threshold: float, overlap: float) -> tuple[float, float, float] | None:
        """Score and shares of question and answer of the best span of tok that
        holds enough of an item; None if none does."""
        held, q, a = self.held[item], self.question[item], self.answer[item]
        at = [(p, t) for p, t in enumerate(tok) if t in held]
        count: dict[int, int] = {}
        score, nq, na, first, best = 0.0, 0, 0, 0, None
        for p, t in at:
            if not count.get(t):
                score, nq, na = score + held[t], nq + (t in q), na + (t in a)
            count[t] = count.get(t, 0) + 1
            while p - at[first][0] >= self.spans[item]:
                old = at[first][1]
                first += 1
                count[old] -= 1
                if not count[old]:
                    score, nq, na = score - held[old], nq - (old in q), na - (old in a)
            if score >= threshold - 1e-9 and nq >= enough(len(q), overlap) and na >= enough(len(a), overlap) and (best is None or score > best[0] + 1e-9):
                span = tok[max(0, p - self.spans[item] + 1) : p + 1]
                if len(self.pairs[item].intersection(zip(span, span[1:], strict=False))) >= PAIRS * len(self.pairs[item]):
                    best = (score, nq / len(q), na / len(a))
        return best

    def leaks(self, texts: list, threshold: float = THRESHOLD, overlap: float = OVERLAP) -> list[list[tuple]]:
        """For each text (item_id, score, question share, answer share) of its items."""
        out: list[list[tuple]] = [[] for _ in texts]
        if not self.ids:
            return out
        get, other = self.terms.get, len(self.terms)
        at = 0
        while at < len(texts):
            toks, owner, start, total = [], [], [], 0
            while at < len(texts) and total < _CHUNK:
                w = words(texts[at])
                toks.append(np.fromiter((get(x, other) for x in w), np.int64, len(w)))
                owner.append(at)
                start.append(total)
                total += len(w)
                at += 1
            tok, begin = np.concatenate(toks), np.array(start)
            size = np.diff(np.append(begin, total))
            best: dict[tuple[int, int], tuple] = {}
            for kind, (span, _, _) in enumerate(self.classes):
                many = np.where(size > 0, np.maximum(1, -(-(size - span) // span)), 0)
                doc = np.repeat(np.arange(len(size)), many)
                lo = begin[doc] + _ranges(np.zeros(len(many), np.int64), many) * span
                hi = np.minimum(lo + 2 * span, begin[doc] + size[doc])
                for p, item, _ in self.search(tok, lo, hi, threshold, kind):
                    key = (owner[doc[p]], item)
                    found = self.verify(tok[lo[p] : hi[p]].tolist(), item, threshold, overlap)
                    if found and (key not in best or found[0] > best[key][1] + 1e-9):
                        best[key] = (self.ids[item], *found)
            for (i, _), (item_id, score, q, a) in sorted(best.items(), key=lambda x: (x[0][0], x[1][0] is None, x[1][0])):
                out[i].append((item_id, min(score, 1.0), q, a))
        return out


def _ranges(start: np.ndarray, many: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1, ... (many[0] numbers), then those of start[1], and so on."""
    return np.repeat(start - (np.cumsum(many) - many), many) + np.arange(int(many.sum()))


_TYPE = "array<struct<item_id:bigint,score:double,question:double,answer:double>>"


def leaks_column(index: Index, text: Column, spark) -> Column:
    """The items that a text leaks, as a column; the index goes out by broadcast."""
    short_batches(spark)
    sent = spark.sparkContext.broadcast(index)

    def found(t: pd.Series) -> pd.Series:
        out = pd.Series([[dict(zip(("item_id", "score", "question", "answer"), hit, strict=True)) for hit in hits] for hits in sent.value.leaks(t.tolist())])
        release()
        return out

    return F.pandas_udf(found, _TYPE)(text.cast("string"))


def indexes(benchmark: DataFrame, max_items: int = MAX_ITEMS) -> Iterator[Index]:
    """Indexes of the benchmark one after another, of about max_items items each at
    most. Runs jobs; the driver holds one part, and the counts of all terms."""
    rows = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).distinct()
    parts = -(-rows.count() // max_items)

    def part(i: int) -> list[tuple[int, str]]:
        return [tuple(r) for r in rows.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == i).collect()]

    facts = Facts()
    if parts == 1:
        yield Index(part(0))
        return
    for i in range(parts):
        facts.add(part(i))
    for i in range(parts):
        yield Index(part(i), facts)


def leaks(docs: DataFrame, benchmark: DataFrame, max_items: int = MAX_ITEMS) -> DataFrame:
    """(doc_id, item_id, score, question_overlap, answer_overlap), a row for each
    item that a document holds. Runs jobs to build the index."""
    out = None
    for index in indexes(benchmark, max_items):
        hits = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.explode(leaks_column(index, F.col("text"), docs.sparkSession)).alias("hit"))
        hits = hits.select("doc_id", "hit.item_id", "hit.score", F.col("hit.question").alias("question_overlap"), F.col("hit.answer").alias("answer_overlap"))
        out = hits if out is None else out.unionAll(hits)
    if out is None:
        return docs.sparkSession.createDataFrame([], "doc_id long, item_id long, score double, question_overlap double, answer_overlap double")
    return out.groupBy("doc_id", "item_id").agg(*[F.max(c).alias(c) for c in ("score", "question_overlap", "answer_overlap")])


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs without the rows that leak an item. Runs jobs to build the index."""
    for index in indexes(benchmark):
        docs = docs.filter(F.size(leaks_column(index, F.col("text"), docs.sparkSession)) == 0)
    return docs
