"""Toxicity: a support vector machine with a gapped subsequence string kernel.

The kernel of two strings counts the three-letter subsequences that they share,
each weighted by DECAY to the length of both spans, and is normalised to 1 for
equal strings: letters put in between or left out cost some weight and no more.
Landmarks (at most `LANDMARKS` words) span a Nyström space; in it a linear
squared-hinge SVM is trained on labelled sentences as bags of words: of a toxic
document's sentences the words that tell the labels apart bear witness, of a clean
one's all words count, the hardest found anew each round. Because Nyström features are
linear in the subsequences, the decision folds into one table of weights, so a
word costs as many lookups as it has subsequences; it is the same number that
`ssk` gives landmark by landmark (tested). A document's margin is its most toxic
word's; a logistic curve fitted to training documents makes it a score.

Words are what Unicode white space divides, in the fit as in scoring.

Defined cases: null and empty texts have no words and score by the floor margin;
very long texts are scored whole and of those that are learnt from a window of
`MAX_FIT_CHARS` at a seeded place is; of equal margins no choice depends on order;
of documents that share a labelled id the text of the least hash is learnt from;
other columns, whatever their names, are not read; words above `SPAN` letters are read in overlapping windows; single letters apart
by spaces are also read joined; labels that repeat a doc_id count as toxic if
one of them is; without labels of both kinds every score is 0; an empty table
gives an empty result.
"""

from __future__ import annotations

import re
import unicodedata
import uuid
from collections import Counter
from functools import lru_cache
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ravelin.llm.common import held_out

DECAY = 0.6
LANDMARKS = 128
#: Bound of the labelled sample: so many documents of each label, in the order of
#: a hash of doc_id, and of longer ones MAX_FIT_CHARS characters at a seeded place.
MAX_EACH = 1200
MAX_FIT_CHARS = 20_000
SPAN, STRIDE = 16, 8
THRESHOLD = 0.5
FLOOR = -3.0
#: Words that a Python worker keeps the margin of.
KEPT_WORDS = 500_000
ROUNDS = 4
#: A letter group is a first witness if it is so many times as frequent in toxic
#: bags and its log likelihood ratio exceeds WORTH.
LIFT, WORTH = 20, 15.0
_GAP = 31
_LEET = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t"}
_MARKED = {"a": 26, "e": 27, "o": 28, "u": 29}
_CODES = 32**3
_SPACED = re.compile(r"(?<!\S)\S(?:[^\S\n]\S){2,}(?!\S)")


@lru_cache(maxsize=4096)
def _code(ch: str) -> int:
    """0 to 25 for plain Latin letters and the digits written for them, 26 to 29
    for a, e, o, u with marks, 30 for all other letters."""
    ch = _LEET.get(ch, ch)
    if "a" <= ch <= "z":
        return ord(ch) - 97
    base = unicodedata.normalize("NFKD", ch)[0].lower()
    if "a" <= base <= "z" and len(unicodedata.normalize("NFKD", ch)) == 1:
        return ord(base) - 97  # full-width and other forms of a plain letter
    return _MARKED.get(base, 30) if ch.isalpha() else _GAP


def codes(word: str) -> list[int]:
    """Character codes of a word without gaps at either end."""
    c = [_code(ch) for ch in word]
    while c and c[-1] == _GAP:
        c.pop()
    i = 0
    while i < len(c) and c[i] == _GAP:
        i += 1
    return c[i:]


def windows(word: str) -> list[tuple[int, ...]]:
    """The word's codes, in overlapping windows if there are more than SPAN."""
    c = codes(word)
    if len(c) <= SPAN:
        return [tuple(c)] if len(c) >= 3 else []
    return [tuple(c[i : i + SPAN]) for i in range(0, len(c) - SPAN + STRIDE, STRIDE)]


def ssk(s: tuple[int, ...], t: tuple[int, ...], decay: float = DECAY) -> float:
    """The kernel by its definition, not normalised: for tests and small sets."""

    def weights(x):
        out: Counter = Counter()
        for i, j, k in combinations(range(len(x)), 3):
            if _GAP not in (x[i], x[j], x[k]):
                out[x[i], x[j], x[k]] += decay ** (k - i + 1)
        return out

    a, b = weights(s), weights(t)
    return sum(v * b[u] for u, v in a.items() if u in b)


@lru_cache(maxsize=64)
def _triples(n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    i, j, k = np.array(list(combinations(range(n), 3)), np.int64).T
    return i, j, k, (k - i + 1).astype(np.int32)


_WEIGHT = np.array([0.0] + [DECAY**s for s in range(1, 32)])


def expand(strings: list[tuple[int, ...]]):
    """For groups of equally long strings: their places, the sorted
    (code * 32 + span) of every subsequence, and the kernel with themselves."""
    by: dict[int, list[int]] = {}
    for at, s in enumerate(strings):
        by.setdefault(len(s), []).append(at)
    for n, places in by.items():
        i, j, k, span = _triples(n)
        step = max(1, 400_000 // len(i))
        for lo in range(0, len(places), step):
            some = places[lo : lo + step]
            c = np.array([strings[p] for p in some], np.int32)
            a, b, d = c[:, i], c[:, j], c[:, k]
            real = (a != _GAP) & (b != _GAP) & (d != _GAP)
            key = (((a * 32 + b) * 32 + d) * 32 + np.where(real, span, 0)).astype(np.int32)
            key.sort(axis=1)
            w = _WEIGHT[key & 31]
            total = np.cumsum(w, axis=1)
            code = key >> 5
            last = np.ones(code.shape, bool)
            last[:, :-1] = code[:, 1:] != code[:, :-1]
            row, col = np.nonzero(last)
            upto = total[row, col]
            before = np.concatenate(([0.0], upto[:-1]))
            first = np.concatenate(([True], row[1:] != row[:-1])) if len(row) else np.zeros(0, bool)
            part = np.where(first, upto, upto - before)
            self_k = np.bincount(row, part * part, minlength=len(some))
            yield some, code, w, self_k


def features(strings: list[tuple[int, ...]]) -> np.ndarray:
    """Normalised weights of all subsequences, a row for each string (for few strings)."""
    out = np.zeros((len(strings), _CODES), np.float32)
    for some, code, w, self_k in expand(strings):
        for r, p in enumerate(some):
            np.add.at(out[p], code[r], w[r] / np.sqrt(max(self_k[r], 1e-30)))
    return out


class Machine:
    """The fitted machine: landmarks, the folded table, bias and score curve."""

    def __init__(self, bags: list[list[str]], toxic: np.ndarray):
        self.table = None
        if len(set(toxic.tolist())) < 2:
            return
        bags = [sorted({w for word in b for w in windows(word)}) for b in bags]
        bad, good = Counter(), Counter()
        for bag, y in zip(bags, toxic, strict=True):
            (bad if y else good).update(bag)
        n_bad, n_good = int(toxic.sum()), int((1 - toxic).sum())
        seeds = self._seeds(bags, toxic)
        common = sorted(good, key=lambda w: (-good[w], w))
        plain = common[:1500] + common[1500 :: max(1, len(common) // 4500)][:4500]
        self.landmarks = self._spread(seeds, LANDMARKS // 2) + self._spread(plain, LANDMARKS // 2)
        self.marks = features(self.landmarks)
        gram = self.marks @ self.marks.T
        value, vector = np.linalg.eigh(gram.astype(np.float64))
        keep = value > 1e-4 * value.max()
        self.root = vector[:, keep] / np.sqrt(value[keep])
        positive, negative = list(seeds), list(plain)
        for r in range(ROUNDS):
            self._train(positive, negative)
            if r + 1 == ROUNDS:
                break
            every = sorted({w for bag in bags for w in bag})
            margin = dict(zip(every, self.margins(every).tolist(), strict=True))
            best = [max(bag, key=lambda w: (margin[w], w), default=None) for bag in bags]
            hard = sorted({w for w, y in zip(best, toxic, strict=True) if not y and w})
            harder = sorted((w for w in good if margin[w] > -1 and bad[w] * n_good <= 3 * good[w] * n_bad), key=lambda w: (-margin[w], w))[:6000]
            negative = sorted(set(plain) | set(hard) | set(harder))
        every = sorted({w for bag in bags for w in bag})
        margin = dict(zip(every, self.margins(every).tolist(), strict=True))
        self._curve(np.array([max((margin[w] for w in bag), default=FLOOR) for bag in bags]), toxic)

    @staticmethod
    def _seeds(bags: list, toxic: np.ndarray, most: int = 3000) -> list:
        """The first witnesses: of each toxic bag the best word, and of all words those
        as telling by themselves. A word is as good as its best letter group
        (4 or 5 letters, word starts marked) that is LIFT times as frequent in
        toxic bags and that a likelihood ratio test holds for sure."""
        def groups(word):
            w = (32, *word)  # a group is packed into one integer
            four = [((w[i] * 33 + w[i + 1]) * 33 + w[i + 2]) * 33 + w[i + 3] for i in range(len(w) - 3)]
            return (*four, *(33**4 + g * 33 + x for g, x in zip(four, w[4:], strict=False)))

        of = {w: groups(w) for w in {w for bag in bags for w in bag}}
        bad, good = Counter(), Counter()
        for bag, y in zip(bags, toxic, strict=True):
            (bad if y else good).update(set().union(*(of[w] for w in bag)))
        n1, n0 = int(toxic.sum()), int(len(toxic) - toxic.sum())

        def worth(g):
            a, b = bad[g], good[g]
            if a * n0 <= LIFT * (b + 2) * n1:
                return 0.0
            e1, e0 = (a + b) * n1 / (n1 + n0), (a + b) * n0 / (n1 + n0)
            sure = a * np.log(a / e1) + (b * np.log(b / e0) if b else 0.0) > WORTH
            return float(np.log(a * n0 / ((b + 2) * n1))) if sure else 0.0

        value = {g: worth(g) for g in bad}
        best = {w: max((value.get(g, 0.0) for g in gs), default=0.0) for w, gs in of.items()}
        in_bad, in_good, first = Counter(), Counter(), set()
        for bag, y in zip(bags, toxic, strict=True):
            (in_bad if y else in_good).update(w for w in bag if best[w] > 0)
            if y and bag and best[top := max(bag, key=lambda w: (best[w], w))] > 0:
                first.add(top)
        out = list(first | {w for w, n in in_bad.items() if n * n0 > LIFT * (in_good[w] + 2) * n1})
        out.sort(key=lambda w: (-best[w] * in_bad[w], w))
        return out[:most] or sorted(of, key=lambda w: (-best[w], w))[:100]

    @staticmethod
    def _spread(words: list, n: int) -> list:
        """Up to n words, the first and then always the one least like those chosen."""
        words = words[:500]
        x = features(words)
        best, out = np.full(len(words), -1.0), []
        at = 0
        for _ in range(min(n, len(words))):
            out.append(words[at])
            best = np.maximum(best, x @ x[at])
            at = int(np.argmin(best))
            if best[at] > 0.98:
                break
        return out

    def _kernel(self, words: list) -> np.ndarray:
        """Normalised kernel of words with all landmarks."""
        out = np.zeros((len(words), len(self.landmarks)))
        marks = np.ascontiguousarray(self.marks.T)
        for some, code, w, self_k in expand(words):
            for r, p in enumerate(some):
                out[p] = w[r] @ marks[code[r]] / np.sqrt(max(self_k[r], 1e-30))
        return out

    def _train(self, positive: list, negative: list, ridge: float = 1e-2) -> None:
        x = self._kernel(positive + negative) @ self.root
        x = np.hstack([x, np.ones((len(x), 1))])
        y = np.array([1.0] * len(positive) + [-1.0] * len(negative))
        c = np.where(y > 0, 0.5 / max(1, len(positive)), 0.5 / max(1, len(negative))) * 100
        w = np.zeros(x.shape[1])
        eye = np.eye(x.shape[1]) * ridge
        eye[-1, -1] = 1e-8
        for _ in range(30):  # Newton steps of the squared hinge; each solves for its active set
            on = y * (x @ w) < 1
            new = np.linalg.solve(eye + (x[on] * c[on, None]).T @ x[on], (x[on] * c[on, None]).T @ y[on])
            if np.allclose(new, w, atol=1e-8):
                break
            w = new
        self.bias = float(w[-1])
        self.table = (self.root @ w[:-1]) @ self.marks.astype(np.float64)

    def _curve(self, margin: np.ndarray, toxic: np.ndarray) -> None:
        """Slope from a grid and shift by Newton steps, of least log loss."""
        n1 = toxic.sum()
        t = np.where(toxic > 0, (n1 + 1) / (n1 + 2), 1 / (len(toxic) - n1 + 2))
        m, found = np.maximum(margin, FLOOR), []
        for a in (1.0, 1.5, 2.0, 3.0, 4.0, 5.0, 6.0):
            b = 0.0
            for _ in range(100):
                p = 1 / (1 + np.exp(-(a * m + b)))
                b -= float(np.clip((p - t).sum() / max((p * (1 - p)).sum(), 1e-6), -1, 1))
            p = np.clip(1 / (1 + np.exp(-(a * m + b))), 1e-9, 1 - 1e-9)
            found.append((float(-(t * np.log(p) + (1 - t) * np.log(1 - p)).sum()), a, b))
        _, self.slope, self.shift = min(found)

    def margins(self, strings: list[tuple[int, ...]]) -> np.ndarray:
        """Decision values of words given as codes."""
        out = np.full(len(strings), self.bias)
        for some, code, w, self_k in expand(strings):
            out[some] = (self.table[code] * w).sum(1) / np.sqrt(np.maximum(self_k, 1e-30)) + self.bias
        return out

    def scores(self, texts: list, kept: dict[str, float]) -> np.ndarray:
        """Scores of texts; kept: margins of words met before, filled further."""
        if self.table is None:
            return np.zeros(len(texts))
        if len(kept) > KEPT_WORDS:
            kept.clear()
        bags = [bag_of_words(t) for t in texts]
        new = set().union(*bags).difference(kept)
        parts, owner = [], []
        for word in new:
            kept[word] = FLOOR
            for s in windows(word):
                parts.append(s)
                owner.append(word)
        for word, m in zip(owner, self.margins(parts).tolist() if parts else [], strict=True):
            if m > kept[word]:
                kept[word] = m
        get = kept.__getitem__
        margin = np.array([max(map(get, bag), default=FLOOR) for bag in bags])
        return 1 / (1 + np.exp(-(self.slope * margin + self.shift)))


def bag_of_words(text: str | None) -> set[str]:
    """The different words of a text in lower case, spaced-out letters also joined."""
    text = (text or "").lower()
    bag = set(text.split())
    for m in _SPACED.finditer(text):
        bag.add("".join(m[0].split()))
    return bag


def fit(docs: DataFrame, labels: DataFrame, max_each: int = MAX_EACH) -> Machine:
    """The machine learnt from at most 2 * max_each labelled documents that are
    not held out. Runs jobs; the driver gets that sample's different words."""
    used = labels.filter(F.col("toxic").isNotNull() & ~held_out(F.col("doc_id"))).groupBy(F.col("doc_id").alias("id")).agg(F.max("toxic").alias("label"))
    order = [F.xxhash64("id"), F.col("id")]
    used = used.filter("label = 1").orderBy(*order).limit(max_each).union(used.filter("label = 0").orderBy(*order).limit(max_each))
    text = docs.select(F.col("doc_id").alias("did"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = text.join(F.broadcast(used), F.col("did") == F.col("id"))
    free = F.greatest(F.char_length("text") - MAX_FIT_CHARS, F.lit(0)) + 1
    rows = rows.select("id", "label", F.xxhash64("text").alias("h"), F.substring(F.col("text"), (F.pmod(F.xxhash64("id", F.lit(5)), free) + 1).cast("int"), F.lit(MAX_FIT_CHARS)).alias("text"))
    bags = F.pandas_udf(lambda t: t.map(lambda x: sorted(bag_of_words(x))), "array<string>")
    found = rows.groupBy("id", "label").agg(F.min_by("text", "h").alias("text")).orderBy("id").limit(2 * max_each).select("label", bags("text").alias("words")).collect()
    return Machine([list(r["words"]) for r in found], np.array([r["label"] for r in found], int))


_KEPT: dict[str, dict[str, float]] = {}


def score_column(model: Machine, text: Column, spark) -> Column:
    """The score of a text as a column; the machine (a table of 32,768 weights) goes out by broadcast."""
    model.marks = model.landmarks = None  # the folded table is all that scoring needs
    sent, key = spark.sparkContext.broadcast(model), uuid.uuid4().hex

    @F.pandas_udf("double")
    def score(t: pd.Series) -> pd.Series:
        if key not in _KEPT:
            _KEPT.clear()
        kept = _KEPT.setdefault(key, {})
        t = t.tolist()
        return pd.Series(np.concatenate([sent.value.scores(t[i : i + 256], kept) for i in range(0, len(t), 256)] or [np.zeros(0)]))

    return score(text.cast("string"))


def toxicity_query(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of docs. Runs jobs to fit."""
    model = fit(docs, labels)
    scored = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), score_column(model, F.col("text"), docs.sparkSession).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
