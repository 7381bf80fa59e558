"""Quality classifier: nearest-neighbour voting over latent-semantic vectors.

Terms of a text are its words and pairs of adjacent words (hashed), the three-grams
of its letter shapes (16 classes of characters, runs of letters drawn together) and
bins of a few ratios: distinct words, distinct lines, word length, capitals, size.
Weighted by tf-idf and unit
length, the labelled texts span a latent space by a truncated SVD. Labelled
vectors are broadcast: at most `MAX_LABELLED` rows of `RANK` numbers, whatever
the corpus holds. Every document is projected and compared with all of them in
exact blocked cosine products; the `NEIGHBOURS` nearest vote by similarity.

Defined cases: null text is the empty text and gets a score like any other; very
long texts are read whole (their different terms are bounded); of neighbours
that tie at the last place all vote; rows of labels that repeat a doc_id vote
with the mean of their labels, of documents that share one the text of the least
hash is learnt from; labels without quality or document don't count; without any
usable label every score is the prior 0.5; other columns, whatever their names,
are not read; an empty table gives an empty result.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ravelin.llm.common import held_out, release, short_batches

#: Bound of the labelled sample: rows of labels in the order of a hash of doc_id.
MAX_LABELLED = 6000
RANK = 48
NEIGHBOURS = 25
#: Similarity is raised to this power before it votes.
SHARPNESS = 8
THRESHOLD = 0.3
_BLOCK = 512
_GROUPS = ((" ", 0), ("\n\r\t\x0b\x0c", 1), (".", 5), (",", 6), ("!", 7), ("?", 8), ("|", 9), ("$&%#*", 10), ("\"'`", 11), ("()[]{}<>", 12), ("-_/\\", 13), (":;=", 14))


def _classes() -> bytes:
    table = bytearray([15] * 128 + [2] * 128)
    for low, high, c in ((97, 122, 2), (65, 90, 3), (48, 57, 4)):
        table[low : high + 1] = bytes([c]) * (high + 1 - low)
    for chars, c in _GROUPS:
        for ch in chars:
            table[ord(ch)] = c
    return bytes(table)


_TABLE = _classes()
_TAIL = bytes(range(0x80, 0xC0))  # continuation bytes: a letter counts once
SHAPES = 16**3
#: Bins of each ratio.
BINS = 12
RATIOS = 6
#: Buckets of hashed words and word pairs, and what their counts weigh beside shapes.
WORDS = 1 << 13
WORD_WEIGHT = 0.5
TERMS = SHAPES + BINS * RATIOS + WORDS


def terms(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Term numbers and weights (before idf) of one text."""
    text = text or ""
    raw = np.frombuffer(text.encode("utf-8", "replace").translate(_TABLE, _TAIL), np.uint8)
    n = len(raw)
    if n:
        keep = np.ones(n, bool)
        keep[1:] = (raw[1:] != raw[:-1]) | ((raw[1:] != 2) & (raw[1:] != 3) & (raw[1:] != 4))
        s = raw[keep].astype(np.int32)
    else:
        s = np.zeros(0, np.int32)
    s = np.concatenate(([1], s, [1]))
    counts = np.bincount(s[:-2] * 256 + s[1:-1] * 16 + s[2:]) if len(s) > 2 else np.zeros(0, np.int64)
    at = np.flatnonzero(counts)
    words = text.split()
    lines = text.split("\n")
    nw = max(1, len(words))
    letters = max(1, int((raw == 2).sum() + (raw == 3).sum()))
    ratios = (
        len(set(words)) / nw,
        len(set(lines)) / len(lines),
        min(1.0, letters / nw / 12),
        int((raw == 3).sum()) / letters,
        min(1.0, np.log1p(nw) / 10),
        min(1.0, (n - letters - int((raw <= 1).sum())) / nw / 2),
    )
    bins = [SHAPES + BINS * i + min(BINS - 1, int(r * BINS)) for i, r in enumerate(ratios)]
    held, many = _hashed(words)
    return np.concatenate((at, bins, SHAPES + BINS * RATIOS + held)).astype(np.int32), np.concatenate((np.log1p(counts[at]), np.full(len(bins), 3.0), WORD_WEIGHT * np.log1p(many))).astype(np.float32)


def _hashed(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of words and pairs of adjacent words, and how many fall in each."""
    if not words:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    crc = {w: zlib.crc32(w.encode("utf-8", "replace")) for w in set(words)}
    h = np.fromiter(map(crc.__getitem__, words), np.int64, len(words))
    both = np.concatenate((h, (h[:-1] * 31 + h[1:]) ^ (h[1:] >> 7)))
    counts = np.bincount((both ^ both >> 16) % WORDS, minlength=WORDS)
    at = np.flatnonzero(counts)
    return at, counts[at]


def _terms(text: pd.Series) -> pd.DataFrame:
    found = [terms(t) for t in text]  # as bytes: lists of numbers fill the driver's memory
    return pd.DataFrame({"at": [a.tobytes() for a, _ in found], "weight": [w.tobytes() for _, w in found]})


class Voter:
    """The fitted model: idf, projection, labelled vectors and their labels."""

    def __init__(self, rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, rank: int = RANK, neighbours: int = NEIGHBOURS, sharpness: float = SHARPNESS):
        self.labels = labels.astype(np.float32)
        self.k, self.power = min(neighbours, len(rows)), sharpness
        if not rows:
            return
        df = np.zeros(TERMS)
        for at, _ in rows:
            df[at] += 1
        self.idf = np.where(df > 0, np.log((1 + len(rows)) / (1 + df)) + 1, 0).astype(np.float32)
        flat, start, val = self._sparse(rows)
        rank = min(rank, len(rows), TERMS)
        q = np.random.default_rng(42).standard_normal((TERMS, rank + 8)).astype(np.float32)
        row = np.repeat(np.arange(len(rows), dtype=np.int32), np.diff(start))
        for _ in range(4):  # subspace iteration for the leading right singular vectors
            y = self._times(flat, start, val, q)
            q, _ = np.linalg.qr(np.stack([np.bincount(flat, val * y[row, j], TERMS).astype(np.float32) for j in range(y.shape[1])], 1))
        _, _, vt = np.linalg.svd(self._times(flat, start, val, q), full_matrices=False)
        self.basis = np.ascontiguousarray((q @ vt[:rank].T).astype(np.float32))
        self.vectors = self._unit(self._times(flat, start, val, self.basis))

    def _sparse(self, rows) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Term numbers of all rows on end, where each row starts, unit tf-idf weights."""
        out = [w * self.idf[at] for at, w in rows]
        out = [w / max(float(np.sqrt(w @ w)), 1e-12) for w in out]
        return np.concatenate([at for at, _ in rows]), np.concatenate(([0], np.cumsum([len(w) for w in out]))), np.concatenate(out)

    @staticmethod
    def _times(flat, start, val, q: np.ndarray) -> np.ndarray:
        """The sparse rows times q; every row has a term."""
        return np.stack([val[a:b] @ q[flat[a:b]] for a, b in zip(start[:-1].tolist(), start[1:].tolist(), strict=True)]).astype(np.float32)

    @staticmethod
    def _unit(x: np.ndarray) -> np.ndarray:
        return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)

    def score(self, texts: list) -> np.ndarray:
        out = np.full(len(texts), 0.5)
        if not self.k:
            return out
        for i in range(0, len(texts), _BLOCK):
            q = self._unit(self._times(*self._sparse([terms(t) for t in texts[i : i + _BLOCK]]), self.basis))
            sim = np.round(q @ self.vectors.T, 6)
            last = np.partition(sim, -self.k, axis=1)[:, -self.k]
            r, c = np.nonzero(sim >= last[:, None])
            w = np.maximum(sim[r, c], 1e-6).astype(float) ** self.power
            out[i : i + _BLOCK] = np.bincount(r, w * self.labels[c], len(q)) / np.bincount(r, w, len(q))
        return np.clip(out, 0, 1)


def fit(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> Voter:
    """The voter learnt from at most max_labelled rows of labels that are not
    held out. Runs a job; terms are counted on the executors."""
    used = labels.filter(F.col("quality").isNotNull() & ~held_out(F.col("doc_id"))).groupBy(F.col("doc_id").alias("id")).agg(F.avg("quality").alias("label"))
    used = used.orderBy(F.xxhash64("id"), "id").limit(max_labelled)  # bounded: safe to broadcast
    counted = F.pandas_udf(_terms, "struct<at:binary,weight:binary>")
    text = docs.select(F.col("doc_id").alias("did"), F.col("text").cast("string").alias("text"))
    one = text.join(F.broadcast(used), F.col("did") == F.col("id")).select("id", "label", F.xxhash64("text").alias("h"), counted("text").alias("t"))
    rows = one.groupBy("id", "label").agg(F.min_by("t", "h").alias("t")).orderBy("id").limit(max_labelled).collect()
    return Voter([(np.frombuffer(r["t"]["at"], np.int32), np.frombuffer(r["t"]["weight"], np.float32)) for r in rows], np.array([r["label"] for r in rows]))


def score_column(model: Voter, text: Column, spark) -> Column:
    """The score of a text as a column; the model goes out by broadcast."""
    short_batches(spark)
    sent = spark.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(t: pd.Series) -> pd.Series:
        out = pd.Series(sent.value.score(t.tolist()), dtype="float64")
        release()
        return out

    return score(text.cast("string"))


def quality_query(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of docs. Runs a job to fit."""
    model = fit(docs, labels)
    scored = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), score_column(model, F.col("text"), docs.sparkSession).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """docs without the rows that score below the threshold. Runs a job to fit."""
    model = fit(docs, labels)
    return docs.filter(score_column(model, F.col("text"), docs.sparkSession) >= threshold)
