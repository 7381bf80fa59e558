"""Secrets: three patterns, and a battery of randomness tests for the rest.

The battery reads every run of 16 or more characters of the base-64 alphabets.
Its encoding is the least alphabet that holds it (digits, hex, 26 letters of one
case, base 32, 36, 62, 64). Within it three tests compare it with uniform random
symbols: chi-squared of the symbol counts, runs above and below the middle, and
lag-one serial correlation; Fisher's method combines them. Prose is no uniform
randomness, and how random prose looks by chance at a given length is measured:
all letter-only runs of one case in the whole corpus give the null counts, by
length class and score bin. Prose hardly has words of 20 letters, so the words of
each document, written without the gaps, are also cut into pieces from end to end,
once for each class, at its least length, where prose looks most random; every
letter is in one, but in documents with fewer letters than a piece has. A run that
is not prose gets the share of null runs of its class that look at least as random
as its p-value, and Benjamini-Hochberg at rate `FDR` decides within each length
class. Runs that hold under `MIN_BITS` bits are no candidates.

Defined cases: null text is empty and has no spans; repeated rows are scanned
each; a length class with too few null runs for any p-value to reach the rate
borrows those of the nearest class that has enough; without any such, no span is
added; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ravelin.llm.common import cut

KINDS = ("assign", "access", "hex", "random")
ASSIGN = re.compile(r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{16,}")  # a run is taken whole or not at all
RUN = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16,}")
PROSE = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
WORD = re.compile(rf"(?<![\w+/-])(?:{PROSE.pattern})(?![\w+/-])")
FDR = 0.01
MIN_BITS = 64
#: Length classes begin at these lengths.
LENGTHS = (16, 20, 24, 32, 48)
BINS = 240
_PER_E = 8  # bins for each power of e of the combined p-value
_LETTERS_AT_ONCE = 1 << 18  # bounds what a worker holds of joined words, not what it reads


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the patterns, by start and then kind."""
    found = [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    found += [("access", *m.span()) for m in ACCESS.finditer(text)] if "AKIA" in text else []
    found += [("hex", *m.span()) for m in HEX.finditer(text)]
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0])))


def joined(spans) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def _alphabet(chars: str) -> np.ndarray:
    table = np.full(128, -1, np.int16)
    for i, ch in enumerate(chars):
        table[ord(ch)] = i
    return table


_DIGITS, _LOWER, _UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_B64 = _alphabet(_UPPER + _LOWER + _DIGITS + "+/")
_B64[ord("-")], _B64[ord("_")] = 62, 63
#: Encodings from the least alphabet up: symbols and their codes.
ENCODINGS = (
    (10, _alphabet(_DIGITS)),
    (16, _alphabet(_DIGITS + "abcdef")),
    (16, _alphabet(_DIGITS + "ABCDEF")),
    (26, _alphabet(_LOWER)),
    (26, _alphabet(_UPPER)),
    (32, _alphabet(_UPPER + "234567")),
    (36, _alphabet(_DIGITS + _LOWER)),
    (36, _alphabet(_DIGITS + _UPPER)),
    (62, _alphabet(_DIGITS + _UPPER + _LOWER)),
    (64, _B64),
)


def _two_sided(z: np.ndarray) -> np.ndarray:
    """erfc(|z| / sqrt 2) by a rational approximation (absolute error under 2e-7)."""
    x = np.abs(z) / np.sqrt(2)
    t = 1 / (1 + 0.3275911 * x)
    poly = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429))))
    return np.clip(poly * np.exp(-x * x), 1e-30, 1)


def _combined(n, size, squares, n1, turns, var, lag) -> np.ndarray:
    """The combined p-value of runs of n symbols out of size, from the sum of squared
    symbol counts, the symbols above the middle, the turns across it, and the sums of
    squares and of neighbours' products about the mean."""
    chi = squares * size / n - n
    df = size - 1
    wilson = ((np.maximum(chi, 0) / df) ** (1 / 3) - (1 - 2 / (9 * df))) / np.sqrt(2 / (9 * df))
    half = _two_sided(wilson) / 2
    p1 = np.where(wilson > 0, half, 1 - half)
    n0 = n - n1
    mean = 2 * n1 * n0 / n + 1
    wide = np.maximum((mean - 1) * (mean - 2) / np.maximum(n - 1, 1), 1e-9)
    p2 = np.where((n1 > 0) & (n0 > 0), _two_sided((turns - mean) / np.sqrt(wide)), 1e-6)
    r = lag / np.maximum(var, 1e-9)
    p3 = np.where(var > 0, _two_sided((r + 1 / n) * np.sqrt(n)), 1e-6)
    x = -(np.log(np.maximum(p1, 1e-30)) + np.log(np.maximum(p2, 1e-30)) + np.log(np.maximum(p3, 1e-30)))
    return np.exp(-x) * (1 + x + x * x / 2)


def battery(runs: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """For ASCII strings: the combined p-value against uniform symbols of the
    inferred encoding, and the bits that such a string holds."""
    if not runs:
        return np.zeros(0), np.zeros(0)
    n = np.fromiter(map(len, runs), np.int64, len(runs))
    raw = np.frombuffer("".join(runs).encode("ascii"), np.uint8)
    who = np.repeat(np.arange(len(runs)), n)
    start = np.cumsum(n) - n
    size = np.zeros(len(runs), np.int64)
    code = np.zeros(len(raw), np.int64)
    open_ = np.ones(len(runs), bool)
    for symbols, table in ENCODINGS:
        c = table[raw]
        fits = open_ & (np.minimum.reduceat(c, start) >= 0)
        size[fits] = symbols
        open_ &= ~fits
        mine = fits[who]
        code[mine] = c[mine]
    counts = np.bincount(who * 64 + code, minlength=64 * len(runs)).reshape(-1, 64)
    up = code * 2 >= size[who]
    n1 = np.bincount(who, up, minlength=len(runs))
    same = np.zeros(len(raw), bool)
    same[1:] = (up[1:] != up[:-1]) & (who[1:] == who[:-1])
    turns = np.bincount(who, same, minlength=len(runs)) + 1
    mid = code - np.bincount(who, code, minlength=len(runs))[who] / n[who]
    var = np.bincount(who, mid * mid, minlength=len(runs))
    prod = np.zeros(len(raw))
    prod[1:] = np.where(who[1:] == who[:-1], mid[1:] * mid[:-1], 0)
    lag = np.bincount(who, prod, minlength=len(runs))
    return _combined(n, size, (counts.astype(float) ** 2).sum(1), n1, turns, var, lag), n * np.log2(np.maximum(size, 2))


def bins(p: np.ndarray) -> np.ndarray:
    """Score bins: 0 the most random."""
    return np.minimum(BINS - 1, (-np.log(np.maximum(p, 1e-30)) * _PER_E)).astype(np.int64)


def joined_words(text: str) -> str:
    """The text's words without the gaps, in small letters."""
    return "".join(WORD.findall(text)).lower()


def piece_p(pieces: np.ndarray) -> np.ndarray:
    """What battery gives for runs of a-z of one length, a row of codes from 0 each."""
    k, n = pieces.shape
    c = pieces.astype(np.int64)
    counts = np.bincount((c + 26 * np.arange(k)[:, None]).ravel(), minlength=26 * k).reshape(k, 26)
    size = np.where(c.max(1) < 6, 16, 26)  # a-f alone are hex, and all above its middle
    up = c >= 13
    turns = (up[:, 1:] != up[:, :-1]).sum(1) + 1
    total, mean = c.sum(1), c.mean(1)
    var = (n * np.einsum("ij,ij->i", c, c) - total * total) / n
    lag = np.einsum("ij,ij->i", c[:, 1:], c[:, :-1]) - mean * (2 * total - c[:, 0] - c[:, -1]) + (n - 1) * mean * mean
    return _combined(n, size, np.einsum("ij,ij->i", counts, counts), up.sum(1), turns, var, lag)


def joined_counts(proses: list[str]) -> np.ndarray:
    """Null counts by length class and bin of all pieces of the given joined words.
    A text's last piece ends with it, so each letter is in a piece of every class
    that the text is long enough for."""
    out = np.zeros((len(LENGTHS), BINS), np.int64)
    size = np.fromiter(map(len, proses), np.int64, len(proses))
    begin = np.cumsum(size) - size
    codes = np.frombuffer("".join(proses).encode("ascii"), np.uint8) - 97
    for i, n in enumerate(LENGTHS):
        k = np.where(size >= n, -(-size // n), 0)
        if not k.any():
            continue
        nth = np.arange(k.sum()) - np.repeat(np.cumsum(k) - k, k)
        at = np.repeat(begin, k) + np.minimum(nth * n, np.repeat(size - n, k))
        windows = np.lib.stride_tricks.sliding_window_view(codes, n)
        for lo in range(0, len(at), _LETTERS_AT_ONCE // n):
            p = piece_p(windows[at[lo : lo + _LETTERS_AT_ONCE // n]])
            out[i] += np.bincount(bins(p), minlength=BINS)
    return out


def _scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        texts = b["text"].fillna("").tolist()
        out = {k: [] for k in ("n_assign", "n_access", "n_hex", "base", "starts", "ends", "cells")}
        null = np.zeros((len(LENGTHS), BINS), np.int64)
        proses: list[str] = []
        letters = 0
        runs: list[str] = []
        where: list[tuple[int, int]] = []
        for i, t in enumerate(texts):
            base = base_spans(t)
            for kind in KINDS[:3]:
                out[f"n_{kind}"].append(sum(s[0] == kind for s in base))
            out["base"].append(joined(base))
            for m in RUN.finditer(t):
                runs.append(m[0])
                where.append((i, m.start()))
            proses.append(joined_words(t))
            letters += len(proses[-1])
            if letters >= _LETTERS_AT_ONCE:
                null += joined_counts(proses)
                proses, letters = [], 0
        null = (null + joined_counts(proses)).ravel()
        p, held = battery(runs)
        cell = np.searchsorted(LENGTHS, [len(r) for r in runs], side="right") - 1 if runs else np.zeros(0, int)
        cell = cell * BINS + bins(p)
        rows = [([], [], []) for _ in texts]
        for (i, at), run, c, bits in zip(where, runs, cell.tolist(), held.tolist(), strict=True):
            if PROSE.fullmatch(run):
                null[c] += 1
            elif bits >= MIN_BITS:
                rows[i][0].append(at)
                rows[i][1].append(at + len(run))
                rows[i][2].append(c)
        for k, name in enumerate(("starts", "ends", "cells")):
            out[name] = [r[k] for r in rows]
        filled = np.flatnonzero(null)
        out["null"] = [filled.tolist() if i == 0 else [] for i in range(len(texts))]
        out["times"] = [null[filled].tolist() if i == 0 else [] for i in range(len(texts))]
        yield pd.DataFrame({"doc_id": b["doc_id"].astype("Int64"), **out})


#: null and times are the cells of a whole batch's null runs and their counts, on its first row.
_SCAN = "doc_id long, n_assign long, n_access long, n_hex long, base string, starts array<int>, ends array<int>, cells array<int>, null array<int>, times array<long>"


def accepted(null: np.ndarray, seen: np.ndarray, rate: float = FDR) -> np.ndarray:
    """Which cells (length class, bin) pass: counts of null and candidate runs in,
    Benjamini-Hochberg within each class."""
    out = np.zeros(seen.shape, bool)
    filled = np.flatnonzero((1 + null.sum(1)) * rate >= 1)
    for c in range(len(seen)):
        if not len(filled) or not seen[c].any():
            continue
        ref = null[filled[np.argmin(np.abs(filled - c))]]
        p = (1 + np.cumsum(ref)) / (1 + ref.sum())
        ok = np.flatnonzero((p * seen[c].sum() <= rate * np.cumsum(seen[c])) & (seen[c] > 0))
        if len(ok):
            out[c, : ok[-1] + 1] = True
    return out


def scan(docs: DataFrame, rate: float = FDR) -> DataFrame:
    """Rows of docs as doc_id, n_assign, n_access, n_hex, base (joined spans) and
    added (array of start, end of the battery's spans). Runs jobs; the driver
    gets counts by cell, at most 2 * len(LENGTHS) * BINS rows."""
    first = cut(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInPandas(_scan, _SCAN))
    null = first.select(F.explode(F.arrays_zip("null", "times")).alias("z")).select(F.lit(0).alias("side"), F.col("z.null").alias("cell"), "z.times")
    seen = first.select(F.lit(1).alias("side"), F.explode("cells").alias("cell"), F.lit(1).cast("long").alias("times"))
    counts = np.zeros((2, len(LENGTHS) * BINS), np.int64)
    for r in null.unionAll(seen).groupBy("side", "cell").agg(F.sum("times").alias("n")).collect():
        counts[r["side"], r["cell"]] = r["n"]
    ok = accepted(*counts.reshape(2, len(LENGTHS), BINS), rate).ravel()
    good = F.array(*[F.lit(int(c)) for c in np.flatnonzero(ok)]).cast("array<int>")
    zipped = F.arrays_zip("starts", "ends", "cells")
    added = F.transform(F.filter(zipped, lambda s: F.array_contains(good, s["cells"])), lambda s: F.struct(s["starts"].alias("start"), s["ends"].alias("end")))
    return first.select("doc_id", "n_assign", "n_access", "n_hex", "base", added.alias("added"))


def _digest(base: pd.Series, added: pd.Series) -> pd.DataFrame:
    shas, spans = [], []
    for b, more in zip(base, added, strict=True):
        shas.append(hashlib.sha256(b.encode()).hexdigest())
        own = [(k, int(s), int(e)) for k, s, e in (x.split(":") for x in b.split(",") if x)]
        new = [("random", int(m["start"]), int(m["end"])) for m in more]
        new = [n for n in new if not any(s < n[2] and n[1] < e for _, s, e in own)]  # what a pattern has found is not told twice
        spans.append(joined(sorted(own + new, key=lambda x: (x[1], KINDS.index(x[0])))))
    return pd.DataFrame({"base_sha256": shas, "spans": spans})


def secrets_query(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans of every row. Runs jobs."""
    digest = F.pandas_udf(_digest, "struct<base_sha256:string,spans:string>")
    found = scan(docs).withColumn("d", digest("base", "added"))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", "d.base_sha256", "d.spans")
