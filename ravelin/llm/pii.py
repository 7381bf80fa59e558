"""Personal data: four patterns, and a character tagger for what they miss.

The tagger is a bidirectional LSTM over characters with a CRF above it, trained
here in numpy on labelled spans: those that the patterns find in a bounded sample of
text, as they stand and rewritten the ways people hide them (spaced, bracketed,
dotted), and invented values planted in that text. Text in which no pattern finds
anything may hold hidden values, so it is never learnt as harmless: decoys (dates,
prices, versions, numbers, hashes) first take the place of all that has digits or an
at. The tagger reads every region of every text around a digit, an at sign, a
bracketed "at" or "dot", or an "at" that a dotted name follows, in overlapping windows;
their emissions are averaged with weights that fall towards a window's edges, and one
Viterbi pass over the whole region settles all windows at once. A decoded span is kept
where no pattern span lies and its kind's digits allow it. All digits look alike to it.

Defined cases: null text is empty and has no spans; repeated rows are scanned
each and tie with themselves; a text of any length is scanned whole, its regions one
by one; other columns are not read, whatever their names; if no text holds a span to
learn from nothing is added; an empty table gives an empty result.
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

KINDS = ("email", "ip", "card", "phone")
WINDOW, STRIDE, MARGIN = 96, 64, 40
HIDDEN, EMBED = 20, 12
#: Bound of the labelled sample: regions with and without spans, by a hash of doc_id.
MAX_REGIONS = 600
EPOCHS = 12

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_HOST = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")  # leftmost: a run of digits starts or fails as a whole
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile("[0-9]")
_TRIGGER = re.compile(r"\d|[@＠]|[(\[{<]\s?(?:at|dot)\s?[)\]}>]|\sat\s\S+(?:\sdot\s|\.\w)|\sdot\s\w", re.IGNORECASE)


def luhn(digits: str) -> bool:
    """Whether the check digit is right."""
    total = 0
    for i, ch in enumerate(reversed(digits)):
        d = ord(ch) - 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(ch for ch in text if "0" <= ch <= "9")


def _emails(text: str) -> list[tuple[str, int, int]]:
    out, end = [], 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _HOST.match(text, at + 1)):
            out.append(("email", start, m.end()))
            end = m.end()
        at = text.find("@", max(at + 1, end))
    return out


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the patterns, by kind as listed and then start."""
    out = _emails(text)
    if _DIGIT.search(text):
        out += [("ip", *m.span()) for m in _IP.finditer(text) if all(len(p) < 400 and int(p) <= 255 for p in m[0].split("."))]
        out += [("card", *m.span()) for m in _CARD.finditer(text) if 16 <= len(d := _digits(m[0])) <= 19 and luhn(d)]
        if "+" in text:
            out += [("phone", *m.span()) for m in _PHONE.finditer(text) if 8 <= len(_digits(m[0])) <= 15]
    return out


def joined(spans) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def regions(text: str) -> list[tuple[int, int]]:
    """Where the tagger reads: the triggers and MARGIN characters about each."""
    out: list[list[int]] = []
    for m in _TRIGGER.finditer(text):
        a, b = max(0, m.start() - MARGIN), min(len(text), m.end() + MARGIN)
        if out and a <= out[-1][1]:
            out[-1][1] = max(b, out[-1][1])
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


_SPECIAL = "@.+-() ,:;\"'=/_%[]{}<>|!?#*$&\n"
_VOCAB = 3 + 26 + 1 + len(_SPECIAL)  # 0 pads, 1 other letters, 2 everything else


def _codes() -> dict[str, int]:
    table = {ch: 3 + i for i, ch in enumerate("abcdefghijklmnopqrstuvwxyz")}
    table |= {ch.upper(): i for ch, i in table.items()}
    table |= {d: 29 for d in "0123456789"}
    return table | {ch: 30 + i for i, ch in enumerate(_SPECIAL)}


_CODE = _codes()
TAGS = 1 + 2 * len(KINDS)  # none; begin and inside of each kind


def encode(text: str) -> np.ndarray:
    get = _CODE.get
    return np.array([get(ch) or (1 if ch.isalpha() else 2) for ch in text], np.int16)


def tags(n: int, spans) -> np.ndarray:
    out = np.zeros(n, np.int64)
    for kind, a, b in spans:
        k = KINDS.index(kind)
        out[a:b] = 2 + 2 * k
        out[a] = 1 + 2 * k
    return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


class Tagger:
    """BiLSTM-CRF. Parameters: embedding, two LSTMs, output layer, transitions."""

    def __init__(self, seed: int = 7):
        r = np.random.default_rng(seed)
        h = HIDDEN

        def init(*shape):
            return (r.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float32)

        self.p = {"embed": (r.standard_normal((_VOCAB, EMBED)) * 0.3).astype(np.float32)}
        for d in "fb":
            self.p |= {f"x{d}": init(EMBED, 4 * h), f"h{d}": init(h, 4 * h), f"c{d}": np.zeros(4 * h, np.float32)}
            self.p[f"c{d}"][h : 2 * h] = 1  # gates are laid out in, forget, out, candidate
        self.p |= {"out": init(2 * h, TAGS), "bias": np.zeros(TAGS, np.float32), "trans": np.zeros((TAGS, TAGS), np.float32)}
        bad = np.zeros((TAGS, TAGS), np.float32)
        for k in range(len(KINDS)):
            bad[:, 2 + 2 * k] = -1e4
            bad[1 + 2 * k, 2 + 2 * k] = bad[2 + 2 * k, 2 + 2 * k] = 0
        self.bad = bad  # an inside follows its own begin or inside only

    def _lstm(self, x: np.ndarray, d: str, keep: bool):
        h_size = HIDDEN
        table = self.p["embed"] @ self.p[f"x{d}"] + self.p[f"c{d}"]
        n, t = x.shape
        h = np.zeros((n, h_size), np.float32)
        c = np.zeros_like(h)
        out = np.empty((n, t, h_size), np.float32)
        past = []
        for s in range(t) if d == "f" else range(t - 1, -1, -1):
            z = table[x[:, s]] + h @ self.p[f"h{d}"]
            gates = _sigmoid(z[:, : 3 * h_size])
            g = np.tanh(z[:, 3 * h_size :])
            i, f, o = gates[:, :h_size], gates[:, h_size : 2 * h_size], gates[:, 2 * h_size :]
            new = f * c + i * g
            tc = np.tanh(new)
            if keep:
                past.append((s, h, c, gates, g, tc))
            h, c = o * tc, new
            out[:, s] = h
        return out, past

    def emissions(self, x: np.ndarray) -> np.ndarray:
        both = np.concatenate((self._lstm(x, "f", False)[0], self._lstm(x, "b", False)[0]), axis=2)
        return both @ self.p["out"] + self.p["bias"]

    def train(self, x: np.ndarray, y: np.ndarray, length: np.ndarray, epochs: int = EPOCHS, rate: float = 0.02, batch: int = 128, seed: int = 11) -> None:
        """Adam on the CRF's negative log likelihood."""
        order = np.random.default_rng(seed)
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        v = {k: np.zeros_like(w) for k, w in self.p.items()}
        step = 0
        for e in range(epochs):
            perm = order.permutation(len(x))
            for lo in range(0, len(x), batch):
                at = perm[lo : lo + batch]
                t = int(length[at].max())
                grad = self._gradients(x[at, :t], y[at, :t], length[at])
                step += 1
                lr = rate * (1 - 0.9 * e / epochs)
                norm = np.sqrt(sum(float((g * g).sum()) for g in grad.values()))
                for k, g in grad.items():
                    g = g * min(1.0, 5 / max(norm, 1e-9))
                    m[k] = 0.9 * m[k] + 0.1 * g
                    v[k] = 0.99 * v[k] + 0.01 * g * g
                    self.p[k] -= lr * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)

    def _crf(self, e: np.ndarray, y: np.ndarray, length: np.ndarray):
        """Gradients of the mean negative log likelihood by emissions and
        transitions: forward-backward over scaled probabilities."""
        n, t, k = e.shape
        trans = np.exp(self.p["trans"] + self.bad)
        live = np.arange(t)[None, :] < length[:, None]
        ex = np.exp(e - e.max(axis=2, keepdims=True)).transpose(1, 0, 2)
        alpha, beta = np.empty((t, n, k), np.float32), np.empty((t, n, k), np.float32)
        scale = np.ones((t, n, 1), np.float32)
        a = ex[0] * np.exp(self.bad[0])  # a text begins as if after no tag
        for s in range(t):
            if s:
                a = np.where(live[:, s, None], (alpha[s - 1] @ trans) * ex[s], alpha[s - 1])
            scale[s] = np.maximum(a.sum(1, keepdims=True), 1e-30)
            alpha[s] = a / scale[s]
        beta[-1] = 1
        for s in range(t - 2, -1, -1):
            beta[s] = np.where(live[:, s + 1, None], ((beta[s + 1] * ex[s + 1]) @ trans.T) / scale[s + 1], beta[s + 1])
        de = alpha * beta
        de = (de / np.maximum(de.sum(2, keepdims=True), 1e-30)).transpose(1, 0, 2) * live[:, :, None]
        on = live.T[1:].reshape(-1)
        left = alpha[:-1].reshape(-1, k)[on]
        right = (beta[1:] * ex[1:] / scale[1:]).reshape(-1, k)[on]
        dt = (left.T @ right) * trans
        before, after = y[:, :-1].T.reshape(-1)[on], y[:, 1:].T.reshape(-1)[on]
        dt -= np.bincount(before * k + after, minlength=k * k).reshape(k, k)
        r, c = np.nonzero(live)
        de[r, c, y[r, c]] -= 1
        return (de / n).astype(np.float32), (dt / n).astype(np.float32)

    def _gradients(self, x: np.ndarray, y: np.ndarray, length: np.ndarray) -> dict[str, np.ndarray]:
        hf, pf = self._lstm(x, "f", True)
        hb, pb = self._lstm(x, "b", True)
        both = np.concatenate((hf, hb), axis=2)
        de, dt = self._crf(both @ self.p["out"] + self.p["bias"], y, length)
        flat = de.reshape(-1, TAGS)
        grad = {"out": both.reshape(-1, 2 * HIDDEN).T @ flat, "bias": flat.sum(0), "trans": dt, "embed": np.zeros_like(self.p["embed"])}
        dh_all = de @ self.p["out"].T
        for d, past, own in (("f", pf, dh_all[:, :, :HIDDEN]), ("b", pb, dh_all[:, :, HIDDEN:])):
            u = self.p[f"h{d}"]
            n, t = x.shape
            dzs, hs = np.empty((t, n, 4 * HIDDEN), np.float32), np.empty((t, n, HIDDEN), np.float32)
            dh = np.zeros((n, HIDDEN), np.float32)
            dc = np.zeros_like(dh)
            for s, h, c, gates, g, tc in reversed(past):
                i, f, o = gates[:, :HIDDEN], gates[:, HIDDEN : 2 * HIDDEN], gates[:, 2 * HIDDEN :]
                dh = dh + own[:, s]
                dc = dc + dh * o * (1 - tc * tc)
                dz = np.concatenate((dc * g * i * (1 - i), dc * c * f * (1 - f), dh * tc * o * (1 - o), dc * i * (1 - g * g)), axis=1)
                dzs[s], hs[s] = dz, h
                dh, dc = dz @ u.T, dc * f
            flat_dz = dzs.reshape(-1, 4 * HIDDEN)
            du = hs.reshape(-1, HIDDEN).T @ flat_dz
            one_hot = np.zeros((t * n, _VOCAB), np.float32)
            one_hot[np.arange(t * n), x.T.ravel()] = 1
            dtable = one_hot.T @ flat_dz
            grad[f"h{d}"], grad[f"c{d}"] = du, dtable.sum(0)
            grad[f"x{d}"] = self.p["embed"].T @ dtable
            grad["embed"] += dtable @ self.p[f"x{d}"].T
        return grad

    def viterbi(self, e: np.ndarray, length: np.ndarray) -> list[np.ndarray]:
        """The best tags of each row of emissions, up to its length."""
        n, t, k = e.shape
        trans = self.p["trans"] + self.bad
        score = e[:, 0] + self.bad[0]
        back = np.zeros((t, n, k), np.int8)
        for s in range(1, t):
            both = score[:, :, None] + trans[None]
            back[s] = both.argmax(1)
            score = np.where((s < length)[:, None], both.max(1) + e[:, s], score)
            back[s][s >= length] = np.arange(k)
        tag = score.argmax(1)
        path = np.zeros((n, t), np.int64)
        for s in range(t - 1, -1, -1):
            path[:, s] = tag
            tag = back[s][np.arange(n), tag]
        return [path[r, : length[r]] for r in range(n)]

    def decode(self, texts: list[str]) -> list[list[tuple[str, int, int]]]:
        """Spans of each region: windows are read apart and settled together."""
        out: list[list[tuple[str, int, int]]] = [[] for _ in texts]
        order = sorted((i for i, t in enumerate(texts) if t), key=lambda i: len(texts[i]))
        lo = 0
        while lo < len(order):
            longest = len(texts[order[min(lo + 127, len(order) - 1)]])
            some = order[lo : lo + (128 if longest <= 2048 else 1)]  # long regions one by one
            lo += len(some)
            length = np.array([len(texts[i]) for i in some])
            e = np.zeros((len(some), int(length.max()), TAGS), np.float32)
            weight = np.full(e.shape[:2], 1e-9, np.float32)
            cut_up = [(r, a) for r, n in enumerate(length.tolist()) for a in range(0, max(1, n - WINDOW + STRIDE), STRIDE)]
            coded = [encode(texts[i]) for i in some]
            tent = (np.minimum(np.arange(WINDOW) + 1, WINDOW - np.arange(WINDOW)) / (WINDOW / 2)).astype(np.float32)
            for w in range(0, len(cut_up), 512):
                part = cut_up[w : w + 512]
                x = np.zeros((len(part), WINDOW), np.int16)
                for j, (r, a) in enumerate(part):
                    c = coded[r][a : a + WINDOW]
                    x[j, : len(c)] = c
                found = self.emissions(x)
                for j, (r, a) in enumerate(part):
                    b = min(a + WINDOW, int(length[r]))
                    e[r, a:b] += found[j, : b - a] * tent[: b - a, None]
                    weight[r, a:b] += tent[: b - a]
            e /= weight[:, :, None]
            for i, path in zip(some, self.viterbi(e, length), strict=True):
                out[i] = [s for s in _spans(path) if _allowed(s[0], texts[i][s[1] : s[2]])]
        return out


def _spans(path: np.ndarray) -> list[tuple[str, int, int]]:
    out, start, kind = [], -1, -1
    for at, tag in enumerate([*path.tolist(), 0]):
        if start >= 0 and (tag == 0 or tag % 2):
            out.append((KINDS[kind], start, at))
            start = -1
        if tag % 2:
            start, kind = at, tag // 2
    return out


def _allowed(kind: str, text: str) -> bool:
    """Whether a decoded span can be what it is taken for."""
    d = _digits(text)
    if kind == "email":
        parts = re.split(r"@|＠|[(\[{<]\s?at\s?[)\]}>]|\sat\s", text, flags=re.IGNORECASE)
        return len(parts) == 2 and all(any(c.isalnum() for c in p) for p in parts) and bool(re.search(r"\.|dot", parts[1], re.IGNORECASE))
    if kind == "ip":
        groups = re.findall("[0-9]+", text)
        return len(groups) == 4 and all(len(g) < 4 and int(g) <= 255 for g in groups)
    if kind == "card":
        return 16 <= len(d) <= 19 and luhn(d)
    return 8 <= len(d) <= 15 and not re.search("[A-Za-z]", text)


#: How people hide an address: what they write for the at sign and for a dot.
_AT_DOT = ((" (at) ", " (dot) "), (" [at] ", " [dot] "), (" @ ", " . "), (" at ", " dot "), ("(at)", "."), ("[at]", "[.]"), (" at ", "."), (" (at) ", "."), ("[at]", "[dot]"), ("＠", "."))
_IP_DOT = (" . ", "[.]", ". ", " dot ", "(.)", "[dot]")
_CARD_GAP = (".", " - ", "/", "  ", "_", "--")


def _hidden(kind: str, text: str, how: int) -> str:
    """The span's text, rewritten the how-th way."""
    if kind == "email":
        at, dot = _AT_DOT[how % len(_AT_DOT)]
        name, _, host = text.partition("@")
        return name + at + host.replace(".", dot)
    if kind == "ip":
        return text.replace(".", _IP_DOT[how % len(_IP_DOT)])
    d = _digits(text)
    if kind == "card":
        return _CARD_GAP[how % len(_CARD_GAP)].join(d[i : i + 4] for i in range(0, len(d), 4))
    tail = d[-10:]
    forms = (f"({tail[:3]}) {tail[3:6]}-{tail[6:]}", f"{tail[:3]}-{tail[3:6]}-{tail[6:]}", f"{tail[:3]}.{tail[3:6]}.{tail[6:]}", f"{tail[:3]} {tail[3:6]} {tail[6:]}", f"({tail[:3]}){tail[3:6]}-{tail[6:]}")
    return forms[how % len(forms)]


def _decoy(r: np.random.Generator) -> str:
    """What has digits or an at and is no personal data."""

    def n(lo: int, hi: int) -> int:
        return int(r.integers(lo, hi))

    kind = n(0, 17)
    day, month, year = n(1, 29), n(1, 13), n(1900, 2100)
    if kind == 0:
        return f"{year}-{month:02d}-{day:02d}"
    if kind == 1:
        return f"{day:02d}.{month:02d}.{year}"
    if kind == 2:
        return f"{month:02d}/{day:02d}/{year}"
    if kind == 3:
        return f"{year}-{month:02d}-{day:02d} {n(0, 24):02d}:{n(0, 60):02d}:{n(0, 60):02d}"
    if kind == 4:
        return f"{n(1990, 2010)}-{n(2010, 2030)}"
    if kind == 5:
        return f"{n(1, 900)},{n(0, 1000):03d}.{n(0, 100):02d}"
    if kind == 6:
        return f"{n(0, 20)}.{n(0, 20)}" + (f".{n(0, 20)}" if n(0, 2) else "")
    if kind == 7:
        return str(n(0, 10 ** n(1, 8)))
    if kind == 8:
        return str(n(10**7, 10 ** n(8, 16)))
    if kind == 9:
        return f"978-{n(0, 10)}-{n(10, 100)}-{n(100000, 1000000)}-{n(0, 10)}"
    if kind == 10:
        return f"{n(256, 999)}.{n(0, 999)}.{n(0, 999)}.{n(256, 999)}"
    if kind == 11:
        return "".join("0123456789abcdef"[i] for i in r.integers(0, 16, n(8, 41)))
    if kind == 12:
        return "".join("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"[i] for i in r.integers(0, 62, n(8, 41)))
    if kind == 13:
        return f"{n(1, 100)} @ {n(1, 100)}.{n(0, 100):02d}"
    if kind == 14:
        return "@" + "".join("abcdefghijklmnopqrstuvwxyz"[i] for i in r.integers(0, 26, n(3, 12)))
    if kind == 15:
        return " - ".join(f"{n(0, 10000):04d}" for _ in range(2))
    return f"({n(1, 100)}) {n(1, 1000)}"


def _invented(kind: str, r: np.random.Generator, known: list[str]) -> str:
    """A value of a kind as the patterns would find it; names are made of known words
    or, one time in three, of letters, so that neither gives them away."""

    def word(lo: int, hi: int) -> str:
        if known and r.integers(3):
            return known[int(r.integers(len(known)))]
        return "".join("abcdefghijklmnopqrstuvwxyz"[i] for i in r.integers(0, 26, int(r.integers(lo, hi))))

    if kind == "email":
        many = int(r.integers(2))
        name = ("", ".", "_", "-")[int(r.integers(4))].join(word(2, 9)[: 1 if many and not i and r.integers(2) else 12] for i in range(many + 1)) + ("", str(r.integers(1, 100)))[int(r.integers(4)) == 0]
        labels = [("", "-")[int(r.integers(5)) == 0].join(word(2, 8) for _ in range(int(r.integers(1, 3)))) + ("", str(r.integers(10)))[int(r.integers(5)) == 0] for _ in range(int(r.integers(1, 3)))]
        return f"{name}@{'.'.join(labels)}.{('com', 'org', 'net', 'de', 'co.uk', 'edu', word(2, 4))[int(r.integers(7))]}"
    if kind == "ip":
        return ".".join(str(x) for x in r.integers(0, (10, 100, 256, 256)[int(r.integers(4))], 4))
    if kind == "card":
        d = "".join(str(x) for x in r.integers(0, 10, 15))
        return next(d + str(c) for c in range(10) if luhn(d + str(c)))
    d = "".join(str(x) for x in r.integers(0, 10, 14))
    forms = (f"+{d[:11]}", f"+{d[0]} ({d[1:4]}) {d[4:7]}-{d[7:11]}", f"+{d[:2]} {d[2:5]} {d[5:8]} {d[8:12]}", f"+{d[:2]}-{d[2:5]}-{d[5:12]}")
    return forms[int(r.integers(len(forms)))]


def _with_decoys(text: str, r: np.random.Generator) -> str:
    """A text with another thing in the place of everything that has a digit or an at:
    whatever stood there, known or not, is not learnt as harmless."""
    bare = re.sub(r"\S*[@＠]\S*|[(\[{<]\s?(?:at|dot)\s?[)\]}>]|\s(?:at|dot)\s", " ", text, flags=re.IGNORECASE)
    return re.sub(r"\S*\d\S*(?:\s+\S*\d\S*)*", lambda m: _decoy(r), bare)


#: Kinds in planted texts: phone numbers, which look most like other numbers, twice.
_OFTEN = ("email", "phone", "ip", "phone", "card", "email", "phone")


def _planted(text: str, n: int, r: np.random.Generator) -> tuple[str, list[tuple[str, int, int]]]:
    """A text with an invented value between two of its words, or one time in four with
    three that few words part; each is hidden or (one time in four) plain. The n-th
    has a kind of its own. About a window of the text is left, so that every step of
    the fit sees a value."""
    places = [0, *(m.end() for m in re.finditer(r"\s", text))]
    at = places[int(r.integers(len(places)))]
    new = text[max(0, at - int(r.integers(0, 45))) : at]
    words = text[at:].split(" ")
    known = re.findall("[a-z]{2,10}", text.lower())
    spans = []
    plain = n // len(_OFTEN) % 4 == 0
    for i in range(1 if r.integers(4) else 3):
        kind = _OFTEN[n % len(_OFTEN)] if i == 0 or r.integers(2) else KINDS[int(r.integers(len(KINDS)))]
        shown = _invented(kind, r, known)
        shown = shown if plain else _hidden(kind, shown, int(r.integers(60)))
        spans.append((kind, len(new), len(new) + len(shown)))
        few = int(r.integers(1, 3))
        new += shown + (" ", ". ", ", ", "\n")[int(r.integers(4))] + " ".join(words[:few]) + " "
        words = words[few:]
    return new + " ".join(words)[: max(4, WINDOW - len(new))], spans


#: Texts with a planted value that are made of all regions together.
PLANTED = 3000


def examples(texts: list[str]) -> list[tuple[str, list[tuple[str, int, int]]]]:
    """Labelled texts: a region that has spans as it stands and with its spans
    rewritten; and every region with decoys in the place of all that has digits or an
    at, bare and with invented values planted in it. A region may hold hidden values
    that no pattern finds, so none is learnt as it stands for having no spans."""
    out = []
    r = np.random.default_rng(5)
    planted = -(-PLANTED // max(1, len(texts)))
    for n, text in enumerate(texts):
        text = text[: 4 * WINDOW]
        spans = sorted(base_spans(text), key=lambda s: s[1])
        spans = [s for i, s in enumerate(spans) if not i or s[1] >= spans[i - 1][2]]
        if spans:
            out += [(text, spans)] * 3
        for how in range(2) if spans else ():
            new, moved, at = "", [], 0
            for kind, a, b in spans:
                new += text[at:a]
                shown = _hidden(kind, text[a:b], int(r.integers(60)))
                moved.append((kind, len(new), len(new) + len(shown)))
                new, at = new + shown, b
            out.append((new + text[at:], moved))
            kind, a, b = moved[n % len(moved)]  # and that span with little about it
            lo, hi = max([0, a - 6 * how, *(e for _, _, e in moved if e <= a)]), min([len(out[-1][0]), b + 12 - 6 * how, *(s for _, s, _ in moved if s >= b)])
            out.append((out[-1][0][lo:hi], [(kind, a - lo, b - lo)]))
        for i in range(planted + max(2, planted // 4)):
            new = _with_decoys(text, r)
            if base_spans(new):
                continue
            out.append(_planted(new, planted * n + i, r) if i < planted else (new[:WINDOW], []))
    return out


def fit(texts: list[str]) -> Tagger | None:
    """A tagger trained on regions of text; None if they hold no span."""
    rows = examples(texts)
    if not any(s for _, s in rows):
        return None
    xs, ys, lengths = [], [], []
    for text, spans in rows:
        code, tag = encode(text), tags(len(text), spans)
        for a in range(0, max(1, len(text) - WINDOW + STRIDE), STRIDE):
            c = code[a : a + WINDOW]
            y = tag[a : a + WINDOW].copy()
            if len(y) and y[0] and y[0] % 2 == 0:
                y[: int(np.argmax(y != y[0])) or len(y)] = 0  # an inside whose begin lies outside
            xs.append(np.pad(c, (0, WINDOW - len(c))))
            ys.append(np.pad(y, (0, WINDOW - len(y))))
            lengths.append(max(1, len(c)))
    model = Tagger()
    model.train(np.array(xs), np.array(ys), np.array(lengths))
    return model


def _scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        out = {k: [] for k in ("n_email", "n_ip", "n_card", "n_phone", "base", "starts", "parts")}
        for t in b["text"].fillna("").tolist():
            base = base_spans(t)
            for kind in KINDS:
                out[f"n_{kind}"].append(sum(s[0] == kind for s in base))
            out["base"].append(joined(base))
            found = regions(t)
            out["starts"].append([a for a, _ in found])
            out["parts"].append([t[a:e] for a, e in found])
        yield pd.DataFrame({"doc_id": b["doc_id"].astype("Int64"), **out})


_SCAN = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base string, starts array<int>, parts array<string>"


def _reader(sent):
    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = sent.value
        for b in batches:
            shas, spans = [], []
            parts = [list(p) for p in b["parts"]]
            flat = [t for p in parts for t in p]
            decoded = iter(model.decode(flat) if model else [[] for _ in flat])
            for base, starts in zip(b["base"], b["starts"], strict=True):
                own = [(k, int(s), int(e)) for k, s, e in (x.split(":") for x in base.split(",") if x)]
                new = [(k, int(a) + s, int(a) + e) for a in starts for k, s, e in next(decoded)]
                new = [x for x in new if not any(s < x[2] and x[1] < e for _, s, e in own)]
                shas.append(hashlib.sha256(base.encode()).hexdigest())
                spans.append(joined(sorted(own + new, key=lambda x: (KINDS.index(x[0]), x[1]))))
            yield b[["doc_id", "n_email", "n_ip", "n_card", "n_phone"]].assign(base_sha256=shas, spans=spans)

    return read


def personal_data(docs: DataFrame, max_regions: int = MAX_REGIONS) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans of every row of
    docs. Runs jobs; the driver gets at most max_regions regions of text, cut to
    four windows each, to learn from."""
    first = cut(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInPandas(_scan, _SCAN))
    each = first.select(F.xxhash64("doc_id").alias("h"), (F.col("base") != "").alias("found"), F.explode("parts").alias("part")).withColumn("part", F.substring("part", 1, 4 * WINDOW))
    third = max_regions // 3
    some = each.filter("found").orderBy("h", "part").limit(2 * third).union(each.filter("not found").orderBy("h", "part").limit(third))
    model = fit([r["part"] for r in some.collect()])
    sent = docs.sparkSession.sparkContext.broadcast(model)
    return first.mapInPandas(_reader(sent), "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")


def pii_query(docs: DataFrame) -> DataFrame:
    """personal_data() of every row of docs. Runs jobs."""
    return personal_data(docs)
