import hashlib
import random
import re

import numpy as np
import pytest

from ravelin.llm import pii
from tests.llm.helpers import documents

R = random.Random(3)


def luhn_card(n=16):
    body = "4" + "".join(R.choice("0123456789") for _ in range(n - 2))
    return next(body + c for c in "0123456789" if pii.luhn(body + c))


def by_definition(text):
    text = text or ""
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub("[^0-9]", "", m[0])
        if 16 <= len(d) <= 19 and pii.luhn(d):
            out.append(("card", *m.span()))
    out += [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 8 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return out


CASES = [
    "", None, "a@b.c x.y+z@mail-1.example.com, @no.com a@b", "a@b@c.d.e", "x@y.z@w.v", "1.2.3.4 256.1.1.1 1.2.3.4.5.6.7.8 01.002.3.4 1.2.3", "+1 (555) 010-9999, +12 +1 2 3 4 5 6 7 8 9 0 1 2 3 4 5 6 7",
    "4111 1111 1111 1111 4111-1111-1111-1112 4111111111111111", "é@b.co ünï a@b.cö 9" + "1" * 3000, "a" * 4000 + "@" + "b" * 50, "+1-2 (3) 4.5 6 7 8 9", "%@-.-", "1..2.3.4 9.9.9.9.",
]


def test_base_spans():
    for t in CASES:
        assert pii.base_spans(t or "") == by_definition(t)


def corpus(n=200):
    words = ["anon", "thly", "ered", "inth", "ou", "shea", "tion", "rest"]
    texts = []
    for i in range(n):
        w = [R.choice(words) for _ in range(30)]
        pii_text = [f"{R.choice(words)}.{R.randint(1, 99)}@mail{R.randint(1, 9)}.example.com", ".".join(str(R.randint(0, 255)) for _ in range(4)), luhn_card(), f"+1 ({R.randint(200, 999)}) 555-{R.randint(1000, 9999)}"][i % 4]
        texts.append(" ".join([*w[:15], pii_text, *w[15:]]) if i % 5 else " ".join([*w[:15], str(R.randint(0, 9999)), *w[15:]]))
    return texts


@pytest.fixture(scope="module")
def tagger():
    texts = corpus()
    return pii.fit([t[a:b] for t in texts for a, b in pii.regions(t)])


def test_tagger_on_new_text(tagger):
    texts = corpus(80)
    parts = [t[a:b] for t in texts for a, b in pii.regions(t)]
    want = [set(pii.base_spans(p)) for p in parts]
    got = [set(d) for d in tagger.decode(parts)]
    hit = sum(len(a & b) for a, b in zip(want, got, strict=True))
    assert hit / sum(map(len, want)) > 0.9 and hit / max(1, sum(map(len, got))) > 0.9


def test_gradients_by_differences():
    r = np.random.default_rng(0)
    m = pii.Tagger(1)
    x, y = r.integers(3, 40, (3, 7)), np.array([[0, 1, 2, 2, 0, 3, 4], [0, 0, 5, 6, 0, 0, 0], [1, 2, 0, 0, 0, 0, 0]])
    length = np.array([7, 5, 3])

    def loss():
        total = 0.0
        e = m.emissions(x).astype(float)
        trans = m.p["trans"].astype(float) + m.bad
        for i in range(3):
            a = e[i, 0] + m.bad[0]
            s = e[i, 0, y[i, 0]] + m.bad[0][y[i, 0]]
            for t in range(1, length[i]):
                a = np.log(np.exp(a[:, None] + trans - a.max()).sum(0)) + a.max() + e[i, t]
                s += trans[y[i, t - 1], y[i, t]] + e[i, t, y[i, t]]
            total += np.log(np.exp(a - a.max()).sum()) + a.max() - s
        return total / 3

    grad = m._gradients(x, y, length)
    for name, at in (("out", (3, 2)), ("bias", (1,)), ("trans", (1, 2)), ("hf", (2, 5)), ("xb", (4, 30)), ("embed", (int(x[0, 2]), 1)), ("cf", (8,))):
        old = float(m.p[name][at])
        m.p[name][at] = old + 1e-2
        up = loss()
        m.p[name][at] = old - 1e-2
        down = loss()
        m.p[name][at] = old
        assert grad[name][at] == pytest.approx((up - down) / 2e-2, abs=3e-3)


def test_long_regions_are_settled_as_one(tagger):
    text = "anon thly " * 3 + " ".join(f"{R.randint(0, 255)}.1.2.3 thly" for _ in range(40))
    assert [s for s in tagger.decode([text])[0]] and tagger.decode([""]) == [[]]


def test_query(spark):
    texts = [*corpus(60), None, "", "long words " * 20000, *[c for c in CASES if c]]
    got = sorted(pii.pii_query(documents(spark, texts, extra=True)).collect())
    assert len(got) == len(texts)
    for r, t in zip(got, texts, strict=True):
        base = by_definition(t)
        assert (r["n_email"], r["n_ip"], r["n_card"], r["n_phone"]) == tuple(sum(k == s[0] for s in base) for k in pii.KINDS)
        text = ",".join(f"{k}:{a}:{b}" for k, a, b in base)
        assert r["base_sha256"] == hashlib.sha256(text.encode()).hexdigest()
        assert set(filter(None, text.split(","))) <= set(r["spans"].split(","))
    none = pii.pii_query(documents(spark, ["no data here", None])).collect()
    assert {r["spans"] for r in none} == {""}
    assert pii.pii_query(documents(spark, ["a"]).limit(0)).count() == 0
