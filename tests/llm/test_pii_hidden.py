"""Values hidden in the very text that the tagger is fitted on."""

import random

from ravelin.llm import pii


def hidden(r, kind):
    if kind == "email":
        at, dot = r.choice([(" (at) ", " (dot) "), (" [at] ", " [dot] "), (" at ", " dot "), ("[at]", ".")])
        return f"{r.choice(['jane', 'bob.smith', 'karl_m', 'info'])}{at}northwind{dot}com"
    if kind == "ip":
        return r.choice(["[.]", " . ", " dot "]).join(str(r.randrange(20, 255)) for _ in range(4))
    d = [r.randrange(10) for _ in range(15)]
    s = "".join(map(str, d))
    return r.choice([".", "/", "--"]).join(t[i : i + 4] for t in [next(s + c for c in "0123456789" if pii.luhn(s + c))] for i in range(0, 16, 4))


def test_hidden_values_of_the_fitted_text_are_found():
    """One text in six holds a hidden value and no pattern span: none of these texts may
    be learnt as harmless."""
    r = random.Random(6)
    words = [x for x in "anon the thion eau ment de la que stre onder in wol haus und see wind blau erst voll kalt".split()]
    texts, want = [], []
    for i in range(120):
        before, after = ([r.choice(words) for _ in range(12)] for _ in range(2))
        value = f"{r.choice(words)}@mail.example.com" if i % 3 == 0 else f"+1 (415) 555-{r.randrange(1000, 9999)}" if i % 3 == 1 else str(r.randrange(1900, 2100))
        kind = ("email", "ip", "card")[i // 6 % 3]
        value = hidden(r, kind) if i % 6 == 5 else value
        texts.append(f"{' '.join(before)} {value} {' '.join(after)}")
        at = len(" ".join(before)) + 1
        want.append({(kind, at, at + len(value))} if i % 6 == 5 else set())
    tagger = pii.fit([t[a:b] for t in texts for a, b in pii.regions(t)])
    found = missed = false = 0
    for text, spans in zip(texts, want, strict=True):
        regions = pii.regions(text)
        got = {(k, a + s, a + e) for (a, _), some in zip(regions, tagger.decode([text[a:b] for a, b in regions]), strict=True) for k, s, e in some}
        found, missed = found + len(got & spans), missed + len(spans - got)
        false += len({s for s in got - spans if not pii.base_spans(text)})
    assert found >= 0.6 * (found + missed) and false <= 6, (found, missed, false)


def test_decoys_take_the_place_of_what_may_be_hidden():
    import numpy as np

    r = np.random.default_rng(1)
    for text in ("see 415-555-0100 now", "jane (at) northwind (dot) com wrote", "10[.]1[.]2[.]3", "a@b", ""):
        new = pii._with_decoys(text, r)
        assert "(at)" not in new and "415-555-0100" not in new and "10[.]1" not in new and "a@b" not in new
    for n in range(200):
        text, spans = pii._planted("some words stand here and there", n, r)
        assert spans and all(0 <= a < e <= len(text) for _, a, e in spans)
