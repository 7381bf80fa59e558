import random
from collections import defaultdict

import pytest

from ravelin.llm import linededup as ld
from tests.llm.helpers import documents


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        new = [i + 1]
        for j, y in enumerate(b):
            new.append(min(row[j] + (x != y), row[j + 1] + 1, new[j] + 1))
        row = new
    return row[-1]


def expected(texts, edits=ld.EDITS):
    first, every = {}, []
    for d, t in enumerate(texts):
        for p, line in enumerate((t or "").split("\n") if t is not None else []):
            every.append((d, p, line))
            if line:
                first.setdefault(line, (d, p))
    links = defaultdict(set)
    for a in first:
        for b in first:
            most = ld.allowed(min(len(a), len(b)), edits)
            if a < b and abs(len(a) - len(b)) <= most and distance(a, b) <= most:
                links[a].add(b)
                links[b].add(a)
    out = {d: [d, 0, 0, 0, 0, []] for d in range(len(texts))}
    for d, p, line in every:
        r = out[d]
        r[1] += 1
        if not line:
            continue
        if first[line] != (d, p):
            r[2] += 1
            r[5].append(p)
            continue
        r[4] += len(links[line])
        if any(first[o] < first[line] for o in links[line]):
            r[3] += 1
            r[5].append(p)
    return [tuple(r) for _, r in sorted(out.items())]


BASE = ["the quick brown fox jumps over it", "an entirely different line of text, longer", "Zeile mit Umläuten äöüß und mehr Wörtern darin", "0123456789" * 6]


def variants():
    texts = []
    for i in range(60):
        b = BASE[i % 4]
        at = (i * 7) % (len(b) - 2)
        how = i % 6
        line = [b, b[:at] + "#" + b[at + 1 :], b[:at] + b[at + 1 :], b[:at] + "+" + b[at:], b[:at] + b[at + 2 :], b[:at] + "ab" + b[at + 1 :][: len(b)]][how]
        texts.append("\n".join(["short", line, f"unique line number {i} of the test {i * i}", line if i % 10 == 0 else ""]))
    return texts


def of_all_lengths():
    """Lines of 0 to 200 characters over few letters, with up to three edits."""
    r = random.Random(10)
    out = []
    for n in [*range(27), 40, 63, 64, 65, 130, 200]:
        line = "".join(r.choice("abcé ") for _ in range(n))
        out.append(line)
        for _ in range(4):
            x = list(line)
            for _ in range(r.randint(0, 3)):
                at = r.randint(0, len(x))
                how = r.randint(0, 2)
                x[at : at + (how != 2)] = [] if how == 1 else [r.choice("abcé +")]
            out.append("".join(x))
    r.shuffle(out)
    return ["\n".join(out[i : i + 7]) for i in range(0, len(out), 7)]


def templates():
    return ["\n".join(f"Page {i} of 600 in this book" for i in range(d, d + 12)) for d in range(0, 96, 12)]


@pytest.mark.parametrize("texts", [variants(), of_all_lengths(), templates(), ["", None, "only\nshort"], ["x" * 50 + "\n" + "x" * 51 + "\n" + "x" * 54]])
def test_against_brute_force(spark, texts):
    got = sorted(tuple(r) for r in ld.line_dedup(documents(spark, texts, extra=True)).collect())
    assert got == expected(texts)


def test_bit_parallel_distance(spark):
    r = random.Random(3)
    words = ["", "a", *("".join(r.choice("abü") for _ in range(r.randint(0, 90))) for _ in range(60))]
    pairs = [(w, v) for w in words[:20] for v in words[:20]]
    for w in words:
        x = list(w)
        for _ in range(r.randint(0, 4)):
            x[r.randint(0, len(x)) :][:1] = []
            x.insert(r.randint(0, len(x)), r.choice("abx"))
            del x[r.randrange(len(x))]
        pairs.append((w, "".join(x)))
    df = spark.createDataFrame(pairs, "a string, b string")
    for edits in (1, 2, 4):
        for row in ld.with_distance(df, "a", "b", "d", edits).collect():
            true = distance(row["a"], row["b"])
            assert row["d"] == (true if true <= edits else None), row


def test_text_without_dropped_lines(spark):
    line = "a line that is long enough to count"
    got = {r["doc_id"]: r["text"] for r in ld.deduplicate(documents(spark, [f"{line}\nend", f"start\n{line}", None])).collect()}
    assert got == {0: f"{line}\nend", 1: "start", 2: None}
    assert ld.line_dedup(documents(spark, ["a"]).limit(0)).count() == 0


def test_query_drops_equal_short_lines(spark):
    texts = ["Les.\n\nAnd ornd.\nLes.", None, "Les.\nLes!\n\n" + BASE[0], BASE[0] + "\nAnd ornd.\nx", ""]
    got = sorted(tuple(r) for r in ld.line_dedup_query(documents(spark, texts, extra=True)).collect())
    assert got == [(0, 4, 1, 0, 0, [3]), (1, 0, 0, 0, 0, []), (2, 4, 1, 0, 0, [0]), (3, 3, 2, 0, 0, [0, 1]), (4, 1, 0, 0, 0, [])]
    assert [r["text"] for r in ld.deduplicate(documents(spark, texts)).orderBy("doc_id").collect()] == ["Les.\n\nAnd ornd.", None, "Les!\n\n" + BASE[0], "x", ""]


def test_an_edit_turns_four_bits_of_a_sketch_at_most(spark):
    r = random.Random(4)
    pairs = []
    for n in [1, 2, 3, 4, 9, 40, 200] * 30:
        line = "".join(r.choice("abü ") for _ in range(n))
        at, how = r.randrange(n), r.randint(0, 2)
        pairs.append((line, [line[:at] + "x" + line[at + 1 :], line[:at] + line[at + 1 :], line[:at] + "bü"[at % 2] + line[at:]][how]))
    one, two = ([(x.odd0, x.odd1) for x in ld.with_sketch(spark.createDataFrame([(i, p[side]) for i, p in enumerate(pairs)], "i int, line string")).orderBy("i").collect()] for side in (0, 1))
    turned = [sum((x ^ y).bit_count() if x ^ y >= 0 else ((x ^ y) % 2**64).bit_count() for x, y in zip(p, q)) for p, q, w in zip(one, two, pairs) if w[1]]
    assert max(turned) == ld.PER_SKETCH
    other = ld.with_sketch(spark.createDataFrame([("the quick brown fox",), ("a slow yellow dog at",)], "line string")).collect()
    assert (other[0].odd0 ^ other[1].odd0) != 0


def test_common_ends_are_taken_off_without_a_change_of_distance(spark):
    r = random.Random(5)
    pairs = [("aaa", "aa"), ("", "b"), ("same", "same"), ("aXb", "aYb"), ("abab", "ab")]
    for n in [1, 5, 30, 90] * 8:
        w = "".join(r.choice("abü") for _ in range(n))
        at = r.randrange(n)
        pairs.append((w, w[:at] + r.choice("abü") * r.randint(0, 2) + w[at + r.randint(0, 2) :]))
    got = ld.without_common_ends(spark.createDataFrame([(i, *p, *p) for i, p in enumerate(pairs)], "i int, a string, b string, x string, y string"), "a", "b").collect()
    for row in got:
        assert distance(row["a"], row["b"]) == distance(row["x"], row["y"]), row
        assert not (row["a"] and row["b"]) or (row["a"][0] != row["b"][0] and row["a"][-1] != row["b"][-1]), row
