"""Line dedup: equal lines and lines within an edit distance, in DataFrame
functions alone.

Every line but the empty one is compared. Equal lines are one class, represented
by its first occurrence (least doc_id, then line number). Different lines link if
they lie within the edits that the shorter one allows: none below 5 characters,
one below 10, else `EDITS`. A line of length n with t edits is cut into t + 1
segments, of which one must lie unchanged in any partner; so segments are
indexed by (t, number, n, content) and each line probes, for every length from its
own down, the substrings whose place the number of edits on either side allows.

The texts are split once, into a table of the different lines: two hashes, the
first place, the keys. One shuffle of the keys tells, by a window over each key,
which lines share one with another line; a line leaves it once, however many
partners it has. Only those lines are fetched and joined by their keys. Pairs
whose sketches (parities of hashed pairs of neighbouring characters, of which an
edit turns four at most) differ too far are dropped inside that join, those whose
letter counts do after it, and what is left, less its common beginning and end, is
verified by a banded bit-parallel edit distance: for each number of edits a bit-vector over the 2t + 1 diagonals of
the band, all of whose cells one column of the comparison moves on by shifts and
ors. Links are counted by line and not kept as pairs. A line goes if an equal or
linked one came earlier.

Hashes of lines to fetch are broadcast only up to `MAX_SENT`, else joined.

Defined cases: null text has no lines; rows that share a doc_id count as one
document; a null doc_id comes first; of ties in the order of lines there are none
but repeated rows, whose equal lines stand at one place; very long lines are
compared like any others (the band has the same width for every length); columns
with clashing names are neither read nor changed; an empty table gives an empty
result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ravelin.llm.common import cut, fresh

EDITS = 2
#: Least lengths of the shorter line for one edit, two and so on: a fifth of it at most.
PER_EDIT = 5
#: Hashes of lines (8 bytes each) that are broadcast at most.
MAX_SENT = 500_000
#: Characters whose counts rule pairs out: an edit takes one away at most and adds
#: one; any ASCII characters do no harm.
LETTERS = "etanoisrhldcum0123456789"
#: Bits of a line's sketch that an edit turns at most: a replaced character takes two
#: pairs of neighbours away and brings two, an added or a lost one three in all.
PER_SKETCH = 4


#: First of the halving steps that take equal beginnings and ends off two lines.
END_STEP = 4096


def allowed(n: int, edits: int = EDITS) -> int:
    """Edits between two different lines of which the shorter has n characters."""
    return min(edits, n // PER_EDIT)


def _allowed(n: Column, edits: int) -> Column:
    return F.least(F.floor(n / F.lit(PER_EDIT)), F.lit(edits)).cast("int")


def _probes(edits: int, less: int) -> set[tuple[int, int]]:
    """(segment, move) of the probes for lines shorter by less. Of equal lengths
    one line of a pair moves up, and where nothing moves the index key serves."""
    out = set()
    for i in range(edits + 1):
        lo = max(-i, less - (edits - i)) if less else 1
        out |= {(i, move) for move in range(lo, min(i, less + (edits - i)) + 1)}
    return out


def with_keys(rows: DataFrame, edits: int = EDITS) -> DataFrame:
    """rows (line and others, none named like the ones made here) with `keys`: all
    keys of a line, null where it has fewer; the lowest bit tells index (1) from
    probe (0). For each shorter length m: t edits, k the least size of a segment, r
    how many of the last ones are one longer. Columns of their own keep the
    generated code short enough to be compiled."""
    cols = rows.columns
    rows = rows.withColumn("n", F.char_length("line"))
    for less in range(edits + 1):
        rows = rows.withColumn(f"t_{less}", F.expr(f"int(least((n - {less}) div {PER_EDIT}, {edits}))"))
        rows = rows.select("*", F.expr(f"int((n - {less}) div (t_{less} + 1))").alias(f"k_{less}"), F.expr(f"(n - {less}) % (t_{less} + 1)").alias(f"r_{less}"))
    out = []
    for less in range(edits + 1):
        slots: dict[tuple[int, int, int], list[str]] = {}  # (segment, move, side) -> the edits that have it
        for own in range(max(less, 1), edits + 1):
            for i, move, side in [(i, 0, 1) for i in range(own + 1) if not less] + [(i, move, 0) for i, move in _probes(own, less)]:
                slots.setdefault((i, move, side), []).append(str(own))
        t, k, r = f"t_{less}", f"k_{less}", f"r_{less}"
        for (i, move, side), who in sorted(slots.items()):
            part = f"substring(line, {k} * {i} + greatest({r} + {i - 1} - {t}, 0) + {move + 1}, {k} + int({r} > {t} - {i}))"
            out.append(f"CASE WHEN {t} IN ({', '.join(who)}) THEN xxhash64({t}, {i}, n - {less}, {part}) {'| 1' if side else '& -2'} END")
    return rows.select(*cols, F.expr(f"array({', '.join(out)})").alias("keys"))


def with_sketch(rows: DataFrame) -> DataFrame:
    """rows (line and others) with `odd0` and `odd1`: 128 bits, each saying whether an
    odd number of the line's pairs of neighbouring characters hash to it; the last
    character is paired with nothing."""
    chars, grams = fresh(rows, "chars", "grams")
    one = F.lit(1).cast("long")

    def half(upper: int) -> Column:
        def turn(bits: Column, h: Column) -> Column:
            here = F.shiftright(h, 6).bitwiseAND(F.lit(1)) == upper
            return bits.bitwiseXOR(F.when(here, F.call_function("shiftleft", one, h.bitwiseAND(F.lit(63)).cast("int"))).otherwise(F.lit(0).cast("long")))

        return F.aggregate(F.col(grams), F.lit(0).cast("long"), turn)

    rows = rows.withColumn(chars, F.split("line", ""))
    rows = rows.withColumn(grams, F.zip_with(F.col(chars), F.slice(F.col(chars), F.lit(2), F.size(chars)), lambda x, y: F.xxhash64(x, F.coalesce(y, F.lit("")))))
    return rows.withColumns({"odd0": half(0), "odd1": half(1)}).drop(chars, grams)


def _letters_apart(a: str, b: str) -> Column:
    """By how much the counts of LETTERS of two string columns differ in all: an
    edit takes away one letter at most and adds one."""
    grown = f"(octet_length({a}) - octet_length({b}))"
    return F.expr(" + ".join(f"abs({grown} - octet_length(replace({a}, '{ch}', '')) + octet_length(replace({b}, '{ch}', '')))" for ch in LETTERS))


def with_distance(rows: DataFrame, a: str, b: str, out: str, edits: int = EDITS) -> DataFrame:
    """rows with the edit distance of two string columns if it is at most edits,
    else null.

    Bit p of the e-th vector says that after j characters of b, i = j + p - edits
    characters of a can be matched with at most e edits. A character moves a
    match along the diagonal, a replacement to the next vector, an insertion one
    diagonal down and a deletion one up, in the column that it leads to.
    """
    x, y, apart = fresh(rows, "x", "y", "apart")
    n, m = F.char_length(a), F.char_length(b)
    chars = [F.when(F.col(c) != "", F.split(c, "")).otherwise(F.array().cast("array<string>")) for c in (a, b)]  # cut once, not for each character
    rows = rows.withColumn(apart, n - m).withColumns({x: chars[0], y: chars[1]})
    band = F.lit((1 << (2 * edits + 1)) - 1)

    def matches(ch: Column, j: Column) -> Column:
        bits = F.lit(0)
        for p in range(2 * edits + 1):
            bits = bits.bitwiseOR(F.when(F.get(F.col(x), j + (p - edits)) == ch, 1 << p).otherwise(0))
        return bits

    def column(state: Column, bits: Column) -> Column:
        new: list[Column] = []
        for e in range(edits + 1):
            row = state[f"r{e}"].bitwiseAND(bits)
            if e:
                before = state[f"r{e - 1}"]
                row = row.bitwiseOR(before).bitwiseOR(F.shiftright(before, 1)).bitwiseOR(F.shiftleft(new[-1], 1))
            new.append(row.bitwiseAND(band))
        return F.struct(*[c.alias(f"r{e}") for e, c in enumerate(new)])

    def least(state: Column) -> Column:
        return F.coalesce(*[F.when(F.getbit(state[f"r{e}"], F.col(apart) + edits) == 1, e) for e in range(edits + 1)])

    begin = F.struct(*[F.lit(((1 << (e + 1)) - 1) << edits).alias(f"r{e}") for e in range(edits + 1)])
    found = F.when(F.abs(apart) <= edits, F.aggregate(F.transform(F.col(y), matches), begin, column, least))
    return rows.withColumn(out, found).drop(x, y, apart)


def without_common_ends(rows: DataFrame, a: str, b: str) -> DataFrame:
    """rows with the string columns a and b replaced by what lies between their
    common beginning and their common end, reversed: of the same edit distance. Up
    to 2 * `END_STEP` - 1 characters are taken off either end, found by halving
    steps."""
    (at,) = fresh(rows, "at")
    for _ in range(2):
        step = END_STEP
        rows = rows.withColumn(at, F.lit(0))
        while step:
            parts = [F.substring(F.col(c), F.col(at) + 1, F.lit(step)) for c in (a, b)]
            same = (parts[0] == parts[1]) & (F.char_length(parts[0]) == step)
            rows = rows.withColumn(at, F.col(at) + F.when(same, step).otherwise(0))
            step //= 2
        rows = rows.withColumns({c: F.reverse(F.substring(F.col(c), F.col(at) + 1, F.char_length(c))) for c in (a, b)})
    return rows.drop(at)


def lines(docs: DataFrame) -> DataFrame:
    """(doc_id, pos, line, k1, k2) of every line that isn't empty; k1 and k2 are
    independent hashes of it."""
    each = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.posexplode(F.split(F.col("text").cast("string"), "\n", -1)).alias("pos", "line"))
    return each.filter("line <> ''").select("*", F.xxhash64("line").alias("k1"), F.xxhash64(F.lit(7), F.col("line")).alias("k2"))


def different(docs: DataFrame, edits: int = EDITS) -> DataFrame:
    """(k1, k2, doc_id, pos, keys) of the first occurrence of every different line.
    Runs a job; the table stays in the shared folder."""
    each = with_keys(lines(docs), edits).drop("line")
    found = each.groupBy("k1", "k2").agg(F.min(F.struct("doc_id", "pos")).alias("first"), F.any_value("keys").alias("keys"))
    return cut(found.select("k1", "k2", "first.doc_id", "first.pos", "keys"))


def partnered(found: DataFrame) -> DataFrame:
    """(id): k1 of the lines that share a key, on the index side of one at least,
    with another line. One shuffle; a line's key is one row."""
    rows = found.select(F.col("k1").alias("id"), F.explode("keys").alias("v")).filter("v IS NOT NULL")
    rows = rows.select("id", F.shiftright("v", 1).alias("key"), F.col("v").bitwiseAND(F.lit(1)).cast("byte").alias("side"))
    w = Window.partitionBy("key")
    rows = rows.select("id", F.max("side").over(w).alias("indexed"), F.min("id").over(w).alias("lo"), F.max("id").over(w).alias("hi"))
    return rows.filter("indexed = 1 AND lo <> hi").select("id").distinct()


def candidates(some: DataFrame, edits: int = EDITS) -> DataFrame:
    """Pairs (a, b) of the k1 of different lines (k1, line) that share a key and
    whose sketches do not rule them out."""
    own = with_keys(with_sketch(some.select("k1", "line")), edits).select("k1", "odd0", "odd1", F.explode("keys").alias("v"))
    own = own.filter("v IS NOT NULL").select("k1", "odd0", "odd1", F.shiftright("v", 1).alias("key"), (F.col("v").bitwiseAND(F.lit(1)) == 1).alias("indexed"))
    own = cut(own)  # adaptive execution plans the join anew after each stage: without the long expressions
    index = own.filter("indexed").select("key", F.col("k1").alias("b"), F.col("odd0").alias("b0"), F.col("odd1").alias("b1"))
    probe = own.select(F.col("key").alias("pkey"), F.col("k1").alias("a"), F.col("odd0").alias("a0"), F.col("odd1").alias("a1"), F.col("indexed").alias("both"))
    once = ~F.col("both") | (F.col("a") < F.col("b"))  # two index keys meet from either side
    turned = F.bit_count(F.col("a0").bitwiseXOR(F.col("b0"))) + F.bit_count(F.col("a1").bitwiseXOR(F.col("b1")))
    near = (F.col("pkey") == F.col("key")) & (F.col("a") != F.col("b")) & once & (turned <= PER_SKETCH * edits)
    return cut(probe.join(index, near).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())


def linked(docs: DataFrame, found: DataFrame, edits: int = EDITS) -> DataFrame:
    """(k1, k2, doc_id, n_links, near) of the lines with links: how many different
    lines link to it, and whether one of them came earlier. Runs jobs."""
    ids = cut(partnered(found))
    sent = F.broadcast(ids) if ids.count() <= MAX_SENT else ids
    some = lines(docs).join(sent, F.col("k1") == F.col("id"), "left_semi")
    some = cut(some.groupBy("k1", "k2").agg(F.min(F.struct("doc_id", "pos")).alias("first"), F.any_value("line").alias("line")))

    def side(name: str, key: str) -> DataFrame:
        return some.select(F.col("k1").alias(key), F.struct("first.doc_id", "first.pos", "k1", "k2").alias(name), F.col("line").alias(f"{name}_line"))

    both = candidates(some, edits).join(side("u", "a"), "a").join(side("v", "b"), "b").filter(_letters_apart("u_line", "v_line") <= 2 * edits)
    n = max(12, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    both = both.repartition(n, "a", "b")  # few rows, each of them costly: to all cores
    both = both.withColumn("most", _allowed(F.least(F.char_length("u_line"), F.char_length("v_line")), edits))
    both = with_distance(without_common_ends(both, "u_line", "v_line"), "u_line", "v_line", "apart", edits)
    both = cut(both.select("u", "v", "most", "apart")).filter("apart <= most")  # a filter moved before the columns it reads would compute them anew for each character
    ends = both.select(F.explode(F.array(F.struct(F.col("u").alias("own"), (F.col("v") < F.col("u")).alias("near")), F.struct(F.col("v").alias("own"), (F.col("u") < F.col("v")).alias("near")))).alias("end"))
    ends = ends.select(F.col("end.own.k1").alias("k1"), F.col("end.own.k2").alias("k2"), F.col("end.own.doc_id").alias("doc_id"), F.col("end.near").cast("int").alias("near"))
    return cut(ends.groupBy("k1", "k2", "doc_id").agg(F.count(F.lit(1)).alias("n_links"), F.max("near").alias("near")))


def line_dedup(docs: DataFrame, edits: int = EDITS) -> DataFrame:
    """One row for each doc_id: n_lines, n_equal and n_near (lines that go because
    an equal or linked one came earlier), n_links (of the lines that first occur
    here), dropped (their numbers, ascending). Runs jobs."""
    found = different(docs, edits)
    links = linked(docs, found, edits).select(F.col("k1").alias("g1"), F.col("k2").alias("g2"), "near", "n_links")
    first = found.join(links, (F.col("k1") == F.col("g1")) & (F.col("k2") == F.col("g2")), "left").withColumn("near", F.coalesce("near", F.lit(0)))
    by_doc = first.groupBy(F.col("doc_id").alias("fid")).agg(F.collect_list(F.when(F.col("near") == 0, F.col("pos"))).alias("kept"), F.sum("near").cast("long").alias("n_near"), F.sum("n_links").alias("n_links"))
    split = F.split(F.col("text").cast("string"), "\n", -1)
    long = F.filter(F.transform(split, lambda x, i: F.when(x != "", i)), lambda i: i.isNotNull())
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.greatest(F.size(split), F.lit(0)).cast("long").alias("lines"), F.coalesce(long, F.array().cast("array<int>")).alias("long"))
    base = base.groupBy("doc_id").agg(F.sum("lines").alias("n_lines"), F.flatten(F.collect_list("long")).alias("long"))
    out = base.join(by_doc, F.col("doc_id").eqNullSafe(F.col("fid")), "left")
    kept = F.coalesce("kept", F.array().cast("array<int>"))
    near = F.coalesce("n_near", F.lit(0)).cast("long")
    return out.select(
        "doc_id",
        "n_lines",
        (F.size("long") - F.size(kept) - near).cast("long").alias("n_equal"),
        near.alias("n_near"),
        F.coalesce("n_links", F.lit(0)).alias("n_links"),
        F.array_sort(F.array_except("long", kept)).alias("dropped"),
    )


def deduplicate(docs: DataFrame, edits: int = EDITS) -> DataFrame:
    """docs with the dropped lines taken out of their texts. Runs jobs."""
    did, dropped = fresh(docs, "did", "dropped")
    gone = line_dedup(docs, edits).select(F.col("doc_id").alias(did), F.col("dropped").alias(dropped))
    rows = docs.join(gone, docs["doc_id"].cast("long").eqNullSafe(gone[did]), "left")
    split = F.split(F.col("text").cast("string"), "\n", -1)
    text = F.array_join(F.filter(split, lambda x, i: ~F.array_contains(F.col(dropped), i)), "\n")
    return rows.withColumn("text", F.when(F.col("text").isNotNull(), text)).select(*[F.col(f"`{c}`") for c in docs.columns])


def line_dedup_query(docs: DataFrame) -> DataFrame:
    """line_dedup() of all documents and all lines. Runs jobs."""
    return line_dedup(docs)
