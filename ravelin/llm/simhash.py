"""SimHash near-duplicates, found with pivot distance tables.

Fingerprints are 64-bit majority votes over the hashes of three-word shingles.
Two fingerprints link at `max_bits` (3) or fewer differing bits. Candidate pairs
come from blocks: of `2 * max_bits` blocks of bits, any linked pair agrees on
`max_bits` whole blocks, so one table for each choice of that many blocks sees
every link. Inside a bucket the distances to many reference fingerprints
(pivots) are laid out once; a pair whose coordinates differ by more than
`max_bits` anywhere is discarded (triangle inequality), and what survives is
verified bit by bit. Buckets are of distinct fingerprints, and those above
`block_rows` are dealt out as pairs of salted blocks, so no task ever holds a
whole hot bucket. A bucket passes on a spanning forest instead of its pairs:
components lose nothing by that.

Defined cases: null text is the empty text; texts without words have fingerprint
zero and link like any other; fewer than three words make one shingle; repeated
rows and ids keep a row each; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ravelin.llm.common import checkpoint, cut, fresh, release, short_batches

SEED = 42
SHINGLE = 3
MAX_BITS = 3
#: Rows of a bucket that one task compares with as many others at most.
BLOCK_ROWS = 1500
PIVOTS = 16
_UNION_PAIRS = 500_000
#: Rows of two numbers that are broadcast at most.
MAX_SENT = 500_000


def fingerprint(text: str | None) -> int:
    """The unsigned 64-bit fingerprint of one text."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: only A-Z change, only ASCII white space splits
    n = len(words)
    if not n:
        return 0
    if n < SHINGLE:
        hashes = np.array([xxhash.xxh64_intdigest(b" ".join(words), SEED)], np.uint64)
    else:
        joined = b" ".join(words)
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1) - 1
        starts = np.concatenate(([0], ends[:-1] + 1))
        h = xxhash.xxh64_intdigest
        hashes = np.fromiter((h(joined[a:b], SEED) for a, b in zip(starts[: n - SHINGLE + 1].tolist(), ends[SHINGLE - 1 :].tolist(), strict=True)), np.uint64, n - SHINGLE + 1)
    counts = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 4096):
        counts += np.unpackbits(hashes[i : i + 4096].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(hashes), bitorder="little").view(np.uint64)[0])


def _fingerprints(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        fp = np.fromiter((fingerprint(t) for t in b["text"]), np.uint64, len(b)).view(np.int64)
        yield pd.DataFrame({"doc_id": b["doc_id"].astype("Int64"), "fp": fp, "h": b["h"]})
        release()


def with_fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp, h) of every row of docs; fp as a signed long, h a hash of the text."""
    short_batches(docs.sparkSession)
    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("h")).mapInPandas(_fingerprints, "doc_id long, fp long, h long")


def table_masks(max_bits: int = MAX_BITS) -> list[int]:
    """A bit mask for each table: `max_bits` of `2 * max_bits` blocks (all bits for 0)."""
    blocks = 2 * max_bits
    if not blocks:
        return [(1 << 64) - 1]
    edges = [64 * i // blocks for i in range(blocks + 1)]
    part = [((1 << edges[i + 1]) - 1) ^ ((1 << edges[i]) - 1) for i in range(blocks)]
    return [sum(c) for c in combinations(part, max_bits)]


def pivots(n: int = PIVOTS) -> np.ndarray:
    """The reference fingerprints: hashes of their own numbers."""
    return np.array([xxhash.xxh64_intdigest(str(i), 7) for i in range(n)], np.uint64)


def _merge(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Makes label the least index that the pairs connect each index to."""
    while True:
        la, lb = label[a], label[b]
        off = la != lb
        if not off.any():
            return
        la, lb = la[off], lb[off]
        np.minimum.at(label, np.maximum(la, lb), np.minimum(la, lb))
        while (up := label[label] != label).any():
            label[up] = label[label[up]]


def forest(run: np.ndarray, side: np.ndarray, fp: np.ndarray, max_bits: int, table: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Edges (fp, fp) that span the linked rows within each run of equal `run`.

    side: 0 compares with all of the run, else rows of 1 meet only rows of 2.
    """
    n = len(fp)
    bits = fp.view(np.uint64)
    if table is None:
        table = np.bitwise_count(bits[:, None] ^ pivots()[None, :]).astype(np.int8)
    label = np.arange(n)
    ends = np.append(np.flatnonzero(run[1:] != run[:-1]) + 1, n)
    last = np.repeat(ends, np.diff(np.concatenate(([0], ends))))
    held: list[tuple[np.ndarray, np.ndarray]] = []
    waiting = 0
    at, shift = np.arange(n), 1
    while len(at := at[at + shift < last[at]]):
        a = at
        b = a + shift
        ok = (side[a] == 0) | (side[a] != side[b])
        a, b = a[ok], b[ok]
        for k in range(table.shape[1]):  # coordinate by coordinate: each leaves fewer pairs
            if len(a) < 64 and k:
                break
            ok = np.abs(table[a, k] - table[b, k]) <= max_bits
            a, b = a[ok], b[ok]
        ok = np.bitwise_count(bits[a] ^ bits[b]) <= max_bits
        a, b = a[ok], b[ok]
        if len(a):
            held.append((a, b))
            waiting += len(a)
        if waiting > _UNION_PAIRS:
            _merge(label, *map(np.concatenate, zip(*held, strict=True)))
            held, waiting = [], 0
        shift += 1
    if held:
        _merge(label, *map(np.concatenate, zip(*held, strict=True)))
    own = label != np.arange(n)
    return fp[own], fp[label[own]]


def _linker(max_bits: int):
    def link(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest = None

        def edges(b: pd.DataFrame) -> pd.DataFrame:
            key = b["key"].to_numpy()
            same = np.zeros(len(key), bool)  # rows that are alone in their run are dropped at once
            same[1:] = key[1:] == key[:-1]
            same[:-1] |= same[1:]
            u, v = forest(key[same], b["side"].to_numpy()[same], b["fp"].to_numpy()[same], max_bits)
            return pd.DataFrame({"u": u, "v": v})

        for b in batches:
            b = b if rest is None else pd.concat([rest, b], ignore_index=True)
            key = b["key"].to_numpy()
            whole = int(np.searchsorted(key, key[-1])) if len(key) else 0  # the last run may go on
            rest = b.iloc[whole:]
            if whole and len(out := edges(b.iloc[:whole])):
                yield out
        if rest is not None and len(out := edges(rest)):
            yield out
        release()

    return link


def links(fps: DataFrame, max_bits: int = MAX_BITS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Edges (u, v) between distinct fingerprints of fps (column fp) whose
    components are those of all links at max_bits or fewer differing bits."""
    signed = [m - (1 << 64) if m >> 63 else m for m in table_masks(max_bits)]
    keys = F.array(*[F.xxhash64(F.lit(i), F.col("fp").bitwiseAND(F.lit(m))) for i, m in enumerate(signed)])
    rows = fps.select("fp", F.explode(keys).alias("bucket"))
    hot = rows.groupBy("bucket").count().filter(F.col("count") > block_rows).select("bucket", F.ceil(F.col("count") / block_rows).cast("int").alias("parts"))
    own = F.pmod(F.xxhash64(F.col("fp"), F.lit(1)), F.col("parts")).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
    dealt = (
        rows.join(hot, "bucket", "left")
        .withColumn("parts", F.coalesce("parts", F.lit(1)))
        .withColumn("own", own)
        .select("bucket", "fp", "own", other.alias("other"))
        .select(
            F.xxhash64("bucket", F.least("own", "other"), F.greatest("own", "other")).alias("key"),
            F.when(F.col("own") == F.col("other"), 0).when(F.col("own") < F.col("other"), 1).otherwise(2).cast("int").alias("side"),
            "fp",
        )
    )
    n = max(12, int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return dealt.repartition(n, "key").sortWithinPartitions("key", "fp").mapInPandas(_linker(max_bits), "u long, v long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of edges (u, v): root is the least node that
    it reaches. Labels take the least of the neighbours' and then their label's
    label until nothing changes; each round is checkpointed. Runs jobs."""
    edges = checkpoint(edges.select("u", "v").union(edges.select("v", "u")).distinct())
    labels = checkpoint(edges.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("near")).select("node", F.least("node", "near").alias("root")))
    while True:
        near = edges.join(labels, edges["v"] == labels["node"]).groupBy(F.col("u").alias("node")).agg(F.min("root").alias("near"))
        step = labels.join(near, "node").select("node", F.col("root").alias("was"), F.least("root", "near").alias("root"))
        # Only roots that point on matter, and the root of a giant component does not:
        # they are few, and where they are not, no single key is hot.
        used = labels.select(F.col("root").alias("node")).distinct()
        up = checkpoint(labels.filter("node <> root").join(used, "node", "left_semi").select(F.col("node").alias("at"), F.col("root").alias("over")))
        up = F.broadcast(up) if up.limit(MAX_SENT + 1).count() <= MAX_SENT else up
        new = checkpoint(step.join(up, F.col("root") == F.col("at"), "left").select("node", "was", F.least("root", F.coalesce("over", "root")).alias("root")))
        moved = new.filter("root <> was").limit(1).count()
        labels = new.select("node", "root")
        if not moved:
            return labels


def grouped(docs: DataFrame, max_bits: int = MAX_BITS, block_rows: int = BLOCK_ROWS) -> tuple[DataFrame, DataFrame]:
    """(doc_id, fp, h) of every row of docs, and (fp, root, first) of every
    fingerprint: root is equal within a component, first the least doc_id that has
    it. Runs jobs."""
    prints = cut(with_fingerprints(docs))
    first = prints.groupBy("fp").agg(F.min("doc_id").alias("first"))
    roots = components(links(first.select("fp"), max_bits, block_rows))
    return prints, cut(first.join(roots, first["fp"] == roots["node"], "left").select("fp", F.coalesce("root", "fp").alias("root"), "first"))


def near_duplicates(docs: DataFrame, max_bits: int = MAX_BITS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(doc_id, fp, component_id) for every row of docs; component_id is the
    least doc_id that links reach (null if all of them are). Runs jobs."""
    prints, by_fp = grouped(docs, max_bits, block_rows)
    least = by_fp.groupBy("root").agg(F.min("first").alias("component_id"))
    alone = by_fp.filter("root = fp")
    known = by_fp.filter("root <> fp").join(least, "root").select("fp", "component_id").union(alone.select("fp", "root").join(least, "root").select("fp", "component_id"))
    return prints.select("doc_id", "fp").join(cut(known), "fp").select("doc_id", "fp", "component_id")


def deduplicate(docs: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """docs with one row of each group of linked texts left: that of the least
    doc_id (null ids last) and, of those that share it, of the least hash of the
    text; of equal rows one stays. Rows with equal ids or none go only if their texts
    are linked. No text is shuffled but those of winners that repeat. Runs jobs."""
    prints, by_fp = grouped(docs, max_bits)
    order = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col("h").alias("h"))
    best = prints.join(by_fp.select("fp", "root"), "fp").groupBy("root").agg(F.min(order).alias("best"))
    did, th, more = fresh(docs, "did", "th", "more")
    win = best.select(F.col("best.id").alias(did), F.col("best.h").alias(th)).distinct()
    rows = prints.groupBy(F.col("doc_id").alias("id"), F.col("h").alias("hash")).agg(F.count(F.lit(1)).alias("n"))
    win = cut(win.join(rows, F.col(did).eqNullSafe(F.col("id")) & (F.col(th) == F.col("hash"))).select(did, th, (F.col("n") > 1).alias(more)))
    text = docs["text"].cast("string")
    kept = docs.withColumns({f"{did}_": docs["doc_id"].cast("long"), f"{th}_": F.xxhash64(text)})
    kept = kept.join(win, kept[f"{did}_"].eqNullSafe(win[did]) & (kept[f"{th}_"] == win[th]))
    cols = [F.col(f"`{c}`") for c in docs.columns]
    once = kept.filter(F.col(more)).dropDuplicates([did, th]).select(*cols)
    return kept.filter(~F.col(more)).select(*cols).unionAll(once)


def simhash_query(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 lowercase hex digits), component_id of every row. Runs jobs."""
    return near_duplicates(docs).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
