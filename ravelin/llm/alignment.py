"""Aligning the tokens of two tokenizers over the bytes of a text.

Both token lists of a text lay intervals over the same bytes. The ends (and starts) of
B's intervals are a sorted, static index; bisecting a token of A into it by its own
start and end (stabbing queries, made for all tokens of a batch at once) tells the run
of B tokens that it overlaps. Byte gaps that no token of either side spans are the
bounds of groups: there A and B tokens both end.

How often a pair of ids is linked is counted over documents: a document's different
pairs are kept with their numbers in one packed column of the table that the first pass
writes; tasks add up what they read before they pass on a row for a pair. The counts
go back to the documents in two ways that give the same rows: the `MAX_SENT` most
frequent pairs are broadcast, the rest (which no document count makes hot) are joined
by a shuffle. One row for a pair and one for an A id is all that is ever shuffled
for them.

Words repeat, so a worker keeps those it has aligned. That is exact where white space is
single spaces and line ends between other characters: no piece of A or B goes across
these (a vocabulary for which that is not so is taken whole always). Texts with other
white space are encoded and aligned whole.

Defined cases: texts that are null, empty, or not spelled back by A's or B's tokens
(U+2581, say, which B takes for a space) have no tokens: zeros and an empty string, and
count for no pair; strings of special tokens are plain text; repeated rows and ids
count as a document each; a text of any length is aligned whole; ties for the highest
count of an A id are all best; other columns are not read, whatever their names; an
empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ravelin.llm.common import cut, release
from ravelin.llm.wavelet import _BYTES, vocabulary_path

VOCABULARY_A, VOCABULARY_B = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: Pairs whose counts are broadcast at most (13 bytes each); the rest are joined.
MAX_SENT = 1_000_000
#: Aligned words that a worker keeps (about 400 bytes each); then it starts anew.
KEPT_WORDS = 300_000
#: Documents whose words are looked up together, and links that are sorted together.
DOCS_AT_ONCE, LINKS_AT_ONCE = 1000, 2_000_000
#: Different pairs that a task adds up before it passes them on.
PAIRS_AT_ONCE = 2_000_000
_SPACE = "▁"
#: White space that does not stand alone between other characters, or is none of both
#: kinds that do, or that B writes as a space.
_ODD = "\\A[ \\n]|[ \\n]\\z|[ \\n][ \\n]|[\\t\\r\\x{0b}\\x{0c}\\x{1c}-\\x{1f}\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{2581}\\x{3000}]"


def stab(ends_a: np.ndarray, sizes_a: np.ndarray, ends_b: np.ndarray, sizes_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each token of A the first and the last token of B whose bytes it overlaps.
    Both lists cover the same bytes without gaps; ends are exclusive."""
    first = np.searchsorted(ends_b, ends_a - sizes_a, side="right")
    last = np.searchsorted(ends_b - sizes_b, ends_a, side="left") - 1
    return first, last


class Aligner:
    """The two tokenizers of a worker, and the words that it has aligned."""

    def __init__(self, path_a: str, path_b: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        self.b = SentencePieceProcessor(model_file=path_b)
        back = {letter: byte for byte, letter in _BYTES.items()} | {chr(b): b for b in range(256) if b not in _BYTES}
        n_a = self.a.get_vocab_size(with_added_tokens=True)
        self.bytes_a = [bytes(back[c] for c in t) if set(t) <= set(back) else t.encode() for t in map(self.a.id_to_token, range(n_a))]
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace(_SPACE, " ").encode() for i, p in enumerate(pieces)]
        self.size_a, self.size_b = (np.array([len(x) for x in t], np.int64) for t in (self.bytes_a, self.bytes_b))
        self.many = len(pieces)
        pre = self.a.pre_tokenizer
        self.by_word = isinstance(pre, ByteLevel) and not pre.add_prefix_space and not any("\n" in p or _SPACE in p.lstrip(_SPACE) for p in pieces)
        self._forget()

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.groups: list[bytes] = []
        self.counts = np.zeros((4, 0), np.int64)  # n_a, n_b, n_groups, n_links by word
        self.pairs = np.zeros(0, np.int64)
        self.spelled = np.zeros(0, bool)

    def _ids(self, texts: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        """A's and B's ids of texts that each begin with a space or a line end."""
        a = [e.ids for e in self.a.encode_batch_fast(texts, add_special_tokens=False)]
        # B puts a space before every text; where the text begins with a line end it is dropped.
        b = self.b.encode([t[1:] if t[0] == " " else t for t in texts], num_threads=1)
        return a, [ids if t[0] == " " else ids[1:] for t, ids in zip(texts, b, strict=True)]

    def align(self, texts: list[str]) -> tuple[list[bytes], np.ndarray, np.ndarray, np.ndarray]:
        """(groups, counts, pairs, spelled) of texts that each begin with a space or a
        line end: the groups as text; n_a, n_b, n_groups, n_links; the linked pairs of
        all texts on end, as A id times B's ids plus B id; whether the tokens spell the
        text (if not, it has none)."""
        a, b = self._ids(texts)
        spelled = np.array([b"".join(map(self.bytes_a.__getitem__, x)) == (raw := t.encode()) == b"".join(map(self.bytes_b.__getitem__, y)) for t, x, y in zip(texts, a, b, strict=True)], bool)
        if not spelled.all():
            a, b = ([ids if ok else [] for ids, ok in zip(side, spelled, strict=True)] for side in (a, b))
        n_a, n_b = (np.fromiter(map(len, side), np.int64, len(side)) for side in (a, b))
        flat_a, flat_b = (np.fromiter(chain.from_iterable(side), np.int64, int(n.sum())) for side, n in ((a, n_a), (b, n_b)))
        sizes_a, sizes_b = self.size_a[flat_a], self.size_b[flat_b]
        ends_a, ends_b = np.cumsum(sizes_a), np.cumsum(sizes_b)
        first, last = stab(ends_a, sizes_a, ends_b, sizes_b)
        links = last - first + 1
        upto = np.cumsum(links)
        pairs = np.repeat(flat_a, links) * self.many + flat_b[np.repeat(first - (upto - links), links) + np.arange(int(links.sum()))]
        bounds = np.flatnonzero(ends_b[last] == ends_a)  # A tokens after which no token spans the gap
        text_a, text_b = list(map(str, flat_a.tolist())), list(map(str, flat_b.tolist()))
        to_a, to_b = (bounds + 1).tolist(), (last[bounds] + 1).tolist()
        each = [f"{','.join(text_a[i:j])}|{','.join(text_b[p:q])}" for i, j, p, q in zip([0, *to_a], to_a, [0, *to_b], to_b, strict=False)]
        last_a = np.cumsum(n_a)
        to_group = np.searchsorted(bounds, last_a, side="left")
        to_link = np.concatenate(([0], upto))[last_a]
        n_groups, n_links = (np.diff(x, prepend=0) for x in (to_group, to_link))
        at = [0, *to_group.tolist()]
        return [";".join(each[i:j]).encode() for i, j in zip(at, at[1:], strict=False)], np.stack([n_a, n_b, n_groups, n_links]), pairs, spelled

    def _numbers(self, words: list[str]) -> np.ndarray:
        """The numbers of words, each as it follows on a space or with its line end;
        unknown ones are aligned and kept."""
        if len(self.known) > KEPT_WORDS:
            self._forget()
        new = [w for w in words if w not in self.known]
        if new:
            groups, counts, pairs, spelled = self.align([w if w[0] == "\n" else f" {w}" for w in new])
            self.known.update(zip(new, range(len(self.groups), len(self.groups) + len(new)), strict=True))
            self.groups += groups
            self.counts = np.concatenate((self.counts, counts), axis=1)
            self.pairs = np.concatenate((self.pairs, pairs))
            self.spelled = np.concatenate((self.spelled, spelled))
        return np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))

    def documents(self, texts: pa.Array) -> tuple[np.ndarray, list[str], np.ndarray]:
        """(counts, digests, pairs) of texts, none null: counts by text as in align(),
        the digest of its groups or an empty string, all texts' linked pairs on end."""
        n = len(texts)
        odd = pc.or_(pc.match_substring_regex(texts, _ODD), pc.equal(pc.binary_length(texts), 0)) if self.by_word else pa.array([True] * n)
        whole = np.flatnonzero(odd.to_numpy(zero_copy_only=False)).tolist()
        marked = pc.replace_substring(pc.if_else(odd, "", texts), "\n", " \n")
        split = pc.split_pattern(marked, " ")
        coded = split.flatten().dictionary_encode()
        number = self._numbers([w for w in coded.dictionary.to_pylist() if w])
        # the empty piece of texts taken whole is no word
        words = np.insert(number, empty, -1) if (empty := pc.index(coded.dictionary, "").as_py()) >= 0 else number
        at = words[coded.indices.to_numpy()]
        offsets = split.offsets.to_numpy() - split.offsets[0].as_py()
        real = at >= 0
        upto = np.concatenate(([0], np.cumsum(real)))[offsets]
        at = at[real]
        counts = np.diff(np.concatenate((np.zeros((4, 1), np.int64), np.cumsum(self.counts[:, at], axis=1)), axis=1)[:, upto], axis=1)
        bad = np.diff(np.concatenate(([0], np.cumsum(~self.spelled[at])))[upto]) > 0
        digests = []
        start = np.cumsum(self.counts[3]) - self.counts[3]
        rows, bounds = at.tolist(), upto.tolist()
        for i, j in zip(bounds, bounds[1:], strict=False):
            digests.append(hashlib.sha256(b";".join(map(self.groups.__getitem__, rows[i:j]))).hexdigest() if j > i else "")
        taken = at[np.repeat(~bad, np.diff(upto))]
        size = self.counts[3, taken]
        ends = np.cumsum(size)
        parts = self.pairs[np.repeat(start[taken] - (ends - size), size) + np.arange(int(size.sum()))]
        for i in np.flatnonzero(bad).tolist():
            counts[:, i], digests[i] = 0, ""
        if not whole:
            return counts, digests, parts
        found: list[np.ndarray] = []
        before = np.concatenate(([0], np.cumsum(counts[3])))
        done = 0
        for i in whole:
            text = texts[i].as_py()
            found.append(parts[before[done] : before[i]])
            done = i
            if text:
                groups, one, pairs, spelled = self.align([f" {text}"])
                if spelled[0]:
                    counts[:, i], digests[i] = one[:, 0], hashlib.sha256(groups[0]).hexdigest()
                    found.append(pairs)
        return counts, digests, np.concatenate([*found, parts[before[done] :]])


_ALIGNERS: dict[tuple[str, str], Aligner] = {}


def aligner(path_a: str, path_b: str) -> Aligner:
    """The worker's aligner for two vocabularies; kept between tasks."""
    if (path_a, path_b) not in _ALIGNERS:
        _ALIGNERS[path_a, path_b] = Aligner(path_a, path_b)
    return _ALIGNERS[path_a, path_b]


def pack(values: np.ndarray, counts: np.ndarray) -> bytes:
    """Ascending different numbers and how often each is there, compressed: steps and
    counts by byte planes."""
    steps = np.diff(values, prepend=0).astype("<u8")
    planes = np.concatenate((steps.view(np.uint8).reshape(-1, 8).T, counts.astype("<u4").view(np.uint8).reshape(-1, 4).T))
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def unpack(image: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(values, counts) of a packed column; nothing for nothing."""
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(image), np.uint8).reshape(12, -1)
    return np.cumsum(planes[:8].T.copy().view("<u8").ravel().astype(np.int64)), planes[8:].T.copy().view("<u4").ravel().astype(np.int64)


def _by_document(counts: np.ndarray, pairs: np.ndarray) -> list[bytes]:
    """The packed pairs of documents with so many links each."""
    out: list[bytes] = []
    ends = np.cumsum(counts)
    lo = 0
    while lo < len(counts):
        begin = int(ends[lo] - counts[lo])
        hi = max(lo + 1, int(np.searchsorted(ends, begin + LINKS_AT_ONCE, side="right")))
        if hi == lo + 1:
            each = [np.unique(pairs[begin : ends[lo]], return_counts=True)]
        else:
            key = np.repeat(np.arange(hi - lo, dtype=np.uint64), counts[lo:hi]) << np.uint64(40) | pairs[begin : ends[hi - 1]].astype(np.uint64)
            keys, times = np.unique(key, return_counts=True)
            cuts = np.searchsorted(keys >> np.uint64(40), np.arange(1, hi - lo, dtype=np.uint64))
            each = list(zip(np.split((keys & np.uint64((1 << 40) - 1)).astype(np.int64), cuts), np.split(times, cuts), strict=True))
        out += [pack(v, c) for v, c in each]
        lo = hi
    return out


_ALIGNED = "row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs binary"


def _aligned(path_a: str, path_b: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = aligner(path_a, path_b)
        row = TaskContext.get().partitionId() << 33
        for b in batches:
            for at in range(0, b.num_rows, DOCS_AT_ONCE):
                some = b.slice(at, DOCS_AT_ONCE)
                counts, digests, pairs = both.documents(some.column("text"))
                packed = _by_document(counts[3], pairs)
                columns = [pa.array(np.arange(row, row + len(packed))), some.column("doc_id"), *[pa.array(c) for c in counts], pa.array(digests), pa.array(packed, pa.binary())]
                row += len(packed)
                yield pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in _ALIGNED.split(", ")])
        release()

    return run


def aligned(docs: DataFrame, path_a: str | None = None, path_b: str | None = None) -> DataFrame:
    """(row, doc_id, n_a, n_b, n_groups, n_links, groups_sha256, pairs) of every row of
    docs (doc_id, text): row is a number of its own, pairs the packed numbers
    A id x B's ids + B id with the document's links of each."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return rows.mapInArrow(_aligned(path_a or vocabulary_path(VOCABULARY_A), path_b or vocabulary_path(VOCABULARY_B)), _ALIGNED)


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(pair, n): documents by pair, added up by task."""
    known, times = np.zeros(0, np.int64), np.zeros(0, np.int64)
    waiting: list[np.ndarray] = []
    held = 0

    def added() -> tuple[np.ndarray, np.ndarray]:
        values, counts = np.unique(np.concatenate(waiting), return_counts=True) if waiting else (np.zeros(0, np.int64), np.zeros(0, np.int64))
        every, place = np.unique(np.concatenate((known, values)), return_inverse=True)
        return every, np.bincount(place, np.concatenate((times, counts)), len(every)).astype(np.int64)

    for b in batches:
        for image in b.column("pairs"):
            waiting.append(unpack(image.as_py())[0])
            held += len(waiting[-1])
            if held > LINKS_AT_ONCE:
                known, times = added()
                waiting, held = [], 0
                if len(known) > PAIRS_AT_ONCE:
                    yield pa.RecordBatch.from_arrays([pa.array(known), pa.array(times)], names=["pair", "n"])
                    known, times = np.zeros(0, np.int64), np.zeros(0, np.int64)
    known, times = added()
    if len(known):
        yield pa.RecordBatch.from_arrays([pa.array(known), pa.array(times)], names=["pair", "n"])
    release()


def pair_counts(stored: DataFrame, many: int) -> DataFrame:
    """(pair, n, best): in how many documents a pair is linked, and whether that is the
    most of its A id's pairs. many: ids of B."""
    n = stored.filter("n_links > 0").select("pairs").mapInArrow(_added, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))
    n = cut(n)
    a = F.expr(f"pair div {many}")
    most = n.groupBy(a.alias("a")).agg(F.max("n").alias("most"))
    return n.join(most, a == most["a"]).select("pair", "n", (F.col("n") == F.col("most")).alias("best"))


def _scored(sent):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs, n, best = sent.value
        for b in batches:
            sums, best_sums, rest = [], [], []
            for image in b.column("pairs"):
                values, times = unpack(image.as_py())
                at = np.minimum(np.searchsorted(pairs, values), max(0, len(pairs) - 1))
                there = pairs[at] == values if len(pairs) else np.zeros(len(values), bool)
                at, known = at[there], times[there]
                sums.append(int((n[at] * known).sum()))
                best_sums.append(int(known[best[at]].sum()))
                rest.append([{"pair": p, "times": t} for p, t in zip(values[~there].tolist(), times[~there].tolist(), strict=True)])
            kind = pa.list_(pa.struct([("pair", pa.int64()), ("times", pa.int64())]))
            yield pa.RecordBatch.from_arrays([b.column("row"), pa.array(best_sums, pa.int64()), pa.array(sums, pa.int64()), pa.array(rest, kind)], names=["row", "n_best", "count_sum", "rest"])

    return run


def link_scores(stored: DataFrame, counts: DataFrame, most_sent: int = MAX_SENT) -> DataFrame:
    """(row, n_best, count_sum) of the rows of aligned() that have links. The most_sent
    pairs of most documents go out by broadcast; what a document has besides is joined.
    Runs jobs."""
    top = counts.orderBy(F.desc("n"), "pair").limit(most_sent).toArrow()
    order = np.argsort(pair := top.column("pair").to_numpy())
    sent = stored.sparkSession.sparkContext.broadcast((pair[order], top.column("n").to_numpy()[order], top.column("best").to_numpy()[order]))
    schema = "row long, n_best long, count_sum long, rest array<struct<pair:long,times:long>>"
    scored = stored.filter("n_links > 0").select("row", "pairs").mapInArrow(_scored(sent), schema)
    if counts.count() <= top.num_rows:  # no pair is left out
        return scored.drop("rest")
    scored = cut(scored)
    few = scored.select("row", F.explode("rest").alias("r")).select("row", "r.pair", "r.times").join(counts, "pair")
    few = few.groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("b"), F.sum(F.col("n") * F.col("times")).alias("s"))
    return scored.join(few, "row", "left").select("row", (F.col("n_best") + F.coalesce("b", F.lit(0))).alias("n_best"), (F.col("count_sum") + F.coalesce("s", F.lit(0))).alias("count_sum"))


def alignment(docs: DataFrame, path_a: str | None = None, path_b: str | None = None, most_sent: int = MAX_SENT) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of every
    row of docs (doc_id, text). Runs jobs."""
    from sentencepiece import SentencePieceProcessor

    stored = cut(aligned(docs, path_a, path_b))
    many = SentencePieceProcessor(model_file=path_b or vocabulary_path(VOCABULARY_B)).get_piece_size()
    scores = link_scores(stored, cut(pair_counts(stored, many)), most_sent)
    out = stored.drop("pairs").join(scores, "row", "left")
    return out.select("doc_id", "n_a", "n_b", "n_groups", "n_links", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n_best", "count_sum")], "groups_sha256")


def alignment_query(docs: DataFrame) -> DataFrame:
    """The alignment of every document's tokens by the two vocabularies. Runs jobs."""
    return alignment(docs)
