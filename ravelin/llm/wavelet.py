"""Token ids as binary shards, each a wavelet matrix in one compressed file.

Documents go in ascending doc_id order to range partitions; a task encodes its
documents, appends an end id to each and closes a shard after `SHARD_TOKENS`
ids. A shard's file holds, for each bit of the ids from the highest, one
bit-plane (the ids stably partitioned by the planes above it), with the running
counts of ones every `BLOCK` bits that rank and select need, the documents' ids
and lengths, everything zstd-compressed by section. From the file alone:
access(i) gives a token, rank and count give numbers of occurrences, select and
occurrences give their places, decode() gives all ids back.

Shard files are written by Spark's own Parquet writer (one row is one file
image, uncompressed by Parquet), so they land on any store that Spark reaches
and a lost task leaves nothing half-written.

Encoding: byte-level BPE joins nothing across a space that stands between two
characters that are no white space, so words are encoded by the tokenizers library
once and kept; texts with other white space or special tokens go to it whole.

Defined cases: null text is empty and yields the end id alone; repeated rows
keep a run of ids each, ordered by text; a null doc_id comes first; an empty
table gives no shards and an empty result.
"""

from __future__ import annotations

import os
import re
import struct
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ravelin.llm.common import cut, release

MAGIC = b"RVWM0001"
BLOCK = 512
SHARD_TOKENS = 2_000_000
END_ID = 0
VOCABULARY = "byte_bpe_50k.json"
#: Words that a Python worker keeps encoded (about 200 bytes each).
KEPT_WORDS = 1_200_000
#: The same beside other stages, whose memory a worker still holds: rare words are encoded
#: more often.
FEW_WORDS = 150_000
#: Documents whose words are looked up together.
DOCS_AT_ONCE = 5000
#: Marks: a word that no space precedes, the end of a text, a text taken whole; and
#: a line end as a word of its own.
_FIRST, _LAST, _WHOLE, _LINE = "\x01", "\x02", "\x03", " \n \x01"
_ODD = "\\A[ \\n]|[ \\n]\\z|\\A\\z|[\\x{01}-\\x{03}\\t\\r\\x{0b}\\x{0c}\\x{1c}-\\x{1f}\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]"


def _byte_letters() -> dict[int, str]:
    """How byte-level vocabularies write the bytes that don't print: as the
    characters from 256 on, in order."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    return {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in shown)}


_BYTES = _byte_letters()


class WaveletMatrix:
    """A sequence of unsigned integers as bit-planes with rank directories."""

    def __init__(self, n: int, planes: list[np.ndarray], zeros: list[int], counts: list[np.ndarray]):
        self.n, self.planes, self.zeros, self.counts = n, planes, zeros, counts
        self.width = len(planes)

    @classmethod
    def build(cls, values: np.ndarray, width: int) -> WaveletMatrix:
        planes, zeros, counts = [], [], []
        a, n = np.ascontiguousarray(values), len(values)
        for level in range(width):
            bit = (a & a.dtype.type(1 << (width - 1 - level))) != 0
            plane = np.zeros(-(-n // BLOCK) * (BLOCK // 8), np.uint8)
            packed = np.packbits(bit, bitorder="little")
            plane[: len(packed)] = packed
            ones = np.bitwise_count(plane.view(np.uint64)).reshape(-1, BLOCK // 64).sum(axis=1, dtype=np.uint32)
            counts.append(np.concatenate(([0], np.cumsum(ones, dtype=np.uint32))).astype(np.uint32))
            planes.append(plane)
            one = np.flatnonzero(bit)
            zeros.append(n - len(one))
            if level + 1 < width:
                a = np.concatenate((a.take(np.flatnonzero(~bit)), a.take(one)))
        return cls(n, planes, zeros, counts)

    def _rank1(self, level: int, i: int) -> int:
        """Ones of a plane before place i."""
        block, byte = i // BLOCK, i // 8
        inside = self.planes[level][block * (BLOCK // 8) : byte]
        r = int(self.counts[level][block]) + int(np.bitwise_count(inside).sum())
        return r + int(self.planes[level][byte] & ((1 << (i % 8)) - 1)).bit_count() if i % 8 else r

    def _select(self, level: int, one: int, k: int) -> int:
        """The place of the k-th (from 0) bit of the given value in a plane."""
        c = self.counts[level]
        if not one:
            c = np.arange(len(c), dtype=np.int64) * BLOCK - c
        block = int(np.searchsorted(c, k, side="right")) - 1
        bits = np.unpackbits(self.planes[level][block * (BLOCK // 8) : (block + 1) * (BLOCK // 8)], bitorder="little")
        return block * BLOCK + int(np.flatnonzero(bits == one)[k - int(c[block])])

    def access(self, i: int) -> int:
        """The value at place i."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        value = 0
        for level in range(self.width):
            one = int(self.planes[level][i // 8]) >> (i % 8) & 1
            value = value << 1 | one
            r = self._rank1(level, i)
            i = self.zeros[level] + r if one else i - r
        return value

    def _range(self, value: int, end: int) -> tuple[int, int]:
        lo, hi = 0, end
        for level in range(self.width):
            a, b = self._rank1(level, lo), self._rank1(level, hi)
            lo, hi = (self.zeros[level] + a, self.zeros[level] + b) if value >> (self.width - 1 - level) & 1 else (lo - a, hi - b)
        return lo, hi

    def rank(self, value: int, end: int) -> int:
        """Occurrences of value before place end."""
        if value >> self.width:
            return 0
        lo, hi = self._range(value, min(end, self.n))
        return hi - lo

    def count(self, value: int) -> int:
        return self.rank(value, self.n)

    def select(self, value: int, k: int) -> int:
        """The place of the k-th (from 0) occurrence of value."""
        if value >> self.width or not 0 <= k < self.count(value):
            raise IndexError(k)
        i = self._range(value, self.n)[0] + k
        for level in reversed(range(self.width)):
            one = value >> (self.width - 1 - level) & 1
            i = self._select(level, one, i - self.zeros[level] if one else i)
        return i

    def occurrences(self, value: int) -> list[int]:
        """All places of value, ascending."""
        return [self.select(value, k) for k in range(self.count(value))]

    def decode(self, dtype=np.uint16) -> np.ndarray:
        """All values."""
        out = np.zeros(self.n, dtype)
        for level in reversed(range(self.width)):
            bit = np.unpackbits(self.planes[level], count=self.n, bitorder="little").view(bool)
            above = np.empty_like(out)
            z = self.zeros[level]
            one = np.flatnonzero(bit)
            above[one] = out[z:] | dtype(1 << (self.width - 1 - level))
            above[np.flatnonzero(~bit)] = out[:z]
            out = above
        return out


def write_image(ids: np.ndarray, width: int, doc_ids: np.ndarray, valid: np.ndarray, lengths: np.ndarray) -> bytes:
    """The bytes of a shard's file."""
    m = WaveletMatrix.build(ids, width)
    press = zstandard.ZstdCompressor(level=1).compress
    head = press(b"".join((np.array(m.zeros, "<u8").tobytes(), doc_ids.astype("<i8").tobytes(), valid.astype("u1").tobytes(), lengths.astype("<u8").tobytes())))
    parts = [head]
    for plane, count in zip(m.planes, m.counts, strict=True):
        parts += [press(plane.tobytes()), press(count.astype("<u4").tobytes())]
    return MAGIC + struct.pack("<QQB", m.n, len(lengths), width) + b"".join(struct.pack("<Q", len(p)) + p for p in parts)


def read_image(image: bytes) -> tuple[WaveletMatrix, np.ndarray, np.ndarray, np.ndarray]:
    """The matrix, the documents' ids, which of these are not null, and lengths."""
    if image[:8] != MAGIC:
        raise ValueError("not a shard")
    n, docs, width = struct.unpack_from("<QQB", image, 8)
    open_, at, parts = zstandard.ZstdDecompressor().decompress, 25, []
    while at < len(image):
        (size,) = struct.unpack_from("<Q", image, at)
        parts.append(open_(image[at + 8 : at + 8 + size]))
        at += 8 + size
    zeros = np.frombuffer(parts[0], "<u8", width).tolist()
    doc_ids = np.frombuffer(parts[0], "<i8", docs, 8 * width)
    valid = np.frombuffer(parts[0], "u1", docs, 8 * width + 8 * docs).astype(bool)
    lengths = np.frombuffer(parts[0], "<u8", docs, 8 * width + 9 * docs).astype(np.int64)
    planes = [np.frombuffer(p, np.uint8) for p in parts[1::2]]
    counts = [np.frombuffer(p, "<u4") for p in parts[2::2]]
    return WaveletMatrix(n, planes, zeros, counts), doc_ids, valid, lengths


class Encoder:
    """Texts to ids, by the tokenizers library.

    Texts are split at spaces and line ends in Arrow and their different words
    looked up; words not yet known are encoded together. The ids of a batch are
    then gathered from those of its different words.
    """

    def __init__(self, path: str, end_id: int = END_ID, kept: int = KEPT_WORDS):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok, self.kept = Tokenizer.from_file(path), kept
        self.width = max(1, (self.tok.get_vocab_size(with_added_tokens=True) - 1).bit_length())
        self.dtype, self.code = (np.uint16, "H") if self.width <= 16 else (np.uint32, "I")
        special = [re.escape(t.content) for t in self.tok.get_added_tokens_decoder().values()]
        self.odd = "|".join([_ODD, "  | \\n|\\n |\\n\\n", *special])
        newline = self.tok.encode("\n", add_special_tokens=False).ids
        self.newline, self.end = np.array(newline, self.dtype).tobytes(), np.array([end_id], self.dtype).tobytes()
        self.stops = dict(zip(",.", self.whole([",", "."]), strict=True))
        alone = [self.whole([w])[0] for w in ("a", " b", " c")]
        self.by_word = len(newline) == 1 and self.whole(["a b.\n c"])[0] == alone[0] + alone[1] + self.stops["."] + self.newline + alone[2]
        some = ["a", " Wort", " \u00e0\u00df\u00ef", " \u0148\u0161"]
        pieces = [w.encode().decode("latin-1").translate(_BYTES) for w in some]
        self.letters = [np.array([t.id for t in self.tok.model.tokenize(p)], self.dtype).tobytes() for p in pieces] == self.whole(some)
        self._forget()

    def _forget(self) -> None:
        """Known words of two generations: after a space, marked by _FIRST at the
        start of a line, and the marks. Words of the older one that come again move
        up, the others go when the younger one is full."""
        self.older = getattr(self, "known", {})
        self.known: dict[str, bytes] = {"\n": self.newline, _FIRST: b"", _LAST: self.end}

    def whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, self.dtype).tobytes() for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]

    def _lines(self, some: list[str]) -> list[bytes]:
        """Pieces without line ends, encoded apart: one text of lines for the
        library, cut at the ids of the line ends."""
        if not some:
            return []
        ids = np.array(self.tok.encode_batch_fast(["\n".join(some) + "\n"], add_special_tokens=False)[0].ids, self.dtype)
        ends = np.flatnonzero(ids == np.frombuffer(self.newline, self.dtype)[0]).tolist()
        raw, size = ids.tobytes(), self.dtype().itemsize
        return [raw[a * size : e * size] for a, e in zip([0, *(e + 1 for e in ends)], ends, strict=False)]

    def _learn(self, words: list[str]) -> None:
        """Adds words to the known ones. A comma or full stop after a letter is
        always a piece of its own, so "word," needs no more than "word"; a word of
        Latin letters alone is one piece, which the library's model takes as it is."""
        known, tails, other = self.known, [], []
        stems = set()
        for w in words:
            if w[-1] in ",." and len(w) > 1:
                tails.append(w)
                w = w[:-1]
            stems.add(w)
        tokenize, code = self.tok.model.tokenize, self.code
        for w in stems:
            if w in known:
                continue
            core = w[1:] if w[0] == _FIRST else w
            if not self.letters or not core.isalpha():
                other.append(w)
            elif core.isascii():
                known[w] = array(code, [t.id for t in tokenize(core if w[0] == _FIRST else "\u0120" + w)]).tobytes()
            elif max(core) <= "\u024f":
                core = (core if w[0] == _FIRST else " " + w).encode().decode("latin-1").translate(_BYTES)
                known[w] = array(code, [t.id for t in tokenize(core)]).tobytes()
            else:
                other.append(w)
        known.update(zip(other, self._lines([w[1:] if w[0] == _FIRST else " " + w for w in other]), strict=True))
        for w in tails:
            if w[-2].isalpha() and w[-2] <= "\u024f":
                known[w] = known[w[:-1]] + self.stops[w[-1]]
            else:
                known[w] = self._lines([w[1:] if w[0] == _FIRST else " " + w])[0]

    def _odd(self, texts: pa.Array) -> np.ndarray:
        """Numbers of the texts that must go to the library whole: white space
        that does not stand alone between words, special tokens, our marks."""
        if not self.by_word:
            return np.arange(len(texts))
        odd = pc.match_substring_regex(texts, self.odd)
        return np.flatnonzero(odd.to_numpy(zero_copy_only=False))

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts (none null) on end, each with the end id, and how
        many are of each."""
        if len(self.known) > self.kept // 2:
            self._forget()
        apart: dict[str, bytes] = {}
        odd = self._odd(texts)
        if len(odd):
            mask = np.zeros(len(texts), bool)
            mask[odd] = True
            names = [f"{_WHOLE}{i}" for i in odd.tolist()]
            apart = dict(zip([_FIRST + n for n in names], self.whole(texts.take(pa.array(odd)).to_pylist()), strict=True))
            texts = pc.replace_with_mask(texts, pa.array(mask), pa.array(names, texts.type))
        marked = pc.binary_join_element_wise(_FIRST, pc.replace_substring(texts, "\n", _LINE), f" {_LAST}", "")
        split = pc.split_pattern(marked, " ")
        coded = split.flatten().dictionary_encode()
        words, place = coded.dictionary.to_pylist(), coded.indices.to_numpy()
        known, older = self.known, self.older
        parts = list(map(known.get, words))
        missing = [i for i, p in enumerate(parts) if p is None]
        new = []
        for i in missing:
            w = words[i]
            p = older.get(w)
            if p is not None:
                parts[i] = known[w] = p
            elif w in apart:
                parts[i] = apart[w]
            else:
                new.append(i)
        self._learn([words[i] for i in new])
        for i in new:
            parts[i] = known[words[i]]
        size = self.dtype().itemsize
        n = np.fromiter(map(len, parts), np.int32, len(parts)) // size
        flat, start = np.frombuffer(b"".join(parts), self.dtype), np.cumsum(n, dtype=np.int32) - n
        count = n[place]
        ends = np.cumsum(count, dtype=np.int32)
        ids = flat[np.repeat(start[place] - (ends - count), count) + np.arange(ends[-1] if len(ends) else 0, dtype=np.int32)]
        upto = np.concatenate(([0], ends))[split.offsets.to_numpy() - split.offsets[0].as_py()]
        return ids, np.diff(upto)


_ENCODERS: dict[tuple[str, int, int], Encoder] = {}


def encoder(path: str, end_id: int = END_ID, kept: int = KEPT_WORDS) -> Encoder:
    """The worker's encoder for a vocabulary file; kept between tasks."""
    if (path, end_id, kept) not in _ENCODERS:
        _ENCODERS[path, end_id, kept] = Encoder(path, end_id, kept)
    return _ENCODERS[path, end_id, kept]


def vocabulary_path(name: str = VOCABULARY) -> str:
    """Where a vocabulary of the public tokenizers lies on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def _shards(path: str, end_id: int, shard_tokens: int, kept_words: int):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path, end_id, kept_words)
        part = TaskContext.get().partitionId()
        release()
        held: list[tuple[np.ndarray, np.ndarray, pa.Array]] = []  # ids, lengths, doc_ids
        waiting, seq = 0, 0

        def close() -> pa.RecordBatch:
            ids, lengths = (np.concatenate([h[i] for h in held]) for i in (0, 1))
            docs = pa.concat_arrays([h[2] for h in held])
            image = write_image(ids, enc.width, docs.fill_null(0).to_numpy(), docs.is_valid().to_numpy(zero_copy_only=False), lengths)
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([seq], pa.int32()), pa.array([len(lengths)], pa.int64()), pa.array([len(ids)], pa.int64()), pa.array([image], pa.binary())], names=["part", "seq", "n_docs", "n_tokens", "image"])

        for b in batches:
            at = 0
            while at < b.num_rows:
                some = b.slice(at, DOCS_AT_ONCE)
                at += some.num_rows
                ids, lengths = enc.encode(some.column("text").fill_null(""))
                ends = np.cumsum(lengths)
                lo = 0
                while lo < len(lengths):  # documents until the shard is full
                    hi = lo + max(1, int(np.searchsorted(ends[lo:] - (ends[lo - 1] if lo else 0), shard_tokens - waiting)) + 1)
                    hi = min(hi, len(lengths))
                    first, last = int(ends[lo - 1]) if lo else 0, int(ends[hi - 1])
                    held.append((ids[first:last], lengths[lo:hi], some.column("doc_id").slice(lo, hi - lo)))
                    waiting += last - first
                    lo = hi
                    if waiting >= shard_tokens:
                        yield close()
                        held, waiting, seq = [], 0, seq + 1
                        release()
        if held:
            yield close()
        held = []
        release()

    return write


def write_shards(docs: DataFrame, path: str | None = None, end_id: int = END_ID, shard_tokens: int = SHARD_TOKENS, kept_words: int = KEPT_WORDS) -> DataFrame:
    """Encodes docs (doc_id, text) into shard files in the shared folder and
    returns their table: part, seq (both in doc_id order), n_docs, n_tokens,
    image. kept_words: how many words a worker keeps encoded, which changes no id.
    Runs a job."""
    n = max(12, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = rows.repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id", "text")
    return cut(rows.mapInArrow(_shards(path or vocabulary_path(), end_id, shard_tokens, kept_words), "part int, seq int, n_docs long, n_tokens long, image binary"))


def _documents(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        for part, seq, image in zip(b["part"], b["seq"], b["image"], strict=True):
            m, doc_ids, valid, lengths = read_image(image)
            ids = m.decode(np.uint16 if m.width <= 16 else np.uint32).astype("<u4").tobytes()
            ends = np.cumsum(lengths)
            starts = ends - lengths
            crc = [zlib.crc32(ids[4 * a : 4 * e]) for a, e in zip(starts.tolist(), ends.tolist(), strict=True)]
            docs = pd.Series(doc_ids).astype("Int64").where(pd.Series(valid))
            yield pd.DataFrame({"part": part, "seq": seq, "doc_id": docs, "inside": starts, "n_tokens": lengths, "ids_crc32": crc})
    release()


def read_documents(shards: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document in the files."""
    found = shards.select("part", "seq", "image").mapInPandas(_documents, "part int, seq int, doc_id long, inside long, n_tokens long, ids_crc32 long")
    meta = shards.select("part", "seq", "n_tokens")
    parts = meta.groupBy("part").agg(F.sum("n_tokens").alias("n"))  # a row for each partition
    parts = parts.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    inside = Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    base = meta.select("part", "seq", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0)).alias("off")).join(parts, "part").select("part", "seq", (F.col("base") + F.col("off")).alias("base"))
    return found.join(base, ["part", "seq"]).select("doc_id", (F.col("base") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32")


def wavelet_query(docs: DataFrame, kept_words: int = KEPT_WORDS) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every row of docs, as read back from
    the shard files. Runs a job."""
    return read_documents(write_shards(docs, kept_words=kept_words))
