"""Token ids in binary blocks with Elias-Fano coded document boundaries.

A block is one row of a Parquet dataset: ``part``, ``seq``, ``n_tokens``, ``n_docs`` and ``payload``. The payload is

    magic "EFT1" | u32 documents | u64 tokens | u8 low bits | u32 bytes of lows | u32 bytes of highs
    | u32 samples | lows | highs | samples (u32) | document ids (i64) | null flags (u8) | token ids (u32)

all little-endian. The boundaries (a document's end within the block) are a monotone sequence: ``low bits`` of each value
are packed, the rest is a unary bit vector, and every 64th one of that vector is sampled for ``select``.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain, compress, islice

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cohortry.llm.common import new_path

END_ID = 0
BLOCK_TOKENS = 1 << 16
SAMPLE = 64
_HEAD = "<4sIQBIII"
#: White space to the tokenizer's pattern. No pre-token runs from another character into it.
_SPACE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_CHUNK = re.compile(f"[{_SPACE}]*[^{_SPACE}]+|[{_SPACE}]+")
_CACHE = 600_000
#: New plain chunks in one sequence of the model.
_AT_ONCE = 64


class EliasFano:
    """A monotone sequence in about ``2 + log2(universe / n)`` bits a value, with random access."""

    def __init__(self, n: int, low_bits: int, lows: bytes, highs: bytes, samples: np.ndarray):
        self.n, self.low_bits, self.lows, self.highs, self.samples = n, low_bits, lows, highs, samples

    @classmethod
    def build(cls, values: np.ndarray) -> EliasFano:
        values = np.asarray(values, dtype=np.uint64)
        n = len(values)
        if not n:
            return cls(0, 0, b"", b"", np.zeros(0, np.uint32))
        universe = int(values[-1]) + 1
        low_bits = max(0, (universe // n).bit_length() - 1)
        shifts = np.arange(low_bits, dtype=np.uint64)
        lows = ((values[:, None] >> shifts) & np.uint64(1)).astype(np.uint8)
        ones = (values >> np.uint64(low_bits)) + np.arange(n, dtype=np.uint64)
        bits = np.zeros(int(ones[-1]) + 1, np.uint8)
        bits[ones.astype(np.int64)] = 1
        return cls(n, low_bits, np.packbits(lows.ravel(), bitorder="little").tobytes(),
                   np.packbits(bits, bitorder="little").tobytes(), ones[::SAMPLE].astype(np.uint32))

    def _low(self, i) -> np.ndarray:
        if not self.low_bits:
            return np.zeros(np.shape(i), np.uint64)
        bits = np.unpackbits(np.frombuffer(self.lows, np.uint8), bitorder="little")[: self.n * self.low_bits]
        weights = np.uint64(1) << np.arange(self.low_bits, dtype=np.uint64)
        return bits.reshape(self.n, self.low_bits)[i].astype(np.uint64) @ weights

    def select(self, i: int) -> int:
        """Value ``i``: jump to the sample before it, then scan at most ``SAMPLE`` ones."""
        start = int(self.samples[i // SAMPLE])
        raw = np.frombuffer(self.highs, np.uint8)[start // 8:]
        passed, width = i % SAMPLE, 64
        while True:
            bits = np.unpackbits(raw[:width], bitorder="little")[start % 8:]
            ones = np.flatnonzero(bits)
            if len(ones) > passed:
                break
            width *= 4
        at = start + int(ones[passed])
        first = i * self.low_bits
        low = np.unpackbits(np.frombuffer(self.lows, np.uint8)[first // 8: (first + self.low_bits) // 8 + 1],
                            bitorder="little")[first % 8: first % 8 + self.low_bits]
        return ((at - i) << self.low_bits) + int(sum(int(b) << k for k, b in enumerate(low)))

    def decode(self) -> np.ndarray:
        ones = np.flatnonzero(np.unpackbits(np.frombuffer(self.highs, np.uint8), bitorder="little"))[: self.n]
        high = ones.astype(np.uint64) - np.arange(self.n, dtype=np.uint64)
        return ((high << np.uint64(self.low_bits)) + self._low(slice(None))).astype(np.int64)


def pack(doc_ids: list[int | None], ids: list[np.ndarray]) -> bytes:
    ends = np.cumsum([len(x) for x in ids])
    ef = EliasFano.build(ends)
    head = struct.pack(_HEAD, b"EFT1", len(ids), int(ends[-1]) if len(ends) else 0, ef.low_bits, len(ef.lows), len(ef.highs),
                      len(ef.samples))
    return b"".join([head, ef.lows, ef.highs, ef.samples.astype("<u4").tobytes(),
                     np.array([x or 0 for x in doc_ids], "<i8").tobytes(),
                     bytes(x is None for x in doc_ids), *(x.astype("<u4").tobytes() for x in ids)])


def unpack(payload: bytes) -> tuple[list[int | None], EliasFano, memoryview]:
    """Document ids, boundaries and the bytes of the token ids."""
    magic, n, tokens, low_bits, lows, highs, samples = struct.unpack_from(_HEAD, payload)
    if magic != b"EFT1":
        raise ValueError("not a token block")
    at = [struct.calcsize(_HEAD)]

    def take(size: int) -> memoryview:
        at[0] += size
        return memoryview(payload)[at[0] - size: at[0]]

    ef_lows, ef_highs = bytes(take(lows)), bytes(take(highs))
    ef = EliasFano(n, low_bits, ef_lows, ef_highs, np.frombuffer(take(4 * samples), "<u4"))
    doc_ids = np.frombuffer(take(8 * n), "<i8").tolist()
    missing = bytes(take(n))
    return [None if m else d for d, m in zip(doc_ids, missing)], ef, take(4 * tokens)


#: Chunks whose pre-tokens are plain: a new line, a word of Latin letters with or without its space, a run of marks.
_PLAIN = re.compile("(?:\n?+ |\n)[A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\u024f]++[.,;:!?|$%&#*]*+")


def _byte_letters() -> np.ndarray:
    """The code point that stands for each byte in a byte-level vocabulary: visible bytes stand for themselves, the
    others for the characters from U+0100 on, in order."""
    visible = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    out = np.arange(256, dtype="<u4")
    hidden = np.setdiff1d(out, visible)
    out[hidden] = 0x100 + np.arange(len(hidden))
    return out


def _keeps_apart(vocabulary: Iterator[str], letters: np.ndarray) -> bool:
    """Whether no token of a plain text's bytes reaches over the end of a pre-token: into a space or a new line from
    before it, from a new line into a letter, from a letter into a mark. Then plain chunks may stand side by side."""
    def group(*of: int) -> str:
        return "[" + "".join(re.escape(chr(letters[b])) for b in of) + "]"

    # the letters above are of one byte, or two that begin with 0xC3 to 0xC9
    letter = group(*range(65, 91), *range(97, 123), *range(0x80, 0xC0), *range(0xC3, 0xCA))
    mark, space, line = group(*b".,;:!?|$%&#*"), group(*b" "), group(*b"\n")
    plain = re.compile(f"(?:{letter}|{mark}|{space}|{line})+")
    over = re.compile(f"(?:{letter}|{mark}){space}|(?:{letter}|{mark}){line}|{line}(?:{space}|{letter})|{letter}{mark}")
    return not any(plain.fullmatch(t) and over.search(t) for t in vocabulary)


class _Places(dict):
    """The place of each key; a new one gets the next place."""

    def __missing__(self, key: str) -> int:
        self[key] = place = len(self)
        return place


class Encoder:
    """The tokenizer behind a cache of chunks, each some white space and the run after it.

    A pre-token never reaches from another character into white space, so the chunks' ids make up the text's ids. New
    plain chunks go side by side to the tokenizer's model alone, where no token of the vocabulary reaches over their
    pre-tokens' ends; all other chunks go through the whole tokenizer, each on its own.
    """

    def __init__(self, tokenizer_path: str):
        from tokenizers import Tokenizer

        self.tokenizer, self.letters = Tokenizer.from_file(tokenizer_path), _byte_letters()
        self.model = Tokenizer(self.tokenizer.model)
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=False)
        self.apart = _keeps_apart(iter(vocabulary), self.letters)
        #: bytes of each id's token
        self.width = np.zeros(max(vocabulary.values(), default=0) + 1, np.int64)
        for token, k in vocabulary.items():
            self.width[k] = len(token)
        self._clear()

    def _clear(self) -> None:
        #: place of each chunk; the ids of the chunk at place k are pool[start[k]: start[k + 1]]
        self.known, self.start, self.pool = _Places(), np.zeros(1, np.int64), np.zeros(0, "<u4")

    def _side_by_side(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of plain chunks and the number of each chunk's ids."""
        sequences = ["".join(chunks[lo: lo + _AT_ONCE]).encode() for lo in range(0, len(chunks), _AT_ONCE)]
        shown = [self.letters[np.frombuffer(x, np.uint8)].tobytes().decode("utf-32-le") for x in sequences]
        got = self.model.encode_batch_fast(shown, add_special_tokens=False)
        ids = np.fromiter(chain.from_iterable(x.ids for x in got), "<u4")
        ends = np.cumsum(np.fromiter(map(len, map(str.encode, chunks)), np.int64, len(chunks)))
        last = np.searchsorted(np.cumsum(self.width[ids]), ends)
        return ids, np.diff(last + 1, prepend=0)

    def _learn(self, new: list[str]) -> None:
        """Append the ids of ``new`` chunks, which have the next places, to the pool."""
        plain = np.fromiter(map(bool, map(_PLAIN.fullmatch, new)), bool, len(new)) & self.apart
        odd = np.flatnonzero(~plain).tolist()
        side, sizes = np.zeros(0, "<u4"), np.zeros(len(new), np.int64)
        if plain.any():
            side, sizes[plain] = self._side_by_side(list(compress(new, plain.tolist())))
        if odd:
            got = self.tokenizer.encode_batch_fast([new[k] for k in odd], add_special_tokens=False)
            at, pieces, done = np.cumsum(sizes), [], 0
            for k, x in zip(odd, got):
                pieces += [side[done: at[k]], np.array(x.ids, "<u4")]
                done = at[k]
                sizes[k] = len(x.ids)
            side = np.concatenate([*pieces, side[done:]])
        self.pool = np.concatenate([self.pool, side])
        self.start = np.concatenate([self.start, self.start[-1] + np.cumsum(sizes)])

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text, the end id appended."""
        split = [_CHUNK.findall(x) for x in texts]
        if len(self.known) > _CACHE:
            self._clear()
        known, before = self.known, len(self.known)
        n = np.array([len(x) for x in split], np.int64)
        at = np.fromiter(map(known.__getitem__, chain.from_iterable(split)), np.int64, int(n.sum()))
        if len(known) > before:
            self._learn(list(islice(known, before, None)))
        sizes = self.start[at + 1] - self.start[at]
        ends = np.cumsum(sizes)
        ids = self.pool[np.arange(int(sizes.sum())) + np.repeat(self.start[at] - ends + sizes, sizes)]
        bounds = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(n)])]
        end = np.array([END_ID], "<u4")
        return [np.concatenate([ids[a:b], end]) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist())]


@lru_cache(maxsize=1)
def _encoder(tokenizer_path: str) -> Encoder:
    """One encoder a Python worker, kept over its tasks."""
    return Encoder(tokenizer_path)


_BLOCK = pa.schema([("part", pa.int64()), ("seq", pa.int64()), ("n_docs", pa.int64()), ("n_tokens", pa.int64()),
                    ("payload", pa.binary())])


def _blocks(batches: Iterator[pa.RecordBatch], tokenizer_path: str, block_tokens: int) -> Iterator[pa.RecordBatch]:
    encoder, part, seq = _encoder(tokenizer_path), TaskContext.get().partitionId(), 0
    doc_ids: list[int | None] = []
    ids: list[np.ndarray] = []
    held = 0

    def block() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(
            [part, seq, len(ids), held, pack(doc_ids, ids)], _BLOCK.types)], schema=_BLOCK)

    for batch in batches:
        for lo in range(0, batch.num_rows, 256):
            some = batch.slice(lo, 256)
            texts = [x or "" for x in some.column(1).to_pylist()]
            for doc_id, got in zip(some.column(0).to_pylist(), encoder.encode(texts)):
                doc_ids.append(doc_id)
                ids.append(got)
                held += len(got)
                if held >= block_tokens:
                    yield block()
                    doc_ids, ids, held, seq = [], [], 0, seq + 1
    if ids:
        yield block()


def write_tokens(docs: DataFrame, path: str, tokenizer_path: str, block_tokens: int = BLOCK_TOKENS) -> None:
    """Encode whole texts and write them in ascending doc_id order (NULL first, repeated ids by text hash).

    Rows are range-partitioned by id and text hash, so no id holds a task up; a block closes once it has
    ``block_tokens``. NULL texts count as empty and keep their end id. Parquet's compression removes the unused high
    bytes of the ids.
    """
    tie = F.xxhash64(F.coalesce(F.col("text"), F.lit("")))
    rows = docs.select(F.col("doc_id").cast("bigint"), "text", tie.alias("tie"))
    rows = rows.repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie").select("doc_id", "text")
    blocks = rows.mapInArrow(lambda it: _blocks(it, tokenizer_path, block_tokens),
                             "part long, seq long, n_docs long, n_tokens long, payload binary")
    blocks.write.option("compression", "zstd").parquet(path)


def _documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in range(batch.num_rows):
            part, seq, payload = (batch.column(k)[row].as_py() for k in range(3))
            doc_ids, boundaries, ids = unpack(payload)
            ends = boundaries.decode()
            starts = np.concatenate([[0], ends[:-1]]).astype(np.int64)
            crcs = [zlib.crc32(ids[4 * a: 4 * b]) for a, b in zip(starts.tolist(), ends.tolist())]
            n = len(ends)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(n, part)), pa.array(np.full(n, seq)), pa.array(doc_ids, pa.int64()), pa.array(starts),
                 pa.array(ends - starts), pa.array(crcs, pa.int64())],
                names=["part", "seq", "doc_id", "start", "n_tokens", "ids_crc32"])


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """Per document: doc_id, start (over the whole dataset), n_tokens, ids_crc32, all decoded from the blocks.

    Only the short block table is summed up for the offsets; payloads are decoded where they are read.
    """
    blocks = spark.read.parquet(path)
    parts = blocks.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    # one row per written file: the only global order, and a short one
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    earlier = Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (blocks.select("part", "seq", "n_tokens").join(parts, "part")
               .select("part", "seq", (F.col("base") + F.coalesce(F.sum("n_tokens").over(earlier), F.lit(0))).alias("offset")))
    rows = blocks.select("part", "seq", "payload").mapInArrow(
        _documents, "part long, seq long, doc_id long, start long, n_tokens long, ids_crc32 long")
    return rows.join(offsets, ["part", "seq"]).select(
        "doc_id", (F.col("start") + F.col("offset")).alias("start"), "n_tokens", "ids_crc32")


def token_files(docs: DataFrame, tokenizer_path: str, path: str | None = None,
                block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """Write the dataset (to ``path`` or a new folder of the shared one) and read it back."""
    path = path or new_path(docs.sparkSession, "tokens")
    write_tokens(docs, path, tokenizer_path, block_tokens)
    return read_tokens(docs.sparkSession, path)
