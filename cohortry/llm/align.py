"""Alignment of two tokenizers over the same bytes.

Both token lists of a text are taken as lists of byte ends. The shorter list drives a galloping search through the
longer one: steps of 1, 2, 4, ... from the last place, then a binary search inside the last step. Common ends cut both
lists into groups. The ranks of a token's start and end in the other list give the tokens that it overlaps.

Work is kept by segment: a blank after a word ends a token of both tokenizers, so no group reaches over it, and a
segment seen before is neither encoded nor aligned again.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterator, Sequence
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortry.llm.common import written
from cohortry.llm.token_files import _SPACE, Encoder

_OTHER = _SPACE.replace(" ", "")
#: From a blank that follows a word (or begins the text) to the next such blank.
_SEGMENT = re.compile(f" [{_SPACE}]*[^{_SPACE}]*(?:[{_OTHER}][{_SPACE}]*[^{_SPACE}]*)*")
_BLANK = "\u2581"
#: Segments and links held by a worker before it starts anew.
_CACHE, _CACHE_LINKS = 500_000, 6_000_000
#: A link is ``a * B_IDS + b``; both vocabularies together stay below 63 bits.
B_IDS = 1 << 24


def gallop(values: Sequence[int], x: int, start: int) -> int:
    """First place at or after ``start`` whose value is at least ``x``."""
    step, n = 1, len(values)
    at = start
    while at < n and values[at] < x:
        start, at, step = at + 1, at + step, 2 * step
    return bisect_left(values, x, start, min(at, n))


def common_ends(a: Sequence[int], b: Sequence[int]) -> list[tuple[int, int]]:
    """Places in ``a`` and ``b`` of the values both ascending lists hold."""
    swapped = len(a) > len(b)
    short, long = (b, a) if swapped else (a, b)
    found, at = [], 0
    for i, x in enumerate(short):
        at = gallop(long, x, at)
        if at == len(long):
            break
        if long[at] == x:
            found.append((at, i) if swapped else (i, at))
            at += 1
    return found


def groups(ends: list[tuple[int, int]]) -> list[tuple[range, range]]:
    """Token ranges of both sides between consecutive common ends."""
    out, i, j = [], 0, 0
    for x, y in ends:
        out.append((range(i, x + 1), range(j, y + 1)))
        i, j = x + 1, y + 1
    return out


def overlaps(a: Sequence[int], b: Sequence[int]) -> list[range]:
    """For each token of ``a`` the tokens of ``b`` that share a byte with it, from the ranks of its start and end."""
    out, before, at = [], 0, 0
    for end in a:
        first = gallop(b, before + 1, at)
        at = gallop(b, end, first)
        out.append(range(first, min(at + 1, len(b))))
        before, at = end, first
    return out


def byte_level_bytes(tokenizer) -> list[bytes]:
    """Bytes of every entry of a byte-level vocabulary, by id."""
    visible = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [x for x in range(256) if x not in set(visible)]
    byte_of = {chr(x): x for x in visible} | {chr(0x100 + k): x for k, x in enumerate(hidden)}
    vocabulary = tokenizer.get_vocab(with_added_tokens=False)
    out = [b""] * (max(vocabulary.values(), default=-1) + 1)
    for token, k in vocabulary.items():
        out[k] = bytes(byte_of[c] for c in token)
    return out


def piece_bytes(pieces) -> list[bytes]:
    """Bytes of every piece, by id."""
    out = []
    for k in range(len(pieces)):
        piece = pieces.id_to_piece(k)
        out.append(bytes([int(piece[1:-1], 16)]) if pieces.is_byte(k) else piece.replace(_BLANK, " ").encode())
    return out


class Aligner:
    """Both tokenizers with the segments they have met."""

    def __init__(self, byte_level: str, piece_model: str):
        import sentencepiece

        self.encoder = Encoder(byte_level)
        self.encoder.tokenizer.encode_special_tokens = True
        self.pieces = sentencepiece.SentencePieceProcessor(model_file=piece_model)
        self.a_bytes, self.b_bytes = byte_level_bytes(self.encoder.model), piece_bytes(self.pieces)
        if len(self.b_bytes) > B_IDS:
            raise ValueError("too many pieces for the code of a link")
        self.a_size, self.b_size = (np.array([len(x) for x in of], np.int64) for of in (self.a_bytes, self.b_bytes))
        self.blank = self.pieces.piece_to_id(_BLANK)
        # a piece that goes on after a blank could reach over a segment's end
        self.splits = not any(re.search(f"[^{_BLANK}]{_BLANK}", self.pieces.id_to_piece(k)) for k in range(len(self.b_bytes)))
        self._clear()

    def _clear(self) -> None:
        #: number of each segment; its shown groups, (tokens by either, groups, whether the bytes agree), place of its links
        self.known: dict[str, int] = {}
        self.shown: list[str] = []
        self.sizes, self.start = np.zeros((0, 4), np.int64), np.zeros(1, np.int64)
        self.links = np.zeros(0, np.int64)

    def encode_pair(self, segments: list[str]) -> tuple[list[np.ndarray], list[list[int]]]:
        """Ids of each segment, which begins with a blank, by both tokenizers."""
        a = [x[:-1] for x in self.encoder.encode(segments)]
        b = self.pieces.encode([s[1:] for s in segments], num_threads=1)
        # the model adds no blank to an empty text
        return a, [ids or [self.blank] for ids in b]

    def _learn(self, segments: list[str]) -> None:
        """Align new segments, all in one pass: a segment's end is common to both lists, so none reaches into the next."""
        a, b = self.encode_pair(segments)
        raw = [s.encode() for s in segments]
        size = np.fromiter(map(len, raw), np.int64, len(raw))
        na, nb = (np.fromiter(map(len, x), np.int64, len(x)) for x in (a, b))
        flat_a, flat_b = np.concatenate(a).astype(np.int64), np.fromiter(chain.from_iterable(b), np.int64, int(nb.sum()))
        wide_a, wide_b = self.a_size[flat_a], self.b_size[flat_b]
        same = np.ones(len(raw), bool)
        joined = b"".join(raw)
        for ids, n, width, of in ((flat_a, na, wide_a, self.a_bytes), (flat_b, nb, wide_b, self.b_bytes)):
            same &= np.add.reduceat(width, np.cumsum(n) - n) == size
            if b"".join([of[k] for k in ids.tolist()]) != joined:
                ends = np.cumsum(n).tolist()
                same &= np.array([b"".join([of[k] for k in ids[e - m: e].tolist()]) == x for e, m, x in zip(ends, n.tolist(), raw)])
        keep_a, keep_b = np.repeat(same, na), np.repeat(same, nb)
        ends = common_ends(np.cumsum(wide_a[keep_a]).tolist(), np.cumsum(wide_b[keep_b]).tolist())
        at = np.array(ends, np.int64).reshape(-1, 2)
        links = flat_a[keep_a][at[:, 0]] * B_IDS + flat_b[keep_b][at[:, 1]]
        show_a, show_b = list(map(str, flat_a[keep_a].tolist())), list(map(str, flat_b[keep_b].tolist()))
        cut = [",".join(show_a[x.start: x.stop]) + "|" + ",".join(show_b[y.start: y.stop]) for x, y in groups(ends)]
        # groups up to each segment's end: those whose token is before the end of its tokens
        upto = np.searchsorted(at[:, 0], np.cumsum(np.where(same, na, 0)))
        per = np.diff(upto, prepend=0)
        for segment, lo, hi in zip(segments, (upto - per).tolist(), upto.tolist()):
            self.known[segment] = len(self.shown)
            self.shown.append(";".join(cut[lo:hi]))
        self.sizes = np.concatenate([self.sizes, np.stack([na, nb, per, same.astype(np.int64)], 1)])
        self.start = np.concatenate([self.start, self.start[-1] + upto])
        self.links = np.concatenate([self.links, links])

    def align(self, texts: list[str]) -> Iterator[tuple[int, int, int, str, np.ndarray]]:
        """n_a, n_b, n_groups, groups_sha256 and the links (codes, one each) of every text."""
        split = [_SEGMENT.findall(" " + x) if self.splits else [" " + x] for x in texts]
        if len(self.known) > _CACHE or len(self.links) > _CACHE_LINKS:
            self._clear()
        known = self.known
        new = list(dict.fromkeys(s for some in split for s in some if s not in known))
        if new:
            self._learn(new)
        shown = self.shown
        for text, some in zip(texts, split):
            at = [known[s] for s in some]
            places = np.array(at, np.int64)
            n_a, n_b, n, same = self.sizes[places].sum(axis=0).tolist()
            if not text or same < len(at):
                yield 0, 0, 0, "", np.zeros(0, np.int64)
                continue
            per = self.sizes[places, 2]
            ends = np.cumsum(per)
            links = self.links[np.arange(n) + np.repeat(self.start[places] - ends + per, per)]
            yield n_a, n_b, n, hashlib.sha256(";".join([shown[k] for k in at]).encode()).hexdigest(), links


@lru_cache(maxsize=1)
def _aligner(byte_level: str, piece_model: str) -> Aligner:
    """One aligner a Python worker, kept over its tasks."""
    return Aligner(byte_level, piece_model)


_ROWS = pa.schema([("doc_id", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()),
                   ("groups_sha256", pa.string()), ("links", pa.list_(pa.int64())), ("times", pa.list_(pa.int32()))])
_DDL = ("doc_id long, n_a long, n_b long, n_groups long, groups_sha256 string, links array<bigint>, times array<int>")


def _aligned_rows(batches: Iterator[pa.RecordBatch], byte_level: str, piece_model: str) -> Iterator[pa.RecordBatch]:
    aligner = _aligner(byte_level, piece_model)
    for batch in batches:
        for lo in range(0, batch.num_rows, 256):
            some = batch.slice(lo, 256)
            columns: list[list] = [[], [], [], []]
            links, times, sizes = [], [], []
            for *out, codes in aligner.align([x or "" for x in some.column(1).to_pylist()]):
                for column, value in zip(columns, out):
                    column.append(value)
                found, n = np.unique(codes, return_counts=True)
                links.append(found)
                times.append(n)
                sizes.append(len(found))
            offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32())
            lists = [pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(x), t))
                     for x, t in ((links, pa.int64()), (times, pa.int32()))]
            yield pa.RecordBatch.from_arrays(
                [some.column(0), *[pa.array(c, f.type) for c, f in zip(columns, list(_ROWS)[1:])], *lists], schema=_ROWS)


def aligned(docs: DataFrame, byte_level: str, piece_model: str) -> DataFrame:
    """Per document: doc_id, token and group numbers, digest of the groups, and its distinct links with their times."""
    rows = docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string"))
    return rows.mapInArrow(lambda it: _aligned_rows(it, byte_level, piece_model), _DDL)


def _totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Times of each link over the task; their number is bounded by the vocabularies (see ``link_counts``)."""
    codes, n = np.zeros(0, np.int64), np.zeros(0, np.int64)
    for batch in batches:
        new = np.asarray(batch.column(0).flatten(), np.int64)
        times = np.asarray(batch.column(1).flatten(), np.int64)
        codes, at = np.unique(np.concatenate([codes, new]), return_inverse=True)
        n = np.bincount(at, weights=np.concatenate([n, times]), minlength=len(codes)).astype(np.int64)
    yield pa.RecordBatch.from_arrays([pa.array(codes), pa.array(n)], names=["link", "n"])


def link_counts(rows: DataFrame) -> DataFrame:
    """link, n, best: how often each pair of ids is linked in all documents, and whether no other pair of its B id is
    linked more often.

    Two tokens that end together are suffixes of the same bytes, so one is a suffix of the other: there are at most as
    many pairs as both vocabularies have bytes, whatever the corpus.
    """
    counts = rows.select("links", "times").mapInArrow(_totals, "link long, n long").groupBy("link").agg(F.sum("n").alias("n"))
    counts = counts.withColumn("b", F.col("link") % B_IDS)
    top = counts.groupBy("b").agg(F.max("n").alias("top"))
    return counts.join(top, "b").select("link", "n", (F.col("n") == F.col("top")).alias("best"))


def _scored(batches: Iterator[pa.RecordBatch], table) -> Iterator[pa.RecordBatch]:
    links, counts, best = table.value
    for batch in batches:
        sizes = np.asarray(batch.column(5).value_lengths(), np.int64)
        doc = np.repeat(np.arange(batch.num_rows), sizes)
        times = np.asarray(batch.column(6).flatten(), np.int64)
        at = np.searchsorted(links, np.asarray(batch.column(5).flatten(), np.int64))
        sums = np.zeros((3, batch.num_rows), np.int64)
        for out, value in zip(sums, (times, times * best[at], times * counts[at])):
            np.add.at(out, doc, value)
        yield pa.RecordBatch.from_arrays(
            [*batch.columns[:4], *[pa.array(x) for x in sums], batch.column(4)],
            names=["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"])


def alignment(docs: DataFrame, byte_level: str, piece_model: str) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256 of every row of ``docs``.

    A NULL or empty text, or one whose bytes a tokenizer changes, has zeros and '' and adds nothing to the counts. Rows
    with the same id are documents of their own. The table of link counts, bounded by the vocabularies, is broadcast.
    """
    spark = docs.sparkSession
    rows = written(aligned(docs, byte_level, piece_model), "aligned")
    found = link_counts(rows).toArrow().sort_by("link")
    table = spark.sparkContext.broadcast((
        np.asarray(found["link"], np.int64), np.asarray(found["n"], np.int64), np.asarray(found["best"]).astype(np.int64)))
    return rows.mapInArrow(
        lambda it: _scored(it, table),
        "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string")
