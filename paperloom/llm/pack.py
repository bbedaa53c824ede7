"""Best-fit packing of token sequences with a bounded number of open bins.

Tokens come from a word-level vocabulary whose pieces (words, single digits,
punctuation runs) are encoded one by one and never cross white space, so each
task keeps the ids of the runs it has met; texts outside plain Latin letters go to the tokenizer whole.

Packing sees lengths only. The documents' pieces are dealt to groups of about
``group_docs`` documents by hash; a group's pieces come in the order of their ids to an online best-fit of bounded space:
open bins hang on their free space, a bitset of the occupied free spaces finds
the tightest bin in a few word operations, and a piece that fits none opens a bin; when ``open_bins`` are open, the
fullest closes first and what it has left stays empty. On the test tables 256 open bins need 0.6 % more sequences than the
tokens fill, as many as unbounded best-fit; sorting the pieces longest first would save most of that, but is not online.

Edge cases: null and empty texts are the end token alone; longer documents are
cut every ``capacity`` tokens; repeated rows are packed as often as they come; a
null doc_id is kept; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean, slices, text_buffer, word_hashes, word_spans

#: Bytes that no plain text has. Plain characters need no library for normal form, case and class: tab, line
#: ends, U+0020-7E, U+00A1-AC, U+00AE-0129, U+0132-017F.
_NEVER = np.ones(256, bool)
_NEVER[[9, 10, 13]] = False
_NEVER[0x20:0x7F] = False
_NEVER[0x80:0xC0] = False
_NEVER[0xC2:0xC6] = False
#: The vocabulary's own splitting rule (fixed value).
_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: White-space runs, and pieces, that a task remembers at most (in about 15 and 50 MB).
_REMEMBER = 250_000


class Encoder:
    """Ids of texts under a tokenizer file.

    Pieces never cross white space, so the ids of a lower-cased white-space run
    are kept under its 64-bit hash (in sorted arrays: a dictionary takes ten times
    their room), and a batch is put together from them with array operations. Runs not met before are cut into pieces; a piece goes to
    the tokenizer's model once. Texts with other characters are encoded whole.
    """

    def __init__(self, path: str):
        import regex
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.pieces = regex.compile(_SPLIT).findall
        self.symbol = _byte_symbols()
        self.of_piece: dict[str, bytes] = {}
        self.forget()

    def forget(self) -> None:
        self.codes, self.slots = np.zeros(0, np.uint64), np.zeros(0, np.int32)
        self.flat, self.used = np.zeros(1 << 16, np.uint32), 0
        self.lo, self.n = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64)

    def whole(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)

    def _piece(self, piece: str) -> bytes:
        if len(self.of_piece) >= _REMEMBER:
            self.of_piece.clear()
        got = self.of_piece[piece] = array("I", [t.id for t in self.tokenizer.model.tokenize(piece.translate(self.symbol))]).tobytes()
        return got

    def _learn(self, runs: list[str]) -> np.ndarray:
        """Slots of runs not met before."""
        ids = bytearray()
        ends: list[int] = []
        known, pieces = self.of_piece.get, self.pieces
        for run in runs:
            for piece in pieces(run):
                ids += known(piece) or self._piece(piece)
            ends.append(len(ids) // 4)
        first, n, end = len(self.codes), len(runs), self.used + len(ids) // 4
        while first + n > len(self.lo):
            self.lo, self.n = np.resize(self.lo, 2 * len(self.lo)), np.resize(self.n, 2 * len(self.n))
        while end > len(self.flat):
            self.flat = np.resize(self.flat, 2 * len(self.flat))
        self.flat[self.used : end] = np.frombuffer(ids, np.uint32)
        cuts = np.array([0, *ends])
        self.lo[first : first + n], self.n[first : first + n] = self.used + cuts[:-1], np.diff(cuts)
        self.used = end
        return np.arange(first, first + n, dtype=np.int32)

    def many(self, column: pa.Array) -> list[np.ndarray]:
        """Ids of each text of a string column."""
        if len(self.codes) > _REMEMBER:
            self.forget()
        texts = pc.fill_null(column.cast(pa.large_string()), "")
        raw, offsets, _ = text_buffer(texts)
        odd = _odd(raw, offsets)
        if len(odd):
            keep = np.ones(len(texts), bool)
            keep[odd] = False
            plain = pc.if_else(pa.array(keep), texts, "")
        else:
            plain = texts
        raw, offsets, _ = text_buffer(pc.utf8_lower(plain))
        starts, ends, first = word_spans(raw, offsets)
        codes, at, inverse = np.unique(word_hashes(raw, starts, ends), return_index=True, return_inverse=True)
        place = np.searchsorted(self.codes, codes)
        slot = np.full(len(codes), -1, np.int32)
        there = np.flatnonzero(place < len(self.codes))
        there = there[self.codes[place[there]] == codes[there]]
        slot[there] = self.slots[place[there]]
        new = np.flatnonzero(slot < 0)
        if len(new):
            data = raw.tobytes()
            runs = [data[a:b].decode() for a, b in zip(starts[at[new]].tolist(), ends[at[new]].tolist(), strict=True)]
            slot[new] = self._learn(runs)
            self.codes, self.slots = np.insert(self.codes, place[new], codes[new]), np.insert(self.slots, place[new], slot[new])
        slot = slot[inverse]
        n = self.n[slot]
        total = np.concatenate(([0], np.cumsum(n)))
        ids = self.flat[np.repeat(self.lo[slot] - total[:-1], n) + np.arange(total[-1])]
        cut = total[first]
        out = [ids[a:b] for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)]
        for i in odd.tolist():
            out[i] = self.whole(texts[i].as_py())
        return out


def _byte_symbols() -> dict[int, str]:
    """Code point → the printable symbols that a byte-level model has for its UTF-8 bytes, for plain texts.

    Fixed values: printable ASCII and Latin-1 stand for themselves, the other bytes follow from U+0100 on.
    """
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    of = {b: chr(b) for b in shown}
    for b in range(256):
        if b not in of:
            of[b] = chr(256 + len(of) - len(shown))
    return {c: "".join(of[b] for b in chr(c).encode()) for c in range(0x180)}


def _odd(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Texts with characters outside ``_PLAIN``'s ranges, or with the opening of a special token."""
    if not len(raw):
        return np.zeros(0, np.int64)
    bad = _NEVER[raw]
    after = raw[1:]
    bad[:-1] |= (raw[:-1] == 0xC2) & ((after == 0xA0) | (after == 0xAD) | (after < 0xA0))
    bad[:-1] |= (raw[:-1] == 0xC4) & (after >= 0xAA) & (after <= 0xB1)
    bad[:-1] |= (raw[:-1] == 60) & (after == 124)
    return np.unique(np.searchsorted(offsets, np.flatnonzero(bad), side="right") - 1)


def tokenize(docs: DataFrame, tokenizer: str, capacity: int, end_id: int) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of docs(doc_id, text)."""
    id_type = docs.schema["doc_id"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = Encoder(tokenizer)  # of this task: one kept by the worker would stand beside all later stages' memory
        tail = np.array([end_id], np.uint32)
        for batch in batches:
            _, offsets, _ = text_buffer(batch.column(1))
            row, piece, start, length, crc = [], [], [], [], []
            for lo, hi in slices(offsets):
                for i, ids in enumerate(code.many(batch.column(1).slice(lo, hi - lo)), lo):
                    ids = np.concatenate((ids, tail)).astype("<u4", copy=False)
                    for k in range(0, len(ids), capacity):
                        part = ids[k : k + capacity]
                        row.append(i)
                        piece.append(k // capacity)
                        start.append(k)
                        length.append(len(part))
                        crc.append(zlib.crc32(part))
            yield pa.record_batch(
                [batch.column(0).take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())],
                names=["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    schema = f"doc_id {id_type.simpleString()}, piece int, start long, length long, ids_crc32 long"
    return docs.select("doc_id", "text").mapInArrow(lean(run), schema)


class BestFit:
    """Bounded-space online best-fit: ``place(n)`` gives (bin, offset)."""

    def __init__(self, capacity: int, open_bins: int):
        self.capacity, self.limit = capacity, open_bins
        self.free: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.bits = self.open = self.made = self.closed = 0

    def _take(self, space: int) -> int:
        got = self.free[space].pop()
        if not self.free[space]:
            self.bits &= ~(1 << space)
        self.open -= 1
        return got

    def place(self, n: int) -> tuple[int, int]:
        fits = self.bits >> n
        if fits:
            space = n + (fits & -fits).bit_length() - 1
            at = self._take(space)
        else:
            if self.open >= self.limit:  # the fullest closes
                self._take((self.bits & -self.bits).bit_length() - 1)
                self.closed += 1
            at, space = self.made, self.capacity
            self.made += 1
        left = space - n
        if left:
            self.free[left].append(at)
            self.bits |= 1 << left
            self.open += 1
        return at, self.capacity - space


def pack(docs: DataFrame, tokenizer: str, capacity: int = 4096, end_id: int = 1, open_bins: int = 256, group_docs: int = 100_000) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every row of docs(doc_id, text)."""
    groups = max(1, math.ceil(docs.count() / group_docs))
    pieces = tokenize(docs, tokenizer, capacity, end_id)
    grouped = pieces.repartition(groups, F.xxhash64("doc_id", "length", "ids_crc32")).sortWithinPartitions("doc_id", "piece", "ids_crc32", "length")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fit = BestFit(capacity, open_bins)
        base = TaskContext.get().partitionId() << 40
        for batch in batches:
            at = [fit.place(n) for n in batch.column(3).to_pylist()]
            yield pa.record_batch(
                [*batch.columns, pa.array([base + b for b, _ in at], pa.int64()), pa.array([o for _, o in at], pa.int64())],
                names=[*batch.schema.names, "sequence_id", "offset"],
            )

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pieces.schema)
    return grouped.mapInArrow(lean(run), f"{schema}, sequence_id long, offset long")
