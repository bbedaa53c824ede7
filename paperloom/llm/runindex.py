"""Byte-level substring deduplication with run-length indexes (run-compressed Burrows-Wheeler transforms).

A window is ``window`` consecutive UTF-8 bytes of a document; a byte goes if a window
that covers it also starts earlier (smaller doc_id, or earlier in the document).

1. Texts that equal an earlier text go whole, if they have a window; they take no further part.
2. Each window picks the smallest hash among its ``gram``-byte grams. Equal windows pick equal grams, so only windows
   whose gram recurs can recur. The hashes meet in one shuffle; those that recur within a batch are settled there.
3. Runs of windows that pick one recurring gram are cut out as snippets and dealt to shards by that gram, so all
   places of a window meet in one shard. Where a batch holds a snippet twice, later places go at once and one is dealt. A gram that
   more than ``hot`` documents pick is dealt by whole windows instead, whose places all have the same bytes.
4. Each shard, of bounded bytes, joins its snippets in the order of their places and builds a run-length index: the runs
   of the transform, and at each run's head the text position, the position at the end of the run before it and the length of
   their common prefix (`RunIndex`). Nothing else of the suffix order is kept. Streaming the text through these samples gives each position's matching statistics, the
   length of the longest match with the text before it in suffix order and where that is. Matches of a window or more chain all places of a window
   together, and all but the first of a chain go.
5. Documents with removed windows are read once more and cut.

Memory: a shard is about SHARD_BYTES of distinct snippets; long texts are worked through in pieces that overlap by a window.

Edge cases: null, empty and short texts have no window and lose nothing; matches never
cross documents; repeated rows (equal doc_id and text) count as one document, neither is earlier; other texts
under one doc_id stand in the order of a hash of the text; null doc_ids are one document's that comes
last; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import CHUNK_BYTES, Scratch, lean, mix, signed, slices, small, text_buffer
from .phrases import _NO_ID, _slide, _twice, copies, recurring

#: Distinct snippet bytes of a shard's index, but for one gram's last snippets.
SHARD_BYTES = 2 << 20
#: Window starts of a snippet at most, so that snippets stay short in text that repeats itself.
RUN = 256
#: Documents that may pick a gram before its windows are dealt one by one.
HOT = 20_000
_GOLD = np.uint64(0x9E3779B97F4A7C15)
_SEPARATOR, _START = 0xFF, 0xFE  # bytes that UTF-8 never has


# ---------------------------------------------------------------- the index


def _words(text: np.ndarray) -> np.ndarray:
    """The eight bytes at each position as a number, first byte first; zeros behind the end."""
    padded = np.concatenate((text, np.zeros(8, np.uint8)))
    return np.ndarray((len(text),), ">u8", padded.data, strides=(1,)).astype(np.uint64)


def suffix_order(text: np.ndarray) -> np.ndarray:
    """Start positions of all suffixes in their order: sorted by eight bytes, then what is still equal by doubled lengths."""
    n = len(text)
    if n == 0:
        return np.zeros(0, np.int64)
    word = _words(text)
    order = np.argsort(word, kind="stable")
    ordered = word[order]
    head = np.ones(n, bool)
    head[1:] = ordered[1:] != ordered[:-1]
    place = np.zeros(n, np.int64)  # of a suffix: the slot of its class's head, from 1
    place[order] = np.maximum.accumulate(np.where(head, np.arange(n), 0)) + 1
    step = 8
    while True:
        tail = np.ones(n, bool)
        tail[:-1] = head[1:]
        slots = np.flatnonzero(~(head & tail))
        if not len(slots):
            return order
        s = order[slots]
        beyond = s + step
        key = (place[s] << 32) | np.where(beyond < n, place[np.minimum(beyond, n - 1)], 0)
        again = np.argsort(key)
        key, s = key[again], s[again]
        order[slots] = s
        parts = np.ones(len(slots), bool)
        parts[1:] = key[1:] != key[:-1]
        head[slots] = parts
        place[s] = np.maximum.accumulate(np.where(parts, slots, 0)) + 1
        step *= 2


def common_prefix(word: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Length of the common prefix of the suffixes at a and b (a <> b), eight bytes at a time."""
    n = len(word)
    room = n - np.maximum(a, b)
    length = np.zeros(len(a), np.int64)
    live = np.arange(len(a))
    while len(live):
        at = length[live]
        inside = at < room[live]
        live, at = live[inside], at[inside]
        gap = word[a[live] + at] ^ word[b[live] + at]
        same = np.full(len(live), 8, np.int64)
        off = gap != 0
        same[off] = sum((gap[off] < np.uint64(1 << bits)).astype(np.int64) for bits in range(8, 64, 8))
        length[live] = at + same
        live = live[~off]
    return np.minimum(length, room)


class RunIndex:
    """Run-length Burrows-Wheeler transform of a text with samples at its runs' heads.

    heads, lengths: the runs' bytes (_START stands before the text) and lengths. at: text positions of the suffixes at run heads, ascending;
    before: the position of the suffix before each in suffix order, the end of the run before it; shared: the length of their common prefix.

    Within a run, the suffixes of two neighbours are preceded by equal bytes, so going back one byte keeps them
    neighbours: between two samples both positions advance together and the common prefix shrinks by one a byte.
    """

    def __init__(self, text: np.ndarray):
        order = suffix_order(text)
        byte = np.where(order > 0, text[order - 1], _START) if len(text) else np.zeros(0, np.uint8)
        head = np.ones(len(order), bool)
        head[1:] = byte[1:] != byte[:-1]
        runs = np.flatnonzero(head)
        self.size = len(text)
        self.heads = byte[runs].astype(np.uint8)
        self.lengths = np.diff(np.append(runs, len(order)))
        at, before = order[runs], order[np.maximum(runs - 1, 0)]
        shared = np.zeros(len(runs), np.int64)
        shared[1:] = common_prefix(_words(text), at[1:], before[1:])
        by_text = np.argsort(at)
        self.at, self.before, self.shared = at[by_text], before[by_text], shared[by_text]

    def matching(self, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray]:
        """(length, position) of the longest match of the text at lo..hi-1 with what is before it in suffix order."""
        position = np.arange(lo, hi)
        sample = np.searchsorted(self.at, position, side="right") - 1
        on = position - self.at[sample]
        return np.maximum(self.shared[sample] - on, 0), self.before[sample] + on

    def repeats(self, whole: np.ndarray, window: int) -> np.ndarray:
        """Whether the window at each position, where whole, also starts earlier in the text."""
        up = np.arange(self.size)
        for lo in range(0, self.size, CHUNK_BYTES):
            hi = min(lo + CHUNK_BYTES, self.size)
            length, where = self.matching(lo, hi)
            long = np.flatnonzero((length >= window) & whole[lo:hi])
            up[lo + long] = where[long]
        linked = np.flatnonzero(up != np.arange(self.size))
        root = up[linked]
        while len(root):
            above = up[root]
            if (above == root).all():
                break
            up[linked] = root = above
        first = np.arange(self.size)
        first[root[::-1]] = linked[::-1]  # the smallest is written last
        first = np.minimum(first, np.arange(self.size))
        again = np.zeros(self.size, bool)
        again[linked] = linked > first[root]
        again[root] = first[root] < root
        return again


# ---------------------------------------------------------------- windows and snippets


def byte_grams(raw: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of k bytes; k is 8 times a power of two."""
    h = mix(_words(raw)[: max(0, len(raw) - 7)] + _GOLD)
    size = 8
    while size < k:
        h = mix(h[: max(0, len(h) - size)] * _GOLD + h[size:])
        size *= 2
    return h


def pieces(raw: np.ndarray, offsets: np.ndarray, window: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, int]]:
    """(first row, end row, text, offsets, start): slices of bounded bytes; one longer text comes in pieces that share window - 1 bytes."""
    for lo, hi in slices(offsets):
        a, b = int(offsets[lo]), int(offsets[hi])
        if b - a <= CHUNK_BYTES + window:
            yield lo, hi, raw[a:b], offsets[lo : hi + 1] - a, 0
            continue
        for s in range(0, max(1, b - a - window + 1), CHUNK_BYTES):
            text = raw[a + s : min(b, a + s + CHUNK_BYTES + window - 1)]
            yield lo, hi, text, np.array([0, len(text)]), s


class Runs:
    """Runs of consecutive windows of a document that pick one gram: first window, how many, gram, document."""

    def __init__(self, raw: np.ndarray, offsets: np.ndarray, window: int, gram: int):
        n = len(raw) - window + 1
        none = np.zeros(0, np.int64)
        self.start, self.count, self.key, self.doc = none, none, none.view(np.uint64), none
        if n <= 0:
            return
        self.gram, self.reach = byte_grams(raw, gram), window - gram + 1
        low = _slide(self.gram, self.reach, np.minimum)
        edge = np.zeros(n + 1, np.int32)  # windows that reach over a document's end
        for cut in np.unique(offsets[1:-1]).tolist():
            edge[min(n, max(0, cut - window + 1))] += 1
            edge[min(n, cut)] -= 1
        valid = np.cumsum(edge[:n]) == 0
        head = valid.copy()
        head[1:] &= ~valid[:-1] | (low[1:] != low[:-1])
        start = np.flatnonzero(head)
        stop = valid.copy()
        stop[:-1] &= ~valid[1:] | head[1:]
        count = np.flatnonzero(stop) + 1 - start
        more = (count + RUN - 1) // RUN
        on = np.arange(more.sum()) - np.repeat(np.cumsum(more) - more, more)
        self.start = np.repeat(start, more) + on * RUN
        self.count = np.minimum(np.repeat(count, more) - on * RUN, RUN)
        self.key = low[self.start]
        self.doc = np.searchsorted(offsets, self.start, side="right") - 1
        self.low = np.where(valid, low, np.uint64(0))

    def picked(self) -> np.ndarray:
        """Positions of the grams that windows pick; one run may pick a gram at several."""
        pad = np.zeros(self.reach - 1, np.uint64)
        top = _slide(np.concatenate((pad, self.low, pad)), self.reach, np.maximum)
        return np.flatnonzero((top == self.gram) & (top > 0))


def grams(docs: DataFrame, window: int, gram: int) -> DataFrame:
    """key, doc_id, version, known: hashes of the grams that windows pick, once a document; known rows stand twice in
    their slice, with one row of version -1 to tell others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, versions = np.asarray(batch.column(0)), np.asarray(batch.column(1))
            raw, offsets, _ = text_buffer(batch.column(2))
            for lo, _, text, own, _ in pieces(raw, offsets, window):
                r = Runs(text, own, window, gram)
                if not len(r.start):
                    continue
                at = r.picked()
                key, owner = r.gram[at], np.searchsorted(own, at, side="right") - 1
                rows, known, tell = _twice(key, owner)
                doc, none = lo + owner[rows], np.full(len(tell), -1)
                yield pa.record_batch(
                    [pa.array(signed(np.concatenate((key[rows], key[tell])))), pa.array(np.concatenate((ids[doc], none))),
                     pa.array(np.concatenate((versions[doc], none)).astype(np.int32)), pa.array(np.concatenate((known, none == 0)))], names=["key", "doc_id", "version", "known"])

    return docs.mapInArrow(lean(run), "key long, doc_id long, version int, known boolean")


_SNIPPET = "key long, snippet binary, doc_id long, version int, start long, n int"
_NAMES = ["key", "snippet", "doc_id", "version", "start", "n"]


def _rows(found: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.binary(), pa.int64(), pa.int32(), pa.int64(), pa.int32())
    return pa.record_batch([pa.array(c, k) for c, k in zip(zip(*found, strict=True), kinds, strict=True)], names=_NAMES)


def _mine(lists: pa.Array, r: Runs) -> np.ndarray:
    """Whether each run's gram is in its document's list."""
    lists = pa.concat_arrays([lists])
    wanted = np.asarray(lists.flatten()).view(np.uint64)
    owner = np.repeat(np.arange(len(lists), dtype=np.uint64), np.asarray(pc.list_value_length(lists)))
    return np.isin(mix(r.key ^ mix(r.doc.astype(np.uint64))), mix(wanted ^ mix(owner)))


def snippets(docs: DataFrame, window: int, gram: int) -> DataFrame:
    """Snippets to be dealt by key, and (without snippet) windows that a batch has shown to repeat, of docs(doc_id, version, text, keys, hots)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, versions = np.asarray(batch.column(0)), np.asarray(batch.column(1))
            raw, offsets, _ = text_buffer(batch.column(2))
            for lo, hi, text, own, base in pieces(raw, offsets, window):
                r = Runs(text, own, window, gram)
                if not len(r.start):
                    continue
                mine, hot = (_mine(batch.column(c).slice(lo, hi - lo), r) for c in (3, 4))
                start, count, key, doc = (x[mine] for x in (r.start, r.count, r.key, r.doc))
                if hot.any():
                    one = np.repeat(r.start[hot], r.count[hot]) + np.arange(r.count[hot].sum()) - np.repeat(np.cumsum(r.count[hot]) - r.count[hot], r.count[hot])
                    half = (window - gram) // 2
                    whole = mix(mix(r.gram[one] + r.gram[one + half] * _GOLD) + r.gram[one + window - gram])
                    start, count = np.concatenate((start, one)), np.concatenate((count, np.ones(len(one), np.int64)))
                    key, doc = np.concatenate((key, whole)), np.concatenate((doc, np.repeat(r.doc[hot], r.count[hot])))
                if not len(start):
                    continue
                data, place = text.tobytes(), base + start - own[doc]
                order = np.lexsort((place, versions[lo + doc], ids[lo + doc]))
                start, count, key, doc, place = (x[order] for x in (start, count, key, doc, place))
                seen: dict[bytes, tuple] = {}
                found = []
                for a, n, k, i, v, p in zip(start.tolist(), count.tolist(), signed(key).tolist(), ids[lo + doc].tolist(), versions[lo + doc].tolist(), place.tolist(), strict=True):
                    snippet, here = data[a : a + n + window - 1], (i, v, p)
                    first = seen.setdefault(snippet, here)
                    if first is here:
                        found.append((k, snippet, i, v, p, n))
                    elif first != here:
                        found.append((None, None, i, v, p, n))
                yield _rows(found)

    return docs.mapInArrow(lean(run), _SNIPPET)


def decide(held: dict[bytes, tuple[int, int, int]], window: int) -> list[tuple]:
    """(doc_id, version, start, n) of the windows in these snippets, each with its first place, that also start earlier."""
    parts = sorted((place, s) for s, place in held.items())
    text = np.frombuffer(b"\xff".join([*(s for _, s in parts), b""]), np.uint8)
    begin = np.cumsum([0] + [len(s) + 1 for _, s in parts])[:-1]
    edge = np.zeros(len(text) + 1, np.int32)
    edge[begin] += 1
    np.add.at(edge, begin + np.array([len(s) - window + 1 for _, s in parts]), -1)
    again = RunIndex(text).repeats(np.cumsum(edge[:-1]) > 0, window)
    step = np.diff(np.concatenate(([0], again.astype(np.int8), [0])))
    lo, hi = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
    which = np.searchsorted(begin, lo, side="right") - 1
    return [(*parts[s][0][:2], parts[s][0][2] + a, n) for s, a, n in zip(which.tolist(), (lo - begin[which]).tolist(), (hi - lo).tolist(), strict=True)]


def indexed(rows: DataFrame, window: int) -> DataFrame:
    """doc_id, version, start, n of all windows that also start earlier."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bytes, tuple[int, int, int]] = {}
        size, last = 0, None
        for batch in batches:
            done = []
            for k, s, i, v, p, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if s is None:
                    done.append((i, v, p, n))
                    continue
                if size >= SHARD_BYTES and k != last:
                    done += decide(held, window)
                    held, size = {}, 0
                last, here = k, (i, v, p)
                first = held.get(s)
                if first is None:
                    held[s] = here
                    size += len(s) + 1
                elif here != first:
                    if here < first:
                        held[s], here = here, first
                    done.append((*here, n))
            if done:
                yield out(done)
        if held and (done := decide(held, window)):
            yield out(done)

    def out(found: list[tuple]) -> pa.RecordBatch:
        kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int32())
        return pa.record_batch([pa.array(c, k) for c, k in zip(zip(*found, strict=True), kinds, strict=True)], names=["doc_id", "version", "start", "n"])

    n = max(2, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    route = F.when(F.col("snippet").isNull(), F.xxhash64("doc_id", "start")).otherwise(F.xxhash64("key"))
    return rows.repartition(n, route).sortWithinPartitions("key").mapInArrow(lean(run), "doc_id long, version int, start long, n int")


# ---------------------------------------------------------------- the operator


def cut(text: bytes, starts: np.ndarray, counts: np.ndarray, window: int) -> tuple[int, int, bytes]:
    """(bytes removed, maximal removed runs, digest of what is left) for the windows start..start+count-1."""
    order = np.argsort(starts)
    lo, hi = starts[order], starts[order] + counts[order] + window - 1
    top = np.maximum.accumulate(hi)
    new = np.ones(len(lo), bool)
    new[1:] = lo[1:] > top[:-1]
    first = np.flatnonzero(new)
    lo, hi = lo[first], top[np.append(first[1:], len(top)) - 1]
    digest, at, view = hashlib.sha256(), 0, memoryview(text)
    for a, b in zip(lo.tolist(), hi.tolist(), strict=True):
        digest.update(view[at:a])
        at = b
    digest.update(view[at:])
    return int((hi - lo).sum()), len(lo), digest.digest()


def remove_substrings(docs: DataFrame, window: int = 100, gram: int = 32, hot: int = HOT, scratch: Scratch | None = None) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 for each row of docs(doc_id, text)."""
    scratch = scratch or Scratch(docs.sparkSession, "runindex")
    text = F.coalesce("text", F.lit(""))
    docs = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_NO_ID)).alias("doc_id"), F.shiftrightunsigned(F.xxhash64(text), 33).cast("int").alias("version"), text.alias("text"))
    row = ["doc_id", "version"]

    def with_texts(lists: DataFrame) -> DataFrame:
        """The rows of a stored table with their texts; other texts stay out of the shuffle where the ids are few."""
        return docs.join(small(lists.select(*row)), row, "left_semi").join(lists, row)

    # 1. texts that an earlier document has
    copied = small(scratch.store(copies(docs), "copies"))
    fresh = docs.join(copied, row, "left_anti").where(F.octet_length("text") >= window)

    # 2. recurring grams, by document
    picked = scratch.store(recurring(grams(fresh, window, gram)), "picked")
    many = scratch.store(picked.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > hot).select("key", F.lit(True).alias("hot")), "hot")
    marked = picked.join(small(many), "key", "left")
    lists = marked.groupBy(*row).agg(F.collect_set(F.when(F.col("hot").isNull(), F.col("key"))).alias("keys"), F.collect_set(F.when(F.col("hot"), F.col("key"))).alias("hots"))
    lists = scratch.store(lists, "lists")
    scratch.drop(picked)

    # 3. snippets, 4. indexes
    spans = indexed(snippets(with_texts(lists).select(*row, "text", "keys", "hots"), window, gram), window)
    spans = scratch.store(spans.groupBy(*row).agg(F.collect_list("start").alias("starts"), F.collect_list("n").alias("counts")), "spans")
    scratch.drop(lists)

    # 5. what is left of the documents
    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offsets, _ = text_buffer(batch.column(1))
            found = []
            for j, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)):
                starts, counts = (np.asarray(batch.column(c)[j].values).astype(np.int64) for c in (2, 3))
                removed, n, digest = cut(raw[a:b].tobytes(), starts, counts, window)
                found.append((b - a, removed, n, digest.hex()))
            columns = [pa.array(c, k) for c, k in zip(zip(*found, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.string()), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    settled = with_texts(spans).select("doc_id", "text", "starts", "counts").mapInArrow(lean(settle), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
    plain = docs.join(small(spans.select(*row)), row, "left_anti").join(copied.withColumn("copy", F.lit(True)), row, "left")
    size = F.octet_length("text").cast("long")
    gone = F.col("copy").isNotNull() & (size >= window)
    rest = plain.select(
        "doc_id", size.alias("n_bytes"), F.when(gone, size).otherwise(0).alias("n_removed"), gone.cast("long").alias("n_spans"),
        F.sha2(F.when(gone, F.lit("")).otherwise(F.col("text")), 256).alias("kept_sha256"))
    both = settled.unionByName(rest)
    return both.withColumn("doc_id", F.when(F.col("doc_id") != _NO_ID, F.col("doc_id")))
