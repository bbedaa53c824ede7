"""Substring deduplication with Aho-Corasick automata over recurring phrases.

A window is ``window`` consecutive words of a document; a word goes if a window
that covers it also starts earlier (smaller doc_id, or earlier in the document).

1. Texts that equal an earlier text go whole, if they have a window; they take
   no further part.
2. Each window picks the smallest hash among its ``phrase``-word grams. Equal
   windows pick equal grams, so only windows whose gram recurs can recur. Hashes, without
   positions, meet in one shuffle; those that recur within a batch are settled
   there and send one row for all, so a passage that very many documents share
   does not gather in one task.
3. The phrases behind recurring hashes meet again as words, which confirms them: a confirmed phrase stands twice or more
   in the corpus, word for word. Each document gets the confirmed phrases that it shares.
4. Documents are streamed in shards of bounded text. The confirmed phrases of a
   shard's documents are compiled to an Aho-Corasick automaton over word numbers,
   which locates every occurrence in all of them; nothing else knows positions. The windows
   that pick a located phrase are candidates.
5. Window digests of 128 bits meet in a minimum (combined before the shuffle), which gives
   each window's first occurrence. All other candidates are covered words.

A document thus passes one automaton, whatever the size of the corpus: an
automaton of all phrases, or shards of it that each see all documents, would cost the square of it.

Edge cases: null, empty and short texts have no window and lose nothing;
repeated rows (equal doc_id and text) count as one document, neither is earlier; other texts
under one doc_id stand in the order of a hash of the text; null
doc_ids are one document's that comes last; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, fold, gram_hashes, lean, mix, signed, slices, small, text_buffer, word_hashes, word_spans

_LAST = np.uint64((1 << 64) - 1)
_NO_ID = (1 << 63) - 1
#: Digests of texts that a task remembers at most.
_REMEMBER = 200_000


def _slide(x: np.ndarray, w: int, op: np.ufunc) -> np.ndarray:
    """op over each w consecutive values, by doubling."""
    n, size, out = len(x), 1, x
    while 2 * size <= w:
        out = op(out[: len(out) - size], out[size:])
        size *= 2
    rest = w - size
    return op(out[: n - w + 1], out[rest : rest + n - w + 1]) if rest else out


class Windows:
    """Word hashes, phrase grams and their window minima of a slice of documents."""

    def __init__(self, raw: np.ndarray, offsets: np.ndarray, window: int, phrase: int):
        self.starts, self.ends, self.first = word_spans(raw, offsets)
        self.words = word_hashes(raw, self.starts, self.ends)
        self.window, self.phrase, self.reach = window, phrase, window - phrase + 1
        n = len(self.words)
        self.doc = np.repeat(np.arange(len(offsets) - 1), np.diff(self.first))
        self.any = n >= window
        if not self.any:
            return
        self.gram = gram_hashes(self.words, phrase)
        self.low = _slide(self.gram, self.reach, np.minimum)
        self.valid = self.doc[: n - window + 1] == self.doc[window - 1 :]

    def picked(self) -> np.ndarray:
        """Positions of the grams that windows pick."""
        if not self.any:
            return np.zeros(0, np.int64)
        low = np.where(self.valid, self.low, np.uint64(0))
        pad = np.zeros(self.reach - 1, np.uint64)
        top = _slide(np.concatenate((pad, low, pad)), self.reach, np.maximum)
        return np.flatnonzero((top == self.gram) & (top > 0))

    def around(self, at: np.ndarray) -> np.ndarray:
        """Starts of the windows that pick one of the grams at these positions."""
        if not self.any or not len(at):
            return np.zeros(0, np.int64)
        marked = np.full(len(self.gram), _LAST)
        marked[at] = self.gram[at]
        return np.flatnonzero(self.valid & (_slide(marked, self.reach, np.minimum) == self.low))


def copies(docs: DataFrame) -> DataFrame:
    """doc_id, version of the rows whose text an earlier doc_id has.

    A task knows a copy when it has met the text under a smaller id, so a text that very many documents have
    sends about one row a task to its key.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        least: dict[bytes, int] = {}
        for batch in batches:
            known = []
            for doc, digest in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                before = least.get(digest)
                known.append(before is not None and before < doc)
                if before is None or doc < before:
                    least[digest] = doc
            if len(least) > _REMEMBER:
                least.clear()
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(known, pa.bool_())], names=["doc_id", "version", "digest", "known"])

    digest = F.unhex(F.md5("text"))
    rows = docs.select("doc_id", "version", digest.alias("digest")).mapInArrow(lean(run), "doc_id long, version int, digest binary, known boolean")
    open_ = rows.where("not known")
    first = open_.groupBy("digest").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last").select("digest", "first")
    return rows.where("known").select("doc_id", "version").unionByName(open_.join(first, "digest").where("doc_id > first").select("doc_id", "version")).distinct()


def _twice(key: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rows, known, tell) of a slice's occurrences: the first of each key in each document, whether the key stands
    twice in the slice, and one row of each key that does."""
    order = np.lexsort((doc, key))
    key, doc = key[order], doc[order]
    same = key[1:] == key[:-1]
    known = np.zeros(len(key), bool)
    known[1:] |= same
    known[:-1] |= same
    new = np.ones(len(key), bool)
    new[1:] = ~same | (doc[1:] != doc[:-1])
    head = known.copy()
    head[1:] &= ~same
    return order[new], known[new], order[head]


_ROW = ["key", "doc_id", "version", "known"]


def grams(docs: DataFrame, window: int, phrase: int) -> DataFrame:
    """key, doc_id, version, known: hashes of the phrases that windows pick, once a document; known rows stand twice in
    their slice, with one row of version -1 to tell others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, versions = np.asarray(batch.column(0)), np.asarray(batch.column(1))
            raw, offsets, _ = text_buffer(batch.column(2))
            for lo, hi in slices(offsets):
                w = Windows(raw[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], window, phrase)
                at = w.picked()
                if not len(at):
                    continue
                key, doc = w.gram[at], w.doc[at]
                rows, known, tell = _twice(key, doc)
                doc = lo + doc[rows]
                none = np.full(len(tell), -1)
                yield pa.record_batch(
                    [pa.array(signed(np.concatenate((key[rows], key[tell])))), pa.array(np.concatenate((ids[doc], none))),
                     pa.array(np.concatenate((versions[doc], none)).astype(np.int32)), pa.array(np.concatenate((known, none == 0)))], names=_ROW)

    return docs.mapInArrow(lean(run), "key long, doc_id long, version int, known boolean")


def phrases(docs: DataFrame, window: int, phrase: int) -> DataFrame:
    """key (the words, with one space between), doc_id, version, known of the picked phrases of docs(doc_id, version, text,
    keys) whose hash is among the document's keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, versions = np.asarray(batch.column(0)), np.asarray(batch.column(1))
            raw, offsets, _ = text_buffer(batch.column(2))
            for lo, hi in slices(offsets):
                text = raw[offsets[lo] : offsets[hi]]
                w = Windows(text, offsets[lo : hi + 1] - offsets[lo], window, phrase)
                at = w.picked()
                lists = pa.concat_arrays([batch.column(3).slice(lo, hi - lo)])
                wanted = np.asarray(lists.flatten()).view(np.uint64)
                owner = np.repeat(np.arange(hi - lo, dtype=np.uint64), np.diff(np.asarray(lists.offsets)))
                at = at[np.isin(mix(w.gram[at] ^ mix(w.doc[at].astype(np.uint64))), mix(wanted ^ mix(owner)))] if len(at) else at
                if not len(at):
                    continue
                data = text.tobytes()
                words = [b" ".join(data[a:b].split()) for a, b in zip(w.starts[at].tolist(), w.ends[at + phrase - 1].tolist(), strict=True)]
                number: dict[bytes, int] = {}
                code = np.array([number.setdefault(x, len(number)) for x in words])
                doc = w.doc[at]
                rows, known, tell = _twice(code, doc)
                doc = lo + doc[rows]
                none = np.full(len(tell), -1)
                yield pa.record_batch(
                    [pa.array([words[i] for i in (*rows.tolist(), *tell.tolist())], pa.binary()), pa.array(np.concatenate((ids[doc], none))),
                     pa.array(np.concatenate((versions[doc], none)).astype(np.int32)), pa.array(np.concatenate((known, none == 0)))], names=_ROW)

    return docs.mapInArrow(lean(run), "key binary, doc_id long, version int, known boolean")


def recurring(rows: DataFrame) -> DataFrame:
    """key, doc_id, version of rows that are known or whose key has another row; keys are streamed in order, no group is held."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple | None = None  # a row of the last key, and whether it has been written
        for batch in batches:
            known = batch.column(3)
            out, rest = [batch.filter(known)], batch.filter(pc.invert(known))
            if rest.num_rows:
                key = rest.column(0)
                same = np.zeros(len(key), bool)
                same[1:] = np.asarray(pc.equal(key.slice(1), key.slice(0, len(key) - 1)))
                same[0] = last is not None and key[0].as_py() == last[0].column(0)[0].as_py()
                if same[0] and not last[1]:
                    out.append(last[0])
                twice = same.copy()
                twice[:-1] |= same[1:]
                out.append(rest.filter(pa.array(twice)))
                last = rest.slice(len(key) - 1), bool(twice[-1])
            for found in out:
                found = found.filter(pc.greater_equal(found.column(2), 0))
                if found.num_rows:
                    yield pa.RecordBatch.from_arrays(found.columns[:3], names=_ROW[:3])

    n = max(2, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    route = F.when(F.col("known"), F.xxhash64("doc_id", "key")).otherwise(F.xxhash64("key"))
    kind = rows.schema["key"].dataType.simpleString()
    return rows.repartition(n, route).sortWithinPartitions("known", "key").mapInArrow(lean(run), f"key {kind}, doc_id long, version int")


def locate(w: Windows, text: np.ndarray, offsets: np.ndarray, confirmed: list[list[bytes]]) -> np.ndarray:
    """First words of every occurrence, in a shard's documents, of the confirmed phrases of any of them, word for word."""
    number: dict[bytes, int] = {}
    automaton = ahocorasick.Automaton(ahocorasick.STORE_LENGTH, ahocorasick.KEY_SEQUENCE)
    for words in {p for own in confirmed for p in own}:
        automaton.add_word(tuple([number.setdefault(x, len(number) + 1) for x in words.split(b" ")]))
    if not number:
        return np.zeros(0, np.int64)
    automaton.make_automaton()
    data, known = text.tobytes(), number.get
    stream: list[int] = []
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        stream += [known(x, 0) for x in data[a:b].split()]
    begin = np.array([end for end, _ in automaton.iter(tuple(stream))], np.int64) - w.phrase + 1
    return begin[w.doc[begin] == w.doc[begin + w.phrase - 1]]


def _shards(batches: Iterator[pa.RecordBatch], window: int, phrase: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, Windows, np.ndarray]]:
    """(rows, raw text, windows, candidate window starts) of bounded shards of (doc_id, version, text, phrases, ...)."""
    for batch in batches:
        raw, offsets, _ = text_buffer(batch.column(2))
        for lo, hi in slices(offsets):
            rows = batch.slice(lo, hi - lo)
            text, own = raw[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
            w = Windows(text, own, window, phrase)
            yield rows, text, w, w.around(locate(w, text, own, rows.column(3).to_pylist())) if w.any else np.zeros(0, np.int64)


def _digests(w: Windows, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits for each window that starts at these words."""
    a, b = np.full(len(at), 3, np.uint64), np.full(len(at), 5, np.uint64)
    for j in range(w.window):
        word = w.words[at + j]
        a, b = fold(a, word), fold(b, word ^ (word >> np.uint64(31)))
    return mix(a), mix(b)


def _kept(text: np.ndarray, w: Windows, cover: np.ndarray) -> tuple[list[int], list[str]]:
    """Words removed and digest of the kept words, per document."""
    removed, digests = [], []
    # every word with one space behind it
    length = w.ends - w.starts + 1
    to = np.concatenate(([0], np.cumsum(np.where(cover, 0, length))))
    keep = np.flatnonzero(~cover)
    source = np.repeat(w.starts[keep] - to[keep], length[keep]) + np.arange(to[-1])
    last = to[keep + 1] - 1
    source[last] = 0
    joined = text[source] if len(text) else np.zeros(0, np.uint8)
    joined[last] = 32
    data = joined.tobytes()
    gone = np.concatenate(([0], np.cumsum(cover)))
    for a, b in zip(w.first[:-1].tolist(), w.first[1:].tolist(), strict=True):
        removed.append(int(gone[b] - gone[a]))
        digests.append(hashlib.sha256(data[to[a] : max(to[a], to[b] - 1)]).hexdigest())
    return removed, digests


def remove_repeats(docs: DataFrame, window: int = 20, phrase: int = 8, scratch: Scratch | None = None) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 for each row of docs(doc_id, text)."""
    scratch = scratch or Scratch(docs.sparkSession, "phrases")
    text = F.coalesce("text", F.lit(""))
    docs = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_NO_ID)).alias("doc_id"), F.shiftrightunsigned(F.xxhash64(text), 33).cast("int").alias("version"), text.alias("text"))
    row = ["doc_id", "version"]
    names = ["doc_id", "n_words", "n_removed", "kept_sha256"]
    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string"

    # 1. texts that an earlier document has
    copied = small(scratch.store(copies(docs), "copies"))
    fresh = docs.join(copied, row, "left_anti")

    def with_texts(lists: DataFrame) -> DataFrame:
        """The rows of a stored table with their texts; other texts stay out of the shuffle where the ids are few."""
        return docs.join(small(lists.select(*row)), row, "left_semi").join(lists, row)

    # 2. recurring hashes, 3. confirmed phrases, by document
    keys = scratch.store(recurring(grams(fresh, window, phrase)).groupBy(*row).agg(F.collect_set("key").alias("keys")), "keys")
    confirmed = recurring(phrases(with_texts(keys).select(*row, "text", "keys"), window, phrase)).groupBy(*row).agg(F.collect_set("key").alias("phrases"))
    confirmed = scratch.store(confirmed, "confirmed")
    scratch.drop(keys)

    # 4. candidate windows; a shard sends each window's earliest
    def candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, _, w, at in _shards(batches, window, phrase):
            if len(at):
                a, b = _digests(w, at)
                doc, version = np.asarray(rows.column(0))[w.doc[at]], np.asarray(rows.column(1)).astype(np.int64)[w.doc[at]]
                spot = (version << 32) | (at - w.first[w.doc[at]])
                order = np.lexsort((spot, doc, b, a))
                new = np.ones(len(order), bool)
                new[1:] = (a[order[1:]] != a[order[:-1]]) | (b[order[1:]] != b[order[:-1]])
                order = order[new]
                yield pa.record_batch([pa.array(signed(a[order])), pa.array(signed(b[order])), pa.array(doc[order]), pa.array(spot[order])], names=["a", "b", "doc_id", "spot"])

    seen = with_texts(confirmed).select(*row, "text", "phrases").mapInArrow(lean(candidates), "a long, b long, doc_id long, spot long")
    firsts = seen.groupBy("a", "b").agg(F.min(F.struct("doc_id", "spot")).alias("at")).select("at.doc_id", F.shiftright("at.spot", 32).cast("int").alias("version"), F.col("at.spot").bitwiseAND(F.lit(0x7FFFFFFF)).cast("int").alias("start"))
    firsts = scratch.store(firsts.groupBy(*row).agg(F.collect_list("start").alias("firsts")), "firsts")

    # 5. what is left of the documents
    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, text, w, at in _shards(batches, window, phrase):
            own = pa.concat_arrays([rows.column(4)])
            keep = np.asarray(own.flatten()).astype(np.int64) + np.repeat(w.first[:-1], np.asarray(pc.fill_null(pc.list_value_length(own), 0)))
            again = np.setdiff1d(at, keep, assume_unique=False)
            edge = np.zeros(len(w.words) + 1, np.int64)
            np.add.at(edge, again, 1)
            np.add.at(edge, again + window, -1)
            removed, digests = _kept(text, w, np.cumsum(edge[:-1]) > 0)
            yield pa.record_batch([rows.column(0), pa.array(np.diff(w.first)), pa.array(removed, pa.int64()), pa.array(digests)], names=names)

    def untouched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, digests = [], []
            for t in batch.column(1):
                words = t.as_buffer().to_pybytes().split()
                n.append(len(words))
                digests.append(hashlib.sha256(b" ".join(words)).hexdigest())
            gone = [k if whole and k >= window else 0 for k, whole in zip(n, batch.column(2).to_pylist(), strict=True)]
            digests = [_EMPTY if g else d for g, d in zip(gone, digests, strict=True)]
            yield pa.record_batch([batch.column(0), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(digests, pa.string())], names=names)

    settled = with_texts(confirmed).join(firsts, row, "left").select(*row, "text", "phrases", "firsts").mapInArrow(lean(settle), schema)
    plain = docs.join(small(confirmed.select(*row)), row, "left_anti").join(copied.withColumn("whole", F.lit(True)), row, "left")
    rest = plain.select("doc_id", "text", F.coalesce("whole", F.lit(False)).alias("whole")).mapInArrow(lean(untouched), schema)
    both = settled.unionByName(rest)
    return both.withColumn("doc_id", F.when(F.col("doc_id") != _NO_ID, F.col("doc_id")))


_EMPTY = hashlib.sha256(b"").hexdigest()
