"""N-gram Jaccard join by parity sketches.

A document is the set of hashes of its word k-grams. Dealing the hash space into
P equal parts and XOR-ing the hashes of each part gives a parity sketch: an
element of the symmetric difference changes the part it falls into and no other,
so two sets that differ in at most D elements agree in at least P - D parts. Sizes a
and b with Jaccard >= t differ in at most (a + b)(1 - t)/(1 + t) elements; size
bands of ratio ``band`` bound that by D per band, and P is chosen so that an
agreeing part is left that is not empty. (A document with so many empty parts that this
might fail also lists its empty parts.) A document lists its parts under its
own band, and under the next if a partner may be there.

The part keys meet in one shuffle. A document with E empty parts agrees with each
partner in at least P - D - E of its keys, so it may leave out that many less one
of its keys, as long as all documents leave out the last ones of one common order: the
keys that most batches have go first (a prefix filter). That takes the keys of
passages that very many otherwise different documents share out of the join.

Documents with equal sets are tied first and one of them stands for all. Inside a key's group the first document is a
hub; hub pairs that pass the size and bit-parity tests are verified on the texts,
one pair of each document first and then those that are still in two components.
Documents of keys whose documents are then still in several components meet a few drawn ones of their key (unless all their pairs are few),
of which the nearest is verified; keys that this leaves in several components are joined in full across components, in blocks, with the size and parity bounds as
join conditions, and verified too: no link between components is missed.
Documents of one batch with a common key meet their hub before the shuffle, so
a group of copies costs a shuffled row per batch, not per copy.

Elements are 64-bit hashes of the k-grams, in candidates and in verification; equal
sets are known by 128 bits. (Within a pair of texts two k-grams collide once in 2^64 pairs of k-grams.)

Edge cases: null, empty and blank texts have the empty set and link with
nothing; shorter texts are one element; repeated rows and copies link with each
other; rows that share a doc_id are one node of the graph, whatever their texts; an
empty table gives an empty result; null doc_ids come back with a null component.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import Scratch, gram_hashes, lean, mix, signed, slices, small, text_buffer, word_hashes, word_spans
from .components import components, extended, labelled

#: Longs in a document's bit-parity sketch (64 bits each).
SKETCH = 16
#: Keys that so many batches have take part in the common order; others count as rare.
HOT_HEADS = 8
#: Lowest bits of a key: the parity of its band, or WHOLE for the key of the whole set.
WHOLE = 2
#: Members of a hub that are verified in one group, and of an open key that are joined in one block.
BLOCK = 256
#: Rounds in which the documents of open keys meet further hubs, and hubs drawn from each key in a round.
ROUNDS, DRAWS = 2, 4
#: Open keys with no more pairs of documents are joined in full at once.
FEW_PAIRS = 200_000


class Bands:
    """Size bands, their difference bounds and part counts for a Jaccard threshold in percent."""

    def __init__(self, percent: int, band: float):
        self.percent, self.band = percent, band

    def __hash__(self) -> int:
        return hash((self.percent, self.band))

    def __eq__(self, other: object) -> bool:
        return isinstance(other, Bands) and (self.percent, self.band) == (other.percent, other.band)

    def differ(self, total: int) -> int:
        """Most elements in which sets of ``total`` elements together differ when they link."""
        # 100 i >= p (total - i)  →  i >= p total / (100 + p)
        return total - 2 * -(-self.percent * total // (100 + self.percent))

    def of(self, n: int) -> int:
        k = int(math.log(n) / math.log(self.band))
        while self.low(k + 1) <= n:
            k += 1
        while self.low(k) > n:
            k -= 1
        return k

    def low(self, k: int) -> int:
        return math.ceil(self.band**k)

    @functools.cache  # noqa: B019  a few dozen bands
    def parts(self, k: int) -> tuple[int, int]:
        """(D, P) for pairs whose larger set is in band k.

        P parts of a set of n elements hold about P exp(-n / P) empty ones; beside those of a set between the band's
        smallest partner and its lower end, P leaves D and two standard deviations, so that listing empty parts is rare.
        Sets of about as many elements as the sketch has bits, and more, which the sketch tells apart badly, have so many
        parts that partners agree in a quarter of D at least: long texts that share passages are then left out.
        """
        # differ() only grows over totals of the same parity, and two sizes may add up to either
        most = 2 * (self.low(k + 1) - 1)
        d = max(self.differ(most), self.differ(most - 1))
        least = max(1, (self.percent + 100) * self.low(k) // 200)
        p = d + 1
        while d and p < least:
            bare = p * math.exp(-least / p)
            if p - bare - 2 * math.sqrt(bare) > d + (d // 4 if least > 48 * SKETCH else 0):
                break
            p += 1
        return d, p


def shingle_sets(raw: np.ndarray, offsets: np.ndarray, k: int) -> list[np.ndarray]:
    """Sorted distinct k-gram hashes of each text, A-Z lower-cased; fewer words than k are one element."""
    starts, ends, first = word_spans(raw, offsets)
    words = word_hashes(raw, starts, ends, lower=True)
    grams = gram_hashes(words, k)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= k:
            g = np.sort(grams[a : b - k + 1])
            if len(g) > 1:
                keep = np.empty(len(g), bool)
                keep[0] = True
                np.not_equal(g[1:], g[:-1], out=keep[1:])
                g = g[keep]
        elif b > a:
            g = gram_hashes(words[a:b], b - a)
        else:
            g = words[:0]
        out.append(g)
    return out


def _parts(g: np.ndarray, bands: Bands) -> Iterator[tuple[int, int, int, np.ndarray]]:
    """(band, D, P, bounds of the parts) of a set under its own band and, where a larger partner may be there, the next."""
    n = len(g)
    own = bands.of(n)
    # the largest partner has n / t elements
    for k in (own, own + 1) if 100 * n >= bands.percent * bands.low(own + 1) else (own,):
        d, p = bands.parts(k)
        edges = np.arange(1, p, dtype=np.uint64) * np.uint64(min((1 << 64) // p, (1 << 64) - 1))
        yield k, d, p, np.concatenate(([0], np.searchsorted(g, edges), [n]))


def part_keys(g: np.ndarray, bands: Bands) -> np.ndarray:
    """Keys of a set's parts; their lowest bits say which band they are of."""
    found = []
    for k, d, p, bounds in _parts(g, bands):
        size = np.diff(bounds)
        full = np.flatnonzero(size)
        salt = np.uint64(k << 32)
        keys = [mix(np.bitwise_xor.reduceat(g, bounds[full]) ^ mix(salt + full.astype(np.uint64)))]
        if p - len(full) >= p - d:
            keys.append(mix(salt + np.uint64(1 << 31) + np.flatnonzero(size == 0).astype(np.uint64)))
        found += [(x & ~np.uint64(3)) | np.uint64(k & 1) for x in keys]
    return np.concatenate(found)


def spare_keys(g: np.ndarray, bands: Bands) -> list[int]:
    """How many keys a set may leave out, by the parity of their band: one less than it has in common with any partner."""
    out = [0, 0]
    for k, d, p, bounds in _parts(g, bands):
        out[k & 1] = max(0, p - d - int((np.diff(bounds) == 0).sum()) - 1)
    return out


def _digest(g: np.ndarray) -> tuple[int, int]:
    if not len(g):
        return 0, 0
    with np.errstate(over="ignore"):
        a = np.bitwise_xor.reduce(g)
        b = np.add.reduce(mix(g + np.uint64(0x5851F42D4C957F2D)))
    return int(signed(a.reshape(1))[0]), int(signed(b.reshape(1))[0])


def _sets(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray, list[np.ndarray], list[tuple[int, int]]]]:
    """(ids, ids as integers, nulls, sets, digests) of slices of (doc_id, text)."""
    for batch in batches:
        ids = batch.column(0).cast(pa.int64())
        raw, offsets, _ = text_buffer(batch.column(1))
        for lo, hi in slices(offsets):
            sets = shingle_sets(raw[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], k)
            own = ids.slice(lo, hi - lo)
            yield own, np.asarray(own.fill_null(0)), np.asarray(own.is_null()), sets, [_digest(g) for g in sets]


def parity_bits(g: np.ndarray, bits: int) -> np.ndarray:
    """Parity of the number of elements with each value of the low bits, as longs; halves of a sketch XOR to the next smaller one."""
    parity = np.bincount((g & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(parity.astype(np.uint8)).view(np.int64)


def sign(docs: DataFrame, k: int, bands: Bands) -> DataFrame:
    """doc_id, n, d1, d2 (digests of the set), s0.. (bit parity of the hashes' low bits), spare0, spare1, wide (for sets of
    more elements than that has bits: a sketch of at least a bit an element)."""
    names = ["doc_id", "n", "d1", "d2", *[f"s{j}" for j in range(SKETCH)], "spare0", "spare1", "wide"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for own, _, _, sets, digests in _sets(batches, k):
            out = np.zeros((len(sets), SKETCH + 2), np.int64)
            wide = []
            for i, g in enumerate(sets):
                wide.append(parity_bits(g, 1 << (len(g) - 1).bit_length()) if len(g) > 64 * SKETCH else None)
                if len(g):
                    out[i, :SKETCH] = parity_bits(g, 64 * SKETCH)
                    out[i, SKETCH:] = spare_keys(g, bands)
            n = pa.array([len(g) for g in sets], pa.int64())
            yield pa.record_batch(
                [own, n, pa.array([d[0] for d in digests], pa.int64()), pa.array([d[1] for d in digests], pa.int64()), *[pa.array(out[:, j]) for j in range(SKETCH + 2)], pa.array(wide, pa.list_(pa.int64()))],
                names=names)

    return docs.select("doc_id", "text").mapInArrow(lean(run), ", ".join(f"{c} long" for c in names[:-1]) + ", wide array<long>")


def part_rows(docs: DataFrame, k: int, bands: Bands) -> DataFrame:
    """doc_id, key, hub: the keys of each set's parts and one of the whole set. A batch's first document with a key has
    no hub, later ones have the first; a set that the batch has had lists the whole only."""
    names = ["doc_id", "key", "hub"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, ids, null, sets, digests in _sets(batches, k):
            keys, owners, seen = [], [], {}
            for i, g in enumerate(sets):
                if not len(g) or null[i]:
                    continue
                same = seen.setdefault((len(g), *digests[i]), i)
                whole = mix(np.array([digests[i][0] ^ digests[i][1] ^ len(g)], np.int64).view(np.uint64) + np.uint64(7))
                whole = (whole & ~np.uint64(3)) | np.uint64(WHOLE)
                own = np.concatenate([whole, part_keys(g, bands)]) if same == i else whole
                keys.append(own)
                owners.append(np.full(len(own), i))
            if not keys:
                continue
            key, owner = np.concatenate(keys), np.concatenate(owners)
            order = np.lexsort((ids[owner], key))
            key, doc = key[order], ids[owner[order]]
            head = np.ones(len(key), bool)
            head[1:] = key[1:] != key[:-1]
            hub = doc[np.maximum.accumulate(np.where(head, np.arange(len(key)), 0))]
            yield pa.record_batch([pa.array(doc), pa.array(signed(key)), pa.array(hub, mask=head)], names=names)

    return docs.select("doc_id", "text").mapInArrow(lean(run), "doc_id long, key long, hub long")


class _Group:
    """What ``meet`` knows of the key it is in when a batch ends."""

    def __init__(self, key: int, doc: int, hub: int, heads: int):
        self.key, self.doc, self.hub, self.heads = key, doc, hub, heads


def meet(keys: DataFrame) -> DataFrame:
    """Rows of keys that two or more documents have: key, doc_id, hub (a document of the key's group). Keys of at least
    HOT_HEADS batches have one more row, without doc_id, whose hub is the number of batches.

    Batch hubs are sorted by key and streamed; a group crosses batches without being held.
    """
    names = ["key", "doc_id", "hub"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: _Group | None = None

        def rows(key, doc, hub) -> pa.RecordBatch:
            return pa.record_batch([pa.array(key, pa.int64()), pa.array(doc, pa.int64()), pa.array(hub, pa.int64())], names=names)

        for batch in batches:
            key, doc, hub = (np.asarray(batch.column(j).fill_null(0)) for j in range(3))
            member = ~np.asarray(batch.column(2).is_null())
            if member.any():
                yield rows(key[member], doc[member], hub[member])
            key, doc = key[~member], doc[~member]
            if not len(key):
                continue
            goes_on = last is not None and int(key[0]) == last.key
            if last is not None and not goes_on and last.heads >= HOT_HEADS:
                yield rows([last.key], [None], [last.heads])
            begin = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
            n = np.diff(np.append(begin, len(key)))
            first = doc[begin]
            heads = n.copy()
            if goes_on:
                if last.heads == 1:  # not written yet
                    yield rows([last.key], [last.doc], [last.hub])
                first[0], heads[0] = last.hub, n[0] + last.heads
            keep = np.repeat(heads > 1, n)
            yield rows(key[keep], doc[keep], np.repeat(first, n)[keep])
            hot = np.flatnonzero(heads[:-1] >= HOT_HEADS)
            if len(hot):
                yield rows(key[begin[hot]], [None] * len(hot), heads[hot])
            last = _Group(int(key[-1]), int(doc[-1]), int(first[-1]), int(heads[-1]))
        if last is not None and last.heads >= HOT_HEADS:
            yield rows([last.key], [None], [last.heads])

    # batch members need not be with their key: they are spread by document
    route = F.when(F.col("hub").isNull(), F.col("key")).otherwise(F.xxhash64("doc_id", "key"))
    n = int(keys.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = keys.repartition(max(n, 2), route).sortWithinPartitions(F.col("hub").isNotNull(), "key")
    return dealt.select("key", "doc_id", "hub").mapInArrow(lean(run), "key long, doc_id long, hub long")


def one_of_equals(met: DataFrame, sigs: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """(found, rows): the components (node, component) of equal sets, stored, and met without their ties, where each document stands for
    all with its set."""
    side = F.col("key").bitwiseAND(F.lit(3))
    digest = sigs.select("doc_id", F.struct("n", "d1", "d2").alias("d")).distinct()
    ties = met.where((side == WHOLE) & (F.col("doc_id") != F.col("hub"))).select(F.greatest("doc_id", "hub").alias("u"), F.least("doc_id", "hub").alias("v")).distinct()
    a, b = digest.select(F.col("doc_id").alias("u"), F.col("d").alias("du")), digest.select(F.col("doc_id").alias("v"), F.col("d").alias("dv"))
    links = scratch.store(ties.join(a, "u").join(b, "v").where("du = dv").select("u", "v").distinct(), "same")
    found = scratch.store(components(links, scratch), "components")
    copies = small(scratch.store(found.where("node <> component"), "copies"))

    def stand_in(rows: DataFrame, column: str) -> DataFrame:
        there = copies.select(F.col("node").alias(column), F.col("component").alias("_rep"))
        return rows.join(there, column, "left").withColumn(column, F.coalesce("_rep", column)).drop("_rep")

    # a key's rows are in one partition of met, so that copies fall together before the shuffle
    rows = stand_in(stand_in(met.where((side != WHOLE) & F.col("doc_id").isNotNull()), "doc_id"), "hub")
    return found, rows.select("key", "doc_id", "hub").distinct()


def leave_out(rows: DataFrame, hot: DataFrame, sigs: DataFrame) -> DataFrame:
    """rows without the commonest keys of each document, as many as it may leave out; a document with no more shared keys
    than that has no partner and goes. Keys of few batches stand in the order of their hashes."""
    spare = sigs.where("spare0 > 0 or spare1 > 0").groupBy("doc_id").agg(F.min("spare0").alias("spare0"), F.min("spare1").alias("spare1"))
    commonest = W.partitionBy("doc_id", "side").orderBy(F.coalesce("heads", F.lit(0)).desc(), "key")
    return (
        rows.join(hot, "key", "left").withColumn("side", F.col("key").bitwiseAND(F.lit(3))).join(spare, "doc_id", "left")
        .withColumn("place", F.dense_rank().over(commonest))
        .where(F.col("place") > F.coalesce(F.when(F.col("side") == 0, F.col("spare0")).otherwise(F.col("spare1")), F.lit(0)))
        .select("key", "doc_id", "hub")
    )


def verify(pairs: DataFrame, docs: DataFrame, k: int, percent: int, scratch: Scratch) -> DataFrame:
    """The pairs (u, v) whose texts' sets link; pairs is a stored table.

    A text of u goes to its pair's group, the text of v goes to each group of at most about BLOCK pairs of v, once.
    """
    if pairs.isEmpty():
        return pairs.select("u", "v")
    groups = scratch.store(pairs.groupBy("v").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > BLOCK).select("v", F.ceil(F.col("n") / BLOCK).alias("groups")), "groups")
    dealt = pairs.join(small(groups), "v", "left").select("u", "v", F.pmod(F.xxhash64("u"), F.coalesce("groups", F.lit(1).cast("long"))).alias("part"))
    wanted = dealt.select(F.col("u").alias("doc_id"), "v", "part", F.lit(True).alias("member")).unionByName(
        dealt.select(F.col("v").alias("doc_id"), "v", "part", F.lit(False).alias("member")).distinct())
    wanted = scratch.store(wanted, "wanted")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hub, theirs = None, []
        for batch in batches:
            raw, offsets, _ = text_buffer(batch.column(4))
            doc, v, part, member = (batch.column(j).to_pylist() for j in range(4))
            us, vs = [], []
            for lo, hi in slices(offsets):
                sets = shingle_sets(raw[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], k)
                for i, a in zip(range(lo, hi), sets, strict=True):
                    if hub != (v[i], part[i]):
                        hub, theirs = (v[i], part[i]), []
                    if not member[i]:
                        theirs.append(a)
                        continue
                    for b in theirs:
                        common = len(np.intersect1d(a, b, assume_unique=True))
                        if common and 100 * common >= percent * (len(a) + len(b) - common):
                            us.append(doc[i])
                            vs.append(v[i])
                            break
            yield pa.record_batch([pa.array(us, pa.int64()), pa.array(vs, pa.int64())], names=["u", "v"])

    n = max(2, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    texts = docs.select("doc_id", "text").join(small(wanted), "doc_id").select("doc_id", "v", "part", "member", "text")
    grouped = texts.repartition(n, "v", "part").sortWithinPartitions("v", "part", "member")
    out = scratch.store(grouped.mapInArrow(lean(run), "u long, v long"), "links")
    scratch.drop(groups, wanted)
    return out


def _differ(a: str, b: str) -> F.Column:
    """Bits in which the sketches of two signed documents differ: a lower bound of their sets' symmetric difference."""
    return functools.reduce(lambda x, y: x + y, [F.bit_count(F.col(f"{a}.s{j}").bitwiseXOR(F.col(f"{b}.s{j}"))) for j in range(SKETCH)])


def _near(bands: Bands, a: str, b: str) -> F.Column:
    """Size and bit-parity bounds of two signed documents under aliases a and b."""
    p = bands.percent
    na, nb = F.col(f"{a}.n"), F.col(f"{b}.n")
    return (100 * F.least(na, nb) >= p * F.greatest(na, nb)) & (na > 0) & ((100 + p) * _differ(a, b) <= (100 - p) * (na + nb))


def _drawn_hubs(member: DataFrame, seed: int) -> DataFrame:
    """Distinct pairs (u, v) of the keys' documents with DRAWS drawn ones of their key, across components. Draws go by a hash of the
    document, so that keys with much the same documents draw the same."""
    draw = [F.min_by(F.struct("doc_id", "component"), F.xxhash64("doc_id", F.lit(DRAWS * seed + j))) for j in range(DRAWS)]
    hubs = member.groupBy("key").agg(F.array_distinct(F.array(*draw)).alias("drawn"))
    pairs = member.join(hubs, "key").withColumn("h", F.explode("drawn")).where("component <> h.component")
    return pairs.select(F.greatest("doc_id", "h.doc_id").alias("u"), F.least("doc_id", "h.doc_id").alias("v")).distinct()


def _open_pairs(member: DataFrame) -> int:
    """Pairs, either way round, of the documents of all keys that are in several components."""
    keys = member.groupBy("key").agg(F.count(F.lit(1)).cast("decimal(19,0)").alias("n"), F.min("component").alias("low"), F.max("component").alias("high"))
    return int(keys.where("low < high").agg(F.sum(F.col("n") * F.col("n"))).first()[0] or 0)


def _wide_near(pairs: DataFrame, sigs: DataFrame, bands: Bands) -> DataFrame:
    """The pairs (u, v, ...) that pass the bit-parity bound of their wide sketches, where both have one. Linked sets differ little in
    size, so their sketches are equally long or one has twice the other's length."""
    side = sigs.where("wide is not null").select("doc_id", "n", "wide")
    a, b = (side.select(F.col("doc_id").alias(c), F.col("n").alias(f"_n{c}"), F.col("wide").alias(f"_w{c}")) for c in ("u", "v"))

    def folded(column: str, longs: F.Column) -> F.Column:
        halves = F.zip_with(F.slice(column, F.lit(1), longs), F.slice(column, longs + 1, longs), lambda x, y: x.bitwiseXOR(y))
        return F.when(F.size(column) > longs, halves).otherwise(F.col(column))

    longs = F.least(F.size("_wu"), F.size("_wv"))
    differ = F.aggregate(F.zip_with(folded("_wu", longs), folded("_wv", longs), lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)
    fits = (100 + bands.percent) * differ <= (100 - bands.percent) * (F.col("_nu") + F.col("_nv"))
    return pairs.join(a, "u", "left").join(b, "v", "left").where(F.col("_wu").isNull() | F.col("_wv").isNull() | fits).select(*pairs.columns).distinct()


def _apart(pairs: DataFrame, found: DataFrame) -> DataFrame:
    """The pairs whose ends are in two components."""
    return labelled(labelled(pairs, found, "u", "_cu"), found, "v", "_cv").where("_cu <> _cv").drop("_cu", "_cv")


def jaccard_components(docs: DataFrame, k: int = 4, percent: int = 85, band: float = 1.5, scratch: Scratch | None = None) -> DataFrame:
    """doc_id, n_shingles, component_id for each row of docs(doc_id, text): documents link when
    100 × intersection >= percent × union of their k-gram sets; a component's id is its smallest doc_id."""
    scratch = scratch or Scratch(docs.sparkSession, "jaccard")
    bands = Bands(percent, band)
    # the texts are read again for the keys: storing those would cost more disk than the text itself
    sigs = scratch.store(sign(docs, k, bands), "sigs")
    met = scratch.store(meet(part_rows(docs, k, bands)), "met")
    hot = small(scratch.store(met.where("doc_id is null").select("key", F.col("hub").alias("heads")), "hot"))
    found, rows = one_of_equals(met, sigs, scratch)
    shared = scratch.store(leave_out(rows, hot, sigs), "shared")
    scratch.drop(met)

    hubs = scratch.store(shared.where("doc_id <> hub").select(F.greatest("doc_id", "hub").alias("u"), F.least("doc_id", "hub").alias("v")).distinct(), "hubs")
    a, b = sigs.alias("a"), sigs.alias("b")
    tried = hubs.join(a, F.col("u") == F.col("a.doc_id")).join(b, F.col("v") == F.col("b.doc_id")).where(_near(bands, "a", "b"))
    tried = scratch.store(tried.select("u", "v", _differ("a", "b").alias("differ")), "tried")

    unlike = scratch.store(_wide_near(tried, sigs, bands), "unlike")
    # first the nearest hub of each document, then those that this leaves in another component
    for nearest in (True, False):
        rest = _apart(unlike, found)
        if nearest:
            rest = rest.groupBy("u").agg(F.min_by("v", F.struct("differ", "v")).alias("v"))
        rest = scratch.store(rest.select("u", "v").distinct(), "rest")
        found = extended(found, verify(rest, docs, k, percent, scratch), scratch)
        scratch.drop(rest)

    # A key's rows tie all its documents to each other through hubs, so its documents are in one component
    # unless a row's ends are in two. The documents of those keys meet further hubs of theirs, then each other, across components.
    split = small(scratch.store(_apart(hubs, found), "split"))
    scratch.drop(hubs)
    tie = (F.greatest("doc_id", "hub") == F.col("u")) & (F.least("doc_id", "hub") == F.col("v"))
    open_keys = scratch.store(shared.join(split, tie).select("key").distinct(), "open")
    ties = shared.where("doc_id <> hub").join(small(open_keys), "key", "left_semi")
    member = ties.select("key", F.explode(F.array("doc_id", "hub")).alias("doc_id")).distinct()
    member = scratch.store(labelled(member, found, "doc_id", "component"), "members")
    scratch.drop(shared)
    tested = [tried.select("u", "v")]
    for seed in range(ROUNDS):
        if _open_pairs(member) <= FEW_PAIRS:
            break
        drawn = scratch.store(_drawn_hubs(member, seed).join(functools.reduce(DataFrame.unionByName, tested), ["u", "v"], "left_anti"), "drawn")
        near = drawn.join(a, F.col("u") == F.col("a.doc_id")).join(b, F.col("v") == F.col("b.doc_id")).where(_near(bands, "a", "b")).select("u", "v", _differ("a", "b").alias("differ"))
        near = _wide_near(near, sigs, bands).groupBy("u").agg(F.min_by("v", F.struct("differ", "v")).alias("v"))
        tested.append(scratch.store(near.select("u", "v"), "nearest"))
        scratch.drop(drawn)
        found = extended(found, verify(tested[-1], docs, k, percent, scratch), scratch)
        before, member = member, scratch.store(labelled(member.select("key", "doc_id"), found, "doc_id", "component"), "members")
        scratch.drop(before)
    # two documents of a key are a hub and its member, which have been tried
    blocks = member.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("component").alias("low"), F.max("component").alias("high")).where("n > 2 and low < high")
    blocks = small(scratch.store(blocks.select("key", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks")), "blocks"))
    # the sketch goes with each row of a key, so that the join itself refuses most pairs
    rest = member.join(blocks, "key").join(sigs.select("doc_id", "n", *[f"s{j}" for j in range(SKETCH)]), "doc_id")
    left = rest.withColumn("block", F.pmod(F.xxhash64("doc_id"), F.col("blocks")).cast("int")).alias("a")
    right = rest.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).alias("b")
    across = (F.col("a.key") == F.col("b.key")) & (F.col("a.block") == F.col("b.block")) & (F.col("a.component") != F.col("b.component")) & (F.col("a.doc_id") > F.col("b.doc_id"))
    pairs = left.join(right, across & _near(bands, "a", "b")).select(F.col("a.doc_id").alias("u"), F.col("b.doc_id").alias("v")).distinct()
    pairs = scratch.store(pairs.join(functools.reduce(DataFrame.unionByName, tested), ["u", "v"], "left_anti"), "pairs")
    scratch.drop(tried, member)
    pairs = scratch.store(_wide_near(pairs, sigs, bands), "near")
    found = extended(found, verify(pairs, docs, k, percent, scratch), scratch)
    return (
        sigs.select("doc_id", F.col("n").alias("n_shingles"))
        .join(found, F.col("doc_id") == F.col("node"), "left")
        .select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))
    )
