"""Run-length indexes and substring deduplication: brute force, nasty rows, hot grams, long texts."""

import hashlib

import numpy as np
import pytest

from paperloom.llm import runindex

BASE = " ".join(f"word{i % 97} item{i % 13}x{i}" for i in range(60))
EXTRA = ["key", "keys", "snippet", "n", "start", "hot", "copy"]


def plain(rows, window):
    """Per row, by a dictionary of every window; rows of one (id, text) are one document."""
    docs = sorted({(i is None, i or 0, t or "") for i, t in rows})
    first, out = {}, {}
    for doc in docs:
        b = doc[2].encode()
        gone = np.zeros(len(b), bool)
        for p in range(len(b) - window + 1):
            if first.setdefault(b[p : p + window], (doc[:2], p)) != (doc[:2], p):
                gone[p : p + window] = True
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        spans = int(np.sum(gone[1:] & ~gone[:-1]) + (len(b) > 0 and gone[0]))
        out[doc] = (len(b), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest())
    return sorted(((i, *out[i is None, i or 0, t or ""]) for i, t in rows), key=repr)


def frame(spark, rows):
    return spark.createDataFrame([(*r, *["z"] * len(EXTRA)) for r in rows], "doc_id long, text string, " + ", ".join(f"`{c}` string" for c in EXTRA)).repartition(3)


def got(df):
    assert df.columns == ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    return sorted((tuple(r) for r in df.collect()), key=repr)


ROWS = [
    (1, BASE), (2, BASE), (2, BASE), (3, BASE.replace("word3 ", "changed ")), (4, None), (5, ""), (6, "short"), (None, "null id " + BASE[100:400]), (None, None),
    (7, "aaaa" * 200), (8, "x" + "a" * 150 + "y"), (9, "Ünï çödé 日本語 🙂 " * 30), (10, BASE[200:500] + " tail " + BASE[200:500]), (11, "ab\x00cd" * 60),
    (12, "start " + BASE[50:180] + " other words between " + BASE[300:450]), (0, BASE[60:160]), (13, "日本語" + BASE[10:140] + "🙂"), (14, "z" * 99), (15, "z" * 100), (16, "z" * 100),
]


def test_equals_brute_force(spark):
    assert got(runindex.remove_substrings(frame(spark, ROWS))) == plain(ROWS, 100)


def test_hot_grams_are_dealt_by_windows(spark):
    passage = BASE[:260]
    rows = [(i, f"head {i * 7919} {passage[i % 40 : 200 + i % 50]} tail {i * 104729} and more") for i in range(60)]
    want = plain(rows, 100)
    for hot in (0, 10, 1000):
        assert got(runindex.remove_substrings(frame(spark, rows), hot=hot)) == want


def test_small_shards_and_long_texts_in_pieces(spark, monkeypatch):
    rng = np.random.default_rng(2)
    text = "".join(chr(97 + c) for c in rng.integers(0, 26, 5000))
    rows = [(1, text), (2, text[700:2200] + "-" + text[2100:2500]), (3, text[::-1][:900] + text[4000:]), (4, text[:1000] * 3)]
    monkeypatch.setattr(runindex, "SHARD_BYTES", 500)
    monkeypatch.setattr(runindex, "CHUNK_BYTES", 400)
    pieces = [p for p in runindex.pieces(np.frombuffer(text.encode(), np.uint8), np.array([0, 5000]), 100)]
    assert len(pieces) > 4 or runindex.slices.__defaults__[0] > 5000
    assert got(runindex.remove_substrings(frame(spark, rows))) == plain(rows, 100)


def test_pieces_of_a_long_text_share_a_window_less_one(monkeypatch):
    monkeypatch.setattr(runindex, "CHUNK_BYTES", 300)
    raw = np.arange(1000).astype(np.uint8)
    found = list(runindex.pieces(raw, np.array([0, 1000]), 100))
    starts = [s + p for *_, text, _, s in found for p in range(len(text) - 99)]
    assert starts == list(range(901)) and all(len(text) <= 399 for *_, text, _, _ in found)


@pytest.mark.parametrize("seed", range(6))
def test_index_equals_plain_suffixes(seed):
    rng = np.random.default_rng(seed)
    for _ in range(40):
        text = rng.integers(97, 97 + int(rng.integers(1, 4)), int(rng.integers(1, 300))).astype(np.uint8)
        if rng.random() < 0.4:
            text = np.concatenate([text[:40]] * 5 + [text])
        if rng.random() < 0.3:
            text[rng.integers(0, len(text), 3)] = 0
        b = text.tobytes()
        order = runindex.suffix_order(text)
        assert order.tolist() == sorted(range(len(b)), key=lambda i: b[i:])
        index = runindex.RunIndex(text)
        # the runs spell the transform, and in a repetitive text they are few
        bwt = b"".join(bytes([h]) * n for h, n in zip(index.heads.tolist(), index.lengths.tolist(), strict=True))
        assert bwt == bytes(b[i - 1] if i else 0xFE for i in order.tolist())
        length, where = index.matching(0, len(b))
        for p, q in zip(order[1:].tolist(), order[:-1].tolist(), strict=True):
            n = 0
            while max(p, q) + n < len(b) and b[p + n] == b[q + n]:
                n += 1
            assert (length[p], where[p]) == (n, q)
        w = int(rng.integers(1, 9))
        seen, want = set(), []
        for i in range(len(b)):
            want.append(i + w <= len(b) and b[i : i + w] in seen)
            seen.add(b[i : i + w])
        assert index.repeats(np.arange(len(b)) + w <= len(b), w).tolist() == want


def test_runs_of_a_repetitive_text_are_few():
    text = np.frombuffer((BASE * 30).encode(), np.uint8)
    assert len(runindex.RunIndex(text).heads) < len(BASE)


def test_decisions_come_from_the_indexes(spark, monkeypatch):
    """Without matches from the samples nothing but copies goes; what one snippet alone repeats inside itself is found by its index too."""
    held = {b"q" * 150: (1, 0, 0)}
    assert runindex.decide(held, 100) == [(1, 0, 1, 50)]
    monkeypatch.setattr(runindex.RunIndex, "matching", lambda self, lo, hi: (np.zeros(hi - lo, np.int64), np.arange(lo, hi)))
    assert runindex.decide(held, 100) == []


def test_empty_table(spark):
    assert got(runindex.remove_substrings(frame(spark, []))) == []
