"""Each operator on nasty rows: nulls, empty and long texts, ties, repeats, empty tables, clashing extra columns."""

import gc
import hashlib
import inspect
import re
import tracemalloc
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from paperloom.llm import apportion, bytecnn, epsilon, langid, linecrf, pack, parity, phrases, piicrf, warc

WORD = re.compile(r"[^\x20\x09-\x0D]+")
TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
BASE = " ".join(f"word{i % 97} item{i % 13}x{i}" for i in range(120))
LONG = " ".join(f"tok{i % 5000}" for i in range(60_000))
TEXTS = [
    (1, BASE, "en", "a"), (2, BASE, "en", "a"), (2, BASE, "en", "a"), (3, BASE.replace("word3 ", "changed "), "en", None),
    (4, None, "en", "a"), (5, "", None, "b"), (6, " \n\t ", "de", "b"), (7, "one", "de", "b"), (8, "one two three", "de", "b"),
    (None, "null id text " + BASE[:200], "fr", "c"), (None, None, "fr", "c"), (9, LONG, "fr", "c"), (10, "Ünï çödé x 日本語 🙂 a+b@c.example.org", None, None),
    (11, BASE.upper(), "en", "a"), (12, "$$$ !!! ###\n" * 40, "en", "b"), (13, BASE + "\n" + BASE, "en", "a"),
]
EXTRA = ["key", "hub", "n", "size", "score", "route", "start", "taken", "value"]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(*r, *["z"] * len(EXTRA)) for r in TEXTS]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, " + ", ".join(f"`{c}` string" for c in EXTRA)).repartition(3)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (2, 1, 0), (3, 1, 0), (12, 0, 0), (13, 1, 0), (6, 0, 0), (4, None, None), (None, 1, 0)], "doc_id long, quality int, toxic int")


def rows(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)


def test_line_rules(docs, labels):
    got = rows(linecrf.line_rules(docs, labels), "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")

    def plain(t):
        t = t or ""
        w = WORD.findall(t)
        c = Counter(zip(w, w[1:], w[2:], strict=False))
        cover = {j for i in range(len(w) - 2) if c[w[i], w[i + 1], w[i + 2]] > 1 for j in (i, i + 1, i + 2)}
        seen, dup = set(), 0
        for line in t.split("\n"):
            dup += bool(WORD.search(line)) and line in seen
            seen.add(line)
        return len(w), sum(map(len, w)), sum(ch in "#*$%&|<>" for ch in t), dup, len(cover)

    assert got == sorted(((i, *plain(t)) for i, t, _, _ in TEXTS), key=repr)


def test_line_crf_viterbi_equals_enumeration():
    from itertools import product

    rng = np.random.default_rng(1)
    crf = linecrf.LineCrf()
    crf.pair = rng.normal(size=(2, 2))
    first = np.array([0, 3, 3, 8, 9])
    s = rng.normal(size=(9, 2))
    got = crf.decode(s, first)
    for a, b in zip(first[:-1], first[1:], strict=True):
        best = max(product((0, 1), repeat=b - a), key=lambda y: sum(s[a + i, k] for i, k in enumerate(y)) + sum(crf.pair[p, q] for p, q in zip(y, y[1:], strict=False)))
        assert tuple(got[a:b]) == best


def test_near_duplicate_vectors(spark):
    rng = np.random.default_rng(0)
    base = rng.normal(size=(6, 8))
    vec = [(i, (base[i % 6] + rng.normal(size=8) * 0.05).astype(np.float32).tolist(), i % 2) for i in range(80)]
    vec += [(200 + i, vec[3][1], vec[3][2]) for i in range(4)]
    odd = [(300, None, 1), (301, [0.0] * 8, 1), (302, [1.0, None] + [0.0] * 6, 1), (303, [float("nan")] * 8, 1), (304, vec[0][1], None), (305, [1.0], 0), (306, [2.0], 0), (307, [], 0), (308, [float("inf")] + [0.0] * 7, 0)]
    df = spark.createDataFrame(vec + odd, "vec_id long, embedding array<float>, label int").withColumn("rep", F.lit(1)).withColumn("n", F.lit("q"))
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in epsilon.near_duplicates(df, block=16).collect()}
    fine = [v for v in vec + odd if v[0] < 300 or v[0] in (305, 306)]
    unit = {i: np.array(e, np.float64) / np.linalg.norm(e) for i, e, _ in fine}
    label = {i: lab for i, _, lab in fine}
    near = {i: [j for j in unit if j != i and label[i] == label[j] and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= 0.98] for i in unit}

    def low(i):
        seen, todo = {i}, [i]
        while todo:
            for j in near.get(todo.pop(), []):
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        return min(seen)

    assert got == {i: (len(near.get(i, [])), low(i), low(i) == i) for i, _, _ in vec + odd}
    assert max(len(n) for n in near.values()) > 5


def test_mix(docs):
    got = apportion.mix_sources(docs, block_tokens=4, shard_docs=2)
    size = {}
    for _, t, _, s in TEXTS:
        size[s] = size.get(s, 0) + len(WORD.findall(t or ""))
    out = got.collect()
    assert sorted(r["size"] for r in out) == sorted(len(WORD.findall(t or "")) for _, t, _, _ in TEXTS)
    assert all(0 <= r.taken <= 2 * r["size"] for r in out)
    assert abs(sum(size.values()) * 1.5 - sum({r.source_size: r.target for r in out}.values())) < 1e-6
    assert all(r.target <= 2 * r.source_size + 1e-9 for r in out)
    taken = {}
    for r in out:
        taken.setdefault((r.source_size, r.target), []).append(r.taken)
    # each shard rounds to blocks
    assert all(abs(sum(v) - k[1]) <= 4 * 8 + 4 for k, v in taken.items())
    again = apportion.mix_sources(docs.repartition(5), block_tokens=4, shard_docs=2)
    assert rows(got, *got.columns) == rows(again, *again.columns)


def test_targets_equal_plain_resharing(spark):
    """Targets against the contract's words: weighted shares, stopped at twice the source's size, the excess reshared by weight."""
    rng = np.random.default_rng(13)
    for n in (1, 2, 5, 11):
        size = {f"s{i:02d}": int(x) for i, x in enumerate(rng.lognormal(5, 2, n))}
        names = sorted(size)
        weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
        left, target, free = 1.5 * sum(size.values()), {}, set(names)
        while free:
            share = {s: left * weight[s] / sum(weight[t] for t in free) for s in free}
            over = {s for s in free if share[s] > 2 * size[s]}
            for s in over or free:
                target[s] = 2 * size[s] if over else share[s]
            left -= sum(target[s] for s in over)
            free -= over or free
        df = spark.createDataFrame(list(size.items()), "source string, source_size long")
        got = {r.source: r.target for r in apportion.targets(df, (5, 2, 1), 1.5, 2).collect()}
        assert got.keys() == target.keys() and all(abs(got[s] - target[s]) < 1e-6 * max(1, target[s]) for s in got)


def test_seats_equal_highest_quotients(spark):
    votes = [("a", 53.0), ("b", 24.0), ("c", 23.0), ("d", 0.0), ("e", 1.5)]
    for total in (0, 1, 7, 101):
        df = spark.createDataFrame([(1, k, v, total) for k, v in votes], "g int, k string, v double, t long")
        got = {r.k: r.seats for r in apportion.seats(df, ["g"], ["k"], "v", "t").collect()}
        won = Counter(k for _, k, _ in sorted(((-v / (2 * s + 1), k, s) for k, v in votes if v for s in range(total + 1)))[:total])
        assert got == {k: won[k] for k, _ in votes}


def test_jaccard(docs, spark):
    base = BASE.split()
    near = [(100 + i, " ".join(base[:i] + ["new"] + base[i + 1 :])) for i in range(0, 60, 3)]
    more = spark.createDataFrame(near + [(200, "shared passage " + " ".join(base[:60])), (201, " ".join(base[:60]) + " other end")], "doc_id long, text string")
    both = docs.where("doc_id is not null").select("doc_id", "text", "key", "hub", "n").unionByName(more, allowMissingColumns=True)
    got = {(r.doc_id, r.n_shingles, r.component_id) for r in parity.jaccard_components(both).collect()}
    sets = {}
    for r in both.collect():
        w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), r.text or ""))
        sets[r.doc_id] = {tuple(w[i : i + 4]) for i in range(len(w) - 3)} if len(w) >= 4 else {tuple(w)} if w else set()
    up = {i: i for i in sets}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for a in sets:
        for b in sets:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]) > 0:
                x, y = sorted((root(a), root(b)))
                up[y] = x
    assert got == {(i, len(s), root(i)) for i, s in sets.items()}
    null = parity.jaccard_components(docs.where("doc_id is null")).collect()
    assert [(r.doc_id, r.component_id) for r in null] == [(None, None)] * 2


def test_parity_parts_agree_where_sets_are_near():
    rng = np.random.default_rng(2)
    bands = parity.Bands(85, 1.5)
    for n in [1, 2, 5, 6, 7, 9, 12, 13, 20, 47, 120, 500]:
        for _ in range(20):
            a = np.sort(rng.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2))
            d = rng.integers(0, bands.differ(2 * n) // 2 + 1)
            b = np.sort(np.concatenate((a[d:], rng.integers(0, 1 << 63, d, dtype=np.uint64))))
            i = len(np.intersect1d(a, b))
            if 100 * i >= 85 * (len(a) + len(b) - i):
                assert len(np.intersect1d(parity.part_keys(a, bands), parity.part_keys(b, bands)))


@pytest.mark.parametrize("percent", [80, 85])
def test_parity_parts_agree_at_the_largest_difference(percent):
    rng = np.random.default_rng(3)
    bands = parity.Bands(percent, 1.5)
    for b in range(1, bands.low(12)):
        for a in range(-(-percent * b // 100), b + 1):
            common = -(-percent * (a + b) // (100 + percent))
            if common > a:
                continue
            assert a + b - 2 * common <= bands.parts(bands.of(b))[0]
            for _ in range(20 if b < 40 else 1):
                x = rng.integers(0, 1 << 63, a + b - common, dtype=np.uint64) * np.uint64(2)
                left, right = np.sort(x[:a]), np.sort(x[a - common :])
                assert len(left) == a and len(right) == b and len(np.intersect1d(left, right)) == common
                assert len(np.intersect1d(parity.part_keys(left, bands), parity.part_keys(right, bands))), (a, b)


@pytest.mark.parametrize("percent", [80, 85])
def test_parity_prefixes_meet_under_any_common_order(percent):
    """Linked sets still have a common key after each has left out its last ones of one order of all keys."""
    rng = np.random.default_rng(4)
    bands = parity.Bands(percent, 1.5)
    spared = 0
    for b in [3, 8, 13, 20, 47, 120, 290, 500]:
        for _ in range(30):
            a = int(rng.integers(-(-percent * b // 100), b + 1))
            common = -(-percent * (a + b) // (100 + percent))
            if common > a:
                continue
            x = rng.integers(0, 1 << 63, a + b - common, dtype=np.uint64) * np.uint64(2)
            salt = np.uint64(rng.integers(0, 1 << 63))
            left = []
            for g in (np.sort(x[:a]), np.sort(x[a - common :])):
                keys, spare = parity.part_keys(g, bands), parity.spare_keys(g, bands)
                spared += sum(spare)
                for side in (0, 1):
                    own = keys[(keys & np.uint64(3)) == side]
                    own = own[np.argsort(parity.mix(own ^ salt))]
                    left.append(own[: len(own) - spare[side]])
            assert len(np.intersect1d(np.concatenate(left[:2]), np.concatenate(left[2:])))
    assert spared > 100


def test_jaccard_with_a_common_passage(spark, monkeypatch):
    """Texts that share a passage, with keys that count as common from two batches on, against all pairs."""
    monkeypatch.setattr(parity, "HOT_HEADS", 2)
    monkeypatch.setattr(parity, "BLOCK", 3)
    rng = np.random.default_rng(5)
    passage = [f"common{i}" for i in range(40)]
    rows = []
    for i in range(60):
        own = [f"own{i}x{j}" for j in range(int(rng.integers(4, 60)))]
        rows.append(passage + own)
        if i % 3 == 0:
            rows.append([*passage, *own[:-1], "changed"])
    sets = [{tuple(w[j : j + 4]) for j in range(len(w) - 3)} for w in rows]
    least = list(range(len(rows)))
    near = [(a, b) for b in range(len(rows)) for a in range(b) if 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])]
    for _ in rows:
        for a, b in near:
            least[a] = least[b] = min(least[a], least[b])
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(rows)], "doc_id long, text string").repartition(8)
    got = {r.doc_id: r.component_id for r in parity.jaccard_components(df).collect()}
    assert got == dict(enumerate(least)) and len(near) == 20


def test_structured_words_do_not_collide(spark):
    """Thue-Morse words and their complements, which any polynomial hash modulo 2^64 takes for equal."""
    word = "a"
    while len(word) < 65_536:
        word += word.translate({97: 98, 98: 97})
    pair = [[word[:n].translate({97: 98, 98: 97}) if flip else word[:n] for n in (1024, 2048, 65_536)] for flip in (0, 1)]
    rows = [(i, f"{' '.join(pair[i])} {pair[i][0]}\n{pair[i][1]}\n{pair[1 - i][1]}") for i in (0, 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert [(r.n_dup_lines, r.n_repeat_words) for r in linecrf.line_rules(df, none).collect()] == [(0, 0)] * 2
    assert {r.component_id for r in parity.jaccard_components(df, k=1).collect()} == {0, 1}
    code = pack.Encoder(TOKENIZER)
    assert [x.tolist() for x in code.many(pa.array([t for _, t in rows]))] == [code.whole(t).tolist() for _, t in rows]
    long = spark.createDataFrame([(i, " ".join([pair[i][0], *[f"w{j}" for j in range(19)]])) for i in (0, 1)], "doc_id long, text string")
    assert [r.n_removed for r in phrases.remove_repeats(long).collect()] == [0, 0]


def test_jaccard_links_short_texts_with_a_word_appended(spark):
    """Texts of 1 to 24 words and the same with one word more: J = (n - 1) / n of n shingles in the longer."""
    rows = []
    for n in range(1, 25):
        words = [f"w{n}x{i}" for i in range(n)]
        rows += [(2 * n, " ".join(words)), (2 * n + 1, " ".join([*words, "more"]))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in parity.jaccard_components(df).collect()}
    assert got == {i: i - 1 if i % 2 and (n := i // 2 - 2) > 1 and 100 * (n - 1) >= 85 * n else i for i, _ in rows}


def test_classifier(docs, labels):
    got = bytecnn.classify(docs, labels, 20).collect()
    assert len(got) == len(TEXTS)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got)
    one_kind = bytecnn.classify(docs, labels.where("quality = 1"), 20).collect()
    assert {r.score for r in one_kind} == {1.0}


def test_classifier_gradient():
    net = bytecnn.ByteCnn(filters=3, width=4, stride=2, embed=2, half=4)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    net.p["b"] += 0.1  # padding alone then stands off the kink of the rectifier
    net.windows = lambda x: np.lib.stride_tricks.as_strided(x, ((len(x) // 2 - 4) // 2, 8), (2 * 2 * 8, 8))
    raw, offsets, _ = linecrf.text_buffer(pa.array(["abc def, ghi!", "", "zzz " * 9]))
    y = np.array([1.0, 0.0, 1.0])

    def loss():
        z = net.logits(raw, offsets)
        return np.mean(np.logaddexp(0, z) - y * z)

    g = net.step(raw, offsets, y)
    for k in ("w", "v", "b", "c"):
        flat = net.p[k].reshape(-1)
        for i in range(0, len(flat), max(1, len(flat) // 5)):
            flat[i] += 1e-5
            up = loss()
            flat[i] -= 2e-5
            down = loss()
            flat[i] += 1e-5
            assert abs((up - down) / 2e-5 - g[k].reshape(-1)[i]) < 1e-4


def test_language(docs):
    got = langid.identify(docs, langid.learn(docs)).collect()
    assert len(got) == len(TEXTS)
    for r in got:
        t = next(t for i, t, _, _ in TEXTS if i == r.doc_id) if r.doc_id else None
        if r.doc_id and not any(c.isalpha() for c in t or ""):
            assert (r.lang_pred, r.score) == ("und", 0.0)
    assert {r.lang_pred for r in got} <= {"en", "de", "fr", "und"}
    none = langid.identify(docs, langid.learn(docs.where("lang is null"))).collect()
    assert {r.lang_pred for r in none} == {"und"}


def test_entropies_equal_a_plain_kneser_ney():
    """Cross-entropies against a dictionary implementation of the recursion, text by text."""
    learnt, order = ["the cat and the hat", "that hat", "a cat"], 3
    clean = lambda t: "  " + t + " "
    counts = [{} for _ in range(order + 1)]
    for t in learnt:
        c = clean(t)
        for i in range(len(c) - order + 1):
            counts[order][c[i : i + order]] = counts[order].get(c[i : i + order], 0) + 1
    for k in range(order - 1, 0, -1):
        for g in counts[k + 1]:
            counts[k][g[1:]] = counts[k].get(g[1:], 0) + 1

    def discount(k):
        once, twice = (sum(n == j for n in counts[k].values()) for j in (1, 2))
        return min(max(once / (once + 2 * twice) if once + twice else 0.5, 0.1), 0.9)

    def prob(g):
        if not g:
            return 1 / (len(counts[1]) + 1)
        k, ctx = len(g), g[:-1]
        inside = [n for h, n in counts[k].items() if h[:-1] == ctx]
        if not inside:
            return prob(g[1:])
        d = discount(k)
        return max(counts[k].get(g, 0) - d, 0) / sum(inside) + d * len(inside) / sum(inside) * prob(g[1:])

    grams = np.array([[0 if c == " " else ord(c) for c in g] for g in counts[order]], np.uint32)
    models = langid.Models({"en": langid.CharModel(grams, np.array(list(counts[order].values())))}, order)
    texts = ["the hat", "xyz cat", "THAT!! cat", "q"]
    h, _ = models.entropies(pa.array(texts))
    for t, got in zip(["the hat", "xyz cat", "that cat", "q"], h[:, 0], strict=True):
        c = clean(t)
        parts = [c[i : i + order] for i in range(len(c) - order + 1)]
        assert abs(got + sum(np.log(prob(g)) for g in parts) / len(parts)) < 1e-6


def test_forward_pass_equals_plain_loops():
    """The network's probability against loops over windows and chunks."""
    rng = np.random.default_rng(12)
    net = bytecnn.ByteCnn(filters=3, width=4, stride=2, embed=2, half=4)
    net.p["b"] = rng.normal(size=3).astype(np.float32)
    texts = ["", "short", "a longer text of some words, " * 5, "é" * 40]
    raw, offsets, _ = linecrf.text_buffer(pa.array(texts))
    got = net.logits(raw, offsets)
    for t, z in zip(texts, got, strict=True):
        data, unit = t.encode(), 4 * 2
        halves = (len(data) + 4 + unit - 1) // unit
        data = data + bytes(halves * unit + 4 - len(data))
        top = []
        for h in range(halves):
            best = [max(sum(float(net.p["e"][data[s + j]] @ net.p["w"][2 * j : 2 * j + 2, f]) for j in range(4)) for s in range(h * unit, (h + 1) * unit, 2)) + float(net.p["b"][f]) for f in range(3)]
            top.append([max(b, 0.0) for b in best])
        pairs = [(i, i + 1) for i in range(halves - 1)] or [(0, 0)]
        plain = np.mean([sum(max(x, y) * float(v) for x, y, v in zip(top[i], top[j], net.p["v"], strict=True)) + float(net.p["c"][0]) for i, j in pairs])
        assert abs(plain - z) < 1e-4


def test_kneser_ney_sums_to_one():
    text = np.array([ord(c) if c != " " else 0 for c in "   the cat and the hat and that    " * 3], np.uint32)
    grams, counts = np.unique(np.lib.stride_tricks.sliding_window_view(text, 3), axis=0, return_counts=True)
    model = langid.CharModel(grams, counts)
    alphabet = np.unique(text)
    for context in ([ord("t"), ord("h")], [ord("q"), ord("a")], [ord("q"), ord("q")], [0, ord("t")]):
        rows_ = np.array([[*context, c] for c in alphabet], np.uint32)
        # one further character stands for all unseen ones
        total = np.exp(model.log_prob(rows_)).sum() + np.exp(model.log_prob(np.array([[*context, 9999]], np.uint32)))[0]
        assert abs(total - 1) < 1e-6


def test_packing(docs):
    out = pack.pack(docs, TOKENIZER, capacity=64, group_docs=5).collect()
    code = pack.Encoder(TOKENIZER)
    ids = [np.concatenate((code.whole(t or ""), [1])).astype("<u4") for _, t, _, _ in TEXTS]
    want = sorted((len(x[k : k + 64]), k, zlib.crc32(x[k : k + 64].tobytes())) for x in ids for k in range(0, len(x), 64))
    assert sorted((r.length, r.start, r.ids_crc32) for r in out) == want
    bins = {}
    for r in out:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for b in bins.values():
        at = 0
        for offset, length in sorted(b):
            assert offset == at
            at += length
        assert at <= 64


def test_encoder_equals_the_library():
    texts = ["", "It's we'll 3.5 Ünï ĳ n't!! 'S ''s", "x <|endoftext|> y", "a b\u0085c", "Σας ΣΑΣ İI ŉ ſ ª²³¼ µ ǅ", "a\x0bb\x0c\x00c", None, LONG[:5000], "日本語 🙂"]
    code = pack.Encoder(TOKENIZER)
    got = code.many(pa.array(texts))
    assert [g.tolist() for g in got] == [code.whole(t or "").tolist() for t in texts]


def test_encoder_keeps_little_and_workers_keep_no_encoder(spark):
    code = pack.Encoder(TOKENIZER)
    code.many(pa.array(["a b"]))
    gc.collect()
    tracemalloc.start()
    texts = [" ".join(f"x{i}" for i in range(lo, lo + 10_000)) for lo in range(0, 100_000, 10_000)]
    for t in texts:
        got = code.many(pa.array([t]))[0]
    gc.collect()
    held = tracemalloc.get_traced_memory()[0]
    tracemalloc.stop()
    assert got.tolist() == code.whole(texts[-1]).tolist()
    assert held < 100 * 100_000

    def encoders(batches):
        for _ in batches:
            yield pa.record_batch([pa.array([sum(type(x).__name__ == "Encoder" for x in gc.get_objects())], pa.int64())], names=["n"])

    docs = spark.range(0, 64, 1, 8).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), "id").alias("text"))
    assert pack.pack(docs, TOKENIZER).count() == 64
    assert {r.n for r in spark.range(0, 64, 1, 16).mapInArrow(encoders, "n long").collect()} == {0}


def test_best_fit_takes_the_tightest_bin_and_closes_the_fullest():
    fit = pack.BestFit(10, 2)
    assert [fit.place(n) for n in (6, 7, 3, 2)] == [(0, 0), (1, 0), (1, 7), (0, 6)]
    assert fit.place(9) == (2, 0)  # opens beside bin 0 with 2 free
    assert fit.place(8) == (3, 0)  # bin 2 (1 free) is the fullest and closes
    assert fit.place(2) == (3, 8)


def test_bounded_best_fit_closes_bins_and_stays_near_the_least_sequences():
    """Lengths as documents have them, in arrival order, under the production bound and a plain linear search."""
    rng = np.random.default_rng(8)
    sizes = np.minimum(4096, rng.lognormal(6.3, 1.0, 6000).astype(int) + 1).tolist()
    limit = inspect.signature(pack.pack).parameters["open_bins"].default
    fit, peak, bins = pack.BestFit(4096, limit), 0, {}
    for n in sizes:
        at, offset = fit.place(n)
        open_ = {b: used for b, (used, live) in bins.items() if live}
        fits = [used for used in open_.values() if used + n <= 4096]
        if fits:
            assert offset == max(fits)
        else:
            assert offset == 0 and at not in bins
            if len(open_) >= limit:  # one of the fullest closed
                bins[next(b for b, used in open_.items() if used == max(open_.values()))][1] = False
        bins[at] = [offset + n, offset + n < 4096]
        peak = max(peak, fit.open)
    assert peak == limit and fit.closed > 0
    assert fit.made <= 1.02 * sum(sizes) / 4096 + 1


def test_personal_data(docs, spark):
    more = spark.createDataFrame([(50, "a.b@c.d.example.com, 10.0.0.300 10.0.0.30 4111 1111 1111 1111 +1 (212) 555-0199 é x_y%z@ex-ample.org_q@r.st"), (51, "1.2.3.4.5.6.7.8 @a.b a@b a@b.c@d.e 00010.0.0.1"), (52, "7" * 3000 + "." + "1.2.3"), (53, "+12345678 +123456789 +1 2345 6789 0123 4567 (x)")], "doc_id long, text string")
    both = docs.select("doc_id", "text", "n", "key").unionByName(more, allowMissingColumns=True)

    def plain(t):
        t, out = t or "", []
        out += [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
        out += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(len(x.lstrip("0")) < 4 and int(x[-3:]) <= 255 for x in m[0].split("."))]
        for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
            d = re.sub("[^0-9]", "", m[0])
            if 12 <= len(d) <= 19 and piicrf.luhn(d):
                out.append((m.start(), 2, m.end()))
        out += [(m.start(), 3, m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
        return sorted(out)

    want = []
    for r in both.collect():
        spans = plain(r.text)
        sha = hashlib.sha256(",".join(f"{piicrf.KINDS[k]}:{a}:{b}" for a, k, b in spans).encode()).hexdigest()
        want.append((r.doc_id, *[sum(s[1] == k for s in spans) for k in range(4)], sha))
    got = piicrf.detect(both)
    assert rows(got, "doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256") == sorted(want, key=repr)
    masked = {r.doc_id: r.text for r in piicrf.mask(both).collect()}
    assert "@c.d" not in masked[50] and masked[50].startswith("[EMAIL], ")
    assert masked[1] == BASE and masked[4] is None


@pytest.fixture(scope="module")
def suspects(spark, sf_dir):
    """Texts with a digit or an @ of the largest tables, in the order of training, and a field learnt from the first half."""
    docs = spark.read.parquet(str(Path(sf_dir).parent / "sf0.1" / "documents.parquet"))
    found = piicrf.training_texts(docs, 10_000)
    return found, piicrf.train(found[::2])


def test_search_of_a_batch_takes_little_beside_its_text():
    texts = pa.array([BASE.translate({c: 97 for c in range(48, 58)}) * 20] * 200 + ["a@b.example", None, "", "room 7", "@"], pa.large_string())
    raw = sum(len(t or "") for t in texts.to_pylist())
    tracemalloc.start()
    got = [(bool(base), i in some) for lo, hi, some, spans in piicrf._found(texts, None) for i, (base, _) in enumerate(spans)]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert got == [(False, False)] * 200 + [(True, True), (False, False), (False, False), (False, True), (False, True)]
    assert raw > 3_000_000 and peak < 6 * raw


def test_skip_edges_carry_labels_to_repetitions(suspects):
    field = suspects[1]
    clear, unclear = "call +1 (212) 555-0147 soon", "later 212 555 0147 again"
    base, more = piicrf.find([f"{clear} and {unclear}"], field)[0]
    assert [k for _, k, _ in base] == [3] and [k for _, k, _ in more] == [3]
    assert piicrf.find(["In 1999 we sold 12 of 300 items at 3.5 each"], field)[0] == ([], [])


def test_field_finds_planted_repetitions_in_documents_it_has_not_seen(suspects):
    """Damaged repetitions, hidden entities and strangers planted in the tables' documents: found, found and left alone; without skip
    edges most repetitions are lost."""
    texts, field = suspects
    rng, cases = np.random.default_rng(21), []
    for t in texts[1::2]:
        base = piicrf.base_spans(t)
        if base:
            cases.append(piicrf.planted(t, base, rng))
    share = {}
    for skips in (True, False):
        hit, wrong, n, strangers = 0, 0, 0, 0
        for (_, spans), (base, more) in zip(cases, piicrf.find([t for t, _ in cases], field, skips=skips), strict=True):
            for a, label, e in spans:
                seen = [k + 1 for s, k, q in (base + more if label else more) if s < e and a < q]
                n, strangers = n + bool(label), strangers + (not label)
                hit, wrong = hit + (label in seen if label else 0), wrong + (not label and bool(seen))
        share[skips] = hit / n
        assert n > 20 and strangers > 10 and wrong <= 0.1 * strangers
    assert share[True] >= 0.85 and share[False] <= share[True] - 0.2


def test_messages_give_exact_marginals_on_a_tree():
    from itertools import product

    rng = np.random.default_rng(9)
    field = piicrf.Field()
    k = len(piicrf.LABELS)
    field.chain, field.skip = rng.normal(size=(k, k)), rng.normal(size=(k, k))
    field.skip += field.skip.T
    unary, edges = rng.normal(size=(4, k)), [(0, 1, False), (1, 2, True), (1, 3, False)]
    p = np.zeros((4, k))
    for y in product(range(k), repeat=4):
        z = np.exp(sum(unary[i, c] for i, c in enumerate(y)) + sum((field.skip if s else field.chain)[y[a], y[b]] for a, b, s in edges))
        for i, c in enumerate(y):
            p[i, c] += z
    assert np.allclose(field.beliefs(unary, edges, rounds=40), p / p.sum(1, keepdims=True), atol=1e-6)


def test_repeats(docs):
    with_ids = docs.where("doc_id is not null")
    got = rows(phrases.remove_repeats(with_ids), "doc_id", "n_words", "n_removed", "kept_sha256")
    seen, want = {}, []
    for i, t in sorted({(i, t) for i, t, _, _ in TEXTS if i is not None}, key=lambda x: x[0]):
        w = WORD.findall(t or "")
        cover = [False] * len(w)
        for p in range(len(w) - 19):
            g = tuple(w[p : p + 20])
            if g in seen:
                cover[p : p + 20] = [True] * 20
            seen.setdefault(g, i)
        kept = " ".join(x for x, c in zip(w, cover, strict=True) if not c)
        want += [(i, len(w), sum(cover), hashlib.sha256(kept.encode()).hexdigest())] * sum(1 for x in TEXTS if x[0] == i)
    assert got == sorted(want, key=repr)
    nulls = phrases.remove_repeats(docs).where("doc_id is null").collect()
    assert len(nulls) == 2


def test_automaton_locates_every_occurrence_word_for_word():
    rng = np.random.default_rng(6)
    texts = [" ".join(rng.choice(["a", "b", "ab", "c"], n)) for n in (0, 30, 200, 7, 90)]
    raw, offsets, _ = linecrf.text_buffer(pa.array(texts))
    w = phrases.Windows(raw, offsets, 6, 3)
    confirmed = [[b"a b ab"], [], [b"c c a", b"a a a"], [b"none of these"], []]
    want = []
    for d, t in enumerate(texts):
        words = t.split()
        want += [int(w.first[d]) + i for i in range(len(words) - 2) if " ".join(words[i : i + 3]).encode() in {p for own in confirmed for p in own}]
    assert sorted(phrases.locate(w, raw, offsets, confirmed).tolist()) == want and len(want) > 5
    assert not len(phrases.locate(w, raw, offsets, [[]] * 5))


def test_candidate_windows_come_from_the_automaton(monkeypatch):
    """A shard knows no positions: its candidates are the windows around what the automaton locates, whatever the hashes."""
    w = [f"w{i}" for i in range(60)]
    texts = [" ".join(w[:40]), "x " + " ".join(w[5:45]), " ".join(w[::-1])]
    for collide in (False, True):
        if collide:
            real = phrases.gram_hashes
            monkeypatch.setattr(phrases, "gram_hashes", lambda h, k: real(h, k) % np.uint64(2) + np.uint64(1))
        raw, offsets, _ = linecrf.text_buffer(pa.array(texts))
        at = phrases.Windows(raw, offsets, 20, 8)
        both = {" ".join(w[i : i + 8]).encode() for i in range(5, 33)}
        batch = pa.record_batch([pa.array([1, 2, 3]), pa.array([0, 0, 0], pa.int32()), pa.array(texts), pa.array([[*both], [*both], []], pa.list_(pa.binary()))], names=["doc_id", "version", "text", "phrases"])
        ((_, _, _, starts),) = phrases._shards([batch], 20, 8)
        shared = [*range(5, 21), *range(int(at.first[1]) + 1, int(at.first[1]) + 17)]
        assert set(shared) <= set(starts.tolist()) and not (starts >= at.first[2]).any()
    monkeypatch.setattr(phrases, "locate", lambda w, text, offsets, confirmed: np.zeros(0, np.int64))
    assert not len(next(phrases._shards([batch], 20, 8))[3])


def test_repeats_of_other_texts_under_one_id(spark):
    a, b = (" ".join(f"{c}{i}" for i in range(40)) for c in "ab")
    df = spark.createDataFrame([(1, a), (2, a), (2, b), (3, f"start {b}"), (3, "short")], "doc_id long, text string")
    assert rows(phrases.remove_repeats(df), "doc_id", "n_words", "n_removed") == [(1, 40, 0), (2, 40, 0), (2, 40, 40), (3, 1, 0), (3, 41, 40)]


def test_warc(spark):
    pages = [(1, "http://a", "x" * 200), (2, None, "x" * 200), (2, "http://b", "x" * 200), (0, "http://é\r\nX: y", "x" * 200), (3, "u", None), (4, "u", ""), (5, "u", "short"), (6, "u", "short"), (None, "u", "n" * 300), (7, "u", "n" * 300), (8, "u", "é" * 100 + "\r\n\r\n\0"), (9, "u", "big" * 7_000_000)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("digest", F.lit("d")).withColumn("size", F.lit(1)).repartition(3)
    got = warc.archive(df, per_file=2, chunk_bytes=500).collect()
    assert len(got) == len(pages)
    for r in got:
        assert any(p[0] == r.page_id and hashlib.sha256((p[2] or "").encode()).hexdigest() == r.payload_digest and len((p[2] or "").encode()) == r.payload_bytes for p in pages)
    kind = sorted((repr(r.page_id), r.record_type, r.refers_to) for r in got)
    assert kind == sorted([("0", "response", None), ("1", "revisit", 0), ("2", "revisit", 0), ("2", "revisit", 0), *[(str(i), "response", None) for i in (3, 4, 5, 6, 7, 8, 9)], ("None", "revisit", 7)])


def test_warc_reader_rejects_damage():
    good = warc.write_record("response", 1, "u", b"payload", 7, hashlib.sha256(b"payload").hexdigest(), None)
    assert len(list(warc.Reader(memoryview(good + good), 7).records())) == 2
    bad = warc.write_record("response", 1, "u", b"payload", 7, hashlib.sha256(b"other").hexdigest(), None)
    with pytest.raises(ValueError, match="payload digest"):
        list(warc.Reader(memoryview(bad)).records())
    with pytest.raises(ValueError, match="ends within"):
        list(warc.Reader(memoryview(good[:-4])).records())


@pytest.mark.parametrize("op", ["rules", "mix", "jaccard", "classify", "language", "pack", "pii", "repeats", "vectors", "warc"])
def test_empty_tables(op, docs, labels, spark):
    none, no_labels = docs.limit(0), labels.limit(0)
    out = {
        "rules": lambda: linecrf.line_rules(none, no_labels), "mix": lambda: apportion.mix_sources(none), "jaccard": lambda: parity.jaccard_components(none),
        "classify": lambda: bytecnn.classify(none, no_labels), "language": lambda: langid.identify(none, langid.learn(none)), "pack": lambda: pack.pack(none, TOKENIZER),
        "pii": lambda: piicrf.detect(none), "repeats": lambda: phrases.remove_repeats(none),
        "vectors": lambda: epsilon.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")),
        "warc": lambda: warc.archive(spark.createDataFrame([], "page_id long, url string, html string")),
    }[op]()
    assert out.count() == 0


def test_later_links_tie_known_components(spark):
    """extended() says what components() says of all links; stars take no round, and links inside components take nothing."""
    from paperloom.llm.common import Scratch
    from paperloom.llm.components import components, extended

    kind, scratch = "u long, v long", Scratch(spark, "extended")
    table = lambda rows: scratch.store(spark.createDataFrame(rows, kind), "rows")
    plain_of = lambda df: sorted(tuple(r) for r in df.collect())
    first, then = [(2, 1), (3, 1), (12, 11), (21, 20), (22, 21), (23, 22)], [(3, 30), (31, 30), (30, 12), (41, 40), (2, 3), (23, 20), (5, 5)]
    found = scratch.store(components(table(first), scratch), "found")
    assert plain_of(found) == sorted([(x, 1) for x in (1, 2, 3)] + [(11, 11), (12, 11)] + [(x, 20) for x in (20, 21, 22, 23)])
    got = extended(found, table(then), scratch)
    assert plain_of(got) == plain_of(components(table(first + then), scratch))
    assert extended(got, table([(2, 12), (40, 41)]), scratch) is got
    assert plain_of(extended(scratch.store(found.limit(0), "none"), table(first), scratch)) == plain_of(found)


def test_draws_change_no_component(spark, monkeypatch):
    """Few open pairs are joined at once; with draws, whatever their number, the components are the same."""
    from paperloom.llm import parity

    base = [f"w{i}" for i in range(60)]
    rows = [(i, " ".join([*base[: 57 - i % 3], *(f"x{i}y{j}" for j in range(i % 7))])) for i in range(24)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    straight = sorted(map(tuple, parity.jaccard_components(df).collect()))
    monkeypatch.setattr(parity, "FEW_PAIRS", -1)
    assert sorted(map(tuple, parity.jaccard_components(df).collect())) == straight
