"""The pipeline's stages against plain versions, each on what the stage before it kept."""

import re
import zlib

import corpus_pipeline
import numpy as np
import pyarrow as pa
import pytest

from paperloom.llm import apportion, bytecnn, pack, piicrf
from paperloom.llm.common import text_buffer
from paperloom.llm.queries import tokenizer_path

WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def stages(spark, sf_dir, tmp_path_factory):
    path, docs, out = tmp_path_factory.mktemp("stages"), spark.read.parquet(f"{sf_dir}/documents.parquet"), {}
    out["documents"] = docs
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, sf_dir).write.parquet(str(path / str(k)))
        docs = out[name] = spark.read.parquet(str(path / str(k)))
    return out


def texts(df):
    return {r.doc_id: r.text for r in df.collect()}


def test_columns_stay(stages):
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert len(names) in (4, 5)
    for n in names[:-1]:
        assert stages[n].columns == stages["documents"].columns


def test_quality(stages, spark, sf_dir):
    docs = stages["documents"]
    net = bytecnn.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), 1200)
    all_texts = texts(docs)
    raw, offsets, _ = text_buffer(pa.array([t or "" for t in all_texts.values()]))
    keep = {i for i, z in zip(all_texts, net.logits(raw, offsets), strict=True) if 1 / (1 + np.exp(-z)) >= 0.5}
    assert set(texts(stages["quality classifier"])) == keep
    good = {r.doc_id for r in spark.read.parquet(f"{sf_dir}/labels.parquet").where("quality = 1").collect()} & set(all_texts)
    assert len(good & keep) >= 0.97 * len(good)


def test_near_copies(stages):
    before = texts(stages["quality classifier"])
    sets = {}
    for i, t in before.items():
        w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[i] = {tuple(w[j : j + 5]) for j in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    up = {i: i for i in sets}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            i = len(sets[a] & sets[b])
            if i and 100 * i >= 80 * (len(sets[a]) + len(sets[b]) - i):
                x, y = sorted((root(a), root(b)))
                up[y] = x
    assert texts(stages["n-gram Jaccard join"]) == {i: before[i] for i in ids if root(i) == i}


def test_near_copies_of_short_texts(spark):
    """Texts of 8 to 21 words, each with one word appended and with its last or a middle word changed, against all pairs."""
    rows = []
    for n in range(8, 22):
        w = [f"w{n}x{i}" for i in range(n)]
        rows += [" ".join(t) for t in (w, [*w, "more"], [*w[:-1], "other"], [*w[: n // 2], "new", *w[n // 2 + 1 :]])]
    sets = [{tuple(w[j : j + 5]) for j in range(len(w) - 4)} for w in map(str.split, rows)]
    least = list(range(len(rows)))
    near = [(a, b) for b in range(len(rows)) for a in range(b) if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    for _ in rows:
        for a, b in near:
            least[a] = least[b] = min(least[a], least[b])
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    assert {a % 4 for a, _ in near} == {0, 1} and len(near) == 28
    assert texts(corpus_pipeline.drop_near_copies(spark, docs, "")) == {i: t for i, t in enumerate(rows) if least[i] == i}


def test_personal_data(stages):
    before, after = stages["n-gram Jaccard join"], texts(stages["PII"])
    field = piicrf.train(piicrf.training_texts(before, 2000))
    for i, t in texts(before).items():
        base, more = piicrf.find([t or ""], field)[0]
        assert after[i] == (piicrf.blank(t, [*base, *more]) if t else t)
        assert not piicrf.base_spans(after[i] or "")
    assert all(r.n_chars == len(r.text) for r in stages["PII"].collect() if r.text is not None)


def test_mix(stages):
    plan = {r.doc_id: (r["size"], r.taken) for r in apportion.mix_sources(stages["PII"]).collect()}
    times = {}
    for r in stages["mixing sources to target weights"].collect():
        times[r.doc_id] = times.get(r.doc_id, 0) + 1
    assert times == {i: n for i, (s, t) in plan.items() if s and (n := int(t / s + 0.5))}


def test_packing(stages):
    code, before = pack.Encoder(tokenizer_path()), stages["mixing sources to target weights"]
    want = []
    for r in before.collect():
        ids = np.concatenate((code.whole(r.text or ""), [1])).astype("<u4")
        want += [(r.doc_id, k, len(ids[k : k + 4096]), zlib.crc32(ids[k : k + 4096].tobytes())) for k in range(0, len(ids), 4096)]
    got = stages["best-fit packing"].collect()
    assert sorted((r.doc_id, r.start, r.length, r.ids_crc32) for r in got) == sorted(want)
    total = sum(r.length for r in got)
    assert len({r.sequence_id for r in got}) <= 1.1 * total / 4096 + 1


EXTRA = ["score", "_id", "_times", "_copy", "_row", "_group", "_key", "key", "hub", "size", "taken", "piece", "length"]
WORDS = [f"plain{i % 89} words{i % 37} of{i}" for i in range(400)]
NASTY = [
    (1, " ".join(WORDS[:60]), "a"), (2, " ".join(WORDS[:60]) + " tail", "a"), (2, " ".join(WORDS[100:180]), "a"), (2, " ".join(WORDS[100:180]), "a"),
    (3, None, "a"), (3, None, "a"), (4, "", None), (5, " \n ", "b"), (None, " ".join(WORDS[200:260]), "b"), (None, " ".join(WORDS[200:260]), "b"),
    (None, None, None), (6, " ".join(f"long{i}" for i in range(80_000)), "b"), (7, "mail a.b@example.org or 10.0.0.1", "c"), (8, "mail a.b@example.org or 10.0.0.1", "c"), (9, " ".join(WORDS[300:400]), None),
]


@pytest.fixture(scope="module")
def nasty(spark):
    schema = "doc_id long, text string, source string, lang string, n_chars long, " + ", ".join(f"`{c}` string" for c in EXTRA)
    return spark.createDataFrame([(*r, "en", len(r[1] or ""), *["z"] * len(EXTRA)) for r in NASTY], schema).repartition(3)


def pairs(df):
    return sorted(((r.doc_id, r.text) for r in df.collect()), key=repr)


def test_quality_of_nasty_rows(nasty, spark, sf_dir, tmp_path):
    got = corpus_pipeline.classify_quality(spark, nasty, sf_dir)
    assert got.columns == nasty.columns and got.count() <= len(NASTY)
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    assert pairs(corpus_pipeline.classify_quality(spark, nasty, str(tmp_path))) == pairs(nasty)


def test_near_copies_of_nasty_rows(nasty, spark):
    got = corpus_pipeline.drop_near_copies(spark, nasty, "")
    assert got.columns == nasty.columns
    # 1 and the first 2 are near copies, as are the repeated rows with words; other texts of an id stay, and so do all rows without words
    assert pairs(got) == sorted([NASTY[i][:2] for i in (0, 2, 4, 5, 6, 7, 8, 10, 11, 12, 14)], key=repr)


def test_masking_of_nasty_rows(nasty, spark):
    got = corpus_pipeline.mask_personal_data(spark, nasty, "")
    assert got.columns == nasty.columns
    assert pairs(got) == sorted([(i, t and t.replace("a.b@example.org", "[EMAIL]").replace("10.0.0.1", "[IP]")) for i, t, _ in NASTY], key=repr)


def test_mix_of_nasty_rows(nasty, spark):
    got = corpus_pipeline.mix_to_targets(spark, nasty, "")
    assert got.columns == nasty.columns
    rows = pairs(got)
    assert set(rows) <= {r[:2] for r in NASTY if r[1] and r[1].strip()}
    assert all(n <= 2 * sum(r[:2] == k for r in NASTY) for k, n in __import__("collections").Counter(rows).items())
    assert pairs(corpus_pipeline.mix_to_targets(spark, nasty.repartition(5), "")) == rows


def test_packing_of_nasty_rows(nasty, spark):
    got = corpus_pipeline.pack_sequences(spark, nasty, "").collect()
    assert sum(r.piece == 0 for r in got) == len(NASTY)


def test_stages_of_an_empty_table(nasty, spark, sf_dir):
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, nasty.limit(0), sf_dir).count() == 0
