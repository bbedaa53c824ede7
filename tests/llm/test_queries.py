"""The registered queries: equal to SQL where it exists, contract columns and held-out quality elsewhere."""

import pytest

from paperloom.llm import queries

COLUMNS = {
    1: ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"],
    2: ["vec_id", "n_links", "component_id", "kept"],
    3: ["doc_id", "size", "source_size", "target", "taken"],
    4: ["doc_id", "n_shingles", "component_id"],
    5: ["doc_id", "held_out", "score", "predicted"],
    6: ["doc_id", "held_out", "lang_pred", "score"],
    7: ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
    8: ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"],
    9: ["doc_id", "n_words", "n_removed", "kept_sha256"],
    10: ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"],
    11: ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"],
    12: ["vec_id", "code", "error", "label_error", "codebooks_sha256"],
    13: ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
}


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_equals_sql(name, same_as_sql):
    same_as_sql(queries.QUERIES[name], queries.ORACLES[name])


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_columns(name, spark, sf_dir):
    got = queries.QUERIES[name](spark, sf_dir)
    want = COLUMNS[int(name[2:].split("_")[0])]
    assert got.columns[: len(want)] == want


def test_held_out_quality(spark, sf_dir):
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    q = queries.QUERIES["op5_byte_cnn_quality"](spark, sf_dir).where("held_out").join(labels, "doc_id").collect()
    assert sum(r.predicted == r.quality for r in q) >= 0.9 * len(q)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang")
    found = queries.QUERIES["op6_kneser_ney_language"](spark, sf_dir).where("held_out").join(docs, "doc_id").collect()
    assert sum(r.lang_pred == r.lang for r in found) >= 0.95 * len(found)
    rules = queries.QUERIES["op1_line_crf_rules"](spark, sf_dir).join(labels, "doc_id").where("not base_failed").collect()
    assert sum(r.kept == (r.quality == 1) for r in rules) >= 0.95 * len(rules)
