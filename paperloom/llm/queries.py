"""The operators' queries (production parameters, whole tables) and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import oracles
from .apportion import mix_sources
from .bytecnn import classify
from .common import table
from .epsilon import near_duplicates
from .langid import identify, learn
from .linecrf import line_rules
from .pack import pack
from .parity import jaccard_components
from .partcodes import compress
from .phrases import remove_repeats
from .piicrf import detect
from .runindex import remove_substrings
from .warc import archive
from .whiten import whiten


def tokenizer_path() -> str:
    """The tokenizer file that the packing contract names."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_line_crf_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_epsilon_grid_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"))


def op3_sainte_lague_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents"))


def op4_parity_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"))


def op5_byte_cnn_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_kneser_ney_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return identify(docs, learn(docs))


def op7_bounded_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), tokenizer_path())


def op8_skip_chain_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect(table(spark, sf_dir, "documents"))


def op9_phrase_automata(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"))


def op10_warc_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive(table(spark, sf_dir, "pages")).drop("url")


def op11_run_length_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_substrings(table(spark, sf_dir, "documents"))


def op12_part_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compress(table(spark, sf_dir, "embeddings"))


def op13_lobpcg_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_line_crf_rules,
        op2_epsilon_grid_order,
        op3_sainte_lague_mix,
        op4_parity_jaccard,
        op5_byte_cnn_quality,
        op6_kneser_ney_language,
        op7_bounded_best_fit,
        op8_skip_chain_pii,
        op9_phrase_automata,
        op10_warc_round_trip,
        op11_run_length_index,
        op12_part_codes,
        op13_lobpcg_whitening,
    )
}

ORACLES: dict[str, str] = {
    "op2_epsilon_grid_order": oracles.OP2,
    "op3_sainte_lague_mix": oracles.OP3,
    "op4_parity_jaccard": oracles.OP4,
    "op9_phrase_automata": oracles.OP9,
    "op10_warc_round_trip": oracles.OP10,
    "op11_run_length_index": oracles.OP11,
    "op12_part_codes": oracles.OP12,
}
