"""A training corpus in five stages, from documents to packed sequences.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it works on all that
the stage before it kept. Stages 1 to 4 keep the columns of documents.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.llm import apportion, bytecnn, pack, parity, piicrf
from paperloom.llm.common import Scratch, free_name, small, table
from paperloom.llm.queries import tokenizer_path
from paperloom.session import ship


def _ids_are_keys(docs: DataFrame) -> bool:
    """Whether every row has a doc_id of its own."""
    twice = docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1 or doc_id is null")
    return twice.limit(1).count() == 0


def classify_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the byte network does not reject (score >= 0.5).

    Rows are judged by their text alone: null and empty texts have the score of padding, very long texts are scored
    whole, repeated rows are judged alike. Without labels of both kinds nothing is rejected; an empty table stays
    empty; other columns, whatever their names, pass through.
    """
    ship(spark)
    net = bytecnn.train(docs, table(spark, sf_dir, "labels"), 1200)
    name = free_name(docs, "score")
    return bytecnn.score(docs, net, name).where(F.col(name) >= 0.5).select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group, the one with the smallest doc_id; words by fives, similarity 0.8.

    Rows without words link with nothing and all stay. Where a doc_id is null or repeated, each row is a document of
    its own: texts that differ stay although their ids are equal, copies go although theirs are null (null ids come
    last in a group, rows with one id by a hash of the row). An empty table stays empty; other columns, whatever
    their names, pass through.
    """
    ship(spark)
    scratch = Scratch(spark, "near")
    if _ids_are_keys(docs):
        groups = parity.jaccard_components(docs, k=5, percent=80, scratch=scratch)
        rest = scratch.store(groups.where(F.col("doc_id") != F.col("component_id")).select("doc_id"), "rest")
        return docs.join(small(rest), "doc_id", "left_anti").select(*docs.columns)
    row, group = free_name(docs, "_row"), free_name(docs, "_group")
    numbered = scratch.store(docs.withColumn(row, F.monotonically_increasing_id()), "numbered")
    groups = parity.jaccard_components(numbered.select(F.col(row).alias("doc_id"), "text"), k=5, percent=80, scratch=scratch)
    groups = scratch.store(groups.select(F.col("doc_id").alias(row), F.col("component_id").alias(group)), "groups")
    order = F.struct(F.col("doc_id").isNull(), "doc_id", F.xxhash64(*docs.columns), row)
    first = numbered.join(groups, row).groupBy(group).agg(F.min_by(row, order).alias(row)).select(row)
    first = scratch.store(first, "first")
    return numbered.join(small(first), row, "left_semi").select(*docs.columns)


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with personal data replaced by its kind; n_chars follows the text.

    Null and empty texts stay as they are, and so does n_chars of a null text; very long texts are masked whole;
    repeated rows are masked alike; without n_chars, or with further columns, the others pass through; an empty table
    stays empty.
    """
    ship(spark)
    masked = piicrf.mask(docs)
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        changed = F.length("text").cast(kind)
        masked = masked.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(changed))
    return masked.select(*docs.columns)


def mix_to_targets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it: in whole passes, and once more if the mix takes over half of it.

    Documents without words are taken no time; a null source is a source. Where a doc_id is null or repeated, rows
    are known by a digest of all their columns, and equal rows are taken as often as their sum. An empty table
    stays empty; other columns, whatever their names, pass through.
    """
    ship(spark)
    scratch = Scratch(spark, "mixplan")
    key, times, copy = (free_name(docs, n) for n in ("_key", "_times", "_copy"))
    keyed, unique = docs, _ids_are_keys(docs)
    if unique:
        keyed = docs.withColumn(key, F.col("doc_id"))
    else:
        keyed = docs.withColumn(key, F.md5(F.to_json(F.struct(*docs.columns))))
    taken = apportion.mix_sources(keyed.select(F.col(key).alias("doc_id"), "text", "source"), scratch=scratch).select("doc_id", "size", "taken")
    often = F.when(F.col("size") > 0, F.round(F.col("taken") / F.col("size"))).otherwise(0).cast("int")
    plan = taken.select(F.col("doc_id").alias(key), often.alias(times)).where(F.col(times) > 0)
    if not unique:
        plan = plan.groupBy(key).agg(F.sum(times).cast("int").alias(times))
        keyed = keyed.dropDuplicates([key])
    plan = small(scratch.store(plan, "plan"))
    return keyed.join(plan, key).withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(times)))).select(*docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents in sequences of at most 4096 tokens.

    Null and empty texts are the end token alone; very long texts are cut, never dropped; repeated rows are packed as
    often as they come; null doc_ids stay null; other columns are left out; an empty table gives an empty result.
    """
    ship(spark)
    return pack.pack(docs, tokenizer_path())


STAGES = [
    ("quality classifier", classify_quality),
    ("n-gram Jaccard join", drop_near_copies),
    ("PII", mask_personal_data),
    ("mixing sources to target weights", mix_to_targets),
    ("best-fit packing", pack_sequences),
]

#: The network, the field and the tokenizer are not SQL; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written and read again."""
    scratch = Scratch(spark, f"pipeline-{uuid.uuid4().hex[:6]}")
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = scratch.store(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
