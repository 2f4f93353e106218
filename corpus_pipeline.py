"""A training-data pipeline over ``documents``: reject toxic texts, drop exact and near copies, mask secrets, pack.

Each stage takes ``(spark, docs, sf_dir)``.  All but the last return the columns
of their input, so that each works on what the one before has kept.
"""

from __future__ import annotations

from string import ascii_lowercase, ascii_uppercase

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from switchyard.llm.exact_dedup import exact_duplicates
from switchyard.llm.keep import without_ids, without_rows
from switchyard.llm.near_dedup import near_duplicates
from switchyard.llm.packing import pack_documents
from switchyard.llm.secrets import redact_secrets
from switchyard.llm.toxicity import held_out, score_toxicity
from switchyard.plans.scratch import materialize

#: No SQL can express the stages.
ORACLE_SQL = None


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the nearest labelled examples don't vote down.

    Rows are judged by their texts and go by id and text together, so rows
    without an id, or that share one, are judged each for itself.  Null and
    empty texts are scored as such.  Other columns are handed on; an empty
    table stays empty, and without labels every row stays.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(~held_out())
    digest = F.sha2(F.coalesce("text", F.lit("")), 256)
    rejected = score_toxicity(docs.withColumn("_digest", digest), labels, digest_col="_digest").where("predicted = 1")
    return without_rows(docs, rejected.select("doc_id", "digest"), digest)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the largest id, of each group of equal texts; null texts count as empty.

    Of rows that repeat an id and a text, and of copies that all have no id,
    one stays.  Other columns are handed on; an empty table stays empty.
    """
    groups = materialize(exact_duplicates(docs).withColumn("digest", F.lower(F.hex("digest"))), "exact")
    digest = F.sha2(F.translate(F.coalesce("text", F.lit("")), ascii_uppercase, ascii_lowercase), 256)
    kept = without_rows(docs, groups.where("not kept").select("doc_id", "digest"), digest)
    # rows that repeat an id, or have none, and the text are all marked as kept
    several = groups.where("kept and group_size > 1").groupBy("doc_id", "digest").agg(F.count("*").alias("n")).where("n > 1").select("doc_id", "digest")
    several = materialize(several, "repeated")
    if several.isEmpty():
        return kept
    rest = without_rows(kept, several, digest)
    keyed = kept.withColumn("_of", digest)
    again = keyed.join(several.toDF("_id", "_digest"), F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_of") == F.col("_digest")), "left_semi")
    return rest.unionByName(again.dropDuplicates(["doc_id", "_of"]).select(*docs.columns))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each component of near-duplicates.

    Rows without an id of their own (null, or shared with other rows) are known
    by a negative hash of id and text instead and so come before the others.
    Texts without a word are near nothing and stay.  Other columns are handed
    on, whatever their names; an empty table stays empty.
    """
    odd = materialize(docs.groupBy("doc_id").agg(F.count("*").alias("n")).where("doc_id is null or n > 1").select(F.col("doc_id").alias("_odd")), "odd")
    if odd.isEmpty():
        return without_ids(docs, near_duplicates(docs).where("not kept").select("doc_id"))
    named = docs.join(odd, F.col("doc_id").eqNullSafe(F.col("_odd")), "left_semi").withColumn("_key", F.xxhash64("doc_id", "text").bitwiseOR(F.lit(-(1 << 63))))
    plain = docs.join(odd, F.col("doc_id").eqNullSafe(F.col("_odd")), "left_anti").withColumn("_key", F.col("doc_id").cast("long"))
    keyed = materialize(plain.unionByName(named), "keyed")
    return without_ids(keyed, near_duplicates(keyed, id_col="_key").where("not kept").select("doc_id"), "_key").select(*docs.columns)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their secrets replaced by a mark.

    Ids aren't looked at, null texts stay null, other columns are handed on; an
    empty table stays empty.
    """
    return redact_secrets(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each piece of a document with its place in a sequence of 4096 tokens.

    A null text is a piece of the end id alone.  Rows that share an id, or have
    none, are packed apart and can be told by their places only.  An empty
    table gives an empty one; columns other than id and text are not looked at.
    """
    return pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("toxicity", toxicity), ("exact_dedup", exact_dedup), ("near_dedup", near_dedup), ("secret_scan", secret_scan), ("packing", packing)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other, each written and read again, over the whole of ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
