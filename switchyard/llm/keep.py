"""Taking rows out of a table by id."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from switchyard.plans.scratch import materialize

#: More ids than this (8 bytes each) are not broadcast but joined by shuffling.
BROADCAST_IDS = 500_000


def _sent(ids: DataFrame) -> DataFrame:
    return F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids


def without_ids(docs: DataFrame, ids: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Rows of ``docs`` whose id is not among ``ids``, with all their columns; rows without an id stay."""
    gone = materialize(ids.select(F.col(ids.columns[0]).alias(id_col)).where(F.col(id_col).isNotNull()).distinct(), "gone")
    return docs.join(_sent(gone), id_col, "left_anti").select(*docs.columns)


def one_row_each(docs: DataFrame, ids: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each id and text among ``ids``, the ids that several rows have."""
    several = materialize(ids, "several")
    if several.isEmpty():
        return docs
    rest = without_ids(docs, several, id_col)
    return rest.unionByName(docs.join(_sent(several), id_col, "left_semi").select(*docs.columns).dropDuplicates([id_col, text_col]))


def without_rows(docs: DataFrame, rows: DataFrame, digest: Column, id_col: str = "doc_id") -> DataFrame:
    """Rows of ``docs`` whose id, null or not, and ``digest`` are not together among ``rows``, ``(id, digest)``."""
    gone = materialize(rows.toDF("_id", "_digest").distinct(), "gone_rows")
    return docs.withColumn("_of", digest).join(_sent(gone), F.col(id_col).eqNullSafe(F.col("_id")) & (F.col("_of") == F.col("_digest")), "left_anti").select(*docs.columns)
