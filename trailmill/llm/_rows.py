"""Documents in or outside a list of (doc_id, text_hash); equal rows are in it or outside together."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _joined(docs: DataFrame, rows: DataFrame, how: str) -> DataFrame:
    listed = rows.select(F.col("doc_id").alias("_row_id"), F.col("text_hash").alias("_row_hash"))
    return docs.join(listed, docs["doc_id"].eqNullSafe(listed["_row_id"]) & (F.xxhash64(docs["text"]) == listed["_row_hash"]), how)


def semi(docs: DataFrame, rows: DataFrame) -> DataFrame:
    return _joined(docs, rows, "left_semi")


def anti(docs: DataFrame, rows: DataFrame) -> DataFrame:
    return _joined(docs, rows, "left_anti")
