"""Contiguous shards of equal bytes, from global prefix sums.

Rows are put in order of (doc_id, text checksum, size) by a range partition;
a running sum inside each partition and the totals of the partitions before it
give every row's global byte offset without any task seeing more than its own
rows.  Cutting the offsets at equal targets gives contiguous shards whose sizes
differ by little more than one document.

Defined results: a null text has size 1 and checksum 0; null doc_ids come first;
equal rows lie next to each other and are told apart only by their slot; an
empty table gives an empty result; other columns of the input are not touched.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trailmill.llm._scratch import written

SHARDS = 8


def byte_size(text: Column) -> Column:
    return (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long")


def _running(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds the bytes and rows before each row in its partition."""
    total, rows = 0, 0
    for batch in batches:
        size = batch.column(batch.schema.get_field_index("size")).to_numpy()
        ends = total + np.cumsum(size)
        yield pa.RecordBatch.from_arrays(
            [*batch.columns, pa.array(ends - size), pa.array(np.arange(rows, rows + len(size)))],
            names=[*batch.schema.names, "bytes_before", "rows_before"],
        )
        if len(size):
            total, rows = int(ends[-1]), rows + len(size)


def ordered_offsets(keyed: DataFrame, order: list[str]) -> DataFrame:
    """Adds ``start`` (bytes before) and ``place`` (rows before) in global order.

    ``keyed`` has a ``size`` column.  The ordered rows are written once: range
    bounds are sampled per run, so totals and rows must come from one run.
    Totals are one row per partition.
    """
    spark = keyed.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    local = keyed.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id())
    schema = local.schema.simpleString()[7:-1] + ",bytes_before:bigint,rows_before:bigint"
    local = written(local.mapInArrow(_running, schema), "shard-order")
    totals = local.groupBy("part").agg(F.sum("size").alias("part_bytes"), F.count("*").alias("part_rows"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        F.col("part").alias("at_part"),
        F.coalesce(F.sum("part_bytes").over(earlier), F.lit(0)).alias("bytes_at"),
        F.coalesce(F.sum("part_rows").over(earlier), F.lit(0)).alias("rows_at"),
        F.sum("part_bytes").over(Window.partitionBy()).alias("all_bytes"),
    )
    # One row per shuffle partition: a number the session sets, whatever the data.
    return (
        local.join(F.broadcast(offsets), F.col("part") == F.col("at_part"))
        .withColumn("start", F.col("bytes_at") + F.col("bytes_before"))
        .withColumn("place", F.col("rows_at") + F.col("rows_before"))
        .drop("part", "at_part", "bytes_at", "rows_at", "bytes_before", "rows_before")
    )


def shard(keyed: DataFrame, order: list[str], shards: int = SHARDS) -> DataFrame:
    """Adds ``shard`` and ``slot``: a row goes where the middle of its bytes lies."""
    names = keyed.columns
    placed = ordered_offsets(keyed, order).withColumn(
        "shard",
        F.least(F.lit(shards - 1), F.floor((F.col("start") * 2 + F.col("size")) * shards / (F.col("all_bytes") * 2)).cast("int")),
    )
    firsts = placed.groupBy("shard").agg(F.min("place").alias("first_place")).withColumnRenamed("shard", "at_shard")
    # One row per shard.
    return placed.join(F.broadcast(firsts), F.col("shard") == F.col("at_shard")).select(
        *names, "shard", (F.col("place") - F.col("first_place")).alias("slot")
    )


def keyed_documents(docs: DataFrame) -> DataFrame:
    return docs.select(
        "doc_id", byte_size(F.col("text")).alias("size"), F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32")
    )


def sharded_documents(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """All rows and columns of the documents, with size, text_crc32, shard and slot; columns of these names give way."""
    added = ("size", "text_crc32", "shard", "slot")
    keep = F.struct(*[docs[c] for c in docs.columns if c not in added]).alias("row")
    rows = docs.select(
        docs["doc_id"], byte_size(docs["text"]).alias("size"), F.crc32(F.coalesce(docs["text"], F.lit("")).cast("binary")).alias("text_crc32"), keep
    )
    done = shard(rows, ["doc_id", "text_crc32", "size"], shards)
    return done.select("row.*", *added)


def op7_sharding(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    done = shard(keyed_documents(docs), ["doc_id", "text_crc32", "size"])
    return done.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )
