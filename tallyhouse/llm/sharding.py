"""Contiguous shards of nearly equal bytes, from global prefix sums of per-partition totals.

Native: DataFrame functions only, and no text is shuffled.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyhouse.llm.shared import kept

#: Bytes that a row costs besides its text.
ROW_BYTES = 16


def shard_by_bytes(docs: DataFrame, shards: int = 40, partitions: int | None = None, law: str = "bytes") -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard (null) of each row of docs (doc_id, text; other columns are ignored).

    Rows are ordered by doc_id (nulls first), then size, checksum and a hash of the text; rows equal in
    all of these are interchangeable. Each partition of that order is numbered and summed by itself; the
    running totals of the partitions, one row for each, give every row the bytes before it. A row goes to
    the shard in whose equal share of all bytes its first byte lies, so a shard's bytes differ from the
    target by less than one row, and shards are contiguous in the order.
    Null text: empty. An empty table gives no rows. Repeated rows each get a slot of their own.
    """
    spark = docs.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long"), (F.octet_length(text).cast("long") + ROW_BYTES).alias("size"), F.crc32(text).alias("text_crc32"), F.xxhash64(text).alias("h"))
    order = ["doc_id", "size", "text_crc32", "h"]
    # the row number only lets equal rows fall into different partitions; written once, so that every later read sees one assignment
    ranged = kept(rows.withColumn("r", F.monotonically_increasing_id()).repartitionByRange(n, *order, "r").withColumn("part", F.spark_partition_id()))
    within = Window.partitionBy("part").orderBy(*order, "r")
    local = ranged.select("part", "doc_id", "size", "text_crc32", F.sum("size").over(within).alias("run"), F.row_number().over(within).alias("nr"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    totals = ranged.groupBy("part").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n"))
    # one row for each partition, so at most n rows in the single-task window and in the broadcast
    starts = totals.select("part", F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("byte0"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("row0"), F.sum("bytes").over(Window.partitionBy(F.lit(1))).alias("total"))
    placed = local.join(F.broadcast(starts), "part").select(
        "doc_id", "size", "text_crc32", (F.col("row0") + F.col("nr") - 1).alias("at"),
        F.expr(f"cast(least({shards - 1}, (byte0 + run - size) * {shards} div total) as int)").alias("shard"),
    )
    first = placed.groupBy("shard").agg(F.min("at").alias("first"))
    return placed.join(F.broadcast(first), "shard").select("doc_id", "size", "text_crc32", F.lit(law).alias("law"), "shard", (F.col("at") - F.col("first")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
