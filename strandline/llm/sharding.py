"""Contiguous shards of nearly equal bytes: global prefix sums from per-partition totals, cut at equal targets.

Rows are range-partitioned by key and materialised, so each row's range never changes. The totals of
the ranges, one row each, give every range's offset; running sums inside a range do the rest. Only
key, size and checksum are moved, never the text, and no step runs over all rows in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.llm.common import materialise

OVERHEAD = 16


def size_of(text: Column) -> Column:
    """UTF-8 bytes of the text (null: none) and a fixed cost per row."""
    return F.octet_length(F.coalesce(text, F.lit(""))).cast("long") + OVERHEAD


def assign(rows: DataFrame, order: list[str], size: str = "size", shards: int = 40, ranges: int | None = None) -> DataFrame:
    """``rows`` with ``shard`` (0 to shards-1) and ``slot`` (0, 1, ... within the shard).

    Rows are taken in the order of ``order`` (nulls first, repeated rows next to each other, of any
    number); a row belongs to the shard in which the middle of its bytes falls, so a shard misses its
    target by less than one row. Columns named like the outputs are replaced, all others carried as
    they are; an empty table stays empty. A shard is empty where a single row is larger than the target.
    """
    spark = rows.sparkSession
    n = ranges or max(64, 4 * int(spark.conf.get("spark.sql.shuffle.partitions", "200")))
    kept = [c for c in rows.columns if c not in ("shard", "slot")]
    # The serial number lets ranges cut through equal rows; it is written down before it is used again.
    key = F.struct(*order, F.monotonically_increasing_id().alias("_serial"))
    keyed = rows.select(F.struct(*kept).alias("row"), key.alias("key"), F.col(size).alias("bytes"))
    dealt = materialise(keyed.repartitionByRange(n, "key").withColumn("range", F.spark_partition_id()))
    # One row for each range: bounded by their number, whatever the input; so is what is broadcast of them.
    totals = dealt.groupBy("range").agg(F.sum("bytes").alias("bytes"), F.count(F.lit(1)).alias("rows"))
    earlier = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select(
        "range",
        F.coalesce(F.sum("bytes").over(earlier), F.lit(0)).alias("bytes_before"),
        F.coalesce(F.sum("rows").over(earlier), F.lit(0)).alias("rows_before"),
        F.sum("bytes").over(Window.partitionBy()).alias("all"),
    )
    inside = Window.partitionBy("range").orderBy("key")
    sums = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = (
        dealt.withColumns({"sum": F.sum("bytes").over(sums), "number": F.row_number().over(inside) - 1})
        .join(F.broadcast(starts), "range")
        .withColumn("twice_middle", 2 * (F.col("bytes_before") + F.col("sum")) - F.col("bytes"))
        .withColumn("shard", F.least(F.lit(shards - 1), F.expr(f"cast(twice_middle * {shards} div (2 * all) as int)")))
        .withColumn("place", F.col("rows_before") + F.col("number"))
    )
    firsts = placed.groupBy("shard").agg(F.min("place").alias("first"))  # one row for each shard
    out = placed.join(F.broadcast(firsts), "shard")
    return out.select("row.*", "shard", (F.col("place") - F.col("first")).alias("slot"))


def shard_documents(docs: DataFrame, shards: int = 40) -> DataFrame:
    """doc_id, size, text_crc32, shard and slot of every document.

    Documents are taken by a hash of their text, so equal texts are next to each other: in one shard,
    or in neighbouring ones where a cut falls among them. A null text has no bytes and counts as empty.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", size_of(F.col("text")).alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.xxhash64(text).alias("text_hash"))
    return assign(rows, ["text_hash", "text_crc32", "size", "doc_id"], shards=shards).drop("text_hash")
