"""Contiguous shards of near-equal byte size.

The rows are put into blocks by range of a key.  Block totals, one row per block, are scanned once to
give every block the bytes and rows before it; inside its block a row adds its own running sum.  The
global prefix sum is cut at equal targets: a row belongs to the shard in which its middle byte falls.
No task sees more than one block, and only the key and the size are shuffled, never a text.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import stage
from .common import byte_size, query, shuffle_partitions, table


def by_bytes(rows: DataFrame, shards: int, key: Column, size: Column, carry: Sequence[Column],
             tie: Column | None = None, blocks: int | None = None) -> DataFrame:
    """Shard number and slot of every row, contiguous in ``key`` order.

    Returns the ``carry`` columns with ``size``, ``shard`` (0 to ``shards`` - 1) and ``slot`` (gapless
    from 0 within the shard).  Other columns of ``rows`` are ignored, so none can clash.

    * Null keys come first; equal keys are ordered by ``tie``, and rows equal in both are
      interchangeable.
    * A null size counts as nothing.  When all sizes are nothing, every row is in shard 0.
    * A row larger than a whole shard takes the shard of its middle byte; shards beside it may be empty.
    * An empty table gives an empty table.
    """
    spark = rows.sparkSession
    blocks = blocks or 4 * shuffle_partitions(spark)
    narrow = stage(rows.select(key.alias("_key"), (F.lit(0) if tie is None else tie).alias("_tie"),
                               F.coalesce(size.cast("long"), F.lit(0)).alias("size"),
                               F.struct(*carry).alias("_row")), "shard-sizes")
    ranged = stage(narrow.withColumn("_id", F.monotonically_increasing_id())
                   .repartitionByRange(blocks, "_key", "_tie", "_id")
                   .withColumn("_block", F.spark_partition_id()), "shard-blocks")

    ahead = Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)  # one row per block
    everything = Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    offsets = (ranged.groupBy("_block").agg(F.sum("size").alias("_bytes"), F.count(F.lit(1)).alias("_rows"))
               .select("_block", F.coalesce(F.sum("_bytes").over(ahead), F.lit(0)).alias("_bytes_before"),
                       F.coalesce(F.sum("_rows").over(ahead), F.lit(0)).alias("_rows_before"),
                       F.sum("_bytes").over(everything).cast("double").alias("_total")))

    inside = Window.partitionBy("_block").orderBy("_key", "_tie", "_id")
    running = F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    placed = (ranged.withColumns({"_upto": running, "_at": F.row_number().over(inside) - 1})
              .join(offsets, "_block")
              .withColumn("_twice_middle", 2 * (F.col("_bytes_before") + F.col("_upto")) - F.col("size"))
              .withColumn("shard", F.when(F.col("_total") == 0, 0).otherwise(F.least(
                  F.lit(shards - 1),
                  F.floor(F.col("_twice_middle") * (F.lit(float(shards)) / (2 * F.col("_total")))))).cast("int"))
              .select("_row", "size", "shard", (F.col("_rows_before") + F.col("_at")).alias("_place")))
    starts = placed.groupBy("shard").agg(F.min("_place").alias("_start"))  # at most one row per shard
    return (placed.join(F.broadcast(starts), "shard")
            .select("_row.*", "size", "shard", (F.col("_place") - F.col("_start")).cast("long").alias("slot")))


@query("op1_sharding")
def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 24 shards of near-equal bytes, in the order of their ids."""
    crc = F.coalesce(F.crc32("text"), F.lit(0)).cast("long")
    placed = by_bytes(table(spark, sf_dir, "documents"), 24, F.col("doc_id"), byte_size(F.col("text")) + 8,
                      [F.col("doc_id"), crc.alias("text_crc32")], tie=crc)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
                         F.lit(None).cast("int").alias("grown_shard"))


def write_shards(rows: DataFrame, folder: str) -> None:
    """Write placed rows as one folder per shard, in files that follow each other by slot."""
    (rows.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot")
     .write.partitionBy("shard").parquet(folder))
