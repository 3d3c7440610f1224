"""Contiguous shards of nearly equal size, cut by prefix sums."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from isoreach.llm.storage import written

#: Added to the bytes of a text: the length that a record file stores before each.
RECORD_BYTES = 8


def shard_by_bytes(
    docs: DataFrame, shards: int = 24, *, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()
) -> DataFrame:
    """(id, size, text_crc32, shard, slot, *carry): every row's shard and its place there, gapless from 0.

    Rows are taken in the order of id (nulls first), size, checksum and place in the input. They are
    dealt by ranges of that order, so that even a single id that repeats endlessly is split, and stored
    without their texts. Totals per partition, one row each, give every partition its offset; within a
    partition a running sum completes the offset of a row. A shard takes the rows whose middle byte lies
    in its share of the total, hence shards are contiguous and differ from the equal share by less
    than one row at either end. Equal texts are rows like others and not kept together.

    A null text has no bytes. Extra columns are not read but for those in ``carry``.
    """
    text = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    rows = docs.select(
        F.col(id_col).alias("id"),
        (F.length(text) + RECORD_BYTES).cast("long").alias("size"),
        F.crc32(text).alias("crc"),
        F.monotonically_increasing_id().alias("place"),
        F.struct(F.lit(0).alias("_"), *carry).alias("more"),
    )
    order = ["id", "size", "crc", "place"]
    ranged = rows.repartitionByRange(*order).withColumn("part", F.spark_partition_id())
    stored = written(ranged, "ranges")

    totals = stored.groupBy("part").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"))
    ahead = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    overall = Window.partitionBy()
    bases = totals.select(
        "part",
        F.coalesce(F.sum("bytes").over(ahead), F.lit(0)).alias("bytes_before"),
        F.coalesce(F.sum("rows").over(ahead), F.lit(0)).alias("rows_before"),
        F.sum("bytes").over(overall).alias("total"),
    )
    within = Window.partitionBy("part").orderBy(*order)
    placed = stored.withColumn("n", F.row_number().over(within) - 1).withColumn("upto", F.sum("size").over(within))
    joined = placed.join(F.broadcast(bases), "part")  # as many rows as the shuffle has partitions
    middle = F.col("bytes_before") + F.col("upto") - F.ceil(F.col("size") / 2)
    shard = F.least(F.floor(middle.cast("decimal(38,0)") * shards / F.col("total")), F.lit(shards - 1)).cast("int")
    dealt = written(joined.select("id", "size", "crc", "more", (F.col("rows_before") + F.col("n")).alias("row"), shard.alias("shard")), "dealt")
    first = dealt.groupBy("shard").agg(F.min("row").alias("first"))
    numbered = dealt.join(F.broadcast(first), "shard")  # one row per shard
    return numbered.select(
        F.col("id").alias(id_col),
        "size",
        F.col("crc").alias("text_crc32"),
        "shard",
        (F.col("row") - F.col("first")).alias("slot"),
        *[F.col(f"more.{c}").alias(c) for c in carry],
    )
