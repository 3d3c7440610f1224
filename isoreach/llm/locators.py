"""Rows found again by the file they lie in and their position there, and joins that move few or spread them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from isoreach.llm.storage import written

#: Bits of a filter per key, and at most: 64 MB.
_BITS_PER_KEY, _MOST_BITS = 16, 1 << 29

#: Bits of one row of a filter, which is what bitmap_construct_agg makes.
_ROW_BITS = 32768


def place(docs: DataFrame) -> tuple[Column, Column]:
    """(file, position) of a row of a table read from files, also where it has a column of that name itself."""
    hidden = docs.metadataColumn("_metadata")
    return hidden["file_path"], hidden["row_index"]


def located(docs: DataFrame) -> DataFrame:
    """``docs`` whose rows can be found again; stored first if they can't."""
    try:
        docs.select(*place(docs))
        return docs
    except AnalysisException:
        return written(docs, "content")


def unused(df: DataFrame, *names: str) -> list[str]:
    """``names``, each with as many underscores before it as it takes to be no column of ``df``."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name in taken:
            name = f"_{name}"
        out.append(name)
    return out


def split_by_filter(rows: DataFrame, keys: DataFrame, *columns: str) -> tuple[DataFrame, DataFrame]:
    """``rows`` that may and that cannot have one of ``keys`` in ``columns``, without a shuffle of ``rows``.

    The keys' hashes are set as bits of a filter, 16 per key and 64 MB at most, which is broadcast. Of rows
    without a key a few pass, more where there are over 30 million keys; they are left to the join that follows.
    """
    bits = min(max(keys.count() * _BITS_PER_KEY, _ROW_BITS), _MOST_BITS)
    line, bit, bitmap, held = unused(rows, "filter_line", "filter_bit", "filter_bitmap", "filter_held")

    def placed(df: DataFrame) -> DataFrame:
        at = F.pmod(F.xxhash64(*columns), F.lit(bits))
        spread = df.withColumn(bit, at).withColumn(line, F.floor(F.col(bit) / _ROW_BITS).cast("long"))
        return spread.withColumn(bit, F.pmod(F.col(bit), F.lit(_ROW_BITS)))

    lines = placed(keys.select(*columns)).groupBy(line).agg(F.bitmap_construct_agg(F.col(bit)).alias(bitmap))
    byte = F.conv(F.hex(F.substring(bitmap, (F.floor(F.col(bit) / 8) + 1).cast("int"), 1)), 16, 10).cast("long")
    is_set = F.coalesce(F.getbit(byte, F.pmod(F.col(bit), F.lit(8)).cast("int")) == 1, F.lit(False))
    tested = placed(rows).join(F.broadcast(lines), line, "left").withColumn(held, is_set).drop(bit, line, bitmap)
    return tested.filter(held).drop(held), tested.filter(~F.col(held)).drop(held)


def without_rows(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """``docs`` without the rows at ``gone`` (file, row), all columns as they were.

    Only the rows that the filter of ``gone`` holds are shuffled, next to few others.
    """
    names = unused(docs, "at_file", "at_row")
    file, row = place(docs)
    at = docs.select("*", file.alias(names[0]), row.alias(names[1]))
    places = gone.select(F.col("file").alias(names[0]), F.col("row").alias(names[1]))
    some, others = split_by_filter(at, places, *names)
    return others.unionByName(some.join(places, names, "left_anti").select(*[F.col(f"`{c}`") for c in others.columns])).drop(*names)


def join_counted(rows: DataFrame, lookup: DataFrame, key: str, n: str, total: int, how: str = "inner") -> DataFrame:
    """``rows`` joined to ``lookup``, which has one row per ``key`` and says in ``n`` how many rows have it.

    A key with more rows than a partition has on average, of which there are fewer than partitions, is
    spread: its rows are dealt to several tasks by a hash of all their columns, and each gets the lookup row.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    per = max(-(-total // parts), 64)
    hot = F.broadcast(lookup.filter(F.col(n) > per).select(key, F.ceil(F.col(n) / per).cast("long").alias("slices_")))
    slices = F.coalesce(F.col("slices_"), F.lit(1).cast("long"))
    dealt = rows.join(hot, key, "left").withColumn("slice_", F.pmod(F.xxhash64(*rows.columns), slices)).drop("slices_")
    repeated = lookup.join(hot, key, "left").withColumn("slice_", F.explode(F.sequence(F.lit(0).cast("long"), slices - 1))).drop("slices_")
    return dealt.join(repeated, [key, "slice_"], how).drop("slice_")
