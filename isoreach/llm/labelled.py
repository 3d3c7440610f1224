"""The bounded sample of labelled rows that a classifier is fitted on."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def remainder(id_col: str | Column, folds: int) -> Column:
    """crc32 of an id's text modulo ``folds``; 0 for a null id."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % folds, F.lit(0).cast("long"))


def training_rows(
    docs: DataFrame,
    labels: DataFrame,
    label_col: str,
    may_learn: Column,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    rows: int,
    per_class: bool,
    max_bytes: int,
    total_bytes: int = 32 << 20,
) -> list[tuple[bytes, int]]:
    """(text, label) of at most ``rows`` labelled documents, or that many of each label.

    The ids with the smallest hashes are taken, so the choice neither follows the order of the rows
    nor changes when a task is repeated. Texts of over ``max_bytes`` are left out of the sample, and where the
    texts taken would have more than ``total_bytes``, the last ones are (of each label alike). Ids without a label or with two different ones teach nothing; of an id's several texts the smallest counts.
    """
    told = labels.filter(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).filter(may_learn)
    sure = told.groupBy(F.col(id_col).alias("id")).agg(F.min(label_col).alias("y"), F.max(label_col).alias("z"))
    sure = sure.filter(F.col("y") == F.col("z")).select("id", F.col("y").cast("int").alias("y"))
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("t"))
    sizes = texts.select("id", F.length("t").alias("n")).filter(F.col("n") <= max_bytes)
    # Of an id's several texts the longest counts, so that the bound holds.
    sizes = sizes.join(sure, "id").groupBy("id", "y").agg(F.max("n").alias("n")).withColumn("h", F.xxhash64("id"))
    groups = [sizes.filter(F.col("y") == y) for y in (0, 1)] if per_class else [sizes]
    chosen = []
    for group in groups:
        first = group.orderBy("h", "id").limit(rows).select("id", "y", "n").toArrow()
        # Up to the first text for which there is no room.
        fits = np.cumsum(first["n"].to_numpy().astype(np.int64)) <= total_bytes // len(groups)
        chosen.append(first.select(["id", "y"]).slice(0, int(fits.sum())))
    chosen = pa.concat_tables(chosen)
    if not chosen.num_rows:
        return []
    # An Arrow table needs no Python on the executors; a list of rows would leave a second set of workers there.
    chosen = docs.sparkSession.createDataFrame(chosen)
    # At most twice ``rows`` ids, whatever the size of the corpus.
    picked = texts.filter(F.length("t") <= max_bytes).join(F.broadcast(chosen), "id")
    # Arrow's buffers hold a text once, here and in the JVM; rows would hold it several times.
    found = picked.groupBy("id", "y").agg(F.min("t").alias("t")).toArrow()
    ids, labels_of, taken = found["id"].to_pylist(), found["y"].to_pylist(), found["t"]
    return [(taken[i].as_py(), labels_of[i]) for i in sorted(range(len(ids)), key=ids.__getitem__)]
