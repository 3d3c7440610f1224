"""Exact duplicates by a stateful stream over fingerprints, proved on whole texts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from isoreach.llm.locators import join_counted, located, place, split_by_filter, without_rows
from isoreach.llm.storage import shared_folder, written

#: Keys are kept on disk, and a partition of the state leaves its executor when its batch is done: what
#: an executor holds is the state in work, not its share of all that was ever seen.
STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.unloadOnCommit": "true",
}


def normalised(text: str | Column) -> Column:
    """Each run of ASCII white space as one space; null as an empty text."""
    return F.regexp_replace(F.coalesce(text if isinstance(text, Column) else F.col(text), F.lit("")), r"[\x20\x09-\x0D]+", " ")


def streamed_groups(
    fingerprints: DataFrame, *, files_per_batch: int = 64, folder: str | None = None
) -> DataFrame:
    """(digest, keep, n): smallest (id, locator) and number of rows of each digest, kept by a stream.

    ``fingerprints`` has digest, id, file and row, and is stored as the source of the stream, which takes
    ``files_per_batch`` of its files at a time. The state is a running minimum and count per digest in a
    store on disk, without a watermark, so no key ever expires. Each batch is summed up before the
    shuffle, and writes the state of the digests that it met. Both values only move one way, so that
    the newest state of a digest is the smallest ``keep`` and the largest ``n``, in whatever order, and
    a batch that is written again after a failure changes nothing.
    """
    spark = fingerprints.sparkSession
    source = folder or shared_folder(spark, "stream-source")
    fingerprints.write.mode("append").parquet(source)
    states, progress = shared_folder(spark, "stream-states"), shared_folder(spark, "stream-progress")

    def store(changed: DataFrame, batch: int) -> None:
        changed.write.mode("overwrite").parquet(f"{states}/batch={batch}")

    stream = spark.readStream.schema(fingerprints.schema).option("maxFilesPerTrigger", files_per_batch).parquet(source)
    held = stream.groupBy("digest").agg(
        F.min(F.struct("id", "file", "row")).alias("keep"), F.count("*").alias("n")
    )
    before = {name: spark.conf.get(name, None) for name in STATE}
    try:
        for name, value in STATE.items():
            spark.conf.set(name, value)
        query = (
            held.writeStream.outputMode("update")
            .foreachBatch(store)
            .option("checkpointLocation", progress)
            .trigger(availableNow=True)
            .start()
        )
        query.awaitTermination()
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)
    kept = spark.read.schema(held.schema).option("recursiveFileLookup", "true").parquet(states)
    return kept.groupBy("digest").agg(F.min("keep").alias("keep"), F.max("n").alias("n"))


def exact_duplicates(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    files_per_batch: int = 64,
    digest: Callable[[Column], Column] = lambda text: F.sha2(text, 256),
) -> DataFrame:
    """(id, keep_id, group_size, kept, text_sha256, file, row) of every row.

    Rows are equal if their normalised texts are; the row with the smallest id stays, of several rows
    with that id the first by file and position, and a null id only where the group has no other. A null
    text is an empty one; a text of any length is one value. Other columns are not read, whatever their names.

    The stream sees digests, ids and locators only. Digests that were met more than once are hits: the
    text at the locator of the row that stays is fetched, and each row of the hit is compared with it byte by
    byte. Texts of other digests do not move. Where rows differ from it, the rows of that digest are
    grouped by their whole texts, so that ``digest`` may send any texts to one value.
    """
    there = located(docs)
    text = normalised(text_col)
    file, row = place(there)
    rows = there.select(
        F.col(id_col).alias("id"), file.alias("file"), row.alias("row"), digest(text.cast("binary")).alias("digest"), text.alias("t")
    )
    named = written(rows.withColumn("sha", F.sha2(F.col("t").cast("binary"), 256)).drop("t"), "digests")
    # min() of a struct puts null ids first; they shall come last.
    ids = F.struct(F.col("id").isNull().alias("no_id"), F.col("id").alias("id")).alias("id")
    groups = written(
        streamed_groups(named.select("digest", ids, "file", "row"), files_per_batch=files_per_batch), "groups"
    )
    total = groups.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    met = groups.filter(F.col("n") > 1)
    # Only the rows of hits are moved, next to the few others that pass the filter.
    some, _ = split_by_filter(rows, met.select("digest"), "digest")
    hits = written(join_counted(some.select("digest", ids, "file", "row", "t"), met, "digest", "n", total), "hits")
    at_locator = (F.col("keep.file") == F.col("file")) & (F.col("keep.row") == F.col("row"))
    stored = hits.filter(at_locator).select("digest", "n", F.col("t").alias("content"))
    compared = join_counted(hits.drop("n", "keep"), stored, "digest", "n", total)
    unlike = written(compared.filter(F.col("t") != F.col("content")).select("digest").distinct(), "unlike")
    found = join_counted(named, groups, "digest", "n", total).withColumn("own", F.col("keep")).withColumn("own_n", F.col("n"))
    if not unlike.isEmpty():
        apart = hits.drop("n", "keep").join(unlike, "digest")
        texts = apart.groupBy("digest", "t").agg(F.min(F.struct("id", "file", "row")).alias("own"), F.count("*").alias("own_n"))
        split = apart.join(texts, ["digest", "t"]).select("file", "row", "own", "own_n")
        found = found.drop("own", "own_n").join(split, ["file", "row"], "left")
        found = found.withColumn("own", F.coalesce("own", "keep")).withColumn("own_n", F.coalesce("own_n", "n"))
    return found.select(
        F.col("id").alias(id_col),
        F.col("own.id.id").alias("keep_id"),
        F.col("own_n").alias("group_size"),
        ((F.col("own.file") == F.col("file")) & (F.col("own.row") == F.col("row"))).alias("kept"),
        F.col("sha").alias("text_sha256"),
        "file",
        "row",
    )


def drop_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns."""
    there = located(docs)
    judged = exact_duplicates(there, id_col=id_col, text_col=text_col, **options)
    return without_rows(there, written(judged.filter(~F.col("kept")).select("file", "row"), "gone"))
