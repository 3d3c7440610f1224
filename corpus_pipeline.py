"""A corpus from raw documents to packed sequences: five stages, each a step of the library's operators.

Every stage takes what the one before it kept and hands on the columns of ``documents``, all but the
last: it returns the pieces of the packed sequences.

Stages that run Python set ``spark.sql.execution.arrow.maxBytesPerBatch`` of the session where it is unset.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from isoreach.llm import packing, quality, simhash, streaming_dedup, toxicity
from isoreach.llm.queries import BYTE_BPE
from isoreach.llm.storage import shared_folder

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")

#: Bytes of rows that go to Python at once; by itself Spark sends 10,000 rows, whatever their size.
BATCH = ("spark.sql.execution.arrow.maxBytesPerBatch", 4 << 20)


def _in_small_batches(spark: SparkSession) -> None:
    """Executors and their Python workers hold a few MB of a stage's texts. Stages are lazy, so the setting stays."""
    if spark.conf.get(BATCH[0], None) is None:
        spark.conf.set(*BATCH)


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents with a toxicity score of 0.5 or more. Each row is judged by its own text."""
    _in_small_batches(spark)
    model = toxicity.fit(docs, _labels(spark, sf_dir), folds=5)
    return _judged(docs, model, toxicity.score_texts, F.col("score") < 0.5)


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents with a quality score below 0.5."""
    _in_small_batches(spark)
    model = quality.fit(docs, _labels(spark, sf_dir), folds=3)
    return _judged(docs, model, quality.score_texts, F.col("score") >= 0.5)


def _judged(docs: DataFrame, model, score_texts, stays) -> DataFrame:
    """The rows that stay, scored in place: all columns travel with the text, so nothing is joined."""
    rows = docs.select(F.struct(*COLUMNS).alias("row"), F.col("text").alias("text"))
    scored = score_texts(rows, model, id_col="row", text_col="text")
    return scored.filter(stays).select("row.*")


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with equal texts that with the smallest doc_id stays."""
    return streaming_dedup.drop_duplicates(docs).select(*COLUMNS)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of texts whose fingerprints of four-word shingles differ at four bits or fewer one row stays."""
    _in_small_batches(spark)
    return simhash.drop_near_copies(docs, words=4, distance=4).select(*COLUMNS)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All tokens in sequences of 1024: the pieces of every document."""
    _in_small_batches(spark)
    return packing.piece_digests(packing.pack(docs, BYTE_BPE, length=1024, end_id=0))


STAGES = [
    ("toxicity", without_toxic),
    ("quality", good_quality),
    ("exact_dedup", without_copies),
    ("near_dedup", without_near_copies),
    ("packing", packed),
]

#: The first two stages learn, so no SQL can say the same; tests compare all stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces packed from ``documents``, each stage stored and read again by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        path = shared_folder(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
