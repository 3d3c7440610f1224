"""One query per operator on the tables of a folder, with SQL where SQL can say the same."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from isoreach.llm import (
    hard_negatives,
    packing,
    periodic_runs,
    pq_dedup,
    quality,
    sentencepiece_scan,
    sharding,
    simhash,
    streaming_dedup,
    token_count,
    top_k,
    toxicity,
    warc,
)
from isoreach.llm.labelled import remainder
from isoreach.llm.storage import shared_folder

BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")
SHARDS = 24


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages written as WARC archives and read back: what each record says and holds."""
    warc.register(spark)
    folder = shared_folder(spark, "warc")
    with warc.small_batches(spark):
        records = warc.page_records(_table(spark, sf_dir, "pages"))
        records.write.format("warc").mode("append").option("path", folder).save()
    found = spark.read.format("warc").load(folder)
    whole = F.col("warc_type") == "response"
    return found.select(
        warc.page_of(F.col("record_id")).alias("page_id"),
        F.when(whole, F.length("payload").cast("long")).otherwise(F.col("payload_length")).alias("payload_bytes"),
        F.when(whole, F.sha1("payload")).otherwise(F.substring_index("payload_digest", ":", -1)).alias("payload_digest"),
        F.col("warc_type").alias("record_type"),
        warc.page_of(F.col("refers_to")).alias("refers_to"),
    )


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of all documents, their number, and whether decoding them gives the text again."""
    docs = _table(spark, sf_dir, "documents")
    encoded = sentencepiece_scan.encode(docs.withColumn("doc_id", F.struct("doc_id", F.sha1("text").alias("sha"))), PIECES)
    decoded = sentencepiece_scan.decode(encoded, PIECES)
    return decoded.select(
        F.col("doc_id.doc_id").alias("doc_id"),
        F.size("ids").cast("long").alias("n_tokens"),
        "ids",
        F.coalesce(F.sha1("text") == F.col("doc_id.sha"), F.lit(False)).alias("round_trip"),
    )


def op3_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pq_dedup.near_vectors(_table(spark, sf_dir, "embeddings"), cosine=0.95)


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.piece_digests(packing.pack(_table(spark, sf_dir, "documents"), BYTE_BPE, length=1024, end_id=0))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_components(_table(spark, sf_dir, "documents"), words=4, distance=4)


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_count.count_tokens(_table(spark, sf_dir, "documents"), BYTE_BPE, limit=512)


def _judged(scores: DataFrame, folds: int, held: int) -> DataFrame:
    return scores.select(
        "doc_id",
        (remainder("doc_id", folds) == held).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, _table(spark, sf_dir, "labels"), folds=5)
    return _judged(toxicity.score_texts(docs, model), 5, 0)


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = streaming_dedup.exact_duplicates(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    dealt = sharding.shard_by_bytes(_table(spark, sf_dir, "documents"), SHARDS)
    return dealt.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        F.col("slot").cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = quality.fit(docs, _table(spark, sf_dir, "labels"), folds=3)
    return _judged(quality.score_texts(docs, model), 3, 1)


def _with_planted_periods(docs: DataFrame) -> DataFrame:
    """``text`` of one document in ten, by a checksum of its id, repeats with a period from some word on."""
    words = F.filter(F.split(F.coalesce("text", F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    g, n = F.floor(h / 10).cast("long"), F.col("_n")
    a = F.pmod(F.col("_g"), n)
    period = 1 + F.floor((n - a) / (3 + F.pmod(F.col("_g"), F.lit(8)))).cast("long")
    chosen = docs.withColumn("_words", F.when(F.pmod(h, F.lit(10)) == 0, words)).withColumn("_n", F.size("_words").cast("long"))
    placed = chosen.withColumn("_g", g).withColumn("_a", F.when(n > 0, a)).withColumn("_p", F.when(n > 0, period))
    a, p = F.col("_a").cast("int"), F.col("_p").cast("int")
    times = F.ceil((n - F.col("_a")) / F.col("_p")).cast("int")
    tail = F.slice(F.flatten(F.array_repeat(F.slice("_words", a + 1, p), times)), F.lit(1), n.cast("int") - a)
    planted = F.array_join(F.concat(F.slice("_words", F.lit(1), a), tail), " ")
    return placed.select("doc_id", F.when(F.col("_a").isNotNull(), planted).otherwise(F.col("text")).alias("text"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All runs of each document, the longest one, and the text without their repetitions."""
    found = periodic_runs.periodic_runs(_with_planted_periods(_table(spark, sf_dir, "documents")))
    # The smallest of (-length, start, period) is the longest run.
    best = F.array_min(F.transform("runs", lambda r: F.struct((-r["length"]).alias("less"), r["start"].alias("start"), r["period"].alias("period"))))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", *(r[c].cast("string") for c in ("start", "length", "period"))), F.lit("\n")))
    rows = found.withColumn("best", F.when(F.size("runs") > 0, best))
    return rows.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        F.col("best.start").alias("start"),
        (-F.col("best.less")).alias("length"),
        F.col("best.period").alias("period"),
        F.expr("-best.less * 1000 div best.period").alias("exponent_milli"),
        F.sha2(F.concat_ws("", lines).cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )


def op12_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k.top_scores(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5, scale=256.0)


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    vectors = _table(spark, sf_dir, "embeddings").withColumn("label", label)
    return hard_negatives.hard_negatives(vectors, F.col("vec_id") % 100 == 0, positives=5, negatives=5, low=80, high=100, scale=256.0)


QUERIES = {
    "op1_warc": op1_warc,
    "op2_sentencepiece": op2_sentencepiece,
    "op3_embedding_dedup": op3_embedding_dedup,
    "op4_packing": op4_packing,
    "op5_simhash": op5_simhash,
    "op6_token_counts": op6_token_counts,
    "op7_toxicity": op7_toxicity,
    "op8_exact_dedup": op8_exact_dedup,
    "op9_sharding": op9_sharding,
    "op10_quality": op10_quality,
    "op11_periodic_runs": op11_periodic_runs,
    "op12_top_k": op12_top_k,
    "op13_hard_negatives": op13_hard_negatives,
}

# The checksum of a text, byte by byte: the table of remainders is built by the rule of CRC-32.
_CRC32 = """
crc_bits AS (
  SELECT n, n AS c, 0 AS step FROM range(256) t(n)
  UNION ALL
  SELECT n, CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END, step + 1 FROM crc_bits WHERE step < 8
),
crc AS (SELECT list(c ORDER BY n) AS rest FROM crc_bits WHERE step = 8)"""

# Vectors of whole numbers; those with a component that is no number are out.
_WHOLE = """
whole AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
)"""

ORACLE_SQL = {
    "op1_warc": """
        WITH p AS (
          SELECT page_id, coalesce(html, '') AS h, strlen(coalesce(html, '')) AS n FROM pages
        ),
        g AS (SELECT *, max(page_id) OVER (PARTITION BY h) AS first FROM p)
        SELECT page_id, n AS payload_bytes, sha1(h) AS payload_digest,
               CASE WHEN n >= 1000 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN n >= 1000 AND page_id <> first THEN first END AS refers_to
        FROM g""",
    "op3_embedding_dedup": """
        WITH RECURSIVE v AS (
          SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings
          WHERE len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
            AND len(list_filter(embedding, lambda x: x <> 0)) > 0
        ),
        links AS (
          SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b
          ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
          WHERE list_dot_product(a.e, b.e) / sqrt(list_dot_product(a.e, a.e) * list_dot_product(b.e, b.e)) >= 0.95
        ),
        reach(x, y) AS (
          SELECT vec_id, vec_id FROM embeddings
          UNION
          SELECT reach.x, links.y FROM reach JOIN links ON reach.y = links.x
        ),
        roots AS (SELECT x, min(y) AS r FROM reach GROUP BY x),
        counts AS (SELECT x, count(*) AS n FROM links GROUP BY x)
        SELECT e.vec_id, coalesce(n, 0) AS n_links, r AS component_id, e.vec_id = r AS kept
        FROM embeddings e JOIN roots ON e.vec_id = roots.x LEFT JOIN counts ON e.vec_id = counts.x""",
    "op8_exact_dedup": r"""
        WITH t AS (
          SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS s FROM documents
        )
        SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
               doc_id = min(doc_id) OVER w AS kept, sha256(s) AS text_sha256
        FROM t WINDOW w AS (PARTITION BY s)""",
    "op9_sharding": f"""
        WITH RECURSIVE {_CRC32},
        h AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
        d AS (
          SELECT doc_id, length(h) // 2 + 8 AS size,
                 xor(4294967295, list_reduce(
                   list_prepend(4294967295::BIGINT,
                     list_transform(regexp_extract_all(h, '..'), lambda x: ('0x' || x)::BIGINT)),
                   lambda c, b: xor(c >> 8, rest[(xor(c, b) & 255) + 1]))) AS text_crc32
          FROM h, crc
        ),
        s AS (
          SELECT *, sum(size) OVER (ORDER BY doc_id, size, text_crc32 ROWS UNBOUNDED PRECEDING) AS upto,
                 sum(size) OVER () AS total
          FROM d
        ),
        p AS (
          SELECT *, least(((upto - (size + 1) // 2) * {SHARDS}) // total, {SHARDS - 1})::INTEGER AS shard FROM s
        )
        SELECT doc_id, size, text_crc32, 'bytes' AS law, shard,
               row_number() OVER (PARTITION BY shard ORDER BY doc_id, size, text_crc32) - 1 AS slot,
               NULL::INTEGER AS grown_shard
        FROM p""",
    "op12_top_k": f"""
        WITH {_WHOLE},
        scored AS (
          SELECT a.vec_id AS query_id, b.vec_id, list_inner_product(a.e, b.e)::BIGINT AS score
          FROM whole a JOIN whole b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0
        ),
        ranked AS (
          SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM scored
        )
        SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5""",
    "op13_hard_negatives": f"""
        WITH {_WHOLE},
        rows_ AS (
          SELECT vec_id, e, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label
          FROM whole WHERE label IS NOT NULL
        ),
        scored AS (
          SELECT a.vec_id AS anchor_id, b.vec_id AS vec_id, a.label = b.label AS same,
                 list_inner_product(a.e, b.e)::BIGINT AS score
          FROM rows_ a JOIN rows_ b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0
        ),
        near AS (
          SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE same
          QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
        )
        SELECT anchor_id, positive_id, vec_id AS negative_id, positive_score, score AS negative_score,
               row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id)::INTEGER AS rank
        FROM near JOIN scored USING (anchor_id)
        WHERE NOT same AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score
        QUALIFY row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) <= 5""",
}
