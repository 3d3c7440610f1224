"""Token counts of whole texts."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from isoreach.llm.byte_bpe import batch_encoder, segments

#: Bytes of text that are encoded together, and characters of a text from which on it is cut first.
BATCH_BYTES = 1 << 20
SEGMENT_CHARS = 1 << 18


def balanced(texts: Iterable[str], batch_bytes: int, segment_chars: int) -> Iterator[list[tuple[int, str]]]:
    """(number of the text, part of it) in batches of at most ``batch_bytes`` in UTF-8, or of one part.

    Long texts are cut at safe places.
    """
    batch, held = [], 0
    for number, text in enumerate(texts):
        for part in segments(text, segment_chars):
            size = len(part) if part.isascii() else len(part.encode())
            if batch and held + size > batch_bytes:
                yield batch
                batch, held = [], 0
            batch.append((number, part))
            held += size
    if batch:
        yield batch


def count_tokens(
    docs: DataFrame,
    tokenizer: str,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    limit: int = 512,
    batch_bytes: int = BATCH_BYTES,
    segment_chars: int = SEGMENT_CHARS,
) -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit) of every row, in one pass without a shuffle.

    ``tokenizer`` is the path of a ``tokenizers`` or ``sentencepiece`` file that every executor can
    open; nothing is added to the ids, truncated or padded. Only lengths leave Python. A null text is
    an empty one and has no tokens; null ids and repeated rows are kept, other columns are not read.
    SentencePiece texts are not cut, as such a model may see beyond a space.
    """
    cuts = segment_chars if not tokenizer.endswith(".model") else 1 << 62

    def lengths(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = batch_encoder(tokenizer)
        for rows in batches:
            texts = rows.column(1).to_pylist()
            counts = [0] * len(texts)
            for batch in balanced((t.decode("utf-8", "replace") for t in texts), batch_bytes, cuts):
                for (number, _), ids in zip(batch, encode([part for _, part in batch]), strict=True):
                    counts[number] += len(ids)
            sizes = [len(t) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [rows.column(0), pa.array(sizes, pa.int64()), pa.array(counts, pa.int64())],
                [id_col, "n_bytes", "n_tokens"],
            )

    rows = docs.select(id_col, F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("t"))
    kind = docs.schema[id_col].dataType.simpleString()
    counted = rows.mapInArrow(lengths, f"`{id_col}` {kind}, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
