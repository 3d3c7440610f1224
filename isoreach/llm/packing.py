"""Concatenates all token sequences and cuts the result into windows of one length."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from isoreach.llm.byte_bpe import encoder, segments
from isoreach.llm.storage import written

SEGMENT_CHARS = 1 << 18


def tokenized(docs: DataFrame, tokenizer: str, *, id_col: str, text_col: str, end_id: int) -> DataFrame:
    """(part, start, id, ids): the ids of a text and ``end_id``, and where they begin within the task's own."""

    def encode_all(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, n_ids = encoder(tokenizer)
        kind = np.dtype("<u2" if max(n_ids, end_id + 1) <= 1 << 16 else "<u4")
        part, start = TaskContext.get().partitionId(), 0
        for rows in batches:
            ids, starts = [], []
            for text in rows.column(1).to_pylist():
                cut = segments(text.decode("utf-8", "replace"), SEGMENT_CHARS if not tokenizer.endswith(".model") else 1 << 62)
                own = np.concatenate([*(np.array(encode(p), kind) for p in cut), np.array([end_id], kind)])
                ids.append(own.tobytes())
                starts.append(start)
                start += len(own)
            wide = pa.array([kind.itemsize] * len(ids), pa.int32())
            yield pa.RecordBatch.from_arrays(
                [pa.array([part] * len(ids), pa.int32()), pa.array(starts, pa.int64()), rows.column(0), wide, pa.array(ids, pa.binary())],
                ["part", "start", "id", "width", "ids"],
            )

    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("t"))
    kind = docs.schema[id_col].dataType.simpleString()
    return rows.mapInArrow(encode_all, f"part int, start long, id {kind}, width int, ids binary")


def pack(
    docs: DataFrame,
    tokenizer: str,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    length: int = 1024,
    end_id: int = 0,
) -> DataFrame:
    """(id, start, length, ids, doc_tokens, sequence_id, offset): one row per piece of a document.

    Pass one tokenizes and stores the ids together with their place within the task; the totals of the
    tasks, one number each, give every task its global offset by a prefix sum. Pass two reads the stored
    ids and cuts them wherever the global offset is a multiple of ``length``, so a document that crosses
    such a boundary has one row on either side. Every sequence but the last is full. No row is shuffled.

    ``ids`` holds little-endian unsigned 32-bit ids. A null or empty text is ``end_id`` alone; null ids
    and repeated rows are packed like others. An empty table gives no rows.
    """
    stored = written(tokenized(docs, tokenizer, id_col=id_col, text_col=text_col, end_id=end_id), "tokens")
    in_task = stored.groupBy("part").agg(F.sum(F.length("ids") / F.col("width")).cast("long").alias("n"))
    totals = {r.part: r.n for r in in_task.collect()}  # one row per task of pass one
    parts = np.array(sorted(totals), np.int64)
    before = np.concatenate([[0], np.cumsum([totals[p] for p in parts.tolist()])]).astype(np.int64)
    offsets = docs.sparkSession.sparkContext.broadcast((parts, before))

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, base = offsets.value
        for rows in batches:
            part, start, _, width, ids = (rows.column(i) for i in range(5))
            first = start.to_numpy() + base[np.searchsorted(known, part.to_numpy())]
            row, begins, sizes, tokens, cells = [], [], [], [], []
            for n, (at, wide, own) in enumerate(zip(first.tolist(), width.to_pylist(), ids.to_pylist(), strict=True)):
                values = np.frombuffer(own, f"<u{wide}").astype("<u4")
                edges = [0, *range(length - at % length, len(values), length), len(values)]
                for a, b in zip(edges, edges[1:], strict=False):
                    row.append(n)
                    begins.append(a)
                    sizes.append(b - a)
                    cells.append(at + a)
                    tokens.append(values[a:b].tobytes())
            row, cells = np.array(row, np.int64), np.array(cells, np.int64)
            whole = np.array([len(x) for x in ids.to_pylist()], np.int64) // width.to_numpy() if len(ids) else row
            yield pa.RecordBatch.from_arrays(
                [
                    rows.column(2).take(pa.array(row)),
                    pa.array(begins, pa.int64()),
                    pa.array(sizes, pa.int64()),
                    pa.array(tokens, pa.binary()),
                    pa.array(whole[row], pa.int64()),
                    pa.array(cells // length),
                    pa.array(cells % length),
                ],
                [id_col, "start", "length", "ids", "doc_tokens", "sequence_id", "offset"],
            )

    kind = docs.schema[id_col].dataType.simpleString()
    return stored.mapInArrow(
        cut,
        f"`{id_col}` {kind}, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long",
    )


def piece_digests(pieces: DataFrame) -> DataFrame:
    """Replaces ``ids`` by ``ids_crc32``, their unsigned checksum."""
    return pieces.withColumn("ids", F.crc32("ids")).withColumnRenamed("ids", "ids_crc32")
