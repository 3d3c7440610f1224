"""Vectors of whole numbers in blocks, and a grid in which every two blocks meet in one task."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from isoreach.llm.storage import shared_folder

#: Scores beyond it count as it, either way; sums and differences of two still fit a long.
LIMIT = (1 << 62) - 1

#: Up to this size whole numbers and their sums are exact as doubles.
_EXACT = float(1 << 53)

#: Bytes of a block's components as doubles, and blocks of queries that meet a block in one task.
_BLOCK_BYTES, _QUERIES_AT_ONCE = 2 << 20, 64

_FILE_ROWS = 32

BLOCK_SCHEMA = "block long, dim long, ids binary, labels binary, kind string, m binary, norm double"


def usable(v: str) -> Column:
    """Whether a vector is there and all its components are finite numbers."""
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(F.col(v).isNotNull() & ~bad, F.lit(False))


def whole(values: np.ndarray, scale: float) -> np.ndarray:
    """floor(scale * x) as doubles, which hold it exactly."""
    most = np.finfo(np.float64).max
    with np.errstate(over="ignore"):
        return np.floor(np.clip(scale * values.astype(np.float64), -most, most))


def norms(m: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.sqrt((m * m).sum(1))


def stored_blocks(vectors: DataFrame, name: str, *, scale: float, rows: int) -> DataFrame:
    """``vectors`` (id, label, v) packed where they lie into blocks of one length, stored.

    A block has at most ``rows`` vectors and two megabytes of components. Nothing is shuffled, so it
    does not matter how many rows share an id or a label.
    """

    def pack(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple[np.ndarray, ...]]] = {}
        made = 0

        def block(dim: int) -> pa.RecordBatch:
            nonlocal made
            ids, labels, m = (np.concatenate(x) for x in zip(*held.pop(dim), strict=True))
            size = np.abs(m).max(initial=0)
            kind = "<i2" if size < 1 << 15 else "<i4" if size < 1 << 31 else "<f8"
            made += 1
            values = [
                (TaskContext.get().partitionId() << 36) + made, dim, ids.tobytes(), labels.tobytes(), kind,
                m.astype(kind).tobytes(), float(norms(m).max(initial=0)),
            ]
            types = [pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.string(), pa.binary(), pa.float64()]
            names = [c.split()[0] for c in BLOCK_SCHEMA.split(", ")]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, types, strict=True)], names)

        for batch in batches:
            v = batch.column("v")
            lengths = v.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            first = np.cumsum(lengths) - lengths
            flat = v.flatten().to_numpy(zero_copy_only=False)
            ids, labels = (batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("id", "label"))
            for dim in np.unique(lengths).tolist():
                most = max(min(rows, _BLOCK_BYTES // (8 * max(dim, 1))), 1)
                of_dim = np.flatnonzero(lengths == dim)
                while len(of_dim):
                    room = most - sum(len(x[0]) for x in held.get(dim, []))
                    now, of_dim = of_dim[:room], of_dim[room:]
                    m = whole(flat[first[now, None] + np.arange(dim)], scale)
                    held.setdefault(dim, []).append((ids[now], labels[now], m))
                    if len(now) == room:
                        yield block(dim)
            while sum(len(x[0]) * dim for dim, parts in held.items() for x in parts) > 4 * _BLOCK_BYTES // 8:
                yield block(max(held, key=lambda d: sum(len(x[0]) for x in held[d]) * d))
        for dim in list(held):
            yield block(dim)

    path = shared_folder(vectors.sparkSession, name)
    made = vectors.mapInArrow(pack, BLOCK_SCHEMA)
    made.write.option("maxRecordsPerFile", _FILE_ROWS).parquet(path)
    return vectors.sparkSession.read.schema(made.schema).parquet(path)


class Block:
    """The ids, labels and matrix of one row."""

    def __init__(self, row: dict) -> None:
        self.name = row["block"]
        self.ids = np.frombuffer(row["ids"], np.int64)
        self.labels = np.frombuffer(row["labels"], np.int64)
        self.m = np.frombuffer(row["m"], row["kind"]).astype(np.float64).reshape(len(self.ids), row["dim"])
        self.norms = norms(self.m)

    def rows(self, at: np.ndarray) -> Block:
        part = object.__new__(Block)
        part.name, part.ids, part.labels = self.name, self.ids[at], self.labels[at]
        part.m, part.norms = self.m[at], self.norms[at]
        return part


def scores(x: Block, y: Block) -> np.ndarray:
    """Inner products of all rows, exact up to ``LIMIT``."""
    if x.norms.max(initial=0) * y.norms.max(initial=0) < _EXACT:
        return (x.m @ y.m.T).astype(np.int64)
    return _clipped(_ints(x.m) @ _ints(y.m).T)


def pair_scores(x: Block, y: Block, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of row a of ``x`` and row b of ``y``."""
    exact, out = x.norms.max(initial=0) * y.norms.max(initial=0) < _EXACT, np.empty(len(a), np.int64)
    for i in range(0, len(a), 1 << 14):
        j = slice(i, i + (1 << 14))
        if exact:
            out[j] = np.einsum("ij,ij->i", x.m[a[j]], y.m[b[j]])
        else:
            out[j] = _clipped((_ints(x.m[a[j]]) * _ints(y.m[b[j]])).sum(1))
    return out


def _ints(m: np.ndarray) -> np.ndarray:
    return np.array([int(v) for v in m.ravel()], object).reshape(m.shape)


def _clipped(m: np.ndarray) -> np.ndarray:
    flat = [min(max(int(v), -LIMIT), LIMIT) for v in np.ravel(m)]
    return np.array(flat, np.int64).reshape(np.shape(m))


def first_per_row(row: np.ndarray, score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of the first ``k`` entries of each row, higher scores first, then smaller ids."""
    order = np.lexsort((ids, -score, row))
    starts = np.flatnonzero(np.concatenate([[True], row[order][1:] != row[order][:-1]])) if len(row) else order
    place = np.arange(len(order)) - np.repeat(starts, np.diff(np.append(starts, len(order))))
    return order[place < k]


def meet(
    candidates: DataFrame, queries: DataFrame, counts: tuple[int, int], compare: Callable, schema: str
) -> DataFrame:
    """``compare(block, [(block, state), ...])`` for every block of candidates with blocks of queries of its length.

    ``queries`` are blocks with a column ``state``; ``counts`` says how many blocks there are of each.
    Blocks are dealt into rows and columns of a grid, and a task gets a cell: a few blocks of
    candidates, which are taken one after another, and at most some 64 blocks of queries. ``compare``
    yields lists of columns of longs, as ``schema`` names them.
    """
    spark = candidates.sparkSession
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    lines = max(min(counts[0], 4 * tasks), -(-counts[0] // 8), 1)
    columns = max(-(-counts[1] // _QUERIES_AT_ONCE), 1)
    keys = ["line", "column", "dim"]

    def place(n: int) -> Column:
        return F.pmod(F.xxhash64("block"), F.lit(n)).cast("long")

    def all_of(n: int) -> Column:
        return F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))

    # A number of partitions of its own: the cells are few bytes and much work, so they shall not be coalesced.
    parts = max(min(lines * columns, tasks), 1)
    left = candidates.withColumn("line", place(lines)).withColumn("column", all_of(columns)).repartition(parts, *keys)
    right = queries.withColumn("column", place(columns)).withColumn("line", all_of(lines)).repartition(parts, *keys)
    names = [c.removesuffix(" long") for c in schema.split(", ")]

    def cell(of: pa.Table, asked: pa.Table) -> pa.Table:
        queries_here = [(Block(r), r["state"]) for r in asked.to_pylist()]
        made = [compare(Block(of.slice(i, 1).to_pylist()[0]), queries_here) for i in range(of.num_rows)] if queries_here else []
        whole_columns = list(zip(*(part for parts_ in made for part in parts_), strict=True)) or [[]] * len(names)
        return pa.table({n: pa.array(np.concatenate(c) if c else [], pa.int64()) for n, c in zip(names, whole_columns, strict=True)})

    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(cell, schema)
