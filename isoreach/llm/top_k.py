"""Exact search for the highest inner products, by histograms of all scores."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from isoreach.llm.storage import written
from isoreach.llm.vector_blocks import LIMIT, Block, first_per_row, meet, scores, stored_blocks, usable

#: A pass splits a range of scores into 2**BITS bins.
BITS = 10

#: A query is not refined further once its last bin has so many rows for each that is wanted.
_SPARE = 16

_KEYS = ("block", "pos")

#: A query's range: its lowest score, the bits that a bin leaves off, the number of bins, the place looked for in it.
_RANGE = ("lo", "shift", "bins", "need")


def _ranges(blocks: DataFrame, most: float, k: int) -> DataFrame:
    """(block, pos, lo, shift, bins, need): a range of scores that holds all of a query, by its norm and the largest one."""

    def each(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                b = Block(batch.slice(i, 1).to_pylist()[0])
                with np.errstate(over="ignore", invalid="ignore"):
                    bound = np.nan_to_num(b.norms * most * (1 + 1e-9), nan=0.0, posinf=LIMIT)
                top = [min(int(x) + 1, LIMIT) for x in bound]
                shift = [max((2 * t + 1).bit_length() - BITS, 0) for t in top]
                n = len(top)
                columns = [np.full(n, b.name), np.arange(n), [-t for t in top], shift, np.full(n, 1 << BITS), np.full(n, k)]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], [*_KEYS, *_RANGE])

    ranges = blocks.mapInArrow(each, ", ".join(f"{c} long" for c in (*_KEYS, *_RANGE)))
    return ranges.withColumn("open", F.lit(True))


def _asked(blocks: DataFrame, state: DataFrame) -> DataFrame:
    """The blocks of queries with the state of those of their rows that have one."""
    rows = F.struct("pos", *_RANGE)
    return blocks.join(state.groupBy("block").agg(F.sort_array(F.collect_list(rows)).alias("state")), "block")


def _arrays(state: list[dict]) -> tuple[np.ndarray, ...]:
    return tuple(np.array([s[c] for s in state], np.int64) for c in ("pos", *_RANGE))


def _histogram(of: Block, queries: list[tuple[Block, list[dict]]]) -> Iterator[list[np.ndarray]]:
    """(block, pos, bin, n) of a query's scores in its range; those above it are counted in its ``need`` already.

    Bins below those that hold the first ``need`` scores here cannot hold the place looked for.
    """
    most = 1 << BITS
    for block, state in queries:
        pos, lo, shift, bins, need = _arrays(state)
        query = block.rows(pos)
        at = (scores(query, of) - lo[:, None]) >> shift[:, None]
        row, col = np.nonzero((at >= 0) & (at < bins[:, None]) & (query.ids[:, None] != of.ids))
        n = np.bincount(row * most + at[row, col], minlength=len(pos) * most).reshape(-1, most)
        above = n[:, ::-1].cumsum(1)[:, ::-1] - n
        row, bin_ = np.nonzero((n > 0) & (above < need[:, None]))
        yield [np.full(len(row), block.name), pos[row], bin_, n[row, bin_]]


def _survivors(k: int):
    def compare(of: Block, queries: list[tuple[Block, list[dict]]]) -> Iterator[list[np.ndarray]]:
        """(block, pos, query, id, score) from a query's bound on, of one block its first ``k`` at most."""
        for block, state in queries:
            pos, lo, *_ = _arrays(state)
            query = block.rows(pos)
            s = scores(query, of)
            row, col = np.nonzero((s >= lo[:, None]) & (query.ids[:, None] != of.ids))
            best = first_per_row(row, s[row, col], of.ids[col], k)
            row, col = row[best], col[best]
            yield [np.full(len(row), block.name), pos[row], query.ids[row], of.ids[col], s[row, col]]

    return compare


def top_scores(
    vectors: DataFrame,
    queries: Column,
    *,
    k: int = 5,
    scale: float = 256.0,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    block_rows: int = 2048,
    query_rows: int = 512,
) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` highest scores of each row for which ``queries`` is true.

    A score is the inner product of floor(``scale`` * x) over the components, an integer; those beyond
    ``LIMIT`` count as it. Higher scores come first, then smaller ids. Candidates are all rows but those with the
    query's own id; a query with fewer than ``k`` of them returns all.

    Every pass scores every pair, block by block, and returns a histogram per query: the first over the
    range that the norms allow, each further one over the bin in which the kth score lies, until that bin
    is one score wide or nearly empty. Then what lies above is ranked. A task holds one pair
    of blocks at a time, and of a block of candidates ``k`` rows per query leave it.

    Rows with a null id, a null vector, or a null or non-finite component take no part; vectors are
    candidates for queries of their own length only, empty ones score 0. Repeated rows count each for
    itself, as candidates and as queries. Other columns are not read, whatever their names, but by ``queries``.
    """
    rows = vectors.select(
        F.col(id_col).cast("long").alias("id"), F.lit(0).alias("label"), F.col(vector_col).alias("v"), queries.alias("asks")
    ).filter(F.col("id").isNotNull() & usable("v"))
    candidates = stored_blocks(rows.drop("asks"), "candidates", scale=scale, rows=block_rows)
    blocks = stored_blocks(rows.filter("asks").drop("asks"), "queries", scale=scale, rows=query_rows)
    size = candidates.agg(F.count("*").alias("n"), F.max("norm").alias("norm")).first()
    counts = (size.n, blocks.count())
    found = "block long, pos long, query_id long, vec_id long, score long"
    if not all(counts):
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")

    state = written(_ranges(blocks, size.norm, k), "ranges")
    while not state.filter("open").isEmpty():
        seen = meet(candidates, _asked(blocks, state.filter("open")), counts, _histogram, "block long, pos long, bin long, n long")
        bins = seen.groupBy(*_KEYS, "bin").agg(F.sum("n").alias("n"))
        upto = F.sum("n").over(Window.partitionBy(*_KEYS).orderBy(F.desc("bin")))
        placed = bins.withColumn("upto", upto).join(state.select(*_KEYS, "need"), list(_KEYS))
        kth = placed.filter((F.col("upto") >= F.col("need")) & (F.col("upto") - F.col("n") < F.col("need")))
        refined = state.join(kth.select(*_KEYS, "bin", "n", (F.col("upto") - F.col("n")).alias("above")), list(_KEYS), "left")
        # A query without a kth score keeps its range, and all it has survives.
        more = F.col("open") & (F.col("shift") > 0) & F.coalesce(F.col("n") > _SPARE * k, F.lit(False))
        state = written(
            refined.select(
                *_KEYS,
                F.when(F.col("n").isNotNull(), F.expr("lo + bin * shiftleft(1L, CAST(shift AS INT))")).otherwise(F.col("lo")).alias("lo"),
                F.greatest(F.col("shift") - BITS, F.lit(0).cast("long")).alias("shift"),
                # A bin of fewer scores than a pass has bins is split into single ones, and no score above it counts.
                F.expr(f"shiftleft(1L, CAST(least(shift, {BITS}L) AS INT))").alias("bins"),
                (F.col("need") - F.coalesce("above", F.lit(0).cast("long"))).alias("need"),
                more.alias("open"),
            ),
            "ranges",
        )
    best = meet(candidates, _asked(blocks, state), counts, _survivors(k), found)
    rank = F.row_number().over(Window.partitionBy(*_KEYS).orderBy(F.desc("score"), "vec_id"))
    ranked = best.withColumn("rank", rank).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
