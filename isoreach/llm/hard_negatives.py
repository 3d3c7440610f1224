"""Hard negatives of anchors: threshold joins over an index that leaves out what norms already bound."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from isoreach.llm.storage import written
from isoreach.llm.vector_blocks import LIMIT, Block, first_per_row, meet, pair_scores, scores, stored_blocks, usable

#: Rows whose scores give the first thresholds. They decide how soon a search ends, not what it finds.
SAMPLE = 1024

#: Dimensions that are accumulated between two prunings.
STEP = 8

_KEYS = ("block", "pos")


class Index:
    """A block's vectors by dimension, largest dimensions first.

    A vector stands in the list of a dimension only while the norm of its components from there on is
    ``least`` or more: what a query of norm x scores on the rest is below x * ``least``. ``depth`` is the number
    of dimensions it stands in, and vectors are sorted by it, so that each list is a prefix of the rows.
    """

    def __init__(self, of: Block, least: float) -> None:
        self.order = np.argsort(-(of.m * of.m).sum(0), kind="stable")
        rest = _rest(of.m[:, self.order])
        depth = (rest[:, :-1] >= least).sum(1)
        self.rows = np.argsort(-depth, kind="stable")
        self.rest, self.depth = rest[self.rows], depth[self.rows]
        m = of.m[:, self.order][self.rows]
        self.listed = np.where(np.arange(m.shape[1]) < self.depth[:, None], m, 0.0)

    def only(self, at: np.ndarray) -> None:
        self.rows, self.rest, self.depth, self.listed = (x[at] for x in (self.rows, self.rest, self.depth, self.listed))


def _rest(m: np.ndarray) -> np.ndarray:
    """Norm of each row's components from every dimension on; the last column is 0."""
    with np.errstate(over="ignore"):
        squares = np.cumsum((m * m)[:, ::-1], 1)[:, ::-1]
    return np.concatenate([np.sqrt(squares), np.zeros((len(m), 1))], 1)


def at_least(query: Block, of: Block, bound: np.ndarray, may: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of ``query``, row of ``of``, score) of the pairs in ``may`` that score ``bound`` or more.

    Partial scores are accumulated a few dimensions at a time. A pair goes once its partial score and
    the product of the norms of what is left are below the bound; the others are scored exactly.
    """
    with np.errstate(divide="ignore", invalid="ignore", over="ignore"):
        least = np.nan_to_num(bound / query.norms, nan=0.0, posinf=0.0, neginf=0.0)
        index = Index(of, max(float(least.min()), 0.0))
        x, alive = query.m[:, index.order], may[:, index.rows]
        x_rest, partial = _rest(x), np.zeros(alive.shape)
        slack = 1e-9 * query.norms[:, None] * of.norms.max(initial=0) + 1e-6
        wanted = bound[:, None] - slack
        # Comparisons with what overflowed are false, so such a pair stays and is scored exactly.
        alive &= ~(x_rest[:, [0]] * index.rest[:, 0] < wanted)
        for i in range(0, x.shape[1], STEP):
            some = alive.any(0)
            if 2 * some.sum() < len(some):
                index.only(some)
                alive, partial = alive[:, some], partial[:, some]
            there = int(np.searchsorted(-index.depth, -i, side="left"))
            if not there:
                break
            j = min(i + STEP, x.shape[1])
            partial[:, :there] += x[:, i:j] @ index.listed[:there, i:j].T
            # Beyond its lists, nothing of a vector is accumulated.
            seen = np.minimum(index.depth[:there], j)
            most = partial[:, :there] + x_rest[:, seen] * index.rest[np.arange(there), seen]
            alive[:, :there] &= ~(most < wanted)
    a, b = np.nonzero(alive)
    b = index.rows[b]
    score = scores(query, of)[a, b] if 8 * len(a) > may.size else pair_scores(query, of, a, b)
    enough = score >= bound[a]
    return a[enough], b[enough], score[enough]


# ---------------------------------------------------------------- rounds


def _asked(blocks: DataFrame, state: DataFrame, *columns: str) -> DataFrame:
    bound = F.element_at("ladder", F.col("step") + 1).alias("bound")
    rows = F.sort_array(F.collect_list(F.struct("pos", bound, *columns)))
    return blocks.join(state.groupBy("block").agg(rows.alias("state")), "block")


def _filled(
    candidates: DataFrame, blocks: DataFrame, counts: tuple[int, int], state: DataFrame, compare: Callable, k: int, *columns: str
) -> DataFrame:
    """(block, pos, slot, place, id, score): the first ``k`` rows of each slot.

    ``state`` is (block, pos, slots, ladder). All rows of a score at or above the threshold are seen in a round,
    so a slot that gets ``k`` of them is filled. Rows with another slot go on with the next threshold
    of their ladder, the last of which lets through whatever may fill a slot.
    """
    state, done = state.withColumn("step", F.lit(0)), []
    schema = "block long, pos long, slot long, id long, score long"
    place = F.row_number().over(Window.partitionBy(*_KEYS, "slot").orderBy(F.desc("score"), "id"))
    while True:
        met = meet(candidates, _asked(blocks, state, *columns), counts, compare, schema)
        found = written(met.withColumn("place", place).filter(F.col("place") <= k), "found")
        full = found.filter(F.col("place") == k).groupBy(*_KEYS).agg(F.count("*").alias("full"))
        judged = state.join(full, list(_KEYS), "left").withColumn(
            "over", (F.coalesce("full", F.lit(0).cast("long")) >= F.col("slots")) | (F.col("step") + 1 >= F.size("ladder"))
        )
        judged = written(judged.drop("full"), "round")
        done.append(found.join(judged.filter("over").select(*_KEYS), list(_KEYS), "left_semi"))
        state = judged.filter(~F.col("over")).drop("over").withColumn("step", F.col("step") + 1)
        if state.isEmpty():
            break
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    return out


def _columns(state: list[dict], *names: str) -> list[np.ndarray]:
    return [np.array([s[c] for s in state], np.int64) for c in names]


def _first_thresholds(blocks: DataFrame, sample: list, rows: int, k: int) -> DataFrame:
    """(block, pos, slots, ladder): thresholds that fewer and fewer rows of an anchor's label should reach.

    They are scores of a bounded sample's rows, the first one that about twice ``k`` of all should reach.
    """
    ours = blocks.sparkSession.sparkContext.broadcast(sample)
    first = max(round(2 * k * len(sample) / max(rows, 1)), 1)

    def each(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                b = Block(batch.slice(i, 1).to_pylist()[0])
                same = [r for r in ours.value if len(r[2]) == b.m.shape[1]]
                there = np.array([r[2] for r in same]).reshape(len(same), b.m.shape[1])
                label, ids = np.array([r[1] for r in same], np.int64), np.array([r[0] for r in same], np.int64)
                with np.errstate(over="ignore", invalid="ignore"):
                    score = np.nan_to_num(b.m @ there.T, nan=-float(LIMIT))
                ladders = []
                for j in range(len(b.ids)):
                    own = np.sort(score[j][(label == b.labels[j]) & (ids != b.ids[j])])[::-1]
                    at = [a for a in (first * 4**x - 1 for x in range(8)) if a < len(own)]
                    ladders.append([*(int(min(max(own[a], -LIMIT), LIMIT)) for a in at), -LIMIT])
                n = len(b.ids)
                yield pa.RecordBatch.from_arrays(
                    [
                        *(pa.array(c, pa.int64()) for c in (np.full(n, b.name), np.arange(n), np.ones(n, np.int64))),
                        pa.array(ladders, pa.list_(pa.int64())),
                    ],
                    [*_KEYS, "slots", "ladder"],
                )

    return blocks.mapInArrow(each, "block long, pos long, slots long, ladder array<long>")


def hard_negatives(
    vectors: DataFrame,
    anchors: Column,
    *,
    positives: int = 5,
    negatives: int = 5,
    low: int = 80,
    high: int = 100,
    scale: float = 256.0,
    id_col: str = "vec_id",
    label_col: str = "label",
    vector_col: str = "embedding",
    block_rows: int = 2048,
    anchor_rows: int = 512,
    sample: int = SAMPLE,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    A row's score is its inner product with the anchor, each component being floor(``scale`` * x); higher scores
    come first, ties by smaller id, and scores beyond ``LIMIT`` count as it. Anchors are the rows for which
    ``anchors`` is true. Their positives are the first ``positives`` rows of the same label; for each
    positive the first ``negatives`` rows of another label are returned whose score is at least ``low`` and at
    most ``high`` per cent of the positive's. Pairs without such a row are not returned.

    Positives and negatives are found by joins with a threshold per anchor (``at_least``), which is lowered
    until the positives, or the windows of all positives, are full. A bounded sample of ``sample`` rows
    suggests the first thresholds; every row is searched, in blocks, whatever its label.

    Rows with a null id or label, a null vector, or a null or non-finite component take no part; vectors
    score only with those of their own length, empty ones score 0. Repeated rows count each for itself, but rows
    with an anchor's own id are not its positives or negatives. Ids and labels are integers. Other
    columns are not read, whatever their names, but by ``anchors``.
    """
    spark = vectors.sparkSession
    rows = vectors.select(
        F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"), F.col(vector_col).alias("v"), anchors.alias("asks")
    ).filter(F.col("id").isNotNull() & F.col("label").isNotNull() & usable("v"))
    candidates = stored_blocks(rows.drop("asks"), "candidates", scale=scale, rows=block_rows)
    blocks = stored_blocks(rows.filter("asks").drop("asks"), "anchors", scale=scale, rows=anchor_rows)
    counts = (candidates.count(), blocks.count())
    if not all(counts):
        return spark.createDataFrame(
            [], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
        )

    total = candidates.agg(F.sum(F.length("ids") / 8).cast("long")).first()[0]
    drawn = rows.select("id", "label", F.transform("v", lambda x: x.cast("double")).alias("v")).orderBy(F.xxhash64("id", "label"), "id").limit(sample)
    tried = [(r.id, r.label, np.floor(np.array(r.v) * scale)) for r in drawn.collect()]

    def same_label(of: Block, asked: list[tuple[Block, list[dict]]]) -> Iterator[list[np.ndarray]]:
        for block, state in asked:
            pos, bound = _columns(state, "pos", "bound")
            query = block.rows(pos)
            may = (query.labels[:, None] == of.labels) & (query.ids[:, None] != of.ids)
            a, b, score = at_least(query, of, bound, may)
            best = first_per_row(a, score, of.ids[b], positives)
            a, b, score = a[best], b[best], score[best]
            yield [np.full(len(a), block.name), pos[a], np.zeros(len(a), np.int64), of.ids[b], score]

    ladders = written(_first_thresholds(blocks, tried, total, positives), "thresholds")
    near = written(_filled(candidates, blocks, counts, ladders, same_label, positives), "positives")

    # low * p <= 100 * n <= high * p, in whole numbers.
    wide = F.col("score").cast("decimal(20,0)")
    least, most = F.ceil(wide * low / 100).cast("long"), F.floor(wide * high / 100).cast("long")
    windows = near.select(
        *_KEYS, F.col("place").cast("long").alias("slot"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"),
        least.alias("least"), most.alias("most"),
    )
    open_ = windows.filter(F.col("least") <= F.col("most"))
    first = F.min("most") - F.floor((F.min("most") - F.min("least")) / 4).cast("long")
    wanted = open_.groupBy(*_KEYS).agg(
        F.count("*").alias("slots"),
        F.array(first, F.min("least")).alias("ladder"),
        F.sort_array(F.collect_list(F.struct("slot", "least", "most"))).alias("windows"),
    )
    wanted = written(wanted, "windows")
    if wanted.isEmpty():
        return spark.createDataFrame(
            [], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
        )

    def other_label(of: Block, asked: list[tuple[Block, list[dict]]]) -> Iterator[list[np.ndarray]]:
        for block, state in asked:
            pos, lowest = _columns(state, "pos", "bound")
            query = block.rows(pos)
            may = (query.labels[:, None] != of.labels) & (query.ids[:, None] != of.ids)
            a, b, score = at_least(query, of, lowest, may)
            for i in range(positives):
                window = [s["windows"][i] if i < len(s["windows"]) else {"slot": 0, "least": 1, "most": 0} for s in state]
                slot, least, most = _columns(window, "slot", "least", "most")
                fits = np.flatnonzero((score >= least[a]) & (score <= most[a]))
                fits = fits[first_per_row(a[fits], score[fits], of.ids[b[fits]], negatives)]
                yield [np.full(len(fits), block.name), pos[a[fits]], slot[a[fits]], of.ids[b[fits]], score[fits]]

    hard = _filled(candidates, blocks, counts, wanted, other_label, negatives, "windows")
    anchor = _anchor_ids(blocks.select("block", "ids"))
    joined = hard.join(windows.select(*_KEYS, "slot", "positive_id", "positive_score"), [*_KEYS, "slot"]).join(anchor, list(_KEYS))
    return joined.select(
        "anchor_id", "positive_id", F.col("place").alias("rank"), F.col("id").alias("negative_id"), "positive_score",
        F.col("score").alias("negative_score"),
    )


def _anchor_ids(blocks: DataFrame) -> DataFrame:
    def each(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, ids in zip(batch.column("block").to_pylist(), batch.column("ids").to_pylist(), strict=True):
                n = len(ids) // 8
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, pa.int64()) for c in (np.full(n, name), np.arange(n), np.frombuffer(ids, np.int64))],
                    [*_KEYS, "anchor_id"],
                )

    return blocks.mapInArrow(each, "block long, pos long, anchor_id long")
