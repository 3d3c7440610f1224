from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from isoreach.llm import vector_blocks as vb
from isoreach.llm.hard_negatives import at_least, hard_negatives
from isoreach.llm.top_k import top_scores

SCHEMA = "vec_id long, embedding array<double>, label int, score string, block int"
NO_PART = [None, [None, 1.0], [math.nan, 1.0], [math.inf, 1.0]]


def whole(v):
    return [math.floor(256 * x) for x in v]


def cut(score):
    return min(max(score, -vb.LIMIT), vb.LIMIT)


def usable(rows, label=False):
    return [
        (i, whole(v), y)
        for i, v, y in rows
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v) and not (label and y is None)
    ]


def ranked(a, rows):
    """(score, id, label) of all rows with another id and as many components, best first."""
    found = [(cut(sum(x * y for x, y in zip(a[1], b[1], strict=True))), b[0], b[2]) for b in rows if b[0] != a[0] and len(a[1]) == len(b[1])]
    return sorted(found, key=lambda r: (-r[0], r[1]))


def brute_top(rows, k, every):
    rows = usable(rows)
    return sorted((a[0], n + 1, i, s) for a in rows if a[0] % every == 0 for n, (s, i, _) in enumerate(ranked(a, rows)[:k]))


def brute_negatives(rows, every, k=5, low=80, high=100):
    rows, out = usable(rows, label=True), []
    for a in rows:
        if a[0] % every:
            continue
        order = ranked(a, rows)
        for p, i, y in [r for r in order if r[2] == a[2]][:k]:
            fits = [(s, j) for s, j, z in order if z != a[2] and low * p <= 100 * s <= high * p]
            out += [(a[0], i, n + 1, j, p, s) for n, (s, j) in enumerate(fits[:k])]
    return sorted(out)


def vectors(seed, n=400, width=12, labels=4):
    """Clusters, ties, repeated rows, other lengths, zero, empty and unusable vectors; a third has one label."""
    draw = np.random.default_rng(seed)
    centres = draw.normal(size=(8, width))
    rows = [(i, (centres[i % 8] + draw.normal(size=width) * 0.6).round(1).tolist(), int(draw.integers(1, labels)) if i % 3 else 0) for i in range(n)]
    rows += [(n + i, rows[3][1], i % 2) for i in range(40)] + [rows[5], rows[5], (5, rows[6][1], 1), (None, rows[0][1], 0)]
    rows += [(2 * n + i, v, 0) for i, v in enumerate(NO_PART)] + [(3 * n, [], 1), (3 * n + 10, [], 2), (3 * n + 20, [0.0] * width, 0)]
    rows += [(4 * n + i, draw.normal(size=5).tolist(), i % 3) for i in range(30)] + [(4 * n + 40, rows[0][1], None)]
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA).repartition(3)


@pytest.mark.parametrize(("blocks", "k"), [((2048, 512), 5), ((50, 7), 5), ((50, 7), 300), ((64, 16), 1)])
def test_top_scores(spark, blocks, k):
    rows = vectors(k)
    got = top_scores(frame(spark, rows), F.col("vec_id") % 10 == 0, k=k, block_rows=blocks[0], query_rows=blocks[1])
    assert sorted(map(tuple, got.collect())) == brute_top(rows, k, 10)


def test_top_scores_beyond_doubles(spark):
    """Scores that no double holds exactly, and some that no long holds."""
    draw = np.random.default_rng(1)
    rows = [(i, (draw.normal(size=3) * 10.0 ** int(draw.integers(0, 8))).tolist(), 0) for i in range(60)]
    rows += [(60 + i, [1e200 * (-1) ** i, 3.0, 1e300], 0) for i in range(4)]
    got = top_scores(frame(spark, rows), F.col("vec_id") % 5 == 0)
    assert sorted(map(tuple, got.collect())) == brute_top(rows, 5, 5)


def test_ties_of_most_rows(spark):
    rows = [(i, [0.5, -0.25], i % 2) for i in range(3000)] + [(3000, [0.6, -0.25], 1)]
    got = top_scores(frame(spark, rows), F.col("vec_id") % 1000 == 0, block_rows=100)
    assert sorted(map(tuple, got.collect())) == brute_top(rows, 5, 1000)
    got = hard_negatives(frame(spark, rows), F.col("vec_id") % 1000 == 0, block_rows=100)
    assert sorted(map(tuple, got.collect())) == brute_negatives(rows, 1000)


@pytest.mark.parametrize("blocks", [(2048, 512), (40, 7)])
@pytest.mark.parametrize("sample", [1024, 20])
def test_hard_negatives(spark, blocks, sample):
    rows = vectors(sample)
    got = hard_negatives(frame(spark, rows), F.col("vec_id") % 10 == 0, block_rows=blocks[0], anchor_rows=blocks[1], sample=sample)
    want = brute_negatives(rows, 10)
    assert want and sorted(map(tuple, got.collect())) == want


def test_hard_negatives_of_odd_scores(spark):
    """Negative and zero scores, scores that no double holds, one label only, nobody of the own label."""
    draw = np.random.default_rng(2)
    for rows in (
        [(i, (draw.normal(size=3) - 1).tolist() if i else [1.0, 1.0, 1.0], i % 2) for i in range(40)],
        [(i, [float(i % 2), 0.0], i % 3) for i in range(30)],
        [(i, (draw.normal(size=3) * 10.0 ** int(draw.integers(5, 9))).tolist(), i % 3) for i in range(60)],
        [(i, [1.0, 0.5], 7) for i in range(20)],
        [(i, [1.0, 0.5], i) for i in range(20)],
        [(1, [1.0], 1)],
        [],
    ):
        got = hard_negatives(frame(spark, rows), F.col("vec_id") % 10 == 0, block_rows=16)
        assert sorted(map(tuple, got.collect())) == brute_negatives(rows, 10)


def test_nothing_usable(spark):
    rows = [(i, v, None) for i, v in enumerate(NO_PART)] + [(None, [1.0], 1)]
    for some in (rows, [], [(1, [1.0], 1)]):
        assert not top_scores(frame(spark, some), F.col("vec_id") % 10 == 0).collect()
    assert not top_scores(frame(spark, [(10, [1.0], 1)]), F.col("vec_id") % 10 == 0).collect()


def test_index_leaves_out_and_loses_nothing():
    """The lists shrink as the threshold grows, and every pair over it is found."""
    draw = np.random.default_rng(3)
    x, y = (np.floor(draw.normal(size=(n, 40)) * 100 * np.linspace(2, 0.1, 40)) for n in (30, 500))
    query, of = (
        vb.Block({"block": 1, "dim": 40, "ids": np.arange(len(m)).tobytes(), "labels": np.zeros(len(m), np.int64).tobytes(), "kind": "<f8", "m": m.tobytes()})
        for m in (x, y)
    )
    exact, listed = (x @ y.T).astype(np.int64), []
    for share in (0.2, 0.5, 0.8):
        bound = (exact.max(1) * share).astype(np.int64)
        a, b, score = at_least(query, of, bound, np.ones(exact.shape, bool))
        wa, wb = np.nonzero(exact >= bound[:, None])
        assert sorted(zip(a, b, score)) == sorted(zip(wa, wb, exact[wa, wb]))
        from isoreach.llm.hard_negatives import Index

        listed.append((Index(of, float((bound / query.norms).min())).listed != 0).sum())
    assert listed[0] > listed[1] > listed[2]


@pytest.mark.parametrize("above", [1, 3, 4])
def test_many_scores_just_below_the_first(spark, above):
    """The last range is narrower than a pass has bins: what lies above it shall not be counted twice."""
    rows = [(0, [1 / 256, 100.0], 0)] + [(100 + i, [0.0, 1.0], 0) for i in range(300)]
    rows += [(1 + i, [(100.0 + 10 * i) / 256, 1.0], 0) for i in range(above)] + [(500 + i, [0.0, 0.5], 0) for i in range(20)]
    got = top_scores(frame(spark, rows), F.col("vec_id") == 0)
    assert sorted(map(tuple, got.collect())) == brute_top(rows, 5, 1000)
