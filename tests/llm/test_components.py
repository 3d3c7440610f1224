from __future__ import annotations

import numpy as np
import pytest

from isoreach.llm.components import connected_components, local_forest


def brute(edges):
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and b is not None and a != b:
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
    return {x: find(x) for x in parent}


@pytest.mark.parametrize("seed", range(3))
def test_random_graphs(spark, seed):
    draw = np.random.default_rng(seed)
    edges = [tuple(map(int, e)) for e in draw.integers(0, 60, (45, 2))] + [(5, 5), (7, 3), (7, 3)]
    edges += [(i, i + 1) for i in range(100, 130)] + [(200, i) for i in range(201, 240)]
    df = spark.createDataFrame([*edges, (None, 4), (3, None)], "a long, b long")
    found = {r.node: r.component for r in connected_components(df).collect()}
    assert found == brute(edges)


def test_no_edges(spark):
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_local_forest_joins_what_is_linked():
    draw = np.random.default_rng(1)
    nodes = draw.permutation(200)[:80]
    a, b = draw.integers(0, 80, (2, 60))
    child, root = local_forest(a, b, nodes)
    assert len(child) < 80
    wanted = brute([(int(nodes[i]), int(nodes[j])) for i, j in zip(a, b, strict=True)])
    assert brute(list(zip(child.tolist(), root.tolist(), strict=True))) == wanted
