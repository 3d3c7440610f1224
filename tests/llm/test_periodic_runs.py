from __future__ import annotations

import hashlib
import re
import zlib

import numpy as np
import pytest

from isoreach.llm import periodic_runs as pr
from isoreach.llm.queries import QUERIES

WORD = re.compile("[^\x20\x09-\x0d]+")


def brute(words):
    """Every run as (start, length, period), by looking at every period."""
    n, found = len(words), {}
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j - i + q >= max(6, 4 * q):
                found.setdefault((i, j - i + q), q)
            i = max(j, i) + 1
    return sorted(((s, length, q) for (s, length), q in found.items()), key=lambda r: (r[0], r[2]))


def brute_collapsed(words, runs):
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def random_words(draw, n, letters):
    """Text in which stretches repeat with all kinds of periods, also inside each other."""
    out = draw.integers(0, letters, n).tolist()
    for _ in range(int(draw.integers(0, 6))):
        a, p = int(draw.integers(0, n)), int(draw.integers(1, max(n // 5, 2)))
        for i in range(a + p, min(n, a + p * int(draw.integers(2, 12)))):
            out[i] = out[i - p]
    return [f"w{x}" for x in out]


@pytest.mark.parametrize("tile", [16, 64, 1 << 13])
def test_equals_brute_force(spark, tile):
    draw = np.random.default_rng(tile)
    texts = [random_words(draw, int(draw.integers(1, 700)), int(draw.choice([1, 2, 3, 30, 1000]))) for _ in range(150)]
    texts += [["a"] * 300, ["a", "b"] * 200, (["a"] * 9 + ["b"]) * 30, ["a"] * 5, ["a"] * 6, ["a", "b"] * 4, ["a", "b", "a", "b", "a", "b", "a"]]
    df = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r.doc_id: r for r in pr.periodic_runs(df.repartition(3), tile=tile).collect()}
    assert len(got) == len(texts)
    for i, words in enumerate(texts):
        want = brute(words)
        assert [tuple(r) for r in got[i].runs] == want, (i, len(words))
        assert (got[i].n_words, got[i].collapsed) == (len(words), brute_collapsed(words, want))


def test_tiles_cover_and_bound():
    assert pr.tiles(5, 64) == [] and pr.tiles(64, 64) == [(1, 16, 0, 64)]
    for n in (65, 1000, 50_000):
        by_octave = {}
        for low, high, a, b in pr.tiles(n, 64):
            by_octave.setdefault((low, high), []).append((a, b))
        assert [p for low, high in by_octave for p in pr.octaves(n) if low <= p <= high] == pr.octaves(n)
        for (low, high), spans in by_octave.items():
            assert spans[0][0] == 0 and spans[-1][1] == n
            assert all(b - a <= max(64, 16 * high) + 10 * high + 12 for a, b in spans)
            assert all(x[1] == n or x[1] - y[0] >= 3 * high for x, y in zip(spans, spans[1:], strict=False))


def test_odd_rows(spark):
    rows = [
        (1, None, "k"), (2, "", "k"), (None, " \t\n ", "k"), (None, "x x x x x x", "k"), (3, "x\x0bx\x0cx\rx x x x x", "k"),
        (3, "x x x x x x", "k"), (3, "x x x x x x", "k"),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string, runs string").withColumnRenamed("runs", "key")
    got = sorted(map(tuple, pr.periodic_runs(df).collect()), key=str)
    run = [(0, 6, 1)]
    want = [(1, 0, [], ""), (2, 0, [], ""), (None, 0, [], ""), (None, 6, run, "x"), (3, 7, [], "x x x x x x x x")] + [(3, 6, run, "x")] * 2
    assert [(i, n, [tuple(r) for r in runs], t) for i, n, runs, t in got] == sorted(want, key=str)
    assert not pr.periodic_runs(df.limit(0)).collect()


def test_very_long_text(spark):
    """A million words of one letter, a long period, and one word without an end."""
    draw = np.random.default_rng(5)
    passage = [f"w{x}" for x in draw.integers(0, 5000, 30_000)]
    texts = [["a"] * 1_000_000, ["b", *passage * 4, "c"], ["z" * 3_000_000]]
    df = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r.doc_id: r for r in pr.periodic_runs(df).collect()}
    assert [tuple(r) for r in got[0].runs] == [(0, 1_000_000, 1)] and got[0].collapsed == "a"
    assert [tuple(r) for r in got[1].runs] == [(1, 120_000, 30_000)]
    assert got[1].collapsed == " ".join(["b", *passage, "c"])
    assert not got[2].runs and got[2].collapsed == texts[2][0]


def planted(doc_id, words):
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]


def test_query_equals_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = QUERIES["op11_periodic_runs"](spark, sf).collect()
    assert sorted(r.doc_id for r in got) == sorted(texts)
    some = 0
    for r in got:
        words = planted(r.doc_id, WORD.findall(texts[r.doc_id] or ""))
        runs = brute(words)
        some += bool(runs)
        s, length, q = min(runs, key=lambda x: (-x[1], x[0], x[2])) if runs else (None,) * 3
        text = "".join(f"{a},{b},{c}\n" for a, b, c in runs)
        assert (r.n_runs, r.start, r.length, r.period) == (len(runs), s, length, q)
        assert r.exponent_milli == (length * 1000 // q if runs else None)
        assert r.runs_sha256 == hashlib.sha256(text.encode()).hexdigest()
        assert r.collapsed_sha256 == hashlib.sha256(brute_collapsed(words, runs).encode()).hexdigest()
    assert some > 5
