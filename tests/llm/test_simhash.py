from __future__ import annotations

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from isoreach.llm import simhash as s


def brute_fingerprint(text: bytes, k: int = 4) -> int:
    import re

    words = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), text))
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))]
    hashes = [xxhash.xxh64_intdigest(x, seed=42) for x in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


@given(st.one_of(st.text(max_size=200), st.text(alphabet="aB \n\x0b", max_size=200)))
@settings(max_examples=150, deadline=None)
def test_fingerprint(text):
    assert s.fingerprint(text.encode()) == brute_fingerprint(text.encode())


def test_long_texts_in_steps(monkeypatch):
    text = " ".join(str(i % 97) for i in range(3000)).encode()
    whole = s.fingerprint(text)
    monkeypatch.setattr(s, "_STEP", 100)
    assert s.fingerprint(text) == whole == brute_fingerprint(text)
    assert s.fingerprint(None) == s.fingerprint(b" \n") == 0


def cloud(seed: int, centres: int, each: int, most: int) -> np.ndarray:
    draw = np.random.default_rng(seed)
    found = []
    for c in draw.integers(0, 2**64, centres, dtype=np.uint64):
        for _ in range(each):
            flips = draw.choice(64, draw.integers(0, most + 1), replace=False)
            found.append(c ^ np.bitwise_or.reduce(np.uint64(1) << flips.astype(np.uint64), initial=np.uint64(0)))
    return np.unique(np.array(found, np.uint64))


def brute_components(fps: np.ndarray, ids: list[int], distance: int) -> dict[int, int]:
    label = {i: i for i in ids}
    near = np.bitwise_count(fps[:, None] ^ fps[None, :]) <= distance
    changed = True
    while changed:
        changed = False
        for x in range(len(ids)):
            least = min(label[ids[y]] for y in np.flatnonzero(near[x]))
            if least < label[ids[x]]:
                label[ids[x]], changed = least, True
    return label


@pytest.mark.parametrize("rows", [10, 10**5, 10**9])
@pytest.mark.parametrize("distance", [1, 4])
def test_plan_loses_no_pair(rows, distance):
    draw = np.random.default_rng(rows % 97)
    bits = (draw.random((64, 500)) < draw.uniform(0.2, 0.8, (64, 1))).astype(float)
    parts = s.plan_parts(rows, bits @ bits.T * rows / 500, distance)
    assert len({b for p in parts for b in p.bits}) == sum(len(p.bits) for p in parts)
    for _ in range(2000):
        differ = set(draw.choice(64, draw.integers(0, distance + 1), replace=False).tolist())
        assert any(len(differ & set(p.bits)) <= p.threshold for p in parts)


def test_more_rows_take_wider_parts():
    even = lambda n: np.full((64, 64), n / 4) + np.eye(64) * n / 4
    few, many = s.plan_parts(10**5, even(10**5), 4), s.plan_parts(10**9, even(10**9), 4)
    assert min(len(p.bits) for p in many) > min(len(p.bits) for p in few)
    assert len({p.threshold for p in many}) > 1


@pytest.mark.parametrize("block", [s.BLOCK, 6])
@pytest.mark.parametrize("parts", [None, [s.Part(tuple(range(16 * i, 16 * i + 16)), int(i == 2)) for i in range(4)]])
def test_links(spark, block, parts):
    fps = np.concatenate([cloud(1, 12, 8, 4), cloud(2, 1, 60, 3), cloud(3, 100, 1, 0)])
    fps = np.unique(fps)
    ids = np.random.default_rng(5).permutation(len(fps)).tolist()
    df = spark.createDataFrame(list(zip(fps.view(np.int64).tolist(), ids, strict=True)), "fp long, node long")
    rows, both = s.bit_counts(df)
    assert rows == len(fps)
    from isoreach.llm.components import connected_components

    edges = s.near_links(df, 4, parts or s.plan_parts(rows, both, 4), block)
    found = {i: i for i in ids} | {r.node: r.component for r in connected_components(edges).collect()}
    assert found == brute_components(fps, ids, 4)


def test_dense_groups_are_searched():
    fps = cloud(7, 3, 900, 5)
    nodes = np.arange(len(fps))
    child, root = s.group_forest(fps, nodes, 4)
    label = np.arange(len(fps))
    label[child] = root
    assert label.tolist() == list(brute_components(fps, nodes.tolist(), 4).values())


def test_documents(spark):
    base = " ".join(f"w{i}" for i in range(400))
    rows = [(5, base), (3, base + " more"), (9, base), (7, None), (8, "  "), (11, "A b C d e"), (2, "a B c d E"), (None, base), (None, "alone x"), (5, base)]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, fp int")
    got = sorted((tuple(r) for r in s.simhash_components(docs).collect()), key=str)
    hexes = [f"{brute_fingerprint((t or '').encode()):016x}" for _, t in rows]
    assert bin(int(hexes[0], 16) ^ int(hexes[1], 16)).count("1") <= 4
    component = {base: 3, base + " more": 3, None: 7, "  ": 7, "A b C d e": 2, "a B c d E": 2, "alone x": None}
    assert got == sorted(((i, h, component[t]) for (i, t), h in zip(rows, hexes, strict=True)), key=str)


def test_no_documents(spark):
    assert s.simhash_components(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_one_row_of_a_group_stays(spark, tmp_path):
    """Rows are judged, not ids: repeated and null ids, and a clean text under the id of a near copy."""
    base, other, third = (" ".join(f"{c}{i}" for i in range(300)) for c in "wvu")
    rows = [
        (5, base), (7, base + " a"), (7, "a clean text of its own"), (None, base + " b"), (2, other + " c"), (2, other),
        (None, third), (None, third + " d"), (9, None), (8, ""), (None, " "), (None, "one more of no id"), (5, base), (5, base),
    ]
    draw = np.random.default_rng(4)
    rows += [(100 + i, " ".join(f"w{x}" for x in draw.integers(0, 40, 3))) for i in range(60)]
    fps = [brute_fingerprint((t or "").encode()) for _, t in rows]
    label = list(range(len(rows)))
    for _ in rows:
        before = list(label)
        for a in range(len(rows)):
            for b in range(a):
                if bin(fps[a] ^ fps[b]).count("1") <= 4:
                    label[a] = label[b] = min(label[a], label[b])
        if label == before:
            break
    groups = {}
    for at, own in enumerate(label):
        groups.setdefault(own, []).append((rows[at][0] is None, rows[at][0] or 0, at))
    want = sorted(min(g)[2] for g in groups.values())
    path = f"{tmp_path}/d"
    spark.createDataFrame([(i, t, at) for at, (i, t) in enumerate(rows)], "doc_id long, text string, at long").coalesce(1).write.parquet(path)
    for block in (32768, 4):
        got = s.drop_near_copies(spark.read.parquet(path), block=block)
        assert got.columns == ["doc_id", "text", "at"] and sorted(r.at for r in got.collect()) == want
    assert len(want) < len(rows) - 5
    assert not s.drop_near_copies(spark.read.parquet(path).limit(0)).collect()
