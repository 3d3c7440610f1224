from __future__ import annotations

import hashlib
import re
import zlib

import pytest
from pyspark.sql import functions as F

from isoreach.llm.sharding import shard_by_bytes
from isoreach.llm.simhash import drop_near_copies
from isoreach.llm.streaming_dedup import drop_duplicates, exact_duplicates

ROWS = [(7, "a  b"), (3, "a\tb"), (9, "a b"), (5, " a b"), (1, None), (2, ""), (4, " "), (None, "a b"), (None, "own"), (3, "a b")]
ROWS += [(100 + i, "copy of one text " * 20) for i in range(300)] + [(500 + i, f"text {i}") for i in range(40)]


def docs(spark, rows=ROWS, parts=5):
    return spark.createDataFrame([(*r, "x", 0) for r in rows], "doc_id long, text string, digest string, n int").repartition(parts)


def norm(t):
    return re.sub(r"[\x20\x09-\x0D]+", " ", t or "")


def groups(rows=ROWS):
    out = {}
    for i, t in rows:
        out.setdefault(norm(t), []).append(i)
    return {t: (min((i for i in ids if i is not None), default=None), len(ids)) for t, ids in out.items()}


@pytest.mark.parametrize("options", [{}, {"files_per_batch": 1}, {"digest": lambda t: F.substring(F.sha2(t, 256), 1, 1)}, {"digest": lambda t: F.lit("one")}])
def test_exact_duplicates(spark, options):
    got = exact_duplicates(docs(spark), **options).select("doc_id", "keep_id", "group_size", "text_sha256", "kept").collect()
    want = [(i, *groups()[norm(t)], hashlib.sha256(norm(t).encode()).hexdigest()) for i, t in ROWS]
    assert sorted((tuple(r)[:4] for r in got), key=str) == sorted(want, key=str)
    kept = [r for r in got if r.kept]
    assert len(kept) == len(groups()) and all(r.doc_id == r.keep_id for r in kept)


def test_rows_stay_whole(spark, tmp_path):
    path = str(tmp_path / "docs")
    docs(spark).write.parquet(path)
    for source in (spark.read.parquet(path), docs(spark)):
        left = drop_duplicates(source)
        assert left.columns == source.columns
        assert sorted(((r.doc_id) for r in left.collect()), key=str) == sorted((k for k, _ in groups().values()), key=str)


def test_any_column_names(spark, tmp_path):
    """Names that the operators use for themselves, and the one of Spark's hidden column, keep their values."""
    names = ["doc_id", "text", "_metadata", "at_file", "at_row", "filter_bit", "digest", "file", "id", "n"]
    rows = [(i, t, *[f"{c}{i}" for c in names[2:]]) for i, t in ((1, "a b c d e"), (2, "a  b c d e"), (3, "other words here"), (4, "A b c d e"))]
    path = str(tmp_path / "docs")
    spark.createDataFrame(rows, ", ".join(f"{c} {'long' if c == 'doc_id' else 'string'}" for c in names)).write.parquet(path)
    for source in (spark.read.parquet(path), spark.createDataFrame(rows, names)):
        assert sorted(map(tuple, drop_duplicates(source).collect())) == [rows[0], rows[2], rows[3]]
        assert sorted(map(tuple, drop_near_copies(source).collect())) == [rows[0], rows[2]]
        assert sorted(r.doc_id for r in exact_duplicates(source).collect()) == [1, 2, 3, 4]


def test_very_long_texts(spark):
    long = "word " * 1_500_000
    rows = [(1, long), (2, long + "x"), (3, "  " + long.replace(" ", "\t")), (4, long)]
    got = sorted((r.doc_id, r.keep_id, r.group_size) for r in exact_duplicates(docs(spark, rows)).collect())
    assert got == [(1, 1, 2), (2, 2, 1), (3, 3, 1), (4, 1, 2)]


def test_session_keeps_its_settings(spark):
    from isoreach.llm.streaming_dedup import STATE

    before = [spark.conf.get(name, None) for name in STATE]
    exact_duplicates(docs(spark)).collect()
    assert [spark.conf.get(name, None) for name in STATE] == before


def test_nothing_to_judge(spark):
    assert exact_duplicates(docs(spark, [])).count() == 0
    assert drop_duplicates(docs(spark, [])).count() == 0


@pytest.mark.parametrize("shards", [1, 4, 24])
def test_shards(spark, shards):
    got = shard_by_bytes(docs(spark), shards, carry=("n",)).collect()
    key = lambda r: (r[0] is not None, r[0] or 0, len((r[1] or "").encode()) + 8, zlib.crc32((r[1] or "").encode()))
    ordered = sorted(ROWS, key=key)
    total, upto, want, slots = sum(key(r)[2] for r in ROWS), 0, [], {}
    for r in ordered:
        size = key(r)[2]
        upto += size
        shard = min((upto - (size + 1) // 2) * shards // total, shards - 1)
        slots[shard] = slots.get(shard, -1) + 1
        want.append((r[0], size, key(r)[3], shard, slots[shard], 0))
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    sizes = [sum(w[1] for w in want if w[3] == s) for s in range(shards)]
    assert max(sizes) - min(sizes) <= 2 * max(w[1] for w in want)


def test_shards_use_no_python(spark):
    plan = shard_by_bytes(docs(spark), 4)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_no_shards_of_nothing(spark):
    assert shard_by_bytes(docs(spark, []), 4).count() == 0
