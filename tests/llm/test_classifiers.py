from __future__ import annotations

import tracemalloc
import zlib

import numpy as np
import pytest

from isoreach.llm import quality, toxicity, word_features
from isoreach.llm.labelled import remainder, training_rows
from isoreach.llm.word_features import Words, cut_at_words, slices, subwords

SF = "/root/testdata/sf0.1"


@pytest.fixture(scope="module")
def tables(spark):
    return tuple(spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))


@pytest.fixture(scope="module")
def models(spark, tables):
    return toxicity.fit(*tables), quality.fit(*tables)


@pytest.mark.parametrize(("which", "label", "folds", "held", "least"), [(0, "toxic", 5, 0, 0.95), (1, "quality", 3, 1, 0.97)])
def test_held_out_accuracy(tables, models, which, label, folds, held, least):
    docs, labels = tables
    score = (toxicity, quality)[which].score_texts(docs, models[which])
    rows = score.join(labels, "doc_id").filter(remainder("doc_id", folds) == held).collect()
    right = [(r.score >= 0.5) == (r[label] == 1) for r in rows]
    assert len(rows) > 50 and np.mean(right) >= least


@pytest.mark.parametrize("which", [0, 1])
def test_odd_rows(spark, models, which):
    rows = [(1, None), (2, ""), (3, "word " * 20000), (None, "!!!"), (4, "\u0000 �"), (4, "\u0000 �")]
    docs = spark.createDataFrame([(*r, 0.3) for r in rows], "doc_id long, text string, score double")
    got = (toxicity, quality)[which].score_texts(docs, models[which]).collect()
    assert sorted((r.doc_id for r in got), key=str) == sorted((i for i, _ in rows), key=str)
    assert all(0 <= r.score <= 1 for r in got)
    by = {r.doc_id: r.score for r in got}
    assert by[1] == by[2]
    assert (toxicity, quality)[which].score_texts(docs.limit(0), models[which]).count() == 0


def test_batches_do_not_matter(models):
    texts = [b"one two", b"", b"idiot here", b"A!! B!! " * 500, None, b"x"]
    for m in models:
        assert np.allclose(m.score(texts), [m.score([t])[0] for t in texts])


def test_long_texts_in_parts(models, monkeypatch):
    text = b"  a fine day you idiot, isn't it\n" * 300 + b"x" * 900 + b" end "
    for words in (1, 3):
        parts = cut_at_words(text, words, 500)
        assert b"".join(parts) == text and len(parts) > 10
        assert all(len(p.split()) % words == 0 for p in parts[:-1])
    assert cut_at_words(b" " * 2000, 3, 500) == [b" " * 2000]
    whole = [m.score([text, b"x"]).tolist() for m in models]
    hashes = Words.of([text]).hashes().tolist()
    monkeypatch.setattr(toxicity, "_CHUNK_BYTES", 500)
    monkeypatch.setattr(word_features, "_BLOCK", 64)
    assert [m.score([text, b"x"]).tolist() for m in models] == whole
    assert Words.of([text]).hashes().tolist() == hashes


def test_one_kind_of_label_only():
    for module, params in ((toxicity, toxicity.ToxicityParams()), (quality, quality.QualityParams())):
        for rows in ([], [(b"a b c", 1)], [(b"", 0)]):
            assert np.isfinite(module.train(rows, params).score([b"a", b""])).all()


def test_training_rows(spark):
    docs = spark.createDataFrame(
        [(1, "a"), (1, "b"), (2, "long" * 9), (3, None), (4, "d"), (5, "e"), (None, "f"), (6, "g")], "doc_id long, text string"
    )
    labels = spark.createDataFrame([(1, 1), (1, 1), (2, 0), (3, 0), (4, 0), (4, 1), (5, None), (None, 1), (6, 1), (77, 1)], "doc_id long, y int")
    keep = remainder("doc_id", 1) == 0
    every = training_rows(docs, labels, "y", keep, rows=9, per_class=True, max_bytes=10)
    assert sorted(every) == [(b"a", 1), (b"g", 1)]
    assert len(training_rows(docs, labels, "y", keep, rows=1, per_class=False, max_bytes=10)) == 1


def test_held_out_rows_are_never_learned(spark):
    ids = list(range(200))
    docs = spark.createDataFrame([(i, str(i)) for i in ids], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in ids], "doc_id long, y int")
    rows = training_rows(docs, labels, "y", remainder("doc_id", 5) != 0, rows=500, per_class=True, max_bytes=10)
    assert {int(t) for t, _ in rows} == {i for i in ids if zlib.crc32(str(i).encode()) % 5 != 0}


def test_words_and_subwords():
    texts = [b"Ab  c\x0bd", b"", None, b"xyz"]
    words = Words.of(texts)
    assert [bytes(words.raw[a:b]) for a, b in zip(words.start, words.end, strict=True)] == [b"Ab", b"c", b"d", b"xyz"]
    assert words.text.tolist() == [0, 0, 0, 3] and words.place.tolist() == [0, 1, 2, 0]
    own, cells = subwords(words, 3, 4, 1 << 16)
    # ab, " ab", "ab ", " ab "; c, " c "; d, " d "; xyz as a word, " xy", "xyz", "yz ", " xyz", "xyz "
    assert np.bincount(own).tolist() == [4, 2, 2, 6]
    again, same = subwords(Words.of([b"XYZ"]), 3, 4, 1 << 16)
    assert sorted(same) == sorted(cells[own == 3])
    assert slices([5, 1, 1, 9, 2], 4) == [slice(0, 1), slice(1, 3), slice(3, 4), slice(4, 5)]


def test_shapes_follow_kinds():
    shape = lambda *w: Words.of([" ".join(w).encode()]).shapes().tolist()
    a, b, c, d = shape("Abc12!!", "Xyzzy7!", "abc", "a!")
    assert a == b and len({a, c, d}) == 3


# ---------------------------------------------------------------- plain Python versions

_M = (1 << 64) - 1


def _mixed(x: int) -> int:
    x = ((x ^ x >> 32) * 0xD6E8FEB86659FD93) & _M
    return x ^ x >> 29


def _hash(word: bytes) -> int:
    base = 0x9E3779B97F4A7C15 | 1
    return _mixed(sum((b + 1) * pow(base, k, 1 << 64) for k, b in enumerate(word)) & _M)


def _lower(word: bytes) -> bytes:
    return bytes(b + 32 if 0x41 <= b <= 0x5A else b for b in word)


def _shape(word: bytes) -> bytes:
    kinds = ["a" if 0x61 <= b <= 0x7A or b >= 0x80 else "A" if 0x41 <= b <= 0x5A else "0" if 0x30 <= b <= 0x39 else chr(b) for b in word]
    return "".join(k for i, k in enumerate(kinds) if not i or kinds[i - 1] != k).encode()


def brute_quality(text: bytes, buckets: int) -> dict[int, float]:
    salt = [0x5851F42D4C957F2D + 2 * i for i in range(16)]
    words = text.split()
    grams = {1: ([_hash(_lower(w)) for w in words], [_hash(_shape(w)) for w in words])}
    for n in (2, 3):
        grams[n] = tuple([(a * salt[n] + b) & _M for a, b in zip(g, one[n - 1 :])] for g, one in zip(grams[n - 1], grams[1]))
    cells: dict[int, float] = {}

    def add(kind: int, key: int, value: float) -> None:
        cell = _mixed(key ^ salt[kind]) & buckets - 1
        cells[cell] = cells.get(cell, 0.0) + value

    for n, (w, s) in grams.items():
        last: dict[int, int] = {}
        for i, (a, b) in enumerate(zip(w, s)):
            if n < 3:
                add(n, a, 1 / len(words))
            add(n + 3, b, 1 / len(words))
            if a in last and (n > 1 or i - last[a] <= 2):
                add(n + 6, min(i - last[a], 4), 1 / len(words))
            last[a] = i
    add(12, int(np.log2(len(words) + 1)), 0.2)
    return {c: v**0.5 for c, v in cells.items()}


def brute_toxic(text: bytes, model) -> float:
    p, words, best = model.params, text.split(), -np.inf
    for i in range(0, len(words), p.window):
        total, n = 0.0, 0
        for word in map(_lower, words[i : i + p.window]):
            keys = [_hash(word)]
            marked = b" " + word + b" "
            for size in range(p.shortest, p.longest + 1):
                for k in range(len(marked) - size + 1):
                    value = 0
                    for b in marked[k : k + size]:
                        value = (value * (0x9E3779B97F4A7C15 | 1) + b + 1) & _M
                    keys.append((value + size) & _M)
            for key in keys:
                total += float(model.weight[_mixed(key) & p.buckets - 1])
                n += 1
        best = max(best, total / n)
    score = (best if words else 0.0) + model.bias
    return 1 / (1 + np.exp(-min(max(score, -60), 60)))


def odd_texts() -> list[bytes]:
    draw = np.random.default_rng(9)
    texts = [b"", b" \n", b"a", b"A a a a b a b a b c c", "Größe 12 Äpfel, 3 Äpfel!!".encode(), b"x" * 50, b"a\x0bb\x0cc\td"]
    for n in (30, 400, 3000):
        texts.append(b" ".join(b"%s%d" % (draw.choice([b"w", b"W", b"", b"x-"]), draw.integers(0, 40)) for _ in range(n)))
    return texts


def test_quality_features_equal_plain_python():
    texts, buckets = odd_texts(), 1 << 16
    text, cell, value = quality.features(texts, buckets)
    for i, t in enumerate(texts):
        want = brute_quality(t, buckets)
        got = dict(zip(cell[text == i].tolist(), value[text == i].tolist(), strict=True))
        assert got.keys() == want.keys() and np.allclose([got[c] for c in want], list(want.values()))
        for block in (1, 40, 700):
            again, values = quality.long_features(t, buckets, block)
            assert again.tolist() == sorted(want) and np.allclose(values, [want[c] for c in sorted(want)])


def test_scores_equal_plain_python(models):
    texts = odd_texts() + [b"you stupid idiot, go away", b"The committee met on Tuesday and approved the budget."]
    assert np.allclose(models[0].score(texts), [brute_toxic(t, models[0]) for t in texts], atol=1e-6)
    p = models[1]
    want = [sum(float(p.weight[c]) * v for c, v in brute_quality(t, p.params.buckets).items()) + p.bias for t in texts]
    assert np.allclose(p.score(texts), 1 / (1 + np.exp(-np.array(want))), atol=1e-6)


@pytest.mark.parametrize("which", [0, 1])
def test_memory_does_not_follow_the_longest_text(models, which):
    """Peak of the arrays held while a text of 4 and one of 16 MB is scored."""
    import tracemalloc

    sentence, peaks = b"The committee met on Tuesday; it approved the budget of 12 million. ", []
    for megabytes in (4, 16):
        text = sentence * (megabytes * (1 << 20) // len(sentence))
        tracemalloc.start()
        models[which].score([text])
        peaks.append(tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
    assert peaks[1] - peaks[0] < (60 << 20)


def test_sample_is_bounded_by_bytes(spark):
    docs = spark.createDataFrame([(i, "x" * 100) for i in range(60)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, y int")
    keep = remainder("doc_id", 1) == 0
    whole = training_rows(docs, labels, "y", keep, rows=60, per_class=False, max_bytes=1000, total_bytes=10_000)
    some = training_rows(docs, labels, "y", keep, rows=60, per_class=False, max_bytes=1000, total_bytes=1050)
    each = training_rows(docs, labels, "y", keep, rows=60, per_class=True, max_bytes=1000, total_bytes=1050)
    assert (len(whole), len(some), [sum(y == v for _, y in each) for v in (0, 1)]) == (60, 10, [5, 5])
    assert training_rows(docs, labels, "y", keep, rows=60, per_class=True, max_bytes=1000, total_bytes=10) == []


def test_sampling_starts_no_python_on_executors(spark, monkeypatch):
    """A list that becomes an RDD is unpacked by Python workers with an environment, and so a pool, of their own."""
    docs = spark.range(60).selectExpr("cast(id as decimal(20, 0)) doc_id", "'x' text")
    labels = spark.range(60).selectExpr("cast(id as decimal(20, 0)) doc_id", "cast(id % 2 as int) y")
    monkeypatch.setattr(type(spark.sparkContext), "parallelize", lambda *_: pytest.fail("a list went to the executors"))
    assert len(training_rows(docs, labels, "y", remainder("doc_id", 1) == 0, rows=60, per_class=True, max_bytes=9)) == 60


def test_training_holds_the_features_of_few_texts():
    """Four times the texts take hardly more memory, since their features wait on disk."""
    draw = np.random.default_rng(5)
    rows = [(b" ".join(b"w%d" % x for x in draw.integers(0, 1 << 30, 600)), i % 2) for i in range(400)]
    params, peaks = quality.QualityParams(buckets=1 << 16, epochs=1), []
    for many in (100, 400):
        tracemalloc.start()
        quality.train(rows[:many], params)
        peaks.append(tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
    assert peaks[1] < 1.2 * peaks[0]
