from __future__ import annotations

import random
from types import SimpleNamespace

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from isoreach.llm import sentencepiece_scan as scan

MODEL = public_tokenizers.path("piece_bpe_32k.model")
TEXTS = st.one_of(
    st.text(max_size=150),
    st.text(alphabet="ab ", max_size=200),
    st.text(alphabet="the quick brown\n▁0é", max_size=200),
)


@given(TEXTS, st.sampled_from([3, 17, 60]))
@settings(max_examples=150, deadline=None)
def test_scan_equals_the_library(text, size):
    vocab = scan.vocabulary(MODEL)
    assert scan.encode_scanned(vocab, text, size) == vocab.model.encode(text)


def test_products_are_associative():
    draw = np.random.default_rng(0)
    a, b, c = (draw.normal(size=s) for s in ((3, 4), (4, 5), (5, 2)))
    b[1, 2] = -np.inf
    assert np.allclose(scan.product(scan.product(a, b), c), scan.product(a, scan.product(b, c)))


def test_unigram_scores():
    """With scores that sum up, the scan finds the best path over the whole text."""
    draw = random.Random(4)
    score = {c: draw.uniform(-6, -4) for c in "abcd" + scan.BLANK}
    score |= {"".join(draw.choice("abcd") for _ in range(draw.randint(2, 4))): draw.uniform(-9, -5) for _ in range(60)}
    ids = {p: i for i, p in enumerate(score)}
    vocab = scan.Vocabulary(SimpleNamespace(), score, ids, [], 999, False, max(map(len, score)))
    for _ in range(30):
        text = "".join(draw.choice("abcd") for _ in range(draw.randint(1, 90)))
        whole, best = scan.BLANK + text, [0.0]
        for end in range(1, len(whole) + 1):
            best.append(max(best[b] + score[whole[b:end]] for b in range(max(0, end - vocab.longest), end) if whole[b:end] in score))
        names = list(score)
        for size in (5, 20, 200):
            pieces = [names[i] for i in scan.encode_scanned(vocab, text, size)]
            assert "".join(pieces) == whole
            assert sum(score[p] for p in pieces) == pytest.approx(best[-1])


def test_table(spark):
    blob = "".join(random.Random(1).choice("abcdefgh") for _ in range(700))
    rows = [(1, "hello world"), (2, None), (3, ""), (4, "word and more words " * 60), (5, blob), (None, "x " * 300), (1, "hello world")]
    docs = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, ids string")
    tokens = scan.encode(docs, MODEL, chunk=100)
    library = scan.vocabulary(MODEL).model
    got = sorted(((r.doc_id, r.ids) for r in tokens.collect()), key=str)
    assert got == sorted(((i, library.encode(t or "")) for i, t in rows), key=str)
    texts = sorted(((r.doc_id, r.text) for r in scan.decode(tokens, MODEL).collect()), key=str)
    assert texts == sorted(((i, t or "") for i, t in rows), key=str)
    some = spark.createDataFrame([(1, None), (2, []), (3, library.encode("a b"))], "doc_id long, ids array<int>")
    assert sorted((r.doc_id, r.text) for r in scan.decode(some, MODEL).collect()) == [(1, None), (2, ""), (3, "a b")]


def test_empty_table(spark):
    assert scan.encode(spark.createDataFrame([], "doc_id long, text string"), MODEL).count() == 0


@pytest.mark.parametrize(
    ("rule", "what"),
    [(b"\x1a\x02\x20\x01", "removes extra spaces"), (b"\x1a\x02\x18\x00", "adds no blank"), (b"\x1a\x03\x12\x01x", "maps characters"), (b"\x12\x03\xc0\x01\x01", "end of words")],
)
def test_models_that_change_texts_are_refused(tmp_path, rule, what):
    """Fields that are repeated count by their last value, so a rule at the end of the file sets it."""
    import public_tokenizers

    from isoreach.llm import sentencepiece_scan as scan

    public = public_tokenizers.path("piece_bpe_32k.model")
    assert scan.changes_texts(public) is None
    path = tmp_path / "other.model"
    with open(public, "rb") as file:
        path.write_bytes(file.read() + rule)
    assert what in scan.changes_texts(str(path))
    with pytest.raises(ValueError, match=what):
        scan.vocabulary(str(path))
