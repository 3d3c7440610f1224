"""Quality by logistic regression on hashed word n-grams, trained by follow-the-regularised-leader."""

from __future__ import annotations

import os
import re
import tempfile
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from isoreach.llm.labelled import remainder, training_rows
from isoreach.llm.word_features import Words, bucket, slices

_CHUNK_BYTES = 1 << 18
#: Of texts that are taken together. What a text takes in numpy is many times its bytes.
_TOGETHER_BYTES = 1 << 16
_TRAIN_BYTES = 1 << 16
_BLANK = re.compile(rb"[\x20\x09-\x0D]")
_SALT = [np.uint64(0x5851F42D4C957F2D + 2 * i) for i in range(16)]


@dataclass(frozen=True)
class QualityParams:
    """``rows``, ``max_bytes`` of a text and ``total_bytes`` bound the sample that is learned from, not what is scored."""

    buckets: int = 1 << 18
    rows: int = 8192
    max_bytes: int = 1 << 16
    total_bytes: int = 32 << 20
    epochs: int = 3
    alpha: float = 1.0
    beta: float = 1.0
    l1: float = 1e-3
    l2: float = 1e-2
    seed: int = 11


def features(texts: list[bytes | None], buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, bucket, value) of the hashed n-grams, each pair of text and bucket once.

    N-grams are of words (1, 2) and of the words' shapes (1, 2, 3), an n-gram that repeats an earlier one
    of its text standing for its kind of repetition. The values of a kind sum to 1 in each text.
    """
    words = Words.of(texts)
    count = np.maximum(np.bincount(words.text, minlength=words.n_texts), 1)
    own, cells, values = [], [], []

    def add(kind: int, at: np.ndarray, key: np.ndarray) -> None:
        own.append(words.text[at])
        cells.append(bucket(key ^ _SALT[kind], buckets))
        values.append(1 / count[words.text[at]])

    with np.errstate(over="ignore"):
        word, shape = words.hashes(), words.shapes()
        grams = {1: (word, shape)}
        for n in (2, 3):
            w, s = grams[n - 1]
            grams[n] = (w[:-1] * _SALT[n] + word[n - 1 :], s[:-1] * _SALT[n] + shape[n - 1 :])
        for n, (w, s) in grams.items():
            at = np.arange(len(w))
            if n > 1:
                at = at[words.text[: len(w)] == words.text[n - 1 :]]
            if n < 3:
                add(n, at, w[at])
            add(n + 3, at, s[at])
            # The bag of repeated n-grams: how often one of this text comes again, next to itself or later.
            order = np.lexsort((at, w[at], words.text[at]))
            key, text = w[at][order], words.text[at][order]
            again = np.flatnonzero((key[1:] == key[:-1]) & (text[1:] == text[:-1]))
            gap = at[order][again + 1] - at[order][again]
            near = np.minimum(gap, 4).astype(np.uint64)
            if n > 1:
                add(n + 6, at[order][again + 1], near)
            else:
                add(n + 6, at[order][again + 1][gap <= 2], near[gap <= 2])
        # How long a text is, in powers of two.
        size = np.log2(np.bincount(words.text, minlength=words.n_texts) + 1).astype(np.uint64)
    own.append(np.arange(words.n_texts))
    cells.append(bucket(size ^ _SALT[12], buckets))
    values.append(np.full(words.n_texts, 0.2))
    key = np.concatenate(own).astype(np.int64) * buckets + np.concatenate(cells)
    known, inverse = np.unique(key, return_inverse=True)
    value = np.sqrt(np.bincount(inverse, np.concatenate(values), len(known)))
    return known // buckets, (known % buckets).astype(np.int32), value


class _Seen:
    """Hashes met so far, in sorted runs of doubling length."""

    def __init__(self) -> None:
        self.runs: list[np.ndarray] = []

    def holds(self, keys: np.ndarray) -> np.ndarray:
        found = np.zeros(len(keys), bool)
        for run in self.runs:
            at = np.minimum(np.searchsorted(run, keys), len(run) - 1)
            found |= run[at] == keys
        return found

    def add(self, keys: np.ndarray) -> None:
        if len(keys):
            self.runs.append(np.unique(keys))
        while len(self.runs) > 1 and len(self.runs[-2]) <= 2 * len(self.runs[-1]):
            last = self.runs.pop()
            self.runs[-1] = np.union1d(self.runs[-1], last)


def long_features(text: bytes, buckets: int, block: int = _CHUNK_BYTES) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, value) of one text, as ``features`` has them, some ``block`` bytes at a time.

    What is held between blocks is a count per bucket, the last words, and the hashes of the distinct n-grams.
    """
    counts, many, at = np.zeros(buckets), 0, 0
    word = shape = np.zeros(0, np.uint64)
    recent = {n: word for n in (1, 2, 3)}
    seen = {n: _Seen() for n in (2, 3)}

    def add(kind: int, key: np.ndarray) -> None:
        counts[:] += np.bincount(bucket(key ^ _SALT[kind], buckets), minlength=buckets)

    while at < len(text):
        cut = _BLANK.search(text, at + block)
        part, at = text[at : cut.start() if cut else len(text)], cut.start() if cut else len(text)
        words = Words.of([part])
        carried = len(word)
        many += len(words.start)
        word, shape = np.concatenate([word, words.hashes()]), np.concatenate([shape, words.shapes()])
        with np.errstate(over="ignore"):
            w, s = word, shape
            for n in (1, 2, 3):
                if n > 1:
                    w, s = w[:-1] * _SALT[n] + word[n - 1 :], s[:-1] * _SALT[n] + shape[n - 1 :]
                # Those that end in this block.
                first = max(carried - n + 1, 0)
                own = w[first:]
                if n < 3:
                    add(n, own)
                add(n + 3, s[first:])
                both = np.concatenate([recent[n], own])
                order = np.argsort(both, kind="stable")
                again = np.flatnonzero(both[order][1:] == both[order][:-1])
                gap, place = order[again + 1] - order[again], order[again + 1]
                gap, place = gap[place >= len(recent[n])], place[place >= len(recent[n])]
                near = np.minimum(gap, 4).astype(np.uint64)
                if n > 1:
                    new = np.ones(len(both), bool)
                    new[: len(recent[n])] = False
                    new[place] = False
                    later = int(seen[n].holds(both[new]).sum())
                    add(n + 6, np.concatenate([near, np.full(later, 4, np.uint64)]))
                    seen[n].add(both[new])
                else:
                    add(n + 6, near[gap <= 2])
                recent[n] = both[-3:]
        word, shape = word[-2:], shape[-2:]
    size = np.log2(np.array([many + 1])).astype(np.uint64)
    counts /= max(many, 1)
    counts[bucket(size ^ _SALT[12], buckets)] += 0.2
    cells = np.flatnonzero(counts)
    return cells, np.sqrt(counts[cells])


@dataclass
class QualityModel:
    params: QualityParams
    weight: np.ndarray
    bias: float

    def score(self, texts: list[bytes | None]) -> np.ndarray:
        """Chance of label 1 of each text, a sparse dot product; a text without words has its length alone."""
        scores = np.empty(len(texts))
        for span in slices([len(t or b"") for t in texts], _TOGETHER_BYTES):
            if len(texts[span.start] or b"") > _CHUNK_BYTES:
                cell, value = long_features(texts[span.start], self.params.buckets)
                scores[span] = self.weight[cell] @ value + self.bias
                continue
            text, cell, value = features(texts[span], self.params.buckets)
            many = len(range(*span.indices(len(texts))))
            scores[span] = np.bincount(text, self.weight[cell] * value, many) + self.bias
        return 1 / (1 + np.exp(-np.clip(scores, -60, 60)))


def _shuffled_examples(
    rows: list[tuple[bytes, int]], params: QualityParams, draw: np.random.Generator
) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """(cells, values, label) of every text, in a new order each epoch.

    Features take several times the room of their texts, so they wait in a file that has no name: some
    texts' features are made at a time, and one text's are held.
    """
    with tempfile.TemporaryFile() as file:
        ends = [0]
        for span in slices([len(t) for t, _ in rows], _TRAIN_BYTES):
            text, cell, value = features([t for t, _ in rows[span]], params.buckets)
            edges = np.searchsorted(text, np.arange(len(rows[span]) + 1))
            for a, b in zip(edges, edges[1:], strict=False):
                file.write(cell[a:b].tobytes() + value[a:b].astype(np.float32).tobytes())
                ends.append(ends[-1] + 8 * int(b - a))
        file.flush()
        for _ in range(params.epochs):
            for i in draw.permutation(len(rows)).tolist():
                held = os.pread(file.fileno(), ends[i + 1] - ends[i], ends[i])
                yield np.frombuffer(held, np.int32, len(held) // 8), np.frombuffer(held, np.float32, offset=len(held) // 2), rows[i][1]


def train(rows: list[tuple[bytes, int]], params: QualityParams) -> QualityModel:
    """FTRL-proximal: each text in turn moves the sums z and n from which its weights are derived.

    Without rows of both labels the model gives all texts one score.
    """
    p, draw = params, np.random.default_rng(params.seed)
    bias_at = p.buckets
    z, n = np.zeros(p.buckets + 1), np.zeros(p.buckets + 1)

    def weights(at: np.ndarray | slice) -> np.ndarray:
        pull = np.sign(z[at]) * p.l1 - z[at]
        return np.where(np.abs(z[at]) <= p.l1, 0.0, pull / ((p.beta + np.sqrt(n[at])) / p.alpha + p.l2))

    for cell, value, y in _shuffled_examples(rows, p, draw):
        at, x = np.append(cell, bias_at), np.append(value, 1.0)
        w = weights(at)
        g = (1 / (1 + np.exp(-np.clip(w @ x, -60, 60))) - y) * x
        sigma = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / p.alpha
        z[at] += g - sigma * w
        n[at] += g * g
    final = weights(slice(None))
    return QualityModel(p, final[:-1].astype(np.float32), float(final[-1]))


def fit(docs: DataFrame, labels: DataFrame, params: QualityParams = QualityParams(), *, folds: int = 3) -> QualityModel:
    """The model of the labelled rows whose crc32 of the id leaves a remainder other than 1."""
    rows = training_rows(
        docs,
        labels,
        "quality",
        remainder("doc_id", folds) != 1,
        rows=params.rows,
        per_class=False,
        max_bytes=params.max_bytes,
        total_bytes=params.total_bytes,
    )
    return train(rows, params)


def score_texts(docs: DataFrame, model: QualityModel, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score) of every row's whole text, in one pass; the model is a table of fixed size.

    A null text is an empty one. Null ids, repeated rows and other columns play no part. A text of any length
    is taken a quarter of a megabyte at a time.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def each(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            yield pa.RecordBatch.from_arrays(
                [rows.column(0), pa.array(shared.value.score(rows.column(1).to_pylist()), pa.float64())],
                [id_col, "score"],
            )

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(id_col, F.col(text_col).cast("binary").alias("t"))
    return rows.mapInArrow(each, f"`{id_col}` {kind}, score double")
