"""Toxicity by a bag of subword vectors under a linear softmax."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from isoreach.llm.labelled import remainder, training_rows
from isoreach.llm.word_features import Words, cut_at_words, slices, subwords

_CHUNK_BYTES = 1 << 18
#: Of texts that are taken together. What a text takes in numpy is many times its bytes.
_TOGETHER_BYTES = 1 << 16


@dataclass(frozen=True)
class ToxicityParams:
    """``rows`` bounds the sample per label, ``max_bytes`` the texts in it; neither bounds what is scored."""

    buckets: int = 1 << 18
    dimension: int = 8
    shortest: int = 3
    longest: int = 6
    window: int = 3
    rows: int = 4096
    max_bytes: int = 1 << 15
    total_bytes: int = 48 << 20
    steps: int = 700
    batch: int = 24
    rate: float = 1.0
    steady: float = 1e-2
    seed: int = 7


def _windows(words: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Number of the window that each word lies in, and the text of each window."""
    if not len(words.start):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    opens = np.concatenate([[True], (words.text[1:] != words.text[:-1]) | (words.place[1:] % size == 0)])
    return np.cumsum(opens) - 1, words.text[opens]


@dataclass
class ToxicityModel:
    """The softmax of two classes is the logistic of ``bias`` and the mean of ``weight`` over a window's n-grams."""

    params: ToxicityParams
    weight: np.ndarray
    bias: float

    def score(self, texts: list[bytes | None]) -> np.ndarray:
        """Chance of label 1 of each text: that of its worst window; the bias alone for no words.

        Texts are taken together up to some bytes, and longer ones in parts of whole windows.
        """
        p, most = self.params, np.full(len(texts), -np.inf)
        for span in slices([len(t or b"") for t in texts], _TOGETHER_BYTES):
            whole = texts[span]
            if len(whole) > 1:
                np.maximum(most[span], self._worst(whole), out=most[span])
                continue
            for part in cut_at_words(whole[0] or b"", p.window, _CHUNK_BYTES):
                np.maximum(most[span], self._worst([part]), out=most[span])
        scores = np.where(np.isfinite(most), most, 0.0) + self.bias
        return 1 / (1 + np.exp(-np.clip(scores, -60, 60)))

    def _worst(self, texts: list[bytes | None]) -> np.ndarray:
        """The highest mean of a window in each text, minus infinity without words."""
        p, words = self.params, Words.of(texts)
        window, text = _windows(words, p.window)
        own, cells = subwords(words, p.shortest, p.longest, p.buckets)
        total = np.bincount(window[own], self.weight[cells], len(text))
        mean = total / np.maximum(np.bincount(window[own], minlength=len(text)), 1)
        worst = np.full(words.n_texts, -np.inf)
        np.maximum.at(worst, text, mean)
        return worst


def train(rows: list[tuple[bytes, int]], params: ToxicityParams) -> ToxicityModel:
    """Fits vectors and softmax together by AdaGrad on batches of as many texts of either label.

    A text answers with the window that the present model finds worst. Without rows of both labels the model says that all are alike.
    """
    p, draw = params, np.random.default_rng(params.seed)
    labels = np.array([y for _, y in rows])
    classes = [np.flatnonzero(labels == y) for y in (0, 1)]
    vectors = draw.normal(0, 0.1, (p.buckets, p.dimension)).astype(np.float32)
    output = draw.normal(0, 0.3, (p.dimension, 2)).astype(np.float32)
    bias, sums = np.zeros(2, np.float32), np.full(p.buckets, p.steady, np.float32)
    output_sums, bias_sums = np.full_like(output, 1e-6), np.full_like(bias, 1e-6)
    if not all(map(len, classes)):
        return ToxicityModel(p, np.zeros(p.buckets, np.float32), 0.0 if not len(labels) else (6.0 if labels[0] else -6.0))
    for step in range(p.steps):
        rate = p.rate * (1 - step / p.steps)
        picked = np.concatenate([draw.choice(c, p.batch) for c in classes])
        words = Words.of([rows[i][0] for i in picked])
        window, text = _windows(words, p.window)
        if not len(text):
            continue
        own, cells = subwords(words, p.shortest, p.longest, p.buckets)
        at = window[own]
        counts = np.maximum(np.bincount(at, minlength=len(text)), 1)
        margin = vectors @ (output[:, 1] - output[:, 0])
        mean = np.bincount(at, margin[cells], len(text)) / counts
        # Of each text the worst window: clean texts teach most by what looks toxic in them.
        worst = np.lexsort((mean, text))
        used = np.sort(worst[np.concatenate([text[worst][1:] != text[worst][:-1], [True]])])
        number = np.full(len(text), -1)
        number[used] = np.arange(len(used))
        kept = number[at] >= 0
        row, cell = number[at[kept]], cells[kept]
        hidden = np.stack([np.bincount(row, vectors[cell, k], len(used)) for k in range(p.dimension)], 1)
        hidden = (hidden / counts[used][:, None]).astype(np.float32)
        logits = hidden @ output + bias
        chances = np.exp(logits - logits.max(1, keepdims=True))
        chances /= chances.sum(1, keepdims=True)
        truth = labels[picked[text[used]]]
        error = chances.astype(np.float32)
        error[np.arange(len(used)), truth] -= 1
        # A batch's clean windows weigh together as much as its toxic ones.
        error /= np.bincount(truth, minlength=2)[truth][:, None] / 8
        back = (error @ output.T) / counts[used][:, None]
        grad_output, grad_bias = hidden.T @ error, error.sum(0)
        cell_of, inverse = np.unique(cell, return_inverse=True)
        grad = np.stack([np.bincount(inverse, back[row, k], len(cell_of)) for k in range(p.dimension)], 1)
        sums[cell_of] += (grad**2).mean(1)
        vectors[cell_of] -= (rate * grad / np.sqrt(sums[cell_of])[:, None]).astype(np.float32)
        output_sums += grad_output**2
        bias_sums += grad_bias**2
        output -= 0.3 * rate * grad_output / np.sqrt(output_sums)
        bias -= 0.3 * rate * grad_bias / np.sqrt(bias_sums)
    weight = (vectors @ (output[:, 1] - output[:, 0])).astype(np.float32)
    return ToxicityModel(p, weight, float(bias[1] - bias[0]))


def fit(docs: DataFrame, labels: DataFrame, params: ToxicityParams = ToxicityParams(), *, folds: int = 5) -> ToxicityModel:
    """The model of the labelled rows whose crc32 of the id leaves a remainder other than 0."""
    rows = training_rows(
        docs,
        labels,
        "toxic",
        remainder("doc_id", folds) != 0,
        rows=params.rows,
        per_class=True,
        max_bytes=params.max_bytes,
        total_bytes=params.total_bytes,
    )
    return train(rows, params)


def score_texts(docs: DataFrame, model: ToxicityModel, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score) of every row's whole text, in one pass; the model is a table of fixed size.

    A null text is an empty one. Null ids, repeated rows and other columns play no part.
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
