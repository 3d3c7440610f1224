"""SentencePiece ids of whole texts, giant ones by a max-plus scan over chunks.

A segmentation is a path over the positions of a text; each piece on it scores its weight, and each two
neighbours must be allowed. For a unigram model the weights are the pieces' scores and all
neighbours are allowed. A BPE model merges by rank instead, which no sum of scores expresses; but its
result is the one path of which every two neighbouring pieces are what the model makes of the two
alone. So its weights are zero and forbidden neighbours minus infinity, in the same algebra.

A chunk of a giant text does not know which piece reaches into it. It yields a matrix: for each piece that
may cross its left edge and each that may cross its right edge the best weight of a path between
them. Products of these matrices (max for plus, plus for times) are associative; a forward and a
backward scan over them fix the piece on every edge, and then each chunk traces its own path back.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from isoreach.llm.storage import written
from isoreach.llm.word_features import slices

#: Fixed value: how the pieces write a blank.
BLANK = "▁"

#: Characters per chunk, and length from which on a text is cut into chunks.
CHUNK = 1 << 15

_NEVER = -np.inf

_BLANK_AFTER = re.compile(f"(?<=[^{BLANK}]){BLANK}")

State = tuple[str, int]  # the piece that crosses an edge, and how many characters of it lie beyond


@dataclass
class Vocabulary:
    """Pieces with their scores. ``bpe`` says that they are merged by score instead of summed up."""

    model: object
    score: dict[str, float]
    ids: dict[str, int]
    byte_ids: list[int]
    unknown: int
    bpe: bool
    longest: int

    @functools.cached_property
    def parts_at_blanks(self) -> bool:
        """Whether no piece has a blank after something else, so that words never share one."""
        return not any(BLANK in piece.lstrip(BLANK) for piece in self.score)

    def merged(self, text: str) -> tuple[str, ...]:
        """What BPE makes of a short text: the best-scored neighbours are joined first, the leftmost of equals."""
        parts = list(text)
        while len(parts) > 1:
            best = max(range(len(parts) - 1), key=lambda i: (self.score.get(parts[i] + parts[i + 1], _NEVER), -i))
            if parts[best] + parts[best + 1] not in self.score:
                break
            parts[best : best + 2] = [parts[best] + parts[best + 1]]
        return tuple(parts)

    @functools.cached_property
    def alone(self):
        """Whether a piece stays whole when it is the only text."""
        return functools.lru_cache(1 << 15)(lambda piece: not self.bpe or self.merged(piece) == (piece,))

    @functools.cached_property
    def allowed(self):
        """Whether two pieces may stand side by side."""
        return functools.lru_cache(1 << 16)(lambda a, b: not self.bpe or not a or self.merged(a + b) == (a, b))

    def weight(self, piece: str) -> float:
        if self.bpe:
            return 0.0
        # A character without a piece of its own costs more than any piece, as in the library.
        return self.score.get(piece, min(self.score.values()) - 10.0)

    def candidates(self, text: str, at: int) -> list[str]:
        """Pieces that the text has at a position; a character without one stands for itself."""
        found = [text[at]]
        for n in range(2, min(self.longest, len(text) - at) + 1):
            if (piece := text[at : at + n]) in self.score and self.alone(piece):
                found.append(piece)
        return found

    def ids_of(self, pieces: Iterable[str]) -> list[int]:
        out: list[int] = []
        for p in pieces:
            if p in self.ids:
                out.append(self.ids[p])
            elif self.byte_ids:
                out += [self.byte_ids[b] for b in p.encode()]
            elif not out or out[-1] != self.unknown:
                out.append(self.unknown)  # neighbouring unknown characters are one piece
        return out


def _fields(message: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of the fields of a serialised protocol buffer message, in order."""
    at = 0

    def number() -> int:
        nonlocal at
        value, shift = 0, 0
        while True:
            byte = message[at]
            at += 1
            value |= (byte & 0x7F) << shift
            if byte < 0x80:
                return value
            shift += 7

    while at < len(message):
        field, kind = divmod(number(), 8)
        if kind == 0:
            yield field, number()
            continue
        size = number() if kind == 2 else {1: 8, 5: 4}[kind]
        yield field, message[at : at + size]
        at += size


def changes_texts(path: str) -> str | None:
    """What a model does to a text before it looks for pieces, beside a blank before it and one for each space."""
    rules: dict[int, int | bytes] = {}
    suffix = 0
    with open(path, "rb") as file:
        # The fields of the format. 3 is the normaliser: 2 its table, 3 adds the first blank, 4 removes
        # extra spaces, 5 writes spaces as blanks (all true unless given). 24 of the trainer (2) ends words in blanks.
        for field, value in _fields(file.read()):
            if field == 3:
                rules |= dict(_fields(value))
            elif field == 2:
                suffix = dict(_fields(value)).get(24, suffix)
    does = {
        "maps characters": rules.get(2, b""),
        "adds no blank before a text": not rules.get(3, 1),
        "removes extra spaces": rules.get(4, 1),
        "keeps spaces": not rules.get(5, 1),
        "has blanks at the end of words": suffix,
    }
    return ", ".join(what for what, is_so in does.items() if is_so) or None


@functools.lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    """The vocabulary of a ``.model`` file. Scores of BPE models fall by 1 from piece to piece.

    Chunks of a text are only right for models that look for pieces in the text as it is; others are refused.
    """
    import sentencepiece

    if change := changes_texts(path):
        raise ValueError(f"{path} {change}; only models that take texts as they are can be scanned in chunks")
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    many = range(model.get_piece_size())
    plain = [i for i in many if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
    score = {model.id_to_piece(i): model.get_score(i) for i in plain}
    ranked = sorted((s for s in score.values() if s > -1e8), reverse=True)
    bpe = all(float(s).is_integer() for s in ranked) and len(set(ranked)) == len(ranked)
    return Vocabulary(
        model,
        score,
        {model.id_to_piece(i): i for i in plain},
        [i for i in many if model.is_byte(i)],
        model.unk_id(),
        bpe,
        max(map(len, score)),
    )


# ---------------------------------------------------------------- paths through a piece of text


def _paths(vocab: Vocabulary, text: str, begin: int, end: int, starts: list[tuple[str, int]]):
    """Best weights from each start to each node up to ``end``, all starts at once.

    A node is (piece, position after it). ``starts`` are such nodes, at ``begin`` or beyond; a row of weights has
    one entry per start. Returns {node: (weights, previous node per start)}.
    """
    at: dict[int, dict[str, tuple[np.ndarray, list]]] = {}
    nodes: dict[tuple[str, int], tuple[np.ndarray, list]] = {}
    for s, (piece, position) in enumerate(starts):
        row = np.full(len(starts), _NEVER)
        row[s] = 0.0
        if piece in at.setdefault(position, {}):
            row = np.maximum(row, at[position][piece][0])
        at[position][piece] = nodes[(piece, position)] = (row, [None] * len(starts))
    for position in range(begin, end):
        here = at.pop(position, None)
        if not here:
            continue
        before = list(here.items())
        for piece in vocab.candidates(text, position):
            fits = [(p, row) for p, (row, _) in before if vocab.allowed(p, piece)]
            if not fits:
                continue
            rows = np.stack([row for _, row in fits])
            best = rows.argmax(0)
            row = rows[best, np.arange(len(starts))] + vocab.weight(piece)
            if not np.isfinite(row).any():
                continue
            back = [(fits[b][0], position) for b in best]
            at.setdefault(position + len(piece), {})[piece] = nodes[(piece, position + len(piece))] = (row, back)
    return nodes


def _trace(nodes, start: int, node: tuple[str, int]) -> list[str]:
    pieces = []
    while (previous := nodes[node][1][start]) is not None:
        pieces.append(node[0])
        node = previous
    return pieces[::-1]


def edge_states(vocab: Vocabulary, text: str, at: int) -> list[State]:
    """All pieces that may end at an edge or cross it, as (piece, characters beyond)."""
    if at == 0:
        return [("", 0)]
    if at >= len(text):
        return [(p, 0) for p in _ending(vocab, text, len(text))]
    found = []
    for begin in range(max(0, at - vocab.longest), at):
        for p in vocab.candidates(text, begin):
            if begin + len(p) >= at:
                found.append((p, begin + len(p) - at))
    return found


def _ending(vocab: Vocabulary, text: str, at: int) -> list[str]:
    return [p for b in range(max(0, at - vocab.longest), at) for p in vocab.candidates(text, b) if b + len(p) == at]


@dataclass
class Chunk:
    """Characters ``begin`` to ``end`` of ``text``, which holds as much more on either side as a piece is long.

    ``first`` and ``last`` say that the text itself begins or ends here.
    """

    text: str
    begin: int
    end: int
    first: bool
    last: bool

    def safe(self, vocab: Vocabulary) -> tuple[int, int] | None:
        """First and last place inside where a piece must begin whatever stands around it.

        That is where a blank follows something else, unless the vocabulary has pieces with such a place
        inside. Pieces that reach in from the left end before the first.
        """
        if not vocab.parts_at_blanks:
            return None
        inside = self.text[: self.end]
        first = _BLANK_AFTER.search(inside, min(self.begin + vocab.longest, self.end))
        if first is None:
            return None
        last = len(inside)
        while True:
            last = inside.rindex(BLANK, 0, last)
            if inside[last - 1] != BLANK:
                return first.start(), last

    def states(self, vocab: Vocabulary) -> tuple[list[State], list[State]]:
        left = [("", 0)] if self.first else edge_states(vocab, self.text, self.begin)
        return left, edge_states(vocab, self.text, self.end)

    def matrix(self, vocab: Vocabulary) -> np.ndarray:
        """Best weight of a path from each state of the left edge to each of the right one."""
        left, right = self.states(vocab)
        safe = self.safe(vocab)
        if safe is None:
            nodes = _paths(vocab, self.text, self.begin, self.end, [(p, self.begin + n) for p, n in left])
            columns = [nodes[(p, self.end + n)][0] if (p, self.end + n) in nodes else np.full(len(left), _NEVER) for p, n in right]
            return np.stack(columns, 1)
        a, b = safe
        nodes = _paths(vocab, self.text, self.begin, a, [(p, self.begin + n) for p, n in left])
        into = np.max([w for (_, at), (w, _) in nodes.items() if at == a] or [np.full(len(left), _NEVER)], 0)
        nodes = _paths(vocab, self.text, b, self.end, [("", b)])
        out = np.array([nodes[(p, self.end + n)][0][0] if (p, self.end + n) in nodes else _NEVER for p, n in right])
        return into[:, None] + out[None, :]

    def pieces(self, vocab: Vocabulary, left: State, right: State) -> list[int]:
        """Ids of the pieces that begin here, between given states of both edges."""
        begin, end = (left[0], self.begin + left[1]), (right[0], self.end + right[1])
        safe = self.safe(vocab)
        if safe is None:
            nodes = _paths(vocab, self.text, self.begin, self.end, [begin])
            return vocab.ids_of(_trace(nodes, 0, end) if end != begin else [])
        a, b = safe
        nodes = _paths(vocab, self.text, self.begin, a, [begin])
        best = max((n for n in nodes if n[1] == a), key=lambda n: nodes[n][0][0])
        ids = vocab.ids_of(_trace(nodes, 0, best) if best != begin else [])
        # The library adds one blank before a text, here the one at the safe place.
        middle = vocab.model.encode(self.text[a + 1 : b].replace(BLANK, " ")) if b > a else []
        nodes = _paths(vocab, self.text, b, self.end, [("", b)])
        return ids + middle + vocab.ids_of(_trace(nodes, 0, end))


def chunks_of(vocab: Vocabulary, text: str, size: int) -> list[Chunk]:
    """The text as the pieces see it, a blank before it and for each space, in chunks."""
    whole = BLANK + text.replace(" ", BLANK)
    reach, out = vocab.longest + 1, []
    for a in range(0, len(whole), size):
        b = min(a + size, len(whole))
        low = max(0, a - reach)
        out.append(Chunk(whole[low : b + reach], a - low, b - low, a == 0, b == len(whole)))
    return out


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The max-plus product of two matrices."""
    return (a[:, :, None] + b[None, :, :]).max(1)


def states_on_edges(matrices: list[np.ndarray]) -> list[int]:
    """Number of the state on every edge of the best path, by a forward and a backward scan."""
    ahead = [np.zeros((1, matrices[0].shape[0]))]
    for m in matrices:
        ahead.append(product(ahead[-1], m))
    behind = [np.zeros((matrices[-1].shape[1], 1))]
    for m in reversed(matrices):
        behind.append(product(m, behind[-1]))
    return [int((f[0] + b[:, 0]).argmax()) for f, b in zip(ahead, reversed(behind), strict=True)]


def encode_scanned(vocab: Vocabulary, text: str, size: int = CHUNK) -> list[int]:
    """Ids of a text by the scan, in one process."""
    if not text:
        return []
    parts = chunks_of(vocab, text, size)
    picked = states_on_edges([c.matrix(vocab) for c in parts])
    out: list[int] = []
    for c, a, b in zip(parts, picked, picked[1:], strict=False):
        left, right = c.states(vocab)
        out += c.pieces(vocab, left[a], right[b])
    return out


# ---------------------------------------------------------------- on tables


def encode(
    docs: DataFrame, model: str, *, id_col: str = "doc_id", text_col: str = "text", chunk: int = CHUNK
) -> DataFrame:
    """(id, ids) of every row's whole text, as the library encodes it without begin or end.

    Texts of up to ``chunk`` characters go to the library. Longer ones are cut: chunks are dealt out and
    yield their matrices, which are small; the matrices of one text are multiplied in order in one
    task; and the chunks, now with known edges, are traced back wherever they lie. Only then are a
    text's ids joined up again. A null or empty text has no ids. Null ids and repeated rows are
    rows like others; extra columns are not read. ``model`` is a path that every executor can open; one
    that normalises texts in any way is refused, whatever the texts.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    text = F.coalesce(F.col(text_col), F.lit(""))
    short = docs.filter(F.length(text) <= chunk).select(F.col(id_col).alias("id"), text.cast("binary").alias("t"))
    long = docs.filter(F.length(text) > chunk).select(
        F.monotonically_increasing_id().alias("doc"), F.col(id_col).alias("id"), text.cast("binary").alias("t")
    )

    def whole(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(model)
        for rows in batches:
            texts = rows.column(1).to_pylist()
            for span in slices([len(t) for t in texts], 1 << 20):
                ids = [vocab.model.encode(t.decode("utf-8", "replace")) for t in texts[span]]
                own = rows.column(0).slice(span.start, len(ids))
                yield pa.RecordBatch.from_arrays([own, pa.array(ids, pa.list_(pa.int32()))], ["id", "ids"])

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(model)
        for rows in batches:
            for doc, own, t in zip(*(rows.column(i).to_pylist() for i in range(3)), strict=True):
                parts = chunks_of(vocab, t.decode("utf-8", "replace"), chunk)
                for i in range(0, len(parts), 256):
                    some = parts[i : i + 256]
                    yield pa.RecordBatch.from_pylist(
                        [{"doc": doc, "id": own, "n": i + k, "text": c.text, "a": c.begin, "b": c.end, "first": c.first, "last": c.last} for k, c in enumerate(some)],
                        pa.schema([("doc", pa.int64()), ("id", rows.schema.field(1).type), ("n", pa.int64()), ("text", pa.string()), ("a", pa.int64()), ("b", pa.int64()), ("first", pa.bool_()), ("last", pa.bool_())]),
                    )

    def matrices(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(model)
        for rows in (b.slice(i, 32) for b in batches for i in range(0, b.num_rows, 32)):
            for r in rows.to_pylist():
                m = Chunk(r["text"], r["a"], r["b"], r["first"], r["last"]).matrix(vocab)
                yield pa.RecordBatch.from_pylist(
                    [{"doc": r["doc"], "n": r["n"], "high": m.shape[0], "wide": m.shape[1], "m": m.tobytes()}]
                )

    def scan(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("n")
        own = [np.frombuffer(m).reshape(h, w) for m, h, w in zip(frame["m"], frame["high"], frame["wide"], strict=True)]
        picked = states_on_edges(own)
        return pd.DataFrame({"doc": frame["doc"], "n": frame["n"], "l": picked[:-1], "r": picked[1:]})

    def trace(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(model)
        for rows in (b.slice(i, 32) for b in batches for i in range(0, b.num_rows, 32)):
            out = []
            for r in rows.to_pylist():
                c = Chunk(r["text"], r["a"], r["b"], r["first"], r["last"])
                left, right = c.states(vocab)
                out.append(c.pieces(vocab, left[r["l"]], right[r["r"]]))
            yield pa.RecordBatch.from_arrays(
                [rows.column("doc"), rows.column("id"), rows.column("n"), pa.array(out, pa.list_(pa.int32()))],
                ["doc", "id", "n", "ids"],
            )

    parts = written(
        long.mapInArrow(cut, f"doc long, id {kind}, n long, text string, a long, b long, first boolean, last boolean")
        .repartition("doc", "n"),
        "chunks",
    )
    made = parts.mapInArrow(matrices, "doc long, n long, high long, wide long, m binary")
    edges = made.groupBy("doc").applyInPandas(scan, "doc long, n long, l long, r long")
    traced = parts.join(edges, ["doc", "n"]).mapInArrow(trace, f"doc long, id {kind}, n long, ids array<int>")
    # A text's own ids, in the order of its chunks; it was one row before.
    again = traced.groupBy("doc").agg(F.first("id").alias("id"), F.sort_array(F.collect_list(F.struct("n", "ids"))).alias("p"))
    joined = again.select("id", F.flatten(F.transform("p", lambda x: x["ids"])).alias("ids"))
    encoded = short.mapInArrow(whole, f"id {kind}, ids array<int>").unionByName(joined)
    return encoded.withColumnRenamed("id", id_col)


def decode(tokens: DataFrame, model: str, *, ids_col: str = "ids") -> DataFrame:
    """``tokens`` with one more column ``text``, that which the ids stand for; null ids give a null text."""

    def each(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(model)
        for rows in (b.slice(i, 256) for b in batches for i in range(0, b.num_rows, 256)):
            ids = rows.column(ids_col)
            values, there = ids.flatten().to_numpy().tolist(), ids.is_valid().to_pylist()
            ends = np.cumsum(ids.value_lengths().fill_null(0).to_numpy()).tolist()
            spans = zip([0, *ends], ends, there, strict=False)
            texts = pa.array([vocab.model.decode(values[a:b]) if ok else None for a, b, ok in spans], pa.string())
            yield pa.RecordBatch.from_arrays([*rows.columns, texts], [*rows.schema.names, "text"])

    return tokens.mapInArrow(each, T.StructType([*tokens.schema.fields, T.StructField("text", T.StringType())]))
