"""Runs of words that repeat with a period, found by tiles per octave of periods."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from isoreach.llm.storage import written

#: A run repeats its period so often at least, and has so many words.
REPEATS, LEAST = 4, 6

#: Words of a tile, and how many least periods of an octave a tile has at least.
TILE, WIDE = 1 << 13, 16

#: Words that are solved together, and cells of a comparison that are held at once.
BATCH, _CELLS = 1 << 18, 1 << 20

_STEP = 1 << 20
_BLANK = re.compile(rb"[\x20\x09-\x0D]")

_SPANS = "array<struct<start:long,length:long,period:long>>"


def word_ids(text: bytes | None, known: dict[bytes, int]) -> np.ndarray:
    """A number per word, the same for equal words; ``known`` collects them. Works in steps of a megabyte."""
    text, at, parts = text or b"", 0, []
    while at < len(text):
        cut = _BLANK.search(text, at + _STEP)
        end = cut.start() if cut else len(text)
        parts.append(_numbered(text[at:end].split(), known))
        at = end
    return np.concatenate(parts) if parts else np.zeros(0, np.int32)


def _numbered(words: list[bytes], known: dict[bytes, int]) -> np.ndarray:
    return np.array([known.setdefault(w, len(known)) for w in words], np.int32)


def joined(ids: np.ndarray, known: dict[bytes, int]) -> bytes:
    """The words of ``ids`` with one space between them."""
    names = list(known)
    return b" ".join([names[i] for i in ids.tolist()])


# ---------------------------------------------------------------- one tile


def octaves(words: int) -> list[int]:
    """The least period of every octave that a run of so many words can have."""
    out = [1] if words >= LEAST else []
    while out and 2 * out[-1] * REPEATS <= words:
        out.append(2 * out[-1])
    return out


def core(octave: int) -> int:
    """Words between the boundaries of a tile's cores: any run of the octave covers one of them with its matches.

    A run of period q has at least max(3 q, 6 - q) positions in a row that match the one q words on.
    """
    return max(3 * octave // 2, 3)


def _equal_rows(ids: np.ndarray, a: np.ndarray, b: np.ndarray, width: int, step: int) -> np.ndarray:
    """How many of ``width`` words from ``a`` on, in direction ``step``, equal those from ``b`` on."""
    out = np.empty(len(a), np.int64)
    reach = np.arange(width) * step
    for i in range(0, len(a), max(_CELLS // width, 1)):
        j = slice(i, i + max(_CELLS // width, 1))
        differ = ids[a[j, None] + reach] != ids[b[j, None] + reach]
        out[j] = np.where(differ.any(1), differ.argmax(1), width)
    return out


def joined_spans(q: np.ndarray, s: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Spans [s, e) of the same period as one where they touch or overlap."""
    if not len(q):
        return q, s, e
    order = np.lexsort((s, q))
    q, s, e = q[order], s[order], e[order]
    apart = int(e.max()) + 2
    upto = np.maximum.accumulate(e + q * apart)
    first = np.concatenate([[True], (s + q * apart)[1:] > upto[:-1]])
    starts = np.flatnonzero(first)
    return q[starts], s[starts], np.maximum.reduceat(e, starts)


def octave_matches(ids: np.ndarray, octave: int, most: int, reach: np.ndarray) -> tuple[np.ndarray, ...]:
    """(period, start, end) of spans whose words equal those a period on; periods from ``octave`` up to ``most``.

    The words are cut into cores. For each the Z-values of its two boundaries are wanted: how far the words
    after (before) the boundary equal those a period on. Periods under which a whole core does not
    match are ruled out by a few words of it, the others have their Z-values taken, up to the length of
    a core. ``reach`` gives the furthest end of a smaller period's span that starts at a word or before it:
    where such a span holds the core and its copy, the period is a multiple of the smaller one.
    """
    size, none = core(octave), np.zeros(0, np.int64)
    starts = np.arange(0, len(ids) - size - octave + 1, size)
    if not len(starts):
        return none, none, none
    margin = 2 * octave + size + 1
    # The margins match nothing but themselves, and a comparison ends where it enters one.
    padded = np.concatenate([np.full(margin, -1, ids.dtype), ids, np.full(margin + size, -1, ids.dtype)])
    ts, qs = [], []
    width = min(octave, most + 1 - octave)
    view = np.lib.stride_tricks.sliding_window_view(padded, width)
    for i in range(0, len(starts), max(_CELLS // width, 1)):
        t = starts[i : i + max(_CELLS // width, 1)]
        m, d = np.nonzero(view[margin + octave + t] == padded[margin + t, None])
        t, q = t[m], d + octave
        new = reach[t] < t + size + q
        t, q = t[new], q[new]
        for offset in dict.fromkeys((size - 1, size // 2, 1, size // 4, size - 2, 3 * size // 4)):
            at = margin + t + offset
            same = padded[at] == padded[at + q]
            t, q = t[same], q[same]
        ts.append(t)
        qs.append(q)
    t, q = np.concatenate(ts), np.concatenate(qs)
    whole = _equal_rows(padded, margin + t, margin + t + q, size, 1) == size
    t, q = t[whole], q[whole]
    after = _equal_rows(padded, margin + t + size, margin + t + size + q, size, 1)
    before = _equal_rows(padded, margin + t - 1, margin + t - 1 + q, size, -1)
    return joined_spans(q, t - before, t + size + after)


def matches(ids: np.ndarray, low: int, high: int, lengths: np.ndarray | None = None) -> tuple[np.ndarray, ...]:
    """(period, start, end) of all octaves from ``low`` to ``high``.

    The octaves below ``low`` are solved too, but for ``reach`` alone: without it each multiple of a short
    period would be followed up. With ``lengths`` the words are those of several documents, longest first, with a number of its own
    after each; an octave then leaves out the documents that are too short for it.
    """
    found, reach, octave = [], np.zeros(len(ids) + 1, np.int64), 1
    upto = None if lengths is None else np.cumsum(lengths + 1)
    while octave <= high:
        part, most = ids, 2 * octave - 1
        if lengths is not None:
            fit = np.searchsorted(-lengths, -max(REPEATS * octave, LEAST), side="right")
            part = ids[: upto[fit - 1]] if fit else ids[:0]
        q, s, e = octave_matches(part, octave, most, reach)
        if len(q):
            if octave >= low:
                found.append((q, s, e))
            np.maximum.at(reach, s, e + q)
            np.maximum.accumulate(reach, out=reach)
        octave *= 2
    none = np.zeros(0, np.int64)
    return tuple(np.concatenate(x) for x in zip(*found, strict=True)) if found else (none, none, none)


def tiles(words: int, tile: int = TILE) -> list[tuple[int, int, int, int]]:
    """(least octave, last octave, start, end) of the tiles of a document; one if it has ``tile`` words or fewer.

    The octaves up to a sixteenth of ``tile`` share their tiles, a longer one has tiles of sixteen times its
    least period. Neighbours overlap by what a core at the edge can see: a core before, two cores and two
    periods behind.
    """
    all_octaves = octaves(words)
    if not all_octaves:
        return []
    if words <= tile:
        return [(1, all_octaves[-1], 0, words)]
    out, shared = [], [p for p in all_octaves if WIDE * p <= tile]
    for low, high in [(shared[0], shared[-1])] * bool(shared) + [(p, p) for p in all_octaves if p not in shared]:
        size = max(tile, WIDE * high)
        before, behind = core(high), 3 * core(high) + 2 * high
        out += [(low, high, max(i - before, 0), min(i + size + behind, words)) for i in range(0, words, size)]
    return out


# ---------------------------------------------------------------- documents


def _row_key(n: int) -> int:
    return (TaskContext.get().partitionId() << 36) + n


def _scanned(docs: DataFrame, tile: int) -> DataFrame:
    """A row per document, and one per tile of a document of several tiles, stored.

    ``text`` is the document with one space between words. Documents of one tile are solved at once,
    many together; those of several hand their tiles on.
    """
    kind = docs.schema["id"].dataType

    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = 0
        for batch in batches:
            ids = batch.column("id")
            pending: list[tuple[int, int, np.ndarray, bytes]] = []
            known: dict[bytes, int] = {}
            for i, text in enumerate(batch.column("t")):
                raw = text.as_py() or b""
                if len(raw) < _STEP:
                    parts = raw.split()
                    own, words = _numbered(parts, known), b" ".join(parts)
                else:
                    known = {}
                    own = word_ids(raw, known)
                    words = joined(own, known)
                plan = tiles(len(own), tile)
                key, n = _row_key(n), n + 1
                if len(plan) > 1:
                    yield rows([(key, i, len(own), words, None, None)], ids)
                    for low, high, a, b in plan:
                        yield rows([(key, i, None, None, None, (low, high, a, own[a:b].tobytes()))], ids)
                    known = {}
                    continue
                pending.append((key, i, own, words))
                if sum(len(p[2]) for p in pending) >= BATCH:
                    yield rows(solved(pending), ids)
                    pending, known = [], {}
            if pending:
                yield rows(solved(pending), ids)

    def solved(pending):
        order = sorted(range(len(pending)), key=lambda i: -len(pending[i][2]))
        lengths = np.array([len(pending[i][2]) for i in order])
        first = np.concatenate([[0], np.cumsum(lengths + 1)[:-1]])
        apart = [np.array([-2 - j], np.int32) for j in range(len(order))]
        whole = np.concatenate([x for j, i in enumerate(order) for x in (pending[i][2], apart[j])])
        top = octaves(int(lengths[0]))
        q, s, e = matches(whole, 1, top[-1] if top else 0, lengths)
        owner = np.searchsorted(first, s, side="right") - 1
        inside = e + q <= first[owner] + lengths[owner]
        q, s, e, owner = (x[inside] for x in (q, s, e, owner))
        spans: dict[int, list] = {}
        for j, *span in zip(owner.tolist(), q.tolist(), (s - first[owner]).tolist(), (e - first[owner]).tolist(), strict=True):
            spans.setdefault(order[j], []).append(tuple(span))
        return [(key, i, len(own), words, spans.get(j, []), None) for j, (key, i, own, words) in enumerate(pending)]

    span_type = pa.list_(pa.struct([("q", pa.int64()), ("s", pa.int64()), ("e", pa.int64())]))

    def rows(made, ids):
        key, i, n, words, spans, tile_ = zip(*made, strict=True)
        tile_ = [t or (None,) * 4 for t in tile_]
        return pa.RecordBatch.from_arrays(
            [
                pa.array(key, pa.int64()),
                ids.take(pa.array(i)),
                pa.array(n, pa.int64()),
                pa.array(words, pa.binary()),
                pa.array([None if s is None else [dict(zip("qse", x, strict=True)) for x in s] for s in spans], span_type),
                *(pa.array([t[k] for t in tile_], pa.int64()) for k in range(3)),
                pa.array([t[3] for t in tile_], pa.binary()),
            ],
            ["key", "id", "n", "text", "spans", "low", "high", "first", "words"],
        )

    schema = (
        f"key long, id {kind.simpleString()}, n long, text binary, spans array<struct<q:long,s:long,e:long>>, "
        "low long, high long, first long, words binary"
    )
    return written(docs.mapInArrow(scan, schema), "scanned")


def _solve_tiles(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in range(batch.num_rows):
            key, low, high, first, words = (batch.column(c)[row].as_py() for c in ("key", "low", "high", "first", "words"))
            q, s, e = matches(np.frombuffer(words, np.int32), low, high)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(q), key)), pa.array(q), pa.array(s + first), pa.array(e + first)], ["key", "q", "s", "e"]
            )


def _stitched(spans: DataFrame) -> DataFrame:
    """Spans of one document and period as one where they touch or overlap."""
    of_period = Window.partitionBy("key", "q").orderBy("s", "e")
    before = F.max("e").over(of_period.rowsBetween(Window.unboundedPreceding, -1))
    new = F.when(F.coalesce(F.col("s") <= before, F.lit(False)), 0).otherwise(1)
    island = F.sum("new").over(of_period.rowsBetween(Window.unboundedPreceding, 0))
    numbered = spans.withColumn("new", new).withColumn("island", island)
    return numbered.groupBy("key", "q", "island").agg(F.min("s").alias("s"), F.max("e").alias("e"))


def _collapse(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Leaves out the words that a run repeats."""
    for batch in batches:
        kept = []
        for row in range(batch.num_rows):
            runs, text = batch.column("runs")[row].as_py(), batch.column("text")[row].as_py()
            if runs:
                known: dict[bytes, int] = {}
                ids = word_ids(text, known)
                edge = np.zeros(len(ids) + 1, np.int64)
                for r in runs:
                    edge[r["start"] + r["period"]] += 1
                    edge[r["start"] + r["length"]] -= 1
                text = joined(ids[np.cumsum(edge)[:-1] == 0], known)
            kept.append(text)
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(kept, pa.binary())], batch.schema)


def periodic_runs(docs: DataFrame, *, id_col: str = "doc_id", text_col: str | Column = "text", tile: int = TILE) -> DataFrame:
    """(id, n_words, runs, collapsed) of every row.

    Words are runs of bytes other than ASCII white space, numbered from 0. ``runs`` holds (start, length,
    period), sorted by start and period, of every stretch of words that repeats with that smallest
    period, four times and over six words at least, and is as long as it can be. ``collapsed`` is the text
    without the words that a run holds after its first period, one space between words.

    Documents are cut into tiles for each octave of periods; a tile is solved by itself, into spans in which
    each word equals that a period on. Spans are shuffled by document and period, and stitched; of equal
    stretches the smallest period counts. ``tile`` bounds the words of a tile while periods are
    short, so a long document is spread over tasks; its rows are the only ones that are moved, next to
    the texts of documents with a span.

    A null or empty text has no words, no runs and an empty ``collapsed``. Every row counts for itself, also
    where ids are null or repeated. Columns other than the two are not read, whatever their names. A
    very long text costs a task its bytes, four more per word, and its distinct words; n words cost in the
    order of n log n.
    """
    text = F.col(text_col) if isinstance(text_col, str) else text_col
    scanned = _scanned(docs.select(F.col(id_col).alias("id"), text.cast("binary").alias("t")), tile)
    whole = scanned.filter(F.col("n").isNotNull())
    far = scanned.filter(F.col("n").isNull()).select("key", "low", "high", "first", "words")
    spans = (
        whole.select("key", F.explode("spans").alias("x"))
        .select("key", "x.*")
        .unionByName(far.repartition("key", "low", "first").mapInArrow(_solve_tiles, "key long, q long, s long, e long"))
    )
    length = F.col("e") - F.col("s") + F.col("q")
    long_enough = length >= F.greatest(F.lit(LEAST).cast("long"), REPEATS * F.col("q"))
    runs = (
        _stitched(spans)
        .filter(long_enough)
        .groupBy("key", F.col("s").alias("start"), length.alias("length"))
        .agg(F.min("q").alias("period"))
        .groupBy("key")
        .agg(F.sort_array(F.collect_list(F.struct("start", "period", "length"))).alias("runs"))
        .withColumn("runs", F.transform("runs", lambda r: F.struct(r["start"].alias("start"), r["length"].alias("length"), r["period"].alias("period"))))
    )
    none = F.array().cast(_SPANS)
    # Without a span there is nothing to stitch: such rows are done.
    plain = F.coalesce(F.size("spans") == 0, F.lit(False))
    done = whole.filter(plain).select("id", "n", none.alias("runs"), "text")
    open_ = whole.filter(~plain).select("key", "id", "n", "text").join(runs, "key", "left")
    schema = f"id {dict(whole.dtypes)['id']}, n long, runs {_SPANS}, text binary"
    collapsed = open_.select("id", "n", F.coalesce("runs", none).alias("runs"), "text").mapInArrow(_collapse, schema)
    return done.unionByName(collapsed).select(
        F.col("id").alias(id_col),
        F.col("n").alias("n_words"),
        "runs",
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("collapsed"),
    )
