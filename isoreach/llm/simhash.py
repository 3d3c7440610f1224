"""SimHash fingerprints and all links between them within a Hamming distance."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from isoreach.llm.components import connected_components, local_forest
from isoreach.llm.locators import join_counted, located, place, without_rows
from isoreach.llm.storage import written

BITS = 64

#: Relative cost of a signature that is stored and shuffled, and of a pair that is verified.
SIGNATURE_COST, CANDIDATE_COST = 2.0, 0.02

#: Fingerprints of one signature that a task compares at most; more are split into blocks.
BLOCK = 32768

_STEP = 1 << 18


def fingerprint(text: bytes | None, words: int = 4) -> int:
    """64 majority bits over the hashes of all word shingles, repeats included; 0 without a word.

    Words are runs of bytes other than ASCII white space, lower-cased in A-Z. Fewer words than a
    shingle has make one shingle. The hash is XXH64 with seed 42 of the words joined by one space.
    """
    parts = (text or b"").lower().split()
    if not parts:
        return 0
    joined = b" ".join(parts)
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1)
    starts = np.concatenate([[0], ends[:-1]])
    if len(parts) > words:
        starts, ends = starts[: 1 - words or None], ends[words - 1 :]
    else:
        starts, ends = starts[:1], ends[-1:]
    ones, digest = np.zeros(BITS, np.int64), xxhash.xxh64_digest
    for i in range(0, len(starts), _STEP):
        spans = zip(starts[i : i + _STEP].tolist(), ends[i : i + _STEP].tolist(), strict=True)
        hashes = b"".join([digest(joined[a : b - 1], 42) for a, b in spans])
        bits = np.unpackbits(np.frombuffer(hashes, np.uint8).reshape(-1, 8), axis=1)
        ones += bits.sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(starts)).tobytes(), "big")


def fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", words: int = 4) -> DataFrame:
    """(id, fp) of every row; ``fp`` is the fingerprint as a signed long."""

    def each(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            made = np.array([fingerprint(t, words) for t in rows.column(1).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(made.view(np.int64))], ["id", "fp"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("t"))
    return rows.mapInArrow(each, f"id {kind}, fp long")


# ---------------------------------------------------------------- plan of the probes


@dataclass(frozen=True)
class Part:
    """Bits that belong together, and at how many of them a pair may differ here."""

    bits: tuple[int, ...]
    threshold: int


def bit_counts(fps: DataFrame) -> tuple[int, np.ndarray]:
    """Rows, and for each pair of bits the number of rows that have both, over the whole table."""

    def each(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, rows = np.zeros((BITS, BITS)), 0
        for batch in batches:
            value = batch.column(0).to_numpy().view(np.uint64)
            bits = ((value[:, None] >> np.arange(BITS, dtype=np.uint64)) & np.uint64(1)).astype(np.float32)
            total += bits.T @ bits
            rows += len(value)
        cells = np.concatenate([total.ravel(), [rows]]).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(cells))), pa.array(cells)], ["cell", "n"])

    cells = fps.select("fp").mapInArrow(each, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n"))
    found = np.zeros(BITS * BITS + 1)
    for r in cells.collect():  # at most 64 * 64 + 1 rows
        found[r.cell] = r.n
    return int(found[-1]), found[:-1].reshape(BITS, BITS)


def correlated_groups(rows: int, both: np.ndarray, parts: int) -> list[tuple[int, ...]]:
    """The bits in ``parts`` groups of nearly equal size, correlated bits together."""
    share = np.diag(both) / max(rows, 1)
    spread = np.sqrt(share * (1 - share))
    with np.errstate(divide="ignore", invalid="ignore"):
        tie = np.abs(np.nan_to_num((both / max(rows, 1) - np.outer(share, share)) / np.outer(spread, spread)))
    np.fill_diagonal(tie, 0)
    free, groups = list(range(BITS)), []
    for k in range(parts):
        size = len(free) // (parts - k)
        group = [max(free, key=lambda b: (tie[b, free].sum(), -b))]
        free.remove(group[0])
        while len(group) < size:
            group.append(max(free, key=lambda b: (tie[b, group].sum(), -b)))
            free.remove(group[-1])
        groups.append(tuple(sorted(group)))
    return groups


def _within(share: np.ndarray, most: int) -> np.ndarray:
    """Chance that two fingerprints differ at 0, up to 1, ... of these bits, the bits taken as independent."""
    chance = np.zeros(most + 1)
    chance[0] = 1
    for q in 2 * share * (1 - share):
        chance[1:] = chance[1:] * (1 - q) + chance[:-1] * q
        chance[0] *= 1 - q
    return np.cumsum(chance)


def plan_parts(rows: int, both: np.ndarray, distance: int) -> list[Part]:
    """The cheapest division into parts and thresholds that loses no pair within ``distance``.

    Where thresholds of m parts sum to ``distance - m + 1``, a pair over every threshold differs at more
    than ``distance`` bits. The thresholds of each m come from dynamic programming over the parts on
    the estimated number of signatures and candidates; -1 leaves a part out.
    """
    share, best = np.diag(both) / max(rows, 1), None
    for m in range(2, max(distance, 1) + 2):
        groups, budget = correlated_groups(rows, both, m), distance - m + 1
        table: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
        for group in groups:
            near, ball = _within(share[list(group)], distance), 0
            cost = {-1: 0.0}
            for t in range(distance + 1):
                ball += len(list(combinations(group, t))) if t <= 3 else 10**9
                cost[t] = rows * ball * SIGNATURE_COST + rows * rows * near[t] * CANDIDATE_COST
            step: dict[int, tuple[float, list[int]]] = {}
            for used, (spent, chosen) in table.items():
                for t, own in cost.items():
                    if (at := used + t) not in step or step[at][0] > spent + own:
                        step[at] = (spent + own, [*chosen, t])
            table = step
        spent, chosen = table[budget]
        if best is None or spent < best[0]:
            best = (spent, [Part(g, t) for g, t in zip(groups, chosen, strict=True) if t >= 0])
    return best[1]


# ---------------------------------------------------------------- probe and verify


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def signatures(fps: DataFrame, parts: list[Part]) -> DataFrame:
    """(part, key, fp, node): a row's bits of every part, once as they are and once per flip within the threshold."""
    probes = []
    for i, part in enumerate(parts):
        mask = sum(1 << b for b in part.bits)
        for t in range(part.threshold + 1):
            probes += [(i, mask, sum(1 << b for b in flip)) for flip in combinations(part.bits, t)]
    each = [
        F.struct(F.lit(i).alias("part"), F.lit(_signed(m)).alias("mask"), F.lit(_signed(x)).alias("flip"))
        for i, m, x in probes
    ]
    rows = fps.select("fp", "node", F.explode(F.array(*each)).alias("p"))
    key = F.col("fp").bitwiseAND(F.col("p.mask")).bitwiseXOR(F.col("p.flip"))
    return rows.select(F.col("p.part").alias("part"), key.alias("key"), "fp", "node")


def _in_blocks(rows: DataFrame, block: int) -> DataFrame:
    """Adds ``pair``: signatures of over ``block`` rows are cut into blocks, and every two blocks share a pair.

    The overfull signatures are counted first; where there are none, as usual, nothing is joined.
    """
    overfull = written(rows.groupBy("part", "key").agg(F.count("*").alias("n")).filter(F.col("n") > block), "overfull")
    if overfull.isEmpty():
        return rows.withColumn("pair", F.lit(0).cast("long"))
    blocks = F.ceil(F.col("n") / block).cast("long")
    own = F.pmod(F.xxhash64("fp"), F.col("k"))
    others = F.transform(
        F.sequence(F.lit(0).cast("long"), F.col("k") - 1),
        lambda c: F.least(c, F.col("own")) * F.col("k") + F.greatest(c, F.col("own")),
    )
    joined = rows.join(overfull.select("part", "key", blocks.alias("k")), ["part", "key"], "left")
    dealt = joined.withColumn("k", F.coalesce("k", F.lit(1).cast("long"))).withColumn("own", own)
    return dealt.select("part", "key", "fp", "node", F.explode(others).alias("pair"))


def _runs(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, ...]]:
    """(starts of the groups and the end, fp, node) of whole groups of rows sorted by part, key and pair."""
    held: list[list[np.ndarray]] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        now = [batch.column(i).to_numpy() for i in range(5)]
        changed = np.flatnonzero((now[0][1:] != now[0][:-1]) | (now[1][1:] != now[1][:-1]) | (now[2][1:] != now[2][:-1])) + 1
        if held and any(h[-1] != n[0] for h, n in zip(held[-1][:3], now[:3], strict=True)):
            whole = [np.concatenate(c) for c in zip(*held, strict=True)]
            yield np.array([0, len(whole[0])]), whole[3], whole[4]
            held = []
        if not len(changed):
            held.append(now)
            continue
        last = changed[-1]
        whole = [np.concatenate([*(h[i] for h in held), now[i][:last]]) for i in range(5)]
        shift = sum(len(h[0]) for h in held)
        yield np.concatenate([[0], changed + shift]), whole[3], whole[4]
        held = [[c[last:] for c in now]]
    if held:
        whole = [np.concatenate(c) for c in zip(*held, strict=True)]
        yield np.array([0, len(whole[0])]), whole[3], whole[4]


def group_forest(fp: np.ndarray, node: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Star edges of the links within ``distance`` in one group.

    Small groups compare all pairs at once. Large ones are searched breadth first against what has not
    been reached yet, so that a dense cluster costs little more than its size and holds no pairs.
    """
    if len(fp) <= 1024:
        a, b = np.nonzero(np.triu(np.bitwise_count(fp[:, None] ^ fp[None, :]) <= distance, 1))
        return local_forest(a, b, node) if len(a) else (node[:0], node[:0])
    left, own, root = [], [], []
    rest, names = fp, node
    while len(rest):
        queue, members, (rest, names) = [rest[:1]], [names[:1]], (rest[1:], names[1:])
        while queue and len(rest):
            ahead = queue.pop()
            for value in ahead:
                near = np.bitwise_count(rest ^ value) <= distance
                if near.any():
                    queue.append(rest[near])
                    members.append(names[near])
                    rest, names = rest[~near], names[~near]
        reached = np.concatenate(members)
        if len(reached) > 1:
            left.append(reached[reached != reached.min()])
            root.append(np.full(len(left[-1]), reached.min()))
    return (np.concatenate(left), np.concatenate(root)) if left else (node[:0], node[:0])


def near_links(fps: DataFrame, distance: int, parts: list[Part], block: int = BLOCK) -> DataFrame:
    """(a, b): edges that connect whatever rows of (fp, node) are linked by a chain of steps within ``distance``."""

    def verify(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for starts, fp, node in _runs(batches):
            sizes, edges, fp = np.diff(starts), [], fp.view(np.uint64)
            two = starts[:-1][sizes == 2]
            close = two[np.bitwise_count(fp[two] ^ fp[two + 1]) <= distance]
            edges.append((node[close], node[close + 1]))
            for i in np.flatnonzero(sizes > 2).tolist():
                span = slice(starts[i], starts[i + 1])
                edges.append(group_forest(fp[span], node[span], distance))
            a, b = (np.concatenate(x) for x in zip(*edges, strict=True))
            a, b = a[a != b], b[a != b]
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    rows = _in_blocks(signatures(fps, parts), block).select("part", "key", "pair", "fp", "node")
    dealt = rows.repartition("part", "key", "pair").sortWithinPartitions("part", "key", "pair")
    return dealt.mapInArrow(verify, "a long, b long")


def simhash_components(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    words: int = 4,
    distance: int = 4,
    block: int = BLOCK,
) -> DataFrame:
    """(id, fingerprint, component_id) of every row: near duplicates share a component.

    ``component_id`` is the smallest id that can be reached over links, the row's own included; rows
    whose fingerprints differ at ``distance`` bits or fewer are linked. Equal fingerprints are one node
    from the start, so copies cost nothing further; only chains within a group leave a task.

    A null text is an empty one with fingerprint zero, linked like any other. A row with a null id links
    nothing by itself; it gets the component of the rows with its fingerprint, null if there are none.
    Repeated rows are rows of the result. Ids are integers.
    """
    named = written(fingerprints(docs, id_col=id_col, text_col=text_col, words=words), "fingerprints")
    fps = written(named.groupBy("fp").agg(F.min("id").cast("long").alias("node")), "classes")
    known = fps.filter(F.col("node").isNotNull())
    rows, both = bit_counts(known)
    nodes = known.withColumn("component_id", F.col("node"))
    if rows > 1:
        edges = near_links(known.select("fp", "node"), distance, plan_parts(rows, both, distance), block)
        found = connected_components(edges).withColumnRenamed("component", "found")
        nodes = known.join(found, "node", "left").withColumn("component_id", F.coalesce("found", "node"))
    labels = nodes.select("fp", "component_id")
    return named.join(labels, "fp", "left").select(
        F.col("id").alias(id_col), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id"
    )


def drop_near_copies(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    words: int = 4,
    distance: int = 4,
    block: int = BLOCK,
) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns: exactly one of each group of near copies.

    Groups are those of ``simhash_components``, over fingerprints in place of ids, so rows with a null id belong
    to them as well. The row with the smallest id stays, of several rows with that id the first by file and
    position, and a null id only where the group has no other. A null text is an empty one. Columns
    may have any names. Only ids, places and fingerprints are shuffled, and of the texts those that go.
    """
    there = located(docs)
    file, row = place(there)
    # The place travels in the struct that stands for the id.
    at = F.struct(F.col(id_col).isNull().alias("no_id"), F.col(id_col).alias("id"), file.alias("file"), row.alias("row"))
    plain = there.select(at.alias("at"), F.col(text_col).alias("t"))
    named = written(fingerprints(plain, id_col="at", text_col="t", words=words), "fingerprints")
    fps = written(named.groupBy("fp").agg(F.min("id").alias("least"), F.count("*").alias("n")), "classes")
    nodes = fps.select("fp", F.col("fp").alias("node"))
    rows, both = bit_counts(nodes)
    group = fps.withColumn("group", F.col("fp"))
    if rows > 1:
        edges = near_links(nodes, distance, plan_parts(rows, both, distance), block)
        found = connected_components(edges).select(F.col("node").alias("fp"), "component")
        group = fps.join(found, "fp", "left").withColumn("group", F.coalesce("component", "fp"))
    keep = group.groupBy("group").agg(F.min("least").alias("keep"), F.count("*").alias("members"))
    keep_of = join_counted(group.select("group", "fp", "n"), keep, "group", "members", rows)
    keep_of = written(keep_of.select("fp", "n", "keep.file", "keep.row"), "stays")
    total = keep_of.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    placed = named.select("fp", F.col("id.file").alias("at_file"), F.col("id.row").alias("at_row"))
    judged = join_counted(placed, keep_of, "fp", "n", total)
    gone = judged.filter((F.col("file") != F.col("at_file")) | (F.col("row") != F.col("at_row")))
    return without_rows(there, written(gone.select(F.col("at_file").alias("file"), F.col("at_row").alias("row")), "gone"))
