"""Near-duplicate embeddings: inverted lists, product-quantised residuals, exact rerank."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from isoreach.llm.components import connected_components, local_forest
from isoreach.llm.storage import written

#: Distinct vectors of one list that a task holds on either side.
BLOCK = 2048

#: Covers the rounding of distances in single precision.
_SLACK = 1e-3


@dataclass(frozen=True)
class PqParams:
    """``sample`` bounds the vectors that centres and codebooks are fitted on; every vector is indexed.

    ``lists`` is the number of inverted lists, by default twice the root of the number of vectors and 2048 at
    most, ``subspaces`` that of the codes per vector, ``centres`` how many values a code has.

    How far beyond a list's border its neighbours are looked for is measured: at most ``trials`` vectors,
    as many from every list, are compared with all vectors, and ``margin`` times the longest way by which a
    link of theirs crosses a border is taken. Already with a margin of 1, a further vector has a link that
    goes farther with a chance of one in the number of trials with a link. Where fewer than ``proven`` of
    them have one, and with ``margin=None``, every list that can hold a neighbour is probed, and no link is lost whatever the data.
    """

    lists: int | None = None
    subspaces: int = 8
    centres: int = 64
    sample: int = 16384
    rounds: int = 8
    margin: float | None = 1.25
    trials: int = 2048
    proven: int = 30
    seed: int = 3

    def lists_for(self, n: int) -> int:
        return self.lists or int(min(max(2 * n**0.5, 16), 2048))


@dataclass
class Codebook:
    coarse: np.ndarray
    fine: list[np.ndarray]
    cuts: list[int]

    def __post_init__(self) -> None:
        self.apart = np.sqrt(np.maximum(_squared(self.coarse, self.coarse), 1e-12))

    def nearest(self, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(list of each unit vector, squared distances to all coarse centres)."""
        far = _squared(unit, self.coarse)
        return far.argmin(1), far

    def codes(self, residual: np.ndarray) -> np.ndarray:
        spans = zip(self.cuts, self.cuts[1:], strict=False)
        return np.stack(
            [_squared(residual[:, a:b], c).argmin(1) for c, (a, b) in zip(self.fine, spans, strict=True)], 1
        ).astype(np.uint8)

    def decoded(self, codes: np.ndarray) -> np.ndarray:
        return np.concatenate([c[codes[:, i]] for i, c in enumerate(self.fine)], 1)

    def table(self, residual: np.ndarray) -> np.ndarray:
        """Squared distance of each query's residual to each centre, by subspace: (queries, subspaces, centres)."""
        most = max(len(c) for c in self.fine)
        out = np.full((len(residual), len(self.fine), most), np.inf, np.float32)
        for i, (c, a, b) in enumerate(zip(self.fine, self.cuts, self.cuts[1:], strict=False)):
            out[:, i, : len(c)] = _squared(residual[:, a:b], c)
        return out

    def beyond(self, far: np.ndarray, own: np.ndarray) -> np.ndarray:
        """How far each row of list ``own`` lies from the plane between its list's cell and every other one."""
        here = np.arange(len(far))
        out = (far - far[here, own][:, None]) / (2 * self.apart[own])
        out[here, own] = 0
        return out

    def probes(self, unit: np.ndarray, own: np.ndarray, reach: float) -> tuple[np.ndarray, np.ndarray]:
        """(row, list) of the other lists that a row of list ``own`` looks through.

        Two near vectors of different lists lie on either side of the plane between the two cells, and the
        ways of both to it sum up to their distance at most. One of the ways is at most half of that, so
        rows look through the lists whose border is no farther than half of ``reach``: with the radius as
        ``reach`` every such pair meets from at least one side, whatever the data.
        """
        near = self.beyond(_squared(unit, self.coarse), own) <= reach / 2 + _SLACK
        near[np.arange(len(unit)), own] = False
        return np.nonzero(near)


def _squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.maximum((a * a).sum(1)[:, None] - 2 * (a @ b.T) + (b * b).sum(1)[None, :], 0)


def _k_means(data: np.ndarray, k: int, rounds: int, draw: np.random.Generator) -> np.ndarray:
    known = np.unique(data, axis=0)
    if len(known) <= k:
        return known.astype(np.float32)
    centres = known[draw.choice(len(known), k, replace=False)].astype(np.float32)
    for _ in range(rounds):
        near = np.concatenate([_squared(data[i : i + 4096], centres).argmin(1) for i in range(0, len(data), 4096)])
        count = np.bincount(near, minlength=k)
        sums = np.stack([np.bincount(near, data[:, j], k) for j in range(data.shape[1])], 1)
        centres = np.where(count[:, None] > 0, sums / np.maximum(count, 1)[:, None], centres).astype(np.float32)
    return np.unique(centres, axis=0)


def fit(sample: np.ndarray, params: PqParams, lists: int) -> Codebook:
    """Coarse centres of unit vectors, and centres of their residuals in each subspace."""
    draw, width = np.random.default_rng(params.seed), sample.shape[1]
    coarse = _k_means(sample, lists, params.rounds, draw)
    residual = sample - coarse[_squared(sample, coarse).argmin(1)]
    parts = min(params.subspaces, width)
    cuts = [width * i // parts for i in range(parts + 1)]
    fine = [_k_means(residual[:, a:b], params.centres, params.rounds, draw) for a, b in zip(cuts, cuts[1:], strict=False)]
    return Codebook(coarse, fine, cuts)


def _usable(vec: str | Column) -> Column:
    """Whether a vector has a direction: not null or empty, all components finite, not all zero."""
    v = F.col(vec) if isinstance(vec, str) else vec
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(v.isNotNull() & ~bad & F.exists(v, lambda x: x != 0), F.lit(False))


def _matrix(column: pa.Array | pd.Series, width: int) -> np.ndarray:
    """Rows of doubles, shorter ones filled with zeros."""
    out = np.zeros((len(column), width))
    for i, v in enumerate(column):
        v = v.as_py() if isinstance(v, pa.Scalar) else v
        out[i, : len(v)] = v
    return out


def _directions(raw: np.ndarray) -> np.ndarray:
    """Unit vectors; the largest component is divided out first, so that no square overflows or vanishes."""
    scaled = raw / np.abs(raw).max(1, keepdims=True)
    return scaled / np.sqrt((scaled * scaled).sum(1, keepdims=True))


def _pairs_in_block(index: pd.DataFrame, query: pd.DataFrame, book: Codebook, cosine: float, width: int):
    """Links of one block of a list and one of its queries: (query row, index row) of every pair once."""
    radius = np.sqrt(max(2 - 2 * cosine, 0))
    x, y = _matrix(query["v"], width), _matrix(index["v"], width)
    ux, uy = _directions(x), _directions(y)
    centre = book.coarse[index["list"].iloc[0]]
    rx, ry = (ux - centre).astype(np.float32), (uy - centre).astype(np.float32)
    codes = np.stack([np.frombuffer(c, np.uint8) for c in index["codes"]])
    # A vector is no nearer to a query than its decoded form, less what decoding is off by.
    off = np.sqrt(((ry - book.decoded(codes)) ** 2).sum(1))
    reach = (radius + off + _SLACK) ** 2
    nx, ny = query["node"].to_numpy(), index["node"].to_numpy()
    # Rows of one list meet from both sides. Those of two lists may, where the index row asks for the query's
    # list too; then they count in the list whose turn it is.
    here, own = int(index["list"].iloc[0]), query["own"].to_numpy()
    asks = np.zeros((len(index), len(book.coarse)), bool)
    asked = index["asks"]
    asks[np.repeat(np.arange(len(index)), asked.map(len)), np.concatenate(asked.to_list()).astype(int)] = True
    turn = (own < here) == ((own + here) % 2 == 0)
    home = own == here
    dx, dy = query["dim"].to_numpy(), index["dim"].to_numpy()
    rows, cols = [], []
    for i in range(0, len(rx), 64):
        table = book.table(rx[i : i + 64])
        far = np.zeros((len(table), len(codes)), np.float32)
        for m in range(codes.shape[1]):
            far += table[:, m, :][:, codes[:, m]]
        part = slice(i, i + 64)
        once = np.where(home[part, None], nx[part, None] < ny, turn[part, None] | ~asks[:, own[part]].T)
        a, b = np.nonzero((far <= reach) & once & (dx[i : i + 64, None] == dy))
        a += i
        for j in range(0, len(a), 1 << 16):
            c, d = a[j : j + (1 << 16)], b[j : j + (1 << 16)]
            exact = np.einsum("ij,ij->i", ux[c], uy[d]) >= cosine
            rows.append(c[exact])
            cols.append(d[exact])
    none = np.zeros(0, np.int64)
    return (np.concatenate(rows) if rows else none), (np.concatenate(cols) if cols else none)


def _ways(index: DataFrame, book, cosine: float, width: int, params: PqParams, lists: int) -> tuple[int, float]:
    """(trial vectors that have a link, longest sum of both ways to the border that a link of theirs crosses).

    The trials of a list are those of the smallest hashes in equal shares of it. All vectors pass by them
    once; what leaves a task is a row per trial with a link.
    """
    spark = index.sparkSession
    share = F.pmod(F.xxhash64("node"), F.lit(max(params.trials // lists, 1)))
    picked = index.groupBy("list", share.alias("share")).agg(
        F.min_by(F.struct("node", "v"), F.struct(F.xxhash64("node", F.lit(params.seed)), "node")).alias("t")
    )
    rows = picked.select("list", "t.node", "t.v").collect()
    trials = spark.sparkContext.broadcast(
        (
            _directions(_matrix([r.v for r in rows], width)),
            np.array([r.list for r in rows]),
            np.array([r.node for r in rows]),
            np.array([len(r.v) for r in rows]),
        )
    )

    def met(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q, q_own, q_node, q_dim = trials.value
        thin = q.astype(np.float32)
        q_beyond = book.value.beyond(_squared(thin, book.value.coarse), q_own)
        for batch in batches:
            most = np.full(len(q), -1.0)
            for i in range(0, batch.num_rows, 1024):
                part = batch.slice(i, 1024)
                u, own = _directions(_matrix(part.column("v"), width)), part.column("list").to_numpy()
                dim = pc.list_value_length(part.column("v")).to_numpy(zero_copy_only=False)
                near = u.astype(np.float32) @ thin.T >= cosine - _SLACK
                near &= part.column("node").to_numpy()[:, None] != q_node
                a, b = np.nonzero(near & (dim[:, None] == q_dim))
                exact = np.einsum("ij,ij->i", u[a], q[b]) >= cosine
                a, b = a[exact], b[exact]
                mine = book.value.beyond(_squared(u.astype(np.float32), book.value.coarse), own)
                np.maximum.at(most, b, mine[a, q_own[b]] + q_beyond[b, own[a]])
            linked = np.flatnonzero(most >= 0)
            yield pa.RecordBatch.from_arrays([pa.array(linked, pa.int64()), pa.array(most[linked])], ["trial", "way"])

    ways = index.select("list", "node", "v").mapInArrow(met, "trial long, way double").groupBy("trial").agg(F.max("way").alias("way"))
    linked, longest = ways.agg(F.count("*"), F.max("way")).first()
    return linked, longest or 0.0


def near_vectors(
    vectors: DataFrame,
    *,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    cosine: float = 0.95,
    params: PqParams = PqParams(),
    block: int = BLOCK,
) -> DataFrame:
    """(id, n_links, component_id, kept) of every row; rows with a cosine of at least ``cosine`` are linked.

    Equal vectors are one node that counts for all its rows. Nodes are put into the list of the nearest
    coarse centre, with the codes of their residual there; each looks through every list whose border is as
    near as trials need, see ``PqParams``, block by block, sums table distances, and compares what is
    near enough in double precision. Two vectors that meet in the lists of both count once. Lists and queries of any size are cut into blocks and every two blocks meet in one
    task, so a list that holds a third of all vectors is spread out. A task returns one count per
    vector and one chain per group, never its pairs.

    Vectors that are null, empty, zero or hold null or non-finite components have no links, nor have
    vectors of different length with each other. A row with a null id counts as a neighbour where another
    row has its vector, and else not; its component is then null. Ids are integers, null ids are not kept.
    Other columns are not read, whatever their names. Vectors of any length are taken; the sample and the trials
    are held by the driver, and a block of vectors by a task.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).alias("v"))
    good = rows.filter(_usable("v"))
    # Dealt by a digest of the components: 32 bytes are compared in place of the vectors.
    key = F.sha2(F.concat_ws(",", F.transform("v", lambda x: F.hex(x.cast("double").cast("string")))), 256)
    classes = written(
        good.withColumn("key", key).groupBy("key").agg(
            F.min("id").cast("long").alias("node"), F.count("*").alias("weight"), F.first("v").alias("v")
        ).filter(F.col("node").isNotNull()),
        "vectors",
    )
    plain = F.lit(0).cast("long")
    size = classes.agg(F.max(F.size("v")).alias("width"), F.count("*").alias("n")).first()
    if not size.n:
        return rows.select(
            F.col("id").alias(id_col), plain.alias("n_links"), F.col("id").alias("component_id"), F.col("id").isNotNull().alias("kept")
        )
    width, lists = size.width, params.lists_for(size.n)
    sample = classes.select("v", F.xxhash64("key").alias("h"), "key").orderBy("h", "key").limit(params.sample).select("v").collect()
    book = spark.sparkContext.broadcast(fit(_directions(_matrix([r.v for r in sample], width)).astype(np.float32), params, lists))
    radius = float(np.sqrt(max(2 - 2 * cosine, 0)))

    def indexed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            unit = _directions(_matrix(b.column("v"), width)).astype(np.float32)
            own, _ = book.value.nearest(unit)
            codes = book.value.codes(unit - book.value.coarse[own])
            yield pa.RecordBatch.from_arrays(
                [pa.array(own, pa.int32()), b.column("node"), b.column("weight"), b.column("v"), pa.array([c.tobytes() for c in codes], pa.binary())],
                ["list", "node", "weight", "v", "codes"],
            )

    def probing(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, 1024):
                part = b.slice(i, 1024)
                unit = _directions(_matrix(part.column("v"), width)).astype(np.float32)
                row, found = book.value.probes(unit, part.column("list").to_numpy(), reach)
                ends = np.searchsorted(row, np.arange(part.num_rows + 1))
                asks = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(found, pa.int32()))
                yield pa.RecordBatch.from_arrays([*part.columns, asks], [*part.schema.names, "asks"])

    base = classes.select("node", "weight", "v")
    kind = dict(base.dtypes)["v"]
    index = written(base.mapInArrow(indexed, f"list int, node long, weight long, v {kind}, codes binary"), "index")
    reach = radius
    if params.margin is not None:
        linked, longest = _ways(index, book, cosine, width, params, lists)
        if linked >= params.proven:
            reach = min(radius, params.margin * longest)
    # A row's list and the lists that it looks through are decided once: both sides must see the same.
    index = written(
        index.mapInArrow(probing, f"list int, node long, weight long, v {kind}, codes binary, asks array<int>"), "probed"
    )
    looked = F.explode(F.concat(F.array("list"), "asks"))
    # New names for the same columns, as both sides meet again.
    probes = index.select(looked.alias("list"), *(F.col(c).alias(c) for c in ("node", "weight", "v")), F.col("list").alias("own"))
    # One row per list.
    sizes = index.groupBy("list").agg(F.ceil(F.count("*") / block).cast("long").alias("ni"))
    asked = written(probes.groupBy("list").agg(F.ceil(F.count("*") / block).cast("long").alias("nq")), "asked")
    grid = F.broadcast(sizes.join(asked, "list"))
    own_block = lambda n: F.pmod(F.xxhash64("node"), F.col(n))
    others = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    left = index.join(grid, "list").select("list", own_block("ni").alias("i"), others("nq").alias("q"), "node", "weight", "v", "codes", "asks")
    right = probes.join(grid, "list").select("list", others("ni").alias("i"), own_block("nq").alias("q"), "node", "weight", "v", "own")

    def compare(of_list: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        none = pd.DataFrame({"node": [], "other": [], "n": []}).astype("int64")
        if not len(of_list) or not len(queries):
            return none
        of_list, queries = (f.assign(dim=f["v"].map(len)) for f in (of_list, queries))
        a, b = _pairs_in_block(of_list, queries, book.value, cosine, width)
        if not len(a):
            return none
        nodes = np.concatenate([queries["node"].to_numpy(), of_list["node"].to_numpy()])
        weight = np.concatenate([queries["weight"].to_numpy(), of_list["weight"].to_numpy()])
        b = b + len(queries)
        counts = np.bincount(a, weight[b], len(nodes)) + np.bincount(b, weight[a], len(nodes))
        met = np.flatnonzero(counts)
        # A node may stand on both sides here; it is one node of the chains.
        names, number = np.unique(nodes, return_inverse=True)
        child, root = local_forest(number[a], number[b], names)
        return pd.concat(
            [
                pd.DataFrame({"node": nodes[met], "other": nodes[met], "n": counts[met].astype("int64")}),
                pd.DataFrame({"node": child, "other": root, "n": 0}),
            ]
        )

    keys = ["list", "i", "q"]
    found = written(
        left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(compare, "node long, other long, n long"), "links"
    )
    links = found.groupBy("node").agg(F.sum("n").alias("n"))
    groups = connected_components(found.filter("node <> other").select("node", "other"))
    labels = (
        classes.select("key", "node", "weight")
        .join(links, "node", "left")
        .join(groups, "node", "left")
        .select(
            "key",
            (F.coalesce("n", plain) + F.col("weight") - 1).alias("n_links"),
            F.coalesce("component", "node").alias("component_id"),
        )
    )
    keyed = rows.withColumn("key", F.when(_usable("v"), key)).drop("v")
    joined = keyed.join(labels, "key", "left")
    component = F.when(F.col("key").isNull(), F.col("id")).otherwise(F.col("component_id"))
    return joined.select(
        F.col("id").alias(id_col),
        F.coalesce("n_links", plain).alias("n_links"),
        component.alias("component_id"),
        F.coalesce(F.col("id") == component, F.lit(False)).alias("kept"),
    )
