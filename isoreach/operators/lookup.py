"""Attaching a per-key table to the travel-time pairs, and summing the pairs per key.

These are the only steps at the scale of the pairs. One origin or destination may hold a large part of
all pairs, so a shuffle by key alone could leave one task with most of the work. ``deal`` therefore cuts
such keys into slices, and every shuffle is by key and slice.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..storage import can_store, written

SLICE = "_slice"
_SLICES = "_slices"
_NULL_SLICES = 1024

# Hot keys that are collected and broadcast at most; of more, Spark stores and joins the table as any other.
_FEW = 75_000

# Tasks that one key is spread over at most.
_MOST_SLICES = 4096


def hot_keys(pairs: DataFrame, key: str, slice_rows: int) -> DataFrame:
    """(``key``, ``_slices``) of all keys with more than ``slice_rows`` pairs, whatever the number of pairs.

    One pass over the key column counts the pairs of every key, with a map-side half. Up to 75,000 hot keys come as a
    table of literals that joins broadcast. More are neither collected nor broadcast: they are stored where
    there is a shared folder, else found again by every use, with the same counts.
    """
    return hot_keys_together([(pairs, key)], slice_rows)[0]


def hot_keys_together(searches: Sequence[tuple[DataFrame, str]], slice_rows: int) -> list[DataFrame]:
    """``hot_keys`` of several tables or columns, found in one job that shares what they have in common."""
    spark, kinds, tables, found = searches[0][0].sparkSession, [], [], None
    for number, (pairs, key) in enumerate(searches):
        kinds.append(pairs.select(key).schema[0].dataType)
        counted = pairs.select(key).filter(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("_rows"))
        slices = F.least(F.ceil(F.col("_rows") / F.lit(slice_rows)), F.lit(_MOST_SLICES)).cast("long")
        tables.append(counted.filter(F.col("_rows") > F.lit(slice_rows)).select(key, slices.alias(_SLICES)))
        if isinstance(kinds[-1], T.NullType):
            kinds[-1] = T.StringType()
            continue
        hot = tables[-1].select(F.lit(number).alias("_of"), F.col(key).cast("string").alias("_item"), _SLICES)
        found = hot if found is None else found.unionByName(hot)
    rows = found.limit(_FEW + 1).collect() if found is not None else []
    if len(rows) > _FEW:
        if len(searches) > 1:
            return [hot_keys(pairs, key, slice_rows) for pairs, key in searches]
        return [written(tables[0], "hot") if can_store(spark) else tables[0]]
    out = []
    for number, ((_, key), kind) in enumerate(zip(searches, kinds, strict=True)):
        own = [r for r in rows if r._of == number]
        table = pa.table({"_item": pa.array([r._item for r in own], pa.string()), _SLICES: pa.array([r[_SLICES] for r in own], pa.int64())})
        out.append(F.broadcast(spark.createDataFrame(table).select(F.col("_item").cast(kind).alias(key), _SLICES)))
    return out


def broadcast_if_few(hot: DataFrame) -> DataFrame:
    """A stored table of hot keys as ``hot_keys`` makes it: broadcast by joins unless it is large."""
    return F.broadcast(hot) if hot.count() <= _FEW else hot


@dataclass(frozen=True)
class Dealt:
    """Pairs shuffled by key and slice. Several uses of one object share that one shuffle."""

    pairs: DataFrame
    hot: DataFrame
    key: str

    def attach(self, lookup: DataFrame, how: str) -> DataFrame:
        """Joins ``lookup``, of at most one row per key, each repeated once per slice of its key.

        Its share of a partition is at most one row per key, so it is hashed and the pairs need no sort.
        """
        last = F.coalesce(F.col(_SLICES), F.lit(1).cast("long")) - 1
        repeated = (
            lookup.join(self.hot, self.key, "left")
            .withColumn(SLICE, F.explode(F.sequence(F.lit(0).cast("long"), last)))
            .drop(_SLICES)
        )
        return self.pairs.join(repeated.hint("shuffle_hash"), [self.key, SLICE], how)


def sliced(pairs: DataFrame, key: str, spread_by: str, hot: DataFrame) -> DataFrame:
    """``pairs`` with the slice of their key that each row belongs to.

    A hash of ``spread_by`` and all other columns picks the slice: it is a function of the row, so a task
    that is run again deals its pairs out alike, and a hot key is cut even where ``spread_by`` is the
    same throughout. Pairs without a key are spread too.
    """
    slices = F.coalesce(F.col(_SLICES), F.when(F.col(key).isNull(), F.lit(_NULL_SLICES)), F.lit(1))
    # Declared never null, lest a join on it puts a null filter below one use of the shuffle only.
    others = [c for c in pairs.columns if c not in (key, spread_by)]
    picked = F.coalesce(F.pmod(F.xxhash64(spread_by, *others), slices.cast("long")), F.lit(0).cast("long"))
    return pairs.join(hot, key, "left").withColumn(SLICE, picked).drop(_SLICES)


def deal(pairs: DataFrame, key: str, spread_by: str, slice_rows: int, hot: DataFrame | None = None) -> Dealt:
    """Shuffles ``pairs`` by ``key``, with keys of more than ``slice_rows`` pairs cut into slices.

    Looks for such keys at once, in one pass over the key column, unless ``hot`` has them.
    """
    if hot is None:
        hot = hot_keys(pairs, key, slice_rows)
    return Dealt(sliced(pairs, key, spread_by, hot).repartition(key, SLICE), hot, key)


def sum_per_key(rows: DataFrame, key: str, sums: Mapping[str, Column]) -> DataFrame:
    """``sums`` (name to aggregate) per key.

    Rows that are dealt by this key are summed per slice where they lie, and only the slices' sums move.
    """
    if SLICE not in rows.columns:
        return rows.groupBy(key).agg(*[total.alias(name) for name, total in sums.items()])
    per_slice = rows.groupBy(key, SLICE).agg(*[total.alias(name) for name, total in sums.items()])
    return per_slice.groupBy(key).agg(*[F.sum(name).alias(name) for name in sums])


def lookup_join(
    pairs: DataFrame,
    lookup: DataFrame,
    key: str,
    spread_by: str,
    how: str,
    *,
    small: bool,
    slice_rows: int,
) -> DataFrame:
    """``pairs`` joined to ``lookup``, which has at most one row per ``key`` (``how``: inner or left).

    A lookup measured small is broadcast and the pairs do not move; otherwise the pairs are dealt.
    """
    if small:
        return pairs.join(F.broadcast(lookup), key, how)
    return deal(pairs, key, spread_by, slice_rows).attach(lookup, how).drop(SLICE)
