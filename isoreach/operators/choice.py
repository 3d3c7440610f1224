"""Shares of an origin's population that choose each facility.

Both shares divide by a total over the origin. The total is an aggregation joined back to the pairs,
not a window: a window would bring all routes of one origin into one task. Both operators start a job when
they are called: the totals, or the search for hot origins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import Columns, Layout, Params, lookup_bytes
from ..functions import nan_safe_sum, positive_ratio, weight
from ..storage import can_store, written
from .catchment import within_catchment
from .lookup import deal, lookup_join, sum_per_key
from .tables import supply_table


def _with_share(
    pairs: DataFrame, part: str, total: Column, share: str, cols: Columns, layout: Layout
) -> DataFrame:
    """Adds ``share``: ``part`` over the origin's ``total``.

    Where the origins were measured small, their totals are summed with a map-side half, stored and measured: the
    routes may name origins that the table has not. If they are small too they are broadcast, and the
    pairs stay where they are. Else the pairs are dealt, and the totals summed and attached there.
    """
    share_of = [*pairs.columns, positive_ratio(F.col(part), F.col("_total")).alias(share)]
    if layout.small_origins and can_store(pairs.sparkSession):
        totals = written(sum_per_key(pairs, cols.origin, {"_total": total}), "totals")
        if lookup_bytes(totals, cols.origin) <= layout.broadcast_bytes:
            return pairs.join(F.broadcast(totals), cols.origin, "left").select(*share_of)
    dealt = deal(pairs, cols.origin, cols.destination, layout.slice_rows)
    joined = dealt.attach(sum_per_key(dealt.pairs, cols.origin, {"_total": total}), "left")
    return joined.select(*share_of)


def selection_weights(
    od: DataFrame,
    params: Params = Params(),
    cols: Columns = Columns(),
    layout: Layout = Layout(),
) -> DataFrame:
    """Adds ``Tij``, the decay weight, and ``Gij``, its share of the origin's total (0 if that is 0).

    Facilities need not be known to count. Every row is kept.
    """
    weighted = od.withColumn("Tij", weight(F.col(cols.time), params))
    return _with_share(weighted, "Tij", nan_safe_sum(F.col("Tij")), "Gij", cols, layout)


def huff_probability(
    od: DataFrame,
    facilities: DataFrame,
    params: Params = Params(),
    cols: Columns = Columns(),
    layout: Layout = Layout(),
) -> DataFrame:
    """``Huff_ij``: share of capacity times decay among the known facilities within ``d0``.

    One unknown capacity within reach leaves the origin's total undefined, and all its shares 0.
    The travel time stays in the result for the steps that follow.
    """
    # NaN, unlike null, is not skipped by the sum.
    supply = supply_table(facilities, cols).withColumn(
        "_supply", F.coalesce(F.col("_supply"), F.lit(float("nan")))
    )
    pulls = lookup_join(
        within_catchment(od, params, cols).select(cols.origin, cols.destination, cols.time),
        supply,
        cols.destination,
        cols.origin,
        "inner",
        small=layout.small_facilities,
        slice_rows=layout.slice_rows,
    ).select(
        cols.origin,
        cols.destination,
        cols.time,
        (F.col("_supply") * weight(F.col(cols.time), params)).alias("_pull"),
    )
    return _with_share(pulls, "_pull", F.sum("_pull"), "Huff_ij", cols, layout).drop("_pull")
