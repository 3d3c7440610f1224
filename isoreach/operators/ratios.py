"""Supply-to-demand ratios, the first half of every method.

Demand is summed per destination with partial sums before the shuffle, so a destination that many
origins reach costs no more than any other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import Columns, Layout, Params
from ..functions import binary_weight, nan_safe_sum, positive_ratio, safe_ratio, weight
from .lookup import lookup_join
from .tables import people_table, supply_table


def _demand(
    pairs: DataFrame, origins: DataFrame, factor: Column, cols: Columns, layout: Layout
) -> DataFrame:
    """(destination, ``_demand``): population times ``factor`` over the origins that are known."""
    weighted = pairs.select(cols.origin, cols.destination, factor.alias("_factor"))
    peopled = lookup_join(
        weighted.filter(F.col(cols.destination).isNotNull()),
        people_table(origins, cols),
        cols.origin,
        cols.destination,
        "inner",
        small=layout.small_origins,
        slice_rows=layout.slice_rows,
    )
    return peopled.groupBy(cols.destination).agg(
        nan_safe_sum(F.col("_people") * F.col("_factor")).alias("_demand")
    )


def _ratio_per_destination(
    demand: DataFrame, facilities: DataFrame, zero: str, cols: Columns
) -> DataFrame:
    joined = demand.join(supply_table(facilities, cols), cols.destination, "left")
    ratio = safe_ratio(F.col("_supply"), F.col("_demand"), zero)
    return joined.select(cols.destination, ratio.alias("Rj"))


def rj_2sfca(
    od: DataFrame,
    origins: DataFrame,
    facilities: DataFrame,
    params: Params = Params(),
    cols: Columns = Columns(),
    layout: Layout = Layout(),
) -> DataFrame:
    """``Rj``: capacity over the population within ``d0``; null where the facility is unknown."""
    factor = binary_weight(F.col(cols.time), params.d0)
    demand = _demand(od, origins, factor, cols, layout)
    return _ratio_per_destination(demand, facilities, params.zero_demand, cols)


def rj_e2sfca(
    od: DataFrame,
    origins: DataFrame,
    facilities: DataFrame,
    params: Params = Params(),
    cols: Columns = Columns(),
    layout: Layout = Layout(),
) -> DataFrame:
    """``Rj``: capacity over the decayed population; null where the facility is unknown."""
    demand = _demand(od, origins, weight(F.col(cols.time), params), cols, layout)
    return _ratio_per_destination(demand, facilities, params.zero_demand, cols)


def rij_m2sfca(
    od: DataFrame,
    origins: DataFrame,
    facilities: DataFrame,
    params: Params = Params(),
    cols: Columns = Columns(),
    layout: Layout = Layout(),
) -> DataFrame:
    """``Rij`` of every pair: decayed capacity over the decayed population, 0 where undefined.

    The travel time stays in the result for ``spai_m2sfca``.
    """
    decay = weight(F.col(cols.time), params)
    per_facility = _demand(od, origins, decay, cols, layout).join(
        supply_table(facilities, cols), cols.destination, "inner"
    )
    joined = lookup_join(
        od.select(cols.origin, cols.destination, cols.time),
        per_facility,
        cols.destination,
        cols.origin,
        "left",
        small=layout.small_facilities,
        slice_rows=layout.slice_rows,
    )
    ratio = safe_ratio(F.col("_supply") * decay, F.col("_demand"), "zero")
    return joined.select(cols.origin, cols.destination, cols.time, ratio.alias("Rij"))


def rj_3sfca(
    od: DataFrame,
    origins: DataFrame,
    facilities: DataFrame,
    params: Params = Params(),
    cols: Columns = Columns(),
    layout: Layout = Layout(),
) -> DataFrame:
    """``Rj`` with demand weighted by ``Gij`` (from ``selection_weights``) and decay; 0 where undefined."""
    factor = F.col("Gij") * weight(F.col(cols.time), params)
    return _ratio_per_destination(
        _demand(od, origins, factor, cols, layout), facilities, "zero", cols
    )


def rj_e3sfca(
    huff: DataFrame,
    origins: DataFrame,
    facilities: DataFrame,
    params: Params = Params(),
    cols: Columns = Columns(),
    layout: Layout = Layout(),
) -> DataFrame:
    """``Rj`` of every facility, reached or not, with demand weighted by ``Huff_ij`` and decay.

    ``huff`` comes from ``huff_probability``. 0 unless the demand is above 0.
    """
    factor = F.col("Huff_ij") * weight(F.col(cols.time), params)
    demand = _demand(huff, origins, factor, cols, layout)
    joined = supply_table(facilities, cols).join(demand, cols.destination, "left")
    ratio = positive_ratio(F.col("_supply"), F.col("_demand"))
    return joined.select(cols.destination, ratio.alias("Rj"))
