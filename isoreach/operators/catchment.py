"""Preparing the travel-time table: catchment filter and duplicate routes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ..config import Columns, Params


def within_catchment(
    od: DataFrame,
    params: Params = Params(),
    cols: Columns = Columns(),
    *,
    observation: Observation | None = None,
) -> DataFrame:
    """Routes of at most ``d0`` minutes; a missing time is out.

    The comparison is a plain column filter and reaches the Parquet scan. With an ``observation`` the
    number of rows kept is delivered as ``pairs_kept`` by whatever action runs first, without a job
    of its own.
    """
    kept = od.filter(F.col(cols.time) <= F.lit(float(params.d0)))
    if observation is not None:
        kept = kept.observe(observation, F.count(F.lit(1)).alias("pairs_kept"))
    return kept


def dedupe_od(od: DataFrame, cols: Columns = Columns()) -> DataFrame:
    """One row per (origin, destination): the shortest time. Combined before the shuffle.

    Routes without a destination have no key to repeat and are all kept, as ``validate_od`` sees them.
    """
    shortest = F.min(F.nanvl(F.col(cols.time), F.lit(None).cast("double")))
    named = od.filter(F.col(cols.destination).isNotNull())
    unnamed = od.filter(F.col(cols.destination).isNull()).select(cols.origin, cols.destination, cols.time)
    once = named.groupBy(cols.origin, cols.destination).agg(shortest.alias(cols.time))
    return once.unionByName(unnamed)
