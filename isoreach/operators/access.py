"""Accessibility scores per origin, the second half of every method, and their assembly."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import Columns, Layout, Params
from ..functions import binary_weight, nan_safe_sum, weight
from .lookup import lookup_join


def _with_ratio(
    pairs: DataFrame, ratios: DataFrame, how: str, cols: Columns, layout: Layout
) -> DataFrame:
    # Ratios of 0 and undefined ones add nothing to a sum. Without them at most one row per facility
    # is left, so that the facilities' measured size bounds this table too.
    contributing = ratios.filter(F.col("Rj") != 0.0)
    return lookup_join(
        pairs,
        contributing,
        cols.destination,
        cols.origin,
        how,
        small=layout.small_facilities,
        slice_rows=layout.slice_rows,
    )


def _score(scored: DataFrame, term: Column, origins: DataFrame, name: str, cols: Columns) -> DataFrame:
    """Sums ``term`` per origin and renames origins to their public id (null for an unknown one)."""
    sums = scored.groupBy(cols.origin).agg(nan_safe_sum(term).alias(name))
    ids = origins.select(F.col(cols.join_id).alias(cols.origin), cols.point)
    return sums.filter(F.col(cols.origin).isNotNull()).join(ids, cols.origin, "left").select(cols.point, name)


def spai_2sfca(
    od: DataFrame,
    rj: DataFrame,
    origins: DataFrame,
    params: Params = Params(),
    cols: Columns = Columns(),
    layout: Layout = Layout(),
) -> DataFrame:
    """``SPAI_2sfca``: sum of ``Rj`` over the facilities within ``d0``."""
    scored = _with_ratio(od, rj, "left", cols, layout)
    term = F.col("Rj") * binary_weight(F.col(cols.time), params.d0)
    return _score(scored, term, origins, "SPAI_2sfca", cols)


def spai_e2sfca(
    od: DataFrame,
    rj: DataFrame,
    origins: DataFrame,
    params: Params = Params(),
    cols: Columns = Columns(),
    layout: Layout = Layout(),
) -> DataFrame:
    """``SPAI_e2sfca``: sum of ``Rj`` times decay."""
    scored = _with_ratio(od, rj, "left", cols, layout)
    return _score(scored, F.col("Rj") * weight(F.col(cols.time), params), origins, "SPAI_e2sfca", cols)


def spai_m2sfca(
    rij: DataFrame,
    origins: DataFrame,
    params: Params = Params(),
    cols: Columns = Columns(),
) -> DataFrame:
    """``SPAI_m2sfca``: sum of ``Rij`` times decay, which so enters squared."""
    return _score(rij, F.col("Rij") * weight(F.col(cols.time), params), origins, "SPAI_m2sfca", cols)


def spai_3sfca(
    od: DataFrame,
    rj: DataFrame,
    origins: DataFrame,
    params: Params = Params(),
    cols: Columns = Columns(),
    layout: Layout = Layout(),
) -> DataFrame:
    """``SPAI_3sfca``: sum of ``Gij`` times ``Rj`` times decay."""
    scored = _with_ratio(od, rj, "left", cols, layout)
    term = F.col("Gij") * F.col("Rj") * weight(F.col(cols.time), params)
    return _score(scored, term, origins, "SPAI_3sfca", cols)


def spai_e3sfca(
    huff: DataFrame,
    rj: DataFrame,
    origins: DataFrame,
    params: Params = Params(),
    cols: Columns = Columns(),
    layout: Layout = Layout(),
) -> DataFrame:
    """``SPAI_e3sfca``: sum of ``Huff_ij`` times ``Rj`` times decay."""
    scored = _with_ratio(huff, rj, "left", cols, layout)
    term = F.col("Huff_ij") * F.col("Rj") * weight(F.col(cols.time), params)
    return _score(scored, term, origins, "SPAI_e3sfca", cols)


def complete_scores(
    spai: DataFrame, origins: DataFrame, score: str, cols: Columns = Columns()
) -> DataFrame:
    """One row per public origin id, with 0 where there is no score."""
    everyone = origins.select(cols.point).distinct()
    filled = F.coalesce(F.nanvl(F.col(score), F.lit(0.0)), F.lit(0.0))
    return everyone.join(spai, cols.point, "left").select(cols.point, filled.alias(score))


def merge_scores(tables: Iterable[DataFrame], cols: Columns = Columns()) -> DataFrame:
    """Score tables side by side, over every id that any of them holds."""
    return reduce(lambda left, right: left.join(right, cols.point, "full"), tables)
