"""The five methods composed of the single operators.

Easier to follow and to inspect than the fused plan, which gives the same scores in far fewer passes.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import operators as ops
from ..config import METHODS, Columns, Layout, Params, checked_methods, measure_layout


def accessibility_by_steps(
    od: DataFrame,
    origins: DataFrame,
    facilities: DataFrame,
    *,
    methods: Sequence[str] = METHODS,
    params: Params = Params(),
    cols: Columns = Columns(),
    layout: Layout | None = None,
    scale: float = 1.0,
) -> DataFrame:
    """Same contract as ``accessibility``."""
    methods = checked_methods(methods)
    layout = layout or measure_layout(origins, facilities, cols)
    common = dict(params=params, cols=cols, layout=layout)
    pairs = ops.within_catchment(od, params, cols)
    chosen = ops.selection_weights(pairs, **common)
    huff = ops.huff_probability(pairs, facilities, **common)

    def score(method: str) -> DataFrame:
        if method == "2sfca":
            rj = ops.rj_2sfca(pairs, origins, facilities, **common)
            return ops.spai_2sfca(pairs, rj, origins, **common)
        if method == "e2sfca":
            rj = ops.rj_e2sfca(pairs, origins, facilities, **common)
            return ops.spai_e2sfca(pairs, rj, origins, **common)
        if method == "m2sfca":
            rij = ops.rij_m2sfca(pairs, origins, facilities, **common)
            return ops.spai_m2sfca(rij, origins, params, cols)
        if method == "3sfca":
            rj = ops.rj_3sfca(chosen, origins, facilities, **common)
            return ops.spai_3sfca(chosen, rj, origins, **common)
        rj = ops.rj_e3sfca(huff, origins, facilities, **common)
        return ops.spai_e3sfca(huff, rj, origins, **common)

    tables = [
        ops.complete_scores(score(method), origins, f"SPAI_{method}", cols) for method in methods
    ]
    merged = ops.merge_scores(tables, cols)
    return merged.select(
        cols.point, *[(F.col(f"SPAI_{m}") * F.lit(float(scale))).alias(f"SPAI_{m}") for m in methods]
    )
