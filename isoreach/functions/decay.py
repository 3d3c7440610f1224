"""Distance decay weights of a travel time."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import Params


def gaussian_weight(time: Column, d0: float, decay_f: float) -> Column:
    """``exp(-(t/decay_f)^2)`` inside the catchment, 0 outside or for a missing time."""
    scaled = time / F.lit(float(decay_f))
    return F.when(time <= F.lit(float(d0)), F.exp(-scaled * scaled)).otherwise(F.lit(0.0))


def linear_weight(time: Column, d0: float) -> Column:
    """Falls from 1 at time 0 to 0 at ``d0`` and beyond; 0 for a missing time."""
    d0 = float(d0)
    return F.when(time < F.lit(d0), (F.lit(d0) - time) / F.lit(d0)).otherwise(F.lit(0.0))


def binary_weight(time: Column, d0: float) -> Column:
    """1 inside the catchment, 0 outside or for a missing time."""
    return F.when(time <= F.lit(float(d0)), F.lit(1.0)).otherwise(F.lit(0.0))


def weight(time: Column, params: Params) -> Column:
    """The decay that ``params`` selects for the weighted methods."""
    if params.decay == "linear":
        return linear_weight(time, params.d0)
    return gaussian_weight(time, params.d0, params.decay_f)
