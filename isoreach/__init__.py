"""Catchment-based spatial accessibility on Spark DataFrames."""

from .config import METHODS, Columns, Layout, Params, measure_layout
from .plans import accessibility, accessibility_by_steps, run

__all__ = [
    "METHODS",
    "Columns",
    "Layout",
    "Params",
    "accessibility",
    "accessibility_by_steps",
    "measure_layout",
    "run",
]
