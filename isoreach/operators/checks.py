"""Checks of the keys that the formulas take for granted."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import Columns


def null_keys(df: DataFrame, *keys: str) -> DataFrame:
    """Rows in which any of ``keys`` is null."""
    any_null = F.lit(False)
    for key in keys:
        any_null = any_null | F.col(key).isNull()
    return df.filter(any_null)


def repeated_keys(df: DataFrame, *keys: str) -> DataFrame:
    """Keys that occur more than once, with their number of rows as ``n_rows``."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows")).filter(F.col("n_rows") > 1)


def _require_unique(df: DataFrame, key: str, what: str) -> None:
    example = null_keys(df, key).select(key).limit(1).count()
    if example:
        raise ValueError(f"{what}: {key} is null in at least one row")
    repeated = repeated_keys(df, key).limit(3).collect()
    if repeated:
        raise ValueError(f"{what}: {key} is repeated, for example {[row[0] for row in repeated]}")


def validate_origins(origins: DataFrame, cols: Columns = Columns()) -> None:
    """Raises unless both ids of the origins are present and unique."""
    _require_unique(origins, cols.join_id, "origins")
    _require_unique(origins, cols.point, "origins")


def validate_facilities(facilities: DataFrame, cols: Columns = Columns()) -> None:
    """Raises unless the facility key is present and unique."""
    _require_unique(facilities, cols.facility_key, "facilities")


def validate_od(od: DataFrame, cols: Columns = Columns()) -> None:
    """Raises unless origins are present and pairs unique. Shuffles the pairs: ``dedupe_od`` mends them."""
    if null_keys(od, cols.origin).limit(1).count():
        raise ValueError(f"od: {cols.origin} is null in at least one row")
    repeated = repeated_keys(
        od.filter(F.col(cols.destination).isNotNull()), cols.origin, cols.destination
    )
    examples = repeated.limit(3).collect()
    if examples:
        raise ValueError(f"od: pairs are repeated, for example {[tuple(row)[:2] for row in examples]}")
