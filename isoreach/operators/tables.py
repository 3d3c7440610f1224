"""The columns the operators take from the two small tables, under working names."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import Columns
from ..functions import number


def supply_table(facilities: DataFrame, cols: Columns) -> DataFrame:
    """(destination, ``_supply``): one row per facility, keyed as the pairs name it."""
    return facilities.select(
        F.col(cols.facility_key).alias(cols.destination), number(cols.capacity).alias("_supply")
    )


def people_table(origins: DataFrame, cols: Columns) -> DataFrame:
    """(origin, ``_people``): population under the id that the pairs use."""
    return origins.select(
        F.col(cols.join_id).alias(cols.origin), number(cols.population).alias("_people")
    )
