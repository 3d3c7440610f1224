"""Reading the three input tables and writing the result."""

from .results import write_csv
from .tables import od_table, facility_table, origin_table, read_facilities, read_od, read_origins

__all__ = [
    "facility_table",
    "od_table",
    "origin_table",
    "read_facilities",
    "read_od",
    "read_origins",
    "write_csv",
]
