"""Field names, parameters and join layout, passed explicitly to every operator."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

METHODS = ("2sfca", "e2sfca", "m2sfca", "3sfca", "e3sfca")


def checked_methods(methods: Sequence[str]) -> list[str]:
    """``methods`` as a list, if they are distinct, known and at least one."""
    chosen = list(methods)
    if not chosen or len(set(chosen)) < len(chosen) or not set(chosen) <= set(METHODS):
        raise ValueError(f"methods must be distinct and of {', '.join(METHODS)}, got {chosen}")
    return chosen


# Field names and parameter defaults that users' existing tables and studies rely on.
@dataclass(frozen=True)
class Columns:
    origin: str = "OriginID"
    name: str = "Name"
    time: str = "Total_time"
    destination: str = "DestinationID"
    point: str = "pointid"
    population: str = "grid_code"
    join_id: str = "OriginID_Point"
    facility: str = "OBJECTID"
    capacity: str = "capacity"
    facility_key: str = "id_str"


@dataclass(frozen=True)
class Params:
    """``d0``: catchment threshold in minutes. ``decay_f``: width of the Gaussian decay.

    ``decay`` is the weight of every method but 2SFCA, which is always binary. ``zero_demand`` says
    what 2SFCA and E2SFCA make of a facility with capacity but no demand: ``"inf"`` or ``"zero"``.
    """

    d0: float = 30.0
    decay_f: float = 15.0
    decay: str = "gaussian"
    zero_demand: str = "inf"

    def __post_init__(self) -> None:
        if not self.d0 > 0:
            raise ValueError(f"d0 must be positive, got {self.d0}")
        if not self.decay_f > 0:
            raise ValueError(f"decay_f must be positive, got {self.decay_f}")
        if self.decay not in ("gaussian", "linear"):
            raise ValueError(f"decay must be 'gaussian' or 'linear', got {self.decay!r}")
        if self.zero_demand not in ("inf", "zero"):
            raise ValueError(f"zero_demand must be 'inf' or 'zero', got {self.zero_demand!r}")


#: Bytes that a row of a lookup table takes in a broadcast, beside its text: a key, at most seven doubles and
#: its place in the hash table. A text stands there as key and in the row.
ROW_BYTES, TEXTS = 150, 2


@dataclass(frozen=True)
class Layout:
    """Which lookup tables were measured small enough to broadcast, and how finely to cut hot keys.

    A lookup that is not small is joined by a shuffle in which every key with more than
    ``slice_rows`` pairs is spread over several tasks (see ``operators.lookup``). ``broadcast_bytes`` bounds what
    operators measure themselves before they broadcast it.
    """

    small_origins: bool = False
    small_facilities: bool = False
    slice_rows: int = 50_000_000
    broadcast_bytes: int = 256 << 20

    def __post_init__(self) -> None:
        if not self.slice_rows > 0:
            raise ValueError(f"slice_rows must be positive, got {self.slice_rows}")
        if not self.broadcast_bytes >= 0:
            raise ValueError(f"broadcast_bytes must not be negative, got {self.broadcast_bytes}")


def lookup_bytes(table: DataFrame, key: str) -> int:
    """Bytes that ``table``, of at most seven numbers beside ``key``, takes when it is broadcast.

    Rows are counted, from file footers only for Parquet; the lengths of text keys are summed.
    """
    if not isinstance(table.select(key).schema[0].dataType, T.StringType):
        return table.count() * ROW_BYTES
    text = F.coalesce(F.sum(F.octet_length(key)), F.lit(0))
    rows, letters = table.agg(F.count(F.lit(1)), text).first()
    return rows * ROW_BYTES + letters * TEXTS


def measure_layout(
    origins: DataFrame,
    facilities: DataFrame,
    cols: Columns = Columns(),
    *,
    broadcast_bytes: int = 256 << 20,
    slice_rows: int = 50_000_000,
) -> Layout:
    """Measures both tables and marks those that take at most ``broadcast_bytes`` in a broadcast.

    That is some 1.8 million rows with ids that are numbers, fewer with ids that are long texts.
    """
    bounds = Layout(slice_rows=slice_rows, broadcast_bytes=broadcast_bytes)
    return replace(
        bounds,
        small_origins=lookup_bytes(origins, cols.join_id) <= broadcast_bytes,
        small_facilities=lookup_bytes(facilities, cols.facility_key) <= broadcast_bytes,
    )
