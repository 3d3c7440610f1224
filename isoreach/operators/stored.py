"""Travel-time pairs stored for the passes of one computation, or for many studies over one table."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Columns, Params
from ..storage import written
from .catchment import within_catchment
from .lookup import SLICE, broadcast_if_few, hot_keys, sliced

_HOT = "_hot"
_D0 = "isoreach.d0"


def store_pairs(od: DataFrame, params: Params = Params(), cols: Columns = Columns()) -> DataFrame:
    """Origin, destination and time of the routes within ``d0``, written once as Parquet and read back.

    For routes that are costly to read again: text files, whose every pass is parsed anew, or the result of a
    query. The folder lies below ``spark.checkpoint.dir`` and goes with the session. Routes without an
    origin add to no score and are left out.
    """
    kept = within_catchment(od, params, cols).filter(F.col(cols.origin).isNotNull())
    return written(kept.select(cols.origin, cols.destination, cols.time), "pairs")


@dataclass(frozen=True)
class StoredPairs:
    """Pairs in buckets by origin and slice, with the table of hot origins that the slices were cut by.

    ``d0`` is the longest time stored, None for all times.
    """

    pairs: DataFrame
    hot: DataFrame
    cols: Columns
    d0: float | None

    def within(self, params: Params) -> DataFrame:
        if self.d0 is not None and params.d0 > self.d0:
            raise ValueError(f"routes of over {self.d0} minutes are not stored, d0 is {params.d0}")
        return within_catchment(self.pairs, params, self.cols)


def store_by_origin(
    od: DataFrame,
    table: str,
    cols: Columns = Columns(),
    *,
    buckets: int,
    d0: float | None = None,
    slice_rows: int = 50_000_000,
    path: str | None = None,
    mode: str = "errorifexists",
) -> StoredPairs:
    """Stores the pairs as a catalog table in ``buckets`` buckets by origin, for many studies.

    Choose ``buckets`` so that one holds some 200 MB. Origins with more than ``slice_rows`` pairs are cut into
    slices that go to several buckets; ``<table>_hot`` lists them. Any study over the stored pairs, whatever its
    threshold up to ``d0``, decay or capacities, sums per origin where the pairs lie. ``path`` puts both tables
    into a folder of the user's.
    """
    kept = od.filter(F.col(cols.origin).isNotNull()).select(cols.origin, cols.destination, cols.time)
    if d0 is not None:
        kept = within_catchment(kept, Params(d0=d0), cols)
    hot = hot_keys(kept, cols.origin, slice_rows)
    dealt = sliced(kept, cols.origin, cols.destination, hot).repartition(buckets, cols.origin, SLICE)
    pairs_out = dealt.write.mode(mode).format("parquet").bucketBy(buckets, cols.origin, SLICE)
    hot_out = hot.write.mode(mode).format("parquet")
    if path is not None:
        pairs_out, hot_out = pairs_out.option("path", f"{path}/pairs"), hot_out.option("path", f"{path}/hot")
    pairs_out.saveAsTable(table)
    hot_out.saveAsTable(table + _HOT)
    spark = od.sparkSession
    spark.sql(f"ALTER TABLE {table} SET TBLPROPERTIES ('{_D0}' = '{'' if d0 is None else float(d0)}')")
    return open_by_origin(spark, table, cols)


def open_by_origin(spark: SparkSession, table: str, cols: Columns = Columns()) -> StoredPairs:
    """The pairs that ``store_by_origin`` stored as ``table``."""
    known = {r.key: r.value for r in spark.sql(f"SHOW TBLPROPERTIES {table}").collect()}
    if _D0 not in known:
        raise ValueError(f"{table} was not written by store_by_origin")
    return StoredPairs(spark.table(table), broadcast_if_few(spark.table(table + _HOT)), cols, float(known[_D0]) if known[_D0] else None)
