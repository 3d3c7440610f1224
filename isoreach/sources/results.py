"""CSV output of a score table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import Columns


def write_csv(
    scores: DataFrame,
    path: str,
    cols: Columns = Columns(),
    *,
    mode: str = "errorifexists",
    infinity: str = "Infinity",
) -> None:
    """Writes a folder of CSV files with headers, sorted by id within and across the files.

    ``infinity`` is the text of infinite scores, for readers that know it as ``inf`` only.
    """
    table = scores.orderBy(cols.point)
    if infinity != "Infinity":
        doubles = [c for c, kind in scores.dtypes if kind == "double"]
        told = {
            c: F.when(F.abs(c) == float("inf"), F.concat(F.when(F.col(c) < 0, "-").otherwise(""), F.lit(infinity))).otherwise(F.col(c).cast("string"))
            for c in doubles
        }
        table = table.withColumns(told)
    table.write.mode(mode).option("header", True).csv(path)
