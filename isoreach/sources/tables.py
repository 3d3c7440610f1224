"""Input tables from any Spark source: Parquet, CSV with a header, a catalog table, and so on.

``read_*`` opens a source, ``*_table`` takes the needed fields of a DataFrame already open. Only those
fields are scanned. Typed sources keep their id types; text, as from CSV, is cast to ``id_type``.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import Columns
from ..functions import id_text, last_word


def _open(spark: SparkSession, source: str, fmt: str, options: Mapping[str, str] | None) -> DataFrame:
    if fmt == "table":
        return spark.table(source)
    reader = spark.read.format(fmt)
    if fmt == "csv":
        # The header gives the names; types come from casts, not from a pass over the data.
        reader = reader.option("header", "true")
    return reader.options(**(options or {})).load(source)


def _id(df: DataFrame, column: str, id_type: str) -> Column:
    if isinstance(df.select(column).schema[0].dataType, T.StringType):
        return F.col(column).cast(id_type).alias(column)
    return F.col(column)


def _double(column: str) -> Column:
    return F.col(column).cast("double").alias(column)


def od_table(
    df: DataFrame,
    cols: Columns = Columns(),
    *,
    destination_id_col: str | None = None,
    id_type: str = "long",
) -> DataFrame:
    """Origin, destination and time of every route.

    The destination is the last word of the route's name, or ``destination_id_col`` where the table
    has it ready.
    """
    if destination_id_col is None:
        destination = last_word(F.col(cols.name))
    else:
        destination = id_text(df, destination_id_col)
    return df.select(
        _id(df, cols.origin, id_type), destination.alias(cols.destination), _double(cols.time)
    )


def origin_table(df: DataFrame, cols: Columns = Columns(), *, id_type: str = "long") -> DataFrame:
    """Public id, population and route id of every origin."""
    return df.select(
        _id(df, cols.point, id_type), _double(cols.population), _id(df, cols.join_id, id_type)
    )


def facility_table(df: DataFrame, cols: Columns = Columns(), *, id_type: str = "long") -> DataFrame:
    """Id, capacity and the id as text, which is how routes name their destination."""
    typed = df.select(_id(df, cols.facility, id_type), _double(cols.capacity))
    return typed.withColumn(cols.facility_key, id_text(typed, cols.facility))


def read_od(
    spark: SparkSession,
    source: str,
    fmt: str = "parquet",
    cols: Columns = Columns(),
    *,
    destination_id_col: str | None = None,
    id_type: str = "long",
    options: Mapping[str, str] | None = None,
) -> DataFrame:
    raw = _open(spark, source, fmt, options)
    return od_table(raw, cols, destination_id_col=destination_id_col, id_type=id_type)


def read_origins(
    spark: SparkSession,
    source: str,
    fmt: str = "parquet",
    cols: Columns = Columns(),
    *,
    id_type: str = "long",
    options: Mapping[str, str] | None = None,
) -> DataFrame:
    return origin_table(_open(spark, source, fmt, options), cols, id_type=id_type)


def read_facilities(
    spark: SparkSession,
    source: str,
    fmt: str = "parquet",
    cols: Columns = Columns(),
    *,
    id_type: str = "long",
    options: Mapping[str, str] | None = None,
) -> DataFrame:
    return facility_table(_open(spark, source, fmt, options), cols, id_type=id_type)
