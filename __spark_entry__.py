"""Registered queries and the SQL that each must agree with.

The driver's tables are read as a travel-time study: customers are the origins, suppliers the
facilities, and each (customer, supplier) pair that shares an order is a route whose time in minutes
is the smallest quantity ordered.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from isoreach import Layout, Params, accessibility, accessibility_by_steps, measure_layout
from isoreach import operators as ops
from isoreach.config import METHODS
from isoreach.functions import binary_weight, gaussian_weight, last_word, linear_weight
from isoreach.operators.lookup import hot_keys
from isoreach.sources import facility_table, od_table, origin_table
from isoreach.storage import shared_folder

try:
    import corpus_pipeline
    from isoreach.llm import queries as llm
except ImportError:
    # The training-data operators can be taken out of the repository, and need packages that nothing else needs.
    corpus_pipeline = llm = None

Query = Callable[[SparkSession, str], DataFrame]

SMOKE_DIR = "/root/testdata/sf0.001"
LINEAR = Params(decay="linear")


# ---------------------------------------------------------------- inputs


def _scan(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def order_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(o_custkey, l_suppkey, l_quantity) of every order line."""
    lines = _scan(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey", "l_quantity")
    orders = _scan(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    return lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))


def routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The travel-time table as a routing tool would hand it over: origin, route name, time."""
    pairs = order_lines(spark, sf_dir).groupBy("o_custkey", "l_suppkey")
    return pairs.agg(F.min("l_quantity").alias("Total_time")).select(
        F.col("o_custkey").alias("OriginID"),
        F.concat(
            F.lit("Location "), F.col("o_custkey"), F.lit(" - Destination "), F.col("l_suppkey")
        ).alias("Name"),
        "Total_time",
    )


def od(spark: SparkSession, sf_dir: str) -> DataFrame:
    return od_table(routes(spark, sf_dir))


def origins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return origin_table(
        _scan(spark, sf_dir, "customer").select(
            (F.col("c_custkey") + 100000).alias("pointid"),
            F.floor(F.greatest(F.col("c_acctbal"), F.lit(0.0))).alias("grid_code"),
            F.col("c_custkey").alias("OriginID_Point"),
        )
    )


def facilities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facility_table(
        _scan(spark, sf_dir, "supplier").select(
            F.col("s_suppkey").alias("OBJECTID"),
            F.floor(F.greatest(F.col("s_acctbal"), F.lit(0.0))).alias("capacity"),
        )
    )


def facilities_with_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers in debt have no known capacity; those with the fullest accounts are not listed at all."""
    suppliers = _scan(spark, sf_dir, "supplier").filter(F.col("s_acctbal") < 9000)
    return facility_table(
        suppliers.select(
            F.col("s_suppkey").alias("OBJECTID"),
            F.when(F.col("s_acctbal") >= 0, F.floor("s_acctbal")).alias("capacity"),
        )
    )


def _study(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    return od(spark, sf_dir), origins(spark, sf_dir), facilities(spark, sf_dir)


def _round(column: str, digits: int, factor: float = 1.0):
    return F.round(F.col(column) * F.lit(factor), digits).alias(column)


def _rounded_scores(df: DataFrame) -> DataFrame:
    scores = [c for c in df.columns if c.startswith("SPAI_")]
    return df.select("pointid", *[_round(c, 3, 1e6) for c in scores])


# ---------------------------------------------------------------- queries


def parse_destination_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return routes(spark, sf_dir).select("Name", last_word(F.col("Name")).alias("DestinationID"))


def parse_last_word(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same parser on free text, where words end in anything and texts may be blank."""
    return _scan(spark, sf_dir, "documents").select("doc_id", last_word(F.col("text")).alias("last_word"))


def load_od(spark: SparkSession, sf_dir: str) -> DataFrame:
    return od(spark, sf_dir)


def load_origins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return origins(spark, sf_dir)


def load_facilities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facilities(spark, sf_dir)


def load_od_ready_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A travel-time table that already has a destination id."""
    raw = order_lines(spark, sf_dir).groupBy("o_custkey", "l_suppkey").agg(
        F.min("l_quantity").alias("Total_time")
    )
    return od_table(raw.withColumnRenamed("o_custkey", "OriginID"), destination_id_col="l_suppkey")


def catchment_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.within_catchment(od(spark, sf_dir))


def _decay(weight) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return od(spark, sf_dir).select(
            "OriginID", "DestinationID", F.round(weight(F.col("Total_time")), 9).alias("f")
        )

    return query


def selection_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    od_df, origins_df, facilities_df = _study(spark, sf_dir)
    chosen = ops.selection_weights(ops.within_catchment(od_df), layout=measure_layout(origins_df, facilities_df))
    return chosen.select("OriginID", "DestinationID", _round("Tij", 9), _round("Gij", 9))


def huff_probability(spark: SparkSession, sf_dir: str) -> DataFrame:
    od_df, origins_df, facilities_df = _study(spark, sf_dir)
    layout = measure_layout(origins_df, facilities_df)
    huff = ops.huff_probability(od_df, facilities_df, layout=layout)
    return huff.select("OriginID", "DestinationID", _round("Huff_ij", 9))


def _ratio(method: str) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        ratios, name, keys = _ratio_table(spark, sf_dir, method)
        return ratios.select(*keys, _round(name, 9))

    return query


def _ratio_table(spark: SparkSession, sf_dir: str, method: str, study=None, layout: Layout | None = None):
    od_df, origins_df, facilities_df = study or _study(spark, sf_dir)
    layout = layout or measure_layout(origins_df, facilities_df)
    pairs = ops.within_catchment(od_df)
    per_facility = ["DestinationID"]
    if method == "2sfca":
        return ops.rj_2sfca(pairs, origins_df, facilities_df, layout=layout), "Rj", per_facility
    if method == "e2sfca":
        return ops.rj_e2sfca(pairs, origins_df, facilities_df, layout=layout), "Rj", per_facility
    if method == "m2sfca":
        rij = ops.rij_m2sfca(pairs, origins_df, facilities_df, layout=layout)
        return rij, "Rij", ["OriginID", "DestinationID"]
    if method == "3sfca":
        chosen = ops.selection_weights(pairs, layout=layout)
        return ops.rj_3sfca(chosen, origins_df, facilities_df, layout=layout), "Rj", per_facility
    huff = ops.huff_probability(pairs, facilities_df, layout=layout)
    return ops.rj_e3sfca(huff, origins_df, facilities_df, layout=layout), "Rj", per_facility


def _spai(method: str) -> Query:
    """The score of one method before completion, so only for origins that reach a facility."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        od_df, origins_df, facilities_df = study = _study(spark, sf_dir)
        layout = measure_layout(origins_df, facilities_df)
        pairs = ops.within_catchment(od_df)
        ratios, _, _ = _ratio_table(spark, sf_dir, method, study, layout)
        if method == "2sfca":
            scores = ops.spai_2sfca(pairs, ratios, origins_df, layout=layout)
        elif method == "e2sfca":
            scores = ops.spai_e2sfca(pairs, ratios, origins_df, layout=layout)
        elif method == "m2sfca":
            scores = ops.spai_m2sfca(ratios, origins_df)
        elif method == "3sfca":
            chosen = ops.selection_weights(pairs, layout=layout)
            scores = ops.spai_3sfca(chosen, ratios, origins_df, layout=layout)
        else:
            huff = ops.huff_probability(pairs, facilities_df, layout=layout)
            scores = ops.spai_e3sfca(huff, ratios, origins_df, layout=layout)
        return _rounded_scores(scores)

    return query


def spai_completion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """At 3 minutes many origins reach nothing and are filled in with 0."""
    params = Params(d0=3.0)
    od_df, origins_df, facilities_df = _study(spark, sf_dir)
    layout = measure_layout(origins_df, facilities_df)
    pairs = ops.within_catchment(od_df, params)
    rj = ops.rj_e2sfca(pairs, origins_df, facilities_df, params, layout=layout)
    scores = ops.spai_e2sfca(pairs, rj, origins_df, params, layout=layout)
    return _rounded_scores(ops.complete_scores(scores, origins_df, "SPAI_e2sfca"))


def spai_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two methods computed apart and merged, without completion."""
    return ops.merge_scores([_spai("2sfca")(spark, sf_dir), _spai("e3sfca")(spark, sf_dir)])


def _accessibility(facility_source=facilities, scale: float | None = None, **options) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        scores = accessibility(
            od(spark, sf_dir),
            origins(spark, sf_dir),
            facility_source(spark, sf_dir),
            scale=scale or 1.0,
            **options,
        )
        if scale is None:
            return _rounded_scores(scores)
        return scores.select("pointid", *[_round(c, 3) for c in scores.columns[1:]])

    return query


def accessibility_stepwise(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded_scores(accessibility_by_steps(*_study(spark, sf_dir)))


def accessibility_bucketed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two studies over routes stored in buckets by origin; the second asks for nearer facilities only."""
    folder, table = shared_folder(spark, "study"), f"study_{uuid.uuid4().hex}"
    routes_there = ops.store_by_origin(od(spark, sf_dir), table, buckets=16, d0=30.0, path=folder)
    wide = accessibility(routes_there, origins(spark, sf_dir), facilities(spark, sf_dir))
    near = accessibility(
        routes_there, origins(spark, sf_dir), facilities(spark, sf_dir), methods=["e2sfca"], params=Params(d0=3.0)
    ).withColumnRenamed("SPAI_e2sfca", "SPAI_near")
    return _rounded_scores(wide.join(near, "pointid"))


def hot_origins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers with over 60 order lines, by the search for keys that are to be cut into slices."""
    raw = order_lines(spark, sf_dir).select(F.col("o_custkey").alias("OriginID"))
    hot = hot_keys(raw, "OriginID", 60)
    return hot.join(raw, "OriginID").groupBy("OriginID").agg(F.count("*").alias("n_rows")).filter("n_rows > 60")


def dedupe_od(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines repeat pairs of customer and supplier."""
    raw = order_lines(spark, sf_dir).select(
        F.col("o_custkey").alias("OriginID"), "l_suppkey", F.col("l_quantity").alias("Total_time")
    )
    return ops.dedupe_od(od_table(raw, destination_id_col="l_suppkey"))


def repeated_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = order_lines(spark, sf_dir).select(
        F.col("o_custkey").alias("OriginID"), "l_suppkey", F.col("l_quantity").alias("Total_time")
    )
    return ops.repeated_keys(
        od_table(raw, destination_id_col="l_suppkey"), "OriginID", "DestinationID"
    )


def entry(spark: SparkSession) -> DataFrame:
    """All five methods on the smallest tables."""
    return accessibility(*_study(spark, SMOKE_DIR))


def queries() -> dict[str, Query]:
    known = {
        "parse_destination_id": parse_destination_id,
        "parse_last_word": parse_last_word,
        "load_od": load_od,
        "load_od_ready_id": load_od_ready_id,
        "load_origins": load_origins,
        "load_facilities": load_facilities,
        "catchment_filter": catchment_filter,
        "decay_gaussian": _decay(lambda t: gaussian_weight(t, 30, 15)),
        "decay_linear": _decay(lambda t: linear_weight(t, 30)),
        "decay_binary": _decay(lambda t: binary_weight(t, 30)),
        "selection_weights": selection_weights,
        "huff_probability": huff_probability,
        "rj_2sfca": _ratio("2sfca"),
        "rj_e2sfca": _ratio("e2sfca"),
        "rij_m2sfca": _ratio("m2sfca"),
        "rj_3sfca": _ratio("3sfca"),
        "rj_e3sfca": _ratio("e3sfca"),
        "spai_2sfca": _spai("2sfca"),
        "spai_e2sfca": _spai("e2sfca"),
        "spai_m2sfca": _spai("m2sfca"),
        "spai_3sfca": _spai("3sfca"),
        "spai_e3sfca": _spai("e3sfca"),
        "spai_completion": spai_completion,
        "spai_merge": spai_merge,
        "accessibility_all": _accessibility(),
        "accessibility_2sfca": _accessibility(methods=["2sfca"]),
        "accessibility_e2sfca": _accessibility(methods=["e2sfca"]),
        "accessibility_linear": _accessibility(params=LINEAR),
        "accessibility_scaled": _accessibility(scale=1e6),
        "accessibility_stepwise": accessibility_stepwise,
        "accessibility_shuffled": _accessibility(layout=Layout()),
        "accessibility_sliced": _accessibility(layout=Layout(slice_rows=20)),
        "accessibility_stored": _accessibility(store=True),
        "accessibility_bucketed": accessibility_bucketed,
        "hot_origins": hot_origins,
        "accessibility_gaps": _accessibility(facility_source=facilities_with_gaps),
        "accessibility_gaps_stepwise": accessibility_gaps_stepwise,
        "dedupe_od": dedupe_od,
        "repeated_pairs": repeated_pairs,
        "accessibility_no_demand": no_demand("inf"),
        "accessibility_no_demand_zero": no_demand("zero"),
        "accessibility_missing_times": missing_times,
        "accessibility_unknown_origins": unknown_origins,
    }
    return known | llm.QUERIES | {"pipeline": corpus_pipeline.run} if llm else known


def no_demand(zero_demand: str) -> Query:
    """Within 5 minutes of most suppliers lives nobody: only customers with a full account count as people."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        people = F.floor(F.greatest(F.col("c_acctbal") - 9000, F.lit(0.0)))
        few = _scan(spark, sf_dir, "customer").select(
            (F.col("c_custkey") + 100000).alias("pointid"),
            people.alias("grid_code"),
            F.col("c_custkey").alias("OriginID_Point"),
        )
        params = Params(d0=5.0, zero_demand=zero_demand)
        od_df, places = od(spark, sf_dir), facilities(spark, sf_dir)
        return _rounded_scores(accessibility(od_df, origin_table(few), places, params=params))

    return query


def missing_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """No time is known for the routes whose smallest quantity is 7."""
    known = routes(spark, sf_dir).withColumn("Total_time", F.nullif(F.col("Total_time"), F.lit(7.0)))
    return _rounded_scores(accessibility(od_table(known), origins(spark, sf_dir), facilities(spark, sf_dir)))


def unknown_origins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers in debt are on routes but not among the origins."""
    solvent = _scan(spark, sf_dir, "customer").filter(F.col("c_acctbal") >= 0).select(
        (F.col("c_custkey") + 100000).alias("pointid"),
        F.floor("c_acctbal").alias("grid_code"),
        F.col("c_custkey").alias("OriginID_Point"),
    )
    return _rounded_scores(accessibility(od(spark, sf_dir), origin_table(solvent), facilities(spark, sf_dir)))


def accessibility_gaps_stepwise(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded_scores(
        accessibility_by_steps(
            od(spark, sf_dir), origins(spark, sf_dir), facilities_with_gaps(spark, sf_dir)
        )
    )


# ---------------------------------------------------------------- SQL

_LINES = "lineitem JOIN orders ON l_orderkey = o_orderkey"

_ROUTES = f"""
routes AS (
  SELECT o_custkey AS o, CAST(l_suppkey AS VARCHAR) AS d, min(l_quantity) AS t
  FROM {_LINES} GROUP BY o_custkey, l_suppkey
)"""

_PEOPLE = """
people AS (
  SELECT c_custkey + 100000 AS pointid, c_custkey AS o, floor(greatest(c_acctbal, 0)) AS p FROM customer
)"""

_SUPPLY = """
supply AS (
  SELECT CAST(s_suppkey AS VARCHAR) AS d, floor(greatest(s_acctbal, 0)) AS s FROM supplier
)"""

_SUPPLY_GAPS = """
supply AS (
  SELECT CAST(s_suppkey AS VARCHAR) AS d, CASE WHEN s_acctbal >= 0 THEN floor(s_acctbal) END AS s
  FROM supplier WHERE s_acctbal < 9000
)"""

_GAUSSIAN = "exp(-(t / 15.0::DOUBLE) * (t / 15.0::DOUBLE))"
_LINEAR = "(30.0::DOUBLE - t) / 30.0::DOUBLE"


_FEW_PEOPLE = _PEOPLE.replace("c_acctbal, 0", "c_acctbal - 9000, 0")
_SOLVENT = _PEOPLE.replace("FROM customer", "FROM customer WHERE c_acctbal >= 0")
_ROUTES_WITH_GAPS = _ROUTES.replace("min(l_quantity)", "nullif(min(l_quantity), 7)")


def _steps(
    d0: int = 30, decay: str = _GAUSSIAN, supply: str = _SUPPLY, people: str = _PEOPLE, routes: str = _ROUTES
) -> str:
    """Pairs with both shares, all ratios and all scores, one WITH clause."""
    return f"""
WITH {routes}, {people}, {supply},
pairs AS (
  SELECT r.o, r.d, t, {decay} AS f, supply.d IS NOT NULL AS known, s
  FROM routes r LEFT JOIN supply ON r.d = supply.d WHERE t <= {d0}
),
totals AS (
  SELECT o, sum(f) AS tf, sum(s * f) AS tsf, bool_or(known AND s IS NULL) AS gap FROM pairs GROUP BY o
),
shares AS (
  SELECT pairs.*,
         CASE WHEN tf > 0 THEN f / tf ELSE 0 END AS g,
         CASE WHEN NOT known THEN NULL WHEN gap THEN 0 WHEN tsf > 0 THEN s * f / tsf ELSE 0 END AS h
  FROM pairs JOIN totals ON pairs.o = totals.o
),
demand AS (
  SELECT d, sum(p) AS d2, sum(p * f) AS de2, sum(g * p * f) AS d3, coalesce(sum(h * p * f), 0) AS de3
  FROM shares JOIN people ON shares.o = people.o GROUP BY d
),
ratios AS (
  SELECT demand.d, s,
         CASE WHEN d2 > 0 THEN s / d2 WHEN s > 0 THEN 'inf'::DOUBLE END AS r2,
         CASE WHEN de2 > 0 THEN s / de2 WHEN s > 0 THEN 'inf'::DOUBLE END AS re2,
         CASE WHEN de2 > 0 THEN coalesce(s, 0) / de2 ELSE 0 END AS rm2,
         CASE WHEN d3 > 0 THEN coalesce(s, 0) / d3 ELSE 0 END AS r3,
         CASE WHEN de3 > 0 THEN s / de3 ELSE 0 END AS re3
  FROM demand LEFT JOIN supply ON demand.d = supply.d
),
scores AS (
  SELECT shares.o, coalesce(sum(r2), 0) AS s2,
         coalesce(sum(CASE WHEN f > 0 OR isfinite(re2) THEN re2 * f END), 0) AS se2,
         coalesce(sum(rm2 * f * f), 0) AS sm2, coalesce(sum(g * r3 * f), 0) AS s3,
         coalesce(sum(h * re3 * f), 0) AS se3, count(h) AS n_known
  FROM shares LEFT JOIN ratios ON shares.d = ratios.d GROUP BY shares.o
)"""


_SCORE_OF = {"2sfca": "s2", "e2sfca": "se2", "m2sfca": "sm2", "3sfca": "s3", "e3sfca": "se3"}
_RATIO_OF = {"2sfca": "r2", "e2sfca": "re2", "3sfca": "r3"}


def _score_columns(methods=METHODS, default: str = "0") -> str:
    return ", ".join(
        f"round(coalesce({_SCORE_OF[m]}, {default}) * 1000000, 3) AS SPAI_{m}" for m in methods
    )


def _all_scores(methods=METHODS, **options) -> str:
    return (
        _steps(**options)
        + f" SELECT pointid, {_score_columns(methods)} FROM people LEFT JOIN scores ON people.o = scores.o"
    )


def _reached_scores(method: str) -> str:
    known = " WHERE n_known > 0" if method == "e3sfca" else ""
    return (
        _steps()
        + f" SELECT pointid, {_score_columns([method])} FROM scores JOIN people ON people.o = scores.o{known}"
    )


def _decay_sql(weight: str) -> str:
    return f"WITH {_ROUTES} SELECT o AS OriginID, d AS DestinationID, round({weight}, 9) AS f FROM routes"


def oracle_sql() -> dict[str, str]:
    # Python's white space: Unicode's, and the separators FS, GS, RS and US.
    blank = r"\s\x0B\x1c-\x1f\x85\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
    sql = {
        "parse_destination_id": f"""
            WITH {_ROUTES}
            SELECT 'Location ' || o || ' - Destination ' || d AS Name, d AS DestinationID FROM routes""",
        "parse_last_word": f"""
            SELECT doc_id,
                   nullif(regexp_extract(text, '([^{blank}]+)[{blank}]*$', 1), '') AS last_word
            FROM documents""",
        "load_od": f"WITH {_ROUTES} SELECT o AS OriginID, d AS DestinationID, t AS Total_time FROM routes",
        "load_od_ready_id": f"""
            WITH {_ROUTES} SELECT o AS OriginID, d AS DestinationID, t AS Total_time FROM routes""",
        "load_origins": f"""
            WITH {_PEOPLE}
            SELECT pointid, CAST(p AS DOUBLE) AS grid_code, o AS OriginID_Point FROM people""",
        "load_facilities": f"""
            WITH {_SUPPLY}
            SELECT CAST(d AS BIGINT) AS OBJECTID, CAST(s AS DOUBLE) AS capacity, d AS id_str FROM supply""",
        "catchment_filter": f"""
            WITH {_ROUTES}
            SELECT o AS OriginID, d AS DestinationID, t AS Total_time FROM routes WHERE t <= 30""",
        "decay_gaussian": _decay_sql(f"CASE WHEN t <= 30 THEN {_GAUSSIAN} ELSE 0 END"),
        "decay_linear": _decay_sql(f"greatest({_LINEAR}, 0)"),
        "decay_binary": _decay_sql("CASE WHEN t <= 30 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END"),
        "selection_weights": _steps()
        + " SELECT o AS OriginID, d AS DestinationID, round(f, 9) AS Tij, round(g, 9) AS Gij FROM shares",
        "huff_probability": _steps()
        + """ SELECT o AS OriginID, d AS DestinationID, round(h, 9) AS Huff_ij
              FROM shares WHERE known""",
        "rij_m2sfca": _steps()
        + """ SELECT pairs.o AS OriginID, pairs.d AS DestinationID, round(rm2 * f, 9) AS Rij
              FROM pairs JOIN ratios ON pairs.d = ratios.d""",
        "rj_e3sfca": _steps()
        + """ SELECT supply.d AS DestinationID, round(coalesce(re3, 0), 9) AS Rj
              FROM supply LEFT JOIN ratios ON supply.d = ratios.d""",
        "spai_completion": _all_scores(["e2sfca"], d0=3),
        "spai_merge": _steps()
        + f""" SELECT pointid, {_score_columns(["2sfca"])},
                      CASE WHEN n_known > 0 THEN round(se3 * 1000000, 3) END AS SPAI_e3sfca
               FROM scores JOIN people ON people.o = scores.o""",
        "accessibility_all": _all_scores(),
        "accessibility_2sfca": _all_scores(["2sfca"]),
        "accessibility_e2sfca": _all_scores(["e2sfca"]),
        "accessibility_linear": _all_scores(decay=_LINEAR),
        "accessibility_scaled": _all_scores(),
        "accessibility_stepwise": _all_scores(),
        "accessibility_shuffled": _all_scores(),
        "accessibility_sliced": _all_scores(),
        "accessibility_stored": _all_scores(),
        "accessibility_bucketed": f"""
            SELECT a.*, b.SPAI_e2sfca AS SPAI_near
            FROM ({_all_scores()}) a JOIN ({_all_scores(["e2sfca"], d0=3)}) b USING (pointid)""",
        "hot_origins": f"""
            SELECT o_custkey AS OriginID, count(*) AS n_rows FROM {_LINES} GROUP BY o_custkey HAVING count(*) > 60""",
        "accessibility_gaps": _all_scores(supply=_SUPPLY_GAPS),
        "accessibility_gaps_stepwise": _all_scores(supply=_SUPPLY_GAPS),
        "accessibility_no_demand": _all_scores(d0=5, people=_FEW_PEOPLE),
        "accessibility_no_demand_zero": _all_scores(d0=5, people=_FEW_PEOPLE).replace("'inf'::DOUBLE", "0"),
        "accessibility_missing_times": _all_scores(routes=_ROUTES_WITH_GAPS),
        "accessibility_unknown_origins": _all_scores(people=_SOLVENT),
        "dedupe_od": f"""
            SELECT o_custkey AS OriginID, CAST(l_suppkey AS VARCHAR) AS DestinationID,
                   min(l_quantity) AS Total_time
            FROM {_LINES} GROUP BY o_custkey, l_suppkey""",
        "repeated_pairs": f"""
            SELECT o_custkey AS OriginID, CAST(l_suppkey AS VARCHAR) AS DestinationID, count(*) AS n_rows
            FROM {_LINES} GROUP BY o_custkey, l_suppkey HAVING count(*) > 1""",
    }
    for method, ratio in _RATIO_OF.items():
        sql[f"rj_{method}"] = (
            _steps() + f" SELECT d AS DestinationID, round({ratio}, 9) AS Rj FROM ratios"
        )
    for method in METHODS:
        sql[f"spai_{method}"] = _reached_scores(method)
    if not llm:
        return sql
    whole = {"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {}
    return sql | llm.ORACLE_SQL | whole
