from __future__ import annotations

import __spark_entry__ as registered
import pytest
from fixtures import INF, ORIGINS_A, tables, tables_a, tables_b
from pyspark.sql import Observation
from pyspark.sql import functions as F

from isoreach import Columns, Layout, Params
from isoreach import operators as ops
from isoreach.operators.lookup import deal, hot_keys, hot_keys_together, sum_per_key

NAN = float("nan")
SMALL = Layout(small_origins=True, small_facilities=True)
SLICED = Layout(slice_rows=1)


def by_pair(df, value):
    return {(r["OriginID"], r["DestinationID"]): r[value] for r in df.collect()}


def by_facility(df):
    return {r["DestinationID"]: r["Rj"] for r in df.collect()}


def near(d0_pairs):
    return ops.within_catchment(d0_pairs)


def test_catchment_filter_is_inclusive_and_drops_missing_times(spark):
    rows = [(1, "x 1", 30.0), (1, "x 2", 30.0001), (1, "x 3", None), (1, "x 4", NAN), (1, "x 5", INF)]
    df = spark.createDataFrame(rows, "OriginID long, Name string, Total_time double")
    assert [r["Name"] for r in ops.within_catchment(df).collect()] == ["x 1"]


def test_catchment_filter_reports_the_rows_kept(spark):
    seen = Observation()
    ops.within_catchment(tables_a(spark)[0], observation=seen).write.format("noop").mode("overwrite").save()
    assert seen.get == {"pairs_kept": 4}


def test_selection_weights(spark):
    got = by_pair(ops.selection_weights(near(tables_a(spark)[0])), "Gij")
    wanted = {(1, "5"): 0.689974481, (1, "8"): 0.310025519, (2, "5"): 0.978378792, (2, "8"): 0.021621208}
    assert got == pytest.approx(wanted, abs=1e-9)


@pytest.mark.parametrize("layout", [Layout(), SLICED])
def test_selection_weights_count_unknown_facilities_and_keep_orphans(spark, layout):
    got = by_pair(ops.selection_weights(near(tables_b(spark)[0]), layout=layout), "Gij")
    assert got[2, "11"] == pytest.approx(0.43081542, abs=1e-8)
    assert got[7, "8"] == 1.0
    totals = {}
    for (origin, _), share in got.items():
        totals[origin] = totals.get(origin, 0.0) + share
    assert totals == pytest.approx({1: 1, 2: 1, 4: 1, 6: 1, 7: 1})


def test_selection_weights_without_origin_or_destination(spark):
    rows = [(None, "x 1", 3.0), (None, "x 2", 3.0), (1, None, 3.0), (1, "x 2", 3.0)]
    od = spark.createDataFrame(rows, "OriginID long, Name string, Total_time double").select(
        "OriginID", F.substring("Name", 3, 9).alias("DestinationID"), "Total_time"
    )
    got = by_pair(ops.selection_weights(od, layout=SLICED), "Gij")
    assert got == {(None, "1"): 0.0, (None, "2"): 0.0, (1, None): 0.5, (1, "2"): 0.5}


def test_selection_weights_of_zero_decay(spark):
    od = tables(spark, [(1, 5, 30.0)], ORIGINS_A, [(5, 1.0)])[0]
    got = by_pair(ops.selection_weights(od, Params(decay="linear")), "Gij")
    assert got == {(1, "5"): 0.0}


@pytest.mark.parametrize("layout", [SMALL, SLICED])
def test_huff_probability(spark, layout):
    od, _, facilities = tables_a(spark)
    got = by_pair(ops.huff_probability(od, facilities, layout=layout), "Huff_ij")
    wanted = {(1, "5"): 0.526687817, (1, "8"): 0.473312183, (2, "5"): 0.95767275, (2, "8"): 0.04232725}
    assert got == pytest.approx(wanted, abs=1e-8)


def test_huff_probability_with_gaps(spark):
    od, _, facilities = tables_b(spark)
    got = by_pair(ops.huff_probability(od, facilities), "Huff_ij")
    assert (2, "11") not in got
    assert got[6, "8"] == got[6, "10"] == 0.0
    assert got[4, "9"] == got[7, "8"] == 1.0


@pytest.mark.parametrize("layout", [SMALL, SLICED])
def test_ratios(spark, layout):
    od, origins, facilities = tables_a(spark)
    od = near(od)
    chosen = ops.selection_weights(od, layout=layout)
    huff = ops.huff_probability(od, facilities, layout=layout)
    got = {
        "2": by_facility(ops.rj_2sfca(od, origins, facilities, layout=layout)),
        "e2": by_facility(ops.rj_e2sfca(od, origins, facilities, layout=layout)),
        "3": by_facility(ops.rj_3sfca(chosen, origins, facilities, layout=layout)),
        "e3": by_facility(ops.rj_e3sfca(huff, origins, facilities, layout=layout)),
    }
    wanted = {
        "2": {"5": 0.066666667, "8": 0.133333333},
        "e2": {"5": 0.10619185, "8": 0.8127254},
        "3": {"5": 0.12999541, "8": 2.715485504},
        "e3": {"5": 0.148240927, "8": 1.777328786},
    }
    for method, ratios in wanted.items():
        assert got[method] == pytest.approx(ratios, rel=1e-7), method
    rij = by_pair(ops.rij_m2sfca(od, origins, facilities, layout=layout), "Rij")
    wanted = {(1, "5"): 0.055994158, (1, "8"): 0.192557208, (2, "5"): 0.088011684, (2, "8"): 0.014885585}
    assert rij == pytest.approx(wanted, rel=1e-7)


def test_ratios_with_gaps(spark):
    od, origins, facilities = tables_b(spark)
    od = near(od)
    two = by_facility(ops.rj_2sfca(od, origins, facilities))
    assert two.keys() == {"5", "8", "9", "10", "11"}
    assert two["9"] == INF and two["10"] is None and two["11"] is None
    assert by_facility(ops.rj_2sfca(od, origins, facilities, Params(zero_demand="zero")))["9"] == 0.0
    three = by_facility(ops.rj_3sfca(ops.selection_weights(od), origins, facilities))
    assert three["9"] == three["10"] == three["11"] == 0.0
    e3 = by_facility(ops.rj_e3sfca(ops.huff_probability(od, facilities), origins, facilities))
    assert e3.keys() == {"5", "8", "9", "10", "12"}
    assert not e3["9"] and not e3["10"] and e3["12"] == 0.0
    rij = by_pair(ops.rij_m2sfca(od, origins, facilities), "Rij")
    assert len(rij) == 9
    assert rij[4, "9"] == rij[6, "10"] == rij[2, "11"] == 0.0 and rij[7, "8"] > 0


def test_scores_before_completion(spark):
    od, origins, facilities = tables_b(spark)
    od = near(od)
    rj = ops.rj_2sfca(od, origins, facilities)
    got = {r[0]: r[1] for r in ops.spai_2sfca(od, rj, origins).collect()}
    # Origin 7 has routes but is not among the origins: it has no public id. 103 reaches nothing.
    assert got.keys() == {101, 102, 104, 106, None}
    assert got[104] == INF


def test_completion_and_merge(spark):
    origins = tables_a(spark)[1]
    scores = spark.createDataFrame([(101, 2.0), (102, NAN), (None, 9.0)], "pointid long, SPAI_x double")
    done = ops.complete_scores(scores, origins, "SPAI_x")
    assert sorted(map(tuple, done.collect())) == [(101, 2.0), (102, 0.0), (103, 0.0)]
    other = spark.createDataFrame([(101, 1.0), (109, 4.0)], "pointid long, SPAI_y double")
    merged = {r[0]: tuple(r)[1:] for r in ops.merge_scores([done, other]).collect()}
    assert merged == {101: (2.0, 1.0), 102: (0.0, None), 103: (0.0, None), 109: (None, 4.0)}


def test_dedupe_keeps_the_shortest_route(spark):
    rows = [(1, "5", 9.0), (1, "5", 4.0), (1, "5", NAN), (1, "5", None), (2, "5", 7.0), (3, "5", NAN)]
    od = spark.createDataFrame(rows, "OriginID long, DestinationID string, Total_time double")
    assert by_pair(ops.dedupe_od(od), "Total_time") == {(1, "5"): 4.0, (2, "5"): 7.0, (3, "5"): None}


def test_dedupe_keeps_routes_without_a_destination(spark):
    rows = [(1, None, 5.0), (1, None, 9.0), (1, "7", 3.0), (1, "7", 4.0)]
    od = spark.createDataFrame(rows, "OriginID long, DestinationID string, Total_time double")
    once = ops.dedupe_od(od)
    assert once.count() == 3
    ops.validate_od(once)
    wanted = [r.Gij for r in ops.selection_weights(od.filter("Total_time <> 4.0")).filter("DestinationID = '7'").collect()]
    assert [r.Gij for r in ops.selection_weights(once).filter("DestinationID = '7'").collect()] == wanted


@pytest.mark.parametrize("row", [(None, None), (5, None), (None, "8")])
def test_hot_keys_are_cut_whatever_the_other_id_is(spark, row):
    od = spark.range(2000).select(
        F.lit(row[0]).cast("long").alias("OriginID"), F.lit(row[1]).alias("DestinationID"), (F.col("id") / 100).alias("Total_time")
    )
    for key, other in (("OriginID", "DestinationID"), ("DestinationID", "OriginID")):
        assert deal(od, key, other, 50).pairs.select("_slice").distinct().count() >= 30


def test_layout_is_checked():
    with pytest.raises(ValueError, match="slice_rows"):
        Layout(slice_rows=0)


def test_validators(spark):
    od, origins, facilities = tables_b(spark)
    ops.validate_od(od)
    ops.validate_origins(origins)
    ops.validate_facilities(facilities)
    with pytest.raises(ValueError, match="pairs are repeated"):
        ops.validate_od(od.union(od.limit(1)))
    with pytest.raises(ValueError, match="OriginID is null"):
        ops.validate_od(od.withColumn("OriginID", F.lit(None).cast("long")))
    with pytest.raises(ValueError, match="OriginID_Point is repeated"):
        ops.validate_origins(origins.withColumn("OriginID_Point", F.lit(1)))
    with pytest.raises(ValueError, match="pointid is repeated"):
        ops.validate_origins(origins.withColumn("pointid", F.lit(1)))
    with pytest.raises(ValueError, match="id_str is null"):
        ops.validate_facilities(facilities.withColumn("id_str", F.lit(None).cast("string")))
    with pytest.raises(ValueError, match="id_str is repeated"):
        ops.validate_facilities(facilities.union(facilities))


def test_hot_keys_are_exact(spark):
    pairs = spark.range(1000).select(
        F.when(F.col("id") < 400, 1).when(F.col("id") < 500, 2).otherwise(F.col("id")).alias("k")
    )
    pairs = pairs.union(spark.range(300).select(F.lit(None).cast("long")))
    assert {tuple(r) for r in hot_keys(pairs, "k", 100).collect()} == {(1, 4)}
    assert {tuple(r) for r in hot_keys(pairs, "k", 99).collect()} == {(1, 5), (2, 2)}


def test_no_size_of_a_table_hides_hot_origins(spark, tmp_path):
    """Six million order lines: 50 customers have 61 of them, all others 60."""
    spark.range(100_000).select(F.col("id").alias("o_orderkey"), F.col("id").alias("o_custkey")).write.parquet(f"{tmp_path}/orders.parquet")
    lines = spark.range(6_000_050).select((F.col("id") % 100_000).alias("l_orderkey"), F.lit(1).alias("l_suppkey"), F.lit(1.0).alias("l_quantity"))
    lines.write.parquet(f"{tmp_path}/lineitem.parquet")
    found = {tuple(r) for r in registered.hot_origins(spark, str(tmp_path)).collect()}
    assert found == {(k, 61) for k in range(50)}


def test_more_hot_keys_than_are_broadcast(spark, monkeypatch):
    """They are all found and cut, by joins without a broadcast; several searches at once find what one finds."""
    pairs = spark.range(4000).select(
        F.when(F.col("id") % 2 == 0, 7).when(F.col("id") % 50 == 1, None).otherwise(F.col("id") % 40).alias("k"),
        F.col("id").alias("other"),
    )
    few = spark.range(90).select((F.col("id") % 2).alias("n"))
    searches = [(pairs, "k"), (few, "n"), (pairs, "other")]
    wanted = [sorted(map(tuple, t.collect())) for t in hot_keys_together(searches, 30)]
    lookup = spark.range(5, 60).select(F.col("id").alias("k"), (F.col("id") * 10).alias("v"))
    joined = sorted(map(str, pairs.join(lookup, "k", "left").collect()))
    monkeypatch.setattr("isoreach.operators.lookup._FEW", 5)
    made = hot_keys_together(searches, 30)
    assert [sorted(map(tuple, t.collect())) for t in made] == wanted and len(wanted[0]) > 10 and len(wanted[1]) == 2
    dealt = deal(pairs, "k", "other", slice_rows=30)
    attached = dealt.attach(lookup, "left").drop("_slice")
    assert "rightHint=(strategy=broadcast)" not in attached._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(map(str, attached.select("k", "other", "v").collect())) == joined
    assert dealt.pairs.filter("k = 7").select("_slice").distinct().count() > 30


def test_a_hot_key_is_spread_over_partitions(spark):
    """A third of all pairs on one key: no partition holds more than a slice or two of them."""
    pairs = spark.range(30_000).select(
        F.when(F.col("id") % 3 == 0, -1).otherwise(F.col("id")).alias("k"), F.col("id").alias("other")
    )
    dealt = deal(pairs, "k", "other", slice_rows=500)
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        sizes = dealt.pairs.filter("k = -1").groupBy(F.spark_partition_id()).count().collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert sum(r["count"] for r in sizes) == 10_000
    assert len(sizes) > 8 and max(r["count"] for r in sizes) < 2_500


@pytest.mark.parametrize("how", ["left", "inner"])
@pytest.mark.parametrize("small", [True, False])
def test_lookup_join_equals_a_plain_join(spark, how, small):
    pairs = spark.range(2000).select(
        F.when(F.col("id") % 3 == 0, 7)
        .when(F.col("id") % 50 == 1, None)
        .otherwise(F.col("id") % 40)
        .alias("k"),
        F.col("id").alias("other"),
    )
    lookup = spark.range(5, 60).select(F.col("id").alias("k"), (F.col("id") * 10).alias("v"))
    wanted = pairs.join(lookup, "k", how)
    got = ops.lookup_join(pairs, lookup, "k", "other", how, small=small, slice_rows=30)
    assert got.columns == wanted.columns
    assert sorted(map(str, got.collect())) == sorted(map(str, wanted.collect()))


def test_sums_of_dealt_pairs(spark):
    pairs = spark.range(1000).select((F.col("id") % 3).alias("k"), F.col("id").alias("other"))
    total = {"total": F.sum("other")}
    dealt = deal(pairs, "k", "other", slice_rows=50).pairs
    assert set(map(tuple, sum_per_key(dealt, "k", total).collect())) == set(
        map(tuple, sum_per_key(pairs, "k", total).collect())
    )


def test_other_column_names(spark):
    cols = Columns(origin="src", time="mins", destination="dst", point="code", population="inhabitants",
                   join_id="node", facility="hid", capacity="beds", facility_key="hid_text")
    od, origins, facilities = tables_a(spark)
    od = od.toDF("src", "dst", "mins")
    origins = origins.toDF("code", "inhabitants", "node")
    facilities = facilities.toDF("hid", "beds", "hid_text")
    rj = ops.rj_2sfca(ops.within_catchment(od, cols=cols), origins, facilities, cols=cols)
    assert {r["dst"]: r["Rj"] for r in rj.collect()} == pytest.approx({"5": 1 / 15, "8": 2 / 15})
