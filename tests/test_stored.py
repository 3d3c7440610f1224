"""Pairs that are stored between passes, in buckets, or summarised by their frequent keys."""

from __future__ import annotations

import re

import numpy as np
import pytest
from fixtures import tables_b
from pyspark.sql import functions as F
from test_plans import final_plan_of, plan_of

from isoreach import Layout, Params, accessibility, measure_layout, run
from isoreach import operators as ops
from isoreach.operators.lookup import hot_keys
from isoreach.sources import read_facilities, read_od, read_origins
from isoreach.storage import shared_folder

SMALL = Layout(small_origins=True, small_facilities=True)


@pytest.fixture(scope="module")
def as_csv(spark, tmp_path_factory):
    """Random routes, origins and facilities as text files, with ids and times that are missing."""
    root, draw = tmp_path_factory.mktemp("csv"), np.random.default_rng(8)
    pairs = {(int(i), int(j)) for i, j in zip(draw.integers(1, 80, 900), draw.zipf(1.5, 900) % 25 + 1, strict=True)}
    od = [(i, f"Location {i} - Destination {j}", float(draw.integers(1, 45))) for i, j in sorted(pairs)]
    od += [(3, "", 5.0), (3, None, 6.0), (4, "Location 4 - Destination 5 ", None)]
    spark.createDataFrame(od, "OriginID long, Name string, Total_time double").repartition(3).write.option("header", True).csv(f"{root}/od")
    people = [(1000 + i, float(draw.integers(0, 90)), i) for i in range(1, 78)]
    spark.createDataFrame(people, "pointid long, grid_code double, OriginID_Point long").write.option("header", True).csv(f"{root}/origins")
    places = [(j, float(draw.integers(0, 40)) if j % 9 else None) for j in range(1, 24)]
    spark.createDataFrame(places, "OBJECTID long, capacity double").write.option("header", True).csv(f"{root}/facilities")
    return root


def study(spark, root):
    return (
        read_od(spark, f"{root}/od", "csv"),
        read_origins(spark, f"{root}/origins", "csv"),
        read_facilities(spark, f"{root}/facilities", "csv"),
    )


def scores(df):
    return {r[0]: [round(x, 9) for x in r[1:]] for r in df.collect()}


def text_scans_of_routes(plan: str) -> int:
    return len([x for x in plan.splitlines() if "FileScan csv" in x and "Total_time" in x])


@pytest.mark.parametrize("layout", [SMALL, Layout(small_facilities=True), Layout(), Layout(small_origins=True)], ids=str)
def test_text_is_parsed_once(spark, as_csv, layout):
    tables = study(spark, as_csv)
    plain, stored = accessibility(*tables, layout=layout), accessibility(*tables, layout=layout, store=True)
    assert scores(stored) == scores(plain) and any(v != [0.0] * 5 for v in scores(plain).values())
    assert text_scans_of_routes(plan_of(plain)) >= 3 and text_scans_of_routes(plan_of(stored)) == 0
    writing = plan_of(ops.within_catchment(tables[0]).select("OriginID", "DestinationID", "Total_time"))
    assert text_scans_of_routes(writing) == 1


def test_stored_pairs_are_narrow_and_near(spark, as_csv):
    od = study(spark, as_csv)[0].withColumn("note", F.lit("x"))
    kept = ops.store_pairs(od, Params(d0=20))
    assert kept.columns == ["OriginID", "DestinationID", "Total_time"]
    assert kept.count() == od.filter("Total_time <= 20").count() > 0
    assert kept.filter("Total_time > 20").count() == 0


@pytest.mark.parametrize("slice_rows", [50_000_000, 5])
def test_studies_over_buckets(spark, as_csv, slice_rows, tmp_path):
    """Several studies over one stored table: equal scores, and no pair leaves its bucket."""
    tables = study(spark, as_csv)
    name = f"routes_{slice_rows}"
    made = ops.store_by_origin(tables[0], name, buckets=6, d0=30.0, slice_rows=slice_rows, path=str(tmp_path / "study"))
    assert made.hot.count() == (0 if slice_rows > 1000 else tables[0].filter("Total_time <= 30").groupBy("OriginID").count().filter("count > 5").count())
    again = ops.open_by_origin(spark, name)
    # The last decay is so narrow that totals are attached to the pairs.
    studies = [(Params(), SMALL), (Params(d0=12, decay="linear"), Layout(False, True, slice_rows)), (Params(d0=25, decay_f=1), Layout(False, False, slice_rows))]
    for params, layout in studies:
        got = accessibility(again, *tables[1:], params=params, layout=layout)
        assert scores(got) == scores(accessibility(*tables, params=params, layout=SMALL))
    with pytest.raises(ValueError, match="not stored"):
        accessibility(again, *tables[1:], params=Params(d0=31))
    spark.range(1).write.mode("overwrite").saveAsTable("no_study")
    with pytest.raises(ValueError, match="store_by_origin"):
        ops.open_by_origin(spark, "no_study")
    spark.sql(f"DROP TABLE {name}")
    spark.sql(f"DROP TABLE {name}_hot")
    spark.sql("DROP TABLE no_study")


def test_buckets_spare_the_shuffle_of_pairs(spark, as_csv, tmp_path):
    tables = study(spark, as_csv)
    made = ops.store_by_origin(tables[0], "spared", buckets=6, path=str(tmp_path / "study"))
    for layout in (SMALL, Layout(small_facilities=True)):
        plan = plan_of(accessibility(made, *tables[1:], layout=layout))
        assert "REPARTITION" not in plan and "Bucketed: true" in plan
        lines = plan.splitlines()
        for number, line in enumerate(lines):
            # Rows with a decay of their own are pairs; of them, only sums go on.
            if re.search(r"Exchange hashpartitioning\((OriginID|DestinationID)", line) and re.search(r"[\[ ]_f#", " ".join(lines[number + 1 : number + 3])):
                assert "HashAggregate" in lines[number + 1], line
            # What goes on by origin alone has been summed by origin and slice before, from the buckets.
            if "Exchange hashpartitioning(OriginID" in line and "partial_sum" in lines[number + 1]:
                assert "_slice" in lines[number + 2], line
    spark.sql("DROP TABLE spared")
    spark.sql("DROP TABLE spared_hot")


def test_run_stores_text_and_counts(spark, as_csv, tmp_path):
    for n, options in enumerate(({}, {"store": False}, {"dedupe": True, "infinity": "inf"})):
        kept = run(
            spark, f"{as_csv}/od", f"{as_csv}/origins", f"{as_csv}/facilities", f"{tmp_path}/{n}", fmt="csv", count_pairs=True, **options
        )
        assert kept == study(spark, as_csv)[0].filter("Total_time <= 30 AND OriginID IS NOT NULL").count()
        got = spark.read.option("header", True).csv(f"{tmp_path}/{n}")
        assert got.count() == 77


def test_infinite_scores_in_another_word(spark, tmp_path):
    tables = tables_b(spark)
    whole = accessibility(*tables)
    from isoreach.sources import write_csv

    for word, path in (("Infinity", f"{tmp_path}/a"), ("inf", f"{tmp_path}/b")):
        write_csv(whole, path, infinity=word)
        texts = {r.pointid: r.SPAI_2sfca for r in spark.read.option("header", True).csv(path).collect()}
        assert texts["104"] == word and float(texts["101"]) == pytest.approx(0.171929824561)


# ---------------------------------------------------------------- layout and hot keys


def test_layout_is_measured_in_bytes(spark):
    numbers = spark.range(1000).select(F.col("id").alias("OriginID_Point"), F.col("id").alias("pointid"), F.lit(1.0).alias("grid_code"))
    texts = numbers.withColumn("OriginID_Point", F.concat(F.lpad(F.col("pointid").cast("string"), 9, "0"), F.lit("x" * 10_000)))
    places = spark.range(3).select(F.col("id").cast("string").alias("id_str"), F.lit(1.0).alias("capacity"))
    of = lambda table: measure_layout(table, places, broadcast_bytes=1 << 20)
    assert of(numbers).small_origins and of(numbers).small_facilities
    assert not of(texts).small_origins and of(texts).small_facilities
    assert not measure_layout(numbers, places, broadcast_bytes=1000).small_origins
    assert measure_layout(numbers.limit(0), places, broadcast_bytes=1000).small_origins


@pytest.mark.parametrize("kind", ["long", "string"])
def test_no_hot_key_is_missed(spark, kind):
    """Keys far over, just over and just under the limit, among many that occur once; dealt over all partitions."""
    draw, limit = np.random.default_rng(2), 500
    keys = np.concatenate([np.full(40_000, 7), np.full(501, 8), np.full(500, 9), np.repeat(np.arange(100, 140), 450), np.arange(10_000, 90_000)])
    pairs = spark.createDataFrame([(int(k),) for k in draw.permutation(keys)], "k long").select(F.col("k").cast(kind).alias("k")).repartition(7)
    hot = {str(r.k): r._slices for r in hot_keys(pairs.unionByName(spark.range(900).select(F.lit(None).cast(kind).alias("k"))), "k", limit).collect()}
    assert hot["7"] >= 80 and hot["8"] >= 2
    assert set(hot) <= {"7", "8", "9", *map(str, range(100, 140))}


def test_hot_keys_take_one_scan_and_are_literals(spark, tmp_path):
    spark.range(5000).select((F.col("id") % 10).alias("k"), F.col("id").alias("v")).write.parquet(f"{tmp_path}/p")
    hot = hot_keys(spark.read.parquet(f"{tmp_path}/p"), "k", 100)
    assert hot.count() == 10 and "FileScan" not in plan_of(hot) and "Exchange" not in plan_of(hot)


def test_slices_are_bounded_from_below(spark):
    """However low the limit, a key needs a share of its bucket's rows to be cut."""
    pairs = spark.range(200_000).select((F.col("id") % 20_000).alias("k"))
    assert hot_keys(pairs, "k", 1).count() <= 16 * 4682


# ---------------------------------------------------------------- shares


@pytest.mark.parametrize("share", ["selection", "huff"])
def test_shares_leave_pairs_where_totals_are_small(spark, as_csv, share):
    od, origins, facilities = study(spark, as_csv)

    def made(layout):
        if share == "selection":
            return ops.selection_weights(ops.within_catchment(od), layout=layout)
        return ops.huff_probability(od, facilities, layout=layout)

    key = ["OriginID", "DestinationID", "Total_time"]
    want = sorted((tuple(r[c] for c in key), round(r[-1], 12)) for r in made(Layout(small_facilities=True)).na.drop(subset=key).collect())
    for layout in (SMALL, Layout(small_origins=True, small_facilities=True, broadcast_bytes=0)):
        got = made(layout)
        assert sorted((tuple(r[c] for c in key), round(r[-1], 12)) for r in got.na.drop(subset=key).collect()) == want
    plan = final_plan_of(made(SMALL))
    assert "Exchange hashpartitioning" not in plan and "REPARTITION" not in plan
    assert "REPARTITION" in plan_of(made(Layout(small_origins=True, small_facilities=True, broadcast_bytes=0)))


def test_shares_of_origins_that_the_table_has_not(spark):
    """Many routes of unknown origins: their totals are measured, not taken to be as few as the origins."""
    od = spark.range(20_000).select(F.col("id").alias("OriginID"), F.lit("5").alias("DestinationID"), F.lit(1.0).alias("Total_time"))
    layout = Layout(small_origins=True, small_facilities=True, broadcast_bytes=1 << 20)
    chosen = ops.selection_weights(od, layout=layout)
    assert "REPARTITION" in plan_of(chosen) and chosen.filter("Gij = 1.0").count() == 20_000


def test_totals_are_summed_where_the_pairs_lie(spark, as_csv):
    """Both tables large: one exchange of partial sums by origin, that of the scores."""
    plan = final_plan_of(accessibility(*study(spark, as_csv), layout=Layout()))
    lines = plan.splitlines()
    by_origin = [
        n for n, x in enumerate(lines) if re.search(r"Exchange hashpartitioning\(OriginID#\d+L?, 4\)", x) and "Reused" not in x
    ]
    partial = [n for n in by_origin if "partial_sum" in lines[n + 1] and "_slice" not in lines[n + 2]]
    assert len(partial) == 1
    dealt = [x for x in lines if "REPARTITION_BY_COL" in x and "Reused" not in x]
    assert len(dealt) == 2


def test_shared_folder_needs_a_shared_place(spark, monkeypatch):
    import isoreach.storage as storage

    monkeypatch.setattr(storage, "_base", lambda spark: None)
    monkeypatch.setattr(storage, "_is_local", lambda spark: False)
    assert not storage.can_store(spark)
    with pytest.raises(ValueError, match="checkpoint"):
        shared_folder(spark, "x")
