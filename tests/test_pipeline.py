from __future__ import annotations

import math

import pytest
from fixtures import SCORES_A, SCORES_B, tables, tables_a, tables_b
from pyspark.sql import functions as F

from isoreach import METHODS, Layout, Params, accessibility, accessibility_by_steps

LAYOUTS = {
    "measured": None,
    "shuffled": Layout(),
    "every key sliced": Layout(slice_rows=1),
    "broadcast": Layout(small_origins=True, small_facilities=True),
}


def scores(df):
    return {row[0]: tuple(row)[1:] for row in df.collect()}


def assert_scores(got, wanted, rel=1e-9):
    assert got.keys() == wanted.keys()
    for key, values in wanted.items():
        assert got[key] == pytest.approx(values, rel=rel), key


@pytest.mark.parametrize("layout", LAYOUTS.values(), ids=LAYOUTS.keys())
def test_worked_examples(spark, layout):
    assert_scores(scores(accessibility(*tables_a(spark), layout=layout)), SCORES_A)
    assert_scores(scores(accessibility(*tables_b(spark), layout=layout)), SCORES_B)


@pytest.mark.parametrize("name", ["measured", "every key sliced"])
def test_worked_examples_by_steps(spark, name):
    assert_scores(scores(accessibility_by_steps(*tables_b(spark), layout=LAYOUTS[name])), SCORES_B)


@pytest.mark.parametrize("method", METHODS)
def test_one_method_alone_equals_its_column_of_the_full_run(spark, method):
    alone = scores(accessibility(*tables_b(spark), methods=[method]))
    column = METHODS.index(method)
    assert_scores(alone, {key: (values[column],) for key, values in SCORES_B.items()})


def test_zero_demand_can_count_as_nothing(spark):
    got = scores(accessibility(*tables_b(spark), params=Params(zero_demand="zero")))
    assert got[104] == (0.0, 0.0, 0.0, 0.0, 0.0)
    assert got[106] == pytest.approx(SCORES_B[106], rel=1e-9)


def test_scale_multiplies_every_score(spark):
    got = scores(accessibility(*tables_a(spark), scale=1e6))
    assert_scores(got, {k: tuple(1e6 * v for v in vs) for k, vs in SCORES_A.items()})


@pytest.mark.parametrize("methods", [[], ["4sfca"], ["2sfca", "2sfca"]])
@pytest.mark.parametrize("plan", [accessibility, accessibility_by_steps])
def test_bad_methods(spark, plan, methods):
    with pytest.raises(ValueError, match="methods"):
        plan(*tables_a(spark), methods=methods)


def test_very_narrow_decay_keeps_far_shares(spark):
    """Weights whose product is no longer a double: with one facility in reach the share is still 1."""
    od, origins, facilities = tables(spark, [(1, 5, 28.0)], [(101, 100.0, 1)], [(5, 10.0)])
    got = scores(accessibility(od, origins, facilities, params=Params(decay_f=1.4)))
    assert got[101] == pytest.approx((0.1,) * 2 + (0.1 * math.exp(-400),) + (0.1,) * 2)


@pytest.mark.parametrize(
    "layout", [Layout(True, True), Layout(False, True), Layout(True, False), Layout(slice_rows=2)], ids=str
)
def test_narrow_decay_in_every_layout(spark, layout):
    """The fused plan keeps its passes and says what the steps say, unknown origins and destinations included."""
    tables_of_b, params = tables_b(spark), Params(decay_f=1.6)
    got = scores(accessibility(*tables_of_b, params=params, layout=layout))
    assert_scores(got, scores(accessibility_by_steps(*tables_of_b, params=params)))


def test_unknown_columns_do_not_matter_and_ids_may_be_text(spark):
    od, origins, facilities = tables_a(spark)
    od = od.withColumn("OriginID", F.concat(F.lit("o"), "OriginID")).withColumn("extra", F.lit(1))
    origins = origins.withColumn("OriginID_Point", F.concat(F.lit("o"), "OriginID_Point"))
    origins = origins.withColumn("pointid", F.concat(F.lit("CZ"), "pointid"))
    got = scores(accessibility(od, origins, facilities.withColumn("extra", F.lit(2))))
    assert_scores(got, {f"CZ{k}": v for k, v in SCORES_A.items()})
