"""The shape of the physical plans: what is read, what moves, and that nothing leaves the JVM."""

from __future__ import annotations

import re

import pytest
from fixtures import tables_b

from isoreach import Layout, accessibility, accessibility_by_steps
from isoreach.sources import read_facilities, read_od, read_origins

BROADCAST = Layout(small_origins=True, small_facilities=True)


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("stored")
    spark.createDataFrame(
        [(1, "Location 1 - Destination 5", 12.0, "x")], "OriginID long, Name string, Total_time double, note string"
    ).write.parquet(f"{root}/od")
    spark.createDataFrame(
        [(101, 10.0, 1, "x")], "pointid long, grid_code double, OriginID_Point long, note string"
    ).write.parquet(f"{root}/origins")
    spark.createDataFrame([(5, 3.0, "x")], "OBJECTID long, capacity double, note string").write.parquet(
        f"{root}/facilities"
    )
    return (
        read_od(spark, f"{root}/od"),
        read_origins(spark, f"{root}/origins"),
        read_facilities(spark, f"{root}/facilities"),
    )


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def final_plan_of(df) -> str:
    df.collect()
    return plan_of(df).split("== Initial Plan ==")[0]


def od_scans(plan: str) -> list[str]:
    return [line for line in plan.splitlines() if "FileScan" in line and "Total_time" in line]


def moved_pairs(plan: str) -> list[str]:
    """Exchanges whose rows are still pairs: the decay has not been summed below them."""
    lines = plan.splitlines()
    found = []
    for number, line in enumerate(lines):
        if re.search(r"[+:]- Exchange hashpartitioning\((OriginID|DestinationID)", line):
            below = lines[number + 1 : number + 4]
            if any("_f#" in x for x in below) and not any("partial_" in x for x in below):
                found.append(line)
    return found


@pytest.mark.parametrize("layout", [BROADCAST, Layout(small_facilities=True), Layout()])
@pytest.mark.parametrize("plan", [accessibility, accessibility_by_steps])
def test_everything_stays_in_the_jvm(stored, plan, layout):
    text = plan_of(plan(*stored, layout=layout))
    assert "EvalPython" not in text and "Pandas" not in text
    assert "CartesianProduct" not in text and "Window" not in text


def test_scans_read_only_what_they_need_and_filter(stored):
    for line in od_scans(plan_of(accessibility(*stored, layout=BROADCAST))):
        assert "LessThanOrEqual(Total_time,30.0)" in line
        assert "ReadSchema: struct<OriginID:bigint,Name:string,Total_time:double>" in line


def test_number_of_passes(stored):
    assert len(od_scans(final_plan_of(accessibility(*stored, layout=BROADCAST)))) == 3
    assert len(od_scans(final_plan_of(accessibility(*stored, methods=["e2sfca"], layout=BROADCAST)))) == 2


def test_small_tables_leave_the_pairs_where_they_are(stored):
    plan = plan_of(accessibility(*stored, layout=BROADCAST))
    assert not moved_pairs(plan)
    exchanges = re.findall(r"Exchange hashpartitioning\((\w+)#", plan)
    # Sums per origin (totals, scores) and per destination (demand), and the origins they are joined to.
    assert exchanges.count("DestinationID") <= 2


def dealt_by(plan: str, key: str) -> list[str]:
    pattern = rf"- Exchange hashpartitioning\({key}#\d+L?, _slice"
    return [x for x in plan.splitlines() if re.search(pattern, x) and "REPARTITION_BY_COL" in x]


def test_many_origins_move_the_pairs_once(stored):
    plan = final_plan_of(accessibility(*stored, layout=Layout(small_facilities=True)))
    assert len(dealt_by(plan, "OriginID")) == 1 and not dealt_by(plan, "DestinationID")
    # Besides the one that deals, only the pass that looks for hot origins reads the table.
    assert len(od_scans(plan)) <= 3


def test_many_facilities_move_the_pairs_once_more(stored):
    plan = final_plan_of(accessibility(*stored, layout=Layout()))
    assert len(dealt_by(plan, "OriginID")) == 1 and len(dealt_by(plan, "DestinationID")) == 1


def test_no_method_asks_for_facilities_twice_over(spark):
    """The fused plan of five methods has fewer joins than two methods by steps."""
    fused = plan_of(accessibility(*tables_b(spark), layout=BROADCAST))
    steps = plan_of(accessibility_by_steps(*tables_b(spark), methods=["2sfca", "3sfca"], layout=BROADCAST))
    count = lambda plan: len(re.findall(r"- \w*(?:HashJoin|SortMergeJoin)", plan))
    assert count(fused) < count(steps)
