from __future__ import annotations

import math
import random

import pytest
from brute import brute_scores
from fixtures import tables
from pyspark.sql import functions as F

import __spark_entry__ as registered
from isoreach import METHODS, Layout, Params, accessibility, accessibility_by_steps

SF = "/root/testdata/sf0.001"
BROADCAST = Layout(small_origins=True, small_facilities=True)


def random_study(seed: int):
    """Skewed, with a hot origin and a hot facility, and every kind of gap."""
    rng = random.Random(seed)
    origin_ids, facility_ids = list(range(1, 41)), list(range(1, 16))
    pairs = {(rng.choice(origin_ids), rng.choice(facility_ids)) for _ in range(200)}
    pairs |= {(1, j) for j in facility_ids} | {(i, 1) for i in origin_ids}
    time = lambda: rng.choice([None, math.nan, 30.0, 0.0] + [round(rng.uniform(0, 40), 2)] * 20)
    od = [(i, j, time()) for i, j in sorted(pairs)]
    origins = [
        (1000 + i, rng.choice([0.0, None, math.nan] + [float(rng.randint(1, 500))] * 9), i)
        for i in origin_ids
        if i % 9 != 4
    ]
    facilities = [
        (j, rng.choice([0.0, None] + [float(rng.randint(1, 90))] * 9)) for j in facility_ids if j % 7 != 3
    ] + [(99, 5.0)]
    # A facility that only an empty place reaches, and one nobody with a population reaches twice over.
    return od + [(77, 98, 4.0)], origins + [(1077, 0.0, 77)], facilities + [(98, 8.0)]


@pytest.mark.parametrize(
    "seed, params, layout, plan",
    [
        (1, Params(), BROADCAST, accessibility),
        (2, Params(decay="linear"), BROADCAST, accessibility),
        (3, Params(d0=17.5, decay_f=6), Layout(slice_rows=3), accessibility),
        (4, Params(decay="linear"), Layout(small_facilities=True, slice_rows=5), accessibility),
        (5, Params(), Layout(small_origins=True, slice_rows=5), accessibility),
        (6, Params(decay="linear"), BROADCAST, accessibility_by_steps),
        (7, Params(), Layout(slice_rows=4), accessibility_by_steps),
    ],
)
def test_random_studies_against_brute_force(spark, seed, params, layout, plan):
    study = random_study(seed)
    wanted = brute_scores(*study, params)
    got = {r[0]: tuple(r)[1:] for r in plan(*tables(spark, *study), params=params, layout=layout).collect()}
    assert got.keys() == wanted.keys()
    for key, values in wanted.items():
        assert got[key] == pytest.approx(values, rel=1e-9), key
    assert any(math.isinf(v[0]) for v in wanted.values())


@pytest.fixture(scope="module")
def study(spark):
    return tuple(
        df.cache()
        for df in (registered.od(spark, SF), registered.origins(spark, SF), registered.facilities(spark, SF))
    )


def by_point(df):
    return {r[0]: tuple(r)[1:] for r in df.collect()}


def test_scores_spread_exactly_the_capacity(spark, study):
    """Population times score sums to the capacity; the modified method loses some of it."""
    od, origins, facilities = study
    scores = accessibility(od, origins, facilities, layout=BROADCAST)
    held = scores.join(origins, "pointid").agg(
        *[F.sum(F.col("grid_code") * F.col(f"SPAI_{m}")).alias(m) for m in METHODS]
    ).first()
    capacity = facilities.agg(F.sum("capacity")).first()[0]
    for method in METHODS:
        if method == "m2sfca":
            assert 0 < held[method] < capacity
        else:
            assert held[method] == pytest.approx(capacity, rel=1e-9), method


def test_scores_scale_with_supply_and_demand(spark, study):
    od, origins, facilities = study
    base = by_point(accessibility(od, origins, facilities, layout=BROADCAST))
    more = facilities.withColumn("capacity", F.col("capacity") * 2)
    for key, values in by_point(accessibility(od, origins, more, layout=BROADCAST)).items():
        assert values == pytest.approx([2 * v for v in base[key]], rel=1e-9)
    crowd = origins.withColumn("grid_code", F.col("grid_code") * 2)
    for key, values in by_point(accessibility(od, crowd, facilities, layout=BROADCAST)).items():
        assert values == pytest.approx([v / 2 for v in base[key]], rel=1e-9)


def test_order_and_partitioning_of_the_pairs_do_not_matter(spark, study):
    od, origins, facilities = study
    base = by_point(accessibility(od, origins, facilities, layout=BROADCAST))
    shuffled = od.orderBy(F.xxhash64("OriginID", "DestinationID")).repartition(7)
    for key, values in by_point(accessibility(shuffled, origins, facilities, layout=BROADCAST)).items():
        assert values == pytest.approx(base[key], rel=1e-9)
