from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from isoreach import Params
from isoreach.functions import (
    binary_weight,
    finite_or_zero,
    gaussian_weight,
    id_text,
    last_word,
    linear_weight,
    nan_safe_sum,
    positive_ratio,
    safe_ratio,
    weight,
)

INF, NAN = float("inf"), float("nan")


@pytest.fixture(params=["true", "false"], ids=["ansi", "no ansi"])
def ansi(spark, request):
    before = spark.conf.get("spark.sql.ansi.enabled")
    spark.conf.set("spark.sql.ansi.enabled", request.param)
    yield
    spark.conf.set("spark.sql.ansi.enabled", before)


def test_decay(spark):
    times = [0.0, 6.5, 29.999, 30.0, 30.001, 100.0, INF, NAN, None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(times)], "i int, t double")
    t = F.col("t")
    rows = df.orderBy("i").select(
        gaussian_weight(t, 30, 15), linear_weight(t, 30), binary_weight(t, 30)
    ).collect()
    inside = [time is not None and time <= 30 for time in times]
    for (gaussian, linear, binary), time, near in zip(rows, times, inside):
        assert gaussian == pytest.approx(math.exp(-((time / 15) ** 2)) if near else 0.0)
        assert linear == pytest.approx((30 - time) / 30 if near else 0.0)
        assert binary == (1.0 if near else 0.0)


def test_weight_follows_the_parameters(spark):
    df = spark.createDataFrame([(15.0,)], "t double")
    row = df.select(weight(F.col("t"), Params()), weight(F.col("t"), Params(decay="linear"))).first()
    assert tuple(row) == pytest.approx((math.exp(-1), 0.5))


@pytest.mark.parametrize(
    "bad", [{"d0": 0}, {"d0": float("nan")}, {"decay_f": -1}, {"decay": "cubic"}, {"zero_demand": "?"}]
)
def test_bad_parameters(bad):
    with pytest.raises(ValueError):
        Params(**bad)


def test_last_word_is_pythons_split(spark):
    spaces = [" ", "\t", "\n", "\x0b", "\x0c", "\r", "\x1c", "\x1d", "\x1e", "\x1f", "\x85", "\xa0"]
    spaces += [chr(c) for c in (0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)]
    spaces += [chr(c) for c in (0x180E, 0x200B, 0x2060, 0xFEFF)]  # these four are no white space
    words = ["5", "007", "-3", "+4", "1.50", "9223372036854775807", "99999999999999999999", "abc", "žluť"]
    samples = ["Location 1 - Destination 5", " a 7 ", "", " ", "\xa0", "a\nb 5\n", "5\t", "a b\x1c7", None]
    samples += [f"Location 1 - Destination{s}{w}" for s in spaces for w in words]
    samples += [f"x {w}{s}" for s in spaces for w in words] + words
    df = spark.createDataFrame([(i, s) for i, s in enumerate(samples)], "i int, s string")
    got = [row[0] for row in df.orderBy("i").select(last_word(F.col("s"))).collect()]
    wanted = [(s.split() or [None])[-1] if s is not None else None for s in samples]
    assert got == wanted


def test_id_text(spark):
    df = spark.createDataFrame([(5, 5.0, "A5")], "i int, d double, s string")
    row = df.select(id_text(df, "i"), id_text(df, "d"), id_text(df, "s")).first()
    assert tuple(row) == ("5", "5", "A5")


def test_ratios(spark, ansi):
    cases = [(1.0, 2.0), (1.0, 0.0), (-1.0, 0.0), (0.0, 0.0), (None, 2.0), (1.0, None), (3.0, -2.0), (INF, 2.0)]
    df = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "i int, n double, d double")
    n, d = F.col("n"), F.col("d")
    rows = df.orderBy("i").select(
        safe_ratio(n, d), safe_ratio(n, d, "zero"), positive_ratio(n, d)
    ).collect()
    assert [r[0] for r in rows] == [0.5, INF, -INF, None, None, None, -1.5, INF]
    assert [r[1] for r in rows] == [0.5, 0.0, 0.0, 0.0, 0.0, 0.0, -1.5, 0.0]
    assert [r[2] for r in rows] == [0.5, 0.0, 0.0, 0.0, None, 0.0, 0.0, INF]


def test_positive_ratio_refuses_nan(spark):
    df = spark.createDataFrame([(1.0, NAN)], "n double, d double")
    assert df.select(positive_ratio(F.col("n"), F.col("d"))).first()[0] == 0.0


def test_nan_safe_sum(spark):
    rows = [("a", 1.0), ("a", NAN), ("a", None), ("a", 2.0), ("b", None), ("b", NAN), ("c", INF), ("c", 1.0)]
    df = spark.createDataFrame(rows, "k string, x double")
    got = {r[0]: r[1] for r in df.groupBy("k").agg(nan_safe_sum(F.col("x"))).collect()}
    assert got == {"a": 3.0, "b": 0.0, "c": INF}


def test_finite_or_zero(spark):
    df = spark.createDataFrame([(i, x) for i, x in enumerate([1.5, None, NAN, INF, -INF])], "i int, x double")
    got = [r[0] for r in df.orderBy("i").select(finite_or_zero(F.col("x"))).collect()]
    assert got == [1.5, 0.0, 0.0, 0.0, 0.0]
