import random

import pytest

from tidewell.functions import statistic
from tidewell.types import MIN_VALUE, STATS

# The published test vector of the percentile functions.
P90 = [43, 54, 56, 61, 62, 66, 68, 69, 69, 70, 71, 72, 77, 78, 79, 85, 87, 88, 89, 93, 95, 96, 98, 99, 99]


def calc(spark, data, functions, **kw):
    df = spark.createDataFrame([(1, t, float(v), f) for t, v, f in data], "id long, time long, value double, flag long")
    return [(r["fn"], r["value"], r["time"], r["flag"]) for r in statistic.calculate(df, functions, **kw).orderBy("ord").collect()]


@pytest.mark.parametrize("fn,data,value,time", [
    ("average", [(0, 2)], 2, 0), ("average", [(0, 2), (5, 6)], 4, 5),
    ("median", [(0, 2)], 2, 0), ("median", [(0, 2), (999, 6)], 4, 999), ("median", [(0, 2), (999, 6), (777, 3)], 3, 777), ("median", [(0, 2), (999, 6), (777, 3), (778, 0)], 3, 777),
    ("sigma", [(0, 0), (999, 14)], 7, 999), ("minimum", [(0, 2), (999, 6), (777, 1)], 1, 777), ("maximum", [(0, 2), (999, 6), (777, 7)], 7, 777),
    ("count", [(0, 2), (999, 6), (777, 7)], 3, 999), ("minimum", [(1, 2), (2, 2)], 2, 2), ("maximum", [(1, 2), (2, 2)], 2, 2),
])
def test_vectors(spark, fn, data, value, time):
    assert calc(spark, [(t, v, 0) for t, v in data], [fn]) == [(fn, value, time, STATS)]


def test_percentile_vector(spark):
    got = calc(spark, [(i, v, 0) for i, v in enumerate(P90)], ["percentile90", "percentile99"])
    assert [v for _, v, _, _ in got] == [98, 99]


def test_calculator(spark):
    asked = ["Average", *statistic.available()[1:8], "nothing"]
    got = calc(spark, [(i, i, 5) for i in range(1, 101)], asked)
    assert [g[0] for g in got] == asked
    assert got[-1] == ("nothing", 0.0, 0, 0) and all(g[3] & STATS for g in got[:-1])
    assert dict((g[0], g[1]) for g in got)["median"] == 51 and got[1][3] == STATS | 5


def test_two_rows_take_the_flag_of_the_first(spark):
    assert calc(spark, [(9, 1, 4), (3, 5, 2)], ["median"]) == [("median", 3.0, 9, STATS | 2)]


def test_no_rows_give_no_result(spark):
    assert calc(spark, [], ["average", "median"]) == []


def test_all_negative(spark):
    assert calc(spark, [(1, -5, 0), (2, -3, 0)], ["maximum"])[0][1] == -3
    assert calc(spark, [(1, -5, 0), (2, -3, 0)], ["maximum"], compat_min_value=True)[0][1] == MIN_VALUE


@pytest.mark.parametrize("n", [3, 7, 1000, 30_000])
def test_percentiles_of_large_groups_are_exact(spark, n):
    rng = random.Random(n)
    data = [(t, rng.choice([rng.gauss(0, 1), 3.0, -1.5]), t % 7) for t in range(n)]
    rng.shuffle(data)
    got = calc(spark, data, ["median", "percentile90", "percentile99"])
    s = sorted((v, t, f) for t, v, f in data)
    for (_, v, t, f), p in zip(got, (0.5, 0.9, 0.99)):
        w = s[int(p * n)]
        assert (v, t, f) == (w[0], w[1], w[2] | STATS)


@pytest.mark.parametrize("large", [2, 40])
def test_groups_that_are_not_gathered(spark, large):
    """Both ways give the same, with ties in value and time, null groups and flags, infinite values and groups of one and two rows."""
    rng = random.Random(large)
    data = [(rng.choice([None, 1, 1, 1, 2]), rng.randrange(60), rng.choice([rng.gauss(0, 1), 3.0, -1.5, float("inf")]), rng.choice([None, 0, 1, 7])) for _ in range(3000)]
    data += [(3, 5, 1.0, 2)] + [(4, 9, 1.0, 1), (4, 2, 5.0, None)] + [(5, 7, 2.0, f) for f in (3, None, 3, 1)] + [(6, t, 1.0, t) for t in range(50)]
    df = spark.createDataFrame(data, "id long, time long, value double, flag long")
    ps = {"median": 0.5, "percentile90": 0.9, "percentile99": 0.99}
    aggs = lambda: [statistic.F.count(statistic.F.lit(1)).alias("n")]
    got = sorted(map(str, statistic.percentile_rows(df, ["id"], ps, aggs(), large=large).collect()))
    assert got == sorted(map(str, statistic.percentile_rows(df, ["id"], ps, aggs()).collect())) and len(got) == 7


def test_register(spark):
    from pyspark.sql import functions as F

    statistic.register("range", lambda: (F.max("value") - F.min("value"), F.max("time")))
    try:
        assert calc(spark, [(1, 2, 0), (2, 7, 0)], ["RANGE"])[0][1] == 5
        with pytest.raises(ValueError):
            statistic.register("median", lambda: (F.max("value"), F.max("time")))
    finally:
        statistic.FUNCTIONS.remove("range")
        statistic._AGGREGATES.pop("range")
