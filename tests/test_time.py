import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tidewell.functions import timeutil as tu
from tidewell.plans.rollup import next_fire
from tidewell.types import INTERVALS, MAX_TIME


def ms(*a):
    return int((dt.datetime(*a) - dt.datetime(1970, 1, 1)) / dt.timedelta(milliseconds=1))


T = ms(2017, 1, 1, 23, 59, 1, 1000)


@pytest.mark.parametrize("interval,start,end", [
    ("minute", ms(2017, 1, 1, 23, 59), ms(2017, 1, 2) - 1), ("halfhour", ms(2017, 1, 1, 23, 30), ms(2017, 1, 2) - 1), ("hour", ms(2017, 1, 1, 23), ms(2017, 1, 2) - 1),
    ("day", ms(2017, 1, 1), ms(2017, 1, 2) - 1), ("week", ms(2016, 12, 26), ms(2017, 1, 2) - 1), ("month", ms(2017, 1, 1), ms(2017, 2, 1) - 1), ("year", ms(2017, 1, 1), ms(2018, 1, 1) - 1),
    ("other", MAX_TIME, MAX_TIME),
])
def test_target_interval(spark, interval, start, end):
    r = spark.range(1).select(F.lit(T).cast("long").alias("t")).select(tu.target_interval("t", interval).alias("x")).first()["x"]
    assert (r["start"], r["end"]) == (start, end)


def test_halfhour_before_the_half(spark):
    t = ms(2017, 1, 1, 23, 3, 1)
    r = spark.range(1).select(F.lit(t).cast("long").alias("t")).select(tu.target_interval("t", "halfhour").alias("x")).first()["x"]
    assert (r["start"], r["end"]) == (ms(2017, 1, 1, 23), ms(2017, 1, 1, 23, 30) - 1)


def test_calendar_against_python(spark):
    rng = random.Random(5)
    times = [rng.randrange(ms(1890, 1, 1), ms(2200, 1, 1)) for _ in range(500)] + [0, -1, ms(2000, 2, 29), ms(1900, 3, 1) - 1]
    df = spark.createDataFrame([(t,) for t in times], "t long")
    for r in df.select("t", *[tu.bucket_start("t", i).alias(i) for i in INTERVALS]).collect():
        d = dt.datetime(1970, 1, 1) + dt.timedelta(milliseconds=r["t"])
        day = d.replace(hour=0, minute=0, second=0, microsecond=0)
        want = {"minute": d.replace(second=0, microsecond=0), "halfhour": d.replace(minute=d.minute // 30 * 30, second=0, microsecond=0), "hour": d.replace(minute=0, second=0, microsecond=0),
                "day": day, "week": day - dt.timedelta(days=day.weekday()), "month": day.replace(day=1), "year": day.replace(month=1, day=1)}
        assert {i: r[i] for i in INTERVALS} == {i: int((w - dt.datetime(1970, 1, 1)) / dt.timedelta(milliseconds=1)) for i, w in want.items()}


def test_slots_of_successive_periods_differ_by_one(spark):
    df = spark.range(0, 5000).select((F.col("id") * 7_200_000_000).alias("t"))
    for i in ("week", "month", "year"):
        assert df.where(tu.slot_index(tu.bucket_end("t", i) + 1, i) != tu.slot_index("t", i) + 1).count() == 0


def test_extreme_times_do_not_fail(spark):
    df = spark.createDataFrame([(2**63 - 1,), (-(2**63),), (None,)], "t long")
    assert df.select(*[tu.slot_index("t", i).alias(i) for i in INTERVALS], *[tu.bucket_start("t", i).alias(f"s{i}") for i in INTERVALS],
                     *[tu.bucket_end("t", i).alias(f"e{i}") for i in INTERVALS], tu.round_to("t", 1000).alias("r")).collect()[2]["month"] is None


def test_conversions(spark):
    t = ms(2017, 3, 5, 11, 45, 55) + 11
    df = spark.createDataFrame([(t,)], "t long")
    r = df.select(tu.to_datetime("t").alias("d"), tu.to_string("t").alias("s"), tu.from_datetime(tu.to_datetime("t")).alias("back")).first()
    assert r["d"].asDict() == {"year": 2017, "month": 3, "day": 5, "day_of_year": 64, "hour": 11, "minute": 45, "second": 55, "millisecond": 11}
    assert r["s"] == "2017-03-05 11:45:55.0011" and r["back"] == t
    p = spark.createDataFrame([("2002-01-20 23:59:59.000", "20020131T235959", "no")], "a string, b string, c string").select(
        tu.from_string("a").alias("a"), tu.from_iso_string("b").alias("b"), tu.from_string("c").alias("c")).first()
    assert (p["a"], p["b"], p["c"]) == (ms(2002, 1, 20, 23, 59, 59), ms(2002, 1, 31, 23, 59, 59), None)


def test_lengths_and_order(spark):
    df = spark.createDataFrame([(n,) for n in [*INTERVALS, "raw", "x"]], "n string")
    got = {r["n"]: (r["l"], r["r"]) for r in df.select("n", tu.interval_length(F.col("n")).alias("l"), tu.interval_rank(F.col("n")).alias("r")).collect()}
    assert [got[n][0] for n in INTERVALS] == sorted(INTERVALS.values()) and got["x"] == (0, None) and got["raw"] == (0, 0)
    assert [got[n][1] for n in INTERVALS] == [1, 2, 3, 4, 5, 6, 7]
    assert (tu.from_days(1), tu.from_hours(1), tu.from_minutes(1), tu.from_seconds(1)) == (86_400_000, 3_600_000, 60_000, 1000)


def test_ntz_is_free_of_the_session_zone(spark):
    df = spark.sql("SELECT timestamp_ntz'2020-07-01 00:00:00.123' AS a, timestamp_ntz'2020-01-01 00:00:00' AS b")
    r = df.select(tu.ms_of_ntz("a").alias("a"), tu.ms_of_ntz("b").alias("b")).first()
    assert (r["a"], r["b"]) == (ms(2020, 7, 1) + 123, ms(2020, 1, 1))


@pytest.mark.parametrize("interval", list(INTERVALS))
def test_next_fire_is_the_end_of_the_next_period(spark, interval):
    end = spark.createDataFrame([(T,)], "t long").select(tu.bucket_end("t", interval).alias("e")).first()["e"]
    want = spark.createDataFrame([(end + 1,)], "t long").select(tu.bucket_end("t", interval).alias("e")).first()["e"]
    assert next_fire(end, interval) == want
