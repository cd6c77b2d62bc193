import random

import pytest
from pyspark.sql import functions as F

from tidewell.functions import predicates
from tidewell.operators import reads
from tidewell.types import MAX_TIME, NO_DATA


def rows(df, *cols):
    return [tuple(r[c] for c in cols or df.columns) for r in df.collect()]


@pytest.fixture
def contract(meas):
    """Ids 0 to 4 with 100 rows each (id 0 in two batches, flag 0 in the second), in random order; flag = id."""
    data = []
    for i in range(5):
        for k in range(100):
            data.append((i, i * 10 + k, float(k), 0 if i == 0 else i))
    random.Random(3).shuffle(data)
    return meas(data)


def test_interval_counts_and_order(contract):
    got = rows(reads.read_interval(contract, [3, 1], 0, 10_000), "id", "time")
    assert len(got) == 200 and [i for i, _ in got] == [3] * 100 + [1] * 100
    assert all(a[1] < b[1] for a, b in zip(got, got[1:]) if a[0] == b[0])


def test_interval_ends_are_included_and_empty_ids_give_nothing(contract):
    assert reads.read_interval(contract, [1], 10, 12).count() == 3
    assert reads.read_interval(contract, [], 0, 10_000).count() == 0
    assert reads.read_interval(contract, [1, 1], 10, 12).count() == 3
    assert reads.read_interval(contract, [9999], 0, 10_000).count() == 0
    assert reads.read_interval(contract, [1], 0, 2**64 - 1).count() == 100


@pytest.mark.parametrize("flag,mask,passes", [(1, 2, False), (3, 1, True), (100, 0, True), (100, 100, True), (100, 10, False), (None, 0, True), (None, 1, False)])
def test_flag_mask(spark, flag, mask, passes):
    df = spark.createDataFrame([(flag,)], "flag long")
    assert (df.where(predicates.in_flag(mask)).count() == 1) is passes


def test_last_written_wins_and_hides_by_flag(meas):
    m = meas([(1, 5, 1.0, 1), (1, 5, 2.0, 2), (1, 6, 3.0, 1)])
    assert rows(reads.read_interval(m, [1], 0, 10)) == [(1, 5, 2.0, 2), (1, 6, 3.0, 1)]
    assert rows(reads.read_interval(m, [1], 0, 10, mask=1)) == [(1, 6, 3.0, 1)]
    assert rows(reads.dedupe(m, "first").orderBy("time"), "value") == [(1.0,), (3.0,)]


def test_write_to_past(meas):
    m = meas([(0, t, 0.0, 0) for t in range(1024)] + [(0, 4, 4.0, 0)])
    ids = m.select("id").distinct()
    assert rows(reads.read_time_point(m, ids, 4), "value") == [(4.0,)]


def test_merge_of_sources(spark):
    def layer(times, v):
        return spark.createDataFrame([(1, t, v, 0) for t in times], "id long, time long, value double, flag long")

    got = rows(reads.merge_layers([layer([1, 2, 4, 7], 1.0), layer([3, 5, 6, 7], 2.0), layer([8], 3.0)]).orderBy("time"), "time", "value")
    assert [t for t, _ in got] == [1, 2, 3, 4, 5, 6, 7, 8] and dict(got)[7] == 1.0
    assert reads.concat([layer([1, 2, 3, 4], 1.0), layer([5, 6, 7, 8], 2.0)]).count() == 8


def test_time_point_filters_before_it_picks_and_current_value_after(spark, meas):
    m = meas([(1, 1, 1.0, 1), (1, 2, 2.0, 2)])
    ids = spark.createDataFrame([(1,), (2,)], "id long")
    assert sorted(rows(reads.read_time_point(m, ids, 5, mask=1))) == [(1, 1, 1.0, 1), (2, 5, 0.0, NO_DATA)]
    assert rows(reads.current_value(m, mask=1)) == []
    assert rows(reads.current_value(m)) == [(1, 2, 2.0, 2)]
    assert rows(reads.current_value(m, [7])) == []


@pytest.mark.parametrize("shard_rows", [10, 10**9])
def test_many_time_points(spark, meas, shard_rows):
    rng = random.Random(1)
    data = [(7 if rng.random() < 0.7 else rng.randrange(3), rng.randrange(2000), rng.random(), rng.randrange(4)) for _ in range(600)]
    pts = [(rng.choice([0, 1, 2, 7, 9]), rng.randrange(-10, 2100)) for _ in range(200)]
    m = meas(data)
    got = sorted(rows(reads.read_time_points(m, spark.createDataFrame(pts, "id long, time_point long"), 1, shard_rows=shard_rows)))
    last = {}
    for k, (i, t, v, f) in enumerate(data):
        last[i, t] = (v, f)
    want = []
    for i, p in pts:
        best = max(((t, v, f) for (j, t), (v, f) in last.items() if j == i and t <= p and f & 1), default=None)
        want.append((i, p, *(best or (p, 0.0, NO_DATA))))
    assert got == sorted(want)


def test_min_max(meas):
    none = meas([])
    assert rows(reads.min_max_time(none)) == [(MAX_TIME, 0)]
    assert reads.id_min_max(none).count() == 0
    m = meas([(1, 5, 1.0, 1), (1, 5, 2.0, 2), (1, 9, 3.0, 1), (2, 0, 4.0, 0)])
    assert sorted(rows(reads.id_min_max(m))) == [(1, 5, 9), (2, 0, 0)]
    assert sorted(rows(reads.first_last(m))) == [(1, 5, 2.0, 2, 9, 3.0, 1), (2, 0, 4.0, 0, 0, 4.0, 0)]


def test_stat_and_its_merge(meas):
    m = meas([(1, 2, 2.0, 1), (1, 3, 3.0, 1), (1, 1, 1.0, 1), (1, 777, 1.0, 1), (1, 4, None, 1), (1, 6, float("nan"), 1)])
    r = reads.range_stat(m).first()
    assert (r["count"], r["sum"], r["min_value"], r["max_value"], r["min_time"], r["max_time"]) == (4, 7.0, 1.0, 3.0, 1, 777)
    parts = reads.range_stat(m.where("time < 3")).unionByName(reads.range_stat(m.where("time >= 3")))
    assert reads.merge_stats(parts, ["id"]).first() == r


@pytest.mark.parametrize("start,end", [(0, 10**12), (5, 86_400_000 * 3 + 7), (86_400_000, 86_400_000 * 2 - 1), (3, 9), (86_400_000 - 1, 86_400_000), (10, 5)])
def test_stat_from_day_states(meas, start, end):
    rng = random.Random(7)
    m = meas([(rng.randrange(3), rng.randrange(5 * 86_400_000) if k % 5 else rng.choice([0, 86_400_000 - 1, 86_400_000, 86_400_000 * 3]), float(rng.randrange(9)), rng.randrange(4)) for k in range(300)])
    assert sorted(rows(reads.range_stat_from(reads.day_states(m), m, start, end))) == sorted(rows(reads.range_stat(m, start, end)))


def test_jenkins_and_bloom(spark):
    from tidewell.functions.hashing import bloom, bloom_check, jenkins

    def plain(v):
        h = 0
        for i in range(4):
            b = (v >> 8 * i) & 255
            h = (h + (b - 256 if b > 127 else b)) & 0xFFFFFFFF
            h = (h + (h << 10)) & 0xFFFFFFFF
            h ^= h >> 6
        h = (h + (h << 3)) & 0xFFFFFFFF
        h ^= h >> 11
        return (h + (h << 15)) & 0xFFFFFFFF

    df = spark.createDataFrame([(v,) for v in (0, 1, 255, 4294967295, 70_000, 128)], "v long")
    assert all(r["h"] == plain(r["v"]) for r in df.select("v", jenkins("v").alias("h")).collect())
    assert df.select(bloom(F.col("v")).alias("b")).crossJoin(df).where(~bloom_check(F.col("b"), F.col("v"))).count() == 0


def test_null_ids_times_and_extra_columns(spark):
    df = spark.createDataFrame([(None, 1, 1.0, 0, 1, "x"), (1, None, 1.0, 0, 2, "x"), (1, 1, None, None, None, None), (1, 1, None, None, None, None)],
                               "id long, time long, value double, flag long, seq long, shard string")
    assert rows(reads.dedupe(df)) == [(1, 1, None, None)]
    assert reads.current_readings(df).count() == 0
    assert reads.read_interval(df, [1], 0, 5).count() == 1
