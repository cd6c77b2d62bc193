"""p2, p3, p5 and p6 against brute force, with large series cut into many shards and in one."""

import datetime as dt
import math
import random
from collections import defaultdict
from statistics import median

import pytest
from pyspark.sql import functions as F

from tidewell.operators.anomalies import implausible, score_readings
from tidewell.operators.grid import regular_grid
from tidewell.operators.hotkeys import totals_by_key
from tidewell.operators.layout import ShardPlan, halos, ordered_readings, plan_shards, with_shard
from tidewell.operators.rolling import rolling_totals
from tidewell.types import DAY, NO_DATA

CUTS = [{"shard_rows": 40}, {"shard_rows": 10**9}]
NAN = float("nan")


def delivered(seed=1, n=1500, span=200 * DAY):
    """Series 7 has two thirds of all rows; rows are repeated, corrected, withdrawn, null and NaN, with ties."""
    rng = random.Random(seed)
    out, seq = [], 0
    level = {}
    for _ in range(n):
        i = 7 if rng.random() < 0.66 else rng.randrange(6)
        t = rng.randrange(span) if i == 7 else rng.randrange(span // 5) * rng.choice([1, 5])
        v = level[i] = rng.choice([level.get(i, 0.0), round(rng.gauss(10 * i, 2), 3), round(rng.gauss(10 * i, 2), 3)])
        if rng.random() < 0.03:
            v += rng.choice([-500.0, 500.0])
        seq += 1
        row = (i, t, rng.choice([v] * 30 + [None, NAN]), rng.choice([0, 0, 0, 4, None]), seq)
        out.append(row)
        while rng.random() < 0.2:
            seq += 1
            out.append(rng.choice([(*row[:4], seq), (i, t, v + 1, 0, seq), (i, t, 0.0, NO_DATA, seq), row]))
    rng.shuffle(out)
    return out


def current(rows):
    key = lambda r: (r[4] is not None, r[4] or 0, r[3] is not None, r[3] or 0, r[2] is not None, (math.isnan(r[2]), 0 if math.isnan(r[2]) else r[2]) if r[2] is not None else ())
    best = {}
    for r in rows:
        if r[0] is not None and r[1] is not None and ((r[0], r[1]) not in best or key(r) > key(best[r[0], r[1]])):
            best[r[0], r[1]] = r
    out = defaultdict(list)
    for r in best.values():
        if r[2] is not None and not math.isnan(r[2]) and r[3] != NO_DATA:
            out[r[0]].append((r[1], r[2], r[3]))
    return {i: sorted(v, key=lambda x: x[0]) for i, v in out.items()}


# Layout

def test_plan_cuts_large_series_only(meas):
    m = meas([(7, t, 1.0, 0) for t in range(1000)] + [(i, 5, 1.0, 0) for i in range(100)])
    plan = plan_shards(m, shard_rows=100)
    assert list(plan.cuts) == [7] and 7 <= len(plan.cuts[7]) <= 11
    counts = [r["count"] for r in with_shard(m.where("id = 7"), plan).groupBy("shard").count().collect()]
    assert len(counts) == len(plan.cuts[7]) + 1 and max(counts) < 150
    assert len(plan_shards(m, shard_rows=1, max_shards=5).cuts.get(7, [])) <= 5
    assert plan_shards(m.where("id < 0")).cuts == {}


def test_shard_is_the_number_of_cuts_at_or_before(spark):
    cuts = [-50, 0, 1, 2, 1000, 10**12]
    far = with_shard(spark.createDataFrame([(1, 2**63 - 1), (1, -(2**63))], "id long, time long"), ShardPlan({1: [-(2**63) + 5, 0]})).collect()
    assert [r["shard"] for r in far] == [2, 0]
    df = spark.createDataFrame([(1, t) for t in (-51, -50, -1, 0, 1, 2, 999, 1000, 10**12 - 1, 10**12, 10**15)] + [(2, 5), (1, None)], "id long, time long")
    for r in with_shard(df, ShardPlan({1: cuts})).collect():
        assert r["shard"] == (sum(c <= r["time"] for c in cuts) if r["id"] == 1 and r["time"] is not None else 0)


def test_tasks_follow_the_table(meas, monkeypatch):
    from tidewell.operators import layout

    m = meas([(i, 1, 1.0, 0) for i in range(300)])
    monkeypatch.setattr(layout, "TASK_ROWS", 10)
    assert ordered_readings(m, plan_shards(m)).rdd.getNumPartitions() == 30
    assert rolling_totals(m).count() == 300


def test_halos_reach_over_short_and_empty_shards(meas):
    m = meas([(1, t, float(t), 0) for t in (0, 1, 2, 10, 30, 31, 32, 33)])
    plan = ShardPlan({1: [5, 20, 25, 30]})
    got = {r["shard"]: r for r in halos(ordered_readings(m, plan), plan, "time", 3, ["time"]).collect()}
    times = lambda x: [e and e["time"] for e in x]
    assert times(got[0]["post"]) == [10, 30, 31] and times(got[0]["pre"]) == [None] * 3
    assert times(got[1]["pre"]) == [2, 1, 0] and times(got[1]["post"]) == [30, 31, 32]
    assert times(got[4]["pre"]) == [10, 2, 1] and 2 not in got


# p2

@pytest.mark.parametrize("cut", CUTS)
def test_rolling(meas, cut):
    data = delivered()
    got = {(r["id"], r["epoch_day"]): r for r in rolling_totals(meas(data), (7, 30), **cut).collect()}
    n = 0
    for i, v in current(data).items():
        days = defaultdict(list)
        for t, x, _ in v:
            days[t // DAY].append(x)
        for d in range(min(days), max(days) + 1):
            n += 1
            for k in (7, 30):
                own = [x for e in range(d - k + 1, d + 1) for x in days.get(e, ())]
                r = got[i, d]
                assert r[f"n_{k}"] == len(own) and abs(r[f"total_{k}"] - sum(own)) < 1e-6
                assert (r[f"average_{k}"] is None) if not own else abs(r[f"average_{k}"] - sum(own) / len(own)) < 1e-6
    assert n == len(got)


def test_rolling_infinite_values_leave_with_their_period(meas):
    got = {r["epoch_day"]: r for r in rolling_totals(meas([(1, 0, float("inf"), 0), (1, 3 * DAY, float("-inf"), 0), (1, 20 * DAY, 2.0, 0), (1, -DAY, 1.0, 0)]), (7,)).collect()}
    assert got[0]["total_7"] == float("inf") and math.isnan(got[3]["total_7"]) and got[8]["total_7"] == float("-inf") and got[15]["total_7"] == 0.0 and got[20]["total_7"] == 2.0


def test_rolling_long_gap(meas):
    assert rolling_totals(meas([(1, 0, 1.0, 0), (1, 20_000 * DAY, 1.0, 0)])).count() == 20_001


# p3

def period(t, interval):
    d = dt.datetime(1970, 1, 1) + dt.timedelta(milliseconds=t)
    day = d.replace(hour=0, minute=0, second=0, microsecond=0)
    s = {"hour": d.replace(minute=0, second=0, microsecond=0), "day": day, "week": day - dt.timedelta(days=day.weekday()), "month": day.replace(day=1),
         "minute": d.replace(second=0, microsecond=0), "halfhour": d.replace(minute=d.minute // 30 * 30, second=0, microsecond=0)}[interval]
    return int((s - dt.datetime(1970, 1, 1)) / dt.timedelta(milliseconds=1))


def all_periods(first, last, interval):
    out, t = [period(first, interval)], first
    step = {"minute": 60_000, "halfhour": 1_800_000, "hour": 3_600_000}.get(interval, DAY)
    while (t := t + step) <= last + 32 * DAY:
        p = period(t, interval)
        if p > last:
            break
        if p != out[-1]:
            out.append(p)
    return out


SCHEME = [(7, "hour"), (0, "day"), (1, "week"), (2, "month"), (3, "halfhour"), (4, "raw"), (5, None), (99, "hour")]


@pytest.mark.parametrize("cut", [*CUTS, {"shard_rows": 40, "max_lookup_rows": 2}])
def test_grid(spark, meas, cut):
    pytest.importorskip("numpy")
    data = delivered(seed=4, span=40 * DAY)
    scheme = spark.createDataFrame(SCHEME, "id long, interval string")
    got = defaultdict(dict)
    for r in regular_grid(meas(data), scheme, max_gap=5, **cut).collect():
        assert r["slot_start"] not in got[r["id"]]
        got[r["id"]][r["slot_start"]] = r
    cur, kinds = current(data), dict(SCHEME)
    assert set(got) == {i for i in cur if kinds.get(i) in ("minute", "halfhour", "hour", "day", "week", "month")}
    for i, own in got.items():
        slots = defaultdict(list)
        for t, v, _ in cur[i]:
            slots[period(t, kinds[i])].append(v)
        every = all_periods(cur[i][0][0], cur[i][-1][0], kinds[i])
        assert sorted(own) == every
        known = [k for k, s in enumerate(every) if s in slots]
        value = {k: sum(slots[every[k]]) / len(slots[every[k]]) for k in known}
        for k, s in enumerate(every):
            r = own[s]
            if s in slots:
                assert r["status"] == "reading" and r["n_readings"] == len(slots[s]) and abs(r["value"] - value[k]) < 1e-9
                continue
            a, b = max(x for x in known if x < k), min(x for x in known if x > k)
            assert r["status"] == ("filled" if b - a <= 6 else "gap") and (r["value"] is None) == (b - a > 6)
            if r["value"] is not None:
                assert min(value[a], value[b]) - 1e-9 <= r["value"] <= max(value[a], value[b]) + 1e-9


def pchip(x, y, at):
    """Fritsch-Carlson slopes as published, for one segment."""
    h = [b - a for a, b in zip(x, x[1:])]
    d = [(b - a) / k for a, b, k in zip(y, y[1:], h)]
    if len(x) == 2:
        s = [d[0], d[0]]
    else:
        def end(h0, h1, d0, d1):
            m = ((2 * h0 + h1) * d0 - h0 * d1) / (h0 + h1)
            return 0.0 if m * d0 <= 0 else 3 * d0 if d0 * d1 <= 0 and abs(m) > 3 * abs(d0) else m

        s = [end(h[0], h[1], d[0], d[1])]
        for k in range(1, len(x) - 1):
            w0, w1 = 2 * h[k] + h[k - 1], h[k] + 2 * h[k - 1]
            s.append((w0 + w1) / (w0 / d[k - 1] + w1 / d[k]) if d[k - 1] * d[k] > 0 else 0.0)
        s.append(end(h[-1], h[-2], d[-1], d[-2]))
    k = max(j for j in range(len(x) - 1) if x[j] <= at)
    u = (at - x[k]) / h[k]
    return ((2 * u**3 - 3 * u**2 + 1) * y[k] + (u**3 - 2 * u**2 + u) * h[k] * s[k] + (3 * u**2 - 2 * u**3) * y[k + 1] + (u**3 - u**2) * h[k] * s[k + 1])


@pytest.mark.parametrize("cut", [{"shard_rows": 5}, {"shard_rows": 10**9}])
def test_grid_curve(spark, meas, cut):
    rng = random.Random(9)
    x = sorted(rng.sample(range(120), 45))
    y = [round(rng.gauss(0, 3), 2) for _ in x]
    m = meas([(1, k * 3_600_000 + 5, v, 0) for k, v in zip(x, y)])
    own = regular_grid(m, spark.createDataFrame([(1, "hour")], "id long, interval string"), max_gap=3, **cut).collect()
    parts, start = [], 0
    for k in range(1, len(x) + 1):
        if k == len(x) or x[k] - x[k - 1] > 4:
            parts.append((x[start:k], y[start:k]))
            start = k
    n = 0
    for r in own:
        if r["status"] == "filled":
            s = r["slot_start"] // 3_600_000
            px, py = next(p for p in parts if p[0][0] <= s <= p[0][-1])
            assert abs(r["value"] - pchip(px, py, s)) < 1e-9
            n += 1
    assert n > 20


# p5

def expected(data, limits):
    out = set()
    for i, v in current(data).items():
        x = [b for _, b, _ in v]
        lo, hi = limits.get(i, (-math.inf, math.inf))
        out |= {(i, t) for t, b, _ in v if b < lo or b > hi}
        d = [abs(b - a) for a, b in zip(x, x[1:])]
        step = median(d) if d else 0
        if step < 1e-5:
            continue
        for k in range(len(x)):
            for n in (1, 2, 3):
                if k >= 3 and k + n + 3 <= len(x):
                    six = x[k - 3:k] + x[k + n:k + n + 3]
                    if max(six) - min(six) <= 10 * step and all(abs(b - s) > 10 * step for b in x[k:k + n] for s in six):
                        out |= {(i, v[j][0]) for j in range(k, k + n)}
        k = 0
        while k < len(x):
            e = k + 1
            while e < len(x) and abs(x[e] - x[e - 1]) < 1e-5:
                e += 1
            if e - k >= 8:
                out |= {(i, v[j][0]) for j in range(k, e)}
            k = e
    return out


def sensor(seed, n=900):
    rng = random.Random(seed)
    out = []
    for i, share in ((7, 0.6), (1, 0.2), (2, 0.15), (3, 0.05)):
        v, t = 50.0, 0
        for _ in range(int(n * share)):
            t += rng.randrange(1, 5_000_000)
            v = round(v + rng.gauss(0, 1), 3)
            out.append((i, t, v, 0))
        own = [k for k, r in enumerate(out) if r[0] == i]
        for _ in range(max(2, len(own) // 60)):
            a, k = rng.choice(own[:-14]), rng.choice([1, 2, 3, 8, 9, 14])
            for j in range(k):
                t0 = out[a + j]
                out[a + j] = (*t0[:2], (out[a][2] if k >= 8 else t0[2] + 200), 0)
    return out + [(9, 5, 1.0, 0), (10, 5, 200.0, 0)]


@pytest.mark.parametrize("cut", [*CUTS, {"shard_rows": 6}])
@pytest.mark.parametrize("seed", [1, 2])
def test_implausible(spark, meas, cut, seed):
    data = [(*r, k) for k, r in enumerate(sensor(seed))]
    scheme = spark.createDataFrame([(7, "a.Flow.raw"), (10, "b.FLOW..x.hour"), (2, "c.flows.raw"), (None, "flow.raw"), (3, None)], "id long, name string")
    limits = spark.createDataFrame([("flow", 0.0, 100.0), ("other", None, 1.0), (None, 0.0, 0.0)], "quantity string, min_value double, max_value double")
    got = {(r["id"], r["time"]) for r in implausible(meas(data), scheme, limits, **cut).collect()}
    assert got == expected(data, {7: (0, 100), 10: (0, 100)}) and len(got) > 20


@pytest.mark.parametrize("cut", [{"shard_rows": 20, "block_rows": 7}, {"shard_rows": 30, "block_rows": 9}, {"shard_rows": 50, "block_rows": 16}])
def test_last_blocks_of_few_readings(spark, meas, cut):
    """Shards whose last block holds 1 to 6 readings: the block before it sees into the next shard."""
    none = spark.createDataFrame([], "id long, name string"), spark.createDataFrame([], "quantity string, min_value double, max_value double")
    rng = random.Random(12)
    data = []
    for i, stretch in ((1, 1), (2, 3), (3, 9)):  # in series 1 and 2 spikes, in 3 stuck values, all the way
        own = []
        while len(own) < 900:
            own += [round(50 + rng.gauss(0, 1), 3) for _ in range(rng.randrange(9, 14))]
            own += [own[-1] if i == 3 else 250.0 + rng.random() for _ in range(stretch)]
        data += [(i, 1000 * k, v, 0) for k, v in enumerate(own)]
    rows = meas(data)
    sizes = [r["n"] for r in with_shard(rows, plan_shards(rows, shard_rows=cut["shard_rows"])).groupBy("id", "shard").agg(F.count("*").alias("n")).collect()]
    assert sum(n > cut["block_rows"] and 1 <= n % cut["block_rows"] <= 6 for n in sizes) > 5
    got = {(r["id"], r["time"]) for r in score_readings(rows, *none, **cut).where("spike OR stuck").collect()}
    assert got == expected([(*r, k) for k, r in enumerate(data)], {}) and len(got) > 300


@pytest.mark.parametrize("cut", [{"shard_rows": 200}, {"shard_rows": 10**9}])
def test_usual_spikes(spark, meas, cut):
    """Series in which many readings are spikes by the rule, so that the forest finds them as usual as others."""
    none = spark.createDataFrame([], "id long, name string"), spark.createDataFrame([], "quantity string, min_value double, max_value double")
    rng = random.Random(5)
    data = []
    for i in range(40):  # three high, three low; three of nine high; nine readings with three of them high; 40 readings with one high
        n, every, high = ((600, 6, 3), (600, 9, 3), (9, 9, 3), (40, 40, 1))[i % 4]
        data += [(i, 1000 * k, round(rng.gauss(0, 1) + (500 if (k - 3) % every < high else 0), 3), 0) for k in range(n)]
    scored = score_readings(meas(data), *none, **cut).where("spike").collect()
    assert all(r["candidate"] for r in scored)
    got = {(r["id"], r["time"]) for r in implausible(meas(data), *none, **cut).collect()}
    assert got == expected([(*r, k) for k, r in enumerate(data)], {}) and {i for i, _ in got} == set(range(40))


def test_scores_do_not_depend_on_the_cut(spark, meas):
    data = sensor(3)
    none = spark.createDataFrame([], "id long, name string"), spark.createDataFrame([], "quantity string, min_value double, max_value double")
    a, b = ({(r["id"], r["time"]): (r["spike"], r["stuck"], r["score"]) for r in score_readings(meas(data), *none, **c).collect()} for c in CUTS)
    assert a.keys() == b.keys()
    assert all(a[k][:2] == b[k][:2] for k in a)
    assert sum(abs(a[k][2] - b[k][2]) < 1e-3 for k in a) > 0.99 * len(a)  # sums in another order may move a threshold
    top = sorted(a, key=lambda k: -a[k][2])[:10]
    assert all(a[k][0] or a[k][1] or a[k][2] > 0.5 for k in top)


def test_anomalies_of_odd_tables(spark, meas):
    none = spark.createDataFrame([], "id long, name string"), spark.createDataFrame([], "quantity string, min_value double, max_value double")
    assert implausible(meas([]), *none).count() == 0
    odd = meas([(1, 1, float("inf"), 0), (1, 2, float("-inf"), 0), (1, 3, 5.0, None), (None, 1, 1.0, 0), (2, None, 1.0, 0), (2, 5, None, 0)])
    assert score_readings(odd.withColumn("shard", F.lit("x")).withColumn("min_value", F.lit(1)), *none).count() == 3
    assert implausible(odd, *none).count() == 0


def test_cut_series_without_readings(spark, meas):
    none = spark.createDataFrame([], "id long, name string"), spark.createDataFrame([], "quantity string, min_value double, max_value double")
    gone = [(1, t, 0.0, NO_DATA) for t in range(100)]
    some = [(2, t, None if t != 50 else 7.0, 0) for t in range(100)]
    grid = spark.createDataFrame([(1, "minute"), (2, "minute")], "id long, interval string")
    for rows, n in ((gone, 0), (gone + some, 1), (some + [(3, 1, 1.0, 0)], 2)):
        assert score_readings(meas(rows), *none, shard_rows=10).count() == n
        assert rolling_totals(meas(rows), shard_rows=10).count() == n
        assert regular_grid(meas(rows), grid, shard_rows=10).count() == n - (len(rows) == 101)


# p6

def test_totals_by_key(meas):
    data = delivered(seed=8) + [(None, 1, 2.0, 0, 1), (None, 2, None, 0, 2), (-5, 1, None, 0, 1), (2**62, 1, 1.5, 0, 1)]
    for blocks, levels in ((1, None), (5, 1), (2, 3)):
        got = {r["id"]: r for r in totals_by_key(meas(data).repartition(5), blocks=blocks, levels=levels).collect()}
        assert set(got) == {r[0] for r in data}
        for i, r in got.items():
            own = [x for x in data if x[0] == i]
            v = [x[2] for x in own if x[2] is not None and not math.isnan(x[2])]
            assert r["n_rows"] == len(own) and r["n_values"] == len(v)
            assert (r["total"] is None) if not v else abs(r["total"] - sum(v)) < 1e-6
            assert (r["min_value"], r["max_value"]) == ((min(v), max(v)) if v else (None, None))
    assert totals_by_key(meas([])).count() == 0


def test_empty_tables(spark, meas):
    assert rolling_totals(meas([])).count() == 0
    assert regular_grid(meas([]), spark.createDataFrame([(1, "hour")], "id long, interval string")).count() == 0
    only = meas([(1, 5, None, 0)])
    assert rolling_totals(only).count() == 0
    assert regular_grid(only, spark.createDataFrame([(1, "hour")], "id long, interval string")).count() == 0


def test_clashing_columns(spark):
    df = spark.createDataFrame([(1, 0, 1.0, 0, 1, "a", 3, 4), (1, 3 * DAY, 2.0, 0, 2, "b", 3, 4)], "id long, time long, value double, flag long, seq long, interval string, shard int, slot int")
    assert rolling_totals(df).count() == 4
    assert regular_grid(df, spark.createDataFrame([(1, "day", "x")], "id long, interval string, value string")).count() == 4
    assert totals_by_key(df).first()["total"] == 3.0


def test_long_series_by_blocks(monkeypatch):
    """A series that is handled by blocks within its task gets what it gets as a whole."""
    import numpy as np
    import pyarrow as pa

    from tidewell.operators import anomalies

    rng = np.random.default_rng(5)
    n = 5000
    v = np.round(np.cumsum(rng.normal(0, 1, n)), 2)
    v[rng.integers(0, n, 40)] += 500
    v[1000:1012] = v[1000]
    ids = np.r_[np.full(7, 1), np.full(n, 2), np.full(9, 3)]
    v = np.r_[np.arange(7.0), v, np.arange(9.0)]
    t = np.r_[np.arange(7), np.arange(n), np.arange(9)] * 600_000
    table = pa.table({"id": ids, "shard": np.zeros(len(ids), np.int32), "time": t, "value": v, "min_value": np.full(len(ids), -1e9), "max_value": np.full(len(ids), 1e9)})
    run = lambda rows: pa.Table.from_batches(list(anomalies._score(iter(table.to_batches(max_chunksize=rows))))).to_pandas().sort_values(["id", "time"]).reset_index(drop=True)
    whole = run(10_000)
    monkeypatch.setattr(anomalies, "CHUNK_ROWS", 300)
    monkeypatch.setattr(anomalies, "LONG_ROWS", 100)
    parts = run(64)
    assert len(whole) == len(ids) and whole.spike.sum() > 20 and whole.stuck.sum() >= 12
    for c in ("id", "time", "value", "spike", "stuck", "impossible", "candidate"):
        assert (whole[c] == parts[c]).all(), c
    assert np.allclose(whole.score, parts.score, atol=1e-6)


def test_the_rule_follows_the_forest(monkeypatch):
    """Only the forest's candidates are held against the rule of spikes, and no spike is lost by that."""
    import numpy as np
    import pyarrow as pa

    from tidewell.operators import anomalies

    rng = random.Random(17)
    data = []
    for i in range(300):  # whole numbers, so that many differences are ten steps exactly; also short series and stuck ones
        v, own = 0, []
        while len(own) < (1, 6, 7, 8, 9, 30, 60, 400)[i % 8]:
            v += rng.choice([-1, 0, 1, 1] if i % 3 == 0 else [-1, 1])
            jump = rng.choice([0] * 20 + [10, 11, -11, 12, 21, 500])
            own += [v + jump + rng.choice([0, 0, 1]) for _ in range(rng.randrange(1, 5))] if jump else [v] * rng.choice([1] * 40 + [9])
        data += [(i, 600_000 * k, float(x), 0, k) for k, x in enumerate(own)]
    ids, t, v = (np.array([r[c] for r in data]) for c in range(3))
    table = pa.table({"id": ids, "shard": np.zeros(len(ids), np.int32), "time": t, "value": v, "min_value": np.full(len(ids), -np.inf), "max_value": np.full(len(ids), np.inf)})
    run = lambda: pa.Table.from_batches(list(anomalies._score(iter(table.to_batches())))).to_pandas()
    whole = run()
    found = whole[whole.spike | whole.stuck]
    assert set(zip(found.id, found.time)) == expected(data, {}) and whole.spike.sum() > 100 and whole.stuck.sum() > 100
    assert whole.candidate[whole.spike].all() and whole.candidate.sum() < 0.6 * len(whole)

    score, usual = anomalies.Forests.score, np.arange(len(ids)) % 2 == 0
    with monkeypatch.context() as m:  # a forest that finds every other reading usual
        m.setattr(anomalies.Forests, "score", lambda self, series, x: np.where(usual, 0.0, score(self, series, x)).astype(np.float32))
        half = run()
    assert (half.spike == whole.spike & ~usual).all() and (half.stuck == whole.stuck).all()
    spikes, looked = anomalies._Segments.spikes, []
    monkeypatch.setattr(anomalies._Segments, "spikes", lambda self, step, rows: looked.append(len(rows)) or spikes(self, step, rows))
    run()
    assert 0 < sum(looked) <= whole.candidate.sum()


def test_time_of_cutting_is_linear():
    """Blocks of one long shard are cut while it is read: no batch is looked at again."""
    import numpy as np
    import pyarrow as pa

    from tidewell.operators import anomalies

    n, seen = 200_000, []
    v = np.arange(float(n))
    batches = pa.table({"id": np.full(n, 5), "shard": np.full(n, 3, np.int32), "time": np.arange(n), "value": v}).to_batches(max_chunksize=1000)

    def source():
        for k, b in enumerate(batches):
            seen.append(k)
            yield b

    first = next(blocks := anomalies._cut(source(), 2000))
    assert len(seen) < len(batches) and first.num_rows > 0
    rows = first.to_pylist() + [r for b in blocks for r in b.to_pylist()]
    assert [r["block"] for r in rows] == list(range(100)) and [x for r in rows for x in r["values"]] == v.tolist()
    assert rows[0]["pre"] is None and rows[-1]["post"] is None
    assert rows[1]["pre"] == v[1993:2000].tolist() and rows[0]["post"] == v[2000:2007].tolist()


@pytest.mark.parametrize("total", [10**12, 10**13])
def test_plan_of_huge_tables(total):
    """The sample, the cuts and the tasks keep their bounds at any size."""
    import numpy as np

    from tidewell.operators import layout

    share = layout.SAMPLE_ROWS / total
    assert abs((layout.sample_bound(share) + 1) / 2**63 * total / layout.SAMPLE_ROWS - 1) < 1e-3
    assert layout.task_count(total) == layout.MAX_TASKS and layout.sample_bound(1.0) == 2**63 - 1
    rng = np.random.default_rng(1)
    k = layout.SAMPLE_ROWS
    ids = np.where(rng.random(k) < 1 / 3, 42, rng.integers(100, 10**6, k))
    times = rng.integers(0, 10**12, k)
    target = -(-total // layout.MAX_SHARDS)
    cuts, copies = layout.cuts_of(ids, times, np.ones(k, np.int64), share, target)
    assert not copies and abs(len(cuts[42]) / (layout.MAX_SHARDS / 3) - 1) < 0.02 and sum(map(len, cuts.values())) <= layout.MAX_SHARDS
    n = np.ones(k, np.int64)
    n[5] = k // 3  # one id and time
    cuts, copies = layout.cuts_of(ids, times, n, share, target)
    assert copies == [(int(ids[5]), int(times[5]))] and sum(map(len, cuts.values())) <= layout.MAX_SHARDS


def test_many_rows_of_one_id_and_time(meas):
    data = [(7, 5, float(k % 50), 0) for k in range(3000)] + [(7, t, 1.0, 0) for t in range(6, 400)] + [(k, 1, 2.0, 0) for k in range(100, 400)]
    m = meas(data)
    plan = plan_shards(m, shard_rows=100)
    assert plan.copies == [(7, 5)]
    got = {(r["id"], r["time"]): r["value"] for r in ordered_readings(m, plan).collect()}
    assert got == {(i, t): v for i, t, v, _ in data} and len(got) == 1 + 394 + 300
