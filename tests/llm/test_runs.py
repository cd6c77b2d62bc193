import math
import random

import pytest
from pyspark.sql import functions as F

from tidewell.llm.runs import collapse_runs


def expected(rows, min_n=1):
    best = {}
    for i, t, v, f in rows:
        best[i, t] = (v, f)
    out, run = set(), []

    def close():
        if len(run) >= min_n and run:
            out.add((run[0][0], run[0][1], run[-1][1], len(run), run[-1][1] - run[0][1], run[0][3], run[0][2]))

    for (i, t), (v, f) in sorted(best.items()):
        if v is None or math.isnan(v) or f == 4294967295:
            continue
        if not (run and run[-1][0] == i and run[-1][3] == f and abs(v - run[-1][2]) < 1e-5):
            close()
            run = []
        run.append((i, t, v, f))
    close()
    return out


@pytest.mark.parametrize("cut", [{"shard_rows": 3}, {"shard_rows": 25}, {"shard_rows": 10**9}])
@pytest.mark.parametrize("calm", [0.5, 0.95, 0.999])
def test_runs(meas, cut, calm):
    rng = random.Random(int(calm * 1000))
    rows, v, f = [], 1.0, 0
    for k in range(1500):
        if rng.random() > calm:
            v, f = rng.choice([v + 1, v, v + 9e-6, v - 2e-5]), rng.choice([0, 0, 1, None])
        rows.append((7 if rng.random() < 0.7 else rng.randrange(4), rng.randrange(6000), rng.choice([v] * 40 + [None, float("nan")]), f if rng.random() > 0.01 else 4294967295))
    for n in (1, 3):
        got = [tuple(r[c] for c in ("id", "time_from", "time_to", "n", "duration", "flag", "value")) for r in collapse_runs(meas(rows), min_n=n, **cut).collect()]
        assert len(got) == len(set(got)) and set(got) == expected(rows, n)


def test_one_run_over_all_shards(meas):
    got = collapse_runs(meas([(1, t, 2.5, 8) for t in range(500)]), shard_rows=20).collect()
    assert [(r["time_from"], r["time_to"], r["n"], r["duration"]) for r in got] == [(0, 499, 500, 499)]


def test_slow_drift_is_one_run(meas):
    assert [r["n"] for r in collapse_runs(meas([(1, t, t * 9e-6, 0) for t in range(100)]), shard_rows=7).collect()] == [100]


def test_extreme_times(meas):
    got = collapse_runs(meas([(1, -(2**63), 1.0, 0), (1, 2**63 - 1, 1.0, 0)])).collect()
    assert [(r["n"], r["duration"]) for r in got] == [(2, None)]


def test_odd_rows(meas):
    assert collapse_runs(meas([])).count() == 0
    inf = float("inf")
    odd = meas([(1, 1, inf, 0), (1, 2, inf, 0), (None, 1, 1.0, 0), (2, None, 1.0, 0), (3, 1, 1.0, None), (3, 2, 1.0, None)]).withColumn("shard", F.lit(1)).withColumn("n", F.lit(1))
    assert sorted((r["id"], r["n"]) for r in collapse_runs(odd).collect()) == [(1, 1), (1, 1), (3, 2)]


def test_cut_series_without_readings(meas):
    from tidewell.llm.digest import series_quantiles

    gone = [(1, t, 0.0, 4294967295) for t in range(100)]
    some = [(2, t, None if t != 50 else 7.0, 0) for t in range(100)]
    for rows, n in ((gone, 0), (gone + some, 1)):
        assert collapse_runs(meas(rows), shard_rows=10).count() == n
        assert [r["exact"] for r in series_quantiles(meas(rows), [0.5], shard_rows=10).collect()] == [7.0] * n
