import math
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tidewell.llm.digest import certify, digest, estimate, merge_digests, series_quantiles
from tidewell.operators.layout import ShardPlan

PS = [0.0, 0.25, 0.5, 0.9, 0.99, 1.0]


def values(spark, seed=1, n=20_000):
    rng = random.Random(seed)
    data = [(rng.choice([1, 1, 1, 2]), k % 9, rng.choice([rng.gauss(0, 1), rng.expovariate(1), 5.0, round(rng.random(), 1)])) for k in range(n)]
    return data, spark.createDataFrame(data, "id long, day int, value double")


def ranks(own, v):
    return sum(x < v for x in own), max(sum(x <= v for x in own) - 1, sum(x < v for x in own))


@pytest.mark.parametrize("merged", [False, True])
def test_error_bound(spark, merged):
    data, df = values(spark)
    d = merge_digests(digest(df, ["id", "day"], delta=200), ["id"], delta=200) if merged else digest(df, ["id"], delta=200)
    assert d.groupBy("id").agg(F.sum("weight").alias("w")).where("id = 1").first()["w"] == sum(i == 1 for i, _, _ in data)
    assert d.groupBy("id").count().agg(F.max("count")).first()[0] <= 201
    for r in estimate(d, ["id"], PS).collect():
        own = sorted(v for i, _, v in data if i == r["id"])
        for k, p in enumerate(PS):
            q = r[f"q{k}"]
            assert q["position"] == min(int(p * len(own)), len(own) - 1)
            lo, hi = ranks(own, q["value"])
            assert max(lo - q["position"], q["position"] - hi, 0) / len(own) < (2 if merged else 1) * math.pi / (2 * 200)
            assert q["low"] <= own[q["position"]] <= q["high"]


def test_certificate(spark):
    data, df = values(spark, 2, 5000)
    est = estimate(digest(df, ["id"], delta=100), ["id"], [0.5, 0.99])
    got = certify(df, est, [0.5, 0.99], ShardPlan()).collect()
    assert len(got) == 4
    for r in got:
        own = sorted(v for i, _, v in data if i == r["id"])
        assert (r["rank_from"], r["rank_to"]) == ranks(own, r["estimate"]) and r["exact"] == own[r["position"]]
        assert r["rank_error"] == max(r["rank_from"] - r["position"], r["position"] - r["rank_to"], 0) / r["n"] < 0.02


@pytest.mark.parametrize("cut", [{"shard_rows": 60}, {"shard_rows": 10**9}])
def test_series(meas, cut):
    rng = random.Random(3)
    data = [(7 if rng.random() < 0.6 else rng.randrange(5), rng.randrange(10**6), rng.choice([round(rng.gauss(5, 3), 1), None, float("nan"), 1.5]), rng.choice([0, 0, 4294967295, None])) for _ in range(2000)]
    best = {}
    for k, r in enumerate(data):
        best[r[0], r[1]] = r
    own = defaultdict(list)
    for i, t, v, f in best.values():
        if v is not None and not math.isnan(v) and f != 4294967295:
            own[i].append(v)
    got = {(r["id"], r["p"]): r for r in series_quantiles(meas(data), [0.5, 0.99], delta=100, **cut).collect()}
    assert {i for i, _ in got} == set(own)
    for (i, p), r in got.items():
        assert r["exact"] == sorted(own[i])[int(p * len(own[i]))] and r["n"] == len(own[i])


def test_odd_values(spark, meas):
    assert series_quantiles(meas([]), [0.5]).count() == 0
    assert series_quantiles(meas([(1, 1, None, 0)]), [0.5]).count() == 0
    inf = float("inf")
    r = series_quantiles(meas([(1, 1, inf, 0), (1, 2, -inf, 0), (1, 3, 2.0, None), (None, 1, 1.0, 0)]).withColumn("n", F.lit(1)).withColumn("p", F.lit("x")), [0.0, 0.5, 0.99]).orderBy("p").collect()
    assert [x["exact"] for x in r] == [-inf, 2.0, inf]
    assert digest(spark.createDataFrame([(None, 1.0), (None, 2.0)], "k string, value double"), ["k"]).count() == 2
