"""Percentiles of very large groups from merging centroid digests.

A digest is a table: for each group some hundred centroids (`mean`, `weight`,
`low`, `high`). Sorted values are clustered by their quantile q under

    k(q) = delta * (asin(2 q - 1) / pi + 1 / 2),

so that a cluster holds at most pi / (2 delta) of the group's values in the
middle and far less towards the ends, where clusters are single values.
Digests of days, files or shards are merged by clustering their centroids again
in the same way. Everything is window functions and grouping in the JVM.

A digest's estimate is certified by a second pass that counts: it tells which
ranks the estimate really covers, and the exact value at the wanted rank from
the few values between the centroids around it.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewell.operators.layout import ShardPlan, join_by_id, ordered_readings, plan_shards
from tidewell.operators.ranks import at_rank, same
from tidewell.plans.cut import written

DELTA = 1000
#: Series up to which their estimates are broadcast.
MAX_BROADCAST = 500_000
#: Shard digests that are merged at once; more are merged in two steps.
FAN_IN = 64


def _cluster(q: Column, delta: int) -> Column:
    return F.floor(F.lit(float(delta)) * (F.asin(F.least(F.greatest(q * 2 - 1, F.lit(-1.0)), F.lit(1.0))) / math.pi + 0.5)).cast("int")


def digest(values: DataFrame, by: list[str], value: str = "value", delta: int = DELTA) -> DataFrame:
    """by, mean, weight, low, high: the digest of each group. Null and NaN values aren't counted; a null key is a key.

    If `values` is already partitioned by (some of) `by`, no row is exchanged.
    """
    v = F.col(value).cast("double")
    group = Window.partitionBy(*by)
    return (
        values.where(v.isNotNull() & ~F.isnan(v)).select(*by, v.alias("_v"))
        .withColumn("_rank", F.row_number().over(group.orderBy("_v")))
        .withColumn("_n", F.count(F.lit(1)).over(group))
        .withColumn("_k", _cluster((F.col("_rank") - 0.5) / F.col("_n"), delta))
        .groupBy(*by, "_k")
        .agg(F.avg("_v").alias("mean"), F.count(F.lit(1)).alias("weight"), F.min("_v").alias("low"), F.max("_v").alias("high"))
        .drop("_k")
    )


def merge_digests(digests: DataFrame, by: list[str], delta: int = DELTA, several: str | None = None) -> DataFrame:
    """One digest for each group of `by` from any number of digests of its parts. several: a boolean column, if only groups in which it is
    true have several parts; the digests of the others stay as they are."""
    group = Window.partitionBy(*by)
    order = group.orderBy("mean", "low", "high")
    upto = F.sum("weight").over(order.rowsBetween(Window.unboundedPreceding, 0))
    k = _cluster((upto - F.col("weight") / 2) / F.sum("weight").over(group), delta)
    if several:
        k = F.when(F.col(several), k).otherwise(F.row_number().over(order))
    return (
        digests.select(*by, "mean", "weight", "low", "high", *([several] if several else []))
        .withColumn("_k", k)
        .groupBy(*by, "_k")
        .agg((F.sum(F.col("mean") * F.col("weight")) / F.sum("weight")).alias("mean"), F.sum("weight").alias("weight"),
             F.min("low").alias("low"), F.max("high").alias("high"))
        .drop("_k")
    )


def estimate(digests: DataFrame, by: list[str], ps: list[float], margin: int = 2) -> DataFrame:
    """For each group one row: by, n, and for the i-th p the struct q<i>(position, value, low, high).

    position is floor(p n), counted from 0 in ascending order; value is the mean of the centroid that holds it, and
    low and high are bounds of the values of the `margin` centroids to either side.
    """
    group = Window.partitionBy(*by)
    order = group.orderBy("mean", "low", "high")
    near = order.rowsBetween(-margin, margin)
    cum = (
        digests.withColumn("_upto", F.sum("weight").over(order.rowsBetween(Window.unboundedPreceding, 0)))
        .withColumn("_n", F.sum("weight").over(group))
        .withColumn("_low", F.min("low").over(near)).withColumn("_high", F.max("high").over(near))
    )
    out = []
    for i, p in enumerate(ps):
        pos = F.least(F.floor(F.lit(float(p)) * F.col("_n")), F.col("_n") - 1)
        mean = F.when(F.isnan("mean"), F.col("low")).otherwise(F.least(F.greatest("mean", "low"), F.col("high")))
        at = F.when((F.col("_upto") > pos) & (F.col("_upto") - F.col("weight") <= pos),
                    F.struct(pos.alias("position"), mean.alias("value"), F.col("_low").alias("low"), F.col("_high").alias("high")))
        out.append(F.first(at, ignorenulls=True).alias(f"q{i}"))
    return cum.groupBy(*by).agg(F.first("_n").alias("n"), *out)


def certify(values: DataFrame, estimates: DataFrame, ps: list[float], plan: ShardPlan, known_few: bool = False) -> DataFrame:
    """The counting pass: id, p, n, position, estimate, rank_from, rank_to, rank_error, exact.

    values: id, value. estimates: of `estimate` by id. rank_from..rank_to are the ranks at which the estimate may stand
    among the values (equal ones share theirs; rank_to is rank_from if it occurs not at all); rank_error is the distance of
    position from them as a share of n. exact is the value at position, or null if it lies outside of the estimate's low and
    high, which the counts then show.

    A pass, made at once, adds up what lies below low and counts the values from low to high; what is above isn't kept. The values of one
    group between low and high are a small share of it (about 5 pi / (2 delta)); they are counted by bins, and only the bin of
    the position is sorted in one task. known_few: estimates are known to have at most MAX_BROADCAST rows.
    """
    values = values.select("id", "value")
    rows = values.join(F.broadcast(estimates), "id") if known_few else join_by_id(values, estimates, plan, max_rows=MAX_BROADCAST)
    parts = []
    for i, p in enumerate(ps):
        q = F.col(f"q{i}")
        v = F.when(F.col("value") >= q["low"], F.col("value"))  # null: below
        inside = F.when(F.col("value") <= q["high"], F.struct(F.lit(float(p)).alias("p"), F.col("n").alias("n"), q["position"].alias("position"), q["value"].alias("estimate"), q["low"].alias("low"), q["high"].alias("high"), v.alias("v")))
        parts.append(inside)
    # A small share of the rows; read three times.
    counted = written(
        rows.select("id", F.explode(F.array_compact(F.array(*parts))).alias("c")).select("id", "c.*")
        .groupBy("id", "p", "n", "position", "estimate", "low", "high", "v").agg(F.count(F.lit(1)).alias("rows")), "counted")
    pos, est = F.col("position"), F.col("estimate")
    exact = at_rank(counted, ["id", "p"], "v", "rows", "position", "low", "high").select("id", "p", F.col("v").alias("exact"))
    ranked = counted.groupBy("id", "p", "n", "position", "estimate").agg(
        F.coalesce(F.sum(F.when(F.col("v").isNull() | (F.col("v") < est), F.col("rows"))), F.lit(0)).alias("rank_from"),
        F.coalesce(F.sum(F.when(F.col("v") == est, F.col("rows"))), F.lit(0)).alias("_same"))
    return (
        same(ranked, exact, ["id", "p"], "left")
        .withColumn("rank_to", F.col("rank_from") + F.greatest(F.col("_same") - 1, F.lit(0)))
        .withColumn("rank_error", F.greatest(F.col("rank_from") - pos, pos - F.col("rank_to"), F.lit(0)) / F.col("n"))
        .select("id", "p", "n", "position", "estimate", "rank_from", "rank_to", "rank_error", "exact")
    )


def series_digests(ordered: DataFrame, plan: ShardPlan, delta: int = DELTA) -> DataFrame:
    """Digest of each series (id) from its `ordered_readings`, made by shard and merged."""
    parts = digest(ordered, ["id", "shard"], delta=delta)
    if not plan.hot:
        return parts.drop("shard")
    if max(map(len, plan.cuts.values())) >= FAN_IN:
        parts = merge_digests(parts.withColumn("_some", F.expr(f"shard div {FAN_IN}")), ["id", "_some"], delta)
    hot = ordered.sparkSession.createDataFrame([(i, True) for i in plan.cuts], "id long, _hot boolean")
    return merge_digests(parts.join(F.broadcast(hot), "id", "left"), ["id"], delta, several="_hot")


def series_quantiles(rows: DataFrame, ps: list[float], delta: int = DELTA, min_n: int = 1, **layout) -> DataFrame:
    """`certify` for the current readings of each series of `rows` (id, time, value, flag, seq, as delivered) with at least
    min_n of them."""
    plan = plan_shards(rows, **layout)
    ordered = ordered_readings(rows, plan)
    known = estimate(series_digests(ordered, plan, delta), ["id"], ps).where(F.col("n") >= min_n)
    if few := rows.select("id").distinct().count() <= MAX_BROADCAST:
        # Both uses of the ordered readings share one exchange; the planner sees that they are the same.
        return certify(ordered, known, ps, plan, few)
    return certify(ordered, written(known, "estimates"), ps, plan)
