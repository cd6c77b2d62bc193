"""Rolling totals over trailing periods, by prefix sums."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewell.functions.timeutil import epoch_day
from tidewell.operators.layout import ordered_readings, plan_shards

_SPAN = 4096


def daily_totals(rows: DataFrame, **layout) -> DataFrame:
    """id, epoch_day, n, total, pos_inf, neg_inf of the current readings of each day with a reading.

    Infinite values are counted apart from `total`, so that they leave later windows alone.
    """
    plan = plan_shards(rows, **layout)
    v = F.col("value")
    inf = float("inf")
    days = (
        ordered_readings(rows, plan)
        .groupBy("id", "shard", epoch_day("time").alias("epoch_day"))  # no exchange: rows of a shard are together
        .agg(F.count(F.lit(1)).alias("n"),
             F.sum(F.when(F.abs(v) < inf, v).otherwise(0.0)).alias("total"),
             F.sum((v == inf).cast("long")).alias("pos_inf"),
             F.sum((v == -inf).cast("long")).alias("neg_inf"))
    )
    if plan.hot:  # a day may lie in two shards
        days = days.groupBy("id", "epoch_day").agg(*[F.sum(c).alias(c) for c in ("n", "total", "pos_inf", "neg_inf")])
    return days.select("id", "epoch_day", "n", "total", "pos_inf", "neg_inf")


def rolling_totals(rows: DataFrame, periods: tuple[int, ...] = (7, 30), **layout) -> DataFrame:
    """For each id and each UTC day from its first to its last with a current reading: `total_k`,
    `average_k` and `n_k` of the readings of that day and the k - 1 days before, for k in periods.

    rows: id, time, value, flag, seq, as delivered. Days without a reading are in the result. Without
    any reading in the period the total is 0 and the average null. Infinite values give an infinite
    (or, with both signs, NaN) total while they are in the period.

    Readings are added up by day first; a running sum over days is carried forward into days without
    readings, and a trailing total is the difference of two running sums. What is kept for an id is at
    most one row a day, however many readings it has.
    """
    w = Window.partitionBy("id").orderBy("epoch_day")
    parts = ("n", "total", "pos_inf", "neg_inf")
    prefix = (
        daily_totals(rows, **layout)
        .withColumns({p: F.sum(p).over(w) for p in parts} | {"_next": F.lead("epoch_day").over(w)})
    )
    # Each prefix holds until the next day with a reading; long gaps are spread in two steps.
    until = F.coalesce(F.col("_next") - 1, F.col("epoch_day"))
    one = F.lit(1).cast("long")
    dense = (
        prefix.withColumn("_until", until)
        .withColumn("_from", F.explode(F.sequence("epoch_day", "_until", F.lit(_SPAN).cast("long"))))
        .withColumn("epoch_day", F.explode(F.sequence("_from", F.least(F.col("_until"), F.col("_from") + (_SPAN - 1)), one)))
        .select("id", "epoch_day", *parts)
    )
    cols = {}
    for k in periods:
        diff = {p: F.col(p) - F.coalesce(F.lag(p, k).over(w), F.lit(0)) for p in parts}
        total = (F.when((diff["pos_inf"] > 0) & (diff["neg_inf"] > 0), float("nan")).when(diff["pos_inf"] > 0, float("inf"))
                 .when(diff["neg_inf"] > 0, float("-inf")).when(diff["n"] == 0, 0.0).otherwise(diff["total"]))
        cols |= {f"n_{k}": diff["n"], f"total_{k}": total, f"average_{k}": F.when(diff["n"] > 0, total / diff["n"])}
    return dense.withColumns(cols).select("id", "epoch_day", *cols)
