"""Runs of identical or near-identical successive readings, each collapsed into one row."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewell.operators.layout import ordered_readings, plan_shards
from tidewell.plans.cut import written
from tidewell.types import EPS


def _fragments(readings: DataFrame, eps: float) -> DataFrame:
    """Runs within each (id, shard). head and tail: it begins or ends its shard."""
    w = Window.partitionBy("id", "shard").orderBy("time")
    here = readings.withColumns({
        "_pt": F.lag("time").over(w), "_pv": F.lag("value").over(w), "_pf": F.lag("flag").over(w),
        "_last": F.lead("time").over(w).isNull(), "_pos": F.row_number().over(w),
    })
    start = F.col("_pt").isNull() | ~F.col("flag").eqNullSafe(F.col("_pf")) | ~(F.abs(F.col("value") - F.col("_pv")) < eps)
    # Only the boundary rows go on: the starts, and the last row of the shard.
    kept = here.withColumn("_start", F.coalesce(start, F.lit(True))).where(F.col("_start") | F.col("_last"))
    nxt = {c: F.lead(c).over(w) for c in ("_pos", "_pt", "_pv", "_start", "time", "value")}
    runs = kept.withColumns({f"_n{c.strip('_')}": x for c, x in nxt.items()}).where("_start")
    open_end = F.col("_nstart").isNotNull() & ~F.col("_nstart")  # the next kept row is the shard's last and no start
    return runs.select(
        "id", "shard", F.col("time").alias("time_from"),
        F.when(F.col("_nstart").isNull(), F.col("time")).when(open_end, F.col("_ntime")).otherwise(F.col("_npt")).alias("time_to"),
        F.when(F.col("_nstart").isNull(), 1).when(open_end, F.col("_npos") - F.col("_pos") + 1).otherwise(F.col("_npos") - F.col("_pos")).cast("long").alias("n"),
        "flag", "value",
        F.when(F.col("_nstart").isNull(), F.col("value")).when(open_end, F.col("_nvalue")).otherwise(F.col("_npv")).alias("last_value"),
        F.col("_pt").isNull().alias("head"), (F.col("_nstart").isNull() | open_end).alias("tail"),
    )


def collapse_runs(rows: DataFrame, eps: float = EPS, min_n: int = 1, **layout) -> DataFrame:
    """Each maximal stretch of successive current readings of an id in which every one has the flag of the one before (null
    equals null) and a value less than eps away from it, as one row: id, time_from, time_to, n, duration (ms; null if that isn't a long), flag, value (of
    the first), last_value. Stretches of fewer than min_n readings are left out.

    rows: id, time, value, flag, seq, as delivered; all ids count. Infinite values are near nothing, not even each other.

    Readings are kept only where they differ from their predecessor; the difference of the positions of two successive starts
    is the count, the predecessor's time of the later one the end. A series that is cut has at most two runs for each shard that
    may go on in another one; only these are put together across shards, however long the series is.
    """
    plan = plan_shards(rows, **layout)
    frag = _fragments(ordered_readings(rows, plan), eps)
    cols = ["id", "time_from", "time_to", "n", "flag", "value", "last_value"]
    if plan.hot:
        hot = rows.sparkSession.createDataFrame([(i, True) for i in plan.cuts], "id long, _hot boolean")
        frag = frag.join(F.broadcast(hot), "id", "left").withColumn("_open", F.col("_hot").isNotNull() & (F.col("head") | F.col("tail")))
        kept = written(frag.where(F.col("_open") | (F.col("n") >= min_n)), "runs")
        w = Window.partitionBy("id").orderBy("time_from")
        joins = (F.lag("last_value").over(w).isNotNull() & F.col("head") & F.lag("tail").over(w) & F.col("flag").eqNullSafe(F.lag("flag").over(w))
                 & (F.abs(F.col("value") - F.lag("last_value").over(w)) < eps))
        stitched = (
            kept.where("_open").withColumn("_run", F.when(joins, 0).otherwise(1)).withColumn("_run", F.sum("_run").over(w))
            .groupBy("id", "_run")
            .agg(F.min("time_from").alias("time_from"), F.max("time_to").alias("time_to"), F.sum("n").alias("n"), F.first("flag").alias("flag"),
                 F.min_by("value", "time_from").alias("value"), F.max_by("last_value", "time_from").alias("last_value"))
        )
        frag = kept.where(~F.col("_open")).select(*cols).unionByName(stitched.select(*cols))
    return frag.where(F.col("n") >= min_n).select(*cols).withColumn("duration", F.try_subtract("time_to", "time_from"))
