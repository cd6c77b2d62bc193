"""Time-sharded layout of ordered series.

Ordered operators (runs, gaps, spikes) need each series in order of time. One
series may hold a third of all rows, so a partitioning by id alone would put a
third of the data into one task. Here a large series is cut into time shards
of about equal size, rows are exchanged once by (id, shard), and what an
operator needs from beyond a shard's ends is handed over as a small halo.

* `plan_shards` finds the cuts from a bounded sample of (id, time), as Spark's
  own range partitioner does. The sample decides only where shards begin, never
  a result. At most `max_shards` cuts exist, whatever the input, so the cut
  table may be broadcast.
* `ordered_readings` labels, exchanges and sorts the rows once, and keeps the
  current reading of each (id, time).
* `halos` gives for each shard of a cut series the last readings before it and
  the first after it.
"""

from __future__ import annotations

import bisect
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewell.types import NO_DATA

#: Bounds of the layout: rows a shard aims at, cuts in all, sampled rows.
SHARD_ROWS = 150_000
MAX_SHARDS = 50_000
SAMPLE_ROWS = 400_000
#: Rows and bytes of input of a task after an exchange, at most about so many; fewer where spark.sql.shuffle.partitions asks for more tasks.
TASK_ROWS = 2_000_000
TASK_BYTES = 128 << 20
#: Tasks after an exchange at most: each input split reports a size for each of them to the driver. Beyond, tasks get larger and sort on disk.
MAX_TASKS = 20_000

_CUTS = T.StructType([
    T.StructField("id", T.LongType()),
    T.StructField("_t0", T.LongType()),
    T.StructField("_width", T.LongType()),
    T.StructField("_base", T.ArrayType(T.IntegerType())),
    T.StructField("_inner", T.ArrayType(T.ArrayType(T.LongType()))),
])


@dataclass
class ShardPlan:
    """cuts: for each large series the first times of its shards 1, 2, ..., ascending. rows: of the table, where known.
    copies: (id, time) with so many rows that they alone exceed a shard."""

    cuts: dict[int, list[int]] = field(default_factory=dict)
    rows: int = 0
    copies: list[tuple[int, int]] = field(default_factory=list)

    @property
    def hot(self) -> bool:
        return bool(self.cuts)

    def table(self, spark: SparkSession) -> DataFrame:
        """One row for each large series: a grid of cells over its cuts, so that the
        shard of a time is found in one or two steps however many cuts there are."""
        rows = []
        for sid, cuts in self.cuts.items():
            cells = 4 * len(cuts)
            width = max(1, -(-(cuts[-1] - cuts[0] + 1) // cells))
            base, inner = [], []
            for c in range(cells):
                lo, hi = cuts[0] + c * width, cuts[0] + (c + 1) * width
                a, b = bisect.bisect_left(cuts, lo), bisect.bisect_left(cuts, hi)
                base.append(a)
                inner.append(cuts[a:b])
            rows.append((sid, cuts[0], width, base, inner))
        return spark.createDataFrame(rows, _CUTS)


def is_reading(value: Column | str = "value", flag: Column | str = "flag") -> Column:
    """Neither null nor NaN nor marked as no data. A null flag is an ordinary one."""
    v = F.col(value) if isinstance(value, str) else value
    f = F.col(flag) if isinstance(flag, str) else flag
    return v.isNotNull() & ~F.isnan(v) & ~f.eqNullSafe(F.lit(NO_DATA).cast("long"))


def plan_shards(rows: DataFrame, shard_rows: int = SHARD_ROWS, max_shards: int = MAX_SHARDS,
                sample_rows: int = SAMPLE_ROWS, total: int | None = None) -> ShardPlan:
    """Cuts for the series of `rows` (columns id, time) that exceed one and a half shards.

    A shard aims at `shard_rows` rows, or at total / max_shards if that is more.
    Rows are sampled by a hash of (id, time, seq), so the plan is the same in every run. About
    `sample_rows` of them are, whatever the total; those of the same id and time are counted
    before they are sent to the driver.
    """
    n = rows.count() if total is None else total
    target = max(shard_rows, -(-n // max_shards))
    if n <= target:
        return ShardPlan(rows=n)
    share = min(1.0, sample_rows / n)
    hashed = F.xxhash64("time", "id", *[c for c in ("seq",) if c in rows.columns]).bitwiseAND(F.lit((1 << 63) - 1).cast("long"))
    sample = (
        rows.where(F.col("id").isNotNull() & F.col("time").isNotNull() & (hashed <= F.lit(sample_bound(share)).cast("long")))
        .groupBy("id", "time").agg(F.count(F.lit(1)).alias("n")).toPandas()
    )
    cuts, copies = cuts_of(sample["id"].to_numpy(), sample["time"].to_numpy(), sample["n"].to_numpy(), share, target)
    return ShardPlan(cuts, n, copies)


def sample_bound(share: float) -> int:
    """The largest of the hashes 0 to 2^63 - 1 in a sample of that share."""
    return min((1 << 63) - 1, max(0, round(share * (1 << 63)) - 1))


def cuts_of(ids: np.ndarray, times: np.ndarray, n: np.ndarray, share: float, target: int) -> tuple[dict[int, list[int]], list[tuple[int, int]]]:
    """Cuts and copies from a sample: distinct (id, time) with the number of their rows in it."""
    cuts, order = {}, np.lexsort((times, ids))
    ids, times, n = ids[order], times[order], n[order]
    large = np.flatnonzero((n > 2) & (n / share > target))
    copies = [(int(ids[k]), int(times[k])) for k in large]
    n = n.copy()
    n[large] = 1  # they are put together before the exchange
    starts = np.flatnonzero(np.r_[True, ids[1:] != ids[:-1]]) if len(ids) else []
    for a, b in zip(starts, [*starts[1:], len(ids)]):
        upto = np.cumsum(n[a:b])
        shards = round(int(upto[-1]) / share / target)
        if shards >= 2:
            own = times[a:b]
            at = {int(own[k]) for k in np.searchsorted(upto, upto[-1] * np.arange(1, shards) // shards, side="right")} - {int(own[0])}
            if at:
                cuts[int(ids[a])] = sorted(at)
    return cuts, copies


def task_count(rows: int) -> int:
    """Tasks for so many rows after an exchange."""
    return min(MAX_TASKS, -(-rows // TASK_ROWS))


def tasks_for(rows: DataFrame) -> int | None:
    """Tasks for an exchange of `rows` by the size of the tables that it reads, without a job; None if the session's number will do."""
    try:
        leaves = rows._jdf.queryExecution().optimizedPlan().collectLeaves()
        sizes = [int(leaves.apply(i).stats().sizeInBytes().toString()) for i in range(leaves.size())]
    except Exception:  # a client without the planner
        return None
    known = sum(x for x in sizes if x < 1 << 62)  # the planner's word for unknown is the largest long
    n = min(MAX_TASKS, -(-known // TASK_BYTES))
    return n if n > int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")) else None


def exchanged(rows: DataFrame, plan: ShardPlan) -> DataFrame:
    """Rows by id and shard, or by id where no series is cut: the planner takes a constant out of a window's keys, and would not see that
    an exchange by both serves it. Tasks don't outgrow memory with the table: if the session's number of partitions is too small for it, there
    are more; else the adaptive planner may put small ones together."""
    n, keys = task_count(plan.rows), ("id", "shard") if plan.hot else ("id",)
    if n > int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")):
        return rows.repartition(n, *keys)
    return rows.repartition(*keys)


def with_shard(rows: DataFrame, plan: ShardPlan, time: Column | str = "time") -> DataFrame:
    """Adds `shard`: 0 for series that aren't cut, else the number of cuts at or before `time`."""
    if not plan.hot:
        return rows.withColumn("shard", F.lit(0))
    t = F.col(time) if isinstance(time, str) else time
    last = F.size("_base").cast("long") - 1
    cell = F.least(F.coalesce(F.call_function("div", F.try_subtract(t, F.col("_t0")), F.col("_width")), last), last).cast("int")
    cell = F.when(t < F.col("_t0"), F.lit(0)).otherwise(cell)
    shard = F.get("_base", cell) + F.size(F.filter(F.get("_inner", cell), lambda s: s <= t))
    return (
        rows.join(F.broadcast(plan.table(rows.sparkSession)), "id", "left")
        .withColumn("shard", F.when(F.col("_t0").isNull() | t.isNull(), F.lit(0)).otherwise(shard))
        .drop("_t0", "_width", "_base", "_inner")
    )


def ordered_rows(rows: DataFrame, plan: ShardPlan, keep: tuple[str, ...] = (), shard_time: Column | str = "time") -> DataFrame:
    """id, shard, time, value, flag (and `keep`) of the latest row of each (id, time), by shard.

    Rows without id or time have no place in an order and are left out. Of rows
    with the same id and time the one with the largest seq stays (a null seq
    counts as the smallest; on equal seq the larger flag, then the larger value
    decides). shard_time: what is compared with the cuts, if not the time itself;
    it must not fall as time rises.
    """
    w = Window.partitionBy("id", "shard").orderBy("time", F.col("seq").asc_nulls_first(), F.col("flag").asc_nulls_first(),
                                                  F.col("value").asc_nulls_first())
    placed = rows.where(F.col("id").isNotNull() & F.col("time").isNotNull()).select("id", "time", "value", "flag", "seq", *keep)
    if plan.copies:  # the last of them in each input split, so that they don't meet in one task
        pairs = F.broadcast(rows.sparkSession.createDataFrame(plan.copies, "id long, time long"))
        kept = ["value", "flag", "seq", *keep]
        last = (placed.join(pairs, ["id", "time"], "left_semi").groupBy("id", "time")
                .agg(F.max_by(F.struct(*kept), F.struct("seq", "flag", "value")).alias("_r")).select("id", "time", "_r.*"))
        placed = placed.join(pairs, ["id", "time"], "left_anti").unionByName(last)
    return (
        exchanged(with_shard(placed, plan, shard_time), plan)
        .withColumn("_next", F.lead("time").over(w))
        .where(F.col("_next").isNull() | (F.col("_next") != F.col("time")))
        .select("id", "shard", "time", "value", "flag", *keep)
    )


def ordered_readings(rows: DataFrame, plan: ShardPlan, keep: tuple[str, ...] = (), shard_time: Column | str = "time") -> DataFrame:
    """`ordered_rows` that are readings: the current readings, in order within each (id, shard)."""
    return ordered_rows(rows, plan, keep, shard_time).where(is_reading())


def join_by_id(rows: DataFrame, dims: DataFrame, plan: ShardPlan, how: str = "inner", max_rows: int = 1_000_000) -> DataFrame:
    """Joins `dims` (one row for each id) to `rows` on id without moving large series by their id.

    Up to `max_rows` rows of dims are broadcast, after counting them. Beyond that, the dims of cut
    series (at most as many as the plan has cuts) are broadcast to the rows of these, and only the
    other series, none of which exceeds one and a half shards, are exchanged by id.
    """
    if dims.count() <= max_rows:
        return rows.join(F.broadcast(dims), "id", how)
    if not plan.hot:
        return rows.join(dims, "id", how)
    hot = rows.sparkSession.createDataFrame([(i,) for i in plan.cuts], "id long")
    some = rows.join(F.broadcast(hot), "id", "left_semi").join(F.broadcast(dims.join(F.broadcast(hot), "id", "left_semi")), "id", how)
    rest = rows.join(F.broadcast(hot), "id", "left_anti").join(dims, "id", how)
    return some.unionByName(rest)


def halos(rows: DataFrame, plan: ShardPlan, order: str, k: int, columns: list[str]) -> DataFrame | None:
    """For each (id, shard) of a cut series: `pre`, the k rows before the shard, nearest first, and
    `post`, the k rows after it, nearest first, as arrays of struct(columns) with nulls beyond the
    ends of the series. None if no series is cut. At most one row for each shard of the plan, so the
    result may be broadcast. `rows` holds each (id, order) once, with its shard.
    """
    if not plan.hot:
        return None
    w = Window.partitionBy("id", "shard").orderBy(order)
    # An inner join, as a semi join would be moved below the exchange, which could then not be reused.
    hot = rows.sparkSession.createDataFrame([(i, True) for i in plan.cuts], "id long, _hot boolean")
    near = (
        rows.withColumn("_far_l", F.lag(order, k).over(w)).withColumn("_far_r", F.lead(order, k).over(w))
        .withColumn("_l", F.lag(order).over(w)).withColumn("_r", F.lead(order).over(w))
        .where(F.col("_far_l").isNull() | F.col("_far_r").isNull())
        .join(F.broadcast(hot), "id").where("_hot")
    )
    # At most 2k rows for each shard of a cut series are left here.
    line = Window.partitionBy("id").orderBy(order)
    s = F.struct(*columns)
    return (
        near
        .withColumn("_pre", F.when(F.col("_l").isNull(), F.array(*[F.lag(s, i).over(line) for i in range(1, k + 1)])))
        .withColumn("_post", F.when(F.col("_r").isNull(), F.array(*[F.lead(s, i).over(line) for i in range(1, k + 1)])))
        .groupBy("id", "shard")
        .agg(F.first("_pre", ignorenulls=True).alias("pre"), F.first("_post", ignorenulls=True).alias("post"))
    )


def with_neighbours(rows: DataFrame, halo: DataFrame | None, order: str, columns: list[str], before: int, after: int) -> DataFrame:
    """Adds `l1`..`l<before>` and `r1`..`r<after>`: structs of `columns` of the rows before and after in
    the series, across shard ends; null beyond the ends of the series."""
    w = Window.partitionBy("id", "shard").orderBy(order)
    s = F.struct(*columns)
    out = rows
    if halo is not None:
        whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        out = out.withColumns({"_rn": F.row_number().over(w), "_n": F.count(F.lit(1)).over(whole)})
    out = out.withColumns({f"l{i}": F.lag(s, i).over(w) for i in range(1, before + 1)} | {f"r{i}": F.lead(s, i).over(w) for i in range(1, after + 1)})
    if halo is None:
        return out
    out = out.join(F.broadcast(halo), ["id", "shard"], "left")
    rr = (F.col("_n") - F.col("_rn") + 1).cast("int")
    return out.withColumns(
        {f"l{i}": F.coalesce(f"l{i}", F.when(F.col("_rn") <= i, F.get("pre", F.lit(i) - F.col("_rn")))) for i in range(1, before + 1)}
        | {f"r{i}": F.coalesce(f"r{i}", F.when(rr <= i, F.get("post", F.lit(i) - rr))) for i in range(1, after + 1)}
    ).drop("_rn", "_n", "pre", "post")
