"""Read operators over rows as delivered (id, time, value, flag, seq)."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewell.functions.hashing import jenkins
from tidewell.functions.predicates import in_flag, in_interval
from tidewell.functions.timeutil import epoch_day
from tidewell.operators.layout import is_reading, ordered_rows, plan_shards, tasks_for, with_shard
from tidewell.types import DAY, MAX_TIME, NO_DATA, clamp_time

_ROW = ["id", "time", "value", "flag"]


def dedupe(rows: DataFrame, keep: str = "last") -> DataFrame:
    """One row for each (id, time): the last (or first) by seq. On equal seq the larger flag and value decide. Rows without id or
    time are left out.

    Rows are exchanged by (id, time), so no key is large; conditions on id and time reach the scan. They are exchanged first and
    sorted once, as few of them are repeated; the planner's own choice would sort each input split as well.
    """
    o = [F.col("seq"), F.col("flag"), F.col("value")]
    o = [c.desc_nulls_last() for c in o] if keep == "last" else [c.asc_nulls_first() for c in o]
    w = Window.partitionBy("id", "time").orderBy(*o)
    placed = rows.where(F.col("id").isNotNull() & F.col("time").isNotNull()).select(*_ROW, "seq")
    n = tasks_for(placed)
    placed = placed.repartition(n, "id", "time") if n else placed.repartition("id", "time")
    return placed.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").select(*_ROW)


def current_readings(rows: DataFrame) -> DataFrame:
    """The deduplicated rows that are readings (value neither null nor NaN, not marked as no data)."""
    return dedupe(rows).where(is_reading())


def merge_layers(layers: list[DataFrame]) -> DataFrame:
    """One row for each (id, time) of several layers, the newest first: a newer layer hides older ones. Within a layer seq decides
    (a layer without seq has at most one row for each id and time)."""
    parts = []
    for i, x in enumerate(layers):
        seq = F.col("seq").cast("long") if "seq" in x.columns else F.lit(0).cast("long")
        parts.append(x.select(*_ROW, F.struct(F.lit(-i).alias("layer"), seq.alias("seq")).alias("seq")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return dedupe(out)


def concat(layers: list[DataFrame]) -> DataFrame:
    """Layers that share no (id, time), one after the other."""
    out = layers[0].select(*_ROW)
    for x in layers[1:]:
        out = out.unionByName(x.select(*_ROW))
    return out


def read_interval(rows: DataFrame, ids: Iterable[int] | DataFrame, start: int, end: int, mask: int = 0, ordered: bool = True, keep: str = "last") -> DataFrame:
    """Rows of ids from start to end (both included) whose flag has all bits of mask, in the order of ids, then of time. No ids: no
    rows. A repeated id counts once. Rows are deduplicated before the flag is looked at, so a newer row with another flag hides
    an older one. ids may be a DataFrame with a column id (unique), for more of them than a list should hold; the result then is
    in order of id."""
    if isinstance(ids, DataFrame):
        own = rows.join(ids.select("id").distinct(), "id", "left_semi")
        out = dedupe(own.where(in_interval(start, end)), keep).where(in_flag(mask))
        return out.orderBy("id", "time") if ordered else out
    unique = list(dict.fromkeys(ids))
    if not unique:
        return rows.select(*_ROW).where(F.lit(False))
    out = dedupe(rows.where(F.col("id").isin(unique) & in_interval(start, end)), keep).where(in_flag(mask))
    if not ordered:
        return out
    return out.orderBy(F.array_position(F.lit(unique).cast("array<bigint>"), F.col("id")), "time")


def read_time_point(rows: DataFrame, ids: DataFrame, time_point: int, mask: int = 0) -> DataFrame:
    """For each id of `ids` the latest row at or before time_point that passes the mask, else (time_point, 0, no data)."""
    tp = F.lit(clamp_time(time_point)).cast("long")
    last = (
        dedupe(rows.where(F.col("time") <= tp)).where(in_flag(mask))
        .groupBy("id").agg(F.max_by(F.struct("time", "value", "flag"), "time").alias("r"))
    )
    return _or_no_data(ids.select("id").distinct().join(last, "id", "left"), tp)


def _or_no_data(joined: DataFrame, tp) -> DataFrame:
    none = F.col("r").isNull()
    return joined.select(
        "id", F.when(none, tp).otherwise(F.col("r.time")).alias("time"), F.when(none, F.lit(0.0)).otherwise(F.col("r.value")).alias("value"),
        F.when(none, F.lit(NO_DATA).cast("long")).otherwise(F.col("r.flag")).alias("flag"))


def read_time_points(rows: DataFrame, points: DataFrame, mask: int = 0, readings_only: bool = False, **layout) -> DataFrame:
    """As-of lookup of many points: for each row (id, time_point) of `points` the latest row of that id at or before it that passes
    the mask, else no data: id, time_point, time, value, flag. Repeated points are answered repeatedly. readings_only: rows that hold
    no reading are passed over.

    Both sides meet in the time shards of the layout, so neither a large series nor many points of one id come into one task. A
    shard's first points take the last row of the shards before, of which there is one for each shard.
    """
    plan = plan_shards(rows, **layout)
    kept = ordered_rows(rows, plan).where(in_flag(mask) & (is_reading() if readings_only else F.lit(True)))
    asked = with_shard(points.select("id", F.col("time_point").alias("time")), plan).withColumn("_ask", F.lit(1))
    both = kept.withColumn("_ask", F.lit(0)).unionByName(asked, allowMissingColumns=True)
    w = Window.partitionBy("id", "shard").orderBy("time", "_ask").rowsBetween(Window.unboundedPreceding, 0)
    row = F.when(F.col("_ask") == 0, F.struct("time", "value", "flag"))
    found = both.withColumn("r", F.last(row, ignorenulls=True).over(w)).where("_ask = 1").select("id", "shard", F.col("time").alias("time_point"), "r")
    if plan.hot:
        every = rows.sparkSession.createDataFrame([(i, k) for i, c in plan.cuts.items() for k in range(len(c) + 1)], "id long, shard int")
        tails = kept.groupBy("id", "shard").agg(F.max_by(F.struct("time", "value", "flag"), "time").alias("tail"))
        before = Window.partitionBy("id").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
        carry = F.broadcast(every).join(tails, ["id", "shard"], "left").withColumn("carry", F.last("tail", ignorenulls=True).over(before)).select("id", "shard", "carry")
        found = found.join(F.broadcast(carry), ["id", "shard"], "left").withColumn("r", F.coalesce("r", "carry"))
    none = F.col("r").isNull()
    return found.select("id", "time_point", F.when(none, F.col("time_point")).otherwise(F.col("r.time")).alias("time"),
                        F.when(none, F.lit(0.0)).otherwise(F.col("r.value")).alias("value"),
                        F.when(none, F.lit(NO_DATA).cast("long")).otherwise(F.col("r.flag")).alias("flag"))


def current_value(rows: DataFrame, ids: Iterable[int] | None = None, mask: int = 0) -> DataFrame:
    """The latest row of each id (no ids: of all), left out if it doesn't pass the mask. One aggregation without dedupe: the row
    with the largest (time, seq) is the latest one of its time."""
    own = list(ids or [])
    some = rows.where(F.col("time").isNotNull() & F.col("id").isNotNull())
    some = some.where(F.col("id").isin(own)) if own else some
    last = some.groupBy("id").agg(F.max_by(F.struct("time", "value", "flag"), F.struct("time", "seq", "flag", "value")).alias("r"))
    return last.select("id", "r.*").where(in_flag(mask))


def min_max_time(rows: DataFrame) -> DataFrame:
    """One row: min_time (largest time if there are no rows), max_time (0 then)."""
    return rows.agg(F.coalesce(F.min("time"), F.lit(MAX_TIME).cast("long")).alias("min_time"), F.coalesce(F.max("time"), F.lit(0).cast("long")).alias("max_time"))


def id_min_max(rows: DataFrame) -> DataFrame:
    """id, min_time, max_time."""
    return rows.where(F.col("id").isNotNull()).groupBy("id").agg(F.min("time").alias("min_time"), F.max("time").alias("max_time"))


def first_last(rows: DataFrame) -> DataFrame:
    """First and last row of each id, as they are after deduplication."""
    some = rows.where(F.col("time").isNotNull() & F.col("id").isNotNull())
    r, seq = F.struct("time", "value", "flag"), F.struct("seq", "flag", "value")
    ends = some.groupBy("id").agg(
        F.max_by(r, F.struct(F.col("time"), F.col("seq"), F.col("flag"), F.col("value"))).alias("l"),
        # of the rows with the least time the one written last
        F.max_by(F.struct(r.alias("r"), seq.alias("s")), F.struct((-F.col("time")).alias("t"), F.col("seq"), F.col("flag"), F.col("value"))).alias("f"))
    return ends.select("id", F.col("f.r.time").alias("first_time"), F.col("f.r.value").alias("first_value"), F.col("f.r.flag").alias("first_flag"),
                       F.col("l.time").alias("last_time"), F.col("l.value").alias("last_value"), F.col("l.flag").alias("last_flag"))


def range_stat(rows: DataFrame, start: int = 0, end: int = MAX_TIME, by: list[str] | None = None) -> DataFrame:
    """by, min_time, max_time, count, flag_bloom, min_value, max_value, sum of the readings from start to end, whatever their flags,
    each (id, time) once. by: id, or id with further columns that depend on id and time. States of parts are merged by `merge_stats`."""
    by = by or ["id"]
    own = current_readings(rows.where(in_interval(start, end)))
    return stat_of(own, by)


def stat_of(readings: DataFrame, by: list[str]) -> DataFrame:
    """By flag first, as hashing a flag takes longer than counting a row."""
    by_flag = readings.groupBy(*by, F.coalesce("flag", F.lit(0).cast("long")).alias("_flag")).agg(
        F.min("time").alias("min_time"), F.max("time").alias("max_time"), F.count(F.lit(1)).alias("count"), F.min("value").alias("min_value"),
        F.max("value").alias("max_value"), F.sum("value").alias("sum"))
    return merge_stats(by_flag.withColumn("flag_bloom", jenkins("_flag")), by)


def merge_stats(stats: DataFrame, by: list[str]) -> DataFrame:
    """The state of a union from the states of its parts."""
    return stats.groupBy(*by).agg(
        F.min("min_time").alias("min_time"), F.max("max_time").alias("max_time"), F.sum("count").alias("count"), F.bit_or("flag_bloom").alias("flag_bloom"),
        F.min("min_value").alias("min_value"), F.max("max_value").alias("max_value"), F.sum("sum").alias("sum"))


def day_states(rows: DataFrame) -> DataFrame:
    """The state of each id and UTC day: a summary table that is worth keeping beside the rows, as it grows with days and not with
    readings. Days of new or changed rows are computed again and replaced."""
    return stat_of(current_readings(rows).withColumn("day", epoch_day("time")), ["id", "day"])


def range_stat_from(states: DataFrame, rows: DataFrame, start: int, end: int) -> DataFrame:
    """`range_stat` from kept day states: rows are read only of the two days that the range cuts."""
    start, end = clamp_time(start), clamp_time(end)
    first, last = -(-start // DAY), (end + 1) // DAY - 1  # whole days
    if last < first:
        return range_stat(rows, start, end)
    whole = states.where(F.col("day").between(first, last)).drop("day")
    cut = rows.where((F.col("time") >= start) & (F.col("time") < first * DAY) | (F.col("time") >= (last + 1) * DAY) & (F.col("time") <= end))
    return merge_stats(whole.unionByName(stat_of(current_readings(cut), ["id"])), ["id"])


def copy_series(rows: DataFrame, to_id) -> DataFrame:
    """The rows under other ids: to_id is a Column of the new id."""
    return rows.withColumn("id", to_id)


def hour_histogram(rows: DataFrame) -> DataFrame:
    """Rows of each hour of the day (UTC), over all ids."""
    hour = F.call_function("div", F.pmod("time", F.lit(86_400_000).cast("long")), F.lit(3_600_000).cast("long")).cast("int")
    return dedupe(rows).groupBy(hour.alias("hour")).agg(F.count(F.lit(1)).alias("n"))
