"""Calendar roll-ups along links of the scheme, retention and erasure."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewell.functions.statistic import available, calculate
from tidewell.functions.timeutil import bucket_start, bucket_start_of
from tidewell.operators.layout import is_reading, join_by_id, plan_shards
from tidewell.operators.reads import current_value, dedupe
from tidewell.plans.cut import written
from tidewell.plans.scheme import NAME_INTERVALS, linked, of_interval
from tidewell.plans.settings import Settings
from tidewell.types import INTERVALS, MAX_TIME

#: Links that are broadcast.
MAX_LINKS = 500_000


def rollup(readings: DataFrame, interval: str, functions: Iterable[str], by: str = "id") -> DataFrame:
    """id, bucket (its first ms), ord, fn, time, value, flag: the functions over each series' calendar periods."""
    return calculate(readings.withColumn("bucket", bucket_start("time", interval)), functions, [by, "bucket"])


def rollup_links(readings: DataFrame, links: DataFrame, since: Column | None = None, functions: list[str] | None = None) -> DataFrame:
    """id, time, value, flag to be appended to the coarser series: for each link the coarser series' function over the finer one's
    readings, by period of the coarser interval; the row's time is the function's (it lies in the period), its flag 0.

    readings: one row for each (id, time). links: of `scheme.linked`; those without a known function give nothing. since: only
    readings from this time on count (a backfill from the coarser series' last period). functions: the known ones among the links'
    functions; looked up if not given.
    """
    known = links.where(F.lower("dst_func").isin(*available()))
    rows = readings.select(F.col("id").alias("src_id"), "time", "value", "flag")
    if since is not None:
        rows = rows.where(F.col("time") >= since)
    joined = _join_links(rows, known).select(
        F.col("dst_id").alias("id"), bucket_start_of("time", F.col("dst_interval")).alias("bucket"), F.lower("dst_func").alias("want"), "src_id", "time", "value", "flag")
    return _wanted(joined, known, functions)


def _join_links(rows: DataFrame, links: DataFrame) -> DataFrame:
    """By src_id. Links are counted and broadcast up to MAX_LINKS; beyond, large series aren't moved by their id (`join_by_id`)."""
    if links.count() <= MAX_LINKS:
        return rows.join(F.broadcast(links), "src_id")
    named = rows.withColumnRenamed("src_id", "id")
    return join_by_id(named, links.withColumnRenamed("src_id", "id"), plan_shards(named), max_rows=MAX_LINKS).withColumnRenamed("id", "src_id")


def _of_ids(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of these ids, which are counted and broadcast up to MAX_LINKS; beyond, nothing is left out, as the rows would have to be moved by id."""
    return rows.join(F.broadcast(ids), "id", "left_semi") if ids.count() <= MAX_LINKS else rows


def _wanted(joined: DataFrame, links: DataFrame, names: list[str] | None = None) -> DataFrame:
    """joined: id, bucket, want, src_id, time, value, flag. Only functions that some link has (of those known) are calculated."""
    if names is None:
        names = sorted(r[0] for r in links.select(F.lower("dst_func")).distinct().collect())
    done = calculate(joined, names or ["average"], ["id", "bucket", "want", "src_id"])
    return done.where(F.col("fn") == F.col("want")).select("id", "time", "value", F.lit(0).cast("long").alias("flag"))


def cascade(rows: DataFrame, scheme: DataFrame, settings: Settings | None = None) -> DataFrame:
    """All rows (id, time, value, flag) that the roll-ups append, from raw to the coarsest interval, each level from the rows of the
    level before: what was stored there and what was appended to it (which replaces a stored row of its time).

    Each existing interval feeds the next coarser one that exists; buckets are those of the coarser one. At most seven levels, each
    written before the next reads it.
    """
    links = written(linked(scheme), "links")
    # Each level reads the stored rows: those of series that take part, deduplicated once.
    ends = links.select(F.explode(F.array("src_id", "dst_id")).alias("id")).distinct()
    stored = written(dedupe(_of_ids(rows, ends)).where(is_reading()), "stored")
    made = None
    steps: dict[str, list[str]] = {}  # at most seven intervals and as many functions as are known
    for r in links.select("src_interval", F.lower("dst_func").alias("fn")).distinct().collect():
        steps.setdefault(r["src_interval"], []).extend([r["fn"]] if r["fn"] in available() else [])
    for interval in NAME_INTERVALS:
        if not steps.get(interval):
            continue
        own = links.where(F.col("src_interval") == interval)
        source = stored if made is None else dedupe(
            stored.withColumn("seq", F.lit(0).cast("long")).unionByName(made.withColumn("seq", F.lit(1).cast("long"))))
        level = written(rollup_links(source, own, functions=sorted(steps[interval])), f"level-{interval}")
        made = level if made is None else made.unionByName(level)
    return made if made is not None else stored.where(F.lit(False))


def backfill(rows: DataFrame, links: DataFrame) -> DataFrame:
    """Rows for the coarser series of each link whose finer one has newer readings: every period from the one that holds the coarser
    series' last row on, including the still open one."""
    own = dedupe(rows).where(is_reading())
    last = own.groupBy("id").agg(F.max("time").alias("until"))
    due = (links.join(last.select(F.col("id").alias("dst_id"), "until"), "dst_id", "left")
           .withColumn("since", F.coalesce(bucket_start_of("until", F.col("dst_interval")), F.lit(0).cast("long"))))
    due = written(due.where(F.lower("dst_func").isin(*available())), "due")  # a row for each link; read three times
    fresh = _join_links(own.select(F.col("id").alias("src_id"), "time", "value", "flag"), due.select("src_id", "dst_id", "dst_interval", "dst_func", "since")).where("time >= since")
    known = fresh.select(F.col("dst_id").alias("id"), bucket_start_of("time", F.col("dst_interval")).alias("bucket"), F.lower("dst_func").alias("want"), "src_id", "time", "value", "flag")
    return _wanted(known, due)


def least_current_time(rows: DataFrame, scheme: DataFrame, interval: str) -> DataFrame:
    """One row: time, the least one of the current values of the interval's series; the largest time if none of them has a row, also
    where the interval has no series (the reference then takes all series, as its current values do without ids)."""
    own = current_value(rows).join(of_interval(scheme, interval), "id", "left_semi")
    return own.agg(F.coalesce(F.min("time"), F.lit(MAX_TIME).cast("long")).alias("time"))


def next_fire(time: int, interval: str) -> int:
    """When a roll-up that ran at `time` runs next: the last ms of the period that holds the middle of the next one."""
    import datetime as dt

    t = time + INTERVALS[interval] // 2
    d = dt.datetime(1970, 1, 1) + dt.timedelta(milliseconds=t)
    ms = lambda x: int((x - dt.datetime(1970, 1, 1)) / dt.timedelta(milliseconds=1))
    if interval in ("minute", "halfhour", "hour", "day"):
        k = INTERVALS[interval]
        return t - t % k + k - 1
    day = d.replace(hour=0, minute=0, second=0, microsecond=0)
    if interval == "week":
        return ms(day - dt.timedelta(days=day.weekday()) + dt.timedelta(days=7)) - 1
    if interval == "month":
        return ms((day.replace(day=1) + dt.timedelta(days=32)).replace(day=1)) - 1
    return ms(day.replace(year=day.year + 1, month=1, day=1)) - 1


def retention(rows: DataFrame, scheme: DataFrame, now: int | Column, settings: Settings | None = None) -> DataFrame:
    """Rows that are younger than their series' interval allows; rows of series without a lifetime stay."""
    s = settings or Settings()
    life = None
    for i in NAME_INTERVALS:
        if (k := s.lifetime_for(i)) is not None:
            life = F.when(F.col("interval") == i, F.lit(k).cast("long")) if life is None else life.when(F.col("interval") == i, F.lit(k).cast("long"))
    t = F.lit(now).cast("long") if isinstance(now, int) else now
    known = scheme.select("id", life.alias("_life")).where(F.col("_life").isNotNull())
    return rows.join(known, "id", "left").where(F.col("_life").isNull() | (F.col("time") > F.greatest(t - F.col("_life"), F.lit(0).cast("long")))).drop("_life")


def erase_old(rows: DataFrame, series: Iterable[int], until: int) -> DataFrame:
    """The rows without those of the series at or before `until`."""
    return rows.where(~(F.col("id").isin(list(series)) & (F.col("time") <= F.lit(until).cast("long"))) | F.col("id").isNull() | F.col("time").isNull())

