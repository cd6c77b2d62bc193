"""Statistical functions of groups of rows, each with a value, a time and a flag.

Averages, extremes, counts and deviations are one grouped aggregation with
partial sums. Where percentiles are asked for, groups up to a bound are exchanged
and sorted once, for all functions together. Percentiles of larger ones are exact
without gathering a group: a mergeable sketch gives bounds around the wanted rank,
one more pass counts what lies below them, and bins narrow down to the row.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewell.operators.ranks import at_rank, same
from tidewell.plans.cut import written
from tidewell.types import MIN_VALUE, STATS

#: Percentile functions by name.
PERCENTILES = {"median": 0.5, "percentile90": 0.9, "percentile99": 0.99}
#: Ranks of the sketch are off by at most n / ACCURACY.
ACCURACY = 2_000
#: Groups up to which their bounds are broadcast to the rows.
MAX_BROADCAST_GROUPS = 500_000
#: Rows of a group that one task sorts.
LARGE_GROUP = 5_000_000

_AGGREGATES: dict[str, Callable[[], tuple[Column, Column]]] = {
    "average": lambda: (F.avg("value"), F.max("time")),
    "sigma": lambda: (F.stddev_pop("value"), F.max("time")),
    "minimum": lambda: (F.min("value"), F.max_by("time", F.struct(-F.col("value"), F.col("time")))),
    "maximum": lambda: (F.max("value"), F.max_by("time", F.struct("value", "time"))),
    "count": lambda: (F.count(F.lit(1)).cast("double"), F.max("time")),
}
#: In the order in which they are listed.
FUNCTIONS = ["average", "median", "percentile90", "percentile99", "sigma", "minimum", "maximum", "count"]


def register(name: str, build: Callable[[], tuple[Column, Column]]) -> None:
    """Adds a function: `build` gives the aggregate Columns of its value (double) and its time over rows (time, value, flag)."""
    key = name.lower()
    if key in PERCENTILES:
        raise ValueError(f"{name} is a percentile")
    _AGGREGATES[key] = build
    if key not in FUNCTIONS:
        FUNCTIONS.append(key)


def available() -> list[str]:
    return list(FUNCTIONS)


def _of_small(rows: DataFrame, by: list[str], ps: dict[str, float], aggs: list[Column]) -> DataFrame:
    """by, aggs and for each percentile function a struct (value, time, flag) of that name, with rows exchanged and sorted once by group."""
    group = Window.partitionBy(*by)
    order = group.orderBy("value", "time", F.col("flag").asc_nulls_first())
    n, two = F.col("_n"), F.col("_n") == 2
    cells = [F.max(F.when((F.col("_at") == F.floor(F.lit(float(p)) * n)) & ~two, F.struct("value", "time", "flag"))).alias(f"_p_{fn}") for fn, p in ps.items()]
    pair = F.struct((F.sum(F.when(two, F.col("value"))) / 2).alias("value"), F.max(F.when(two, F.col("time"))).alias("time"),
                    F.min(F.when(two, F.struct("time", "value", "flag")))["flag"].alias("flag")).alias("_pair")
    found = rows.withColumns({"_at": F.row_number().over(order) - 1, "_n": F.count(F.lit(1)).over(group)}).groupBy(*by).agg(*aggs, *cells, pair)
    return found.withColumns({f"_p_{fn}": F.coalesce(f"_p_{fn}", "_pair") for fn in ps}).drop("_pair")


def _of_large(rows: DataFrame, by: list[str], ps: dict[str, float], aggs: list[Column]) -> DataFrame:
    """The same, where no group may come together. A mergeable sketch gives bounds around each rank; one pass counts what lies below them and the
    values between; the value at the rank, then the time and the flag, are found by bins (`at_rank`)."""
    named = list(ps.items())
    wanted = [x for _, p in named for x in (max(0.0, p - 2 / ACCURACY), min(1.0, p + 2 / ACCURACY))]
    n = F.col("_n")
    # The sketch may give the extremes only roughly; near the ends the least and largest value are the bounds.
    bounds = {}
    for i, (_, p) in enumerate(named):
        bounds |= {f"_low{i}": F.when(n * p < 4.0, F.col("_min")).otherwise(F.get("_b", F.lit(2 * i))),
                   f"_high{i}": F.when(n * (1 - p) < 4.0, F.col("_max")).otherwise(F.get("_b", F.lit(2 * i + 1)))}
    # Read for their number and for two joins.
    groups = written(
        rows.groupBy(*by).agg(
            *aggs, F.count(F.lit(1)).alias("_n"), F.percentile_approx("value", F.array(*[F.lit(b) for b in wanted]), F.lit(ACCURACY)).alias("_b"),
            F.min("value").alias("_min"), F.max("value").alias("_max"), F.min("time").alias("_from"), F.max("time").alias("_to"))
        .withColumns(bounds).drop("_b"), "bounds")
    small = F.broadcast if groups.count() <= MAX_BROADCAST_GROUPS else (lambda df: df)
    v = F.col("value")
    sides = [F.when(v <= F.col(f"_high{i}"), F.struct(
        F.lit(fn).alias("fn"), F.floor(F.lit(float(p)) * n).alias("_rank"), F.col(f"_low{i}").alias("_low"), F.col(f"_high{i}").alias("_high"),
        F.when(v >= F.col(f"_low{i}"), v).alias("value"))) for i, (fn, p) in enumerate(named)]
    keys = [*by, "fn"]
    counted = (
        same(rows, small(groups.select(*by, "_n", *bounds)), by).select(*by, F.explode(F.array_compact(F.array(*sides))).alias("c")).select(*by, "c.*")
        .groupBy(*keys, "_rank", "_low", "_high", "value").agg(F.count(F.lit(1)).alias("_k")))
    values = written(at_rank(counted, keys, "value", "_k", "_rank", "_low", "_high"), "at-rank")
    equal = (
        same(rows, small(same(values.withColumnRenamed("value", "_value"), groups.select(*by, "_from", "_to"), by)), by).where(F.col("value") == F.col("_value"))
        .groupBy(*keys, "value", F.col("_left").alias("_rank"), "_from", "_to", "time", "flag").agg(F.count(F.lit(1)).alias("_k")))
    times = at_rank(equal, keys, "time", "_k", "_rank", "_from", "_to")
    flags = same(equal.select(*keys, "value", "time", "flag", "_k"), times, [*keys, "time"])
    upto = F.sum("_k").over(Window.partitionBy(*keys).orderBy(F.col("flag").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0))
    rows_at = flags.withColumn("_upto", upto).where((F.col("_upto") > F.col("_left")) & (F.col("_upto") - F.col("_k") <= F.col("_left")))
    cells = rows_at.groupBy(*by).agg(*[F.first(F.when(F.col("fn") == fn, F.struct("value", "time", "flag")), ignorenulls=True).alias(f"_p_{fn}") for fn in ps])
    return same(groups.drop("_n", "_min", "_max", "_from", "_to", *bounds), cells, by)


def percentile_rows(rows: DataFrame, by: list[str], ps: dict[str, float], aggs: list[Column] | None = None, large: int = LARGE_GROUP) -> DataFrame:
    """by, aggs and for each p a struct _p_<fn> (value, time, flag): of n rows in order of (value, time, flag) the one at floor(p n), counted from 0. Of
    two rows: the mean of both values, the later time, the flag of the earlier row.

    rows: by, time, value, flag, without null or NaN values; written once, as they are read for the sizes of groups and for the results.
    Groups of at most `large` rows are each sorted in a task; of larger ones, of which there are at most rows / large, no task gets more
    than a small part (see `_of_large`). Both ways give the same.
    """
    aggs = aggs or []
    rows = written(rows, "rows")
    k = 0
    if rows.count() > large:  # by the files' footers; else no group can be
        big = written(rows.groupBy(*by).agg(F.count(F.lit(1)).alias("_size")).where(F.col("_size") > large).select(*by, F.lit(True).alias("_big")), "large")
        k = big.count()
    if not k:
        return _of_small(rows, by, ps, aggs)
    marked = same(rows, F.broadcast(big) if k <= MAX_BROADCAST_GROUPS else big, by, "left")
    return _of_small(marked.where(F.col("_big").isNull()).drop("_big"), by, ps, aggs).unionByName(_of_large(marked.where("_big").drop("_big"), by, ps, aggs))


def calculate(rows: DataFrame, functions: Iterable[str], by: list[str] | None = None, compat_min_value: bool = False) -> DataFrame:
    """by, ord, fn, time, value, flag: one row for each group and each function, ord being its place in `functions`.

    rows: by, time, value, flag, one row for each (id, time), without null or NaN values. Names are looked up without regard to
    case. An unknown one gives time 0, value 0, flag 0. The flag of the others has the statistics bit set; a null flag counts as
    0. A group without rows gives none. compat_min_value: the maximum is at least the smallest positive normal double.
    """
    by = ["id"] if by is None else by
    asked = [(i, f, f.lower()) for i, f in enumerate(functions)]
    plain = [(i, f, k) for i, f, k in asked if k in _AGGREGATES]
    ps = {k: PERCENTILES[k] for _, _, k in asked if k in PERCENTILES}
    unknown = [(i, f) for i, f, k in asked if k not in _AGGREGATES and k not in PERCENTILES]
    long0 = F.lit(0).cast("long")
    aggs, cells = [], []
    for i, f, k in plain:
        v, t = _AGGREGATES[k]()
        if k == "maximum" and compat_min_value:
            v = F.greatest(v, F.lit(MIN_VALUE))
        aggs += [v.cast("double").alias(f"_v{i}"), t.alias(f"_t{i}")]
        cells.append(_cell(i, f, F.col(f"_t{i}"), F.col(f"_v{i}"), F.lit(STATS).cast("long")))
    for i, f in unknown:
        cells.append(_cell(i, f, long0, F.lit(0.0), long0))
    for i, f, k in asked:
        if k in ps:
            at = F.col(f"_p_{k}")
            cells.append(_cell(i, f, at["time"], at["value"], F.coalesce(at["flag"], long0).bitwiseOR(F.lit(STATS).cast("long"))))
    if not cells:
        raise ValueError("no function is asked for")
    if ps:
        grouped = percentile_rows(rows.select(*by, "time", "value", "flag"), by, ps, aggs)
    else:
        grouped = rows.groupBy(*by).agg(*(aggs or [F.count(F.lit(1)).alias("_any")]))
    return grouped.select(*by, F.explode(F.array(*cells)).alias("c")).select(*by, "c.*")


def _cell(i: int, fn: str, time: Column, value: Column, flag: Column) -> Column:
    return F.struct(F.lit(i).alias("ord"), F.lit(fn).alias("fn"), time.alias("time"), value.alias("value"), flag.alias("flag"))
