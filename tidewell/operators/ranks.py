"""The value at a rank of very large groups, without sorting a group in one task."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Bins into which a range of values is cut.
BINS = 4096


def same(a: DataFrame, b: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join by keys in which null equals null. No condition on the keys is added to either side, so that exchanges stay alike and are reused."""
    named = b.withColumnsRenamed({k: f"_same_{k}" for k in keys})
    on = reduce(lambda x, y: x & y, [a[k].eqNullSafe(named[f"_same_{k}"]) for k in keys])
    return a.join(named, on, how).drop(*[f"_same_{k}" for k in keys])


def bin_of(value: Column, low: Column, high: Column, bins: int = BINS) -> Column:
    """0 to bins - 1, never falling as value rises from low to high; -1 for null. Ranges that aren't finite have two bins: high, and what is below."""
    place = F.floor((value - low) / (high - low) * bins)
    return (F.when(value.isNull(), F.lit(-1)).when(value >= high, F.lit(bins - 1)).when((place >= 0) & (place < bins), place)
            .when(place >= bins, F.lit(bins - 1)).otherwise(F.lit(0)).cast("int"))


def at_rank(rows: DataFrame, keys: list[str], value: str, count: str, rank: str, low: str, high: str, bins: int = BINS) -> DataFrame:
    """keys, value, _left for each key with a value there: the value at `rank`, counted from 0, of the key's values in ascending order, each
    `count` times, nulls first; _left is the rank within the rows of that value.

    rank, low and high (bounds of the values) are the same in all rows of a key. Counts by bin show the bin that holds the rank; only its
    values come together, by key and bin, and are sorted. rows is read twice; if it ends in an exchange, that is shared.
    """
    binned = rows.withColumn("_bin", bin_of(F.col(value).cast("double"), F.col(low).cast("double"), F.col(high).cast("double"), bins))
    by_bin = binned.groupBy(*keys, "_bin").agg(F.sum(count).alias("_n"), F.first(rank).alias("_rank"))
    chosen = _reached(by_bin, keys, [F.col("_bin")], "_rank").select(*keys, "_bin", "_left")
    hit = same(binned.select(*keys, "_bin", value, count), chosen, [*keys, "_bin"])
    by_value = hit.groupBy(*keys, value).agg(F.sum(count).alias("_n"), F.first("_left").alias("_rank"))
    return _reached(by_value, keys, [F.col(value).asc_nulls_first()], "_rank").select(*keys, value, "_left")


def _reached(sums: DataFrame, keys: list[str], order: list[Column], rank: str) -> DataFrame:
    """The row of each key in which the running sum of _n passes the rank; _left is what of the rank is left there."""
    upto = F.sum("_n").over(Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    cum = sums.withColumn("_upto", upto)
    return cum.where((F.col("_upto") > F.col(rank)) & (F.col("_upto") - F.col("_n") <= F.col(rank))).withColumn("_left", F.col(rank) - (F.col("_upto") - F.col("_n")))
