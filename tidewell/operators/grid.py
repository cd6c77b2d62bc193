"""Irregular readings onto a regular grid."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewell.functions.timeutil import bucket_start_of, slot_index_of, slot_start_of
from tidewell.operators.layout import halos, join_by_id, ordered_readings, plan_shards, with_neighbours

GRID_INTERVALS = ("minute", "halfhour", "hour", "day", "week", "month")
_SPAN = 4096


def _slope_inside(h0: Column, d0: Column, h1: Column, d1: Column) -> Column:
    """Fritsch-Butland: weighted harmonic mean of the secants; flat where they differ in sign."""
    w0, w1 = h1 * 2 + h0, h1 + h0 * 2
    return F.when(d0 * d1 > 0, (w0 + w1) / (w0 / d0 + w1 / d1)).otherwise(F.lit(0.0))


def _slope_end(h0: Column, d0: Column, h1: Column, d1: Column) -> Column:
    """Three-point slope at the end next to (h0, d0), kept from overshooting; with one secant only, that."""
    s = ((h0 * 2 + h1) * d0 - h0 * d1) / (h0 + h1)
    kept = (F.when(s * d0 <= 0, F.lit(0.0)).when((d0 * d1 <= 0) & (F.abs(s) > F.abs(d0) * 3), d0 * 3).otherwise(s))
    return F.when(d1.isNull(), d0).otherwise(kept)


def regular_grid(rows: DataFrame, scheme: DataFrame, max_gap: int = 24, max_lookup_rows: int = 1_000_000, **layout) -> DataFrame:
    """One row for each period from the first to the last current reading of each series of `scheme`
    whose interval names a period: id, interval, slot_start (epoch ms), n_readings, value, status.

    rows: id, time, value, flag, seq, as delivered. scheme: id (unique; of repeated ids the smallest
    interval name is used), interval. Series without such an interval, or not in scheme, have no grid.

    status `reading`: value is the mean of the period's readings. `filled`: the period has none and lies
    in a gap of at most `max_gap` periods; value is a shape-preserving monotone cubic through the
    periods with readings, never outside the two next to the gap. `gap`: it lies in a longer gap;
    value is null, and the curve ends at both sides of the gap. Infinite means are not interpolated
    across (value null, status `gap`).
    """
    plan = plan_shards(rows, **layout)
    dims = (scheme.where(F.col("interval").isin(*GRID_INTERVALS) & F.col("id").isNotNull())
            .groupBy("id").agg(F.min("interval").alias("interval")))
    placed = join_by_id(rows.select("id", "time", "value", "flag", "seq").where(F.col("time").isNotNull()), dims, plan, max_rows=max_lookup_rows)
    # Shards begin with a period, so that no period lies in two.
    at = bucket_start_of("time", F.col("interval"))
    slots = (
        ordered_readings(placed, plan, keep=("interval",), shard_time=at)
        .groupBy("id", "shard", "interval", slot_index_of("time", F.col("interval")).alias("slot"))  # no exchange
        .agg(F.count(F.lit(1)).alias("n_readings"), F.avg("value").alias("value"))
    )
    halo = halos(slots, plan, "slot", 3, ["slot", "value"])
    near = with_neighbours(slots, halo, "slot", ["slot", "value"], before=2, after=3)

    # Names of the points around the gap between x0 (this row) and x1: xm, x0 | x1, x2, x3.
    def joined(a: Column, b: Column) -> Column:
        return (b["slot"] - a["slot"] <= max_gap + 1) & (F.abs(a["value"]) < float("inf")) & (F.abs(b["value"]) < float("inf"))

    here = F.struct("slot", "value")
    p = [F.col("l2"), F.col("l1"), here, F.col("r1"), F.col("r2"), F.col("r3")]
    pairs = list(zip(p, p[1:]))
    # Columns of their own: each is used several times, and written out everywhere the code would be too long to be compiled.
    near = near.withColumns({f"_h{i}": F.when(joined(a, b), (b["slot"] - a["slot"]).cast("double")) for i, (a, b) in enumerate(pairs)})
    near = near.withColumns({f"_d{i}": (b["value"] - a["value"]) / F.col(f"_h{i}") for i, (a, b) in enumerate(pairs)})
    hs, ds = ([F.col(f"_{c}{i}") for i in range(len(pairs))] for c in "hd")

    def slope(i: int) -> Column:
        """At p[i], of the secants to its left (i - 1) and right (i)."""
        both = ds[i - 1].isNotNull() & ds[i].isNotNull()
        right = _slope_end(hs[i], ds[i], hs[i + 1], ds[i + 1]) if i + 1 < len(ds) else ds[i]
        left = _slope_end(hs[i - 1], ds[i - 1], hs[i - 2], ds[i - 2]) if i >= 2 else ds[i - 1]
        return (F.when(both, _slope_inside(hs[i - 1], ds[i - 1], hs[i], ds[i]))
                .when(ds[i].isNotNull(), right).otherwise(left))

    curve = near.withColumns({"_next": F.col("r1.slot"), "_y1": F.col("r1.value"), "_fill": F.col("_h2").isNotNull(),
                              "_s0": slope(2), "_s1": slope(3)})
    # The row itself and, after it, the periods up to the next one with a reading; long gaps in two steps.
    one = F.lit(1).cast("long")
    spread = (
        curve.withColumn("_to", F.coalesce(F.col("_next") - 1, F.col("slot")))
        .withColumn("_a", F.explode(F.sequence("slot", "_to", F.lit(_SPAN).cast("long"))))
        .withColumn("_slot", F.explode(F.sequence("_a", F.least(F.col("_to"), F.col("_a") + (_SPAN - 1)), one)))
    )
    t, h = (F.col("_slot") - F.col("slot")).cast("double"), (F.col("_next") - F.col("slot")).cast("double")
    u = t / h
    cubic = ((u * u * (u * 2 - 3) + 1) * F.col("value") + u * (u * (u - 2) + 1) * h * F.col("_s0")
             + u * u * (F.lit(3) - u * 2) * F.col("_y1") + u * u * (u - 1) * h * F.col("_s1"))
    cubic = F.greatest(F.least(cubic, F.greatest("value", "_y1")), F.least("value", "_y1"))  # rounding only
    own, fill = F.col("_slot") == F.col("slot"), F.coalesce(F.col("_fill"), F.lit(False))
    return spread.select(
        "id", "interval", slot_start_of("_slot", F.col("interval")).alias("slot_start"),
        F.when(own, F.col("n_readings")).otherwise(F.lit(0).cast("long")).alias("n_readings"),
        F.when(own, F.col("value")).when(fill, cubic).alias("value"),
        F.when(own, "reading").when(fill, "filled").otherwise("gap").alias("status"),
    )
