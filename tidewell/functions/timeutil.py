"""Calendar arithmetic on epoch milliseconds (UTC), as integer Column expressions.

Everything works on longs, so no result depends on the session time zone and
no long is out of range of a calendar type.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidewell.types import DAY, INTERVALS, MAX_TIME

ColumnOrName = Column | str


def _c(c: ColumnOrName) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _long(n: int) -> Column:
    return F.lit(n).cast("long")


def floor_div(a: Column, n: int) -> Column:
    """floor(a / n) on longs (`div` alone truncates towards zero)."""
    return F.call_function("div", a, _long(n)) - F.when(a % _long(n) < 0, _long(1)).otherwise(_long(0))


def epoch_day(time: ColumnOrName) -> Column:
    return floor_div(_c(time), DAY)


def _divs(a: Column, n: int) -> Column:
    return F.call_function("div", a, _long(n))


def _as_date(day: Column) -> Column:
    """Days beyond what a date can hold (some five million years) count as the last one it holds."""
    held = F.least(F.greatest(day, _long(-(2**31) + 1000)), _long(2**31 - 1000))
    return F.date_from_unix_date(F.when(day.isNotNull(), held).cast("int"))


def month_of_day(day: Column) -> Column:
    """Months since 1970-01 of an epoch day (proleptic Gregorian calendar)."""
    d = _as_date(day)
    return (F.year(d) * 12 + F.month(d)).cast("long") - (1970 * 12 + 1)


def day_of_month_index(month: Column) -> Column:
    """Epoch day of the first day of a month given in months since 1970-01."""
    return F.unix_date(F.add_months(F.lit("1970-01-01").cast("date"), month.cast("int"))).cast("long")


def slot_index(time: ColumnOrName, interval: str) -> Column:
    """Running number of the calendar period that holds `time`; successive periods differ by 1."""
    t = _c(time)
    if interval in ("minute", "halfhour", "hour", "day"):
        return floor_div(t, INTERVALS[interval])
    if interval == "week":
        return floor_div(epoch_day(t) + 3, 7)  # 1970-01-01 was a Thursday
    if interval == "month":
        return month_of_day(epoch_day(t))
    if interval == "year":
        return floor_div(month_of_day(epoch_day(t)), 12)
    raise ValueError(f"unknown interval {interval!r}")


def slot_start(slot: ColumnOrName, interval: str) -> Column:
    """First millisecond of the period with running number `slot`; null if that isn't a long."""
    s = _c(slot)
    if interval in ("minute", "halfhour", "hour", "day"):
        return F.try_multiply(s, _long(INTERVALS[interval]))
    if interval == "week":
        return F.try_multiply(s * 7 - 3, _long(DAY))
    if interval == "month":
        return day_of_month_index(s) * DAY
    if interval == "year":
        return day_of_month_index(s * 12) * DAY
    raise ValueError(f"unknown interval {interval!r}")


def _by_interval(interval: Column, make, names=tuple(INTERVALS)) -> Column:
    out = None
    for n in names:
        out = F.when(interval == n, make(n)) if out is None else out.when(interval == n, make(n))
    return out


def slot_index_of(time: ColumnOrName, interval: Column) -> Column:
    """`slot_index` for a column of interval names; null for other names."""
    return _by_interval(interval, lambda n: slot_index(time, n))


def slot_start_of(slot: ColumnOrName, interval: Column) -> Column:
    return _by_interval(interval, lambda n: slot_start(slot, n))


def bucket_start(time: ColumnOrName, interval: str) -> Column:
    return slot_start(slot_index(time, interval), interval)


def bucket_end(time: ColumnOrName, interval: str) -> Column:
    """Last millisecond of the period (inclusive); null if that isn't a long."""
    return F.try_subtract(slot_start(slot_index(time, interval) + 1, interval), _long(1))


def target_interval(time: ColumnOrName, interval: str) -> Column:
    """struct(start, end); an unknown period gives the largest time twice."""
    if interval not in INTERVALS:
        return F.struct(_long(MAX_TIME).alias("start"), _long(MAX_TIME).alias("end"))
    return F.struct(bucket_start(time, interval).alias("start"), bucket_end(time, interval).alias("end"))


def bucket_start_of(time: ColumnOrName, interval: Column) -> Column:
    return _by_interval(interval, lambda n: bucket_start(time, n))


def interval_length(name: Column) -> Column:
    """Nominal length in ms of an interval name; 0 if unknown."""
    return F.coalesce(_by_interval(name, lambda n: _long(INTERVALS[n])), _long(0))


def interval_rank(name: Column) -> Column:
    """Order of interval names: raw 0, minute 1, ..., year 7; null otherwise."""
    out = F.when(name == "raw", 0)
    for i, n in enumerate(INTERVALS, 1):
        out = out.when(name == n, i)
    return out


def current_time() -> Column:
    return F.unix_millis(F.current_timestamp())


def ms_of_ntz(ts: ColumnOrName) -> Column:
    """Epoch ms of a TIMESTAMP_NTZ column, floored, free of the session time zone."""
    return F.expr(f"timestampdiff(MILLISECOND, timestamp_ntz'1970-01-01 00:00:00', {ts})") if isinstance(ts, str) \
        else F.call_function("timestampdiff", ts)


def _date(t: Column) -> Column:
    return _as_date(epoch_day(t))


def to_datetime(time: ColumnOrName) -> Column:
    """struct(year, month, day, day_of_year, hour, minute, second, millisecond) in UTC."""
    t = _c(time)
    in_day, d = F.pmod(t, _long(DAY)), _date(t)
    return F.struct(
        F.year(d).alias("year"), F.month(d).alias("month"), F.dayofmonth(d).alias("day"), F.dayofyear(d).alias("day_of_year"),
        _divs(in_day, 3_600_000).cast("int").alias("hour"), F.pmod(_divs(in_day, 60_000), _long(60)).cast("int").alias("minute"),
        F.pmod(_divs(in_day, 1000), _long(60)).cast("int").alias("second"), F.pmod(in_day, _long(1000)).cast("int").alias("millisecond"),
    )


def from_datetime(dt: Column) -> Column:
    """Inverse of `to_datetime` (day_of_year is not read)."""
    months = (dt["year"].cast("long") - 1970) * 12 + dt["month"] - 1
    days = day_of_month_index(months) + dt["day"] - 1
    return ((days * 24 + dt["hour"]) * 60 + dt["minute"]) * 60_000 + dt["second"] * _long(1000) + dt["millisecond"]


def to_string(time: ColumnOrName) -> Column:
    """`YYYY-MM-DD hh:mm:ss.mmmm`: the milliseconds have four digits."""
    t = _c(time)
    d = to_datetime(t)
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    return F.concat(
        F.date_format(_date(t), "yyyy-MM-dd"), F.lit(" "), two(d["hour"]), F.lit(":"), two(d["minute"]), F.lit(":"),
        two(d["second"]), F.lit("."), F.lpad(d["millisecond"].cast("string"), 4, "0"),
    )


def from_string(s: ColumnOrName) -> Column:
    """Epoch ms of `2002-01-20 23:59:59[.000]`; null if it can't be read."""
    micros = F.unix_micros(F.try_to_timestamp(F.concat(_c(s), F.lit("+00:00"))))
    return floor_div(micros, 1000)


def from_iso_string(s: ColumnOrName) -> Column:
    """Epoch ms of `20020131T235959`; null if it can't be read."""
    return floor_div(F.unix_micros(F.try_to_timestamp(F.concat(_c(s), F.lit("+0000")), F.lit("yyyyMMdd'T'HHmmssZ"))), 1000)


def from_days(n: int) -> int:
    return n * DAY


def from_hours(n: int) -> int:
    return n * 3_600_000


def from_minutes(n: int) -> int:
    return n * 60_000


def from_seconds(n: int) -> int:
    return n * 1000


def round_to(time: ColumnOrName, ms: int) -> Column:
    """Floor to a multiple of `ms`: 1000, 60 000 or 3 600 000 for seconds, minutes and hours; null if that isn't a long."""
    return F.try_multiply(floor_div(_c(time), ms), _long(ms))
