"""Row schemas, constants and limits of the measurement model."""

from __future__ import annotations

from pyspark.sql import types as T

MEAS_SCHEMA = T.StructType([
    T.StructField("id", T.LongType()),
    T.StructField("time", T.LongType()),
    T.StructField("value", T.DoubleType()),
    T.StructField("flag", T.LongType()),
])

#: As delivered: `seq` orders rows of the same (id, time); the larger was written later.
DELIVERED_SCHEMA = T.StructType([*MEAS_SCHEMA.fields, T.StructField("seq", T.LongType())])

SCHEME_SCHEMA = T.StructType([
    T.StructField("id", T.LongType()),
    T.StructField("name", T.StringType()),
    T.StructField("interval", T.StringType()),
    T.StructField("aggregation_func", T.StringType()),
])

# Fixed values of the data model.
NO_DATA = 4294967295
STATS = 2147483648
MAX_ID = 4294967295
MIN_TIME = 0
MAX_TIME = 9223372036854775807
MIN_VALUE = 2.2250738585072014e-308
MAX_VALUE = 1.7976931348623157e308
EPS = 1e-5

MINUTE = 60_000
HALFHOUR = 30 * MINUTE
HOUR = 60 * MINUTE
DAY = 24 * HOUR

#: Calendar periods, finest first, with nominal lengths in ms.
INTERVALS = {
    "minute": MINUTE, "halfhour": HALFHOUR, "hour": HOUR, "day": DAY,
    "week": 7 * DAY, "month": 31 * DAY, "year": 365 * DAY,
}


def clamp_time(t: int) -> int:
    """Unsigned 64-bit bounds at the API edge become the largest signed value."""
    return min(max(int(t), MIN_TIME), MAX_TIME)
