"""Queries p2, p3, p5 and p6: data-processing operators of the core, with SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.operators.anomalies import implausible
from tidewell.operators.grid import regular_grid
from tidewell.operators.hotkeys import totals_by_key
from tidewell.operators.rolling import rolling_totals
from tidewell.sources.tables import table

CURRENT = """latest AS (
  SELECT id, time, value, flag FROM meas QUALIFY row_number() OVER (PARTITION BY id, time ORDER BY seq DESC) = 1
), cur AS (
  SELECT * FROM latest WHERE value IS NOT NULL AND NOT isnan(value) AND flag IS DISTINCT FROM 4294967295
)"""


def settled(c: str) -> Column:
    """Two decimals, moved off the ties of values with few decimals, so that engines that add up in another order agree."""
    return F.round(F.col(c) + 0.00037123456, 2)


def p2_rolling(spark: SparkSession, d: str) -> DataFrame:
    out = rolling_totals(table(spark, d, "meas"))
    return out.withColumns({c: settled(c) for c in ("total_7", "average_7", "total_30", "average_30")})


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return rolling_totals(table(spark, d, "meas"), (7, 30)).where((F.col("n_7") == 0) & (F.col("n_30") > 0)).select("id", "epoch_day")


def p3_grid(spark: SparkSession, d: str) -> DataFrame:
    return regular_grid(table(spark, d, "meas"), table(spark, d, "scheme")).withColumn("value", settled("value"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """Periods that got their value from the curve, or were marked as within a long gap."""
    grid = regular_grid(table(spark, d, "meas"), table(spark, d, "scheme"))
    return grid.where((F.col("status") == "filled") & F.col("value").isNotNull() | (F.col("status") == "gap")).select("id", "slot_start")


def p3_slots(spark: SparkSession, d: str) -> DataFrame:
    return p3_grid(spark, d).select("id", "slot_start", "n_readings", "status")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return implausible(table(spark, d, "meas"), table(spark, d, "scheme"), table(spark, d, "quantity_limits")).select("id", "time")


def p6_totals(spark: SparkSession, d: str) -> DataFrame:
    return totals_by_key(table(spark, d, "meas")).withColumn("total", settled("total"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    meas = table(spark, d, "meas")
    n = meas.count()  # of the files' footers
    return totals_by_key(meas).where(F.col("n_rows") > F.lit(0.03) * n).select("id")


P2_ROLLING_SQL = f"""WITH {CURRENT}, daily AS (
  SELECT id, time // 86400000 AS epoch_day, count(*) AS n, sum(value) AS total FROM cur GROUP BY ALL
), days AS (
  SELECT id, unnest(generate_series(min(epoch_day), max(epoch_day))) AS epoch_day FROM daily GROUP BY id
), dense AS (
  SELECT id, epoch_day, coalesce(n, 0) AS n, coalesce(total, 0) AS total FROM days LEFT JOIN daily USING (id, epoch_day)
), rolled AS (
  SELECT id, epoch_day, sum(n) OVER w7 AS n_7, sum(total) OVER w7 AS total_7, sum(n) OVER w30 AS n_30, sum(total) OVER w30 AS total_30 FROM dense
  WINDOW w7 AS (PARTITION BY id ORDER BY epoch_day ROWS 6 PRECEDING), w30 AS (PARTITION BY id ORDER BY epoch_day ROWS 29 PRECEDING)
)
SELECT id, epoch_day, n_7::BIGINT AS n_7, round(total_7 + 0.00037123456, 2) AS total_7, round(total_7 / nullif(n_7, 0) + 0.00037123456, 2) AS average_7,
  n_30::BIGINT AS n_30, round(total_30 + 0.00037123456, 2) AS total_30, round(total_30 / nullif(n_30, 0) + 0.00037123456, 2) AS average_30 FROM rolled"""

P2_FOUND_SQL = f"""WITH {CURRENT}, daily AS (SELECT DISTINCT id, time // 86400000 AS day FROM cur),
gaps AS (SELECT id, day, lead(day) OVER (PARTITION BY id ORDER BY day) AS next FROM daily)
SELECT id, unnest(generate_series(day + 7, least(day + 29, next - 1))) AS epoch_day FROM gaps WHERE next > day + 7"""

_SLOT = """CASE interval WHEN 'minute' THEN time // 60000 WHEN 'halfhour' THEN time // 1800000 WHEN 'hour' THEN time // 3600000
  WHEN 'day' THEN time // 86400000 WHEN 'week' THEN (time // 86400000 + 3) // 7
  WHEN 'month' THEN year(epoch_ms(time)) * 12 + month(epoch_ms(time)) - 1 END"""
_SLOT_START = """CASE interval WHEN 'minute' THEN slot * 60000 WHEN 'halfhour' THEN slot * 1800000 WHEN 'hour' THEN slot * 3600000
  WHEN 'day' THEN slot * 86400000 WHEN 'week' THEN (slot * 7 - 3) * 86400000
  WHEN 'month' THEN epoch_ms(make_timestamp(slot // 12, slot % 12 + 1, 1, 0, 0, 0)) END"""

P3_FOUND_SQL = f"""WITH {CURRENT}, slots AS (
  SELECT DISTINCT id, interval, {_SLOT} AS slot FROM cur JOIN scheme USING (id) WHERE interval IN ('minute', 'halfhour', 'hour', 'day', 'week', 'month')
), gaps AS (SELECT *, lead(slot) OVER (PARTITION BY id ORDER BY slot) AS next FROM slots),
missing AS (SELECT id, interval, unnest(generate_series(slot + 1, next - 1)) AS slot FROM gaps WHERE next > slot + 1)
SELECT id, ({_SLOT_START})::BIGINT AS slot_start FROM missing"""

P3_SLOTS_SQL = f"""WITH {CURRENT}, slots AS (
  SELECT id, interval, {_SLOT} AS slot, count(*) AS n FROM cur JOIN scheme USING (id) WHERE interval IN ('minute', 'halfhour', 'hour', 'day', 'week', 'month') GROUP BY ALL
), gaps AS (SELECT *, coalesce(lead(slot) OVER (PARTITION BY id ORDER BY slot), slot + 1) AS next FROM slots),
every AS (SELECT id, interval, slot AS own, n, next, unnest(generate_series(slot, next - 1)) AS slot FROM gaps)
SELECT id, ({_SLOT_START})::BIGINT AS slot_start, CASE WHEN slot = own THEN n ELSE 0 END AS n_readings,
  CASE WHEN slot = own THEN 'reading' WHEN next - own <= 25 THEN 'filled' ELSE 'gap' END AS status FROM every"""

def _inside(a: int, b: int) -> str:
    """Slope where two secants meet."""
    w0, w1 = f"(2 * h{b} + h{a})", f"(h{b} + 2 * h{a})"
    return f"CASE WHEN d{a} * d{b} > 0 THEN ({w0} + {w1}) / ({w0} / d{a} + {w1} / d{b}) ELSE 0 END"


def _at_end(a: int, b: int) -> str:
    """Slope at the end of secant a, with b beyond it."""
    s = f"(((2 * h{a} + h{b}) * d{a} - h{a} * d{b}) / (h{a} + h{b}))"
    return f"CASE WHEN d{b} IS NULL THEN d{a} WHEN {s} * d{a} <= 0 THEN 0 WHEN d{a} * d{b} <= 0 AND abs({s}) > 3 * abs(d{a}) THEN 3 * d{a} ELSE {s} END"


_POINTS = ", ".join(f"{f}(slot, {k}) OVER s AS x{i}, {f}(v, {k}) OVER s AS y{i}" for i, f, k in ((0, "lag", 2), (1, "lag", 1), (3, "lead", 1), (4, "lead", 2), (5, "lead", 3)))
P3_GRID_SQL = f"""WITH {CURRENT}, slots AS (
  SELECT id, interval, {_SLOT} AS slot, count(*) AS n, avg(value) AS v FROM cur JOIN scheme USING (id) WHERE interval IN ('minute', 'halfhour', 'hour', 'day', 'week', 'month') GROUP BY ALL
), w AS (SELECT *, slot AS x2, v AS y2, {_POINTS} FROM slots WINDOW s AS (PARTITION BY id ORDER BY slot)),
secants AS (SELECT *, {', '.join(f"CASE WHEN x{i + 1} - x{i} <= 25 AND isfinite(y{i}) AND isfinite(y{i + 1}) THEN (x{i + 1} - x{i})::DOUBLE END AS h{i}" for i in range(5))} FROM w),
sloped AS (SELECT *, {', '.join(f"(y{i + 1} - y{i}) / h{i} AS d{i}" for i in range(5))} FROM secants),
curve AS (SELECT *, CASE WHEN d1 IS NOT NULL THEN {_inside(1, 2)} ELSE {_at_end(2, 3)} END AS s0, CASE WHEN d3 IS NOT NULL THEN {_inside(2, 3)} ELSE {_at_end(2, 1)} END AS s1 FROM sloped),
every AS (SELECT *, slot AS own, unnest(generate_series(slot, coalesce(x3 - 1, slot))) AS pos FROM curve),
placed AS (SELECT *, (pos - own) / (x3 - own)::DOUBLE AS u FROM every)
SELECT id, interval, ({_SLOT_START.replace('slot', 'pos')})::BIGINT AS slot_start, CASE WHEN pos = own THEN n ELSE 0 END AS n_readings,
  round(CASE WHEN pos = own THEN v WHEN h2 IS NOT NULL THEN (2 * u * u * u - 3 * u * u + 1) * y2 + (u * u * u - 2 * u * u + u) * h2 * s0 + (3 * u * u - 2 * u * u * u) * y3 + (u * u * u - u * u) * h2 * s1 END + 0.00037123456, 2) AS value,
  CASE WHEN pos = own THEN 'reading' WHEN h2 IS NOT NULL THEN 'filled' ELSE 'gap' END AS status FROM placed"""

P5_FOUND_SQL = f"""WITH {CURRENT}, a AS (
  SELECT *, abs(value - lag(value) OVER s) AS d, row_number() OVER s AS rn FROM cur WINDOW s AS (PARTITION BY id ORDER BY time)
), step AS (SELECT id, median(d) AS step FROM a GROUP BY id),
n AS (
  SELECT a.*, step,
    [lag(value, 3) OVER s, lag(value, 2) OVER s, lag(value, 1) OVER s, lead(value, 1) OVER s, lead(value, 2) OVER s, lead(value, 3) OVER s] AS w1,
    [lag(value, 3) OVER s, lag(value, 2) OVER s, lag(value, 1) OVER s, lead(value, 2) OVER s, lead(value, 3) OVER s, lead(value, 4) OVER s] AS w2,
    [lag(value, 3) OVER s, lag(value, 2) OVER s, lag(value, 1) OVER s, lead(value, 3) OVER s, lead(value, 4) OVER s, lead(value, 5) OVER s] AS w3,
    lead(value, 1) OVER s AS v1, lead(value, 2) OVER s AS v2
  FROM a JOIN step USING (id) WINDOW s AS (PARTITION BY id ORDER BY time)
), f AS (
  SELECT id, time, rn, step,
    CASE WHEN len(list_filter(w1, lambda x: x IS NOT NULL)) = 6 AND list_max(w1) - list_min(w1) <= 10 * step AND len(list_filter(w1, lambda x: abs(value - x) > 10 * step)) = 6 THEN 1 END AS s1,
    CASE WHEN len(list_filter(w2, lambda x: x IS NOT NULL)) = 6 AND list_max(w2) - list_min(w2) <= 10 * step AND len(list_filter(w2, lambda x: abs(value - x) > 10 * step AND abs(v1 - x) > 10 * step)) = 6 THEN 2 END AS s2,
    CASE WHEN len(list_filter(w3, lambda x: x IS NOT NULL)) = 6 AND list_max(w3) - list_min(w3) <= 10 * step AND len(list_filter(w3, lambda x: abs(value - x) > 10 * step AND abs(v1 - x) > 10 * step AND abs(v2 - x) > 10 * step)) = 6 THEN 3 END AS s3
  FROM n WHERE step >= 1e-5
), spikes AS (
  SELECT id, rn FROM f WHERE s1 = 1 UNION SELECT id, unnest(generate_series(rn, rn + 1)) FROM f WHERE s2 = 2 UNION SELECT id, unnest(generate_series(rn, rn + 2)) FROM f WHERE s3 = 3
), runs AS (
  SELECT a.*, step, sum(CASE WHEN d < 1e-5 THEN 0 ELSE 1 END) OVER (PARTITION BY id ORDER BY time) AS run FROM a JOIN step USING (id)
), stuck AS (SELECT id, time FROM runs WHERE step >= 1e-5 QUALIFY count(*) OVER (PARTITION BY id, run) >= 8),
lim AS (
  SELECT id, max(min_value) AS lo, min(max_value) AS hi FROM (SELECT id, unnest(string_split(lower(name), '.')) AS quantity FROM scheme) t
  JOIN (SELECT lower(quantity) AS quantity, min_value, max_value FROM quantity_limits) q USING (quantity) GROUP BY id
), impossible AS (SELECT id, time FROM cur JOIN lim USING (id) WHERE value < lo OR value > hi)
SELECT id, time FROM spikes JOIN a USING (id, rn) UNION SELECT id, time FROM stuck UNION SELECT id, time FROM impossible"""

P6_TOTALS_SQL = """SELECT id, count(*) AS n_rows, count(v) AS n_values, round(sum(v) + 0.00037123456, 2) AS total, min(v) AS min_value, max(v) AS max_value
FROM (SELECT id, CASE WHEN NOT isnan(value) THEN value END AS v FROM meas) GROUP BY id"""

P6_FOUND_SQL = "SELECT id FROM meas GROUP BY id HAVING count(*) > 0.03 * (SELECT count(*) FROM meas)"

QUERIES = {"p2_found": p2_found, "p2_rolling": p2_rolling, "p3_found": p3_found, "p3_grid": p3_grid, "p3_slots": p3_slots, "p5_found": p5_found, "p6_found": p6_found, "p6_totals": p6_totals}
SQL = {"p2_found": P2_FOUND_SQL, "p2_rolling": P2_ROLLING_SQL, "p3_found": P3_FOUND_SQL, "p3_grid": P3_GRID_SQL, "p3_slots": P3_SLOTS_SQL, "p5_found": P5_FOUND_SQL, "p6_found": P6_FOUND_SQL, "p6_totals": P6_TOTALS_SQL}
