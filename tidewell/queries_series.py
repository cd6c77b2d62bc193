"""Queries of the series operators over the whole tables, with SQL that gives the same rows."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.functions import hashing, predicates, statistic, timeutil
from tidewell.operators import reads

from tidewell.plans import rollup as rollups
from tidewell.plans import scheme as schemes
from tidewell.plans.cut import shared_folder
from tidewell.plans.json_api import series_json
from tidewell.plans.settings import Settings
from tidewell.plans.storage import ShardedStore, Store
from tidewell.queries_data import CURRENT, settled
from tidewell.sources.tables import events_series, negated_series, order_series, supply_series, table
from tidewell.streaming import subscriptions
from tidewell.types import INTERVALS, MAX_TIME, NO_DATA

# Arguments of the queries: a stretch of time, a moment, an hour before all data.
FROM, TO, AT, EARLY = 1_294_500_000_000, 1_297_000_000_000, 1_296_000_000_000, 1_000_000_000_000
SERIES = [305, 42, 7]

LATEST = "latest AS (SELECT id, time, value, flag FROM meas QUALIFY row_number() OVER (PARTITION BY id, time ORDER BY seq DESC) = 1)"
QUERIES: dict = {}
SQL: dict = {}


def query(sql: str | None = None, name: str | None = None, raw: tuple[str, ...] = ()):
    """raw: columns with values as delivered. NaN isn't equal to itself, so both sides say by a column of its own where a value is NaN, and give null there."""
    def add(f):
        def shown(spark, d):
            out = f(spark, d)
            nan = {c.replace("value", "is_nan"): F.coalesce(F.isnan(c), F.lit(False)) for c in raw}
            return out.withColumns(nan).withColumns({c: F.nanvl(c, F.lit(None).cast("double")) for c in raw})

        QUERIES[name or f.__name__] = shown if raw else f
        if sql is not None:
            SQL[name or f.__name__] = sql if not raw else f"""SELECT * REPLACE ({', '.join(f'CASE WHEN NOT isnan({c}) THEN {c} END AS {c}' for c in raw)}),
  {', '.join(f"coalesce(isnan({c}), false) AS {c.replace('value', 'is_nan')}" for c in raw)} FROM ({sql})"""
        return f

    return add


def _meas(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "meas")


def _hourly(spark: SparkSession, d: str) -> DataFrame:
    return schemes.of_interval(table(spark, d, "scheme"), "hour").select("id")


# Scans

@query(f"WITH {LATEST} SELECT * FROM latest WHERE id IN (SELECT id FROM scheme WHERE interval = 'hour') AND time BETWEEN {FROM} AND {TO}", raw=("value",))
def interval_read(spark, d):
    return reads.read_interval(_meas(spark, d), _hourly(spark, d), FROM, TO)


@query(f"WITH {LATEST} SELECT * FROM latest WHERE id IN (SELECT id FROM scheme WHERE interval = 'hour') AND time BETWEEN {FROM} AND {TO} AND flag & 1 = 1", raw=("value",))
def interval_read_flag(spark, d):
    return reads.read_interval(_meas(spark, d), _hourly(spark, d), FROM, TO, mask=1)


@query(f"WITH {LATEST} SELECT * FROM latest WHERE id IN ({', '.join(map(str, SERIES))}) AND time BETWEEN {FROM} AND {TO}", raw=("value",))
def interval_read_ids(spark, d):
    return reads.read_interval(_meas(spark, d), SERIES, FROM, TO)


@query(f"WITH {LATEST} SELECT * FROM latest", raw=("value",))
def interval_read_dedupe_last(spark, d):
    return reads.dedupe(_meas(spark, d))


@query("SELECT id, time, value, flag FROM meas QUALIFY row_number() OVER (PARTITION BY id, time ORDER BY seq) = 1", raw=("value",))
def interval_read_dedupe_first(spark, d):
    return reads.dedupe(_meas(spark, d), keep="first")


@query("""WITH s AS (SELECT l_suppkey AS id, epoch_us(l_shipdate) // 1000 AS time, l_extendedprice AS value,
  (CASE l_returnflag WHEN 'R' THEN 1 WHEN 'A' THEN 2 WHEN 'N' THEN 4 ELSE 0 END + CASE l_linestatus WHEN 'O' THEN 8 ELSE 0 END)::BIGINT AS flag, l_orderkey, l_linenumber, l_partkey FROM lineitem)
SELECT id, time, value, flag FROM s QUALIFY row_number() OVER (PARTITION BY id, time ORDER BY l_orderkey DESC, l_linenumber DESC, l_partkey DESC, value DESC, flag DESC) = 1""")
def dedupe_supply(spark, d):
    return reads.dedupe(supply_series(table(spark, d, "lineitem")))


@query(f"WITH {LATEST} SELECT * FROM latest", raw=("value",))
def merge_layers(spark, d):
    """What arrived after and before a moment as two layers, the newer one first."""
    m = _meas(spark, d)
    late = F.col("arrived") >= F.timestamp_millis(F.lit(AT))
    return reads.merge_layers([m.where(late), m.where(~late)])


@query("""SELECT o_custkey AS id, epoch_us(o_orderdate) // 1000 AS time, o_totalprice AS value, CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 2 WHEN 'P' THEN 4 ELSE 0 END::BIGINT AS flag FROM orders
UNION ALL SELECT user_id, epoch_us(ts) // 1000, value, CASE event_type WHEN 'view' THEN 1 WHEN 'click' THEN 2 WHEN 'purchase' THEN 4 WHEN 'signup' THEN 8 WHEN 'error' THEN 16 ELSE 0 END::BIGINT FROM events""")
def concat_layers(spark, d):
    return reads.concat([order_series(table(spark, d, "orders")), events_series(table(spark, d, "events"))])


def _time_point_sql(at: int, mask: int) -> str:
    return f"""WITH {LATEST}, r AS (SELECT id, arg_max({{'t': time, 'v': value, 'f': flag}}, time) AS r FROM latest WHERE time <= {at} AND flag & {mask} = {mask} GROUP BY id)
SELECT id, coalesce(r.t, {at}) AS time, CASE WHEN r IS NULL THEN 0 ELSE r.v END AS value, coalesce(r.f, {NO_DATA}) AS flag FROM scheme LEFT JOIN r USING (id)"""


@query(_time_point_sql(AT, 0), raw=("value",))
def time_point(spark, d):
    return reads.read_time_point(_meas(spark, d), table(spark, d, "scheme"), AT)


@query(_time_point_sql(AT, 2), raw=("value",))
def time_point_flag(spark, d):
    return reads.read_time_point(_meas(spark, d), table(spark, d, "scheme"), AT, mask=2)


@query(_time_point_sql(EARLY, 0), raw=("value",))
def time_point_nodata(spark, d):
    return reads.read_time_point(_meas(spark, d), table(spark, d, "scheme"), EARLY)


@query(f"""WITH {CURRENT}, p AS (SELECT id, time AS time_point FROM meas WHERE flag = {NO_DATA})
SELECT p.id, p.time_point, coalesce(c.time, p.time_point) AS time, CASE WHEN c.time IS NULL THEN 0 ELSE c.value END AS value, coalesce(c.flag, {NO_DATA}) AS flag
FROM p ASOF LEFT JOIN cur c ON p.id = c.id AND p.time_point >= c.time""")
def time_points_asof(spark, d):
    """What was valid whenever a reading was withdrawn."""
    m = _meas(spark, d)
    return reads.read_time_points(m, m.where(F.col("flag") == NO_DATA).select("id", F.col("time").alias("time_point")), readings_only=True)


_CURRENT_VALUE_SQL = f"WITH {LATEST}, r AS (SELECT id, arg_max({{'t': time, 'v': value, 'f': flag}}, time) AS r FROM latest GROUP BY id) SELECT id, r.t AS time, r.v AS value, r.f AS flag FROM r"


@query(_CURRENT_VALUE_SQL, raw=("value",))
def current_value(spark, d):
    return reads.current_value(_meas(spark, d))


@query(f"WITH {LATEST}, r AS (SELECT id, arg_max({{'t': time, 'v': value, 'f': flag}}, time) AS r FROM latest GROUP BY id) SELECT id, r.t AS time, r.v AS value, r.f AS flag FROM r WHERE r.f & 1 = 1", raw=("value",))
def current_value_flag(spark, d):
    return reads.current_value(_meas(spark, d), mask=1)


@query("SELECT min(time) AS min_time, max(time) AS max_time FROM meas")
def min_max_time(spark, d):
    return reads.min_max_time(_meas(spark, d))


@query("SELECT id, min(time) AS min_time, max(time) AS max_time FROM meas GROUP BY id")
def id_min_max(spark, d):
    return reads.id_min_max(_meas(spark, d))


@query(f"""WITH {LATEST}, r AS (SELECT id, arg_min({{'t': time, 'v': value, 'f': flag}}, time) AS f, arg_max({{'t': time, 'v': value, 'f': flag}}, time) AS l FROM latest GROUP BY id)
SELECT id, f.t AS first_time, f.v AS first_value, f.f AS first_flag, l.t AS last_time, l.v AS last_value, l.f AS last_flag FROM r""", raw=("first_value", "last_value"))
def first_last(spark, d):
    return reads.first_last(_meas(spark, d))


def _jenkins_sql(source: str) -> str:
    """flag, h: a chain of steps, one for each byte."""
    m, out = 4294967295, f"j0 AS (SELECT DISTINCT flag, 0::BIGINT AS h FROM {source})"
    for i in range(4):
        b = f"((flag >> {8 * i}) & 255)"
        out += f""", j{i}a AS (SELECT flag, (h + {b} - CASE WHEN {b} > 127 THEN 256 ELSE 0 END) & {m} AS h FROM j{i}),
j{i}b AS (SELECT flag, (h + h * 1024) & {m} AS h FROM j{i}a), j{i + 1} AS (SELECT flag, xor(h, h >> 6) AS h FROM j{i}b)"""
    return out + f", j5 AS (SELECT flag, (h + h * 8) & {m} AS h FROM j4), j6 AS (SELECT flag, xor(h, h >> 11) AS h FROM j5), hashed AS (SELECT flag, (h + h * 32768) & {m} AS h FROM j6)"


_STAT_SQL = f"""WITH {CURRENT}, {_jenkins_sql('cur')}
SELECT id, min(time) AS min_time, max(time) AS max_time, count(*) AS count, bit_or(h)::BIGINT AS flag_bloom, min(value) AS min_value, max(value) AS max_value,
  round(sum(value) + 0.00037123456, 2) AS sum FROM cur JOIN hashed USING (flag)"""


@query(_STAT_SQL + f" WHERE time BETWEEN {FROM} AND {TO} GROUP BY id")
def range_stat(spark, d):
    return reads.range_stat(_meas(spark, d), FROM, TO).withColumn("sum", settled("sum"))


@query(_STAT_SQL + " GROUP BY id")
def range_stat_merge(spark, d):
    """States by day, merged."""
    return reads.merge_stats(reads.day_states(_meas(spark, d)), ["id"]).withColumn("sum", settled("sum"))


@query(SQL["range_stat"])
def range_stat_summary(spark, d):
    """Whole days from their states, the two that are cut from the rows."""
    m = _meas(spark, d)
    return reads.range_stat_from(reads.day_states(m), m, FROM, TO).withColumn("sum", settled("sum"))


@query(f"WITH {_jenkins_sql('meas')} SELECT flag, h AS hash FROM hashed")
def flag_hash(spark, d):
    return _meas(spark, d).select("flag").distinct().select("flag", hashing.jenkins("flag").alias("hash"))


@query(f"SELECT id, min(time) AS min_time, max(time) AS max_time FROM meas GROUP BY id HAVING min(time) <= {TO} AND max(time) >= {FROM}")
def interval_overlap(spark, d):
    """Series whose rows reach into a stretch of time."""
    return reads.id_min_max(_meas(spark, d)).where(predicates.overlaps(F.col("min_time"), F.col("max_time"), F.lit(FROM), F.lit(TO)))


@query(f"""WITH {CURRENT}, {_jenkins_sql('(SELECT flag FROM cur UNION ALL SELECT 3)')}, w AS (SELECT id, bit_or(h)::BIGINT AS flag_bloom FROM cur JOIN hashed USING (flag) GROUP BY id)
SELECT id, flag_bloom, (flag_bloom & (SELECT h FROM hashed WHERE flag = 3)) = (SELECT h FROM hashed WHERE flag = 3) AS maybe FROM w""")
def flag_bloom(spark, d):
    """Whether a series may hold a reading with flag 3, from its bloom word alone."""
    state = reads.merge_stats(reads.day_states(_meas(spark, d)), ["id"])
    return state.select("id", "flag_bloom", hashing.bloom_check(F.col("flag_bloom"), F.lit(3).cast("long")).alias("maybe"))


@query("""SELECT DISTINCT flag, (flag >> 3) & 1 AS got, flag | 8 AS with_bit, flag - (flag & 8) AS without_bit, (32 - length(ltrim(bin(flag), '0')))::INTEGER AS leading,
  (CASE WHEN flag = 0 THEN 32 ELSE length(bin(flag)) - length(rtrim(bin(flag), '0')) END)::INTEGER AS trailing FROM meas""")
def flag_bits(spark, d):
    f = F.col("flag")
    return _meas(spark, d).select("flag").distinct().select(
        "flag", hashing.get_bit(f, 3).alias("got"), hashing.set_bit(f, 3).alias("with_bit"), hashing.clear_bit(f, 3).alias("without_bit"),
        hashing.leading_zeros(f).alias("leading"), hashing.trailing_zeros(f).alias("trailing"))


# Statistics

def _stats_sql(source: str, by: str, functions: list[str]) -> str:
    """One row for each group and function, by the rules of `statistic.calculate`."""
    v = {"average": "avg(value)", "sigma": "stddev_pop(value)", "minimum": "min(value)", "maximum": "max(value)", "count": "count(*)::DOUBLE"}
    t = {"minimum": "arg_max(time, {'v': -value, 't': time})", "maximum": "arg_max(time, {'v': value, 't': time})"}
    parts = []
    for i, f in enumerate(functions):
        if f in statistic.PERCENTILES:
            at = f"l[least(floor({statistic.PERCENTILES[f]}::DOUBLE * n), n - 1)::BIGINT + 1]"
            two = "n = 2"
            parts.append(f"""SELECT {by}, {i}::INTEGER AS ord, '{f}' AS fn, CASE WHEN {two} THEN greatest(l[1].t, l[2].t) ELSE {at}.t END AS time,
  round(CASE WHEN {two} THEN (l[1].v + l[2].v) / 2 ELSE {at}.v END + 0.00037123456, 2) AS value, (CASE WHEN {two} THEN ff ELSE {at}.f END | 2147483648)::BIGINT AS flag
FROM (SELECT {by}, count(*) AS n, list_sort(list({{'v': value, 't': time, 'f': flag}})) AS l, arg_min(flag, time) AS ff FROM rows GROUP BY {by})""")
        else:
            parts.append(f"SELECT {by}, {i}::INTEGER AS ord, '{f}' AS fn, {t.get(f, 'max(time)')} AS time, round({v[f]} + 0.00037123456, 2) AS value, 2147483648 AS flag FROM rows GROUP BY {by}")
    return f"WITH {source}\n" + "\nUNION ALL ".join(parts)


_ALL = ["average", "median", "percentile90", "percentile99", "sigma", "minimum", "maximum", "count"]
_CUR_ROWS = f"{CURRENT}, rows AS (SELECT * FROM cur)"


def _add_stats() -> None:
    for f in _ALL:
        def one(spark, d, f=f):
            return statistic.calculate(reads.current_readings(_meas(spark, d)), [f]).withColumn("value", settled("value"))

        query(_stats_sql(_CUR_ROWS, "id", [f]), f"stat_{f}")(one)


_add_stats()


@query(_stats_sql(_CUR_ROWS, "id", _ALL))
def stat_all(spark, d):
    return statistic.calculate(reads.current_readings(_meas(spark, d)), _ALL).withColumn("value", settled("value"))


@query(_stats_sql("rows AS (SELECT s_nationkey::BIGINT AS id, s_suppkey AS time, -abs(s_acctbal) AS value, 0::BIGINT AS flag FROM supplier)", "id", ["maximum"])
       .replace("max(value)", "greatest(max(value), 2.2250738585072014e-308)"))
def stat_maximum_compat(spark, d):
    """Series without a positive value, with the maximum that starts at the smallest positive double."""
    return statistic.calculate(reads.dedupe(negated_series(table(spark, d, "supplier"))), ["maximum"], compat_min_value=True).withColumn("value", settled("value"))


@query(_stats_sql("rows AS (SELECT user_id AS id, epoch_us(ts) // 1000 AS time, value, CASE event_type WHEN 'view' THEN 1 WHEN 'click' THEN 2 WHEN 'purchase' THEN 4 WHEN 'signup' THEN 8 WHEN 'error' THEN 16 ELSE 0 END::BIGINT AS flag FROM events)",
                  "id", _ALL))
def stat_events(spark, d):
    return statistic.calculate(reads.dedupe(events_series(table(spark, d, "events"))), _ALL).withColumn("value", settled("value"))


# Periods and time functions

_STARTS = {
    "minute": "time - time % 60000", "halfhour": "time - time % 1800000", "hour": "time - time % 3600000", "day": "time - time % 86400000",
    "week": "epoch_ms(date_trunc('week', epoch_ms(time))::TIMESTAMP)", "month": "epoch_ms(date_trunc('month', epoch_ms(time))::TIMESTAMP)",
    "year": "epoch_ms(date_trunc('year', epoch_ms(time))::TIMESTAMP)",
}
_ENDS = {
    "minute": "time - time % 60000 + 59999", "halfhour": "time - time % 1800000 + 1799999", "hour": "time - time % 3600000 + 3599999",
    "day": "time - time % 86400000 + 86399999", "week": "epoch_ms(date_trunc('week', epoch_ms(time))::TIMESTAMP) + 604799999",
    "month": "epoch_ms(date_trunc('month', epoch_ms(time))::TIMESTAMP + INTERVAL 1 MONTH) - 1", "year": "epoch_ms(date_trunc('year', epoch_ms(time))::TIMESTAMP + INTERVAL 1 YEAR) - 1",
}


def _add_buckets() -> None:
    for i in INTERVALS:
        def one(spark, d, i=i):
            return _meas(spark, d).select("seq", "time", timeutil.bucket_start("time", i).alias("start"), timeutil.bucket_end("time", i).alias("end"))

        query(f'SELECT seq, time, ({_STARTS[i]})::BIGINT AS start, ({_ENDS[i]})::BIGINT AS "end" FROM meas', f"bucket_{i}")(one)


_add_buckets()


def _rollup_sql(interval: str) -> str:
    return _stats_sql(f"{CURRENT}, rows AS (SELECT *, ({_STARTS[interval]})::BIGINT AS bucket FROM cur)", "id, bucket", _ALL)


@query(_rollup_sql("day"))
def rollup_day(spark, d):
    return rollups.rollup(reads.current_readings(_meas(spark, d)), "day", _ALL).withColumn("value", settled("value"))


@query(_rollup_sql("month"))
def rollup_month(spark, d):
    return rollups.rollup(reads.current_readings(_meas(spark, d)), "month", _ALL).withColumn("value", settled("value"))


@query("""SELECT seq, time, year(t)::INTEGER AS year, month(t)::INTEGER AS month, day(t)::INTEGER AS day, dayofyear(t)::INTEGER AS day_of_year, hour(t)::INTEGER AS hour, minute(t)::INTEGER AS minute,
  second(t)::INTEGER AS second, (time % 1000)::INTEGER AS millisecond, time AS back FROM (SELECT seq, time, epoch_ms(time) AS t FROM meas)""")
def time_convert(spark, d):
    dt = timeutil.to_datetime("time")
    return _meas(spark, d).select("seq", "time", dt.alias("d")).select("seq", "time", "d.*", timeutil.from_datetime(F.col("d")).alias("back"))


@query("SELECT seq, time, time - time % 1000 AS second, time - time % 60000 AS minute, time - time % 3600000 AS hour FROM meas")
def time_round(spark, d):
    return _meas(spark, d).select("seq", "time", *[timeutil.round_to("time", k).alias(n) for n, k in (("second", 1000), ("minute", 60_000), ("hour", 3_600_000))])


@query("SELECT seq, strftime(epoch_ms(time), '%Y-%m-%d %H:%M:%S') || '.' || lpad((time % 1000)::VARCHAR, 4, '0') AS text, time - time % 1000 AS parsed, time - time % 1000 AS iso FROM meas")
def time_format(spark, d):
    m = _meas(spark, d).withColumn("text", timeutil.to_string("time"))
    whole = F.substring("text", 1, 19)
    return m.select("seq", "text", timeutil.from_string(whole).alias("parsed"), timeutil.from_iso_string(F.regexp_replace(F.regexp_replace(whole, "[-:]", ""), " ", "T")).alias("iso"))


@query("SELECT hour(epoch_ms(time))::INTEGER AS hour, count(*) AS n FROM (SELECT DISTINCT id, time FROM meas) GROUP BY 1")
def hour_histogram(spark, d):
    return reads.hour_histogram(_meas(spark, d))


# Scheme and shards

_PARSE = """parsed AS (SELECT id, name, CASE WHEN len(t) >= 2 AND t[-1] IN ('raw', 'minute', 'halfhour', 'hour', 'day', 'week', 'month', 'year') THEN t[-1] END AS interval,
  CASE WHEN len(t) >= 3 AND t[-2] IN ('average', 'median', 'percentile90', 'percentile99', 'sigma', 'minimum', 'maximum', 'count') THEN t[-2] END AS aggregation_func
  FROM (SELECT id, name, list_filter(string_split(name, '.'), lambda x: x <> '') AS t FROM {source}))"""
_PREFIX = r"CASE WHEN interval IS NOT NULL THEN regexp_extract(name, '^((?:.*\.)?)[^.]+\.*$', 1) END AS prefix"


@query(f"WITH {_PARSE.format(source='scheme')} SELECT *, {_PREFIX} FROM parsed")
def scheme_parse(spark, d):
    return schemes.describe(table(spark, d, "scheme"))


@query("SELECT name, id FROM scheme UNION ALL SELECT 'nation.' || n_name || '.raw', 4294967295 FROM nation")
def scheme_lookup(spark, d):
    names = table(spark, d, "scheme").select("name").unionByName(table(spark, d, "nation").select(F.concat(F.lit("nation."), "n_name", F.lit(".raw")).alias("name")))
    return schemes.ids_for(names, table(spark, d, "scheme"))


@query("SELECT coalesce(s.id, 4294967295) AS id, name, interval, aggregation_func FROM (SELECT DISTINCT id FROM meas) m LEFT JOIN scheme s USING (id)")
def scheme_describe(spark, d):
    return schemes.descriptions_for(_meas(spark, d).select("id").distinct(), table(spark, d, "scheme"))


@query("SELECT id, name, interval, aggregation_func FROM scheme WHERE interval = 'hour'")
def scheme_interval(spark, d):
    return schemes.of_interval(table(spark, d, "scheme"), "hour")


@query("SELECT id, interval, CASE interval " + " ".join(f"WHEN '{i}' THEN {n}" for i, n in INTERVALS.items()) + " ELSE 0 END::BIGINT AS length FROM scheme")
def interval_lengths(spark, d):
    return table(spark, d, "scheme").select("id", "interval", timeutil.interval_length(F.col("interval")).alias("length"))


_CHAIN = (("raw", 0), ("average.hour", 1), ("average.maximum.day", 2), ("average.maximum.median.month", 3))
_CHAIN_SQL = "names AS (SELECT user_id * 10 + k AS id, 'u' || user_id || '.' || n AS name FROM (SELECT DISTINCT user_id FROM events) e, (VALUES " + ", ".join(f"('{n}', {k})" for n, k in _CHAIN) + ") v(n, k))"


def _chain_scheme(spark: SparkSession, d: str) -> DataFrame:
    """For each user of events: raw data, hourly averages, daily maxima of these, monthly medians of these."""
    users = table(spark, d, "events").select("user_id").distinct()
    names = users.select(F.explode(F.array(*[F.struct((F.col("user_id") * 10 + k).alias("id"), F.concat(F.lit("u"), F.col("user_id").cast("string"), F.lit(f".{n}")).alias("name")) for n, k in _CHAIN])).alias("x")).select("x.*")
    return schemes.describe(names).drop("prefix")


@query(f"""WITH {_CHAIN_SQL}, {_PARSE.format(source='names')}, p AS (SELECT *, {_PREFIX}, list_position(['raw', 'minute', 'halfhour', 'hour', 'day', 'week', 'month', 'year'], interval) AS rank FROM parsed WHERE interval IS NOT NULL),
chain AS (SELECT rank, lead(rank) OVER (ORDER BY rank) AS next FROM (SELECT DISTINCT rank FROM p))
SELECT a.id AS src_id, a.interval AS src_interval, b.id AS dst_id, b.interval AS dst_interval, b.aggregation_func AS dst_func
FROM p a JOIN chain c ON a.rank = c.rank JOIN p b ON b.rank = c.next AND starts_with(b.prefix, a.prefix)""")
def scheme_linked(spark, d):
    return schemes.linked(_chain_scheme(spark, d))


@query("""WITH listed AS (SELECT id, min(alias) AS alias FROM shards WHERE id IS NOT NULL GROUP BY id)
SELECT m.id, coalesce(l.alias, s.interval, 'default') AS alias FROM (SELECT DISTINCT id FROM meas) m LEFT JOIN listed l ON l.id = m.id LEFT JOIN scheme s ON s.id = m.id""")
def shard_route(spark, d):
    return schemes.route(_meas(spark, d).select("id").distinct(), table(spark, d, "scheme"), table(spark, d, "shards"))


@query("""WITH latest AS (SELECT id, time, value, flag FROM meas QUALIFY row_number() OVER (PARTITION BY id, time ORDER BY seq DESC) = 1), listed AS (SELECT id, min(alias) AS alias FROM shards WHERE id IS NOT NULL GROUP BY id)
SELECT coalesce(l.alias, s.interval, 'default') AS alias, count(*) AS n FROM latest m LEFT JOIN listed l ON l.id = m.id LEFT JOIN scheme s ON s.id = m.id GROUP BY 1""")
def shard_counts(spark, d):
    rows = reads.dedupe(_meas(spark, d)).groupBy("id").agg(F.count(F.lit(1)).alias("n"))  # before the routing is joined
    return schemes.route(rows, table(spark, d, "scheme"), table(spark, d, "shards")).join(rows, "id").groupBy("alias").agg(F.sum("n").alias("n"))


# Roll-ups along links, retention, rewriting

_HOURLY = "h AS (SELECT id * 10 + 1 AS id, max(time) AS time, avg(value) AS value FROM raw GROUP BY id, time // 3600000)"
_DAILY = "dd AS (SELECT id + 1 AS id, arg_max(time, {'v': value, 't': time}) AS time, max(value) AS value FROM h GROUP BY id, time // 86400000)"
_MONTHLY = """m AS (SELECT id + 1 AS id, CASE WHEN n = 2 THEN greatest(l[1].t, l[2].t) ELSE l[n // 2 + 1].t END AS time, CASE WHEN n = 2 THEN (l[1].v + l[2].v) / 2 ELSE l[n // 2 + 1].v END AS value
  FROM (SELECT id, count(*) AS n, list_sort(list({'v': value, 't': time})) AS l FROM dd GROUP BY id, date_trunc('month', epoch_ms(time))))"""


@query(f"""WITH raw AS (SELECT user_id AS id, epoch_us(ts) // 1000 AS time, value FROM events), {_HOURLY}, {_DAILY}, {_MONTHLY}
SELECT id, time, round(value + 0.00037123456, 2) AS value, 0::BIGINT AS flag FROM (SELECT * FROM h UNION ALL SELECT * FROM dd UNION ALL SELECT * FROM m)""")
def rollup_cascade(spark, d):
    rows = events_series(table(spark, d, "events")).withColumn("id", F.col("id") * 10)
    return rollups.cascade(rows, _chain_scheme(spark, d)).withColumn("value", settled("value"))


@query(f"""WITH raw AS (SELECT user_id AS id, epoch_us(ts) // 1000 AS time, value FROM events), {_HOURLY} SELECT id, time, round(value + 0.00037123456, 2) AS value, 0::BIGINT AS flag FROM h""")
def rollup_links(spark, d):
    rows = events_series(table(spark, d, "events")).withColumn("id", F.col("id") * 10)
    return rollups.rollup_links(reads.dedupe(rows), schemes.linked(_chain_scheme(spark, d)).where("src_interval = 'raw'")).withColumn("value", settled("value"))


@query(f"""WITH raw AS (SELECT user_id AS id, epoch_us(ts) // 1000 AS time, value FROM events), {_HOURLY}, mid AS (SELECT (min(time) + max(time)) // 2 AS middle FROM raw),
done AS (SELECT id - 1 AS id, max(time) AS until FROM h WHERE time < (SELECT middle FROM mid) GROUP BY id),
due AS (SELECT r.id * 10 AS id, r.time, r.value FROM raw r LEFT JOIN done d ON d.id = r.id * 10 WHERE r.time >= coalesce(d.until - d.until % 3600000, 0))
SELECT id + 1 AS id, max(time) AS time, round(avg(value) + 0.00037123456, 2) AS value, 0::BIGINT AS flag FROM due GROUP BY id, time // 3600000""")
def backfill(spark, d):
    """Hourly averages are there up to the middle of the time; the rest is caught up with, from the last hour that is there on."""
    raw = events_series(table(spark, d, "events")).withColumn("id", F.col("id") * 10)
    links = schemes.linked(_chain_scheme(spark, d)).where("src_interval = 'raw'")
    mid = F.call_function("div", F.min("time") + F.max("time"), F.lit(2).cast("long"))
    at = raw.agg(mid.alias("at")).first()["at"]
    done = rollups.rollup_links(reads.dedupe(raw), links).where(F.col("time") < at).withColumn("seq", F.lit(0).cast("long"))
    rows = reads.dedupe(raw).withColumn("seq", F.lit(0).cast("long"))
    return rollups.backfill(rows.unionByName(done), links).withColumn("value", settled("value"))


@query(f"""WITH {LATEST}, r AS (SELECT id, max(time) AS time FROM latest GROUP BY id)
SELECT coalesce(min(time), {MAX_TIME}) AS time FROM r WHERE id IN (SELECT id FROM scheme WHERE interval = 'hour')""")
def least_current_time(spark, d):
    return rollups.least_current_time(_meas(spark, d), table(spark, d, "scheme"), "hour")


_LIFE = "CASE interval " + " ".join(f"WHEN '{i}' THEN {Settings().lifetime_for(i)}" for i in ("raw", "minute", "halfhour", "hour", "day", "week", "month")) + " END"


@query(f"SELECT m.id, time, value, flag FROM meas m LEFT JOIN scheme s USING (id) WHERE interval IS NULL OR interval = 'year' OR time > {AT} - {_LIFE}", raw=("value",))
def retention(spark, d):
    return rollups.retention(_meas(spark, d), table(spark, d, "scheme"), AT).select("id", "time", "value", "flag")


@query(f"SELECT id, time, value, flag FROM meas WHERE NOT (id IN ({', '.join(map(str, SERIES))}) AND time <= {AT})", raw=("value",))
def erase_old(spark, d):
    return rollups.erase_old(_meas(spark, d), SERIES, AT).select("id", "time", "value", "flag")


@query(f"WITH {LATEST} SELECT * FROM latest WHERE value > 0 AND NOT isnan(value)")
def compact_filter(spark, d):
    return reads.dedupe(_meas(spark, d)).where((F.col("value") > 0) & ~F.isnan("value"))


@query(f"WITH {LATEST} SELECT id, time, value, (flag | 512)::BIGINT AS flag FROM latest", raw=("value",))
def compact_mutate(spark, d):
    return reads.dedupe(_meas(spark, d)).withColumn("flag", predicates.add_flag(512))


@query(f"WITH {LATEST} SELECT id, time, value, flag FROM latest", raw=("value",))
def repack(spark, d):
    """The clustered layout a store writes."""
    return reads.dedupe(_meas(spark, d)).repartitionByRange("id", "time").sortWithinPartitions("id", "time")


@query(f"WITH {LATEST} SELECT 4294967295 - id AS id, time, value, flag FROM latest", raw=("value",))
def copy_series(spark, d):
    return reads.copy_series(reads.dedupe(_meas(spark, d)), F.lit(4294967295).cast("long") - F.col("id"))


# The store

def _sharded(spark: SparkSession, d: str) -> ShardedStore:
    """A sharded store of its own with the rows of meas: the listed shards, the others made by the routing."""
    s = ShardedStore(spark, f"{shared_folder(spark)}/shards-{uuid.uuid4().hex}")
    s.add("rest")
    for r in table(spark, d, "shards").where("id IS NOT NULL").groupBy("alias").agg(F.collect_set("id").alias("ids")).collect():
        s.add(r["alias"], ids=r["ids"])
    s.append_frame(reads.dedupe(_meas(spark, d)))
    return s


_STORED = f"{LATEST}, stored AS (SELECT * FROM latest WHERE value IS NOT NULL)"


@query(f"WITH {_STORED} SELECT * FROM stored WHERE NOT (id = 42 AND time <= {AT})", raw=("value",))
def store_erase(spark, d):
    s = _sharded(spark, d)
    s.erase_old(42, AT)
    return s.rows().select("id", "time", "value", "flag")


@query(f"WITH {_STORED} SELECT id, time, value, CASE WHEN id = 42 AND time BETWEEN {FROM} AND {TO} THEN flag | 512 ELSE flag END::BIGINT AS flag FROM stored WHERE id <> 42 OR time NOT BETWEEN {FROM} AND {TO} OR value > 0 AND NOT isnan(value)", raw=("value",))
def store_compact(spark, d):
    s = _sharded(spark, d)
    s.compact(42, FROM, TO, keep=(F.col("value") > 0) & ~F.isnan("value"), change={"flag": predicates.add_flag(512)})
    return s.rows().select("id", "time", "value", "flag")


@query(SQL["range_stat"].replace(" GROUP BY id", f" AND id IN ({', '.join(map(str, SERIES))}) GROUP BY id"))
def store_stat(spark, d):
    s = _sharded(spark, d)
    out = s.stat(SERIES[0], FROM, TO)
    for i in SERIES[1:]:
        out = out.unionByName(s.stat(i, FROM, TO))
    return out.withColumn("sum", settled("sum"))


@query(f"""WITH part AS (SELECT id, time, value, flag, epoch_ms(arrived) >= {AT} AS late FROM meas QUALIFY row_number() OVER (PARTITION BY id, time, epoch_ms(arrived) >= {AT} ORDER BY seq DESC) = 1)
SELECT id, time, value, flag FROM part WHERE value IS NOT NULL QUALIFY row_number() OVER (PARTITION BY id, time ORDER BY late DESC) = 1""", raw=("value",))
def store_repack(spark, d):
    """Two layers, one series repacked alone, then all."""
    s, m = Store(spark, f"{shared_folder(spark)}/store-{uuid.uuid4().hex}"), _meas(spark, d)
    late = F.col("arrived") >= F.timestamp_millis(F.lit(AT))
    s.append_frame(reads.dedupe(m.where(~late)))
    s.append_frame(reads.dedupe(m.where(late)))
    s.repack(42)
    s.repack()
    return s.rows().select("id", "time", "value", "flag")


@query(f"""WITH {LATEST} SELECT name, time, value, flag FROM latest JOIN scheme USING (id) WHERE interval = 'hour' AND time BETWEEN {FROM} AND {TO}""", raw=("value",))
def series_json_rows(spark, d):
    """The rows that the JSON of `series_json_all` holds, read from it again."""
    rows = F.from_json("json", "array<struct<F: bigint, T: bigint, V: double>>")
    return series_json_all(spark, d).select("name", F.explode(rows).alias("r")).select("name", F.col("r.T").alias("time"), F.col("r.V").alias("value"), F.col("r.F").alias("flag"))


@query()
def series_json_all(spark, d):
    """Series of hourly values as JSON."""
    rows = reads.read_interval(_meas(spark, d), _hourly(spark, d), FROM, TO, ordered=False)
    return series_json(rows, table(spark, d, "scheme").select("id", "name"))


# Subscriptions and streams

@query("SELECT id, time, value, flag FROM meas WHERE flag = 1", raw=("value",))
def subscribe_filter(spark, d):
    return subscriptions.subscribe(_meas(spark, d), (), 1).select("id", "time", "value", "flag")


def _stream(spark: SparkSession, d: str) -> DataFrame:
    return subscriptions.read_rows(spark, f"{d}/meas.parquet*")


def _run(stream: DataFrame, name: str, mode: str) -> DataFrame:
    at = f"{shared_folder(stream.sparkSession)}/{name}-{uuid.uuid4().hex}"
    return subscriptions.run_to_table(stream, f"{at}/out", f"{at}/state", mode)


@query("SELECT id, time, value, flag FROM meas WHERE flag = 1", raw=("value",))
def stream_subscribe(spark, d):
    return _run(subscriptions.subscribe(_stream(spark, d), (), 1).select("id", "time", "value", "flag"), "subscribe", "append")


@query("""SELECT id, time - time % 86400000 AS bucket, count(*) AS n, round(sum(value) + 0.00037123456, 2) AS total, min(value) AS low, max(value) AS high
FROM meas WHERE value IS NOT NULL AND NOT isnan(value) AND flag <> 4294967295 GROUP BY ALL""")
def stream_rollup(spark, d):
    return _run(subscriptions.windowed_rollup(_stream(spark, d), "day"), "rollup", "complete").withColumn("total", settled("total"))


@query(_CURRENT_VALUE_SQL, raw=("value",))
def stream_latest(spark, d):
    return _run(subscriptions.latest_values(_stream(spark, d)), "latest", "complete")


