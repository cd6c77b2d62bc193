import json
import threading

import pytest
from pyspark.sql import functions as F

from tidewell.plans import rollup as ro
from tidewell.plans import scheme as sc
from tidewell.plans.folder import Folder
from tidewell.plans.json_api import JsonApi
from tidewell.plans.settings import Settings
from tidewell.plans.storage import LockedError, ShardedStore, Store, memory_only_storage, open_storage
from tidewell.streaming import subscriptions as sub
from tidewell.types import DAY, MAX_ID, MAX_TIME, NO_DATA, STATS


def rows(df, *cols):
    return [tuple(r[c] for c in cols or df.columns) for r in df.collect()]


@pytest.fixture(params=["disk", "memory"])
def store(request, spark, tmp_path):
    s = Store(spark, str(tmp_path / "s")) if request.param == "disk" else memory_only_storage(spark)
    yield s
    s.stop()


# Scheme

def test_catalogue(spark, tmp_path):
    c = sc.SchemeCatalog(spark, Folder(str(tmp_path), spark))
    names = ["lvl1.lvl2.lvl3_1.param1", "lvl1.lvl2.lvl3_1.param2", "memory.raw"]
    ids = c.add_all(names)
    assert len(set(ids.values())) == 3 and c.add("memory.raw") == ids["memory.raw"] and c.id_of("nothing") == MAX_ID
    c.save()
    d = sc.SchemeCatalog(spark, Folder(str(tmp_path), spark))
    assert d.names() == ids and d.add("more") > max(ids.values())
    assert rows(d.description_for(12345), "id", "name") == [(MAX_ID, None)]


def test_names(spark):
    names = ["memory.raw", "cpu.raw", "memory.median.hour", "memory.sigma.hour", "cpu.sigma.hour", "memory.median.day", "hour", "a..b.Median.hour.", "x.draw.raw", "a.hour.b", ".raw", "a.median.raw"]
    c = sc.SchemeCatalog(spark)
    ids = c.add_all(names)
    got = {r["name"]: r for r in c.ls().collect()}
    assert (got["memory.median.hour"]["interval"], got["memory.median.hour"]["aggregation_func"]) == ("hour", "median")
    assert (got["memory.raw"]["interval"], got["memory.raw"]["aggregation_func"]) == ("raw", None)
    assert got["hour"]["interval"] is None and got[".raw"]["interval"] is None and got["a.hour.b"]["interval"] is None
    assert (got["a..b.Median.hour."]["interval"], got["a..b.Median.hour."]["aggregation_func"]) == ("hour", None)
    prefix = dict(rows(sc.describe(spark.createDataFrame([(i, n) for n, i in ids.items()], "id long, name string")), "name", "prefix"))
    assert prefix["memory.median.hour"] == "memory.median." and prefix["x.draw.raw"] == "x.draw." and prefix["hour"] is None
    linked = {n: sorted(r["dst_id"] for r in c.linked_for(ids[n]).collect()) for n in ("memory.raw", "cpu.raw", "memory.median.day")}
    assert linked == {"memory.raw": sorted([ids["memory.median.hour"], ids["memory.sigma.hour"]]), "cpu.raw": [ids["cpu.sigma.hour"]], "memory.median.day": []}
    assert c.ls_interval("hour").count() == 4


def test_links_take_whole_tokens(spark):
    c = sc.SchemeCatalog(spark)
    ids = c.add_all(["param1.raw", "param3.raw", "param3.average.minute", "param33.average.minute"])
    assert [r["dst_id"] for r in c.linked_for(ids["param3.raw"]).collect()] == [ids["param3.average.minute"]]


def test_routes(spark):
    scheme = spark.createDataFrame([(1, "raw"), (2, None), (3, "hour")], "id long, interval string")
    shards = spark.createDataFrame([("a", 1), ("b", 1), ("default", None)], "alias string, id long")
    got = dict(rows(sc.route(spark.range(1, 5).select("id"), scheme, shards)))
    assert got == {1: "a", 2: "default", 3: "hour", 4: "default"}


# Roll-ups

def test_cascade_of_the_example(spark, meas):
    chain = ["param1.raw", "param1.average.minute", "param1.average.average.halfhour", "param1.average.average.average.hour", "param1.average.average.average.average.day",
             "param1.average.average.average.average.average.week", "param1.average.average.average.average.average.average.month"]
    c = sc.SchemeCatalog(spark)
    ids = c.add_all(chain)
    t = 1483228800000  # 2017-01-01
    got = {r["id"]: (r["time"], r["value"], r["flag"]) for r in ro.cascade(meas([(ids["param1.raw"], t, 2.0, 3), (ids["param1.raw"], t + 59_000, 4.0, 3)]), c.ls()).collect()}
    assert got == {ids[n]: (t + 59_000, 3.0, 0) for n in chain[1:]}


def test_cascade_skips_missing_levels_and_unknown_functions(spark, meas):
    c = sc.SchemeCatalog(spark)
    ids = c.add_all(["a.raw", "a.maximum.hour", "a.hour", "b.raw", "c.median.hour"])
    got = rows(ro.cascade(meas([(ids["a.raw"], 5, 1.0, 0), (ids["a.raw"], 9, 7.0, 0), (ids["b.raw"], 1, 1.0, 0), (99, 1, 1.0, 0)]), c.ls()))
    assert got == [(ids["a.maximum.hour"], 9, 7.0, 0)]
    assert ro.cascade(meas([]), c.ls()).count() == 0


def test_backfill_includes_the_open_period(spark, meas):
    c = sc.SchemeCatalog(spark)
    ids = c.add_all(["a.raw", "a.count.hour"])
    h = 3_600_000
    m = meas([(ids["a.raw"], t, 1.0, 0) for t in (0, h, h + 1, h + 2, 2 * h + 5)] + [(ids["a.count.hour"], h + 1, 2.0, 0)])
    got = sorted(rows(ro.backfill(m, sc.linked(c.ls()))))
    assert got == [(ids["a.count.hour"], h + 2, 3.0, 0), (ids["a.count.hour"], 2 * h + 5, 1.0, 0)]


def test_least_current_time(spark, meas):
    scheme = spark.createDataFrame([(1, "hour"), (2, "hour"), (3, "day"), (4, "hour"), (6, "week")], "id long, interval string")
    m = meas([(1, 5, 1.0, 0), (1, 90, 1.0, 0), (2, 70, 1.0, 0), (2, 70, 2.0, 4), (3, 10, 1.0, 0), (5, 1, 1.0, 0), (None, 0, 1.0, 0), (4, None, 1.0, 0)])
    for interval, least in (("hour", 70), ("day", 10), ("week", MAX_TIME), ("month", MAX_TIME)):
        assert rows(ro.least_current_time(m, scheme, interval)) == [(least,)]
    assert rows(ro.least_current_time(meas([]), scheme, "hour")) == [(MAX_TIME,)]


def test_retention_and_erasure(spark, meas):
    scheme = spark.createDataFrame([(1, "raw"), (2, "year"), (3, None)], "id long, interval string")
    m = meas([(i, t, 1.0, 0) for i in (1, 2, 3, 4) for t in (0, 10 * DAY)])
    left = ro.retention(m, scheme, 10 * DAY + 5)
    assert sorted(rows(left, "id", "time")) == sorted([(1, 10 * DAY)] + [(i, t) for i in (2, 3, 4) for t in (0, 10 * DAY)])
    assert sorted(rows(ro.retention(m, scheme, 5), "id", "time")).count((1, 10 * DAY)) == 1
    assert sorted(rows(ro.erase_old(m, [1], 0), "id", "time"))[0] == (1, 10 * DAY)


# Store

def test_contract(store):
    for i in range(3):
        assert store.append_rows([(i, k, float(k), i) for k in range(50)]).writed == 50
    store.flush()
    store.append_rows([(0, k, float(k), 0) for k in range(50, 100)])
    assert store.read_interval([0], 0, 1000).count() == 100
    assert store.stat(0).first()["count"] == 100 and store.min_max_time(0) == (0, 99) and store.min_max_time(77) is None
    assert (store.min_time(), store.max_time()) == (0, 99)
    assert rows(store.read_time_point([9999], 5)) == [(9999, 5, 0.0, NO_DATA)]
    assert sorted(rows(store.current_value(), "id", "time")) == [(0, 99), (1, 49), (2, 49)]
    seen, ended = [], []
    assert store.foreach([1], 0, 100, lambda r: seen.append(r["time"]) or len(seen) == 5, is_end=lambda: ended.append(1)) == 5
    assert seen == [0, 1, 2, 3, 4] and ended == [1]


def test_repack_and_compact(store, spark):
    store.append_frame(spark.range(1, 101).select(F.lit(0).alias("id"), F.col("id").alias("time"), F.lit(1.0).alias("value")))
    store.append_frame(spark.range(1, 101).select(F.lit(1).alias("id"), F.col("id").alias("time"), F.lit(1.0).alias("value")))
    store.append_frame(spark.range(1, 51).select(F.lit(0).alias("id"), F.col("id").alias("time"), F.lit(3.0).alias("value")))
    assert store.rows().count() == 250
    store.repack()
    assert store.rows().count() == 200 and store.read_interval([0], 0, 50).where("value = 3").count() == 50
    store.compact(0, change={"flag": F.lit(777).cast("long")})
    assert store.read_interval([0], 0, 1000, 777).count() == 100 and store.read_interval([1], 0, 1000, 777).count() == 0
    store.compact(1, keep=F.col("time") % 2 == 1)
    assert store.read_interval([1], 0, 1000).count() == 50
    store.compact_with(1, lambda parts: (p[p.time > 50].assign(value=9.0) for p in parts))
    assert rows(store.stat(1), "count", "min_value", "max_value") == [(25, 9.0, 9.0)]
    store.compact(0, erase_older_than=50, now=100)
    assert store.read_interval([0], 0, 1000).count() == 50
    store.erase_old(0, 90)
    assert rows(store.stat(0), "count", "min_time") == [(10, 91)]
    store.compact(0, keep=F.lit(False))
    store.compact(1, keep=F.lit(False))
    assert store.rows().count() == 0


def test_append_frame_counts_what_it_leaves_out(store, spark):
    st = store.append_frame(spark.createDataFrame([(1, 1, 1.0), (None, 1, 1.0), (1, None, 1.0), (1, 2, None)], "id long, time long, value double"))
    assert (st.writed, st.ignored) == (1, 3)


def test_reopen_lock_and_cleaning(spark, tmp_path):
    p = str(tmp_path / "s")
    s = open_storage(spark, p)
    s.append(1, 1, 2.0)
    with pytest.raises(LockedError):
        Store(spark, p)
    s.stop()
    (tmp_path / "s" / "layer-left").mkdir()
    s = open_storage(spark, p)
    assert not (tmp_path / "s" / "layer-left").exists() and rows(s.rows(), "id", "value") == [(1, 2.0)]
    s.append(1, 1, 3.0)
    assert rows(s.read_interval([1], 0, 5), "value") == [(3.0,)]
    s.stop()
    folder = Folder(p, spark)
    folder.write("Manifest", json.dumps(json.loads(folder.read("Manifest")) | {"format": 2}))
    with pytest.raises(LockedError):
        Store(spark, p)


def test_fsck(spark, tmp_path):
    s = Store(spark, str(tmp_path / "s"))
    s.append(1, 1, 1.0)
    s.flush()
    s.append(2, 1, 1.0)
    s.flush()
    assert s.fsck() == [] and s.description()["layers"] == 2
    bad = tmp_path / "s" / s._layers[0]
    for f in bad.glob("*.parquet"):
        f.write_bytes(b"broken")
    for f in bad.glob(".*.crc"):
        f.unlink()
    assert s.fsck() == [bad.name] and rows(s.rows(), "id") == [(2,)]
    s.stop()


def test_subscribers(spark):
    s = memory_only_storage(spark)
    seen = {k: [] for k in ("all", "2", "21", "f1")}
    for k, ids, flag in (("all", [], 0), ("2", [2], 0), ("21", [2, 1], 0), ("f1", [], 1)):
        s.subscribe(ids, flag, lambda *r, k=k: seen[k].append(r))
    s.append_rows([(i % 5, i, float(i), i) for i in range(100)])
    assert {k: len(v) for k, v in seen.items()} == {"all": 100, "2": 20, "21": 40, "f1": 1}


def test_shards(spark, tmp_path):
    s = ShardedStore(spark, str(tmp_path))
    ids = s.scheme.add_all(["0.raw", "1.minute", "2.hour"])
    s.add("default")
    s.add("mine", ids=[50])
    for i in (*ids.values(), 50, 60):
        s.append(i, i, float(i))
    assert {x["alias"] for x in s.list()} == {"raw", "minute", "hour", "default", "mine"}
    assert s.read_interval([50, 60, 0], 0, 100).count() == 3 and s.current_value().count() == 5
    assert rows(s.read_time_point([60, 999], 70), "id", "flag") == [(60, 0), (999, NO_DATA)] or sorted(rows(s.read_time_point([60, 999], 70), "id", "flag")) == [(60, 0), (999, NO_DATA)]
    s.add("mine", ids=[51])
    s.stop()
    again = open_storage(spark, str(tmp_path))
    assert isinstance(again, ShardedStore) and next(x for x in again.list() if x["alias"] == "mine")["ids"] == [50, 51]
    assert again.read_interval([50], 0, 100).count() == 1
    again.remove("mine")
    assert "mine" not in {x["alias"] for x in again.list()}
    again.stop()


def test_one_series_is_rewritten_alone(spark, tmp_path):
    s = Store(spark, str(tmp_path / "s"))
    s.append_frame(spark.range(0, 300).select((F.col("id") % 3).alias("id"), F.col("id").alias("time"), F.lit(1.0).alias("value")))
    first = list(s._layers)
    s.erase_old(1, 150)
    assert s._layers[:1] == first and s._read([s._layers[1]]).select("id").distinct().collect() == [(1,)]
    assert rows(s.stat(1), "count", "min_time") == [(sum(t > 150 for t in range(1, 300, 3)), 151)] and rows(s.stat(0), "count") == [(100,)]
    s.append(1, 10, 7.0)
    s.repack(1)
    assert rows(s.stat(1), "min_time", "max_value") == [(10, 7.0)] and len(s._layers) == 4
    before = s.rows()
    n = before.count()
    s.repack()
    assert len(s._layers) == 1 and s._hidden == {} and s.rows().count() == n and before.count() == n  # an older reader still finds its files
    s.stop()
    again = Store(spark, str(tmp_path / "s"))
    assert again.rows().count() == n and len([x for x in again.folder.names() if x.startswith("layer-")]) == 1
    again.stop()


def test_single_rows_survive(spark, tmp_path):
    """A store that wasn't stopped gets its single rows back, also after one series was flushed, and none twice."""
    at = str(tmp_path / "s")
    s = Store(spark, at)
    s.append_rows([(1, 1, 1.0), (2, 1, 2.0, 5), (1, 2, float("nan"))])
    s.flush(1)
    assert s.description()["buffered"] == 1
    s.append(3, 1, 3.0)
    with open(s._log_path(), "a") as f:
        f.write('[4, 1, ')  # cut off
    again = Store(spark, at, force_unlock=True)
    assert sorted(rows(again.rows(), "id", "time", "flag")) == [(1, 1, 0), (1, 2, 0), (2, 1, 5), (3, 1, 0)]
    again.append(3, 1, 4.0)
    again.flush()
    third = Store(spark, at, force_unlock=True)
    assert third.rows().count() == 5 and rows(third.read_interval([3], 0, 9), "value") == [(4.0,)] and third.description()["buffered"] == 0
    third.stop()


def test_reading_on_a_thread(store):
    store.append_rows([(1, k, float(k)) for k in range(50)])
    seen, ended = [], []
    r = store.start_foreach([1], 0, 100, seen.append, is_end=lambda: ended.append(1))
    assert r.wait(120) and r.rows == 50 and len(seen) == 50 and ended == [1]
    r = store.start_foreach([1], 0, 100, lambda row: r.cancel())
    assert r.wait(120) and r.rows <= 2
    with pytest.raises(ZeroDivisionError):
        store.start_foreach([1], 0, 100, lambda row: 1 / 0).wait(120)
    got = []
    assert store.foreach_time_point([1, 9], 7, got.append) == 2 and sorted((x["id"], x["time"]) for x in got) == [(1, 7), (9, 7)]


def test_bulk_appends_reach_subscribers(spark):
    s = memory_only_storage(spark)
    seen = []
    s.subscribe([2], 1, lambda *r: seen.append(r))
    s.append_frame(spark.createDataFrame([(1, 1, 1.0, 1), (2, 1, 1.0, 1), (2, 2, 1.0, 3)], "id long, time long, value double, flag long"))
    assert seen == [(2, 1, 1.0, 1)]


def test_sharded_store_in_full(spark, tmp_path):
    s = ShardedStore(spark, str(tmp_path))
    ids = s.scheme.add_all(["0.raw", "1.minute"])
    s.add("default")
    s.add("mine", ids=[50])
    seen = []
    s.subscribe([50], 0, lambda *r: seen.append(r))
    data = [(i, t, float(t)) for i in (*ids.values(), 50, 60) for t in range(10)]
    st = s.append_frame(spark.createDataFrame([*data, (None, 1, 1.0)], "id long, time long, value double"))
    assert (st.writed, st.ignored) == (40, 1) and len(seen) == 10
    assert {x["alias"]: x["ids"] for x in s.list()} == {"default": [], "mine": [50], "raw": [ids["0.raw"]], "minute": [ids["1.minute"]]}
    assert rows(s.stat(50), "count", "sum") == [(10, 45.0)] and (s.min_time(), s.max_time()) == (0, 9) and s.min_max_time(60) == (0, 9) and s.first_last().count() == 4
    s.erase_old(50, 4)
    s.compact(60, keep=F.col("time") % 2 == 0)
    s.compact_with(ids["0.raw"], lambda parts: (p[p.time > 7] for p in parts))
    s.append(50, 9, 1.0)
    s.flush(50)
    s.repack(50)
    assert [s.stat(i).first()["count"] for i in (50, 60, ids["0.raw"], ids["1.minute"])] == [5, 5, 2, 10]
    s.repack()
    got = []
    assert s.foreach([50, 60], 0, 100, got.append) == 10 and s.fsck() == []
    api = JsonApi(s)
    assert json.loads(api.handle({"type": "stat", "id": "1.minute", "from": 0, "to": 100})[1])["1.minute"]["count"] == 10
    assert api.handle({"type": "erase", "id": "1.minute", "to": 5})[0] == 200 and s.stat(ids["1.minute"]).first()["count"] == 4
    s.stop()


def test_timer(spark):
    from tidewell.plans.timer import RollupTimer, Timer

    at, calls = [0], []
    t = Timer(lambda: at[0])
    t.add(5, lambda x: calls.append(("a", x)) or (x + 5 if x < 15 else None))
    t.add(6, lambda x: 1 / 0)
    assert t.run_due() == 0 and t.next_time() == 5
    at[0] = 12
    assert t.run_due() == 3 and calls == [("a", 5), ("a", 10)] and t.next_time() == 15
    at[0] = 100
    assert t.run_due() == 1 and t.next_time() is None
    done = threading.Event()
    real = Timer()
    real.start()
    real.add(real.now() + 30, lambda x: done.set())
    assert done.wait(20)
    real.stop()
    # At the end of a minute its average is appended.
    s = memory_only_storage(spark)
    raw, minute = s.scheme.add("p.raw"), s.scheme.add("p.average.minute")
    s.append_rows([(raw, 1_000, 2.0), (raw, 59_000, 4.0), (raw, 61_000, 8.0)])
    clock = [10_000]
    r = RollupTimer(s, Timer(lambda: clock[0]))
    r.watch("minute")
    assert r.timer.next_time() == 59_999
    clock[0] = 60_000
    assert r.timer.run_due() == 1 and r.timer.next_time() == 119_999
    assert sorted(rows(s.read_interval([minute], 0, 200_000), "time", "value")) == [(59_000, 3.0), (61_000, 8.0)]


# Settings

def test_settings(tmp_path):
    s = Settings()
    s.change("strategy=WAL")
    s.change("lifetime_raw=5")
    s.change("raw_is_memonly=true")
    s.save(Folder(str(tmp_path)))
    t = Settings.load(Folder(str(tmp_path)))
    assert t == s and t.lifetime_for("raw") == 5 and t.lifetime_for("year") is None and t.strategy_for("hour") == "COMPRESSED"
    assert json.loads(t.dump())["chunk_size"] == "1024"
    for bad, e in (("x=1", KeyError), ("strategy=none", ValueError), ("strategy", ValueError)):
        with pytest.raises(e):
            t.change(bad)
    t.set_default()
    assert t == Settings()


# JSON

def test_json(spark):
    api = JsonApi(memory_only_storage(spark))
    ask = lambda q: (lambda s, b: (s, json.loads(b) if b[:1] in "{[" and b else b))(*api.handle(q))
    columns = {str(n): {k: [i for i in range(100) if i % 10 == n] for k in "FTV"} for n in range(10)}
    assert ask({"type": "append", "append_values": columns}) == (200, {"writed": 100, "ignored": 0, "error": "OK"})
    assert ask({"type": "append", "append_value": {"I": "single_value", "T": 777, "V": 777.0, "F": 0}})[1]["writed"] == 1
    s, r = ask({"type": "readInterval", "id": [*columns, "single_value", "none"], "from": 0, "to": 2**64 - 1, "flag": 0})
    assert s == 200 and sum(map(len, r.values())) == 101 and r["3"][0] == {"F": 3, "T": 3, "V": 3.0} and "none" not in r
    assert ask({"type": "readTimepoint", "id": ["3"], "time": 50, "flag": 0}) == (200, {"3": [{"F": 43, "T": 43, "V": 43.0}]})
    assert ask({"type": "stat", "id": "3", "from": 0, "to": 2**64 - 1})[1]["3"] == {"count": 10, "maxTime": 93, "maxValue": 93.0, "minTime": 3, "minValue": 3.0, "sum": 480.0}
    s, r = ask({"type": "statistic", "id": "3", "from": 0, "to": 1000, "flag": 0, "functions": ["average", "median", "nothing"]})
    assert s == 200 and r["average"] == {"F": STATS, "T": 93, "V": 48.0} and r["median"]["V"] == 53.0 and r["nothing"] == {"F": 0, "T": 0, "V": 0.0}
    assert api.handle({"type": "statistic", "id": "3", "from": 5000, "to": 6000, "functions": ["average"]}) == (200, "")
    assert ask({"type": "scheme", "add": ["new1", "new1"]})[1]["new1"] == 11 and json.loads(api.get("/scheme")[1])["new1"] == 11
    assert ask({"type": "erase", "id": "3", "to": 50})[0] == 200
    assert len(ask({"type": "readInterval", "id": ["3"], "from": 0, "to": 1000})[1]["3"]) == 5
    assert json.loads(api.get("/statfuncs")[1])["functions"][0] == "average" and api.get("/other") == (204, "")
    assert api.handle("garbage")[0] == 400 and api.handle({"type": "none"})[0] == 404 and api.handle({"type": "readInterval"})[0] == 400
    assert api.handle({"type": "append", "append_values": {"a": {"F": [1], "T": [1, 2], "V": [1.0]}}})[0] == 400


# Streams

def test_streams(spark, meas, tmp_path):
    src = str(tmp_path / "in")
    m = meas([(i % 5, i * 60_000, float(i), i % 3) for i in range(300)] + [(1, 60_000, 99.0, 1), (1, 120_000, None, 1)])
    m.repartition(4).write.parquet(src)
    stream = sub.read_rows(spark, src, 1)
    seen = []
    q = sub.deliver(sub.subscribe(stream, [2, 1], 1), lambda b, n: seen.extend(b.collect()), str(tmp_path / "c1"), once=True)
    q.awaitTermination()
    assert len(seen) == m.where("id in (1, 2) and flag = 1").count()
    got = rows(sub.run_to_table(sub.windowed_rollup(stream, "halfhour"), str(tmp_path / "w1"), str(tmp_path / "c2")), "id", "bucket", "n", "low", "high")
    want = rows(m.where("value is not null").groupBy("id", (F.col("time") - F.col("time") % 1_800_000).alias("bucket")).agg(F.count("value").alias("n"), F.min("value").alias("low"), F.max("value").alias("high")))
    assert sorted(got) == sorted(want)
    assert rows(sub.windowed_rollup(m, "week"), "bucket")[0][0] == -3 * DAY
    assert sub.windowed_rollup(stream, "hour", late_ms=1000).isStreaming
    last = {r["id"]: r["time"] for r in sub.run_to_table(sub.latest_values(stream), str(tmp_path / "l1"), str(tmp_path / "c3")).collect()}
    assert last == {i: (295 + i) * 60_000 for i in range(5)}


def test_late_rows_are_rolled_up_again(spark, meas, tmp_path):
    store = memory_only_storage(spark)
    hour = lambda df: df.withColumn("bucket", F.col("time") - F.col("time") % 3_600_000)
    roll = lambda df: df.groupBy("id", "bucket").agg(F.sum("value").alias("value")).select((F.col("id") + 100).alias("id"), F.col("bucket").alias("time"), "value")
    call = sub.rolled_by_touched(spark, store, roll, ["id", "bucket"], hour)
    call(meas([(1, 5, 1.0, 0), (1, 3_600_005, 1.0, 0)]), 0)
    call(meas([(1, 9, 2.0, 0)]), 1)
    assert rows(store.read_interval([101], 0, 10**9), "time", "value") == [(0, 3.0), (3_600_000, 1.0)]


# Files, command line, HTTP

def test_files(spark, tmp_path):
    import pandas as pd

    from tidewell.sources import files

    df = pd.DataFrame({"id": [1, 4294967295, 1], "time": [5, 6, 5], "value": [1.5, -2.0, 9.0], "flag": [0, 4294967295, 1]})
    (tmp_path / "a.wal").write_bytes(files.pack_rows(df) + b"half")
    got = files.read_packed(spark, str(tmp_path / "*.wal"))
    assert rows(got, "id", "time", "value", "flag") == [tuple(r) for r in df.itertuples(index=False)]
    from tidewell.operators.reads import dedupe

    assert sorted(rows(dedupe(got), "id", "value")) == [(1, 1.5), (4294967295, -2.0)]
    folder = Folder(str(tmp_path / "c"), spark)
    c = sc.SchemeCatalog(spark, folder)
    c.add_all(["a.raw", "b"])
    c.save()
    assert sorted(rows(files.read_scheme(spark, folder.at("scheme.js")))) == [(0, "a.raw", "raw", None), (1, "b", None, None)]
    folder.write("shards.js", json.dumps([{"alias": "x", "path": "p", "ids": [1, 2]}, {"alias": "default", "path": "d", "ids": []}]))
    assert sorted(rows(files.read_shards(spark, folder.at("shards.js"))), key=str) == sorted([("x", "p", 1), ("x", "p", 2), ("default", "d", None)], key=str)
    spark.range(3).select("id", F.col("id").alias("time"), F.lit(1.0).alias("value")).write.parquet(str(tmp_path / "t"))
    assert rows(files.read_table(spark, str(tmp_path / "t")).agg(F.sum("flag"), F.sum("seq"))) == [(0, 0)]


def test_bits(spark):
    from tidewell.functions import hashing as h

    df = spark.createDataFrame([(5, "123456789")], "w long, s string")
    assert df.select(h.get_bit(F.col("w"), 0), h.get_bit(F.col("w"), 1), h.set_bit(F.col("w"), 1), h.clear_bit(F.col("w"), 2), h.crc32("s")).first() == (1, 0, 7, 1, 0xCBF43926)


def test_command_line(spark, tmp_path, capsys, monkeypatch):
    from tidewell.__main__ import main

    at = str(tmp_path / "s")
    assert main(["--init", "--storage-path", at, "--strategy", "WAL"]) == 0
    s = Store(spark, at)
    assert s.settings.strategy == "WAL"
    s.append(1, 1, 1.0)
    s.stop()
    assert main(["--repack", "--storage-path", at]) == 0 and main(["--fsck", "--storage-path", at]) == 0 and main(["--format", "--memory-only"]) == 0
    assert main(["--init", "--use-shards", "--storage-path", str(tmp_path / "t")]) == 0
    with pytest.raises(SystemExit):
        main(["--init"])


def test_http(spark):
    import threading
    import urllib.request

    from tidewell.plans.json_api import serve

    server = serve(JsonApi(memory_only_storage(spark)), 0)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    url = f"http://127.0.0.1:{server.server_port}"
    try:
        body = json.dumps({"type": "append", "append_value": {"I": "a", "T": 1, "V": 2.0, "F": 0}}).encode()
        assert json.load(urllib.request.urlopen(urllib.request.Request(url, data=body)))["writed"] == 1
        assert json.load(urllib.request.urlopen(url + "/scheme")) == {"a": 0}
        assert urllib.request.urlopen(url + "/nothing").status == 204
        with pytest.raises(urllib.error.HTTPError):
            urllib.request.urlopen(urllib.request.Request(url, data=b"{}"))
    finally:
        server.shutdown()
