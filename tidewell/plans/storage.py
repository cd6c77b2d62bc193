"""A store of series: Parquet layers, a list of the live ones, a catalogue and settings.

Appending adds a layer; nothing is changed in place. Compaction, erasure and the
repacking of one series write that series alone, as a new layer, and hide it in the
layers before; repacking all writes one layer from the live ones. Then the list
is replaced in one step, so a reader sees the old state or the new one, and a job
that dies in between leaves only unlisted files. Unlisted layers stay for
readers that began before; stopping or opening the store removes them.

Single rows are held in memory until there are enough for a layer; where the store
lies in a local folder each is first added to a log, which the next opening reads.

Layers are clustered by (id, time): a large series spans several files and the
footers' bounds let a read skip all files of other series and times.
"""

from __future__ import annotations

import json
import logging
import os
import threading
import uuid
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.operators import reads
from tidewell.plans.cut import written
from tidewell.plans.folder import Folder
from tidewell.plans.scheme import NAME_INTERVALS, SchemeCatalog, route
from tidewell.plans.settings import Settings
from tidewell.streaming.subscriptions import subscribe
from tidewell.types import MAX_TIME, MEAS_SCHEMA

log = logging.getLogger(__name__)

FORMAT = 3
_LAYER_SCHEMA = "id long, time long, value double, flag long, seq long"


@dataclass
class Status:
    """Counts of an append; they add up."""

    writed: int = 0
    ignored: int = 0
    error: str = "OK"

    def __add__(self, other: Status) -> Status:
        return Status(self.writed + other.writed, self.ignored + other.ignored, other.error if self.error == "OK" else self.error)


class Reading:
    """Rows that are handed to a callback on a thread of their own."""

    def __init__(self, work: Callable[[Callable[[], bool]], int]) -> None:
        self._stop, self.rows, self.error = threading.Event(), 0, None

        def run() -> None:
            try:
                self.rows = work(self._stop.is_set)
            except Exception as e:  # given to the one who waits
                self.error = e

        self._thread = threading.Thread(target=run, daemon=True)
        self._thread.start()

    def cancel(self) -> None:
        """No row is handed over after the one in hand."""
        self._stop.set()

    def wait(self, seconds: float | None = None) -> bool:
        """Whether it has ended; an error of the callback is raised here."""
        self._thread.join(seconds)
        if self.error:
            raise self.error
        return not self._thread.is_alive()


class LockedError(RuntimeError):
    """The store is open elsewhere, or of another format."""


class Store:
    """One folder of series. All reads are lazy DataFrames over the live layers."""

    MANIFEST = "Manifest"

    def __init__(self, spark: SparkSession, path: str | None, force_unlock: bool = False, buffer_rows: int = 10_000) -> None:
        """path None: in memory only. buffer_rows: single rows are held until there are so many, or until `flush`."""
        self.spark, self.path, self.buffer_rows = spark, path, buffer_rows
        self._buffer: list[tuple] = []
        self._seq = 0
        self._memory: list[DataFrame] = []
        self._layers: list[str] = []
        self._hidden: dict[str, list[int]] = {}  # series that are hidden in a layer
        self._part, self._log = 0, None
        self._callbacks: list[tuple[tuple[int, ...], int, Callable]] = []
        self.folder = Folder(path, spark) if path else None
        self.settings = Settings.load(self.folder) if path else Settings(strategy="MEMORY")
        self.scheme = SchemeCatalog(spark, self.folder)
        if path:
            self._open(force_unlock)

    def _open(self, force_unlock: bool) -> None:
        self.folder.make()
        if not self.folder.create_once("lock", str(os.getpid())) and not force_unlock:
            raise LockedError(f"{self.path} is locked")
        if self.folder.exists(self.MANIFEST):
            m = json.loads(self.folder.read(self.MANIFEST))
            if m["format"] != FORMAT:
                self.folder.remove("lock")
                raise LockedError(f"format {m['format']}, expected {FORMAT}")
            self._layers, self._seq, self._hidden, self._part = m["layers"], m["seq"], m.get("hidden", {}), m.get("log", 0)
        else:
            self._list(self._layers)
            self.settings.save(self.folder)
        self._clean()
        self._replay()

    def _clean(self) -> None:
        """Removes layers that aren't listed: replaced ones, and what an unfinished job left."""
        for d in self.folder.names():
            if d.startswith("layer-") and d not in self._layers or d.startswith("rows-") and d != self._log_name():
                self.folder.remove(d)

    def _list(self, layers: list[str], hidden: dict[str, list[int]] | None = None) -> None:
        """Replaces the list of live layers in one step."""
        hidden = {n: h for n, h in (self._hidden if hidden is None else hidden).items() if n in layers}
        self.folder.write(self.MANIFEST, json.dumps({"format": FORMAT, "layers": layers, "seq": self._seq, "hidden": hidden, "log": self._part}))
        self._layers, self._hidden = list(layers), hidden

    # The log of single rows: one file, which the list names.

    def _log_name(self) -> str:
        return f"rows-{self._part}.wal"

    def _log_path(self) -> str | None:
        at = (self.path or "").removeprefix("file://")
        return f"{at}/{self._log_name()}" if at and "://" not in at else None

    def _replay(self) -> None:
        """Takes back single rows that weren't flushed when the store was last used. A row that was cut off is left out."""
        at = self._log_path()
        if not at or not os.path.exists(at):
            return
        with open(at) as f:
            for line in f:
                try:
                    i, t, v, flag, seq = json.loads(line)
                except ValueError:
                    break
                self._buffer.append((i, t, float(v), flag, seq))
                self._seq = max(self._seq, seq)

    def _note(self, row: tuple) -> None:
        if not (at := self._log_path()):
            return
        if self._log is None:
            self._log = open(at, "a")  # noqa: SIM115
        self._log.write(json.dumps(row) + "\n")
        self._log.flush()

    def _next_log(self) -> None:
        """A log with the rows that are still held; the one before is valid until the list names this one."""
        if self._log is not None:
            self._log.close()
            self._log = None
        self._part += 1
        for r in self._buffer:
            self._note(r)

    # Writing

    def append(self, id: int, time: int, value: float, flag: int = 0) -> Status:  # noqa: A002
        """One row, held in a buffer that every read includes."""
        self._seq += 1
        self._buffer.append((id, time, float(value), flag, self._seq))
        self._note(self._buffer[-1])
        for ids, f, call in self._callbacks:
            if (not ids or id in ids) and (not f or f == flag):
                call(id, time, float(value), flag)
        if len(self._buffer) >= self.buffer_rows:
            self.flush()
        return Status(writed=1)

    def append_rows(self, rows: Iterable[tuple]) -> Status:
        """Rows of (id, time, value, flag)."""
        out = Status()
        for r in rows:
            out = out + self.append(*r)
        return out

    def append_frame(self, rows: DataFrame) -> Status:
        """A DataFrame (id, time, value[, flag]) as one layer; of equal (id, time) within it the larger flag, then value wins."""
        self.flush()
        self._seq += 1
        flag = F.coalesce("flag", F.lit(0)).cast("long") if "flag" in rows.columns else F.lit(0).cast("long")
        own = rows.select(F.col("id").cast("long"), F.col("time").cast("long"), F.col("value").cast("double"), flag.alias("flag"), F.lit(self._seq).cast("long").alias("seq"))
        good = own.where(F.col("id").isNotNull() & F.col("time").isNotNull() & F.col("value").isNotNull())
        before = own.count()
        n = self._add(good)
        for ids, f, call in self._callbacks:
            wanted = subscribe(good, ids, f)
            for r in wanted.select("id", "time", "value", "flag").toLocalIterator():
                call(*r)
        return Status(writed=n, ignored=before - n)

    def _add(self, rows: DataFrame) -> int:
        if not self.path:
            kept = rows.persist()
            self._memory.append(kept)
            return kept.count()
        name = self._write(rows)
        self._list([*self._layers, name])
        return self._read([name]).count()

    def _write(self, rows: DataFrame) -> str:
        name = f"layer-{uuid.uuid4().hex}"
        rows.repartitionByRange("id", "time").sortWithinPartitions("id", "time").write.parquet(f"{self.path}/{name}")
        return name

    def flush(self, id: int | None = None) -> None:  # noqa: A002
        """Writes the rows that are held, of one series or of all."""
        held = [r for r in self._buffer if id is None or r[0] == id]
        if held:
            self._buffer = [r for r in self._buffer if id is not None and r[0] != id]
            rows = self.spark.createDataFrame(held, _LAYER_SCHEMA)
            if not self.path:
                self._add(rows)
                return
            name, old = self._write(rows), self._log_path()
            self._next_log()
            self._list([*self._layers, name])
            if old and os.path.exists(old):
                os.remove(old)

    # Reading

    def _read(self, names: list[str]) -> DataFrame:
        if not names:
            return self.spark.createDataFrame([], _LAYER_SCHEMA)
        return self.spark.read.schema(_LAYER_SCHEMA).parquet(*[f"{self.path}/{n}" for n in names])

    def rows(self) -> DataFrame:
        """All rows as written, with seq: id, time, value, flag, seq."""
        out = self._read([n for n in self._layers if n not in self._hidden]) if self.path else None
        for n, ids in self._hidden.items():
            out = out.unionByName(self._read([n]).where(~F.col("id").isin(ids)))
        for x in self._memory:
            out = x if out is None else out.unionByName(x)
        if self._buffer:
            b = self.spark.createDataFrame(self._buffer, _LAYER_SCHEMA)
            out = b if out is None else out.unionByName(b)
        return out if out is not None else self.spark.createDataFrame([], _LAYER_SCHEMA)

    def read_interval(self, ids: Iterable[int], start: int, end: int, flag: int = 0) -> DataFrame:
        return reads.read_interval(self.rows(), ids, start, end, flag)

    def read_time_point(self, ids: Iterable[int], time_point: int, flag: int = 0) -> DataFrame:
        return reads.read_time_point(self.rows(), self.spark.createDataFrame([(i,) for i in ids], "id long"), time_point, flag)

    def current_value(self, ids: Iterable[int] | None = None, flag: int = 0) -> DataFrame:
        return reads.current_value(self.rows(), ids, flag)

    def stat(self, id: int, start: int = 0, end: int = MAX_TIME) -> DataFrame:  # noqa: A002
        return reads.range_stat(self.rows().where(F.col("id") == id), start, end)

    def min_time(self) -> int:
        return reads.min_max_time(self.rows()).first()["min_time"]

    def max_time(self) -> int:
        return reads.min_max_time(self.rows()).first()["max_time"]

    def min_max_time(self, id: int) -> tuple[int, int] | None:  # noqa: A002
        r = self.rows().where(F.col("id") == id).agg(F.min("time"), F.max("time")).first()
        return None if r[0] is None else (r[0], r[1])

    def first_last(self) -> DataFrame:
        return reads.first_last(self.rows())

    def foreach(self, ids: Iterable[int], start: int, end: int, call: Callable, flag: int = 0, is_end: Callable | None = None) -> int:
        """Calls call(row) for each row in order until it returns True, then is_end(); rows come a partition at a time."""
        n = 0
        for r in self.cursor(ids, start, end, flag):
            n += 1
            if call(r):
                break
        if is_end:
            is_end()
        return n

    def foreach_time_point(self, ids: Iterable[int], time_point: int, call: Callable, flag: int = 0, is_end: Callable | None = None) -> int:
        """The same for what was valid at a moment: one row for each id."""
        n = 0
        for r in self.read_time_point(ids, time_point, flag).toLocalIterator():
            n += 1
            if call(r):
                break
        if is_end:
            is_end()
        return n

    def start_foreach(self, ids: Iterable[int], start: int, end: int, call: Callable, flag: int = 0, is_end: Callable | None = None) -> Reading:
        """`foreach` on a thread of its own; the result can be waited for and cancelled."""
        return Reading(lambda stop: self.foreach(ids, start, end, lambda r: stop() or call(r), flag, is_end))

    def cursor(self, ids: Iterable[int], start: int, end: int, flag: int = 0) -> Iterator:
        return self.read_interval(ids, start, end, flag).toLocalIterator(prefetchPartitions=True)

    def subscribe(self, ids: Iterable[int], flag: int, call: Callable) -> None:
        """call(id, time, value, flag) on each later `append` of one of ids (none: any) with exactly this flag (0: any)."""
        self._callbacks.append((tuple(ids), flag, call))

    # Rewriting

    def _replace(self, rows: DataFrame) -> None:
        """The store's rows from now on."""
        if not self.path:
            kept = rows.persist()
            kept.count()
            for x in self._memory:
                x.unpersist()
            self._memory = [kept]
            return
        self._list([self._write(rows)])

    def _rewrite(self, id: int, change: Callable[[DataFrame], DataFrame]) -> None:  # noqa: A002
        """change: from the series' rows, each (id, time) once, to those it has from now on. Only files that may hold the series are read
        (by their footers), and only its rows are written; those in the layers so far are hidden until all is repacked."""
        self.flush(id)
        mine = F.col("id") == id
        new = self._with_seq(change(reads.dedupe(self.rows().where(mine))))
        if not self.path:
            kept = new.persist()
            kept.count()
            self._memory = [*(x.where(~mine) for x in self._memory), kept]
            return
        name = self._write(new)
        self._list([*self._layers, name], {n: sorted({*self._hidden.get(n, ()), id}) for n in self._layers})

    def _with_seq(self, rows: DataFrame) -> DataFrame:
        return rows.withColumn("seq", F.lit(self._seq).cast("long"))

    def repack(self, id: int | None = None) -> None:  # noqa: A002
        """One row for each (id, time): of one series, or of all, in one clustered layer."""
        if id is not None:
            self._rewrite(id, lambda rows: rows)
            return
        self.flush()
        self._replace(self._with_seq(reads.dedupe(self.rows())))

    compress_all = repack

    def repack_due(self) -> bool:
        """As many layers as the settings allow on one level, or more."""
        return len(self._layers) > self.settings.max_pages_per_level

    def compact(self, id: int, start: int = 0, end: int = MAX_TIME, keep: Column | None = None, change: dict[str, Column] | None = None,  # noqa: A002
                erase_older_than: int | None = None, now: int | None = None) -> None:
        """Rewrites a series' rows from start to end: those for which `keep` doesn't hold are dropped, `change` gives new values of
        time, value or flag. Rows of the series at least erase_older_than ms before `now` are dropped first."""
        own = F.col("time").between(start, end)

        def new(rows: DataFrame) -> DataFrame:
            if erase_older_than is not None:
                rows = rows.where(~(F.lit(now) - F.col("time") >= erase_older_than))
            if keep is not None:
                rows = rows.where(~own | F.coalesce(keep, F.lit(False)))
            if change:
                rows = rows.select(*[F.when(own, change[c]).otherwise(F.col(c)).alias(c) if c in change else F.col(c) for c in MEAS_SCHEMA.fieldNames()])
            return reads.dedupe(self._with_seq(rows))

        self._rewrite(id, new)

    def compact_with(self, id: int, rewrite: Callable) -> None:  # noqa: A002
        """`rewrite` is a function of batches, as of DataFrame.mapInPandas, over the series' rows; what it yields stays."""
        self._rewrite(id, lambda rows: reads.dedupe(self._with_seq(rows.mapInPandas(rewrite, MEAS_SCHEMA))))

    def erase_old(self, id: int, until: int) -> None:  # noqa: A002
        """Removes the series' rows at or before `until`."""
        self._rewrite(id, lambda rows: rows.where(F.col("time") > F.lit(min(until, MAX_TIME)).cast("long")))

    def fsck(self) -> list[str]:
        """Layers that can't be read are taken off the list; their names."""
        bad = []
        for n in self._layers:
            try:
                self._read([n]).write.format("noop").mode("overwrite").save()
            except Exception as e:
                log.warning("layer %s can't be read: %s", n, str(e)[:200])
                bad.append(n)
        if bad:
            self._list([n for n in self._layers if n not in bad])
        return bad

    def description(self) -> dict[str, int]:
        files = [f for n in self._layers for f in self.folder.names(n) if f.endswith(".parquet")]
        return {"layers": len(self._layers) + len(self._memory), "files": len(files), "buffered": len(self._buffer)}

    def stop(self) -> None:
        if self.path:
            self.flush()
            self.scheme.save()
            self._clean()
            self.folder.remove("lock")
        for x in self._memory:
            x.unpersist()


class ShardedStore:
    """Stores by alias; each series goes to the one that lists it, else to that of its interval, else to the default one."""

    FILE = "shards.js"

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path
        self.folder = Folder(path, spark)
        self.folder.make()
        self.scheme = SchemeCatalog(spark, self.folder)
        self._shards: dict[str, dict] = {}
        self._open: dict[str, Store] = {}
        self._callbacks: list[tuple] = []
        self._routes: dict[int, str] | None = None  # of listed ids, and of those of the default shard that were asked for
        self._names: dict[int, str] = {}
        if self.folder.exists(self.FILE):
            self._shards = {s["alias"]: s for s in json.loads(self.folder.read(self.FILE))}

    def _save(self) -> None:
        self.folder.write(self.FILE, json.dumps(list(self._shards.values()), indent=1))

    def add(self, alias: str, path: str | None = None, ids: Iterable[int] = ()) -> None:
        """No ids: the default shard. A known alias gets further ids."""
        known, new = alias in self._shards, set(ids)
        s = self._shards.setdefault(alias, {"alias": alias, "path": path or f"{self.path}/shards/{alias}", "ids": []})
        if known and new <= {*s["ids"]}:
            return
        s["ids"] = sorted({*s["ids"], *new})
        self._routes = None
        self._save()

    def remove(self, alias: str) -> None:
        if x := self._open.pop(alias, None):
            x.stop()
        self._shards.pop(alias, None)
        self._routes = None
        self._save()

    def list(self) -> list[dict]:
        return [dict(s) for s in self._shards.values()]

    def alias_of(self, id: int) -> str:  # noqa: A002
        if self._routes is None:
            self._routes = {}
            for x in self._shards.values():
                for i in x["ids"]:
                    self._routes.setdefault(i, x["alias"])
        if id not in self._routes:
            alias = self._alias_by_name(id)
            self.add(alias, ids=[id] if alias in NAME_INTERVALS else [])
            if self._routes is not None:
                self._routes[id] = alias
            return alias
        return self._routes[id]

    def _alias_by_name(self, id: int) -> str:  # noqa: A002
        names = self.scheme.names()
        if len(self._names) != len(names):
            self._names = {i: n for n, i in names.items()}
        parts = [p for p in self._names.get(id, "").split(".") if p]
        if len(parts) >= 2 and parts[-1] in NAME_INTERVALS:
            return parts[-1]
        return next((x["alias"] for x in self._shards.values() if not x["ids"]), "default")

    def store(self, alias: str) -> Store:
        if alias not in self._open:
            self._open[alias] = Store(self.spark, self._shards[alias]["path"])
            for c in self._callbacks:
                self._open[alias].subscribe(*c)
        return self._open[alias]

    def append(self, id: int, time: int, value: float, flag: int = 0) -> Status:  # noqa: A002
        return self.store(self.alias_of(id)).append(id, time, value, flag)

    def append_rows(self, rows: Iterable[tuple]) -> Status:
        out = Status()
        for r in rows:
            out = out + self.append(*r)
        return out

    def append_frame(self, rows: DataFrame) -> Status:
        """A DataFrame (id, time, value[, flag]): each shard gets the rows of its series as one layer. The ids of `rows` are routed as a table."""
        listed = self.spark.createDataFrame([(x["alias"], i) for x in self._shards.values() for i in x["ids"]], "alias string, id long")
        default = next((x["alias"] for x in self._shards.values() if not x["ids"]), "default")
        by_name = self.scheme.ls().withColumn("interval", F.when(F.col("interval").isin(*NAME_INTERVALS), F.col("interval")))
        own = written(rows.withColumn("id", F.col("id").cast("long")), "rows")  # read by each shard
        routes = written(route(own.select("id").where(F.col("id").isNotNull()).distinct(), by_name, listed)
                         .withColumn("alias", F.when(F.col("alias") == "default", F.lit(default)).otherwise(F.col("alias"))), "routes")
        out = Status(ignored=own.where(F.col("id").isNull()).count())
        for alias in sorted(r[0] for r in routes.select("alias").distinct().collect()):
            mine = routes.where(F.col("alias") == alias).select("id")
            self.add(alias, ids=[r[0] for r in mine.collect()] if alias in NAME_INTERVALS else [])
            out = out + self.store(alias).append_frame(own.join(mine, "id", "left_semi"))
        return out

    def rows(self, ids: Iterable[int] | None = None) -> DataFrame:
        """Only the shards that hold any of ids are read."""
        names = list(self._shards) if ids is None else list(dict.fromkeys(self.alias_of(i) for i in ids))
        out = self.spark.createDataFrame([], _LAYER_SCHEMA)
        for n in names:
            out = out.unionByName(self.store(n).rows())
        return out

    def read_interval(self, ids: Iterable[int], start: int, end: int, flag: int = 0) -> DataFrame:
        ids = list(ids)
        return reads.read_interval(self.rows(ids), ids, start, end, flag)

    def read_time_point(self, ids: Iterable[int], time_point: int, flag: int = 0) -> DataFrame:
        ids = list(ids)
        return reads.read_time_point(self.rows(ids), self.spark.createDataFrame([(i,) for i in ids], "id long"), time_point, flag)

    def current_value(self, ids: Iterable[int] | None = None, flag: int = 0) -> DataFrame:
        ids = list(ids or [])
        return reads.current_value(self.rows(ids or None), ids, flag)

    def stat(self, id: int, start: int = 0, end: int = MAX_TIME) -> DataFrame:  # noqa: A002
        return self.store(self.alias_of(id)).stat(id, start, end)

    def min_time(self) -> int:
        return reads.min_max_time(self.rows()).first()["min_time"]

    def max_time(self) -> int:
        return reads.min_max_time(self.rows()).first()["max_time"]

    def min_max_time(self, id: int) -> tuple[int, int] | None:  # noqa: A002
        return self.store(self.alias_of(id)).min_max_time(id)

    def first_last(self) -> DataFrame:
        return reads.first_last(self.rows())

    cursor, foreach, foreach_time_point, start_foreach = Store.cursor, Store.foreach, Store.foreach_time_point, Store.start_foreach

    def subscribe(self, ids: Iterable[int], flag: int, call: Callable) -> None:
        """On the shards that there are, and those that are opened later."""
        self._callbacks.append((ids, flag, call))
        for x in self._open.values():
            x.subscribe(ids, flag, call)

    def flush(self, id: int | None = None) -> None:  # noqa: A002
        for n in [self.alias_of(id)] if id is not None else list(self._open):
            self.store(n).flush(id)

    def compact(self, id: int, *args, **kw) -> None:  # noqa: A002
        self.store(self.alias_of(id)).compact(id, *args, **kw)

    def compact_with(self, id: int, rewrite: Callable) -> None:  # noqa: A002
        self.store(self.alias_of(id)).compact_with(id, rewrite)

    def erase_old(self, id: int, until: int) -> None:  # noqa: A002
        self.store(self.alias_of(id)).erase_old(id, until)

    @property
    def settings(self) -> Settings:
        return Settings.load(self.folder)

    def repack(self, id: int | None = None) -> None:  # noqa: A002
        for n in [self.alias_of(id)] if id is not None else list(self._shards):
            self.store(n).repack(id)

    def fsck(self) -> list[str]:
        return [f"{n}/{x}" for n in self._shards for x in self.store(n).fsck()]

    def description(self) -> dict[str, dict]:
        return {n: self.store(n).description() for n in self._shards}

    def stop(self) -> None:
        for s in self._open.values():
            s.stop()
        self._open = {}
        self.scheme.save()


def open_storage(spark: SparkSession, path: str, force_unlock: bool = False) -> Store | ShardedStore:
    """A sharded store if the folder lists shards, else a plain one."""
    if Folder(path, spark).exists(ShardedStore.FILE):
        return ShardedStore(spark, path)
    return Store(spark, path, force_unlock)


def memory_only_storage(spark: SparkSession) -> Store:
    return Store(spark, None)
