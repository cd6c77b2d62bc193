"""Implausible spikes, stuck values and impossible readings, by source.

Every reading gets four features, in units of its series' usual step (the
median of the absolute differences of successive readings): its level, its
difference from the third readings before and after it, its departure from the
series' usual value at that hour of the day, and the length of the run of equal
values that it is in. An isolation forest of the series scores every reading;
readings that it finds at least as unusual as any spike by the rule must be to it
are candidates. Only these are held against the exact rule. Physical limits are
rules of their own, and so are stuck values: in a series that often stands still,
a long run is nothing that a forest isolates.

A series that fits into one task is handled there as a whole. The readings of a
series that is cut into time shards (see `layout`) are exchanged and sorted once
and written as blocks, each with the few readings beside it, so that every later
pass is a scan in which any block can be handled anywhere. Three passes gather
what doesn't grow with the length of the series:

* for each shard its outermost values, for each series its sums by hour;
* the histogram of absolute differences in narrow logarithmic bins, from which
  follows the bin of the median, then the exact median from that bin's values;
* the sample of readings on which its forest is grown.

A last one scores the blocks.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewell.operators.forest import Forests, mix
from tidewell.operators.layout import ShardPlan, join_by_id, ordered_readings, plan_shards
from tidewell.plans.cut import written
from tidewell.types import EPS

#: Readings beside a shard that decide about those at its ends: five for spikes, seven for runs of eight.
HALO = 7
STUCK = 8
FAR = 10.0
#: Readings of a series from which its forest's samples are drawn.
POOL = 256
#: Bins of absolute differences: so many to a factor of e.
BINS = 16_384
CHUNK_ROWS = 100_000
#: Readings of a series that isn't cut beyond which it is handled by blocks within its task.
LONG_ROWS = 400_000
#: Readings of a block.
BLOCK = 16_384
#: Cuts in all. For each of them at most 14 readings come to the driver, and for each series that is cut, of which there are fewer, usual values by
#: hour and the features of POOL readings, 4.3 kB.
MAX_SHARDS = 50_000
FEATURES = ("level", "difference", "season", "run")
#: The feature `difference` of every spike by the rule is more than FAR units; less what rounding may do.
LEAST_DIFFERENCE = float(np.log1p(FAR)) - 1e-5


@dataclass
class HotSeries:
    """What is known of a series that is cut: its step and unit, usual values by hour (the 25th: over all), limits and pool (features)."""

    step: float = 0.0
    scale: float = 1.0
    hours: np.ndarray | None = None
    limits: tuple[float, float] = (-np.inf, np.inf)
    pool: np.ndarray | None = None


@dataclass
class Hot:
    series: dict[int, HotSeries] = field(default_factory=dict)
    pre: dict[tuple[int, int], np.ndarray] = field(default_factory=dict)  # values before the shard, in order of time
    post: dict[tuple[int, int], np.ndarray] = field(default_factory=dict)


def _chunks(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[dict[str, np.ndarray]]:
    """Columns of whole (id, shard) groups, of at least CHUNK_ROWS rows where there are so many. Each batch is looked at once, however long a group."""
    held: list[pa.RecordBatch] = []
    rows, last = 0, None

    def arrays() -> dict[str, np.ndarray]:
        t = pa.Table.from_batches(held)
        return {c: t.column(c).to_numpy() for c in names}

    for b in batches:
        if not b.num_rows:
            continue
        new = _starts(b, last)
        last = _last(b)
        if rows + b.num_rows >= CHUNK_ROWS and len(new):
            cut = int(new[-1])
            held.append(b.slice(0, cut))
            if rows + cut:
                yield arrays()
            held, rows = [b.slice(cut)], b.num_rows - cut
        else:
            held.append(b)
            rows += b.num_rows
    if held:
        yield arrays()


def _last(b: pa.RecordBatch) -> tuple[int, int]:
    return b.column("id")[-1].as_py(), b.column("shard")[-1].as_py()


def _starts(b: pa.RecordBatch, last: tuple[int, int] | None) -> np.ndarray:
    """Where in a batch a group begins; last: the group before the batch."""
    i, k = b.column("id").to_numpy(), b.column("shard").to_numpy()
    new = np.flatnonzero((i[1:] != i[:-1]) | (k[1:] != k[:-1])) + 1
    return new if last == (i[0], k[0]) else np.r_[0, new]


class _Segments:
    """Whole series, or blocks of series, with HALO values added at both ends (NaN where there are none)."""

    def __init__(self, ids: np.ndarray, n: np.ndarray, time: np.ndarray, value: np.ndarray, pre: list | None = None, post: list | None = None) -> None:
        self.id, self.n, self.time, self.v = ids, n, time, value
        self.first = np.cumsum(n) - n
        self.of = np.repeat(np.arange(len(n)), n)
        self.at = np.arange(len(value)) + HALO * (2 * self.of + 1)  # places of the readings in `long`
        self.long = np.full(len(value) + 2 * HALO * len(n), np.nan)
        self.long[self.at] = value
        for s in range(len(n)) if pre is not None else ():
            a = self.first[s] + 2 * HALO * s
            if len(pre[s]):
                self.long[a + HALO - len(pre[s]):a + HALO] = pre[s]
            if len(post[s]):
                self.long[a + HALO + n[s]:a + HALO + n[s] + len(post[s])] = post[s]

    @classmethod
    def of_rows(cls, x: dict[str, np.ndarray]) -> _Segments:
        first = np.flatnonzero(np.r_[True, (x["id"][1:] != x["id"][:-1]) | (x["shard"][1:] != x["shard"][:-1])])
        return cls(x["id"][first], np.diff(np.r_[first, len(x["id"])]), x["time"], x["value"])

    def differences(self) -> np.ndarray:
        """Absolute difference from the reading before; NaN for the first."""
        with np.errstate(invalid="ignore"):
            return np.abs(self.v - self.long[self.at - 1])

    def around(self, step: np.ndarray) -> np.ndarray:
        """step: by segment. How far each reading lies beyond the third before and the third after it, where these are at most FAR steps apart;
        else 0. Both are among the six readings around any stretch of one to three that it is in, so for every spike by the rule it is
        more than FAR steps."""
        a, b = self.long[self.at - 3], self.long[self.at + 3]
        with np.errstate(invalid="ignore", over="ignore"):
            beyond = np.maximum(self.v - np.maximum(a, b), np.minimum(a, b) - self.v)
            return np.where(np.abs(a - b) <= FAR * step[self.of], np.maximum(beyond, 0.0), 0.0)

    def spikes(self, step: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """step: by segment. Of each of these readings whether a stretch of one to three that it is in fulfils the rule."""
        x = self.long[self.at[rows] + np.arange(-5, 6)[:, None]]
        spike = np.zeros(len(rows), bool)
        with np.errstate(invalid="ignore", over="ignore"):
            far = FAR * step[self.of[rows]]
            for length in (1, 2, 3):
                for first in range(6 - length, 6):  # the reading itself is at 5
                    last = first + length
                    six, stretch = np.concatenate([x[first - 3:first], x[last:last + 3]]), x[first:last]
                    hi, lo = six.max(axis=0), six.min(axis=0)
                    spike |= (hi - lo <= far) & (np.maximum(stretch - hi, lo - stretch).min(axis=0) > far)
        return spike

    def runs(self) -> np.ndarray:
        """Length of the run of readings less than EPS from the one before, as far as it can be seen; at most STUCK."""
        with np.errstate(invalid="ignore"):
            same = np.abs(self.long[1:] - self.long[:-1]) < EPS
        run = np.cumsum(np.r_[True, ~same]) - 1
        return np.minimum(np.bincount(run)[run], STUCK)[self.at]

    def hour(self) -> np.ndarray:
        return (self.time // 3_600_000) % 24


def _medians(of: np.ndarray, d: np.ndarray, k: int) -> np.ndarray:
    """Ordinary medians of d by group, NaN left out and for empty groups."""
    ok = ~np.isnan(d)
    of, d = of[ok], d[ok]
    order = np.lexsort((d, of))
    d, n = d[order], np.bincount(of, minlength=k)
    first = np.r_[0, np.cumsum(n)[:-1]]
    out = np.full(k, np.nan)
    some = n > 0
    a, b = d[first[some] + (n[some] - 1) // 2], d[first[some] + n[some] // 2]
    with np.errstate(invalid="ignore"):
        out[some] = np.where(a == b, a, (a + b) / 2)
    return out


def _usual(step: np.ndarray, scale: np.ndarray) -> np.ndarray:
    """The unit of the features: the step, or where the series hardly moves how far its usual values by hour lie from their mean, or 1."""
    return np.where(step >= EPS, step, np.where(scale > 0, scale, 1.0))


def _features(seg: _Segments, hours: np.ndarray, unit: np.ndarray, difference: np.ndarray, run: np.ndarray) -> np.ndarray:
    """hours: [segment, 24] usual values, their mean in a 25th column; unit: by segment."""
    u = unit[seg.of]
    out = np.empty((len(seg.v), len(FEATURES)), np.float32)
    with np.errstate(invalid="ignore", over="ignore"):
        for i, x in enumerate((np.abs(seg.v - hours[seg.of, 24]) / u, difference / u, np.abs(seg.v - hours[seg.of, seg.hour()]) / u)):
            out[:, i] = np.nan_to_num(np.log1p(x), nan=50.0, posinf=50.0)
    out[:, 3] = np.log2(run)
    return np.minimum(out, 50.0)


def _profile(sums: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Means by hour and, last, over all; an hour without finite readings has the mean over all."""
    n = counts.sum(axis=1)
    mean = np.divide(sums.sum(axis=1), n, out=np.zeros(len(n)), where=n > 0)
    hours = np.where(counts > 0, np.divide(sums, counts, out=np.zeros_like(sums), where=counts > 0), mean[:, None])
    return np.c_[hours, mean]


def _scale(hours: np.ndarray) -> np.ndarray:
    return np.abs(hours[:, :24] - hours[:, 24:]).mean(axis=1)


def _hour_sums(seg: _Segments) -> tuple[np.ndarray, np.ndarray]:
    k, fin = len(seg.id), np.isfinite(seg.v)
    at = (seg.of * 24 + seg.hour())[fin]
    return (np.bincount(at, weights=seg.v[fin], minlength=24 * k).reshape(k, 24), np.bincount(at, minlength=24 * k).reshape(k, 24))


def _key(time: np.ndarray) -> np.ndarray:
    """What the pool is chosen by: a hash of the time, not negative."""
    return (mix(time) >> np.uint64(1)).astype(np.int64)


def _lowest(of: np.ndarray, key: np.ndarray, k: int) -> np.ndarray:
    """Rows with the k smallest keys of each group, groups in order."""
    order = np.lexsort((key, of))
    o = of[order]
    first = np.flatnonzero(np.r_[True, o[1:] != o[:-1]])
    rank = np.arange(len(o)) - np.repeat(first, np.diff(np.r_[first, len(o)]))
    return order[rank < k]


_COLS = ["id", "shard", "time", "value"]

_BLOCKS = "id long, shard int, block int, pre array<double>, post array<double>, times array<long>, values array<double>, sums array<double>, counts array<long>"


def _bin(d: np.ndarray) -> np.ndarray:
    with np.errstate(divide="ignore"):
        return np.where(d > 0, np.floor(np.log(np.maximum(d, 5e-324)) * BINS), -1e15).clip(-1e15, 1e15).astype(np.int64)


def _cut(batches: Iterator[pa.RecordBatch], block_rows: int) -> Iterator[pa.RecordBatch]:
    """Blocks of the shards. pre and post: the readings beside the block in its shard; null at the ends of the shard, and post is
    shorter than HALO where the shard ends so soon after the block. Of a shard no more than a block and a batch are held."""
    f, i = pa.list_(pa.float64()), pa.list_(pa.int64())
    types = {"id": pa.int64(), "shard": pa.int32(), "block": pa.int32(), "pre": f, "post": f, "times": i, "values": f, "sums": f, "counts": i}
    out: dict[str, list] = {c: [] for c in types}
    t, v = np.empty(0, np.int64), np.empty(0)
    pre, block = None, 0

    def emit(group: tuple[int, int], n: int) -> None:
        nonlocal t, v, pre, block
        part = _Segments(np.array(group[:1]), np.array([n]), t[:n], v[:n])
        sums, counts = _hour_sums(part)
        for c, y in zip(out, (*group, block, pre, v[n:n + HALO] if len(v) > n else None, part.time, part.v, sums[0], counts[0])):
            out[c].append(y)
        pre, block, t, v = v[max(0, n - HALO):n], block + 1, t[n:], v[n:]

    def end(group: tuple[int, int] | None) -> None:
        nonlocal pre, block
        while len(v):
            emit(group, min(len(v), block_rows))
        pre, block = None, 0

    def full() -> pa.RecordBatch:
        done = pa.RecordBatch.from_pydict({c: pa.array(x, types[c]) for c, x in out.items()})
        for x in out.values():
            x.clear()
        return done

    group = None
    for b in batches:
        if not b.num_rows:
            continue
        ids, shards, times, values = (b.column(c).to_numpy() for c in _COLS)
        new = _starts(b, group)
        for a, z in zip([0, *new], [*new, b.num_rows]):
            if a == z:
                continue
            if (own := (int(ids[a]), int(shards[a]))) != group:
                end(group)
                group = own
            t, v = np.r_[t, times[a:z]], np.r_[v, values[a:z]]
            while len(v) >= block_rows + HALO:
                emit(group, block_rows)
        if len(out["id"]) * block_rows >= CHUNK_ROWS:
            yield full()
    end(group)
    if out["id"]:
        yield full()


def _segments(batches: Iterator[pa.RecordBatch], hot: Hot) -> Iterator[_Segments]:
    """The blocks, as many at once as hold about CHUNK_ROWS readings, with the readings beside them."""
    some = max(1, CHUNK_ROWS // BLOCK)
    for batch in batches:
        for a in range(0, batch.num_rows, some):
            b = batch.slice(a, some)
            ids, shard = b.column("id").to_numpy(), b.column("shard").to_numpy()
            keys = [(int(i), int(k)) for i, k in zip(ids, shard)]
            none = np.empty(0)
            pre = [hot.pre.get(k, none) if y is None else np.array(y) for k, y in zip(keys, b.column("pre").to_pylist())]
            post = [np.array(y) if y and len(y) == HALO else np.r_[y or none, hot.post.get(k, none)][:HALO] for k, y in zip(keys, b.column("post").to_pylist())]
            values = b.column("values")
            n = np.asarray(values.value_lengths()).astype(np.int64)
            yield _Segments(ids, n, b.column("times").flatten().to_numpy(), values.flatten().to_numpy(), pre, post)


def _histogram(batches: Iterator[pa.RecordBatch], hot: Hot) -> Iterator[pa.RecordBatch]:
    """id, bin, n of the absolute differences, added up by batch."""
    for seg in _segments(batches, hot):
        d = seg.differences()
        ok = ~np.isnan(d)
        pairs, n = np.unique(np.stack([seg.id[seg.of[ok]], _bin(d[ok])]), axis=1, return_counts=True)
        yield pa.RecordBatch.from_pydict({"id": pairs[0], "bin": pairs[1], "n": n.astype(np.int64)})


def _narrow(batches: Iterator[pa.RecordBatch], hot: Hot, bins: dict[int, set[int]]) -> Iterator[pa.RecordBatch]:
    """The absolute differences in the bins of the median."""
    wanted = np.array([(i, b) for i, own in bins.items() for b in own], np.int64).reshape(-1, 2)
    for seg in _segments(batches, hot):
        d = seg.differences()
        ok = np.flatnonzero(~np.isnan(d))
        ids, own = seg.id[seg.of[ok]], _bin(d[ok])
        hit = np.zeros(len(ok), bool)
        for i in np.unique(seg.id):
            hit |= (ids == i) & np.isin(own, wanted[wanted[:, 0] == i, 1])
        yield pa.RecordBatch.from_pydict({"id": ids[hit], "d": d[ok[hit]]})


def _of_series(seg: _Segments, hot: Hot) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Step, usual values and unit of each block."""
    info = [hot.series[int(i)] for i in seg.id]
    step = np.array([h.step for h in info])
    return step, np.stack([h.hours for h in info]), _usual(step, np.array([h.scale for h in info]))


def _pool(batches: Iterator[pa.RecordBatch], hot: Hot) -> Iterator[pa.RecordBatch]:
    """The readings that may belong to their series' pool."""
    for seg in _segments(batches, hot):
        step, hours, unit = _of_series(seg, hot)
        feats = _features(seg, hours, unit, seg.around(step), seg.runs())
        keys, ids = _key(seg.time), np.unique(seg.id, return_inverse=True)[1][seg.of]
        low = _lowest(ids, keys, POOL)
        yield pa.RecordBatch.from_pydict({"id": seg.id[seg.of[low]], "key": keys[low], "features": pa.array([f.tobytes() for f in feats[low]], pa.binary())})


_SCORED = "id long, time long, value double, score float, candidate boolean, spike boolean, stuck boolean, impossible boolean"


def _result(seg: _Segments, step: np.ndarray, feats: np.ndarray, run: np.ndarray, low: np.ndarray, high: np.ndarray, forest: Forests,
            series: np.ndarray) -> pa.RecordBatch:
    """series: the forest of each reading. A candidate's score is one that a spike by the rule can have in this forest; no other reading is
    held against that rule."""
    score = forest.score(series, feats)
    candidate = score >= forest.least_score(FEATURES.index("difference"), LEAST_DIFFERENCE)[series]
    moves = (step >= EPS)[seg.of]
    spike = np.zeros(len(seg.v), bool)
    rows = np.flatnonzero(candidate & moves)
    spike[rows] = seg.spikes(step, rows)
    return pa.RecordBatch.from_pydict({
        "id": seg.id[seg.of], "time": seg.time, "value": seg.v, "score": score, "candidate": candidate,
        "spike": spike, "stuck": (run >= STUCK) & moves, "impossible": (seg.v < low) | (seg.v > high),
    })


def _score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of whole series."""
    for x in _chunks(batches, [*_COLS, "min_value", "max_value"]):
        _, first, last = _spans(x["id"])
        if (long := last - first > LONG_ROWS).any():
            for a, z in zip(first[long], last[long]):
                yield from _score_long({c: y[a:z] for c, y in x.items()})
            x = {c: y[np.repeat(~long, last - first)] for c, y in x.items()}
            if not len(x["id"]):
                continue
        seg = _Segments.of_rows(x)
        k = len(seg.id)
        step = np.nan_to_num(_medians(seg.of, seg.differences(), k), nan=0.0)
        hours = _profile(*_hour_sums(seg))
        run = seg.runs()
        feats = _features(seg, hours, _usual(step, _scale(hours)), seg.around(step), run)
        pick = _lowest(seg.of, _key(seg.time), POOL)
        pools, sizes = feats[pick], np.bincount(seg.of[pick], minlength=k)
        forest = Forests(seg.id, pools, np.r_[0, np.cumsum(sizes)])
        yield _result(seg, step, feats, run, x["min_value"], x["max_value"], forest, seg.of)


def _score_long(x: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
    """Of one series whose features shouldn't all be held at once: by blocks, as those of series that are cut."""
    t, v, sid = x["time"], x["value"], x["id"][:1]

    def blocks() -> Iterator[_Segments]:
        for a in range(0, len(v), CHUNK_ROWS):
            z = min(a + CHUNK_ROWS, len(v))
            yield _Segments(sid, np.array([z - a]), t[a:z], v[a:z], [v[max(0, a - HALO):a]], [v[z:z + HALO]])

    with np.errstate(invalid="ignore"):
        d = np.abs(np.diff(v))
    d = d[~np.isnan(d)]
    step = np.zeros(1)
    if len(d):
        low, high = np.partition(d, [(len(d) - 1) // 2, len(d) // 2])[[(len(d) - 1) // 2, len(d) // 2]]
        step[0] = low if low == high else (low + high) / 2
    sums = [_hour_sums(seg) for seg in blocks()]
    hours = _profile(sum(s for s, _ in sums), sum(n for _, n in sums))
    unit = _usual(step, _scale(hours))

    def featured() -> Iterator[tuple[_Segments, np.ndarray, np.ndarray]]:
        for seg in blocks():
            run = seg.runs()
            yield seg, _features(seg, hours, unit, seg.around(step), run), run

    keys, feats = [], []
    for seg, f, _ in featured():
        own = _key(seg.time)
        low = _lowest(seg.of, own, POOL)
        keys.append(own[low])
        feats.append(f[low])
    best = np.argsort(np.concatenate(keys), kind="stable")[:POOL]
    pool = np.concatenate(feats)[best]
    forest = Forests(sid, pool, np.array([0, len(pool)]))
    for seg, f, run in featured():
        yield _result(seg, step, f, run, x["min_value"][0], x["max_value"][0], forest, seg.of)


def _score_blocks(batches: Iterator[pa.RecordBatch], hot: Hot) -> Iterator[pa.RecordBatch]:
    """Of blocks of series that are cut. A series' forest is grown again where it is needed, always the same."""
    grown: tuple[list[int], Forests] | None = None
    for seg in _segments(batches, hot):
        step, hours, unit = _of_series(seg, hot)
        run = seg.runs()
        feats = _features(seg, hours, unit, seg.around(step), run)
        ids, at = np.unique(seg.id, return_inverse=True)
        if grown is None or grown[0] != ids.tolist():
            parts = [hot.series[int(i)].pool for i in ids]
            grown = (ids.tolist(), Forests(ids, np.concatenate(parts), np.r_[0, np.cumsum([len(p) for p in parts])]))
        limits = np.array([hot.series[int(i)].limits for i in seg.id])[seg.of]
        yield _result(seg, step, feats, run, limits[:, 0], limits[:, 1], grown[1], at[seg.of])


def limits_by_id(scheme: DataFrame, limits: DataFrame) -> DataFrame:
    """id, min_value, max_value of the series whose name has a token equal to a listed quantity, whatever the case. With
    several such tokens the narrowest limits hold."""
    tokens = scheme.where(F.col("id").isNotNull()).select("id", F.explode(F.split(F.lower("name"), r"\.")).alias("quantity"))
    known = limits.where(F.col("quantity").isNotNull()).select(F.lower("quantity").alias("quantity"), "min_value", "max_value")
    return tokens.join(known, "quantity").groupBy("id").agg(F.max("min_value").alias("min_value"), F.min("max_value").alias("max_value"))


def _know(blocks: DataFrame, plan: ShardPlan, dims: DataFrame) -> Hot:
    """Gathers what is needed of the series that are cut; what comes to the driver is bounded by the plan's cuts."""
    spark = blocks.sparkSession
    hot = Hot()
    whole = F.concat(F.coalesce("pre", F.array().cast("array<double>")), "values")
    ends = (blocks.groupBy("id", "shard").agg(F.min_by(F.slice("values", 1, HALO), "block").alias("head"), F.max_by(F.slice(F.reverse(whole), 1, HALO), "block").alias("tail"))
            .orderBy("id", "shard").toPandas())
    by_hour = (blocks.select("id", F.posexplode(F.arrays_zip("sums", "counts")).alias("hour", "h")).groupBy("id", "hour")
               .agg(F.sum("h.sums").alias("total"), F.sum("h.counts").alias("n")).toPandas())
    for sid, own in by_hour.groupby("id"):
        own = own.sort_values("hour")
        hot.series[int(sid)] = HotSeries(hours=_profile(own["total"].to_numpy()[None, :], own["n"].to_numpy()[None, :])[0])
    for sid, own in ends.groupby("id"):
        heads, tails, keys = own["head"].to_list(), [t[::-1] for t in own["tail"]], [(int(sid), int(s)) for s in own["shard"]]
        before: np.ndarray = np.empty(0)
        for key, tail in zip(keys, tails):
            hot.pre[key] = before[-HALO:]
            before = np.concatenate([before, tail])[-HALO:]
        after: np.ndarray = np.empty(0)
        for key, head in zip(reversed(keys), reversed(heads)):
            hot.post[key] = after[:HALO]
            after = np.concatenate([head, after])[:HALO]
    hot_ids = spark.createDataFrame([(i,) for i in hot.series], "id long")
    for r in dims.join(F.broadcast(hot_ids), "id", "left_semi").collect():
        hot.series[r["id"]].limits = tuple(d if r[c] is None else r[c] for c, d in (("min_value", -np.inf), ("max_value", np.inf)))
    # Each difference is counted in the block of its later reading.
    binned = blocks.mapInArrow(lambda b: _histogram(b, hot), "id long, bin long, n long").groupBy("id", "bin").agg(F.sum("n").alias("n"))
    by_bin = Window.partitionBy("id").orderBy("bin")
    cum = binned.withColumn("upto", F.sum("n").over(by_bin)).withColumn("all", F.sum("n").over(Window.partitionBy("id")))
    low, high = F.call_function("div", F.col("all") - 1, F.lit(2).cast("long")), F.call_function("div", F.col("all"), F.lit(2).cast("long"))
    middle = cum.where(((F.col("upto") > low) & (F.col("upto") - F.col("n") <= low)) | ((F.col("upto") > high) & (F.col("upto") - F.col("n") <= high))).collect()
    bins: dict[int, set[int]] = {i: set() for i in hot.series}
    want: dict[int, tuple[int, int, int]] = {}
    for r in sorted(middle, key=lambda r: (r["id"], r["bin"])):
        bins[r["id"]].add(r["bin"])
        below, n = want.get(r["id"], (r["upto"] - r["n"], 0, 0))[0], r["all"]
        want[r["id"]] = (below, (n - 1) // 2 - below, n // 2 - below)
    ranks = spark.createDataFrame([(i, a, b) for i, (_, a, b) in want.items()], "id long, low long, high long")
    counted = (blocks.mapInArrow(lambda b: _narrow(b, hot, bins), "id long, d double").groupBy("id", "d").agg(F.count(F.lit(1)).alias("n"))
               .withColumn("upto", F.sum("n").over(Window.partitionBy("id").orderBy("d"))))
    exact = (counted.join(F.broadcast(ranks), "id").groupBy("id")
             .agg(F.min(F.when(F.col("upto") > F.col("low"), F.col("d"))).alias("a"), F.min(F.when(F.col("upto") > F.col("high"), F.col("d"))).alias("b")).collect())
    for r in exact:
        hot.series[r["id"]].step = r["a"] if r["a"] == r["b"] else (r["a"] + r["b"]) / 2
    for h in hot.series.values():
        h.scale = float(_scale(h.hours[None, :])[0])
    best = Window.partitionBy("id").orderBy("key")
    pools = (blocks.mapInArrow(lambda b: _pool(b, hot), "id long, key long, features binary")
             .withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= POOL).select("id", "rank", "features").toArrow())
    ids, rank = pools.column("id").to_numpy(), pools.column("rank").to_numpy()
    feats = np.concatenate([np.empty(0, np.float32), *(_floats(x) for x in pools.column("features").chunks)]).reshape(-1, len(FEATURES))
    order = np.lexsort((rank, ids))
    ids, feats = ids[order], feats[order]
    for sid, first, last in zip(*(x.tolist() for x in _spans(ids))):
        hot.series[sid].pool = feats[first:last]
    return hot


def _spans(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of sorted ids each one, where it begins and where it ends."""
    first = np.flatnonzero(np.r_[True, ids[1:] != ids[:-1]]) if len(ids) else np.empty(0, np.int64)
    return ids[first], first, np.r_[first[1:], len(ids)]


def _floats(x: pa.BinaryArray) -> np.ndarray:
    """The bytes of all values as numbers."""
    at = np.frombuffer(x.buffers()[1], np.int32, len(x) + 1, x.offset * 4)
    return np.frombuffer(x.buffers()[2], np.float32, int(at[-1] - at[0]) // 4, int(at[0])) if len(x) else np.empty(0, np.float32)


def score_readings(rows: DataFrame, scheme: DataFrame, limits: DataFrame, block_rows: int = BLOCK, **layout) -> DataFrame:
    """Every current reading (id, time, value) with its score by the forest of its series, whether that makes it a
    candidate, and the rules `spike` (false unless it is a candidate), `stuck` and `impossible` (see TESTDATA.md, p5_found).

    rows: id, time, value, flag, seq, as delivered. Series missing from scheme have no limits; a null limit doesn't hold.
    A series with one reading has no step, so only its limits count. Infinite readings are far from all finite ones.
    block_rows: readings of a block of a series that is cut, at least HALO.
    """
    if block_rows < HALO:
        raise ValueError(f"a block must hold at least {HALO} readings")
    plan = plan_shards(rows, **({"max_shards": MAX_SHARDS} | layout))
    dims = limits_by_id(scheme, limits)
    few = rows.select("id", "time", "value", "flag", "seq")
    inf = float("inf")
    hot_ids = rows.sparkSession.createDataFrame([(i,) for i in plan.cuts], "id long")
    cold = few.join(F.broadcast(hot_ids), "id", "left_anti") if plan.hot else few
    out = (
        ordered_readings(join_by_id(cold, dims, ShardPlan(), how="left"), ShardPlan(rows=plan.rows), keep=("min_value", "max_value"))
        .withColumns({"min_value": F.coalesce("min_value", F.lit(-inf)), "max_value": F.coalesce("max_value", F.lit(inf))})
        .sortWithinPartitions("id", "shard", "time").mapInArrow(_score, _SCORED)
    )
    if not plan.hot:
        return out
    ordered = ordered_readings(few.join(F.broadcast(hot_ids), "id", "left_semi"), plan).select(*_COLS).sortWithinPartitions("id", "shard", "time")
    blocks = written(ordered.mapInArrow(lambda b: _cut(b, block_rows), _BLOCKS), "blocks", {"parquet.block.size": str(32 << 20)})
    shared = rows.sparkSession.sparkContext.broadcast(_know(blocks, plan, dims))
    return out.unionByName(blocks.select("id", "shard", "pre", "post", "times", "values").mapInArrow(lambda b: _score_blocks(b, shared.value), _SCORED))


def implausible(rows: DataFrame, scheme: DataFrame, limits: DataFrame, **layout) -> DataFrame:
    """Candidates of the forest that are spikes by the exact rule, stuck readings, and readings beyond physical limits."""
    scored = score_readings(rows, scheme, limits, **layout)
    return scored.where(F.col("impossible") | F.col("stuck") | (F.col("candidate") & F.col("spike")))
