"""Results by key when a few keys hold most rows."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Arrays of so many splits are added up by one task of a level of the reduction.
FAN_IN = 64
BATCH_ROWS = 500_000

_PARTIAL = "_block int, _null boolean, _part long, _keys array<long>, _rows array<long>, _values array<long>, _sum array<double>, _min array<double>, _max array<double>"
_RESULT = "id long, n_rows long, n_values long, total double, min_value double, max_value double"


class _Accumulators:
    """A dictionary of keys and, at each key's code, dense arrays of what was added up for it."""

    def __init__(self) -> None:
        self.keys = np.empty(0, np.int64)
        self.rows = np.empty(0, np.int64)
        self.values = np.empty(0, np.int64)
        self.sum = np.empty(0)
        self.min = np.empty(0)
        self.max = np.empty(0)

    def merge(self, keys, rows, values, total, low, high) -> None:
        """Adds arrays that belong to `keys` (unique, sorted)."""
        both = np.union1d(self.keys, keys)
        a, b = np.searchsorted(both, self.keys), np.searchsorted(both, keys)

        def scatter(old, new, empty, f):
            out = np.full(len(both), empty, dtype=old.dtype)
            out[a] = old
            out[b] = f(out[b], new)
            return out

        with np.errstate(invalid="ignore"):
            self.rows, self.values = scatter(self.rows, rows, 0, np.add), scatter(self.values, values, 0, np.add)
            self.sum = scatter(self.sum, total, 0.0, np.add)
            self.min, self.max = scatter(self.min, low, np.inf, np.minimum), scatter(self.max, high, -np.inf, np.maximum)
        self.keys = both

    def table(self, block: int, null: bool, part: int, at) -> pa.Table:
        """The entries `at` as one row of arrays."""
        i, f = pa.list_(pa.int64()), pa.list_(pa.float64())
        return pa.table({
            "_block": pa.array([block], pa.int32()), "_null": pa.array([null]), "_part": pa.array([part], pa.int64()), "_keys": pa.array([self.keys[at]], i),
            "_rows": pa.array([self.rows[at]], i), "_values": pa.array([self.values[at]], i), "_sum": pa.array([self.sum[at]], f), "_min": pa.array([self.min[at]], f),
            "_max": pa.array([self.max[at]], f),
        })

    def add(self, keys: np.ndarray, values: np.ndarray, known: np.ndarray) -> None:
        """Encodes the rows' keys, adds up by code with bincount. known: which rows have a value."""
        if not len(keys):
            return
        own, code = np.unique(keys, return_inverse=True)
        n = len(own)
        c, v = code[known], values[known]
        order = np.argsort(c, kind="stable")
        c2, v2 = c[order], v[order]
        low, high = np.full(n, np.inf), np.full(n, -np.inf)
        if len(c2):
            at = np.flatnonzero(np.r_[True, c2[1:] != c2[:-1]])
            low[c2[at]], high[c2[at]] = np.minimum.reduceat(v2, at), np.maximum.reduceat(v2, at)
        self.merge(own, np.bincount(code, minlength=n), np.bincount(c, minlength=n), np.bincount(c, weights=v, minlength=n), low, high)


def _some(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Batches, BATCH_ROWS or more rows at once, as the dictionary is gone through for each."""
    held, n = [], 0
    for b in batches:
        held.append(b)
        n += b.num_rows
        if n >= BATCH_ROWS:
            yield pa.Table.from_batches(held)
            held, n = [], 0
    if held:
        yield pa.Table.from_batches(held)


def _split(batches: Iterator[pa.RecordBatch], blocks: int) -> Iterator[pa.RecordBatch]:
    """Of one input split: an accumulator block for each block of keys that occurs in it."""
    task = TaskContext.get()
    part = task.partitionId() if task else 0
    acc, null = _Accumulators(), _Accumulators()
    for b in _some(batches):
        ids, val = b.column(0), b.column(1)
        known = np.asarray(val.is_valid()).astype(bool)
        v = np.asarray(val.fill_null(0.0), dtype=np.float64)
        known &= ~np.isnan(v)
        has = np.asarray(ids.is_valid()).astype(bool)
        k = np.asarray(ids.fill_null(0), dtype=np.int64)
        acc.add(k[has], v[has], known[has])
        null.add(k[~has], v[~has], known[~has])
    for one, is_null in ((acc, False), (null, True)):
        if not len(one.keys):
            continue
        block = (one.keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)).astype(np.int64) % blocks
        order = np.argsort(block, kind="stable")
        first = np.flatnonzero(np.diff(block[order], prepend=-1))
        for a, z in zip(first, [*first[1:], len(order)]):
            yield from one.table(int(block[order[a]]), is_null, part, order[a:z]).to_batches()


def _added(table: pa.Table) -> _Accumulators:
    acc = _Accumulators()
    for i in range(table.num_rows):
        acc.merge(*(np.asarray(table.column(c)[i].values) for c in ("_keys", "_rows", "_values", "_sum", "_min", "_max")))
    return acc


def _combine(table: pa.Table) -> pa.Table:
    """One array block from up to FAN_IN of them."""
    acc = _added(table)
    return acc.table(table.column("_block")[0].as_py(), table.column("_null")[0].as_py(), table.column("_part")[0].as_py(), slice(None))


def _finish(table: pa.Table) -> pa.Table:
    acc = _added(table)
    none = acc.values == 0
    keys = pa.nulls(len(acc.keys), pa.int64()) if table.column("_null")[0].as_py() else pa.array(acc.keys)
    return pa.table({
        "id": keys, "n_rows": acc.rows, "n_values": acc.values, "total": pa.array(acc.sum, mask=none),
        "min_value": pa.array(acc.min, mask=none), "max_value": pa.array(acc.max, mask=none),
    })


def _levels(rows: DataFrame) -> int:
    """How often arrays are added up: once for up to FAN_IN input splits, twice for up to its square, and so on. Splits are estimated
    from the planner's size of the input."""
    size = int(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    each = rows.sparkSession._jsparkSession.sessionState().conf().filesMaxPartitionBytes()
    return max(1, min(4, math.ceil(math.log(max(2, size / each), FAN_IN))))


def totals_by_key(rows: DataFrame, key: str = "id", value: str = "value", blocks: int | None = None, levels: int | None = None) -> DataFrame:
    """For each key (long): n_rows, n_values, total, min_value, max_value, without a task that gets a
    large key's rows.

    Every input split is the same work whatever its keys: its keys are dictionary-encoded and its rows
    added up by code with bincount into dense arrays. Only these arrays, one entry for each key that a
    split holds, are exchanged, in `blocks` blocks of keys (as many as
    there are shuffle partitions, if not given), and added up block by block, in `levels` levels if there are more splits than one task should
    add up. A key
    with a third of all rows is one array entry of each split.

    All rows count in n_rows; null and NaN values count in nothing else (total, min and max are null
    without any value). A null key is a key of its own. An empty table gives no rows.
    """
    few = rows.select(F.col(key).cast("long").alias("id"), F.col(value).cast("double").alias("value"))
    n = blocks or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = few.mapInArrow(lambda b: _split(b, n), _PARTIAL)
    for _ in range((levels or _levels(few)) - 1):
        parts = parts.withColumn("_part", F.call_function("div", "_part", F.lit(FAN_IN).cast("long"))).groupBy("_block", "_null", "_part").applyInArrow(_combine, _PARTIAL)
    return parts.groupBy("_block", "_null").applyInArrow(_finish, _RESULT)
