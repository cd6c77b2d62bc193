"""Row predicates as Columns."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidewell.types import clamp_time


def in_flag(mask: int, flag: Column | str = "flag") -> Column:
    """All bits of mask are set; 0 passes every flag. A null flag passes 0 only."""
    f = F.col(flag) if isinstance(flag, str) else flag
    if not mask:
        return F.lit(True)
    return F.coalesce(f.bitwiseAND(F.lit(mask).cast("long")) == F.lit(mask).cast("long"), F.lit(False))


def in_ids(ids: Iterable[int]) -> Column:
    """Membership; no ids pass every row."""
    ids = list(ids)
    return F.col("id").isin(ids) if ids else F.lit(True)


def in_interval(start: int, end: int) -> Column:
    """start <= time <= end."""
    return F.col("time").between(clamp_time(start), clamp_time(end))


def in_query(ids: Iterable[int] = (), mask: int = 0, start: int | None = None, end: int | None = None) -> Column:
    out = in_flag(mask) & in_ids(ids)
    return out & in_interval(start, end) if start is not None and end is not None else out


def overlaps(a_from: Column, a_to: Column, b_from: Column, b_to: Column) -> Column:
    """Closed intervals share a point."""
    return (a_from <= b_to) & (b_from <= a_to)


def subscribed(ids: Iterable[int] = (), flag: int = 0) -> Column:
    """Of a subscription: any of ids (none: all), and the very flag (0: any). Not a mask."""
    return in_ids(ids) & (F.col("flag").eqNullSafe(F.lit(flag).cast("long")) if flag else F.lit(True))


def add_flag(flag: int) -> Column:
    return F.coalesce("flag", F.lit(0).cast("long")).bitwiseOR(F.lit(flag).cast("long"))
