"""Options of a store, kept as JSON, each value as text."""

from __future__ import annotations

import json
from dataclasses import dataclass, fields

from pyspark.sql import SparkSession

from tidewell.plans.folder import Folder
from tidewell.types import DAY, HOUR, MINUTE

FILE = "Settings"
STRATEGIES = ("WAL", "COMPRESSED", "MEMORY", "CACHE", "SHARD")


@dataclass
class Settings:
    """Defaults are fixed values of the model. Sizes of buffers, files and pools are accepted; Spark sizes its own."""

    wal_file_size: int = 174_762
    wal_cache_size: int = 1_700
    chunks_per_page: int = 10_240
    chunk_size: int = 1_024
    strategy: str = "COMPRESSED"
    memory_limit: int = 104_857_600
    percent_when_start_droping: float = 0.75
    percent_to_drop: float = 0.1
    max_pages_per_level: int = 2
    threads_in_common: int = 2
    threads_in_diskio: int = 1
    lifetime_raw: int = 60 * MINUTE
    lifetime_minute: int = 2 * HOUR
    lifetime_halfhour: int = 5 * HOUR
    lifetime_hour: int = 2 * DAY
    lifetime_day: int = 3 * DAY
    lifetime_week: int = 14 * DAY
    lifetime_month: int = 62 * DAY
    raw_is_memonly: bool = False
    strategy_raw: str = "MEMORY"
    strategy_minute: str = "COMPRESSED"
    strategy_halfhour: str = "COMPRESSED"
    strategy_hour: str = "COMPRESSED"
    strategy_day: str = "COMPRESSED"
    strategy_week: str = "COMPRESSED"
    strategy_month: str = "COMPRESSED"

    def set(self, name: str, text: str) -> None:
        kind = {f.name: type(f.default) for f in fields(self)}.get(name)
        if kind is None:
            raise KeyError(f"unknown option {name!r}")
        value = text.strip().lower() in ("1", "true") if kind is bool else kind(text)
        if kind is str and value not in STRATEGIES:
            raise ValueError(f"unknown strategy {value!r}")
        setattr(self, name, value)

    def change(self, expression: str) -> None:
        """`name=value`."""
        parts = [p for p in expression.split("=") if p]
        if len(parts) != 2:
            raise ValueError("expected name=value")
        self.set(*parts)

    def dump(self) -> str:
        return json.dumps({f.name: str(getattr(self, f.name)) for f in fields(self)}, indent=1)

    def save(self, folder: Folder) -> None:
        folder.write(FILE, self.dump())

    @classmethod
    def load(cls, folder: Folder) -> Settings:
        out = cls()
        if folder.exists(FILE):
            for k, v in json.loads(folder.read(FILE)).items():
                if k in out.__dict__:
                    out.set(k, v)
        return out

    def set_default(self) -> None:
        for f in fields(self):
            setattr(self, f.name, f.default)

    def lifetime_for(self, interval: str) -> int | None:
        """ms that rows of an interval are kept; None: for ever."""
        return getattr(self, f"lifetime_{interval}", None)

    def strategy_for(self, interval: str) -> str:
        return getattr(self, f"strategy_{interval}", self.strategy)

    def apply(self, spark: SparkSession) -> None:
        """Spark's counterparts: adaptive plans, and UTC for what is shown of times."""
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        spark.conf.set("spark.sql.session.timeZone", "UTC")
