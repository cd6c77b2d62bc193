"""The catalogue of named series."""

from __future__ import annotations

import json
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.functions.timeutil import interval_rank
from tidewell.plans.folder import Folder
from tidewell.types import INTERVALS, MAX_ID, SCHEME_SCHEMA

# Names of functions as they stand in series names (their case matters).
NAME_FUNCTIONS = ("average", "median", "percentile90", "percentile99", "sigma", "minimum", "maximum", "count")
NAME_INTERVALS = ("raw", *INTERVALS)


def tokens(name: Column | str) -> Column:
    """The parts of a dotted name, without empty ones."""
    n = F.col(name) if isinstance(name, str) else name
    return F.filter(F.split(n, r"\."), lambda x: x != "")


def interval_of(name: Column | str) -> Column:
    """The last token if the name has at least two and it is raw or a period; else null."""
    t = tokens(name)
    return F.when((F.size(t) >= 2) & F.element_at(t, -1).isin(*NAME_INTERVALS), F.element_at(t, -1))


def function_of(name: Column | str) -> Column:
    """The last token but one if the name has at least three and it is a function; else null."""
    t = tokens(name)
    return F.when((F.size(t) >= 3) & F.get(t, F.size(t) - 2).isin(*NAME_FUNCTIONS), F.get(t, F.size(t) - 2))


def prefix_of(name: Column | str) -> Column:
    """What stands before the interval: the name without its last token; null if the name has no interval."""
    n = F.col(name) if isinstance(name, str) else name
    return F.when(interval_of(n).isNotNull(), F.regexp_extract(n, r"^((?:.*\.)?)[^.]+\.*$", 1))


def describe(names: DataFrame) -> DataFrame:
    """id, name, interval, aggregation_func, prefix of rows (id, name)."""
    return names.select("id", "name", interval_of("name").alias("interval"), function_of("name").alias("aggregation_func"), prefix_of("name").alias("prefix"))


def ids_for(names: DataFrame, scheme: DataFrame) -> DataFrame:
    """name, id for each row of names; an unknown name has the largest id."""
    return names.join(scheme.select("name", "id"), "name", "left").select("name", F.coalesce("id", F.lit(MAX_ID).cast("long")).alias("id"))


def descriptions_for(ids: DataFrame, scheme: DataFrame) -> DataFrame:
    """id, name, interval, aggregation_func for each row of ids; an unknown id is given as the largest one without a name."""
    own = scheme.select("id", "name", "interval", "aggregation_func", F.lit(True).alias("_known"))
    return ids.select("id").join(own, "id", "left").select(
        F.when(F.col("_known"), F.col("id")).otherwise(F.lit(MAX_ID).cast("long")).alias("id"), "name", "interval", "aggregation_func")


def of_interval(scheme: DataFrame, interval: str) -> DataFrame:
    return scheme.where(F.col("interval") == interval)


def linked(scheme: DataFrame) -> DataFrame:
    """src_id, src_interval, dst_id, dst_interval, dst_func: for each series those of the next coarser interval that the scheme has
    whose prefix begins with the series' own. Series without an interval have none.

    A prefix ends with a dot, so it begins with another one exactly if that is among its own token-wise beginnings: the beginnings
    of the coarser series' prefixes are spread and joined by equality.
    """
    d = scheme.select("id", "name", F.col("interval"), F.col("aggregation_func").alias("func")).where(F.col("interval").isin(*NAME_INTERVALS))
    d = d.withColumns({"prefix": prefix_of("name"), "rank": interval_rank(F.col("interval"))}).where(F.col("prefix").isNotNull())
    steps = d.select("rank").distinct().agg(F.sort_array(F.collect_set("rank")).alias("r"))  # at most eight numbers
    chain = steps.select(F.explode(F.expr("transform(sequence(1, greatest(size(r) - 1, 1)), i -> struct(r[i - 1] AS rank, get(r, i) AS next))")).alias("s")).select("s.*")
    src = d.join(F.broadcast(chain), "rank").where(F.col("next").isNotNull()).select(F.col("id").alias("src_id"), F.col("interval").alias("src_interval"), F.col("next").alias("rank"), F.col("prefix").alias("beginning"))
    parts = F.split("prefix", r"\.")
    spread = d.select(F.col("id").alias("dst_id"), F.col("interval").alias("dst_interval"), F.col("func").alias("dst_func"), "rank",
                      F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.concat(F.array_join(F.slice(parts, 1, k), "."), F.lit(".")))).alias("beginning"))
    spread = spread.where(F.length("beginning") > 0).unionByName(
        d.select(F.col("id").alias("dst_id"), F.col("interval").alias("dst_interval"), F.col("func").alias("dst_func"), "rank", F.lit("").alias("beginning"))).distinct()
    return src.join(spread, ["rank", "beginning"]).select("src_id", "src_interval", "dst_id", "dst_interval", "dst_func")


def route(ids: DataFrame, scheme: DataFrame, shards: DataFrame) -> DataFrame:
    """id, alias of the shard of each id: the shard that lists it, else that of its interval (made on demand), else the default one.
    Of several shards that list an id the first alias counts."""
    listed = shards.where(F.col("id").isNotNull()).groupBy("id").agg(F.min("alias").alias("alias"))
    by_interval = scheme.select("id", "interval").where(F.col("interval").isNotNull())
    return (ids.select("id").join(listed, "id", "left").join(by_interval, "id", "left")
            .select("id", F.coalesce("alias", "interval", F.lit("default")).alias("alias")))


class SchemeCatalog:
    """Names to ids, kept in a JSON file: adding a name is idempotent, ids are never used again."""

    FILE = "scheme.js"

    def __init__(self, spark: SparkSession, folder: Folder | None = None) -> None:
        self.spark, self.folder = spark, folder
        self._ids: dict[str, int] = {}
        self._next = 0
        if folder and folder.exists(self.FILE):
            for p in json.loads(folder.read(self.FILE))["params"]:
                self._ids[p["name"]] = p["id"]
            self._next = max(self._ids.values(), default=-1) + 1

    def add(self, name: str) -> int:
        if name not in self._ids:
            self._ids[name] = self._next
            self._next += 1
        return self._ids[name]

    def add_all(self, names: Iterable[str]) -> dict[str, int]:
        return {n: self.add(n) for n in names}

    def id_of(self, name: str) -> int:
        return self._ids.get(name, MAX_ID)

    def names(self) -> dict[str, int]:
        return dict(self._ids)

    def ls(self) -> DataFrame:
        """id, name, interval, aggregation_func of all series."""
        rows = self.spark.createDataFrame([(i, n) for n, i in self._ids.items()], "id long, name string")
        return describe(rows).select(*SCHEME_SCHEMA.fieldNames())

    def ls_interval(self, interval: str) -> DataFrame:
        return of_interval(self.ls(), interval)

    def description_for(self, series: int) -> DataFrame:
        return descriptions_for(self.spark.createDataFrame([(series,)], "id long"), self.ls())

    def linked_for(self, series: int) -> DataFrame:
        return linked(self.ls()).where(F.col("src_id") == series)

    def save(self) -> None:
        if not self.folder:
            return
        params = [{k: r[k] or "" if k != "id" else r[k] for k in SCHEME_SCHEMA.fieldNames()} for r in self.ls().collect()]
        self.folder.write(self.FILE, json.dumps({"params": params}, indent=1))
