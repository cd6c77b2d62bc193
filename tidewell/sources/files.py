"""Files that hold series, catalogues and shard lists."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.types import DELIVERED_SCHEMA

# Fixed value: a packed row, little-endian, without a header before the first one.
PACKED = np.dtype([("id", "<u4"), ("time", "<u8"), ("value", "<f8"), ("flag", "<u4")])


def read_packed(spark: SparkSession, path: str) -> DataFrame:
    """Rows of files of packed rows: id, time, value, flag, seq, where seq is the place in the file (the earlier row of an id and time
    is the one that such a file stands for, so seq falls). Half a row at the end of a file, of an append that was broken off, is
    left out. Files are read whole, one row group of Arrow for each."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for content in b.column("content"):
                raw = content.as_buffer().to_pybytes()
                x = np.frombuffer(raw[:len(raw) // PACKED.itemsize * PACKED.itemsize], PACKED)
                yield pa.RecordBatch.from_pydict({
                    "id": x["id"].astype(np.int64), "time": x["time"].astype(np.int64), "value": x["value"].astype(np.float64),
                    "flag": x["flag"].astype(np.int64), "seq": -np.arange(len(x), dtype=np.int64),
                })

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(rows, DELIVERED_SCHEMA)


def pack_rows(rows: pd.DataFrame) -> bytes:
    """The content of such a file."""
    out = np.empty(len(rows), PACKED)
    for c in PACKED.names:
        out[c] = rows[c].to_numpy()
    return out.tobytes()


def read_scheme(spark: SparkSession, path: str) -> DataFrame:
    """id, name, interval, aggregation_func of catalogues kept as JSON; empty texts become null."""
    doc = spark.read.schema("params array<struct<id long, name string, interval string, aggregation_func string>>").option("multiLine", True).json(path)
    return doc.select(F.explode("params").alias("p")).select("p.id", "p.name", *[F.nullif(F.col(f"p.{c}"), F.lit("")).alias(c) for c in ("interval", "aggregation_func")])


def read_shards(spark: SparkSession, path: str) -> DataFrame:
    """alias, path, id of shard lists kept as JSON; a shard without ids, the default one, has a null id."""
    doc = spark.read.schema("alias string, path string, ids array<long>").option("multiLine", True).json(path)
    return doc.select("alias", "path", F.explode_outer("ids").alias("id"))


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """id, time, value, flag, seq of Parquet files; missing flag and seq are 0."""
    df = spark.read.parquet(path)
    return df.select("id", "time", "value", *[F.col(c) if c in df.columns else F.lit(0).cast("long").alias(c) for c in ("flag", "seq")])
