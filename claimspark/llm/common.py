"""What the training-data operators share: places for written tables, folds, Arrow helpers."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_own_dir: dict[str, str] = {}


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new folder under spark.checkpoint.dir."""
    return f"{shared_base(spark)}/{name}-{uuid.uuid4().hex}"


def shared_base(spark: SparkSession) -> str:
    """spark.checkpoint.dir; a temporary folder only where that is unset and all runs on one machine."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        app = spark.sparkContext.applicationId
        if app not in _own_dir:
            _own_dir[app] = tempfile.mkdtemp(prefix="claimspark-")
        base = _own_dir[app]
    return base.rstrip("/")


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Cuts lineage: writes df as a Parquet table in the shared folder and reads it again."""
    path = shared_dir(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_crc(id_col: str) -> Column:
    """crc32 of the id as text; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary"))


def map_batches(
    df: DataFrame,
    fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]],
    schema: str,
) -> DataFrame:
    return df.mapInArrow(fn, schema)


def slices(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """Cuts Arrow batches into small ones, so that few texts are Python objects at a time."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)
