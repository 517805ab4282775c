"""The folder that driver and executors share, the check before a broadcast, and small tables of fixed rows."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset, in local mode alone, a folder of our own."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        known = spark.sparkContext._jsc.sc().getCheckpointDir()
        found = known.get() if known.isDefined() else None
    if not found:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="spark-shared-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def written(df: DataFrame) -> DataFrame:
    """df written once to the shared folder and read back: later readers neither recompute it nor lose it with an executor."""
    path = f"{shared_dir(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Most rows of a table that may be broadcast once it has been counted.
BROADCAST_ROWS = 200_000


def checked(small: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """small, to be broadcast if it has been counted to have no more than ``limit`` rows; else as it is."""
    return F.broadcast(small) if small.limit(limit + 1).count() <= limit else small


def fixed_rows(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A few rows as a table that is part of the plan.

    Made from a list, it would be a job of Python workers wherever it is read, who keep their memory beside those of the
    query's own functions; from Arrow, the driver's JVM has the rows.
    """
    import pyarrow as pa

    kind = StructType.fromDDL(schema)
    return spark.createDataFrame(pa.Table.from_pylist([dict(zip(kind.names, r)) for r in rows], to_arrow_schema(kind)), kind)
