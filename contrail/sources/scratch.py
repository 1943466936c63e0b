"""A folder that every executor sees, and tables written there."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new path under spark.checkpoint.dir. Where that is unset, a temporary folder serves executors in the driver's own process; on a
    cluster that is an error, as no executor could see it."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", base)
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


#: Folders that sessions are dealt to where each needs none of its own, and sequences of a session that one task writes.
FOLDERS, PIECE = 64, 1 << 16


def folder_of(session_id: str, folders: int | None = FOLDERS) -> Column:
    """The folder of a session: its own (None) or one of a number. A store of very many sessions wants a number: a file costs the same however little it holds."""
    return F.col(session_id).cast("string") if folders is None else F.pmod(F.xxhash64(F.col(session_id).cast("string")), F.lit(folders)).cast("string")


def kept(df: DataFrame) -> DataFrame:
    """Written once and read back: what uses it twice doesn't compute it twice, and lost executors don't either. Runs when it is called."""
    path = shared_folder(df.sparkSession, "step")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
