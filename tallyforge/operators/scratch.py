"""Where intermediate tables go: the folder that the cluster names, shared by driver and executors."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or where it is unset and the master local, a folder of this session's own."""
    place = spark.conf.get("spark.checkpoint.dir", None)
    if not place:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        place = getattr(shared_folder, "own", None) or tempfile.mkdtemp(prefix="tallyforge-")
        shared_folder.own = place
    return place.rstrip("/")


def scratch(spark: SparkSession, label: str) -> str:
    """A path in the shared folder that nothing has yet."""
    return f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"


def dealt(df: DataFrame, keys: list[str], rows: int, each: int = 250_000) -> DataFrame:
    """df, of about so many rows, dealt by keys into partitions of about `each` rows: what a task holds doesn't grow with the table."""
    return df.repartition(max(1, -(-rows // each)), *keys)


def stored(df: DataFrame) -> DataFrame:
    """df written as Parquet in the shared folder and read back, which ends its lineage."""
    path = scratch(df.sparkSession, "step")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
