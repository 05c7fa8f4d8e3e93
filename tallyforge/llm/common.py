"""Shared helpers of the training-data operators."""

from __future__ import annotations

import contextlib
import re
import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: The six separators of the word pattern [^\x20\x09-\x0D]+; bytes.split() cuts at exactly these.
SEPARATORS = " \t\n\x0b\x0c\r"


def shared_dir(spark: SparkSession) -> str:
    """Folder that driver and executors share: spark.checkpoint.dir, or one of our own where it is unset and the master is local."""
    place = spark.conf.get("spark.checkpoint.dir", None)
    if not place:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        place = getattr(shared_dir, "own", None) or tempfile.mkdtemp(prefix="tallyforge-")
        shared_dir.own = place
    return f"{place.rstrip('/')}/tallyforge-{spark.sparkContext.applicationId}"


def new_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def hadoop_path(spark: SparkSession, path: str):
    """(file system, path) of the JVM for a URI, on the driver."""
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jpath.getFileSystem(spark._jsc.hadoopConfiguration()), jpath


def remove_path(spark: SparkSession, path: str) -> None:
    fs, jpath = hadoop_path(spark, path)
    fs.delete(jpath, True)


@contextlib.contextmanager
def shuffles_removed(spark: SparkSession):
    """Shuffle files go when the query that made them has ended, and not only when the driver collects its garbage."""
    with settings(spark, {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}):
        yield


@contextlib.contextmanager
def settings(spark: SparkSession, values: dict[str, str]):
    """Session settings for the queries within, and what they were before after them."""
    before = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def small_batches(spark: SparkSession, rows: int = 1000):
    """Batches of few rows to Python, each of which stands in the JVM, on the way and in the worker at once."""
    return settings(spark, {"spark.sql.execution.arrow.maxRecordsPerBatch": str(rows)})


def materialise(df: DataFrame, label: str, rows: int = 1000) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: lineage ends here, and a lost executor costs no recomputation."""
    spark, schema = df.sparkSession, df.schema
    path = new_path(spark, label)
    with shuffles_removed(spark), small_batches(spark, rows):
        df.write.parquet(path)
    out = spark.read.schema(schema).parquet(path)
    out.stored_at = path
    return out


def bucketed(dfs: Sequence[DataFrame], key: str, buckets: int, label: str) -> DataFrame:
    """materialise() of frames one after another into one table, in buckets by a column: joins by it then read it where it
    lies. Each should be dealt by the key into as many partitions, so that it makes one file of each bucket."""
    spark, path = dfs[0].sparkSession, new_path(dfs[0].sparkSession, label)
    name = f"{label}_{uuid.uuid4().hex}"
    with shuffles_removed(spark), small_batches(spark):
        for df in dfs:
            df.write.mode("append").bucketBy(buckets, key).sortBy(key).option("path", path).saveAsTable(name)
    out = spark.table(name)
    out.stored_at, out.stored_as = path, name
    return out


def forget(df: DataFrame) -> None:
    """Remove the files of a materialised or bucketed frame that nothing reads any more."""
    if name := getattr(df, "stored_as", None):
        df.sparkSession.sql(f"DROP TABLE IF EXISTS {name}")
    remove_path(df.sparkSession, df.stored_at)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rank_within(df: DataFrame, keys: Sequence[str], order: Sequence[str], name: str, buckets: int | None = None) -> DataFrame:
    """Add a gapless 0-based rank within `keys` (not null), without putting a hot key into one task.

    Rows of a key are dealt into `buckets` by a hash of the order columns (one for 100,000 rows, 256 at the least); each
    bucket is numbered by itself, and starts where the counts of the buckets before it end. df is read several times, so
    it should be materialised.
    """
    buckets = buckets or max(256, df.count() // 100_000)
    dealt = df.withColumn("__bucket", F.pmod(F.xxhash64(*order), F.lit(buckets)).cast("int"))
    before = Window.partitionBy(*keys).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = dealt.groupBy(*keys, "__bucket").agg(F.count("*").alias("__n")).withColumn("__start", F.coalesce(F.sum("__n").over(before), F.lit(0))).drop("__n")
    own = Window.partitionBy(*keys, "__bucket").orderBy(*order)
    return dealt.withColumn("__own", F.row_number().over(own)).join(starts, [*keys, "__bucket"]).withColumn(name, (F.col("__start") + F.col("__own") - 1).cast("long")).drop("__bucket", "__own", "__start")


def third(id_col: str = "doc_id"):
    """crc32 of the id as text, modulo 3; 1 marks held-out rows. A null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")), F.lit(3))


def broadcast_if_small(df: DataFrame, max_rows: int) -> DataFrame:
    """Broadcast hint only where a count proves the bound; else a shuffle join. df should be cheap to count."""
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df


def keyed(docs: DataFrame) -> DataFrame:
    """(doc_id, text_key, text): what tells a row of documents from others, also from those that share its doc_id or lack one."""
    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("text_key"), text.alias("text"))


def without_rows(docs: DataFrame, gone: DataFrame, broadcast_rows: int = 1_000_000) -> DataFrame:
    """docs without the rows that gone (doc_id, text_key) names, null ids included; rows equal in doc_id and text go together.

    The keys are written first and go by broadcast if they are no more than `broadcast_rows`, so that the texts stay where
    they are; else both sides are shuffled.
    """
    gone = materialise(gone.select("doc_id", "text_key").distinct().toDF("__gone", "__gone_text"), "gone")
    side = F.broadcast(gone) if gone.count() <= broadcast_rows else gone
    same = docs["doc_id"].cast("long").eqNullSafe(side["__gone"]) & (F.xxhash64(docs["text"].cast("string")) == side["__gone_text"])
    return docs.join(side, same, "left_anti")


def per_worker(key: tuple, make):
    """What make() gives, kept for later tasks of the same Python worker: for read-only things that take long to load."""
    import sys
    import types

    kept = sys.modules.setdefault("_tallyforge_worker", types.ModuleType("_tallyforge_worker")).__dict__
    if key not in kept:
        kept[key] = make()
    return kept[key]


def release_memory() -> None:
    """Give freed memory of this Python worker back to the system at a task's end: workers stay for later tasks, side by side with the JVM."""
    import ctypes
    import gc

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass
