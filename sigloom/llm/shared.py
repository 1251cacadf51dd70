"""Shared helpers: tables in the cluster's shared folder, and joins that stay even when one key is hot."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: A key is hot from this share of all rows on. There can be at most HOT_PARTS hot keys, whatever the data.
HOT_PARTS = 1000
#: A key with fewer rows than this is never hot.
HOT_LEAST = 100
#: Rows of a lookup table up to which it is broadcast.
BROADCAST_ROWS = 100_000


def shared_folder(spark: SparkSession) -> str:
    """A new folder name under spark.checkpoint.dir; a temporary folder stands in only in local mode."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/sigloom-{uuid.uuid4().hex}"


def stored(df: DataFrame, partition_by: str | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lost executors replay nothing above it."""
    spark = df.sparkSession
    path = shared_folder(spark)
    writer = df.write
    if partition_by:
        writer = writer.partitionBy(partition_by)
    writer.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def discard(*tables: DataFrame | None) -> None:
    """Delete tables that ``stored`` wrote and nothing reads any more, and let Spark drop the shuffle files of plans that are gone.

    For rounds of an iteration: their tables would else stay until the cluster clears the folder.
    """
    jvm = None
    for table in tables:
        if path := getattr(table, "stored_at", None):
            jvm = table.sparkSession._jvm
            folder = jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(table.sparkSession._jsc.hadoopConfiguration()).delete(folder, True)
    if jvm:
        gc.collect()
        jvm.System.gc()


def small_join(rows: DataFrame, table: DataFrame, key: str, spread: Column, how: str = "left") -> DataFrame:
    """Join ``rows`` with a table of one row per key.

    The table is counted: up to BROADCAST_ROWS rows it is broadcast, beyond
    that the join is dealt out by key with hot keys split.
    """
    if table.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        return rows.join(F.broadcast(table), key, how)
    return split_join(rows, table, key, rows.groupBy(key).agg(F.count(F.lit(1)).alias("n")), spread, how)


def hot_keys(counts: DataFrame, key: str) -> DataFrame | None:
    """Keys with at least 1 / HOT_PARTS of all rows, and over how many tasks each is dealt; None if there are none.

    ``counts`` has ``key`` and ``n``. The counts add up to the number of rows,
    so there are at most HOT_PARTS hot keys and 2 * HOT_PARTS parts.
    """
    seen = counts.agg(F.sum("n").alias("total"), F.max("n").alias("most")).first()
    share = max((seen["total"] or 0) / HOT_PARTS, HOT_LEAST)
    if (seen["most"] or 0) < share:
        return None
    return counts.where(F.col("n") >= share).select(key, F.ceil(F.col("n") / F.lit(share)).cast("int").alias("__parts"))


def split_join(
    rows: DataFrame, table: DataFrame, key: str, counts: DataFrame | None, spread: Column, how: str = "left"
) -> DataFrame:
    """Join ``rows`` with ``table`` (one row per key); rows of a hot key go to many tasks.

    The key's row in ``table`` is repeated once for each part. ``spread`` is
    hashed to choose a row's part. A null key joins nothing. ``counts`` is None
    where there are fewer than HOT_LEAST rows.
    """
    hot = None if counts is None else hot_keys(counts, key)
    if hot is None:
        return rows.join(table, key, how)
    hot = F.broadcast(hot)
    parts = F.coalesce(F.col("__parts"), F.lit(1))
    left = rows.withColumn("__spread", spread).join(hot, key, "left")
    left = left.withColumn("__part", F.pmod(F.xxhash64("__spread"), parts).cast("int")).drop("__parts", "__spread")
    right = table.join(hot, key, "left")
    right = right.withColumn("__part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("__parts")
    return left.join(right, [key, "__part"], how).drop("__part")


def lower_ascii(c: Column) -> Column:
    """Lower-case A-Z only."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
