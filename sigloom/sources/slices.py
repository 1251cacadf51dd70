"""Stored tables in slices: a write touches the files of its own slices and is seen whole or not at all.

A table is a folder of Parquet files, a folder per write and slice in it, and
a short list of JSON files: each names, for every slice, the write that holds
it. A write adds files, then puts the next list in place by a rename. Readers
take the newest list, so a write that dies leaves the table as it was.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .tables import upsert

LISTS = "_lists"
#: What stands for a slice in a path.
SLICE = "_slice"


def slice_name(on: list[str]) -> Column:
    """A slice's name: its columns as text; null is told from every text."""
    texts = [F.coalesce(F.concat(F.lit("="), F.col(x).cast("string")), F.lit("null")) for x in on]
    return F.concat_ws("|", *texts)


def slice_path(on: list[str]) -> Column:
    """A slice's folder: hex of a hash of its name, so that no value needs escaping."""
    return F.md5(slice_name(on))


def _files(spark: SparkSession, path: str):
    jvm = spark._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    return jvm, where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def current(spark: SparkSession, folder: str) -> tuple[int, dict[str, str]]:
    """Number and content (slice → write) of the newest list; 0 and nothing before the first write. One entry per slice."""
    jvm, fs, lists = _files(spark, f"{folder}/{LISTS}")
    if not fs.exists(lists):
        return 0, {}
    names = [s.getPath().getName() for s in fs.listStatus(lists)]
    numbers = [int(n.removesuffix(".json")) for n in names if n.removesuffix(".json").isdigit()]
    if not numbers:
        return 0, {}
    rows = spark.read.text(f"{folder}/{LISTS}/{max(numbers):012d}.json", wholetext=True).collect()
    return max(numbers), json.loads(rows[0][0])


def _switch(spark: SparkSession, folder: str, after: int, content: dict[str, str]) -> None:
    """Put list ``after + 1`` in place. It is written beside the others and renamed; a rename fails if another write was first."""
    jvm, fs, draft = _files(spark, f"{folder}/{LISTS}/.draft-{uuid.uuid4().hex}")
    out = fs.create(draft, True)
    out.write(bytearray(json.dumps(content).encode()))
    out.close()
    final = jvm.org.apache.hadoop.fs.Path(f"{folder}/{LISTS}/{after + 1:012d}.json")
    if fs.exists(final) or not fs.rename(draft, final):
        fs.delete(draft, False)
        raise RuntimeError(f"another write to {folder} came first; nothing of this one is seen")


def read_slices(spark: SparkSession, folder: str, schema: str, only: list[str] | None = None) -> DataFrame:
    """The table, or only the named slices (paths as ``slice_path`` gives them): no other file is opened."""
    _, content = current(spark, folder)
    paths = [f"{folder}/{write}/{SLICE}={name}" for name, write in content.items() if only is None or name in only]
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def _write(rows: DataFrame, folder: str, on: list[str], number: int, content: dict[str, str], touched: list[str]) -> None:
    spark, write = rows.sparkSession, uuid.uuid4().hex
    rows.withColumn(SLICE, slice_path(on)).write.partitionBy(SLICE).parquet(f"{folder}/{write}")
    _switch(spark, folder, number, content | dict.fromkeys(touched, write))


def _touched(rows: DataFrame, on: list[str]) -> list[str]:
    """The slices of one write: as many as it has days (or markets and days)."""
    return [r[0] for r in rows.select(slice_path(on)).distinct().collect()]


def replace_slices(new: DataFrame, folder: str, on: list[str]) -> None:
    """The slices present in ``new`` give way to its rows; all other files stay as they are."""
    number, content = current(new.sparkSession, folder)
    if touched := _touched(new, on):
        _write(new, folder, on, number, content, touched)


def upsert_slices(new: DataFrame, folder: str, keys: list[str], on: list[str]) -> None:
    """``tables.upsert`` into a stored table; reads and writes only the slices that ``new`` has rows of.

    ``on`` is part of ``keys``, so that a key's rows are in one slice.
    """
    if not set(on) <= set(keys):
        raise ValueError("slices must follow from the key")
    spark = new.sparkSession
    number, content = current(spark, folder)
    if touched := _touched(new, on):
        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in new.schema.fields)
        old = read_slices(spark, folder, schema, touched)
        _write(upsert(old, new, keys), folder, on, number, content, touched)


def superseded(spark: SparkSession, folder: str) -> list[str]:
    """Files' folders that the newest list does not name: what a clean-up may delete once no reader is left."""
    _, content = current(spark, folder)
    jvm, fs, where = _files(spark, folder)
    used = {f"{write}/{SLICE}={name}" for name, write in content.items()}
    out = []
    for write in fs.listStatus(where):
        if write.isDirectory() and not write.getPath().getName().startswith("_"):
            for part in fs.listStatus(write.getPath()):
                name = f"{write.getPath().getName()}/{part.getPath().getName()}"
                if part.isDirectory() and name not in used and not part.getPath().getName().startswith("_temporary"):
                    out.append(name)
    return sorted(out)
