import glob
import os
import tempfile

import pytest
from pyspark.sql import functions as F

from sigloom.sources import slices as SL

SCHEMA = "symbol string, day string, market string, value double"


@pytest.fixture
def folder():
    return tempfile.mkdtemp(prefix="spark-", dir="/tmp") + "/table"


def table(spark, folder):
    return {(r["symbol"], r["day"], r["market"]): r["value"] for r in SL.read_slices(spark, folder, SCHEMA).collect()}


def files(folder):
    return {p: os.stat(p).st_mtime_ns for p in glob.glob(folder + "/**/*.parquet", recursive=True)}


def test_an_upsert_of_one_day_leaves_all_other_files(spark, folder):
    rows = [(s, d, m, 1.0) for s in "AB" for d in ("d1", "d2", "d/3") for m in ("us", None)]
    assert table(spark, folder) == {}
    SL.upsert_slices(spark.createDataFrame(rows, SCHEMA), folder, ["symbol", "day", "market"], ["day", "market"])
    before, first = files(folder), table(spark, folder)
    assert len(first) == 12
    SL.upsert_slices(spark.createDataFrame([("A", "d2", "us", 7.0), ("Z", "d2", "us", None), ("Z", "d2", "us", 3.0)], SCHEMA), folder, ["symbol", "day", "market"], ["day", "market"])
    assert table(spark, folder) == first | {("A", "d2", "us"): 7.0, ("Z", "d2", "us"): 3.0}
    after = files(folder)
    assert all(after[p] == t for p, t in before.items())
    used = {os.path.dirname(p).removeprefix(folder + "/") for p in before}
    assert len(SL.superseded(spark, folder)) == 1 and SL.superseded(spark, folder)[0] in used
    SL.replace_slices(spark.createDataFrame([("Q", "d/3", None, 9.0)], SCHEMA), folder, ["day", "market"])
    left = table(spark, folder)
    assert left[("Q", "d/3", None)] == 9.0 and len([k for k in left if k[1:] == ("d/3", None)]) == 1
    assert len(left) == 12  # 13 rows, of which the slice's two gave way to one
    SL.replace_slices(spark.createDataFrame([], SCHEMA), folder, ["day", "market"])
    assert table(spark, folder) == left


def test_a_write_that_dies_leaves_the_old_state(spark, folder):
    old = spark.createDataFrame([("A", "d1", "us", 1.0)], SCHEMA)
    SL.replace_slices(old, folder, ["day"])
    broken = spark.range(4).select(
        F.lit("B").alias("symbol"), F.lit("d1").alias("day"), F.lit("us").alias("market"),
        F.when(F.col("id") < 3, 2.0).otherwise(F.raise_error(F.lit("killed")).cast("double")).alias("value"),
    )
    with pytest.raises(Exception, match="killed"):
        SL.replace_slices(broken, folder, ["day"])
    assert table(spark, folder) == {("A", "d1", "us"): 1.0}


def test_of_two_writes_at_once_one_is_refused(spark, folder, monkeypatch):
    SL.replace_slices(spark.createDataFrame([("A", "d1", "us", 1.0)], SCHEMA), folder, ["day"])
    seen = SL.current(spark, folder)
    SL.replace_slices(spark.createDataFrame([("B", "d2", "us", 2.0)], SCHEMA), folder, ["day"])
    monkeypatch.setattr(SL, "current", lambda *a: seen)
    with pytest.raises(RuntimeError, match="came first"):
        SL.replace_slices(spark.createDataFrame([("C", "d3", "us", 3.0)], SCHEMA), folder, ["day"])
    monkeypatch.undo()
    assert {k[0] for k in table(spark, folder)} == {"A", "B"}


def test_reading_one_slice_opens_no_other_file(spark, folder):
    rows = [("A", f"d{i}", "us", float(i)) for i in range(5)]
    SL.replace_slices(spark.createDataFrame(rows, SCHEMA), folder, ["day"])
    name = spark.createDataFrame([("d3",)], "day string").select(SL.slice_path(["day"])).first()[0]
    one = SL.read_slices(spark, folder, SCHEMA, [name])
    assert [r["value"] for r in one.collect()] == [3.0] and len(one.inputFiles()) == 1
    with pytest.raises(ValueError):
        SL.upsert_slices(one, folder, ["symbol"], ["day"])
