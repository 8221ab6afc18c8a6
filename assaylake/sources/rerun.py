"""A sink for stages that may run again: their rows replace what the same scope held, also where a rerun gives none."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MARK = "_swap.json"


def _files(spark: SparkSession, path: str):
    """Hadoop's file system of a path, so that any store works, and a maker of its paths."""
    jvm = spark._jvm
    make = lambda *parts: jvm.org.apache.hadoop.fs.Path("/".join(parts))
    return make(path).getFileSystem(spark._jsc.hadoopConfiguration()), make


def _folder(spark: SparkSession, keys: list[str], values) -> str:
    name = spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.getPartitionPathString
    return "/".join(name(k, None if v is None else str(v)) for k, v in zip(keys, values, strict=True))


def _swap(spark: SparkSession, path: str, staged: str) -> None:
    """Move the staged partitions in and delete the listed ones without rows. Done again after an interruption, it ends in the same state."""
    fs, at = _files(spark, path)
    stream = fs.open(at(staged, MARK))
    try:
        plan = json.loads(spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    finally:
        stream.close()
    for part in plan["empty"]:
        fs.delete(at(path, part), True)
    for part in plan["filled"]:
        if fs.exists(at(staged, part)):  # else it was moved before the interruption
            fs.delete(at(path, part), True)
            target = at(path, part)
            fs.mkdirs(target.getParent())
            if not fs.rename(at(staged, part), target):
                raise OSError(f"could not move {part}")
    fs.delete(at(staged), True)


def finish_swaps(spark: SparkSession, path: str) -> None:
    """End what an interrupted replace_scope() began: marked stagings are swapped in, unmarked ones, whose write failed, are deleted."""
    fs, at = _files(spark, path)
    if not fs.exists(at(path)):
        return
    for status in fs.listStatus(at(path)):
        name = status.getPath().getName()
        if name.startswith("_staged-"):
            staged = f"{path}/{name}"
            if fs.exists(at(staged, MARK)):
                _swap(spark, path, staged)
            else:
                fs.delete(at(staged), True)


def replace_scope(df: DataFrame, path: str, keys: list[str], scope: list[tuple]) -> None:
    """Replace the partitions in ``scope`` (values of the keys, such as project and stage) by the frame's rows.

    A partition of the scope without rows is deleted, one outside stays as it is; rows outside the scope are an error. All
    new files are written beside the old ones first, so that a failed write leaves the old rows. Then a mark is set and the
    listed partitions are swapped one by one; finish_swaps(), which every call begins with, ends a swap that was
    interrupted. One writer at a time; readers between two swaps see some partitions new and some old. The scope is a list of
    the run's partitions and is held by the driver.
    """
    spark, path = df.sparkSession, path.rstrip("/")
    finish_swaps(spark, path)
    wanted = list(dict.fromkeys(tuple(v) for v in scope))
    staged = f"{path}/_staged-{uuid.uuid4().hex}"
    inside = F.lit(False)
    for values in wanted:
        one = F.lit(True)
        for k, v in zip(keys, values, strict=True):
            one &= F.col(k).eqNullSafe(F.lit(v))
        inside |= one
    checked = F.when(inside, F.lit(True)).otherwise(F.raise_error(F.concat(F.lit("a row outside the scope: "), F.to_json(F.struct(*keys)))).cast("boolean"))
    df.filter(checked).repartition(*keys).write.partitionBy(*keys).parquet(staged)
    fs, at = _files(spark, path)
    parts = [_folder(spark, keys, v) for v in wanted]
    filled = [p for p in parts if fs.exists(at(staged, p))]
    out = fs.create(at(staged, MARK), True)
    try:
        out.write(bytearray(json.dumps({"filled": filled, "empty": [p for p in parts if p not in filled]}).encode()))
    finally:
        out.close()
    _swap(spark, path, staged)
