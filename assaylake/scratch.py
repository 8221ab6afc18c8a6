"""Tables written to the shared folder between steps, and the package on the workers."""

from __future__ import annotations

import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_shipped: set[str] = set()

#: How many times their files' size rows may be in memory: sorted ids take a byte in a compressed file, and some sixty in a join's hash table.
EXPANSION = 64


def expanded(spark: SparkSession) -> SparkSession:
    """Let the planner count files at EXPANSION times their size, unless the session has a factor of its own; the session keeps the setting.

    Else it broadcasts millions of rows through the driver because their files are small.
    """
    if float(spark.conf.get("spark.sql.sources.fileCompressionFactor")) == 1:
        spark.conf.set("spark.sql.sources.fileCompressionFactor", str(EXPANSION))
    return spark


#: Parquet's defaults hold a hundred rows before they look at their size, and give up a dictionary at 1 MB: with rows of a megabyte a writer needs hundreds.
#: A page of several rows shows that their texts repeat, else the dictionary is given up at the first.
LONG_ROWS = {"parquet.page.size.row.check.min": 16, "parquet.block.size.row.check.min": 16, "parquet.dictionary.page.size": 64 << 20}


def long_rows(spark: SparkSession) -> None:
    """Let Parquet writers take rows of megabytes that repeat their texts, unless the session has settings of its own; the session keeps these."""
    for key, value in LONG_ROWS.items():
        if spark.conf.get(key, None) is None:
            spark.conf.set(key, str(value))


def scratch(spark: SparkSession) -> str:
    """A new folder name below spark.checkpoint.dir, which all executors share; where that is unset, a temporary one in local mode and an error on a cluster."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="assaylake-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/assaylake-{uuid.uuid4().hex}"


def saved(df: DataFrame, compression: str = "zstd") -> DataFrame:
    """Write to the shared folder and read back: cuts the lineage, and survives the loss of any executor."""
    path = scratch(df.sparkSession)
    df.write.option("compression", compression).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, *keys: str | int) -> DataFrame:
    """Write to the shared folder in buckets of the keys; later joins and groupings by exactly these keys need no exchange.

    As in DataFrame.repartition(), the number of buckets may come first; else there are as many as shuffles have partitions. Tables
    that are joined should have the same number. The files lie below spark.checkpoint.dir; the session's catalogue gets a table name for them.
    """
    n, keys = _numbered(df, keys)
    return in_buckets(df.repartition(n, *keys), n, *keys)


def in_buckets(df: DataFrame, *keys: str | int) -> DataFrame:
    """Like bucketed(), but every task writes its own rows to files of their buckets: no exchange, and as many files a task as it has buckets."""
    spark = df.sparkSession
    n, keys = _numbered(df, keys)
    path = scratch(spark)
    name = path.rsplit("/", 1)[1].replace("-", "_")
    df.write.bucketBy(n, *keys).sortBy(*keys).format("parquet").option("compression", "zstd").option("path", path).saveAsTable(name)
    return spark.table(name)


def _numbered(df: DataFrame, keys: tuple) -> tuple[int, tuple]:
    given = isinstance(keys[0], int)
    return (keys[0], keys[1:]) if given else (int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), keys)


def ship(spark: SparkSession) -> None:
    """Give the workers this package, wherever they run; once an application."""
    app = spark.sparkContext.applicationId
    if app not in _shipped:
        _shipped.add(app)
        root = Path(__file__).resolve().parent
        target = shutil.make_archive(f"{tempfile.mkdtemp(prefix='assaylake-')}/{root.name}", "zip", root.parent, root.name)
        spark.sparkContext.addPyFile(target)
