"""One state of tables and folders: listings of files without their contents, and frames that read exactly the files that were listed."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def file_listing(spark: SparkSession, *paths: str, suffix: str = "") -> DataFrame:
    """(path, length, modified) of the files at and below the paths, but for empty ones, which Spark leaves out; no content is read. Every given path must exist."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", f"*{suffix}")
    return files.load(list(paths)).select("path", "length", F.col("modificationTime").alias("modified"))


class Snapshot:
    """The named Parquet tables below one root, as they are when this is made.

    The manifest holds each file's path, length and time, and ``id`` is its digest. All frames read the listed files, so
    that the parts of a report agree while writers add files. A listed file that is changed or gone is named by changed();
    checked() raises for it.
    """

    def __init__(self, spark: SparkSession, root: str, names: list[str]):
        self.spark, self.root, self.names = spark, root.rstrip("/"), list(names)
        self.files = self._list()
        lines = [f"{n}\0{path}\0{length}\0{modified}" for n in self.names for path, length, modified in self.files[n]]
        self.id = hashlib.sha256("\n".join(lines).encode()).hexdigest()

    def _list(self) -> dict[str, list[tuple]]:
        found: dict[str, list[tuple]] = {n: [] for n in self.names}
        for row in file_listing(self.spark, *[f"{self.root}/{n}.parquet" for n in self.names], suffix=".parquet").sort("path").collect():  # as long as Spark's own file index
            name = next(n for n in self.names if f"/{n}.parquet" in row.path[len(self.root) - 1 :] or f"/{n}.parquet" in row.path)
            found[name].append((row.path, row.length, row.modified))
        return found

    def table(self, name: str) -> DataFrame:
        paths = [path for path, _, _ in self.files[name]]
        reader = self.spark.read
        if not (len(paths) == 1 and paths[0].endswith(f"/{name}.parquet")):
            reader = reader.option("basePath", f"{self.root}/{name}.parquet")  # a folder: its partition columns stay
        return reader.parquet(*paths)

    def changed(self) -> list[str]:
        """The listed files that are gone or differ now; new files are no change."""
        now = {path: rest for files in self._list().values() for path, *rest in files}
        return [path for files in self.files.values() for path, *rest in files if now.get(path) != rest]

    def checked(self) -> Snapshot:
        if gone := self.changed():
            raise ValueError(f"{len(gone)} files of the snapshot changed, such as {gone[0]}")
        return self


def missing_artefacts(expected: DataFrame, files: DataFrame, key: str = "path") -> DataFrame:
    """The rows of ``expected`` with ``length`` and ``problem``, MISSING where there is no such file or an empty one. Paths are compared without a leading scheme."""
    plain = lambda c: F.regexp_replace(c, r"^[a-z][a-z0-9+.-]*:/+(?=/)|^file:(?=/)", "")
    known = files.select(plain(F.col("path")).alias("_path"), "length")
    joined = expected.join(known, plain(F.col(key)) == F.col("_path"), "left").drop("_path")
    return joined.withColumn("problem", F.when(F.col("length").isNull(), "MISSING"))


def read_outcomes(spark: SparkSession, expected: DataFrame, root: str, key: str = "path") -> DataFrame:
    """Outcome sidecars (outcome.json: one object with diagnosticKind and message) of the expected paths below a root.

    The rows of ``expected`` with diagnostic_kind and message: DIAGNOSTIC_MISSING where no file is, or an empty one, DIAGNOSTIC_UNREADABLE
    where it is no JSON object with a kind. NUL characters go from messages. Files are listed first; only those that are
    there are read, one row each.
    """
    plain = lambda c: F.regexp_replace(c, r"^[a-z][a-z0-9+.-]*:/+(?=/)|^file:(?=/)", "")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").load(root)
    texts = files.select(plain(F.col("path")).alias("_path"), F.decode("content", "UTF-8").alias("_text"))
    joined = expected.join(texts, plain(F.col(key)) == F.col("_path"), "left")
    parsed = F.try_parse_json("_text")
    kind, message = F.try_variant_get(parsed, "$.diagnosticKind", "string"), F.try_variant_get(parsed, "$.message", "string")
    named = F.when(F.col("_path").isNull(), "DIAGNOSTIC_MISSING").when(kind.isNull(), "DIAGNOSTIC_UNREADABLE").otherwise(kind)
    return joined.withColumns({"diagnostic_kind": named, "message": F.regexp_replace(message, r"\x00", "")}).drop("_path", "_text")
