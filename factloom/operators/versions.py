"""Append-only versions of a table in a folder: saved whole, never changed, loaded by number, replayed up to a number."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


class Versions:
    """The versions in a folder that driver and executors share; one writer at a time."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")

    def _named(self) -> dict[int, bool]:
        """Every number that was begun, and whether its version was saved whole."""
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        folder = path(self.path)
        store = folder.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        if not store.exists(folder):
            return {}
        named = [f.getPath() for f in store.listStatus(folder) if f.getPath().getName().startswith("version=")]
        return {int(p.getName().split("=")[1]): store.exists(path(p, "_SUCCESS")) for p in named}

    def numbers(self) -> list[int]:
        """The numbers of the versions that were saved whole, ascending."""
        return sorted(n for n, whole in self._named().items() if whole)

    def save(self, rows: DataFrame) -> int:
        """Write rows as the next version and return its number; an existing version is never written again."""
        number = max(self._named(), default=0) + 1  # one that was begun and never finished keeps its number
        rows.write.mode("error").parquet(f"{self.path}/version={number}")
        return number

    def load(self, number: int | None = None) -> DataFrame:
        """The rows of a version, by default the latest, with its number."""
        held = self.numbers()
        if not held or number not in (None, *held):
            raise LookupError(f"version {number or 'latest'} is not in {self.path}")
        number = number or held[-1]
        return self.spark.read.parquet(f"{self.path}/version={number}").withColumn("version", F.lit(number))

    def every(self, upto: int | None = None) -> DataFrame:
        """The rows of all versions up to a number, with the numbers of theirs."""
        held = [n for n in self.numbers() if upto is None or n <= upto]
        if not held:
            raise LookupError(f"no version up to {upto} is in {self.path}")
        read = [f"{self.path}/version={n}" for n in held]
        return self.spark.read.option("basePath", self.path).parquet(*read)

    def replay(self, keys: list[str], upto: int | None = None) -> DataFrame:
        """The last row of each key in the versions up to a number: what the table was then, whatever came later."""
        newest = Window.partitionBy(*keys).orderBy(F.desc("version"))
        return self.every(upto).withColumn("_nth", F.row_number().over(newest)).where("_nth = 1").drop("_nth")
