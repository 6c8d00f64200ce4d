"""Records from JSON files, with a registry's rows laid over them by id; what is no record is kept as a reject.

Files are read as Spark finds them when the query runs, so a changed file is a changed record; no copy is cached.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

BROKEN = "_broken"


def read_records(spark: SparkSession, path: str, fields: str, key: str) -> tuple[DataFrame, DataFrame]:
    """(records, rejects) of the JSON lines below a path: a record is an object with a key; rejects are line and reason.

    fields: the columns as DDL.  Of a key that stands in several lines the one of the file modified last counts, then the last by text.
    """
    schema = StructType.fromDDL(f"{fields}, {BROKEN} string")
    lines = spark.read.text(path).select("value", F.col("_metadata.file_modification_time").alias("_at")).where(F.trim("value") != "")
    read = lines.withColumn("r", F.from_json("value", schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": BROKEN}))
    reason = F.when(F.col(f"r.{BROKEN}").isNotNull() | F.col("r").isNull(), "no JSON").when(F.col(f"r.{key}").isNull(), "no key")
    judged = read.withColumn("reason", reason)
    newest = F.max_by("r", F.struct("_at", "value"))
    records = judged.where("reason IS NULL").groupBy(F.col(f"r.{key}").alias("_key")).agg(newest.alias("r")).select("r.*").drop(BROKEN)
    return records, judged.where("reason IS NOT NULL").select(F.col("value").alias("line"), "reason")


def with_registry(records: DataFrame, registry: DataFrame, key: str) -> DataFrame:
    """records with the registry's rows over them: a field that the registry states wins, one that it leaves out stays; ``origin`` says who told of the record.

    registry: some of the columns of records, one row a key; rows of keys that no file has are records as well.
    """
    over = registry.select(*[F.col(c).alias(f"_{c}") for c in registry.columns], F.lit(True).alias("_there"))
    both = records.withColumn("_own", F.lit(True)).join(over, F.col(key) == F.col(f"_{key}"), "full")
    told = [F.coalesce(F.col(f"_{c}"), F.col(c)).alias(c) if c in registry.columns else F.col(c) for c in records.columns]
    origin = F.when(F.col("_own").isNull(), "REGISTRY").when(F.col("_there").isNull(), "FILE").otherwise("BOTH")
    return both.select(*told, origin.alias("origin"))
