"""Helpers that several corpus operators use."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid
from functools import lru_cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_written: list[tuple[SparkSession, str]] = []


@lru_cache
def _own_dir(application: str) -> str:
    return tempfile.mkdtemp(prefix=f"stages-{application}-")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Where it is unset a local session (one process) gets a folder of its own; on a cluster it is refused, since
    executors would write to their own disks.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return _own_dir(spark.sparkContext.applicationId)


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write df as Parquet to the shared folder and read it back.

    This cuts the lineage in a way that survives the loss of any executor, and later branches read only the columns
    they need.  The folder is removed when the driver's process ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if not _written:
        atexit.register(_remove)
    _written.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Remove a table that materialize() wrote and that no later plan reads."""
    roots = {f.rsplit("/", 1)[0] for f in df.inputFiles()}
    for spark, path in [x for x in _written if any(r.endswith(x[1].rsplit("/", 1)[1]) for r in roots)]:
        _delete(spark, path)
        _written.remove((spark, path))


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def _remove() -> None:
    for spark, path in _written:
        try:
            _delete(spark, path)
        except Exception:  # noqa: S112  the session has ended, or this one is gone: the others are still tried
            continue


def text_of(column: str = "text") -> Column:
    """The text, with null as empty."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def input_partitions(df: DataFrame) -> int:
    """Partitions for a shuffle of rows derived from df, as the session says."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def whole_text(column: Column | str = "text") -> list[Column]:
    """Two 64-bit hashes that tell a whole text from any other."""
    text = text_of(column) if isinstance(column, str) else F.coalesce(column.cast("string"), F.lit(""))
    return [F.xxhash64(text).alias("text_hash"), F.xxhash64(text, F.lit("check")).alias("text_check")]


def only_kept(docs: DataFrame, judged: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that judged (doc_id, text_hash, text_check, kept) keeps, with all their columns, whatever their names.

    A row is known by its id and whole text.  Only the narrow table of what goes is joined with docs, by a sort-merge join
    whatever its size, so that the plan is the same for small and large inputs and a hot key is split.  Of rows with one
    id and one text of which judged keeps one, exactly one stays: they are rare, and read again only if they occur.
    """
    names = ["doc_id", "text_hash", "text_check"]
    told = judged.groupBy(*names).agg(F.count("*").alias("n"), F.max("kept").alias("any"))
    told = materialize(told.where("n > 1 or not any"), "verdicts")

    def same(other: DataFrame):
        mine = [docs[id_col].cast("long"), *whole_text(docs[text_col])]
        return mine[0].eqNullSafe(other["doc_id"]) & (mine[1] == other["text_hash"]) & (mine[2] == other["text_check"])

    rest = docs.join(told.hint("merge"), same(told), "left_anti")
    again = told.where("any")
    if not again.limit(1).count():
        return rest
    some = docs.join(again.hint("merge"), same(again), "left_semi").select(F.struct("*").alias("row"), F.col(id_col).alias("doc_id"), *whole_text(text_col))
    return rest.unionByName(some.dropDuplicates(names).select("row.*"))
