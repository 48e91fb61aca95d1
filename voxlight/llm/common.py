"""Helpers that the training-data operators share."""

from __future__ import annotations

import ctypes
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Width of shuffles where the session names none.
DEFAULT_PARTITIONS = 200


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", str(DEFAULT_PARTITIONS)))


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir. Where none is named, a local session gets a folder of its own and a cluster is refused."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = f"file://{tempfile.mkdtemp(prefix='voxlight-')}"
        spark.sparkContext.setCheckpointDir(named)
    return named


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """df written as Parquet to the shared folder and read again: lineage ends there, and lost executors cost nothing."""
    path = f"{shared_dir(df.sparkSession).rstrip('/')}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.written_to = path
    return out


def discard(*tables: DataFrame | None) -> None:
    """Deletes the files of materialized tables that no result will read any more; others are left alone."""
    for t in tables:
        if path := getattr(t, "__dict__", {}).get("written_to"):
            jvm = t.sparkSession.sparkContext._jvm
            place = jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(t.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def give_back() -> None:
    """Memory that this Python worker no longer uses goes back to the machine. Workers live on from stage to stage, and each would keep what its largest task once held."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # not every C library has it
        trim(0)


def lean(work):
    """The same function of batches; at its end the worker gives unused memory back."""

    def worked(batches):
        try:
            yield from work(batches)
        finally:
            give_back()

    return worked


def from_json_literal(text: str, ddl: str) -> Column:
    """A constant of the given type; Catalyst folds it, however many items it has."""
    return F.from_json(F.lit(text), ddl)


def count_not_above(items: Column, n: int, not_above) -> Column:
    """How many of the n ascending items are not above the row: binary search as one expression.

    not_above(item) says whether an item is at or below the row.
    """
    steps = max(1, n.bit_length())

    def step(acc: Column, _: Column) -> Column:
        mid = F.floor((acc["lo"] + acc["hi"]) / 2).cast("int")
        below = not_above(F.element_at(items, F.least(mid, F.lit(n - 1)) + 1))
        going = acc["lo"] < acc["hi"]
        return F.struct(
            F.when(going & below, mid + 1).otherwise(acc["lo"]).cast("int").alias("lo"),
            F.when(going & ~below, mid).otherwise(acc["hi"]).cast("int").alias("hi"),
        )

    start = F.struct(F.lit(0).cast("int").alias("lo"), F.lit(n).cast("int").alias("hi"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, step)["lo"] if n else F.lit(0)
