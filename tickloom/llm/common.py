"""Helpers shared by the training-data operators."""

from __future__ import annotations

import os
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The words of a text are maximal runs of anything but these ASCII blanks.
WORD = r"[^\x20\x09-\x0D]+"
#: Rows of an Arrow batch: texts are long, and workers hold a batch at a time.
BATCH_ROWS = "1000"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ship(spark: SparkSession) -> None:
    """Lets local Python workers import this package, wherever the driver found it, and bounds Arrow batches of long texts.

    On a cluster the package is sent with --py-files; the entry is harmless there.
    """
    root = str(Path(__file__).resolve().parents[2])
    env = spark.sparkContext.environment
    have = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in have:
        env["PYTHONPATH"] = os.pathsep.join([root, *have])
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir; where that is unset a fresh one of this machine in local mode, as in tests, and an error on a cluster."""
    sc = spark.sparkContext
    at = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not at:
        if sc.master != "local" and not sc.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        at = tempfile.mkdtemp(prefix="checkpoints-")
        sc.setCheckpointDir(at)
    return at


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder, removed when the driver ends."""
    path = f"{shared_dir(spark)}/tickloom/{name}-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
    return path


def cut(df: DataFrame, name: str) -> DataFrame:
    """Writes a table to the shared folder and reads it: lineage ends there, and a lost executor costs nothing."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def uncut(df: DataFrame) -> None:
    """Deletes the files of a table that cut() gave and nothing reads any more, before the driver ends."""
    jvm, sc = df.sparkSession.sparkContext._jvm, df.sparkSession.sparkContext
    for path in {name.rpartition("/")[0] for name in df.inputFiles()}:
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(sc._jsc.hadoopConfiguration()).delete(where, True)


def ascii_lower(c: Column) -> Column:
    return F.translate(c, UPPER, UPPER.lower())


def text_of(c: str | Column = "text") -> Column:
    """A text, the empty one for null."""
    c = F.col(c) if isinstance(c, str) else c
    return F.coalesce(c, F.lit(""))
