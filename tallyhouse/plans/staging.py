"""Intermediate tables in the shared folder of ``spark.checkpoint.dir``.

Matching in several passes reads its own results again and again; a written table
keeps the plan small and survives lost executors.
"""

from __future__ import annotations

import atexit
import functools
import re
import shutil
import tempfile
import uuid

from pyspark import SparkContext
from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The session's checkpoint folder. Where none is set, a session in one JVM
    gets a temporary one; any other master is refused, as its executors would not
    see a folder of the driver."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        own = tempfile.mkdtemp(prefix="tallyhouse-")
        atexit.register(shutil.rmtree, own, True)
        spark.sparkContext.setCheckpointDir(f"file://{own}")
        named = spark.sparkContext.getCheckpointDir()
    return named.rstrip("/")


def cut(df: DataFrame, name: str = "step") -> DataFrame:
    """``df`` written once and read from there; it goes when the application ends.

    Joins with it are dealt by key: Spark judges a written table by the size of its
    files, and a file of repeated texts is a hundred times as large once a
    broadcast has it in the driver's memory. A broadcast asked for on the other
    side, and one that runtime sizes allow elsewhere, still holds."""
    context = df.sparkSession.sparkContext
    own = f"{shared_folder(df.sparkSession)}/tallyhouse-{context.applicationId}"
    path = f"{own}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    folder = context._jvm.org.apache.hadoop.fs.Path(own)
    folder.getFileSystem(context._jsc.hadoopConfiguration()).deleteOnExit(folder)
    return df.sparkSession.read.schema(df.schema).parquet(path).hint("merge")


def once(build):
    """A function without arguments that makes columns: built once for each
    application. Columns are names and operations, they hold no data; building some
    thousands of them through the gateway takes seconds."""
    made: dict = {}

    @functools.wraps(build)
    def columns():
        context = SparkContext._active_spark_context
        if made.get("context") is not context:
            made.update(context=context, columns=build())
        return made["columns"]

    return columns
