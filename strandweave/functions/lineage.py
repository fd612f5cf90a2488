"""Cutting a long lineage through the shared folder that the cluster names."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame


def folder(spark) -> str:
    """The folder of ``spark.checkpoint.dir``; where the session names none and runs on one machine, as in tests, one is made and removed when Python ends."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir isn't set")
        named = tempfile.mkdtemp(prefix="strandweave-")
        atexit.register(shutil.rmtree, named, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", named)
    return named


def place(spark) -> str:
    """A new path in the application's part of the shared folder."""
    return f"{folder(spark)}/{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"


def drop_all(spark) -> None:
    """Removes everything that the application has written to the shared folder; what reads it must have ended."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(f"{folder(spark)}/{spark.sparkContext.applicationId}")
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def kept(spark, path: str, make, force: bool = False) -> DataFrame:
    """The table at ``path``, made by ``make()`` unless an earlier run has finished it there; ``force`` makes it anew.

    A table counts as finished by the mark that its last task's commit leaves, so one that a run was lost over is made again."""
    jvm = spark.sparkContext._jvm
    mark = jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if force or not mark.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(mark):
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def cut(df: DataFrame) -> DataFrame:
    """The DataFrame, written to and read from the shared folder.

    A table rather than a checkpoint: it survives the loss of any executor as well, takes less
    room, and tells its true size to the planner, whose estimates would else multiply in a loop
    of joins until they are numbers of millions of digits. Tables lie in a folder of the
    application; ``drop_all`` removes it when its results have been taken."""
    spark = df.sparkSession
    path = place(spark)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
