"""Session helpers: the shared working folder and lineage cuts that survive lost executors."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; one of our own only where none is set and the
    session runs in one process (tests). A cluster without a shared folder raises."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        named = tempfile.mkdtemp(prefix="bispace-")
        atexit.register(shutil.rmtree, named, ignore_errors=True)
        spark.sparkContext.setCheckpointDir(named)
    return named


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint (for small, iterated tables)."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def work_dir(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/bispace-work-{spark.sparkContext.applicationId}"


def work_table(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once as compressed Parquet in the shared folder and read it back.

    A later stage that reads it several times then repeats neither its shuffles nor its Python
    work, and a lost executor costs only a re-read. ``clear_work`` removes what an application left.
    """
    spark = df.sparkSession
    path = f"{work_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def clear_work(spark: SparkSession) -> None:
    """Removes all work tables of this application; results that are still to be read need them."""
    path = spark._jvm.org.apache.hadoop.fs.Path(work_dir(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
