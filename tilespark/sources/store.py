"""Folders and small files in whatever store the tables are in."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir, or set as the checkpoint folder of the context. Where neither is, a private
    one in local mode; on a cluster that is an error, since executors could not see it."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    chosen = spark.sparkContext._jsc.sc().getCheckpointDir()
    if not chosen.isEmpty():
        return chosen.get()
    master = spark.sparkContext.master
    if not (master == "local" or master.startswith("local[")):
        raise RuntimeError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
    return tempfile.mkdtemp(prefix="shared-")


def file_system(spark: SparkSession, path: str):
    """(path, file system) of Spark's own, which reaches whatever store the tables are in."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target, target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def put_file(spark: SparkSession, path: str, data: bytes) -> None:
    """Write a small file beside its place, then rename it there, so that readers see the old one or the new one."""
    jvm, draft = spark.sparkContext._jvm, f"{path}.{uuid.uuid4().hex}.tmp"
    (source, store), (target, _) = file_system(spark, draft), file_system(spark, path)
    out = store.create(source)
    out.write(bytearray(data))
    out.close()
    rename = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
    how = spark.sparkContext._gateway.new_array(rename, 1)
    how[0] = rename.OVERWRITE
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(store.getUri(), spark.sparkContext._jsc.hadoopConfiguration()).rename(source, target, how)


def remove(spark: SparkSession, path: str) -> None:
    target, store = file_system(spark, path)
    store.delete(target, True)
