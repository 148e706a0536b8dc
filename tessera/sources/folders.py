"""Folders for tables that live as long as a session."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where that is unset a temporary folder is made and set if driver and
    executors are one process; else it is an error, as executors would not
    see the folder.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="tessera-")
        spark.conf.set("spark.checkpoint.dir", found)
        atexit.register(shutil.rmtree, found, ignore_errors=True)
    return found.rstrip("/")


def own_folder(spark: SparkSession) -> str:
    """The name of a new folder inside the shared one, deleted as the application ends."""
    path = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    atexit.register(forget, spark, path)
    return path


def forget(spark: SparkSession, path: str) -> None:
    """Delete a folder, if the session has not been stopped before."""
    if spark.sparkContext._jsc is not None:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(p, True)
