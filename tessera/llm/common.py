"""Plumbing that the operators share: tables, scratch space, small checks."""

from __future__ import annotations

import atexit
import gc
import shutil
import tempfile
import uuid

import numpy as np
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word: a run of characters other than ASCII white space (fixed value).
WORD = r"[^\x20\x09-\x0D]+"

#: Rows that a table may have to be broadcast; callers count the table first.
BROADCAST_ROWS = 100_000

#: Rows that a Python worker holds as objects at a time.
SLICE_ROWS = 256


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    A cluster names it in ``spark.checkpoint.dir``. Where that is unset a
    temporary folder is made and set, if driver and executors are one process;
    else that is an error, since executors would not see the folder.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="tessera-")
        spark.conf.set("spark.checkpoint.dir", found)
        atexit.register(shutil.rmtree, found, ignore_errors=True)
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(found)
        atexit.register(_forget_checkpoints, spark)
    return found.rstrip("/")


def _forget_checkpoints(spark: SparkSession) -> None:
    """Delete the checkpoints of this application as it ends, if it has not been stopped before."""
    if spark.sparkContext._jsc is not None:
        _delete(spark, spark.sparkContext.getCheckpointDir())


def _delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(p, True)


class Scratch:
    """Tables written to the shared folder while an operator runs.

    ``keep`` cuts the lineage at a Parquet table, which any executor can read
    again; all of them are deleted on exit, so what is returned from inside
    must be checkpointed (``result``) or must not depend on them.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.path = f"{shared_dir(spark)}/scratch-{uuid.uuid4().hex}"
        self.n = 0

    def __enter__(self) -> Scratch:
        return self

    def keep(self, df: DataFrame) -> DataFrame:
        self.n += 1
        path = f"{self.path}/{self.n}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def narrow(self, df: DataFrame, *cols: str) -> DataFrame:
        """Of a table that ``keep`` gave, some columns; the table itself is deleted."""
        out = self.keep(df.select(*cols))
        self.discard(df)
        return out

    def discard(self, df: DataFrame) -> None:
        """Delete a table that ``keep`` gave."""
        for path in {f.rpartition("/")[0] for f in df.inputFiles()}:
            self.drop(path)

    def release(self) -> None:
        """Let Spark remove the shuffles of finished stages now rather than with some later collection."""
        gc.collect()
        self.spark._jvm.System.gc()

    def result(self, df: DataFrame) -> DataFrame:
        """An eager checkpoint. Its files go when the application ends, or with the last reference if ``spark.cleaner.referenceTracking.cleanCheckpoints`` is on."""
        return df.checkpoint(eager=True)

    def drop(self, path: str | None = None) -> None:
        _delete(self.spark, path or self.path)

    def __exit__(self, *exc) -> None:
        self.drop()


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if it has few rows, else without a hint."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def unit(*cols: Column) -> Column:
    """A reproducible number in [0, 1) from a hash of the columns."""
    return F.shiftrightunsigned(F.xxhash64(*cols), 11) / F.lit(float(1 << 53))


def pieces(batch, column: int, most: int):
    """An Arrow batch in pieces of at most about ``most`` bytes of one column, a row at least."""
    ends = np.cumsum(pc.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64) + 1)
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, side="right")))
        yield batch.slice(at, to - at)
        at = to


def slices(batch, size: int = SLICE_ROWS):
    """An Arrow batch in pieces, so that few rows are Python objects at a time."""
    for at in range(0, batch.num_rows, size):
        yield batch.slice(at, size)
