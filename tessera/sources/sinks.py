"""Writing results: delimited, appended, atomically replaced, resumed, matched to a design."""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return fs.exists(p)


def write_csv(df: DataFrame, path: str, one_file: bool = False) -> None:
    """A delimited result with a header; ``one_file`` is for report-sized tables."""
    (df.coalesce(1) if one_file else df).write.mode("overwrite").csv(path, header=True)


def append(df: DataFrame, path: str, partition_by: str | None = None) -> None:
    """Rows added to a Parquet log; each run adds files, so a header is never in question."""
    w = df.write.mode("append")
    (w.partitionBy(partition_by) if partition_by else w).parquet(path)


#: Where the old table is while the new one moves in.
ASIDE = "._old"


def recovered(spark: SparkSession, path: str) -> bool:
    """Whether there is a table at ``path``, after undoing a replacement that broke off."""
    base = path.rstrip("/")
    fs, p = _fs(spark, base)
    _, o = _fs(spark, f"{base}{ASIDE}")
    if fs.exists(o):
        if fs.exists(p):
            fs.delete(o, True)
        else:
            fs.rename(o, p)
    return fs.exists(p)


def replace(df: DataFrame, path: str) -> None:
    """Write beside ``path``, move the old table aside, the new one in, then delete the old.

    Some whole table exists at every moment: ``recovered`` puts back what a
    crash between the two moves left aside.
    """
    spark = df.sparkSession
    recovered(spark, path)
    base, token = path.rstrip("/"), uuid.uuid4().hex
    tmp, old = f"{base}._{token}", f"{base}{ASIDE}"
    try:
        df.write.parquet(tmp)
        fs, p = _fs(spark, base)
        _, o = _fs(spark, old)
        if fs.exists(p) and not fs.rename(p, o):
            raise OSError(f"{path} could not be moved aside")
        if not fs.rename(spark._jvm.org.apache.hadoop.fs.Path(tmp), p):
            fs.rename(o, p)
            raise OSError(f"{tmp} could not be renamed to {path}")
        fs.delete(o, True)
    finally:
        fs, t = _fs(spark, tmp)
        fs.delete(t, True)


def cached(spark: SparkSession, path: str, make: Callable[[], DataFrame], overwrite: bool = False) -> DataFrame:
    """The table at ``path``, made first if it is not there."""
    if overwrite or not recovered(spark, path):
        replace(make(), path)
    return spark.read.parquet(path)


def remaining(wanted: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Keys not done yet, for a resumed run."""
    return wanted.join(done.select(key).distinct(), key, "left_anti")


def signature(design: dict) -> str:
    """A digest of a run's design that does not depend on the order of its entries."""
    return hashlib.md5(json.dumps(design, sort_keys=True, default=str).encode()).hexdigest()


def read_if_same_design(spark: SparkSession, path: str, design: dict) -> DataFrame | None:
    """A checkpointed table if it was written under this design, else None; an empty one tells by its column's name."""
    if not recovered(spark, path):
        return None
    df = spark.read.parquet(path)
    name = f"design_{signature(design)}"
    return df.drop(name) if name in df.columns else None


def write_with_design(df: DataFrame, path: str, design: dict) -> None:
    replace(df.withColumn(f"design_{signature(design)}", F.lit(True)), path)
