"""Ranks and running sums over whole groups, however large a group is.

Few rows are sorted group by group. Many are dealt into ranges of the value
first, whose borders are quantiles of all rows, as many as there are tasks to
spread them over; a range's place comes from the sums of the ranges before it,
a row's place from its own range. Both give the same rows, so which way is
taken is a question of time alone. Callers pass values that are distinct in
their group, so ties never cross a border, however many groups share a value.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Bytes of a table, by Spark's estimate, and rows, by count, that are sorted group by group; ranges for each shuffle partition.
FEW_BYTES, FEW_ROWS, RANGES = 16 << 20, 2_000_000, 4


def few(df: DataFrame) -> bool:
    """Whether a table is small enough to be sorted group by group. Only where the plan's own estimate leaves doubt is it counted."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return size <= FEW_BYTES or df.limit(FEW_ROWS + 1).count() <= FEW_ROWS


def ranges(df: DataFrame) -> int:
    """How many ranges large tables are dealt into: some for each task of a shuffle."""
    return RANGES * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def splitters(df: DataFrame, value: str) -> np.ndarray:
    """Values that part all rows into about equally many: quantiles from a sketch, on the driver, one a range."""
    n = ranges(df)
    found = df.select(F.col(value).cast("double").alias("v")).where("v IS NOT NULL AND NOT isnan(v)").approxQuantile("v", [k / n for k in range(1, n)], 0.25 / n)
    return np.unique(np.array(found, float))


def in_range(value: Column, borders: np.ndarray) -> Column:
    """The number of a value's range; it never falls as the value rises: nulls first, NaN last."""

    def place(v: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(borders, v.to_numpy(float), side="right") + 1)  # NaN sorts last

    v = value.cast("double")
    last = F.lit(len(borders) + 2).cast("bigint")
    known = F.pandas_udf(place, "bigint")(F.coalesce(F.nanvl(v, F.lit(0.0)), F.lit(0.0)))
    return F.when(v.isNull(), F.lit(0).cast("bigint")).when(F.isnan(v), last).otherwise(known)


def join_on(a: DataFrame, b: DataFrame, cols: list[str], how: str = "inner", large: bool = False) -> DataFrame:
    """``a`` with the other columns of ``b``; nulls meet nulls.

    ``large``: both have rows by the size of the data, whatever the plan's own
    estimate says, so neither is sent to the driver and from there to all tasks.
    """
    renamed = b.select(*[F.col(c).alias(f"_k_{c}") for c in cols], *[c for c in b.columns if c not in cols])
    renamed = renamed.hint("merge") if large else renamed
    same = [F.col(c).eqNullSafe(F.col(f"_k_{c}")) for c in cols]
    return a.join(renamed, reduce(lambda x, y: x & y, same), how).drop(*[f"_k_{c}" for c in cols])


def _grouped(by: list[str]):
    return Window.partitionBy(*by) if by else Window.partitionBy(F.lit(1))


def _offsets(rows: DataFrame, by: list[str], sums: dict[str, Column]) -> DataFrame:
    """``(by, _b, <name>_0)``: the sums of a group's ranges before each."""
    totals = rows.groupBy(*by, "_b").agg(*[F.sum(v).alias(n) for n, v in sums.items()])
    before = _grouped(by).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    return totals.select(*by, "_b", *[F.coalesce(F.sum(n).over(before), F.lit(0)).alias(f"{n}_0") for n in sums])


def running(bins: DataFrame, by: list[str], value: str, sums: dict[str, Column], like: DataFrame | None = None) -> DataFrame:
    """``bins`` with, for each name, the sum over the group's bins of smaller value; values are distinct in a group.

    ``like`` is a table of the same values that is cheaper to count and to
    sketch, if no group has more bins than it has rows.
    """
    before = lambda w: w.orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    like = bins if like is None else like
    if few(like):
        inside = before(_grouped(by))
        return bins.select(*bins.columns, *[F.coalesce(F.sum(v).over(inside), F.lit(0)).alias(n) for n, v in sums.items()])
    rows = bins.withColumn("_b", in_range(F.col(value), splitters(like, value)))
    inside = before(Window.partitionBy(*by, "_b"))
    out = join_on(rows, _offsets(rows, by, sums), [*by, "_b"])
    return out.select(*bins.columns, *[(F.col(f"{n}_0") + F.coalesce(F.sum(v).over(inside), F.lit(0))).alias(n) for n, v in sums.items()])


def numbered(df: DataFrame, by: list[str], order: Column, tie: str, name: str = "_n") -> DataFrame:
    """``df`` with row numbers from 1 in each group, in the order of a 32-bit hash, then ``tie``.

    Hashes are even, so ranges of many rows are equal parts of their 32 bits.
    """
    rows = df.withColumn("_o", order)
    if few(df):
        return rows.withColumn(name, F.row_number().over(_grouped(by).orderBy("_o", tie))).drop("_o")
    rows = rows.withColumn("_b", F.shiftright(F.col("_o") * ranges(df), 32))
    inside = Window.partitionBy(*by, "_b").orderBy("_o", tie)
    out = join_on(rows, _offsets(rows, by, {"_c": F.lit(1)}), [*by, "_b"])
    return out.withColumn(name, F.col("_c_0") + F.row_number().over(inside)).drop("_o", "_b", "_c_0")


def smallest_after(bins: DataFrame, by: list[str], value: str, what: Column, name: str) -> DataFrame:
    """``bins`` with the least of ``what`` over the group's bins of the same or a larger value: a suffix minimum."""
    after = lambda w: w.orderBy(value).rowsBetween(0, Window.unboundedFollowing)
    if few(bins):
        return bins.withColumn(name, F.min(what).over(after(_grouped(by))))
    rows = bins.withColumn("_w", what).withColumn("_b", in_range(F.col(value), splitters(bins, value)))
    later = _grouped(by).orderBy("_b").rowsBetween(1, Window.unboundedFollowing)
    least = rows.groupBy(*by, "_b").agg(F.min("_w").alias("_after")).select(*by, "_b", F.min("_after").over(later).alias("_after"))
    out = join_on(rows, least, [*by, "_b"])
    return out.withColumn(name, F.least(F.min("_w").over(after(Window.partitionBy(*by, "_b"))), "_after")).drop("_w", "_b", "_after")


def total_rank(df: DataFrame, order: str, tie: str, name: str = "rank", descending: bool = False) -> DataFrame:
    """``df`` with row numbers from 1 by a number and then ``tie``, over all rows; nulls come last.

    ``tie`` tells rows of one number apart. Counts of the different numbers
    are summed up first; only rows of one number are sorted together.
    """
    key = F.col(order).cast("double")
    rows = df.withColumn("_v", F.coalesce(-key if descending else key, F.lit(float("inf"))))
    counts = running(rows.groupBy("_v").agg(F.count("*").alias("_c")), [], "_v", {"_c0": F.col("_c")}).drop("_c")
    inside = Window.partitionBy("_v").orderBy(tie)
    return rows.join(counts, "_v").withColumn(name, F.col("_c0") + F.row_number().over(inside)).drop("_v", "_c0")
