"""Exact quantiles of two definitions and average ranks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators.ordered import join_on, running


def _ranked(df: DataFrame, value: str, by: list[str]) -> DataFrame:
    """``(by, _v, _c, _lo, _n)``: distinct values, how often they occur, how many are smaller, how many there are in all."""
    bins = df.where(F.col(value).isNotNull()).groupBy(*by, F.col(value).cast("double").alias("_v")).agg(F.count("*").alias("_c"))
    ranked = running(bins, by, "_v", {"_lo": F.col("_c")})
    totals = bins.groupBy(*by).agg(F.sum("_c").alias("_n"))
    return join_on(ranked, totals, by) if by else ranked.join(totals)  # one row


def _at(k: Column) -> Column:
    """The k-th smallest value of a group, as an aggregate over its distinct values."""
    return F.min(F.when((F.col("_lo") < k) & (k <= F.col("_lo") + F.col("_c")), F.col("_v")))


def quantile_averaged(df: DataFrame, value: str, p: float, by: list[str] | None = None, name: str = "q") -> DataFrame:
    """The quantile that averages at discontinuities: between two order statistics if n*p is whole.

    Ranks come from counts of distinct values. Nulls are left out.
    """
    by = list(by or [])
    np_ = F.round(F.col("_n") * p, 9)  # whole numbers that a product misses by rounding are whole
    low = F.greatest(F.lit(1), F.ceil(np_))
    high = F.least(F.col("_n"), F.floor(np_) + 1)
    return _ranked(df, value, by).groupBy(*by).agg(((_at(low) + _at(high)) / 2).alias(name))


def _interpolated(p: float) -> Column:
    at = F.round((F.col("_n") - 1) * p, 9)
    low = F.floor(at)
    share = F.max(at - low)
    a, b = _at(low + 1), _at(F.least(low + 2, F.col("_n")))
    return a + share * (b - a)


def quantiles_interpolated(df: DataFrame, value: str, ps: list[float], by: list[str] | None = None) -> DataFrame:
    """Linearly interpolated quantiles, exact, one column ``q<percent>`` each."""
    by = list(by or [])
    return _ranked(df, value, by).groupBy(*by).agg(*[_interpolated(p).alias(f"q{round(100 * p)}") for p in ps])


def medians(df: DataFrame, cols: list[str], by: list[str] | None = None) -> DataFrame:
    """Exact medians, the mean of the middle two for even counts; 0 where all are null."""
    by = list(by or [])
    cells = F.explode(F.array(*[F.struct(F.lit(c).alias("c"), F.col(c).cast("double").alias("v")) for c in cols]))
    long = df.select(*by, cells.alias("x")).select(*by, F.col("x.c").alias("_col"), F.col("x.v").alias("_x"))
    found = _ranked(long, "_x", [*by, "_col"]).groupBy(*by, "_col").agg(_interpolated(0.5).alias("m"))
    wide = found.groupBy(*by).agg(*[F.max(F.when(F.col("_col") == c, F.col("m"))).alias(c) for c in cols])
    groups = df.select(*by).distinct() if by else df.sparkSession.range(1).select()
    out = join_on(groups, wide, by, "left") if by else groups.join(wide, how="left")
    return out.select(*by, *[F.coalesce(c, F.lit(0.0)).alias(c) for c in cols])


def average_rank(df: DataFrame, value: str, by: list[str] | None = None, name: str = "avg_rank") -> DataFrame:
    """Ranks from 1 in which ties share their mean; nulls come first."""
    by = list(by or [])
    bins = df.groupBy(*by, value).agg(F.count("*").alias("_c"))
    ranks = running(bins, by, value, {"_lo": F.col("_c")}).select(*by, value, (F.col("_lo") + (F.col("_c") + 1) / 2.0).alias(name))
    return join_on(df, ranks, [*by, value])
