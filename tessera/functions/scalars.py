"""Scalar expressions with the null and rounding rules that cohort work needs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

EPS = 1e-6


def as_id(c) -> Column:
    return F.trim(F.col(c).cast("string")) if isinstance(c, str) else F.trim(c.cast("string"))


def is_missing(c: Column) -> Column:
    """Null or NaN."""
    return c.isNull() | F.isnan(c)


def is_in(c: Column, values) -> Column:
    """Membership that is false, not null, for null."""
    return F.coalesce(c.isin(list(values)), F.lit(False))


def recode(c: Column, arms: list[tuple], otherwise=None, missing="Missing") -> Column:
    """Ordered arms (condition on the column, label); missing is a category and comes first."""
    out = F.when(c.isNull(), F.lit(missing))
    for condition, label in arms:
        out = out.when(condition, F.lit(label))
    return out.otherwise(F.lit(otherwise)) if otherwise is not None else out


def present(cols: list[Column]) -> Column:
    """How many of the columns are not null, row by row."""
    return reduce(lambda a, b: a + b, [c.isNotNull().cast("int") for c in cols])


def row_mean(cols: list[Column]) -> Column:
    """The mean of the columns that are not null; null if none is."""
    total = reduce(lambda a, b: a + b, [F.coalesce(c.cast("double"), F.lit(0.0)) for c in cols])
    return F.try_divide(total, F.nullif(present(cols), F.lit(0)))


def half_even(c: Column) -> Column:
    return F.bround(c, 0)


def clamp(c: Column, low: float, high: float) -> Column:
    """Between bounds, and null for null (``least`` alone would skip it)."""
    return F.when(c.isNotNull(), F.least(F.greatest(c, F.lit(low)), F.lit(high)))


def logit(p: Column, eps: float = EPS) -> Column:
    q = clamp(p, eps, 1 - eps)
    return F.ln(q / (1 - q))


def neg_log10(p: Column, cap: float = 15.0) -> Column:
    """-log10 of a P value, capped; zero gives the cap."""
    return F.when(p.isNotNull(), F.least(F.coalesce(-F.log10(p), F.lit(cap)), F.lit(cap)))


def safe_ratio(a: Column, b: Column) -> Column:
    return F.try_divide(a, b)


def hash_order(seed, salt: str, *ids) -> Column:
    """A 32-bit pseudo-random number that any engine with md5 reproduces."""
    text = F.concat_ws("|", F.lit(str(seed)), F.lit(salt), *[i.cast("string") for i in ids])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint")


def derived_age(at_enrolment: Column, base: Column, visit: Column) -> Column:
    """Age at a visit from age at enrolment and two follow-up times in years."""
    return at_enrolment + base - visit


def fisher_z_difference(r1: Column, n1: Column, r2: Column, n2: Column) -> Column:
    """Difference of two correlations on Fisher's scale over its standard error."""
    bound = 0.9999
    a, b = clamp(r1, -bound, bound), clamp(r2, -bound, bound)
    return (F.atanh(a) - F.atanh(b)) / F.sqrt(1 / (n1 - 3) + 1 / (n2 - 3))


def correlation_t(r: Column, n: Column) -> Column:
    """The t statistic of a correlation with n - 2 degrees of freedom."""
    q = clamp(r, -0.9999, 0.9999)
    return q * F.sqrt((n - 2) / (1 - q * q))


def chernoff_log10(a: Column, df: Column) -> Column:
    """log10 of Chernoff's bound on a chi-square tail at a times its mean; 0 up to the mean."""
    return F.when(a <= 1, F.lit(0.0)).otherwise(-(df / 2) * (a - 1 - F.ln(a)) / F.ln(F.lit(10.0)))


def larger_magnitude(d: Column, a: Column) -> Column:
    """The value further from zero; the first on ties."""
    return F.when(F.abs(d) >= F.abs(a), d).otherwise(a)


def safe_corr(x: Column, y: Column) -> Column:
    """Pearson's correlation as an aggregate; null where a variance is zero, which ``corr`` refuses to divide by."""
    both = lambda c: F.when(x.isNotNull() & y.isNotNull(), c.cast("double"))
    sd = F.stddev_pop(both(x)) * F.stddev_pop(both(y))
    return F.try_divide(F.covar_pop(both(x), both(y)), sd)
