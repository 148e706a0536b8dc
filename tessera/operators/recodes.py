"""Derived clinical features."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.scalars import half_even, present, row_mean
from tessera.operators.quantiles import quantile_averaged
from tessera.operators.relational import null_safe_left_join


def weight_loss(change: Column, intended: Column) -> Column:
    """1 for a loss of 5 or more that was not intended, 0 for any other known change."""
    return F.when((change <= -5) & (intended == "No"), 1).when((change <= -5) & (intended == "Yes"), 0).when(change > -5, 0)


def low_energy(has_energy: Column) -> Column:
    return F.when(has_energy == "No", 1).when(has_energy == "Yes", 0)


def at_or_below(value: Column, cut: Column, unable: Column | None = None) -> Column:
    """1 at or below a cut-point or if unable to be measured, 0 above, null if unknown."""
    out = F.when(F.coalesce(unable, F.lit(False)), 1) if unable is not None else F.when(F.lit(False), 1)
    return out.when(value <= cut, 1).when(value > cut, 0)


def bucket_of_four(df: DataFrame, value: str, name: str) -> DataFrame:
    """Which quarter of all rows a value falls in, by averaged quartiles; null stays null."""
    cuts = None
    for k, p in enumerate((0.25, 0.5, 0.75), 1):
        q = quantile_averaged(df, value, p, name=f"_c{k}")
        cuts = q if cuts is None else cuts.join(q)  # one row each
    v = F.col(value)
    return df.join(cuts).withColumn(  # one row
        name, F.when(v <= F.col("_c1"), 1).when(v <= F.col("_c2"), 2).when(v <= F.col("_c3"), 3).when(v.isNotNull(), 4)
    ).drop("_c1", "_c2", "_c3")


def with_bucket_cut(df: DataFrame, bucket: str, value: str, p: float, name: str, eligible: Column | None = None) -> DataFrame:
    """Each row's cut-point: the averaged quantile of its bucket among eligible rows. A null bucket has one too."""
    pool = df.where(eligible) if eligible is not None else df
    return null_safe_left_join(df, quantile_averaged(pool, value, p, [bucket], name), bucket)


def low_activity(df: DataFrame, value: str, name: str, share: float = 0.2) -> DataFrame:
    """``name``: 1 at or below the averaged quantile of all rows, 0 above, null if unknown."""
    cut = quantile_averaged(df, value, share, name="_cut")
    return df.join(cut).withColumn(name, at_or_below(F.col(value), F.col("_cut"))).drop("_cut")  # one row


def slowness(df: DataFrame, height: str, walk: str, unable: str, name: str, share: float = 0.2) -> DataFrame:
    """``name``: unable to walk, or at or below the cut-point of one's half of heights; null where height or speed is unknown.

    Halves divide at the averaged median, which belongs to the upper one;
    cut-points come from rows that walked or were unable to.
    """
    middle = quantile_averaged(df, height, 0.5, name="_middle")
    halves = df.join(middle).withColumn("_half", F.when(F.col(height) < F.col("_middle"), 1).when(F.col(height) >= F.col("_middle"), 2))  # one row
    cut = with_bucket_cut(halves, "_half", walk, share, "_cut", F.col(walk).isNotNull() | F.col(unable))
    slow = F.when(F.col("_half").isNotNull(), at_or_below(F.col(walk), F.col("_cut"), F.col(unable)))
    return cut.withColumn(name, slow).drop("_middle", "_half", "_cut")


def weakness(df: DataFrame, build: str, grip: str, unable: str, name: str, share: float = 0.2) -> DataFrame:
    """``name``: unable to grip, or at or below the cut-point of one's quarter of ``build``; null without a cut-point or a measure.

    Rows of unknown build are a bucket of their own.
    """
    quarters = bucket_of_four(df, build, "_quarter")
    cut = with_bucket_cut(quarters, "_quarter", grip, share, "_cut", F.col(grip).isNotNull() | F.col(unable))
    weak = F.when(F.col("_cut").isNotNull(), at_or_below(F.col(grip), F.col("_cut"), F.col(unable)))
    return cut.withColumn(name, weak).drop("_quarter", "_cut")


def frailty(criteria: list[Column], in_clinic: Column) -> tuple[Column, Column]:
    """Score and class of a five-criteria composite: prorated from three criteria on, rounded half to even."""
    n = present(criteria)
    score = F.when(in_clinic & (n >= 3), half_even(F.when(n == 5, row_mean(criteria) * 5).otherwise(5 * row_mean(criteria))))
    label = F.when(score.isNull(), "Missing").when(score == 0, "Robust").when(score <= 2, "Intermediate").otherwise("Frail")
    return score, label


def eligible_layer_rows(df: DataFrame, status: str, classes: list[str], antibiotics: str | None = None, excluded: tuple[str, list] | None = None) -> DataFrame:
    """Rows of two outcome classes, off antibiotics, without listed samples, which must exist."""
    if excluded:
        key, ids = excluded
        found = df.where(F.col(key).isin(ids)).select(key).distinct().count()
        if found != len(set(ids)):
            raise ValueError(f"{len(set(ids)) - found} excluded samples are not in the table")
        df = df.where(~F.coalesce(F.col(key).isin(ids), F.lit(False)))
    if antibiotics:
        df = df.where(F.col(antibiotics) == "No")
    return df.where(F.col(status).isin(classes))


def count_filters(counts: DataFrame, sample: str, taxon: str, n: str, prevalence: float, library: int) -> DataFrame:
    """Counts of samples with a large enough library and taxa present in enough of those samples."""
    big = counts.groupBy(sample).agg(F.sum(n).alias("_lib")).where(F.col("_lib") >= library).select(sample)
    kept = counts.join(big, sample)
    seen = kept.where(F.col(n) > 0).groupBy(taxon).agg(F.countDistinct(sample).alias("_s"))
    total = kept.agg(F.countDistinct(sample).alias("_t"))  # one row
    common = seen.join(total).where(F.col("_s") >= prevalence * F.col("_t")).select(taxon)
    return kept.join(common, taxon)


def clr(counts: DataFrame, sample: str, n: str, name: str = "clr", pseudo: float = 1.0) -> DataFrame:
    """Centred log ratios within a sample, after a pseudo-count."""
    from pyspark.sql import Window

    x = F.ln(F.col(n) + pseudo)
    return counts.withColumn(name, x - F.avg(x).over(Window.partitionBy(sample)))


def bias_corrected_log(counts: DataFrame, sample: str, taxon: str, n: str, groups: list[str]) -> DataFrame:
    """Log abundances less each sample's bias: its mean residual from the taxon-by-group means.

    An approximation by one least-squares step, not the published iterative
    estimator; ``log_corrected`` and ``abundance`` (its exponential, 0 for
    absent taxa) are returned.
    """
    from pyspark.sql import Window

    x = counts.where(F.col(n) > 0).withColumn("_l", F.ln(n))
    fitted = x.withColumn("_r", F.col("_l") - F.avg("_l").over(Window.partitionBy(taxon, *groups)))
    out = fitted.withColumn("log_corrected", F.col("_l") - F.avg("_r").over(Window.partitionBy(sample))).drop("_l", "_r")
    rest = counts.where(~(F.coalesce(F.col(n), F.lit(0)) > 0)).withColumn("log_corrected", F.lit(None).cast("double"))
    return out.unionByName(rest).withColumn("abundance", F.coalesce(F.exp("log_corrected"), F.lit(0.0)))
