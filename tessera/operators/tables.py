"""Descriptive tables: characteristics by group, complete cases against the rest."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.inference import chi_square, fisher_simulated, wilcoxon
from tessera.operators.ordered import join_on
from tessera.operators.relational import stack


def categorical_rows(df: DataFrame, variables: list[str], group: str, by: list[str] | None = None) -> DataFrame:
    """``(by, variable, level, n, n_a, n_b, pct, pct_a, pct_b)`` for a 0/1 group.

    All variables are stacked and counted in one pass. Percentages are of all
    rows of the column, missing ones included; a "Missing" level appears only
    where a value is missing.
    """
    by = list(by or [])
    long = df.select(*by, group, F.explode(F.array(*[F.struct(F.lit(v).alias("variable"), F.coalesce(F.col(v).cast("string"), F.lit("Missing")).alias("level")) for v in variables])).alias("x"))
    counts = long.groupBy(*by, "x.variable", "x.level").agg(
        F.count("*").alias("n"), F.sum((F.col(group) == 1).cast("bigint")).alias("n_a"), F.sum((F.col(group) == 0).cast("bigint")).alias("n_b")
    )
    w = Window.partitionBy(*by, "variable")
    pct = lambda c: (100.0 * F.try_divide(F.col(c), F.sum(c).over(w)))
    return counts.withColumns({"pct": pct("n"), "pct_a": pct("n_a"), "pct_b": pct("n_b")})


def continuous_rows(df: DataFrame, variables: list[str], group: str, by: list[str] | None = None) -> DataFrame:
    """``(by, variable, n, missing, mean, sd, mean_a, sd_a, mean_b, sd_b)`` for a 0/1 group."""
    by = list(by or [])
    long = df.select(*by, group, F.explode(F.array(*[F.struct(F.lit(v).alias("variable"), F.col(v).cast("double").alias("x")) for v in variables])).alias("v")).select(*by, group, "v.*")
    a, b = F.when(F.col(group) == 1, F.col("x")), F.when(F.col(group) == 0, F.col("x"))
    return long.groupBy(*by, "variable").agg(
        F.count("x").alias("n"), F.sum(F.col("x").isNull().cast("bigint")).alias("missing"), F.avg("x").alias("mean"), F.stddev_samp("x").alias("sd"),
        F.avg(a).alias("mean_a"), F.stddev_samp(a).alias("sd_a"), F.avg(b).alias("mean_b"), F.stddev_samp(b).alias("sd_b"),
    )


def characteristics(df: DataFrame, key: str, group: str, categorical: list[str], yes_no: list[str], continuous: list[str], permutations: int = 2000, seed=1, by: list[str] | None = None) -> DataFrame:
    """The rows of ``categorical_rows`` and ``continuous_rows`` in one table, with ``p_value`` by variable; one such table for each of ``by``.

    Chi-square P of known levels; where an expected count is below 5 a yes/no
    variable has none and others take Fisher's, by ``permutations`` random
    tables. Rank-sum P of numbers, exact for small untied groups, none for
    small tied ones.
    """
    by = list(by or [])
    at, levels = [*by, "variable"], [*categorical, *yes_no]
    cells = F.explode(F.array(*[F.struct(F.lit(v).alias("variable"), F.col(v).cast("string").alias("level")) for v in levels]))
    long = df.select(*by, group, cells.alias("x")).select(*by, group, "x.*")
    plain = chi_square(long, "level", group, at).select(*at, "p_value", (F.col("least_expected") < 5).alias("_sparse"))
    thin = join_on(long.where(F.col("variable").isin(categorical)), plain.where("_sparse").select(*at), at)
    fisher = fisher_simulated(thin, "level", group, at, permutations, seed).withColumnRenamed("p_value", "_fisher")
    tested = join_on(plain, fisher, at, "left").select(*at, F.when(F.col("_sparse"), F.col("_fisher")).otherwise(F.col("p_value")).alias("p_value"))
    numbers = F.explode(F.array(*[F.struct(F.lit(v).alias("variable"), F.col(v).cast("double").alias("value")) for v in continuous]))
    ranked = wilcoxon(df.select(*by, group, numbers.alias("x")).select(*by, group, "x.*"), "value", group, at).select(*at, "p_value")
    return join_on(stack([categorical_rows(df, levels, group, by), continuous_rows(df, continuous, group, by)]), tested.unionByName(ranked), at, "left")


def flow_counts(df: DataFrame, flags: dict[str, str]) -> DataFrame:
    """``(step, n)``: how many rows pass each condition, in one pass over the table."""
    one = df.agg(*[F.sum(F.expr(f"CAST(({c}) AS BIGINT)")).alias(k) for k, c in flags.items()])
    return one.select(F.explode(F.array(*[F.struct(F.lit(k).alias("step"), F.col(k).alias("n")) for k in flags])).alias("x")).select("x.*")
