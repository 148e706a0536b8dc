"""Multiplicity, group tests and correlations."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.scalars import safe_corr
from tessera.functions.tails import _lgamma as log_gamma
from tessera.functions.tails import chi2_p, normal_p, rank_sum_p, t_log10_p
from tessera.operators.ordered import join_on, running, smallest_after
from tessera.operators.quantiles import average_rank


def bh_adjust(df: DataFrame, p: str, family: list[str], name: str = "p_adj") -> DataFrame:
    """Benjamini-Hochberg adjusted P values within a family; nulls stay and do not count.

    Families are counted by distinct P first; ranks are running sums and the
    adjusted value a suffix minimum over these, so a family of any size is
    spread.
    """
    bins = df.where(F.col(p).isNotNull()).groupBy(*family, p).agg(F.count("*").alias("_c"))
    ranked = running(bins, family, p, {"_lo": F.col("_c")})
    sizes = bins.groupBy(*family).agg(F.sum("_c").alias("_m"))
    ranked = join_on(ranked, sizes, family) if family else ranked.join(sizes)  # one row
    scaled = F.col(p) * F.col("_m") / (F.col("_lo") + F.col("_c"))
    least = smallest_after(ranked, family, p, scaled, "_s").select(*family, p, F.least("_s", F.lit(1.0)).alias(name))
    return join_on(df, least, [*family, p], "left")


def chi_square(df: DataFrame, row: str, col: str, by: list[str] | None = None) -> DataFrame:
    """Pearson's statistic of a contingency table without continuity correction, its df, least expected count and P."""
    by = list(by or [])
    cells = df.where(F.col(row).isNotNull() & F.col(col).isNotNull()).groupBy(*by, row, col).agg(F.count("*").alias("o"))
    rows = cells.groupBy(*by, row).agg(F.sum("o").alias("r"))
    cols = cells.groupBy(*by, col).agg(F.sum("o").alias("c"))
    grid = (rows.join(cols, by) if by else rows.crossJoin(cols)).join(cells, [*by, row, col], "left")  # levels x levels
    part = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(1))
    grid = grid.withColumn("n", F.sum(F.coalesce("o", F.lit(0))).over(part)).withColumn("e", F.col("r") * F.col("c") / F.col("n"))
    out = grid.groupBy(*by).agg(
        F.sum(F.pow(F.coalesce("o", F.lit(0)) - F.col("e"), F.lit(2)) / F.col("e")).alias("statistic"),
        ((F.countDistinct(row) - 1) * (F.countDistinct(col) - 1)).alias("df"), F.min("e").alias("least_expected"),
    )
    return out.withColumn("p_value", chi2_p("statistic", F.col("df").cast("double")))


def chi_square_by_permutation(df: DataFrame, key: str, row: str, label: str, permutations: int = 2000, seed=1) -> DataFrame:
    """The P value of the chi-square statistic under permuted labels, for tables with small expected counts."""
    from tessera.operators.resampling import permuted_labels

    perms = permuted_labels(df, key, label, permutations, seed).join(df.select(key, row), key)
    stats = chi_square(perms, row, label, ["perm_id"]).select("perm_id", "statistic")
    observed = stats.where("perm_id = 0").select(F.col("statistic").alias("observed"))
    return stats.where("perm_id > 0").join(observed).agg(  # one row observed
        F.first("observed").alias("statistic"), ((1 + F.sum((F.col("statistic") >= F.col("observed") - 1e-9).cast("int"))) / (1 + F.count("*"))).alias("p_value")
    )


#: Parts in which the random tables of one test are drawn, and rows that numpy's sampler takes.
SHARDS, MOST_ROWS = 16, 10**9


def random_tables(rows: np.ndarray, cols: np.ndarray, times: int, rng: np.random.Generator) -> np.ndarray:
    """``times`` contingency tables with these margins, as they fall if rows and columns do not depend on each other.

    A row after another is dealt among what is left of the columns, each cell
    hypergeometric given the cells before it, for all tables at once.
    """
    out = np.zeros((times, len(rows), len(cols)), np.int64)
    rest = np.tile(np.asarray(cols, np.int64), (times, 1))
    for i, total in enumerate(rows[:-1]):
        left, pool = np.full(times, total, np.int64), rest.sum(axis=1)
        for j in range(len(cols) - 1):
            pool = pool - rest[:, j]
            out[:, i, j] = rng.hypergeometric(rest[:, j], pool, left)
            left = left - out[:, i, j]
        out[:, i, -1] = left
        rest = rest - out[:, i]
    out[:, -1] = rest
    return out


def _fisher_exact(table: np.ndarray) -> float:
    """P of a table of two by two: all tables with its margins that are no more likely."""
    (a, b), (c, d) = table
    first, second, total = a + b, a + c, a + b + c + d
    k = np.arange(max(0, first + second - total), min(first, second) + 1)
    logs = -(log_gamma(k + 1) + log_gamma(first - k + 1) + log_gamma(second - k + 1) + log_gamma(total - first - second + k + 1))
    p = np.exp(logs - logs.max())
    return float(min(1.0, p[p <= p[k == a][0] * (1 + 1e-7)].sum() / p.sum()))


def fisher_simulated(df: DataFrame, row: str, col: str, by: list[str] | None = None, replicates: int = 2000, seed=1) -> DataFrame:
    """``(by, p_value)``: Fisher's test of every group's contingency table.

    A table of two by two has its exact P. Of larger ones ``replicates``
    random tables with the same margins are drawn, in parts that are spread,
    and those no more likely than the observed one count, which counts itself.
    A table with one row or column has P 1; rows with nulls do not count.
    """
    by = list(by or [])
    cells = df.where(F.col(row).isNotNull() & F.col(col).isNotNull()).groupBy(*by, F.col(row).cast("string").alias("_r"), F.col(col).cast("string").alias("_c")).agg(F.count("*").alias("o"))
    tables = cells.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("_r", "_c", "o"))).alias("_t"))  # the levels of one table
    units = tables.withColumn("_shard", F.explode(F.sequence(F.lit(0), F.lit(min(SHARDS, replicates) - 1)))).withColumn("_key", F.xxhash64(*by, "_shard", F.lit(seed)) if by else F.xxhash64("_shard", F.lit(seed)))
    shards = min(SHARDS, replicates)

    def run(batches):
        for pdf in batches:
            out = []
            for t, shard, key in zip(pdf["_t"], pdf["_shard"], pdf["_key"]):
                rs, cs = sorted({c["_r"] for c in t}), sorted({c["_c"] for c in t})
                table = np.zeros((len(rs), len(cs)), np.int64)
                for c in t:
                    table[rs.index(c["_r"]), cs.index(c["_c"])] = c["o"]
                times = replicates // shards + (shard < replicates % shards)
                if min(table.shape) < 2:
                    out.append((0, 0, 1.0))
                elif table.shape == (2, 2):
                    out.append((0, 0, _fisher_exact(table)))
                else:
                    if table.sum() > MOST_ROWS:
                        raise ValueError(f"random tables of more than {MOST_ROWS} rows")
                    drawn = random_tables(table.sum(axis=1), table.sum(axis=0), times, np.random.default_rng(int(key) & (1 << 63) - 1))
                    own, least = -log_gamma(table + 1.0).sum(), -log_gamma(drawn + 1.0).sum(axis=(1, 2))
                    out.append((int((least <= own + 1e-10 * abs(own)).sum()), times, None))
            found = pd.DataFrame(out, columns=["_hits", "_times", "_exact"])
            yield pd.concat([pdf[by].reset_index(drop=True), found], axis=1)

    schema = T.StructType([*[tables.schema[c] for c in by], T.StructField("_hits", T.LongType()), T.StructField("_times", T.LongType()), T.StructField("_exact", T.DoubleType())])
    parts = units.repartition(2 * SHARDS, "_key").mapInPandas(run, schema)
    p = F.coalesce(F.nanvl(F.max("_exact"), F.lit(None)), (1 + F.sum("_hits")) / (1 + F.sum("_times")))
    return parts.groupBy(*by).agg(p.alias("p_value"))


def chi_square_or_simulated(df: DataFrame, key: str, row: str, col: str, permutations: int = 2000, seed=1) -> DataFrame:
    """``(statistic, df, least_expected, p_value)``: the asymptotic P, unless an expected count is below 5.

    Then P is Fisher's: exact for two by two levels, by random tables for more.
    """
    plain = chi_square(df, row, col)
    fisher = fisher_simulated(df, row, col, [], permutations, seed).withColumnRenamed("p_value", "_p")
    sparse = F.col("least_expected") < 5
    return plain.join(fisher).select("statistic", "df", "least_expected", F.when(sparse, F.col("_p")).otherwise(F.col("p_value")).alias("p_value"))  # one row each


def wilcoxon(df: DataFrame, value: str, group: str, by: list[str] | None = None) -> DataFrame:
    """Rank-sum W of group 1, z with tie and continuity correction, and P.

    ``group`` is 0/1. P is exact where both groups have fewer than 50 rows and
    none tie, null where they are that small and tie, else the normal one.
    """
    by = list(by or [])
    known = df.where(F.col(value).isNotNull() & F.col(group).isNotNull())
    ranked = average_rank(known, value, by)
    ties = known.groupBy(*by, value).agg(F.count("*").alias("t")).groupBy(*by).agg(F.sum(F.col("t") * F.col("t") * F.col("t") - F.col("t")).alias("tie"))
    sums = ranked.groupBy(*by).agg(
        F.sum(F.when(F.col(group) == 1, F.col("avg_rank"))).alias("r1"), F.sum((F.col(group) == 1).cast("bigint")).alias("n1"), F.sum((F.col(group) == 0).cast("bigint")).alias("n0")
    )
    j = sums.join(ties, by) if by else sums.crossJoin(ties)  # one row each
    n = F.col("n1") + F.col("n0")
    w = F.col("r1") - F.col("n1") * (F.col("n1") + 1) / 2.0
    mean = F.col("n1") * F.col("n0") / 2.0
    sd = F.sqrt(F.col("n1") * F.col("n0") / 12.0 * ((n + 1) - F.try_divide(F.col("tie").cast("double"), n * (n - 1))))
    z = F.try_divide(F.col("w") - mean - F.signum(F.col("w") - mean) * 0.5, sd)
    out = j.withColumn("w", w).withColumn("z", z).withColumn("small", (F.col("n1") < 50) & (F.col("n0") < 50)).withColumn("tied", F.col("tie") > 0)
    exact = rank_sum_p(F.col("w").cast("double"), F.when(F.col("small") & ~F.col("tied"), F.col("n1")), F.col("n0"))
    return out.withColumn("p_value", F.when(~F.col("small"), normal_p("z")).when(~F.col("tied"), exact)).select(*by, "n1", "n0", "w", "z", "small", "tied", "p_value")


def spearman(df: DataFrame, x: str, y: str, by: list[str] | None = None, name: str = "rho") -> DataFrame:
    """Spearman's correlation; 0 where it is undefined."""
    by = list(by or [])
    known = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    ranked = average_rank(average_rank(known, x, by, "_rx"), y, by, "_ry")
    return ranked.groupBy(*by).agg(F.coalesce(safe_corr(F.col("_rx"), F.col("_ry")), F.lit(0.0)).alias(name))


def with_correlation_p(df: DataFrame, r: str, n: str, cap: float = 15.0) -> DataFrame:
    """``t`` and the capped ``-log10`` P of a correlation, computed in log space."""
    from tessera.functions.scalars import correlation_t

    out = df.withColumn("t", correlation_t(F.col(r), F.col(n)))
    return out.withColumn("nlp", F.least(-t_log10_p("t", (F.col(n) - 2).cast("double")), F.lit(cap)))


def permutation_p(log: DataFrame, statistic: str, permutations: int) -> DataFrame:
    """(1 + permutations at least as large) / (1 + permutations), on each permutation's largest block.

    ``log`` has no row for a permutation without a block, so how many were run
    has to be said; such a one is smaller than any. Without an observed block
    P is 1.
    """
    tops = log.groupBy("perm_id").agg(F.max(statistic).alias("s"))
    seen = tops.agg(F.max(F.when(F.col("perm_id") == 0, F.col("s"))).alias("observed"), F.collect_list(F.when(F.col("perm_id") > 0, F.col("s"))).alias("rest"))
    larger = F.when(F.col("observed").isNull(), F.lit(permutations)).otherwise(F.size(F.filter("rest", lambda v: v >= F.col("observed"))))
    return seen.select("observed", F.lit(permutations).cast("bigint").alias("permutations"), ((1 + larger) / F.lit(1.0 + permutations)).alias("p_value"))
