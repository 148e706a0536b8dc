"""Joins, set operations and first/last/top rules with defined ties."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: Columns that a transposed table may have.
TRANSPOSED = 10_000


def require_unique(df: DataFrame, keys: list[str]) -> DataFrame:
    """``df`` unchanged; raises if a key repeats. An action, kept apart from the lazy plan."""
    if duplicates(df, keys).limit(1).count():
        raise ValueError(f"{keys} is not unique")
    return df


def duplicates(df: DataFrame, keys: list[str]) -> DataFrame:
    """``(keys, n)`` of keys with more than one row."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def reduce_left_join(base: DataFrame, others: list[DataFrame], key: str) -> DataFrame:
    """Left joins of any number of tables on one key, whose partitioning Spark reuses."""
    return reduce(lambda a, b: a.join(b, key, "left"), others, base)


def null_safe_left_join(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """A left join in which a null key meets a null key. The right side is a table of cut-points."""
    r = right.withColumnRenamed(key, "_key")
    return left.join(r, left[key].eqNullSafe(r["_key"]), "left").drop("_key")


def matched_left_join(left: DataFrame, right: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """A left join without the rows that found no partner, and those rows: ``(joined, unmatched)``."""
    marked = left.join(right.withColumn("_found", F.lit(True)), key, "left")
    return marked.where("_found").drop("_found"), marked.where("_found IS NULL").select(*left.columns)


def aligned_join(left: DataFrame, right: DataFrame, key: str, same: str) -> DataFrame:
    """An inner join of two tables that have to name the same rows with the same ``same``; raises if they do not."""
    require_unique(left, [key]), require_unique(right, [key])
    r = right.withColumnRenamed(same, "_same").withColumn("_right", F.lit(True))
    both = left.withColumn("_left", F.lit(True)).join(r, key, "full")
    faults = both.agg(
        F.count(F.when(F.col("_left").isNull() | F.col("_right").isNull(), 1)).alias("alone"),
        F.count(F.when(F.col("_left") & F.col("_right") & ~F.col(same).eqNullSafe(F.col("_same")), 1)).alias("differ"),
    ).first()
    if faults["alone"] or faults["differ"]:
        raise ValueError(f"{faults['alone']} rows on one side only, {faults['differ']} with another {same}")
    return left.join(right.drop(same), key)


def pick_columns(df: DataFrame, matching: str | None = None, all_of: tuple = (), any_of: tuple = (), without: tuple = ()) -> list[str]:
    """Column names of ``df`` by rule, in its order: by a regular expression or a list; all_of raises if one is absent."""
    absent = [c for c in all_of if c not in df.columns]
    if absent:
        raise ValueError(f"columns {absent} are not there")
    wanted = {*all_of, *any_of}
    every = matching is None and not wanted
    return [c for c in df.columns if (every or c in wanted or matching is not None and re.search(matching, c)) and c not in without]


def transposed(df: DataFrame, key: str, columns: list[str], name: str = "name") -> DataFrame:
    """Rows for ``columns`` and columns for the values of ``key``, which have to be few and unique."""
    keys = [r[0] for r in df.select(key).distinct().orderBy(key).limit(TRANSPOSED + 1).collect()]
    if len(keys) > TRANSPOSED:
        raise ValueError(f"more than {TRANSPOSED} rows do not become columns; keep them long")
    cells = F.explode(F.array(*[F.struct(F.lit(k).alias("at"), F.lit(c).alias(name), F.col(c).cast("double").alias("v")) for k, c in enumerate(columns)]))
    long = df.select(F.col(key).cast("string").alias("_key"), cells.alias("x")).select("_key", "x.*")
    return long.groupBy("at", name).pivot("_key", [str(k) for k in keys]).agg(F.first("v")).orderBy("at").drop("at")


def in_all_layers(members: DataFrame, key: str, layer: str, n_layers: int) -> DataFrame:
    """Keys that occur in every layer: one shuffle on the key for any number of layers."""
    return members.groupBy(key).agg(F.countDistinct(layer).alias("_n")).where(F.col("_n") == n_layers).select(key)


def keep_first(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def keep_last(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    return keep_first(df, keys, [F.col(c).desc() for c in order])


def top_k(df: DataFrame, k: int, order: list, by: list[str] | None = None) -> DataFrame:
    """The first ``k`` rows by ``order``, overall or in each group."""
    if not by:
        return df.orderBy(*order).limit(k)
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= k).drop("_n")


def rank_by(df: DataFrame, by: list[str], value: str, tie: str, name: str = "rank") -> DataFrame:
    """Ranks from the largest value, ties by ``tie``."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(F.col(value).desc(), tie)))


def max_normalised(df: DataFrame, by: list[str], value: str, name: str) -> DataFrame:
    return df.withColumn(name, F.try_divide(value, F.max(value).over(Window.partitionBy(*by))))


def layer_pairs(layers: DataFrame, name: str, order: str) -> DataFrame:
    """Unordered pairs of layers: a handful of rows."""
    a, b = layers.alias("a"), layers.alias("b")
    return a.join(b, F.col(f"a.{order}") < F.col(f"b.{order}")).select(F.col(f"a.{name}").alias("layer_a"), F.col(f"b.{name}").alias("layer_b"))


def stack(tables: list[DataFrame]) -> DataFrame:
    """All rows of all tables by column name; what a table lacks is null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)


def aligned(ids: DataFrame, df: DataFrame, key: str, at: str) -> DataFrame:
    """``df`` in the order of a list of ids, which carries its positions; absent ids give nulls."""
    return ids.select(key, at).join(df, key, "left").orderBy(at)


def tally(df: DataFrame, *cols: str) -> DataFrame:
    """Counts by value, the most frequent first, ties by value."""
    return df.groupBy(*cols).agg(F.count("*").alias("n")).orderBy(F.desc("n"), *cols)


def stratified_sample(df: DataFrame, by: list[str], k: int, order: Column, tie: str) -> DataFrame:
    """``k`` rows of each class in a reproducible pseudo-random order."""
    return top_k(df, k, [order, tie], by)


def table_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of either table that the other lacks, as often as they are missing, with their side."""
    b = b.select(*a.columns)
    return a.exceptAll(b).withColumn("side", F.lit("left")).unionByName(b.exceptAll(a).withColumn("side", F.lit("right")))
