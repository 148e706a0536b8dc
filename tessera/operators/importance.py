"""Feature importance: attributions, directions, agreement between models."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.ordered import join_on, total_rank
from tessera.operators.quantiles import quantiles_interpolated


def linear_attributions(features: DataFrame, coefficients: DataFrame, key: str) -> DataFrame:
    """``(key, feature, value, attribution)``: exact for linear models, coefficient times distance from the mean."""
    mean = F.avg("value").over(Window.partitionBy("feature"))
    return features.join(coefficients, "feature").select(key, "feature", "value", (F.col("coefficient") * (F.col("value") - mean)).alias("attribution"))


def sampled_attributions(rows: DataFrame, key: str, names: list[str], predict, background: np.ndarray, permutations: int = 16, seed: int = 1) -> DataFrame:
    """Permutation-sampled Shapley values of any model: ``rows(key, features array)`` to the long form.

    Every permutation is walked forwards and backwards from every row of the
    background, so attributions add up to the prediction less the background's
    mean prediction. ``predict`` maps a matrix to a vector; the background is a
    bounded sample of rows.
    """
    rng = np.random.default_rng(seed)
    orders = [rng.permutation(len(names)) for _ in range(permutations)]
    step = max(1, (1 << 19) // background.size)

    def run(batches):
        for pdf in batches:
            x = np.stack(pdf["features"].to_numpy()) if len(pdf) else np.empty((0, len(names)))
            total = np.zeros_like(x, dtype=float)
            for at in range(0, len(x), step):
                part, out = x[at : at + step], total[at : at + step]
                for order in orders:
                    for walk in (order, order[::-1]):
                        z = np.tile(background, (len(part), 1, 1))
                        mean = lambda z=z: predict(z.reshape(-1, len(names))).reshape(z.shape[:2]).mean(axis=1)
                        last = mean()
                        for f in walk:
                            z[:, :, f] = part[:, None, f]
                            now = mean()
                            out[:, f] += now - last
                            last = now
            total /= 2 * permutations
            yield pd.DataFrame({key: np.repeat(pdf[key].to_numpy(), len(names)), "feature": names * len(x), "value": x.ravel(), "attribution": total.ravel()})

    kind = dict(rows.dtypes)[key]
    return rows.select(key, "features").mapInPandas(run, f"{key} {kind}, feature string, value double, attribution double")


def towards_event(attributions: DataFrame, model: str, survival: list[str]) -> DataFrame:
    """Attributions as shifts of the event's risk: those of models that were explained on its complement change sign."""
    return attributions.withColumn("attribution", F.when(F.col(model).isin(survival), F.lit(0.0) - F.col("attribution")).otherwise(F.col("attribution")))


def mean_importance(attributions: DataFrame, by: list[str], top: int = 100) -> DataFrame:
    """``(by, feature, importance, rank)``: mean absolute attribution, the ``top`` features."""
    imp = attributions.groupBy(*by, "feature").agg(F.avg(F.abs("attribution")).alias("importance"))
    imp = imp if by else imp.orderBy(F.desc("importance"), "feature").limit(top)
    w = (Window.partitionBy(*by) if by else Window.partitionBy(F.lit(1))).orderBy(F.desc("importance"), "feature")  # of all groups together, the top rows
    return imp.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top)


def coefficient_importance(coefficients: DataFrame) -> DataFrame:
    """Coefficients that are not zero, by size."""
    sized = coefficients.where("coefficient <> 0").withColumn("_size", F.abs("coefficient"))
    return total_rank(sized, "_size", "feature", descending=True).drop("_size")


def directions(attributions: DataFrame, by: list[str], threshold: float = 0.0, labels=("Adverse", "Protective", "Neutral")) -> DataFrame:
    """``(by, feature, contrast, direction)``: mean attribution of the top quarter of values less the bottom's.

    Fewer than four rows, or quartiles that coincide, fall back on the mean
    attribution. Without any attribution the direction is "Unknown".
    """
    keys = [*by, "feature"]
    q = quantiles_interpolated(attributions, "value", [0.25, 0.75], keys).withColumnsRenamed({"q25": "_q1", "q75": "_q3"})
    q = join_on(attributions.groupBy(*keys).agg(F.count("value").alias("_n")), q, keys, "left")
    j = join_on(attributions, q, keys)
    s = j.groupBy(*keys).agg(
        F.avg(F.when(F.col("value") >= F.col("_q3"), F.col("attribution"))).alias("_top"), F.avg(F.when(F.col("value") <= F.col("_q1"), F.col("attribution"))).alias("_low"),
        F.avg("attribution").alias("_mean"), F.first("_n").alias("_n"), F.first("_q1").alias("_q1"), F.first("_q3").alias("_q3"),
    )
    contrast = F.when((F.col("_n") < 4) | (F.col("_q1") >= F.col("_q3")), F.col("_mean")).otherwise(F.col("_top") - F.col("_low"))
    label = F.when(F.col("contrast").isNull(), "Unknown").when(F.col("contrast") > threshold, labels[0]).when(F.col("contrast") < -threshold, labels[1]).otherwise(labels[2])
    return s.select(*keys, contrast.alias("contrast")).withColumn("direction", label)


def overlap(a: DataFrame, b: DataFrame, tops=(20, 50, 100)) -> DataFrame:
    """``(top_n, overlap, overlap_pct, concordant, concordant_pct)`` of two rankings ``(feature, rank, direction)``."""
    j = a.select("feature", F.col("rank").alias("ra"), F.col("direction").alias("da")).join(b.select("feature", F.col("rank").alias("rb"), F.col("direction").alias("db")), "feature")
    j = j.withColumn("top_n", F.explode(F.array(*map(F.lit, tops))))
    both = (F.col("ra") <= F.col("top_n")) & (F.col("rb") <= F.col("top_n"))
    out = j.groupBy("top_n").agg(F.sum(both.cast("bigint")).alias("overlap"), F.sum((both & (F.col("da") == F.col("db"))).cast("bigint")).alias("concordant"))
    return out.select("top_n", "overlap", (100.0 * F.col("overlap") / F.col("top_n")).alias("overlap_pct"), "concordant", F.try_divide(100.0 * F.col("concordant"), F.col("overlap").cast("double")).alias("concordant_pct"))


def shared_top(a: DataFrame, b: DataFrame, n: int = 20) -> DataFrame:
    """Features that both rankings have among their first ``n``, by mean rank, with importances scaled to their model's largest."""
    def own(df, side):
        top = df.agg(F.max("importance").alias("_top"))  # one row
        return df.join(top).select("feature", F.col("rank").alias(f"rank_{side}"), F.try_divide("importance", "_top").alias(f"scaled_{side}")).where(F.col(f"rank_{side}") <= n)

    j = own(a, "a").join(own(b, "b"), "feature")
    return j.withColumn("mean_rank", (F.col("rank_a") + F.col("rank_b")) / 2.0)


def merged_ranks(a: DataFrame, b: DataFrame) -> DataFrame:
    """Both rankings side by side, with features that only one has."""
    return a.select("feature", F.col("rank").alias("rank_a")).join(b.select("feature", F.col("rank").alias("rank_b")), "feature", "full")
