"""Supervised feature screening over long tables ``(id, feature, value)`` with a 0/1 outcome."""

from __future__ import annotations

import math

import numpy as np
from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.scalars import safe_corr
from tessera.functions.tails import t_p
from tessera.operators.inference import bh_adjust
from tessera.operators.quantiles import average_rank, medians


def imputed(long: DataFrame) -> DataFrame:
    """Missing values filled with the feature's exact median; 0 if it has no value at all."""
    mid = medians(long, ["value"], ["feature"]).withColumnRenamed("value", "_m")
    return long.join(mid, "feature").withColumn("value", F.coalesce("value", "_m")).drop("_m")


def two_group_stats(long: DataFrame, truth: str = "truth") -> DataFrame:
    """``(feature, n1, n0, mean1, mean0, effect, s2, df, t)``: sufficient statistics in one aggregation."""
    on = lambda k: F.when(F.col(truth) == k, F.col("value"))
    s = long.groupBy("feature").agg(
        F.count(on(1)).alias("n1"), F.count(on(0)).alias("n0"), F.avg(on(1)).alias("mean1"), F.avg(on(0)).alias("mean0"),
        F.coalesce(F.var_samp(on(1)), F.lit(0.0)).alias("_v1"), F.coalesce(F.var_samp(on(0)), F.lit(0.0)).alias("_v0"),
    )
    df = F.col("n1") + F.col("n0") - 2
    s2 = F.try_divide((F.col("n1") - 1) * F.col("_v1") + (F.col("n0") - 1) * F.col("_v0"), df)
    out = s.withColumn("effect", F.col("mean1") - F.col("mean0")).withColumn("df", df).withColumn("s2", s2)
    return out.withColumn("t", F.try_divide("effect", F.sqrt(F.col("s2") * (1 / F.col("n1") + 1 / F.col("n0"))))).drop("_v1", "_v0")


def _digamma(x: float) -> float:
    out = 0.0
    while x < 8:
        out, x = out - 1 / x, x + 1
    i = 1 / (x * x)
    return out + math.log(x) - 0.5 / x - i * (1 / 12 - i * (1 / 120 - i * (1 / 252 - i / 240)))


def _trigamma(x: float) -> float:
    out = 0.0
    while x < 8:
        out, x = out + 1 / (x * x), x + 1
    i = 1 / (x * x)
    return out + 1 / x + i / 2 + i / x * (1 / 6 - i * (1 / 30 - i * (1 / 42 - i / 30)))


def variance_prior(stats: DataFrame) -> tuple[float, float]:
    """Degrees of freedom and scale of the prior of variances, by matching moments of their logarithms."""
    r = stats.where("s2 > 0 AND df > 0").agg(F.avg(F.ln("s2")).alias("m"), F.var_samp(F.ln("s2")).alias("v"), F.avg("df").alias("d")).first()
    if r["m"] is None:
        return 0.0, 0.0
    half = r["d"] / 2
    mean, rest = r["m"] - _digamma(half) + math.log(half), (r["v"] or 0.0) - _trigamma(half)
    if rest <= 0:
        return math.inf, math.exp(mean)
    low, high = 1e-8, 1e8  # trigamma falls from infinity to zero
    for _ in range(200):
        mid = math.sqrt(low * high)
        low, high = (mid, high) if _trigamma(mid) > rest else (low, mid)
    d0 = 2 * low
    return d0, math.exp(mean + _digamma(d0 / 2) - math.log(d0 / 2))


def moderated_t(long: DataFrame, truth: str = "truth") -> DataFrame:
    """``two_group_stats`` with variances shrunk to a common prior: ``t_moderated, p_value, p_adj``."""
    s = two_group_stats(imputed(long), truth)
    d0, s0 = variance_prior(s)
    if math.isinf(d0):
        post, df = F.lit(s0), F.lit(1e8)
    else:
        post, df = (d0 * F.lit(s0) + F.col("df") * F.col("s2")) / (d0 + F.col("df")), F.col("df") + d0
    out = s.withColumn("t_moderated", F.try_divide("effect", F.sqrt(post * (1 / F.col("n1") + 1 / F.col("n0")))))
    return bh_adjust(out.withColumn("p_value", t_p("t_moderated", df.cast("double"))), "p_value", [])


def screen_moderated(long: DataFrame, alpha: float = 0.05, least: int = 2, fallback: int = 50, truth: str = "truth") -> DataFrame:
    """Features below ``alpha`` after adjustment; if fewer than ``least``, the ``fallback`` smallest P values."""
    tested = moderated_t(long, truth)
    hits = tested.agg(F.count(F.when(F.col("p_adj") < alpha, 1)).alias("_h"))
    first = tested.orderBy(F.col("p_value").asc_nulls_last(), "feature").limit(fallback).select("feature", F.lit(True).alias("_first"))
    ranked = tested.join(hits).join(first, "feature", "left")  # one row of hits
    return ranked.where(F.when(F.col("_h") < least, F.coalesce("_first", F.lit(False))).otherwise(F.col("p_adj") < alpha)).drop("_h", "_first")


def sis_size(n: int, cap: int = 200) -> int:
    return max(1, min(cap, int(n // math.log(n)))) if n > 1 else 1


def screen_sis(long: DataFrame, k: int, rank_based: bool = True, truth: str = "truth") -> DataFrame:
    """``(feature, score, rank)``: the ``k`` largest absolute correlations with the outcome; undefined ones score 0."""
    known = long.where("value IS NOT NULL")
    if rank_based:
        known = average_rank(average_rank(known, "value", ["feature"], "_x"), truth, ["feature"], "_y")
    else:
        known = known.withColumn("_x", F.col("value")).withColumn("_y", F.col(truth).cast("double"))
    s = known.groupBy("feature").agg(F.abs(F.coalesce(safe_corr(F.col("_x"), F.col("_y")), F.lit(0.0))).alias("score"))
    best = s.orderBy(F.desc(F.round("score", 12)), "feature").limit(k)
    return best.withColumn("rank", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(F.desc(F.round("score", 12)), "feature")))  # k rows


def screen_mrmr(long: DataFrame, k: int, id_col: str, truth: str = "truth") -> list[str]:
    """``k`` features, one by one: most information on the outcome less the mean shared with those chosen.

    Information is -ln(1 - r^2) / 2 of Pearson's r. The greedy walk goes over
    all features: a step needs the correlations with the feature chosen last
    only, so there are ``k`` passes and no full matrix.
    """
    filled = imputed(long).persist()
    try:
        info = lambda r: -0.5 * math.log(max(1 - min(1.0, abs(0.0 if r is None or math.isnan(r) else r)) ** 2, 1e-12))
        r = {x["feature"]: x["r"] for x in filled.groupBy("feature").agg(safe_corr(F.col("value"), F.col(truth)).alias("r")).collect()}
        names, chosen = sorted(r), []
        rel, shared = np.array([info(r[f]) for f in names]), np.zeros(len(names))
        while len(chosen) < min(k, len(names)):
            score = rel - shared / max(1, len(chosen))
            score[chosen] = -np.inf
            chosen.append(int(np.argmax(score)))
            if len(chosen) < min(k, len(names)):
                last = filled.where(F.col("feature") == names[chosen[-1]]).select(id_col, F.col("value").alias("_last"))
                pairs = filled.join(last, id_col).groupBy("feature").agg(safe_corr(F.col("value"), F.col("_last")).alias("r"))
                r = {x["feature"]: x["r"] for x in pairs.collect()}
                shared += [info(r.get(f)) for f in names]
        return [names[i] for i in chosen]
    finally:
        filled.unpersist()


def selection_frequency(tuning: DataFrame, by: list[str]) -> DataFrame:
    """How many folds chose each feature, the most frequent first, ties by name."""
    return tuning.select(*by, F.explode("selected_features").alias("feature")).groupBy(*by, "feature").agg(F.count("*").alias("n")).orderBy(*by, F.desc("n"), "feature")


def plan_grid(layers: DataFrame, specs: DataFrame) -> DataFrame:
    """Every layer with every screening specification: the run's plan, a few rows."""
    return layers.crossJoin(specs)


class _ScreenParams(Params):
    inputCol = Param(Params._dummy(), "inputCol", "array of features", TypeConverters.toString)
    outputCol = Param(Params._dummy(), "outputCol", "array of the chosen features", TypeConverters.toString)
    labelCol = Param(Params._dummy(), "labelCol", "0/1 outcome", TypeConverters.toString)
    k = Param(Params._dummy(), "k", "features to keep", TypeConverters.toInt)


class CorrelationScreen(Estimator, _ScreenParams, DefaultParamsReadable, DefaultParamsWritable):
    """Keeps the ``k`` features most correlated with the outcome; learnt on what ``fit`` sees and nothing else."""

    @keyword_only
    def __init__(self, *, inputCol="features", outputCol="screened", labelCol="label", k=10):
        super().__init__()
        self._setDefault(inputCol="features", outputCol="screened", labelCol="label", k=10)
        self._set(**self._input_kwargs)

    def _fit(self, df: DataFrame) -> CorrelationScreenModel:
        x, y = self.getOrDefault(self.inputCol), F.col(self.getOrDefault(self.labelCol)).cast("double")
        s = df.select(F.posexplode(x).alias("i", "v"), y.alias("y")).groupBy("i").agg(F.abs(F.coalesce(safe_corr(F.col("v"), F.col("y")), F.lit(0.0))).alias("r"))
        keep = sorted(r["i"] for r in s.orderBy(F.desc(F.round("r", 12)), "i").limit(self.getOrDefault(self.k)).collect())
        model = CorrelationScreenModel(chosen=keep)
        return model._set(inputCol=x, outputCol=self.getOrDefault(self.outputCol))


class CorrelationScreenModel(Model, _ScreenParams, DefaultParamsReadable, DefaultParamsWritable):
    chosen = Param(Params._dummy(), "chosen", "positions kept", TypeConverters.toListInt)

    @keyword_only
    def __init__(self, *, chosen=None):
        super().__init__()
        self._set(chosen=chosen or [])

    def _transform(self, df: DataFrame) -> DataFrame:
        x = F.col(self.getOrDefault(self.inputCol))
        return df.withColumn(self.getOrDefault(self.outputCol), F.array(*[F.get(x, F.lit(i)) for i in self.getOrDefault(self.chosen)]))
