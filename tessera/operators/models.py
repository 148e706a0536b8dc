"""Classifiers by MLlib: leakage-safe preparation, tuning over given folds, stacking.

Folds are tables (see ``resampling``). Screening and preparation are learnt on
analysis rows only. Fits run on the executors, several grid points side by
side; the loop over outer folds is the driver's, its size set by the
configuration rather than by the data. ``penalty`` has the elastic net's whole
paths as one job.
"""

from __future__ import annotations

import hashlib
import json
from dataclasses import dataclass, field, replace
from functools import reduce
from itertools import product
from multiprocessing.pool import ThreadPool

import numpy as np
import pandas as pd

from pyspark.ml import Pipeline
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import OneHotEncoder, StandardScaler, StringIndexer, VarianceThresholdSelector, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.scalars import logit, safe_corr
from tessera.operators.discrimination import auc
from tessera.operators.screening import screen_moderated, screen_mrmr, screen_sis
from tessera.sources.sinks import append, exists

#: Full tuning ranges of the three learners; ``thinned_grid`` makes grids of them.
ELASTIC = {"regParam": (1e-10, 1.0), "elasticNetParam": (0.0, 1.0)}
FOREST = {"numTrees": (300, 2000), "minInstancesPerNode": (2, 40)}
BOOSTED = {
    "maxIter": (500, 4000), "maxDepth": (2, 4), "stepSize": (10**-2.5, 10**-0.5), "subsamplingRate": (0.5, 0.9), "minInfoGain": (1e-4, 10.0), "featureSubsetStrategy": (10, 140),
}
#: Fits of a tuning grid that run side by side.
FITS = 4
#: Penalties of the stack, and share of the analysis rows that tells boosting when to stop.
PENALTIES, STOP_SHARE = tuple(10 ** (-10 + 12 * k / 59) for k in range(60)), 5


def min_rows_bound(n: int) -> tuple[int, int]:
    """Bounds of rows per node that leave a small analysis set room to split."""
    return 2, max(4, int(n * 0.5 * 0.25 / 2))


@dataclass(frozen=True)
class Learner:
    """A named classifier with a small grid of parameters.

    Features are columns, and of the array ``layer`` those of ``names`` that
    the screen ``(kind, size)`` picks on the analysis rows: moderated, mrmr,
    sis, or none for all of them. ``stop`` rounds without gain end boosting.
    """

    name: str
    kind: str  # elastic, forest, boosted
    numeric: tuple[str, ...] = ()
    categorical: tuple[str, ...] = ()
    grid: tuple[dict, ...] = field(default=({},))
    layer: str | None = None
    names: tuple[str, ...] = ()
    screen: tuple[str, int] | None = None
    stop: bool = False

    def estimator(self, params: dict, seed: int):
        cls = {"elastic": LogisticRegression, "forest": RandomForestClassifier, "boosted": GBTClassifier}[self.kind]
        more = {} if self.kind == "elastic" else {"seed": seed}
        if self.stop:
            more["validationIndicatorCol"] = "_stop"
        params = {k: str(v) if k == "featureSubsetStrategy" else v for k, v in params.items()}
        return cls(featuresCol="features", labelCol="label", **more, **params)


def screened(analysis: DataFrame, learner: Learner, key: str) -> tuple[str, ...]:
    """The layer's features that the learner's screen picks on these rows, in the layer's order."""
    if not learner.screen:
        return learner.names
    kind, size = learner.screen
    cells = F.explode(F.arrays_zip(F.array(*map(F.lit, learner.names)).alias("feature"), F.col(learner.layer).alias("value")))
    long = analysis.select(key, F.col("label").cast("int").alias("truth"), cells.alias("x")).select(key, "truth", F.col("x.feature").alias("feature"), F.col("x.value").cast("double").alias("value"))
    if kind == "moderated":
        picked = {r["feature"] for r in screen_moderated(long, fallback=size).select("feature").collect()}
    elif kind == "mrmr":
        picked = set(screen_mrmr(long, size, key))
    elif kind == "sis":
        picked = {r["feature"] for r in screen_sis(long, size).select("feature").collect()}
    else:
        raise ValueError(f"unknown screen {kind!r}")
    return tuple(n for n in learner.names if n in picked)


def with_features(df: DataFrame, learner: Learner, picked: tuple[str, ...]) -> tuple[DataFrame, Learner]:
    """``df`` with a column for each picked feature, and the learner that reads them."""
    if not learner.layer:
        return df, learner
    at = {n: k for k, n in enumerate(learner.names)}
    cols = {f"_f{at[n]}": F.get(F.col(learner.layer), F.lit(at[n])).cast("double") for n in picked}
    return df.withColumns(cols), replace(learner, numeric=(*learner.numeric, *cols), layer=None, names=(), screen=None)


def thinned_grid(ranges: dict, points: int = 2) -> tuple[dict, ...]:
    """``points`` values of each parameter, spaced by ratio where the range allows."""
    def values(low, high):
        out = []
        for k in range(points):
            f = k / max(1, points - 1)
            v = low * (high / low) ** f if low > 0 else low + (high - low) * f
            out.append(round(v) if isinstance(low, int) else v)
        return sorted(set(out))

    names = list(ranges)
    return tuple(dict(zip(names, combo)) for combo in product(*[values(*ranges[n]) for n in names]))


def latin_grid(ranges: dict, points: int, seed: int = 1, tries: int = 200) -> tuple[dict, ...]:
    """``points`` settings that fill the ranges: of many Latin hypercubes the one whose closest two points lie furthest apart.

    Every parameter's range is cut into as many steps as there are points, by
    ratio where the range allows, and each step is used once; md5 order of
    (seed, try, parameter, step) says which meet, so every run has the same.
    """
    names = list(ranges)

    def order(attempt, name):
        return np.argsort([hashlib.md5(f"{seed}|{attempt}|{name}|{k}".encode()).hexdigest() for k in range(points)])

    def closest(cube):
        gaps = ((cube[:, None] - cube[None]) ** 2).sum(axis=2)
        return gaps[np.triu_indices(points, 1)].min() if points > 1 else 0.0

    cubes = (np.stack([(order(t, n) + 0.5) / points for n in names], axis=1) for t in range(tries))
    best = max(cubes, key=closest)

    def value(low, high, f):
        v = low * (high / low) ** f if low > 0 else low + (high - low) * f
        return round(v) if isinstance(low, int) else float(v)

    return tuple({n: value(*ranges[n], f) for n, f in zip(names, row)} for row in best)


def prepared(analysis: DataFrame, assessment: DataFrame, learner: Learner) -> tuple[DataFrame, DataFrame]:
    """Both sets with a ``features`` vector, learnt on the analysis rows.

    Numbers take the exact median, categories the most frequent value (ties by
    name); then dummies, removal of constant columns, and scaling for the
    elastic net.
    """
    mids = analysis.agg(*[F.coalesce(F.median(c), F.lit(0.0)).alias(c) for c in learner.numeric]).first() if learner.numeric else {}
    modes = {}
    for c in learner.categorical:
        top = analysis.where(F.col(c).isNotNull()).groupBy(c).count().orderBy(F.desc("count"), c).limit(1).collect()
        modes[c] = top[0][c] if top else "none"
    fill = lambda df: df.withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(mids[c])) for c in learner.numeric} | {c: F.coalesce(F.col(c), F.lit(modes[c])) for c in learner.categorical})
    a, b = fill(analysis), fill(assessment)
    stages, inputs = [], list(learner.numeric)
    if learner.categorical:
        idx, hot = [f"{c}_i" for c in learner.categorical], [f"{c}_h" for c in learner.categorical]
        stages += [StringIndexer(inputCols=list(learner.categorical), outputCols=idx, handleInvalid="keep"), OneHotEncoder(inputCols=idx, outputCols=hot, dropLast=True, handleInvalid="keep")]
        inputs += hot
    last = "scaled" if learner.kind == "elastic" else "kept"
    stages += [VectorAssembler(inputCols=inputs, outputCol="raw"), VarianceThresholdSelector(featuresCol="raw", outputCol="kept", varianceThreshold=0.0)]
    if learner.kind == "elastic":
        stages.append(StandardScaler(inputCol="kept", outputCol="scaled", withMean=True))
    model = Pipeline(stages=stages).fit(a)
    return tuple(model.transform(x).withColumnRenamed(last, "features") for x in (a, b))


def fit_predict(analysis: DataFrame, assessment: DataFrame, learner: Learner, params: dict, keep: list[str], seed: int = 1, picked: tuple[str, ...] | None = None) -> DataFrame:
    """``keep`` and ``risk`` of the assessment rows; ``keep`` begins with the key. ``picked`` are a screen's features, if it has been run."""
    picked = screened(analysis, learner, keep[0]) if picked is None else picked
    (analysis, own), (assessment, _) = with_features(analysis, learner, picked), with_features(assessment, learner, picked)
    a, b = prepared(analysis, assessment, own)
    if own.stop:
        a = a.withColumn("_stop", F.pmod(F.xxhash64(F.lit(seed), keep[0]), F.lit(STOP_SHARE)) == 0)
        held = a.groupBy("_stop").agg(F.countDistinct("label").alias("n")).collect()
        if len(held) < 2 or min(r["n"] for r in held) < 2:  # too few rows to hold any back
            own = replace(own, stop=False)
    model = own.estimator(params, seed).fit(a)
    return model.transform(b).select(*keep, F.get(vector_to_array("probability"), F.lit(1)).alias("risk"))


def tune(analysis: DataFrame, inner: DataFrame, key: str, learner: Learner, seed: int = 1) -> tuple[dict, float | None, DataFrame]:
    """The grid point with the best mean AUC over inner folds, that AUC, and its out-of-fold risks.

    ``inner(key, inner_fold)``; screens are learnt anew in every inner fold.
    Without any finite AUC the first point is taken, which for the elastic net
    is the fallback to declare first.
    """
    rows = analysis.join(inner.select(key, "inner_fold"), key).persist()
    folds = sorted(r[0] for r in rows.select("inner_fold").distinct().collect())
    best = None
    keep = [key, "label", "inner_fold"]
    split = {f: (rows.where(F.col("inner_fold") != f), rows.where(F.col("inner_fold") == f)) for f in folds}

    def tried(params: dict):
        parts = [fit_predict(*split[f], learner, params, keep, seed, picked[f]) for f in folds]
        oof = reduce(DataFrame.unionByName, parts).persist()
        return params, auc(oof, ["inner_fold"], "risk", "label").agg(F.avg("auc")).first()[0], oof

    beside = inheritable_thread_target(analysis.sparkSession)
    with ThreadPool(FITS) as pool:  # fits of different points and folds run side by side
        picked = dict(zip(folds, pool.map(beside(lambda f: screened(split[f][0], learner, key)), folds)))
        found = pool.map(beside(tried), learner.grid, chunksize=1)
    for params, score, oof in found:
        if best is None or score is not None and (best[1] is None or score > best[1]):
            if best is not None:
                best[2].unpersist()
            best = (params, score, oof)
        else:
            oof.unpersist()
    best[2].count()  # held from here on, so the rows can go
    rows.unpersist()
    return best[0], best[1], best[2].select(key, "label", "inner_fold", "risk")


def nested_cv(df: DataFrame, key: str, folds: DataFrame, inner: DataFrame, learners: list[Learner], path: str, seed: int = 1) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Every row predicted once a repeat by models that never saw it: predictions, inner predictions, tuning record.

    ``(key, truth, risk, repeat_id, fold_id, model)``; the same of the outer
    analysis rows, out of their ``inner_fold``; and for every outer fold and
    model the chosen parameters, their score and the features that the screen
    picked. Learners share ``folds``; each is tuned on the inner folds of an
    outer analysis set and refitted on all of it. Each fold's tables are
    written below ``path`` as they are made, and a rerun goes on where the
    last one stopped.
    """
    spark = df.sparkSession
    tables = [f"{path}/{t}" for t in ("predictions", "inner", "tuning")]
    done = set()
    if exists(spark, tables[2]):  # written last
        done = {tuple(r) for r in spark.read.parquet(tables[2]).select("repeat_id", "fold_id", "model").distinct().collect()}
    folds, inner = folds.persist(), inner.persist()  # drawn once
    plan = sorted(tuple(r) for r in folds.select("repeat_id", "fold_id").distinct().collect())
    for repeat, fold in plan:
        left = [ln for ln in learners if (repeat, fold, ln.name) not in done]
        if not left:
            continue
        own = folds.where((F.col("repeat_id") == repeat)).select(key, "fold_id")
        rows = df.join(own, key).persist()
        try:
            analysis, assessment = rows.where(F.col("fold_id") != fold), rows.where(F.col("fold_id") == fold)
            ins = inner.where((F.col("repeat_id") == repeat) & (F.col("outer_fold") == fold))
            for ln in left:
                params, score, oof = tune(analysis, ins, key, ln, seed)
                stamp = [F.lit(repeat).alias("repeat_id"), F.lit(fold).alias("fold_id"), F.lit(ln.name).alias("model")]
                truth = F.col("label").cast("int").alias("truth")
                picked = screened(analysis, ln, key) if ln.layer else ()
                p = fit_predict(analysis, assessment, ln, params, [key, "label"], seed, picked)
                replace_part(p.select(key, truth, "risk", *stamp), tables[0], (repeat, fold, ln.name))
                replace_part(oof.select(key, truth, "risk", "inner_fold", *stamp), tables[1], (repeat, fold, ln.name))
                oof.unpersist()
                record = [(repeat, fold, ln.name, json.dumps(params, sort_keys=True), score, len(picked), list(picked))]
                append(spark.createDataFrame(record, "repeat_id int, fold_id int, model string, params string, score double, n_features int, selected_features array<string>").coalesce(1), tables[2])
        finally:
            rows.unpersist()
    folds.unpersist(), inner.unpersist()
    return tuple(spark.read.parquet(t) for t in (f"{tables[0]}/*", f"{tables[1]}/*", tables[2]))


def replace_part(df: DataFrame, table: str, part: tuple) -> None:
    """One part of a table of parts, written anew: what a broken-off run left of it goes."""
    df.write.mode("overwrite").parquet(f"{table}/part={'-'.join(str(x).replace(' ', '_') for x in part)}")


def ridge_logistic(x: np.ndarray, y: np.ndarray, penalty: float) -> np.ndarray:
    """Intercept and weights that minimise the mean log loss and penalty / 2 times the weights' squares, by Newton steps."""
    z = np.hstack([np.ones((len(x), 1)), x])
    w, ridge = np.zeros(z.shape[1]), np.full(z.shape[1], penalty)
    ridge[0] = 0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        h = (z * (p * (1 - p))[:, None]).T @ z / len(z) + np.diag(ridge + 1e-9)
        step = np.linalg.solve(h, z.T @ (p - y) / len(z) + ridge * w)
        w -= np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-9:
            break
    return w


def _rank_auc(y: np.ndarray, s: np.ndarray) -> float:
    n1, n0 = y.sum(), (1 - y).sum()
    r = pd.Series(s).rank().to_numpy()
    return (r[y == 1].sum() - n1 * (n1 + 1) / 2) / (n1 * n0) if n1 and n0 else np.nan


def stack_ridge(inner: DataFrame, outer: DataFrame, key: str, models: list[str], penalties=PENALTIES) -> tuple[DataFrame, DataFrame]:
    """Ridge-logistic stacks of the models' logit risks, one an outer fold: assessment risks and the weights.

    Both tables are as ``nested_cv`` returns them. A stack learns from the
    inner out-of-fold risks of its outer analysis set; its penalty is the one
    with the best mean AUC over the inner folds, the largest of equals. One
    fold's rows are a cohort and fit a task; folds are spread over tasks.
    """
    cols = [f"l{k}" for k in range(len(models))]
    stamp = ["repeat_id", "fold_id"]

    def wide(t, more):
        w = t.groupBy(*stamp, *more, key, "truth").pivot("model", models).agg(F.first("risk"))
        return w.select(*stamp, *more, key, "truth", *[logit(F.col(f"`{m}`")).alias(c) for m, c in zip(models, cols)])

    both = wide(inner, ["inner_fold"]).unionByName(wide(outer, []).withColumn("inner_fold", F.lit(None).cast(dict(inner.dtypes)["inner_fold"])))
    kind = dict(inner.dtypes)[key]

    def fit(pdf: pd.DataFrame):
        own = pdf[pdf["inner_fold"].notna()]
        x, y, f = own[cols].to_numpy(float), own["truth"].to_numpy(float), own["inner_fold"].to_numpy()
        mean, sd = x.mean(axis=0), x.std(axis=0)
        sd[sd == 0] = 1
        x = (x - mean) / sd

        def score(p):
            parts = [_rank_auc(y[f == k], (lambda w: w[0] + x[f == k] @ w[1:])(ridge_logistic(x[f != k], y[f != k], p))) for k in np.unique(f)]
            return np.nanmean(parts) if np.isfinite(parts).any() else -1.0

        scores = [round(score(p), 12) for p in penalties]
        best = max(range(len(penalties)), key=lambda k: (scores[k], penalties[k]))
        w = ridge_logistic(x, y, penalties[best])
        return mean, sd, w, penalties[best]

    def risks(pdf: pd.DataFrame) -> pd.DataFrame:
        mean, sd, w, _ = fit(pdf)
        held = pdf[pdf["inner_fold"].isna()]
        z = w[0] + (held[cols].to_numpy(float) - mean) / sd @ w[1:]
        return held[[*stamp, key, "truth"]].assign(risk=1 / (1 + np.exp(-z)))

    def weights(pdf: pd.DataFrame) -> pd.DataFrame:
        mean, sd, w, penalty = fit(pdf)
        b = w[1:] / sd
        ratio = abs(b[1]) / abs(b[0]) if len(b) > 1 and b[0] else None
        row = {c: pdf[c].iloc[0] for c in stamp} | {"penalty": penalty, "intercept": w[0] - float(mean @ b), "weights": [b.tolist()][0], "ratio": ratio}
        return pd.DataFrame([row])

    grouped = both.groupBy(*stamp)
    return (
        grouped.applyInPandas(risks, f"repeat_id int, fold_id int, {key} {kind}, truth int, risk double"),
        grouped.applyInPandas(weights, "repeat_id int, fold_id int, penalty double, intercept double, weights array<double>, ratio double"),
    )


def single_predictor(analysis: DataFrame, assessment: DataFrame, key: str, x: str) -> DataFrame:
    """The one-predictor logistic baseline, unpenalised."""
    from tessera.operators.discrimination import logistic_line

    line = logistic_line(analysis.select(F.col(x).cast("double").alias("x"), F.col("label").cast("double").alias("y")), [], "x", "y").first()
    return assessment.select(key, F.col("label").cast("int").alias("truth"), (1 / (1 + F.exp(-(line["intercept"] + line["slope"] * F.col(x))))).alias("risk"))


def oof_agreement(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Pearson's and Spearman's correlation of two models' risks, joined on the id."""
    from tessera.operators.quantiles import average_rank

    j = a.select(key, F.col("risk").alias("ra")).join(b.select(key, F.col("risk").alias("rb")), key)
    r = average_rank(average_rank(j, "ra", [], "qa"), "rb", [], "qb")
    return r.agg(safe_corr(F.col("ra"), F.col("rb")).alias("pearson"), safe_corr(F.col("qa"), F.col("qb")).alias("spearman"))
