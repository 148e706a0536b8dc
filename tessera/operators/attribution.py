"""Exact Shapley values of fitted trees, forests, boosted trees and stacks of them.

A tree's value where only some features are known is the mean over its leaves,
each weighed by the shares of rows that go its way at the splits on unknown
features. On one leaf's path that is a product over the path's features, so a
feature's Shapley value is an integral of a polynomial in one variable, which
a few Gauss-Legendre nodes give exactly: no subsets are enumerated, and a leaf
costs its depth squared. Leaves add up, so a model of any size is worked off in
parts of a bounded number of leaves.
"""

from __future__ import annotations

import math
from collections import defaultdict

import numpy as np
import pandas as pd
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.sources.folders import forget, own_folder

#: Leaves that travel to the tasks together, and numbers that a task holds at a time for a batch of rows.
LEAVES, CELLS = 50_000, 1 << 21
PATHS = "tree int, leaf int, value double, feature array<int>, low array<double>, high array<double>, left array<array<double>>, inside array<boolean>, share array<double>"


def node_table(model, folder: str) -> DataFrame:
    """``(tree, id, left, right, feature, split, categories, value, rows)`` of a fitted tree model of MLlib, written to ``folder``.

    ``value`` is what a leaf adds to the model's margin: to the probability of
    class 1 for classifying trees and forests, to half the log odds for
    boosted ones, to the prediction for regressions. A split is a threshold,
    or the categories that go left.
    """
    from pyspark.sql import SparkSession

    spark = SparkSession.active()
    model.write().overwrite().save(folder)
    data = spark.read.parquet(f"{folder}/data")
    if "nodeData" not in data.columns:  # a single tree
        data = data.select(F.lit(0).alias("treeID"), F.struct(*data.columns).alias("nodeData"))
    boosted = type(model).__name__.startswith("GBT")
    n = data.select("nodeData").schema[0].dataType.names
    stats = F.col("nodeData.impurityStats")
    classes = not boosted and "Classification" in type(model).__name__
    own = stats[1] / F.aggregate(stats, F.lit(0.0), lambda a, b: a + b) if classes else F.col("nodeData.prediction")
    weights = list(model.treeWeights) if boosted else [1.0 / max(1, getattr(model, "getNumTrees", 1) or 1)]
    weight = F.element_at(F.array(*map(F.lit, weights)), F.col("treeID") + 1) if boosted else F.lit(weights[0])
    assert "rawCount" in n
    return data.select(
        F.col("treeID").cast("int").alias("tree"), F.col("nodeData.id").alias("id"), F.col("nodeData.leftChild").alias("left"), F.col("nodeData.rightChild").alias("right"),
        F.col("nodeData.split.featureIndex").alias("feature"), F.col("nodeData.split.leftCategoriesOrThreshold").alias("split"),
        F.col("nodeData.split.numCategories").alias("categories"), (own * weight).alias("value"), F.col("nodeData.rawCount").cast("double").alias("rows"),
    )


def _paths_of(pdf: pd.DataFrame) -> pd.DataFrame:
    """A row for each leaf of one tree: the conditions on its way, one for each feature."""
    node = {r.id: r for r in pdf.itertuples(index=False)}
    out, todo = [], [(0, {})]
    while todo:
        at, way = todo.pop()
        r = node[at]
        if r.left < 0:
            names = sorted(way)
            columns = list(zip(*(way[f] for f in names))) if names else [()] * 5
            out.append((r.tree, at, r.value, names, *map(list, columns)))
            continue
        for child, goes_left in ((r.left, True), (r.right, False)):
            low, high, left, inside, share = way.get(r.feature, (-math.inf, math.inf, None, True, 1.0))
            share *= node[child].rows / r.rows if r.rows else 0.5
            if r.categories < 0:
                low, high = (low, min(high, r.split[0])) if goes_left else (max(low, r.split[0]), high)
            else:  # the categories that pass all splits so far, named or excluded
                now = set(map(float, r.split))
                if left is None:
                    left, inside = now, goes_left
                elif goes_left:
                    left, inside = (set(left) & now, True) if inside else (now - set(left), True)
                else:
                    left, inside = (set(left) - now, True) if inside else (set(left) | now, False)
                left = sorted(left)
            todo.append((child, way | {r.feature: (low, high, left, inside, share)}))
    return pd.DataFrame(out, columns=["tree", "leaf", "value", "feature", "low", "high", "left", "inside", "share"])


def leaf_paths(nodes: DataFrame) -> DataFrame:
    """The leaves of every tree with their conditions; one tree is one group."""
    return nodes.groupBy("tree").applyInPandas(_paths_of, PATHS)


class Leaves:
    """Some leaves as arrays, by how many features their paths have."""

    def __init__(self, rows):
        groups = defaultdict(list)
        self.base = 0.0
        for r in rows:
            self.base += r["value"] * math.prod(r["share"])
            groups[len(r["feature"])].append(r)
        self.constant = sum(r["value"] for r in groups.pop(0, []))
        self.groups = []
        for d, own in sorted(groups.items()):
            cols = [np.array([r[c] for r in own], float).reshape(-1, d) for c in ("low", "high", "share")]
            sets = [(i, j, np.array(r["left"][j], float), r["inside"][j]) for i, r in enumerate(own) for j in range(d) if r["left"][j] is not None]
            self.groups.append((np.array([r["feature"] for r in own], int).reshape(-1, d), *cols, np.array([r["value"] for r in own]), sets))
        self.used = np.unique(np.concatenate([g[0].ravel() for g in self.groups])) if self.groups else np.zeros(0, int)

    def __call__(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of rows: attributions of the used features, and what the leaves add to the margin."""
        out, margin = np.zeros((len(x), len(self.used))), np.full(len(x), float(self.constant))
        for feature, low, high, share, value, sets in self.groups:
            d = feature.shape[1]
            nodes, weights = np.polynomial.legendre.leggauss((d + 1) // 2)
            nodes, weights = (nodes + 1) / 2, weights / 2
            step = max(1, CELLS // max(1, len(x) * d))
            for at in range(0, len(feature), step):
                f, z, v = feature[at : at + step], share[at : at + step], value[at : at + step]
                own = x[:, f]
                passes = (own <= high[at : at + step]) & ~(own <= low[at : at + step])
                for i, j, names, inside in sets:
                    if at <= i < at + step:
                        passes[:, i - at, j] &= np.isin(own[:, i - at, j], names) == inside
                o = passes.astype(float)
                margin += passes.all(axis=2) @ v
                total = np.zeros_like(o)
                for t, w in zip(nodes, weights):
                    p = z * (1 - t) + o * t
                    total += w * p.prod(axis=2, keepdims=True) / np.where(p == 0, 1.0, p)
                total *= (o - z) * v[:, None]
                flat = np.searchsorted(self.used, f.ravel())
                order = np.argsort(flat, kind="stable")
                begins = np.flatnonzero(np.diff(flat[order], prepend=-1))
                out[:, flat[order][begins]] += np.add.reduceat(total.reshape(len(x), -1)[:, order], begins, axis=1)
        return out, margin


def _parts(paths: DataFrame, leaves: int):
    """The leaves in parts of about ``leaves``, dealt by hash."""
    count = paths.count()
    k = max(1, -(-count // leaves))
    for part in range(k):
        yield Leaves(paths.where(F.pmod(F.xxhash64("tree", "leaf"), F.lit(k)) == part).orderBy("tree", "leaf").collect())


def _as_array(rows: DataFrame, features: str) -> DataFrame:
    kind = dict(rows.dtypes)[features]
    return rows if kind.startswith("array") else rows.withColumn(features, vector_to_array(features))


def tree_attributions(rows: DataFrame, key: str, nodes: DataFrame, names: list[str], features: str = "features", leaves: int = LEAVES) -> tuple[DataFrame, DataFrame]:
    """Shapley values of a tree model: ``(key, feature, value, attribution)`` and ``(key, margin, base)``.

    ``rows`` have a key of their own each and ``features`` as an array or a
    vector, ``nodes`` are as ``node_table`` gives them. A row's attributions
    add up to its margin less the base, the model's mean over its training
    rows. Features that no split uses have no rows: theirs are zero.
    """
    spark = rows.sparkSession
    folder = own_folder(spark)
    leaf_paths(nodes).write.parquet(folder)
    paths = spark.read.parquet(folder)
    rows = _as_array(rows, features).select(key, F.col(features).alias("_x"))
    kind = dict(rows.dtypes)[key]

    def part_of(model: Leaves):
        def attributed(batches):
            for pdf in batches:
                x = np.stack(pdf["_x"].to_numpy()) if len(pdf) else np.zeros((0, len(names)))
                found, own = model(x)[0], [names[k] for k in model.used]
                yield pd.DataFrame({key: np.repeat(pdf[key].to_numpy(), len(own)), "feature": own * len(x), "value": x[:, model.used].ravel(), "attribution": found.ravel()})

        def margins(batches):
            for pdf in batches:
                x = np.stack(pdf["_x"].to_numpy()) if len(pdf) else np.zeros((0, len(names)))
                yield pd.DataFrame({key: pdf[key].to_numpy(), "margin": model(x)[1], "base": model.base})

        return rows.mapInPandas(attributed, f"{key} {kind}, feature string, value double, attribution double"), rows.mapInPandas(margins, f"{key} {kind}, margin double, base double")

    long = wide = None
    parts = 0
    for model in _parts(paths, leaves):
        a, m = part_of(model)
        long, wide = (a, m) if long is None else (long.unionByName(a), wide.unionByName(m))
        parts += 1
    forget(spark, folder)
    if parts > 1:
        long = long.groupBy(key, "feature").agg(F.first("value").alias("value"), F.sum("attribution").alias("attribution"))
        wide = wide.groupBy(key).agg(F.sum("margin").alias("margin"), F.sum("base").alias("base"))
    return long, wide


def linear_margins(features: DataFrame, coefficients: DataFrame, key: str, intercept: float) -> tuple[DataFrame, DataFrame]:
    """The same two tables of a linear predictor: coefficient times distance from the mean; ``features(key, feature, value)`` in long form."""
    j = features.join(coefficients, "feature").join(features.groupBy("feature").agg(F.avg("value").alias("_mean")), "feature")
    long = j.select(key, "feature", "value", (F.col("coefficient") * (F.col("value") - F.col("_mean"))).alias("attribution"))
    margin = F.sum(F.col("coefficient") * F.col("value")) + intercept
    wide = j.groupBy(key).agg(margin.alias("margin"), (F.sum(F.col("coefficient") * F.col("_mean")) + intercept).alias("base"))
    return long, wide


#: What a model's margin is to its log odds: a probability, half of them, or the log odds themselves.
LINKS = {"probability": lambda m: F.log(F.least(F.greatest(m, F.lit(1e-6)), F.lit(1 - 1e-6)) / (1 - F.least(F.greatest(m, F.lit(1e-6)), F.lit(1 - 1e-6)))), "half": lambda m: 2 * m, "odds": lambda m: m}


def stacked_attributions(inputs: list[tuple[DataFrame, DataFrame, str]], weights: list[float], key: str) -> DataFrame:
    """``(key, feature, value, attribution)`` of a linear stack of models' log odds, by the chain over its inputs.

    Each input is a model's two tables and the link of its margin. Its
    attributions are scaled by how steeply its log odds run between base and
    margin, and by its weight; so they add up to the stack's margin less its
    margin at the bases. Features that several models use add up.
    """
    out = None
    for (long, wide, link), weight in zip(inputs, weights):
        f = LINKS[link]
        rise = F.col("margin") - F.col("base")
        p = F.col("margin")
        slope = F.when(F.abs(rise) > 1e-12, (f(p) - f(F.col("base"))) / rise).otherwise(
            F.lit({"half": 2.0, "odds": 1.0}.get(link)) if link != "probability" else 1 / F.greatest(p * (1 - p), F.lit(1e-6))
        )
        part = long.join(wide.select(key, (slope * weight).alias("_slope")), key).select(key, "feature", "value", (F.col("attribution") * F.col("_slope")).alias("attribution"))
        out = part if out is None else out.unionByName(part)
    return out.groupBy(key, "feature").agg(F.first("value", ignorenulls=True).alias("value"), F.sum("attribution").alias("attribution"))
