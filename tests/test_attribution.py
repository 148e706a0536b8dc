"""Shapley values of fitted trees against enumerating all subsets of features."""

from __future__ import annotations

import itertools
import math

import numpy as np
import pytest
from pyspark.ml.classification import DecisionTreeClassifier, GBTClassifier, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler, VectorIndexer
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import functions as F

from tessera.operators import attribution
from tessera.sources.folders import own_folder

WIDTH = 8
NAMES = [f"f{k}" for k in range(WIDTH)]


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(4)
    x = np.round(rng.random((160, WIDTH)), 2)
    x[:, 6] = rng.integers(0, 4, 160)  # a category
    x[:, 7] = 0.5
    y = ((x[:, 0] + x[:, 1] * x[:, 2] - (x[:, 6] == 2) + rng.normal(0, 0.2, 160)) > 0.5).astype(float)
    df = spark.createDataFrame([(k, *map(float, r), float(t)) for k, (r, t) in enumerate(zip(x, y))], ["id", *NAMES, "label"])
    df = VectorAssembler(inputCols=NAMES, outputCol="raw").transform(df)
    return VectorIndexer(inputCol="raw", outputCol="features", maxCategories=5).fit(df).transform(df).select("id", "features", "label").cache()


MODELS = {
    "tree": lambda: DecisionTreeClassifier(maxDepth=4, seed=1), "forest": lambda: RandomForestClassifier(numTrees=5, maxDepth=5, seed=2, featureSubsetStrategy="all"),
    "boosted": lambda: GBTClassifier(maxIter=5, maxDepth=3, seed=3), "regression": lambda: RandomForestRegressor(numTrees=3, maxDepth=4, seed=4),
}


def enumerated(nodes, x):
    """Shapley values by definition: the tree's value for every subset of known features."""
    by = {}
    for n in nodes:
        by.setdefault(n["tree"], {})[n["id"]] = n

    def value(tree, at, known):
        n = tree[at]
        if n["left"] < 0:
            return n["value"]
        a, b = tree[n["left"]], tree[n["right"]]
        if n["feature"] in known:
            left = x[n["feature"]] <= n["split"][0] if n["categories"] < 0 else x[n["feature"]] in n["split"]
            return value(tree, n["left"] if left else n["right"], known)
        return (a["rows"] * value(tree, n["left"], known) + b["rows"] * value(tree, n["right"], known)) / n["rows"]

    total = {s: sum(value(t, 0, s) for t in by.values()) for k in range(WIDTH + 1) for s in map(frozenset, itertools.combinations(range(WIDTH), k))}
    out = np.zeros(WIDTH)
    for s, v in total.items():
        for j in set(range(WIDTH)) - s:
            out[j] += math.factorial(len(s)) * math.factorial(WIDTH - len(s) - 1) / math.factorial(WIDTH) * (total[s | {j}] - v)
    return out, total[frozenset()], total[frozenset(range(WIDTH))]


@pytest.mark.parametrize("kind", MODELS)
def test_same_as_all_subsets_and_adds_up(spark, rows, kind):
    model = MODELS[kind]().fit(rows)
    nodes = attribution.node_table(model, own_folder(spark))
    long, wide = attribution.tree_attributions(rows, "id", nodes, NAMES)
    plain = nodes.collect()
    found = {}
    for r in long.collect():
        found.setdefault(r.id, {})[r.feature] = r.attribution
    margins = {r.id: r for r in wide.collect()}
    scored = model.transform(rows)
    if kind == "boosted":
        scored = scored.withColumn("m", vector_to_array("rawPrediction")[1])
    elif kind == "regression":
        scored = scored.withColumn("m", F.col("prediction"))
    else:
        scored = scored.withColumn("m", vector_to_array("probability")[1])
    for r in scored.select("id", "m", vector_to_array("features").alias("x")).collect():
        own = margins[r.id]
        assert abs(own.margin - r.m) < 1e-9 and abs(sum(found[r.id].values()) - (own.margin - own.base)) < 1e-9
        if r.id % 8 == 0:
            want, base, full = enumerated(plain, r.x)
            assert abs(base - own.base) < 1e-9 and abs(full - own.margin) < 1e-9
            assert all(abs(found[r.id].get(n, 0.0) - w) < 1e-9 for n, w in zip(NAMES, want))
    if kind == "forest":
        again, _ = attribution.tree_attributions(rows.repartition(5), "id", nodes, NAMES, leaves=7)  # worked off in parts
        for r in again.collect():
            assert abs(found[r.id][r.feature] - r.attribution) < 1e-9
        assert attribution.tree_attributions(rows.limit(0), "id", nodes, NAMES)[0].count() == 0


def test_stack_adds_up(spark, rows):
    forest, boosted = MODELS["forest"]().fit(rows), MODELS["boosted"]().fit(rows)
    a = attribution.tree_attributions(rows, "id", attribution.node_table(forest, own_folder(spark)), NAMES)
    b = attribution.tree_attributions(rows, "id", attribution.node_table(boosted, own_folder(spark)), NAMES)
    out = attribution.stacked_attributions([(*a, "probability"), (*b, "half")], [0.7, 0.4], "id")
    sums = {r.id: r.s for r in out.groupBy("id").agg(F.sum("attribution").alias("s")).collect()}
    logit = lambda p: math.log(min(max(p, 1e-6), 1 - 1e-6) / (1 - min(max(p, 1e-6), 1 - 1e-6)))
    other = {r.id: r for r in b[1].collect()}
    for r in a[1].collect():
        want = 0.7 * (logit(r.margin) - logit(r.base)) + 0.8 * (other[r.id].margin - other[r.id].base)
        assert abs(sums[r.id] - want) < 1e-9


def test_linear_predictor(spark):
    long = spark.createDataFrame([(1, "a", 1.0), (1, "b", 2.0), (2, "a", 3.0), (2, "b", 0.0)], "id int, feature string, value double")
    att, wide = attribution.linear_margins(long, spark.createDataFrame([("a", 2.0), ("b", -1.0)], "feature string, coefficient double"), "id", 0.5)
    assert {(r.id, r.feature): r.attribution for r in att.collect()} == {(1, "a"): -2.0, (1, "b"): -1.0, (2, "a"): 2.0, (2, "b"): 1.0}
    assert {(r.id, r.margin, r.base) for r in wide.collect()} == {(1, 0.5, 3.5), (2, 6.5, 3.5)}
