"""Bias correction on simulated counts: planted shifts of samples and groups come back."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import composition, recodes


@pytest.fixture(scope="module")
def planted(spark):
    """150 taxa in 36 samples of two batches and two sites; a fifth of the taxa is more common at one site."""
    rng = np.random.default_rng(5)
    taxa, samples = 150, 36
    level, effect = rng.normal(6, 1, taxa), np.where(np.arange(taxa) % 5 == 0, 2.5, 0.0)
    batch, site = np.arange(samples) % 2, np.arange(samples) // 2 % 2
    shift = rng.normal(0, 0.3, samples) - 1.2 * site + 0.5 * batch
    rows = []
    for s in range(samples):
        for t in range(taxa):
            count = rng.poisson(np.exp(level[t] + effect[t] * site[s] + shift[s] + rng.normal(0, 0.2)))
            if rng.random() > 0.05:
                rows.append((f"s{s:02d}", f"t{t:03d}", int(count), f"b{batch[s]}", f"site{site[s]}"))
    df = spark.createDataFrame(rows, "sample string, taxon string, n bigint, batch string, site string").repartition(4).cache()
    return df, {f"s{s:02d}": shift[s] for s in range(samples)}, {f"t{t:03d}": effect[t] for t in range(taxa)}


def group_difference(out, effects):
    """Mean difference between sites of taxa that do not differ, and of those that do."""
    by = {}
    for r in out.where("n > 0").groupBy("taxon", "site").agg(F.avg("log_corrected").alias("m")).collect():
        by.setdefault(r.taxon, {})[r.site] = r.m
    d = {t: v["site1"] - v["site0"] for t, v in by.items() if len(v) == 2}
    return np.mean([d[t] for t in d if not effects[t]]), np.mean([d[t] for t in d if effects[t]])


def test_planted_shifts_come_back_where_one_step_misses_them(planted):
    df, shift, effects = planted
    fit = composition.fit_bias(df, "sample", "taxon", "n", ["batch", "site"])
    assert fit.names == ["(all)", "batch=b1", "site=site1"] and fit.rounds < 20 and fit.mix_rounds < 100
    got = {r["sample"]: r["shift"] for r in fit.samples.collect()}
    error = np.array([got[s] - shift[s] for s in sorted(shift)])
    assert np.abs(error - error.mean()).max() < 0.1  # all but a constant
    still, moved = group_difference(composition.bias_corrected(df, "sample", "taxon", "n", ["batch", "site"]), effects)
    assert abs(still) < 0.1 and abs(moved - 2.5) < 0.15
    off, _ = group_difference(recodes.bias_corrected_log(df, "sample", "taxon", "n", ["batch", "site"]), effects)
    assert abs(off) > 0.4


def test_settled(planted):
    """More rounds and a finer tolerance move nothing."""
    df, _, _ = planted
    one = composition.fit_bias(df, "sample", "taxon", "n", ["site"])
    two = composition.fit_bias(df, "sample", "taxon", "n", ["site"], tolerance=1e-7, rounds=60)
    assert abs(one.bias["site=site1"] - two.bias["site=site1"]) < 0.01 and two.rounds < 60
    a, b = ({r["sample"]: r["shift"] for r in f.samples.collect()} for f in (one, two))
    assert max(abs(a[s] - b[s]) for s in a) < 0.02


def test_mixture_against_arrays(spark):
    rng = np.random.default_rng(2)
    b = np.concatenate([rng.normal(0.7, 0.2, 400), rng.normal(-2, 0.5, 40), rng.normal(4, 0.6, 60)])
    v = np.full(len(b), 0.04)
    df = spark.createDataFrame([(k, float(x + k), float(y)) for k in (1, 2) for x, y in zip(b, v)], "k int, b double, v double").cache()
    got, rounds = composition.mixture_centres(df)
    assert abs(got[1] - 1.7) < 0.05 and abs(got[2] - 2.7) < 0.05 and rounds < 100


def test_odd_counts(spark):
    df = spark.createDataFrame([("a", "t", 0, "x"), ("a", "u", 3, "x"), ("b", "t", None, "x"), ("b", "u", 5, None), ("c", "t", 0, "x")], "sample string, taxon string, n int, g string")
    out = {(r["sample"], r.taxon): r for r in composition.bias_corrected(df, "sample", "taxon", "n", ["g"]).collect()}
    assert len(out) == 5 and out["a", "t"].abundance == 0 and out["c", "t"].log_corrected is None and out["a", "u"].log_corrected is not None
    plain = composition.fit_bias(df, "sample", "taxon", "n", [])
    assert plain.bias == {} and {r["sample"] for r in plain.samples.collect()} == {"a", "b"}
