"""Bias correction of compositional counts by the iterative estimator.

Log counts of a sample share an unknown shift, its sampling fraction. Weighted
least squares by taxon and mean residuals by sample are alternated until the
shifts settle; what they cannot tell apart is a shift of a whole group, which
appears in all its taxa's differences. Most taxa do not differ, so the common
shift is the centre of the middle part of a mixture of three normal
distributions, fitted to all taxa's differences by expectation maximisation.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators.quantiles import quantiles_interpolated
from tessera.sources.folders import forget, own_folder

#: When the alternation and the mixture count as settled, their rounds at most, and levels of all factors at most.
TOLERANCE, ROUNDS, MIX_TOLERANCE, MIX_ROUNDS, MOST_LEVELS = 1e-3, 20, 1e-5, 100, 200


@dataclass
class BiasFit:
    """Sample shifts, coefficients by taxon, and each group's bias against its factor's first level."""

    samples: DataFrame
    coefficients: DataFrame
    names: list[str]
    bias: dict[str, float] = field(default_factory=dict)
    rounds: int = 0
    mix_rounds: int = 0


class _Tables:
    """Tables written to the shared folder as the fit goes on, the last two of each kept."""

    def __init__(self, spark):
        self.spark, self.made = spark, {}

    def keep(self, name: str, df: DataFrame) -> DataFrame:
        path = own_folder(self.spark)
        df.write.parquet(path)
        own = self.made.setdefault(name, [])
        own.append(path)
        if len(own) > 2:
            forget(self.spark, own.pop(0))
        return self.spark.read.schema(df.schema).parquet(path)


def _design(cells: DataFrame, factors: list[str]) -> tuple[list[str], Column]:
    """Names of the columns, the intercept first, and the array of them: an indicator for each level but a factor's first."""
    names, columns = ["(all)"], [F.lit(1.0)]
    for f in factors:
        levels = sorted(r[0] for r in cells.select(F.coalesce(F.col(f).cast("string"), F.lit(""))).distinct().limit(MOST_LEVELS + 1).collect())
        names += [f"{f}={x}" for x in levels[1:]]
        columns += [(F.coalesce(F.col(f).cast("string"), F.lit("")) == x).cast("double") for x in levels[1:]]
    if len(names) > MOST_LEVELS:
        raise ValueError(f"more than {MOST_LEVELS} levels of all factors")
    return names, F.array(*columns)


def _inverse(cells: DataFrame, taxon: str, p: int) -> DataFrame:
    """``(taxon, inv, rank, n)``: the pseudo-inverse of every taxon's cross products, row by row of a matrix."""
    at = [(i, j) for i in range(p) for j in range(i, p)]
    sums = cells.groupBy(taxon).agg(F.count("*").alias("n"), F.array(*[F.sum(F.col("d")[i] * F.col("d")[j]) for i, j in at]).alias("g"))

    def run(batches):
        for pdf in batches:
            m = np.zeros((len(pdf), p, p))
            if len(pdf):
                g = np.stack(pdf["g"].to_numpy())
                for k, (i, j) in enumerate(at):
                    m[:, i, j] = m[:, j, i] = g[:, k]
            yield pd.DataFrame({taxon: pdf[taxon], "inv": list(np.linalg.pinv(m, hermitian=True).reshape(len(pdf), -1)), "rank": np.linalg.matrix_rank(m, hermitian=True), "n": pdf["n"]})

    kind = dict(cells.dtypes)[taxon]
    return sums.mapInPandas(run, f"{taxon} {kind}, inv array<double>, rank int, n bigint")


def _solved(cells: DataFrame, inverse: DataFrame, taxon: str, p: int) -> DataFrame:
    """``(taxon, beta)`` by least squares on ``y - shift``."""
    right = cells.groupBy(taxon).agg(F.array(*[F.sum(F.col("d")[k] * (F.col("y") - F.col("shift"))) for k in range(p)]).alias("b"))
    row = lambda i: sum((F.col("inv")[i * p + j] * F.col("b")[j] for j in range(p)), F.lit(0.0))
    return right.join(inverse.select(taxon, "inv"), taxon).select(taxon, F.array(*[row(i) for i in range(p)]).alias("beta"))


def _fitted(p: int) -> Column:
    return sum((F.col("d")[k] * F.col("beta")[k] for k in range(p)), F.lit(0.0))


def _density(x: Column, mean: Column, variance: Column) -> Column:
    return F.exp(-0.5 * (x - mean) * (x - mean) / variance) / F.sqrt(2 * math.pi * variance)


def mixture_centres(effects: DataFrame, tolerance: float = MIX_TOLERANCE, rounds: int = MIX_ROUNDS) -> tuple[dict[int, float], int]:
    """``effects(k, b, v)``: for each k the centre of the middle of three normals, and rounds used.

    The outer parts lie below and above and are wider by a variance of their
    own; ``v`` is an effect's error variance. Every round is one aggregation
    over all effects; only a row of parameters for each k is the driver's.
    """
    spark = effects.sparkSession
    q = {r["k"]: r for r in quantiles_interpolated(effects, "b", [0.125, 0.25, 0.75, 0.875], ["k"]).collect()}
    inner = effects.join(spark.createDataFrame([(k, r["q12"], r["q25"], r["q75"], r["q88"]) for k, r in q.items()], "k int, q12 double, q25 double, q75 double, q88 double"), "k")
    when = lambda c: (F.avg(F.when(c, F.col("b"))), F.coalesce(F.var_samp(F.when(c, F.col("b"))), F.lit(0.0)))
    (m0, _), (m1, v1), (m2, v2) = when(F.col("b").between(F.col("q25"), F.col("q75"))), when(F.col("b") < F.col("q12")), when(F.col("b") > F.col("q88"))
    start = inner.groupBy("k").agg(m0.alias("m0"), m1.alias("m1"), v1.alias("v1"), m2.alias("m2"), v2.alias("v2"), F.avg("v").alias("v")).collect()
    at = {}
    for r in start:
        centre = r["m0"]
        at[r["k"]] = [0.75, 0.125, 0.125, centre, min((r["m1"] if r["m1"] is not None else centre) - centre, 0.0), max((r["m2"] if r["m2"] is not None else centre) - centre, 0.0), max(r["v1"], r["v"]), max(r["v2"], r["v"])]
    names, done = ["p0", "p1", "p2", "c", "l1", "l2", "k1", "k2"], 0
    open_ = set(at)
    while open_ and done < rounds:
        done += 1
        now = spark.createDataFrame([(k, *map(float, at[k])) for k in sorted(open_)], "k int, " + ", ".join(f"{n} double" for n in names))
        j = effects.join(now, "k")
        b, v, c = F.col("b"), F.col("v"), F.col("c")
        parts = [F.col("p0") * _density(b, c, v), F.col("p1") * _density(b, c + F.col("l1"), v + F.col("k1")), F.col("p2") * _density(b, c + F.col("l2"), v + F.col("k2"))]
        whole = F.greatest(parts[0] + parts[1] + parts[2], F.lit(1e-300))
        j = j.select("k", "b", "v", *names, *[(x / whole).alias(f"r{i}") for i, x in enumerate(parts)])
        w = [1 / v, 1 / (v + F.col("k1")), 1 / (v + F.col("k2"))]
        d = [b - c, b - c - F.col("l1"), b - c - F.col("l2")]
        sums = [F.count("*").alias("n")]
        for i in range(3):
            r = F.col(f"r{i}")
            sums += [F.sum(r).alias(f"s{i}"), F.sum(r * w[i]).alias(f"w{i}"), F.sum(r * w[i] * (d[i] + c)).alias(f"m{i}"), F.sum(r * w[i] * (b - c)).alias(f"f{i}")]
            sums += [F.sum(r * w[i] * w[i]).alias(f"h{i}"), F.sum(r * w[i] * w[i] * (d[i] * d[i] - v)).alias(f"u{i}")]
        for r in j.groupBy("k").agg(*sums).collect():
            p = at[r["k"]]
            centre = sum(r[f"m{i}"] for i in range(3)) / sum(r[f"w{i}"] for i in range(3))
            low = min(r["f1"] / r["w1"], 0.0) if r["w1"] else 0.0
            high = max(r["f2"] / r["w2"], 0.0) if r["w2"] else 0.0
            wide = [max(r[f"u{i}"] / r[f"h{i}"], 0.0) if r[f"h{i}"] else 0.0 for i in (1, 2)]  # one scoring step
            new = [r["s0"] / r["n"], r["s1"] / r["n"], r["s2"] / r["n"], centre, low, high, *wide]
            moved = abs(new[3] - p[3])
            at[r["k"]] = new
            if moved < tolerance:
                open_.discard(r["k"])
    return {k: p[3] for k, p in at.items()}, done


def fit_bias(counts: DataFrame, sample: str, taxon: str, n: str, factors: list[str], tolerance: float = TOLERANCE, rounds: int = ROUNDS) -> BiasFit:
    """The iterative fit: counts are positive where a taxon was seen; ``factors`` say a sample's groups and add up."""
    spark, kept = counts.sparkSession, _Tables(counts.sparkSession)
    seen = counts.where(F.col(n) > 0).withColumn("_log", F.ln(F.col(n).cast("double")))
    names, design = _design(seen, factors)
    p = len(names)
    centre = seen.groupBy(sample).agg(F.avg("_log").alias("_mid"))
    cells = kept.keep("cells", seen.join(centre, sample).select(sample, taxon, "_log", (F.col("_log") - F.col("_mid")).alias("y"), design.alias("d")))
    inverse = kept.keep("inverse", _inverse(cells, taxon, p))
    shifts = kept.keep("shifts", cells.select(sample).distinct().withColumn("shift", F.lit(0.0)))
    done = 0
    while done < rounds:
        done += 1
        beta = kept.keep("beta", _solved(cells.join(shifts, sample), inverse, taxon, p))
        new = cells.join(beta, taxon).groupBy(sample).agg(F.avg(F.col("y") - _fitted(p)).alias("shift"))
        new = kept.keep("shifts", new)
        moved = new.withColumnRenamed("shift", "_new").join(shifts, sample).agg(F.max(F.abs(F.col("_new") - F.col("shift")))).first()[0]
        shifts = new
        if moved is None or moved < tolerance:
            break
    beta = kept.keep("beta", _solved(cells.join(shifts, sample), inverse, taxon, p))
    fit = BiasFit(shifts, beta, names, {}, done)
    if p > 1:
        rss = cells.join(shifts, sample).join(beta, taxon).groupBy(taxon).agg(F.sum(F.pow(F.col("y") - F.col("shift") - _fitted(p), F.lit(2))).alias("rss"))
        j = beta.join(inverse, taxon).join(rss, taxon).where(f"rank = {p} AND n > {p} AND rss > 0")
        each = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.col("beta")[k].alias("b"), (F.col("inv")[k * p + k] * F.col("rss") / (F.col("n") - p)).alias("v")) for k in range(1, p)]))
        effects = kept.keep("effects", j.select(each.alias("x")).select("x.*").where("v > 0"))
        centres, fit.mix_rounds = mixture_centres(effects)
        fit.bias = {names[k]: centres.get(k, 0.0) for k in range(1, p)}
        less = F.array(*[F.col("beta")[k] - F.lit(fit.bias.get(names[k], 0.0)) for k in range(p)])
        fit.coefficients = beta.withColumn("beta", less)
    fit.samples = kept.keep("samples", cells.join(fit.coefficients, taxon).groupBy(sample).agg(F.avg(F.col("_log") - _fitted(p)).alias("shift")))
    return fit


def bias_corrected(counts: DataFrame, sample: str, taxon: str, n: str, factors: list[str], **options) -> DataFrame:
    """``counts`` with ``log_corrected``, the log count less its sample's shift, and ``abundance``, its exponential; 0 where a taxon was not seen."""
    fit = fit_bias(counts, sample, taxon, n, factors, **options)
    seen = F.col(n) > 0
    out = counts.join(fit.samples.withColumnRenamed("shift", "_shift"), sample, "left")
    out = out.withColumn("log_corrected", F.when(seen, F.ln(F.col(n).cast("double")) - F.col("_shift"))).drop("_shift")
    return out.withColumn("abundance", F.coalesce(F.exp("log_corrected"), F.lit(0.0)))
