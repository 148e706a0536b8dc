"""Order of many rows: ranges of even size, and the same results as group by group."""

from __future__ import annotations

import random

import duckdb
import numpy as np
import pytest
import test_oracles
from pyspark.sql import functions as F

from tessera.functions import scalars
from tessera.operators import discrimination, importance, inference, ordered, quantiles, resampling


@pytest.fixture()
def many(monkeypatch):
    """Every table counts as large."""
    monkeypatch.setattr(ordered, "FEW_BYTES", -1)
    monkeypatch.setattr(ordered, "FEW_ROWS", -1)


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in test_oracles.TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{test_oracles.DATA}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", ["auc_pinned", "bh_families", "bootstrap_delta_auc", "delong_ci", "delong_paired_z", "quantile_type2_grouped", "quantile_type7_grouped", "repeated_folds", "inner_folds", "permute_labels", "wilcoxon_by_layer"])
def test_registered_queries_of_many_rows(spark, duck, many, name):
    from tessera.plans import registry

    if name in registry.oracle_sql():
        test_oracles.test_same_as_sql(spark, duck, name)


SPREADS = {
    "uniform": lambda k: f"({k} * 7919 % 100003) / 100003D", "clustered": lambda k: f"0.5 + pow(({k} * 7919 % 100003) / 100003D, 9) * 1e-6", "huge": lambda k: f"exp(({k} * 7919 % 100003) / 500D) * (CASE WHEN {k} % 2 = 0 THEN 1 ELSE -1 END)",
}


@pytest.mark.parametrize("spread", SPREADS)
def test_ranges_are_even(spark, many, spread):
    """The largest range grows with rows over ranges, wherever values lie."""
    n = 40_000
    df = spark.range(n).selectExpr(f"{SPREADS[spread]('id')} AS v")
    borders = ordered.splitters(df, "v")
    sizes = df.groupBy(ordered.in_range(F.col("v"), borders).alias("b")).count().collect()
    assert max(r["count"] for r in sizes) <= 2.5 * n / ordered.ranges(df) and len(sizes) >= ordered.ranges(df) / 2
    hashes = spark.range(n).select((F.shiftright(scalars.hash_order(1, "x", F.col("id")) * ordered.ranges(df), 32)).alias("b")).groupBy("b").count().collect()
    assert max(r["count"] for r in hashes) <= 1.3 * n / ordered.ranges(df) and {r.b for r in hashes} == set(range(ordered.ranges(df)))


def test_no_group_is_sorted_whole(spark, many):
    """Plans of many rows have no window and no exchange over everything."""
    df = spark.range(1000).selectExpr("CAST(id * 7 % 31 AS DOUBLE) / 31 AS p", "id % 5 AS g")
    for out in (inference.bh_adjust(df, "p", []), quantiles.average_rank(df, "p", [], "r")):
        plan = out._jdf.queryExecution().optimizedPlan().toString()
        for line in plan.splitlines():
            assert "Window" not in line or "_b#" in line, line


def awkward():
    rng = random.Random(3)
    vs = [None, float("-inf"), -1e300, -2.5, -2.5, 0.0, -0.0, 5e-324, 1.0, 1.0, 1.0000001, 3.0, 1e300, float("inf"), float("nan"), 0.05, 0.05]
    return [(g, i, v) for g in ("a", "b", None) for i, v in enumerate(vs)] + [("c", 100 + i, rng.choice([rng.random(), 0.25, None])) for i in range(300)]


def both(monkeypatch, run):
    few = run()
    monkeypatch.setattr(ordered, "FEW_BYTES", -1)
    monkeypatch.setattr(ordered, "FEW_ROWS", -1)
    return few, run()


@pytest.mark.parametrize("by", [["g"], []])
def test_both_ways_agree_on_awkward_values(spark, monkeypatch, by):
    df = spark.createDataFrame(awkward(), "g string, i int, v double")
    p = df.where("v IS NULL OR v BETWEEN 0 AND 1")
    t = df.withColumn("truth", F.col("i") % 2)

    def run():
        return [
            sorted(map(str, x.collect())) for x in (
                quantiles.average_rank(df, "v", by, "r"), inference.bh_adjust(p, "v", by), quantiles.quantiles_interpolated(p, "v", [0.1, 0.5], by),
                ordered.numbered(df.withColumn("k", F.concat_ws("|", "g", "i")), by, scalars.hash_order(1, "x", F.concat_ws("|", "g", "i")), "k"),
                ordered.total_rank(p.withColumn("k", F.concat_ws("|", "g", "i")), "v", "k", descending=True), discrimination.auc(t.where("NOT isnan(v)"), by, "v"),
                resampling.stratified_folds(p.withColumn("k", F.concat_ws("|", "g", "i")), "k", by), discrimination.bootstrap_delta(
                    spark.range(80).selectExpr("id", "id % 3 AS g", "id * 7 % 11 / 11D AS a", "id * 5 % 13 / 13D AS b", "CAST(id % 2 AS INT) AS truth"), "id", "a", "b", replicates=25, by=["g"] if by else []),
            )
        ]

    few, many = both(monkeypatch, run)
    assert few == many


def test_bh_against_the_definition(spark, many):
    rng = random.Random(5)
    ps = [rng.choice([round(rng.random(), 2), rng.random() ** 3, 0.0, 1.0]) for _ in range(200)]
    df = spark.createDataFrame(list(enumerate(ps)) + [(999, None)], "id int, p double")
    got = {r.id: r.p_adj for r in inference.bh_adjust(df, "p", []).collect()}
    order, want, least = np.argsort(ps, kind="stable"), {}, 1.0
    for rank in range(len(ps), 0, -1):
        k = order[rank - 1]
        least = min(least, ps[k] * len(ps) / rank)
        want[int(k)] = least
    assert got.pop(999) is None and all(abs(got[k] - want[k]) < 1e-12 for k in want) and len(got) == len(want)


def test_rankings_of_coefficients(spark):
    c = spark.createDataFrame([("a", 1.0), ("b", -3.0), ("c", 0.0), ("d", 1.0), ("e", None)], "feature string, coefficient double")
    assert [(r.feature, r["rank"]) for r in importance.coefficient_importance(c).orderBy("rank").collect()] == [("b", 1), ("a", 2), ("d", 3)]


def test_draws_stay_on_the_executors(spark):
    """Slots by the rows' number look few to the plan: they are neither broadcast nor all made in one task."""
    df = spark.range(1000).selectExpr("id", "id % 3 AS g")
    plan = resampling.bootstrap_draws(df, "id", 5, by=["g"])._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" not in plan and "SortMergeJoin" in plan
    slots = resampling.bootstrap_slots(df.groupBy("g").agg(F.count("*").alias("_size")), ["g"], 5)
    assert slots.select(F.spark_partition_id().alias("p")).distinct().count() > 1
