"""Contracts: aggregates that say what is wrong, and a gate that raises.

Each check returns a table ``(check, failures)`` from one pass over the data;
``enforce`` is the only action.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _as_rows(one: DataFrame, names: list[str]) -> DataFrame:
    return one.select(F.explode(F.array(*[F.struct(F.lit(n).alias("check"), F.coalesce(F.col(n), F.lit(0)).cast("bigint").alias("failures")) for n in names])).alias("x")).select("x.*")


def frame_checks(df: DataFrame, key: str, outcome: str, classes: list[str], numeric: list[str]) -> DataFrame:
    """Empty or repeated ids, unknown outcomes, non-finite numbers (null is allowed)."""
    bad = [(F.isnan(F.col(c).cast("double")) | (F.abs(F.col(c).cast("double")) == float("inf"))) for c in numeric]
    aggs = {
        "empty_id": F.sum((F.col(key).isNull() | (F.trim(F.col(key).cast("string")) == "")).cast("bigint")),
        "repeated_id": F.count(key) - F.countDistinct(key),
        "unknown_outcome": F.sum((~F.coalesce(F.col(outcome).isin(classes), F.lit(False))).cast("bigint")),
        "not_finite": sum((F.sum(F.coalesce(b, F.lit(False)).cast("bigint")) for b in bad), F.lit(0)),
    }
    return _as_rows(df.agg(*[v.alias(k) for k, v in aggs.items()]), list(aggs))


def layer_contract(members: DataFrame, layer: str, event: str, features: DataFrame | None = None) -> DataFrame:
    """``(layer, n, events[, n_features])`` as found."""
    out = members.groupBy(layer).agg(F.count("*").alias("n"), F.sum(F.col(event).cast("bigint")).alias("events"))
    if features is not None:
        out = out.join(features.groupBy(layer).agg(F.countDistinct("feature").alias("n_features")), layer, "left")
    return out


def contract_faults(found: DataFrame, declared: DataFrame, key: str) -> DataFrame:
    """Rows whose found and declared numbers differ, or that only one side has."""
    cols = [c for c in declared.columns if c != key]
    d = declared.select(key, *[F.col(c).alias(f"declared_{c}") for c in cols])
    j = found.join(d, key, "full")
    differs = F.lit(False)
    for c in cols:
        differs = differs | ~F.col(c).eqNullSafe(F.col(f"declared_{c}"))
    return j.where(differs)


def agreement(a: DataFrame, b: DataFrame, key: str, numeric: list[str], text: list[str], tolerance: float = 1e-8) -> DataFrame:
    """``(check, failures)``: shared ids whose values differ between two layers, by column."""
    r = b.select(key, *[F.col(c).alias(f"_{c}") for c in [*numeric, *text]])
    j = a.join(r, key)
    aggs = {c: F.sum((~F.coalesce(F.abs(F.col(c) - F.col(f"_{c}")) <= tolerance, F.col(c).isNull() & F.col(f"_{c}").isNull())).cast("bigint")) for c in numeric}
    aggs |= {c: F.sum((~F.col(c).eqNullSafe(F.col(f"_{c}"))).cast("bigint")) for c in text}
    return _as_rows(j.agg(*[v.alias(k) for k, v in aggs.items()]), list(aggs))


def prediction_checks(predictions: DataFrame, key: str) -> DataFrame:
    """Risks out of [0, 1] or missing, repeated keys, ids with two truths, ids whose fold differs between models."""
    own = predictions.agg(
        F.sum((~F.coalesce((F.col("risk") >= 0) & (F.col("risk") <= 1) & ~F.isnan("risk"), F.lit(False))).cast("bigint")).alias("invalid_risk")
    )
    keys = [key, "repeat_id", "model", "layer"]
    rep = predictions.groupBy(*keys).agg(F.count("*").alias("n")).agg(F.sum((F.col("n") > 1).cast("bigint")).alias("repeated_key"))
    truth = predictions.groupBy(key).agg(F.countDistinct("truth").alias("n")).agg(F.sum((F.col("n") > 1).cast("bigint")).alias("two_truths"))
    fold = predictions.groupBy(key, "repeat_id").agg(F.countDistinct("fold_id").alias("n")).agg(F.sum((F.col("n") > 1).cast("bigint")).alias("two_folds"))
    return _as_rows(own.crossJoin(rep).crossJoin(truth).crossJoin(fold), ["invalid_risk", "repeated_key", "two_truths", "two_folds"])  # one row each


def held_out_checks(predictions: DataFrame, test: DataFrame, key: str) -> DataFrame:
    """``(model, check, failures)`` of held-out predictions ``(key, truth, risk, score, model)`` against the test rows ``(key, truth)``.

    Ids that repeat, that only one side has, other truths, risks that are no
    probabilities, and models whose ``score`` is neither all risks nor all
    complements, or not what most models store.
    """
    models = predictions.select("model").distinct()
    wanted = test.select(key, F.col("truth").alias("_truth")).join(models)  # a row for each model
    own = predictions.groupBy("model", key).agg(
        F.count("*").alias("_n"), F.max("truth").alias("truth"), F.max((~_probability("risk")).cast("int")).alias("_bad"),
        F.max(F.abs(F.col("score") - F.col("risk"))).alias("_same"), F.max(F.abs(1 - F.col("score") - F.col("risk"))).alias("_flipped"),
    )
    j = wanted.withColumn("_w", F.lit(True)).join(own, ["model", key], "full")
    per = j.groupBy("model").agg(
        F.sum((F.col("_n") > 1).cast("bigint")).alias("repeated_id"), F.count(F.when(F.col("_w").isNull(), 1)).alias("unknown_id"), F.count(F.when(F.col("_n").isNull(), 1)).alias("absent_id"),
        F.count(F.when(~F.col("truth").eqNullSafe(F.col("_truth")) & F.col("_w") & F.col("_n").isNotNull(), 1)).alias("other_truth"), F.sum("_bad").alias("invalid_risk"),
        F.max("_same").alias("_same"), F.max("_flipped").alias("_flipped"),
    )
    kind = F.when(F.col("_same") <= 1e-12, 1).when(F.col("_flipped") <= 1e-12, -1).otherwise(0)
    usual = F.signum(F.sum(kind).over(Window.partitionBy(F.lit(1))))  # a row for each model
    per = per.withColumn("mixed_score", ((kind == 0) | (usual != 0) & (kind != usual)).cast("bigint"))
    return _by_model(per, ["model"], ["repeated_id", "unknown_id", "absent_id", "other_truth", "invalid_risk", "mixed_score"])


def out_of_fold_checks(predictions: DataFrame, train: DataFrame) -> DataFrame:
    """``(model, check, failures)`` of out-of-fold predictions ``(train_row, truth, risk, model)`` against ``train(train_row, truth)``; a null truth is not checked."""
    wanted = train.select("train_row", F.col("truth").alias("_truth")).join(predictions.select("model").distinct())  # a row for each model
    own = predictions.groupBy("model", "train_row").agg(F.count("*").alias("_n"), F.max("truth").alias("truth"), F.max((~_probability("risk")).cast("int")).alias("_bad"))
    j = wanted.withColumn("_w", F.lit(True)).join(own, ["model", "train_row"], "full")
    per = j.groupBy("model").agg(
        F.count(F.when((F.col("_n") > 1) | F.col("_n").isNull() | F.col("_w").isNull(), 1)).alias("no_permutation"),
        F.count(F.when((F.col("truth") != F.col("_truth")), 1)).alias("other_truth"), F.sum("_bad").alias("invalid_risk"),
    )
    return _by_model(per, ["model"], ["no_permutation", "other_truth", "invalid_risk"])


def matched_output_checks(predictions: DataFrame, by_repeat: DataFrame, tuning: DataFrame, cohort: DataFrame, expected: DataFrame, key: str, repeats: int, outer: int) -> DataFrame:
    """``(model, layer, check, failures)`` of a matched cohort's output against its cohort ``(key, truth)`` and design.

    Every expected ``(model, layer)`` has one averaged risk for everybody with
    the cohort's truth; in every repeat one out-of-fold risk for everybody, in
    folds that all models share; and a tuning record for every outer fold
    whose number of features is that of its list.
    """
    keys = ["model", "layer"]
    n = cohort.agg(F.count("*").alias("_all"))
    own = predictions.groupBy(*keys, key).agg(F.count("*").alias("_n"), F.max("truth").alias("truth"), F.max((~_probability("risk")).cast("int")).alias("_bad"))
    own = own.join(cohort.select(key, F.col("truth").alias("_truth")), key, "left")
    averaged = own.groupBy(*keys).agg(
        F.sum((F.col("_n") > 1).cast("bigint")).alias("repeated_id"), F.count(F.when(F.col("_truth").isNull(), 1)).alias("unknown_id"), F.count("_truth").alias("_have"),
        F.count(F.when(F.col("truth") != F.col("_truth"), 1)).alias("other_truth"), F.sum("_bad").alias("invalid_risk"),
    )
    folds = by_repeat.groupBy(key, "repeat_id", "fold_id").agg(F.count("*").alias("_c"))
    usual = folds.groupBy(key, "repeat_id").agg(F.max(F.struct("_c", (-F.col("fold_id")).alias("f"))).alias("m")).select(key, "repeat_id", (-F.col("m.f")).alias("_fold"))
    rows = by_repeat.groupBy(*keys, key, "repeat_id").agg(F.count("*").alias("_n"), F.max("fold_id").alias("fold_id"), F.max((~_probability("risk")).cast("int")).alias("_bad"))
    rows = rows.join(cohort.select(key, F.lit(True).alias("_known")), key, "left").join(usual, [key, "repeat_id"])
    repeated = rows.groupBy(*keys).agg(
        F.count(F.when(F.col("_known") & (F.col("_n") == 1), 1)).alias("_covered"), F.sum(((F.col("_n") > 1) | F.col("_known").isNull()).cast("bigint")).alias("repeat_extra"),
        F.sum("_bad").alias("repeat_invalid_risk"), F.count(F.when(F.col("fold_id") != F.col("_fold"), 1)).alias("other_fold"),
    )
    tuned = tuning.groupBy(*keys).agg(
        F.countDistinct("repeat_id", "fold_id").alias("_records"), F.count(F.when(F.size("selected_features") != F.col("n_features"), 1)).alias("wrong_feature_count")
    )
    j = expected.select(*keys).distinct().withColumn("_e", F.lit(True)).join(averaged, keys, "full").join(repeated, keys, "left").join(tuned, keys, "left").join(n)  # one row
    zero = F.lit(0)
    j = j.withColumn("unexpected", F.col("_e").isNull().cast("bigint")).withColumn("absent_id", F.col("_all") - F.coalesce("_have", zero))
    j = j.withColumn("repeat_absent", F.col("_all") * repeats - F.coalesce("_covered", zero)).withColumn("tuning_absent", F.lit(repeats * outer) - F.coalesce("_records", zero))
    return _by_model(j, keys, ["unexpected", "absent_id", "repeated_id", "unknown_id", "other_truth", "invalid_risk", "repeat_absent", "repeat_extra", "repeat_invalid_risk", "other_fold", "tuning_absent", "wrong_feature_count"])


def preflight(layers: DataFrame, key: str, layer: str, outcome: str, event: str, n: int, events: int) -> DataFrame:
    """``(check, failures)`` before a matched run: repeated ids in a layer, ids whose outcome differs between layers, and how far the overlap is from declared."""
    count = layers.select(layer).distinct().count()
    per = layers.groupBy(key).agg(F.countDistinct(layer).alias("_k"), F.count("*").alias("_n"), F.countDistinct(outcome).alias("_o"), F.max(outcome).alias("_outcome"))
    inside = F.col("_k") == count
    out = per.agg(
        F.sum((F.col("_n") > F.col("_k")).cast("bigint")).alias("repeated_id"), F.sum((inside & (F.col("_o") > 1)).cast("bigint")).alias("outcome_differs"),
        F.abs(F.sum(inside.cast("bigint")) - n).alias("overlap_off"), F.abs(F.sum((inside & (F.col("_outcome") == event)).cast("bigint")) - events).alias("events_off"),
    )
    return _as_rows(out, ["repeated_id", "outcome_differs", "overlap_off", "events_off"])


def _probability(c: str) -> Column:
    return F.coalesce((F.col(c) >= 0) & (F.col(c) <= 1) & ~F.isnan(c), F.lit(False))


def _by_model(per: DataFrame, keys: list[str], names: list[str]) -> DataFrame:
    cells = F.explode(F.array(*[F.struct(F.lit(n).alias("check"), F.coalesce(F.col(n), F.lit(0)).cast("bigint").alias("failures")) for n in names]))
    return per.select(*keys, cells.alias("x")).select(*keys, "x.*")


def enforce(checks: DataFrame) -> None:
    """Raise if any check failed."""
    failed = checks.where("failures > 0").collect()
    if failed:
        raise ValueError("; ".join(f"{r['check']}: {r['failures']}" for r in failed))
