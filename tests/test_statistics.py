"""Closed forms, brute force and properties of the statistical operators."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions import labels, scalars, tails
from tessera.operators import blocks, contracts, discrimination, importance, inference, quantiles, recodes, relational, resampling, screening


def one(df):
    return df.collect()[0]


def test_tails_against_known_values():
    assert tails.normal_two_sided(1.959963984540054) == pytest.approx(0.05, abs=1e-12)
    assert tails.t_two_sided(2.228138852, 10) == pytest.approx(0.05, abs=1e-8)
    assert tails.t_two_sided(12.7062047364, 1) == pytest.approx(0.05, abs=1e-9)
    assert tails.chi2_upper(3.841458820694124, 1) == pytest.approx(0.05, abs=1e-10)
    assert tails.chi2_upper(18.307038053275146, 10) == pytest.approx(0.05, abs=1e-10)
    assert tails.log_t_two_sided(60.0, 300) < -300
    assert tails.log_normal_upper(40.0) == pytest.approx(-804.608442, abs=1e-5)


def test_bh_by_hand(spark):
    df = spark.createDataFrame([("a", 0.01), ("a", 0.02), ("a", 0.03), ("a", None), ("b", 0.5)], "f string, p double")
    got = {(r.f, r.p): r.p_adj for r in inference.bh_adjust(df, "p", ["f"]).collect()}
    assert got["a", 0.01] == pytest.approx(0.03) and got["a", 0.03] == pytest.approx(0.03) and got["a", None] is None and got["b", 0.5] == pytest.approx(0.5)


@pytest.mark.parametrize("n,p,want", [(10, 0.2, 2.5), (10, 0.25, 3.0), (4, 0.5, 2.5), (5, 0.5, 3.0), (1, 0.2, 1.0)])
def test_averaged_quantile(spark, n, p, want):
    df = spark.range(1, n + 1).selectExpr("CAST(id AS DOUBLE) AS v")
    assert one(quantiles.quantile_averaged(df, "v", p))["q"] == want


def test_auc_and_delong_by_brute_force(spark):
    rng = random.Random(3)
    rows = [(i, rng.randint(0, 1), rng.randint(0, 6) / 6, rng.randint(0, 9) / 9) for i in range(80)]
    df = spark.createDataFrame(rows, "id int, truth int, a double, b double")
    cases, ctrl = [r for r in rows if r[1]], [r for r in rows if not r[1]]
    psi = lambda x, y: 1.0 if x > y else 0.5 if x == y else 0.0
    v10 = {k: np.array([np.mean([psi(c[k], d[k]) for d in ctrl]) for c in cases]) for k in (2, 3)}
    v01 = {k: np.array([np.mean([psi(c[k], d[k]) for c in cases]) for d in ctrl]) for k in (2, 3)}
    r = one(discrimination.delong(df, [], "a"))
    assert r["auc"] == pytest.approx(v10[2].mean()) and r["se"] ** 2 == pytest.approx(v10[2].var(ddof=1) / len(cases) + v01[2].var(ddof=1) / len(ctrl))
    up, down = one(discrimination.auc(df, [], "a"))["auc"], one(discrimination.auc(df.withColumn("a", -F.col("a")), [], "a"))["auc"]
    assert up == pytest.approx(r["auc"]) and up + down == pytest.approx(1)
    assert one(discrimination.auc(df.withColumn("a", F.exp("a")), [], "a"))["auc"] == pytest.approx(up)
    s10, s01 = np.cov(v10[2], v10[3]), np.cov(v01[2], v01[3])
    var = (s10[0, 0] + s10[1, 1] - 2 * s10[0, 1]) / len(cases) + (s01[0, 0] + s01[1, 1] - 2 * s01[0, 1]) / len(ctrl)
    p = one(discrimination.delong_paired(df, "id", [], "a", "b"))
    assert p["z"] == pytest.approx((v10[2].mean() - v10[3].mean()) / math.sqrt(var))
    assert p["p_value"] == pytest.approx(math.erfc(abs(p["z"]) / math.sqrt(2)))


def test_delong_of_all_pairs_equals_pair_by_pair(spark):
    rng = random.Random(5)
    rows = [(i, i % 2, i % 3 > 0, rng.randint(0, 6) / 6, rng.randint(0, 9) / 9, rng.random()) for i in range(90)]
    df = spark.createDataFrame(rows, "id int, g int, t boolean, a double, b double, c double").withColumn("truth", F.col("t").cast("int")).withColumn("same", F.col("a"))
    models = ["c", "a", "b", "same"]
    cells = F.explode(F.array(*[F.struct(F.lit(m).alias("model"), F.col(m).alias("risk")) for m in models]))
    long = df.select("id", "g", "truth", cells.alias("x")).select("id", "g", "truth", "x.model", "x.risk")
    long = long.where("NOT (id = 7 AND model = 'b')").unionByName(df.selectExpr("id", "g", "truth", "'other' AS model", "a AS risk"))  # id 7 has no risk by b
    got = {(r.g, r.model_a, r.model_b): r for r in discrimination.delong_all_pairs(long, "id", ["g"], models).collect()}
    assert len(got) == 2 * 6
    for a, b in (("c", "a"), ("a", "b"), ("c", "same")):
        for want in discrimination.delong_paired(df.where("id <> 7"), "id", ["g"], a, b).collect():
            r = got[want.g, a, b]
            assert r.n == (45 if want.g == 0 else 44) and (r.auc_a, r.auc_b, r.z, r.p_value) == pytest.approx((want.auc_a, want.auc_b, want.z, want.p_value))
    assert got[0, "a", "same"].delta == 0 and not got[0, "a", "same"].z
    assert discrimination.delong_all_pairs(long.limit(0), "id", ["g"], models).count() == 0


def test_calibration_of_true_model(spark):
    df = spark.range(4000).select(((F.col("id") % 97 + 1) / 99.0).alias("risk"), (scalars.hash_order(1, "y", F.col("id")) / 2.0**32 < (F.col("id") % 97 + 1) / 99.0).cast("int").alias("truth"))
    r = one(discrimination.calibration(df.withColumn("m", F.lit(1)), ["m"]))
    assert abs(r["calibration_slope"] - 1) < 0.1 and abs(r["calibration_in_the_large"]) < 0.15
    assert (r["calibration_in_the_large"] > 0) == (r["observed"] > r["mean_predicted"])


def test_folds_and_permutations(spark):
    df = spark.range(103).select("id", (F.col("id") % 3 == 0).cast("int").alias("truth"))
    f = resampling.repeated_folds(df, "id", ["truth"], 5, 3)
    sizes = [r["count"] for r in f.groupBy("repeat_id", "fold_id", "truth").count().where("truth = 1").collect()]
    assert max(sizes) - min(sizes) <= 1 and f.groupBy("repeat_id", "id").count().where("count <> 1").count() == 0
    assert resampling.out_of_fold_faults(f, df, "id").count() == 0
    broken = f.where("NOT (repeat_id = 2 AND id = 7)")
    assert [tuple(r) for r in resampling.out_of_fold_faults(broken, df, "id").collect()] == [(2, "absent", 1)]
    p = resampling.permuted_labels(df, "id", "truth", 4)
    assert {r["s"] for r in p.groupBy("perm_id").agg(F.sum("truth").alias("s")).collect()} == {35}
    b = resampling.bootstrap_draws(df, "id", 7)
    assert {r["s"] for r in b.groupBy("replicate").agg(F.sum("times").alias("s")).collect()} == {103}


def test_screen_learns_from_analysis_rows_only(spark):
    rng = random.Random(5)
    rows = [(i, float(i % 2), [rng.random() + (i % 2) * (k == 3) for k in range(6)]) for i in range(60)]
    df = spark.createDataFrame(rows, "id int, label double, features array<double>")
    est = screening.CorrelationScreen(k=2)
    chosen = est.fit(df.where("id < 40")).getOrDefault("chosen")
    changed = df.withColumn("features", F.when(F.col("id") >= 40, F.transform("features", lambda x: x * 100)).otherwise(F.col("features")))
    assert 3 in chosen and est.fit(changed.where("id < 40")).getOrDefault("chosen") == chosen
    assert len(est.fit(df).transform(df).first()["screened"]) == 2


def test_screens_fallback(spark):
    rows = [(i, f"f{k}", float((i * (k + 3)) % 7), i % 2) for i in range(30) for k in range(5)]
    long = spark.createDataFrame(rows, "id int, feature string, value double, truth int")
    assert screening.screen_moderated(long, fallback=3).count() == 3
    assert len(screening.screen_mrmr(long, 2, "id")) == 2 and screening.sis_size(332) == 57 and screening.sis_size(1) == 1


def test_mrmr_walks_over_all_features(spark):
    """Many copies of the most relevant feature do not keep a weaker one of its own from being chosen."""
    rng = np.random.default_rng(8)
    truth = np.arange(24) % 2
    strong = truth + rng.normal(size=24) * 0.2
    own = truth * 0.5 + rng.normal(size=24)
    rows = [(i, f"copy{k:03d}", float(strong[i]), int(truth[i])) for k in range(520) for i in range(24)] + [(i, "own", float(own[i]), int(truth[i])) for i in range(24)]
    got = screening.screen_mrmr(spark.createDataFrame(rows, "id int, feature string, value double, truth int"), 2, "id")
    assert got == ["copy000", "own"]


def test_attributions_add_up(spark):
    rng = np.random.default_rng(9)
    x, back, w = rng.normal(size=(30, 5)), rng.normal(size=(12, 5)), np.arange(5) - 2.0
    predict = lambda z: 1 / (1 + np.exp(-z @ w))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id int, features array<double>")
    got = importance.sampled_attributions(df, "id", list("abcde"), predict, back, permutations=2).groupBy("id").agg(F.sum("attribution").alias("s")).collect()
    assert all(r.s == pytest.approx(predict(x[r.id][None])[0] - predict(back).mean()) for r in got)


def test_shap_covers_all_features(spark):
    from tessera.plans import registry

    assert registry.queries()["shap_sampled"](spark, "/root/testdata/sf0.001").count() == 64


def test_whole_tables_in_queries(spark):
    from tessera.plans import fixtures, registry

    q, d = registry.queries(), "/root/testdata/sf0.001"
    t = fixtures.scores(spark, d)
    n, layers = t.count(), {r.layer for r in t.select("layer").distinct().collect()}
    assert {(r.model, r.layer) for r in q["calibration_table"](spark, d).select("model", "layer").collect()} == {(m, x) for m in ("s1", "s2", "s3") for x in layers}
    assert q["inner_folds"](spark, d).count() == 4 * n and q["permute_labels"](spark, d).count() == 6 * n
    draws = one(q["bootstrap_draws"](spark, d).agg(F.sum("times").alias("s"), F.countDistinct("layer").alias("k"), F.max("replicate").alias("r")))
    assert (draws.s, draws.k, draws.r) == (20 * n, len(layers), 20)
    assert set(q["auc_table_wide"](spark, d).columns) == {"model", *layers}
    assert {(r.model, r.repeats) for r in q["auc_by_repeat"](spark, d).collect()} == {(m, 5) for m in ("s1", "s2", "s3")}
    assert {r.layer: r.n_valid for r in q["bootstrap_delta_auc"](spark, d).collect()} == {x: 200 for x in layers}


def test_slots_side_by_side():
    """Digests of many numbers at once are those of one at a time, across lengths and blocks."""
    import hashlib

    for seed, first, n in ((1, 0, 12_345), ("abc", 99_990, 30), (7, 10**9 - 5, 20), ("x" * 50, 1, 5)):
        assert resampling.slot_digests(seed, first, n).tolist() == [int(hashlib.md5(f"{seed}|boot|{k}".encode()).hexdigest()[:8], 16) for k in range(first, first + n)]


def test_ranks_of_awkward_values(spark):
    """Ranges keep order for negative, tiny, huge, null, infinite and NaN values."""
    from tessera.operators import ordered, quantiles

    vs = [None, float("-inf"), -1e300, -2.5, -2.5, -1e-300, 0.0, -0.0, 5e-324, 1.0, 1.0, 1.0000001, 3.0, 1e300, float("inf"), float("nan")]
    df = spark.createDataFrame([(g, i, v) for g in ("a", None) for i, v in enumerate(vs)], "g string, i int, v double")
    got = {(r.g, r.i): r.r for r in quantiles.average_rank(df, "v", ["g"], "r").collect()}
    want = [1, 2, 3, 4.5, 4.5, 6, 7.5, 7.5, 9, 10.5, 10.5, 12, 13, 14, 15, 16]
    assert [got["a", i] for i in range(16)] == want and [got[None, i] for i in range(16)] == want
    n = ordered.numbered(df, ["g"], scalars.hash_order(1, "x", F.col("i")), "i").groupBy("g").agg(F.sort_array(F.collect_list("_n")).alias("n"))
    assert all(r.n == list(range(1, 17)) for r in n.collect())


def test_quantiles_against_numpy(spark):
    from tessera.operators import quantiles

    rng = random.Random(4)
    rows = [(g, rng.choice([rng.gauss(0, 1), round(rng.gauss(0, 1), 1)])) for g in "abc" for _ in range(rng.randint(1, 60))] + [("a", None), ("d", None)]
    df = spark.createDataFrame(rows, "g string, v double")
    got = {r.g: r for r in quantiles.quantiles_interpolated(df, "v", [0.0, 0.3, 0.5, 1.0], ["g"]).collect()}
    mid = {r.g: r.v for r in quantiles.medians(df, ["v"], ["g"]).collect()}
    for g in "abc":
        own = [v for k, v in rows if k == g and v is not None]
        assert [got[g].q0, got[g].q30, got[g].q50, got[g].q100] == pytest.approx(np.quantile(own, [0, 0.3, 0.5, 1]).tolist()) and mid[g] == pytest.approx(np.median(own))
    assert mid["d"] == 0 and quantiles.quantile_averaged(df, "v", 0.5, ["g"]).count() == 3


def naive_peel(w, lam, symmetric=False):
    """Step by step on submatrices: drop a weakest line, score what is left, keep the best state."""
    rows, cols = list(range(w.shape[0])), list(range(w.shape[1]))
    best = (0.0, rows, cols)
    while rows and cols:
        sub = w[np.ix_(rows, cols)]
        i, j = int(np.argmin(sub.sum(axis=1))), int(np.argmin(sub.sum(axis=0)))
        if symmetric:
            rows = rows[:i] + rows[i + 1 :]
            cols = rows
        elif len(rows) / len(cols) * sub.sum(axis=1)[i] <= sub.sum(axis=0)[j]:
            rows = rows[:i] + rows[i + 1 :]
        else:
            cols = cols[:j] + cols[j + 1 :]
        if rows and cols:
            left = w[np.ix_(rows, cols)].sum()
            score = left / (len(rows) ** lam if symmetric else (len(rows) * len(cols)) ** (lam / 2))
            if score > best[0]:
                best = (score, rows, cols)
    return best


def naive_blocks(w, lam, symmetric=False, most=10**9):
    whole = w.sum() / (len(w) ** lam if symmetric else w.size ** (lam / 2))
    rows, cols, out = list(range(w.shape[0])), list(range(w.shape[1])), []
    while rows and cols and len(out) < most:
        score, r, c = naive_peel(w[np.ix_(rows, cols)], lam, symmetric)
        if score <= whole:
            break
        out.append(([rows[i] for i in r], [cols[i] for i in c]))
        rows, cols = [x for i, x in enumerate(rows) if i not in r], [x for i, x in enumerate(cols) if i not in c]
    return out


def test_peels_against_stepwise_statement():
    rng = np.random.default_rng(7)
    for k in range(150):
        w = rng.integers(0, 6, (rng.integers(2, 9), rng.integers(2, 10))).astype(float)
        w[: len(w) // 3 + 1, :2] += 4 * (k % 3)
        w[-2:, -3:] += 3 * (k % 2)
        lam = (1.2, 1.4, 1.8)[k % 3]
        got = [(r.tolist(), c.tolist()) for r, c, _ in blocks.peel_blocks(w, lam)]
        assert got == naive_blocks(w, lam, most=4)
        s = rng.integers(-1 if k % 5 == 0 else 0, 5, (9, 9)).astype(float)
        s = s + s.T
        s[:3, :3] += 3 * (k % 3)
        s[5:8, 5:8] += 4 * (k % 2)
        assert [x.tolist() for x, _ in blocks.symmetric_blocks(s, lam)] == [r for r, _ in naive_blocks(s, lam, symmetric=True)]


def test_search_refines_to_all_communities():
    """Two communities inside a long side both stay, strongest first; small blocks go before they are refined."""
    w = np.full((12, 10), 0.01)
    w[:8, :6] = 9
    inside = np.full((12, 12), 0.01)
    inside[:3, :3], inside[5:8, 5:8] = 1.0, 0.8
    found = blocks.search(w, w, inside, np.eye(10), blocks.Search(lam=(1.4, 1.5, 1.5), x_size=(0, 5), y_size=(0, 15)))
    assert found[0][0].tolist() == [0, 1, 2, 5, 6, 7] and sorted(found[0][1]) == list(range(6))
    assert blocks.search(w, w, inside, np.eye(10), blocks.Search(lam=(1.4, 1.5, 1.5), x_size=(8, 15), y_size=(0, 15))) == [] or len(found) >= 1
    assert blocks.signed_refine(inside, np.arange(8), 1.5, "4")[0][0] == "4.1" and [x for x, _ in blocks.signed_refine(inside, np.arange(8), 1.5, "4")] == ["4.1", "4.2"]


def test_permutation_log_and_p(spark):
    rng = np.random.default_rng(12)
    truth = np.arange(40) % 2
    latent = rng.normal(size=40) * truth
    rows = [(i, (rng.normal(size=5) + 2 * latent[i] * (np.arange(5) < 3)).tolist(), (rng.normal(size=6) + 2 * latent[i] * (np.arange(6) < 3)).tolist(), int(truth[i])) for i in range(40)]
    df = spark.createDataFrame(rows, "id int, x array<double>, y array<double>, truth int")
    how = blocks.Search(lam=(1.4, 1.5, 1.5), x_size=(0, 9), y_size=(0, 9))
    log = blocks.permutation_log(df, "id", "x", "y", "truth", blocks.permutation_shard(spark, 6), how).toPandas()
    assert len(log.columns) == 26 and set(log.perm_id) <= set(range(7)) and 0 in set(log.perm_id)
    parts = [blocks.permutation_log(df, "id", "x", "y", "truth", blocks.permutation_shard(spark, 6, k, 2), how).toPandas() for k in (0, 1)]
    assert sorted(map(tuple, np.concatenate([p[["perm_id", "block_id"]].to_numpy() for p in parts]))) == sorted(map(tuple, log[["perm_id", "block_id"]].to_numpy()))
    drawn = {(r.perm_id, r.id): r.truth for r in resampling.permuted_labels(df, "id", "truth", 6).collect()}
    for p in range(7):
        mask = blocks.permuted_mask(list(range(40)), truth == 1, p)
        assert [drawn[p, i] for i in range(40)] == mask.astype(int).tolist()
    first = log[(log.perm_id == 0) & (log.block_id == 1)].iloc[0]
    assert first.n == first.p * first.q and first.delta == pytest.approx(first.mean_z_d - first.mean_z_a) and first.r_d == pytest.approx(np.tanh(first.mean_z_d))
    assert first.n_pos + first.n_neg <= first.n and first.min_abs_r <= first.max_abs_r and first.psi_d > 0
    few = spark.createDataFrame([(0, 1, 5.0), (2, 1, 7.0), (2, 2, 1.0), (3, 1, 2.0)], "perm_id int, block_id int, s double")
    got = one(inference.permutation_p(few, "s", 9))  # six permutations found no block and still count
    assert (got.observed, got.permutations, got.p_value) == (5.0, 9, pytest.approx(2 / 10))


def test_matched_comparisons_and_families(spark):
    from tessera.operators import discrimination as dn

    rng = random.Random(2)
    rows = [(i, int(rng.random() < 0.5)) for i in range(80)]
    preds = [(i, t, layer, m, min(1.0, max(0.0, 0.3 * t + rng.random() * 0.7))) for i, t in rows for layer, m in [("a layer", "EN"), ("b", "EN"), ("c", "EN"), ("a layer", "XGB"), ("clinical", "RF")]]
    p = spark.createDataFrame(preds, "id int, truth int, layer string, model string, risk double")
    got = {(r.family, r.model, r.comparison): r for r in dn.matched_comparisons(p, "id", ["a layer", "b", "c"], "RF", replicates=30).collect()}
    assert set(got) == {("Between omics layers", "EN", x) for x in ("A Layer vs B", "A Layer vs C", "B vs C")} | {
        ("Versus the clinical model", m, f"{x} vs Clinical") for m, x in (("EN", "A Layer"), ("EN", "B"), ("EN", "C"), ("XGB", "A Layer"))}
    for r in got.values():
        assert r.n == 80 and r.delta == pytest.approx(r.auc_a - r.auc_b) and r.delta_lo <= r.delta_hi and r.p_adj >= r.p_value
    wide = spark.createDataFrame([(i, t, "L", 0.3 * t + rng.random() * 0.7, rng.random(), rng.random()) for i, t in rows], "id int, truth int, layer string, m1 double, m2 double, age double")
    table = {(r.model, r.reference): r for r in dn.compare(wide, "id", ["layer"], {"m2": ["m1"], "age": ["m1", "m2"]}, replicates=30).collect()}
    assert set(table) == {("m1", "m2"), ("m1", "age"), ("m2", "age")} and all(r.n_test == 80 and r.n_deaths == sum(t for _, t in rows) for r in table.values())
    assert table["m1", "m2"].p_adj == pytest.approx(table["m1", "m2"].p_value)
    proxy = {r.model: r for r in dn.age_proxy(wide, ["layer"], "id", ["m1"], "age", "age", "m2").collect()}
    assert proxy["m2"].auc_omics is None and proxy["m2"].p_adj is None and proxy["m1"].p_adj == pytest.approx(proxy["m1"].p_value) and proxy["m2"].rho_age is not None


def test_peel_finds_planted_block_and_keeps_negative_input():
    rng = np.random.default_rng(1)
    w = rng.random((30, 40)) * 0.2
    w[5:12, 10:19] += 5
    r, c, density = blocks.peel(w, 1.4)
    assert r.tolist() == list(range(5, 12)) and c.tolist() == list(range(10, 19)) and density > 0
    r, c, density = blocks.peel(-w, 1.4)
    assert len(r) == 30 and len(c) == 40 and density == 0
    two = w.copy()
    two[20:26, 25:33] += 4
    found = blocks.peel_blocks(two, 1.4)
    assert len(found) >= 2 and not set(found[0][0]) & set(found[1][0]) and not set(found[0][1]) & set(found[1][1])
    s = rng.random((20, 20)) * 0.1
    s = s + s.T
    s[3:8, 3:8] += 3
    assert blocks.peel_symmetric(s, 1.3)[0].tolist() == list(range(3, 8))
    assert all(len(r) > 7 for r, _, _ in blocks.search(w, w, w @ w.T, w.T @ w, blocks.Search(x_size=(7, 30), y_size=(0, 40))))


def test_blocked_correlation_equals_long(spark):
    rng = np.random.default_rng(2)
    rows = [(i, rng.random(3).tolist(), rng.random(4).tolist()) for i in range(25)]
    df = spark.createDataFrame(rows, "id int, x array<double>, y array<double>")
    wide = {(r.x, r.y): r.r for r in blocks.correlate_wide(df, "x", "y", list("abc"), list("wxyz")).collect()}
    x, y = np.array([r[1] for r in rows]), np.array([r[2] for r in rows])
    for i, a in enumerate("abc"):
        for j, b in enumerate("wxyz"):
            assert wide[a, b] == pytest.approx(np.corrcoef(x[:, i], y[:, j])[0, 1])


def test_wilcoxon_small_and_tied(spark):
    df = spark.createDataFrame([(1.0, 1), (2.0, 0), (2.0, 1), (3.0, 0)], "v double, g int")
    r = one(inference.wilcoxon(df, "v", "g"))
    assert r["small"] and r["tied"] and r["p_value"] is None and r["w"] == 0.5


def test_frailty_rounds_half_to_even(spark):
    df = spark.createDataFrame([(1, 1, 0, 0, None), (1, 1, 1, None, None), (None, None, 1, 1, None)], "a int, b int, c int, d int, e int")
    score, label = recodes.frailty([F.col(c) for c in "abcde"], F.lit(True))
    got = [tuple(r) for r in df.select(score, label).collect()]
    assert got[0] == (2.0, "Intermediate") and got[1] == (5.0, "Frail") and got[2] == (None, "Missing")


def test_null_bucket_gets_its_cut(spark):
    df = spark.createDataFrame([(1, None, 1.0), (2, None, 3.0), (3, 1, 5.0)], "id int, b int, v double")
    got = {r.id: r.cut for r in recodes.with_bucket_cut(df, "b", "v", 0.5, "cut").collect()}
    assert got == {1: 2.0, 2: 2.0, 3: 5.0}


def test_unique_names_avoid_collisions():
    assert labels.unique_names(["a", "a", "a.1", "a"]) == ["a", "a.2", "a.1", "a.3"]


def test_make_unique_skips_names_that_are_there(spark):
    names = ["a", "a", "a.1", "a", "a.3", "a", "b", "a.1", "x.2", None, None, "a."]
    df = spark.createDataFrame(list(enumerate(names)), "i int, n string")
    got = [r.n_unique for r in labels.make_unique(df, "n", ["i"]).orderBy("i").collect()]
    assert got == ["a", "a.2", "a.1", "a.4", "a.3", "a.5", "b", "a.1.1", "x.2", None, None, "a."]


def test_contracts_raise(spark):
    df = spark.createDataFrame([("1", "D", 1.0), ("1", "A", float("inf")), (" ", "X", None)], "id string, status string, v double")
    checks = contracts.frame_checks(df, "id", "status", ["D", "A"], ["v"])
    assert {r.check: r.failures for r in checks.collect()} == {"empty_id": 1, "repeated_id": 1, "unknown_outcome": 1, "not_finite": 1}
    with pytest.raises(ValueError, match="not_finite"):
        contracts.enforce(checks)
    with pytest.raises(ValueError):
        relational.require_unique(df, ["id"])


def test_membership_of_null_is_false(spark):
    df = spark.createDataFrame([(None,), ("a",)], "v string")
    assert [r[0] for r in df.select(~scalars.is_in(F.col("v"), ["a"])).collect()] == [True, False]


def test_neg_log_p_of_zero_is_the_cap(spark):
    df = spark.createDataFrame([(0.0,), (0.1,), (None,)], "p double")
    got = [r[0] for r in df.select(scalars.neg_log10(F.col("p"))).collect()]
    assert got[0] == 15.0 and got[1] == pytest.approx(1.0) and got[2] is None


def _small_cohort(spark, n=60, seed=3):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        y = i % 2
        layer = (rng.normal(size=6) + y * 1.5 * (np.arange(6) == 4)).tolist()
        rows.append((i, float(y), float(2 * y + rng.normal()), None if i % 11 == 0 else "u" if rng.random() < 0.5 else "v", layer))
    return spark.createDataFrame(rows, "id int, label double, a double, c string, layer array<double>")


def test_assessment_rows_do_not_change_a_fit(spark):
    from tessera.operators import models

    df = _small_cohort(spark)
    names = tuple(f"g{k}" for k in range(6))
    ln = models.Learner("m", "elastic", ("a",), ("c",), ({"regParam": 0.05, "elasticNetParam": 0.5},), "layer", names, ("sis", 2))
    analysis, assessment = df.where("id < 40"), df.where("id >= 40")
    wild = assessment.withColumn("a", F.when(F.col("id") == 50, 1e6).otherwise(F.col("a"))).withColumn("c", F.when(F.col("id") == 51, "new").otherwise(F.col("c")))
    one_, two = ({r.id: r.risk for r in models.fit_predict(analysis, x, ln, ln.grid[0], ["id", "label"]).collect()} for x in (assessment, wild))
    assert all(one_[i] == pytest.approx(two[i]) for i in one_ if i not in (50, 51)) and set(one_) == set(range(40, 60))
    assert "g4" in models.screened(analysis, ln, "id") and len(models.screened(analysis, ln, "id")) == 2
    assert "g4" in models.screened(analysis, models.Learner("m", "elastic", layer="layer", names=names, screen=("mrmr", 2)), "id")
    assert "g4" in models.screened(analysis, models.Learner("m", "elastic", layer="layer", names=names, screen=("moderated", 3)), "id")


def test_nested_cv_resumes_and_stacks(spark, tmp_path):
    from tessera.operators import models

    df = _small_cohort(spark)
    folds = resampling.stratified_folds(df, "id", ["label"], 2)
    inner = resampling.inner_folds(folds, "id", ["label"], 2)
    names = tuple(f"g{k}" for k in range(6))
    learners = [
        models.Learner("m1", "elastic", ("a",), ("c",), ({"regParam": 0.05}, {"regParam": 0.5})),
        models.Learner("m2", "boosted", (), (), ({"maxIter": 3, "maxDepth": 2},), "layer", names, ("sis", 2), stop=True),
    ]
    path = str(tmp_path / "cv")
    p, oof, tuning = models.nested_cv(df, "id", folds, inner, learners, path)
    assert p.groupBy("model", "id").count().where("count <> 1").count() == 0 and p.count() == 120 and oof.count() == 120
    t = {(r.fold_id, r.model): r for r in tuning.collect()}
    assert len(t) == 4 and all(t[f, "m2"].n_features == 2 and "g4" in t[f, "m2"].selected_features and t[f, "m1"].score > 0.5 for f in (1, 2))
    before = sorted(x.stat().st_mtime_ns for x in (tmp_path / "cv").rglob("*.parquet"))
    again, _, _ = models.nested_cv(df, "id", folds, inner, learners, path)
    assert again.count() == 120 and sorted(x.stat().st_mtime_ns for x in (tmp_path / "cv").rglob("*.parquet")) == before
    risks, weights = models.stack_ridge(oof, p, "id", ["m1", "m2"], (1e-4, 1e-2, 1.0))
    got = risks.collect()
    assert sorted(r.id for r in got) == list(range(60)) and all(0 < r.risk < 1 for r in got)
    assert models._rank_auc(np.array([r.truth for r in got]), np.array([r.risk for r in got])) > 0.6
    assert [(r.fold_id, len(r.weights), r.penalty in (1e-4, 1e-2, 1.0)) for r in weights.orderBy("fold_id").collect()] == [(1, 2, True), (2, 2, True)]


def test_ridge_logistic_is_the_minimum():
    from tessera.operators.models import ridge_logistic

    rng = np.random.default_rng(1)
    x = rng.normal(size=(80, 2))
    y = (x[:, 0] + rng.normal(size=80) > 0).astype(float)
    loss = lambda w, p: np.logaddexp(0, w[0] + x @ w[1:]).mean() - (y * (w[0] + x @ w[1:])).mean() + p / 2 * (w[1:] ** 2).sum()
    for p in (1e-6, 0.1, 10.0):
        w = ridge_logistic(x, y, p)
        assert all(loss(w, p) <= loss(w + d, p) + 1e-10 for d in rng.normal(size=(50, 3)) * 0.05)


def test_exact_rank_sum_p(spark):
    from itertools import combinations

    from tessera.functions import tails

    for m, n in ((1, 1), (2, 3), (4, 3), (5, 5)):
        ws = [sum(c) - m * (m + 1) // 2 for c in combinations(range(1, m + n + 1), m)]
        below = [sum(x <= w for x in ws) / len(ws) for w in range(m * n + 1)]
        assert tails.rank_sum_shares(m, n).tolist() == pytest.approx(below)
        for w in range(m * n + 1):
            tail = min(sum(x <= w for x in ws), sum(x >= w for x in ws)) / len(ws)
            assert tails.rank_sum_two_sided(w, m, n) == pytest.approx(min(1.0, 2 * tail))
    df = spark.createDataFrame([(float(i), int(i in (1, 2, 4))) for i in range(1, 8)], "v double, g int")
    r = one(inference.wilcoxon(df, "v", "g"))
    assert r["w"] == 1.0 and r["p_value"] == pytest.approx(2 * 2 / 35)


def enumerated_fisher(table):
    """P of Fisher's test by going through all tables with the same margins."""
    t = np.array(table)
    rows, cols = t.sum(axis=1), t.sum(axis=0)
    weight = lambda m: -sum(math.lgamma(v + 1) for v in m)
    found = []

    def fill(i, rest, cells):
        if i == len(rows) - 1:
            found.append(weight([*cells, *rest]))
            return

        def across(j, left, own):
            if j == len(cols) - 1:
                if left <= rest[j]:
                    last = [*own, left]
                    fill(i + 1, [r - v for r, v in zip(rest, last)], [*cells, *last])
                return
            for v in range(min(left, rest[j]) + 1):
                across(j + 1, left - v, [*own, v])

        across(0, rows[i], [])

    fill(0, list(cols), [])
    p = np.exp(np.array(found) - max(found))
    mine = math.exp(weight(t.ravel()) - max(found))
    return float(p[p <= mine * (1 + 1e-7)].sum() / p.sum())


def test_random_tables_keep_margins_and_odds():
    rng = np.random.default_rng(1)
    t = inference.random_tables(np.array([3, 0, 4, 2]), np.array([5, 1, 3]), 20_000, rng)
    assert (t >= 0).all() and (t.sum(axis=2) == [3, 0, 4, 2]).all() and (t.sum(axis=1) == [5, 1, 3]).all()
    assert np.abs(t.mean(axis=0) - np.outer([3, 0, 4, 2], [5, 1, 3]) / 9).max() < 0.03


def test_fisher_against_enumeration(spark):
    tables = {"a": [[3, 1], [0, 4], [2, 2]], "b": [[5, 0, 1], [0, 4, 1], [1, 1, 3]], "c": [[4, 0], [1, 3]], "d": [[7, 2]], "e": [[1, 9], [8, 2], [5, 5], [0, 3]]}
    rows = [(g, f"r{i}", f"c{j}") for g, t in tables.items() for i, r in enumerate(t) for j, n in enumerate(r) for _ in range(n)] + [("a", None, "c0"), ("f", None, None)]
    df = spark.createDataFrame(rows, "g string, x string, y string")
    got = {r.g: r.p_value for r in inference.fisher_simulated(df, "x", "y", ["g"], 20_000).collect()}
    assert set(got) == set(tables) and got["d"] == 1.0 and got["c"] == pytest.approx(enumerated_fisher(tables["c"]), abs=1e-9)
    for g in "abe":
        want = enumerated_fisher(tables[g])
        assert abs(got[g] - want) < 5 * math.sqrt(want * (1 - want) / 20_000) + 1e-4, g
    again = {r.g: r.p_value for r in inference.fisher_simulated(df.repartition(5), "x", "y", ["g"], 20_000).collect()}
    assert again == got


def test_tails_as_arrays():
    from tessera.functions import tails

    x = np.concatenate([np.linspace(1e-8, 30, 400), [100.5, 1e4, 1e8]])
    assert np.allclose(tails._lgamma(x), [math.lgamma(v) for v in x], rtol=1e-13, atol=1e-13)
    z = np.concatenate([np.linspace(-6, 6, 481), [0.0, 20.0, 26.0]])
    assert np.allclose(tails._erfc(z), [math.erfc(v) for v in z], rtol=1e-11, atol=0)
    assert tails.chi2_upper([0.0, -1.0, np.nan, np.inf, 4.0], 2.0)[[0, 1, 3]].tolist() == [1.0, 1.0, 0.0] and np.isnan(tails.chi2_upper(np.nan, 2.0))
    k = np.arange(1, 60)
    assert np.allclose(tails.chi2_upper(2.0 * k, 2.0), np.exp(-k), rtol=1e-12)


def test_characteristics_by_layer(spark):
    from tessera.operators import tables

    rows = [(i, "ab"[i % 2], "xyz"[i % 3], "Yes" if i % 4 else "No", float(i % 7), int(i % 5 < 2)) for i in range(60)]
    df = spark.createDataFrame(rows, "id int, layer string, kind string, flag string, v double, truth int")
    both = tables.characteristics(df, "id", "truth", ["kind"], ["flag"], ["v"], by=["layer"])
    key = lambda r: (r["variable"], r["level"])
    for g in "ab":
        alone = {key(r): r for r in tables.characteristics(df.where(F.col("layer") == g), "id", "truth", ["kind"], ["flag"], ["v"]).collect()}
        found = {key(r): r for r in both.where(F.col("layer") == g).collect()}
        assert set(alone) == set(found) and all(alone[k]["n"] == found[k]["n"] and (alone[k]["p_value"] is None) == (found[k]["p_value"] is None) for k in alone)
        assert all(alone[k]["p_value"] == pytest.approx(found[k]["p_value"], abs=0.06) for k in alone if alone[k]["p_value"] is not None)


def test_chi_square_with_few_expected(spark):
    rows = [(i, "abc"[i % 3], int(i % 3 == 0 or i % 4 == 0)) for i in range(12)]
    df = spark.createDataFrame(rows, "id int, x string, truth int")
    r = one(inference.chi_square_or_simulated(df, "id", "x", "truth", 200))
    assert r["least_expected"] < 5 and 0 < r["p_value"] <= 1
    two = one(inference.chi_square_or_simulated(df.where("x <> 'c'"), "id", "x", "truth"))
    assert two["p_value"] == pytest.approx(enumerated_fisher([[4, 0], [1, 3]]))
    many = df.crossJoin(spark.range(20).toDF("k")).withColumn("id", F.col("id") * 20 + F.col("k"))
    assert one(inference.chi_square_or_simulated(many, "id", "x", "truth"))["p_value"] == pytest.approx(one(inference.chi_square(many, "x", "truth"))["p_value"])


def test_joins_that_assert_and_column_rules(spark):
    from tessera.operators import relational

    a = spark.createDataFrame([(1, "u", 0.1), (2, "v", 0.2)], "id int, truth string, p double")
    b = spark.createDataFrame([(1, "u", 0.3), (2, "v", 0.4)], "id int, truth string, q double")
    assert relational.aligned_join(a, b, "id", "truth").columns == ["id", "truth", "p", "q"]
    for bad in (b.where("id = 1"), b.withColumn("truth", F.lit("u")), b.union(b)):
        with pytest.raises(ValueError):
            relational.aligned_join(a, bad, "id", "truth")
    hit, lost = relational.matched_left_join(a, b.where("id = 1").drop("truth"), "id")
    assert [r.id for r in hit.collect()] == [1] and [r.id for r in lost.collect()] == [2] and lost.columns == a.columns
    wide = spark.createDataFrame([(1, 2.0, 3.0, "x")], "id int, `seq.1` double, `seq.2` double, note string")
    assert relational.pick_columns(wide, r"^seq[.]") == ["seq.1", "seq.2"] and relational.pick_columns(wide, without=("note",)) == ["id", "seq.1", "seq.2"]
    assert relational.pick_columns(wide, any_of=("note", "no"), all_of=("id",)) == ["id", "note"]
    with pytest.raises(ValueError):
        relational.pick_columns(wide, all_of=("no",))
    t = relational.transposed(spark.createDataFrame([("s2", 1.0, 2.0), ("s1", 3.0, None)], "sample string, x double, y double"), "sample", ["x", "y"], "taxon")
    assert [tuple(r) for r in t.collect()] == [("x", 3.0, 1.0), ("y", None, 2.0)] and t.columns == ["taxon", "s1", "s2"]


def test_matched_output_contract(spark):
    from tessera.operators import contracts

    ids = range(12)
    cohort = spark.createDataFrame([(i, i % 2) for i in ids], "id int, truth int")
    expected = spark.createDataFrame([("EN", "a"), ("EN", "b"), ("RF", "clinical")], "model string, layer string")
    keys = [tuple(r) for r in expected.collect()]
    preds = [(i, i % 2, 0.5, m, n) for m, n in keys for i in ids]
    reps = [(i, i % 2, 0.5, m, n, r, i % 3 + 1) for m, n in keys for r in (1, 2) for i in ids]
    tune = [(m, n, r, f, 1, ["g"]) for m, n in keys for r in (1, 2) for f in (1, 2, 3)]
    P, R, T = "id int, truth int, risk double, model string, layer string", "id int, truth int, risk double, model string, layer string, repeat_id int, fold_id int", "model string, layer string, repeat_id int, fold_id int, n_features int, selected_features array<string>"

    def faults(p, rep, t):
        got = contracts.matched_output_checks(spark.createDataFrame(p, P), spark.createDataFrame(rep, R), spark.createDataFrame(t, T), cohort, expected, "id", 2, 3)
        return {(r.model, r.layer, r.check): r.failures for r in got.collect() if r.failures}

    assert faults(preds, reps, tune) == {}
    p = [x for x in preds if x[3:] != ("EN", "b")] + [(0, 0, 0.5, "EN", "a"), (99, 0, 0.5, "EN", "a"), (1, 1, 0.5, "new", "a")]
    p = [(i, 1 - t if (i, m) == (4, "RF") else t, 1.5 if (i, m) == (5, "RF") else r, m, n) for i, t, r, m, n in p]
    rep = [x for x in reps if x[0] != 3 or x[3:5] != ("EN", "a")]
    rep = [(*x[:6], 1 + x[6] % 3) if (x[0], x[3], x[5]) == (7, "RF", 2) else x for x in rep]
    got = faults(p, rep, [(*x[:4], 2, x[5]) if x[:4] == ("EN", "a", 1, 1) else x for x in tune if x[:4] != ("RF", "clinical", 2, 3)])
    assert got == {
        ("EN", "b", "absent_id"): 12, ("EN", "a", "repeated_id"): 1, ("EN", "a", "unknown_id"): 1, ("RF", "clinical", "other_truth"): 1, ("RF", "clinical", "invalid_risk"): 1,
        ("new", "a", "unexpected"): 1, ("new", "a", "absent_id"): 11, ("new", "a", "repeat_absent"): 24, ("new", "a", "tuning_absent"): 6,
        ("EN", "a", "repeat_absent"): 2, ("RF", "clinical", "other_fold"): 1, ("EN", "a", "wrong_feature_count"): 1, ("RF", "clinical", "tuning_absent"): 1,
    }
    train = spark.createDataFrame([(k, k % 2) for k in range(1, 6)], "train_row int, truth int")
    oof = spark.createDataFrame([(k, None if k == 2 else k % 2, 0.4, "m") for k in (1, 2, 3, 3)] + [(4, 1, float("nan"), "m")], "train_row int, truth int, risk double, model string")
    assert {r.check: r.failures for r in contracts.out_of_fold_checks(oof, train).collect()} == {"no_permutation": 2, "other_truth": 1, "invalid_risk": 1}


def test_cells_and_aliases(spark):
    df = spark.createDataFrame([(0.0004, 3, 12.345, "x1"), (0.05, 4, -1.0, "y"), (0.25, 5, 0.0, None), (None, 6, 2.5, "z")], "p double, n int, v double, k string")
    got = df.select(
        labels.p_text(F.col("p")).alias("p"), labels.count_cell(F.col("n"), F.col("v")).alias("c"), labels.mean_cell(F.col("v"), F.col("v")).alias("m"),
        labels.difference_cell(F.col("v"), F.col("v") - 1, F.col("v") + 1).alias("d"), labels.canonical(F.col("k"), {"x1": "x"}).alias("k"), labels.title_case(F.lit("a bc")).alias("t"),
    ).collect()
    assert [r.p for r in got] == ["<0.001", "0.050", "0.25", None] and got[0].c == "3 (12.3%)" and got[1].m == "-1.00 (-1.00)"
    assert got[3].d == "+2.500 (+1.500 to +3.500)" and [r.k for r in got] == ["x", "y", None, "z"] and got[0].t == "A Bc"


def test_contract_faults_name_the_rows(spark):
    from tessera.operators import contracts

    found = spark.createDataFrame([("a", 3, 1), ("b", 5, None), ("d", 1, 1)], "layer string, n int, events int")
    declared = spark.createDataFrame([("a", 3, 1), ("b", 4, None), ("c", 1, 1)], "layer string, n int, events int")
    assert sorted(r.layer for r in contracts.contract_faults(found, declared, "layer").collect()) == ["b", "c", "d"]


def test_oof_agreement_and_single_predictor(spark):
    from tessera.operators import models

    a = spark.createDataFrame([(i, i / 10) for i in range(10)], "id int, risk double")
    b = a.withColumn("risk", F.col("risk") * F.col("risk"))
    r = one(models.oof_agreement(a, b, "id"))
    assert r["spearman"] == pytest.approx(1.0) and 0.9 < r["pearson"] < 1
    df = spark.createDataFrame([(i, float(i % 10 < (3 if i % 2 else 7)), float(i % 2)) for i in range(200)], "id int, label double, x double")
    p = {r.x: r.risk for r in models.single_predictor(df, df, "id", "x").join(df.select("id", "x"), "id").select("x", "risk").distinct().collect()}
    assert p[0.0] == pytest.approx(df.where("x = 0").agg(F.avg("label")).first()[0]) and p[1.0] == pytest.approx(df.where("x = 1").agg(F.avg("label")).first()[0])


def test_characteristics_have_a_p_by_variable(spark):
    rng = random.Random(6)
    rows = [(i, i % 2, "abc"[i % 3], None if i % 9 == 0 else "d" if i == 1 else "e", "Yes" if i % 4 else "No", float(i % 7 + (i % 2)), rng.random() if i < 12 else None) for i in range(60)]
    df = spark.createDataFrame(rows, "id int, g int, x string, rare string, flag string, v double, w double")
    from tessera.operators import tables

    t = tables.characteristics(df, "id", "g", ["x", "rare"], ["flag"], ["v", "w"], permutations=60).collect()
    p = {}
    for r in t:
        p.setdefault(r.variable, set()).add(r.p_value)
    assert {k: len(v) for k, v in p.items()} == {"x": 1, "rare": 1, "flag": 1, "v": 1, "w": 1}
    want = one(inference.chi_square(df, "x", "g"))["p_value"]
    assert min(p["x"]) == pytest.approx(want) and 0 < min(p["rare"]) <= 1 and p["v"] == {None} and 0 < min(p["w"]) <= 1
    assert {r.level for r in t if r.variable == "rare"} == {"d", "e", "Missing"}
    few = df.where("id < 14").withColumn("flag", F.when(F.col("id") == 3, "Yes").otherwise("No"))
    assert {r.p_value for r in tables.characteristics(few, "id", "g", [], ["flag"], ["w"]).collect() if r.variable == "flag"} == {None}


def test_bootstrap_paths_agree(spark, monkeypatch):
    """Replicates made in arrays equal those made by joins, for several comparisons of one cohort and null groups."""
    from tessera.operators import discrimination as dn

    rng = random.Random(8)
    rows = [(g, m, i, i % 2, round(rng.random(), 1), rng.random()) for g, n in (("a", 30), (None, 21)) for m in ("x", "y") for i in range(n)]
    df = spark.createDataFrame(rows, "g string, m string, id int, truth int, r double, s double")
    for cohort in (["g"], ["g", "m"]):
        monkeypatch.setattr(dn, "few", lambda df: True)
        one_ = {(x.g, x.m): x for x in dn.bootstrap_delta(df, "id", "r", "s", replicates=25, by=["g", "m"], cohort=cohort).collect()}
        monkeypatch.setattr(dn, "few", lambda df: False)
        two = {(x.g, x.m): x for x in dn.bootstrap_delta(df, "id", "r", "s", replicates=25, by=["g", "m"], cohort=cohort).collect()}
        assert len(one_) == 4 and set(one_) == set(two)
        for k in one_:
            assert one_[k].n_valid == two[k].n_valid == 25 and one_[k].delta_lo == pytest.approx(two[k].delta_lo) and one_[k].delta_hi == pytest.approx(two[k].delta_hi)


def _by_keys(t, keys):
    return {tuple(r[k] for k in keys): r for r in t.collect()}


@pytest.mark.parametrize("sizes", [(4, 64, 16, 8, 4), (2, 50, 3, 32, 5)])
def test_bootstrap_blocks_of_a_few_rows(spark, monkeypatch, sizes):
    """Many blocks, stretches, turns, chunks and ranges give every group and what arrays give."""
    from tessera.operators import discrimination as dn

    rng = random.Random(9)
    rows = [(g, m, i, i % 2, round(rng.random(), 1), float("nan") if i == 7 else rng.random()) for g, n in (("a", 90), (None, 21), ("b", 1), ("c", 5)) for m in ("x", "y") for i in range(n)]
    df = spark.createDataFrame(rows, "g string, m string, id int, truth int, r double, s double")
    for name, value in zip(("BITS", "DRAWN", "RISKS", "TOGETHER", "COUNTED"), sizes):
        monkeypatch.setattr(dn, name, value)
    for cohort in (["g"], []):
        one_, two = (_by_keys(dn.bootstrap_delta(df, "id", "r", "s", replicates=11, by=["g", "m"], cohort=cohort, large=large), "gm") for large in (False, True))
        assert len(one_) == 8 and one_ == two


def test_slot_digests_of_60_bits():
    import hashlib

    from tessera.operators import resampling

    for seed in (1, "a seed so long that its digests take more than one block of md5"):
        want = [int(hashlib.md5(f"{seed}|boot|{k}".encode()).hexdigest()[:15], 16) for k in range(95, 105)]
        assert resampling.slot_digests(seed, 95, 10, True).tolist() == want


def _matched_sample(spark, n=60):
    rng = random.Random(10)
    rows = [(i, i % 2, layer, model, rng.random()) for i in range(n) for layer, model in (("a", "EN"), ("b", "EN"), ("a", "XGB"), ("b", "XGB"), ("clinical", "RF"))]
    return spark.createDataFrame(rows, "id int, truth int, layer string, model string, risk double")


def test_comparisons_of_many_rows_are_those_of_few(spark, monkeypatch):
    from tessera.operators import discrimination as dn
    from tessera.operators import ordered

    wide = spark.range(80).selectExpr("id", "id % 2 AS g", "CAST(id * 7 % 3 = 0 AS INT) AS truth", "id * 7 % 11 / 11D AS a", "id * 5 % 13 / 13D AS b", "id % 17 / 17D AS c")
    p = _matched_sample(spark)
    run = lambda: [
        _by_keys(dn.compare(wide, "id", ["g"], {"b": ["a", "c"]}, replicates=20), ("g", "model", "reference")),
        _by_keys(dn.between_layers(p, "id", ["a", "b"], replicates=20), ("model", "comparison")), _by_keys(dn.versus_clinical(p, "id", "RF", replicates=20), ("model", "comparison")),
    ]
    few = run()
    monkeypatch.setattr(ordered, "FEW_BYTES", -1)
    monkeypatch.setattr(ordered, "FEW_ROWS", -1)
    for a, b in zip(few, run()):
        assert set(a) == set(b) and len(a) in (2, 4)
        for k in a:
            for c, v in a[k].asDict().items():
                assert v is not None and b[k][c] == (v if isinstance(v, str) else pytest.approx(v, abs=1e-9)), (k, c)


@pytest.mark.parametrize("kind", ["between", "clinical", "compare"])
def test_comparisons_are_not_broadcast_and_made_once(spark, monkeypatch, kind):
    """Predictions meet by sorting, and the adjustment reads finished comparisons: P values made anew may differ in the last bit, and then miss each other."""
    from tessera.operators import discrimination as dn

    seen = []
    monkeypatch.setattr(dn, "compared", lambda rows, *a, _real=dn.compared: (seen.append(rows), _real(rows, *a))[1])
    p = _matched_sample(spark)
    if kind == "compare":
        wide = p.groupBy("id", "truth").agg(F.max("risk").alias("x"), F.min("risk").alias("y"))
        out = dn.compare(wide, "id", [], {"x": ["y"]}, replicates=5)
    else:
        out = dn.between_layers(p, "id", ["a", "b"], replicates=5) if kind == "between" else dn.versus_clinical(p, "id", "RF", replicates=5)
    plan = seen[0]._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and plan.count("BroadcastHashJoin") <= (kind != "clinical")  # the pairs alone
    assert "LocalTableScan" not in (made := out._jdf.queryExecution().optimizedPlan().toString()) and "LogicalRDD" not in made and "Relation" in made
