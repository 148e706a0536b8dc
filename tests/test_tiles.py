"""Correlations by tiles against the definition, missing values and wide layers included."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest

from tessera.operators import blocks


def cohort(rows, p, q, lacking=0.15, seed=1):
    rng = np.random.default_rng(seed)
    x, y = rng.normal(1e4, 1, (rows, p)), rng.normal(0, 1, (rows, q))
    y[:, : min(p, q) // 2] += x[:, : min(p, q) // 2] - 1e4
    for m in (x, y):
        m[rng.random(m.shape) < lacking] = np.nan
    x[:, 0], y[:, -1] = 7.0, np.nan
    return x, y


def frame(spark, x, y):
    plain = lambda m: [[None if np.isnan(v) else float(v) for v in r] for r in m]
    return spark.createDataFrame(list(zip(range(len(x)), plain(x), plain(y))), "id int, x array<double>, y array<double>")


def held(got, x, y, xs, ys):
    both = pd.concat([pd.DataFrame(x, columns=xs), pd.DataFrame(y, columns=ys)], axis=1)
    want = both.corr(min_periods=1).loc[xs, ys].to_numpy()
    there = (~np.isnan(x)).astype(int).T @ (~np.isnan(y)).astype(int)
    rows = {(r.x, r.y): (r.n, r.r) for r in got.collect()}
    assert len(rows) == (there > 0).sum()
    for i, a in enumerate(xs):
        for j, b in enumerate(ys):
            if there[i, j]:
                n, r = rows[a, b]
                assert n == there[i, j] and abs(r - (0.0 if np.isnan(want[i, j]) or n < 2 else want[i, j])) < 1e-9, (a, b)


@pytest.mark.parametrize("tile, rows", [(4, 1000), (512, 16), (5, 16)])
def test_tiles_against_pandas(spark, monkeypatch, tile, rows):
    monkeypatch.setattr(blocks, "TILE", tile)
    monkeypatch.setattr(blocks, "ROW_BLOCK", rows)
    x, y = cohort(60, 11, 9)
    xs, ys = [f"x{k:02d}" for k in range(11)], [f"y{k:02d}" for k in range(9)]
    df = frame(spark, x, y).repartition(3)
    held(blocks.correlate_tiled(df, "id", "x", "y", xs, ys), x, y, xs, ys)
    held(blocks.correlate_wide(df, "x", "y", xs, ys), x, y, xs, ys)
    long = lambda m, names: spark.createDataFrame([(i, n, float(v)) for i, r in enumerate(m) for n, v in zip(names, r) if not np.isnan(v)], "id int, feature string, value double")
    held(blocks.correlate(long(x, xs), long(y, ys), "id"), x, y, xs, ys)


def test_no_rows_and_missing_arrays(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0], None), (2, [2.0, 1.0], [1.0]), (3, [3.0, None], [2.0])], "id int, x array<double>, y array<double>")
    got = {(r.x, r.y): (r.n, r.r) for r in blocks.correlate_tiled(df, "id", "x", "y", ["a", "b"], ["c"]).collect()}
    assert got == {("a", "c"): (2, 1.0), ("b", "c"): (1, 0.0)}
    assert blocks.correlate_tiled(df.limit(0), "id", "x", "y", ["a", "b"], ["c"]).count() == 0


def test_wide_layers_fit_their_tasks(spark):
    """As many features as the largest pair of layers has, a few rows of them, and some pairs looked up."""
    x, y = cohort(24, 1574, 7596, seed=2)
    xs, ys = [f"x{k:04d}" for k in range(1574)], [f"y{k:04d}" for k in range(7596)]
    df = frame(spark, x, y).repartition(4)
    out = blocks.correlate_tiled(df, "id", "x", "y", xs, ys)
    found = out.where("substring(x, 4) IN ('07', '33') AND substring(y, 4) IN ('11', '42')")
    rows = {(r.x, r.y): (r.n, r.r) for r in found.collect()}
    for (a, b), (n, r) in list(rows.items())[:200]:
        u, v = x[:, int(a[1:])], y[:, int(b[1:])]
        ok = ~np.isnan(u) & ~np.isnan(v)
        assert n == ok.sum() and abs(r - np.corrcoef(u[ok], v[ok])[0, 1]) < 1e-9
    assert len(rows) > 2000
