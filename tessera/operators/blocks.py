"""Two-group cross-correlation, dense blocks by peeling, and their permutation statistics."""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.scalars import fisher_z_difference, larger_magnitude
from tessera.functions.tails import log_normal_upper, log_t_two_sided
from tessera.operators.inference import with_correlation_p

CLIP, CAP = 0.9999, 15.0


#: Features of a tile on either side, rows of a tile, and features of a layer at most: pairs are a row each.
TILE, ROW_BLOCK, MOST_FEATURES = 512, 4096, 1_000_000


def _features(long: DataFrame) -> list:
    """The names of a layer in order with their means, a row each; bounded by what a table of all pairs can hold."""
    found = long.groupBy("feature").agg(F.avg("value").alias("mean")).orderBy("feature").limit(MOST_FEATURES + 1).collect()
    if len(found) > MOST_FEATURES:
        raise ValueError(f"more than {MOST_FEATURES} features")
    return found


def _as_arrays(long: DataFrame, key: str, names: list[str], out: str) -> DataFrame:
    """``(key, out)``: an array of a key's values in the order of ``names``, null where there is none."""
    kind = dict(long.dtypes)[key]
    at = long.sparkSession.createDataFrame(list(enumerate(names)), "pos int, feature string")
    cells = long.join(at, "feature").groupBy(key).agg(F.collect_list(F.struct("pos", F.col("value").cast("double").alias("value"))).alias("cells"))

    def run(batches):
        for pdf in batches:
            dense = []
            for cells in pdf["cells"]:
                row = np.full(len(names), np.nan)
                row[[c["pos"] for c in cells]] = [c["value"] for c in cells]
                dense.append(row)
            yield pd.DataFrame({key: pdf[key], out: dense})

    return cells.mapInPandas(run, f"{key} {kind}, {out} array<double>")


def correlate(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """``(x, y, n, r)`` for every feature of ``a`` with every feature of ``b``, both ``(key, feature, value)``.

    Values of a key are gathered into an array a layer, then tiles are
    correlated. Pairs without a row in common have none.
    """
    a, b = (t.select(key, "feature", "value").where("value IS NOT NULL") for t in (a, b))
    xs, ys = _features(a), _features(b)
    rows = _as_arrays(a, key, [r["feature"] for r in xs], "x").join(_as_arrays(b, key, [r["feature"] for r in ys], "y"), key)
    return correlate_tiled(rows, key, "x", "y", [r["feature"] for r in xs], [r["feature"] for r in ys], ([r["mean"] for r in xs], [r["mean"] for r in ys]))


def _means(rows: DataFrame, column: str, n: int) -> list[float]:
    found = rows.select(F.posexplode(column).alias("i", "v")).where("NOT isnan(v)").groupBy("i").agg(F.avg("v").alias("m")).collect()
    at = {r["i"]: r["m"] for r in found}
    return [at.get(k, 0.0) for k in range(n)]


def correlate_tiled(rows: DataFrame, key: str, x: str, y: str, x_names: list[str], y_names: list[str], means=None) -> DataFrame:
    """``(x, y, n, r)`` from rows with one array of features a layer, which may lack values.

    A task has a tile: some features of either layer and a block of rows. It
    multiplies matrices of values, squares and what is there, so every pair
    has the sums of its own complete rows. Where there are several blocks of
    rows their sums are added up by pair. Values are taken from their means
    first, so large means cost no digits.
    """
    p, q = len(x_names), len(y_names)
    blocks = max(1, -(-rows.count() // ROW_BLOCK))
    shift = [np.nan_to_num(np.array(m, float)) for m in (means or (_means(rows, x, p), _means(rows, y, q)))]
    whole = lambda c, n: F.coalesce(F.col(c), F.array_repeat(F.lit(None).cast("double"), n))
    tiles = lambda n: F.explode(F.sequence(F.lit(0), F.lit((n - 1) // TILE)))
    cut = lambda c, t: F.slice(c, F.col(t) * TILE + 1, TILE)
    dealt = rows.select(F.pmod(F.xxhash64(key), F.lit(blocks)).alias("block"), whole(x, p).alias("_x"), whole(y, q).alias("_y"))
    dealt = dealt.withColumn("xt", tiles(p)).withColumn("yt", tiles(q)).select("block", "xt", "yt", cut("_x", "xt").alias("vx"), cut("_y", "yt").alias("vy"))
    schema = "x string, y string, n bigint, sx double, sy double, xx double, yy double, xy double"

    def sums(table: pa.Table) -> pa.Table:
        at, to = table.column("xt")[0].as_py() * TILE, table.column("yt")[0].as_py() * TILE

        def matrix(name, names, mean, first):
            v = table.column(name).combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(float).reshape(table.num_rows, -1)
            there = ~np.isnan(v)
            return np.where(there, v - mean[first : first + v.shape[1]], 0.0), there.astype(float), names[first : first + v.shape[1]]

        v, m, xs = matrix("vx", x_names, shift[0], at)
        w, o, ys = matrix("vy", y_names, shift[1], to)
        n = np.rint(m.T @ o).astype(np.int64).ravel()
        keep = n > 0
        found = [n, (v.T @ o).ravel(), (m.T @ w).ravel(), ((v * v).T @ o).ravel(), (m.T @ (w * w)).ravel(), (v.T @ w).ravel()]
        named = [pa.array(np.repeat(np.array(xs, object), len(ys))[keep], pa.string()), pa.array(np.tile(np.array(ys, object), len(xs))[keep], pa.string())]
        return pa.Table.from_arrays([*named, *(pa.array(c[keep]) for c in found)], names=[c.split()[0] for c in schema.split(", ")])

    z = dealt.groupBy("block", "xt", "yt").applyInArrow(sums, schema)
    if blocks > 1:
        z = z.groupBy("x", "y").agg(*[F.sum(c).alias(c) for c in ("n", "sx", "sy", "xx", "yy", "xy")])
    vx, vy = (F.col("n") * F.col(c + c) - F.col("s" + c) * F.col("s" + c) for c in "xy")
    tiny = lambda v, c: F.when(v > 1e-12 * F.col("n") * F.col(c + c), v)  # noqa: E731  what rounding leaves of a constant is none
    r = F.try_divide(F.col("n") * F.col("xy") - F.col("sx") * F.col("sy"), F.sqrt(tiny(vx, "x")) * F.sqrt(tiny(vy, "y")))
    return z.select("x", "y", "n", F.when(r.isNull() | F.isnan(r), 0.0).otherwise(F.least(F.greatest(r, F.lit(-1.0)), F.lit(1.0))).alias("r"))


def correlate_wide(rows: DataFrame, x: str, y: str, x_names: list[str], y_names: list[str]) -> DataFrame:
    """The same where no row has a key: rows are dealt to blocks by all their values."""
    return correlate_tiled(rows.select(F.xxhash64(x, y).alias("_key"), x, y), "_key", x, y, x_names, y_names)


def two_group_table(d: DataFrame, a: DataFrame, cap: float = CAP) -> DataFrame:
    """``(x, y, r_d, r_a, r, nlp)``: the correlation of the group with the larger one, and the larger -log10 P."""
    dd = with_correlation_p(d, "r", "n", cap).select("x", "y", F.col("r").alias("r_d"), F.col("nlp").alias("p_d"), F.col("n").alias("n_d"))
    aa = with_correlation_p(a, "r", "n", cap).select("x", "y", F.col("r").alias("r_a"), F.col("nlp").alias("p_a"), F.col("n").alias("n_a"))
    j = dd.join(aa, ["x", "y"])
    return j.withColumn("r", larger_magnitude(F.col("r_d"), F.col("r_a"))).withColumn("nlp", F.greatest("p_d", "p_a"))


def _densest(gone: list, totals: list[float], cells: list[float], power: float) -> tuple[int, float]:
    """How many of the lines ``gone`` are missing in the densest state, and its density; none and 0 if no state beats 0."""
    if not totals:
        return 0, 0.0
    density = np.array(totals) / np.array(cells, float) ** power
    at = int(np.argmax(density))
    return (at + 1, float(density[at])) if density[at] > 0 else (0, 0.0)


def peel(w: np.ndarray, lam: float) -> tuple[np.ndarray, np.ndarray, float]:
    """The densest block met while weakest rows or columns go one at a time.

    Density is the sum over (rows * columns) to the power lam / 2, taken after
    each removal: the untouched matrix is no candidate. The side to peel is
    the one whose weakest line is weaker after scaling by the block's shape;
    the first of equals goes. Nothing is pruned if no state beats 0.
    """
    alive = [np.ones(k, bool) for k in w.shape]
    sums = [w.sum(axis=1).astype(float), w.sum(axis=0).astype(float)]
    gone: list[tuple[int, int]] = []
    totals, cells = [], []
    while all(x.any() for x in alive):
        weakest = [int(np.argmin(np.where(x, v, np.inf))) for x, v in zip(alive, sums)]
        left = [int(x.sum()) for x in alive]
        side = int(left[0] / left[1] * sums[0][weakest[0]] > sums[1][weakest[1]])
        line, other = weakest[side], 1 - side
        alive[side][line] = False
        sums[other] = sums[other] - (w[line] if side == 0 else w[:, line])
        left[side] -= 1
        gone.append((side, line))
        if left[side]:
            totals.append(sums[other][alive[other]].sum())
            cells.append(left[0] * left[1])
    n, density = _densest(gone, totals, cells, lam / 2)
    keep = [np.ones(k, bool) for k in w.shape]
    for side, line in gone[:n]:
        keep[side][line] = False
    return np.flatnonzero(keep[0]), np.flatnonzero(keep[1]), density


def peel_blocks(w: np.ndarray, lam: float, most: int = 4) -> list[tuple[np.ndarray, np.ndarray, float]]:
    """Disjoint blocks, each denser than the whole matrix, until none is."""
    whole = w.sum() / (w.shape[0] * w.shape[1]) ** (lam / 2) if w.size else 0.0
    rows, cols, out = np.arange(w.shape[0]), np.arange(w.shape[1]), []
    while len(out) < most and len(rows) and len(cols):
        r, c, density = peel(w[np.ix_(rows, cols)], lam)
        if density <= whole or not len(r) or not len(c):
            break
        out.append((rows[r], cols[c], density))
        rows, cols = np.delete(rows, r), np.delete(cols, c)
    return out


def peel_symmetric(w: np.ndarray, lam: float) -> tuple[np.ndarray, float]:
    """The densest subset of one side met while the weakest member goes; density is the sum over size to the power lam, after each removal."""
    n = len(w)
    alive, s = np.ones(n, bool), w.sum(axis=1).astype(float)
    gone, totals = [], []
    while alive.any():
        i = int(np.argmin(np.where(alive, s, np.inf)))
        alive[i] = False
        s = s - w[i]
        gone.append(i)
        totals.append(s[alive].sum())
    at, density = _densest(gone, totals[:-1], list(range(n - 1, 0, -1)), lam)
    keep = np.ones(n, bool)
    keep[gone[:at]] = False
    return np.flatnonzero(keep), density


def symmetric_blocks(w: np.ndarray, lam: float) -> list[tuple[np.ndarray, float]]:
    """Disjoint communities, each denser than the whole, until none is; meant for non-negative matrices."""
    whole = w.sum() / len(w) ** lam if len(w) else 0.0
    left, out = np.arange(len(w)), []
    while len(left):
        k, density = peel_symmetric(w[np.ix_(left, left)], lam)
        if density <= whole or not len(k):
            break
        out.append((left[k], density))
        left = np.delete(left, k)
    return out


def _by_marginal(keys: np.ndarray, marginal: np.ndarray) -> np.ndarray:
    """Members in the order of their marginal, the largest first, ties as they stand."""
    return keys[np.argsort(-marginal, kind="stable")]


def communities(r: np.ndarray, members: np.ndarray, lam: float) -> list[np.ndarray]:
    """The communities of some members in the signed matrix of their own layer, each in the order of its marginals."""
    sub = r[np.ix_(members, members)]
    sub = (sub + sub.T) / 2
    return [_by_marginal(members[k], sub[np.ix_(k, k)].sum(axis=1)) for k, _ in symmetric_blocks(sub, lam)]


def signed_refine(r: np.ndarray, members: np.ndarray, lam: float, block: str) -> list[tuple[str, np.ndarray]]:
    """A side of a block split into the communities of its own layer's signed matrix, labelled block.1, block.2, ..."""
    return [(f"{block}.{k}", c) for k, c in enumerate(communities(r, members, lam), 1)]


@dataclass(frozen=True)
class Search:
    """Exponents of the three steps and the size bounds of either side (a side larger than its bound is refined)."""

    lam: tuple[float, float, float] = (1.4, 1.5, 1.5)
    x_size: tuple[float, float] = (0, 15)
    y_size: tuple[float, float] = (0, 15)
    most: int = 4


def search(w: np.ndarray, r_xy: np.ndarray, r_xx: np.ndarray, r_yy: np.ndarray, how: Search) -> list[tuple[np.ndarray, np.ndarray, float]]:
    """Blocks of the cross matrix ``w``; small ones go, then sides over their upper bound are refined.

    A side is too small unless it is strictly larger than its lower bound.
    Features are in the order of the size of their marginal in ``r_xy``. A
    refined side is all its communities in its layer's signed correlations,
    one after another; without any it stays.
    """
    out = []
    for r, c, density in peel_blocks(w, how.lam[0], how.most):
        sub = r_xy[np.ix_(r, c)]
        r, c = _by_marginal(r, np.abs(sub.sum(axis=1))), _by_marginal(c, np.abs(sub.sum(axis=0)))
        if len(r) > how.x_size[0] and len(c) > how.y_size[0]:
            out.append((r, c, density))

    def refined(members, matrix, size, lam):
        found = communities(matrix, members, lam) if len(members) > size[1] else []
        return np.concatenate(found) if found else members

    return [(refined(r, r_xx, how.x_size, how.lam[1]), refined(c, r_yy, how.y_size, how.lam[2]), density) for r, c, density in out]


def find_blocks(edges: DataFrame, pair: list[str], lam: float, value: str = "nlp", most: int = 4) -> DataFrame:
    """``(pair, block_id, axis, feature, ord, density)`` from edges ``(pair, x, y, value)``: one task a pair.

    A pair's matrix is dense and peeled sequentially, so it has to fit a task;
    pairs and permutations are what is spread. Features are ordered by their
    marginal in the block, the strongest first.
    """
    kinds = dict(edges.dtypes)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        xs, ys = np.sort(pdf["x"].unique()), np.sort(pdf["y"].unique())
        w = np.zeros((len(xs), len(ys)))
        w[np.searchsorted(xs, pdf["x"]), np.searchsorted(ys, pdf["y"])] = pdf[value]
        rows = []
        for b, (r, c, density) in enumerate(peel_blocks(w, lam, most), 1):
            sub = w[np.ix_(r, c)]
            for axis, names, sums in (("x", xs[r], sub.sum(1)), ("y", ys[c], sub.sum(0))):
                for o, k in enumerate(np.argsort(-np.abs(sums), kind="stable"), 1):
                    rows.append((*[pdf[p].iloc[0] for p in pair], b, axis, names[k], o, density))
        return pd.DataFrame(rows, columns=[*pair, "block_id", "axis", "feature", "ord", "density"])

    schema = ", ".join([*(f"{p} {kinds[p]}" for p in pair), "block_id int, axis string, feature string, ord int, density double"])
    return edges.groupBy(*pair).applyInPandas(run, schema)


def find_communities(edges: DataFrame, pair: list[str], lam: float, value: str = "r") -> DataFrame:
    """``(pair, block_id, feature, density)`` from both directions of the edges ``(pair, x, y, value)`` of one side: one task a pair."""
    kinds = dict(edges.dtypes)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        names = np.sort(pdf["x"].unique())
        w = np.zeros((len(names), len(names)))
        w[np.searchsorted(names, pdf["x"]), np.searchsorted(names, pdf["y"])] = pdf[value]
        rows = [(*[pdf[p].iloc[0] for p in pair], b, names[i], density) for b, (k, density) in enumerate(symmetric_blocks(w, lam), 1) for i in k]
        return pd.DataFrame(rows, columns=[*pair, "block_id", "feature", "density"])

    schema = ", ".join([*(f"{p} {kinds[p]}" for p in pair), "block_id int, feature string, density double"])
    return edges.groupBy(*pair).applyInPandas(run, schema)


def feature_order(edges: DataFrame, membership: DataFrame) -> DataFrame:
    """``(block_id, axis, feature, marginal, ord)``: features of a block by the size of their marginal."""
    from pyspark.sql import Window

    mx = membership.where("axis = 'x'").select("block_id", F.col("feature").alias("x"))
    my = membership.where("axis = 'y'").select("block_id", F.col("feature").alias("y"))
    e = edges.join(mx, "x").join(my, ["block_id", "y"])
    both = e.select("block_id", F.lit("x").alias("axis"), F.col("x").alias("feature"), "nlp").union(e.select("block_id", F.lit("y"), "y", "nlp"))
    m = both.groupBy("block_id", "axis", "feature").agg(F.sum("nlp").alias("marginal"))
    w = Window.partitionBy("block_id", "axis").orderBy(F.desc(F.abs(F.round("marginal", 9))), "feature")
    return m.withColumn("ord", F.row_number().over(w))


def block_summary(edges: DataFrame, membership: DataFrame) -> DataFrame:
    """``(block_id, len_x, len_y, mean_r, mean_r_d, mean_r_a, mean_nlp)``, the largest mean correlation first."""
    mx = membership.where("axis = 'x'").select("block_id", F.col("feature").alias("x"))
    my = membership.where("axis = 'y'").select("block_id", F.col("feature").alias("y"))
    e = edges.join(mx, "x").join(my, ["block_id", "y"])
    return e.groupBy("block_id").agg(
        F.countDistinct("x").alias("len_x"), F.countDistinct("y").alias("len_y"), F.avg("r").alias("mean_r"),
        F.avg("r_d").alias("mean_r_d"), F.avg("r_a").alias("mean_r_a"), F.avg("nlp").alias("mean_nlp"),
    ).orderBy(F.desc("mean_r"), "block_id")


def cell_table(edges: DataFrame, membership: DataFrame, low: float = -1.0, high: float = 1.0, colours: int = 100) -> DataFrame:
    """The cells of a block's heat map: positions, clipped correlation, colour index."""
    mx = membership.where("axis = 'x'").select("block_id", F.col("feature").alias("x"), F.col("ord").alias("row"))
    my = membership.where("axis = 'y'").select("block_id", F.col("feature").alias("y"), F.col("ord").alias("col"))
    v = F.least(F.greatest("r", F.lit(low)), F.lit(high))
    return edges.join(mx, "x").join(my, ["block_id", "y"]).select("block_id", "row", "col", v.alias("value"), F.least(F.floor((v - low) / (high - low) * colours) + 1, F.lit(colours)).alias("colour"))


def z_differences(d: DataFrame, a: DataFrame) -> DataFrame:
    """``(x, y, z, r_d, r_a)``: Fisher's z of the difference of the two groups' correlations."""
    dd = d.select("x", "y", F.col("r").alias("r_d"), F.col("n").alias("n_d"))
    aa = a.select("x", "y", F.col("r").alias("r_a"), F.col("n").alias("n_a"))
    return dd.join(aa, ["x", "y"]).withColumn("z", fisher_z_difference(F.col("r_d"), F.col("n_d"), F.col("r_a"), F.col("n_a")))


def block_statistics(z: DataFrame, membership: DataFrame) -> DataFrame:
    """Per block: how many z, their squares' sum, sizes, signs, the groups' mean correlations on Fisher's scale and back, and their difference there."""
    mx = membership.where("axis = 'x'").select("block_id", F.col("feature").alias("x"))
    my = membership.where("axis = 'y'").select("block_id", F.col("feature").alias("y"))
    j = z.join(mx, "x").join(my, ["block_id", "y"])
    at = lambda c: F.atanh(F.least(F.greatest(c, F.lit(-CLIP)), F.lit(CLIP)))
    out = j.groupBy("block_id").agg(
        F.count("z").alias("n_valid"), F.sum(F.col("z") * F.col("z")).alias("sum_z2"), F.max(F.abs("z")).alias("max_abs_z"), F.avg(F.abs("z")).alias("mean_abs_z"),
        F.sum((F.col("z") > 0).cast("bigint")).alias("n_pos"), F.sum((F.col("z") < 0).cast("bigint")).alias("n_neg"),
        F.avg(at("r_d")).alias("mean_z_d"), F.avg(at("r_a")).alias("mean_z_a"), F.avg(F.abs(at("r_d") - at("r_a"))).alias("delta_abs_r"),
    )
    out = out.withColumn("r_d", F.tanh("mean_z_d")).withColumn("r_a", F.tanh("mean_z_a")).withColumn("delta", F.col("mean_z_d") - F.col("mean_z_a"))
    return out.withColumn("min_abs_r", F.least(F.abs("r_d"), F.abs("r_a"))).withColumn("max_abs_r", F.greatest(F.abs("r_d"), F.abs("r_a")))


#: Values of a cohort that travels to every permutation's task at most.
COHORT_VALUES = 50_000_000

LOG = (
    "perm_id int, block_id int, p int, q int, n int, n_valid int, psi_diff double, a_diff double, bound_diff double, sum_z2 double, a_z2 double, bound_z2 double,"
    " max_abs_z double, mean_abs_z double, n_pos int, n_neg int, psi_d double, psi_a double, mean_z_d double, mean_z_a double, r_d double, r_a double,"
    " delta double, delta_abs_r double, min_abs_r double, max_abs_r double"
)


def permuted_mask(keys: list, observed: np.ndarray, perm_id: int, seed=1) -> np.ndarray:
    """Which rows are events under a permutation: as ``resampling.permuted_labels`` draws them; 0 is the observed one."""
    if perm_id == 0:
        return observed
    order = sorted(range(len(keys)), key=lambda i: (hashlib.md5(f"{seed}|perm|{perm_id}|{keys[i]}".encode()).hexdigest()[:8], keys[i]))
    mask = np.zeros(len(keys), bool)
    mask[order[: int(observed.sum())]] = True
    return mask


def permutation_log(rows: DataFrame, key: str, x: str, y: str, label: str, perms: DataFrame, how: Search, seed=1) -> DataFrame:
    """One row per block of every ``perms(perm_id)``: the whole search under permuted labels, permutations spread over tasks.

    ``rows`` has an array of features for each layer; the cohort, not the
    permutations, travels to every task, and is refused beyond
    ``COHORT_VALUES``. Labels are drawn in the task, so shards are parts of
    ``perms``, and a run is resumed with the ids that ``sinks.remaining``
    gives. A permutation without a block has no row. ``psi_*`` add up -2 ln P:
    of the group difference, and of each group's correlations.
    """
    spark = rows.sparkSession
    wide = rows.select(F.count("*").alias("n"), F.max(F.size(x) + F.size(y)).alias("k")).first()
    if wide["n"] * (wide["k"] or 0) > COHORT_VALUES:
        raise ValueError(f"a cohort of {wide['n']} rows with {wide['k']} features does not fit every task")
    local = rows.select(key, x, y, label).orderBy(key).toPandas()
    keys, observed = local[key].tolist(), (local[label] == 1).to_numpy()
    cohort = spark.sparkContext.broadcast(tuple(np.stack(local[c].to_numpy()).astype(float) for c in (x, y)))

    def corr(p, q):
        p, q = p - p.mean(0), q - q.mean(0)
        den = np.outer(np.sqrt((p * p).sum(0)), np.sqrt((q * q).sum(0)))
        return np.clip(np.divide(p.T @ q, den, out=np.zeros_like(den), where=den > 0), -CLIP, CLIP)

    def log_p(r, n):
        return log_t_two_sided(r * np.sqrt((n - 2) / (1 - r * r)), n - 2)

    def bound(v, df):
        return 0.0 if v <= 1 else -(df / 2) * (v - 1 - np.log(v)) / np.log(10)

    def larger(d, a):
        return np.where(np.abs(d) >= np.abs(a), d, a)

    def blocks_of(perm_id: int):
        a, b = cohort.value
        mask = permuted_mask(keys, observed, perm_id, seed)
        n1, n0 = int(mask.sum()), int((~mask).sum())
        pair = lambda p, q: (corr(p[mask], q[mask]), corr(p[~mask], q[~mask]))
        r1, r0 = pair(a, b)
        w = np.maximum(-log_p(r1, n1), -log_p(r0, n0)) / np.log(10)
        w = np.where(np.isfinite(w), np.minimum(w, CAP), CAP)
        z1, z0 = np.arctanh(r1), np.arctanh(r0)
        z = (z1 - z0) / np.sqrt(1 / (n1 - 3) + 1 / (n0 - 3))
        for k, (r, c, _) in enumerate(search(w, larger(r1, r0), larger(*pair(a, a)), larger(*pair(b, b)), how), 1):
            at = np.ix_(r, c)
            zz, d, e = z[at].ravel(), z1[at].ravel(), z0[at].ravel()
            n, size = len(zz), np.abs(zz)
            psi, s2 = float(-2 * (np.log(2) + log_normal_upper(size)).sum()), float((zz * zz).sum())
            means = np.tanh([d.mean(), e.mean()])
            yield (
                perm_id, k, len(r), len(c), n, int(np.isfinite(zz).sum()), psi, psi / (2 * n), bound(psi / (2 * n), 2 * n), s2, s2 / n, bound(s2 / n, n),
                float(size.max()), float(size.mean()), int((zz > 0).sum()), int((zz < 0).sum()),
                float(-2 * log_p(r1[at], n1).sum()), float(-2 * log_p(r0[at], n0).sum()), float(d.mean()), float(e.mean()), *means.tolist(),
                float(d.mean() - e.mean()), float(np.abs(d - e).mean()), float(np.abs(means).min()), float(np.abs(means).max()),
            )

    names = [c.split()[0] for c in LOG.split(",")]

    def run(batches):
        for pdf in batches:
            yield pd.DataFrame([row for p in pdf["perm_id"] for row in blocks_of(int(p))], columns=names)

    return perms.select(F.col("perm_id").cast("int").alias("perm_id")).mapInPandas(run, LOG)


def permutation_shard(spark, permutations: int, shard: int = 0, shards: int = 1) -> DataFrame:
    """The ids of one of several shards, 0 (the observed labels) to ``permutations``, an id a task at most."""
    ids = spark.range(0, permutations + 1, 1, permutations + 1).where(F.col("id") % shards == shard)
    return ids.select(F.col("id").cast("int").alias("perm_id"))
