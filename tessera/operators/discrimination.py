"""ROC, AUC, DeLong, bootstrap differences and calibration over prediction tables.

A prediction table has a 0/1 ``truth`` and a ``risk`` of the event. The event
is never inferred and an AUC below one half is reported as it is. Everything is
grouped by ``by`` (model, layer, repeat ...), so one plan serves all groups.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.labels import title_case
from tessera.functions.scalars import EPS, logit
from tessera.functions.tails import normal_p
from tessera.operators import ordered
from tessera.operators.inference import bh_adjust, spearman
from tessera.operators.ordered import few, join_on, running
from tessera.operators.resampling import draw_numbers, slot_digests, stretches
from tessera.sources.folders import own_folder

Z95 = 1.959963984540054


def auc(df: DataFrame, by: list[str], risk: str = "risk", truth: str = "truth") -> DataFrame:
    """``(by, n1, n0, auc)`` by average ranks; ties count one half.

    Rows are first counted per distinct risk, so heavy ties cost nothing.
    """
    bins = df.where(F.col(risk).isNotNull() & F.col(truth).isNotNull()).groupBy(*by, risk).agg(
        F.sum(F.col(truth).cast("bigint")).alias("_p"), F.count("*").alias("_c")
    )
    u = F.col("_p") * (F.col("_q0") + (F.col("_c") - F.col("_p")) / 2.0)
    return (
        running(bins, by, risk, {"_q0": F.col("_c") - F.col("_p")}).withColumn("_u", u).groupBy(*by)
        .agg(F.sum("_p").alias("n1"), F.sum(F.col("_c") - F.col("_p")).alias("n0"), F.sum("_u").alias("_u"))
        .select(*by, "n1", "n0", F.try_divide(F.col("_u"), F.col("n1").cast("double") * F.col("n0")).alias("auc"))
    )


def roc_curve(df: DataFrame, by: list[str], risk: str = "risk", truth: str = "truth") -> DataFrame:
    """``(by, threshold, sensitivity, specificity)``: a point for each distinct risk, and the end where nothing is called."""
    bins = df.groupBy(*by, F.col(risk).alias("threshold")).agg(F.sum(F.col(truth).cast("bigint")).alias("_p"), F.count("*").alias("_c"))
    below = running(bins, by, "threshold", {"_fn": F.col("_p"), "_tn": F.col("_c") - F.col("_p")})
    totals = bins.groupBy(*by).agg(F.sum("_p").alias("_pos"), F.sum(F.col("_c") - F.col("_p")).alias("_neg"))
    pts = (join_on(below, totals, by) if by else below.join(totals)).select(
        *by, "threshold", F.try_divide((F.col("_pos") - F.col("_fn")).cast("double"), F.col("_pos")).alias("sensitivity"),
        F.try_divide(F.col("_tn").cast("double"), F.col("_neg")).alias("specificity"),
    )
    ends = df.select(*by).distinct().select(*by, F.lit(float("inf")).alias("threshold"), F.lit(0.0).alias("sensitivity"), F.lit(1.0).alias("specificity"))
    return pts.unionByName(ends)


def placements(df: DataFrame, by: list[str], risk: str = "risk", truth: str = "truth", name: str = "placement", large: bool = False) -> DataFrame:
    """DeLong's placement value of every row: the share of the other class that it beats, ties one half.

    Rows are counted per distinct risk; what comes before is a running sum
    over these, joined back, with ``large`` never through the driver.
    """
    bins = df.groupBy(*by, risk).agg(F.sum(F.col(truth).cast("bigint")).alias("_p"), F.count("*").alias("_c"))
    sums = running(bins, by, risk, {"_p0": F.col("_p"), "_c0": F.col("_c")})
    totals = bins.groupBy(*by).agg(F.sum("_p").alias("_pos"), F.sum(F.col("_c") - F.col("_p")).alias("_neg"))
    sums = (join_on(sums, totals, by) if by else sums.join(totals)).select(
        *by, risk, F.try_divide(F.col("_c0") - F.col("_p0") + (F.col("_c") - F.col("_p")) / 2.0, F.col("_neg")).alias("_up"),
        (1 - F.try_divide(F.col("_p0") + F.col("_p") / 2.0, F.col("_pos"))).alias("_down"),
    )
    return join_on(df, sums, [*by, risk], large=large).withColumn(name, F.when(F.col(truth) == 1, F.col("_up")).otherwise(F.col("_down"))).drop("_up", "_down")


def delong(df: DataFrame, by: list[str], risk: str = "risk", truth: str = "truth") -> DataFrame:
    """``(by, n1, n0, auc, se, lower, upper)`` with DeLong's 95 % interval, cut to [0, 1]."""
    v = placements(df, by, risk, truth)
    case = lambda c: F.when(F.col(truth) == 1, F.col(c))
    ctrl = lambda c: F.when(F.col(truth) == 0, F.col(c))
    out = v.groupBy(*by).agg(
        F.count(case("placement")).alias("n1"), F.count(ctrl("placement")).alias("n0"), F.avg(case("placement")).alias("auc"),
        F.sqrt(F.try_divide(F.var_samp(case("placement")), F.count(case("placement"))) + F.try_divide(F.var_samp(ctrl("placement")), F.count(ctrl("placement")))).alias("se"),
    )
    return out.withColumn("lower", F.greatest(F.col("auc") - Z95 * F.col("se"), F.lit(0.0))).withColumn("upper", F.least(F.col("auc") + Z95 * F.col("se"), F.lit(1.0)))


def delong_paired(df: DataFrame, key: str, by: list[str], risk_a: str, risk_b: str, truth: str = "truth", large: bool = False) -> DataFrame:
    """``(by, auc_a, auc_b, delta, z, p_value)`` of two risks of the same rows, a row for each ``key``."""
    rows = df.select(*by, truth, F.col(risk_a).alias("_ra"), F.col(risk_b).alias("_rb"))
    j = placements(placements(rows, by, "_ra", truth, "va", large), by, "_rb", truth, "vb", large)
    parts = []
    for k, c in ((1, "1"), (0, "0")):
        va, vb = F.when(F.col(truth) == k, F.col("va")), F.when(F.col(truth) == k, F.col("vb"))
        parts += [F.count(va).alias(f"n{c}"), (F.var_samp(va) + F.var_samp(vb) - 2 * F.covar_samp(va, vb)).alias(f"s{c}")]
    out = j.groupBy(*by).agg(F.avg(F.when(F.col(truth) == 1, F.col("va"))).alias("auc_a"), F.avg(F.when(F.col(truth) == 1, F.col("vb"))).alias("auc_b"), *parts)
    out = out.withColumn("delta", F.col("auc_a") - F.col("auc_b")).withColumn("z", F.try_divide(F.col("delta"), F.sqrt(F.col("s1") / F.col("n1") + F.col("s0") / F.col("n0"))))
    return out.select(*by, "auc_a", "auc_b", "delta", "z", normal_p("z").alias("p_value"))


def delong_all_pairs(predictions: DataFrame, key: str, by: list[str], models: list[str], truth: str = "truth") -> DataFrame:
    """``(by, model_a, model_b, n, auc_a, auc_b, delta, z, p_value)``: every two of ``models`` on the ids that have a risk by each.

    ``predictions`` has a row for each id and model. Each model is ranked once;
    the placements of an id then stand side by side, and one aggregation gives
    the covariances of all pairs. z is null where two models never differ.
    """
    at = range(len(models))
    wide = lambda t, name, value: t.groupBy(*by, key, truth).agg(*[F.max(F.when(F.col("model") == name(k), F.col(value))).alias(f"_v{k}") for k in at])
    risks = wide(predictions.where(F.col("model").isin(models) & F.col(truth).isNotNull()), lambda k: models[k], "risk").dropna(subset=[f"_v{k}" for k in at])
    cells = F.explode(F.array(*[F.struct(F.lit(k).alias("model"), F.col(f"_v{k}").alias("risk")) for k in at]))
    long = risks.select(*by, key, truth, cells.alias("_x")).select(*by, key, truth, "_x.model", "_x.risk")
    v = wide(placements(long, [*by, "model"], "risk", truth), lambda k: k, "placement")
    of = lambda c, k: F.when(F.col(truth) == c, F.col(f"_v{k}"))
    gram = [F.covar_samp(of(c, i), of(c, j)).alias(f"_s{c}_{i}_{j}") for c in (0, 1) for i in at for j in at if i <= j]
    sums = v.groupBy(*by).agg(F.count("*").alias("n"), F.count(F.when(F.col(truth) == 0, 1)).alias("_n0"), F.count(F.when(F.col(truth) == 1, 1)).alias("_n1"), *[F.avg(of(1, k)).alias(f"_a{k}") for k in at], *gram)
    part = lambda c, i, j: (F.col(f"_s{c}_{i}_{i}") + F.col(f"_s{c}_{j}_{j}") - 2 * F.col(f"_s{c}_{i}_{j}")) / F.col(f"_n{c}")
    pairs = [
        F.struct(F.lit(models[i]).alias("model_a"), F.lit(models[j]).alias("model_b"), F.col(f"_a{i}").alias("auc_a"), F.col(f"_a{j}").alias("auc_b"), F.sqrt(part(1, i, j) + part(0, i, j)).alias("se"))
        for i in at for j in at if i < j
    ]
    out = sums.select(*by, "n", F.explode(F.array(*pairs)).alias("_x")).select(*by, "n", "_x.*").withColumn("delta", F.col("auc_a") - F.col("auc_b"))
    out = out.withColumn("z", F.try_divide("delta", "se"))
    return out.select(*by, "model_a", "model_b", "n", "auc_a", "auc_b", "delta", "z", normal_p("z").alias("p_value"))


def bootstrap_delta(
    df: DataFrame, key: str, risk_a: str, risk_b: str, truth: str = "truth", replicates: int = 2000, seed=1, by: list[str] | None = None, cohort: list[str] | None = None,
    large: bool | None = None,
) -> DataFrame:
    """``(by, n_valid, delta_lo, delta_hi)``: percentile interval of the AUC difference; one-class draws do not count.

    Ids are drawn once for each group of ``cohort`` (those columns of ``by``
    that tell whose ids they are; all of them if not given), so comparisons of
    one cohort see the same draws. Everything stays on the executors: cohorts
    of few rows are arrays there, larger ones (``large``, if the caller knows)
    blocks of rows that meet their part of the draws.
    """
    by = list(by or [])
    cohort = by if cohort is None else list(cohort)
    rows = df.select(*by, key, F.col(risk_a).cast("double").alias("_ra"), F.col(risk_b).cast("double").alias("_rb"), F.col(truth).cast("int").alias("_y")).where("_ra IS NOT NULL AND _rb IS NOT NULL AND _y IS NOT NULL")
    members = rows.select(*cohort, key).distinct()
    large = not few(rows) if large is None else large
    own = join_on(rows, draw_numbers(members, key, seed, cohort), [*cohort, key], large=large).drop(key)
    make = _deltas_in_blocks if large else _deltas_in_arrays
    d = make(rows, own, members, by, cohort, replicates, seed)
    return d.groupBy(*by).agg(F.count("d").alias("n_valid"), F.percentile("d", F.lit(0.025)).alias("delta_lo"), F.percentile("d", F.lit(0.975)).alias("delta_hi"))


#: Parts of a cohort's replicates that are spread.
SHARDS = 32


def _deltas_in_arrays(rows: DataFrame, own: DataFrame, members: DataFrame, by: list[str], cohort: list[str], replicates: int, seed) -> DataFrame:
    """``(by, d)`` of cohorts of at most ``FEW_ROWS`` rows in all: a cohort's comparisons are gathered into arrays, which each part of its replicates gets."""
    arrays = own.groupBy(*by).agg(*[F.collect_list(c).alias(c) for c in ("_i", "_ra", "_rb", "_y")])
    gathered = arrays.groupBy(*cohort).agg(F.collect_list(F.struct(*[c for c in by if c not in cohort], "_i", "_ra", "_rb", "_y")).alias("_c"))
    shards = min(SHARDS, replicates)
    units = gathered.withColumn("_shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))).repartition(shards, "_shard")

    def auc_of(code, p, q):
        p, q = np.bincount(code, p), np.bincount(code, q)
        return (p * (np.cumsum(q) - q / 2)).sum() / (p.sum() * q.sum()) if p.sum() * q.sum() else None

    def run(batches):
        for pdf in batches:
            for at in range(len(pdf)):
                shared, kept = {c: pdf[c].iloc[at] for c in cohort}, []
                for c in pdf["_c"].iloc[at]:
                    codes = [np.unique(np.asarray(c[k], float), return_inverse=True)[1] for k in ("_ra", "_rb")]
                    kept.append((shared | {n: c[n] for n in by if n not in cohort}, np.asarray(c["_i"], np.int64), np.asarray(c["_y"], float), *codes))
                n = 1 + max(int(i.max()) for _, i, *_ in kept)
                out = []
                for replicate in range(int(pdf["_shard"].iloc[at]), replicates, shards):
                    times = np.bincount(slot_digests(seed, replicate * n, n) % n, minlength=n)
                    for named, i, y, a, b in kept:
                        p, q = y * times[i], (1 - y) * times[i]
                        found = auc_of(a, p, q), auc_of(b, p, q)
                        out.append(named | {"d": None if None in found else found[0] - found[1]})
                yield pd.DataFrame(out, columns=[*by, "d"])

    schema = T.StructType([*[rows.schema[c] for c in by], T.StructField("d", T.DoubleType())])
    return units.mapInPandas(run, schema)


#: Bits of a row's number within its block, slots that are drawn at a time, replicates that meet a block's rows at once and that are counted together, different risks of a range.
BITS, DRAWN, TOGETHER, COUNTED, RISKS = 16, 1 << 22, 256, 16, 1 << 16


def _narrow(counts: np.ndarray) -> bytes:
    """Counts in the fewest bytes that hold them; how many tells the length."""
    return counts.astype(np.min_scalar_type(int(counts.max(initial=0)))).tobytes()


def _picks(sizes: DataFrame, cohort: list[str], replicates: int, seed) -> DataFrame:
    """``(cohort, replicate, _block, _at)``: the rows that a stretch of slots draws from each block of row numbers, two bytes a draw."""

    def run(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                size, s, end = (batch.column(c)[k].as_py() for c in ("_size", "_s", "_end"))
                at = np.empty(end - s, np.uint32 if size < 1 << 32 else np.int64)
                for first in range(0, end - s, 1 << 18):
                    n = min(1 << 18, end - s - first)
                    at[first : first + n] = slot_digests(seed, s + first, n, size >= 1 << 31) % size
                at.sort()
                block, low = at >> BITS, (at & ((1 << BITS) - 1)).astype("<u2")
                cuts = np.flatnonzero(np.concatenate([[True], block[1:] != block[:-1], [True]]))
                raws = [low[a:b].tobytes() for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist())]
                named = [batch.column(c).take(pa.array([k] * len(raws), pa.int32())) for c in (*cohort, "replicate")]
                yield pa.RecordBatch.from_arrays([*named, pa.array(block[cuts[:-1]].astype(np.int64)), pa.array(raws, pa.binary())], names=[*cohort, "replicate", "_block", "_at"])

    schema = T.StructType([*[sizes.schema[c] for c in cohort], T.StructField("replicate", T.IntegerType()), T.StructField("_block", T.LongType()), T.StructField("_at", T.BinaryType())])
    return stretches(sizes, cohort, replicates, DRAWN).mapInArrow(run, schema)


def _borders(rows: DataFrame) -> np.ndarray:
    """Risks that part all different ones into ranges of some ``RISKS``; none if these are few."""
    risks = rows.select(F.explode(F.array("_ra", "_rb")).alias("r")).distinct()
    n = -(-risks.count() // RISKS)
    if n <= 1:
        return np.empty(0)
    return np.unique(np.array(risks.where("NOT isnan(r)").approxQuantile("r", [k / n for k in range(1, n)], 0.25 / n), float))


def _deltas_in_blocks(rows: DataFrame, own: DataFrame, members: DataFrame, by: list[str], cohort: list[str], replicates: int, seed) -> DataFrame:
    """``(by, d)`` of cohorts of any size: blocks of rows meet their draws and count them by different risk.

    Counts of a range of risks are added over the blocks, and ranges by
    running sums, so no task has more than a block of rows with some
    replicates' draws, or a range of risks.
    """
    borders, block_rows, more = _borders(rows), 1 << BITS, [c for c in by if c not in cohort]
    picks = _picks(members.groupBy(*cohort).agg(F.count("*").alias("_size")), cohort, replicates, seed)
    turns = (replicates - 1) // TOGETHER
    blocks = own.withColumn("_block", F.shiftright("_i", BITS)).withColumn("_turn", F.explode(F.sequence(F.lit(0), F.lit(turns))))
    met = blocks.withColumn("_i", F.col("_i").bitwiseAND(block_rows - 1).cast("int")).unionByName(
        picks.withColumn("_turn", F.expr(f"CAST((replicate - 1) DIV {TOGETHER} AS INT)")), allowMissingColumns=True
    )
    named = [rows.schema[c] for c in by] + [T.StructField(n, k) for n, k in (("s", T.IntegerType()), ("_range", T.IntegerType()), ("_chunk", T.IntegerType()))]
    binary, arrow = [T.StructField(c, T.BinaryType()) for c in ("_risks", "_counts")], {"s": pa.int32(), "_range": pa.int32(), "_chunk": pa.int32()}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(batches)
        turn, drawn = t.column("_turn")[0].as_py(), {}
        t, draws = t.filter(t.column("_at").is_null()), t.filter(t.column("_at").is_valid())
        for replicate, raw in zip(draws.column("replicate").to_pylist(), draws.column("_at").to_pylist()):
            drawn.setdefault(replicate - 1, []).append(np.frombuffer(raw, "<u2"))
        of = t.select(more).to_pandas().groupby(more, dropna=False, sort=False).ngroup().to_numpy() if more else np.zeros(t.num_rows, np.int64)
        at, y, *sides = (t.column(c).to_numpy() for c in ("_i", "_y", "_ra", "_rb"))
        of_rows = [np.flatnonzero(of == g) for g in range(int(of.max(initial=-1)) + 1)]
        coded = []
        for mine in of_rows:
            for s, risk in enumerate(sides):
                different, place = np.unique(risk[mine], return_inverse=True)
                spot = np.searchsorted(borders, different, side="right")
                cuts = np.flatnonzero(np.concatenate([[True], spot[1:] != spot[:-1], [True]])).tolist()
                coded.append((int(mine[0]), s, at[mine], place + len(different) * (y[mine] != 1), different, spot, cuts))
        for chunk in range(turn * TOGETHER // COUNTED, -(-min(replicates, (turn + 1) * TOGETHER) // COUNTED)):
            of_chunk = range(chunk * COUNTED, min(replicates, (chunk + 1) * COUNTED))
            times = [sum((np.bincount(d, minlength=block_rows) for d in drawn.get(r, [])), np.zeros(block_rows, np.int64)) for r in of_chunk]
            for first, s, where, place, different, spot, cuts in coded:
                counts = np.stack([np.bincount(place, x[where], 2 * len(different)).astype(np.int64).reshape(2, -1) for x in times])
                n = len(cuts) - 1
                cells = [
                    pa.array([s] * n, pa.int32()), pa.array(spot[cuts[:-1]], pa.int32()), pa.array([chunk] * n, pa.int32()),
                    pa.array([different[a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:])], pa.binary()), pa.array([_narrow(counts[:, :, a:b]) for a, b in zip(cuts[:-1], cuts[1:])], pa.binary()),
                ]
                groups = t.select(by).take(pa.array([first] * n, pa.int64())).combine_chunks().columns
                yield pa.RecordBatch.from_arrays([*(c.chunk(0) for c in groups), *cells], names=[*by, *arrow, "_risks", "_counts"])

    def added(parts: list) -> tuple[np.ndarray, np.ndarray]:
        """Parts ``(risks, counts by replicate and class)`` as one."""
        risks, place = np.unique(np.concatenate([r for r, _ in parts]), return_inverse=True)
        counts = np.concatenate([c for _, c in parts], axis=2)
        return risks, np.stack([[np.bincount(place, v, len(risks)) for v in replicate] for replicate in counts])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, waiting, one = [], 0, None
        for batch in batches:
            one = one or batch.select([*by, *arrow]).slice(0, 1)
            for r, raw, chunk in zip(batch.column("_risks"), batch.column("_counts"), batch.column("_chunk").to_pylist()):
                r, raw, n = np.frombuffer(r.as_buffer()), raw.as_buffer(), min(replicates - chunk * COUNTED, COUNTED)
                parts.append((r, np.frombuffer(raw, f"<u{raw.size // (2 * n * len(r))}").reshape(n, 2, len(r))))
                waiting += len(r)
            if waiting > 8 * RISKS:
                parts = [added(parts)]
                waiting = len(parts[0][0])
        _, counts = added(parts)
        p, q = counts[:, 0], counts[:, 1]
        n, chunk = len(p), one.column("_chunk")[0].as_py()
        sums = (p.sum(axis=1), q.sum(axis=1), (p * (np.cumsum(q, axis=1) - q / 2)).sum(axis=1))
        groups = one.drop_columns(["_chunk"]).take(pa.array([0] * n, pa.int32()))
        yield pa.RecordBatch.from_arrays([*groups.columns, pa.array(range(chunk * COUNTED, chunk * COUNTED + n), pa.int32()), *(pa.array(v) for v in sums)], names=[*groups.schema.names, "replicate", "_p", "_q", "_u"])

    parts = met.groupBy(*cohort, "_block", "_turn").applyInArrow(count, T.StructType(named + binary))
    sums = parts.groupBy(*by, *arrow).applyInArrow(add, T.StructType(named[:-1] + [T.StructField("replicate", T.IntegerType())] + [T.StructField(c, T.DoubleType()) for c in ("_p", "_q", "_u")]))
    group = [*by, "replicate", "s"]
    before = Window.partitionBy(*group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    sides = sums.withColumn("_u", F.col("_u") + F.col("_p") * F.coalesce(F.sum("_q").over(before), F.lit(0.0)))
    sides = sides.groupBy(*group).agg(F.try_divide(F.sum("_u"), F.sum("_p") * F.sum("_q")).alias("auc"))
    one = lambda k: F.max(F.when(F.col("s") == k, F.col("auc")))
    return sides.groupBy(*by, "replicate").agg((one(0) - one(1)).alias("d"))


def contrasts(predictions: DataFrame, pairs: DataFrame, key: str, same: list[str], truth: str = "truth") -> DataFrame:
    """``(columns of pairs, same, key, truth, risk_a, risk_b)``: both risks of each pair, on the ids that have both.

    ``predictions`` name a risk by some columns; ``pairs`` have each of these
    twice, with suffixes _a and _b. ``same`` are columns that both sides share.
    Only ``pairs`` may travel through the driver: a plan takes predictions that
    a column explodes into for as few as the column's rows.
    """
    named = [c for c in predictions.columns if f"{c}_a" in pairs.columns]
    a = predictions.select(*same, key, truth, F.col("risk").alias("risk_a"), *[F.col(c).alias(f"{c}_a") for c in named])
    b = predictions.select(*same, key, F.col("risk").alias("risk_b"), *[F.col(c).alias(f"{c}_b") for c in named])
    return a.join(F.broadcast(pairs), [f"{c}_a" for c in named]).join(b.hint("merge"), [*same, key, *[f"{c}_b" for c in named]])


def compared(rows: DataFrame, key: str, by: list[str], family: list[str], cohort: list[str], truth: str = "truth", replicates: int = 2000, seed=1) -> DataFrame:
    """``(by, n, events, auc_a, auc_b, delta, delta_lo, delta_hi, z, p_value, p_adj)`` of rows with two risks, as ``contrasts`` makes them.

    P is DeLong's, the interval the bootstrap's; they may disagree on the
    margin. P values are adjusted within a family. Many rows, by count, are
    written down once, as every step reads them again; so are the comparisons,
    which would otherwise be made anew each time their adjustment counts them.
    """
    large = rows.limit(ordered.FEW_ROWS + 1).count() > ordered.FEW_ROWS
    if large:
        rows.write.parquet(path := own_folder(rows.sparkSession))
        rows = rows.sparkSession.read.schema(rows.schema).parquet(path)
    sizes = rows.groupBy(*by).agg(F.count("*").alias("n"), F.sum(F.col(truth).cast("bigint")).alias("events"))
    tested = delong_paired(rows, key, by, "risk_a", "risk_b", truth, large)
    drawn = bootstrap_delta(rows, key, "risk_a", "risk_b", truth, replicates, seed, by, cohort, large).drop("n_valid")
    out = sizes.join(tested, by).join(drawn, by)
    out.write.parquet(path := own_folder(rows.sparkSession))
    return bh_adjust(rows.sparkSession.read.schema(out.schema).parquet(path), "p_value", family)


def compare(df: DataFrame, key: str, by: list[str], families: dict[str, list[str]], truth: str = "truth", replicates: int = 2000, seed=1) -> DataFrame:
    """``(by, model, reference, n_test, n_deaths, auc, auc_ref, delta, delta_lo, delta_hi, z, p_value, p_adj)``, a column of ``df`` a model.

    ``families`` names the models that are held against each reference; P
    values are adjusted by reference, over all of ``by``.
    """
    spark = df.sparkSession
    pairs = spark.createDataFrame([(m, r) for r, ms in families.items() for m in ms], "model_a string, model_b string")
    models = sorted({m for r, ms in families.items() for m in (r, *ms)})
    risks = F.explode(F.array(*[F.struct(F.lit(m).alias("model"), F.col(m).alias("risk")) for m in models]))
    long = df.select(*by, key, truth, risks.alias("x")).select(*by, key, truth, "x.model", "x.risk")
    rows = contrasts(long, pairs, key, by, truth).withColumnsRenamed({"model_a": "model", "model_b": "reference"})
    out = compared(rows, key, [*by, "model", "reference"], ["reference"], by, truth, replicates, seed)
    return out.withColumnsRenamed({"n": "n_test", "events": "n_deaths", "auc_a": "auc", "auc_b": "auc_ref"})


def between_layers(predictions: DataFrame, key: str, layers: list[str], truth: str = "truth", replicates: int = 2000, seed=1) -> DataFrame:
    """``(model, comparison, auc_a, ...)``: every two layers of a model on one matched cohort, adjusted by model.

    ``layers`` says their order in pairs; models without a risk in a layer
    have no pair with it.
    """
    pairs = predictions.sparkSession.createDataFrame([(a, b) for k, a in enumerate(layers) for b in layers[k + 1 :]], "layer_a string, layer_b string")
    rows = contrasts(predictions, pairs, key, ["model"], truth)
    rows = rows.withColumn("comparison", F.concat_ws(" vs ", title_case(F.col("layer_a")), title_case(F.col("layer_b")))).drop("layer_a", "layer_b")
    return compared(rows, key, ["model", "comparison"], ["model"], [], truth, replicates, seed)


def versus_clinical(predictions: DataFrame, key: str, clinical: str, layer: str = "clinical", truth: str = "truth", replicates: int = 2000, seed=1) -> DataFrame:
    """``(model, comparison, auc_a, ...)``: every model of every layer against the one clinical model, one family."""
    own = predictions.where((F.col("model") == clinical) & (F.col("layer") == layer)).select(key, F.col("risk").alias("risk_b"))
    rows = predictions.where(F.col("layer") != layer).withColumnRenamed("risk", "risk_a").join(own.hint("merge"), key)
    rows = rows.withColumn("comparison", F.concat_ws(" vs ", title_case(F.col("layer")), title_case(F.lit(layer)))).drop("layer")
    return compared(rows, key, ["model", "comparison"], [], [], truth, replicates, seed)


def matched_comparisons(predictions: DataFrame, key: str, layers: list[str], clinical: str, **options) -> DataFrame:
    """Both kinds of comparison as one table, by the name of their family."""
    return between_layers(predictions, key, layers, **options).withColumn("family", F.lit("Between omics layers")).unionByName(
        versus_clinical(predictions, key, clinical, **options).withColumn("family", F.lit("Versus the clinical model"))
    )


def _newton(df: DataFrame, by: list[str], x: str, y: str, slope: bool, steps: int = 25) -> list:
    """Rows of ``by`` with ``b0`` and ``b1`` of a logistic regression on one predictor, or with its slope held at one.

    Rows are counted once per distinct predictor; Newton steps then run over
    these bins, with a row of coefficients for each group on the driver.
    """
    bins = df.groupBy(*by, F.col(x).cast("double").alias("_x")).agg(F.count("*").cast("double").alias("_n"), F.sum(F.col(y).cast("double")).alias("_s")).persist()
    try:
        groups = [tuple(r) for r in bins.select(*by).distinct().collect()] if by else [()]
        at = {g: (0.0, 0.0 if slope else 1.0) for g in groups}
        schema = T.StructType([*[df.schema[c] for c in by], T.StructField("b0", T.DoubleType()), T.StructField("b1", T.DoubleType())])
        p = 1 / (1 + F.exp(-(F.col("b0") + F.col("b1") * F.col("_x"))))
        w, d = F.col("_n") * p * (1 - p), F.col("_s") - F.col("_n") * p
        for _ in range(steps):
            coef = df.sparkSession.createDataFrame([(*g, *b) for g, b in at.items()], schema)
            j = join_on(bins, coef, by) if by else bins.join(coef)  # a row for each group
            sums = j.groupBy(*by).agg(F.sum(d).alias("g0"), F.sum(d * F.col("_x")).alias("g1"), F.sum(w).alias("h00"), F.sum(w * F.col("_x")).alias("h01"), F.sum(w * F.col("_x") * F.col("_x")).alias("h11")).collect()
            moved = 0.0
            for r in sums:
                g = tuple(r[c] for c in by)
                det = r["h00"] * r["h11"] - r["h01"] ** 2 if slope else r["h00"]
                if not det:
                    at[g] = (None, None)
                if at[g][0] is None:
                    continue
                s0, s1 = ((r["h11"] * r["g0"] - r["h01"] * r["g1"]) / det, (r["h00"] * r["g1"] - r["h01"] * r["g0"]) / det) if slope else (r["g0"] / det, 0.0)
                at[g] = (at[g][0] + s0, at[g][1] + s1)
                moved = max(moved, abs(s0), abs(s1))
            if moved < 1e-10:
                break
        return [(*g, *b) for g, b in at.items()]
    finally:
        bins.unpersist()


def logistic_line(df: DataFrame, by: list[str], x: str, y: str) -> DataFrame:
    """``(by, intercept, slope)`` of a logistic regression on one predictor; null where it has no variation."""
    schema = T.StructType([*[df.schema[c] for c in by], T.StructField("intercept", T.DoubleType()), T.StructField("slope", T.DoubleType())])
    return df.sparkSession.createDataFrame(_newton(df, by, x, y, slope=True), schema)


def offset_intercept(df: DataFrame, by: list[str], lp: str, y: str) -> DataFrame:
    """``(by, calibration_in_the_large)``: the intercept with the linear predictor's coefficient held at one."""
    schema = T.StructType([*[df.schema[c] for c in by], T.StructField("calibration_in_the_large", T.DoubleType())])
    return df.sparkSession.createDataFrame([r[:-1] for r in _newton(df, by, lp, y, slope=False)], schema)


def brier(df: DataFrame, by: list[str], risk: str = "risk", truth: str = "truth") -> DataFrame:
    """``(by, n, events, mean_predicted, observed, brier, brier_null)``."""
    y = F.col(truth).cast("double")
    return df.groupBy(*by).agg(
        F.count("*").alias("n"), F.sum(F.col(truth).cast("bigint")).alias("events"), F.avg(risk).alias("mean_predicted"), F.avg(y).alias("observed"),
        F.avg((F.col(risk) - y) * (F.col(risk) - y)).alias("brier"), (F.avg(y) * (1 - F.avg(y))).alias("brier_null"),
    )


def calibration(df: DataFrame, by: list[str], risk: str = "risk", truth: str = "truth") -> DataFrame:
    """Brier scores, slope and joint intercept of truth on logit risk, and calibration in the large."""
    lp = df.withColumn("_lp", logit(F.col(risk), EPS)).withColumn("_y", F.col(truth).cast("double"))
    line = logistic_line(lp, by, "_lp", "_y").withColumnRenamed("intercept", "calibration_intercept_joint").withColumnRenamed("slope", "calibration_slope")
    return brier(df, by, risk, truth).join(line, by).join(offset_intercept(lp, by, "_lp", "_y"), by)


def age_proxy(df: DataFrame, by: list[str], key: str, risks: list[str], age_risk: str, age: str, reference: str | None = None, truth: str = "truth") -> DataFrame:
    """How far risks stand for age: Spearman's rho with it, and the AUC difference from age alone.

    ``(by, model, rho_age, auc_omics, auc_age_only, delta, z, p_value, p_adj)``
    with one adjustment over all rows. ``reference`` is a model that holds age
    by design: its row has rho alone.
    """
    models = [*risks, *([reference] if reference else [])]
    cells = F.explode(F.array(*[F.struct(F.lit(m).alias("model"), F.col(m).alias("risk")) for m in models]))
    long = df.select(*by, key, truth, F.col(age_risk).alias("_age_risk"), F.col(age).alias("_age"), cells.alias("x")).select("*", "x.model", "x.risk")
    rho = spearman(long, "risk", "_age", [*by, "model"], "rho_age")
    tested = delong_paired(long.where(F.col("model").isin(risks)), key, [*by, "model"], "risk", "_age_risk", truth)
    tested = tested.withColumnsRenamed({"auc_a": "auc_omics", "auc_b": "auc_age_only"})
    return bh_adjust(rho.join(tested, [*by, "model"], "left"), "p_value", [])


def out_of_sample(oof: DataFrame, train: DataFrame, test: DataFrame, key: str, score: str, stored: str, truth: str = "truth") -> DataFrame:
    """``(key, truth, risk, source)``: everybody once, by out-of-fold risk if they were trained on, else by held-out risk.

    ``oof`` names its rows by ``train_row`` of ``train`` and has ``score``
    alone; ``test`` has it beside ``stored``, the event's risk, which tells
    whether ``score`` is that risk or its complement.
    """
    flipped = risk_of_event(test, score, stored)
    inside = oof.join(train.select("train_row", key, truth), "train_row")
    return inside.select(key, truth, flipped.alias("risk"), F.lit("out_of_fold").alias("source")).unionByName(
        test.select(key, truth, F.col(stored).alias("risk"), F.lit("held_out_test").alias("source"))
    )


def wide_auc(table: DataFrame, layers: list[str]) -> DataFrame:
    return table.groupBy("model").pivot("layer", layers).agg(F.first("auc"))


def repeat_summary(predictions: DataFrame, by: list[str]) -> DataFrame:
    """Mean, sd, least and largest AUC over repeats."""
    per = auc(predictions, [*by, "repeat_id"])
    return per.groupBy(*by).agg(F.count("*").alias("repeats"), F.avg("auc").alias("auc_mean"), F.stddev_samp("auc").alias("auc_sd"), F.min("auc").alias("auc_min"), F.max("auc").alias("auc_max"))


def risk_of_event(df: DataFrame, stored: str, reference: str, tolerance: float = 1e-12) -> Column:
    """A stored probability as risk of the event: itself or its complement, whichever agrees with a reference column."""
    same = df.agg(F.max(F.abs(F.col(stored) - F.col(reference))).alias("d"), F.max(F.abs(1 - F.col(stored) - F.col(reference))).alias("c")).first()
    if same["d"] is not None and same["d"] <= tolerance:
        return F.col(stored)
    if same["c"] is not None and same["c"] <= tolerance:
        return 1 - F.col(stored)
    raise ValueError("the stored probability agrees with neither orientation")


