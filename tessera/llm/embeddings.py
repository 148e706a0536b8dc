"""Near-duplicate vectors by PCA-ordered tiled comparison.

Vectors are turned into the frame of their principal components, so that the
leading dimensions carry most of a product. Tiles of vectors, ordered along the
first component, are compared pair by pair: leading dimensions are accumulated
first, what the rest can add is bounded by the suffixes' norms, and a pair is
given up as soon as the threshold is out of reach. Survivors are verified in
double precision over the vectors as given.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import Scratch, slices, unit
from tessera.llm.graph import components

THRESHOLD = 0.95
#: Vectors of a tile, leading dimensions after which pairs are given up, rounding slack of the bounds.
TILE, STEPS, SLACK = 2048, (8, 16, 32), 1e-9
#: Neighbouring tiles that travel together at most, and bundles that there should be before tiles are bundled.
BUNDLE, BUNDLES = 8, 12
#: Numbers of a bundle at most, beyond one tile.
BUNDLE_NUMBERS = 1 << 21
#: Share of surviving pairs above which a tile is finished as one product.
DENSE = 0.02
#: From here on ids stand for vectors without one; they are never the smallest of a group with an id.
NAMELESS = 1 << 62


def usable(col: str = "embedding") -> Column:
    """Whether a vector can link: not null or empty, finite throughout, not zero."""
    v = F.col(col)
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(v.isNotNull() & (F.size(v) > 0) & ~bad & F.exists(v, lambda x: x != 0), F.lit(False))


def _matrix(column) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)  # no overflow for large components
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def principal_axes(vectors: DataFrame, size: int) -> np.ndarray:
    """The principal axes of unit vectors of one size, by all of them: partitions add up second moments."""

    def run(batches):
        total = np.zeros((size, size))
        for batch in batches:
            for part in slices(batch, 4096):
                u = _unit(_matrix(part.column(0)))
                total += u.T @ u
        yield pa.RecordBatch.from_arrays([pa.array([total.ravel().tolist()])], names=["m"])

    parts = vectors.select("embedding").mapInArrow(run, "m array<double>")
    sums = parts.select(F.posexplode("m").alias("k", "v")).groupBy("k").agg(F.sum("v").alias("v")).collect()  # size^2 numbers
    moment = np.zeros(size * size)
    for r in sums:
        moment[r["k"]] = r["v"]
    values, axes = np.linalg.eigh(moment.reshape(size, size))
    return axes[:, np.argsort(-values)]


def close_pairs(a: np.ndarray, b: np.ndarray, axes: np.ndarray, threshold: float, steps=STEPS) -> np.ndarray:
    """Which rows of ``a`` and ``b`` have a cosine of at least ``threshold``, as a boolean matrix."""
    ua, ub = _unit(a), _unit(b)
    pa_, pb = ua @ axes, ub @ axes
    size = a.shape[1]
    done = 0
    dot = rows = cols = None
    for upto in [*(s for s in steps if s < size), size]:
        ra = np.sqrt(np.maximum(0, 1 - (pa_[:, :upto] ** 2).sum(axis=1)))
        rb = np.sqrt(np.maximum(0, 1 - (pb[:, :upto] ** 2).sum(axis=1)))
        if rows is None:
            dot = pa_[:, :upto] @ pb[:, :upto].T
            mask = dot + ra[:, None] * rb[None, :] >= threshold - SLACK
            rows, cols = np.nonzero(mask)
            if len(rows) > DENSE * mask.size:
                # most of a dense tile has to be verified anyway: one product over the vectors as given
                near = ua @ ub.T
                rows, cols = np.nonzero(mask & (np.abs(near - threshold) < 1e-6))
                mask &= near >= threshold
                mask[rows, cols] = _exact(a, b, rows, cols) >= threshold
                return mask
            dot = dot[rows, cols]
        else:
            dot = dot + np.einsum("ij,ij->i", pa_[rows, done:upto], pb[cols, done:upto])
            keep = dot + ra[rows] * rb[cols] >= threshold - SLACK
            rows, cols, dot = rows[keep], cols[keep], dot[keep]
        done = upto
    out = np.zeros((len(a), len(b)), bool)
    good = _exact(a, b, rows, cols) >= threshold
    out[rows[good], cols[good]] = True
    return out


def _exact(a, b, rows, cols) -> np.ndarray:
    out = np.empty(len(rows))
    na, nb = np.sqrt((a * a).sum(axis=1)), np.sqrt((b * b).sum(axis=1))
    for at in range(0, len(rows), 1 << 16):
        r, c = rows[at : at + (1 << 16)], cols[at : at + (1 << 16)]
        with np.errstate(over="ignore", invalid="ignore"):
            v = np.einsum("ij,ij->i", a[r], b[c]) / (na[r] * nb[c])
        bad = ~np.isfinite(v)
        if bad.any():  # squares over- or underflow: scaled vectors
            v[bad] = np.einsum("ij,ij->i", _unit(a[r[bad]]), _unit(b[c[bad]]))
        out[at : at + (1 << 16)] = v
    return out


def compare(a, b, ids_a, ids_b, count_a, count_b, axes, threshold, same: bool):
    """``(id, links, low)`` of the vectors of a pair of tiles that have links in it.

    ``links`` counts linked vectors with their copies, ``low`` is the smallest id
    reachable within the pair: a forest instead of all links.
    """
    near = close_pairs(a, b, axes, threshold)
    if same:
        np.fill_diagonal(near, False)
    la, lb, top = ids_a.copy(), ids_b.copy(), np.iinfo(np.int64).max
    ka = near @ count_b
    kb = np.zeros(len(ids_b), np.int64) if same else near.T @ count_a
    ra, rb = np.flatnonzero(near.any(axis=1)), np.flatnonzero(near.any(axis=0))
    part = near[np.ix_(ra, rb)]
    while len(ra):
        na = np.minimum(la[ra], np.where(part, lb[rb][None, :], top).min(axis=1))
        if same:
            lb[ra] = na
        nb = np.minimum(lb[rb], np.where(part, na[:, None], top).min(axis=0))
        still = (na == la[ra]).all() and (nb == lb[rb]).all()
        la[ra], lb[rb] = na, nb
        if same:
            la = lb = np.minimum(la, lb)
        if still:
            break
    ids, links, low = (ids_a, ka, la) if same else (np.concatenate([ids_a, ids_b]), np.concatenate([ka, kb]), np.concatenate([la, lb]))
    keep = links > 0
    return ids[keep], links[keep].astype(np.int64), low[keep]


def _cuts_up_to(value: str, tiles: int) -> str:
    """SQL for how many of the sorted ``cuts`` are not above a value, by binary search."""
    middle = "CAST((s.a + s.b) div 2 AS INT)"
    step = f"IF(s.a >= s.b, s, IF(cuts[{middle}] <= {value}, named_struct('a', {middle} + 1, 'b', s.b), named_struct('a', s.a, 'b', {middle})))"
    return f"aggregate(sequence(1, {max(1, tiles.bit_length())}), named_struct('a', 0, 'b', size(cuts)), (s, i) -> {step}, s -> s.a)"


def _links_of_size(classes: DataFrame, size: int, threshold: float, scratch: Scratch) -> DataFrame:
    axes = principal_axes(classes, size)
    first = [float(v) for v in axes[:, 0]]
    n = classes.count()
    tiles = max(1, -(-n // TILE))
    norm = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    along = F.aggregate(F.zip_with("embedding", F.array(*map(F.lit, first)), lambda x, w: x.cast("double") * w), F.lit(0.0), lambda s, x: s + x)
    # a hash far below the bounds' slack orders vectors that are alike along the first axis
    placed = classes.withColumn("at", along / norm + unit(F.lit(5), "id") * 1e-10)
    placed = scratch.keep(placed.withColumn("at", F.coalesce(F.nanvl("at", F.lit(0.0)), F.lit(0.0))))
    if tiles > 1:
        cuts = placed.agg(F.percentile_approx("at", [k / tiles for k in range(1, tiles)], 100_000).alias("cuts"))
    else:
        cuts = classes.sparkSession.range(1).select(F.expr("cast(array() as array<double>)").alias("cuts"))
    cuts = scratch.keep(cuts)  # one row
    reach = float(np.sqrt(max(0.0, 2 - 2 * threshold))) + 1e-6  # unit vectors that link are no further apart
    packed = scratch.keep(
        placed.join(cuts).withColumn("tile", F.expr(_cuts_up_to("at", tiles)))
        .groupBy("tile")
        .agg(F.collect_list("id").alias("ids"), F.collect_list("copies").alias("copies"), F.flatten(F.collect_list("embedding")).alias("v"), F.max("at").alias("hi"))
        .join(cuts).withColumn("last", F.expr(_cuts_up_to(f"hi + {reach!r}D", tiles))).drop("cuts")
    )
    # tiles travel in bundles of neighbours: a bundle meets itself and those after it that are in reach along the first axis
    bundle = min(BUNDLE, max(1, tiles // BUNDLES), max(1, BUNDLE_NUMBERS // (TILE * size)))
    packed = packed.withColumn("i", F.floor(F.col("tile") / bundle).cast("int"))
    upto = packed.groupBy("i").agg(F.floor(F.max("last") / bundle).cast("int").alias("upto"))  # a row for each bundle
    pairs = scratch.keep(upto.select("i", F.explode(F.sequence("i", "upto")).alias("j")))
    held = ["tile", "last", "ids", "copies", "v"]
    left = packed.join(pairs, "i").select("i", "j", F.lit(0).alias("side"), *held)
    right = packed.withColumnRenamed("i", "j").join(pairs.where("j > i"), "j").select("i", "j", F.lit(1).alias("side"), *held)
    both = left.unionByName(right)

    def run(key, rows):
        sides = ([], [])
        for k in range(rows.num_rows):
            one = rows.slice(k, 1).combine_chunks()
            ids, copies, v = (one.column(c).chunk(0).flatten().to_numpy(zero_copy_only=False) for c in ("ids", "copies", "v"))
            tile, last, side = (one.column(c)[0].as_py() for c in ("tile", "last", "side"))
            sides[side].append((tile, last, ids.copy(), copies, v.astype(np.float64).reshape(-1, size)))
        same = key[0].as_py() == key[1].as_py()
        found = [(np.empty(0, np.int64),) * 3]
        for ta, last, ia, ca, a in sides[0]:
            for tb, _, ib, cb, b in sides[0] if same else sides[1]:
                if ta <= tb <= last:  # a tile itself and those after it that are in its reach
                    found.append(compare(a, b, ia, ib, ca, cb, axes, threshold, ta == tb))
        ids, links, low = (np.concatenate(c) for c in zip(*found))
        return pa.table({"id": pa.array(ids, pa.int64()), "links": pa.array(links, pa.int64()), "low": pa.array(low, pa.int64())})

    return both.groupBy("i", "j").applyInArrow(run, "id bigint, links bigint, low bigint")


def embedding_groups(vectors: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``(vec_id, n_links, component_id, kept)`` of every row of ``vectors(vec_id, embedding)``.

    Equal vectors are compared once and counted as often as they occur. Null,
    empty and zero vectors, and those with a null or non-finite component, link
    with nothing; vectors of different sizes never link. Rows with one vec_id
    and one vector link like any copies; a null vec_id takes part under no id.
    Other columns, labels among them, are not read; an empty table gives none.
    """
    with Scratch(vectors.sparkSession) as scratch:
        rows = scratch.keep(vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), "embedding").withColumn("usable", usable()))
        classes = scratch.keep(
            rows.where("usable").groupBy("embedding").agg(F.min("vec_id").alias("least"), F.count("*").alias("copies"))
            .withColumn("id", F.coalesce("least", F.lit(NAMELESS) + F.abs(F.xxhash64("embedding") % (1 << 60)))).drop("least")
        )
        found = None
        for r in classes.select(F.size("embedding").alias("n")).distinct().collect():
            part = _links_of_size(classes.where(F.size("embedding") == r["n"]), r["n"], threshold, scratch)
            found = part if found is None else found.union(part)
        if found is None:
            return scratch.result(rows.select("vec_id", F.lit(0).cast("bigint").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept")))
        found = scratch.keep(found)
        groups = components(found.select(F.col("id").alias("a"), F.col("low").alias("b")), scratch)
        links = found.groupBy("id").agg(F.sum("links").alias("links"))
        known = scratch.keep(
            classes.join(links, "id", "left").join(groups.withColumnRenamed("node", "id"), "id", "left")
            .select("embedding", "copies", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("component", "id").alias("component"))
            .withColumn("component", F.when(F.col("component") < NAMELESS, F.col("component")))
        )
        out = rows.where("usable").join(known, "embedding").select("vec_id", (F.col("links") + F.col("copies") - 1).alias("n_links"), F.col("component").alias("component_id"))
        rest = rows.where("not usable").select("vec_id", F.lit(0).cast("bigint").alias("n_links"), F.col("vec_id").alias("component_id"))
        return scratch.result(out.union(rest).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True))))
