"""SimHash near-duplicates by multi-index hashing.

A fingerprint is cut into segments. If two fingerprints differ in few bits, one
segment differs in so few that a small Hamming ball around it holds the other's
segment: the ball's members are looked up in a table of segments, and what is
found is verified over all 64 bits.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import WORD, Scratch, slices, small
from tessera.llm.graph import components

#: Lower-casing of A-Z alone.
LOWER = {c: c + 32 for c in range(65, 91)}
SHINGLE, SEED, MAX_BITS = 4, 42, 4

#: (first bit, bits, radius) of each segment. Radii r with sum(r + 1) > MAX_BITS
#: leave no pair within MAX_BITS unseen. The second plan is for more fingerprints
#: than FEW, where buckets of 20 bits would hold too many; both find the same.
NARROW = ((0, 22, 1), (22, 22, 1), (44, 20, 0))
WIDE = ((0, 32, 2), (32, 32, 1))
FEW = 1 << 26

#: A segment value that more fingerprints share is compared in blocks instead of rows.
HEAVY, BLOCK = 64, 2048


def shingle_hashes(text: str, n: int = SHINGLE, seed: int = SEED) -> np.ndarray:
    """XXH64 of each run of ``n`` words, or of all words if there are fewer."""
    words = re.findall(WORD, text.translate(LOWER))
    if not words:
        return np.empty(0, np.uint64)
    joined = [w.encode() for w in words]
    if len(words) <= n:
        return np.array([xxhash.xxh64_intdigest(b" ".join(joined), seed)], np.uint64)
    ends = np.cumsum([len(w) + 1 for w in joined])
    starts = (ends - np.array([len(w) + 1 for w in joined])).tolist()
    whole, digest = b" ".join(joined), xxhash.xxh64_intdigest
    stops = (ends[n - 1 :] - 1).tolist()
    return np.array([digest(whole[a:b], seed) for a, b in zip(starts, stops)], np.uint64)


def fingerprint(text: str | None, n: int = SHINGLE, seed: int = SEED) -> int:
    """The 64-bit SimHash of a text as an unsigned number; 0 if it has no word."""
    h = shingle_hashes(text or "", n, seed)
    if not len(h):
        return 0
    ones = np.zeros(64, np.int64)
    for at in range(0, len(h), 1 << 16):  # bounded memory for very long texts
        part = h[at : at + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = (2 * ones > len(h)).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``(doc_id, fp)`` of every row, fp a signed 64-bit number; null text: 0."""

    def run(batches):
        for batch in batches:
            for part in slices(batch):
                fps = [fingerprint(t) for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(np.array(fps, np.uint64).astype(np.int64))], names=["doc_id", "fp"]
                )

    rows = docs.select(F.col(key).cast("bigint").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id bigint, fp bigint")


def _segment(first: int, bits: int):
    return F.shiftrightunsigned("fp", first).bitwiseAND(F.lit((1 << bits) - 1))


def _ball(bits: int, radius: int) -> str:
    """SQL for the keys to look up for ``key``, itself aside.

    Of two keys only the one whose lowest differing bit is 0 looks up the other.
    """
    one = f"transform(filter(sequence(0, {bits - 1}), i -> shiftright(key, i) & 1 = 0), i -> key ^ shiftleft(1L, i))"
    if radius == 0:
        return "array()"
    if radius == 1:
        return one
    two = (
        f"flatten(transform(filter(sequence(0, {bits - 2}), i -> shiftright(key, i) & 1 = 0),"
        f" i -> transform(sequence(i + 1, {bits - 1}), j -> key ^ shiftleft(1L, i) ^ shiftleft(1L, j))))"
    )
    return f"concat({one}, {two})"


def _compare_blocks(batches, max_bits: int):
    """Links inside (probe block, table block), as a forest: few rows, same components."""
    for batch in (part for whole in batches for part in slices(whole, 4)):
        for row in batch.to_pylist():
            a, ra = np.array(row["pfp"], np.int64).view(np.uint64), np.array(row["prep"], np.int64)
            b, rb = np.array(row["fps"], np.int64).view(np.uint64), np.array(row["reps"], np.int64)
            near = np.bitwise_count(a[:, None] ^ b[None, :]) <= max_bits
            la, lb, top = ra.copy(), rb.copy(), np.iinfo(np.int64).max
            while True:
                na = np.minimum(la, np.where(near, lb[None, :], top).min(axis=1))
                nb = np.minimum(lb, np.where(near, na[:, None], top).min(axis=0))
                if (na == la).all() and (nb == lb).all():
                    break
                la, lb = na, nb
            x, y = np.concatenate([ra, rb]), np.concatenate([la, lb])
            keep = x != y
            yield pa.RecordBatch.from_arrays([pa.array(x[keep]), pa.array(y[keep])], names=["a", "b"])


def links(classes: DataFrame, scratch: Scratch, max_bits: int = MAX_BITS, plan=None, heavy_at: int = HEAVY) -> DataFrame:
    """Links ``(a, b)`` between the representatives of ``classes(fp, rep)``.

    Every pair within ``max_bits`` is joined by a path of links. Fingerprints
    are distinct. A segment value shared by many is dealt in blocks, of which
    each pair is one row, so a dense group costs neither a long task nor a row
    for each of its pairs.
    """
    plan = plan or (NARROW if classes.count() <= FEW else WIDE)
    assert sum(r + 1 for *_, r in plan) > max_bits
    parts = [
        classes.select(F.lit(k).alias("seg"), _segment(first, bits).alias("key"), "fp", "rep")
        for k, (first, bits, _) in enumerate(plan)
    ]
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.union(p)
    rows = scratch.keep(rows)
    heavy = scratch.keep(rows.groupBy("seg", "key").agg(F.count("*").alias("n")).where(F.col("n") > heavy_at))
    far = [
        rows.where(F.col("seg") == k).withColumn("key", F.explode(F.expr(_ball(bits, r))))
        for k, (_, bits, r) in enumerate(plan)
        if r
    ]
    probes = rows.withColumn("own", F.lit(True))
    for f in far:
        probes = probes.union(f.withColumn("own", F.lit(False)))
    any_heavy = heavy.limit(1).count() > 0
    hint = small(heavy) if any_heavy else None
    light = rows.join(hint.select("seg", "key"), ["seg", "key"], "left_anti") if any_heavy else rows
    close = F.bit_count(F.col("p.fp").bitwiseXOR(F.col("t.fp"))) <= max_bits
    found = (
        probes.alias("p")
        .join(light.alias("t"), (F.col("p.seg") == F.col("t.seg")) & (F.col("p.key") == F.col("t.key")) & close
              & (~F.col("p.own") | (F.col("p.fp") < F.col("t.fp"))))
        .select(F.col("p.rep").alias("a"), F.col("t.rep").alias("b"))
    )
    if not any_heavy:
        return found

    def blocks(df: DataFrame, fp: str, rep: str, block: str) -> DataFrame:
        df = df.join(hint.select("seg", "key"), ["seg", "key"])
        size = scratch.keep(df.groupBy("seg", "key").agg(F.ceil(F.count("*") / BLOCK).alias("blocks")))
        return (
            df.join(small(size), ["seg", "key"])
            .groupBy("seg", "key", F.pmod(F.xxhash64("fp"), F.col("blocks")).alias(block))
            .agg(F.collect_list("fp").alias(fp), F.collect_list("rep").alias(rep))
        )

    pairs = scratch.keep(blocks(probes, "pfp", "prep", "pblock").join(blocks(rows, "fps", "reps", "tblock"), ["seg", "key"]))
    return found.union(
        pairs.select("pfp", "prep", "fps", "reps").mapInArrow(lambda it: _compare_blocks(it, max_bits), "a bigint, b bigint")
    )


def _grouped(docs: DataFrame, scratch: Scratch, max_bits: int, plan) -> DataFrame:
    """``(doc_id, fp, node, component_id)`` of every row: its fingerprint's group, and the group's smallest doc_id."""
    fps = scratch.keep(fingerprints(docs))
    classes = fps.groupBy("fp").agg(F.min("doc_id").alias("least"))
    classes = scratch.keep(classes.withColumn("rep", F.monotonically_increasing_id()))
    found = components(links(classes.select("fp", "rep"), scratch, max_bits, plan), scratch)
    named = scratch.keep(
        classes.join(found.withColumnRenamed("node", "rep"), "rep", "left").select("fp", "least", F.coalesce("component", "rep").alias("node"))
    )
    ids = named.groupBy("node").agg(F.min("least").alias("component_id"))
    return fps.join(scratch.keep(named.join(ids, "node").select("fp", "node", "component_id")), "fp")


def simhash_groups(docs: DataFrame, max_bits: int = MAX_BITS, plan=None) -> DataFrame:
    """``(doc_id, fingerprint, component_id)`` of every row of ``docs(doc_id, text)``.

    Null or wordless texts have fingerprint 0 and link like any other. Rows
    are grouped by their texts alone, also where a doc_id repeats. A null
    doc_id is kept and gets the smallest doc_id of its group, null if the
    group has no other. Other columns of ``docs``, whatever their names, are
    not read; an empty table gives none.
    """
    with Scratch(docs.sparkSession) as scratch:
        rows = _grouped(docs, scratch, max_bits, plan)
        return scratch.result(rows.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"))


def keep_one(docs: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """One row of ``docs`` of each SimHash group: that with the smallest doc_id.

    All columns stay. Where the id repeats in the group, the smallest
    fingerprint and then the smallest hash of all columns decide; null ids
    come last. Rows of one id in different groups each stand for their group.
    """
    names = docs.columns
    with Scratch(docs.sparkSession) as scratch:
        rows = scratch.keep(_grouped(docs, scratch, max_bits, None).select("doc_id", "fp", "node", "component_id"))
        own = rows.where(F.col("doc_id").eqNullSafe(F.col("component_id")))
        picked = scratch.keep(own.groupBy("node").agg(F.min("fp").alias("fp"), F.first("component_id").alias("doc_id")))
        often = rows.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select(F.col("doc_id").alias("__often"))
        same = F.col("doc_id").eqNullSafe(F.col("__often"))
        hard = scratch.result(picked.join(often, same, "left_semi").select("doc_id", "fp"))
        plain = scratch.result(picked.join(often, same, "left_anti").select(F.col("doc_id").alias("__kept_id")))
    # the ids become a new column, so that both sides of the join are exchanged alike
    out = docs.join(plain, F.col("doc_id").cast("bigint").eqNullSafe(F.col("__kept_id")), "left_semi")
    if not hard.limit(1).count():
        return out
    ids = hard.select(F.col("doc_id").alias("__id"), F.col("fp").alias("__fp"))
    at = names.index("text")
    schema = T.StructType([*docs.schema.fields, T.StructField("__own_fp", T.LongType())])

    def fingerprinted(batches):
        for batch in batches:
            for part in slices(batch):
                fps = [fingerprint(None if t is None else str(t)) for t in part.column(at).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(np.array(fps, np.uint64).astype(np.int64))], names=[*names, "__own_fp"])

    some = docs.join(ids.select("__id").distinct(), F.col("doc_id").cast("bigint").eqNullSafe(F.col("__id")), "left_semi").mapInArrow(fingerprinted, schema)
    some = some.join(ids, F.col("doc_id").cast("bigint").eqNullSafe(F.col("__id")) & (F.col("__own_fp") == F.col("__fp")), "left_semi")
    some = some.withColumn("__hash", F.xxhash64(*[c for c, t in docs.dtypes if "map" not in t]))
    first = some.groupBy("doc_id", "__own_fp").agg(F.min("__hash").alias("__least"))
    first = first.select(F.col("doc_id").alias("__id"), F.col("__own_fp").alias("__fp"), "__least")
    match = F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("__own_fp") == F.col("__fp")) & (F.col("__hash") == F.col("__least"))
    return out.unionByName(some.join(first, match, "left_semi").dropDuplicates(["doc_id", "__own_fp"]).select(*names))
