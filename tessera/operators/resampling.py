"""Splits, folds, bootstrap draws and permutations as tables.

All order comes from md5 of (seed, salt, id), so every engine and every rerun
draws the same. A split is a join with one of these tables, never a copy.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.scalars import hash_order
from tessera.operators.ordered import join_on, numbered

#: Slots of a bootstrap replicate that are made from one row.
SLOTS = 1 << 16


def _shuffled(df: DataFrame, key: str, strata: list[str], seed, salt: str) -> DataFrame:
    return numbered(df, strata, hash_order(seed, salt, F.col(key)), key)


def stratified_split(df: DataFrame, key: str, strata: list[str], share: float = 0.8, seed=1) -> DataFrame:
    """``df`` with ``in_train``: the first floor(share * n) of each stratum in hash order."""
    sizes = df.groupBy(*strata).agg(F.count("*").alias("_size"))
    out = join_on(_shuffled(df, key, strata, seed, "split"), sizes, strata)
    return out.withColumn("in_train", F.col("_n") <= F.floor(F.col("_size") * share)).drop("_n", "_size")


def stratified_folds(df: DataFrame, key: str, strata: list[str], v: int = 5, seed=1, repeat: int = 1) -> DataFrame:
    """``(key, strata, repeat_id, fold_id)``: fold sizes of a stratum differ by one at most."""
    out = _shuffled(df, key, strata, seed, f"fold{repeat}")
    return out.select(key, *strata, F.lit(repeat).alias("repeat_id"), ((F.col("_n") - 1) % v + 1).cast("int").alias("fold_id"))


def repeated_folds(df: DataFrame, key: str, strata: list[str], v: int = 5, repeats: int = 5, seed=1) -> DataFrame:
    """Folds for each repeat in one pass: rows are spread over repeats, then numbered."""
    spread = df.select(key, *strata).withColumn("repeat_id", F.explode(F.array(*[F.lit(r) for r in range(1, repeats + 1)])))
    salt = F.concat(F.lit("fold"), F.col("repeat_id").cast("string"))
    order = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), salt, F.col(key).cast("string"))), 1, 8), 16, 10).cast("bigint")
    return numbered(spread, ["repeat_id", *strata], order, key).withColumn("fold_id", ((F.col("_n") - 1) % v + 1).cast("int")).drop("_n")


def inner_folds(folds: DataFrame, key: str, strata: list[str], v: int = 3, seed=1) -> DataFrame:
    """``(repeat_id, outer_fold, key, inner_fold)``: folds within every outer analysis set."""
    outer = folds.select("repeat_id", F.col("fold_id").alias("outer_fold")).distinct()
    rows = folds.join(outer, "repeat_id").where("fold_id <> outer_fold")  # a row for each repeat and fold
    order = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), F.lit("inner"), "repeat_id", "outer_fold", F.col(key).cast("string"))), 1, 8), 16, 10).cast("bigint")
    rows = numbered(rows, ["repeat_id", "outer_fold", *strata], order, key)
    return rows.select("repeat_id", "outer_fold", key, ((F.col("_n") - 1) % v + 1).cast("int").alias("inner_fold"))


def out_of_fold_faults(predictions: DataFrame, members: DataFrame, key: str) -> DataFrame:
    """What keeps out-of-fold predictions from being complete: repeated or absent ids by repeat; empty if none."""
    repeats = predictions.select("repeat_id").distinct()
    wanted = members.select(key).distinct().join(repeats)  # a row for each repeat
    have = predictions.groupBy("repeat_id", key).agg(F.count("*").alias("n"))
    j = wanted.withColumn("_w", F.lit(1)).join(have, ["repeat_id", key], "full")
    fault = F.when(F.col("_w").isNull(), "unknown").when(F.col("n").isNull(), "absent").when(F.col("n") > 1, "repeated")
    return j.withColumn("fault", fault).where("fault is not null").groupBy("repeat_id", "fault").agg(F.count("*").alias("n"))


def averaged_over_repeats(predictions: DataFrame, keys: list[str]) -> DataFrame:
    return predictions.groupBy(*keys).agg(F.avg("risk").alias("risk"), F.count("*").alias("n_repeats"))


def draw_numbers(df: DataFrame, key: str, seed=1, by: list[str] | None = None) -> DataFrame:
    """``(by, key, _i)``: the numbers from 0 by which bootstrap draws name rows, in hash order."""
    by = list(by or [])
    return numbered(df.select(*by, key), by, hash_order(seed, "index", F.col(key)), key).withColumn("_i", F.col("_n") - 1).drop("_n")


#: Left rotations of the digest's four rounds (fixed values); numbers that are digested at a time.
_TURNS, _LANES = ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21)), 5000


def _md5_heads(head: bytes, first: int, n: int, wide: bool) -> np.ndarray:
    """The first 32 bits (``wide``: 60) of md5 of ``head`` and each of ``n`` numbers from ``first`` on in decimals: as many digests side by side.

    The numbers differ in their last four digits only, so most of what is
    digested is the same for all.
    """
    digits = str(first).encode()
    text, tail = len(head) + len(digits), min(4, len(digits))
    block = bytearray((head + digits[:-tail]).ljust(64, b"\0"))
    block[text], block[56:60] = 0x80, (8 * text).to_bytes(4, "little")
    words, own = np.frombuffer(bytes(block), "<u4").astype(np.uint32), {}
    low = np.arange(n, dtype=np.uint32) + np.uint32(first % 10**tail)
    for k in range(tail):
        word, byte = divmod(text - 1 - k, 4)
        own[word] = own.get(word, words[word]) + ((low // np.uint32(10**k) % np.uint32(10) + np.uint32(48)) << np.uint32(8 * byte))
    start = [np.uint32(x) for x in (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)]
    a, b, c, d = (np.full(n, x, np.uint32) for x in start)
    f, t = np.empty(n, np.uint32), np.empty(n, np.uint32)
    for i in range(64):
        add = int(abs(math.sin(i + 1)) * 2**32)
        if i < 16:
            g = i
            np.bitwise_xor(c, d, out=f)
            f &= b
            f ^= d
        elif i < 32:
            g = (5 * i + 1) % 16
            np.bitwise_xor(b, c, out=f)
            f &= d
            f ^= c
        elif i < 48:
            g = (3 * i + 5) % 16
            np.bitwise_xor(b, c, out=f)
            f ^= d
        else:
            g = 7 * i % 16
            np.invert(d, out=f)
            f |= b
            f ^= c
        f += a
        if g in own:
            f += own[g]
        f += np.uint32((add + (0 if g in own else int(words[g]))) & 0xFFFFFFFF)
        turn = _TURNS[i // 16][i % 4]
        np.left_shift(f, np.uint32(turn), out=t)
        f >>= np.uint32(32 - turn)
        t |= f
        t += b
        a, d, c, b, t = d, c, b, t, a
    first_bits = (a + start[0]).byteswap().astype(np.int64)
    return first_bits << 28 | (b + start[1]).byteswap().astype(np.int64) >> 4 if wide else first_bits


def slot_digests(seed, first: int, n: int, wide: bool = False) -> np.ndarray:
    """The numbers of 32 bits (``wide``: 60) behind ``n`` bootstrap slots from ``first`` on, as ``bootstrap_slots`` has them."""
    head, out, at = f"{seed}|boot|".encode(), np.empty(n, np.int64), 0
    while at < n:
        number = first + at
        to = min(n, at + _LANES, at + 10**4 - number % 10**4, 10 ** len(str(number)) - first)  # numbers of one length that differ in four digits
        if len(head) + len(str(number)) > 55:  # more than one block
            out[at:to] = [int(hashlib.md5(head + str(k).encode()).hexdigest()[: 15 if wide else 8], 16) for k in range(number, first + to)]
        else:
            out[at:to] = _md5_heads(head, number, to - at, wide)
        at = to
    return out


def stretches(sizes: DataFrame, by: list[str], replicates: int, slots: int) -> DataFrame:
    """``(by, _size, replicate, _s, _end)``: a replicate's slots in stretches of at most ``slots``, dealt over the tasks."""
    parts = sizes.where("_size > 0").select(*by, "_size", F.explode(F.sequence(F.lit(1), F.lit(replicates))).alias("replicate"))
    first = (F.col("replicate") - 1) * F.col("_size")
    parts = parts.withColumn("_s", F.explode(F.sequence(first, first + F.col("_size") - 1, F.lit(slots).cast("bigint"))))
    tasks = int(sizes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = parts.repartition(tasks, *by, "replicate", "_s")  # by number: stretches are small rows, which would be put together in one task
    return parts.withColumn("_end", F.least(F.col("_s") + slots, first + F.col("_size")))


def bootstrap_slots(sizes: DataFrame, by: list[str], replicates: int, seed=1) -> DataFrame:
    """``(by, replicate, _i)``: for each of a replicate's slots the number of the row that it draws, ``sizes(by, _size)``.

    Slots are made where they are used, in stretches, so that no row explodes
    into all of them. Groups of 2^31 rows and more draw with 60 bits of the
    digest.
    """
    slots = stretches(sizes, by, replicates, SLOTS).withColumn("slot", F.explode(F.sequence("_s", F.col("_end") - 1)))
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), F.lit("boot"), F.col("slot").cast("string")))
    digits = F.when(F.col("_size") < 1 << 31, F.substring(digest, 1, 8)).otherwise(F.substring(digest, 1, 15))
    return slots.select(*by, "replicate", F.pmod(F.conv(digits, 16, 10).cast("bigint"), F.col("_size")).alias("_i"))


def bootstrap_draws(df: DataFrame, key: str, replicates: int, seed=1, by: list[str] | None = None) -> DataFrame:
    """``(by, replicate, key, times)``: rows drawn with replacement, as many as a group has, in each group of ``by``.

    Row numbers are dealt by hash order; each of replicate * n slots picks one.
    Picks are counted per row before they are joined, so the join is as small
    as the distinct draws.
    """
    by = list(by or [])
    numbers = draw_numbers(df, key, seed, by)
    sizes = df.groupBy(*by).agg(F.count("*").alias("_size"))
    counted = bootstrap_slots(sizes, by, replicates, seed).groupBy(*by, "replicate", "_i").agg(F.count("*").alias("times"))
    return join_on(counted, numbers, [*by, "_i"], large=True).select(*by, "replicate", key, "times")  # a plan takes slots for few rows


def permuted_labels(df: DataFrame, key: str, label: str, permutations: int, seed=1, by: list[str] | None = None) -> DataFrame:
    """``(by, perm_id, key, label)``: class counts of each group stay; permutation 0 is the observed one."""
    by = list(by or [])
    events = df.groupBy(*by).agg(F.sum(F.col(label).cast("bigint")).alias("_e"))
    spread = df.select(*by, key, label).withColumn("perm_id", F.explode(F.sequence(F.lit(0), F.lit(permutations))))
    spread = numbered(spread, [*by, "perm_id"], hash_order(seed, "perm", F.col("perm_id"), F.col(key)), key)
    out = join_on(spread, events, by) if by else spread.join(events)  # a row for each group
    drawn = (F.col("_n") <= F.col("_e")).cast("int")
    return out.select(*by, "perm_id", key, F.when(F.col("perm_id") == 0, F.col(label).cast("int")).otherwise(drawn).alias(label))
