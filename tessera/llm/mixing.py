"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

Everything here is a DataFrame or SQL expression. Each source's documents form
a line in a reproducible random order; a second pass over the source has an
order of its own. A block is one document in one pass. The source's quota is
the number of blocks that its target of words reaches. A binary tree deals the
quotas to the output shards: a node gives its left child half of its blocks,
whose sources are drawn hypergeometrically, and the rest to the right child.
A shard's blocks of a source are consecutive places of the source's line, so
shards are disjoint by construction, and a hash orders the blocks in a shard.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import WORD, Scratch, small, unit

#: Weights of the sources in order, repeating; words of the mix as a share of all words;
#: how often a source's words may be taken (fixed values).
WEIGHTS, SHARE, REPEATS = (5, 2, 1), 1.5, 2
SHARDS, SEED = 16, 17

#: Blocks that are put in order together; a source has as many buckets as it needs.
BUCKET = 2048

#: Sources, or groups of them, that a row of the splitting tree deals one after another.
FAN = 64


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def source_targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, repeats: int = REPEATS) -> DataFrame:
    """``(source, sidx, source_size, n_rows, target)`` of ``sizes(source, size)``.

    Sources are numbered by code point, null last, and weigh ``weights`` in
    turn. Targets share ``share`` of all words by weight, stop at ``repeats``
    times their source's words, and what is cut off is shared again by weight.
    That is min(cap, level * weight) at the one level where targets add up:
    with sources ordered by cap / weight, the level is the largest candidate
    that does not exceed its own source's ratio.
    """
    s = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_rows"))
    order = Window.orderBy(F.col("source").asc_nulls_last())  # a row for each source
    s = s.withColumn("sidx", F.row_number().over(order) - 1)
    s = s.withColumn("w", F.element_at(F.array(*map(F.lit, weights)), (F.col("sidx") % len(weights) + 1).cast("int")))
    s = s.withColumn("cap", F.col("source_size") * float(repeats)).withColumn("ratio", F.col("cap") / F.col("w"))
    up = Window.orderBy("ratio", "sidx").rowsBetween(Window.unboundedPreceding, -1)
    down = Window.orderBy(F.desc("ratio"), F.desc("sidx")).rowsBetween(Window.unboundedPreceding, 0)  # linear, unlike a frame up to the last row
    every = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    total = F.sum("source_size").over(every) * F.lit(float(share))
    s = s.withColumn("level", (total - F.coalesce(F.sum("cap").over(up), F.lit(0.0))) / F.sum("w").over(down))
    level = F.coalesce(F.max(F.when(F.col("level") <= F.col("ratio"), F.col("level"))).over(every), F.max("ratio").over(every))
    return s.withColumn("target", F.least("cap", level * F.col("w"))).select(
        "source", "sidx", "source_size", "n_rows", "target"
    )


def hypergeometric(N: str, K: str, n: str, u: str) -> str:
    """SQL for a draw from the hypergeometric law: of N items K are marked, n are taken.

    By inversion: weights relative to the mode's follow from their ratios, over
    all values within ten standard deviations (what lies outside weighs less
    than a double can tell), from the mode up and then down.
    """
    mode = f"greatest(greatest(0L, {n} + {K} - {N}), least(least({n}, {K}), floor((({n} + 1D) * ({K} + 1D)) / ({N} + 2D))))"
    sd = f"ceil(10 * sqrt(greatest(0D, {n} * 1D * {K} / greatest({N}, 1L) * (1 - {K} * 1D / greatest({N}, 1L)) * ({N} - {n}) / greatest({N} - 1, 1L)))) + 10"
    lo, hi = f"greatest(greatest(0L, {n} + {K} - {N}), m - w)", f"least(least({n}, {K}), m + w)"
    up = f"(({K} - x) * 1D * ({n} - x)) / ((x + 1D) * ({N} - {K} - {n} + x + 1D))"
    down = f"(x * 1D * ({N} - {K} - {n} + x)) / (({K} - x + 1D) * ({n} - x + 1D))"
    rise, fall = f"if({hi} > m, sequence(m, {hi} - 1), array())", f"if({lo} < m, sequence(m, {lo} + 1, -1L), array())"

    def let(name: str, value: str, body: str) -> str:
        return f"aggregate(array({value}), CAST(0 AS BIGINT), (ignored_{name}, {name}) -> {body})"

    def total(xs: str, ratio: str) -> str:
        return f"aggregate({xs}, named_struct('p', 1D, 's', 0D), (a, x) -> named_struct('p', a.p * {ratio}, 's', a.s + a.p * {ratio}), a -> a.s)"

    def pick(xs: str, ratio: str, step: int, start: str) -> str:
        got = f"a.p * {ratio}"
        return (
            f"aggregate({xs}, {start}, (a, x) -> named_struct('p', {got}, 's', a.s + {got},"
            f" 'k', if(a.k IS NULL AND a.s + {got} >= v, x + {step}L, a.k)))"
        )

    first = f"named_struct('p', 1D, 's', 1D, 'k', if(1D >= v, m, CAST(NULL AS BIGINT)))"
    rising = pick(rise, up, 1, first)
    whole = f"1D + {total(rise, up)} + {total(fall, down)}"
    falling = pick(fall, down, -1, "named_struct('p', 1D, 's', r.s, 'k', r.k)")
    chosen = f"aggregate(array({rising}), CAST(0 AS BIGINT), (ignored_r, r) -> coalesce({falling}.k, m))"
    inner = f"aggregate(array({u} * ({whole})), CAST(0 AS BIGINT), (ignored_v, v) -> {chosen})"
    return let("m", f"CAST({mode} AS BIGINT)", let("w", f"CAST({sd} AS BIGINT)", inner))


def shard_quotas(quotas: DataFrame, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """``(sidx, cuts)``: of each source's quota, where the shards' parts of it end.

    ``quotas(sidx, quota)`` has a row for each source, numbered from 0. The
    shards' tree is a heap: node 1 has all blocks, node k's children are 2k and
    2k + 1. Sources are gathered by ``FAN``, these groups by ``FAN`` again, up
    to one group. From the top down, a group's blocks at every node are known
    and are dealt to its members, so a row never holds more than ``FAN`` of
    them, and a step deals all groups of its height side by side.
    """
    if shards < 1 or shards & (shards - 1):
        raise ValueError("shards must be a power of 2")
    sources, height = quotas.agg(F.max("sidx")).first()[0], 1
    while sources is not None and FAN**height <= sources:
        height += 1
    grow = "concat(a, array(if(k % 2 = 0, a[k div 2 - 1] div 2, a[k div 2 - 1] - a[k div 2 - 1] div 2)))"
    heap = f"aggregate(sequence(2, {2 * shards - 1}), array(total), (a, k) -> {grow})" if shards > 1 else "array(total)"
    dealt = None
    for step in reversed(range(height)):
        members = quotas.groupBy(F.floor(F.col("sidx") / FAN**step).alias("id")).agg(F.sum("quota").alias("quota"))
        groups = members.groupBy(F.floor(F.col("id") / FAN).alias("part")).agg(F.sort_array(F.collect_list(F.struct("id", "quota"))).alias("q"), F.sum("quota").alias("total"))
        known = groups.withColumn("counts", F.expr(heap)) if dealt is None else groups.join(dealt, "part")  # one group at the top
        dealt = known.select(F.explode(F.expr(_split(shards, seed, FAN ** (step + 1)))).alias("x")).select(F.col("x.id").alias("part"), "x.counts")
    ends = f"transform(sequence({shards}, {2 * shards - 1}), k -> aggregate(slice(counts, {shards}, k - {shards - 1}), 0L, (s, x) -> s + x))"
    return dealt.select(F.col("part").cast("int").alias("sidx"), F.expr(ends).alias("cuts"))


def _split(shards: int, seed: int, height: int) -> str:
    """SQL for ``(id, counts)`` of the members ``q`` of a group with ``counts`` blocks at every node: each node's blocks are dealt to its children."""
    draw = hypergeometric("acc.pop", "src.quota", "acc.take", f"(shiftrightunsigned(xxhash64({seed}, {height}L, k, src.id), 11) / {float(1 << 53)}D)")
    drawn = f"""aggregate(nodes[k - 1], named_struct('pop', counts[k - 1], 'take', counts[2 * k - 1], 'out', CAST(array() AS ARRAY<STRUCT<id: BIGINT, quota: BIGINT>>)),
        (acc, src) -> aggregate(array({draw}), acc, (same, n) -> named_struct('pop', acc.pop - src.quota, 'take', acc.take - n,
            'out', concat(acc.out, array(named_struct('id', src.id, 'quota', n))))), acc -> acc.out)"""
    rest = "zip_with(nodes[k - 1], l, (x, y) -> named_struct('id', x.id, 'quota', x.quota - y.quota))"
    both = f"aggregate(array({drawn}), nodes, (ignored, l) -> concat(nodes, array(l, {rest})))"
    tree = f"aggregate(sequence(1, {shards - 1}), array(q), (nodes, k) -> {both})" if shards > 1 else "array(q)"
    return f"aggregate(array({tree}), CAST(array() AS ARRAY<STRUCT<id: BIGINT, counts: ARRAY<BIGINT>>>), (none, t) -> transform(q, (m, i) -> named_struct('id', m.id, 'counts', transform(t, n -> n[i].quota))))"


def mix(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, repeats: int = REPEATS, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """How many words, and into which shards, the mix takes of each document.

    ``docs(doc_id, text, source)`` gives a row for each of its rows: ``doc_id,
    source, size, source_size, target, taken, blocks``. ``blocks`` is an array
    of (shard, order, pass, words): the draws that the document is part of, in
    the order of the shard. The last block of a source's quota is cut where
    the target is reached, to the word, so a source's taken words are its
    target rounded. Sizes count words; null and wordless texts have size 0 and
    are never drawn. Rows alike in doc_id, source and size are one block, and
    its words go to them in turn. Null sources are a source of their own, null
    doc_ids an id of their own. Other columns are not read; no rows give none.
    """
    with Scratch(docs.sparkSession) as scratch:
        return scratch.result(_mix(docs, scratch, weights, share, repeats, shards, seed))


def _mix(docs, scratch, weights, share, repeats, shards, seed):
    sizes = scratch.keep(
        docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("source").cast("string").alias("source"),
                    word_count(F.col("text").cast("string")).alias("size"))
    )
    targets = scratch.keep(source_targets(sizes, weights, share, repeats))
    known = small(targets)
    keys = sizes.groupBy("doc_id", "source", "size").agg(F.count("*").alias("rows"))
    keys = keys.join(known.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    words = F.col("size") * F.col("rows")
    quota = F.round(F.col("target")).cast("bigint") - F.col("pass") * F.col("source_size")
    blocks = (
        keys.where("size > 0")
        .withColumn("pass", F.explode(F.array(*map(F.lit, range(repeats)))))
        .withColumn("quota", F.greatest(F.lit(0), F.least(quota, F.col("source_size"))))
        .where("quota > 0")
        .withColumn("h", unit(F.lit(seed), "pass", "doc_id", "size"))
        .withColumn("bucket", F.floor(F.col("h") * F.ceil(F.col("n_rows") / BUCKET)))
    )
    part = ["sidx", "pass", "bucket"]
    before = Window.partitionBy("sidx", "pass").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = scratch.keep(
        blocks.groupBy(part).agg(F.sum(words).alias("bw"), F.count("*").alias("bn"))
        .select(*part, F.coalesce(F.sum("bw").over(before), F.lit(0)).alias("w0"), F.coalesce(F.sum("bn").over(before), F.lit(0)).alias("n0"))
    )
    line = Window.partitionBy(part).orderBy("h", "doc_id", "size")
    placed = (
        blocks.withColumn("at", F.sum(words).over(line) - words).withColumn("place", F.row_number().over(line) - 1)
        .join(starts, part)
        .withColumn("words", F.greatest(F.lit(0), F.least(words, F.col("quota") - F.col("w0") - F.col("at"))))
        .where("words > 0")
        .select("doc_id", "sidx", "size", "rows", "pass", "words", (F.col("n0") + F.col("place")).alias("place"))
    )
    placed = scratch.keep(placed)
    counts = scratch.keep(placed.groupBy("sidx", "pass").agg(F.count("*").alias("quota")))
    earlier = Window.partitionBy("sidx").orderBy("pass").rowsBetween(Window.unboundedPreceding, -1)
    passes = scratch.keep(counts.withColumn("p0", F.coalesce(F.sum("quota").over(earlier), F.lit(0))).select("sidx", "pass", "p0"))
    cuts = scratch.keep(shard_quotas(counts.groupBy("sidx").agg(F.sum("quota").alias("quota")), shards, seed))
    drawn = (
        placed.join(small(passes), ["sidx", "pass"]).join(small(cuts), "sidx")
        .withColumn("shard", F.expr("size(filter(cuts, c -> c <= p0 + place))"))
        .withColumn("order", F.xxhash64(F.lit(seed + 1), "shard", "pass", "doc_id", "size"))
        .groupBy("doc_id", "sidx", "size")
        .agg(F.sort_array(F.collect_list(F.struct("shard", "order", "pass", "words"))).alias("drawn"))
    )
    drawn = scratch.keep(drawn)
    out = (
        keys.join(drawn.select(F.col("doc_id").alias("d"), F.col("sidx").alias("i"), F.col("size").alias("z"), "drawn"),
                  F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("sidx") == F.col("i")) & (F.col("size") == F.col("z")), "left")
        .withColumn("row", F.explode(F.expr("sequence(0L, rows - 1)")))
        .withColumn("blocks", F.expr("""coalesce(filter(transform(drawn, b -> named_struct('shard', b.shard, 'order', b.order, 'pass', b.pass,
            'words', greatest(0L, least(size, b.words - row * size)))), b -> b.words > 0),
            CAST(array() AS ARRAY<STRUCT<shard: INT, order: BIGINT, pass: INT, words: BIGINT>>))"""))
    )
    return out.select("doc_id", "source", "size", "source_size", "target",
                      F.expr("aggregate(blocks, 0L, (s, b) -> s + b.words)").alias("taken"), "blocks")


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs``, each as often as the mix draws it, whole.

    A row of a block that the quota cuts counts as drawn if at least half of
    it is in. Rows alike in doc_id, source and size are drawn one by one, in
    the order of a hash of all their columns; equal rows are interchangeable.
    All columns stay as they are; documents that are not drawn go.
    """
    key, names = ["__d", "__s", "__z"], docs.columns
    plain = [c for c, t in docs.dtypes if "map" not in t]
    named = [F.col("doc_id").cast("bigint").alias("__d"), F.col("source").cast("string").alias("__s"), word_count(F.col("text").cast("string")).alias("__z"), F.xxhash64(*plain).alias("__h")]
    with Scratch(docs.sparkSession) as scratch:
        times = F.expr("size(filter(blocks, b -> 2 * b.words >= size))")
        drawn = mix(docs, **options).select(F.col("doc_id").alias("__d"), F.col("source").alias("__s"), F.col("size").alias("__z"), times.alias("times")).where("times > 0")
        drawn = drawn.groupBy(*key, "times").agg(F.count("*").alias("n"))
        upto = Window.partitionBy(*key).orderBy(F.col("times").desc()).rowsBetween(Window.unboundedPreceding, 0)  # a row for each number of draws
        drawn = drawn.withColumn("end", F.sum("n").over(upto)).groupBy(*key).agg(F.collect_list(F.struct((F.col("end") - F.col("n")).alias("first"), "end", "times")).alias("ranks"))
        drawn = drawn.select(*[F.col(k).alias(f"{k}_") for k in key], "ranks")
        groups = docs.select(*named).groupBy(*key, "__h").agg(F.count("*").alias("c"))
        same = (F.col("__z") == F.col("__z_")) & F.col("__d").eqNullSafe(F.col("__d_")) & F.col("__s").eqNullSafe(F.col("__s_"))
        groups = scratch.keep(groups.join(drawn, same).drop(*[f"{k}_" for k in key]).withColumn("part", F.shiftrightunsigned("__h", 58)))
        # where a group of equal rows begins among the rows alike: parts of them by hash, then the groups in a part
        before = Window.partitionBy(*key).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
        parts = groups.groupBy(*key, "part").agg(F.sum("c").alias("n")).withColumn("p0", F.coalesce(F.sum("n").over(before), F.lit(0)))
        parts = parts.select(*[F.col(k).alias(f"{k}_") for k in key], F.col("part").alias("part_"), "p0")
        inside = Window.partitionBy(*key, "part").orderBy("__h").rowsBetween(Window.unboundedPreceding, -1)
        placed = groups.join(parts, same & (F.col("part") == F.col("part_"))).withColumn("at", F.col("p0") + F.coalesce(F.sum("c").over(inside), F.lit(0)))
        copies = F.expr("aggregate(ranks, 0L, (n, r) -> n + r.times * greatest(0L, least(r.end, at + c) - greatest(r.first, at)))")
        picked = placed.select(*[F.col(k).alias(f"{k}_") for k in key], F.col("__h").alias("__h_"), "c", copies.alias("__copies")).where("__copies > 0")
        picked = scratch.result(picked)
    rows = docs.select("*", *named).join(picked, same & (F.col("__h") == F.col("__h_")))
    out = rows.where("c = 1")
    if picked.where("c > 1").limit(1).count():  # of equal rows one stands for all
        out = out.unionByName(rows.where("c > 1").dropDuplicates([*key, "__h"]))
    return out.withColumn("__copy", F.explode(F.expr("sequence(1L, __copies)"))).select(*names)
