"""Passages that repeat across documents, by compact windows.

Tokens are runs of five words, hashed by several functions. For one function a
Cartesian tree over a text's token hashes has a node for every subsequence
minimum: the node's compact window (l, c, r) stands for all subsequences from
l..c to c..r, whose min-hash is the token at c. Only windows that hold a passage
of the required length matter; their centres are the minima of sliding windows
of that length, and their bounds are the nearest smaller centres.

Windows whose min-hash only one text has are dropped. Within a text the windows
of different functions are joined by interval: where they overlap in at least a
passage, its subsequences share several min-hashes. Subsequences that agree in
all functions are compared whole, by hash, so exact repeats are linked and
marked without a pair. Between texts that these leave apart, those that agree in two
functions over a joint window are candidates: their contexts around the centres
are verified by the Jaccard similarity of their tokens, with words inserted,
deleted or replaced, or sentences in another order.
"""

from __future__ import annotations

from bisect import bisect_left
from fractions import Fraction
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import Scratch, pieces, slices
from tessera.llm.graph import components
from tessera.llm.words import ODD, Powers, Words, mixed

#: Words of a token, words of the shortest passage, similarity, hash functions, of which candidates agree in two.
SHINGLE, PASSAGE, SIMILARITY, HASHES = 5, 50, 0.8, 3
#: Classes of one key that are compared in one go; more are dealt in blocks that have about so many classes in common.
BLOCK, HUBS = 256, 8
#: Beyond all row numbers.
REST = 1 << 62
#: Tasks that the rows of one key are dealt over.
SALTS = 64
#: Bytes of texts, or of their words' bits, that are worked on together.
PIECE = 1 << 18


def tokens(h: np.ndarray, n: int = SHINGLE) -> np.ndarray:
    """A 64-bit hash for each run of ``n`` words, of the words' hashes."""
    if len(h) < n:
        return np.empty(0, np.uint64)
    h = h.astype(np.uint64)
    m = len(h) - n + 1
    t = np.zeros(m, np.uint64)
    for k in range(n):
        t = (t * ODD[0]) ^ (h[k : k + m] + np.uint64(int(ODD[1]) * (k + 1) % (1 << 64)))
        t ^= t >> np.uint64(29)
    return t * ODD[2]


def centres(h: np.ndarray, t: int, valid: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(begin, c, keys)``: runs of ``valid`` sliding windows of ``t`` tokens with one minimum; ties go to the left.

    ``begin`` counts valid windows only, of which every run is a stretch; ``c``
    is the minimum's place, ``keys`` order them.
    """
    n = len(h)
    if n < t:
        return (*(np.empty(0, np.int64),) * 2, np.empty(0, np.uint64))
    bits = np.uint64(max(20, int(n).bit_length()))
    low = (np.uint64(1) << bits) - np.uint64(1)
    key = (h & ~low) | np.arange(n, dtype=np.uint64)  # hash first, place second
    m, width = key, 1
    while width * 2 <= t:
        m = np.minimum(m[:-width], m[width:])
        width *= 2
    if width < t:
        m = np.minimum(m[: n - t + 1], m[t - width : t - width + n - t + 1])
    m = m[valid]
    begin = np.flatnonzero(np.append(True, m[1:] != m[:-1])) if len(m) else np.empty(0, np.int64)
    m = m[begin]
    return begin, (m & low).astype(np.int64), m


class Slice:
    """Some texts' words, one text after another, and the windows of a passage that lie in one text."""

    def __init__(self, sigs: list[bytes], passage: int):
        words = np.frombuffer(b"".join(sigs), "<u2")
        size = np.array([len(x) >> 1 for x in sigs], np.int64)
        self.t = passage - SHINGLE + 1
        self.end = np.cumsum(size)
        self.start = self.end - size
        self.tokens = tokens(words)
        of = np.repeat(np.arange(len(sigs)), size)
        room = self.end[of] - np.arange(len(words)) >= passage
        self.valid = room[: max(0, len(self.tokens) - self.t + 1)]
        self.at = np.flatnonzero(self.valid)  # a window's first token
        self.of = of[self.at]  # and its text

    def functions(self, hashes: int, shared: np.ndarray | None = None) -> list[tuple]:
        """By function: hashes, runs of windows, centres, their order, and which of them have a min-hash in ``shared``."""
        out = []
        for k in range(hashes):
            v = mixed(self.tokens, k)
            begin, c, keys = centres(v, self.t, self.valid)
            out.append((v, begin, c, keys, None if shared is None else np.isin(v[c].view(np.int64), shared)))
        return out

    def runs(self, begin: np.ndarray) -> np.ndarray:
        """How many windows each run has."""
        return np.diff(np.append(begin, len(self.at)))

    def bounds(self, begin: np.ndarray, c: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``(l, r)`` of the compact windows at these centres: by the Cartesian tree of each text, as far as it has windows of ``t`` tokens."""
        t, last = self.t, begin + self.runs(begin) - 1
        of = self.of[begin]
        before, after = (self.start[of] - 1).tolist(), (self.end[of] - SHINGLE + 1).tolist()
        stack: list[int] = []
        place, text, own = c.tolist(), of.tolist(), -1
        keys = keys.tolist()
        for i, v in enumerate(keys):
            if text[i] != own:
                stack, own = [], text[i]
            while stack and keys[stack[-1]] > v:
                after[stack.pop()] = place[i]
            if stack:
                before[i] = place[stack[-1]]
            stack.append(i)
        l = np.where(self.at[begin] > c - t + 1, self.at[begin], np.array(before, np.int64) + 1)
        r = np.where(self.at[last] < c, self.at[last] + t - 1, np.array(after, np.int64) - 1)
        return l, r


def reach(t: int, s: Fraction) -> int:
    """How far from its centre a window is compared.

    Cut where both sides have t tokens, two near passages fall into pieces of
    less than 2 t tokens on the one side, of which one at least is as near as
    the whole; the other side is then longer by the similarity at most.
    """
    return int((2 * t - 1) / s)


def _texts(docs: DataFrame, passage: int) -> DataFrame:
    """A row for each row: its words' number, a 128-bit digest of them, and 16 bits for each word of a text of a passage or more."""

    def run(batches):
        words = Words()
        for batch in batches:
            for part in pieces(batch, 2, PIECE):
                raws = [(t or "").encode() for t in part.column(2).to_pylist()]
                place, h = words.hashes(b"\n".join(raws))
                ends = np.searchsorted(place, np.cumsum([len(x) + 1 for x in raws]))
                cuts = list(zip(np.append(0, ends[:-1]).tolist(), ends.tolist()))
                digests = [np.frombuffer(xxhash.xxh3_128_digest(h[a:b].tobytes()), np.int64) for a, b in cuts]
                bits = (h >> np.uint64(48)).astype("<u2")
                f, g = np.stack(digests, axis=1)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(f), pa.array(g), pa.array([b - a for a, b in cuts], pa.int32()),
                     pa.array([bits[a:b].tobytes() if b - a >= passage else b"" for a, b in cuts], pa.binary())],
                    names=["rid", "doc_id", "f", "g", "n", "sig"],
                )

    rows = docs.select(F.monotonically_increasing_id().alias("rid"), F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "rid bigint, doc_id bigint, f bigint, g bigint, n int, sig binary")


def _min_hashes(distinct: DataFrame, passage: int, hashes: int) -> DataFrame:
    """``(rid, tok)``: the different min-hashes of a text's passages."""

    def run(batches):
        for batch in batches:
            for part in pieces(batch, 1, PIECE):
                x = Slice(part.column(1).to_pylist(), passage)
                found = [(v[c], x.of[begin]) for v, begin, c, _, _ in x.functions(hashes)]
                tok, of = (np.concatenate([f[k] for f in found]) for k in (0, 1))
                order = np.lexsort((tok, of))
                tok, of = tok[order], of[order]
                new = np.append(True, (tok[1:] != tok[:-1]) | (of[1:] != of[:-1])) if len(tok) else np.empty(0, bool)
                tok, of = tok[new], of[new]
                ends = np.append(0, np.cumsum(np.bincount(of, minlength=part.num_rows))).astype(np.int32)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(ends), pa.array(tok.view(np.int64)))], names=["rid", "tok"])

    return distinct.select("rid", "sig").mapInArrow(run, "rid bigint, tok array<bigint>")


def _salts(by: str):
    """Which of the SALTS tasks have rows of a key, as bits."""
    return F.expr(f"bit_or(shiftleft(1L, CAST(pmod({by}, {SALTS}) AS INT)))").alias("salts")


def _dealt(rows: DataFrame, stats: DataFrame, keys: list[str], by: str) -> DataFrame:
    """``rows`` joined with the row of ``stats`` for their key; a key's rows are dealt over SALTS tasks by ``by``, so no key fills one."""
    few = stats.withColumn("salt", F.explode(F.expr(f"filter(sequence(0, {SALTS - 1}), x -> (shiftrightunsigned(salts, x) & 1L) = 1)"))).drop("salts")
    return rows.withColumn("salt", F.expr(f"CAST(pmod({by}, {SALTS}) AS INT)")).join(few.hint("shuffle_hash"), [*keys, "salt"]).drop("salt")


def _column_values(column) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False)


def _passages(texts: DataFrame, passage: int, hashes: int) -> DataFrame:
    """``(h, tok, rid, at)``: the passages all of whose min-hashes are shared, by hash and one min-hash."""

    def run(batches):
        powers = Powers(int(ODD[0]))
        for batch in batches:
            for part in pieces(batch, 1, PIECE):
                x = Slice(part.column(1).to_pylist(), passage)
                found = x.functions(hashes, _column_values(part.column(2)))
                on = np.flatnonzero(np.logical_and.reduce([np.repeat(ok, x.runs(begin)) for _, begin, _, _, ok in found]))
                at, p = x.at[on], powers.grow(len(x.tokens) + 1)
                sums = np.append(np.uint64(0), np.cumsum(mixed(x.tokens, 2) * p.up[: len(x.tokens)], dtype=np.uint64))
                v, begin, c, _, _ = found[0]
                cols = (mixed((sums[at + x.t] - sums[at]) * p.down[at], 3).view(np.int64), np.repeat(v[c], x.runs(begin))[on].view(np.int64),
                        part.column(0).to_numpy()[x.of[on]], (at - x.start[x.of[on]]).astype(np.int32))
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["h", "tok", "rid", "at"])

    return texts.select("rid", "sig", "toks").mapInArrow(run, "h bigint, tok bigint, rid bigint, at int")


def _joint_windows(texts: DataFrame, passage: int, hashes: int, far: int) -> DataFrame:
    """``(key, rid, comp, mark, lo, c, hi)``: where shared windows of two functions overlap in a passage.

    ``key`` names the two min-hashes, ``c`` is the first one's place, and
    ``lo..hi`` what both windows hold, ``far`` from a centre at most. ``mark`` is ``rid``, with REST on top if any of
    these passages is not an exact repeat. Where all are exact repeats only the
    texts that stand for one have a row.
    """

    def run(batches):
        for batch in batches:
            for part in pieces(batch, 1, PIECE):
                x = Slice(part.column(1).to_pylist(), passage)
                found = x.functions(hashes, _column_values(part.column(2)))
                bounds = [x.bounds(begin, c, keys) for _, begin, c, keys, _ in found]
                rid, comp = part.column(0).to_numpy(), part.column(3).to_numpy()
                seen = part.column(4)
                first = np.searchsorted(x.of, np.arange(part.num_rows))
                place = _column_values(seen).astype(np.int64)
                spot = np.repeat(first, seen.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)) + (place >> 1) + 1
                known, stands = np.zeros(len(x.at) + 1, np.int64), np.zeros(len(x.at) + 1, np.int64)
                known[spot], stands[spot] = 1, place & 1
                known, stands = np.cumsum(known), np.cumsum(stands)
                cols: list[list] = [[] for _ in range(7)]
                for n, (a, b) in enumerate(combinations(range(hashes), 2)):
                    (va, ba, ca, _, oka), (vb, bb, cb, _, okb) = found[a], found[b]
                    cuts = np.union1d(ba, bb)
                    stop = np.append(cuts[1:], len(x.at))
                    rest = known[stop] - known[cuts] < stop - cuts
                    ia, ib = np.searchsorted(ba, cuts, "right") - 1, np.searchsorted(bb, cuts, "right") - 1
                    keep = oka[ia] & okb[ib] & (rest | (stands[stop] > stands[cuts]))
                    cuts, ia, ib, rest = cuts[keep], ia[keep], ib[keep], rest[keep]
                    c, d = ca[ia], cb[ib]
                    lo = np.maximum(np.maximum(bounds[a][0][ia], bounds[b][0][ib]), np.maximum(c, d) - far)
                    hi = np.minimum(np.minimum(bounds[a][1][ia], bounds[b][1][ib]), np.minimum(c, d) + far)
                    key = mixed(va[c] * ODD[0] ^ (vb[d] + np.uint64(n)) * ODD[1], 1)
                    of = x.of[cuts]
                    for col, v in zip(cols, (key.view(np.int64), rid[of], comp[of], rid[of] + rest * REST, *((y - x.start[of]).astype(np.int32) for y in (lo, c, hi)))):
                        col.append(v)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in cols], names=["key", "rid", "comp", "mark", "lo", "c", "hi"])

    return texts.select("rid", "sig", "toks", "comp", "places").mapInArrow(run, "key bigint, rid bigint, comp bigint, mark bigint, lo int, c int, hi int")


def _contexts(grouped: DataFrame) -> DataFrame:
    """The words' bits that a joint window holds."""

    def run(batches):
        for batch in batches:
            for part in slices(batch, 16):
                sigs, wins = part.column(1).to_pylist(), part.column(3)
                of = np.repeat(np.arange(part.num_rows), wins.value_lengths().to_numpy(zero_copy_only=False))
                key, many, apart, lo, c, hi = wins.flatten().flatten()
                begin, middle, end = (v.to_numpy(zero_copy_only=False) for v in (lo, c, hi))
                rid, comp = (part.column(k).to_numpy(zero_copy_only=False)[of] for k in (0, 2))
                for at in range(0, len(of), 4096):
                    m = slice(at, at + 4096)
                    ctx = [sigs[r][2 * x : 2 * (y + SHINGLE)] for r, x, y in zip(of[m].tolist(), begin[m].tolist(), end[m].tolist())]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(rid[m]), pa.array(comp[m]), key[m], many[m], apart[m], c[m], pa.array(middle[m] - begin[m]), pa.array(ctx, pa.binary())],
                        names=["rid", "comp", "key", "many", "apart", "c", "left", "ctx"],
                    )

    return grouped.select("rid", "sig", "comp", "wins").mapInArrow(run, "rid bigint, comp bigint, key bigint, many boolean, apart boolean, c int, left int, ctx binary")


#: Pairs that are compared at a time.
PAIRS = 1 << 13


def context_tokens(ctx, left: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The tokens of contexts, one after another: which context each is of, its place from the centre, and its hash."""
    if not len(ctx):
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint64)
    ends = np.frombuffer(ctx.buffers()[1], np.int32, len(ctx) + 1, ctx.offset * 4).astype(np.int64)
    data = np.frombuffer(ctx.buffers()[2], np.uint8)[ends[0] : ends[-1]].view("<u2")
    ends = (ends - ends[0]) >> 1
    size = np.diff(ends) - SHINGLE + 1
    row = np.repeat(np.arange(len(ctx)), size)
    place = np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)
    return row, place - left[row], tokens(data)[place + ends[:-1][row]]


def _runs(key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A stable order of keys, where the runs of equal ones begin in it, and the run of each place in it."""
    if key.dtype == np.uint64:  # upper bits first, place second; keys that differ in the lower bits alone are rare
        low = (np.uint64(1) << np.uint64(len(key).bit_length())) - np.uint64(1)
        order = (np.sort(key & ~low | np.arange(len(key), dtype=np.uint64)) & low).astype(np.int64)
        of = key[order]
        first = np.ones(len(key), bool)
        first[1:] = of[1:] != of[:-1]
        if not (first[1:] & ((of[1:] ^ of[:-1]) <= low)).any():
            return order, np.flatnonzero(first), np.cumsum(first) - 1
    order = np.argsort(key, kind="stable")
    first = np.ones(len(key), bool)
    first[1:] = key[order[1:]] != key[order[:-1]]
    return order, np.flatnonzero(first), np.cumsum(first) - 1


def _numbered(group: np.ndarray, row: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Numbers for tokens of several contexts of a group, -1 for others: by token, and by token and occurrence in its context.

    The latter count from 0 in every group; their number by group is returned as well.
    """
    token, label = np.full(len(row), -1, np.int32), np.full(len(row), -1, np.int32)
    counts = np.zeros(int(group.max()) + 1 if len(group) else 0, np.int64)
    if not len(row):
        return token, label, counts
    g = group[row]
    key = value * ODD[0] ^ (g.astype(np.uint64) + np.uint64(1)) * ODD[1]
    order, begin, run = _runs(key)
    token[order] = np.where(row[order] == row[order[begin]][run], -1, 0)
    shared = np.zeros(len(begin), bool)
    shared[run[token[order] == 0]] = True
    token[order] = np.where(shared[run], run, -1)
    part = np.ones(len(row), bool)
    part[1:] = (run[1:] != run[:-1]) | (row[order[1:]] != row[order[:-1]])
    starts = np.flatnonzero(part)
    nth = np.empty(len(row), np.uint64)
    nth[order] = np.arange(len(row)) - starts[np.cumsum(part) - 1]
    if nth.any():
        order, begin, run = _runs(np.where(nth > 0, mixed(key + nth * ODD[3], 0), key))
    many = np.diff(np.append(begin, len(row))) > 1
    owner = g[order[begin]]
    by = np.argsort(owner[many], kind="stable")
    counts += np.bincount(owner[many], minlength=len(counts))
    number = np.empty(len(by), np.int64)
    number[by] = np.arange(len(by)) - np.repeat(np.cumsum(counts) - counts, counts)
    of_run = np.full(len(begin), -1, np.int64)
    of_run[many] = number
    label[order] = of_run[run]
    return token, label, counts


def stretches(good: np.ndarray, inside: np.ndarray, gain: int, loss: int, t: int):
    """Around the middle column: is there a stretch of t places and more whose gains make up for its losses, and the outer ends of all such."""
    far = good.shape[1] // 2
    p = np.zeros((len(good), 2 * far + 2), np.int32)
    np.cumsum(np.where(inside, np.where(good, gain, -loss), -1_000_000), axis=1, out=p[:, 1:])
    after = np.maximum.accumulate(p[:, ::-1], axis=1)[:, ::-1]
    before = np.minimum.accumulate(p, axis=1)
    x, e = np.arange(far + 1), np.arange(far + 1, 2 * far + 2)
    head = after[:, np.maximum(x + t, far + 1)] >= p[:, x]
    tail = p[:, e] >= before[:, np.minimum(e - t, far)]
    return head.any(axis=1), head.argmax(axis=1), 2 * far - tail[:, ::-1].argmax(axis=1)


def _chains(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places (x, y) of equal tokens and how long a chain of matches in order may end there; the centre is (0, 0).

    Where (x + 1, y + 1) matches as well (x, y) is left out, since what holds with it holds with the next one.
    """
    p, q = np.flatnonzero(a >= 0), np.flatnonzero(b >= 0)[::-1]
    k = np.flatnonzero(a[p][:, None] == b[q])
    x = k // max(len(q), 1)
    y = q[k - x * len(q)]
    xs, ys = np.zeros(len(k) + 1, np.int64), np.zeros(len(k) + 1, np.int64)
    xs[1:], ys[1:] = p[x] + 1, y + 1
    if (y[1:] > y[:-1]).all():  # one chain has them all
        n = np.arange(len(y) + 1)
    else:
        ends, ln = [-1], [0]
        for v in y.tolist():
            if v > ends[-1]:
                ln.append(len(ends))
                ends.append(v)
            else:
                k = bisect_left(ends, v)
                ends[k] = v
                ln.append(k)
        n = np.array(ln)
    wide = len(b) + 2
    spot = xs * wide + ys
    known = np.zeros(wide * (len(a) + 2), bool)
    known[spot] = True
    last = ~known[spot + wide + 1]
    return xs[last], ys[last], n[last]


def in_order(a: np.ndarray, b: np.ndarray, t: int, s: Fraction):
    """The outer ends (x0, x1, y0, y1) of near passages whose matches are in order, with any gaps; None if there are none."""
    far = len(a) // 2
    lx, ly, ln = _chains(a[:far][::-1], b[:far][::-1])
    rx, ry, rn = _chains(a[far + 1 :], b[far + 1 :])
    num, den = s.numerator, s.denominator
    kind = np.int16 if (num + den) * (4 * far + 2 * t + 4) < 1 << 15 else np.int64
    (lx, ly, ln), (rx, ry, rn) = (tuple(v.astype(kind) for v in side) for side in ((lx, ly, ln), (rx, ry, rn)))
    sides = np.maximum(np.add.outer(lx, rx + 1), t) + np.maximum(np.add.outer(ly, ry + 1), t)
    ok = np.add.outer(ln, rn + 1) * kind(num + den) >= kind(num) * sides
    i = ok.any(axis=1)
    if not i.any():
        return None
    j = ok.any(axis=0)
    return -int(lx[i].max()), int(rx[j].max()), -int(ly[i].max()), int(ry[j].max())


def crossing(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether any two matches of labels, which occur once on either side, are out of order."""
    place = np.full(int(max(a.max(), b.max())) + 2, -1)
    place[b] = np.arange(len(b))
    place[-1] = -1  # where there is no label
    y = place[a]
    y = y[y >= 0]
    return bool((y[1:] < y[:-1]).any())


def in_any_order(a: np.ndarray, b: np.ndarray, t: int, s: Fraction):
    """As ``in_order``, for matches in any order: of every interval in ``a``, the best one in ``b``."""
    far = len(a) // 2
    eq = ((a[:, None] == b[None, :]) & (a >= 0)[:, None]).astype(np.int32)
    gain, cost = s.numerator + s.denominator, s.numerator
    up, down = np.cumsum(eq[far::-1], axis=0), np.cumsum(np.vstack([np.zeros((1, len(b)), np.int32), eq[far + 1 :]]), axis=0)
    left, right = (lambda m: np.cumsum(m[:, far::-1], axis=1)), (lambda m: np.cumsum(np.hstack([np.zeros((len(m), 1), np.int32), m[:, far + 1 :]]), axis=1))
    ul, ur, dl, dr = left(up), right(up), left(down), right(down)
    k = np.arange(far + 1)
    some = eq.any(axis=1)
    some[far] = True
    tail = some[far:]  # passages begin and end at matches
    found = []
    for x in np.flatnonzero(some[far::-1]).tolist():
        fl, fr = gain * (ul[x] + dl) - cost * k, gain * (ur[x] + dr) - cost * k
        l, r = fl.argmax(axis=1), fr.argmax(axis=1)
        m = ul[x][l] + dl[k, l] + ur[x][r] + dr[k, r]
        ok = tail & (gain * m >= cost * (np.maximum(x + k + 1, t) + np.maximum(l + r + 1, t)))
        found += [(-x, x1, -l[x1], r[x1]) for x1 in np.flatnonzero(ok).tolist()]
    if not found:
        return None
    x0, x1, y0, y1 = zip(*found)
    return min(x0), max(x1), min(y0), max(y1)


def _first(label: np.ndarray, n: int) -> np.ndarray:
    """Places of the first ``n`` of each label."""
    order, begin, run = _runs(label)
    return order[np.arange(len(label)) - begin[run] < n]


def _join_labels(comp: np.ndarray, x: np.ndarray, y: np.ndarray) -> None:
    """Give the labels of linked places one value, the least."""
    while True:
        a, b = comp[x], comp[y]
        if (a == b).all():
            return
        low = np.arange(len(comp))
        np.minimum.at(low, np.maximum(a, b), np.minimum(a, b))
        comp[:] = low[comp]


def near_passages(group, comp, only, row, place, value, i, j, t: int, s: Fraction, far: int):
    """Of pairs (i, j) of contexts of one group, links by passages of t tokens and more whose Jaccard similarity is ``s``.

    Pairs that share enough tokens are verified best first, unless what has
    been found connects them already (``comp``, labels below the number of
    contexts, changed in place): all linked contexts end in one component, and
    each has a verified partner. Contexts of one text alone (``only``, else
    -1) are not compared with one another. Returns the verified pairs, and the first and
    last place of such passages relative to the centre, in i and in j. Bounds
    that lose nothing come first: tokens in common, wherever they stand, and
    the share of such in the intervals of either. Where all that two contexts
    have in common lies at equal places one sum over places is enough; else
    matches are chained with gaps, and where no chain is long enough taken in
    any order.
    """
    num, den = s.numerator, s.denominator
    least = -(-2 * t * num // (num + den))  # m / (2 t - m) >= s
    token, label, counts = _numbered(group, row, value)
    size = np.bincount(row, minlength=len(group))
    words = (counts + 63) >> 6
    of = words[group[i]]
    keep = (size[i] >= t) & (size[j] >= t) & (counts[group[i]] >= least) & (comp[i] != comp[j]) & ((only[i] != only[j]) | (only[i] < 0))
    i, j, of = i[keep], j[keep], of[keep]
    found: list[tuple] = []
    known = np.zeros((len(group), 2 * far + 1), bool)
    known[row, place + far] = True
    tokens_at, labels_at = np.full(known.shape, -1, np.int32), np.full(known.shape, -1, np.int32)
    tokens_at[row, place + far], labels_at[row, place + far] = token, label
    wide = words[group]
    for w in np.unique(of).tolist():
        own = np.flatnonzero(wide == w)
        nth = np.full(len(group), -1)
        nth[own] = np.arange(len(own))
        bits = np.zeros((len(own), w * 64), bool)
        some = np.flatnonzero((label >= 0) & (nth[row] >= 0))
        bits[nth[row[some]], label[some]] = True
        packed = np.packbits(bits, axis=1, bitorder="little").view(np.uint64)
        ii, jj = i[of == w], j[of == w]
        common = np.empty(len(ii), np.int64)
        step = max(64, min(PAIRS, (1 << 19) // w))
        for at in range(0, len(ii), step):
            x, y = ii[at : at + step], jj[at : at + step]
            common[at : at + step] = np.bitwise_count(packed[nth[x]] & packed[nth[y]]).sum(axis=1, dtype=np.int64)
        best = np.argsort(-common, kind="stable")
        best = best[common[best] >= least]
        ii, jj, common = ii[best], jj[best], common[best]
        n = 1
        while True:
            cross = comp[ii] != comp[jj]
            ii, jj, common = ii[cross], jj[cross], common[cross]
            if not len(ii):
                break
            pick = np.unique(np.concatenate([_first(comp[ii], n), _first(comp[jj], n)]))
            for part in range(0, len(pick), 1024):
                h = pick[part : part + 1024]
                found += _verified(ii[h], jj[h], packed[nth[ii[h]]] & packed[nth[jj[h]]], common[h], known, tokens_at, labels_at, t, s)
            rest = np.ones(len(ii), bool)
            rest[pick] = False
            ii, jj, common = ii[rest], jj[rest], common[rest]
            if found:
                x, y = (np.concatenate([np.atleast_1d(f[k]) for f in found]) for k in (0, 1))
                _join_labels(comp, x, y)
            n *= 4
    if not found:
        return (np.empty(0, np.int64),) * 6
    return tuple(np.concatenate([np.atleast_1d(c) for c in col]) for col in zip(*found))


def _verified(i, j, both, common, known, tokens_at, labels_at, t: int, s: Fraction) -> list[tuple]:
    num, den, far = s.numerator, s.denominator, known.shape[1] // 2
    for side in (0, 1):  # an interval's tokens are in the other context to a share of s
        k = (i, j)[side]
        at = labels_at[k]
        bit = np.take_along_axis(both, np.maximum(at, 0) >> 6, axis=1) >> (np.maximum(at, 0) & 63).astype(np.uint64) & np.uint64(1)
        good = (bit > 0) & (at >= 0)
        good[:, far] = True
        keep = np.flatnonzero(stretches(good, known[k], den - num, num, t)[0])
        i, j, both, common = i[keep], j[keep], both[keep], common[keep]
    out = []
    a, b = tokens_at[i], tokens_at[j]
    same = (a == b) & (a >= 0)
    same[:, far] = True
    plain = same.sum(axis=1) >= common
    if plain.any():
        good = same[plain]
        ok, begin, end = stretches(good, known[i[plain]] & known[j[plain]], den - num, 2 * num, t)
        good, begin, end, x, y = good[ok], begin[ok], end[ok], i[plain][ok], j[plain][ok]
        spot = np.arange(2 * far + 1)
        first = (good & (spot >= begin[:, None])).argmax(axis=1) - far
        last = far - (good & (spot <= end[:, None]))[:, ::-1].argmax(axis=1)
        out.append((x, y, first, last, first, last))
    for k in np.flatnonzero(~plain).tolist():
        ends = in_order(a[k], b[k], t, s)
        if not ends and crossing(x := labels_at[i[k]], y := labels_at[j[k]]):
            ends = in_any_order(x, y, t, s)
        if ends:
            out.append((i[k], j[k], *ends))
    return out


def _pairs(starts: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of all pairs within groups that lie one after another."""
    made: dict[int, tuple] = {}
    left, right = [], []
    for s, n in zip(starts.tolist(), counts.tolist()):
        if n > 1:
            if n not in made:
                made[n] = np.triu_indices(n, 1)
            left.append(made[n][0] + s)
            right.append(made[n][1] + s)
    return (np.concatenate(left), np.concatenate(right)) if left else (np.empty(0, np.int64),) * 2


def _fields(column):
    """A list<struct<cls, comp, only, left, ctx>> column: where its rows start and how long they are, and the flat fields."""
    flat = column.flatten()
    counts = column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    cls, comp, only, left, ctx = flat.flatten()
    return np.cumsum(np.append(0, counts[:-1])), counts, *(c.to_numpy(zero_copy_only=False).astype(np.int64) for c in (cls, comp, only, left)), ctx


def _bounded(batch):
    """A batch in pieces of few pairs each: a row's pairs are bounded by its blocks."""
    na, nb = (batch.column(k).value_lengths().to_numpy(zero_copy_only=False).astype(np.int64) for k in (0, 1))
    made = np.cumsum(np.where(nb == 0, na * (na - 1) // 2, na * nb) + 16)  # rows without pairs count too
    at = 0
    while at < batch.num_rows:
        done = made[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(made, done + 4 * PAIRS, side="right")))
        yield batch.slice(at, to - at)
        at = to


def _compare(batches, t: int, s: Fraction, far: int):
    """The classes with a near passage: what they link with (a forest) and where their passages are.

    A row is a block of classes of one key, or two blocks of which each class
    of the one meets each of the other; classes of one ``comp`` are known to
    be connected.
    """
    for batch in (part for whole in batches for part in _bounded(whole)):
        parts = [_fields(batch.column(k)) for k in (0, 1)]
        at = len(parts[0][2])
        cls, comp, only, left = (np.concatenate([p[k] for p in parts]) for k in (2, 3, 4, 5))
        group = np.concatenate([np.repeat(np.arange(batch.num_rows), p[1]) for p in parts])
        (row, place, value), other = (context_tokens(p[6], p[5]) for p in parts)
        row, place, value = np.append(row, other[0] + at), np.append(place, other[1]), np.append(value, other[2])
        (sa, na), (sb, nb) = parts[0][:2], parts[1][:2]
        own = nb == 0
        pairs = [_pairs(sa[own], na[own])]
        for a, n, b, k in zip(sa[~own].tolist(), na[~own].tolist(), sb[~own].tolist(), nb[~own].tolist()):
            pairs.append((np.repeat(np.arange(a, a + n), k), np.tile(np.arange(at + b, at + b + k), n)))
        comp = np.unique(np.stack([group, comp]), axis=1, return_inverse=True)[1].ravel()  # every key marks its own passages
        i, j, *ends = near_passages(group, comp, only, row, place, value, *(np.concatenate(p) for p in zip(*pairs)), t, s, far)
        low = cls.copy()
        while len(i):
            before = low.copy()
            np.minimum.at(low, i, low[j])
            np.minimum.at(low, j, low[i])
            if (low == before).all():
                break
        lo, hi = np.full(len(cls), 9999), np.full(len(cls), -9999)
        for k, first, last in ((i, *ends[:2]), (j, *ends[2:])):
            np.minimum.at(lo, k, first)
            np.maximum.at(hi, k, last)
        hit = np.flatnonzero(hi > -9999)
        kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32())
        yield pa.RecordBatch.from_arrays([pa.array(v[hit], k) for v, k in zip((cls, low, lo, hi), kinds)], names=["cls", "low", "first", "last"])


COMPARED = "cls bigint, low bigint, first int, last int"


def _blocks(rows: DataFrame) -> DataFrame:
    """``rows(key, block, cls, comp, only, left, ctx)`` as a row a block."""
    return rows.groupBy("key", "block").agg(F.collect_list(F.struct("cls", "comp", "only", "left", "ctx")).alias("x"))


def near_links(classes: DataFrame, scratch: Scratch, t: int, s: Fraction, far: int) -> DataFrame:
    """Verified links ``(cls, low, first, last)`` between the classes of each key, enough to connect all that link.

    Classes of one ``comp`` are connected by exact repeats and not compared,
    unless they hold words that no exact repeat covers (``apart``): such a
    class counts by itself, whatever its text is connected with. A
    key of more than BLOCK classes is dealt in blocks. A few of its classes,
    by hash, are in all of them, so what is alike meets through these. What is
    then not connected with the key's largest component is compared with all
    of the key's classes, in pairs of blocks dealt evenly, so the same classes
    have a near passage and the same are connected whatever BLOCK is. Keys of BLOCK rows at most (not ``many``) are one
    block without being counted.
    """
    few, many = classes.where(~F.col("many")).drop("many"), classes.where("many").drop("many")
    sizes = many.groupBy("key").agg(F.count("*").alias("m"), _salts("cls")).where("m > 1")
    sized = scratch.keep(_dealt(many, sizes, ["key"], "cls").withColumn("blocks", F.ceil(F.col("m") / BLOCK)))
    home = F.pmod(F.xxhash64("cls"), F.col("blocks"))
    hub = (F.col("blocks") > 1) & (F.pmod(F.xxhash64(F.lit(1), "cls"), F.col("m")) < HUBS)
    dealt = sized.select(
        "key", F.explode(F.when(hub, F.expr("sequence(0L, blocks - 1)")).otherwise(F.array(home))).alias("block"), "cls", "apart", "comp", "only", "left", "ctx",
    )
    dealt = dealt.unionByName(few.withColumn("block", F.lit(0).cast("bigint"))).withColumn("comp", F.when(F.col("apart"), F.col("cls")).otherwise(F.col("comp")))
    own = _blocks(dealt).where("size(x) > 1").select(F.col("x").alias("a"), F.expr("slice(x, 1, 0)").alias("b"))
    found = scratch.keep(own.mapInArrow(lambda it: _compare(it, t, s, far), COMPARED))
    wide = sized.where("blocks > 1")
    if not wide.limit(1).count():
        return found
    wide = wide.withColumn("comp", F.when(F.col("apart"), F.col("cls")).otherwise(F.col("comp")))
    bridges = _bridges(found, classes).union(_bridges(found, wide))
    nodes = components(bridges, scratch).select(F.col("node").alias("comp"), F.col("component").alias("now"))
    placed = wide.join(nodes, "comp", "left").withColumn("comp", F.coalesce("now", "comp")).drop("now")
    placed = scratch.keep(placed.withColumn("block", F.pmod(F.xxhash64("cls"), F.col("blocks"))))
    shares = placed.groupBy("key", "comp").agg(F.count("*").alias("n"))
    main = shares.groupBy("key").agg(F.max(F.struct("n", "comp")).alias("main"), F.count("*").alias("parts")).where("parts > 1").select("key", F.col("main.comp").alias("main"))
    main = scratch.keep(main.join(placed.groupBy("key").agg(_salts("cls")), "key"))
    if not main.limit(1).count():
        return found
    apart = scratch.keep(_dealt(placed, main, ["key"], "cls"))
    one = _blocks(apart.where("comp <> main")).select("key", F.col("x").alias("a"))
    two = _blocks(apart).select("key", F.col("x").alias("b"))
    cross = one.join(two, "key").select("a", "b")
    cross = scratch.keep(cross.repartition(int(scratch.spark.conf.get("spark.sql.shuffle.partitions"))))
    return found.union(scratch.keep(cross.mapInArrow(lambda it: _compare(it, t, s, far), COMPARED)))


def _bridges(links: DataFrame, classes: DataFrame) -> DataFrame:
    """Links between classes as links ``(a, b)`` between the components of their texts."""
    comps = classes.select("cls", "comp")
    pairs = links.where("cls <> low").select("cls", "low").distinct()
    return (
        pairs.join(comps.withColumnRenamed("comp", "a"), "cls")
        .join(comps.select(F.col("cls").alias("low"), F.col("comp").alias("b")), "low").select("a", "b").where("a <> b")
    )


def _merged(rows: DataFrame, passage: int) -> DataFrame:
    """``(rid, n_passages, repeated_words, spans)`` of exact repeats ``places`` and near passages ``near``; those that touch are merged."""

    def run(batches):
        for batch in batches:
            for part in slices(batch, 64):
                out: list[list] = [[], [], []]
                for exact, near in zip(part.column(1), part.column(2).to_pylist()):
                    a = exact.values.to_numpy().astype(np.int64) >> 1 if exact.is_valid else np.empty(0, np.int64)
                    b = np.append(a + passage, [x["e"] for x in near or []]).astype(np.int64)
                    a = np.append(a, [x["s"] for x in near or []]).astype(np.int64)
                    order = np.argsort(a, kind="stable")
                    a, b = a[order], np.maximum.accumulate(b[order])
                    new = np.append(True, a[1:] > b[:-1])
                    starts, ends = a[new], b[np.append(new[1:], True)]
                    out[0].append(len(starts))
                    out[1].append(int((ends - starts).sum()))
                    out[2].append(",".join(f"{x}:{y}" for x, y in zip(starts.tolist(), ends.tolist())))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), *(pa.array(c, k) for c, k in zip(out, (pa.int64(), pa.int64(), pa.string())))], names=["rid", "n_passages", "repeated_words", "spans"]
                )

    return rows.select("rid", "places", "near").mapInArrow(run, "rid bigint, n_passages bigint, repeated_words bigint, spans string")


def repeated_passages(docs: DataFrame, passage: int = PASSAGE, similarity: float = SIMILARITY, hashes: int = HASHES) -> DataFrame:
    """``(doc_id, n_passages, repeated_words, spans, component_id)`` of every row of ``docs`` that shares a passage.

    ``spans`` are the passages in words of the text, "start:end" with the end
    exclusive, those that touch merged. Words are runs of characters other
    than ASCII white space, A-Z lower-cased. ``component_id`` is the smallest
    doc_id reachable by shared passages. Exact repeats of at least ``passage``
    words are always found; texts that these do not connect are by near
    passages, of multiset Jaccard similarity
    ``similarity`` in their tokens, with the chance that two of ``hashes``
    min-hashes agree; such spans, also those next to exact repeats, are what
    has been compared to connect them. Words are compared by 16 bits around min-hashes that agree in whole.
    Null and short texts share nothing; repeats inside one row do not count;
    rows of equal words (also repeated rows) share all they have; a null
    doc_id stays and is not named by component_id; other columns are not
    read; no rows give none.
    """
    spark = docs.sparkSession
    t = passage - SHINGLE + 1
    near = Fraction(similarity).limit_denominator(1000)
    far = reach(t, near)
    with Scratch(spark) as scratch:
        texts = scratch.keep(_texts(docs, passage))
        distinct = scratch.keep(texts.where(F.col("n") >= passage).dropDuplicates(["f", "g"]).select("rid", "f", "g", "sig"))
        texts = scratch.narrow(texts, "rid", "doc_id", "f", "g", "n")
        scratch.release()
        hashed = scratch.keep(_min_hashes(distinct, passage, hashes))
        flat = hashed.select("rid", F.explode("tok").alias("tok"))
        shared = flat.groupBy("tok").agg(F.count("*").alias("texts"), _salts("rid")).where("texts > 1").drop("texts")
        owned = _dealt(flat, shared, ["tok"], "rid").groupBy("rid").agg(F.collect_list("tok").alias("toks"))
        some = scratch.keep(distinct.join(owned, "rid").select("rid", "sig", "toks"))
        scratch.discard(hashed)
        ids = scratch.narrow(distinct, "rid", "f", "g")
        scratch.release()
        # exact repeats: no pairs, a hash for each passage; the first text that has a passage stands for it
        windows = scratch.keep(_passages(some, passage, hashes))
        twice = windows.groupBy("h", "tok").agg(F.min("rid").alias("low"), F.max("rid").alias("high"), _salts("rid")).where("low < high").drop("high")
        places = (F.col("at") * 2 + (F.col("low") == F.col("rid")).cast("int")).alias("place")
        exact = _dealt(windows, twice, ["h", "tok"], "rid").select("rid", "low", places)
        exact = scratch.keep(exact.groupBy("rid").agg(F.collect_list("place").alias("places"), F.collect_set("low").alias("lows")))
        scratch.discard(windows)
        scratch.release()
        least = F.array_min("lows")
        stars = exact.select(F.col("rid").alias("a"), least.alias("b")).union(exact.select(F.explode("lows").alias("a"), least.alias("b")))
        nodes = scratch.keep(components(stars, scratch).withColumnRenamed("node", "rid").withColumnRenamed("component", "comp"))
        # near passages: joint windows that two components have, and those that hold what a component's exact repeats
        # leave out, there with one text that is exact if any is
        placed = some.join(nodes, "rid", "left").withColumn("comp", F.coalesce("comp", "rid")).join(exact.select("rid", "places"), "rid", "left")
        joint = scratch.keep(_joint_windows(placed, passage, hashes, far))
        wanted = joint.groupBy("key").agg(
            F.min("comp").alias("c0"), F.max("comp").alias("c1"),
            F.min("mark").alias("m0"), F.max("mark").alias("m1"), F.min("rid").alias("r0"), F.max("rid").alias("r1"), F.count("*").alias("rows"), _salts("rid"),
        )
        wanted = wanted.where((F.col("r0") < F.col("r1")) & ((F.col("c0") < F.col("c1")) | (F.col("m1") >= REST)))
        wanted = wanted.select("key", (F.col("c0") < F.col("c1")).alias("cross"), F.pmod("m0", F.lit(REST)).alias("first"), "rows", "salts")
        wins = _dealt(joint, wanted, ["key"], "rid").where(F.col("cross") | (F.col("mark") >= REST) | (F.col("rid") == F.col("first")))
        apart = (~F.col("cross") | (F.col("mark") >= REST)).alias("apart")
        wins = wins.groupBy("rid", "comp").agg(F.collect_list(F.struct("key", (F.col("rows") > BLOCK).alias("many"), apart, "lo", "c", "hi")).alias("wins"))
        members = scratch.keep(_contexts(some.select("rid", "sig").join(wins, "rid")).withColumn("cls", F.xxhash64("key", "left", "ctx")))
        scratch.discard(joint)
        scratch.discard(some)
        scratch.release()
        classes = members.groupBy("cls", "key", "many", "left", "ctx").agg(  # cls stands for the others
            F.max("apart").alias("apart"), F.min("comp").alias("comp"),
            F.when(F.min("rid") == F.max("rid"), F.min("rid")).otherwise(-1).alias("only"), _salts("rid"),
        )
        classes = scratch.keep(classes)
        members = scratch.narrow(members, "rid", "c", "cls")
        scratch.release()
        links = near_links(classes.drop("salts"), scratch, t, near, far)
        good = links.groupBy("cls").agg(F.min("first").alias("first"), F.max("last").alias("last")).join(classes.select("cls", "salts"), "cls")
        spots = _dealt(members, good, ["cls"], "rid").select("rid", (F.col("c") + F.col("first")).alias("s"), (F.col("c") + F.col("last") + SHINGLE).alias("e"))
        spots = spots.groupBy("rid").agg(F.collect_set(F.struct("s", "e")).alias("near"))
        spans = scratch.keep(_merged(exact.select("rid", "places").join(spots, "rid", "full"), passage))
        joined = components(_bridges(links, classes), scratch).select(F.col("node").alias("comp"), F.col("component"))
        found = spans.join(ids, "rid").join(nodes, "rid", "left").withColumn("comp", F.coalesce("comp", "rid"))
        found = found.join(joined, "comp", "left").withColumn("component", F.coalesce("component", "comp")).drop("comp")
        # texts for rows: equal texts are one node, and share all they have where they are several rows
        copies = texts.where(F.col("n") >= passage).groupBy("f", "g").agg(
            F.min("doc_id").alias("low"), F.count("*").alias("rows"), F.min("n").alias("n"), _salts("rid")
        )
        found = copies.join(found, ["f", "g"], "left").where("rows > 1 OR rid IS NOT NULL")
        whole = F.col("rows") > 1
        found = scratch.keep(found.select(
            "f", "g", "salts", "low", "component", F.when(whole, 1).otherwise(F.col("n_passages")).cast("bigint").alias("n_passages"),
            F.when(whole, F.col("n")).otherwise(F.col("repeated_words")).cast("bigint").alias("repeated_words"),
            F.when(whole, F.concat(F.lit("0:"), "n")).otherwise(F.col("spans")).alias("spans"),
        ))
        least_id = scratch.keep(found.where("component IS NOT NULL").groupBy("component").agg(F.min("low").alias("component_id")))
        found = found.join(least_id, "component", "left").withColumn("component_id", F.coalesce("component_id", "low"))
        out = _dealt(texts.select("rid", "doc_id", "f", "g"), found.drop("low", "component"), ["f", "g"], "rid")
        return scratch.result(out.select("doc_id", "n_passages", "repeated_words", "spans", "component_id"))
