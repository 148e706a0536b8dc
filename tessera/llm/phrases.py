"""Phrase collocations by suffix sorting.

Every word begins a suffix of its piece, cut after ``LONGEST`` words. Suffixes
are dealt out and sorted by language, first word and the words after it, so
that all phrases with one beginning stand together, the longest first; one pass
with a stack of open prefixes counts them all. Ranges that part a prefix give
its count in parts, which are joined afterwards, so a hot word is split like
any other. Scores then come from joins of the counts alone.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import Scratch, pieces

#: Words of a phrase at most, occurrences of a candidate at least, rows of a language's report.
LONGEST, LEAST, TOP = 4, 30, 2000
#: A candidate goes if a longer one around it has so many hundredths of its occurrences; units of a score.
SHARE, UNIT = 80, 2_000_000
#: Bytes of text whose suffixes are made, and counted where they repeat, in one go.
PART = 1 << 21
#: Between the language and the words of a key; sorts before all else, as texts with it are escaped.
SEP = "\x00"
#: What bytes are: of a word, between words, between pieces (fixed values).
_KIND = np.zeros(256, np.uint8)
_KIND[[0x20, 0x09]] = 1
_KIND[[*b".,;:!?\n\v\f\r"]] = 2
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def _escaped(raw: bytes) -> bytes:
    """Without ``SEP``, in the same order and to be told apart."""
    if b"\x00" in raw or b"\x01" in raw:
        raw = raw.replace(b"\x01", b"\x01\x02").replace(b"\x00", b"\x01\x01")
    return raw


def _unescaped(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("\x01\x01"), F.lit("\x00")), F.lit("\x01\x02"), F.lit("\x01"))


def suffixes(texts: list[bytes], langs: list[bytes]) -> pa.Array:
    """A key for every word of the texts: its language, itself and up to three words after it in its piece."""
    data = np.frombuffer(b"\n".join(texts), np.uint8)
    kind = _KIND[data]
    word = kind == 0
    edge = np.diff(word.astype(np.int8), prepend=0, append=0)
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    n = len(starts)
    if not n:
        return pa.array([], pa.string())
    offsets = np.append(0, np.cumsum(ends - starts)).astype(np.int32)
    words = pa.StringArray.from_buffers(n, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data[word])))
    piece = np.cumsum(kind == 2)[starts]
    first = np.cumsum([0, *(len(t) + 1 for t in texts[:-1])])
    own = pa.array(langs, pa.binary()).cast(pa.string()).take(pa.array(np.searchsorted(first, starts, side="right") - 1))
    parts = [own, words]
    for k in range(1, LONGEST):
        at = np.arange(k, n + k)
        far = np.minimum(at, n - 1)
        parts.append(words.take(pa.array(at, mask=(at >= n) | (piece[far] != piece))))
    return pc.binary_join_element_wise(*parts, SEP, null_handling="skip")


def _suffix_rows(batches):
    for batch in batches:
        for part in pieces(batch, 0, PART):
            langs = [_escaped(x.encode()) for x in part.column(1).to_pylist()]
            texts = [_escaped(x.encode().translate(_LOWER)) for x in part.column(0).to_pylist()]
            found = pc.value_counts(suffixes(texts, langs))
            yield pa.RecordBatch.from_arrays([found.field("values"), found.field("counts").cast(pa.int64())], names=["key", "c"])


class OpenPrefixes:
    """The stack: for each depth the prefix that the last key ended in and what it has counted so far.

    Keys come in order, so a prefix is complete once a key departs from it.
    Whole batches are compared at a time: where neighbours share fewer words
    than a depth has, a run of that depth ends.
    """

    def __init__(self, least: int):
        self.least, self.last, self.first = least, None, True
        self.count = [0] * (LONGEST + 1)
        self.begun = [True] * (LONGEST + 1)  # open since the first key, so perhaps begun in the range before

    @staticmethod
    def _ends(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """For each key, where its first 1, 2 ... words end; -1 where it has fewer."""
        out = np.full((len(offsets) - 1, LONGEST + 1), -1, np.int64)
        gaps = np.flatnonzero(data == 0)
        row = np.searchsorted(offsets, gaps, side="right") - 1
        nth = np.arange(len(gaps)) - np.searchsorted(gaps, offsets[:-1])[row]
        out[row, nth] = gaps
        lengths = np.bincount(row, minlength=len(out))
        out[np.arange(len(out)), lengths] = offsets[1:]
        return out

    def push(self, keys: list[bytes] | pa.Array, counts: np.ndarray):
        """The prefixes that are complete now, as lists of keys and counts."""
        n = len(counts)
        lead = [self.last] if self.last is not None else []
        both = pa.concat_arrays([pa.array(lead, pa.binary()), keys.cast(pa.binary())]) if lead else keys.cast(pa.binary())
        offsets = np.frombuffer(both.buffers()[1], np.int32)[both.offset : both.offset + len(both) + 1].astype(np.int64)
        data = np.frombuffer(both.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
        offsets = offsets - offsets[0]
        ends = self._ends(data, offsets)
        size = np.diff(offsets)
        # bytes that neighbours share: places in the later key up to the shorter one's end
        least = np.minimum(size[1:], size[:-1])
        total = np.append(0, np.cumsum(least))
        inside = np.arange(total[-1]) - np.repeat(total[:-1], least)
        differ = data[np.repeat(offsets[1:-1], least) + inside] != data[np.repeat(offsets[:-2], least) + inside]
        where = np.flatnonzero(differ)
        nth = np.searchsorted(where, total[:-1])
        shared = least.copy()
        some = nth < len(where)
        hit = np.full(len(least), -1)
        hit[some] = where[nth[some]]
        real = some & (hit < total[1:])
        shared[real] = hit[real] - total[:-1][real]
        keys_out, counts_out = [], []
        raw = data.tobytes()
        for k in range(LONGEST + 1):
            depth = ends[:, k] - offsets[:-1]
            have = ends[:, k] >= 0
            same = have[1:] & have[:-1] & (depth[1:] == depth[:-1]) & (shared >= depth[1:])
            same = same if lead else np.append(False, same)
            own, offset = have[len(lead) :], len(lead)
            begins = np.flatnonzero(~same)  # rows of the batch that begin a run
            closing = []
            if len(begins) == 0:
                self.count[k] += int(counts.sum())
                continue
            head = int(counts[: begins[0]].sum()) + self.count[k]
            if lead and self.last_has[k] and (head >= self.least or k == 0 or self.begun[k]):
                closing.append((0, head))
            sums = np.add.reduceat(counts, begins)
            inner = np.flatnonzero(own[begins[:-1]] & ((sums[:-1] >= self.least) | (k == 0) | (self.first & (begins[:-1] == 0))))
            closing += [(int(begins[i]) + offset, int(sums[i])) for i in inner]
            for row, c in closing:
                keys_out.append(raw[offsets[row] : ends[row, k]])
                counts_out.append(c)
            self.count[k] = int(sums[-1])
            self.begun[k] = self.first and begins[-1] == 0
        self.last = both[-1].as_py()
        self.last_has = ends[-1] >= 0
        self.last_ends = ends[-1] - offsets[-2]
        self.first = self.first and n == 0
        return keys_out, counts_out

    def close(self):
        """What is open at the end: perhaps it goes on in the next range."""
        if self.last is None:
            return [], []
        found = [(self.last[: self.last_ends[k]], self.count[k]) for k in range(LONGEST + 1) if self.last_has[k]]
        return [k for k, _ in found], [c for _, c in found]


def _counted(least: int):
    def run(batches):
        stack = OpenPrefixes(least)
        out = lambda ks, cs: pa.RecordBatch.from_arrays([pa.array(ks, pa.binary()).cast(pa.string()), pa.array(cs, pa.int64())], names=["key", "c"])
        for batch in batches:
            if batch.num_rows:
                yield out(*stack.push(batch.column(0), batch.column(1).to_numpy()))
        yield out(*stack.close())

    return run


def phrase_counts(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """``(key, c)``: occurrences of every language (its words), and of every word and phrase that has ``least``.

    A key is the language and the words, ``SEP`` between them.
    """
    col = lambda c: F.col(c).cast("string") if c in docs.columns else F.lit(None).cast("string")
    rows = docs.select(F.coalesce(col("text"), F.lit("")).alias("text"), F.coalesce(col("lang"), F.lit("und")).alias("lang"))
    found = rows.mapInArrow(_suffix_rows, "key string, c bigint")
    dealt = found.repartitionByRange("key").sortWithinPartitions(F.desc("key"))
    parts = dealt.mapInArrow(_counted(least), "key string, c bigint")
    return parts.groupBy("key").agg(F.sum("c").alias("c")).where((F.col("c") >= least) | (F.instr("key", SEP) == 0))


def collocations(docs: DataFrame, least: int = LEAST, top: int = TOP, share: int = SHARE) -> DataFrame:
    """``(lang, rank, phrase, a, l, r, n, score)``: each language's ``top`` phrases of two to ``LONGEST`` words.

    ``a`` counts the phrase, ``l`` and ``r`` the two parts of its worst cut,
    ``n`` all words of the language; the score is the floor of
    ``UNIT * a / (l + r)``. A phrase inside a longer candidate that has
    ``share`` percent of its occurrences goes. Reads text and lang, whole; a
    null text is empty, a null lang is ``und``; repeated rows count each;
    a language without candidates has no rows, and no documents give none.
    """
    with Scratch(docs.sparkSession) as scratch:
        counts = scratch.keep(phrase_counts(docs, least))
        words = F.split("key", SEP)
        every = counts.select("key", "c", words.alias("w"))
        sizes = every.where(F.size("w") == 1).select(F.col("key").alias("lang"), F.col("c").alias("n"))
        cand = every.where(F.size("w") >= 3).select(F.element_at("w", 1).alias("lang"), "key", F.col("c").alias("a"), F.slice("w", 2, LONGEST).alias("w"))
        joined = lambda w: F.concat(F.col("lang"), F.lit(SEP), F.array_join(w, SEP))
        cuts = cand.select("lang", "key", "a", "w", F.explode(F.sequence(F.lit(1), F.size("w") - 1)).alias("k"))
        cuts = cuts.select(
            "lang", "key", "a", "k", joined(F.slice("w", F.lit(1), F.col("k"))).alias("left"), joined(F.slice("w", F.col("k") + 1, F.size("w") - F.col("k"))).alias("right")
        )
        count = lambda key, name: counts.select(F.col("key").alias(key), F.col("c").alias(name))
        score = F.expr(f"(CAST(a AS DECIMAL(20, 0)) * CAST({UNIT} AS DECIMAL(7, 0))) div (CAST(l AS DECIMAL(20, 0)) + CAST(r AS DECIMAL(20, 0)))")
        scored = cuts.join(count("left", "l"), "left").join(count("right", "r"), "right").withColumn("score", score)
        worst = scored.groupBy("lang", "key", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("m")).select("lang", "key", "a", "m.l", "m.r", "m.score")
        spans = F.flatten(F.transform(F.sequence(F.lit(2), F.size("w") - 1), lambda m: F.transform(F.sequence(F.lit(1), F.size("w") - m + 1), lambda i: F.slice("w", i, m))))
        inside = cand.where(F.size("w") > 2).select("lang", "a", F.explode(spans).alias("s")).groupBy(joined(F.col("s")).alias("key")).agg(F.max("a").alias("around"))
        covered = F.expr(f"CAST(around AS DECIMAL(20, 0)) * 100 >= CAST(a AS DECIMAL(20, 0)) * {share}")
        left = worst.join(inside, "key", "left").where(F.col("around").isNull() | ~covered)
        phrase = _unescaped(F.replace(F.substring(F.col("key"), F.length("lang") + 2, F.length("key")), F.lit(SEP), F.lit(" ")))
        order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
        ranked = left.select("lang", phrase.alias("phrase"), "a", "l", "r", "score").withColumn("rank", F.row_number().over(order).cast("bigint")).where(F.col("rank") <= top)
        out = ranked.join(sizes, "lang").select(_unescaped(F.col("lang")).alias("lang"), "rank", "phrase", "a", "l", "r", "n", "score")
        return scratch.result(out)
