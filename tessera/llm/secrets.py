"""Secret scans: rules, and novelty under a dictionary-primed compressor.

Rules find what looks like a secret by form. Beside them, every string that
stands near a word like "credential" is a candidate: it is compressed within
the text around it, by a compressor primed with the corpus's common
identifiers, and again without it. What the candidate adds in bytes is what
neither its surroundings nor the dictionary explain; strings that stay almost
incompressible are reported.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import Scratch, pieces

#: Kinds in the order in which they are listed; the last is the method's (fixed values).
KINDS = ("assign", "access", "hex", "novel")
#: Rules (fixed values): a pattern, which group is measured, and how long that has to be.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
RULES = ((ASSIGN, 2, 8), (re.compile(r"AKIA[A-Z0-9]+"), 0, 16), (re.compile(r"[0-9a-f]{32,}"), 0, 32))
#: Bytes without which the first two rules cannot match, in lower case (fixed values).
NEEDED = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")
#: Words that make what follows within ``REACH`` characters a candidate (fixed values).
SENSITIVE = ("access", "apikey", "auth", "bearer", "cert", "credential", "key", "passphrase", "passwd", "password", "private", "pwd", "salt", "secret", "session", "signature", "token")
REACH = 48
#: A candidate: at least 16 characters of keys and encodings; of digits, small and capital letters two have so many at least.
CANDIDATE, MIXED = re.compile(r"(?<![A-Za-z0-9+/_.=-])[A-Za-z0-9+/_.=-]{16,}"), 2
#: Characters around a candidate that it is compressed with, on either side.
AROUND = 256
#: Bytes that a candidate has to add, and bits for each of its characters.
LEAST_BYTES, LEAST_BITS = 12, 5.0
#: The dictionary: bytes of the most frequent identifiers of the corpus, how often they occur at least, their length, and the compression level.
DICTIONARY_BYTES, COMMON, SHORTEST, LONGEST, LEVEL = 1 << 16, 20, 4, 32, 9
#: Bytes of text worked on in one go.
PART = 1 << 21
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123), 95]] = True


def base_spans(text: str, low: bytes | None = None) -> list[tuple[int, int, int]]:
    """``(start, kind, end)`` of the rules' matches, in order; matches that are too short are dropped and not tried again."""
    low = text.encode().lower() if low is None else low
    out = []
    for kind, (pattern, group, least) in enumerate(RULES):
        if kind == 0 and not any(w in low for w in NEEDED) or kind == 1 and b"akia" not in low:
            continue
        out += [(m.start(), kind, m.end()) for m in pattern.finditer(text) if m.end(group) - m.start(group) >= least]
    return sorted(out)


def candidates(text: str, low: bytes, taken: list[tuple[int, int, int]]):
    """``(start, end)`` of strings in a sensitive context that no rule's match touches."""
    if not any(w.encode() in low for w in SENSITIVE):
        return
    k, far = 0, -1
    for m in CANDIDATE.finditer(text):
        while k < len(taken) and taken[k][0] < m.end():
            far, k = max(far, taken[k][2]), k + 1
        if far > m.start():
            continue
        near = text[max(0, m.start() - REACH) : m.start()].lower()
        if any(w in near for w in SENSITIVE) and sum(sum(map(f, m[0])) >= MIXED for f in (str.isdigit, str.islower, str.isupper)) > 1:
            yield m.span()


class Novelty:
    """What strings add to the compressed size of their surroundings. A worker makes one."""

    def __init__(self, identifiers: bytes):
        self.compressor = zstandard.ZstdCompressor(
            level=LEVEL, dict_data=self._dictionary(identifiers), write_content_size=False, write_checksum=False, write_dict_id=False
        )

    @staticmethod
    def _dictionary(identifiers: bytes):
        if len(identifiers) < 8:  # the library takes no shorter one
            return None
        d = zstandard.ZstdCompressionDict(identifiers, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        d.precompute_compress(level=LEVEL)
        return d

    def added(self, text: str, start: int, end: int) -> int:
        """Marginal bytes of a part of a text. What repeats it nearby does not explain it."""
        own = text[start:end]
        before, after = text[max(0, start - AROUND) : start].replace(own, ""), text[end : end + AROUND].replace(own, "")
        size = lambda s: len(self.compressor.compress(s.encode()))
        return size(before + own + after) - size(before + after)

    def reported(self, text: str, start: int, end: int) -> bool:
        added = self.added(text, start, end)
        return added >= LEAST_BYTES and 8 * added >= LEAST_BITS * (end - start)


def identifier_counts(docs: DataFrame) -> DataFrame:
    """``(word, n)``: every run of letters and underscores of ``SHORTEST`` to ``LONGEST`` bytes in all texts, and how often it occurs."""

    def run(batches):
        for batch in batches:
            for part in pieces(batch, 0, PART):
                data = np.frombuffer("\n".join(part.column(0).to_pylist()).encode(), np.uint8)
                edge = np.diff(_LETTER[data].astype(np.int8), prepend=0, append=0)
                starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
                size = ends - starts
                keep = (size >= SHORTEST) & (size <= LONGEST)
                starts, size = starts[keep], size[keep]
                offsets = np.append(0, np.cumsum(size)).astype(np.int32)
                chars = data[np.repeat(starts - offsets[:-1], size) + np.arange(offsets[-1])]
                found = pc.value_counts(pa.StringArray.from_buffers(len(size), pa.py_buffer(offsets), pa.py_buffer(chars)))
                yield pa.RecordBatch.from_arrays([found.field("values"), found.field("counts").cast(pa.int64())], names=["word", "n"])

    texts = docs.select(F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return texts.mapInArrow(run, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


def identifier_dictionary(docs: DataFrame, size: int = DICTIONARY_BYTES, common: int = COMMON) -> bytes:
    """The corpus's most frequent identifiers, the most frequent last, in at most ``size`` bytes; each occurs ``common`` times at least.

    All texts are counted. How many identifiers there are of each magnitude
    says from which one on they have room, so that only about as many as fit
    come to the driver, however many tasks there are.
    """
    most = size // (SHORTEST + 1)
    with Scratch(docs.sparkSession) as scratch:
        counts = scratch.keep(identifier_counts(docs).where(F.col("n") >= common))
        steps = counts.groupBy(F.floor(F.log2("n") * 16).alias("step")).agg(F.count("*").alias("words"), F.min("n").alias("least")).orderBy(F.desc("step")).collect()
        least, room = common, most
        for r in steps:
            least, room = r["least"], room - r["words"]
            if room <= 0:
                break
        rows = counts.where(F.col("n") >= least).orderBy(F.desc("n"), "word").limit(most).collect()
    out, left = [], size
    for r in rows:
        left -= len(r["word"]) + 1
        if left < 0:
            break
        out.append(r["word"].encode())
    return b" ".join(reversed(out))


def scan(docs: DataFrame, dictionary: bytes | None = None) -> DataFrame:
    """``(doc_id, found)`` of every row: ``found(kind, start, end, added)`` by start and kind, in code points.

    ``added`` are the marginal bytes of a novel string, null for a rule's.
    Reads doc_id and text, texts whole; a null text is empty; repeated rows
    are scanned each; a null doc_id stays; other columns are not read. Without
    a dictionary one is made from all of ``docs``. No rows give none.
    """
    dictionary = identifier_dictionary(docs) if dictionary is None else dictionary
    kind = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("added", pa.int64())])

    def run(batches):
        novelty = Novelty(dictionary)
        for batch in batches:
            for part in pieces(batch, 1, PART):
                out = []
                for text in part.column(1).to_pylist():
                    low = text.encode().lower()
                    rules = base_spans(text, low)
                    novel = [(a, 3, b) for a, b in candidates(text, low, rules) if novelty.reported(text, a, b)]
                    out.append([
                        {"kind": KINDS[k], "start": a, "end": b, "added": novelty.added(text, a, b) if k == 3 else None} for a, k, b in sorted(rules + novel)
                    ])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(out, pa.list_(kind))], names=["doc_id", "found"])

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return rows.mapInArrow(run, "doc_id bigint, found array<struct<kind: string, start: bigint, end: bigint, added: bigint>>")


def secret_digests(scanned: DataFrame) -> DataFrame:
    """``(doc_id, n_assign, n_access, n_hex, n_novel, base_sha256, spans)``; counts and digest are of the rules' spans, ``spans`` of all."""
    joined = lambda c: F.array_join(F.transform(c, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    own = lambda k: F.filter("found", lambda x: x["kind"] == k)
    counts = [F.size(own(k)).cast("bigint").alias(f"n_{k}") for k in KINDS]
    base = F.filter("found", lambda x: x["kind"] != KINDS[-1])
    return scanned.select("doc_id", *counts, F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"), joined(F.col("found")).alias("spans"))
