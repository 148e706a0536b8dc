"""SentencePiece encoding and decoding with an Aho-Corasick automaton.

The automaton over all pieces reads a text once. At every position its output
links name the pieces that end there, and each relaxes the best way to reach
the position:

* unigram models add up piece scores (the Viterbi recurrence proper);
* BPE models have no additive score. Their encoding of a prefix is the encoding
  of a shorter prefix plus one last piece, and a piece may follow another only
  if the merge rules leave the two alone, so exactly one of the pieces ending
  at a position relaxes it. The pass, the links and the table are the same.

No piece crosses from a character to a following space mark, so a text falls
into words whose encodings are independent; they are remembered in a bounded
table. Results equal the public library's for the same model file.
"""

from __future__ import annotations

import re
import struct

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import slices

SPACE = "▁"
MODEL = "/opt/tokenizers/piece_bpe_32k.model"

#: Piece types, model types and the penalty of the unknown piece (fixed values of the format).
NORMAL, UNKNOWN, CONTROL, USER, BYTE, UNUSED = 1, 2, 3, 4, 6, 5
UNIGRAM, BPE = 1, 2
UNKNOWN_PENALTY = 10.0

#: Words whose encodings, and pairs of pieces whose verdicts, a worker remembers.
REMEMBERED, PAIRS = 1 << 18, 1 << 19
MODEL_BYTES = 64 << 20


def _fields(data: bytes):
    """The (number, value) pairs of a serialised message, values as int or bytes."""
    at = 0

    def varint(at):
        out = shift = 0
        while True:
            b = data[at]
            at += 1
            out |= (b & 127) << shift
            if b < 128:
                return out, at
            shift += 7

    while at < len(data):
        tag, at = varint(at)
        kind = tag & 7
        if kind == 0:
            value, at = varint(at)
        elif kind == 2:
            n, at = varint(at)
            value, at = data[at : at + n], at + n
        else:
            n = {1: 8, 5: 4}[kind]
            value, at = data[at : at + n], at + n
        yield tag >> 3, value


class Model:
    """A model file's pieces and the automaton over them.

    Models that normalise texts by rules of their own are refused: only
    identity normalisation is implemented, with or without the dummy prefix.
    """

    def __init__(self, data: bytes):
        self.pieces, self.scores, self.types = [], [], []
        self.kind, self.prefix, self.byte_fallback = UNIGRAM, True, False
        squeeze = True
        for number, value in _fields(data):
            if number == 1:
                piece = dict(_fields(value))
                self.pieces.append(piece[1].decode())
                self.scores.append(struct.unpack("<f", piece.get(2, b"\0\0\0\0"))[0])
                self.types.append(piece.get(3, NORMAL))
            elif number == 2:
                spec = dict(_fields(value))
                self.kind = spec.get(3, UNIGRAM)
                self.byte_fallback = bool(spec.get(35, 0))
            elif number == 3:
                spec = dict(_fields(value))
                self.prefix, squeeze = bool(spec.get(3, 1)), bool(spec.get(4, 1))
                if spec.get(2) or not spec.get(5, 1):
                    raise ValueError("only identity normalisation is implemented")
        if squeeze or self.kind not in (UNIGRAM, BPE):
            raise ValueError("only unigram and BPE models that keep white space are implemented")
        if USER in self.types:
            raise ValueError("user-defined pieces are not implemented")
        self.unknown = self.types.index(UNKNOWN)
        self.bytes = {int(p[3:5], 16): i for i, (p, t) in enumerate(zip(self.pieces, self.types)) if t == BYTE}
        self.ids = {p: i for i, (p, t) in enumerate(zip(self.pieces, self.types)) if t == NORMAL and p}
        self.worst = min(self.scores[i] for i in self.ids.values()) - UNKNOWN_PENALTY
        self.whole = any(SPACE in p.lstrip(SPACE) for p in self.ids)  # a piece may cross words
        self.automaton = ahocorasick.Automaton()
        for p, i in self.ids.items():
            self.automaton.add_word(p, (i, len(p)))
        self.automaton.make_automaton()
        self.single = {p for p in self.ids if len(p) == 1}
        # id 0 stands for the start of a word in self.pairs, which needs that no piece of texts has it
        self.count = len(self.pieces) if 0 not in self.ids.values() else None
        self.surfaces = [self.surface(i) for i in range(len(self.pieces))]
        # no piece crosses into a run of space marks, nor, for most models, touches a line's end
        line = "" if any("\n" in p for p in self.ids) else "\n"
        self.words = re.compile(f"{SPACE}+[^{SPACE}{line}]*|[^{SPACE}{line}]+" + (f"|{line}+" if line else ""))
        self.seen: dict[str, tuple] = {}  # the words met lately, and those met before them
        self.older: dict[str, tuple] = {}
        self.pairs: dict[int, bool] = {}

    def merged(self, text: str) -> list[str]:
        """The pieces that the merge rules make of a text: best score first, then leftmost."""
        parts = list(text)
        while True:
            best, at = None, -1
            for k in range(len(parts) - 1):
                i = self.ids.get(parts[k] + parts[k + 1])
                if i is not None and (best is None or self.scores[i] > best):
                    best, at = self.scores[i], k
            if at < 0:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def fits(self, a: str, b: str) -> bool:
        """Whether the merge rules leave piece a before piece b alone; a may be empty."""
        return self.merged(a + b) == ([a, b] if a else [b])

    def word(self, text: str) -> tuple:
        """The ids of a text's pieces by one pass of the automaton."""
        if self.count and self.kind == BPE and self.single.issuperset(text):
            return self.bpe(text)
        n = len(text)
        last: list = [None] * (n + 1)  # (id, length) of the piece that ends here; id -1: unknown
        best = [0.0] + [-np.inf] * n
        ends: list[list] = [[] for _ in range(n)]
        for at, found in self.automaton.iter(text):
            ends[at].append(found)
        for at in range(n):
            single = False
            for i, size in ends[at]:
                single |= size == 1
                start = at + 1 - size
                if self.kind == BPE:
                    before = text[start - last[start][1] : start] if start else ""
                    if last[at + 1] is None and self.fits(before, text[start : at + 1]):
                        last[at + 1] = (i, size)
                elif (score := best[start] + self.scores[i]) > best[at + 1]:
                    best[at + 1], last[at + 1] = score, (i, size)
            if last[at + 1] is None or not single and best[at] + self.worst > best[at + 1] and self.kind == UNIGRAM:
                best[at + 1], last[at + 1] = best[at] + self.worst, (-1, 1)
        out, at = [], n
        while at:
            i, size = last[at]
            if i >= 0:
                out.append(i)
            elif self.byte_fallback:
                out += [self.bytes[b] for b in reversed(text[at - 1].encode())]
            elif not out or out[-1] != self.unknown:
                out.append(self.unknown)
            at -= size
        return tuple(reversed(out))

    def bpe(self, text: str) -> tuple:
        """``word`` for a BPE model and a text whose characters are all pieces; the hot path."""
        n = len(text)
        ids, starts, done = [0] * (n + 1), [0] * (n + 1), -1
        pairs, count = self.pairs, self.count
        verdict = pairs.get
        for at, (i, size) in self.automaton.iter(text):
            if at == done:
                continue  # the longest that fits is the only one that does
            start = at + 1 - size
            pair = ids[start] * count + i
            ok = verdict(pair)
            if ok is None:
                if len(pairs) > PAIRS:
                    pairs.clear()
                ok = pairs[pair] = self.fits(self.pieces[ids[start]] if start else "", self.pieces[i])
            if ok:
                done = at
                ids[at + 1], starts[at + 1] = i, start
        out = []
        while n:
            out.append(ids[n])
            n = starts[n]
        out.reverse()
        return tuple(out)

    def encode(self, text: str) -> list[int]:
        if not text:
            return []
        text = (SPACE if self.prefix else "") + text.replace(" ", SPACE)
        if self.whole:
            return list(self.word(text))
        out: list[int] = []
        seen, older = self.seen, self.older
        for w in self.words.findall(text):
            ids = seen.get(w)
            if ids is None:
                ids = older.get(w)
                if ids is None:
                    ids = self.word(w)
                if len(w) <= 64:
                    if len(seen) >= REMEMBERED:
                        self.seen, self.older = seen, older = {}, seen
                    seen[w] = ids
            out += ids
        return out

    def surface(self, i: int) -> bytes:
        if self.types[i] == BYTE:
            return bytes([int(self.pieces[i][3:5], 16)])
        if self.types[i] == UNKNOWN:
            return " ⁇ ".encode()
        return b"" if self.types[i] == CONTROL else self.pieces[i].replace(SPACE, " ").encode()

    def decode(self, ids) -> str:
        """The text of ids; unknown ids read as the library's unknown surface, control ids as nothing."""
        text = b"".join(map(self.surfaces.__getitem__, ids)).decode("utf-8", "replace")
        return text[1:] if self.prefix and text.startswith(" ") else text


def read_model(spark: SparkSession, path: str = MODEL) -> bytes:
    """A model file's bytes, read by Spark so that any store serves."""
    row = spark.read.format("binaryFile").load(path if "://" in path else f"file://{path}").select("length", "content").first()
    if row["length"] > MODEL_BYTES:
        raise ValueError("the model is too large to be sent to every executor")
    return bytes(row["content"])


def encode(docs: DataFrame, model: str = MODEL, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, n_tokens, ids, decoded_sha256, lossless)`` of every row.

    ``ids`` are a text's piece ids without sentence marks; a null or empty text
    has none. ``lossless`` says whether decoding the ids gives the text again,
    which fails only for texts that hold the space mark U+2581 itself, as in
    the library. Rows are independent: repeated rows repeat, a null key stays,
    other columns are not read, no rows give none.
    """
    data = read_model(docs.sparkSession, model)

    def run(batches):
        import hashlib

        m = Model(data)
        for batch in batches:
            for part in slices(batch, 64):
                texts = [t or "" for t in part.column(1).to_pylist()]
                ids = [np.array(m.encode(t), np.int32) for t in texts]
                back = [m.decode(i.tolist()) for i in ids]
                offsets = np.cumsum([0, *map(len, ids)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0),
                        pa.array([len(i) for i in ids], pa.int64()),
                        pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(ids) if ids else np.empty(0, np.int32))),
                        pa.array([hashlib.sha256(b.encode()).hexdigest() for b in back]),
                        pa.array([a == b for a, b in zip(texts, back)]),
                    ],
                    names=["doc_id", "n_tokens", "ids", "decoded_sha256", "lossless"],
                )

    rows = docs.select(F.col(key).cast("bigint").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id bigint, n_tokens bigint, ids array<int>, decoded_sha256 string, lossless boolean")


def decode(encoded: DataFrame, model: str = MODEL) -> DataFrame:
    """``(doc_id, text)`` of every row of ``encoded(doc_id, ids)``; null ids give an empty text."""
    data = read_model(encoded.sparkSession, model)

    def run(batches):
        m = Model(data)
        for batch in batches:
            for part in slices(batch):
                texts = [m.decode(i or []) for i in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id bigint, text string")
