"""Media columns: ISO base media files, written, walked and described.

A file is a tree of boxes. The walker follows nested boxes, decodes the sample
tables and reports codec, duration and the byte ranges of the key frames,
without touching the payload; ``payload`` then reads the samples themselves.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import slices

#: A sample is one grey frame of 24 x 24 8-bit samples; timing and table layout (fixed values).
SIDE, FRAME = 24, 576
TIMESCALE, TICKS, KEY_EVERY, CHUNK = 12800, 512, 12, 8

#: Boxes that hold boxes (fixed values of the format).
CONTAINERS = {b"moov", b"trak", b"mdia", b"minf", b"stbl", b"dinf", b"edts", b"udta", b"mvex", b"moof", b"traf"}


def box(kind: bytes, *parts: bytes) -> bytes:
    body = b"".join(parts)
    return struct.pack(">I4s", len(body) + 8, kind) + body


def full(kind: bytes, *parts: bytes, flags: int = 0) -> bytes:
    return box(kind, struct.pack(">I", flags), *parts)


MATRIX = struct.pack(">9I", 0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)


def write_file(payload: bytes) -> bytes:
    """A file with one track of raw grey frames whose samples are ``payload``, a multiple of FRAME."""
    n = len(payload) // FRAME
    if n * FRAME != len(payload) or not n:
        raise ValueError("the payload must be a positive multiple of the frame size")
    chunks = -(-n // CHUNK)
    large = len(payload) > (1 << 32) - (1 << 20)
    ftyp = box(b"ftyp", b"isom", struct.pack(">I", 512), b"isomiso2")
    duration = n * TICKS

    def moov(first: int) -> bytes:
        offsets = first + np.arange(chunks, dtype=np.int64) * CHUNK * FRAME
        keys = np.arange(1, n + 1, KEY_EVERY)
        runs = [(1, CHUNK)] if n % CHUNK == 0 else [(1, n)] if chunks == 1 else [(1, CHUNK), (chunks, n % CHUNK)]
        entry = box(b"raw ", bytes(6), struct.pack(">H", 1), bytes(16), struct.pack(">HHIIIH", SIDE, SIDE, 72 << 16, 72 << 16, 0, 1), bytes(32), struct.pack(">Hh", 8, 40))
        stbl = box(
            b"stbl",
            full(b"stsd", struct.pack(">I", 1), entry),
            full(b"stts", struct.pack(">III", 1, n, TICKS)),
            full(b"stss", struct.pack(">I", len(keys)), keys.astype(">u4").tobytes()),
            full(b"stsc", struct.pack(">I", len(runs)), *(struct.pack(">III", a, b, 1) for a, b in runs)),
            full(b"stsz", struct.pack(">II", FRAME, n)),
            full(b"co64", struct.pack(">I", chunks), offsets.astype(">u8").tobytes()) if large
            else full(b"stco", struct.pack(">I", chunks), offsets.astype(">u4").tobytes()),
        )
        minf = box(b"minf", full(b"vmhd", bytes(8), flags=1), box(b"dinf", full(b"dref", struct.pack(">I", 1), full(b"url ", flags=1))), stbl)
        mdia = box(b"mdia", full(b"mdhd", struct.pack(">IIIIHH", 0, 0, TIMESCALE, duration & 0xFFFFFFFF, 0x55C4, 0)), full(b"hdlr", bytes(4), b"vide", bytes(12), b"frames\0"), minf)
        tkhd = full(b"tkhd", struct.pack(">IIIII", 0, 0, 1, 0, duration & 0xFFFFFFFF), bytes(16), MATRIX, struct.pack(">II", SIDE << 16, SIDE << 16), flags=3)
        mvhd = full(b"mvhd", struct.pack(">IIIIIH", 0, 0, TIMESCALE, duration & 0xFFFFFFFF, 0x10000, 0x100), bytes(10), MATRIX, bytes(24), struct.pack(">I", 2))
        return box(b"moov", mvhd, box(b"trak", tkhd, mdia))

    head = 16 if large else 8
    first = len(ftyp) + len(moov(0)) + head
    mdat = struct.pack(">I4sQ", 1, b"mdat", len(payload) + 16) if large else struct.pack(">I4s", len(payload) + 8, b"mdat")
    return b"".join((ftyp, moov(first), mdat, payload))


def walk(data, start: int = 0, end: int | None = None, path: str = ""):
    """``(path, body start, body end)`` of every box, parents first. A damaged size raises ValueError."""
    at, end = start, len(data) if end is None else end
    while at + 8 <= end:
        size, kind = struct.unpack_from(">I4s", data, at)
        head = 8
        if size == 1:
            size, head = struct.unpack_from(">Q", data, at + 8)[0], 16
        elif size == 0:
            size = end - at
        if size < head or at + size > end:
            raise ValueError(f"box {kind!r} at {at} reaches outside its parent")
        name = f"{path}/{kind.decode('latin-1')}"
        yield name, at + head, at + size
        if kind in CONTAINERS:
            yield from walk(data, at + head, at + size, name)
        at += size


def tracks(data) -> list[dict]:
    """Codec, timing and sample places of each track, from the tables alone."""
    out: list[dict] = []
    for path, a, b in walk(data):
        kind = path.rpartition("/")[2]
        if kind == "trak":
            out.append({})
        if not out:
            continue
        t = out[-1]
        u32 = lambda at, n: np.frombuffer(data[at:b], ">u4", n).astype(np.int64)  # noqa: E731  never past its box
        if kind == "mdhd":
            v = data[a]
            t["timescale"], t["duration"] = struct.unpack_from(">IQ" if v else ">II", data, a + (20 if v else 12))
        elif kind == "hdlr":
            t["handler"] = bytes(data[a + 8 : a + 12]).decode("latin-1")
        elif kind == "stsd":
            t["codec"] = bytes(data[a + 12 : a + 16]).decode("latin-1")
        elif kind in ("stts", "stsc"):
            width = 2 if kind == "stts" else 3
            t[kind] = u32(a + 8, int(u32(a + 4, 1)[0]) * width).reshape(-1, width)
        elif kind in ("stss", "stco"):
            t[kind] = u32(a + 8, int(u32(a + 4, 1)[0]))
        elif kind == "co64":
            t["stco"] = np.frombuffer(data[a + 8 : b], ">u8", int(u32(a + 4, 1)[0])).astype(np.int64)
        elif kind == "stsz":
            size, n = u32(a + 4, 2).tolist()
            if size and n * size > len(data):
                raise ValueError(f"{n} samples of {size} bytes are more than the file has")
            t["sizes"] = np.full(n, size, np.int64) if size else u32(a + 12, n)
    for t in out:
        t["offsets"] = _offsets(t.pop("stsc"), t.pop("stco"), t["sizes"])
        n = len(t["sizes"])
        t["ticks"] = int((t["stts"][:, 0] * t.pop("stts")[:, 1]).sum())
        t["keys"] = np.arange(n) if "stss" not in t else t.pop("stss") - 1
    return out


def _offsets(runs, chunks, sizes) -> np.ndarray:
    """Where each sample starts: its chunk's place and the samples before it in the chunk."""
    until = np.append(runs[1:, 0], len(chunks) + 1)
    if (until < runs[:, 0]).any() or until.max() > len(chunks) + 1 or (runs[:, 1] * (until - runs[:, 0])).sum() != len(sizes):
        raise ValueError("the chunk table does not fit the samples")
    per_chunk = np.repeat(runs[:, 1], until - runs[:, 0])
    chunk = np.repeat(np.arange(len(chunks)), per_chunk)[: len(sizes)]
    ends = np.cumsum(sizes)
    first = np.cumsum(np.append(0, per_chunk[:-1]))
    return chunks[chunk] + (ends - sizes) - (ends - sizes)[np.minimum(first, len(sizes) - 1)][chunk]


def payload(data, track: dict) -> bytes:
    """The samples of a track in order; neighbours are read together."""
    a, n = track["offsets"], track["sizes"]
    if not len(a) or len(a) != len(n) or a.min() < 0 or (a + n).max() > len(data):
        raise ValueError("a sample lies outside the file")
    cut = np.flatnonzero(a[1:] != a[:-1] + n[:-1]) + 1
    starts, stops = np.append(0, cut), np.append(cut, len(a))
    return b"".join(data[a[i] : a[j - 1] + n[j - 1]] for i, j in zip(starts, stops))


def describe(track: dict) -> str:
    """Codec, duration, samples and key frame byte ranges in short, the ranges as a digest."""
    k = track["keys"]
    ranges = np.stack([track["offsets"][k], track["offsets"][k] + track["sizes"][k]], axis=1)
    digest = hashlib.sha256(ranges.astype(">u8").tobytes()).hexdigest()[:16]
    seconds = track["duration"] / track["timescale"]
    return f"codec={track['codec'].strip()};handler={track['handler']};seconds={seconds:.3f};samples={len(track['sizes'])};keys={len(k)};first={ranges[0][0]}-{ranges[0][1]};last={ranges[-1][0]}-{ranges[-1][1]};ranges={digest}"


def pad(text: str | None) -> tuple[bytes, int]:
    raw = (text or "").encode()
    return raw + b"\xff" * (max(1, -(-len(raw) // FRAME)) * FRAME - len(raw)), len(raw)


def media_column(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, n_bytes, media)``: every row's text stored in a media file of its own.

    The UTF-8 bytes are filled up with 255 to whole frames, at least one; null
    texts are empty. Equal texts give equal files. Rows are independent:
    repeated rows repeat, a null key stays, other columns are not read.
    """

    def run(batches):
        for batch in batches:
            for part in slices(batch, 64):
                padded = [pad(t) for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([n for _, n in padded], pa.int64()), pa.array([write_file(p) for p, _ in padded], pa.binary())],
                    names=["doc_id", "n_bytes", "media"],
                )

    rows = docs.select(F.col(key).cast("bigint").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id bigint, n_bytes bigint, media binary")


INFO = (
    "codec string, handler string, seconds double, samples bigint, keyframes array<struct<start: bigint, end: bigint>>,"
    " payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string"
)


def media_info(media: DataFrame) -> DataFrame:
    """The first track of every file in ``media(doc_id, n_bytes, media)``, with digests of what is read back.

    A null file, or one without a track or with damaged boxes or tables, has
    nulls.
    """

    def info(data):
        try:
            return described(data)
        except (IndexError, KeyError, ValueError, OverflowError, ZeroDivisionError, RecursionError, struct.error, TypeError):
            return (None,) * 11

    def described(data):
        t = tracks(data)[0]
        got = payload(data, t)
        k = t["keys"]
        keys = [{"start": int(a), "end": int(a + n)} for a, n in zip(t["offsets"][k], t["sizes"][k])]
        return (t["codec"].strip(), t["handler"], t["duration"] / t["timescale"], len(t["sizes"]), keys, len(got),
                hashlib.sha256(got).hexdigest(), zlib.crc32(got[-32:]), len(data), hashlib.sha256(data).hexdigest(), describe(t))

    names = [x.split()[0] for x in ("codec handler seconds samples keyframes payload_bytes payload_sha256 tail_crc32 media_bytes media_sha256 feature").split()]
    types = [pa.string(), pa.string(), pa.float64(), pa.int64(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])),
             pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]

    def run(batches):
        for batch in batches:
            for part in slices(batch, 64):
                rows = list(zip(*map(info, part.column(2).to_pylist()))) or [()] * len(names)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), *(pa.array(list(c), t) for c, t in zip(rows, types))], names=["doc_id", "n_bytes", *names]
                )

    return media.select("doc_id", "n_bytes", "media").mapInArrow(run, f"doc_id bigint, n_bytes bigint, {INFO}")
