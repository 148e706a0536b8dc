"""Conversation structure repair at least cost.

A conversation is wanted to read ``(system? (user assistant)+)?``. A backward
pass computes, for every row and grammar state, the cost to go; a forward walk
then takes, among the edits that keep to that cost, the one whose initial comes
first: Delete, Insert, Keep, Rerole. Rows are dealt out in order over ranges.
A conversation that lies within one range is repaired there; of one that
crosses ranges, or is long, every piece tells what each pair of states costs
across it, and pieces are repaired once the chain of these says what comes
after them and in which state they begin.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import Scratch, pieces

#: Costs of edits, and what a truncated row that stays adds (fixed values).
DELETE, INSERT, REROLE, TRUNCATED = 3, 2, 2, 1
#: Grammar states, 0 before all turns, and the state after a user's or an assistant's turn that fits.
SYSTEM, USER, ASSISTANT = 1, 2, 3
NEXT = (USER, USER, ASSISTANT, USER)
FITS = ((SYSTEM, USER), (USER,), (ASSISTANT,), (USER,))
NAMES = {USER: "user", ASSISTANT: "assistant"}
KINDS = {"s": SYSTEM, "u": USER, "a": ASSISTANT}
LEGAL = {(SYSTEM, USER), (USER, ASSISTANT), (ASSISTANT, USER)}
#: Faults of a row, in the order in which they count.
FINE, CUT, GOES = 0, 1, 2
FAR = 1 << 60
#: White space (fixed values); rows and characters of a piece at most, one row at least; bytes of texts read in one go.
SPACES = " \t\n\v\f\r"
PIECE_ROWS, PIECE_CHARS, PART = 512, 1 << 16, 1 << 20


def closed(costs) -> tuple[int, ...]:
    """Costs to go if turns may be inserted first."""
    out = list(costs)
    for _ in range(3):
        for s in range(4):
            out[s] = min(out[s], INSERT + out[NEXT[s]], FAR)
    return tuple(out)


#: At the end of a conversation nothing or a whole exchange may stand.
END = closed((0, FAR, FAR, 0))


def _relative(costs) -> tuple[tuple[int, ...], int]:
    low = min(costs)
    return tuple(c - low if c < FAR else FAR for c in costs), low


@lru_cache(maxsize=1 << 16)
def before(kind: int, fault: int, after: tuple[int, ...]):
    """Costs to go before a row, relative to the least; that; and for each state the edits up to the row and the state after it.

    ``after`` are relative costs after the row. There are few of them, so a
    long conversation looks up almost every step.
    """
    extra = TRUNCATED if fault == CUT else 0
    base = []
    for s in range(4):
        ways = [DELETE + after[s]]
        if fault != GOES:
            ways.append(REROLE + extra + after[NEXT[s]])
            if kind in FITS[s]:
                ways.append(extra + after[kind])
        base.append(min(min(ways), FAR))
    costs = closed(base)
    moves = []
    for s in range(4):
        edits, at = "", s
        while costs[s] < FAR and edits[-1:] not in ("D", "K", "R"):
            if DELETE + after[at] == costs[at]:
                edits += "D"
            elif INSERT + costs[NEXT[at]] == costs[at]:
                edits, at = edits + "I", NEXT[at]
            elif fault != GOES and kind in FITS[at] and extra + after[kind] == costs[at]:
                edits, at = edits + "K", kind
            else:
                edits, at = edits + "R", NEXT[at]
        moves.append((edits, at))
    relative, low = _relative(costs)
    return relative, low, tuple(moves)


def backward(rows, end):
    """Costs to go before all rows ``(kind, fault, copies)``, and each row's moves. Copies beyond the first have to go."""
    (costs, total), moves = _relative(end), []
    for kind, fault, n in reversed(rows):
        total += DELETE * (n - 1)
        costs, low, own = before(kind, fault, costs)
        total += low
        moves.append(own)
    moves.reverse()
    return tuple(c + total if c < FAR else FAR for c in costs), moves


def walk(rows, moves, state: int):
    """``(edits, state)`` for each row on the way from ``state``; copies beyond the first are deleted."""
    for (_, _, n), own in zip(rows, moves):
        edits, state = own[state]
        yield edits, state, n - 1


def ending(state: int) -> str:
    """Turns to insert at the end."""
    return "I" * (END[state] // INSERT)


def across(rows) -> list[int]:
    """What each pair of states costs from before the rows to after them, row by row of a matrix."""
    columns = [backward(rows, tuple(0 if t == s else FAR for t in range(4)))[0] for s in range(4)]
    return [columns[t][s] for s in range(4) for t in range(4)]


def rebuilt(entries, rows, moves, state: int, last: bool):
    """Audit, turns and end state of a piece walked from ``state``."""
    audit, turns, at = [], [], state
    for (role, text), (edits, after, more) in zip(entries, walk(rows, moves, state)):
        audit.append(edits + "D" * more)
        for e in edits:
            if e == "I":
                at = NEXT[at]
                turns.append({"role": NAMES[at], "text": ""})
            elif e == "R":
                turns.append({"role": NAMES[after], "text": text})
            elif e == "K":
                turns.append({"role": role, "text": text})
        at = after
    if last:
        audit.append(ending(at))
        for _ in audit[-1]:
            at = NEXT[at]
            turns.append({"role": NAMES[at], "text": ""})
    return "".join(audit), turns, at


def damaged(rows: DataFrame) -> DataFrame:
    """``(conv_id, turn, role, text, n)`` of conversations damaged in a reproducible way, n copies of a row.

    By crc32 of ``conv_id:turn`` modulo 20: 0 drops a row (it keeps a
    conversation's name with n = 0), 1 empties its text, 2 removes full stops,
    3 repeats it, 4 makes it a user's. Nulls in what is hashed, in roles and
    in texts are one space.
    """
    name = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    k = F.pmod(F.crc32(F.concat(name("conv_id"), F.lit(":"), name("turn")).cast("binary")), F.lit(20))
    rows = rows.select(F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"), name("role").alias("role"), name("text").alias("text"), k.alias("_k"))
    text = F.when(F.col("_k") == 1, "").when(F.col("_k") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    gone = F.col("_k") == 0
    return rows.select(
        "conv_id", F.when(~gone, F.col("turn")).alias("turn"), F.when(gone, "").when(F.col("_k") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(gone, "").otherwise(text).alias("text"), F.when(gone, 0).when(F.col("_k") == 3, 2).otherwise(1).cast("bigint").alias("n"),
    )


def in_order(rows: DataFrame) -> DataFrame:
    """Different rows once, with how many copies there are and whether role and text came in an earlier turn, dealt out in order.

    Of equal turns the role and then the text decide, so copies are neighbours.
    """
    named = ["conv_id", "turn", "role", "text"]
    once = rows.groupBy(*named).agg(F.sum("n").alias("n")).withColumn("d", F.md5(F.concat("role", F.lit("\x00"), "text")))
    first = once.where("n > 0").groupBy(F.col("conv_id").alias("_c"), F.col("d").alias("_d")).agg(F.min(F.struct("turn")).alias("_first"))
    seen = once.join(first, F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("d") == F.col("_d")), "left")
    seen = seen.select(*named, "n", F.coalesce(~F.struct("turn").eqNullSafe(F.col("_first")), F.lit(False)).alias("again"))
    return seen.repartitionByRange("conv_id", "turn", "role", F.substring("text", 1, 256)).sortWithinPartitions(*named)


MADE = "cost bigint, audit string, turns array<struct<role: string, text: string>>"
SCHEMA = (
    f"conv_id bigint, part bigint, open boolean, n bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, head int, tail int, low bigint, high bigint, n_turns bigint, {MADE},"
    " entries array<struct<role: string, text: string>>, codes array<int>, copies array<bigint>, matrix array<bigint>"
)


_TURN = pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))
_LONGS = ["n", "blank", "duplicate", "truncated", "illegal"]
_TYPES = pa.schema(
    [("conv_id", pa.int64()), ("part", pa.int64()), ("open", pa.bool_()), *((c, pa.int64()) for c in _LONGS), ("head", pa.int32()), ("tail", pa.int32()), ("low", pa.int64()), ("high", pa.int64()), ("n_turns", pa.int64())]
    + [("cost", pa.int64()), ("audit", pa.string()), ("turns", _TURN), ("entries", _TURN), ("codes", pa.list_(pa.int32())), ("copies", pa.list_(pa.int64())), ("matrix", pa.list_(pa.int64()))]
)


class Piece:
    """Rows of one conversation that follow one another, and what is counted of them."""

    def __init__(self, conv):
        self.conv, self.entries, self.rows, self.chars, self.n_turns = conv, [], [], 0, 0
        self.counts = dict.fromkeys(_LONGS, 0)
        self.head = self.tail = self.low = self.high = None

    def add(self, turn, role: str, text: str, n: int, again: bool) -> None:
        if not n:
            return
        body = text.rstrip(SPACES)
        kind, more, c = KINDS.get(role[:1], 0), n - 1, self.counts
        fault = GOES if not body or again else FINE if body[-1] in ".!?" else CUT
        c["n"] += n
        if not body:
            c["blank"] += n
        else:
            c["duplicate"] += more + again
            c["truncated"] += fault == CUT
        c["illegal"] += more + (self.tail is not None and (self.tail, kind) not in LEGAL)
        self.head, self.tail = kind if self.head is None else self.head, kind
        if turn is not None:
            self.n_turns += turn != self.high
            self.low, self.high = turn if self.low is None else self.low, turn
        self.entries.append((role, text))
        self.rows.append((kind, fault, n))
        self.chars += len(text) + len(role)

    def full(self) -> bool:
        return len(self.rows) >= PIECE_ROWS or self.chars >= PIECE_CHARS

    def record(self, part: int, is_open: bool) -> dict:
        out = {"conv_id": self.conv, "part": part, "open": is_open, **self.counts, "head": self.head, "tail": self.tail, "low": self.low, "high": self.high, "n_turns": self.n_turns}
        if is_open:
            return out | {
                "entries": [{"role": r, "text": t} for r, t in self.entries], "codes": [3 * k + f for k, f, _ in self.rows],
                "copies": [n for _, _, n in self.rows], "matrix": across(self.rows),
            }
        costs, moves = backward(self.rows, END)
        audit, turns, _ = rebuilt(self.entries, self.rows, moves, 0, True)
        return out | {"cost": costs[0], "audit": audit, "turns": turns}


def _cut(batches):
    """Pieces of the sorted rows of a range: conversations that are whole here are repaired, others left open."""
    part, done, size = TaskContext.get().partitionId() << 33, [], 0
    piece, first, split = None, True, False
    for batch in batches:
        for own in pieces(batch, 3, PART):
            for conv, turn, role, text, n, again in zip(*(own.column(k).to_pylist() for k in range(6))):
                if piece is None:
                    piece = Piece(conv)
                elif piece.conv != conv:
                    done.append(piece.record(part, first or split))
                    part, first, split, size, piece = part + 1, False, False, size + piece.chars, Piece(conv)
                elif piece.full():
                    done.append(piece.record(part, True))
                    part, split, size, piece = part + 1, True, size + piece.chars, Piece(conv)
                piece.add(turn, role, text, n, again)
            if size >= PART or len(done) >= 4096:
                yield pa.RecordBatch.from_pylist(done, schema=_TYPES)
                done, size = [], 0
    if piece is not None:
        done.append(piece.record(part, True))
    yield pa.RecordBatch.from_pylist(done, schema=_TYPES)


def _rows_of(codes, copies):
    return [(c // 3, c % 3, n) for c, n in zip(codes, copies)]


def _by_conversation(batches):
    """Rows of sorted Arrow batches as dictionaries, with whether a conversation begins."""
    last, any_yet = None, False
    for batch in batches:
        for own in (batch.slice(at, 1024) for at in range(0, batch.num_rows, 1024)):
            for r in own.to_pylist():
                yield r, not any_yet or r["conv_id"] != last
                last, any_yet = r["conv_id"], True


def _batched(rows, types, size: int = 1024):
    out = []
    for r in rows:
        out.append(r)
        if len(out) >= size:
            yield pa.RecordBatch.from_pylist(out, schema=types)
            out = []
    yield pa.RecordBatch.from_pylist(out, schema=types)


_AFTER = pa.schema([("conv_id", pa.int64()), ("part", pa.int64()), ("last", pa.bool_()), ("after", pa.list_(pa.int64()))])
_STEP = pa.schema([*_AFTER, ("to", pa.list_(pa.int32()))])
_START = pa.schema([("part", pa.int64()), ("last", pa.bool_()), ("after", pa.list_(pa.int64())), ("state", pa.int32())])


def _costs_after(batches):
    """Last pieces first: what a conversation costs after each piece, by state."""
    def rows():
        costs = END
        for r, begins in _by_conversation(batches):
            costs = END if begins else costs
            yield {"conv_id": r["conv_id"], "part": r["part"], "last": begins, "after": list(costs)}
            m = r["matrix"]
            costs = tuple(min(min(m[4 * s + t] + costs[t] for t in range(4)), FAR) for s in range(4))

    return _batched(rows(), _AFTER)


def _steps(batches):
    """In which state a piece ends for each that it may begin in."""
    def rows():
        for r, _ in _by_conversation(batches):
            own = _rows_of(r["codes"], r["copies"])
            costs, moves = backward(own, tuple(r["after"]))
            to = [0] * 4  # states that cannot come to an end are never begun in
            for s in range(4):
                to[s] = s
                for _, at, _ in walk(own, moves, s) if costs[s] < FAR else ():
                    to[s] = at
            yield {"conv_id": r["conv_id"], "part": r["part"], "last": r["last"], "after": r["after"], "to": to}

    return _batched(rows(), _STEP)


def _starts(batches):
    """First pieces first: the state that each begins in."""
    def rows():
        state = 0
        for r, begins in _by_conversation(batches):
            state = 0 if begins else state
            yield {"part": r["part"], "last": r["last"], "after": r["after"], "state": state}
            state = r["to"][state]

    return _batched(rows(), _START)


def _finished(batches):
    kept = _TYPES.names[:13]

    def rows():
        for r, _ in _by_conversation(batches):
            own = _rows_of(r["codes"], r["copies"])
            costs, moves = backward(own, tuple(r["after"]))
            audit, turns, at = rebuilt([(e["role"], e["text"]) for e in r["entries"]], own, moves, r["state"], r["last"])
            yield {c: r[c] for c in kept} | {"cost": costs[r["state"]] - (0 if r["last"] else r["after"][at]), "audit": audit, "turns": turns}

    return _batched(rows(), pa.schema([_TYPES.field(c) for c in _TYPES.names[:16]]), 64)


def repaired(rows: DataFrame, scratch: Scratch) -> DataFrame:
    """``(conv_id, part, ..., cost, audit, turns)``: the pieces of all conversations, ``part`` saying their order.

    ``rows(conv_id, turn, role, text, n)`` as ``damaged`` gives them. Pieces
    have ``PIECE_ROWS`` different rows at most; the chains along a
    conversation that is in several carry four numbers a piece.
    """
    found = scratch.keep(in_order(rows).mapInArrow(_cut, SCHEMA))
    names = _TYPES.names[:16]
    left = found.where("open")
    after = left.select("conv_id", "part", "matrix").repartition("conv_id").sortWithinPartitions(F.asc("conv_id"), F.desc("part"))
    after = scratch.keep(after.mapInArrow(_costs_after, "conv_id bigint, part bigint, last boolean, after array<bigint>"))
    steps = left.select("part", "codes", "copies").join(after, "part").mapInArrow(_steps, "conv_id bigint, part bigint, last boolean, after array<bigint>, to array<int>")
    starts = steps.repartition("conv_id").sortWithinPartitions("conv_id", "part").mapInArrow(_starts, "part bigint, last boolean, after array<bigint>, state int")
    ended = left.drop("matrix", "cost", "audit", "turns").join(starts, "part")
    kind = SCHEMA.partition(" entries")[0].rstrip(", ")
    return found.where("not open").select(*names).unionByName(ended.mapInArrow(_finished, kind))


def repair_conversations(rows: DataFrame) -> DataFrame:
    """``(conv_id, part, position, role, text)``: the turns of all conversations after the cheapest repair.

    ``rows(conv_id, turn, role, text)``: turns by number, null first, ties by
    role and text; null roles and texts are one space; rows with a null
    conv_id are one conversation; of repeated rows all but the first go;
    other columns are not read. A conversation that nothing is left of has no
    rows here.
    """
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c)
    with Scratch(rows.sparkSession) as scratch:
        own = rows.select(F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"), text("role"), text("text"), F.lit(1).cast("bigint").alias("n"))
        return scratch.result(repaired(own, scratch).select("conv_id", "part", F.posexplode("turns").alias("position", "t")).select("conv_id", "part", "position", "t.role", "t.text"))


_DIGEST = pa.schema([("conv_id", pa.int64()), *((c, pa.int64()) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")), ("audit", pa.string()), ("repaired_sha256", pa.string())])


def _digests(batches):
    """A row for each conversation from its pieces in order; of texts only a digest is held."""
    def rows():
        out = None
        for r, begins in _by_conversation(batches):
            if begins:
                if out is not None:
                    yield done(out)
                out = dict.fromkeys(("blank", "duplicate", "truncated", "illegal", "cost", "n_turns"), 0) | {"conv_id": r["conv_id"], "low": None, "high": None, "tail": None, "audit": [], "sha": hashlib.sha256(), "lines": 0}
            for c in ("blank", "duplicate", "truncated", "illegal", "cost", "n_turns"):
                out[c] += r[c]
            if r["head"] is not None:
                out["illegal"] += out["tail"] is not None and (out["tail"], r["head"]) not in LEGAL
                out["tail"] = r["tail"]
            if r["low"] is not None:
                out["n_turns"] -= r["low"] == out["high"]
                out["low"], out["high"] = r["low"] if out["low"] is None else out["low"], r["high"]
            out["audit"].append(r["audit"])
            for t in r["turns"]:
                out["sha"].update(f"{chr(10) * (out['lines'] > 0)}{t['role']}:{t['text']}".encode())
                out["lines"] += 1
        if out is not None:
            yield done(out)

    def done(out):
        gaps = 0 if out["low"] is None else out["high"] - out["low"] + 1 - out["n_turns"]
        return {c: out[c] for c in ("conv_id", "blank", "duplicate", "truncated", "illegal", "cost")} | {"gaps": gaps, "audit": "".join(out["audit"]), "repaired_sha256": out["sha"].hexdigest()}

    return _batched(rows(), _DIGEST)


def repair_digests(rows: DataFrame) -> DataFrame:
    """``(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256)`` of ``rows`` as ``damaged`` gives them.

    A row for each conv_id, a null one too; those without rows have zeros, an
    empty audit and the digest of nothing. No rows give none. A digest needs
    its conversation in one order, so a task reads all its pieces, but holds
    one batch of them at a time.
    """
    with Scratch(rows.sparkSession) as scratch:
        found = repaired(rows, scratch).select("conv_id", "part", "blank", "duplicate", "truncated", "illegal", "head", "tail", "low", "high", "n_turns", "cost", "audit", "turns")
        kind = "conv_id bigint, gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string, repaired_sha256 string"
        return scratch.result(found.repartition("conv_id").sortWithinPartitions("conv_id", "part").mapInArrow(_digests, kind))
