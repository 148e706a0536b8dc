"""Conversation repair against trying every edit, whole and cut into pieces."""

from __future__ import annotations

import hashlib
import itertools
import random
import re
import zlib
from functools import cache

import pytest

from tessera.llm import queries, repair

NAMED = {"u": "user", "a": "assistant"}
COLUMNS = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def faults(rows):
    out = []
    for k, (role, text) in enumerate(rows):
        body = re.sub(r"[\x20\x09-\x0D]", "", text)
        out.append("blank" if not body else "duplicate" if (role, text) in rows[:k] else "truncated" if body[-1] not in ".!?" else "")
    return out


def every_repair(rows, inserts=3):
    """The best ``(cost, audit, turns)`` of all edit sequences, by trying them."""
    bad, found = faults(rows), []
    options = []
    for (role, text), f in zip(rows, bad):
        own = [("D", 3, None)]
        if f not in ("blank", "duplicate"):
            more = int(f == "truncated")
            own += [("K", more, (role, text)), *(("R", 2 + more, (n, text)) for n in NAMED.values())]
        options.append(own)
    puts = [p for k in range(inserts + 1) for p in itertools.product(NAMED.values(), repeat=k)]
    for edits in itertools.product(*options):
        for gaps in itertools.product(puts, repeat=len(rows) + 1):
            if sum(map(len, gaps)) > inserts:
                continue
            audit, cost, turns = "", 2 * sum(map(len, gaps)), []
            for g, e in itertools.zip_longest(gaps, edits):
                audit += "I" * len(g)
                turns += [(n, "") for n in g]
                if e:
                    audit, cost = audit + e[0], cost + e[1]
                    turns += [e[2]] if e[2] else []
            if all(r for r, _ in turns) and re.fullmatch("(s?(ua)+)?", "".join(r[0] for r, _ in turns)):
                found.append((cost, audit, turns))
    return min(found)


def best_repair(rows):
    """The same by recursion over rows and states, for longer conversations."""
    bad = faults(rows)
    follow = {"": "su", "s": "u", "u": "a", "a": "u"}

    @cache
    def go(i, state, put):
        ways = []
        if i == len(rows) and state in ("", "a"):
            ways.append((0, "", ()))
        step = lambda cost, edit, turn, to: ways.append((to[0] + cost, edit + to[1], turn + to[2]))
        if put < 3:
            n = follow[state][-1]
            step(2, "I", ((NAMED[n], ""),), go(i, n, put + 1))
        if i < len(rows):
            role, text = rows[i]
            step(3, "D", (), go(i + 1, state, 0))
            if bad[i] in ("", "truncated"):
                more = int(bad[i] == "truncated")
                if role[:1] and role[0] in follow[state]:
                    step(more, "K", ((role, text),), go(i + 1, role[0], 0))
                n = follow[state][-1]
                step(2 + more, "R", ((NAMED[n], text),), go(i + 1, n, 0))
        return min(ways) if ways else (10**9, "", ())

    for i in range(len(rows), -1, -1):  # from the end, so that no call goes deep
        for state in follow:
            go(i, state, 0)
    return go(0, "", 0)


def expected(conv, rows):
    """A row of the digests from ``(turn, role, text)`` after damage, in order."""
    turns = [t for t, _, _ in rows if t is not None]
    own = [(r, x) for _, r, x in rows]
    bad = faults(own)
    pairs = [a[0][:1] + b[0][:1] for a, b in itertools.pairwise(own)]
    cost, audit, out = best_repair(own)
    sha = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in out).encode()).hexdigest()
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    return (conv, gaps, *(bad.count(f) for f in ("blank", "duplicate", "truncated")), sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, sha)


def damage(rows):
    """The contract's damage, by conversation."""
    out = {}
    for conv, turn, role, text in rows:
        name = lambda v: " " if v is None else str(v)
        k, role, text = zlib.crc32(f"{name(conv)}:{name(turn)}".encode()) % 20, name(role), name(text)
        own = out.setdefault(conv, [])
        if k:
            text = "" if k == 1 else re.sub("[.!?]", "", text) if k == 2 else text
            own += [(turn, "user" if k == 4 else role, text)] * (2 if k == 3 else 1)
    return {c: sorted(own, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode())) for c, own in out.items()}


def test_every_edit_of_short_conversations():
    rng = random.Random(2)
    texts = ["Yes.", "yes", "", " \t", "No!", "Why? "]
    for _ in range(40):
        rows = [(rng.choice(["system", "user", "assistant", "tool", ""]), rng.choice(texts)) for _ in range(rng.randrange(4))]
        cost, audit, turns = every_repair(rows)
        assert best_repair(rows) == (cost, audit, tuple(turns)), rows
        piece = repair.Piece(1)
        for k, (r, t) in enumerate(rows):
            piece.add(k, r, t, 1, (r, t) in rows[:k])
        got = piece.record(0, False)
        assert (got["cost"], got["audit"], [(t["role"], t["text"]) for t in got["turns"]]) == (cost, audit, turns), rows


@pytest.fixture(scope="module")
def odd():
    rng = random.Random(9)
    texts = ["Yes.", "yes", "", " \n", None, "No!", "Why? ", "a\nb.", "é?", "so"]
    rows = []
    for conv in [None, *range(60)]:
        n = rng.choice([1, 2, 3, 5, 8, 13]) if conv != 7 else 400
        for k in range(n):
            turn = rng.choice([k, k, k, k + 3, None]) if conv != 7 else k // 2
            own = rng.choices(["system", "user", "assistant", None, "", "tool"], weights=[2, 9, 9, 1, 1, 1])[0], rng.choice(texts) if rng.random() < 0.5 else f"t{rng.randrange(30)}."
            rows += [(conv, turn, *own)] * rng.choice([1, 1, 1, 1, 1, 4])
    rows += [(8, 1, "user", "x" * 70_000 + "!"), (8, 2, "assistant", "y" * 70_000), (8, 3, "user", "x" * 70_000 + "!")] + [(99, 0, "assistant", "same")] * 500
    return rows


@pytest.mark.parametrize("piece_rows, parts", [(512, 4), (3, 7), (1, 2)])
def test_digests_of_awkward_conversations(spark, odd, monkeypatch, piece_rows, parts):
    monkeypatch.setattr(repair, "PIECE_ROWS", piece_rows)
    df = spark.createDataFrame([(*r, "z", 5) for r in odd], "conv_id bigint, turn bigint, role string, text string, audit string, part int").repartition(parts)
    got = repair.repair_digests(repair.damaged(df))
    assert got.columns == COLUMNS
    want = sorted((expected(c, rows) for c, rows in damage(odd).items()), key=str)
    assert sorted(map(tuple, got.collect()), key=str) == want
    if piece_rows == 3:
        assert repair.repair_digests(repair.damaged(df.limit(0))).count() == 0


def test_pieces_chain(spark, odd, monkeypatch):
    """Turns come out the same from a whole conversation and from pieces of it."""
    df = spark.createDataFrame(odd, "conv_id bigint, turn bigint, role string, text string")
    read = lambda: [(r.conv_id, r.role, r.text) for r in repair.repair_conversations(df).orderBy("conv_id", "part", "position").collect()]
    whole = read()
    monkeypatch.setattr(repair, "PIECE_ROWS", 2)
    assert read() == whole and len(whole) > 300
    for conv in {c for c, _, _ in whole}:
        assert re.fullmatch("s?(ua)+", "".join(r[0] for c, r, _ in whole if c == conv))


def test_query_over_its_table(spark):
    folder = "/root/testdata/sf0.01"
    rows = [tuple(r) for r in spark.read.parquet(f"{folder}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    want = sorted((expected(c, own) for c, own in damage(rows).items()), key=str)
    assert sorted(map(tuple, queries.queries()["op13_conversation_repair"](spark, folder).collect()), key=str) == want
