"""Personal data by rules and by bootstrapped contextual extraction.

Rules find e-mail addresses, IP addresses, card and phone numbers. They seed a
graph: each identifier-like run of tokens is an instance, the one to three
words before it and after it are its lexical patterns, and an edge says that
the two meet. Scores travel over the graph: a pattern is as good as the
instances it brings, an instance as good as its best patterns. Patterns that
stay confident mark instances that no rule knows.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left, bisect_right

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import BROADCAST_ROWS, Scratch, slices

#: Kinds in the order of results (fixed values).
KINDS = ("email", "ip", "card", "phone")

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")
MARK, TOKEN, GROUP = re.compile(r"[0-9@]"), re.compile(r"\S+"), re.compile(r"[0-9()+./#-]+")
EDGE = "\"'()[]{}<>.,;:!?"

#: A pattern is one to so many words on one side of an instance; words and instances beyond so many characters stand as a digest.
PATTERN_WORDS, PLAIN_CHARS = 3, 64
#: A pattern is confident if it brings so many different seeds of one kind and this share of its instances is of it.
SEEDS, CONFIDENT, ROUNDS = 5, 0.8, 3


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if k % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def rule_spans(text: str) -> list[tuple[int, int, int]]:
    """``(kind, start, end)`` of what the rules find, by kind, then start; linear in the text.

    Each kind's matches are leftmost and do not overlap; a match that fails its
    check is dropped with what it covers.
    """
    out = []
    if "@" in text:
        done = 0
        for m in DOMAIN.finditer(text):
            at = m.start()
            while at > done and text[at - 1] in LOCAL:
                at -= 1
            if at < m.start():
                out.append((0, at, m.end()))
                done = m.end()
    if DIGIT.search(text):
        for m in IP.finditer(text):
            if all(len(p) < 4 and int(p) < 256 for p in (g.lstrip("0") or "0" for g in m.groups())):
                out.append((1, *m.span()))
        for m in CARD.finditer(text):
            if m.end() - m.start() >= 13:
                digits = m.group().replace(" ", "").replace("-", "")
                if 13 <= len(digits) <= 19 and luhn(digits):
                    out.append((2, *m.span()))
        if "+" in text:
            for m in PHONE.finditer(text):
                if 9 <= len(DIGIT.findall(m.group())) <= 15:
                    out.append((3, *m.span()))
    return out


def _short(text: str) -> str:
    return text if len(text) <= PLAIN_CHARS else hashlib.blake2b(text.encode(), digest_size=16).hexdigest()


def _trimmed(text: str, a: int, b: int) -> tuple[int, int]:
    """A span without punctuation at its ends; a bracket that the span closes again stays."""
    while b > a and text[b - 1] in EDGE:
        b -= 1
    while a < b and text[a] in EDGE and not (text[a] == "(" and text.find(")", a, b) > 0):
        a += 1
    return a, b


def candidates(text: str, spans) -> list[tuple[int, int, str, list[str], int]]:
    """``(start, end, instance, patterns, kind)`` of identifier-like runs of tokens; kind -1: no rule knows it.

    What a rule found is an instance, whole. Other tokens with a digit or @ are
    instances as they stand; groups of digits with single spaces between them
    are one. The text's ends count as words of patterns.
    """
    if not MARK.search(text):
        return []
    starts, ends = [], []
    for m in TOKEN.finditer(text):
        starts.append(m.start())
        ends.append(m.end())
    found, taken = [], set()
    for k, a, b in spans:
        i, j = bisect_right(starts, a) - 1, bisect_left(ends, b)
        taken.update(range(i, j + 1))
        found.append((a, b, i, j, k))
    marks, at, end = [m.start() for m in MARK.finditer(text)], 0, -1
    run: list[int] = []

    def close():
        if run:
            a, b = _trimmed(text, starts[run[0]], ends[run[-1]])
            if b > a:
                found.append((a, b, run[0], run[-1], -1))
            run.clear()

    while at < len(marks):
        i = bisect_right(starts, marks[at]) - 1
        at = bisect_left(marks, ends[i], at)
        if i in taken:
            continue
        group = GROUP.fullmatch(text, starts[i], ends[i]) is not None
        if not (group and run and end == i - 1 and starts[i] == ends[i - 1] + 1):
            close()
        run.append(i)
        end = i if group else -1
    close()

    def words(rest: str, places) -> list[str]:
        """Up to PATTERN_WORDS words next to an instance: what is left of its own token, then tokens."""
        out = [w for w in (rest.strip(EDGE),) if w]
        for i in places:
            if len(out) == PATTERN_WORDS:
                return out
            if not 0 <= i < len(starts):
                return [*out, "^"]
            w = text[starts[i] : ends[i]].strip(EDGE)
            out += [w] if w else []
        return out

    out, done = [], 0
    found.sort()
    for n, (a, b, i, j, k) in enumerate(found):  # a token's text between two findings is read once
        until = found[n + 1][0] if n + 1 < len(found) else len(text)
        before = words(text[max(starts[i], min(done, a)) : a], range(i - 1, -2, -1))
        after = words(text[b : max(b, min(ends[j], until))], range(j + 1, len(starts) + 1))
        done = max(done, b)
        patterns = [f"{side} {' '.join(_short(w.lower()) for w in ws[:m])}" for side, ws in (("<", before), (">", after)) for m in range(1, len(ws) + 1)]
        out.append((a, b, _short(text[a:b]), patterns, k))
    return out


def _edges(docs: DataFrame) -> DataFrame:
    """``(pattern, instance, kind)``: an edge for each pattern and instance that meet."""

    def run(batches):
        for batch in batches:
            for part in slices(batch):
                p, i, k = [], [], []
                for text in part.column(0).to_pylist():
                    found = {(pattern, c[2], c[4]) for c in candidates(text or "", rule_spans(text or "")) for pattern in c[3]}
                    for x in found:
                        p.append(x[0]), i.append(x[1]), k.append(x[2])
                yield pa.RecordBatch.from_arrays([pa.array(p, pa.string()), pa.array(i, pa.string()), pa.array(k, pa.int32())], names=["pattern", "instance", "kind"])

    found = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "pattern string, instance string, kind int")
    return found.distinct()


def confident_patterns(docs: DataFrame, scratch: Scratch, seeds: int = SEEDS, confident: float = CONFIDENT, rounds: int = ROUNDS) -> DataFrame:
    """``(pattern, kind, score)``: patterns whose instances are of one kind, by rules or by earlier rounds.

    Instances found by a rule keep score 1 for their kind. In each round a
    pattern's score for a kind is the mean over its different instances, and
    an unknown instance takes the best score of its patterns if that is
    ``confident`` and its pattern has enough different seeds. Documents that
    repeat an edge do not count it again, and sums are combined before they
    are shuffled, so a pattern or instance that a third of all documents share
    costs no more than its different edges.
    """
    edges = scratch.keep(_edges(docs))
    kinds = [f"k{k}" for k in range(len(KINDS))]
    scores = scratch.keep(
        edges.groupBy("instance").agg(*[F.max((F.col("kind") == k).cast("double")).alias(c) for k, c in enumerate(kinds)])
    )
    pairs = scratch.keep(edges.select("pattern", "instance").distinct())
    enough = scratch.keep(
        edges.where("kind >= 0").groupBy("pattern", "kind").agg(F.count("*").alias("n")).where(F.col("n") >= seeds)
        .groupBy("pattern").agg(F.array_agg("kind").alias("seeded"))
    )
    patterns = None
    for step in range(rounds):
        best = F.greatest(*kinds)
        patterns = scratch.keep(
            pairs.join(enough, "pattern").join(scores, "instance").groupBy("pattern")
            .agg(F.first("seeded").alias("seeded"), *[F.avg(c).alias(c) for c in kinds])
            .withColumn("score", best)
            .withColumn("kind", F.coalesce(*[F.when(F.col(c) == F.col("score"), k) for k, c in enumerate(kinds)]))
            .where(F.array_contains("seeded", F.col("kind")) & (F.col("score") >= confident))
            .select("pattern", "kind", "score")
        )
        if step + 1 == rounds or not patterns.limit(1).count():
            break
        gained = pairs.join(patterns, "pattern").groupBy("instance").agg(
            *[F.max(F.when(F.col("kind") == k, F.col("score"))).alias(f"g{k}") for k in range(len(KINDS))]
        )
        scores = scratch.keep(
            scores.join(gained, "instance", "left").select("instance", *[F.greatest(c, F.coalesce(f"g{k}", F.lit(0.0))).alias(c) for k, c in enumerate(kinds)])
        )
    return patterns.select("pattern", "kind", "score")


def all_spans(text: str, patterns: dict[str, tuple[float, int]], more=()) -> tuple[list, list]:
    """The rules' spans, and with them those of instances that a confident pattern marks; by kind, then start.

    The pattern with the best score decides on the kind, of equal ones the
    first kind. ``more`` are marks ``(start, end, kind)`` found elsewhere.
    """
    base = rule_spans(text)
    found = [(k, a, b) for a, b, k in more or ()]
    for a, b, _, own, kind in candidates(text, base) if patterns else ():
        known = [patterns[p] for p in own if p in patterns] if kind < 0 else None
        if known:
            found.append((max(known, key=lambda v: (v[0], -v[1]))[1], a, b))
    return (base, sorted(base + found)) if found else (base, base)


def _join(spans) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in spans)


def learn(docs: DataFrame, scratch: Scratch, **options) -> tuple[dict[str, tuple[float, int]], DataFrame | None]:
    """The confident patterns of ``docs`` for executors, and where those are too many, the marks they make instead.

    Up to BROADCAST_ROWS patterns travel to the executors. More are joined
    with the instances of each different text: ``(page, marks)`` by the
    text's digest.
    """
    found = scratch.keep(confident_patterns(docs, scratch, **options))
    if found.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        return {r["pattern"]: (r["score"], r["kind"]) for r in found.toLocalIterator()}, None

    def run(batches):
        for batch in batches:
            for part in slices(batch):
                rows = [(page, c[0], c[1], p) for page, text in zip(*(part.column(k).to_pylist() for k in (0, 1)))
                        for c in candidates(text or "", rule_spans(text or "")) if c[4] < 0 for p in c[3]]
                kinds = (pa.string(), pa.int32(), pa.int32(), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*rows)) or [()] * 4, kinds)], names=["page", "a", "b", "pattern"])

    texts = docs.select(_page().alias("page"), F.col("text").cast("string").alias("text")).where(F.col("text").rlike("[0-9@]"))
    spots = texts.mapInArrow(run, "page string, a int, b int, pattern string").distinct()
    best = spots.join(found, "pattern").groupBy("page", "a", "b").agg(F.max(F.struct("score", -F.col("kind"))).alias("best"))
    marks = best.select("page", F.struct("a", "b", (-F.col("best")["col2"]).alias("kind")).alias("m")).groupBy("page").agg(F.collect_list("m").alias("marks"))
    return {}, scratch.result(marks)


def _page():
    return F.sha2(F.coalesce(F.col("text").cast("string"), F.lit("")), 256)


def _marked(docs: DataFrame, marks: DataFrame | None) -> DataFrame:
    """``docs`` with the marks made elsewhere as a last column ``__marks``."""
    if marks is None:
        return docs.withColumn("__marks", F.lit(None).cast("array<struct<a: int, b: int, kind: int>>"))
    return docs.withColumn("__page", _page()).join(marks.select(F.col("page").alias("__page"), F.col("marks").alias("__marks")), "__page", "left").drop("__page")


def _spots(column) -> list:
    return [[(m["a"], m["b"], m["kind"]) for m in ms] if ms else () for ms in column.to_pylist()]


def find_pii(docs: DataFrame, **options) -> DataFrame:
    """Personal data of every row of ``docs(doc_id, text)``: counts, digest of the rules' spans, all spans.

    Positions are code points, ends exclusive. A null text is empty and has no
    spans; a null doc_id stays; repeated rows repeat; texts are read whole;
    other columns are not read; no rows give none.
    """
    with Scratch(docs.sparkSession) as scratch:
        patterns, marks = learn(docs, scratch, **options)

    def run(batches):
        for batch in batches:
            for part in slices(batch):
                rows = []
                for text, more in zip(part.column(1).to_pylist(), _spots(part.column(2))):
                    base, every = all_spans(text or "", patterns, more)
                    counts = [sum(s[0] == k for s in base) for k in range(4)]
                    rows.append((*counts, hashlib.sha256(_join(base).encode()).hexdigest(), _join(every)))
                names = ["n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"]
                yield pa.RecordBatch.from_arrays([part.column(0), *map(pa.array, map(list, zip(*rows)))], names=["doc_id", *names])

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return _marked(rows, marks).mapInArrow(run, "doc_id bigint, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, spans string")


def redact(text: str, patterns: dict[str, tuple[float, int]], more=()) -> str:
    """A text with each finding replaced by its kind in brackets; findings that overlap become one."""
    spans = sorted((a, b, k) for k, a, b in all_spans(text, patterns, more)[1])
    out, at = [], 0
    for a, b, k in spans:
        if b <= at:
            continue
        if a >= at:
            out += (text[at:a], f"[{KINDS[k].upper()}]")
        at = b
    return "".join([*out, text[at:]])


def redacted_documents(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with personal data in ``text`` replaced; ``n_chars``, if there, counts the new text.

    Null texts stay null; all other columns and all rows stay.
    """
    with Scratch(docs.sparkSession) as scratch:
        patterns, marks = learn(docs, scratch, **options)
    at = docs.columns.index("text")

    def run(batches):
        for batch in batches:
            for part in slices(batch):
                texts = pa.array([None if t is None else redact(t, patterns, more) for t, more in zip(part.column(at).to_pylist(), _spots(part.column(part.num_columns - 1)))], pa.string())
                yield part.select(list(range(part.num_columns - 1))).set_column(at, part.schema.field(at), texts.cast(part.schema.field(at).type))

    out = _marked(docs, marks).mapInArrow(run, docs.schema)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.coalesce(F.length("text").cast("bigint"), F.col("n_chars")))
    return out
