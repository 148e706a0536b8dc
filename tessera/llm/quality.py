"""A quality classifier by co-training two views of a document.

One view sees the text's content, as hashed words, runs of bytes and measures of
the whole, the other only the metadata beside it. Each is a logistic regression. In every round each view labels the documents
it is confident about, and the other learns from them; at the end both are
calibrated on labelled rows that neither was fitted on, and their log odds are
combined to score every document.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import Scratch, slices, unit
from tessera.llm.words import Words

#: The text view: slots of hashed words, slots of hashed runs of three bytes, and measures of the whole.
WORD_SLOTS, GRAM_SLOTS, MEASURES = 128, 128, 10
WIDTH = WORD_SLOTS + GRAM_SLOTS + MEASURES
#: Bytes whose runs are counted in one go.
PART = 1 << 20
#: Rows that a fit uses at most, of either kind of label; rounds; what counts as confident.
FIT_ROWS, ROUNDS, CONFIDENT, SEED = 10_000, 2, 0.98, 29
#: A document is rejected if its combined probability of good quality is below this.
REJECT_BELOW = 0.5
#: Values of one metadata column that get a weight each, by hash.
HASHED = 64

class TextView:
    """What a text is made of, a byte a feature: roots of shares, so that rare content counts. A worker makes one."""

    def __init__(self):
        self.words = Words()
        kinds = np.full(256, 4, np.int64)  # other ASCII
        kinds[[9, 10, 11, 12, 13, 32]] = 0
        kinds[48:58], kinds[65:91], kinds[97:123], kinds[128:] = 1, 2, 3, 5
        self.kinds = kinds

    def __call__(self, text: str) -> bytes:
        """The whole text is read. Wordless texts give zeros."""
        raw = text.encode()
        h = self.words.hashes(raw)[1]
        n = len(h)
        if not n:
            return bytes(WIDTH)
        grams, kinds, lines = np.zeros(GRAM_SLOTS), np.zeros(6), 0
        for at in range(0, len(raw), PART):
            part = np.frombuffer(raw[at : at + PART + 2], np.uint8)
            kinds += np.bincount(self.kinds[part[:PART]], minlength=6)
            lines += raw.count(b"\n", at, at + PART)
            b = part.astype(np.uint32)
            g = b[:-2] * np.uint32(0x9E3779B1) + b[1:-1] * np.uint32(0x85EBCA6B) + b[2:] * np.uint32(0xC2B2AE35)
            grams += np.bincount(g >> np.uint32(25), minlength=GRAM_SLOTS)
        words = np.bincount((h >> np.uint64(57)).astype(np.int64), minlength=WORD_SLOTS)
        same = h[1:] == h[:-1]
        runs = np.diff(np.flatnonzero(np.concatenate([[True], ~same, [True]])))
        shares = np.concatenate([words / n, grams / max(1.0, grams.sum())])
        measures = [
            np.log1p(n) / 20, len(np.unique(h)) / n, same.sum() / n, runs.max() / (runs.max() + 10), n / (n + lines),
            min(1.0, len(raw) / n / 32), *(kinds[[1, 2, 4, 5]] / len(raw)),
        ]
        return np.rint(255 * np.append(np.sqrt(shares), measures)).astype(np.uint8).tobytes()


def matrix(column) -> np.ndarray:
    """A binary column of text views as rows of numbers from 0 to 1."""
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, WIDTH) / 255


def views(docs: DataFrame) -> DataFrame:
    """``(doc_id, x, m)`` of every row: the text view, and the metadata view as a short vector of numbers and hashes."""

    def run(batches):
        view = TextView()
        for batch in batches:
            for part in slices(batch):
                x = pa.array([view(t or "") for t in part.column(1).to_pylist()], pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), x, part.column(2), part.column(3), part.column(4)],
                    names=["doc_id", "x", "lang", "source", "n_chars"],
                )

    col = lambda c, kind: F.col(c).cast(kind) if c in docs.columns else F.lit(None).cast(kind)
    rows = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"), col("text", "string").alias("text"), col("lang", "string").alias("lang"),
        col("source", "string").alias("source"), col("n_chars", "bigint").alias("n_chars"),
    )
    found = rows.mapInArrow(run, "doc_id bigint, x binary, lang string, source string, n_chars bigint")
    slot = lambda c: F.pmod(F.xxhash64(F.lit(c), F.coalesce(c, F.lit(""))), F.lit(HASHED)).cast("float")
    size = F.log1p(F.greatest(F.coalesce("n_chars", F.lit(0)), F.lit(0))).cast("float")
    return found.select("doc_id", "x", F.array(size, slot("lang"), slot("source")).alias("m"))


def metadata_matrix(m: np.ndarray) -> np.ndarray:
    """Length, its square, and indicators of the hashed language and source."""
    out = np.zeros((len(m), 2 + 2 * HASHED), np.float64)
    if len(m):
        out[:, 0], out[:, 1] = m[:, 0] / 10, (m[:, 0] / 10) ** 2
        rows = np.arange(len(m))
        out[rows, 2 + m[:, 1].astype(int)] = 1
        out[rows, 2 + HASHED + m[:, 2].astype(int)] = 1
    return out


class Logistic:
    """Ridge logistic regression by Newton steps on standardised columns, then Platt scaling."""

    def __init__(self, ridge: float = 1.0):
        self.ridge, self.a, self.b = ridge, 1.0, 0.0

    def fit(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> Logistic:
        self.mean, self.sd = x.mean(axis=0), x.std(axis=0)
        self.sd[self.sd == 0] = 1
        z = np.hstack([(x - self.mean) / self.sd, np.ones((len(x), 1))])
        self.w = np.zeros(z.shape[1])
        ridge = np.full(z.shape[1], self.ridge)
        ridge[-1] = 1e-6
        for _ in range(25):
            p = 1 / (1 + np.exp(-np.clip(z @ self.w, -30, 30)))
            g = z.T @ (weight * (p - y)) + ridge * self.w
            h = (z * (weight * p * (1 - p))[:, None]).T @ z + np.diag(ridge)
            step = np.linalg.solve(h, g)
            self.w -= step
            if np.abs(step).max() < 1e-8:
                break
        return self

    def raw(self, x: np.ndarray) -> np.ndarray:
        return np.hstack([(x - self.mean) / self.sd, np.ones((len(x), 1))]) @ self.w

    def calibrate(self, x: np.ndarray, y: np.ndarray) -> Logistic:
        """Platt scaling on rows that the fit did not see, with Platt's own targets."""
        s, up = np.clip(self.raw(x), -30, 30), y.sum()
        t = np.where(y > 0, (up + 1) / (up + 2), 1 / (len(y) - up + 2))
        scale = max(1e-6, np.abs(s).mean())
        z = np.stack([s / scale, np.ones(len(s))], axis=1)
        loss = lambda ab: (np.logaddexp(0, z @ ab) - t * (z @ ab)).sum() + 5e-4 * ab[0] ** 2
        ab = np.array([1.0, 0.0])
        for _ in range(100):
            p = 1 / (1 + np.exp(-np.clip(z @ ab, -30, 30)))
            g = z.T @ (p - t) + [1e-3 * ab[0], 0]
            step = np.linalg.solve((z * np.maximum(p * (1 - p), 1e-6)[:, None]).T @ z + np.diag([1e-3, 1e-6]), g)
            size = 1.0
            while size > 1e-6 and loss(ab - size * step) > loss(ab):
                size /= 2
            ab = ab - size * step
            if np.abs(size * step).max() < 1e-8:
                break
        self.a, self.b = (ab[0] / scale, ab[1]) if ab[0] > 0 else (0.0, ab[1])
        return self

    def odds(self, x: np.ndarray) -> np.ndarray:
        """Calibrated log odds of good quality."""
        return self.a * np.clip(self.raw(x), -30, 30) + self.b


class CoTrained:
    """The two views' models after co-training."""

    def __init__(self, text: Logistic, meta: Logistic, prior: float):
        self.text, self.meta, self.prior = text, meta, prior

    def probabilities(self, x: np.ndarray, m: np.ndarray) -> np.ndarray:
        """Columns: text view, metadata view, both. Views' log odds add up, the prior counting once."""
        if not len(x):
            return np.zeros((0, 3))
        a, b = self.text.odds(np.asarray(x, float)), self.meta.odds(metadata_matrix(np.asarray(m, float)))
        prior = np.log(self.prior / (1 - self.prior))
        odds = np.stack([a, b, a + b - prior], axis=1)
        return 1 / (1 + np.exp(-np.clip(odds, -30, 30)))


#: What tells rows apart: those that agree in it count once, however often they are repeated.
_ROW = ("doc_id", "x", "m")


def _distinct(rows: DataFrame, *by: str) -> dict:
    """How many different rows there are for each value of ``by``, counted by a hash of 64 bits."""
    found = rows.groupBy(*by).agg(F.countDistinct(F.xxhash64(*_ROW)).alias("n")).collect()
    return {tuple(r[c] for c in by): r["n"] for r in found}


def _sample(rows: DataFrame, n: int, salt: int) -> list:
    """At most ``n`` different rows, the same in every run: those whose hash comes first; all if there are fewer.

    Of many rows those below a hash come into question that leaves about twice
    as many different ones (for a small ``n`` more, so that it is not missed by
    chance), so what is sent to the driver grows neither with partitions nor
    with repeats.
    """
    total = _distinct(rows).get((), 0)
    hashed = rows.withColumn("h", unit(F.lit(SEED), F.lit(salt), *_ROW))
    wanted = 2 * n + 12 * n**0.5 + 16
    if total > wanted:
        hashed = hashed.where(F.col("h") < wanted / total)
    return hashed.dropDuplicates(list(_ROW)).orderBy("h", *_ROW).limit(n).drop("h").collect()


def _arrays(rows) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    rows = sorted(rows, key=lambda r: (r["doc_id"] is None, r["doc_id"] or 0, bytes(r["x"]), r["m"]))
    x = np.frombuffer(b"".join(bytes(r["x"]) for r in rows), np.uint8).reshape(-1, WIDTH) / 255
    m = np.array([r["m"] for r in rows], float).reshape(-1, 3)
    return x, m, np.array([r["y"] for r in rows], float)


def co_train(seen: DataFrame, labels: DataFrame, scratch: Scratch, fit_rows: int = FIT_ROWS, rounds: int = ROUNDS, confident: float = CONFIDENT) -> CoTrained | None:
    """Models for ``views`` rows and ``labels(doc_id, quality)``; None if only one quality is labelled.

    Each fit uses at most ``fit_rows`` labelled rows and as many that the other
    view labelled, picked by hash; which rows are confident is decided over all
    unlabelled documents. A document labelled twice takes the mean label; null
    labels do not count; repeated rows count once, here and in the prior.
    """
    named = labels.where("doc_id is not null and quality is not null").groupBy(F.col("doc_id").cast("bigint").alias("doc_id")).agg((F.avg("quality") >= 0.5).cast("double").alias("y"))
    joined = scratch.keep(seen.join(named, "doc_id", "left"))
    known = joined.where("y is not null")
    have = _distinct(known, "y")
    if len(have) < 2:
        return None
    prior = have[1.0,] / sum(have.values())
    x, m, y = _arrays(sum((_sample(known.where(F.col("y") == v), fit_rows // 2, v) for v in (0, 1)), []))
    held = np.arange(len(y)) % 4 == 3  # for calibration
    if len(set(y[held])) < 2 or len(set(y[~held])) < 2:
        held = np.zeros(len(y), bool)
    cal = held if held.any() else ~held
    share = np.where(y > 0, prior / max(1, (y > 0).sum()), (1 - prior) / max(1, (y == 0).sum()))
    base = share * len(y)  # classes weigh as they occur among labels, however many were drawn
    extra = {"text": (x[:0], m[:0], y[:0]), "meta": (x[:0], m[:0], y[:0])}
    model = None
    for step in range(rounds + 1):
        fitted = {}
        for view, matrix in (("text", lambda a, b: a), ("meta", lambda a, b: metadata_matrix(b))):
            ex, em, ey = extra[view]
            own = np.concatenate([base[~held], np.full(len(ey), 0.5)])
            fitted[view] = Logistic().fit(
                np.concatenate([matrix(x[~held], m[~held]), matrix(ex, em)]), np.concatenate([y[~held], ey]), own
            ).calibrate(matrix(x[cal], m[cal]), y[cal])
        model = CoTrained(fitted["text"], fitted["meta"], prior)
        if step == rounds:
            return model
        guessed = scratch.keep(_scored(joined.where("y is null").select("doc_id", "x", "m"), model, keep=True))
        for view, by in (("text", "p_meta"), ("meta", "p_text")):
            sure = [
                _sample(guessed.where(F.col(by) > confident if v else F.col(by) < 1 - confident).select("doc_id", "x", "m", F.lit(float(v)).alias("y")), fit_rows // 2, 10 + 2 * step + v)
                for v in (0, 1)
            ]
            extra[view] = _arrays(sum(sure, []))
    return model


def _scored(seen: DataFrame, model: CoTrained, keep: bool = False) -> DataFrame:
    def run(batches):
        for batch in (part for whole in batches for part in slices(whole, 4096)):
            x = matrix(batch.column(1))
            m = batch.column(2).flatten().to_numpy(zero_copy_only=False).reshape(-1, 3)
            p = model.probabilities(x, m)
            own = [batch.column(1), batch.column(2)] if keep else []
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *own, *(pa.array(p[:, k]) for k in range(3))], names=["doc_id", *(["x", "m"] if keep else []), "p_text", "p_meta", "p_good"]
            )

    more = "x binary, m array<float>, " if keep else ""
    return seen.select("doc_id", "x", "m").mapInArrow(run, f"doc_id bigint, {more}p_text double, p_meta double, p_good double")


def score_documents(docs: DataFrame, labels: DataFrame, reject_below: float = REJECT_BELOW, **options) -> DataFrame:
    """``(doc_id, p_text, p_meta, p_good, kept)`` of every row of ``docs``.

    Reads doc_id, text, lang, source and n_chars; a column that is missing or
    null counts as empty, texts are read whole, other columns are not read.
    Repeated rows are scored each; a null doc_id stays and is unlabelled. If
    the labels know fewer than two qualities there is nothing to learn: all
    probabilities are 1 and everything is kept. No rows give none.
    """
    with Scratch(docs.sparkSession) as scratch:
        seen = scratch.keep(views(docs))
        model = co_train(seen, labels, scratch, **options)
        if model is None:
            found = seen.select("doc_id", *[F.lit(1.0).alias(c) for c in ("p_text", "p_meta", "p_good")])
        else:
            found = _scored(seen, model)
        return scratch.result(found.withColumn("kept", F.col("p_good") >= reject_below))


def good_documents(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` whose text the classifier does not reject, with all their columns.

    Models are learnt as in ``score_documents``; the second reading of a row
    scores it where it stands, so no text is shuffled.
    """
    with Scratch(docs.sparkSession) as scratch:
        model = co_train(scratch.keep(views(docs)), labels, scratch, **options)
    if model is None:
        return docs
    return kept_by(docs, model)


def kept_by(docs: DataFrame, model: CoTrained, reject_below: float = REJECT_BELOW) -> DataFrame:
    """The rows of ``docs`` that ``model`` keeps."""
    col = lambda c, kind: F.col(c).cast(kind) if c in docs.columns else F.lit(None).cast(kind)
    slot = lambda c: F.pmod(F.xxhash64(F.lit(c), F.coalesce(col(c, "string"), F.lit(""))), F.lit(HASHED)).cast("float")
    size = F.log1p(F.greatest(F.coalesce(col("n_chars", "bigint"), F.lit(0)), F.lit(0))).cast("float")
    wide = docs.withColumn("__m", F.array(size, slot("lang"), slot("source")))
    at = docs.columns.index("text")

    def run(batches):
        view = TextView()
        for batch in batches:
            for part in slices(batch):
                x = matrix(pa.array([view(t or "") for t in part.column(at).to_pylist()], pa.binary()))
                m = part.column(part.num_columns - 1).flatten().to_numpy(zero_copy_only=False).reshape(-1, 3)
                keep = pa.array(model.probabilities(x, m)[:, 2] >= reject_below)
                yield part.select(list(range(part.num_columns - 1))).filter(keep)

    return wide.mapInArrow(run, docs.schema)
