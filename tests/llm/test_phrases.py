"""Collocations against counting everything, on awkward texts and any dealing of rows."""

from __future__ import annotations

import random
import re
from collections import Counter

import pyarrow as pa
import pytest

from tessera.llm import phrases

WORDS = ["a", "b", "B", "new", "york", "é", "x\x01", "\x00", "\x00\x01y", "zz'z"]
COLUMNS = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]


def brute(rows, least, top=2000):
    """Rows of the report from ``(text, lang)``."""
    f, sizes = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\n-\r]", low):
            w = re.findall("[^ \t]+", piece)
            sizes[lang] += len(w)
            f.update((lang, tuple(w[i : i + k])) for k in range(1, 5) for i in range(len(w) - k + 1))
    cand = {k: v for k, v in f.items() if v >= least and len(k[1]) > 1}
    out = {}
    for (lang, w), a in cand.items():
        cuts = [(2_000_000 * a // (f[lang, w[:k]] + f[lang, w[k:]]), k, f[lang, w[:k]], f[lang, w[k:]]) for k in range(1, len(w))]
        score, _, left, right = min(cuts)
        around = [v for (g, x), v in cand.items() if g == lang and len(x) > len(w) and any(x[i : i + len(w)] == w for i in range(len(x)))]
        if not any(100 * v >= 80 * a for v in around):
            out.setdefault(lang, []).append((-score, -a, " ".join(w).encode(), left, right))
    return sorted((lang, i + 1, p.decode(), -a, left, right, sizes[lang], -s) for lang, x in out.items() for i, (s, a, p, left, right) in enumerate(sorted(x)[:top]))


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(3)
    gap = lambda: rng.choice([" ", "  ", "\t", " ", ". ", "\n", ",", "\v"])
    rows = [("".join(rng.choices(WORDS, weights=[9, 5, 2, 5, 5, 3, 2, 2, 1, 1])[0] + gap() for _ in range(rng.randrange(60))), rng.choice(["en", "de", None, "", "und"])) for _ in range(120)]
    rows += [(None, "en"), ("", "fr"), (" . \t", "fr"), ("New York is big", "en")] + [("new york city now and then", "en")] * 40 + [("one two " * 3000, "long")]
    return rows


@pytest.mark.parametrize("least, top, parts", [(30, 2000, 3), (4, 9, 7), (1, 50, 1)])
def test_same_as_counting_everything(spark, texts, least, top, parts):
    df = spark.createDataFrame([(i, t, g, "x", 1) for i, (t, g) in enumerate(texts)], "doc_id bigint, text string, lang string, key string, c int").repartition(parts)
    got = phrases.collocations(df, least, top)
    assert got.columns == COLUMNS
    assert sorted(map(tuple, got.collect())) == brute(texts, least, top)


def test_ranges_that_part_a_prefix(spark, texts):
    """However sorted keys are cut into ranges and batches, the parts add up."""
    found = phrases.suffixes([phrases._escaped((t or "").lower().encode()) for t, _ in texts[:60]], [(g or "und").encode() for _, g in texts[:60]])
    keys = sorted((k.encode() for k in found.to_pylist()), reverse=True)
    whole = Counter()
    for k in keys:
        w = k.split(b"\0")
        whole.update(b"\0".join(w[:i]) for i in range(1, len(w) + 1))
    rng = random.Random(1)
    for least in (1, 5):
        for _ in range(20):
            total, cuts = Counter(), sorted(rng.choices(range(len(keys) + 1), k=5))
            for a, b in zip([0, *cuts], [*cuts, len(keys)]):
                rows, at = keys[a:b], 0
                batches = []
                while at < len(rows):
                    n = rng.randrange(1, 40)
                    batches.append(pa.RecordBatch.from_arrays([pa.array([k.decode() for k in rows[at : at + n]]), pa.array([1] * len(rows[at : at + n]), pa.int64())], names=["key", "c"]))
                    at += n
                for out in phrases._counted(least)(batches):
                    for k, c in zip(out.column(0).to_pylist(), out.column(1).to_pylist()):
                        total[k.encode()] += c
            for k, c in whole.items():
                if c >= least:
                    assert total[k] == c, (k, least)


def test_no_documents_and_no_candidates(spark):
    df = spark.createDataFrame([("a b c", "en")], "text string, lang string")
    assert phrases.collocations(df).count() == 0 and phrases.collocations(df.limit(0)).count() == 0
    assert phrases.collocations(df.drop("lang"), least=1).collect()[0]["lang"] == "und"
