"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing columns; brute force beside each."""

from __future__ import annotations

import hashlib
import random
import re
import time
import zlib
from collections import Counter
from html.parser import HTMLParser

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tessera.llm import chat, embeddings, html, media, mixing, pii, quality, sentencepiece_codec, simhash, substrings
from tessera.llm.common import WORD

SF = "/root/testdata/sf0.001"
DOCS = "doc_id bigint, text string, source string, size string, fp string, component_id string, taken string"


def documents(spark, rows):
    """A documents table with extra columns whose names clash with results'."""
    return spark.createDataFrame([(i, t, s, "x", "y", "z", "w") for i, t, s in rows], DOCS)


@pytest.fixture(scope="module")
def odd(spark):
    rng = random.Random(4)
    words = [f"w{k}" for k in range(300)]
    base = [rng.choice(words) for _ in range(400)]
    near = list(base)
    near[200] = "other"
    rows = [
        (1, " ".join(base), "a"), (2, " ".join(near), "a"), (3, " ".join(base), "b"), (3, " ".join(base), "b"), (4, None, None), (5, "", "b"),
        (6, " \t\n", "c"), (7, "one", "c"), (8, " ".join(rng.choice(words) for _ in range(30_000)), "a"), (None, "no id here at all", "b"), (9, "ÄÖÜ ẞ İ 日本 🙂", "d"),
        (10, "x" * 200_000, "d"),
    ]
    return documents(spark, rows).repartition(3).cache()


def reference_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def test_simhash_against_brute_force(spark, odd):
    rows = odd.select("doc_id", "text").collect()
    got = simhash.simhash_groups(odd)
    assert got.columns == ["doc_id", "fingerprint", "component_id"] and got.count() == len(rows)
    have = {(r.doc_id, r.fingerprint) for r in got.collect()}
    assert have == {(r.doc_id, f"{reference_fingerprint(r.text):016x}") for r in rows}
    comp = {r.doc_id: r.component_id for r in got.collect()}
    assert comp[1] == comp[2] == comp[3] == 1 and comp[4] == comp[5] == comp[6] == 4 and comp[9] == 9
    assert simhash.simhash_groups(odd.limit(0)).count() == 0
    kept = simhash.keep_one(odd)
    assert kept.columns == odd.columns and sorted(r.doc_id for r in kept.where("doc_id IS NOT NULL").collect()) == [1, 4, 7, 8, 9, 10]
    assert [r.text for r in kept.where("doc_id IS NULL").collect()] == ["no id here at all"]


def test_simhash_keeps_texts_that_share_an_id(spark):
    rng = random.Random(17)
    text = lambda: " ".join("".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(60))
    a, b, c, d = text(), text(), text(), text()
    rows = [(1, a, "x"), (1, b, "x"), (1, b, "y"), (2, a, "x"), (None, c, "x"), (None, c, "x"), (None, d, "x"), (3, d, "x"), (None, None, "x"), (None, "", "x"), (4, c + " tail", None)]
    df = documents(spark, rows).repartition(3)
    kept = sorted((r.doc_id is None, r.doc_id or 0, r.text or "") for r in simhash.keep_one(df).collect())
    groups = {(r.doc_id, r.fingerprint): r.component_id for r in simhash.simhash_groups(df).collect()}
    assert groups[2, f"{reference_fingerprint(a):016x}"] == 1 and groups[1, f"{reference_fingerprint(b):016x}"] == 1
    tail = reference_fingerprint(c) ^ reference_fingerprint(c + " tail")
    near = [(False, 4, c + " tail")] + ([] if bin(tail).count("1") <= 4 else [(True, 0, c)])
    assert kept == sorted([(False, 1, a), (False, 1, b), (False, 3, d), (True, 0, ""), *near])
    assert len({r.source for r in simhash.keep_one(df).where("text = '" + b + "'").collect()}) == 1


@pytest.mark.parametrize("plan,heavy", [(simhash.NARROW, 64), (simhash.WIDE, 64), (simhash.NARROW, 2)])
def test_hamming_links_lose_nothing(spark, plan, heavy):
    rng = random.Random(9)
    centres = [rng.getrandbits(64) for _ in range(15)]
    fps = set(centres) | {c ^ sum(1 << b for b in rng.sample(range(64), rng.randint(1, 6))) for c in centres for _ in range(12)}
    rows = [(i, f - (1 << 64) if f >> 63 else f) for i, f in enumerate(sorted(fps))]
    classes = spark.createDataFrame(rows, "rep bigint, fp bigint")
    from tessera.llm.common import Scratch
    from tessera.llm.graph import components

    with Scratch(spark) as scratch:
        got = {r.node: r.component for r in components(simhash.links(classes, scratch, plan=plan, heavy_at=heavy), scratch).collect()}
    label = {i: i for i, _ in rows}
    for _ in rows:
        new = {i: min(label[j] for j, g in rows if bin((f ^ g) & (1 << 64) - 1).count("1") <= 4) for i, f in rows}
        if new == label:
            break
        label = new
    assert {i: got.get(i, i) for i in label} == label


def test_components_of_chains_and_stars(spark):
    from tessera.llm.common import Scratch
    from tessera.llm.graph import components

    edges = [(i, i + 1) for i in range(100, 160)] + [(7, k) for k in range(300, 340)] + [(5, 5), (None, 3), (340, 339), (340, 339)]
    with Scratch(spark) as scratch:
        got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a bigint, b bigint"), scratch).collect()}
        assert components(spark.createDataFrame([], "a bigint, b bigint"), scratch).count() == 0
    assert all(got[i] == 100 for i in range(100, 161)) and all(got[k] == 7 for k in range(300, 341)) and 5 not in got


def reference_targets(sizes):
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(sorted(sizes, key=lambda s: (s is None, s)))}
    left, capped, total = dict(weight), {}, 1.5 * sum(sizes.values())
    while left:
        share = (total - sum(capped.values())) / sum(left.values())
        over = [s for s in left if share * left[s] > 2 * sizes[s]]
        if not over:
            return capped | {s: share * w for s, w in left.items()}
        for s in over:
            capped[s] = 2.0 * sizes[s]
            del left[s]
    return capped


def test_mixing_targets_and_draws(spark, odd):
    rows = odd.select("doc_id", "text", "source").collect()
    size = lambda t: len(re.findall(WORD, t or ""))
    sizes = {}
    for r in rows:
        sizes[r.source] = sizes.get(r.source, 0) + size(r.text)
    want = reference_targets(sizes)
    got = mixing.mix(odd, shards=4).collect()
    assert len(got) == len(rows) and sorted((str(r.doc_id), r.size) for r in got) == sorted((str(r.doc_id), size(r.text)) for r in rows)
    taken = {}
    for r in got:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source]) and 0 <= r.taken <= 2 * r.size
        assert r.taken == sum(b.words for b in r.blocks) and all(0 <= b.shard < 4 for b in r.blocks)
        taken[r.source] = taken.get(r.source, 0) + r.taken
    assert all(abs(taken[s] - want[s]) <= 1 for s in want)
    again = mixing.mix(odd.repartition(7), shards=4).collect()
    key = lambda r: (str(r.doc_id), r.size, r.taken)
    assert sorted(map(key, got)) == sorted(map(key, again))
    assert mixing.mix(odd.limit(0)).count() == 0
    copies = mixing.mixed_documents(odd)
    assert copies.columns == odd.columns and copies.where("text IS NULL").count() == 0


def test_mixing_shards_are_even_and_exact(spark):
    df = spark.range(900).selectExpr("id AS doc_id", "repeat('a ', CAST(1 + id % 5 AS INT)) AS text", "IF(id % 3 = 0, 's1', IF(id % 3 = 1, 's2', 's3')) AS source")
    got = mixing.mix(df, shards=8).selectExpr("source", "explode(blocks) AS b").selectExpr("source", "b.shard AS shard", "b.order AS o").collect()
    n = [sum(r.shard == k for r in got) for k in range(8)]
    assert max(n) - min(n) <= 3
    quotas = spark.createDataFrame([(0, 40), (1, 60), (2, 1)], "sidx int, quota bigint")
    cuts = {r.sidx: r.cuts for r in mixing.shard_quotas(quotas, 4).collect()}
    assert {k: c[-1] for k, c in cuts.items()} == {0: 40, 1: 60, 2: 1} and all(c == sorted(c) and len(c) == 4 for c in cuts.values())


def test_mixing_deals_many_sources_in_groups(spark, monkeypatch):
    quotas = spark.range(11).selectExpr("CAST(id AS INT) AS sidx", "1 + id * 3 AS quota")
    for fan in (2, 3, 64):  # four heights, three and one
        monkeypatch.setattr(mixing, "FAN", fan)
        for shards in (1, 8):
            got = {r.sidx: r.cuts for r in mixing.shard_quotas(quotas, shards).collect()}
            assert sorted(got) == list(range(11)) and all(c[-1] == 1 + 3 * k and c == sorted(c) and len(c) == shards for k, c in got.items())
            sizes = [sum(c[n] - (c[n - 1] if n else 0) for c in got.values()) for n in range(shards)]
            assert max(sizes) - min(sizes) <= 3
    assert mixing.shard_quotas(quotas.limit(0), 8).count() == 0


def test_mixing_in_groups_follows_the_law(spark, monkeypatch):
    """Of two shards the first has half of all blocks; a source's part of it is hypergeometric however its group was dealt."""
    from math import comb

    monkeypatch.setattr(mixing, "FAN", 2)
    quotas = spark.createDataFrame([(0, 6), (1, 4), (2, 5), (3, 5)], "sidx int, quota bigint").coalesce(1)
    seen, runs = {k: {} for k in range(4)}, 30
    for seed in range(runs):
        for r in mixing.shard_quotas(quotas, 2, seed).collect():
            seen[r.sidx][r.cuts[0]] = seen[r.sidx].get(r.cuts[0], 0) + 1
    for k, quota in ((0, 6), (1, 4), (2, 5), (3, 5)):
        law = [comb(quota, v) * comb(20 - quota, 10 - v) / comb(20, 10) for v in range(quota + 1)]
        mean = sum(v * c for v, c in seen[k].items()) / runs
        sd = sum(p * (v - quota / 2) ** 2 for v, p in enumerate(law)) ** 0.5
        assert abs(mean - quota / 2) < 4 * sd / runs**0.5 and len(seen[k]) > 2


def test_hypergeometric_law(spark):
    r = spark.range(40_000).selectExpr("50L AS pop", "20L AS marked", "10L AS take", "(id + 0.5D) / 40000 AS u")
    e = mixing.hypergeometric("pop", "marked", "take", "u")
    got = {x.v: x["count"] / 40_000 for x in r.selectExpr(f"{e} AS v").groupBy("v").count().collect()}
    from math import comb

    for v in range(11):
        assert got.get(v, 0) == pytest.approx(comb(20, v) * comb(30, 10 - v) / comb(50, 10), abs=1e-3)


RULES = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def reference_spans(text):
    out = []
    for kind, rule in RULES.items():
        for m in re.finditer(rule, text):
            digits = re.sub("[^0-9]", "", m.group())
            ok = {
                "email": lambda m=m: True, "ip": lambda m=m: all(int(p) <= 255 for p in m.group().split(".")),
                "card": lambda d=digits: 13 <= len(d) <= 19 and sum(int(c) if k % 2 == 0 else (2 * int(c) - 9 if int(c) > 4 else 2 * int(c)) for k, c in enumerate(reversed(d))) % 10 == 0,
                "phone": lambda d=digits: 9 <= len(d) <= 15,
            }[kind]()
            if ok:
                out.append((kind, *m.span()))
    return out


def test_pii_rules_against_plain_patterns():
    rng = random.Random(8)
    alphabet = ["a", "Z", "9", "0", "4", "1", "25", "255", "256", ".", "@", "-", "+", " ", "(", ")", "_", "%", "é", "\n", "4111111111111111", "b.c", "@d.e"]
    for _ in range(6000):
        text = "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 24)))
        assert [(pii.KINDS[k], a, b) for k, a, b in pii.rule_spans(text)] == reference_spans(text), text


def test_pii_long_texts_are_linear():
    for text in ("a" * 400_000, "1" * 400_000, "+1 " * 100_000, "a@" * 100_000, "1." * 200_000, "1 " * 200_000, "(" * 200_000 + "1", "(1) " * 100_000, "x1 " * 100_000):
        began = time.process_time()
        pii.all_spans(text, {"< p q": (1.0, 0)})
        assert time.process_time() - began < 20  # quadratic work takes minutes


def test_pii_discovers_by_context(spark):
    seeds = [(k, f"please write to user{k}@mail.org today", None) for k in range(12)]
    more = [(20, "please write to jane77(at)mail today", None), (21, "nothing of 12345678 here", None), (22, None, None), (22, None, None), (None, "", None)]
    got = {r.doc_id: r for r in pii.find_pii(documents(spark, seeds + more)).collect() if r.doc_id is not None}
    assert got[20].n_email == 0 and got[20].spans == "email:16:30" and got[21].spans == "" and got[22].spans == "" and got[3].spans == "email:16:30"
    assert got[20].base_sha256 == hashlib.sha256(b"").hexdigest() and got[3].base_sha256 == hashlib.sha256(b"email:16:30").hexdigest()
    red = {r.doc_id: r.text for r in pii.redacted_documents(documents(spark, seeds + more)).collect()}
    assert red[3] == "please write to [EMAIL] today" and red[20] == "please write to [EMAIL] today" and red[22] is None
    assert pii.find_pii(documents(spark, [])).count() == 0


def test_sentencepiece_equals_the_library(spark, odd):
    import sentencepiece

    lib = sentencepiece.SentencePieceProcessor(model_file=sentencepiece_codec.MODEL)
    text = {r.doc_id: r.text or "" for r in odd.collect()}
    enc = sentencepiece_codec.encode(odd)
    for r in enc.collect():
        assert r.ids == lib.encode(text[r.doc_id]) and r.n_tokens == len(r.ids) and r.lossless
    back = sentencepiece_codec.decode(enc).collect()
    assert sorted(r.text for r in back) == sorted(r.text or "" for r in odd.collect())
    assert sentencepiece_codec.encode(odd.limit(0)).count() == 0


def test_unigram_takes_the_best_path():
    def varint(n):
        out = b""
        while n > 127:
            out, n = out + bytes([n & 127 | 128]), n >> 7
        return out + bytes([n])

    import struct

    pieces = [("<unk>", 0.0, 2), ("▁", -2.0, 1), ("a", -3.0, 1), ("b", -3.5, 1), ("ab", -4.0, 1), ("▁ab", -7.0, 1), ("bab", -5.0, 1), ("▁a", -4.5, 1)]
    data = b""
    for p, s, t in pieces:
        body = b"\x0a" + varint(len(p.encode())) + p.encode() + b"\x15" + struct.pack("<f", s) + b"\x18" + varint(t)
        data += b"\x0a" + varint(len(body)) + body
    data += b"\x12\x02\x18\x01" + b"\x1a\x04\x18\x01\x20\x00"
    m = sentencepiece_codec.Model(data)
    score = {p: s for p, s, t in pieces if t == 1}

    def best(text):
        if not text:
            return 0.0
        return max([score[text[:k]] + best(text[k:]) for k in range(1, len(text) + 1) if text[:k] in score], default=-1e9)

    for text in ("ab", "abab", "a b", "babab", "aabb ab", "bbb"):
        ids = m.encode(text)
        assert sum(score[m.pieces[i]] for i in ids) == pytest.approx(best("▁" + text.replace(" ", "▁"))) and m.decode(ids) == text
    assert [m.pieces[i] for i in m.encode("azzb")] == ["▁a", "<unk>", "b"]


def test_chat_round_trip(spark):
    rows = [
        (1, 0, "user", "hi <|im_end|> there"), (1, 1, "assistant", "<\\|im_start|>ok"), (1, 2, "assistant", None), (2, None, None, "null turn"), (2, 1, "assistant", " lead"),
        (2, 1, "assistant", " lead"), (3, 0, "assistant", "x" * 50_000), (None, 0, "assistant", "nobody"),
    ]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "conv_id bigint, turn bigint, role string, text string, formatted string")
    got = {r.conv_id: r for r in chat.digests(chat.format_conversations(df)).collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert got[1].n_turns == 3 and got[1].turns_sha256 == sha("user\nhi <|im_end|> there\nassistant\n<\\|im_start|>ok\nassistant\n\n")
    assert got[1].loss_sha256 == sha("<\\|im_start|>ok") and got[2].loss_sha256 == sha(" lead lead") and got[2].turns_sha256 == sha("\nnull turn\nassistant\n lead\nassistant\n lead\n")
    assert got[3].loss_chars == 50_000 and got[None].loss_sha256 == sha("nobody")
    assert chat.format_conversations(df.limit(0)).count() == 0


def test_media_round_trip(spark, odd):
    got = media.media_info(media.media_column(odd)).collect()
    text = {r.doc_id: (r.text or "").encode() for r in odd.collect()}
    for r in got:
        raw = text[r.doc_id]
        padded = raw + b"\xff" * (max(1, -(-len(raw) // 576)) * 576 - len(raw))
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-32:]))
        assert r.codec == "raw" and r.samples == len(padded) // 576 and len(r.keyframes) == -(-r.samples // media.KEY_EVERY) and r.media_bytes > r.payload_bytes
    assert len({(r.n_bytes, r.media_sha256, r.feature) for r in got if r.n_bytes == 0}) == 1
    broken = spark.createDataFrame([(1, 1, b"\0\0\0\x08moov"), (2, 1, b"\0\0\0\xffmoov"), (3, 1, None)], "doc_id bigint, n_bytes bigint, media binary")
    assert [r.codec for r in media.media_info(broken).collect()] == [None] * 3
    assert media.media_column(odd.limit(0)).count() == 0


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var t="</p>";</script></head><body><nav><ul><li><a href="/a">Menu</a></ul></nav>
<div class="ad">Buy</div>{main}<div id="comments"><p>A reader says a lot of things, here, there, and everywhere.</div><footer>&copy; x</footer>{end}"""


def test_html_cases(spark):
    article = "<article><h1>Head &amp; line</h1><p><b>One,  two<br>three<p>Four &lt;five&gt; <a href=x>link</a></p><form>no</form></article>"
    pages = [
        (1, "http://h.org/1", PAGE.format(main=article, end="</body></html>")), (2, "http://H.org:80/2", PAGE.format(main=article, end="")), (2, "http://H.org:80/2", PAGE.format(main=article, end="")),
        (3, None, None), (4, "x", ""), (5, "http://h.org/5", "just <b>text</b> 1 < 2"), (6, "http://other/", "<div class='post-12'><p>Deep, and long, text, of a post.</p></div>" + "<div>" * 2000 + "deep"),
        (None, "http://h.org/1", "<p>" + "long words " * 30_000),
    ]
    df = spark.createDataFrame([(*p, "clash", 7) for p in pages], "page_id bigint, url string, html string, text string, n_chars int")
    got = {}
    for r in html.extract_pages(df).collect():
        got[r.page_id] = r
        assert r.n_chars == len(r.text)
    want = "Head & line One, two three Four <five> link"
    assert got[1].text == want and got[2].text == want and got[3].text == "" and got[4].text == "" and got[5].text == "just text 1 < 2"
    assert got[6].text.startswith("Deep, and long") and got[None].text == ("long words " * 30_000).strip()
    assert html.extract_pages(df).count() == len(pages) and html.extract_pages(df.limit(0)).count() == 0


@pytest.mark.parametrize("few", [html.BROADCAST_ROWS, 0])
def test_html_all_templates_of_a_host(spark, monkeypatch, few):
    monkeypatch.setattr(html, "BROADCAST_ROWS", few)
    side = "<section><p>aside</p></section>"
    main = lambda k, text: f"<div class='t{chr(97 + k)}'><p>{text}</p></div>"
    rows = [(k * 10 + n, "http://h.org/", main(k, "Long, winding, text, of the main part, of this page.") + side) for k in range(5) for n in range(6 - k)]
    rows.append((99, "http://h.org/", main(4, "short") + "<section><p>A longer, louder, much more wordy, section, than the main part.</p></section>"))
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    got = {r.page_id: r.text for r in html.extract_pages(df).collect()}
    assert got[99] == "short" and got[40] == "Long, winding, text, of the main part, of this page." and len(got) == len(rows)


def html_path(text):
    """The path of block elements written as "/tag.classes/tag"."""
    path = ""
    for part in text.split("/")[1:]:
        path = html.step(path, *part.partition(".")[::2])
    return path


def test_html_deep_elements_stay_balanced():
    page = "<div><article><p>before</p>" + "<div>" * 600 + "<div class=ad>advert <b>bold</b></div>within" + "</div>" * 600 + "<p>after</p></article></div><div>outside</div>"
    nodes, blocks = html.parse(page)
    assert [(t, n.apart) for n, t in blocks] == [("before", False), ("advert bold", True), ("within", False), ("after", False), ("outside", False)]
    assert blocks[3][0].path == html_path("/div/article/p") and blocks[4][0].path == html_path("/div")
    assert html.extract(page, {html_path("/div/article"): ()}) == "before within after"
    html.parse("<b><div>" + "<span>" * 100_000 + "</b>" * 100_000)


@pytest.mark.parametrize("tile,bundles", [(16, 12), (4, 5), (5, 2)])
def test_embeddings_over_many_tiles(spark, monkeypatch, tile, bundles):
    """Links across tiles and bundles equal brute force, where many vectors lie at one place along the first axis too."""
    monkeypatch.setattr(embeddings, "TILE", tile)
    monkeypatch.setattr(embeddings, "BUNDLES", bundles)
    rng = np.random.default_rng(9)
    base = rng.normal(size=(60, 12))
    base[20:40] = base[20]
    v = np.concatenate([base, base + rng.normal(size=base.shape) * 0.1, np.eye(12)]).astype(np.float32).astype(float)
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id bigint, embedding array<float>")
    got = {r.vec_id: (r.n_links, r.component_id) for r in embeddings.embedding_groups(df).collect()}
    n = np.linalg.norm(v, axis=1)
    near = (v @ v.T) / np.outer(n, n) >= 0.95
    np.fill_diagonal(near, False)
    label = np.arange(len(v))
    while True:
        new = np.minimum(label, np.where(near, label[None, :], 1 << 60).min(axis=1))
        if (new == label).all():
            break
        label = new
    assert got == {i: (int(near[i].sum()), int(label[i])) for i in range(len(v))}


def test_embeddings_against_brute_force(spark):
    rng = np.random.default_rng(6)
    centres = rng.normal(size=(12, 24))
    v = [c + rng.normal(size=24) * 0.12 for c in centres for _ in range(14)] + [centres[0] * 3, centres[0] * 3]
    rows = [(i, [float(np.float32(x)) for x in e]) for i, e in enumerate(v)]
    odd_rows = [(900, None), (901, [0.0] * 24), (902, [float("nan")] + [1.0] * 23), (903, [None] + [1.0] * 23), (904, [1.0, 2.0]), (905, [2.0, 4.0]), (906, []), (5, rows[5][1])]
    df = spark.createDataFrame([(*r, 3, "k") for r in rows + odd_rows], "vec_id bigint, embedding array<float>, label int, kept string")
    got = {}
    for r in embeddings.embedding_groups(df).collect():
        got.setdefault(r.vec_id, []).append((r.n_links, r.component_id, r.kept))
    allv = [(i, np.array(e, float)) for i, e in rows] + [(5, np.array(rows[5][1], float))]
    x = np.array([e for _, e in allv])
    n = np.linalg.norm(x, axis=1)
    near = (x @ x.T) / np.outer(n, n) >= 0.95
    np.fill_diagonal(near, False)
    label = np.array([i for i, _ in allv])
    while True:
        new = np.minimum(label, np.where(near, label[None, :], 1 << 60).min(axis=1))
        if (new == label).all():
            break
        label = new
    for k, (i, _) in enumerate(allv):
        assert (near[k].sum(), label[k], label[k] == i) in got[i]
    assert got[900] == got.get(900) and all(got[i] == [(0, i, True)] for i in (900, 901, 902, 903, 906)) and got[904] == [(1, 904, True)] and got[905] == [(1, 904, False)]
    assert embeddings.embedding_groups(df.limit(0)).count() == 0


def test_tiles_agree_with_one_product():
    rng = np.random.default_rng(7)
    for spread in (0.05, 0.3, 3.0):
        a, b = (rng.normal(size=(40, 32)) * spread + np.ones(32) * (spread < 1) for _ in range(2))
        axes = np.linalg.qr(rng.normal(size=(32, 32)))[0]
        cos = (a @ b.T) / np.outer(np.linalg.norm(a, axis=1), np.linalg.norm(b, axis=1))
        assert (embeddings.close_pairs(a, b, axes, 0.95) == (cos >= 0.95)).all()


def test_substrings_cases(spark):
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    passage = [word() for _ in range(60)]
    other = list(passage)
    other[30] = "changed"
    fill = lambda n: [word() for _ in range(n)]
    line = fill(14)
    rows = [
        (1, " ".join(fill(80) + passage + fill(20)), None), (2, " ".join(fill(10) + passage), None), (3, " ".join(fill(33) + other + fill(50)), None), (4, " ".join(fill(120)), None),
        (5, " ".join(line + fill(100)), None), (6, " ".join(fill(50) + line + fill(50)), None), (7, None, None), (8, "short", None), (9, " ".join(passage[:30] * 4), None), (None, " ".join(passage), None),
    ]
    got = {r.doc_id: r for r in substrings.repeated_passages(documents(spark, rows)).collect()}
    assert set(got) == {1, 2, 3, None} and {r.component_id for r in got.values()} == {1}
    assert got[2].spans == "10:70" and got[1].spans == "80:140" and got[1].n_passages == 1 and got[1].repeated_words == 60
    assert substrings.repeated_passages(documents(spark, [])).count() == 0 and substrings.repeated_passages(documents(spark, rows[3:7])).count() == 0


def test_substrings_blocks(spark, monkeypatch):
    monkeypatch.setattr(substrings, "BLOCK", 3)
    rng = random.Random(12)
    fill = lambda n: ["".join(rng.choice("abcdefghij") for _ in range(5)) for _ in range(n)]
    passage = fill(55)
    rows = [(k, " ".join(fill(30) + passage + fill(30)), None) for k in range(20)]
    got = substrings.repeated_passages(documents(spark, rows)).collect()
    assert len(got) == 20 and {r.component_id for r in got} == {0}
    for r in got:  # tokens are compared by one byte, so an end may lie one too far
        a, b = map(int, r.spans.split(":"))
        assert a in (29, 30) and b in (85, 86)


def test_substrings_with_gaps(spark):
    """Near passages by their shingles' Jaccard similarity: words inserted or deleted, sentences in another order."""
    rng = random.Random(21)
    fill = lambda n: ["".join(rng.choice("abcdefghij") for _ in range(5)) for _ in range(n)]
    runs = lambda ws: [tuple(ws[k : k + 5]) for k in range(len(ws) - 4)]

    def jaccard(a, b):
        a, b = set(runs(a)), set(runs(b))
        return len(a & b) / len(a | b)

    one, two, long, cut, turned, far = fill(60), fill(88), fill(440), fill(70), fill(64), fill(60)
    pairs = [
        (one, one[:30] + ["new"] + one[30:]), (two, two[:44] + ["new"] + two[44:]), (long, [w for k in range(0, 440, 44) for w in [*long[k : k + 44], f"new{k}"]]),
        (cut, cut[:35] + cut[37:]), (turned, turned[32:] + turned[:32]), (far, [w for k in range(0, 60, 15) for w in [*far[k : k + 15], f"new{k}"]]),
    ]
    assert [jaccard(*p) >= 0.8 for p in pairs] == [True] * 5 + [False]
    rows = [(2 * k + side, " ".join(fill(40) + text + fill(40)), None) for k, p in enumerate(pairs) for side, text in enumerate(p)]
    got = {r.doc_id: r for r in substrings.repeated_passages(documents(spark, rows)).collect()}
    assert {i: r.component_id for i, r in got.items()} == {i: i - i % 2 for i in range(10)}
    for i, r in got.items():
        n = len(pairs[i // 2][i % 2])
        spans = [tuple(map(int, x.split(":"))) for x in r.spans.split(",")]
        assert all(39 <= a and b <= 41 + n for a, b in spans) and r.repeated_words >= 0.9 * n, (i, r)


def test_substrings_recall_against_brute_force(spark):
    """Passages edited at random, alike to 0.8 and more without 50 equal words in a row: nine of ten link, nothing else does."""
    rng = random.Random(31)
    fill = lambda n: ["".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(n)]
    runs = lambda ws: Counter(tuple(ws[k : k + 5]) for k in range(len(ws) - 4))
    rows, n = [], 0
    while n < 200:
        a = fill(rng.choice([50, 55, 60, 75, 110]))
        b = list(a)
        for _ in range(rng.choice([1, 1, 2, 3])):
            at, op = rng.randrange(len(b)), rng.choice("sid")
            b[at : at + (op != "i")] = fill(op != "d")
        equal = {tuple(a[k : k + 50]) for k in range(len(a) - 49)}
        both, x, y = runs(a) & runs(b), runs(a), runs(b)
        near = sum(both.values()) >= 0.8 * (sum(x.values()) + sum(y.values()) - sum(both.values()))
        if near and len(b) >= 50 and not any(tuple(b[k : k + 50]) in equal for k in range(len(b) - 49)):
            rows += [(2 * n, " ".join(fill(40) + a + fill(40)), None), (2 * n + 1, " ".join(fill(50) + b + fill(30)), None)]
            n += 1
    got = {r.doc_id: r.component_id for r in substrings.repeated_passages(documents(spark, rows)).collect()}
    assert all(c == i - i % 2 for i, c in got.items()) and len(got) >= 0.9 * len(rows)


def test_substrings_near_passage_whose_exact_partners_come_later(spark):
    """A near passage is found in a connected text whose row comes before those in which an exact repeat holds it."""
    rng = random.Random(34)
    fill = lambda n: ["".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(n)]
    rows = []
    for k in range(30):
        exact, near, before, after = fill(60), fill(60), fill(60), fill(60)
        rows.append((3 * k, " ".join(fill(30) + exact + fill(40) + near[:30] + ["new"] + near[30:] + fill(30)), None))
        rows.append((3 * k + 1, " ".join(exact + before + near + after), None))
        rows.append((3 * k + 2, " ".join(fill(20) + before + near + after), None))
    got = {r.doc_id: r.spans for r in substrings.repeated_passages(documents(spark, rows)).collect()}
    spans = [[tuple(map(int, s.split(":"))) for s in got[3 * k].split(",")] for k in range(30)]
    assert sum(any(a <= 136 and b >= 185 for a, b in x) for x in spans) >= 27


def test_substrings_near_passages_of_connected_texts(spark):
    """What an exact repeat connects is searched all the same: nine of ten near passages are covered, in pairs and in texts that others connect too."""
    rng = random.Random(33)
    fill = lambda n: ["".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(n)]
    rows, at = [], {}
    for k in range(120):
        exact, near, third = fill(60), fill(60), fill(60)
        for side, text in enumerate((near, near[:30] + ["new"] + near[30:])):
            rows.append((3 * k + side, " ".join(fill(30) + exact + fill(40) + text + fill(30) + (third if k % 2 else fill(60))), None))
            at[3 * k + side] = (130, 130 + len(text))
        rows.append((3 * k + 2, " ".join(fill(25) + (third if k % 2 else fill(60)) + fill(20) + near[:20] + ["other"] + near[20:]), None))
        at[3 * k + 2] = (105, 166)
    got = {r.doc_id: r for r in substrings.repeated_passages(documents(spark, rows)).collect()}
    covered = {i: sum(max(0, min(b, y) - max(a, x)) for x, y in (map(int, s.split(":")) for s in got[i].spans.split(","))) if i in got else 0 for i, (a, b) in at.items()}
    for part in ([i for i in at if i % 3 < 2 and i // 3 % 2 == 0], [i for i in at if i // 3 % 2], list(at)):
        assert sum(covered[i] >= 0.9 * (at[i][1] - at[i][0]) for i in part) >= 0.9 * len(part)
    assert all(got[i].component_id == i - i % 3 for i in got)


def test_substrings_copies_and_long_texts(spark):
    """Equal words are one text whatever their case and spaces; a passage in a very long text is found where it is."""
    rng = random.Random(32)
    fill = lambda n: ["".join(rng.choice("abcdefghij") for _ in range(5)) for _ in range(n)]
    passage, long, copy = fill(52), fill(60_000), fill(70)
    rows = [
        (1, " ".join(long[:30_000] + passage + long[30_000:]), None), (2, " ".join(fill(9) + passage), None), (3, " ".join(copy), None), (4, "\n".join(copy).upper() + " ", None),
        (3, " ".join(copy), None), (5, " ".join(copy[:49]), None), (6, " ".join(copy[:49]), None), (7, "x" * 300_000, None), (8, "y " * 50_000, None), (9, "y " * 40, None),
    ]
    got = {}
    for r in substrings.repeated_passages(documents(spark, rows)).collect():
        got.setdefault(r.doc_id, []).append((r.spans, r.component_id))
    assert got == {1: [("30000:30052", 1)], 2: [("9:61", 1)], 3: [("0:70", 3)] * 2, 4: [("0:70", 3)]}


def test_substrings_hot_passage_in_blocks(spark, monkeypatch):
    """Near copies of one passage in more texts than a block holds are one component."""
    monkeypatch.setattr(substrings, "BLOCK", 8)
    rng = random.Random(33)
    fill = lambda n: ["".join(rng.choice("abcdefghij") for _ in range(5)) for _ in range(n)]
    passage, rows = fill(54), []
    for k in range(40):
        own = list(passage)
        own[27] = f"edit{k}"
        rows.append((k, " ".join(fill(20) + own + fill(20)), None))
    got = {r.doc_id: r.component_id for r in substrings.repeated_passages(documents(spark, rows)).collect()}
    assert len(got) >= 38 and set(got.values()) == {min(got)}


def test_substrings_inside_connected_texts_whatever_the_block(spark, monkeypatch):
    """Texts that exact repeats connect have the same near passages whether a key's classes fit a block or not."""
    rng = random.Random(35)
    fill = lambda n: ["".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(n)]
    exact, core, rows = fill(60), fill(40), []
    for k in range(16):
        before, after = fill(20), fill(20)
        for side, own in enumerate((core, core[:20] + [f"new{k}"] + core[20:])):
            rows.append((2 * k + side, " ".join(fill(20) + exact + fill(20) + before + own + after + fill(20)), None))
    found = []
    for block in (1 << 20, 3):
        monkeypatch.setattr(substrings, "BLOCK", block)
        found.append({r.doc_id: (r.spans, r.component_id) for r in substrings.repeated_passages(documents(spark, rows)).collect()})
    assert len(found[0]) == 32 and sum("," in s for s, _ in found[0].values()) >= 16
    assert found[0] == found[1]


def test_mixed_documents_draw_rows_alike_one_by_one(spark):
    """Equal rows across a source's cut are drawn as often as the target says, not all or none."""
    rows = [(7, "one two three", "a")] * 5000 + [(k, f"w{k} " * (1 + k % 5), "b") for k in range(900)] + [(None, "null id " * 3, None)] * 40 + [(7, "other words here", "a")] * 30
    df = documents(spark, rows)
    targets = {r.source: r.target for r in mixing.mix(df).select("source", "target").distinct().collect()}
    out = mixing.mixed_documents(df)
    assert out.columns == df.columns
    words = {r.source: r.n for r in out.groupBy("source").agg(F.sum(mixing.word_count(F.col("text"))).alias("n")).collect()}
    for source, target in targets.items():
        assert abs(words.get(source, 0) - target) <= 6, (source, words, targets)
    assert max(r["count"] for r in out.groupBy("doc_id", "source", "text").count().where("source = 'b'").collect()) <= 2
    again = mixing.mixed_documents(df.repartition(5))
    key = lambda t: sorted((r.source or "", r.text, r["count"]) for r in t.groupBy("source", "text").count().collect())
    assert key(out) == key(again)


class Plain(HTMLParser):
    """The text of the one article of a page, by another parser."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.depth, self.out = 0, []

    def handle_starttag(self, tag, attrs):
        self.depth += tag == "article"
        if tag in ("p", "br", "h1", "h2", "li", "div"):
            self.out.append(" ")

    def handle_endtag(self, tag):
        self.depth -= tag == "article"
        self.out.append(" " if tag in ("p", "h1", "h2", "li", "div") else "")

    def handle_data(self, data):
        if self.depth:
            self.out.append(data)


def test_html_against_another_extractor(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    got = {r.page_id: r.text for r in html.extract_pages(pages).collect()}
    checked = 0
    for r in pages.collect():
        if r.html and r.html.count("<article>") == 1 and "</article>" in r.html and not re.search(r"<(aside|form|script|nav)", r.html.split("<article>")[1].split("</article>")[0]):
            other = Plain()
            other.feed(r.html)
            assert got[r.page_id] == " ".join("".join(other.out).split()), r.page_id
            checked += 1
    assert checked >= 20


@pytest.mark.parametrize("name,aside", [
    *[(x, False) for x in ("social-policy", "related-work", "share-price-report", "comment-on-law", "article-header", "adventure", "main", "post-12")],
    *[(x, True) for x in ("ad", "ads", "cookie-banner", "related-posts", "commentList", "site-footer", "nav_main", "sidebar2", "share-buttons")],
])
def test_html_names_count_as_a_whole(name, aside):
    page = f"<body><div class='{name}'><p>Some words, of this part.</p></div><div><p>Others, beside it, that stay.</p></div></body>"
    texts = [t for n, t in html.parse(page)[1] if not n.apart]
    assert ("Some words, of this part." in texts) != aside
    assert html.extract(f"<article class='{name}'><p>All there is.</p></article>", {}) == "All there is."


def test_html_raw_elements_and_empty_consensus():
    assert html.extract("<div>" + "İ" * 12 + "<SCRIPT>var a='</scripty>'</ScRiPt ><p>kept</p></div>", {}) == "İ" * 12 + " kept"
    one, other = html_path("/div.a"), html_path("/div.b")
    assert html.extract("<div class='a'></div><div class='b'><p>body</p></div>", {one: (-5, "")}) == "body"
    two = "<div class='a'><p>first text, here.</p></div><div class='b'><p>second text, here.</p></div>"
    assert html.extract(two, {one: (-2, 0), other: (-2, 1)}) == "first text, here."
    assert html.extract(two, {one: (-2, 0), other: (-3, 1)}) == "second text, here."


def test_html_no_depth_changes_the_rules(spark):
    """A consensus path of any depth wins, and deep or unbalanced pages take linear time."""
    deep = "<div>" * 3000
    page = lambda main, noise: f"{deep}<article><p>{main}</p></article><section><p>{noise}</p></section>"
    long, short = "Many words, of the main text, of this page, which goes on.", "few words"
    rows = [(k, "http://deep.org/", page(long, "side")) for k in range(4)] + [(9, "http://deep.org/", page(short, long + long))]
    got = {r.page_id: r.text for r in html.extract_pages(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()}
    assert got == {0: long, 1: long, 2: long, 3: long, 9: short}
    began = time.process_time()
    for text in ("<div>x" * 60_000, "<span>" * 60_000 + "<p>x" * 60_000, "<div>" * 60_000 + "</i>" * 60_000, "<b><div>" + "<span>" * 60_000 + "</b>" * 60_000, "<ul><li>x" * 60_000):
        html.extract(text, {})
    assert time.process_time() - began < 60


def plain_scores(nodes, blocks):
    """Each block's weight carried up one element at a time."""
    out = Counter()
    for node, text in blocks:
        links, at, share = 0, node, 1.0
        while at.tag not in html.CONTAINERS:
            links, at = links + at.links, at.parent
        weight = max(0, len(text) + 25 * text.count(", ") + 50 * (node.tag == "p") - links) * (not node.apart)
        while at is not None:
            if at.tag in html.CONTAINERS:
                out[at.path] += weight * share * (1.25 if at.tag in ("article", "main") else 1)
                share *= 0.8
            at = at.parent
    return out


@pytest.mark.parametrize("few", [html.BROADCAST_ROWS, 0])
def test_html_vote_against_plain_counting(spark, monkeypatch, few):
    monkeypatch.setattr(html, "BROADCAST_ROWS", few)
    df = spark.read.parquet(f"{SF}/pages.parquet")
    pages = [(r.page_id, re.match(r"\w+://([^/:?#]*)", r.url or "")[1].lower(), r.html or "") for r in df.collect()]
    ballots, parsed = {}, {}
    for i, h, text in pages:
        parsed[i] = html.parse(text)
        plain, own = plain_scores(*parsed[i]), html.scores(*parsed[i])
        assert own == pytest.approx({p: plain[p] for p in own}) and not any(v for p, v in plain.items() if p not in own)
        best = min((p for p in own if p and own[p] > 0), key=lambda p: (-own[p], p), default=None)
        if best:
            ballots.setdefault(h, Counter())[best] += 1
    want = {}
    for i, h, _ in pages:
        nodes, blocks = parsed[i]
        mine = [p for p in {x for n, _ in blocks if not n.apart for x in lineage(n)} if p in ballots.get(h, {})]
        chosen = min(mine, key=lambda p: (-ballots[h][p], p), default=None)
        if chosen:
            want[i] = " ".join(t for n, t in blocks if not n.apart and chosen in lineage(n))
    got = {r.page_id: r.text for r in html.extract_pages(df).collect()}
    assert len(want) >= 0.9 * len(pages) and all(got[i] == t for i, t in want.items())


def lineage(node):
    """The paths of the containers that an element is in."""
    found = []
    while node is not None:
        found += [node.path] * (node.tag in html.CONTAINERS)
        node = node.parent
    return found


def test_media_survives_damage(spark):
    rng = random.Random(5)
    whole = media.write_file(media.pad("hello world " * 900)[0])
    rows = []
    for k in range(5000):
        d = bytearray(whole)
        for _ in range(rng.randint(1, 4)):
            d[rng.randrange(min(len(d), 900))] = rng.randrange(256)
        rows.append((k, 1, bytes(d[: rng.randrange(len(d))] if k % 5 == 0 else d)))
    df = spark.createDataFrame(rows, "doc_id bigint, n_bytes bigint, media binary")
    got = media.media_info(df).select("codec", "samples", "payload_bytes").collect()
    assert len(got) == 5000 and all((r.codec is None) == (r.samples is None) == (r.payload_bytes is None) for r in got) and sum(r.codec is not None for r in got) > 500


def test_pii_instances_of_several_tokens_and_table_of_patterns(spark, monkeypatch):
    seeds = [(k, f"you may call my office at +1 555 010 {1000 + k} any day", None) for k in range(9)] + [(k, f"mail {k}@b.org or x", None) for k in range(50, 53)]
    more = [(20, "you may call my office at (555) 010-2345 any day", None), (21, "my office at 12", None), (22, "no 555 010 2345 at all", None)]
    df = documents(spark, seeds + more)
    got = {r.doc_id: r for r in pii.find_pii(df).collect()}
    assert got[20].spans == "phone:26:40" and got[20].n_phone == 0 and got[22].spans == "" and got[3].spans == "phone:26:41"
    few = {r.doc_id: r.text for r in pii.redacted_documents(df).collect()}
    monkeypatch.setattr(pii, "BROADCAST_ROWS", 0)
    assert {r.doc_id: r for r in pii.find_pii(df).collect()} == got
    assert {r.doc_id: r.text for r in pii.redacted_documents(df).collect()} == few and few[20] == "you may call my office at [PHONE] any day"


def test_pii_kinds_that_tie():
    patterns = {"< at": (0.9, 3), "> now": (0.9, 1), "< call at": (0.8, 0)}
    assert pii.all_spans("call at 12-34-56-78 now", patterns)[1] == [(1, 8, 19)]
    assert pii.all_spans("call at 12-34-56-78 now", patterns | {"< at": (0.95, 3)})[1] == [(3, 8, 19)]


def test_quality_sample_is_bounded(spark):
    same = "CAST(NULL AS BIGINT) AS doc_id", "CAST('same' AS BINARY) AS x", "array(1.0F) AS m", "1.0D AS y"
    rows = spark.range(3000).selectExpr("id AS doc_id", "CAST(CAST(id AS STRING) AS BINARY) AS x", "array(1.0F) AS m", "CAST(id % 3 AS DOUBLE) AS y").union(spark.range(900).selectExpr(*same))
    got = quality._sample(rows, 20, 1)
    assert len(got) == 20 and got == quality._sample(rows.repartition(7), 20, 1) and len(quality._sample(rows.limit(5), 20, 1)) == 5
    assert len(quality._sample(spark.range(900).selectExpr(*same), 20, 1)) == 1
    hot = rows.where("doc_id < 100").union(rows.where("doc_id < 11").join(spark.range(400).select()))
    assert len({r.doc_id for r in quality._sample(hot, 20, 1)}) == 20 and {r.doc_id for r in quality._sample(hot, 20, 1)} == {r.doc_id for r in quality._sample(rows.where("doc_id < 100"), 20, 1)}


def labelled(n, rng, bad):
    words = ["buy", "now", "$$$", "!!!", "free"] if bad else ["the", "river", "runs", "over", "old", "stones", "and", "sand"]
    return " ".join(rng.choice(words) for _ in range(n))


@pytest.fixture(scope="module")
def two_kinds(spark):
    """Documents of two kinds, a third of them labelled, and one repeated row of each kind among them."""
    rng = random.Random(6)
    rows = [(k, labelled(rng.randrange(20, 60), rng, k % 3 == 0), "en", "web" if k % 3 == 0 else "book", 100 + k % 7) for k in range(66)]
    labels = [(k, int(k % 3 > 0)) for k in range(22)]
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    plain = spark.createDataFrame(rows, schema)
    repeated = spark.createDataFrame(rows + [rows[0], rows[1]] * 2000, schema)
    return plain, repeated, spark.createDataFrame(labels, "doc_id bigint, quality int")


def test_quality_with_repeated_labelled_rows(two_kinds):
    plain, repeated, labels = two_kinds
    one, many = (quality.score_documents(d.repartition(3), labels, fit_rows=20).dropDuplicates(["doc_id"]).collect() for d in (plain, repeated))
    close = lambda rows: {r.doc_id: (*(round(r[c], 9) for c in ("p_text", "p_meta", "p_good")), r.kept) for r in rows}
    assert close(one) == close(many)
    bad = quality.score_documents(repeated, labels, fit_rows=20).where("doc_id % 3 = 0 AND doc_id < 22")
    assert bad.count() == 2008 and bad.where("kept").count() == 0
    good = quality.good_documents(repeated, labels, fit_rows=40).groupBy((F.col("doc_id") % 3 == 0).alias("bad")).count().collect()
    assert [(r.bad, r["count"]) for r in good] == [(False, 2044)]


@pytest.mark.parametrize("rounds", [0, 1, 2])
def test_quality_co_training_against_plain_arrays(two_kinds, rounds):
    """The rounds written down on arrays, every row in them: what Spark scores has to agree."""
    plain, _, labels = two_kinds
    seen = {r.doc_id: r for r in quality.views(plain).collect()}
    named = {r.doc_id: float(r.quality) for r in labels.collect()}
    known, rest = sorted(named), sorted(set(seen) - set(named))
    x = lambda ids: np.array([np.frombuffer(bytes(seen[i].x), np.uint8) / 255 for i in ids]).reshape(-1, quality.WIDTH)
    m = lambda ids: quality.metadata_matrix(np.array([seen[i].m for i in ids], float).reshape(-1, 3))
    y = np.array([named[i] for i in known])
    held = np.arange(len(known)) % 4 == 3
    weight = np.where(y > 0, y.mean() / (y > 0).sum(), (1 - y.mean()) / (y == 0).sum()) * len(y)
    extra = {"text": {}, "meta": {}}
    for step in range(rounds + 1):
        fitted = {}
        for view, f in (("text", x), ("meta", m)):
            more = sorted(extra[view])
            fit = quality.Logistic().fit(np.vstack([f(known)[~held], f(more)]), np.append(y[~held], [extra[view][i] for i in more]), np.append(weight[~held], np.full(len(more), 0.5)))
            z = np.hstack([(np.vstack([f(known)[~held], f(more)]) - fit.mean) / fit.sd, np.ones(((~held).sum() + len(more), 1))])
            p = 1 / (1 + np.exp(-z @ fit.w))
            target, w = np.append(y[~held], [extra[view][i] for i in more]), np.append(weight[~held], np.full(len(more), 0.5))
            assert np.abs(z.T @ (w * (p - target)) + np.append(np.full(z.shape[1] - 1, fit.ridge), 1e-6) * fit.w).max() < 1e-6  # the optimum
            fitted[view] = fit.calibrate(f(known)[held], y[held])
        odds = {v: 1 / (1 + np.exp(-np.clip(fitted[v].odds(f(rest)), -30, 30))) for v, f in (("text", x), ("meta", m))}
        for view, by in (("text", "meta"), ("meta", "text")):
            extra[view] = {i: float(p > 0.5) for i, p in zip(rest, odds[by]) if p > quality.CONFIDENT or p < 1 - quality.CONFIDENT}
    prior = np.log(y.mean() / (1 - y.mean()))
    every = sorted(seen)
    want = 1 / (1 + np.exp(-np.clip(fitted["text"].odds(x(every)) + fitted["meta"].odds(m(every)) - prior, -30, 30)))
    got = {r.doc_id: r.p_good for r in quality.score_documents(plain.repartition(4), labels, rounds=rounds).collect()}
    assert np.allclose([got[i] for i in every], want, atol=1e-9)


def test_quality_on_held_out_labels(spark):
    docs, labels = spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    part = "pmod(xxhash64(doc_id), 3)"  # low quality stands at multiples of 3, so ids themselves do not split evenly
    held = labels.where(f"{part} = 0")
    got = quality.score_documents(docs, labels.where(f"{part} <> 0")).join(held, "doc_id")
    wrong = got.where("(quality = 1) <> kept").count()
    assert wrong <= 0.05 * got.count() and got.where("quality = 1 AND NOT kept").count() <= 0.02 * got.count()
    assert quality.good_documents(docs, labels).columns == docs.columns


def test_quality_odd_input(spark, odd):
    labels = spark.createDataFrame([(1, 1, "x"), (1, 0, "y"), (7, 0, "z"), (None, 1, "w"), (8, None, "v")], "doc_id bigint, quality int, kept string")
    assert quality.score_documents(odd, labels).count() == odd.count()
    one = quality.score_documents(odd, labels.where("doc_id = 7"))
    assert one.where("kept AND p_good = 1").count() == odd.count() and quality.score_documents(odd.limit(0), labels).count() == 0


def test_pipeline_stages_pass_whole_rows(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    before = docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns, name
        if name == "quality_classifier":
            bad = spark.read.parquet(f"{SF}/labels.parquet").where("quality = 0")
            good = spark.read.parquet(f"{SF}/labels.parquet").where("quality = 1")
            assert out.join(good, "doc_id", "left_semi").count() == docs.join(good, "doc_id", "left_semi").count()
            assert out.join(bad, "doc_id", "left_semi").count() <= 0.3 * bad.count()
        if name == "simhash_near_dedup":
            groups = simhash.simhash_groups(docs)
            assert sorted(r.doc_id for r in out.collect()) == sorted(r.doc_id for r in groups.where("doc_id = component_id").collect())
        if name == "pii_redaction":
            assert out.count() == docs.count() and all(not pii.rule_spans(r.text) for r in out.collect())
        docs = out.cache()
    last = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert last.count() == docs.count() and last.where("NOT lossless").count() == 0 and before > 0 and F is not None
