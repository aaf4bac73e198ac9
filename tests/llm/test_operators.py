"""Each operator on nulls, empty and long texts, ties, repeats, empty tables and clashing columns, and against brute force."""

from __future__ import annotations

import hashlib
import itertools
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from fabula.llm import bpe, common, op1_toxicity, op2_topk, op3_media, op4_warc, op5_html, op6_bpe, op7_packing, op8_substring, op9_licenses, op10_icws

P = pytest.importorskip("public_tokenizers")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key long, tid long, class long, rank int"
WORDS = [a + b for a in ("ba", "ko", "ti", "zu", "re") for b in ("lan", "mer", "dos", "fik", "sat", "wen", "")]


def prose(rng, n):
    return " ".join(rng.choice(WORDS, n)) + "."


@pytest.fixture(scope="module")
def texts():
    rng = np.random.default_rng(5)
    shared = prose(rng, 70)
    base = [prose(rng, int(n)) for n in rng.integers(60, 200, 14)]
    out = [None, "", "", "one", "Éa ß 日本語 <|endoftext|> it's", *base]
    out += [base[0], base[0], base[1].replace(" ", " new ", 1)]  # copies, a near copy
    out += [f"{base[3][:200]} {shared} {base[4][-150:]}", f"{base[5][:180]} {shared} {base[6][-90:]}", prose(rng, 20_000)]
    return out


@pytest.fixture(scope="module")
def docs(spark, texts):
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), 1, 2, 3, 4) for i, t in enumerate(texts)], SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


def test_components(spark):
    rng = np.random.default_rng(1)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 80, (60, 2))] + [(100 + i, 101 + i) for i in range(20)]
    leader = {}

    def find(x):
        while leader.setdefault(x, x) != x:
            x = leader[x]
        return x

    for a, b in edges:
        low, high = sorted((find(a), find(b)))
        leader[high] = low
    got = {r["node"]: r["root"] for r in common.components(spark, spark.createDataFrame(edges, "a long, b long")).collect()}
    nodes = {x for a, b in edges if a != b for x in (a, b)}
    assert got == {x: find(x) for x in nodes}


def test_toxicity(spark, docs, none):
    rng = np.random.default_rng(2)
    rows, labels = [], []
    for i in range(400):
        toxic = i % 8 == 0
        words = list(rng.choice(WORDS, 50)) + [["idiot", "scum"][i % 16 // 8]] * toxic
        rng.shuffle(words)
        rows.append((1000 + i, " ".join(words)))
        labels.append((1000 + i, [None, 0, 1][i % 3], int(toxic) if i != 9 else None))
    d = docs.select("doc_id", "text").unionByName(spark.createDataFrame(rows, "doc_id long, text string"))
    y = spark.createDataFrame(labels[:300] + labels[:5], "doc_id long, quality int, toxic int")
    got = by_id(op1_toxicity.score(d, y))
    assert len(got) == d.count()
    held_out = [(got[1000 + i]["toxic"], i % 8 == 0) for i in range(300, 400)]
    assert np.mean([a == b for a, b in held_out]) >= 0.97
    texts, table = [t for _, t in rows[:300]], np.array([[i % 2, i % 8 == 0] for i in range(300)], dtype=float)
    one = op1_toxicity.train(texts, table)
    p = one.predict(*op1_toxicity.features(texts))
    parts = [op1_toxicity.features([t]) for t in texts]
    for i in (0, 7, 299):  # the chain, by hand: the second model adds the first one's probability
        first = 1 / (1 + np.exp(-(one.weights[parts[i][0], 0].sum(dtype=float) + one.bias[0])))
        second = 1 / (1 + np.exp(-(one.weights[parts[i][0], 1].sum(dtype=float) + first * one.earlier[1][0] + one.bias[1])))
        assert np.allclose(p[i], (first, second), atol=1e-6)
    assert op1_toxicity.score(none, y).count() == 0
    assert not any(r["toxic"] for r in op1_toxicity.score(docs, y.limit(0)).collect())


def test_topk(spark):
    rng = np.random.default_rng(3)
    v = [(i, (rng.integers(-3, 4, 16) / 4).tolist()) for i in range(150)]
    v += [(200, v[0][1]), (201, None), (202, [1.0] * 15 + [None]), (203, [float("nan")] * 16), (204, [float("inf")] + [0.0] * 15), (205, []), (20, v[20][1]), (206, [1.0] * 40), (207, [float("nan")] * 99)]
    df = spark.createDataFrame([(i, e, 9) for i, e in v], "vec_id long, embedding array<float>, score int")
    got = [tuple(r) for r in op2_topk.search(df.select("vec_id", "embedding").repartition(3), F.col("vec_id") % 20 == 0, k=7, block=20, query_block=2, tile=2).collect()]
    good = [(int(i), np.floor(64 * np.array(e, dtype=np.float32).astype(float)).astype(int)) for i, e in v if e and len(e) == 16 and None not in e and np.isfinite(np.array(e, float)).all()]
    want = []
    for n, (q, a) in enumerate(good):
        if q % 20 == 0:
            best = sorted((-int(a @ b), i) for m, (i, b) in enumerate(good) if m != n)[:7]
            want += [(q, rank + 1, i, -s) for rank, (s, i) in enumerate(best)]
    assert sorted(got) == sorted(want) and sum(q == 20 and rank == 1 for q, rank, _, _ in got) == 2
    few = df.where("vec_id < 3").select("vec_id", "embedding")
    assert op2_topk.search(few, F.col("vec_id") == 0).count() == 2
    assert op2_topk.search(few.limit(0), F.col("vec_id") == 0).count() == 0


def test_media(docs, none, texts):
    got = by_id(op3_media.media(docs))
    for i, t in enumerate(texts):
        raw = (t or "").encode()
        pad = raw + bytes(-len(raw) % 64 or (0 if raw else 64))
        r = got[i]
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(pad), hashlib.sha256(pad).hexdigest(), zlib.crc32(pad[-64:]))
        assert r["media_sha256"] == hashlib.sha256(op3_media.to_wav(pad)).hexdigest() and op3_media.from_wav(op3_media.to_wav(pad)) == pad
    again = by_id(op3_media.fingerprints(op3_media.media(docs).withColumn("wav", F.when(F.col("doc_id") != 3, F.col("wav")))))
    assert all((r["times"], r["codes"]) == ((None, None) if i == 3 else (got[i]["times"], got[i]["codes"])) for i, r in again.items())
    assert got[1]["codes"] == got[2]["codes"] and len(got[5]["times"]) == len(got[5]["codes"]) > 0
    assert op3_media.media(none).count() == 0
    n = np.arange(8192)
    bursts = sum(100 * np.exp(-(((n - at) / 300) ** 2)) * np.sin(n * 2 * np.pi * k / op3_media.FRAME) for at, k in ((2000, 32), (4000, 50)))
    assert any(int(c) >> 16 == 32 for c in op3_media.fingerprint((128 + bursts).astype(np.uint8))[1])


def test_warc(spark):
    R = "record_id long, url string, ts long, type string, etag string, last_modified string, headers array<struct<name:string,value:string>>, slice int, r int"
    rng = np.random.default_rng(4)
    data = []
    for i in range(300):
        kind = "response" if rng.random() < 0.3 else "revisit"
        url = ["http://WWW.a.org:80/x/?b=2&a=1#f", "https://a.org/x?a=1&b=2", "http://b.org/y", None][min(3, int(rng.integers(0, 13) // 4))]
        data.append((i, url, int(rng.integers(0, 60)) if rng.random() > 0.05 else None, kind, [None, '"u"', 'W/"u"', '"v"'][rng.integers(0, 4)], [None, "d1", "d2"][rng.integers(0, 3)], [("content-length", str(i)), ("date", str(i))], 1, 1))
    got = {r["record_id"]: r for r in op4_warc.resolve(spark.createDataFrame(data, R)).collect()}
    key = {None: None, "http://b.org/y": "b"}
    weak = lambda e: e and e.removeprefix("W/")
    for i, url, ts, kind, etag, lm, _, _, _ in data:
        if kind == "response":
            assert i not in got
            continue
        past = [(t, j, e, m) for j, u, t, k, e, m, *_ in data if k == "response" and t is not None and ts is not None and u and url and key.get(u, "a") == key.get(url, "a") and t < ts]
        if url is None or ts is None:
            want = ("no_url", None)
        elif not past:
            want = ("missing", None)
        else:
            _, j, e, m = max(past, key=lambda p: p[:2])
            ok = weak(etag) == weak(e) if etag else lm == m if lm else None
            want = ("unchecked" if ok is None else "resolved" if ok else "mismatch", j if ok is not False else None)
        assert (got[i]["status"], got[i]["origin_id"]) == want, (i, want)
        if want[1] is not None:
            assert {h["name"]: h["value"] for h in got[i]["headers"]} == {"content-length": str(want[1]), "date": str(i)}
    assert op4_warc.resolve(spark.createDataFrame([], R)).count() == 0


def test_html(spark):
    page = """<html><head><title>T</title><style>p{}</style><script>var t="</p><p>no";</script></head><body><header>Top</header><nav><ul><li><a href=x>Menu</a></ul></nav>
    <div class="ad-box ad">Buy</div><article><h1>Head &amp; more</h1><p><b>First
       line<br>goes &eacute;&#233; on and on for a while<p>Be.<div class="share">Like</div><p>The last paragraph of the article, long enough.</article>
    <aside>Side</aside><div id="comments"><p>I think so too</p></div><form>Mail <input></form><footer>&copy; x</footer></body></html>"""
    assert op5_html.main_text(page) == "Head & more\nFirst line goes éé on and on for a while\nBe.\nThe last paragraph of the article, long enough."
    plain = "<body><div class=menu><a>a</a><a>b</a></div><div><p>" + "Long text here. " * 9 + "<p>Short.</div><div class=footer>f</div>"
    assert op5_html.main_text(plain) == ("Long text here. " * 9).strip() + "\nShort."
    body = "".join(f"<p>Sentence number {i} of a long text that goes on.</p>" for i in range(9))
    lines = "\n".join(f"Sentence number {i} of a long text that goes on." for i in range(9))
    menu = "<ul class=menu><li><a href=x>Home</a><li><a href=y>News</a></ul>"
    for wrapped, want in [
        (f'<div class="layout sidebar-right">{menu}<div><h1>Title</h1>{body}</div></div>', "Title\n" + lines),
        (f'<div id=content class="no-sidebar"><h1>Title</h1>{body}</div><div class="sidebar">Side words</div>', "Title\n" + lines),
        (f'<article><div class="entry-header"><h1>Title</h1></div>{body}<div class=comments>{body}{body}</div></article>', "Title\n" + lines),
        (f'<article><div class="article-header"><h1>Title</h1></div>{body}<div class="related">More</div></article>', "Title\n" + lines),
        ("<body>" + menu + "".join(f"<div><p>Sentence number {i} of a long text that goes on.</p></div>" for i in range(9)) + "<section><p>End.</p></section>", lines + "\nEnd."),
    ]:
        assert op5_html.main_text(wrapped) == want
    began = time.time()
    for n in (2000, 40_000):  # no time that grows with the square of the depth
        assert op5_html.main_text("<b>" * n + "deep" + "</i>" * n + "</b>" * n + "<p>x</p>" * 50).startswith("deep")
    assert time.time() - began < 5
    df = spark.createDataFrame([(1, "u", page, "x"), (2, None, None, "x"), (3, "u", "", "x"), (4, "u", "<nav>m</nav><p", "x")], "page_id long, url string, html string, text string")
    got = {r["page_id"]: (r["n_chars"], r["text"]) for r in op5_html.extract(df).collect()}
    assert got[1][0] == len(got[1][1]) and got[2] == got[3] == (0, "") and got[4] == (0, "")
    assert op5_html.extract(df.limit(0)).count() == 0


def test_bpe_equals_the_library(spark, docs, none, texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    got = by_id(op6_bpe.encode(docs))
    for i, x in enumerate(texts):
        ids = t.encode(x or "", add_special_tokens=False).ids
        decoded = t.decode(ids, skip_special_tokens=False)
        assert got[i]["ids"] == ids and got[i]["decoded"] == decoded
        assert got[i]["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest() and got[i]["decoded_sha256"] == hashlib.sha256(decoded.encode()).hexdigest()
    assert op6_bpe.encode(none).count() == 0


def test_bpe_odd_strings():
    from tokenizers import Tokenizer

    rng = np.random.default_rng(6)
    odd = ["".join(rng.choice(list("'stredvlmabS  \n\t1²é!.-İΣ  日😀\x1c"), size=rng.integers(1, 30))) for _ in range(1500)]
    odd += ["<|startoftext|>Hi<|endoftext|> 've'", "it's 'single ''s ' 's \n's don't''ve", "ΑΣ ΣΑΣ.", "a\u1c89b \u1c89", "x\U000105c0y"]
    for file, e in (("byte_bpe_50k.json", bpe.ByteEncoder(P.path("byte_bpe_50k.json"))), ("word_bpe_49k.json", bpe.WordEncoder(P.path("word_bpe_49k.json")))):
        ids, at = e.encode(odd)
        assert [ids[at[i] : at[i + 1]].tolist() for i in range(len(odd))] == [x.ids for x in Tokenizer.from_file(P.path(file)).encode_batch(odd, add_special_tokens=False)]


def test_merges_rank_after_those_that_make_their_parts():
    e = bpe.WordEncoder(P.path("word_bpe_49k.json"))
    makes = {x: rank for rank, x in e.merges.values()}
    assert len(makes) == len(e.merges) and all(rank > makes.get(s, -1) for pair, (rank, _) in e.merges.items() for s in pair)


def test_packing(docs, none, texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    rows = op7_packing.pack(docs).collect()
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r["doc_id"]].append(r)
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for i, x in enumerate(texts):
        ids = [*t.encode(x or "", add_special_tokens=False).ids, 0]
        at = 0
        for r in sorted(pieces[i], key=lambda r: r["start"]):
            part = np.array(ids[at : at + r["length"]], "<u4").tobytes()
            assert (r["start"], r["doc_tokens"], r["ids_crc32"], bytes(r["ids"])) == (at, len(ids), zlib.crc32(part), part)
            at += r["length"]
        assert at == len(ids)
    for s in sequences.values():
        at = 0
        for offset, n in sorted(s):
            assert offset == at
            at += n
        assert at <= 1024
    assert op7_packing.pack(none).count() == 0


def test_packing_plan_holds_the_histogram():
    rng = np.random.default_rng(7)
    for n in (1, 30, 20_000):
        h = Counter(rng.integers(1, 129, n).tolist())
        plan = op7_packing.plan(dict(h), 128)
        held = Counter()
        for own, times in plan:
            assert sum(k * c for k, c in own.items()) <= 128 and times > 0
            held.update({k: c * times for k, c in own.items()})
        assert held == h
    assert sum(t for _, t in plan) <= 1.01 * sum(k * c for k, c in h.items()) / 128 + 1


def test_packing_cuts_a_length_that_fits_no_other(spark, none):
    rng = np.random.default_rng(11)
    size = lambda: 76 if rng.random() < 0.7 else int(rng.integers(60, 129))
    counts = Counter((size(), int(rng.integers(256))) for _ in range(40_000))
    split, after = op7_packing.cuts(counts, 128)
    assert split and sum(n * k for n, k in after.items()) == sum(n * k for (n, _), k in counts.items())
    assert sum(t for _, t in op7_packing.plan(dict(after), 128)) <= 1.03 * sum(n * k for n, k in after.items()) / 128
    rows = [(i, "a" + " b" * 601) for i in range(3000)]
    got = op7_packing.pack(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len({r["sequence_id"] for r in got}) * 1024 <= 1.04 * 3000 * 603 and len(got) > 3000
    by_doc = defaultdict(list)
    for r in got:
        by_doc[r["doc_id"]].append((r["start"], bytes(r["ids"])))
        assert r["ids_crc32"] == zlib.crc32(bytes(r["ids"])) and len(r["ids"]) == 4 * r["length"]
    assert len({b"".join(x for _, x in sorted(p)) for p in by_doc.values()}) == 1 and len(by_doc) == 3000


def test_substring(spark, docs, none, texts):
    spans = op8_substring.repeated(docs)
    found = by_id(spans)
    assert len(texts) - 2 in found  # the later holder of the passage loses it
    assert 5 not in found and all(i in found for i in (19, 20))  # copies of the first document
    cleaned = by_id(op8_substring.remove(docs, spans))
    assert len(cleaned) == len(texts) and all(cleaned[i]["text"] == t for i, t in enumerate(texts) if i not in found)
    inner = " ".join(texts[-2][181:-91].split()[25:45])
    assert inner in cleaned[len(texts) - 3]["text"] and inner not in cleaned[len(texts) - 2]["text"]
    assert op8_substring.repeated(none).count() == 0 and op8_substring.remove(none, spans).count() == 0


def test_paragraphs_do_not_depend_on_the_batch(texts):
    some = [t or "" for t in texts[:20]]
    together = op8_substring.paragraphs(some, 2)
    for i, t in enumerate(some):
        alone = op8_substring.paragraphs([t], 2)
        own = together[0] == i
        assert (alone is None and not own.any()) or (alone[5].tolist() == together[5][own].tolist() and alone[3][-1] == len(t.encode()))


def test_a_changed_word_does_not_hide_a_passage():
    rng = np.random.default_rng(9)
    for size in (51, 60, 70, 200):
        for _ in range(60):
            shared = [f"w{x}" for x in rng.integers(0, 10**6, size)]
            edited = list(shared)
            at = int(rng.integers(1, size - 1))
            edited[at : at + 1] = [["changed"], [shared[at], "more"], []][int(rng.integers(3))] if size > 55 else ["changed"]
            frame = lambda own: " ".join([f"a{x}" for x in rng.integers(0, 10**6, 80)] + own + [f"b{x}" for x in rng.integers(0, 10**6, 80)])  # noqa: B023, E731
            w = common.Words([frame(edited), frame(shared)], ascii_only=True)
            k, o, mark = op8_substring.seeds(w, 51)
            d, h = w.hash[: w.offset[1]], w.hash[w.offset[1] :]
            found = op8_substring.passages(d, h, k[: o[1]], k[o[1] :], 0.8, 51)
            assert len(found) == 1 and set(k[: o[1]][mark[: o[1]]]) & set(k[o[1] :][mark[o[1] :]])
            a, b, c, e = found[0]
            assert 78 <= a <= 83 and abs(b - 80 - len(edited)) <= 3 and e - c > 50


def test_a_passage_of_fifty_words_stays_and_edits_leave_whole(spark):
    rng = np.random.default_rng(10)
    words = lambda n: [f"w{x}" for x in rng.integers(0, 10**6, n)]
    long, short = words(60), words(50)
    edited = long[:30] + ["changed"] + long[31:]
    rows = [(1, words(70) + long + words(70)), (2, words(70) + edited + words(70)), (3, words(40) + short + words(40)), (4, words(50) + short + words(50))]
    d = spark.createDataFrame([(i, " ".join(t)) for i, t in rows], "doc_id long, text string")
    spans = op8_substring.repeated(d)
    assert {r["doc_id"]: [s["words"] for s in r["spans"]] for r in spans.collect()} == {2: [60]}
    assert by_id(op8_substring.remove(d, spans))[2]["text"] == " ".join(rows[1][1][:70] + rows[1][1][130:])


def test_passages_against_all_pairs_that_share_a_seed(spark):
    """Passages with edits, in documents that also share short lines: nothing is removed beyond the full comparison, and little is missed."""
    rng = np.random.default_rng(14)
    words = lambda n: [f"w{x}" for x in rng.integers(0, 10**6, n)]
    shared, lines = [words(int(n)) for n in rng.integers(45, 120, 12)], [words(30) for _ in range(4)]
    rows = []
    for i in range(240):
        own = words(60)
        for _ in range(int(rng.integers(0, 4))):
            part = list(shared[int(rng.integers(12))] if rng.random() < 0.6 else lines[int(rng.integers(4))])
            if rng.random() < 0.4:
                part[int(rng.integers(len(part)))] = "changed"
            own += part + words(int(rng.integers(5, 40)))
        rows.append((i, " ".join(own)))
    w = common.Words([t for _, t in rows], ascii_only=True)
    found, at, mark = op8_substring.seeds(w, 51)
    seeds = [set(found[at[i] : at[i + 1]][mark[at[i] : at[i + 1]]].tolist()) for i in range(240)]
    hashes = [w.hash[w.offset[i] : w.offset[i + 1]] for i in range(240)]
    want = {}
    for i in range(240):
        gone = np.zeros(len(hashes[i]), dtype=bool)
        for j in range(i):
            if seeds[i] & seeds[j]:
                for a, b, _, _ in op8_substring.passages(hashes[i], hashes[j], found[at[i] : at[i + 1]], found[at[j] : at[j + 1]], 0.8, 51):
                    gone[a:b] = True
        want[i] = int(gone.sum())
    got = {r["doc_id"]: sum(s["words"] for s in r["spans"]) for r in op8_substring.repeated(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(got.get(i, 0) <= n for i, n in want.items())
    assert sum(n > 0 for n in want.values()) > 100 and sum(got.values()) >= 0.97 * sum(want.values())


def test_licenses(spark, none):
    d = spark.createDataFrame([(1, "text\nReleased under the MIT License.\nReleased  under the MIT LICENSE", 1), (2, None, 1), (3, "", 1), (4, "released under the new mit license", 1), (5, "x " * 5000, 1)], "doc_id long, text string, line long")
    got = sorted(tuple(r) for r in op9_licenses.scan(d).collect())
    a, b = set(op9_licenses.bigrams("released under the new mit license")), set(op9_licenses.bigrams("Released under the MIT License."))
    assert got == [(1, "MIT", 2, 1, 1.0)] and 2 * len(a & b) / (len(a) + len(b)) < 0.8
    assert op9_licenses.scan(none).count() == 0


def test_licenses_that_are_no_lines_of_their_own(spark):
    import textwrap

    full = {name: op9_licenses.MORE[name][0] for name in ("MIT", "BSD-2-Clause", "BSD-3-Clause", "ISC")}
    rows = [
        (1, "This sample code is free to use. Released under the MIT License."),
        (2, "a\nThis work is licensed under the GNU General\nPublic License, version 3.\nb"),
        (3, "Intro words\n" + "\n".join(textwrap.wrap(full["MIT"], 60))),
        (4, "Licensed under CC BY-NC 4.0."),
        (5, "plain words about a license that permits nothing in particular"),
        (6, "\n".join(textwrap.wrap(full["BSD-3-Clause"], 60))),
        (7, "Released under the MIT License. Then other words stand between. Released under the MIT License."),
    ]
    got = {(r["doc_id"], r["license"]): (r["n_lines"], r["line_no"], r["dice"]) for r in op9_licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1, "MIT"] == (1, 0, 1.0) and got[2, "GPL-3.0"] == (1, 1, 1.0) and got[4, "CC-BY-NC-4.0"] == (1, 0, 1.0)
    assert got[3, "MIT"][1:] == (1, 1.0) and got[6, "BSD-3-Clause"] == (1, 0, 1.0) and got[7, "MIT"][0] == 2
    assert not any(i == 5 for i, _ in got)


def test_licenses_equal_every_window_in_sql(spark):
    """Templates whole and in parts, with words changed, wrapped at random, beside and inside other words."""
    import duckdb

    rng = np.random.default_rng(13)
    every = [t for d in (op9_licenses.TEMPLATES, op9_licenses.MORE) for ts in d.values() for t in ts]
    rows = [(0, None), (1, ""), (2, "one"), (3, every[0])]
    for i in range(10, 90):
        words = []
        for _ in range(int(rng.integers(1, 4))):
            own = every[int(rng.integers(len(every)))].split()
            for at in rng.integers(0, len(own), int(rng.integers(0, 1 + len(own) // 12))):
                own[int(at)] = str(rng.choice(["other", "the", ""]))
            cut = int(rng.integers(0, 1 + len(own) // 6))
            words += list(rng.choice(WORDS, int(rng.integers(0, 12)))) + own[cut:]
        rows.append((i, "".join(w + str(rng.choice([" ", "\n", "  ", ". "], p=[0.8, 0.12, 0.04, 0.04])) for w in words)))
    documents = spark.createDataFrame(rows, "doc_id long, text string").toPandas()
    got = sorted(tuple(r) for r in op9_licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    con = duckdb.connect()
    con.register("documents", documents)
    assert got == sorted(con.execute(op9_licenses.oracle()).fetchall()) and len(got) > 60


def test_near_duplicates(spark, docs, none, texts):
    got = by_id(op10_icws.near_duplicates(docs))
    df, n = op10_icws.document_frequencies(docs)
    idf = 1 + np.log((1 + n) / (1 + df))
    plain = [t or "" for t in texts]
    found, weight, at = op10_icws.weighted_sets(plain, idf)
    sets = [dict(zip(found[at[i] : at[i + 1]].tolist(), weight[at[i] : at[i + 1]].tolist(), strict=True)) for i in range(len(plain))]
    leader = list(range(len(plain)))
    for a, b in itertools.combinations(range(len(plain)), 2):
        x, y = sets[a], sets[b]
        both, whole = sum(min(x[k], y[k]) for k in x.keys() & y.keys()), sum(max(x.get(k, 0), y.get(k, 0)) for k in x.keys() | y.keys())
        if plain[a] == plain[b] or (whole and both / whole >= 0.8):
            old, new = leader[b], leader[a]
            leader = [new if v == old else v for v in leader]
    first = {v: leader.index(v) for v in leader}
    assert {i: r["class_id"] for i, r in got.items()} == {i: first[v] for i, v in enumerate(leader)}
    kept = op10_icws.stage(spark, docs, "")
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(set(first.values())) and kept.columns == docs.columns
    assert op10_icws.near_duplicates(none).count() == 0


def test_large_bucket_of_near_copies(spark):
    rng = np.random.default_rng(8)
    base = prose(rng, 300).split()
    rows = []
    for i in range(60):
        w = list(base)
        w[int(rng.integers(300))] = f"x{i}"
        rows.append((i, " ".join(w)))
    got = op10_icws.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["class_id"] for r in got} == {0} and {r["class_size"] for r in got} == {60}


def test_hot_buckets_keep_their_links(spark):
    """Copies with none to nine edits of one base, copies of copies, and different texts with one long common passage."""
    rng = np.random.default_rng(12)
    base, passage = prose(rng, 140).split(), prose(rng, 60)
    plain = []
    for i in range(220):
        w = list(base) if i < 150 or i % 2 else plain[int(rng.integers(150))].split()
        for at in rng.integers(0, len(w), int(rng.integers(0, 10))):
            w[int(at)] = f"x{i}y{at}"
        plain.append(" ".join(w))
    plain += [f"{prose(rng, int(rng.integers(8, 60)))} {passage} {prose(rng, 8)}" for _ in range(120)]
    docs = spark.createDataFrame(list(enumerate(plain)), "doc_id long, text string")
    got = {i: r["class_id"] for i, r in by_id(op10_icws.near_duplicates(docs)).items()}
    df, n = op10_icws.document_frequencies(docs)
    found, weight, at = op10_icws.weighted_sets(plain, 1 + np.log((1 + n) / (1 + df)))
    sets = [op10_icws._sorted(found[at[i] : at[i + 1]], weight[at[i] : at[i + 1]]) for i in range(len(plain))]
    links = [(a, b) for a, b in itertools.combinations(range(len(plain)), 2) if plain[a] == plain[b] or op10_icws.weighted_jaccard(sets[a], sets[b]) >= 0.8]
    leader = list(range(len(plain)))
    for a, b in links:
        if leader[a] != leader[b]:
            old, new = max(leader[a], leader[b]), min(leader[a], leader[b])
            leader = [new if x == old else x for x in leader]
    together = sum(got[a] == got[b] for a, b in links)
    assert len(links) > 500 and together >= 0.995 * len(links)
    assert all(leader[i] == leader[c] for i, c in got.items())  # no class joins what no chain of links joins
    print(f"{together} of {len(links)} links; {len(set(got.values()))} classes, {len(set(leader))} by brute force")
