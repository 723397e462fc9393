"""Each opN query against a brute-force version, on rows with nulls, empty, odd and repeated texts and clashing columns."""

import hashlib
import random
import re
import struct
import time
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer
from xxhash import xxh64_intdigest

from tarnbridge.llm import arrow_files, html_blocks, imatch, licenses, mixing, near_copies, packing, quality, queries, sharding, token_ids, train_blocks, urls

LONG = " ".join(f"word{i % 997} and" for i in range(4000))
BASE = " ".join(f"alpha{i} beta{i % 7}" for i in range(120))
TEXTS = [
    None, "", " \n\t ", "One", "two words", "Licensed under the MIT License. mit  license, MIT-LICENSE", "the GNU General Public License\nGeneral public license", "É ÀB apache\xa0license Apache License",
    BASE, BASE, BASE.replace("alpha7 ", "gamma "), BASE + " tail", LONG, "a\nb\na\n\n\nb \na", "x # y $ z <|endoftext|> don't STOP  now   ", "same words " * 40,
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this Software and associated documentation files (the Software), to deal in the software without any restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
    "über straße ÜBER Straße ça l'été 12 34\r\n", "日本語 テキスト です",
]
ROWS = [(i * 3 + 1, t, "en" if i % 2 else None, f"src{i % 6}", i, "clash", 1) for i, t in enumerate(TEXTS)]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, fp string, shard int"


@pytest.fixture(scope="module")
def sf(spark, tmp_path_factory):
    """The folder of a small copy of the tables."""
    top = tmp_path_factory.mktemp("sf")
    spark.createDataFrame(ROWS, SCHEMA).repartition(3).write.parquet(f"{top}/documents.parquet")
    spark.createDataFrame([(r[0], r[0] % 2, 0) for r in ROWS], "doc_id long, quality int, toxic int").write.parquet(f"{top}/labels.parquet")
    urls_ = [None, "", "no scheme/en/", "HTTP://WWW.Example.COM/en/7?x#y", "https://example.com/en/8", "http://a.net/de/1", "http://example.net/de/8/z", "http://x.org/es/", "http://xorg/es/", "http://cheap-pills.biz/", "http://ok.biz/freedom", "http://ok.biz/free/win", "http://h.biz?casino", "ftp://u.org#frag/es/"]
    pages = [(i, u, h, 5) for i, (u, h) in enumerate(zip(urls_, [None, "", "<p>"] + [PAGE] * (len(urls_) - 3), strict=True))]
    spark.createDataFrame(pages, "page_id long, url string, html string, n_chars int").write.parquet(f"{top}/pages.parquet")
    empty = f"{top}/empty"
    for t, s in (("documents", SCHEMA), ("labels", "doc_id long, quality int, toxic int"), ("pages", "page_id long, url string, html string")):
        spark.createDataFrame([], s).write.parquet(f"{empty}/{t}.parquet")
    return str(top)


PAGE = (
    "<!DOCTYPE html><html><head><title>No</title><style>p{}</style><script>var t='</p>';</script></head><body><nav><ul><li><a href=/a>Home</a></li><li><a href=/b>News</a></li></ul></nav>"
    "<div class=\"ad\">Buy this one now.</div><article><h1>A &amp; B&#39;s title</h1><p><b>First   paragraph\n of the story.<br><p>Second one, with <i>more</i> words &lt;here&gt;.</p></article>"
    "<section class='comments'><h3>Comments</h3><div class='comment'><p>First!</p></div></section><footer>&copy; nobody</footer>"
)


def rows(spark, sf, name):
    return queries.QUERIES[name](spark, sf).collect()


def test_license_scan(spark, sf):
    got = {r["doc_id"]: r for r in rows(spark, sf, "op1_license_scan")}
    assert len(got) == len(ROWS)
    for doc_id, text, *_ in ROWS:
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
        places = [(i, label) for phrase, label in licenses.PHRASES.items() for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split()]
        r = got[doc_id]
        starts = [i for i, _ in places]
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"]) == (len(words), len(places), min(starts, default=None), max(starts, default=None))
        assert r["base_labels"] == ",".join(sorted({x for _, x in places}))
        assert set(filter(None, r["base_labels"].split(","))) <= set(filter(None, r["labels"].split(",")))
    near = got[ROWS[16][0]]
    assert near["labels"] == "mit" and near["base_labels"] == "" and 0.8 < near["score"] < 1  # a word put in and one left out


def test_license_scan_finds_short_creative_commons_forms(spark):
    texts = {"Licensed under CC BY-NC 4.0.": "cc-by-nc", "CC BY 4.0": "cc-by", "x cc-by-sa y CC BY": "cc-by,cc-by-sa", "cc by nc sa": "cc-by-nc-sa", "cc and by": "", "MIT License, CC BY-ND": "cc-by-nd,mit"}
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = sorted(licenses.scan_licenses(docs).collect(), key=lambda r: r["doc_id"])
    assert [r["labels"] for r in got] == list(texts.values()) and [r["score"] for r in got] == [1, 1, 1, 1, 0, 1]
    assert [(r["base_labels"], r["n_base"]) for r in got] == [("", 0)] * 5 + [("mit", 1)]


def _brute_spans(text):
    """(label, start, end, share) of passages, from all hits, diagonal by diagonal."""
    words = [w for w in re.split(licenses.NOT_WORD, text.lower()) if w]
    out = []
    for label, passage in licenses.PASSAGES.items():
        own = [w for w in re.split(licenses.NOT_WORD, passage.lower()) if w]
        grams = {i: g for i, g in enumerate(zip(own, own[1:], strict=False)) if not set(g) <= licenses.COMMON}
        hits = sorted((p, t) for p, g in enumerate(zip(words, words[1:], strict=False)) for t, h in grams.items() if g == h)
        spans = {}
        for d in {p - t for p, t in hits}:
            n, last_p, last_t = 0, -1, -1
            for p, t in hits:
                if d <= p - t <= d + licenses.SLACK and t > last_t and p > last_p:
                    n, last_p, last_t = n + 1, p, t
            spans[d] = (n / len(grams), last_p + 1)
        for d, (share, end) in spans.items():
            around = [(s if s >= licenses.ENOUGH else 0, -e) for e, (s, _) in spans.items() if abs(e - d) <= licenses.SLACK]
            if share >= licenses.ENOUGH and (share, -d) == max(around):
                out.append((label, max(d, 0), end, round(share, 4)))
    return sorted(out)


def test_license_spans_are_verified_in_order(spark):
    bsd = [w for w in re.split(licenses.NOT_WORD, licenses.PASSAGES["bsd"]) if w]
    filler = " ".join(f"{a} {b} filler" for a, b in zip(bsd[::2], bsd[1::2], strict=False))
    halves = " ".join(bsd[len(bsd) // 2 :] + bsd[: len(bsd) // 2])
    one_more = " ".join(["intro", *bsd[:20], "really", *bsd[20:], "and", "more"])
    twice = " ".join([*bsd, "then", "again", *bsd])
    rng, texts = random.Random(2), [filler, halves, one_more, twice]
    for _ in range(60):
        words = rng.choice(list(licenses.PASSAGES.values())).split()
        for _ in range(rng.randrange(8)):
            at = rng.randrange(len(words))
            words[at : at + 1] = rng.choice([[], ["x", words[at]], ["y"]])
        texts.append(" ".join(["pre"] * rng.randrange(5) + words))
    got = {r["doc_id"]: r for r in licenses.scan_licenses(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert got[0]["labels"] == got[1]["labels"] == "" and got[2]["labels"] == got[3]["labels"] == "bsd" and len(got[3]["spans"]) == 2
    assert (got[2]["spans"][0]["start"], got[2]["spans"][0]["end"]) == (1, len(bsd) + 1)
    for i, text in enumerate(texts):
        assert sorted(tuple(x) for x in got[i]["spans"] if x["label"] in licenses.PASSAGES and x["share"] < 1 or x["end"] - x["start"] > 4) == _brute_spans(text)


def test_license_scan_keeps_repeated_rows(spark):
    twice = spark.createDataFrame([(1, "MIT License")] * 2 + [(None, None)], "doc_id long, text string")
    assert sorted((r["doc_id"] or 0, r["n_base"]) for r in licenses.scan_licenses(twice).collect()) == [(0, 0), (1, 1), (1, 1)]


def test_packing(spark, sf):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    got = rows(spark, sf, "op2_best_fit_packing")
    by_doc, bins = {}, {}
    for r in got:
        by_doc.setdefault(r["doc_id"], []).append(r)
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for doc_id, text, *_ in ROWS:
        ids, at = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 2], 0
        for i, r in enumerate(sorted(by_doc[doc_id], key=lambda r: r["piece"])):
            assert (r["piece"], r["start"]) == (i, at)
            assert r["length"] == 1024 or i == 0
            assert r["ids_crc32"] == zlib.crc32(np.array(ids[at : at + r["length"]], "<u4").tobytes())
            at += r["length"]
        assert at == len(ids)
    for parts in bins.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= 1024
    total = sum(r["length"] for r in got)
    assert len(bins) <= -(-total // 1024) + 4


def test_best_fit_is_bounded_and_fills():
    rng, best, lengths = np.random.default_rng(1), packing.BestFit(1024, 256), None
    lengths = rng.integers(1, 1025, 20_000).tolist()
    fill = Counter()
    for n in lengths:
        number, offset = best.place(n)
        assert fill[number] == offset
        fill[number] += n
        assert best.n_open <= 256 and sum(map(len, best.bins)) == best.n_open
    assert sum(lengths) / (1024 * len(fill)) > 0.97
    with pytest.raises(ValueError):
        best.place(1025)


def test_fingerprints_and_edits(spark, sf):
    got = {r["doc_id"]: r for r in rows(spark, sf, "op3_document_fingerprints")}
    order = sorted(ROWS, key=lambda r: -r[0])
    for k, (doc_id, text, *_) in enumerate(order):
        text, following = text or "", order[(k + 1) % len(order)][1] or ""
        n = len(text) // 3
        edited = text[: len(text) - n] + following[:n]
        r = got[doc_id]
        assert r["n_chars"] == len(text) and r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert 0 <= r["near_edited"] <= 1 and (r["fingerprint"] != r["edited_fingerprint"] or r["near_edited"] == 1)
        nxt = got[order[(k + 1) % len(order)][0]]
        assert (r["near_next"] == 1) == (r["fingerprint"] == nxt["fingerprint"])
    assert got[25]["fingerprint"] == got[28]["fingerprint"] and got[25]["near_next"] < 1


def test_edits_across_runs(spark, monkeypatch):
    """Runs of two documents: the ends of runs, ids far apart and a null id."""
    monkeypatch.setattr(imatch, "RUN", 2)
    data = [(i * i * i, f"text {i} " + "abc def ghi "[: i % 11] * i) for i in range(40)] + [(None, "last of all")]
    got = {r["doc_id"]: r for r in imatch.compare_with_edits(spark.createDataFrame(data, "doc_id long, text string")).collect()}
    order = sorted(data[:-1], key=lambda r: -r[0]) + data[-1:]
    for k, (doc_id, text) in enumerate(order):
        following, n = order[(k + 1) % len(order)][1], len(text) // 3
        assert got[doc_id]["edited_sha256"] == hashlib.sha256((text[: len(text) - n] + following[:n]).encode()).hexdigest()


def _brute_fingerprint(text, band):
    """As Spark hashes: XXH64 of UTF-8, of 8 bytes a long, of 4 bytes an int, each with the hash before as seed."""
    signed = lambda h: h - (1 << 64) if h >> 63 else h
    n = 1 + imatch.LEVELS * imatch.REPLICAS
    hashes = sorted(signed(h) for h in {xxhash.xxh64_intdigest(t.encode(), 42) for t in re.split("[\\x00-\\x2f\\x3a-\\x60\\x7b-\\x7f]+", text.lower()) if t in band})
    if not hashes:
        return [xxhash.xxh64_intdigest(text.lower().encode(), 42)] * n

    def digest(some, replica):
        seed = 42
        for h in some:
            seed = xxhash.xxh64_intdigest(struct.pack("<q", h), seed)
        return xxhash.xxh64_intdigest(struct.pack("<i", replica), seed) if some else None

    out = [digest(hashes, 0)]
    for level in range(1, imatch.LEVELS + 1):
        out += [digest([h for h in hashes if not (h >> (imatch.LEVELS * r)) & ((1 << level) - 1)], r) for r in range(imatch.REPLICAS)]
    return out


def test_fingerprints_by_brute_force(spark):
    rng = random.Random(5)
    data = [(i, " ".join(f"W{rng.randrange(40) ** 2}x" for _ in range(rng.randrange(60)))) for i in range(60)] + [(99, None), (100, "only here"), (None, "w1x W4X none")]
    texts = [t or "" for _, t in data]
    df = Counter(t for x in texts for t in set(re.findall("[a-z0-9]+", x.lower())))
    band = {t for t, k in df.items() if max(2, round(0.05 * len(texts))) <= k <= max(2, 0.4 * len(texts))}
    got = {r["doc_id"]: r for r in imatch.compare_with_edits(spark.createDataFrame(data, "doc_id int, text string"), 0.05, 0.4).collect()}
    order = sorted(data[:-1], key=lambda r: -r[0]) + data[-1:]
    shown = lambda fp: ".".join("-" if h is None else f"{h:016x}" for h in fp)

    def likeness(a, b):
        either = [(x, y) for x, y in zip(a, b, strict=True) if x is not None or y is not None]
        return sum(x == y for x, y in either) / len(either)

    assert len(got) == len(data) and len(band) > 10
    for k, (doc_id, text) in enumerate(order):
        text, following = text or "", order[(k + 1) % len(order)][1] or ""
        n = len(text) // 3
        a, b, c = (_brute_fingerprint(x, band) for x in (text, text[: len(text) - n] + following[:n], following))
        r = got[doc_id]
        assert (r["fingerprint"], r["edited_fingerprint"]) == (shown(a), shown(b))
        assert (r["near_edited"], r["near_next"]) == (likeness(a, b), likeness(a, c))


def test_runs_are_of_like_size_however_ids_cluster(spark):
    ids = [*range(3000), *(10**12 + 7 * i for i in range(3000)), *(-(2**60) + i for i in range(50)), *[None] * 500]
    rows = spark.createDataFrame([(i, k * 2654435761 % 2**63 * (-1) ** k) for k, i in enumerate(ids)], "i long, t long")
    runs = imatch.in_runs(rows, "i", "t", 50).collect()
    sizes = Counter(r["run"] for r in runs if not r["ghost"])
    assert sum(sizes.values()) == len(ids) and max(sizes.values()) <= 200 and sum(r["ghost"] for r in runs) <= 2 * len(sizes) + 60


def test_html_extraction(spark, sf):
    got = {r["page_id"]: r for r in rows(spark, sf, "op4_html_extraction")}
    assert got[0]["text"] == got[1]["text"] == got[2]["text"] == ""
    want = "A & B's title\n\nFirst paragraph of the story.\n\nSecond one, with more words <here>."
    assert all(got[i]["text"] == want and got[i]["n_chars"] == len(want) for i in range(3, len(got)))
    blocks_right, _ = train_blocks.accuracy(html_blocks.load_weights(), pages=150, seed=4321)
    assert blocks_right > 0.98


def test_html_is_read_in_linear_time():
    """Pages of 1 MB whose tags are left open, and deep ones."""
    for unit in ("<svg>x", '<a href="x', "<div>y ", "</b>z", "<!--", "<object>w<p>v", "<![CDATA[", "<title", "<p title='\">q", "</script>u", "<i>t", "<", "<p "):
        page = "<body>" + unit * (1_000_000 // len(unit))
        began = time.process_time()
        html_blocks.blocks(page)
        assert time.process_time() - began < 12, unit


def test_html_keeps_formulas():
    assert [b.text for b in html_blocks.blocks("<p>a <math><mi>x</mi></math> b<p>c")] == ["a x b", "c"]


def test_html_with_elements_left_open():
    """Neither a head without its end tag nor an unclosed element that is not raw text takes the rest of the page."""
    texts = lambda page: [b.text for b in html_blocks.blocks(page)]
    assert texts("<html><head><title>x</title><meta charset=a><style>p{}</style><p>First.<p>Second.") == ["First.", "Second."]
    assert [b.path for b in html_blocks.blocks("<html><head><title>x</title><p>First.")] == [b.path for b in html_blocks.blocks("<html><p>First.")]
    for tag in ("svg", "object", "video", "audio", "canvas", "math", "noscript", "template"):
        assert texts(f"<p>First.</p><{tag} a=b><p>Second.</p>")[-1] == "Second.", tag
        if tag != "math":  # a formula is text
            assert texts(f"<p>First.</p><{tag}>silent</{tag}><p>Second.</p>") == ["First.", "Second."], tag
    for tag in ("script", "style", "textarea", "title", "iframe"):
        assert texts(f"<p>First.</p><{tag}>silent <p>still") == ["First."], tag


def test_token_files(spark, sf):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    got, start = {r["doc_id"]: r for r in rows(spark, sf, "op5_token_files")}, 0
    for doc_id, text, *_ in ROWS:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 2]
        r = got[doc_id]
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


def test_sequence_files_give_random_access(tmp_path):
    fs, _ = arrow_files._open(f"file://{tmp_path}")
    ids = np.arange(10_000) % 50_000
    w = arrow_files.SequenceWriter(fs, f"{tmp_path}/a.arrow", 16, "uint16")
    for at in range(0, len(ids), 777):
        w.append(ids[at : at + 777])
    w.close()
    f = arrow_files.SequenceFile(fs, f"{tmp_path}/a.arrow")
    seq, mask = f.sequence(100)
    assert seq.tolist() == ids[1600:1616].tolist() and mask.all() and not seq.flags.owndata
    seq, mask = f.sequence(624)
    assert f.ids(5, 9_000).tolist() == ids[5:9005].tolist()


ODD_TEXTS = ["a\x85b", "x  y", " lead", "don't can't I'LL", "Ünd...ÉTÉ, ok?!", "\x1c a", "İstanbul Σας", "\x01 \x02", "a \n\n b\n", "<|endoftext|> x", "e\u0301.", "it's.'s, | a|b", "trail ", "\t", "ß, Ä!", "9a. a9, x_y;"]


def test_units_equal_the_library_whole():
    rng = random.Random(3)
    bits = [*"aZé ß.,'|#\n\t\u00a0\u0301\x01", "  ", "the", " The", "ing ", "<|", "123", "don't", "日本", "\r\n"]
    texts = [t or "" for t in TEXTS] + ODD_TEXTS + ["".join(rng.choices(bits, k=rng.randrange(30))) for _ in range(2000)]
    for path, kind in (("byte_bpe_50k.json", "byte"), ("word_bpe_49k.json", "word")):
        e = token_ids.UnitEncoder(public_tokenizers.path(path), kind)
        want = e.whole(texts)
        for most in (200, 10**6):  # anew in small parts, then all known
            batch = pa.record_batch([pa.array([*texts, None])], names=["t"])
            parts = [e.encode(p.column(0)) for p in token_ids.slices(batch, 0, most)]
            ids, sizes = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
            assert [x.tolist() for x in np.split(ids, np.cumsum(sizes)[:-1])] == [*want, []]
            assert e.counts(pa.array(texts)).tolist() == [len(x) for x in want]


def test_encoder_refuses_another_kind():
    for path, kind in (("byte_bpe_50k.json", "word"), ("byte_bpe_50k.json", "piece")):
        with pytest.raises(ValueError, match="kind"):
            token_ids.UnitEncoder(public_tokenizers.path(path), kind)


def test_encoder_forgets(monkeypatch):
    monkeypatch.setattr(token_ids, "MOST_UNITS", 50)
    e = token_ids.UnitEncoder(public_tokenizers.path("byte_bpe_50k.json"), "byte")
    for i in range(20):
        texts = [f"word{i} and other{j}, here" for j in range(30)]
        assert [x.tolist() for x in np.split(*[f(x) for f, x in zip((lambda a: a, lambda n: np.cumsum(n)[:-1]), e.encode(pa.array(texts)), strict=True)])] == e.whole(texts)
        assert len(e.known) < 200


def test_pieces_are_cut_as_said():
    for n in (1, 7, 8, 9, 16, 17):
        row, piece, start, length = (x.tolist() for x in packing.cut_into_pieces(np.array([n]), 8))
        assert sum(length) == n and piece == list(range(len(row))) and start == [sum(length[:i]) for i in range(len(row))] and all(x == 8 for x in length[1:])


def test_ids_too_large_for_the_file(tmp_path):
    fs, _ = arrow_files._open(f"file://{tmp_path}")
    w = arrow_files.SequenceWriter(fs, f"{tmp_path}/a.arrow", 16, "uint16")
    with pytest.raises(ValueError, match="70000"):
        w.append(np.array([1, 70_000], np.uint32))


def test_mixing_budgets():
    supply = {("a", "x"): 100, ("a", "y"): 10, ("b", "x"): 1000}
    out = mixing.allocate(supply, {("a",): 1, ("b",): 1}, 200)
    assert out == {("a", "x"): 90, ("a", "y"): 10, ("b", "x"): 100}  # the shortage of a/y goes to its sibling
    out = mixing.allocate(supply, {("a",): 3, ("b",): 1}, 800)
    assert out == {("a", "x"): 100, ("a", "y"): 10, ("b", "x"): 690}  # what all of a lacks goes to b
    assert sum(mixing.allocate(supply, {}, 10**9).values()) == 1110


def test_mixing_budgets_with_a_zero_weight():
    supply = {("web", "de"): 900, ("web", "en"): 100, ("forum", "en"): 1000}
    out = mixing.allocate(supply, {("web", "de"): 0}, 800)
    assert out == {("web", "de"): 0, ("web", "en"): 100, ("forum", "en"): 700}  # what web cannot give goes to forum
    assert sum(mixing.allocate(supply, {("web", "de"): 0}, 10**9).values()) == 1100
    assert mixing.allocate(supply, {("web",): 0}, 1500) == {("web", "de"): 0, ("web", "en"): 0, ("forum", "en"): 1000}


def test_mixing(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for share, epochs in ((1.0, 4), (0.5, 1), (2.5, 3)):
        got = mixing.mix(docs, queries.domain_of(docs["source"]), queries.WEIGHTS, share=share, max_epochs=epochs, run=2).collect()
        leaf = lambda r: (r["__domain"], r["lang"] or "", r["source"])
        taken, size, all_of = Counter(), {}, Counter()
        for doc_id, text, lang, source, *_ in ROWS:
            size[doc_id] = max(1, -(-len((text or "").encode()) // 4))
            all_of["web", lang or "", source] += size[doc_id]
        budgets = mixing.allocate({k: v * epochs for k, v in all_of.items()}, queries.WEIGHTS, int(share * sum(all_of.values())))
        for r in got:
            taken[leaf(r)] += r["__tokens"]
            assert r["__epoch"] < epochs and r["__tokens"] == size[r["doc_id"]] and r["__budget"] == budgets[leaf(r)]
        assert len({(r["doc_id"], r["__epoch"]) for r in got}) == len(got)
        for k, b in budgets.items():
            assert taken[k] <= b and b - taken[k] <= max(size[d] for d, t, la, s, *_ in ROWS if ("web", la or "", s) == k)


def _spark_hash(*values):
    """xxhash64(...) of longs, ('int', n) and strings; nulls are passed over."""
    seed = 42
    for v in values:
        if v is not None:
            data = v.encode() if isinstance(v, str) else struct.pack("<i", v[1]) if isinstance(v, tuple) else struct.pack("<q", v)
            seed = xxhash.xxh64_intdigest(data, seed)
    return seed


def test_mixing_takes_the_prefix_of_each_epochs_own_order(spark):
    rng = random.Random(11)
    signed = lambda h: h - (1 << 64) if h >> 63 else h
    data = [(i, f"text {i % 70}", rng.choice("ab"), rng.choice("xy"), rng.randrange(1, 9)) for i in range(400)] + [(None, None, "a", "x", 5), (7, "twice", "a", "x", 2), (7, "twice", "a", "x", 2)]
    docs = spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n long")
    for share in (0.3, 1.7):
        got = mixing.mix(docs, F.lit("d"), {("d", "a"): 3.0}, share=share, max_epochs=3, tokens=F.col("n"), run=8).collect()
        supply = Counter()
        for _, _, la, so, n in data:
            supply["d", la, so] += n
        want = Counter()
        for (dom, la, so), b in mixing.allocate({k: 3 * v for k, v in supply.items()}, {("d", "a"): 3.0}, int(share * sum(supply.values()))).items():
            mine = [d for d in data if d[2:4] == (la, so)]
            whole, rest = divmod(b, supply[dom, la, so])
            want.update((d[0], d[1], e) for d in mine for e in range(whole))
            for d in sorted(mine, key=lambda d: _spark_hash(("int", 17), whole, d[0], signed(_spark_hash(d[1])))):
                rest -= d[4]
                if rest < 0:
                    break
                want[d[0], d[1], whole] += 1
        assert Counter((r["doc_id"], r["text"], r["__epoch"]) for r in got) == want


def test_mixing_with_clashing_names_and_no_rows(spark):
    docs = spark.createDataFrame([(1, "a b", None, None, "old", {"k": 1}, 3.5), (2, None, "en", "s", "old", {"k": 2}, 4.5)], "doc_id long, text string, lang string, source string, __domain string, m map<string,int>, `a.b` double")
    got = mixing.mix(docs, F.lit(None).cast("string"), {}, share=1.0)
    assert got.columns == ["doc_id", "text", "lang", "source", "m", "a.b", "__domain", "__epoch", "__tokens", "__budget"]
    assert sorted((r["doc_id"], r["a.b"], r["__domain"], r["m"]["k"]) for r in got.collect()) == [(1, 3.5, "", 1), (2, 4.5, "", 2)]
    assert mixing.mix(docs.limit(0), F.lit("d"), {}, share=1.0).count() == 0


def test_mixing_counts_real_tokens(spark, sf):
    """op6's n_tokens and the pipeline's budgets are ids of the packing stage's tokenizer, not bytes over 4."""
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    size = {d: len(library.encode(t or "", add_special_tokens=False).ids) + 1 for d, t, *_ in ROWS}
    got = rows(spark, sf, "op6_source_mixing")
    supply = Counter()
    for doc_id, _, lang, source, *_ in ROWS:
        supply["web", lang or "", source] += size[doc_id]
    budgets = mixing.allocate({k: 4 * v for k, v in supply.items()}, queries.WEIGHTS, sum(supply.values()))
    assert got and all(r["n_tokens"] == size[r["doc_id"]] and r["leaf_budget"] == budgets[r["domain"], r["lang"] or "", r["source"]] for r in got)
    packed = Counter()
    for r in rows(spark, sf, "op2_best_fit_packing"):
        packed[r["doc_id"]] += r["length"]
    assert all(r["n_tokens"] == packed[r["doc_id"]] for r in got)


def test_quality_rules_do_not_depend_on_the_order_of_rows(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    want = quality.fit(docs, labels)
    assert want
    for seed in (1, 2):
        again = labels.union(labels.limit(50)).orderBy(F.rand(seed))
        assert quality.fit(docs.union(docs.limit(100)).repartition(7).orderBy(F.rand(seed)), again) == want


def test_quality_verdicts_by_brute_force(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet") for t in ("documents", "labels"))
    rules = quality.fit(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet"))
    got = {r["doc_id"]: r for r in quality.judge(docs, rules).collect()}
    for r in docs.collect():
        m = dict(zip((*quality.COUNTS, *quality.MORE), quality.measure(r["text"] or ""), strict=True))
        first = next((k for k, rule in enumerate(rules, 1) if all((m[quality.FEATURES[c.feature][0]] / max(m[quality.FEATURES[c.feature][1]], 1) >= c.value) == c.above for c in rule.conditions)), None)
        base = m["n_words"] < 50 or 100 * m["n_repeat_words"] > 50 * m["n_words"]
        assert (got[r["doc_id"]]["base_failed"], got[r["doc_id"]]["rule"], got[r["doc_id"]]["kept"]) == (base, first, not base and first is None)


def test_quality_rules(spark, sf):
    got = {r["doc_id"]: r for r in rows(spark, sf, "op7_quality_rules")}
    for doc_id, text, *_ in ROWS:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
        often, covered = Counter(windows), set()
        for i, w in enumerate(windows):
            if often[w] > 1:
                covered |= {i, i + 1, i + 2}
        lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        r = got[doc_id]
        assert (r["n_words"], r["word_chars"], r["n_symbols"]) == (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)))
        assert (r["n_dup_lines"], r["n_repeat_words"]) == (len(lines) - len(set(lines)), len(covered))
        assert r["base_failed"] == (len(words) < 50 or 100 * len(covered) > 50 * len(words)) and not (r["base_failed"] and r["kept"])


def test_decision_list_on_held_out_rows():
    rng = np.random.default_rng(3)
    x = rng.random((3000, len(quality.FEATURES)))
    bad = (x[:, 1] > 0.8) | ((x[:, 3] > 0.7) & (x[:, 5] < 0.2))
    rules = quality.learn(x[:2000], bad[:2000])
    said = np.logical_or.reduce([r.holds(x[2000:]) for r in rules])
    assert (said == bad[2000:]).mean() > 0.97 and all(len(r.conditions) <= 3 for r in rules)
    assert quality.learn(x[:10], np.zeros(10, bool)) == []


def test_one_more_shard_takes_rows_only_into_itself(spark):
    """For every number of shards, and by brute force."""
    trees = {f"n{n}": sharding.even_tree(n) for n in range(1, 65)}
    got = sharding.with_shards(spark.range(3000).withColumn("k", F.col("id").cast("string")), F.col("k"), trees).collect()
    for n in range(1, 64):
        moved = [(r[f"n{n}"], r[f"n{n + 1}"]) for r in got if r[f"n{n}"] != r[f"n{n + 1}"]]
        assert all(b == n for _, b in moved) and len(moved) < 3 * 3000 / (n + 1) + 30
    for r in got[:200]:
        u = [((_spark_hash(r["k"], f"shard{s}") >> 11) + 0.5) / (1 << 53) for s in range(64)]
        assert all(r[f"n{n}"] == max(range(n), key=lambda s: u[s]) for n in range(1, 65))


def test_weights_decide_how_much_a_shard_gets(spark):
    leaf = lambda s, w: sharding.Node(f"s{s}", shard=s, own=w)
    tree = lambda w: sharding.Node("root", (sharding.Node("r0", (sharding.Node("r0k0", (leaf(0, 1.0), leaf(1, w))),)), sharding.Node("r1", (leaf(2, 4.0), leaf(3, 0.0)))))
    got = sharding.with_shards(spark.range(20_000).withColumn("k", F.col("id").cast("string")), F.col("k"), {"a": tree(1.0), "b": tree(3.0)}).groupBy("a", "b").count().collect()
    sizes = Counter()
    for r in got:
        assert r["a"] == r["b"] or r["b"] == 1
        sizes[r["a"]] += r["count"]
    assert 3 not in sizes and abs(sizes[2] / 20_000 - 4 / 6) < 0.02 and abs(sizes[0] / 20_000 - 1 / 6) < 0.02


def test_sharding(spark, sf):
    got = rows(spark, sf, "op8_hash_tree_sharding")
    texts = {r[0]: r[1] or "" for r in ROWS}
    slots = {}
    for r in got:
        raw = texts[r["doc_id"]].encode()
        assert (r["size"], r["text_crc32"], r["law"]) == (len(raw) + 1, zlib.crc32(raw), "key")
        assert 0 <= r["shard"] < 16 and r["grown_shard"] in (r["shard"], 16)
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and len(got) == len(ROWS)


def test_hash_tree_confines_movement(spark):
    docs = spark.range(30_000).selectExpr("id AS doc_id", "CAST(id AS STRING) AS text")
    got = sharding.shard_documents(docs, sharding.even_tree(16), sharding.even_tree(17), run=500).groupBy("shard", "grown_shard").count().collect()
    per, moved = Counter(), 0
    for r in got:
        per[r["shard"]] += r["count"]
        moved += r["count"] * (r["grown_shard"] != r["shard"])
    assert max(per.values()) < 1.1 * 30_000 / 16 and min(per.values()) > 0.9 * 30_000 / 16 and abs(moved - 30_000 / 17) < 200


def test_url_filter(spark, sf):
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in rows(spark, sf, "op9_url_filter")}
    assert got == {
        0: ("", "", None, "allow"), 1: ("", "", None, "allow"), 2: ("", "", None, "allow"), 3: ("www.example.com", "/en/7", "example.com/en/7", "allow"), 4: ("example.com", "/en/8", "com/en/", "block"),
        5: ("a.net", "/de/1", "net/de/", "allow"), 6: ("example.net", "/de/8/z", "example.net/de/8", "block"), 7: ("x.org", "/es/", "org/es/", "block"), 8: ("xorg", "/es/", None, "allow"),
        9: ("cheap-pills.biz", "/", None, "block"), 10: ("ok.biz", "/freedom", None, "allow"), 11: ("ok.biz", "/free/win", None, "block"), 12: ("h.biz", "", None, "block"), 13: ("u.org", "", None, "allow"),
    }
    assert urls.hits("http://CASINO1.com/xcasino/casino_x", urls._automaton(urls.STRICT, urls.SOFT)) == ({"casino"}, set())


def slow_simhash(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    hashes = [xxh64_intdigest(s.encode(), 42) for s in ([" ".join(words)] if len(words) < 3 else [" ".join(words[i : i + 3]) for i in range(len(words) - 2)])]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def classes(fps):
    root = dict.fromkeys(fps)
    for d in sorted(fps):
        if root[d] is None:
            todo, root[d] = [d], d
            while todo:
                a = todo.pop()
                for b in fps:
                    if root[b] is None and (fps[a] ^ fps[b]).bit_count() <= 2:
                        root[b] = d
                        todo.append(b)
    return root


def test_near_copies(spark, sf):
    got = {r["doc_id"]: r for r in rows(spark, sf, "op10_simhash_near_dedup")}
    fps = {d: slow_simhash(t) for d, t, *_ in ROWS}
    assert {d: int(r["fingerprint"], 16) for d, r in got.items()} == fps
    assert {d: r["component_id"] for d, r in got.items()} == classes(fps)


@pytest.mark.parametrize("dense", [2, 1000])
def test_links_find_all_near_fingerprints(spark, dense):
    """Random fingerprints and chains of neighbours; dense=2 resolves nearly all keys through middle fingerprints."""
    rng = np.random.default_rng(dense)
    base = [int(x) for x in rng.integers(0, 2**63, 30)]
    fps = set(base)
    for b in base[:10]:
        f = b
        for _ in range(12):
            f ^= sum(1 << int(k) for k in rng.integers(0, 64, rng.integers(1, 4)))
            fps.add(f)
    fps |= {base[0] ^ (1 << 63), base[0] ^ (1 << 63) ^ 1, base[1] ^ 6, base[1] ^ 5}
    signed = {f - 2**64 if f >= 2**63 else f: f for f in fps}
    nodes = spark.createDataFrame([(f,) for f in signed], "fp long")
    root = {r["node"]: r["root"] for r in near_copies.components(near_copies.links(nodes, dense=dense)).collect()}
    want = classes(signed)
    assert {f: root.get(f, f) for f in signed} == want


def test_one_of_each_group_stays(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    docs = docs.union(docs).union(spark.createDataFrame([(None, BASE, None, None, 0, None, None)], SCHEMA))
    got = near_copies.drop_near_copies(docs)
    fps = {d: slow_simhash(t) for d, t, *_ in ROWS}
    assert sorted(r["doc_id"] for r in got.collect()) == sorted(set(classes(fps).values())) and got.columns == docs.columns


def test_empty_tables(spark, sf):
    for name, query in queries.QUERIES.items():
        assert query(spark, f"{sf}/empty").count() == 0, name


def test_null_ids_and_repeated_rows_pass_through(spark, tmp_path):
    data = [(None, "some text here", None, None, None, None, None)] * 2 + [(5, "some text here", "en", "src1", 1, "a", 1)] * 3
    spark.createDataFrame(data, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(None, None, None)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for name, query in queries.QUERIES.items():
        if name not in ("op4_html_extraction", "op9_url_filter", "op6_source_mixing"):
            assert query(spark, str(tmp_path)).count() == 5, name
