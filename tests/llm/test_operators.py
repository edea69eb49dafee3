import base64
import gzip
import hashlib
import io
import random
import time
import zlib

import numpy as np
import public_tokenizers
import pytest

from gazeflow.llm import bpe, embeddings, graph, html_text, jaccard, media, packing, quality, suffix_array, tokens, warc

from . import brute

WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
ODD = ["", None, " ", "a", "  two  words ", "Don't 'REally 've 'r isn''t ''ll", "<|endoftext|>x<|startoftext|> <|END|><|endof", "ΑΣ ΣΑΣ İstanbul é́ ½²Ⅷ", "a\x1cb\x1d  c\x85d \x1f e  ", "a" * 300, "-" * 70 + " !!!???   \n\n x", "日本語のテスト 한국어 العربية", "👍🏽👩‍👩‍👧 x'S", "\n \n", "</w> w></w>"]


def sentence(rng, n, letters="abcdeé"):
    return " ".join("".join(rng.choice(letters) for _ in range(rng.randint(1, 7))) for _ in range(n))


def texts():
    """Ids and texts with copies, near copies, shared passages, very long, short, empty and null texts."""
    rng = random.Random(5)
    rows = list(enumerate(ODD))
    passage = sentence(rng, 60)
    base = [sentence(rng, rng.randint(5, 400)) for _ in range(30)]
    for t in base:
        words = t.split()
        for _ in range(3):
            w = list(words)
            for _ in range(rng.randint(0, 3)):
                w[rng.randrange(len(w))] = "changed"
            rows.append((len(rows), " ".join(w)))
    rows += [(len(rows) + i, f"{sentence(rng, 30)} {passage} {sentence(rng, 20)}") for i in range(12)]
    rows += [(len(rows) + i, base[0]) for i in range(25)]
    rows.append((len(rows), sentence(rng, 9000)))
    rng.shuffle(rows)
    return rows


def frame(spark, rows, schema="doc_id long, text string"):
    """With extra columns whose names clash with those that operators make, in several partitions."""
    df = spark.createDataFrame(rows, schema).repartition(3)
    return df.selectExpr("*", "'x' as label", "1 as n", "2 as a", "3 as list", "cast(null as int) as cls", "4 as length")


EMPTY = [], "doc_id long, text string"


def test_token_counts(spark):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(WORD_BPE)
    rows = texts()
    got = {r.doc_id: r for r in tokens.prefix_counts(frame(spark, rows), WORD_BPE).collect()}
    assert len(got) == len(rows)
    for i, t in rows:
        assert got[i].n_tokens == len(library.encode(t or "", add_special_tokens=False).ids)
        assert got[i].n_bytes == len((t or "").encode())
        assert sum(got[i].chunk_tokens) == got[i].n_tokens
    for i, t in rows[:60]:
        if not t or "<|" in t or "\x1c" in t or len(t) > 3000:
            continue
        normal = library.normalizer.normalize_str(t)
        counts = tokens.counts_of(got[i].prefix_deltas)
        step = max(1, len(normal) // 40)
        for k in range(1, len(normal) + 1, step):
            assert counts[k - 1] == len(library.encode(normal[:k], add_special_tokens=False).ids)
        fit = tokens.longest_within(got[i].prefix_deltas, 7)
        assert fit == len(normal) or len(library.encode(normal[:fit], add_special_tokens=False).ids) <= 7
    assert tokens.prefix_counts(spark.createDataFrame(*EMPTY), WORD_BPE).count() == 0
    assert tokens.prefix_counts(spark.createDataFrame([(None, "a b"), (1, None), (1, None)], EMPTY[1]), WORD_BPE).count() == 3


def test_special_strings():
    from tokenizers import Tokenizer

    library, c = Tokenizer.from_file(WORD_BPE), tokens.PrefixCounter(WORD_BPE)
    for t in ("x<|endoftext|>", "<|endoftext|>", "a<|startoftext|>b<|endoftext|>c", "<|ENDOFTEXT|>"):
        counts = tokens.counts_of(c.deltas(t))
        assert counts[-1] == len(library.encode(t, add_special_tokens=False).ids)
        for k in range(1, len(t)):
            assert counts[k - 1] == len(library.encode(t[:k], add_special_tokens=False).ids)


def test_bpe(spark):
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(2)
    rows = texts() + [(1000 + i, "".join(rng.choice("abthe'sTré1 \n.,-<|\t") for _ in range(80))) for i in range(100)]
    got = {r.doc_id: r for r in bpe.encode_decode(frame(spark, rows), RANKS, public_tokenizers.PATTERN).collect()}
    for i, t in rows:
        ids = library.encode_ordinary(t or "")
        assert got[i].ids == ids and got[i].n_tokens == len(ids)
        assert got[i].ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert bytes(got[i].decoded) == (t or "").encode()
        assert got[i].decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()
    assert bpe.encode_decode(spark.createDataFrame(*EMPTY), RANKS, public_tokenizers.PATTERN).count() == 0


def test_media_formats():
    rng = np.random.default_rng(0)
    gray, colour = rng.integers(0, 256, (5, 7), dtype=np.uint8), rng.integers(0, 256, (5, 7, 3), dtype=np.uint8)
    for image in (gray, colour):
        assert (media.decode(media.to_pgm(image)) == image).all()
        assert (media.decode(media.to_bmp(image)) == image).all()
    assert (media.decode(b"P2\n# note\n2 2\n9\n1 2\n3 4\n") == [[1, 2], [3, 4]]).all()
    assert (media.decode(b"P1\n3 1\n101\n") == [[1, 0, 1]]).all()
    assert (media.decode(b"P4\n3 1\n\xa0") == [[1, 0, 1]]).all()
    assert media.decode(b"P5 1 1 65535\n\x01\x02")[0, 0] == 258
    big = rng.integers(0, 256, (24, 27))
    assert np.allclose(media.area_resize(big, 8, 9), big.reshape(8, 3, 9, 3).mean((1, 3)))
    assert np.allclose(media.area_resize(np.full((3, 64), 7), 8, 9), 7)
    assert np.isclose(media.area_resize(big, 5, 4).mean(), big.mean())


def test_media(spark):
    rows = texts()
    got = {r.doc_id: r for r in media.store_payloads(frame(spark, rows)).collect()}
    for i, t in rows:
        raw = (t or "").encode()
        padded = raw + bytes(64 - len(raw) % 64 if len(raw) % 64 or not raw else 0)
        r = got[i]
        assert (r.n_bytes, r.payload_bytes) == (len(raw), len(padded))
        assert r.payload_sha256 == hashlib.sha256(padded).hexdigest() and r.tail_crc32 == zlib.crc32(padded[-64:])
        assert r.media_bytes == len(r.media) and r.media_sha256 == hashlib.sha256(r.media).hexdigest()
        assert media.decode(bytes(r.media)).tobytes() == padded
        assert np.load(io.BytesIO(r.tile)).shape == (8, 9)
    back = media.image_features(spark.createDataFrame([(1, bytes(got[0].media)), (2, b"junk"), (3, None), (None, b"P5 9 9 255\n")], "doc_id long, data binary"), "doc_id", "data").collect()
    assert back[0].dhash == got[0].feature and all(b.dhash is None and b.error for b in back[1:])


def test_warc(spark):
    long = "<p>ü" * 200_000
    rows = [(3, "http://a/", "x"), (1, "http://b/", "x"), (2, None, None), (4, "bad\r\nurl", ""), (5, "http://c/", long), (6, "u", long), (None, "u", "x"), (7, "u", "x\r\n\r\ny"), (8, "", "y")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3).selectExpr("*", "1 as first_id", "2 as _sha")
    archives = warc.write_archives(df)
    got = {r.page_id: r for r in warc.read_archives(archives).collect()}
    first = {}
    for i, _, h in sorted((r for r in rows if r[0] is not None), key=lambda r: r[0]):
        raw = (h or "").encode()
        to = first.setdefault(raw, i)
        r = got[i]
        assert (r.payload_bytes, r.payload_digest) == (len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode())
        assert (r.record_type, r.refers_to) == (("response", None) if to == i else ("revisit", to))
        assert r.payload == (raw if to == i else None)
    assert got[None].record_type == "revisit" and got[None].refers_to == 1
    assert warc.read_archives(warc.write_archives(spark.createDataFrame([], df.schema))).count() == 0
    small = {r.page_id: r.record_type for r in warc.read_archives(warc.write_archives(df, min_bytes=100)).collect()}
    assert small[3] == "response" and small[6] == "revisit"


def test_warc_reader_checks_what_it_reads():
    good = warc.page_record(1, "http://a/", b"hello", None) + warc.page_record(2, "http://a/", b"hello", 1)
    read = list(warc.read_records(iter([good[i : i + 3] for i in range(0, len(good), 3)])))
    assert [f["warc-type"] for f, _ in read] == ["response", "revisit"] and read[0][1].endswith(b"\r\n\r\nhello")
    assert gzip.decompress(good).count(b"WARC/1.1") == 2
    plain = gzip.decompress(warc.page_record(1, "http://a/", b"hello", None))
    for broken in (gzip.compress(plain.replace(b"hello", b"hellO")), gzip.compress(plain[:-3]), gzip.compress(plain + plain), good[:-20], gzip.compress(b"nothing")):
        with pytest.raises((ValueError, zlib.error)):
            list(warc.read_records(iter([broken])))


def test_quality(spark):
    rng = random.Random(3)
    rows, labels = [], []
    for i in range(400):
        good = rng.random() < 0.7
        words = sentence(rng, 40).split()
        rows.append((i, " ".join(words) if good else " ".join(w + "###" for w in words)))
        labels.append((i, int(good)))
    rows += [(1000, None), (1001, ""), (None, "a b"), (1002, "b ### " * 50_000)]
    labels += [(1, 1), (None, 0), (5000, 1), (7, None)]
    docs, labelled = frame(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int")
    model = quality.fit(docs, labelled)
    got = quality.score(docs, model).collect()
    assert len(got) == len(rows)
    held = [r for r in got if r.held_out and r.doc_id is not None and r.doc_id < 400]
    truth = dict(labels[:400])
    assert held and np.mean([r.predicted == truth[r.doc_id] for r in held]) > 0.95
    for r in got:
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
        assert 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3)
    assert len({r.score for r in got if r.doc_id in (1000, 1001)}) == 1
    kept = quality.keep_good(docs, model)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {r.doc_id for r in got if r.predicted}
    none = quality.fit(docs, labelled.where("false"))
    assert {r.score for r in quality.score(docs, none).collect()} == {0.5}
    assert quality.score(spark.createDataFrame(*EMPTY), model).count() == 0


PAGES = {
    "<p>A &amp; b\n c<b>d</b>e<br>f</p><p>g</p>": "A & b cde f g",
    "<nav><a>Home</a></nav><article><h1>T</h1><p>One two.<form><input>Send</form><p>Three.<aside>Ad here</aside></article><div class='comments'><p>nice</p></div><footer>c</footer>": "T One two. Three.",
    "<script>var a='<p>x</p>'</script><style>p{}</style><p>Only this text.</p>": "Only this text.",
    "<div class='cookie-notice'>We use cookies</div><div id=content><p>Long story of a sea.</p><ul><li>one</li><li>two</li></ul></div><div class=sidebar>More</div>": "Long story of a sea. one two",
    "": "",
    None: "",
    "<html><body><nav><a>x</a></nav></body></html>": "",
    "no tags at all": "no tags at all",
    "<p>unclosed <b>bold<p>next": "unclosed bold next",
    "<p>a<!-- hidden -->b</p><p><!-- open": "ab",
}


def test_html(spark):
    rows = [(i, None if i == 1 else f"u{i}", h) for i, h in enumerate(PAGES)] + [(None, "u", "<p>word " * 30_000)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 as text", "2 as n_chars")
    got = {r.page_id: r for r in html_text.extract(df).collect()}
    for i, want in enumerate(PAGES.values()):
        assert (got[i].text, got[i].n_chars, got[i].url) == (want, len(want), rows[i][1])
    assert got[None].n_chars == 30_000 * 5 - 1
    assert html_text.extract(df.where("false")).count() == 0


def test_html_weights_and_region():
    w = html_text.weights()
    assert w["text"] > 0 > w["boiler"] and all(w[k] < 0 for k in ("block", "inline", "boilertag"))
    items = [("boiler", 2, "x", False), ("text", 3, "y", False), ("block", 1, None, True), ("text", 1, "z", False), ("boiler", 9, "x", False), ("text", 1, "w", False)]
    low, high = html_text.region(items, w)
    best = max(((a, b) for a in range(6) for b in range(a + 1, 7)), key=lambda r: sum(w[k] * n for k, n, _, _ in items[r[0] : r[1]]))
    assert (low, high) == best


def test_packing(spark):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(WORD_BPE)
    rows = texts() + [(5, "again a repeated id")]
    for capacity in (4096, 50):
        got = packing.pack(frame(spark, rows), WORD_BPE, capacity).collect()
        by = {}
        for r in got:
            by.setdefault(r.doc_id, []).append(r)
        for i, t in rows:
            if i == 5:
                continue
            ids = [*library.encode(t or "", add_special_tokens=False).ids, 1]
            own = sorted(by[i], key=lambda r: r.piece)
            assert [r.length for r in own] == [len(ids[k : k + capacity]) for k in range(0, len(ids), capacity)]
            assert [r.start for r in own] == list(range(0, len(ids), capacity)) and [r.piece for r in own] == list(range(len(own)))
            assert np.frombuffer(b"".join(bytes(r.ids) for r in own), "<u4").tolist() == ids
            assert all(r.ids_crc32 == zlib.crc32(r.ids) for r in own)
        bins = {}
        for r in got:
            bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
        for places in bins.values():
            at = 0
            for offset, length in sorted(places):
                assert offset == at
                at += length
            assert at <= capacity
        total = sum(r.length for r in got)
        assert len(bins) <= -(-total // capacity) + 1
    assert packing.pack(spark.createDataFrame(*EMPTY), WORD_BPE).count() == 0
    assert packing.pack(spark.createDataFrame([(None, None)], EMPTY[1]), WORD_BPE).first().length == 1


def test_plan_fills_bins():
    rng = random.Random(4)
    for _ in range(30):
        counts = {rng.randint(1, 60): rng.randint(1, 40) for _ in range(rng.randint(1, 20))}
        places, n = packing.plan(counts, 60)
        seen = {}
        for length, count in counts.items():
            own = places[places[:, 0] == length]
            for rank in range(count):
                row = own[np.searchsorted(own[:, 1], rank, "right") - 1]
                seen.setdefault(row[2] + (rank - row[1]) // row[3], []).append((row[4] + (rank - row[1]) % row[3] * length, length))
        assert len(seen) == n and sum(map(len, seen.values())) == sum(counts.values())
        for bin_ in seen.values():
            at = 0
            for offset, length in sorted(bin_):
                assert offset == at
                at += length
            assert at <= 60
    assert sum(packing.best_combination([7, 5, 3], {7: 1, 5: 2, 3: 1}, 16)) == 15
    assert packing.best_combination([9], {9: 3}, 5) == []


@pytest.mark.parametrize(("words", "num", "den"), [(4, 85, 100), (5, 4, 5), (2, 1, 2)])
def test_jaccard(spark, words, num, den):
    rows = texts()
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.join_components(frame(spark, rows), words, num, den).collect()}
    assert got == brute.jaccard(rows, words, num, den)


def test_jaccard_odd_rows(spark):
    rows = [(7, "a b c d e"), (7, "a b c d e"), (None, "a b c d e"), (3, "A B\tC d\x0be"), (4, None), (None, None), (5, "x"), (6, "X")]
    got = sorted(map(tuple, jaccard.join_components(frame(spark, rows), 4, 85, 100).collect()), key=str)
    assert got == sorted([(7, 2, 3), (7, 2, 3), (None, 2, 3), (3, 2, 3), (4, 0, 4), (None, 0, None), (5, 1, 5), (6, 1, 5)], key=str)
    assert jaccard.join_components(spark.createDataFrame(*EMPTY)).count() == 0


def thue_morse(n):
    return "".join("ab"[i.bit_count() % 2] for i in range(n)), "".join("ba"[i.bit_count() % 2] for i in range(n))


def test_long_words_are_not_confused(spark):
    a, b = thue_morse(2048)
    rows = [(1, a), (2, b), (3, f"{a} x y z"), (4, f"{b} x y z"), (5, a)]
    got = {r.doc_id: r.component_id for r in jaccard.join_components(frame(spark, rows), 4, 85, 100).collect()}
    assert got == {1: 1, 2: 2, 3: 3, 4: 4, 5: 1}


def test_groups_whose_members_are_mostly_apart(spark, monkeypatch):
    """Variants of a few texts, some linked only by way of others, in blocks and common segments smaller than the groups."""
    monkeypatch.setattr(jaccard, "COMMON", 32)
    monkeypatch.setattr(jaccard, "BLOCK", 16)
    monkeypatch.setattr(jaccard, "SIDE", 16)
    rng = random.Random(21)
    rows = []
    for base in range(3):
        words = sentence(rng, 120).split()
        for _ in range(90):
            w = list(words)
            for _ in range(rng.randint(0, 9)):
                w[rng.randrange(len(w))] = sentence(rng, 1)
            rows.append((len(rows), " ".join(w)))
    for num, den, n in ((85, 100, 4), (4, 5, 5)):
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.join_components(frame(spark, rows), n, num, den).collect()}
        assert got == brute.jaccard(rows, n, num, den)


def test_sketches_never_miss_a_pair():
    rng = np.random.default_rng(3)
    for num, den in ((85, 100), (4, 5)):
        for n in [1, 5, 30, 33, 64, 65, 500, 513, 3000]:
            a = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64))
            others = [np.unique(np.concatenate([a[g:], rng.integers(0, 1 << 63, k, dtype=np.uint64)])) for g, k in ((0, 0), (0, n // 6), (n // 7, 0), (n // 14, n // 14), (n // 2, n // 2))]
            sets = [a, *others]
            sizes = np.array([len(s) for s in sets])
            found = jaccard.Sketches(sizes, jaccard.pa.array(jaccard.odd_sketches(sets), jaccard.pa.binary()), num, den)
            some = np.arange(len(sets)) == 4  # masks may leave out all sketches of a width
            assert all(p.tolist() == q.tolist() == [4] for p, q in found.candidates(some, some))
            got = {(i, j) for p, q in found.candidates(np.ones(len(sets), bool), np.ones(len(sets), bool)) for i, j in zip(p.tolist(), q.tolist())}
            for i, x in enumerate(sets):
                for j, y in enumerate(sets):
                    both = len(np.intersect1d(x, y))
                    if den * both >= num * (len(x) + len(y) - both):
                        assert (i, j) in got


def test_first_rows_are_kept(spark):
    t, u = "a b c d e f g h i j", "k l m n o p q r s t"
    rows = [(7, t), (7, t), (7, u), (None, t), (None, "v w x y z 1 2 3"), (None, "v w x y z 1 2 3"), (3, t + " "), (9, u), (1, ""), (1, ""), (2, None), (None, None)]
    kept = jaccard.keep_first(frame(spark, rows))
    assert kept.columns == frame(spark, rows).columns
    got = sorted(((r.doc_id, (r.text or "").strip()) for r in kept.collect()), key=str)
    assert got == sorted([(3, t), (7, u), (None, "v w x y z 1 2 3"), (1, ""), (1, ""), (2, ""), (None, "")], key=str)
    assert jaccard.keep_first(spark.createDataFrame(*EMPTY)).count() == 0


def test_segments_never_miss_a_pair():
    rng = np.random.default_rng(6)
    bands = jaccard.Bands(85, 100)
    for n in [*range(1, 40), 55, 80, 150, 400]:
        for _ in range(20):
            a = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64))
            most = bands.bound(len(a))
            gone = rng.integers(0, most + 1)
            b = np.unique(np.concatenate([a[gone:], rng.integers(0, 1 << 63, most - gone, dtype=np.uint64)]))
            shared = len(np.intersect1d(a, b))
            if 100 * shared < 85 * (len(a) + len(b) - shared) or np.array_equal(a, b):
                continue
            keys, of = bands.signatures([a, b])
            assert set(keys[of == 0].tolist()) & set(keys[of == 1].tolist())


def test_components(spark):
    rng = random.Random(8)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(1000, 1060)] + [(2000, i) for i in range(2001, 2050)]
    got = {r.node: r.label for r in graph.components(spark.createDataFrame(links, "a long, b long")).collect()}
    nodes = {x for p in links if p[0] != p[1] for x in p}
    assert got == brute.components(nodes, [p for p in links if p[0] != p[1]])
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_suffix_ranks():
    rng = random.Random(1)
    for n in [*range(1, 40), 700]:
        for k in (1, 2, 5, 250):
            s = np.array([rng.randint(1, k) for _ in range(n)])
            order = sorted(range(n), key=lambda i: s[i:].tolist())
            assert suffix_array.suffix_ranks(s, k)[order].tolist() == list(range(n))


@pytest.mark.parametrize("window", [100, 23, 6])
def test_suffix_array_dedup(spark, window):
    rows = texts() + [(9000, "x" * 500), (9001, "é" * 300 + "x" * 450)]
    want = brute.repeats(rows, window)
    got = {r.doc_id: r for r in suffix_array.dedup(frame(spark, rows), window).collect()}
    assert {i: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256, bytes(r.kept)) for i, r in got.items()} == want
    assert all(sum(s.end - s.start for s in r.spans) == r.n_removed for r in got.values())


def test_large_classes_are_dealt_out(spark):
    rng = random.Random(9)
    passage = sentence(rng, 40)
    rows = [(i, f"{sentence(rng, 12)} {passage[: rng.randint(60, 250)]} {sentence(rng, 12)}") for i in range(80)]
    want = brute.repeats(rows, 50)
    docs = spark.createDataFrame(rows, "doc long, text string").repartition(3)
    stretches = suffix_array.stored(suffix_array.stretch_table(docs, 50), "t")
    asked = suffix_array.stored(suffix_array.decided(stretches), "t")
    assert asked.where("kind = 1").count() > 0
    large = asked.selectExpr("if(kind = 1, 2, kind) as kind", "doc", "start", "end", "cls")
    found = suffix_array.dealt_repeats(docs, large, 50).union(asked.where("kind = 0").select("doc", "start", "end")).collect()
    by = {}
    for d, a, b in found:
        by.setdefault(d, []).append((a, b))
    for i, _ in rows:
        runs = suffix_array.merged(by.get(i, []))
        assert (sum(b - a for a, b in runs), len(runs)) == want[i][1:3]


def test_suffix_array_odd_rows(spark):
    t = sentence(random.Random(0), 80)
    got = suffix_array.dedup(frame(spark, [(4, t), (4, t), (None, t), (5, None), (2, t[:120])]), 100).collect()
    removed = sorted((str(r[0]), r.n_removed) for r in got)
    assert removed == sorted([("4", 120), ("4", 120), ("None", len(t.encode())), ("5", 0), ("2", 0)]) or t[:120].encode() != t.encode()[:120]
    assert suffix_array.dedup(spark.createDataFrame(*EMPTY)).count() == 0
    cut = suffix_array.cut_repeats(spark.createDataFrame([(1, t, len(t)), (2, t, len(t)), (3, f"{t} more", 9), (4, None, None), (5, "", 0)], "doc_id long, text string, n_chars long"))
    assert sorted(map(tuple, cut.collect()), key=str) == sorted([(1, t, len(t)), (3, " more", 5), (4, None, None), (5, "", 0)], key=str)


def test_embeddings(spark):
    rng = np.random.default_rng(1)
    rows = []
    for _ in range(40):
        base = rng.normal(size=16)
        rows += [(len(rows) + i, (base + rng.normal(size=16) * s).tolist(), int(rng.integers(0, 3))) for i, s in enumerate(rng.uniform(0, 0.15, 12))]
    rows += [(len(rows) + i, (rng.normal(size=16)).tolist(), 0) for i in range(200)]
    rows += [(len(rows) + i, rows[0][1], rows[0][2]) for i in range(300)]
    n = len(rows)
    rows += [(n, None, 1), (n + 1, [0.0] * 16, 1), (n + 2, [1.0, None], 1), (n + 3, [float("nan")] * 16, 1), (n + 4, rows[0][1], None), (n + 5, [1.0, 2.0], 0), (n + 6, [-2.0, -4.0], 0), (n + 7, [2.0, 4.0], 0), (n + 8, [], 0), (n + 9, [1e300] * 3, 0), (n + 10, [1e-300] * 3, 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").repartition(4).selectExpr("*", "1 as n", "2 as space", "3 as id")
    want = brute.near_vectors(rows, 0.98)
    want[n + 9] = want[n + 10] = (1, n + 9)
    got = {r.vec_id: r for r in embeddings.near_duplicates(df).collect()}
    assert {i: (r.n_links, r.component_id) for i, r in got.items()} == want
    assert all(r.kept == (r.vec_id == r.component_id) for r in got.values())
    assert embeddings.near_duplicates(df.where("false")).count() == 0


def test_embeddings_links_between_tight_groups(spark):
    """Every list of neighbours is full of links of the own group, and all groups link."""
    rng = np.random.default_rng(2)
    rows = []
    for label, size in ((0, 10), (1, 400)):
        centre = rng.normal(size=(1, 16))
        spread = [c + 0.08 * np.linalg.norm(centre) * d / np.linalg.norm(d) for c, d in zip([centre[0]] * 3, rng.normal(size=(3, 16)))]
        rows += [(len(rows) + i, (spread[i % 3] + rng.normal(size=16) * 0.005).tolist(), label) for i in range(3 * size)]
    want = brute.near_vectors(rows, 0.98)
    assert {want[0], want[1], want[2]} == {(29, 0)} and want[30] == (1199, 30)
    got = {r.vec_id: r for r in embeddings.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").repartition(4)).collect()}
    assert {i: (r.n_links, r.component_id) for i, r in got.items()} == want and sum(r.kept for r in got.values()) == 2


def test_embeddings_compare_labels_whole_where_audits_fail(spark, monkeypatch):
    """Without any neighbours to start from, the links are found all the same."""
    start = embeddings.bucket_neighbours
    monkeypatch.setattr(embeddings, "bucket_neighbours", lambda *a: start(*a).where("false"))
    monkeypatch.setattr(embeddings, "AUDITS", 0)
    monkeypatch.setattr(embeddings, "SIDE", 100, raising=False)
    rng = np.random.default_rng(3)
    rows = [(i, (rng.normal(size=8)).tolist(), i % 2) for i in range(1500)]
    rows += [(1500 + i, (np.array(rows[7 * i][1]) * 1.5 + 0.01).tolist(), rows[7 * i][2]) for i in range(200)]
    got = {r.vec_id: r for r in embeddings.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").repartition(4)).collect()}
    want = brute.near_vectors(rows, 0.98)
    assert sum(n > 0 for n, _ in want.values()) >= 400
    assert {i: (r.n_links, r.component_id) for i, r in got.items()} == want


def test_embeddings_audit_takes_nodes_of_each_label(spark):
    own = spark.createDataFrame([(i, str(i % 3), i, b"", i < 90) for i in range(60_000)], "id long, space string, label long, vec binary, linked boolean")
    taken = {(r.space, r.linked): r["count"] for r in embeddings.audited(own, 0).groupBy("space", "linked").count().collect()}
    for space in "012":  # of 30 nodes with links all, of the others one in 142 / 27
        assert taken[space, True] == 30 and 3400 < taken[space, False] < 4300


def test_html_names_of_wrappers():
    text = "The mill stands by the stream and its wheel turns day and night."
    for name in ("content no-sidebar", "post comments-open", "search-results", "legal", "social", "notice", "related"):
        assert html_text.main_text(f"<body><nav><a>Home</a></nav><div class='{name}'><p>{text}</p></div></body>") == text
    for name in ("related-work", "legal", "notice"):
        assert html_text.main_text(f"<article><p>{text}</p><section id='{name}'><p>{text}</p></section></article>") == f"{text} {text}"
    for name in ("ad", "site-footer", "left-sidebar", "comment-list", "cookie-notice"):
        assert html_text.main_text(f"<div><p>{text}</p></div><div class='{name}'><p>Some other words</p></div>") == text
    for raw in ("noscript", "template", "iframe", "canvas", "audio", "video", "textarea"):
        assert html_text.main_text(f"<p>{text}</p><{raw}><p>{text}</p>") == f"{text} {text}"


def test_html_takes_time_in_proportion():
    """Broken pages of a megabyte: nothing is searched twice to the end."""
    began = time.process_time()
    for junk in ("<a ", "<![CDATA[", '<a title="', "<a title='x>", "<script", "</b>", "<b><i>", "<noscript>", "<nav><b>", "< ", "<!x", "<p><b>", "<a>"):
        html_text.main_text(junk * (300_000 // len(junk)) + "<p>end of page")
    assert time.process_time() - began < 60
    text = "The mill stands by the stream and its wheel turns day and night."
    assert html_text.main_text(f"<p>{'İ' * 40}</p><script>x</SCRIPT><p>{text}</p>") == f"{'İ' * 40} {text}"
    assert html_text.main_text(f'<p title="a > b">{text}</p><p title="a>{text}</p>') == f"{text} {text}"
    assert html_text.main_text(f"<article><p>{text}</p><label>{text}</label></article>") == f"{text} {text}"


def test_long_words():
    from tokenizers import Tokenizer

    library, c = Tokenizer.from_file(WORD_BPE), tokens.counter(WORD_BPE)
    rng = random.Random(1)
    for w in ("a" * 300, "".join(rng.choice("abcdefghij") for _ in range(20_000)), "日本語" * 300, "-" * 100, "x-" * 100, "aGVsbG8" * 60):
        assert sum(c.ends(w)) == len(library.encode(w, add_special_tokens=False).ids)
        counts = tokens.counts_of(c.deltas(w[:300]))
        for k in (1, 7, 49, 150, 300):
            if k <= len(w):
                assert counts[k - 1] == len(library.encode(w[:k], add_special_tokens=False).ids)
    assert len(c.states) < 10_000


def test_broken_images(spark):
    bad = [b"P5 99999999999 99999999999 255\n", b"P2 1 1 255 99999999999999999999", b"P5 0 3 255\n", b"P1 2 1 ab", b"P2 2 2 255 1 2 3", b"BM" + bytes(60), b"P6 3 3 255\nxx"]
    images = spark.createDataFrame([(i, d) for i, d in enumerate(bad)] + [(None, b"P5 1 1 255\nA"), (7, b"P5 1 1 255\nA"), (7, b"P5 1 1 255\nB")], "doc_id long, data binary").selectExpr("*", "1 as tile", "2 as error")
    got = media.image_features(images, "doc_id", "data").collect()
    assert all(r.error and r.dhash is None for r in got[: len(bad)]) and all(r.error is None and (r.height, r.width) == (1, 1) for r in got[len(bad) :])
    assert media.image_features(images.where("false"), "doc_id", "data").count() == 0 and media.store_payloads(spark.createDataFrame(*EMPTY)).count() == 0
    same = media.store_payloads(spark.createDataFrame([(None, "x"), (4, "x"), (4, "y")], EMPTY[1])).drop("doc_id").collect()
    assert same[0] == same[1] != same[2]


def test_difference_hash_against_plain_loops():
    rng = random.Random(12)
    for h in (1, 3, 40):
        image = [[rng.randrange(256) for _ in range(64)] for _ in range(h)]

        def mean(y, x):  # of the source area under a target pixel, by exact fractions
            from fractions import Fraction as Q

            total = Q(0)
            for i in range(h):
                rows = max(Q(0), min(Q(i + 1), Q(h * (y + 1), 8)) - max(Q(i), Q(h * y, 8)))
                for j in range(64) if rows else ():
                    total += rows * max(Q(0), min(Q(j + 1), Q(64 * (x + 1), 9)) - max(Q(j), Q(64 * x, 9))) * image[i][j]
            return total / (Q(h, 8) * Q(64, 9))

        tile = [[round(float(mean(y, x)), 3) for x in range(9)] for y in range(8)]
        data, dhash = media.features(np.array(image, np.uint8))
        assert np.allclose(media.from_npy(data), tile, atol=2e-3)
        bits = "".join(str(int(b > a)) for row in tile for a, b in zip(row, row[1:]))
        differing = bin(int(bits, 2) ^ int(dhash, 16)).count("1")
        assert differing == 0 or min(abs(b - a) for row in tile for a, b in zip(row, row[1:])) < 2e-3
