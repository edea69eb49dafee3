import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest

from gazeflow.llm import alignment, spelling, token_files

from . import brute
from .test_operators import EMPTY, ODD, WORD_BPE, frame, texts

FIRST, SECOND = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


@pytest.mark.parametrize("width", [1, 3, 8, 13, 16, 17, 24, 32])
def test_packed_bits(width):
    ids = np.random.default_rng(width).integers(0, 1 << width, 1001, dtype=np.uint64).astype(np.uint32)
    raw = token_files.pack(ids, width)
    assert len(raw) == -(-1001 * width // 8)
    assert (token_files.unpack(raw, 1001, width) == ids).all()
    if width < 32:
        with pytest.raises(ValueError):
            token_files.pack(np.array([1 << width]), width)


def test_segment_gives_any_range():
    rng = np.random.default_rng(1)
    docs = [rng.integers(0, 1 << 11, n) for n in (3, 9000, 1, 5000)]
    s = next(token_files.segments(token_files.segment([4, None, 7, 9], docs, 11, 2, 30) + b"\n"))
    flat = np.concatenate(docs)
    assert (s.task, s.before, s.n_ids, s.docs[2], s.null.tolist()) == (2, 30, len(flat), 7, [False, True, False, False])
    for i, j in ((0, len(flat)), (4095, 4097), (5, 5), (8192, 8193), (12288, len(flat))):
        assert (s.ids(i, j) == flat[i:j]).all()
    with pytest.raises(ValueError):
        token_files.Segment(memoryview(bytes(100)), 0)


@pytest.mark.parametrize("size", [1 << 20, 2000])
def test_token_files(spark, monkeypatch, tmp_path, size):
    monkeypatch.setattr(token_files, "SEGMENT", size)
    monkeypatch.setattr(token_files, "PER_FILE", 3)
    rows = texts()
    want = brute.token_starts(rows, WORD_BPE, 2)
    path = f"file://{tmp_path}/tokens"
    assert token_files.write_tokens(frame(spark, rows), path, WORD_BPE, 2) == 16
    got = token_files.read_tokens(spark, path).collect()
    assert {r.doc_id: (r.start, r.n_tokens, r.ids_crc32, r.ids) for r in got} == want and len(got) == len(rows)
    some = token_files.read_tokens(spark, path, first=5, last=9).collect()
    assert {r.doc_id: r.ids for r in some} == {i: w[3][5:9] for i, w in want.items()}
    assert {r.doc_id: r.ids for r in token_files.read_tokens(spark, path, first=1).collect()} == {i: w[3][1:] for i, w in want.items()}


def test_token_files_of_odd_rows(spark):
    assert token_files.round_trip(spark.createDataFrame(*EMPTY), WORD_BPE).count() == 0
    odd = [(3, "x"), (None, "a b"), (3, None), (None, None), (3, None), (-1, "")]
    got = token_files.round_trip(spark.createDataFrame(odd, EMPTY[1]), WORD_BPE).orderBy("start").collect()
    assert [r.doc_id for r in got] == [None, None, -1, 3, 3, 3]
    assert [r.start for r in got] == np.cumsum([0, *(r.n_tokens for r in got[:-1])]).tolist()
    assert sorted(len(r.ids) for r in got) == [1, 1, 1, 1, 2, 3] and all(r.ids[-1] == 2 for r in got)


def test_alignment(spark):
    rng = random.Random(3)
    rows = [(i, t) for i, t in texts() if i < 90 or rng.random() < 0.3]
    rows += [(2000 + i, t) for i, t in enumerate(["a\u2581b", "\u2581", "\x00 \x00a b", "<s></s><unk><0x41> \u0e01\u0e47\u0e17\u0e35\u0e48", "12 345 67890 \u0661\u0662", "a  \n b"])]
    rows += [(3000 + i, "".join(rng.choice("abthe'sTr\u00e91 \n.,-<|\t  \u2581\u00e9\u65e5\u3000\xa0\x1c") for _ in range(rng.randint(1, 90)))) for i in range(300)]
    want = brute.aligned(rows, FIRST, SECOND)
    got = alignment.align(frame(spark, rows), FIRST, SECOND).collect()
    assert sorted(tuple(r)[:8] for r in got) == sorted(want)
    assert all(r.n_groups == (r.groups.count(";") + 1 if r.groups else 0) for r in got)
    assert sum(r.n_a == 0 for r in got) > 2


def test_alignment_of_odd_rows(spark):
    assert alignment.align(spark.createDataFrame(*EMPTY), FIRST, SECOND).count() == 0
    odd = [(None, "a b"), (1, None), (1, "a b"), (1, "a b"), (2, "")]
    got = sorted(map(str, ((r.doc_id, r.n_links, r.count_sum, r.groups) for r in alignment.align(spark.createDataFrame(odd, EMPTY[1]), FIRST, SECOND).collect())))
    same = "2, 6, '257|263;275|289'"
    assert len(got) == 5 and sum("2, 6, " in g for g in got) == 3 and sum("0, 0, ''" in g for g in got) == 2, same


def test_overlapping_tokens():
    al = alignment.aligner(FIRST, SECOND)
    for text in [t for t in ODD if t][:12]:
        a, b, *_ = al.tables(pa.array([text]))
        spans = [list(zip(t["s"].to_pylist(), t["e"].to_pylist())) for t in (a, b)]
        assert al.overlaps(text) == [(i, j) for i, x in enumerate(spans[0]) for j, y in enumerate(spans[1]) if x[0] < y[1] and y[0] < x[1]]
    assert al.overlaps("") == []


def test_spelling(spark):
    rng = random.Random(1)
    for alphabet, least, factor in (("ab\u00e9", 2, 2), ("abcdefgh", 1, 3)):
        words = ["".join(rng.choice(alphabet) for _ in range(rng.randint(3, 8))) for _ in range(60)]
        words += [w[:k] + rng.choice(["", "Z", "aa"]) + w[k + 1 :] for w in words for k in [rng.randrange(len(w))]]
        rows = [(i, " ".join(rng.choice(words[: 1 + rng.randrange(len(words))]) for _ in range(40))) for i in range(200)]
        rows += [(1000, None), (1001, ""), (1002, "a1\u00d7b2 \u0100x"), (7, "repeated abcdef abcdef")]
        want = brute.spellings(rows, 4, least, factor)
        got = spelling.variants(frame(spark, rows), 4, least, factor).collect()
        assert {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in got} == want and len(got) == len(want)
        assert any(w[3] for w in want.values()) and any(w[0] for w in want.values())


def test_near_pairs_once(spark):
    rng = random.Random(9)
    words = sorted({"".join(rng.choice("ab") for _ in range(rng.randint(1, 9))) for _ in range(300)})
    near = lambda u, v: u != v and (v in {u[:k] + c + u[k + 1 :] for k in range(len(u)) for c in ("a", "b", "")} or u in {v[:k] + v[k + 1 :] for k in range(len(v))})
    got = [tuple(sorted(r)) for r in spelling.near_pairs(spark.createDataFrame([(w,) for w in words], "word string")).collect()]
    assert sorted(got) == [(u, v) for u in words for v in words if u < v and near(u, v)]


def test_spelling_of_odd_rows(spark):
    assert spelling.variants(spark.createDataFrame(*EMPTY)).count() == 0
    rows = [(None, "wordsmith " * 5), (1, None), (1, "Wordsmith"), (1, "Wordsmith")]
    got = spelling.variants(spark.createDataFrame(rows, EMPTY[1])).collect()
    assert {r.word: (r.form, r.root, r.n, r.n_near) for r in got} == {w: (f, r, n, k) for w, (f, r, n, k, _) in brute.spellings(rows, 6, 5, 5).items()}
    with pytest.raises(ValueError):
        spelling.variants(spark.createDataFrame(*EMPTY), factor=1)


def test_token_counts_come_from_prefix_counts(spark, monkeypatch):
    """the query's rows are those of the counts stored at every prefix."""
    from gazeflow.llm import queries, tokens

    seen, own = [], tokens.PrefixCounter.prefixes_of
    rows = [(1, "Unbelievable prefixes, aren't they? été<|endoftext|>"), (2, None), (3, " \n "), (4, "word " * 2048), (5, "word " * 2049), (6, "x" * 60)]
    monkeypatch.setattr(queries, "_table", lambda spark, sf_dir, name: frame(spark, rows))
    stored = tokens.prefix_counts
    monkeypatch.setattr(tokens, "prefix_counts", lambda *a, **k: seen.append(stored(*a, **k)) or seen[-1])
    got = {r.doc_id: r for r in queries.op8_token_counts(spark, "").collect()}
    deltas = {r.doc_id: r.prefix_deltas for r in seen[0].collect()}
    assert all(d is not None and got[i].n_tokens == int(tokens.counts_of(d)[-1] if d else 0) for i, d in deltas.items())
    assert {i: r.over_limit for i, r in got.items()} == {1: False, 2: False, 3: False, 4: False, 5: True, 6: False}
    c = tokens.PrefixCounter(WORD_BPE)
    for t in (t for _, t in rows if t):  # the same with and without what is kept of words
        assert c.prefixes_of(t) == own(tokens.PrefixCounter(WORD_BPE), t) and c.prefixes_of(t)[1] == c.ends(t)


def test_work_on_new_words_is_done_symbol_by_symbol_without_calls():
    """twice the symbols of a new word don't cost more calls of Python functions, once its tokens' pairs are known."""
    import sys

    from gazeflow.llm import tokens

    rng, c = random.Random(1), tokens.PrefixCounter(WORD_BPE)
    words = [["".join(rng.choice("ab") for _ in range(n)) for _ in range(2000)] for n in (40, 40, 20)]
    c.prefixes_of(" ".join(words[0]))
    calls = []
    for new in words[1:]:
        seen = []
        sys.setprofile(lambda frame, event, arg: seen.append(1) if event == "call" else None)  # noqa: B023
        try:
            c.prefixes_of(" ".join(new))
        finally:
            sys.setprofile(None)
        calls.append(len(seen) / len(new))
    assert calls[0] < 1.2 * calls[1] and calls[0] < 20, calls


@pytest.mark.parametrize("group,recent,pairs,places", [(1, 1, 1, 1), (200, 7, 50, 20), (1 << 20, 1 << 20, 1 << 20, 1 << 20)])
def test_prefix_counts_whatever_is_kept(monkeypatch, group, recent, pairs, places):
    """groups of texts and what is kept of words change no count."""
    from tokenizers import Tokenizer

    from gazeflow.llm import tokens

    for name, value in (("GROUP", group), ("RECENT", recent), ("PAIRS", pairs), ("PLACES", places)):
        monkeypatch.setattr(tokens, name, value)
    library, c, rng = Tokenizer.from_file(WORD_BPE), tokens.PrefixCounter(WORD_BPE), random.Random(5)
    rows = ["".join(rng.choice("abthe'sTr\u00e91 \n.,-|\t\u03a3\u65e5\u3000\xa0") for _ in range(rng.randint(0, 60))) for _ in range(60)]
    rows += ["", " ", "x" * 60, "\u00e9" * 25, "we'll the's 'tis", "the then them the", "a\u0301b A\u0301"]
    for t, (deltas, ends) in zip(rows, c.prefixes_of_all(rows), strict=True):
        normal = library.normalizer.normalize_str(t)
        want = [len(library.encode(normal[:k], add_special_tokens=False).ids) for k in range(1, len(normal) + 1)]
        assert tokens.counts_of(deltas).tolist() == want and sum(ends) == (want[-1] if want else 0), t
    specials = ["x<|endoftext|>y <|endoftext|>", "<|startoftext|>"]
    for t, (deltas, _) in zip(specials, c.prefixes_of_all(specials), strict=True):
        assert tokens.last_count(deltas) == len(library.encode(t, add_special_tokens=False).ids)
    assert list(c.prefixes_of_all([])) == []
