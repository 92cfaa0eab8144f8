"""Tokenizing, token counts and packing against the library."""

import zlib
from types import SimpleNamespace

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from data import DOCS, frame, odd_rows, prose
from eventmine.llm import packing, token_counts, tokenizing

BYTE, WORD = (public_tokenizers.path(f) for f in ("byte_bpe_50k.json", "word_bpe_49k.json"))
PIECES = st.sampled_from([" ", "  ", "\n", "\t\n", " ", " ", "\x1c", "́", "'", "'s", "don't", ",", "...", "é", "ß", "×", "÷",
                          "The", "naïve", "İ", "Σς", "日本", "🙂", "<|endoftext|>", "<|", "12", "3.5", "\x00", "K", "=", "̸", "zzz"])


@pytest.mark.parametrize("path", [BYTE, WORD])
@settings(max_examples=400, deadline=None, derandomize=True)
@given(st.lists(st.lists(PIECES, max_size=14).map("".join), max_size=4))
def test_pieces_give_the_librarys_ids(path, texts):
    tok = tokenizing.piece_tokenizer(path)
    want = [e.ids for e in tok.tok.encode_batch(texts, add_special_tokens=False)] if texts else []
    got = tokenizing.batched([t.encode() for t in texts], tok, True)
    assert [list(ids) for _, ids in got] == want
    assert [n for n, _ in got] == [len(w) for w in want]


@settings(max_examples=200, deadline=None, derandomize=True)
@given(st.lists(PIECES, max_size=60).map("".join), st.integers(8, 40), st.integers(1, 30))
def test_windows_splice_to_the_whole_count(text, chunk, overlap):
    tok = tokenizing.piece_tokenizer(BYTE)
    assert token_counts.count_batch([text.encode()], tok, chunk, overlap) == [len(tok.tok.encode(text, add_special_tokens=False).ids)]


def test_overlap_widens_until_it_finds_a_boundary():
    tok = tokenizing.piece_tokenizer(BYTE)
    text = "a " + "é" * 3000 + " b " + "日" * 2000
    assert token_counts.count_batch([text.encode()], tok, 64, 8) == [len(tok.tok.encode(text, add_special_tokens=False).ids)]


def test_a_full_cache_starts_over(monkeypatch):
    monkeypatch.setattr(tokenizing, "MAX_PIECES", 5)
    tok = tokenizing.PieceTokenizer(WORD)
    texts = [prose(k, 40) for k in range(6)]
    got = [tokenizing.batched([t.encode()], tok, True)[0][1].tolist() for t in texts]
    assert got == [tok.tok.encode(t, add_special_tokens=False).ids for t in texts]


def test_token_counts_of_odd_rows(spark):
    rows = odd_rows()
    tok = tokenizing.load_tokenizer(BYTE)
    got = token_counts.count_tokens(frame(spark, rows), BYTE, chunk=4096, overlap=64).collect()
    key = lambda x: (x[0] is None, x[0] or 0, x[1])
    want = [(r[0], len((r[1] or "").encode()), len(tok.encode(r[1] or "", add_special_tokens=False).ids)) for r in rows]
    assert sorted(map(tuple, (g[:3] for g in got)), key=key) == sorted(want, key=key)
    assert all(g.over_limit == (g.n_tokens > 512) for g in got)
    assert token_counts.count_tokens(spark.createDataFrame([], DOCS), BYTE).count() == 0


def test_exact_complement():
    rest = np.zeros(101, int)
    rest[[10, 20, 30, 45]] = [2, 1, 1, 1]
    assert packing.exact_complement(rest, 45) == [45]
    assert packing.exact_complement(rest, 65) == [45, 20]
    assert packing.exact_complement(rest, 60) == [30, 20, 10]
    assert packing.exact_complement(rest, 65 + 10) == [45, 30]
    assert packing.exact_complement(rest, 40) == [30, 10]
    assert packing.exact_complement(rest, 99) is None
    rest[10] = 1
    assert packing.exact_complement(rest, 20) == [20]
    rest[20] = 0
    assert packing.exact_complement(rest, 20) is None  # two of the same need two


@settings(max_examples=100, deadline=None, derandomize=True)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 40), min_size=1))
def test_patterns_use_every_piece_once_and_fit(counts):
    patterns = packing.plan_patterns(counts, 64)
    used = {}
    for pattern, times in patterns:
        assert sum(pattern) <= 64 and times > 0
        for x in pattern:
            used[x] = used.get(x, 0) + times
    assert used == counts
    total, n = sum(k * v for k, v in counts.items()), sum(t for _, t in patterns)
    assert n <= 2 * -(-total // 64)


def check_packed(got, want, seq_len):
    """want: (doc_id, ids) of every row."""
    pieces = sorted((i is not None, i or 0, s // seq_len, s, len(x), zlib.crc32(np.array(x, "<u4").tobytes()))
                    for i, ids in want for s in range(0, len(ids), seq_len) for x in [ids[s:s + seq_len]])
    assert sorted((r.doc_id is not None, r.doc_id or 0, r.piece, r.start, r.length, r.ids_crc32) for r in got) == pieces
    places = {}
    for r in got:
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for placed in places.values():
        end = 0
        for offset, length in sorted(placed):
            assert offset == end
            end += length
        assert end <= seq_len
    return len(places)


def test_packing_of_odd_rows(spark):
    rows = odd_rows()
    tok = tokenizing.load_tokenizer(WORD)
    got = packing.pack(packing.encode_pieces(frame(spark, rows).repartition(5), WORD)).collect()
    want = [(r[0], tok.encode(r[1] or "", add_special_tokens=False).ids + [1]) for r in rows]
    check_packed(got, want, 4096)
    empty = packing.pack(packing.encode_pieces(spark.createDataFrame([], DOCS), WORD))
    assert empty.count() == 0 and "sequence_id" in empty.columns


def test_packing_is_tight_with_a_hot_length(spark):
    rows = [(k, prose(k % 50, 20 + k % 37) if k % 3 else None, "en", "s", 0) for k in range(600)]
    tok = tokenizing.load_tokenizer(WORD)
    got = packing.pack(packing.encode_pieces(spark.createDataFrame(rows, DOCS).repartition(4), WORD, seq_len=256), seq_len=256).collect()
    want = [(r[0], tok.encode(r[1] or "", add_special_tokens=False).ids + [1]) for r in rows]
    n = check_packed(got, want, 256)
    assert n <= 1.02 * sum(len(ids) for _, ids in want) / 256 + 1


def test_packing_moves_no_pieces_for_few_counts(spark, tmp_path):
    """Each task of the input writes one file, however many parts a shuffle has."""
    rows = [(k, prose(k % 50, 20 + k % 37), "en", "s", 0) for k in range(60)]
    conf = {"spark.sql.shuffle.partitions": "40", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in conf}
    docs = spark.createDataFrame(spark.sparkContext.parallelize(rows, 3), DOCS)
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        packing.pack(packing.encode_pieces(docs, WORD, seq_len=64), seq_len=64).write.parquet(str(tmp_path / "out"))
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert len(list((tmp_path / "out").glob("part-*"))) == 3
    tok = tokenizing.load_tokenizer(WORD)
    want = [(r[0], tok.encode(r[1], add_special_tokens=False).ids + [1]) for r in rows]
    check_packed(spark.read.parquet(str(tmp_path / "out")).collect(), want, 64)


def test_pieces_can_carry_their_ids(spark):
    df = spark.createDataFrame([(1, "some words here", "en", "s", 0)], DOCS)
    r = packing.pack(packing.encode_pieces(df, WORD, with_ids=True)).collect()[0]
    assert zlib.crc32(r.ids) == r.ids_crc32 and len(r.ids) == 4 * r.length


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_pieces_of_one_hash_keep_their_own_ids(name):
    """Letter runs in the Thue-Morse order, whose polynomial hashes collide."""
    path = public_tokenizers.path(name)
    tok, lib = tokenizing.PieceTokenizer(path), tokenizing.load_tokenizer(path)
    texts = []
    for n in (512, 1024, 2048, 4096):
        for a, b in ("ab", "xz"):
            run = "".join((a, b)[bin(k).count("1") % 2] for k in range(n))
            texts += [run, run.translate(str.maketrans(a + b, b + a))]
    got = tokenizing.batched([" ".join(texts).encode(), *(t.encode() for t in texts)], tok, True)
    for t, (n, ids) in zip([" ".join(texts), *texts], got):
        want = lib.encode(t, add_special_tokens=False).ids
        assert n == len(want) and list(ids) == want


def test_bytes_that_are_not_utf8_are_replaced(spark):
    df = spark.sql("SELECT 1L AS doc_id, cast(unhex('61FF6220C3212063') AS string) AS text")
    path = public_tokenizers.path("byte_bpe_50k.json")
    want = tokenizing.load_tokenizer(path).encode("a�b �! c", add_special_tokens=False).ids
    r = token_counts.count_tokens(df, path).collect()[0]
    assert (r.n_bytes, r.n_tokens) == (8, len(want))
    piece = packing.encode_pieces(df, public_tokenizers.path("word_bpe_49k.json"), with_ids=True).collect()
    assert len(piece) == 1 and piece[0].length > 1


def test_a_blocks_new_pieces_share_the_words_that_reach_the_library(monkeypatch):
    tok, lib = tokenizing.PieceTokenizer(WORD), tokenizing.load_tokenizer(WORD)
    met = []
    model = tok.model
    monkeypatch.setattr(tok, "model", SimpleNamespace(tokenize=lambda w: met.append(w) or model.tokenize(w)))
    text = "été Été Straße straße lorem Lorem LOREM\nlorem ipsum\nipsum"
    got = tokenizing.batched([text.encode()], tok, True)
    assert got[0][1].tolist() == lib.encode(text, add_special_tokens=False).ids
    assert len(met) == len(set(met)) == 4


@pytest.mark.parametrize("name", ["WORD", "BYTE"])
def test_every_byte_of_plain_words_has_the_librarys_ids(name):
    path = globals()[name]
    tok, lib = tokenizing.PieceTokenizer(path), tokenizing.load_tokenizer(path)
    letters = [chr(c) for c in range(0x41, 0x100) if tokenizing._WORD.fullmatch(chr(c))]
    texts = [f"{a}{b} {b}{a}x" for a in letters[::3] for b in letters[::5]]
    got = tokenizing.batched([t.encode() for t in texts], tok, True)
    assert [x.tolist() for _, x in got] == [lib.encode(t, add_special_tokens=False).ids for t in texts]
