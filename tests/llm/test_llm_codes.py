"""Vector codes against plain assignment; byte-level BPE against the library."""

import base64

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from data import frame, odd_rows, prose
from eventmine.llm import byte_bpe, vector_codes

VECTORS = "vec_id long, embedding array<float>, label int"


def plain_codes(rows, parts=16, k=64, rounds=2):
    """Codes, errors and codebooks by all distances in each round; rows in order of their key."""
    x = np.stack([np.floor(256 * np.array(v, np.float32).astype(float)).astype(np.int64) for _, v, _ in rows])
    w = x.shape[1] // parts
    x = x.reshape(len(x), parts, w).transpose(1, 0, 2)
    books = x[:, :k].copy()

    def assign():
        d = ((x[:, :, None] - books[:, None]) ** 2).sum(axis=3)
        return d.argmin(axis=2), d.min(axis=2)

    for _ in range(rounds):
        code, _d = assign()
        for p in range(parts):
            for e in range(books.shape[1]):
                own = x[p][code[p] == e]
                if len(own):
                    books[p, e] = own.sum(axis=0) // len(own)
    code, d = assign()
    return [(r[0], r[2], bytes(code[:, n].tolist()), int(d[:, n].sum())) for n, r in enumerate(rows)], books


def coded(df, **options):
    out, books = vector_codes.compress(df, **options)
    return sorted(((r.vec_id, r.label, bytes(r.code), r.error) for r in out.collect()), key=repr), books


@pytest.mark.parametrize("spread, dims", [(0.1, 64), (1.0, 64), (0.01, 32), (30.0, 16)])
def test_codes_equal_all_distances(spark, spread, dims):
    r = np.random.default_rng(int(spread * 100))
    centres = r.normal(size=(40, dims))
    rows = [(k, (centres[k % 40] + spread * r.normal(size=dims)).astype(np.float32).tolist(), k % 3) for k in range(700)]
    rows += [(k + 700, rows[k][1], None) for k in range(0, 60, 2)]  # repeated vectors
    got, books = coded(spark.createDataFrame(rows, VECTORS).repartition(5))
    want, want_books = plain_codes(rows)
    assert (books == want_books).all() and got == sorted(want, key=repr)


def test_rounds_use_what_is_kept(spark):
    """More rounds, fewer entries, other bounds: always the same as all distances."""
    r = np.random.default_rng(3)
    rows = [(k, r.integers(-3, 4, 32).astype(float).tolist(), 0) for k in range(400)]  # many ties
    df = spark.createDataFrame(rows, VECTORS)
    for options in ({"rounds": 5, "entries": 20}, {"bounds": 1}, {"bounds": 64, "rounds": 3}, {"rounds": 0}):
        want, want_books = plain_codes(rows, k=options.get("entries", 64), rounds=options.get("rounds", 2))
        got, books = coded(df, **options)
        assert (books == want_books).all() and got == sorted(want, key=repr), options


@settings(max_examples=60, deadline=None, derandomize=True)
@given(st.integers(0, 10_000), st.integers(1, 12), st.integers(1, 9))
def test_bounds_are_sound(seed, k, bounds):
    r = np.random.default_rng(seed)
    x, books = r.integers(-50, 50, (80, 3)), r.integers(-50, 50, (k, 3))
    near, low, outer, squared = vector_codes.nearest(x, books, bounds)
    for _ in range(3):
        new = books + r.integers(-4, 5, books.shape)
        moved = np.sqrt(((new - books) ** 2).sum(axis=1)) * (1 + 1e-9)
        books = new
        near, low, outer, squared, used = vector_codes.again(x, books, moved, near, low, outer)
        d = ((x[:, None] - books) ** 2).sum(axis=2)
        assert (near[:, 0] == d.argmin(axis=1)).all() and (squared == d.min(axis=1)).all()
        true = np.sqrt(np.take_along_axis(d, near.astype(int), 1))
        assert (low.astype(float)[:, 1:] <= true[:, 1:] + 1e-9).all()
        rest = d.astype(float)
        np.put_along_axis(rest, near.astype(int), np.inf, 1)
        assert (outer.astype(float) <= np.sqrt(rest.min(axis=1)) + 1e-9).all() and used >= 1


def test_odd_vectors(spark):
    v = [float(k) for k in range(16)]
    rows = [(1, v, 1), (1, v, 1), (2, [-x / 7 for x in v], None), (None, v, None), (3, None, 1), (4, [None] + v[1:], 1), (5, [float("nan")] + v[1:], 1),
            (6, [float("inf")] + v[1:], 2), (7, v[:5], 2), (8, v + v, 2), (9, [], 1), (10, [-0.0] * 16, 1), (11, [1e30] + v[1:], 1)]
    df = spark.createDataFrame(rows, VECTORS).withColumn("_id", F.lit("x")).withColumn("code", F.lit(1)).withColumn("error", F.lit(1))
    kept = [r for r in rows if r[0] in (1, 2, 10)] + [(None, v, None)]
    want, books = plain_codes(kept)
    got, got_books = coded(df)
    assert got == sorted(want, key=repr) and (books == got_books).all() and books.shape == (16, 5, 1)
    summed = {r.label: r.label_error for r in vector_codes.with_label_error(vector_codes.compress(df)[0]).collect()}
    assert set(summed) == {1, None} and summed[1] == sum(e for _, label, _, e in want if label == 1)
    none, books = vector_codes.compress(df.limit(0))
    assert none.count() == 0 and books.size == 0 and vector_codes.with_label_error(none).count() == 0


RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
OF = (RANKS, public_tokenizers.PATTERN)


@pytest.fixture(scope="module")
def library():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


ODD_TEXTS = [
    "", " ", "\n\n  x", "<|endoftext|> hi", "a" * 5000, "ab" * 3000 + " " * 4000 + "z", "日本語" * 2000, "é" * 300 + "́   x", "'s'll don't I'VE 'S ''s",
    "\x00\x1c \x85a b", "🙂🙃" * 50, "a\tb\r\n c", "1234567890" * 40, "²³½ Ⅳ", "x" + "‍" * 9, prose(1, 3000), "".join("ab"[bin(k).count("1") % 2] for k in range(4096)),
]


def test_a_perfect_hash_is_a_permutation():
    for n in (1, 2, 7, 5000):
        keys = np.random.default_rng(n).integers(1, 1 << 63, n, dtype=np.uint64)
        h = byte_bpe.PerfectHash(keys)
        assert sorted(h.slots(keys).tolist()) == list(range(n))
        other = h.slots(keys ^ np.uint64(1))
        assert (other >= 0).all() and (other < n).all()
    with pytest.raises(ValueError):
        byte_bpe.PerfectHash(np.array([3, 3], np.uint64))


def test_tiers(library):
    bpe = byte_bpe.load_vocabulary(*OF)
    tokens = list(bpe.ranks)
    data = np.frombuffer(b"".join(tokens), np.uint8)
    ends = np.cumsum([len(t) for t in tokens])
    starts = np.append(0, ends[:-1])
    assert bpe.tier_one(data, starts, ends).tolist() == list(bpe.ranks.values())  # every token is found
    assert (bpe.tier_one(data, starts[:-1], ends[1:])[:3000] >= -1).all()
    for word in ("zqxj", "ka" * 40, "Überländisch", "a" * 999):
        assert byte_bpe.merged(word.encode(), bpe.ranks) == library._encode_single_piece(word.encode())


def test_short_pretokens_are_merged_together(library, monkeypatch):
    bpe = byte_bpe.ByteBpe(*OF)
    r = np.random.default_rng(3)
    words = [bytes(r.choice(np.frombuffer(of, np.uint8), r.integers(1, 65)).tolist())
             for of in (b"etaoinshrdlu ", b"aab", "é日\xa0".encode(), bytes(range(256))) for _ in range(300)] + [bytes([b]) for b in range(256)]
    want = [library._encode_single_piece(w) for w in words]
    heap = []
    monkeypatch.setattr(byte_bpe, "merged", lambda piece, ranks, f=byte_bpe.merged: heap.append(piece) or f(piece, ranks))
    for _ in range(2):  # new, then kept
        ids, sizes = bpe.tier_two(words + words[::-1])
        assert sizes.tolist() == [len(w) for w in want + want[::-1]] and ids.tolist() == [x for w in want + want[::-1] for x in w]
    assert not heap
    long = b"ab" * byte_bpe.KEPT_BYTES
    assert bpe.tier_two([long, b"zqxj", long])[0].tolist() == [x for w in (long, b"zqxj", long) for x in library._encode_single_piece(w)]
    assert heap == [long]


@settings(max_examples=150, deadline=None, derandomize=True)
@given(st.lists(st.text(st.sampled_from("abcz '\n\t1é日.-") | st.characters(codec="utf-8"), max_size=60), max_size=6), st.integers(8, 200))
def test_ids_equal_the_library(library, texts, block):
    bpe = byte_bpe.load_vocabulary(*OF)
    ids, sizes = bpe.encode([t.encode() for t in texts], block)
    want = [library.encode_ordinary(t) for t in texts]
    assert sizes.tolist() == [len(w) for w in want] and ids.tolist() == [x for w in want for x in w]


def test_odd_texts_in_blocks(library):
    bpe = byte_bpe.load_vocabulary(*OF)
    long = " ".join(ODD_TEXTS * 3)
    for text in [*ODD_TEXTS, long]:
        for block in (64, 4096, byte_bpe.BLOCK):
            parts = list(byte_bpe.cut_at_boundaries(text.encode(), block))
            assert b"".join(parts) == text.encode()
            assert bpe.encode([text.encode()], block)[0].tolist() == library.encode_ordinary(text)


def test_round_trip_of_odd_rows(spark, library):
    rows = odd_rows() + [(100 + k, t, None, "a", 0) for k, t in enumerate(ODD_TEXTS)]
    df = frame(spark, rows).withColumn("ids", F.lit(1)).withColumn("bytes", F.lit(2))
    out = byte_bpe.decode(byte_bpe.encode(df, *OF, keys=("doc_id", "text")), *OF).collect()
    assert len(out) == len(rows)
    for r in out:
        assert r.ids == library.encode_ordinary(r.text or "") and bytes(r.bytes) == (r.text or "").encode()
    assert byte_bpe.decode(byte_bpe.encode(df.limit(0), *OF), *OF).count() == 0


def test_bytes_that_are_not_utf8(spark, library):
    df = spark.sql("SELECT 1L AS doc_id, cast(unhex('61FF62C3') AS string) AS text")
    r = byte_bpe.decode(byte_bpe.encode(df, *OF), *OF).collect()[0]
    assert bytes(r.bytes).decode() == "a�b�" and r.ids == library.encode_ordinary("a�b�")
    with pytest.raises(Exception, match="outside the vocabulary"):
        byte_bpe.decode(spark.createDataFrame([([60_000],)], "ids array<int>"), *OF).collect()
    assert byte_bpe.decode(spark.createDataFrame([(None,), ([],)], "ids array<int>"), *OF).collect()[0].bytes is None
