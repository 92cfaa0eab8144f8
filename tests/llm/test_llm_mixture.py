"""Mixing and sharding against their definitions."""

import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from data import DOCS, frame, odd_rows, prose
from eventmine.llm import mixing, sharding
from eventmine.llm.common import n_words, random_key, range_buckets, row_hash

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def size(text):
    return len(WORD.findall(text or ""))


def targets(sizes):
    """Shares by weight, capped at three times the size, the excess shared again."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    total, capped = sum(sizes.values()), {}
    while True:
        rest = [s for s in order if s not in capped]
        left = total - sum(capped.values())
        share = {s: left * weight[s] / sum(weight[r] for r in rest) for s in rest}
        over = [s for s in rest if share[s] > 3 * sizes[s]]
        if not over:
            return {**capped, **share}
        capped.update({s: 3 * sizes[s] for s in over})


def test_words_are_counted_as_the_pattern_does(spark):
    texts = [None, "", " ", "a", " a\nb\x0b\x0cc ", "a b", "\x1c", "é é"]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, text string")
    got = {r.k: r.n for r in df.select("k", n_words().alias("n")).collect()}
    assert got == {k: size(t) for k, t in enumerate(texts)}


@pytest.mark.parametrize("rows", [odd_rows(), [(k, prose(k, 1 + k % 90), "en", None if k % 11 == 0 else f"s{min(k % 7, 3)}é", 0) for k in range(300)],
                                  [(1, None, "en", "a", 0), (2, " ", "en", None, 0)]])
def test_budgets(spark, rows):
    got = mixing.budgets(frame(spark, rows).repartition(3)).collect()
    sizes = defaultdict(int)
    for r in rows:
        sizes[r[3]] += size(r[1])
    want = targets(dict(sizes)) if sum(sizes.values()) else {s: 0 for s in sizes}
    assert Counter((r.doc_id, r["size"], r.source) for r in got) == Counter((r[0], size(r[1]), r[3]) for r in rows)
    taken = defaultdict(int)
    for r in got:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source])
        assert 0 <= r.taken <= 3 * r["size"]
        taken[r.source] += r.taken
    assert all(taken[s] == pytest.approx(want[s], abs=1) for s in sizes)
    again = mixing.budgets(frame(spark, rows).repartition(7)).collect()
    assert Counter(map(tuple, got)) == Counter(map(tuple, again))


def test_mixed_documents_hold_what_is_taken(spark):
    rows = [(k, f"\t{prose(k, 5 + k % 40)}\n end ", "en", f"s{k % 4}", 7) for k in range(80)]
    taken = {r.doc_id: r.taken for r in mixing.budgets(spark.createDataFrame(rows, DOCS)).collect()}
    mixed = mixing.mix(frame(spark, rows))
    assert mixed.columns == frame(spark, rows).columns
    words = defaultdict(int)
    texts = {r[0]: r[1] for r in rows}
    cut = 0
    for r in mixed.collect():
        words[r.doc_id] += size(r.text)
        assert texts[r.doc_id].startswith(r.text) and r.n_chars == 7
        cut += r.text != texts[r.doc_id]
    assert {k: v for k, v in taken.items() if v} == dict(words) and cut <= 4
    assert mixing.mix(spark.createDataFrame([], DOCS)).count() == 0


def test_each_row_is_mixed_by_its_own_budget(spark):
    """Rows that share an id, null included, in several sources."""
    rows = odd_rows() + [(k % 7 if k % 7 else None, prose(k % 50, 5 + k % 50), "en", f"s{k % 3}", 0) for k in range(120)] + [(1, prose(2, 40), "en", "b", 0)] * 3
    sizes, words = defaultdict(int), defaultdict(int)
    for r in rows:
        sizes[r[3]] += size(r[1])
    mixed = mixing.mix(frame(spark, rows).repartition(3)).collect()
    for r in mixed:
        words[r.source] += size(r.text)
    want = targets(dict(sizes))
    assert all(words[s] == pytest.approx(want[s], abs=1) for s in sizes)
    given, whole, cut = Counter(r[:5] for r in rows), Counter(tuple(r)[:5] for r in mixed), Counter()
    for r in list(whole):
        if r not in given:  # the one a budget ends in
            cut[r[3]] += whole.pop(r)
    assert sum(cut.values()) <= len(sizes) and set(cut.values()) <= {1}
    for s in sizes:  # each row of a source whole times, some once more
        times = {r: whole[r] / n for r, n in given.items() if r[3] == s and size(r[1])}
        epochs = int((want[s] + 1e-6) // sizes[s]) if sizes[s] else 0
        assert all(epochs <= t <= epochs + 1 for t in times.values())


@pytest.mark.parametrize("rows,n", [(odd_rows(), 4), (odd_rows(), 40), ([(k, prose(k, k % 30), "en", "hot" if k % 3 else f"s{k % 5}", 0) for k in range(997)], 40)])
def test_shards_are_even_and_match_the_mixture(spark, rows, n):
    got = sharding.shard(frame(spark, rows).repartition(3), n).collect()
    assert Counter((r.doc_id, r["size"], r.text_crc32, r.source) for r in got) == Counter(
        (r[0], len((r[1] or "").encode()) + 16, zlib.crc32((r[1] or "").encode()), r[3]) for r in rows)
    assert {r.law for r in got} == {"rows"} and all(r.grown_shard is None for r in got)
    by = defaultdict(list)
    for r in got:
        by[r.shard].append(r)
    counts = [len(by.get(s, [])) for s in range(n)]
    assert max(counts) - min(counts) <= 1 and set(by) <= set(range(n))
    for s in by:
        assert sorted(r.slot for r in by[s]) == list(range(len(by[s])))
    for source, k in Counter(r[3] for r in rows).items():
        # a stretch holds each source's share but for one row per source
        assert all(abs(sum(r.source == source for r in by[s]) - k * len(by[s]) / len(rows)) <= 1 + len({r[3] for r in rows}) for s in by)


def test_no_rows_no_shards(spark):
    assert sharding.shard(spark.createDataFrame([], DOCS)).count() == 0
    assert mixing.budgets(spark.createDataFrame([], DOCS)).count() == 0


def largest_share(rows):
    """The largest range bucket, as a multiple of the mean."""
    n = [r["count"] for r in rows.groupBy("_bucket").count().collect()]
    return max(n) / (sum(n) / 8)


def test_a_long_run_of_blanks_takes_linear_time(spark):
    import time

    df = spark.range(1).select(F.concat(F.lit("a"), F.repeat(F.lit(" "), 1_000_000), F.lit("b\u00a0c"), F.repeat(F.lit("\n"), 1_000_000)).alias("text"))
    n_words()
    df.select(n_words().alias("n")).collect()
    t = time.time()
    assert df.select(n_words().alias("n")).collect()[0].n == 2
    assert time.time() - t < 2


@pytest.mark.parametrize("id_of, source_of", [("id", "cast(id AS string)"), ("if(id % 3 = 0, null, id)", "if(id % 2 = 0, null, 'a')"), ("7", "'a'")])
def test_buckets_are_even_whatever_ids_and_sources(spark, id_of, source_of):
    docs = spark.range(20_000).selectExpr(f"cast({id_of} AS bigint) AS doc_id", f"{source_of} AS source", "'a b c' AS text", "'en' AS lang", "1L AS n_chars")
    order = [F.col(c) for c in ("source", "_random", "size")]
    rows = docs.withColumn("_random", random_key("doc_id", 17)).withColumn("size", F.lit(3))
    assert largest_share(range_buckets(rows, order)) < 2
    seen = []
    orig = sharding.range_buckets
    try:
        sharding.range_buckets = lambda df, by: seen.append(orig(df, by)) or seen[-1]
        got = sharding.shard(docs).groupBy("shard").count().collect()
    finally:
        sharding.range_buckets = orig
    assert len(seen) == 2 and all(largest_share(x) < 2 for x in seen)
    assert len(got) == 40 and {r["count"] for r in got} == {500}


def test_rows_with_swapped_nulls_are_told_apart(spark):
    rows = [(1, "a b c d", "en", None, 1), (1, "a b c d", None, "en", 1), (1, "a b c d", None, "en", 1), (None, "x y", "en", None, 2), (None, "x y", None, "en", 2)]
    kinds = "doc_id long, text string, lang string, source string, n_chars long, m map<string,int>, a array<int>"
    df = spark.createDataFrame([(*r, {"k": n % 2}, [None, n] if n % 2 else [n, None]) for n, r in enumerate(rows)], kinds)
    hashes = [r.h for r in df.select(row_hash(df).alias("h")).collect()]
    assert len(set(hashes)) == 5
    taken = Counter()
    for r in mixing.budgets(df).collect():
        taken[r.source] += r.taken
    mixed = Counter()
    for r in mixing.mix(df).collect():
        mixed[r.source] += size(r.text)
    assert mixed == taken and sum(taken.values()) == sum(size(r[1]) for r in rows)
