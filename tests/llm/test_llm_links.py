"""Near duplicates of vectors and texts, components, repeated passages: against brute force."""

import hashlib
import time
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from data import DOCS, frame, odd_rows, prose
from eventmine.llm import bwt, repeats, text_links, vector_links
from eventmine.llm.common import cut_lineage
from eventmine.llm.components import components

VECTORS = "vec_id long, embedding array<float>, label int"


def smallest(n, edges, key):
    """Smallest key of each node's component."""
    root = list(range(n))

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in edges:
        root[find(a)] = find(b)
    low = {}
    for x in range(n):
        if key[x] is not None:
            r = find(x)
            low[r] = min(low.get(r, key[x]), key[x])
    return [low.get(find(x)) if key[x] is not None else None for x in range(n)]


def test_components(spark):
    edges = [(k, k + 1) for k in range(0, 60)] + [(100, k) for k in range(101, 160)] + [(7, 7), (200, 201), (201, 200)]
    mix = lambda x: (x * 0x9E3779B97F4A7C15) % (1 << 63)
    got = components(spark.createDataFrame([(mix(a), mix(b)) for a, b in edges], "a long, b long")).collect()
    of = {r.node: r.root for r in got}
    assert len(got) == len(of) == 61 + 60 + 2
    groups = [range(0, 61), range(100, 160), (200, 201)]
    assert all(len({of[mix(x)] for x in g}) == 1 for g in groups) and len(set(of.values())) == 3
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def brute_vectors(rows, threshold=0.98):
    def unit(v, label, key):
        if v is None or label is None or key is None or not len(v) or any(x is None or not np.isfinite(x) for x in v) or not any(v):
            return None
        x = np.array(v, np.float32).astype(float)
        return x / np.sqrt((x * x).sum())

    units = [unit(v, label, k) for k, v, label in rows]
    edges = [(a, b) for a in range(len(rows)) for b in range(a) if units[a] is not None and units[b] is not None
             and rows[a][2] == rows[b][2] and len(units[a]) == len(units[b]) and units[a] @ units[b] >= threshold]
    n = Counter(x for e in edges for x in e)
    comp = smallest(len(rows), edges, [r[0] for r in rows])
    return Counter((r[0], n[k], comp[k], r[0] is not None and comp[k] == r[0]) for k, r in enumerate(rows))


def vectors(seed, n, copies, noise, dim=64):
    r = np.random.default_rng(seed)
    base = r.standard_normal((n, dim))
    near = base[r.integers(0, n, copies)]
    near = near + noise * r.standard_normal(near.shape)
    hot = base[0] + 0.11 * r.standard_normal((copies, dim))
    return [(k, v.astype(np.float32).tolist(), k % 3 if k < n + copies else 0) for k, v in enumerate(np.concatenate([base, near, hot, base[:9], base[:9]]))]


@pytest.mark.parametrize("block", [16, 1024])
def test_vector_links(spark, block):
    rows = vectors(1, 120, 80, 0.1)
    df = spark.createDataFrame(rows, VECTORS)
    got = vector_links.links(df.repartition(3), block=block).collect()
    assert Counter(map(tuple, got)) == brute_vectors(rows)


def test_vectors_of_every_odd_kind(spark):
    one = [1.0] + [0.0] * 5
    rows = [(1, one, 1), (2, one, 1), (2, one, 1), (3, one, 2), (4, one, None), (5, None, 1), (6, [0.0] * 6, 1), (7, [None] + [1.0] * 5, 1),
            (8, [float("nan")] + [1.0] * 5, 1), (9, [float("inf")] + [1.0] * 5, 1), (10, [2.0] + [0.0] * 5, 1), (11, [1.0, 0.0], 1), (12, [], 1),
            (None, one, 1), (13, [-1.0] + [0.0] * 5, 1), (14, [3.0], 1), (15, [5.0], 1)]
    df = spark.createDataFrame(rows, VECTORS).selectExpr("*", "1 AS _id", "2 AS _cls", "3 AS n_links", "4 AS _v")
    assert Counter(map(tuple, vector_links.links(df).collect())) == brute_vectors(rows)
    assert vector_links.links(spark.createDataFrame([], VECTORS)).count() == 0


def test_recall_at_the_threshold():
    r = np.random.default_rng(3)
    a = r.standard_normal((4000, 64))
    a /= np.linalg.norm(a, axis=1)[:, None]
    e = r.standard_normal(a.shape)
    e -= (e * a).sum(1)[:, None] * a
    b = 0.98 * a + np.sqrt(1 - 0.98 ** 2) * e / np.linalg.norm(e, axis=1)[:, None]
    label = np.zeros(4000, np.int64)
    x, y = (vector_links.buckets(v, label, 4, 2, 4) for v in (a, b))
    found = ((x[:, :, :1] == y).any(2) | (y[:, :, :1] == x).any(2)).any(1)
    assert found.mean() > 0.999


def shingle_set(text):
    words = (text or "").encode().lower().split()
    return {tuple(words[k:k + 5]) for k in range(max(1, len(words) - 4))} if words else set()


def brute_texts(rows):
    sets = [shingle_set(r[1]) for r in rows]
    edges = [(a, b) for a in range(len(rows)) for b in range(a) if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    comp = smallest(len(rows), edges, [r[0] for r in rows])
    return Counter((r[0], len(sets[k]), comp[k], r[0] is not None and comp[k] == r[0]) for k, r in enumerate(rows))


def variants(seed, text, n, edits):
    r = np.random.default_rng(seed)
    for _ in range(n):
        words = text.split()
        for at in r.integers(0, len(words), r.integers(0, edits + 1)):
            words[at] = f"w{r.integers(1 << 30)}"
        yield " ".join(words)


def test_text_links(spark):
    texts = [prose(k, 60 + k) for k in range(30)]
    hot = list(variants(1, prose(99, 150), 60, 5))  # a chain: many are linked only through others
    short = ["a b c d e f g", "a b c d e f", "a b c d e f g h", "x y", "X  y", "x", "", None, "A b C d e f g"]
    some = [v for k in range(10) for v in variants(k, texts[k], 4, 3)]
    rows = [(k, t, "en", "s", 0) for k, t in enumerate(texts + hot + short + some)]
    got = text_links.links(spark.createDataFrame(rows[::-1], DOCS).repartition(5)).collect()
    assert Counter(map(tuple, got)) == brute_texts(rows)


def test_text_links_of_odd_rows(spark):
    rows = odd_rows()
    got = text_links.links(frame(spark, rows)).collect()
    assert Counter(map(tuple, got)) == brute_texts(rows)
    assert text_links.links(spark.createDataFrame([], DOCS)).count() == 0
    kept = text_links.deduplicated(frame(spark, rows))
    assert kept.columns == frame(spark, rows).columns
    gone = {r.doc_id for r in got if r.doc_id is not None and not r.kept}
    assert Counter(r.doc_id for r in kept.collect()) == Counter(r[0] for r in rows if r[0] not in gone)


def test_one_row_of_each_component_stays(spark):
    """Whatever ids rows share: of each component one row, that of the smallest id."""
    near = prose(1, 400).replace(" ", "  ", 3)
    rows = odd_rows() + [(20, prose(1, 400), "en", "a", 1), (20, prose(20, 300), "en", "a", 1), (21, prose(21, 300), "en", "a", 1),
                         (21, prose(21, 300), "en", "a", 1), (22, prose(22, 300), "en", "a", 1), (22, prose(22, 300), "en", "b", 2),
                         (None, near, "en", "a", 1), (None, prose(23, 300), "en", "a", 1), (None, prose(23, 300), "en", "b", 1), (6, None, "fr", "b", 0)]
    sets = [shingle_set(r[1]) for r in rows]
    group = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                group = [group[b] if g == group[a] else g for g in group]
    want = Counter(min((r[0] is None, r[0] or 0) for k, r in enumerate(rows) if group[k] == g) for g in set(group))
    got = text_links.deduplicated(frame(spark, rows).repartition(3)).collect()
    assert Counter((r.doc_id is None, r.doc_id or 0) for r in got) == want
    whole = {(r[:5]): group[k] for k, r in enumerate(rows) if sets[k]}
    assert len({whole[tuple(r)[:5]] for r in got if shingle_set(r.text)}) == sum(1 for r in got if shingle_set(r.text))


def test_sketch_estimates_similarity():
    r = np.random.default_rng(0)
    for n in (3, 20, 300, 5000):
        pool = np.unique(r.integers(0, 1 << 63, 2 * n, np.uint64) * np.uint64(2))
        a, b = pool[: int(1.5 * n)], pool[int(0.5 * n):]
        a, b = np.sort(r.permutation(a)), np.sort(b)
        true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        got = text_links.estimate((text_links.sketch(a) == text_links.sketch(b)).sum())
        assert abs(got - true) < 0.15
    assert (text_links.sketch(np.zeros(1, np.uint64)) == text_links.sketch(np.zeros(1, np.uint64))).all()


@settings(max_examples=200, deadline=None, derandomize=True)
@given(st.text(st.sampled_from("ab"), min_size=1, max_size=80) | st.binary(min_size=1, max_size=60).map(lambda b: b.decode("latin-1")), st.integers(1, 12))
def test_groups_of_equal_strings(text, length):
    data = np.frombuffer(text.encode("latin-1"), np.uint8)
    order, group = bwt.equal_groups(data, length)
    around = data.tobytes() * (length // len(data) + 2)
    strings = [around[k:k + length] for k in order.tolist()]
    seen = {}
    assert sorted(order.tolist()) == list(range(len(data)))
    assert [seen.setdefault(s, len(seen)) for s in strings] == group.tolist()


def brute_repeats(rows, length=100):
    """Rows of one id and text are one document; null ids come last."""
    docs = {}
    for r in rows:
        docs[(r[0] is None, r[0] or 0, r[1] or "")] = (r[1] or "").encode()
    seen, out = set(), {}
    for k in sorted(docs):
        b = docs[k]
        cover = np.zeros(len(b) + 1, int)
        for s in range(len(b) - length + 1):
            if b[s:s + length] in seen:
                cover[s] += 1
                cover[s + length] -= 1
            seen.add(b[s:s + length])
        gone = np.cumsum(cover)[:-1] > 0
        runs = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out[k] = (len(b), int(gone.sum()), runs, hashlib.sha256(np.frombuffer(b, np.uint8)[~gone].tobytes()).hexdigest())
    return Counter((r[0], *out[(r[0] is None, r[0] or 0, r[1] or "")]) for r in rows)


def passages():
    shared, other = prose(50, 40), prose(51, 200)
    texts = [prose(k, 80) for k in range(12)] + [f"{prose(k, 30)} {shared} {prose(k + 500, 30)}" for k in range(20, 45)]
    texts += [f"{other[:300]} {prose(60, 20)} {other[200:]}", f"{other[100:900]} é{other[50:420]}", "abc" * 200, "x" * 350, "xyz" + "x" * 99, "x" * 100]
    texts += [other[k:k + 120] for k in range(0, 300, 37)] + ["", None, "short", texts[3], texts[3] + "!", "日本語テキスト" * 40, "日本語テキスト" * 30]
    return [(k, t, "en", "s", 0) for k, t in enumerate(texts)]


@pytest.mark.parametrize("most,chunk", [(20_000, 4 << 20), (3, 2000)])
def test_repeated_passages(spark, most, chunk):
    rows = passages()
    got = repeats.removals(spark.createDataFrame(rows[::-1], DOCS).repartition(4), most=most, chunk=chunk).collect()
    assert Counter(map(tuple, got)) == brute_repeats(rows)


def test_a_passage_many_share_fits_in_no_unit(spark, monkeypatch):
    """At the edges of a shared passage an anchor has a kind per document; what
    meets in one task stays bounded, and equal strings are found all the same."""
    shared = prose(70, 60)
    rows = [(k, f"{prose(k + 100, 20)} {shared} {prose(k + 900, 20)}", "en", "s", 0) for k in range(80)]
    rows += [rows[3], (None, rows[5][1][40:], "en", "s", 0)]
    sizes, real = [], repeats._contexts

    def seen(*args):
        out = real(*args).checkpoint()
        sizes.extend(r.n for r in out.groupBy("_unit").agg(F.sum(F.octet_length("_bytes")).alias("n")).collect())
        return out

    monkeypatch.setattr(repeats, "_contexts", seen)
    got = repeats.removals(spark.createDataFrame(rows[::-1], DOCS).repartition(5), most=5).collect()
    assert Counter(map(tuple, got)) == brute_repeats(rows)
    assert sizes and max(sizes) <= 5 * (repeats.CHOICES + 99)


def test_repeated_passages_across_blocks(spark, monkeypatch):
    monkeypatch.setattr(repeats, "BLOCK", 1 << 11)
    rows = [(1, prose(1, 1500), "en", "s", 0), (2, prose(1, 1500)[700:9000], "en", "s", 0), (3, "ab" * 3000, "en", "s", 0)]
    keyed = [(r[0], r[1].encode()) for r in rows]
    seen, want = set(), Counter()
    for _, b in keyed:
        for _, _, parts in repeats._blocks([b], 100):
            assert sum(map(len, parts)) <= 1 << 11
        at = [o + s for _, offs, parts in repeats._blocks([b], 100) for o, p in zip(offs, parts) for s in range(len(p) - 99)]
        assert at == list(range(len(b) - 99))
    del seen, want


def test_repeats_of_odd_rows(spark):
    rows = [r for r in odd_rows() if r[1] is None or len(r[1]) < 20_000] + [(20, prose(1, 400)[300:900], "en", "a", 0)]
    got = repeats.removals(frame(spark, rows)).collect()
    null_texts = [r for r in rows if r[0] is None]
    assert len(null_texts) == 2
    assert Counter(map(tuple, got)) == brute_repeats(rows)
    assert repeats.removals(spark.createDataFrame([], DOCS)).count() == 0


def test_texts_without_repeats(spark):
    rows = passages()
    left = repeats.without_repeats(frame(spark, rows))
    assert left.columns == frame(spark, rows).columns
    want = {}
    for r in rows:
        want[r[0]] = r[1]
    sha = {d: h for d, _, n, _, h in brute_repeats(rows) if n}
    got = {r.doc_id: r.text for r in left.collect()}
    for k, t in want.items():
        if k in sha and k in got and t.isascii():
            assert hashlib.sha256(got[k].encode()).hexdigest() == sha[k]
        elif k not in sha:
            assert got[k] == t
    assert set(want) - set(got) == {d for d, n, gone, _, _ in brute_repeats(rows) if n and n == gone}


@pytest.mark.parametrize("outsiders", [1, 5])
def test_rows_sent_grow_with_the_group(spark, outsiders):
    """A group of copies and a few outsiders in all its buckets."""
    sent = {}
    for n in (1500, 3000, 6000):
        rooted = spark.range(n + outsiders).selectExpr("xxhash64(id) AS _cls", f"if(id < {n}, 0, xxhash64(id)) AS root").withColumn("bucket", F.explode(F.array(*map(F.lit, range(6)))))
        routed = text_links._routed(text_links._contested(rooted), text_links.BLOCK)
        sent[n] = routed.count()
        assert routed.where("NOT _out").count() == n  # each once, whatever buckets it shares
    assert sent[3000] <= 2.1 * sent[1500] and sent[6000] <= 2.1 * sent[3000]


def test_blocks_of_outsiders_find_all_links(spark, monkeypatch):
    monkeypatch.setattr(text_links, "BLOCK", 3)
    words = prose(7, 60).split()
    rows = []
    for k in range(40):  # texts at many distances from each other
        own = list(words)
        for x in range(k % 10):
            own[(7 * x + k) % 60] = f"w{k}x{x}"
        rows.append((k, " ".join(own), "en", "a", 1))
    got = {r.doc_id: r.component_id for r in text_links.links(spark.createDataFrame(rows, DOCS)).collect()}
    sets = [set(text_links.shingles(r[1].encode()).tolist()) for r in rows]
    edges = [(a, b) for a in range(40) for b in range(a) if 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    assert [got[k] for k in range(40)] == smallest(40, edges, list(range(40)))


def test_repeats_in_texts_longer_than_a_block(spark):
    """Passages that begin in one block and end in the next, in both texts."""
    long = prose(80, 95_000)
    assert len(long) > repeats.BLOCK + 50_000
    at = repeats.BLOCK
    other = prose(81, 60_000) + long[at - 700:at + 300] + prose(82, 40_000) + long[2_000:2_099] + "!" + long[5_000:5_100]
    rows = [(1, long, "en", "s", 0), (2, other, "en", "s", 0), (3, long[at - 40:at + 59], "en", "s", 0)]
    got = repeats.removals(spark.createDataFrame(rows, DOCS)).collect()
    assert Counter(map(tuple, got)) == brute_repeats(rows)
    assert {r.doc_id: r.n_removed for r in got}[3] == 0


def test_shuffle_files_go_with_the_step_that_wrote_them(spark):
    """Rows behind a checkpoint leave no shuffle files, though their DataFrame is still there."""
    disk = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def written() -> set[str]:
        files = disk.getAllFiles().iterator()
        names = set()
        while files.hasNext():
            names.add(files.next().getName())
        return {n for n in names if n.startswith("shuffle_")}

    there = written()
    sums = spark.range(1000).groupBy((F.col("id") % 100).alias("k")).agg(F.sum("id").alias("v"))
    kept = cut_lineage(sums)
    until = time.time() + 20
    while written() - there and time.time() < until:
        time.sleep(0.2)
    assert not written() - there
    assert sorted(kept.collect()) == sorted(sums.collect()) == sorted(sums.collect()) and sums.join(kept, "k").count() == 100
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"


def test_small_tables_have_few_files_whatever_the_shuffle(spark, monkeypatch):
    made = []
    real = type(spark.range(1)).checkpoint

    def checkpoint(df, *a, **k):
        made.append(real(df, *a, **k))
        return made[-1]

    docs = spark.createDataFrame([(k, prose(k // 3, 60) + " x" * (k % 3), "en", "a", 1) for k in range(60)], DOCS).coalesce(1)
    want = sorted(text_links.links(docs).collect())
    kept = sorted(repeats.without_repeats(docs).collect())
    monkeypatch.setattr(type(docs), "checkpoint", checkpoint)
    was = {c: spark.conf.get(c) for c in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "24")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        assert sorted(text_links.links(docs).collect()) == want
        # all but the pairs found block by block, whose number isn't known before
        assert sum(d.rdd.getNumPartitions() > 1 for d in made) <= 2 and len(made) > 10
        made.clear()
        again = repeats.without_repeats(docs)
        assert again.rdd.getNumPartitions() <= 2
        assert sorted(again.collect()) == kept
        assert [d.rdd.getNumPartitions() for d in made] == [1] * len(made) and made
    finally:
        for c, v in was.items():
            spark.conf.set(c, v)
