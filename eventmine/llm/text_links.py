"""Near-duplicate texts by HyperMinHash.

A document's set holds the hashes of its distinct five-word shingles. Its
sketch has 256 registers: a hash's first bits pick the register, the rest is
kept as the number of leading zeros and the ten bits behind them, of the
smallest hash. Empty registers borrow that of the first filled one in an order
of their own, so short texts have whole sketches as well. Runs of five
registers, 40 of them, are band buckets.

1. Equal sets are one class; links are searched between classes.
2. In each bucket of the first bands, every class is compared with one centre
   (a random one for each bucket). Large groups of copies are thus joined by
   a number of comparisons in proportion to their size.
3. Where a bucket still holds several components, its outsiders (all but the
   classes of the largest one) are compared with the classes they share a
   bucket with, inside tasks, in blocks of ``BLOCK`` classes, on the lower 32
   bits of the shingles' hashes (with room for two that share them). The
   largest component's classes don't meet each other again, so rows moved grow
   with a hot group times the blocks of its outsiders. Pairs aren't written:
   each block pair gives the links that join its components, at most one per
   class. If one of these fails on the full sets, the round is repeated, so no
   candidate of the bands goes unseen.
4. A pair's similarity is estimated from equal registers, corrected for
   accidental collisions; unless it is clearly below the threshold, the pair
   is confirmed on its full sets. Nothing is linked without that.

Two sets at similarity 0.75 miss all bands with a chance of 2e-5, at 0.8 of
1e-7. A link that wouldn't change the components needn't be compared.

Cases: null texts and texts without words have an empty set and link with
nothing; texts of fewer than five words have their whole sequence as the one
shingle; rows without an id link through equal or similar texts like others,
but have no component number of their own; repeated rows are copies of each
other; extra columns are ignored; an empty table gives no rows. Shingles, sets
and buckets are told apart by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.sizing import bounded_broadcast
from .common import bounded_batches, cut_lineage, hold_nothing, row_hash, utf8, whole_groups
from .components import components
from .hashes import mixed

N = 5
BITS = 8
REGISTERS = 1 << BITS
MANTISSA = 10
ROWS, BANDS, FIRST = 5, 40, 8
#: classes of a component, and outsiders, compared in one task
BLOCK = 1024
#: a row with a class's registers
_CLASS_BYTES = 64 + 2 * REGISTERS
#: chance that registers of different minima agree: equal zeros (sum of 4**-k) and equal mantissas
COLLISION = 1 / 3 / (1 << MANTISSA)


def shingles(text: bytes) -> np.ndarray:
    """Sorted distinct hashes of the runs of five lower-cased words."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    n = min(N, len(h))
    run = np.zeros(len(h) - n + 1, np.uint64)
    for k in range(n):
        run = mixed(run + h[k:len(h) - n + 1 + k])
    return np.unique(run ^ mixed(np.full(1, n, np.uint64)))


@lru_cache(maxsize=1)
def _orders() -> np.ndarray:
    """For each register, all registers in an order of its own."""
    r = np.random.default_rng(5)
    return np.stack([r.permutation(REGISTERS) for _ in range(REGISTERS)])


def sketch(hashes: np.ndarray) -> np.ndarray:
    """Registers (unsigned 16 bits: zeros, then mantissa) of a sorted set, not empty."""
    register = (hashes >> np.uint64(64 - BITS)).astype(np.int64)
    filled = np.zeros(REGISTERS, bool)
    filled[register] = True
    first = np.searchsorted(register, np.flatnonzero(filled))
    rest = hashes[first] << np.uint64(BITS)
    # leading zeros from the exponent; the mantissa follows the leading one
    top = (rest >> np.uint64(11)).astype(np.float64)
    zeros = np.where(top > 0, 53 - np.frexp(top)[1], 53).astype(np.uint64)
    behind = (rest << np.minimum(zeros + np.uint64(1), np.uint64(63))) >> np.uint64(64 - MANTISSA)
    out = np.zeros(REGISTERS, "<u2")
    out[filled] = (zeros << np.uint64(MANTISSA)) | behind
    if len(first) < REGISTERS:
        empty = np.flatnonzero(~filled)
        order = _orders()[empty]
        out[empty] = out[order[np.arange(len(empty)), filled[order].argmax(axis=1)]]
    return out


def estimate(equal: np.ndarray) -> np.ndarray:
    """Similarity from the number of equal registers, without accidental ones."""
    return np.maximum(0.0, (equal / REGISTERS - COLLISION) / (1 - COLLISION))


def _set_hash(hashes: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(hashes.tobytes()) - (1 << 63)


def _sketches(docs: DataFrame, key: str, text: str, row: Column | None = None) -> DataFrame:
    given = docs.select(F.col(key).alias("_id"), utf8(text).alias("_text"), (F.lit(0).cast("bigint") if row is None else row).alias("_row"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hold_nothing()
        for b in batches:
            sets = [shingles(t) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(2), pa.array(map(len, sets), pa.int64()), pa.array([_set_hash(s) if len(s) else None for s in sets], pa.int64()),
                 pa.array([sketch(s).tobytes() if len(s) else None for s in sets], pa.binary())], names=["_id", "_row", "_n", "_cls", "_regs"])

    return given.mapInArrow(work, f"_id {given.schema['_id'].dataType.simpleString()}, _row bigint, _n bigint, _cls bigint, _regs binary")


def _sets(docs: DataFrame, key: str, text: str, wanted: DataFrame) -> DataFrame:
    """The full set of each class in ``wanted`` (``_cls``, ``_low``: an id that has it)."""
    # a broadcast if the numbers are few enough, so that other texts needn't move
    ids = bounded_broadcast(wanted.select(F.col("_low").alias("_id"), F.col("_cls").alias("_want")), 1_000_000)
    given = docs.select(F.col(key).alias("_id"), utf8(text).alias("_text"))
    given = given.join(ids, given["_id"].eqNullSafe(ids["_id"])).select("_want", "_text")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            want, sets = [], []
            for w, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                s = shingles(t)
                if len(s) and _set_hash(s) == w:  # an id may stand for several texts
                    want.append(w)
                    sets.append(s.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(want, pa.int64()), pa.array(sets, pa.binary())], names=["_cls", "_set"])

    return given.mapInArrow(work, "_cls bigint, _set binary").dropDuplicates(["_cls"])


def _confirmed(pairs: DataFrame, classes: DataFrame, sets: DataFrame, percent: int, margin: float, n_bytes: int) -> DataFrame:
    """Those of the pairs (``a``, ``b``) that are linked. ``n_bytes``: of all
    sets and those of all pairs, about."""
    def of(c: str, table: DataFrame, *columns: str) -> DataFrame:
        return table.select(F.col("_cls").alias(c), *[F.col(x).alias(f"{x}{c}") for x in columns])

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, y = (np.frombuffer(b"".join(b.column(c).to_pylist()), "<u2").reshape(-1, REGISTERS) for c in (2, 3))
            yield b.select([0, 1]).filter(pa.array(estimate((x == y).sum(axis=1)) >= percent / 100 - margin))

    def same(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            linked = []
            for x, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist()):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = len(x) + len(y) - len(np.unique(np.concatenate([x, y])))
                linked.append(100 * both >= percent * (len(x) + len(y) - both))
            yield b.select([0, 1]).filter(pa.array(linked, pa.bool_()))

    pairs = pairs.distinct().join(of("a", classes, "_n", "_regs"), "a").join(of("b", classes, "_n", "_regs"), "b")
    fits = 100 * F.least("_na", "_nb") >= percent * F.greatest("_na", "_nb")
    pairs = pairs.where(fits).select("a", "b", "_regsa", "_regsb").mapInArrow(near, "a bigint, b bigint")
    pairs = pairs.join(of("a", sets, "_set"), "a").join(of("b", sets, "_set"), "b").select("a", "b", "_seta", "_setb")
    return cut_lineage(pairs.mapInArrow(same, "a bigint, b bigint"), n_bytes, 1)


def _contested(rooted: DataFrame) -> DataFrame:
    """Rows (``_zone``, ``bucket``, ``_cls``, ``root``, ``_out``) of the buckets
    that hold several components. A bucket's zone is the component it has most
    classes of; the others are outsiders there."""
    per = rooted.groupBy("bucket", "root").agg(F.count(F.lit(1)).alias("_n"))
    zones = per.groupBy("bucket").agg(F.max(F.struct("_n", "root"))["root"].alias("_zone"), F.count(F.lit(1)).alias("_roots"))
    return rooted.join(zones.where("_roots > 1").drop("_roots"), "bucket").withColumn("_out", F.col("root") != F.col("_zone"))


def _routed(contested: DataFrame, block: int, most: int | None = None) -> DataFrame:
    """Which classes meet in which tasks (``_zone``, ``_i``, ``_j``): a zone's
    own classes and its outsiders are cut into blocks; a block of own classes
    meets the blocks of outsiders that it shares a bucket with, and so do
    blocks of outsiders among themselves (``_i`` below zero). Own classes
    never meet each other, so a class moves once per block of outsiders.
    ``most``: number of rows or more, if known."""
    sizes = contested.groupBy("_zone", "_out").agg(F.ceil(F.approx_count_distinct("_cls") / block).cast("int").alias("_blocks"))
    large = bounded_broadcast(cut_lineage(sizes.where("_blocks > 1"), most))  # a row stands for many classes
    cut = contested.join(large, ["_zone", "_out"], "left").withColumn(
        "_block", F.pmod(F.xxhash64("_cls"), F.coalesce("_blocks", F.lit(1))).cast("int"))
    met = cut.groupBy("_zone", "bucket").agg(F.collect_set(F.when(~F.col("_out"), F.col("_block"))).alias("_own"),
                                             F.collect_set(F.when(F.col("_out"), F.col("_block"))).alias("_others"))
    own = F.transform("_others", lambda j: F.struct(F.col("_block").alias("_i"), j.alias("_j")))
    out = F.concat(F.transform("_own", lambda i: F.struct(i.alias("_i"), F.col("_block").alias("_j"))),
                   F.transform("_others", lambda j: F.struct((-1 - F.least("_block", j)).alias("_i"), F.greatest("_block", j).alias("_j"))))
    routes = cut.join(met, ["_zone", "bucket"]).select("_zone", "_cls", "root", "_out", "_block", "bucket", F.inline(F.when(F.col("_out"), out).otherwise(own)))
    # a class has at most BANDS buckets
    return routes.groupBy("_zone", "_i", "_j", "_cls", "root", "_out", "_block").agg(F.collect_list("bucket").alias("_buckets"))


def _joining(rooted: DataFrame, candidates: DataFrame, sets: DataFrame, percent: int, margin: float, most: int | None = None) -> DataFrame:
    """Pairs (``a``, ``b``) that would join different components within a
    bucket, compared block by block."""
    lower = sets.mapInArrow(_lower_bits, "_cls bigint, _low binary")
    rows = (_routed(_contested(rooted), BLOCK, most).join(lower, "_cls").join(candidates.select("_cls", "_regs", "_n"), "_cls").repartition("_zone", "_i", "_j")
            .sortWithinPartitions("_zone", "_i", "_j").select("_zone", "_i", "_j", "_block", "_out", "_buckets", "_cls", "root", "_regs", "_low", "_n"))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in whole_groups(batches, 3):
            keys = np.stack([rows.column(c).to_numpy() for c in range(3)])
            cut = np.concatenate([[0], np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1, [rows.num_rows]])
            out = []
            for s, e in zip(cut[:-1].tolist(), cut[1:].tolist()):
                if e - s > 1:
                    out += _block_joins(rows.slice(s, e - s), percent, margin)
            if out:
                a, b = np.array(out, np.int64).T
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])

    return rows.mapInArrow(compare, "a bigint, b bigint")


def _lower_bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        low = [np.unique(np.frombuffer(x, np.uint64).astype(np.uint32)).tobytes() for x in b.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(low, pa.binary())], names=["_cls", "_low"])


def _block_joins(rows: pa.Table, percent: int, margin: float) -> list[tuple[int, int]]:
    """Links between different components in one pair of blocks, of classes
    that share a bucket; what a link has joined isn't compared again."""
    i, j = rows.column(1)[0].as_py(), rows.column(2)[0].as_py()
    block, out = rows.column(3).to_numpy(), rows.column(4).to_numpy(zero_copy_only=False)
    buckets = rows.column(5).to_pylist()
    cls, root = rows.column(6).to_numpy(), rows.column(7).to_numpy()
    regs = np.frombuffer(b"".join(rows.column(8).to_pylist()), "<u2").reshape(-1, REGISTERS)
    low = [np.frombuffer(x, np.uint32) for x in rows.column(9).to_pylist()]
    n = rows.column(10).to_numpy()
    shared = n - np.array([len(x) for x in low])  # hashes whose lower bits another of the set has
    label = np.unique(root, return_inverse=True)[1]
    # outsiders of one block are held against the others: own classes, or outsiders of a block that isn't before theirs
    mine = out & (block == (j if i >= 0 else -1 - i))
    theirs = ~out if i >= 0 else block == j
    at: dict[int, list[int]] = {}
    for y in np.flatnonzero(theirs).tolist():
        for bucket in buckets[y]:
            at.setdefault(bucket, []).append(y)
    found = []
    for x in np.flatnonzero(mine).tolist():
        others = np.unique(np.concatenate([np.array(at.get(bucket, ()), np.int64) for bucket in buckets[x]]))
        fits = (label[others] != label[x]) & (100 * np.minimum(n[others], n[x]) >= percent * np.maximum(n[others], n[x]))
        if i < 0 and -1 - i == j:
            fits &= others > x
        others = others[fits]
        likely = estimate((regs[others] == regs[x]).sum(axis=1))
        order = np.argsort(-likely, kind="stable")
        for y in others[order[likely[order] >= percent / 100 - margin]].tolist():
            if label[x] != label[y]:
                union = len(np.union1d(low[x], low[y]))
                both = len(low[x]) + len(low[y]) - union
                # at least the full sets' intersection, over at most their union
                if 100 * (both + shared[x]) >= percent * union:
                    found.append((int(cls[x]), int(cls[y])))
                    label[label == label[y]] = label[x]
    return found


def links(docs: DataFrame, key: str = "doc_id", text: str = "text", percent: int = 75, margin: float = 0.13) -> DataFrame:
    """Per row: the key, ``n_shingles``, ``component_id`` (smallest key
    reachable by links of at least ``percent``, its own included) and ``kept``
    (whether that is its own key)."""
    rows, known = _rooted(docs, key, text, percent, margin)
    known = known.join(known.groupBy("root").agg(F.min("_low").alias("_component")), "root").select("_cls", "_component")
    component = F.coalesce("_component", "_id")
    return rows.select("_id", "_n", "_cls").join(known, "_cls", "left").select(
        F.col("_id").alias(key), F.col("_n").alias("n_shingles"), component.alias("component_id"),
        F.coalesce(component == F.col("_id"), F.lit(False)).alias("kept"))


def _rooted(docs: DataFrame, key: str, text: str, percent: int = 75, margin: float = 0.13, row: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """Rows (``_id``, ``_row``, ``_n``, ``_cls``: null without words, ``_regs``)
    and classes (``_cls``, ``_low``, ``root``)."""
    bounded_batches(docs.sparkSession)
    rows = cut_lineage(_sketches(docs, key, text, row))
    n_rows = rows.count()  # no table of classes has more, whatever number of files a shuffle would give it
    classes = cut_lineage(rows.where(F.col("_cls").isNotNull()).groupBy("_cls").agg(
        F.min("_id").alias("_low"), F.first("_n").alias("_n"), F.first("_regs").alias("_regs")), n_rows, _CLASS_BYTES)
    bands = F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda i: F.struct(
        i.alias("band"), F.xxhash64(i, F.substring("_regs", i * (2 * ROWS) + 1, 2 * ROWS)).alias("bucket")))
    members = classes.select("_cls", F.inline(bands)).select("_cls", "bucket", (F.col("band") < FIRST).alias("_first"))
    shared = members.groupBy("bucket").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("bucket")
    members = cut_lineage(members.join(shared, "bucket"), BANDS * n_rows, 32)
    n_members = members.count()
    wanted = members.select("_cls").distinct()
    candidates = cut_lineage(classes.join(wanted, "_cls"), n_rows, _CLASS_BYTES)
    of_sets = candidates.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("_n"), F.lit(0)).alias("hashes")).first()
    set_bytes = 64 + 8 * of_sets["hashes"] // max(1, of_sets["n"])
    sets = cut_lineage(_sets(docs, key, text, candidates), of_sets["n"], set_bytes)

    # one class of each bucket, by an order of the bucket's own
    own = members.where("_first")
    centres = own.groupBy("bucket").agg(F.min(F.struct(F.xxhash64("_cls", "bucket"), "_cls")).alias("_m")).select("bucket", F.col("_m._cls").alias("_c"))
    pairs = own.join(centres, "bucket").where("_cls != _c").select(F.least("_cls", "_c").alias("a"), F.greatest("_cls", "_c").alias("b"))
    n_found = own.count()
    found = _confirmed(pairs, candidates, sets, percent, margin, (of_sets["n"] + 2 * n_found) * set_bytes)

    def with_roots(found: DataFrame) -> tuple[DataFrame, DataFrame]:
        roots = components(found, n_found).select(F.col("node").alias("_cls"), "root")
        return roots, cut_lineage(members.select("_cls", "bucket").join(roots, "_cls", "left").withColumn("root", F.coalesce("root", "_cls")), n_members)

    while True:
        roots, rooted = with_roots(found)
        named = cut_lineage(_joining(rooted, candidates, sets, percent, margin, n_members).distinct())
        n_named = named.count()
        new = _confirmed(named, candidates, sets, percent, 1.0, (of_sets["n"] + 2 * n_named) * set_bytes)
        n_new = new.count()
        if n_new:
            found, n_found = found.unionAll(new), n_found + n_new
            roots, rooted = with_roots(found)
        # all pairs were compared but those that a named pair had joined already: final if all of these hold
        if n_named == n_new:
            break

    return rows, cut_lineage(classes.select("_cls", "_low").join(roots, "_cls", "left").select("_cls", "_low", F.coalesce("root", "_cls").alias("root")), n_rows)


def deduplicated(docs: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The documents with the columns they had, one row of each component: that
    of the smallest key (null last), then by a hash of the row; of equal rows,
    one. Rows decide for themselves, whatever rows share their key. Rows
    without words stay."""
    names = [f"c{k}" for k in range(len(docs.columns))]
    given = docs.toDF(*names)
    at, body = (names[docs.columns.index(c)] for c in (key, text))
    marked = given.withColumn("_row", row_hash(given))
    rows, known = _rooted(given, at, body, row=row_hash(given), **options)
    # the best row of each class, then of each component: minima, summed up before rows move
    one = F.struct(F.col("_id").isNull().alias("_no"), "_id", "_row")
    best = rows.where(F.col("_cls").isNotNull()).groupBy("_cls").agg(F.min(one).alias("_one")).join(known, "_cls")
    best = known.select("_cls", "root").join(best.groupBy("root").agg(F.min("_one").alias("_one")), "root").select("_cls", "_one")
    own = rows.select("_id", "_row", "_cls").join(best, "_cls").groupBy("_id", "_row").agg(
        F.count(F.lit(1)).alias("_rows"), F.first(F.col("_one") == one).alias("_best")).where("NOT _best OR _rows > 1")
    own = cut_lineage(own.select(F.col("_id").alias("_key"), F.col("_row").alias("_is"), "_best"), rows.count())

    def same(these: DataFrame):
        return marked["_row"].eqNullSafe(these["_is"]) & marked[at].eqNullSafe(these["_key"])

    def of(best: bool) -> DataFrame:
        return bounded_broadcast(own.where(F.col("_best") if best else ~F.col("_best")).drop("_best"), 1_000_000)

    gone, twice = of(False), of(True)
    left = marked.join(gone, same(gone), "left_anti")
    if not twice.isEmpty():
        once = marked.join(twice, same(twice), "left_semi").dropDuplicates([at, "_row"])
        left = left.join(twice, same(twice), "left_anti").unionAll(once)
    return left.select(names).toDF(*docs.columns)
