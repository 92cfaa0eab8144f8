"""Vector compression into one byte per part, with adaptive distance bounds.

Components become integers (``scale`` times, rounded down). A vector is cut
into equal parts; each part position has a codebook, which starts as that part
of the vectors of smallest keys and is refined by a few rounds of assigning
every part to its nearest entry and moving the entries to their parts' means.

Between rounds each part keeps its ``bounds`` closest entries, nearest first,
a lower bound on the distance to each (in order) and one outer bound below all
other entries. When entries have moved by known distances, the bounds shrink by
these. Then, for each part:

1. The distance to its present entry is worked out in integers.
2. Entries whose bound is above it are out. If the outer bound isn't, all
   entries are looked at; else those at the front whose bounds aren't.
3. What is uncertain is settled by integer squared distances, ties to the
   lower index, so codes are exact whatever the bounds' rounding.

How many bounds the parts of a batch needed is how many they keep (at least
``LEAST``), so the state gets smaller as entries settle. It is written as a
table in the shared checkpoint folder after each round and the one before is
deleted; sums and counts of the parts are added up in tasks and by Spark.
The codebooks (entries x components integers) are all that the driver holds.

Cases: rows are left out if the vector is null, holds null or non-finite
components or ones beyond ``MOST`` in size (their squares don't fit), or if its
length isn't that of the first row (by key, of those whose length is a positive
multiple of ``parts``). Keys decide where codebooks start, ties by the vector,
null keys last; repeated rows and keys are rows of their own; fewer rows than
entries give smaller codebooks; an empty table gives no rows; extra columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import delete_path, scratch_path
from .common import bounded_batches, cut_lineage

#: sizes of components that are kept
MOST = 2.0 ** 14
#: bounds kept at least, by a part
LEAST = 2
#: rows worked on at once
ROWS = 4096
#: what rounding may add to a distance, relative and absolute
_SLACK = 1e-9


def integers(vectors: DataFrame, key: str, vector: str, label: str, parts: int, scale: float) -> DataFrame:
    """Rows that can be coded: ``_id``, ``_label`` and ``_x`` (integers)."""
    v = F.col(vector)
    sound = F.size(v) % parts == 0
    sound = sound & (F.size(v) > 0) & F.forall(v, lambda x: F.coalesce(F.abs(x.cast("double")) <= MOST, F.lit(False)) & ~F.isnan(x))
    return vectors.where(F.coalesce(v.isNotNull() & sound, F.lit(False))).select(
        F.col(key).alias("_id"), F.col(label).alias("_label"),
        F.transform(v, lambda x: F.floor(F.lit(float(scale)) * x.cast("double")).cast("int")).alias("_x"))


def _squared(x: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Exact squared distances of all rows to all entries."""
    most = max(int(np.abs(x).max(initial=0)), int(np.abs(entries).max(initial=0)))
    if 4 * most * most * x.shape[1] < 1 << 52:  # whole numbers that doubles hold
        a, c = x.astype(np.float64), entries.astype(np.float64)
        return ((a * a).sum(axis=1)[:, None] - 2 * (a @ c.T) + (c * c).sum(axis=1)).astype(np.int64)
    return np.stack([((x - c) ** 2).sum(axis=1) for c in entries], axis=1)


def _below(distance: np.ndarray) -> np.ndarray:
    """Half-precision numbers not above the distances."""
    least = np.maximum(distance * (1 - _SLACK) - _SLACK, 0)
    h = np.minimum(least, 65504.0).astype(np.float16)
    return np.where(h > least, np.nextafter(h, np.float16(0)), h).astype(np.float16)


def nearest(x: np.ndarray, entries: np.ndarray, bounds: int) -> tuple[np.ndarray, ...]:
    """By all distances: the ``bounds`` closest entries (nearest first), lower
    bounds, the outer bound, the exact squared distance of the first."""
    k = len(entries)
    keyed = _squared(x, entries) * 256 + np.arange(k)  # by distance, then index
    b = min(bounds, k)
    front = np.partition(keyed, b, axis=1)[:, :b + 1] if b < k else keyed
    front = np.sort(front, axis=1)
    outer = _below(np.sqrt((front[:, b] >> 8).astype(np.float64))) if b < k else np.full(len(x), np.inf, np.float16)
    front = front[:, :b]
    return (front & 255).astype(np.uint8), _below(np.sqrt((front >> 8).astype(np.float64))), outer, front[:, 0] >> 8


def again(x: np.ndarray, entries: np.ndarray, moved: np.ndarray, near: np.ndarray, low: np.ndarray, outer: np.ndarray):
    """The same after the entries moved by ``moved``, from what was kept, and
    how many bounds were of use."""
    b = near.shape[1]
    low = low.astype(np.float64) - moved[near]
    outer = outer.astype(np.float64) - moved.max()
    # in order: no bound above the ones behind it
    low = np.minimum.accumulate(np.concatenate([low, outer[:, None]], axis=1)[:, ::-1], axis=1)[:, ::-1][:, :b]
    own = near[:, 0].astype(np.int64)
    best = ((x - entries[own]) ** 2).sum(axis=1) * 256 + own
    reach = np.sqrt((best >> 8).astype(np.float64)) * (1 + _SLACK) + _SLACK
    every = outer <= reach
    look = (low <= reach[:, None]) & ~every[:, None]
    look[:, 0] = False
    value = low.copy()
    value[:, 0] = np.sqrt((best >> 8).astype(np.float64))
    rows, at = np.nonzero(look)
    if len(rows):
        entry = near[rows, at].astype(np.int64)
        keyed = ((x[rows] - entries[entry]) ** 2).sum(axis=1) * 256 + entry
        value[rows, at] = np.sqrt((keyed >> 8).astype(np.float64))
        np.minimum.at(best, rows, keyed)
    used = int(look.sum(axis=1).max(initial=0)) + 1
    first = near == (best & 255)[:, None]
    order = np.argsort(np.where(first, -1.0, value), axis=1, kind="stable")
    near, value = np.take_along_axis(near, order, 1), np.take_along_axis(value, order, 1)
    low, squared = _below(value), best >> 8
    outer = _below(np.maximum(outer, 0))
    if every.any():
        near[every], low[every], outer[every], squared[every] = nearest(x[every], entries, b)
    return near, low, outer, squared, used


def _fewer(near: np.ndarray, low: np.ndarray, outer: np.ndarray, b: int):
    """Only the first ``b`` bounds; the outer one covers the others."""
    if b < near.shape[2]:
        outer = np.minimum(outer, low[:, :, b:].min(axis=2))
    return near[:, :, :b], low[:, :, :b], outer


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy().reshape(-1, width).astype(np.int64)


def _binary(rows: np.ndarray) -> pa.Array:
    return pa.array([r.tobytes() for r in rows], pa.binary())


def _assigned(rows: DataFrame, books: np.ndarray, moved: np.ndarray | None, bounds: int, final: bool) -> DataFrame:
    """Codes of the rows of :func:`integers` (``moved`` is null), or of those
    that an earlier call gave, after the entries ``moved``. ``books``: part,
    entry, component. ``final``: squared distances instead of bounds."""
    parts, _, width = books.shape

    def coded(x: np.ndarray, state) -> tuple[np.ndarray, ...]:
        out = []
        for p in range(parts):
            own = np.ascontiguousarray(x[:, p * width:(p + 1) * width])
            if state is None:
                out.append((*nearest(own, books[p], bounds), bounds))
            else:
                out.append(again(own, books[p], moved[p], *(s[:, p] for s in state)))
        near, low, outer, squared = (np.stack(c, axis=1) for c in list(zip(*out))[:4])
        return near, low, outer, squared, max(o[4] for o in out)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sizes = np.zeros(b.num_rows, np.int64) if moved is None else np.array([len(c) for c in b.column(4).to_pylist()], np.int64)
            for n in np.unique(sizes).tolist():
                of_size = b.filter(pa.array(sizes == n))
                for at in range(0, of_size.num_rows, ROWS):
                    own = of_size.slice(at, ROWS)
                    x, state = _matrix(own.column(2), parts * width), None
                    if moved is not None:
                        near, low, outer = (np.frombuffer(b"".join(own.column(c).to_pylist()), kind) for c, kind in ((4, np.uint8), (5, np.float16), (6, np.float16)))
                        state = near.reshape(len(x), parts, -1), low.reshape(len(x), parts, -1), outer.reshape(len(x), parts)
                    near, low, outer, squared, used = coded(x, state)
                    code = _binary(near[:, :, 0])
                    if final:
                        yield pa.RecordBatch.from_arrays([own.column(0), own.column(1), code, pa.array(squared.sum(axis=1))], names=["_id", "_label", "_code", "_error"])
                    else:
                        near, low, outer = _fewer(near, low, outer, max(LEAST, used))
                        yield pa.RecordBatch.from_arrays([*own.columns[:3], code, *map(_binary, (near, low, outer))], names=names)

    names = ["_id", "_label", "_x", "_code", "_near", "_low", "_outer"]
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    head = f"_id {kinds['_id']}, _label {kinds['_label']}"
    return rows.mapInArrow(work, f"{head}, _code binary, _error bigint" if final else
                           f"{head}, _x array<int>, _code binary, _near binary, _low binary, _outer binary")


def _means(state: DataFrame, books: np.ndarray) -> np.ndarray:
    """The entries moved to the means of their parts, rounded down; an entry
    without parts stays. Tasks send one row per part, entry and component."""
    parts, k, width = books.shape

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = np.zeros((parts, k, width), np.int64), np.zeros((parts, k), np.int64)
        for b in batches:
            x = _matrix(b.column(0), parts * width)
            code = np.frombuffer(b"".join(b.column(1).to_pylist()), np.uint8).reshape(-1, parts)
            for p in range(parts):
                counts[p] += np.bincount(code[:, p], minlength=k)
                for w in range(width):
                    sums[p, :, w] += np.bincount(code[:, p], x[:, p * width + w], k).astype(np.int64)
        p, e = np.nonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(c, width), pa.int32()) for c in (p, e)] + [
            pa.array(np.tile(np.arange(width), len(p)), pa.int32()), pa.array(sums[p, e].ravel()), pa.array(np.repeat(counts[p, e], width))],
            names=["p", "e", "w", "total", "n"])

    moved = books.copy()
    sums = state.select("_x", "_code").mapInArrow(work, "p int, e int, w int, total bigint, n bigint")
    for r in sums.groupBy("p", "e", "w").agg(F.sum("total").alias("total"), F.sum("n").alias("n")).collect():
        moved[r.p, r.e, r.w] = r.total // r.n
    return moved


def compress(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", parts: int = 16,
             entries: int = 64, rounds: int = 2, scale: float = 256.0, bounds: int = 8) -> tuple[DataFrame, np.ndarray]:
    """Per row that can be coded: the key, ``label``, ``code`` (a byte per
    part) and ``error`` (squared distances, summed); and the codebooks by
    part, entry and component. At most 256 entries."""
    spark = vectors.sparkSession
    bounded_batches(spark)
    rows = integers(vectors, key, vector, label, parts, scale)
    by_key = [F.col("_id").asc_nulls_last(), F.col("_x"), F.col("_label").asc_nulls_last()]
    first = rows.orderBy(*by_key).limit(1).collect()
    length = len(first[0]["_x"]) if first else parts
    rows = rows.where(F.size("_x") == length)
    start = [r["_x"] for r in rows.orderBy(*by_key).limit(entries).collect()]
    books = np.array(start, np.int64).reshape(len(start), parts, length // parts).transpose(1, 0, 2).copy()
    names = [F.col("_id").alias(key), F.col("_label").alias(label), F.col("_code").alias("code"), F.col("_error").alias("error")]
    if not start:
        return rows.select("_id", "_label", F.lit(b"").alias("_code"), F.lit(0).cast("bigint").alias("_error")).select(*names), books
    moved, at = None, None
    for _ in range(rounds):
        to = scratch_path(spark, "vector_codes")
        _assigned(rows, books, moved, bounds, False).write.parquet(to)
        if at:
            delete_path(spark, at)
        rows, at = spark.read.parquet(to), to
        new = _means(rows, books)
        moved = np.sqrt(((new - books) ** 2).sum(axis=2).astype(np.float64)) * (1 + _SLACK)
        books = new
    out = cut_lineage(_assigned(rows, books, moved, bounds, True))
    if at:
        delete_path(spark, at)
    return out.select(*names), books


def with_label_error(coded: DataFrame, label: str = "label", error: str = "error") -> DataFrame:
    """Adds ``label_error``: the errors summed over rows of one label (nulls together)."""
    from ..functions.sizing import bounded_broadcast

    per = coded.groupBy(label).agg(F.sum(error).alias("_sum")).withColumnRenamed(label, "_of")
    per = bounded_broadcast(per)
    return coded.join(per, coded[label].eqNullSafe(per["_of"])).select(*coded.columns, F.col("_sum").alias("label_error"))


def codebook_text(books: np.ndarray) -> str:
    """All integers by part, entry and component, joined by commas."""
    return ",".join(map(str, books.ravel().tolist()))


def hex_code(code: str = "code") -> Column:
    return F.lower(F.hex(F.col(code)))
