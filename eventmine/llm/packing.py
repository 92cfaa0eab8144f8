"""Packing documents into sequences by exact-complement hashing.

1. Each text becomes token ids plus an end id and is cut, only if longer than
   a sequence, into pieces of the sequence length.
2. Pieces are counted by length. A sequence is filled from the longest length
   left. Sums of one, two and three available lengths are looked up for the
   exact gap; where none fits, the longest length that does (best fit) goes in
   and the smaller gap is looked up again. What results is a pattern, used as
   often as its lengths are available. All of this works on the counts (at
   most one per length up to the sequence length, whatever the corpus), so it
   runs on the driver, and each step uses up a length.
3. Every piece has a rank among those of its length: its position within its
   task plus the counts of the tasks before. Rank ranges map to sequences and
   offsets through the list of patterns, which all tasks have. No group of
   equal lengths is ever gathered.

Cases: a null or empty text is the end id alone; each row is packed by itself,
so repeated rows or ids and null ids are placed separately; extra columns are
ignored; an empty table gives no rows. Equal lengths are told apart by the
order in the table's files.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.sizing import bounded_broadcast
from .common import bounded_batches, cut_lineage, utf8
from .tokenizing import batched, piece_tokenizer


def encode_pieces(docs: DataFrame, tokenizer: str, seq_len: int = 4096, end_id: int = 1, key: str = "doc_id",
                  text: str = "text", with_ids: bool = False) -> DataFrame:
    """Per piece: the key, ``piece``, ``start``, ``length``, ``ids_crc32``,
    where its task met it (``part``, ``nth`` of that length) and, if
    ``with_ids``, the ids as little-endian unsigned 32-bit numbers."""
    bounded_batches(docs.sparkSession)
    given = docs.select(key, utf8(text).alias("_text"))
    names = [key, "piece", "start", "length", "ids_crc32", "part", "nth", *["ids"] * with_ids]
    schema = T.StructType([given.schema[key]] + [T.StructField(n, t()) for n, t in zip(names[1:], (
        T.IntegerType, T.LongType, T.LongType, T.LongType, T.IntegerType, T.LongType, T.BinaryType))])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok, part, met = piece_tokenizer(tokenizer), TaskContext.get().partitionId(), Counter()
        last = np.array([end_id], np.uint32)
        for b in batches:
            rows = []
            of = []
            for k, (_, ids) in enumerate(batched(b.column(1).to_pylist(), tok, True)):
                ids = np.concatenate([ids, last]).astype("<u4", copy=False)
                for piece, start in enumerate(range(0, len(ids), seq_len)):
                    raw = ids[start:start + seq_len].tobytes()
                    n = len(raw) // 4
                    of.append(k)
                    rows.append((piece, start, n, zlib.crc32(raw), part, met[n], *[raw] * with_ids))
                    met[n] += 1
            columns = [pa.array(c, f.type) for c, f in zip(zip(*rows), pa_fields)]
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(of, pa.int64())), *columns], names=names)

    pa_fields = [pa.field(n, t) for n, t in zip(names[1:], (
        pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary()))]
    return given.mapInArrow(lambda batches: work(b for b in batches if b.num_rows), schema)


def exact_complement(rest: np.ndarray, gap: int) -> list[int] | None:
    """One, two or three available lengths that sum to ``gap``, the longest first.
    ``rest``: how many of each length are left, by length."""
    if rest[gap]:
        return [gap]
    have = rest > 0
    lengths = np.flatnonzero(have[:gap])[::-1]
    other = gap - lengths
    pairs = lengths[(lengths >= other) & have[other]]
    for a in pairs.tolist():
        if 2 * a != gap or rest[a] > 1:
            return [a, gap - a]
    for a in lengths.tolist():
        if 3 * a < gap:
            return None
        left = gap - a
        b = lengths[(lengths <= a) & (lengths < left)]
        c = left - b
        fits = (b >= c) & have[c]
        for x in b[fits].tolist():
            three = [a, x, left - x]
            if all(rest[k] >= n for k, n in Counter(three).items()):
                return three
    return None


def plan_patterns(counts: dict[int, int], seq_len: int) -> list[tuple[list[int], int]]:
    """Patterns (lengths of a sequence) and how many sequences have each."""
    left = np.zeros(seq_len + 1, np.int64)
    for length, n in counts.items():
        left[length] = n
    patterns: list[tuple[list[int], int]] = []
    while left.any():
        longest = int(np.flatnonzero(left)[-1])
        pattern, gap, rest = [longest], seq_len - longest, left.copy()
        rest[longest] -= 1
        while gap:
            fill = exact_complement(rest, gap)
            if fill is None:
                fitting = np.flatnonzero(rest[:gap + 1])
                if not fitting.size:
                    break
                fill = [int(fitting[-1])]
            for x in fill:
                rest[x] -= 1
                gap -= x
            pattern += fill
        times = min(int(left[x]) // n for x, n in Counter(pattern).items())
        for x in pattern:
            left[x] -= times
        patterns.append((pattern, times))
    return patterns


def rank_ranges(patterns: list[tuple[list[int], int]]) -> dict[str, np.ndarray]:
    """For each length, which ranks go where: from ``rank`` on, ranks count up
    with the sequences from ``sequence`` on, at ``offset``."""
    used: Counter = Counter()
    rows, sequence = [], 0
    for pattern, times in patterns:
        offset = 0
        for length in pattern:
            rows.append((length, used[length], sequence, offset))
            used[length] += times
            offset += length
        sequence += times
    columns = np.array(sorted(rows), np.int64).reshape(-1, 4).T
    return dict(zip(("length", "rank", "sequence", "offset"), columns))


def pack(pieces: DataFrame, seq_len: int = 4096) -> DataFrame:
    """Places for the rows of :func:`encode_pieces`: ``sequence_id`` and
    ``offset`` instead of ``part`` and ``nth``."""
    pieces = cut_lineage(pieces)
    by_task = pieces.groupBy("length", "part").agg(F.count(F.lit(1)).alias("n"))
    counts = {r["length"]: r["n"] for r in by_task.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    ranges = rank_ranges(plan_patterns(counts, seq_len))
    first, sequence, offset = (ranges[c] for c in ("rank", "sequence", "offset"))
    length_at = np.searchsorted(ranges["length"], np.arange(seq_len + 2))
    keep = [c for c in pieces.columns if c not in ("part", "nth")]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            length, rank = (b.column(c).to_numpy() for c in ("length", "_rank"))
            at = np.empty(len(length), np.int64)
            for n in np.unique(length).tolist():
                own = length == n
                at[own] = length_at[n] + np.searchsorted(first[length_at[n]:length_at[n + 1]], rank[own], "right") - 1
            yield pa.RecordBatch.from_arrays(
                [*(b.column(c) for c in keep), pa.array(sequence[at] + rank - first[at]), pa.array(offset[at])],
                names=[*keep, "sequence_id", "offset"])

    before = F.coalesce(F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # the counts are broadcast if few enough, so that pieces needn't move and stay in as few files as the input
    ranked = pieces.join(bounded_broadcast(by_task.select("length", "part", before.alias("_before"))), ["length", "part"]).select(
        *keep, (F.col("_before") + F.col("nth")).alias("_rank"))
    schema = T.StructType([pieces.schema[c] for c in keep] + [T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])
    return ranked.mapInArrow(work, schema)
