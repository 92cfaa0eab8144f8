"""Exact removal of repeated passages: threshold-bounded interval expansion.

Each byte covered by a string of ``length`` bytes that also starts earlier (in
a document of smaller id, or earlier in the same one) is removed.

A Burrows-Wheeler transform of the whole corpus fits nowhere, and needn't:
strings that are equal pick equal *anchors*, the 37-byte gram of lowest hash
among the 64 in them. So every start of a string belongs to one anchor, and
equal strings meet under the same one.

1. Documents are cut into segments, the starts of neighbouring strings with
   the same anchor. Only hashes leave the task: of the anchor and of the
   segment with its context. Equal segments within a batch are settled there.
2. Sorted by anchor and segment, equal segments are neighbours, and all but
   the first are repeats as a whole. A segment whose anchor has no other one
   is done.
3. The contexts of the others (one of each kind) are fetched, and what shares
   an anchor meets in one task, where a transform of about ``chunk`` bytes
   gives the groups of equal strings (see :mod:`.bwt`).
4. Anchors with more than ``most`` kinds of segments (at the edges of a passage
   that many documents share) would not fit in a task, and don't meet in one:
   their strings move as hashes, settled like segments (steps 1 and 2).
5. All repeats of a document are merged, and its text is cut.

Cases: a null or empty text has no bytes and loses none; rows of one id and
text are one document (each loses the same); rows that share an id but not the
text come in the order of a hash of the text, and null ids come last; texts
shorter than ``length`` lose nothing; extra columns are kept by
:func:`without_repeats` and ignored by :func:`repeats`; an empty table gives
no rows. Anchors, segments and the strings of step 4 are told apart by 64-bit
hashes. Removed bytes may leave broken characters at a cut.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.sizing import bounded_broadcast
from .bwt import equal_groups
from .common import bounded_batches, cut_lineage, files_of, hold_nothing, utf8, whole_groups
from .hashes import Spans, mixed

#: string starts that share a choice of anchor; a power of two
CHOICES = 64
#: bytes worked on at once; places in them must fit in the bits below it
BLOCK = 1 << 19
#: bytes of contexts in one transform
CHUNK = 1 << 19
#: kinds of segments of one anchor beyond which its strings move as hashes; so many contexts fit in a task
MOST = 20_000
#: stands for a null id
LAST = (1 << 63) - 1
_PLACE = np.uint64(BLOCK - 1)


def anchors(data: np.ndarray, begin: np.ndarray, end: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """Segments of the documents ``data[begin:end]``: (anchor, kind, document,
    start within it, number of string starts). ``data``: at most ``BLOCK`` bytes."""
    none = tuple(np.zeros(0, np.int64) for _ in range(5))
    if len(data) < length:
        return none
    spans = Spans(data)
    grams = spans.of_length(length - CHOICES + 1)
    low = (grams & ~_PLACE) | np.arange(len(grams), dtype=np.uint64)
    step = 1
    while step < CHOICES:
        low = np.minimum(low[:-step], low[step:])
        step *= 2
    # string starts, document by document
    counts = np.maximum(0, end - begin - length + 1)
    doc = np.repeat(np.arange(len(begin)), counts)
    at = np.arange(len(doc)) + np.repeat(begin - np.cumsum(counts) + counts, counts)
    if not len(at):
        return none
    chosen = low[at]
    new = np.flatnonzero(np.concatenate([[True], (chosen[1:] != chosen[:-1]) | (doc[1:] != doc[:-1])]))
    first = at[new]
    n = np.diff(np.append(new, len(at)))
    place = (chosen[new] & _PLACE).astype(np.int64)
    kind = mixed(spans.hashes(first, first + n + length - 1) + (place - first).astype(np.uint64))
    return grams[place].view(np.int64), kind.view(np.int64), doc[new], first - begin[doc[new]], n


def _blocks(texts: list[bytes], length: int) -> Iterator[tuple[list[int], list[int], list[bytes]]]:
    """(rows, offsets in their texts, bytes) of about ``BLOCK`` bytes; longer
    texts are cut so that each string's start is in one block."""
    rows, offsets, parts, size = [], [], [], 0
    for k, text in enumerate(texts):
        for start in range(0, max(1, len(text) - length + 1), BLOCK - length + 1):
            part = text[start:start + BLOCK] if len(text) > BLOCK else text
            if size + len(part) > BLOCK:
                yield rows, offsets, parts
                rows, offsets, parts, size = [], [], [], 0
            rows.append(k)
            offsets.append(start)
            parts.append(part)
            size += len(part)
            if len(text) <= BLOCK:
                break
    if parts:
        yield rows, offsets, parts


def _identified(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Adds ``_id`` and ``_h``, which tell documents apart and order them;
    ``_h`` is 0 where ids alone do."""
    number = F.col(key).cast("bigint")
    odd = docs.select(number.alias("_id")).groupBy("_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1 OR _id IS NULL")
    h = F.lit(0).cast("bigint") if odd.isEmpty() else F.xxhash64(utf8(text))
    return docs.withColumns({"_id": F.coalesce(number, F.lit(LAST)), "_h": h})


def _keyed(docs: DataFrame, key: str, text: str) -> DataFrame:
    return _identified(docs.select(key, text), key, text).select("_id", "_h", utf8(text).alias("_text"))


def _n_bytes(keyed: DataFrame) -> int:
    """Bytes of all texts; what is made of them needs no more files than they."""
    return keyed.agg(F.coalesce(F.sum(F.octet_length("_text").cast("bigint")), F.lit(0))).first()[0]


def _segments(keyed: DataFrame, length: int) -> DataFrame:
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hold_nothing()
        for b in batches:
            ids, h = b.column(0), b.column(1)
            for rows, offsets, parts in _blocks(b.column(2).to_pylist(), length):
                ends = np.cumsum([len(p) for p in parts])
                begins = ends - np.array([len(p) for p in parts], np.int64)
                anchor, kind, doc, start, n = anchors(np.frombuffer(b"".join(parts), np.uint8), begins, ends, length)
                of = pa.array(np.array(rows, np.int64)[doc])
                place = ((start + np.array(offsets, np.int64)[doc]) << 8) | n
                yield _first_of_kind(anchor, kind, ids.take(of).to_numpy(), h.take(of).to_numpy(), place)

    return keyed.mapInArrow(work, "_anchor bigint, _kind bigint, _id bigint, _h bigint, _place bigint")


def _first_of_kind(anchor, kind, i, h, place) -> pa.RecordBatch:
    """What a task can settle before the rows move: of equal segments, all but
    the first are repeats (anchor null), so a passage that fills a table moves
    once per batch. Rows that are there twice are one."""
    order = np.lexsort((place, h, i, kind, anchor))
    anchor, kind, i, h, place = (x[order] for x in (anchor, kind, i, h, place))
    same = np.zeros(len(order), bool)
    same[1:] = (anchor[1:] == anchor[:-1]) & (kind[1:] == kind[:-1])
    twice = np.zeros(len(order), bool)
    twice[1:] = same[1:] & (i[1:] == i[:-1]) & (h[1:] == h[:-1]) & (place[1:] == place[:-1])
    batch = pa.RecordBatch.from_arrays([pa.array(anchor, mask=same), *(pa.array(x) for x in (kind, i, h, place))],
                                       names=["_anchor", "_kind", "_id", "_h", "_place"])
    return batch.filter(pa.array(~twice)) if twice.any() else batch


def _sorted_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From segments in order: repeats (anchor null, as known ones come), and
    the first segment of each kind where an anchor has several kinds. Holds one
    row at a time from one batch to the next."""
    last: tuple | None = None  # the row before
    pending: tuple | None = None  # first of its anchor, if no other kind came yet
    for b in batches:
        settled = b.filter(b.column(0).is_null())
        if settled.num_rows:
            yield settled.select(["_anchor", "_id", "_h", "_place"])
            b = b.filter(b.column(0).is_valid())
        if not b.num_rows:
            continue
        a, k, i, h, p = (c.to_numpy() for c in b.columns)
        before = [np.concatenate([[x[0] if last is None else y], x[:-1]]) for x, y in zip((a, k, i, h, p), last or (0,) * 5)]
        same_anchor = a == before[0]
        same_kind = same_anchor & (k == before[1])
        same_row = same_kind & (i == before[2]) & (h == before[3]) & (p == before[4])
        if last is None:
            same_anchor[0] = same_kind[0] = same_row[0] = False
        repeat = np.flatnonzero(same_kind & ~same_row)
        heads = np.flatnonzero(~same_kind)
        opens = ~same_anchor[heads]
        followed = np.append(~opens[1:], False)
        several = heads[~opens | followed]
        if pending is not None and len(heads) and not opens[0]:
            yield _segment_rows(*([x] for x in pending))
            pending = None
        if len(heads):
            at = heads[-1]
            pending = (a[at], i[at], h[at], p[at]) if opens[-1] else None
        last = (a[-1], k[-1], i[-1], h[-1], p[-1])
        yield _segment_rows(a[several], i[several], h[several], p[several])
        yield _segment_rows(None, i[repeat], h[repeat], p[repeat])


def _segment_rows(anchor, i, h, place) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.nulls(len(i), pa.int64()) if anchor is None else pa.array(anchor, pa.int64()), pa.array(i, pa.int64()),
         pa.array(h, pa.int64()), pa.array(place, pa.int64())], names=["_anchor", "_id", "_h", "_place"])


def _with_segments(keyed: DataFrame, segments: DataFrame) -> DataFrame:
    """The documents of segments, and their list."""
    wanted = segments.groupBy("_id", "_h").agg(F.collect_list(F.struct("_anchor", "_place")).alias("_segments"))
    return _only(keyed, wanted).join(wanted, ["_id", "_h"]).select("_id", "_h", "_text", "_segments")


def _contexts(keyed: DataFrame, several: DataFrame, length: int) -> DataFrame:
    """The bytes of segments, and the unit (anchor) they meet in."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in range(b.num_rows):
                i, h, text = (b.column(c)[row].as_py() for c in range(3))
                segments = b.column(3)[row].values
                unit, place = (segments.field(c) for c in range(2))
                at, n = place.to_numpy() >> 8, place.to_numpy() & 255
                bytes_ = [text[s:s + c + length - 1] for s, c in zip(at.tolist(), n.tolist())]
                yield pa.RecordBatch.from_arrays(
                    [unit, pa.array(np.full(len(unit), i)), pa.array(np.full(len(unit), h)), place, pa.array(bytes_, pa.binary())],
                    names=["_unit", "_id", "_h", "_place", "_bytes"])

    return _with_segments(keyed, several).mapInArrow(work, "_unit bigint, _id bigint, _h bigint, _place bigint, _bytes binary")


def _strings(keyed: DataFrame, several: DataFrame, length: int) -> DataFrame:
    """The strings of segments as segments of their own, with their hash as
    anchor and kind. Worked on by ``BLOCK`` bytes of contexts, each of which
    leaves one row per string: not even a string that every document has is
    moved for each of them."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for b in batches:
            for row in range(b.num_rows):
                i, h, text = (b.column(c)[row].as_py() for c in range(3))
                for p in b.column(3)[row].values.field(1).to_pylist():
                    context = text[p >> 8:(p >> 8) + (p & 255) + length - 1]
                    if size + len(context) > BLOCK:
                        yield _first_of_string(held, length)
                        held, size = [], 0
                    held.append((i, h, p, context))
                    size += len(context)
        if held:
            yield _first_of_string(held, length)

    return _with_segments(keyed, several).mapInArrow(work, "_anchor bigint, _kind bigint, _id bigint, _h bigint, _place bigint")


def _first_of_string(segments: list[tuple[int, int, int, bytes]], length: int) -> pa.RecordBatch:
    """For (id, h, place, context): the first start of each string, and the
    others as repeats (anchor null), neighbours of a segment in one row."""
    i, h, place = (np.array(x, np.int64) for x in list(zip(*segments))[:3])
    counts = place & 255
    row = np.repeat(np.arange(len(counts)), counts)
    step = np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)
    own = step + row * (length - 1) + np.repeat(np.cumsum(counts) - counts, counts)
    string = Spans(np.frombuffer(b"".join(x[3] for x in segments), np.uint8)).hashes(own, own + length).view(np.int64)
    i, h, at = i[row], h[row], (place >> 8)[row] + step
    order = np.lexsort((at, h, i, string))
    same = string[order][1:] == string[order][:-1]
    twice = same & np.logical_and.reduce([x[order][1:] == x[order][:-1] for x in (i, h, at)])  # repeated rows are one document
    first, repeated = np.ones(len(row), bool), np.zeros(len(row), bool)
    first[order[1:]], repeated[order[1:]] = ~same, same & ~twice
    first, hit = np.flatnonzero(first), np.flatnonzero(repeated)
    new = np.concatenate([[True], (np.diff(hit) != 1) | (np.diff(row[hit]) != 0)])[:len(hit)]
    head = hit[new]
    n = np.diff(np.append(np.flatnonzero(new), len(hit)))
    rows = np.concatenate([first, head])
    known = pa.array(string[rows], mask=np.arange(len(rows)) >= len(first))
    ends = np.concatenate([np.ones(len(first), np.int64), n])
    return pa.RecordBatch.from_arrays([known, *(pa.array(x) for x in (string[rows], i[rows], h[rows], (at[rows] << 8) | ends))],
                                      names=["_anchor", "_kind", "_id", "_h", "_place"])


def repeated_starts(contexts: list[bytes], counts: np.ndarray, length: int) -> np.ndarray:
    """For the string starts of contexts in document order, one after the
    other: whether an equal string starts before."""
    sizes = np.array([len(c) for c in contexts], np.int64)
    text = np.frombuffer(b"".join(contexts), np.uint8)
    own = np.repeat(np.cumsum(sizes) - sizes - np.cumsum(counts) + counts, counts) + np.arange(counts.sum())
    is_own = np.zeros(len(text), bool)
    is_own[own] = True
    order, group = equal_groups(text, length)
    ours = is_own[order]
    place, group = order[ours], group[ours]
    earliest = np.full(int(group[-1]) + 1, len(text), np.int64)
    np.minimum.at(earliest, group, place)
    repeated = np.zeros(len(text), bool)
    repeated[place] = place > earliest[group]
    return repeated[own]


def _expanded(batches: Iterator[pa.RecordBatch], length: int, chunk: int) -> Iterator[pa.RecordBatch]:
    def work(rows: pa.Table) -> pa.RecordBatch:
        rows = rows.sort_by([("_id", "ascending"), ("_h", "ascending"), ("_place", "ascending")])
        i, h, place = (rows.column(c).to_numpy() for c in (1, 2, 3))
        once = np.concatenate([[True], (np.diff(i) != 0) | (np.diff(h) != 0) | (np.diff(place) != 0)])
        rows, i, h, place = rows.filter(pa.array(once)), i[once], h[once], place[once]  # repeated rows are one document
        counts = place & 255
        repeated = repeated_starts(rows.column(4).to_pylist(), counts, length)
        # neighbouring repeated starts of a segment become one segment
        row = np.repeat(np.arange(len(counts)), counts)
        at = np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)
        hit = np.flatnonzero(repeated)
        new = np.concatenate([[True], (np.diff(hit) != 1) | (np.diff(row[hit]) != 0)])[:len(hit)]
        head = hit[new]
        n = np.diff(np.append(np.flatnonzero(new), len(hit)))
        return _segment_rows(None, i[row[head]], h[row[head]], (((place >> 8)[row[head]] + at[head]) << 8) | n)

    held: list[pa.Table] = []
    size = 0
    for rows in whole_groups(batches, 1):
        unit = rows.column(0).to_numpy()
        cuts = np.append(np.flatnonzero(np.diff(unit)) + 1, len(unit))
        bytes_ = np.cumsum(pc.binary_length(rows.column(4)).to_numpy())
        begin = taken = 0
        for cut in cuts.tolist():
            if size + bytes_[cut - 1] - taken >= chunk:
                yield work(pa.concat_tables([*held, rows.slice(begin, cut - begin)]))
                held, size, begin, taken = [], 0, cut, bytes_[cut - 1]
        if begin < len(unit):
            held.append(rows.slice(begin))
            size += bytes_[-1] - taken
    if held:
        yield work(pa.concat_tables(held))


def _only(keyed: DataFrame, wanted: DataFrame) -> DataFrame:
    """Documents in ``wanted``: by a broadcast of their numbers if these are
    few enough, so that other texts needn't move; else the later join sorts them out."""
    return keyed.join(bounded_broadcast(wanted.select("_id", "_h"), 1_000_000), ["_id", "_h"], "left_semi")


def repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = 100, chunk: int = CHUNK, most: int = MOST) -> DataFrame:
    """Repeats (``_id``, ``_h``, ``_segments``: list of starts << 8 | number of
    repeated string starts from there on) of the documents of :func:`_keyed`."""
    keyed = _keyed(docs, key, text)
    return _repeats(keyed, _n_bytes(keyed), length, chunk, most)


def _repeats(keyed: DataFrame, n_bytes: int, length: int, chunk: int, most: int) -> DataFrame:
    bounded_batches(keyed.sparkSession)
    schema = "_anchor bigint, _id bigint, _h bigint, _place bigint"

    def settled(segments: DataFrame) -> DataFrame:
        return segments.repartition(F.coalesce("_anchor", F.xxhash64("_id", "_place"))).sortWithinPartitions(
            "_anchor", "_kind", "_id", "_h", "_place").mapInArrow(_sorted_out, schema)

    # about one segment for every other choice
    sorted_out = cut_lineage(settled(_segments(keyed, length)), 2 * n_bytes // CHOICES)
    n_left = sorted_out.count()
    several = sorted_out.where(F.col("_anchor").isNotNull())
    every = sorted_out.where(F.col("_anchor").isNull())
    many = cut_lineage(several.groupBy("_anchor").agg(F.count(F.lit(1)).alias("_kinds")).where(F.col("_kinds") > most).select("_anchor"), n_left)
    if not many.isEmpty():
        many = bounded_broadcast(many, 1_000_000)
        every = every.unionAll(settled(_strings(keyed, several.join(many, "_anchor", "left_semi"), length)))
        several = several.join(many, "_anchor", "left_anti")
    contexts = _contexts(keyed, several, length).repartition("_unit").sortWithinPartitions("_unit")
    expanded = contexts.mapInArrow(lambda batches: _expanded(batches, length, chunk), schema)
    every = every.unionAll(expanded).select("_id", "_h", "_place")
    return cut_lineage(every.groupBy("_id", "_h").agg(F.collect_list("_place").alias("_segments")), n_left)


def merged(segments: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Maximal removed runs (starts, ends) of one document."""
    start = segments >> 8
    order = np.argsort(start, kind="stable")
    start = start[order]
    end = np.maximum.accumulate(start + (segments & 255)[order] + length - 1)
    new = np.concatenate([[True], start[1:] > end[:-1]])
    return start[new], end[np.append(new[1:], True)]


def kept_bytes(text: bytes, starts: np.ndarray, ends: np.ndarray) -> bytes:
    cuts = zip([0, *ends.tolist()], [*starts.tolist(), len(text)])
    return b"".join(text[a:b] for a, b in cuts)


def removals(docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = 100, chunk: int = CHUNK, most: int = MOST) -> DataFrame:
    """Per row: the key, ``n_bytes``, ``n_removed``, ``n_spans`` and
    ``kept_sha256`` (of the bytes that remain)."""
    keyed = _keyed(docs, key, text)
    found = _repeats(keyed, _n_bytes(keyed), length, chunk, most)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for row in range(b.num_rows):
                body, segments = b.column(2)[row].as_py(), b.column(3)[row].values.to_numpy()
                starts, ends = merged(segments, length)
                out.append((int((ends - starts).sum()), len(starts), hashlib.sha256(kept_bytes(body, starts, ends)).hexdigest()))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *(pa.array(x) for x in zip(*out))],
                                             names=["_id", "_h", "_removed", "_spans", "_sha"]) if out else b.select([0, 1]).slice(0, 0)

    cut = _only(keyed, found).join(found, ["_id", "_h"]).select("_id", "_h", "_text", "_segments").mapInArrow(
        lambda batches: work(b for b in batches if b.num_rows), "_id bigint, _h bigint, _removed bigint, _spans bigint, _sha string").dropDuplicates(["_id", "_h"])
    rows = keyed.select("_id", "_h", F.octet_length("_text").cast("bigint").alias("n_bytes"), F.sha2("_text", 256).alias("_whole"))
    return rows.join(cut, ["_id", "_h"], "left").select(
        F.when(F.col("_id") != LAST, F.col("_id")).alias(key), "n_bytes", F.coalesce("_removed", F.lit(0)).cast("bigint").alias("n_removed"),
        F.coalesce("_spans", F.lit(0)).cast("bigint").alias("n_spans"), F.coalesce("_sha", "_whole").alias("kept_sha256"))


def without_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = 100, chunk: int = CHUNK, most: int = MOST) -> DataFrame:
    """The documents with the columns they had and without repeated passages;
    a character that a cut breaks goes with it. Documents of which nothing is
    left are dropped."""
    keyed = _keyed(docs, key, text)
    n_bytes = _n_bytes(keyed)
    found = _repeats(keyed, n_bytes, length, chunk, most)
    names = [f"c{k}" for k in range(len(docs.columns))]
    at = docs.columns.index(text)
    body = F.col(names[at])
    rows = _identified(docs.toDF(*names), names[docs.columns.index(key)], names[at])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            left = pa.array([kept_bytes(b.column(at)[row].as_py().encode(), *merged(b.column(len(names))[row].values.to_numpy(), length))
                             .decode("utf-8", "ignore") for row in range(b.num_rows)], pa.string())
            yield pa.RecordBatch.from_arrays([left if k == at else b.column(k) for k in range(len(names))], names=names)

    cut = _only(rows, found).join(found, ["_id", "_h"]).select(*names, "_segments").coalesce(files_of(n_bytes)).mapInArrow(work, rows.select(names).schema)
    numbers = bounded_broadcast(found.select("_id", "_h"), 1_000_000)
    whole = rows.join(numbers, ["_id", "_h"], "left_anti").select(names)
    return whole.unionAll(cut.where(F.length(body) > 0)).toDF(*docs.columns)
