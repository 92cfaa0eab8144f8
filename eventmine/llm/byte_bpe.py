"""Byte-level BPE of whole texts, there and back, by a two-tier lookup.

A vocabulary is a file of ranks (base64 of a token's bytes, its rank). Texts
are cut into pre-tokens by a pattern, and each pre-token is encoded by itself.

1. Pre-tokens that are tokens: a minimal perfect hash maps a pre-token's
   64-bit hash to the one slot that could hold it (hash and displace: keys
   fall into small groups, each group has a displacement that sends its keys
   to free slots, as many slots as tokens). The bytes in the slot are compared,
   so other pre-tokens never pass. This is done for a block of text at once.
2. The others: adjacent parts of the pre-token's bytes are merged, lowest rank
   first and leftmost among equals. The short ones of a block, each once, are
   merged together, one merge of each at a time; ranks come from a table of
   all pairs of tokens that make a token. Long ones use a heap over a linked
   list, so a pre-token of n bytes takes n log n steps, a megabyte without a
   blank included. Ids of short ones are kept by their bytes, a bounded number.

Long texts are cut into blocks where a pre-token must start (see
:mod:`.tokenizing`), so what a task holds beside the text and its ids is bounded.

Cases: a null or empty text has no ids, and no ids decode to no bytes; bytes
that aren't UTF-8 are replaced (U+FFFD) before encoding; strings of special
tokens are ordinary text; repeated rows and repeated or null keys give a row
each; extra columns are ignored by :func:`encode` and kept by :func:`decode`;
an empty table gives no rows. An id outside the vocabulary is an error.
"""

from __future__ import annotations

import base64
import heapq
from array import array
from bisect import bisect_left
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded_batches, held_by_worker, utf8, valid_utf8
from .hashes import Spans, mixed
from .tokenizing import stable_boundaries

#: bytes of text looked up at once
BLOCK = 1 << 19
#: pre-tokens outside the vocabulary that a worker keeps, and their longest
KEPT, KEPT_BYTES = 300_000, 64
#: keys in a group of the perfect hash, on average, and displacements tried at once
GROUP, TRIES = 4, 128
#: short pre-tokens merged together have lengths up to the same of these
WIDTHS = (8, 12, 16, 24, 40, KEPT_BYTES)
#: rank of what is no token, and the bits of a pair's hash
NONE, PAIR_BITS = np.iinfo(np.int32).max, 20
_STEP = np.uint64(0x9E3779B97F4A7C15)


class PerfectHash:
    """A minimal perfect hash of distinct 64-bit keys: ``slots(keys)`` is a
    permutation of 0 .. n - 1; any other key gets some slot."""

    def __init__(self, keys: np.ndarray):
        self.n, self.groups = len(keys), len(keys) // GROUP + 1
        if len(np.unique(keys)) != self.n:
            raise ValueError("keys must be distinct")
        # negative: a group of one key, and the slot it has; else the displacement
        self.displacement = np.zeros(self.groups, np.int64)
        group = (keys % np.uint64(self.groups)).astype(np.int64)
        order = np.argsort(group, kind="stable")
        size = np.bincount(group, minlength=self.groups)
        begin = np.cumsum(size) - size
        free = np.ones(self.n, bool)
        tries = np.arange(TRIES, dtype=np.uint64)[:, None]
        for g in np.argsort(-size, kind="stable").tolist():
            if size[g] < 2:
                break
            own, at = keys[order[begin[g]:begin[g] + size[g]]], 0
            while True:
                slots = np.sort(self._displaced(own, tries + np.uint64(at)), axis=1)
                fits = free[slots].all(axis=1) & (slots[:, 1:] != slots[:, :-1]).all(axis=1)
                if fits.any():
                    k = int(fits.argmax())
                    break
                at += TRIES
            free[slots[k]] = False
            self.displacement[g] = at + k
        self.displacement[size == 1] = -1 - np.flatnonzero(free)

    def _displaced(self, keys: np.ndarray, d: np.ndarray) -> np.ndarray:
        return (mixed(keys + d * _STEP) % np.uint64(self.n)).astype(np.int64)

    def slots(self, keys: np.ndarray) -> np.ndarray:
        d = self.displacement[(keys % np.uint64(self.groups)).astype(np.int64)]
        return np.where(d < 0, -1 - d, self._displaced(keys, np.maximum(d, 0).astype(np.uint64)))


class PairRanks:
    """Which token two adjacent tokens make, for many pairs at once."""

    def __init__(self, ranks: dict[bytes, int]):
        self.n = max(ranks.values()) + 1
        made = [(a * self.n + b, r) for t, r in ranks.items() for k in range(1, len(t))
                if (a := ranks.get(t[:k])) is not None and (b := ranks.get(t[k:])) is not None]
        keys, ids = np.array(made, np.int64).reshape(-1, 2).T
        at = self._hashes(keys)
        order = np.argsort(at, kind="stable")
        filled = np.bincount(at, minlength=1 << PAIR_BITS)
        self.first, self.deepest = (np.cumsum(filled) - filled).astype(np.int32), int(filled.max())
        # keys of one hash stand side by side; so many are looked at from the first on
        self.keys = np.append(keys[order], np.full(self.deepest, -1))
        self.ids = np.append(ids[order], np.full(self.deepest, NONE)).astype(np.int32)

    def _hashes(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * _STEP) >> np.uint64(64 - PAIR_BITS)).astype(np.int64)

    def of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The id of each pair, or ``NONE``."""
        keys = left.astype(np.int64) * self.n + right
        at, found = self.first[self._hashes(keys)], np.full(keys.shape, NONE, np.int32)
        for k in range(self.deepest):
            np.copyto(found, self.ids[at + k], where=self.keys[at + k] == keys)
        return found


def merged_together(pieces: list[bytes], pairs: PairRanks, byte_ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What :func:`merged` gives for each of some pre-tokens, none empty: a row
    of ids for each, and how many of them count."""
    size = np.array([len(p) for p in pieces], np.int64)
    width = int(size.max())
    ids = byte_ids[np.frombuffer(b"".join(p.ljust(width, b"\0") for p in pieces), np.uint8)].reshape(-1, width)
    column = np.arange(width)
    # ranks[:, k]: of the parts k and k + 1 together
    ranks = np.full(ids.shape, NONE, np.int32)
    ranks[:, :-1] = np.where(column[1:] < size[:, None], pairs.of(ids[:, :-1], ids[:, 1:]), NONE)
    done, sizes, rows = ids.copy(), size.copy(), np.arange(len(ids))
    while True:
        low = ranks.argmin(axis=1)
        found = ranks[np.arange(len(rows)), low]
        go = found < NONE
        if not go.all():
            done[rows[~go]], sizes[rows[~go]] = ids[~go], size[~go]
            rows, ids, ranks, size, low, found = (x[go] for x in (rows, ids, ranks, size, low, found))
        if not len(rows):
            return done, sizes
        # the part behind goes, what follows moves up
        every = np.arange(len(rows))
        behind = column[:-1] >= low[:, None]
        np.copyto(ranks[:, :-1], ranks[:, 1:].copy(), where=behind)
        behind[every, np.minimum(low, width - 2)] = False
        np.copyto(ids[:, :-1], ids[:, 1:].copy(), where=behind)
        ids[every, low] = found
        size -= 1
        ranks[:, -1] = NONE
        after = np.flatnonzero(low + 1 < size)
        ranks[after, low[after]] = pairs.of(found[after], ids[after, low[after] + 1])
        before = np.flatnonzero(low > 0)
        ranks[before, low[before] - 1] = pairs.of(ids[before, low[before] - 1], found[before])


def merged(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one pre-token: its bytes, merged by rank."""
    n = len(piece)
    after, before = list(range(1, n + 2)), list(range(-1, n))
    heap = [(r, k, k + 2) for k in range(n - 1) if (r := ranks.get(piece[k:k + 2])) is not None]
    heapq.heapify(heap)
    gone = bytearray(n + 1)
    while heap:
        _, k, end = heapq.heappop(heap)
        middle = after[k]
        if gone[k] or middle >= n or after[middle] != end:
            continue  # one of its parts has been merged meanwhile
        gone[middle] = 1
        after[k], before[end] = end, k
        if end < n and (r := ranks.get(piece[k:after[end]])) is not None:
            heapq.heappush(heap, (r, k, after[end]))
        if k and (r := ranks.get(piece[before[k]:end])) is not None:
            heapq.heappush(heap, (r, before[k], end))
    ids, k = [], 0
    while k < n:
        ids.append(ranks[piece[k:after[k]]])
        k = after[k]
    return ids


def _ranges(first: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """All of first .. first + size - 1, one range after the other."""
    ends = np.cumsum(sizes)
    return np.repeat(first - ends + sizes, sizes) + np.arange(int(ends[-1]) if len(ends) else 0)


class ByteBpe:
    """A vocabulary of ranks with its perfect hash."""

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(t): int(r) for t, r in (line.split() for line in f if line.strip())}
        self.pattern = regex.compile(pattern)
        tokens, ids = list(self.ranks), np.array(list(self.ranks.values()), np.int64)
        # tokens by id, end to end
        self.size = np.full(int(ids.max()) + 1, -1, np.int64)
        self.size[ids] = [len(t) for t in tokens]
        by_id = {r: t for t, r in self.ranks.items()}
        self.bytes = np.frombuffer(b"".join(by_id[k] for k in sorted(by_id)), np.uint8)
        self.begin = np.cumsum(np.maximum(self.size, 0)) - np.maximum(self.size, 0)
        self._clear()

    @cached_property
    def _hash(self) -> tuple[PerfectHash, np.ndarray]:
        """The perfect hash of all tokens, and the id in each slot."""
        ids = np.flatnonzero(self.size >= 0)
        keys = Spans(self.bytes).hashes(self.begin[ids], self.begin[ids] + self.size[ids])
        found = PerfectHash(keys)
        at = np.empty(len(ids), np.int64)
        at[found.slots(keys)] = ids
        return found, at

    @cached_property
    def _pairs(self) -> tuple[PairRanks, np.ndarray] | None:
        """Ranks of pairs and the ids of single bytes, if each byte has one."""
        alone = [self.ranks.get(bytes([b]), -1) for b in range(256)]
        return None if -1 in alone else (PairRanks(self.ranks), np.array(alone, np.int32))

    def _clear(self) -> None:
        """Nothing kept: no pre-token's ids, which stand in one row in ``store``."""
        self.at: dict[bytes, int] = {}
        self.store = array("i")
        self.ends = array("q", [0])

    def tier_one(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The id of each span that is a token, else -1."""
        found, id_at = self._hash
        ids = id_at[found.slots(Spans(data).hashes(starts, ends))]
        maybe = np.flatnonzero(self.size[ids] == ends - starts)
        sizes = self.size[ids[maybe]]
        equal = data[_ranges(starts[maybe], sizes)] == self.bytes[_ranges(self.begin[ids[maybe]], sizes)]
        found = np.full(len(starts), -1, np.int64)
        if len(maybe):
            same = np.add.reduceat(equal, np.cumsum(sizes) - sizes, dtype=np.int64) == sizes
            found[maybe[same]] = ids[maybe[same]]
        return found

    def _added(self, pieces: list[bytes]) -> dict[bytes, int]:
        """Where the ids of new pre-tokens now stand; short ones are kept."""
        new: dict[bytes, int] = {}
        by_width: list[list[bytes]] = [[] for _ in WIDTHS]
        for piece in pieces:
            if len(piece) <= KEPT_BYTES and self._pairs:
                by_width[bisect_left(WIDTHS, len(piece))].append(piece)
            else:
                new[piece] = len(self.ends) - 1
                self.store.extend(merged(piece, self.ranks))
                self.ends.append(len(self.store))
        for own in by_width:
            if own:
                ids, sizes = merged_together(own, *self._pairs)
                new.update(zip(own, range(len(self.ends) - 1, len(self.ends) - 1 + len(own))))
                self.ends.frombytes((len(self.store) + np.cumsum(sizes)).tobytes())
                self.store.frombytes(ids[np.arange(ids.shape[1]) < sizes[:, None]].tobytes())
        self.at.update((piece, place) for piece, place in new.items() if len(piece) <= KEPT_BYTES)
        return new

    def tier_two(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pre-tokens that are no tokens, one after the other, and how
        many each has."""
        if len(self.at) > KEPT or len(self.store) > KEPT * KEPT_BYTES:
            self._clear()
        places = list(map(self.at.get, pieces))
        missed = [k for k, place in enumerate(places) if place is None]
        new = self._added(list(dict.fromkeys([pieces[k] for k in missed])))
        for k in missed:
            places[k] = new[pieces[k]]
        at = np.array(places, np.int64)
        ends = np.array(self.ends)
        sizes = ends[at + 1] - ends[at]
        return np.array(self.store)[_ranges(ends[at], sizes)], sizes

    def block(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the texts, one after the other, and how many each has."""
        pieces, n_pieces = [], []
        for t in texts:
            own = self.pattern.findall(t)
            n_pieces.append(len(own))
            pieces += own
        if not pieces:
            return np.zeros(0, np.int64), np.zeros(len(texts), np.int64)
        raw = "".join(texts).encode()
        data = np.frombuffer(raw, np.uint8)
        ends = np.cumsum(np.fromiter(map(len, pieces), np.int64, len(pieces)))
        if ends[-1] != len(data):  # characters to bytes
            ends = np.append(np.flatnonzero(data & 0xC0 != 0x80), len(data))[ends]
        starts = np.append(0, ends[:-1])
        found = self.tier_one(data, starts, ends)
        sizes = np.ones(len(found), np.int64)
        missed = np.flatnonzero(found < 0)
        rest, sizes[missed] = self.tier_two([raw[s:e] for s, e in zip(starts[missed].tolist(), ends[missed].tolist())])
        at = np.cumsum(sizes) - sizes
        ids = np.empty(int(sizes.sum()), np.int64)
        hit = found >= 0
        ids[at[hit]] = found[hit]
        ids[_ranges(at[missed], sizes[missed])] = rest
        before = np.append(0, np.cumsum(sizes))[np.append(0, np.cumsum(n_pieces))]
        return ids, np.diff(before)

    def encode(self, texts: list[bytes], block: int = BLOCK) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts and how many each has; about ``block`` bytes at a time."""
        of, sizes, out = [], [], []
        group: list[str] = []
        held = 0

        def work() -> None:
            nonlocal held
            ids, n = self.block(group)
            out.append(ids.astype(np.int32))
            sizes.extend(n.tolist())
            group.clear()
            held = 0

        for k, text in enumerate(texts):
            for part in cut_at_boundaries(valid_utf8(text), block):
                if group and held + len(part) > block:
                    work()
                of.append(k)
                group.append(part.decode())
                held += len(part)
        if group:
            work()
        ids = np.concatenate(out) if out else np.zeros(0, np.int32)
        return ids, np.bincount(of, sizes, minlength=len(texts)).astype(np.int64)

    def decode(self, ids: np.ndarray) -> tuple[bytes, np.ndarray]:
        """The tokens' bytes, one after the other, and the size of each."""
        if ids.size and (ids.min() < 0 or ids.max() >= len(self.size) or (self.size[ids] < 0).any()):
            raise ValueError("an id outside the vocabulary")
        sizes = self.size[ids]
        return self.bytes[_ranges(self.begin[ids], sizes)].tobytes(), sizes


def cut_at_boundaries(text: bytes, block: int = BLOCK) -> Iterator[bytes]:
    """The text in parts of about ``block`` bytes, cut where a pre-token must
    start; a part goes on where there is no such place."""
    at = 0
    while len(text) - at > block:
        # a boundary is proven by the two bytes on either side of it
        look = block
        while True:
            found = stable_boundaries(np.frombuffer(text, np.uint8, min(look + 8, len(text) - at), at))
            found = found[(found > 2) & (found <= look)]
            if found.size or at + look >= len(text):
                break
            look *= 2
        if not found.size:
            break
        yield text[at:at + int(found[-1])]
        at += int(found[-1])
    if at < len(text):
        yield text[at:] if at else text


def load_vocabulary(path: str, pattern: str) -> ByteBpe:
    return held_by_worker(ByteBpe, path, pattern)


def encode(docs: DataFrame, ranks: str, pattern: str, keys: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """Per row: its ``keys`` and ``ids``. ``ranks``: path of a vocabulary
    file, which every executor must have."""
    bounded_batches(docs.sparkSession)
    given = docs.select(*keys, utf8(text).alias("_text"))
    schema = T.StructType([given.schema[k] for k in keys] + [T.StructField("ids", T.ArrayType(T.IntegerType()))])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load_vocabulary(ranks, pattern)
        for b in batches:
            ids, sizes = bpe.encode(b.column(b.num_columns - 1).to_pylist())
            offsets = pa.array(np.append(0, np.cumsum(sizes)), pa.int32())
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.ListArray.from_arrays(offsets, pa.array(ids, pa.int32()))], names=[*keys, "ids"])

    return given.mapInArrow(work, schema)


def decode(rows: DataFrame, ranks: str, pattern: str, ids: str = "ids", out: str = "bytes") -> DataFrame:
    """Adds ``out``: the bytes that the ids stand for (null for null)."""
    bounded_batches(rows.sparkSession)
    at = rows.columns.index(ids)
    schema = T.StructType([*rows.schema.fields, T.StructField(out, T.BinaryType())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load_vocabulary(ranks, pattern)
        for b in batches:
            lists = b.column(at)
            flat = lists.flatten().to_numpy(zero_copy_only=False)
            if flat.dtype.kind == "f":  # nulls inside
                raise ValueError("an id outside the vocabulary")
            raw, sizes = bpe.decode(flat.astype(np.int64))
            n_ids = np.array([0 if n is None else n for n in lists.value_lengths().to_pylist()], np.int64)
            ends = np.append(0, np.cumsum(sizes))[np.cumsum(n_ids)].tolist()
            texts = [None if gone else raw[s:e] for gone, s, e in zip(lists.is_null().to_pylist(), [0, *ends[:-1]], ends)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(texts, pa.binary())], names=[*b.schema.names, out])

    return rows.mapInArrow(work, schema)
