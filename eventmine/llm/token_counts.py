"""Token counts of whole texts by overlap resynchronisation.

A text of at most ``chunk`` bytes is encoded at once. A longer one is encoded
in windows of ``chunk`` bytes that overlap; neighbouring windows are spliced
at a stable boundary (see :mod:`.tokenizing`) that both found in the overlap,
far enough from either window's edge that the bytes which prove it are inside
both. What lies between two such boundaries is then encoded from the same
bytes as in the whole text. Where an overlap holds no common boundary it is
doubled, at worst up to the end of the text, so the counts are always those
of the whole text, with memory bounded by the window.

Cases: a null or empty text has 0 bytes and 0 tokens; repeated rows and
repeated or null ids give one row each; extra columns are ignored, so their
names can't clash; an empty table gives no rows. Strings of special tokens
inside a text count as the library counts them by default.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded_batches, utf8, valid_utf8
from .tokenizing import PieceTokenizer, batched, piece_tokenizer

CHUNK = 256 << 10
OVERLAP = 1 << 10
#: a boundary is proven by the two bytes before it and the two from it on
MARGIN = 4


def _char_start(text: bytes, at: int) -> int:
    while at < len(text) and text[at] & 0xC0 == 0x80:
        at += 1
    return at


def count_long(text: bytes, tok: PieceTokenizer, chunk: int = CHUNK, overlap: int = OVERLAP) -> int:
    """Number of ids of one text without special tokens, window by window."""
    def window(at: int, to: int):
        starts, places = tok.pieces(np.frombuffer(text, np.uint8, min(to, len(text)) - at, at), np.zeros(1, np.int64))
        return starts + at, tok.size[places]

    total, done, at = 0, 0, 0  # done: where the pieces not counted yet begin
    end = _char_start(text, chunk + overlap)
    starts, sizes = window(0, end)
    while end < len(text):
        nxt = _char_start(text, at + chunk)
        nxt_end = _char_start(text, nxt + chunk + overlap)
        more, more_sizes = window(nxt, nxt_end)
        both = np.intersect1d(starts, more, assume_unique=True)
        both = both[(both >= max(nxt + MARGIN, done)) & (both <= end - MARGIN)]
        if both.size:
            total += int(sizes[(starts >= done) & (starts < both[0])].sum())
            done, at, end, starts, sizes = int(both[0]), nxt, nxt_end, more, more_sizes
        else:
            end = _char_start(text, end + (end - nxt))
            starts, sizes = window(at, end)
    return total + int(sizes[starts >= done].sum())


def count_batch(texts: list[bytes], tok: PieceTokenizer, chunk: int = CHUNK, overlap: int = OVERLAP) -> list[int]:
    short = iter(batched([t for t in texts if len(t) <= chunk], tok, False))
    return [next(short)[0] if len(t) <= chunk else sum(
        1 if odd % 2 else count_long(part, tok, chunk, overlap) for odd, part in enumerate(tok.segments(t)) if part)
        for t in texts]


def count_tokens(docs: DataFrame, tokenizer: str, keys: tuple[str, ...] = ("doc_id",), text: str = "text",
                 limit: int = 512, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """Per row: its ``keys``, ``n_bytes`` (UTF-8), ``n_tokens`` and
    ``over_limit`` (more than ``limit`` tokens). ``tokenizer``: path of a
    vocabulary file, which every executor must have."""
    bounded_batches(docs.sparkSession)
    given = docs.select(*keys, utf8(text).alias("_text"))
    schema = T.StructType([given.schema[k] for k in keys] + [T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = piece_tokenizer(tokenizer)
        for b in batches:
            texts = b.column(b.num_columns - 1).to_pylist()
            counts = count_batch(list(map(valid_utf8, texts)), tok, chunk, overlap)
            yield pa.RecordBatch.from_arrays(
                [*b.columns[:-1], pa.array(map(len, texts), pa.int64()), pa.array(counts, pa.int64())],
                names=[*keys, "n_bytes", "n_tokens"])

    return given.mapInArrow(work, schema).withColumn("over_limit", F.col("n_tokens") > limit)
