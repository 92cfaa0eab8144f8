"""Language identification by compression.

For each language a dictionary of raw text is drawn from labelled documents.
A text is compressed with every language's dictionary (zstandard, raw content)
and gets the language that makes it smallest. Where the runner-up is nearly
as small, the text is rejected.

The dictionaries are fitted on a bounded sample: per language ``per_lang``
documents (the first in a hash order of their ids, found with a partial limit
before the shuffle) with ``excerpt`` characters from the middle of each.
Everything else takes all rows and whole texts; a text is compressed in blocks
of ``BLOCK`` bytes, so memory doesn't grow with it.

Cases: a null text, or one without a letter, is ``und`` with score 0 and
rejected; so is every text if no labelled row exists. Equal sizes give the
language that more labelled rows have, then the first by name. Rows without a text, label or id are not learned
from, and a null id is not held out. Repeated rows and ids give one row each;
an empty table gives no rows. Columns passed through must not be named like
the results (``lang_pred``, ``score``, ``margin``, ``rejected``); others may
have any name.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded_batches, held_by_worker

BLOCK = 32 << 10
#: short matches, searched well: what tells languages apart are parts of words
SEARCH = dict(strategy=zstandard.STRATEGY_BTLAZY2, min_match=4, search_log=4, hash_log=16, chain_log=18, window_log=18,
              write_content_size=False, write_dict_id=False)
RESULTS = ("lang_pred", "score", "margin", "rejected")
#: ASCII letters in lower case, other ASCII characters as space; other bytes stay
_PLAIN = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b > 127 else 32 for b in range(256))


def held_out(key: str = "doc_id", folds: int = 5) -> Column:
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % folds == 0, F.lit(False))


def plain(text: bytes) -> bytes:
    return b" ".join(text.translate(_PLAIN).split())


def learn(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", per_lang: int = 64,
          excerpt: int = 1500, folds: int = 5, max_langs: int = 256) -> dict[str, bytes]:
    """Dictionary of each of the ``max_langs`` commonest languages, from rows
    that are not held out: at most ``per_lang * excerpt`` characters per
    language come to the driver."""
    labelled = docs.select(F.col(key).alias("_id"), F.col(lang).alias("_lang"), F.col(text).alias("_text")).where(
        F.col("_text").isNotNull() & F.col("_lang").isNotNull() & F.col("_id").isNotNull() & ~held_out("_id", folds))
    order = Window.partitionBy("_lang").orderBy(F.xxhash64("_id"), "_id", "_text")
    middle = F.substr("_text", F.greatest(F.lit(1), F.expr(f"length(_text) div 2 - {excerpt // 2}").cast("int")), F.lit(excerpt))
    per = labelled.groupBy("_lang").count().orderBy(F.col("count").desc(), "_lang").limit(max_langs)
    common = {r["_lang"]: r["count"] for r in per.collect()}
    rows = (labelled.where(F.col("_lang").isin(*common)).select("_id", "_lang", middle.alias("_text")).withColumn("_nth", F.row_number().over(order))
            .where(F.col("_nth") <= per_lang).orderBy("_lang", "_nth").select("_lang", "_text").collect()) if common else []
    model: dict[str, list[bytes]] = {}
    for r in rows:
        model.setdefault(r["_lang"], []).append(plain(r["_text"].encode()))
    by_rows = sorted(model, key=lambda k: (-common.get(k, 0), k))
    return {k: b" ".join(model[k]) for k in by_rows if any(model[k])}


def compressors(contents: Iterable[bytes]) -> list[zstandard.ZstdCompressor]:
    made = []
    for content in contents:
        d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        how = zstandard.ZstdCompressionParameters(**SEARCH)
        d.precompute_compress(compression_params=how)
        made.append(zstandard.ZstdCompressor(dict_data=d, compression_params=how))
    return made


def sizes(text: bytes, by_lang: list[zstandard.ZstdCompressor]) -> list[int]:
    blocks = [text[i:i + BLOCK] for i in range(0, len(text), BLOCK)]
    return [sum(len(c.compress(b)) for b in blocks) for c in by_lang]


def predict_one(text: bytes | None, langs: list[str], by_lang: list, min_margin: float) -> tuple[str, float, float, bool]:
    if not langs or not text or not any(map(str.isalpha, text.decode("utf-8", "replace"))):
        return "und", 0.0, 0.0, True
    got = sorted(zip(sizes(plain(text), by_lang), range(len(langs))))
    best, at = got[0]
    second = got[1][0] if len(got) > 1 else 2 * best
    margin = 1 - best / second
    return langs[at], second / (best + second), margin, margin < min_margin


def predict(docs: DataFrame, model: dict[str, bytes], keep: list[str], text: str = "text", min_margin: float = 0.005) -> DataFrame:
    """The columns in ``keep`` with ``lang_pred``, ``score`` (0 to 1; 0.5 says
    the runner-up is as small), ``margin`` (share of the runner-up's bytes
    saved) and ``rejected``."""
    bounded_batches(docs.sparkSession)
    given = docs.select(*keep, F.col(text).cast("binary").alias("_text_bytes"))
    schema = T.StructType([given.schema[c] for c in keep] + [T.StructField(n, t()) for n, t in zip(
        RESULTS, (T.StringType, T.DoubleType, T.DoubleType, T.BooleanType))])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs, by_lang = list(model), held_by_worker(compressors, tuple(model.values()))
        for b in batches:
            got = [predict_one(t, langs, by_lang, min_margin) for t in b.column(b.num_columns - 1).to_pylist()]
            results = [pa.array([g[k] for g in got], kind) for k, kind in enumerate((pa.string(), pa.float64(), pa.float64(), pa.bool_()))]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], *results], names=[*keep, *RESULTS])

    return given.mapInArrow(work, schema)


def only_known(docs: DataFrame, model: dict[str, bytes], text: str = "text", min_margin: float = 0.005) -> DataFrame:
    """The documents that are not rejected, with the columns they had."""
    bounded_batches(docs.sparkSession)
    numbered = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    at = docs.columns.index(text)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs, by_lang = list(model), held_by_worker(compressors, tuple(model.values()))
        for b in batches:
            texts = b.column(at).cast(pa.binary()).to_pylist()
            yield b.filter(pa.array([not predict_one(t, langs, by_lang, min_margin)[3] for t in texts], pa.bool_()))

    return numbered.mapInArrow(work, numbered.schema).toDF(*docs.columns)
