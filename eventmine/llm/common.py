"""What several of the operators share."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.hashing import md5_key
from ..session import checkpoint_dir

#: the words of every operator: runs of anything but ASCII white space
WORD = r"[^\x20\x09-\x0D]+"
BLANKS = r"[\x20\x09-\x0D]+"


def bounded_batches(spark: SparkSession) -> None:
    """Python workers get rows by a bounded number of bytes, not by count alone."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "20000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(4 << 20))


#: whether shuffle files go as soon as the action that wrote them ends
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


#: bytes of rows, about, for which a table gets another file
FILE_BYTES = 4 << 20


def files_of(rows: int, row_bytes: int = 1) -> int:
    return max(1, -(-rows * row_bytes // FILE_BYTES))


def cut_lineage(df: DataFrame, rows: int | None = None, row_bytes: int = 64) -> DataFrame:
    """Write the rows to the shared checkpoint folder and go on from there: what
    several branches read is worked out once and survives lost executors. The
    shuffle files behind them go at once, not when the driver happens to
    collect its garbage; so the rows are read through a DataFrame of their own,
    and ``df`` can still be used.

    ``rows``: about how many rows there are at most, and come out of the last
    shuffles, if that is known, of ``row_bytes`` or less. A table much smaller than the shuffle it comes from
    then has as few files as it needs: each one costs a task, and on a local
    folder two processes forked off the executor, which count as large as the
    executor itself until they are on their own."""
    spark = df.sparkSession
    checkpoint_dir(spark)
    if rows is not None:
        df = df.coalesce(files_of(rows, row_bytes))
    before = spark.conf.get(_CLEANUP)
    spark.conf.set(_CLEANUP, "true")
    try:
        return df.select("*").checkpoint(eager=True)
    finally:
        spark.conf.set(_CLEANUP, before)


def utf8(text: str = "text") -> Column:
    """The text's bytes; null counts as empty."""
    return F.coalesce(F.col(text).cast("binary"), F.lit(b""))


def valid_utf8(text: bytes) -> bytes:
    """The text itself if it is UTF-8, else with U+FFFD for what isn't."""
    try:
        text.decode()
        return text
    except UnicodeDecodeError:
        return text.decode("utf-8", "replace").encode()


_held: dict = {}


def held_by_worker(make, *args):
    """``make(*args)``, kept by the worker until it needs another: vocabularies
    and models of earlier stages don't add up in workers that Spark reuses."""
    if (make, args) not in _held:
        _held.clear()
        _held[make, args] = make(*args)
    return _held[make, args]


def hold_nothing() -> None:
    """The worker lets go of what an earlier stage made."""
    _held.clear()


def row_hash(df: DataFrame) -> Column:
    """A hash of the whole row, which also says which columns are null; values
    with parts (arrays, structs, maps) go by their JSON text. Rows that share
    it are taken as equal, so one stands for another."""
    parts = []
    for f in df.schema.fields:
        c = F.col(f.name)
        nested = isinstance(f.dataType, (T.ArrayType, T.StructType, T.MapType, T.VariantType))
        parts += [c.isNull(), F.to_json(F.struct(c), {"ignoreNullFields": "false"}) if nested else c]
    return F.xxhash64(*parts)


def n_words(text: str = "text") -> Column:
    """Number of words: white space at both ends goes, then one more than the
    gaps. No pattern is tried anew at each blank of a long run."""
    trimmed = F.btrim(F.coalesce(F.col(text), F.lit("")), F.lit(" \t\n\x0b\x0c\r"))
    return F.when(F.length(trimmed) == 0, 0).otherwise(F.size(F.split(trimmed, BLANKS))).cast("bigint")


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def random_key(key: str, seed: int) -> Column:
    """A reproducible random string (hex digits) of the key's text; null has its own."""
    return md5_key(F.coalesce(F.col(key).cast("string"), F.lit("")), seed)


def range_buckets(df: DataFrame, order: list[Column], out: str = "_bucket") -> DataFrame:
    """Adds the row's part of the table when it is cut into equal ranges of
    ``order``; equal rows are cut too, so no value of any column makes a part
    larger. Parts come from a sample, so the rows are written before and after."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    given = cut_lineage(df).withColumn("_nth", F.monotonically_increasing_id())
    return cut_lineage(given.repartitionByRange(n, *order, F.col("_nth")).drop("_nth").withColumn(out, F.spark_partition_id()))


def prefix_sums(df: DataFrame, group: list[str], bucket: str, order: list[Column], sums: dict[str, str]) -> DataFrame:
    """Adds, for each name in ``sums``, the sum of its column over the rows of
    the group that come before, in the order of ``bucket`` and then ``order``.

    No group is sorted in one task: rows are summed inside their bucket, and
    only one row per bucket meets in the group's window."""
    inside = Window.partitionBy(*group, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    across = Window.partitionBy(*group).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    of_bucket = df.groupBy(*group, bucket).agg(*[F.sum(c).alias(f"_b_{n}") for n, c in sums.items()])
    before = of_bucket.select(
        *[F.col(g).alias(f"_g_{g}") for g in group], F.col(bucket).alias("_g_bucket"),
        *[F.coalesce(F.sum(f"_b_{n}").over(across), F.lit(0)).alias(f"_o_{n}") for n in sums])
    here = df.select("*", *[F.coalesce(F.sum(c).over(inside), F.lit(0)).alias(f"_i_{n}") for n, c in sums.items()])
    on = here[bucket] == before["_g_bucket"]
    for g in group:
        on = on & here[g].eqNullSafe(before[f"_g_{g}"])
    return here.join(before, on).select(*df.columns, *[(F.col(f"_o_{n}") + F.col(f"_i_{n}")).alias(n) for n in sums])


def whole_groups(batches: Iterator[pa.RecordBatch], n_keys: int) -> Iterator[pa.Table]:
    """Batches of rows sorted by their first columns, cut so that no group is
    in two of them."""
    rest: pa.Table | None = None
    for b in batches:
        if not b.num_rows:
            continue
        rows = pa.Table.from_batches([b])
        rows = pa.concat_tables([rest, rows]) if rest is not None else rows
        last = [rows.column(c)[rows.num_rows - 1].as_py() for c in range(n_keys)]
        same = np.ones(rows.num_rows, bool)
        for c in range(n_keys):
            same &= rows.column(c).to_numpy() == last[c]
        at = rows.num_rows - int(same.sum())
        if at:
            yield rows.slice(0, at)
        rest = rows.slice(at)
    if rest is not None:
        yield rest
