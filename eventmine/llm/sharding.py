"""Sharding by proportional stratified interleaving.

The rows of each source are ranked in a seeded random order, each rank becomes
a fraction of its source, and the rows of all sources are put in one order by
that fraction. Any stretch of that order holds the sources in their
proportions, so cutting it into equal numbers of rows gives shards that match
the mixture (law ``rows``: counts at most one apart).

Neither order is sorted in one task: each is cut into equal ranges, rows are
ranked inside a range and the counts of the ranges before are added. Neither a
source with a third of the rows nor a third of rows with one id, nor thousands
of sources that all have a row at the same fraction, make a range larger.

Cases: null sources are one stratum; null texts have no bytes and checksum 0;
rows with equal ids and texts may swap places (they can't be told apart);
extra columns are ignored; an empty table gives no rows; more shards than
rows leaves shards empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import prefix_sums, random_key, range_buckets, utf8


def shard(docs: DataFrame, n_shards: int = 40, seed: int = 17, key: str = "doc_id", text: str = "text",
          source: str = "source") -> DataFrame:
    """Per row: the key, ``size`` (bytes of the text plus 16), ``text_crc32``,
    ``source``, ``law``, ``shard``, ``slot`` and ``grown_shard`` (null: under
    this law one more shard deals all rows anew)."""
    inside = [F.col(c) for c in ("_random", "text_crc32", "size")]
    rows = range_buckets(docs.select(
        F.col(key).alias("_id"), (F.length(utf8(text)) + 16).cast("bigint").alias("size"), F.crc32(utf8(text)).alias("text_crc32"),
        F.col(source).alias("_source"), F.lit(1).cast("bigint").alias("_one"),
        random_key(key, seed).alias("_random")), [F.col("_source"), *inside])
    totals = rows.groupBy("_source").agg(F.count(F.lit(1)).alias("_rows"))
    n = rows.count()
    dealt = prefix_sums(rows, ["_source"], "_bucket", inside, {"_rank": "_one"}).drop("_bucket")
    totals = totals.withColumnRenamed("_source", "_of")
    fraction = (2 * F.col("_rank") + 1) / (2.0 * F.col("_rows"))
    placed = dealt.join(totals, dealt["_source"].eqNullSafe(totals["_of"])).drop("_of").withColumn("_fraction", fraction)
    order = [F.col(c) for c in ("_fraction", "_source", "_rank")]
    placed = prefix_sums(range_buckets(placed, order), [], "_bucket", order, {"_place": "_one"})
    # shard s holds the places from ceil(s * n / n_shards) on
    first = F.expr(f"(cast(shard as bigint) * {n} + {n_shards - 1}) div {n_shards}")
    return (placed.withColumn("shard", F.expr(f"cast((_place * {n_shards}) div {max(n, 1)} as int)"))
            .select(F.col("_id").alias(key), "size", "text_crc32", F.lit("rows").alias("law"), "shard",
                    (F.col("_place") - first).alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
                    F.col("_source").alias("source")))
