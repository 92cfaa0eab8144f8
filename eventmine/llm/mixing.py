"""Mixing sources to target weights.

Every document gets a hash-random key; the keys put each source's documents
in a random order, and distributed prefix sums of their sizes over equal ranges
of that order cut it at the source's exact budget. A budget above the source's size takes the
whole source once or more (epochs) and then cuts.

Budgets share the corpus's total size by weight. None goes beyond
``max_epochs`` times its source's size; the excess is shared again by weight
among the rest until none is above. That is the level ``x`` at which the
budgets ``min(weight * x, cap)`` sum to the total: sources are ordered by
cap / weight, and prefix sums over them (one row per source) give ``x``.

The document in which a budget ends is cut there, so at most one per source.

Cases: null texts and texts without words have size 0 and are never taken;
null sources are one source, the last in order; repeated rows are separate
documents (equal rows may swap places); extra columns are ignored by
:func:`budgets` and kept by :func:`mix`; an empty table gives no rows; a
corpus without words takes nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.sizing import bounded_broadcast
from .common import WORD, cut_lineage, n_words, prefix_sums, random_key, range_buckets, row_hash

WEIGHTS = (5.0, 2.0, 1.0)


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, max_epochs: float = 3.0) -> DataFrame:
    """From rows (source, size): per source ``source_size`` and ``target``.
    Weights go to the sources in code point order, null last, and repeat."""
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    # windows over one row per source from here on
    nth = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*map(F.lit, weights)), (nth % len(weights) + 1).cast("int"))
    per = per.withColumn("weight", weight).withColumn("_cap", F.col("source_size") * F.lit(float(max_epochs)))
    by_need = Window.orderBy(F.col("_cap") / F.col("weight"), F.col("source").asc_nulls_last())
    everything = Window.partitionBy()
    level = ((F.sum("source_size").over(everything)
              - F.coalesce(F.sum("_cap").over(by_need.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
             / F.sum("weight").over(by_need.rowsBetween(0, Window.unboundedFollowing)))
    per = per.withColumn("_level", level)
    open_ = F.col("_cap") / F.col("weight") > F.col("_level")
    final = F.min(F.when(open_, F.struct(F.col("_cap") / F.col("weight"), F.col("_level").alias("x")))).over(everything)["x"]
    return per.select("source", "source_size", F.least(F.col("_cap"), F.col("weight") * F.coalesce(final, F.lit(float("inf")))).alias("target"))


def budgets(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, max_epochs: float = 3.0, seed: int = 17,
            key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """Per row: the key, ``size``, ``source_size``, ``target`` (its source's),
    ``taken`` (words the mix takes, over all epochs) and ``source``."""
    taken = _taken(docs, weights, max_epochs, seed, key, text, source, F.lit(0))
    return taken.select(F.col("_id").alias(key), "size", "source_size", "target", "taken", "source")


def _taken(docs: DataFrame, weights: tuple[float, ...], max_epochs: float, seed: int, key: str, text: str, source: str, row: Column) -> DataFrame:
    order = [F.col(c) for c in ("_random", "size", "_row")]
    rows = range_buckets(docs.select(
        F.col(key).alias("_id"), F.col(source).alias("source"), n_words(text).alias("size"),
        random_key(key, seed).alias("_random"), row.alias("_row")), [F.col("source"), *order])
    targets = source_targets(rows, weights, max_epochs).withColumnRenamed("source", "_of")
    placed = prefix_sums(rows, ["source"], "_bucket", order, {"_before": "size"})
    epochs = F.floor(F.try_divide(F.col("target"), F.col("source_size").cast("double")))
    rest = F.round(F.col("target") - epochs * F.col("source_size")).cast("bigint")
    taken = F.when(F.col("size") > 0, epochs * F.col("size") + F.greatest(F.lit(0), F.least(F.col("size"), rest - F.col("_before"))))
    return placed.join(targets, placed["source"].eqNullSafe(targets["_of"])).select(
        "_id", "_row", "size", "source_size", "target", F.coalesce(taken, F.lit(0)).cast("bigint").alias("taken"), "source")


def mix(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[float, ...] = WEIGHTS,
        max_epochs: float = 3.0, seed: int = 17) -> DataFrame:
    """The mixed documents with the columns they had: each row as often as it
    is taken whole, and the one in which a source's budget ends up to there.
    Rows that share a key are told apart by a hash of the row; equal rows
    follow each other in the order, and one of them stands for all."""
    names = [f"c{k}" for k in range(len(docs.columns))]
    given = docs.toDF(*names)
    at, body, of = (names[docs.columns.index(c)] for c in (key, text, source))
    marked = given.withColumn("_row", row_hash(given))
    taken = _taken(given, weights, max_epochs, seed, at, body, of, row_hash(given))
    taken = taken.groupBy("_id", "_row").agg(F.sum("taken").alias("_taken"), F.first("size").alias("_size"), F.count(F.lit(1)).alias("_rows"))
    taken = cut_lineage(taken.where(F.col("_taken") > 0).withColumnRenamed("_row", "_is"), given.count())
    whole, part = F.expr("_taken div _size").cast("int"), (F.col("_taken") % F.col("_size")).cast("int")
    words = F.concat(F.array_repeat(F.lit(-1), whole), F.when(part > 0, F.array(part)).otherwise(F.array().cast("array<int>")))

    def same(rows: DataFrame, these: DataFrame):
        return rows["_row"].eqNullSafe(these["_is"]) & rows[at].eqNullSafe(these["_id"])

    def joined(rows: DataFrame, these: DataFrame) -> DataFrame:
        return rows.join(these, same(rows, these)).withColumn("_words", F.explode(words))

    kept = joined(marked, bounded_broadcast(taken.where("_rows = 1"), 1_000_000))
    several = taken.where("_rows > 1")
    if not several.isEmpty():
        several = bounded_broadcast(several, 1_000_000)
        once = marked.join(several, same(marked, several), "left_semi").dropDuplicates([at, "_row"])
        kept = kept.unionAll(joined(once, several))
    # for the cut ones: the words up to there, each with the white space before it
    gaps, found = F.split(F.col(body), WORD), F.regexp_extract_all(F.col(body), F.lit(WORD), F.lit(0))
    cut = F.array_join(F.zip_with(F.slice(gaps, 1, F.col("_words")), F.slice(found, 1, F.col("_words")), lambda g, w: F.concat(g, w)), "")
    return kept.select(*[F.when(F.col("_words") >= 0, cut).otherwise(F.col(c)).alias(c) if c == body else c for c in names]).toDF(*docs.columns)
