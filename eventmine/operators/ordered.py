"""Per-key and global ordered scans that never put one whole key in one task.

A plain ``Window.partitionBy(user)`` sends every row of a user to one task; a
bot or a house account holding a third of the rows makes that task a third of
the job, and an unpartitioned window sends *everything* to one task. The
helpers here split the order into buckets and stitch neighbouring buckets:

* two-level scans (lag, carry-forward, running sums): compute inside each
  ``(key, time bucket)``, summarise each bucket to one row, scan the small
  summary per key, join the offsets back on the keys the big side is already
  partitioned by (only the summary moves);
* range buckets: the whole order (key, time, id) or (value, tiebreak) cut into
  equal parts, fixed by a checkpoint, so that neither a hot key nor a tied
  value is one task; offsets come from a summary of one row per part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.timefn import duration_us, floor_div, micros

BUCKET = "_bkt"
TS_US = "_ts_us"


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _cols(c) -> list:
    return [c] if isinstance(c, (str, Column)) else list(c)


def with_time_bucket(df: DataFrame, ts_col: str, bucket: str | int) -> DataFrame:
    """Add ``_ts_us`` (epoch micros of ``ts_col``) and ``_bkt`` (its bucket)."""
    b = duration_us(bucket)
    return (df.withColumn(TS_US, micros(ts_col))
              .withColumn(BUCKET, floor_div(F.col(TS_US), b)))


def with_range_bucket(df: DataFrame, keys, ts_col: str, order) -> DataFrame:
    """Add ``_ts_us`` and ``_bkt``: the row's part of the whole table when it
    is cut into equal ranges of (keys, time, order). A key that holds a third
    of the rows spans a third of the parts, be they all in one day or at one
    instant. The parts are found by sampling, so the rows are written to the
    shared checkpoint folder once, with their number; rows without a time
    have no part, as with :func:`with_time_bucket`."""
    from ..session import checkpoint_dir

    spark = df.sparkSession
    checkpoint_dir(spark)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    df = df.withColumn(TS_US, micros(ts_col))
    by = [_col(c) for c in [*_cols(keys), TS_US, *_cols(order)]]
    return (df.repartitionByRange(n, *by)
              .withColumn(BUCKET, F.when(F.col(TS_US).isNotNull(), F.spark_partition_id().cast("bigint")))
              .checkpoint(eager=True))


def in_ranges(df: DataFrame, order, bucket_col: str = BUCKET) -> DataFrame:
    """Adds the row's part when the table is cut into equal ranges of
    ``order``; rows that agree in it stay together. Written to the shared
    checkpoint folder once, so a part stays what it is."""
    from ..session import checkpoint_dir

    spark = df.sparkSession
    checkpoint_dir(spark)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return df.repartitionByRange(n, *[_col(c) for c in _cols(order)]).withColumn(bucket_col, F.spark_partition_id().cast("bigint")).checkpoint(eager=True)


def with_bucket(df: DataFrame, keys, ts_col: str, order, bucket: str | int | None) -> DataFrame:
    """Time buckets of width ``bucket``, or range buckets if it is None."""
    return with_range_bucket(df, keys, ts_col, order) if bucket is None else with_time_bucket(df, ts_col, bucket)


def lag_across_buckets(df: DataFrame, keys, order, values: dict, bucket_col: str = BUCKET
                       ) -> DataFrame:
    """Add, per row, the ``values`` (name → column) of the previous row of its
    key in ``order``; NULL on a key's first row and on rows whose key or
    bucket is NULL (they have no place in an order). ``order`` must be total
    within a key and consistent with the bucket (bucket = function of its
    lead column).
    """
    keys, order = _cols(keys), [_col(o) for o in _cols(order)]
    payload = F.struct(*[_col(v).alias(n) for n, v in values.items()])
    w = Window.partitionBy(*keys, bucket_col).orderBy(*order)
    inner = df.withColumn("_lag_in", F.lag(payload).over(w))
    summary = (inner.groupBy(*keys, bucket_col)
                    .agg(F.max_by(payload, F.struct(*order)).alias("_last")))
    ws = Window.partitionBy(*keys).orderBy(bucket_col)
    summary = summary.select(*keys, bucket_col, F.lag("_last").over(ws).alias("_lag_prev"))
    keyed = F.lit(True)
    for k in [*keys, bucket_col]:
        keyed = keyed & F.col(k).isNotNull()
    prev = F.when(keyed, F.coalesce(F.col("_lag_in"), F.col("_lag_prev")))
    return (inner.join(summary, [*keys, bucket_col], "left")
                 .select(*df.columns, *[prev[n].alias(n) for n in values]))


def carry_last_across_buckets(df: DataFrame, keys, order, value: Column, out: str,
                              include_current: bool = True, bucket_col: str = BUCKET
                              ) -> DataFrame:
    """Add ``out``: the last non-NULL ``value`` at (or strictly before, when
    ``include_current`` is False) each row, in ``order`` within its key; NULL
    for rows whose key or bucket is NULL."""
    keys, order = _cols(keys), [_col(o) for o in _cols(order)]
    w = (Window.partitionBy(*keys, bucket_col).orderBy(*order)
         .rowsBetween(Window.unboundedPreceding, 0 if include_current else -1))
    inner = df.withColumn("_carry_in", F.last(value, ignorenulls=True).over(w))
    tagged = F.when(value.isNotNull(), F.struct(F.struct(*order).alias("o"), value.alias("v")))
    summary = inner.groupBy(*keys, bucket_col).agg(F.max(tagged).alias("_bl"))
    ws = (Window.partitionBy(*keys).orderBy(bucket_col)
          .rowsBetween(Window.unboundedPreceding, -1))
    summary = summary.select(*keys, bucket_col,
                             F.last(F.col("_bl.v"), ignorenulls=True).over(ws).alias("_carry_prev"))
    keyed = F.lit(True)
    for k in [*keys, bucket_col]:
        keyed = keyed & F.col(k).isNotNull()
    return (inner.join(summary, [*keys, bucket_col], "left")
                 .select(*df.columns,
                         F.when(keyed, F.coalesce("_carry_in", "_carry_prev")).alias(out)))


def running_sum_across_buckets(df: DataFrame, keys, order, sums: dict, bucket_col: str = BUCKET
                               ) -> DataFrame:
    """Add inclusive running sums (name → column) in ``order`` within each
    key; NULL for rows whose key or bucket is NULL."""
    keys, order = _cols(keys), [_col(o) for o in _cols(order)]
    w = (Window.partitionBy(*keys, bucket_col).orderBy(*order)
         .rowsBetween(Window.unboundedPreceding, 0))
    inner = df.select("*", *[F.sum(_col(v)).over(w).alias(f"_rs_{n}") for n, v in sums.items()])
    summary = inner.groupBy(*keys, bucket_col).agg(
        *[F.sum(_col(v)).alias(f"_tot_{n}") for n, v in sums.items()])
    ws = (Window.partitionBy(*keys).orderBy(bucket_col)
          .rowsBetween(Window.unboundedPreceding, -1))
    summary = summary.select(*keys, bucket_col, *[
        F.coalesce(F.sum(f"_tot_{n}").over(ws), F.lit(0)).alias(f"_off_{n}") for n in sums])
    return (inner.join(summary, [*keys, bucket_col], "left")
                 .select(*df.columns,
                         *[(F.col(f"_rs_{n}") + F.col(f"_off_{n}")).alias(n) for n in sums]))
    # (NULL keys find no summary row in the equi-join, so _off is NULL there)


def _in_order(df: DataFrame, order: list[Column], n: int) -> DataFrame:
    """``df`` cut into ``n`` ranges of ``order`` and sorted inside: ``_gb`` is
    a row's range, ``_rn`` its place there (from 1). Written to the shared
    checkpoint folder once, so neither changes when a part is worked out again."""
    from ..session import checkpoint_dir

    checkpoint_dir(df.sparkSession)
    ranged = (df.repartitionByRange(n, *order).sortWithinPartitions(*order)
                .withColumn("_ix", F.monotonically_increasing_id()).checkpoint(eager=True))
    return ranged.select(*df.columns, F.shiftright("_ix", 33).alias("_gb"),
                         (F.col("_ix").bitwiseAND((1 << 33) - 1) + 1).alias("_rn"))


def global_positions(df: DataFrame, value: str, tiebreak: list[str], out: str = "pos",
                     descending: bool = False, n_buckets: int | None = None,
                     sums: dict | None = None, totals: bool = False) -> DataFrame:
    """1-based position of each row in the global order
    ``(value [desc], *tiebreak)``, without a single-task window.

    Rows are cut into ``n_buckets`` equal ranges of the whole order, so rows
    of one value are split by the tiebreak; NULL and NaN stand where Spark's
    order puts them. The position inside a range and the counts of the ranges
    before add up. ``sums`` (name → column) adds inclusive running sums in the
    same order; ``totals`` adds the grand totals (``<out>_total`` rows,
    ``total_<name>`` per sum). The summary has ``n_buckets`` rows and is
    broadcast; the default, ``max(64, 4 x default parallelism)``, shrinks
    ranges as the cluster grows. The input is written to the shared checkpoint
    folder once and read from there."""
    sums = sums or {}
    if n_buckets is None:
        n_buckets = max(64, 4 * df.sparkSession.sparkContext.defaultParallelism)
    val = F.col(value).desc() if descending else F.col(value).asc()
    placed = _in_order(df, [val, *[F.col(c).asc() for c in tiebreak]], n_buckets)
    wr = Window.partitionBy("_gb").orderBy("_rn").rowsBetween(Window.unboundedPreceding, 0)
    inner = placed.select("*", *[F.sum(_col(v)).over(wr).alias(f"_rs_{n}") for n, v in sums.items()])
    summary = placed.groupBy("_gb").agg(F.count(F.lit(1)).alias("_cnt"),
                                        *[F.sum(_col(v)).alias(f"_tot_{n}") for n, v in sums.items()])
    # One row per range: unpartitioned windows here touch n_buckets rows.
    wo = Window.orderBy("_gb").rowsBetween(Window.unboundedPreceding, -1)
    wall = Window.orderBy("_gb").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    extra = []
    if totals:
        extra = [F.sum("_cnt").over(wall).cast("bigint").alias(f"{out}_total"),
                 *[F.sum(f"_tot_{n}").over(wall).alias(f"total_{n}") for n in sums]]
    summary = summary.select(
        "_gb", F.coalesce(F.sum("_cnt").over(wo), F.lit(0)).alias("_off"),
        *[F.coalesce(F.sum(f"_tot_{n}").over(wo), F.lit(0)).alias(f"_off_{n}") for n in sums],
        *extra)
    res = inner.join(F.broadcast(summary), "_gb")
    keep_totals = [f"{out}_total", *[f"total_{n}" for n in sums]] if totals else []
    return res.select(*df.columns, (F.col("_off") + F.col("_rn")).cast("bigint").alias(out),
                      *[(F.col(f"_rs_{n}") + F.col(f"_off_{n}")).alias(n) for n in sums],
                      *keep_totals)


def positions_of_each(df: DataFrame, key: str, metrics: dict, n_buckets: int | None = None) -> DataFrame:
    """1-based position of each row in several global orders at once, one per
    entry of ``metrics`` (numeric column → descending?), ties by ``key``, which
    names each row. Gives ``key``, the metrics, ``_pos_<metric>`` and ``_total``.

    Each row is turned into one narrow row per metric and all of them are cut
    into ``n_buckets`` equal ranges of (metric, value, key) in one pass: one
    write to the checkpoint folder and one sort, however many orders there are.
    A range's first place is taken off inside it and the counts of the ranges
    before are added; the summary has at most ``n_buckets`` plus one row per
    metric and is broadcast. Metrics are compared as doubles; NULL and NaN stand
    where Spark's order puts them."""
    if n_buckets is None:
        n_buckets = max(64, 4 * df.sparkSession.sparkContext.defaultParallelism)
    number = F.lit(None).cast("double")
    long = df.select(key, F.inline(F.array(*[F.struct(
        F.lit(i).alias("_metric"),
        (number if falls else F.col(m).cast("double")).alias("_up"),
        (F.col(m).cast("double") if falls else number).alias("_down"))
        for i, (m, falls) in enumerate(metrics.items())])))
    placed = _in_order(long, [F.col("_metric"), F.col("_up").asc(), F.col("_down").desc(), F.col(key).asc()], n_buckets)
    # One row per (metric, range): the window touches about n_buckets rows.
    wm = Window.partitionBy("_metric")
    summary = placed.groupBy("_metric", "_gb").agg(F.count(F.lit(1)).alias("_cnt"), F.min("_rn").alias("_first")).select(
        "_metric", "_gb",
        (F.coalesce(F.sum("_cnt").over(wm.orderBy("_gb").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
         - F.col("_first") + 1).alias("_off"),
        F.sum("_cnt").over(wm).alias("_total"))
    at = placed.join(F.broadcast(summary), ["_metric", "_gb"])
    value = F.coalesce("_up", "_down")
    aggs = [F.max("_total").cast("bigint").alias("_total")]
    for i, m in enumerate(metrics):
        here = F.col("_metric") == i
        aggs += [F.max(F.when(here, value)).cast(df.schema[m].dataType).alias(m),
                 F.max(F.when(here, F.col("_off") + F.col("_rn"))).cast("bigint").alias(f"_pos_{m}")]
    return at.groupBy(key).agg(*aggs)


def keyed_quantiles(df: DataFrame, keys, value: str, probs: dict, mean: str | None = None) -> DataFrame:
    """Exact interpolated quantiles of ``value`` per key (the definition of
    Spark ``percentile`` / SQL ``quantile_cont``), one column per entry of
    ``probs`` (name → probability), plus ``n`` and, if named, the ``mean``.

    No key's values are gathered in one buffer: values are counted per
    (key, value) first, the counts are cut into equal ranges of (key, value),
    so a key's values spread over as many tasks as they are worth however
    close together they lie, and only the at most two rows per quantile that
    hold the needed ranks are kept."""
    keys = _cols(keys)
    v = F.col(value)
    freq = df.where(v.isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_f"))
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    freq = _in_order(freq, [*[F.col(k) for k in keys], v], n)
    w = (Window.partitionBy(*keys, "_gb").orderBy("_rn")
         .rowsBetween(Window.unboundedPreceding, 0))
    inner = freq.withColumn("_cum_in", F.sum("_f").over(w))
    summ = freq.groupBy(*keys, "_gb").agg(F.sum("_f").alias("_tot"), F.sum(v * F.col("_f")).alias("_vtot"))
    wk = Window.partitionBy(*keys).orderBy("_gb")
    every = Window.partitionBy(*keys)
    summ = summ.select(*keys, "_gb",
                       F.coalesce(F.sum("_tot").over(wk.rowsBetween(Window.unboundedPreceding, -1)),
                                  F.lit(0)).alias("_off"),
                       F.sum("_tot").over(every).alias("n"), (F.sum("_vtot").over(every) / F.sum("_tot").over(every)).alias("_avg"))
    j = inner.join(summ, [*keys, "_gb"], "left")
    cum = F.col("_off") + F.col("_cum_in")
    before = cum - F.col("_f")
    hit_any = F.lit(False)
    aggs = [F.max("n").alias("n"), F.max("_avg").alias("_avg")]
    for name, p in probs.items():
        pos = F.lit(float(p)) * (F.col("n") - 1)
        lo, hi = F.floor(pos), F.ceil(pos)
        has_lo = (before <= lo) & (lo < cum)
        has_hi = (before <= hi) & (hi < cum)
        hit_any = hit_any | has_lo | has_hi
        j = (j.withColumn(f"_lo_{name}", F.when(has_lo, v))
              .withColumn(f"_hi_{name}", F.when(has_hi, v))
              .withColumn(f"_fr_{name}", pos - lo))
        aggs += [F.max(f"_lo_{name}").alias(f"_lo_{name}"), F.max(f"_hi_{name}").alias(f"_hi_{name}"),
                 F.max(f"_fr_{name}").alias(f"_fr_{name}")]
    picked = j.where(hit_any).groupBy(*keys).agg(*aggs)
    outs = []
    for name in probs:
        lo_v, hi_v, fr = F.col(f"_lo_{name}"), F.col(f"_hi_{name}"), F.col(f"_fr_{name}")
        outs.append((lo_v + (hi_v - lo_v) * fr).alias(name))
    return picked.select(*keys, "n", *outs, *([F.col("_avg").alias(mean)] if mean else []))
