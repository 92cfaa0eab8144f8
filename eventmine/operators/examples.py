"""Examples and features at cutoff dates.

Cutoffs are a short, sorted list of TIMESTAMP_NTZ strings (a parameter, not
data). Events without a user belong to no example: P15, P16 and the flagship
leave them out. Features and labels are computed without a range join: each event is
tagged with the index of the first cutoff after it, the event log is reduced
to one row per (user, day, segment) by a partially-aggregated ``groupBy``, and
only those small rows are fanned out to the cutoffs they precede.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.hashing import md5_bucket, md5_key
from ..functions.sizing import bounded_broadcast
from ..functions.timefn import duration_us, micros, ntz_array, ntz_literal
from ..session import checkpoint_dir
from .ordered import TS_US, carry_last_across_buckets, with_bucket

# The event vocabulary of the event log.
EVENT_TYPES = ["click", "error", "purchase", "signup", "view"]


def _segment(ts: Column, cutoffs: list[str]) -> Column:
    """Number of cutoffs at or before ``ts``: the event precedes cutoffs
    ``seg .. len(cutoffs)-1``. A sum of comparisons, so it stays inside
    whole-stage codegen (no higher-order function per event)."""
    seg = F.lit(0)
    for c in cutoffs:
        seg = seg + (ts >= ntz_literal(c)).cast("int")
    return seg


def _cutoff_at(idx: Column, cutoffs: list[str]) -> Column:
    return F.element_at(ntz_array(cutoffs), idx + 1)


def _per_day(events: DataFrame, cutoffs: list[str], event_types: list[str],
             until=None, hits: Column | None = None) -> DataFrame:
    """Level 1: one row per (user, day, segment) — partial aggregation
    collapses hot users map-side. ``until`` bounds the scan (pushed to the
    reader); ``hits`` (an array of label-window indexes per event) is kept as
    the group's distinct indexes (at most one per cutoff)."""
    last = until if until is not None else ntz_literal(cutoffs[-1])
    ev = (events.where((F.col("ts") < last) & F.col("user_id").isNotNull())
                .select("user_id", "ts", "event_type", "value")
                .withColumn("seg", _segment(F.col("ts"), cutoffs))
                .withColumn("day", F.to_date("ts")))
    return ev.groupBy("user_id", "day", "seg").agg(
        F.count(F.lit(1)).alias("n_events"),
        *[F.count_if(F.col("event_type") == t).alias(f"n_{t}") for t in event_types],
        F.sum(F.col("value").cast("decimal(18,2)")).alias("value_sum"),
        F.max("ts").alias("last_ts"),
        *([F.array_distinct(F.flatten(F.collect_set(hits))).alias("_hits")]
          if hits is not None else []))


def _features_from_per_day(per_day: DataFrame, cutoffs: list[str], event_types: list[str]
                           ) -> DataFrame:
    """Level 2: running sums over each user's segments. Rows of segment s
    count for every cutoff from s on, so the per-(user, segment) totals are
    summed cumulatively (a window over at most len(cutoffs) rows per user)
    and each cumulative row is expanded to the cutoffs up to the user's next
    segment: every (user, cutoff) output row is produced once."""
    n = len(cutoffs)
    seg = F.col("seg")
    # A day is active before cutoff i from the first segment it appears in.
    first_seg = F.min("seg").over(Window.partitionBy("user_id", "day"))
    per_day = per_day.withColumn("new_day", (seg == first_seg).cast("int")).where(seg < n)
    count_cols = ["n_events"] + [f"n_{t}" for t in event_types]
    per_seg = per_day.groupBy("user_id", "seg").agg(
        *[F.sum(c).alias(c) for c in count_cols],
        F.sum("value_sum").alias("value_sum"),
        F.max("last_ts").alias("last_ts"),
        F.sum("new_day").alias("active_days"))
    wu = Window.partitionBy("user_id").orderBy("seg")
    run = wu.rowsBetween(Window.unboundedPreceding, 0)
    cum = per_seg.select(
        "user_id", "seg",
        *[F.sum(c).over(run).cast("bigint").alias(c) for c in count_cols],
        F.sum("value_sum").over(run).cast("double").alias("value_sum"),
        F.max("last_ts").over(run).alias("last_ts"),
        F.sum("active_days").over(run).cast("bigint").alias("active_days"),
        F.lead("seg").over(wu).alias("_next"))
    upto = F.coalesce(F.col("_next"), F.lit(n)) - 1
    out = cum.withColumn("ci", F.explode(F.sequence(seg, upto)))
    cutoff = _cutoff_at(F.col("ci"), cutoffs)
    return out.select(
        "user_id", "ci", cutoff.alias("cutoff"), *count_cols, "value_sum",
        ((micros(cutoff) - micros("last_ts")) / F.lit(1e6)).alias("recency_s"),
        "active_days")


def features_at_cutoff(events: DataFrame, cutoffs: list[str],
                       event_types: list[str] = EVENT_TYPES) -> DataFrame:
    """P16. One row per (user seen before the cutoff, cutoff), from events with
    ``ts < cutoff`` only: counts per event type, value sum, seconds since the
    last event, distinct active days."""
    cutoffs = sorted(cutoffs)
    per_day = _per_day(events, cutoffs, event_types)
    return _features_from_per_day(per_day, cutoffs, event_types).drop("ci")


def _hit_windows(cutoffs: list[str], h: int, positive_type: str) -> Column:
    """Indexes j of the label windows [c_j, c_j + h) holding a positive event
    (cutoffs in (ts - h, ts]); NULL for other events."""
    ts = F.col("ts")
    back = F.timestamp_add("MICROSECOND", F.lit(-h), ts)
    lo, hi = _segment(back, cutoffs), _segment(ts, cutoffs) - 1
    return F.when((F.col("event_type") == positive_type) & (hi >= lo), F.sequence(lo, hi))


def label_examples(events: DataFrame, cutoffs: list[str], horizon: str = "1d",
                   positive_type: str = "purchase") -> DataFrame:
    """P15. One row per (user seen before the cutoff, cutoff); ``label`` is 1
    iff the user has a ``positive_type`` event in ``[cutoff, cutoff + horizon)``.

    One pass, one ``groupBy(user_id)``: each positive event is exploded to the
    indexes of the label windows holding it (cutoffs in ``(ts - h, ts]``, a
    handful), and the user keeps its first event time and the set of hit
    indexes (at most one entry per cutoff, combined map-side). Examples are
    then the cutoffs after the user's first event."""
    cutoffs = sorted(cutoffs)
    n = len(cutoffs)
    h = duration_us(horizon)
    ts = F.col("ts")
    hit_idx = _hit_windows(cutoffs, h, positive_type)
    until = F.timestamp_add("MICROSECOND", F.lit(h), ntz_literal(cutoffs[-1]))
    per_user = (events.where((ts < until) & F.col("user_id").isNotNull())
                      .select("user_id", "ts", F.explode_outer(hit_idx).alias("_j"))
                      .groupBy("user_id")
                      .agg(F.min("ts").alias("first_ts"), F.collect_set("_j").alias("_hits")))
    start_j = _segment(F.col("first_ts"), cutoffs)
    ex = per_user.where(start_j < n).select(
        "user_id", "_hits", F.explode(F.sequence(start_j, F.lit(n - 1))).alias("_ci"))
    cutoff = _cutoff_at(F.col("_ci"), cutoffs)
    return ex.select("user_id", cutoff.alias("cutoff"),
                     F.array_contains("_hits", F.col("_ci")).cast("int").alias("label"))


def examples_with_features(events: DataFrame, cutoffs: list[str], horizon: str = "1d",
                           event_types: list[str] = EVENT_TYPES,
                           positive_type: str = "purchase") -> DataFrame:
    """Features (P16) joined to labels (P15) on (user_id, cutoff), from one
    scan of the event log: the (user, day, segment) reduction also carries the
    label windows its positive events fall in (a few indexes per row), and is
    checkpointed once for the feature and label branches."""
    cutoffs = sorted(cutoffs)
    h = duration_us(horizon)
    until = F.timestamp_add("MICROSECOND", F.lit(h), ntz_literal(cutoffs[-1]))
    per_day = _per_day(events, cutoffs, event_types, until=until,
                       hits=_hit_windows(cutoffs, h, positive_type))
    # features and labels both read the (much smaller) per-day table: write it
    # once instead of scanning the event log per branch
    checkpoint_dir(per_day.sparkSession)
    per_day = per_day.checkpoint(eager=True)
    feats = _features_from_per_day(per_day, cutoffs, event_types)
    hit = (per_day.select("user_id", F.explode("_hits").alias("ci")).distinct()
                  .withColumn("label", F.lit(1)))
    return (feats.join(hit, ["user_id", "ci"], "left")
                 .select(*[c for c in feats.columns if c != "ci"],
                         F.coalesce(F.col("label"), F.lit(0)).cast("int").alias("label")))


def as_of_join(left: DataFrame, right: DataFrame, by: str, left_ts: str, right_ts: str,
               right_id: str, right_cols: list[str], strict: bool = False,
               bucket: str | None = None, prefix: str = "r_") -> DataFrame:
    """P14. Each left row gets the latest right row with the same ``by`` at or
    before its time (strictly before if ``strict``); NULL if none. Among right
    rows with equal time the largest ``right_id`` wins; a NULL key matches
    nothing.

    Both sides are unioned with a side flag and ordered by
    (time, side, id): at equal times right rows sort before left rows unless
    ``strict``. The carry-forward runs per (key, time bucket) with the
    bucket-to-bucket hand-over in :func:`carry_last_across_buckets`, so one
    busy key does not become one task."""
    right_side = 0 if not strict else 2
    right = right.where(F.col(by).isNotNull())  # a NULL key matches nothing
    payload_cols = [right_id, right_ts, *[c for c in right_cols if c not in (right_id, right_ts)]]
    l = left.select(F.col(by).alias("_k"), F.col(left_ts).alias("_t"), F.lit(1).alias("_side"),
                    F.lit(None).cast("long").alias("_rid"),
                    F.struct(*[F.col(c) for c in left.columns]).alias("_l"),
                    F.lit(None).cast(right.select(F.struct(*payload_cols)).schema[0].dataType)
                    .alias("_r"))
    r = right.select(F.col(by).alias("_k"), F.col(right_ts).alias("_t"),
                     F.lit(right_side).alias("_side"), F.col(right_id).cast("long").alias("_rid"),
                     F.lit(None).cast(left.select(F.struct(*left.columns)).schema[0].dataType)
                     .alias("_l"),
                     F.struct(*payload_cols).alias("_r"))
    u = with_bucket(l.unionByName(r), "_k", "_t", ["_side", "_rid"], bucket)
    carried = carry_last_across_buckets(
        u, "_k", [TS_US, "_side", "_rid"], F.col("_r"), "_match", include_current=True)
    out = carried.where(F.col("_side") == 1)
    return out.select(*[F.col(f"_l.{c}").alias(c) for c in left.columns],
                      *[F.col(f"_match.{c}").alias(prefix + c) for c in payload_cols])


def split_examples(examples: DataFrame, by: str = "hash", key: str = "user_id",
                   n_buckets: int = 10, valid: int = 1, test: int = 1,
                   test_cutoff: str | None = None, valid_cutoff: str | None = None,
                   horizon: str = "0s") -> DataFrame:
    """P17. Add ``split`` ∈ {train, valid, test, gap}.

    ``hash``: md5 bucket of ``key`` (stable across engines and runs): buckets
    ``[0, n-valid-test)`` train, the next ``valid`` valid, the last ``test``
    test. ``time``: ``cutoff >= test_cutoff`` test, ``>= valid_cutoff`` valid;
    an earlier example whose label window (``horizon``) reaches past the next
    part's first cutoff is in neither (``gap``): its label is not known then."""
    if by == "hash":
        b = md5_bucket(key, n_buckets)
        split = (F.when(b >= n_buckets - test, "test")
                  .when(b >= n_buckets - test - valid, "valid").otherwise("train"))
    elif by == "time":
        ends = F.timestamp_add("MICROSECOND", F.lit(duration_us(horizon)), F.col("cutoff"))
        split = F.when(F.col("cutoff") >= ntz_literal(test_cutoff), "test")
        split = split.when(ends > ntz_literal(test_cutoff), "gap")
        if valid_cutoff:
            split = split.when(F.col("cutoff") >= ntz_literal(valid_cutoff), "valid")
            split = split.when(ends > ntz_literal(valid_cutoff), "gap")
        split = split.otherwise("train")
    else:
        raise ValueError(by)
    return examples.withColumn("split", split)


def negative_sample(examples: DataFrame, ratio: float, seed: int = 0, key: str = "user_id",
                    group: str = "cutoff", label: str = "label", prefix_len: int = 4,
                    materialize: bool = True) -> DataFrame:
    """P18. All positives plus, per ``group``, the ``floor(ratio * positives)``
    negatives with the smallest md5('<key>:<seed>') (ties by ``key``).

    No per-group window over all negatives: negatives are counted per
    (group, leading ``prefix_len`` hex digits of the hash); prefix counts
    locate the boundary prefix, everything below it is kept, and only the
    boundary prefix is ranked. The count table has at most
    groups × 16^prefix_len rows and is broadcast only if it is small. Rows
    with a NULL label are neither positive nor negative and are left out.
    The examples are read by four branches, so by default they are first
    checkpointed to the shared checkpoint folder."""
    if materialize:
        checkpoint_dir(examples.sparkSession)
        examples = examples.checkpoint(eager=True)
    h = md5_key(key, seed)
    ex = examples.withColumn("_h", h).withColumn("_p", F.substring("_h", 1, prefix_len))
    pos = ex.where(F.col(label) == 1)
    neg = ex.where(F.col(label) != 1)
    quota = (pos.groupBy(group).agg(F.floor(F.count(F.lit(1)) * F.lit(ratio)).alias("_q")))
    counts = neg.groupBy(group, "_p").agg(F.count(F.lit(1)).alias("_c"))
    wc = Window.partitionBy(group).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    counts = (counts.withColumn("_before", F.coalesce(F.sum("_c").over(wc), F.lit(0)))
                    .join(quota, group)
                    .where(F.col("_before") < F.col("_q")))
    # prefixes entirely inside the quota, and the one that straddles it
    cnt_b = bounded_broadcast(counts.select(group, "_p", "_before", "_c", "_q"))
    cand = neg.join(cnt_b, [group, "_p"])
    full = cand.where(F.col("_before") + F.col("_c") <= F.col("_q"))
    edge = cand.where(F.col("_before") + F.col("_c") > F.col("_q"))
    w = Window.partitionBy(group, "_p").orderBy("_h", key)
    edge = (edge.withColumn("_r", F.row_number().over(w))
                .where(F.col("_before") + F.col("_r") <= F.col("_q")))
    cols = examples.columns
    return pos.select(*cols).unionByName(full.select(*cols)).unionByName(edge.select(*cols))


def target_encode(examples: DataFrame, category: str, label: str = "label",
                  prior_weight: float = 10.0, time_col: str = "cutoff",
                  horizon: str = "0s") -> DataFrame:
    """P19. Per example, the smoothed positive rate of its ``category`` using
    only examples whose label was known by then: those of earlier
    ``time_col`` values ``c'`` whose label window is closed,
    ``c' + horizon <= c``:
    ``(pos_prev + w * prior) / (n_prev + w)``, where ``prior`` is the overall
    rate over the same examples. NULL when there is none. A NULL category is
    a category of its own; rows without a label don't count.

    Examples are first reduced to (category, cutoff) counts. What is known at
    a cutoff is the running sum up to the last closed cutoff before it, so
    each cutoff's counts are moved to the first cutoff that may use them (one
    row per cutoff decides that) and summed along."""
    h = duration_us(horizon)
    cat, t = F.col(category), F.col(time_col)
    # a missing category joins and groups like any other value
    examples_ = examples.withColumn("_cat", F.struct(cat.isNull(), cat))
    per = examples_.groupBy("_cat", t.alias("_t")).agg(
        F.count(F.col(label)).alias("_n"), F.coalesce(F.sum(F.col(label).cast("long")), F.lit(0)).alias("_pos"))
    # the cutoffs: a short list, one row each
    cuts = per.select("_t").distinct()
    ahead = Window.orderBy(micros("_t")).rangeBetween(max(h, 1), Window.unboundedFollowing)
    usable = cuts.withColumn("_from", F.min("_t").over(ahead)).where(F.col("_from").isNotNull())
    moved = per.join(F.broadcast(usable), "_t").groupBy("_cat", F.col("_from").alias("_t")).agg(
        F.sum("_n").alias("_n"), F.sum("_pos").alias("_pos"))
    grid = per.select("_cat", "_t").join(moved, ["_cat", "_t"], "full_outer")
    upto = Window.partitionBy("_cat").orderBy("_t").rowsBetween(Window.unboundedPreceding, 0)
    known = grid.select("_cat", "_t", F.coalesce(F.sum("_n").over(upto), F.lit(0)).alias("_n_prev"),
                        F.coalesce(F.sum("_pos").over(upto), F.lit(0)).alias("_pos_prev"))
    tot = cuts.join(moved.groupBy("_t").agg(F.sum("_n").alias("_n"), F.sum("_pos").alias("_pos")), "_t", "left")
    te = Window.orderBy("_t").rowsBetween(Window.unboundedPreceding, 0)  # one row per cutoff
    tot = tot.select("_t", F.try_divide(F.sum("_pos").over(te), F.sum("_n").over(te)).alias("_prior"))
    w = F.lit(prior_weight)
    enc = known.join(F.broadcast(tot), "_t").select(
        "_cat", F.col("_t").alias(time_col),
        ((F.col("_pos_prev") + w * F.col("_prior")) / (F.col("_n_prev") + w)).alias("te"))
    return examples_.join(enc, ["_cat", time_col], "left").select(*examples.columns, "te")
